"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from relaylake.llm.bfd_packing import op1_bfd_packing
from relaylake.llm.bwt_repeats import op5_bwt_repeats
from relaylake.llm.importance_resampling import op13_importance_resampling
from relaylake.llm.line_runs import op10_line_runs
from relaylake.llm.mixture_packing import op3_mixture_packing
from relaylake.llm.overlap_counts import op4_overlap_counts
from relaylake.llm.odd_sketch_dedup import op7_odd_sketch_dedup
from relaylake.llm.phrase_quicksort import op11_phrase_quicksort
from relaylake.llm.pii_bootstrap import op9_pii_bootstrap
from relaylake.llm.quality_mcd import op6_quality_mcd
from relaylake.llm.seed_extend import op12_seed_extend
from relaylake.llm.url_filter import op2_url_filter
from relaylake.llm.wu_manber import op8_wu_manber

QUERIES = {
    "op1_bfd_packing": op1_bfd_packing,
    "op2_url_filter": op2_url_filter,
    "op3_mixture_packing": op3_mixture_packing,
    "op4_overlap_counts": op4_overlap_counts,
    "op5_bwt_repeats": op5_bwt_repeats,
    "op6_quality_mcd": op6_quality_mcd,
    "op7_odd_sketch_dedup": op7_odd_sketch_dedup,
    "op8_wu_manber": op8_wu_manber,
    "op9_pii_bootstrap": op9_pii_bootstrap,
    "op10_line_runs": op10_line_runs,
    "op11_phrase_quicksort": op11_phrase_quicksort,
    "op12_seed_extend": op12_seed_extend,
    "op13_importance_resampling": op13_importance_resampling,
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

HEX = "'0123456789abcdef'"

# The results of these are fixed by their definitions alone, whatever the
# method. The other queries depend on a tokenizer, a model or a packing, or
# take windows of every byte: they are tested against brute force.
ORACLE: dict[str, str] = {
    "op7_odd_sketch_dedup": rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i:i + 2])) END AS s FROM words),
single AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM single x JOIN single y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * shared >= 85 * (len(x.s) + len(y.s) - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)""",
    "op8_wu_manber": rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
strings AS (SELECT DISTINCT item_id, m, w[i:i + m - 1] AS g FROM (SELECT *, least(len(w), 10) AS m,
    unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT doc_id, m, i, w[i:i + m - 1] AS g FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i
    FROM docs, (SELECT DISTINCT m FROM strings) WHERE len(w) >= m)),
found AS (SELECT doc_id, i, p.m, item_id FROM places p JOIN strings s ON p.m = s.m AND p.g = s.g),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS k FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op11_phrase_quicksort": rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS r, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
runs AS (SELECT lang, m, w[i:i + m - 1] AS g FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, g, CAST(count(*) AS HUGEINT) AS c FROM runs GROUP BY ALL HAVING count(*) >= 10),
cuts AS (SELECT x.lang, x.g, x.m, x.c AS a, k, h.c AS l, t.c AS r, (1000000::HUGEINT * x.c * x.c) // (h.c * t.c) AS score
  FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM f WHERE m > 1) x
  JOIN f h ON h.lang = x.lang AND h.g = x.g[1:k] JOIN f t ON t.lang = x.lang AND t.g = x.g[k + 1:]),
weak AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (SELECT lang, g, max(c) AS c FROM (SELECT lang, c, unnest([g[1:2], g[2:3]]) AS g FROM f WHERE m = 3) GROUP BY lang, g),
kept AS (SELECT w.lang, array_to_string(w.g, ' ') AS phrase, a, l, r, score FROM weak w LEFT JOIN longer o ON o.lang = w.lang AND o.g = w.g
  WHERE o.c IS NULL OR 100 * o.c < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a,
  CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000""",
    "op12_seed_extend": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT r, doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - 49)) AS i FROM docs WHERE len(w) >= 50)),
first AS (SELECT g, min(doc_id) AS least FROM places GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 49)) AS k FROM places JOIN first USING (g) WHERE doc_id > least),
rest AS (SELECT d.r, string_agg(word, ' ' ORDER BY d.k) AS kept, count(*) AS n
  FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM docs) d ANTI JOIN gone g ON g.r = d.r AND g.k = d.k GROUP BY d.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN rest USING (r)""",
    "op13_importance_resampling": rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, true AS corpus, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT NULL, NULL, false, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
features AS (SELECT r, corpus, unnest(w || list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM texts),
bytes AS (SELECT f, lower(hex(encode(f))) AS x FROM (SELECT DISTINCT f FROM features)),
steps AS (SELECT list_transform(range(256), lambda b: list_reduce([b] || [0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
buckets AS (SELECT f, xor(list_reduce([4294967295] || list_transform(generate_series(1, len(x), 2), lambda i:
  (strpos({HEX}, x[i]) - 1) * 16 + strpos({HEX}, x[i + 1]) - 1), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS b FROM bytes, steps),
counts AS (SELECT b, count(*) FILTER (corpus) AS s, count(*) FILTER (NOT corpus) AS t FROM features JOIN buckets USING (f) GROUP BY b),
gains AS (SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE)
  / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE))) AS gain FROM counts),
weights AS (SELECT r, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM features JOIN buckets USING (f) JOIN gains USING (b) WHERE corpus GROUP BY r),
scores AS (SELECT doc_id, len(w) AS n_words, CAST(len(w) + greatest(len(w) - 1, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(list_reduce(list_transform(range(1, 9), lambda i:
    (strpos({HEX}, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[i]) - 1)::BIGINT), lambda a, d: a * 16 + d) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM texts LEFT JOIN weights USING (r) WHERE corpus),
ranked AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 25 * count(*) // 100 FROM scores WHERE n_words >= 20) THEN place END AS rank FROM ranked""",
}
