"""Near-duplicates against all pairs on plain Python sets."""

import random
import re

from relaylake.llm import odd_sketch_dedup as od
from relaylake.llm.components import components

SCHEMA = "doc_id long, text string, n string, node string, band string"


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 3:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(words, words[1:], words[2:]))


def brute(rows, percent=85):
    big = (1 << 63) - 1
    sets = [sets_of(r[1]) for r in rows]
    ids = [big if r[0] is None else r[0] for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * len(sets[i] | sets[j]):
                    root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), big), ids[i])
    return sorted(((rows[i][0], len(sets[i]), None if least[find(i)] == big else least[find(i)], ids[i] == least[find(i)]) for i in range(len(rows))), key=repr)


def varied(rng, words, rate, vocab):
    return [rng.choice(vocab) if rng.random() < rate else w for w in words]


def corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([5, 40, 200, 1500]))]
        for _ in range(rng.randint(1, 12)):
            rows.append(" ".join(varied(rng, base, rng.choice([0, 0.005, 0.02, 0.03, 0.05, 0.1]), vocab)))
    hot = [rng.choice(vocab) for _ in range(150)]
    rows += [" ".join(varied(rng, hot, 0.015, vocab)) for _ in range(80)]
    chain = [rng.choice(vocab) for _ in range(260)]
    rows += [" ".join(chain[i:i + 200]).upper() for i in range(0, 60, 6)]
    rows += ["one two", "ONE  two", "solo", "", " \n", "a b c", "a\tb\x0bc", "ü Ü ü"]
    rng.shuffle(rows)
    table = [(i, t, "x", "y", "z") for i, t in enumerate(rows)]
    return table + [(None, None, None, None, None), (None, rows[3], "", "", ""), table[5], (900, None, "", "", "")]


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = od.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_filter_keeps_one_and_empty_tables(spark):
    rows = [(3, "a b c d e", "", "", ""), (1, "A b c d e", "", "", ""), (2, "other words stand here now", "", "", ""), (4, None, "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = od.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    assert od.near_duplicates(docs.limit(0)).count() == 0


def test_filter_keeps_one_row_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near, far = text + " more", " ".join(f"v{i}" for i in range(60))
    rows = [(1, far), (1, far), (1, far)]  # loaded twice and more
    rows += [(2, text.replace("w", "a")), (2, near.replace("w", "a"))]  # one id, two nearly equal texts
    rows += [(None, text), (None, near), (None, text)]  # a group without ids
    rows += [(None, text.replace("w", "b")), (7, near.replace("w", "b")), (7, near.replace("w", "b"))]
    rows += [(None, None), (None, ""), (5, " "), (5, " ")]  # without words
    docs = spark.createDataFrame([(i, t, str(k), "", "") for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)
    kept = od.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text, int(r.n)) for r in kept.collect()]
    assert all(rows[k] == (i, t) for i, t, k in got)
    groups = [0 if k < 3 else 1 if k < 5 else 2 if k < 8 else 3 if k < 11 else k for _, _, k in got]
    assert sorted(groups) == [0, 1, 2, 3, 11, 12, 13, 14]
    assert [(i, t) for (i, t, _), g in zip(got, groups) if g == 3] == [(7, near.replace("w", "b"))]


def test_bands_are_not_broadcast(spark, monkeypatch):
    """Spark takes the exploded bands for as many rows as there are nodes, and
    so sent them all through the driver (F1)."""
    plans, write = {}, od.stored
    monkeypatch.setattr(od, "stored", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and write(df, name))
    assert od.near_duplicates(spark.createDataFrame([(i, f"a b c d e f {i // 2}", "", "", "") for i in range(20)], SCHEMA)).count() == 20
    assert "SortMergeJoin" in plans["buckets"] and "BroadcastHashJoin" not in plans["buckets"]


def jaccard(x, y, width):
    x, y = x.split(), y.split()
    a, b = ({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} for w in (x, y))
    return len(a & b) / len(a | b)


def test_stage_takes_five_words_and_80_percent(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(250)]
    block = " ".join(base + [f"n{i}" for i in range(48)])
    spread = " ".join("x" + w if i in (30, 80, 130, 180, 220, 240) else w for i, w in enumerate(base))
    base = " ".join(base)
    assert 0.80 <= jaccard(base, block, 5) < 0.85 and 0.80 <= jaccard(base, block, 3) < 0.85
    assert jaccard(base, spread, 5) < 0.80 < 0.85 <= jaccard(base, spread, 3)
    rows = [(1, base, "", "", ""), (2, block, "", "", ""),
            (3, base.replace("w", "z"), "", "", ""), (4, spread.replace("w", "z"), "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3, 4]
    op7 = od.near_duplicates(docs).where("kept").collect()
    assert sorted(r.doc_id for r in op7) == [1, 2, 3]
    assert [od.band_count(p) for p in (80, 85, 100)] == [40, 27, 1]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 102), (7, 7)], "a long, b long")
    got = {r.node: r.comp for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
