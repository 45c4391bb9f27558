"""Phrase collocations by multikey three-way quicksort of suffix pointers.

A text's pieces are cut at punctuation and line ends; every word of a piece
starts a suffix, of which the first ``MAX_WORDS`` words are sorted. All is per
language.

1. Routing. Suffixes are dealt over the cluster by their leading word. A
   leading word with more than ``1 / (SPLIT * partitions)`` of all occurrences
   is hot; its suffixes are dealt by two words, and where these are hot too (they
   can only be if both words are) by three, and so on. So there are at most
   ``SPLIT * partitions`` hot strings of each length, which is all that is sent
   to the tasks. Equal suffixes of one slice of texts are one, with a weight,
   before they are dealt.
2. Sorting. A task sorts the suffixes of its leading words by multikey
   three-way quicksort: a partition is split by the word of one suffix, the
   pivot, into less, equal and greater; the equal part goes on with the next
   word. Its weight is the count of the phrase. All partitions of a depth step
   are split at once, with pointers in arrays. As all suffixes of a leading word
   are there, a partition with less than ``least`` is infrequent everywhere and is
   abandoned. (Under a hot string that is dealt deeper, counts of the string
   itself are partial and are added up afterwards.)
3. Candidates are scored at their weakest cut by joins with the counts of
   their parts; those inside a longer candidate with ``contained`` percent of
   their count or more are dropped.

Defined cases: null texts are empty, a null language is ``und``; repeated rows
count each; words never span pieces or texts; ties in the cut go to the smallest
first part; other columns take no part; an empty table gives no phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relaylake.llm.common import read_table, slices, stored, utf8
from relaylake.llm.spans import LOWER, word_spans

MAX_WORDS = 3
LEAST = 10
CONTAINED = 50
TOP = 2000
SPLIT = 8
SLICE_BYTES = 3 << 20  # of texts that a task holds as words at once, about 40 times that in arrays
TASK_ROWS = 1 << 19  # suffixes that a task sorts at once, or one leading string's
NO_LANG = "und"

ENDS_PIECE = np.zeros(256, dtype=bool)
ENDS_PIECE[[ord(x) for x in ".,;:!?"]] = True
ENDS_PIECE[0x0A:0x0E] = True
IN_WORD = ~ENDS_PIECE
IN_WORD[[0x20, 0x09]] = False


def short_parts(part: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Languages, lower-cased bytes and row offsets; one very long text in
    parts cut at piece ends."""
    data, offsets = utf8(part.column("text"))
    data = LOWER[data]
    if part.num_rows > 1 or len(data) <= SLICE_BYTES:
        yield part.column("lang"), data, offsets
        return
    ends = np.flatnonzero(ENDS_PIECE[data]) + 1
    cuts, at = [0], 0
    while at + SLICE_BYTES < len(data) and len(ends):
        k = np.searchsorted(ends, at + SLICE_BYTES, side="right") - 1
        at = int(ends[k]) if k >= 0 and ends[k] > at else int(ends[k + 1]) if k + 1 < len(ends) else len(data)
        cuts.append(at)
    for a, b in zip(cuts, cuts[1:] + [len(data)]):
        yield part.column("lang"), data[a:b], np.array([0, b - a])


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, each word's code, its row, and how many words of its
    piece follow."""
    starts, ends, first = word_spans(data, offsets, IN_WORD)
    n = len(starts)
    packed = data[IN_WORD[data]]
    at = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=at[1:])
    words = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(at), pa.py_buffer(packed)])
    coded = words.dictionary_encode()
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    marks = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(ENDS_PIECE[data], out=marks[1:])
    piece = marks[starts]
    last = np.ones(n, dtype=bool)
    last[:-1] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
    stops = np.flatnonzero(last)
    follow = np.repeat(stops, np.diff(stops, prepend=-1)) - np.arange(n)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), row, follow


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``languages, language of each word, distinct words, codes, follow``."""
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            for lang, data, offsets in short_parts(part):
                names = lang.dictionary_encode()
                words, code, row, follow = words_of(data, offsets)
                if len(code):
                    yield names.dictionary.to_pylist(), names.indices.to_numpy(zero_copy_only=False)[row], words, code, follow


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, keys ascending, and how many there are."""
    _, at, count = np.unique(key, return_index=True, return_counts=True)
    return at, count


def unigrams(docs: DataFrame) -> DataFrame:
    """``lang, phrase, f`` of all words, written once."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, lang, words, code, _ in parts_of(batches):
            at, c = grouped(lang.astype(np.int64) * len(words) + code)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()).take(pa.array(lang[at])), words.take(pa.array(code[at])).cast(pa.string()), pa.array(c, pa.int64())],
                names=["lang", "phrase", "f"])

    counts = texts_of(docs).mapInArrow(count, "lang string, phrase string, f long")
    return stored(counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "phrases-1")


def codes_of(strings: set, langs: list[str], words: pa.Array) -> np.ndarray:
    """For each language and distinct word whether it is in ``strings``."""
    if len(strings) < len(words):
        names = list({w for _, w in strings})
        at = pc.index_in(words, value_set=pa.array(names, words.type)).fill_null(len(names)).to_numpy()
        return np.array([[(x, w) in strings for w in names] + [False] for x in langs], dtype=bool)[:, at]
    have = words.to_pylist()
    return np.array([[(x, w) in strings for w in have] for x in langs], dtype=bool).reshape(len(langs), len(have))


def run_keys(lang: np.ndarray, code: np.ndarray, size: int, at: np.ndarray, m: int) -> np.ndarray:
    """One number for each run of ``m`` words from the places ``at``, equal
    where language and words are."""
    key = lang[at].astype(np.int64)
    for k in range(m):
        if len(key) and int(key.max()) > (1 << 62) // size:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * size + code[at + k]
    return key


def run_texts(words: pa.Array, code: np.ndarray, at: np.ndarray, m: int) -> pa.Array:
    out = words.take(pa.array(code[at]))
    for k in range(1, m):
        out = pc.binary_join_element_wise(out, words.take(pa.array(code[at + k])), pa.scalar(" ", words.type))
    return out


def is_hot(hot: list[set], langs, lang, words, code, follow) -> np.ndarray:
    """How many leading words of each suffix are a hot string."""
    depth = np.zeros(len(code), dtype=np.int8)
    single = codes_of(hot[0], langs, words)[lang, code] if hot and hot[0] else np.zeros(len(code), dtype=bool)
    depth[single] = 1
    for m in range(2, len(hot) + 1):
        at = longer_runs(depth, single, follow, m) if hot[m - 1] else np.empty(0, np.int64)
        if not len(at):
            break
        _, where, back = np.unique(run_keys(lang, code, len(words), at, m), return_index=True, return_inverse=True)
        own = at[where]
        flags = np.array([(langs[x], w) in hot[m - 1] for x, w in zip(lang[own].tolist(), run_texts(words, code, own, m).to_pylist())], dtype=bool)
        depth[at[flags[back]]] = m
    return depth


def longer_runs(depth: np.ndarray, single: np.ndarray, follow: np.ndarray, m: int) -> np.ndarray:
    """Places of ``m`` hot words of which the first ``m - 1`` are a hot string."""
    at = np.flatnonzero((depth == m - 1) & (follow >= m - 1))
    return at[np.all([single[at + k] for k in range(1, m)], axis=0)] if len(at) else at


def hot_strings(docs: DataFrame, singles: DataFrame, max_words: int, limit: int) -> list[set]:
    """Strings of 1, 2 … words with more than ``limit`` occurrences. As
    ``limit`` is a share of all, their number is bounded by the share."""
    hot = [{(r.lang, r.phrase) for r in singles.where(F.col("f") > limit).select("lang", "phrase").toLocalIterator()}]
    while hot[-1] and len(hot) < max_words - 1:
        m = len(hot) + 1
        below = list(hot)

        def count(batches: Iterator[pa.RecordBatch], m=m, below=below) -> Iterator[pa.RecordBatch]:
            for langs, lang, words, code, follow in parts_of(batches):
                single = codes_of(below[0], langs, words)[lang, code]
                at = longer_runs(is_hot(below, langs, lang, words, code, follow), single, follow, m)
                if len(at):
                    where, c = grouped(run_keys(lang, code, len(words), at, m))
                    own = at[where]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(langs, pa.string()).take(pa.array(lang[own])), run_texts(words, code, own, m).cast(pa.string()), pa.array(c, pa.int64())],
                        names=["lang", "phrase", "f"])

        counts = texts_of(docs).mapInArrow(count, "lang string, phrase string, f long")
        counts = counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") > limit)
        hot.append({(r.lang, r.phrase) for r in counts.select("lang", "phrase").toLocalIterator()})
    return hot


def suffixes(docs: DataFrame, hot: list[set], max_words: int) -> DataFrame:
    """``lang, lead, k``: suffixes by their ``k`` leading words, one more than
    are hot, or all there are (``cut``); ``rest``: the words that follow, a line
    for each suffix; ``weights``: their numbers."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, lang, words, code, follow in parts_of(batches):
            n, size = len(code), len(words) + 1
            depth = np.minimum(is_hot(hot, langs, lang, words, code, follow) + 1, max_words)
            keys = [lang.astype(np.int64), code] + [np.where(follow >= k, code[np.minimum(np.arange(n) + k, n - 1)], size - 1) for k in range(1, max_words)]
            key = keys[0]
            for k in keys[1:]:  # of the words so far, as numbers in order
                key = key * size + k
                if int(key.max()) > (1 << 62) // size:
                    key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            at, count = grouped(key)
            codes = np.stack([k[at] for k in keys], axis=1)
            k = depth[at].astype(np.int64)  # equal suffixes have equal leads
            cut = k > follow[at] + 1
            k = np.minimum(k, follow[at] + 1)
            new = np.ones(len(at), dtype=bool)
            new[1:] = k[1:] != k[:-1]
            for j in range(max_words + 1):
                new[1:] |= (codes[1:, j] != codes[:-1, j]) & (j <= k[1:])
            edge = np.flatnonzero(new)
            names = pa.concat_arrays([words.cast(pa.large_string()), pa.array([""], pa.large_string())])
            word = lambda j, rows: names.take(pa.array(codes[rows, j]))
            blank, line = pa.scalar(" ", pa.large_string()), pa.scalar("\n", pa.large_string())
            lead = word(1, edge)
            for j in range(2, max_words):
                there = pa.array(k[edge] >= j)
                lead = pc.if_else(there, pc.binary_join_element_wise(lead, word(j, edge), blank), lead)
            full = k[edge] >= max_words
            if max_words > 1 and full.any():
                lead = pc.if_else(pa.array(full), pc.binary_join_element_wise(lead, word(max_words, edge), blank), lead)
            every = np.arange(len(at))
            rest = pa.array([""] * len(at), pa.large_string())
            for j in range(2, max_words + 1):
                more = (j > k) & (codes[:, j] < size - 1)
                empty = pc.equal(pc.binary_length(rest), 0)
                joined = pc.if_else(empty, word(j, every), pc.binary_join_element_wise(rest, word(j, every), blank))
                rest = pc.if_else(pa.array(more), joined, rest)
            rest = pc.binary_join_element_wise(rest, pa.scalar("", pa.large_string()), line)
            ends, bytes_ = np.frombuffer(rest.buffers()[1], np.int64)[rest.offset:rest.offset + len(rest) + 1], rest.buffers()[2]
            bounds = np.append(ends[edge], ends[-1])
            blobs = pa.Array.from_buffers(pa.large_binary(), len(edge), [None, pa.py_buffer(np.ascontiguousarray(bounds)), bytes_])
            weights = pa.Array.from_buffers(pa.large_binary(), len(edge), [
                None, pa.py_buffer(np.append(edge, len(at)).astype(np.int64) * 8), pa.py_buffer(count.astype(np.int64))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()).take(pa.array(codes[edge, 0])), lead.cast(pa.string()), pa.array(k[edge], pa.int32()), pa.array(cut[edge]),
                 blobs.cast(pa.binary()), weights.cast(pa.binary())], names=["lang", "lead", "k", "cut", "rest", "weights"])

    return texts_of(docs).mapInArrow(deal, "lang string, lead string, k int, cut boolean, rest binary, weights binary")


def three_way(keys: np.ndarray, weight: np.ndarray, begin: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort, all partitions at once.

    ``keys``: a row of word codes for each suffix, -1 after its end; ``begin``:
    where groups start, each sorted for itself. Yields ``depth``, a suffix and
    the weight of every equal partition with ``least`` or more: all suffixes of
    the group whose first ``depth`` words are the suffix's."""
    n, deepest = keys.shape
    order = np.arange(n)
    low, high = begin, np.append(begin[1:], n)
    depth = np.zeros(len(low), dtype=np.int64)
    while len(low) and deepest:
        size = high - low
        offset = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(low)), size)
        slot = np.arange(len(owner)) + np.repeat(low - offset, size)
        own = order[slot]
        key = keys[own, np.repeat(depth, size)]
        pivot = key[offset + size // 2]
        of_owner = np.repeat(pivot, size)
        box = owner * 3
        box += key >= of_owner
        box += key > of_owner  # 0 less, 1 equal, 2 greater
        w = np.bincount(box, weights=weight[own], minlength=3 * len(low)).astype(np.int64)  # exact below 2**53
        sizes = np.bincount(box, minlength=3 * len(low))
        full = (sizes > 0) & (w >= least)  # the others are abandoned
        equal = np.zeros(3 * len(low), dtype=bool)
        equal[1::3] = pivot >= 0
        at_depth = np.repeat(depth, 3)
        found = np.flatnonzero(full & equal)
        further = full.copy()
        further[1::3] &= (pivot >= 0) & (depth + 1 < deepest)
        # what goes on, or is given out, box after box
        needed = full[box]
        box, own = box[needed], own[needed]
        own = own[np.argsort(box, kind="stable")]
        sizes = np.where(full, sizes, 0)
        start = np.cumsum(sizes) - sizes
        for d in np.unique(at_depth[found]):
            here = found[at_depth[found] == d]
            yield int(d) + 1, own[start[here]], w[here]
        at_depth[1::3] += 1
        order, low, high, depth = own, start[further], (start + sizes)[further], at_depth[further]


LEAD = ["lang", "lead", "k", "cut"]


def lead_groups(table: pa.Table) -> np.ndarray:
    """First rows of the runs of rows with one lead."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for name in LEAD:
        column = table.column(name).combine_chunks()
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def sizes_of(column: pa.Array) -> np.ndarray:
    return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def sorted_chunk(table: pa.Table, max_words: int, least: int) -> Iterator[pa.RecordBatch]:
    """Phrases of whole leads: ``lang, phrase, words, f, whole``."""
    begin = lead_groups(table)
    weights = table.column("weights").combine_chunks()
    number = sizes_of(weights) // 8  # suffixes of each row
    weight = utf8(weights)[0].view(np.int64)
    before = np.cumsum(number) - number
    total = np.add.reduceat(weight, before[begin])
    heads = table.select(LEAD).take(pa.array(begin))
    k, cut = heads.column("k").to_numpy(), heads.column("cut").to_numpy()

    def phrases(lead: pa.Table, texts: pa.Array, words: np.ndarray, f: np.ndarray, whole: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [lead.column("lang").combine_chunks(), texts.cast(pa.string()), pa.array(words, pa.int32()), pa.array(f, pa.int64()), pa.array([whole] * len(f), pa.bool_())],
            names=["lang", "phrase", "words", "f", "whole"])

    for m in range(2, max_words):  # hot strings: in part
        some = np.flatnonzero((k > m) | (k == m) & cut)
        if len(some):
            lead = heads.take(pa.array(some))
            texts = pa.array([" ".join(x.split(" ")[:m]) for x in lead.column("lead").to_pylist()], pa.string())
            yield phrases(lead, texts, np.full(len(some), m), total[some], False)
    some = np.flatnonzero((k > 1) & ~cut & (total >= least))  # all suffixes of the lead are here
    if len(some):
        lead = heads.take(pa.array(some))
        yield phrases(lead, lead.column("lead").combine_chunks(), k[some], total[some], True)
    live = (total >= least) & ~cut & (k < max_words)  # the others are abandoned
    rows = np.repeat(live, np.diff(np.append(begin, table.num_rows)))
    if not rows.any():
        return
    owner = np.repeat(np.repeat(np.arange(len(begin)), np.diff(np.append(begin, table.num_rows)))[rows], number[rows])
    weight = weight[np.repeat(rows, number)]
    text, _ = utf8(table.column("rest").filter(pa.array(rows)).combine_chunks())
    line_end = text == 0x0A
    inside = ~line_end & (text != 0x20)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    line = np.cumsum(line_end, dtype=np.int32)[starts]
    at = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(stops - starts, out=at[1:])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(text[inside]))]).dictionary_encode()
    place = np.arange(len(starts))
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = line[1:] != line[:-1]
    keys = np.full((len(owner), max_words - 1), -1, dtype=np.int32)
    keys[line, place - np.maximum.accumulate(np.where(fresh, place, 0))] = words.indices.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    for depth, own, count in three_way(keys, weight, first, least):
        lead = heads.take(pa.array(owner[own]))
        texts = lead.column("lead").combine_chunks().cast(pa.large_string())
        for j in range(depth):
            texts = pc.binary_join_element_wise(texts, words.dictionary.take(pa.array(keys[own, j])), pa.scalar(" ", pa.large_string()))
        yield phrases(lead, texts, k[owner[own]] + depth, count, True)


def phrase_counts(dealt: DataFrame, max_words: int, least: int) -> DataFrame:
    """``lang, phrase, words, f`` of the phrases of two words and more with
    ``least`` or more occurrences."""
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, enough = [], 0, TASK_ROWS
        for batch in batches:
            held.append(batch)
            n += int(sizes_of(batch.column("weights")).sum()) // 8
            if n >= enough:
                table = pa.Table.from_batches(held)
                last = int(lead_groups(table)[-1])  # more rows of this lead may follow
                if last:
                    yield from sorted_chunk(table.slice(0, last), max_words, least)
                    table = table.slice(last)
                    n = int(sizes_of(table.column("weights").combine_chunks()).sum()) // 8
                enough = max(TASK_ROWS, 2 * n)
                held = table.combine_chunks().to_batches()
        if held and n:
            yield from sorted_chunk(pa.Table.from_batches(held), max_words, least)

    routed = dealt.repartition(*LEAD).sortWithinPartitions(*LEAD)
    found = stored(routed.mapInArrow(sort, "lang string, phrase string, words int, f long, whole boolean"), "phrases-sorted")
    partial = found.where("NOT whole").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return found.where("whole").select("lang", "phrase", "words", "f").unionByName(partial)


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, contained: int = CONTAINED, split: int = SPLIT) -> DataFrame:
    """``lang, phrase, words, a, l, r, n, score`` of all candidates that stay."""
    spark = docs.sparkSession
    singles = unigrams(docs)
    totals = stored(singles.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals")
    n = totals.agg(F.sum("n")).first()[0] or 0
    limit = n // (split * int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = hot_strings(docs, singles, max_words, max(limit, least))
    counts = stored(phrase_counts(suffixes(docs, hot, max_words), max_words, least), "phrase-counts")
    every = stored(counts.select("lang", "phrase", "f").unionByName(singles.where(F.col("f") >= least)), "phrase-parts")
    words = F.split("phrase", " ", -1)
    cuts = counts.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("tail", F.expr("substring_index(phrase, ' ', k - words)"))
    cuts = stored(cuts.join(every.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]), "phrase-heads")
    cuts = stored(cuts.join(every.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]), "phrase-cuts")
    cuts = cuts.withColumn("score", F.expr(
        "cast((cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(18,0))) as bigint)"))
    scored = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' ', -1), i, m), ' '))))")
    longer = (counts.where("words > 2").select("lang", F.col("f").alias("longer"), F.explode(inner).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {contained} * a")
    return kept.join(F.broadcast(totals), "lang").select(  # one row a language
        "lang", "phrase", "words", "a", "x.l", "x.r", "n", "x.score")


def best(found: DataFrame, top: int = TOP, salts: int = 64) -> DataFrame:
    """Each language's first ``top`` with ``rank``, found per salt first, so
    that a language's candidates don't meet in one task."""
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = (found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
           .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*by))).where(F.col("rank") <= top))
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top).drop("salt")


def op11_phrase_quicksort(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = best(stored(collocations(read_table(spark, sf_dir, "documents").select("lang", "text")), "phrases"))
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
