"""Target-distribution importance resampling on hashed word runs.

Documents are drawn in proportion to how much more likely their features are
in a target (``benchmark``) than in the corpus. Features are words and pairs of
consecutive words; a feature's bucket is the CRC-32 of its bytes.

The corpus's most frequent distinct words form an Aho-Corasick dictionary. Each
is a pattern bounded by a delimiter on both sides, so at any place at most one
of them ends, and it is a whole word; it carries as payload the CRC and the
length of the word. A scan of a text emits the payloads in order. The CRC of a
pair is composed of two adjacent payloads: the first word's, with the space,
is moved past as many zero bytes as the second one is long (a linear map, in a
table for each length) and added to the second's. Pairs are never put together
or hashed as strings.

The dictionary is bounded by ``WORDS`` entries of at most ``WORD_BYTES`` bytes;
words outside it get their payload directly, so the results don't depend on
the bound. Bucket counts are summed per task before they are shuffled; the ten
thousand gains are what the scoring scan is given.

Defined cases: null texts have no words; repeated rows count and are drawn each
for itself; null ids come last in ties and take the noise of the text ``7:null``;
an empty target or corpus counts 0 in every bucket; other columns take no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relaylake.llm.common import read_table, slices, stored, utf8
from relaylake.llm.spans import LOWER, word_spans

BUCKETS = 10000
WORDS = 1 << 16
WORD_BYTES = 64
MIN_WORDS = 20
PERCENT = 25
SEED = 7
SLICE_BYTES = 1 << 21

IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[0x30:0x3A] = True
IN_WORD[0x61:0x7B] = True
IN_WORD[0x80:] = True
DELIMITED = np.where(IN_WORD, np.arange(256), 0x20).astype(np.uint8)  # after lower-casing


def zero_bytes(crc: np.ndarray) -> np.ndarray:
    """The map that one zero byte makes of a CRC, for many."""
    table = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)
    return table[crc & 0xFF] ^ (crc >> np.uint32(8))


def shift_tables(longest: int) -> np.ndarray:
    """``[length, byte, value]``: what ``length`` zero bytes make of a CRC whose
    other bytes are 0; a CRC's image is the sum of four of them."""
    now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [now]
    for _ in range(longest):
        now = zero_bytes(now)
        out.append(now)
    return np.stack(out)


SHIFT = shift_tables(WORD_BYTES)


def composed(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of two strings one after the other, of their CRCs and the second's length."""
    moved, left = first.copy(), length.copy()
    while len(left) and left.max() > 0:
        step = np.minimum(left, WORD_BYTES)
        moved = (SHIFT[step, 0, moved & 0xFF] ^ SHIFT[step, 1, (moved >> np.uint32(8)) & 0xFF]
                 ^ SHIFT[step, 2, (moved >> np.uint32(16)) & 0xFF] ^ SHIFT[step, 3, moved >> np.uint32(24)])
        left = left - step
    return moved ^ second


class Dictionary:
    """Automaton over delimited words with their payloads."""

    def __init__(self, words: tuple[str, ...]):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, word in enumerate(words):
            self.automaton.add_word(f" {word} ", k)
        self.automaton.make_automaton()
        self.any = bool(words)
        self.crc, self.size = payloads([w.encode() for w in words])

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRC and length of every word of the rows, and the rows' first words."""
        rows = len(offsets) - 1
        text = np.full(len(data) + 2 * rows, 0x20, dtype=np.uint8)  # a delimiter at both ends of each row
        place = np.arange(len(data)) + np.repeat(2 * np.arange(rows) + 1, np.diff(offsets))
        text[place] = DELIMITED[LOWER[data]]
        starts, ends, first = word_spans(text, offsets + 2 * np.arange(rows + 1), IN_WORD)
        crc, size = np.zeros(len(starts), dtype=np.uint32), ends - starts
        known = np.zeros(len(starts), dtype=bool)
        if self.any and len(starts):
            chars = np.cumsum((text & 0xC0) != 0x80) - 1  # a byte's place in characters
            found = np.fromiter(self.automaton.iter(text.tobytes().decode()), dtype=[("end", np.int64), ("id", np.int64)])
            word = np.searchsorted(chars[ends], found["end"])  # the delimiter behind a word ends its match
            crc[word] = self.crc[found["id"]]
            known[word] = True
        rest = np.flatnonzero(~known)
        if len(rest):
            view = memoryview(text)
            crc[rest] = [zlib.crc32(view[a:b]) for a, b in zip(starts[rest].tolist(), ends[rest].tolist())]
        return crc, size, first


_built: dict[tuple[str, ...], Dictionary] = {}


def dictionary(words: tuple[str, ...]) -> Dictionary:
    """Built once in each Python worker."""
    if words not in _built:
        _built.clear()
        _built[words] = Dictionary(words)
    return _built[words]


def payloads(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([zlib.crc32(w) for w in words], dtype=np.uint32), np.array([len(w) for w in words], dtype=np.int64)


def features(known: Dictionary, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words, of all pairs (of a word and the next one; -1 at a
    row's end), and the rows' first words."""
    data, offsets = utf8(part.column("text"))
    crc, size, first = known.scan(data, offsets)
    pairs = np.full(len(crc), -1, dtype=np.int64)
    if len(crc) > 1:
        spaced = composed(crc[:-1], np.full(len(crc) - 1, zlib.crc32(b" "), np.uint32), np.ones(len(crc) - 1, np.int64))
        pairs[:-1] = composed(spaced, crc[1:], size[1:]) % BUCKETS
    last = first[1:][np.diff(first) > 0] - 1
    pairs[last] = -1
    return (crc % BUCKETS).astype(np.int64), pairs, first


def texts_of(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(*more, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def frequent_words(docs: DataFrame, words: int = WORDS) -> tuple[str, ...]:
    """The most frequent distinct words, ``words`` at most, none longer than
    ``WORD_BYTES`` bytes. Counts are ranked by level (eight to a doubling), so
    that no task sends more than its share of the words."""
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                data, offsets = utf8(part.column("text"))
                text = LOWER[data]
                starts, ends, _ = word_spans(text, offsets, IN_WORD)
                at = np.zeros(len(starts) + 1, dtype=np.int64)
                np.cumsum(ends - starts, out=at[1:])
                packed = np.ascontiguousarray(text[IN_WORD[text]])
                found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(packed)])
                counts = found.value_counts()
                yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.string()), counts.field(1)], names=["word", "n"])

    counts = texts_of(docs).mapInArrow(distinct, "word string, n long").where(F.octet_length("word") <= WORD_BYTES)
    counts = counts.groupBy("word").agg(F.sum("n").alias("n"))
    counts = stored(counts.withColumn("level", F.floor(8 * F.log2("n")).cast("int")), "resampling-words")
    levels = {r.level: r["count"] for r in counts.groupBy("level").count().collect()}  # a few hundred at most
    room, least = words, None
    for level in sorted(levels, reverse=True):
        if levels[level] > room:
            break
        room, least = room - levels[level], level
    top = [] if least is None else [r.word for r in counts.where(F.col("level") >= least).select("word").collect()]
    next_level = max((x for x in levels if least is None or x < least), default=None)
    if room and next_level is not None:  # any of the next level will do
        top += [r.word for r in counts.where(F.col("level") == next_level).select("word").limit(room).collect()]
    return tuple(sorted(top))


def bucket_counts(docs: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """``bucket, n`` of all features."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = dictionary(words), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                single, pairs, _ = features(known, part)
                total += np.bincount(single, minlength=BUCKETS) + np.bincount(pairs[pairs >= 0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return texts_of(docs).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, words: tuple[str, ...]) -> np.ndarray:
    """A bucket's gain in thousandths of the log ratio, smoothed by one."""
    s, t = [0] * BUCKETS, [0] * BUCKETS
    for into, docs in ((s, corpus), (t, target)):
        for r in bucket_counts(docs, words).collect():  # BUCKETS rows at most
            into[r.bucket] = r.n
    return np.array([math.floor(1000 * math.log((float(b + 1) * float(sum(s) + BUCKETS)) / (float(a + 1) * float(sum(t) + BUCKETS))))
                     for a, b in zip(s, t)], dtype=np.int64)


def weighed(docs: DataFrame, target: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row."""
    known = frequent_words(docs, words)
    gain = gains(docs, target, known)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                single, pairs, first = features(dictionary(known), part)
                sums = np.append(0, np.cumsum(gain[single] + np.where(pairs >= 0, gain[pairs], 0)))
                n = np.diff(first)
                many = n + np.maximum(n - 1, 0)
                weight = np.where(many > 0, (sums[first[1:]] - sums[first[:-1]]) // np.maximum(many, 1), 0)  # down
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(many, pa.int64()), pa.array(weight, pa.int64())],
                                                 names=["doc_id", "n_words", "n_features", "weight"])

    return texts_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """Gumbel noise of a document, in thousandths, fixed by seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, words: int = WORDS) -> DataFrame:
    """Adds ``score`` and, for the rows drawn, ``rank`` to ``weighed``: of the N
    rows with ``min_words`` words the ``percent * N / 100`` highest scores.

    Rows are sorted over the whole cluster in ranges (equal scores are cut apart
    by id and a row number); a row's rank is its number in its range and the
    rows of the ranges before it."""
    rows = weighed(docs, target, words).withColumn("score", F.col("weight") + noise(seed)).withColumn("_in", F.col("n_words") >= min_words)
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "resampling-scores")
    drawn = rows.agg(F.count_if("_in")).first()[0] * percent // 100
    by = [F.desc("_in"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    ranged = stored(ranged.withColumn("_range", F.shiftright("_at", 33)), "resampling-ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))  # a row a range
    place = F.col("_before") + F.col("_at") - F.shiftleft("_range", 33) + 1
    return (ranged.join(F.broadcast(sizes), "_range")
            .select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("_in") & (place <= drawn), place).alias("rank")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampled(docs, read_table(spark, sf_dir, "benchmark").select("text")).select("doc_id", "n_features", "weight", "score", "rank")
