"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are the item windows: ten consecutive words of an item, or
all its words if it has fewer. Strings of one length form a search group. A
table over blocks of ``BLOCK`` words says how far the search place may move
on: a block that stands in no string moves it past the block, one that stands
nearest to a string's end at distance ``d`` moves it by ``d``. Where the move
is 0 the block may end a string. All rows of a slice are searched in lockstep,
each from its own place, so most words are never looked at.

The strings are cut out of the items by a Spark job and stored with the key of
their suffix block. A task holds the shift tables and a bitmap of the strings'
hashes only, both of fixed size however large the benchmark is; documents are
scanned once. Places the bitmap lets pass meet the strings of their suffix
bucket in a join that compares the words themselves. A larger benchmark makes
the moves shorter and more places pass; results don't depend on it.

Defined cases: null texts and items have no words; repeated items and rows
count each (an item id counts once); null item ids are left out of the item
list but their occurrences are hit; an empty benchmark hits nothing; other
columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relaylake.llm.common import base_columns, id_key, read_table, slices, stored, utf8
from relaylake.llm.spans import LOWER, running_hash, span_hash, word_spans

WINDOW = 10
BLOCK = 2
TABLE_BITS = 18  # entries of a shift table, of which a length has one (a byte each)
FILTER_BITS = 24  # places of the bitmap of all strings' hashes (2 MB)
LANE = 512  # places that one lane of the lockstep search covers

IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[0x30:0x3A] = True
IN_WORD[0x61:0x7B] = True
IN_WORD[0x80:] = True


def words_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, word ends, word hashes, first word of each row."""
    data, offsets = utf8(array)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, IN_WORD)
    return data, starts, ends, span_hash(running_hash(data), starts, ends), first


def block_key(hashes: np.ndarray, at: np.ndarray, block: int, bits: int) -> np.ndarray:
    """Table entry of the ``block`` words from ``at``."""
    key = hashes[at].copy()
    for k in range(1, block):
        key = key * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k]
    return ((key >> np.uint64(29)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def whole_hash(hashes: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Hash of the ``m`` words from ``at``."""
    out = np.full(len(at), m, dtype=np.uint64)
    for k in range(m):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[at + k]
    return out


def filter_place(whole: np.ndarray, bits: int) -> np.ndarray:
    return (whole >> np.uint64(64 - bits)).astype(np.int64)


def words_from(raw: bytes, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, m: int) -> list[bytes]:
    """The ``m`` words from each place, joined by blanks."""
    places = at[:, None] + np.arange(m)
    return [b" ".join([raw[i:j] for i, j in zip(x, y)]) for x, y in zip(starts[places].tolist(), ends[places].tolist())]


# ---- the strings -------------------------------------------------------------
STRING_SCHEMA = "item string, m long, suffix long, whole long, place long, words binary, blocks array<long>"


def strings_of(benchmark: DataFrame, window: int, table_bits: int, filter_bits: int) -> DataFrame:
    """One row for each item window: its words, hash and bitmap place, the key
    of its suffix block, and ``blocks``, the keys of its blocks from the last."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                data, starts, ends, hashes, first = words_of(part.column("text"))
                raw, items = data.tobytes(), part.column("item")
                for row in range(part.num_rows):
                    n = int(first[row + 1] - first[row])
                    m = min(n, window)
                    for low in range(0, n - m + 1 if m else 0, 4096):
                        at = int(first[row]) + np.arange(low, min(low + 4096, n - m + 1))
                        block = min(BLOCK, m)
                        keys = np.stack([block_key(hashes, at + j, block, table_bits) for j in range(m - block, -1, -1)], axis=1)
                        whole = whole_hash(hashes, at, m)
                        yield pa.RecordBatch.from_arrays(
                            [pa.repeat(items[row], len(at)), pa.array(np.full(len(at), m)), pa.array(keys[:, 0]), pa.array(whole.view(np.int64)),
                             pa.array(filter_place(whole, filter_bits)), pa.array(words_from(raw, starts, ends, at, m), pa.binary()),
                             pa.array(keys.tolist(), pa.list_(pa.int64()))],
                            names=["item", "m", "suffix", "whole", "place", "words", "blocks"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return items.mapInArrow(cut, STRING_SCHEMA)


def search_tables(strings: DataFrame, table_bits: int, filter_bits: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """The shift table of each length, and the bitmap. At most as many rows come
    to the driver as the tables have entries, whatever the benchmark's size."""
    near = strings.select("m", F.posexplode("blocks").alias("move", "key")).groupBy("m", "key").agg(F.min("move").alias("move")).toArrow()
    lengths, keys, moves = (near.column(c).to_numpy() for c in ("m", "key", "move"))
    shifts = {}
    for m in np.unique(lengths).tolist():
        own = lengths == m
        shifts[m] = np.full(1 << table_bits, m - min(BLOCK, m) + 1, dtype=np.uint8 if m < 255 else np.int64)
        shifts[m][keys[own]] = moves[own]
    bits = strings.select((F.expr("place div 32")).alias("word"), F.expr("shiftleft(1L, int(place % 32))").alias("bit"))
    bits = bits.groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    bitmap = np.zeros(max(1, (1 << filter_bits) // 32), dtype=np.uint32)
    bitmap[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().astype(np.uint32)
    return shifts, bitmap


# ---- the scan ----------------------------------------------------------------
def passing(hashes: np.ndarray, first: np.ndarray, m: int, shift: np.ndarray, bitmap: np.ndarray, table_bits: int, filter_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the windows of ``m`` words at which a string
    may stand, over the words of all rows."""
    b = min(BLOCK, m)
    place, stop = first[:-1] + m, first[1:]  # a place is the end of a window
    lanes = np.maximum(0, -(-(stop - place + 1) // LANE))  # long rows are searched from several places
    row = np.repeat(np.arange(len(place)), lanes)
    place = place[row] + LANE * (np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    stop = np.minimum(stop[row], place + LANE - 1)
    found = [(np.empty(0, np.int64), np.empty(0, np.uint64))]
    while len(place):
        move = shift[block_key(hashes, place - b, b, table_bits)].astype(np.int64)
        at = place[move == 0] - m
        whole = whole_hash(hashes, at, m)
        bit = filter_place(whole, filter_bits)
        some = (bitmap[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1
        found.append((at[some], whole[some]))
        place = place + np.maximum(move, 1)
        keep = place <= stop
        place, stop = place[keep], stop[keep]
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


SCAN_SCHEMA = "doc_id long, _id long, _h long, n_words long, at long, m long, suffix long, whole long, words binary"
PLACES = 8192  # places in one batch


def scanned(docs: DataFrame, shifts: dict[int, np.ndarray], bitmap: np.ndarray, table_bits: int, filter_bits: int) -> DataFrame:
    """A row for each document (``n_words``) and for each place that passes."""
    kinds = [pa.int64()] * 8 + [pa.binary()]
    names = ["doc_id", "_id", "_h", "n_words", "at", "m", "suffix", "whole", "words"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                data, starts, ends, hashes, first = words_of(part.column("text"))
                raw, n = data.tobytes(), part.num_rows
                own = [part.column(c) for c in ("doc_id", "_id", "_h")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(first), pa.int64()), *[pa.nulls(n, k) for k in kinds[4:]]], names=names)
                for m, shift in shifts.items():
                    every, wholes = passing(hashes, first, m, shift, bitmap, table_bits, filter_bits)
                    for low in range(0, len(every), PLACES):
                        at, whole = every[low:low + PLACES], wholes[low:low + PLACES]
                        row = np.searchsorted(first, at, side="right") - 1
                        block = min(BLOCK, m)
                        yield pa.RecordBatch.from_arrays(
                            [*[c.take(pa.array(row)) for c in own], pa.nulls(len(at), pa.int64()), pa.array(at - first[row], pa.int64()),
                             pa.array(np.full(len(at), m), pa.int64()), pa.array(block_key(hashes, at + m - block, block, table_bits)),
                             pa.array(whole.view(np.int64)), pa.array(words_from(raw, starts, ends, at, m), pa.binary())], names=names)

    return base_columns(docs).mapInArrow(scan, SCAN_SCHEMA)


KEY = ["_id", "_h"]
STRING = ["m", "suffix", "whole", "words"]


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, table_bits: int = TABLE_BITS,
                filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents (``doc_id, _id, _h, n_words``), the confirmed places
    (``_id, _h, at`` and the string), and the strings with their items."""
    strings = stored(strings_of(benchmark, window, table_bits, filter_bits), "wm-strings")
    shifts, bitmap = search_tables(strings, table_bits, filter_bits)
    rows = stored(scanned(docs, shifts, bitmap, table_bits, filter_bits), "wm-scan")
    known = strings.select(*STRING).distinct()
    places = rows.where(F.col("m").isNotNull()).join(known, STRING).select(*KEY, "at", *STRING)
    return rows.where(F.col("m").isNull()).select("doc_id", *KEY, "n_words"), places, strings.select("item", *STRING)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: the keys, ``n_words``, ``hits`` (flat list of word
    runs, ascending) and the sorted ``items``."""
    rows, places, strings = occurrences(docs, benchmark, **options)
    places = stored(places, "wm-places")
    ends = places.groupBy(*KEY, "at").agg(F.max(F.col("at") + F.col("m")).alias("end"))  # equal rows meet here
    before = Window.partitionBy(*KEY).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    opens = ends.withColumn("opens", (F.col("at") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("long"))
    upto = Window.partitionBy(*KEY).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = (opens.withColumn("run", F.sum("opens").over(upto)).groupBy(*KEY, "run").agg(F.min("at").alias("s"), F.max("end").alias("e"))
            .groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("runs")))
    items = (places.select(*KEY, *STRING).distinct().join(strings.where("item IS NOT NULL").distinct(), STRING)
             .groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias("items")))
    flat = F.flatten(F.transform("runs", lambda x: F.array(x["s"], x["e"])))
    return rows.join(runs, KEY, "left").join(items, KEY, "left").select(
        "doc_id", *KEY, "n_words", F.coalesce(flat, F.array().cast("array<bigint>")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def n_hit():
    return F.aggregate(F.sequence(F.lit(0), F.size("hits") - 1, F.lit(2)), F.lit(0).cast("long"),
                       lambda a, i: a + F.coalesce(F.get(F.col("hits"), i + 1) - F.get(F.col("hits"), i), F.lit(0)))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    hits = benchmark_hits(docs, benchmark, **options)
    return hits.select("doc_id", "n_words", F.when(F.size("hits") > 0, n_hit()).otherwise(0).cast("long").alias("n_hit"),
                       F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a hit, with all their columns."""
    bad = occurrences(docs, benchmark, **options)[1].select(F.col("_id").alias("_bad"), F.col("_h").alias("_bad_h")).distinct()
    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(bad, (id_key() == bad["_bad"]) & (text_hash == bad["_bad_h"]), "left_anti")


def op8_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
