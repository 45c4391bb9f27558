"""MinHash near-duplicates, candidates verified by odd sketches, then exactly.

1. Each text becomes its set of shingles of ``width`` words (64-bit hashes).
   Rows with equal sets form one class, so exact copies are one node from here on.
2. Bands of ``BAND_ROWS`` MinHash values give candidate buckets.
3. A second MinHash sample, the least hash in each of ``BINS`` bins, is folded
   into a parity bitmap (odd sketch). The population count of two sketches'
   XOR estimates in how many bins the samples differ. Candidates that are, by
   ``SIGMAS`` standard deviations, below the wanted similarity are dropped.
4. What remains is confirmed on the full sets.

A bucket of many copies never becomes all its pairs. First every node is
checked against one hub only, the node of its buckets with most neighbours;
links that hold are joined into components. Only in buckets that then still
hold several components, nodes outside the bucket's largest component are
compared, and only with nodes of other components: a link inside a component
can't change the result. Joins on buckets are plain equi-joins with the sketch
test as a condition, which adaptive execution splits where a bucket is hot.

Similarity is ``intersection / union >= percent / 100``. There are as many bands
as a pair at exactly that similarity needs to meet in none with a probability
below ``MISS``: 27 for 85 %, 40 for 80 % (1.3e-7 each).

Defined cases: texts without words are linked with nothing; a null id is never
the smallest of a group that has another (a group without ids has a null
``component_id``). In ``near_duplicates`` every row with its group's smallest id
counts as kept, so repeated rows and those of a group without ids all do;
``keep_one`` leaves one row of each group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylake.llm.common import NULL_ID, base_columns, read_table, slices, stored, unbroadcast, utf8
from relaylake.llm.components import components
from relaylake.llm.spans import LOWER, mix, running_hash, span_hash, word_spans

SHINGLE = 3
PERCENT = 85
BAND_ROWS = 5
MISS = 1.4e-7
BINS = 4096
WORDS = 32  # 64-bit words of a sketch
BITS = 64 * WORDS
SIGMAS = 4.5  # how far a sample may stray from the wanted similarity

IN_WORD = np.ones(256, dtype=bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(array: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and each row's first one."""
    data, offsets = utf8(array)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, IN_WORD)
    words = span_hash(running_hash(data), starts, ends)
    counts = np.diff(first)
    n = len(counts)
    full = np.maximum(counts - width + 1, 0)
    row = np.repeat(np.arange(n), full)
    at = np.repeat(first[:-1] - (np.cumsum(full) - full), full) + np.arange(full.sum())
    value = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        value = mix(value * STEP + words[at + k] + np.uint64(k + 1))
    short = np.flatnonzero((counts > 0) & (counts < width))
    lone = np.zeros(len(short), dtype=np.uint64)
    for k in range(width - 1):
        has = counts[short] > k
        lone[has] = mix(lone[has] * STEP + words[first[short[has]] + k] + np.uint64(k + 1))
    row, value = np.concatenate([row, short]), np.concatenate([value, lone])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(n + 1))


def band_count(percent: int) -> int:
    """Bands for which a pair at exactly ``percent`` is missed below ``MISS``."""
    meets = (percent / 100) ** BAND_ROWS
    return 1 if meets >= 1 else math.ceil(math.log(MISS) / math.log1p(-meets))


def band_functions(bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and addends of the bands' hash functions."""
    rng = np.random.default_rng(77)
    factors = rng.integers(1, 1 << 63, bands * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
    return factors, rng.integers(1, 1 << 63, bands * BAND_ROWS, dtype=np.uint64)


def band_hashes(values: np.ndarray, first: np.ndarray, factors: np.ndarray, addends: np.ndarray) -> np.ndarray:
    """``rows x bands``; rows without shingles must not be asked for."""
    bands = len(factors) // BAND_ROWS
    out = np.empty((len(first) - 1, bands), dtype=np.uint64)
    for b in range(bands):
        joined = np.full(len(first) - 1, b + 1, dtype=np.uint64)
        for r in range(b * BAND_ROWS, (b + 1) * BAND_ROWS):
            least = np.minimum.reduceat(values * factors[r] + addends[r], first[:-1])
            joined = mix(joined * STEP + least)
        out[:, b] = joined
    return out


def odd_sketches(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``rows x WORDS`` parity bitmaps of the least value in each bin."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    remixed = mix(values ^ np.uint64(0xA0761D6478BD642F))
    slot = row * BINS + (remixed >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    order = np.lexsort((remixed, slot))
    slot, least = slot[order], remixed[order]
    lead = np.ones(len(slot), dtype=bool)
    lead[1:] = slot[1:] != slot[:-1]
    bit = (mix(least[lead]) & np.uint64(BITS - 1)).astype(np.int64)
    odd = np.bincount((slot[lead] // BINS) * BITS + bit, minlength=n * BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, BITS), axis=1, bitorder="little").view("<u8")


def signatures(base: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """The columns of every row but its text, set size ``n``, set digest
    ``s1, s2``, ``bands`` and sketch ``sk``."""
    names = [c for c in base.columns if c != "text"]
    n_bands = band_count(percent)
    factors, addends = band_functions(n_bands)
    sketch = pa.struct([(f"k{i}", pa.int64()) for i in range(WORDS)])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                values, first = shingle_sets(part.column("text"), width)
                sizes = np.diff(first)
                some = np.flatnonzero(sizes)
                digest = np.zeros((2, len(sizes)), dtype=np.uint64)
                bands = np.zeros((len(sizes), n_bands), dtype=np.uint64)
                bits = np.zeros((len(sizes), WORDS), dtype=np.uint64)
                if len(some):
                    bounds = np.append(first[some], len(values))
                    digest[0, some] = np.add.reduceat(mix(values), bounds[:-1])
                    digest[1, some] = np.add.reduceat(mix(values ^ STEP), bounds[:-1])
                    bands[some] = band_hashes(values, bounds, factors, addends)
                    bits[some] = odd_sketches(values, bounds)
                signed = bits.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in names] + [
                        pa.array(sizes, pa.int64()), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * n_bands, pa.int32()), pa.array(bands.view(np.int64).ravel())),
                        pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(signed[:, i])) for i in range(WORDS)], fields=list(sketch))],
                    names=[*names, "n", "s1", "s2", "bands", "sk"])

    fields = ", ".join(f"k{i}: bigint" for i in range(WORDS))
    kept = ", ".join(f"{c} long" for c in names)
    return base.mapInArrow(sign, f"{kept}, n long, s1 long, s2 long, bands array<bigint>, sk struct<{fields}>")


def full_sets(texts: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``node`` and its sorted shingle hashes ``sh``."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                values, first = shingle_sets(part.column("text"), width)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(
                    pa.array(first, pa.int32()), pa.array(values.view(np.int64)))], names=["node", "sh"])

    return texts.select("node", "text").mapInArrow(build, "node long, sh array<bigint>")


def plausible(x: str, y: str, percent: int = PERCENT) -> Column:
    """May the nodes of ``x`` and ``y`` (struct columns with ``n`` and ``sk``)
    be that similar? Sizes first, then the sketches.

    With ``u`` the union's size at the wanted similarity ``s``, ``filled`` bins
    hold a sample; in ``(1 - s) * filled`` of them it differs, which toggles
    one bit or, if both sets fill the bin, two. Bins sample without
    replacement, so the spread shrinks with the share of the union sampled.
    """
    s = percent / 100.0
    na, nb = F.col(f"{x}.n").cast("double"), F.col(f"{y}.n").cast("double")
    both = F.bit_count(F.col(f"{x}.sk.k0").bitwiseXOR(F.col(f"{y}.sk.k0")))
    for i in range(1, WORDS):
        both = both + F.bit_count(F.col(f"{x}.sk.k{i}").bitwiseXOR(F.col(f"{y}.sk.k{i}")))
    union = (na + nb) / (1 + s)
    filled = BINS * (1 - F.exp(-union / BINS))
    second = 1 - F.exp(-F.greatest(na, nb) / BINS)
    differ = (1 - s) * filled
    spread = F.sqrt((1 + second) * (1 + second) * s * differ * F.greatest(1 - filled / union, F.lit(0.0)) + differ * second * (1 - second) + 0.25)
    most = differ * (1 + second) + SIGMAS * spread
    # a toggle flips one bit, so there are never more bits than toggles
    expected = BITS / 2 * (1 - F.exp(-2 * most / BITS))
    noise = F.sqrt(BITS / 4 * (1 - F.exp(-4 * most / BITS)) * F.least(F.lit(1.0), 4 * most / BITS)) + 1
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (both <= F.least(most, expected + SIGMAS * noise))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    joined = (pairs.join(sets.select(F.col("node").alias("a"), F.col("sh").alias("sa")), "a")
              .join(sets.select(F.col("node").alias("b"), F.col("sh").alias("sb")), "b"))
    sized = joined.select("a", "b", F.size("sa").cast("long").alias("na"), F.size("sb").cast("long").alias("nb"),
                          F.size(F.array_intersect("sa", "sb")).cast("long").alias("both"))
    return sized.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def hub_pairs(buckets: DataFrame) -> DataFrame:
    """For each node the hub it shares most buckets with; a bucket's hub is its
    node with most neighbours."""
    degree = buckets.groupBy("node").agg(F.sum("size").alias("degree"))
    hubs = (buckets.join(degree, "node").groupBy("band").agg(F.max(F.struct("degree", (-F.col("node")).alias("m"))).alias("h"))
            .select("band", (-F.col("h.m")).alias("hub")))
    shared = buckets.join(hubs, "band").where("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("c"))
    best = shared.groupBy("node").agg(F.max(F.struct("c", (-F.col("hub")).alias("m"))).alias("h"))
    return best.select(F.col("node").alias("a"), (-F.col("h.m")).alias("b"))


def other_pairs(buckets: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Plausible pairs of different components that share a bucket, each from
    the first of its buckets only."""
    placed = buckets.join(labels, "node", "left").select("band", "slot", "node", F.coalesce("comp", "node").alias("comp"))
    parts = placed.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = parts.groupBy("band").agg(F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1")
    rows = (placed.join(mixed.select("band", F.col("top.comp").alias("major")), "band")
            .join(nodes.select("node", "n", "sk", "bands"), "node")
            .select("band", "slot", "comp", (F.col("comp") == F.col("major")).alias("in_major"), F.struct("node", "n", "sk", "bands").alias("x")))
    left = rows.where("NOT in_major").select("band", "slot", F.col("comp").alias("comp_x"), "x")
    right = rows.select("band", F.col("comp").alias("comp_y"), "in_major", F.col("x").alias("y"))
    met_before = F.lit(False)
    for i in range(band_count(percent) - 1):
        met_before = met_before | ((F.col("slot") > i) & (F.col("x.bands")[i] == F.col("y.bands")[i]))
    return (left.join(right, "band")
            .where((F.col("comp_x") != F.col("comp_y")) & (F.col("in_major") | (F.col("x.node") < F.col("y.node")))
                   & ~met_before & plausible("x", "y", percent))
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))


def grouped(base: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of ``base``, and of each class of equal sets ``n, s1, s2``
    its least row ``rep`` (by ``_id, _h`` and further key columns) and its
    group ``comp``."""
    key = [c for c in base.columns if c not in ("doc_id", "text")]
    rows = stored(signatures(base, percent, width), "signatures")
    nodes = stored(rows.where("n > 0").groupBy("n", "s1", "s2").agg(
        F.min(F.struct(*key)).alias("rep"), F.first("bands").alias("bands"), F.first("sk").alias("sk"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    every = nodes.select("node", F.posexplode("bands").alias("slot", "band"))
    shared = every.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = stored(every.join(unbroadcast(shared), "band").select("band", "slot", "node", "size"), "buckets")
    reps = (buckets.select("node").distinct().join(nodes.select("node", "rep"), "node")
            .select("node", *[F.col(f"rep.{c}").alias(c) for c in key]))
    texts = base.select(*key, "text").join(reps, key)
    sets = stored(full_sets(texts, width).dropDuplicates(["node"]), "sets")

    side = lambda c, name: nodes.select(F.col("node").alias(c), F.struct("n", "sk").alias(name))
    hub = hub_pairs(buckets).join(side("a", "x"), "a").join(side("b", "y"), "b").where(plausible("x", "y", percent)).select("a", "b")
    links = stored(confirmed(hub, sets, percent), "links")
    others = stored(other_pairs(buckets, nodes, components(links), percent), "pairs")
    labels = components(links.unionByName(confirmed(others, sets, percent)))
    return rows, nodes.join(labels, "node", "left").select("n", "s1", "s2", "rep", F.coalesce("comp", "node").alias("comp"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """``doc_id, _id, _h, n_shingles, component_id, kept`` for every row."""
    rows, comps = grouped(base_columns(docs), percent, width)
    smallest = comps.groupBy("comp").agg(F.min("rep._id").alias("least"))
    classes = comps.join(smallest, "comp").select("n", "s1", "s2", "least")
    out = rows.select("doc_id", "_id", "_h", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left").withColumn("least", F.coalesce("least", "_id"))
    return out.select("doc_id", "_id", "_h", F.col("n").alias("n_shingles"),
                      F.when(F.col("least") != NULL_ID, F.col("least")).alias("component_id"), (F.col("_id") == F.col("least")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """The documents less all rows but one of each group, with all columns: the
    least by id (null last), text hash and row number stays. The numbers are
    written with the rows, so that every reading finds the same."""
    numbered = stored(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("_doc")), "numbered")
    rows, comps = grouped(base_columns(numbered.select("_row", "_doc.doc_id", "_doc.text"), "_row"), percent, width)
    first = comps.groupBy("comp").agg(F.min("rep").alias("rep")).select("rep._row")
    gone = rows.where("n > 0").select("_row").join(first, "_row", "left_anti")
    return numbered.join(gone, "_row", "left_anti").select("_doc.*")


def op7_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
