"""Repeated byte strings by interval expansion on Burrows-Wheeler transforms.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere in
the corpus is removed.

1. Candidates. The anchor of a place is the least ``ANCHOR``-byte string (by
   hash, the first if equal) within the ``LENGTH`` bytes from it: equal strings
   have equal anchors, so a place whose anchor is unique in the corpus is
   unique. Neighbouring places share anchors; a run of places with one anchor
   is one row, with the hash of its context, all bytes the run's strings cover.
2. Runs with equal anchor and context are copies: all their strings repeat.
   This takes most of the repeated bytes, however many copies there are.
3. What is left are runs whose anchor repeats in other contexts, mostly at the
   edges of passages. The places of a run are divided by their distance to the
   anchor; all strings of one division contain the same core around the anchor,
   and only contexts with equal cores need comparing. Divisions of a core with
   more than ``MAX_CONTEXTS`` contexts are divided again, at the end into
   single places whose core is the string itself, so no group is too large for
   one task and none is cut short.
4. Contexts are dealt by their core into buckets. A task joins a bucket's
   contexts to one text, sorts its suffixes by ``LENGTH`` symbols and expands
   intervals of the Burrows-Wheeler transform breadth first: extending all
   intervals of depth ``l`` by each byte before them finds the places where
   the common prefix of neighbours is ``l``, in increasing order. It stops at
   ``LENGTH``: neighbours without a value yet share at least that many bytes.

Defined cases: null texts are empty; matches don't cross documents; repeated
rows are copies of each other; documents shorter than ``LENGTH`` keep all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylake.llm.common import base_columns, read_table, slices, stored, utf8
from relaylake.llm.spans import BASE_INVERSE, mix, powers, running_hash, span_hash

LENGTH = 400
ANCHOR = 200
MAX_CONTEXTS = 1024
BUCKET_BYTES = 1 << 18
PLACE_BITS = 23  # of a block's place, in the key whose minimum is the anchor
BLOCK = 1 << 22


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(key)
    table = np.concatenate([key, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    up = np.minimum.accumulate(table, axis=1).ravel()
    down = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n - width + 1], up[width - 1:n])


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of places with one anchor: first place, last place, the anchor's
    place, its hash, the context's hash. Places are those in ``data``."""
    n = len(data)
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = running_hash(data)
    grams = mix((sums[anchor:] - sums[:-anchor]) * powers("back", BASE_INVERSE, len(sums))[:n - anchor + 1])
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - anchor + 1)
    first, stop = offsets[:-1], offsets[1:] - length + 1
    inside = np.zeros(n + 1, dtype=np.int64)
    some = stop > first
    np.add.at(inside, first[some], 1)
    np.add.at(inside, stop[some], -1)
    place = np.flatnonzero(np.cumsum(inside)[:len(least)] > 0)
    at = (least[place] & low).astype(np.int64)
    begins = np.zeros(n + 1, dtype=bool)
    begins[first] = True
    new = np.ones(len(place), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | begins[place[1:]]
    edge = np.flatnonzero(new)
    lo, hi, at = place[edge], place[np.append(edge[1:], len(place)) - 1], at[edge]
    return lo, hi, at, grams[at], span_hash(sums, lo, hi + length)


RUN = "struct<lo:int,n:smallint,rel:smallint,anchor:bigint,context:bigint>"


def run_table(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """``_id, _h, _row`` and the ``runs`` of each row, written once."""
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("n", pa.int16()), ("rel", pa.int16()), ("anchor", pa.int64()), ("context", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                data, offsets = utf8(part.column("text"))
                found = []  # of one block after the other, in order of place
                for b in range(0, max(len(data), 1), BLOCK):  # more than one for a very long row only
                    block = data[b:b + BLOCK + length - 1]
                    inner = np.clip(offsets - b, 0, len(block))
                    lo, hi, at, ha, hc = anchor_runs(block, inner, length, anchor)
                    found.append((lo + b, hi - lo, at - lo, ha, hc))
                lo, n, rel, ha, hc = (np.concatenate(x) for x in zip(*found))
                first = np.searchsorted(lo, offsets)
                lo = lo - offsets[np.repeat(np.arange(part.num_rows), np.diff(first))]
                values = pa.StructArray.from_arrays(
                    [pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(rel.astype(np.int16)),
                     pa.array(ha.view(np.int64)), pa.array(hc.view(np.int64))], fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_h"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values)],
                    names=["_id", "_h", "runs"])

    rows = base_columns(docs).select("_id", "_h", "text").mapInArrow(find, f"_id long, _h long, runs array<{RUN}>")
    return stored(rows.withColumn("_row", F.monotonically_increasing_id()), "anchor-runs")


def sorted_suffixes(text: np.ndarray, alphabet: int, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes sorted by ``depth`` symbols at least; a flag at each place of
    this order whose first ``shallow`` symbols differ from the place before."""
    n = len(text)
    bits = int(alphabet).bit_length()
    h = min(4, 63 // bits, depth)
    padded = np.concatenate([text, np.zeros(h, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for k in range(h):
        key = (key << bits) | padded[k:k + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.ones(n, dtype=bool)
    head[1:] = sorted_key[1:] != sorted_key[:-1]
    rank_bits = max(1, int(n).bit_length())
    times = max(2, 63 // rank_bits)
    rank = np.zeros(n + 1, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    shallow, shallow_head, first = h, head.copy(), True
    while h < depth:
        tied = ~head
        tied[:-1] |= tied[1:].copy()
        slots = np.flatnonzero(tied)  # places of suffixes that aren't told apart yet
        if len(slots):
            own = order[slots]
            key = rank[own]
            for k in range(1, times):
                key = (key << rank_bits) | rank[np.minimum(own + k * h, n)]
            by = np.argsort(key, kind="stable")
            own, key = own[by], key[by]
            order[slots] = own
            new = np.ones(len(slots), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            head[slots] = new
            rank[own] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        h *= times
        if first and h <= depth:
            shallow, shallow_head = h, head.copy()
        first = False
    return order, shallow_head, shallow


def repeated_places(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part the places whose ``length`` bytes also start elsewhere in
    the parts, by threshold-bounded expansion on the joined text."""
    m = len(parts)
    sizes = np.array([len(x) for x in parts], dtype=np.int64)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8).astype(np.int64) + m
    text[first + sizes] = np.arange(m)  # each part ends in a sign of its own
    n = len(text)
    order, head, depth = sorted_suffixes(text, m + 256, length)
    inverse = np.empty(n, dtype=np.int64)
    inverse[order] = np.arange(n)
    previous = order - 1
    last = np.where(previous >= 0, inverse[previous], -1)  # the transform, as its map from last to first column
    last[text[previous] < m] = -1
    lead = text[order]
    common = np.full(n + 1, -1, dtype=np.int32)
    common[0] = common[n] = 0
    common[:n][head] = depth - 1  # or less
    low = np.flatnonzero(head)
    high = np.append(low[1:], n)
    level = depth
    while level < length and len(low):
        width = high - low
        total = int(width.sum())
        owner = np.repeat(np.arange(len(low)), width)
        at = np.arange(total) + np.repeat(low - (np.cumsum(width) - width), width)
        to = last[at]
        owner, to = owner[to >= 0], to[to >= 0]
        by = np.argsort(to, kind="stable")
        to, owner = to[by], owner[by]
        sign = lead[to]
        begin = np.ones(len(to), dtype=bool)
        begin[1:] = (to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | (sign[1:] != sign[:-1])
        edge = np.flatnonzero(begin)
        low = to[edge]
        high = to[np.append(edge[1:], len(to)) - 1] + 1 if len(edge) else low
        new = common[high] < 0
        low, high = low[new], high[new]
        common[high] = level
        level += 1
    alike = common[:n] < 0
    alike |= common[1:] < 0
    places = np.sort(order[alike])
    cut = np.searchsorted(places, np.append(first, n))
    return [places[cut[k]:cut[k + 1]] - first[k] for k in range(m)]


def divided(contexts: DataFrame, length: int) -> DataFrame:
    """Adds ``core`` to rows ``anchor, rel, n, bytes, p, q``: the hash of what
    all strings starting ``p`` to ``q`` bytes before the anchor contain."""
    part = F.expr(f"substring(bytes, int(rel - p + 1), int({length} - q + p))")
    has = (F.greatest(F.lit(0), F.col("rel") - F.col("q")) <= F.least(F.col("n"), F.col("rel") - F.col("p")))
    return contexts.where(has).withColumn("core", F.xxhash64("anchor", "p", "q", part))


def halves(contexts: DataFrame) -> DataFrame:
    """Each row's division ``p..q`` in two."""
    middle = F.expr("(p + q) div 2")
    parts = F.array(F.struct(F.col("p").alias("p"), middle.alias("q")), F.struct((middle + 1).alias("p"), F.col("q").alias("q")))
    return contexts.withColumn("pq", F.explode(parts)).withColumns({"p": F.col("pq.p"), "q": F.col("pq.q")}).drop("pq").where("p <= q")


def edge_repeats(contexts: DataFrame, length: int, anchor: int, max_contexts: int, bucket_bytes: int) -> DataFrame:
    """``_row, s, e``: repeated places of the runs that occur once. ``contexts``:
    ``anchor, rel, n, copies, _row, lo, bytes``."""
    zero = F.lit(0).cast("long")
    rows = divided(halves(contexts.withColumn("p", zero).withColumn("q", zero + (length - anchor))), length)
    small = None
    while True:
        groups = rows.groupBy("core").agg(F.count(F.lit(1)).alias("size"), F.min("copies").alias("least"))
        rows = stored(rows.join(groups.where("size > 1 AND least = 1"), "core"), "contexts")
        fits = rows.where((F.col("size") <= max_contexts) | (F.col("p") == F.col("q")))
        small = fits if small is None else small.unionByName(fits)
        large = rows.where((F.col("size") > max_contexts) & (F.col("p") != F.col("q"))).drop("core", "size", "least")
        if large.isEmpty():
            break
        rows = divided(halves(large), length)
    # a single place whose core is the string itself is repeated as it stands
    done = small.where((F.col("p") == F.col("q")) & (F.col("copies") == 1)).select(
        "_row", (F.col("lo") + F.col("rel") - F.col("p")).cast("long").alias("s"), (F.col("lo") + F.col("rel") - F.col("p")).cast("long").alias("e"))
    small = small.where("p <> q")
    small = small.select("core", "copies", "_row", F.expr("cast(lo + greatest(0, rel - q) as long)").alias("lo"),
                         F.expr(f"substring(bytes, int(greatest(0, rel - q) + 1), int(least(n, rel - p) - greatest(0, rel - q) + {length}))").alias("bytes"))
    total = small.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    buckets = -(-total // bucket_bytes) or 1

    def expanded(parts: list[bytes], whose: list[tuple[int, int, int]]) -> pa.RecordBatch:
        rows_, starts, ends = [], [], []
        for places, (copies, row, lo) in zip(repeated_places(parts, length), whose):
            if copies == 1 and len(places):
                cuts = np.flatnonzero(np.diff(places) != 1)
                starts += (places[np.append(0, cuts + 1)] + lo).tolist()
                ends += (places[np.append(cuts, len(places) - 1)] + lo).tolist()
                rows_ += [row] * (len(cuts) + 1)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows_, starts, ends)], names=["_row", "s", "e"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, whose = None, [], []  # the rows of a bucket follow one another
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "bytes", "copies", "_row", "lo")]
            for b, part, *who in zip(*columns):
                if parts and b != bucket:
                    yield expanded(parts, whose)
                    parts, whose = [], []
                bucket = b
                parts.append(part)
                whose.append(tuple(who))
        if parts:
            yield expanded(parts, whose)

    dealt = small.withColumn("bucket", F.pmod("core", F.lit(buckets))).repartition("bucket").sortWithinPartitions("bucket")
    found = dealt.select("bucket", "bytes", "copies", "_row", "lo").mapInArrow(expand, "_row long, s long, e long")
    return found.unionByName(done)


def repeated_runs(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, max_contexts: int = MAX_CONTEXTS,
                  bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``_id, _h, starts``: for each document with any, the runs (first and
    last place) at which a repeated string starts."""
    table = run_table(docs, length, anchor)
    runs = table.select("_row", F.explode("runs").alias("x")).select("_row", "x.*")
    # written first: a join with the aggregate itself couldn't be split at a hot anchor
    often = stored(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"), "anchors-often")
    shared = stored(runs.join(often, "anchor"), "anchor-shared")
    contexts = (shared.groupBy("anchor", "context", "n", "rel").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("_row", "lo")).alias("at")))
    contexts = stored(contexts, "anchor-contexts")
    whole = (shared.join(contexts.where("copies > 1").select("anchor", "context", "n", "rel"), ["anchor", "context", "n", "rel"])
             .select("_row", F.col("lo").cast("long").alias("s"), (F.col("lo") + F.col("n")).cast("long").alias("e")))
    open_ = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.min("copies").alias("least")).where("k > 1 AND least = 1").select("anchor")
    wanted = (contexts.join(open_, "anchor").select("at._row", F.struct("anchor", "n", "rel", "copies", "at.lo").alias("w"))
              .groupBy("_row").agg(F.collect_list("w").alias("ws"))
              .join(table.select("_row", "_id", "_h"), "_row"))
    texts = base_columns(docs).select("_id", "_h", F.col("text").cast("binary").alias("all")).join(wanted, ["_id", "_h"])
    cut = texts.select("_row", "all", F.explode("ws").alias("w")).select(
        "_row", "w.*", F.expr(f"substring(all, int(w.lo + 1), int(w.n + {length}))").alias("bytes"))
    edges = edge_repeats(stored(cut, "context-bytes"), length, anchor, max_contexts, bucket_bytes)
    return (whole.unionByName(edges).join(table.select("_row", "_id", "_h"), "_row")
            .groupBy("_id", "_h").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("starts")))


def without_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans`` (removed runs of bytes, flat) and
    ``kept`` (the remaining bytes) of every row."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                kept, spans, sizes, removed = [], [], [], []
                for text, starts in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("starts").to_pylist()):
                    flat: list[int] = []
                    for x in starts or ():
                        if flat and x["s"] <= flat[-1]:
                            flat[-1] = max(flat[-1], x["e"] + length)
                        else:
                            flat += [x["s"], x["e"] + length]
                    edges = [0, *flat, len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if flat else text)
                    spans.append(flat)
                    sizes.append(len(text))
                    removed.append(len(text) - len(kept[-1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    rows = base_columns(docs).join(repeated_runs(docs, length, **options), ["_id", "_h"], "left")
    return rows.select("doc_id", "text", "starts").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<long>, kept binary")


def op5_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.expr("cast(size(spans) div 2 as long)").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
