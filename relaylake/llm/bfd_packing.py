"""Packed id matrices by best-fit decreasing with a segment tree.

Documents are dealt by the hash of id and text into groups of about
``GROUP_ROWS`` rows; a group is read as a stream of batches and packed in
blocks of at most ``BLOCK_TOKENS`` tokens, so memory doesn't grow with a group
or a document. In a block, texts become ids (an end id last), overlong documents
are cut into whole rows and a rest, and the pieces, longest first, each go to
the row with the least room that still holds them. Rows are kept by their room
in the leaves of a segment tree; the search for the least sufficient room
descends it in logarithmic time.

Every packed row is a line of an id matrix: ``seq_len`` ids (padded with
``pad_id``), the cumulative lengths of its segments, the positions counted from
each segment's start, and for each segment the document and its first token,
so documents can be put together again without loss.

Defined cases: null and empty texts are one end id; null ids are kept; repeated
rows are packed each for itself; no rows give no matrix rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylake.llm.common import read_table, slices
from relaylake.llm.mixture_packing import word_encoder
from relaylake.llm.tokens import tokenizer_path

SEQ_LEN = 2048
END_ID = 2
PAD_ID = 0
GROUP_ROWS = 8192
BLOCK_TOKENS = 1 << 21

MATRIX = ("group long, block long, row long, n_tokens long, ids binary, positions binary, cu_lengths array<int>, "
          "segments array<struct<doc_id:bigint,start:bigint,doc_tokens:bigint>>")


class Rooms:
    """How many open rows have each room, as a segment tree over 0..n."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, count: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += count
            i >>= 1

    def least_from(self, room: int) -> int:
        """The least room of an open row that is at least ``room``, or -1."""
        tree, i = self.tree, room + self.size
        if tree[i]:
            return room
        while i > 1 and (i & 1 or not tree[i + 1]):  # up until a right neighbour has rows
            i >>= 1
        if i <= 1:
            return -1
        i += 1
        while i < self.size:
            i *= 2
            if not tree[i]:
                i += 1
        return i - self.size


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of piece numbers: the pieces longest first (ties by number), each
    into the fullest row that holds it."""
    rooms = Rooms(capacity)
    open_rows: dict[int, list[int]] = {}
    rows: list[list[int]] = []
    for piece in np.lexsort((np.arange(len(lengths)), -lengths)).tolist():
        n = int(lengths[piece])
        room = rooms.least_from(n)
        if room < 0:
            row, room = len(rows), capacity
            rows.append([])
        else:
            row = open_rows[room].pop()
            rooms.add(room, -1)
        rows[row].append(piece)
        if room > n:
            open_rows.setdefault(room - n, []).append(row)
            rooms.add(room - n, 1)
    return rows


def matrix_rows(doc_ids: list, ids: list[bytes], group: int, block: int, seq_len: int, pad_id: int) -> pa.RecordBatch:
    """One block's documents as packed rows."""
    sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
    pieces = -(-sizes // seq_len)
    doc = np.repeat(np.arange(len(ids)), pieces)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * seq_len
    length = np.minimum(sizes[doc] - start, seq_len)
    packed = best_fit_decreasing(length, seq_len)
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    first = np.cumsum(sizes) - sizes
    out_ids, out_positions, out_lengths, out_segments, out_n = [], [], [], [], []
    for row in packed:
        line = np.full(seq_len, pad_id, dtype="<u4")
        place = np.zeros(seq_len, dtype="<u4")
        bounds, segments = [0], []
        for p in row:
            d, at, n = doc[p], bounds[-1], int(length[p])
            line[at:at + n] = flat[first[d] + start[p]: first[d] + start[p] + n]
            place[at:at + n] = np.arange(n)
            bounds.append(at + n)
            segments.append({"doc_id": doc_ids[d], "start": int(start[p]), "doc_tokens": int(sizes[d])})
        out_ids.append(line.tobytes())
        out_positions.append(place.tobytes())
        out_lengths.append(bounds)
        out_segments.append(segments)
        out_n.append(bounds[-1])
    n = len(packed)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [pa.array([group] * n, pa.int64()), pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(out_n, pa.int64()),
         pa.array(out_ids, pa.binary()), pa.array(out_positions, pa.binary()), pa.array(out_lengths, pa.list_(pa.int32())), pa.array(out_segments, kind)],
        names=["group", "block", "row", "n_tokens", "ids", "positions", "cu_lengths", "segments"])


def pack_matrix(docs: DataFrame, path: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID, pad_id: int = PAD_ID,
                group_rows: int = GROUP_ROWS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Packed rows ``group, block, row, n_tokens, ids, positions, cu_lengths,
    segments``; ``ids`` and ``positions`` are ``seq_len`` little-endian unsigned
    32-bit numbers."""
    path = path or tokenizer_path("word_bpe_49k.json")
    end = end_id.to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        group, block, used, names, ids = None, 0, 0, [], []
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = encoder.ids(part.column("text").to_pylist())
                for g, doc_id, x in zip(part.column("group").to_pylist(), part.column("doc_id").to_pylist(), texts):
                    if names and (g != group or used > block_tokens):
                        yield matrix_rows(names, ids, group, block, seq_len, pad_id)
                        block, used, names, ids = (block + 1 if g == group else 0), 0, [], []
                    group = g
                    names.append(doc_id)
                    ids.append(x + end)
                    used += len(x) // 4 + 1
        if names:
            yield matrix_rows(names, ids, group, block, seq_len, pad_id)

    groups = -(-docs.count() // group_rows) or 1
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))
    return (rows.repartition("group").sortWithinPartitions("group", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
            .mapInArrow(pack, MATRIX))


def write_matrix(docs: DataFrame, folder: str, **options) -> None:
    """Write the id matrix, cumulative segment lengths and positions as Parquet
    in ``folder``, one folder for each group."""
    pack_matrix(docs, **options).write.partitionBy("group").parquet(folder)


def op1_bfd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packed row: its tokens and segments, and checksums of its ids and
    positions."""
    packed = pack_matrix(read_table(spark, sf_dir, "documents"))
    return packed.select("group", "block", "row", "n_tokens", F.size("segments").cast("long").alias("n_segments"),
                         F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"),
                         F.array_join(F.transform("cu_lengths", lambda x: x.cast("string")), ",").alias("cu_lengths"),
                         F.array_join(F.transform("segments", lambda x: F.concat_ws(":", F.coalesce(x["doc_id"].cast("string"), F.lit("")),
                                                                                    x["start"].cast("string"))), ",").alias("segments"))
