"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of token chunks. In each round a queue is credited its
quantum (window tokens times its target share) and sends chunks while its
credit lasts; what is left, its deficit, is carried into the next round, and so
across windows and partitions. A queue that is credited ``Q`` a round has sent,
after ``r`` rounds, exactly the chunks whose running total is at most ``r*Q``:
so the round of a chunk is ``ceil(running total / Q)``, and the schedule needs
two running totals instead of one pass over all tokens. Both are summed per
bucket first, so a source that holds a third of all rows is spread evenly.

Chunks in schedule order fill sequences of ``seq_len`` tokens without gaps;
a chunk that meets a sequence's end is cut there. Only the last sequence is
padded.

Defined cases: null text is empty (one end token); null and empty sources
share a queue; null ids are kept, last in their queue; repeated rows are
packed each for itself; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relaylake.llm.common import bucket_sums, id_key, read_table, slices, stored
from relaylake.llm.tokens import WordEncoder, tokenizer_path

SEQ_LEN = 4096
WINDOW_SEQUENCES = 64
END_ID = 2
QUEUE_BUCKET_ROWS = 8192

_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One per worker process, kept between tasks with the words it has met."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_table(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id``, ``queue``, ``ids`` (little-endian unsigned 32 bit, the end id
    last), ``n`` and the unique ``_row``; written once."""
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                ids = [x + end for x in encoder.ids(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("queue"), pa.array(ids, pa.binary()),
                     pa.array([len(x) // 4 for x in ids], pa.int64())], names=["doc_id", "queue", "ids", "n"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("queue"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = texts.mapInArrow(encode, "doc_id long, queue string, ids binary, n long")
    return stored(out.withColumn("_row", F.monotonically_increasing_id()), "tokens")


def schedule(chunks: DataFrame, weights: DataFrame, window_tokens: int, buckets: int) -> DataFrame:
    """Adds ``round`` and ``at`` (the first token's place in the whole output)
    to chunks (``queue, _id, _row, start, len``). ``weights``: ``queue, weight``
    (positive); one row for each queue."""
    total = weights.agg(F.sum("weight").alias("_all"))
    quantum = (weights.join(F.broadcast(total)).select(
        "queue", F.greatest(F.lit(1), F.floor(F.col("weight") / F.col("_all") * window_tokens)).cast("long").alias("_quantum")))
    chunks = chunks.withColumn("_bucket", F.pmod(F.xxhash64("_id"), F.lit(buckets)))
    order = ["_bucket", "_id", "_row", "start"]
    in_queue = Window.partitionBy("queue", "_bucket").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    timed = (chunks.join(bucket_sums(chunks, ["queue"], "_bucket", "len"), ["queue", "_bucket"])
             .join(quantum, "queue")
             .withColumn("_sent", F.col("_before") + F.sum("len").over(in_queue))
             .withColumn("round", F.expr("(_sent - 1) div _quantum"))
             .drop("_before", "_sent", "_quantum"))
    in_round = Window.partitionBy("round").orderBy("queue", *order).rowsBetween(Window.unboundedPreceding, -1)
    return (timed.join(bucket_sums(timed, [], "round", "len"), "round")
            .withColumn("at", F.col("_before") + F.coalesce(F.sum("len").over(in_round), F.lit(0)))
            .drop("_before", "_bucket"))


def pack_mixture(docs: DataFrame, path: str | None = None, targets: dict[str, float] | None = None,
                 seq_len: int = SEQ_LEN, window_sequences: int = WINDOW_SEQUENCES,
                 chunk_tokens: int | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces ``doc_id, source, start, length, ids, doc_tokens, sequence_id,
    offset, window_id``.

    ``targets``: weight by source (a source without one gets none of its own
    and is then weighted by its share of tokens); default: each source's share
    of all tokens. ``chunk_tokens`` (default ``seq_len``): longer documents
    queue as several chunks, so no source overdraws a window by more.
    """
    tokens = token_table(docs, path or tokenizer_path("word_bpe_49k.json"), end_id)
    step = chunk_tokens or seq_len
    lengths = tokens.select("_row", "queue", id_key().alias("_id"), "n")
    weights = lengths.groupBy("queue").agg(F.sum("n").cast("double").alias("weight"))
    if targets:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "queue string, given double")
        every = weights.agg(F.sum("weight").alias("_all"))
        weights = (weights.join(F.broadcast(every)).join(given, "queue", "left")
                   .select("queue", F.coalesce("given", F.col("weight") / F.col("_all")).alias("weight")))
    chunks = (lengths.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))))
              .withColumn("len", F.least(F.lit(step).cast("long"), F.col("n") - F.col("start"))))
    buckets = -(-tokens.count() // QUEUE_BUCKET_ROWS) or 1
    placed = schedule(chunks.drop("n"), weights, seq_len * window_sequences, buckets)
    size = F.lit(seq_len).cast("long")
    pieces = (placed
              .withColumn("sequence_id", F.explode(F.sequence(F.expr(f"at div {seq_len}"), F.expr(f"(at + len - 1) div {seq_len}"))))
              .withColumn("_from", F.greatest(F.col("at"), F.col("sequence_id") * size))
              .withColumn("length", F.least(F.col("at") + F.col("len"), (F.col("sequence_id") + 1) * size) - F.col("_from"))
              .select("_row", F.struct((F.col("start") + F.col("_from") - F.col("at")).alias("start"), "length", "sequence_id",
                                       (F.col("_from") - F.col("sequence_id") * size).alias("offset")).alias("p")))
    layout = pieces.groupBy("_row").agg(F.collect_list("p").alias("ps"))
    return (tokens.join(layout, "_row").withColumn("p", F.explode("ps"))
            .select("doc_id", F.col("queue").alias("source"), "p.start", "p.length",
                    F.expr("substring(ids, cast(4 * p.start + 1 as int), cast(4 * p.length as int))").alias("ids"),
                    F.col("n").alias("doc_tokens"), "p.sequence_id", "p.offset",
                    F.expr(f"p.sequence_id div {window_sequences}").alias("window_id")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "source", "window_id")


def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 ids, every 64 sequences holding the
    sources at their shares of the corpus."""
    return digest(pack_mixture(read_table(spark, sf_dir, "documents")))
