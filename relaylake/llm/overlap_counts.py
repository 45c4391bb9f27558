"""Token counts of whole texts; huge documents by overlap resynchronisation.

A huge document is cut into chunks that overlap, each encoded for itself with
offsets. Pre-tokens are found from left to right, and what follows a place
where one ends depends on the text after it alone. So a place in the overlap
where both chunks end a pre-token is a proven common boundary: the tokens
before it are taken from the left chunk, those after it from the right one.
The left chunk's last characters are not trusted: its end may have cut a word,
a run of white space or a special token's string. If two chunks have no common
boundary, the right one is encoded again from further left, twice as far each
time, until they meet; from the left chunk's own start they always do.

Defined cases: null text is empty (0 bytes, 0 tokens); strings of special
tokens count as the library counts them; repeated rows are counted each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylake.llm.common import read_table, slices
from relaylake.llm.tokens import ByteCounter, tokenizer_path

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 256
TOKEN_LIMIT = 512

_counters: dict[str, ByteCounter] = {}


def byte_counter(path: str) -> ByteCounter:
    if path not in _counters:
        _counters[path] = ByteCounter(path)
    return _counters[path]


def pre_tokens(encoding) -> dict[int, int]:
    """Place where each pre-token or special token ends → tokens up to there."""
    ends: dict[int, int] = {}
    words, offsets = encoding.word_ids, encoding.offsets
    n = len(words)
    for i in range(n):
        if i + 1 == n or words[i] is None or words[i + 1] != words[i]:
            ends[offsets[i][1]] = i + 1
    return ends


def count_overlapping(text: str, tokenizer, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, margin: int = 32) -> int:
    """Tokens of one text. ``margin``: characters at a chunk's end that are not
    trusted, more than the longest special token has. ``tokenizer`` gives whole
    offsets (``trim_offsets`` off)."""
    start, stop = 0, min(chunk, len(text))  # the left chunk
    left = pre_tokens(tokenizer.encode(text[:stop], add_special_tokens=False))
    base, at_base, total = 0, 0, 0  # the last proven boundary, the left chunk's tokens before it, all before it
    while stop < len(text):
        trusted = {start + e: n for e, n in left.items() if base < start + e <= stop - margin}
        end, reach, common = min(len(text), stop + chunk), max(overlap, 2 * margin), None
        while common is None:
            begin = max(base, stop - reach)
            right = pre_tokens(tokenizer.encode(text[begin:end], add_special_tokens=False))
            common = max((b for b in trusted if b - begin in right), default=base if begin == base else None)
            reach *= 2
        if common == base:  # one pre-token reaches over the whole chunk
            chunk *= 2
        total += trusted.get(common, at_base) - at_base
        start, stop, left, base, at_base = begin, end, right, common, right.get(common - begin, 0)
    return total + max(left.values(), default=0) - at_base


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = TOKEN_LIMIT,
                 chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; no shuffle."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import processors

        counter = byte_counter(path)
        exact = counter.tokenizer
        exact.post_processor = processors.ByteLevel(trim_offsets=False)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                texts = part.column("text").to_pylist()
                counts = counter.counts([x if len(x) <= chunk_chars else "" for x in texts])
                for i, x in enumerate(texts):
                    if len(x) > chunk_chars:
                        counts[i] = count_overlapping(x, exact, chunk_chars, overlap_chars, 2 * counter.special + 4)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"), pa.array(counts, pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return (rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))


def op4_overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))
