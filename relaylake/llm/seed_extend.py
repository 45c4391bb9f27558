"""Repeated word passages by seed and extend on winnowed anchors.

Every word covered by a window of ``LENGTH`` words that also starts in a
document with a smaller id is removed.

1. Seeds. Of the ``GRAM``-word strings in a window the least by hash (the first
   if equal) is its anchor, so equal windows have equal anchors at equal
   distances. Neighbouring windows share anchors: a run of windows with one
   anchor is one row, ``lo`` to ``hi`` words before the anchor.
2. Documents are joined on the anchors that stand in more than one of them.
   The least place of an anchor (by document id) leads its group; every other
   place meets the leader alone, never all pairs, so a group of any size costs
   one row a place, and the join can be split at a hot anchor.
3. Both places are extended word by word to the left and to the right, up to
   the first difference. Windows inside the match are found. A window that
   isn't reaches over the first difference on the left, or else over the one on
   the right; all windows equal to it have the same difference there. So the
   rest of a run is dealt by side, distance and differing word, each part with
   a leader of its own, and extended again, until no part has two documents.
   Words are compared, hashes only deal: equal hashes of different words cost
   a round, not a result.
4. Matches of one pair at one distance that overlap are one maximal repeat.

Defined cases: null texts have no words; null ids come last and don't count as
smaller than each other; repeated rows and other rows of one id never remove
each other's words, and each gets its result; documents with fewer words than
the window lose nothing; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylake.llm.bwt_repeats import sliding_least
from relaylake.llm.common import base_columns, read_table, slices, stored, utf8
from relaylake.llm.spans import BASE, BASE_INVERSE, mix, powers, running_hash, span_hash, word_spans

LENGTH = 50
GRAM = 10
PLACE_BITS = 23  # of a block's word, in the key whose minimum is the anchor
BLOCK = 1 << 20  # windows searched at once
KEY = ["_id", "_h"]

IN_WORD = np.ones(256, dtype=bool)
IN_WORD[0x20] = False
IN_WORD[0x09:0x0E] = False


def anchor_runs(words: np.ndarray, first: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first window, last window, anchor (all
    by word), anchor hash. ``words``: word hashes; ``first``: rows' first words."""
    none = np.empty(0, np.int64)
    n = len(words)
    if n < length:
        return none, none, none, none.astype(np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * powers("base", BASE, n), out=sums[1:])
    grams = mix((sums[gram:] - sums[:-gram]) * powers("back", BASE_INVERSE, n + 1)[:n - gram + 1])
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
    row = np.searchsorted(first, np.arange(n), side="right")
    window = np.flatnonzero(row[:n - length + 1] == row[length - 1:])
    at = (least[window] & low).astype(np.int64)
    new = np.ones(len(window), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (row[window[1:]] != row[window[:-1]])
    edge = np.flatnonzero(new)
    if not len(edge):
        return none, none, none, none.astype(np.uint64)
    return window[edge], window[np.append(edge[1:], len(window)) - 1], at[edge], grams[at[edge]]


def anchor_table(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``_id, _h, at, lo, hi, g``: the anchors' words, the farthest and nearest
    windows' distances, the anchors' hashes; written once."""
    kind = pa.list_(pa.struct([("at", pa.int32()), ("lo", pa.int16()), ("hi", pa.int16()), ("g", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                data, offsets = utf8(part.column("text"))
                starts, ends, first = word_spans(data, offsets, IN_WORD)
                words = span_hash(running_hash(data), starts, ends)
                found = []
                for b in range(0, max(len(words), 1), BLOCK):
                    begin, end, at, g = anchor_runs(words[b:b + BLOCK + length - 1], first[1:] - b, length, gram)
                    found.append((begin + b, end + b, at + b, g))
                begin, end, at, g = (np.concatenate(x) for x in zip(*found))
                runs = np.searchsorted(begin, first)
                values = pa.StructArray.from_arrays(
                    [pa.array((at - first[np.repeat(np.arange(part.num_rows), np.diff(runs))]).astype(np.int32)),
                     pa.array((at - end).astype(np.int16)), pa.array((at - begin).astype(np.int16)), pa.array(g.view(np.int64))],
                    fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_h"), pa.ListArray.from_arrays(pa.array(runs.astype(np.int32)), values)], names=[*KEY, "runs"])

    rows = base_columns(docs).select(*KEY, "text").mapInArrow(
        find, "_id long, _h long, runs array<struct<at:int,lo:smallint,hi:smallint,g:bigint>>")
    return stored(rows.select(*KEY, F.explode("runs").alias("x")).select(*KEY, "x.*"), "seed-anchors")


def with_leaders(rows: DataFrame, name: str) -> DataFrame:
    """The rows of groups with more than one document; ``first`` marks the least place."""
    place = F.struct(*KEY, "at")
    groups = rows.groupBy("g").agg(F.min(place).alias("least"), F.max("_id").alias("last")).where("least._id < last").select("g", "least")
    # written first: a join with the aggregate itself couldn't be split at a hot group
    return rows.join(stored(groups, f"{name}-groups"), "g").withColumn("first", place == F.col("least")).drop("least")


def contexts(docs: DataFrame, anchors: DataFrame, length: int) -> DataFrame:
    """Adds the words that the runs' windows cover: ``left`` of the anchor,
    nearest first, and ``right`` from it on."""
    wanted = anchors.groupBy(*KEY).agg(F.collect_set(F.struct("at", "lo", "hi", "g", "first")).alias("runs"))
    schema = "_id long, _h long, at int, lo int, hi int, g long, first boolean, left string, right string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                out: list[tuple] = []
                texts = part.column("text").cast(pa.binary()).to_pylist()
                for i, h, text, runs in zip(part.column("_id").to_pylist(), part.column("_h").to_pylist(), texts, part.column("runs").to_pylist()):
                    words, size = text.split(), 0  # at the six blanks
                    for r in runs:
                        at, lo, hi = r["at"], r["lo"], r["hi"]
                        left, right = b" ".join(words[at - hi:at][::-1]), b" ".join(words[at:at - lo + length])
                        out.append((i, h, at, lo, hi, r["g"], r["first"], left.decode(), right.decode()))
                        size += len(left) + len(right)
                        if size > 1 << 22:
                            yield batch_of(out)
                            out, size = [], 0
                yield batch_of(out)

    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)

    return base_columns(docs).select(*KEY, "text").join(wanted, KEY).select(*KEY, "text", "runs").mapInArrow(cut, schema)


def words_alike(a: str, b: str, all_of: Column) -> Column:
    """How many words two texts have in common from their start."""
    differ = F.array_position(F.zip_with(F.split(a, " ", -1), F.split(b, " ", -1), lambda x, y: x.eqNullSafe(y)), False) - 1
    return F.when(F.col(a) == F.col(b), all_of).otherwise(differ.cast("int"))


def extended(rows: DataFrame, length: int) -> DataFrame:
    """Each place extended against its group's leader. ``side`` null: found
    windows, ``lo`` to ``hi`` words before ``at``, in ``src`` at ``src_at``;
    else what is left of the run, dealt anew."""
    lead = stored(rows.where("first").dropDuplicates(["g"]).select(  # written first, as the groups are
        "g", F.struct(*KEY, F.col("at").alias("at")).alias("src"), F.col("left").alias("l_left"), F.col("right").alias("l_right")), "seed-leaders")
    both = (rows.where("NOT first").join(lead, "g")
            .withColumn("L", words_alike("left", "l_left", F.col("hi")))
            .withColumn("R", words_alike("right", "l_right", F.lit(length) - F.col("lo"))))
    lo, hi, left_, right_ = F.col("lo"), F.col("hi"), F.col("L"), F.col("R")

    def part(side, a, b, key):
        return F.struct(F.lit(side).cast("string").alias("side"), a.alias("lo"), b.alias("hi"), key.alias("g"))

    word = lambda text, n: F.get(F.split(text, " ", -1), n)
    parts = F.array(
        part(None, F.greatest(lo, F.lit(length) - right_), F.least(hi, left_), F.col("g")),
        part("left", F.greatest(lo, left_ + 1), hi, F.xxhash64("g", F.lit("left"), "L", word("left", left_))),
        part("right", lo, F.least(hi, left_, F.lit(length) - right_ - 1), F.xxhash64("g", F.lit("right"), "R", word("right", right_))))
    both = both.withColumn("x", F.explode(F.filter(parts, lambda x: x["lo"] <= x["hi"])))
    rest = F.col("x.side").isNotNull()
    return both.select(
        *KEY, "at", "x.lo", "x.hi", "x.g", "x.side", F.when(~rest, F.col("src")).alias("src"),
        F.when(rest, F.expr("substring_index(left, ' ', x.hi)")).alias("left"),
        F.when(rest, F.expr(f"substring_index(right, ' ', {length} - x.lo)")).alias("right"))


def matches(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``_id, _h, s, e, src_id, src_h, src_s``: words ``s`` to ``e`` (exclusive)
    stand in another place, from word ``src_s`` on, of the least document that
    has their windows; a match for each anchor."""
    rows = with_leaders(anchor_table(docs, length, gram), "seed")
    rows = stored(contexts(docs, stored(rows, "seed-shared"), length), "seed-contexts")
    found = None
    while True:
        step = stored(extended(rows, length), "seed-extended")
        hits = step.where("side IS NULL AND _id > src._id").select(
            *KEY, (F.col("at") - F.col("hi")).alias("s"), (F.col("at") - F.col("lo") + length).alias("e"),
            F.col("src._id").alias("src_id"), F.col("src._h").alias("src_h"), (F.col("src.at") - F.col("hi")).alias("src_s"))
        found = hits if found is None else found.unionByName(hits)
        rest = step.where("side IS NOT NULL").select(*KEY, "at", "lo", "hi", "g", "left", "right")
        if rest.isEmpty():
            return found
        rows = stored(with_leaders(rest, "seed-rest"), "seed-rest")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """For every row ``doc_id, n_words, n_removed, kept`` (the words left, one
    space between) and ``repeats``: maximal repeats ``s, e`` (words), and the
    document and word ``src_id, src_s`` where they stand first."""
    whose = F.struct("src_id", "src_h", (F.col("s") - F.col("src_s")).alias("shift"), "s", "e")
    found = matches(docs, length, gram).groupBy(*KEY).agg(F.sort_array(F.collect_set(whose)).alias("found"))
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("src_id", pa.int64()), ("src_s", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                kept, repeats, sizes, removed = [], [], [], []
                for text, hits in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("found").to_pylist()):
                    words, longest, last = text.split(), [], None
                    for x in hits or ():
                        pair = x["src_id"], x["src_h"], x["shift"]
                        if pair == last and x["s"] <= longest[-1]["e"]:
                            longest[-1]["e"] = max(longest[-1]["e"], x["e"])
                        else:
                            longest.append({"s": x["s"], "e": x["e"], "src_id": x["src_id"], "src_s": x["s"] - x["shift"]})
                        last = pair
                    longest.sort(key=lambda x: (x["s"], x["e"]))
                    rest, end = [], 0
                    for x in longest:
                        rest += words[end:x["s"]]
                        end = max(end, x["e"])
                    rest += words[end:]
                    kept.append(b" ".join(rest).decode())
                    repeats.append(longest)
                    sizes.append(len(words))
                    removed.append(len(words) - len(rest))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(repeats, kind), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "repeats", "kept"])

    rows = base_columns(docs).join(found, KEY, "left")
    return rows.select("doc_id", "text", "found").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, repeats array<struct<s:int,e:int,src_id:bigint,src_s:int>>, kept string")


def op12_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
