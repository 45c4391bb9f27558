"""Repeated line runs by prefix doubling (DataFrame functions only).

The corpus is a sequence of line IDs for each document, its lines with a word.
A line that occurs once cuts the sequence: no repeated run contains it. Within
the pieces left, the suffix array is built by prefix doubling: the rank of the
2**k lines from a place is the number of places whose 2**k lines sort lower;
the pair of ranks at ``p`` and ``p + 2**k`` gives the rank for 2**(k+1) lines.
Ranks come from running totals over distinct pairs, in ranges of bounded size,
so neither one sort of all places nor a hot line meets in one task. Places of
equal rank are a longest-common-prefix interval of that depth.

A run counts if it has ``min_words`` words. From each place the shortest such
run is looked up, and to each place the shortest such run that ends there; both
have at most ``min_words`` lines, so doubling ends there. Two ranks, at the
run's start and 2**k lines before its end, name its content. If the same name
stands earlier in the corpus (by document id, then line), the run is a later
copy. Each line of a maximal repeated run lies in such a shortest run of it,
so together they are the maximal repeated runs; their lines are deleted.

Defined cases: lines are compared without blanks at their ends; lines without
a word stay, and don't interrupt runs; a null text stays null; null ids come
last; repeated rows (same id and text) are one document and keep or lose the
same lines; a document that had words and lost all of them is dropped by
``dedup_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relaylake.llm.common import bucket_sums, id_key, let, read_table, stored, unbroadcast

MIN_WORDS = 50
RANGE = 1 << 16  # ranks in one range
KEY = ["_id", "_h"]


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def numbered_lines(text: Column) -> Column:
    """``(at, line)`` of the lines with a word, trimmed."""
    trimmed = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("at"), F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "").alias("line")))
    return F.filter(trimmed, lambda x: x["line"] != "")


def line_table(docs: DataFrame) -> DataFrame:
    """``_id, _h, i`` (number among lines with a word), 96 bits of line ID, words."""
    rows = docs.select(id_key().alias("_id"), F.xxhash64(_text()).alias("_h"), _text().alias("text"))
    lines = rows.select(*KEY, F.posexplode(numbered_lines(F.col("text"))).alias("i", "x"))
    return lines.select(*KEY, "i", F.xxhash64("x.line").alias("k1"), F.hash("x.line").alias("k2"),
                        F.regexp_count("x.line", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))


def repeated_pieces(lines: DataFrame) -> DataFrame:
    """Places of lines that occur more than once: ``_id, _h, piece, i``, the
    words before the line in its piece, and ``r0``, the rank of the line."""
    classes = lines.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    classes = stored(classes.withColumn("range", F.shiftrightunsigned("k1", 48).cast("long")), "lines-repeated")
    inside = Window.partitionBy("range").orderBy("k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (classes.join(bucket_sums(classes, [], "range", "c"), "range")
              .select("k1", "k2", (F.col("_before") + F.coalesce(F.sum("c").over(inside), F.lit(0))).alias("r0")))
    places = lines.join(unbroadcast(ranked), ["k1", "k2"]).select(*KEY, "i", "words", "r0").repartition(*KEY).dropDuplicates([*KEY, "i"])
    in_doc = Window.partitionBy(*KEY).orderBy("i")
    places = places.withColumn("piece", F.col("i") - F.row_number().over(in_doc))
    before = Window.partitionBy(*KEY, "piece").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return places.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)).cast("long"))


def shortest_runs(places: DataFrame, min_words: int) -> DataFrame:
    """``_id, _h, start, m``: the shortest runs of ``min_words`` words from
    each place and to each place, within pieces."""
    piece = Window.partitionBy(*KEY, "piece")
    ahead = piece.orderBy("before").rangeBetween(0, min_words - 1)
    back = piece.orderBy("upto").rangeBetween(-(min_words - 1), 0)
    sized = places.withColumn("upto", F.col("before") + F.col("words"))
    counted = sized.select(*KEY, "i", F.count(F.lit(1)).over(ahead).alias("ma"), F.sum("words").over(ahead).alias("wa"),
                           F.count(F.lit(1)).over(back).alias("mb"), F.sum("words").over(back).alias("wb"))
    runs = F.array(F.when(F.col("wa") >= min_words, F.struct(F.col("i").cast("long").alias("start"), F.col("ma").alias("m"))),
                   F.when(F.col("wb") >= min_words, F.struct((F.col("i") - F.col("mb") + 1).cast("long").alias("start"), F.col("mb").alias("m"))))
    return (counted.select(*KEY, F.explode(F.array_distinct(F.filter(runs, lambda x: x.isNotNull()))).alias("x"))
            .select(*KEY, "x.start", "x.m").dropDuplicates([*KEY, "start", "m"]))


def doubled(places: DataFrame, k: int) -> DataFrame:
    """Adds ``r{k+1}``, null where the piece ends before 2**(k+1) lines."""
    ahead = Window.partitionBy(*KEY, "piece").orderBy("i")
    paired = places.withColumn("next", F.lead(f"r{k}", 1 << k).over(ahead))
    pairs = (paired.where(F.col("next").isNotNull()).groupBy(F.col(f"r{k}").alias("left"), F.col("next").alias("right"))
             .agg(F.count(F.lit(1)).alias("c")).withColumn("range", F.expr(f"right div {RANGE}")))
    inside = Window.partitionBy("left", "range").orderBy("right").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (pairs.join(bucket_sums(pairs, ["left"], "range", "c"), ["left", "range"])
              .select("left", "right", (F.col("left") + F.col("_before") + F.coalesce(F.sum("c").over(inside), F.lit(0))).alias(f"r{k + 1}")))
    return (paired.join(ranked, (F.col(f"r{k}") == F.col("left")) & (F.col("next") == F.col("right")), "left")
            .drop("left", "right", "next"))


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``_id, _h, gone``: numbers (among lines with a word) of the lines in
    later copies of repeated runs, ascending."""
    places = stored(repeated_pieces(stored(line_table(docs), "lines")), "places")
    runs = stored(shortest_runs(places, min_words), "runs")
    longest = runs.agg(F.max("m")).first()[0] or 1
    levels = int(longest).bit_length() - 1
    for k in range(levels):
        places = stored(doubled(places, k), "places")
    rank_of = lambda t, k: F.coalesce(*[F.when(k == j, F.col(f"{t}.r{j}")) for j in range(levels + 1)])
    level = sum((F.when(F.col("m") >= (1 << j), 1).otherwise(0) for j in range(1, levels + 1)), F.lit(0))
    runs = runs.withColumn("k", level).withColumn("i", F.col("start")).withColumn("second", F.col("start") + F.col("m") - F.expr("shiftleft(1L, k)"))
    ranks = places.select(*KEY, F.col("i").cast("long").alias("i"), F.struct(*[f"r{j}" for j in range(levels + 1)]).alias("t"))
    named = (runs.join(unbroadcast(ranks), [*KEY, "i"]).select(*KEY, "start", "m", "k", F.col("second").alias("i"), rank_of("t", F.col("k")).alias("head"))
             .join(unbroadcast(ranks), [*KEY, "i"]).select(*KEY, "start", "m", "head", rank_of("t", F.col("k")).alias("tail")))
    named = stored(named, "runs-named")
    place = F.struct(*KEY, "start")
    first = named.groupBy("m", "head", "tail").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    copies = named.join(unbroadcast(first), ["m", "head", "tail"]).where(place > F.col("first"))
    return (copies.select(*KEY, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("m") - 1)).alias("i"))
            .groupBy(*KEY).agg(F.sort_array(F.collect_set("i")).alias("gone")))


def without_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """For every row ``_doc``, the row as it was, ``text`` less its later copies,
    ``_gone`` (their line numbers) and ``_had`` (lines with a word before).
    Columns of ``docs`` may have any names: they stay inside ``_doc``."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), id_key().alias("_id"), F.xxhash64(_text()).alias("_h"), F.col("text"))
    gone = later_copies(docs.select("doc_id", "text"), min_words).withColumnRenamed("gone", "_gone")
    joined = whole.join(gone, KEY, "left").withColumn("_had", F.size(numbered_lines(_text())).cast("long"))
    removed = let(F.transform(numbered_lines(_text()), lambda x: x["at"]),
                  lambda at: F.transform("_gone", lambda i: F.get(at, i.cast("int"))))
    rest = let(F.split(_text(), "\n", -1), lambda lines: let(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed),
        lambda kept: F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")))
    return joined.select("_doc", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(rest).alias("text"), "_gone", "_had")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later copies of repeated runs, with all their
    columns, whatever their names; ``n_chars``, where there is one, follows the
    text. Documents left without a word are dropped if they had one."""
    out = without_copies(docs, min_words)
    out = out.where(F.col("_gone").isNull() | (F.size("_gone") < F.col("_had")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("_gone").isNull(), F.col("_doc.n_chars")).otherwise(F.length("text")).cast(kind)
    return out.select(*[new.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns])


def op10_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines with a word, lines and runs deleted, hash of the rest."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = F.coalesce("_gone", F.array().cast("array<bigint>"))
    runs = F.filter(gone, lambda x, i: (i == 0) | (F.get(gone, i - 1) != x - 1))
    return without_copies(docs).select(
        F.col("_doc.doc_id").alias("doc_id"), F.col("_had").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"), F.size(runs).cast("long").alias("n_runs"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
