"""Quality rules by robust multivariate outliers (DataFrame functions only).

Statistics of every whole text are transformed into a vector: log mean word
length, and square roots of symbols per word, of repeated lines, of words in
repeated three-word windows and of capitals per character. For each language
and source the minimum covariance determinant is sought from three starts:
medians and quartile ranges alone, and with the correlations of hyperbolic
tangents or of spatial signs of the scores. From each, mean and covariance are
fitted again and again to the closest three quarters of the group until the
determinant stops falling; the fit with the least one is kept. A document whose
squared Mahalanobis distance from the fit exceeds ``CUTOFF`` is rejected.

The vectors are fixed-point integers and all sums exact, so the fit doesn't
depend on the order of rows. A step is one aggregate per group, start and
distance bin (map-side combined; a hot source is only more rows of it) and a
running total over the bins of a group, whose number is bounded; starts that
have come to rest take no further part. ``FLOOR`` is the least standard
deviation assumed of each statistic: it holds where a group varies less, keeps
the matrix regular where it has one value only, and tiny groups from rejecting.

Defined cases: null text has no words and fails the base rules; null languages
and sources form groups of their own with the empty ones; groups with equal
rows, or of one row, reject none of these rows; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relaylake.llm.common import let, read_table, stored

MIN_WORDS = 50
REPEAT_PERCENT = 50
SHARE = 0.75  # of a group that the fit describes
TOLERANCE = 0.001  # least fall of the determinant's logarithm that counts
SCALE = 1000  # fixed point of the statistics
FLOOR = (0.06, 0.10, 0.12, 0.12, 0.06)
CUTOFF = 35.9  # chi-square, 5 degrees of freedom: beyond 1 - 1e-6
CHI2_MEDIAN = 4.351  # of chi-square with 5 degrees of freedom
BLANKS = r"[\x20\x09-\x0D]+"
P = len(FLOOR)


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more."""
    def covered(starts: Column) -> Column:  # ascending places of repeated windows
        last = F.size(starts) - 1
        return F.aggregate(F.sequence(F.lit(0), last), F.lit(0).cast("long"),
                           lambda a, k: a + F.when(k == last, F.lit(3)).otherwise(F.least(F.lit(3), F.get(starts, k + 1) - F.get(starts, k))))

    def sorted_windows(s: Column) -> Column:  # (hash, place), ascending
        same = lambda j: (F.get(s, j)["h"].eqNullSafe(F.get(s, j - 1)["h"])) | (F.get(s, j)["h"].eqNullSafe(F.get(s, j + 1)["h"]))
        starts = F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), same), lambda j: F.get(s, j)["i"])
        return let(F.sort_array(starts), lambda x: F.when(F.size(x) > 0, covered(x)).otherwise(F.lit(0).cast("long")))

    def windows(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(F.sort_array(pairs), sorted_windows))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3),
                         lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(hashes, windows))


def statistics(docs: DataFrame) -> DataFrame:
    """Base statistics of every row: the keys, ``lang``, ``source`` and counts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "doc_id", "text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    per_words = let(F.array_remove(F.split(text, BLANKS, -1), ""), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeat_words(w).alias("n_repeat_words")))
    per_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                              (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return keys.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_h"), "lang", "source",
        per_words.alias("w"), per_lines.alias("l"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[A-Z]")).cast("long").alias("n_capitals"),
    ).select("doc_id", "_h", "lang", "source", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines",
             "w.n_repeat_words", "l.n_lines", "n_capitals",
             ((F.col("w.n_words") < MIN_WORDS) | (100 * F.col("w.n_repeat_words") > REPEAT_PERCENT * F.col("w.n_words"))).alias("base_failed"))


def vectors(stats: DataFrame) -> DataFrame:
    """Adds ``z0`` … ``z4``: the transformed statistics in fixed point."""
    n, chars = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    x = [F.log(chars / n), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 5.0)),
         F.sqrt(F.col("n_repeat_words") / n), F.sqrt(F.col("n_capitals") / chars)]
    return stats.withColumns({f"z{k}": F.when(F.col("n_words") > 0, F.round(v * SCALE)).otherwise(0).cast("long") for k, v in enumerate(x)})


GROUP = ["lang", "source"]
START = [*GROUP, "start"]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def starting_fit(rows: DataFrame) -> DataFrame:
    """Medians and quartile ranges of each group as a first fit (``m*``, ``v**``)."""
    long = rows.select(*GROUP, F.posexplode(F.array(*[f"z{k}" for k in range(P)])).alias("k", "z"))
    counts = long.groupBy(*GROUP, "k", "z").agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy(*GROUP, "k").orderBy("z").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("c").over(up)).withColumn("all", F.sum("c").over(Window.partitionBy(*GROUP, "k")))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("z")))
    per = counts.groupBy(*GROUP).pivot("k", list(range(P))).agg(at(0.25).alias("a"), at(0.5).alias("m"), at(0.75).alias("b"))
    cols = {f"m{k}": F.col(f"{k}_m").cast("double") for k in range(P)}
    cols |= {f"v{i}{j}": floored(F.pow((F.col(f"{i}_b") - F.col(f"{i}_a")) / 1.349, 2), i) if i == j else F.lit(0.0) for i, j in PAIRS}
    return per.select(*GROUP, *[v.alias(k) for k, v in cols.items()])


def floored(variance: Column, k: int) -> Column:
    return F.greatest(variance, F.lit((FLOOR[k] * SCALE) ** 2))


def starting_fits(rows: DataFrame) -> DataFrame:
    """Three fits of each group: start 0 has the variances only; 1 adds the
    correlations of the scores' hyperbolic tangents, 2 those of their signs in
    space (the scores' directions from the median)."""
    plain = stored(starting_fit(rows), "mcd-start")
    score = [(F.col(f"z{k}") - F.col(f"m{k}")) / F.sqrt(f"v{k}{k}") for k in range(P)]
    away = F.greatest(F.sqrt(sum((u * u for u in score), F.lit(0.0))), F.lit(1e-9))
    fixed = lambda us: F.struct(*[F.round(u * SCALE).cast("long").alias(f"t{k}") for k, u in enumerate(us)])
    bounded = (rows.join(plain, GROUP)
               .select(*GROUP, F.posexplode(F.array(fixed([F.tanh(u) for u in score]), fixed([u / away for u in score]))).alias("at", "t"))
               .groupBy(*GROUP, (F.col("at") + 1).alias("start"))
               .agg(*[F.sum(F.col(f"t.t{i}") * F.col(f"t.t{j}")).cast("double").alias(f"q{i}{j}") for i, j in PAIRS]))
    spread = lambda k: F.sqrt(F.greatest(F.col(f"q{k}{k}"), F.lit(1.0)))
    turned = bounded.join(plain, GROUP).select(*START, *[f"m{k}" for k in range(P)], *[
        F.col(f"v{i}{i}") if i == j else
        (F.col(f"q{i}{j}") / (spread(i) * spread(j)) * F.sqrt(F.col(f"v{i}{i}") * F.col(f"v{j}{j}"))).alias(f"v{i}{j}") for i, j in PAIRS])
    return plain.withColumn("start", F.lit(0)).unionByName(turned)


def fit_keys(fit: DataFrame) -> list[str]:
    return START if "start" in fit.columns else GROUP


def whitened(fit: DataFrame) -> DataFrame:
    """Adds ``w**``, the inverse of the covariance's Cholesky factor, and
    ``logdet``, the logarithm of its determinant. A statistic that others give
    exactly keeps one unit of the fixed point as its spread."""
    keys = fit_keys(fit)
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"v{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            fit = fit.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l{j}{j}"))
    for j in range(P):
        for i in range(j, P):
            fit = fit.withColumn(f"w{i}{j}", 1 / F.col(f"l{i}{i}") if i == j else
                                 -sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}{i}"))
    logdet = sum((2 * F.log(F.col(f"l{k}{k}")) for k in range(P)), F.lit(0.0))
    return fit.select(*keys, *[f"m{k}" for k in range(P)], *[f"w{i}{j}" for i, j in PAIRS], logdet.alias("logdet"))


def with_distance(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance under the group's fit (one
    row per start, if the fit has several)."""
    keep = [*rows.columns, *[k for k in fit_keys(fit) if k not in rows.columns]]
    joined = rows.join(fit, GROUP)
    parts = [sum((F.col(f"w{i}{j}") * (F.col(f"z{j}") - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(P)]
    return joined.select(*keep, sum((y * y for y in parts), F.lit(0.0)).alias("d2"))


def concentrated(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """One concentration step: mean and covariance of the closest ``SHARE``."""
    keys = fit_keys(fit)
    exact = lambda c: F.sum(c.cast("decimal(24,0)"))
    bins = (with_distance(rows, fit).withColumn("bin", F.floor(64 * F.log2(1 + F.col("d2"))).cast("int"))
            .groupBy(*keys, "bin").agg(
                F.count(F.lit(1)).alias("c"), *[exact(F.col(f"z{k}")).alias(f"s{k}") for k in range(P)],
                *[exact(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"q{i}{j}") for i, j in PAIRS]))
    sums = ["c", *[f"s{k}" for k in range(P)], *[f"q{i}{j}" for i, j in PAIRS]]
    below = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    inside = (bins.withColumn("below", F.coalesce(F.sum("c").over(below), F.lit(0)))
              .withColumn("all", F.sum("c").over(Window.partitionBy(*keys)))
              .where(F.col("below") < SHARE * F.col("all"))
              .groupBy(*keys).agg(*[F.sum(x).alias(x) for x in sums]))
    n = F.col("c").cast("double")
    mean = lambda k: F.col(f"s{k}").cast("double") / n
    cross = lambda i, j: F.col(f"q{i}{j}").cast("double") / n - mean(i) * mean(j)
    return inside.select(*keys, *[mean(k).alias(f"m{k}") for k in range(P)], *[
        (floored(cross(i, i), i) if i == j else cross(i, j)).alias(f"v{i}{j}") for i, j in PAIRS])


def least_determinant(rows: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Concentrates every start of every group until its determinant falls no
    more, and keeps the group's fit with the least determinant. The floors bound
    the determinant from below, so the steps end."""
    steps, live = [], stored(whitened(starting_fits(rows)), "mcd-fit").withColumn("logdet", F.lit(float("inf")))
    while True:  # one row per group and start that still moves
        steps.append(stored(whitened(concentrated(rows, live)), "mcd-fit"))
        before = live.select(*START, F.col("logdet").alias("_before"))
        # stored, for Spark takes a join for as large as the product of its sides, and would broadcast the rows
        live = stored(steps[-1].join(before, START).where(F.col("logdet") < F.col("_before") - tolerance).drop("_before"), "mcd-live")
        if live.isEmpty():
            break
    every = steps[0].withColumn("step", F.lit(0))
    for k, fit in enumerate(steps[1:], 1):
        every = every.unionByName(fit.withColumn("step", F.lit(k)))
    values = [c for c in steps[0].columns if c not in START]
    return (every.groupBy(*GROUP).agg(F.min_by(F.struct(*values), F.struct("logdet", "start", "step")).alias("_fit"))
            .select(*GROUP, "_fit.*"))


def fitted(rows: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """The fit of each group (``m*``, ``w**``) and ``grow``, the factor that
    brings the median distance to that of a normal sample (1 at least)."""
    fit = stored(least_determinant(rows, tolerance), "mcd-fit")
    bins = (with_distance(rows, fit).groupBy(*GROUP, F.floor(64 * F.log2(1 + F.col("d2"))).cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("c")))
    up = Window.partitionBy(*GROUP).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    median = (bins.withColumn("upto", F.sum("c").over(up)).withColumn("all", F.sum("c").over(Window.partitionBy(*GROUP)))
              .where(2 * F.col("upto") >= F.col("all")).groupBy(*GROUP).agg(F.min("bin").alias("bin")))
    grow = F.greatest(F.lit(1.0), (F.pow(F.lit(2.0), (F.col("bin") + 1) / 64.0) - 1) / CHI2_MEDIAN)
    return stored(fit.join(median.select(*GROUP, grow.alias("grow")), GROUP), "mcd-fit")


def quality_verdicts(docs: DataFrame, tolerance: float = TOLERANCE, cutoff: float = CUTOFF) -> DataFrame:
    """Every row's statistics, ``base_failed``, ``distance`` (null where the
    base rules failed) and ``kept``."""
    rows = stored(vectors(statistics(docs)), "quality")
    good = rows.where(~F.col("base_failed"))
    fit = fitted(good, tolerance)
    judged = (with_distance(good, fit.drop("grow")).join(fit.select(*GROUP, "grow"), GROUP)
              .withColumn("distance", F.col("d2") / F.col("grow")).drop("d2", "grow"))
    bad = rows.where("base_failed").withColumn("distance", F.lit(None).cast("double"))
    return (judged.unionByName(bad)
            .withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with all their columns."""
    rejected = quality_verdicts(docs, **options).where(~F.col("kept")).select(F.col("doc_id").alias("_bad"), F.col("_h").alias("_bad_h")).distinct()
    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["_bad"]) & (text_hash == rejected["_bad_h"]), "left_anti")


def op6_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "lang", "source", "distance")
