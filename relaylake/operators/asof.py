"""As-of join: for each row the latest values at or before its time.

Both sides are merged, sorted by key and time, and the values folded forward
(last one that isn't null). A key's rows are split by spans of time, so a key
with a third of all rows is many groups, not one. What is known before a span
is one more row at its start, so one sort gives every row its values; these
rows come from the right side's last values of each span, and of the left side
only the spans that it has are counted for them, not its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _span(at: Column, hours: int) -> Column:
    since = F.timestamp_diff("HOUR", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at.cast("timestamp_ntz"))
    return F.floor(since / F.lit(hours)).cast("long")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, order: str, values: list[str],
          span_hours: int = 24, spans_of: DataFrame | None = None) -> DataFrame:
    """``left`` with each of ``values``: the last one that isn't null among the
    rows of ``right`` with equal keys and ``since <= at``, by (since, order).
    Null where there is none, where a key is null or where ``at`` is. The two
    sides need no common types but the keys'; other columns of ``left``, however
    they are named, come back as they were. ``spans_of`` has at least the keys
    and times of ``left``, where these can be had with less work."""
    known = right.where(F.col(since).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    key = [f"_k{i}" for i in range(len(keys))]
    n = range(len(values))

    def placed(df: DataFrame, time: str, *more: Column) -> DataFrame:
        rows = df.select(*[F.col(k).alias(name) for k, name in zip(keys, key)], F.col(time).cast("timestamp_ntz").alias("_t"), *more)
        return rows.withColumn("_s", _span(F.col("_t"), span_hours))

    own = [f"_l{i}" for i in range(len(left.columns))]  # columns of their own: what no one asks for later isn't sorted
    asked = placed(left, at, F.lit(1).alias("_side"), *[F.col(f"`{c}`").alias(name) for c, name in zip(left.columns, own)])
    events = placed(known, since, F.lit(0).alias("_side"), F.col(order).alias("_o"), *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)])
    spans = placed(left if spans_of is None else spans_of, at).select(*key, "_s").dropna().distinct().withColumn("_asked", F.lit(True))
    ends = events.groupBy(*key, "_s").agg(*[
        F.max_by(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), F.struct("_t", "_o"))).alias(f"_v{i}") for i in n])
    earlier = Window.partitionBy(*key).orderBy("_s").rangeBetween(Window.unboundedPreceding, -1)
    carried = (spans.unionByName(ends, allowMissingColumns=True)
               .select(*key, "_s", "_asked", *[F.last(f"_v{i}", ignorenulls=True).over(earlier).alias(f"_v{i}") for i in n])
               .where("_asked").drop("_asked").dropna("all", subset=[f"_v{i}" for i in n]))
    both = asked.unionByName(events, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    order_in = Window.partitionBy("_s", *key).orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)  # without a time: first
    folded = both.withColumns({f"_in{i}": F.last(f"_v{i}", ignorenulls=True).over(order_in) for i in n}).where("_side = 1")
    return folded.select(*[F.col(name).alias(c) for c, name in zip(left.columns, own)], *[F.col(f"_in{i}").alias(v) for i, v in enumerate(values)])
