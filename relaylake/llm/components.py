"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylake.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``edges(a, b)`` but the components'
    smallest nodes; ``comp`` is the smallest node reachable.

    Each round hangs the larger neighbours of every node on its smallest one,
    then the smaller ones; stars are reached in a logarithmic number of rounds.
    Minima are combined on the map side and joined back, so a node with very
    many neighbours is no group in one task. A round's edges are written to
    the shared folder; only their number and a checksum come to the driver.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        seen = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = stored(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")
