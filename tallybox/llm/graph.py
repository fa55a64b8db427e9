"""Connected components by alternating large-star and small-star steps: joins and sums, in about log n rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybox.llm.common import cut

#: Edges of one task: rounds over few edges run in few tasks, and leave few files.
TASK_EDGES = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every end of an edge (a, b) of one orderable type; root: the smallest end of its component.

    Null ends and loops are ignored; no edges give no rows.
    """
    up = F.col("a") > F.col("b")
    e = edges.filter("a <> b").select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("b"))
    e = cut(e.distinct())
    before = _print(e)
    tasks = max(1, -(-before[0] // TASK_EDGES))
    while True:
        e = e.coalesce(tasks)
        both = e.union(e.select("b", "a")).toDF("u", "v").coalesce(tasks)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.when(F.col("m") < F.col("u"), F.col("m")).otherwise(F.col("u")).alias("m"))
        large = both.filter("v > u").join(low.coalesce(tasks), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct().coalesce(tasks)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.coalesce(tasks), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = cut(small.coalesce(tasks).distinct().coalesce(tasks))
        now = _print(e)
        if now == before:
            return e.select(F.col("a").alias("v"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
        before = now


def _print(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first())
