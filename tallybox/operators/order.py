"""Passes over one order of many rows: running sums without a task that holds a whole group.

Rows are dealt by range of the order, so each block is a stretch of it. Blocks are summed, the few sums become each block's
offset, and only inside a block do windows run. A group may hold any share of the rows: it then spans many blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybox.session import stored


def blocks(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """`df` with `_block`: rises along keys and order. The order should end with an id, so that ties can part."""
    by = [F.col(k) for k in keys] + order
    return stored(df.repartitionByRange(*by).withColumn("_block", F.spark_partition_id()))


def running_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], totals: dict[str, str] | None = None) -> DataFrame:
    """`df` with a column for each entry of `sums`: the sum of its expression over the rows of the same keys up to this one, itself
    included. `totals`: name of the keys' whole sum -> name in `sums`."""
    rows = blocks(df.withColumns({f"_v_{n}": c for n, c in sums.items()}), keys, order)
    part = rows.groupBy(*keys, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_b_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    part = part.select(*keys, "_block", *[F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums], *[F.sum(f"_b_{s}").over(whole).alias(t) for t, s in (totals or {}).items()])
    within = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(part, [*keys, "_block"])
    return out.withColumns({n: F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(within) for n in sums}).drop("_block", *[f"_v_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def row_numbers(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`df` with its place, from 1, in one order of all rows."""
    return running_sums(df, [], order, {name: F.lit(1).cast("long")})


def average_ranks(df: DataFrame, keys: list[str], value: str, rank: str, total: str) -> DataFrame:
    """`df` with the average rank from 0 of its value among the rows of its keys, and their number. Equal values are counted first,
    so the ordered pass goes over distinct values."""
    by = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    by = running_sums(by, keys, [F.col(value)], {"_c": F.col("_n")}, {total: "_c"})
    by = by.select(*keys, value, (F.col("_c") - F.col("_n") + (F.col("_n") - 1) / 2).alias(rank), total)
    return df.join(by, [*keys, value])


def quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float]) -> DataFrame:
    """keys, q, quantile: linear between neighbours, as `percentile` gives; nulls are left out. Over counts of distinct values."""
    by = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    by = running_sums(by, keys, [F.col("_v")], {"_c": F.col("_n")}, {"_t": "_c"})
    by = by.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("_at", F.col("q") * (F.col("_t") - 1))
    has = lambda at: (F.col("_c") - F.col("_n") <= at) & (at < F.col("_c"))
    low, high = F.max(F.when(has(F.floor("_at")), F.col("_v"))), F.max(F.when(has(F.ceil("_at")), F.col("_v")))
    return by.groupBy(*keys, "q", "_at").agg(low.alias("_l"), high.alias("_h")).select(*keys, "q", (F.col("_l") + (F.col("_at") - F.floor("_at")) * (F.col("_h") - F.col("_l"))).alias("quantile"))
