"""Bag and set operations on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybox.functions.columns import BOX
from tallybox.operators.fuse import GROUP


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, with the side."""
    return a.exceptAll(b).select(F.lit("a").alias("side"), "*").union(b.exceptAll(a).select(F.lit("b").alias("side"), "*"))


def addon_append(base: DataFrame, extra: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(base with the extra rows that have no `reason` and are new, counts of added rows and of each reason)."""
    keys = [*GROUP, *BOX]
    marked = extra.withColumn("_r", reason)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "det_id"))
    fine = marked.filter("_r is null").withColumn("_k", first)
    known = base.select(*keys).distinct().withColumn("_b", F.lit(True))
    fine = fine.join(known, keys, "left").withColumn("_r", F.when((F.col("_k") > 1) | F.col("_b").isNotNull(), "duplicate").otherwise("added"))
    counts = marked.filter("_r is not null").select("_r").union(fine.select("_r")).groupBy(F.col("_r").alias("reason")).agg(F.count("*").alias("n"))
    return base.unionByName(fine.filter("_r = 'added'").select(base.columns)), counts


def counter_total(log: DataFrame, keys: list[str], counter: str, order: list[str]) -> DataFrame:
    """Total of a counter that starts again at resets: rises are summed, a fall counts what stands after it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    p = F.lag(counter).over(w)
    d = log.withColumn("_p", p)
    step = F.when(F.col("_p").isNull(), F.col(counter)).when(F.col(counter) >= F.col("_p"), F.col(counter) - F.col("_p")).otherwise(F.col(counter))
    return d.groupBy(*keys).agg(F.sum(step).cast("bigint").alias("total"), F.count_if(F.col(counter) < F.col("_p")).alias("resets"))


def membership_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row that is equal for equal bags of rows, whatever their order: count, xor and sum of 60 bits of the rows' sha256."""
    text = F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), "|")
    h = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")
    return df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum"))


#: Rows, or digests, under one node of the hash tree.
FAN = 1024


def ordered_digest(df: DataFrame, columns: list[str], order: list[Column], levels: int | None = None) -> DataFrame:
    """One row (n, digest) that is equal only for the same rows in the same order, however they are partitioned.

    A hash tree over the places of the rows: FAN neighbours make a node by the sha256 of their digests in order, FAN nodes one above, up to the root, so no task reads more than FAN
    digests at once. An empty table has the digest of the empty text. With `levels` the tree ends after that many, and the digest is the largest of its top nodes (null, if there is none): one node
    for FAN ** levels rows at most, beyond that only the root stands for all rows."""
    from tallybox.operators.order import row_numbers

    text = F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), "|")
    d = row_numbers(df, order, "_i").select((F.col("_i") - 1).alias("i"), F.sha2(text, 256).alias("h"))
    n, left = (total := df.count()), 0
    while left < levels if levels else n > 1 or left == 0:
        d = d.groupBy(F.expr(f"i div {FAN}").alias("i")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
        n, left = -(-n // FAN), left + 1
    top = F.max("h") if levels else F.coalesce(F.max("h"), F.sha2(F.lit(""), 256))
    return d.agg(F.lit(total).cast("long").alias("n"), top.alias("digest"))


def runtime_estimate(log: DataFrame, run: str, epoch: str, elapsed: str, total_epochs: int, safety: float = 1.15) -> DataFrame:
    """run, epochs, elapsed, hours: what `total_epochs` take at the pace of a run's last logged epoch (elapsed seconds up to it), times a safety factor."""
    last = log.groupBy(run).agg(F.max_by(F.struct(F.col(epoch).alias("e"), F.col(elapsed).alias("s")), F.col(epoch)).alias("l"))
    hours = F.col("l.s") / F.greatest(F.col("l.e"), F.lit(1)) * total_epochs * safety / 3600
    return last.select(run, F.col("l.e").alias("epochs"), F.col("l.s").alias("elapsed"), hours.alias("hours"))
