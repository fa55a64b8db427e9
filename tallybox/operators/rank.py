"""Scores: joins of score tables, blends, calibration, ranks, quantile filters, top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybox.operators.order import average_ranks, quantiles, row_numbers, running_sums

FLOOR = 1e-12


def replace_scores(base: DataFrame, other: DataFrame, classes: list[int], id_col: str = "det_id") -> DataFrame:
    """The other table's score for rows of the chosen classes that it holds."""
    b = other.select(id_col, F.col("score").alias("_o"))
    return base.join(b, id_col, "left").withColumn("score", F.when(F.col("class_id").isin(*classes), F.coalesce("_o", "score")).otherwise(F.col("score"))).drop("_o")


def geometric_blend(base: Column, other: Column, weight: Column | float) -> Column:
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return F.pow(F.greatest(base, F.lit(FLOOR)), 1 - w) * F.pow(F.greatest(other, F.lit(FLOOR)), w)


def logit_shift(score: Column, extra: Column, beta: float) -> Column:
    from tallybox.functions.columns import logit, sigmoid

    return sigmoid(logit(score) + beta * extra)


def linear_sigmoid(features: dict[str, tuple[float, float, float]], intercept: float) -> Column:
    """features: column -> (mean, std, coefficient)."""
    from tallybox.functions.columns import sigmoid

    z = F.lit(float(intercept))
    for c, (mean, std, coef) in features.items():
        z = z + (F.col(c) - mean) / std * coef
    return sigmoid(z)


def relative_rank(keys: list[str], *order: Column) -> Column:
    """Rank from 0 over the last rank; 0 in groups of one."""
    w = Window.partitionBy(*keys)
    return (F.row_number().over(w.orderBy(*order)) - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1))


def with_percentile(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(average rank from 0 + 0.5) / number of rows of the keys."""
    return average_ranks(df, keys, value, "_r", "_t").withColumn(name, (F.col("_r") + 0.5) / F.col("_t")).drop("_r", "_t")


def group_calibration(method: str, alpha: float, supports: tuple[str, ...] = ()) -> Column:
    """The score times a factor of its group, within 1e-12 and 1.

    image_max, class_max: the largest score of the image (of its class there) ^ -alpha; image_count, class_count: rows there, in units of
    200 (30), ^ -alpha; unsupported, all_supported: alpha where no (every) column of `supports` is true."""
    image, group = Window.partitionBy("image_id"), Window.partitionBy("image_id", "class_id")
    support = sum((F.col(c).cast("int") for c in supports), F.lit(0))
    largest = lambda w: F.pow(F.greatest(F.max("score").over(w), F.lit(FLOOR)), F.lit(-alpha))
    count = lambda w, unit: F.pow(F.count("*").over(w) / F.lit(unit), F.lit(-alpha))
    factor = {"image_max": lambda: largest(image), "class_max": lambda: largest(group), "image_count": lambda: count(image, 200.0), "class_count": lambda: count(group, 30.0),
              "unsupported": lambda: F.when(support == 0, F.lit(alpha)).otherwise(1.0), "all_supported": lambda: F.when(support == len(supports), F.lit(alpha)).otherwise(1.0)}
    return F.least(F.lit(1.0), F.greatest(F.lit(FLOOR), F.col("score") * factor[method]()))


def burst_penalty(df: DataFrame, keys: list[str], quantile: float, alpha: float) -> DataFrame:
    """Score times min(1, q / count) ^ alpha, q the quantile of the groups' counts."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    q = quantiles(counts, [], "_n", [quantile]).select(F.col("quantile").alias("_q"))
    return df.join(counts, keys).crossJoin(F.broadcast(q)).withColumn("score", F.col("score") * F.pow(F.least(F.lit(1.0), F.col("_q") / F.col("_n")), alpha)).drop("_n", "_q")


def append_below(base: DataFrame, extra: DataFrame, order: list[Column]) -> DataFrame:
    """The extra rows under the lowest base score, by rank: min * (0.49 - 0.48 * rank / n).

    The rank is global, by blocks of the order."""
    low = base.agg(F.min("score").alias("_m"), ).crossJoin(extra.agg(F.count("*").alias("_n")))
    ranked = row_numbers(extra, order, "_r").withColumn("_r", F.col("_r") - 1).crossJoin(F.broadcast(low))
    added = ranked.withColumn("score", F.col("_m") * (0.49 - 0.48 * F.col("_r") / F.col("_n"))).select(base.columns)
    return base.unionByName(added)


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def quantile_floor(df: DataFrame, q: float, keys: list[str] | None = None, where: Column | None = None, of: DataFrame | None = None) -> DataFrame:
    """Rows at or above the (conditional) score quantile of all rows (of another table, if given) or of their group."""
    of = df if of is None else of
    floor = quantiles(of if where is None else of.filter(where), keys or [], "score", [q])
    if keys:
        return df.join(floor.select(*keys, F.col("quantile").alias("_f")), keys, "left").filter("score >= coalesce(_f, score)").drop("_f")
    return df.crossJoin(F.broadcast(floor.agg(F.max("quantile").alias("_f")))).filter("score >= coalesce(_f, score)").drop("_f")


def weighted_quantile(df: DataFrame, q: float, weight: str, score: str = "score") -> DataFrame:
    """The smallest score at which the cumulative weight reaches q of the whole: equal scores are summed first, so the
    ordered pass goes over distinct scores, not rows."""
    by = df.groupBy(score).agg(F.sum(weight).alias("_w"))
    cum = running_sums(by, [], [F.col(score)], {"_c": F.col("_w")}, {"_t": "_c"})
    return cum.filter(F.col("_c") >= q * F.col("_t")).agg(F.min(score).alias("floor"))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, tie: str) -> DataFrame:
    """First value at which the cumulative weight reaches half."""
    w = Window.partitionBy(*keys).orderBy(value, tie).rowsBetween(Window.unboundedPreceding, 0)
    c = df.withColumn("_c", F.sum(weight).over(w)).withColumn("_t", F.sum(weight).over(Window.partitionBy(*keys)))
    return c.filter(F.col("_c") >= F.col("_t") / 2).groupBy(*keys).agg(F.min(value).alias("median"))
