"""Distributions, distances between them, and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybox.operators.order import average_ranks, quantiles, running_sums


def percentiles(df: DataFrame, by: list[str], columns: list[str], points: list[int]) -> DataFrame:
    """Exact linear-interpolated percentiles: a row for each group and column. All columns become rows first, so there is one ordered pass."""
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns])).alias("m")).select(*by, "m.measure", "m.v")
    q = quantiles(long, [*by, "measure"], "v", [p / 100 for p in points])
    return q.groupBy(*by, "measure").agg(*[F.max(F.when(F.col("q") == p / 100, F.col("quantile"))).alias(f"p{p}") for p in points])


def nearest_rank(df: DataFrame, by: list[str], value: str, points: list[float]) -> DataFrame:
    """Values at index round(q * (n - 1)) (half-even) of each group's sorted values, from counts of distinct values."""
    c = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    c = running_sums(c, by, [F.col(value)], {"_end": F.col("_n")}, {"_all": "_end"})
    i = lambda q: F.rint(F.lit(q) * (F.col("_all") - 1))
    return c.groupBy(*by).agg(*[F.min(F.when(F.col("_end") > i(q), F.col(value))).alias(f"q{int(q * 100)}") for q in points])


def histogram(df: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """(by, bin, share) of the values in equal bins of [low, high]; values outside fall into the end bins."""
    b = F.least(F.greatest(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")
    n = df.filter(F.col(value).isNotNull()).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by))).drop("n")


def jensen_shannon(a: DataFrame, b: DataFrame) -> DataFrame:
    """Divergence in bits of two histograms (bin, share)."""
    j = a.select("bin", F.col("share").alias("p")).join(b.select("bin", F.col("share").alias("q")), "bin", "full_outer").fillna(0.0, ["p", "q"])
    m = (F.col("p") + F.col("q")) / 2
    term = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m)).otherwise(0.0)
    return j.agg((F.sum(term("p")) / 2 + F.sum(term("q")) / 2).alias("jsd"))


def ks_statistic(df: DataFrame, value: str, sample: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic; `sample`: boolean column. The ordered pass goes over distinct values."""
    c = df.groupBy(value).agg(F.count_if(F.col(sample)).alias("a"), F.count_if(~F.col(sample)).alias("b"))
    c = running_sums(c, [], [F.col(value)], {"_a": F.col("a"), "_b": F.col("b")}, {"_ta": "_a", "_tb": "_b"})
    return c.agg(F.max(F.abs(F.col("_a") / F.col("_ta") - F.col("_b") / F.col("_tb"))).alias("ks"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks; ranks come from counts of distinct values."""
    ranked = reduce(lambda d, c: average_ranks(d, [], c[0], c[1], c[1] + "n"), [(x, "_rx"), (y, "_ry")], df)
    return ranked.agg(F.corr("_rx", "_ry").alias("rho"))


def conflicting_groups(rows: DataFrame, content: str, mark: str) -> DataFrame:
    """Contents that carry different annotation sets: content, members, marks. Marks are counted, not gathered."""
    return rows.groupBy(content).agg(F.count("*").alias("members"), F.countDistinct(mark).alias("marks")).filter("marks > 1")


def repeated_boxes(boxes: DataFrame, image: str, *same: str) -> DataFrame:
    """image, boxes: images that hold a box more than once, with the number of such boxes."""
    twice = boxes.groupBy(image, *same).agg(F.count("*").alias("_n")).filter("_n > 1")
    return twice.groupBy(image).agg(F.count("*").alias("boxes"))


def dataset_report(boxes: DataFrame, problem: Column, width: Column, height: Column, points: tuple[int, ...] = (0, 10, 25, 50, 75, 90, 100)) -> DataFrame:
    """(class_id, measure, n, p0 ..): boxes, and their width, height and area as a share of the image, by class and of all (class -1); boxes with a `problem` only count, as
    class -2 under its name."""
    d = boxes.withColumns({"_problem": problem, "width": F.col("x2") - F.col("x1"), "height": F.col("y2") - F.col("y1")})
    d = d.withColumn("area_share", F.col("width") * F.col("height") / (width * height))
    good = d.filter("_problem is null").withColumn("class_id", F.explode(F.array("class_id", F.lit(-1))))
    p = percentiles(good, ["class_id"], ["width", "height", "area_share"], list(points))
    out = p.join(good.groupBy("class_id").agg(F.count("*").alias("n")), "class_id").select("class_id", "measure", "n", *[f"p{x}" for x in points])
    bad = d.filter("_problem is not null").groupBy("_problem").agg(F.count("*").alias("n"))
    return out.union(bad.select(F.lit(-2), "_problem", "n", *[F.lit(None).cast("double")] * len(points)))


def split_summary(objects: DataFrame, tiles: DataFrame) -> DataFrame:
    """(part, split, key, n): `objects` by split and class; `tiles` by split, of which `repeat`, `global`, `strip`, and `crop` (neither of the last two).

    objects: split, class_id; tiles: split, is_repeat, is_global, is_strip."""
    o = objects.groupBy("split", "class_id").agg(F.count("*").alias("n")).select(F.lit("objects").alias("part"), "split", F.col("class_id").cast("string").alias("key"), "n")
    kinds = {"tiles": F.lit(True), "repeat": F.col("is_repeat"), "global": F.col("is_global"), "strip": F.col("is_strip"), "crop": ~F.col("is_global") & ~F.col("is_strip")}
    t = tiles.groupBy("split").agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])
    t = t.select("split", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("n")) for k in kinds])).alias("k"))
    return o.union(t.select(F.lit("tiles"), "split", "k.key", "k.n"))


def prediction_distribution(pred: DataFrame, classes: list[int]) -> DataFrame:
    """(class_id, n, images, images_median, score_median, score_p99): for each class the rows and their scores' median and 99th percentile, for all (class -1)
    the rows, the images that hold any, and the median of their counts. Classes without rows have n 0."""
    q = percentiles(pred, ["class_id"], ["score"], [50, 99])
    none = F.lit(None)
    named = pred.sparkSession.createDataFrame([(c,) for c in classes], "class_id int")
    by = pred.groupBy("class_id").agg(F.count("*").alias("n"))
    per = named.join(by, "class_id", "left").join(q, "class_id", "left").select("class_id", F.coalesce("n", F.lit(0)).alias("n"), none.cast("long").alias("images"), none.cast("double").alias("images_median"), F.col("p50").alias("score_median"), F.col("p99").alias("score_p99"))
    images = pred.groupBy("image_id").agg(F.count("*").alias("c"))
    m = percentiles(images, [], ["c"], [50])
    whole = images.agg(F.sum("c").alias("n"), F.count("*").alias("images")).crossJoin(F.broadcast(m.select("p50")))  # one row each
    return per.union(whole.select(F.lit(-1), "n", "images", "p50", none.cast("double"), none.cast("double")))


def contrast_report(images: DataFrame, pred: DataFrame, low: float) -> DataFrame:
    """By view: images, count_median, count_p90 of predictions for each image (none counts as 0), highest_median (of the highest score, 0 without), rho (Spearman, contrast and count),
    zero (images without predictions), low (images of less contrast than `low`). images: image_id, view, contrast."""
    n = pred.groupBy("image_id").agg(F.count("*").alias("n"), F.max("score").alias("top"))
    d = images.join(n, "image_id", "left").select("image_id", "view", "contrast", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("top", F.lit(0.0)).alias("top"))
    q = percentiles(d, ["view"], ["n", "top"], [50, 90]).groupBy("view").agg(F.max(F.when(F.col("measure") == "n", F.col("p50"))).alias("count_median"), F.max(F.when(F.col("measure") == "n", F.col("p90"))).alias("count_p90"), F.max(F.when(F.col("measure") == "top", F.col("p50"))).alias("highest_median"))
    r = reduce(lambda x, c: average_ranks(x, ["view"], c[0], c[1], c[1] + "n"), [("contrast", "_rx"), ("n", "_ry")], d)
    r = r.groupBy("view").agg(F.count("*").alias("images"), F.corr("_rx", "_ry").alias("rho"), F.count_if(F.col("n") == 0).alias("zero"), F.count_if(F.col("contrast") < low).alias("low"))
    return r.join(q, "view").select("view", "images", "count_median", "count_p90", "highest_median", "rho", "zero", "low")


def grounding_report(samples: DataFrame, image: str) -> DataFrame:
    """(measure, value): samples, image groups, least and most queries for each image, labelled samples, and mean and median of their boxes' width, height and area.

    samples: the image's key, bbox array of four numbers or null."""
    by = samples.groupBy(image).agg(F.count("*").alias("q"), F.count("bbox").alias("b"))
    counts = by.agg(F.sum("q").alias("samples"), F.count("*").alias("image_groups"), F.min("q").alias("least"), F.max("q").alias("most"), F.sum("b").alias("labelled"))
    at = lambda i: F.get("bbox", F.lit(i))
    b = samples.filter("bbox is not null").select((at(2) - at(0)).alias("width"), (at(3) - at(1)).alias("height")).withColumn("area", F.col("width") * F.col("height"))
    sides = ("width", "height", "area")
    means = b.agg(*[F.avg(c).alias(f"{c}_mean") for c in sides])
    medians = percentiles(b, [], list(sides), [50]).select(F.concat("measure", F.lit("_median")).alias("measure"), F.col("p50").alias("value"))
    long = lambda d: d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in d.columns])).alias("m")).select("m.*")
    return long(counts).union(long(means)).union(medians)


def tile_label_counts(tiles: DataFrame, labels: DataFrame, place: list[str], source: str) -> DataFrame:
    """(class_id, tiles, sources, boxes): by class those that hold its labels; of all (class -1) every tile and source, and the boxes; class -2: tiles and sources with any label."""
    held = labels.groupBy("class_id").agg(F.countDistinct(*place).alias("tiles"), F.countDistinct(source).alias("sources"), F.count("*").alias("boxes"))
    every = tiles.agg(F.lit(-1).alias("class_id"), F.countDistinct(*place).alias("tiles"), F.countDistinct(source).alias("sources")).crossJoin(F.broadcast(labels.agg(F.count("*").alias("boxes"))))
    some = labels.agg(F.lit(-2).alias("class_id"), F.countDistinct(*place).alias("tiles"), F.countDistinct(source).alias("sources"), F.count("*").alias("boxes"))
    return held.union(every).union(some)
