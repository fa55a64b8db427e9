"""Weights, scalers and group-safe fits with Spark ML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybox.session import cut, stored


def balanced(df: DataFrame, keys: list[str]) -> DataFrame:
    """weight = rows / (groups * the group's rows): every group weighs the same and the mean is 1."""
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    t = n.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    return df.join(n.crossJoin(F.broadcast(t)), keys).withColumn("weight", F.col("_t") / (F.col("_n") * F.col("_k"))).drop("_n", "_t", "_k")


def group_robust(df: DataFrame, stratum: str, group: str) -> DataFrame:
    """Each stratum weighs 1, its groups share that evenly, their rows share it again: copies of a group add nothing."""
    n = df.groupBy(stratum, group).agg(F.count("*").alias("_n"))
    k = n.groupBy(stratum).agg(F.count("*").alias("_k"))
    return df.join(n, [stratum, group]).join(k, stratum).withColumn("weight", 1 / F.col("_k") / F.col("_n")).drop("_n", "_k")


def scaled(df: DataFrame, keys: list[str], columns: list[str], floor: float = 1e-6) -> DataFrame:
    """<column>_z: by the group's mean and population standard deviation."""
    s = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.greatest(F.stddev_pop(c), F.lit(floor)).alias(f"_s_{c}") for c in columns])
    out = df.join(s, keys)
    return out.withColumns({f"{c}_z": (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in columns}).select(*df.columns, *[f"{c}_z" for c in columns])


def _vector(df: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="_x").transform(df)


def constrained_logistic(df: DataFrame, columns: list[str], label: str, weight: str, lower: list[float | None], reg: float = 1e-3) -> DataFrame:
    """Coefficients (name, value) of a weighted logistic fit with lower bounds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Matrices

    low = Matrices.dense(1, len(columns), [float("-inf") if x is None else x for x in lower])
    fit = LogisticRegression(featuresCol="_x", labelCol=label, weightCol=weight, regParam=reg, lowerBoundsOnCoefficients=low, maxIter=50).fit(_vector(stored(df.select(label, weight, *columns)), columns))
    rows = [*zip(columns, map(float, fit.coefficients), strict=True), ("intercept", float(fit.intercept))]
    return df.sparkSession.createDataFrame(rows, "name string, value double")


def _binned(df: DataFrame, columns: list[str], edges: list) -> tuple[DataFrame, list[str]]:
    """`df` with the bin of each column as a number: how many edges are at or below its value. A null stays, so that the assembler refuses it; NaN is an error here."""
    from pyspark.ml.feature import Bucketizer

    names = [f"_b{i}" for i in range(len(columns))]
    split = {n: (c, [float("-inf"), *map(float, e), float("inf")]) for n, c, e in zip(names, columns, edges, strict=True) if len(e)}
    if split:
        df = Bucketizer(inputCols=[c for c, _ in split.values()], outputCols=[*split], splitsArray=[e for _, e in split.values()]).transform(df)
        df = df.withColumns({n: F.col(n) + 0.0 for n in split})  # without the mark of a category, since bins have an order
    return df.withColumns({n: F.when(F.col(c).isNotNull(), 0.0) for n, c in zip(names, columns, strict=True) if n not in split}), names


def alike(df: DataFrame, columns: list[str], label: str, weight: str, by_label: bool) -> DataFrame:
    """Rows of one fold and the same `columns` (and label, `by_label`) as one, with their mean label and the sum of their weights. Rows of no weight count nothing."""
    on = F.col(weight) > 0
    w = F.coalesce(F.sum(F.when(on, F.col(weight))), F.lit(0.0))
    mean = F.sum(F.when(on, F.col(weight) * F.col(label))) / F.sum(F.when(on, F.col(weight)))
    return df.groupBy("fold", *columns, *([F.col(label).alias("_y")] if by_label else [])).agg(*([] if by_label else [mean.alias("_y")]), w.alias("_w"))


#: Places of bins that are broadcast with their predictions; more are joined in a shuffle.
PLACES = 500_000


def out_of_fold(df: DataFrame, columns: list[str], label: str, weight: str, folds: int, kind: str, iterations: int = 5) -> DataFrame:
    """Each row scored (`prediction`) by a boosted-tree model that saw no row of its fold. Groups must not cross folds.

    Trees see 32 bins of a feature, cut at the exact quantiles of all rows. Rows alike in them add the same to every sum that a fit looks at, so it reads them as one:
    folds * 32 ^ features rows at most, however many there are."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor

    from tallybox.operators.boost import bin_edges

    d = stored(df)
    d, bins = _binned(d, columns, bin_edges(d, columns, 32))
    place = ["fold", *bins]
    cells = _vector(stored(alike(d, bins, label, weight, kind == "classifier")), bins)
    places = cells.select(*place, "_x").distinct()
    parts = []
    for k in range(folds):
        make = GBTClassifier if kind == "classifier" else GBTRegressor
        fit = make(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=iterations, maxDepth=3, seed=7).fit(cells.filter((F.col("fold") != k) & (F.col("_w") > 0)))
        p = vector_to_array("probability")[1] if kind == "classifier" else F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0))
        parts.append(fit.transform(places.filter(F.col("fold") == k)).select(*place, p.alias("_p")))
    scored = stored(reduce(DataFrame.union, parts))
    d = d.join(F.broadcast(scored) if scored.count() <= PLACES else scored, place)
    return d.select(*df.columns, F.col("_p").alias("prediction"))


def beta_sweep(df: DataFrame, totals: DataFrame, betas: list[float], weights: dict[str, float]) -> DataFrame:
    """class_id, beta, weighted_ap, worst_delta, chosen: the blends score^(1-b) prediction^b of each class, by their AP in each view.

    Of the blends that lose in no view against the plain score (of all, if each loses somewhere) the one of the largest weighted AP is chosen, then of the largest
    worst delta, then the smallest. df: det_id, class_id, view, tp, score, prediction; totals: view, class_id, n_gt."""
    from tallybox.operators.metrics import average_precision
    from tallybox.operators.rank import geometric_blend

    grid = lambda d: d.withColumn("beta", F.explode(F.array(*[F.lit(float(b)) for b in betas])))
    by = ["class_id", "view", "beta"]
    df = stored(df.select("det_id", "class_id", "view", "tp", "score", "prediction"))  # read by two ordered passes and the sampling of each
    d = grid(df)
    ap = average_precision(d.withColumn("score", geometric_blend(F.col("score"), F.col("prediction"), F.col("beta"))), grid(totals), by).filter("ap is not null")
    base = average_precision(df, totals, ["class_id", "view"]).select("class_id", "view", F.col("ap").alias("base"))
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("view")]
    s = ap.join(base, ["class_id", "view"]).groupBy("class_id", "beta").agg(F.sum(weight * F.col("ap")).alias("weighted_ap"), F.min(F.col("ap") - F.col("base")).alias("worst_delta"))
    order = Window.partitionBy("class_id").orderBy(F.desc(F.col("worst_delta") >= 0), F.desc("weighted_ap"), F.desc("worst_delta"), "beta")  # a row for each blend of a class
    return s.withColumn("chosen", F.row_number().over(order) == 1)


def _cell(columns: list[str], name: str, width: float) -> Column:
    return F.array(*[F.floor(F.col(f"{name}_{c}") / width) for c in columns])


def _moved(cell: str, at: int, by: Column) -> Column:
    """An array with `by` added to its number at `at`."""
    return F.transform(cell, lambda x, k: F.when(k == at, x + by).otherwise(x))


def matched_subset(targets: DataFrame, pool: DataFrame, key: str, columns: list[str], most_rounds: int = 40) -> DataFrame:
    """(target, partner, distance): partners distinct, pairs taken by distance, the nearest first, until targets or pool are used up.

    Features are robust-scaled. Pairs within a radius meet by the cells of a grid of that width; among them mutual nearest neighbours match, round by round, until
    none is left; then the radius doubles for those still free. Matches are a table, and leave by anti-joins."""
    from tallybox.operators.audit import percentiles

    both = targets.select(*columns).union(pool.select(*columns))
    n = both.count()
    q = {r["measure"]: r for r in percentiles(both, [], columns, [0, 25, 50, 75, 100]).collect()}  # a row for each column
    spread = {c: max(q[c]["p75"] - q[c]["p25"], 1e-9) if n else 1.0 for c in columns}
    z = lambda df, name: cut(df.select(F.col(key).alias(name), *[((F.col(c) - F.lit(q[c]["p50"] if n else 0.0)) / spread[c]).alias(f"{name}_{c}") for c in columns]))
    t, p = z(targets, "target"), z(pool, "partner")
    found = cut(t.sparkSession.createDataFrame([], "target long, partner long, distance double"))
    if not n:
        return found
    widest = max((q[c]["p100"] - q[c]["p0"]) / spread[c] for c in columns) * len(columns) ** 0.5 + 1e-9
    radius = widest / max(2.0, n ** (1 / len(columns)))
    for _ in range(most_rounds):
        near = t.withColumn("_c", _cell(columns, "target", radius))
        for i in range(len(columns)):
            near = near.withColumn("_o", F.explode(F.array(*[F.lit(o) for o in (-1, 0, 1)]))).withColumn("_c", _moved("_c", i, F.col("_o"))).drop("_o")
        d = F.sqrt(sum((F.pow(F.col(f"target_{c}") - F.col(f"partner_{c}"), 2) for c in columns), F.lit(0.0)))
        pairs = cut(near.join(p.withColumn("_c", _cell(columns, "partner", radius)), "_c").select("target", "partner", d.alias("distance")).filter(F.col("distance") <= radius))
        while True:
            a = pairs.groupBy("target").agg(F.min(F.struct("distance", "partner")).alias("b")).select("target", "b.partner", "b.distance")
            b = pairs.groupBy("partner").agg(F.min(F.struct("distance", "target")).alias("b")).select("partner", "b.target")
            new = cut(a.join(b, ["target", "partner"]).select("target", "partner", "distance"))
            if new.isEmpty():
                break
            found = found.union(new)
            pairs = cut(pairs.join(new.select("target"), "target", "left_anti").join(new.select("partner"), "partner", "left_anti"))
        found = cut(found)
        t, p = cut(t.join(found.select("target"), "target", "left_anti")), cut(p.join(found.select("partner"), "partner", "left_anti"))
        if radius > widest or t.isEmpty() or p.isEmpty():
            break
        radius *= 2
    return found
