"""Average precision, operating figures, threshold sweeps, error taxonomies.

A greedy labelling is prefix-stable: what a rank gets depends on the ranks before it alone. So one labelling serves
every threshold, and sweeps are windows over labelled rows, not repeated matching.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybox.functions.columns import IOU_STEPS
from tallybox.operators.fuse import GROUP, match_greedy, pairs_at
from tallybox.operators.order import blocks, running_sums
from tallybox.session import cut, stored


def label(pred: DataFrame, gt: DataFrame, threshold: float, keys: list[str] | None = None) -> DataFrame:
    """Predictions with tp (0/1) and the truth that each took."""
    m = match_greedy(pairs_at(pred, gt, threshold, keys), keys).select("det_id", "gt_id")
    return pred.join(m, "det_id", "left").withColumn("tp", F.col("gt_id").isNotNull().cast("int"))


def average_precision(labelled: DataFrame, totals: DataFrame, by: list[str], weight: str | None = None, order: tuple = ("score", "det_id")) -> DataFrame:
    """AP at 101 recall levels of each group of `by`; null for groups without truth. totals: by, n_gt.

    Ranks by score down, id up; the running sums go over blocks of that order, so a group may hold any share of the rows. Precision only
    matters at the true positives, of which the best for each recall level is kept."""
    w = F.col(weight) if weight else F.lit(1.0)
    rows = labelled.select(*by, F.col("tp").alias("_tp"), F.col(order[0]).alias("_score"), F.col(order[1]).alias("_id"), w.cast("double").alias("_w"))
    r = running_sums(rows, by, [F.desc("_score"), F.asc("_id")], {"_all": F.col("_w"), "_hit": F.col("_w") * F.col("_tp")})
    return _levels(r.filter("_tp = 1").join(totals, by).filter("n_gt > 0").select(*by, (F.col("_hit") / F.greatest("_all", F.lit(1e-12))).alias("_p"), (F.col("_hit") / F.col("n_gt")).alias("_r")), totals, by)


def compact_ap(hits: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """The same from the true positives alone: hits: by, rank (among all rows), k (among the true positives)."""
    return _levels(hits.join(totals, by).filter("n_gt > 0").select(*by, (F.col("k") / F.col("rank")).alias("_p"), (F.col("k") / F.col("n_gt")).alias("_r")), totals, by)


def _levels(hits: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """AP from the precision _p and recall _r at each true positive: a level i * 0.01 has the best precision of those at or beyond it."""
    return _from_best(hits.groupBy(*by, _level(F.col("_r")).alias("_l")).agg(F.max("_p").alias("_p")), totals, by)


def _level(r: Column) -> Column:
    """The largest i of 0 to 100 with i * 0.01 <= r, by the product itself: the guess may be one off."""
    top = F.least(F.floor(r * 100) + 1, F.lit(100)).cast("int")
    at = lambda i: i.cast("double") * F.lit(0.01) <= r
    return F.when(at(top), top).when(at(top - 1), top - 1).otherwise(top - 2)


def _from_best(best: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """AP from the best precision _p of each level _l that has any: at most 101 rows a group."""
    per = best.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_l", "_p"))).alias("_m"))

    def step(s, i):
        top = F.greatest(s["best"], F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
        return F.struct(top.alias("best"), (s["sum"] + top).alias("sum"))

    total = F.aggregate(F.sequence(F.lit(100), F.lit(0), F.lit(-1)), F.struct(F.lit(0.0).alias("best"), F.lit(0.0).alias("sum")), step)["sum"]
    return totals.join(per.select(*by, (total / 101).alias("ap")), by, "left").select(*by, "n_gt", F.when(F.col("n_gt") > 0, F.coalesce("ap", F.lit(0.0))).alias("ap"))


def cumulative_envelope(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows (tp 0/1) with the true and false positives up to them, by score down, and the best precision at or beyond."""
    order = [F.desc("score"), F.asc("det_id")]
    r = running_sums(rows.withColumnRenamed("tp", "_t"), by, order, {"tp": F.col("_t"), "_n": F.lit(1).cast("long")}).withColumn("_p", F.col("tp") / F.col("_n"))
    r = blocks(r, by, order)
    part = r.groupBy(*by, "_block").agg(F.max("_p").alias("_m"))
    part = part.select(*by, "_block", F.max("_m").over(Window.partitionBy(*by).orderBy("_block").rowsBetween(1, Window.unboundedFollowing)).alias("_beyond"))
    # from the last row back, so that the frame only grows
    within = Window.partitionBy(*by, "_block").orderBy(F.asc("score"), F.desc("det_id")).rowsBetween(Window.unboundedPreceding, 0)
    return r.join(part, [*by, "_block"]).withColumns({"envelope": F.greatest(F.max("_p").over(within), "_beyond"), "fp": F.col("_n") - F.col("tp")}).drop("_t", "_n", "_p", "_block", "_beyond")


def operating(tp: Column, fp: Column, n_gt: Column, beta: float = 1.0) -> list[Column]:
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(n_gt > 0, tp / n_gt).otherwise(F.lit(0.0))
    b = beta * beta
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, (1 + b) * p * r / (b * p + r)).otherwise(F.lit(0.0)).alias("fbeta")]


def truth_totals(gt: DataFrame, by: list[str]) -> DataFrame:
    return gt.groupBy(*by).agg(F.count("*").alias("n_gt"))


def evaluate(pred: DataFrame, gt: DataFrame, steps: tuple[float, ...] = IOU_STEPS, by: list[str] | None = None) -> DataFrame:
    """Per group of `by` (classes, unless given) AP at each IoU step from one pair table at the lowest step: by, step, n_gt, ap.

    A row's rank is the same at every step, so rows are numbered once; the steps then handle only their matches. Keys beyond the class must be functions of
    the image, in both tables."""
    by = by or ["class_id"]
    keys = [*by, *[k for k in GROUP if k not in by]]
    pairs = pairs_at(pred, gt, steps[0], keys)
    grid = pairs.withColumn("step", F.explode(F.array(*[F.lit(s) for s in steps]))).filter("iou >= step")
    m = match_greedy(grid, ["step", *keys]).select("step", "det_id")
    ranks = running_sums(pred.select(*by, "det_id", "score"), by, [F.desc("score"), F.asc("det_id")], {"rank": F.lit(1).cast("long")})
    hits = m.join(ranks.select(*by, "det_id", "rank"), "det_id")
    hits = running_sums(hits, ["step", *by], [F.col("rank")], {"k": F.lit(1).cast("long")})
    totals = truth_totals(gt, by).withColumn("step", F.explode(F.array(*[F.lit(s) for s in steps]))).select("step", *by, "n_gt")
    return compact_ap(hits.select("step", *by, "rank", "k"), totals, ["step", *by])


def prefix_figures(labelled: DataFrame, gt: DataFrame, thresholds: list[float], by: list[str]) -> DataFrame:
    """by, threshold, n_gt, tp, fp, ap of the rows at or above each threshold, from one labelling: rows are numbered once, and only true positives meet the thresholds."""
    order = [F.desc("score"), F.asc("det_id")]
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    labelled = stored(labelled.select(*by, "det_id", "score", "tp"))  # read by the ordered pass, its sampling and the counts
    r = running_sums(labelled, by, order, {"rank": F.lit(1).cast("long"), "k": F.col("tp")})
    levels = F.array(*[F.lit(float(x)) for x in sorted(thresholds)])
    below = sum(((F.col("score") >= float(x)).cast("int") for x in thresholds), F.lit(0))
    whole = truth_totals(gt, by)
    # precision and recall at a true positive are the same for every threshold that it passes: the best of each level and count of thresholds is kept before the thresholds multiply it
    hits = r.filter("tp = 1").join(whole, by).filter("n_gt > 0").select(*by, _level(F.col("k") / F.col("n_gt")).alias("_l"), (F.col("k") / F.col("rank")).alias("_p"), F.coalesce(below, F.lit(0)).alias("_n"))
    best = hits.groupBy(*by, "_l", "_n").agg(F.max("_p").alias("_p")).select(*by, "_l", "_p", F.explode(F.slice(levels, F.lit(1), F.col("_n"))).alias("threshold")).groupBy(*by, "threshold", "_l").agg(F.max("_p").alias("_p"))
    totals = whole.select(*by, "n_gt", t)
    passed = labelled.select(*by, "tp", F.coalesce(below, F.lit(0)).alias("_n")).groupBy(*by, "_n").agg(F.count("*").alias("c"), F.sum("tp").alias("t"))
    counts = passed.select(*by, "c", "t", F.explode(F.slice(levels, F.lit(1), F.col("_n"))).alias("threshold")).groupBy(*by, "threshold").agg(F.sum("t").alias("tp"), F.sum("c").alias("n"))
    out = _from_best(best, totals, [*by, "threshold"]).join(counts, [*by, "threshold"], "left").na.fill(0, ["tp", "n"])
    return out.select(*by, "threshold", "n_gt", "tp", (F.col("n") - F.col("tp")).alias("fp"), "ap")


def report(pred: DataFrame, gt: DataFrame, thresholds: DataFrame | None = None, operating_threshold: float = 0.05, beta: float = 2.0, tail: tuple[int, ...] = (), images: DataFrame | None = None) -> DataFrame:
    """The whole evaluation, a row for each class and one (class_id -1) for all, one (-2) for the classes of `tail`.

    ap50, ap75, map (mean over IOU_STEPS); tp, fp, precision, recall and F-beta of a matching of the rows at or above the class's own threshold (table of
    class_id, threshold) or the operating one. Row -1: means over the classes with truth, and all false positives for each image of `images`
    (of the truth, if none is given); row -2: the tail's means."""
    least = F.lit(operating_threshold)
    at = pred.withColumn("_t", least) if thresholds is None else pred.join(thresholds.select("class_id", F.col("threshold").alias("_t")), "class_id", "left")
    lab = label(at.filter(F.col("score") >= F.coalesce("_t", least)).drop("_t"), gt, 0.5)
    steps = evaluate(pred, gt).groupBy("class_id").agg(F.max(F.when(F.col("step") == IOU_STEPS[0], F.col("ap"))).alias("ap50"), F.max(F.when(F.col("step") == IOU_STEPS[5], F.col("ap"))).alias("ap75"), F.avg("ap").alias("map"))
    counts = lab.groupBy("class_id").agg(F.sum("tp").alias("tp"), (F.count("*") - F.sum("tp")).alias("fp"))
    f = truth_totals(gt, ["class_id"]).join(counts, "class_id", "full_outer").join(steps, "class_id", "left").na.fill(0, ["n_gt", "tp", "fp"])
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1e-12))
    r = F.col("tp") / F.greatest(F.col("n_gt"), F.lit(1))
    b = beta * beta
    f = f.withColumns({"precision": p, "recall": r}).withColumn("fbeta", (1 + b) * F.col("precision") * F.col("recall") / F.greatest(b * F.col("precision") + F.col("recall"), F.lit(1e-12)))
    means = ("ap50", "ap75", "map", "precision", "recall", "fbeta")
    valid = F.col("n_gt") > 0
    n = (gt if images is None else images).select("image_id").distinct().agg(F.greatest(F.count("*"), F.lit(1)).alias("_n"))
    every = f.agg(F.sum("n_gt").alias("n_gt"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), *[F.avg(F.when(valid, F.col(c))).alias(c) for c in means]).crossJoin(F.broadcast(n))
    every = every.withColumn("fp_per_image", F.col("fp") / F.col("_n")).drop("_n").withColumn("class_id", F.lit(-1))
    out = f.withColumn("fp_per_image", F.lit(None).cast("double")).unionByName(every.select(*f.columns, "fp_per_image"))
    if tail:
        t = f.filter(F.col("class_id").isin(*tail) & valid).agg(F.sum("n_gt").alias("n_gt"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), *[F.avg(c).alias(c) for c in means])
        out = out.unionByName(t.withColumn("class_id", F.lit(-2)).withColumn("fp_per_image", F.lit(None).cast("double")).select(out.columns))
    return out


def class_figures(labelled: DataFrame, gt: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, n_gt and AP of each group."""
    totals = truth_totals(gt, by)
    labelled = stored(labelled.select(*by, "det_id", "score", "tp"))  # read by the ordered pass, its sampling and the counts
    counts = labelled.groupBy(*by).agg(F.sum("tp").alias("tp"), (F.count("*") - F.sum("tp")).alias("fp"))
    return cut(average_precision(labelled, totals, by).join(counts, by, "left").select(*by, "n_gt", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("fp", F.lit(0)).alias("fp"), "ap"))


def composite(figures: DataFrame, by: list[str]) -> DataFrame:
    """20 precision + 60 recall + 20 AP: micro precision and recall, macro AP over the classes with truth."""
    g = figures.groupBy(*by) if by else figures.groupBy()
    s = g.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("n_gt").alias("n_gt"), F.avg("ap").alias("ap50"))
    p, r, _ = operating(F.col("tp"), F.col("fp"), F.col("n_gt"))
    return s.select(*by, "tp", "fp", "n_gt", p, r, "ap50").withColumn("score", 20 * F.col("precision") + 60 * F.col("recall") + 20 * F.col("ap50"))


def sweep(labelled: DataFrame, gt: DataFrame, thresholds: list[float], by: list[str], beta: float = 1.0) -> DataFrame:
    """Figures of every group at every threshold from one labelling."""
    grid = labelled.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    s = grid.groupBy(*by, "threshold").agg(F.sum(F.when(F.col("score") >= F.col("threshold"), F.col("tp")).otherwise(0)).alias("tp"), F.count_if(F.col("score") >= F.col("threshold")).alias("n"))
    s = s.join(F.broadcast(truth_totals(gt, by)), by)
    return s.select(*by, "threshold", "tp", (F.col("n") - F.col("tp")).alias("fp"), "n_gt", *operating(F.col("tp"), F.col("n") - F.col("tp"), F.col("n_gt"), beta))


def best_threshold(swept: DataFrame, by: list[str]) -> DataFrame:
    """By F-beta, then recall, then the lower threshold."""
    return swept.groupBy(*by).agg(F.max_by(F.struct("threshold", "precision", "recall", "fbeta"), F.struct("fbeta", "recall", -F.col("threshold"))).alias("b")).select(*by, "b.*")


def best_overlap(gt: DataFrame, pred: DataFrame, same_class: bool = True) -> DataFrame:
    """gt_id with the largest IoU of any prediction of its image (null: none), of its class or of any other class."""
    from tallybox.functions.columns import BOX, iou

    p = pred.select("image_id", F.col("class_id").alias("_c"), *[F.col(c).alias("p" + c) for c in BOX])
    on = (F.col("class_id") == F.col("_c")) if same_class else (F.col("class_id") != F.col("_c"))
    return gt.join(p, "image_id").filter(on).groupBy("gt_id").agg(F.max(iou("", "p")).alias("iou"))
