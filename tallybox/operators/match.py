"""Joins of box tables, coverage, error kinds, gates and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybox.functions.columns import BOX, iou
from tallybox.operators.fuse import GROUP


def _other(df: DataFrame, keys: list[str], id_col: str = "det_id", prefix: str = "o_") -> DataFrame:
    return df.select(*keys, F.col(id_col).alias("other_id"), *[F.col(c).alias(prefix + c) for c in BOX], *([F.col("score").alias(prefix + "score")] if "score" in df.columns else []))


def best_match(base: DataFrame, other: DataFrame, floor: float, keys: list[str] | None = None, id_col: str = "det_id") -> DataFrame:
    """Each base row with its partner of highest IoU of at least `floor` (ties: lowest id), else nulls. Columns match_id, match_iou,
    match_score, m_x1 .. m_y2 are added."""
    keys = keys or GROUP
    p = base.select(id_col, *keys, *BOX).join(_other(other, keys, id_col), keys).withColumn("iou", iou("", "o_")).filter(F.col("iou") >= floor)
    best = p.groupBy(id_col).agg(F.max_by(F.struct("other_id", "iou", "o_score", *["o_" + c for c in BOX]), F.struct("iou", -F.col("other_id"))).alias("b"))
    return base.join(best, id_col, "left").select(*base.columns, F.col("b.other_id").alias("match_id"), F.col("b.iou").alias("match_iou"), F.col("b.o_score").alias("match_score"), *[F.col(f"b.o_{c}").alias("m_" + c) for c in BOX])


def support_features(matched: DataFrame) -> DataFrame:
    """present, iou, log score and log advantage of the partner; an absent one scores 1e-12."""
    s, b = F.coalesce("match_score", F.lit(0.0)), F.greatest("score", F.lit(1e-12))
    s = F.greatest(s, F.lit(1e-12))
    return matched.select("det_id", F.col("match_id").isNotNull().cast("int").alias("present"), F.coalesce("match_iou", F.lit(0.0)).alias("iou"), F.ln(s).alias("log_score"), (F.ln(s) - F.ln(b)).alias("log_advantage"))


def transfer_scores(matched: DataFrame, mode: str, boost: float = 1.1) -> Column:
    """The score of a base row given its partner: boost, geometric raise, max raise or probability union."""
    s, o = F.col("score"), F.col("match_score")
    new = {"boost": F.least(F.lit(1.0), s * boost), "geometric": F.greatest(s, F.sqrt(s * o)), "max": F.greatest(s, o), "union": 1 - (1 - s) * (1 - o)}[mode]
    return F.when(F.col("match_id").isNotNull(), new).otherwise(s)


def fuse_locations(matched: DataFrame) -> DataFrame:
    """Boxes moved to the score-weighted mean with the partner; the rows stay."""
    w = F.greatest(F.col("score") + F.col("match_score"), F.lit(1e-12))
    return matched.select("det_id", *[F.when(F.col("match_id").isNull(), F.col(c)).otherwise((F.col(c) * F.col("score") + F.col("m_" + c) * F.col("match_score")) / w).alias(c) for c in BOX], "score")


def miss_taxonomy(gt: DataFrame, pred: DataFrame) -> DataFrame:
    from tallybox.operators.metrics import best_overlap

    same, other = best_overlap(gt, pred).withColumnRenamed("iou", "same"), best_overlap(gt, pred, False).withColumnRenamed("iou", "other")
    kind = F.when(F.col("same") >= 0.5, "covered").when(F.col("same") >= 0.1, "poor_localization").when(F.col("other") >= 0.5, "wrong_class").otherwise("missing_candidate")
    return gt.join(same, "gt_id", "left").join(other, "gt_id", "left").withColumn("kind", kind)


def top_errors(labelled: DataFrame, gt: DataFrame, n: int) -> DataFrame:
    """The kind of each of a class's top n rows, with its size over that of the best truth of its class (width_ratio, height_ratio)."""
    from tallybox.session import cut

    top = cut(labelled.withColumn("_r", F.row_number().over(Window.partitionBy("class_id").orderBy(F.desc("score"), "det_id"))).filter(F.col("_r") <= n))
    g = gt.select("image_id", F.col("class_id").alias("_c"), F.col("gt_id").alias("_g"), *[F.col(c).alias("g" + c) for c in BOX])
    i, own = iou("", "g"), F.col("class_id") == F.col("_c")
    nearest = F.max_by(F.struct((F.col("gx2") - F.col("gx1")).alias("w"), (F.col("gy2") - F.col("gy1")).alias("h")), F.when(own, F.struct(i, -F.col("_g"))))
    o = top.join(g, "image_id").groupBy("det_id").agg(F.max(F.when(own, i)).alias("same"), F.max(F.when(~own, i)).alias("other"), nearest.alias("_n"))
    kind = F.when(F.col("tp") == 1, "tp").when(F.col("same") >= 0.5, "duplicate").when(F.col("other") >= 0.5, "wrong_class").when(F.col("same") >= 0.1, "localization").otherwise("background")
    ratios = {"width_ratio": (F.col("x2") - F.col("x1")) / F.col("_n.w"), "height_ratio": (F.col("y2") - F.col("y1")) / F.col("_n.h")}
    return top.join(o, "det_id", "left").withColumns({"kind": kind, **ratios}).drop("_n")


def error_summary(errors: DataFrame) -> DataFrame:
    """class_id, kind, n, and for localisation errors the median width and height ratios."""
    from tallybox.operators.audit import percentiles

    counts = errors.groupBy("class_id", "kind").agg(F.count("*").alias("n"))
    m = percentiles(errors.filter("kind = 'localization'"), ["class_id"], ["width_ratio", "height_ratio"], [50]).groupBy("class_id").agg(*[F.max(F.when(F.col("measure") == c, F.col("p50"))).alias(c) for c in ("width_ratio", "height_ratio")])
    return counts.join(m.withColumn("kind", F.lit("localization")), ["class_id", "kind"], "left")


def model_coverage(gt: DataFrame, pred: DataFrame, threshold: float) -> DataFrame:
    """gt with booleans a and b: hit by a model of that name."""
    p = pred.select(*GROUP, "model", *[F.col(c).alias("p" + c) for c in BOX])
    hit = gt.join(p, GROUP).filter(iou("", "p") >= threshold).groupBy("gt_id").agg(F.bool_or(F.col("model") == "a").alias("a"), F.bool_or(F.col("model") == "b").alias("b"))
    no = F.lit(False)
    return gt.join(hit, "gt_id", "left").withColumns({"a": F.coalesce("a", no), "b": F.coalesce("b", no)})


def recall_bound(gt: DataFrame, pred: DataFrame, policies: DataFrame, threshold: float, quantiles: list[int] = [0, 1, 2, 5, 10, 25, 50, 100]) -> DataFrame:  # noqa: B006
    """What policies could cover at best. policies: policy, sx, sy, dx, dy, a row for each transformed box that a policy emits.

    Rows (policy, part, key, n, total, value): `recall` and, by class, `class`: truth that a box of its class covers, of all; `confusion`, key `source->target`: truth that no box of its class
    covers, by the class whose box covers it best; `quantile`: of the largest IoU with a box of the class."""
    from tallybox.functions.columns import scale
    from tallybox.operators.audit import percentiles

    from tallybox.session import stored

    # boxes and truths meet by image before the policies multiply them; only boxes that touch count, so nothing is shuffled or summed for the rest
    p = pred.select("image_id", F.col("class_id").alias("_c"), *[F.col(c).alias("d" + c) for c in BOX])
    j = gt.select("image_id", "gt_id", "class_id", *BOX).join(p, "image_id").join(F.broadcast(policies))  # a few rows
    j = j.withColumn("b", scale("d", F.col("sx"), F.col("sy"), F.col("dx"), F.col("dy"))).withColumns({"p" + c: F.col(f"b.{c}") for c in BOX})
    j = j.filter((F.col("px1") < F.col("x2")) & (F.col("px2") > F.col("x1")) & (F.col("py1") < F.col("y2")) & (F.col("py2") > F.col("y1")))
    each = j.groupBy("image_id", "policy", "gt_id", "class_id", "_c").agg(F.max(iou("", "p")).alias("i"))
    best = each.groupBy("image_id", "policy", "gt_id").agg(F.max(F.when(F.col("_c") == F.col("class_id"), F.col("i"))).alias("own"), F.max(F.struct("i", (-F.col("_c")).alias("_c"))).alias("any"))
    best = best.select("policy", "gt_id", "own", F.struct((-F.col("any._c")).alias("_c"), F.col("any.i").alias("i")).alias("any"))
    every = gt.select("gt_id", "class_id").join(F.broadcast(policies.select("policy").distinct())).join(best, ["policy", "gt_id"], "left")
    every = stored(every.select("policy", "class_id", F.coalesce("own", F.lit(0.0)).alias("own"), "any").withColumn("hit", F.col("own") >= threshold))
    row = lambda part, key, n, total, value: [F.lit(part).alias("part"), key.cast("string").alias("key"), n.cast("long").alias("n"), total.cast("long").alias("total"), value.cast("double").alias("value")]
    none = F.lit(None)
    counts = every.groupBy("policy", "class_id").agg(F.count_if("hit").alias("n"), F.count("*").alias("t"))
    out = counts.groupBy("policy").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).select("policy", *row("recall", F.lit(""), F.col("n"), F.col("t"), none))
    out = out.union(counts.select("policy", *row("class", F.col("class_id"), F.col("n"), F.col("t"), none)))
    lost = every.filter(~F.col("hit") & (F.col("any.i") >= threshold)).groupBy("policy", F.concat_ws("->", F.col("any._c").cast("string"), F.col("class_id").cast("string")).alias("key")).agg(F.count("*").alias("n"))
    out = out.union(lost.select("policy", *row("confusion", F.col("key"), F.col("n"), none, none)))
    q = percentiles(every, ["policy"], ["own"], quantiles)
    q = q.select("policy", F.explode(F.array(*[F.struct(F.lit(f"q{x:02d}").alias("key"), F.col(f"p{x}").alias("v")) for x in quantiles])).alias("q"))
    return out.union(q.select("policy", *row("quantile", F.col("q.key"), none, none, F.col("q.v"))))


def greedy_cover(gt: DataFrame, emitted: DataFrame, threshold: float, target: float = 0.95) -> DataFrame:
    """Actions in the order of gain (truth newly covered) per emitted box, until the target recall or no gain: round, action, gain, cost, recall. Ties: larger gain,
    smaller cost, smaller action.

    What an action covers is bitmaps, one for each 32,768 truths. A gain is a count of bits of the union with those of the actions taken, an aggregation without a join;
    gains only shrink, so an action is counted again only when it comes first. The driver holds a figure for each action."""
    from tallybox.operators.order import row_numbers
    from tallybox.session import stored

    spark = gt.sparkSession
    numbered = row_numbers(gt, [F.col("gt_id")], "_n").withColumn("_n", F.col("_n") - 1)
    e = emitted.select(*GROUP, "action", *[F.col(c).alias("p" + c) for c in BOX])
    hits = numbered.join(e, GROUP).filter(iou("", "p") >= threshold).select("action", F.bitmap_bucket_number("_n").alias("bucket"), F.bitmap_bit_position("_n").alias("bit"))
    maps = stored(hits.groupBy("action", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))
    cost = {r["action"]: r["n"] for r in emitted.groupBy("action").agg(F.count("*").alias("n")).collect()}
    total, covered, chosen = gt.count(), 0, []
    rank = lambda a: (gain[a] / max(cost[a], 1), gain[a], -cost[a], -a)

    def union(actions: list) -> int:
        m = maps.filter(F.col("action").isin(actions)).groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("c"))
        return m.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c")).first()["c"]

    gain = {r["action"]: r["n"] for r in maps.groupBy("action").agg(F.sum(F.bitmap_count("bits")).alias("n")).collect()}
    fresh = set(gain)
    while gain and covered < target * total:
        best = max(gain, key=rank)
        if best not in fresh:
            gain[best] = union([*[c[1] for c in chosen], best]) - covered
            fresh.add(best)
            continue
        if not gain[best]:
            break
        covered += gain[best]
        chosen.append((len(chosen), int(best), int(gain.pop(best)), int(cost[best]), covered / total))
        fresh = set()
    return spark.createDataFrame(chosen, "round int, action int, gain long, cost long, recall double")


def route_search(options: DataFrame, starts: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75)) -> DataFrame:
    """class_id, variant, threshold, score: for each class the source and threshold that together maximise 20 precision + 60 recall + 20 mean AP.

    options: class_id, variant, threshold, tp, fp, n_gt, ap: a row for each choice, a number that the data do not change. One class at a time is set to its best choice (of equal ones the lower
    threshold, then the smaller variant) until nothing changes, from each variant at each of `starts` (shares of its thresholds); the best end is kept."""
    spark = options.sparkSession
    table: dict[int, list] = {}
    for r in options.select("class_id", "variant", "threshold", "tp", "fp", "n_gt", "ap").collect():
        table.setdefault(r["class_id"], []).append(r)
    if not table:
        return spark.createDataFrame([], "class_id int, variant string, threshold double, score double")
    classes = sorted(table)
    for c in classes:
        table[c].sort(key=lambda r: (r["threshold"], str(r["variant"])))

    def score(pick: dict) -> float:
        rows = [table[c][k] for c, k in pick.items()]
        tp, fp, n = (sum(r[x] for r in rows) for x in ("tp", "fp", "n_gt"))
        return 20 * tp / max(tp + fp, 1) + 60 * tp / max(n, 1) + 20 * sum(r["ap"] or 0.0 for r in rows) / len(rows)

    best, best_score = None, -1.0
    for variant in sorted({str(r["variant"]) for rows in table.values() for r in rows}):
        for share in starts:
            own = {c: [k for k, r in enumerate(table[c]) if str(r["variant"]) == variant] or [0] for c in classes}
            at = {c: k[int(share * (len(k) - 1))] for c, k in own.items()}
            now = score(at)
            while True:
                before = dict(at)
                for c in classes:
                    tried = [(score(at | {c: k}), -k) for k in range(len(table[c]))]
                    top = max(tried)
                    if top[0] > now + 1e-12 or (top[0] >= now - 1e-12 and -top[1] < at[c]):
                        at[c], now = -top[1], top[0]
                if at == before:
                    break
            if now > best_score + 1e-12:
                best, best_score = at, now
    return spark.createDataFrame([(int(c), str(table[c][k]["variant"]), float(table[c][k]["threshold"]), best_score) for c, k in sorted(best.items())], "class_id int, variant string, threshold double, score double")


#: What a release has to reach, over its control.
GATES = {"weighted_gain": 0.20, "score_gain": 0.10, "map50_gain": 0.005, "map75_gain": 0.005, "map_gain": 0.0, "recall_drop": 0.002, "fp_ratio": 1.05, "class_drop": 0.02}


def release_gates(control: DataFrame, new: DataFrame, control_classes: DataFrame, new_classes: DataFrame, weights: dict[str, float], limits: dict[str, float] | None = None, different: DataFrame | None = None) -> DataFrame:
    """(view, gate, figure) for every gate that the new figures fail.

    Figures by view: view, score, map50, map75, map, recall, fp_per_image; classes: view, class_id, ap50. Gates by view: score, map50, map75, map (gains), recall (drop), fp_ratio, class_ap50 (the
    largest drop of a class); of all views, in their weighted mean (view `all`), weighted_score; and membership, if `different` (a column n, one row) is not 0."""
    g = GATES | (limits or {})
    figures = ["score", "map50", "map75", "map", "recall", "fp_per_image"]
    d = control.select("view", *[F.col(c).alias("c_" + c) for c in figures]).join(new.select("view", *figures), "view")
    drop = new_classes.select("view", "class_id", F.col("ap50").alias("n")).join(control_classes.select("view", "class_id", F.col("ap50").alias("c")), ["view", "class_id"]).groupBy("view").agg(F.min(F.col("n") - F.col("c")).alias("worst"))
    d = d.join(drop, "view", "left")
    gain = lambda c: F.col(c) - F.col("c_" + c)
    ratio = F.when(F.col("c_fp_per_image") > 0, F.col("fp_per_image") / F.col("c_fp_per_image")).when(F.col("fp_per_image") == 0, 1.0).otherwise(float("inf"))
    tests = [("score", gain("score"), gain("score") < g["score_gain"]), ("map50", gain("map50"), gain("map50") < g["map50_gain"]), ("map75", gain("map75"), gain("map75") < g["map75_gain"]), ("map", gain("map"), gain("map") < g["map_gain"]),
             ("recall", gain("recall"), gain("recall") < -g["recall_drop"]), ("fp_ratio", ratio, ratio > g["fp_ratio"]), ("class_ap50", F.col("worst"), F.coalesce("worst", F.lit(0.0)) < -g["class_drop"])]
    failed = d.select("view", F.explode(F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(n).alias("gate"), v.cast("double").alias("figure"))) for n, v, bad in tests]))).alias("f")).select("view", "f.*")
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("view")]
    whole = d.agg(F.sum(weight * gain("score")).alias("figure")).filter(F.col("figure") < g["weighted_gain"])
    failed = failed.union(whole.select(F.lit("all"), F.lit("weighted_score"), "figure"))
    if different is not None:
        failed = failed.union(different.filter("n <> 0").select(F.lit("all"), F.lit("membership"), F.col("n").cast("double")))
    return failed


def best_candidate(figures: DataFrame, name: str, weights: dict[str, float], baseline=None, least_map_gain: float = 0.0, most_recall_drop: float = 0.0, recall_first: bool = False) -> DataFrame:
    """One row: the best of the candidates by their figures in each view (name, view, score, precision, recall, map50, rows).

    Eligible are, if a baseline candidate is named, those that gain `least_map_gain` in map50 and lose `most_recall_drop` of recall at most in every view. Order: weighted score, then the worst view's score, precision, fewer rows,
    the smaller name; with `recall_first` weighted recall and map50 come before all."""
    f = figures
    if baseline is not None:
        b = figures.filter(F.col(name) == baseline).select("view", F.col("map50").alias("_m"), F.col("recall").alias("_r"))
        good = f.join(b, "view").groupBy(name).agg(F.bool_and((F.col("map50") >= F.col("_m") + least_map_gain) & (F.col("recall") >= F.col("_r") - most_recall_drop)).alias("_ok")).filter("_ok")
        f = f.join(good.select(name), name, "left_semi")
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("view")]
    mean = lambda c: F.round(F.sum(weight * F.col(c)), 9).alias(c)
    s = f.groupBy(name).agg(mean("score"), F.round(F.min("score"), 9).alias("worst"), mean("precision"), mean("recall"), mean("map50"), F.sum("rows").alias("rows"))
    first = [F.col("recall"), F.col("map50")] if recall_first else []
    return s.agg(F.max_by(F.struct(*s.columns), F.struct(*[c.alias(f"_{i}") for i, c in enumerate([*first, F.col("score"), F.col("worst"), F.col("precision"), -F.col("rows"), -F.col(name)])])).alias("b")).select("b.*")
