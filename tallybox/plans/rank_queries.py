"""Windows, top rows, set operations, scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallybox.functions.columns import BOX, iou
from tallybox.operators import boost, crossfit, match, metrics, rank, sets, support
from tallybox.operators.fuse import GROUP, match_greedy, pairs_at
from tallybox.plans.registry import query, sql_iou



CLASSES = [f"class_{c}" for c in range(8)]
CONTEXT = {"log_w": "ln(greatest(bw/4096, 1e-8))", "log_h": "ln(greatest(bh/3000, 1e-8))", "log_area": "ln(greatest(bw/4096*(bh/3000), 1e-12))", "log_aspect": "ln(greatest(bw/bh, 1e-8))",
           "cx": "(x1+x2)/8192", "cy": "(y1+y2)/6000", "edge": "least((x1+x2)/8192, 1-(x1+x2)/8192, (y1+y2)/6000, 1-(y1+y2)/6000)"}


@query("w1_context_features", f"""WITH s AS (SELECT *, greatest(x2-x1, 1.0::DOUBLE) AS bw, greatest(y2-y1, 1.0::DOUBLE) AS bh FROM det) SELECT det_id, {', '.join(f'round({e}, 6) AS {n}' for n, e in CONTEXT.items())},
 round((row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id)-1)/greatest(count(*) OVER (PARTITION BY image_id)-1, 1), 6) AS rank_image,
 round((row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, det_id)-1)/greatest(count(*) OVER (PARTITION BY image_id, class_id)-1, 1), 6) AS rank_class,
 round(ln(count(*) OVER (PARTITION BY image_id)), 6) AS log_image, round(ln(count(*) OVER (PARTITION BY image_id, class_id)), 6) AS log_class, {', '.join(f'CASE WHEN class_id = {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS class_{c}' for c in range(8))} FROM s""")
def w1(v):
    f = support.context_features(v.det, 4096.0, 3000.0, list(range(8)))
    return f.select("det_id", *[F.round(c, 6).alias(c) for c in [*CONTEXT, "rank_image", "rank_class", "log_image", "log_class"]], *CLASSES)


@query("w2_cluster_features", f"""WITH p AS (SELECT a.det_id, count(*) FILTER ({sql_iou('a.', 'b.')} >= 0.5) AS peers, max({sql_iou('a.', 'b.')}) AS max_iou, count(*) FILTER ({sql_iou('a.', 'b.')} >= 0.5 AND b.score > a.score) AS higher FROM det a JOIN det b ON a.image_id = b.image_id AND a.class_id = b.class_id AND a.det_id <> b.det_id GROUP BY 1),
r AS (SELECT det_id, (row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, det_id)-1)/greatest(count(*) OVER (PARTITION BY image_id, class_id)-1, 1) AS rel FROM det)
SELECT r.det_id, round(ln(1+coalesce(peers, 0)), 6) AS log_peers, round(coalesce(max_iou, 0), 6) AS max_iou, coalesce(higher, 0) AS higher, coalesce(higher, 0) = 0 AS top, round(rel, 6) AS rel FROM r LEFT JOIN p USING (det_id)""")
def w2(v):
    f = support.cluster_features(v.det)
    return f.select("det_id", *[F.round(c, 6).alias(c) for c in ("log_peers", "max_iou", "rel")], "higher", "top")


METHODS = {"image_max": 0.3, "class_max": 0.3, "image_count": 0.2, "class_count": 0.2, "unsupported": 0.5, "all_supported": 0.8}
FACTORS = {"image_max": "pow(greatest(max(score) OVER (PARTITION BY image_id), 1e-12), -0.3)", "class_max": "pow(greatest(max(score) OVER (PARTITION BY image_id, class_id), 1e-12), -0.3)",
           "image_count": "pow(count(*) OVER (PARTITION BY image_id)/200.0::DOUBLE, -0.2)", "class_count": "pow(count(*) OVER (PARTITION BY image_id, class_id)/30.0::DOUBLE, -0.2)",
           "unsupported": "CASE WHEN NOT is_global AND NOT touches_edge AND model <> 'a' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END", "all_supported": "CASE WHEN is_global AND touches_edge AND model = 'a' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END"}


@query("w3_group_calibration", f"SELECT det_id, {', '.join(f'round(least(1.0::DOUBLE, greatest(1e-12, score*{e})), 6) AS {n}' for n, e in FACTORS.items())} FROM det")
def w3(v):
    d = v.det.withColumn("first_model", F.col("model") == "a")
    return d.select("det_id", *[F.round(rank.group_calibration(m, a, ("is_global", "touches_edge", "first_model")), 6).alias(m) for m, a in METHODS.items()])


@query("w4_burst_penalty", "WITH n AS (SELECT image_id, class_id, count(*) AS n FROM det GROUP BY ALL), q AS (SELECT quantile_cont(n, 0.9) AS q FROM n) SELECT det_id, round(score*pow(least(1.0, q/n), 0.7), 6) AS score FROM det JOIN n USING (image_id, class_id), q")
def w4(v):
    return rank.burst_penalty(v.det, GROUP, 0.9, 0.7).select("det_id", F.round("score", 6).alias("score"))


@query("w5_cumulative_envelope", f"WITH t AS (SELECT det_id, class_id, score, CASE WHEN EXISTS (SELECT 1 FROM gt g WHERE g.image_id = d.image_id AND g.class_id = d.class_id AND {sql_iou('d.', 'g.')} >= 0.5) THEN 1 ELSE 0 END AS tp FROM det d), c AS (SELECT det_id, class_id, score, sum(tp) OVER w AS tps, count(*) OVER w AS n FROM t WINDOW w AS (PARTITION BY class_id ORDER BY score DESC, det_id ROWS UNBOUNDED PRECEDING)) SELECT det_id, CAST(tps AS BIGINT) AS tp, CAST(n-tps AS BIGINT) AS fp, round(max(tps/n) OVER (PARTITION BY class_id ORDER BY score, det_id DESC ROWS UNBOUNDED PRECEDING), 6) AS envelope FROM c")
def w5(v):
    from tallybox.operators.fuse import pairs_at

    hit = pairs_at(v.det, v.gt, 0.5).select("det_id").distinct().withColumn("tp", F.lit(1))
    return metrics.cumulative_envelope(v.det.join(hit, "det_id", "left").withColumn("tp", F.coalesce("tp", F.lit(0))), ["class_id"]).select("det_id", "tp", "fp", F.round("envelope", 6).alias("envelope"))


@query("w6_append_below", "WITH b AS (SELECT * FROM det WHERE score >= 0.5), e AS (SELECT * FROM det WHERE score < 0.5), r AS (SELECT det_id, row_number() OVER (ORDER BY score DESC, det_id)-1 AS k, count(*) OVER () AS n FROM e) SELECT det_id, round(score, 9) AS score FROM b UNION ALL SELECT det_id, round((SELECT min(score) FROM b)*(0.49-0.48*k/n), 9) FROM r")
def w6(v):
    return rank.append_below(v.det.filter("score >= 0.5"), v.det.filter("score < 0.5"), [F.desc("score"), F.asc("det_id")]).select("det_id", F.round("score", 9).alias("score"))


@query("w7_rank_percentile", "SELECT det_id, round((rank() OVER (PARTITION BY class_id ORDER BY score)-1+(count(*) OVER (PARTITION BY class_id, score)-1)/2+0.5)/count(*) OVER (PARTITION BY class_id), 9) AS p FROM det")
def w7(v):
    return rank.with_percentile(v.det.select("det_id", "class_id", "score"), ["class_id"], "score", "p").select("det_id", F.round("p", 9).alias("p"))


@query("w8_counter_across_resumes", "WITH l AS (SELECT user_id, CAST(floor(value) AS BIGINT) % 100 AS c, lag(CAST(floor(value) AS BIGINT) % 100) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, CAST(sum(CASE WHEN p IS NULL THEN c WHEN c >= p THEN c-p ELSE c END) AS BIGINT) AS total, count(*) FILTER (c < p) AS resets FROM l GROUP BY 1")
def w8(v):
    e = v.events.withColumn("c", F.floor("value") % 100)
    return sets.counter_total(e, ["user_id"], "c", ["ts", "event_id"])


@query("w9_runtime_extrapolation", "WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, epoch(ts)-epoch(min(ts) OVER (PARTITION BY user_id)) AS elapsed FROM events) SELECT user_id, epoch AS epochs, round(elapsed, 3) AS elapsed, round(elapsed/greatest(epoch, 1)*300*1.15/3600, 6) AS hours FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY epoch DESC) = 1")
def w9(v):
    # each user's events stand for the epochs of a run
    w = Window.partitionBy("user_id")
    e = v.events.withColumn("epoch", F.row_number().over(w.orderBy("ts", "event_id")).cast("long"))
    e = e.withColumn("elapsed", F.col("ts").cast("timestamp").cast("double") - F.min(F.col("ts").cast("timestamp").cast("double")).over(w))
    out = sets.runtime_estimate(e, "user_id", "epoch", "elapsed", 300)
    return out.select("user_id", "epochs", F.round("elapsed", 3).alias("elapsed"), F.round("hours", 6).alias("hours"))


@query("k1_top_k", "SELECT det_id FROM det QUALIFY row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, det_id) <= 5")
def k1(v):
    return rank.top_k(v.det, GROUP, 5, F.desc("score"), F.asc("det_id")).select("det_id")


@query("k2_quantile_floor", "WITH q AS (SELECT class_id, quantile_cont(score, 0.1) AS f FROM det GROUP BY 1) SELECT det_id FROM det JOIN q USING (class_id) WHERE score >= f AND score >= (SELECT quantile_cont(score, 0.1) FROM det)")
def k2(v):
    return rank.quantile_floor(rank.quantile_floor(v.det, 0.1, ["class_id"]), 0.1, of=v.det).select("det_id")


@query("k3_weighted_floor", "WITH w AS (SELECT score, sum(CASE WHEN view = 'original' THEN 488 ELSE 300 END) AS w FROM det JOIN images USING (image_id) GROUP BY 1), c AS (SELECT score, sum(w) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER () AS t FROM w) SELECT min(score) AS floor FROM c WHERE c >= 0.1*t")
def k3(v):
    d = v.det.join(v.images.select("image_id", "view"), "image_id").withColumn("w", F.when(F.col("view") == "original", 488).otherwise(300))
    return rank.weighted_quantile(d, 0.1, "w")


@query("k4_unsupported_tail", f"WITH s AS (SELECT a.det_id, a.score, EXISTS (SELECT 1 FROM det_b b WHERE a.image_id = b.image_id AND a.class_id = b.class_id AND {sql_iou('a.', 'b.')} >= 0.5) AS sup FROM det_a a) SELECT det_id FROM s WHERE score >= (SELECT quantile_cont(score, 0.3) FROM s WHERE NOT sup)")
def k4(v):
    m = match.best_match(v.det_a, v.det_b, 0.5)
    return rank.quantile_floor(m, 0.3, where=F.col("match_id").isNull()).select("det_id")


@query("k5_empty_image_rescue", "WITH p AS (SELECT DISTINCT image_id FROM det WHERE score >= 0.5 AND image_id % 5 <> 0) SELECT det_id, image_id FROM det WHERE image_id NOT IN (SELECT image_id FROM p) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) <= 3")
def k5(v):
    some = v.det.filter("score >= 0.5 and image_id % 5 <> 0").select("image_id").distinct()
    return rank.top_k(v.det.join(some, "image_id", "left_anti"), ["image_id"], 3, F.desc("score"), F.asc("det_id")).select("det_id", "image_id")


@query("k6_raw_top_k", "SELECT det_id FROM det QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) <= 100")
def k6(v):
    return rank.top_k(v.det, ["image_id"], 100, F.desc("score"), F.asc("det_id")).select("det_id")


@query("u1_union_views", "SELECT image_id, count(*) AS n FROM (SELECT image_id FROM det_a UNION ALL SELECT image_id FROM det_b UNION ALL SELECT image_id FROM det WHERE is_global) GROUP BY 1")
def u1(v):
    return v.det_a.unionByName(v.det_b).unionByName(v.det.filter("is_global").select(v.det_a.columns)).groupBy("image_id").agg(F.count("*").alias("n"))


@query("u2_bag_difference", "WITH a AS (SELECT image_id, class_id, score FROM det WHERE score >= 0.3), b AS (SELECT image_id, class_id, score FROM det WHERE score < 0.6) SELECT 'a' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'b', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def u2(v):
    c = ["image_id", "class_id", "score"]
    return sets.bag_difference(v.det.filter("score >= 0.3").select(c), v.det.filter("score < 0.6").select(c))


@query("u3_split_leakage", "SELECT image_id, class_id FROM det WHERE model = 'a' INTERSECT SELECT image_id, class_id FROM det WHERE model = 'b'")
def u3(v):
    return v.det_a.select(*GROUP).intersect(v.det_b.select(*GROUP))


@query("u4_missing_ids", "SELECT image_id FROM images EXCEPT SELECT image_id FROM det WHERE score > 0.995")
def u4(v):
    return v.images.select("image_id").exceptAll(v.det.filter("score > 0.995").select("image_id").distinct())


@query("u5_addon_append", """WITH r AS (SELECT *, CASE WHEN class_id NOT IN (1, 2) THEN 'class' WHEN score < 0.4 THEN 'threshold' WHEN x2 > 2900 THEN 'box' WHEN image_id % 11 = 0 THEN 'image' END AS reason FROM det_b), d AS (SELECT *, row_number() OVER (PARTITION BY image_id, class_id, x1, y1, x2, y2 ORDER BY score DESC, det_id) AS k FROM r WHERE reason IS NULL),
x AS (SELECT reason FROM r WHERE reason IS NOT NULL UNION ALL SELECT CASE WHEN k > 1 OR EXISTS (SELECT 1 FROM det_a a WHERE a.image_id = d.image_id AND a.class_id = d.class_id AND a.x1 = d.x1 AND a.y1 = d.y1 AND a.x2 = d.x2 AND a.y2 = d.y2) THEN 'duplicate' ELSE 'added' END FROM d) SELECT reason, count(*) AS n FROM x GROUP BY 1""")
def u5(v):
    reason = F.when(~F.col("class_id").isin(1, 2), "class").when(F.col("score") < 0.4, "threshold").when(F.col("x2") > 2900, "box").when(F.col("image_id") % 11 == 0, "image")
    return sets.addon_append(v.det_a, v.det_b, reason)[1]


@query("l1_geometric_blend", "SELECT a.det_id, round(pow(greatest(score, 1e-12), 1-b)*pow(greatest(score/2+0.1, 1e-12), b), 6) AS score FROM (SELECT det_id, score, CASE class_id WHEN 1 THEN 0.8::DOUBLE WHEN 3 THEN 0.0::DOUBLE ELSE 0.35::DOUBLE END AS b FROM det) a")
def l1(v):
    w = F.when(F.col("class_id") == 1, 0.8).when(F.col("class_id") == 3, 0.0).otherwise(0.35)
    return v.det.select("det_id", F.round(rank.geometric_blend(F.col("score"), F.col("score") / 2 + 0.1, w), 6).alias("score"))


@query("l2_logit_shift", "SELECT det_id, round(1/(1+exp(-least(greatest(ln(p/(1-p))+0.7*(class_id-3), -40), 40))), 6) AS score FROM (SELECT det_id, class_id, least(greatest(score, 1e-12), 1-1e-12) AS p FROM det)")
def l2(v):
    return v.det.select("det_id", F.round(rank.logit_shift(F.col("score"), F.col("class_id") - 3, 0.7), 6).alias("score"))


@query("l3_context_rescore", "SELECT det_id, round(score*pow(greatest(1e-4, (image_id % 10)/10), CASE WHEN view = 'grid' THEN 0.5 ELSE 0.2 END), 6) AS score FROM det JOIN images USING (image_id)")
def l3(v):
    c = v.images.select("image_id", ((F.col("image_id") % 10) / 10).alias("p"), F.when(F.col("view") == "grid", 0.5).otherwise(0.2).alias("w"))
    return v.det.join(c, "image_id").select("det_id", F.round(F.col("score") * F.pow(F.greatest(F.lit(1e-4), F.col("p")), F.col("w")), 6).alias("score"))


@query("l4_linear_sigmoid", "SELECT det_id, round(1/(1+exp(-least(greatest(-0.5+(score-0.5)/0.3*2.0+(class_id-3.5)/2.3*(-0.4), -40), 40))), 6) AS score FROM det")
def l4(v):
    return v.det.select("det_id", F.round(rank.linear_sigmoid({"score": (0.5, 0.3, 2.0), "class_id": (3.5, 2.3, -0.4)}, -0.5), 6).alias("score"))


@query("l5_balanced_weights", "WITH d AS (SELECT det_id, class_id, model FROM det), g AS (SELECT *, count(*) OVER (PARTITION BY class_id, model) AS n, count(*) OVER () AS t FROM d), k AS (SELECT count(*) AS k FROM (SELECT DISTINCT class_id, model FROM d)) SELECT det_id, round(t/(n*k), 6) AS weight FROM g, k")
def l5(v):
    return crossfit.balanced(v.det, ["class_id", "model"]).select("det_id", F.round("weight", 6).alias("weight"))


@query("l6_group_robust_weights", "WITH d AS (SELECT det.det_id, class_id, grp FROM det JOIN images USING (image_id)), n AS (SELECT class_id, grp, count(*) AS n FROM d GROUP BY ALL), k AS (SELECT class_id, count(*) AS k FROM n GROUP BY 1) SELECT det_id, round(1.0/k/n, 9) AS weight FROM d JOIN n USING (class_id, grp) JOIN k USING (class_id)")
def l6(v):
    d = v.det.join(v.images.select("image_id", "grp"), "image_id")
    return crossfit.group_robust(d, "class_id", "grp").select("det_id", F.round("weight", 9).alias("weight"))


@query("l7_scaler", "WITH s AS (SELECT class_id, avg(score) AS m, greatest(stddev_pop(score), 1e-6) AS s FROM det GROUP BY 1) SELECT det_id, round((score-m)/s, 6) AS z FROM det JOIN s USING (class_id)")
def l7(v):
    return crossfit.scaled(v.det, ["class_id"], ["score"]).select("det_id", F.round("score_z", 6).alias("z"))


@query("l8_constrained_logistic")
def l8(v):
    return crossfit.constrained_logistic(features(v), ["score", "n_peers", "log_area"], "label", "weight", [0.0, None, None])


@query("l9_crossfit_scores")
def l9(v):
    d = features(v).withColumn("fold", (F.col("grp_no") % 3).cast("int"))
    return boost.crossfit_by_class(d, ["score", "n_peers", "log_area"], "label", "class_id", "fold", "grp_no", 3, boost.Settings(rounds=8))


@query("l10_iou_ranker")
def l10(v):
    d = features(v).withColumn("fold", (F.col("grp_no") % 3).cast("int"))
    out = crossfit.out_of_fold(d, ["score", "n_peers", "log_area"], "target", "weight", 3, "regressor")
    return out.withColumn("blend", rank.geometric_blend(F.col("score"), F.col("prediction"), 0.5))


@query("l11_beta_policy")
def l11(v):
    d = features(v).withColumn("fold", (F.col("grp_no") % 3).cast("int"))
    oof = crossfit.out_of_fold(d, ["score", "n_peers", "log_area"], "target", "weight", 3, "regressor")
    view = v.images.select("image_id", "view")
    hit = match_greedy(pairs_at(v.det, v.gt, 0.5)).select("det_id", F.lit(1).alias("tp"))
    lab = oof.join(hit, "det_id", "left").na.fill(0, ["tp"]).join(view, "image_id")
    return crossfit.beta_sweep(lab, metrics.truth_totals(v.gt.join(view, "image_id"), ["view", "class_id"]), [0.0, 0.2, 0.4, 0.6], {"original": 488 / 788, "grid": 300 / 788})


@query("l12_family_weights", "SELECT det_id, CASE WHEN image_id % 37 < 10 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM det")
def l12(v):
    return v.det.select("det_id", F.when(F.col("image_id") % 37 < 10, 2.0).otherwise(1.0).alias("weight"))


@query("l13_matched_subset")
def l13(v):
    s = v.det.groupBy("image_id").agg(F.avg("score").alias("f1"), F.count("*").cast("double").alias("f2"))
    return crossfit.matched_subset(s.filter("image_id % 4 = 0"), s.filter("image_id % 4 <> 0"), "image_id", ["f1", "f2"])


def features(v):
    # the truths of an image and class come to its boxes as one row, and the peers are counted where the boxes then are: they move once
    t = v.gt.groupBy(*GROUP).agg(F.collect_list(F.struct(*BOX)).alias("_t"))
    own = F.struct(*BOX)
    d = v.det.select("det_id", *GROUP, *BOX, "score").join(t, GROUP, "left").withColumn("i", F.array_max(F.transform("_t", lambda g: iou(own, g)))).drop("_t")
    d = d.withColumn("label", (F.coalesce("i", F.lit(0.0)) >= 0.5).cast("double")).withColumn("target", F.greatest(F.lit(0.0), (F.coalesce("i", F.lit(0.0)) - 0.25) / 0.75))
    d = d.withColumn("n_peers", F.count("*").over(Window.partitionBy(*GROUP)).cast("double")).withColumn("log_area", F.ln(F.greatest((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), F.lit(1.0))))
    return d.withColumn("weight", F.lit(1.0)).withColumn("grp_no", F.col("image_id") % 37).select("det_id", "image_id", "class_id", "score", "n_peers", "log_area", "label", "target", "weight", "grp_no")
