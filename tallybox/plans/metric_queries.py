"""Matching and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybox.functions.columns import BOX, IOU_STEPS, iou
from tallybox.operators import fuse, match, metrics
from tallybox.operators.order import running_sums
from tallybox.plans.registry import query, sql_iou, sql_match, sql_nms
from tallybox.session import cut as checkpointed
from tallybox.session import stored

G = ["class_id"]


def kept(v):
    return stored(fuse.nms(v.det.select("det_id", "image_id", "class_id", *BOX, "score"), 0.5))


def labelled(v, threshold=0.5):
    return metrics.label(v.det, v.gt, threshold)


M = f"m AS ({sql_match('det', 'gt', 0.5)})"
L = f"{M}, lab AS (SELECT det.*, m.gt_id, CASE WHEN m.gt_id IS NULL THEN 0 ELSE 1 END AS tp FROM det LEFT JOIN m USING (det_id))"


def sql_ap(lab: str, totals: str, by: str, weight: str = "1.0::DOUBLE", tag: str = "") -> str:
    """CTEs ap(by, n_gt, ap) by the definition: the best precision at or beyond each of 101 recall levels. `tag` ends the CTEs' names."""
    on = " AND ".join(f"c.{k.strip()} = t.{k.strip()}" for k in by.split(","))
    tby = ", ".join("t." + k.strip() for k in by.split(","))
    return f"""cum{tag} AS (SELECT {by}, tp, sum({weight}) OVER w AS alln, sum({weight}*tp) OVER w AS hit FROM {lab} WINDOW w AS (PARTITION BY {by} ORDER BY score DESC, det_id ROWS UNBOUNDED PRECEDING)),
tot{tag} AS ({totals}),
lev{tag} AS (SELECT {tby}, t.n_gt, i, max(CASE WHEN c.hit/t.n_gt >= i::DOUBLE*0.01::DOUBLE THEN c.hit/greatest(c.alln, 1e-12) END) AS p FROM tot{tag} t CROSS JOIN range(0, 101) r(i) LEFT JOIN cum{tag} c ON {on} AND c.tp = 1 GROUP BY ALL),
ap{tag} AS (SELECT {by}, n_gt, sum(coalesce(p, 0))/101 AS ap FROM lev{tag} GROUP BY ALL)"""


TOT = "SELECT class_id, count(*) AS n_gt FROM gt GROUP BY 1"
AP = sql_ap("lab", TOT, "class_id")
FIG = f"""{L}, {AP}, cnt AS (SELECT class_id, sum(tp) AS tp, count(*)-sum(tp) AS fp FROM lab GROUP BY 1), fig AS (SELECT ap.class_id, ap.n_gt, coalesce(cnt.tp, 0) AS tp, coalesce(cnt.fp, 0) AS fp, ap.ap FROM ap LEFT JOIN cnt USING (class_id))"""
PR = "CASE WHEN tp+fp > 0 THEN tp/(tp+fp) ELSE 0.0::DOUBLE END"
RE = "CASE WHEN n_gt > 0 THEN tp/n_gt ELSE 0.0::DOUBLE END"


def sql_f(beta: float) -> str:
    b = beta * beta
    return f"CASE WHEN precision+recall > 0 THEN (1+{b})*precision*recall/({b}*precision+recall) ELSE 0.0::DOUBLE END"


@query("m1_match_greedy", f"WITH {M} SELECT det_id, gt_id FROM m")
def m1(v):
    return fuse.match_greedy(fuse.pairs_at(v.det, v.gt, 0.5)).select("det_id", "gt_id")


@query("m2_match_voc", f"""WITH p AS (SELECT d.det_id, g.gt_id, d.score, {sql_iou('d.', 'g.')} AS i FROM det d JOIN gt g ON d.image_id = g.image_id AND d.class_id = g.class_id),
b AS (SELECT det_id, gt_id, score FROM p WHERE i >= 0.5 QUALIFY row_number() OVER (PARTITION BY det_id ORDER BY i DESC, gt_id) = 1)
SELECT det_id, gt_id FROM b QUALIFY row_number() OVER (PARTITION BY gt_id ORDER BY score DESC, det_id) = 1""")
def m2(v):
    return fuse.match_voc(fuse.pairs_at(v.det, v.gt, 0.5)).select("det_id", "gt_id")


@query("m3_average_precision", f"WITH {L}, {AP} SELECT class_id, n_gt, round(ap, 6) AS ap FROM ap")
def m3(v):
    return metrics.average_precision(labelled(v), metrics.truth_totals(v.gt, G), G).withColumn("ap", F.round("ap", 6))


@query("m4_compact_ap", f"""WITH {L}, r AS (SELECT class_id, tp, row_number() OVER (PARTITION BY class_id ORDER BY score DESC, det_id) AS rank FROM lab),
h AS (SELECT class_id, rank, row_number() OVER (PARTITION BY class_id ORDER BY rank) AS k FROM r WHERE tp = 1), tot AS ({TOT}),
lev AS (SELECT t.class_id, i, max(CASE WHEN h.k/t.n_gt >= i::DOUBLE*0.01::DOUBLE THEN h.k/h.rank END) AS p FROM tot t CROSS JOIN range(0, 101) q(i) LEFT JOIN h ON h.class_id = t.class_id GROUP BY ALL)
SELECT class_id, round(sum(coalesce(p, 0))/101, 6) AS ap FROM lev GROUP BY 1""")
def m4(v):
    # from the ranks of the positives alone
    order = [F.desc("score"), F.asc("det_id")]
    r = running_sums(labelled(v).select("class_id", "score", "det_id", "tp"), G, order, {"rank": F.lit(1).cast("long"), "k": F.col("tp")}).filter("tp = 1")
    return metrics.compact_ap(r, metrics.truth_totals(v.gt, G), G).select("class_id", F.round("ap", 6).alias("ap"))


@query("m5_weighted_ap", f"WITH {L}, lw AS (SELECT *, CASE WHEN image_id % 3 = 0 THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END AS wt FROM lab), {sql_ap('lw', 'SELECT class_id, sum(CASE WHEN image_id % 3 = 0 THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END) AS n_gt FROM gt GROUP BY 1', 'class_id', 'wt')} SELECT class_id, round(ap, 6) AS ap FROM ap")
def m5(v):
    wt = F.when(F.col("image_id") % 3 == 0, 0.5).otherwise(0.75)
    totals = v.gt.groupBy("class_id").agg(F.sum(wt).alias("n_gt"))
    return metrics.average_precision(labelled(v).withColumn("wt", wt), totals, G, "wt").select("class_id", F.round("ap", 6).alias("ap"))


@query("m6_operating", f"WITH {FIG}, o AS (SELECT class_id, {PR} AS precision, {RE} AS recall FROM fig) SELECT class_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round({sql_f(2)}, 6) AS fbeta FROM o")
def m6(v):
    f = metrics.class_figures(labelled(v), v.gt, G)
    f = f.select("class_id", *metrics.operating(F.col("tp"), F.col("fp"), F.col("n_gt"), 2.0))
    return f.select("class_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "fbeta")])


STEPS = "(VALUES " + ", ".join(f"({x}::DOUBLE)" for x in IOU_STEPS) + ") AS s(step)"


@query("m7_evaluate", f"""WITH ds AS (SELECT step, det.* FROM det, {STEPS}), pp AS (SELECT p.step, p.image_id, p.class_id, p.det_id, any_value(p.score) AS score, list(g.gt_id ORDER BY {sql_iou('p.', 'g.')} DESC, g.gt_id) AS c
 FROM ds p JOIN gt g ON p.image_id = g.image_id AND p.class_id = g.class_id WHERE {sql_iou('p.', 'g.')} >= p.step GROUP BY ALL),
mm AS (SELECT step, list_reduce(list_prepend([{{'d': -1::BIGINT, 'c': [-1::BIGINT], 'g': NULL::BIGINT}}], list_transform(list({{'d': det_id, 'c': c, 'g': NULL::BIGINT}} ORDER BY score DESC, det_id), lambda x: [x])), lambda acc, x: list_concat(acc, [{{'d': x[1].d, 'c': x[1].c, 'g': list_filter(x[1].c, lambda c: NOT list_contains(list_transform(acc, lambda a: coalesce(a.g, -1)), c))[1]}}])) AS m FROM pp GROUP BY step, image_id, class_id),
m AS (SELECT step, unnest(list_transform(list_filter(m, lambda q: q.g IS NOT NULL), lambda q: q.d)) AS det_id FROM mm),
lab AS (SELECT ds.step, ds.class_id, ds.det_id, ds.score, CASE WHEN m.det_id IS NULL THEN 0 ELSE 1 END AS tp FROM ds LEFT JOIN m ON ds.step = m.step AND ds.det_id = m.det_id),
{sql_ap('lab', f'SELECT step, class_id, count(*) AS n_gt FROM gt, {STEPS} GROUP BY ALL', 'step, class_id')},
st AS (SELECT class_id, max(ap) FILTER (step < 0.51) AS ap50, max(ap) FILTER (step > 0.74 AND step < 0.76) AS ap75, avg(ap) AS map FROM ap GROUP BY 1),
op AS (SELECT det.* FROM det JOIN router USING (class_id) WHERE score >= threshold), om AS ({sql_match('op', 'gt', 0.5)}),
oc AS (SELECT class_id, count(om.gt_id) AS tp, count(*)-count(om.gt_id) AS fp FROM op LEFT JOIN om USING (det_id) GROUP BY 1),
f0 AS (SELECT class_id, n_gt, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, ap50, ap75, map FROM (SELECT class_id, count(*) AS n_gt FROM gt GROUP BY 1) LEFT JOIN oc USING (class_id) LEFT JOIN st USING (class_id)),
f1 AS (SELECT *, tp/greatest(tp+fp, 1e-12) AS precision, tp/n_gt AS recall FROM f0), f AS (SELECT *, 5*precision*recall/greatest(4*precision+recall, 1e-12) AS fbeta FROM f1),
al AS (SELECT class_id, n_gt, tp, fp, ap50, ap75, map, precision, recall, fbeta, NULL AS fp_per_image FROM f UNION ALL SELECT -1, sum(n_gt), sum(tp), sum(fp), avg(ap50), avg(ap75), avg(map), avg(precision), avg(recall), avg(fbeta), sum(fp)/(SELECT count(*) FROM images) FROM f
 UNION ALL SELECT -2, sum(n_gt), sum(tp), sum(fp), avg(ap50), avg(ap75), avg(map), avg(precision), avg(recall), avg(fbeta), NULL FROM f WHERE class_id IN (2, 5))
SELECT class_id, CAST(n_gt AS BIGINT) AS n_gt, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, {', '.join(f'round({c}, 6) AS {c}' for c in ('ap50', 'ap75', 'map', 'precision', 'recall', 'fbeta', 'fp_per_image'))} FROM al""")
def m7(v):
    r = metrics.report(v.det, v.gt, v.router, tail=(2, 5), images=v.images)
    return r.select("class_id", "n_gt", "tp", "fp", *[F.round(c, 6).alias(c) for c in ("ap50", "ap75", "map", "precision", "recall", "fbeta", "fp_per_image")])


@query("m8_composite", f"""WITH kept AS ({sql_nms('det', 0.5)}), pred AS (SELECT det.* FROM det JOIN kept USING (det_id)), m AS ({sql_match('pred', 'gt', 0.5)}),
lab AS (SELECT pred.*, CASE WHEN m.gt_id IS NULL THEN 0 ELSE 1 END AS tp FROM pred LEFT JOIN m USING (det_id)), {AP},
cnt AS (SELECT class_id, sum(tp) AS tp, count(*)-sum(tp) AS fp FROM lab GROUP BY 1), fig AS (SELECT ap.class_id, n_gt, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, ap FROM ap LEFT JOIN cnt USING (class_id)),
allc AS (SELECT class_id, tp, fp, n_gt, ap AS ap50 FROM fig UNION ALL SELECT -1, sum(tp), sum(fp), sum(n_gt), avg(ap) FROM fig)
SELECT class_id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(n_gt AS BIGINT) AS n_gt, round({PR}, 6) AS precision, round({RE}, 6) AS recall, round(ap50, 6) AS ap50, round(20*{PR}+60*{RE}+20*ap50, 4) AS score FROM allc""")
def m8(v):
    f = metrics.class_figures(metrics.label(kept(v), v.gt, 0.5), v.gt, G)
    both = metrics.composite(f, G).unionByName(metrics.composite(f, []).withColumn("class_id", F.lit(-1)))
    return both.select("class_id", "tp", "fp", "n_gt", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ap50")], F.round("score", 4).alias("score"))


VIEWED = f"""{M}, lab AS (SELECT det.*, i.view, CASE WHEN m.gt_id IS NULL THEN 0 ELSE 1 END AS tp FROM det JOIN images i USING (image_id) LEFT JOIN m USING (det_id)),
{sql_ap('lab', 'SELECT i.view, g.class_id, count(*) AS n_gt FROM gt g JOIN images i USING (image_id) GROUP BY ALL', 'view, class_id')},
cnt AS (SELECT view, class_id, sum(tp) AS tp, count(*)-sum(tp) AS fp FROM lab GROUP BY ALL),
vs AS (SELECT view, sum(coalesce(tp, 0)) AS tp, sum(coalesce(fp, 0)) AS fp, sum(n_gt) AS n_gt, avg(ap) AS ap50 FROM ap LEFT JOIN cnt USING (view, class_id) GROUP BY 1),
sc AS (SELECT view, tp, fp, n_gt, ap50, 20*{PR}+60*{RE}+20*ap50 AS score FROM vs)"""


def by_view(v):
    lab = labelled(v).join(v.images.select("image_id", "view"), "image_id")
    gt = v.gt.join(v.images.select("image_id", "view"), "image_id")
    return metrics.composite(metrics.class_figures(lab, gt, ["view", "class_id"]), ["view"])


@query("m9_weighted_views", f"WITH {VIEWED} SELECT round(sum(score*CASE WHEN view = 'original' THEN 488.0/788 ELSE 300.0/788 END), 4) AS weighted, round(min(score), 4) AS worst FROM sc")
def m9(v):
    w = F.when(F.col("view") == "original", 488.0 / 788).otherwise(300.0 / 788)
    return by_view(v).agg(F.round(F.sum(F.col("score") * w), 4).alias("weighted"), F.round(F.min("score"), 4).alias("worst"))


TH = [i / 20 for i in range(20)]
SW = f"""{L}, tv AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in TH)}]) AS threshold), tot AS ({TOT}),
sw AS (SELECT class_id, threshold, sum(CASE WHEN score >= threshold THEN tp ELSE 0 END) AS tp, count(*) FILTER (score >= threshold) - sum(CASE WHEN score >= threshold THEN tp ELSE 0 END) AS fp, any_value(n_gt) AS n_gt FROM lab JOIN tot USING (class_id), tv GROUP BY ALL),
sp AS (SELECT *, {PR} AS precision, {RE} AS recall FROM sw), sf AS (SELECT *, {sql_f(2)} AS fbeta FROM sp)"""


@query("m10_tune_thresholds", f"WITH {SW} SELECT class_id, threshold, round(fbeta, 6) AS fbeta FROM sf QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY fbeta DESC, recall DESC, threshold) = 1")
def m10(v):
    return metrics.best_threshold(metrics.sweep(labelled(v), v.gt, TH, G, 2.0), G).select("class_id", "threshold", F.round("fbeta", 6).alias("fbeta"))


@query("m11_threshold_scan", f"""WITH {L}, tv AS (SELECT unnest([0.0::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE]) AS threshold), lt AS (SELECT threshold, lab.* FROM lab, tv WHERE score >= threshold),
{sql_ap('lt', 'SELECT threshold, class_id, count(*) AS n_gt FROM gt, tv GROUP BY ALL', 'threshold, class_id')} SELECT threshold, round(avg(ap), 6) AS ap50 FROM ap GROUP BY 1""")
def m11(v):
    t = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5)]))
    lab = labelled(v).withColumn("threshold", t).filter("score >= threshold")
    totals = metrics.truth_totals(v.gt, G).withColumn("threshold", t).select("threshold", "class_id", "n_gt")
    return metrics.average_precision(lab, totals, ["threshold", "class_id"]).groupBy("threshold").agg(F.round(F.avg("ap"), 6).alias("ap50"))


@query("m12_topk_tradeoff", f"""WITH {L}, r AS (SELECT tp, row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, det_id) AS k FROM lab), ks AS (SELECT unnest([1, 3, 5, 10, 1000]) AS top)
SELECT top, count(*) FILTER (k <= top) AS n_kept, CAST(coalesce(sum(tp) FILTER (k <= top), 0) AS BIGINT) AS tp FROM r, ks GROUP BY 1""")
def m12(v):
    r = labelled(v).withColumn("k", F.row_number().over(Window.partitionBy("image_id", "class_id").orderBy(F.desc("score"), "det_id")))
    r = r.groupBy("k").agg(F.count("*").alias("n"), F.sum("tp").alias("tp")).withColumn("top", F.explode(F.array(*[F.lit(x) for x in (1, 3, 5, 10, 1000)])))
    on = F.col("k") <= F.col("top")
    return r.groupBy("top").agg(F.sum(F.when(on, F.col("n")).otherwise(0)).alias("n_kept"), F.sum(F.when(on, F.col("tp")).otherwise(0)).alias("tp"))


@query("m13_threshold_ascent")
def m13(v):
    options = [metrics.prefix_figures(metrics.label(p, v.gt, 0.5), v.gt, TH, G).withColumn("variant", F.lit(n)) for n, p in (("all", v.det), ("a", v.det_a), ("kept", kept(v)))]
    return match.route_search(reduce(DataFrame.unionByName, options))


@query("m14_heldout_thresholds", f"""WITH {L}, f AS (SELECT lab.*, (lab.image_id % 37) % 5 AS fold FROM lab), gf AS (SELECT class_id, (image_id % 37) % 5 AS fold, count(*) AS n FROM gt GROUP BY ALL), fo AS (SELECT unnest(range(0, 5)) AS held), tv AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in TH)}]) AS threshold),
tt AS (SELECT held, class_id, sum(n) AS n_gt FROM gf, fo WHERE fold <> held GROUP BY ALL),
sw AS (SELECT held, class_id, threshold, sum(CASE WHEN score >= threshold THEN tp ELSE 0 END) AS tp, count(*) FILTER (score >= threshold) - sum(CASE WHEN score >= threshold THEN tp ELSE 0 END) AS fp, any_value(n_gt) AS n_gt FROM f CROSS JOIN fo CROSS JOIN tv JOIN tt USING (held, class_id) WHERE fold <> held GROUP BY ALL),
sp AS (SELECT *, {PR} AS precision, {RE} AS recall FROM sw), sf AS (SELECT *, {sql_f(1)} AS fbeta FROM sp)
SELECT held, class_id, threshold FROM sf QUALIFY row_number() OVER (PARTITION BY held, class_id ORDER BY fbeta DESC, recall DESC, threshold) = 1""")
def m14(v):
    fold = (F.col("image_id") % 37) % 5
    held = F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(5)]))
    lab = labelled(v).withColumn("held", held).filter(fold != F.col("held"))
    gt = v.gt.withColumn("held", held).filter(fold != F.col("held"))
    return metrics.best_threshold(metrics.sweep(lab, gt, TH, ["held", "class_id"]), ["held", "class_id"]).select("held", "class_id", "threshold")


MISS = f"""s AS (SELECT g.gt_id, max({sql_iou('d.', 'g.')}) FILTER (d.class_id = g.class_id) AS same, max({sql_iou('d.', 'g.')}) FILTER (d.class_id <> g.class_id) AS other FROM gt g JOIN det d ON d.image_id = g.image_id GROUP BY 1)"""


@query("m15_miss_taxonomy", f"""WITH {MISS} SELECT CASE WHEN s.same >= 0.5 THEN 'covered' WHEN s.same >= 0.1 THEN 'poor_localization' WHEN s.other >= 0.5 THEN 'wrong_class' ELSE 'missing_candidate' END AS kind, count(*) AS n FROM gt LEFT JOIN s USING (gt_id) GROUP BY 1""")
def m15(v):
    return match.miss_taxonomy(v.gt, v.det).groupBy("kind").agg(F.count("*").alias("n"))


@query("m16_top_errors", f"""WITH {L}, top AS (SELECT * FROM lab QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY score DESC, det_id) <= 200),
g AS (SELECT t.det_id, {sql_iou('t.', 'g.')} AS i, t.class_id = g.class_id AS own, (t.x2-t.x1)/(g.x2-g.x1) AS w, (t.y2-t.y1)/(g.y2-g.y1) AS h, g.gt_id FROM top t JOIN gt g ON t.image_id = g.image_id),
o AS (SELECT det_id, max(i) FILTER (own) AS same, max(i) FILTER (NOT own) AS other FROM g GROUP BY 1), n AS (SELECT det_id, w, h FROM g WHERE own QUALIFY row_number() OVER (PARTITION BY det_id ORDER BY i DESC, gt_id) = 1),
k AS (SELECT class_id, CASE WHEN tp = 1 THEN 'tp' WHEN same >= 0.5 THEN 'duplicate' WHEN other >= 0.5 THEN 'wrong_class' WHEN same >= 0.1 THEN 'localization' ELSE 'background' END AS kind, w, h FROM top LEFT JOIN o USING (det_id) LEFT JOIN n USING (det_id))
SELECT class_id, kind, count(*) AS n, round(quantile_cont(w, 0.5) FILTER (kind = 'localization'), 6) AS width_ratio, round(quantile_cont(h, 0.5) FILTER (kind = 'localization'), 6) AS height_ratio FROM k GROUP BY class_id, kind""")
def m16(v):
    e = match.error_summary(match.top_errors(labelled(v), v.gt, 200))
    return e.select("class_id", "kind", "n", F.round("width_ratio", 6).alias("width_ratio"), F.round("height_ratio", 6).alias("height_ratio"))


@query("m17_crossclass_recovery", f"""WITH {MISS} SELECT class_id, count(*) FILTER (coalesce(s.same, 0) < 0.5) AS missed, count(*) FILTER (coalesce(s.same, 0) < 0.5 AND s.other >= 0.5) AS recoverable FROM gt LEFT JOIN s USING (gt_id) GROUP BY 1""")
def m17(v):
    j = v.gt.join(metrics.best_overlap(v.gt, v.det).withColumnRenamed("iou", "same"), "gt_id", "left").join(metrics.best_overlap(v.gt, v.det, False).withColumnRenamed("iou", "other"), "gt_id", "left")
    miss = F.coalesce("same", F.lit(0.0)) < 0.5
    return j.groupBy("class_id").agg(F.count_if(miss).alias("missed"), F.count_if(miss & (F.col("other") >= 0.5)).alias("recoverable"))


@query("m18_nearest_candidates", f"""SELECT g.gt_id, d.det_id, round({sql_iou('d.', 'g.')}, 9) AS iou FROM gt g JOIN det d ON d.image_id = g.image_id WHERE {sql_iou('d.', 'g.')} > 0 QUALIFY row_number() OVER (PARTITION BY g.gt_id ORDER BY {sql_iou('d.', 'g.')} DESC, d.det_id) <= 5""")
def m18(v):
    p = fuse.pairs_at(v.det, v.gt, 1e-300, ["image_id"])
    r = p.withColumn("k", F.row_number().over(Window.partitionBy("gt_id").orderBy(F.desc("iou"), "det_id"))).filter("k <= 5")
    return r.select("gt_id", "det_id", F.round("iou", 9).alias("iou"))


COV = f"""c AS (SELECT g.gt_id, bool_or(d.model = 'a') AS a, bool_or(d.model = 'b') AS b FROM gt g JOIN det d ON d.image_id = g.image_id AND d.class_id = g.class_id WHERE {sql_iou('d.', 'g.')} >= 0.5 GROUP BY 1)"""


@query("m19_coverage_oracle", f"WITH {COV} SELECT class_id, count(*) AS n_gt, count(*) FILTER (a AND b) AS both_, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, count(*) FILTER (c.gt_id IS NULL) AS none_ FROM gt LEFT JOIN c USING (gt_id) GROUP BY 1")
def m19(v):
    c = match.model_coverage(v.gt, v.det, 0.5)
    a, b = F.col("a"), F.col("b")
    return c.groupBy("class_id").agg(F.count("*").alias("n_gt"), F.count_if(a & b).alias("both_"), F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"), F.count_if(~a & ~b).alias("none_"))


POLICIES = "('plain', 1.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), ('scaled', 0.8::DOUBLE, 0.8::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), ('scaled', 1.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), ('scaled', 1.25::DOUBLE, 1.25::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), ('shifted', 1.0::DOUBLE, 1.0::DOUBLE, 0.1::DOUBLE, 0.0::DOUBLE), ('shifted', 1.0::DOUBLE, 1.0::DOUBLE, -0.1::DOUBLE, 0.0::DOUBLE)"
Q8 = (0, 1, 2, 5, 10, 25, 50, 100)


@query("m20_recall_bound", f"""WITH k(policy, sx, sy, dx, dy) AS (VALUES {POLICIES}), w AS (SELECT policy, image_id, class_id, (x2-x1)*sx AS w, (y2-y1)*sy AS h, (x1+x2)/2+(x2-x1)*sx*dx AS cx, (y1+y2)/2+(y2-y1)*sy*dy AS cy FROM det, k),
t AS (SELECT policy, image_id, class_id, cx-w/2 AS x1, cy-h/2 AS y1, cx+w/2 AS x2, cy+h/2 AS y2 FROM w),
e AS (SELECT t.policy, g.gt_id, g.class_id, t.class_id AS c, max({sql_iou('g.', 't.')}) AS i FROM gt g JOIN t USING (image_id) GROUP BY ALL),
b AS (SELECT policy, gt_id, max(i) FILTER (c = class_id) AS own, arg_max(c, i) AS c0, max(i) AS top FROM e GROUP BY ALL), bc AS (SELECT e.policy, e.gt_id, min(e.c) AS c FROM e JOIN b ON e.policy = b.policy AND e.gt_id = b.gt_id AND e.i = b.top GROUP BY ALL),
a AS (SELECT p.policy, g.class_id, coalesce(b.own, 0) AS own, b.top, bc.c FROM gt g CROSS JOIN (SELECT DISTINCT policy FROM k) p LEFT JOIN b ON b.policy = p.policy AND b.gt_id = g.gt_id LEFT JOIN bc ON bc.policy = p.policy AND bc.gt_id = g.gt_id)
SELECT policy, 'recall' AS part, '' AS key, count(*) FILTER (own >= 0.5) AS n, count(*) AS total, NULL AS value FROM a GROUP BY 1 UNION ALL SELECT policy, 'class', CAST(class_id AS VARCHAR), count(*) FILTER (own >= 0.5), count(*), NULL FROM a GROUP BY 1, class_id
UNION ALL SELECT policy, 'confusion', concat(c, '->', class_id), count(*), NULL, NULL FROM a WHERE own < 0.5 AND top >= 0.5 GROUP BY 1, c, class_id
UNION ALL SELECT policy, 'quantile', unnest([{', '.join(f"'q{x:02d}'" for x in Q8)}]), NULL, NULL, unnest([{', '.join(f'round(quantile_cont(own, {x / 100}), 6)' for x in Q8)}]) FROM a GROUP BY 1""")
def m20(v):
    policies = v.spark.sql(f"SELECT * FROM (VALUES {POLICIES.replace('::DOUBLE', 'D')}) AS t(policy, sx, sy, dx, dy)")
    return match.recall_bound(v.gt, v.det, policies, 0.5, list(Q8)).withColumn("value", F.round("value", 6))


@query("m21_greedy_cover")
def m21(v):
    # each class's boxes as they are, smaller and larger
    actions = v.spark.sql("SELECT CAST(3 * c + k AS INT) AS action, CAST(c AS INT) AS source_class, CAST(c AS INT) AS target_class, s AS sx, s AS sy, 0D AS dx, 0D AS dy FROM (SELECT explode(sequence(0, 7)) AS c) LATERAL VIEW posexplode(array(1D, 0.8D, 1.25D)) AS k, s")
    return match.greedy_cover(v.gt, fuse.apply_actions(v.det, actions, F.lit(4096.0), F.lit(3000.0), 0.1, 0.0), 0.5)


@query("m22_unmatched_truth", f"WITH {M} SELECT gt_id, class_id FROM gt WHERE gt_id NOT IN (SELECT gt_id FROM m)")
def m22(v):
    m = fuse.match_greedy(fuse.pairs_at(v.det, v.gt, 0.5)).select("gt_id")
    return v.gt.join(m, "gt_id", "left_anti").select("gt_id", "class_id")


@query("m23_acc_at_iou", f"WITH p AS (SELECT a.image_id, {sql_iou('a.', 'b.')} AS i FROM det_a a JOIN det_b b ON a.image_id = b.image_id AND a.class_id = b.class_id) SELECT round(avg(CASE WHEN i >= 0.5 THEN 1.0 ELSE 0.0 END), 9) AS acc50, round(avg(i), 9) AS mean_iou FROM p")
def m23(v):
    b = v.det_b.select("image_id", "class_id", *[F.col(c).alias("b" + c) for c in BOX])
    p = v.det_a.join(b, ["image_id", "class_id"]).select(iou("", "b").alias("i"))
    return p.agg(F.round(F.avg((F.col("i") >= 0.5).cast("double")), 9).alias("acc50"), F.round(F.avg("i"), 9).alias("mean_iou"))


@query("m24_stratum_metrics", f"WITH {VIEWED} SELECT view, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(n_gt AS BIGINT) AS n_gt, round(score, 4) AS score FROM sc")
def m24(v):
    return by_view(v).select("view", "tp", "fp", "n_gt", F.round("score", 4).alias("score"))


VIEW_WEIGHTS = {"original": 488 / 788, "grid": 300 / 788}
GATE_STEPS = (IOU_STEPS[0], IOU_STEPS[5])


def view_figures(v, pred):
    """(figures by view, AP50 by view and class) of a prediction table; the mean AP is over GATE_STEPS."""
    on = v.images.select("image_id", "view")
    p, g = stored(pred.select("det_id", "image_id", "class_id", *BOX, "score").join(on, "image_id")), v.gt.join(on, "image_id")
    ap = metrics.evaluate(p, g, GATE_STEPS, ["view", "class_id"])
    classes = ap.filter(F.col("step") == GATE_STEPS[0]).select("view", "class_id", F.col("ap").alias("ap50"))
    means = ap.groupBy("view").agg(F.avg(F.when(F.col("step") == GATE_STEPS[0], F.col("ap"))).alias("map50"), F.avg(F.when(F.col("step") == GATE_STEPS[1], F.col("ap"))).alias("map75"), F.avg("ap").alias("map"))
    lab = metrics.label(p, g, 0.5, ["view", "image_id", "class_id"])
    counts = lab.groupBy("view").agg(F.sum("tp").alias("tp"), (F.count("*") - F.sum("tp")).alias("fp"))
    n = on.groupBy("view").agg(F.count("*").alias("images"))
    f = means.join(counts, "view").join(metrics.truth_totals(g, ["view"]), "view").join(n, "view")
    pr, re, _ = metrics.operating(F.col("tp"), F.col("fp"), F.col("n_gt"))
    f = f.select("view", "map50", "map75", "map", pr, re, (F.col("fp") / F.col("images")).alias("fp_per_image"), (F.col("tp") + F.col("fp")).alias("rows"))
    return f.withColumn("score", 20 * F.col("precision") + 60 * F.col("recall") + 20 * F.col("map50")), classes


def sql_view_figures(n: str, pred: str) -> str:
    """CTEs f{n} (figures by view) and c{n} (AP50 by view and class) of a prediction table."""
    steps = []
    for k, t in enumerate(GATE_STEPS):
        steps.append(f"m{n}{k} AS ({sql_match(pred, 'gt', t)}), lab{n}{k} AS (SELECT i.view, p.class_id, p.det_id, p.score, CASE WHEN m.gt_id IS NULL THEN 0 ELSE 1 END AS tp FROM {pred} p JOIN images i USING (image_id) LEFT JOIN m{n}{k} m USING (det_id))")
        steps.append(sql_ap(f"lab{n}{k}", "SELECT i.view, g.class_id, count(*) AS n_gt FROM gt g JOIN images i USING (image_id) GROUP BY ALL", "view, class_id", tag=f"{n}{k}"))
    return ", ".join(steps) + f""", c{n} AS (SELECT view, class_id, ap AS ap50 FROM ap{n}0),
x{n} AS (SELECT view, sum(tp) AS tp, count(*)-sum(tp) AS fp FROM lab{n}0 GROUP BY 1), g{n} AS (SELECT view, count(*) AS n_gt FROM gt JOIN images USING (image_id) GROUP BY 1), i{n} AS (SELECT view, count(*) AS images FROM images GROUP BY 1),
y{n} AS (SELECT view, map50, map75, (map50+map75)/2 AS map, {PR} AS precision, {RE} AS recall, fp/images AS fp_per_image, tp+fp AS rows FROM (SELECT view, avg(ap) AS map50 FROM ap{n}0 GROUP BY 1) JOIN (SELECT view, avg(ap) AS map75 FROM ap{n}1 GROUP BY 1) USING (view) JOIN x{n} USING (view) JOIN g{n} USING (view) JOIN i{n} USING (view)),
f{n} AS (SELECT *, 20*precision+60*recall+20*map50 AS score FROM y{n})"""


@query("m25_release_gates", f"""WITH kept AS ({sql_nms('det', 0.5)}), pred AS (SELECT det.* FROM det JOIN kept USING (det_id)), {sql_view_figures('A', 'det')}, {sql_view_figures('B', 'pred')},
w AS (SELECT b.view, min(b.ap50-a.ap50) AS worst FROM cB b JOIN cA a USING (view, class_id) GROUP BY 1), d AS (SELECT b.view, b.score-a.score AS s, b.map50-a.map50 AS m, b.map75-a.map75 AS m75, b.map-a.map AS mm, b.recall-a.recall AS r, b.fp_per_image/a.fp_per_image AS q, worst FROM fB b JOIN fA a USING (view) JOIN w USING (view)),
t AS (SELECT view, unnest(['score', 'map50', 'map75', 'map', 'recall', 'fp_ratio', 'class_ap50']) AS gate, unnest([s, m, m75, mm, r, q, worst]) AS figure, unnest([s < 0.1, m < 0.005, m75 < 0.005, mm < 0, r < -0.002, q > 1.05, worst < -0.02]) AS bad FROM d),
x AS (SELECT count(*) AS n FROM (SELECT image_id, class_id, x1, y1, x2, y2 FROM det EXCEPT ALL SELECT image_id, class_id, x1, y1, x2, y2 FROM pred)), z AS (SELECT sum(s*CASE view WHEN 'grid' THEN 300/788 ELSE 488/788 END) AS figure FROM d)
SELECT view, gate, round(figure, 6) AS figure FROM t WHERE bad UNION ALL SELECT 'all', 'weighted_score', round(figure, 6) FROM z WHERE figure < 0.2 UNION ALL SELECT 'all', 'membership', n FROM x WHERE n <> 0""")
def m25(v):
    new = kept(v)
    (control, classes), (better, better_classes) = view_figures(v, v.det), view_figures(v, new)
    box = ["image_id", "class_id", *BOX]
    different = v.det.select(*box).exceptAll(new.select(*box)).agg(F.count("*").alias("n"))
    return match.release_gates(control, better, classes, better_classes, VIEW_WEIGHTS, different=different).withColumn("figure", F.round("figure", 6))


CUTS = (0.0, 0.3, 0.6, 0.9)


@query("m26_best_candidate", f"""WITH {L}, v AS (SELECT lab.*, i.view FROM lab JOIN images i USING (image_id)), tv AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in CUTS)}]) AS cut), lc AS (SELECT cut, view, class_id, det_id, score, tp FROM v, tv WHERE score >= cut),
{sql_ap('lc', 'SELECT cut, i.view, g.class_id, count(*) AS n_gt FROM gt g JOIN images i USING (image_id), tv GROUP BY ALL', 'cut, view, class_id')},
m1 AS (SELECT cut, view, avg(ap) AS map50, sum(n_gt) AS n_gt FROM ap GROUP BY ALL), m2 AS (SELECT cut, view, sum(tp) AS tp, count(*)-sum(tp) AS fp FROM lc GROUP BY ALL),
f AS (SELECT cut, view, map50, {PR} AS precision, {RE} AS recall, tp+fp AS rows FROM m1 JOIN m2 USING (cut, view)), s AS (SELECT *, 20*precision+60*recall+20*map50 AS score FROM f),
e AS (SELECT s.cut FROM s JOIN (SELECT view, map50 AS bm, recall AS br FROM s WHERE cut = 0.3) b USING (view) GROUP BY 1 HAVING bool_and(map50 >= bm-0.2 AND recall >= br-0.25)),
w AS (SELECT cut, round(sum(wt*score), 9) AS score, round(min(score), 9) AS worst, round(sum(wt*precision), 9) AS precision, round(sum(wt*recall), 9) AS recall, round(sum(wt*map50), 9) AS map50, sum(rows)::BIGINT AS rows FROM (SELECT *, CASE view WHEN 'grid' THEN 300/788 ELSE 488/788 END AS wt FROM s) JOIN e USING (cut) GROUP BY 1)
SELECT * FROM (SELECT 'score' AS rule, * FROM w ORDER BY score DESC, worst DESC, precision DESC, rows, cut LIMIT 1) UNION ALL SELECT * FROM (SELECT 'recall', * FROM w ORDER BY recall DESC, map50 DESC, score DESC, worst DESC, precision DESC, rows, cut LIMIT 1)""")
def m26(v):
    on = v.images.select("image_id", "view")
    f = metrics.prefix_figures(labelled(v).join(on, "image_id"), v.gt.join(on, "image_id"), list(CUTS), ["view", "class_id"])
    f = f.groupBy(F.col("threshold").alias("cut"), "view").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("n_gt").alias("n_gt"), F.avg("ap").alias("map50"))
    pr, re_, _ = metrics.operating(F.col("tp"), F.col("fp"), F.col("n_gt"))
    f = checkpointed(f.select("cut", "view", "map50", pr, re_, (F.col("tp") + F.col("fp")).alias("rows")).withColumn("score", 20 * F.col("precision") + 60 * F.col("recall") + 20 * F.col("map50")))
    pick = lambda name, first: match.best_candidate(f, "cut", VIEW_WEIGHTS, 0.3, -0.2, 0.25, first).select(F.lit(name).alias("rule"), "*")
    return pick("score", False).union(pick("recall", True))
