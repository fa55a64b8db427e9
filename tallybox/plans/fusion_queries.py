"""Suppression, fusion, refinement."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallybox.functions.columns import BOX
from tallybox.operators import fuse, profiles, rank, refine
from tallybox.plans.registry import query, sql_iou, sql_nms

CLIP4 = "greatest(least({v}, {t}::DOUBLE), 0.0::DOUBLE)"
IDS = ["det_id", "image_id", "class_id"]


def six(df):
    return df.select(*IDS, *[F.round(c, 6).alias(c) for c in (*BOX, "score") if c in df.columns])


@query("a1_nms", f"WITH k AS ({sql_nms('det', 0.5)}) SELECT det_id, image_id, class_id, score FROM det JOIN (SELECT det_id FROM k) USING (det_id)")
def a1(v):
    return fuse.nms(v.det, 0.5).select(*IDS, "score")


@query("a2_agnostic_nms", f"WITH k AS ({sql_nms('det', 0.6, 'image_id')}) SELECT det_id FROM k")
def a2(v):
    return fuse.agnostic_nms(v.det, 0.6).select("det_id")


_FITS = f"list_transform(acc, lambda k: {sql_iou('k.', 'x[1].')})"
_JOINED = ", ".join(f"'{c}': (k.{c}*k.w+x[1].{c}*x[1].w)/greatest(k.w+x[1].w, 1e-12)" for c in BOX)


@query("a3_wbf", f"""WITH g AS (SELECT image_id, class_id, list({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'w': score, 'score': score, 'n': 1}} ORDER BY score DESC, det_id) AS b FROM det GROUP BY ALL),
f AS (SELECT image_id, class_id, list_reduce(list_transform(b, lambda x: [x]), lambda acc, x: CASE WHEN list_max({_FITS}) > 0.5 THEN list_transform(acc, lambda k, i: CASE WHEN i = list_position({_FITS}, list_max({_FITS})) THEN {{{_JOINED}, 'w': k.w+x[1].w, 'score': greatest(k.score, x[1].w), 'n': k.n+1}} ELSE k END) ELSE list_concat(acc, x) END) AS c FROM g),
u AS (SELECT image_id, class_id, unnest(c) AS k, unnest(range(0, len(c))) AS cluster FROM f)
SELECT image_id, class_id, CAST(cluster AS INT) AS cluster, {', '.join(f'floor(k.{c}*1000+0.137::DOUBLE)::BIGINT AS {c}_milli' for c in BOX)}, k.score AS score, k.n AS n FROM u""")
def a3(v):
    return fuse.wbf(v.det, 0.5).select("image_id", "class_id", "cluster", *[F.floor(F.col(c) * 1000 + 0.137).alias(f"{c}_milli") for c in BOX], "score", "n")


@query("a4_box_vote", f"""WITH g AS (SELECT image_id, class_id, list({{'id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'w': greatest(score, 1e-12), 's': score, 'a': det_id}} ORDER BY score DESC, det_id) AS b FROM det GROUP BY ALL),
f AS (SELECT image_id, class_id, unnest(list_reduce(list_transform(b, lambda x: [x]), lambda acc, x: list_concat(acc, [{{'id': x[1].id, 'x1': x[1].x1, 'y1': x[1].y1, 'x2': x[1].x2, 'y2': x[1].y2, 'w': x[1].w, 's': x[1].s,
 'a': coalesce(list_filter(acc, lambda k: k.a = k.id AND {sql_iou('k.', 'x[1].')} > 0.5)[1].id, x[1].id)}}]))) AS m FROM g)
SELECT m.a AS det_id, image_id, class_id, max(m.s) AS score, count(*) AS n, floor(sum(m.x1*m.w)/sum(m.w)*1000+0.137::DOUBLE)::BIGINT AS x1_milli, floor(sum(m.y2*m.w)/sum(m.w)*1000+0.137::DOUBLE)::BIGINT AS y2_milli FROM f GROUP BY ALL""")
def a4(v):
    out = fuse.box_vote(v.det, 0.5)
    return out.select(*IDS, "score", F.col("n").cast("bigint").alias("n"), F.floor(F.col("x1") * 1000 + 0.137).alias("x1_milli"), F.floor(F.col("y2") * 1000 + 0.137).alias("y2_milli"))


@query("a5_merge_candidates", f"""WITH e AS (SELECT det_id, image_id, class_id, score*CASE WHEN touches_edge THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS score, greatest(least(x1, 3000.0::DOUBLE), 0) AS x1, greatest(least(y1, 2000.0::DOUBLE), 0) AS y1, greatest(least(x2, 3000.0::DOUBLE), 0) AS x2, greatest(least(y2, 2000.0::DOUBLE), 0) AS y2 FROM det),
c AS (SELECT * FROM e WHERE x2-x1 > 1 AND y2-y1 > 1), k AS ({sql_nms('c', 0.45)})
SELECT c.det_id, c.image_id, c.class_id, round(c.score, 6) AS score, round_even(x1, 0) AS x1, round_even(y1, 0) AS y1, round_even(x2, 0) AS x2, round_even(y2, 0) AS y2 FROM c JOIN (SELECT det_id FROM k) USING (det_id) JOIN router r ON r.class_id = c.class_id WHERE c.score >= r.threshold AND round_even(x2, 0) > round_even(x1, 0) AND round_even(y2, 0) > round_even(y1, 0)""")
def a5(v):
    return six(fuse.merge_candidates(v.det, F.lit(3000.0), F.lit(2000.0), 0.5, 0.45, v.router))


@query("a6_fuse_scaled", f"WITH u AS (SELECT * FROM det_a UNION ALL SELECT det_id, image_id, class_id, x1, y1, x2, y2, least(1.0::DOUBLE, score*0.8::DOUBLE) AS score FROM det_b), k AS ({sql_nms('u', 0.55)}) SELECT u.det_id, u.image_id, u.class_id, round(u.score, 6) AS score FROM u JOIN (SELECT det_id FROM k) USING (det_id)")
def a6(v):
    return fuse.fuse_scaled(v.det_a, v.det_b, 0.8, 0.55).select(*IDS, F.round("score", 6).alias("score"))


def sql_act(source: str, acts: str, floor: float = 0.0) -> str:
    c = ", ".join(f"{CLIP4.format(v=e, t=t)} AS {n}" for e, t, n in (("cx-w/2", 4096, "x1"), ("cy-h/2", 3000, "y1"), ("cx+w/2", 4096, "x2"), ("cy+h/2", 3000, "y2")))
    return f"""SELECT det_id, image_id, class_id, action, x1, y1, x2, y2, score FROM (SELECT det_id, image_id, class_id, action, score, {c} FROM (SELECT s.det_id, s.image_id, a.target_class AS class_id, a.action, greatest(s.score, {floor}::DOUBLE) AS score, (x2-x1)*sx AS w, (y2-y1)*sy AS h, (x1+x2)/2+(x2-x1)*sx*dx AS cx, (y1+y2)/2+(y2-y1)*sy*dy AS cy
 FROM {source} s JOIN {acts} a ON a.source_class = s.class_id)) WHERE x2-x1 > 1 AND y2-y1 > 1"""


@query("a7_apply_actions", f"WITH s0 AS (SELECT * FROM det WHERE score >= 0.9), k AS ({sql_nms('s0', 0.6, 'image_id')}), s AS (SELECT s0.* FROM s0 JOIN (SELECT det_id FROM k) USING (det_id)), a AS ({sql_act('s', 'actions', 0.05)}) SELECT det_id, image_id, class_id, action, round(x1, 6) AS x1, round(y2, 6) AS y2, score FROM a")
def a7(v):
    out = fuse.apply_actions(v.det, v.actions, F.lit(4096.0), F.lit(3000.0), 0.9, 0.6, 0.05)
    return out.select(*IDS, "action", F.round("x1", 6).alias("x1"), F.round("y2", 6).alias("y2"), "score")


@query("a8_layered_union", f"WITH s1 AS (SELECT * FROM det WHERE score >= 0.9), s2 AS (SELECT * FROM det WHERE score >= 0.8), a1 AS (SELECT * FROM actions WHERE action < 3), a2 AS (SELECT * FROM actions WHERE action >= 3), l1 AS ({sql_act('s1', 'a1')}), l2 AS ({sql_act('s2', 'a2')}) SELECT 'first' AS layer, class_id, count(*) AS n FROM l1 GROUP BY ALL UNION ALL SELECT 'second', class_id, count(*) FROM l2 GROUP BY ALL")
def a8(v):
    layers = [("first", v.actions.filter("action < 3"), 0.9), ("second", v.actions.filter("action >= 3"), 0.8)]
    return fuse.layered(v.det, layers, F.lit(4096.0), F.lit(3000.0), 0.0).groupBy("layer", "class_id").agg(F.count("*").alias("n"))


REPS = f"""rp AS (SELECT a.det_id, p.det_id AS pid, p.model, p.is_global, p.score, p.touches_edge, {sql_iou('a.', 'p.')} AS i, p.x1, p.y1, p.x2, p.y2 FROM det a JOIN det p ON a.image_id = p.image_id AND a.class_id = p.class_id WHERE {sql_iou('a.', 'p.')} >= 0.5
 QUALIFY row_number() OVER (PARTITION BY a.det_id, p.model, p.is_global ORDER BY i DESC, p.score DESC, p.det_id) = 1)"""
EVIDENCE = f"""{REPS}, pw AS (SELECT a.det_id, a.model = b.model AS same, {sql_iou('a.', 'b.')} AS i FROM rp a JOIN rp b ON a.det_id = b.det_id AND (a.model < b.model OR (a.model = b.model AND a.is_global < b.is_global))),
pq AS (SELECT det_id, max(i) FILTER (NOT same) AS ab, avg(i) FILTER (same) AS views, quantile_cont(1-i, 0.5) AS spread FROM pw GROUP BY 1),
ag AS (SELECT det_id, count(*) AS n, count(DISTINCT model) AS m, bool_and(NOT is_global AND touches_edge) AS edges, bool_or(NOT is_global AND NOT touches_edge) AS loc, count(*) FILTER (is_global OR NOT touches_edge) AS donors FROM rp GROUP BY 1),
ev AS (SELECT d.*, ln(greatest(d.score, 1e-12)) AS log_score, CASE WHEN m = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS both_models, coalesce(ab, 0.0::DOUBLE) AS ab_iou, n::DOUBLE AS sources, coalesce(views, 0.0::DOUBLE) AS coherence, views IS NOT NULL AS has_views,
 coalesce(spread, 1.0::DOUBLE) AS dispersion, CASE WHEN edges THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS edge_only, ln((x2-x1)*(y2-y1)/(4096.0::DOUBLE*3000)) AS log_area, ln((x2-x1)/(y2-y1)) AS log_aspect, loc, donors FROM det d JOIN ag USING (det_id) LEFT JOIN pq USING (det_id))"""
OVER = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({v}-0.6::DOUBLE)/(1-0.6::DOUBLE)))"
REFINED = f"""{EVIDENCE}, dn AS (SELECT det_id, pow(greatest(score, 1e-12), 0.5)*greatest(i, 1e-12) AS w, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, ln(greatest(x2-x1, 1e-9)) AS lw, ln(greatest(y2-y1, 1e-9)) AS lh FROM rp WHERE is_global OR NOT touches_edge),
up AS (UNPIVOT dn ON cx, cy, lw, lh INTO NAME dim VALUE v), wm AS (SELECT det_id, dim, min(v) AS v FROM (SELECT *, sum(w) OVER (PARTITION BY det_id, dim ORDER BY v, w ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY det_id, dim) AS t FROM up) WHERE c >= t/2 GROUP BY 1, 2),
md AS (SELECT det_id, max(v) FILTER (dim = 'cx') AS cx, max(v) FILTER (dim = 'cy') AS cy, exp(max(v) FILTER (dim = 'lw')) AS w, exp(max(v) FILTER (dim = 'lh')) AS h FROM wm GROUP BY 1),
rb AS (SELECT det_id, greatest(0.0::DOUBLE, cx-w/2) AS x1, greatest(0.0::DOUBLE, cy-h/2) AS y1, least(4096.0::DOUBLE, cx+w/2) AS x2, least(3000.0::DOUBLE, cy+h/2) AS y2 FROM md),
why AS (SELECT e.*, r.x1 AS rx1, r.y1 AS ry1, r.x2 AS rx2, r.y2 AS ry2, CASE WHEN both_models = 0 THEN 'missing_model' WHEN dispersion > 0.20::DOUBLE THEN 'dispersed' WHEN NOT loc THEN 'no_local_donor' WHEN donors < 2 THEN 'few_donors' WHEN r.x2 <= r.x1 OR r.y2 <= r.y1 THEN 'invalid' WHEN {sql_iou('e.', 'r.')} < 0.85::DOUBLE THEN 'out_of_trust' ELSE 'refined' END AS reason FROM ev e LEFT JOIN rb r USING (det_id))"""
MOVED = ", ".join(f"round(CASE WHEN reason = 'refined' THEN r{c} ELSE {c} END, 4) AS {c}" for c in BOX)


def evidence(v):
    return refine.evidence(v.det, v.det, 4096.0, 3000.0)


@query("a9_robust_refinement", f"WITH {REFINED} SELECT det_id, {MOVED}, score, reason FROM why")
def a9(v):
    return refine.robust_refinement(evidence(v), 4096.0, 3000.0).select("det_id", *[F.round(c, 4).alias(c) for c in BOX], "score", "reason")


@query("a10_weighted_median", """WITH c AS (SELECT image_id, class_id, x1, sum(score) OVER (PARTITION BY image_id, class_id ORDER BY x1, det_id ROWS UNBOUNDED PRECEDING) AS c, sum(score) OVER (PARTITION BY image_id, class_id) AS t FROM (SELECT det_id, image_id, class_id, x1, CAST(round(score*1000) AS BIGINT) AS score FROM det))
SELECT image_id, class_id, min(x1) AS median FROM c WHERE c >= t/2 GROUP BY ALL""")
def a10(v):
    d = v.det.withColumn("w", F.round(F.col("score") * 1000).cast("bigint"))
    return rank.weighted_median(d, ["image_id", "class_id"], "x1", "w", "det_id")


@query("a11_evidence_features", f"WITH {EVIDENCE} SELECT det_id, {', '.join(f'round({c}, 6) AS {c}' for c in refine.FEATURES)} FROM ev")
def a11(v):
    return evidence(v).select("det_id", *[F.round(c, 6).alias(c) for c in refine.FEATURES])


#: feature -> (mean, scale, coefficient)
PROFILE = {"log_score": (-1.2, 1.1, 0.8), "both_models": (0.5, 0.5, 0.3), "ab_iou": (0.4, 0.35, 0.5), "sources": (2.0, 1.0, 0.25), "coherence": (0.2, 0.3, 0.2), "dispersion": (0.6, 0.4, -0.4), "edge_only": (0.2, 0.4, -0.3), "log_area": (-5.4, 0.3, 0.1), "log_aspect": (0.0, 0.2, -0.05)}
QUALITY = "1/(1+exp(-(-0.5::DOUBLE" + "".join(f"+({c}-({m}::DOUBLE))/{s}::DOUBLE*({k}::DOUBLE)" for c, (m, s, k) in PROFILE.items()) + ")))"


#: The same as a document, and one that changes nothing.
DOCUMENTS = {"fitted": {"score_blend": 0.2, "scaler": {"mean": {c: m for c, (m, _, _) in PROFILE.items()}, "scale": {c: x for c, (_, x, _) in PROFILE.items()}}, "linear": {"intercept": -0.5, "coefficients": {c: k for c, (_, _, k) in PROFILE.items()}}}, "plain": {}}


@query("a12_quality_score", f"""WITH {REFINED} SELECT 'fitted' AS profile, det_id, {MOVED}, reason, round(least(1.0::DOUBLE, pow(greatest(score, 1e-12), 0.8)*pow(greatest({QUALITY}, 1e-12), 0.2)), 6) AS score FROM why
UNION ALL SELECT 'plain', det_id, {MOVED}, reason, round(score, 6) FROM why""")
def a12(v):
    documents = v.spark.createDataFrame([(n, json.dumps(d)) for n, d in DOCUMENTS.items()], "profile string, json string")
    out = profiles.scored(refine.robust_refinement(evidence(v), 4096.0, 3000.0), profiles.parsed(documents))
    return out.select("profile", "det_id", *[F.round(c, 4).alias(c) for c in BOX], "reason", F.round("score", 6).alias("score"))


@query("a13_global_divisor", f"""WITH {EVIDENCE}, s AS (SELECT det_id, score*exp(least(0.25::DOUBLE, greatest(-0.10::DOUBLE, 0.18::DOUBLE*both_models*{OVER.format(v='ab_iou')}+CASE WHEN has_views THEN 0.08::DOUBLE*{OVER.format(v='coherence')} ELSE 0.0::DOUBLE END
 +0.05::DOUBLE*log2(least(4, greatest(1, sources)))/2-0.10::DOUBLE*edge_only))) AS s FROM ev) SELECT det_id, round(s/greatest(1.0, max(s) OVER ()), 6) AS score FROM s""")
def a13(v):
    return refine.consensus_delta(evidence(v)).select("det_id", F.round("score", 6).alias("score"))


@query("a14_view_invariant_delta", f"""WITH {EVIDENCE}, t AS (SELECT det_id, class_id, score, both_models > 0 AND ab_iou > 0.6::DOUBLE AS on_, {OVER.format(v='ab_iou')} AS strength FROM ev),
r AS (SELECT *, rank() OVER (PARTITION BY class_id, on_ ORDER BY strength)-1+(count(*) OVER (PARTITION BY class_id, on_, strength)-1)/2 AS r, count(*) OVER (PARTITION BY class_id, on_) AS n FROM t),
s AS (SELECT det_id, score*CASE WHEN on_ THEN exp(0.08::DOUBLE*strength*(2*(r+0.5)/n-1)) ELSE 1.0::DOUBLE END AS s FROM r) SELECT det_id, round(s/greatest(1.0, max(s) OVER ()), 6) AS score FROM s""")
def a14(v):
    return refine.view_invariant_delta(evidence(v).select("det_id", "class_id", "score", "both_models", "ab_iou")).select("det_id", F.round("score", 6).alias("score"))


@query("a15_seam_statistics", """WITH l AS (SELECT unnest([1024, 2048, 3072]) AS p), s AS (SELECT det_id, class_id, bool_or(abs(x1-p) <= 12 OR abs(x2-p) <= 12) AS vx, bool_or(abs(y1-p) <= 12 OR abs(y2-p) <= 12) AS hy FROM det, l GROUP BY ALL) SELECT class_id, count(*) AS n, count(*) FILTER (vx) AS vertical, count(*) FILTER (hy) AS horizontal FROM s GROUP BY 1""")
def a15(v):
    return refine.seam_statistics(v.det, [1024, 2048, 3072], [1024, 2048, 3072], 12.0)
