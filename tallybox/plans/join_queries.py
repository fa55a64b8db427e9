"""Joins of box tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybox.functions.columns import BOX, ioa, iou
from tallybox.operators import fuse, govern, match, support
from tallybox.plans.registry import query, sql_area, sql_inter, sql_iou, sql_match, sql_nms

BM = f"""bm AS (SELECT a.det_id, b.det_id AS match_id, b.score AS match_score, {sql_iou('a.', 'b.')} AS match_iou, b.x1 AS mx1, b.y1 AS my1, b.x2 AS mx2, b.y2 AS my2 FROM det_a a JOIN det_b b ON a.image_id = b.image_id AND a.class_id = b.class_id
 WHERE {sql_iou('a.', 'b.')} >= {{t}} QUALIFY row_number() OVER (PARTITION BY a.det_id ORDER BY match_iou DESC, b.det_id) = 1)"""


def matched(v, t):
    return match.best_match(v.det_a, v.det_b, t)


@query("j1_best_match", f"WITH {BM.format(t=0.3)} SELECT a.det_id, bm.match_id, round(bm.match_iou, 9) AS match_iou FROM det_a a LEFT JOIN bm USING (det_id)")
def j1(v):
    return matched(v, 0.3).select("det_id", "match_id", F.round("match_iou", 9).alias("match_iou"))


@query("j2_support_features", f"WITH {BM.format(t=0.3)} SELECT a.det_id, CASE WHEN match_id IS NULL THEN 0 ELSE 1 END AS present, round(coalesce(match_iou, 0), 6) AS iou, round(ln(greatest(coalesce(match_score, 0), 1e-12)), 6) AS log_score, round(ln(greatest(coalesce(match_score, 0), 1e-12))-ln(greatest(a.score, 1e-12)), 6) AS log_advantage FROM det_a a LEFT JOIN bm USING (det_id)")
def j2(v):
    return match.support_features(matched(v, 0.3)).select("det_id", "present", *[F.round(c, 6).alias(c) for c in ("iou", "log_score", "log_advantage")])


@query("j3_score_transfer", f"WITH {BM.format(t=0.7)} SELECT a.det_id, round(CASE WHEN match_id IS NULL THEN score ELSE least(1.0, score*1.1) END, 6) AS boost, round(CASE WHEN match_id IS NULL THEN score ELSE greatest(score, sqrt(score*match_score)) END, 6) AS geometric, round(CASE WHEN match_id IS NULL THEN score ELSE greatest(score, match_score) END, 6) AS max_raise, round(CASE WHEN match_id IS NULL THEN score ELSE 1-(1-score)*(1-match_score) END, 6) AS union_ FROM det_a a LEFT JOIN bm USING (det_id)")
def j3(v):
    m = matched(v, 0.7)
    return m.select("det_id", *[F.round(match.transfer_scores(m, k), 6).alias(n) for k, n in (("boost", "boost"), ("geometric", "geometric"), ("max", "max_raise"), ("union", "union_"))])


@query("j4_location_fusion", f"WITH {BM.format(t=0.5)} SELECT a.det_id, floor((CASE WHEN match_id IS NULL THEN x1 ELSE (x1*score+mx1*match_score)/greatest(score+match_score, 1e-12::DOUBLE) END)*1000+0.137::DOUBLE)::BIGINT AS x1_milli, floor((CASE WHEN match_id IS NULL THEN y2 ELSE (y2*score+my2*match_score)/greatest(score+match_score, 1e-12::DOUBLE) END)*1000+0.137::DOUBLE)::BIGINT AS y2_milli, score FROM det_a a LEFT JOIN bm USING (det_id)")
def j4(v):
    return match.fuse_locations(matched(v, 0.5)).select("det_id", F.floor(F.col("x1") * 1000 + 0.137).alias("x1_milli"), F.floor(F.col("y2") * 1000 + 0.137).alias("y2_milli"), "score")


def sql_consensus(place: str) -> str:
    """Source-aware fusion with the expression `place` (of {c}) for a matched box."""
    at = ", ".join(f"CASE WHEN m.gt_id IS NULL THEN a.{c} ELSE {place.format(c=c)} END AS {c}" for c in BOX)
    return f"""WITH bs AS (SELECT det_id AS gt_id, image_id, class_id, x1, y1, x2, y2, score*0.9::DOUBLE AS score FROM det_b), m AS ({sql_match('det_a', 'bs', 0.5)}),
l AS (SELECT a.det_id, a.image_id, a.class_id, {at}, CASE WHEN m.gt_id IS NULL THEN a.score ELSE least(1.0, greatest(a.score, b.score)*1.2::DOUBLE) END AS score FROM det_a a LEFT JOIN m USING (det_id) LEFT JOIN bs b ON b.gt_id = m.gt_id),
u AS (SELECT * FROM l UNION ALL SELECT gt_id, image_id, class_id, x1, y1, x2, y2, score*0.5::DOUBLE FROM bs WHERE gt_id NOT IN (SELECT gt_id FROM m)), k AS ({sql_nms('u', 0.6)}),
r AS (SELECT u.det_id, u.class_id, {', '.join(f'round_even(u.{c}, 0) AS {c}' for c in BOX)}, round(u.score, 6) AS score FROM u JOIN (SELECT det_id FROM k) USING (det_id)) SELECT * FROM r WHERE x2 > x1 AND y2 > y1"""


@query("j5_source_aware_fuse", sql_consensus("CASE WHEN b.score > a.score THEN b.{c} ELSE a.{c} END"))
def j5(v):
    return fuse.source_aware_fuse(v.det_a, v.det_b, 0.5, 1.2, 0.5, 0.9, 0.6).select("det_id", "class_id", *BOX, F.round("score", 6).alias("score"))


@query("j6_representatives", f"""SELECT a.det_id, p.model, p.is_global, p.det_id AS pid, round({sql_iou('a.', 'p.')}, 9) AS iou FROM det a JOIN det p ON a.image_id = p.image_id AND a.class_id = p.class_id WHERE a.model = 'a' AND {sql_iou('a.', 'p.')} >= 0.5
 QUALIFY row_number() OVER (PARTITION BY a.det_id, p.model, p.is_global ORDER BY {sql_iou('a.', 'p.')} DESC, p.score DESC, p.det_id) = 1""")
def j6(v):
    from tallybox.operators.refine import representatives

    return representatives(v.det_a, v.det).select("det_id", "model", "is_global", "pid", F.round("iou", 9).alias("iou"))


@query("j7_label_any", f"SELECT d.det_id, EXISTS (SELECT 1 FROM gt g WHERE g.image_id = d.image_id AND g.class_id = d.class_id AND {sql_iou('d.', 'g.')} >= 0.5) AS positive FROM det d")
def j7(v):
    hit = fuse.pairs_at(v.det, v.gt, 0.5).select("det_id").distinct().withColumn("positive", F.lit(True))
    return v.det.select("det_id").join(hit, "det_id", "left").select("det_id", F.coalesce("positive", F.lit(False)).alias("positive"))


@query("j8_mutual_best", f"""WITH p AS (SELECT d.det_id, g.gt_id, {sql_iou('d.', 'g.')} AS i FROM det d JOIN gt g ON d.image_id = g.image_id AND d.class_id = g.class_id WHERE {sql_iou('d.', 'g.')} >= 0.5)
SELECT det_id, gt_id FROM p QUALIFY row_number() OVER (PARTITION BY det_id ORDER BY i DESC, gt_id) = 1 AND row_number() OVER (PARTITION BY gt_id ORDER BY i DESC, det_id) = 1""")
def j8(v):
    return support.mutual_best(fuse.pairs_at(v.det, v.gt, 0.5))


@query("j9_iou_target", f"SELECT d.det_id, round(greatest(0.0::DOUBLE, (max(CASE WHEN g.gt_id IS NULL THEN 0.0::DOUBLE ELSE {sql_iou('d.', 'g.')} END)-0.25::DOUBLE)/0.75::DOUBLE), 6) AS target FROM det d LEFT JOIN gt g ON d.image_id = g.image_id AND d.class_id = g.class_id GROUP BY 1")
def j9(v):
    m = fuse.pairs_at(v.det, v.gt, 0.0).groupBy("det_id").agg(F.max("iou").alias("i"))
    return v.det.select("det_id").join(m, "det_id", "left").select("det_id", F.round(F.greatest(F.lit(0.0), (F.coalesce("i", F.lit(0.0)) - 0.25) / 0.75), 6).alias("target"))


@query("j10_truth_coverage", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, det_id) AS rank FROM det), c AS (SELECT g.gt_id, max({sql_iou('r.', 'g.')}) AS iou, max(r.score) FILTER ({sql_iou('r.', 'g.')} >= 0.5) AS best_score, min(r.rank) FILTER ({sql_iou('r.', 'g.')} >= 0.5) AS best_rank FROM gt g JOIN r ON r.image_id = g.image_id AND r.class_id = g.class_id GROUP BY 1)
SELECT gt.gt_id, coalesce(c.iou, 0) >= 0.5 AS hit, round(coalesce(c.iou, 0), 9) AS iou, best_score, best_rank FROM gt LEFT JOIN c USING (gt_id)""")
def j10(v):
    c = support.truth_coverage(v.gt, v.det, 0.5)
    return c.select("gt_id", "hit", F.round("iou", 9).alias("iou"), "best_score", F.col("best_rank").cast("bigint").alias("best_rank"))


@query("j11_orphan_filter", f"SELECT det_id FROM det d WHERE NOT touches_edge OR NOT EXISTS (SELECT 1 FROM det c WHERE NOT c.touches_edge AND c.image_id = d.image_id AND c.class_id = d.class_id AND ({sql_iou('d.', 'c.')} > 0.4 OR {sql_inter('d.', 'c.')}/greatest({sql_area('d.')}, 1e-9) > 0.6))")
def j11(v):
    whole = v.det.filter("not touches_edge").select("image_id", "class_id", *[F.col(c).alias("o" + c) for c in BOX])
    seam = v.det.filter("touches_edge")
    bad = seam.join(whole, fuse.GROUP).filter((iou("", "o") > 0.4) | (ioa("", "o") > 0.6)).select("det_id").distinct()
    return v.det.filter("not touches_edge").select("det_id").union(seam.join(bad, "det_id", "left_anti").select("det_id"))


@query("j12_crossview_rescue", f"""WITH bg AS (SELECT gt_id, image_id, class_id, x1+150 AS x1, y1, x2+150 AS x2, y2 FROM gt), m AS (SELECT o.*, g.x1 AS gx1, g.y1 AS gy1, g.x2 AS gx2, g.y2 AS gy2, g.score AS gs, {sql_iou('o.', 'g.')} AS i, row_number() OVER (PARTITION BY o.det_id ORDER BY {sql_iou('o.', 'g.')} DESC, g.det_id) AS k
 FROM det_a o JOIN det_b g ON o.image_id = g.image_id AND o.class_id = g.class_id WHERE {sql_iou('o.', 'g.')} >= 0.6),
f AS (SELECT m.*, i*sqrt(greatest(score, 1e-12)*greatest(gs, 1e-12)) AS rank FROM m WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM gt b WHERE b.image_id = m.image_id AND b.class_id = m.class_id AND {sql_iou('m.', 'b.')} >= 0.3)
 AND NOT EXISTS (SELECT 1 FROM bg b WHERE b.image_id = m.image_id AND b.class_id = m.class_id AND {sql_iou('m.g', 'b.')} >= 0.3))
SELECT det_id, image_id, round(rank, 6) AS rank, round(i, 6) AS support FROM f QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY rank DESC, i DESC, det_id) = 1""")
def j12(v):
    # each view has a base of its own
    shifted = v.gt.withColumns({"x1": F.col("x1") + 150, "x2": F.col("x2") + 150})
    out = support.crossview_rescue(v.det_a, v.det_b, v.gt, shifted, 0.6, 0.3, 1)
    return out.select("det_id", "image_id", F.round("rank", 6).alias("rank"), F.round("match_iou", 6).alias("support"))


SEQ = "SELECT det_id, image_id, image_id // 5 AS seq, class_id, (x1+x2)/2 AS cx, score FROM det"


@query("j13_sequence_support", f"""WITH s AS ({SEQ}), o AS (SELECT * FROM s WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, det_id) <= 20),
p AS (SELECT a.det_id, b.image_id, max(exp(-pow((a.cx-b.cx)/256, 2)/2)*b.score) AS s FROM s a JOIN o b ON a.seq = b.seq AND a.class_id = b.class_id AND a.image_id <> b.image_id GROUP BY ALL),
r AS (SELECT det_id, s, row_number() OVER (PARTITION BY det_id ORDER BY s DESC) AS k FROM p) SELECT s.det_id, round(coalesce(sum(r.s) FILTER (k <= 2), 0)/2, 6) AS support FROM s LEFT JOIN r USING (det_id) GROUP BY 1""")
def j13(v):
    d = v.det.withColumn("seq", F.expr("image_id div 5"))
    return support.sequence_support(d, 256.0).select("det_id", F.round("support", 6).alias("support"))


PR = """pp AS (SELECT id, width, thumb, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN thumb[i] > 0 THEN (1::HUGEINT << (i-1)::INT) ELSE 0::HUGEINT END))::HUGEINT AS dhash, sha256(array_to_string(list_transform(thumb, lambda x: CAST(x AS BIGINT)), ',')) AS pixel,
 sqrt(list_aggregate(thumb, 'var_pop')) AS sd, list_aggregate(thumb, 'avg') AS mu FROM fingers),
nd AS (SELECT * FROM (SELECT a.id AS a, b.id AS b, bit_count(xor(a.dhash, b.dhash))::BIGINT AS distance, (list_dot_product(a.thumb, b.thumb)/64-a.mu*b.mu)/(a.sd*b.sd) AS corr, list_distance(a.thumb, b.thumb)/8 AS rmse FROM pp a JOIN pp b ON a.id < b.id AND a.width = b.width AND a.pixel <> b.pixel
 WHERE bit_count(xor(a.dhash, b.dhash)) <= 4 AND a.sd >= 4 AND b.sd >= 4) WHERE corr >= 0.9995 AND rmse <= 1.0)"""


@query("j14_near_duplicate_pairs", f"WITH {PR} SELECT a, b, distance, round(corr, 6) AS corr, round(rmse, 6) AS rmse FROM nd")
def j14(v):
    return govern.near_duplicate_pairs(govern.fingerprints(v.fingers)).select("a", "b", "distance", F.round("corr", 6).alias("corr"), F.round("rmse", 6).alias("rmse"))


@query("j15_duplicate_keys", "WITH k AS (SELECT doc_id, concat('t:', sha256(text)) AS key FROM documents UNION ALL SELECT doc_id, concat('n:', lang, ':', n_chars) FROM documents WHERE n_chars > 1000), c AS (SELECT key, min(doc_id) AS head FROM k GROUP BY 1 HAVING count(*) > 1) SELECT DISTINCT c.head AS a, k.doc_id AS b FROM k JOIN c USING (key) WHERE k.doc_id <> c.head")
def j15(v):
    keys = F.array_compact(F.array(F.concat(F.lit("t:"), F.sha2("text", 256)), F.when(F.col("n_chars") > 1000, F.concat(F.lit("n:"), F.col("lang"), F.lit(":"), F.col("n_chars").cast("string")))))
    return govern.key_edges(v.documents.select("doc_id", keys.alias("keys")), "doc_id")


@query("j16_aligned_caches", "WITH a AS (SELECT DISTINCT image_id, 4096 AS w FROM det_a), b AS (SELECT DISTINCT image_id, CASE WHEN image_id % 50 = 0 THEN 4000 ELSE 4096 END AS w FROM det_b WHERE image_id % 40 <> 7) SELECT coalesce(a.image_id, b.image_id) AS image_id, CASE WHEN a.image_id IS NULL THEN 'only_b' WHEN b.image_id IS NULL THEN 'only_a' ELSE 'size' END AS problem FROM a FULL JOIN b USING (image_id) WHERE a.image_id IS NULL OR b.image_id IS NULL OR a.w <> b.w")
def j16(v):
    a = v.det_a.select("image_id").distinct().withColumn("width", F.lit(4096))
    b = v.det_b.filter("image_id % 40 <> 7").select("image_id").distinct().withColumn("width", F.when(F.col("image_id") % 50 == 0, 4000).otherwise(4096))
    return support.misaligned(a, b)


@query("j17_identity_join", "WITH a AS (SELECT image_id, class_id, x1, y1, x2, y2, score, row_number() OVER (PARTITION BY image_id, class_id, x1, y1, x2, y2 ORDER BY score DESC, det_id) AS k FROM det), b AS (SELECT image_id, class_id, x1, y1, x2, y2, score, row_number() OVER (PARTITION BY image_id, class_id, x1, y1, x2, y2 ORDER BY score/2 DESC, det_id) AS k FROM det) SELECT count(*) AS n, round(sum(a.score-b.score/2), 3) AS diff FROM a JOIN b USING (image_id, class_id, x1, y1, x2, y2, k)")
def j17(v):
    j = support.identity_join(v.det, v.det.withColumn("score", F.col("score") / 2))
    return j.agg(F.count("*").alias("n"), F.round(F.sum(F.col("score") - F.col("new_score")), 3).alias("diff"))


@query("j18_missing_images", "WITH e AS (SELECT unnest(range(0, (SELECT count(*)+10 FROM images))) AS image_id), p AS (SELECT DISTINCT image_id FROM det WHERE score >= 0.99 UNION SELECT -1) SELECT image_id, 'missing' AS problem FROM e WHERE image_id NOT IN (SELECT image_id FROM p) UNION ALL SELECT image_id, 'unknown' FROM p WHERE image_id NOT IN (SELECT image_id FROM e)")
def j18(v):
    expected = v.spark.range(v.images.count() + 10).toDF("image_id")
    present = v.det.filter("score >= 0.99").select("image_id").union(v.spark.range(-1, 0).toDF("image_id")).distinct()
    return support.missing_and_unknown(expected, present, "image_id")


@query("j19_coverage_difference", f"WITH c AS (SELECT g.gt_id, bool_or(d.model = 'a') AS a, bool_or(d.model = 'b') AS b FROM gt g JOIN det d ON d.image_id = g.image_id AND d.class_id = g.class_id WHERE {sql_iou('d.', 'g.')} >= 0.5 GROUP BY 1) SELECT gt_id, CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_a' ELSE 'only_b' END AS side FROM c")
def j19(v):
    c = match.model_coverage(v.gt, v.det, 0.5).filter("a or b")
    return c.select("gt_id", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "only_a").otherwise("only_b").alias("side"))


@query("j20_nearest_in_prefix", """WITH n AS (SELECT vec_id, label, thumb, sqrt(list_sum(list_transform(thumb, lambda x: x*x))) AS norm FROM prints), p AS (SELECT a.vec_id, b.vec_id AS near, list_dot_product(a.thumb, b.thumb)/(a.norm*b.norm) AS sim FROM n a JOIN n b ON a.label = b.label AND b.vec_id % 2 = 0 WHERE a.vec_id % 2 = 1)
SELECT vec_id, near, round(sim, 6) AS sim FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, near) = 1""")
def j20(v):
    out = support.nearest_in_prefix(v.prints.filter("vec_id % 2 = 1"), v.prints.filter("vec_id % 2 = 0"), "label", "vec_id", "thumb")
    return out.select("vec_id", "near", F.round("sim", 6).alias("sim"))


@query("j21_incremental_rescue", f"""WITH b AS (SELECT * FROM det_a WHERE score >= 0.7), p1 AS (SELECT * FROM det_a WHERE score < 0.7), j AS (SELECT p1.det_id, p1.image_id, p1.class_id, p1.x1, p1.y1, p1.x2, p1.y2, max(sqrt(p1.score*d.score)) AS score FROM p1 JOIN det_b d ON p1.image_id = d.image_id AND p1.class_id = d.class_id WHERE {sql_iou('p1.', 'd.')} >= 0.5 GROUP BY ALL),
f AS (SELECT * FROM j WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.image_id = j.image_id AND b.class_id = j.class_id AND {sql_iou('j.', 'b.')} >= 0.3) AND score >= 0.5), k AS ({sql_nms('f', 0.5, 'image_id, class_id')})
SELECT det_id, image_id, class_id, round(score, 6) AS score FROM f JOIN (SELECT det_id FROM k) USING (det_id) QUALIFY row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, det_id) <= 2""")
def j21(v):
    out = support.incremental_rescue(v.det_a.filter("score >= 0.7"), v.det_a.filter("score < 0.7"), v.det_b, 0.5, 0.3, 0.5, 0.5, 2)
    return out.select("det_id", "image_id", "class_id", F.round("score", 6).alias("score"))


@query("j22_consensus_support", f"SELECT a.det_id, round(CASE WHEN max(CASE WHEN b.det_id IS NULL THEN 0.0::DOUBLE ELSE {sql_iou('a.', 'b.')} END) >= 0.55 THEN least(1.0, a.score*1.25) ELSE a.score END, 6) AS score FROM det_a a LEFT JOIN det_b b ON a.image_id = b.image_id AND a.class_id = b.class_id GROUP BY a.det_id, a.score")
def j22(v):
    m = matched(v, 0.55)
    return m.select("det_id", F.round(match.transfer_scores(m, "boost", 1.25), 6).alias("score"))


@query("j23_class_router", "SELECT det.det_id, det.class_id, det.model FROM det JOIN router r ON r.class_id = det.class_id AND r.model = det.model AND det.score >= r.threshold")
def j23(v):
    return v.det.join(F.broadcast(v.router), ["class_id", "model"]).filter("score >= threshold").select("det_id", "class_id", "model")
