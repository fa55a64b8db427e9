"""Scalar geometry, keys, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybox.functions import columns as C
from tallybox.plans.registry import query, sql_area, sql_inter, sql_iou
from tallybox.functions.columns import BOX

PAIR = """pr AS (SELECT p.det_id, g.gt_id, p.score, p.image_id, p.class_id, p.x1 AS ax1, p.y1 AS ay1, p.x2 AS ax2, p.y2 AS ay2, g.x1 AS bx1, g.y1 AS by1, g.x2 AS bx2, g.y2 AS by2
 FROM det p JOIN gt g ON p.image_id = g.image_id AND p.class_id = g.class_id)"""
W, H = 4096.0, 3000.0
CLIP = "greatest(least({v}, {t}::DOUBLE), 0.0::DOUBLE)"


def pairs(v):
    a = v.det.select("det_id", "score", "image_id", "class_id", *[F.col(c).alias("a" + c) for c in BOX])
    return a.join(v.gt.select("gt_id", "image_id", "class_id", *[F.col(c).alias("b" + c) for c in BOX]), ["image_id", "class_id"])


def clipped(x1, y1, x2, y2):
    return ", ".join(f"{CLIP.format(v=e, t=t)} AS {n}" for e, t, n in ((x1, 4096, "x1"), (y1, 3000, "y1"), (x2, 4096, "x2"), (y2, 3000, "y2")))


@query("p1_iou", f"WITH {PAIR} SELECT det_id, gt_id, {sql_iou('a', 'b')} AS iou FROM pr")
def p1(v):
    return pairs(v).select("det_id", "gt_id", C.iou("a", "b").alias("iou"))


@query("p2_ioa", f"WITH {PAIR} SELECT det_id, gt_id, {sql_inter('a', 'b')}/greatest({sql_area('a')}, 1e-9::DOUBLE) AS ioa FROM pr")
def p2(v):
    return pairs(v).select("det_id", "gt_id", C.ioa("a", "b").alias("ioa"))


@query("p3_giou_loss", f"""WITH {PAIR}, h AS (SELECT det_id, gt_id, {sql_iou('a', 'b')} AS i, {sql_area('a')}+{sql_area('b')}-{sql_inter('a', 'b')} AS u,
 (greatest(ax2,bx2)-least(ax1,bx1))*(greatest(ay2,by2)-least(ay1,by1)) AS hull FROM pr) SELECT det_id, gt_id, round(1-(i-(hull-u)/greatest(hull, 1e-9::DOUBLE)), 6) AS loss FROM h""")
def p3(v):
    return pairs(v).select("det_id", "gt_id", F.round(C.giou_loss("a", "b"), 6).alias("loss"))


@query("p4_yolo", """SELECT det_id, round((x1+x2)/2/4096, 9) AS cx, round((y1+y2)/2/3000, 9) AS cy, round((x2-x1)/4096, 9) AS w, round((y2-y1)/3000, 9) AS h,
 round(x1, 6) AS bx1, round(y2, 6) AS by2 FROM det""")
def p4(v):
    d = v.det.withColumn("y", C.to_yolo("", W, H))
    back = C.from_yolo(F.col("y.cx"), F.col("y.cy"), F.col("y.w"), F.col("y.h"), W, H)
    return d.select("det_id", *[F.round(f"y.{c}", 9).alias(c) for c in ("cx", "cy", "w", "h")], F.round(back.x1, 6).alias("bx1"), F.round(back.y2, 6).alias("by2"))


@query("p5_clip", f"WITH c AS (SELECT det_id, {clipped('x1*1.5-200', 'y1*1.5-200', 'x2*1.5-200', 'y2*1.5-200')} FROM det) SELECT * FROM c WHERE x2-x1 > 1 AND y2-y1 > 1")
def p5(v):
    d = v.det.withColumns({c: F.col(c) * 1.5 - 200 for c in BOX}).withColumn("b", C.clip("", W, H))
    return d.select("det_id", "b.*").filter(C.larger_than(""))


@query("p6_scale_boxes", f"""WITH s AS (SELECT det_id, (x2-x1)*0.8::DOUBLE AS w, (y2-y1)*1.3::DOUBLE AS h, (x1+x2)/2+(x2-x1)*0.8::DOUBLE*0.5 AS cx, (y1+y2)/2+(y2-y1)*1.3::DOUBLE*(-0.5) AS cy FROM det),
 c AS (SELECT det_id, {clipped('cx-w/2', 'cy-h/2', 'cx+w/2', 'cy+h/2')} FROM s) SELECT det_id, round(x1,6) AS x1, round(y1,6) AS y1, round(x2,6) AS x2, round(y2,6) AS y2 FROM c WHERE x2-x1 > 1 AND y2-y1 > 1""")
def p6(v):
    d = v.det.select("det_id", C.clip(C.scale("", 0.8, 1.3, 0.5, -0.5), W, H).alias("b")).select("det_id", "b.*").filter(C.larger_than(""))
    return d.select("det_id", *[F.round(c, 6).alias(c) for c in BOX])


@query("p7_transform_boxes", f"""WITH k(sc) AS (VALUES (0.9::DOUBLE), (1.0::DOUBLE), (1.2::DOUBLE)), t(dx, dy) AS (VALUES (0.0::DOUBLE, 0.0::DOUBLE), (0.1::DOUBLE, 0.0::DOUBLE), (-0.1::DOUBLE, 0.0::DOUBLE), (0.0::DOUBLE, 0.1::DOUBLE), (0.0::DOUBLE, -0.1::DOUBLE)),
 s AS (SELECT det_id, sc, dx, dy, (x2-x1)*sc AS w, (y2-y1)*sc AS h, (x1+x2)/2+(x2-x1)*sc*dx AS cx, (y1+y2)/2+(y2-y1)*sc*dy AS cy FROM det, k, t),
 c AS (SELECT det_id, sc, dx, dy, {clipped('cx-w/2', 'cy-h/2', 'cx+w/2', 'cy+h/2')} FROM s)
 SELECT sc AS scale, dx, dy, count(*) AS n, round(sum((x2-x1)*(y2-y1)), 0) AS area FROM c WHERE x2-x1 > 1 AND y2-y1 > 1 GROUP BY ALL""")
def p7(v):
    variants = v.spark.range(1).select(F.explode(F.array(F.lit(0.9), F.lit(1.0), F.lit(1.2))).alias("scale")).select("scale", F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((0.0, 0.0), (0.1, 0.0), (-0.1, 0.0), (0.0, 0.1), (0.0, -0.1))])).alias("t")).select("scale", "t.*")
    d = v.det.crossJoin(F.broadcast(variants))  # 15 rows
    d = d.withColumn("b", C.clip(C.scale("", F.col("scale"), F.col("scale"), F.col("dx"), F.col("dy")), W, H)).select("scale", "dx", "dy", "b.*").filter(C.larger_than(""))
    return d.groupBy("scale", "dx", "dy").agg(F.count("*").alias("n"), F.round(F.sum(C.area("")), 0).alias("area"))


@query("p8_dilate", """WITH f AS (SELECT *, CASE WHEN class_id = 3 THEN 1.4::DOUBLE ELSE 1.1::DOUBLE END AS sx, CASE WHEN class_id = 5 THEN 0.0::DOUBLE ELSE 1.2::DOUBLE END AS sy FROM det),
 s AS (SELECT det_id, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, (x2-x1)*sx AS w, (y2-y1)*sy AS h FROM f),
 c AS (SELECT det_id, round_even(greatest(least(cx-w/2, 4096), 0), 0) AS a, round_even(greatest(least(cy-h/2, 3000), 0), 0) AS b, round_even(greatest(least(cx+w/2, 4096), 0), 0) AS c, round_even(greatest(least(cy+h/2, 3000), 0), 0) AS d FROM s)
 SELECT det_id, least(a, 4095.0::DOUBLE) AS x1, least(b, 2999.0::DOUBLE) AS y1, greatest(c, least(a, 4095.0::DOUBLE)+1) AS x2, greatest(d, least(b, 2999.0::DOUBLE)+1) AS y2 FROM c""")
def p8(v):
    sx, sy = F.when(F.col("class_id") == 3, 1.4).otherwise(1.1), F.when(F.col("class_id") == 5, 0.0).otherwise(1.2)
    return v.det.select("det_id", C.dilate("", sx, sy, W, H).alias("b")).select("det_id", "b.*")


@query("p9_change_box", f"WITH s AS (SELECT det_id, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, greatest(1.0::DOUBLE, (x2-x1)*0.001::DOUBLE/2) AS w, greatest(1.0::DOUBLE, (y2-y1)*1.4::DOUBLE/2) AS h FROM det), c AS (SELECT det_id, {clipped('cx-w', 'cy-h', 'cx+w', 'cy+h')} FROM s) SELECT det_id, round(x1,6) AS x1, round(y1,6) AS y1, round(x2,6) AS x2, round(y2,6) AS y2 FROM c")
def p9(v):
    return v.det.select("det_id", C.change_box("", 1.4, 0.001, W, H).alias("b")).select("det_id", *[F.round(f"b.{c}", 6).alias(c) for c in BOX])


@query("p10_expand_width", """WITH n AS (SELECT *, CASE WHEN image_id % 2 = 0 THEN CAST(image_id AS VARCHAR) ELSE concat('im', image_id) END AS name FROM det)
 SELECT det_id, CASE WHEN regexp_matches(name, '^[0-9]') THEN greatest(0.0::DOUBLE, (x1+x2)/2-(x2-x1)*1.5/2) ELSE x1 END AS x1, y1, CASE WHEN regexp_matches(name, '^[0-9]') THEN least(4096.0::DOUBLE, (x1+x2)/2+(x2-x1)*1.5/2) ELSE x2 END AS x2, y2 FROM n""")
def p10(v):
    name = F.when(F.col("image_id") % 2 == 0, F.col("image_id").cast("string")).otherwise(F.concat(F.lit("im"), F.col("image_id").cast("string")))
    return v.det.select("det_id", C.expand_width("", 1.5, name, W).alias("b")).select("det_id", "b.*")


@query("p11_interpolate_box", f"""WITH {PAIR}, m AS (SELECT det_id, gt_id, ax1, ay1, ax2, ay2, {clipped('ax1+(bx1-ax1)*0.5', 'ay1+(by1-ay1)*0.5', 'ax2+(bx2-ax2)*0.5', 'ay2+(by2-ay2)*0.5')} FROM pr),
 r AS (SELECT *, round_even(x1, 0) AS a, round_even(y1, 0) AS b, round_even(x2, 0) AS c, round_even(y2, 0) AS d FROM m)
 SELECT det_id, gt_id, CASE WHEN c > a AND d > b THEN a ELSE ax1 END AS x1, CASE WHEN c > a AND d > b THEN b ELSE ay1 END AS y1, CASE WHEN c > a AND d > b THEN c ELSE ax2 END AS x2, CASE WHEN c > a AND d > b THEN d ELSE ay2 END AS y2 FROM r""")
def p11(v):
    return pairs(v).select("det_id", "gt_id", C.interpolate("a", "b", 0.5, W, H).alias("b")).select("det_id", "gt_id", "b.*")


@query("p12_latent_box", f"""WITH l AS (SELECT det_id, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, ln(greatest(x2-x1, 1e-9)) AS lw, ln(greatest(y2-y1, 1e-9)) AS lh FROM det),
 b AS (SELECT *, exp(lw) AS w, exp(lh) AS h FROM l), c AS (SELECT det_id, lw, lh, {clipped('cx-w/2', 'cy-h/2', 'cx+w/2', 'cy+h/2')} FROM b)
 SELECT det_id, round(lw, 6) AS lw, round(lh, 6) AS lh, round(x1, 4) AS x1, round(y2, 4) AS y2 FROM c""")
def p12(v):
    d = v.det.select("det_id", C.latent("").alias("l")).withColumn("b", C.from_latent(F.col("l"), W, H))
    return d.select("det_id", F.round("l.lw", 6).alias("lw"), F.round("l.lh", 6).alias("lh"), F.round("b.x1", 4).alias("x1"), F.round("b.y2", 4).alias("y2"))


@query("p13_round_modes", """SELECT det_id, round_even(x1/2, 0) AS nx1, round_even(y1/4, 0) AS ny1, floor(x1/2) AS ox1, floor(y1/4) AS oy1, ceil(x2/2) AS ox2, ceil(y2/4) AS oy2 FROM det WHERE class_id <> 7""")
def p13(v):
    d = v.det.filter("class_id <> 7").select("det_id", (F.col("x1") / 2).alias("x1"), (F.col("y1") / 4).alias("y1"), (F.col("x2") / 2).alias("x2"), (F.col("y2") / 4).alias("y2"))
    n, o = C.round_box(""), C.round_box("", "outward")
    return d.select("det_id", n.x1.alias("nx1"), n.y1.alias("ny1"), o.x1.alias("ox1"), o.y1.alias("oy1"), o.x2.alias("ox2"), o.y2.alias("oy2"))


@query("p14_edge_score", """WITH t AS (SELECT *, floor(x1/1024)*1024 AS tx, floor(y1/1024)*1024 AS ty FROM det),
 e AS (SELECT det_id, score, (x1 <= tx+12 AND tx > 0) OR (y1 <= ty+12 AND ty > 0) OR (x2 >= tx+1024-12 AND tx+1024 < 4096) OR (y2 >= ty+1024-12 AND ty+1024 < 3000) AS touches FROM t)
 SELECT det_id, touches, score*CASE WHEN touches THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS score FROM e""")
def p14(v):
    tx, ty = F.floor(F.col("x1") / 1024) * 1024, F.floor(F.col("y1") / 1024) * 1024
    t = C.touches_internal_edge("", C.box_struct(tx, ty, tx + 1024, ty + 1024), W, H)
    return v.det.select("det_id", t.alias("touches"), C.edge_score(F.col("score"), t, 0.5).alias("score"))


@query("p15_tile_to_image", "SELECT det_id, x1*0.5+100 AS x1, y1*0.5+200 AS y1, x2*0.5+100 AS x2, y2*0.5+200 AS y2 FROM det")
def p15(v):
    return v.det.select("det_id", C.tile_to_image("", 0.5, 100.0, 200.0).alias("b")).select("det_id", "b.*")


@query("p16_parse_tile_id", """WITH n AS (SELECT det_id, CASE WHEN class_id = 0 THEN concat('im', image_id) ELSE concat('im', image_id, '::x', CAST(x1 AS BIGINT), '_y', CAST(y1 AS BIGINT)) END AS name FROM det)
 SELECT det_id, regexp_replace(name, '::x\\d+_y\\d+$', '') AS source, CAST(coalesce(nullif(regexp_extract(name, '::x(\\d+)_y(\\d+)$', 1), ''), '0') AS INT) AS x, CAST(coalesce(nullif(regexp_extract(name, '::x(\\d+)_y(\\d+)$', 2), ''), '0') AS INT) AS y FROM n""")
def p16(v):
    n = F.concat(F.lit("im"), F.col("image_id").cast("string"))
    name = F.when(F.col("class_id") == 0, n).otherwise(F.concat(n, F.lit("::x"), F.col("x1").cast("bigint").cast("string"), F.lit("_y"), F.col("y1").cast("bigint").cast("string")))
    return v.det.select("det_id", C.parse_tile_id(name).alias("t")).select("det_id", "t.*")


NAMES = """CASE o_orderkey % 6 WHEN 0 THEN concat('coil', o_custkey, '-Raw', o_orderkey % 100, '_x') WHEN 1 THEN concat('img_', o_custkey % 9, '_b', o_custkey, '_', o_orderkey) WHEN 2 THEN concat('C', o_custkey, 'X_V1_F', o_orderkey)
 WHEN 3 THEN concat('C', o_custkey, '_V2_F3_rAW', o_orderkey) WHEN 4 THEN concat('img_x_', o_orderkey) ELSE concat('z', o_orderkey) END"""


@query("p17_group_key", f"""WITH n AS (SELECT o_orderkey, {NAMES} AS name FROM orders) SELECT o_orderkey, CASE WHEN regexp_matches(name, '[-_][Rr][Aa][Ww][0-9]') THEN regexp_replace(name, '[-_][Rr][Aa][Ww][0-9].*$', '')
 WHEN regexp_matches(name, '^img_[0-9]+_.+_[0-9]+$') THEN regexp_replace(name, '_[0-9]+$', '') ELSE name END AS grp FROM n""")
def p17(v):
    return v.orders.withColumn("name", F.expr(NAMES)).select("o_orderkey", C.group_key(F.col("name")).alias("grp"))


@query("p18_source_keys", f"""WITH n AS (SELECT o_orderkey, {NAMES} AS name FROM orders) SELECT o_orderkey, array_to_string(list_filter([CASE WHEN regexp_matches(name, '[-_][Rr][Aa][Ww][0-9]') THEN concat('raw:', regexp_replace(name, '[-_][Rr][Aa][Ww][0-9].*$', '')) END,
 CASE WHEN regexp_matches(name, '^C[^_]+_V[^_]+_F') THEN concat('candidate_c:', lower(split_part(name, '_', 1))) END], lambda x: x IS NOT NULL), '|') AS keys FROM n""")
def p18(v):
    return v.orders.withColumn("name", F.expr(NAMES)).select("o_orderkey", F.array_join(C.source_keys(F.col("name")), "|").alias("keys"))


ALIASES = {"promoanodizedtin": "anodised", "mediumpolishedbrass": "polished", "standardburnishedsteel": "burnished"}


@query("p19_canonical_class", "WITH k AS (SELECT p_partkey, replace(lower(trim(p_type)), ' ', '') AS k FROM part) SELECT p_partkey, CASE k " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES.items()) + " ELSE k END AS class_name FROM k")
def p19(v):
    return v.part.select("p_partkey", C.canonical_class(F.col("p_type"), ALIASES).alias("class_name"))


@query("p20_hash_fraction", "SELECT image_id, round(CAST(concat('0x', substr(sha256(concat('s1:', image_id)), 1, 16)) AS UHUGEINT)::DOUBLE / 18446744073709551616.0::DOUBLE, 9) AS fraction FROM images")
def p20(v):
    return v.images.select("image_id", F.round(C.hash_fraction(F.col("image_id").cast("string"), "s1"), 9).alias("fraction"))


@query("p21_hash_fold", "SELECT image_id, CAST(CAST(concat('0x', substr(sha256(grp), 1, 16)) AS UHUGEINT) % 5 AS INT) AS fold, CAST(CAST(concat('0x', substr(sha256(grp), 1, 8)) AS UHUGEINT) % 10 AS INT) = 0 AS val FROM images")
def p21(v):
    return v.images.select("image_id", C.hash_fold(F.col("grp")).alias("fold"), (C.hash_fold(F.col("grp"), 10, 8) == 0).alias("val"))


@query("p22_threshold_filter", "SELECT det_id FROM det JOIN router r USING (class_id) WHERE det.score >= 0.02 AND det.score >= r.threshold")
def p22(v):
    return v.det.filter("score >= 0.02").join(F.broadcast(v.router.select("class_id", "threshold")), "class_id").filter("score >= threshold").select("det_id")


@query("p23_score_floor", "SELECT det_id, greatest(score, 0.25::DOUBLE) AS score FROM det")
def p23(v):
    return v.det.select("det_id", F.greatest("score", F.lit(0.25)).alias("score"))


@query("p24_exclude_categories", "SELECT class_id, count(*) FILTER (class_id NOT IN (2, 5)) AS kept, count(*) FILTER (class_id IN (2, 5)) AS removed FROM det GROUP BY ALL")
def p24(v):
    out = F.col("class_id").isin(2, 5)
    return v.det.groupBy("class_id").agg(F.count_if(~out).alias("kept"), F.count_if(out).alias("removed"))


@query("p25_sanitize_box", """WITH a AS (SELECT det_id, CASE class_id WHEN 0 THEN NULL WHEN 1 THEN [x1, y1, x2] WHEN 2 THEN [x1, 'nan'::DOUBLE, x2, y2] WHEN 3 THEN [x2, y2, x1, y1] WHEN 4 THEN [x1, y1, x1, y1] ELSE [x1-900, y1-900, x2+900, y2+900] END AS b FROM det),
 f AS (SELECT det_id, b IS NULL OR len(b) <> 4 OR len(list_filter(b, lambda x: isnan(x))) > 0 AS bad, greatest(least(b[1], 4096), 0) AS xa, greatest(least(b[2], 3000), 0) AS ya, greatest(least(b[3], 4096), 0) AS xb, greatest(least(b[4], 3000), 0) AS yb FROM a),
 o AS (SELECT det_id, bad, least(least(xa, xb), 4095) AS x1, least(least(ya, yb), 2999) AS y1, greatest(xa, xb) AS xm, greatest(ya, yb) AS ym FROM f)
 SELECT det_id, CASE WHEN bad THEN 0.0::DOUBLE ELSE x1 END AS x1, CASE WHEN bad THEN 0.0::DOUBLE ELSE y1 END AS y1, CASE WHEN bad THEN 4096.0::DOUBLE ELSE greatest(xm, x1+1) END AS x2, CASE WHEN bad THEN 3000.0::DOUBLE ELSE greatest(ym, y1+1) END AS y2 FROM o""")
def p25(v):
    b = F.expr("""CASE class_id WHEN 0 THEN NULL WHEN 1 THEN array(x1, y1, x2) WHEN 2 THEN array(x1, double('NaN'), x2, y2) WHEN 3 THEN array(x2, y2, x1, y1)
        WHEN 4 THEN array(x1, y1, x1, y1) ELSE array(x1-900, y1-900, x2+900, y2+900) END""")
    return v.det.select("det_id", C.sanitize_box(b, W, H).alias("b")).select("det_id", "b.*")


@query("p26_query_tokens", """WITH w AS (SELECT conv_id, turn, list_slice(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9'']+)', 1), 1, 16) AS w FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(range(1, 17), lambda i: CASE WHEN i <= len(w) THEN CAST(concat('0x', substr(sha256(w[i]), 1, 8)) AS BIGINT) % 32767 + 1 ELSE 0 END), ',') AS ids, CAST(len(w) AS INT) AS real_tokens FROM w""")
def p26(v):
    t = v.conversations.select("conv_id", "turn", C.query_tokens(F.col("text")).alias("t"))
    return t.select("conv_id", "turn", F.array_join(F.col("t.ids").cast("array<string>"), ",").alias("ids"), F.size(F.filter("t.mask", lambda m: m)).alias("real_tokens"))


@query("p27_replace_category_scores", """SELECT a.det_id, CASE WHEN a.class_id IN (1, 3) AND b.score IS NOT NULL THEN b.score ELSE a.score END AS score FROM det a LEFT JOIN (SELECT det_id, score/2 AS score FROM det WHERE image_id % 2 = 0) b USING (det_id)""")
def p27(v):
    from tallybox.operators.rank import replace_scores

    other = v.det.filter("image_id % 2 = 0").select("det_id", (F.col("score") / 2).alias("score"))
    return replace_scores(v.det, other, [1, 3]).select("det_id", "score")
