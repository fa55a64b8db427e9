"""Tiling and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybox.functions.columns import BOX
from tallybox.operators import tiles
from tallybox.plans.registry import query, sql_iou

TX, TY = "[0, 768, 1536, 2304, 3072]", "[0, 768, 1536, 1976]"
SL = f"sl AS (SELECT image_id, tx, ty, 1024 AS tw, 1024 AS th FROM (SELECT image_id, unnest({TX}) AS tx FROM images), (SELECT unnest({TY}) AS ty))"
GRID = "gr AS (SELECT image_id, tx, ty, 1387 AS tw, 1516 AS th FROM (SELECT image_id, unnest([0, 1354, 2709]) AS tx FROM images), (SELECT unnest([0, 1484]) AS ty))"


def as_int(df):
    return df.select("image_id", *[F.col(c).cast("int").alias(c) for c in tiles.TILE])


@query("t1_sliding_tiles", f"WITH {SL} SELECT * FROM sl")
def t1(v):
    return as_int(tiles.sliding_tiles(v.images, 1024, 0.25))


@query("t2_grid_tiles", f"WITH {GRID} SELECT * FROM gr")
def t2(v):
    return as_int(tiles.grid_tiles(v.images, 1387, 1516, 2, 3))


@query("t3_strip_tiles", f"SELECT image_id, unnest({TX}) AS tx, 0 AS ty, 1024 AS tw, 3000 AS th FROM images")
def t3(v):
    return as_int(tiles.strip_tiles(v.images, 1024, 0.25))


@query("t4_squares_and_strips", f"WITH {SL} SELECT * FROM sl UNION ALL SELECT image_id, unnest({TX}), 0, 1024, 3000 FROM images")
def t4(v):
    return as_int(tiles.squares_and_strips(v.images, 1024, 0.25))


def sql_assign(t: str, vis: float) -> str:
    return f"""asg AS (SELECT *, (share >= {vis} OR (mx >= tx AND mx < tx+tw AND my >= ty AND my < ty+th) OR (x1 <= tx AND x2 >= tx+tw) OR (y1 <= ty AND y2 >= ty+th)) AND cx2-cx1 >= 1 AND cy2-cy1 >= 1 AS kept FROM
 (SELECT *, (cx2-cx1)*(cy2-cy1)/greatest((x2-x1)*(y2-y1), 1e-9) AS share, (x1+x2)/2 AS mx, (y1+y2)/2 AS my FROM (SELECT t.*, g.gt_id, g.class_id, x1, y1, x2, y2, greatest(x1, tx::DOUBLE) AS cx1, greatest(y1, ty::DOUBLE) AS cy1, least(x2, (tx+tw)::DOUBLE) AS cx2, least(y2, (ty+th)::DOUBLE) AS cy2 FROM {t} t JOIN gt g ON t.image_id = g.image_id AND x1 < tx+tw AND x2 > tx AND y1 < ty+th AND y2 > ty)))"""


def assigned(v, visibility=0.5):
    return tiles.assign_boxes(tiles.sliding_tiles(v.images, 1024, 0.25), v.gt, visibility)


@query("t5_assign_boxes", f"WITH {SL}, {sql_assign('sl', 0.5)} SELECT gt_id, tx, ty, cx1-tx AS x1, cy1-ty AS y1, cx2-tx AS x2, cy2-ty AS y2 FROM asg WHERE kept")
def t5(v):
    return assigned(v).filter("kept").select("gt_id", "tx", "ty", *BOX)


@query("t6_drop_ambiguous_tiles", f"WITH {SL}, {sql_assign('sl', 0.95)} SELECT image_id, tx, ty FROM sl WHERE (image_id, tx, ty) NOT IN (SELECT (image_id, tx, ty) FROM asg WHERE NOT kept AND share > 0.05)")
def t6(v):
    bad = assigned(v, 0.95).filter("not kept and visibility > 0.05").select("image_id", "tx", "ty").distinct()
    return tiles.sliding_tiles(v.images, 1024, 0.25).select("image_id", "tx", "ty").join(bad, ["image_id", "tx", "ty"], "left_anti")


@query("t7_sample_negatives", f"""WITH {SL}, {sql_assign('sl', 0.5)}, p AS (SELECT sl.image_id, sl.tx, sl.ty, EXISTS (SELECT 1 FROM asg a WHERE a.kept AND a.image_id = sl.image_id AND a.tx = sl.tx AND a.ty = sl.ty) AS positive FROM sl),
c AS (SELECT *, greatest(1, round_even(greatest(sum(positive::INT) OVER (PARTITION BY image_id), 1)*0.1, 0)) AS cap, row_number() OVER (PARTITION BY image_id, positive ORDER BY sha256(concat('n:', image_id, ':', tx, ':', ty)), tx, ty) AS r FROM p)
SELECT image_id, tx, ty, positive FROM c WHERE positive OR r <= cap""")
def t7(v):
    return tiles.sample_negatives(marked(v), 0.1, "n")


def marked(v):
    pos = assigned(v).filter("kept").select("image_id", "tx", "ty").distinct().withColumn("positive", F.lit(True))
    t = tiles.sliding_tiles(v.images, 1024, 0.25).select("image_id", "tx", "ty").join(pos, ["image_id", "tx", "ty"], "left")
    return t.withColumn("positive", F.coalesce("positive", F.lit(False)))


@query("t8_global_view", "SELECT image_id, round(least(1.0, 1024/greatest(width, height)), 9) AS scale, round_even(width*least(1.0, 1024/greatest(width, height)), 0)::INT AS w, round_even(height*least(1.0, 1024/greatest(width, height)), 0)::INT AS h FROM images")
def t8(v):
    s = F.least(F.lit(1.0), F.lit(1024.0) / F.greatest("width", "height"))
    return v.images.select("image_id", F.round(s, 9).alias("scale"), F.rint(F.col("width") * s).cast("int").alias("w"), F.rint(F.col("height") * s).cast("int").alias("h"))


REP = """cl AS (SELECT DISTINCT image_id, CASE WHEN class_id < 5 THEN class_id ELSE class_id + (gt_id % 4)::INT END AS class_id FROM gt),
pr AS (SELECT class_id, count(*) AS n FROM cl GROUP BY 1), fa AS (SELECT class_id, least(4.0, sqrt((SELECT max(n) FROM pr)/n)) AS f FROM pr), rf AS (SELECT image_id, greatest(1, round_even(max(f), 0)::INT) AS copies FROM cl JOIN fa USING (class_id) GROUP BY 1)"""


def rare(v):
    return v.gt.select("image_id", F.when(F.col("class_id") < 5, F.col("class_id")).otherwise(F.col("class_id") + (F.col("gt_id") % 4).cast("int")).alias("class_id"))


@query("t9_rare_class_oversampling", f"WITH {REP} SELECT image_id, unnest(range(0, copies))::INT AS copy FROM rf")
def t9(v):
    return tiles.repeated(tiles.repeat_factors(rare(v), "image_id", 4.0), "copies").select("image_id", "copy")


@query("t10_repeat_views", "SELECT image_id, unnest(range(0, 3))::INT AS copy FROM images WHERE view = 'grid'")
def t10(v):
    return tiles.repeated(v.images.filter("view = 'grid'").withColumn("n", F.lit(3)), "n").select("image_id", "copy")


FOCUS = "(class_id = 0 AND (x2-x1)*(y2-y1) < 50000) OR (class_id = 1 AND (y2-y1)/(x2-x1) > 1.1) OR class_id = 3"


@query("t11_focus_duplication", f"WITH f AS (SELECT image_id, bool_or({FOCUS}) AS focus FROM gt GROUP BY 1) SELECT image_id, unnest(range(0, CASE WHEN focus THEN 2 ELSE 1 END))::INT AS copy FROM f")
def t11(v):
    f = v.gt.groupBy("image_id").agg(F.bool_or(F.expr(FOCUS)).alias("focus"))
    return tiles.repeated(f.withColumn("n", F.when(F.col("focus"), 2).otherwise(1)), "n").select("image_id", "copy")


@query("t12_hard_negatives", f"""WITH d AS (SELECT * FROM det WHERE NOT EXISTS (SELECT 1 FROM gt g WHERE g.image_id = det.image_id AND {sql_iou('det.', 'g.')} >= 0.05)), c AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, det_id) <= 4)
SELECT det_id, image_id, class_id FROM c QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) <= 12""")
def t12(v):
    return tiles.hard_negatives(v.det, v.gt, 0.05, 4, 12).select("det_id", "image_id", "class_id")


@query("t13_systematic_sample", "WITH i AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey)-1 AS i, count(*) OVER () AS n FROM orders), s AS (SELECT DISTINCT floor(k*(n-1)/49.0)::BIGINT AS i FROM range(0, 50) r(k), (SELECT any_value(n) AS n FROM i)) SELECT o_orderkey FROM i JOIN s USING (i)")
def t13(v):
    return tiles.systematic_sample(v.orders, "o_orderkey", 50).select("o_orderkey")


def sql_draw(key: str, letter: str, low: float = 0.0, high: float = 1.0) -> str:
    return f"({low}::DOUBLE+{high - low}::DOUBLE*(CAST(concat('0x', substr(sha256(concat('p:', {key}, '{letter}')), 1, 16)) AS UHUGEINT)::DOUBLE/18446744073709551616.0::DOUBLE))"


def sql_around(cx: str, cy: str, w: str, h: str) -> str:
    return f"{cx}-{w}/2 AS px1, {cy}-{h}/2 AS py1, {cx}+{w}/2 AS px2, {cy}+{h}/2 AS py2"


GT_KEY, NEG_KEY = "gt_id, ':', t", "image_id, ':', no, ':', t"
_D, _N = (lambda k, *a: sql_draw(GT_KEY, k, *a)), (lambda k, *a: sql_draw(NEG_KEY, k, *a))
_P = "{'x1': px1, 'y1': py1, 'x2': px2, 'y2': py2}"


def sql_size(low: str, high: str, a: str, b: str, top: int) -> str:
    return f"least(greatest(CASE WHEN {_N('k')} < 0.2 OR len(g) = 0 THEN {_N(a, 20.0, 240.0)} ELSE (g[pick].{high}-g[pick].{low})*{_N(b, 0.75, 1.25)} END, 12.0::DOUBLE), {top}*0.7::DOUBLE)"


@query("t14_box_proposals", f"""WITH j0 AS (SELECT gt.*, t, greatest(x2-x1, 2) AS w, greatest(y2-y1, 2) AS h FROM gt, range(0, 20) r(t)),
j1 AS (SELECT gt_id, t, x1, y1, x2, y2, {sql_around(f'((x1+x2)/2+{_D("c", -0.07, 0.07)}*w)', f'((y1+y2)/2+{_D("d", -0.07, 0.07)}*h)', f'(w*{_D("a", 0.9, 1.12)})', f'(h*{_D("b", 0.9, 1.12)})')} FROM j0),
j2 AS (SELECT * FROM j1 WHERE {sql_iou('j1.', 'j1.p')} >= 0.6::DOUBLE QUALIFY row_number() OVER (PARTITION BY gt_id ORDER BY t) = 1),
j AS (SELECT 'jitter' AS kind, gt.gt_id AS id, 0 AS no, coalesce(t, -1) AS t, coalesce(px1, gt.x1) AS px1, coalesce(py1, gt.y1) AS py1, coalesce(px2, gt.x2) AS px2, coalesce(py2, gt.y2) AS py2 FROM gt LEFT JOIN j2 USING (gt_id)),
s0 AS (SELECT gt.*, t, x2-x1 AS w, y2-y1 AS h FROM gt, range(0, 7) r(t)),
s1 AS (SELECT gt_id, t, {sql_around(f'((x1+x2)/2+{_D("c", -0.55, 0.55)}*w)', f'((y1+y2)/2+{_D("d", -0.55, 0.55)}*h)', f'(CASE WHEN t = 0 THEN w ELSE w*exp({_D("a", -1.0, 0.7)}) END)', f'(CASE WHEN t = 0 THEN h*0.35::DOUBLE ELSE h*exp({_D("b", -1.0, 0.7)}) END)')} FROM s0),
s2 AS (SELECT gt_id, t, greatest(0.0::DOUBLE, least(px1, 4096)) AS px1, greatest(0.0::DOUBLE, least(py1, 3000)) AS py1, greatest(0.0::DOUBLE, least(px2, 4096)) AS px2, greatest(0.0::DOUBLE, least(py2, 3000)) AS py2 FROM s1),
s AS (SELECT 'scaled' AS kind, gt_id AS id, 0 AS no, t, px1, py1, px2, py2 FROM s2 WHERE px2-px1 >= 2 AND py2-py1 >= 2),
n0 AS (SELECT image_id, no, t, coalesce(g, []) AS g FROM images LEFT JOIN (SELECT image_id, list({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY gt_id) AS g FROM gt GROUP BY 1) USING (image_id), range(0, 3) q(no), range(0, 50) r(t)),
n1 AS (SELECT *, CAST(floor({_N('p')}*len(g)) AS INT)+1 AS pick FROM n0), n2 AS (SELECT *, {sql_size('x1', 'x2', 'a', 'b', 4096)} AS w, {sql_size('y1', 'y2', 'c', 'd', 3000)} AS h FROM n1),
n3 AS (SELECT image_id, no, t, g, (4096-w)*{_N('x')} AS px1, (3000-h)*{_N('y')} AS py1, w, h FROM n2), n4 AS (SELECT *, px1+w AS px2, py1+h AS py2 FROM n3),
n5 AS (SELECT * FROM n4 WHERE len(list_filter(list_transform(g, lambda k: {sql_iou('k.', 'n4.p')}), lambda i: i >= 0.04::DOUBLE)) = 0 QUALIFY row_number() OVER (PARTITION BY image_id, no ORDER BY t) = 1)
SELECT kind, id, CAST(no AS INT) AS no, CAST(t AS INT) AS try, {', '.join(f'round(p{c}, 4) AS {c}' for c in BOX)} FROM (SELECT * FROM j UNION ALL SELECT * FROM s UNION ALL SELECT 'negative', image_id, no, t, px1, py1, px2, py2 FROM n5)""")
def t14(v):
    j, s, n = tiles.jittered_proposals(v.gt, 20, 0.6, "p"), tiles.scaled_proposals(v.gt, 7, 4096.0, 3000.0, "p"), tiles.negative_proposals(v.images, v.gt, 3, 50, 0.04, "p")
    row = lambda d, kind, key, no: d.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), no.alias("no"), "try", *[F.round("p" + c, 4).alias(c) for c in BOX])
    return row(j, "jitter", "gt_id", F.lit(0)).union(row(s, "scaled", "gt_id", F.lit(0))).union(row(n, "negative", "image_id", F.col("no")))


@query("t15_stitch_fragments", """WITH d AS (SELECT * FROM det QUALIFY row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, det_id) <= 40),
p AS (SELECT a.image_id, a.class_id, a.det_id, b.det_id AS oid, least(a.x1,b.x1) AS ux1, least(a.y1,b.y1) AS uy1, greatest(a.x2,b.x2) AS ux2, greatest(a.y2,b.y2) AS uy2, least(a.score,b.score)*0.9::DOUBLE AS score, greatest(a.y2-a.y1, b.y2-b.y1) AS h
 FROM d a JOIN d b ON a.image_id = b.image_id AND a.class_id = b.class_id AND a.det_id <> b.det_id AND (a.y1 < b.y1 OR (a.y1 = b.y1 AND a.det_id < b.det_id)) WHERE (least(a.x2,b.x2)-greatest(a.x1,b.x1))/greatest(least(a.x2-a.x1, b.x2-b.x1), 1e-9::DOUBLE) >= 0.45::DOUBLE AND abs(b.y1-a.y2) <= 300),
q AS (SELECT * FROM p WHERE uy2-uy1 >= 1.35::DOUBLE*h QUALIFY row_number() OVER (PARTITION BY image_id, class_id, ux1, uy1, ux2, uy2 ORDER BY score DESC, det_id, oid) = 1)
SELECT image_id, class_id, det_id, oid, ux1, uy1, ux2, uy2, round(score, 6) AS score FROM q QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id, oid) <= 15""")
def t15(v):
    return tiles.stitch_fragments(v.det, gap=300.0).withColumn("score", F.round("score", 6))


@query("t16_diagnostic_set")
def t16(v):
    return tiles.diagnostic_set(v.gt, v.images, 4, 5)


@query("t17_tile_labels", f"WITH {GRID}, {sql_assign('gr', 0.5)} SELECT gr.image_id, gr.tx, gr.ty, count(gt_id) FILTER (kept) AS labels, coalesce(bool_or(share >= 0.3), false) AS positive FROM gr LEFT JOIN asg a ON a.image_id = gr.image_id AND a.tx = gr.tx AND a.ty = gr.ty GROUP BY ALL")
def t17(v):
    g = tiles.grid_tiles(v.images, 1387, 1516, 2, 3)
    a = tiles.assign_boxes(g, v.gt, 0.5).groupBy("image_id", "tx", "ty").agg(F.count_if("kept").alias("labels"), F.bool_or(F.col("visibility") >= 0.3).alias("positive"))
    return g.join(a, ["image_id", "tx", "ty"], "left").select("image_id", "tx", "ty", F.coalesce("labels", F.lit(0)).alias("labels"), F.coalesce("positive", F.lit(False)).alias("positive"))


@query("t18_repeat_manifest", f"WITH {REP}, s AS (SELECT cl.class_id, count(*) AS presence, sum(copies-1)::BIGINT AS extra FROM cl JOIN rf USING (image_id) GROUP BY 1) SELECT class_id, presence, extra, round((presence+extra)/presence, 6) AS growth FROM s")
def t18(v):
    f = tiles.repeat_factors(rare(v), "image_id", 4.0)
    s = rare(v).distinct().join(f, "image_id").groupBy("class_id").agg(F.count("*").alias("presence"), F.sum((F.col("copies") - 1).cast("bigint")).alias("extra"))
    return s.withColumn("growth", F.round((F.col("presence") + F.col("extra")) / F.col("presence"), 6))
