"""The SQL surface, profiles as rows, and methods by name."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallybox.functions import columns as C
from tallybox.functions import sql
from tallybox.operators import fuse, profiles, refine, tiles

BOXES = "det_id long, image_id long, class_id int, x1 double, y1 double, x2 double, y2 double, score double"
ROWS = [(1, 1, 0, 10.0, 20.0, 30.0, 40.0, 0.9), (2, 1, 0, 12.0, 18.0, 33.0, 44.0, 0.8), (3, 1, 1, 0.0, 0.0, 5.0, 5.0, 0.7), (4, 1, 0, 90.0, 90.0, 130.0, 95.0, 0.4)]


def test_boxes_from_sql_alone(spark):
    sql.register(spark)
    spark.createDataFrame(ROWS, BOXES).createOrReplaceTempView("surface_boxes")
    pair = "a.x1, a.y1, a.x2, a.y2, b.x1, b.y1, b.x2, b.y2"
    got = spark.sql(f"SELECT a.det_id AS a, b.det_id AS b, box_iou({pair}) AS iou, box_ioa({pair}) AS ioa, box_giou_loss({pair}) AS giou FROM surface_boxes a JOIN surface_boxes b ON a.det_id < b.det_id")
    assert "Python" not in got._jdf.queryExecution().toString()
    d = spark.table("surface_boxes")
    both = d.join(d.select(F.col("det_id").alias("b"), *[F.col(c).alias("o" + c) for c in C.BOX])).filter("det_id < b")
    want = {(r.det_id, r.b): (r.iou, r.ioa, r.giou) for r in both.select("det_id", "b", C.iou("", "o").alias("iou"), C.ioa("", "o").alias("ioa"), C.giou_loss("", "o").alias("giou")).collect()}
    assert {(r.a, r.b): (r.iou, r.ioa, r.giou) for r in got.collect()} == want
    moved = spark.sql("SELECT det_id, box_scale(x1, y1, x2, y2, 1.2, 0.5, 0.1, -0.2) AS s, box_clip(x1, y1, x2, y2, 100, 92) AS c, box_to_yolo(x1, y1, x2, y2, 100, 92) AS y, box_larger_than(x1, y1, x2, y2, 6) AS l FROM surface_boxes").collect()
    same = d.select("det_id", C.scale("", 1.2, 0.5, 0.1, -0.2).alias("s"), C.clip("", 100.0, 92.0).alias("c"), C.to_yolo("", 100.0, 92.0).alias("y"), C.larger_than("", 6.0).alias("l")).collect()
    assert [tuple(map(pytest.approx, r.s)) + tuple(map(pytest.approx, r.y)) for r in moved] == [tuple(r.s) + tuple(r.y) for r in same]
    assert [(r.c, r.l) for r in moved] == [(r.c, r.l) for r in same]


def test_tiles_from_sql_alone(spark):
    sql.register(spark)
    images = spark.createDataFrame([(1, 4096.0, 3000.0), (2, 500.0, 1024.0)], "image_id long, width double, height double")
    images.createOrReplaceTempView("surface_images")
    for name, f in (("sliding_tiles", tiles.sliding_tiles), ("strip_tiles", tiles.strip_tiles)):
        got = spark.sql(f"SELECT image_id, t.* FROM surface_images, LATERAL {name}(CAST(width AS INT), CAST(height AS INT), 1024, 0.25) AS t")
        assert sorted(map(tuple, got.collect())) == sorted(tuple(int(x) for x in r) for r in f(images, 1024, 0.25).select("image_id", "tx", "ty", "tw", "th").collect())


def test_profiles_are_checked_and_scored_together(spark):
    docs = {"plain": "{}", "fitted": json.dumps({"score_blend": 0.5, "linear": {"intercept": 1.0, "coefficients": {"sources": 2.0}}, "scaler": {"mean": {"sources": 1.0}, "scale": {"sources": 4.0}}}),
            "text": "not json", "blend": '{"score_blend": 1.5}', "feature": '{"linear": {"coefficients": {"colour": 1, "area": 2}}}', "scale": '{"scaler": {"scale": {"ab_iou": 0}}}', "donors": '{"refinement": {"minimum_donors": 1}}', "iou": '{"refinement": {"minimum_anchor_iou": -1}}'}
    p = profiles.parsed(spark.createDataFrame(list(docs.items()), "profile string, json string"))
    assert {r.profile: r.problem for r in p.collect()} == {"plain": None, "fitted": None, "text": "not_json", "blend": "score_blend", "feature": "unknown feature area, colour", "scale": "scale of ab_iou", "donors": "minimum_donors", "iou": "minimum_anchor_iou"}
    d = spark.createDataFrame([(1, 0.4, *[0.0] * 9)], ", ".join(["det_id long, score double", *[f"{f} double" for f in refine.FEATURES]])).withColumn("sources", F.lit(3.0))
    got = {r.profile: r.score for r in profiles.scored(d, p.filter("problem is null")).collect()}
    quality = refine.rescored(d, {"sources": (1.0, 4.0, 2.0)}, 1.0, 0.5).first().score
    assert got == {"plain": 0.4, "fitted": pytest.approx(quality)}
    with pytest.raises(ValueError, match="profile .*: "):
        profiles.scored(d, p)


def test_methods_by_name(spark):
    d = spark.createDataFrame(ROWS, BOXES)
    assert [fuse.postprocess(d, m, 0.3).count() for m in ("none", "nms", "vote", "wbf")] == [4, 3, 3, 3]
    with pytest.raises(ValueError):
        fuse.postprocess(d, "soft", 0.3)
