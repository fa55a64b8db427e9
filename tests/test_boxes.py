"""Literal cases with known answers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybox.functions import columns as C
from tallybox.functions.columns import BOX
from tallybox.operators import fuse, govern, metrics, tiles

BOXES = "det_id long, image_id long, class_id int, x1 double, y1 double, x2 double, y2 double, score double"
TRUTH = "gt_id long, image_id long, class_id int, x1 double, y1 double, x2 double, y2 double"
THREE = [(0, 1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 0, 1.0, 1.0, 11.0, 11.0, 0.8), (2, 1, 1, 1.0, 1.0, 11.0, 11.0, 0.7)]


def image(spark, w=4096.0, h=3000.0):
    return spark.createDataFrame([(1, w, h)], "image_id long, width double, height double")


def test_sliding_tiles_reach_the_edges(spark):
    rows = tiles.sliding_tiles(image(spark), 1024, 0.25).collect()
    assert (0, 0) in {(r.tx, r.ty) for r in rows}
    assert max(r.tx + r.tw for r in rows) == 4096 and max(r.ty + r.th for r in rows) == 3000


def test_grid_tiles(spark):
    rows = tiles.grid_tiles(image(spark), 1387, 1516, 2, 3).collect()
    assert sorted({r.tx for r in rows}) == [0, 1354, 2709] and sorted({r.ty for r in rows}) == [0, 1484]


def test_box_is_clipped_to_its_tile(spark):
    t = spark.createDataFrame([(1, 100, 200, 100, 100)], "image_id long, tx int, ty int, tw int, th int")
    g = spark.createDataFrame([(1, 1, 0, 90.0, 190.0, 160.0, 260.0)], TRUTH)
    r = tiles.assign_boxes(t, g, 0.2).first()
    assert (r.x1, r.y1, r.x2, r.y2) == (0, 0, 60, 60) and r.kept


def test_long_fragment_is_kept(spark):
    t = spark.createDataFrame([(1, 0, 0, 1024, 1024)], "image_id long, tx int, ty int, tw int, th int")
    g = spark.createDataFrame([(1, 1, 0, 100.0, 0.0, 140.0, 3000.0)], TRUTH)
    r = tiles.assign_boxes(t, g, 0.5).first()
    assert (r.x1, r.y1, r.x2, r.y2) == (100, 0, 140, 1024) and r.kept


def test_nms_by_class(spark):
    assert {r.det_id for r in fuse.nms(spark.createDataFrame(THREE, BOXES), 0.5).collect()} == {0, 2}


def test_nms_keeps_a_box_at_the_threshold(spark):
    rows = [(0, 1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 0, 0.0, 0.0, 10.0, 5.0, 0.8)]
    assert fuse.nms(spark.createDataFrame(rows, BOXES), 0.5).count() == 2


def test_wbf_by_class(spark):
    rows = fuse.wbf(spark.createDataFrame(THREE, BOXES), 0.5).collect()
    assert len(rows) == 2 and max(r.score for r in rows) == 0.9
    joined = next(r for r in rows if r.n == 2)
    assert math.isclose(joined.x1, 0.8 / 1.7)


def test_action_scales_about_the_centre(spark):
    d = spark.createDataFrame([(1, 1, 0, 10.0, 20.0, 30.0, 40.0, 0.9)], BOXES)
    a = spark.createDataFrame([(0, 0, 1, 1.0, 2.0, 0.0, 0.0)], "action int, source_class int, target_class int, sx double, sy double, dx double, dy double")
    r = fuse.apply_actions(d, a, F.lit(100.0), F.lit(100.0), 0.05, 0.0).first()
    assert (r.class_id, r.x1, r.y1, r.x2, r.y2, r.score) == (1, 10, 10, 30, 50, 0.9)


def test_shift_counts_in_box_sizes(spark):
    d = spark.createDataFrame([(10.0, 20.0, 30.0, 40.0)], "x1 double, y1 double, x2 double, y2 double")
    r = d.select(C.scale("", 1, 1, 0.5, -0.5).alias("b")).select("b.*").first()
    assert tuple(r) == (20, 10, 40, 30)


def test_rounding_is_half_even(spark):
    d = spark.createDataFrame([(0.5, 1.5, 2.5, 3.5)], "x1 double, y1 double, x2 double, y2 double")
    assert tuple(d.select(C.round_box("").alias("b")).select("b.*").first()) == (0, 2, 2, 4)


def test_gold_case_duplicate_and_stray(spark):
    g = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 10.0)], TRUTH)
    d = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (2, 1, 0, 0.0, 0.0, 10.0, 10.0, 0.8), (3, 1, 0, 50.0, 50.0, 60.0, 60.0, 0.1)], BOXES)
    f = metrics.class_figures(metrics.label(d, g, 0.5), g, ["class_id"]).first()
    assert (f.tp, f.fp, f.n_gt) == (1, 2, 1) and math.isclose(f.ap, 1.0)


def test_wrong_class_scores_zero(spark):
    g = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 10.0)], TRUTH)
    d = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0, 0.9)], BOXES)
    f = metrics.class_figures(metrics.label(d, g, 0.5), g, ["class_id"]).first()
    assert (f.tp, f.ap) == (0, 0.0)


def test_average_precision_equals_the_plain_form(spark):
    labels, n_gt = [0, 1, 0, 1], 2
    rows = [(i, 0, 1 - i / 10, t) for i, t in enumerate(labels)]
    lab = spark.createDataFrame(rows, "det_id long, class_id int, score double, tp int")
    got = metrics.average_precision(lab, spark.createDataFrame([(0, n_gt)], "class_id int, n_gt long"), ["class_id"]).first().ap
    points, hit = [], 0
    for k, t in enumerate(labels, 1):
        hit += t
        points.append((hit / n_gt, hit / k))
    want = sum(max((p for r, p in points if r >= i * 0.01), default=0.0) for i in range(101)) / 101
    assert math.isclose(got, want)


def test_greedy_match_takes_the_best_free_truth(spark):
    g = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 10.0), (2, 1, 0, 0.0, 2.0, 10.0, 12.0)], TRUTH)
    d = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (2, 1, 0, 0.0, 0.0, 10.0, 10.0, 0.8)], BOXES)
    pairs = fuse.pairs_at(d, g, 0.5)
    assert {(r.det_id, r.gt_id) for r in fuse.match_greedy(pairs).collect()} == {(1, 1), (2, 2)}
    assert {(r.det_id, r.gt_id) for r in fuse.match_voc(pairs).collect()} == {(1, 1)}


def test_six_violations(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 9, 0, 0.0, 0.0, 1.0, 1.0, 0.5), (2, 1, 9, 0.0, 0.0, 1.0, 1.0, 0.5), (3, 1, 0, 0.0, 0.0, 1.0, 1.0, nan), (4, 1, 0, 0.0, 0.0, inf, 1.0, 0.5), (5, 1, 0, 0.0, 0.0, 200.0, 1.0, 0.5), (6, 1, 0, 5.0, 0.0, 1.0, 1.0, 0.5), (7, 1, 0, 0.0, 0.0, 1.0, 1.0, 0.5)]
    p = govern.box_problem(F.lit(100.0), F.lit(100.0), F.col("image_id") == 1, F.col("class_id") == 0)
    got = {r.det_id: r.p for r in spark.createDataFrame(rows, BOXES).select("det_id", p.alias("p")).collect()}
    assert got == {1: "unknown_image", 2: "unknown_class", 3: "score", 4: "box_not_finite", 5: "box_outside", 6: "box_empty", 7: None}


def test_duplicate_chain_is_one_group(spark):
    rows = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["b", "c"]), (4, ["c"]), (5, ["z"])], "id long, keys array<string>")
    g = govern.connected_groups(rows.select("id"), govern.key_edges(rows, "id"))
    assert {r.id: r.head for r in g.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}


def test_shared_group_is_leakage(spark):
    m = spark.createDataFrame([("train", "p1", "g1"), ("val", "p2", "g1")], "split string, path string, grp string")
    assert [(r.kind, r.key) for r in govern.split_violations(m).collect()] == [("shared_group", "g1")]


def crowd(n, seed, images=1, spread=3000):
    """Boxes of several sizes in few images, with ties in score."""
    r = np.random.default_rng(seed)
    x, y = r.integers(0, spread, (2, n)).astype(float)
    w, h = (np.exp(r.normal(4, 0.5, (2, n)))).round() + 1
    boxes = np.stack([x, y, x + w, y + h], 1).tolist()
    return [(i, i % images, 0, *boxes[i], s) for i, s in enumerate((r.integers(1, 500, n) / 500).tolist())]


def rows(df, *columns):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def test_cells_keep_the_folds_rows_of_a_large_group(spark):
    d = spark.createDataFrame(crowd(15_000, 3, spread=500), BOXES).cache()
    got = rows(fuse.agnostic_nms(d, 0.4, method="cells"), "det_id", "score")
    assert got == rows(fuse.agnostic_nms(d, 0.4), "det_id", "score") and 300 < len(got) < 5_000


@pytest.mark.parametrize("threshold", [0.0, 0.2, 0.7])
def test_cells_equal_the_folds(spark, threshold):
    d = spark.createDataFrame([*crowd(1_500, 4, 3, 500), (9001, 0, 0, 0.0, 0.0, 5000.0, 5000.0, 0.3), (9002, 0, 0, 7.0, 7.0, 7.0, 7.0, 0.9), (9003, 2, 1, -50.0, -20.0, 30.0, 40.0, 0.4)], BOXES).cache()
    assert rows(fuse.nms(d, threshold, method="cells"), "det_id") == rows(fuse.nms(d, threshold), "det_id")
    assert rows(fuse.nms(d, threshold, ["image_id"], limit=7, method="cells"), "det_id") == rows(fuse.nms(d, threshold, ["image_id"], limit=7), "det_id")
    assert rows(fuse.wbf(d, threshold, method="cells"), "image_id", "class_id", "cluster", *BOX, "score", "n") == rows(fuse.wbf(d, threshold), "image_id", "class_id", "cluster", *BOX, "score", "n")
    g = d.filter("det_id % 3 = 0").select(F.col("det_id").alias("gt_id"), "image_id", "class_id", *BOX)
    pairs = fuse.pairs_at(d.filter("det_id % 3 <> 0"), g, max(threshold, 0.05))
    assert rows(fuse.match_greedy(pairs, method="cells"), "det_id", "gt_id") == rows(fuse.match_greedy(pairs), "det_id", "gt_id")
    with pytest.raises(ValueError):
        fuse.nms(d, threshold, method="other")
