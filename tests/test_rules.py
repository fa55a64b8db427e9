"""Rules that the queries' SQL repeats, on small cases worked out by hand or in plain Python, and the ordered passes against numpy."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybox.functions import columns as C
from tallybox.operators import audit, crossfit, fuse, govern, metrics, order, rank, refine
from tallybox.sources import formats
from tallybox.streaming import caches

CAND = "det_id long, image_id long, class_id int, model string, is_global boolean, touches_edge boolean, x1 double, y1 double, x2 double, y2 double, score double"


def cand(spark, rows):
    return spark.createDataFrame(rows, CAND)


def test_evidence_caps_each_model_and_view(spark):
    anchor = cand(spark, [(1, 1, 0, "a", False, False, 0.0, 0.0, 100.0, 100.0, 0.5)])
    rows = [(10, 1, 0, "a", False, False, 0.0, 0.0, 100.0, 90.0, 0.4), (11, 1, 0, "a", False, True, 0.0, 0.0, 100.0, 80.0, 0.9), (12, 1, 0, "a", True, False, 0.0, 0.0, 100.0, 95.0, 0.3),
            (20, 1, 0, "b", False, True, 0.0, 0.0, 100.0, 100.0, 0.2), (21, 1, 0, "b", True, False, 0.0, 0.0, 80.0, 100.0, 0.6), (22, 1, 1, "b", True, False, 0.0, 0.0, 100.0, 100.0, 0.9)]
    r = refine.evidence(anchor, cand(spark, rows), 1000.0, 500.0).first()
    assert [(x.model, x.is_global) for x in r.reps] == [("a", False), ("a", True), ("b", False), ("b", True)]
    assert r.sources == 4 and r.both_models == 1 and r.edge_only == 0
    assert r.ab_iou == pytest.approx(0.95)  # the whole-image box of a with the tile box of b
    assert r.coherence == pytest.approx((90 / 95 + 0.8) / 2)
    pairs = [90 / 95, 0.9, 7200 / 9800, 0.95, 7600 / 9900, 0.8]
    assert r.dispersion == pytest.approx(np.median(1 - np.array(pairs)))
    assert r.log_area == pytest.approx(math.log(10000 / 500000)) and r.log_aspect == 0


def test_evidence_without_candidates(spark):
    anchor = cand(spark, [(1, 1, 0, "a", False, False, 0.0, 0.0, 50.0, 100.0, 0.0)])
    r = refine.robust_refinement(refine.evidence(anchor, anchor.limit(0), 100.0, 100.0), 100.0, 100.0).first()
    assert (r.sources, r.both_models, r.ab_iou, r.coherence, r.dispersion, r.edge_only, r.reason) == (0, 0, 0, 0, 1, 0, "missing_model")
    assert r.log_score == pytest.approx(math.log(1e-12)) and r.log_aspect == pytest.approx(math.log(0.5))


def test_refinement_moves_only_with_good_evidence(spark):
    anchors = cand(spark, [(k, k, 0, "a", False, False, 0.0, 0.0, 100.0, 100.0, 0.5) for k in (1, 2, 3, 4)])
    b = lambda i, image, edge, whole, x: (i, image, 0, "b" if i % 2 else "a", whole, edge, x, 0.0, 100.0 + x, 100.0, 0.64)
    rows = [b(10, 1, False, False, 4.0), b(11, 1, False, False, 4.0), b(13, 1, False, True, 6.0), b(20, 2, True, False, 2.0), b(21, 2, True, False, 2.0), b(30, 3, False, False, 30.0), b(31, 3, False, False, 0.0), b(40, 4, False, False, 1.0)]
    got = {r.det_id: (r.reason, r.x1, r.x2) for r in refine.robust_refinement(refine.evidence(anchors, cand(spark, rows), 1000.0, 1000.0), 1000.0, 1000.0).collect()}
    assert got[1][0] == "refined" and got[1][1:] == (pytest.approx(4.0), pytest.approx(104.0))
    assert [got[k] for k in (2, 3, 4)] == [("no_local_donor", 0.0, 100.0), ("dispersed", 0.0, 100.0), ("missing_model", 0.0, 100.0)]


def test_score_deltas(spark):
    cols = "det_id long, class_id int, score double, both_models double, ab_iou double, has_views boolean, coherence double, sources double, edge_only double"
    d = spark.createDataFrame([(1, 0, 0.5, 1.0, 0.8, True, 1.0, 4.0, 0.0), (2, 0, 0.9, 0.0, 0.0, False, 0.0, 1.0, 1.0), (3, 0, 0.95, 1.0, 1.0, False, 0.0, 2.0, 0.0)], cols)
    got = {r.det_id: r.score for r in refine.consensus_delta(d).collect()}
    raw = {1: 0.5 * math.exp(0.18 * 0.5 + 0.08 + 0.05), 2: 0.9 * math.exp(-0.1), 3: 0.95 * math.exp(0.18 + 0.025)}
    assert got == {k: pytest.approx(v / raw[3]) for k, v in raw.items()}
    got = {r.det_id: r.score for r in refine.view_invariant_delta(d).collect()}
    raw = {1: 0.5 * math.exp(0.08 * 0.5 * (2 * 0.25 - 1)), 2: 0.9, 3: 0.95 * math.exp(0.08 * (2 * 0.75 - 1))}
    assert got == {k: pytest.approx(v) for k, v in raw.items()}


def test_fusion_takes_the_box_of_the_higher_score(spark):
    cols = "det_id long, image_id long, class_id int, x1 double, y1 double, x2 double, y2 double, score double"
    a = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 100.0, 100.0, 0.4), (2, 1, 0, 500.0, 0.0, 600.0, 100.0, 0.8)], cols)
    b = spark.createDataFrame([(11, 1, 0, 0.4, 0.0, 110.0, 100.0, 0.6), (12, 1, 0, 500.0, 0.0, 590.0, 100.0, 0.6), (13, 1, 0, 900.0, 900.0, 900.4, 950.0, 0.9)], cols)
    got = {r.det_id: (r.x1, r.x2, round(r.score, 6)) for r in fuse.source_aware_fuse(a, b, 0.5, 1.2, 0.5, 0.9, 0.6).collect()}
    assert got == {1: (0.0, 110.0, 0.648), 2: (500.0, 600.0, 0.96)}  # the one left over is no pixel wide
    vote = {r.det_id: r.x2 for r in fuse.source_aware_fuse(a, b, 0.5, 1.2, 0.5, 0.9, 0.6, "vote").collect()}
    assert vote[1] == round((100 * 0.4 + 110 * 0.54) / 0.94)
    with pytest.raises(ValueError):
        fuse.source_aware_fuse(a, b, 0.5, 1.2, 0.5, 0.9, 0.6, "other")


def test_near_duplicates_need_texture_and_different_pixels(spark):
    r = random.Random(1)
    base = [float(r.randrange(-90, 90) or 1) for _ in range(64)]
    small = min(range(64), key=lambda i: abs(base[i]))
    one = [*base]
    one[small] = -1.0 if base[small] > 0 else 1.0
    rows = [(1, base, 64), (2, one, 64), (3, base, 64), (4, one, 32), (5, [1.0] * 64, 64), (6, [1.0] * 63 + [2.0], 64), (7, [-x if i < 5 else x for i, x in enumerate(base)], 64)]
    prints = govern.fingerprints(spark.createDataFrame(rows, "id long, thumb array<double>, width int"))
    got = {(x.a, x.b): x.distance for x in govern.near_duplicate_pairs(prints).collect()}
    assert got == {(1, 2): 1, (2, 3): 1}
    groups = govern.group_names(govern.connected_groups(prints.select("id"), govern.near_duplicate_pairs(prints).select("a", "b")))
    assert {x.id: x.head for x in groups.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}
    assert len({x.name for x in groups.collect()}) == 5


def test_splits_keep_groups_and_classes_apart(spark):
    groups = spark.createDataFrame([(f"g{i}", 4, 3 * (i % 2), 3 * (1 - i % 2)) for i in range(8)], "grp string, n int, c0 int, c1 int")
    val = {r.grp: r.val for r in govern.best_split(groups, ["c0", "c1"], 0.25, 60, 3).collect()}
    assert len(val) == 8 and {int(g[1:]) % 2 for g, v in val.items() if v} == {0, 1} == {int(g[1:]) % 2 for g, v in val.items() if not v}
    parts = {r.grp: r.part for r in govern.three_way_split(groups, ["c0", "c1"], 0.25, 0.25, 60, 3).collect()}
    assert len(parts) == 8 and {g for g, p in parts.items() if p == "val"} == {g for g, v in val.items() if v}
    assert {"train", "calibration", "val"} == set(parts.values())
    assert govern.best_split(groups.limit(0), ["c0", "c1"], 0.25, 5, 3).count() == 0


def test_running_sums_and_ranks_equal_numpy(spark):
    r = np.random.default_rng(1)
    n = 3000
    key, value = np.where(r.random(n) < 0.4, 0, r.integers(0, 5, n)), r.integers(0, 40, n)
    d = spark.createDataFrame([(int(i), int(k), float(v)) for i, (k, v) in enumerate(zip(key, value))], "id long, k int, v double").repartition(7)
    got = {x.id: (x.s, x.t) for x in order.running_sums(d, ["k"], [F.desc("v"), F.asc("id")], {"s": F.col("v")}, {"t": "s"}).collect()}
    for k in range(5):
        at = np.flatnonzero(key == k)
        at = at[np.lexsort((at, -value[at]))]
        assert [got[i] for i in at.tolist()] == [(s, float(value[at].sum())) for s in np.cumsum(value[at]).astype(float).tolist()]
    q = {(x.k, x.q): x.quantile for x in order.quantiles(d, ["k"], "v", [0.0, 0.1, 0.5, 0.99]).collect()}
    assert q == {(k, p): pytest.approx(np.quantile(value[key == k], p)) for k in range(5) for p in (0.0, 0.1, 0.5, 0.99)}
    p = {x.id: x.p for x in rank.with_percentile(d, ["k"], "v", "p").collect()}
    at = np.flatnonzero(key == 2)
    assert [p[i] for i in at.tolist()] == [pytest.approx(((value[at] < v).sum() + ((value[at] == v).sum() - 1) / 2 + 0.5) / len(at)) for v in value[at]]
    assert {x.id: x.i for x in order.row_numbers(d, [F.asc("id")], "i").collect()} == {i: i + 1 for i in range(n)}
    rows = audit.percentiles(d, ["k"], ["v", "id"], [50]).collect()
    assert len(rows) == 10


def test_envelope_and_average_precision_equal_plain_python(spark):
    r = random.Random(4)
    rows = [(i, i % 2, round(r.random(), 2), int(r.random() < 0.4)) for i in range(400)]
    d = spark.createDataFrame(rows, "det_id long, class_id int, score double, tp int")
    totals = spark.createDataFrame([(0, 90), (1, 120), (2, 5), (3, 0)], "class_id int, n_gt long")
    got = {x.class_id: x.ap for x in metrics.average_precision(d, totals, ["class_id"]).collect()}
    env = {x.det_id: (x.tp, x.fp, x.envelope) for x in metrics.cumulative_envelope(d, ["class_id"]).collect()}
    for c, n in ((0, 90), (1, 120)):
        mine = sorted((x for x in rows if x[1] == c), key=lambda x: (-x[2], x[0]))
        tp = np.cumsum([x[3] for x in mine])
        precision, recall = tp / np.arange(1, len(mine) + 1), tp / n
        assert got[c] == pytest.approx(np.mean([precision[recall >= i * 0.01].max(initial=0) for i in range(101)]))
        best = np.maximum.accumulate(precision[::-1])[::-1]
        assert [env[x[0]] for x in mine] == [(int(t), i + 1 - int(t), pytest.approx(b)) for i, (t, b) in enumerate(zip(tp, best))]
    assert got[2] == 0 and got[3] is None


def test_report_of_the_gold_cases(spark):
    cols = "det_id long, image_id long, class_id int, x1 double, y1 double, x2 double, y2 double, score double"
    gt = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 10.0)], "gt_id long, image_id long, class_id int, x1 double, y1 double, x2 double, y2 double")
    pred = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (2, 1, 0, 50.0, 50.0, 60.0, 60.0, 0.1)], cols)
    one = {r.class_id: r for r in metrics.report(pred, gt, operating_threshold=0.5, tail=(0, 3)).collect()}
    assert all(one[k][c] == pytest.approx(1.0) for k in (0, -1, -2) for c in ("ap50", "ap75", "map", "precision", "recall", "fbeta")) and one[-1].fp_per_image == 0
    high = spark.createDataFrame([(0, 0.95)], "class_id int, threshold double")
    cut = {r.class_id: r for r in metrics.report(pred, gt, high).collect()}
    assert cut[0].ap50 == pytest.approx(1.0) and cut[0].recall == 0
    wrong = {r.class_id: r for r in metrics.report(pred.withColumn("class_id", F.lit(1)), gt, images=spark.range(1, 5).toDF("image_id")).collect()}
    assert wrong[-1].ap50 == 0 and wrong[-1].fp_per_image == pytest.approx(0.5)


def test_calibration_methods(spark):
    d = spark.createDataFrame([(1, 0, 0.5, True, True), (1, 0, 0.25, False, False), (1, 1, 0.9, True, False)], "image_id long, class_id int, score double, p boolean, q boolean")
    by = lambda m, a: [r[0] for r in d.select(rank.group_calibration(m, a, ("p", "q"))).collect()]
    assert sorted(by("class_max", 1.0)) == pytest.approx([0.5, 1.0, 1.0])
    assert sorted(by("image_max", 1.0)) == pytest.approx(sorted([0.5 / 0.9, 0.25 / 0.9, 1.0]))
    assert sorted(by("image_count", 0.0)) == pytest.approx([0.25, 0.5, 0.9]) and max(by("class_count", 1.0)) == 1.0
    assert sorted(by("unsupported", 0.5)) == pytest.approx([0.125, 0.5, 0.9]) and sorted(by("all_supported", 0.5)) == pytest.approx([0.25, 0.25, 0.9])


def test_name_rules(spark):
    names = ["coil7-Raw12_3", "coil7_RAW13", "img_02_425000_0017", "img_x_1", "C12a_V3_F9", "plain"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(C.group_key(F.col("n")).alias("g"), C.source_keys(F.col("n")).alias("k")).collect()
    assert [r.g for r in got] == ["coil7", "coil7", "img_02_425000", "img_x_1", "C12a_V3_F9", "plain"]
    assert [r.k for r in got] == [["raw:coil7"], ["raw:coil7"], [], [], ["candidate_c:c12a"], []]


def test_predictions_in_lines_and_arrays(spark, tmp_path):
    p = lambda i: {"image_id": str(i), "category_name": "c", "bbox": [1, 2, 3, 4], "score": 0.5}
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed" / "a.json").write_text(json.dumps(p(1)) + "\n" + json.dumps([p(2), p(3)]) + "\n\n")
    assert sorted(r.image_id for r in formats.read_predictions(spark, str(tmp_path / "mixed")).collect()) == ["1", "2", "3"]
    (tmp_path / "whole.json").write_text(json.dumps([p(4), p(5)], indent=1))
    assert formats.read_predictions(spark, str(tmp_path / "whole.json"), whole_files=True).count() == 2


def test_strict_annotations_fail_and_signatures_differ(spark, tmp_path):
    boxes = spark.createDataFrame([("i1", 100, 100, [("c0", 1.0, 1.0, 120.0, 50.0), ("other", 1.0, 1.0, 5.0, 5.0), ("c0", 9.0, 9.0, 9.0, 20.0)])], "filename string, width int, height int, objects array<struct<name:string,x1:double,y1:double,x2:double,y2:double>>")
    formats.write_voc(boxes, str(tmp_path / "voc"), files=1)
    assert [(r.class_name, r.x2) for r in formats.read_voc(spark, str(tmp_path / "voc"), ["c0"]).collect()] == [("c0", 100.0)]
    with pytest.raises(Exception, match="bad object in i1"):
        formats.read_voc(spark, str(tmp_path / "voc"), ["c0"], strict=True).collect()
    assert caches.signature(a=1, b=2) == caches.signature(b=2, a=1) != caches.signature(a=1, b=3)


def test_matched_subset_equals_greedy_by_distance(spark):
    r = np.random.default_rng(3)
    t, p = r.normal(size=(25, 2)), np.concatenate([r.normal(size=(60, 2)), r.normal(size=(3, 2)) + 40])
    rows = lambda x, first: spark.createDataFrame([(first + i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, f1 double, f2 double")
    got = {x.target: x.partner for x in crossfit.matched_subset(rows(t, 0), rows(p, 1000), "id", ["f1", "f2"]).collect()}
    both = np.concatenate([t, p])
    q = np.quantile(both, [0.25, 0.5, 0.75], axis=0)
    z = (both - q[1]) / (q[2] - q[0])
    d = np.linalg.norm(z[:25, None] - z[None, 25:], axis=2)
    want, used = {}, set()
    for at in np.argsort(d, axis=None):
        i, j = divmod(int(at), d.shape[1])
        if i not in want and j not in used:
            want[i] = 1000 + j
            used.add(j)
    assert got == want
    assert crossfit.matched_subset(rows(t[:0], 0), rows(p, 1000), "id", ["f1", "f2"]).count() == 0


def test_beta_policy_keeps_blends_that_lose_nowhere(spark):
    r = random.Random(6)
    rows = []
    for i in range(300):
        tp = int(r.random() < 0.5)
        good = 0.5 + 0.4 * tp + 0.05 * r.random()
        rows.append((i, i % 2, "ab"[i // 2 % 2], tp, r.random(), good if i % 2 == 0 else 1 - good))
    d = spark.createDataFrame(rows, "det_id long, class_id int, view string, tp int, score double, prediction double")
    totals = d.filter("tp = 1").groupBy("view", "class_id").agg(F.count("*").alias("n_gt"))
    out = crossfit.beta_sweep(d, totals, [0.0, 0.5, 1.0], {"a": 0.6, "b": 0.4}).collect()
    best = {x.class_id: x for x in out if x.chosen}
    assert best[0].beta == 1.0 and best[0].weighted_ap == pytest.approx(1.0) and best[1].beta == 0.0 and best[1].worst_delta == 0
    assert len(out) == 6


def test_constrained_fit_and_folds(spark):
    r = random.Random(2)
    rows = [(i, i % 3, float(x), float(r.random()), float(x + r.gauss(0, 0.2) > 0.5), 1.0) for i in range(240) for x in [r.random()]]
    d = spark.createDataFrame(rows, "det_id long, fold int, x double, noise double, label double, weight double")
    fit = {x.name: x.value for x in crossfit.constrained_logistic(d.withColumn("minus", -F.col("x")), ["minus", "noise"], "label", "weight", [0.0, None]).collect()}
    assert fit["minus"] == 0.0 and set(fit) == {"minus", "noise", "intercept"}
    out = crossfit.out_of_fold(d, ["x", "noise"], "label", "weight", 3, "classifier").collect()
    assert len(out) == 240 and np.mean([(x.prediction > 0.5) == bool(x.label) for x in out]) > 0.75


def test_scope_rules(spark):
    runs = spark.createDataFrame([(1, "final_holdout", False, 0, "a", None), (2, "final_holdout", False, 0, "a", "a"), (3, "dev", True, 0, None, None), (4, "val", True, 0, None, None), (5, "final_holdout", True, -1, "a", "a")], "run int, role string, tune boolean, row_limit int, frozen string, signature string")
    assert [x.p for x in runs.orderBy("run").select(govern.scope_problem().alias("p")).collect()] == ["not_frozen", None, None, "tuned", "negative_limit"]


def test_caches_of_one_object_and_their_problems(spark, tmp_path):
    box = {"bbox": [0.0, 0.0, 1.0, 1.0], "score": 0.5, "class_id": 0, "touches_internal_edge": False, "is_global": False, "det_id": 1}
    images = lambda *ids: {i: {"image_size": [9, 9], "candidates": [box]} for i in ids}
    for name, j in (("good", {"signature": {"conf": 0.1}, "images": images("a", "b")}), ("turned", {"signature": {"conf": 0.1}, "images": images("d", "c")}), ("other", {"signature": {"conf": 0.2}, "images": images("e")}), ("none", {"signature": {}})):
        (tmp_path / f"{name}.json").write_text(json.dumps(j))
    got = {r.file.rsplit("/", 1)[1]: r.problem for r in formats.legacy_problems(spark, str(tmp_path), {"conf": 0.1}).collect()}
    assert got == {"good.json": None, "turned.json": "not_sorted", "other.json": "signature", "none.json": "no_images"}
    assert sorted(r.image_id for r in formats.read_legacy_cache(spark, str(tmp_path), {"conf": 0.1}, strict=False).collect()) == ["a", "b"]
    with pytest.raises(Exception, match="not_sorted|signature|no_images"):
        formats.read_legacy_cache(spark, str(tmp_path), {"conf": 0.1}).collect()


def test_header_options_and_grounding_lists(spark, tmp_path):
    head = {"type": "candidate_cache_header", "schema": 3, "weights_sha256": "w", "classes": ["a", "b"], "source": "s", "options": {"conf": 0.00001, "tta": True, "tile_layout": "grid"}}
    (tmp_path / "c.jsonl").write_text(json.dumps(head) + "\n" + json.dumps({"image_id": "i", "image_size": [1, 1], "candidates": []}))
    want = {"schema": 3, "weights_sha256": "w", "classes": ["b", "a"]}
    got = {r.field: r.actual for r in formats.header_problems(formats.read_header(spark, str(tmp_path)), want, {"conf": 1e-5, "tta": False, "tile_layout": "grid", "batch": 1}).collect()}
    assert got == {"classes": '["a","b"]', "options.tta": "true", "options.batch": None}
    full = {"visible": "v", "infrared": "i", "depth": "d", "query": "q"}
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a.json").write_text(json.dumps([{**full, "id": "x", "bbox": [0.1, 0.1, 0.2, 0.2]}, {**full, "query_id": "y"}, {**full, "depth": None}, {**full, "bbox": [0.5, 0, 0.4, 1]}]))
    (tmp_path / "g" / "b.json").write_text(json.dumps({"k": {**full, "bbox": [0, 0, 1, 1]}}))
    ids = {r.sample_id: r.problem for r in formats.read_grounding(spark, str(tmp_path / "g")).collect()}
    assert ids == {"x": None, "y": None, "2": "depth", "3": "bbox", "k": None}
    assert {r.sample_id for r in formats.read_grounding(spark, str(tmp_path / "g"), require_bbox=True).filter("problem = 'bbox'").collect()} == {"y", "3"}


def test_nearest_in_prefix_equals_plain_search(spark, monkeypatch):
    from tallybox.operators import support

    r = np.random.default_rng(8)
    v = r.normal(size=(120, 5))
    v[50:60], v[3] = v[40:50], 0  # equal neighbours, and one without a direction
    rows = [(i, "ab"[i % 7 == 0], x.tolist()) for i, x in enumerate(v)]
    d = spark.createDataFrame(rows, "id long, p string, v array<double>")
    u = v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    want = {}
    for i, p, _ in rows[:60]:
        near = [j for j, o, _ in rows[30:] if o == p]
        if i != 3 and near:
            s = np.array([(u[i] * u[j]).sum() for j in near])
            want[i] = near[int(np.argmax(s))]
    for block in (4096, 7):
        monkeypatch.setattr(support, "BLOCK", block)
        got = {x.id: x.near for x in support.nearest_in_prefix(d.filter("id < 60"), d.filter("id >= 30"), "p", "id", "v").collect()}
        assert got == want
    assert support.nearest_in_prefix(d.limit(0), d, "p", "id", "v").count() == 0
