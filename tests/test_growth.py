"""Steps whose work must not grow faster than their rows."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from tallybox.operators import fuse, match, metrics, refine, sets, tiles

BOXES = "det_id long, image_id long, class_id int, x1 double, y1 double, x2 double, y2 double, score double"


def boxes(spark, n, seed=1):
    """n boxes of one image and class."""
    r = np.random.default_rng(seed)
    at, size = r.integers(0, 3000, (n, 2)), r.integers(60, 240, (n, 2))
    rows = [(i, 1, 0, float(x), float(y), float(x + w), float(y + h), float(s)) for i, ((x, y), (w, h), s) in enumerate(zip(at.tolist(), size.tolist(), r.random(n).tolist(), strict=True))]
    return spark.createDataFrame(rows, BOXES)


def test_two_levels_of_an_ordered_digest(spark, monkeypatch):
    from hashlib import sha256

    monkeypatch.setattr(sets, "FAN", 4)
    sha = lambda s: sha256(s.encode()).hexdigest()
    for n in (0, 3, 50):
        level = [sha(str(i)) for i in range(n)]
        for _ in range(2):
            level = [sha("".join(level[i:i + 4])) for i in range(0, len(level), 4)]
        d = spark.range(n).select(F.col("id").alias("k"))
        assert sets.ordered_digest(d, ["k"], [F.asc("k")], levels=2).first()["digest"] == max(level, default=None)


def test_tries_after_the_first_good_one_are_not_drawn(spark):
    gt = spark.range(40).select(F.col("id").alias("gt_id"), (F.col("id") % 5).alias("image_id"), F.lit(0).alias("class_id"), *[F.lit(v).alias(c) for v, c in ((10.0, "x1"), (10.0, "y1"), (210.0, "x2"), (160.0, "y2"))])
    images = spark.range(6).select(F.col("id").alias("image_id"), F.lit(4096.0).alias("width"), F.lit(3000.0).alias("height"))
    t = time.time()
    jittered, negative = tiles.jittered_proposals(gt, 200_000, 0.6, "p").collect(), tiles.negative_proposals(images, gt, 2, 200_000, 0.04, "p").collect()
    assert len(jittered) == 40 and len(negative) == 12 and max(r["try"] for r in jittered) < 5
    assert time.time() - t < 60  # 8,000,000 and 2,400,000 draws if all were drawn


def test_votes_follow_the_first_anchor(spark):
    d = boxes(spark, 500)
    t = time.time()
    got = {r["det_id"]: (r["n"], r["x1"], r["y2"]) for r in fuse.box_vote(d, 0.5).collect()}
    assert time.time() - t < 30
    iou = lambda p, q: (i := max(0, min(p.x2, q.x2) - max(p.x1, q.x1)) * max(0, min(p.y2, q.y2) - max(p.y1, q.y1))) / ((p.x2 - p.x1) * (p.y2 - p.y1) + (q.x2 - q.x1) * (q.y2 - q.y1) - i)
    anchors = []
    for r in sorted(d.collect(), key=lambda r: (-r.score, r.det_id)):
        home = next((m for m in anchors if iou(m[0], r) > 0.5), None)
        home.append(r) if home else anchors.append([r])
    assert set(got) == {m[0].det_id for m in anchors}
    for m in anchors:
        w = sum(max(r.score, 1e-12) for r in m)
        n, x1, y2 = got[m[0].det_id]
        assert n == len(m) and abs(x1 - sum(r.x1 * max(r.score, 1e-12) for r in m) / w) < 1e-6 and abs(y2 - sum(r.y2 * max(r.score, 1e-12) for r in m) / w) < 1e-6


def test_fusion_and_votes_are_quadratic_in_a_group_at_most(spark):
    d = boxes(spark, 500)
    t = time.time()
    a, b = fuse.wbf(d, 0.5).orderBy("cluster").collect(), fuse.wbf(d, 0.5, method="cells").orderBy("cluster").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]
    assert time.time() - t < 30  # 60,000,000 overlaps and more, if each cluster sought the best again


def plan(df):
    return df._jdf.queryExecution().toString()


def test_a_labelling_is_computed_once(spark):
    d = boxes(spark, 60).repartition("image_id")
    gt = d.filter("det_id % 3 = 0").withColumnRenamed("det_id", "gt_id").drop("score")
    lab = metrics.label(fuse.nms(d, 0.5), gt, 0.5)
    for out in (metrics.class_figures(lab, gt, ["class_id"]), metrics.prefix_figures(lab, gt, [0.0, 0.5], ["class_id"])):
        assert "posexplode" not in plan(out) and "array_append" not in plan(out)  # neither suppression nor matching is left to do
    assert "array_append" not in plan(match.top_errors(lab, gt, 5))


def test_policies_multiply_pairs_and_not_what_is_shuffled(spark):
    d = boxes(spark, 60)
    gt = d.filter("det_id % 3 = 0").withColumnRenamed("det_id", "gt_id").drop("score")
    policies = spark.createDataFrame([("p", 1.0, 1.0, 0.0, 0.0), ("q", 0.5, 0.5, 3.0, 0.0)], "policy string, sx double, sy double, dx double, dy double")
    out = match.recall_bound(gt, d, policies, 0.5)
    assert "sx" not in plan(out)  # boxes met once, what is read by three reports is stored
    got = {(r["policy"], r["part"]): (r["n"], r["total"]) for r in out.filter("part = 'recall'").collect()}
    assert got[("p", "recall")] == (20, 20) and got[("q", "recall")] == (0, 20)


def test_evidence_is_read_once_for_ranks_and_scores(spark):
    d = boxes(spark, 30).filter("array_contains(array_repeat(true, 2), score >= 0)").withColumns({"both_models": F.lit(1.0), "ab_iou": 0.6 + F.col("score") / 3})
    assert "array_repeat" not in plan(refine.view_invariant_delta(d))


def test_caches_have_files_for_their_images(spark):
    from types import SimpleNamespace

    from tallybox.plans import source_queries

    some = lambda n: SimpleNamespace(images=spark.range(n))
    few, many = source_queries.cache_files(some(20_000)), source_queries.cache_files(some(200_000))
    assert many >= 5 * few and source_queries.at_once(many) <= 64


def test_features_move_a_box_once(spark):
    from types import SimpleNamespace

    from tallybox.plans import rank_queries

    d = boxes(spark, 60)
    gt = d.filter("det_id % 7 = 0").withColumnRenamed("det_id", "gt_id").drop("score")
    f = rank_queries.features(SimpleNamespace(det=d, gt=gt))
    assert f._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2  # the boxes and the truths
    assert f.count() == 60 and f.filter("det_id % 7 = 0 and label <> 1").count() == 0


def test_boxes_of_a_cache_are_dealt_to_a_task_for_each_file(spark):
    from tallybox.plans import source_queries

    d = spark.range(6_000).select(F.col("id").alias("det_id"), (F.col("id") % 600).alias("image_id"), F.lit(0).alias("class_id"), F.lit(0.5).alias("score"), F.lit(False).alias("touches_edge"), F.lit(False).alias("is_global"),
                                  *[F.lit(v).alias(c) for v, c in ((1.0, "x1"), (1.0, "y1"), (9.0, "x2"), (9.0, "y2"))])
    text = source_queries.lines(d, 24)
    parts = text.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) == 24 and sum(r["count"] for r in parts) == 600 and max(r["count"] for r in parts) < 60  # the session deals to four
    assert text._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_thresholds_multiply_levels_and_not_true_positives(spark):
    n = 2_000
    d = spark.range(n).select(F.col("id").alias("det_id"), (F.col("id") % 2).cast("int").alias("class_id"), (F.lit(1.0) - F.col("id") / n).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("tp"))
    gt = spark.range(1_000).select(F.col("id").alias("gt_id"), (F.col("id") % 2).cast("int").alias("class_id"))
    out = metrics.prefix_figures(d, gt, [0.0, 0.3, 0.7], ["class_id"])
    assert "sequence(0, 100" not in plan(out).split("aggregate(")[0] and "filter(sequence" not in plan(out)  # no level is sought among all at each true positive
    for r in out.collect():
        rows = sorted((x for x in d.collect() if x["class_id"] == r["class_id"] and x["score"] >= r["threshold"]), key=lambda x: -x["score"])
        hits, at = 0, []
        for i, x in enumerate(rows):
            hits += x["tp"]
            at.append((hits / (i + 1), hits / 500) if x["tp"] else None)
        want = sum(max((p for p, c in filter(None, at) if i * 0.01 <= c), default=0.0) for i in range(101)) / 101
        assert abs(r["ap"] - want) < 1e-9 and (r["tp"], r["fp"]) == (hits, len(rows) - hits)


def test_levels_are_those_of_the_products(spark):
    values = sorted({i * 0.01 for i in range(101)} | {i / 100 for i in range(101)} | {k / 7 for k in range(8)} | {i * 0.01 - 1e-17 for i in range(1, 101)} | {1.5})
    got = spark.createDataFrame([(v,) for v in values], "r double").select("r", metrics._level(F.col("r")).alias("l")).collect()
    assert [r["l"] for r in got] == [max(i for i in range(101) if i * 0.01 <= r["r"]) for r in got]


def test_a_fit_reads_rows_alike_once(spark):
    from pyspark.ml.regression import GBTRegressor

    from tallybox.operators import crossfit

    d = spark.range(1_600).select((F.col("id") % 8).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"), F.lit(1.0).alias("weight"), ((F.col("id") % 37) % 3).cast("int").alias("fold"))
    d = d.withColumn("target", F.least(F.lit(1.0), F.abs(F.sin(F.col("x") * 3 + F.col("y"))) + F.rand(3) / 9))
    many = d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20))))
    cells = [crossfit.alike(t, ["x", "y"], "target", "weight", False) for t in (d, many)]
    assert cells[0].count() == cells[1].count() == 120
    got = crossfit.out_of_fold(d, ["x", "y"], "target", "weight", 3, "regressor")
    seen = {(r["fold"], r["x"], r["y"]): r["prediction"] for r in got.collect()}
    again = {(r["fold"], r["x"], r["y"]): r["prediction"] for r in crossfit.out_of_fold(many, ["x", "y"], "target", "weight", 3, "regressor").collect()}
    assert seen.keys() == again.keys() and max(abs(seen[k] - again[k]) for k in seen) < 1e-9
    x = crossfit._vector(d, ["x", "y"])
    fit = GBTRegressor(featuresCol="_x", labelCol="target", weightCol="weight", maxIter=5, maxDepth=3, seed=7).fit(x.filter("fold <> 1"))
    for r in fit.transform(x.filter("fold = 1")).collect():  # the plain fit over the rows themselves
        assert abs(min(max(r["prediction"], 0.0), 1.0) - seen[1, r["x"], r["y"]]) < 1e-9


def test_support_of_a_sequence_makes_no_rows_of_pairs(spark, monkeypatch):
    import math

    from tallybox.operators import groups, support

    monkeypatch.setattr(groups, "ROWS", 50)
    monkeypatch.setattr(groups, "AT_ONCE", 16)
    r = np.random.default_rng(5)
    rows = [(i, int(im), int(im) // 4 if im < 28 else None, int(c), float(x), float(x) + 10, float(s) if s > 0.05 else None) for i, (im, c, x, s) in enumerate(zip(r.integers(0, 30, 600), r.integers(0, 3, 600), r.integers(0, 900, 600), r.random(600), strict=True))]
    d = spark.createDataFrame(rows, "det_id long, image_id long, seq long, class_id int, x1 double, x2 double, score double")
    out = support.sequence_support(d, 200.0, 3, 0.2)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString() and out.rdd.getNumPartitions() == 12  # 600 / 50, where the session deals to four
    lend = {}
    for q in sorted((q for q in rows if q[6] is not None and q[6] >= 0.2 and q[2] is not None), key=lambda q: (-q[6], q[0])):
        lend.setdefault((q[2], q[3]), {}).setdefault(q[1], [])
        if len(lend[q[2], q[3]][q[1]]) < 3:
            lend[q[2], q[3]][q[1]].append(q)
    got = {x["det_id"]: x["support"] for x in out.collect()}
    assert len(got) == 600
    for q in rows:
        best = sorted((max(math.exp(-((q[4] - o[4]) / 200.0) ** 2 / 2) * o[6] for o in who) for im, who in lend.get((q[2], q[3]), {}).items() if im != q[1]), reverse=True)[:2]
        assert abs(got[q[0]] - sum(best) / 2) < 1e-9


def test_evidence_makes_no_rows_of_pairs(spark, monkeypatch):
    from tallybox.operators import groups

    monkeypatch.setattr(groups, "ROWS", 40)
    monkeypatch.setattr(groups, "AT_ONCE", 16)
    monkeypatch.setattr(refine, "PAIRS", 50)
    r = np.random.default_rng(2)
    rows = [(i, int(g) // 3, int(g) % 3, "ab"[int(m)], bool(v), bool(e), float(x), float(x), float(x + 100), float(x + 90), float(s)) for i, (g, m, v, e, x, s) in enumerate(zip(r.integers(0, 12, 200), r.integers(0, 2, 200), r.integers(0, 2, 200), r.integers(0, 2, 200), r.integers(0, 60, 200), r.random(200), strict=True))]
    d = spark.createDataFrame(rows, "det_id long, image_id long, class_id int, model string, is_global boolean, touches_edge boolean, x1 double, y1 double, x2 double, y2 double, score double")
    iou = lambda p, q: (i := max(0, min(p[8], q[8]) - max(p[6], q[6])) * max(0, min(p[9], q[9]) - max(p[7], q[7]))) / max((p[8] - p[6]) * (p[9] - p[7]) + (q[8] - q[6]) * (q[9] - q[7]) - i, 1e-9)
    for anchors, some in ((d, rows), (d.filter("det_id % 5 = 0").drop("model", "is_global", "touches_edge"), rows[::5])):
        out = refine.evidence(anchors, d, 1000.0, 1000.0)
        assert "Join" not in plan(out) and out.rdd.getNumPartitions() >= 5 and out.columns[:len(anchors.columns)] == anchors.columns
        got = {x["det_id"]: x for x in out.collect()}
        assert len(got) == len(some)
        for p in some:
            reps = {}
            for q in sorted((q for q in rows if q[1:3] == p[1:3] and iou(p, q) >= 0.5), key=lambda q: (-iou(p, q), -q[10], q[0])):
                reps.setdefault((q[3], q[4]), q)
            reps = [reps[k] for k in sorted(reps)]
            x = got[p[0]]
            assert [(a["model"], a["is_global"], a["p_score"], a["touches_edge"], a["x1"]) for a in x["reps"]] == [(q[3], q[4], q[10], q[5], q[6]) for q in reps]
            pairs = [(a[3] == b[3], iou(a, b)) for i, a in enumerate(reps) for b in reps[i + 1:]]
            same, other = [v for s, v in pairs if s], [v for s, v in pairs if not s]
            want = (float(len({q[3] for q in reps}) == 2), max(other, default=0.0), float(len(reps)), sum(same) / len(same) if same else 0.0, float(np.median([1 - v for _, v in pairs])) if pairs else 1.0, float(all(not q[4] and q[5] for q in reps)))
            assert np.allclose([x[c] for c in ("both_models", "ab_iou", "sources", "coherence", "dispersion", "edge_only")], want, atol=1e-12) and x["has_views"] == bool(same)
