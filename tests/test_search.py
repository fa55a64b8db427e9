"""Searches against plain ones: routing against all combinations, the cover against sets, digests of order."""

from __future__ import annotations

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from tallybox.operators import match, sets

OPTIONS = "class_id int, variant string, threshold double, tp long, fp long, n_gt long, ap double"


@pytest.mark.parametrize("seed", range(4))
def test_routing_equals_exhaustive_search_on_three_classes(spark, seed):
    r = random.Random(seed)
    rows = []
    for c in range(3):
        n = r.randrange(50, 200)
        for v in "ab":
            tp, fp, ap = n * r.uniform(0.5, 0.9), n * r.uniform(3, 30), r.uniform(0.3, 0.7)
            for t in (0.0, 0.2, 0.4, 0.6):
                rows.append((c, v, t, int(tp), int(fp), n, ap))
                tp, fp, ap = tp * r.uniform(0.7, 1), fp * r.uniform(0.2, 0.8), ap * r.uniform(0.9, 1)

    def score(pick):
        tp, fp, n = (sum(p[k] for p in pick) for k in (3, 4, 5))
        return 20 * tp / (tp + fp) + 60 * tp / n + 20 * sum(p[6] for p in pick) / 3

    best = max(product(*[[x for x in rows if x[0] == c] for c in range(3)]), key=score)
    got = match.route_search(spark.createDataFrame(rows, OPTIONS)).orderBy("class_id").collect()
    assert abs(got[0].score - score(best)) < 1e-9
    assert [(g.class_id, g.variant, g.threshold) for g in got] == [x[:3] for x in best]
    assert match.route_search(spark.createDataFrame([], OPTIONS)).count() == 0


def test_cover_equals_plain_greedy(spark):
    r = random.Random(5)
    gt = [(7 * i + 3, i % 9, 0, 20.0 * i, 0.0, 20.0 * i + 10, 10.0) for i in range(400)]
    held = {a: {g[0] for g in gt if r.random() < p} for a, p in enumerate((0.4, 0.35, 0.35, 0.3, 0.1, 0.02, 0.0))}
    cost = {a: len(s) + r.randrange(40) for a, s in held.items()}
    rows = [(g[1], 0, a, *g[3:]) for a, s in held.items() for g in gt if g[0] in s]
    rows += [(0, 0, a, -500.0, 0.0, -490.0, 10.0) for a, s in held.items() for _ in range(cost[a] - len(s))]
    truth = spark.createDataFrame(gt, "gt_id long, image_id int, class_id int, x1 double, y1 double, x2 double, y2 double")
    emitted = spark.createDataFrame(rows, "image_id int, class_id int, action int, x1 double, y1 double, x2 double, y2 double")
    for target in (0.6, 1.0):
        seen, left, want = set(), dict(held), []
        while left and len(seen) < target * len(gt):
            a = max(left, key=lambda a: (len(left[a] - seen) / max(cost[a], 1), len(left[a] - seen), -cost[a], -a))
            if not left[a] - seen:
                break
            want.append((len(want), a, len(left[a] - seen), cost[a]))
            seen |= left.pop(a)
        got = match.greedy_cover(truth, emitted, 0.5, target).orderBy("round").collect()
        assert [tuple(g)[:4] for g in got] == want and abs(got[-1].recall - len(seen) / len(gt)) < 1e-9


def test_an_ordered_digest_sees_order_and_not_partitions(spark, monkeypatch):
    monkeypatch.setattr(sets, "FAN", 4)
    d = spark.createDataFrame([(i, f"r{i % 7}") for i in range(70)], "i int, t string")
    one = sets.ordered_digest(d, ["t"], [F.col("i")]).first()
    assert one == sets.ordered_digest(d.repartition(9, "t"), ["t"], [F.col("i")]).first() and one.n == 70
    swapped = d.withColumn("i", F.when(F.col("i") == 10, 11).when(F.col("i") == 11, 10).otherwise(F.col("i")))
    assert sets.ordered_digest(swapped, ["t"], [F.col("i")]).first().digest != one.digest
    assert sets.membership_digest(swapped, ["t"]).first() == sets.membership_digest(d, ["t"]).first()
    assert sets.ordered_digest(d.limit(0), ["t"], [F.col("i")]).first().n == 0
    assert sets.ordered_digest(d.limit(1), ["t"], [F.col("i")]).first().digest != sets.ordered_digest(d.limit(0), ["t"], [F.col("i")]).first().digest


def test_diagnostic_set_equals_a_plain_loop(spark):
    from tallybox.operators import tiles

    r = random.Random(9)
    rows = [(i, r.choice([i % 3, r.randrange(5)])) for i in range(60) if i % 6 for _ in range(r.randrange(1, 6))]
    boxes, images = spark.createDataFrame(rows, "image_id long, class_id int"), spark.range(60).toDF("image_id")
    used, want = set(), []
    for c in sorted({k for _, k in rows}):
        others = {i: sum(a == i and k != c for a, k in rows) for i in {a for a, k in rows if k == c}}
        for i in sorted((i for i in others if i not in used), key=lambda i: (others[i], i))[:4]:
            used.add(i)
            want.append((c, i))
    want += [(-1, i) for i in [i for i in range(60) if i not in {a for a, _ in rows}][:5]]
    got = [tuple(x) for x in tiles.diagnostic_set(boxes, images, 4, 5).collect()]
    assert sorted(got) == sorted(want) and len({i for _, i in got}) == len(got)
