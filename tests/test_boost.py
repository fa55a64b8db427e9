"""Boosted trees of all classes and folds against a plain loop that fits one after the other."""

from __future__ import annotations

import numpy as np
import pytest

from tallybox.operators import boost

ROWS = "id long, cls int, fold int, grp string, y int, a double, b double, prediction string"


def made(n=900, seed=2):
    r = np.random.default_rng(seed)
    a, b, cls, grp = r.normal(size=n).round(2), r.integers(0, 6, n).astype(float), r.integers(0, 3, n), r.integers(0, 30, n)
    cls[r.random(n) < 0.5] = 0
    z = np.where(cls == 0, 2 * a, np.where(cls == 1, -2 * a, b - 3))
    y = (z + r.normal(size=n) > 0).astype(int)
    return [(i, int(cls[i]), int(grp[i] % 3), f"g{grp[i]}", int(y[i]), float(a[i]), float(b[i]), "x") for i in range(n)]


def plain(rows, s, folds):
    """Prediction by id, one fit after the other."""
    x = np.array([r[5:7] for r in rows])
    edges = [np.unique(np.quantile(x[:, f], [i / s.bins for i in range(1, s.bins)])) for f in range(2)]
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    cls, fold, y = (np.array([r[i] for r in rows]) for i in (1, 2, 4))
    grp = np.array([r[3] for r in rows])
    soft = lambda g: np.sign(g) * max(abs(g) - s.reg_alpha, 0)

    def fit(train):
        w = np.where(y == 1, 0.5 / y[train].mean(), 0.5 / (1 - y[train].mean()))
        margin = np.zeros(len(y))
        for _ in range(s.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = w * (p - y), w * p * (1 - p)
            nodes = [np.ones(len(y), bool)]
            for d in range(s.depth):
                after = []
                for at in nodes:
                    on = at & train
                    best = None
                    for f in range(2):
                        for cut in range(s.bins):
                            left = on & (bins[:, f] <= cut)
                            right = on & ~left
                            if not left.any() or h[left].sum() < s.least_hessian or h[right].sum() < s.least_hessian:
                                continue
                            gain = sum(k * soft(g[m].sum()) ** 2 / (h[m].sum() + s.reg_lambda) for m, k in ((left, 1), (right, 1), (on, -1)))
                            if gain > 1e-9 and (best is None or round(gain, 9) > best[0]):
                                best = round(gain, 9), f, cut
                    f, cut = (best[1], best[2]) if best else (0, s.bins)
                    left = at & (bins[:, f] <= cut)
                    after += [left, at & ~left]
                    if d == s.depth - 1:
                        for m in (left, at & ~left) if best else (at,):
                            margin[m] -= s.rate * soft(g[m & train].sum()) / (h[m & train].sum() + s.reg_lambda)
                nodes = after
        return 1 / (1 + np.exp(-margin))

    out, kind = np.zeros(len(y)), np.array(["class"] * len(y), dtype=object)
    for k in range(folds):
        whole = fit(fold != k)
        for c in np.unique(cls):
            train, held = (fold != k) & (cls == c), (fold == k) & (cls == c)
            good = y[train].sum() >= s.least_positives and len(set(grp[train & (y == 1)])) >= s.least_positive_groups and len(set(grp[train & (y == 0)])) >= s.least_negative_groups
            out[held] = (fit(train) if good else whole)[held]
            kind[held] = "class" if good else "global"
    return {r[0]: (kind[i], out[i]) for i, r in enumerate(rows)}


@pytest.mark.parametrize("least,store", [(20, 8), (130, 2)])
def test_all_models_at_once_equal_one_after_the_other(spark, monkeypatch, least, store):
    monkeypatch.setattr(boost, "STORE_ROUNDS", store)
    s = boost.Settings(rounds=5, depth=2, bins=8, rate=0.3, least_hessian=4.0, least_positives=least)
    rows = made()
    d = spark.createDataFrame(rows, ROWS).repartition(3)
    got = boost.crossfit_by_class(d, ["a", "b"], "y", "cls", "fold", "grp", 3, s)
    assert got.columns == [*d.columns[:-1], "prediction", "model"]
    want = plain(rows, s, 3)
    got = {r.id: (r.model, r.prediction) for r in got.collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-6 for i in got)
    assert len({m for m, _ in got.values()}) == (1 if least == 20 else 2)
    # the classes' scores answer to different features
    mean = lambda c, up: np.mean([got[r[0]][1] for r in rows if r[1] == c and (r[5] > 0) == up])
    assert least != 20 or (mean(0, True) > mean(0, False) + 0.2 and mean(1, True) < mean(1, False) - 0.2)


def test_groups_that_leak_and_odd_rows(spark):
    rows = made(200)
    leak = spark.createDataFrame([*rows, (999, 0, 1, rows[0][3] if rows[0][2] != 1 else rows[1][3] if rows[1][2] != 1 else rows[2][3], 1, 0.0, 0.0, "x")], ROWS)
    if leak.groupBy("grp").agg({"fold": "min"}).count():
        with pytest.raises(ValueError, match="more than one fold"):
            boost.crossfit_by_class(leak, ["a", "b"], "y", "cls", "fold", "grp", 3, boost.Settings(rounds=1))
    odd = spark.createDataFrame([*rows, (1000, None, 0, "n1", 1, None, 1.0, "x"), (1001, 7, 1, "n2", None, 0.5, None, "x")], ROWS)
    got = {r.id: (r.model, r.prediction) for r in boost.crossfit_by_class(odd, ["a", "b"], "y", "cls", "fold", "grp", 3, boost.Settings(rounds=2, bins=4, least_positives=5, least_positive_groups=2, least_negative_groups=2)).collect()}
    assert len(got) == 202 and got[1000][0] == got[1001][0] == "global" and all(0 < p < 1 for _, p in got.values())
    assert boost.crossfit_by_class(odd.limit(0), ["a", "b"], "y", "cls", "fold", "grp", 3, boost.Settings(rounds=1)).count() == 0


def test_passes_read_cells_and_not_rows(spark, monkeypatch):
    tables, stored = [], boost.stored
    monkeypatch.setattr(boost, "stored", lambda d: tables.append(stored(d)) or tables[-1])
    d = spark.createDataFrame(made(), ROWS)
    out = boost.crossfit_by_class(d, ["a", "b"], "y", "cls", "fold", "grp", 3, boost.Settings(rounds=1, depth=1, bins=4))
    assert tables[-1].count() <= 3 * 3 * 2 * 4**2  # classes, folds, labels, bins
    assert tables[-1].groupBy().sum("_weight").first()[0] == out.count() == 900  # all of them, by weight
