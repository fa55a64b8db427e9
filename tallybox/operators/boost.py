"""Boosted trees for all classes and folds at once, and cross-fitted scores by them.

A model belongs to a class and a held-out fold: it learns from the class's rows of all other folds. One more for each fold learns from all classes and
stands in for classes without enough support. All models grow together: a pass over the rows sums gradients by (model, node, feature, bin)
inside its tasks, one aggregation adds the parts, and the best split of each node of each model comes back, so the number of passes is rounds times
depth, whatever the number of classes and folds. Rows alike in class, fold, label and bins are summed to one row before, which carries a margin for each model that
it meets: a pass reads classes * folds * 2 * bins ^ features of them at most, however many rows there are.

What the driver holds is the models: classes times folds times nodes, not rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybox.operators.order import quantiles
from tallybox.session import stored

#: Rounds after which margins are stored; until then a pass computes them from the trees since.
STORE_ROUNDS = 8
NO_SPLIT = 255


@dataclass
class Settings:
    rounds: int = 20
    depth: int = 3
    rate: float = 0.1
    bins: int = 32
    reg_lambda: float = 10.0
    reg_alpha: float = 0.3
    least_hessian: float = 12.0
    #: Support that a class's model needs in its training rows.
    least_positives: int = 20
    least_positive_groups: int = 5
    least_negative_groups: int = 5


@dataclass
class Tree:
    """A tree of each model: feature and bin by heap index (values beyond the bin go right), and the leaves."""

    feature: np.ndarray
    bin: np.ndarray
    leaf: np.ndarray

    @staticmethod
    def blank(models: int, depth: int) -> Tree:
        return Tree(np.zeros((models, 2**depth - 1), np.int64), np.full((models, 2**depth - 1), NO_SPLIT, np.int64), np.zeros((models, 2**depth)))

    def nodes(self, model: np.ndarray, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row, counted from 0 within its level."""
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for d in range(levels):
            at = 2**d - 1 + node
            node = 2 * node + (bins[rows, self.feature[model, at]] > self.bin[model, at])
        return node


@dataclass
class Models:
    """What tasks need: which models there are, the weight of each label in them, the trees since margins were stored."""

    classes: list
    folds: int
    weight: np.ndarray  # models x 2
    depth: int
    trees: list[Tree] = field(default_factory=list)

    def slots(self, cls: np.ndarray, fold: int) -> list[np.ndarray]:
        """The models of rows for a fold: their class's, and the one of all classes, which comes last."""
        return [cls * self.folds + fold, np.full(len(cls), len(self.classes) * self.folds + fold)]

    def margins(self, cls: np.ndarray, bins: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Margins of the rows, folds x 2 columns: those of `before` and of the trees since."""
        out = before.copy()
        for t in self.trees:
            for k in range(self.folds):
                for j, slot in enumerate(self.slots(cls, k)):
                    out[:, 2 * k + j] += t.leaf[slot, t.nodes(slot, bins, self.depth)]
        return out


def bin_edges(df: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """Exact quantiles of each column, at most `bins` - 1 of them."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("m")).select("m.c", "m.v")
    found: list[list[float]] = [[] for _ in columns]
    for r in quantiles(long, ["c"], "v", [i / bins for i in range(1, bins)]).select("c", "quantile").collect():
        found[r["c"]].append(r["quantile"])
    return [np.unique(x) for x in found]


def _rows(batch, features: int):
    """cls, fold, label, weight, bins and margins of a batch as arrays."""
    get = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
    n = batch.num_rows
    flat = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return get("_cls").astype(np.int64), get("_fold").astype(np.int64), get("_label").astype(np.int64), get("_weight"), flat("_bins").astype(np.int64).reshape(n, features), flat("_margin")


def _histogram(models: Models, tree: Tree, level: int, features: int, bins: int):
    """Sums of gradients and hessians by cell: ((model * nodes + node) * features + feature) * bins + bin."""
    def run(batches):
        import pyarrow as pa

        nodes = 2**level
        shape = (features, len(models.weight) * nodes * bins)
        g, h = np.zeros(shape), np.zeros(shape)
        for batch in batches:
            if not batch.num_rows:
                continue
            cls, fold, label, weight, x, before = _rows(batch, features)
            margin = models.margins(cls, x, before)
            for k in range(models.folds):
                for j, slot in enumerate(models.slots(cls, k)):
                    on = (fold != k) & (cls >= 0 if j == 0 else True)
                    s, y = slot[on], label[on]
                    p = 1 / (1 + np.exp(-margin[on, 2 * k + j]))
                    w = models.weight[s, y] * weight[on]
                    cell = (s * nodes + tree.nodes(s, x[on], level)) * bins
                    for f in range(features):
                        g[f] += np.bincount(cell + x[on, f], w * (p - y), shape[1])
                        h[f] += np.bincount(cell + x[on, f], w * p * (1 - p), shape[1])
        f, at = np.nonzero(h)
        cell = ((at // bins) * features + f) * bins + at % bins
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(g[f, at]), pa.array(h[f, at])], names=["cell", "g", "h"])
    return run


def _splits(parts: DataFrame, s: Settings, features: int) -> list:
    """Per model and node: feature, bin and the leaf values left and right of the best split; of the whole node where none is good."""
    cells = parts.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    cells = cells.select(F.expr(f"cell div {features * s.bins}").alias("node"), F.expr(f"cell div {s.bins} % {features}").alias("feature"), F.expr(f"cell % {s.bins}").alias("bin"), "g", "h")
    up, whole = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("node", "feature")  # `bins` rows at most
    cells = cells.select("node", "feature", "bin", F.sum("g").over(up).alias("gl"), F.sum("h").over(up).alias("hl"), F.sum("g").over(whole).alias("gt"), F.sum("h").over(whole).alias("ht"))
    cells = cells.withColumns({"gr": F.col("gt") - F.col("gl"), "hr": F.col("ht") - F.col("hl")})
    soft = lambda g: F.signum(g) * F.greatest(F.abs(F.col(g)) - s.reg_alpha, F.lit(0.0))
    worth = lambda g, h: F.pow(soft(g), 2) / (F.col(h) + s.reg_lambda)
    value = lambda g, h: -s.rate * soft(g) / (F.col(h) + s.reg_lambda)
    gain = worth("gl", "hl") + worth("gr", "hr") - worth("gt", "ht")
    fine = (F.col("hl") >= s.least_hessian) & (F.col("hr") >= s.least_hessian) & (gain > 1e-9)
    row = F.when(fine, F.struct("feature", "bin", value("gl", "hl").alias("l"), value("gr", "hr").alias("r")))
    none = F.struct(F.lit(0).cast("bigint").alias("feature"), F.lit(NO_SPLIT).cast("bigint").alias("bin"), value("gt", "ht").alias("l"), value("gt", "ht").alias("r"))
    ordered = F.struct(F.round(gain, 9), -F.col("feature"), -F.col("bin"))
    best = cells.groupBy("node").agg(F.max_by(row, F.when(fine, ordered)).alias("best"), F.min_by(none, "feature").alias("none"))
    return best.select("node", F.coalesce("best", "none").alias("b")).select("node", "b.*").collect()


def crossfit_by_class(df: DataFrame, columns: list[str], label: str, cls: str, fold: str, group: str, folds: int, settings: Settings | None = None, weight: str | None = None) -> DataFrame:
    """`df` with `prediction` of the model of the row's class that saw no row of its fold, and `model`: `class`, or `global` where that class lacks support.

    label: 0 or 1; fold: 0 to folds - 1; null features count as the smallest. Within a model either label weighs the same. A group in two folds is an error, since
    it would leak. Rows without a class or of unknown labels are scored, and teach none. Columns of the two new names are replaced."""
    df = df.drop("prediction", "model")
    s = settings or Settings()
    if not 2 <= s.bins <= NO_SPLIT:
        raise ValueError("bins must be 2 to 255")
    leak = df.groupBy(group).agg(F.countDistinct(fold).alias("n")).filter("n > 1").select(group).first()
    if leak is not None:
        raise ValueError(f"group {leak[0]!r} is in more than one fold")
    known = df.filter(F.col(label).isin(0, 1))
    # a group stands in one fold, so its counts add up over folds
    counts = known.groupBy(F.col(cls).alias("c"), F.col(fold).alias("f"), F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n"), F.countDistinct(group).alias("g")).collect()
    classes = sorted({r["c"] for r in counts if r["c"] is not None})
    place = {c: i for i, c in enumerate(classes)}
    models = (len(classes) + 1) * folds
    n, g = np.zeros((models, 2)), np.zeros((models, 2))
    for r in counts:
        for k in range(folds):
            if r["f"] != k:
                slots = [len(classes) * folds + k] + ([place[r["c"]] * folds + k] if r["c"] is not None else [])
                for slot in slots:
                    n[slot, r["y"]] += r["n"]
                    g[slot, r["y"]] += r["g"]
    total = n.sum(1, keepdims=True)
    balanced = np.divide(total, n * np.maximum((n > 0).sum(1, keepdims=True), 1), out=np.zeros_like(n), where=n > 0)
    supported = (n[:, 1] >= s.least_positives) & (g[:, 1] >= s.least_positive_groups) & (g[:, 0] >= s.least_negative_groups)

    edges = bin_edges(df, columns, s.bins)
    below = lambda value, e: F.size(F.filter(F.lit(e.tolist()).cast("array<double>"), lambda x: x < value)) if len(e) else F.lit(0)
    bins = F.array(*[below(F.col(c), e) for c, e in zip(columns, edges, strict=True)])
    bins = F.transform(bins, lambda b: F.greatest(b, F.lit(0)).cast("smallint"))
    number = F.coalesce(F.create_map(*[x for c, i in place.items() for x in (F.lit(c), F.lit(i))])[F.col(cls)], F.lit(-1)) if classes else F.lit(-1)
    rows = df.withColumns({"_cls": number.cast("int"), "_fold": F.col(fold).cast("int"), "_label": F.when(F.col(label).isin(0, 1), F.col(label)).otherwise(-1).cast("int"), "_weight": (F.col(weight) if weight else F.lit(1.0)).cast("double"), "_bins": bins,
                           "_margin": F.array_repeat(F.lit(0.0), 2 * folds)})
    rows = stored(rows)
    # rows alike in all that a model sees have one gradient: passes go over these, with the sum of their weights, and not over rows
    alike = ["_cls", "_fold", "_label", "_bins"]
    cells = rows.filter("_label >= 0").groupBy(*alike).agg(F.sum("_weight").alias("_weight")).withColumn("_margin", F.array_repeat(F.lit(0.0), 2 * folds))
    cells = stored(cells)
    grown: list[Tree] = []
    state = Models(classes, folds, balanced, s.depth)
    for done in range(s.rounds):
        tree = Tree.blank(models, s.depth)
        for level in range(s.depth):
            parts = cells.mapInArrow(_histogram(state, tree, level, len(columns), s.bins), "cell long, g double, h double")
            for r in _splits(parts, s, len(columns)):
                model, node = divmod(r["node"], 2**level)
                at = 2**level - 1 + node
                tree.feature[model, at], tree.bin[model, at] = r["feature"], r["bin"]
                if level == s.depth - 1:
                    tree.leaf[model, 2 * node:2 * node + 2] = r["l"], r["r"]
        state.trees.append(tree)
        grown.append(tree)
        if (done + 1) % STORE_ROUNDS == 0 and done + 1 < s.rounds:
            cells, state = stored(_scored(cells, state, supported, len(columns), False)), Models(classes, folds, balanced, s.depth)
    out = _scored(rows, Models(classes, folds, balanced, s.depth, grown), supported, len(columns), True)
    return out.select(*df.columns, "prediction", "model")


def _scored(rows: DataFrame, models: Models, supported: np.ndarray, features: int, last: bool) -> DataFrame:
    """The rows with their margins up to now, or with prediction and model."""
    added = "prediction double, model string" if last else "_margin array<double>"
    names = [c for c in rows.columns if c != "_margin"]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_margin")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cls, fold, _, _, x, before = _rows(batch, features)
            margin = models.margins(cls, x, before)
            if last:
                own = (cls >= 0) & supported[cls * models.folds + fold]
                z = margin[np.arange(len(cls)), 2 * fold + ~own]
                new = [pa.array(1 / (1 + np.exp(-z))), pa.array(np.where(own, "class", "global").tolist(), pa.string())]
            else:
                new = [pa.ListArray.from_arrays(pa.array(np.arange(0, margin.size + 1, margin.shape[1]), pa.int32()), pa.array(margin.ravel()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + new, names=[*names, *(["prediction", "model"] if last else ["_margin"])])

    return rows.mapInArrow(run, f"{kept}, {added}")
