"""Evidence of several models and views about one box, and what follows for its score and place."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybox.functions.columns import BOX, GUARD, from_latent, iou, latent, sigmoid
from tallybox.operators.fuse import GROUP
from tallybox.operators.groups import by_groups, flags, numbers, starts
from tallybox.operators.order import average_ranks
from tallybox.operators.rank import geometric_blend
from tallybox.session import stored

TINY = 1e-12
#: Pairs of boxes that are held at once.
PAIRS = 2_000_000
#: The nine numbers that stand for a box's evidence.
FEATURES = ("log_score", "both_models", "ab_iou", "sources", "coherence", "dispersion", "edge_only", "log_area", "log_aspect")


def representatives(anchors: DataFrame, candidates: DataFrame, floor: float = 0.5) -> DataFrame:
    """For each anchor at most one candidate of each model and kind of view: by IoU, then score, then lowest id."""
    c = candidates.select(*GROUP, F.col("det_id").alias("pid"), "model", "is_global", F.col("score").alias("p_score"), "touches_edge", *[F.col(k).alias("p" + k) for k in BOX])
    p = anchors.select("det_id", *GROUP, *BOX).join(c, GROUP).withColumn("iou", iou("", "p")).filter(F.col("iou") >= floor)
    best = p.groupBy("det_id", "model", "is_global").agg(F.max_by(F.struct("pid", "iou", "p_score", "touches_edge", *["p" + k for k in BOX]), F.struct("iou", "p_score", -F.col("pid"))).alias("r"))
    return best.select("det_id", "model", "is_global", "r.*")


def _ious(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """`iou` of the boxes of two lists of coordinates."""
    i = np.maximum(0.0, np.minimum(a[2], b[2]) - np.maximum(a[0], b[0])) * np.maximum(0.0, np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]))
    area = lambda x: np.maximum(0.0, x[2] - x[0]) * np.maximum(0.0, x[3] - x[1])
    return i / np.maximum(area(a) + area(b) - i, GUARD)


def _best(t, floor: float) -> tuple[np.ndarray, ...]:
    """(anchor, slot, candidate, iou) by anchor and slot, and for each slot its model and kind of view: rows of an ordered table of whole groups."""
    import pyarrow as pa
    import pyarrow.compute as pc

    boxes, score, pid = [numbers(t, c) for c in BOX], numbers(t, "_score"), t.column("det_id").to_numpy()
    codes = [pc.fill_null(pc.cast(t.column(c), pa.string()), "").combine_chunks().dictionary_encode() for c in ("_model", "_global")]
    names = [c.dictionary.to_pylist() for c in codes]
    rank = [np.argsort(np.argsort(n))[c.indices.to_numpy()] if len(n) else np.zeros(t.num_rows, np.int64) for c, n in zip(codes, names, strict=True)]
    slot = rank[0] * len(names[1]) + rank[1]
    kind = t.column("_kind").to_numpy()
    whole = ~(np.asarray(t.column("image_id").is_null()) | np.asarray(t.column("class_id").is_null()))
    anchors, others = np.flatnonzero((kind & 1 > 0) & whole), np.flatnonzero((kind & 2 > 0) & whole)
    group = starts(t, GROUP)
    lo, hi = np.searchsorted(others, group), np.searchsorted(others, np.append(group[1:], t.num_rows))
    home = np.searchsorted(group, anchors, "right") - 1
    many = np.cumsum((hi - lo)[home])
    found = []
    for some in np.split(anchors, np.searchsorted(many, np.arange(PAIRS, many[-1] if len(many) else 0, PAIRS))):
        g = np.searchsorted(group, some, "right") - 1
        n = hi[g] - lo[g]
        a = np.repeat(some, n)
        c = others[np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[g], n)]
        v = _ious([x[a] for x in boxes], [x[c] for x in boxes])
        on = v >= floor
        a, c, v = a[on], c[on], v[on]
        order = np.lexsort((pid[c], -score[c], -v, slot[c], a))
        a, c, v = a[order], c[order], v[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (slot[c[1:]] != slot[c[:-1]])
        found.append((a[first], c[first], v[first]))
    a, c, v = (np.concatenate(x) for x in zip(*found, strict=True))
    return a, slot[c], c, v, np.repeat(np.arange(len(names[0])), len(names[1])), boxes


def _evidence(floor: float, keep: list[str]):
    """The anchors of whole groups, the columns `keep` of them, their representatives and what these say."""
    def run(t):
        import pyarrow as pa

        a, slot, c, v, model, boxes = _best(t, floor)
        rows = np.flatnonzero(t.column("_kind").to_numpy() & 1)
        at = np.searchsorted(rows, a)
        sources = np.bincount(at, minlength=len(rows))
        place = np.full((len(rows), len(model)), -1)
        place[at, slot] = c
        across, within, n_within, spread = np.full(len(rows), -np.inf), np.zeros(len(rows)), np.zeros(len(rows), np.int64), []
        for i in range(len(model)):
            for j in range(i + 1, len(model)):
                p, q = place[:, i], place[:, j]
                x = np.where((p >= 0) & (q >= 0), _ious([b[p] for b in boxes], [b[q] for b in boxes]), np.nan)
                spread.append(1 - x)
                if model[i] == model[j]:
                    within += np.nan_to_num(x)
                    n_within += ~np.isnan(x)
                else:
                    across = np.fmax(across, x)
        spread = np.sort(np.array(spread).reshape(len(spread), len(rows)), axis=0) if spread else np.zeros((0, len(rows)))
        n = (~np.isnan(spread)).sum(0)
        median = np.ones(len(rows))
        k = np.flatnonzero(n)
        median[k] = (spread[(n[k] - 1) // 2, k] + spread[n[k] // 2, k]) / 2
        models = sum(((place[:, model == m] >= 0).any(1).astype(int) for m in np.unique(model)), np.zeros(len(rows), int))
        edge = ~flags(t, "_global") & flags(t, "_edge")
        off = np.bincount(at, ~edge[c], len(rows)) > 0
        take = lambda name: t.column(name).take(pa.array(c)).combine_chunks()
        reps = pa.StructArray.from_arrays([take("_model"), take("_global"), pa.array(v), take("_score"), take("_edge"), *[take(x) for x in BOX]], names=["model", "is_global", "iou", "p_score", "touches_edge", *BOX])
        reps = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sources)]), pa.int32()), reps)
        own = t.select(keep).take(pa.array(rows))
        new = {"reps": reps, "both_models": pa.array((models == 2).astype(float)), "ab_iou": pa.array(np.where(np.isfinite(across), across, 0.0)), "sources": pa.array(sources.astype(float)),
               "coherence": pa.array(within / np.maximum(n_within, 1)), "has_views": pa.array(n_within > 0), "dispersion": pa.array(median), "edge_only": pa.array(((sources > 0) & ~off).astype(float))}
        return pa.table({**dict(zip(keep, own.columns, strict=True)), **new})
    return run


def evidence(anchors: DataFrame, candidates: DataFrame, width: Column | float, height: Column | float, floor: float = 0.5) -> DataFrame:
    """`anchors` with `reps` (an array, at most four) and FEATURES.

    Models agree by the best IoU of a box of one with a box of the other; a model's views cohere by the IoU of its whole-image with its
    tile box. Dispersion is the median of 1 - IoU over all pairs, 1 without one. Boxes of an image and class are dealt to one task, of many such groups, and meet there:
    pairs and representatives are never rows."""
    flat = ["det_id", *GROUP, *BOX]
    side = {"_model": "model", "_global": "is_global", "_score": "score", "_edge": "touches_edge"}
    number = {c: F.col(c).cast("double").alias(c) for c in BOX}
    rest = [c for c in anchors.columns if c not in flat]
    values = [F.col(c).cast("double").alias(n) if n == "_score" else F.col(c).alias(n) for n, c in side.items()]
    place = [number.get(c, F.col(c)) for c in flat]
    rows = candidates.select(*place, *values, F.lit(2).alias("_kind"))
    if anchors is candidates:
        rows = candidates.select(*place, *values, F.lit(3).alias("_kind"), F.struct(*rest, *BOX).alias("_own"))
    else:
        alone = anchors.select(*place, *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name in side], F.lit(1).alias("_kind"), F.struct(*rest, *BOX).alias("_own"))
        rows = alone.unionByName(rows, allowMissingColumns=True)
    keep = ["det_id", *GROUP, "_own"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"reps array<struct<model:{types['_model']},is_global:{types['_global']},iou:double,p_score:double,touches_edge:{types['_edge']},x1:double,y1:double,x2:double,y2:double>>",
                                                             "both_models double, ab_iou double, sources double, coherence double, has_views boolean, dispersion double, edge_only double"])
    df = by_groups(rows, GROUP, [], _evidence(floor, keep), schema, anchors.count() + (0 if anchors is candidates else candidates.count()))
    df = df.select(*[F.col(c) if c in keep else F.col(f"_own.{c}").alias(c) for c in anchors.columns], *df.columns[len(keep):])
    w, h = F.greatest(F.col("x2") - F.col("x1"), F.lit(TINY)), F.greatest(F.col("y2") - F.col("y1"), F.lit(TINY))
    return df.withColumns({"log_score": F.ln(F.greatest("score", F.lit(TINY))), "log_area": F.ln(F.greatest(w * h / (width * height), F.lit(TINY))), "log_aspect": F.ln(w / h)})


def quality(profile: dict[str, tuple[float, float, float]], intercept: float) -> Column:
    """Sigmoid of a linear sum of features; profile: feature -> (mean, scale, coefficient)."""
    z = F.lit(float(intercept))
    for name, (mean, scale, coefficient) in profile.items():
        z = z + (F.col(name) - mean) / scale * coefficient
    return sigmoid(z, 700.0)


def rescored(df: DataFrame, profile: dict[str, tuple[float, float, float]], intercept: float, blend: float) -> DataFrame:
    """The score blended geometrically with the quality of the evidence, within 0 and 1; as it was if `blend` is 0."""
    mixed = geometric_blend(F.col("score"), quality(profile, intercept), blend) if blend else F.col("score")
    return df.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), mixed)))


def _over(value: Column, floor: float) -> Column:
    """How far a value is from `floor` to 1, from 0 to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - floor) / (1 - floor)))


def divided_by_largest(df: DataFrame) -> DataFrame:
    """Scores divided by the largest, if that is over 1: the order stays."""
    top = df.agg(F.greatest(F.lit(1.0), F.max("score")).alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn("score", F.col("score") / F.col("_top")).drop("_top")


def consensus_delta(df: DataFrame, floor: float = 0.6, agreement: float = 0.18, views: float = 0.08, sources: float = 0.05, edge: float = 0.10, least: float = -0.10, most: float = 0.25) -> DataFrame:
    """Scores times exp(delta), delta from the agreement of models, of views, the number of sources and a box seen at tile edges alone;
    all divided by the largest if that is over 1. `df` holds the evidence."""
    delta = (agreement * F.col("both_models") * _over(F.col("ab_iou"), floor) + views * F.col("has_views").cast("double") * _over(F.col("coherence"), floor)
             + sources * F.log2(F.least(F.lit(4.0), F.greatest(F.lit(1.0), F.col("sources")))) / 2 - edge * F.col("edge_only"))
    return divided_by_largest(df.withColumn("score", F.col("score") * F.exp(F.least(F.lit(most), F.greatest(F.lit(least), delta)))))


def view_invariant_delta(df: DataFrame, floor: float = 0.6, amplitude: float = 0.08) -> DataFrame:
    """Scores times exp(amplitude * strength * (2 percentile - 1)): strength is how far the models' agreement is over `floor`, its percentile that among
    the supported rows of the class; rows without support stay. All divided by the largest if that is over 1. `df` holds the evidence."""
    supported = (F.col("both_models") > 0) & (F.col("ab_iou") > floor)
    df = stored(df)  # read for the ranks, twice for the rows and for the largest score
    df = df.withColumn("_strength", F.when(supported, _over(F.col("ab_iou"), floor)))
    ranked = average_ranks(df.filter(supported), ["class_id"], "_strength", "_rank", "_all").withColumn("_d", amplitude * F.col("_strength") * (2 * (F.col("_rank") + 0.5) / F.col("_all") - 1))
    rest = df.filter(~supported).withColumn("_d", F.lit(0.0))
    out = ranked.drop("_rank", "_all").unionByName(rest)
    return divided_by_largest(out.withColumn("score", F.col("score") * F.exp("_d")).drop("_d", "_strength"))


def robust_refinement(df: DataFrame, width: Column | float, height: Column | float, most_dispersion: float = 0.20, trust: float = 0.85, least_donors: int = 2, score_power: float = 0.5, iou_power: float = 1.0) -> DataFrame:
    """Boxes moved to the weighted median of their donors in latent space, where the evidence is good; `reason` says why not elsewhere.

    Donors: whole-image boxes, and tile boxes off the tiles' edges; weight: powers of the score and of the IoU with the anchor. `df` holds
    the evidence."""
    donors = F.filter("reps", lambda r: r["is_global"] | ~r["touches_edge"])
    weight = lambda r: F.pow(F.greatest(r["p_score"], F.lit(TINY)), score_power) * F.pow(F.greatest(r["iou"], F.lit(TINY)), iou_power)
    local = F.exists("reps", lambda r: ~r["touches_edge"] & ~r["is_global"])
    stays = (F.when(F.col("both_models") == 0, "missing_model").when(F.col("dispersion") > most_dispersion, "dispersed").when(~local, "no_local_donor").when(F.size(donors) < least_donors, "few_donors"))
    # a box that stays has no donors to sum up
    g = df.withColumn("_s", stays).withColumn("_d", F.when(F.col("_s").isNull(), F.transform(donors, lambda r: F.struct(latent(r).alias("l"), weight(r).alias("w")))))

    def median(field: str) -> Column:
        rows = F.array_sort(F.transform("_d", lambda x: F.struct(x["l"][field].alias("v"), x["w"].alias("w"))))
        total = F.aggregate("_d", F.lit(0.0), lambda s, x: s + x["w"])
        step = lambda s, x: F.struct((s["c"] + x["w"]).alias("c"), F.when(s["v"].isNull() & (s["c"] + x["w"] >= total / 2), x["v"]).otherwise(s["v"]).alias("v"))
        return F.aggregate(rows, F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("v")), step)["v"]

    g = g.withColumn("_m", F.struct(*[median(f).alias(f) for f in ("cx", "cy", "lw", "lh")])).withColumn("_b", from_latent(F.col("_m"), width, height))
    reason = (F.when(F.col("_s").isNotNull(), F.col("_s")).when((F.col("_b.x2") <= F.col("_b.x1")) | (F.col("_b.y2") <= F.col("_b.y1")), "invalid").when(iou("", F.col("_b")) < trust, "out_of_trust").otherwise("refined"))
    g = g.withColumn("reason", reason)
    ok = F.col("reason") == "refined"
    return g.withColumns({c: F.when(ok, F.col(f"_b.{c}")).otherwise(F.col(c)) for c in BOX}).drop("_s", "_d", "_m", "_b")


def seam_statistics(df: DataFrame, xs: list[float], ys: list[float], margin: float) -> DataFrame:
    """Boxes with a side near an internal tile line, by direction and class."""
    near = lambda cols, at: F.exists(F.array(*[F.lit(float(p)) for p in at]), lambda p: (F.abs(F.col(cols[0]) - p) <= margin) | (F.abs(F.col(cols[1]) - p) <= margin))
    return df.groupBy("class_id").agg(F.count("*").alias("n"), F.count_if(near(("x1", "x2"), xs)).alias("vertical"), F.count_if(near(("y1", "y2"), ys)).alias("horizontal"))
