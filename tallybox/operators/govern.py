"""Duplicates, groups, splits, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybox.operators.order import blocks
from tallybox.session import cut as checkpointed


def fingerprints(prints: DataFrame) -> DataFrame:
    """`prints` (id, thumb, width) with dhash (the signs of the first 64 numbers as bits) and pixel (a hash of all)."""
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda s, i: s.bitwiseOR(F.when(F.coalesce(F.get("thumb", i), F.lit(0.0)) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))))
    return prints.withColumns({"dhash": bits, "pixel": F.sha2(F.array_join(F.transform("thumb", lambda x: x.cast("bigint").cast("string")), ","), 256)})


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def near_duplicate_pairs(prints: DataFrame, distance: int = 4, least_std: float = 4.0, least_corr: float = 0.9995, most_rmse: float = 1.0) -> DataFrame:
    """Pairs a < b of fingerprints of one size and different pixels whose hashes differ in at most `distance` bits and whose thumbnails,
    neither of them flat, agree: hashes alone take uniform textures for each other.

    Hashes are cut into distance + 1 bands; by the pigeonhole principle such a pair agrees in one of them, so the join is on
    bands (and sizes), on ids and hashes alone: equal pixels stand for each other there, and thumbnails are fetched for the pairs that are left."""
    n = distance + 1
    width = -(-64 // n)
    mean = _total(F.col("thumb")) / F.size("thumb")
    std = F.sqrt(_total(F.transform("thumb", lambda x: x * x)) / F.size("thumb") - mean * mean)
    rows = prints.withColumns({"_mean": mean, "_std": std}).filter(F.col("_std") >= least_std)
    one = rows.groupBy("width", "pixel").agg(F.min("id").alias("id"), F.first("dhash").alias("dhash"))
    bands = F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("dhash", i * width).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")).alias("w")) for i in range(n)])
    keys = one.select("id", "dhash", "width", "pixel", F.explode(bands).alias("_b"))
    a, b = (keys.select("_b", "width", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "dhash", "pixel")]) for x in "ab")
    p = a.join(b, ["_b", "width"]).filter("id_a < id_b").withColumn("distance", F.bit_count(F.col("dhash_a").bitwiseXOR(F.col("dhash_b"))).cast("bigint")).filter(F.col("distance") <= distance)
    p = p.select("width", "id_a", "pixel_a", "id_b", "pixel_b", "distance").distinct()
    x, y = (rows.select(F.col("id").alias(f"id_{k}"), F.col("thumb").alias(f"t{k}"), F.col("_mean").alias(f"m{k}"), F.col("_std").alias(f"s{k}")) for k in "ab")
    p = p.join(x, "id_a").join(y, "id_b")
    cov = _total(F.zip_with("ta", "tb", lambda u, v: u * v)) / F.size("ta") - F.col("ma") * F.col("mb")
    p = p.withColumns({"corr": cov / (F.col("sa") * F.col("sb")), "rmse": F.sqrt(_total(F.zip_with("ta", "tb", lambda u, v: (u - v) * (u - v))) / F.size("ta"))})
    p = p.filter((F.col("corr") >= least_corr) & (F.col("rmse") <= most_rmse)).select("width", "pixel_a", "pixel_b", "distance", "corr", "rmse")
    # back to all rows of these pixels
    ids = rows.select("id", "width", "pixel")
    out = p.join(ids.toDF("a", "width", "pixel_a"), ["width", "pixel_a"]).join(ids.toDF("b", "width", "pixel_b"), ["width", "pixel_b"])
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance", "corr", "rmse")


def key_edges(rows: DataFrame, id_col: str) -> DataFrame:
    """(a, b): each row with the first row of every key that it shares; rows of a key are a star, not all pairs."""
    k = rows.select(F.col(id_col).alias("b"), F.explode("keys").alias("key"))
    heads = k.groupBy("key").agg(F.min("b").alias("a"), F.count("*").alias("n")).filter("n > 1").select("key", "a")
    return k.join(heads, "key").filter("a <> b").select("a", "b").distinct()


def connected_groups(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, head): the smallest id reachable. Labels spread along edges and are shortened through their own label each round."""
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "w").distinct())
    labels = checkpointed(vertices.select(F.col("id"), F.col("id").alias("head")))
    while True:
        near = both.join(labels.toDF("w", "h"), "w").groupBy(F.col("u").alias("id")).agg(F.min("h").alias("h"))
        step = labels.join(near, "id", "left").select("id", F.least("head", F.coalesce("h", "head")).alias("head"))
        jump = step.join(step.toDF("head", "up"), "head", "left").select("id", F.least("head", F.coalesce("up", "head")).alias("head"))
        new = checkpointed(jump)
        changed = new.join(labels.toDF("id", "old"), "id").filter("head <> old")
        if changed.isEmpty():
            return new
        labels = new


def group_names(groups: DataFrame) -> DataFrame:
    """(id, head, name): name is the beginning of the sha256 of the group's members, sorted as text, a line each."""
    names = groups.groupBy("head").agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(F.col("id").cast("string"))), "\n"), 256), 1, 20).alias("name"))
    return groups.join(names, "head").select("id", "head", "name")


def quarantine(members: DataFrame, marks: DataFrame) -> DataFrame:
    """(id, head, reasons): all members of groups in which a member has a mark (id, reason)."""
    bad = members.join(marks, "id").groupBy("head").agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))
    return members.join(bad, "head").select("id", "head", "reasons")


def _draw(seed: int, trial: Column, share: float) -> Column:
    """Whether a trial takes a group: by the group's own hash and the share itself in trial 0, by a hash with the trial and a share within 0.05 and 0.95 in others."""
    text = F.when(trial == 0, F.concat(F.lit(f"{seed}:"), F.col("grp"))).otherwise(F.concat(F.lit(f"{seed}:"), trial.cast("string"), F.lit(":"), F.col("grp")))
    part = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    return part < F.when(trial == 0, F.lit(share)).otherwise(F.lit(min(0.95, max(0.05, share))))


def split_costs(groups: DataFrame, classes: list[str], share: float, trials: int, seed: int) -> DataFrame:
    """(trial, cost): mean squared relative error of the class counts against the wanted share, half that of the images, and 4 for each class of
    two groups or more that either side lacks. Trials that take no group or all are left out. groups: grp, n (images), a count column per class.

    Trials are hash draws by (seed, trial, group); all are scored in one aggregation."""
    rows = groups.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("val", _draw(seed, F.col("trial"), share))
    taken = lambda c: F.sum(F.when(F.col("val"), F.col(c)).otherwise(0))
    error = lambda c: F.pow((taken(c) - F.sum(c) * share) / F.greatest(F.sum(c) * share, F.lit(1.0)), 2)
    missing = lambda c: F.when((F.count_if(F.col(c) > 0) >= 2) & ((taken(c) == 0) | (taken(c) == F.sum(c))), 4.0).otherwise(0.0)
    cost = sum((error(c) for c in classes), F.lit(0.0)) / len(classes) + 0.5 * error("n") + sum((missing(c) for c in classes), F.lit(0.0))
    return rows.groupBy("trial").agg(F.round(cost, 9).alias("cost"), F.count_if("val").alias("_v"), F.count("*").alias("_n")).filter("_v > 0 and _v < _n").select("trial", "cost")


def best_split(groups: DataFrame, classes: list[str], share: float, trials: int, seed: int) -> DataFrame:
    """(grp, val): the groups under the trial of least cost, the first of equals; the smallest group alone where no trial parts them."""
    best = split_costs(groups, classes, share, trials, seed).agg(F.min(F.struct("cost", "trial")).alias("b"), F.lit(0).alias("_")).select(F.col("b.trial").alias("trial"))
    first = groups.agg(F.min("grp").alias("first"))
    rows = groups.select("grp").crossJoin(F.broadcast(best)).crossJoin(F.broadcast(first))
    return rows.select("grp", F.when(F.col("trial").isNull(), F.col("grp") == F.col("first")).otherwise(_draw(seed, F.col("trial"), share)).alias("val"))


def three_way_split(groups: DataFrame, classes: list[str], val: float, calibration: float, trials: int, seed: int) -> DataFrame:
    """(grp, part): val, then calibration of what val leaves, by its share of that, and train."""
    one = best_split(groups, classes, val, trials, seed)
    if not calibration:
        return one.select("grp", F.when(F.col("val"), "val").otherwise("train").alias("part"))
    rest = groups.join(one.filter("not val").select("grp"), "grp")
    two = best_split(rest, classes, calibration / (1 - val), trials, seed + 1009)
    return one.filter("val").select("grp", F.lit("val").alias("part")).union(two.select("grp", F.when(F.col("val"), "calibration").otherwise("train").alias("part")))


def split_violations(members: DataFrame) -> DataFrame:
    """(kind, key): paths named twice in a split, and paths or groups in two splits. members: split, path, grp."""
    twice = members.groupBy("split", "path").count().filter("count > 1").select(F.lit("duplicate_path").alias("kind"), F.col("path").alias("key"))
    path = members.groupBy("path").agg(F.countDistinct("split").alias("n")).filter("n > 1").select(F.lit("shared_path").alias("kind"), F.col("path").alias("key"))
    grp = members.groupBy("grp").agg(F.countDistinct("split").alias("n")).filter("n > 1").select(F.lit("shared_group").alias("kind"), F.col("grp").alias("key"))
    return twice.union(path).union(grp).distinct()


def frozen_violations(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """(path, problem): missing, of another group, or with a changed hash."""
    n = now.select("path", F.col("grp").alias("g"), F.col("sha").alias("s"))
    problem = F.when(F.col("g").isNull(), "missing").when(F.col("g") != F.col("grp"), "group").when(F.col("s") != F.col("sha"), "changed")
    return frozen.join(n, "path", "left").select("path", problem.alias("problem")).filter("problem is not null")


def scope_violations(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, problem): rows of the split that were not evaluated, rows out of it, and rows evaluated twice."""
    missing = expected.select(key).join(found, key, "left_anti").select(key, F.lit("not_evaluated").alias("problem"))
    outside = found.select(key).distinct().join(expected, key, "left_anti").select(key, F.lit("out_of_scope").alias("problem"))
    return missing.union(outside).union(found.groupBy(key).count().filter("count > 1").select(key, F.lit("twice").alias("problem")))


def scope_problem() -> Column:
    """What an evaluation run (role, tune, row_limit, frozen, signature) must not do, or null: the final holdout is whole, untuned and of a frozen
    signature; thresholds are tuned on dev and calibration alone."""
    holdout, tune, limit = F.col("role") == "final_holdout", F.col("tune"), F.col("row_limit")
    return (F.when(limit < 0, "negative_limit").when(holdout & (tune | (limit > 0)), "holdout_not_whole")
            .when(holdout & ~F.coalesce(F.col("frozen") == F.col("signature"), F.lit(False)), "not_frozen").when(tune & ~F.col("role").isin("dev", "calibration"), "tuned"))


def box_problem(width: Column, height: Column, known_image: Column, known_class: Column) -> Column:
    """The first thing wrong with a prediction, or null."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    odd = F.lit(False)
    for c in (x1, y1, x2, y2):
        odd = odd | c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return (F.when(~known_image, "unknown_image").when(~known_class, "unknown_class").when(F.col("score").isNull() | F.isnan("score") | (F.col("score") < 0) | (F.col("score") > 1), "score")
            .when(odd, "box_not_finite").when((x2 <= x1) | (y2 <= y1), "box_empty").when((x1 < 0) | (y1 < 0) | (x2 > width) | (y2 > height), "box_outside"))


def hash_order_split(keys: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """(key, val): the first share of distinct keys by their hash; rows of a key stay together.

    The cut is the hash's quantile, so no ordered pass over all keys is needed."""
    d = keys.select(key).distinct().withColumn("_h", F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256))
    frac = F.conv(F.substring("_h", 1, 12), 16, 10).cast("bigint") / F.lit(float(16**12))
    return d.select(key, (frac < share).alias("val"))


def run_count(df: DataFrame, key: str, order: str) -> DataFrame:
    """Number of runs of a key in row order: over 1 where its rows are not contiguous.

    Rows are dealt by range of the order. Inside a block a row begins a run if the row before has another key; for the first row of a block
    that is the last one of the block before it that has rows."""
    rows = blocks(df.select(F.col(key).alias("_k"), F.col(order).alias("_o")), [], [F.col("_o"), F.col("_k")])
    ends = rows.groupBy("_block").agg(F.max_by("_k", F.struct("_o", "_k")).alias("_last"))
    ends = ends.select("_block", F.lag("_last").over(Window.orderBy("_block")).alias("_before"))  # a row for each block
    within = Window.partitionBy("_block").orderBy("_o", "_k")
    starts = rows.join(ends, "_block").withColumn("_p", F.coalesce(F.lag("_k").over(within), "_before")).filter(F.col("_p").isNull() | (F.col("_p") != F.col("_k")))
    return starts.groupBy(F.col("_k").alias(key)).agg(F.count("*").alias("runs"))
