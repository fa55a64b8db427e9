"""Tiling and sampling: table-generating operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybox.functions.columns import BOX, hash_fraction, iou
from tallybox.operators.order import row_numbers

TILE = ["tx", "ty", "tw", "th"]


def _starts(length: Column, tile: Column, stride: Column) -> Column:
    """Starts every `stride`, the last one moved to the edge."""
    last = F.greatest(F.lit(0), length - tile)
    return F.array_sort(F.array_distinct(F.array_append(F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), last), stride), lambda p: p <= last), last)))


def sliding_tiles(images: DataFrame, tile: int, overlap: float) -> DataFrame:
    """A row for each square tile of each image: stride tile * (1 - overlap), edge-aligned at the end."""
    stride = F.lit(max(1, round(tile * (1 - overlap))))
    w, h = F.col("width").cast("int"), F.col("height").cast("int")
    d = images.select("image_id", "width", "height", F.explode(_starts(w, F.least(F.lit(tile), w), stride)).alias("tx"))
    d = d.select("*", F.explode(_starts(h, F.least(F.lit(tile), h), stride)).alias("ty"))
    return d.select("image_id", "tx", "ty", F.least(F.lit(tile), w).alias("tw"), F.least(F.lit(tile), h).alias("th"))


def grid_tiles(images: DataFrame, tw: int, th: int, rows: int, cols: int) -> DataFrame:
    """rows x cols tiles, evenly spaced from edge to edge, starts rounded half-even, equal ones once."""
    def starts(length: Column, tile: int, n: int) -> Column:
        span = F.greatest(F.lit(0), length.cast("int") - tile)
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(span * i / max(1, n - 1)).cast("int")))

    d = images.select("image_id", "height", F.explode(starts(F.col("width"), tw, cols)).alias("tx"))
    return d.select("image_id", "tx", F.explode(starts(F.col("height"), th, rows)).alias("ty"), F.lit(tw).alias("tw"), F.lit(th).alias("th"))


def strip_tiles(images: DataFrame, width: int, overlap: float) -> DataFrame:
    """Full-height strips, sliding in x only."""
    w = F.col("width").cast("int")
    s = _starts(w, F.least(F.lit(width), w), F.lit(max(1, round(width * (1 - overlap)))))
    return images.select("image_id", F.explode(s).alias("tx"), F.lit(0).alias("ty"), F.least(F.lit(width), w).alias("tw"), F.col("height").cast("int").alias("th"))


def squares_and_strips(images: DataFrame, tile: int, overlap: float) -> DataFrame:
    """Squares, and full-height strips at the same places in x."""
    return sliding_tiles(images, tile, overlap).union(strip_tiles(images, tile, overlap)).distinct()


def assign_boxes(tiles: DataFrame, boxes: DataFrame, min_visibility: float, min_size: float = 1.0) -> DataFrame:
    """Boxes in tile coordinates, clipped. Kept if visible enough, or the centre is inside, or the box spans the tile.

    A range join: equal image, overlapping areas."""
    ids = [c for c in boxes.columns if c not in ("image_id", *BOX)]
    j = tiles.join(boxes, "image_id").filter((F.col("x1") < F.col("tx") + F.col("tw")) & (F.col("x2") > F.col("tx")) & (F.col("y1") < F.col("ty") + F.col("th")) & (F.col("y2") > F.col("ty")))
    cx1, cy1 = F.greatest(F.col("x1"), F.col("tx").cast("double")), F.greatest(F.col("y1"), F.col("ty").cast("double"))
    cx2, cy2 = F.least(F.col("x2"), (F.col("tx") + F.col("tw")).cast("double")), F.least(F.col("y2"), (F.col("ty") + F.col("th")).cast("double"))
    share = (cx2 - cx1) * (cy2 - cy1) / F.greatest((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), F.lit(1e-9))
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    centre = (mx >= F.col("tx")) & (mx < F.col("tx") + F.col("tw")) & (my >= F.col("ty")) & (my < F.col("ty") + F.col("th"))
    spans = ((F.col("x1") <= F.col("tx")) & (F.col("x2") >= F.col("tx") + F.col("tw"))) | ((F.col("y1") <= F.col("ty")) & (F.col("y2") >= F.col("ty") + F.col("th")))
    keep = ((share >= min_visibility) | centre | spans) & (cx2 - cx1 >= min_size) & (cy2 - cy1 >= min_size)
    return j.select("image_id", *TILE, *ids, (cx1 - F.col("tx")).alias("x1"), (cy1 - F.col("ty")).alias("y1"), (cx2 - F.col("tx")).alias("x2"), (cy2 - F.col("ty")).alias("y2"), share.alias("visibility"), keep.alias("kept"))


def sample_negatives(tiles: DataFrame, ratio: float, seed: str) -> DataFrame:
    """All positive tiles and, of each image's others, the first max(1, round(max(1, positives) * ratio)) by hash. tiles: positive boolean."""
    w = Window.partitionBy("image_id")
    cap = F.greatest(F.lit(1.0), F.rint(F.greatest(F.sum(F.col("positive").cast("int")).over(w), F.lit(1)) * ratio))
    h = F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in ("image_id", "tx", "ty")]), 256)
    r = F.row_number().over(Window.partitionBy("image_id", "positive").orderBy(h, "tx", "ty"))
    return tiles.withColumn("_cap", cap).withColumn("_r", r).filter(F.col("positive") | (F.col("_r") <= F.col("_cap"))).drop("_cap", "_r")


def repeat_factors(classes: DataFrame, key: str, most: float) -> DataFrame:
    """(key, copies): how often a tile stands in all: the largest sqrt(majority / presence) of its classes, capped, rounded
    half-even. classes: key, class_id."""
    d = classes.select(key, "class_id").distinct()
    presence = d.groupBy("class_id").agg(F.count("*").alias("n"))
    top = presence.agg(F.max("n").alias("top"))
    f = presence.crossJoin(F.broadcast(top)).select("class_id", F.least(F.lit(float(most)), F.sqrt(F.col("top") / F.col("n"))).alias("f"))
    return d.join(F.broadcast(f), "class_id").groupBy(key).agg(F.greatest(F.lit(1), F.rint(F.max("f")).cast("int")).alias("copies"))


def repeated(rows: DataFrame, copies: str) -> DataFrame:
    """Each row as often as its `copies` says, numbered from 0."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))


def hard_negatives(pred: DataFrame, gt: DataFrame, most_iou: float, per_class: int, per_image: int) -> DataFrame:
    """Boxes that no truth of their image overlaps by `most_iou`: the best of each class, then of each image."""
    g = gt.select("image_id", *[F.col(c).alias("g" + c) for c in BOX])
    near = pred.join(g, "image_id").filter(iou("", "g") >= most_iou).select("det_id").distinct()
    d = pred.join(near, "det_id", "left_anti")
    d = d.withColumn("_c", F.row_number().over(Window.partitionBy("image_id", "class_id").orderBy(F.desc("score"), "det_id"))).filter(F.col("_c") <= per_class)
    return d.withColumn("_i", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "det_id"))).filter(F.col("_i") <= per_image).drop("_c", "_i")


def systematic_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n rows evenly spaced in key order: the indices of a linear spacing, cut to whole numbers."""
    total = rows.count()
    at = sorted({int(i * (total - 1) / max(1, n - 1)) for i in range(n)}) if total else []
    return row_numbers(rows, [F.col(key)], "_i").filter((F.col("_i") - 1).isin(at)).drop("_i")


def _uniform(seed: str, *key: Column):
    """letter -> (low, high) -> a draw by the hash of the key and the letter."""
    text = F.concat_ws(":", *[k.cast("string") for k in key])
    return lambda letter, low=0.0, high=1.0: low + (high - low) * hash_fraction(F.concat(text, F.lit(letter)), seed)


def _given(value: Column, f) -> Column:
    """f(value), with the value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _around(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip((cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2), BOX, strict=True)])


def _draws(seed: str, key: list[Column], ranges: dict[str, tuple[float, float]]) -> Column:
    u = _uniform(seed, *key)
    return F.struct(*[u(k, *r).alias(k) for k, r in ranges.items()])


def _first(tries: int, box, holds) -> Column:
    """(try, x1 .. y2) of the first try whose box `holds`, null if none does. Later tries are not drawn."""
    none = F.lit(None).cast("struct<try:int,x1:double,y1:double,x2:double,y2:double>")
    taken = lambda i, b: F.struct(i.alias("try"), *[b[c].alias(c) for c in BOX])
    step = lambda found, i: F.when(found.isNotNull(), found).otherwise(_given(box(i), lambda b: F.when(holds(b), taken(i, b))))
    return F.aggregate(F.sequence(F.lit(0), F.lit(tries - 1)), none, step)


def jittered_proposals(gt: DataFrame, tries: int, least_iou: float, seed: str) -> DataFrame:
    """(gt_id, try, px1 .. py2): a copy of each truth, moved and scaled a little: the first hash-drawn try with an IoU of at least `least_iou`, else the truth itself (try -1)."""
    w, h = F.greatest(F.col("x2") - F.col("x1"), F.lit(2.0)), F.greatest(F.col("y2") - F.col("y1"), F.lit(2.0))
    ranges = {"a": (0.9, 1.12), "b": (0.9, 1.12), "c": (-0.07, 0.07), "d": (-0.07, 0.07)}

    def box(i):
        place = lambda u: _around((F.col("x1") + F.col("x2")) / 2 + u["c"] * w, (F.col("y1") + F.col("y2")) / 2 + u["d"] * h, w * u["a"], h * u["b"])
        return _given(_draws(seed, [F.col("gt_id"), i], ranges), place)

    truth = F.struct(*BOX)
    best = _first(tries, box, lambda b: iou(truth, b) >= least_iou)
    b = F.coalesce(best, F.struct(F.lit(-1).alias("try"), *BOX))
    return gt.repartition("gt_id").select("gt_id", F.explode(F.array(b)).alias("b")).select("gt_id", "b.try", *[F.col(f"b.{c}").alias("p" + c) for c in BOX])


def scaled_proposals(gt: DataFrame, count: int, width: float, height: float, seed: str) -> DataFrame:
    """(gt_id, try, px1 .. py2): copies of each truth scaled by exp(-1 .. 0.7) and shifted by up to 0.55 of its size, the first of them cut to 0.35 of its height
    instead; clipped to the image, two pixels each way at least."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ranges = {"a": (-1.0, 0.7), "b": (-1.0, 0.7), "c": (-0.55, 0.55), "d": (-0.55, 0.55)}
    on = {"x1": width, "x2": width, "y1": height, "y2": height}

    def box(i):
        first = i == 0
        place = lambda u: _around((F.col("x1") + F.col("x2")) / 2 + u["c"] * w, (F.col("y1") + F.col("y2")) / 2 + u["d"] * h, F.when(first, w).otherwise(w * F.exp(u["a"])), F.when(first, h * 0.35).otherwise(h * F.exp(u["b"])))
        inside = lambda b: F.struct(i.alias("try"), *[F.greatest(F.lit(0.0), F.least(b[c], F.lit(on[c]))).alias(c) for c in BOX])
        return _given(_given(_draws(seed, [F.col("gt_id"), i], ranges), place), inside)

    t = gt.repartition("gt_id").select("gt_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), box)).alias("b"))
    return t.filter("b.x2 - b.x1 >= 2 and b.y2 - b.y1 >= 2").select("gt_id", "b.try", *[F.col(f"b.{c}").alias("p" + c) for c in BOX])


def negative_proposals(images: DataFrame, gt: DataFrame, count: int, tries: int, most_iou: float, seed: str) -> DataFrame:
    """(image_id, no, try, px1 .. py2): boxes of each image that hold no truth: the first hash-drawn try with an IoU under `most_iou` to every truth. One in five has a size of
    20 to 240, the others that of a truth of the image within a quarter (the former, if it has none); 12 pixels to 0.7 of the image."""
    truths = gt.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("gt_id", *BOX))).alias("g"))
    t = images.select("image_id", "width", "height").join(truths, "image_id", "left").withColumn("g", F.coalesce("g", F.array().cast(truths.schema["g"].dataType)))
    t = t.withColumn("no", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    ranges = {"a": (20.0, 240.0), "b": (0.75, 1.25), "c": (20.0, 240.0), "d": (0.75, 1.25), "k": (0.0, 1.0), "p": (0.0, 1.0), "x": (0.0, 1.0), "y": (0.0, 1.0)}

    def size(u, low, high, a, b, top):
        pick = F.get("g", F.floor(u["p"] * F.size("g")).cast("int"))
        free = (u["k"] < 0.2) | (F.size("g") == 0)
        return F.least(F.greatest(F.when(free, u[a]).otherwise((pick[high] - pick[low]) * u[b]), F.lit(12.0)), F.col(top) * 0.7)

    def box(i):
        sized = lambda u: F.struct(size(u, "x1", "x2", "a", "b", "width").alias("w"), size(u, "y1", "y2", "c", "d", "height").alias("h"), u["x"].alias("x"), u["y"].alias("y"))
        at = lambda s: F.struct(((F.col("width") - s["w"]) * s["x"]).alias("x"), ((F.col("height") - s["h"]) * s["y"]).alias("y"), s["w"].alias("w"), s["h"].alias("h"))
        corners = lambda s: F.struct(s["x"].alias("x1"), s["y"].alias("y1"), (s["x"] + s["w"]).alias("x2"), (s["y"] + s["h"]).alias("y2"))
        return _given(_given(_given(_draws(seed, [F.col("image_id"), F.col("no"), i], ranges), sized), at), corners)

    best = _first(tries, box, lambda b: F.forall("g", lambda k: iou(b, k) < most_iou))
    out = t.select("image_id", "no", F.explode(F.array(best)).alias("b")).filter("b is not null")
    return out.select("image_id", "no", "b.try", *[F.col(f"b.{c}").alias("p" + c) for c in BOX])


def stitch_fragments(df: DataFrame, top: int = 40, overlap: float = 0.45, gap: float = 60.0, growth: float = 1.35, factor: float = 0.9, per_image: int = 15) -> DataFrame:
    """Unions of two collinear boxes of one image and class that overlap in x and leave a small gap in y; the best few of each image."""
    d = df.withColumn("_k", F.row_number().over(Window.partitionBy("image_id", "class_id").orderBy(F.desc("score"), "det_id"))).filter(F.col("_k") <= top).drop("_k")
    o = d.select("image_id", "class_id", F.col("det_id").alias("oid"), F.col("score").alias("os"), *[F.col(c).alias("o" + c) for c in BOX])
    w = F.least(F.col("x2"), F.col("ox2")) - F.greatest(F.col("x1"), F.col("ox1"))
    p = d.join(o, ["image_id", "class_id"]).filter("y1 < oy1 or (y1 = oy1 and det_id < oid)").filter("det_id <> oid")
    share = w / F.greatest(F.least(F.col("x2") - F.col("x1"), F.col("ox2") - F.col("ox1")), F.lit(1e-9))
    space = F.col("oy1") - F.col("y2")
    u = [F.least("x1", "ox1").alias("ux1"), F.least("y1", "oy1").alias("uy1"), F.greatest("x2", "ox2").alias("ux2"), F.greatest("y2", "oy2").alias("uy2")]
    p = p.filter((share >= overlap) & (space <= gap) & (space >= -gap)).select("image_id", "class_id", "det_id", "oid", *u, (F.least("score", "os") * factor).alias("score"), F.greatest(F.col("y2") - F.col("y1"), F.col("oy2") - F.col("oy1")).alias("_h"))
    p = p.filter((F.col("uy2") - F.col("uy1")) >= growth * F.col("_h")).drop("_h")
    p = p.withColumn("_d", F.row_number().over(Window.partitionBy("image_id", "class_id", "ux1", "uy1", "ux2", "uy2").orderBy(F.desc("score"), "det_id", "oid"))).filter("_d = 1").drop("_d")
    return p.withColumn("_r", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "det_id", "oid"))).filter(F.col("_r") <= per_image).drop("_r")


def diagnostic_set(boxes: DataFrame, images: DataFrame, per_class: int, empty: int) -> DataFrame:
    """For each class in turn the images with the fewest other boxes, none used twice, and a few empty ones.

    At most per_class * (classes + 1) candidates of a class can ever be needed, so only these reach the greedy step."""
    n = boxes.groupBy("image_id").agg(F.count("*").alias("total"))
    c = boxes.groupBy("image_id", "class_id").agg(F.count("*").alias("own")).join(n, "image_id").withColumn("others", F.col("total") - F.col("own"))
    classes = sorted(r["class_id"] for r in c.select("class_id").distinct().collect())
    need = per_class * (len(classes) + 1)
    c = c.withColumn("_r", F.row_number().over(Window.partitionBy("class_id").orderBy("others", "image_id"))).filter(F.col("_r") <= need)
    ranked: dict[int, list[int]] = {}
    for r in c.orderBy("class_id", "_r").collect():
        ranked.setdefault(r["class_id"], []).append(r["image_id"])
    used: set[int] = set()
    out = []
    for k in classes:
        for i in [i for i in ranked[k] if i not in used][:per_class]:
            used.add(i)
            out.append((int(k), int(i)))
    bare = images.select("image_id").join(boxes.select("image_id").distinct(), "image_id", "left_anti").orderBy("image_id").limit(empty)
    chosen = boxes.sparkSession.createDataFrame(out, "class_id int, image_id long")
    return chosen.union(bare.select(F.lit(-1).alias("class_id"), "image_id"))
