"""Column builders for boxes, keys and scores. A box is four columns `<prefix>x1 .. <prefix>y2`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")
GUARD = 1e-9
#: The steps of the averaged IoU, as repeated addition of 0.05 gives them.
IOU_STEPS = (0.5, 0.55, 0.6000000000000001, 0.6500000000000001, 0.7000000000000002, 0.7500000000000002, 0.8000000000000003, 0.8500000000000003, 0.9000000000000004, 0.9500000000000004)


def num(v: Column | float) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def box(prefix: str | Column = "") -> tuple[Column, Column, Column, Column]:
    """The four coordinates; of a struct column if one is given."""
    if isinstance(prefix, Column):
        return tuple(prefix[c] for c in BOX)
    return tuple(F.col(prefix + c) for c in BOX)


def area(b) -> Column:
    x1, y1, x2, y2 = box(b)
    return F.greatest(F.lit(0.0), x2 - x1) * F.greatest(F.lit(0.0), y2 - y1)


def intersection(a, b) -> Column:
    ax1, ay1, ax2, ay2 = box(a)
    bx1, by1, bx2, by2 = box(b)
    return F.greatest(F.lit(0.0), F.least(ax2, bx2) - F.greatest(ax1, bx1)) * F.greatest(F.lit(0.0), F.least(ay2, by2) - F.greatest(ay1, by1))


def iou(a, b) -> Column:
    i = intersection(a, b)
    return i / F.greatest(area(a) + area(b) - i, F.lit(GUARD))


def ioa(a, b) -> Column:
    return intersection(a, b) / F.greatest(area(a), F.lit(GUARD))


def giou_loss(a, b) -> Column:
    ax1, ay1, ax2, ay2 = box(a)
    bx1, by1, bx2, by2 = box(b)
    hull = (F.greatest(ax2, bx2) - F.least(ax1, bx1)) * (F.greatest(ay2, by2) - F.least(ay1, by1))
    union = area(a) + area(b) - intersection(a, b)
    return 1 - (iou(a, b) - (hull - union) / F.greatest(hull, F.lit(GUARD)))


def box_struct(*coords: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip(coords, BOX, strict=True)])


def to_yolo(b, width: Column | float, height: Column | float) -> Column:
    x1, y1, x2, y2 = box(b)
    return F.struct(((x1 + x2) / 2 / width).alias("cx"), ((y1 + y2) / 2 / height).alias("cy"), ((x2 - x1) / width).alias("w"), ((y2 - y1) / height).alias("h"))


def from_yolo(cx: Column, cy: Column, w: Column, h: Column, width: Column | float, height: Column | float) -> Column:
    return box_struct((cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height)


def clip(b, width: Column | float, height: Column | float) -> Column:
    x1, y1, x2, y2 = box(b)
    on = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), num(top))
    return box_struct(on(x1, width), on(y1, height), on(x2, width), on(y2, height))


def larger_than(b, side: float = 1.0) -> Column:
    x1, y1, x2, y2 = box(b)
    return ((x2 - x1) > side) & ((y2 - y1) > side)


def scale(b, sx, sy, dx, dy) -> Column:
    """About the centre; the shift counts in units of the new size."""
    sx, sy, dx, dy = (v if isinstance(v, Column) else F.lit(float(v)) for v in (sx, sy, dx, dy))
    x1, y1, x2, y2 = box(b)
    w, h = (x2 - x1) * sx, (y2 - y1) * sy
    cx, cy = (x1 + x2) / 2 + w * dx, (y1 + y2) / 2 + h * dy
    return box_struct(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def dilate(b, sx: Column, sy: Column, width: Column | float, height: Column | float) -> Column:
    """Scaled about the centre, clipped, rounded, at least one pixel each way."""
    c = clip(scale(b, sx, sy, 0, 0), width, height)
    x1, y1, x2, y2 = (F.rint(v) for v in box(c))
    return box_struct(F.least(x1, num(width) - 1), F.least(y1, num(height) - 1), F.greatest(x2, F.least(x1, num(width) - 1) + 1), F.greatest(y2, F.least(y1, num(height) - 1) + 1))


def change_box(b, height_scale: float, width_scale: float, width: Column | float, height: Column | float) -> Column:
    """Both half sides scaled, at least 1, clipped."""
    x1, y1, x2, y2 = box(b)
    hw, hh = F.greatest(F.lit(1.0), (x2 - x1) * width_scale / 2), F.greatest(F.lit(1.0), (y2 - y1) * height_scale / 2)
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
    return clip(box_struct(cx - hw, cy - hh, cx + hw, cy + hh), width, height)


def expand_width(b, factor: float, image: Column, width: Column | float) -> Column:
    """Wider by `factor` about the centre, only in images whose id starts with a digit."""
    x1, y1, x2, y2 = box(b)
    hw, cx = (x2 - x1) * factor / 2, (x1 + x2) / 2
    on = image.cast("string").rlike("^[0-9]")
    return box_struct(F.when(on, F.greatest(F.lit(0.0), cx - hw)).otherwise(x1), y1, F.when(on, F.least(num(width), cx + hw)).otherwise(x2), y2)


def interpolate(a, b, alpha: float, width: Column | float, height: Column | float) -> Column:
    """From box a toward box b, clipped and rounded; a itself where nothing valid is left."""
    mixed = [p + (q - p) * alpha for p, q in zip(box(a), box(b), strict=True)]
    c = clip(box_struct(*mixed), width, height)
    r = box_struct(*[F.rint(v) for v in box(c)])
    return F.when((r.x2 > r.x1) & (r.y2 > r.y1), r).otherwise(box_struct(*box(a)))


def latent(b) -> Column:
    x1, y1, x2, y2 = box(b)
    return F.struct(((x1 + x2) / 2).alias("cx"), ((y1 + y2) / 2).alias("cy"), F.ln(F.greatest(x2 - x1, F.lit(GUARD))).alias("lw"), F.ln(F.greatest(y2 - y1, F.lit(GUARD))).alias("lh"))


def from_latent(v: Column, width: Column | float, height: Column | float) -> Column:
    w, h = F.exp(v.lw), F.exp(v.lh)
    return clip(box_struct(v.cx - w / 2, v.cy - h / 2, v.cx + w / 2, v.cy + h / 2), width, height)


def round_box(b, mode: str = "nearest") -> Column:
    """Half-even to the nearest pixel, or outward."""
    x1, y1, x2, y2 = box(b)
    if mode == "outward":
        return box_struct(F.floor(x1), F.floor(y1), F.ceil(x2), F.ceil(y2))
    return box_struct(*[F.rint(v) for v in (x1, y1, x2, y2)])


def touches_internal_edge(b, tile, image_width: Column | float, image_height: Column | float, margin: float = 12.0) -> Column:
    """Near a side of its tile that is not a side of the image. Box and tile in image coordinates."""
    x1, y1, x2, y2 = box(b)
    tx1, ty1, tx2, ty2 = box(tile)
    return (((x1 <= tx1 + margin) & (tx1 > 0)) | ((y1 <= ty1 + margin) & (ty1 > 0)) | ((x2 >= tx2 - margin) & (tx2 < image_width)) | ((y2 >= ty2 - margin) & (ty2 < image_height)))


def edge_score(score: Column, touches: Column, factor: float) -> Column:
    return score * F.when(touches, F.lit(factor)).otherwise(F.lit(1.0))


def tile_to_image(b, scale_: Column, tx: Column, ty: Column) -> Column:
    x1, y1, x2, y2 = box(b)
    return box_struct(x1 * scale_ + tx, y1 * scale_ + ty, x2 * scale_ + tx, y2 * scale_ + ty)


def parse_tile_id(name: Column) -> Column:
    """`source::xX_yY` as (source, x, y); an id without a tile is its own source at (0, 0)."""
    at = lambda k: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(name, r"::x(\d+)_y(\d+)$", k), F.lit("")), F.lit("999999999")), F.lit(0)).cast("int")
    return F.struct(F.regexp_replace(name, r"::x\d+_y\d+$", "").alias("source"), at(1).alias("x"), at(2).alias("y"))


def first_group(text: Column, *patterns: str) -> Column:
    """The first pattern's group 1 that is not empty, else the text."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns], text)


def group_key(stem: Column) -> Column:
    """What frames of one strip share: what stands before `-Raw12` or `_raw12`, or a camera name without its frame number, else the name itself."""
    before = F.regexp_extract(stem, r"(?i)^(.*?)[-_]Raw\d+", 1)
    return F.when(stem.rlike(r"(?i)[-_]Raw\d+"), before).otherwise(first_group(stem, r"(?i)^(img_\d+_.+)_\d+$"))


def source_keys(stem: Column) -> Column:
    """Keys by which sources may belong together: `raw:` and the part before Raw, `candidate_c:` and the C part of a C.._V.._F name in lower case."""
    raw = F.when(stem.rlike(r"(?i)[-_]Raw\d+"), F.concat(F.lit("raw:"), F.regexp_extract(stem, r"(?i)^(.*?)[-_]Raw\d+", 1)))
    c = r"(?i)^(C[^_]+)_V[^_]+_F"
    return F.array_compact(F.array(raw, F.when(stem.rlike(c), F.concat(F.lit("candidate_c:"), F.lower(F.regexp_extract(stem, c, 1))))))


def hash_fraction(text: Column, seed: str) -> Column:
    """The first 8 bytes of sha256(seed:text) as a fraction of 2^64."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), text), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def hash_fold(text: Column, folds: int = 5, digits: int = 16) -> Column:
    """The first hex digits of sha256(text), mod the number of folds."""
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10).cast("decimal(20,0)"), F.lit(folds).cast("decimal(20,0)")).cast("int")


def canonical_class(name: Column, aliases: dict[str, str]) -> Column:
    """Trimmed, lower-cased, without spaces, then by the alias table; an unknown name stays, never merged silently."""
    key = F.regexp_replace(F.lower(F.trim(name)), " ", "")
    if not aliases:
        return key
    table = F.create_map(*[F.lit(v) for pair in aliases.items() for v in pair])
    return F.coalesce(table[key], key)


def sanitize_box(b: Column, width: Column | float, height: Column | float, least: float = 1.0) -> Column:
    """An array of four numbers as a box: the full image if it is not four numbers; clamped, sorted, of minimum size."""
    width, height = num(width), num(height)
    bad = b.isNull() | (F.size(b) != 4) | F.exists(b, lambda v: v.isNull() | F.isnan(v))
    on = lambda i, top: F.least(F.greatest(F.get(b, F.lit(i)), F.lit(0.0)), top)
    xa, xb, ya, yb = on(0, width), on(2, width), on(1, height), on(3, height)
    x1, y1 = F.least(F.least(xa, xb), width - least), F.least(F.least(ya, yb), height - least)
    fixed = box_struct(x1, y1, F.greatest(F.greatest(xa, xb), x1 + least), F.greatest(F.greatest(ya, yb), y1 + least))
    return F.when(bad, box_struct(F.lit(0.0), F.lit(0.0), width, height)).otherwise(fixed)


def query_tokens(text: Column, limit: int = 16, vocabulary: int = 32768) -> Column:
    """Hashed ids (from 1) of the first tokens, padded with 0, and the mask of real ones."""
    words = F.slice(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9']+)"), F.lit(1)), 1, limit)
    ids = F.transform(words, lambda w: (F.conv(F.substring(F.sha2(w, 256), 1, 8), 16, 10).cast("bigint") % F.lit(vocabulary - 1) + 1).cast("int"))
    pad = F.array_repeat(F.lit(0), F.lit(limit) - F.size(words))
    return F.struct(F.concat(ids, pad).alias("ids"), F.transform(F.sequence(F.lit(1), F.lit(limit)), lambda i: i <= F.size(words)).alias("mask"))


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.ln(p / (1 - p))


def sigmoid(z: Column, clamp: float = 40.0) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-clamp)), F.lit(clamp))))
