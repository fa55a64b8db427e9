"""The box builders and tilings for use from SQL text: scalar and table functions whose bodies are SQL, so plans hold no Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

_BOX = "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
_PAIR = "ax1 DOUBLE, ay1 DOUBLE, ax2 DOUBLE, ay2 DOUBLE, bx1 DOUBLE, by1 DOUBLE, bx2 DOUBLE, by2 DOUBLE"
_STRUCT = "STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>"
_A, _B = "box_area(ax1, ay1, ax2, ay2)", "box_area(bx1, by1, bx2, by2)"
_I = "box_intersection(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2)"
_HULL = "((greatest(ax2, bx2) - least(ax1, bx1)) * (greatest(ay2, by2) - least(ay1, by1)))"


def _box(*sides: str) -> str:
    return "named_struct(" + ", ".join(f"'{n}', CAST({s} AS DOUBLE)" for n, s in zip(("x1", "y1", "x2", "y2"), sides, strict=True)) + ")"


#: name -> (parameters, result, body)
SCALARS = {
    "box_area": (_BOX, "DOUBLE", "greatest(0D, x2 - x1) * greatest(0D, y2 - y1)"),
    "box_intersection": (_PAIR, "DOUBLE", "greatest(0D, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0D, least(ay2, by2) - greatest(ay1, by1))"),
    "box_iou": (_PAIR, "DOUBLE", f"{_I} / greatest({_A} + {_B} - {_I}, 1e-9D)"),
    "box_ioa": (_PAIR, "DOUBLE", f"{_I} / greatest({_A}, 1e-9D)"),
    "box_giou_loss": (_PAIR, "DOUBLE", f"1 - (box_iou(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) - ({_HULL} - ({_A} + {_B} - {_I})) / greatest({_HULL}, 1e-9D))"),
    "box_clip": (f"{_BOX}, width DOUBLE, height DOUBLE", _STRUCT, _box(*[f"least(greatest({s}, 0D), {top})" for s, top in (("x1", "width"), ("y1", "height"), ("x2", "width"), ("y2", "height"))])),
    "box_scale": (f"{_BOX}, sx DOUBLE, sy DOUBLE, dx DOUBLE, dy DOUBLE", _STRUCT, _box(
        "(x1 + x2) / 2 + (x2 - x1) * sx * dx - (x2 - x1) * sx / 2", "(y1 + y2) / 2 + (y2 - y1) * sy * dy - (y2 - y1) * sy / 2", "(x1 + x2) / 2 + (x2 - x1) * sx * dx + (x2 - x1) * sx / 2", "(y1 + y2) / 2 + (y2 - y1) * sy * dy + (y2 - y1) * sy / 2")),
    "box_round": (_BOX, _STRUCT, _box("rint(x1)", "rint(y1)", "rint(x2)", "rint(y2)")),
    "box_to_yolo": (f"{_BOX}, width DOUBLE, height DOUBLE", "STRUCT<cx: DOUBLE, cy: DOUBLE, w: DOUBLE, h: DOUBLE>", "named_struct('cx', (x1 + x2) / 2 / width, 'cy', (y1 + y2) / 2 / height, 'w', (x2 - x1) / width, 'h', (y2 - y1) / height)"),
    "box_larger_than": (f"{_BOX}, side DOUBLE", "BOOLEAN", "x2 - x1 > side AND y2 - y1 > side"),
}
_TILES = "tx INT, ty INT, tw INT, th INT"


def _starts(length: str) -> str:
    """Where tiles begin along a side: the last one ends at its end."""
    last = f"greatest({length} - least(tile, {length}), 0)"
    return f"explode(array_distinct(concat(sequence(0, {last}, greatest(1, CAST(rint(tile * (1 - overlap)) AS INT))), array({last}))))"


TABLES = {
    "sliding_tiles": ("width INT, height INT, tile INT, overlap DOUBLE", _TILES, f"SELECT x, y, least(tile, width), least(tile, height) FROM (SELECT {_starts('width')} AS x) CROSS JOIN (SELECT {_starts('height')} AS y)"),
    "strip_tiles": ("width INT, height INT, tile INT, overlap DOUBLE", _TILES, f"SELECT x, 0, least(tile, width), height FROM (SELECT {_starts('width')} AS x)"),
}


def register(spark: SparkSession) -> None:
    """Makes SCALARS and TABLES known to the session. Use: `SELECT box_iou(a.x1, .., b.y2)`; `FROM images, LATERAL sliding_tiles(width, height, 1024, 0.25)`."""
    for name, (parameters, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, (parameters, result, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({result}) RETURN {body}")
