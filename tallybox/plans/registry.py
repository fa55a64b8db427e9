"""The registered queries and the DuckDB SQL that checks them, over views derived from the given tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: Views that read the same in Spark SQL and DuckDB. Image counts grow with the data, so groups stay small.
VIEWS = {
    "det": """SELECT ((l_orderkey*10+l_linenumber)*100000+l_partkey)*10000+l_suppkey AS det_id,
       l_orderkey % (SELECT greatest(20, CAST(floor(count(*)/75) AS BIGINT)) FROM orders) AS image_id,
       CAST(l_partkey % 8 AS INT) AS class_id, CASE WHEN l_linenumber % 2 = 1 THEN 'a' ELSE 'b' END AS model,
       l_linenumber % 3 = 0 AS is_global, l_linenumber % 4 = 0 AS touches_edge,
       CAST(512*(l_partkey%6)+9*l_linenumber AS DOUBLE) AS x1, CAST(512*(l_suppkey%5)+l_orderkey%40 AS DOUBLE) AS y1,
       CAST(512*(l_partkey%6)+9*l_linenumber+200+l_quantity AS DOUBLE) AS x2, CAST(512*(l_suppkey%5)+l_orderkey%40+200+2*l_quantity AS DOUBLE) AS y2,
       CAST(CAST(floor(l_extendedprice) AS BIGINT)%1000 AS DOUBLE)/CAST(1000 AS DOUBLE) AS score FROM lineitem""",
    "gt": """SELECT o_orderkey AS gt_id, o_orderkey % (SELECT greatest(20, CAST(floor(count(*)/75) AS BIGINT)) FROM orders) AS image_id,
       CAST(o_custkey % 8 AS INT) AS class_id, CAST(512*(o_custkey%6)+20 AS DOUBLE) AS x1, CAST(512*(o_orderkey%5)+15 AS DOUBLE) AS y1,
       CAST(512*(o_custkey%6)+240 AS DOUBLE) AS x2, CAST(512*(o_orderkey%5)+265 AS DOUBLE) AS y2 FROM orders WHERE o_custkey % 3 = 0""",
    "images": "SELECT image_id, CAST(4096 AS DOUBLE) AS width, CAST(3000 AS DOUBLE) AS height, concat('g', CAST(image_id % 37 AS STRING)) AS grp, CASE WHEN image_id % 3 = 0 THEN 'grid' ELSE 'original' END AS view FROM (SELECT DISTINCT image_id FROM det) d",
    "det_a": "SELECT det_id, image_id, class_id, x1, y1, x2, y2, score FROM det WHERE model = 'a'",
    "det_b": "SELECT det_id, image_id, class_id, x1, y1, x2, y2, score FROM det WHERE model = 'b'",
    "actions": """SELECT * FROM (VALUES (0, 0, 1, 1.0D, 2.0D, 0.0D, 0.0D), (1, 1, 1, 1.2D, 1.0D, 0.1D, 0.0D), (2, 2, 3, 0.8D, 0.8D, 0.0D, -0.1D),
       (3, 3, 3, 1.0D, 1.0D, 0.5D, -0.5D), (4, 4, 5, 1.5D, 0.5D, 0.0D, 0.0D), (5, 5, 0, 1.0D, 1.0D, 0.0D, 0.0D)) AS t(action, source_class, target_class, sx, sy, dx, dy)""",
    "router": "SELECT * FROM (VALUES (0, 'a', 0.1D), (1, 'b', 0.2D), (2, 'a', 0.3D), (3, 'b', 0.05D), (4, 'a', 0.5D), (5, 'b', 0.4D), (6, 'a', 0.0D), (7, 'b', 0.25D)) AS t(class_id, model, threshold)",
    "prints": """SELECT vec_id, CAST(embedding AS DOUBLE[]) AS thumb, label FROM embeddings""",
    # fingerprints of images: each vector, and a copy of it that is the same, brighter by a little or by more, differs in places, or has another size
    "fingers": """SELECT vec_id*2 AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round_even(x*512, 0)) AS thumb, 64 AS width FROM embeddings UNION ALL
       SELECT vec_id*2+1, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: CASE vec_id % 6 WHEN 1 THEN round_even(x*512, 0) + CASE WHEN i = 1 THEN 1 ELSE 0 END WHEN 2 THEN round_even(x*512, 0)+1 WHEN 3 THEN round_even(x*512, 0)+3
       WHEN 4 THEN CASE WHEN i <= 5 THEN -round_even(x*512, 0) ELSE round_even(x*512, 0) END ELSE round_even(x*512, 0) END), CASE WHEN vec_id % 6 = 5 THEN 63 ELSE 64 END FROM embeddings""",
}
#: What a view's text becomes in Spark.
_SPARK = {"fingers": """SELECT vec_id*2 AS id, transform(CAST(embedding AS ARRAY<DOUBLE>), x -> rint(x*512)) AS thumb, 64 AS width FROM embeddings UNION ALL
       SELECT vec_id*2+1, transform(CAST(embedding AS ARRAY<DOUBLE>), (x, i) -> CASE vec_id % 6 WHEN 1 THEN rint(x*512) + CASE WHEN i = 0 THEN 1 ELSE 0 END WHEN 2 THEN rint(x*512)+1 WHEN 3 THEN rint(x*512)+3
       WHEN 4 THEN CASE WHEN i < 5 THEN -rint(x*512) ELSE rint(x*512) END ELSE rint(x*512) END), CASE WHEN vec_id % 6 = 5 THEN 63 ELSE 64 END FROM embeddings""",
          "prints": "SELECT vec_id, CAST(embedding AS ARRAY<DOUBLE>) AS thumb, label FROM embeddings"}
_NEEDS = {"images": ["det"], "det_a": ["det"], "det_b": ["det"]}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Views:
    """The tables and derived views of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        elif name in VIEWS:
            text = _SPARK.get(name, VIEWS[name])
            used = [t for t in [*TABLES, *VIEWS] if t != name and re.search(rf"\b(FROM|JOIN) {t}\b", text)]
            for t in used:
                text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
            df = self.spark.sql(text, **{t: getattr(self, t) for t in used})
        else:
            raise AttributeError(name)
        setattr(self, name, df)
        return df

    @cached_property
    def preds(self) -> DataFrame:
        return self.det


def with_views(body: str) -> str:
    """The SQL behind the views that it names."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", body)]
    for n in list(names):
        names += [m for m in _NEEDS.get(n, []) if m not in names]
    order = [n for n in VIEWS if n in names]
    ctes = ", ".join(f"{n} AS ({VIEWS[n].replace('D,', ',').replace('D)', ')') if n in ('actions', 'router') else VIEWS[n]})" for n in order)
    ctes = re.sub(r"\b(\d+\.\d+)(?=[,)])", r"CAST(\1 AS DOUBLE)", ctes) if {"actions", "router"} & set(order) else ctes
    if not ctes:
        return body
    head = re.match(r"\s*WITH( RECURSIVE)?\b", body)
    return f"WITH{head[1] or '' if head else ''} {ctes}{',' + body[head.end():] if head else ' ' + body}"


def query(name: str, sql: str | None = None):
    """Registers a query (a function of Views) under `name`, and its SQL."""
    def add(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_views(sql)
        return f
    return add


# --- SQL text for the checks ------------------------------------------------------------------

def sql_area(b: str) -> str:
    return f"(greatest(0.0::DOUBLE, {b}x2-{b}x1)*greatest(0.0::DOUBLE, {b}y2-{b}y1))"


def sql_inter(a: str, b: str) -> str:
    return f"(greatest(0.0::DOUBLE, least({a}x2,{b}x2)-greatest({a}x1,{b}x1))*greatest(0.0::DOUBLE, least({a}y2,{b}y2)-greatest({a}y1,{b}y1)))"


def sql_iou(a: str, b: str) -> str:
    return f"({sql_inter(a, b)}/greatest({sql_area(a)}+{sql_area(b)}-{sql_inter(a, b)}, 1e-9::DOUBLE))"


def sql_nms(source: str, threshold: float, keys: str = "image_id, class_id", limit: str = "") -> str:
    """CTE body: kept (keys, det_id) of a greedy suppression over `source`."""
    return f"""SELECT {keys}, unnest(list_transform({limit}(list_reduce(list_transform(b, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {sql_iou('k.', 'x[1].')} > {threshold}::DOUBLE)) > 0 THEN acc ELSE list_concat(acc, x) END)), lambda q: q.id)) AS det_id
 FROM (SELECT {keys}, list({{'id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY score DESC, det_id) AS b FROM {source} GROUP BY ALL)"""


def sql_match(pred: str, gt: str, threshold: float, keys: str = "image_id, class_id") -> str:
    """CTE body: (det_id, gt_id) of the greedy matching in score order to the best truth still free."""
    on = " AND ".join(f"p.{k.strip()} = g.{k.strip()}" for k in keys.split(","))
    return f"""SELECT unnest(list_transform(list_filter(m, lambda q: q.g IS NOT NULL), lambda q: q.d)) AS det_id, unnest(list_transform(list_filter(m, lambda q: q.g IS NOT NULL), lambda q: q.g)) AS gt_id
 FROM (SELECT {keys}, list_reduce(list_prepend([{{'d': -1::BIGINT, 'c': [-1::BIGINT], 'g': NULL::BIGINT}}], list_transform(b, lambda x: [x])), lambda acc, x: list_concat(acc, [{{'d': x[1].d, 'c': x[1].c, 'g': list_filter(x[1].c, lambda c: NOT list_contains(list_transform(acc, lambda a: coalesce(a.g, -1)), c))[1]}}])) AS m
  FROM (SELECT {keys}, list({{'d': det_id, 'c': c, 'g': NULL::BIGINT}} ORDER BY score DESC, det_id) AS b
   FROM (SELECT {', '.join('p.' + k.strip() for k in keys.split(','))}, p.det_id, any_value(p.score) AS score, list(g.gt_id ORDER BY {sql_iou('p.', 'g.')} DESC, g.gt_id) AS c
    FROM {pred} p JOIN {gt} g ON {on} WHERE {sql_iou('p.', 'g.')} >= {threshold}::DOUBLE GROUP BY ALL) GROUP BY ALL))"""
