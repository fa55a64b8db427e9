r"""Line dedup: lines spread over many sites are boilerplate.

A line is the trimmed text between newlines; lines without a visible character never count. For each line
hash a HyperLogLog sketch of its sites merges by aggregation. Lines whose estimate is clearly below or above
`min_sites` are settled by it; those near the threshold get exact distinct counts. Of a line that reaches
`min_sites` distinct sites one occurrence stays, in the row of the smallest (id, key), so that no text leaves
the corpus altogether; all others go.

All occurrences of a line stand under its hash; they meet the few lines that go in a broadcast (beyond `BROADCAST_KEYS` of
those in a shuffle), so a line of every document is no task of its own.

A null site counts as one site of its own. Null texts stay null, empty ones empty; texts of any length and number of lines are whole. Null
ids sort first. Rows equal in id and text share a result. Empty tables give empty results. Other columns, whatever their names, are returned
untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybox.llm.common import few, packed, row_key

#: An estimate within this factor of the threshold is counted exactly (the sketch's error is far smaller).
NEAR = 1.5


def _line_rows(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("_id"), *row_key(id_col, text_col), F.coalesce(F.col(site_col).cast("string"), F.lit("\0")).alias("_site"),
                       F.posexplode(F.split(text_col, "\n")).alias("_pos", "_raw"))
    rows = rows.withColumn("_line", F.regexp_replace("_raw", r"^\s+|\s+$", "")).filter("_line <> ''")
    return rows.withColumns({"_h1": F.xxhash64("_line"), "_h2": F.hash("_line")})


def boilerplate_lines(rows: DataFrame, min_sites: int) -> DataFrame:
    """Line hashes spread over at least `min_sites` sites, with the place of the occurrence that stays."""
    by_site = rows.groupBy("_h1", "_h2", "_site").agg(F.min(F.struct("_id", "_k1", "_k2", "_pos")).alias("_first"))
    spread = (by_site.groupBy("_h1", "_h2").agg(F.hll_sketch_agg(F.xxhash64("_site"), 10).alias("_sketch"), F.min("_first").alias("_first"))
              .select("_h1", "_h2", "_first", F.hll_sketch_estimate("_sketch").alias("_est")))
    sure = spread.filter(F.col("_est") > NEAR * min_sites).select("_h1", "_h2", "_first")
    near = spread.filter((F.col("_est") <= NEAR * min_sites) & (F.col("_est") >= min_sites / NEAR)).select("_h1", "_h2")
    exact = (by_site.join(near, ["_h1", "_h2"]).groupBy("_h1", "_h2")
             .agg(F.countDistinct("_site").alias("_n"), F.min("_first").alias("_first"))
             .filter(F.col("_n") >= min_sites).select("_h1", "_h2", "_first"))
    return sure.union(exact)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                min_sites: int = 10, counts: bool = True) -> DataFrame:
    """All rows and columns of `docs`, the text without its cross-site lines, and (if `counts`) n_lines and n_removed, which
    replace columns of these names."""
    rows = _line_rows(docs, id_col, text_col, site_col)
    boiler = few(boilerplate_lines(rows, min_sites))
    stays = (F.col("_first._k1") == F.col("_k1")) & (F.col("_first._k2") == F.col("_k2")) & (F.col("_first._pos") == F.col("_pos"))
    gone = (rows.select("_h1", "_h2", "_k1", "_k2", "_pos").join(boiler, ["_h1", "_h2"]).filter(~stays)
            .groupBy("_k1", "_k2").agg(F.collect_set("_pos").alias("_gone")))
    keyed = packed(docs, *row_key(id_col, text_col)).join(gone, ["_k1", "_k2"], "left")
    whole = F.col(f"_row.`{text_col}`")
    lines = F.split(whole, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_gone")
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col("_gone").isNull(), whole).otherwise(kept).alias(text_col)
    added = [F.when(whole.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
             F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed")] if counts else []
    names = [c for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    return keyed.select(*[text if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in names], *added)
