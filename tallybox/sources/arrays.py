r"""One JSON array of objects in each file, read by many tasks.

The text source cuts a file by bytes and lines at closing braces, so a piece is what stands between two of them, whole even where a cut runs through it. In most files every piece is an
element: one opening brace, no open string. Those are parsed where they are read, without a shuffle. In the others braces stand within strings or objects within objects; there
the state at the beginning of each piece (inside a string or not, how many braces are open, how many elements came before) is a running sum over the file's pieces: sums of cuts
first, then within each cut, so that no task holds a file. Pieces of one element are then joined.

A file that is not an array, is cut short, or lacks a comma is an error that names it. An empty file gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybox.session import cut

#: Files with nested objects of which the names are broadcast; with more of them all files are read as such.
NAMES = 100_000

_HEAD, _NEXT, _TAIL, _EMPTY = r"^\s*\[\s*\{", r"^\s*,\s*\{", r"^\s*\]\s*$", r"^\s*\[\s*\]\s*$"


def _kind(text: Column) -> Column:
    return F.when(text.rlike(_NEXT), "next").when(text.rlike(_HEAD), "head").when(text.rlike(_TAIL), "tail").when(text.rlike(_EMPTY), "empty").otherwise("odd")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.option("lineSep", "}").text(path)
    return d.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def _plain(text: Column) -> Column:
    """Without escapes."""
    return F.regexp_replace(text, r"(?s)\\.", "")


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _opened(plain: Column) -> Column:
    """Opening braces outside of strings."""
    return _count(F.regexp_replace(plain, r'"[^"]*("|$)', ""), "{")


def _before(df: DataFrame, value: str, name: str) -> DataFrame:
    """`name`: the sum of `value` over the file's pieces before this one."""
    within = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    cuts = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("file", "block").agg(F.sum(value).alias("_s")).select("file", "block", F.coalesce(F.sum("_s").over(cuts), F.lit(0)).alias("_s"))
    return df.join(sums, ["file", "block"]).withColumn(name, F.col("_s") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_s")


def _nested(pieces: DataFrame) -> DataFrame:
    """(file, element, text) of files whose pieces are not elements; the closing bracket is an element of its own."""
    d = cut(pieces.withColumn("plain", _plain(F.col("value"))).withColumn("quotes", _count(F.col("plain"), '"')))
    last = d.groupBy("file").agg(F.max(F.struct("block", "at")).alias("last"))
    d = _before(d, "quotes", "q").join(last, "file").withColumn("end", (F.col("last.block") == F.col("block")) & (F.col("last.at") == F.col("at")))
    inside = F.col("q") % 2 == 1
    opened = _opened(F.when(inside, F.concat(F.lit('"'), "plain")).otherwise(F.col("plain")))
    closes = ((F.col("q") + F.col("quotes")) % 2 == 0) & ~F.col("end")
    d = cut(d.select("file", "block", "at", "value", "end", opened.alias("opened"), closes.cast("int").alias("closes")).withColumn("change", F.col("opened") - F.col("closes")))
    d = _before(d, "change", "depth")
    d = cut(d.withColumn("ends", ((F.col("closes") == 1) & (F.col("depth") + F.col("change") == 0)).cast("int")))
    d = _before(d, "ends", "element")
    parts = F.sort_array(F.collect_list(F.struct("block", "at", "value")))
    return d.groupBy("file", "element").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "}").alias("text"), F.max("end").alias("end"), F.max("ends").alias("whole"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of files that hold one JSON array each, as rows of `schema` (a struct)."""
    pieces = _pieces(spark, path)
    kind = _kind(F.col("value"))
    plain = _plain(F.col("value"))
    one = (_count(plain, '"') % 2 == 0) & (_opened(plain) == 1)
    place = F.struct("block", "at")
    seen = pieces.withColumns({"kind": kind, "one": one}).groupBy("file").agg(
        F.bool_or(~F.col("kind").isin("tail", "empty") & ~(F.col("one") & F.col("kind").isin("head", "next"))).alias("nested"),
        F.min_by("kind", place).alias("first"), F.max_by("kind", place).alias("last"), F.count_if(F.col("kind").isin("head", "empty")).alias("heads"), F.count_if(F.col("kind").isin("tail", "empty")).alias("tails"))
    seen = cut(seen)
    fine = F.col("first").isin("head", "empty") & F.col("last").isin("tail", "empty") & (F.col("heads") == 1) & (F.col("tails") == 1)
    _refuse(seen.filter(~F.col("nested") & ~fine))
    nested = seen.filter("nested").select("file")
    n = nested.limit(NAMES + 1).count()
    parse = lambda text: F.from_json(F.regexp_replace(text, r"^[\s,\[]+", ""), schema, {"mode": "FAILFAST"}).alias("r")
    body = pieces.filter(kind.isin("head", "next"))
    rows = body.join(F.broadcast(nested), "file", "left_anti") if n else body
    out = rows.select(parse(F.concat("value", F.lit("}"))))
    if n > NAMES:
        nested, out = seen.select("file"), out.limit(0)
    if n:
        elements = cut(_nested(pieces.join(F.broadcast(nested) if n <= NAMES else nested, "file", "left_semi")))
        kind = _kind(F.col("text"))
        good = F.when(F.col("end"), kind.isin("tail", "empty")).otherwise((F.col("whole") == 1) & F.when(F.col("element") == 0, kind == "head").otherwise(kind == "next"))
        _refuse(elements.groupBy("file").agg(F.bool_and(good & (~F.col("end") | (F.col("element") > 0) | (kind == "empty"))).alias("good")).filter("not good"))
        out = out.union(elements.filter("not end").select(parse(F.concat("text", F.lit("}")))))
    return out.select("r.*")


def _refuse(bad: DataFrame) -> None:
    row = bad.select("file").first()
    if row is not None:
        raise ValueError(f"not one whole JSON array of objects: {row['file']}")
