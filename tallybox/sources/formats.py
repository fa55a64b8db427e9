"""Readers and writers of the formats that detection tables come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybox.sources.arrays import read_json_array

_BOX = T.ArrayType(T.DoubleType())
CANDIDATE = T.StructType([T.StructField("bbox", _BOX), T.StructField("score", T.DoubleType()), T.StructField("class_id", T.IntegerType()), T.StructField("touches_internal_edge", T.BooleanType()), T.StructField("is_global", T.BooleanType()), T.StructField("det_id", T.LongType())])
RECORD = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("image_size", T.ArrayType(T.IntegerType())), T.StructField("candidates", T.ArrayType(CANDIDATE))])
HEADER = T.StructType([T.StructField("type", T.StringType()), T.StructField("schema", T.IntegerType()), T.StructField("weights_sha256", T.StringType()), T.StructField("classes", T.ArrayType(T.StringType())), T.StructField("source", T.StringType()), T.StructField("options", T.MapType(T.StringType(), T.StringType()))])
LINE = T.StructType([*HEADER.fields, *RECORD.fields])
PREDICTION = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("category_name", T.StringType()), T.StructField("bbox", T.ArrayType(T.IntegerType())), T.StructField("score", T.DoubleType())])
_BND = T.StructType([T.StructField(c, T.DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax")])
VOC = T.StructType([T.StructField("filename", T.StringType()), T.StructField("size", T.StructType([T.StructField(c, T.IntegerType()) for c in ("width", "height", "depth")])),
                    T.StructField("object", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("bndbox", _BND)])))])


def read_voc(spark: SparkSession, path: str, classes: list[str], strict: bool = False) -> DataFrame:
    """(filename, width, height, class_name, x1 .. y2): boxes clipped to the image. Unknown classes, and missing or empty boxes,
    are dropped, or fail the job if strict."""
    d = spark.read.format("xml").option("rowTag", "annotation").schema(VOC).load(path)
    d = d.select("filename", "size.width", "size.height", F.explode_outer("object").alias("o"))
    on = lambda c, top: F.least(F.greatest(F.col(f"o.bndbox.{c}"), F.lit(0.0)), F.col(top).cast("double"))
    d = d.select("filename", "width", "height", F.trim("o.name").alias("class_name"), on("xmin", "width").alias("x1"), on("ymin", "height").alias("y1"), on("xmax", "width").alias("x2"), on("ymax", "height").alias("y2"))
    good = F.col("class_name").isin(classes) & F.coalesce((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.lit(False))
    if strict:
        return d.filter(F.when(good | F.col("class_name").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("bad object in "), F.coalesce("filename", F.lit("?"))))))
    return d.filter(good)


def write_voc(boxes: DataFrame, path: str, files: int = 8) -> None:
    """Annotation elements from (filename, width, height, objects array<struct<name, x1, y1, x2, y2>>), under one root in each of
    `files` files: choose it so that a file's annotations fit in memory."""
    obj = F.transform("objects", lambda o: F.format_string("<object><name>%s</name><bndbox><xmin>%s</xmin><ymin>%s</ymin><xmax>%s</xmax><ymax>%s</ymax></bndbox></object>", o["name"], o["x1"], o["y1"], o["x2"], o["y2"]))
    line = F.concat(F.format_string("<annotation><filename>%s</filename><size><width>%d</width><height>%d</height><depth>1</depth></size>", F.col("filename"), F.col("width"), F.col("height")), F.array_join(obj, ""), F.lit("</annotation>"))
    d = boxes.select(F.pmod(F.xxhash64("filename"), F.lit(files)).alias("file"), line.alias("line")).groupBy("file").agg(F.array_join(F.collect_list("line"), "\n").alias("all"))
    d.select("file", F.concat(F.lit("<annotations>"), "all", F.lit("</annotations>")).alias("value")).write.mode("errorifexists").partitionBy("file").text(path)


def pair_sides(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(stem, problem) of images without a label file and label files without an image; paths match by folder and lower-cased stem."""
    stem = lambda c: F.lower(F.regexp_replace(F.col(c), r"\.[^./]*$", ""))
    j = images.select(stem("path").alias("stem"), F.lit(1).alias("i")).join(labels.select(stem("path").alias("stem"), F.lit(1).alias("l")), "stem", "full_outer")
    return j.filter("i is null or l is null").select("stem", F.when(F.col("l").isNull(), "no_label").otherwise("no_image").alias("problem"))


def natural_classes(names: DataFrame, column: str) -> DataFrame:
    """(position, name): distinct names in digit-aware order."""
    from pyspark.sql import Window

    key = F.array_join(F.transform(F.regexp_extract_all(F.lower("name"), F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 12, "0")).otherwise(p)), "")
    d = names.select(F.col(column).alias("name")).distinct()
    return d.select(F.row_number().over(Window.orderBy(key, "name")).alias("position"), "name")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each image of a JSON-lines cache; the header line is skipped."""
    return spark.read.schema(LINE).option("mode", "FAILFAST").json(path).filter("type is null and image_id is not null").select("image_id", "image_size", "candidates")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return flat_candidates(read_records(spark, path))


def flat_candidates(records: DataFrame) -> DataFrame:
    d = records.select("image_id", F.explode("candidates").alias("c"))
    return d.select("image_id", "c.det_id", "c.class_id", *[F.get("c.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))], "c.score", "c.is_global", F.col("c.touches_internal_edge").alias("touches_edge"))


_LEGACY = f"struct<signature:map<string,string>,images:map<string,struct<image_size:array<int>,candidates:array<{CANDIDATE.simpleString()}>>>>"


def _legacy(spark: SparkSession, path: str, signature: dict[str, str] | None) -> DataFrame:
    """(file, j, problem) of one-object caches {signature, images: {id: record}}: no images, ids out of order, or, if one is expected, another signature."""
    d = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", _LEGACY).alias("j"))
    ids = F.map_keys("j.images")
    falls = F.exists(F.zip_with(F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))), F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))), lambda a, b: b < a), lambda x: x)
    other = F.lit(False)
    for k, value in (signature or {}).items():
        other = other | ~F.element_at("j.signature", k).eqNullSafe(F.lit(str(value)))
    return d.withColumn("problem", F.when(F.col("j.images").isNull(), "no_images").when(falls, "not_sorted").when(other, "signature"))


def legacy_problems(spark: SparkSession, path: str, signature: dict[str, str] | None = None) -> DataFrame:
    """(file, problem, images) of one-object caches; a good one has no problem."""
    return _legacy(spark, path, signature).select("file", "problem", F.coalesce(F.cardinality("j.images"), F.lit(0)).alias("images"))


def read_legacy_cache(spark: SparkSession, path: str, signature: dict[str, str] | None = None, strict: bool = True) -> DataFrame:
    """Records of one-object caches. A cache with a problem (see `legacy_problems`) fails the job, or is left out if not strict."""
    d = _legacy(spark, path, signature)
    fail = F.raise_error(F.concat(F.lit("cache "), "file", F.lit(": "), "problem")).cast("boolean") if strict else F.lit(False)
    d = d.filter(F.when(F.col("problem").isNull(), F.lit(True)).otherwise(fail))
    return d.select(F.explode("j.images").alias("image_id", "r")).select("image_id", "r.image_size", "r.candidates")


def read_header(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINE).json(path).filter("type = 'candidate_cache_header'").select("type", "schema", "weights_sha256", "classes", "source", "options")


def header_problems(header: DataFrame, expected: dict[str, object], options: dict[str, object]) -> DataFrame:
    """(source, field, expected, actual): fields and inference options in which a header differs from what a run expects; values compare as JSON texts, numbers as numbers."""
    def differs(actual: Column, value) -> Column:
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            want = F.lit(str(value).lower() if isinstance(value, bool) else str(value))
            return ~actual.eqNullSafe(want)
        return ~F.coalesce(actual.try_cast("double") == F.lit(float(value)), F.lit(False))

    tests = []
    for name, value in expected.items():
        actual = F.to_json(name) if isinstance(value, list) else F.col(name).cast("string")
        value = F.lit("[" + ",".join(f'"{x}"' for x in value) + "]") if isinstance(value, list) else value
        bad = ~actual.eqNullSafe(value) if isinstance(value, Column) else differs(actual, value)
        tests.append((F.lit(name), value if isinstance(value, Column) else F.lit(str(value)), actual, bad))
    for name, value in options.items():
        actual = F.try_element_at("options", F.lit(name))
        tests.append((F.lit(f"options.{name}"), F.lit(str(value).lower() if isinstance(value, bool) else str(value)), actual, differs(actual, value)))
    rows = F.array(*[F.when(bad, F.struct(n.alias("field"), e.alias("expected"), a.alias("actual"))) for n, e, a, bad in tests])
    return header.select("source", F.explode(F.array_compact(rows)).alias("p")).select("source", "p.*")


def read_predictions(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Predictions in files whose lines are objects or arrays of objects; `whole_files`: one array, over any lines, in each file,
    read by as many tasks as its size asks for."""
    if whole_files:
        return read_json_array(spark, path, PREDICTION.simpleString())
    line = F.trim("value")
    rows = F.from_json(F.when(line.startswith("["), line).otherwise(F.concat(F.lit("["), line, F.lit("]"))), f"array<{PREDICTION.simpleString()}>", {"mode": "FAILFAST"})
    return spark.read.text(path).filter(line != "").select(F.explode(rows).alias("p")).select("p.*")


def write_predictions(df: DataFrame, path: str) -> DataFrame:
    """Writes prediction rows as JSON lines, never over an existing result; returns the counts by class."""
    df.write.mode("errorifexists").json(path)
    return df.groupBy("category_name").agg(F.count("*").alias("n"))


def read_yolo(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """(stem, class_id, x1 .. y2) from text files of lines `class cx cy w h`, in pixels."""
    d = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1).alias("stem"), F.split(F.trim("value"), r"\s+").alias("p")).filter(F.size("p") == 5)
    n = [F.get("p", F.lit(i)).cast("double") for i in range(1, 5)]
    return d.select("stem", F.get("p", F.lit(0)).cast("int").alias("class_id"), ((n[0] - n[2] / 2) * width).alias("x1"), ((n[1] - n[3] / 2) * height).alias("y1"), ((n[0] + n[2] / 2) * width).alias("x2"), ((n[1] + n[3] / 2) * height).alias("y2"))


def yolo_line(class_id: Column, yolo: Column) -> Column:
    return F.format_string("%d %.9f %.9f %.9f %.9f", class_id, yolo["cx"], yolo["cy"], yolo["w"], yolo["h"])


_SAMPLE = "visible:string,infrared:string,depth:string,query:string,bbox:array<double>"
#: Fields that a sample must have.
REQUIRED = ("visible", "infrared", "depth", "query")


def read_grounding(spark: SparkSession, path: str, whole_files: bool = True, require_bbox: bool = False) -> DataFrame:
    """(sample_id, fields, problem) of JSON objects keyed by sample, or of lists of records (named by `id`, else `query_id`, else their place), one in a file, or in a line if not
    `whole_files`. problem: the first required field that is missing; `bbox` if it is not a box in shares of the image, or missing though required."""
    d = spark.read.option("wholetext", whole_files).text(path).filter(F.trim("value") != "")
    listed = F.ltrim("value").startswith("[")
    keyed = d.filter(~listed).select(F.explode(F.from_json("value", f"map<string,struct<{_SAMPLE}>>")).alias("sample_id", "s")).select("sample_id", "s.*")
    rows = d.filter(listed).select(F.posexplode(F.from_json("value", f"array<struct<id:string,query_id:string,{_SAMPLE}>>")).alias("i", "s"))
    rows = rows.select(F.coalesce(F.nullif("s.id", F.lit("")), F.nullif("s.query_id", F.lit("")), F.col("i").cast("string")).alias("sample_id"), *[f"s.{f.split(':')[0]}" for f in _SAMPLE.split(",")])
    at = lambda i: F.get("bbox", F.lit(i))
    shares = (at(0) >= 0) & (at(0) < at(2)) & (at(2) <= 1) & (at(1) >= 0) & (at(1) < at(3)) & (at(3) <= 1)
    odd = (F.size("bbox") != 4) | ~F.coalesce(shares, F.lit(False)) | F.exists("bbox", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    problem = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED], F.when(F.col("bbox").isNotNull() & odd, "bbox"), F.when(F.lit(require_bbox) & F.col("bbox").isNull(), "bbox"))
    return keyed.union(rows).withColumn("problem", problem)


MANIFEST = "struct<splits:map<string,array<string>>,groups:map<string,array<string>>,roles:map<string,string>,records:map<string,struct<sha256:string,xml_sha256:string,dhash:string,thumbnail:string,group:string>>>"


def read_manifest(spark: SparkSession, path: str, whole_files: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(split members, split groups, split roles, records by path) of a JSON manifest in one file; or of its parts, one in a line, if not `whole_files`."""
    m = spark.read.option("wholetext", whole_files).text(path).select(F.from_json("value", MANIFEST).alias("m"))
    members = m.select(F.explode("m.splits").alias("split", "p")).select("split", F.explode("p").alias("path"))
    groups = m.select(F.explode("m.groups").alias("split", "g")).select("split", F.explode("g").alias("grp")).distinct()
    records = m.select(F.explode("m.records").alias("path", "r")).select("path", F.col("r.sha256").alias("sha"), F.col("r.xml_sha256").alias("xml_sha"), "r.dhash", F.col("r.group").alias("grp"))
    return members, groups, m.select(F.explode("m.roles").alias("split", "role")).distinct(), records


def frozen_members(members: DataFrame, groups: DataFrame, records: DataFrame, now: DataFrame) -> DataFrame:
    """(split, path, grp, problem) of all members: `missing` (not in `now`: path, sha, xml_sha), `no_record`, `group` (the record's is not among the split's), `changed` (either hash), or none."""
    r = records.select("path", "grp", F.col("sha").alias("_s"), F.col("xml_sha").alias("_x"), F.lit(True).alias("_r"))
    n = now.select("path", F.col("sha").alias("_ns"), F.col("xml_sha").alias("_nx"), F.lit(True).alias("_n"))
    d = members.join(r, "path", "left").join(n, "path", "left").join(groups.withColumn("_g", F.lit(True)), ["split", "grp"], "left")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_r").isNull(), "no_record").when(F.col("_g").isNull(), "group").when(~F.col("_s").eqNullSafe(F.col("_ns")) | ~F.col("_x").eqNullSafe(F.col("_nx")), "changed")
    return d.select("split", "path", "grp", problem.alias("problem"))


def file_manifest(spark: SparkSession, path: str, suffix: str, least_bytes: int = 0) -> DataFrame:
    """(folder, name, bytes, sha256) of the files under a folder."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
    return d.filter(F.col("length") >= least_bytes).select(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def label_repairs(files: DataFrame, objects: DataFrame, classes: list[str], aliases: dict[str, str]) -> DataFrame:
    """(kind, name, n): what label files need before they are used.

    files: image_name, width, height, mode of the image; filename, has_size, declared_width, declared_height, declared_depth (texts, null where missing) of its label. objects: image_name, name, xmin .. ymax (texts).
    `fatal`: files that can't be used, each under the first reason: mode, unknown_class, no_box, not_finite, degenerate. Of all other files: `repair`, how often each was needed: filename_inserted, filename_normalized (same stem, whatever its case and folder),
    filename_stem_corrected, size_inserted, width_, height_ and depth_ inserted or corrected, class_normalized, box_clipped; and `class`: objects by class."""
    from tallybox.functions.columns import canonical_class

    sides = ("xmin", "ymin", "xmax", "ymax")
    stem = lambda c: F.lower(F.regexp_replace(F.regexp_replace(F.replace(F.trim(c), F.lit("\\"), F.lit("/")), "^.*/", ""), r"(?<=.)[.][^.]*$", ""))
    o = objects.select("image_name", F.trim(F.coalesce("name", F.lit(""))).alias("raw"), *sides, *[F.col(c).try_cast("double").alias("_" + c) for c in sides]).withColumn("cls", canonical_class(F.col("raw"), aliases))
    o = o.join(files.select("image_name", F.col("width").cast("double").alias("_w"), F.col("height").cast("double").alias("_h")), "image_name")
    on = {c: F.least(F.greatest(F.col("_" + c), F.lit(0.0)), F.col("_w" if c[0] == "x" else "_h")) for c in sides}
    none = F.lit(False)
    missing, odd, clipped = none, none, none
    for c in sides:
        v = F.col("_" + c)
        missing, odd, clipped = missing | F.col(c).isNull(), odd | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), clipped | (on[c] != v)
    bad = F.when(~F.col("cls").isin(classes), 2).when(missing, 3).when(odd, 4).when((on["xmax"] <= on["xmin"]) | (on["ymax"] <= on["ymin"]), 5)
    o = o.select("image_name", "cls", bad.alias("bad"), (F.col("cls") != F.col("raw")).alias("class_normalized"), clipped.alias("box_clipped"))
    worst = o.groupBy("image_name").agg(F.min("bad").alias("bad"))
    f = files.join(worst, "image_name", "left").withColumn("fatal", F.when(F.col("mode") != "L", "mode").otherwise(F.get(F.array(*[F.lit(x) for x in ("mode", "unknown_class", "no_box", "not_finite", "degenerate")]), F.col("bad") - 1)))
    name = F.trim("filename")
    named = F.when(F.col("filename").isNull(), "filename_inserted").when(name == F.col("image_name"), F.lit(None)).when(stem(F.col("filename")) == stem(F.col("image_name")), "filename_normalized").otherwise("filename_stem_corrected")
    field = lambda n, value: F.when(F.col(f"declared_{n}").isNull(), f"{n}_inserted").when(~F.coalesce(F.col(f"declared_{n}").try_cast("double").cast("long") == value, none), f"{n}_corrected")
    needs = F.array_compact(F.array(named, F.when(~F.col("has_size"), "size_inserted"), field("width", F.col("width")), field("height", F.col("height")), field("depth", F.lit(1))))
    fine = f.filter("fatal is null")
    usable = o.join(fine.select("image_name"), "image_name", "left_semi")
    both = F.array_compact(F.array(F.when(F.col("class_normalized"), "class_normalized"), F.when(F.col("box_clipped"), "box_clipped")))
    count = lambda d, kind: d.groupBy("name").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    repairs = fine.select(F.explode(needs).alias("name")).union(usable.select(F.explode(both)))
    return count(f.filter("fatal is not null").select(F.col("fatal").alias("name")), "fatal").union(count(repairs, "repair")).union(count(usable.select(F.col("cls").alias("name")), "class"))


def rewrite_labels(rows: DataFrame, names: dict[str, str], drop: list[str], stem: str, order: str) -> DataFrame:
    """Labels renamed by a table, dropped classes left out, of equal stems the first kept."""
    from pyspark.sql import Window

    table = F.create_map(*[F.lit(v) for p in names.items() for v in p])
    d = rows.filter(~F.col("class_name").isin(drop)).withColumn("class_name", F.coalesce(table[F.col("class_name")], F.col("class_name")))
    return d.withColumn("_k", F.row_number().over(Window.partitionBy(stem).orderBy(order))).filter("_k = 1").drop("_k")


def write_tile_metadata(tiles: DataFrame, path: str) -> DataFrame:
    """Writes tile metadata as JSON lines; returns the summary by split."""
    tiles.write.mode("errorifexists").json(path)
    return tiles.groupBy("split").agg(F.count("*").alias("tiles"), F.sum("objects").cast("bigint").alias("objects"), F.count_if(F.col("objects") == 0).alias("empty"))
