"""Files that Spark writes from the given tables, read back by the sources, and streams over them."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from tallybox.functions.columns import BOX, to_yolo
from tallybox.operators import govern
from tallybox.plans.registry import query, sql_nms
from tallybox.session import freed, remove, shared_folder
from tallybox.sources import formats as S
from tallybox.streaming import caches as R


def scratch(v) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(v.spark)}/files-{uuid4().hex}"


def records(df):
    """One nested record for each image of a box table."""
    c = F.struct(F.array(*BOX).alias("bbox"), "score", "class_id", F.col("touches_edge").alias("touches_internal_edge"), "is_global", "det_id")
    d = df.groupBy("image_id").agg(F.sort_array(F.collect_list(c)).alias("candidates"))
    return d.select(F.col("image_id").cast("string").alias("image_id"), F.array(F.lit(4096), F.lit(3000)).alias("image_size"), "candidates")


def cache_lines(v, df):
    head = v.spark.range(1).select(F.to_json(F.struct(F.lit("candidate_cache_header").alias("type"), F.lit(3).alias("schema"), F.lit("ab12").alias("weights_sha256"), F.array(F.lit("c0"), F.lit("c1")).alias("classes"))).alias("value"))
    return head.union(records(df).select(F.to_json(F.struct("image_id", "image_size", "candidates")).alias("value")))


@query("s1_read_voc", "SELECT concat('im', image_id) AS filename, concat('c', class_id) AS class_name, count(*) AS n, sum(x2-x1) AS width FROM gt WHERE class_id < 6 GROUP BY ALL")
def s1(v):
    path = scratch(v)
    d = v.gt.groupBy("image_id").agg(F.collect_list(F.struct(F.concat(F.lit("c"), F.col("class_id").cast("string")).alias("name"), *BOX)).alias("objects"))
    d = d.select(F.concat(F.lit("im"), F.col("image_id").cast("string")).alias("filename"), F.lit(4096).alias("width"), F.lit(3000).alias("height"), "objects")
    S.write_voc(d, path, files=-(-d.count() // 500) or 1)  # some hundred annotations in a file, however many files
    out = S.read_voc(v.spark, path, [f"c{i}" for i in range(6)])
    return out.groupBy("filename", "class_name").agg(F.count("*").alias("n"), F.sum(F.col("x2") - F.col("x1")).alias("width"))


@query("s2_pair_audit", "SELECT concat('a/im', image_id) AS stem, CASE WHEN image_id % 10 = 0 THEN 'no_label' ELSE 'no_image' END AS problem FROM images WHERE image_id % 10 = 0 OR image_id % 14 = 0 AND image_id % 10 <> 0")
def s2(v):
    name = lambda suffix: F.concat(F.lit("a/IM"), F.col("image_id").cast("string"), F.lit(suffix))
    i = v.images.filter("not (image_id % 14 = 0 and image_id % 10 <> 0)").select(name(".png").alias("path"))
    return S.pair_sides(i, v.images.filter("image_id % 10 <> 0").select(name(".xml").alias("path")))


@query("s3_discover_classes", "WITH d AS (SELECT DISTINCT source AS name FROM documents), n AS (SELECT name, regexp_extract(name, '^(\\D*)', 1) AS a, CAST(regexp_extract(name, '(\\d+)$', 1) AS INT) AS b FROM d) SELECT CAST(row_number() OVER (ORDER BY a, b) AS INT) AS position, name FROM n")
def s3(v):
    return S.natural_classes(v.documents, "source")


@query("s4_read_candidates", "SELECT det_id, CAST(image_id AS VARCHAR) AS image_id, class_id, x1, y1, x2, y2, score, is_global, touches_edge FROM det")
def s4(v):
    path = scratch(v)
    cache_lines(v, v.det).write.option("compression", "gzip").text(path)
    return S.read_candidates(v.spark, path)


@query("s5_read_legacy_cache", """WITH n AS (SELECT CAST(ceil(count(*)/40) AS BIGINT) AS k FROM images), i AS (SELECT image_id, image_id % k AS b, count(*) AS n FROM det, n GROUP BY ALL), f AS (SELECT b, count(*) AS images, sum(n)::BIGINT AS boxes FROM i GROUP BY 1)
SELECT problem, sum(images)::BIGINT AS images, sum(CASE WHEN problem = 'ok' THEN boxes ELSE 0 END)::BIGINT AS boxes FROM (SELECT *, CASE WHEN b % 3 = 1 AND images > 1 THEN 'not_sorted' WHEN b % 3 = 2 THEN 'signature' ELSE 'ok' END AS problem FROM f) GROUP BY 1""")
def s5(v):
    path = scratch(v)
    # the legacy form is one object in a file: some forty images in each, however many files; of three files one is out of order, and one comes from other settings
    bucket = F.pmod(F.col("image_id").cast("long"), F.lit(-(-v.images.count() // 40) or 1))
    rows = F.sort_array(F.collect_list(F.struct("image_id", F.struct("image_size", "candidates"))))
    one = records(v.det).groupBy(bucket.alias("bucket")).agg(rows.alias("r"))
    one = one.select("bucket", F.create_map(F.lit("conf"), F.when(F.col("bucket") % 3 == 2, "0.1").otherwise("0.05")).alias("signature"), F.map_from_entries(F.when(F.col("bucket") % 3 == 1, F.reverse("r")).otherwise(F.col("r"))).alias("images"))
    one.select("bucket", F.to_json(F.struct("signature", "images")).alias("value")).write.partitionBy("bucket").text(path)
    found = S.legacy_problems(v.spark, path, {"conf": "0.05"}).groupBy(F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.sum("images").cast("long").alias("images"))
    boxes = S.flat_candidates(S.read_legacy_cache(v.spark, path, {"conf": "0.05"}, strict=False)).agg(F.count("*").alias("_n"))
    return found.crossJoin(F.broadcast(boxes)).select("problem", "images", F.when(F.col("problem") == "ok", F.col("_n")).otherwise(0).alias("boxes"))  # one row


@query("s6_header_policy", """WITH h AS (SELECT concat('c', class_id) AS source, count(*) AS n, CAST(floor(min(score)*1000) AS BIGINT) AS conf, CAST(max(class_id) % 3 AS INT) AS k FROM det GROUP BY class_id),
p AS (SELECT source, unnest(['schema', 'classes', 'options.conf', 'options.max_det', 'options.tta']) AS field, unnest([CASE WHEN k = 1 THEN '2' END, CASE WHEN k = 2 THEN '["c1","c0"]' END, CASE WHEN conf <> 0 THEN CAST(conf AS VARCHAR) END, CASE WHEN n <> 7500 THEN CAST(n AS VARCHAR) END, CASE WHEN k = 0 THEN 'true' END]) AS actual FROM h)
SELECT source, field, actual FROM p WHERE actual IS NOT NULL""")
def s6(v):
    # a cache of each class, with what its run says of itself
    path = scratch(v)
    k = F.col("class_id") % 3
    h = v.det.groupBy("class_id").agg(F.count("*").alias("max_det"), F.floor(F.min("score") * 1000).alias("conf"))
    options = F.struct("conf", "max_det", (k == 0).alias("tta"))
    head = F.struct(F.lit("candidate_cache_header").alias("type"), F.when(k == 1, 2).otherwise(3).alias("schema"), F.lit("ab12").alias("weights_sha256"), F.when(k == 2, F.array(F.lit("c1"), F.lit("c0"))).otherwise(F.array(F.lit("c0"), F.lit("c1"))).alias("classes"), F.concat(F.lit("c"), F.col("class_id").cast("string")).alias("source"), options.alias("options"))
    h.select(F.to_json(head).alias("value")).union(records(v.det).select(F.to_json(F.struct("image_id", "image_size", "candidates")))).write.text(path)
    bad = S.header_problems(S.read_header(v.spark, path), {"schema": 3, "weights_sha256": "ab12", "classes": ["c0", "c1"]}, {"conf": 0, "max_det": 7500, "tta": False})
    return bad.select("source", "field", "actual")


def predictions(v):
    return v.det.select(F.col("image_id").cast("string").alias("image_id"), F.concat(F.lit("c"), F.col("class_id").cast("string")).alias("category_name"), F.transform(F.array(*BOX), lambda x: F.rint(x).cast("int")).alias("bbox"), "score", "class_id")


@query("s7_read_predictions", "SELECT CAST(image_id AS VARCHAR) AS image_id, count(*) AS n, round(sum(score), 3) AS score FROM det GROUP BY 1")
def s7(v):
    path = scratch(v)
    p = predictions(v)
    row = F.struct("image_id", "category_name", "bbox", "score")
    arrays = p.filter("class_id in (2, 3)").groupBy("image_id").agg(F.to_json(F.collect_list(row)).alias("value")).select("value")
    arrays.union(p.filter("class_id >= 4").select(F.to_json(row))).write.text(f"{path}/lines")
    # one array in a file, of some ten thousand rows
    bucket = F.pmod(F.xxhash64("image_id"), F.lit(-(-v.images.count() // 500) or 1)).alias("bucket")
    whole = p.filter("class_id < 2").groupBy(bucket).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(F.to_json(row)), ",\n"), F.lit("\n]")).alias("value"))
    whole.write.partitionBy("bucket").text(f"{path}/arrays")
    both = S.read_predictions(v.spark, f"{path}/lines").union(S.read_predictions(v.spark, f"{path}/arrays", whole_files=True))
    return both.groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("score"))


@query("s8_write_predictions", "SELECT concat('c', class_id) AS category_name, count(*) AS n FROM det GROUP BY 1")
def s8(v):
    path = scratch(v)
    S.write_predictions(predictions(v).drop("class_id"), path)
    return v.spark.read.schema(S.PREDICTION).json(path).groupBy("category_name").agg(F.count("*").alias("n"))


@query("s9_yolo_round_trip", "SELECT concat('part=', image_id % 4) AS stem, class_id, count(*) AS n, round(sum(x1), 0) AS x1, round(sum(y2), 0) AS y2 FROM gt GROUP BY ALL")
def s9(v):
    path = scratch(v)
    v.gt.select((F.col("image_id") % 4).alias("part"), S.yolo_line(F.col("class_id"), to_yolo("", 4096.0, 3000.0)).alias("value")).write.partitionBy("part").text(path)
    out = S.read_yolo(v.spark, path, 4096, 3000)
    return out.groupBy("stem", "class_id").agg(F.count("*").alias("n"), F.round(F.sum("x1"), 0).alias("x1"), F.round(F.sum("y2"), 0).alias("y2"))


@query("s10_read_grounding", "SELECT CASE WHEN turn % 7 = 6 THEN 'depth' WHEN turn % 5 = 4 THEN 'query' WHEN turn % 3 = 2 THEN 'bbox' ELSE 'ok' END AS problem, count(*) AS n, count(DISTINCT CASE WHEN conv_id % 2 = 0 THEN concat(conv_id, '/', turn) ELSE concat('q', conv_id, '/', turn) END) AS ids FROM conversations GROUP BY 1")
def s10(v):
    # objects by sample for even conversations, lists of records for odd ones
    path = scratch(v)
    box = F.when(F.col("turn") % 3 == 2, F.array(F.lit(0.1), F.lit(0.2))).otherwise(F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3), F.lit(0.4)))
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    fields = [F.lit("v.png").alias("visible"), F.lit("i.png").alias("infrared"), F.when(F.col("turn") % 7 != 6, "d.png").alias("depth"), F.when(F.col("turn") % 5 != 4, F.col("role")).alias("query"), box.alias("bbox")]
    keyed = v.conversations.filter("conv_id % 2 = 0").groupBy("conv_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, F.struct(*fields))))).alias("value"))
    listed = v.conversations.filter("conv_id % 2 = 1").groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct(F.concat(F.lit("q"), key).alias("query_id"), *fields))).alias("value"))
    keyed.select("value").union(listed.select("value")).write.text(path)
    return S.read_grounding(v.spark, path, whole_files=False, require_bbox=True).groupBy(F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("ids"))


@query("s11_read_manifest", """WITH m AS (SELECT view AS split, grp, image_id, CASE WHEN image_id % 23 = 0 THEN 'missing' WHEN image_id % 31 = 3 THEN 'group' WHEN image_id % 19 = 5 OR image_id % 29 = 7 THEN 'changed' END AS problem FROM images)
SELECT split, count(*) AS n, count(DISTINCT grp) AS groups, 'eval' AS role, count(*) FILTER (problem = 'missing') AS missing, count(*) FILTER (problem = 'group') AS other_group, count(*) FILTER (problem = 'changed') AS changed FROM m GROUP BY 1""")
def s11(v):
    path, i = scratch(v), F.col("image_id")
    name = F.concat(F.lit("im"), i.cast("string"))
    sha = lambda c: F.sha2(c.cast("string"), 256)
    # a part for each split and some hundred images, however many parts
    bucket = F.pmod(F.xxhash64("image_id"), F.lit(-(-v.images.count() // 300) or 1)).alias("bucket")
    record = F.struct(sha(i).alias("sha256"), sha(-i).alias("xml_sha256"), F.when(i % 31 == 3, "other").otherwise(F.col("grp")).alias("group"))
    m = v.images.groupBy("view", bucket).agg(F.collect_list(name).alias("p"), F.collect_set("grp").alias("g"), F.map_from_entries(F.collect_list(F.struct(name, record))).alias("records"))
    m.select(F.to_json(F.struct(F.create_map("view", "p").alias("splits"), F.create_map("view", "g").alias("groups"), F.create_map("view", F.lit("eval")).alias("roles"), "records")).alias("value")).write.text(path)
    members, groups, roles, found = S.read_manifest(v.spark, path, whole_files=False)
    now = v.images.filter("image_id % 23 <> 0").select(name.alias("path"), sha(F.when(i % 19 == 5, -7).otherwise(i)).alias("sha"), sha(F.when(i % 29 == 7, 9).otherwise(-i)).alias("xml_sha"))
    p = S.frozen_members(members, groups, found, now).groupBy("split").agg(F.count("*").alias("n"), *[F.count_if(F.col("problem") == k).alias(c) for k, c in (("missing", "missing"), ("group", "other_group"), ("changed", "changed"))])
    return p.join(groups.groupBy("split").agg(F.count("*").alias("groups")), "split").join(roles, "split")


@query("s12_file_manifest", "SELECT count(DISTINCT source) AS folders, sum(length(CAST(doc_id AS VARCHAR))+1)::BIGINT AS bytes FROM documents")
def s12(v):
    path = scratch(v)
    v.documents.select("doc_id", "source").write.partitionBy("source").csv(path)
    m = S.file_manifest(v.spark, path, ".csv")
    return m.agg(F.countDistinct("folder").alias("folders"), F.sum("bytes").alias("bytes"))


@query("s13_label_repairs", """WITH o AS (SELECT image_id, class_id, gt_id, CASE WHEN gt_id % 401 = 7 THEN NULL ELSE x1-50 END AS x1, y1, CASE WHEN gt_id % 397 = 5 THEN x1-60 ELSE x2 END AS x2, y2, gt_id % 409 = 3 AS nan, gt_id % 419 = 2 AS unknown FROM gt),
b AS (SELECT *, CASE WHEN unknown THEN 2 WHEN x1 IS NULL THEN 3 WHEN nan THEN 4 WHEN x2 <= greatest(x1, 0) THEN 5 END AS bad FROM o), w AS (SELECT image_id, min(bad) AS bad FROM b GROUP BY 1),
f AS (SELECT i.image_id, CASE WHEN i.image_id % 41 = 6 THEN 'mode' ELSE (['mode', 'unknown_class', 'no_box', 'not_finite', 'degenerate'])[bad] END AS fatal FROM images i LEFT JOIN w USING (image_id)),
r AS (SELECT unnest([CASE image_id % 4 WHEN 1 THEN 'filename_inserted' WHEN 2 THEN 'filename_normalized' WHEN 3 THEN 'filename_stem_corrected' END, CASE WHEN image_id % 13 = 0 THEN 'size_inserted' END, CASE WHEN image_id % 13 = 0 THEN 'width_inserted' WHEN image_id % 7 = 1 THEN 'width_corrected' END,
 CASE WHEN image_id % 13 = 0 THEN 'height_inserted' END, CASE WHEN image_id % 13 = 0 THEN 'depth_inserted' WHEN image_id % 5 = 2 THEN 'depth_corrected' END]) AS name FROM f WHERE fatal IS NULL
 UNION ALL SELECT unnest([CASE WHEN class_id = 3 THEN 'class_normalized' END, CASE WHEN x1 < 0 THEN 'box_clipped' END]) FROM b JOIN f USING (image_id) WHERE fatal IS NULL)
SELECT 'fatal' AS kind, fatal AS name, count(*) AS n FROM f WHERE fatal IS NOT NULL GROUP BY fatal UNION ALL SELECT 'repair', name, count(*) FROM r WHERE name IS NOT NULL GROUP BY name UNION ALL SELECT 'class', concat('c', class_id), count(*) FROM b JOIN f USING (image_id) WHERE fatal IS NULL GROUP BY class_id""")
def s13(v):
    i, g = F.col("image_id"), F.col("gt_id")
    name = F.concat(F.lit("im"), i.cast("string"), F.lit(".png"))
    said = F.when(i % 4 == 0, name).when(i % 4 == 2, F.concat(F.lit("D:\\set\\IM"), i.cast("string"), F.lit(".JPG"))).when(i % 4 == 3, "frame.png")
    whole = i % 13 != 0
    files = v.images.select(name.alias("image_name"), F.lit(4096).alias("width"), F.lit(3000).alias("height"), F.when(i % 41 == 6, "RGB").otherwise("L").alias("mode"), said.alias("filename"), whole.alias("has_size"),
                            F.when(whole, F.when(i % 7 == 1, "x1").otherwise("4096.0")).alias("declared_width"), F.when(whole, "3000").alias("declared_height"), F.when(whole, F.when(i % 5 == 2, "3").otherwise("1")).alias("declared_depth"))
    text = lambda c: c.cast("string")
    label = F.when(g % 419 == 2, "scratch").when(F.col("class_id") == 3, " C 3").otherwise(F.concat(F.lit("c"), text(F.col("class_id"))))
    objects = v.gt.select(name.alias("image_name"), label.alias("name"), F.when(g % 401 != 7, text(F.col("x1") - 50)).alias("xmin"), F.when(g % 409 == 3, "nan").otherwise(text(F.col("y1"))).alias("ymin"), text(F.when(g % 397 == 5, F.col("x1") - 60).otherwise(F.col("x2"))).alias("xmax"), text(F.col("y2")).alias("ymax"))
    return S.label_repairs(files, objects, [f"c{k}" for k in range(8)], {})


@query("s14_rewrite_labels", "WITH r AS (SELECT gt_id, image_id, CASE class_id WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE concat('c', class_id) END AS class_name FROM gt WHERE class_id NOT IN (4, 5)) SELECT gt_id, class_name FROM r QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY gt_id) = 1")
def s14(v):
    r = v.gt.select("gt_id", "image_id", F.concat(F.lit("c"), F.col("class_id").cast("string")).alias("class_name"))
    return S.rewrite_labels(r, {"c1": "one", "c2": "two"}, ["c4", "c5"], "image_id", "gt_id").select("gt_id", "class_name")


@query("s15_tile_metadata", "WITH t AS (SELECT i.view AS split, i.image_id, count(g.gt_id) AS objects FROM images i LEFT JOIN gt g USING (image_id) GROUP BY ALL) SELECT split, count(*) AS tiles, sum(objects)::BIGINT AS objects, count(*) FILTER (objects = 0) AS empty FROM t GROUP BY 1")
def s15(v):
    n = v.gt.groupBy("image_id").agg(F.count("*").alias("n"))
    t = v.images.join(n, "image_id", "left").select(F.col("view").alias("split"), "image_id", F.coalesce("n", F.lit(0)).alias("objects"))
    return S.write_tile_metadata(t, scratch(v))


@query("s16_grounding_sink", "SELECT CAST(gt_id AS VARCHAR) AS sample_id, round(x1/4096, 6) AS x1, round(y2/3000, 6) AS y2 FROM gt")
def s16(v):
    path = scratch(v)
    d = v.gt.select(F.col("gt_id").cast("string").alias("sample_id"), F.transform(F.array(F.col("x1") / 4096, F.col("y1") / 3000, F.col("x2") / 4096, F.col("y2") / 3000), lambda x: F.round(x, 6)).alias("bbox"))
    d.write.json(path)
    return v.spark.read.schema("sample_id string, bbox array<double>").json(path).select("sample_id", F.get("bbox", F.lit(0)).alias("x1"), F.get("bbox", F.lit(3)).alias("y2"))


# --- streams -----------------------------------------------------------------------------------

def cache_files(v) -> int:
    """Files of a cache: their number grows with the images, so that neither the task that writes one nor the one that reads it does."""
    return 4 + v.images.count() // 1_000


def at_once(files: int) -> int:
    """Files of a batch: half of them, and no more than 64."""
    return max(2, min(files // 2, 64))


def lines(df, files):
    """The records as JSON in `files` parts. The boxes are dealt by image once, to as many tasks as there are files: what one of them reads is some images, whatever the
    session shuffles to."""
    return records(df.repartition(files, "image_id")).select(F.to_json(F.struct("image_id", "image_size", "candidates")).alias("value"))


def cache_folder(v, df, files, path=None):
    """The records as compressed JSON (as text they are some 15 times the tables they come from), in a new folder or beside what `path` holds."""
    path = path or scratch(v)
    with freed(v.spark):
        lines(df, files).write.mode("append").option("compression", "gzip").text(path)
    return path


def state_size(v) -> int:
    """Partitions for what is kept by image."""
    return 4 + v.images.count() // 5_000


KEPT = f"WITH k AS ({sql_nms('det', 0.5)}), s AS (SELECT * FROM det)"


@query("r1_stream_json_reader", "SELECT CAST(image_id AS VARCHAR) AS image_id, count(*) AS n FROM det GROUP BY 1")
def r1(v):
    files = cache_files(v)
    path = cache_folder(v, v.det, files)
    s = R.read_cache_stream(v.spark, path, at_once(files)).select("image_id", F.size("candidates").cast("bigint").alias("n"))
    out = scratch(v)
    R.run_to_parquet(s, out, out + "-ck")
    remove(v.spark, path)
    return v.spark.read.parquet(out)


@query("r2_stream_merge", f"{KEPT} SELECT CAST(image_id AS VARCHAR) AS image_id, class_id, det_id, score FROM s JOIN (SELECT det_id FROM k) USING (det_id)")
def r2(v):
    files = cache_files(v)
    path, out = cache_folder(v, v.det, files), scratch(v)
    R.run_to_parquet(R.merged_records(R.read_cache_stream(v.spark, path, at_once(files)), 0.5), out, out + "-ck")
    remove(v.spark, path)
    return v.spark.read.parquet(out)


@query("r3_stream_counts", f"{KEPT} SELECT class_id, count(*) AS n FROM s JOIN (SELECT det_id FROM k) USING (det_id) GROUP BY 1 UNION ALL SELECT -1, count(DISTINCT image_id) FROM det")
def r3(v):
    n, path, out = cache_files(v), scratch(v), scratch(v)
    # every image arrives twice, in files of two sizes; the second record is a duplicate, and by then the first one's file is gone: the state knows the image
    for files in (n, n // 2):
        cache_folder(v, v.det, files, path)
        R.run_counts(R.read_cache_stream(v.spark, path, at_once(files)), out, out + "-ck", 0.5, partitions=state_size(v))
        remove(v.spark, path)
    twice = v.spark.read.parquet(f"{out}/violations").agg(F.lit(-1).alias("class_id"), F.count("*").alias("n"))
    return R.running_counts(v.spark, out).filter("class_id >= 0").union(twice)


@query("r4_contiguity", "WITH l AS (SELECT l_orderkey, CASE WHEN lag(l_orderkey // 3) OVER (ORDER BY l_orderkey % 1000, l_orderkey, l_linenumber, l_partkey, l_suppkey) = l_orderkey // 3 THEN 0 ELSE 1 END AS s, l_orderkey // 3 AS k FROM lineitem) SELECT k, sum(s)::BIGINT AS runs FROM l GROUP BY 1")
def r4(v):
    d = v.lineitem.select(F.expr("l_orderkey div 3").alias("k"), F.struct(F.col("l_orderkey") % 1000, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("o"))
    return govern.run_count(d, "k", "o")


@query("r5_resume_by_signature", f"{KEPT} SELECT class_id, count(*) AS n FROM s JOIN (SELECT det_id FROM k) USING (det_id) GROUP BY 1")
def r5(v):
    files = cache_files(v)
    path, out = cache_folder(v, v.det.filter("image_id % 2 = 0"), files), scratch(v)
    run = lambda: R.run_to_parquet(R.merged_records(R.read_cache_stream(v.spark, path, at_once(files)), 0.5), out, f"{out}-{R.signature(threshold=0.5, source=path)}")
    run()
    cache_folder(v, v.det.filter("image_id % 2 = 1"), files, path)
    run()  # the same signature: only what is new
    remove(v.spark, path)
    return R.class_counts(v.spark.read.parquet(out))


@query("r6_paired_sources", "WITH a AS (SELECT image_id, count(*) AS na FROM det WHERE model = 'a' GROUP BY 1), b AS (SELECT image_id, count(*) AS nb FROM det WHERE model = 'b' GROUP BY 1) SELECT CAST(image_id AS VARCHAR) AS image_id, na, nb FROM a JOIN b USING (image_id)")
def r6(v):
    files = cache_files(v) // 2
    a, b = cache_folder(v, v.det.filter("model = 'a'"), files), cache_folder(v, v.det.filter("model = 'b'"), files)
    out = scratch(v)
    j = R.paired_sources(R.read_cache_stream(v.spark, a, at_once(files)), R.read_cache_stream(v.spark, b, at_once(files)))
    with R.state_partitions(v.spark, state_size(v)):
        R.run_to_parquet(j.select("image_id", F.size("a_candidates").cast("bigint").alias("na"), F.size("b_candidates").cast("bigint").alias("nb")), out, out + "-ck")
    remove(v.spark, a)
    remove(v.spark, b)
    return v.spark.read.parquet(out)
