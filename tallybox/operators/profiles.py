"""Scoring profiles as rows: JSON documents of settings, checked and typed, many of them scored against the evidence in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybox.functions.columns import sigmoid
from tallybox.operators.rank import geometric_blend
from tallybox.operators.refine import FEATURES

_JSON = ("struct<support_iou:double,score_blend:double,scaler:struct<mean:map<string,double>,scale:map<string,double>>,linear:struct<intercept:double,coefficients:map<string,double>>,"
         "refinement:struct<enabled:boolean,max_dispersion:double,minimum_anchor_iou:double,minimum_donors:int,score_power:double,anchor_iou_power:double>,_broken:string>")
#: Profiles that one pass may score: they go to every task.
MOST = 10_000


def parsed(documents: DataFrame, name: str = "profile", text: str = "json") -> DataFrame:
    """(profile, support_iou, blend, intercept, weights, refine settings, problem) of JSON texts; what a profile leaves out has the default, which changes nothing.

    weights: array of (feature, mean, scale, coefficient) over FEATURES. problem, null for a good one: not_json, support_iou, score_blend, max_dispersion or minimum_anchor_iou out of [0, 1],
    minimum_donors under 2, `unknown feature ...`, `scale of ...` not positive."""
    j = F.from_json(text, _JSON, {"columnNameOfCorruptRecord": "_broken"})
    d = documents.select(F.col(name).alias("profile"), j.alias("j"))
    get = lambda path, default: F.coalesce(F.col(f"j.{path}"), F.lit(default))
    of = lambda path, f, default: F.coalesce(F.try_element_at(f"j.{path}", F.lit(f)), F.lit(default))
    weights = F.array(*[F.struct(F.lit(f).alias("feature"), of("scaler.mean", f, 0.0).alias("mean"), of("scaler.scale", f, 1.0).alias("scale"), of("linear.coefficients", f, 0.0).alias("coefficient")) for f in FEATURES])
    d = d.select("profile", (F.col("j").isNull() | F.col("j._broken").isNotNull()).alias("_broken"), get("support_iou", 0.5).alias("support_iou"), get("score_blend", 0.0).alias("blend"), get("linear.intercept", 0.0).alias("intercept"), weights.alias("weights"),
                 get("refinement.enabled", False).alias("refines"), get("refinement.max_dispersion", 0.2).alias("max_dispersion"), get("refinement.minimum_anchor_iou", 0.75).alias("minimum_anchor_iou"), get("refinement.minimum_donors", 2).alias("minimum_donors"),
                 get("refinement.score_power", 0.5).alias("score_power"), get("refinement.anchor_iou_power", 1.0).alias("anchor_iou_power"),
                 F.array_sort(F.array_except(F.coalesce(F.map_keys("j.linear.coefficients"), F.array().cast("array<string>")), F.array(*map(F.lit, FEATURES)))).alias("_unknown"))
    share = lambda c: ~F.coalesce(F.col(c).between(0, 1), F.lit(False))
    odd = F.filter("weights", lambda w: ~((w["scale"] > 0) & (w["scale"] < float("inf"))))
    problem = F.coalesce(F.when(F.col("_broken"), "not_json"), *[F.when(share(c), n) for c, n in (("support_iou", "support_iou"), ("blend", "score_blend"))],
                         F.when(F.size("_unknown") > 0, F.concat(F.lit("unknown feature "), F.array_join("_unknown", ", "))), F.when(F.size(odd) > 0, F.concat(F.lit("scale of "), F.array_join(F.transform(odd, lambda w: w["feature"]), ", "))),
                         *[F.when(share(c), c) for c in ("max_dispersion", "minimum_anchor_iou")], F.when(F.col("minimum_donors") < 2, "minimum_donors"))
    return d.withColumn("problem", problem).drop("_broken", "_unknown")


def _quality(weights: Column, intercept: Column) -> Column:
    terms = F.zip_with(F.array(*[F.col(f).cast("double") for f in FEATURES]), weights, lambda x, w: (x - w["mean"]) / w["scale"] * w["coefficient"])
    return sigmoid(F.aggregate(terms, intercept, lambda s, x: s + x), 700.0)


def scored(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """The rows of `df`, which holds the evidence, once for each profile: `profile`, and `score` blended with the profile's quality of the evidence, within 0 and 1.

    A profile with a problem is an error that names it and the reason."""
    bad = profiles.filter("problem is not null").select("profile", "problem").first()
    if bad is not None:
        raise ValueError(f"profile {bad['profile']}: {bad['problem']}")
    n = profiles.count()
    if n > MOST:
        raise ValueError(f"{n} profiles; {MOST} at most")
    p = profiles.select("profile", F.col("blend").alias("_blend"), F.col("intercept").alias("_intercept"), F.col("weights").alias("_weights"))
    rows = df.crossJoin(F.broadcast(p))  # MOST rows at most
    mixed = F.when(F.col("_blend") > 0, geometric_blend(F.col("score"), _quality(F.col("_weights"), F.col("_intercept")), F.col("_blend"))).otherwise(F.col("score"))
    return rows.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), mixed))).drop("_blend", "_intercept", "_weights")
