"""Saved models: versions named by their content, with a manifest, and a replay that refuses other sources.

A version is a folder of Parquet tables, models and predictions by fly and run, and a manifest written last. Its
name is a hash of all model rows, so a changed table no longer matches its name.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonloom.operators.contracts import raise_first
from photonloom.operators.history import lagged_vectors
from photonloom.plans.experiments import verify_replay

BY = ["fly", "run_id"]
MODEL = ["fly", "run_id", "roi", "pixel", "kernel", "bias"]
PREDICTION = ["fly", "run_id", "roi", "t", "actual", "predicted"]


def content_hash(df: DataFrame) -> str:
    """A hash of the rows, whatever their order: row hashes in 256 lots, each sorted and hashed, and the lots' hashes hashed."""
    rows = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    lots = rows.groupBy(F.substring("h", 1, 2).alias("lot")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    return hashlib.sha256("".join(f"{r.lot}{r.h}" for r in lots.orderBy("lot").collect()).encode()).hexdigest()


@dataclass(frozen=True)
class Version:
    name: str
    models: DataFrame
    predictions: DataFrame
    manifest: dict


def save(models: DataFrame, predictions: DataFrame, folder: str, sources: dict[str, str], facts: dict | None = None) -> str:
    """Write a version and return its name. sources maps each source table or file to its content_hash()."""
    spark = models.sparkSession
    models, predictions = models.select(*MODEL), predictions.select(*PREDICTION)
    if models.isEmpty():
        raise ValueError("no models to save")
    raise_first(models.groupBy("fly", "run_id", "roi").count().where("count > 1"), "More than one model of a response")
    name = content_hash(models)
    for part, df in (("models", models), ("predictions", predictions)):
        df.write.mode("overwrite").partitionBy(*BY).parquet(f"{folder}/{name}/{part}")
    manifest = json.dumps({"version": name, "sources": sources, "facts": facts or {}}, sort_keys=True)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}/manifest")
    return name


def load(spark: SparkSession, folder: str, name: str) -> Version:
    """A version whose models still have the content that names it."""
    manifest = json.loads(spark.read.text(f"{folder}/{name}/manifest", wholetext=True).first().value)
    kinds = "roi string, pixel int, kernel array<double>, bias double, fly string, run_id string"
    models = spark.read.schema(kinds).parquet(f"{folder}/{name}/models").select(*MODEL)
    predictions = spark.read.schema("roi string, t long, actual double, predicted double, fly string, run_id string").parquet(f"{folder}/{name}/predictions").select(*PREDICTION)
    if manifest["version"] != name or content_hash(models) != name:
        raise ValueError(f"Models of version {name} differ from what was saved")
    return Version(name, models, predictions, manifest)


def check_inputs(models: DataFrame, frames: DataFrame, updates: DataFrame) -> None:
    """What a replay needs of models, of frames (fly, run_id, roi, t, u) and of updates (u from 0, x); each broken rule raises."""
    raise_first(models.where("kernel is null or size(kernel) = 0 or bias is null or isnan(bias) or exists(kernel, k -> k is null or isnan(k))"), "A kernel or bias is missing or not finite")
    raise_first(models.agg(F.count_distinct(F.size("kernel")).alias("lengths")).where("lengths > 1"), "Kernels differ in length")
    shape = updates.agg(F.count("*").alias("n"), F.min("u").alias("low"), F.max("u").alias("high"), F.min(F.size("x")).alias("width"), F.max(F.size("x")).alias("widest")).first()
    if not shape.n or (shape.low, shape.high) != (0, shape.n - 1) or shape.width != shape.widest:
        raise ValueError("Updates must count from 0 without gaps and have vectors of one size")
    raise_first(models.where((F.col("pixel") < 0) | (F.col("pixel") >= shape.width) | F.col("pixel").isNull()), "A pixel lies outside the stimulus")
    known = frames.join(models.select("fly", "run_id", "roi", F.size("kernel").alias("_lags")), ["fly", "run_id", "roi"], "left")
    raise_first(known.where("_lags is null"), "A response is absent from the saved models")
    raise_first(known.where(F.coalesce((F.col("u") < F.col("_lags") - 1) | (F.col("u") >= shape.n), F.lit(True))), "An update index has no complete history in the stimulus")


def predict(models: DataFrame, frames: DataFrame, updates: DataFrame) -> DataFrame:
    """frames with predicted: the kernel times the pixel's values at the frame's update and before, plus the bias; inputs are checked."""
    check_inputs(models, frames, updates)
    lags = models.select(F.size("kernel").alias("n")).first().n
    width = updates.select(F.size("x").alias("n")).first().n
    history = lagged_vectors(updates.select(F.lit(1).alias("_all"), "u", "x", (F.col("u") + 1).alias("rn")), ["_all"], "x", lags).select("u", F.col("x").alias("_x"))
    found = frames.join(history, "u").join(models.select("fly", "run_id", "roi", "pixel", "kernel", "bias"), ["fly", "run_id", "roi"])
    terms = F.transform("kernel", lambda k, lag: k * F.element_at("_x", (lag * width + F.col("pixel") + 1).cast("int")))
    return found.withColumn("predicted", F.aggregate(terms, F.col("bias"), lambda s, v: s + v)).drop("_x", "pixel", "kernel", "bias")


def replay(version: Version, frames: DataFrame, updates: DataFrame, sources: dict[str, str], tolerance: float = 1e-9) -> DataFrame:
    """(fly, run_id, roi, t, predicted, actual) of saved test frames, predicted anew from frames (fly, run_id, roi, t, u, actual).

    Raises if a source's hash differs from the saved one, if frames' values aren't the saved ones, or if a
    prediction differs by more than the tolerance, absolute and relative.
    """
    saved = version.manifest["sources"]
    odd = sorted(k for k in saved.keys() | sources.keys() if saved.get(k) != sources.get(k))
    if odd:
        raise ValueError(f"Sources differ from those of the saved models: {odd}")
    keys = ["fly", "run_id", "roi", "t"]
    verify_replay(version.predictions, frames, keys, "actual", 0.0)
    found = predict(version.models, frames, updates)
    verify_replay(version.predictions, found, keys, "predicted", tolerance)
    return found.select(*keys, "predicted", "actual")
