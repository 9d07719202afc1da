"""Comparisons between models, sessions and saved outputs, and the experiment registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonloom.functions.exprs import dot, median, pearson

REGISTRY_FIELDS = ("experiment_id", "created_at", "model", "fold", "response", "normalization", "features", "flies", "rois", "median_r2", "responsive_median_r2", "fraction_positive_r2", "comparison_baseline", "notes", "artifact_dir")


def check_same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    odd = left.select(*keys).withColumn("_l", F.lit(1)).join(right.select(*keys).withColumn("_r", F.lit(1)), keys, "full_outer").where("_l is null or _r is null").limit(3).collect()
    if odd:
        raise ValueError(f"Keys differ: {odd}")


def deltas(model: DataFrame, baseline: DataFrame, keys: list[str], r2: str = "r2") -> DataFrame:
    """Rows of both with a score in both, and delta, the model's less the baseline's."""
    pairs = model.select(*keys, F.col(r2).alias("model_r2")).join(baseline.select(*keys, F.col(r2).alias("baseline_r2")), keys)
    return pairs.where("model_r2 is not null and baseline_r2 is not null").withColumn("delta", F.col("model_r2") - F.col("baseline_r2"))


def delta_summary(pairs: DataFrame, group: str) -> DataFrame:
    """Median delta and improved share for each group and over all (null group), with groups of positive median."""
    own = pairs.groupBy(group).agg(F.count("*").alias("n"), median("delta").alias("median_delta"), F.avg((F.col("delta") > 0).cast("double")).alias("fraction_improved"))
    positive = own.agg(F.count_if(F.col("median_delta") > 0).alias("positive_groups"))
    over = pairs.agg(F.count("*").alias("n"), median("delta").alias("median_delta"), F.avg((F.col("delta") > 0).cast("double")).alias("fraction_improved")).withColumn("_k", F.lit(1))
    over = over.join(F.broadcast(positive.withColumn("_k", F.lit(1))), "_k").drop("_k").withColumn(group, F.lit(None).cast(pairs.schema[group].dataType))
    return own.withColumn("positive_groups", F.lit(None).cast("long")).unionByName(over)


def kernel_cosine(left: DataFrame, right: DataFrame, keys: list[str], vector: str = "kernel") -> DataFrame:
    """Absolute cosine of two kernels for each key; null where one is zero."""
    pairs = left.select(*keys, F.col(vector).alias("_a")).join(right.select(*keys, F.col(vector).alias("_b")), keys)
    return pairs.select(*keys, F.abs(F.try_divide(dot("_a", "_b"), F.sqrt(dot("_a", "_a") * dot("_b", "_b")))).alias("abs_cosine"))


def pairwise_correlation(maps: DataFrame, unit: str, place: str, value: str) -> DataFrame:
    """Correlation of two units' maps over common places, for each unordered pair."""
    a, b = (maps.select(F.col(unit).alias(f"{unit}_{s}"), F.col(place).alias("_p"), F.col(value).alias(f"_{s}")) for s in "ab")
    pairs = a.join(b, "_p").where(F.col(f"{unit}_a") < F.col(f"{unit}_b"))
    return pairs.groupBy(f"{unit}_a", f"{unit}_b").agg(F.coalesce(pearson("_a", "_b"), F.lit(0.0)).alias("r"))


def upsert(old: DataFrame, new: DataFrame, key: str = "experiment_id", fields: tuple[str, ...] = REGISTRY_FIELDS) -> DataFrame:
    """Rows of new, and those of old with no key in new; fields only, missing ones empty, all strings."""

    def shaped(df: DataFrame) -> DataFrame:
        return df.select(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f) for f in fields])

    new = shaped(new)
    return shaped(old).join(new.select(key), key, "left_anti").select(*fields).unionByName(new)


def flattened(df: DataFrame, id_col: str, json: str) -> DataFrame:
    """(id, path, value) of the scalar entries of JSON objects, two levels deep; deeper ones stay JSON."""
    top = df.select(F.col(id_col).alias("id"), F.explode(F.from_json(json, "map<string,string>")).alias("k", "v"))
    inner = F.from_json("v", "map<string,string>")
    nested = top.where(F.col("v").startswith("{")).select("id", "k", F.explode(inner).alias("k2", "v2"))
    return top.where(~F.col("v").startswith("{") | F.col("v").isNull()).select("id", F.concat(F.lit("/"), "k").alias("path"), F.col("v").alias("value")).unionByName(nested.select("id", F.concat(F.lit("/"), "k", F.lit("/"), "k2").alias("path"), F.col("v2").alias("value")))


def json_diff(left: DataFrame, right: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Each (id, path) of either side with status same, differs, left_only or right_only, and the numeric delta."""
    pairs = left.withColumnRenamed("value", "l").withColumn("_l", F.lit(1)).join(right.withColumnRenamed("value", "r").withColumn("_r", F.lit(1)), ["id", "path"], "full_outer")
    a, b = F.expr("try_cast(l as double)"), F.expr("try_cast(r as double)")
    numeric = a.isNotNull() & b.isNotNull()
    close = F.when(numeric, F.abs(a - b) <= tolerance + tolerance * F.abs(b)).otherwise(F.col("l").eqNullSafe(F.col("r")))
    status = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(close, "same").otherwise("differs")
    return pairs.select("id", "path", status.alias("status"), F.when(numeric, F.abs(a - b)).alias("delta"))


def old_keys_preserved(left: DataFrame, right: DataFrame) -> bool:
    return left.join(right, ["id", "path"], "left_anti").isEmpty()


def regression_class(diff: DataFrame, tolerance: float = 1e-8) -> str:
    """NUMERICAL_CHANGE where a value differs or went missing, else READABILITY_ONLY."""
    return "READABILITY_ONLY" if diff.where("status in ('differs', 'left_only')").isEmpty() else "NUMERICAL_CHANGE"
