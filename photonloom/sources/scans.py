"""Scans of recorded sessions, each with its contract; a broken contract raises."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_PATH = r"(fly[^/]*)/([^/]+)/[^/]+$"


def _path() -> Column:
    return F.col("_metadata.file_path")


def _session(df: DataFrame) -> DataFrame:
    return df.withColumns({"fly": F.regexp_extract("_file", SESSION_PATH, 1), "run_id": F.regexp_extract("_file", SESSION_PATH, 2)})


def discover_sessions(spark: SparkSession, root: str) -> DataFrame:
    """(fly, run_id, path) of every fly*/*/Results.csv below root, sorted by path."""
    files = spark.read.format("binaryFile").load(f"{root}/fly*/*/Results.csv").select(F.col("path").alias("_file"))
    found = _session(files).select("fly", "run_id", F.col("_file").alias("path")).orderBy("path")
    if found.isEmpty():
        raise FileNotFoundError(f"no sessions below {root}")
    return found


def exactly_one(files: DataFrame, by: list[str]) -> DataFrame:
    """files, if each group has one; else an error that names the groups."""
    odd = files.groupBy(*by).count().where("count <> 1").limit(3).collect()
    if odd:
        raise ValueError(f"Expected exactly one file: {odd}")
    return files


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column labels of a CSV file's first line, a byte order mark taken off."""
    first = spark.read.text(path).limit(1).first()
    if first is None:
        raise ValueError(f"Empty file: {path}")
    return [x.strip().strip('"') for x in first.value.removeprefix("﻿").split(",")]


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """(sample_index from 0, roi, value) of a CSV with frame numbers 1..n and one column for each ROI."""
    labels = header_of(spark, path)
    rois = labels[1:]
    if len(set(rois)) != len(rois):
        raise ValueError(f"Duplicate ROI labels: {path}")
    if not rois or not all(rois):
        raise ValueError(f"Missing ROI labels: {path}")
    # labels are set by position, as Spark renames columns that share one
    names = ["_frame", *(f"_c{k}" for k in range(len(rois)))]
    wide = spark.read.schema(", ".join([f"{names[0]} long", *(f"{n} float" for n in names[1:])])).option("header", True).option("enforceSchema", True).csv(path)
    bad = F.greatest(*[F.coalesce((F.isnan(n) | (F.abs(n) == float("inf"))).cast("int"), F.lit(1)) for n in names[1:]], F.lit(0))
    seen = wide.agg(F.count("*").alias("n"), F.min("_frame").alias("low"), F.max("_frame").alias("high"), F.count_distinct("_frame").alias("kinds"), F.sum(bad).alias("bad")).first()
    if seen.n == 0 or (seen.low, seen.high, seen.kinds) != (1, seen.n, seen.n):
        raise ValueError(f"Frame column is not consecutive: {path}")
    if seen.bad:
        raise ValueError(f"Non-finite ROI values: {path}")
    long = wide.select((F.col("_frame") - 1).alias("sample_index"), F.explode(F.map_from_arrays(F.array(*map(F.lit, rois)), F.array(*names[1:]))).alias("roi", "value"))
    return long


def read_clock(spark: SparkSession, path: str, column: str = "timestamp_us", kind: str = "long") -> DataFrame:
    """(row from 1, t) of one clock column, which must grow and have two rows at least."""
    from photonloom.operators.clocks import check_clock

    if column not in header_of(spark, path):
        raise ValueError(f"{path} lacks required column {column}")
    raw = spark.read.option("header", True).csv(path)
    rows = raw.select(F.monotonically_increasing_id().alias("rn"), F.col(f"`{column}`").cast(kind).alias("t"), F.lit(path).alias("clock"))
    check_clock(rows, ["clock"])
    return rows.select("rn", "t")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


@dataclass(frozen=True)
class Config:
    """Experiment settings; folds map names to (train_end, validation_end, test_end)."""

    bins: int
    updates_per_bin: int
    folds: dict[str, tuple[int, int, int]]
    alphas: tuple[float, ...]

    @classmethod
    def load(cls, path: str, updates: int, version: int = 1) -> Config:
        from photonloom.operators.splits import GlobalSplit

        raw = json.loads(Path(path).read_text())
        if raw.get("schema_version") != version:
            raise ValueError("Unsupported config version")
        bins, width = raw["features"]["bins"], raw["features"]["updates_per_bin"]
        folds = {f["name"]: (f["train_end"], f["validation_end"], f["test_end"]) for f in raw["folds"]}
        if len(folds) < 2 or len(folds) != len(raw["folds"]):
            raise ValueError("At least two folds of unique names are required")
        alphas = tuple(map(float, raw["alphas"]))
        if bins < 1 or width < 1 or not alphas or min(alphas) <= 0:
            raise ValueError("Bins, widths and penalties must be positive")
        for ends in folds.values():
            GlobalSplit(bins * width, *ends).validate(updates)
        return cls(bins, width, folds, alphas)


def resolve_root(*candidates: str | None) -> Path:
    """The first of the given folders that exists."""
    for c in candidates:
        if c and os.path.isdir(c):
            return Path(c).resolve()
    raise FileNotFoundError(f"none of {candidates} is a folder")
