"""Bindings of the driver's tables to sessions, clocks and stimuli."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonloom.functions.exprs import micros
from photonloom.operators.clocks import ranked
from photonloom.operators.moments import Moments, moments
from photonloom.operators.splits import blocked
from photonloom.operators.stretches import ROWS, in_stretches

HISTORY = 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("fly"), "user_id", "value", "props", micros("ts").alias("t"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as traces: fly is the session, rn and n place a row in it."""
    return ranked(plain_events(spark, sf_dir), ["fly"], "t", "event_id")


def with_lags(e: DataFrame, lags: int = 2) -> DataFrame:
    return in_stretches(e, ["fly"], lags, lambda w: {f"x{k}": F.lag("value", k).over(w) for k in range(1, lags + 1)})


def embedding_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sessions of stimulus vectors x (4 bins of 16 pixels) and two responses y, split 50/20/30."""
    v = table(spark, sf_dir, "embeddings").withColumn("session", F.concat(F.lit("s"), (F.col("vec_id") % 5).cast("string")))
    v = ranked(v, ["session"], "vec_id", "vec_id", ROWS)
    y = F.array(F.col("label").cast("double") + F.col("embedding")[3].cast("double"), 2 * F.col("embedding")[21].cast("double") + F.col("embedding")[5].cast("double"))
    return v.withColumn("split", blocked(4, True)).select("session", "vec_id", "rn", "split", F.col("embedding").alias("x"), y.alias("y"))


def session_moments(spark: SparkSession, sf_dir: str) -> dict[str, dict[str, Moments]]:
    found = moments(embedding_sessions(spark, sf_dir).where("split <> 'purge'"), ["session", "split"])
    out: dict[str, dict[str, Moments]] = {}
    for (s, split), m in sorted(found.items()):
        out.setdefault(s, {})[split] = m
    return out
