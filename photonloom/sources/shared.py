"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local master without one gets a temporary folder, with a warning, a cluster an error."""
    conf = spark.sparkContext.getConf()
    app = spark.sparkContext.applicationId
    found = conf.get("spark.checkpoint.dir") or _own.get(app)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _own[app] = f"file://{tempfile.mkdtemp(prefix='photonloom-')}"
        warnings.warn(f"spark.checkpoint.dir is unset; intermediate tables of this local run are in {found}", stacklevel=2)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/photonloom/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written and read again, so that later steps don't compute it anew and lost executors lose nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
