"""Checks of a frozen binary stimulus against the seed it was made from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reconstructed(spark: SparkSession, seed: int, updates: int, pixels: int, bright: float) -> DataFrame:
    """(row, values) of plus and minus one, from the generator's single seeded stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            signs = np.where(np.random.RandomState(seed).random_sample((updates, pixels)) < bright, 1.0, -1.0)
            yield pd.DataFrame({"row": np.arange(updates), "values": list(signs.astype(np.float32))})

    return spark.range(1, numPartitions=1).mapInPandas(run, "row long, values array<float>")


def mismatches(left: DataFrame, right: DataFrame, key: str = "row", value: str = "values") -> int:
    """Keys that one side lacks or whose values differ."""
    pairs = left.select(key, F.col(value).alias("_a")).join(right.select(key, F.col(value).alias("_b")), key, "full_outer")
    return pairs.where(~F.col("_a").eqNullSafe(F.col("_b"))).count()


def gray_mismatches(updates: DataFrame, gray: DataFrame, dark: float, bright: float, key: str = "row", value: str = "values") -> int:
    """Rows where the gray map of the signs differs from what was rendered."""
    mapped = updates.withColumn(value, F.transform(value, lambda v: F.when(v > 0, bright).otherwise(dark).cast("float")))
    return mismatches(mapped, gray, key, value)


def differing_stimuli(df: DataFrame, key: str, value: str) -> DataFrame:
    """Updates whose value isn't the same in all sessions."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("kinds")).where("kinds > 1")
