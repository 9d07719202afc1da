"""A feature table that many sessions share: written once in buckets of the update index, gathered without moving it."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonloom.sources.shared import new_folder


@dataclass(frozen=True)
class FeatureTable:
    """name of the table, its index column and its feature columns, in order."""

    name: str
    index: str
    columns: tuple[str, ...]

    def read(self, spark: SparkSession, rows: tuple[int, int] | None = None, columns: slice | None = None) -> DataFrame:
        """The index and some features of the updates from rows[0] up to rows[1]; both reach the Parquet reader."""
        found = spark.table(self.name)
        if rows is not None:
            found = found.where((F.col(self.index) >= rows[0]) & (F.col(self.index) < rows[1]))
        return found.select(self.index, *self.columns[columns or slice(None)])


def write_features(df: DataFrame, index: str, vector: str, size: int, name: str = "f", buckets: int | None = None) -> FeatureTable:
    """One column for each of the first size entries of vector, in buckets of index, sorted by it; index must be unique.

    There are as many buckets as shuffles have partitions, unless told, so that joins keep them as they are.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = tuple(f"{name}{k:0{len(str(size - 1))}d}" for k in range(size))
    table = f"features_{uuid.uuid4().hex}"
    rows = df.select(index, *[F.col(vector)[k].cast("double").alias(c) for k, c in enumerate(columns)]).repartition(buckets, index)
    rows.write.bucketBy(buckets, index).sortBy(index).option("path", new_folder(spark, "features")).saveAsTable(table)
    twice = spark.table(table).groupBy(index).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"update {twice[0][0]} has more than one row of features")
    return FeatureTable(table, index, columns)


def gather(frames: DataFrame, features: FeatureTable, on: str, rows: tuple[int, int] | None = None, columns: slice | None = None) -> DataFrame:
    """frames with the features of their update, only where it has any. The frames go to the buckets; the features stay where they are."""
    spark = frames.sparkSession
    own = frames if rows is None else frames.where((F.col(on) >= rows[0]) & (F.col(on) < rows[1]))
    right = features.read(spark, rows, columns).withColumnRenamed(features.index, "_index")
    return own.join(right.hint("merge"), own[on] == right["_index"]).drop("_index")
