"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: A key with over 1 / HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE such keys at any scale.
HOT_SHARE = 4096
#: Bytes of an Arrow batch within small_batches().
BATCH_BYTES = 4 << 20
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Only where it is unset and the master is local, so that this machine is the only one, it is a temporary
    folder, with a warning; on a cluster an unset folder is an error.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or _own.get(spark.sparkContext.applicationId)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own[spark.sparkContext.applicationId] = f"file://{tempfile.mkdtemp(prefix='photonloom-')}"
        warnings.warn(f"spark.checkpoint.dir is unset: this local run keeps its tables in {found}", stacklevel=2)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/photonloom/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """For the actions within it, Arrow batches of at most so many bytes (or one row), so that long texts don't fill Python workers.

    The session's own setting is back afterwards, so what runs later is not bounded by it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    kept = spark.conf.get(name)
    spark.conf.set(name, f"{most}b")
    try:
        yield
    finally:
        spark.conf.set(name, kept)


def as_text(df: DataFrame, id_col: str) -> Column:
    """The id as a string, for Python workers: pandas would turn whole numbers beside a null into floating-point ones."""
    return F.col(f"`{id_col}`").cast("string")


def as_id(df: DataFrame, id_col: str, name: str = "id") -> Column:
    """Back from as_text() to the type that id_col has in df."""
    return F.col(name).cast(df.schema[id_col].dataType)


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores before it until no column of that name, in whatever case, is taken."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def hot_keys(counts: DataFrame, n: str = "n") -> DataFrame:
    """Rows of counts, a table of keys and their numbers of rows, with over 1 / HOT_SHARE of all rows."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).first().n
    return counts.where(F.col(n) * HOT_SHARE > total)


def join_split(big: DataFrame, small: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """big left join small by key, for a small that has each key once and rows of a few hundred bytes.

    Rows of big with a hot key stay where they are and meet their row by broadcast, of fewer than HOT_SHARE
    rows; the others are dealt by key, and none of these has more than 1 / HOT_SHARE of all rows.
    """
    if hot.isEmpty():
        return big.join(small, key, "left")
    own = F.broadcast(staged(small.join(F.broadcast(hot.select(key)), key, "left_semi"), "hot"))
    marked = big.join(F.broadcast(staged(hot.select(key), "hotkeys").withColumn("_hot", F.lit(True))), key, "left")
    near = marked.where("_hot").drop("_hot").join(own, key, "left")
    far = marked.where("_hot is null").drop("_hot").join(small, key, "left")
    return near.unionByName(far)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str | Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: str | Column, n: str | Column) -> Column:
    """The beginning of a text with its first n words and the white space between and after them."""
    space, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    parts = F.split(text, f"(?<={space})(?={word})")
    # a text that begins with white space has a first part without a word
    more = F.when(F.rlike(text, F.lit(f"^{space}")), 1).otherwise(0)
    return F.array_join(F.slice(parts, F.lit(1), (F.col(n) if isinstance(n, str) else n).cast("int") + more), "")
