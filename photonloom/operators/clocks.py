"""Clocks: ranks, as-of alignment of frames with past updates, and clock summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonloom.operators.stretches import in_stretches, quantiles

DAY_US = 86_400_000_000


def ranked(df: DataFrame, by: list[str], order: str, tie: str, width: int = DAY_US, out: tuple[str, str] = ("rn", "n")) -> DataFrame:
    """df with rn (1..n by order, then tie) and n, or what out calls them, for each group of by.

    order is divided into stretches of width; only the totals of the stretches are ordered as a whole,
    so a group of any size is sorted in as many parts as it has stretches.
    """
    df = df.withColumn("_part", F.floor(F.col(order) / width))
    sizes = df.groupBy(*by, "_part").agg(F.count("*").alias("_size"))
    by_part = Window.partitionBy(*by).orderBy("_part")
    sizes = sizes.select(*by, "_part", F.coalesce(F.sum("_size").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"), F.sum("_size").over(Window.partitionBy(*by)).alias(out[1]))
    within = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(order, tie))
    return df.withColumn("_within", within).join(sizes, [*by, "_part"]).withColumn(out[0], F.col("_ahead") + F.col("_within")).drop("_part", "_ahead", "_within")


def asof(frames: DataFrame, updates: DataFrame, by: list[str], payload: list[str], t: str = "t", width: int = DAY_US) -> DataFrame:
    """frames with payload of the last update at or before each frame; nulls where there is none.

    Frames and updates meet in one ordered window for each stretch of time. A frame without an update
    in its stretch takes the last update of the stretches before, found among one row for each stretch.
    """
    held = F.struct(F.col(t).alias("_at"), *[F.col(c) for c in payload])
    names = frames.columns
    both = updates.select(*by, t, held.alias("_up"), F.lit(0).alias("_kind")).unionByName(frames.select("*", F.lit(1).alias("_kind")), allowMissingColumns=True)
    both = both.withColumn("_part", F.floor(F.col(t) / width))
    last = both.where("_kind = 0").groupBy(*by, "_part").agg(F.max("_up").alias("_last"))
    parts = both.select(*by, "_part").distinct().join(last, [*by, "_part"], "left")
    parts = parts.withColumn("_before", F.last("_last", True).over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    near = F.last("_up", True).over(Window.partitionBy(*by, "_part").orderBy(t, "_kind").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_near", near).where("_kind = 1").join(parts.select(*by, "_part", "_before"), [*by, "_part"])
    up = F.coalesce("_near", "_before")
    return found.select(*names, *[up[c].alias(c) for c in payload])


def in_payload(aligned: DataFrame, update: str, end_us: int, t: str = "t") -> DataFrame:
    """Frames with an update, before the end; the start is inclusive, the end exclusive."""
    return aligned.where(F.col(update).isNotNull() & (F.col(t) < end_us))


def with_steps(df: DataFrame, by: list[str], t: str = "t", row: str = "rn", out: str = "step") -> DataFrame:
    """df with the time since the row before, null in the first row."""
    return in_stretches(df, by, 1, lambda w: {out: F.col(t) - F.lag(t).over(w)}, row)


def playback_alignment(df: DataFrame, by: list[str], t: str = "t", played_us: str = "played_us") -> DataFrame:
    """The median offset of the recorded clock from the playback's, in seconds, and the 0.99 quantile of its absolute residual, in milliseconds."""
    own = df.select(*by, (F.col(t) - F.col(played_us)).alias("_offset"))
    middle = quantiles(own, by, {"_middle": ("_offset", 0.5)})
    rest = own.join(middle, by).withColumn("_rest", F.abs(F.col("_offset") - F.col("_middle")) / 1000)
    far = quantiles(rest, by, {"playback_p99_abs_residual_ms": ("_rest", 0.99)})
    return middle.join(far, by).select(*by, (F.col("_middle") / 1_000_000).alias("playback_offset_s"), "playback_p99_abs_residual_ms")


def check_clock(df: DataFrame, by: list[str], t: str = "t", row: str = "rn") -> None:
    """Raise unless each group has two rows at least and t grows with row."""
    bad = with_steps(df, by, t, row, "_step").groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("_step") <= 0).alias("back")).where("n < 2 or back > 0").limit(3).collect()
    if bad:
        raise ValueError(f"Non-increasing or empty clock: {bad}")


def best(df: DataFrame, by: list[str], value: str, score: str | Column) -> DataFrame:
    """by and the value with the largest score; of equal scores the smallest value, nulls last."""
    s = F.col(score) if isinstance(score, str) else score
    return df.where(s.isNotNull()).groupBy(*by).agg(F.max_by(value, F.struct(s, -F.col(value))).alias(value), F.max(s).alias("best_score"))


def clock_summary(df: DataFrame, by: list[str], t: str = "t", row: str = "rn", expected_us: float | None = None) -> DataFrame:
    """Count, ends, backward steps and interval quantiles of each clock."""
    step = with_steps(df.select(*by, row, t), by, t, row)
    found = quantiles(step, by, {name: ("step", q) for name, q in (("median_interval_us", 0.5), ("p01_interval_us", 0.01), ("p99_interval_us", 0.99))})
    return step.join(found, by).groupBy(*by).agg(
        F.count("*").alias("count"),
        F.min(t).alias("start_us"),
        F.max(t).alias("end_us"),
        F.count_if(F.col("step") <= 0).alias("duplicate_or_reverse"),
        F.first("median_interval_us").alias("median_interval_us"),
        F.first("p01_interval_us").alias("p01_interval_us"),
        F.first("p99_interval_us").alias("p99_interval_us"),
        F.max("step").alias("max_interval_us"),
        F.count_if(F.col("step") > 1.5 * F.col("median_interval_us")).alias("intervals_over_1p5x_median"),
        F.lit(expected_us).cast("double").alias("nominal_interval_us"),
    )
