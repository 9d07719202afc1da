"""Past-only baselines of a trace, and the transforms made of them.

A baseline at a row never depends on later rows. The exponential one is a recursion; stretches of a trace
are handled apart and composed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photonloom.operators.clocks import ranked
from photonloom.operators.stretches import decayed, in_stretches, quantiles

KINDS = ("raw", "ema_residual", "ema_dff", "block_median_residual")


def ema_baseline(df: DataFrame, by: list[str], tau_seconds: float = 60.0, t: str = "t", value: str = "value", tie: str = "event_id") -> DataFrame:
    """df with baseline, the exponential average of irregular samples up to each row; rows are ordered by t, then tie."""
    if tau_seconds <= 0:
        raise ValueError("tau must be positive")
    tau = tau_seconds * 1e6
    placed = ranked(df, by, t, tie, out=("_rn", "_n")).withColumn("_x", F.col(value).cast("double"))
    gain = -F.expm1(-(F.col(t) - F.col("_before")) / tau) * F.col("_x")
    return decayed(placed, by, t, gain, F.col("_x"), tau, "baseline", "_rn").drop("_rn", "_n", "_x")


def range_median(df: DataFrame, by: list[str], lookback_us: int, t: str = "t", value: str = "value") -> DataFrame:
    """df with baseline: the median of the lookback_us before each row, the row itself left out; null if empty."""
    past = F.array_sort(F.collect_list(value).over(Window.partitionBy(*by).orderBy(t).rangeBetween(-lookback_us, -1)))
    n = F.size("_past")
    mid = (F.element_at("_past", F.floor((n + 1) / 2).cast("int")) + F.element_at("_past", (F.floor(n / 2) + 1).cast("int"))) / 2
    return df.withColumn("_past", past).withColumn("baseline", F.when(n > 0, mid)).drop("_past")


def block_median(df: DataFrame, by: list[str], block_us: int = 10_000_000, lookback_us: int = 60_000_000, t: str = "t", value: str = "value", row: str = "rn") -> DataFrame:
    """df with baseline: the median of the lookback before the start of the row's block, held for the block.

    A block has block_us divided by the median interval rows, rounded half to even, one at least. Without
    past rows in the lookback the previous row's value holds, and in the first block the first row's.
    """
    steps = in_stretches(df.select(*by, row, t), by, 1, lambda w: {"_step": F.col(t) - F.lag(t).over(w)}, row)
    rows = quantiles(steps, by, {"_middle": ("_step", 0.5)}).select(*by, F.greatest(F.lit(1), F.bround(block_us / F.col("_middle")).cast("long")).alias("_rows"))
    placed = df.join(rows, by).withColumn("_block", F.floor((F.col(row) - 1) / F.coalesce("_rows", F.lit(1))))
    starts = placed.groupBy(*by, "_block").agg(F.min(t).alias("_t0"), F.min(row).alias("_r0"))
    # past rows meet block starts by time stretches of the lookback's length: those of the start and the one before
    stretch = lambda c: F.floor(c / lookback_us)
    want = starts.withColumn("_part", F.explode(F.array(stretch(F.col("_t0")), stretch(F.col("_t0")) - 1)))
    past = df.select(*by, F.col(t).alias("_t"), F.col(row).alias("_r"), F.col(value).alias("_v"), stretch(F.col(t)).alias("_part"))
    near = want.join(past, [*by, "_part"]).where((F.col("_r") < F.col("_r0")) & (F.col("_t") >= F.col("_t0") - lookback_us))
    mid = near.groupBy(*by, "_block").agg(F.median("_v").alias("_mid"))
    before = df.select(*by, (F.col(row) + 1).alias("_r0"), F.col(value).alias("_prev"))
    first = df.where(F.col(row) == 1).select(*by, F.lit(1).cast("long").alias("_r0"), F.col(value).alias("_prev"))
    held = starts.join(mid, [*by, "_block"], "left").join(before.unionByName(first), [*by, "_r0"], "left").select(*by, "_block", F.coalesce("_mid", "_prev").alias("baseline"))
    return placed.join(held, [*by, "_block"]).drop("_rows", "_block")


def candidate(df: DataFrame, by: list[str], kind: str, tau_seconds: float = 60.0, t: str = "t", value: str = "value", tie: str = "event_id", block_us: int = 10_000_000, lookback_us: int = 60_000_000) -> DataFrame:
    """df with response: the trace, or what a baseline leaves of it; ema_dff divides by at least one unit."""
    if kind == "raw":
        return df.withColumn("response", F.col(value).cast("double"))
    if kind == "block_median_residual":
        return block_median(df, by, block_us, lookback_us, t, value).withColumn("response", F.col(value) - F.col("baseline"))
    if kind not in KINDS:
        raise ValueError(f"Unknown candidate response: {kind}")
    rest = F.col(value) - F.col("baseline")
    return ema_baseline(df, by, tau_seconds, t, value, tie).withColumn("response", rest if kind == "ema_residual" else rest / F.greatest("baseline", F.lit(1.0)))
