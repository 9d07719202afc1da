"""Scores, scalers, trace quality, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonloom.functions.exprs import median, pearson, r_squared
from photonloom.operators.stretches import in_stretches, quantiles
from photonloom.operators.transforms import power_spectrum
from photonloom.sources.shared import kept


def score(df: DataFrame, by: list[str], actual: str, predicted: str, train_variance: str | None = None) -> DataFrame:
    """r, r2, mse and nmse of each group; undefined ones are null."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    mse = F.avg((a - p) * (a - p))
    variance = F.first(train_variance, True) if train_variance else F.lit(None).cast("double")
    return df.groupBy(*by).agg(F.count("*").alias("n"), pearson(a, p).alias("r"), r_squared(a, p).alias("r2"), mse.alias("mse"), F.try_divide(mse, variance).alias("nmse"))


def summarize(records: DataFrame, group: str, r2: str = "r2", responsive: str | None = None) -> DataFrame:
    """Medians, means and positive shares of r2 for each group and, with a null group, over all."""
    chosen = F.when(F.col(responsive), F.col(r2)) if responsive else F.lit(None).cast("double")
    return records.withColumn("_chosen", chosen).groupingSets([[], [group]], group).agg(
        F.count(r2).alias("scored"),
        median(r2).alias("median_r2"),
        F.avg(r2).alias("mean_r2"),
        F.avg(F.when(F.col(r2).isNotNull(), (F.col(r2) > 0).cast("double"))).alias("fraction_positive_r2"),
        median("_chosen").alias("responsive_median_r2"),
    )


def scaler(df: DataFrame, by: list[str], value: str, split: str = "split", normalization: str = "zscore", least: float = 1e-8) -> DataFrame:
    """Centre and scale of the training rows of each group; a constant group keeps scale 1 and is flagged."""
    if normalization not in ("zscore", "raw"):
        raise ValueError(f"Unknown normalization: {normalization}")
    own = df.where(F.col(split) == "train").groupBy(*by).agg(F.avg(value).alias("center"), F.stddev_pop(value).alias("spread"))
    flat = F.col("spread") < least
    if normalization == "raw":
        return own.select(*by, F.lit(0.0).alias("center"), F.lit(1.0).alias("scale"), flat.alias("zero_variance"))
    return own.select(*by, "center", F.when(flat, 1.0).otherwise(F.col("spread")).alias("scale"), flat.alias("zero_variance"))


def scale(df: DataFrame, scales: DataFrame, by: list[str], value: str, out: str = "z") -> DataFrame:
    return df.join(scales, by).withColumn(out, (F.col(value) - F.col("center")) / F.col("scale"))


def unscale(df: DataFrame, scales: DataFrame, by: list[str], z: str, out: str = "value") -> DataFrame:
    return df.join(scales, by).withColumn(out, F.col(z) * F.col("scale") + F.col("center"))


def calibrated(df: DataFrame, by: list[str], y: str, projection: str) -> DataFrame:
    """Gain and intercept that map a projection to the response; gain 0 where the projection is constant."""
    gain = F.coalesce(F.try_divide(F.covar_pop(projection, y), F.var_pop(projection)), F.lit(0.0))
    return df.groupBy(*by).agg(gain.alias("gain"), (F.avg(y) - gain * F.avg(projection)).alias("intercept"))


def trace_quality(df: DataFrame, by: list[str], value: str = "value", row: str = "rn", n: str = "n") -> DataFrame:
    """Location, spread, tails, drift, outliers, jumps and lag-1 correlation of each trace."""
    own = df.select(*by, F.col(row).alias("rn"), F.col(n).alias("n"), F.col(value).cast("double").alias("v"))
    own = in_stretches(own, by, 1, lambda w: {"prev": F.lag("v").over(w)}).withColumn("step", F.col("v") - F.col("prev"))
    own = kept(own, "steps")
    tails = {f"p{q:02d}": ("v", q / 100) for q in (1, 5, 95, 99)}
    top = own.groupBy(*by).agg(F.max("v").alias("top"))
    own = own.join(quantiles(own, by, {"median": ("v", 0.5), "mid_step": ("step", 0.5)} | tails), by).join(top, by)
    own = own.join(quantiles(own, by, {"mad": (F.abs(F.col("v") - F.col("median")), 0.5), "jump": (F.abs(F.col("step") - F.col("mid_step")), 0.5)}), by)
    mean = F.avg("v")
    first, last = F.avg(F.when(F.col("rn") <= F.floor(F.col("n") / 10), F.col("v"))), F.avg(F.when(F.col("rn") > F.col("n") - F.ceil(F.col("n") / 10), F.col("v")))
    pairs = F.col("prev").isNotNull()
    before, now = F.when(pairs, F.col("prev")), F.when(pairs, F.col("v"))
    return own.groupBy(*by).agg(
        F.count("*").alias("count"),
        mean.alias("mean"),
        F.first("median").alias("median"),
        F.stddev_pop("v").alias("std"),
        F.try_divide(F.stddev_pop("v"), mean).alias("cv"),
        F.min("v").alias("min"),
        *[F.first(name).alias(name) for name in tails],
        F.max("v").alias("max"),
        F.count_if(F.col("v") == 0).alias("zero_count"),
        F.count_if(F.col("v") == F.col("top")).alias("at_max_count"),
        F.try_divide(last - first, mean).alias("decile_change"),
        F.count_if((F.col("mad") > 0) & (F.abs(F.col("v") - F.col("median")) > 6 * 1.4826 * F.col("mad"))).alias("robust_outlier_count"),
        F.count_if((F.col("jump") > 0) & (F.abs(F.col("step") - F.col("mid_step")) > 8 * 1.4826 * F.col("jump"))).alias("abrupt_jump_count"),
        F.coalesce(pearson(before, now), F.lit(0.0)).alias("lag1_autocorrelation"),
    )


def spectrum_peak(df: DataFrame, by: list[str], sample_hz: float, value: str = "value", row: str = "rn", n: str = "n") -> DataFrame:
    """Frequency with the most power of each trace, the mean taken out, the lowest of equal ones; row counts from 1 to n.

    A trace of one row or without power has frequency 0.
    """
    own = df.select(*by, (F.col(row) - 1).alias("_place"), F.col(n).cast("long").alias("_n"), F.col(value).cast("double").alias("_v"))
    mean = own.groupBy(*by).agg(F.avg("_v").alias("_mean"))
    power = power_spectrum(own.join(mean, by).withColumn("_v", F.col("_v") - F.col("_mean")), by, "_v", "_place", "_n")
    top = power.groupBy(*by, "_n").agg(F.max_by("k", F.struct(F.when(F.col("k") > 0, F.col("power")).otherwise(0.0).alias("power"), -F.col("k"))).alias("_k"))
    return top.select(*by, (F.col("_k") * sample_hz / F.col("_n")).alias("psd_peak_hz"))


def population(df: DataFrame, by: list[str], frame: str, value: str, how: str = "mean") -> DataFrame:
    """Mean or median response of the selected members at each frame, with their number."""
    agg = {"mean": F.avg, "median": F.median}[how]
    return df.groupBy(*by, frame).agg(agg(value).alias("response"), F.count("*").alias("members"))


def equal_rows(df: DataFrame, by: list[str], row: str = "rn") -> DataFrame:
    """The first rows of each group, as many as the smallest group has."""
    least = df.groupBy(*by).agg(F.max(row).alias("_n")).agg(F.min("_n").alias("_n"))
    # one row, so this is a filter by a value
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(least.withColumn("_k", F.lit(1))), "_k").where(F.col(row) <= F.col("_n")).drop("_k", "_n")


def equal_parts(df: DataFrame, by: list[str], part: str, row: str = "rn") -> DataFrame:
    """The first rows of each group under each label of part, as many as the group with fewest rows has under it."""
    marked = df.withColumn("_row", F.row_number().over(Window.partitionBy(*by, part).orderBy(row)))
    least = df.groupBy(*by, part).agg(F.count("*").alias("_n")).groupBy(part).agg(F.min("_n").alias("_n"))
    # one row for each label
    return marked.join(F.broadcast(least), part).where("_row <= _n").drop("_row", "_n")


def confidence(q: str, test_r: str, stable: str, agreement: str, split_p: str, late_r: str, alpha: float = 0.05) -> Column:
    """Four classes of evidence for a response field; nulls never count as evidence."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    model = yes(F.col(q) < alpha) & yes(F.col(test_r) > 0)
    high = model & yes(F.col(stable)) & yes(F.col(agreement) > 0) & yes(F.col(split_p) < alpha)
    low = yes(F.col(agreement) > 0) & yes(F.col(late_r) > 0)
    return F.when(high, "HIGH_CONFIDENCE_RESPONSIVE").when(model, "MODERATE_CONFIDENCE").when(low, "LOW_CONFIDENCE").otherwise("NO_DETECTABLE_RF")


def responsive(p: str, projection_r: str, agreement: str, zeros: str, alpha: float = 0.05, least_r: float = 0.0, least_agreement: float = 0.0, most_zeros: float = 0.2) -> Column:
    """Selection rule of training reliability; the thresholds are parameters."""
    return F.coalesce((F.col(p) < alpha) & (F.col(projection_r) > least_r) & (F.col(agreement) > least_agreement) & (F.col(zeros) < most_zeros), F.lit(False))


def ridge_1d(df: DataFrame, by: list[str], y: str, x: str, alpha: float) -> DataFrame:
    """Closed-form slope and intercept of one penalised predictor."""
    slope = F.covar_pop(x, y) / (F.var_pop(x) + alpha)
    return df.groupBy(*by).agg(slope.alias("b1"), (F.avg(y) - slope * F.avg(x)).alias("intercept"))


def ridge_2d(df: DataFrame, by: list[str], y: str, x1: str, x2: str, alpha: float) -> DataFrame:
    """Closed-form slopes and intercept of two penalised predictors."""
    a, b, c = F.var_pop(x1) + alpha, F.covar_pop(x1, x2), F.var_pop(x2) + alpha
    u, v = F.covar_pop(x1, y), F.covar_pop(x2, y)
    det = a * c - b * b
    b1, b2 = (u * c - v * b) / det, (v * a - u * b) / det
    return df.groupBy(*by).agg(b1.alias("b1"), b2.alias("b2"), (F.avg(y) - b1 * F.avg(x1) - b2 * F.avg(x2)).alias("intercept"))


def predict_lagged(df: DataFrame, parameters: DataFrame, x: str = "x") -> DataFrame:
    """predicted for each row and roi: weights times the row's lags, plus the intercept. parameters is a table of models."""
    terms = F.aggregate(F.zip_with(x, "weights", lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
    pairs = df.withColumn("_k", F.lit(1)).join(F.broadcast(parameters.withColumn("_k", F.lit(1))), "_k").drop("_k")
    return pairs.withColumn("predicted", terms + F.col("intercept"))


def covariance_kernel(df: DataFrame, by: list[str], vector: str, y: str) -> DataFrame:
    """(by, i, k): covariance of each vector entry with the response."""
    long = df.select(*by, F.col(y).cast("double").alias("_y"), F.posexplode(vector).alias("i", "_x"))
    return long.groupBy(*by, "i").agg(F.covar_pop(F.col("_x").cast("double"), "_y").alias("k"))


def peak(kernel: DataFrame, by: list[str], pixels: int, digits: int = 9) -> DataFrame:
    """The pixel with the most squared kernel over bins, the first of equals."""
    energy = kernel.groupBy(*by, (F.col("i") % pixels).cast("long").alias("pixel")).agg(F.round(F.sum(F.col("k") * F.col("k")), digits).alias("energy"))
    return energy.groupBy(*by).agg(F.max_by("pixel", F.struct("energy", -F.col("pixel"))).alias("pixel"), F.max("energy").alias("energy"))
