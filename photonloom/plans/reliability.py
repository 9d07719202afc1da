"""Training reliability, response-field quality and the common-mode control, composed from the operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonloom.functions.exprs import dot, pearson
from photonloom.operators import linear, scores, significance
from photonloom.operators.moments import Moments, moments

EARLY_HALF, EARLY_END = 0.35, 0.7


def _kernel_table(like: DataFrame, groups: dict[str, Moments]) -> DataFrame:
    """(session, response, kernel, center): the covariance kernel of each response; one row for each."""
    rows = [(s, r, m.cross[:, r].tolist(), float(m.mx @ m.cross[:, r])) for s, m in groups.items() for r in range(m.cross.shape[1])]
    return like.sparkSession.createDataFrame(rows, "session string, response int, kernel array<double>, center double")


def projected(rows: DataFrame, kernels: DataFrame) -> DataFrame:
    """(session, response, rn, y, projection) of rows (session, rn, x, y)."""
    long = rows.select("session", "rn", "x", F.posexplode("y").alias("response", "y"))
    return long.join(kernels, ["session", "response"]).select("session", "response", "rn", "y", (dot("x", "kernel") - F.col("center")).alias("projection"))


def _corr(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a - a.mean(axis=0), b - b.mean(axis=0)
    size = np.sqrt((a * a).sum(axis=0) * (b * b).sum(axis=0))
    return np.divide((a * b).sum(axis=0), size, out=np.zeros(a.shape[1]), where=size > 0)


def training_reliability(rows: DataFrame, bins: int, width: int, exclusion: int = 30, tolerance: int = 1, alpha: float = 0.05, most_zeros: float = 0.2) -> DataFrame:
    """Split-half evidence for each response of rows (session, rn, split, x, y), without any test row.

    The first half of the training rows gives a kernel; the second half gives a kernel to compare, and a
    projection to correlate and to shift. A response is selected by scores.responsive. Pixels lie in rows
    of width; the validation peak is stable if it lies at most tolerance rows and columns away.
    """
    sizes = rows.where("split = 'train'").groupBy("session").agg(F.floor(F.count("*") / 2).alias("_half"), F.min("rn").alias("_from"))
    part = F.when(F.col("split") == "validation", "validation").when(F.col("rn") < F.col("_from") + F.col("_half"), "first").otherwise("second")
    parts = rows.where("split in ('train', 'validation')").join(sizes, "session").withColumn("part", part)
    found = moments(parts, ["session", "part"])
    first, second, late = ({s: m for (s, p), m in found.items() if p == name} for name in ("first", "second", "validation"))
    if not first or set(first) != set(second) or set(first) != set(late):
        raise ValueError("each session needs two halves of training rows, and validation rows")
    kernels = _kernel_table(rows, first)
    own = []
    for s, m in first.items():
        agreement = _corr(m.cross, second[s].cross)
        near, far = linear.peak_pixels(m, bins), linear.peak_pixels(late[s], bins)
        stable = (np.abs(near // width - far // width) <= tolerance) & (np.abs(near % width - far % width) <= tolerance)
        own += [(s, r, float(agreement[r]), int(near[r] // width), int(near[r] % width), bool(stable[r])) for r in range(len(near))]
    facts = rows.sparkSession.createDataFrame(own, "session string, response int, split_half_kernel_r double, peak_row int, peak_col int, validation_pixel_stable boolean")
    by = ["session", "response"]
    held = projected(parts.where("part = 'second'"), kernels)
    r_of = lambda df, name: df.groupBy(*by).agg(F.coalesce(pearson("y", "projection"), F.lit(0.0)).alias(name))
    p = significance.circular_shift(held, by, "y", "projection", exclusion).withColumnRenamed("p", "train_shift_null_p")
    zeros = parts.where("part = 'first'").select("session", F.posexplode("y").alias("response", "y")).groupBy(*by).agg(F.avg((F.col("y") == 0).cast("double")).alias("train_zero_fraction"))
    out = facts.join(r_of(held, "train_projection_r"), by).join(p, by).join(zeros, by).join(r_of(projected(parts.where("part = 'validation'"), kernels), "validation_projection_r"), by)
    return out.withColumn("train_defined_responsive", scores.responsive("train_shift_null_p", "train_projection_r", "split_half_kernel_r", "train_zero_fraction", alpha, most_zeros=most_zeros))


def field_quality(rows: DataFrame, pixel: DataFrame, bins: int, width: int, exclusion: int = 30, alpha: float = 0.05) -> DataFrame:
    """Repeatability and confidence class of each response of rows (session, rn, n, x, y).

    Two halves of the early rows give kernels, the late rows a projection. pixel has (session, response,
    q, test_r, stable) of a fitted pixel model where there is one; its values are descriptive.
    """
    part = F.when(F.col("rn") <= F.floor(F.col("n") * EARLY_HALF), "first").when(F.col("rn") <= F.floor(F.col("n") * EARLY_END), "second").otherwise("late")
    parts = rows.withColumn("part", part)
    found = moments(parts.where("part <> 'late'"), ["session", "part"])
    first, second = ({s: m for (s, p), m in found.items() if p == name} for name in ("first", "second"))
    kernels = _kernel_table(rows, first)
    own = []
    for s, m in first.items():
        agreement, peak = _corr(m.cross, second[s].cross), linear.peak_pixels(m, bins)
        own += [(s, r, float(agreement[r]), linear.rank_one(m.cross[:, r], bins)[1], int(peak[r] // width), int(peak[r] % width)) for r in range(len(peak))]
    facts = rows.sparkSession.createDataFrame(own, "session string, response int, split_half_kernel_r double, rank_one_energy_fraction double, peak_row int, peak_col int")
    by = ["session", "response"]
    p = significance.circular_shift(projected(parts.where("part = 'second'"), kernels), by, "y", "projection", exclusion).withColumnRenamed("p", "split_half_p")
    late = projected(parts.where("part = 'late'"), kernels).groupBy(*by).agg(F.coalesce(pearson("y", "projection"), F.lit(0.0)).alias("late_projection_r"))
    out = facts.join(p, by).join(late, by).join(pixel.select(*by, "q", "test_r", "stable"), by, "left")
    return out.withColumn("rf_confidence", scores.confidence("q", "test_r", "stable", "split_half_kernel_r", "split_half_p", "late_projection_r", alpha))


def common_mode(rows: DataFrame, pixels: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Test r2 of the peers' median alone, and with a pixel's history, for each response.

    rows have (session, rn, split, x, y), y of two responses at least; pixels have (session, response,
    columns), the entries of x that a response's pixel model reads. Peers are the session's other responses
    at the same time, so this tells common signals from stimulus-driven ones; it is no stimulus model.
    """
    peers = F.array_sort(F.concat(F.slice("y", 1, F.col("response")), F.slice("y", F.col("response") + 2, F.size("y"))))
    k = F.size("_peers")
    mid = (F.element_at("_peers", F.floor((k + 1) / 2).cast("int")) + F.element_at("_peers", (F.floor(k / 2) + 1).cast("int"))) / 2
    long = rows.where("split in ('train', 'validation', 'test')").select("session", "rn", "split", "x", "y", F.posexplode("y").alias("response", "_own"))
    long = long.withColumn("_peers", peers).withColumn("peer", mid).join(pixels, ["session", "response"])
    fit = F.when(F.col("split") == "test", "test").otherwise("fit")
    scale = long.where("split <> 'test'").groupBy("session", "response").agg(F.avg("peer").alias("_m"), F.stddev_pop("peer").alias("_s"))
    z = (F.col("peer") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.raise_error(F.lit("constant median of the peers")))
    full = long.join(scale, ["session", "response"]).select("session", "response", fit.alias("part"), F.concat(F.array(z), F.transform("columns", lambda c: F.element_at("x", c + 1).cast("double"))).alias("x"), F.array("_own").alias("y"))
    found = moments(full, ["session", "response", "part"])
    out = []
    for (s, r, p), m in sorted(found.items()):
        if p != "fit":
            continue
        r2 = {}
        for name, columns in (("peer", np.array([0])), ("both", np.arange(len(m.sx)))):
            beta, bias = linear.Ridge(m.picked(columns, 0)).fit(alpha)
            r2[name] = float(found[s, r, "test"].picked(columns, 0).scores(beta, bias)["r2"][0])
        out.append((s, r, r2["peer"], r2["both"], r2["both"] - r2["peer"]))
    return rows.sparkSession.createDataFrame(out, "session string, response int, peer_median_test_r2 double, pixel_plus_peer_test_r2 double, incremental_r2 double")
