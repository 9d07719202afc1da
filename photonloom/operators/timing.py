"""How a frozen model's fit depends on an offset between the clocks of frames and updates.

Frames and updates are shuffled once, by stretch of time. An update goes to every stretch whose frames can
reach it under some offset, and each stretch also gets the last update before those. A task looks up all
offsets of its frames among its updates and returns sums; no row is copied for an offset.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonloom.functions.exprs import finite
from photonloom.operators.clocks import DAY_US, asof

_SUMS = ("n", "sy", "syy")
_ARRAYS = ("sx", "sxy", "sxx")


def neighbours(frames: DataFrame, updates: DataFrame, offsets_us: Iterable[int], by: list[str], t: str, width: int) -> tuple[DataFrame, DataFrame]:
    """frames and updates with _part, such that a frame's update under any offset lies in its own part."""
    low, high = min(offsets_us), max(offsets_us)
    part = lambda x: F.floor(x / width)
    placed = frames.withColumn("_part", part(F.col(t)))
    spread = updates.withColumn("_part", F.explode(F.sequence(part(F.col(t) - high), part(F.col(t) - low))))
    # of the updates that lie before all of a part, its last one
    row = F.struct(*[F.col(c) for c in [t, *[c for c in updates.columns if c != t]]])
    last = updates.groupBy(*by, part(F.col(t) - low).alias("_part")).agg(F.max(row).alias("_last"))
    parts = placed.select(*by, "_part").distinct().join(last, [*by, "_part"], "full_outer")
    before = F.last("_last", True).over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = parts.select("_part", before.alias("_before")).where("_before is not null").select("_part", "_before.*").select(*updates.columns, "_part")
    both = spread.unionByName(carried)
    # frames and updates may come of one table; new names keep their columns apart
    return placed, both.select(*[F.col(c).alias(c) for c in both.columns])


def offset_sums(frames: DataFrame, updates: DataFrame, offsets_us: list[int], by: list[str], t: str = "t", width: int = DAY_US) -> DataFrame:
    """Sums for each group of by, part, response and offset, from one shuffle.

    frames: by, t, part, y (array, an entry for each response). updates: by, t, x, for each response an array of
    its regressors, all of one length. The update of a frame is the last one at or before its time plus the
    offset; a frame without one, or whose update has no x, is left out.
    """
    keys = [*by, "_part"]
    placed, spread = neighbours(frames.select(*by, t, "part", "y"), updates.select(*by, t, "x"), offsets_us, by, t, width)
    names = [*by, "part", "response", "offset_us", *_SUMS, *_ARRAYS]

    def run(key: tuple, f: pd.DataFrame, u: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        known = u["x"].notna().to_numpy() if len(u) else np.empty(0, bool)
        if len(f) and known.any():
            order = np.argsort(u[t].to_numpy(), kind="stable")
            ut, known = u[t].to_numpy()[order], known[order]
            x = np.array([[list(r) for r in v] for v in u["x"].iloc[order[known]]], float)
            place = np.cumsum(known) - 1
            for part, g in f.groupby("part", sort=True):
                ft, y = g[t].to_numpy(), np.array([list(v) for v in g["y"]], float)
                for offset in offsets_us:
                    at = np.searchsorted(ut, ft + offset, side="right") - 1
                    met = (at >= 0) & known[at]
                    own, yo = x[place[at[met]]], y[met]
                    sy, syy, sx = yo.sum(0), (yo * yo).sum(0), own.sum(0)
                    sxy, sxx = np.einsum("trl,tr->rl", own, yo), np.einsum("trl,trm->rlm", own, own).reshape(y.shape[1], -1)
                    out += [[*key[: len(by)], part, r, offset, len(own), sy[r], syy[r], sx[r].tolist(), sxy[r].tolist(), sxx[r].tolist()] for r in range(y.shape[1])]
        return pd.DataFrame(out, columns=names)

    kinds = [f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in [*by, "part"]]
    schema = ", ".join([*kinds, "response int, offset_us long, n long, sy double, syy double", *[f"{c} array<double>" for c in _ARRAYS]])
    return placed.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(run, schema)


def _total(sums: DataFrame, by: list[str], lags: int) -> DataFrame:
    entries = {"sx": lags, "sxy": lags, "sxx": lags * lags}
    return sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _SUMS], *[F.array(*[F.sum(F.col(c)[k]) for k in range(n)]).alias(c) for c, n in entries.items()])


def _centred(x: str) -> Column:
    mean = F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / F.size(x)
    return F.transform(x, lambda v: v - mean)


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def reverse_models(sums: DataFrame, by: list[str], lags: int) -> DataFrame:
    """(by, response, kernel, bias) from offset_sums() at one offset: the covariance kernel, scaled and shifted to fit the responses best."""
    n, entries = F.col("n"), [(i, k) for i in range(lags) for k in range(lags)]
    total = _total(sums, [*by, "response"], lags).withColumn("k", F.zip_with("sxy", "sx", lambda xy, x: (xy - x * F.col("sy") / n) / n))
    power = sum((F.col("k")[i] * F.col("k")[k] * (F.col("sxx")[i * lags + k] - F.col("sx")[i] * F.col("sx")[k] / n) / n for i, k in entries), F.lit(0.0))
    gain = F.when(power > 0, _dot("k", "k") / power).otherwise(0.0)
    fitted = total.withColumn("gain", gain).withColumn("kernel", F.transform("k", lambda v: v * F.col("gain")))
    return fitted.select(*by, "response", "kernel", ((F.col("sy") - _dot("kernel", "sx")) / n).alias("bias"))


def offset_scores(frames: DataFrame, updates: DataFrame, models: DataFrame, offsets_us: list[int], by: list[str], lags: int, t: str = "t", width: int = DAY_US) -> DataFrame:
    """One row for each group of by, response and offset, under frozen models (by, response, kernel, bias).

    n, r and r2 are of the model on the frames of part test, from their sums. filter_strength is the norm of
    the covariance kernel of part first, split_half_r its correlation over lags with that of part second, 0
    where one of them is flat. Frames are as in offset_sums(); part is first, second or test.
    """
    keys = [*by, "response", "offset_us"]
    whole = _total(offset_sums(frames, updates, offsets_us, by, t, width), [*keys, "part"], lags)
    n, sy, bias = F.col("n"), F.col("sy"), F.col("bias")
    # sums of the prediction less its bias
    sp, syp = _dot("kernel", "sx"), _dot("kernel", "sxy")
    spp = sum((F.col("kernel")[i] * F.col("kernel")[k] * F.col("sxx")[i * lags + k] for i in range(lags) for k in range(lags)), F.lit(0.0))
    error = F.col("syy") - 2 * F.col("syp") - 2 * bias * sy + F.col("spp") + 2 * bias * F.col("sp") + n * bias * bias
    tiny = lambda v, s: F.when(v > 1e-12 * s, v)
    vy, vp = tiny(F.col("syy") - sy**2 / n, F.col("syy")), tiny(F.col("spp") - F.col("sp") ** 2 / n, F.col("spp"))
    test = whole.where("part = 'test'").join(models.select(*by, "response", "kernel", "bias"), [*by, "response"]).withColumns({"sp": sp, "syp": syp, "spp": spp})
    test = test.select(*keys, "n", ((F.col("syp") - sy * F.col("sp") / n) / F.sqrt(vy * vp)).alias("r"), (1 - error / vy).alias("r2"))
    kernel = F.zip_with("sxy", "sx", lambda xy, x: (xy - x * sy / n) / n)
    of = lambda part: whole.where(F.col("part") == part).select(*keys, kernel.alias(part))
    halves = of("first").join(of("second"), keys).withColumns({"a": _centred("first"), "b": _centred("second")})
    size = F.sqrt(_dot("a", "a") * _dot("b", "b"))
    halves = halves.select(*keys, F.sqrt(_dot("first", "first")).alias("filter_strength"), F.when(size > 0, _dot("a", "b") / size).otherwise(0.0).alias("split_half_r"))
    return test.join(halves, keys, "left")


def timing_sensitivity(scores: DataFrame, by: list[str], digits: int | None = None) -> DataFrame:
    """Medians over responses of offset_scores() for each group of by and offset, and the number of responses with r above zero."""
    held = lambda c: F.round(c, digits) if digits is not None else F.col(c)
    return scores.groupBy(*by, "offset_us").agg(
        F.median(finite(held("r"))).alias("median_test_r"),
        F.median(finite(held("r2"))).alias("median_test_r2"),
        F.count_if(held("r") > 0).alias("positive_r_count"),
        F.median(held("filter_strength")).alias("median_filter_strength"),
        F.median(held("split_half_r")).alias("median_split_half_r"),
    )


def check_zero_offset(frames: DataFrame, updates: DataFrame, models: DataFrame, saved: str, by: list[str], tolerance: float = 1e-10, t: str = "t", width: int = DAY_US) -> None:
    """Raise unless the models give at offset zero the predictions that the test frames have in the column saved (an array)."""
    found = asof(frames.where("part = 'test'").select(*by, t, saved), updates.select(*by, t, "x"), by, ["x"], t, width)
    pairs = found.select(*by, F.posexplode(F.arrays_zip(F.col(saved).alias("s"), F.coalesce("x", F.array()).alias("x"))).alias("response", "_p")).join(models, [*by, "response"])
    gap = F.abs(F.aggregate(F.zip_with("_p.x", "kernel", lambda x, k: x * k), F.col("bias"), lambda a, v: a + v) - F.col("_p.s"))
    odd = pairs.where(~F.coalesce(gap <= tolerance, F.lit(False))).limit(3).collect()
    if odd:
        raise ValueError(f"Zero-offset replay differs from the saved prediction: {odd}")
