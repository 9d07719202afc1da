"""The pixel model's report: where each response looks, how well it is predicted, and what chance would give."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from photonloom.operators import linear, significance
from photonloom.operators.moments import moments
from photonloom.plans.reliability import projected

_FACTS = (
    "session string, response int, pixel_row int, pixel_col int, fly_side_row int, fly_side_col int, validation_row int, validation_col int, pixel_stable boolean, "
    "penalty double, validation_r2 double, test_r double, test_r2 double, constant_baseline_test_r2 double, peak_lag int, kernel array<double>, center double"
)


def _finite(v: float) -> float | None:
    return float(v) if np.isfinite(v) else None


def pixel_report(rows: DataFrame, bins: int, width: int, exclusion: int, alphas: tuple[float, ...] = linear.ALPHAS, kernels: bool = False) -> DataFrame:
    """One row for each response of rows (session, rn, split, x, y); x has bins stretches of pixels in rows of width.

    The pixel is chosen on training rows, the penalty on validation rows; both are fitted together and
    scored on test rows, beside a constant, the mean of the fitted rows. pixel_stable tells whether
    validation rows would choose the same pixel; the fly side sees rows and columns flipped. peak_lag is the
    bin of the largest coefficient. The p of the test prediction is among its circular shifts, its q over
    all responses. A response without variance has null scores and p. With kernels the coefficients and
    the center of each response are columns too.
    """
    sessions: dict = {}
    for (s, split), m in sorted(moments(rows.where("split in ('train', 'validation', 'test')"), ["session", "split"]).items()):
        sessions.setdefault(s, {})[split] = m
    fit = linear.individual_pixel(sessions, bins, alphas)
    facts = []
    for s, parts in sessions.items():
        tall = len(parts["train"].sx) // bins // width
        test, mean = parts["test"].scores(fit.beta[s], fit.bias[s]), linear.refit(parts).my
        flat = parts["test"].scores(np.zeros_like(fit.beta[s]), mean)["r2"]
        for r, (own, late) in enumerate(zip(fit.extra["pixels"][s], fit.extra["validation_pixels"][s])):
            at, then = divmod(int(own), width), divmod(int(late), width)
            flipped = tall - 1 - at[0], width - 1 - at[1]
            lag = int(np.argmax(np.abs(fit.beta[s][:, r].reshape(bins, -1)[:, own])))
            scored = [_finite(v) for v in (fit.extra["validation_r2"][s][r], test["r"][r], test["r2"][r], flat[r])]
            facts.append((s, r, *at, *flipped, *then, at == then, float(fit.chosen[s][r]), *scored, lag, fit.beta[s][:, r].tolist(), float(-fit.bias[s][r])))
    facts_df = rows.sparkSession.createDataFrame(facts, _FACTS)
    held = projected(rows.where("split = 'test'"), F.broadcast(facts_df.select("session", "response", "kernel", "center")))  # one row for each response
    p = significance.circular_shift(held, ["session", "response"], "y", "projection", exclusion)
    out = (facts_df if kernels else facts_df.drop("kernel", "center")).join(p, ["session", "response"], "left").withColumn("_tie", F.concat_ws("/", "session", "response"))
    return significance.benjamini_hochberg(out, "p", "_tie").drop("_tie").withColumnsRenamed({"p": "shift_null_p", "q": "shift_null_q"})


def example_response(rows: DataFrame, report: DataFrame, bins: int, step: float, seconds: float = 20.0) -> tuple[Row, list[float], DataFrame]:
    """The response that validation rows predict best: its row of a report with kernels, the weights of its pixel
    by bin, and (seconds, y, projection) of the first seconds of its test rows, step seconds apart.

    Responses without a score count last, ties go to the first session and response; an empty report is an error.
    """
    best = report.orderBy(F.desc_nulls_last("validation_r2"), "session", "response").first()
    if best is None:
        raise ValueError("the report has no response")
    own = report.where((F.col("session") == best.session) & (F.col("response") == best.response)).select("session", "response", "kernel", "center")
    test = projected(rows.where((F.col("split") == "test") & (F.col("session") == best.session)), F.broadcast(own))
    start = test.agg(F.min("rn")).first()[0]
    trace = test.select(((F.col("rn") - F.lit(start)) * step).alias("seconds"), "y", "projection").where(F.col("seconds") <= seconds)
    kernel = np.array(best.kernel).reshape(bins, -1)
    return best, kernel[:, np.abs(kernel).max(axis=0).argmax()].tolist(), trace
