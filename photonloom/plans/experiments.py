"""The experiment matrix: targets, models by folds, replay checks, roll-ups and diagnostics."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonloom.operators import baseline, history, linear, scores
from photonloom.operators.clocks import ranked
from photonloom.operators.linear import Fit, Sessions
from photonloom.operators.moments import moments
from photonloom.operators.stretches import ROWS

#: Families of one response kind: how they are fitted, and whether responses are scaled by their training rows first.
MODELS: dict[str, tuple[Callable[[Sessions, int], Fit], bool]] = {
    "individual_ridge": (lambda s, bins: linear.individual_ridge(s), True),
    "individual_ridge_raw_units": (lambda s, bins: linear.individual_ridge(s), False),
    "individual_pixel": (linear.individual_pixel, True),
    "sta": (linear.sta, True),
    "shared_kernel": (lambda s, bins: linear.shared_kernel(s), True),
    "shared_kernel_raw_units": (lambda s, bins: linear.shared_kernel(s), False),
    "shared_kernel_equal_response": (lambda s, bins: linear.shared_kernel(s, weighting="equal_response"), True),
    "hierarchical": (lambda s, bins: linear.hierarchical(s, linear.shared_kernel(s)), True),
    "low_rank": (lambda s, bins: linear.low_rank(s, linear.individual_ridge(s), bins), True),
}
#: Families whose response kind is chosen by the shared kernel's validation rows within the fold.
SELECTED: dict[str, Callable[[Sessions, int], Fit]] = {
    "shared_kernel_selected_response": lambda s, bins: linear.shared_kernel(s),
    "individual_ridge_selected_response": lambda s, bins: linear.individual_ridge(s),
}
RECORD = "fold string, model string, response_kind string, session string, response int, r double, r2 double, mse double, nmse double"
CANDIDATES = ("raw", "ema_residual", "ema_dff")


def process_target(df: DataFrame, by: list[str], kind: str, history_rows: int, split: Column, normalization: str = "zscore", row: str = "rn", **options) -> DataFrame:
    """Response transform over the whole trace, then eligibility, then the training scaler, in this order.

    A baseline warms up on rows that have no full history yet, so eligibility comes after it.
    """
    whole = baseline.candidate(df, by, kind, **options)
    kept = history.eligible(whole, history_rows, row).withColumn("split", split)
    return scores.scale(kept, scores.scaler(kept, by, "response", normalization=normalization), by, "response")


def sessions_of(rows: DataFrame) -> Sessions:
    """Moments by session and split of rows (session, split, x, y); purged and unused rows are left out."""
    out: Sessions = {}
    for (s, split), m in sorted(moments(rows.where("split in ('train', 'validation', 'test')"), ["session", "split"]).items()):
        out.setdefault(s, {})[split] = m
    return out


def with_candidates(rows: DataFrame, by: list[str], t: str, tau_seconds: float, row: str = "rn") -> DataFrame:
    """rows with y widened to all responses under each kind of CANDIDATES, one kind after the other; the baseline is found once.

    A baseline is of a response's whole trace, in the order of row.
    """
    long = rows.select(*by, row, t, F.posexplode("y").alias("_r", "_v"))
    found = baseline.ema_baseline(long, [*by, "_r"], tau_seconds, t, "_v", row)
    rest = F.col("_v") - F.col("baseline")
    kinds = F.struct(F.col("_r").alias("r"), F.col("_v").cast("double").alias("raw"), rest.alias("ema_residual"), (rest / F.greatest("baseline", F.lit(1.0))).alias("ema_dff"))
    # as many entries as a session has responses
    wide = found.groupBy(*by, row).agg(F.array_sort(F.collect_list(kinds)).alias("_k"))
    y = F.concat(*[F.col(f"_k.{c}") for c in CANDIDATES])
    return rows.drop("y").join(wide.select(*by, row, y.alias("y")), [*by, row])


def of_kind(sessions: Sessions, kind: str, scaled: bool) -> Sessions:
    """Moments of one kind's responses, scaled by their training rows if wanted; a constant response keeps scale 1."""
    out: Sessions = {}
    for s, parts in sessions.items():
        size = len(parts["train"].sy) // len(CANDIDATES)
        which = [CANDIDATES.index(kind) * size + r for r in range(size)]
        own = {name: m.responses(which) for name, m in parts.items()}
        center, spread = own["train"].my, np.sqrt(np.maximum(own["train"].variance, 0))
        out[s] = {name: m.rescaled(center, np.where(spread < 1e-8, 1.0, spread)) for name, m in own.items()} if scaled else own
    return out


def selected_kind(sessions: Sessions, kinds: tuple[str, ...] = CANDIDATES) -> tuple[str, dict[str, float]]:
    """The kind under which a shared kernel predicts validation rows best, the first of equal ones, and all kinds' median r2."""
    found = {}
    for kind in kinds:
        own = of_kind(sessions, kind, True)
        train = {s: p["train"] for s, p in own.items()}
        trials = []
        for a in linear.ALPHAS:
            k, g, b = linear.shared_direction(train, a)
            trials.append(linear.median_r2([p["validation"].scores(np.outer(k, g[s]), b[s])["r2"] for s, p in own.items()]))
        found[kind] = max(trials)
    return max(found, key=found.get), found


def run_matrix(rows: DataFrame, folds: dict[str, Column], bins: int, models: tuple[str, ...] = (*MODELS, *SELECTED)) -> DataFrame:
    """Test records of models by folds. rows have session, x and y, widened by with_candidates(); a fold is a column that labels the split.

    Each fold's moments, of all response kinds, are summed once by Spark and serve all of its models.
    """
    out = []
    for fold, label in folds.items():
        sessions = sessions_of(rows.withColumn("split", label))
        best = selected_kind(sessions)[0] if set(models) & set(SELECTED) else None
        for m in models:
            build, scaled = MODELS.get(m) or (SELECTED[m], True)
            kind = best if m in SELECTED else "raw"
            own = of_kind(sessions, kind, scaled)
            out += [r | {"fold": fold, "model": m, "response_kind": kind} for r in linear.records(own, build(own, bins))]
    names = [c.split()[0] for c in RECORD.split(", ")]
    return rows.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in out], RECORD)


def candidate_summary(rows: DataFrame, shares: tuple[float, float] = (0.35, 0.7), row: str = "rn", n: str = "n") -> DataFrame:
    """(session, candidate, median_split_half_kernel_r, median_late_projection_r, positive_late_projection_count) of rows as in run_matrix().

    All kinds and both early halves and the late rest are summed in one scan.
    """
    part = F.when(F.col(row) <= F.floor(F.col(n) * shares[0]), "first").when(F.col(row) <= F.floor(F.col(n) * shares[1]), "second").otherwise("late")
    found: dict[str, dict] = {}
    for (s, p), m in sorted(moments(rows.withColumn("_part", part), ["session", "_part"]).items()):
        found.setdefault(s, {})[p] = m
    out = []
    for s, parts in found.items():
        size = len(parts["first"].sy) // len(CANDIDATES)
        for k, kind in enumerate(CANDIDATES):
            which = list(range(k * size, (k + 1) * size))
            first, second, late = (parts[p].responses(which) for p in ("first", "second", "late"))
            a, b = first.cross - first.cross.mean(axis=0), second.cross - second.cross.mean(axis=0)
            norm = np.sqrt((a * a).sum(axis=0) * (b * b).sum(axis=0))
            agreement = np.divide((a * b).sum(axis=0), norm, out=np.zeros(size), where=norm > 0)
            r = np.nan_to_num(late.scores(first.cross, np.zeros(size))["r"])
            out.append((s, kind, float(np.median(agreement)), float(np.median(r)), int((r > 0).sum())))
    return rows.sparkSession.createDataFrame(out, "session string, candidate string, median_split_half_kernel_r double, median_late_projection_r double, positive_late_projection_count int")


def registry_rows(records: DataFrame, stamp: str | None = None) -> DataFrame:
    """One registry row for each fold and model."""
    stamp = stamp or datetime.now(UTC).isoformat()
    own = records.groupBy("fold", "model").agg(F.median("r2").alias("median_r2"), F.avg((F.col("r2") > 0).cast("double")).alias("fraction_positive_r2"), F.count("*").alias("rois"), F.count_distinct("session").alias("flies"))
    return own.withColumns({"experiment_id": F.concat_ws("/", "fold", "model"), "created_at": F.lit(stamp)})


def replay_differences(saved: DataFrame, current: DataFrame, keys: list[str], value: str = "predicted", tolerance: float = 1e-9) -> DataFrame:
    """Keys that one side lacks, or whose values differ by more than the tolerance, absolute and relative."""
    pairs = saved.select(*keys, F.col(value).alias("saved")).join(current.select(*keys, F.col(value).alias("current")), keys, "full_outer")
    return pairs.where(F.coalesce(F.abs(F.col("saved") - F.col("current")) > tolerance + tolerance * F.abs("current"), F.lit(True)))


def verify_replay(saved: DataFrame, current: DataFrame, keys: list[str], value: str = "predicted", tolerance: float = 1e-9) -> None:
    odd = replay_differences(saved, current, keys, value, tolerance).limit(3).collect()
    if odd:
        raise ValueError(f"Replayed values differ from saved ones: {odd}")


def validation_rollup(df: DataFrame, least_validation: float = 0.05, alpha: float = 0.05) -> DataFrame:
    """Counts of responses by validation r2, test r2 and q."""
    chosen = F.col("validation_r2") > least_validation
    return df.agg(
        F.count("*").alias("responses"),
        F.count_if(chosen).alias("validation_selected"),
        F.count_if(chosen & (F.col("test_r2") > 0)).alias("selected_test_positive"),
        F.count_if((F.col("test_r2") > 0) & (F.col("q") < alpha)).alias("test_positive_and_q"),
    )


def dataset_diagnostics(df: DataFrame, by: list[str], roi: str, value: str = "value", row: str = "rn") -> DataFrame:
    """Rows, ROIs, the median training spread and the median drift from first to last quarter of each session's training rows.

    Training rows are one block of places; a quarter has at least one. A ROI without rows in one of the
    quarters has no drift, and a session without training rows has neither spread nor drift.
    """
    train = F.when(F.col("split") == "train", F.col(value))
    blocks = df.where("split = 'train'").groupBy(*by).agg(F.min(row).alias("_first"), F.max(row).alias("_last"))
    quarter = F.greatest(F.lit(1), F.floor((F.col("_last") - F.col("_first") + 1) / 4))
    late = F.avg(F.when(F.col(row) > F.col("_last") - quarter, train))
    early = F.avg(F.when(F.col(row) < F.col("_first") + quarter, train))
    own = df.join(blocks, by, "left").groupBy(*by, roi).agg(F.count("*").alias("_rows"), F.stddev_pop(train).alias("_spread"), (late - early).alias("_drift"))
    return own.groupBy(*by).agg(F.sum("_rows").alias("observations"), F.count("*").alias("rois"), F.median("_spread").alias("median_train_sd"), F.median("_drift").alias("median_drift"))


def fold_labels(history_rows: int, shares: dict[str, tuple[float, float, float]], row: str = "rn", n: str = "n") -> dict[str, Column]:
    """Folds by shares of a session's rows: train end, validation end and test end, history-1 rows purged between."""
    out = {}
    for name, (a, b, c) in shares.items():
        r, at = F.col(row) - 1, lambda share: F.floor(F.col(n) * share)
        gap = history_rows - 1
        out[name] = F.when(r < at(a), "train").when(r < at(a) + gap, "purge").when(r < at(b), "validation").when(r < at(b) + gap, "purge").when(r < at(c), "test").otherwise("unused")
    return out


def guarded(df: DataFrame, most_rows: int) -> list:
    """collect(), unless df has more rows than that."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise MemoryError(f"more than {most_rows} rows")
    return rows


def numbered(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """df with rn and n of each session, by an order of whole numbers, in stretches of 4096 of them."""
    return ranked(df.drop("rn", "n"), by, order, order, ROWS)

