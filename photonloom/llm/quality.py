"""Robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Counting runs inside tasks. The estimates are made by Spark over all rows, for all rows together, for each
language and for each language and source. A concentration step is one scan: rows are binned by their
distance, each bin sums its first and second moments, and the bins up to the group's quantile give the
next estimate, so no group is ever gathered. Steps go on until no group's determinant falls any more;
of several starts the one with the smallest determinant counts. An estimate is then shrunk towards that
of the group above it, by PRIOR_ROWS rows, so groups of any size have their own.
"""

from __future__ import annotations

import functools
import warnings
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonloom.llm.common import as_id, as_text, hot_keys, join_split, staged

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
#: Least standard deviation of each transformed statistic, as most documents have no symbol or repeat at all.
FLOORS = (0.08, 0.12, 0.12, 0.25, 0.5)
D = len(FLOORS)
#: Share of a group's rows that an estimate is made from, and the largest distance of a kept document.
KEEP, CUTOFF = 0.5, 6.0
#: Rows that the estimate of the group above counts as.
PRIOR_ROWS = 50
#: Concentration ends when no group's log determinant falls by more than this any more, at the latest after so many steps.
TOLERANCE, MAX_STEPS = 0.02, 40
#: Distance bins for each factor of e, and the range of log squared distances that they cover.
BINS, LOW, HIGH = 32, -12.0, 16.0
STARTS = ("medians", "moments", "above")
#: Median of chi-square with D degrees of freedom.
CHI2_MEDIAN = 4.3515


def repeated_words(words: list, width: int = WINDOW) -> int:
    """Words within windows whose sequence is found twice or more."""
    grams = list(zip(*(words[k:] for k in range(width))))
    if len(set(grams)) == len(grams):
        return 0
    found = Counter(grams)
    hit = np.fromiter((found[g] > 1 for g in grams), bool, len(grams))
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """The counts named in COUNTS; a null text has none."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    return len(words), len(text) - without(SPACE), without(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), without(UPPER)


def with_statistics(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns keep, as strings, and the counts of each row's text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            counts = np.array([statistics(t) for t in x["_text"]], np.int64).reshape(len(x), len(COUNTS))
            yield x.drop(columns="_text").assign(**{c: counts[:, k] for k, c in enumerate(COUNTS)})

    kinds = [f"`{c}` string" for c in keep]
    return df.select(*[as_text(df, c).alias(c) for c in keep], F.col(text_col).alias("_text")).mapInPandas(run, ", ".join(kinds + [f"{c} long" for c in COUNTS]))


def transformed() -> list[Column]:
    """Log of the mean word length, then logs of shares; constants in the divisors steady short texts."""
    share = lambda n, of, more: F.log1p(20.0 * F.col(n) / (F.col(of) + more))
    return [F.log((F.col("word_chars") + 250.0) / (F.col("n_words") + 50.0)), share("n_symbols", "word_chars", 100.0), share("n_upper", "word_chars", 100.0), share("n_repeat_words", "n_words", 30.0), share("n_dup_lines", "n_lines", 3.0)]


_PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
_PARAMS = [f"m{i}" for i in range(D)] + [f"p{i}{j}" for i, j in _PAIRS]


def _distance() -> Column:
    """Squared Mahalanobis distance of z0.. from centre m0.. under precision p00.. of the joined group."""
    diff = [F.col(f"z{i}") - F.col(f"m{i}") for i in range(D)]
    return F.greatest(F.lit(0.0), sum((diff[i] * diff[j] * F.col(f"p{i}{j}") * (1.0 if i == j else 2.0) for i, j in _PAIRS), F.lit(0.0)))


def precision_row(centre: np.ndarray, cov: np.ndarray) -> dict:
    """Columns m and p of an estimate, with floors so that constant statistics leave it regular, and its log determinant."""
    cov = cov + np.diag(np.square(FLOORS))
    inverse = np.linalg.inv(cov)
    return {f"m{i}": centre[i] for i in range(D)} | {f"p{i}{j}": inverse[i, j] for i, j in _PAIRS} | {"logdet": float(np.linalg.slogdet(cov)[1])}


def concentrated(bins: list, keep: float) -> tuple[float, np.ndarray, np.ndarray, float]:
    """(rows, centre, covariance, median squared distance) of the nearest keep of a group's rows.

    bins are (bin, n, sums, products) by rising distance; the rows of the last bin count in proportion.
    """
    total = sum(b[1] for b in bins)
    want, n, sums, products, middle, seen = keep * total, 0.0, np.zeros(D), np.zeros(len(_PAIRS)), None, 0.0
    for at, size, s, q in sorted(bins, key=lambda b: b[0]):
        part = min(1.0, (want - n) / size)
        if part > 0:
            n, sums, products = n + part * size, sums + part * np.array(s), products + part * np.array(q)
        seen += size
        if middle is None and 2 * seen >= total:
            middle = float(np.exp((at + 0.5) / BINS + LOW))
    centre, cov = sums / n, np.empty((D, D))
    for k, (i, j) in enumerate(_PAIRS):
        cov[i, j] = cov[j, i] = products[k] / n - centre[i] * centre[j]
    return float(total), centre, cov, middle


_STEP = "grp string, start string, n double, " + ", ".join(f"{c} double" for c in [*_PARAMS, "logdet", "middle"]) + ", centre array<double>, cov array<double>"


def _step(keep: float) -> Callable:
    def run(x: pd.DataFrame) -> pd.DataFrame:
        n, centre, cov, middle = concentrated(list(zip(x["bin"], x["n"], x["sums"], x["products"])), keep)
        row = {"grp": x["grp"].iat[0], "start": x["start"].iat[0], "n": n, "middle": middle, "centre": centre.tolist(), "cov": cov.ravel().tolist()}
        return pd.DataFrame([row | precision_row(centre, cov)])[[c.split()[0] for c in _STEP.split(", ")]]

    return run


def binned(rows: DataFrame, params: DataFrame, hot: DataFrame) -> DataFrame:
    """(grp, start, bin, n, sums, products) of rows (grp, z0..) under params: at most BINS * (HIGH - LOW) rows for each estimate.

    hot has the groups of very many rows, such as that of all rows; they meet their params where they are.
    """
    # as many as there are ways to start
    own = params.groupBy("grp").agg(F.collect_list(F.struct("start", *_PARAMS)).alias("_own"))
    near = join_split(rows, own, "grp", hot).where("_own is not null").withColumn("_own", F.explode("_own")).select("grp", "_own.*", *[f"z{i}" for i in range(D)])
    at = F.floor((F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.log(_distance() + 1e-9))) - LOW) * BINS)
    near = near.select("grp", "start", at.alias("bin"), *[f"z{i}" for i in range(D)])
    sums = [F.sum(f"z{i}").alias(f"s{i}") for i in range(D)] + [F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"s{i}{j}") for i, j in _PAIRS]
    out = near.groupBy("grp", "start", "bin").agg(F.count("*").alias("n"), *sums)
    return out.select("grp", "start", "bin", "n", F.array(*[f"s{i}" for i in range(D)]).alias("sums"), F.array(*[f"s{i}{j}" for i, j in _PAIRS]).alias("products"))


def starts(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Params of each grp by each way to start: medians and their deviations, all moments, and the moments of all rows."""
    z, array = [f"z{i}" for i in range(D)], lambda cols: F.array(*cols)
    moments = [F.avg(c).alias(f"a{c}") for c in z] + [F.stddev_pop(c).alias(f"d{c}") for c in z]
    own = staged(rows.groupBy("grp").agg(array([F.percentile_approx(c, 0.5) for c in z]).alias("med"), *moments), "middles")
    spread = join_split(rows, own.select("grp", "med"), "grp", hot).groupBy("grp").agg(array([F.percentile_approx(F.abs(F.col(c) - F.col("med")[i]), 0.5) * 1.4826 for i, c in enumerate(z)]).alias("scale"))
    means, scales = array([f"a{c}" for c in z]), array([f"d{c}" for c in z])
    every = own.where("grp = '[]'").select(means.alias("means"), scales.alias("scales"))
    wide = own.join(spread, "grp").join(F.broadcast(every))  # one row, of all rows
    start = F.array(*[F.struct(F.lit(n).alias("start"), c.alias("c"), d.alias("d")) for n, c, d in zip(STARTS, (F.col("med"), means, F.col("means")), (F.col("scale"), scales, F.col("scales")))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame([{"grp": r.grp, "start": r.start} | precision_row(np.array(r.c), np.diag(np.square(r.d))) for r in x.itertuples()], columns=["grp", "start", *_PARAMS])

    return wide.select("grp", F.explode(start).alias("s")).select("grp", "s.*").mapInPandas(run, "grp string, start string, " + ", ".join(f"{c} double" for c in _PARAMS))


def estimates(rows: DataFrame, keep: float = KEEP) -> DataFrame:
    """(grp, n, centre, cov, middle, start, logdet, settled): of each grp, the concentrated estimate with the smallest determinant.

    Each start goes on until its determinant falls no more; settled ones are not scanned again. What still falls
    after MAX_STEPS steps is not settled and gives a warning.
    """
    hot = staged(hot_keys(staged(rows.groupBy("grp").agg(F.count("*").alias("n")), "sizes")).select("grp"), "hot")
    going, done, before = staged(starts(rows, hot), "params"), [], None
    for k in range(MAX_STEPS):
        found = staged(binned(rows, going, hot).groupBy("grp", "start").applyInPandas(_step(keep), _STEP), "step")
        old = F.lit(None).cast("double") if before is None else F.col("before")
        joined = found if before is None else found.join(before, ["grp", "start"], "left")
        settled = F.coalesce(old - F.col("logdet") <= TOLERANCE, F.lit(False))
        marked = joined.withColumn("settled", settled)
        going = marked.where("not settled").drop("settled", "before")
        last = k + 1 == MAX_STEPS
        done.append((marked if last else marked.where("settled")).drop("before"))
        if going.isEmpty():
            break
        if last:
            warnings.warn(f"{going.count()} estimates have not settled in {MAX_STEPS} steps", stacklevel=2)
            break
        before = going.select("grp", "start", F.col("logdet").alias("before"))
    every = functools.reduce(DataFrame.unionByName, done)
    order = F.struct("logdet", "start")
    return every.groupBy("grp").agg(*[F.min_by(c, order).alias(c) for c in ("n", "centre", "cov", "middle", "start", "logdet", "settled")])


def shrunk(own: tuple | None, above: tuple, prior: float = PRIOR_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of a group's (n, centre, cov, middle) and its group above: rows against prior rows."""
    if own is None:
        return above
    n, centre, cov, middle = own
    w, cov = n / (n + prior), cov * max(1.0, middle / CHI2_MEDIAN)
    gap = centre - above[0]
    return w * centre + (1 - w) * above[0], w * cov + (1 - w) * above[1] + w * (1 - w) * np.outer(gap, gap)


_FINAL = "grp string, " + ", ".join(f"{c} double" for c in _PARAMS)


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """One row per input row: the counts, base_failed, distance and kept.

    A null or empty text has no words and fails; very long texts are counted whole. A null language or source
    is a group of its own, apart from the empty string. Repeated rows count as often as they occur, and null
    ids keep their rows. Ties in distance are decided alike, as all rows up to the cutoff are kept. Other
    columns, of whatever name, are ignored. An empty table gives an empty result.
    """
    own = df.select(as_text(df, id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    counted = with_statistics(own, "text", ("id", "lang", "source"))
    keys = [F.lit("[]"), F.to_json(F.array("lang")), F.to_json(F.array("lang", "source"))]
    counted = staged(counted.select("*", F.array(*keys).alias("grps"), *[z.alias(f"z{i}") for i, z in enumerate(transformed())]), "statistics")
    z = [f"z{i}" for i in range(D)]
    found = staged(estimates(counted.select(F.explode("grps").alias("grp"), *z)), "estimates")
    # each group beside its language's and all rows' estimates
    column = F.struct("n", "centre", "cov", "middle")
    leaves = counted.select("grps").distinct().select(F.col("grps")[2].alias("grp"), F.col("grps")[1].alias("of"), F.col("grps")[0].alias("all"))
    for name, level in (("grp", "own"), ("of", "mid"), ("all", "top")):
        leaves = leaves.join(found.select(F.col("grp").alias(name), column.alias(level)), name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = lambda r: (r["n"], np.array(r["centre"]), np.array(r["cov"]).reshape(D, D), r["middle"])
        for x in batches:
            out = []
            for r in x.to_dict("records"):
                n, centre, cov, middle = of(r["top"])
                above = shrunk(of(r["mid"]), (centre, cov * max(1.0, middle / CHI2_MEDIAN)))
                out.append({"grp": r["grp"]} | precision_row(*shrunk(of(r["own"]), above)))
            yield pd.DataFrame(out, columns=["grp", *_PARAMS])

    params = staged(leaves.select("grp", "own", "mid", "top").mapInPandas(run, _FINAL), "precisions")
    sizes = found.select("grp", "n").join(params.select("grp"), "grp", "left_semi")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = join_split(counted.withColumn("grp", F.col("grps")[2]), params, "grp", hot_keys(sizes)).withColumn("distance", F.sqrt(_distance()))
    return scored.select(as_id(df, id_col).alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & (F.col("distance") <= cutoff)).alias("kept"), "distance")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
