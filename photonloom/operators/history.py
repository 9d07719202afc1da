"""Causal history features over the updates of a session, found in stretches that carry their history along."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonloom.operators.stretches import in_stretches


@dataclass(frozen=True)
class Bins:
    """count disjoint past blocks of width updates each, the newest first."""

    count: int = 4
    width: int = 10

    @property
    def history(self) -> int:
        return self.count * self.width


def eligible(df: DataFrame, history: int, row: str = "rn") -> DataFrame:
    """Rows with a full history of that many updates, their own included; row counts from 1."""
    return df.where(F.col(row) >= history)


def lagged(df: DataFrame, by: list[str], value: str, lags: int, row: str = "rn") -> DataFrame:
    """df with x: value now and at lags-1 rows before, only where all of them exist."""
    return eligible(in_stretches(df, by, lags - 1, lambda w: {"x": F.array(*[F.lag(value, k).over(w) for k in range(lags)])}, row), lags, row)


def lagged_vectors(df: DataFrame, by: list[str], vector: str, lags: int, row: str = "rn") -> DataFrame:
    """df with x: the vectors of this row and of lags-1 rows before, newest first, as one array."""
    return eligible(in_stretches(df, by, lags - 1, lambda w: {"x": F.flatten(F.array(*[F.lag(vector, k).over(w) for k in range(lags)]))}, row), lags, row)


def binned(df: DataFrame, by: list[str], value: str, bins: Bins, row: str = "rn") -> DataFrame:
    """df with b0..: averages over the blocks of bins, only where the whole history exists."""
    block = lambda w, b: F.avg(value).over(w.rowsBetween(-((b + 1) * bins.width - 1), -b * bins.width))
    return eligible(in_stretches(df, by, bins.history - 1, lambda w: {f"b{b}": block(w, b) for b in range(bins.count)}, row), bins.history, row)


def binned_vectors(df: DataFrame, by: list[str], vector: str, bins: Bins, size: int, row: str = "rn") -> DataFrame:
    """df with x: block averages of each entry of a vector of that size, block-major."""
    entry = lambda w, b, i: F.avg(F.col(vector)[i].cast("double")).over(w.rowsBetween(-((b + 1) * bins.width - 1), -b * bins.width))
    add = lambda w: {"x": F.array(*[entry(w, b, i) for b in range(bins.count) for i in range(size)])}
    return eligible(in_stretches(df, by, bins.history - 1, add, row), bins.history, row)
