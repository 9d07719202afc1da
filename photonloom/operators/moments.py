"""Sufficient statistics of design and response, summed by Spark once and reused by all linear models.

Sums add, so every fold, refit set or left-out session is a sum or difference of the same few tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Moments:
    """Row count and raw sums of x, x xT, y, x yT and y squared; x has P entries, y one for each response."""

    n: float
    sx: np.ndarray
    xx: np.ndarray
    sy: np.ndarray
    xy: np.ndarray
    yy: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(*(getattr(self, k) + getattr(other, k) for k in self.__dataclass_fields__))

    def __sub__(self, other: Moments) -> Moments:
        return Moments(*(getattr(self, k) - getattr(other, k) for k in self.__dataclass_fields__))

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> Moments:
        return cls(float(len(x)), x.sum(axis=0), x.T @ x, y.sum(axis=0), x.T @ y, (y * y).sum(axis=0))

    @property
    def mx(self) -> np.ndarray:
        return self.sx / self.n

    @property
    def my(self) -> np.ndarray:
        return self.sy / self.n

    @property
    def cov(self) -> np.ndarray:
        return self.xx / self.n - np.outer(self.mx, self.mx)

    @property
    def cross(self) -> np.ndarray:
        return self.xy / self.n - np.outer(self.mx, self.my)

    @property
    def variance(self) -> np.ndarray:
        return self.yy / self.n - self.my**2

    def projected(self, basis: np.ndarray) -> Moments:
        """Moments of basis @ x."""
        return Moments(self.n, basis @ self.sx, basis @ self.xx @ basis.T, self.sy, basis @ self.xy, self.yy)

    def picked(self, columns: np.ndarray, response: int) -> Moments:
        """Some entries of x and one response."""
        r = slice(response, response + 1)
        return Moments(self.n, self.sx[columns], self.xx[np.ix_(columns, columns)], self.sy[r], self.xy[columns][:, r], self.yy[r])

    def responses(self, which: list[int]) -> Moments:
        """Some responses, with all of x."""
        return Moments(self.n, self.sx, self.xx, self.sy[which], self.xy[:, which], self.yy[which])

    def rescaled(self, center: np.ndarray, scale: np.ndarray) -> Moments:
        """Moments of (y - center) / scale."""
        sy = (self.sy - self.n * center) / scale
        yy = (self.yy - 2 * center * self.sy + self.n * center**2) / scale**2
        return Moments(self.n, self.sx, self.xx, sy, (self.xy - np.outer(self.sx, center)) / scale, yy)

    def scores(self, beta: np.ndarray, bias: np.ndarray) -> dict[str, np.ndarray]:
        """r, r2 and mse of the predictions x @ beta + bias, from sums alone."""
        shift = self.my - self.mx @ beta - bias
        power = np.einsum("pr,pq,qr->r", beta, self.cov, beta, optimize=True)
        shared = np.einsum("pr,pr->r", beta, self.cross)
        mse = np.maximum(self.variance - 2 * shared + power, 0) + shift**2
        ok = self.variance > 1e-12 * np.maximum(self.my**2, 1)
        r = np.divide(shared, np.sqrt(np.maximum(self.variance * power, 0)), out=np.full_like(mse, np.nan), where=ok & (power > 1e-20))
        return {"r": r, "r2": 1 - np.divide(mse, self.variance, out=np.full_like(mse, np.nan), where=ok), "mse": mse}


_OUT = "n double, p int, sx binary, xx binary, sy binary, xy binary, yy binary"


def _packed(m: Moments) -> list:
    return [m.n, len(m.sx), *(np.ascontiguousarray(getattr(m, k), float).tobytes() for k in ("sx", "xx", "sy", "xy", "yy"))]


def _opened(r) -> Moments:
    sx, xx, sy, xy, yy = (np.frombuffer(b, float) for b in (r.sx, r.xx, r.sy, r.xy, r.yy))
    return Moments(r.n, sx, xx.reshape(r.p, r.p), sy, xy.reshape(r.p, -1), yy)


def moments(df: DataFrame, by: list[str], x: str = "x", y: str = "y", fan_in: int = 32) -> dict[tuple, Moments]:
    """Moments of each group of by. Arrays x and y are summed in each task, then in groups of fan_in tasks.

    What comes to the driver is one row for each group, of P squared numbers, whatever the rows.
    """
    columns = [*by, "_lot", *(c.split()[0] for c in _OUT.split(", "))]

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Moments] = {}
        for b in batches:
            for key, g in b.groupby(by, dropna=False, sort=False):
                m = Moments.of(np.stack(g[x].to_numpy()).astype(float), np.stack(g[y].to_numpy()).astype(float))
                held[key] = held[key] + m if key in held else m
        lot = TaskContext.get().partitionId() // fan_in
        yield pd.DataFrame([[*k, lot, *_packed(m)] for k, m in held.items()], columns=columns)

    def joined(keep: list[str]):
        def run(g: pd.DataFrame) -> pd.DataFrame:
            total = reduce(lambda a, b: a + b, map(_opened, g.itertuples()))
            return pd.DataFrame([[*g.iloc[0][keep], *_packed(total)]], columns=[*keep, *columns[len(by) + 1 :]])

        return run

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    parts = df.select(*by, x, y).mapInPandas(part, f"{kinds}, _lot int, {_OUT}")
    lots = parts.groupBy(*by, "_lot").applyInPandas(joined([*by, "_lot"]), f"{kinds}, _lot int, {_OUT}")
    return {tuple(r[c] for c in by): _opened(r) for r in lots.groupBy(*by).applyInPandas(joined(by), f"{kinds}, {_OUT}").collect()}
