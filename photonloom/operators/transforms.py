"""Fourier transforms of long traces in four steps, spread over tasks.

A trace of N = L * M places is a grid, place i in column i mod L. The columns are transformed, turned by
their twiddle factors and dealt again by rows, and the rows are transformed. A task holds LOT columns or rows,
about LOT * sqrt(N) numbers. A product of two transforms goes back the same way; its first step needs the very
rows that the second step before has, so a convolution takes two shuffles of packed tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOT = 64


def grid(n: int) -> tuple[int, int]:
    """Columns and rows of the grid for a trace of n places with as many zeros at least, powers of two."""
    bits = int(2 * n - 1).bit_length()
    return 1 << bits // 2, 1 << bits - bits // 2


def _twiddle(a: np.ndarray, c: np.ndarray, size: int) -> np.ndarray:
    return np.exp(-2j * np.pi * (np.outer(a, c) % size) / size)


def _tiles(key: list, values: np.ndarray, at: int, width: int) -> list[list]:
    """The last axis of values in lots of width, one row each."""
    return [[*key, lot, at, np.ascontiguousarray(values[..., lot * width : (lot + 1) * width]).tobytes()] for lot in range(-(-values.shape[-1] // width))]


def chirp(n: int, places: np.ndarray) -> np.ndarray:
    """exp(-i pi k ** 2 / n), the square taken modulo 2 n so that it stays exact."""
    return np.exp(-1j * np.pi * ((places * places) % (2 * n)) / n)


def _joined(df: DataFrame, by: list[str], size: str, place: str, columns: list[str], kind: str) -> DataFrame:
    """(by, size, shift, re, im): the cross-correlation of two columns, or the convolution that gives one column's transform."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    wide = F.length(F.bin(2 * F.col(size) - 1))
    lot = F.floor(F.pmod(F.col(place), F.pow(F.lit(2.0), F.floor(wide / 2)).cast("long")) / LOT)
    rows = df.select(*by, F.col(size).cast("long").alias("_n"), F.col(place).cast("long").alias("_i"), lot.alias("_lot"), *[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(columns)])
    names = [*by, "_n", "_lot", "_at", "_tile"]
    schema = f"{kinds}, _n long, _lot long, _at long, _tile binary"
    if kind == "transform":
        # the chirp fills all columns, whatever rows the trace has in them
        lots = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.pow(F.lit(2.0), F.floor(F.length(F.bin(2 * F.col("_n") - 1)) / 2)).cast("long") - 1) / LOT)))
        empty = rows.select(*by, "_n").distinct().withColumn("_lot", lots)
        rows = rows.unionByName(empty, allowMissingColumns=True)

    def columns_(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        n, at = int(key[len(by)]), int(key[len(by) + 1])
        left, right = grid(n)
        own = np.arange(at * LOT, min((at + 1) * LOT, left))
        g = g[g["_i"].notna()]
        i = g["_i"].to_numpy(np.int64)
        z = np.zeros((2, len(own), right), np.complex128)
        if kind == "transform":
            z[0, i % left - own[0], i // left] = g["_0"].to_numpy() * chirp(n, i)
            k = own[:, None] + left * np.arange(right)[None, :]
            far = left * right - k
            z[1] = np.where(k < n, np.conj(chirp(n, np.minimum(k, n))), np.where(far < n, np.conj(chirp(n, np.minimum(far, n))), 0))
        else:
            z[0, i % left - own[0], i // left], z[1, i % left - own[0], i // left] = g["_0"].to_numpy(), g["_1"].to_numpy()
        z = np.fft.fft(z, axis=2) * _twiddle(own, np.arange(right), left * right)
        return pd.DataFrame(_tiles([*key[: len(by)], n], z, at, LOT), columns=names)

    def rows_(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        n, at = int(key[len(by)]), int(key[len(by) + 1])
        left, right = grid(n)
        own = np.arange(at * LOT, min((at + 1) * LOT, right))
        z = np.concatenate([np.frombuffer(t, np.complex128).reshape(2, -1, len(own)) for t in g.sort_values("_at")["_tile"]], axis=1)
        lots = np.sort(g["_at"].to_numpy())
        if len(lots) * LOT < left:
            # lots without rows have no tile
            whole = np.zeros((2, left, len(own)), np.complex128)
            whole[:, np.concatenate([np.arange(a * LOT, min((a + 1) * LOT, left)) for a in lots])] = z
            z = whole
        z = np.fft.fft(z, axis=1)
        product = z[0] * z[1] if kind == "transform" else np.conj(z[0]) * z[1]
        # the inverse is the conjugate's transform; row c of the grid is column c of the way back
        back = np.fft.fft(np.conj(product).T, axis=1) * _twiddle(own, np.arange(left), left * right)
        return pd.DataFrame(_tiles([*key[: len(by)], n], back, at, LOT), columns=names)

    def found(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        n, at = int(key[len(by)]), int(key[len(by) + 1])
        left, right = grid(n)
        own = np.arange(at * LOT, min((at + 1) * LOT, left))
        z = np.concatenate([np.frombuffer(t, np.complex128).reshape(-1, len(own)) for t in g.sort_values("_at")["_tile"]], axis=0)
        value = np.conj(np.fft.fft(z, axis=0)) / (left * right)
        shift = (own[None, :] + left * np.arange(right)[:, None]).ravel()
        return pd.DataFrame({**dict(zip(by, key)), size: n, "shift": shift, "re": value.real.ravel(), "im": value.imag.ravel()})

    keys = [*by, "_n", "_lot"]
    first = rows.groupBy(*keys).applyInPandas(columns_, schema)
    second = first.groupBy(*keys).applyInPandas(rows_, schema)
    return second.groupBy(*keys).applyInPandas(found, f"{kinds}, `{size}` long, shift long, re double, im double")


def circular_correlation(df: DataFrame, by: list[str], a: str, b: str, place: str, size: str) -> DataFrame:
    """(by, size, shift, value): for each shift from 0 to size - 1 the sum of a at i times b at i + shift, round the trace's end.

    place counts from 0 to size - 1 in each trace. The linear correlation of the traces with as many zeros is
    folded, so size may be any number.
    """
    whole = _joined(df, by, size, place, [a, b], "correlation")
    bits = F.length(F.bin(2 * F.col(size) - 1))
    n = F.col(size)
    behind = F.col("shift") - F.pow(F.lit(2.0), bits).cast("long") + n
    at = F.when(F.col("shift") < n, F.col("shift")).when(behind > 0, behind)
    return whole.withColumn("shift", at).where("shift is not null").groupBy(*by, size, "shift").agg(F.sum("re").alias("value"))


def power_spectrum(df: DataFrame, by: list[str], value: str, place: str, size: str) -> DataFrame:
    """(by, size, k, power) for k from 0 to size // 2: the squared size of a trace's Fourier sum at k cycles in its length.

    Any size: the sum is written as a convolution with a chirp.
    """
    whole = _joined(df, by, size, place, [value], "transform")
    return whole.where(F.col("shift") <= F.floor(F.col(size) / 2)).select(*by, size, F.col("shift").alias("k"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))
