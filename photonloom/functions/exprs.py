"""Column expressions that several operators share; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ, whatever the session's time zone."""
    since = col(ts) - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")


def finite(x: str | Column) -> Column:
    """Null for NaN and infinities."""
    x = col(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def pearson(a: str | Column, b: str | Column) -> Column:
    """Aggregate correlation; null where a side is constant."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def r_squared(actual: str | Column, predicted: str | Column) -> Column:
    """Aggregate 1 - MSE / population variance; null where actual is constant."""
    a, p = col(actual).cast("double"), col(predicted).cast("double")
    return 1 - F.try_divide(F.avg((a - p) * (a - p)), F.var_pop(a))


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two arrays, in double."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def median(x: str | Column) -> Column:
    """Exact median of the finite values."""
    return F.median(finite(x))


def grid_row(pixel: str | Column, width: int) -> Column:
    return F.floor(col(pixel) / width)


def grid_col(pixel: str | Column, width: int) -> Column:
    return col(pixel) % width
