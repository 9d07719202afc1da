"""The exponential baseline as a stateful stream: equal to the batch operator for rows in time order of each key."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_ema_baseline(df: DataFrame, key: str, tau_seconds: float = 60.0, t: str = "t", value: str = "value", tie: str = "event_id") -> DataFrame:
    """A stream of (key, t, tie, value) with baseline; the state of a key is its last time and baseline.

    Micro-batches must come in time order; a row older than its key's state is an error.
    """

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, b = state.get if state.exists else (None, 0.0)
        x = pd.concat(list(batches)).sort_values([t, tie], ignore_index=True)
        out = []
        for now, v in zip(x[t].tolist(), x[value].tolist()):
            if last is not None and now < last:
                raise ValueError("rows came out of time order")
            b = v if last is None else b - math.expm1(-(now - last) / 1e6 / tau_seconds) * (v - b)
            last = now
            out.append(b)
        state.update((last, b))
        yield x.assign(baseline=out)

    columns = [key, t, tie, value]
    kinds = {c: df.schema[c].dataType.simpleString() for c in columns}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    return df.select(*columns).groupBy(key).applyInPandasWithState(run, f"{schema}, baseline double", f"last {kinds[t]}, b double", "append", GroupStateTimeout.NoTimeout)
