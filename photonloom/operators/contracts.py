"""Checks of sessions that must hold before anything is fitted; a broken one raises and names the session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonloom.functions.exprs import finite


def raise_first(broken: DataFrame, message: str, most: int = 3) -> None:
    """Raise if broken has rows, and show some of them."""
    rows = [r.asDict() for r in broken.limit(most).collect()]
    if rows:
        raise ValueError(f"{message}: {rows}")


#: What must not hold of a session's counts, and what it means.
ALIGNMENT = (
    ("clock_rows <> display_frames or frame_clock_rows <> response_rows", "Row counts of clocks and recordings differ"),
    ("playback_rows <> display_frames", "Playback rows differ from display frames"),
    ("back_steps > 0", "Update starts don't grow"),
    ("payload_end >= display_frames or last_update_start >= payload_end", "Payload ends outside the display or before the last update"),
    ("matched_frames = 0", "No frames overlap the payload"),
)


def check_alignment(sessions: DataFrame, by: list[str]) -> None:
    """sessions has one row of counts for each session, named as in ALIGNMENT; a null count breaks its rule."""
    for rule, message in ALIGNMENT:
        raise_first(sessions.where(F.coalesce(F.expr(rule), F.lit(True))).select(*by), message)


def one_session(sessions: DataFrame, **wanted: str) -> DataFrame:
    """The session with these values; none or several are an error."""
    found = sessions
    for c, v in wanted.items():
        found = found.where(F.col(c) == v)
    n = found.limit(2).count()
    if n != 1:
        raise ValueError(f"{'No' if not n else 'More than one'} session with {wanted}")
    return found


def check_shared(rows: DataFrame, by: list[str], response: str = "y", table: str = "features") -> None:
    """Raise unless each session has one run, one response width of finite values, and all sessions one feature table."""
    raise_first(rows.groupBy(by[0]).agg(F.count_distinct(*by).alias("runs")).where("runs > 1"), "Sessions are not distinct")
    size, odd = F.size(response), F.exists(response, lambda v: finite(v).isNull())
    raise_first(rows.groupBy(*by).agg(F.min(size).alias("least"), F.max(size).alias("most"), F.count_if(F.coalesce(odd, F.lit(True))).alias("odd")).where("least <> most or odd > 0"), "Response shape or values are invalid")
    raise_first(rows.select(table).distinct().groupBy().agg(F.count("*").alias("tables")).where("tables > 1"), "Sessions don't share one feature table")
