"""Work on ordered traces in stretches, so that no trace is one task's: halos, running sums with decay, exact quantiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from photonloom.functions.exprs import col, finite
from photonloom.sources.shared import kept

#: Rows of a stretch.
ROWS = 4096
#: Bins of a refinement, and values of a bin that one row may hold.
BINS, FEW = 1024, 10_000
#: A stretch lasts so many time constants at most: exp(SPAN) is far from the largest floating-point number.
SPAN = 300.0


def in_stretches(df: DataFrame, by: list[str], history: int, add: Callable[[WindowSpec], dict[str, Column]], row: str = "rn", rows: int = ROWS) -> DataFrame:
    """df with the columns that add makes of a window in the order of row, which counts from 1 in each trace.

    They must depend on a row and on history rows before it at most. Each row is copied to the later stretches
    whose first rows look back to it, so every stretch has its whole history and is a window of its own.
    """
    own = F.floor((F.col(row) - 1) / rows)
    reach = F.floor((F.col(row) - 1 + history) / rows)
    spread = df.withColumn("_own", own).withColumn("_stretch", F.explode(F.sequence("_own", reach)))
    return spread.withColumns(add(Window.partitionBy(*by, "_stretch").orderBy(row))).where("_own = _stretch").drop("_own", "_stretch")


def decayed(df: DataFrame, by: list[str], t: str, gain: Column, first: Column, tau_us: float, out: str, row: str = "rn", rows: int = ROWS) -> DataFrame:
    """df with out: first in a trace's first row, then b = b_before * exp(-(t - t_before) / tau) + gain.

    gain may use the column _before, the time of the row before. A row maps b_before to b by a factor and an
    offset, and so does a stretch. A stretch's offset is a running sum under one exponential; the maps of
    the stretches, one row each, are composed by doubling: after k steps a map reaches over 2 ** k stretches.
    """
    df = in_stretches(df, by, 1, lambda w: {"_before": F.lag(t).over(w)}, row, rows)
    df = df.withColumn("_s", F.struct(F.floor((F.col(row) - 1) / rows).alias("rows"), F.floor(F.col(t) / (SPAN * tau_us)).alias("span")))
    since = (F.col(t) - F.col("_s.span") * (SPAN * tau_us)) / tau_us
    w = Window.partitionBy(*by, "_s").orderBy(row)
    term = F.when(F.col(row) == 1, first).otherwise(gain)
    df = df.withColumn("_local", F.sum(term * F.exp(since)).over(w.rowsBetween(Window.unboundedPreceding, 0)) * F.exp(-since))
    stretches = df.groupBy(*by, "_s").agg(F.max_by("_local", row).alias("_offset"), F.max(t).alias("_last"), F.min("_before").alias("_from"))
    stretches = kept(stretches.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy("_s"))), "stretches")
    order = Window.partitionBy(*by).orderBy("_place")
    maps = stretches.withColumn("_factor", F.coalesce(F.exp(-(F.col("_last") - F.col("_from")) / tau_us), F.lit(0.0)))
    most = stretches.agg(F.coalesce(F.max("_place"), F.lit(1))).first()[0]
    for k in range((most - 1).bit_length()):
        before = lambda c: F.lag(c, 1 << k).over(order)
        maps = maps.withColumns({"_offset": F.col("_offset") + F.coalesce(F.col("_factor") * before("_offset"), F.lit(0.0)), "_factor": F.col("_factor") * F.coalesce(before("_factor"), F.lit(1.0))})
    carried = maps.select(*by, "_s", "_from", F.coalesce(F.lag("_offset").over(order), F.lit(0.0)).alias("_carry"))
    # a stretch is one of few in its trace, and its rows are bounded by its width
    found = df.join(carried, [*by, "_s"])
    rest = F.when(F.col("_from").isNull(), 0.0).otherwise(F.col("_carry") * F.exp(-(F.col(t) - F.col("_from")) / tau_us))
    return found.withColumn(out, F.col("_local") + rest).drop("_before", "_s", "_local", "_from", "_carry")


def quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[str | Column, float]], few: int = FEW, bins: int = BINS) -> DataFrame:
    """by and one column for each name in wanted: the exact quantile of a column's finite values, between two of them in proportion.

    The values around each rank are found by histograms that are refined until a bin has few values or one
    value only, however often it occurs; what a task or row holds is bounded, whatever a group's size. A
    group without values has nulls.
    """
    exprs: list[str] = []
    place = {}
    held = []
    for name, (c, _) in wanted.items():
        text = str(col(c))
        if text not in exprs:
            exprs.append(text)
            held.append(finite(c))
        place[name] = exprs.index(text)
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("_c"), v.alias("_v")) for k, v in enumerate(held)])).alias("_x")).select(*by, "_x.*")
    long = kept(long, "values")
    values = long.where("_v is not null")
    sizes = values.groupBy(*by, "_c").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ranks = []
    for name, (_, q) in wanted.items():
        at = F.lit(float(q)) * (F.col("_n") - 1)
        low = F.floor(at)
        for side, rank in enumerate((low, F.least(low + 1, F.col("_n") - 1))):
            ranks.append(F.when(F.col("_c") == place[name], F.struct(F.lit(name).alias("_name"), F.lit(side).alias("_side"), rank.alias("_rank"), (at - low).alias("_share"))))
    targets = sizes.withColumn("_x", F.explode(F.array_compact(F.array(*ranks)))).select(*by, "_c", "_x.*", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_held"))
    targets = kept(targets, "ranks")
    span = [*by, "_c", "_lo", "_hi"]
    inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    wide = F.col("_hi") - F.col("_lo") == float("inf")
    share = F.when(wide, (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)).otherwise((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    open_ = (F.col("_lo") < F.col("_hi")) & (F.col("_held") > few)
    while not (left := targets.where(open_)).isEmpty():
        marked = values.join(left.select(*span).distinct(), [*by, "_c"]).where(inside)
        bars = marked.groupBy(*span, F.least(F.lit(bins - 1), F.floor(share * bins)).alias("_bin")).agg(F.count("*").alias("_size"), F.min("_v").alias("_first"), F.max("_v").alias("_last"))
        ahead = F.sum("_size").over(Window.partitionBy(*span).orderBy("_bin")) - F.col("_size")
        found = left.join(bars.withColumn("_ahead", ahead), span).where("_rank >= _below + _ahead and _rank < _below + _ahead + _size")
        next_ = found.select(*by, "_c", "_name", "_side", "_rank", "_share", F.col("_first").alias("_lo"), F.col("_last").alias("_hi"), (F.col("_below") + F.col("_ahead")).alias("_below"), F.col("_size").alias("_held"))
        targets = kept(next_.unionByName(targets.where(~open_)), "ranks")
    left = targets.where("_lo < _hi")
    lists = values.join(left.select(*span).distinct(), [*by, "_c"]).where(inside).groupBy(*span).agg(F.sort_array(F.collect_list("_v")).alias("_list"))
    known = left.join(lists, span).withColumn("_value", F.element_at("_list", (F.col("_rank") - F.col("_below") + 1).cast("int"))).drop("_list")
    known = known.unionByName(targets.where("_lo = _hi").withColumn("_value", F.col("_lo")))
    side = lambda name, k: F.max(F.when((F.col("_name") == name) & (F.col("_side") == k), F.col("_value")))
    part = lambda name: F.max(F.when(F.col("_name") == name, F.col("_share")))
    out = known.groupBy(*by).agg(*[(side(n, 0) + (side(n, 1) - side(n, 0)) * part(n)).alias(n) for n in wanted])
    return long.select(*by).distinct().join(out, by, "left")
