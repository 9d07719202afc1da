"""Null distributions, false discovery rates and block bootstrap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from photonloom.operators.clocks import ranked
from photonloom.operators.stretches import ROWS
from photonloom.operators.transforms import circular_correlation
from photonloom.sources.shared import kept


def circular_shift(df: DataFrame, by: list[str], actual: str, predicted: str, exclusion: int, row: str = "rn", compat: bool = False) -> DataFrame:
    """(by, p): two-sided p of a trace's correlation among those of rotations of at least exclusion steps to either side.

    The observed one counts as one of them. A constant side has no p, or with compat the smallest one; fewer
    than two rotations are an error. Rows are in the order of row. Every rotation's correlation comes of one
    transform that is spread over tasks.
    """
    own = ranked(df.select(*by, F.col(row).alias("_row"), F.col(actual).cast("double").alias("_a"), F.col(predicted).cast("double").alias("_b")), by, "_row", "_row", ROWS, ("_rn", "_size"))
    own = kept(own.withColumn("_place", F.col("_rn") - 1), "traces")
    facts = own.groupBy(*by).agg(F.count("*").alias("_n"), *[f(c).alias(f"{name}{c}") for c in ("_a", "_b") for name, f in (("_mean", F.avg), ("_sd", F.stddev_pop))])
    far = F.col("_n") - 2 * exclusion
    facts = facts.withColumn("_far", F.when(far >= 2, far).otherwise(F.raise_error(F.lit(f"a trace has no two rotations beyond {exclusion} steps"))))
    unit = lambda c: (F.col(c) - F.col(f"_mean{c}")) / F.col(f"_sd{c}")
    moving = own.join(facts.where((F.col("_sd_a") > 0) & (F.col("_sd_b") > 0)), by).select(*by, "_place", "_size", unit("_a").alias("_a"), unit("_b").alias("_b"))
    r = kept(circular_correlation(moving, by, "_a", "_b", "_place", "_size").withColumn("_r", F.abs(F.col("value") / F.col("_size"))), "rotations")
    seen = r.where("shift = 0").select(*by, F.col("_r").alias("_seen"))
    within = (F.col("shift") >= exclusion) & (F.col("shift") < F.col("_size") - exclusion)
    above = r.where(within).join(seen, by).groupBy(*by).agg(F.count_if(F.col("_r") >= F.col("_seen")).alias("_above"))
    p = F.when(F.col("_above").isNotNull(), (F.col("_above") + 1) / (F.col("_far") + 1))
    return facts.join(above, by, "left").select(*by, (F.coalesce(p, 1 / (F.col("_far") + 1)) if compat else p).alias("p"))


def benjamini_hochberg(df: DataFrame, p: str = "p", tie: str = "roi") -> DataFrame:
    """df with q over all rows with a p; null p has null q.

    p are counted in stretches of equal width first, so that ranks and the running minimum are found
    in each stretch on its own and carried over by one row for each stretch.
    """
    stretches = 1024
    tested = df.where(F.col(p).isNotNull()).withColumn("_part", F.least(F.lit(stretches - 1), F.floor(F.col(p) * stretches)))
    sizes = tested.groupBy("_part").agg(F.count("*").alias("_size"))
    # at most 1024 rows, so a window over all of them is small
    every = Window.orderBy("_part")
    ahead = F.coalesce(F.sum("_size").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_size").over(Window.partitionBy(F.lit(1)))
    sizes = sizes.select("_part", ahead.alias("_ahead"), total.alias("_m"))
    order = Window.partitionBy("_part").orderBy(p, tie)
    ranks = tested.join(sizes, "_part").withColumn("_raw", F.col(p) * F.col("_m") / (F.col("_ahead") + F.row_number().over(order)))
    later = ranks.groupBy("_part").agg(F.min("_raw").alias("_low"))
    later = later.select("_part", F.min("_low").over(every.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    here = F.min("_raw").over(order.rowsBetween(0, Window.unboundedFollowing))
    done = ranks.withColumn("_here", here).join(later, "_part").withColumn("q", F.least(F.lit(1.0), "_here", F.coalesce("_later", F.lit(1.0))))
    return done.select(*df.columns, "q").unionByName(df.where(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))


def block_bootstrap(df: DataFrame, by: list[str], actual: str, predicted: str, block: int = 68, repetitions: int = 2000, seed: int = 20260929, row: str = "rn") -> DataFrame:
    """95 % intervals of r and r2 over paired moving blocks.

    A repetition draws blocks of rows that follow each other until it has as many rows as the trace, the last
    one cut. The drawn starts, by the hash of seed, repetition and number, are dealt to the stretches where
    their blocks begin; block sums are differences of running sums there, and a stretch gives one row for each
    repetition that drew from it. Draws are many times the rows, so no step may send them to the driver. Rows
    count from 1 by row in each trace.
    """
    own = ranked(df.select(*by, F.col(row).alias("_row"), F.col(actual).cast("double").alias("a"), F.col(predicted).cast("double").alias("p")), by, "_row", "_row", ROWS, ("_rn", "_n"))
    terms = {"a": F.col("a"), "p": F.col("p"), "aa": F.col("a") * F.col("a"), "pp": F.col("p") * F.col("p"), "ap": F.col("a") * F.col("p"), "ee": (F.col("a") - F.col("p")) * (F.col("a") - F.col("p"))}
    sums, rows = list(terms), ROWS
    own = kept(own.select(*by, "_rn", "_n", *[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in terms.items()]), "paired")
    # after a stretch's own rows come those of the longest block, so a block lies in the stretch where it begins
    spread = own.withColumn("_stretch", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("_rn") - block) / rows)), F.floor((F.col("_rn") - 1) / rows))))
    width = F.least(F.lit(block), F.col("_n")).cast("long")
    traces = own.select(*by, "_n").distinct().withColumns({"_width": width, "_last": F.pmod(F.col("_n") - 1, width) + 1, "_count": F.ceil(F.col("_n") / width).cast("long")})
    # by number, as a few small rows become many
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = traces.withColumn("_rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repetitions - 1).cast("long")))).repartition(tasks, *by, "_rep")
    draws = draws.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_count") - 1)))
    share = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "_rep", "_k")), 1, 8), 16, 10).cast("long") / float(1 << 32)
    start = F.floor(share * (F.col("_n") - F.col("_width") + 1))
    size = F.when(F.col("_k") == F.col("_count") - 1, F.col("_last")).otherwise(F.col("_width"))
    draws = draws.select(*by, F.floor(start / rows).alias("_stretch"), F.col("_rep").cast("int"), F.pmod(start, F.lit(rows)).cast("int").alias("_from"), size.cast("int").alias("_size"))

    def drawn(key: tuple, own: pa.Table, draws: pa.Table) -> pa.Table:
        order = np.argsort(own["_rn"].to_numpy())
        rep, first = draws["_rep"].to_numpy(), draws["_from"].to_numpy()
        last = first + draws["_size"].to_numpy()
        found = np.bincount(rep, minlength=1)
        reps = np.flatnonzero(found)
        out = {c: pa.repeat(k, len(reps)) for c, k in zip(by, key)} | {"_n": pa.repeat(own["_n"][0], len(reps)), "_rep": pa.array(reps, pa.int32())}
        for c in sums:
            running = np.concatenate([[0.0], np.cumsum(own[c].to_numpy()[order])])
            out[c] = pa.array(np.bincount(rep, running[last] - running[first], len(found))[reps])
        return pa.table(out)

    kinds = StructType([*[df.schema[c] for c in by], StructField("_n", LongType()), StructField("_rep", IntegerType()), *[StructField(k, DoubleType()) for k in sums]])
    parts = spread.groupBy(*by, "_stretch").cogroup(draws.groupBy(*by, "_stretch")).applyInArrow(drawn, kinds)
    total = parts.groupBy(*by, "_n", "_rep").agg(*[F.sum(k).alias(k) for k in sums])
    n = F.col("_n")
    va, vp = F.col("aa") - F.col("a") * F.col("a") / n, F.col("pp") - F.col("p") * F.col("p") / n
    tiny = lambda v, s: F.when(v > 1e-12 * F.col(s), v)
    scored = total.select(*by, ((F.col("ap") - F.col("a") * F.col("p") / n) / F.sqrt(tiny(va, "aa") * tiny(vp, "pp"))).alias("r"), (1 - F.col("ee") / tiny(va, "aa")).alias("r2"))
    # as many rows as repetitions for each trace
    return scored.groupBy(*by).agg(*[F.percentile(c, q).alias(f"{c}_{name}") for c in ("r", "r2") for name, q in (("low", 0.025), ("high", 0.975))])
