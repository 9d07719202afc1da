"""Queries over the driver's tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photonloom.functions.exprs import dot, micros, pearson, r_squared
from photonloom.operators import baseline, clocks, compare, history, linear, network, scores, significance, splits, timing
from photonloom.operators.clocks import ranked
from photonloom.operators.moments import moments
from photonloom.operators.stretches import ROWS, in_stretches, quantiles
from photonloom.plans import experiments, pixels, reliability
from photonloom.plans.events import HISTORY, embedding_sessions, events, plain_events, session_moments, table, with_lags
from photonloom.sources import features, parameters, stimulus
from photonloom.sources import inventory as inventories
from photonloom.sources.shared import kept, new_folder

DAY = 86_400_000_000
PAYLOAD_END = 1_706_140_800_000_000
OFFSETS = [k * 600_000_000 for k in range(-10, 11)]
TAU = 21_600.0
CANDIDATE_TAU = 60.0
HOUR = 3_600_000_000
MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
GLOBAL = splits.GlobalSplit(40, 800, 1200, 1900)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: str | Column, name: str | None = None) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def clicks_and_frames(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    return e.where("fly = 'click'"), e.where("fly <> 'click'")


@query
def asof_align(spark, sf):
    clicks, frames = clicks_and_frames(plain_events(spark, sf))
    return clocks.asof(frames.select("event_id", "t"), clicks.select("t", F.col("event_id").alias("update_id")), [], ["update_id"]).select("event_id", "update_id")


@query
def asof_payload_filter(spark, sf):
    clicks, frames = clicks_and_frames(plain_events(spark, sf))
    aligned = clocks.asof(frames.select("event_id", "t"), clicks.select("t", F.col("event_id").alias("update_id")), [], ["update_id"])
    return clocks.in_payload(aligned, "update_id", PAYLOAD_END).select("event_id", "update_id", "t")


SESSIONS = ("error", "purchase", "signup", "view")


def _shared_updates(clicks: DataFrame, x: Column) -> DataFrame:
    """The clicks as updates of every session, as all see one stimulus."""
    return clicks.select(F.explode(F.array(*map(F.lit, SESSIONS))).alias("fly"), "t", x.alias("x"))


@query
def asof_offset_sweep(spark, sf):
    clicks, frames = clicks_and_frames(plain_events(spark, sf))
    rows = frames.select("fly", "t", F.lit("test").alias("part"), F.array("value").alias("y"))
    ups = _shared_updates(clicks, F.array(F.array("value")))
    sums = timing.offset_sums(rows, ups, OFFSETS, ["fly"])
    total = sums.groupBy("fly", "offset_us").agg(F.sum("n").alias("n_matched"), *[F.sum(c).alias(c) for c in ("sy", "syy")], *[F.sum(F.col(c)[0]).alias(c) for c in ("sx", "sxy", "sxx")])
    n = F.col("n_matched")
    r = F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / n, F.sqrt((F.col("syy") - F.col("sy") ** 2 / n) * (F.col("sxx") - F.col("sx") ** 2 / n)))
    scored = total.where("n_matched > 0").select("fly", "offset_us", "n_matched", r6(r, "r"))
    top = clocks.best(scored, ["fly"], "offset_us", "r").select("fly", F.col("offset_us").alias("best_offset_us"))
    return scored.join(top, "fly", "left").select("fly", "offset_us", "n_matched", "r", (F.col("offset_us") == F.col("best_offset_us")).alias("is_best"))


TIMING_LAGS, TIMING_MARGIN = 3, 8


def _clicked(spark, sf):
    """Updates of each session, the clicks with three lags of value and user_id, and its frames with their update u and part."""
    clicks, frames = clicks_and_frames(plain_events(spark, sf))
    placed = ranked(clicks.withColumn("_all", F.lit(1)), ["_all"], "t", "event_id")
    lags = lambda c, w: F.array(*[F.lag(c, k).over(w).cast("double") for k in range(TIMING_LAGS)])
    placed = in_stretches(placed, ["_all"], TIMING_LAGS - 1, lambda w: {"x": F.array(lags("value", w), lags("user_id", w))})
    ups = kept(_shared_updates(placed.withColumn("x", F.when(F.col("rn") >= TIMING_LAGS, F.col("x"))), F.col("x")), "updates")
    at_zero = clocks.asof(frames, placed.select("t", F.col("rn").alias("_rn"), F.col("n").alias("_n")), [], ["_rn", "_n"])
    common = at_zero.where((F.col("_rn") > TIMING_LAGS + TIMING_MARGIN) & (F.col("_rn") <= F.col("_n") - TIMING_MARGIN)).withColumn("u", F.col("_rn") - 1).drop("_rn", "_n")
    common = ranked(common, ["fly"], "t", "event_id")
    part = F.when(F.col("rn") <= F.floor(F.col("n") * 0.35), "first").when(F.col("rn") <= F.floor(F.col("n") * 0.7), "second").otherwise("test")
    return ups, kept(common.withColumn("part", part).select("fly", "event_id", "t", "u", "part", "value", "user_id"), "frames")


@query
def timing_sensitivity(spark, sf):
    """Two responses, value and user_id, to three clicks' values and user_ids; frozen models fitted on the first 70 % at offset zero."""
    ups, frames = _clicked(spark, sf)
    rows = frames.select("fly", "t", "part", F.array("value", F.col("user_id").cast("double")).alias("y"))
    models = timing.reverse_models(timing.offset_sums(rows.where("part <> 'test'"), ups, [0], ["fly"]), ["fly"], TIMING_LAGS)
    scored = timing.offset_scores(rows, ups, models, OFFSETS, ["fly"], TIMING_LAGS)
    out = timing.timing_sensitivity(scored, ["fly"])
    return out.select("fly", "offset_us", "positive_r_count", *[r6(c) for c in ("median_test_r", "median_test_r2", "median_filter_strength", "median_split_half_r")])


@query
def row_id_zip(spark, sf):
    e = events(spark, sf)
    return e.where("fly = 'click'").select("rn", F.col("event_id").alias("click_id")).join(e.where("fly = 'view'").select("rn", F.col("event_id").alias("view_id")), "rn")


@query
def index_lookup(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), micros("o_orderdate").alias("t_us"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(orders, "l_orderkey")


FEATURE_BINS, FEATURE_PIXELS, FEATURE_ROWS, FEATURE_COLUMNS = history.Bins(2, 2), 8, (50, 300), slice(6, 10)


@query
def feature_gather(spark, sf):
    """Binned vectors, written once in buckets of the update, gathered by events; a slice of updates and of features."""
    v = ranked(table(spark, sf, "embeddings").select(F.lit(1).alias("_all"), "vec_id", "embedding"), ["_all"], "vec_id", "vec_id", ROWS)
    x = history.binned_vectors(v, ["_all"], "embedding", FEATURE_BINS, FEATURE_PIXELS).select((F.col("rn") - 1).alias("u"), "x")
    shared = features.write_features(x, "u", "x", FEATURE_BINS.count * FEATURE_PIXELS)
    frames = plain_events(spark, sf).select("event_id", "value", (F.col("event_id") % 400).alias("update"))
    found = features.gather(frames, shared, "update", FEATURE_ROWS, FEATURE_COLUMNS)
    return found.select("event_id", "update", "value", *[r6(c) for c in shared.columns[FEATURE_COLUMNS]])


@query
def parameter_replay(spark, sf):
    """Frozen models of each session's value by three clicks' values, saved with their test predictions, loaded and replayed."""
    ups, frames = _clicked(spark, sf)
    rows = frames.select("fly", "t", "part", F.array("value").alias("y"))
    history_ = ups.select("fly", "t", F.when(F.col("x").isNotNull(), F.array(F.element_at("x", 1))).alias("x"))
    fitted = timing.reverse_models(timing.offset_sums(rows.where("part <> 'test'"), history_, [0], ["fly"]), ["fly"], TIMING_LAGS)
    named = {"run_id": F.lit("r0"), "roi": F.lit("value")}
    models = kept(fitted.withColumns(named | {"pixel": F.lit(0)}), "models")
    clicks = ranked(plain_events(spark, sf).where("fly = 'click'").withColumn("_all", F.lit(1)), ["_all"], "t", "event_id")
    stimulus_ = kept(clicks.select((F.col("rn") - 1).alias("u"), F.array(F.col("value").cast("double"), F.col("user_id").cast("double")).alias("x")), "stimulus")
    tests = kept(frames.where("part = 'test'").withColumns(named).select("fly", "run_id", "roi", F.col("event_id").alias("t"), "u", F.col("value").alias("actual")), "tests")
    sources = {"stimulus": parameters.content_hash(stimulus_), "responses": parameters.content_hash(tests)}
    folder = new_folder(spark, "parameters")
    version = parameters.save(models, parameters.predict(models, tests, stimulus_), folder, sources, {"lags": TIMING_LAGS})
    found = parameters.replay(parameters.load(spark, folder, version), tests, stimulus_, sources)
    return found.select("fly", F.col("t").alias("event_id"), r6("predicted"), "actual")


@query
def eligible_history(spark, sf):
    return history.eligible(events(spark, sf), HISTORY).select("event_id", "rn")


@query
def lagged_design(spark, sf):
    x = history.lagged(events(spark, sf), ["fly"], "value", HISTORY)
    return x.select("event_id", *[F.col("x")[k].alias(f"lag_{k:02d}") for k in range(HISTORY)])


@query
def binned_design(spark, sf):
    return history.binned(events(spark, sf), ["fly"], "value", history.Bins(4, 10)).select("event_id", *[r6(f"b{b}") for b in range(4)])


def _ema(spark, sf, kind):
    e = plain_events(spark, sf).select("event_id", "user_id", "t", "value")
    if kind == "ema_baseline":
        return baseline.ema_baseline(e, ["user_id"], TAU).select("event_id", r6("baseline"))
    return baseline.candidate(e, ["user_id"], kind, TAU).select("event_id", r6("response"))


@query
def ema_baseline(spark, sf):
    return _ema(spark, sf, "ema_baseline")


@query
def ema_residual(spark, sf):
    return _ema(spark, sf, "ema_residual")


@query
def ema_dff(spark, sf):
    return _ema(spark, sf, "ema_dff")


@query
def range_median_baseline(spark, sf):
    e = plain_events(spark, sf).select("event_id", "user_id", "t", "value")
    return baseline.range_median(e, ["user_id"], 10 * HOUR).select("event_id", r6("baseline"))


@query
def block_median_residual(spark, sf):
    e = events(spark, sf).select("event_id", "fly", "t", "value", "rn")
    return baseline.candidate(e, ["fly"], "block_median_residual", block_us=10 * HOUR, lookback_us=60 * HOUR).select("event_id", r6("response", "residual"))


@query
def clock_summary(spark, sf):
    out = clocks.clock_summary(events(spark, sf), ["fly"])
    return out.select("fly", "count", "start_us", "end_us", "duplicate_or_reverse", "max_interval_us", "intervals_over_1p5x_median", *[F.round(c, 3).alias(c) for c in ("median_interval_us", "p01_interval_us", "p99_interval_us")])


@query
def trace_quality(spark, sf):
    out = scores.trace_quality(events(spark, sf), ["fly"])
    whole = {"fly", "count", "zero_count", "at_max_count", "robust_outlier_count", "abrupt_jump_count"}
    return out.select(*[c if c in whole else r6(c) for c in out.columns])


@query
def psd_peak(spark, sf):
    return scores.spectrum_peak(events(spark, sf), ["fly"], 1.0).select("fly", r6("psd_peak_hz"))


@query
def session_qc(spark, sf):
    e = events(spark, sf)
    ups = e.where("fly = 'click'").select("t", F.col("event_id").alias("update_id"))
    # values stand for the playback's jitter
    aligned = kept(clocks.asof(clocks.with_steps(e, ["fly"]).withColumn("played_us", F.col("t") - 10_000_000 - F.round(F.col("value") * 1000).cast("long")), ups, [], ["update_id"]), "aligned")
    middle = quantiles(aligned, ["fly"], {"median_interval_us": ("step", 0.5)})
    facts = middle.join(clocks.playback_alignment(aligned, ["fly"]), "fly")
    counts = aligned.groupBy("fly").agg(
        F.count("*").alias("frames"),
        F.count("update_id").alias("matched"),
        r6(F.avg((F.col("value") == 0).cast("double")), "zero_fraction"),
        (F.count_if(F.col("step") <= 0) == 0).alias("clock_increases"),
        (F.count("update_id") > 0).alias("overlaps_payload"),
    )
    return counts.join(facts.withColumns({c: F.round(c, 3) for c in ("median_interval_us", "playback_p99_abs_residual_ms")} | {"playback_offset_s": r6("playback_offset_s")}), "fly")


def _blocked(spark, sf, validation):
    return events(spark, sf).select("event_id", splits.blocked(HISTORY, validation).alias("split"))


@query
def split_blocked_50_20_30(spark, sf):
    return _blocked(spark, sf, True)


@query
def split_blocked_70_30(spark, sf):
    return _blocked(spark, sf, False)


@query
def split_global_labels(spark, sf):
    return events(spark, sf).where("fly = 'click'").withColumn("u", F.col("rn") - 1).select("event_id", "u", GLOBAL.label().alias("split"))


@query
def split_leak_check(spark, sf):
    e = events(spark, sf).withColumns({"split": splits.blocked(HISTORY, True), "u": F.col("rn") - 1})
    return splits.history_overlaps(e, ["fly"], HISTORY)


@query
def unpivot_long(spark, sf):
    return table(spark, sf, "lineitem").unpivot(["l_orderkey", "l_linenumber"], list(MEASURES), "roi", "value")


@query
def roi_global_index(spark, sf):
    rois = plain_events(spark, sf).select("fly", "user_id").distinct()
    sizes = rois.groupBy("fly").agg(F.count("*").alias("size"))
    # one row for each session
    ahead = F.coalesce(F.sum("size").over(Window.orderBy("fly").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = rois.withColumn("roi_index", F.row_number().over(Window.partitionBy("fly").orderBy("user_id")).cast("long") - 1)
    return own.join(sizes.select("fly", ahead.alias("ahead")), "fly").select("fly", "user_id", "roi_index", (F.col("ahead") + F.col("roi_index")).alias("global_roi_index"))


@query
def explain_row(spark, sf):
    row = events(spark, sf).where("event_id = 5")
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return row.join(names, "user_id", "left").select("event_id", "fly", "user_id", "rn", "t", "value", "c_name")


@query
def manifest_counts(spark, sf):
    e = events(spark, sf).withColumn("split", splits.blocked(HISTORY, True))
    return e.groupBy("fly", "split").agg(F.count("*").alias("observations"), F.count_distinct("user_id").alias("rois"))


@query
def split_pivot_counts(spark, sf):
    e = events(spark, sf).withColumn("split", splits.blocked(HISTORY, True))
    return e.groupBy("fly").pivot("split", ["train", "validation", "test", "purge"]).count().na.fill(0)


@query
def train_zscore(spark, sf):
    e = events(spark, sf).withColumn("split", splits.blocked(HISTORY, True))
    z = scores.scale(e, scores.scaler(e, ["fly"], "value"), ["fly"], "value")
    return z.select("event_id", "split", r6("z"), "zero_variance")


def _paired(spark, sf):
    e = with_lags(events(spark, sf)).withColumn("split", splits.blocked(HISTORY, True))
    return e.where("x2 is not null")


@query
def score_columns(spark, sf):
    e = _paired(spark, sf)
    variance = e.where("split = 'train'").groupBy("fly").agg(F.var_pop("value").alias("train_variance"))
    out = scores.score(e.join(variance, "fly"), ["fly"], "value", "x1", "train_variance")
    return out.select("fly", "n", *[r6(c) for c in ("r", "r2", "mse", "nmse")])


def _roi_scores(spark, sf, predicted="x1"):
    return scores.score(_paired(spark, sf), ["fly", "user_id"], "value", predicted)


@query
def score_summary(spark, sf):
    own = _roi_scores(spark, sf).withColumns({"r2": F.round("r2", 9), "responsive": F.coalesce(F.round("r", 9) > 0.2, F.lit(False))})
    out = scores.summarize(own, "fly", responsive="responsive")
    return out.select("fly", "scored", *[r6(c) for c in ("median_r2", "mean_r2", "fraction_positive_r2", "responsive_median_r2")])


def _labelled_vectors(spark, sf):
    v = table(spark, sf, "embeddings")
    rois = F.explode(F.array(F.struct(F.lit("label").alias("roi"), F.col("label").cast("double").alias("y")), F.struct(F.lit("cycle").alias("roi"), (F.col("vec_id") % 7).cast("double").alias("y"))))
    return v.select("vec_id", "embedding", rois.alias("r")).select("vec_id", "embedding", "r.roi", "r.y")


@query
def sta_kernel(spark, sf):
    return scores.covariance_kernel(_labelled_vectors(spark, sf), ["roi"], "embedding", "y").select("roi", F.col("i").cast("long").alias("i"), r6("k"))


@query
def sta_argmax_pixel(spark, sf):
    top = scores.peak(scores.covariance_kernel(_labelled_vectors(spark, sf), ["roi"], "embedding", "y"), ["roi"], 16)
    row, col = F.floor(F.col("pixel") / 4), F.col("pixel") % 4
    return top.select("roi", "pixel", row.alias("pixel_row"), col.alias("pixel_col"), (3 - row).alias("flipped_row"), (3 - col).alias("flipped_col"), r6("energy"))


@query
def calibrated_projection(spark, sf):
    return scores.calibrated(_paired(spark, sf), ["fly"], "value", "x1").select("fly", r6("gain"), r6("intercept"))


@query
def ridge_1d(spark, sf):
    return scores.ridge_1d(_paired(spark, sf), ["fly"], "value", "x1", 0.1).select("fly", r6("b1"), r6("intercept"))


@query
def ridge_2d(spark, sf):
    return scores.ridge_2d(_paired(spark, sf), ["fly"], "value", "x1", "x2", 0.1).select("fly", r6("b1"), r6("b2"), r6("intercept"))


@query
def predict_from_params(spark, sf):
    models = spark.createDataFrame([(f"roi{r}", [1.0 / (k + 1 + r) for k in range(4)], float(r)) for r in range(3)], "roi string, weights array<double>, intercept double")
    x = history.lagged(events(spark, sf), ["fly"], "value", 4)
    return scores.predict_lagged(x, models).select("event_id", "roi", r6("predicted"))


@query
def vector_projection(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    kernel = v.where("vec_id = 0").select(F.col("embedding").alias("kernel"), F.lit(1).alias("k"))
    # one row
    return v.withColumn("k", F.lit(1)).join(F.broadcast(kernel), "k").select("vec_id", r6(dot("embedding", "kernel"), "projection"))


@query
def gram_matrix(spark, sf):
    v = table(spark, sf, "embeddings").select(F.lit(0).alias("all"), F.col("embedding").alias("x"), F.array("label").alias("y"))
    cov = next(iter(moments(v, ["all"]).values())).cov
    return spark.createDataFrame([(i, j, float(c)) for (i, row) in enumerate(cov) for (j, c) in enumerate(row)], "i long, j long, c double").select("i", "j", r6("c"))


@query
def population_average(spark, sf):
    e = scores.equal_rows(events(spark, sf), ["fly"])
    mean = scores.population(e, [], "rn", "value").select("rn", r6("response", "mean_response"), "members")
    return mean.join(scores.population(e, [], "rn", "value", "median").select("rn", r6("response", "median_response")), "rn")


@query
def leave_one_out_readout(spark, sf):
    e = _paired(spark, sf)
    own = scores.calibrated(e, ["fly"], "value", "x1")
    few = scores.calibrated(e.where(F.col("rn") <= F.greatest(F.lit(50), F.floor(F.col("n") * 0.2))), ["fly"], "value", "x1")
    pairs = own.select(F.col("fly").alias("source"), F.col("gain").alias("g"), F.col("intercept").alias("b"), F.lit(1).alias("k")).join(own.select("fly", F.lit(1).alias("k")), "k").where("source <> fly")
    zero = pairs.groupBy("fly").agg(r6(F.median("g"), "zero_shot_gain"), r6(F.median("b"), "zero_shot_bias"), F.count("*").alias("sources"))
    return zero.join(few.select("fly", r6("gain", "few_shot_gain"), r6("intercept", "few_shot_bias")), "fly")


@query
def peer_median_control(spark, sf):
    daily = plain_events(spark, sf).groupBy("fly", F.floor(F.col("t") / DAY).alias("frame")).agg(F.avg("value").alias("v"))
    pairs = daily.join(daily.select(F.col("fly").alias("peer"), "frame", F.col("v").alias("w")), "frame").where("peer <> fly")
    peers = pairs.groupBy("fly", "frame").agg(F.first("v").alias("v"), F.median("w").alias("peer_median"))
    fit = scores.ridge_1d(peers, ["fly"], "v", "peer_median", 0.1)
    out = scores.score(peers.join(fit, "fly").withColumn("predicted", F.col("b1") * F.col("peer_median") + F.col("intercept")), ["fly"], "v", "predicted")
    return out.select("fly", "n", r6("r"), r6("r2"))


@query
def circular_shift_null(spark, sf):
    part = plain_events(spark, sf).groupBy("fly", F.floor(F.col("t") / (6 * HOUR)).alias("frame")).agg(F.avg("value").alias("v"))
    pairs = part.where("fly <> 'click'").join(part.where("fly = 'click'").select("frame", F.col("v").alias("predicted")), "frame")
    pairs = pairs.withColumn("rn", F.row_number().over(Window.partitionBy("fly").orderBy("frame")))
    return significance.circular_shift(pairs, ["fly"], "v", "predicted", 3).select("fly", r6("p"))


def _roi_p(spark, sf):
    own = plain_events(spark, sf).groupBy("fly", "user_id").agg(F.round(F.avg("value") / (1 + F.max("value")), 6).alias("p"), F.round(F.avg((F.col("value") < 10).cast("double")), 6).alias("zeros"))
    return own.withColumn("roi", F.concat_ws("/", "fly", "user_id"))


@query
def bh_qvalues(spark, sf):
    return significance.benjamini_hochberg(_roi_p(spark, sf)).select("roi", "p", r6("q"))


@query
def block_bootstrap_ci(spark, sf):
    return significance.block_bootstrap(_paired(spark, sf), ["fly"], "value", "x1").select("fly", *[r6(c) for c in ("r_low", "r_high", "r2_low", "r2_high")])


def _evidence(spark, sf):
    r = _roi_scores(spark, sf).select("fly", "user_id", F.round("r", 6).alias("r"))
    late = _roi_scores(spark, sf, "x2").select("fly", "user_id", F.round("r", 6).alias("late_r"))
    return _roi_p(spark, sf).join(r, ["fly", "user_id"], "left").join(late, ["fly", "user_id"], "left")


@query
def reliability_select(spark, sf):
    return _evidence(spark, sf).select("roi", "p", "r", "late_r", "zeros", scores.responsive("p", "r", "late_r", "zeros", alpha=0.3).alias("selected"))


@query
def rf_confidence(spark, sf):
    rows = _evidence(spark, sf).withColumn("stable", F.col("user_id") % 2 == 0)
    marked = rows.select("fly", scores.confidence("p", "r", "stable", "late_r", "zeros", "late_r", 0.4).alias("rf_confidence"))
    levels = ["HIGH_CONFIDENCE_RESPONSIVE", "MODERATE_CONFIDENCE", "LOW_CONFIDENCE", "NO_DETECTABLE_RF"]
    return marked.groupBy("fly").pivot("rf_confidence", levels).count().na.fill(0)


@query
def pairwise_energy_corr(spark, sf):
    long = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    maps = long.groupBy("label", "i").agg(F.avg(F.col("x").cast("double") * F.col("x").cast("double")).alias("energy"))
    return compare.pairwise_correlation(maps, "label", "i", "energy").select("label_a", "label_b", r6("r"))


@query
def paired_delta(spark, sf):
    own = lambda flag, c: table(spark, sf, "lineitem").where(F.col("l_returnflag") == flag).groupBy((F.col("l_suppkey") % 5).alias("fly"), F.col("l_suppkey").alias("roi")).agg(F.round(F.avg(c), 9).alias("r2"))
    model, base = own("R", "l_discount"), own("A", "l_tax")
    out = compare.delta_summary(compare.deltas(model, base, ["fly", "roi"]), "fly")
    return out.select("fly", "n", r6("median_delta"), r6("fraction_improved"), "positive_groups")


@query
def kernel_cosine(spark, sf):
    mean = lambda fold: table(spark, sf, "embeddings").where(F.col("vec_id") % 2 == fold).groupBy("label").agg(F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(64)]).alias("kernel"))
    return compare.kernel_cosine(mean(0), mean(1), ["label"]).select("label", r6("abs_cosine"))


@query
def candidate_select(spark, sf):
    e = _paired(spark, sf).withColumn("both", (F.col("x1") + F.col("x2")) / 2)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("ordinal"), F.lit(c).alias("kind"), F.col(c).alias("predicted")) for k, c in enumerate(("x1", "x2", "both"))]))
    long = e.select("fly", "value", kinds.alias("c")).select("fly", "value", "c.*")
    scored = long.groupBy("fly", "ordinal", "kind").agg(F.round(r_squared("value", "predicted"), 6).alias("r2"))
    return scored.groupBy("fly").agg(F.max_by("kind", F.struct("r2", -F.col("ordinal"))).alias("kind"), F.max("r2").alias("r2"))


@query
def stimulus_identity(spark, sf):
    return stimulus.differing_stimuli(table(spark, sf, "events"), "user_id", "event_type")


@query
def registry_upsert(spark, sf):
    """All events as old rows, and all with ids shifted by 50 as new ones."""
    e = table(spark, sf, "events")
    rows = lambda shift, note: e.select((F.col("event_id") + shift).alias("experiment_id"), F.col("event_type").alias("model"), F.lit(note).alias("notes"))
    return compare.upsert(rows(0, "old"), rows(50, "new"), fields=("experiment_id", "model", "fold", "notes"))


@query
def json_diff(spark, sf):
    """All events against all events with ids shifted by one."""
    e = table(spark, sf, "events")
    left = compare.flattened(e, "event_id", "props")
    right = compare.flattened(e.withColumn("event_id", F.col("event_id") - 1), "event_id", "props")
    return compare.json_diff(left, right).select("id", "path", "status", "delta")


@query
def csv_profile(spark, sf):
    rows = table(spark, sf, "lineitem").select(*[F.col(c).cast("string").alias(c) for c in ("l_orderkey", "l_returnflag", "l_quantity")])
    return inventories.csv_profile(rows)


FILE_RULES = (("name", r"\.html$", "document", True), ("name", r"^[0-9]+#top$", "anchor", True), ("folder", "^(en|fr)$", "west", True), ("both", r"^de/[0-9]+", "numbered", False))


@query
def file_role(spark, sf):
    category, used = inventories.by_rules(F.col("url"), FILE_RULES)
    return table(spark, sf, "pages").select("page_id", category.alias("category"), used.alias("used"))


@query
def json_profile(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.array_join(F.json_object_keys("props"), ",").alias("keys")).agg(F.count("*").alias("n"), F.count_distinct(F.get_json_object("props", "$.k")).alias("kinds"))


@query
def file_inventory(spark, sf):
    return inventories.inventory(spark, sf, "*.parquet")


def _records(spark, sessions, fit):
    out = spark.createDataFrame(linear.records(sessions, fit), "model string, session string, response int, r double, r2 double, mse double, nmse double")
    return out.select("model", "session", "response", *[r6(c) for c in ("r", "r2", "mse", "nmse")])


def _model(name: str, build) -> None:
    def run(spark, sf):
        sessions = session_moments(spark, sf)
        return _records(spark, sessions, build(sessions))

    QUERIES[name] = run


_model("ridge_multi", linear.individual_ridge)
_model("individual_pixel", lambda s: linear.individual_pixel(s, 4))
_model("reverse_correlation", lambda s: linear.sta(s, 4))
_model("shared_kernel", linear.shared_kernel)
_model("hierarchical_deviation", lambda s: linear.hierarchical(s, linear.shared_kernel(s)))
_model("low_rank_basis", lambda s: linear.low_rank(s, linear.individual_ridge(s), 4))


@query
def pixel_model(spark, sf):
    return pixels.pixel_report(_numbered_vectors(spark, sf), 4, 4, exclusion=5)


@query
def population_ridge(spark, sf):
    """Training, validation and refitted rows are the first of each session, equally many; test rows are all."""
    rows = embedding_sessions(spark, sf).where("split <> 'purge'").withColumn("y", F.array((F.col("y")[0] + F.col("y")[1]) / 2))
    kept = rows.where("split <> 'test'").withColumn("part", F.explode(F.array("split", F.lit("fit"))))
    parts = scores.equal_parts(kept, ["session"], "part").unionByName(rows.where("split = 'test'").withColumn("part", F.col("split")))
    sessions: dict = {}
    for (s, part), m in sorted(moments(parts, ["session", "part"]).items()):
        sessions.setdefault(s, {})[part] = m
    return _records(spark, sessions, linear.population_ridge(sessions))


@query
def leave_one_session_out(spark, sf):
    sessions = session_moments(spark, sf)
    rows = embedding_sessions(spark, sf).where("split = 'train'")
    count = F.count("*").over(Window.partitionBy("session"))
    few = moments(rows.withColumn("_n", count).where(F.col("rn") <= F.greatest(F.lit(50), F.floor(F.col("_n") * 0.2))), ["session"])
    out = linear.leave_one_out(sessions, {s: m for (s,), m in few.items()})
    return spark.createDataFrame(out, "heldout string, response int, mode string, r double, r2 double, mse double, alpha double")


@query
def rank_one_energy(spark, sf):
    sessions = session_moments(spark, sf)
    energy = linear.sta(sessions, 4).extra["rank_one_energy"]
    return spark.createDataFrame([(s, r, float(v)) for s, own in energy.items() for r, v in enumerate(own)], "session string, response int, energy_fraction double")


def _candidate_vectors(spark, sf):
    rows = experiments.numbered(embedding_sessions(spark, sf).drop("split"), ["session"], "vec_id")
    return kept(experiments.with_candidates(rows.withColumn("t", F.col("rn") * 1_000_000), ["session"], "t", CANDIDATE_TAU), "candidates")


@query
def candidate_summary(spark, sf):
    out = experiments.candidate_summary(_candidate_vectors(spark, sf))
    return out.select("session", "candidate", r6("median_split_half_kernel_r"), r6("median_late_projection_r"), "positive_late_projection_count")


@query
def experiment_matrix(spark, sf):
    rows = _candidate_vectors(spark, sf)
    folds = experiments.fold_labels(4, {"fold_a": (0.5, 0.7, 1.0), "fold_b": (0.4, 0.6, 0.8)})
    return experiments.run_matrix(rows, folds, 4)


@query
def experiment_single(spark, sf):
    """All families on one entry of the vectors, where each has a closed form."""
    rows = embedding_sessions(spark, sf).withColumns({"x": F.array(F.col("x")[3].cast("double")), "y": F.concat(*["y"] * len(experiments.CANDIDATES))})
    out = experiments.run_matrix(rows, {"all": F.col("split")}, 1, tuple(experiments.MODELS))
    return out.select("model", "session", "response", *[r6(c) for c in ("r", "r2", "mse", "nmse")])


@query
def pixel_single_bin(spark, sf):
    """The pixel report on the vectors' first 16 entries as one bin of 4 by 4 pixels."""
    rows = _numbered_vectors(spark, sf).withColumn("x", F.slice("x", 1, 16))
    out = pixels.pixel_report(rows, 1, 4, exclusion=5)
    rounded = ("validation_r2", "test_r", "test_r2", "constant_baseline_test_r2", "shift_null_p", "shift_null_q")
    return out.select(*[r6(c) if c in rounded else c for c in out.columns])


@query
def residual_network(spark, sf):
    """A network of 4 lags of 4 by 4 pixels beside the pixel model, for each session of vectors."""
    rows = kept(_numbered_vectors(spark, sf).select("session", "rn", "split", "x", "y"), "vectors")
    shape = network.Shape(4, 4, 4, 2)
    nets, _ = network.fit(rows, experiments.sessions_of(rows), shape, max_epochs=8, patience=3, rate=0.003)
    return network.held_out_scores(rows, nets, shape)


@query
def processed_target(spark, sf):
    e = events(spark, sf).select("event_id", "fly", "t", "value", "rn", "n")
    z = experiments.process_target(e, ["fly"], "ema_residual", HISTORY, splits.blocked(HISTORY, True), tau_seconds=TAU)
    return z.select("event_id", "split", r6("z"))


@query
def replay_check(spark, sf):
    """All events against a replay with some values changed and the first ten events missing."""
    e = events(spark, sf).select("event_id", F.col("value").alias("predicted"))
    current = e.where("event_id >= 10").withColumn("predicted", F.col("predicted") + F.when(F.col("event_id") % 50 == 0, 1.0).otherwise(0.0))
    return experiments.replay_differences(e, current, ["event_id"]).select("event_id", r6("saved"), r6("current"))


@query
def validation_rollup(spark, sf):
    rows = significance.benjamini_hochberg(_evidence(spark, sf)).select(F.col("r").alias("validation_r2"), F.col("late_r").alias("test_r2"), F.round("q", 6).alias("q"))
    return experiments.validation_rollup(rows, 0.05, 0.9)


@query
def dataset_diagnostics(spark, sf):
    e = events(spark, sf).withColumn("split", splits.blocked(HISTORY, True))
    out = experiments.dataset_diagnostics(e, ["fly"], "user_id")
    return out.select("fly", "observations", "rois", r6("median_train_sd"), r6("median_drift"))


def _numbered_vectors(spark, sf):
    rows = experiments.numbered(embedding_sessions(spark, sf).drop("rn"), ["session"], "vec_id")
    return rows.withColumn("x", F.transform("x", lambda v: v.cast("double")))


@query
def training_reliability(spark, sf):
    return reliability.training_reliability(_numbered_vectors(spark, sf), 4, 4, exclusion=5)


@query
def field_quality(spark, sf):
    found = pixels.pixel_report(_numbered_vectors(spark, sf), 4, 4, exclusion=5)
    pixel = found.select("session", "response", F.col("shift_null_q").alias("q"), "test_r", F.col("pixel_stable").alias("stable"))
    return reliability.field_quality(_numbered_vectors(spark, sf), pixel, 4, 4, exclusion=5)


@query
def common_mode_control(spark, sf):
    found = pixels.pixel_report(_numbered_vectors(spark, sf), 4, 4, exclusion=5)
    columns = F.array(*[(16 * b + 4 * F.col("pixel_row") + F.col("pixel_col")).cast("int") for b in range(4)])
    fields = found.select("session", "response", columns.alias("columns"))
    return reliability.common_mode(_numbered_vectors(spark, sf), fields)
