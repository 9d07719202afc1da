"""Small exact cases, broken contracts, and the rule that the future never moves the past."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonloom.operators import baseline, clocks, compare, history, scores, significance, splits, transforms


def trace(spark, values, step=1_000_000):
    return spark.createDataFrame([(k, "f", k * step, float(v), k + 1, len(values)) for k, v in enumerate(values)], "event_id long, fly string, t long, value double, rn long, n long")


def assert_causal(spark, transform, columns):
    """Rows before a change are identical with and without it."""
    rng = np.random.default_rng(3)
    values = rng.normal(5, 1, 60)
    changed = values.copy()
    changed[45:] = 999.0
    past = lambda v: sorted(transform(trace(spark, v)).where("event_id < 45").select("event_id", *columns).collect())
    assert past(values) == past(changed)


@pytest.mark.parametrize("kind", baseline.KINDS)
def test_candidates_are_causal(spark, kind):
    assert_causal(spark, lambda df: baseline.candidate(df, ["fly"], kind, block_us=5_000_000, lookback_us=20_000_000), ["response"])


def test_histories_and_scaler_are_causal(spark):
    assert_causal(spark, lambda df: history.binned(df, ["fly"], "value", history.Bins(2, 3)), ["b0", "b1"])
    assert_causal(spark, lambda df: history.lagged(df, ["fly"], "value", 5), ["x"])
    assert_causal(spark, lambda df: scores.scale(df, scores.scaler(df.withColumn("split", F.when(F.col("rn") < 30, "train").otherwise("test")), ["fly"], "value"), ["fly"], "value"), ["z"])


def test_lag_order_and_bins(spark):
    pixels = spark.createDataFrame([("f", k + 1, [2.0 * k, 2.0 * k + 1]) for k in range(5)], "fly string, rn long, px array<double>")
    got = {r.rn: r.x for r in history.lagged_vectors(pixels, ["fly"], "px", 2).collect()}
    assert got[3] == [4, 5, 2, 3] and got[4] == [6, 7, 4, 5] and 1 not in got
    ten = trace(spark, range(10))
    row = history.binned(ten, ["fly"], "value", history.Bins(2, 2)).where("rn = 6").first()
    assert (row.b0, row.b1) == (4.5, 2.5)


def test_asof_bounds(spark):
    ups = spark.createDataFrame([(100, 0), (200, 1), (300, 2)], "t long, u int")
    frames = spark.createDataFrame([(t,) for t in (99, 100, 199, 200, 349, 350, 400)], "t long")
    for width in (1000, 60):
        aligned = clocks.asof(frames, ups, [], ["u"], width=width)
        got = {r.t: r.u for r in clocks.in_payload(aligned, "u", 350).collect()}
        assert got == {100: 0, 199: 0, 200: 1, 349: 2}


def test_clock_contract(spark):
    with pytest.raises(ValueError, match="Non-increasing"):
        clocks.check_clock(spark.createDataFrame([("a", 1, 5), ("a", 2, 5)], "fly string, rn long, t long"), ["fly"])


def test_splits(spark):
    rows = spark.range(1, 601).withColumnRenamed("id", "rn").withColumns({"n": F.lit(600), "fly": F.lit("f")})
    labels = rows.withColumn("split", splits.blocked(18, True))
    first = {r.split: r.a - 1 for r in labels.groupBy("split").agg(F.min("rn").alias("a")).collect()}
    assert (first["train"], first["validation"], first["test"]) == (0, 318, 438)
    sparse = labels.withColumn("u", F.col("rn") - 1)
    assert not splits.history_overlaps(sparse, ["fly"], 18).where("overlaps").count()
    dense = labels.withColumn("u", F.floor((F.col("rn") - 1) / 4))
    assert splits.history_overlaps(dense, ["fly"], 18).where("overlaps").count() == 2
    with pytest.raises(ValueError):
        splits.check_blocked(rows.withColumn("n", F.lit(400)), ["fly"], 18, True)
    with pytest.raises(ValueError):
        splits.GlobalSplit(40, 30, 50, 60).validate(100)
    g = splits.GlobalSplit(4, 25, 36, 50)
    g.validate(60)
    assert g.intervals()["validation"] == (28, 36)


def test_scaler_of_constant_and_training_rows(spark):
    df = trace(spark, [1, 3, 100, 200]).withColumn("split", F.when(F.col("rn") <= 2, "train").otherwise("test"))
    s = scores.scaler(df, ["fly"], "value").first()
    assert (s.center, s.scale, s.zero_variance) == (2.0, 1.0, False)
    flat = scores.scaler(df.withColumn("value", F.lit(7.0)), ["fly"], "value").first()
    assert (flat.scale, flat.zero_variance) == (1.0, True)


def test_scores_of_a_constant_are_null(spark):
    row = scores.score(trace(spark, [2, 2, 2]).withColumn("p", F.col("rn")), ["fly"], "value", "p").first()
    assert row.r is None and row.r2 is None and row.mse is not None


def plain_shift_p(a, b, exclusion):
    r = np.array([abs(np.corrcoef(a, np.roll(b, -k))[0, 1]) for k in range(len(a))])
    null = r[exclusion : len(a) - exclusion]
    return (1 + (null >= r[0]).sum()) / (1 + len(null))


def test_shift_null(spark):
    rng = np.random.default_rng(8)
    x, noise = rng.normal(size=500), rng.normal(size=500)
    traces = {"signal": (x, x + rng.normal(size=500)), "noise": (x, noise), "flat": (np.ones(100), x[:100]), "odd": (x[:97], noise[:97])}
    df = spark.createDataFrame([(k, 40 + i, float(a), float(b)) for k, (u, v) in traces.items() for i, (a, b) in enumerate(zip(u, v))], "fly string, rn long, a double, b double")
    p = {r.fly: r.p for r in significance.circular_shift(df, ["fly"], "a", "b", 30).collect()}
    assert p["flat"] is None and p["signal"] < 0.05 and p["noise"] > 0.01
    for k in ("signal", "noise", "odd"):
        assert p[k] == pytest.approx(plain_shift_p(*traces[k], 30))
    assert {r.fly: r.p for r in significance.circular_shift(df.where("fly = 'flat'"), ["fly"], "a", "b", 5, compat=True).collect()} == {"flat": 1 / 91}
    with pytest.raises(Exception, match="no two rotations"):
        significance.circular_shift(df.where("fly = 'odd'"), ["fly"], "a", "b", 48).collect()


@pytest.mark.parametrize("lot", [2, 64])
def test_transforms_of_any_length(spark, monkeypatch, lot):
    monkeypatch.setattr(transforms, "LOT", lot)
    rng = np.random.default_rng(9)
    traces = {n: rng.normal(size=(2, n)) for n in (1, 2, 7, 64, 101)}
    df = spark.createDataFrame([(n, i, n, float(v[0, i]), float(v[1, i])) for n, v in traces.items() for i in range(n)], "k long, i long, n long, a double, b double").repartition(3)
    own = df.withColumnRenamed("k", "trace")
    power = {(r.trace, r.k): r.power for r in transforms.power_spectrum(own, ["trace"], "a", "i", "n").collect()}
    shifted = {(r.trace, r["shift"]): r.value for r in transforms.circular_correlation(own, ["trace"], "a", "b", "i", "n").collect()}
    assert len(power) == sum(n // 2 + 1 for n in traces) and len(shifted) == sum(traces)
    for n, (a, b) in traces.items():
        assert np.allclose([power[n, k] for k in range(n // 2 + 1)], np.abs(np.fft.rfft(a)) ** 2)
        assert np.allclose([shifted[n, s] for s in range(n)], [a @ np.roll(b, -s) for s in range(n)])


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.2), ("c", None)], "roi string, p double")
    assert {r.roi: r.q for r in significance.benjamini_hochberg(df).collect()} == {"a": 0.02, "b": 0.2, "c": None}
    rng = np.random.default_rng(1)
    p = rng.random(200) ** 3
    order = np.argsort(p)
    want = np.empty(200)
    want[order] = np.minimum(1, np.minimum.accumulate((p[order] * 200 / np.arange(1, 201))[::-1])[::-1])
    got = significance.benjamini_hochberg(spark.createDataFrame([(f"{k:03d}", float(v)) for k, v in enumerate(p)], "roi string, p double"))
    assert np.allclose([r.q for r in got.orderBy("roi").collect()], want)


@pytest.mark.parametrize("rows", [4096, 64])
def test_bootstrap_equals_plain_draws(spark, monkeypatch, rows):
    monkeypatch.setattr(significance, "ROWS", rows)
    rng = np.random.default_rng(2)
    x = rng.normal(size=303)
    y = x + rng.normal(0, 0.5, 303)
    df = spark.createDataFrame([("f", k, float(v), float(w)) for k, (v, w) in enumerate(zip(x, y))], "fly string, rn long, a double, p double")
    row = significance.block_bootstrap(df, ["fly"], "a", "p", 20, 100, seed=3).first()
    found = []
    for rep in range(100):
        draws = [int(int(hashlib.md5(f"3:{rep}:{k}".encode()).hexdigest()[:8], 16) / 2**32 * (303 - 20 + 1)) for k in range(16)]
        i = np.concatenate([np.arange(s, s + (20 if k < 15 else 3)) for k, s in enumerate(draws)])
        a, p = x[i], y[i]
        found.append((np.corrcoef(a, p)[0, 1], 1 - ((a - p) ** 2).sum() / ((a - a.mean()) ** 2).sum()))
    low, high = np.quantile(found, [0.025, 0.975], axis=0)
    assert np.allclose([row.r_low, row.r2_low, row.r_high, row.r2_high], [*low, *high]) and row.r_low < 0.9 < row.r_high < 1
    short = significance.block_bootstrap(df.where("rn < 5").withColumn("p", F.lit(1.0)), ["fly"], "a", "p", 20, 3).first()
    assert short.r_low is None and short.r2_low is not None


def test_bootstrap_draws_are_never_broadcast(spark):
    df = spark.range(300).select(F.lit("f").alias("fly"), F.col("id").alias("rn"), F.sin("id").alias("a"), F.cos("id").alias("p"))
    out = significance.block_bootstrap(df.unionByName(df.limit(1).withColumn("fly", F.lit("g"))), ["fly"], "a", "p", 20, 50)
    # a table of some rows becomes one of many times all rows, which Spark's estimates can't tell
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.fly: r.r is None for r in out.select("fly", F.col("r_low").alias("r")).collect()} == {"f": False, "g": True}


def test_registry_and_comparisons(spark):
    old = spark.createDataFrame([("a", "model_a"), ("b", "model_b")], "experiment_id string, model string")
    new = spark.createDataFrame([("a", "a_v2")], "experiment_id string, model string")
    assert sorted((r.experiment_id, r.model, r.notes) for r in compare.upsert(old, new).collect()) == [("a", "a_v2", ""), ("b", "model_b", "")]
    with pytest.raises(ValueError, match="Keys differ"):
        compare.check_same_keys(old, new, ["experiment_id"])
    js = lambda *rows: compare.flattened(spark.createDataFrame(list(rows), "id long, j string"), "id", "j")
    a, b = js((1, '{"x": 1.0, "y": {"z": "t"}}')), js((1, '{"x": 1.000000001, "y": {"z": "t", "w": 2}}'))
    assert compare.old_keys_preserved(a, b) and not compare.old_keys_preserved(b, a)
    assert compare.regression_class(compare.json_diff(a, b)) == "READABILITY_ONLY"
    assert compare.regression_class(compare.json_diff(a, js((1, '{"x": 1.1}')))) == "NUMERICAL_CHANGE"


def test_replay_and_guard(spark):
    from photonloom.plans import experiments

    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, predicted double")
    experiments.verify_replay(a, a.withColumn("predicted", F.col("predicted") + 1e-10), ["k"])
    with pytest.raises(ValueError, match="differ"):
        experiments.verify_replay(a, a.withColumn("predicted", F.col("predicted") + 1e-3), ["k"])
    with pytest.raises(ValueError, match="differ"):
        experiments.verify_replay(a, a.where("k = 1"), ["k"])
    assert len(experiments.guarded(a, 2)) == 2
    with pytest.raises(MemoryError):
        experiments.guarded(a, 1)


def test_target_is_transformed_before_it_is_cut(spark):
    from photonloom.plans.experiments import process_target

    df = trace(spark, [1, 9, 4, 7, 2, 8, 5, 6])
    z = process_target(df, ["fly"], "ema_residual", 3, F.when(F.col("rn") <= 6, "train").otherwise("test"), tau_seconds=5.0)
    whole = {r.event_id: r.response for r in baseline.candidate(df, ["fly"], "ema_residual", 5.0).collect()}
    got = {r.event_id: r.response for r in z.collect()}
    assert got == {k: v for k, v in whole.items() if k >= 2}
    train = [r.z for r in z.where("split = 'train'").collect()]
    assert abs(np.mean(train)) < 1e-9 and abs(np.std(train) - 1) < 1e-9


def test_confidence_and_selection(spark):
    rows = [("a", 0.01, 0.3, True, 0.2, 0.01, 0.1), ("b", 0.01, 0.3, False, 0.2, 0.01, 0.1), ("c", None, None, None, 0.2, None, 0.1), ("d", 0.5, 0.3, True, -0.1, 0.5, 0.1)]
    df = spark.createDataFrame(rows, "k string, q double, r double, s boolean, a double, p double, l double")
    got = {r.k: r.c for r in df.select("k", scores.confidence("q", "r", "s", "a", "p", "l").alias("c")).collect()}
    assert got == {"a": "HIGH_CONFIDENCE_RESPONSIVE", "b": "MODERATE_CONFIDENCE", "c": "LOW_CONFIDENCE", "d": "NO_DETECTABLE_RF"}
    chosen = df.select("k", scores.responsive("p", "r", "a", "l").alias("c")).collect()
    assert {r.k: r.c for r in chosen} == {"a": True, "b": True, "c": False, "d": False}


def test_equal_parts(spark):
    sizes = {("a", "train"): 5, ("b", "train"): 3, ("a", "fit"): 6, ("b", "fit"): 7}
    rows = [(f, p, k + 10) for (f, p), n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "fly string, part string, rn long")
    got = scores.equal_parts(df, ["fly"], "part").groupBy("fly", "part").agg(F.count("*").alias("n"), F.max("rn").alias("last")).collect()
    assert {(r.fly, r.part): (r.n, r["last"]) for r in got} == {("a", "train"): (3, 12), ("b", "train"): (3, 12), ("a", "fit"): (6, 15), ("b", "fit"): (6, 15)}
