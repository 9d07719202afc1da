"""Work in stretches gives what the same work on whole traces gives, wherever the cuts fall."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonloom.operators import baseline, clocks, stretches, timing


def plain_ema(t, x, tau_seconds):
    out = [x[0]]
    for k in range(1, len(x)):
        out.append(out[-1] - math.expm1(-(t[k] - t[k - 1]) / 1e6 / tau_seconds) * (x[k] - out[-1]))
    return np.array(out)


def rows_of(spark, names, *traces):
    return spark.createDataFrame([(name, k, int(t), float(v), k + 1) for name, (ts, vs) in zip(names, traces) for k, (t, v) in enumerate(zip(ts, vs))], "fly string, event_id long, t long, value double, rn long")


@pytest.mark.parametrize("rows", [1, 3, 100])
def test_lags_and_sums_reach_over_cuts(spark, rows):
    df = rows_of(spark, "ab", (range(20), range(20)), (range(7), range(100, 107)))
    got = stretches.in_stretches(df, ["fly"], 4, lambda w: {"back": F.lag("value", 4).over(w), "total": F.sum("value").over(w.rowsBetween(-4, 0))}, rows=rows)
    assert got.count() == 27 and set(got.columns) == {*df.columns, "back", "total"}
    for r in got.where("rn >= 5").collect():
        assert r.back == r.value - 4 and r.total == 5 * r.value - 10
    assert all(r.back is None for r in got.where("rn < 5").collect())


@pytest.mark.parametrize(("rows", "span"), [(4096, 300.0), (5, 300.0), (1, 300.0), (7, 2.0)])
def test_exponential_average_over_cuts(spark, monkeypatch, rows, span):
    monkeypatch.setattr(stretches, "SPAN", span)
    rng = np.random.default_rng(5)
    own = {}
    for name, n in (("a", 83), ("b", 1), ("c", 40)):
        t = np.cumsum(rng.integers(1, 3_000_000, n))
        t[n // 2 :] += 10_000_000_000 * (name == "c")
        own[name] = t, rng.normal(50, 20, n)
    df = rows_of(spark, own, *own.values())
    gain = -F.expm1(-(F.col("t") - F.col("_before")) / 3e6) * F.col("value")
    got = stretches.decayed(df, ["fly"], "t", gain, F.col("value"), 3e6, "b", rows=rows)
    for name, (t, x) in own.items():
        found = [r.b for r in got.where(F.col("fly") == name).orderBy("rn").collect()]
        assert np.allclose(found, plain_ema(t, x, 3.0), rtol=1e-12)


def test_exponential_average_of_equal_times_and_an_empty_table(spark):
    df = rows_of(spark, "a", ([0, 5, 5, 9], [1, 2, 3, 4]))
    assert [round(r.baseline, 9) for r in baseline.ema_baseline(df, ["fly"], 1e-6).orderBy("rn").collect()] == [round(v, 9) for v in plain_ema([0, 5, 5, 9], [1.0, 2, 3, 4], 1e-6)]
    assert baseline.ema_baseline(df.limit(0), ["fly"]).count() == 0
    with pytest.raises(ValueError):
        baseline.ema_baseline(df, ["fly"], 0)


@pytest.mark.parametrize("few", [1, 4, 10_000])
def test_quantiles_are_exact(spark, few):
    rng = np.random.default_rng(6)
    own = {"wide": rng.normal(size=400) * 10.0 ** rng.integers(-200, 200, 400), "tied": np.repeat([0.0, 1.0, 2.5], [200, 3, 100]), "one": np.array([7.0]), "flat": np.full(50, -3.0), "far": np.array([-1.7e308, 0.0, 1.7e308, 5.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in own.items() for v in vs] + [("tied", None), ("tied", float("nan")), ("none", None)], "fly string, v double")
    qs = {"low": 0.01, "half": 0.5, "high": 0.99}
    got = {r.fly: r for r in stretches.quantiles(df, ["fly"], {k: ("v", q) for k, q in qs.items()} | {"size": (F.abs("v"), 0.5)}, few=few, bins=4).collect()}
    for k, v in own.items():
        s = np.sort(v)
        for name, q in qs.items():
            at = q * (len(s) - 1)
            low, high = s[int(at)], s[min(int(at) + 1, len(s) - 1)]
            assert got[k][name] == pytest.approx(low + (high - low) * (at - int(at)), rel=1e-12), (k, name)
        assert got[k]["size"] == pytest.approx(np.median(np.abs(v)), rel=1e-12)
    assert got["none"].half is None and len(got) == 6


def test_playback_alignment(spark):
    df = spark.createDataFrame([("a", 10_000_000 + k * 1000 + j, k * 1000) for k, j in enumerate([0, 10, 20, 30, 1000])], "fly string, t long, played_us long")
    row = clocks.playback_alignment(df, ["fly"]).first()
    assert row.playback_offset_s == pytest.approx(10.00002) and row.playback_p99_abs_residual_ms == pytest.approx(np.quantile([0.02, 0.01, 0, 0.01, 0.98], 0.99))


def timed(spark, seed=11):
    """Two sessions, two responses, two lags; frames before the first and after the last update too."""
    rng = np.random.default_rng(seed)
    ups, frames = [], []
    for s in "ab":
        t = np.sort(rng.choice(4000, 60, replace=False)) + 500
        x = rng.normal(size=(60, 2, 2))
        ups += [(s, int(v), None if k < 2 else x[k].tolist()) for k, v in enumerate(t)]
        frames += [(s, int(v), str(p), rng.normal(size=2).tolist()) for v, p in zip(rng.choice(5000, 300, replace=False), rng.choice(["first", "second", "test"], 300))]
    models = [(s, r, rng.normal(size=2).tolist(), float(r)) for s in "ab" for r in range(2)]
    return (
        spark.createDataFrame(frames, "fly string, t long, part string, y array<double>"),
        spark.createDataFrame(ups, "fly string, t long, x array<array<double>>"),
        spark.createDataFrame(models, "fly string, response int, kernel array<double>, bias double"),
    )


@pytest.mark.parametrize("width", [300, 100_000])
def test_offset_scores_equal_a_plain_replay(spark, width):
    frames, ups, models = timed(spark)
    offsets = [-450, -30, 0, 700]
    got = {(r.fly, r.response, r.offset_us): r for r in timing.offset_scores(frames, ups, models, offsets, ["fly"], 2, width=width).collect()}
    own = {(r.fly, r.response): r for r in models.collect()}
    for s in "ab":
        u = sorted(((r.t, r.x) for r in ups.where(F.col("fly") == s).collect()), key=lambda v: v[0])
        at = np.array([v[0] for v in u])
        f = frames.where(F.col("fly") == s).collect()
        for o in offsets:
            met = [(r, u[k][1]) for r in f if (k := int(np.searchsorted(at, r.t + o, side="right")) - 1) >= 0 and u[k][1]]
            for r in range(2):
                part = lambda p: (np.array([x[r] for g, x in met if g.part == p]), np.array([g.y[r] for g, _ in met if g.part == p]))  # noqa: E731, B023
                x, y = part("test")
                p = x @ np.array(own[s, r].kernel) + own[s, r].bias
                row = got[s, r, o]
                assert row.n == len(y) and row.r == pytest.approx(np.corrcoef(y, p)[0, 1]) and row.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
                k = [np.array([np.cov(x[:, j], y, bias=True)[0, 1] for j in range(2)]) for x, y in map(part, ("first", "second"))]
                a, b = (v - v.mean() for v in k)
                assert row.filter_strength == pytest.approx(np.linalg.norm(k[0])) and row.split_half_r == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    summary = timing.timing_sensitivity(spark.createDataFrame(list(got.values())), ["fly"]).where("fly = 'a' and offset_us = 0").first()
    assert summary.median_test_r == pytest.approx(np.mean([got["a", r, 0].r for r in range(2)])) and summary.positive_r_count == sum(got["a", r, 0].r > 0 for r in range(2))


def test_zero_offset_must_replay(spark):
    frames, ups, models = timed(spark)
    inside = clocks.asof(frames.where("part = 'test'"), ups, ["fly"], ["x"], width=300).where("x is not null").join(
        models.groupBy("fly").agg(F.sort_array(F.collect_list(F.struct("response", "kernel", "bias"))).alias("m")), "fly"
    )
    saved = F.transform("x", lambda x, r: F.aggregate(F.zip_with(x, F.element_at("m", r + 1)["kernel"], lambda a, b: a * b), F.element_at("m", r + 1)["bias"], lambda s, v: s + v))
    rows = inside.select("fly", "t", "part", "y", saved.alias("saved"))
    timing.check_zero_offset(rows, ups, models, "saved", ["fly"], width=300)
    for bad in (rows.withColumn("saved", F.transform("saved", lambda v: v + 1e-6)), rows.withColumn("t", F.lit(1).cast("long"))):
        with pytest.raises(ValueError, match="Zero-offset"):
            timing.check_zero_offset(bad, ups, models, "saved", ["fly"], width=300)
