"""The feature table, saved models and the checks before fitting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonloom.operators import contracts
from photonloom.plans import experiments
from photonloom.sources import features, parameters


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_are_gathered_where_they_lie(spark):
    x = spark.createDataFrame([(u, [float(10 * u + k) for k in range(12)]) for u in range(40)], "u long, x array<double>")
    shared = features.write_features(x, "u", "x", 12)
    assert shared.columns[:2] == ("f00", "f01") and shared.read(spark).count() == 40
    frames = spark.createDataFrame([(k, k % 50) for k in range(200)], "frame long, update long")
    found = features.gather(frames, shared, "update", (5, 30), slice(3, 5))
    got = {(r.frame, r.update, r.f03, r.f04) for r in found.collect()}
    assert got == {(k, k % 50, 10.0 * (k % 50) + 3, 10.0 * (k % 50) + 4) for k in range(200) if 5 <= k % 50 < 30}
    plan = plan_of(features.gather(frames, shared, "update", (5, 30), slice(3, 5)))
    assert plan.count("Exchange hashpartitioning") == 1 and "PushedFilters: [IsNotNull(u), GreaterThanOrEqual(u,5), LessThan(u,30)" in plan
    assert "ReadSchema: struct<u:bigint,f03:double,f04:double>" in plan
    assert features.gather(frames, shared, "update").count() == 160
    with pytest.raises(ValueError, match="more than one row"):
        features.write_features(x.union(x.limit(1)), "u", "x", 12)


def stored(spark):
    """One fly, two responses of two lags, twelve updates of two pixels."""
    updates = spark.createDataFrame([(u, [float(u), float(-u * u)]) for u in range(12)], "u long, x array<double>")
    models = spark.createDataFrame([("f", "r", "a", 0, [2.0, 1.0], 0.5), ("f", "r", "b", 1, [1.0, 0.0], 0.0)], "fly string, run_id string, roi string, pixel int, kernel array<double>, bias double")
    frames = spark.createDataFrame([("f", "r", roi, 100 * k, u, float(k)) for roi in "ab" for k, u in enumerate((1, 2, 5, 11))], "fly string, run_id string, roi string, t long, u long, actual double")
    return models, frames, updates


def test_saved_models_replay(spark, tmp_path):
    models, frames, updates = stored(spark)
    got = {(r.roi, r.u): r.predicted for r in parameters.predict(models, frames, updates).collect()}
    assert got == {("a", u): 2.0 * u + (u - 1) + 0.5 for u in (1, 2, 5, 11)} | {("b", u): float(-u * u) for u in (1, 2, 5, 11)}
    sources, folder = {"stimulus": parameters.content_hash(updates), "responses": "x"}, str(tmp_path)
    name = parameters.save(models, parameters.predict(models, frames, updates), folder, sources, {"lags": 2})
    version = parameters.load(spark, folder, name)
    assert version.manifest["facts"] == {"lags": 2} and name == parameters.content_hash(models.repartition(3))
    assert parameters.replay(version, frames, updates, sources).count() == 8
    for bad in (sources | {"stimulus": "other"}, {"responses": "x"}, sources | {"more": "y"}):
        with pytest.raises(ValueError, match="Sources differ"):
            parameters.replay(version, frames, updates, bad)
    with pytest.raises(ValueError, match="differ"):
        parameters.replay(version, frames.withColumn("actual", F.col("actual") + 1e-12), updates, sources)
    with pytest.raises(ValueError, match="differ"):
        parameters.replay(version, frames, updates.withColumn("x", F.transform("x", lambda v: v * 1.001)), sources)
    with pytest.raises(ValueError, match="differ"):
        parameters.replay(version, frames.where("t > 0"), updates, sources)
    version.models.withColumn("bias", F.col("bias") + 1).write.mode("overwrite").partitionBy("fly", "run_id").parquet(f"{folder}/{name}/models2")
    (tmp_path / name / "models").rename(tmp_path / name / "old")
    (tmp_path / name / "models2").rename(tmp_path / name / "models")
    with pytest.raises(ValueError, match="differ from what was saved"):
        parameters.load(spark, folder, name)
    with pytest.raises(ValueError, match="no models"):
        parameters.save(models.limit(0), frames.withColumn("predicted", F.lit(0.0)), folder, {})
    with pytest.raises(ValueError, match="More than one model"):
        parameters.save(models.union(models), frames.withColumn("predicted", F.lit(0.0)), folder, {})


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (lambda m, f, u: (m.withColumn("kernel", F.expr("if(roi = 'a', array(2.0D), kernel)")), f, u), "length"),
        (lambda m, f, u: (m.withColumn("kernel", F.array(F.lit(float("nan")), F.lit(1.0))), f, u), "finite"),
        (lambda m, f, u: (m.withColumn("kernel", F.expr("cast(array() as array<double>)")), f, u), "missing"),
        (lambda m, f, u: (m.withColumn("bias", F.lit(None).cast("double")), f, u), "finite"),
        (lambda m, f, u: (m.withColumn("pixel", F.lit(2)), f, u), "outside"),
        (lambda m, f, u: (m, f, u.where("u <> 3")), "gaps"),
        (lambda m, f, u: (m, f.withColumn("u", F.lit(0).cast("long")), u), "history"),
        (lambda m, f, u: (m, f.withColumn("u", F.lit(12).cast("long")), u), "history"),
        (lambda m, f, u: (m, f.withColumn("u", F.lit(None).cast("long")), u), "history"),
        (lambda m, f, u: (m, f.withColumn("roi", F.lit("z")), u), "absent"),
    ],
)
def test_replay_checks_its_inputs(spark, change, message):
    with pytest.raises(ValueError, match=message):
        parameters.predict(*change(*stored(spark)))


GOOD = dict(fly="f", run_id="r", clock_rows=10, display_frames=10, frame_clock_rows=5, response_rows=5, playback_rows=10, back_steps=0, payload_end=9, last_update_start=7, matched_frames=3)


@pytest.mark.parametrize(
    ("change", "message"),
    [({"clock_rows": 9}, "Row counts"), ({"response_rows": 6}, "Row counts"), ({"playback_rows": 9}, "Playback"), ({"back_steps": 1}, "grow"), ({"payload_end": 10}, "Payload"), ({"last_update_start": 9}, "Payload"), ({"matched_frames": 0}, "overlap"), ({"back_steps": None}, "grow")],
)
def test_alignment_must_hold(spark, change, message):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in GOOD.items())
    contracts.check_alignment(spark.createDataFrame([tuple(GOOD.values())], schema), ["fly", "run_id"])
    bad = spark.createDataFrame([tuple(GOOD.values()), tuple((GOOD | {"fly": "odd"} | change).values())], schema)
    with pytest.raises(ValueError, match=f"{message}.*odd"):
        contracts.check_alignment(bad, ["fly", "run_id"])


def test_one_session_and_shared_tables(spark):
    s = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2")], "fly string, run_id string")
    assert contracts.one_session(s, fly="b", run_id="2").count() == 1
    with pytest.raises(ValueError, match="More than one"):
        contracts.one_session(s, fly="b")
    with pytest.raises(ValueError, match="No session"):
        contracts.one_session(s, fly="c")
    rows = lambda *r: spark.createDataFrame(list(r), "fly string, run_id string, y array<double>, features string")
    contracts.check_shared(rows(("a", "1", [1.0], "t"), ("a", "1", [2.0], "t"), ("b", "1", [1.0, 2.0], "t")), ["fly", "run_id"])
    for bad, message in (
        (rows(("a", "1", [1.0], "t"), ("a", "2", [1.0], "t")), "distinct"),
        (rows(("a", "1", [1.0], "t"), ("a", "1", [1.0, 2.0], "t")), "shape"),
        (rows(("a", "1", [float("inf")], "t")), "shape"),
        (rows(("a", "1", None, "t")), "shape"),
        (rows(("a", "1", [1.0], "t"), ("b", "1", [1.0], "u")), "one feature table"),
    ):
        with pytest.raises(ValueError, match=message):
            contracts.check_shared(bad, ["fly", "run_id"])


def test_candidates_and_their_choice(spark):
    rng = np.random.default_rng(3)
    n = 400
    x = rng.choice([-1.0, 1.0], size=(n, 4))
    drift = 40 + 25 * np.sin(np.arange(n) / 60)
    y = np.stack([drift + 4 * x[:, 1], drift * 0.5 - 2 * x[:, 1]], axis=1)
    rows = spark.createDataFrame([("s", k + 1, n, k * 1_000_000, x[k].tolist(), y[k].tolist()) for k in range(n)], "session string, rn long, n long, t long, x array<double>, y array<double>")
    wide = experiments.with_candidates(rows, ["session"], "t", 5.0)
    one = wide.where("rn = 1").first().y
    assert one[:2] == y[0].tolist() and one[2:4] == [0.0, 0.0] and len(one) == 6
    split = F.when(F.col("rn") <= 200, "train").when(F.col("rn") <= 300, "validation").otherwise("test")
    sessions = experiments.sessions_of(wide.withColumn("split", split))
    kind, found = experiments.selected_kind(sessions)
    assert kind != "raw" and found[kind] > found["raw"] + 0.2
    out = experiments.run_matrix(wide, {"a": split}, 1).collect()
    assert {r.model for r in out} == {*experiments.MODELS, *experiments.SELECTED} and len(out) == 22
    r2 = {(r.model, r.response): r.r2 for r in out}
    assert min(r2["individual_ridge_selected_response", k] for k in (0, 1)) > 0.5 > max(r2["individual_ridge", k] for k in (0, 1))
    assert all(r.response_kind == (kind if r.model in experiments.SELECTED else "raw") for r in out)
    changed = wide.withColumn("y", F.when(F.col("rn") > 300, F.transform("y", lambda v: v * 0 + 9.0)).otherwise(F.col("y")))
    assert experiments.selected_kind(experiments.sessions_of(changed.withColumn("split", split))) == (kind, found)
    summary = {r.candidate: r for r in experiments.candidate_summary(wide).collect()}
    assert set(summary) == set(experiments.CANDIDATES) and summary["ema_residual"].median_late_projection_r > summary["raw"].median_late_projection_r
    first, late = slice(0, 140), slice(280, n)
    k = (x[first] - x[first].mean(axis=0)).T @ (y[first] - y[first].mean(axis=0)) / 140
    want = [np.corrcoef(y[late, r], x[late] @ k[:, r])[0, 1] for r in range(2)]
    assert summary["raw"].median_late_projection_r == pytest.approx(np.median(want)) and summary["raw"].positive_late_projection_count == sum(v > 0 for v in want)
