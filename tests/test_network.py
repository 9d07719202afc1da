"""The residual network: its gradient, what it learns, and that test rows don't change it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonloom.operators import network
from photonloom.plans.experiments import sessions_of

SHAPE = network.Shape(2, 5, 4, 2)


def rows_of(spark, seed=3, n=600, names="ab"):
    """One response is a product of pixels, which no linear model has, the other a pixel."""
    rng = np.random.default_rng(seed)
    rows = []
    for s in names:
        x = rng.choice([-1.0, 1.0], size=(n, 40))
        y = np.stack([3 * x[:, 6] * x[:, 7] + x[:, 6] + 10, 2 * x[:, 9] + 0.5 * rng.normal(size=n)], axis=1)
        split = lambda k: "train" if k < 0.6 * n else "validation" if k < 0.8 * n else "test"
        rows += [(s, k, split(k), x[k].tolist(), y[k].tolist()) for k in range(n)]
    return spark.createDataFrame(rows, "session string, rn long, split string, x array<double>, y array<double>").repartition(3)


def test_gradient_is_the_slope():
    rng = np.random.default_rng(1)
    w = SHAPE.initial(2)
    w["head"] = rng.normal(size=w["head"].shape)
    images, aim = rng.normal(size=(7, 2, 5, 4)), rng.normal(size=(7, 2))
    loss = lambda v: ((network.output(v, images)[0] - aim) ** 2).sum()
    out, kept = network.output(w, images)
    slopes = network.gradient(w, kept, 2 * (out - aim))
    assert set(slopes) == set(w)
    for k, v in w.items():
        for at in {0, v.size // 2, v.size - 1}:
            up, down = ({**w, k: v + d * (np.arange(v.size) == at).reshape(v.shape)} for d in (1e-6, -1e-6))
            assert slopes[k].ravel()[at] == pytest.approx((loss(up) - loss(down)) / 2e-6, rel=1e-4, abs=1e-6), (k, at)


def test_network_learns_replays_and_ignores_test_rows(spark, tmp_path):
    rows = rows_of(spark).cache()
    sessions = sessions_of(rows)
    nets, curve = network.fit(rows, sessions, SHAPE, max_epochs=18, patience=12, rate=0.05)
    losses = [v for s, _, v in curve if s == "a"]
    assert min(losses) < 0.8 * losses[0] and all(n.epoch > 0 for n in nets.values())
    got = {(r.session, r.response): r for r in network.held_out_scores(rows, nets, SHAPE).collect()}
    assert all(got[s, 0].delta_r2 > 0.1 and got[s, 1].pixel_r2 > 0.8 for s in "ab")

    network.as_table(spark, nets).write.parquet(str(tmp_path / "nets"))
    again = network.from_table(spark.read.parquet(str(tmp_path / "nets")), SHAPE)
    first, second = ({(r.session, r.rn): (r.predicted, r.baseline) for r in network.predict(rows, own, SHAPE, ["rn"]).collect()} for own in (nets, again))
    assert first == second
    saved = network.predict(rows.where("split = 'test'"), nets, SHAPE, ["rn"])
    network.check_baseline(rows, again, SHAPE, saved, ["rn"])
    for bad in (saved.where("rn > 500"), saved.withColumn("baseline", F.transform("baseline", lambda v: v + 1e-6))):
        with pytest.raises(ValueError, match="baseline differs"):
            network.check_baseline(rows, again, SHAPE, bad, ["rn"])
    with pytest.raises(ValueError, match="shape"):
        network.from_table(network.as_table(spark, nets).where("name <> 'dense'"), SHAPE)

    changed = rows.withColumn("y", F.when(F.col("split") == "test", F.array(F.lit(9.0), F.lit(9.0))).otherwise(F.col("y")))
    other, _ = network.fit(changed, sessions_of(changed), SHAPE, max_epochs=18, patience=12, rate=0.05)
    assert all(np.allclose(nets[s].weights[k], other[s].weights[k], rtol=1e-9, atol=1e-12) for s in "ab" for k in nets[s].weights)


def test_without_gain_the_pixel_model_stays(spark):
    rows = rows_of(spark, n=60, names="a").withColumn("y", F.array(F.lit(1.0), F.lit(2.0)))
    nets, _ = network.fit(rows, sessions_of(rows), SHAPE, max_epochs=2, patience=1)
    assert nets["a"].epoch == 0
    assert all(r.predicted == r.baseline for r in network.predict(rows, nets, SHAPE, ["rn"]).collect())
    with pytest.raises(ValueError):
        network.fit(rows, sessions_of(rows), SHAPE, max_epochs=0)
    with pytest.raises(Exception, match="no network"):
        network.predict(rows.withColumn("session", F.lit("z")), nets, SHAPE, ["rn"]).collect()
