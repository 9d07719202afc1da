"""Models find what made synthetic responses, and moments give what rows give."""

import numpy as np
import pytest

from photonloom.operators import linear
from photonloom.operators.moments import Moments, moments

BINS, PIXELS = 3, 25


def sessions(seed=4, gains=(1.2, -0.8), pixel=7, noise=0.3, n=900):
    rng = np.random.default_rng(seed)
    kernel = np.zeros((BINS, PIXELS))
    kernel[:, pixel] = [1.0, 0.6, 0.3]
    out = {}
    for k, g in enumerate(gains):
        s = rng.choice([-1.0, 1.0], size=(n + BINS, PIXELS))
        x = np.stack([np.concatenate([s[i - b] for b in range(BINS)]) for i in range(BINS, n + BINS)])
        y = np.stack([g * x @ kernel.ravel() + 3 + noise * rng.normal(size=n), rng.normal(size=n)], axis=1)
        out[f"s{k}"] = {name: Moments.of(x[a:b], y[a:b]) for name, a, b in (("train", 0, 450), ("validation", 450, 630), ("test", 630, n))} | {"rows": (x, y)}
    return out


DATA = sessions()
PARTS = {s: {k: m for k, m in p.items() if k != "rows"} for s, p in DATA.items()}


def test_scores_from_moments_equal_those_of_rows():
    x, y = DATA["s0"]["rows"]
    fit = linear.individual_ridge(PARTS)
    p = x[630:] @ fit.beta["s0"] + fit.bias["s0"]
    got = PARTS["s0"]["test"].scores(fit.beta["s0"], fit.bias["s0"])
    assert np.allclose(got["mse"], ((p - y[630:]) ** 2).mean(axis=0))
    assert np.allclose(got["r2"], 1 - ((p - y[630:]) ** 2).mean(axis=0) / y[630:].var(axis=0))
    assert np.allclose(got["r"], [np.corrcoef(p[:, r], y[630:, r])[0, 1] for r in range(2)])


def test_ridge_equals_the_normal_equation():
    m = PARTS["s0"]["train"]
    beta, _ = linear.Ridge(m).fit(0.1)
    assert np.allclose(beta, np.linalg.solve(m.cov + 0.1 * np.eye(len(m.sx)), m.cross))


@pytest.mark.parametrize(
    "build",
    [
        linear.individual_ridge,
        lambda s: linear.individual_pixel(s, BINS),
        lambda s: linear.sta(s, BINS),
        linear.shared_kernel,
        lambda s: linear.hierarchical(s, linear.shared_kernel(s)),
        lambda s: linear.low_rank(s, linear.individual_ridge(s), BINS),
    ],
)
def test_models_recover_signal_and_not_noise(build):
    got = {(r["session"], r["response"]): r["r2"] for r in linear.records(PARTS, build(PARTS))}
    assert got["s0", 0] > 0.7 and got["s1", 0] > 0.7
    assert got["s0", 1] < 0.2 and got["s1", 1] < 0.2


def test_pixel_and_direction():
    fit = linear.individual_pixel(PARTS, BINS)
    assert fit.extra["pixels"]["s0"][0] == 7 and fit.extra["pixels"]["s1"][0] == 7
    k = linear.shared_kernel(PARTS)
    assert linear.cosine(k.extra["kernel"], linear.shared_kernel(PARTS, weighting="equal_response").extra["kernel"]) > 0.9
    assert np.sign(k.extra["gains"]["s0"][0]) == -np.sign(k.extra["gains"]["s1"][0])


def test_population_and_left_out():
    one = {s: {k: Moments(m.n, m.sx, m.xx, m.sy[:1], m.xy[:, :1], m.yy[:1]) for k, m in p.items()} for s, p in {"s0": PARTS["s0"], "s2": {k: m for k, m in sessions(9, (1.2,))["s0"].items() if k != "rows"}}.items()}
    assert min(r["r2"] for r in linear.records(one, linear.population_ridge(one))) > 0.8
    few = linear.leave_one_out(one, {s: p["train"] for s, p in one.items()})
    assert min(r["r2"] for r in few if r["mode"] == "few_shot_readout") > 0.8


def test_future_rows_leave_choice_alone():
    changed = {s: p | {"test": Moments.of(np.ones((10, BINS * PIXELS)), np.full((10, 2), 9.0))} for s, p in PARTS.items()}
    a, b = linear.individual_pixel(PARTS, BINS), linear.individual_pixel(changed, BINS)
    assert a.chosen == b.chosen and all(np.array_equal(a.beta[s], b.beta[s]) for s in a.beta)


def test_moments_of_rows_in_spark(spark):
    x, y = DATA["s0"]["rows"]
    df = spark.createDataFrame([("a" if k % 3 else "b", x[k, :4].tolist(), y[k].tolist()) for k in range(300)], "g string, x array<double>, y array<double>").repartition(5)
    got = moments(df, ["g"], fan_in=2)
    pick = [k for k in range(300) if k % 3]
    want = Moments.of(x[pick, :4], y[pick])
    assert got["a",].n == 200 and np.allclose(got["a",].xx, want.xx) and np.allclose(got["a",].xy, want.xy)
    assert np.allclose((want + want - want).yy, want.yy)


def test_rank_one():
    assert linear.rank_one(np.outer([1.0, 2, 3], [1.0, -1]).ravel(), 3)[1] == pytest.approx(1.0)
    assert linear.rank_one(np.eye(3).ravel(), 3)[1] < 0.5


def test_reliability_finds_the_driven_response(spark):
    from photonloom.plans.reliability import common_mode, field_quality, training_reliability

    x, y = DATA["s0"]["rows"]
    split = lambda k: "train" if k < 450 else "validation" if k < 630 else "test"
    rows = spark.createDataFrame([("s0", k + 1, len(x), split(k), x[k].tolist(), y[k].tolist()) for k in range(len(x))], "session string, rn long, n long, split string, x array<double>, y array<double>")
    got = {r.response: r for r in training_reliability(rows, BINS, 5).collect()}
    assert got[0].train_defined_responsive and (got[0].peak_row, got[0].peak_col) == (1, 2) and got[0].validation_pixel_stable
    assert got[0].train_projection_r > got[1].train_projection_r
    pixel = spark.createDataFrame([("s0", 0, 0.01, 0.8, True)], "session string, response int, q double, test_r double, stable boolean")
    quality = {r.response: r.rf_confidence for r in field_quality(rows, pixel, BINS, 5).collect()}
    assert quality[0] == "HIGH_CONFIDENCE_RESPONSIVE" and quality[1] in ("LOW_CONFIDENCE", "NO_DETECTABLE_RF")
    columns = spark.createDataFrame([("s0", r, [7 + PIXELS * b for b in range(BINS)]) for r in (0, 1)], "session string, response int, columns array<int>")
    control = {r.response: r for r in common_mode(rows, columns, 0.01).collect()}
    assert control[0].pixel_plus_peer_test_r2 > 0.8 and control[0].incremental_r2 > 0.7 and abs(control[1].incremental_r2) < 0.1
