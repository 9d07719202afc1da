"""Pages of figures: what is drawn for each entry, undefined ones included; the drawn response against plain computations."""

import xml.etree.ElementTree as ET

import numpy as np
import pytest

from photonloom.operators.splits import GlobalSplit
from photonloom.plans.experiments import dataset_diagnostics
from photonloom.plans.pixels import example_response, pixel_report
from photonloom.sources import figures

SVG = "{http://www.w3.org/2000/svg}"


def texts(page):
    return [t.text for t in ET.fromstring(page).iter(f"{SVG}text")]


def bars(page, *kinds):
    return [r for r in ET.fromstring(page).iter(f"{SVG}rect") if r.get("class") in kinds]


def test_diagnostics_take_quarters_of_training_rows(spark):
    rows = [("f", roi, n, "train" if n <= 40 else "test", float(n * (1 + roi))) for roi in range(3) for n in range(1, 101)]
    rows += [("g", 0, n, "test", 1.0) for n in range(3)] + [("h", 0, 7, "train", 2.0), ("h", 1, 9, "train", 5.0)]
    df = spark.createDataFrame(rows, "fly string, roi int, rn long, split string, value double")
    got = {r.fly: r for r in dataset_diagnostics(df, ["fly"], "roi").collect()}
    # quarters of 10 rows: means 5.5 and 35.5 times 1, 2 and 3
    assert (got["f"].observations, got["f"].rois, got["f"].median_drift) == (300, 3, 60.0)
    assert np.isclose(got["f"].median_train_sd, 2 * np.std(np.arange(1, 41)))
    assert got["g"].median_drift is None and got["g"].median_train_sd is None
    assert got["h"].median_drift is None and got["h"].rois == 2
    assert dataset_diagnostics(df.limit(0), ["fly"], "roi").count() == 0


def test_dataset_page(spark):
    facts = spark.createDataFrame([("f<1", 300, 3, 2.0, -4.0), ("g", 30, 1, None, None)], "fly string, observations long, rois long, median_train_sd double, median_drift double")
    stimuli = spark.createDataFrame([("f<1", "x"), ("g", "y")], "fly string, digest string")
    responsive = spark.createDataFrame([("f<1", True), ("f<1", False)], "fly string, selected boolean")
    page = figures.dataset_page("set & more", facts, GlobalSplit(4, 50, 80, 120), 120, stimuli, responsive)
    seen = texts(page)
    assert len([t for t in ET.fromstring(page).iter(f"{SVG}text") if t.get("class") == "h"]) == 9
    assert {"set & more", "f<1", "300", "0.50", "-4.000", "same", "differs", "2 stimuli", "2 sessions", "4 responses", "330 observations", "train 3 to 50"} <= set(seen)
    assert seen.count("undefined") == 3
    assert len(bars(page, "train", "validation", "test")) == 3 and len(bars(page, "down")) == 2
    wide = sorted(float(r.get("width")) for r in bars(page, "up"))
    assert np.isclose(wide[-1], 230) and np.isclose(wide[0], 23)
    empty = figures.dataset_page("none", facts.limit(0), GlobalSplit(4, 50, 80, 120), 120, stimuli.limit(0), responsive.limit(0))
    assert "0 sessions" in texts(empty)


def test_score_pages(spark):
    models = spark.createDataFrame([("a", -0.4), ("b", 0.3), ("c", None)], "model string, median_r2 double")
    page = figures.model_page("m", models)
    seen = texts(page)
    assert seen.index("b") < seen.index("a") < seen.index("c") and "undefined" in seen and "-0.400" in seen
    down, up = bars(page, "down")[0], bars(page, "up")[0]
    assert np.isclose(float(down.get("x")) + float(down.get("width")), float(up.get("x")), atol=0.11)
    assert np.isclose(float(down.get("width")) / float(up.get("width")), 4 / 3, atol=0.01)
    many = spark.range(70).selectExpr("cast(id as string) session", "id members", "id / 70 median_r2")
    assert len(bars(figures.session_page("s", many), "up")) == 70
    assert "7 (7)" in texts(figures.session_page("s", many))


def test_response_page(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s, noise in (("s0", 3.0), ("s1", 0.2)):
        x = rng.choice([-1.0, 1.0], size=(300, 2 * 6))
        y = np.stack([rng.normal(size=300), 2 * x[:, 4] - x[:, 10] + noise * rng.normal(size=300)], axis=1)
        rows += [(s, n, "train" if n < 150 else "validation" if n < 200 else "test", x[n].tolist(), y[n].tolist()) for n in range(300)]
    df = spark.createDataFrame(rows, "session string, rn long, split string, x array<double>, y array<double>")
    report = pixel_report(df, 2, 3, 5, kernels=True)
    best, weights, trace = example_response(df, report, 2, 0.5)
    assert (best.session, best.response, best.pixel_row, best.pixel_col) == ("s1", 1, 1, 1)
    assert np.allclose(weights, [2, -1], atol=0.1)
    got = trace.orderBy("seconds").collect()
    want = [r for r in rows if r[0] == "s1" and 200 <= r[1] <= 240]
    assert np.allclose([r.seconds for r in got], 0.5 * np.arange(41)) and np.allclose([r.y for r in got], [r[4][1] for r in want])
    assert np.corrcoef([r.y for r in got], [r.projection for r in got])[0, 1] > 0.98
    page = figures.response_page("r", (1, 1), (2, 3), weights, 0.5, trace)
    lines = list(ET.fromstring(page).iter(f"{SVG}polyline"))
    assert [len(p.get("points").split()) for p in lines] == [2, 41, 41] and "row 1, column 1" in texts(page)
    ET.fromstring(figures.response_page("none", (0, 0), (1, 1), [], 0.5, trace.limit(0)))
    with pytest.raises(ValueError):
        example_response(df, report.limit(0), 2, 0.5)
