"""Scans with their contracts, inventory, sinks and the stream."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_stretches import plain_ema

from photonloom.sources import inventory, npz, scans, stimulus, writers
from photonloom.streaming.baseline import stream_ema_baseline


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_responses(spark, tmp_path):
    good = put(tmp_path / "good.csv", "﻿ ,Mean1,Mean2\n1,5.5,1\n2,6.5,2\n")
    got = sorted((r.sample_index, r.roi, r.value) for r in scans.read_responses(spark, good).collect())
    assert got == [(0, "Mean1", 5.5), (0, "Mean2", 1.0), (1, "Mean1", 6.5), (1, "Mean2", 2.0)]
    for name, text, says in (("gap", " ,Mean1\n1,5\n3,6\n", "consecutive"), ("twice", " ,Mean1,Mean1\n1,5,6\n", "Duplicate ROI"), ("nan", " ,Mean1\n1,NaN\n", "Non-finite")):
        with pytest.raises(ValueError, match=says):
            scans.read_responses(spark, put(tmp_path / f"{name}.csv", text))


def test_clocks_and_sessions(spark, tmp_path):
    ok = put(tmp_path / "c.csv", "a,timestamp_us\nx,1\nx,4\n")
    assert [r.t for r in scans.read_clock(spark, ok).orderBy("rn").collect()] == [1, 4]
    with pytest.raises(ValueError, match="Non-increasing"):
        scans.read_clock(spark, put(tmp_path / "d.csv", "timestamp_us\n1\n1\n"))
    with pytest.raises(ValueError, match="lacks"):
        scans.read_clock(spark, put(tmp_path / "e.csv", "other\n1\n"))
    put(tmp_path / "root/fly2/20240101_000000/Results.csv", "x")
    put(tmp_path / "root/fly1/20240101_000001/Results.csv", "x")
    found = scans.discover_sessions(spark, str(tmp_path / "root")).collect()
    assert [(r.fly, r.run_id) for r in found] == [("fly1", "20240101_000001"), ("fly2", "20240101_000000")]


def test_npz_source_and_stimulus(spark, tmp_path):
    signs = np.where(np.random.RandomState(17).random_sample((6, 4)) < 0.5, 1.0, -1.0).astype(np.float32)
    gray = np.where(signs > 0, 100, 0).astype(np.uint8)
    np.savez(tmp_path / "s.npz", updates=signs.reshape(6, 2, 2), gray=gray.reshape(6, 2, 2))
    npz.register(spark)
    read = lambda a: spark.read.format("npz").option("array", a).option("rowsperpartition", 4).load(str(tmp_path / "s.npz"))
    assert [r["values"] for r in read("updates").orderBy("row").collect()] == signs.tolist()
    assert stimulus.mismatches(read("updates"), stimulus.reconstructed(spark, 17, 6, 4, 0.5)) == 0
    assert stimulus.gray_mismatches(read("updates"), read("gray"), 0, 100) == 0
    assert stimulus.mismatches(read("updates"), stimulus.reconstructed(spark, 18, 6, 4, 0.5)) > 0


def test_inventory(spark, tmp_path):
    root = tmp_path / "inv"
    put(root / "data/fly1/20240101_000000/Results.csv", " ,Mean1\n1,5\n2,7\n")
    put(root / "data/fly1/20240101_000000/playback/stim_frames.csv", "a,b\n1\n")
    put(root / "data/fly1/20240101_000000/playback/status.json", '{"b": {"c": 1}, "a": 2}')
    put(root / "notes.md", "text")
    (root / "x.bin").write_bytes(b"\0")
    (root / "p.png").write_bytes(inventory.PNG + b"\0\0\0\rIHDR" + (3).to_bytes(4, "big") + (2).to_bytes(4, "big"))
    got = {r.path.rpartition("/")[2]: r for r in inventory.inventory(spark, f"file:{root}").collect()}
    assert got["Results.csv"].category == "ROI measurements" and json.loads(got["Results.csv"].metadata)["row_count"] == 2
    assert (got["Results.csv"].fly, got["Results.csv"].run_id) == ("fly1", "20240101_000000")
    assert got["stim_frames.csv"].status in ("ERROR", "PARSED") and got["status.json"].category == "Playback"
    assert json.loads(got["status.json"].metadata)["nested"] == {"b": ["c"]}
    assert json.loads(got["p.png"].metadata) == {"width": 3, "height": 2}
    assert (got["notes.md"].status, got["x.bin"].status) == ("TEXT_READABLE", "UNSUPPORTED")


def test_sinks(spark, tmp_path):
    with pytest.raises(ValueError):
        writers.write_csv(spark.createDataFrame([], "a int"), str(tmp_path / "none"))
    path = str(tmp_path / "registry")
    row = lambda i, m: spark.createDataFrame([(i, m)], "experiment_id string, model string")
    writers.write_registry(row("a", "one").unionByName(row("b", "two")), path)
    got = writers.write_registry(row("a", "three"), path)
    assert sorted((r.experiment_id, r.model) for r in got.collect()) == [("a", "three"), ("b", "two")]
    uri = f"file://{tmp_path}/other/registry"
    writers.write_registry(row("a", "one"), uri)
    assert sorted(r.experiment_id for r in writers.write_registry(row("c", "one"), uri).collect()) == ["a", "c"]
    seen = spark.createDataFrame([("f", "train", 0, "r"), ("f", "test", 1, "r"), ("f", "test", 1, "s")], "fly string, split string, u long, roi string")
    out = writers.write_manifest(seen, f"file://{tmp_path}/manifest", {"k": 1})
    assert json.loads((tmp_path / "manifest" / "manifest.json").read_text()) == out and out["unique_updates"] == 2
    files = spark.createDataFrame([("a.csv", "Playback", "PARSED")], "path string, category string, status string")
    assert "- Playback: 1" in writers.write_inventory(files, f"file://{tmp_path}/inventory") and (tmp_path / "inventory" / "summary.md").exists()
    assert writers.bars_svg("t", {"a<b": 1.0, "c": None}).count("<rect") == 1 and "polyline" in writers.line_svg("t", [1, 2])


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k % 3, k * 700_000, k, float((k * 37) % 11)) for k in range(90)]
    schema = "user_id long, t long, event_id long, value double"
    for k in range(3):
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_ema_baseline(stream, "user_id").writeStream.format("memory").queryName("ema_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.event_id: r.baseline for r in spark.table("ema_out").collect()}
    for u in range(3):
        own = [r for r in rows if r[0] == u]
        want = plain_ema(np.array([r[1] for r in own]), np.array([r[3] for r in own]), 60.0)
        assert np.allclose([got[r[2]] for r in own], want)


def test_config(tmp_path):
    good = {"schema_version": 1, "features": {"bins": 4, "updates_per_bin": 10}, "alphas": [0.1], "folds": [{"name": n, "train_end": a, "validation_end": a + 100, "test_end": a + 300} for n, a in (("a", 100), ("b", 200))]}
    path = put(tmp_path / "c.json", json.dumps(good))
    assert scans.Config.load(path, 600).folds["b"] == (200, 300, 500)
    with pytest.raises(ValueError):
        scans.Config.load(put(tmp_path / "d.json", json.dumps(good | {"folds": good["folds"][:1]})), 600)


def test_inventory_gives_python_only_what_is_profiled(spark):
    names = ["a/x.parquet", "a/x.PNG", "a/x.csv", "a/x", "a.csv/x.bin"]
    df = spark.createDataFrame([(n, bytearray(range(200))) for n in names], "path string, content binary")
    sent = df.select("path", F.length(inventory.profiled(F.col("path"), F.col("content"))).alias("n"))
    assert [r.n for r in sent.collect()] == [None, 24, 200, None, None]
