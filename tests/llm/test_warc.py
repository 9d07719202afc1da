import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from photonloom.llm.common import shared_path
from photonloom.llm.warc import parsed, ranges, read_records, record, write_archives

rng = random.Random(1)
HTML = [None, "", "é\r\n\r\nWARC/1.1\r\n", "x" * 300_000, "same", "same"] + ["<p>" + "".join(rng.choice("abc ") for _ in range(500)) for _ in range(60)]
ROWS = [(k, None if k % 7 == 0 else f"http://h/{k}\nx", h, "o", 1) for k, h in enumerate(HTML)]
ROWS += [(90, "u", HTML[10], "o", 1), (90, "u", HTML[10], "o", 1), (4, "u", "same", "o", 1), (None, "u", HTML[11], "o", 1), (None, None, "lone", "o", 1), (2**53 + 1, "u", "lone too", "o", 1)]


def expected(min_bytes=0):
    out = []
    for i, _, h, *_ in ROWS:
        raw = (h or "").encode()
        first = min((j for j, _, o, *_ in ROWS if (o or "").encode() == raw and j is not None), default=None)
        revisit = len(raw) >= min_bytes and first is not None and first != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, min_bytes):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, offset string, file int").repartition(3)
    folder = shared_path(spark, "test")
    index = write_archives(df, folder, min_bytes=min_bytes, archive_bytes=4000)
    got = sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_records(index, folder).collect()), key=str)
    assert got == expected(min_bytes)
    assert index.select("file").distinct().count() > 3
    chosen = read_records(index.where("id in (7, 30, 90)"), folder).collect()
    assert sorted(r.id for r in chosen) == [7, 30, 90, 90]
    whole = gzip.decompress(b"".join(p.read_bytes() for p in sorted(Path(folder.removeprefix("file://")).glob("*.warc.gz"))))
    assert whole.count(b"WARC-Type: ") == len(ROWS)


def test_archives_are_read_by_several_tasks(spark):
    df = spark.createDataFrame([(k, "u", "".join(rng.choice("abcdefgh") for _ in range(20_000))) for k in range(120)], "page_id long, url string, html string").repartition(4)
    folder = shared_path(spark, "test")
    index = write_archives(df, folder, archive_bytes=100_000)
    size = index.agg(F.sum("length")).first()[0]
    got = read_records(index, folder, task_bytes=50_000).withColumn("task", F.spark_partition_id())
    by_task = got.join(index.select("id", "length"), "id").groupBy("task").agg(F.sum("length").alias("n")).collect()
    assert len(by_task) > 6 and max(r.n for r in by_task) < size / 3


def test_ranges_coalesce(spark):
    df = spark.createDataFrame([("f", 0, 10), ("f", 10, 5), ("f", 500, 10), ("f", 1500, 20), ("g", 3, 4)], "file string, offset long, length long")
    got = sorted((r.file, r.start, r.stop, len(r.parts)) for r in ranges(df, gap=600, stretch=1000).collect())
    assert got == [("f", 0, 510, 3), ("f", 1500, 1520, 1), ("g", 3, 7, 1)]


def test_damage_is_an_error():
    raw = record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    assert parsed(raw)[1] == b"abc"
    with pytest.raises(ValueError, match="digest"):
        parsed(raw.replace(b"abc", b"abd"))


def test_empty(spark):
    folder = shared_path(spark, "test")
    index = write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert read_records(index, folder).count() == 0
