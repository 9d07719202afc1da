"""Sinks: tables, the experiment registry, manifests, and small SVG figures of aggregated results."""

from __future__ import annotations

import html
import json
import os
import subprocess
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonloom.operators.compare import REGISTRY_FIELDS, upsert


def write_csv(df: DataFrame, path: str, allow_empty: bool = False) -> bool:
    """Write with a header; an empty table is an error, or nothing is written where allowed."""
    if df.isEmpty():
        if allow_empty:
            return False
        raise ValueError(f"No rows to write: {path}")
    df.write.mode("overwrite").option("header", True).csv(path)
    return True


def write_parameters(df: DataFrame, path: str) -> None:
    """Parameters or predictions as Parquet by fly and run."""
    df.write.mode("overwrite").partitionBy("fly", "run_id").parquet(path)


def _at(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def write_text(path: str, text: str) -> None:
    fs, at = _at(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at, compression=None) as out:
        out.write(text.encode())


def write_registry(new: DataFrame, path: str) -> DataFrame:
    """Insert or replace experiments by id; the former files stay until the new ones are whole."""
    from pyarrow.fs import FileType

    spark = new.sparkSession
    fs, at = _at(path)
    known = fs.get_file_info(at).type != FileType.NotFound
    old = spark.read.option("header", True).csv(path) if known else spark.createDataFrame([], ", ".join(f"{f} string" for f in REGISTRY_FIELDS))
    upsert(old, new).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}.new")
    if known:
        fs.move(at, f"{at}.{uuid.uuid4().hex}.old")
    fs.move(f"{at}.new", at)
    return spark.read.option("header", True).csv(path)


def write_inventory(files: DataFrame, folder: str) -> str:
    """The inventory as JSON lines, and a Markdown summary of its counts."""
    files.write.mode("overwrite").json(f"{folder}/inventory.json")
    lines = ["# Inventory", ""]
    for c in ("category", "status"):
        lines += [f"- {r[c]}: {r['count']}" for r in files.groupBy(c).count().orderBy(c).collect()] + [""]
    write_text(f"{folder}/summary.md", "\n".join(lines))
    return "\n".join(lines)


def write_manifest(observations: DataFrame, folder: str, config: dict) -> dict:
    """Counts by session and split and the number of updates, never the features themselves."""
    counts = observations.groupBy("fly", "split").count().orderBy("fly", "split").collect()
    updates = observations.agg(F.count_distinct("u").alias("n")).first().n
    out = {"config": config, "counts": [r.asDict() for r in counts], "unique_updates": updates}
    write_text(f"{folder}/manifest.json", json.dumps(out, indent=2))
    write_csv(observations.groupBy("fly", "roi").count(), f"{folder}/roi_counts.csv")
    return out


def git_revision(path: str = ".") -> dict:
    """Revision of the working tree and whether it has changes; nulls outside one."""
    call = lambda *a: subprocess.run(["git", "-C", path, *a], capture_output=True, text=True)
    head = call("rev-parse", "HEAD")
    return {"revision": head.stdout.strip(), "dirty": bool(call("status", "--porcelain").stdout.strip())} if head.returncode == 0 else {"revision": None, "dirty": None}


def bars_svg(title: str, values: dict[str, float | None], width: int = 640) -> str:
    """Horizontal bars of a few aggregated values around zero, as SVG."""
    rows = 24 * len(values) + 40
    most = max((abs(v) for v in values.values() if v is not None), default=0) or 1.0
    middle, scale = width * 0.6, width * 0.3 / most
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{rows}">', f'<text x="8" y="20">{html.escape(title)}</text>']
    for k, (name, v) in enumerate(values.items()):
        y = 36 + 24 * k
        out.append(f'<text x="8" y="{y + 14}" font-size="12">{html.escape(name)}</text>')
        if v is not None:
            out.append(f'<rect x="{middle + min(0, v * scale):.1f}" y="{y}" width="{abs(v * scale):.1f}" height="18"><title>{v:.4f}</title></rect>')
    return "\n".join([*out, "</svg>"])


def line_svg(title: str, values: list[float], width: int = 640, height: int = 200) -> str:
    """A curve of a small series, scaled to its box, as SVG."""
    low, high = (min(values), max(values)) if values else (0.0, 1.0)
    span = high - low or 1.0
    points = " ".join(f"{8 + (width - 16) * k / max(1, len(values) - 1):.1f},{height - 8 - (height - 40) * (v - low) / span:.1f}" for k, v in enumerate(values))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="8" y="20">{html.escape(title)}</text><polyline fill="none" stroke="black" points="{points}"/></svg>'
