"""File inventory: hashes, formats and profiles of all files below a folder."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonloom.sources.shared import kept

# fixed values: (test of a path's folder or file name, category, whether models read it), the first that fits
ROLES: tuple[tuple[str, str, str, bool], ...] = (
    ("name", r"^Results\.csv$", "ROI measurements", True),
    ("name", r"^zeiss_ttl_.*\.csv$", "Zeiss imaging", True),
    ("name", r"^stim_realized\.npz$", "Stimulus package", True),
    ("both", r"^stimulus_package/stim_(recipe|structure_priors)\.json$", "Stimulus package", True),
    ("folder", r"^stimulus_package$", "Stimulus package", False),
    ("both", r"^playback/stim_frames\.csv$", "Playback", True),
    ("folder", r"^playback$", "Playback", False),
    ("both", r"^(capture/.*dlp_ttl.*|[^/]*/dlp_ttl_.*)$", "DLP timing", False),
    ("both", r"^capture/.*optical.*$", "Calibration", False),
    ("folder", r"^capture$", "QC", False),
    ("both", r"^analysis_marker_lock/marker_lock_summary\.json$", "Marker lock", True),
    ("folder", r"^analysis_marker_lock$", "Marker lock", False),
    ("both", r"^analysis_alignment/analysis_summary\.json$", "Calibration", True),
    ("folder", r"^analysis_alignment$", "Calibration", False),
    ("both", r"^offsite_analysis/offsite_reference_summary\.json$", "Existing analysis", True),
    ("folder", r"^offsite_analysis$", "Existing analysis", False),
    ("name", r"^preflight_checklist\.json$", "Experimental metadata", True),
    ("name", r"^preflight_checklist\.md$", "Experimental metadata", False),
    ("name", r"^task3_live_qc_summary\.json$", "QC", True),
    ("name", r"\.DS_Store$", "Temporary/generated", False),
    ("name", r"^(session_.*|run_manifest.*|microscope_play_manifest\.json)$", "Experimental metadata", False),
    ("folder", r"^logs$", "QC", False),
)
#: Kinds of files that are profiled whole, and the bytes of a PNG file that are.
WHOLE, PNG_HEAD = ("csv", "json", "npz", "txt", "md", "log", "svg"), 24
#: Bytes of files that come to a Python worker at once, beyond one file.
BATCH_BYTES = 4 << 20
PNG = b"\x89PNG\r\n\x1a\n"


def by_rules(path: Column, rules: tuple[tuple[str, str, str, bool], ...] = ROLES) -> tuple[Column, Column]:
    """(category, used) of a path by ordered rules on its file name, fourth part, or both."""
    parts = F.split(path, "/")
    name, folder = F.element_at(parts, -1), F.coalesce(F.try_element_at(parts, F.lit(4)), F.lit(""))
    subject = {"name": name, "folder": folder, "both": F.concat_ws("/", folder, name)}
    category = used = None
    for on, pattern, what, reads in rules:
        fits = F.rlike(subject[on], F.lit(pattern))
        category = F.when(fits, what) if category is None else category.when(fits, what)
        used = F.when(fits, reads) if used is None else used.when(fits, reads)
    return category.otherwise("Unknown"), used.otherwise(False)


def profile(name: str, content: bytes) -> tuple[str, str]:
    """Parse status and details as JSON of one file."""
    kind = name.rpartition(".")[2].lower()
    try:
        if kind == "csv":
            x = pd.read_csv(io.BytesIO(content), encoding="utf-8-sig", dtype=str, keep_default_na=False, header=None, skip_blank_lines=False)
            rows = x.iloc[1:]
            numbers = rows.apply(pd.to_numeric, errors="coerce")
            whole = [c for c in rows if len(rows) and np.isfinite(numbers[c]).all()]
            return "PARSED", json.dumps({"columns": x.iloc[0].tolist(), "row_count": len(rows), "nonempty": [int((rows[c] != "").sum()) for c in rows], "ranges": {str(x.iloc[0][c]): [float(numbers[c].min()), float(numbers[c].max())] for c in whole}})
        if kind == "json":
            doc = json.loads(content)
            if isinstance(doc, dict):
                return "PARSED", json.dumps({"keys": sorted(doc), "nested": {k: sorted(v) for k, v in sorted(doc.items()) if isinstance(v, dict)}})
            return "PARSED", json.dumps({"type": type(doc).__name__, "length": len(doc) if isinstance(doc, list | str) else None})
        if kind == "npz":
            arrays = np.load(io.BytesIO(content), allow_pickle=False)
            own = {k: arrays[k] for k in arrays.files}
            return "PARSED", json.dumps({k: {"shape": list(v.shape), "dtype": str(v.dtype)} | ({"min": float(np.nanmin(v)), "max": float(np.nanmax(v))} if v.size and np.issubdtype(v.dtype, np.number) else {}) for k, v in own.items()})
        if kind == "png":
            if content[:8] != PNG or content[12:16] != b"IHDR":
                raise ValueError("Invalid PNG header")
            return "PARSED", json.dumps({"width": int.from_bytes(content[16:20], "big"), "height": int.from_bytes(content[20:24], "big")})
        if kind in ("txt", "md", "log", "svg"):
            content.decode("utf-8")
            return "TEXT_READABLE", "{}"
        return "UNSUPPORTED", "{}"
    except (ValueError, KeyError, OSError, zipfile.BadZipFile) as e:
        return "ERROR", json.dumps({"message": str(e)[:200]})


def profiled(path: Column, content: Column) -> Column:
    """What profile() reads of a file: all of it, a PNG's head, or nothing, so that other files never come to Python."""
    kind = F.lower(F.substring_index(path, ".", -1))
    return F.when(kind.isin(*WHOLE), content).when(kind == "png", F.substring(content, 1, PNG_HEAD))


def inventory(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """One row per file: path, fly, run_id, extension, bytes, sha256, category, used, status and metadata.

    Spark hashes the files; a Python worker has one file to be profiled at a time, or some small ones. Spark
    reads a file as one value, so a file of 2 GB or more is its error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = [profile(p, c) for p, c in zip(x["path"], x["content"])]
            yield x.drop(columns="content").assign(status=[s for s, _ in found], metadata=[m for _, m in found])

    hashed = files.select("path", "length", F.sha2("content", 256).alias("sha256"), profiled(F.col("path"), F.col("content")).alias("content"))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, f"{BATCH_BYTES}b")
    try:
        known = kept(hashed.mapInPandas(run, "path string, length long, sha256 string, status string, metadata string"), "inventory")
    finally:
        spark.conf.set(name, before)
    relative = F.substring_index(F.col("path"), f"{root.rstrip('/')}/", -1)
    category, used = by_rules(relative)
    fly = F.nullif(F.regexp_extract("path", r"(?:^|/)(fly\d+)(?:/|$)", 1), F.lit(""))
    run_id = F.nullif(F.regexp_extract("path", r"(?:^|/)(\d{8}_\d{6})(?:/|$)", 1), F.lit(""))
    return known.select(relative.alias("path"), fly.alias("fly"), run_id.alias("run_id"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension"), F.col("length").alias("bytes"), "sha256", category.alias("category"), used.alias("used"), "status", "metadata")


def csv_profile(df: DataFrame) -> DataFrame:
    """For each string column: non-empty values, and the range if every row is a finite number."""
    parts = []
    for c in df.columns:
        v = F.expr(f"try_cast(`{c}` as double)")
        ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
        parts.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("row_count"), F.count_if(F.col(c).isNotNull() & (F.col(c) != "")).alias("nonempty"), F.count_if(ok).alias("numeric"), F.min(F.when(ok, v)).alias("low"), F.max(F.when(ok, v)).alias("high")))
    out = df.agg(F.array(*parts).alias("all")).select(F.explode("all").alias("c")).select("c.*")
    whole = (F.col("numeric") == F.col("row_count")) & (F.col("row_count") > 0)
    return out.select("column", "row_count", "nonempty", F.when(whole, F.col("low")).alias("low"), F.when(whole, F.col("high")).alias("high"))
