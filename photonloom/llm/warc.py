"""WARC archives: written with an index, then read by coalesced byte ranges.

Each task writes archives of gzip members, one for each record, and returns for each the file, offset,
length, URL and digest. Spark commits these rows as the index, so archives of failed attempts are never
read. Selected index rows are sorted by file and offset, near ones become one byte range, and each
range is one read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photonloom.llm.common import as_id, as_text, hot_keys, join_split, shared_path, staged

ARCHIVE_BYTES = 64 << 20
#: Ranges closer than GAP_BYTES become one read; a read begins in one stretch of READ_BYTES.
GAP_BYTES, READ_BYTES = 64 << 10, 4 << 20
#: Archive bytes that one reading task gets, and the most reading tasks; beyond, a task reads more ranges, one at a time.
TASK_BYTES, MOST_TASKS = 8 << 20, 20_000
MIN_REVISIT_BYTES = 0
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "file string, offset long, length long, id string, url string, digest string, record_type string"


def _urn(page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page: object, url: str | None, payload: bytes, sha1: str, first: object, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record; first is the page of the equal payload's response if this record revisits it, else None."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    uri = (url or _urn(page)[1:-1]).replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", _urn(page)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    head += [("X-Page-ID", page)] if page is not None else []
    if first is not None:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _urn(first)), ("X-Refers-To-Page-ID", first), ("X-Payload-Length", len(payload))]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (payload if first is None else b"")
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "replace") + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record; a payload that doesn't match its digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record of page {fields.get('X-Page-ID')} doesn't end where it should")
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode():
        raise ValueError(f"payload of page {fields.get('X-Page-ID')} doesn't match its digest")
    return fields, payload


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row below folder and return the index, itself written.

    Of equal payloads of at least min_bytes, the row with the smallest id is the response and rows of
    other ids revisit it. A null id is larger than all others; where all ids are null, all rows are
    responses, as are repeated rows of the smallest id. A null payload is empty, a null URL becomes the
    record's own name; very long payloads are one record each. Other columns of df, of whatever name, are
    ignored. An empty table gives an empty index.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "utf-8")))
    shared = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = staged(shared, "repeats")
    # a payload that very many rows have, such as the empty one, doesn't gather them in one task
    rows = join_split(rows, shared.select("sha1", "first"), "sha1", hot_keys(shared)).withColumn("first", F.expr("case when first is not null and not first <=> id then first end"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        task, k, out, offset = TaskContext.get(), 0, None, 0
        for x in batches:
            index = []
            for page, url, html, sha1, first in zip(x["id"], x["url"], x["html"], x["sha1"], x["first"]):
                if out is None or offset >= archive_bytes:
                    if out:
                        out.close()
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{k:04d}.warc.gz"
                    out, offset, k = fs.open_output_stream(f"{path}/{name}", compression=None), 0, k + 1
                raw = _gzip(record(page, url, html.encode("utf-8", "replace"), sha1, first))
                out.write(raw)
                index.append((name, offset, len(raw), page, url, base64.b32encode(bytes.fromhex(sha1)).decode(), "response" if first is None else "revisit"))
                offset += len(raw)
            yield pd.DataFrame(index, columns=["file", "offset", "length", "id", "url", "digest", "record_type"])
        if out:
            out.close()

    text = rows.select(as_text(rows, "id").alias("id"), "url", "html", "sha1", as_text(rows, "first").alias("first"))
    return staged(text.mapInPandas(run, _INDEX).withColumn("id", as_id(df, id_col)), "index")


def ranges(selected: DataFrame, gap: int = GAP_BYTES, stretch: int = READ_BYTES) -> DataFrame:
    """(file, start, stop, parts) of index rows: few sorted byte ranges, with the records in each."""
    by_file = Window.partitionBy("file").orderBy("offset")
    far = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(by_file) > gap
    marked = selected.select("file", "offset", "length", F.coalesce(far, F.lit(False)).cast("long").alias("far"), F.floor(F.col("offset") / stretch).alias("stretch"))
    marked = marked.withColumn("run", F.sum("far").over(by_file))
    part = F.struct("offset", "length")
    return marked.groupBy("file", "run", "stretch").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.sort_array(F.collect_list(part)).alias("parts"))


def read_records(selected: DataFrame, folder: str, id_type: str = "bigint", task_bytes: int = TASK_BYTES) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to, url) of the selected index rows, read back and verified.

    Ranges are dealt by file and stretch to as many tasks as the selected bytes need. An empty selection gives no row.
    """
    size = selected.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first().n
    tasks = max(1, min(MOST_TASKS, -(-size // task_bytes)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(folder)
        for x in batches:
            for name, start, stop, parts in zip(x["file"], x["start"], x["stop"], x["parts"]):
                with fs.open_input_file(f"{path}/{name}") as f:
                    f.seek(start)
                    raw = f.read(stop - start)
                rows = []
                for p in parts:
                    at = p["offset"] - start
                    fields, payload = parsed(zlib.decompress(raw[at : at + p["length"]], 31))
                    size = len(payload) if fields["WARC-Type"] == "response" else int(fields["X-Payload-Length"])
                    rows.append((fields.get("X-Page-ID"), size, fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], fields.get("X-Refers-To-Page-ID"), fields["WARC-Target-URI"]))
                yield pd.DataFrame(rows, columns=["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    out = ranges(selected).repartition(tasks, "file", "stretch").mapInPandas(run, "id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string")
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("id", "refers_to")})


def op8_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = shared_path(spark, "archives")
    index = write_archives(pages, folder)
    return read_records(index, folder).withColumnRenamed("id", "page_id").drop("url")


OP8_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) payload_bytes, sha1(coalesce(html, '')) s from pages),
f as (select *, min(page_id) over (partition by s) first from p)
select page_id, payload_bytes::bigint payload_bytes,
  array_to_string(list_transform(range(8), lambda i: translate(to_base(('0x' || substr(s, (5 * i + 1)::int, 5))::bigint, 32, 4),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), '') payload_digest,
  case when first = page_id then 'response' else 'revisit' end record_type,
  case when first <> page_id then first end refers_to
from f
"""
