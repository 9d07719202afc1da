"""Content-defined chunking of media payloads, with chunks stored once and media rebuilt from chunk lists.

A text's bytes become the samples of an 8-bit WAV medium. A rolling gear hash cuts its samples into
chunks, and the medium becomes an ordered list of chunk digests. Spark joins on digests find chunks that
several media have and give each an owner; every medium stores, compressed, the chunks it owns and its
list. Reading back, each medium is put together from its list, chunk by chunk: own chunks from its own
row, others from their owners' rows, each chunk verified by its digest and the whole by its SHA-256.

Media that share nothing need no other row, so their store rows are written by the task that reads the
text. A filter of the other media's keys, sized by their number, tells the two apart; where it would be
larger than FILTER_LIMIT there is none, and all media take the way of shared ones.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonloom.llm.common import as_id, as_text, hot_keys, join_split, staged

ALIGN = 64
RATE = 8000
MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 256, 10, 8192
LEVEL = 3
#: Filter bits for each key, and the most bits that are broadcast.
FILTER_BITS_A_KEY, FILTER_LIMIT = 16, 1 << 28
#: Media that take one chunk from one copy of its owner's row.
LENT_ROWS = 2000
_HEADER = 44
_GEAR = np.random.default_rng(20240101).integers(0, 1 << 32, 256, dtype=np.uint32)
_LIST = "array<struct<digest binary, size int, owner binary>>"


def payload(text: str | None) -> tuple[int, bytes]:
    """Unpadded bytes of a text, and its bytes padded to a positive multiple of ALIGN."""
    raw = (text or "").encode("utf-8", "replace")
    size = max(ALIGN, -(-len(raw) // ALIGN) * ALIGN)
    return len(raw), raw + bytes(size - len(raw))


def wav(samples: bytes) -> bytes:
    """The WAV file of 8-bit samples."""
    size = len(samples)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", size) + samples


def payload_of(medium: bytes) -> bytes:
    size = struct.unpack_from("<I", medium, _HEADER - 4)[0]
    if medium[:4] != b"RIFF" or len(medium) != _HEADER + size:
        raise ValueError("a stored medium is not the WAV file that was written")
    return medium[_HEADER:]


def gear_hashes(data: bytes) -> np.ndarray:
    """At each byte the sum of the last 32 bytes' table entries, each shifted by its distance."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks: after a byte whose hash has MEAN_BITS leading zeros, within the least and largest size."""
    ends, start = [], 0
    for c in [*(np.flatnonzero(gear_hashes(data) >> np.uint32(32 - MEAN_BITS) == 0) + 1).tolist(), len(data)]:
        while c - start > MAX_CHUNK:
            start += MAX_CHUNK
            ends.append(start)
        if c - start >= MIN_CHUNK or (c == len(data) and c > start):
            ends.append(c)
            start = c
    return ends


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def recipe(samples: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of each chunk, in order."""
    ends = cuts(samples)
    return [(_digest(samples[a:b]), samples[a:b]) for a, b in zip([0, *ends], ends)]


def features(medium: bytes) -> dict:
    payload = payload_of(medium)
    x = np.frombuffer(payload, np.uint8)
    rms = float(np.sqrt(np.mean(np.square(x, dtype=np.float32), dtype=np.float64)))
    turns = int(np.count_nonzero((x[1:] >= 96) != (x[:-1] >= 96)))
    return {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-ALIGN:]), "media_bytes": len(medium), "media_sha256": hashlib.sha256(medium).hexdigest(), "feature": f"rms={rms:.4f};turns={turns};peak={int(x.max())}"}


_FEATURES = "key binary, n_chunks long, n_lent long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_NAMES = [c.split()[0] for c in _FEATURES.split(", ")]


def _spots(keys: list[bytes], n_bits: int) -> np.ndarray:
    """Three filter bits for each key."""
    if not keys:
        return np.empty((0, 3), np.int64)
    h = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    return ((h[:, :1] + np.arange(3, dtype=np.uint64) * (h[:, 1:] | np.uint64(1))) % np.uint64(n_bits)).astype(np.int64)


def key_filter(keys: DataFrame, limit: int = FILTER_LIMIT) -> np.ndarray | None:
    """Packed bits of all keys, sized by their number; None where they would be over limit."""
    n = keys.count()
    n_bits = max(64, 1 << (n * FILTER_BITS_A_KEY - 1).bit_length()) if n else 64
    if n_bits > limit:
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(n_bits, bool)
        for x in batches:
            bits[_spots(x["key"].tolist(), n_bits)] = True
        yield pd.DataFrame({"bits": [zlib.compress(np.packbits(bits).tobytes(), 1)]})

    out = np.zeros(n_bits // 8, np.uint8)
    for r in keys.mapInPandas(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return out


def _texts(docs: DataFrame, bits: np.ndarray | None, shared: bool) -> Callable:
    """A function of batches of texts that gives (key, text) of those that the filter names, or of the others, once in a task."""
    filter_ = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bytes, str | None]]:
        seen, bits = set(), filter_.value
        for x in batches:
            for text in x["text"]:
                key = _digest((text or "").encode("utf-8", "replace"))
                spot = None if bits is None else _spots([key], 8 * len(bits))[0]
                named = bits is None or bool((bits[spot >> 3] >> (7 - (spot & 7)) & 1).all())
                if named == shared and key not in seen:
                    seen.add(key)
                    yield key, text

    return run


def _frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of at most a few megabytes."""
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += 200 + sum(len(v) for v in r if isinstance(v, (bytes, str)))
        if size > 4 << 20:
            yield pd.DataFrame(out, columns=columns)
            out, size = [], 0
    if out:
        yield pd.DataFrame(out, columns=columns)


def store_row(key: bytes, chunks: list[tuple[bytes, bytes]], owners: dict[bytes, bytes], pack: zstandard.ZstdCompressor) -> tuple:
    """(key, chunks, data): the ordered list, and the chunks that this medium owns, each once."""
    own, listed = {}, []
    for digest, raw in chunks:
        owner = owners.get(digest)
        listed.append({"digest": digest, "size": len(raw), "owner": owner})
        if owner is None or owner == key:
            own.setdefault(digest, raw)
    return key, listed, pack.compress(b"".join(own.values()))


def own_chunks(key: bytes, chunks: list, data: bytes) -> dict[bytes, bytes]:
    """The chunks in a store row, by digest; one that doesn't match its digest is an error."""
    own, at = {}, 0
    for c in chunks:
        if (c["owner"] is None or c["owner"] == key) and c["digest"] not in own:
            raw = own[c["digest"]] = data[at : at + c["size"]]
            at += c["size"]
            if _digest(raw) != c["digest"]:
                raise ValueError("a stored chunk doesn't match its digest")
    return own


def _lent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pack, unpack = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()

    def rows() -> Iterator[tuple]:
        for x in batches:
            for key, chunks, data in zip(x["key"], x["chunks"], x["data"]):
                shared = {c["digest"] for c in chunks if c["owner"] == key}
                for d, raw in own_chunks(key, chunks, unpack.decompress(data)).items():
                    if d in shared:
                        yield d, pack.compress(raw)

    yield from _frames(rows(), ["digest", "raw"])


def _rebuilt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each medium from its ordered chunk list."""
    unpack = zstandard.ZstdDecompressor()

    def rows() -> Iterator[tuple]:
        for x in batches:
            for key, chunks, data, lent in zip(x["key"], x["chunks"], x["data"], x["lent"] if "lent" in x else [None] * len(x)):
                parts = own_chunks(key, chunks, unpack.decompress(data))
                others = {p["digest"]: unpack.decompress(p["raw"]) for p in (() if lent is None else lent)}
                if any(_digest(raw) != d for d, raw in others.items()):
                    raise ValueError("a lent chunk doesn't match its digest")
                medium = wav(b"".join((parts.get(c["digest"]) or others[c["digest"]]) for c in chunks))
                found = {"key": key, "n_chunks": len(chunks), "n_lent": len(others)} | features(medium)
                yield tuple(found[c] for c in _NAMES)

    yield from _frames(rows(), _NAMES)


def chunk_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_limit: int = FILTER_LIMIT) -> DataFrame:
    """One row per input row: id, n_bytes, what was computed from the rebuilt medium, n_chunks and n_lent.

    n_lent counts the different chunks that came from other media's rows. Null texts are empty; very long
    texts are one medium of many chunks; equal texts share one stored medium; repeated rows and null ids
    keep their rows; other columns, of whatever name, are ignored; an empty table gives an empty result. A
    chunk or medium that differs from what was cut is an error.
    """
    docs = df.select(as_text(df, id_col).alias("id"), F.col(text_col).alias("text"))
    texts = docs.select("text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for x in batches:
                for i, text in zip(x["id"], x["text"]):
                    n, samples = payload(text)
                    yield i, _digest((text or "").encode("utf-8", "replace")), n, hashlib.sha256(wav(samples)).hexdigest(), list(dict.fromkeys(d for d, _ in recipe(samples)))

        yield from _frames(rows(), ["id", "key", "n_bytes", "sha", "digests"])

    recipes = staged(docs.mapInPandas(cut, "id string, key binary, n_bytes long, sha string, digests array<binary>"), "recipes")
    copies = staged(recipes.groupBy("key").agg(F.count("*").alias("n")), "copies")
    chunks = recipes.select("key", F.explode("digests").alias("digest"))
    owners = chunks.groupBy("digest").agg(F.min("key").alias("owner"), F.max("key").alias("last"), F.count("*").alias("n")).where("owner <> last").drop("last")
    owners = staged(owners, "owners")
    shares = join_split(chunks, owners.select("digest", "owner"), "digest", hot_keys(owners)).where("owner is not null")
    shares = shares.groupBy("key").agg(F.collect_set(F.struct("digest", "owner")).alias("shares"))
    met = staged(copies.where("n > 1").select("key").join(shares, "key", "full_outer"), "shares")
    bits = key_filter(met.select("key"), filter_limit)

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        yield from _frames((store_row(key, recipe(payload(text)[1]), {}, pack) for key, text in others(batches)), ["key", "chunks", "data"])

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        yield from _frames(((key, pack.compress((text or "").encode("utf-8", "replace"))) for key, text in wanted_texts(batches)), ["key", "text"])

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack, unpack = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        rows = ((k, recipe(payload(unpack.decompress(t).decode("utf-8"))[1]), {s["digest"]: s["owner"] for s in (() if own is None else own)}) for x in batches for k, t, own in zip(x["key"], x["text"], x["shares"]))
        yield from _frames((store_row(k, c, own, pack) for k, c, own in rows), ["key", "chunks", "data"])

    others, wanted_texts = _texts(docs, bits, False), _texts(docs, bits, True)
    kinds = f"key binary, chunks {_LIST}, data binary"
    store = texts.mapInPandas(named, "key binary, text binary").dropDuplicates(["key"]).join(met, "key", "left").mapInPandas(placed, kinds)
    if bits is not None:
        store = store.unionByName(texts.mapInPandas(alone, kinds))
    foreign = F.exists("chunks", lambda c: c.owner.isNotNull() & (c.owner != F.col("key")))
    store = staged(store.withColumn("foreign", foreign), "store")

    # a chunk that very many media take is lent by several copies of its owner's row
    spread = owners.select("digest", F.ceil(F.col("n") / LENT_ROWS).alias("parts"))
    takes = F.array_distinct(F.transform(F.filter("chunks", lambda c: c.owner.isNotNull() & (c.owner != F.col("key"))), lambda c: c.digest))
    wanted = store.where("foreign").select("key", F.explode(takes).alias("digest"))
    wanted = join_split(wanted, spread, "digest", hot_keys(owners)).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    lent = store.where(F.exists("chunks", lambda c: c.owner == F.col("key"))).select("key", "chunks", "data").mapInPandas(_lent, "digest binary, raw binary")
    lent = lent.join(spread, "digest").select("digest", "raw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    lent = wanted.join(lent, ["digest", "part"]).groupBy("key").agg(F.collect_list(F.struct("digest", "raw")).alias("lent"))
    own = store.where("not foreign").select("key", "chunks", "data").mapInPandas(_rebuilt, _FEATURES)
    found = store.where("foreign").join(lent, "key").select("key", "chunks", "data", "lent").mapInPandas(_rebuilt, _FEATURES)
    found = staged(own.unionByName(found), "features")

    out = join_split(recipes.drop("digests"), found, "key", hot_keys(copies))
    checked = F.when(F.col("media_sha256") == F.col("sha"), F.col("media_sha256")).otherwise(F.raise_error(F.lit("a medium read back differs from the one that was cut")))
    return out.select(as_id(df, id_col).alias(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", checked.alias("media_sha256"), "feature", "n_chunks", "n_lent")


def op2_media(spark, sf_dir: str) -> DataFrame:
    return chunk_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
