import hashlib
import io
import random
import wave
import zlib

import numpy as np
import pytest

import photonloom.llm.media as module
from photonloom.llm.media import MAX_CHUNK, MIN_CHUNK, chunk_media, cuts, gear_hashes, own_chunks, payload, recipe, wav

RNG = random.Random(3)


def words(n):
    return " ".join("".join(RNG.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_gear_hash_equals_plain():
    data = RNG.randbytes(300)
    got = gear_hashes(data)
    for i in range(len(data)):
        assert got[i] == sum(int(module._GEAR[data[i - k]]) << k for k in range(min(32, i + 1))) % (1 << 32)


def test_cuts_follow_content():
    base = RNG.randbytes(200_000)
    ends = cuts(base)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(base) and sizes.max() <= MAX_CHUNK and sizes[:-1].min() >= MIN_CHUNK
    one, two = recipe(base), recipe(b"new first bytes" + base)
    assert b"".join(raw for _, raw in one) == base
    shared = {d for d, _ in one} & {d for d, _ in two}
    assert len(shared) >= len(one) - 3
    assert cuts(b"\0" * 50_000)[-1] == 50_000


@pytest.mark.parametrize("limit", [1 << 28, 0])
def test_media_are_rebuilt_from_chunk_lists(spark, monkeypatch, limit):
    """limit 0: without a filter all media take the way of shared ones."""
    monkeypatch.setattr(module, "LENT_ROWS", 3)
    common = words(3000)
    texts = [None, "", "", "x" * 64, "x" * 65, "é" * 40, "\0" * 90_000] + [words(RNG.randint(1, 600)) for _ in range(20)]
    texts += [words(20) + common, common + words(5), common + "!", common + "!", common * 3, common + words(40)]
    big = 2**53 + 1
    rows = [(k, t, b"k", 1) for k, t in enumerate(texts)] + [(None, texts[9], b"k", 1), (9, texts[9], b"k", 1), (big, texts[9], b"k", 1)]
    kept = []
    real = module.staged
    monkeypatch.setattr(module, "staged", lambda df, name: kept.append((name, real(df, name))) or kept[-1][1])
    got = chunk_media(spark.createDataFrame(rows, "doc_id long, text string, key binary, n_bytes int").repartition(3), filter_limit=limit).collect()
    assert len(got) == len(rows) and sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(r[0] for r in rows if r[0] is not None)
    for r in got:
        text = texts[9] if r.doc_id in (None, big) else texts[r.doc_id]
        raw = (text or "").encode()
        want = raw + bytes(-len(raw) % 64) or bytes(64)
        assert payload(text) == (len(raw), want)
        with wave.open(io.BytesIO(wav(want))) as w:
            assert (w.getsampwidth(), w.getnchannels()) == (1, 1) and w.readframes(w.getnframes()) == want
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(want), len(wav(want)))
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.media_sha256 == hashlib.sha256(wav(want)).hexdigest()
        assert r.tail_crc32 == zlib.crc32(want[-64:]) and r.n_chunks == len(recipe(want))
    by_text = {((r.payload_sha256,), *r[1:]) for r in got}
    distinct = {(t or "") for t in texts}
    assert len(by_text) == len(distinct)
    # each distinct medium has one store row and one rebuilt one, and a chunk's bytes are in one row only
    stored = dict(kept)
    assert stored["store"].count() == stored["features"].count() == len(distinct)
    owned = [d for r in stored["store"].collect() for d in own_chunks(r.key, r.chunks, module.zstandard.decompress(r.data))]
    assert len(owned) == len(set(owned))
    long = [r for r in got if r.doc_id is not None and r.doc_id < 1000 and len(texts[r.doc_id] or "") > 15_000 and "\0" not in texts[r.doc_id]]
    assert len(long) == 6 and sum(r.n_lent > 5 for r in long) >= 4


def test_damage_is_an_error():
    samples = RNG.randbytes(2048)
    key, chunks, data = module.store_row(b"k", recipe(samples), {}, module.zstandard.ZstdCompressor())
    raw = module.zstandard.decompress(data)
    assert b"".join(own_chunks(key, chunks, raw).values()) == samples
    with pytest.raises(ValueError, match="digest"):
        own_chunks(key, chunks, b"?" + raw[1:])


def test_empty(spark):
    assert chunk_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0
