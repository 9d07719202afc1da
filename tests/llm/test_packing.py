import random
import zlib

import duckdb
import numpy as np
from tokenizers import Tokenizer

from photonloom.llm import packing as module
from photonloom.llm.packing import WINDOW, Encoder, Index, fill, pack, sketches, terms, tokenizer_path


WHOLE = Tokenizer.from_file(tokenizer_path())


def ids_of(text):
    return np.array(WHOLE.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def test_encoder_equals_the_tokenizer():
    rng = random.Random(4)
    bits = ["a", "The", "don't", " ", "  ", "\n", "\t", "\xa0", "\x1c", "é", "語", "12", "...", "'s", "<|endoftext|>", "x" * 40, "\u2003", " $", "🙂"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    # any characters, white space among them more often
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts += ["".join(rng.choice(spaces) if rng.random() < 0.4 else chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0x10000, 0x11000), rng.randrange(32, 127)])) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    for text, ids in zip(texts, Encoder(tokenizer_path())(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == ids_of(text)[:-1].tolist(), repr(text)


def test_pieces_of_the_tables_equal_the_tokenizer():
    """Every distinct piece of the documents and pages of two scales."""
    db, pieces = duckdb.connect(), set()
    for table, column in (("documents", "text"), ("pages", "html"), ("benchmark", "text")):
        for (text,) in db.execute(f"select {column} from '/root/testdata/sf0.01/{table}.parquet' where {column} is not null").fetchall():
            head, *rest = text.split(" ")
            pieces |= {head, *(f" {p}" for p in rest)}
    pieces, encode = sorted(pieces), Encoder(tokenizer_path())
    for piece, want in zip(pieces, WHOLE.encode_batch(pieces, add_special_tokens=False)):
        assert np.frombuffer(encode.one(piece), "<u2").tolist() == want.ids, repr(piece)


def plain_bm25(tails, seed, idf, k1=1.2, b=0.75):
    mean = sum(map(len, tails)) / len(tails)
    out = []
    for t in tails:
        own = t.tolist()
        out.append(sum(idf[term] * own.count(term) * (k1 + 1) / (own.count(term) + k1 * (1 - b + b * len(own) / mean)) for term in set(tails[seed].tolist()) if term in own))
    return np.array(out)


def test_neighbours_and_fill_equal_brute_force():
    rng = np.random.default_rng(5)
    tails = [rng.zipf(1.5, rng.integers(1, 90)).clip(1, 400).astype("<u2") for _ in range(300)]
    idf = rng.random(1 << 16)
    index = Index(tails, idf)
    plain = np.array([plain_bm25(tails, k, idf) for k in range(len(tails))])
    for k in range(len(tails)):
        assert np.allclose(index.scores(k), plain[k])
    left, start, want = [len(t) for t in tails], [0] * len(tails), []
    for seed in sorted(range(len(tails)), key=lambda k: (-len(tails[k]), k)):
        if not left[seed]:
            continue
        now, room = [(seed, start[seed], left[seed])], 100 - left[seed]
        left[seed] = 0
        order = sorted((k for k in range(len(tails)) if left[k]), key=lambda k: (-index.scores(seed)[k], k)) if room else []
        for k in order:
            if room and left[k] <= room:
                now.append((k, start[k], left[k]))
                room, left[k] = room - left[k], 0
        cut = next((k for k in order if left[k]), None)
        if room and cut is not None:
            now.append((cut, start[cut], room))
            start[cut], left[cut] = start[cut] + room, left[cut] - room
        want.append(now)
    assert fill([len(t) for t in tails], index.scores, 100) == want


def test_index_ranks_by_shared_rare_tokens():
    tails = [np.array(x, "<u2") for x in ([1, 2, 3], [9, 9, 9], [3, 2, 7], [1, 8, 8])]
    scores = Index(tails, np.ones(1 << 16)).scores(0)
    assert scores[1] == 0 and scores[2] > scores[3] > 0


def check(got, rows):
    want = [ids_of(t) for _, t in rows]
    assert sum(got.length) == sum(map(len, want))
    for i, t in {(i, t) for i, t in rows if i is not None}:
        ids, copies = ids_of(t), sum(r == (i, t) for r in rows)
        own = got[got.doc_id == i].sort_values("start")
        assert own.length.sum() == copies * len(ids) and (own.doc_tokens == len(ids)).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        if copies == 1:
            assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= WINDOW


def test_pieces(spark):
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "ünï", "42", "x,y"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 40, 300, 900])))) for k in range(150)]
    rows += [(200, None), (201, "long " * 30000), (202, "same"), (202, "same"), (None, "no id"), (2**53 + 1, "exact id")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, shard string")
    out = pack(df, shard_rows=64)
    assert {r.doc_id for r in out.collect()} == {i for i, _ in rows}
    got = out.select(*[c for c in out.columns if c != "doc_id"], out.doc_id.cast("string").alias("doc_id")).toPandas()
    rows = [(None if i is None else str(i), t) for i, t in rows]
    check(got, rows)
    used = got.groupby("sequence_id").length.sum()
    assert (used < WINDOW).sum() <= 3


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).toPandas().empty


def test_neighbours_share_a_shard(spark):
    """Each fragment's three best BM25 neighbours, by brute force over all fragments, are mostly in its own shard."""
    rng = random.Random(8)
    topics = [["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(30)] for _ in range(40)]
    rows = [(k, " ".join(rng.choice(topics[k % 40]) if rng.random() < 0.7 else rng.choice(["the", "and", "of", "to", "in"]) for _ in range(60))) for k in range(1600)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shard_rows=128).toPandas()
    assert got.length.sum() == sum(len(ids_of(t)) for _, t in rows)
    shard = dict(zip(got.doc_id, got.sequence_id // 2**32))
    sizes = np.bincount([shard[k] for k, _ in rows])
    assert (sizes > 0).sum() > 8 and sizes.max() <= 3 * 128
    tails = [ids_of(t).astype("<u2") for _, t in rows]
    df_of = np.zeros(1 << 16)
    for t in tails:
        df_of[np.unique(t)] += 1
    index = Index(tails, np.log1p((len(rows) - df_of + 0.5) / (df_of + 0.5)))
    found = []
    for k in range(0, 1600, 7):
        scores = index.scores(k)
        scores[k] = -1
        found += [shard[j] == shard[k] for j in np.argsort(-scores, kind="stable")[:3]]
    assert np.mean(found) > 0.6


def test_many_copies_fill_several_shards(spark):
    rows = [(k, "one text that is always the same") for k in range(700)] + [(k, f"other {k} text {k * k}") for k in range(700, 900)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), shard_rows=64).toPandas()
    check(got, rows)
    assert got[got.doc_id < 700].groupby(got.sequence_id // 2**32).doc_id.nunique().max() <= 3 * 64


def test_a_block_of_texts_is_encoded_as_its_distinct_pieces_in_one_call(monkeypatch):
    encode = Encoder(tokenizer_path())
    texts = ["", " ", "w1 w2", " w3  w1 ", "a\n b\n\n  c\t", "é ü", "<|endoftext|> w1 w2", *(" ".join(f"w{k}" for k in range(j, j + 300)) for j in range(9))]
    asked, ranked = [], encode.ranked
    monkeypatch.setattr(encode, "ranked", lambda t: asked.append(t) or ranked(t))
    for raw, text in zip(encode(texts), texts, strict=True):
        assert np.frombuffer(raw, "<u2").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    # a call for the start of each text, and one for all pieces of each block; the special text parts two blocks
    assert len(asked) == len(texts) - 1 + 2 and max(asked, key=len).count(" w300 ") == 1


def test_terms_of_all_fragments_come_from_one_sort(monkeypatch):
    rng = np.random.default_rng(9)
    tails = [rng.integers(0, 1 << 16, n).astype("<u2") if n % 3 else rng.integers(0, 4, n).astype("<u2") for n in (0, 5, 900, 0, 3, 1, 60, 0)]
    want = [(k, int(t), int(c)) for k, x in enumerate(tails) for t, c in zip(*np.unique(x, return_counts=True))]
    assert list(zip(*(x.tolist() for x in terms(tails)))) == want
    assert [x.tolist() for x in terms([])] == [[], [], []]
    # more fragments than 16 bits count
    many = [np.array([k % 7, 1], "<u2") for k in range((1 << 16) + 9)]
    row, term, tf = terms(many)
    assert np.bincount(row).tolist() == [1 if k % 7 == 1 else 2 for k in range(len(many))] and tf.sum() == 2 * len(many) and np.bincount(term).tolist() == [sum(k % 7 == j for k in range(len(many))) + (j == 1) * sum(k % 7 != 1 for k in range(len(many))) for j in range(7)]
    idf, asked = rng.random(1 << 16).astype(np.float32), []
    # a call of np.unique for each fragment is what took the time
    monkeypatch.setattr(np, "unique", lambda *a, **b: asked.append(a))
    own, index = sketches(tails, idf, 50.0), Index([t for t in tails if len(t)], idf)
    monkeypatch.undo()
    assert not asked and index.n == 5 and np.allclose(np.linalg.norm(own, axis=1), [len(t) > 0 for t in tails], atol=1e-5)


def test_frequent_and_rare_tokens_score_alike(monkeypatch):
    rng = np.random.default_rng(10)
    tails = [rng.zipf(1.4, rng.integers(1, 200)).clip(1, 3000).astype("<u2") for _ in range(60)]
    idf = rng.random(1 << 16)
    for full in (1, 4, 1 << 20):
        monkeypatch.setattr(module, "FULL", full)
        index = Index(tails, idf)
        assert len(index.full) == (np.bincount(np.concatenate([np.unique(t) for t in tails])) * full > 60).sum()
        for k in range(60):
            assert np.allclose(index.scores(k), plain_bm25(tails, k, idf))
