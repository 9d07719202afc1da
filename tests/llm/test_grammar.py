import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from photonloom.llm import grammar as module
from photonloom.llm.common import shared_path
from photonloom.llm.grammar import Encoder, Shard, packed, placed, read_documents, repaired, tokenizer_path, write_shards

SF = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


def test_pieces_give_the_ids_of_whole_texts(spark, whole):
    encoder = Encoder(tokenizer_path())
    for r in spark.read.parquet(SF).select("text").collect():
        assert ids_of(encoder, r.text or "") == whole(r.text or "")
    rng = random.Random(3)
    parts = [*"aZéÉßþÿ÷×ªºµ.,'!&?-_09", " ", "  ", "\n", "\t", "\r\n", " ", "́", "é", "İ", "Σ", "ς", "日本", "🙂", " ", "\x1c", "\x00", "'s", "'LL", "don't", "It's.", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|>", "<|", "|>", "ǅ", "ﬁ", "Å", "Å"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert ids_of(encoder, text) == whole(text), repr(text)


def test_kept_pieces_are_bounded(monkeypatch, whole):
    monkeypatch.setattr(module, "_CACHED", 10)
    encoder = Encoder(tokenizer_path())
    for k in range(300):
        text = f"word{k % 40} other, thing{k} {'x' * (k % 50)}"
        assert ids_of(encoder, text) == whole(text)
        assert len(encoder) <= 10 and len(encoder.before) <= 10


SEQUENCES = {
    "empty": np.empty(0, np.uint32),
    "one": np.array([7], np.uint32),
    "zeros": np.zeros(5000, np.uint32),
    "period": np.tile(np.arange(100, dtype=np.uint32), 70),
    "random": np.random.default_rng(1).integers(0, 5, 3000).astype(np.uint32),
    "many ids": np.random.default_rng(2).integers(0, 90_000, 120_000).astype(np.uint32),
}


@pytest.mark.parametrize("name", SEQUENCES)
def test_shards_decode_anywhere(name):
    ids = SEQUENCES[name]
    shard = Shard(packed(ids, ["1", None, "", "é"], [len(ids), 0, 0, 0]))
    assert np.array_equal(shard.decode(0, len(ids)), ids) and shard.doc_ids == ["1", None, "", "é"] and shard.doc_sizes.tolist() == [len(ids), 0, 0, 0]
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = np.sort(rng.integers(0, len(ids) + 1, 2)).tolist()
        assert np.array_equal(shard.decode(a, b), ids[a:b])
    raw = bytearray(packed(ids, [], []))
    raw[len(raw) // 2] ^= 1
    with pytest.raises(ValueError):
        Shard(bytes(raw))


def test_rules_replace_frequent_pairs():
    ids = SEQUENCES["period"]
    terminals, rules, lengths, seq = repaired(ids)
    assert len(seq) < len(ids) / 50 and (rules < len(terminals) + np.arange(len(rules))[:, None]).all()
    size = np.concatenate([np.ones(len(terminals), np.int64), lengths])
    assert size[seq].sum() == len(ids) and (lengths == size[rules].sum(axis=1)).all()
    codes = (seq[:-1].astype(np.int64) << 32) | seq[1:]
    assert np.unique(codes, return_counts=True)[1].max(initial=0) < 2 * module.LEAST
    unlike = repaired(np.arange(1000, dtype=np.uint32))
    assert len(unlike[1]) == 0 and len(unlike[3]) == 1000


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_files_give_every_document(spark, whole, size):
    texts = [(k, t) for k, t in enumerate(["", None, "a b c", "Hello, World's end!", "x" * 5000, "the same text here"] + ["the same text here"] * 20 + [f"document {k} is here, and there" for k in range(60)])]
    rows = [*texts, (3, "again three"), (None, "no id"), (None, "no id"), (2**53 + 1, "large id")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, shard string, part int").repartition(5)
    folder = shared_path(spark, "tokens")
    index = write_shards(df, folder, shard_tokens=size)
    got = read_documents(placed(index), folder).collect()
    own = lambda t: np.array([*whole(t or ""), 1], "<u4")
    assert sorted((str(r.id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(own(t)), zlib.crc32(own(t).tobytes())) for i, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted((i for i, _ in rows if i is not None)) + [None, None]
    # some documents only, decoded from the middle of their shards
    wanted = index.select("file", "offset", F.lit(1).cast("long").alias("first"), F.least(F.lit(3), F.col("n_docs")).alias("last")).where("last > 1")
    some = read_documents(placed(index), folder, wanted=wanted).collect()
    assert some and {(str(r.id), r.start, r.ids_crc32) for r in some} <= {(str(r.id), r.start, r.ids_crc32) for r in got}


def test_empty_table(spark):
    folder = shared_path(spark, "tokens")
    index = write_shards(spark.createDataFrame([], "doc_id long, text string"), folder)
    assert index.count() == 0 and read_documents(placed(index), folder).count() == 0


def test_blocks_of_texts_are_encoded_like_whole_texts_and_new_words_come_together(monkeypatch):
    own = Encoder(tokenizer_path())
    asked, learn = [], own._learn
    monkeypatch.setattr(own, "_learn", lambda words: asked.append(words) or learn(words))
    monkeypatch.setattr(module, "_CACHED", 300)
    rng = np.random.default_rng(4)
    marks = list("abcXYZàÉßÿñ'''.,!?-0129  \n\t\r|<>&ste")
    texts = ["", " ", "<|endoftext|>", "x" * 5000, "ÀB'Sx it's", "éa œuvre", *("".join(rng.choice(marks, 60)) for _ in range(400))]
    for most in (1000, 1 << 24):
        monkeypatch.setattr(module, "BLOCK_CHARS", most)
        for raw, text in zip(own.encode_all(texts), texts, strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    # one call for the new words of a block
    assert len(asked) <= sum(map(len, texts)) // 1000 + 2


def test_a_block_asks_for_each_word_once_whatever_stands_beside_it():
    class Counting(Encoder):
        asked = 0

        def __getitem__(self, piece):
            self.asked += 1
            return super().__getitem__(piece)

    own = Counting(tokenizer_path())
    words = ["".join(chr(97 + k // 26**j % 26) for j in range(3)) for k in range(900)]
    for marks in (",.", "'"):
        texts = [" ".join(f"{a}{m}{b}" for a, b, m in zip(words, words[k:] + words[:k], marks * 450)) for k in range(1, 5)] if marks != "'" else ["it's  'a b'c'd e.'f, g\n'", "'", "''a", "a' 'b", "é'É x.'"]
        for raw, text in zip(own.encode_all(texts), texts, strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
        # the 3600 pieces of the first texts are 900 known words and two marks
        assert own.asked < 20
    assert set(words) <= set(own.known)


def test_words_of_blocks_are_bounded(monkeypatch):
    monkeypatch.setattr(module, "_CACHED", 100)
    monkeypatch.setattr(module, "BLOCK_CHARS", 200)
    own = Encoder(tokenizer_path())
    texts = [" ".join("".join(chr(97 + (k + j * j) // 26**i % 26) for i in range(3)) for j in range(20)) + " x" * (k % 3) + "y" * 40 for k in range(300)]
    for raw, text in zip(own.encode_all(texts), texts, strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
        assert len(own.known) <= 200 and len(own.known) == len(own.sizes) and own.sizes.sum() == len(own.pool)


@pytest.mark.parametrize("kind", [np.uint32, np.uint64])
def test_chosen_pairs_are_found(kind):
    rng = np.random.default_rng(6)
    codes = (rng.integers(0, 1 << 12, 50_000) << (8 * np.dtype(kind).itemsize - 12)).astype(kind) + rng.integers(0, 3, 50_000).astype(kind)
    for n in (1, 2, 40, 3000):
        chosen = np.unique(rng.choice(codes, n))
        at, rule = module.ranked(chosen, codes)
        assert at.tolist() == np.flatnonzero(np.isin(codes, chosen)).tolist() and (chosen[rule] == codes[at]).all()
