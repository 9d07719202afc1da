import random
import re
from collections import Counter

import numpy as np
import pytest

import photonloom.llm.substring as module
from photonloom.llm.substring import WINDOW, Places, Shard, Words, remove_repeats, runs, split


def plain(texts):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(d[i : i + 35]) for d in docs for i in range(len(d) - 34))
    out = []
    for d in docs:
        gone = {k for i in range(len(d) - 34) if seen[tuple(d[i : i + 35])] > 1 for k in range(i, i + 35)}
        out.append((len(d), len(gone), " ".join(w for k, w in enumerate(d) if k not in gone)))
    return out


def test_hashes_do_not_depend_on_place():
    a, b = Words(split("x y é z w")), Words(split("q é z w y"))
    assert a.hashes(3)[2] == b.hashes(3)[1] and len(set(a.hashes(2).tolist())) == 4
    assert runs(np.array([True, True, False, True])) == [(0, 2), (3, 4)] and runs(np.empty(0, bool)) == []


def corpus():
    rng = random.Random(4)
    new = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    shared = [new(rng.choice([34, 35, 36, 54, 120, 400])) for _ in range(8)]
    texts = [None, "", "a b c", "a b c", " ".join(["again"] * 36), " ".join(["periodic", "text"] * 40), " ".join(new(35))]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = list(rng.choice(shared))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edit"
            if rng.random() < 0.3:
                p = p[rng.randrange(len(p)) :]
            parts += [p, new(rng.randint(0, 60))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(w for p in parts for w in p))
    texts += [texts[20], texts[20], texts[30] + " more", "x" * 70_000 + " " + texts[31]]
    twice = new(90)
    texts.append(" ".join(twice + ["mid"] + twice))
    return texts


@pytest.mark.parametrize("shard_words, slice_rows, limit", [(100_000, 20_000, 1 << 30), (300, 7, 1 << 30), (40, 50, 0)])
def test_equals_brute_force(spark, shard_words, slice_rows, limit):
    """limit 0: joins in place of filters. 40 words: anchors with more passages than a shard holds."""
    texts = corpus()
    df = spark.createDataFrame([(k, t, "w", 1) for k, t in enumerate(texts)], "doc_id long, text string, key string, n long").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(df, shard_words=shard_words, slice_rows=slice_rows, filter_limit=limit).collect()}
    for k, want in enumerate(plain(texts)):
        assert got[k] == want, k
    assert WINDOW == 35


def test_equal_hashes_are_not_enough():
    """A window is removed only where its words are those of a passage."""
    text = [f"v{k}" for k in range(40)]
    anchor = Words(" ".join(text).encode()).anchored()[0]
    shard = Shard([int(anchor.view(np.int64)[0])], [" ".join(text).encode()])
    places = Places([" ".join(text).encode()], np.array([6]))
    assert shard.occurrences(places).tolist() == list(range(6))
    shard.blob = shard.blob.replace(b"v2 ", b"v_ ")
    assert shard.occurrences(places).tolist() == [3, 4, 5]


def thue_morse(a, b, n=1024):
    return "".join(b if k.bit_count() % 2 else a for k in range(n))


@pytest.mark.parametrize("order", [(0, 1), (1, 0), (0, 1, 1), (1, 0, 0), (0, 0, 1)])
def test_words_that_a_sum_over_letters_confuses(spark, order):
    """Windows that differ in one word only, of letters whose polynomial hashes are equal modulo any power of two."""
    words = thue_morse("a", "b"), thue_morse("b", "a")
    texts = [" ".join([*(f"v{k}" for k in range(20)), words[o], *(f"v{k}" for k in range(21, 35))]) for o in order]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in remove_repeats(df).collect()}
    assert [got[k] for k in range(len(order))] == [35 if order.count(o) > 1 else 0 for o in order]


def test_word_hashes():
    words = sorted({w for n in range(1, 9) for w in (thue_morse("a", "b", n), "a" * n, "b" * n, "x" * n + "y")} | {"a" * 255, "a" * 256, "a" * 257, "b" * 300, "é", "\x00", "\x00\x00", thue_morse("a", "b", 128), thue_morse("b", "a", 128)})
    for lane in (0, 1):
        own = [module._word_hashes(w.encode(), np.array([0]), np.array([len(w.encode())]), lane)[0] for w in words]
        assert len(set(own)) == len(words)
        whole = Words(" ".join(words).encode())
        assert module._word_hashes(whole.blob, whole.start, whole.stop, lane).tolist() == own
    assert Words(b"").own.tolist() == []


def test_filter_is_sized_by_its_keys(spark):
    keys = spark.range(1000).withColumnRenamed("id", "h")
    known = module.Filter(module.filter_of(keys, module.F.col("h"), 1 << 20))
    assert 8 * len(known.bits) == 1 << 14 and known.has(np.arange(1000, dtype=np.uint64)).all()
    assert known.has(np.random.default_rng(1).integers(1 << 40, 1 << 63, 5000).astype(np.uint64)).mean() < 0.05
    assert module.filter_of(keys, module.F.col("h"), 1 << 13) is None


def test_periodic_passages_stay_cheap(spark):
    import time

    rows = [(k, " ".join((["the"] * (200 + k)) + [f"end{k}"] + (["of", "and"] * (100 + k)))) for k in range(60)]
    start = time.time()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k, _ in rows] == plain([t for _, t in rows]) and time.time() - start < 60


def test_ids_and_empty(spark):
    long = " ".join(f"v{k}" for k in range(50))
    df = spark.createDataFrame([(None, long), (3, long), (3, long), (4, None), (2**53 + 1, "few words")], "doc_id long, text string")
    got = remove_repeats(df).collect()
    assert sorted((r.n_words, r.n_removed, r.kept) for r in got) == [(0, 0, ""), (2, 0, "few words")] + [(50, 50, "")] * 3
    assert {r.doc_id for r in got} == {None, 3, 4, 2**53 + 1}
    assert remove_repeats(df.limit(0)).count() == 0


def test_settings_are_back_afterwards(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "a b c"), (None, None)], "doc_id long, text string")
    out = {r.doc_id: (r.n_words, r.n_removed) for r in module.remove_repeats(docs).collect()}
    assert out == {1: (3, 0), None: (0, 0)} and spark.conf.get(name) == before


def test_batches_of_the_whole_job_are_of_one_megabyte(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    monkeypatch.setattr(module, "_remove_repeats", lambda df, *rest: spark.conf.get(name))
    assert module.remove_repeats(spark.range(1)) == f"{1 << 20}b" and spark.conf.get(name) == before
