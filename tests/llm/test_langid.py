import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

import photonloom.llm.langid as module
from photonloom.llm.langid import Model, calibration_error, codes, fit, sampled, train, with_language

SYLLABLES = {"en": "the and tion ing er ou".split(), "de": "ung sch der ein ch ü".split(), "fr": "eau que é le oi ç".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_codes_of_blocks_equal_those_of_whole():
    long = "ab cé! 12 " * 300
    whole = np.sort(np.concatenate([*codes(long)]))
    kept, module._BLOCK = module._BLOCK, 64
    try:
        assert np.array_equal(np.sort(np.concatenate([*codes(long)])), whole)
    finally:
        module._BLOCK = kept
    assert sum(map(len, codes(None))) <= 3


def test_logits_equal_plain_sums():
    rng = random.Random(1)
    texts, langs = zip(*[(text(rng, lang, 20), lang) for lang in SYLLABLES for _ in range(30)])
    m = fit(list(texts), list(langs))
    c = np.concatenate([*codes(texts[0])])
    assert np.allclose(m.logits(texts[0]), m.bias + m.weights[m.row[c]].astype(float).mean(axis=0), atol=1e-5)
    assert len(m.used) < 0.1 * (1 << module.BITS) and (m.weights[1:] != 0).any(axis=1).all()


def test_fit_equals_plain_ftrl():
    """Each weight by its own sums, in dictionaries, after the same examples in the same order; then the best temperature of a grid."""
    rng = random.Random(4)
    texts, langs = map(list, zip(*[(text(rng, lang, 8), lang) for lang in SYLLABLES for _ in range(20)]))
    m = fit(texts, langs, seed=3)
    names, draw = sorted(SYLLABLES), np.random.default_rng(3)
    forms, y = [], []
    for t, lang in zip(texts, langs):
        words = t.split()
        start = int(draw.integers(0, max(1, len(words) - 5)))
        forms += [t, " ".join(words[start : start + int(draw.integers(2, 12))])]
        y += [names.index(lang)] * 2
    held = [k // 2 % 5 == 4 for k in range(len(forms))]
    counts = [Counter(np.concatenate([*codes(f)]).tolist()) for f in forms]
    tf = [{g: 100 * n / sum(c.values()) for g, n in c.items()} for c in counts]
    df = Counter(g for c, h in zip(counts, held) if not h for g in c)
    idf = {g: math.log((1 + len(forms)) / (1 + df[g])) for c in counts for g in c}
    z, n, bias, bias_n = defaultdict(float), defaultdict(float), [0.0] * 3, [0.0] * 3

    def weight(g, j):
        a = z[g, j]
        return 0.0 if abs(a) <= module.L1 else (math.copysign(module.L1, a) - a) / ((module.BETA + math.sqrt(n[g, j])) / module.ALPHA + module.L2)

    def shares(k):
        logits = [bias[j] + sum(v * idf[g] * weight(g, j) for g, v in tf[k].items()) for j in range(3)]
        return logits

    soft = lambda v: [math.exp(a - max(v)) / sum(math.exp(b - max(v)) for b in v) for a in v]
    for _ in range(module.EPOCHS):
        for k in draw.permutation(len(forms)):
            if held[k]:
                continue
            error = [p - (j == y[k]) for j, p in enumerate(soft(shares(k)))]
            for g, v in tf[k].items():
                for j in range(3):
                    grad, w = v * idf[g] * error[j], weight(g, j)
                    z[g, j] += grad - (math.sqrt(n[g, j] + grad**2) - math.sqrt(n[g, j])) / module.ALPHA * w
                    n[g, j] += grad**2
            for j in range(3):
                bias_n[j] += error[j] ** 2
                bias[j] -= 0.1 * error[j] / math.sqrt(1 + bias_n[j])
    assert np.allclose(m.bias, bias, atol=1e-3)
    for f in forms[:20]:
        for g in set(np.concatenate([*codes(f)]).tolist()):
            assert np.allclose(m.weights[m.row[g]], [100 * idf[g] * weight(g, j) for j in range(3)], atol=0.05, rtol=1e-3)
    logits = [(shares(k), y[k]) for k in range(len(forms)) if held[k]]
    loss = lambda t: -sum(math.log(soft([v / t for v in s])[c] + 1e-12) for s, c in logits)
    assert math.isclose(loss(m.temperature), min(map(loss, np.geomspace(0.05, 20, 121))), rel_tol=1e-2)


def test_six_hundred_languages(spark):
    rows = [(600 * j + k, f"{chr(0x4E00 + 2 * k)}{chr(0x4E01 + 2 * k)} " * 3, f"l{k:03}") for k in range(600) for j in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = train(df, sample_rows=3000)
    assert len(m.langs) == 600
    got = with_language(df, m)
    assert got.where("lang = lang_pred").count() > 0.9 * len(rows)


@pytest.mark.parametrize("value", [None, "", " 12 !", "☃"])
def test_no_letter(value):
    assert Model(["en"], np.empty(0, np.int64), np.empty(0, np.float32), np.zeros(1), 1.0).predict(value) == ("und", 0.0)


def test_held_out_accuracy_and_cases(spark):
    rng = random.Random(2)
    rows = [(k, text(rng, lang, rng.randint(2, 60)), lang, "q") for k, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(900))]
    rows += [(9001, None, "en", "q"), (9002, "", None, "q"), (9003, text(rng, "de", 30), None, "q"), (9003, text(rng, "de", 30), None, "q"), (None, text(rng, "fr", 30), "fr", "q")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, lang string, score string, found int")
    out = with_language(df, train(df))
    assert out.columns == ["doc_id", "text", "lang", "score", "found", "lang_pred", "_score"]
    got = out.toPandas()
    assert len(got) == len(rows) and got._score.between(0, 1).all() and set(got.score) == {"q"} and set(got.found) == {5}
    held = got[got.doc_id.map(lambda i: not math.isnan(i) and i < 9000 and crc32(str(int(i)).encode()) % 4 == 2)]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got[got.doc_id == 9003].lang_pred.tolist() == ["de", "de"] and set(got[got.doc_id.isin([9001, 9002])].lang_pred) == {"und"}
    assert calibration_error(with_language(df.drop("score").where("lang is not null"), train(df))) < 0.1
    long = spark.createDataFrame([(2**53 + 1, text(rng, "de", 200_000)), (None, "")], "doc_id long, text string")
    assert {(r.doc_id, r.lang_pred) for r in with_language(long, train(df)).collect()} == {(2**53 + 1, "de"), (None, "und")}


def test_labels_of_held_out_rows_are_not_read(spark):
    rng = random.Random(3)
    rows = [(k, text(rng, lang, 30), "held" if crc32(str(k).encode()) % 4 == 2 else lang) for k, lang in enumerate(list(SYLLABLES) * 20)]
    assert "held" not in train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert with_language(df, train(df)).count() == 0
    one = spark.createDataFrame([(2, "abc", None)], "doc_id long, text string, lang string")
    assert with_language(one, train(one)).first().lang_pred == "und"


def test_sample_is_bounded_and_never_empty(spark):
    """Null ids, one id or one text on very many rows neither fill the sample nor empty it."""
    ids = spark.range(60_000)
    lang = F.when(F.col("id") % 2 == 0, "en").otherwise("fr")
    text = F.concat(F.when(F.col("id") % 2 == 0, "the house of ").otherwise("la maison de "), F.conv(F.col("id").cast("string"), 10, 26))
    for name, key, words in (("nulls", F.lit(None).cast("long"), text), ("one id", F.when(F.col("id") % 3 == 0, F.lit(8).cast("long")).otherwise(F.col("id")), text), ("one text", F.when(F.col("id") % 3 == 0, F.lit(8).cast("long")).otherwise(F.col("id")), F.when(F.col("id") % 3 == 0, F.lit("the same")).otherwise(text))):
        df = ids.select(key.alias("doc_id"), words.alias("text"), lang.alias("lang"))
        rows = df.select(F.col("doc_id").cast("string").alias("id"), "lang", "text")
        sizes = {r.lang: r["count"] for r in sampled(rows, 200, 1000).groupBy("lang").count().collect()}
        assert sizes == {"en": 200, "fr": 200}, name
        assert {r.lang: r["count"] for r in sampled(rows, 200, 100).groupBy("lang").count().collect()} == {"en": 50, "fr": 50}
        assert train(df, per_lang=200).langs == ["en", "fr"], name
    few = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "id string, text string").withColumn("lang", F.lit("en"))
    assert sampled(few.select("id", "lang", "text"), 10, 10).count() == 2
