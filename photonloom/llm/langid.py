"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties on a bounded sample of labelled
documents, then calibrated by a temperature on part of that sample. Predictions read whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonloom.llm.common import free_name, staged

UNKNOWN = "und"
#: Most sampled documents of each language, and of all together unless there are more languages: these bound what the fit reads.
SAMPLE_PER_LANG, SAMPLE_ROWS = 1500, 60_000
BITS = 17
ORDERS = (1, 2, 3)
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.05, 0.5, 2
_BLOCK, _ROWS = 1 << 18, 1 << 14
_SPACE = np.uint32(32)
# letters stay, all else becomes a space; texts are lower-cased before
_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)])


def codes(text: str | None) -> Iterator[np.ndarray]:
    """Hashed character n-grams of the lower-cased text, in blocks, white space at both ends."""
    points = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_LETTER[np.minimum(points, 0x2FFF)] | (points >= 0x3000), points, _SPACE)
    # runs of white space count once
    points = points[np.concatenate([[True], (points[1:] != _SPACE) | (points[:-1] != _SPACE)])] if len(points) else points
    most = max(ORDERS)
    for k in range(0, len(points), _BLOCK):
        part = points[k : k + _BLOCK + most - 1]
        out = []
        for n in ORDERS:
            stop = min(_BLOCK, len(points) - k - n + 1)
            if stop <= 0:
                continue
            h = np.full(stop, n, np.uint32)
            for j in range(n):
                h = (h ^ part[j : j + stop]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            out.append(h >> np.uint32(32 - BITS))
        if out:
            yield np.concatenate(out)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    """weights[row[feature], language] already hold the inverse document frequencies; features without a weight share row 0."""

    def __init__(self, langs: list[str], used: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.used, self.bias, self.temperature = langs, used, bias, temperature
        self.row = np.zeros(1 << BITS, np.int32)
        self.row[used] = np.arange(1, len(used) + 1)
        self.weights = np.concatenate([np.zeros((1, len(langs)), np.float32), weights.reshape(len(used), len(langs))])

    def logits(self, text: str | None) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for c in codes(text):
            rows = self.row[c]
            for k in range(0, len(rows), _ROWS):
                total += self.weights[rows[k : k + _ROWS]].sum(axis=0, dtype=np.float64)
            n += len(c)
        return self.bias + total / max(n, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and their shares of the text's n-grams, times a constant that steadies the step sizes."""
    c = np.concatenate([*codes(text), np.empty(0, np.uint32)]).astype(np.int64)
    found, n = np.unique(c, return_counts=True)
    return found, 100.0 * n / max(len(c), 1)


def fit(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """Every fifth document calibrates, the others train; each is learned whole and as a short piece of itself.

    Only features that the sample has are kept, so memory follows the sample and its languages.
    """
    names = sorted(set(langs))
    if not names:
        return Model([], np.empty(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0), 1.0)
    rng = np.random.default_rng(seed)
    x, y, held, number = [], [], [], {n: k for k, n in enumerate(names)}
    for k, (text, lang) in enumerate(zip(texts, langs)):
        words = text.split()
        start = int(rng.integers(0, max(1, len(words) - 5)))
        piece = " ".join(words[start : start + int(rng.integers(2, 12))])
        for form in (text, piece):
            x.append(_features(form))
            y.append(number[lang])
            held.append(k % 5 == 4 and len(texts) >= 50)
    seen = np.unique(np.concatenate([f for f, _ in x]))
    x = [(np.searchsorted(seen, f), tf) for f, tf in x]
    df = np.zeros(len(seen))
    for (f, _), h in zip(x, held):
        if not h:
            df[f] += 1
    idf = np.log((1 + len(x)) / (1 + df)).astype(np.float64)
    z, n = np.zeros((len(seen), len(names)), np.float32), np.zeros((len(seen), len(names)), np.float32)
    bias, bias_n = np.zeros(len(names)), np.zeros(len(names))

    def active(f: np.ndarray) -> np.ndarray:
        w = (np.sign(z[f]) * L1 - z[f]) / ((BETA + np.sqrt(n[f])) / ALPHA + L2)
        return np.where(np.abs(z[f]) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for k in rng.permutation(len(x)):
            if held[k]:
                continue
            f, tf = x[k]
            value = tf * idf[f]
            w = active(f)
            error = softmax(bias + value @ w)
            error[y[k]] -= 1.0
            g = value[:, None] * error
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA
            z[f] += g - sigma * w
            n[f] += g * g
            bias_n += error * error
            bias -= 0.1 * error / np.sqrt(1.0 + bias_n)
    weights = np.concatenate([active(np.arange(k, min(k + 4096, len(seen)))) for k in range(0, len(seen), 4096)])
    del z, n
    at = [k for k in range(len(x)) if held[k]] or range(len(x))
    logits = np.array([bias + (x[k][1] * idf[x[k][0]]) @ weights[x[k][0]] for k in at])
    truth = np.array([y[k] for k in at])
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    temperature = min(np.geomspace(0.05, 20, 121), key=loss)
    kept = weights.any(axis=1)
    return Model(names, seen[kept], (100.0 * idf[kept, None] * weights[kept]).astype(np.float32), bias, float(temperature))


def labelled(id_col: str = "doc_id", lang_col: str = "lang") -> Column:
    """Rows to learn from: crc32 of the id as text, modulo 4, is not 2, and the label is not null."""
    return ~held_out(id_col) & F.col(lang_col).isNotNull()


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def sampled(rows: DataFrame, per_lang: int, sample_rows: int) -> DataFrame:
    """Distinct rows (id, lang, text): of each language those with the smallest hashes of id and text.

    At most per_lang of a language, fewer where there are so many languages that this would exceed sample_rows
    in all, but one of each. Rows with one id, or with none, are told apart by their texts.
    """
    drawn = rows.withColumn("h", F.xxhash64("id", "text", F.lit("langid")))
    known = staged(drawn.select("lang", "h").distinct(), "drawn")
    each = min(per_lang, -(-sample_rows // max(1, known.select("lang").distinct().count())))
    ranked = known.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= each)
    # one row for each language, as the model itself has
    last = F.broadcast(staged(ranked.groupBy("lang").agg(F.max("h").alias("last")), "last"))
    return drawn.join(last, "lang").where("h <= last").dropDuplicates(["lang", "h"]).select("id", "lang", "text")


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of all languages in the rows that labelled() allows, fitted on sampled() of them in one task.

    Memory grows with the languages and with the features that the sample has. Rows with a null id are never
    held out. Without a labelled row the model has no language; of equal probabilities the first language wins.
    """
    rows = df.where(labelled(id_col, lang_col)).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def learn(x: pd.DataFrame) -> pd.DataFrame:
        x = x[x["text"].map(has_letter).astype(bool)].sort_values(["id", "text"], ignore_index=True)
        m = fit(x["text"].tolist(), x["lang"].tolist())
        return pd.DataFrame({"langs": [m.langs], "used": [m.used.astype("<u4").tobytes()], "weights": [m.weights[1:].tobytes()], "bias": [m.bias.tobytes()], "temperature": [m.temperature]})

    sample = sampled(rows, per_lang, sample_rows).withColumn("all", F.lit(1))
    found = sample.groupBy("all").applyInPandas(learn, "langs array<string>, used binary, weights binary, bias binary, temperature double").first()
    if found is None:
        return fit([], [])
    return Model(list(found.langs), np.frombuffer(found.used, "<u4").astype(np.int64), np.frombuffer(found.weights, np.float32), np.frombuffer(found.bias, np.float64), found.temperature)


def with_language(df: DataFrame, model: Model, text_col: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """df with the predicted language and its calibrated probability, in columns called as into says.

    All columns of df stay; where one has a name of into, the new column's name gets underscores before it.
    Null texts and texts without a letter get `und` and score 0; very long texts are read whole, in blocks;
    repeated rows each keep their row; an empty table gives an empty result.
    """
    # as large as the languages and the features with a weight, as the model is
    shared = df.sparkSession.sparkContext.broadcast(model)
    lang, score = (free_name(c, df.columns) for c in into)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for x in batches:
            yield pd.DataFrame([own.predict(t) for t in x], columns=["lang", "score"])

    both = free_name("found", df.columns)
    found = df.withColumn(both, F.pandas_udf(run, "lang string, score double")(F.col(f"`{text_col}`")))
    return found.select(*[F.col(f"`{c}`") for c in df.columns], F.col(f"{both}.lang").alias(lang), F.col(f"{both}.score").alias(score))


def calibration_error(rows: DataFrame, truth: str = "lang", bins: int = 10) -> float:
    """Expected calibration error of lang_pred and score against truth."""
    right = (F.col("lang_pred") == F.col(truth)).cast("double")
    parts = rows.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg(right).alias("right"), F.avg("score").alias("score")).collect()
    total = sum(r.n for r in parts)
    return math.fsum(r.n * abs(r.right - r.score) for r in parts) / max(total, 1)


def op5_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return with_language(docs.select("doc_id", held_out().alias("held_out"), "text"), train(docs)).drop("text")
