import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from photonloom.llm import divergence as module
from photonloom.llm.divergence import OP11_SQL, divergence, share, shares

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least, top=10):
    """rows of (text, lang, source); all by whole numbers of any size."""
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((t or "", a or "", b or "") for t, a, b in rows):
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text)]
        groups[lang].add(source)
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= least]
        v = len(kept)
        p = {}
        whole = sum((n[lang, s] for s in sources), Counter())
        for s, c in [*((s, n[lang, s]) for s in sources), (None, whole)]:
            total = sum(c[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * v) for t in kept}
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(far(p[s][t], p[o][t]) for t in kept)) for o in sources - {s}]
            terms = [(t, far(p[s][t], p[None][t])) for t in kept if n[lang, s][t] and p[s][t] > p[None][t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.add((lang, s, part, item, value, k + 1))
    return out


def rows_of(seed=3):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("été", "Haus", "the", "ÀB", "x", "日本") for b in "abcdefgh"]
    rows = [(" ".join(rng.choice(words, rng.integers(1, 40))) + "! 12'é_z", str(rng.choice(["en", "fr"])), f"s{rng.integers(9)}") for _ in range(300)]
    rows += [(None, "en", "s1"), ("", None, None), ("lone words", "xx", "a"), ("lone words", "xx", "b"), ("12 34", "en", "mute"), ("Haus" * 20_000 + " hausa", "fr", "s1")]
    return rows + rows[:40]


@pytest.mark.parametrize(("chunk", "stripe", "block"), [(4096, 16, 64), (5, 2, 2), (1, 1, 1)])
def test_equals_plain(spark, chunk, stripe, block):
    rows = rows_of()
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], "text string, lang string, source string, whole int, term string").repartition(4)
    got = [tuple(r) for r in divergence(df, min_docs=5, chunk_terms=chunk, stripe_chunks=stripe, block_groups=block).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, 5)


def test_shares_are_exact(spark):
    pairs = [(0, 1, 1), (5, 7, 3), (2**52, 2**52 + 12345, 10**6), (8 * 10**15, 8_900_000_000_000_000, 10), (3, 999_999_937, 1)]
    df = spark.createDataFrame(pairs, "n long, total long, terms long").select(share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    want = [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in pairs]
    assert [r.p for r in df.collect()] == want and [int(shares(np.array([n]), t + 2 * v)[0]) for n, t, v in pairs] == want


def test_too_many_terms_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(module, "LARGEST", 20)
    with pytest.raises(ValueError, match="more than"):
        divergence(spark.createDataFrame(rows_of(), "text string, lang string, source string"), min_docs=5)


def test_empty(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence(df).count() == 0
    one = divergence(spark.createDataFrame([("a b", "en", "s")], df.schema))
    assert one.count() == 0 and one.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_sql_is_plain_too(spark):
    rows = rows_of(5)
    con = duckdb.connect()
    con.register("d", spark.createDataFrame([(t, a, b) for t, a, b in rows], "text string, lang string, source string").toPandas())
    con.execute("create view documents as select * from d")
    assert set(con.sql(OP11_SQL).fetchall()) == plain(rows, 10)
