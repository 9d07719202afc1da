import hashlib
import random
from collections import defaultdict

import duckdb
import pytest

import photonloom.llm.mixing as module
from photonloom.llm.mixing import OP4_SQL, mix, op4_mixing
from photonloom.llm.warc import OP8_SQL, op8_warc


def shares(caps, weights, budget):
    """Plain water filling: those that can't use their share keep what they have, the others divide the rest."""
    out, left, free = {}, budget, dict(caps)
    while free:
        total = sum(weights[k] for k in free)
        full = [k for k in free if free[k] <= left * weights[k] / total]
        if not full:
            return out | {k: left * weights[k] / total for k in free}
        for k in full:
            out[k] = free.pop(k)
        left = budget - sum(out.values())
    return out


@pytest.mark.parametrize("share, epochs, rows_per_bucket", [(0.5, 2, 7), (0.9, 1, 10_000), (3.0, 2, 5)])
def test_equals_plain(spark, monkeypatch, share, epochs, rows_per_bucket):
    monkeypatch.setattr(module, "ROWS_PER_BUCKET", rows_per_bucket)
    rng = random.Random(5)
    rows = [(k, rng.choice(["a", "b", None]), rng.choice(["en", "de"]), rng.choice(["s0"] * 6 + ["s1", "s2"]), rng.choice([0, 3, 50, 400])) for k in range(300)]
    weights = {"domain": {"a": 3.0}, "lang": {"en": 2.0}, "source": {"s1": 4.0}}
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, dom string, lang string, source string, n long, budget string")
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in mix(df, weights, share, epochs, 9, domain=F.col("dom"), tokens=F.col("n")).collect()}
    leaf = defaultdict(list)
    for i, d, g, s, n in rows:
        leaf[(d or "", g, s)].append((i, n))
    cap = {k: epochs * sum(n for _, n in v) for k, v in leaf.items()}
    total = min(int(share * sum(r[4] for r in rows)), sum(cap.values()))
    up = lambda depth, under: {p: sum(c for k, c in cap.items() if k[: depth + 1] == p) for p in {k[: depth + 1] for k in cap if k[:depth] == under}}
    w = lambda depth, keys: {k: weights[("domain", "lang", "source")[depth]].get(k[depth], 1.0) for k in keys}
    taken = 0
    for d, b in shares(up(0, ()), w(0, up(0, ())), total).items():
        for g, c in shares(up(1, d), w(1, up(1, d)), b).items():
            for k, alloc in shares(up(2, g), w(2, up(2, g)), c).items():
                tokens, alloc = sum(n for _, n in leaf[k]), int(alloc + 1e-9)
                whole = alloc // tokens if tokens else 0
                rest = alloc - whole * tokens
                for i, n in sorted(leaf[k], key=lambda r: (hashlib.md5(f"9:{whole}:{r[0]}".encode()).hexdigest(), r[0])):
                    part = min(n, rest)
                    rest -= part
                    assert (got[i].epochs, got[i].partial_tokens, got[i].tokens_taken) == (whole, part, whole * n + part)
                    taken += got[i].tokens_taken
    assert total - len(leaf) <= taken <= total


def test_cases(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "a b c", "en", "s"), (2, "a b c", "en", "s"), (None, "", "en", "s")], "doc_id long, text string, lang string, source string")
    got = mix(df, {}, 0.5).toPandas()
    assert len(got) == 4 and got.tokens_taken.sum() == 3
    assert mix(df.limit(0), {}, 0.5).count() == 0
    with pytest.raises(ValueError):
        mix(df, {"lang": {"en": 0}}, 0.5)


@pytest.mark.parametrize("name", ["op4", "op8"])
def test_sql_gives_the_same_rows(spark, name):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, sql = (op4_mixing(spark, sf), OP4_SQL) if name == "op4" else (op8_warc(spark, sf), OP8_SQL)
    want = db.sql(f"select {', '.join(chr(34) + c + chr(34) for c in df.columns)} from ({sql})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    assert [t for _, t in df.dtypes] == [{"BIGINT": "bigint", "VARCHAR": "string"}[str(t)] for t in db.sql(f"select {', '.join(chr(34) + c + chr(34) for c in df.columns)} from ({sql})").types]
