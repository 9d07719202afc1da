import random

import corpus_pipeline
from photonloom.llm.common import first_words
from photonloom.llm.packing import WINDOW
from photonloom.llm.pii import masked
from tests_plain import ids_of, plain_components

SYLLABLES = {"en": "the and tion ing er ou".split(), "de": "ung sch der ein ch ü".split()}


def test_stages_equal_plain_versions(spark, tmp_path):
    rng = random.Random(8)
    text = lambda lang, n: " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = []
    for k in range(200):
        lang = rng.choice(["en", "de"])
        t = text(lang, rng.randint(20, 200))
        if k % 9 == 4:
            t = rows[-1][1]
        if k % 10 == 0:
            t += f" a{k}@mail.example.com"
        rows.append((k, t, lang, rng.choice(["src0", "src1", "src5"]), len(t)))
    rows += [(300, None, "en", "src0", None), (301, "", "en", None, 0), (302, "12 34", None, "src1", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, row int, fp long, lang_pred double"
    spark.createDataFrame([(*r, "mine", 7, 8, 0.5) for r in rows], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    by_id = {r[0]: r for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.staged(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "row", "fp", "lang_pred"]
        assert docs.select("score", "row", "fp", "lang_pred").distinct().collect() == [("mine", 7, 8, 0.5)]
        after = {r.doc_id: r for r in docs.collect()}
        if name == "language":
            assert set(before) - set(after) == {300, 301, 302}
        elif name == "near_dedup":
            assert set(after) == {c for _, _, c in plain_components([(i, r.text) for i, r in before.items()])}
        elif name == "personal_data":
            assert {i: r.text for i, r in after.items()} == {i: masked(by_id[i][1]) for i in before}
            assert all(r.n_chars == len(r.text) for r in after.values())
        else:
            words = lambda d: sum(len(r.text.split()) for r in d.values())
            assert set(after) < set(before) and 0.8 * words(before) - 10 <= words(after) <= 0.8 * words(before)
            cut = [i for i, r in after.items() if r.text != before[i].text]
            assert len(cut) <= 6 and all(before[i].text.startswith(after[i].text) and after[i].n_chars == len(after[i].text) for i in cut)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).toPandas()
    assert packed.length.sum() == sum(len(ids_of(r.text)) for r in after.values())
    assert packed.groupby("sequence_id").length.sum().max() <= WINDOW
    again = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(again.doc_id) == set(packed.doc_id) and again.length.sum() == packed.length.sum()


def test_null_repeated_and_clashing_ids(spark, tmp_path):
    """Rows are told apart by place: different texts under one id or none all stay, copies leave one row."""
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice(SYLLABLES["en"]) for _ in range(rng.randint(1, 3))) for _ in range(40))
    one, two, three, four, big = text(), text(), text(), text(), 2**53 + 1
    rows = [(None, one), (None, two), (None, two), (5, three), (5, four), (5, three), (-3, two), (big, text()), (big + 1, text())]
    df = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df, "").collect()), key=str)
    want = [(None, one), (-3, two), (5, three), (5, four), *rows[-2:]]
    assert got == sorted(want, key=str)
    assert [r for r in (corpus_pipeline.near_dedup(spark, df.limit(0), "").collect())] == []
    mixed = corpus_pipeline.mixture(spark, df, "").collect()
    assert {r.doc_id for r in mixed} <= {r[0] for r in rows} and sum(len(r.text.split()) for r in mixed) == int(0.8 * 40 * len(rows))


def test_no_labels_at_all(spark):
    df = spark.createDataFrame([(1, "some words", None, "src1", 10), (2, "12", None, "src1", 2), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.language(spark, df, "").collect()] == [1]


def test_first_words(spark):
    for text in ("a b  c\n", "  a\tb c", "a", "", " "):
        for n in range(4):
            got = spark.createDataFrame([(text, n)], "t string, n int").select(first_words("t", "n").alias("x")).first().x
            assert text.startswith(got) and got.split() == text.split()[:n], (text, n, got)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_joined_and_united_tables_are_documents_too(spark, tmp_path):
    """A table without places in files is written first; its rows stay apart as those of a file do."""
    rng = random.Random(12)
    rows = [(k, " ".join("".join(rng.choice(SYLLABLES["en"]) for _ in range(2)) for _ in range(40)), "en", "src1", 9) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/d.parquet")
    docs = spark.read.parquet(f"{tmp_path}/d.parquet")
    labels = spark.createDataFrame([(k, 1) for k in range(6)], "doc_id long, quality int")
    for table, n in ((docs.join(labels, "doc_id", "left"), 12), (docs.union(docs), 12), (docs.where("doc_id > 3"), 8), (df, 12)):
        found = corpus_pipeline.near_dedup(spark, table, "")
        assert found.columns == table.columns and sorted(r.doc_id for r in found.collect()) == list(range(12))[-n:]
        assert 0 < corpus_pipeline.mixture(spark, table, "").count() <= table.count()
