import math
import random
import re

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

import photonloom.llm.urls as module
from photonloom.llm.urls import RULES, judge, sampled, train, with_lexical

URLS = [None, "", "nothing", "http://", "HTTP://A.Example.ORG/es/x?y#z", "http://example.org", "http://example.org?x=/es/", "http://example.org/en/12", "http://notexample.org/es/", "http://com/fr/", "http://a.com/de/1?b=c&d=e#f", "ftp://x://y/z", "http://a.net/\nq", "http://org:80/", "http://" + "a" * 50000 + ".com/fr/"]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, says in RULES:
        own, begin = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + begin):
            fits.append((len(rule), rule, says))
    _, rule, says = max(fits, default=(0, None, None))
    return host, path, rule, says


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(1)
    more = []
    for _ in range(600):
        tld, lang = rng.choice(["com", "org", "net"]), rng.choice(["en", "fr", "de", "es"])
        tail = rng.choice(["", "?utm=1&x=2"]) if lang in ("en", "fr") else f"{rng.randint(1000, 99999)}?id={rng.randint(1, 10**9)}&s={rng.randint(1, 10**9)}"
        more.append(f"https://{rng.choice('abcd')}.example.{tld}/{lang}/{rng.randint(1, 99)}{tail}")
    urls = URLS + more + more[:5]
    df = spark.createDataFrame([(k, u, "h", 1.0) for k, u in enumerate(urls)], "page_id long, url string, host string, suffix_rows double")
    return urls, judge(df).collect(), df


def test_rules(judged):
    urls, got, _ = judged
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, says = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == says if says else r.verdict in ("allow", "block")


def test_trees_learn_what_is_lexical(spark):
    rng = random.Random(2)
    rows = []
    for k in range(500):
        bad = rng.random() < 0.4
        tail = f"{rng.randint(10**6, 10**9)}?id={rng.randint(1, 10**9)}&s=1" if bad else "/".join(rng.choice(["news", "about", "team"]) for _ in range(2))
        rows.append((f"http://{rng.choice('abc')}.{rng.choice(['com', 'net'])}/{tail}", "block" if bad else "allow"))
    df = with_lexical(spark.createDataFrame(rows, "url string, label string"))
    out = train(df).verdict(df)
    assert out.where("learned = label").count() > 480


def test_every_suffix_has_statistics(spark):
    """1500 suffixes, one of which a third of all rows have."""
    rows = [(f"http://a.s{k}/{'b' if k % 3 else 'c'}/{j}", "block" if k % 3 else "allow") for k in range(1500) for j in range(2)] + [(f"http://x{j}.hot/", "block") for j in range(1500)]
    df = with_lexical(spark.createDataFrame(rows, "url string, label string"))
    model = train(df)
    assert model.suffixes.count() == 1501
    got = {(r.suffix, r.suffix_rows, round(r.suffix_share, 6)) for r in model.features(df).collect()}
    assert got == {(f"s{k}", 2.0, 0.75 if k % 3 else 0.25) for k in range(1500)} | {("hot", 1500.0, round(1501 / 1502, 6))}


def plain_features(url, suffix_rows, suffix_share):
    host, path, *_ = plain(url)
    url = url or ""
    m = re.search(r"\?([^#]*)", url)
    query, text = m[1] if m else "", host + path
    entropy = -sum(text.count(c) / len(text) * math.log(text.count(c) / len(text)) for c in set(text))
    return [len(url), len(host), len(path), path.count("/"), host.count("."), sum(c in "0123456789" for c in url) / max(len(url), 1), host.count("-"), entropy, query.count("&") + 1 if query else 0, len(query), suffix_share, suffix_rows]


def test_verdicts_equal_trees_on_plain_features(judged):
    """The model's trees, walked on features computed in plain Python."""
    urls, _, df = judged
    rows = with_lexical(df.select("page_id", "url"))
    _, says = module.rule_of("host", "path")
    model = train(rows.withColumn("says", says), "says")
    labels = {k: plain(u)[3] for k, u in enumerate(urls)}
    by = {}
    for k, u in enumerate(urls):
        if labels[k]:
            by.setdefault(plain(u)[0].split(".")[-1], []).append(labels[k] == "block")
    every = [v for own in by.values() for v in own]
    for r in model.verdict(rows).collect():
        own = by.get(plain(r.url)[0].split(".")[-1])
        share, n = ((sum(own) + 1) / (len(own) + 2), len(own)) if own else (sum(every) / len(every), 0)
        x = plain_features(r.url, n, share)
        assert r.learned == ("block" if model.trees.predict(Vectors.dense(x)) > 0 else "allow"), r.url


def test_ids_stay_exact(spark):
    df = spark.createDataFrame([(2**53 + 1, "http://a.org/"), (None, None)], "page_id long, url string")
    assert {r.page_id for r in judge(df).collect()} == {2**53 + 1, None}


def test_no_python_on_the_executors(judged):
    plan = judge(judged[2])._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_entropy(spark):
    rows = with_lexical(spark.createDataFrame([("http://aab/bé",)], "url string")).first()
    counts = [2, 2, 1, 1]
    assert math.isclose(rows.entropy, -sum(c / 6 * math.log(c / 6) for c in counts)) and rows.depth == 1


def test_one_class_and_empty(spark):
    one = spark.createDataFrame([(1, "http://a.org/"), (2, "http://b.net/")], "page_id long, url string")
    assert {r.verdict for r in judge(one).collect()} == {"allow"}
    assert judge(one.limit(0)).count() == 0


def test_sample_is_of_distinct_urls(spark):
    """A URL on two thirds of the rows is one of the sample, with its rows as weight."""
    n = F.col("id")
    df = spark.range(30_000).select(F.when(n % 3 > 0, "https://a.com/de/hot").otherwise(F.concat(F.lit("https://b.org/x"), n)).alias("url"), F.when(n % 3 > 0, "block").otherwise("allow").alias("label"))
    rows = with_lexical(df)
    found = {(r.host, r.path): r.n for r in sampled(rows, 20_000).collect()}
    assert len(found) == 10_001 and found["a.com", "/de/hot"] == 20_000
    few = sampled(rows, 500).collect()
    assert len(few) == 500 and sampled(rows.limit(0), 500).count() == 0
    assert train(df.transform(with_lexical)).verdict(rows).where("learned <> label").count() == 0
