import random
import re

import numpy as np
import pytest

import photonloom.llm.quality as module
from photonloom.llm.quality import D, FLOORS, estimates, quality, shrunk, statistics


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    cover = {k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def test_counts():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "é ü x\x85y", "a b\na b\n\n a b\na b", "a a a a a a a", "x | y ### <b>\n"]
    texts += [" ".join(rng.choice("abc") + rng.choice(["", "\n"]) for _ in range(60)) for _ in range(20)]
    for t in texts:
        assert statistics(t)[:5] == plain(t), t


def test_outliers_and_cases(spark):
    rng = random.Random(2)
    syll = ["an", "the", "tion", "er", "ou", "re", "st", "ed"]
    word = lambda: "".join(rng.choice(syll) for _ in range(rng.randint(1, 4)))
    clean = [" ".join(word() for _ in range(rng.randint(30, 400))) for _ in range(600)]
    junk = [" ".join(word().upper() + "$$$" for _ in range(100)) for _ in range(30)]
    rows = [(k, t, "en", "hot" if k % 3 else f"s{k % 7}", "x") for k, t in enumerate(clean + junk)]
    rows += [(2**53 + 1, clean[1], "en", "", None), (None, clean[2] * 300, "en", "s1", None)]
    rows += [(900, None, None, None, None), (901, "", "en", None, None), (902, "few words", "de", "q", None), (903, clean[0], None, "q", None), (903, clean[0], None, "q", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, grp string")
    got = quality(df).toPandas()
    assert len(got) == len(rows)
    assert {r.doc_id for r in quality(df.where("doc_id is null or doc_id > 890")).collect()} == {None, 900, 901, 902, 903, 2**53 + 1}
    good = got[got.doc_id < 600]
    assert good.kept.all() and not got[(got.doc_id >= 600) & (got.doc_id < 630)].kept.any()
    assert list(got[got.doc_id.between(900, 902)].sort_values("doc_id").base_failed) == [True] * 3
    assert got[got.doc_id == 903].kept.tolist() == [True, True]
    assert np.isfinite(got.distance).all() and len(FLOORS) == 5


def plain_estimate(z, starts, keep=module.KEEP):
    """Concentration from each start on exact quantiles; the smallest determinant."""
    best = None
    for centre, cov in starts:
        before = np.inf
        for _ in range(module.MAX_STEPS):
            p = np.linalg.inv(cov + np.diag(np.square(FLOORS)))
            far = np.einsum("ni,ij,nj->n", z - centre, p, z - centre)
            near = z[np.argsort(far, kind="stable")[: int(np.ceil(keep * len(z)))]]
            centre, cov, middle = near.mean(axis=0), np.cov(near.T, bias=True), np.median(far)
            det = np.linalg.slogdet(cov + np.diag(np.square(FLOORS)))[1]
            if before - det <= module.TOLERANCE:
                break
            before = det
        if best is None or det < best[0]:
            best = det, centre, cov, middle
    return best


def test_estimates_equal_plain_concentration(spark):
    """Groups with junk of up to 45 percent far off, which no estimate may follow, and one of 20 rows."""
    rng = np.random.default_rng(3)
    groups = {}
    for name, n, junk in (("a", 900, 0.0), ("b", 900, 0.3), ("c", 900, 0.45), ("d", 20, 0.2)):
        mix = rng.normal(size=(D, D)) * 0.4 + np.eye(D)
        own = rng.normal(size=(n, D)) @ mix
        own[: int(n * junk)] = rng.normal(size=(int(n * junk), D)) * 0.2 + 15
        groups[name] = own
    every = np.concatenate(list(groups.values()))
    rows = [(g, *map(float, r)) for g, z in groups.items() for r in z] + [("[]", *map(float, r)) for r in every]
    got = {r.grp: r for r in estimates(spark.createDataFrame(rows, "grp string, " + ", ".join(f"z{i} double" for i in range(D)))).collect()}
    for name, z in groups.items():
        mad = lambda v: 1.4826 * np.median(np.abs(v - np.median(v, axis=0)), axis=0)
        starts = [(np.median(z, axis=0), mad(z)), (z.mean(axis=0), z.std(axis=0)), (every.mean(axis=0), every.std(axis=0))]
        _, centre, cov, middle = plain_estimate(z, [(c, np.diag(np.square(s))) for c, s in starts])
        assert got[name].n == len(z)
        assert np.abs(np.array(got[name].centre) - centre).max() < (0.15 if len(z) > 100 else 0.6)
        assert np.allclose(np.array(got[name].cov).reshape(D, D), cov, atol=0.2 if len(z) > 100 else 1.2)
        assert np.abs(centre).max() < 2 and 0.6 < got[name].middle / middle < 1.7


def test_small_groups_lean_on_the_group_above():
    above = np.zeros(D), np.eye(D)
    for n, low, high in ((1, 0.0, 0.2), (50, 0.9, 1.1), (5000, 1.9, 2.1)):
        centre, _ = shrunk((n, np.full(D, 2.0), np.eye(D), 1.0), above)
        assert low <= centre[0] <= high


def test_null_and_empty_languages_are_apart(spark):
    text = lambda k, w: " ".join(w * (k % 5 + 1) for _ in range(40 + k % 7))
    rows = [(k, text(k, "ab"), None, "s") for k in range(120)] + [(200 + k, text(k, "abcdefghijkl"), "", "s") for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = []
    real, module_staged = module.staged, lambda d, n: kept.append((n, real(d, n))) or kept[-1][1]
    module.staged = module_staged
    try:
        quality(df).count()
    finally:
        module.staged = real
    assert {r.grp for r in dict(kept)["precisions"].collect()} == {'[null,"s"]', '["","s"]'}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality(df).count() == 0


@pytest.mark.parametrize("share", [4096, 3])
def test_hot_groups_and_unsettled_estimates(spark, monkeypatch, share):
    """Groups above the share are joined where their rows are, the others are dealt; the estimates are the same."""
    import photonloom.llm.common as common

    rng = np.random.default_rng(4)
    rows = [(g, *rng.normal(size=D).tolist()) for g, n in (("[]", 300), ("a", 80), ("b", 60)) for _ in range(n)]
    df = spark.createDataFrame(rows, "grp string, " + ", ".join(f"z{i} double" for i in range(D)))
    want = {r.grp: r for r in estimates(df).collect()}
    monkeypatch.setattr(common, "HOT_SHARE", share)
    got = {r.grp: r for r in estimates(df).collect()}
    assert set(got) == {"[]", "a", "b"} and all(r.settled for r in got.values())
    for g, r in got.items():
        assert np.allclose(r.centre, want[g].centre) and np.allclose(r.cov, want[g].cov) and r.n == want[g].n
    monkeypatch.setattr(module, "MAX_STEPS", 1)
    with pytest.warns(UserWarning, match="not settled"):
        found = estimates(df).collect()
    assert len(found) == 3 and not any(r.settled for r in found)
