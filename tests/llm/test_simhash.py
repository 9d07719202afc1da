import random

import pytest
import xxhash

from photonloom.llm.common import hot_keys, join_split
from photonloom.llm.graph import connected_components
from photonloom.llm.simhash import agreeing, blocks_met, fingerprint, links, near_duplicates, part_masks


def plain_fingerprint(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    found = [(i, plain_fingerprint(t)) for i, t in rows]
    name = list(range(len(found)))
    changed = True
    while changed:
        changed = False
        for a in range(len(found)):
            for b in range(len(found)):
                if name[b] < name[a] and bin(found[a][1] ^ found[b][1]).count("1") <= 4:
                    name[a], changed = name[b], True
    least = {}
    for (i, _), n in zip(found, name):
        least[n] = min(least.get(n, i), i)
    return sorted((i, f"{fp:016x}", least[n]) for (i, fp), n in zip(found, name))


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "a b c", "a b c d", "A b\tC d e f g", "x " * 70001])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One  two")]
    for k in range(40):
        base = [rng.choice(words) for _ in range(120)]
        for c in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(120)] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component int")
    got = sorted(map(tuple, near_duplicates(df).collect()))
    assert got == plain_components(rows)


@pytest.mark.parametrize("tile, block", [(1, 1), (3, 2), (4, 100), (1000, 1)])
def test_tiles_and_blocks_lose_no_link(spark, tile, block):
    rng = random.Random(8)
    fps = set()
    for _ in range(12):
        seed = rng.getrandbits(63)
        fps |= {seed} | {seed ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for _ in range(6)}
    near = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4]
    edges = [tuple(r) for r in links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4, tile, block).collect()]

    def names(pairs):
        name = {f: f for f in fps}
        for _ in fps:
            for a, b in pairs:
                name[a] = name[b] = min(name[a], name[b])
        return name

    assert all((a ^ b).bit_count() <= 4 for a, b in edges) and names(edges) == names(near)


@pytest.mark.parametrize("agree, tile, block", [(0, 2, 2), (1, 1, 1), (1, 3, 2), (1, 1000, 1), (2, 2, 1), (2, 1000, 1)])
@pytest.mark.parametrize("radius", [0, 1, 4, 7])
def test_classes_lose_no_link(spark, radius, agree, tile, block):
    rng = random.Random(radius)
    seeds = [0, (1 << 64) - 1, *(rng.getrandbits(64) for _ in range(8))]
    fps = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(radius + 2))) for s in seeds for _ in range(10)}
    fps |= {s ^ 0xF << k for s in seeds[:3] for k in (0, 11, 24, 37, 49, 60)}
    signed = {f - (f >> 63 << 64) for f in fps}
    edges = [tuple(r) for r in links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius, tile, block, agree).collect()]
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius]

    def names(pairs):
        name = {f: f for f in signed}
        for _ in signed:
            before = dict(name)
            for a, b in pairs:
                name[a] = name[b] = min(name[a], name[b])
            if name == before:
                return name

    # a forest's edges may lead past several links, within one component
    assert names(edges) == names(near)


@pytest.mark.parametrize("radius, agree", [(0, 0), (0, 1), (4, 0), (4, 1), (4, 2), (4, 4), (70, 1)])
def test_any_radius_bits_leave_a_choice_of_parts_whole(radius, agree):
    masks, rng = part_masks(radius, agree), random.Random(5)
    for _ in range(500):
        flipped = sum(1 << b for b in rng.sample(range(64), min(radius, 64)))
        assert any(not flipped & m for m in masks)


def test_comparisons_grow_with_the_fingerprints_not_their_square(spark):
    rng = random.Random(6)
    fps = [(rng.getrandbits(64) - (1 << 63),) for _ in range(100_000)]
    met = blocks_met(spark.createDataFrame(fps, "fp long"))
    compared = met.selectExpr("sum(size(a) * size(b))").first()[0]
    # blocks of near population counts alone made a fifth of all pairs meet
    assert compared < len(fps) ** 2 / 500
    assert [agreeing(n, 4) for n in (0, 1000, 10**5, 10**7, 10**9)] == [0, 0, 1, 1, 2]


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).collect() == []
    twice = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    assert [r.component_id for r in near_duplicates(twice).collect()] == [5, 5, 5]
    exact = spark.createDataFrame([(2**53 + 1, "a b c d e"), (None, "other words that are here now")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(exact).collect()} == {(2**53 + 1, 2**53 + 1), (None, None)}


def test_hot_and_rare_keys_are_joined_alike(spark):
    big = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k}") for k in range(30_000)] + [(-1, None)], "n long, key string").repartition(4)
    counts = big.groupBy("key").count().withColumnRenamed("count", "n")
    hot = hot_keys(counts)
    assert [r.key for r in hot.collect()] == ["hot"]
    small = counts.where("key <> 'k9'").select("key", "n").withColumnRenamed("n", "m")
    got = {r.n: r.m for r in join_split(big, small, "key", hot).collect()}
    assert got == {k: 20_000 if k % 3 else (None if k == 9 else 1) for k in range(30_000)} | {-1: None}


def test_hub_and_common_label(spark):
    edges = [(5, k) for k in range(10, 9000)] + [(k, k + 1) for k in range(20_000, 20_020)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 5 for k in (5, *range(10, 9000))} | {k: 20_000 for k in range(20_000, 20_021)}


def test_chain_of_links(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 200), (200, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 200: 100}
