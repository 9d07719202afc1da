"""SimHash near-duplicates: exact tiled comparison of the distinct fingerprints that can be near.

Of radius + 1 parts of their bits, two fingerprints within the radius agree in one part at least, so a
class has the fingerprints that agree in a part; of many fingerprints in two parts of radius + 2, and so on. Their
population counts differ by the radius at most: a class too large for a block is cut by the population counts
of both 32-bit halves, a smaller one is sorted by them, and only tiles and strips of near counts are compared, with
numpy exclusive-or and bit counts. A tile pair returns a spanning forest of its links, never the links of a
group to each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonloom.llm.common import as_id, as_text, hot_keys, join_split, small_batches, staged
from photonloom.llm.graph import connected_components

RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
TILE_ROWS = 4096
#: Tiles of a block. Blocks are shuffled and meet in pairs, their tiles are compared in the task, so that an eighth as much is moved.
BLOCK_TILES = 8
_STRIP = 64
#: Comparisons that take as long as dealing a fingerprint to a class.
_DEALT = 8192
_BLOCK = 65536


def fingerprint(text: str | None, width: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles; 0 without words, the whole sequence if it is short."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: max(0, len(words) - width)]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s : e - 1], seed) for s, e in zip(starts, ends[min(width, len(words)) - 1 :])], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _BLOCK):
        part = hashes[k : k + _BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per input row, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            fp = np.array([fingerprint(t) for t in x["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"id": x["id"], "fp": fp})

    found = df.select(as_text(df, id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id string, fp long")
    return found.select(as_id(df, id_col).alias("id"), "fp")


def as_hex(fp: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it is linked to."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles, or within one, that are sorted by population count: at most one link for each fingerprint."""
    values, shift = (a, 0) if same else (np.concatenate([a, b]), len(a))
    ones, others = (np.bitwise_count(x).astype(np.int64) for x in (a, b))
    i = j = np.empty(0, np.int64)
    for k in range(0, len(a), _STRIP):
        # population counts of linked fingerprints differ by the radius at most
        first, last = np.searchsorted(others, [ones[k] - radius, ones[k : k + _STRIP][-1] + radius + 1])
        first = max(first, k) if same else first
        # flatnonzero takes a quarter of the time of nonzero on two dimensions
        near = np.flatnonzero(np.bitwise_count(a[k : k + _STRIP, None] ^ b[None, first:last]) <= radius)
        if len(near):
            x, y = np.divmod(near, last - first)
            x, y = x + k, y + first
            if same:
                x, y = x[x < y], y[x < y]
            label = forest(len(values), np.concatenate([i, x]), np.concatenate([j, y + shift]))
            i = np.flatnonzero(label != np.arange(len(values)))
            j = label[i]
    return values[i], values[j]


def block_links(a: np.ndarray, b: np.ndarray, radius: int, tile_rows: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links of each pair of tiles of two blocks; of a block with itself each pair once."""
    a, b = (x[np.argsort(np.bitwise_count(x), kind="stable")] for x in (a, b))
    for i in range(0, len(a), tile_rows):
        for j in range(i if same else 0, len(b), tile_rows):
            yield tile_links(a[i : i + tile_rows], b[j : j + tile_rows], radius, same and i == j)


def agreeing(n: int, radius: int) -> int:
    """In how many parts the fingerprints of a class agree, so that n of them take the fewest comparisons; 0: one class of all."""
    classes = {c: (comb(radius + c, c), 64 * c // max(1, radius + c)) for c in range(5)}
    return min(classes, key=lambda c: classes[c][0] * (n / 2 ** classes[c][1] + _DEALT))


def part_masks(radius: int, agree: int) -> list[int]:
    """Bits of every choice of agree parts out of radius + agree. As radius bits lie in radius parts at most, linked fingerprints agree in all bits of one choice."""
    parts = radius + agree
    ends = [64 * k // max(1, parts) for k in range(parts + 1)]
    masks = [(1 << y) - (1 << x) for x, y in zip(ends, ends[1:])]
    return [sum(chosen) for chosen in combinations(masks, agree)]


def blocks_met(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS, block_tiles: int = BLOCK_TILES, agree: int | None = None) -> DataFrame:
    """(a, b, itself): pairs of blocks, arrays of fingerprints, whose fingerprints are compared. Linked fingerprints meet in one pair at least.

    A class has the fingerprints that agree in one choice of parts. One that fits a block meets itself; a larger one
    is cut by the population counts of both halves, and blocks of near counts meet.
    """
    agree = agreeing(distinct.count(), radius) if agree is None else agree
    signed = [m - (m >> 63 << 64) for m in part_masks(radius, agree)]
    slots = F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for k, m in enumerate(signed)]))
    dealt = distinct.select("fp", slots.alias("of")).select("fp", "of.slot", "of.key")
    large = staged(dealt.groupBy("slot", "key").agg(F.count("*").alias("n")).where(F.col("n") > tile_rows * block_tiles).select("slot", "key"), "large")
    if large.isEmpty():
        return _own(dealt)
    return _own(dealt.join(large, ["slot", "key"], "left_anti")).union(_split(dealt.join(large, ["slot", "key"]), radius, tile_rows * block_tiles))


def _own(dealt: DataFrame) -> DataFrame:
    return dealt.groupBy("slot", "key").agg(F.collect_list("fp").alias("a")).select("a", F.col("a").alias("b"), F.lit(True).alias("itself"))


def _split(dealt: DataFrame, radius: int, block_rows: int) -> DataFrame:
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    halves = dealt.select("slot", "key", "fp", F.bit_count(F.shiftrightunsigned("fp", 32)).alias("hi"), F.bit_count(low).alias("lo"))
    kind = ["slot", "key", "hi", "lo"]
    # at most 33 x 33 kinds of a large class, of which there are few
    kinds = halves.groupBy(*kind).agg(F.ceil(F.count("*") / block_rows).cast("long").alias("parts"))
    blocks = (
        halves.join(F.broadcast(kinds), kind)
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
        .groupBy(*kind, "part")
        .agg(F.collect_list("fp").alias("fps"))
    )
    blocks = staged(blocks, "blocks")
    steps = [(x, y) for x in range(radius + 1) for y in range(-radius, radius + 1) if abs(x) + abs(y) <= radius and (x > 0 or y >= 0)]
    step = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps])).alias("step")
    left = (
        blocks.select("*", step)
        .select("slot", "key", F.col("fps").alias("a"), F.col("part").alias("own"), F.expr("step.x = 0 and step.y = 0").alias("same"), (F.col("hi") + F.col("step.x")).alias("hi"), (F.col("lo") + F.col("step.y")).alias("lo"))
        .join(F.broadcast(kinds), kind)
        .select("slot", "key", "a", "own", "same", "hi", "lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        .where("not same or own <= part")
    )
    return left.join(blocks, [*kind, "part"]).select("a", F.col("fps").alias("b"), F.expr("same and own = part").alias("itself"))


def links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS, block_tiles: int = BLOCK_TILES, agree: int | None = None) -> DataFrame:
    """(a, b) over a table of distinct fingerprints fp: edges with the same components as all pairs within radius."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            # one table for many small classes
            found = []
            for a, b, itself in zip(x["a"], x["b"], x["itself"]):
                found += block_links(np.asarray(a, np.int64).view(np.uint64), np.asarray(b, np.int64).view(np.uint64), radius, tile_rows, itself)
            if found:
                i, j = (np.concatenate(side).view(np.int64) for side in zip(*found))
                yield pd.DataFrame({"a": i, "b": j})

    return blocks_met(distinct, radius, tile_rows, block_tiles, agree).mapInPandas(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id): the component's smallest id, over links of at most radius bits.

    Null texts and texts without words have fingerprint zero and link like any other; very long texts are
    read whole. Repeated rows and repeated ids each keep their row. A null id takes part in links but never
    names a component unless all its ids are null. Other columns of df, of whatever name, are ignored. An
    empty table gives an empty result.
    """
    own = staged(fingerprints(df, id_col, text_col), "fingerprints")
    least = staged(own.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    with small_batches(df.sparkSession):
        group = connected_components(links(least.select("fp"), radius)).withColumnRenamed("node", "fp")
    marked = staged(least.join(group, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "marked")
    names = staged(marked.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "names")
    # one component may hold most fingerprints
    known = join_split(marked, names.drop("n"), "component", hot_keys(names)).select("fp", "component_id")
    # mass copies share one fingerprint
    return join_split(own, known, "fp", hot_keys(least)).select(F.col("id").alias(id_col), as_hex("fp").alias("fingerprint"), "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
