"""Lexical retrieval packing: documents into token windows, filled with BM25 neighbours.

Whole windows of a document stand alone; what is left of it is a fragment. Fragments are dealt to
shards of like content, each with an inverted index. A seed fragment retrieves the unused fragments of
its shard that score highest by BM25; they fill its window whole while they fit, and the best one left
is cut to fill the rest, so that at most one window of a shard is padded.

Shards are the leaves of a tree over sketches: a fragment's BM25 term weights, projected to DIMS numbers.
The tree is grown on a sample of at most SAMPLE_ROWS sketches, each node cut across its main direction where
the sample is thinnest, down to leaves of about SHARD_ROWS; what can't be cut, such as many copies of a text
or a leaf with too few sampled rows, is dealt to several shards. Every fragment is indexed, in its own shard;
neighbours in another one are not found.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonloom.llm.common import as_id, as_text, staged

WINDOW = 1024
END_ID = 0
SHARD_ROWS = 512
K1, B = 1.2, 0.75
#: Tokens of over 1 / FULL of a shard's fragments have a weight for each fragment.
FULL = 4
#: Numbers of a sketch, sampled fragments for each shard that the tree is to have and at most, and fewest of a leaf.
DIMS, SAMPLE_PER_SHARD, SAMPLE_ROWS, LEAF_SAMPLE = 64, 32, 100_000, 8
#: Neighbours that are looked at before all of a shard's.
NEAR = 32
_SPECIAL = "<|endoftext|>"
#: Characters of the texts whose distinct pieces are encoded together.
BLOCK_CHARS = 8 << 20
#: A space before another white-space character, where pieces can't be cut by str.split.
_SPACES = re.compile(r" (?:\s|$)")
_BOUNDARY = re.compile(r" (?=\S)")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to token ids as little-endian 16-bit bytes, those of the tokenizer file at path.

    Pre-tokens never span a space that a non-space follows, so texts are cut there and a block of texts comes
    to the vocabulary's ranks, which lie beside the file, as its distinct pieces, in one string. Tokens part
    its bytes, so their lengths tell where each piece's ids end; tests hold them against the tokenizer, piece
    by piece. A text with the special token's string goes to the tokenizer as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        lines = Path(path).with_suffix(".tiktoken").read_bytes().split(b"\n")
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
        self.ranked = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = list(map(len, ranks))

    def _bulk(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, each after a space, and where each piece's begin and end."""
        ids = np.array(array("H", self.ranked(" " + " ".join(pieces.to_numpy(zero_copy_only=False)))), "<u2")
        ends = np.cumsum(pc.binary_length(pieces).to_numpy().astype(np.int64) + 1)
        return ids, np.concatenate([[0], np.searchsorted(np.cumsum(self.size[ids]), ends, "left") + 1])

    def block(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without the special token's string."""
        lists = pa.list_(pa.large_string())
        apart = [k for k, t in enumerate(texts) if not t or _SPACES.search(t)]
        named = set(apart)
        order = [k for k in range(len(texts)) if k not in named] + apart
        plain = pc.split_pattern(pa.array([texts[k] for k in order[: len(texts) - len(apart)]], pa.large_string()), " ").cast(lists)
        cut = pa.concat_arrays([plain, pa.array([_BOUNDARY.split(texts[k]) for k in apart], lists)])
        n = pc.list_value_length(cut).to_numpy().astype(np.int64)
        later = np.ones(n.sum(), bool)
        later[np.cumsum(n) - n] = False
        words = cut.flatten()
        heads = [np.array(self.ranked(h), "<u2").tobytes() for h in words.filter(pa.array(~later)).to_pylist()]
        pieces = words.filter(pa.array(later)).dictionary_encode()
        ids, bounds = self._bulk(pieces.dictionary) if len(pieces) else (np.empty(0, "<u2"), np.zeros(1, np.int64))
        of = pieces.indices.to_numpy()
        size = np.diff(bounds)[of]
        stops = np.concatenate([[0], np.cumsum(size)])
        # 32 bits where they do: most of the time goes to memory
        kind = np.int32 if max(stops[-1], len(ids)) < 1 << 31 else np.int64
        at = np.repeat((bounds[of] - stops[:-1]).astype(kind), size)
        at += np.arange(stops[-1], dtype=kind)
        found = ids[at].tobytes()
        stops = (stops[np.concatenate([[0], np.cumsum(n - 1)])] * 2).tolist()
        out = dict(zip(order, [h + found[a:b] for h, a, b in zip(heads, stops, stops[1:])]))
        return [out[k] for k in range(len(texts))]

    def one(self, text: str) -> bytes:
        return self([text])[0]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        block: list[str] = []
        size = 0
        for t in texts:
            if _SPECIAL in t:
                out += [*(self.block(block) if block else ()), np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes()]
                block, size = [], 0
                continue
            block.append(t)
            size += len(t)
            if size >= BLOCK_CHARS:
                out += self.block(block)
                block, size = [], 0
        return out + self.block(block) if block else out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def fragments(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(uid, id, doc_tokens, crcs of the whole windows, tail ids as 16-bit bytes), one row per input row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, uid = encoder(path), TaskContext.get().partitionId() << 40
        for x in batches:
            rows = []
            for i, raw in zip(x["id"], encode([t or "" for t in x["text"]])):
                ids = np.frombuffer(raw + END_ID.to_bytes(2, "little"), "<u2")
                whole = len(ids) // window
                rows.append((uid, i, len(ids), [crc_of(ids[k * window : (k + 1) * window]) for k in range(whole)], ids[whole * window :].tobytes()))
                uid += 1
            yield pd.DataFrame(rows, columns=["uid", "id", "doc_tokens", "crcs", "tail"])

    return df.select(as_text(df, id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "uid long, id string, doc_tokens long, crcs array<long>, tail binary")


def terms(tails: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fragment, token, occurrences) for each token of each fragment, in this order, by one sort of them all."""
    codes = np.concatenate([np.empty(0, "<u2"), *tails]).astype(np.uint32 if len(tails) <= 1 << 16 else np.uint64)
    codes |= np.repeat(np.arange(len(tails), dtype=codes.dtype) << codes.dtype.type(16), [len(t) for t in tails])
    codes.sort()
    edges = np.flatnonzero(np.concatenate([codes[1:] != codes[:-1], [True] * bool(len(codes))]))
    codes = codes[edges]
    return (codes >> codes.dtype.type(16)).astype(np.int64), (codes & codes.dtype.type(0xFFFF)).astype(np.int64), np.diff(edges, prepend=-1)


def document_frequencies(parts: DataFrame) -> np.ndarray:
    """Fragments with each token id, over all fragments. The result has at most 65,536 entries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(1 << 16, np.int64)
        for x in batches:
            seen += np.bincount(terms([np.frombuffer(t, "<u2") for t in x["tail"]])[1], minlength=1 << 16)
        ids = np.flatnonzero(seen)
        yield pd.DataFrame({"token": ids, "n": seen[ids]})

    out = np.zeros(1 << 16)
    for r in parts.select("tail").mapInPandas(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        out[r.token] = r.n
    return out


_signs: list[np.ndarray] = []


def sketches(tails: list[np.ndarray], idf: np.ndarray, mean: float, k1: float = K1, b: float = B) -> np.ndarray:
    """Unit vectors whose inner products stand for the fragments' likeness in BM25 term weights."""
    if not _signs:
        _signs.append(np.random.default_rng(7).standard_normal((1 << 16, DIMS), np.float32))
    out = np.zeros((len(tails), DIMS), np.float32)
    row, term, tf = terms(tails)
    weight = (idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * np.array([len(t) for t in tails])[row] / max(mean, 1.0)))).astype(np.float32)
    ends = np.searchsorted(row, np.arange(len(tails)), "right").tolist()
    for k, (first, last) in enumerate(zip([0, *ends], ends)):
        out[k] = weight[first:last] @ _signs[0].take(term[first:last], axis=0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class Tree:
    """Leaves of like sketches, grown on a sample; each node has the share of all shards that its sample has of all rows."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.axis, self.cut, self.child, self.first, self.pieces = [], [], [], [], []
        todo, begun = [(sample, shards, None)], 0
        while todo:
            x, own, parent = todo.pop()
            node = len(self.axis)
            if parent:
                self.child[parent[0]][parent[1]] = node
            found = self._cut(x) if own > 1 and len(x) >= 2 * LEAF_SAMPLE else None
            axis, cut = found or (np.zeros(sample.shape[1], np.float32), 0.0)
            self.axis.append(axis), self.cut.append(cut), self.child.append([node, node]), self.first.append(begun), self.pieces.append(own)
            if found:
                right = x @ axis > cut
                more = min(own - 1, max(1, round(own * float(right.mean()))))
                todo += [(x[right], more, (node, 1)), (x[~right], own - more, (node, 0))]
            else:
                begun += own
        self.axis, self.cut, self.child, self.first, self.pieces = np.array(self.axis), np.array(self.cut, np.float32), np.array(self.child), np.array(self.first), np.array(self.pieces)

    @staticmethod
    def _cut(x: np.ndarray) -> tuple[np.ndarray, float] | None:
        """The main direction and the widest gap in the middle of it, None for rows that are all alike."""
        centred = x - x.mean(axis=0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1].astype(np.float32)
        at = np.sort(x @ axis)
        low, high = max(1, int(len(at) * 0.3)), max(2, int(np.ceil(len(at) * 0.7)))
        for a, b in ((low, high), (1, len(at))):
            gap = at[a:b] - at[a - 1 : b - 1]
            if len(x) > 1 and len(gap) and gap.max() > 1e-4:
                k = a + int(np.argmax(gap))
                return axis, float((at[k - 1] + at[k]) / 2)
        return None

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            right = np.einsum("nd,nd->n", x, self.axis[node]) > self.cut[node]
            then = self.child[node, right.astype(np.int64)]
            if (then == node).all():
                return node
            node = then

    def shards(self, x: np.ndarray, uid: np.ndarray) -> np.ndarray:
        leaf = self.leaves(x)
        mixed = (uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.first[leaf] + mixed.astype(np.int64) % self.pieces[leaf]


def by_content(parts: DataFrame, rows: int, shards: int, idf: np.ndarray) -> DataFrame:
    """parts with a shard of like fragments each."""
    mean = parts.agg(F.avg(F.length("tail") / 2)).first()[0] or 0.0
    every = max(1, rows // min(SAMPLE_ROWS, shards * SAMPLE_PER_SHARD))
    idf = idf.astype(np.float32)

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            own = sketches([np.frombuffer(t, "<u2") for t in x["tail"]], idf, mean)
            yield pd.DataFrame({"sketch": [v.tobytes() for v in own.astype(np.float16)]})

    sample = parts.where(F.pmod(F.xxhash64("uid"), F.lit(every)) == 0).select("tail").mapInPandas(sketched, "sketch binary").toPandas()["sketch"]
    known = np.frombuffer(b"".join(sample), np.float16).reshape(-1, DIMS).astype(np.float32)
    tree = Tree(known, shards)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            own = sketches([np.frombuffer(t, "<u2") for t in x["tail"]], idf, mean)
            yield x.assign(shard=tree.shards(own, x["uid"].to_numpy()))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    return parts.mapInPandas(dealt, f"{kinds}, shard long")


class Index:
    """BM25 scores of a shard's fragments by an inverted index over token ids.

    The list of a token that 1 / FULL of the fragments have is a row with a weight for each fragment.
    """

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, k1: float = K1, b: float = B):
        doc, term, tf = terms(tails)
        lengths = np.array([len(t) for t in tails], float)
        self.n, ends = len(tails), np.searchsorted(doc, np.arange(len(tails)), "right")
        weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[doc] / max(lengths.mean(), 1.0)))
        found = np.bincount(term, minlength=1 << 16)
        often = np.flatnonzero(found * FULL > self.n)
        row = np.full(1 << 16, -1)
        row[often] = np.arange(len(often))
        full = row[term] >= 0
        self.full = np.zeros((len(often), self.n))
        self.full[row[term[full]], doc[full]] = weight[full]
        self.query = [(x[x >= 0], t[x < 0]) for t, x in zip(np.split(term, ends[:-1]), np.split(row[term], ends[:-1]))]
        doc, term, weight = doc[~full], term[~full], weight[~full]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.starts = np.searchsorted(term[order], np.arange((1 << 16) + 1))

    def scores(self, seed: int) -> np.ndarray:
        often, rest = self.query[seed]
        first = self.starts[rest]
        size = self.starts[rest + 1] - first
        at = np.repeat(first - np.cumsum(size) + size, size)
        at += np.arange(len(at))
        return np.bincount(self.doc[at], self.weight[at], minlength=self.n) + self.full[often].sum(axis=0)


def ranked(scores: np.ndarray, left: np.ndarray, most: Callable[[], int]) -> Iterator[int]:
    """Fragments with something left by falling score, those of equal score by number; the first NEAR of them are found without a full sort.

    Of the others, only those with at most most() left, asked when their turn comes.
    """
    free = np.flatnonzero(left)
    own = scores[free]
    limit = -np.inf
    if len(free) > 2 * NEAR:
        limit = np.partition(own, len(own) - NEAR)[len(own) - NEAR]
        near = free[own >= limit]
        yield from near[np.argsort(-scores[near], kind="stable")].tolist()
        free = free[own < limit]
    free = free[left[free] <= most()]
    yield from free[np.argsort(-scores[free], kind="stable")].tolist()


def fill(lengths: list[int], scores: Callable[[int], np.ndarray], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows of (fragment, start in it, length); longest unused fragment first as seed.

    Its neighbours go in by falling score, whole while they fit; the best one that is left is cut for the rest.
    """
    left, start, out = np.array(lengths, np.int64), [0] * len(lengths), []
    for seed in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        if not left[seed]:
            continue
        now, room = [(seed, start[seed], int(left[seed]))], window - int(left[seed])
        left[seed] = 0
        cut = None
        # nothing that is left fits less room than this
        shortest = int(left[left > 0].min(initial=window))
        # once there is one to cut, only those that fit whole are looked for
        for k in ranked(scores(seed), left, lambda: window if cut is None else room) if room else ():  # noqa: B023
            own = int(left[k])
            if own <= room:
                now.append((k, start[k], own))
                room -= own
                left[k] = 0
            elif cut is None:
                cut = k
            if not room or cut is not None and room < shortest:
                break
        if room and cut is not None:
            now.append((cut, start[cut], room))
            start[cut] += room
            left[cut] -= room
        out.append(now)
    return out


def pack(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone; very long texts are whole windows of their own and one
    fragment. Neighbours of equal score are taken in the order of the rows. Repeated rows are packed as
    often as they occur, null ids too. Other columns, of whatever name, are ignored. An empty table gives
    an empty result.
    """
    parts = staged(fragments(df, path or tokenizer_path(), id_col, text_col, window), "fragments")
    rows = parts.count()
    shards = max(1, -(-rows // shard_rows))
    df_of = document_frequencies(parts)
    idf = np.log1p((rows - df_of + 0.5) / (df_of + 0.5))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("uid", ignore_index=True)
        sequence = int(x["shard"].iloc[0]) << 32
        out = []
        for i, total, crcs in zip(x["id"], x["doc_tokens"], x["crcs"]):
            for k, crc in enumerate(crcs):
                out.append((i, k * window, window, crc, total, sequence, 0))
                sequence += 1
        tails = [np.frombuffer(t, "<u2") for t in x["tail"]]
        kept = [k for k, t in enumerate(tails) if len(t)]
        if kept:
            index = Index([tails[k] for k in kept], idf)
            for pieces in fill([len(tails[k]) for k in kept], index.scores, window):
                offset = 0
                for k, start, length in pieces:
                    row, tail = kept[k], tails[kept[k]]
                    total = x["doc_tokens"].iat[row]
                    out.append((x["id"].iat[row], total - len(tail) + start, length, crc_of(tail[start : start + length]), total, sequence, offset))
                    offset += length
                sequence += 1
        return pd.DataFrame(out, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    dealt = by_content(parts, rows, shards, idf) if shards > 1 else parts.withColumn("shard", F.lit(0).cast("long"))
    out = dealt.groupBy("shard").applyInPandas(run, "id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.select(as_id(df, id_col).alias(id_col), *out.columns[1:])


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
