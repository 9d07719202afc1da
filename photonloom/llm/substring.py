"""Substring deduplication by repeated-phrase automata.

1. Anchors (the smallest hash of the 16-word grams in each 35-word window) are counted; equal windows
   have equal anchors, so a window with an anchor found once is found once.
2. Windows with a repeated anchor are counted by two independent hashes of all their words; those found twice
   or more recur, and one of the places where they are owns them. Runs of owned windows are the confirmed passages, each
   with its words and the one anchor that all its windows share.
3. Passages are dealt by anchor to shards of bounded size. Each shard compiles an Aho-Corasick automaton
   of its anchors' words with pyahocorasick.
4. Documents stream, where they hold a repeated anchor, through the shards of these anchors and no others.
   The windows around a hit are looked up in the shard and compared with its passage word by word; equal
   ones are occurrences, and their words are removed.

Which documents hold a repeated anchor is told by a filter of these anchors, sized by their number. Where
it would be larger than FILTER_LIMIT, joins on the anchors take its place.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonloom.llm.common import as_id, as_text, hot_keys, join_split, shared_path, small_batches, staged

WINDOW, GRAM = 35, 16
SPAN = WINDOW - GRAM
#: Words of the passages in one shard, and anchored places that one task streams through it.
SHARD_WORDS, SLICE_ROWS = 100_000, 20_000
#: Filter bits for each key, and the most bits that are broadcast.
FILTER_BITS_A_KEY, FILTER_LIMIT = 16, 1 << 30
_BLOCK_WORDS, _BLOCK_ROWS = 100_000, 1000
#: Bytes of the batches that come to and from Python workers; the JVM holds some of each task outside its heap.
BATCH_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Keys and multipliers of the two lanes of word hashes, the bytes of a word's last eight that are its own, and bytes beyond which a word is hashed alone.
_KEYS = [np.uint64(0x2545F4914F6CDD1D), np.uint64(0xA0761D6478BD642F)]
_MIXERS = [(np.uint64(0xD6E8FEB86659FD93), np.uint64(0x94D049BB133111EB)), (np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3))]
_FIRST_BYTES, _LONG_WORD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64), 256
_powers: dict[str, np.ndarray] = {}


def _table(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < max(n, 1):
        size = max(1 << 15, 1 << (n - 1).bit_length())
        _powers[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base)]), dtype=np.uint64)
    return _powers[name]


def _word_hashes(blob: bytes, start: np.ndarray, stop: np.ndarray, lane: int) -> np.ndarray:
    """A keyed hash of each word, eight bytes after eight mixed in by steps that are not linear; the lanes are two such hashes with keys of their own.

    Words of one length of up to eight bytes never share a hash, and no pattern of letters makes longer ones
    do, as it would in a sum over letters; very long words are hashed one by one.
    """
    by_eight = np.ndarray((len(blob) + 1,), "<u8", blob + bytes(8), strides=(1,))
    size = stop - start
    out = size.astype(np.uint64) * _BASE ^ _KEYS[lane]
    for k in range(0, len(start), _BLOCK_WORDS):
        live = np.arange(k, min(k + _BLOCK_WORDS, len(start)))
        live, at = live[size[live] <= _LONG_WORD], 0
        while len(live):
            h = out[live] ^ (by_eight[start[live] + at] & _FIRST_BYTES[np.minimum(size[live] - at, 8)])
            h *= _MIXERS[lane][0]
            h ^= h >> np.uint64(32)
            h *= _MIXERS[lane][1]
            out[live] = h ^ (h >> np.uint64(29))
            at += 8
            live = live[size[live] > at]
    for k in np.flatnonzero(size > _LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(blob[start[k] : stop[k]], digest_size=8, key=bytes([lane + 1])).digest(), "little")
    return out


class Words:
    """Words joined by one space each, where they begin and end, and hashes of all their k-grams from one prefix sum over the words' hashes."""

    def __init__(self, blob: bytes):
        self.blob, raw = blob, np.frombuffer(blob, np.uint8)
        spaces = np.flatnonzero(raw == 0x20)
        self.start, self.stop = (np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(raw)]])) if blob else (spaces, spaces)
        self.n = len(self.start)
        self.own = _word_hashes(blob, self.start, self.stop, 0)
        self.sums = self._sums(self.own)

    def _sums(self, own: np.ndarray) -> np.ndarray:
        sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(own * _table("up", _BASE, self.n)[: self.n], out=sums[1:])
        return sums

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, the latter exclusive."""
        return self.blob[self.start[a] : self.stop[b - 1]]

    def hashes(self, k: int, lane: int = 0) -> np.ndarray:
        if self.n < k:
            return np.empty(0, np.uint64)
        sums = self._sums(_word_hashes(self.blob, self.start, self.stop, 1)) if lane else self.sums
        h = (sums[k:] - sums[:-k]) * _table("down", _BACK, self.n)[: self.n - k + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Gram hashes, and for each window the place of the leftmost smallest one in it."""
        h = self.hashes(GRAM)
        low, at = h, np.arange(len(h))
        size, width = 1, SPAN + 1
        if self.n < WINDOW:
            return h, at[:0]
        while size < width:
            step = min(size, width - size)
            later = low[step:] < low[:-step]
            at = np.where(later, at[step:], at[:-step])
            low = np.minimum(low[step:], low[:-step])
            size += step
        return h, at

    def anchored(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor hash, first window, windows) of each run of windows that share their anchor."""
        low, size, width = self.hashes(GRAM), 1, SPAN + 1
        if self.n < WINDOW:
            low = low[:0]
        while len(low) and size < width:
            step = min(size, width - size)
            low = np.minimum(low[step:], low[:-step])
            size += step
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.empty(0, np.int64)
        return low[first], first, np.diff(np.concatenate([first, [len(low)]]))


def split(text: str | None) -> bytes:
    """The words of a text, joined by one space."""
    return b" ".join((text or "").encode("utf-8", "replace").split())


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Half-open ranges of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _key(text: str | None) -> bytes:
    return hashlib.blake2b((text or "").encode("utf-8", "replace"), digest_size=16).digest()


def _key_hash(keys: list[bytes] | pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in keys), "<u8")


def _spots(h: np.ndarray, n_bits: int) -> list[np.ndarray]:
    step = (h >> np.uint64(21)) | np.uint64(1)
    return [((h + np.uint64(k) * step) % np.uint64(n_bits)).astype(np.int64) for k in range(3)]


class Filter:
    """A Bloom filter over 64-bit hashes: no false negatives. None stands for a filter that lets all pass."""

    def __init__(self, packed: bytes | None):
        self.bits = None if packed is None else np.frombuffer(zlib.decompress(packed), np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        if self.bits is not None:
            for at in _spots(h, 8 * len(self.bits)):
                out &= (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return out


def _unsigned(keys: pd.Series) -> np.ndarray:
    return keys.to_numpy(np.int64).view(np.uint64)


def filter_of(df: DataFrame, col: Column, limit: int, hashes: Callable[[pd.Series], np.ndarray] = _unsigned) -> bytes | None:
    """Packed filter of a column, sized by its rows and made by as many tasks as df has; None where it would be over limit bits."""
    n = df.count()
    n_bits = max(64, 1 << max(0, n * FILTER_BITS_A_KEY - 1).bit_length())
    if n_bits > limit:
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(n_bits // 8, np.uint8)
        for x in batches:
            for at in _spots(hashes(x["key"]), n_bits):
                np.bitwise_or.at(bits, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        yield pd.DataFrame({"bits": [zlib.compress(bits.tobytes(), 1)]})

    out = np.zeros(n_bits // 8, np.uint8)
    for r in df.select(col.alias("key")).mapInPandas(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return zlib.compress(out.tobytes(), 1)


def repeated_anchors(texts: DataFrame) -> DataFrame:
    """(h, n): anchors chosen at two or more places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for k in range(0, len(x), 1000):
                found = [np.empty(0, np.uint64)]
                for text in x["text"].iloc[k : k + 1000]:
                    h, at = Words(split(text)).anchors()
                    found.append(h[at[np.concatenate([[True], at[1:] != at[:-1]])]] if len(at) else h[:0])
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"h": _long(h), "n": n})

    return texts.mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")


class _Twice(dict):
    """Counts keys, and says whether one was seen less than twice before: a repeated text is told by two of it."""

    def new(self, key: bytes) -> bool:
        n = self[key] = self.get(key, 0) + 1
        return n <= 2


_CONTEXT = "key binary, h long, first int, size int, cid long, words binary"


class _Contexts:
    """Rows of the words of runs of windows; cid names the place."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, key: bytes, words: Words, h: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        base = np.frombuffer(key[8:], "<u8") ^ (first.astype(np.uint64) * _BASE)
        cid = (base ^ (base >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        text = [words.blob[a:b] for a, b in zip(words.start[first].tolist(), words.stop[first + size + WINDOW - 2].tolist())]
        self.parts.append(([key] * len(h), h, first, size, cid, text))
        self.size += 100 * len(h) + sum(map(len, text))

    def frame(self) -> pd.DataFrame:
        key, h, first, size, cid, text = zip(*self.parts)
        whole = lambda lists: [v for own in lists for v in own]
        out = pd.DataFrame({"key": whole(key), "h": _long(np.concatenate(h)), "first": np.concatenate(first).astype(np.int32), "size": np.concatenate(size).astype(np.int32), "cid": _long(np.concatenate(cid)), "words": whole(text)})
        self.parts, self.size = [], 0
        return out

    def frames(self, rows: Iterator[tuple], most: int = BATCH_BYTES) -> Iterator[pd.DataFrame]:
        for r in rows:
            self.add(*r)
            if self.size > most:
                yield self.frame()
        if self.parts:
            yield self.frame()


def contexts(texts: DataFrame, repeated: DataFrame, limit: int) -> DataFrame:
    """(key, h, first, size, cid, words): runs of windows with a repeated anchor; each text at most twice in a task."""
    packed = filter_of(repeated, F.col("h"), limit)
    if packed is not None:
        shared = texts.sparkSession.sparkContext.broadcast(packed)

        def by_filter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, seen = Filter(shared.value), _Twice()

            def rows() -> Iterator[tuple]:
                for x in batches:
                    for text in x["text"]:
                        words = Words(split(text))
                        h, first, size = words.anchored()
                        maybe = known.has(h)
                        if maybe.any() and seen.new(key := _key(text)):
                            yield key, words, h[maybe], first[maybe], size[maybe]

            yield from _Contexts().frames(rows())

        return texts.mapInPandas(by_filter, _CONTEXT)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = _Twice()

        for x in batches:
            for text in x["text"]:
                h, first, size = Words(split(text)).anchored()
                if len(h) and seen.new(key := _key(text)):
                    yield pd.DataFrame({"key": [key] * len(h), "h": _long(h), "first": first.astype(np.int32), "size": size.astype(np.int32)})

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = _Twice()
        for x in batches:
            keys = [_key(t) for t in x["text"]]
            new = [seen.new(k) for k in keys]
            yield pd.DataFrame([(k, t) for k, t, n in zip(keys, x["text"], new) if n], columns=["key", "text"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for x in batches:
                for key, text, places in zip(x["key"], x["text"], x["places"]):
                    h, first, size = (np.array([p[c] for p in places], np.int64) for c in ("h", "first", "size"))
                    yield key, Words(split(text)), h.view(np.uint64), first, size

        yield from _Contexts().frames(rows())

    found = join_split(texts.mapInPandas(grams, "key binary, h long, first int, size int"), repeated, "h", hot_keys(repeated)).where("n is not null")
    places = found.groupBy("key").agg(F.collect_set(F.struct("h", "first", "size")).alias("places"))
    return texts.mapInPandas(keyed, "key binary, text string").join(places, "key").mapInPandas(cut, _CONTEXT)


class Places(Words):
    """The words of many runs of windows in a row, with the hash and the validity of each window that begins at a word."""

    def __init__(self, texts: list[bytes], size: np.ndarray):
        super().__init__(b" ".join(texts))
        self.begin = np.concatenate([[0], np.cumsum(size + WINDOW - 1)[:-1]]).astype(np.int64) if len(size) else np.empty(0, np.int64)
        self.windows = self.hashes(WINDOW)
        steps = np.zeros(self.n + 1, np.int64)
        steps[self.begin] += 1
        steps[self.begin + size] -= 1
        self.valid = np.flatnonzero(np.cumsum(steps)[: len(self.windows)] > 0)

    def code(self) -> str:
        """Two characters for each word, from two alphabets of 64, which keep an automaton's nodes narrow and its hits on word boundaries."""
        h = self.own
        return np.stack([h & np.uint64(63), ((h >> np.uint64(6)) & np.uint64(63)) + np.uint64(64)], axis=1).astype(np.uint8).tobytes().decode("latin-1")


def recurring_windows(places: DataFrame) -> DataFrame:
    """(w, cid): windows found twice or more, with the place that owns them.

    Windows are told apart by 128 bits, of two hashes of each of their words.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for k in range(0, len(x), _BLOCK_ROWS):
                part = x.iloc[k : k + _BLOCK_ROWS]
                size = part["size"].to_numpy(np.int64)
                found = Places(part["words"].tolist(), size)
                # windows come in the order of the places
                yield pd.DataFrame({"w": _long(found.windows[found.valid]), "v": _long(found.hashes(WINDOW, 1)[found.valid]), "cid": np.repeat(part["cid"].to_numpy(), size)})

    rows = places.select("size", "cid", "words").mapInPandas(run, "w long, v long, cid long")
    return rows.groupBy("w", "v").agg(F.count("*").alias("n"), F.min("cid").alias("cid")).where("n > 1").select("w", "cid")


def passages(places: DataFrame, windows: DataFrame) -> DataFrame:
    """(h, phrase, n_words): runs of recurring windows at the places that own them, each once."""
    owned = windows.groupBy("cid").agg(F.collect_set("w").alias("own"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for k in range(0, len(whole), _BLOCK_ROWS):
                x = whole.iloc[k : k + _BLOCK_ROWS]
                size = x["size"].to_numpy(np.int64)
                found = Places(x["words"].tolist(), size)
                own = np.concatenate(x["own"].tolist())
                order = np.argsort(own, kind="stable")
                own, row = own[order], np.repeat(np.arange(len(x)), [len(v) for v in x["own"]])[order]
                w, of = _long(found.windows[found.valid]), np.repeat(np.arange(len(x)), size)
                at = np.minimum(np.searchsorted(own, w), len(own) - 1)
                keep = (own[at] == w) & (row[at] == of)
                at, of = found.valid[keep], of[keep]
                head = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(of) != 0)])) if len(at) else at
                tail = np.concatenate([head[1:], [len(at)]]) - 1 if len(at) else at
                n_words = at[tail] - at[head] + WINDOW
                text = [found.blob[a:b] for a, b in zip(found.start[at[head]].tolist(), found.stop[at[tail] + WINDOW - 1].tolist())]
                yield pd.DataFrame({"h": x["h"].to_numpy()[of[head]], "phrase": text, "n_words": n_words})

    return owned.join(places.select("cid", "h", "size", "words"), "cid").select("h", "size", "words", "own").mapInPandas(cut, "h long, phrase binary, n_words long").dropDuplicates(["h", "phrase"])


class Shard:
    """Passages: an automaton of their anchors' words, and of each window its hash and its place among the passages' words."""

    def __init__(self, anchors: list[int], phrases: list[bytes]):
        import ahocorasick

        size = np.array([p.count(b" ") + 2 - WINDOW for p in phrases], np.int64)
        found = Places(phrases, size)
        # the anchor's own place in each passage: all windows of the passage hold it whole
        of, grams = np.repeat(np.arange(len(size)), size + WINDOW - 1), found.hashes(GRAM)
        hits = np.flatnonzero(_long(grams) == np.array(anchors, np.int64)[of[: len(grams)]])
        _, k = np.unique(of[hits], return_index=True)
        code = found.code()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for word in {code[2 * at : 2 * (at + GRAM)] for at in hits[k].tolist()}:
            self.automaton.add_word(word)
        self.automaton.make_automaton()
        self.windows, k = np.unique(found.windows[found.valid], return_index=True)
        self.at, self.blob, self.start, self.stop = found.valid[k], found.blob, found.start, found.stop

    def occurrences(self, places: Places) -> np.ndarray:
        """Windows of places, by their first word, that are windows of the passages, word by word."""
        last = np.fromiter((at for at, _ in self.automaton.iter(places.code())), np.int64)
        gram = (last + 1) // 2 - GRAM
        steps = np.bincount(np.maximum(gram - SPAN, 0), minlength=places.n + 2) - np.bincount(gram + 1, minlength=places.n + 2)
        at = places.valid[np.cumsum(steps)[places.valid] > 0]
        k = np.minimum(np.searchsorted(self.windows, places.windows[at]), len(self.windows) - 1)
        same = self.windows[k] == places.windows[at]
        at, to = at[same], self.at[k[same]]

        def equal(first: np.ndarray, last: np.ndarray) -> list[bool]:
            bounds = places.start[at[first]], places.stop[at[last] + WINDOW - 1], self.start[to[first]], self.stop[to[last] + WINDOW - 1]
            return [places.blob[a:b] == self.blob[c:d] for a, b, c, d in zip(*(v.tolist() for v in bounds))]

        if not len(at):
            return at
        first = np.concatenate([[0], np.flatnonzero((np.diff(at) != 1) | (np.diff(to) != 1)) + 1])
        last = np.concatenate([first[1:], [len(at)]]) - 1
        keep = np.repeat(equal(first, last), last - first + 1)
        # where a run isn't equal as a whole, each of its windows counts for itself
        rest = np.flatnonzero(~keep)
        keep[rest] = equal(rest, rest)
        return at[keep]


_loaded: dict[str, Shard] = {}


def _shard(folder: str, file: str) -> Shard:
    """The shard in a file; a Python worker keeps the last one."""
    from pyarrow.fs import FileSystem

    if file not in _loaded:
        _loaded.clear()
        fs, path = FileSystem.from_uri(folder)
        with fs.open_input_stream(f"{path}/{file}", compression=None) as f:
            _loaded[file] = pickle.loads(zstandard.decompress(f.read()))
    return _loaded[file]


def compile_shards(dealt: DataFrame, folder: str) -> DataFrame:
    """(shard, file): an automaton of each shard of (shard, h, phrase), written below folder."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        fs, path = FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name = f"shard-{x['shard'].iat[0]}-{TaskContext.get().taskAttemptId()}"
        x = x.sort_values(["h", "phrase"])
        with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
            out.write(zstandard.compress(pickle.dumps(Shard(x["h"].tolist(), x["phrase"].tolist())), 1))
        return pd.DataFrame({"shard": x["shard"].iloc[:1], "file": [name]})

    return dealt.groupBy("shard").applyInPandas(run, "shard long, file string")


def occurrences(places: DataFrame, phrases: DataFrame, folder: str, shard_words: int, slice_rows: int) -> DataFrame:
    """(key, ranges): of each text with a recurring window, the half-open ranges of words to remove."""
    total = phrases.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first().n
    shards = max(1, -(-total // shard_words))
    # an anchor with more passages than a shard holds is dealt to several; there are fewer such anchors than shards
    wide = phrases.groupBy("h").agg(F.ceil(F.sum("n_words") / shard_words).alias("parts")).where("parts > 1")
    wide = F.broadcast(staged(wide, "wide"))
    shard = F.pmod(F.xxhash64("h", "part"), F.lit(shards)).alias("shard")
    part = F.pmod(F.xxhash64("phrase"), F.coalesce("parts", F.lit(1)))
    dealt = phrases.join(wide, "h", "left").withColumn("part", part).select("h", "phrase", shard)
    files = staged(compile_shards(dealt, folder), "shards")
    routed = places.join(wide, "h", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
    routed = routed.select("key", "first", "size", "cid", "words", shard)
    # as many rows as there are shards; a shard that many documents meet is read by several tasks
    slices = F.broadcast(staged(routed.groupBy("shard").agg(F.ceil(F.count("*") / slice_rows).alias("slices")).join(files, "shard"), "slices"))
    routed = routed.join(slices, "shard").withColumn("slice", F.pmod(F.xxhash64("cid"), F.col("slices")))

    def ranges_of(x: pd.DataFrame) -> pd.DataFrame:
        found = Places(x["words"].tolist(), x["size"].to_numpy(np.int64))
        at = _shard(folder, x["file"].iat[0]).occurrences(found)
        k = np.searchsorted(found.begin, at, "right") - 1
        head = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(k) != 0)])) if len(at) else at
        tail = np.concatenate([head[1:], [len(at)]]) - 1 if len(at) else at
        first = x["first"].to_numpy(np.int64)[k] - found.begin[k] + at
        return pd.DataFrame({"key": x["key"].to_numpy()[k[head]], "a": first[head], "b": first[tail] + WINDOW})

    def run(x: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([ranges_of(x.iloc[k : k + _BLOCK_ROWS]) for k in range(0, len(x), _BLOCK_ROWS)])

    ranges = routed.select("shard", "slice", "file", "key", "first", "size", "words").groupBy("shard", "slice").applyInPandas(run, "key binary, a long, b long")
    return ranges.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))


def without(text: str | None, ranges: list) -> tuple[int, int, str]:
    """(words, words removed, the others joined by one space)."""
    if not len(ranges):
        blob = split(text)
        return blob.count(b" ") + bool(blob), 0, blob.decode("utf-8")
    words = Words(split(text))
    steps = np.zeros(words.n + 1, np.int64)
    for r in ranges:
        steps[r["a"]] += 1
        steps[r["b"]] -= 1
    gone = np.cumsum(steps)[: words.n] > 0
    return words.n, int(gone.sum()), b" ".join([words.text(a, b) for a, b in runs(~gone)]).decode("utf-8")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, slice_rows: int = SLICE_ROWS, filter_limit: int = FILTER_LIMIT) -> DataFrame:
    """One row per input row: id, n_words, n_removed and kept, the words left, joined by one space.

    A word goes if it lies in a window of 35 words whose sequence starts anywhere else too. Null texts
    have no words; texts of fewer than 35 words stay; of equal longer texts nothing stays. Very long texts
    are read whole, with some 60 bytes of memory for each word. Null and repeated ids keep their rows;
    other columns, of whatever name, are ignored; an empty table gives an empty result.
    """
    with small_batches(df.sparkSession, BATCH_BYTES):
        return _remove_repeats(df, id_col, text_col, shard_words, slice_rows, filter_limit)


def _remove_repeats(df: DataFrame, id_col: str, text_col: str, shard_words: int, slice_rows: int, filter_limit: int) -> DataFrame:
    docs = df.select(as_text(df, id_col).alias("id"), F.col(text_col).alias("text"))
    texts = docs.select("text")
    places = staged(contexts(texts, staged(repeated_anchors(texts), "anchors"), filter_limit), "places")
    phrases = staged(passages(places, staged(recurring_windows(places), "windows")), "phrases")
    ranges = staged(occurrences(places, phrases, shared_path(df.sparkSession, "automata"), shard_words, slice_rows), "ranges")
    packed = filter_of(ranges, F.col("key"), filter_limit, _key_hash)
    shared = df.sparkSession.sparkContext.broadcast(packed)

    def keyed(x: pd.DataFrame, known: Filter) -> tuple[list[bytes], np.ndarray]:
        keys = [_key(t) for t in x["text"]]
        return keys, known.has(_key_hash(keys))

    def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Filter(shared.value)
        for x in batches:
            _, named = keyed(x, known)
            rest = x[~named]
            for k in range(0, len(rest), _BLOCK_ROWS):
                part = rest.iloc[k : k + _BLOCK_ROWS]
                yield pd.DataFrame([(i, *without(t, ())) for i, t in zip(part["id"], part["text"])], columns=["id", "n_words", "n_removed", "kept"])

    def ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Filter(shared.value)
        for x in batches:
            keys, named = keyed(x, known)
            yield pd.DataFrame([(i, k) for i, k, n in zip(x["id"], keys, named) if n], columns=["id", "key"])

    def named_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, seen = Filter(shared.value), set()
        for x in batches:
            keys, named = keyed(x, known)
            new = [bool(n) and not (k in seen or seen.add(k)) for k, n in zip(keys, named)]
            yield pd.DataFrame([(k, t) for k, t, n in zip(keys, x["text"], new) if n], columns=["key", "text"])

    def removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = [(k, *without(t, () if r is None else r)) for k, t, r in zip(x["key"], x["text"], x["ranges"])]
            yield pd.DataFrame(out, columns=["key", "n_words", "n_removed", "kept"])

    met = texts.mapInPandas(named_texts, "key binary, text string").dropDuplicates(["key"]).join(ranges, "key", "left")
    met = staged(met.mapInPandas(removed, "key binary, n_words long, n_removed long, kept string"), "removed")
    named = staged(docs.mapInPandas(ids, "id string, key binary"), "named")
    copies = staged(named.groupBy("key").agg(F.count("*").alias("n")), "copies")
    # of a text that very many rows have nothing is left, if it has 35 words; with fewer it is short
    out = join_split(named, met, "key", hot_keys(copies)).select("id", "n_words", "n_removed", "kept")
    if packed is not None:
        out = out.unionByName(docs.mapInPandas(apart, "id string, n_words long, n_removed long, kept string"))
    return out.select(as_id(df, id_col).alias(id_col), "n_words", "n_removed", "kept")


def op6_substring(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
