"""Token ids as shards of Re-Pair grammars.

Documents are dealt by range of their ids and encoded in order. A shard holds the ids of whole documents,
SHARD_TOKENS at least. Its frequent pairs of neighbours are replaced by nonterminals again and again, the
most frequent ones first: each round replaces the pairs above a limit that falls from round to round. A
shard stores the rules, the number of ids that each nonterminal expands to, what is left of the sequence,
and the documents. By the expansion lengths any stretch of ids is decoded without the rest of the shard.

Each task writes one file of shards and returns their index rows, which Spark commits, so shards of
failed attempts are never read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photonloom.llm.common import as_id, as_text, shared_path, small_batches, staged, table

END_ID = 1
SHARD_TOKENS = 1 << 20
#: A pair is replaced if it is found LEAST times at least; the first round's limit is the sequence's length by FIRST.
LEAST, FIRST = 8, 256
#: Rounds go on at the lowest limit while one shortens the sequence by 1 / SETTLED.
SETTLED = 100
#: Bits of a table of chosen pairs beyond those of their number, and the odd factors that mix pairs of 4 and of 8 bytes.
_SPARE, _ODD = 3, {4: 0x9E3779B1, 8: 0x9E3779B97F4A7C15}
#: Symbols of a shard with 16-bit symbols, and of one with more ids than leave room for rules.
NARROW, WIDE = 1 << 16, 1 << 24
_MAGIC, _HEAD, _NONE = b"RPG1", struct.Struct("<4sIIIQQQ"), 0xFFFFFFFF
#: Pieces of text whose ids a worker keeps in each of two generations, words of blocks that it keeps, and the longest of both.
_CACHED, _LONGEST = 600_000, 32
#: What special tokens, which are told by their case, begin with.
_SPECIAL = "<|"
#: Latin letters, and ASCII characters but for these and the apostrophe, which may begin a pre-token of letters.
_LETTERS, _OTHERS = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF", r"!-&(-@\[-`{-~"
_LATIN, _RUNS = re.compile(f"[{_LETTERS}]+"), re.compile(f"[{_LETTERS}]+|[{_OTHERS}]+")
#: Texts of Latin letters and ASCII alone, and the kinds of their UTF-8 bytes. Their parts are runs of letters and of marks, with what follows an apostrophe up to white space.
_PLAIN = re.compile(f"[{_LETTERS}{_OTHERS}'\\x20\\t\\n\\r]*")
_SPACE, _LETTER, _MARK, _APOSTROPHE = range(4)
_SPACES = b" \t\n\r"
#: Characters of the texts whose distinct parts are looked up together.
BLOCK_CHARS = 16 << 20
#: New words that come to the model in one string.
_TOGETHER = 200
#: The bytes of such texts in lower case, and their kinds: beyond ASCII, all belong to letters.
_LOWER, _KIND = np.arange(256, dtype=np.uint8), np.full(256, _MARK, np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[0x80:0x9F] += 32
_KIND[[*_SPACES]], _KIND[ord("'")], _KIND[ord("a") : ord("z") + 1], _KIND[0x80:] = _SPACE, _APOSTROPHE, _LETTER, _LETTER
#: Nonterminals of up to so many ids are decoded by one table.
_SHORT = 64
#: Bytes of shards that a reading task gets, and the most reading tasks; beyond, a task reads more shards, one at a time.
TASK_BYTES, MOST_TASKS = 8 << 20, 20_000
_INDEX = "part int, shard int, file string, offset long, length long, n_docs long, n_tokens long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _spaced(text: str) -> str:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ")


class Encoder(dict):
    """Texts to ids, as little-endian 32-bit bytes, by a tokenizer that lower-cases and whose pre-tokens end at white space.

    Normalisation, pre-tokens and merges then stay between white space, so a text's ids are those of its pieces.
    Each piece is encoded by the tokenizers library, short ones once. Pre-tokens also end between Latin letters
    and ASCII marks, and Latin letters are lower-cased whatever stands beside them, so pieces that differ in
    these only share their letters' ids. Words of Latin letters that are new come to the library's model alone,
    many in one string; the mark of a word's end tells their ids apart. Tests hold the ids against those of whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.before = self.tokenizer.model, {}
        self._forget()
        # every word comes to the model once, so its own cache would only cost time
        self.model._resize_cache(0)
        self.words = Tokenizer(self.model)
        self.words.pre_tokenizer = WhitespaceSplit()
        suffix, vocab = self.model.end_of_word_suffix, self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        letters = [chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha()]
        self.as_bytes = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}

    def _forget(self) -> None:
        """Words that blocks of texts have in common: their places in the pool, the ids there and their numbers."""
        self.known: dict[str, int] = {}
        self.pool, self.sizes = np.empty(0, "<u4"), np.empty(0, np.int64)

    def _new(self, piece: str) -> bytes:
        """Ids of a piece not seen yet."""
        if _LATIN.fullmatch(piece):
            low = piece.lower()
            if low != piece:
                return self[low]
            # of such letters, the model's merges are all that is left to do
            ids = [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.as_bytes))]
            return np.array(ids, "<u4").tobytes()
        runs = _RUNS.findall(piece)
        if len(runs) > 1 and "".join(runs) == piece and _SPECIAL not in piece:
            return b"".join(map(self.__getitem__, runs))
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self._new(piece)
        if len(piece) <= _LONGEST:
            if len(self) >= _CACHED:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def _learn(self, words: list[str]) -> None:
        """Keep the ids of words of lower-case Latin letters."""
        spelled = [w if w.isascii() else w.translate(self.as_bytes) for w in words]
        found = self.words.encode_batch_fast([" ".join(spelled[k : k + _TOGETHER]) for k in range(0, len(words), _TOGETHER)], add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, "<u4") for x in found])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("a word's last id must bear the mark of a word's end, and no other")
        self.known.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words))))
        self.pool, self.sizes = np.concatenate([self.pool, ids]), np.concatenate([self.sizes, np.diff(ends, prepend=0)])

    @staticmethod
    def parts(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The parts of plain texts in lower case, and how many each text has."""
        raws = [t.encode() for t in texts]
        low = b" ".join([b"", *raws, b""]).translate(_LOWER.tobytes())
        kind = np.frombuffer(low.translate(_KIND.tobytes()), np.uint8)
        begins = np.zeros(len(low), bool)
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        at = np.flatnonzero(kind == _APOSTROPHE)
        if len(at):
            # a part goes on from an apostrophe up to white space
            spaces = np.flatnonzero(kind == _SPACE)
            stop = spaces[np.searchsorted(spaces, at)]
            first = np.diff(stop, prepend=-1) > 0
            inside = np.zeros(len(low), np.int8)
            inside[at[first]], inside[stop[first]] = 1, -1
            begins &= np.cumsum(inside, dtype=np.int8) == 0
            begins[at[kind[at - 1] == _SPACE]] = True
        own = kind != _SPACE
        begins &= own
        left = low.translate(None, _SPACES)
        offsets = np.append(np.flatnonzero(begins[own]), len(left))
        ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)
        n = np.diff(np.searchsorted(np.flatnonzero(begins), ends), prepend=0)
        return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(left)]), n

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of Latin letters and ASCII without special tokens."""
        parts, n = self.parts(texts)
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        rows = list(map(self.known.get, distinct))
        new = [p for p, k in zip(distinct, rows) if k is None]
        words = [p for p in new if len(p) <= _LONGEST and _LATIN.fullmatch(p)]
        if words:
            self._learn(words)
        # of no known word: marks, parts with an apostrophe and long words, for this block alone
        rest = [p for p in new if p not in self.known]
        found = [self[p] for p in rest]
        place = dict(zip(rest, range(len(self.sizes), len(self.sizes) + len(rest))))
        rows = np.array([k if k is not None else place[p] if p in place else self.known[p] for p, k in zip(distinct, rows)], np.int64)
        pool = np.concatenate([self.pool, np.frombuffer(b"".join(found), "<u4")])
        sizes = np.concatenate([self.sizes, np.fromiter(map(len, found), np.int64, len(found)) // 4])
        if len(self.known) > _CACHED:
            self._forget()
        begins, size = (np.cumsum(sizes) - sizes)[rows], sizes[rows]
        of = coded.indices.to_numpy()
        stops = np.concatenate([[0], np.cumsum(size[of])])
        # 32 bits where they do: most of the time goes to memory
        kind = np.int32 if max(stops[-1], len(pool)) < 1 << 31 else np.int64
        at = np.repeat(begins.astype(kind)[of] - stops[:-1].astype(kind), size.astype(kind)[of])
        at += np.arange(stops[-1], dtype=kind)
        raw = pool[at].tobytes()
        stops = (4 * stops[np.concatenate([[0], np.cumsum(n)])]).tolist()
        return [raw[a:b] for a, b in zip(stops, stops[1:])]

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order; looked up by blocks of texts."""
        block: list[str] = []
        size = 0

        def done() -> Iterator[bytes]:
            plain = [bool(_PLAIN.fullmatch(t)) and _SPECIAL not in t for t in block]
            parts = iter(self._plain([t for t, own in zip(block, plain) if own]) if any(plain) else ())
            for t, own in zip(block, plain):
                yield next(parts) if own else self.encode(t)

        for t in texts:
            block.append(t)
            size += len(t)
            if size >= BLOCK_CHARS:
                yield from done()
                block, size = [], 0
        yield from done()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _spaced(text).split(" ")))


_encoders: dict[str, Encoder] = {}


def _pairs(seq: np.ndarray) -> np.ndarray:
    """Neighbours as one number each; 32 bits if the symbols have 16."""
    if seq.dtype == np.uint16:
        return (seq[:-1].astype(np.uint32) << np.uint32(16)) | seq[1:]
    return (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]


def frequent(codes: np.ndarray, least: int, most: int) -> np.ndarray:
    """The codes found least times or more, in order; of more than most, those found most often."""
    kept = np.sort(codes)
    edges = np.flatnonzero(np.concatenate(([True], kept[1:] != kept[:-1], [True])))
    n = np.diff(edges)
    found = np.flatnonzero(n >= least)
    if len(found) > most:
        found = np.sort(found[np.argsort(-n[found], kind="stable")[:most]])
    return kept[edges[found]]


def ranked(chosen: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in codes of those that are among the ascending chosen ones, and their ranks there: by a hash table, as most codes are not."""
    bits = len(chosen).bit_length() + _SPARE
    kind = codes.dtype.type
    slots = lambda x: (x * kind(_ODD[codes.itemsize])) >> kind(8 * codes.itemsize - bits)
    k, own = np.arange(len(chosen), dtype=np.int32), slots(chosen)
    table = np.zeros(1 << bits, np.int32)
    table[own] = k
    # slots of several chosen codes, whose last one is in the table
    shared = np.zeros(1 << bits, bool)
    shared[own[table[own] != k]] = True
    own = slots(codes)
    rule = table[own]
    hit = chosen[rule] == codes
    if shared.any():
        rest = np.flatnonzero(shared[own] & ~hit)
        rule[rest] = np.minimum(np.searchsorted(chosen, codes[rest]), len(chosen) - 1)
        hit[rest] = chosen[rule[rest]] == codes[rest]
    at = np.flatnonzero(hit)
    return at, rule[at]


def every_other(at: np.ndarray) -> np.ndarray:
    """Which of the ascending places are kept so that no two are neighbours: the first, third, ... of each run."""
    k = np.arange(len(at))
    begins = np.concatenate(([True], np.diff(at) > 1)) if len(at) else np.empty(0, bool)
    return (k - np.maximum.accumulate(np.where(begins, k, 0))) % 2 == 0


def repaired(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terminals, rules, lengths, symbols) of ids: symbols below len(terminals) are ids, the others rules of two earlier symbols."""
    seen = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    seen[ids] = True
    terminals = np.flatnonzero(seen).astype(np.uint32)
    narrow = len(terminals) <= NARROW * 3 // 4
    seq = (np.cumsum(seen) - 1)[ids].astype(np.uint16 if narrow else np.uint32)
    size = np.ones(len(terminals), np.int64)
    rules = np.empty((0, 2), seq.dtype)
    limit = max(least, len(seq) // FIRST)
    while len(seq) > 1 and (room := (NARROW if narrow else WIDE) - len(size)) > 0:
        codes = _pairs(seq)
        chosen = frequent(codes, limit, room)
        before = len(seq)
        if len(chosen):
            left, right = (chosen >> chosen.dtype.type(chosen.itemsize * 4)).astype(np.int64), (chosen & chosen.dtype.type((1 << chosen.itemsize * 4) - 1)).astype(np.int64)
            at, rule = ranked(chosen, codes)
            own = every_other(at)
            at, rule = at[own], rule[own]
            # overlapping pairs may have left a rule too few places to pay
            used = np.bincount(rule, minlength=len(chosen)) >= (least + 1) // 2
            own = used[rule]
            at, rule = at[own], rule[own]
            seq[at] = (len(size) + np.cumsum(used) - 1)[rule]
            gone = np.ones(len(seq), bool)
            gone[at + 1] = False
            seq = seq[gone]
            rules = np.concatenate([rules, np.stack([left[used], right[used]], axis=1).astype(seq.dtype)])
            size = np.concatenate([size, size[left[used]] + size[right[used]]])
        if limit == least and (before - len(seq)) * SETTLED <= before:
            break
        limit = max(least, limit // 4)
    return terminals, rules, size[len(terminals) :], seq


def packed(ids: np.ndarray, doc_ids: list[str | None], doc_sizes: list[int]) -> bytes:
    """One shard as bytes; their last four are the checksum of the others."""
    terminals, rules, lengths, seq = repaired(ids)
    names = [None if d is None else d.encode() for d in doc_ids]
    parts = [
        _HEAD.pack(_MAGIC, seq.itemsize, len(terminals), len(rules), len(seq), len(names), len(ids)),
        terminals.astype("<u4").tobytes(),
        rules.astype(f"<u{seq.itemsize}").tobytes(),
        lengths.astype("<u8").tobytes(),
        seq.astype(f"<u{seq.itemsize}").tobytes(),
        np.array(doc_sizes, "<u8").tobytes(),
        np.array([_NONE if d is None else len(d) for d in names], "<u4").tobytes(),
        *(d for d in names if d),
    ]
    raw = b"".join(parts)
    return raw + struct.pack("<I", zlib.crc32(raw))


class Shard:
    """A shard read back; ids are decoded on demand."""

    def __init__(self, raw: bytes):
        magic, width, n_terminals, n_rules, n_symbols, n_docs, self.n_tokens = _HEAD.unpack_from(raw)
        if magic != _MAGIC or struct.unpack_from("<I", raw, len(raw) - 4)[0] != zlib.crc32(raw[:-4]):
            raise ValueError("not a shard, or a damaged one")
        at = _HEAD.size

        def taken(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.terminals = taken("<u4", n_terminals)
        self.rules = taken(f"<u{width}", 2 * n_rules).reshape(-1, 2)
        self.size = np.concatenate([np.ones(n_terminals, np.int64), taken("<u8", n_rules).astype(np.int64)])
        self.symbols = taken(f"<u{width}", n_symbols)
        self.doc_sizes = taken("<u8", n_docs).astype(np.int64)
        self.ends = np.cumsum(self.size[self.symbols])
        self.doc_ids: list[str | None] = []
        for n in taken("<u4", n_docs).tolist():
            self.doc_ids.append(None if n == _NONE else raw[at : at + n].decode())
            at += 0 if n == _NONE else n

    def _split(self, seq: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """seq with the marked nonterminals replaced by their two symbols."""
        at = np.cumsum(1 + inner) - 1 - inner
        seq = np.repeat(seq, 1 + inner)
        pairs = self.rules[seq[at[inner]] - len(self.terminals)]
        seq[at[inner]], seq[at[inner] + 1] = pairs[:, 0], pairs[:, 1]
        return seq

    @cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all symbols of at most _SHORT ids, one after the other, and where each symbol's begin."""
        short = self.size <= _SHORT
        seq = np.flatnonzero(short)
        while (inner := seq >= len(self.terminals)).any():
            seq = self._split(seq, inner)
        size = np.where(short, self.size, 0)
        return self.terminals[seq], np.cumsum(size) - size

    def decode(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop; long nonterminals are split, and what lies outside that stretch is left out, until all are short."""
        start, stop = max(start, 0), min(stop, self.n_tokens)
        if start >= stop:
            return np.empty(0, np.uint32)
        ids, begins = self._table
        seq, ends, begin = self.symbols.astype(np.int64), self.ends, 0
        while True:
            first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
            begin = int(ends[first - 1]) if first else begin
            seq = seq[first:last]
            size = self.size[seq]
            if not (inner := size > _SHORT).any():
                break
            seq = self._split(seq, inner)
            ends = begin + np.cumsum(self.size[seq])
        ends = np.cumsum(size)
        found = ids[np.repeat(begins[seq] - ends + size, size) + np.arange(ends[-1])]
        return found[start - begin : stop - begin]


def write_shards(df: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the ids of all texts below folder, documents in ascending order of their ids, and return the index, itself written.

    Null ids come last; documents of one id are ordered by their texts' hashes. A null or empty text has the
    end id alone; a very long one is a shard of its own. Other columns, of whatever name, are ignored. An
    empty table gives an empty index.
    """
    spark, path = df.sparkSession, path or tokenizer_path()
    key = [F.col("key").asc_nulls_last(), F.col("hash"), F.col("place")]
    rows = df.select(F.col(f"`{id_col}`").alias("key"), as_text(df, id_col).alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    # by number, so that partitions keep the order of their ranges
    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key).select("id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encode, end = _encoders[path].encode_all, np.array([end_id], "<u4").tobytes()
        task = TaskContext.get()
        name, out, offset, shard = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.rpg", None, 0, 0
        held: list[bytes] = []
        docs: list[str | None] = []
        sizes: list[int] = []

        def closed() -> pd.DataFrame:
            nonlocal out, offset, shard
            if out is None:
                fs, at = FileSystem.from_uri(folder)
                fs.create_dir(at, recursive=True)
                out = fs.open_output_stream(f"{at}/{name}", compression=None)
            raw = packed(np.frombuffer(b"".join(held), "<u4"), docs, sizes)
            out.write(raw)
            row = (task.partitionId(), shard, name, offset, len(raw), len(docs), sum(sizes))
            offset, shard = offset + len(raw), shard + 1
            for x in (held, docs, sizes):
                x.clear()
            return pd.DataFrame([row], columns=["part", "shard", "file", "offset", "length", "n_docs", "n_tokens"])

        total = 0
        for x in batches:
            for i, ids in zip(x["id"], encode(x["text"])):
                raw = ids + end
                held.append(raw)
                docs.append(i)
                sizes.append(len(raw) // 4)
                total += sizes[-1]
                if total >= shard_tokens:
                    yield closed()
                    total = 0
        if docs:
            yield closed()
        if out:
            out.close()

    # a batch has about a block of texts
    with small_batches(spark, BLOCK_CHARS):
        return staged(ordered.mapInPandas(run, _INDEX), "index")


def placed(index: DataFrame) -> DataFrame:
    """index with start, the ids of all shards before: of the parts before, one row each, and of the shards before in its part."""
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # a row for each writing task
    ahead = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    here = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return index.withColumn("here", here).join(ahead, "part").withColumn("start", F.col("ahead") + F.col("here")).drop("ahead", "here")


def read_documents(selected: DataFrame, folder: str, id_type: str = "bigint", wanted: DataFrame | None = None) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of the documents in the selected rows of placed(index), read back.

    With wanted, a table of (file, offset, first, last), only the documents from first up to last, counted
    from 0 in a shard, are decoded. An empty selection gives no row.
    """
    whole = F.lit(None).cast("long")
    rows = selected.join(wanted, ["file", "offset"]) if wanted is not None else selected.withColumns({"first": F.lit(0).cast("long"), "last": whole})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        fs, at = FileSystem.from_uri(folder)
        for x in batches:
            for name, offset, length, base, first, last in zip(x["file"], x["offset"], x["length"], x["start"], x["first"], x["last"]):
                with fs.open_input_file(f"{at}/{name}") as f:
                    f.seek(offset)
                    shard = Shard(f.read(length))
                docs = slice(int(first), len(shard.doc_ids) if pd.isna(last) else int(last))
                ends = np.cumsum(shard.doc_sizes)
                starts = ends - shard.doc_sizes
                own = list(zip(starts[docs].tolist(), ends[docs].tolist()))
                if own:
                    ids = shard.decode(own[0][0], own[-1][1])
                    crc = [zlib.crc32(ids[a - own[0][0] : b - own[0][0]].astype("<u4").tobytes()) for a, b in own]
                    yield pd.DataFrame({"id": shard.doc_ids[docs], "start": base + starts[docs], "n_tokens": shard.doc_sizes[docs], "ids_crc32": crc})

    size = rows.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first().n
    tasks = max(1, min(MOST_TASKS, -(-size // TASK_BYTES)))
    out = rows.select("file", "offset", "length", "start", "first", "last").repartition(tasks, "file", "offset").mapInPandas(run, "id string, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("id", F.col("id").cast(id_type))


def op12_grammar(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_path(spark, "token_shards")
    index = write_shards(docs, folder)
    return read_documents(placed(index), folder, docs.schema["doc_id"].dataType.simpleString()).withColumnRenamed("id", "doc_id")
