"""Source divergence audit: how far the term shares of each two sources of a language lie apart.

Terms are counted in each task and then by Spark; a language keeps the terms of enough of its documents.
A language's terms are dealt by hash to chunks of about CHUNK_TERMS, its sources to blocks of about
BLOCK_GROUPS, and the counts of a source in a chunk are packed into one row. A task has two blocks of
sources and a stripe of chunks: it gets the packed rows of both blocks in the order of chunks, holds one
chunk of them at a time, and adds to the submatrix of its pairs. Submatrices of the stripes are summed by
Spark. Shares and divergences are whole numbers and exact.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonloom.llm.common import hot_keys, join_split, small_batches, staged, table

#: Documents of a language that a kept term is in at least; terms reported for a source.
MIN_DOCS, TOP_TERMS = 10, 10
#: Terms in a chunk, chunks in a task's stripe, and sources in a block, all on average.
CHUNK_TERMS, STRIPE_CHUNKS, BLOCK_GROUPS = 4096, 16, 64
#: Distinct terms that a counting task holds before it hands them on.
_HELD = 1 << 19
#: Shares are in parts of 10 ** 9, found in three steps of long division, which whole 64-bit numbers hold up to LARGEST.
_STEP, _STEPS, LARGEST = 1000, 3, 9_000_000_000_000_000
#: ASCII letters, lower-cased, and the bytes of all other characters stay; the rest separates terms.
_LETTERS = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))


def term_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs), and for each language and source one row with a null term and its number of documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = defaultdict(lambda: (Counter(), Counter()))
        rows: Counter = Counter()

        def handed() -> Iterator[pd.DataFrame]:
            for (lang, source), (n, docs) in held.items():
                terms = list(n)
                for k in range(0, len(terms), 100_000):
                    part = terms[k : k + 100_000]
                    yield pd.DataFrame({"lang": lang, "source": source, "term": [t.decode() for t in part], "n": [n[t] for t in part], "docs": [docs[t] for t in part]})
            held.clear()

        for x in batches:
            for text, lang, source in zip(x["text"], x["lang"], x["source"]):
                words = text.encode("utf-8", "replace").translate(_LETTERS).split(b" ")
                n, docs = held[lang, source]
                n.update(words)
                docs.update(set(words))
                del n[b""], docs[b""]
                rows[lang, source] += 1
            if sum(len(n) for n, _ in held.values()) > _HELD:
                yield from handed()
        yield from handed()
        if rows:
            yield pd.DataFrame({"lang": [k[0] for k in rows], "source": [k[1] for k in rows], "term": None, "n": 0, "docs": list(rows.values())})

    plain = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    parts = plain.mapInPandas(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10 ** 9 * (n + 2) / (total + 2 * terms)), exact for totals up to LARGEST."""
    rest, whole, out = n + 2, total + 2 * terms, F.lit(0).cast("long")
    for _ in range(_STEPS):
        out = out * _STEP + F.call_function("div", rest * _STEP, whole)
        rest = (rest * _STEP) % whole
    return out + 1


def shares(n: np.ndarray, whole: int) -> np.ndarray:
    """share() of an array of counts; whole is total + 2 * terms."""
    rest, out = n + 2, np.zeros_like(n)
    for _ in range(_STEPS):
        step, rest = np.divmod(rest * _STEP, whole)
        out = out * _STEP + step
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / (p + q)) of shares, entry by entry."""
    d = p - q
    return (d * d).view(np.uint64) // (p + q).view(np.uint64)


class Tile:
    """The pairs of two blocks of sources over one stripe of chunks; the blocks may be the same."""

    def __init__(self, lang: str, own: int, other: int, terms: int):
        self.lang, self.own, self.other, self.terms = lang, own, other, terms
        self.members: list[tuple[str, int, int]] = []

    def start(self) -> None:
        self.place = {s: k for k, (s, _, _) in enumerate(self.members)}
        self.whole = [w for _, _, w in self.members]
        self.least = np.array([int(shares(np.zeros(1, np.int64), w)[0]) for w in self.whole], np.int64)
        at = np.array([b for _, b, _ in self.members], np.int64)
        self.left, self.right = np.flatnonzero(at == self.own), np.flatnonzero(at == self.other)
        self.sums = np.zeros((len(self.left), len(self.right)), np.uint64)

    def add(self, width: int, rows: list[tuple[str, np.ndarray, np.ndarray]]) -> None:
        """One chunk of width terms: positions and counts of the sources that have any of them."""
        p = np.repeat(self.least[:, None], width, axis=1)
        for source, pos, n in rows:
            m = self.place[source]
            p[m, pos] = shares(n, self.whole[m])
        right = p[self.right]
        for k, i in enumerate(self.left):
            self.sums[k] += apart(right, p[i]).sum(axis=1, dtype=np.uint64)
        self.terms -= width

    def result(self) -> pd.DataFrame:
        """Each pair once. Terms that no chunk brought are ones that none of these sources has."""
        sums = self.sums + np.uint64(self.terms) * apart(self.least[self.right][None, :], self.least[self.left][:, None])
        i, j = np.triu_indices(len(self.left), 1) if self.own == self.other else map(np.ravel, np.indices(sums.shape))
        names = np.array([s for s, _, _ in self.members], object)
        return pd.DataFrame({"lang": self.lang, "a": names[self.left[i]], "b": names[self.right[j]], "value": sums[i, j].astype(np.int64)})


def tiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Submatrices from rows sorted by tile and chunk; rows of chunk -1 name a tile's sources."""
    key = at = tile = None
    rows: list = []
    width = 0
    for x in batches:
        for lang, own, other, stripe, chunk, source, block, whole, size, pos, n in zip(*(x[c] for c in _TILE)):
            if (lang, own, other, stripe) != key:
                if tile:
                    tile.start() if at == -1 else tile.add(width, rows)
                    yield tile.result()
                key, at, rows, tile = (lang, own, other, stripe), -1, [], Tile(lang, own, other, size)
            elif chunk != at:
                tile.start() if at == -1 else tile.add(width, rows)
                at, rows = chunk, []
            if chunk == -1:
                tile.members.append((source, block, whole))
            else:
                width = size
                rows.append((source, np.asarray(pos, np.int64), np.asarray(n, np.int64)))
    if tile:
        tile.start() if at == -1 else tile.add(width, rows)
        yield tile.result()


_TILE = ["lang", "own", "other", "stripe", "chunk", "source", "block", "whole", "size", "pos", "n"]


def pair_sums(groups: DataFrame, packed: DataFrame, stripes: DataFrame, stripe_chunks: int) -> DataFrame:
    """(lang, a, b, value), each pair of a language's sources once.

    groups: (lang, source, whole, block, blocks). packed: (lang, source, chunk, size, pos, n).
    stripes: (lang, stripe, size), at least one for each language.
    """
    none = lambda kind: F.lit(None).cast(kind)
    heads = groups.join(stripes, "lang").withColumns({"chunk": F.lit(-1).cast("long"), "pos": none("array<int>"), "n": none("array<bigint>")})
    bodies = packed.join(groups, ["lang", "source"]).withColumn("stripe", F.floor(F.col("chunk") / stripe_chunks))
    rows = heads.unionByName(bodies.select(heads.columns))
    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = rows.withColumn("partner", partner).withColumns({"own": F.least("block", "partner"), "other": F.greatest("block", "partner")}).select(_TILE)
    tile = ["lang", "own", "other", "stripe"]
    found = dealt.repartition(*tile).sortWithinPartitions(*tile, "chunk").mapInPandas(tiled, "lang string, a string, b string, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = MIN_DOCS,
    top: int = TOP_TERMS,
    chunk_terms: int = CHUNK_TERMS,
    stripe_chunks: int = STRIPE_CHUNKS,
    block_groups: int = BLOCK_GROUPS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): pair rows for all other sources of the language, term rows for the top excess terms.

    Null texts, languages and sources are empty ones, and keys of their own. A source without terms takes
    part with no counts; a language without kept terms has pairs of value 0 and no terms, one with a single
    source no pairs. Texts of any length are read whole; repeated rows are documents of their own; equal values
    rank by item. Other columns, of whatever name, are ignored. An empty table gives an empty result. The
    terms of a language may be LARGEST at most.
    """
    spark = df.sparkSession
    counts = staged(term_counts(df, text_col, lang_col, source_col), "counts")
    words = counts.where("term is not null")
    kept = staged(words.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= min_docs).select("lang", "term", "n"), "kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    langs = counts.where("term is null").select("lang").distinct().join(sizes, "lang", "left").na.fill(0)
    langs = staged(langs.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("terms") / chunk_terms)).cast("long")), "langs")
    if langs.where(F.col("lang_total") + 2 * F.col("terms") > LARGEST).limit(1).count():
        raise ValueError(f"a language has more than {LARGEST} kept terms")
    # of few languages, one may have most terms
    chunked = join_split(kept, langs.select("lang", "chunks"), "lang", hot_keys(langs, "terms")).withColumn("chunk", F.pmod(F.xxhash64("term"), "chunks"))
    by_chunk = Window.partitionBy("lang", "chunk")
    placed = chunked.select("lang", "term", F.col("n").alias("lang_n"), "chunk", (F.row_number().over(by_chunk.orderBy("term")) - 1).alias("pos"), F.count("*").over(by_chunk).alias("size"))
    placed = staged(placed, "vocabulary")
    rows = staged(words.select("lang", "source", "term", "n").join(placed, ["lang", "term"]), "rows")
    members = counts.where("term is null").select("lang", "source")
    blocks = members.groupBy("lang").agg(F.ceil(F.count("*") / block_groups).cast("long").alias("blocks"))
    groups = members.join(rows.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").na.fill(0, ["total"]).join(langs, "lang").join(blocks, "lang")
    groups = staged(groups.withColumn("block", F.pmod(F.xxhash64("source"), "blocks")), "groups")

    own = rows.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    own = own.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")).where("p > q")
    terms = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = terms.withColumn("rank", rank).where(F.col("rank") <= top)

    packed = rows.groupBy("lang", "source", "chunk").agg(F.first("size").alias("size"), F.collect_list(F.struct("pos", "n")).alias("cells"))
    packed = packed.select("lang", "source", "chunk", "size", F.col("cells.pos").alias("pos"), F.col("cells.n").alias("n"))
    held = placed.groupBy("lang", F.floor(F.col("chunk") / stripe_chunks).alias("stripe")).agg(F.count("*").alias("size"))
    stripes = langs.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("chunks") - 1) / stripe_chunks))).alias("stripe")).join(held, ["lang", "stripe"], "left").na.fill(0, ["size"])
    with small_batches(spark):
        sums = staged(pair_sums(groups.select("lang", "source", (F.col("total") + 2 * F.col("terms")).alias("whole"), "block", "blocks"), packed, stripes, stripe_chunks), "pairs")
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("d")
    pairs = sums.select("lang", both, "value").select("lang", "d.source", F.lit("pair").alias("part"), "d.item", "value").withColumn("rank", rank)
    return pairs.unionByName(terms)


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


_SHARE = "1 + (1000000000::hugeint * ({n} + 2)) // ({total} + 2 * {terms})"
_APART = "((p - q) * (p - q)) // (p + q)"
OP11_SQL = rf"""
with d as (select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
w as (select id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
c as (select lang, source, term, count(*) n, count(distinct id) docs from w group by all),
k as (select lang, term, sum(n)::bigint n from c group by all having sum(docs) >= {MIN_DOCS}),
l as (select lang, count(term) terms, coalesce(sum(n), 0)::bigint total from (select distinct lang from d) left join k using (lang) group by lang),
r as (select c.lang, c.source, term, c.n, k.n lang_n from c join k using (lang, term)),
g as (select lang, source, l.terms, l.total lang_total, coalesce(s.total, 0)::bigint total from (select distinct lang, source from d) join l using (lang) left join (select lang, source, sum(n) total from r group by all) s using (lang, source)),
p as (select g.lang, g.source, k.term, {_SHARE.format(n="coalesce(r.n, 0)", total="g.total", terms="g.terms")} p from g join k using (lang) left join r on r.lang = g.lang and r.source = g.source and r.term = k.term),
s as (select a.lang, a.source, b.source item, sum({_APART.replace("p", "a.p").replace("q", "b.p")}) as v from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' part, b.source item, coalesce(v, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
q as (select lang, source, term, {_SHARE.format(n="r.n", total="g.total", terms="g.terms")} p, {_SHARE.format(n="r.lang_n", total="g.lang_total", terms="g.terms")} q from r join g using (lang, source)),
terms as (select lang, source, 'term' part, term item, ({_APART})::bigint as value from q where p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= {TOP_TERMS}
"""
