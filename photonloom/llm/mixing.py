"""Mixing sources to target weights: hierarchical budgets over domain, language and source.

Leaf and node totals are aggregates. A node's budget is divided among its children by weight; a child
that can't use its share keeps what it can, and its siblings divide the rest before anything goes up,
as no child is ever given more than its own subtree can supply. A leaf takes whole seeded epochs and
then a prefix of the next epoch's order, found by bucket totals, so that no leaf is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonloom.llm.common import staged, table, word_count

LEVELS = ("domain", "lang", "source")
ROWS_PER_BUCKET = 1_000
Weights = Mapping[str, Mapping[str, float]]


def weight_of(level: str, weights: Weights) -> Column:
    """The weight given for the level's value, 1 where none is; weights must be above zero."""
    out = F.lit(1.0)
    for value, weight in weights.get(level, {}).items():
        if weight <= 0:
            raise ValueError(f"weight of {level} {value} is not above zero")
        out = F.when(F.col(level) == value, float(weight)).otherwise(out)
    return out


def shared_out(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """nodes with alloc: of the column budget, by weight, at most cap each; what one can't use goes to its siblings."""
    order = Window.partitionBy(*parents).orderBy((F.col("cap") / F.col("weight")), name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = nodes.withColumn("level", (F.col("budget") - before) / onward)
    open_level = F.max(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))).over(Window.partitionBy(*parents))
    return level.withColumn("open", open_level).withColumn("alloc", F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("weight") * F.col("open")).otherwise(F.col("cap"))).drop("level", "open")


def budgets(leaves: DataFrame, weights: Weights, share: float, max_epochs: float) -> DataFrame:
    """leaves (domain, lang, source, tokens, docs) with epochs, whole ones, and rest, the tokens of the next one's prefix."""
    cap = F.col("tokens") * float(max_epochs)
    own = leaves.withColumn("cap", cap.cast("double"))
    langs = own.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    domains = own.groupBy("domain").agg(F.sum("cap").alias("cap"))
    total = own.agg(F.least(F.floor(F.sum("tokens") * float(share)).cast("double"), F.sum("cap")).alias("budget"))
    # one row, so this is no cross join of tables
    top = domains.withColumns({"weight": weight_of("domain", weights), "root": F.lit(1)}).join(F.broadcast(total.withColumn("root", F.lit(1))), "root")
    top = shared_out(top, ["root"], "domain").select("domain", F.col("alloc").alias("budget"))
    mid = shared_out(langs.withColumn("weight", weight_of("lang", weights)).join(top, "domain"), ["domain"], "lang").select("domain", "lang", F.col("alloc").alias("budget"))
    low = shared_out(own.withColumn("weight", weight_of("source", weights)).join(mid, ["domain", "lang"]), ["domain", "lang"], "source")
    tokens = F.floor("alloc")
    return low.select(*LEVELS, "tokens", "docs", tokens.alias("wanted"), F.coalesce(F.floor(F.try_divide(tokens, F.col("tokens"))), F.lit(0)).alias("epochs")).withColumn("rest", F.col("wanted") - F.col("epochs") * F.col("tokens"))


def mix(
    df: DataFrame,
    weights: Weights,
    share: float,
    max_epochs: float = 1.0,
    seed: int = 0,
    id_col: str = "doc_id",
    domain: Column | None = None,
    lang_col: str = "lang",
    source_col: str = "source",
    tokens: Column | None = None,
    order: Column | None = None,
) -> DataFrame:
    """One row per input row: id, domain, lang, source, n_tokens, epochs, partial_tokens, tokens_taken.

    Wanted are share times all tokens. tokens defaults to the words of column text, however long. A row's
    document is taken epochs times whole, and then its first partial_tokens tokens. An epoch's order is
    drawn from order, the id unless given, and the id settles ties. Null keys count as the empty string,
    null texts as no tokens, null ids in the order as the empty string; repeated rows are separate documents
    next to each other in the order. Other columns, of whatever name, are ignored; an empty table gives an
    empty result.
    """
    key = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    count = word_count("text") if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    docs = df.select(F.col(id_col).alias("id"), key(F.lit("") if domain is None else domain).alias("domain"), key(F.col(lang_col)).alias("lang"), key(F.col(source_col)).alias("source"), count.alias("n_tokens"), key(F.col(id_col) if order is None else order).alias("drawn"))
    docs = staged(docs, "tokens")
    leaves = docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    plan = staged(budgets(leaves, weights, share, max_epochs), "budgets")
    place = F.md5(F.concat_ws(":", F.lit(seed), F.col("epochs"), F.col("drawn")))
    parts = F.ceil(F.col("docs") / ROWS_PER_BUCKET)
    bucket = F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * parts / float(1 << 32))
    rows = docs.join(plan, list(LEVELS)).withColumn("place", place).withColumn("bucket", bucket)
    sums = rows.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("held"))
    ahead = F.coalesce(F.sum("held").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*LEVELS, "bucket", ahead.alias("ahead"))
    here = F.coalesce(F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "bucket").orderBy("place", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("here", here).join(starts, [*LEVELS, "bucket"])
    partial = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - F.col("ahead") - F.col("here")))
    out = rows.select("id", *LEVELS, "n_tokens", "epochs", partial.alias("partial_tokens"))
    return out.withColumn("tokens_taken", F.col("epochs") * F.col("n_tokens") + F.col("partial_tokens")).withColumnRenamed("id", id_col)


#: documents has no domain, so sources stand in for it by their number modulo 4.
DOMAINS, DOMAIN_WEIGHTS, LANG_WEIGHTS, SHARE, MAX_EPOCHS, SEED = 4, {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, {"en": 5, "fr": 2, "de": 2, "es": 1}, 0.5, 2, 17


def domain_of(source: str = "source") -> Column:
    return F.concat(F.lit("d"), F.try_to_number(F.regexp_extract(source, "[0-9]+$", 0), F.lit("999999999")).cast("long") % DOMAINS)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS}, SHARE, MAX_EPOCHS, SEED, domain=domain_of())


def _shared_sql(nodes: str, parents: str, name: str) -> str:
    return f"""select *, case when cap / weight > level then weight * max(case when cap / weight > level then level end) over (partition by {parents}) else cap end alloc
from (select *, (budget - coalesce(sum(cap) over (partition by {parents} order by cap / weight, {name} rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (partition by {parents} order by cap / weight, {name} rows between current row and unbounded following) as level from ({nodes}))"""


def _case(level: str, weights: Mapping[str, float]) -> str:
    return f"(case {level} " + " ".join(f"when '{k}' then {float(v)}" for k, v in weights.items()) + " else 1.0 end)::double"


OP4_SQL = f"""
with docs as (select doc_id, coalesce('d' || (try_cast(nullif(regexp_extract(source, '[0-9]+$'), '') as bigint) % {DOMAINS}), '') as "domain", coalesce(lang, '') lang, coalesce(source, '') source,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint n_tokens from documents),
leaves as (select "domain", lang, source, sum(n_tokens)::bigint tokens, count(*) docs, (sum(n_tokens) * {MAX_EPOCHS})::double cap from docs group by all),
top as ({_shared_sql(f'''select "domain", sum(cap) cap, {_case('"domain"', DOMAIN_WEIGHTS)} weight, 1 root, (select least(floor(sum(tokens) * {SHARE}::double), sum(cap)) from leaves) budget from leaves group by "domain"''', 'root', '"domain"')}),
mid as ({_shared_sql(f'''select l."domain", l.lang, l.cap, {_case('l.lang', LANG_WEIGHTS)} weight, top.alloc budget from (select "domain", lang, sum(cap) cap from leaves group by all) l join top using ("domain")''', '"domain"', 'lang')}),
low as ({_shared_sql('''select v.*, 1.0::double weight, mid.alloc budget from leaves v join mid using ("domain", lang)''', '"domain", lang', 'source')}),
plan as (select *, (floor(alloc) - epochs * tokens)::bigint rest from (select *, coalesce(floor(floor(alloc) / nullif(tokens, 0)), 0)::bigint epochs from low)),
rows as (select d.*, p.epochs, p.rest, md5('{SEED}:' || p.epochs || ':' || d.doc_id) place from docs d join plan p using ("domain", lang, source)),
taken as (select *, greatest(0, least(n_tokens, rest - coalesce(sum(n_tokens) over (partition by "domain", lang, source order by place, doc_id rows between unbounded preceding and 1 preceding), 0)))::bigint partial_tokens from rows)
select doc_id, "domain", lang, source, n_tokens, epochs, partial_tokens, (epochs * n_tokens + partial_tokens)::bigint tokens_taken from taken
"""
