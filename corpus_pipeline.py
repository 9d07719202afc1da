"""The corpus pipeline: each stage takes and, but for the last, returns the columns of documents, whatever else these are.

Rows are told apart by their place in the stage's input, so rows with null, repeated or clashing ids are
documents of their own. Null and empty texts leave at the language stage; where no row has a label to
learn from, that stage rejects only texts without a letter. Null languages and sources are keys of their
own in the mixture. An empty table passes through as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonloom.llm.common import first_words, free_name, staged
from photonloom.llm.langid import UNKNOWN, train, with_language
from photonloom.llm.mixing import DOMAIN_WEIGHTS, LANG_WEIGHTS, SEED, domain_of, mix
from photonloom.llm.packing import pack
from photonloom.llm.pii import redact
from photonloom.llm.simhash import near_duplicates

#: Least calibrated probability of the predicted language.
MIN_SCORE = 0.5
#: Share of the remaining tokens that the mixture keeps; no document is taken twice.
MIX_SHARE = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told with a probability of at least MIN_SCORE."""
    model = train(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = (free_name(c, docs.columns) for c in ("lang_pred", "score"))
    found = with_language(docs, model, into=(lang, score))
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= MIN_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def _placed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column, of the returned name, that tells rows apart and sorts them by doc_id, null ids last, then by place in the files."""
    name = free_name("row", docs.columns)
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        # a joined or united table has no places of its own
        docs = staged(docs, "placed")
    whole = dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint")
    # whole numbers from the least one up sort as text of equal length
    id_ = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0") if whole else F.col("doc_id").cast("string")
    place = F.concat_ws(":", F.lpad(F.col("_metadata.row_index").cast("string"), 12, "0"), F.col("_metadata.file_name"))
    return docs.withColumn(name, F.concat_ws(":", F.coalesce(id_, F.lit("~")), place)), name


def _met(docs: DataFrame, found: DataFrame, row: str) -> DataFrame:
    """Rows of docs that found names, with its columns. Both sides are dealt by row at any size, so the plan stays the same as they grow."""
    return docs.join(staged(found, "kept").hint("merge"), row)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each SimHash group the document with the smallest doc_id, the first one of these."""
    placed, row = _placed(docs)
    found = near_duplicates(placed, id_col=row).where(F.col(row) == F.col("component_id")).select(row)
    return _met(placed, found, row).select(*[F.col(f"`{c}`") for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data; n_chars follows the masked text."""
    return redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of which the mixture takes tokens, of the last one of each leaf the taken tokens only; n_chars follows."""
    placed, row = _placed(docs)
    taken = mix(placed, {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS}, MIX_SHARE, 1.0, SEED, id_col=row, domain=domain_of(), order=F.concat_ws(":", "doc_id", F.xxhash64("text")))
    words, whole, text = (free_name(c, docs.columns) for c in ("words_taken", "words_whole", "text_taken"))
    found = taken.where("tokens_taken > 0").select(row, F.col("tokens_taken").alias(words), F.col("n_tokens").alias(whole))
    out = _met(placed, found, row).withColumn(text, F.when(F.col(words) < F.col(whole), first_words("text", words)).otherwise(F.col("text")))
    length = F.when(F.col(words) < F.col(whole), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    new = {"text": F.col(text), "n_chars": length}
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into token windows."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packing),
]

#: SQL can't express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
