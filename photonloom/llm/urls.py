"""URL filters: host and path rules, then gradient-boosted trees on lexical features.

The main path is DataFrame expressions and the DataFrame-based trees of pyspark.ml; no Python runs on
the executors.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonloom.llm.common import hot_keys, join_split, staged

#: (host and path, verdict); a rule fits its host and all subdomains where the path starts with its path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Most distinct labelled URLs that the trees are fitted on, and the trees' size.
SAMPLE_ROWS, TREES, DEPTH, SEED = 20_000, 10, 4, 11
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "params", "param_length", "suffix_share", "suffix_rows")


def host_of(url: str | Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str | Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: str, path: str, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for name, says in sorted(rules, key=lambda r: -len(r[0])):
        own, _, begin = name.partition("/")
        fits = ((F.col(host) == own) | F.endswith(F.col(host), F.lit(f".{own}"))) & F.startswith(F.col(path), F.lit(f"/{begin}"))
        rule = F.when(fits, name) if rule is None else rule.when(fits, name)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def entropy_of(text: Column) -> Column:
    """Shannon entropy of the characters, in nats; 0 for the empty string."""
    size = F.length(text).cast("double")
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda s, c: s - F.when(c == "", 0.0).otherwise(share(c) * F.log(share(c))))


def with_lexical(df: DataFrame, url_col: str = "url") -> DataFrame:
    """df with host, path, suffix and the lexical features but those of the suffix."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    df = df.withColumns({"host": host_of(url), "path": path_of(url), "_url": url, "_query": query})
    count = lambda text, what: F.coalesce(F.regexp_count(text, F.lit(what)), F.lit(0)).cast("double")
    length = lambda c: F.length(c).cast("double")
    return df.withColumns(
        {
            "suffix": F.element_at(F.split("host", r"\."), -1),
            "url_length": length("_url"),
            "host_length": length("host"),
            "path_length": length("path"),
            "depth": count("path", "/"),
            "labels": count("host", r"\."),
            "digit_ratio": count("_url", "[0-9]") / F.greatest(length("_url"), F.lit(1.0)),
            "hyphens": count("host", "-"),
            "entropy": entropy_of(F.concat("host", "path")),
            "params": F.when(F.col("_query") == "", 0.0).otherwise(count("_query", "&") + 1.0),
            "param_length": length("_query"),
        }
    ).drop("_url", "_query")


class UrlModel:
    """Trees, and the blocked share and rows of each suffix; constant is the verdict where there are no two classes."""

    def __init__(self, trees: GBTClassificationModel | None, suffixes: DataFrame | None, share: float, constant: str):
        self.trees, self.suffixes, self.share, self.constant = trees, suffixes, share, constant
        self.hot = hot_keys(suffixes, "suffix_rows") if suffixes is not None else None

    def features(self, rows: DataFrame) -> DataFrame:
        # suffixes are as many as the data has; those of very many rows, such as com, are joined where the rows are
        rows = join_split(rows, self.suffixes, "suffix", self.hot).fillna({"suffix_share": self.share, "suffix_rows": 0.0})
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)

    def verdict(self, rows: DataFrame) -> DataFrame:
        """rows of with_lexical() with learned: allow or block."""
        if self.trees is None:
            return rows.withColumn("learned", F.lit(self.constant))
        out = self.trees.transform(self.features(rows))
        return out.withColumn("learned", F.when(F.col("prediction") > 0, "block").otherwise("allow")).drop("features", "rawPrediction", "probability", "prediction", "suffix_share", "suffix_rows")


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """Distinct URLs by their lexical features and label, those with the smallest hashes and most at most, with n, the rows of each.

    However often a URL is repeated, it is one of them.
    """
    keys = ["host", "path", "suffix", *FEATURES[:-2], "label"]
    drawn = rows.select(*keys, F.xxhash64(*keys, F.lit(SEED)).alias("h"))
    last = drawn.select("h").distinct().orderBy("h").limit(most).agg(F.max("h").alias("h")).first().h
    return drawn.where(F.col("h") <= F.lit(last)).groupBy(*keys, "h").agg(F.count("*").cast("double").alias("n")).drop("h")


def train(labelled: DataFrame, label_col: str = "label", sample_rows: int = SAMPLE_ROWS) -> UrlModel:
    """From rows of with_lexical() with a label allow or block; trees are fitted on sampled() of them, rows as weights.

    Suffix statistics are of all labelled rows, with a row for every suffix; a suffix without labels gets the
    share of all rows. Null labels are skipped. With one class only, or no rows, the verdict is constant:
    that class, or allow.
    """
    rows = labelled.where(F.col(label_col).isin("allow", "block")).withColumn("label", (F.col(label_col) == "block").cast("double"))
    n = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocked")).first()
    if n.blocked in (0, n.n):
        return UrlModel(None, None, 0.0, "block" if n.n and n.blocked else "allow")
    suffixes = staged(rows.groupBy("suffix").agg(F.count("*").cast("double").alias("suffix_rows"), ((F.sum("label") + 1.0) / (F.count("*") + 2.0)).alias("suffix_share")), "suffixes")
    model = UrlModel(None, suffixes, n.blocked / n.n, "allow")
    sample = staged(model.features(sampled(rows, sample_rows)).select("features", "label", "n"), "sample")
    if sample.select("label").distinct().count() < 2:
        model.constant = "block" if n.blocked * 2 > n.n else "allow"
        return model
    # the sample is a few megabytes at any scale; few partitions keep the many small steps of boosting short
    model.trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=32, weightCol="n").fit(sample.coalesce(2))
    return model


def judge(df: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, host, path, rule, verdict, learned): verdict is the rule's, else that of trees trained on the ruled URLs.

    Null URLs and those without `://` have an empty host and path, hence no rule; very long ones are read
    whole. Repeated rows and null ids each keep their row; other columns of df, of whatever name, are
    ignored. An empty table gives an empty result.
    """
    rows = with_lexical(df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url")))
    rule, says = rule_of("host", "path", rules)
    rows = rows.withColumns({"rule": rule, "says": says})
    out = train(rows, "says", sample_rows).verdict(rows)
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("says", "learned").alias("verdict"), "learned")


def op3_urls(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
