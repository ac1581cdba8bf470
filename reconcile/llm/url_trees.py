"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

A rule names a host suffix and a path prefix; the longest fitting rule decides.
Every other url goes to boosted trees over its length, depth, digit ratio,
character entropy, parameter counts and the statistics of its host suffix. The
trees learn from the labelled urls, that is those with a verdict by rule, and
from none of the rules themselves.

Suffix statistics count all labelled rows, one row a task and suffix before the
shuffle; their table joins the urls as an ordinary join, which Spark broadcasts
where it measures the table as small and splits at hot suffixes where not. Only
the fit reads a bounded sample: the ``SAMPLE`` distinct labelled urls with the
smallest hash, each with its copies as weight. All expressions are built-in
functions and the trees run in the JVM.

Defined cases: null urls and urls without ``://`` have an empty host and path,
fit no rule, and are judged by the trees like any other; without labelled urls,
or with one label only, all other urls get ``allow`` or that label. Repeated
page_ids are judged row by row. An empty table gives no rows.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE, TREES, DEPTH, SEED = 10_000, 10, 4, 7
#: Pseudo-counts that pull the statistics of rare suffixes to one half.
PRIOR = 2.0


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = [
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
]

NUMBERS = ["length", "host_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "hyphens", "entropy", "parameters", "has_fragment", "file_suffix", "suffix_rate", "suffix_seen"]


def host_and_path(pages: DataFrame) -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``; both empty without ``://``."""
    at = F.locate("://", F.col("url"))
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    pattern = r"^([^/?#]*)([^?#]*)"
    return (
        pages.withColumn("__rest", rest)
        .withColumn("host", F.translate(F.regexp_extract("__rest", pattern, 1), string.ascii_uppercase, string.ascii_lowercase))
        .withColumn("path", F.regexp_extract("__rest", pattern, 2))
        .drop("__rest")
    )


def _fits(rule: Rule) -> Column:
    host = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
    return host & F.col("path").startswith(rule.path)


def by_rule(rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # longer ones are tested first
        name = F.when(_fits(rule), rule.name).otherwise(name)
        verdict = F.when(_fits(rule), rule.verdict).otherwise(verdict)
    return name, verdict


def lexical(pages: DataFrame) -> DataFrame:
    """Add the numeric features of a url and its host suffix."""
    url = F.coalesce("url", F.lit(""))
    n = F.char_length(url)
    count = lambda c, pattern: F.char_length(c) - F.char_length(F.regexp_replace(c, pattern, ""))
    size = F.greatest(n, F.lit(1))
    host_size = F.greatest(F.char_length("host"), F.lit(1))
    entropy = F.aggregate(
        F.array_distinct(F.split(url, "")),
        F.lit(0.0),
        lambda s, c: s - F.when(c == "", 0.0).otherwise(
            (n - F.char_length(F.replace(url, c, F.lit("")))) / size * F.log2((n - F.char_length(F.replace(url, c, F.lit("")))) / size)
        ),
    )
    query = F.when(F.locate("?", url) > 0, F.substring_index(F.substring_index(url, "#", 1), "?", -1)).otherwise("")
    return pages.withColumns({
        "length": n.cast("double"),
        "host_length": F.char_length("host").cast("double"),
        "depth": count(F.col("path"), "/").cast("double"),
        "labels": count(F.col("host"), r"\.").cast("double"),
        "digit_ratio": count(url, "[0-9]") / size,
        "host_digit_ratio": count(F.col("host"), "[0-9]") / host_size,
        "hyphens": count(F.col("host"), "-").cast("double"),
        "entropy": entropy,
        "parameters": F.when(query == "", 0.0).otherwise((count(query, "&") + 1).cast("double")),
        "has_fragment": (F.locate("#", url) > 0).cast("double"),
        "file_suffix": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
        "suffix": F.substring_index("host", ".", -1),
    })


class Trees:
    """A fitted model with the suffix statistics it was fitted on, or one constant verdict."""

    def __init__(self, model: GBTClassificationModel | None, suffixes: DataFrame | None, otherwise: str):
        self.model, self.suffixes, self.otherwise = model, suffixes, otherwise

    def blocks(self, features: DataFrame) -> DataFrame:
        """Add ``blocked`` (boolean) and ``block_score`` (0 to 1)."""
        if self.model is None:
            return features.withColumns({"blocked": F.lit(self.otherwise == "block"), "block_score": F.lit(float(self.otherwise == "block"))})
        from pyspark.ml.functions import vector_to_array

        scored = self.model.transform(_vector(_with_suffix(features, self.suffixes)))
        return scored.withColumns({"blocked": F.col("prediction") == 1.0, "block_score": vector_to_array("probability")[1]})


def _with_suffix(features: DataFrame, suffixes: DataFrame) -> DataFrame:
    return features.join(suffixes, "suffix", "left").fillna({"suffix_rate": 0.5, "suffix_seen": 0.0})


def _vector(features: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=NUMBERS, outputCol="features").transform(features)


def train(labelled: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fit on rows with ``url``, ``suffix`` and ``label`` (1: block, 0: allow); a url has one label."""
    from .components import written

    suffixes = written(
        labelled.groupBy("suffix").agg(F.sum("label").alias("blocked_rows"), F.count(F.lit(1)).alias("rows")), "url-suffixes"
    )
    seen = suffixes.agg(F.sum("blocked_rows").alias("blocked"), F.sum("rows").alias("rows")).first()
    if not seen["rows"] or seen["blocked"] in (0, seen["rows"]):
        return Trees(None, None, "block" if seen["blocked"] else "allow")
    suffixes = suffixes.select(
        "suffix",
        ((F.col("blocked_rows") + PRIOR / 2) / (F.col("rows") + PRIOR)).alias("suffix_rate"),
        F.log1p(F.col("rows").cast("double")).alias("suffix_seen"),
    )
    urls = labelled.groupBy("url").agg(F.any_value("label").alias("label"), F.count(F.lit(1)).cast("double").alias("copies"))
    few = written(urls.orderBy(F.xxhash64("url"), "url").limit(sample), "url-sample")
    gbt = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", weightCol="copies", featuresCol="features", cacheNodeIds=False)
    return Trees(gbt.fit(_vector(_with_suffix(lexical(host_and_path(few)), suffixes))), suffixes, "allow")


def judge(pages: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score of each page."""
    name, verdict = by_rule(rules)
    base = host_and_path(pages.select(F.col("page_id"), F.col("url").cast("string").alias("url")))
    features = lexical(base.withColumns({"rule": name, "by_rule": verdict}))
    labelled = features.where("by_rule is not null").withColumn("label", (F.col("by_rule") == "block").cast("double"))
    judged = train(labelled).blocks(features)
    learned = F.when(F.col("blocked"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", learned).alias("verdict"), "block_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
