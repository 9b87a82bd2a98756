"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import stage

FEATURES = ["url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters",
            "host_labels", "hyphens", "secure", "suffix_weight", "suffix_block_rate"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and the paths that start with `path`."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"),
         Rule("allow", "org", "/fr/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    host, path = (F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit("")) for k in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Text and verdict of the longest rule that fits; null if none does.

    Of rules of equal length the one with the longer host wins, then the first by text.
    """
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text, r.verdict))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in reversed(ordered):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def training_label(host: Column, matched: Column, rules=RULES) -> Column:
    """Block or allow where the rules tell it, else null.

    A rule labels what it fits. A URL on a rule's host that no rule fits is labelled `allow`: who lists a part of a
    site has seen the site, and without this label all examples of a host with one blocked part would be blocked.
    """
    listed = F.lit(False)
    for rule in rules:
        listed = listed | (host == rule.host) | host.endswith("." + rule.host)
    return F.coalesce(matched["verdict"], F.when(listed, "allow"))


def lexical_features(df: DataFrame, url: str = "url") -> DataFrame:
    """Features that need the row only; expects `host` and `path`. A null URL counts as empty."""
    text = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    length = F.length(text)
    characters = F.split(text, "")
    entropy = F.aggregate(F.array_distinct(characters), F.lit(0.0), lambda total, c: F.when(c == "", total).otherwise(
        total - (F.size(F.filter(characters, lambda x: x == c)) / length)
        * F.log2(F.size(F.filter(characters, lambda x: x == c)) / length)))
    return df.withColumns({
        "url_length": length.cast("double"), "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": F.regexp_count(F.col("path"), F.lit("/[^/]")).cast("double"),
        "digit_ratio": F.coalesce(F.try_divide(F.regexp_count(text, F.lit("[0-9]")), length), F.lit(0.0)),
        "entropy": F.when(length > 0, entropy).otherwise(0.0),
        "parameters": F.regexp_count(text, F.lit("[?&][^=&#]+=")).cast("double"),
        "host_labels": F.size(F.split("host", r"\.")).cast("double"),
        "hyphens": F.regexp_count(text, F.lit("-")).cast("double"),
        "secure": text.startswith("https://").cast("double"),
        "suffix": F.regexp_extract("host", r"([^.]*)$", 1),
    })


def with_suffix_statistics(df: DataFrame, labelled: Column, blocked: Column, prior: float = 5.0) -> DataFrame:
    """How frequent a row's host suffix is among all rows (a logarithm), and its smoothed rate of blocked labels.

    One aggregate with a partial count before the shuffle; the join is left to Spark's measured sizes.
    """
    rates = df.groupBy(F.col("suffix").alias("__suffix")).agg(
        F.log10(F.count(F.lit(1))).alias("suffix_weight"),
        ((F.count_if(labelled & blocked) + prior / 2) / (F.count_if(labelled) + prior)).alias("suffix_block_rate"))
    return df.join(rates, F.col("suffix") == F.col("__suffix")).drop("__suffix")


def judge_urls(df: DataFrame, url: str = "url", id: str = "page_id", rules=RULES, sample_rows: int = 20_000,
               trees: int = 12, depth: int = 3) -> DataFrame:
    """id, host, path, rule, verdict and the trees' block probability for every row.

    Labels come from the rules (`training_label`). Trees are fitted on at most `sample_rows` distinct labelled URLs, taken by
    hash; suffix statistics cover all rows. With labels of one kind only, that verdict holds for the rest;
    with none it is `allow`. Null or malformed URLs have empty host and path and are judged by the trees.
    Repeated rows are judged alike; columns besides id and url are not looked at.
    """
    base = df.select(F.col(f"`{id}`").alias("__id"), F.col(f"`{url}`").alias("url"))
    host, path = url_parts(F.col("url"))
    parts = base.withColumns({"host": host, "path": path})
    parts = lexical_features(parts.withColumn("matched", matching_rule(F.col("host"), F.col("path"), rules)))
    parts = parts.withColumn("labelled", training_label(F.col("host"), F.col("matched"), rules))
    known, blocked = F.col("labelled").isNotNull(), F.col("labelled") == "block"
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(
        with_suffix_statistics(parts, known, blocked))
    # One row per URL, so that a hot one cannot fill the sample; written once, as the guard and every tree read it
    distinct = rows.filter(known).select("url", "features", blocked.cast("double").alias("label")).dropDuplicates(["url"])
    sample = stage(distinct.orderBy(F.xxhash64("url"), "url").limit(sample_rows).select("features", "label"), "sample")
    kinds = ["block" if r["label"] else "allow" for r in sample.select("label").distinct().collect()]
    if set(kinds) == {"allow", "block"}:
        model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, maxBins=32, seed=7,
                              subsamplingRate=1.0).fit(sample)
        judged = model.transform(rows)
        judged = judged.withColumn("block_probability", vector_to_array("probability")[1])
    else:
        judged = rows.withColumn("block_probability", F.lit(1.0 if kinds == ["block"] else 0.0))
    verdict = F.coalesce(F.col("matched.verdict"), F.when(F.col("block_probability") > 0.5, "block").otherwise("allow"))
    return judged.select(F.col("__id").alias(id), "host", "path", F.col("matched.rule").alias("rule"),
                         verdict.alias("verdict"), F.round("block_probability", 6).alias("block_probability"))
