"""The corpus pipeline: documents to token ids, each stage on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
`run` writes each result to the shared folder and reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, decontamination, jaccard_join, language_id, personal_data
from tickloom.llm.session import find_package, shielded, table
from tickloom.session import stage

#: A text whose best language scores less is of no language the model knows.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those without a letter, or whose best score is too low, go."""
    find_package(spark)
    rows, given = shielded(docs)
    others = tuple(c for c in rows.columns if c != "doc_id")
    judged = language_id.predict(rows, language_id.train(rows), keep=others, outputs=("__language", "__score"))
    known = judged.filter((F.col("__language") != language_id.UNDETERMINED) & (F.col("__score") >= LEAST_SCORE))
    return given(known.select(*[F.col(f"`{c}`") for c in rows.columns]))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets with a similarity of 0.8 or more."""
    find_package(spark)
    return jaccard_join.one_of_each_group(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced and n_chars counted anew."""
    find_package(spark)
    return personal_data.sanitise(docs, length="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of each document."""
    find_package(spark)
    return bpe.encode_digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language), ("jaccard_join", drop_near_copies), ("decontamination", drop_benchmark_leaks),
    ("personal_data", mask_personal_data), ("bpe", encode),
]

#: String kernels, tilings and merges are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
