"""The pipeline's stages against the operators' plain rules, on the small table."""

import hashlib

import corpus_pipeline
import public_tokenizers
import pytest
from test_operators import base_by_patterns


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    from tickloom.session import stage

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = [docs]
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
        found.append(docs)
    return found


def test_columns_and_rows(results):
    for df in results[:-1]:
        assert df.columns == results[0].columns
    counts = [df.count() for df in results]
    assert counts[0] >= counts[1] > counts[2] > counts[3] == counts[4] == counts[5]
    assert counts[1] >= 0.99 * counts[0], "prose in a known language stays"


def test_leaks_go_and_texts_are_masked(spark, sf_dir, results):
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r["text"] for r in results[2].collect()}
    after = {r["doc_id"] for r in results[3].collect()}
    leaks = {d for d, t in before.items() if any(i in t for i in items)}
    assert leaks and not leaks & after and len(before) - len(after) <= 1.2 * len(leaks)
    for r in results[4].collect():
        assert not base_by_patterns(r["text"]) and r["n_chars"] == len(r["text"])


def test_tokens(results):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tool.no_truncation()
    tool.no_padding()
    texts = {r["doc_id"]: r["text"] for r in results[4].collect()}
    for r in results[5].collect():
        ids = tool.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, sf_dir)
        assert docs.count() == 0 and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls in every column, empty and blank texts, ties, repeated rows, long texts and columns named like internal ones."""
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, " \n", None, "s", 2), (None, "no id here at all", "en", None, 3),
           (10**6 + 3, "tie", "en", "s", 3), (10**6 + 4, "tie", "de", "s", 3), (10**6 + 5, "word " * 30_000, "en", "s", 150_000)]
    rows = real.unionByName(spark.createDataFrame(odd, real.schema)).unionByName(real.limit(5))
    docs = rows.selectExpr("*", "1 AS __id", "'x' AS __language", "2 AS __score", "'y' AS __text", "3 AS __found", "4 AS __key", "5 AS given0")
    names, counts = docs.columns, [docs.count()]
    for name, function in corpus_pipeline.STAGES[:-1]:
        from tickloom.session import stage

        docs = stage(function(spark, docs, sf_dir), name)
        assert docs.columns == names, name
        assert docs.select("__id", "__language", "__score", "__text", "__found", "__key", "given0").distinct().collect() == [(1, "x", 2, "y", 3, 4, 5)]
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] > 0
    left = docs.filter("doc_id IS NOT NULL")
    assert left.count() == left.select("doc_id").distinct().count(), "one row of each repeated document"
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert tokens.count() == counts[4] and set(tokens.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
