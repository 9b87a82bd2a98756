"""Toxicity: features by hand, held-out accuracy on the given tables, odd rows."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, prose, texts

from tickloom.llm import toxicity

LABELS = "doc_id bigint, quality int, toxic int, text string, i int"


def named(text, terms):
    return dict(zip(toxicity.FEATURES, toxicity.features(text, toxicity.Lexicon(terms))))


def test_features():
    terms = {"fool": 3.0, "stup*": 2.0, "meh": 0.5}
    f = named("You STUPIDLY stupid FOOL!! meh, one two three f0ol tree", terms)
    assert f["strong_density"] == 3 / 10 and f["mild_density"] == 1 / 10 and f["largest_weight"] == 3.0
    assert f["weight_density"] == pytest.approx((2 + 2 + 3 + 0.5) / 10)
    assert f["strong_words"] == math.log(4) and f["distinct_strong"] == math.log(4)
    assert f["second_person"] == 1 / 10 and f["close_second_person"] == 1.0
    assert f["shouted"] == 2 / 10 and f["punctuation_runs"] == 1 / 10
    assert f["revealed"] == f["disguised"] == 1 / 10, "f0ol is a disguised fool"
    assert named("a f.o.o.l is here", terms)["revealed"] == 1 / 7 and named("so f o o l", terms)["revealed"] == 1 / 5
    far = named("you " + "word " * 20 + "fool", terms)
    assert far["close_second_person"] == 0 and far["second_person"] == 1 / 22
    assert named("sooo good", terms)["stretched"] == 1 / 2
    assert set(named("", terms).values()) == {0.0} and named(" \n!", terms)["length"] == 0


def test_lexicon_forgets(monkeypatch):
    monkeypatch.setattr(toxicity.T, "CACHE_WORDS", 3)
    book = toxicity.Lexicon({"bad*": 2.0, "badge": 5.0})
    assert [book[w] for w in ("badly", "a", "b", "c", "badge", "bad")] == [0.0, 0, 0, 0, 5.0, 0.0]
    assert toxicity.Lexicon({"badl*": 2.0})["badly"] == 2.0 and len(book) <= 3


def rows_with_labels():
    r = random.Random(4)
    rows, labels = [], []
    for k in range(300):
        words = prose(k, r.randint(5, 60)).split()
        toxic = k % 4 == 0
        if toxic:
            for _ in range(1 + len(words) // 8):
                words[r.randrange(len(words))] = r.choice(["zorkish", "zorkly", "quabble"])
        rows.append((k, " ".join(words), "en", "s"))
        labels.append((k, 1, int(toxic), "x", 0))
    return rows, labels


@pytest.fixture(scope="module")
def made(spark):
    rows, labels = rows_with_labels()
    odd = [(1000 + k, t, None, None) for k, t in enumerate(texts())]
    rows += odd + [rows[0]] * 40 + [(None, "nobody's zorkish text", "en", None), (None, None, None, None)]
    labels += [(3, 1, None, "x", 0), (None, 1, 1, "x", 0), labels[0], (1006, 0, 1, "x", 0), (99_999, 0, 1, "x", 0)]
    df = spark.createDataFrame([(*r, 1, 2, "x", 3, 4, 5, "y") for r in rows], SCHEMA)
    return df.selectExpr("*", "1 AS score", "2 AS features", "'t' AS __id", "0 AS toxic"), spark.createDataFrame(labels, LABELS), rows, labels


def test_odd_rows(made):
    docs, labels, rows, marks = made
    found = toxicity.judge_documents(docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in rows)
    toxic = {m[0] for m in marks if m[2]}
    tested = [r for r in found if r["held_out"] and r["doc_id"] < 300]
    assert sum(r["predicted"] == (r["doc_id"] in toxic) for r in tested) >= 0.95 * len(tested) > 50
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] in (True, False)
    assert len({r["score"] for r in found if r["doc_id"] == 0}) == 1, "copies are judged alike"
    by_id = {r["doc_id"]: r["score"] for r in found}
    assert by_id[1006] == by_id[1007] < 0.7, "null and empty"


def test_labels_of_one_kind(made):
    docs, labels, _, _ = made
    for kept, expected in (("toxic = 1", 1.0), ("toxic = 0", 0.0), ("false", 0.0)):
        assert {r["score"] for r in toxicity.judge_documents(docs, labels.filter(kept)).collect()} == {expected}
    assert toxicity.judge_documents(docs.limit(0), labels).count() == 0


def test_sample_is_bounded_and_balanced(made):
    docs, labels, rows, marks = made
    known = toxicity.labelled_texts(docs, labels, "doc_id", "text", "toxic")
    assert known.count() == len({r[1] for r in rows if r[0] is not None and r[0] < 300 and not held(r[0])})
    sample = toxicity.sample_texts(docs, known, 20, "text")
    assert {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()} == {0: 20, 1: 20}


def held(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_term_counts(made):
    docs, labels, rows, marks = made
    sample = toxicity.sample_texts(docs, toxicity.labelled_texts(docs, labels, "doc_id", "text", "toxic"), 1000, "text").cache()
    lexicons = toxicity.learn_terms(sample, 50)
    held_by = {0: [], 1: []}
    for r in sample.collect():
        held_by[r["toxic"]].append({t for w in re.findall(r"[^\W_]+", r["text"].lower()) for t in toxicity.terms_of(w)})

    def weight(term):
        n = {k: sum(term in s for s in held_by[k]) for k in (0, 1)}
        m = {k: len(held_by[k]) for k in (0, 1)}
        odds = [math.log((n[k] + 0.5) / (m[k] - n[k] + 0.5)) for k in (0, 1)]
        return odds[1] - odds[0] - toxicity.DOUBT * math.sqrt(sum(1 / (n[k] + 0.5) + 1 / (m[k] - n[k] + 0.5) for k in (0, 1)))

    assert {"zork*", "quabble", "zorkish", "zorkly"} <= set(lexicons[-1]) and len(lexicons) == toxicity.FOLDS + 1
    for term, value in lexicons[-1].items():
        assert value == pytest.approx(weight(term)) and value > 0


def test_held_out_accuracy(spark):
    """On the larger table, on documents that no label was learned from. About one label in 200 there contradicts the text."""
    from tickloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.1"
    judged = QUERIES["op13_toxicity"](spark, folder).filter("held_out")
    found = judged.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    n = found.agg(F.count_if(F.expr("toxic = 1 AND predicted = 1")).alias("tp"), F.count_if(F.expr("toxic = 1")).alias("p"),
                  F.count_if(F.expr("toxic = 0 AND predicted = 1")).alias("fp"), F.count_if(F.expr("toxic = 0")).alias("n")).first()
    assert n["tp"] >= 0.9 * n["p"] and n["fp"] <= 0.01 * n["n"] and n["p"] > 100
