"""Toxicity: boosted trees over dense features of a text, their margin calibrated by isotonic regression.

The lexicon is learned with the rest: words and beginnings of words that labelled toxic texts hold clearly more often than
others, each with the lower bound of its log odds ratio. Features that labelled texts get for the fit come from a lexicon that has
not seen them. Trees and lexicon are fitted on a bounded sample of labelled texts; every text is scored whole.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import text as T
from tickloom.llm.language_id import held_out
from tickloom.session import stage

# Words that speak to the reader, and signs that stand for letters.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner ihr euch euer "
    "tu te toi ton tes vous votre vos tú ti usted ustedes vosotros".split())
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l",
                       "*": None, ".": None, "-": None, "_": None, " ": None})

WORD = re.compile(r"[^\W_]+")
SHOUTED = re.compile(r"\b[^\W\d_a-zß-öø-ÿ]{3,}\b")
PUNCTUATION_RUN = re.compile(r"[!?]{2,}")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
DISGUISED = re.compile(r"(?<![\w@$])(?:[@$][^\W\d_]++(?:[*@$!|0-9.\-_]++[^\W\d_]++)*|[^\W\d_]++(?:[*@$!|0-9.\-_]++[^\W\d_]++)+)")
SPACED = re.compile(r"(?<!\w)[^\W\d_](?:[ .\-][^\W\d_]){3,}(?!\w)")

#: Lengths of the word beginnings that are terms besides the whole word: inflected and joined forms share them.
STEMS = (4, 5, 6, 7)
#: Standard errors by which a term's log odds ratio must stay above zero, and what makes it a strong one.
DOUBT, STRONG = 2.5, 1.0
#: Words around a term in which a second person counts as close.
NEAR = 5
#: Parts of the sample: each gets features from a lexicon of the others, and the last one calibrates.
FOLDS = 3
FEATURES = [
    "strong_density", "mild_density", "weight_density", "strong_words", "distinct_strong", "largest_weight",
    "second_person", "close_second_person", "capitals", "shouted", "punctuation", "punctuation_runs", "stretched",
    "disguised", "revealed", "length"]


class Lexicon(dict):
    """Weight of each word: that of its heaviest term, 0 without one. Remembers T.CACHE_WORDS words."""

    def __init__(self, terms: dict[str, float]):
        super().__init__()
        self.terms = terms
        self.starts = {t[:min(STEMS)] for t in terms if t.endswith("*")}

    def __missing__(self, word: str) -> float:
        if len(self) >= T.CACHE_WORDS:
            self.clear()
        if word[:min(STEMS)] in self.starts:
            weight = max(self.terms.get(t, 0.0) for t in terms_of(word))
        else:
            weight = self.terms.get(word, 0.0)
        self[word] = weight
        return weight


def terms_of(word: str) -> list[str]:
    """The word, and its beginnings marked with `*`."""
    return [word, *[word[:k] + "*" for k in STEMS if len(word) > k]]


@cache
def _kinds() -> np.ndarray:
    """For each code point: 1 capital, 2 other letter, 3 white space, 4 mark, 0 anything else."""
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    for point in range(0x30000):  # beyond, letters have no case and marks are not in use
        c = chr(point)
        kinds[point] = 1 if c.isupper() else 2 if c.isalpha() else 3 if c.isspace() else 4 if unicodedata.category(c)[0] in "PS" else 0
    return kinds


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The dense features of one text; all zero for an empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    lower = text.lower()
    words = WORD.findall(lower)
    n = max(len(words), 1)
    weights = np.fromiter(map(lexicon.__getitem__, words), np.float64, len(words))
    strong = np.flatnonzero(weights >= STRONG)
    mild = np.count_nonzero(weights) - len(strong)
    persons = [k for k, w in enumerate(words) if w in SECOND_PERSON]
    close = 0
    if persons and len(strong):
        at = np.searchsorted(persons, strong)
        far = np.iinfo(np.int64).max // 2
        edged = np.array([-far, *persons, far])
        close = int(np.count_nonzero(np.minimum(strong - edged[at], edged[at + 1] - strong) <= NEAR))
    kinds = np.bincount(_kinds()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)], minlength=5)
    letters, signs = max(int(kinds[1] + kinds[2]), 1), max(int(kinds.sum() - kinds[3]), 1)
    disguised = revealed = 0
    for pattern in (DISGUISED, SPACED):
        for m in pattern.finditer(lower):
            disguised += 1
            plain = m.group().translate(SIGNS)
            if lexicon[plain] >= STRONG and not any(lexicon[w] >= STRONG for w in WORD.findall(m.group())):
                revealed += 1
    return [
        len(strong) / n, mild / n, float(weights.sum()) / n, np.log1p(len(strong)),
        np.log1p(len({words[k] for k in strong.tolist()})), float(weights.max()) if len(weights) else 0.0,
        len(persons) / n, close / max(len(strong), 1), int(kinds[1]) / letters, len(SHOUTED.findall(text)) / n,
        int(kinds[4]) / signs, len(PUNCTUATION_RUN.findall(text)) / n, len(STRETCHED.findall(lower)) / n,
        disguised / n, revealed / n, np.log1p(len(words))]


# -- the bounded sample ------------------------------------------------------------------------

def labelled_texts(documents: DataFrame, labels: DataFrame, id: str, text: str, label: str) -> DataFrame:
    """(key, toxic) of every labelled text that is not held out, once; key is the text's hash.

    A document or text with both labels counts as toxic. Copies are counted once per task before they move.
    """
    marks = (labels.filter(F.col(f"`{label}`").isNotNull() & F.col(f"`{id}`").isNotNull())
             .groupBy(F.col(f"`{id}`").alias("i")).agg(F.max((F.col(f"`{label}`") > 0).cast("int")).alias("toxic")))
    texts = (documents.filter(F.col(f"`{text}`").isNotNull() & ~held_out(F.col(f"`{id}`")))
             .select(F.col(f"`{id}`").alias("i"), F.xxhash64(f"`{text}`").alias("key")).distinct())
    return texts.join(marks, "i").groupBy("key").agg(F.max("toxic").alias("toxic"))


def sample_texts(documents: DataFrame, known: DataFrame, per_label: int, text: str) -> DataFrame:
    """(key, toxic, fold, text) of at most `per_label` texts of each label, the first by hash."""
    order = [F.xxhash64("key"), F.col("key")]
    chosen = known.filter("toxic = 1").orderBy(*order).limit(per_label).unionByName(
        known.filter("toxic = 0").orderBy(*order).limit(per_label))
    # At most 2 * per_label rows of two numbers are broadcast.
    rows = documents.select(F.xxhash64(f"`{text}`").alias("key"), F.col(f"`{text}`").alias("text")).filter(F.col("text").isNotNull())
    found = rows.join(F.broadcast(chosen), "key").groupBy("key").agg(F.first("toxic").alias("toxic"), F.first("text").alias("text"))
    return found.withColumn("fold", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(FOLDS)).cast("int"))


def learn_terms(sample: DataFrame, most_terms: int) -> list[dict[str, float]]:
    """Lexicons of term weights: one without each fold, and at last the one of all.

    A term counts once per text. Its weight is its log odds ratio less DOUBT standard errors; only positive ones stay,
    at most `most_terms`, the heaviest.
    """
    names = [f"n{fold}_{toxic}" for fold in range(FOLDS) for toxic in (0, 1)]

    def count(batches):
        counts = [Counter() for _ in names]
        for batch in batches:
            for value, fold, toxic in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), batch.column("toxic").to_pylist()):
                counts[2 * fold + toxic].update({t for w in set(WORD.findall(value.lower())) for t in terms_of(w)})
            if sum(map(len, counts)) > T.CACHE_WORDS:
                yield from rows(counts)
                counts = [Counter() for _ in names]
        yield from rows(counts)

    def rows(counts):
        for k, counter in enumerate(counts):
            items = list(counter.items())
            for at in range(0, len(items), 10_000):
                part = items[at:at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in part]), pa.array([k] * len(part), pa.int32()),
                                                  pa.array([n for _, n in part], pa.int64())], ["term", "cell", "n"])

    per_cell = sample.select("text", "fold", "toxic").mapInArrow(count, "term string, cell int, n bigint")
    per_term = per_cell.groupBy("term").agg(*[F.sum(F.when(F.col("cell") == k, F.col("n")).otherwise(0)).alias(n) for k, n in enumerate(names)])
    totals = sample.agg(*[F.count_if((F.col("fold") == k // 2) & (F.col("toxic") == k % 2)).alias(n) for k, n in enumerate(names)]).first()

    def weight(left_out: int | None) -> Column:
        kept = [fold for fold in range(FOLDS) if fold != left_out]
        held = [sum((F.col(f"n{fold}_{toxic}") for fold in kept), F.lit(0)) for toxic in (0, 1)]
        texts = [sum(totals[f"n{fold}_{toxic}"] for fold in kept) for toxic in (0, 1)]
        odds = [F.log((held[t] + 0.5) / (texts[t] - held[t] + 0.5)) for t in (0, 1)]
        spread = sum((1 / (held[t] + 0.5) + 1 / (texts[t] - held[t] + 0.5) for t in (0, 1)), F.lit(0.0))
        return odds[1] - odds[0] - DOUBT * F.sqrt(spread)

    cuts = [*range(FOLDS), None]
    weighed = per_term.select("term", *[weight(cut).alias(f"w{k}") for k, cut in enumerate(cuts)])
    best = F.greatest(*[f"w{k}" for k in range(len(cuts))])
    found = weighed.filter(best > 0).orderBy(best.desc(), "term").limit(most_terms).collect()
    return [{r["term"]: r[f"w{k}"] for r in found if r[f"w{k}"] > 0} for k in range(len(cuts))]


# -- model -------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Model:
    terms: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    #: Score of every text where labels of one kind only, or none, are known.
    constant: float = 0.0


def train(documents: DataFrame, labels: DataFrame, per_label: int = 8_000, most_terms: int = 4_000, trees: int = 15, depth: int = 3,
          id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Lexicon, trees and calibration from the labelled documents that are not held out.

    Fitted on at most `per_label` distinct texts of each label, a documented bound. Trees see two folds of them, balanced;
    the third, weighted back to the labels' shares among all labelled texts, gives the isotonic calibration.
    """
    known = stage(labelled_texts(documents, labels, id, text, label), "labelled")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return Model({}, None, None, 1.0 if 1 in counts else 0.0)
    sample = stage(sample_texts(documents, known, per_label, text), "sample")
    lexicons = learn_terms(sample, most_terms)

    def describe(batches):
        books = [Lexicon(terms) for terms in lexicons[:FOLDS]]
        for batch in batches:
            rows = [features(value, books[fold]) for value, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("fold"), batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], ["key", "fold", "toxic", "values"])

    rows = sample.select("key", "fold", "toxic", "text").mapInArrow(describe, "key bigint, fold int, toxic int, values array<double>")
    rows = stage(rows, "features").select("key", "fold", F.col("toxic").cast("double").alias("label"), array_to_vector("values").alias("features"))
    fitted = rows.filter(F.col("fold") < FOLDS - 1)
    if len(fitted.select("label").distinct().collect()) < 2:  # too few texts for folds
        fitted = rows
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=64, stepSize=0.3, seed=11).fit(fitted.orderBy("key").drop("key", "fold"))
    judged = model.transform(rows.filter(F.col("fold") == FOLDS - 1)).withColumn("margin", margin())
    shares = {toxic: n / min(n, per_label) for toxic, n in counts.items()}
    judged = judged.withColumn("weight", F.when(F.col("label") == 1, shares[1]).otherwise(shares[0])).select("margin", "label", "weight")
    calibration = None
    if len(judged.select("label").distinct().collect()) == 2:
        calibration = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight", predictionCol="score").fit(judged)
    return Model(lexicons[-1], model, calibration)


def margin() -> Column:
    return vector_to_array("probability")[1]


def score(documents: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(`id`, score) for every row; a null text counts as empty. Only the text is looked at, and all of it."""
    if model.trees is None:
        return documents.select(F.col(f"`{id}`"), F.lit(model.constant).alias("score"))

    def describe(batches):
        book = Lexicon(terms)
        for rows, texts in T.text_blocks(batches, "__text"):
            values = [features((t or b"").decode("utf-8"), book) for t in texts]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(values, pa.list_(pa.float64()))], ["__id", "values"])

    terms = model.terms
    kind = documents.schema[id].dataType.simpleString()
    source = documents.select(F.col(f"`{id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    described = source.mapInArrow(describe, f"__id {kind}, values array<double>")
    judged = model.trees.transform(described.select("__id", array_to_vector("values").alias("features")))
    judged = judged.select("__id", margin().alias("margin"))
    if model.calibration is None:
        return judged.select(F.col("__id").alias(id), F.col("margin").alias("score"))
    return model.calibration.transform(judged).select(F.col("__id").alias(id), F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def judge_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score and predicted (score at or above the threshold) of every row.

    Learned from rows whose id is not held out; a null id is not, and has no label. Labels that are null are ignored, and
    repeated texts are learned once. With labels of one kind only every text scores 1 or 0 accordingly, and 0 without
    labels. Repeated rows are scored alike; an empty table gives an empty one. Other columns are not looked at.
    """
    scored = score(documents, train(documents, labels, **options))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
