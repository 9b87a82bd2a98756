"""Language ID with string kernels: blended-spectrum n-gram presence, Nystroem landmarks, kernel ridge regression.

Two texts are compared by the n-grams of one to three characters that both hold, over the root of the product of
their numbers of n-grams. A few texts serve as landmarks; one ridge regression per language is fitted on the kernel
values against them. The kernel is linear in the presence vectors, so landmarks and coefficients fold into one
n-gram x language matrix, and scoring is a product of a batch of presence rows with it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm import text as T

UNDETERMINED = "und"
#: Hash buckets of the n-grams; 2^15 hold the n-grams of many alphabets with few collisions.
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Rows of presence vectors multiplied at once.
BATCH_ROWS = 64
#: Parts of a language in which the sample's ranks are taken first.
_PARTS = 64


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def presence(text: bytes | None, row: np.ndarray) -> bool:
    """Marks the buckets of the text's n-grams in `row`; False if it has no letter.

    Letters count in lower case, everything else as one kind of gap, also before and after the text.
    """
    if not text:
        return False
    points = np.frombuffer(text.decode("utf-8").lower().encode("utf-32-le"), np.uint32)
    known = _letters()[points]
    if not known.any():
        return False
    codes = np.zeros(len(points) + 2, np.uint32)
    codes[1:-1] = np.where(known, points, 0)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for n in ORDERS:
        h = np.full(len(codes) - n + 1, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ codes[k:k + len(h)]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        row[(h * np.uint32(0x85EBCA6B)) >> shift] = True
    return True


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    intercept: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Regression values, about 1 for the text's language and 0 for others."""
        size = np.sqrt(np.maximum(rows.sum(1), 1)).astype(np.float32)
        return rows.astype(np.float32) @ self.weights / size[:, None] + self.intercept


def fit(bits: np.ndarray, languages: list[str], landmarks: int = 128, ridge: float = 1e-3) -> Model:
    """One-versus-rest kernel ridge regression on the landmarks' kernel; landmarks alternate between languages.

    `bits` are packed presence vectors, unpacked a batch at a time.
    """
    names = sorted(set(languages))
    label = np.array([names.index(x) for x in languages])
    turn = np.empty(len(label), np.int64)
    for k in range(len(names)):
        turn[label == k] = np.arange((label == k).sum())
    chosen = np.lexsort((label, turn))[:landmarks]

    def normed(part: np.ndarray) -> np.ndarray:
        rows = np.unpackbits(part, axis=1)
        return rows.astype(np.float32) / np.sqrt(np.maximum(rows.sum(1), 1)).astype(np.float32)[:, None]

    basis = normed(bits[chosen])
    k_nm = np.concatenate([normed(bits[at:at + BATCH_ROWS]) @ basis.T for at in range(0, len(bits), BATCH_ROWS)]).astype(np.float64)
    k_mm = k_nm[chosen]
    target = np.eye(len(names))[label]
    # each language weighs the same, however many texts it has
    weight = (1.0 / np.bincount(label, minlength=len(names)) / len(names))[label]
    mean_k, mean_y = weight @ k_nm, weight @ target
    centred = (k_nm - mean_k) * weight[:, None]
    left = centred.T @ (k_nm - mean_k) + ridge * k_mm + 1e-9 * np.eye(len(chosen))
    alpha = np.linalg.solve(left, centred.T @ (target - mean_y))
    return Model(names, basis.T @ alpha.astype(np.float32), (mean_y - mean_k @ alpha).astype(np.float32))


def held_out(id: Column) -> Column:
    """Documents whose id's checksum leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_rows(documents: DataFrame, per_language: int, id: str, text: str, lang: str,
                  names: list[str] | None = None) -> tuple[np.ndarray, list[str]]:
    """Presence vectors, packed in the tasks, of at most `per_language` texts of each language, the first by hash.

    Ranks are taken on hashes alone, first inside parts of a language, so no task sees more than per_language rows of each
    part of one. The broadcast keys are at most `per_language` for each of the bounded number of languages; with `names`,
    only those languages are learned.
    """
    usable = documents.filter(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull() & ~held_out(F.col(f"`{id}`")))
    if names is not None:
        chosen = documents.sparkSession.createDataFrame([(n,) for n in names], "__name string")
        usable = usable.join(F.broadcast(chosen), F.col(f"`{lang}`") == F.col("__name"), "left_semi")
    keys = usable.select(F.col(f"`{lang}`").alias("lang"), F.xxhash64(f"`{text}`").alias("key")).distinct()
    part = F.pmod("key", F.lit(_PARTS))
    for by in (["lang", part], ["lang"]):
        order = Window.partitionBy(*by).orderBy(F.xxhash64("key"), "key")
        keys = keys.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_language).select("lang", "key")

    def pack(batches):
        for rows, texts in T.text_blocks(batches, "text"):
            bits, kept = [], []
            for k, value in enumerate(texts):
                row = np.zeros(BUCKETS, bool)
                if presence(value, row):
                    bits.append(np.packbits(row).tobytes())
                    kept.append(k)
            yield pa.RecordBatch.from_arrays([
                rows.column(0).take(pa.array(kept, pa.int64())), rows.column(1).take(pa.array(kept, pa.int64())),
                pa.array(bits, pa.binary())], ["lang", "key", "bits"])

    texts = usable.select(F.col(f"`{lang}`").alias("lang"), F.xxhash64(f"`{text}`").alias("key"), F.col(f"`{text}`").alias("text"))
    texts = texts.join(F.broadcast(keys), ["lang", "key"], "left_semi")
    packed = texts.mapInArrow(pack, "lang string, key bigint, bits binary").dropDuplicates(["lang", "key"])
    found = sorted(packed.collect(), key=lambda r: (r["lang"], r["key"]))
    bits = np.frombuffer(b"".join(r["bits"] for r in found), np.uint8).reshape(len(found), BUCKETS // 8)
    return bits, [r["lang"] for r in found]


def train(documents: DataFrame, per_language: int = 200, id: str = "doc_id", text: str = "text", lang: str = "lang",
          most_rows: int = 40_000, most_languages: int = 4_000) -> Model | None:
    """A model from the documents that are not held out; None without a labelled text.

    Fitted on a bounded sample of at most `most_rows` texts, 4 KB each on the driver: `per_language` texts of each language, the
    first by hash, or fewer where there are many languages. Beyond `most_languages` the ones with the most rows are learned.
    """
    known = documents.filter(F.col(f"`{lang}`").isNotNull()).groupBy(F.col(f"`{lang}`").alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    names = [r["lang"] for r in known.orderBy(F.desc("n"), "lang").limit(most_languages + 1).collect()]
    chosen = names[:most_languages] if len(names) > most_languages else None
    share = max(1, most_rows // max(1, min(len(names), most_languages)))
    bits, languages = training_rows(documents, min(per_language, share), id, text, lang, chosen)
    return fit(bits, languages) if len(bits) else None


def predict(documents: DataFrame, model: Model | None, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (),
            outputs: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `id` and `keep`, the predicted language and its score for every row; only the text is looked at.

    `keep` may name the text, which then passes through the tasks once.

    `und` with score 0 for a null text, one without a letter, or without a model. The score is the regression
    value of the best language, cut to 0..1; ties go to the first language by name.
    """
    names = [id, *keep]

    def run(batches):
        block = np.zeros((BATCH_ROWS, BUCKETS), bool)
        for rows, texts in T.text_blocks(batches, carried):
            labels, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            for start in range(0, len(texts), BATCH_ROWS):
                part = texts[start:start + BATCH_ROWS]
                block[:len(part)] = False
                usable = [k for k, value in enumerate(part) if model is not None and presence(value, block[k])]
                if usable:
                    values = model.scores(block[usable])
                    best = values.argmax(1)
                    for k, b, v in zip(usable, best, values[np.arange(len(best)), best]):
                        labels[start + k] = model.languages[b]
                        scores[start + k] = min(1.0, max(0.0, float(v)))
            yield pa.RecordBatch.from_arrays([*rows.columns[:len(names)], pa.array(labels), pa.array(scores)],
                                             [*names, *outputs])

    carried = text if text in names else "__text"
    source = documents.select(*[F.col(f"`{c}`") for c in names], *[F.col(f"`{text}`").alias(carried) for _ in range(carried not in names)])
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in names)
    return source.mapInArrow(run, f"{kinds}, {outputs[0]} string, {outputs[1]} double")


def identify(documents: DataFrame, per_language: int = 200, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the documents that are not held out and predict all; id, held_out, lang_pred, score.

    Rows with a null language are predicted but not learned from; repeated rows count once in training. An
    empty table gives an empty one.
    """
    model = train(documents, per_language, id, text, lang)
    return predict(documents, model, id, text).select(f"`{id}`", held_out(F.col(f"`{id}`")).alias("held_out"), "lang_pred", "score")
