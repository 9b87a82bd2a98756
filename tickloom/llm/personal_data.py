"""Personal data: patterns, and terms that give a protected value away.

Patterns find protected values (addresses, numbers). Corpus statistics then tell how strongly a term reveals a value
of the same document: with n documents (distinct texts), disclosure = PMI(term, value) / information(value), where
PMI = log2(n * together / (with term * with value)) and information = log2(n / with value). It is 1 where the term
never occurs without the value. Terms beyond a threshold are generalised, the strongest removed, at every place of every document.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import text as T
from tickloom.llm.session import shielded
from tickloom.session import stage

# Kinds in their order, the patterns' character classes, and their limits.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[TERM]", "remove": ""}

#: Distinct terms counted in a worker before their counts are passed on.
COUNTED_TERMS = 250_000
#: Bits of the filters that tell which texts and terms are to be looked at (2 MB); what passes by chance changes no result.
FILTER_BITS = 24
#: Terms are runs of at least two letters and their marks.
_TERMS = re.compile(T.runs("L", "M"))


def luhn(digits: str) -> bool:
    """Check digit of card numbers."""
    values = [int(d) for d in reversed(digits)]
    return (sum(values[0::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each domain with the longest local part before it; linear however long the text's words are."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        before = text[floor:at]
        local = len(before) - len(before.rstrip(LOCAL_PART))
        match = DOMAIN.match(text, at) if local else None
        floor = at + 1
        if match:
            found.append((at - local, match.end()))
            floor = match.end()
        at = text.find("@", floor)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches that pass their checks, by start and kind; code points."""
    found = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _hash(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode()) - (1 << 63)


def values_of(text: str, spans: list[tuple[str, int, int]]) -> set[int]:
    """Hashes of the spans' values, which are compared without case, spaces and marks."""
    return {_hash(kind + ":" + (text[s:e].lower() if kind == "email" else "".join(c for c in text[s:e] if c.isdigit() or c == "." and kind == "ip")))
            for kind, s, e in spans}


class TermHashes(dict):
    """Hash of each term in the form that all cases of it share, None for one letter, or if a filter is given and the hash is not in it.

    Forgets all of them when it holds T.CACHE_WORDS.
    """

    def __init__(self, bitmap: np.ndarray | None = None):
        self.bitmap = bitmap

    def __missing__(self, term: str) -> int | None:
        if len(self) >= T.CACHE_WORDS:
            self.clear()
        value = _hash(T.fold(term))
        known = len(term) > 1 and (self.bitmap is None or _in_filter(self.bitmap, value))
        value = self[term] = value if known else None
        return value

    def of(self, text: str) -> set[int]:
        """Hashes of the text's distinct terms, wherever they stand."""
        found = {self[w] for w in set(_TERMS.findall(text))}
        found.discard(None)
        return found

    def places(self, text: str) -> list[tuple[int, int, int]]:
        """(term, start, end) of every place outside the patterns' spans."""
        if not self.of(text):
            return []
        inside = sorted((s, e) for _, s, e in base_spans(text))
        found, k = [], 0
        for m in _TERMS.finditer(text):
            term = self[m.group()]
            while k < len(inside) and inside[k][1] <= m.start():
                k += 1
            if term is not None and not any(a < m.end() and m.start() < b for a, b in inside[k:k + len(KINDS) + 1]):
                found.append((term, m.start(), m.end()))
        return found


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_HASHES = pa.list_(pa.int64())


def copy_of(text: str) -> Column:
    """Equal for copies of one text, which are one piece of evidence however many there are."""
    return F.when(F.col(f"`{text}`").isNotNull(), F.xxhash64(F.col(f"`{text}`")))


def hash_filter(hashes: DataFrame, column: str):
    """A broadcast of FILTER_BITS bits, those of the column's hashes set; None if there is no hash."""
    bit = F.pmod(F.col(column), F.lit(1 << FILTER_BITS))
    words = hashes.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(bit % 64 AS INT)))").alias("bits")).collect()
    if not words:
        return None
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for row in words:
        bitmap[row["word"]] = row["bits"]
    return hashes.sparkSession.sparkContext.broadcast(bitmap)


def _in_filter(bitmap: np.ndarray, value: int) -> bool:
    bit = value & ((1 << FILTER_BITS) - 1)
    return bool(int(bitmap[bit >> 6]) >> (bit & 63) & 1)


def _key(id: str, text: str) -> Column:
    """Rows of one id and text are judged alike."""
    return F.xxhash64(F.col(f"`{id}`"), F.col(f"`{text}`"))


def scan(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """key, id, hash of the text, spans of the patterns, distinct values and, where there are any, distinct terms, for every row.

    A null text has none.
    """

    def run(batches):
        cache = TermHashes()
        for rows, texts in T.text_blocks(batches, "__text"):
            spans, values, terms = [], [], []
            for value in texts:
                whole = (value or b"").decode("utf-8")
                found = base_spans(whole)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                values.append(list(values_of(whole, found)))
                terms.append(list(cache.of(whole)) if found else [])
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(spans, _SPANS), pa.array(values, _HASHES), pa.array(terms, _HASHES)],
                                             ["key", "id", "copy", "base", "values", "terms"])

    kind = documents.schema[id].dataType.simpleString()
    source = documents.select(_key(id, text).alias("__key"), F.col(f"`{id}`").alias("__id"), copy_of(text).alias("__copy"),
                              F.col(f"`{text}`").alias("__text"))
    return source.mapInArrow(run, f"key bigint, id {kind}, copy bigint, base array<struct<kind:string,start:bigint,end:bigint>>, "
                             "values array<bigint>, terms array<bigint>")


def term_frequencies(documents: DataFrame, text: str = "text", wanted=None) -> DataFrame:
    """(term, documents): in how many distinct texts each term occurs, over all texts; of terms in the filter `wanted`, if given.

    Workers add up the counts of at most COUNTED_TERMS terms before passing them on. Texts that may be repeated
    pass on their terms one by one, each with the text's hash, and every pair counts once.
    """
    source = documents.filter(F.col(f"`{text}`").isNotNull()).select(copy_of(text).alias("__copy"), F.col(f"`{text}`").alias("__text"))
    repeated = hash_filter(source.groupBy("__copy").count().filter("count > 1"), "__copy")

    def run(batches):
        counts: Counter = Counter()
        pairs: set[tuple[int, int]] = set()
        cache = TermHashes(None if wanted is None else wanted.value)

        def batch():
            terms = [*counts, *(t for t, _ in pairs)]
            copies = pa.array([*[None] * len(counts), *(c for _, c in pairs)], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), copies, pa.array([*counts.values(), *[1] * len(pairs)], pa.int64())], ["term", "copy", "n"])

        for rows, texts in T.text_blocks(batches, "__text"):
            for copy, value in zip(rows.column(0).to_pylist(), texts):
                terms = cache.of(value.decode("utf-8"))
                if repeated is not None and _in_filter(repeated.value, copy):
                    pairs.update((t, copy) for t in terms)
                else:
                    counts.update(terms)
                if len(counts) + len(pairs) > COUNTED_TERMS:
                    yield batch()
                    counts.clear()
                    pairs.clear()
        yield batch()

    partial = source.mapInArrow(run, "term bigint, copy bigint, n bigint")
    once = partial.groupBy("term", "copy").agg(F.when(F.col("copy").isNull(), F.sum("n")).otherwise(1).alias("n"))
    return once.groupBy("term").agg(F.sum("n").alias("documents"))


def _disclosure(texts: int) -> Column:
    """Of a pair with together, with_value and documents."""
    information = F.log2(F.lit(float(texts)) / F.col("with_value"))
    return F.log2(F.lit(float(texts)) * F.col("together") / (F.col("documents") * F.col("with_value"))) / information


def pairs_together(scanned: DataFrame, texts: int, threshold: float, least_documents: int) -> DataFrame:
    """(value, term, with_value, together) of the pairs that stand in `least_documents` texts or more and may reach the threshold.

    A term stands in at least as many texts as those with any value hold it. Where that is too many already, as for
    common words, the pair is below the threshold whatever the other texts hold.

    Documents are distinct texts: copies add nothing to a pair, and take nothing from it. Values in fewer texts
    have no such pair and go before their terms are listed.
    """
    by_value = scanned.filter(F.size("values") > 0).dropDuplicates(["copy"]).select("copy", F.explode("values").alias("value"), "terms")
    values = by_value.groupBy("value").agg(F.count(F.lit(1)).alias("with_value")).filter(
        (F.col("with_value") >= least_documents) & (F.col("with_value") < texts))
    pairs = (by_value.join(values, "value").select("value", "with_value", F.explode("terms").alias("term"))
             .groupBy("value", "term", "with_value").agg(F.count(F.lit(1)).alias("together")).filter(F.col("together") >= least_documents))
    least = (scanned.filter(F.size("values") > 0).dropDuplicates(["copy"]).select(F.explode("terms").alias("term"))
             .groupBy("term").agg(F.count(F.lit(1)).alias("documents")))
    return pairs.join(least, "term").filter(_disclosure(texts) >= threshold).drop("documents")


def disclosing_terms(pairs: DataFrame, frequencies: DataFrame, texts: int, threshold: float) -> DataFrame:
    """(term, disclosure) of the terms that disclose a value at or above the threshold, with the highest of their values."""
    return (pairs.join(frequencies, "term").select("term", _disclosure(texts).alias("disclosure")).filter(F.col("disclosure") >= threshold)
            .groupBy("term").agg(F.max("disclosure").alias("disclosure")))


def term_places(documents: DataFrame, id: str, text: str, wanted) -> DataFrame:
    """(key, term, start, end) of every place, in all texts, of the terms in the filter `wanted`."""

    def run(batches):
        cache = TermHashes(wanted.value)
        for rows, texts in T.text_blocks(batches, "__text"):
            found = [(key, *place) for key, value in zip(rows.column(0).to_pylist(), texts) if value for place in cache.places(value.decode("utf-8"))]
            columns = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "term", "start", "end"])

    source = documents.select(_key(id, text).alias("__key"), F.col(f"`{text}`").alias("__text"))
    return source.mapInArrow(run, "key bigint, term bigint, start bigint, end bigint")


def find_personal_data(documents: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.9,
                       remove_at: float = 0.98, least_documents: int = 3) -> DataFrame:
    """id, base spans and added spans (kind, start, end, action, disclosure) for every row.

    Base spans come from the patterns; added ones are all places, in all documents, of terms that disclose a value of
    any document. A null or empty text has no spans; repeated rows get the same ones. Texts are read once for the
    patterns, and once each for the counts and the places of terms where there are any; they are never shuffled.
    """
    scanned = stage(scan(documents, id, text), "personal-data")
    texts = scanned.select(F.count_distinct("copy")).first()[0]
    pairs = stage(pairs_together(scanned, texts, threshold, least_documents), "term-pairs")
    none = F.array().cast("array<struct<start:bigint,end:bigint,action:string,disclosure:double>>")
    candidates = hash_filter(pairs, "term")
    strong = wanted = None
    if candidates is not None:
        strong = stage(disclosing_terms(pairs, term_frequencies(documents, text, candidates), texts, threshold), "strong-terms")
        wanted = hash_filter(strong, "term")
    if wanted is None:
        return scanned.select(F.col("id").alias(id), "base", none.alias("added"))
    action = F.when(F.col("disclosure") >= remove_at, "remove").otherwise("generalise")
    added = (term_places(documents, id, text, wanted).join(strong, "term").groupBy("key").agg(F.sort_array(F.collect_set(F.struct(
        "start", "end", action.alias("action"), F.round("disclosure", 6).alias("disclosure")))).alias("added")))
    return scanned.join(added, "key", "left").select(F.col("id").alias(id), "base", F.coalesce("added", none).alias("added"))


def _listed(spans: Column) -> Column:
    """Spans as kind:start:end by start, then kind in its order."""
    order = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(order, s["kind"]).alias("order"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data_digest(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, number of base spans of each kind, digest of the base spans and all spans as text, for every row."""
    found = find_personal_data(documents, id, text)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    added = F.transform("added", lambda s: F.struct(F.lit(TERM).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(f"`{id}`", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                        _listed(F.concat("base", added)).alias("spans"))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its placeholder; spans that overlap an earlier one are cut to the rest."""
    out, at = [], 0
    for start, end, mark in sorted(spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def sanitise(documents: DataFrame, id: str = "doc_id", text: str = "text", length: str | None = None, **options) -> DataFrame:
    """Every row and column, with the text's spans generalised or removed and `length` set to its new length.

    Base spans give way to the name of their kind, added terms to a mark or to nothing. Null texts stay null. The
    patterns run again on the text where it lies; only the few added spans are joined to it, by id and text.
    """
    documents, given = shielded(documents)
    key = F.xxhash64(F.col(f"`{id}`"), F.col(f"`{text}`"))
    found = find_personal_data(documents.select(key.alias("__key"), F.col(f"`{text}`").alias("text")), "__key", "text", **options)
    added = stage(found.filter(F.size("added") > 0).dropDuplicates(["__key"]).select(
        F.col("__key").alias("__k"), F.col("added").alias("__added")), "added-spans")  # its size is known when the join is planned
    names = documents.columns
    joined = documents.withColumn("__key", key).join(added, F.col("__key") == F.col("__k"), "left").select(
        *[F.col(f"`{c}`") for c in names], "__added")
    at = names.index(text)

    def run(batches):
        for rows, texts in T.text_blocks(batches, text):
            out = []
            for value, terms in zip(texts, rows.column(len(names)).to_pylist()):
                if value is not None:
                    whole = value.decode("utf-8")
                    spans = [(s, e, PLACEHOLDERS[k]) for k, s, e in base_spans(whole)]
                    spans += [(t["start"], t["end"], PLACEHOLDERS[t["action"]]) for t in terms or ()]
                    value = masked(whole, spans) if spans else whole
                out.append(value)
            columns = list(rows.columns[:len(names)])
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    clean = joined.mapInArrow(run, documents.schema)
    if length is None:
        return given(clean)
    kind = documents.schema[length].dataType
    return given(clean.withColumn(length, F.length(F.col(f"`{text}`")).cast(kind)).select(*[F.col(f"`{c}`") for c in names]))
