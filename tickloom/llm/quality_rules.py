"""Quality rules: text statistics, and frequency of lines across the documents of a host.

Lines are normalised and hashed, the distinct documents of each line are counted per host, lines above
the limit are removed, and documents that lose too much are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.session import shielded

# What separates words, and the characters that count as symbols.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_in_repeated_windows(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in windows of `window` words that the text holds at least twice.

    Windows are compared by 64-bit hashes. Only a text with a repeated window sorts its windows: equal ones are then
    neighbours, and the words covered follow from the steps between their places.
    """
    size = F.size(words)

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(pairs, lambda p: _let(
            F.sort_array(F.transform(F.filter(p, lambda x, k: (
                (k > 0) & (F.get(p, k - 1)["h"] == x["h"])) | (F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)))),
                lambda x: x["i"])),
            lambda places: F.aggregate(places, F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n")), lambda s, at: F.struct(
                at.alias("last"), (s["n"] + F.least(F.lit(window), at - s["last"])).alias("n")))["n"]))

    def windows(hashed: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), size - window), lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(window)]))

    counted = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashed: _let(
        windows(hashed), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))))
    return F.when(size > window, counted).otherwise(F.lit(0).cast("long"))


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A null or empty text has zeros and fails. Input columns of these names are replaced.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    with_words = df.withColumns({
        "__words": F.filter(F.split(whole, SPACE + "+"), lambda w: w != ""),
        "__lines": F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    return with_words.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": (F.length(whole) - F.regexp_count(whole, F.lit(SPACE))).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": words_in_repeated_windows(F.col("__words")),
    }).drop("__words", "__lines").withColumn(
        "base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, white space and marks dropped: lines that differ only there are one line."""
    return F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), r"[^\p{L}\p{N}]+", "")


def distinct_lines(text: Column) -> Column:
    """The text's distinct normalised lines as structs of hash and length; empty for null."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: normalised(x))
    return F.transform(F.array_distinct(F.filter(lines, lambda x: x != "")),
                       lambda x: F.struct(F.xxhash64(x).alias("hash"), F.length(x).alias("chars")))


def frequent_lines(documents: DataFrame, host: str, text: str, max_documents: int, id: str = "doc_id", share: float = 0.0) -> DataFrame:
    """(__host, __line, documents) of lines that more than `max_documents` documents of a host hold, and more than `share` of them.

    A document is an id, however many rows repeat it; rows without an id are told apart by their text. A line is counted once per document,
    spread by host, line and document, so one that every document holds is many small groups before it is a count.
    """
    document = F.when(F.col(f"`{id}`").isNull(), F.xxhash64(F.col(f"`{text}`"))).otherwise(F.xxhash64(F.col(f"`{id}`")))
    held = documents.select(F.col(f"`{host}`").alias("__host"), document.alias("__document"), F.explode(F.transform(
        distinct_lines(F.col(f"`{text}`")), lambda x: x["hash"])).alias("__line")).distinct()
    counts = held.groupBy("__host", "__line").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") > max_documents)
    if not share:
        return counts
    sizes = documents.select(F.col(f"`{host}`").alias("__of"), document.alias("__document")).distinct().groupBy("__of").agg(
        F.count(F.lit(1)).alias("__all"))
    return counts.join(sizes, F.col("__host").eqNullSafe(F.col("__of"))).filter(
        F.col("documents") > share * F.col("__all")).select("__host", "__line", "documents")


def judge_documents(documents: DataFrame, id: str = "doc_id", host: str = "source", text: str = "text",
                    max_documents: int = 40, share: float = 0.002, least_kept: float = 0.3) -> DataFrame:
    """id, statistics, base_failed, line_chars, removed_chars and kept for every row.

    A line is removed where more than `max_documents` documents of its host, and more than `share` of them, hold it.
    `kept` is false where the base rules fail or less than `least_kept` of the characters in a document's
    distinct lines is left. Texts without a line fail the base rules. A null host is a host of its own; rows that
    repeat an id and text are judged alike, each in its own row. An empty table gives an empty table.
    """
    base = text_statistics(documents.select(
        F.col(f"`{id}`").alias("__id"), F.col(f"`{host}`").alias("__host"), F.col(f"`{text}`").alias("__text")), "__text")
    keyed = base.withColumn("__key", F.xxhash64("__text")).withColumn(
        "line_chars", F.aggregate(distinct_lines(F.col("__text")), F.lit(0).cast("long"), lambda n, x: n + x["chars"])).drop("__text", "__host")
    lines = documents.select(
        F.col(f"`{id}`").alias("i"), F.xxhash64(F.col(f"`{text}`")).alias("k"), F.col(f"`{host}`").alias("h"),
        F.explode(distinct_lines(F.col(f"`{text}`"))).alias("x"))
    frequent = frequent_lines(documents, host, text, max_documents, id, share)
    removed = (lines.join(frequent, F.col("h").eqNullSafe(F.col("__host")) & (F.col("x.hash") == F.col("__line")))
               .groupBy("i", "k").agg(F.collect_set("x").alias("set"))
               .select("i", "k", F.aggregate("set", F.lit(0).cast("long"), lambda n, x: n + x["chars"]).alias("removed")))
    joined = keyed.join(removed, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__key") == F.col("k")), "left")
    removed_chars = F.coalesce("removed", F.lit(0).cast("long"))
    return joined.select(
        F.col("__id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "line_chars", removed_chars.alias("removed_chars"),
        (~F.col("base_failed") & (F.col("line_chars") - removed_chars >= least_kept * F.col("line_chars"))).alias("kept"))


def without_frequent_lines(documents: DataFrame, host: str = "source", text: str = "text", max_documents: int = 40,
                           id: str = "doc_id", share: float = 0.0) -> DataFrame:
    """Every row and column, its frequent lines taken out of the text; a null text stays null.

    Lines are told apart by host and hash: an equi-join per line, then one row per document again in line order.
    """
    rows, given = shielded(documents)
    names = rows.columns
    frequent = frequent_lines(rows, host, text, max_documents, id, share)
    key = [F.col(f"`{c}`") for c in names]
    numbered = rows.select(*key, F.xxhash64(*key).alias("__row"), F.posexplode_outer(F.split(F.col(f"`{text}`"), "\n")).alias("__at", "__value"))
    kept = numbered.withColumn("__hash", F.xxhash64(normalised(F.col("__value")))).join(
        frequent.withColumnRenamed("__host", "__h"), F.col(f"`{host}`").eqNullSafe(F.col("__h")) & (F.col("__hash") == F.col("__line")), "left_anti")
    texts = kept.groupBy("__row").agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("__at", "__value"))), lambda x: x["__value"]), "\n").alias("__new"))
    return given(rows.withColumn("__key", F.xxhash64(*key)).join(texts, F.col("__key") == F.col("__row"), "left").select(*[
        F.when(F.col(f"`{text}`").isNotNull(), F.coalesce("__new", F.lit(""))).alias(c) if c == text else F.col(f"`{c}`") for c in names]))
