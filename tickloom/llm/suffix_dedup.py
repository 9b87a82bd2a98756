"""Removal of long repeated byte strings with a family of sorted suffix tables.

A suffix table holds the suffixes that begin at content-defined places: of every window of WINDOW bytes the place with the
lowest hash of GRAM bytes. Two equal windows have theirs at the same offset, so no match of WINDOW bytes is missed
although one suffix in about forty is kept. Tables are sorted; a new batch is merge-scanned with the tables of earlier
batches, its first occurrences become a table, and tables of equal size merge into one of twice the size.

A suffix stands for the run of windows that have their lowest place there, and its context hash covers the
bytes of the whole run. A context seen before makes all windows of the run repeats. Where only the suffix was seen
before, an edge of a match lies inside the run, and its windows are compared one by one.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import text as T
from tickloom.llm.session import release
from tickloom.session import stage, write_stage
from tickloom.sources.folders import remove

WINDOW = 100
GRAM = 40
#: Bits of the filter that tells which texts have something to look at (2 MB); the others are not shuffled.
FILTER_BITS = 24
#: Bytes of text hashed at once: each byte takes about a hundred bytes of arrays.
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 28) - 1)
# a place in one 64-bit number: start, length of the run of windows less one, tag of the text
_START, _RUN, _TAG = 33, 26, (1 << 26) - 1


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, 2^bits of each."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.ones(1, np.uint64)
        for k in range(bits):
            powers = np.concatenate([powers, powers * np.uint64(pow(base, 1 << k, 1 << 64))])
        out.append(powers)
    return out[0], out[1]


class Block:
    """Texts one after the other, with hashes of any of their substrings."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begins = np.cumsum(self.sizes) - self.sizes
        data = np.frombuffer(b"".join(texts), np.uint8)
        up, self.down = _powers(max(12, len(data).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, length) -> np.ndarray:
        """Hash of the `length` bytes from each start, the same wherever they stand."""
        return T.mixed((self.sums[starts + length] - self.sums[starts]) * self.down[starts])

    def suffixes(self) -> tuple[np.ndarray, ...]:
        """(text, first window, last window, suffix hash, context hash) of every suffix kept; windows by their starts."""
        total = len(self.sums) - 1
        if total < WINDOW:
            return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        grams = self.hashes(np.arange(total - GRAM + 1), GRAM)
        low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        width, span = 1, WINDOW - GRAM + 1
        while width < span:
            step = min(width, span - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        places = (low & _PLACE).astype(np.int64)
        owner = np.repeat(np.arange(len(self.sizes)), np.maximum(self.sizes - WINDOW + 1, 0))
        inside = np.arange(len(owner)) - np.repeat(*_counts(np.maximum(self.sizes - WINDOW + 1, 0)))
        windows = self.begins[owner] + inside
        places = places[windows]
        new = np.flatnonzero(np.append(True, (np.diff(places) != 0) | (np.diff(owner) != 0))) if len(places) else np.empty(0, np.int64)
        first = windows[new]
        last = windows[np.append(new[1:], len(windows)) - 1] if len(new) else first
        place, own = places[new], owner[new]
        context = self.hashes(first, last - first + WINDOW) ^ T.mixed(((place - first) << 8 | (last - first)).astype(np.uint64), 1)
        return own, first - self.begins[own], last - self.begins[own], grams[place], context


def _counts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(sizes) - sizes, sizes


def _source(documents: DataFrame, id: str, text: str) -> DataFrame:
    """doc (null as the smallest number), tag of the text, text; texts of one id differ by their tag."""
    return documents.select(F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(-(1 << 63))).alias("doc"),
                            F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).bitwiseAND(F.lit(_TAG)).alias("tag"),
                            F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


_TABLE = "suffix bigint, context bigint, doc bigint, place bigint"
_COLUMNS = ["suffix", "context", "doc", "place"]
_MARKED = _TABLE + ", kind tinyint"
#: Smallest id, and one above all that can stand in a table.
_LEAST, _NONE = -(1 << 63), (1 << 63) - 1


def suffix_table(source: DataFrame) -> DataFrame:
    """(suffix, context, doc, place, known) of all texts; known rows repeat a context of their own block of texts.

    What a later copy inside a block is, needs no other row to tell: it is known here and only the block's first goes on.
    """

    def run(batches):
        for rows, texts in T.text_blocks(batches, "text", BLOCK_BYTES):
            doc, tag = (rows.column(k).to_numpy() for k in (0, 1))
            own, first, last, suffix, context = Block(texts).suffixes()
            columns = [suffix.view(np.int64), context.view(np.int64), doc[own], first << _START | (last - first) << _RUN | tag[own]]
            order = np.lexsort(columns[::-1])
            columns = [c[order] for c in columns]
            differs = [np.append(np.ones(min(len(c), 1), bool), c[1:] != c[:-1]) for c in columns]
            new = differs[0] | differs[1]
            fresh = new | differs[2] | differs[3]  # repeated rows of a table are one
            yield pa.RecordBatch.from_arrays([*(pa.array(c[fresh]) for c in columns), pa.array(~new[fresh])], [*_COLUMNS, "known"])

    return source.mapInArrow(run, _TABLE + ", known boolean")


def _scan(batches, floor: int, earliest: int):
    """Over rows sorted by suffix, context, doc, place: (row, kind), kind 0 for the first of a context, 1 for a later one, and 2,
    beside 0, for the first of a context whose suffix has other contexts too. Firsts below the id `floor` are left out; rows of
    kind 1 and 2 are places only, without hashes. Ids below `earliest` belong to earlier batches: a suffix all of whose firsts do
    has been told before and gives no rows of kind 2 (it may where its rows reach into another batch of the stream)."""
    before = head = None  # last row; the first row of the open suffix, until it is known whether it has other contexts
    several = False

    def marked(firsts, later, edges):
        places = np.concatenate([x[2:] for x in (firsts, *later, *edges)], 1)
        counts = [firsts.shape[1], sum(x.shape[1] for x in later), sum(x.shape[1] for x in edges)]
        hashes = [pa.concat_arrays([pa.array(x), pa.nulls(counts[1] + counts[2], pa.int64())]) for x in firsts[:2]]
        return pa.RecordBatch.from_arrays([*hashes, *(pa.array(x) for x in places), pa.array(np.repeat(np.arange(3, dtype=np.int8), counts))],
                                          [*_COLUMNS, "kind"])

    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy() for k in range(4)])
        known = batch.column(4).to_numpy(zero_copy_only=False)
        if known.any():
            yield marked(rows[:, :0], [rows[:, known]], [])
            rows = rows[:, ~known]
        if not rows.shape[1]:
            continue
        if before is not None:
            rows = np.concatenate([before[:, None], rows], 1)
        differs = rows[:, 1:] != rows[:, :-1]
        new_suffix, new_context = differs[0], differs[0] | differs[1]
        fresh = differs.any(0)  # repeated rows of a table are one
        if before is None:
            new_suffix, new_context, fresh = (np.append(True, x) for x in (new_suffix, new_context, fresh))
        else:
            rows = rows[:, 1:]
        if not rows.shape[1]:
            continue
        before = rows[:, -1].copy()
        later = fresh & ~new_context
        others = new_context & ~new_suffix  # a further context of the same suffix
        heads = np.flatnonzero(new_suffix)
        group = np.cumsum(new_suffix) - 1  # -1: the suffix that was open before this batch
        with_others = np.bincount(group[others] + 1, minlength=len(heads) + 1) > 0
        now = np.bincount(group[new_context & (rows[2] >= earliest)] + 1, minlength=len(heads) + 1) > 0
        now[0] = now[-1] = True  # the open ones
        edges = [rows[:, others & now[group + 1]], rows[:, heads[(with_others & now)[1:]]]]
        if head is not None and with_others[0] and not several:
            edges.append(head[:, None])
        if len(heads):
            head, several = rows[:, heads[-1]].copy(), bool(with_others[-1])
        else:
            several = several or bool(with_others[0])
        yield marked(rows[:, new_context & (rows[2] >= floor)], [rows[:, later]], edges)


def merge_scan(tables: list[DataFrame], floor: int = _LEAST, earliest: int = _LEAST) -> DataFrame:
    """Rows of the tables with their kind (see `_scan`); one shuffle by suffix, and groups are streamed, not gathered.

    Known rows pass through it, dealt out by their place: a passage that fills the table is then a row of each block. They are
    sorted along with the others, as the sort compares the numbers of its first column before it looks into any row.
    """
    rows = tables[0]
    for other in tables[1:]:
        rows = rows.union(other.select(*_COLUMNS, F.lit(False).alias("known")))
    dealt = F.when(F.col("known"), F.xxhash64("doc", "place")).otherwise(F.col("suffix"))
    ordered = rows.repartition(dealt).sortWithinPartitions(*_COLUMNS)
    return ordered.mapInArrow(lambda batches: _scan(batches, floor, earliest), _MARKED)


def _first_or_later(batches):
    """Over rows sorted by window, doc, place: those with an equal window before them."""
    before = None
    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy() for k in range(3)])
        if before is not None:
            rows = np.concatenate([before[:, None], rows], 1)
        if rows.shape[1]:
            before = rows[:, -1].copy()
            keep = np.flatnonzero((rows[0, 1:] == rows[0, :-1]) & (rows[1:, 1:] != rows[1:, :-1]).any(0)) + 1
            yield pa.RecordBatch.from_arrays([pa.array(rows[1, keep]), pa.array(rows[2, keep])], ["doc", "place"])


def _key(doc: Column, tag: Column) -> Column:
    return F.pmod(F.xxhash64(doc, tag), F.lit(1 << FILTER_BITS))


def _filter(places: DataFrame):
    """A bitmap of the texts that the places lie in, built by an aggregate of bounded size."""
    bits = _key(F.col("doc"), F.col("place").bitwiseAND(F.lit(_TAG)))
    words = places.select(bits.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(bit % 64 AS INT)))").alias("bits")).collect()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for row in words:
        bitmap[row["word"]] = row["bits"]
    return places.sparkSession.sparkContext.broadcast(np.unpackbits(bitmap.view(np.uint8), bitorder="little").astype(bool))


def _may_have(source: DataFrame, places: DataFrame, wanted: bool) -> DataFrame:
    """Texts the bitmap names, or all others; a name without a place costs a look, nothing else."""
    shared = _filter(places)

    def run(batches):
        for batch in batches:
            mask = shared.value[batch.column(3).to_numpy()]
            yield batch.filter(pa.array(mask == wanted))

    return source.withColumn("key", _key(F.col("doc"), F.col("tag"))).mapInArrow(
        run, "doc bigint, tag bigint, text string, key bigint").drop("key")


def _with_places(source: DataFrame, places: DataFrame) -> DataFrame:
    """doc, tag, text and the text's places, for the texts that have any."""
    lists = places.groupBy("doc", F.col("place").bitwiseAND(F.lit(_TAG)).alias("tag")).agg(F.collect_list("place").alias("places"))
    return _may_have(source, places, True).join(lists, ["doc", "tag"], "left")


def single_windows(source: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc, place) of the windows, among the runs at edges of matches, that stand somewhere before."""

    def run(batches):
        for rows, texts in T.text_blocks(batches, "text", BLOCK_BYTES):
            doc, tag, block = rows.column(0).to_numpy(), rows.column(1).to_numpy(), Block(texts)
            lists = rows.column(3).to_pylist()
            own = np.repeat(np.arange(len(texts)), [len(x or ()) for x in lists])
            places = np.fromiter((p for x in lists for p in x or ()), np.int64, len(own))
            lengths = (places >> _RUN & 127) + 1
            starts = np.repeat((places >> _START) - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            text = np.repeat(own, lengths)
            windows = block.hashes(block.begins[text] + starts, WINDOW) if len(starts) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(windows.view(np.int64)), pa.array(doc[text]), pa.array(starts << _START | tag[text])],
                                             ["window", "doc", "place"])

    found = _with_places(source, edges).mapInArrow(run, "window bigint, doc bigint, place bigint")
    return found.repartition("window").sortWithinPartitions("window", "doc", "place").mapInArrow(_first_or_later, "doc bigint, place bigint")


class SuffixIndex:
    """The tables of the batches seen so far, at most one of each size class, each in a folder of its own.

    A folder holds what the scan of its last batch wrote: the firsts of all batches that its size class stands for.
    """

    def __init__(self):
        self.levels: list[tuple[int, str]] = []
        self.earliest: dict[str, int] = {}

    def _read(self, spark: SparkSession, path: str) -> DataFrame:
        return spark.read.schema(_MARKED).parquet(path).filter("kind = 0").select(*_COLUMNS)

    def add(self, batch: DataFrame, texts: DataFrame, more: bool = True) -> DataFrame:
        """(doc, place) of the repeated windows of a batch whose ids are greater than those before it, in the shared folder.

        `batch` and `texts` are frames of `_source`; `texts` holds the batch and all earlier ones, for the edges of matches.
        The batch's own table is kept only if `more` batches are to come, and no table behind the last. Tables of equal size
        are merged by the scan itself: it meets their rows anyway, and as their ids are the last ones, all firsts from the
        earliest of them on are written.
        """
        spark = batch.sparkSession
        earliest = batch.agg(F.coalesce(F.min("doc"), F.lit(_NONE))).first()[0] if self.levels else _LEAST
        size, merged = 0, []
        for k, path in sorted(self.levels):
            if k == size:
                merged.append(path)
                size += 1
        floor = min([earliest, *(self.earliest[path] for path in merged)]) if more else _NONE
        rows = merge_scan([suffix_table(batch), *(self._read(spark, path) for _, path in self.levels)], floor, earliest)
        scanned = write_stage(rows, "suffixes", **{"parquet.enable.dictionary": "false"})  # hashes and places do not repeat
        if not more:
            for _, path in self.levels:
                remove(spark, path)
            self.levels, merged = [], [scanned]
        release(spark)
        marks = spark.read.schema(_MARKED).parquet(scanned).select("doc", "place", "kind")
        later, edges = (marks.filter(f"kind = {k}").select("doc", "place") for k in (1, 2))
        found = stage(later.union(single_windows(texts, edges).filter(F.col("doc") >= F.lit(earliest))), "places")
        if more:
            self.levels = [(k, path) for k, path in self.levels if path not in merged] + [(size, scanned)]
            self.earliest[scanned] = floor
        for path in merged:
            remove(spark, path)
        release(spark)
        return found


def repeated_places(documents: DataFrame, id: str = "doc_id", text: str = "text", batches: int = 1) -> DataFrame:
    """(doc, place) of all windows that stand earlier: in a smaller id, or before in the same text.

    With several batches the table is taken in ranges of ids, as if they arrived one after the other.
    """
    source, index = _source(documents, id, text), SuffixIndex()
    if batches == 1:
        return index.add(source, source, more=False)
    cuts = source.approxQuantile("doc", [k / batches for k in range(1, batches)], 0.001)
    bounds = [None, *[int(c) for c in sorted(set(cuts))], None]
    found = None
    for low, high in zip(bounds[:-1], bounds[1:]):
        upto = source.filter(F.col("doc") < high) if high is not None else source
        batch = upto.filter(F.col("doc") >= low) if low is not None else upto
        places = index.add(batch, upto, more=high is not None)
        found = places if found is None else found.union(places)
    return found


def removed_bytes(size: int, places: np.ndarray) -> np.ndarray:
    """Mask of the bytes that the repeated windows cover."""
    edges = np.zeros(size + 1, np.int64)
    starts = places >> _START
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + (places >> _RUN & 127) + WINDOW, size), -1)
    return np.cumsum(edges[:-1]) > 0


def remove_repeats(documents: DataFrame, id: str = "doc_id", text: str = "text", batches: int = 1) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (the remaining bytes) for every row.

    Every byte of a WINDOW-byte string that starts earlier too is removed; strings are judged on the input. Null and
    empty texts have no bytes, texts shorter than WINDOW keep all. Repeated rows are the same places, so they do not
    remove each other; texts of one id are ordered by start. Null ids come first. Strings are compared by
    64-bit hashes. Texts without a repeat are not shuffled.
    """
    kind = documents.schema[id].dataType.simpleString()
    source = _source(documents, id, text)
    places = repeated_places(documents, id, text, batches)

    def run(batches):
        for rows, texts in T.text_blocks(batches, "text", BLOCK_BYTES):
            lists = rows.column(3).to_pylist() if rows.num_columns > 3 else [None] * len(texts)
            masks = [removed_bytes(len(t), np.array(p, np.int64)) if p else None for t, p in zip(texts, lists)]
            counts = [int(m.sum()) if m is not None else 0 for m in masks]
            spans = [int(m[0]) + int((np.diff(m.view(np.int8)) == 1).sum()) if m is not None else 0 for m in masks]
            kept = [np.frombuffer(t, np.uint8)[~m].tobytes() if m is not None else t for t, m in zip(texts, masks)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64()),
                                              pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    result = _with_places(source, places).mapInArrow(run, schema).union(_may_have(source, places, False).mapInArrow(run, schema))
    return result.select(F.when(F.col("doc") != -(1 << 63), F.col("doc")).cast(kind).alias(id), "n_bytes", "n_removed", "n_spans", "kept")


def repeats_digest(documents: DataFrame, id: str = "doc_id", text: str = "text", batches: int = 1) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes."""
    return remove_repeats(documents, id, text, batches).select(f"`{id}`", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
