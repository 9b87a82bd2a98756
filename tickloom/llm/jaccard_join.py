"""N-gram Jaccard join by prefix filtering under several global token orders.

Two sets that are similar enough share tokens among the first few of each, whatever the order of all tokens, and the
number of shared prefix tokens bounds the overlap. The first order puts tokens that many sets hold last and is evaluated
for all documents by one shuffle of prefix tokens. Pairs that pass are held against the prefixes under the other
orders, of which only the prefixes are sent. Whole sets are sent for pairs that pass under every order, and verified.

No bucket of a token is paired with itself: its members are first compared with one hub, and only those that are
not in the hub's component by then are compared with the rest, so that a group of near copies costs as many comparisons
as it has members while every link between different components is still looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tickloom.llm import text as T
from tickloom.llm.components import connected_components
from tickloom.llm.session import release, shielded
from tickloom.session import stage, staged

#: Bits of the cell of a token: how many sets hold a token is counted by cells, over all documents, in fixed space (a byte
#: per cell and task). The counts decide the order in which tokens are looked at and nothing else; any order gives the same links.
CELL_BITS = 20
#: Parts in which a task's counts are added up.
CELL_PARTS = 16
#: Tokens go last in the first order whose cell counts so many times the mean of all cells, and so many more.
FREQUENT_TIMES, FREQUENT_MORE = 2, 64
#: Pairs of different components are counted only if they meet at so many tokens, or at all that they have to share if that is fewer.
MEETINGS = 4
#: Seeds of the orders besides the first.
OTHER_ORDERS = (2, 3)
#: Bits of the filter that tells which rows are to be read again, and which sets are to be sent (2 MB).
FILTER_BITS = 24
#: Sets a task remembers so as not to send copies again.
REMEMBERED = 200_000


def prefix_length(size: int, percent: int) -> int:
    return size - -(-size * percent // 100) + 1


def shingle_set(text: bytes | None, words: int, cache: T.WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; all words as one shingle if there are fewer; empty without words."""
    tokens = T.token_hashes((text or b"").lower().split(), cache)
    return np.unique(T.gram_hashes(tokens, min(words, len(tokens)))) if len(tokens) else tokens


def set_key(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _sets(batches, words: int):
    """(rows, the rows' sets) block by block."""
    cache = T.WordHashes()
    for rows, texts in T.text_blocks(batches, "__text"):
        yield rows, [shingle_set(t, words, cache) for t in texts]


def _first_time(key: int, seen: set[int]) -> bool:
    if key in seen:
        return False
    if len(seen) >= REMEMBERED:
        seen.clear()
    seen.add(key)
    return True


def describe(source: DataFrame, kind: str, words: int) -> DataFrame:
    """(id, n, key) of every row, and rows (slice, part, cells) with a task's counts of its sets by cell of their tokens."""

    def run(batches):
        seen: set[int] = set()
        counts = np.zeros(1 << CELL_BITS, np.int64)
        task = TaskContext.get().partitionId()
        for rows, sets in _sets(batches, words):
            keys = [set_key(s) for s in sets]
            new = [s for s, k in zip(sets, keys) if len(s) and _first_time(k, seen)]
            if new:
                counts += np.bincount(cells_of(np.concatenate(new)), minlength=len(counts))
            empty = pa.nulls(len(keys), pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()),
                                              empty, empty, pa.nulls(len(keys), pa.binary())], columns)
        if seen:
            parts = np.minimum(counts, 255).astype(np.uint8).reshape(CELL_PARTS, -1)
            none = pa.nulls(CELL_PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays([
                none.cast(id_type), none, none, pa.array([task >> 10] * CELL_PARTS, pa.int64()), pa.array(range(CELL_PARTS), pa.int64()),
                pa.array([p.tobytes() for p in parts], pa.binary())], columns)

    columns = ["id", "n", "key", "slice", "part", "cells"]
    id_type = to_arrow_type(source.schema["__id"].dataType)
    return source.mapInArrow(run, f"id {kind}, n bigint, key bigint, slice bigint, part bigint, cells binary")


def cells_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _added(kind: type, out: type):
    """A function that adds up the cells of a group."""

    def run(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << CELL_BITS) // CELL_PARTS, np.uint64)
        for cells in table.column("cells"):
            total += np.frombuffer(cells.as_py(), kind)
        total = np.minimum(total, np.iinfo(out).max).astype(out)
        return pa.table({"part": table.column("part").slice(0, 1), "cells": pa.array([total.tobytes()], pa.binary())})

    return run


def frequent_cells(described: DataFrame) -> np.ndarray:
    """Which cells hold frequent tokens. Counts are added up in two levels of bounded groups; 4 MB reach the driver."""
    rows = described.filter(F.col("part").isNotNull()).select("slice", "part", "cells")
    sums = rows.groupBy("slice", "part").applyInArrow(_added(np.uint8, np.uint64), "part bigint, cells binary")
    counts = np.zeros((CELL_PARTS, (1 << CELL_BITS) // CELL_PARTS), np.int64)
    for row in sums.groupBy("part").applyInArrow(_added(np.uint64, np.uint32), "part bigint, cells binary").collect():
        counts[row["part"]] = np.frombuffer(row["cells"], np.uint32)
    return counts.reshape(-1) >= FREQUENT_TIMES * counts.mean() + FREQUENT_MORE


def prefix_tokens(source: DataFrame, words: int, percent: int, frequent) -> DataFrame:
    """(token, rank, key, place) of the prefixes under the first order: frequent tokens last, then by hash.

    place counts the set's tokens before the token; rank packs the number of tokens that are not frequent and the set's size: sets of frequent tokens only are
    the most common wording of their group and come first in a bucket.
    """

    def run(batches):
        last, seen = frequent.value, set()
        for _, sets in _sets(batches, words):
            tokens, ranks, keys = [], [], []
            for s in sets:
                if not len(s):
                    continue
                key = set_key(s)
                if not _first_time(key, seen):
                    continue
                marks = last[cells_of(s)]
                length = prefix_length(len(s), percent)
                own = s[~marks]
                first = own[:length] if len(own) >= length else np.concatenate([own, s[marks][:length - len(own)]])
                tokens.append(first)
                ranks.append(len(own) << 32 | len(s))
                keys.append(key)
            if tokens:
                lengths = [len(t) for t in tokens]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(ranks, np.int64), lengths)),
                    pa.array(np.repeat(np.array(keys, np.int64), lengths)),
                    pa.array(np.concatenate([np.arange(k) for k in lengths]))], ["token", "rank", "key", "place"])

    return source.mapInArrow(run, "token bigint, rank bigint, key bigint, place bigint")


def _shared(batches):
    """Of rows sorted by token, rank, key: those of tokens that two sets hold, each with its bucket's first set, the hub."""
    low = np.int64(0xFFFFFFFF)
    hub = last = None  # first row of the open bucket, last row seen
    open_sent = False
    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)])
        if last is not None:
            rows = rows[:, (rows != last[:, None]).any(0)]
            rows = np.concatenate([hub[:, None], rows], 1)
        if not rows.shape[1]:
            continue
        rows = rows[:, np.append(True, (rows[:, 1:] != rows[:, :-1]).any(0))]
        head = np.append(True, rows[0, 1:] != rows[0, :-1])
        start = np.flatnonzero(head)
        sizes = np.diff(np.append(start, rows.shape[1]))
        send = np.repeat(sizes > 1, sizes)
        if last is not None and open_sent:
            send[0] = False
        first = np.repeat(start, sizes)
        known = bool(last is not None and open_sent and len(start) == 1)
        hub, last = rows[:, start[-1]].copy(), rows[:, -1].copy()
        open_sent = known or bool(sizes[-1] > 1)
        if send.any():
            part, hubs = rows[:, send], rows[:, first[send]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                part[0], part[2], part[1] & low, part[3], hubs[2], hubs[1] & low)], ["token", "key", "n", "place", "hub", "hub_n"])


def buckets(tokens: DataFrame) -> DataFrame:
    """(token, key, n, place, hub, hub_n) of the tokens that at least two sets hold; streams over one shuffle, groups nothing."""
    ordered = tokens.repartition("token").sortWithinPartitions("token", "rank", "key")
    return ordered.mapInArrow(_shared, "token bigint, key bigint, n bigint, place bigint, hub bigint, hub_n bigint")


def least_overlap(a: str, b: str, percent: int) -> Column:
    """How many tokens two sets of the sizes a and b share at least if they are similar."""
    return F.expr(f"(({a} + {b}) * {percent} + {99 + percent}) div {100 + percent}")


def least_shared(a: str, b: str, percent: int) -> Column:
    """How many of them are in both prefixes: the set whose prefix ends first in the order misses all its prefix tokens that are not shared."""
    behind = F.greatest(*[F.expr(f"({n} * {percent} + 99) div 100") for n in (a, b)]) - 1
    return least_overlap(a, b, percent) - behind


def may_link(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, a_n, b_n, shared) whose sizes and number of shared prefix tokens allow the similarity."""
    return pairs.filter((F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)
                        & (F.col("shared") >= least_shared("a_n", "b_n", percent)))


def order_prefixes(tokens: np.ndarray, percent: int) -> bytes:
    """The set's prefixes under the other orders, each sorted, one after the other."""
    length, parts = prefix_length(len(tokens), percent), []
    for seed in OTHER_ORDERS:
        first = np.partition(T.mixed(tokens, seed), length - 1)[:length]
        parts.append(np.sort(first).tobytes())
    return b"".join(parts)


def may_overlap(a: bytes, b: bytes, a_n: int, b_n: int, percent: int) -> bool:
    """Whether the prefixes under every other order allow the similarity.

    Up to where the first of two prefixes ends all tokens of both sets are known; behind it no more can be
    shared than the shorter rest holds.
    """
    one, two = (np.frombuffer(x, np.uint64).reshape(len(OTHER_ORDERS), -1) for x in (a, b))
    for x, y in zip(one, two):
        end = min(x[-1], y[-1])
        x, y = x[:np.searchsorted(x, end, "right")], y[:np.searchsorted(y, end, "right")]
        shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
        possible = shared + min(a_n - len(x), b_n - len(y))
        if not shared or possible * (100 + percent) < percent * (a_n + b_n):
            return False
    return True


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _filter_of(numbers: DataFrame) -> Broadcast:
    """A filter of fixed size over the one column of whole numbers; more numbers than bits let more pass, never fewer."""
    (name,) = numbers.columns
    bits = numbers.select(F.pmod(F.col(name), F.lit(1 << FILTER_BITS)).alias("bit"))
    found = bits.groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit % 64 AS INT)))").alias("bits")).collect()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for row in found:
        bitmap[row["word"]] = row["bits"]
    return numbers.sparkSession.sparkContext.broadcast(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _passing(batches, column: str, bits: np.ndarray):
    for batch in batches:
        at = batch.column(column).to_numpy(zero_copy_only=False) % (1 << FILTER_BITS)
        kept = batch.filter(pa.array(bits[at].astype(bool)))
        if kept.num_rows:
            yield kept


def verified(pairs: DataFrame, source: DataFrame, holders: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, b, a_n, b_n) that are similar, in the shared folder.

    Of each set that a pair names one row is read again. Prefixes under the other orders meet first; whole sets are sent
    for pairs that pass under all of them. What a step no longer needs goes at once, and so do its shuffle files.
    """
    spark = source.sparkSession
    named = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    reread = _filter_of(holders.join(named, "key").select("row"))

    def read(batches):
        seen: set[int] = set()
        for _, sets in _sets(_passing(batches, "__row", reread.value), words):
            new = [(k, s) for k, s in ((set_key(s), s) for s in sets if len(s)) if _first_time(k, seen)]
            yield pa.RecordBatch.from_arrays([
                pa.array([k for k, _ in new], pa.int64()), pa.array([order_prefixes(s, percent) for _, s in new], pa.binary()),
                pa.array([s.tobytes() for _, s in new], pa.binary())], ["key", "orders", "tokens"])

    def intersect(batches):
        for batch in batches:
            a, b, a_n, b_n = (batch.column(k).to_pylist() for k in ("a_orders", "b_orders", "a_n", "b_n"))
            keep = [may_overlap(*row, percent) for row in zip(a, b, a_n, b_n)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def check(batches):
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in ("a_tokens", "b_tokens"))
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def with_both(left: DataFrame, sets: DataFrame, value: str) -> DataFrame:
        for side in ("a", "b"):
            one = sets.select(F.col("key").alias(side), F.col(value).alias(f"{side}_{value}")).dropDuplicates([side])
            left = left.join(one, side)
        return left

    numbered = source.withColumn("__row", F.xxhash64("__id"))
    made = numbered.mapInArrow(read, "key bigint, orders binary, tokens binary")
    with staged(made, "sets") as sets:
        release(spark)
        met = with_both(pairs.select("a", "b", "a_n", "b_n"), sets, "orders").mapInArrow(intersect, "a bigint, b bigint")
        with staged(met, "candidates") as candidates:
            release(spark)
            wanted = _filter_of(candidates.select(F.explode(F.array("a", "b")).alias("key")))
            sent = sets.select("key", "tokens").mapInArrow(lambda batches: _passing(batches, "key", wanted.value), "key bigint, tokens binary")
            links = stage(with_both(candidates, sent, "tokens").mapInArrow(check, "a bigint, b bigint"), "links")
    release(spark)
    return links


def hub_pairs(index: DataFrame) -> DataFrame:
    """Each set with the hubs of its buckets."""
    return (index.filter(F.col("key") != F.col("hub")).groupBy(F.col("key").alias("a"), F.col("hub").alias("b"))
            .agg(F.first("n").alias("a_n"), F.first("hub_n").alias("b_n"), F.count(F.lit(1)).alias("shared")))


def remaining_pairs(index: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket that lie in different components: the sets outside the hub's component with all others; in the shared folder.

    A pair is met at the first tokens that its sets share: all they share stands from the first of them on in both, so a bucket
    gives only pairs of which enough is left behind the token. What is rare in a near copy stands before the wording of its
    group, so sets too far from the group do not meet it. Texts that share a wording by chance meet at a token or two, and ever
    more of them do in a greater table; only of pairs that meet MEETINGS times the shared tokens are counted, which takes a row per token.
    """
    named = labels.withColumnsRenamed({"node": "key", "label": "found"})
    of_hub = labels.withColumnsRenamed({"node": "hub", "label": "hub_found"})
    placed = (index.join(named, "key", "left").join(of_hub, "hub", "left")
              .select("token", "key", "n", "place", F.coalesce("found", "key").alias("c"), F.coalesce("hub_found", "hub").alias("main")))
    with staged(placed, "bucket-rows") as rows:
        release(index.sparkSession)
        # A set's partners are at most one class of size away; the step is a little wider than the similarity asks for
        sized = rows.withColumn("size", F.floor(F.ln("n") / F.ln(F.lit(100.1 / percent))))
        outside = sized.filter(F.col("c") != F.col("main")).select(
            "token", F.col("key").alias("u"), F.col("n").alias("u_n"), F.col("place").alias("u_place"), F.col("c").alias("u_c"),
            F.explode(F.sequence(F.col("size") - 1, F.col("size") + 1)).alias("size"))
        near = (F.least("u_n", "n") * 100 >= F.greatest("u_n", "n") * percent)
        left = F.least(F.col("u_n") - F.col("u_place"), F.col("n") - F.col("place"))
        # Before its k-th shared token a pair shares k - 1; as many meetings as asked for below are made
        meetings = lambda a, b: F.least(F.lit(MEETINGS), least_shared(a, b, percent))
        enough = left + meetings("u_n", "n") - 1 >= least_overlap("u_n", "n", percent)
        met = outside.join(sized, ["token", "size"]).filter(
            (F.col("u_c") != F.col("c")) & ((F.col("c") == F.col("main")) | (F.col("u") < F.col("key"))) & near & enough)
        swap = F.col("u") > F.col("key")
        pairs = stage(met.groupBy(F.least("u", "key").alias("a"), F.greatest("u", "key").alias("b")).agg(
            F.first(F.when(swap, F.col("n")).otherwise(F.col("u_n"))).alias("a_n"),
            F.first(F.when(swap, F.col("u_n")).otherwise(F.col("n"))).alias("b_n"),
            F.count(F.lit(1)).alias("times")).filter(F.col("times") >= meetings("a_n", "b_n")), "met")
        release(index.sparkSession)
        one, other = (rows.select("token", F.col("key").alias(side)) for side in "ab")
        counted = stage(may_link(pairs.join(one, "a").join(other, ["b", "token"]).groupBy("a", "b").agg(
            F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"), F.count(F.lit(1)).alias("shared")), percent), "pairs")
    release(index.sparkSession)
    return counted


def similar_documents(documents: DataFrame, id: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """id, n_shingles and component_id for every row, by word shingles and Jaccard similarity of `percent` hundredths.

    component_id is the smallest id reachable by links, its own included. Null texts and texts without words have empty
    sets and are linked with nothing; texts with equal sets are always linked. Shingles are compared by 64-bit hashes.
    Repeated rows are one document; null ids are compared as documents but name a component only if it has no
    other id. Columns besides id and text are not looked at; an empty table gives an empty one.
    """
    spark = documents.sparkSession
    kind = documents.schema[id].dataType.simpleString()
    source = documents.select(F.col(f"`{id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    written = stage(describe(source, kind, words), "shingles")
    described = written.filter(F.col("part").isNull()).select("id", "n", "key")
    frequent = spark.sparkContext.broadcast(frequent_cells(written))
    holders = described.groupBy("key").agg(F.min(F.xxhash64("id")).alias("row"))
    tokens = prefix_tokens(source, words, percent, frequent)
    with staged(buckets(tokens), "buckets") as index:
        release(spark)
        with staged(may_link(hub_pairs(index), percent), "pairs") as pairs:
            release(spark)
            links = verified(pairs, source, holders, words, percent)
        labels = connected_components(links)
        rest = remaining_pairs(index, labels, percent)
    if not rest.isEmpty():
        labels = connected_components(links.union(verified(rest, source, holders, words, percent)))
    rows = described.select("id", "n", "key").join(labels.withColumnRenamed("node", "key"), "key", "left").select(
        "id", "n", F.when(F.col("n") > 0, F.coalesce("label", "key")).alias("label"))
    names = rows.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min("id").alias("smallest"))
    return rows.join(names, "label", "left").select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"),
        F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("smallest")).alias("component_id"))


def one_of_each_group(documents: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows, with all their columns, that stay when each component keeps its smallest id.

    Of rows that repeat an id one stays; rows without an id stay. Only the ids to be dropped are joined to the texts.
    """
    rows, given = shielded(documents)
    named = stage(similar_documents(rows.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")), "id", "text", words, percent), "groups")
    dropped = stage(named.filter(F.col("id") != F.col("component_id")).select(F.col("id").alias("__id")).distinct(), "dropped")
    repeated = stage(named.groupBy("id").count().filter((F.col("count") > 1) & F.col("id").isNotNull()).select(F.col("id").alias("__id")), "repeated")
    same = rows[id] == F.col("__id")
    kept = rows.join(dropped, same, "left_anti")
    if repeated.isEmpty():
        return given(kept)
    again = kept.join(repeated, kept[id] == F.col("__id"), "left_semi").dropDuplicates([id])
    return given(kept.join(repeated, kept[id] == F.col("__id"), "left_anti").union(again))
