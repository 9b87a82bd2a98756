"""Merkle manifest of a table: bitmap ranks place the leaves, keyed slot arrays reduce the levels.

A group's ids are kept as compressed bitmaps, one for each range of 2^12 ids: tasks make partial ones, which are merged, and a
directory of counts says how many ids lie before each. The rank of an id, its leaf's slot, is that number and the ones below
it in its own bitmap; ids are never sorted. Slots are dealt into arrays of 2^LEVELS, and a whole array becomes one node of
the next array. So 10^12 leaves take four rounds, and no task holds more than one array at a time. Proofs go the same way
down: an array gets the siblings above it once and hands each slot its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.sequence import join_alike, running
from tickloom.session import stage

#: Levels of the tree that one slot array reduces.
LEVELS = 11
#: Ids of one bitmap: those that agree in all but their last 12 bits. Ranges are what work is dealt out by, so they are small.
RANGE_BITS = 12
LOW_BITS = (1 << RANGE_BITS) - 1
#: A bitmap of fewer ids is kept as their sorted low bits, two bytes each; a full one takes 512 bytes.
SPARSE = 1 << RANGE_BITS - 4
#: Pieces of the range of all ids in which the directory is summed up.
DIRECTORY_CHUNKS = 4096
#: Ids that a task gathers before it writes its partial bitmaps.
GATHERED = 1 << 20
#: Copies of one row that are numbered by one task.
COPIES = 8192

LEFT, RIGHT, ALONE = "<", ">", "="
NO_SIDES = {ord(c): None for c in LEFT + RIGHT + ALONE}


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of the columns, nulls and lengths told apart."""
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


# -- reducing one array ------------------------------------------------------------------------

def array_levels(nodes: list[str], levels: int | None) -> list[list[str]]:
    """The nodes and `levels` levels above them, or as many as it takes to a single node.

    Two consecutive nodes become the digest of both; a last one alone becomes its own.
    """
    out = [nodes]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        last = out[-1]
        out.append([digest("".join(last[k:k + 2])) for k in range(0, len(last), 2)])
    return out


def siblings(levels: list[list[str]], place: int) -> str:
    """Side and digest of the sibling on each level from a slot to its array's top."""
    path = []
    for nodes in levels[:-1]:
        other = place ^ 1
        path.append((LEFT if place & 1 else RIGHT) + nodes[other] if other < len(nodes) else ALONE)
        place >>= 1
    return "".join(path)


def proof_digest(path: str) -> str:
    """Digest of the siblings alone."""
    return digest(path.translate(NO_SIDES))


def fold(node: str, path: str) -> str:
    """The root that a leaf and its siblings give."""
    at = 0
    while at < len(path):
        side = path[at]
        if side == ALONE:
            node, at = digest(node), at + 1
        else:
            other = path[at + 1:at + 65]
            node, at = digest(other + node if side == LEFT else node + other), at + 65
    return node


# -- compressed bitmaps ------------------------------------------------------------------------

def compressed(low: np.ndarray) -> bytes:
    """Sorted distinct low bits, as they are or as a bitmap, whichever is shorter."""
    if len(low) < SPARSE:
        return low.astype("<u2").tobytes()
    bits = np.zeros(1 << RANGE_BITS, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def opened(data: bytes) -> np.ndarray:
    """The sorted numbers of a compressed bitmap."""
    if len(data) < 2 * SPARSE:
        return np.frombuffer(data, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))


def ranks(data: bytes, low: np.ndarray) -> np.ndarray:
    """How many numbers of the bitmap are smaller than each given one: a popcount directory of its words and one masked word."""
    if len(data) < 2 * SPARSE:
        return np.searchsorted(np.frombuffer(data, "<u2"), low)
    words = np.frombuffer(data, "<u8")
    counts = np.bitwise_count(words).astype(np.int64)
    directory = np.cumsum(counts) - counts
    low = low.astype(np.int64)
    word, bit = low >> 6, (low & 63).astype(np.uint64)
    below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
    return directory[word] + np.bitwise_count(below)


_BITMAP = "grp string, hi bigint, bits binary"
_BITMAP_NAMES = ["grp", "hi", "bits"]


def _partial_bitmaps(batches):
    """Bitmaps of the ids of one task, GATHERED ids at a time."""
    def write():
        out = []
        for group, parts in held.items():
            ids = np.unique(np.concatenate(parts))
            high = ids >> RANGE_BITS
            starts = np.flatnonzero(np.r_[True, high[1:] != high[:-1]])
            for a, b in zip(starts, np.append(starts[1:], len(ids))):
                out.append((group, int(high[a]), compressed((ids[a:b] & LOW_BITS).astype(np.uint16))))
        held.clear()
        for at in range(0, len(out), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*out[at:at + 1000]), (pa.string(), pa.int64(), pa.binary()))], _BITMAP_NAMES)

    held: dict[str | None, list[np.ndarray]] = {}
    gathered = 0
    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        groups = batch.column("grp").dictionary_encode()
        names, codes = groups.dictionary.to_pylist(), groups.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
            if len(part):
                held.setdefault(None if codes[part[0]] < 0 else names[codes[part[0]]], []).append(ids[part])
        gathered += len(ids)
        if gathered >= GATHERED:
            yield from write()
            gathered = 0
    yield from write()


def _merged_bitmaps(batches):
    """One bitmap per group and range from partial ones that come sorted; bitmaps of one range are or-ed as they pass."""
    key, bits = None, np.zeros(1 << RANGE_BITS, bool)
    out = []
    for batch in batches:
        for group, high, data in zip(*(batch.column(n).to_pylist() for n in _BITMAP_NAMES)):
            if key != (group, high):
                if key is not None:
                    low = np.flatnonzero(bits)
                    out.append((*key, compressed(low), len(low)))
                key = (group, high)
                bits[:] = False
            bits[opened(data)] = True
            if len(out) >= 500:
                yield _bitmap_rows(out)
                out = []
    if key is not None:
        low = np.flatnonzero(bits)
        out.append((*key, compressed(low), len(low)))
    yield _bitmap_rows(out)


def _bitmap_rows(rows):
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
        columns, (pa.string(), pa.int64(), pa.binary(), pa.int64()))], [*_BITMAP_NAMES, "ids"])


def bitmaps(keys: DataFrame) -> DataFrame:
    """(grp, hi, bits, ids) of the distinct pairs in `keys` (grp, id).

    A range of ids is merged in two steps, so that a range which every task has seen is not one task's work alone.
    """
    partial = keys.mapInArrow(_partial_bitmaps, _BITMAP)
    salted = partial.withColumn("salt", F.spark_partition_id() % 64)
    once = (salted.repartition("grp", "hi", "salt").sortWithinPartitions("grp", "hi", "salt").select(*_BITMAP_NAMES)
            .mapInArrow(_merged_bitmaps, _BITMAP + ", ids bigint").drop("ids"))
    return once.repartition("grp", "hi").sortWithinPartitions("grp", "hi").mapInArrow(_merged_bitmaps, _BITMAP + ", ids bigint")


def id_ranks(keys: DataFrame) -> DataFrame:
    """(grp, id, id_rank) of the distinct pairs: how many ids of the group are smaller.

    Bitmaps and the ids that look into them meet by group and range: the bitmap comes first, the ids in batches behind it.
    """
    maps = stage(bitmaps(keys), "bitmaps")
    ends = maps.agg(F.min("hi").alias("lo"), F.max("hi").alias("hi")).first()
    width = max(1, ((ends["hi"] or 0) - (ends["lo"] or 0)) // DIRECTORY_CHUNKS + 1)
    directory = running(maps.select("grp", "hi", "ids"), ["grp"], "hi", {"upto": F.col("ids")}, F.expr(f"hi div {width}"))
    offsets = directory.select("grp", "hi", (F.col("upto") - F.col("ids")).alias("before"))
    placed = maps.join(offsets, ["grp", "hi"])
    both = placed.select("grp", "hi", F.col("before").alias("id"), "bits").unionByName(
        keys.select("grp", F.shiftright("id", RANGE_BITS).alias("hi"), "id", F.lit(None).cast("binary").alias("bits")))
    # Of each range the row with the bitmap sorts first; the rest stay as they come.
    sorted_ = both.repartition("grp", "hi").sortWithinPartitions("grp", "hi", F.col("bits").isNull())

    def look_up(batches):
        data, before, key = b"", 0, None
        for batch in batches:
            groups, high = batch.column("grp").to_pylist(), batch.column("hi").to_numpy(zero_copy_only=False)
            ids, maps_ = batch.column("id").to_numpy(zero_copy_only=False), batch.column("bits")
            heads = np.flatnonzero(~maps_.is_null().to_numpy(zero_copy_only=False))
            out = np.zeros(len(ids), np.int64)
            for a, b in zip(np.r_[0, heads], np.r_[heads, len(ids)]):
                if a < b and maps_[int(a)].is_valid:
                    data, before, key = maps_[int(a)].as_py(), int(ids[a]), (groups[a], high[a])
                    a += 1
                if a < b:
                    assert key == (groups[a], high[a]), "every id was counted"
                    out[a:b] = before + ranks(data, ids[a:b] & LOW_BITS)
            rows = np.ones(len(ids), bool)
            rows[heads] = False
            kept = pa.array(np.flatnonzero(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("grp").take(kept), batch.column("id").take(kept), pa.array(out).take(kept)], ["grp", "id", "id_rank"])

    return sorted_.mapInArrow(look_up, "grp string, id bigint, id_rank bigint")


# -- slots -------------------------------------------------------------------------------------

def numbered_copies(df: DataFrame, first: str, copies: str, out: str) -> DataFrame:
    """Each row as often as `copies` says, numbered from `first`; the numbers are made COPIES at a time, dealt out in between."""
    blocks = df.withColumn("__at", F.explode(F.expr(f"sequence(0L, {copies} - 1, {COPIES}L)")))
    return blocks.repartition(F.col(first) + F.col("__at")).withColumn(out, F.explode(F.sequence(
        F.col(first) + F.col("__at"), F.col(first) + F.least(F.col("__at") + COPIES, F.col(copies)) - 1))).drop("__at", first, copies)


def leaf_slots(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rows` (grp, id, leaf, ...) with `slot`, from 0 in each group by id, without gaps; and (grp, total) of the groups.

    Null ids come first; rows of one id follow each other by leaf. Equal rows are counted before they move. What repeated
    ids add to the ranks behind them, and the order of the leaves of one id, are running sums over pieces of a range, so an id that
    a third of all rows carries stays spread. Where no id is repeated there is nothing to add.
    """
    counted = stage(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__copies")), "leaves")
    per_id = stage(counted.groupBy("grp", "id").agg(F.count(F.lit(1)).alias("__leaves"), F.sum("__copies").alias("__rows")), "ids")
    totals = stage(per_id.groupBy("grp").agg(F.sum("__rows").alias("total")), "totals")
    seen = per_id.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("__rows").alias("rows"), F.count_if(F.col("id").isNull()).alias("none")).first()
    ranked = join_alike(per_id, id_ranks(per_id.filter("id IS NOT NULL").select("grp", "id")), ["grp", "id"], "left")
    if (seen["rows"] or 0) <= 1 and not seen["none"]:
        return join_alike(counted.drop("__copies"), ranked.select("grp", "id", F.col("id_rank").alias("slot")), ["grp", "id"]), totals
    width = max(1, ((seen["hi"] or 0) - (seen["lo"] or 0)) // DIRECTORY_CHUNKS + 1)
    more = ranked.withColumn("__more", F.col("__rows") - F.when(F.col("id").isNull(), 0).otherwise(1))
    summed = running(more, ["grp"], "id", {"__upto": F.col("__more")}, F.expr(f"id div {width}"))
    placed = summed.select("grp", "id", "__leaves", F.when(F.col("id").isNull(), 0).otherwise(
        F.col("id_rank") + F.col("__upto") - F.col("__more")).alias("__start"))
    joined = stage(join_alike(counted, placed, ["grp", "id"]), "placed")
    several = running(joined.filter("__leaves > 1"), ["grp", "id"], "leaf", {"__upto": F.col("__copies")}, F.substring("leaf", 1, 3))
    numbered = joined.filter("__leaves = 1").withColumn("__first", F.col("__start")).unionByName(
        several.withColumn("__first", F.col("__start") + F.col("__upto") - F.col("__copies")).drop("__upto"))
    return numbered_copies(numbered.drop("__start", "__leaves"), "__first", "__copies", "slot"), totals


# -- levels ------------------------------------------------------------------------------------

def _grouped(table: pa.Table):
    """The table's rows by slot, and its digests."""
    order = np.argsort(table.column("slot").to_numpy(), kind="stable")
    ordered = table.take(pa.array(order))
    return ordered, ordered.column("node").to_pylist()


def _reduce(table: pa.Table, levels: int) -> pa.Table:
    """An array's top node. A group that is one array only goes up to a single node."""
    ordered, nodes = _grouped(table)
    total = ordered.column("total")[0].as_py()
    top = array_levels(nodes, None if total <= 1 << levels else levels)[-1][0]
    return pa.table({"grp": ordered.column("grp").slice(0, 1), "slot": ordered.column("array").slice(0, 1),
                     "total": pa.array([-(-total >> levels)], pa.int64()), "node": [top]})


def _paths(table: pa.Table, above: pa.Table, levels: int) -> tuple[pa.Table, list[str], list[str]]:
    """An array's rows by slot, their nodes, and each one's siblings: the array's own and those above it."""
    ordered, nodes = _grouped(table)
    own = array_levels(nodes, None if ordered.column("total")[0].as_py() <= 1 << levels else levels)
    rest = above.column("path")[0].as_py()
    return ordered, nodes, [siblings(own, k) + rest for k in range(len(nodes))]


def _with_paths(table: pa.Table, above: pa.Table, levels: int) -> pa.Table:
    ordered, _, paths = _paths(table, above, levels)
    return pa.table({"grp": ordered.column("grp"), "slot": ordered.column("slot"), "path": pa.array(paths, pa.string())})


def _arrays(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("array", F.shiftright("slot", levels))


def reduce_levels(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The given nodes (grp, slot, total, node), then those of each round, until every group is one node.

    Each round is a table in the shared folder with one row for each array of 2^levels slots.
    """
    rounds = [nodes]
    while True:
        done = rounds[-1].agg(F.max("total")).first()[0]
        if done is None or (done <= 1 and len(rounds) > 1):
            return rounds
        up = _arrays(rounds[-1], levels).groupBy("grp", "array").applyInArrow(
            lambda table: _reduce(table, levels), "grp string, slot bigint, total bigint, node string")
        rounds.append(stage(up, "nodes"))


def paths_down(rounds: list[DataFrame], top: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(grp, slot, path) for the nodes of the second round, from `top` (grp, slot, path) of the last one."""
    paths = top
    for nodes in reversed(rounds[1:-1]):
        paths = stage(_slot_paths(nodes, paths, levels), "paths")
    return paths


def _slot_paths(nodes: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    return _one_down(nodes, paths, levels, lambda table, above: _with_paths(table, above, levels), "grp string, slot bigint, path string")


def _one_down(nodes: DataFrame, paths: DataFrame, levels: int, function, schema: str) -> DataFrame:
    """`function(array, row with its path)` for each slot array; the path of an array is not copied to its slots before."""
    above = paths.withColumnRenamed("slot", "array").groupBy("grp", "array")
    return _arrays(nodes, levels).groupBy("grp", "array").cogroup(above).applyInArrow(function, schema)


def subroot_slots(subroots: DataFrame) -> DataFrame:
    """(grp, slot, total, node, name) with all groups in a row by name. Sums per first letters, so no task holds all."""
    marked = subroots.select(F.lit("").alias("all"), F.col("grp").alias("name"), "node")
    placed = running(marked, ["all"], "name", {"slot": F.lit(1)}, F.substring("name", 1, 3), {"total": "slot"})
    return placed.select(F.col("all").alias("grp"), (F.col("slot") - 1).cast("long").alias("slot"), F.col("total").cast("long"), "node", "name")


def manifest(df: DataFrame, id: str = "doc_id", group: str = "lang", columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
             tampered: tuple[Column, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Leaves are digests of `columns`; those of a group stand by id, groups by name, null first for both. Rows of one id follow
    each other by leaf, and repeated rows are leaves of their own. `tampered` is (which rows, leaf they have now):
    `folded_root` is what such a leaf and the original siblings give, `verified` whether that is the root. Other
    columns are not looked at; an empty table gives no row. A tree of one leaf has that leaf as root and no siblings.
    """
    which, now = tampered or (F.lit(False), F.lit(None).cast("string"))
    original = leaf([F.col(f"`{c}`") for c in columns])
    # A key that is never null and sorts as the names do, null first: every join and group on it is a plain one
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    rows = df.select(name.alias("grp"), F.col(f"`{id}`").cast("long").alias("id"), original.alias("leaf"),
                     F.when(which, now).alias("now"))
    slots, totals = leaf_slots(rows)
    # Written, so that rows which met by group alone are dealt out by group and array again
    leaves = stage(slots.select("grp", "slot", F.col("leaf").alias("node"), "id", "now").join(totals, "grp"), "slots")
    rounds = reduce_levels(leaves, levels)
    if len(rounds) == 1:
        return rows.select(F.col("id").alias(id), "leaf", *[F.lit(None).cast(t).alias(n) for n, t in _OUTPUTS[2:]])
    subroots = stage(subroot_slots(rounds[-1]), "subroots")
    upper = reduce_levels(subroots, levels)
    root = upper[-1].first()["node"]
    top = upper[-1].select("grp", "slot", F.lit("").alias("path"))
    per_group = _slot_paths(subroots, paths_down(upper, top, levels), levels)
    named = subroots.select("slot", F.col("name").alias("grp"), F.col("node").alias("subroot")).join(per_group.select("slot", "path"), "slot")
    named = stage(named.select("grp", F.lit(0).cast("long").alias("slot"), "path", "subroot"), "groups")
    arrays = paths_down(rounds, named.select("grp", "slot", "path"), levels)
    above = stage(arrays.join(named.select("grp", "subroot"), "grp"), "above")

    def prove(table: pa.Table, above: pa.Table) -> pa.Table:
        ordered, nodes, paths = _paths(table, above, levels)
        folded = [fold(node if now is None else now, path) for node, now, path in zip(nodes, ordered.column("now").to_pylist(), paths)]
        return pa.table({id: ordered.column("id"), "leaf": ordered.column("node"), "subroot": pa.array([above.column("subroot")[0].as_py()] * len(nodes)),
                         "root": [root] * len(nodes), "proof_sha256": list(map(proof_digest, paths)), "folded_root": folded,
                         "verified": [f == root for f in folded]})

    return _one_down(rounds[0], above, levels, prove, ", ".join(f"`{id if n == 'id' else n}` {t}" for n, t in _OUTPUTS))


_OUTPUTS = [("id", "bigint"), ("leaf", "string"), ("subroot", "string"), ("root", "string"), ("proof_sha256", "string"),
            ("folded_root", "string"), ("verified", "boolean")]


def documents_manifest(documents: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest of the documents, verified against a copy in which some documents have one character more in n_chars.

    Those are the ids whose checksum 7 divides; a null id is not tampered with, and a null n_chars stays null.
    """
    chosen = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0, F.lit(False))
    changed = leaf([F.col(c) if c != "n_chars" else F.col(c) + 1 for c in ("doc_id", "source", "lang", "n_chars", "text")])
    return manifest(documents, tampered=(chosen, changed), levels=levels)
