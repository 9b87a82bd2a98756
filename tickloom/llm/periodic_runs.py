"""Periodic runs of words, by uniting suffix classes in the order of falling LCP.

Suffixes whose longest common prefix is l words or more form a class; as l falls, classes unite as in Kruskal's algorithm.
Every class keeps its places in order. When a union makes places i < j neighbours and j - i <= l, the words from i to j + l
repeat with period j - i. The first place of a run and the place one period later become neighbours in exactly that way: they
meet at l = length - period, and a third place of their class between them would give the run a smaller period. So every run is
seeded once by its first place, with its length known, and its period is the smallest.

A run of 12 words or more has such an l of 6 or more, so places whose six words occur once in a text take no part.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import text as T

LEAST_LENGTH = 12
#: Words in common that the two ends of a run of LEAST_LENGTH have at least.
GRAM = LEAST_LENGTH // 2
#: Bytes of text worked on at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Places in one piece of an ordered set.
PIECE = 1024

Run = tuple[int, int, int]  # start, length, period


class Places:
    """An ordered set of numbers in sorted pieces, so that adding one moves PIECE numbers at most."""

    __slots__ = ("pieces", "tops", "size")

    def __init__(self, first: int):
        self.pieces, self.tops, self.size = [[first]], [first], 1

    def __iter__(self):
        for piece in self.pieces:
            yield from piece

    def add(self, value: int) -> tuple[int | None, int | None]:
        """Add a number that is not in the set; the numbers before and after it."""
        pieces, tops = self.pieces, self.tops
        k = min(bisect_left(tops, value), len(pieces) - 1)
        piece = pieces[k]
        at = bisect_left(piece, value)
        before = piece[at - 1] if at else pieces[k - 1][-1] if k else None
        after = piece[at] if at < len(piece) else None  # only the last piece can end before the number
        insort(piece, value)
        self.size += 1
        if len(piece) > 2 * PIECE:
            pieces[k:k + 1] = [piece[:PIECE], piece[PIECE:]]
            tops[k:k + 1] = [piece[PIECE - 1], piece[-1]]
        else:
            tops[k] = piece[-1]
        return before, after


def _shared_grams(ids: np.ndarray) -> np.ndarray:
    """Places whose GRAM words occur at another place too; chance hits of the hash only add places."""
    h = T.gram_hashes(T.mixed(ids.astype(T.U64)), GRAM)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    shared = np.zeros(len(h), bool)
    shared[order[1:]] = same
    shared[order[:-1]] |= same
    return np.flatnonzero(shared)


def _first_of_class(changes: np.ndarray) -> np.ndarray:
    """For sorted items and where a new class begins: the index of each item's class's first item."""
    return np.maximum.accumulate(np.where(changes, np.arange(len(changes)), 0))


def suffix_order(ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The places in the order of the suffixes that begin there, by doubling the compared length.

    A rank is the index of a class's first place, so a class that is a single place keeps its rank for good.
    """
    known = np.union1d(places, places + GRAM)  # ranks of what follows a shared gram are asked for as well
    known = known[known + GRAM <= len(ids)]
    order = np.lexsort([ids[known + k] for k in reversed(range(GRAM))])
    sorted_places = known[order]
    changes = np.ones(len(known), bool)
    if len(known) > 1:
        changes[1:] = np.any([ids[sorted_places[1:] + k] != ids[sorted_places[:-1] + k] for k in range(GRAM)], axis=0)
    rank = np.full(len(ids), -1, np.int64)
    rank[sorted_places] = _first_of_class(changes)
    length = GRAM
    while True:
        starts = np.flatnonzero(changes)
        sizes = np.diff(np.append(starts, len(known)))
        open_ = np.repeat(sizes > 1, sizes)
        if not open_.any():
            break
        at = np.flatnonzero(open_)
        members = sorted_places[at]
        following = rank[members + length]
        resorted = np.lexsort([following, rank[members]])
        members, following = members[resorted], following[resorted]
        sorted_places[at] = members
        old = rank[members]
        differs = np.ones(len(at), bool)
        differs[1:] = (old[1:] != old[:-1]) | (following[1:] != following[:-1])
        changes[at] = differs
        rank[sorted_places] = _first_of_class(changes)
        length *= 2
    return sorted_places


def common_prefixes(ids: list[int], order: list[int]) -> dict[int, tuple[int, int]]:
    """{place: (place before it in suffix order, number of words both begin with)}, places in text order."""
    before = dict(zip(order[1:], order[:-1]))
    found, shared, last = {}, 0, -2
    for i in sorted(before):
        j = before[i]
        shared -= i - last
        if shared < GRAM:  # below that the place this one is compared with may be another
            shared = 0
        while ids[i + shared] == ids[j + shared]:  # every text ends with a number of its own
            shared += 1
        found[i] = (j, shared)
        last = i
    return found


def seeds(ids: np.ndarray) -> list[Run]:
    """All runs of a sequence of word numbers in which 0 and the ends of texts occur once each."""
    places = _shared_grams(ids)
    if not len(places):
        return []
    words = ids.tolist()
    edges = [(shared, i, j) for i, (j, shared) in common_prefixes(words, suffix_order(ids, places).tolist()).items() if shared >= GRAM]
    edges.sort(reverse=True)
    parent: dict[int, int] = {}
    classes: dict[int, Places] = {}
    for _, i, j in edges:
        for place in (i, j):
            if place not in parent:
                parent[place] = place
                classes[place] = Places(place)

    def root(place: int) -> int:
        while parent[place] != place:
            parent[place] = place = parent[parent[place]]
        return place

    found: list[Run] = []

    def near(i: int, j: int, shared: int) -> None:
        """i and j now follow one another: a run begins at i if the words repeat twice and not from one word before."""
        if j - i <= shared and words[i - 1] != words[j - 1] and j - i + shared >= LEAST_LENGTH:
            found.append((i, j - i + shared, j - i))

    for shared, i, j in edges:
        a, b = root(i), root(j)
        if classes[a].size < classes[b].size:
            a, b = b, a
        large, small = classes[a], list(classes.pop(b))
        parent[b] = a
        for k, place in enumerate(small):
            # neighbours of the whole union only: one of each class, and no later place of the small class between them
            before, after = large.add(place)
            if before is not None and not (k and before == small[k - 1]):
                near(before, place, shared)
            if after is not None and not (k + 1 < len(small) and small[k + 1] < after):
                near(place, after, shared)
    return found


def planted(ids: np.ndarray, doc_id: int | None) -> np.ndarray:
    """Places of the words that a document has once its tail is made periodic, for one document in ten."""
    n = len(ids)
    places = np.arange(n)
    if n and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            places[a:] = a + (places[a:] - a) % p
    return places


def find_runs(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each list of words, by start and period. Texts are never compared with each other."""
    flat, starts = [0], []
    for words in texts:
        starts.append(len(flat))
        base = flat[-1] + 1
        numbers: dict[bytes, int] = {}
        flat += [base + numbers.setdefault(w, len(numbers)) for w in words]
        flat.append(base + len(numbers))
    flat += range(flat[-1] + 1, flat[-1] + 2 + GRAM)
    found: list[list[Run]] = [[] for _ in texts]
    bounds = np.array(starts, np.int64)
    for start, length, period in sorted(seeds(np.array(flat, np.int64)), key=lambda r: (r[0], r[2])):
        k = int(np.searchsorted(bounds, start, "right")) - 1
        found[k].append((start - starts[k], length, period))
    return found


def without_repeats(n: int, runs: list[Run]) -> np.ndarray:
    """For each of n words whether it stays: words of a run behind its first period go."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def _blocks(batches, names: list[str], plant: bool):
    """(rows, texts as lists of words, their runs) for a bounded number of bytes at a time."""
    for rows, texts in T.text_blocks(batches, names[1], BLOCK_BYTES):
        ids = rows.column(0).to_pylist()
        lists = []
        for id, value in zip(ids, texts):
            words = value.split() if value else []
            if plant:
                words = [words[k] for k in planted(words, id).tolist()]
            lists.append(words)
        yield rows, ids, lists, find_runs(lists)


def periodic_runs(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (id, start, length, period) per run of every text, in word numbers from 0.

    A run is a longest stretch of 12 words or more that repeats with its smallest period twice at least. Texts
    that are null, blank or without a run give no row; repeated rows give theirs each. Other columns are not looked at.
    """
    def run(batches):
        for rows, ids, _, runs in _blocks(batches, ["__id", "__text"], False):
            at = [k for k, found in enumerate(runs) for _ in found]
            parts = list(zip(*[r for found in runs for r in found])) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(at, pa.int64())), *[pa.array(p, pa.int64()) for p in parts]],
                ["__id", "start", "length", "period"])

    kind = documents.schema[id].dataType.simpleString()
    source = documents.select(F.col(f"`{id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    return source.mapInArrow(run, f"__id {kind}, start long, length long, period long").withColumnRenamed("__id", id)


def runs_digest(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Number of runs, the longest run and digests of all runs and of the words that stay, for each document.

    One document in ten, by checksum of its id, is looked at with a periodic tail. A null or blank text has no word and no
    run; a null id plants nothing. Of equally long runs the first by start, then period, is shown. Repeated rows are
    rows of their own; other columns are not looked at. No shuffle: a text is worked on where it is read.
    """
    def run(batches):
        for rows, _, lists, runs in _blocks(batches, ["__id", "__text"], True):
            best, digests, collapsed = [], [], []
            for words, found in zip(lists, runs):
                best.append(min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None))
                digests.append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest())
                if found:
                    words = [w for w, stays in zip(words, without_repeats(len(words), found).tolist()) if stays]
                collapsed.append(hashlib.sha256(b" ".join(words)).hexdigest())
            start, length, period = zip(*best) if best else ((), (), ())
            milli = [None if n is None else 1000 * n // p for n, p in zip(length, period)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *[pa.array(c, pa.int64()) for c in (list(map(len, runs)), start, length, period, milli)],
                 pa.array(digests, pa.string()), pa.array(collapsed, pa.string())], names)

    names = ["__id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    kind = documents.schema[id].dataType.simpleString()
    source = documents.select(F.col(f"`{id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    kinds = [kind, *["long"] * 5, "string", "string"]
    return source.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds))).withColumnRenamed("__id", id)
