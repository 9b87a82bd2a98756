"""Benchmark decontamination by greedy string tiling.

Seeds are runs of words that a document and a benchmark item share, found by rolling hashes. From them the longest
matches are marked again and again, none overlapping a marked one, in whatever order the passages
stand. The share of the item's words under tiles tells whether the document holds the item.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import text as T
from tickloom.llm.session import shielded

#: Words of the shortest tile.
SEED_WORDS = 5
#: Bytes of item text in one broadcast; a larger benchmark is taken block by block.
BLOCK_BYTES = 32 << 20
_FILTER_BITS = 20
#: The same for ASCII, byte by byte: letters in lower case, all others but digits as space.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
#: Words are runs of letters, their marks and digits.
_WORDS = re.compile(T.runs("L", "M", "N"))


def plain_words(text: bytes | None) -> list[bytes]:
    """Words in one form: case, punctuation and ways of writing a character do not hide a passage, in any script."""
    text = text or b""
    if text.isascii():
        return text.translate(_PLAIN).split()
    return [w.encode() for w in _WORDS.findall(T.fold(text.decode("utf-8")))]


#: Matches of a text and the items that are held against each other at once.
PAIRS = 1 << 20
#: Base of the running hashes and its inverse modulo 2^64, and what stands for the word before a text and before an item.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BEFORE_TEXT, _BEFORE_ITEM = np.uint64(1), np.uint64(2)


class Running:
    """Karp-Rabin hashes of all stretches of a sequence of words, from one running sum."""

    def __init__(self, tokens: np.ndarray):
        powers = np.full(len(tokens) + 1, _BASE, np.uint64)
        back = np.full(len(tokens) + 1, _INVERSE, np.uint64)
        powers[0] = back[0] = 1
        self.back = np.cumprod(back, dtype=np.uint64)
        self.sums = np.append(np.uint64(0), np.cumsum(tokens * np.cumprod(powers, dtype=np.uint64)[:-1], dtype=np.uint64))

    def of(self, at: np.ndarray, n: int) -> np.ndarray:
        return (self.sums[at + n] - self.sums[at]) * self.back[at]


def common_words(one: Running, at: np.ndarray, other: Running, there: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words two sequences share from each pair of places on, at most `most`."""
    length = np.zeros(len(at), np.int64)
    step = 1 << int(most.max(initial=0)).bit_length()
    while step:
        k = np.flatnonzero(length + step <= most)
        same = one.of(at[k] + length[k], step) == other.of(there[k] + length[k], step)
        length[k[same]] += step
        step >>= 1
    return length


def segment_search(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """For each wanted value the place in its own sorted segment [low, high) where it would go."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        found = values[np.minimum(middle, len(values) - 1)]
        up = open_ & ((found <= wanted) if right else (found < wanted))
        low, high = np.where(up, middle + 1, low), np.where(open_ & ~up, middle, high)
    return low


@dataclass(frozen=True)
class Items:
    """A block of benchmark items: their words one after the other, and the seeds of all of them, sorted."""

    ids: list
    begin: np.ndarray
    running: Running
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # words of a seed: hash, word before, place, filter

    @staticmethod
    def of(rows: list[tuple[object, bytes]], seed_words: int) -> Items:
        cache = T.WordHashes()
        words = [T.token_hashes(plain_words(text), cache) for _, text in rows]
        begin = np.cumsum([0, *map(len, words)])
        parts: dict[int, list] = {}
        for start, tokens in zip(begin.tolist(), words):
            if len(tokens):
                size = min(seed_words, len(tokens))
                hashes = T.gram_hashes(tokens, size)
                before = np.append(_BEFORE_ITEM, tokens)[:len(hashes)]
                parts.setdefault(size, []).append((hashes, before, start + np.arange(len(hashes))))
        seeds = {}
        for size, found in parts.items():
            hashes, before, place = (np.concatenate([f[k] for f in found]) for k in range(3))
            order = np.lexsort((before, hashes))
            known = np.zeros(1 << _FILTER_BITS, bool)
            known[hashes >> np.uint64(64 - _FILTER_BITS)] = True
            seeds[size] = (hashes[order], before[order], place[order], known)
        return Items([r[0] for r in rows], begin, Running(np.concatenate([*words, np.empty(0, np.uint64)])), seeds)


def tiles(runs: list[tuple[int, int, int]], item_words: int, shortest: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: the longest match first, then the longest of what others leave free of it.

    Equal lengths go by place in the text, then in the item. It ends when no free stretch of the item is long enough.
    """
    heap = [(-n, t, i) for t, i, n in runs]
    heapq.heapify(heap)
    origin = min((t for t, _, _ in runs), default=0)
    item_free = np.ones(item_words, bool)
    text_free = np.ones(max((t + n for t, _, n in runs), default=0) - origin, bool)
    chosen, open_ = [], True
    while heap and open_:
        n, t, i = heapq.heappop(heap)
        n, t = -n, t - origin
        free = item_free[i:i + n] & text_free[t:t + n]
        if free.all():
            chosen.append((t + origin, i, n))
            item_free[i:i + n] = text_free[t:t + n] = False
            open_ = any(b - a >= shortest for a, b in stretches(item_free))
            continue
        for start, stop in stretches(free):
            if stop - start >= shortest:
                heapq.heappush(heap, (start - stop, t + origin + start, i + start))
    return chosen


def stretches(free: np.ndarray) -> list[tuple[int, int]]:
    """First place and end of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def first_matches(items: Items, tokens: np.ndarray, begin: np.ndarray, size: int):
    """(text, item, place, item place, words) of every longest match of `size` words or more, PAIRS at a time.

    Of a stretch that text and item share only the first seed is looked at: one whose words before differ. The seeds of a
    repetitive text that only go on with a stretch are never listed.
    """
    hashes, before, place, known = items.seeds[size]
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    grams = T.gram_hashes(tokens, size)
    hit = np.flatnonzero(known[grams >> np.uint64(64 - _FILTER_BITS)])
    hit = hit[owner[hit] == owner[hit + size - 1]]
    low, high = (np.searchsorted(hashes, grams[hit], side) for side in ("left", "right"))
    hit, low, high = (x[high > low] for x in (hit, low, high))
    own = np.where(hit == begin[owner[hit]], _BEFORE_TEXT, tokens[hit - 1])
    ends = segment_search(before, low, high, own, False), segment_search(before, low, high, own, True)
    counts = (ends[0] - low) + (high - ends[1])
    upto = np.cumsum(counts)
    running = Running(tokens)
    start = 0
    while start < len(hit):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, "right")))
        part = slice(start, stop)
        n = counts[part]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        smaller = np.repeat(ends[0][part] - low[part], n)
        seed = np.where(k < smaller, np.repeat(low[part], n) + k, np.repeat(ends[1][part], n) + k - smaller)
        at, there = np.repeat(hit[part], n), place[seed]
        text, item = owner[at], np.searchsorted(items.begin, there, "right") - 1
        most = np.minimum(begin[text + 1] - at, items.begin[item + 1] - there)
        yield text, item, at - begin[text], there - items.begin[item], common_words(running, at, items.running, there, most)
        start = stop


def covered(items: Items, texts: list[bytes | None], cache: T.WordHashes) -> list[list[tuple[int, float, int]]]:
    """For each text: (item, share of the item's words under tiles, tiles) of every item it shares a seed with."""
    words = [T.token_hashes(plain_words(t), cache) for t in texts]
    tokens = np.concatenate([*words, np.empty(0, np.uint64)])
    begin = np.cumsum([0, *[len(w) for w in words]])
    found: list[list[tuple[int, float, int]]] = [[] for _ in texts]
    for size in items.seeds:
        parts = list(first_matches(items, tokens, begin, size))
        if not parts:
            continue
        text, item, at, there, n = (np.concatenate([p[k] for p in parts]) for k in range(5))
        order = np.lexsort((item, text))
        text, item, at, there, n = (x[order] for x in (text, item, at, there, n))
        cut = np.flatnonzero(np.append(True, (np.diff(text) != 0) | (np.diff(item) != 0))) if len(text) else []
        for start, stop in zip(cut, np.append(cut[1:], len(text))):
            which = int(item[start])
            total = int(items.begin[which + 1] - items.begin[which])
            runs = list(zip(at[start:stop].tolist(), there[start:stop].tolist(), n[start:stop].tolist()))
            chosen = tiles(runs, total, size)
            found[int(text[start])].append((which, sum(m for _, _, m in chosen) / total, len(chosen)))
    return found


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int):
    """The items in blocks of bounded size, split by hash; null texts and items without a word match nothing."""
    usable = benchmark.filter(F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").cast("binary").alias("text"))
    size = usable.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-size // block_bytes)
    for k in range(blocks):
        part = usable.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else usable
        rows = sorted(((r["item"], bytes(r["text"])) for r in part.distinct().collect()), key=lambda r: (r[0] is not None, r))
        if rows:
            yield rows


def tile_coverage(documents: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", threshold: float = 0.6, seed_words: int = SEED_WORDS, keep: tuple[str, ...] = (),
                  block_bytes: int = BLOCK_BYTES, output: str = "items") -> DataFrame:
    """id, `keep`, `output` (array of item, coverage, tiles at or above the threshold) for every row.

    The benchmark is the query set: it is broadcast in blocks of at most `block_bytes` of text, each held against all
    rows. Texts without words and empty benchmarks give empty arrays. Items shorter than a seed must occur as a whole.
    Repeated items count once, repeated rows are judged alike.
    """
    names = [id, *keep]
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in names)
    item_kind = benchmark.schema[item].dataType.simpleString()
    found_type = f"array<struct<item:{item_kind},coverage:double,tiles:bigint>>"
    carried = text if text in names else "__text"
    passed = [*names, *[carried for _ in range(carried not in names)]]
    passed_kinds = kinds if carried in names else f"{kinds}, __text string"
    result = documents.select(*[F.col(f"`{text if c == carried else c}`").alias(c) for c in passed],
                              F.array().cast(found_type).alias("__items"))
    for rows in benchmark_blocks(benchmark, item, item_text, block_bytes):
        shared = documents.sparkSession.sparkContext.broadcast(Items.of(rows, seed_words))

        def run(batches, shared=shared):
            items, cache = shared.value, T.WordHashes()
            for part, texts in T.text_blocks(batches, carried):
                added = [[{"item": items.ids[i], "coverage": c, "tiles": n} for i, c, n in per if c >= threshold]
                         for per in covered(items, texts, cache)]
                before = part.column(part.num_columns - 1)
                values = pa.array([[*a.as_py(), *b] if b else a.as_py() for a, b in zip(before, added)], before.type)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], values], [*passed, "__items"])

        result = result.mapInArrow(run, f"{passed_kinds}, __items {found_type}")
    return result.select(*[F.col(f"`{c}`") for c in names], F.array_sort("__items").alias(output))


def without_contaminated(documents: DataFrame, benchmark: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """The rows, with all their columns, that hold no benchmark item."""
    rows, given = shielded(documents)
    others = tuple(c for c in rows.columns if c != id)
    clean = tile_coverage(rows, benchmark, id, keep=others, output="__found", **options).filter(F.size("__found") == 0)
    return given(clean.drop("__found"))


def contamination(documents: DataFrame, benchmark: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """id, item_id of the best covered item, its coverage, item_ids at or above the threshold, contaminated; all rows.

    Ties of coverage go to the smallest item. A clean row has a null item, coverage 0 and an empty array.
    """
    best = F.element_at(F.array_sort(F.transform("items", lambda x: F.struct(
        (-x["coverage"]).alias("less"), x["item"].alias("item"), x["tiles"].alias("tiles")))), 1)
    dirty = F.size("items") > 0
    return tile_coverage(documents, benchmark, id, **options).select(
        F.col(f"`{id}`"), F.when(dirty, best["item"]).alias("item_id"),
        F.when(dirty, F.round(-best["less"], 6)).otherwise(0.0).alias("coverage"),
        F.when(dirty, best["tiles"]).otherwise(0).alias("tiles"),
        F.transform("items", lambda x: x["item"]).alias("item_ids"), dirty.alias("contaminated"))
