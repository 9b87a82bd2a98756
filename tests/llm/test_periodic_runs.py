"""Periodic runs against a search over all periods."""

import hashlib
import random
import re
import zlib

import pytest
from test_operators import SCHEMA, texts

from tickloom.llm import periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_by_period(words):
    """Every period is tried: longest stretches of it, kept where no smaller period holds in them."""
    found = set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            start = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(12, 2 * q):
                found.add((start, i - start + q, q))
            i += 1 if i == start else 0
    return sorted((r for r in found if not any(
        all(words[r[0] + k] == words[r[0] + k + q] for k in range(r[1] - q)) for q in range(1, r[2]))), key=lambda r: (r[0], r[2]))


def digest_by_period(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a, g = h // 10 % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_by_period(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest())


def test_random_words():
    r = random.Random(5)
    for _ in range(150):
        lists = []
        for _ in range(r.randint(1, 5)):
            kinds, n = r.choice([1, 2, 2, 3, 5]), r.choice([0, 1, 11, 12, 13, 40, 90])
            words = [bytes([97 + r.randrange(kinds)]) for _ in range(n)]
            if r.random() < 0.5 and n > 20:
                a = r.randrange(n)
                p = 1 + (n - a) // r.randint(2, 6)
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            lists.append(words)
        assert periodic_runs.find_runs(lists) == [runs_by_period(w) for w in lists]


def test_long_repetitive_texts():
    assert periodic_runs.find_runs([[b"a"] * 100_000, [b"a", b"b", b"c"] * 20_000]) == [[(0, 100_000, 1)], [(0, 60_000, 3)]]


def test_ordered_places():
    numbers = list(range(0, 20_000, 3))
    random.Random(2).shuffle(numbers)
    places, known = periodic_runs.Places(numbers[0]), [numbers[0]]
    for n in numbers[1:]:
        before, after = places.add(n)
        if len(known) < 300:
            assert before == max((k for k in known if k < n), default=None) and after == min((k for k in known if k > n), default=None)
        known.append(n)
    assert list(places) == sorted(numbers) and places.size == len(numbers) and len(places.pieces) > 2


@pytest.fixture(scope="module")
def odd_rows():
    planted = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    some = texts() + ["same words " * 9, "a b c d e f\n" * 6, "x " * 12 + "y " * 13]
    rows = list(enumerate(some)) + [(planted[k], t) for k, t in enumerate(texts()[:25]) if k < len(planted)]
    return rows + [(3, some[3]), (3, some[3]), (None, "no id " * 10)]


def test_digest(spark, odd_rows):
    df = spark.createDataFrame([(*r, "en", "s", 1, 2, "x", 3, 4, 5, "y") for r in odd_rows], SCHEMA)
    df = df.selectExpr("*", "1 AS start", "'z' AS runs_sha256", "2 AS __id", "n AS __text")
    found = [tuple(r) for r in periodic_runs.runs_digest(df).collect()]
    assert sorted(found, key=str) == sorted((digest_by_period(*r) for r in odd_rows), key=str)
    listed = sorted(tuple(r)[1:] for r in periodic_runs.periodic_runs(df.filter("doc_id = 20")).collect())
    assert listed == [(0, 18, 2)]
    assert periodic_runs.runs_digest(df.limit(0)).count() == 0 and periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    from tickloom.llm.queries import QUERIES

    found = {r["doc_id"]: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(docs)
    for r in docs:
        if len(r["text"] or "") < 3000:
            assert found[r["doc_id"]] == digest_by_period(r["doc_id"], r["text"])
