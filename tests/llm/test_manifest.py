"""The Merkle manifest against a tree built in one list."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from test_operators import SCHEMA, texts

from tickloom.llm import manifest

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k:k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, k):
    """(siblings left of the node, siblings right of it) on each level."""
    out = []
    for nodes in levels[:-1]:
        run = range(k // 2 * 2, min(k // 2 * 2 + 2, len(nodes)))
        out.append(("".join(nodes[j] for j in run if j < k), "".join(nodes[j] for j in run if j > k)))
        k //= 2
    return out


def by_lists(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    leaves = {g: sorted([(r[0] is not None, r[0] or 0, leaf_of(r), r) for r in groups[g]], key=lambda x: x[:3]) for g in order}
    trees = {g: tree([x[2] for x in leaves[g]]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    root = top[-1][0] if top[-1] else None
    out = []
    for at, g in enumerate(order):
        for k, (_, _, leaf, r) in enumerate(leaves[g]):
            steps = path(trees[g], k) + path(top, at)
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                now = leaf_of((*r[:3], None if r[3] is None else r[3] + 1, r[4]))
            for left, right in steps:
                now = H(left, now, right)
            out.append((r[0], leaf, trees[g][-1][0], root, H(*[x for s in steps for x in s]), now, now == root))
    return sorted(out, key=str)


def frame(spark, rows):
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], 1, "x", 2, 3, 4, "y") for r in rows], SCHEMA)
    return df.selectExpr("*", "1 AS slot", "2 AS id", "'g' AS grp", "'l' AS leaf", "0 AS total", "5 AS node")


def result(spark, rows, levels=manifest.LEVELS):
    return sorted((tuple(r) for r in manifest.documents_manifest(frame(spark, rows), levels).collect()), key=str)


def odd_rows():
    r = random.Random(3)
    rows = [(k, f"s{k % 3}" if k % 5 else None, r.choice(["en", "de", "é", None]), None if k % 6 == 0 else k, t) for k, t in enumerate(texts())]
    rows += [(r.choice([-1, 1]) * r.randrange(1 << r.choice([5, 17, 40, 62])), "s", "en", 7, str(k)) for k in range(60)]
    rows += [rows[3]] * 3 + [(3, "other", rows[3][2], 1, "same id")] + [(None, "s", "en", 1, f"no id {k % 2}") for k in range(5)]
    return rows + [(5, None, "zz", None, None)]


@pytest.mark.parametrize("levels", [2, 11])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "COPIES", 2)
    rows = odd_rows()
    assert result(spark, rows, levels) == by_lists(rows)


def test_small_trees(spark):
    unique = [(k, "s", "en", 1, "t") for k in (70_000, 3, -9)]
    for rows in ([unique[0]], unique, unique + [(1, "s", None, 1, "u")]):
        assert result(spark, rows) == by_lists(rows)
    assert manifest.documents_manifest(frame(spark, [])).collect() == []


def test_many_groups(spark):
    rows = [(k, "s", f"lang{k // 2}", 1, "t") for k in range(60)]
    assert result(spark, rows, 3) == by_lists(rows)


def test_bitmaps():
    r, room = np.random.default_rng(1), 1 << manifest.RANGE_BITS
    for n in (0, 1, manifest.SPARSE - 1, manifest.SPARSE, room // 2, room):
        low = np.sort(r.choice(room, n, replace=False))
        data = manifest.compressed(low)
        assert np.array_equal(manifest.opened(data), low) and len(data) == min(2 * n, room // 8)
        asked = r.integers(0, room, 500)
        assert np.array_equal(manifest.ranks(data, asked), np.searchsorted(low, asked))


def test_query(spark, sf_dir):
    from tickloom.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS).collect()]
    assert sorted((tuple(r) for r in QUERIES["op11_manifest"](spark, sf_dir).collect()), key=str) == by_lists(rows)


def test_sql(spark, sf_dir):
    import duckdb

    from tickloom.llm.queries import QUERIES, SQL

    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    expected = duckdb.sql(SQL["op11_manifest"])
    found = QUERIES["op11_manifest"](spark, sf_dir).select(*expected.columns).collect()
    assert sorted(map(tuple, found)) == sorted(expected.fetchall())
