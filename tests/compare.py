"""Compare a query's rows with those of its SQL, regardless of row and column order."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


SPARK_KIND = {"bigint": "int", "int": "int", "double": "float", "string": "str", "timestamp_ntz": "time",
              "timestamp": "time", "boolean": "bool", "date": "date"}
DUCK_KIND = {"BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "str", "TIMESTAMP": "time",
             "BOOLEAN": "bool", "DATE": "date"}


def differences(df, con, sql: str, limit: int = 4) -> list[str]:
    found = []
    relation = con.sql(sql)
    theirs = dict(zip(relation.columns, [str(t) for t in relation.types]))
    ours = dict(df.dtypes)
    if sorted(ours) != sorted(theirs):
        return [f"columns {sorted(ours)} != {sorted(theirs)}"]
    for name, kind in ours.items():
        a, b = SPARK_KIND.get(kind, kind), DUCK_KIND.get(theirs[name], theirs[name])
        if a != b:
            found.append(f"type of {name}: {kind} != {theirs[name]}")
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    other = _rows(list(theirs), relation.fetchall())
    if sum(mine.values()) != sum(other.values()):
        found.append(f"rows {sum(mine.values())} != {sum(other.values())}")
    for label, extra in (("only here", mine - other), ("only SQL", other - mine)):
        if extra:
            found.append(f"{label} {sum(extra.values())}: {list(extra)[:limit]}")
    if not mine:
        found.append("no rows")
    return found
