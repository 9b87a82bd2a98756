"""Ordered computations that stay distributed when one key holds most of the rows.

A plain window over (key ORDER BY time) sorts all rows of a key in one task. The helpers
here cut a key's sequence into pieces instead:

* prefix sums run inside a chunk (a day, say) and add the total of the earlier chunks;
  only the chunk totals, one row per key and chunk, meet in one window;
* frames of bounded length run inside blocks of consecutive positions, where the last
  rows of a block are also sent to the next one.

As in a plain window, a NULL key is a key of its own and a NULL order comes first. Rows must be unique
per (keys, order), NULLs included.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.columns import day, quoted

BLOCK = 4096

_CHUNK, _POS, _BLOCK, _HALO = "__chunk", "__pos", "__block", "__halo"


def _definite(df: DataFrame, names: Sequence[str]) -> dict[str, Column]:
    """Columns that are never NULL and are equal where the named ones are, NULLs included.

    Unlike a null-safe comparison, an equality on them keeps the partitioning of a window on them.
    """
    made = {}
    for i, c in enumerate(names):
        kind = df.schema[c].dataType
        timed = isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
        made[f"__d{i}"] = F.coalesce(F.col(quoted(c)), F.lit("1970-01-01" if timed else "0").cast(kind))
        made[f"__m{i}"] = F.col(quoted(c)).isNull()
    return made


def join_alike(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns of one name in which NULL equals NULL."""
    renamed = right.withColumnsRenamed({c: f"__w_{c}" for c in on})
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(quoted(c)).eqNullSafe(F.col(quoted(f"__w_{c}")))
    return left.join(renamed, condition, how).drop(*[f"__w_{c}" for c in on])


def running(df: DataFrame, keys: Sequence[str], order: str, sums: Mapping[str, Column],
            chunk: Column | None = None, totals: Mapping[str, str] | None = None) -> DataFrame:
    """Add inclusive running sums per key. `chunk` must not decrease along `order`.

    `totals` adds a key's final sum as well: {new name: name in sums}.
    """
    keys, totals = list(keys), dict(totals or {})
    chunked = df.withColumn(_CHUNK, day(order) if chunk is None else chunk)
    group = [*keys, _CHUNK]
    per_chunk = chunked.groupBy(*group).agg(*[F.sum(v).alias(f"__t_{n}") for n, v in sums.items()])
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    same = _definite(chunked, group)
    offsets = per_chunk.select(
        *[c.alias(n) for n, c in same.items()],
        *[F.sum(f"__t_{n}").over(earlier).alias(f"__o_{n}") for n in sums],
        *[F.sum(f"__t_{n}").over(whole).alias(out) for out, n in totals.items()],
    )
    inside = Window.partitionBy(*same).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = chunked.withColumns(same).select("*", *[F.sum(v).over(inside).alias(f"__i_{n}") for n, v in sums.items()])
    joined = local.join(offsets, list(same))
    # NULL only where no value came before, as in one window over the whole key.
    reached = {n: F.coalesce(F.col(f"__i_{n}") + F.col(f"__o_{n}"), F.col(f"__i_{n}"), F.col(f"__o_{n}")) for n in sums}
    return joined.select(*[F.col(quoted(c)) for c in df.columns], *[c.alias(n) for n, c in reached.items()], *totals)


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str],
            chunk: Column | None = None) -> DataFrame:
    """Add the last value that is not NULL, at or before each row: {new name: column}.

    As with `running`, a window sees one chunk, and one row per chunk carries the last value into later ones. Rows
    need not be unique; of rows equal in all of `order` any may come first.
    """
    keys, order = list(keys), list(order)
    chunked = df.withColumn(_CHUNK, day(order[0]) if chunk is None else chunk)
    group = [*keys, _CHUNK]
    # max_by passes over rows whose order is NULL; a struct of NULLs is not
    at = F.struct(*order)
    per_chunk = chunked.groupBy(*group).agg(*[
        F.max_by(quoted(c), F.when(F.col(quoted(c)).isNotNull(), at)).alias(f"__l_{n}") for n, c in columns.items()])
    same = _definite(chunked, group)
    earlier = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    before = per_chunk.select(*[c.alias(n) for n, c in same.items()], *[
        F.last(f"__l_{n}", ignorenulls=True).over(earlier).alias(f"__b_{n}") for n in columns])
    inside = Window.partitionBy(*same).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = chunked.withColumns(same).select("*", *[
        F.last(quoted(c), ignorenulls=True).over(inside).alias(f"__i_{n}") for n, c in columns.items()])
    return local.join(before, list(same)).select(
        *[F.col(quoted(c)) for c in df.columns if c not in columns],
        *[F.coalesce(f"__i_{n}", f"__b_{n}").alias(n) for n in columns])


def asof_join(left: DataFrame, rights: Mapping[str, tuple[DataFrame, str]], keys: Sequence[str], on: str,
              chunk: Column | None = None) -> DataFrame:
    """Each row of `left` with the latest row of every right table at or before its time: {new struct: (table, its time)}.

    All sides become one sequence, right rows first where times are equal, and the last right row is carried along. So a key
    with most of the rows is cut into chunks like everywhere here, and any number of tables costs one pass. A left row
    without a match or a time gets NULL. Rows of a right table without a time match nothing; of several with one key and
    time the largest by its other columns counts.
    """
    keys = list(keys)
    payloads = {n: F.struct(*[quoted(c) for c in table.columns if c not in keys]) for n, (table, _) in rights.items()}
    kinds = {n: table.select(payloads[n].alias("p")).schema["p"].dataType for n, (table, _) in rights.items()}
    rows = left.select(*[quoted(c) for c in left.columns], F.lit(len(rights)).alias("__side"),
                       *[F.lit(None).cast(kinds[n]).alias(n) for n in rights])
    for side, (name, (table, time)) in enumerate(rights.items()):
        given = table.filter(F.col(quoted(time)).isNotNull()).select(
            *[quoted(k) for k in keys], F.col(quoted(time)).cast(left.schema[on].dataType).alias(on),
            F.lit(side).alias("__side"), payloads[name].alias(name))
        one = given.groupBy(*[quoted(k) for k in keys], quoted(on), "__side").agg(F.max(name).alias(name))
        rows = rows.unionByName(one, allowMissingColumns=True)
    found = carried(rows, keys, [on, "__side"], {n: n for n in rights}, day(on) if chunk is None else chunk)
    return found.filter(F.col("__side") == len(rights)).drop("__side")


def islands(df: DataFrame, keys: Sequence[str], order: str, state: Column, chunk: Column | None = None) -> DataFrame:
    """Cut every key's sequence where `state` changes: adds state, run (from 0) and place in the run (from 0).

    A NULL state goes on with the state before it; rows before the first state have neither run nor place. Runs may be as long as
    the data: numbers and places are prefix sums, so no task sees a whole run.
    """
    keys = list(keys)
    known = carried(df.withColumn("__given", state), keys, [order], {"__state": "__given"}, chunk)
    placed = with_position(known, keys, order, chunk=chunk)
    turned = lagged(placed, keys, order, {"__before": "__state"}, position=_POS)
    starts = F.col("__state").isNotNull() & ~F.col("__state").eqNullSafe(F.col("__before"))
    marked = turned.withColumn("__turn", starts.cast("bigint")).withColumn("__first", F.when(starts, F.col(_POS)))
    numbered = running(marked, keys, order, {"__runs": F.col("__turn")}, chunk)
    begun = carried(numbered, keys, [order], {"__begin": "__first"}, chunk)
    kept = F.col("__state").isNotNull()
    return begun.select(*[quoted(c) for c in df.columns], F.col("__state").alias("state"),
                        F.when(kept, F.col("__runs") - 1).alias("run"), F.when(kept, F.col(_POS) - F.col("__begin")).alias("place"))


def with_position(df: DataFrame, keys: Sequence[str], order: str, out: str = _POS,
                  chunk: Column | None = None, total: str | None = None) -> DataFrame:
    """0-based position of every row in its key's sequence, and with `total` the number of rows."""
    counted = running(df, keys, order, {out: F.lit(1)}, chunk, {total: out} if total else None)
    return counted.withColumn(out, (F.col(out) - 1).cast("bigint"))


def framed(df: DataFrame, keys: Sequence[str], order: str, back: int,
           columns: Callable[[Window], Mapping[str, Column]], position: str | None = None,
           block: int | None = None, chunk: Column | None = None) -> DataFrame:
    """Add window columns whose frames reach at most `back` rows into the past.

    `columns` gets the ordered window and returns name -> column. `position` names a column with the rows'
    0-based positions without holes; without it they are counted here.
    """
    keys = list(keys)
    size = max(block or BLOCK, 4 * back)
    base = df if position else with_position(df, keys, order, chunk=chunk)
    pos = F.col(position or _POS)
    home = F.floor(pos / size)
    spread = base.select(
        "*",
        F.explode(F.when(pos % size >= size - back, F.array(home, home + 1)).otherwise(F.array(home))).alias(_BLOCK),
    ).withColumn(_HALO, F.col(_BLOCK) != home)
    window = Window.partitionBy(*keys, _BLOCK).orderBy(order)
    made = columns(window)
    # A computed column may replace an input column, so the result keeps its place.
    computed = spread.select("*", *[c.alias(f"__w_{n}") for n, c in made.items()]).filter(~F.col(_HALO))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in made]
    return computed.select(*kept, *[F.col(f"__w_{n}").alias(n) for n in made])


def lagged(df: DataFrame, keys: Sequence[str], order: str, columns: Mapping[str, str], n: int = 1,
           chunk: Column | None = None, position: str | None = None) -> DataFrame:
    """Add the value each named column had `n` rows earlier: {new name: column}."""
    return framed(df, keys, order, n, lambda w: {o: F.lag(c, n).over(w) for o, c in columns.items()},
                  position, chunk=chunk)


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & left[c].eqNullSafe(right[f"__w_{c}"])
    return condition


def _pieces(df: DataFrame, column: str) -> Column:
    """A chunk for any sortable column: the day of a time, the first letters of a text, 4,096 ranges of a number."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return day(column)
    if isinstance(kind, T.NumericType):
        value = F.col(quoted(column)).cast("double")
        ends = df.agg(F.min(value), F.max(value)).first()
        low, width = ends[0] or 0.0, ((ends[1] or 0.0) - (ends[0] or 0.0)) / 4096 or 1.0
        return F.floor((value - F.lit(low)) / F.lit(width))
    return F.substring(F.col(quoted(column)).cast("string"), 1, 2)


def position_slice(df: DataFrame, order: Sequence[str], start: Column | int, length: int) -> DataFrame:
    """Rows at global positions [start, start + length) when sorted by the columns in `order`.

    Counts per prefix of the order narrow the search, one order column at a time. Those of the first column are summed up
    in chunks, those of the others inside the few prefixes that matter. `start` may use column `n_rows`.
    """
    order = list(order)
    first = start if isinstance(start, Column) else F.lit(start)
    wanted = None
    for depth, column in enumerate(order):
        prefix = order[:depth]
        if wanted is None:
            counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
            summed = running(counts, [], column, {"__upto": F.col("__n")}, _pieces(df, column), {"n_rows": "__upto"})
            placed = summed.select(column, "__n", (F.col("__upto") - F.col("__n")).alias("__at"), first.alias("__start"))
        else:
            # At most `length` prefixes are wanted, whatever the size of the data.
            scope = df.join(F.broadcast(wanted), _same(df, wanted, prefix))
            located = scope.groupBy(*prefix, column, "__base", "__start").agg(F.count(F.lit(1)).alias("__n"))
            earlier = Window.partitionBy(*prefix).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
            placed = located.withColumn("__at", F.col("__base") + F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        wanted = placed.filter(
            (F.col("__at") + F.col("__n") > F.col("__start")) & (F.col("__at") < F.col("__start") + length)
        ).select(*[F.col(c).alias(f"__w_{c}") for c in order[:depth + 1]],
                 F.col("__at").alias("__base"), "__start", F.col("__n").alias("__size"))
        if depth + 1 < len(order):
            wanted = wanted.drop("__size")
    # Rows that tie on every order column are interchangeable: take as many as fall into the slice.
    end = F.least(F.col("__base") + F.col("__size"), F.col("__start") + length)
    wanted = wanted.withColumn("__need", end - F.greatest("__base", "__start"))
    ties = df.join(F.broadcast(wanted), _same(df, wanted, order))
    ranked = ties.withColumn("__rn", F.row_number().over(Window.partitionBy(*order).orderBy(order[-1])))
    return (ranked.filter(F.col("__rn") <= length).filter(F.col("__rn") <= F.col("__need"))
            .select(*[F.col(f"`{c}`") for c in df.columns]))


def smallest(df: DataFrame, order: str, bucket: Column, n: int) -> DataFrame:
    """The n rows that come first by `order`.

    Counts per bucket give the last bucket that can matter, so that only about n rows reach
    the final top-n. `bucket` must not decrease along `order`.
    """
    counts = df.groupBy(bucket.alias(_CHUNK)).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    last = (counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
            .filter(F.col("__before") < n).agg(F.max(_CHUNK)).scalar())
    return df.filter(bucket <= last).orderBy(order).limit(n)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """All rows that carry their key's latest order value (partial max, then an equi-join)."""
    last = df.groupBy(*keys).agg(F.max(order).alias(order))
    return join_alike(df, last, [*keys, order], "left_semi")


def last_n_per_key(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The n latest rows per key; the rank filter trims every partition before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("__rn", F.row_number().over(newest)).filter(F.col("__rn") <= n).drop("__rn")
