"""Sharding by jump consistent hashing.

The key alone decides the shard: no ring table, and appending a shard moves rows only into it. All
expressions are Spark's own; the 64-bit wrap-around product of the generator is taken in decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the published algorithm: multiplier of the generator and its number ranges.
MULTIPLIER = "2862933555777941757"
TWO_64 = "18446744073709551616"
TWO_33 = "8589934592"
TWO_31 = 2147483648.0
#: Steps of the first loop; a key that needs more goes on in a second one.
STEPS = 48


def _draws(state: Column, shards: int, steps: int) -> Column:
    def step(s: Column, _: Column) -> Column:
        following = ((s["key"] * F.expr(f"CAST({MULTIPLIER} AS DECIMAL(19,0))") + F.lit(1))
                     % F.expr(f"CAST({TWO_64} AS DECIMAL(20,0))")).cast("decimal(20,0)")
        jumped = F.transform(F.array(following), lambda k: F.struct(
            k.alias("key"), s["next"].alias("shard"),
            F.floor((s["next"] + 1) * (F.lit(TWO_31) / (F.floor(k / F.expr(f"CAST({TWO_33} AS DECIMAL(10,0))"))
                                                         .cast("double") + 1))).cast("long").alias("next")))
        return F.when(s["next"] < shards, jumped[0]).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 to shards - 1 of a 64-bit key, read as unsigned. A null key counts as 0."""
    if shards < 1:
        raise ValueError("shards must be positive")
    number = F.coalesce(key.cast("long"), F.lit(0)).cast("decimal(20,0)")
    unsigned = F.when(number < 0, (number + F.expr(f"CAST({TWO_64} AS DECIMAL(20,0))")).cast("decimal(20,0)")).otherwise(number)
    state = F.struct(unsigned.alias("key"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))
    short = _draws(state, shards, STEPS)
    return F.element_at(F.transform(F.array(short), lambda s: F.when(
        s["next"] < shards, _draws(s, shards, shards)["shard"]).otherwise(s["shard"])), 1).cast("int")


def stable_key(df: DataFrame, column: str) -> Column:
    """Whole numbers are keys themselves; any other type is hashed. Null stays null."""
    if df.schema[column].dataType.typeName() in ("byte", "short", "integer", "long"):
        return F.col(f"`{column}`").cast("long")
    return F.when(F.col(f"`{column}`").isNotNull(), F.xxhash64(F.col(f"`{column}`").cast("string")))


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = 16, output: str = "shard") -> DataFrame:
    """All rows and columns with their shard; no shuffle. An input column named `output` is replaced.

    Rows with equal keys share a shard; rows without a key go where key 0 goes. An empty table stays empty.
    """
    return df.withColumn(output, jump_shard(stable_key(df, key), shards))


def number_slots(df: DataFrame, shard: str = "shard", output: str = "slot", blocks: int = 4096, copies: int = 8192) -> DataFrame:
    """Rows of a narrow frame numbered from 0 without gaps inside each shard.

    Repeated rows are counted once per partition before the shuffle, so a row that makes up a third of the table is one
    record. It goes on as pieces of at most `copies` rows in blocks of their own, and only behind the window does each task
    make the rows of its pieces. No task holds a shard: the rows of one fall into `blocks` hash blocks, and only the
    blocks' totals meet in one window.
    """
    names = [c for c in df.columns if c != output]
    columns = [F.col(f"`{c}`") for c in names]
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__all"))
    pieces = counted.withColumn("__piece", F.explode(F.expr(f"sequence(0L, (__all - 1) div {copies})")))
    rows = (pieces.withColumn("__copies", F.least(F.lit(copies).cast("long"), F.col("__all") - F.col("__piece") * copies))
            .withColumn("__block", F.pmod(F.xxhash64(*columns) % blocks + F.col("__piece"), F.lit(blocks))))
    by_shard = Window.partitionBy("__shard").orderBy("__b")
    totals = (rows.groupBy(F.col(f"`{shard}`").alias("__shard"), F.col("__block").alias("__b"))
              .agg(F.sum("__copies").alias("__total"))
              .withColumn("__before", F.sum("__total").over(by_shard) - F.col("__total")))
    inside = Window.partitionBy(f"`{shard}`", "__block").orderBy(*columns, "__piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = (rows.join(totals, F.col(f"`{shard}`").eqNullSafe(F.col("__shard")) & (F.col("__block") == F.col("__b")))
                .withColumn("__first", F.sum("__copies").over(inside) - F.col("__copies") + F.col("__before")))
    return numbered.select(*columns, F.explode(F.sequence(
        F.col("__first"), F.col("__first") + F.col("__copies") - 1)).alias(output))


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder of Parquet files per shard; each task writes its own rows, nothing is gathered."""
    df.write.partitionBy(shard).parquet(path)


def shard_digest(documents: DataFrame, shards: int = 16) -> DataFrame:
    """Size, checksum, shard, slot and the shard with one more shard for each document.

    Size is the text's UTF-8 bytes plus 1; a null text has no bytes and checksum 0. Repeated rows get a
    slot each.
    """
    content = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    narrow = documents.select(
        "doc_id", (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"))
    sharded = assign_shards(assign_shards(narrow, "doc_id", shards), "doc_id", shards + 1, "grown_shard")
    return number_slots(sharded).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
