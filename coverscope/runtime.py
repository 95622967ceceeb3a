"""What operators share: cutting lineage, and joins on keys that many rows have."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut, in the folder that spark.checkpoint.dir names (shared by driver and executors)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt out, evenly or by columns, over a number of tasks that doesn't follow from its bytes, for rows that are quick to read and slow or large to work on."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def by_hash(right: DataFrame) -> DataFrame:
    """right, which has one row of each key, as what a join holds by hash: the other side, of many more rows, isn't sorted. A task holds its share of right's keys."""
    return right.hint("shuffle_hash")


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, salts: int, how: str = "inner") -> DataFrame:
    """left join right on keys, where one key may hold a great part of left: left's rows of a key go to `salts` places by spread, right's rows to each of them.

    spread is an expression over left; right should hold few rows of each key.
    """
    a = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def first_by(df: DataFrame, keys: list[str], order: list[Column], keep: list[str] | None = None) -> DataFrame:
    """The row of each key that comes first in order. An aggregate with partial sums, so a key of many rows is reduced before it is shuffled.

    order: ascending columns whose values tell rows apart; where they don't, equal rows are interchangeable.
    """
    names = keep or [c for c in df.columns if c not in keys]
    value = F.struct(*[F.col(c) for c in names])
    best = df.groupBy(*keys).agg(F.min_by(value, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_first"))
    return best.select(*keys, *[F.col("_first")[c].alias(c) for c in names])


def counted_so_far(df: DataFrame, order: list[Column], counted: Column, to: str) -> DataFrame:
    """df with the number of counted rows up to each row, itself included, in an order of all rows: a prefix sum over partitions.

    Rows are dealt out in ranges of the order, and sums within a range are given what all ranges before it have, a row for each. No task sees more than its range. order should tell rows apart, or one range
    takes all rows that are equal in it; those are in any order.
    """
    ranged = df.withColumn("_own", counted.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = settle(ranged.withColumn("_part", F.shiftright("_id", 33)))
    sums = placed.groupBy("_part").agg(F.sum("_own").alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    within = F.sum("_own").over(Window.partitionBy("_part").orderBy("_id"))
    return placed.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn(to, F.col("_within") + F.col("_before")).drop("_own", "_id", "_part", "_within", "_before")
