"""Sums, ranks and percentiles along an order, without putting all rows into one task.

The order is cut into ranges at some of its values, drawn by hash; a running sum is taken inside each range and offset by
the totals of the ranges before it.  What reaches the driver are the cuts, and what is broadcast are the ranges' totals:
``RANGES`` rows for each group at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.sources.scratch import written

RANGES = 64


def cuts(df: DataFrame, column: str, ranges: int = RANGES) -> list:
    """Up to ranges - 1 values of a column, in order, that cut it into ranges of about equally many distinct values."""
    draw = F.xxhash64(F.lit("cut"), "value")
    values = df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct().orderBy(draw, "value").limit(8 * ranges)
    drawn = sorted(r[0] for r in values.collect())
    return sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else []


def range_of(column: Column, at: list) -> Column:
    """How many of the cuts are not above a value, found by halving."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(column < F.lit(at[middle]), between(low, middle)).otherwise(between(middle + 1, high))

    return between(0, len(at))


def running(df: DataFrame, order: str, value: str, out: str, by: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of its group whose ``order`` is not above its own.

    Rows of equal order are in one range; rows whose order is null get null.  The rows are looked at three times, so they
    are written once.
    """
    by = by or []
    df = written(df, "ranges")
    placed = df.withColumn("range_no", F.when(F.col(order).isNotNull(), range_of(F.col(order), cuts(df, order, ranges))))
    totals = placed.where("range_no IS NOT NULL").groupBy(*by, "range_no").agg(F.sum(value).alias("range_sum"))
    before = F.sum("range_sum").over(Window.partitionBy(*by).orderBy("range_no")) - F.col("range_sum")
    names = [f"range_by_{i}" for i in range(len(by))]
    offsets = totals.select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col("range_no").alias("range_at"), before.alias("range_before"))
    inside = F.sum(value).over(Window.partitionBy(*by, "range_no").orderBy(order))
    same = F.col("range_no") == F.col("range_at")
    for c, n in zip(by, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    joined = placed.withColumn("range_own", inside).join(offsets, same, "left")
    return joined.select(*df.columns, F.when(F.col("range_no").isNotNull(), F.col("range_own") + F.col("range_before")).alias(out))


def numbered(df: DataFrame, order: str, out: str) -> DataFrame:
    """``df`` with ``out``: 1, 2, ... by a column whose values are distinct and not null."""
    return running(df.withColumn("range_one", F.lit(1).cast("long")), order, "range_one", out).drop("range_one")


def percentiles(df: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """(by, p0, p1, ...): exact percentiles of each group, by straight lines between neighbours.

    From counts by distinct value: no group's values meet in one task.  A group without a value has no row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("grp"), F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n"))
    upto = running(counts, "x", "n", "upto", ["grp"])
    totals = upto.groupBy("grp").agg(F.max("upto").alias("total")).withColumnRenamed("grp", "g")
    placed = upto.join(totals, F.col("grp").eqNullSafe(F.col("g")))
    out = []
    for i, p in enumerate(shares):
        at = (F.col("total") - 1) * F.lit(float(p))
        value_at = lambda k: F.max(F.when((F.col("upto") - F.col("n") <= k) & (k < F.col("upto")), F.col("x")))
        low, high = value_at(F.floor(at)), value_at(F.ceil(at))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(f"p{i}"))
    return placed.groupBy(F.col("grp").alias(by)).agg(*out)


def ranked_by_hash(df: DataFrame, stratum: str, order: Column, key: str) -> DataFrame:
    """``df`` with hash_rank (1, 2, ... by ``order``, then key, inside each stratum) and stratum_rows.

    ``order`` is text of hexadecimal digits; rows are ranked in blocks of its first two, so that a large stratum is not
    ranked in one task.
    """
    blocked = df.withColumn("hash_block", F.substring(order, 1, 2))
    counts = blocked.groupBy(stratum, "hash_block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(stratum).orderBy("hash_block")) - F.col("n")
    offsets = counts.select(F.col(stratum).alias("hash_s"), F.col("hash_block").alias("hash_b"), before.alias("hash_before"), F.sum("n").over(Window.partitionBy(stratum)).alias("stratum_rows"))
    inside = F.row_number().over(Window.partitionBy(stratum, "hash_block").orderBy(order, key))
    joined = blocked.withColumn("hash_rank", inside).join(offsets, F.col(stratum).eqNullSafe(F.col("hash_s")) & (F.col("hash_block") == F.col("hash_b")))
    return joined.select(*df.columns, (F.col("hash_rank") + F.col("hash_before")).alias("hash_rank"), "stratum_rows")


def fold_of(position: Column, rows: int, folds: int) -> Column:
    """The contiguous fold, from 1, of a position from 1: the first rows % folds folds have one row more."""
    small, more = rows // folds, rows % folds
    edge = more * (small + 1)
    in_large = F.floor((position - 1) / F.lit(small + 1)) + 1
    in_small = F.lit(more) + F.floor((position - 1 - edge) / F.lit(max(1, small))) + 1
    return F.when(position <= edge, in_large).otherwise(in_small).cast("int")


def blocks_for(rows: int, in_block: int = 2_000, least: int = 8) -> int:
    """Blocks that rows are dealt into where each pair of blocks is a task's work."""
    return max(least, math.ceil(rows / in_block))
