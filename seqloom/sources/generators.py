"""Synthetic tables, the same on every run and whatever the number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(*key, seed: int = 0) -> Column:
    """A number in [0, 1): the first ten hexadecimal digits of md5 of the seed and the key as text."""
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key]
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 10)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(2**40))


def normal(*key, seed: int = 0) -> Column:
    """A standard normal from two uniforms."""
    return F.sqrt(-2 * F.log1p(-uniform(*key, seed=seed))) * F.cos(2 * F.pi() * uniform(*key, seed=seed + 1))


def circle(spark: SparkSession, n: int, radius: float, inverse: bool = False, seed: int = 0) -> DataFrame:
    """(id, x, y, label): points in the square [-1, 1]^2; 1 inside the circle (outside, if inverse)."""
    p = spark.range(n).select("id", (uniform("id", seed=seed) * 2 - 1).alias("x"), (uniform("id", seed=seed + 7) * 2 - 1).alias("y"))
    inside = F.col("x") * F.col("x") + F.col("y") * F.col("y") < radius * radius
    return p.withColumn("label", (~inside if inverse else inside).cast("int"))


def square(spark: SparkSession, n: int, side: float, seed: int = 0) -> DataFrame:
    p = circle(spark, n, 1.0, seed=seed)
    return p.withColumn("label", ((F.abs("x") < side / 2) & (F.abs("y") < side / 2)).cast("int"))


def survival(spark: SparkSession, n: int, mean: float, censored: float, seed: int = 0) -> DataFrame:
    """(id, duration, event): exponential durations, a share of them censored."""
    return spark.range(n).select("id", (-F.log1p(-uniform("id", seed=seed)) * mean).alias("duration"), (uniform("id", seed=seed + 3) >= censored).alias("event"))


def noisy_sigmoids(spark: SparkSession, n: int, visits: int, noise: float = 1.0, seed: int = 0) -> DataFrame:
    """(id, t, v): declining curves of different pace, a visit every 90 days."""
    k, a = 0.003 + 0.01 * uniform("id", seed=seed), 300 + 900 * uniform("id", seed=seed + 5)
    v = 48 / (1 + F.exp(k * (F.col("t") - a))) + noise * normal("id", "t", seed=seed + 11)
    return spark.range(n).select("id", F.explode(F.sequence(F.lit(0), F.lit(90 * (visits - 1)), F.lit(90))).alias("t")).select("id", "t", F.greatest(F.least(v, F.lit(48.0)), F.lit(0.0)).alias("v"))
