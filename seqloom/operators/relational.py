"""Relational idioms that need more than one call: deterministic sampling and splits, encodings, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.ranges import fold_of, numbered, ranked_by_hash


def hash_order(*columns: str, seed: int = 0) -> Column:
    """A reproducible random order: md5 of the seed and the columns as text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def sample_n(df: DataFrame, n: int, *key: str, seed: int = 0) -> DataFrame:
    """n rows, the same on every run."""
    return df.orderBy(hash_order(*key, seed=seed), *key).limit(n)


def sample_share(df: DataFrame, share: float, *key: str, seed: int = 0) -> DataFrame:
    """Rows whose hash falls below a share; row by row, without a shuffle."""
    return df.where(F.conv(F.substring(hash_order(*key, seed=seed), 1, 8), 16, 10).cast("long") < int(share * 2**32))


def stratified_split(df: DataFrame, stratum: str, key: str, test: float, seed: int = 0) -> DataFrame:
    """``df`` with ``is_test``: of each stratum exactly floor(test * n) rows."""
    ranked = ranked_by_hash(df, stratum, hash_order(key, seed=seed), key)
    return ranked.withColumn("is_test", F.col("hash_rank") <= F.floor(F.col("stratum_rows") * F.lit(test))).select(*df.columns, "is_test")


def balanced(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """As many rows of each label as the rarest has, without replacement."""
    least = df.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    return ranked_by_hash(df, label, hash_order(key, seed=seed), key).where(F.col("hash_rank") <= least).select(*df.columns)


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """``df`` with <column>_code: 1..k by sorted value; only the distinct values are numbered, in ranges."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    codes = numbered(values, column, f"{column}_code").withColumn(f"{column}_code", F.col(f"{column}_code").cast("int"))
    return df.join(codes, column, "left")


def folds(df: DataFrame, key: str, k: int) -> DataFrame:
    """``df`` with ``fold``, 1..k: contiguous folds by a key of distinct values, the first ones a row longer."""
    return numbered(df, key, "fold_position").withColumn("fold", fold_of(F.col("fold_position"), df.count(), k)).drop("fold_position")


def by_position(df: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    """The columns at these positions; (0, -1) drops the last."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns[start:stop]])


def reordered(df: DataFrame, nominal: list[str], numeric: list[str]) -> DataFrame:
    """The other columns first, then the nominal and the numeric ones kept."""
    rest = [c for c in df.columns if c not in nominal and c not in numeric]
    return df.select(*rest, *nominal, *numeric)


def side_by_side(a: DataFrame, order_a: str, b: DataFrame, order_b: str) -> DataFrame:
    """Rows of two tables next to each other by their places in the order of a column of distinct values of each; a column
    ``place`` from 1; the shorter table ends in nulls."""
    left, right = numbered(a, order_a, "place"), numbered(b, order_b, "place")
    return left.join(right, "place", "full")


def boolean_like(df: DataFrame) -> list[str]:
    """Numeric columns whose values are all 0, 1 or null."""
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "smallint", "tinyint", "double", "float")]
    row = df.agg(*[F.bool_and(F.col(c).isNull() | F.col(c).isin(0, 1)).alias(c) for c in numeric]).first() if numeric else {}
    return [c for c in numeric if row[c]]


def suffix_booleans(df: DataFrame, suffix: str = "_bool") -> DataFrame:
    return df.withColumnsRenamed({c: c + suffix for c in boolean_like(df)})


def missing_profile(df: DataFrame) -> DataFrame:
    """(column, missing): per cent of rows in which a column is null; one pass."""
    shares = df.agg(*[(100 * F.avg(F.col(c).isNull().cast("int"))).alias(c) for c in df.columns])
    return shares.unpivot([], df.columns, "column", "missing")


def missing_per_row(df: DataFrame, columns: list[str]) -> Column:
    out = F.lit(0)
    for c in columns:
        out = out + F.col(c).isNull().cast("int")
    return out


def mode(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., mode): the most frequent value, the smallest of equals."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), F.col(value))).alias("mode"))


def clean_name(name: str) -> str:
    """``Sexe : [ SEX ] [ STATIC ]`` becomes ``SEX``; other names keep their letters, digits and underscores."""
    import re

    code = re.search(r"\[\s*([A-Za-z0-9_-]+)\s*\]", name)
    return code[1] if code else re.sub(r"\W+", "_", name.strip().lstrip("﻿")).strip("_")


def clean_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_name(c) for c in df.columns])
