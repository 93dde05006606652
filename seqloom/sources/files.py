"""File sources and sinks with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.operators.relational import clean_headers


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", header: bool = True, clean: bool = False) -> DataFrame:
    """CSV with a header; without a schema every column is a string.  ``clean`` turns coded headers into names."""
    r = spark.read.option("sep", sep).option("header", header).option("encoding", "UTF-8")
    df = (r.schema(schema) if schema else r).csv(path)
    return clean_headers(df) if clean else df


def read_timed_events(spark: SparkSession, path: str) -> DataFrame:
    """(num_patient, events): a ``;``-separated file of patient, event and time, as arrays in order of time."""
    df = read_csv(spark, path, "num_patient BIGINT, event_name STRING, difftime DOUBLE", ";")
    return df.groupBy("num_patient").agg(F.array_sort(F.collect_list(F.struct("difftime", "event_name"))).alias("events"))


def read_many_csv(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """All files of a glob, lower-case headers, with the ordinal of the file as ``part`` (from 1, by path)."""
    df = spark.read.option("header", True).schema(schema).csv(glob).withColumn("file", F.col("_metadata.file_path"))
    order = df.select("file").distinct().withColumn("part", F.row_number().over(Window.orderBy("file")))
    return df.join(F.broadcast(order), "file").drop("file").toDF(*[c.lower() for c in df.columns if c != "file"], "part")


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) of a space-separated file without header or quoting."""
    parts = F.split("value", " ")
    return spark.read.text(path).select(parts[0].alias("word"), F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.cast("double")).alias("vector"))


def read_json_lines(spark: SparkSession, path: str, schema: str, keep: Column | None = None, most: int | None = None) -> DataFrame:
    """Line-delimited JSON (gzip too), filtered at the scan, optionally no more than ``most`` rows."""
    df = spark.read.schema(schema).json(path)
    df = df if keep is None else df.where(keep)
    return df if most is None else df.limit(most)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lookup table: one trimmed, non-empty line a row."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_matrix(edges: DataFrame, labels: DataFrame, value: str, path: str) -> None:
    """A distance list as a matrix with a class column, as CSV."""
    wide = edges.groupBy("id1").pivot("id2").agg(F.first(value))
    write_csv(wide.join(labels.select(F.col("id").alias("id1"), F.col("label").alias("class")), "id1"), path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def small_sample(df: DataFrame, related: DataFrame, key: str, share: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A share of the complete rows, and the rows of a related table that they refer to."""
    from seqloom.operators.relational import sample_share

    some = sample_share(df.dropna(), share, *df.columns, seed=seed)
    return some, related.join(some, key, "left_semi")
