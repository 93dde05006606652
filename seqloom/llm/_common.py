"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and U+0009..U+000D.
GAP = r"[\x20\x09-\x0D]+"

_own_dir: list[str] = []
_written: list[str] = []

#: Keys with more rows than this may be hot; the most frequent ones, no more than ``MOST_HOT``, are looked up by broadcast.
HOT_ROWS, MOST_HOT = 200, 1_024


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session leaves that unset and runs on one machine (tests) is a folder of our own made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="seqloom-"))
    return _own_dir[0]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and returns the table read back.

    Cuts the lineage: a lost executor costs no more than the tasks it ran, since the files are kept elsewhere.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession, keep: DataFrame | None = None) -> None:
    """Deletes all tables that ``materialize`` wrote but those that ``keep`` reads; other results that still read them must have been saved before."""
    jvm = spark._jvm
    read = {part for f in keep.inputFiles() for part in f.split("/")} if keep is not None else set()
    kept = [path for path in _written if path.rsplit("/", 1)[-1] in read]
    while _written:
        if (name := _written.pop()) not in kept:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _written.extend(kept)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text):
    """Column: the words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def bind(value, body):
    """Column: ``body(x)`` with x bound to ``value``, evaluated once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def give_back() -> None:
    """Returns memory that a worker has freed to the system; called at the end of a part, since workers stay."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def slices(batches, rows: int = 512):
    """Arrow batches in slices, so that what is made of a batch is not held for all its rows at once; gives memory back at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def look_up(rows: DataFrame, key: str, found: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` with the further columns of ``found``, which has one row for each ``key``; rows without one keep nulls.

    ``found`` is read twice, so it should be a table or a short plan.

    No key's rows meet in one task: the ``MOST_HOT`` most frequent keys (by ``counts``: key, n; else counted here) are
    looked up in a broadcast of as many rows at most, and their rows take no part in the shuffle by key; any other key has
    less than one in ``MOST_HOT`` of the rows.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    hot = counts.where(F.col("n") > HOT_ROWS).orderBy(F.desc("n")).limit(MOST_HOT).select(F.col(key).alias("hot_key"))
    values = [c for c in found.columns if c != key]
    held = F.broadcast(found.join(F.broadcast(hot), found[key] == F.col("hot_key")).select("hot_key", *[F.col(c).alias(f"hot_{c}") for c in values]))
    spread = rows.join(held, F.col(key) == F.col("hot_key"), "left").withColumn("hot_salt", F.when(F.col("hot_key").isNull(), F.lit(0)).otherwise(F.xxhash64(*rows.columns)))
    rest = found.select(F.col(key).alias("rest_key"), F.lit(0).cast("long").alias("rest_salt"), *[F.col(c).alias(f"rest_{c}") for c in values])
    joined = spread.join(rest, (F.col(key) == F.col("rest_key")) & (F.col("hot_salt") == F.col("rest_salt")), "left")
    return joined.select(*rows.columns, *[F.when(F.col("hot_key").isNull(), F.col(f"rest_{c}")).otherwise(F.col(f"hot_{c}")).alias(c) for c in values])
