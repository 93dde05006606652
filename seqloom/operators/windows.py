"""Operators on the ordered rows of an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshots(df: DataFrame, id: str, order: list[str], n: int, columns: list[str], ended=None) -> DataFrame:
    """(id, start, snapshot): every n rows in a row of an entity, as an array of structs.

    With ``ended``, a condition on a row, only those of whose first n - 1 rows none has ended.
    """
    w = Window.partitionBy(id).orderBy(*order)
    row = F.struct(*columns)
    out = df.select(id, (F.row_number().over(w) - 1).alias("start"), F.collect_list(row).over(w.rowsBetween(0, n - 1)).alias("snapshot")).where(F.size("snapshot") == n)
    return out if ended is None else out.where(~F.exists(F.slice("snapshot", 1, n - 1), ended))


def event_grid(df: DataFrame, id: str, t: str, code: str, granularity: int, empty: int) -> DataFrame:
    """(id, bucket, code): the largest code in each cell of a grid that all entities share; ``empty`` where there is none.

    Only the two ends of the grid are gathered; the cells are made by a sequence for each entity.
    """
    low, high = df.agg(F.min(t), F.max(t)).first()
    if low is None:
        return df.select(id, F.lit(0).alias("bucket"), F.col(code).cast("int").alias("code")).limit(0)
    last = (high - low) // granularity
    cells = df.select(id).distinct().select(id, F.explode(F.sequence(F.lit(0), F.lit(int(last)))).alias("bucket"))
    found = df.groupBy(id, F.floor((F.col(t) - low) / granularity).cast("int").alias("bucket")).agg(F.max(code).alias("code"))
    return cells.join(found, [id, "bucket"], "left").select(id, "bucket", F.coalesce("code", F.lit(empty)).cast("int").alias("code"))


def session_pairs(df: DataFrame, id: str, ts: str, key: str, gap_seconds: int) -> DataFrame:
    """(id, session, a, b): each row's key and the next one's, within sessions that end with a gap longer than given."""
    w = Window.partitionBy(id).orderBy(ts, key)
    gap = F.expr(f"timestampdiff(MICROSECOND, lag({ts}) OVER (PARTITION BY {id} ORDER BY {ts}, {key}), {ts})")
    cut = df.select(id, ts, key, F.when(gap > gap_seconds * 1_000_000, 1).otherwise(0).alias("cut"))
    sessions = cut.withColumn("session", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    b = F.lead(key).over(Window.partitionBy(id, "session").orderBy(ts, key))
    return sessions.select(id, "session", F.col(key).alias("a"), b.alias("b")).where("b IS NOT NULL")
