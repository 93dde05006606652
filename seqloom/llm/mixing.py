"""Mixing of sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document of a source gets a place in a shuffled order of that source; its virtual finish time is the number of
its source's words up to and including it, divided by the source's target.  A source whose target exceeds its size goes
round again, at most ``MAX_PASSES`` times.  The queue of all sources is sorted by finish time in ranges and cut where
the total budget is used up.

Cost: one pass over the texts (they are reduced to a word count at once), then shuffles of (doc_id, source, size) rows.
Running sums never need a source, or the whole queue, in one task: they are taken inside about sqrt(n) blocks and offset by the
running sums of the blocks' totals.  A document's place is a hash of its doc_id and text, so rows of a repeated or null
doc_id spread; rows that are equal in both are counted, queue as one entry and are told apart when the mix is known.

Defined cases: a null or blank text has size 0 and is taken 0 times; a very long text is one document, and a budget that
ends inside it ends before it; a null source is a source of its own, last in order; equal doc_ids are separate documents;
ties in finish time are taken together or not at all; an empty table gives an empty result; other columns are not looked at
by ``mix_plan``, whose result has none of them, and kept by ``mix``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import GAP, fresh, materialize, table

#: Weights dealt to the sources by code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_PASSES = 3

def word_count(text: Column) -> Column:
    """Number of words in a text; null: 0."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{GAP}|{GAP}\z", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, GAP))).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """Adds weight and target to rows of (source, source_size, ...), one for each source.

    Targets share the sum of all sizes by weight, no target exceeding ``max_passes`` times its source's size; what is
    cut off is shared by weight among the others.  That is min(cap, level * weight) with one level for all, found from
    running sums over the sources in order of cap / weight.  One row per source, so one task can hold them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    out = sizes.withColumn("weight", F.element_at(dealt, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    out = out.withColumn("cap", (F.col("source_size") * max_passes).cast("double"))
    ratio = F.col("cap") / F.col("weight")
    order = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    # the level if this source and those after it are not cut; right at the first source that this level leaves uncut
    out = out.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    uncut = F.col("level") * F.col("weight") <= F.col("cap")
    out = out.withColumn("level", F.min(F.when(uncut, F.struct(ratio.alias("ratio"), F.col("level")))).over(everything)["level"])
    target = F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap"))
    return out.withColumn("target", target).drop("cap", "level")


def mix_plan(docs: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and passes (how often the mix takes it)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    place = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), place.alias("place"))
    rows = materialize(rows.groupBy("doc_id", "source", "size", "place").agg(F.count("*").alias("copies")), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n_docs"))
    targets = materialize(source_targets(sizes, weights, max_passes), "mix-targets")
    queue = rows.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # the shuffled order is that of md5; its first digits cut a source of n entries into about sqrt(n) blocks, so
    # that neither a block nor the list of a source's blocks is long
    blocks = F.ceil(F.sqrt("n_docs"))
    queue = queue.withColumn("block", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * blocks / F.lit(2**32)))
    sums = queue.groupBy("source", "block").agg(F.sum(F.col("size") * F.col("copies")).alias("block_size"))
    running = F.sum("block_size").over(Window.partitionBy("source").orderBy("block"))
    offsets = sums.select(F.col("source").alias("s"), F.col("block").alias("b"), (running - F.col("block_size")).alias("offset"))
    inside = Window.partitionBy("source", "block").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queue = queue.withColumn("upto", F.sum(F.col("size") * F.col("copies")).over(inside))
    queue = queue.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    # copies of a row follow each other
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    queue = queue.withColumn("copy", copy).withColumn("upto", F.col("upto") + F.col("offset") - F.col("size") * (F.col("copies") - F.col("copy")))
    finish = [F.when(F.col("target") > 0, (F.col("upto") + F.col("source_size") * p).cast("double") / F.col("target")) for p in range(max_passes)]
    queue = materialize(queue.select("doc_id", "source", "size", "source_size", "target", F.array(*finish).alias("finish")), "mix-queue")
    cut = last_finish(queue)
    passes = F.size(F.filter("finish", lambda t: t <= F.lit(cut)))
    return queue.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, passes).otherwise(0).alias("passes"))


def last_finish(queue: DataFrame) -> float:
    """The latest finish time at which the queue's running sum is still within the budget, the sum of all sizes.

    The queue of n entries is dealt into about sqrt(n) ranges of finish time, and only the one in which the budget ends
    is sorted.  Returns a single number; -1 for an empty queue.
    """
    n, budget = queue.agg(F.count("*"), F.sum("size")).first()
    if not budget:
        return -1.0
    ranges = math.ceil(math.sqrt(n))
    times = queue.where("size > 0").select("size", F.explode("finish").alias("finish")).where("finish IS NOT NULL")
    times = times.withColumn("range", F.floor(F.col("finish") * ranges))
    upto = times.groupBy("range").agg(F.sum("size").alias("size"), F.max("finish").alias("last")).withColumn("upto", F.sum("size").over(Window.orderBy("range")))
    whole, at = upto.agg(F.max(F.when(F.col("upto") <= budget, F.col("last"))), F.min(F.when(F.col("upto") > budget, F.struct("range", (F.col("upto") - F.col("size")).alias("before"))))).first()
    part = None
    if at:
        ended = times.where(F.col("range") == at["range"]).withColumn("upto", F.sum("size").over(Window.partitionBy("range").orderBy("finish")))
        part = ended.where(F.col("upto") + at["before"] <= budget).agg(F.max("finish")).first()[0]
    return max(x for x in (whole, part, -1.0) if x is not None)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: every row of ``docs`` as often as the plan takes it, columns unchanged.

    Documents are matched to the plan by a row number given to them here, so equal doc_ids do no harm.
    """
    row, taken, passes = (fresh(docs, n) for n in ("mix_row", "mix_taken", "mix_passes"))
    marked = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs")
    plan = mix_plan(marked.select(F.col(row).alias("doc_id"), "source", "text"), **options)
    plan = plan.where("passes > 0").select(F.col("doc_id").alias(taken), F.col("passes").alias(passes))
    again = F.explode(F.sequence(F.lit(1), F.col(passes)))
    return marked.join(plan, F.col(row) == F.col(taken)).withColumn(taken, again).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_mix(spark, sf_dir: str) -> DataFrame:
    """Nulls, blank and very long texts, ties, repeated rows and an empty table: as the module states."""
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size")).cast("long").alias("taken"))


OP9_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS place
  FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM rows GROUP BY source),
levels AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         (sum(source_size) OVER ()::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sizes),
targets AS (
  SELECT source, source_size, coalesce(least(cap, weight * (SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap / weight, level LIMIT 1)), cap) AS target
  FROM levels),
queue AS (
  SELECT r.doc_id, r.size, t.source_size, t.target,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.place, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
times AS (
  SELECT size, (upto + p * source_size)::DOUBLE / target AS finish FROM queue, range(3) AS x(p) WHERE size > 0 AND target > 0),
cut AS (
  SELECT max(finish) AS cut FROM (SELECT finish, sum(size) OVER (ORDER BY finish) AS upto FROM times) WHERE upto <= (SELECT sum(size) FROM rows))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN size > 0 AND target > 0 THEN size * (((upto)::DOUBLE / target <= cut)::INT + ((upto + source_size)::DOUBLE / target <= cut)::INT + ((upto + 2 * source_size)::DOUBLE / target <= cut)::INT) ELSE 0 END AS BIGINT) AS taken
FROM queue, cut
"""
