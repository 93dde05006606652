"""Exact top-k search by inner product, by a three-phase uniform threshold.

The components of the vectors are cut into ``LISTS`` stretches; a stretch is one list of partial scores for each query,
and a vector's score is the sum over the lists.

1. Gather: every part of the vectors returns, for each query, the scores of the vectors that are among the first k of one
   of its local lists; the k-th best of these over all parts is the query's cutoff, below which no result can be.
2. Collect: the cutoff goes to all parts.  A score that reaches it needs the cutoff's equal share, the cutoff divided by
   the number of lists, in one list at least, and a list can give no more than the product of the two stretches' lengths.
   So vectors that can't have the share in any list are passed over; the others go from list to list, and are given up
   for a query as soon as what they have so far and the most that the lists to come can give fall short of the cutoff.
3. Resolve: what is left has met all its lists, so its score is exact; those that reach the cutoff are ranked, and a part
   returns no more than k of a query.

The queries are taken in blocks of a bounded number, each of which is sent to all parts; queries never meet as rows of a
join, and neither queries nor vectors are gathered beyond one block.

Vectors are turned once into floor(1024 * x) of each component as a double, and kept as flat bytes.  Scores are exact:
products are summed as doubles where no sum can reach 2**53, as Python integers otherwise (cut to the range of a long).

Defined cases: a vector that is null, empty or holds a null or non-finite component (or one that is not finite after the
scaling) takes no part, as query or candidate; vectors meet only vectors of their own length; a row is told from others by
a number of its own, so each row of a repeated vec_id is a query with its own results and a candidate of the others; null
vec_ids take no part; ties go to the smaller vec_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, table

LISTS = 4
#: Queries in a block: 4096 of 64 doubles are 2 MB, 1024 dimensions 32 MB.
BLOCK = 4_096
#: Queries and vectors whose scores are held at once.
QUERIES_AT_ONCE, ROWS_AT_ONCE = 256, 2_048
SCALE = 1024
#: A pair scored by itself costs about as much as so many in a product of matrices.
ALONE = 8
#: Room for rounding in bounds, as a share of their size.
SLACK = 1e-9


def scaled(vec_ids: pa.Array, column: pa.Array) -> pa.RecordBatch:
    """(vec_id, n, x): floor(1024 * x) of the vectors that take part, as bytes of doubles."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(SCALE * column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    upto = np.cumsum(n)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ok = (n > 0) & (bad[upto] == bad[upto - n]) & vec_ids.is_valid().to_numpy(zero_copy_only=False)
    sizes = 8 * n[ok]
    data = flat[np.repeat(ok, n)].astype("<f8").tobytes()
    offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64).tobytes())
    x = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, offsets, pa.py_buffer(data)]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([vec_ids.filter(pa.array(ok)), pa.array(n[ok].astype(np.int32)), x], names=["vec_id", "n", "x"])


def prepared(vectors: DataFrame, is_query: Column) -> DataFrame:
    """(row, vec_id, n, asked, x) of the vectors that take part, scaled once; ``row`` is a number of each row's own."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(at, ROWS_AT_ONCE)
                yield scaled(some.column(0), some.column(1))

    # asked of the vec_id alone is asked again of the result, so that the vectors' other columns need not travel
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, n int, x binary")
    return materialize(given.select(F.monotonically_increasing_id().alias("row"), "vec_id", "n", F.coalesce(is_query, F.lit(False)).alias("asked"), "x"), "vectors")


def lengths(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Length of each vector's stretches, a column for each list."""
    return np.stack([np.sqrt(np.einsum("ij,ij->i", x[:, a:b], x[:, a:b])) for a, b in zip(edges, edges[1:])], axis=1)


class Queries:
    """A block of queries of one length."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, lists: int):
        self.rows, self.vectors = rows, vectors
        self.edges = np.linspace(0, vectors.shape[1], min(lists, vectors.shape[1]) + 1).astype(int)
        self.most = float(np.abs(vectors).max(initial=0))
        with np.errstate(over="ignore"):
            self.lengths = lengths(vectors, self.edges)

    def exact(self, x: np.ndarray) -> bool:
        """Whether no sum of products with rows of x can reach 2**53."""
        return self.most * float(np.abs(x).max(initial=0)) * x.shape[1] < 2**53


def _long(x) -> int:
    return max(-(2**63), min(2**63 - 1, int(x)))


def whole_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as Python integers cut to the range of a long, for vectors too large for doubles."""
    return np.array([[_long(sum(int(a) * int(b) for a, b in zip(r, s))) for s in x.tolist()] for r in q.tolist()], dtype=np.int64).reshape(len(q), len(x))


def gather(rows: np.ndarray, vectors: np.ndarray, queries: Queries, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1 in one part: (query index, score) of up to k vectors a query, from the first k of each of its lists."""
    found_q, found_s = [], []
    for qa in range(0, len(queries.rows), QUERIES_AT_ONCE):
        q, best = queries.vectors[qa : qa + QUERIES_AT_ONCE], None
        for xa in range(0, len(rows), ROWS_AT_ONCE):
            x, number = vectors[xa : xa + ROWS_AT_ONCE], rows[xa : xa + ROWS_AT_ONCE]
            own = queries.rows[qa : qa + len(q), None] == number[None, :]
            if not queries.exact(x):
                score, there = whole_scores(q, x).astype(np.float64), ~own
            else:
                lists = [q[:, a:b] @ x[:, a:b].T for a, b in zip(queries.edges, queries.edges[1:])]
                there = np.zeros(own.shape, dtype=bool)
                for p in lists:
                    first = np.argpartition(np.where(own, np.inf, -p), min(k, len(x)) - 1, axis=1)[:, :k]
                    np.put_along_axis(there, first, True, axis=1)
                there &= ~own
                at = np.nonzero(there)
                score = np.zeros(own.shape)
                score[at] = sum(p[at] for p in lists)
            score = np.where(there, score, -np.inf)
            both = score if best is None else np.concatenate([best, score], axis=1)
            best = -np.partition(-both, k - 1, axis=1)[:, :k] if both.shape[1] > k else both
        if best is not None:
            i, j = np.nonzero(np.isfinite(best))
            found_q.append(qa + i)
            found_s.append(best[i, j])
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(found_q), np.concatenate(found_s)


def collect(q: np.ndarray, q_lengths: np.ndarray, x: np.ndarray, edges: np.ndarray, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3 for some queries and vectors: (query, vector, score) of all pairs whose score reaches the cutoff."""
    low = np.where(np.isfinite(cutoff), cutoff - SLACK * np.abs(cutoff) - 0.5, -np.inf)
    x_lengths, m = lengths(x, edges), len(edges) - 1
    # the share that one list at least must give
    able = (q_lengths.max(axis=0)[None, :] * x_lengths * (1 + SLACK)).max(axis=1) >= low.min() / m
    cols = np.flatnonzero(able)
    if not len(cols):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    x_lengths = x_lengths[cols]
    rows, so_far = np.arange(len(q)), np.zeros((len(q), len(cols)))
    for i in range(m):
        a, b = edges[i], edges[i + 1]
        so_far = so_far + q[rows, a:b] @ x[cols, a:b].T
        open_ = so_far + (q_lengths[rows, i + 1 :] @ x_lengths[:, i + 1 :].T) * (1 + SLACK) >= low[rows, None]
        left = np.count_nonzero(open_)
        r_left, c_left = open_.any(axis=1), open_.any(axis=0)
        if i + 1 < m and left * ALONE < np.count_nonzero(r_left) * np.count_nonzero(c_left):
            r, c = np.nonzero(open_)
            score = so_far[r, c]
            r, c = rows[r], cols[c]
            return _alone(r, c, score, q, x, edges[i + 1 :], q_lengths[:, i + 1 :], lengths(x, edges)[:, i + 1 :], low)
        rows, cols, x_lengths, so_far = rows[r_left], cols[c_left], x_lengths[c_left], so_far[np.ix_(r_left, c_left)]
    r, c = np.nonzero(so_far >= low[rows, None])
    return rows[r], cols[c], so_far[r, c]


def _alone(r, c, score, q, x, edges, q_lengths, x_lengths, low):
    """Goes on with ``collect`` for single pairs, over the lists between ``edges``."""
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        for at in range(0, len(r), 1 << 16):
            part = slice(at, at + (1 << 16))
            score[part] += np.einsum("ij,ij->i", q[r[part], a:b], x[c[part], a:b])
        open_ = score + np.einsum("ij,ij->i", q_lengths[r, i + 1 :], x_lengths[c, i + 1 :]) * (1 + SLACK) >= low[r]
        r, c, score = r[open_], c[open_], score[open_]
    return r, c, score


def best_of(q: np.ndarray, vec_ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best of each query: higher scores first, ties to the smaller vec_id."""
    order = np.lexsort((vec_ids, -score, q))
    place = np.arange(len(order))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], q[order][1:] != q[order][:-1]]), place, 0)) if len(order) else place
    return order[place - first < k]


def resolve(rows: np.ndarray, vec_ids: np.ndarray, vectors: np.ndarray, queries: Queries, cutoff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3 in one part: (query index, vec_id, score) of the best k vectors whose score reaches the cutoff."""
    got = [(np.zeros(0, np.int64),) * 3]
    for xa in range(0, len(rows), ROWS_AT_ONCE):
        x, number, names = vectors[xa : xa + ROWS_AT_ONCE], rows[xa : xa + ROWS_AT_ONCE], vec_ids[xa : xa + ROWS_AT_ONCE]
        exact = queries.exact(x)
        for qa in range(0, len(queries.rows), QUERIES_AT_ONCE):
            q, low = queries.vectors[qa : qa + QUERIES_AT_ONCE], cutoff[qa : qa + QUERIES_AT_ONCE]
            if exact:
                r, c, s = collect(q, queries.lengths[qa : qa + len(q)], x, queries.edges, low)
                s = np.rint(s).astype(np.int64)
            else:
                score = whole_scores(q, x)
                r, c = np.nonzero(score.astype(np.float64) >= low[:, None])
                s = score[r, c]
            other = queries.rows[qa + r] != number[c]
            got.append((qa + r[other], names[c[other]], s[other]))
        q, names, s = (np.concatenate(p) for p in zip(*got))
        keep = best_of(q, names, s, k)
        got = [(q[keep], names[keep], s[keep])]
    return got[0]


def _read(batches, queries: dict[int, Queries]):
    """(length, rows, vec_ids, vectors) of the vectors of each length that queries have, a batch at a time."""
    for batch in batches:
        sizes = batch.column(2).to_numpy(zero_copy_only=False)
        for n in set(sizes.tolist()) & queries.keys():
            some = batch.filter(pa.array(sizes == n))
            vectors = np.frombuffer(b"".join(v.as_buffer() for v in some.column(3)), "<f8").reshape(-1, n)
            yield n, some.column(0).to_numpy(), some.column(1).to_numpy(), vectors


def _search_block(vectors: DataFrame, queries: dict[int, Queries], k: int) -> DataFrame:
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(queries)

    def first(batches):
        # no more than k scores for each query and part
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, rows, _, x in _read(batches, sent.value):
            q, s = gather(rows, x, sent.value[n], k)
            if n in best:
                q, s = np.concatenate([best[n][0], q]), np.concatenate([best[n][1], s])
                keep = best_of(q, np.zeros(len(q)), s, k)
                q, s = q[keep], s[keep]
            best[n] = q, s
        for n, (q, s) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(sent.value[n].rows[q]), pa.array(s)], names=["query", "score"])

    sides = vectors.select("row", "vec_id", "n", "x")
    gathered = sides.mapInArrow(first, "query long, score double")
    ranked = gathered.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"))))
    cutoffs = {r[0]: r[1] for r in ranked.where(F.col("place") == k).select("query", "score").collect()}  # one number for each query of the block
    cut = spark.sparkContext.broadcast({n: np.array([cutoffs.get(int(i), -np.inf) for i in q.rows]) for n, q in queries.items()})

    def second(batches):
        best: dict[int, list[np.ndarray]] = {}
        for n, rows, vec_ids, x in _read(batches, sent.value):
            got = resolve(rows, vec_ids, x, sent.value[n], cut.value[n], k)
            if n in best:
                got = [np.concatenate(p) for p in zip(best[n], got)]
                keep = best_of(*got, k)
                got = [p[keep] for p in got]
            best[n] = got
        for n, (q, v, s) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(sent.value[n].rows[q]), pa.array(v), pa.array(s)], names=["query", "vec_id", "score"])

    return sides.mapInArrow(second, "query long, vec_id long, score long")


def search(vectors: DataFrame, is_query: Column, k: int = 10, lists: int = LISTS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query among (vec_id, embedding) rows.

    ``is_query`` is a condition on vec_id.
    """
    vectors = prepared(vectors, is_query)
    asked = vectors.where("asked")
    blocks = max(1, math.ceil(1.1 * asked.count() / block))
    found = []
    for b in range(blocks):
        by_length: dict[int, list] = {}
        for r in asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "vec_id", "n", "x").collect():
            by_length.setdefault(r["n"], []).append(r)
        if by_length:
            queries = {n: Queries(np.array([r["row"] for r in rows], np.int64), np.frombuffer(b"".join(r["x"] for r in rows), "<f8").reshape(-1, n), lists) for n, rows in by_length.items()}
            found.append(materialize(_search_block(vectors, queries, k), "topk"))
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    ranked = out.withColumn("rank", rank).where(F.col("rank") <= k)
    names = asked.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return ranked.join(names, "query").select("query_id", "rank", "vec_id", "score")


def op7_topk(spark, sf_dir: str) -> DataFrame:
    """Nulls, empty and odd vectors, repeated ids, ties and an empty table: as the module states; texts don't occur."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP7_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.row AS query, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.row <> q.row AND len(q.e) = len(c.e)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INT) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
