"""Queries of edit costs, warping within time, agreement of labellings, grids of clusterings, models of clusters, and drawn augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import alignment as A
from seqloom.operators import clustering as C
from seqloom.operators import evaluation as E
from seqloom.operators import models as M
from seqloom.operators import pairs as P
from seqloom.operators import weak as W

from .evaluation_queries import ARI, CALLED
from .pair_queries import _fold, nation_pairs
from .registry import query, rounded as R, table as T


@query("levenshtein_costs", _fold("list_transform(range(0, len(y) + 1), lambda j: j::DOUBLE)", "ea AS x, eb AS y FROM p",
    "list_concat([(i + 1)::DOUBLE], list_transform(range(1, len(y) + 1), lambda j: 0.5 * j + least((i + 1)::DOUBLE, list_min(list_transform(range(1, j + 1), lambda k: least(r[k + 1] + 1.5, r[k] + 0.75 * (x[i + 1] <> y[k])::INT) - 0.5 * k)))))", "round(r[len(r)]::DOUBLE, 6) + 0 AS edits"))
def levenshtein_costs(spark, d):
    """Insertions cost 0.5, deletions 1.5, substitutions 0.75."""
    return nation_pairs(spark, d).select("id1", "id2", R(A.levenshtein(F.col("a.e"), F.col("b.e"), insert=0.5, delete=1.5, substitute=0.75)).alias("edits"))


@query("levenshtein_matrix", _fold("list_transform(range(0, len(y) + 1), lambda j: j::DOUBLE)", "ea AS x, eb AS y FROM p",
    "list_concat([(i + 1)::DOUBLE], list_transform(range(1, len(y) + 1), lambda j: j + least((i + 1)::DOUBLE, list_min(list_transform(range(1, j + 1), lambda k: least(r[k + 1] + 1, r[k] + abs(x[i + 1] - y[k]) / 4.0) - k)))))", "round(r[len(r)]::DOUBLE, 6) + 0 AS edits"))
def levenshtein_matrix(spark, d):
    """Substitutions cost what a matrix of the codes says."""
    costs = [[abs(i - j) / 4 for j in range(5)] for i in range(5)]
    return nation_pairs(spark, d).select("id1", "id2", R(A.levenshtein(F.col("a.e"), F.col("b.e"), A.looked_up(costs))).alias("edits"))


POINTS = "list_transform(range(1, len({v}) + 1), lambda i: {{'t': {t}[i], 'v': {v}[i]}}) AS {out}"


@query("dtw_in_time", _fold("list_concat([0.0::DOUBLE], list_transform(y, lambda w: 1000000::DOUBLE))", POINTS.format(v="va", t="ta", out="x") + ", " + POINTS.format(v="vb", t="tb", out="y") + " FROM p",
    "list_concat([1000000::DOUBLE], list_transform(range(1, len(y) + 1), lambda j: s[j + 1] + list_min(list_transform(range(1, j + 1), lambda k: least(r[k + 1], r[k]) - s[k]))))", "CASE WHEN r[len(r)] < 1000000 THEN round(r[len(r)], 5) END AS dtw")
    .replace("abs(x[i + 1] - w)", "CASE WHEN (x[i + 1].t - w.t) * (x[i + 1].t - w.t) > 9 THEN 1000000 ELSE abs(x[i + 1].v - w.v) END"))
def dtw_in_time(spark, d):
    """Warping of values at most three quarters apart; NULL where no warping keeps to that."""
    found = A.dtw(F.col("a"), F.col("b"), A.in_time(9.0))
    return nation_pairs(spark, d).select("id1", "id2", R(F.when(found < A.INF, found), 5).alias("dtw"))


LABELLINGS = f"SELECT *, CAST(floor(length(predicted) / 2) AS INT) AS size FROM ({CALLED})"


@query("label_agreements", " UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, ari FROM ({ARI.format(x=f'SELECT {a} AS a, {b} AS b FROM ({LABELLINGS})')}) WHERE ari >= 0.2" for a, b in (("truth", "predicted"), ("truth", "size"), ("predicted", "size"))))
def label_agreements(spark, d):
    """Pairs of labellings whose adjusted Rand index is 0.2 at least."""
    m = F.col("o_totalprice") % 7
    p = F.when(m < 1.5, "1-URGENT").when(m < 3, "2-HIGH").when(m < 4, "3-MEDIUM").otherwise(F.col("o_orderpriority"))
    x = T(spark, d, "orders").select(F.col("o_orderpriority").alias("truth"), p.alias("predicted"), F.floor(F.length(p) / 2).alias("size"))
    return E.agreements(x, ["truth", "predicted", "size"], 0.2).withColumn("ari", R(F.col("ari")))


def nation_distances(spark, d, column: str):
    return nation_pairs(spark, d).select("id1", "id2", A.dtw(F.col(f"a.{column}"), F.col(f"b.{column}")).alias("d"))


@query("sequence_matrix_kmeans")
def sequence_matrix_kmeans(spark, d):
    """K-means on the rows of the matrix of the nations' warping distances."""
    return C.matrix_kmeans(nation_distances(spark, d, "v"), 3)


@query("best_neighbours")
def best_neighbours(spark, d):
    """Mean silhouettes of spectral clusterings with different numbers of neighbours."""
    found = C.best_neighbours(P.symmetric(nation_distances(spark, d, "v"), "d"), 3, [4, 8])
    return spark.createDataFrame(found, "neighbours int, silhouette double")


@query("clustering_grid")
def clustering_grid(spark, d):
    """Two measures by two methods by two numbers of clusters."""
    methods = {"matrix_kmeans": C.matrix_kmeans, "spectral": lambda e, k: C.spectral(P.symmetric(e, "d"), k, 6)}
    return C.workflows({"warped_values": nation_distances(spark, d, "v"), "warped_events": nation_distances(spark, d, "e")}, methods, [2, 3])


@query("cluster_curves")
def cluster_curves(spark, d):
    """A sigmoid and its band for the customers of each segment: orders' values, scaled, by the months since 1992."""
    o = T(spark, d, "orders").join(T(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    month = F.months_between(F.trunc("o_orderdate", "month"), F.lit("1992-01-01").cast("date"))
    return M.cluster_curves(o.select("c_mktsegment", month.alias("t"), (F.sqrt("o_totalprice") / 12).alias("v")), "c_mktsegment", "t", "v").withColumnRenamed("cluster", "segment")


@query("one_against_rest")
def one_against_rest(spark, d):
    """What tells orders of each status from the others, in two folds."""
    o = T(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).alias("day"), "o_totalprice")
    return M.one_against_rest(o, "o_orderkey", ["day", "o_totalprice"], "o_orderstatus", 2)


@query("augmented_each", r"""WITH c AS (SELECT doc_id, text, copy, list_transform(range(0, 3), lambda j: ('0x' || substr(md5(concat_ws('|', '5', doc_id::VARCHAR, copy::VARCHAR, j::VARCHAR)), 1, 8))::BIGINT % 1000000) AS h FROM documents, range(1, 3) r(copy)),
a AS (SELECT doc_id, text, copy, h, CASE WHEN h[1] < 500000 THEN regexp_replace(text, '\bthe\b', 'this', 'g') ELSE text END AS t FROM c), b AS (SELECT doc_id, text, copy, h, CASE WHEN h[2] < 250000 THEN replace(t, ',', '') ELSE t END AS t FROM a),
n AS (SELECT doc_id, text, copy, CASE WHEN h[3] < 750000 THEN regexp_replace(t, '^(\S+)', '\1 \1') ELSE t END AS t FROM b)
SELECT doc_id, 0 AS copy, CAST(length(text) AS INT) AS n_chars FROM documents UNION ALL SELECT doc_id, CAST(copy AS INT), CAST(length(t) AS INT) FROM n WHERE t <> text""")
def augmented_each(spark, d):
    """Documents and, for each, two copies that every transformation changes with its own probability."""
    swap = lambda t: F.regexp_replace(t, r"\bthe\b", "this")
    drop = lambda t: F.regexp_replace(t, r",", "")
    twice = lambda t: F.regexp_replace(t, r"^(\S+)", "$1 $1")
    made = W.augment_each(T(spark, d, "documents").select("doc_id", "text"), "doc_id", [swap, drop, twice], "text", [0.5, 0.25, 0.75], 2, seed=5)
    return made.select("doc_id", "copy", F.length("text").alias("n_chars"))
