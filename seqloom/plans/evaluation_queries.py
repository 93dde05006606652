"""Queries of the evaluation, survival and statistics operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import scalars
from seqloom.operators import distances as D
from seqloom.operators import evaluation as E
from seqloom.operators import pairs as P
from seqloom.operators import statistics as ST
from seqloom.operators import survival as SV

from .registry import query, rounded as R, table

# predicted: the priority's first digit by the size of the order
CALLED = "SELECT o_orderpriority AS truth, CASE WHEN o_totalprice % 7 < 1.5 THEN '1-URGENT' WHEN o_totalprice % 7 < 3 THEN '2-HIGH' WHEN o_totalprice % 7 < 4 THEN '3-MEDIUM' ELSE o_orderpriority END AS predicted FROM orders"
COUNTS = f"""WITH x AS ({CALLED}), c AS (SELECT truth, predicted, count(*) AS n FROM x GROUP BY 1, 2), k AS (SELECT truth AS label FROM c UNION SELECT predicted FROM c),
r AS (SELECT label, coalesce(sum(n) FILTER (WHERE truth = label AND predicted = label), 0)::DOUBLE AS tp, coalesce(sum(n) FILTER (WHERE truth <> label AND predicted = label), 0)::DOUBLE AS fp,
coalesce(sum(n) FILTER (WHERE truth = label AND predicted <> label), 0)::DOUBLE AS fn, coalesce(sum(n) FILTER (WHERE truth <> label AND predicted <> label), 0)::DOUBLE AS tn FROM k, c GROUP BY 1)
"""


def called(spark, d) -> DataFrame:
    m = F.col("o_totalprice") % 7
    p = F.when(m < 1.5, "1-URGENT").when(m < 3, "2-HIGH").when(m < 4, "3-MEDIUM").otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("truth"), p.alias("predicted"))


@query("confusion_matrix", f"WITH x AS ({CALLED}) SELECT truth, predicted, count(*) AS n FROM x GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return E.confusion(called(spark, d), "truth", "predicted")


@query("class_rates", COUNTS + "SELECT label, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(tn / nullif(tn + fn, 0), 6) AS npv, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM r")
def class_rates(spark, d):
    return E.class_rates(called(spark, d), "truth", "predicted").select("label", *[R(F.col(c)).alias(c) for c in ("precision", "recall", "specificity", "npv", "f1")])


@query("averaged_rates", COUNTS + """SELECT round(avg(tn / (tn + fp)), 6) AS specificity_macro, round(sum(tn / (tn + fp) * (tp + fn)) / sum(tp + fn), 6) AS specificity_weighted, round(sum(tn) / sum(tn + fp), 6) AS specificity_micro,
round(avg(tn / (tn + fn)), 6) AS npv_macro, round(sum(tn / (tn + fn) * (tp + fn)) / sum(tp + fn), 6) AS npv_weighted, round(sum(tn) / sum(tn + fn), 6) AS npv_micro, round(sum(tp) / sum(tp + fn), 6) AS accuracy FROM r""")
def averaged_rates(spark, d):
    rates = E.class_rates(called(spark, d), "truth", "predicted")
    out = rates.agg(*E.averaged(rates, "specificity", "tn", "fp"), *E.averaged(rates, "npv", "tn", "fn"), F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"))
    return out.select(*[R(F.col(c)).alias(c) for c in out.columns])


@query("entropy_by_group", "WITH c AS (SELECT c_nationkey AS nation, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), p AS (SELECT nation, n / sum(n) OVER (PARTITION BY nation) AS p FROM c) SELECT nation, round(-sum(p * log2(p)), 6) + 0 AS entropy, round(-sum(p * log2(p)) / nullif(log2(count(*)), 0), 6) + 0 AS normalised, count(*) AS k FROM p GROUP BY 1")
def entropy_by_group(spark, d):
    e = E.entropy(table(spark, d, "customer").withColumnRenamed("c_nationkey", "nation"), "c_mktsegment", ["nation"])
    return e.select("nation", R(F.col("entropy")).alias("entropy"), R(F.col("normalised")).alias("normalised"), "k")


ARI = """WITH x AS ({x}), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM x GROUP BY 1, 2), t AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM c),
r AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY a)), k AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT round((t.s - r.s * k.s / (t.n * (t.n - 1) / 2)) / ((r.s + k.s) / 2 - r.s * k.s / (t.n * (t.n - 1) / 2)), 6) + 0 AS ari FROM t, r, k"""


@query("adjusted_rand", ARI.format(x=f"SELECT truth AS a, predicted AS b FROM ({CALLED})"))
def adjusted_rand(spark, d):
    return E.adjusted_rand(called(spark, d), "truth", "predicted").select(R(F.col("ari")).alias("ari"))


def embedding_edges(spark, d) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), "label")
    return P.pairs(v, "vec_id").select(F.col("a.vec_id").alias("id1"), F.col("b.vec_id").alias("id2"), scalars.euclidean(F.col("a.e"), F.col("b.e")).alias("d"))


EDGES = "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings), d AS (SELECT a.id AS i, a.label AS la, b.label AS lb, b.id AS j, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.id <> b.id)"


@query("silhouette", EDGES + ", m AS (SELECT i, la, lb, avg(d) AS m FROM d GROUP BY ALL), s AS (SELECT i, la, max(m) FILTER (WHERE la = lb) AS a, min(m) FILTER (WHERE la <> lb) AS b FROM m GROUP BY 1, 2) SELECT la AS label, count(*) AS n, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) + 0 AS mean, round(stddev_pop(coalesce((b - a) / greatest(a, b), 0)), 6) AS std FROM s GROUP BY 1")
def silhouette(spark, d):
    s = E.vector_silhouettes(table(spark, d, "embeddings"), "vec_id", "embedding", "label")
    return s.groupBy("label").agg(F.count("*").alias("n"), R(F.avg("silhouette")).alias("mean"), R(F.stddev_pop("silhouette")).alias("std"))


@query("medoid_by_label", EDGES + ", t AS (SELECT la AS label, i, round(sum(d), 6) AS total FROM d WHERE la = lb GROUP BY 1, 2) SELECT label, arg_min(i, struct_pack(a := total, b := i)) AS medoid, min(total) AS total FROM t GROUP BY 1")
def medoid_by_label(spark, d):
    v = table(spark, d, "embeddings")
    labels = v.select(F.col("vec_id").alias("id"), "label")
    own = D.totals_by_label(v, "vec_id", "embedding", "label").join(labels, "id").where("label = other")
    totals = own.select("label", F.col("id").alias("id1"), R(F.col("total")).alias("total"))
    return totals.groupBy("label").agg(P.medoid(totals, "total").alias("medoid"), F.min("total").alias("total"))


@query("nearest_neighbour", EDGES + " SELECT i AS id, arg_min(j, struct_pack(a := round(d, 6), b := j)) AS nearest, round(min(d), 6) AS d FROM d GROUP BY 1")
def nearest_neighbour(spark, d):
    return D.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", 1, 6).select(F.col("id1").alias("id"), F.col("id2").alias("nearest"), "d")


@query("spread_indices", """WITH x AS (SELECT vec_id AS id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
c AS (SELECT label, dim, avg(x) AS c, count(*) AS n FROM x GROUP BY 1, 2), m AS (SELECT dim, avg(x) AS m FROM x GROUP BY 1),
b AS (SELECT sum(n * (c - m) ** 2) AS b, count(DISTINCT label) AS k FROM c JOIN m USING (dim)),
a AS (SELECT id, label, sum((x - c) ** 2) AS d2 FROM x JOIN c USING (label, dim) GROUP BY 1, 2), w AS (SELECT sum(d2) AS w, count(*) AS n FROM a), s AS (SELECT label, avg(sqrt(d2)) AS s FROM a GROUP BY 1),
p AS (SELECT u.label AS la, v.label AS lb, sqrt(sum((u.c - v.c) ** 2)) AS m FROM c u JOIN c v USING (dim) WHERE u.label <> v.label GROUP BY 1, 2),
r AS (SELECT la, max((y.s + z.s) / m) AS r FROM p JOIN s y ON y.label = la JOIN s z ON z.label = lb GROUP BY 1)
SELECT round(b * (n - k) / (w * (k - 1)), 6) AS calinski_harabasz, (SELECT round(avg(r), 6) FROM r) AS davies_bouldin FROM b, w""")
def spread_indices(spark, d):
    out = E.spread(table(spark, d, "embeddings"), "vec_id", "embedding", "label")
    return out.select(*[R(F.col(c)).alias(c) for c in out.columns])


@query("pareto_parts", """WITH p AS (SELECT p_partkey, p_retailprice AS a, p_size::DOUBLE AS b FROM part) SELECT p_partkey, NOT EXISTS (SELECT 1 FROM p q WHERE q.a <= p.a AND q.b <= p.b AND (q.a < p.a OR q.b < p.b)) AS on_front FROM p""")
def pareto_parts(spark, d):
    return E.pareto(table(spark, d, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("size")), "p_partkey", ["p_retailprice", "size"]).select("p_partkey", "on_front")


@query("roc_auc", "WITH x AS (SELECT quality AS y, n_chars % 1000 AS s FROM labels JOIN documents USING (doc_id)) SELECT round((SELECT avg(CASE WHEN p.s > q.s THEN 1.0 WHEN p.s = q.s THEN 0.5 ELSE 0 END) FROM x p, x q WHERE p.y = 1 AND q.y <> 1), 6) AS auc")
def roc_auc(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("quality", (F.col("n_chars") % 1000).alias("s"))
    return E.auc(x, "quality", "s").select(R(F.col("auc")).alias("auc"))


@query("matching_percentage", """WITH x AS (SELECT c_custkey AS id, c_mktsegment AS cluster, CASE WHEN c_acctbal < 0 THEN -1 WHEN c_acctbal < 4000 THEN 0 ELSE 1 END AS vote FROM customer),
p AS (SELECT c_nationkey, count(*) FILTER (WHERE vote <> -1) AS n, count(*) FILTER (WHERE vote <> -1 AND (vote = 1) = (cluster IN ('BUILDING', 'MACHINERY'))) AS hit FROM x JOIN customer ON c_custkey = id GROUP BY 1)
SELECT c_nationkey AS nation, round(100.0 * hit / nullif(n, 0), 6) AS matching FROM p""")
def matching_percentage(spark, d):
    c = table(spark, d, "customer")
    vote = F.when(F.col("c_acctbal") < 0, -1).when(F.col("c_acctbal") < 4000, 0).otherwise(1)
    x = c.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("cluster"), vote.alias("vote")).where("vote <> -1")
    return c.select(F.col("c_nationkey").alias("nation")).distinct().join(x.groupBy("nation").agg(R(100 * F.avg(((F.col("vote") == 1) == F.col("cluster")).cast("int"))).alias("matching")), "nation", "left")


# --- survival ---------------------------------------------------------------------------------------------------------

LIVES = """WITH x AS (SELECT c_mktsegment AS grp, o_custkey, date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) // 90 AS t, bool_or(o_orderstatus = 'F') AS e FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def lives(spark, d) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    days = F.date_diff(F.to_date(F.max("o_orderdate")), F.to_date(F.min("o_orderdate")))
    return o.groupBy(F.col("c_mktsegment").alias("grp"), "o_custkey").agg(F.floor(days / 90).alias("t"), F.bool_or(F.col("o_orderstatus") == "F").alias("e"))


KM = LIVES + """, y AS (SELECT grp, t, count(*) AS n, count(*) FILTER (WHERE e) AS d FROM x GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY t DESC) AS at_risk FROM y),
k AS (SELECT grp, t, at_risk::BIGINT AS at_risk, d, product(1 - d / at_risk) OVER (PARTITION BY grp ORDER BY t) AS s FROM r)"""


@query("km_curve", KM + " SELECT grp, t, at_risk, d, round(s, 6) + 0 AS survival FROM k")
def km_curve(spark, d):
    return SV.kaplan_meier(lives(spark, d), "grp", "t", "e").withColumn("survival", R(F.col("survival")))


@query("km_median", KM + " SELECT grp, min(t) FILTER (WHERE s <= 0.5) AS median FROM k GROUP BY 1")
def km_median(spark, d):
    return SV.median_survival(SV.kaplan_meier(lives(spark, d), "grp", "t", "e"))


LOGRANK = LIVES + """, g AS (SELECT DISTINCT grp FROM x), p AS (SELECT a.grp AS group1, b.grp AS group2 FROM g a JOIN g b ON a.grp < b.grp),
t AS (SELECT DISTINCT group1, group2, t FROM p JOIN x ON grp IN (group1, group2) WHERE e),
n AS (SELECT group1, group2, t.t, count(*) FILTER (WHERE x.t >= t.t)::DOUBLE AS n, count(*) FILTER (WHERE x.t >= t.t AND grp = group1)::DOUBLE AS n1, count(*) FILTER (WHERE x.t = t.t AND e)::DOUBLE AS d, count(*) FILTER (WHERE x.t = t.t AND e AND grp = group1)::DOUBLE AS d1 FROM t JOIN x ON grp IN (group1, group2) GROUP BY 1, 2, 3),
v AS (SELECT *, d1 - d * n1 / n AS oe, CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END AS v FROM n)
SELECT group1, group2, round(sum(oe) ** 2 / sum(v), 6) + 0 AS logrank, round(sum(oe * n) ** 2 / sum(v * n * n), 6) + 0 AS wilcoxon FROM v GROUP BY 1, 2"""


@query("logrank_pairs", LOGRANK)
def logrank_pairs(spark, d):
    s = SV.logrank(lives(spark, d), "grp", "t", "e")
    return s.select("group1", "group2", R(F.col("logrank")).alias("logrank"), R(F.col("wilcoxon")).alias("wilcoxon"))


@query("logrank_p_values", LOGRANK.replace("SELECT group1, group2, round(sum(oe) ** 2 / sum(v), 6) + 0 AS logrank, round(sum(oe * n) ** 2 / sum(v * n * n), 6) + 0 AS wilcoxon FROM v GROUP BY 1, 2", """, q AS (SELECT group1, group2, sum(oe) ** 2 / sum(v) AS x FROM v GROUP BY 1, 2), z AS (SELECT *, sqrt(x / 2) AS z FROM q),
e AS (SELECT *, CASE WHEN z > 1 THEN exp(-z * z) / sqrt(pi()) / list_reduce(range(600, 0, -1), lambda a, k: z + k / 2.0::DOUBLE / a, z) ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(60), lambda k: (-1) ** k * z ** (2 * k + 1) / (gamma(k + 1) * (2 * k + 1)))) END AS p FROM z)
SELECT group1, group2, format('{:.3e}', p) AS p_value, round(max(p) OVER (), 6) AS p_max, round(min(x) OVER (), 6) AS statistic_min FROM e"""))
def logrank_p_values(spark, d):
    """The least statistic and the largest p-value over all pairs of groups, and each p-value as text."""
    s = SV.logrank(lives(spark, d), "grp", "t", "e")
    tail = F.udf(SV.chi2_tail, "double")  # a handful of rows
    p = s.select("group1", "group2", tail("logrank").alias("p"), F.col("logrank"))
    return p.select("group1", "group2", F.format_string("%.3e", "p").alias("p_value"), R(F.max("p").over(Window.partitionBy())).alias("p_max"), R(F.min("logrank").over(Window.partitionBy())).alias("statistic_min"))


# --- statistics -------------------------------------------------------------------------------------------------------


@query("cramers_v", """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), r AS (SELECT a, sum(n) AS na FROM c GROUP BY 1), k AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1), t AS (SELECT sum(n) AS t FROM c),
f AS (SELECT (coalesce(n, 0) - na * nb / t) ** 2 / (na * nb / t) AS part FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.a = r.a AND c.b = k.b)
SELECT round(sum(part), 6) AS chi2, round(sqrt(sum(part) / ((SELECT t FROM t) * least((SELECT count(*) FROM r) - 1, (SELECT count(*) FROM k) - 1))), 6) AS cramers_v FROM f""")
def cramers_v(spark, d):
    out = ST.cramers_v(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    return out.select(R(F.col("chi2")).alias("chi2"), R(F.col("cramers_v")).alias("cramers_v"))


RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2"


@query("spearman", f"WITH r AS (SELECT {RANK.format('l_quantity')} AS a, {RANK.format('l_extendedprice')} AS b FROM lineitem) SELECT round(corr(a, b), 6) AS spearman FROM r")
def spearman(spark, d):
    return ST.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(R(F.col("spearman")).alias("spearman"))


@query("kruskal", f"""WITH r AS (SELECT l_returnflag AS g, l_quantity AS v, {RANK.format('l_quantity')} AS r FROM lineitem), b AS (SELECT g, sum(r) AS s, count(*)::DOUBLE AS n FROM r GROUP BY 1), t AS (SELECT sum(m ** 3 - m) AS ties FROM (SELECT count(*)::DOUBLE AS m FROM r GROUP BY v)),
h AS (SELECT 12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1) AS h, sum(n) AS n, count(*) AS groups FROM b) SELECT round(h, 5) + 0 AS h, round(h / (1 - ties / (n ** 3 - n)), 5) + 0 AS h_corrected, groups FROM h, t""")
def kruskal(spark, d):
    out = ST.kruskal(table(spark, d, "lineitem"), "l_quantity", "l_returnflag")
    return out.select(R(F.col("h"), 5).alias("h"), R(F.col("h_corrected"), 5).alias("h_corrected"), "groups")


@query("correlations", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS qp, round(corr(l_quantity, l_discount), 6) + 0 AS qd, round(corr(l_extendedprice, l_tax), 6) + 0 AS pt FROM lineitem")
def correlations(spark, d):
    c = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    m = ST.correlation_matrix(table(spark, d, "lineitem"), c)
    row = (m[c[0], c[1]], m[c[0], c[2]], m[c[1], c[3]])
    return spark.createDataFrame([row], "qp double, qd double, pt double").select(*[R(F.col(n)).alias(n) for n in ("qp", "qd", "pt")])


@query("drop_correlated")
def drop_correlated(spark, d):
    x = table(spark, d, "lineitem").withColumn("total", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    kept = ST.drop_correlated(x, ["l_quantity", "l_extendedprice", "total"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "total"], "pearson")
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@query("principal_features")
def principal_features(spark, d):
    x = table(spark, d, "lineitem").withColumn("total", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return spark.createDataFrame([(c,) for c in ST.principal_features(x, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "total"])], "feature string")
