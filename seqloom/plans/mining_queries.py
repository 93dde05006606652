"""Queries of clustering, cubes, learned models, sources and streams."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators import clustering as C
from seqloom.operators import distances as D
from seqloom.operators import models as M
from seqloom.operators import pairs as P
from seqloom.operators import triclusters as TR
from seqloom.sources import files, generators
from seqloom.streaming import events as EV

from .pair_queries import DIFFS, NAMES, nations, supplier_features
from .registry import query, rounded as R, table
from seqloom.sources.scratch import scratch, written

# --- clustering -------------------------------------------------------------------------------------------------------


def nation_events(spark, d) -> DataFrame:
    q = F.col("seq")
    return nations(spark, d).select("id", q["t"].alias("t"), q["e"].cast("array<int>").alias("e"))


@query("sequence_kmeans")
def sequence_kmeans(spark, d):
    return C.sequence_kmeans(nation_events(spark, d), "id", 3, 5, drop=1.0, rounds=3)


@query("sequence_agglomeration")
def sequence_agglomeration(spark, d):
    return spark.createDataFrame(C.agglomerate_sequences(nation_events(spark, d), "id", 4, 5), "id int, cluster int")


@query("ward_clusters")
def ward_clusters(spark, d):
    """Ward's clusters of nations by their customers' segments."""
    c = table(spark, d, "customer").groupBy("c_nationkey").pivot("c_mktsegment").agg(F.count(F.lit(1))).fillna(0)
    x = c.select(F.col("c_nationkey").alias("id"), F.array(*[F.col(n).cast("double") for n in c.columns[1:]]).alias("v"))
    ids, merges = C.ward(x, "id", "v")
    return spark.createDataFrame(list(zip(ids, C.cut(merges, len(ids), 4))), "id int, cluster int")


@query("vector_kmeans")
def vector_kmeans(spark, d):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=10, seed=1).fit(v).transform(v).select("vec_id", F.col("prediction").alias("cluster"))


@query("spectral_clusters")
def spectral_clusters(spark, d):
    return C.spectral(D.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", 8), 5, 8)


@query("hopkins")
def hopkins(spark, d):
    return spark.createDataFrame([(C.hopkins(table(spark, d, "embeddings"), "vec_id", "embedding"),)], "hopkins double")


@query("threshold_strata", "SELECT o_custkey, CASE WHEN avg(o_totalprice) < 100000 THEN 0 WHEN avg(o_totalprice) < 200000 THEN 1 ELSE 2 END AS stratum FROM orders GROUP BY 1")
def threshold_strata(spark, d):
    m = F.avg("o_totalprice")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.when(m < 100000, 0).when(m < 200000, 1).otherwise(2).alias("stratum"))


# --- cubes ------------------------------------------------------------------------------------------------------------

CUBE = """WITH c AS (SELECT year(l_shipdate) AS t, l_suppkey AS g, sum(l_quantity) AS q, max(l_extendedprice) AS p, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
x AS (SELECT t, g, unnest([0, 1, 2]) AS s, unnest([q, p, n]) AS val FROM c)"""
EDGES = CUBE + f""", r AS (SELECT a.t, a.s AS s1, b.s AS s2, a.g, round(b.val / a.val, 6) AS ratio FROM x a JOIN x b ON a.t = b.t AND a.g = b.g AND a.s < b.s WHERE a.val <> 0 AND b.val <> 0),
z AS (SELECT t, s1, s2, ratio, ln(ratio) AS size, list(g) OVER w AS g, max(ln(ratio)) OVER w AS fin FROM r WINDOW w AS (PARTITION BY t, s1, s2 ORDER BY ln(ratio) RANGE BETWEEN CURRENT ROW AND {math.log1p(0.02) + 1e-9!r} FOLLOWING)),
y AS (SELECT t, s1, s2, size, fin, min(ratio) AS low, any_value(g) AS g FROM z GROUP BY 1, 2, 3, 4, 5), e AS (SELECT t, s1, s2, low, list_sort(g) AS g FROM (SELECT *, lag(fin) OVER (PARTITION BY t, s1, s2 ORDER BY size) AS pre FROM y) WHERE len(g) >= 8 AND (pre IS NULL OR pre < fin))"""


def cube(spark, d) -> DataFrame:
    """Written once: a query's steps look at it several times, and lineitem is added up for it only then."""
    c = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("t"), F.col("l_suppkey").alias("g")).agg(F.sum("l_quantity").alias("q"), F.max("l_extendedprice").alias("p"), F.count("*").cast("double").alias("n"))
    return written(c.select("t", "g", F.posexplode(F.array("q", "p", "n")).alias("s", "val")), "cube")


@query("cube_ratio_edges", EDGES + " SELECT CAST(t AS INT) AS t, s1, s2, round(low, 6) AS low, array_to_string(g, ',') AS g FROM e")
def cube_ratio_edges(spark, d):
    e = TR.ratio_edges(cube(spark, d), 0.02, 8)
    return e.select("t", "s1", "s2", R(F.col("low")).alias("low"), F.concat_ws(",", F.transform("g", lambda x: x.cast("string"))).alias("g"))


@query("cube_biclusters", EDGES + """, b AS (SELECT t, [s1, s2] AS s, g FROM e UNION SELECT p.t, [0, 1, 2], list_sort(list_intersect(list_intersect(p.g, q.g), r.g)) FROM e p JOIN e q ON p.t = q.t AND p.s1 = 0 AND p.s2 = 1 AND q.s1 = 1 AND q.s2 = 2 JOIN e r ON r.t = p.t AND r.s1 = 0 AND r.s2 = 2 WHERE len(list_intersect(list_intersect(p.g, q.g), r.g)) >= 8)
SELECT DISTINCT CAST(t AS INT) AS t, array_to_string(s, ',') AS s, array_to_string(g, ',') AS g FROM b WHERE NOT EXISTS (SELECT 1 FROM b c WHERE c.t = b.t AND list_has_all(c.s, b.s) AND list_has_all(c.g, b.g) AND len(c.s) + len(c.g) > len(b.s) + len(b.g))""")
def cube_biclusters(spark, d):
    shown = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c)
    return TR.biclusters(TR.ratio_edges(cube(spark, d), 0.02, 8), 2, 8).select("t", shown("s"), shown("g"))


@query("cube_triclusters")
def cube_triclusters(spark, d):
    return TR.triclusters(cube(spark, d), 0.02, 2, 2, 4)


@query("cube_coverage", EDGES + ", k AS (SELECT t, unnest([s1, s2]) AS s, g FROM e), m AS (SELECT t, s, unnest(g) AS g FROM k) SELECT count(*) AS cells, count(DISTINCT (t, s, g)) AS covered, round((count(*) - count(DISTINCT (t, s, g))) / count(*), 6) AS overlap FROM m")
def cube_coverage(spark, d):
    e = TR.ratio_edges(cube(spark, d), 0.02, 8).select(F.array("t").alias("t"), F.array("s1", "s2").alias("s"), "g")
    return TR.coverage(e).withColumn("overlap", R(F.col("overlap")))


@query("cube_pattern_similarity", EDGES + """, p AS (SELECT e.t, s, any_value(array_to_string(e.g, ',')) AS gs, concat_ws('/', e.t, concat_ws(',', s1, s2), array_to_string(e.g, ',')) AS cluster, avg(nullif(val, 0)) AS p FROM e JOIN x ON x.t = e.t AND x.s IN (e.s1, e.s2) AND list_contains(e.g, x.g) GROUP BY e.t, s, cluster)
SELECT x.g, cluster, round(sqrt(sum((val - p) ** 2)), 5) AS distance, round(sum(val * p) / (sqrt(sum(val * val)) * sqrt(sum(p * p))), 6) AS cosine FROM p JOIN x ON x.t = p.t AND x.s = p.s GROUP BY 1, 2""")
def cube_pattern_similarity(spark, d):
    x = cube(spark, d)
    e = TR.ratio_edges(x, 0.02, 8).select(F.array("t").alias("t"), F.array("s1", "s2").alias("s"), "g")
    s = TR.pattern_similarity(x, TR.representative_patterns(x, e))
    return s.select("g", "cluster", R(F.col("distance"), 5).alias("distance"), R(F.col("cosine")).alias("cosine"))


def numbered_cubes(x: DataFrame) -> DataFrame:
    """Runs of the ratio edges of a cube as cubes of one time, numbered by a hash of what they hold."""
    e = TR.ratio_edges(x, 0.02, 8).select(F.array("t").alias("t"), F.array("s1", "s2").alias("s"), F.array_sort("g").alias("g"))
    number = F.conv(F.substring(F.md5(F.concat_ws("/", *[F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))) for c in ("t", "s", "g")])), 1, 12), 16, 10).cast("long")
    return e.select(number.alias("cube"), "t", "s", "g")


def _shown(cubes: DataFrame) -> DataFrame:
    return cubes.select(*[F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c) for c in ("t", "s", "g")])


@query("cubes_not_covered")
def cubes_not_covered(spark, d):
    """Cubes without those that a larger one that stays covers to three quarters."""
    return _shown(TR.drop_covered(numbered_cubes(cube(spark, d)), 0.75))


@query("cubes_merged")
def cubes_merged(spark, d):
    """Cubes merged while two fill all but two hundredths of the box around both."""
    return _shown(TR.merge_filled(numbered_cubes(cube(spark, d)), 0.98))


# --- learned models ---------------------------------------------------------------------------------------------------


def labelled_pairs(spark, d, parts: int = 1) -> DataFrame:
    """Differences of all pairs and their label, once for suppliers of equal features; n counts the pairs, held those whose
    hash ``parts`` divides.
    """
    from pyspark.ml.feature import VectorAssembler

    f = written(supplier_features(spark, d), "features")
    # the median from the sorted feature: one over all pairs holds every distinct difference in one task
    known = P.gaps(f, "mean")
    x = written(P.counted_differences(f, "id", NAMES, parts), "pairs")
    mid = known.percentiles([0.5])[0] if known else P.differences(P.pairs(f, "id"), "id", ["mean"]).agg(F.median("mean_diff")).first()[0]
    return VectorAssembler(inputCols=DIFFS, outputCol="features").transform(x.withColumn("label", (F.col("mean_diff") > F.lit(mid)).cast("int")))


@query("svm_distance_weights")
def svm_distance_weights(spark, d):
    """Weights of a distance: the coefficients of a linear SVM that tells pairs apart from pairs together."""
    from pyspark.ml.classification import LinearSVC

    m = LinearSVC(maxIter=20, regParam=0.01, weightCol="n").fit(labelled_pairs(spark, d))
    return spark.createDataFrame([*zip(DIFFS, map(float, m.coefficients)), ("intercept", float(m.intercept))], "feature string, weight double")


@query("classifiers")
def classifiers(spark, d):
    """Accuracy of logistic regression, a decision tree and boosted trees on held-out pairs."""
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    x = labelled_pairs(spark, d, 5)
    learn, test = x.withColumn("n", F.col("n") - F.col("held")).where("n > 0"), x.where("held > 0")
    score = MulticlassClassificationEvaluator(metricName="accuracy", weightCol="held")
    made = [("logistic", LogisticRegression(maxIter=20, weightCol="n")), ("tree", DecisionTreeClassifier(maxDepth=4, seed=1, weightCol="n")), ("boosted", GBTClassifier(maxIter=5, maxDepth=3, seed=1, weightCol="n"))]
    return spark.createDataFrame([(n, float(score.evaluate(m.fit(learn).transform(test)))) for n, m in made], "model string, accuracy double")


@query("permutation_importance")
def permutation_importance(spark, d):
    """How much accuracy a tree loses when a feature is dealt out anew among the pairs, in the mean of all ways to deal it."""
    from pyspark.ml.classification import DecisionTreeClassifier

    x = labelled_pairs(spark, d)
    model = DecisionTreeClassifier(maxDepth=4, seed=1, weightCol="n").fit(x)
    return spark.createDataFrame(list(zip(DIFFS, M.tree_losses(model, x, DIFFS, "label", "n"))), "feature string, loss double")


# --- sources and sinks ------------------------------------------------------------------------------------------------


@query("csv_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, d):
    path = scratch(spark, "nation-csv")
    files.write_csv(table(spark, d, "nation"), path, ";")
    return files.read_csv(spark, path, "n_nationkey INT, n_name STRING, n_regionkey INT", ";")


@query("json_round_trip", "SELECT event_id, event_type, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_type IN ('click', 'view')")
def json_round_trip(spark, d):
    path = scratch(spark, "events-json")
    e = table(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k INT").alias("props"))
    e.write.option("compression", "gzip").json(path)
    back = files.read_json_lines(spark, path, "event_id BIGINT, event_type STRING, props STRUCT<k: INT>", F.col("event_type").isin("click", "view"))
    return back.select("event_id", "event_type", "props.k")


@query("parquet_round_trip", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
def parquet_round_trip(spark, d):
    path = scratch(spark, "orders-parquet")
    files.write_parquet(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path, ["o_orderstatus"])
    return spark.read.parquet(path).where("o_orderstatus = 'O'").select("o_orderkey", "o_orderstatus")


@query("text_lookup", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2')")
def text_lookup(spark, d):
    path = scratch(spark, "sources-text")
    spark.createDataFrame([("src1",), (" src2 ",), ("",)], "value string").write.text(path)
    keep = files.read_lines(spark, path)
    return table(spark, d, "documents").join(F.broadcast(keep), F.col("source") == F.col("line"), "left_semi").select("doc_id")


UNIFORM = "('0x' || substr(md5('{0}|' || {1}), 1, 10))::BIGINT / 1099511627776.0::DOUBLE"


@query("generated_circle", f"WITH p AS (SELECT id, {UNIFORM.format(0, 'id')} * 2 - 1 AS x, {UNIFORM.format(7, 'id')} * 2 - 1 AS y FROM range(1000) r(id)) SELECT id, round(x, 9) AS x, round(y, 9) AS y, (x * x + y * y < 0.7 * 0.7)::INT AS label FROM p")
def generated_circle(spark, d):
    g = generators.circle(spark, 1000, 0.7)
    return g.select("id", R(F.col("x"), 9).alias("x"), R(F.col("y"), 9).alias("y"), "label")


@query("generated_sigmoids", f"""WITH p AS (SELECT id, 90 * j AS t, 0.003::DOUBLE + 0.01::DOUBLE * {UNIFORM.format(0, 'id')} AS k, 300 + 900 * {UNIFORM.format(5, 'id')} AS a, sqrt(-2 * ln(1 - {UNIFORM.format(11, "id || '|' || 90 * j")})) * cos(2 * pi() * {UNIFORM.format(12, "id || '|' || 90 * j")}) AS e FROM range(50) r(id), range(8) s(j))
SELECT id, CAST(t AS INT) AS t, round(greatest(least(48 / (1 + exp(k * (t - a))) + e, 48), 0), 6) AS v FROM p""")
def generated_sigmoids(spark, d):
    return generators.noisy_sigmoids(spark, 50, 8).select("id", "t", R(F.col("v")).alias("v"))


# --- streams ----------------------------------------------------------------------------------------------------------


@query("stream_windows", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 5) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    s = EV.window_counts(EV.read(spark, d, "events.parquet"), "1 day")
    out = EV.run_complete(s, scratch(spark, "stream-windows"), scratch(spark, "stream-state"))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", R(F.col("total"), 5).alias("total"))


@query("stream_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    s = EV.sessions(EV.read(spark, d, "events.parquet"), "12 hours")
    out = EV.run_complete(s, scratch(spark, "stream-sessions"), scratch(spark, "stream-state"))
    return out.select("user_id", F.unix_micros("start").alias("start"), "n")
