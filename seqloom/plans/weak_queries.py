"""Queries of weak supervision, over documents with their labels and over pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import scalars
from seqloom.operators import pairs as P
from seqloom.operators import weak as W
from seqloom.sources.scratch import written

from .pair_queries import SUPPLIERS, supplier_features
from .registry import query, rounded as R, table


@W.labeling_function()
def symbols() -> Column:
    return F.when(F.regexp_count("text", F.lit("[#*$%&|]")) > 20, 0).otherwise(-1)


@W.labeling_function()
def shouting() -> Column:
    return F.when(F.col("text").rlike("[A-Z]{4,}!!"), 0).otherwise(-1)


@W.labeling_function()
def long_enough(least: int = 300) -> Column:
    return F.when(F.length("text") >= least, 1).otherwise(-1)


@W.labeling_function()
def sentences() -> Column:
    return F.when(F.regexp_count("text", F.lit(r"\.")) >= 3, 1).when(F.regexp_count("text", F.lit(r"\.")) == 0, 0).otherwise(-1)


@W.labeling_function()
def even_lines() -> Column:
    return F.when(F.regexp_count("text", F.lit("\n")) % 4 == 0, 1).when(F.regexp_count("text", F.lit("\n")) % 4 == 1, 0).otherwise(-1)


LFS = [symbols, shouting, long_enough, sentences, even_lines]
NAMES = [f.name for f in LFS]

VOTES = r"""WITH t AS (SELECT d.doc_id, d.lang, d.text, l.quality, len(regexp_extract_all(text, '[#*$%&|]')) AS sym, len(text) AS n, len(regexp_extract_all(text, '\.')) AS dots, len(regexp_extract_all(text, '\n')) AS nl FROM documents d LEFT JOIN labels l USING (doc_id)),
v AS (SELECT *, [CASE WHEN sym > 20 THEN 0 ELSE -1 END, CASE WHEN regexp_matches(text, '[A-Z]{4,}!!') THEN 0 ELSE -1 END, CASE WHEN n >= 300 THEN 1 ELSE -1 END, CASE WHEN dots >= 3 THEN 1 WHEN dots = 0 THEN 0 ELSE -1 END, CASE WHEN nl % 4 = 0 THEN 1 WHEN nl % 4 = 1 THEN 0 ELSE -1 END] AS votes FROM t)
"""


def documents(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return W.votes(docs, LFS).select("doc_id", "lang", "quality", "text", "votes")


@query("lf_votes", VOTES + "SELECT doc_id, votes[1] AS symbols, votes[2] AS shouting, votes[3] AS long_enough, votes[4] AS sentences, votes[5] AS even_lines FROM v")
def lf_votes(spark, d):
    return documents(spark, d).select("doc_id", *[F.col("votes")[j].alias(n) for j, n in enumerate(NAMES)])


@query("lf_summary", VOTES + """, e AS (SELECT quality, votes, list_filter(votes, lambda x: x <> -1) AS act, unnest(votes) AS vote, generate_subscripts(votes, 1) AS j FROM v)
SELECT ['symbols', 'shouting', 'long_enough', 'sentences', 'even_lines'][j] AS lf, CAST(list_sort(list(DISTINCT vote) FILTER (WHERE vote <> -1)) AS VARCHAR) AS polarity, round(avg((vote <> -1)::INT), 6) AS coverage, round(avg((vote <> -1 AND len(act) > 1)::INT), 6) AS overlaps,
round(avg((vote <> -1 AND len(list_filter(act, lambda x: x <> vote)) > 0)::INT), 6) AS conflicts, count(*) FILTER (WHERE vote <> -1 AND vote = quality) AS correct, count(*) FILTER (WHERE vote <> -1 AND vote <> quality) AS incorrect,
round(avg(CASE WHEN vote <> -1 THEN (vote = quality)::INT END), 6) AS accuracy FROM e GROUP BY j""")
def lf_summary(spark, d):
    a = W.analysis(documents(spark, d), NAMES, truth="quality")
    shown = F.concat(F.lit("["), F.array_join(F.col("polarity").cast("array<string>"), ", "), F.lit("]"))
    return a.select("lf", shown.alias("polarity"), *[R(F.col(c)).alias(c) for c in ("coverage", "overlaps", "conflicts")], "correct", "incorrect", R(F.col("accuracy")).alias("accuracy"))


@query("majority_vote", VOTES + ", c AS (SELECT doc_id, len(list_filter(votes, lambda x: x = 0)) AS a, len(list_filter(votes, lambda x: x = 1)) AS b FROM v) SELECT doc_id, CASE WHEN a = b THEN -1 WHEN a > b THEN 0 ELSE 1 END AS label FROM c")
def majority_vote(spark, d):
    return documents(spark, d).select("doc_id", W.majority().alias("label"))


@query("lf_filter_unlabeled", VOTES + "SELECT doc_id FROM v WHERE len(list_filter(votes, lambda x: x <> -1)) > 0")
def lf_filter_unlabeled(spark, d):
    return documents(spark, d).where(W.voted()).select("doc_id")


@query("lf_buckets", VOTES + "SELECT votes[3] AS long_enough, votes[5] AS even_lines, count(*) AS n FROM v GROUP BY 1, 2")
def lf_buckets(spark, d):
    v = F.col("votes")
    return documents(spark, d).groupBy(v[2].alias("long_enough"), v[4].alias("even_lines")).agg(F.count("*").alias("n"))


@query("vote_histogram", VOTES + "SELECT len(list_filter(votes, lambda x: x <> -1)) AS votes, count(*) AS n FROM v GROUP BY 1")
def vote_histogram(spark, d):
    return documents(spark, d).groupBy(F.size(F.filter("votes", lambda x: x != -1)).cast("long").alias("votes")).agg(F.count("*").alias("n"))


MODEL = VOTES + """, s AS (SELECT doc_id, votes, list_transform(votes, lambda x: CASE x WHEN 1 THEN 1.0::DOUBLE WHEN 0 THEN -1.0::DOUBLE END) AS s FROM v),
ix AS (SELECT unnest([1, 2, 3, 4, 5]) AS i), m AS (SELECT a.i, b.i AS j, avg(s[a.i] * s[b.i]) AS m FROM s, ix a, ix b WHERE a.i <> b.i GROUP BY 1, 2),
f AS (SELECT x.i, sqrt(abs(x.m * y.m / z.m)) AS b FROM m x JOIN m y ON x.i = y.i AND x.j < y.j JOIN m z ON z.i = x.j AND z.j = y.j WHERE x.m IS NOT NULL AND y.m IS NOT NULL AND z.m IS NOT NULL AND abs(z.m) > 1e-3),
acc AS (SELECT ix.i, (1 + coalesce(least(greatest(median(b), 0.02), 0.96), 0.4)) / 2 AS a FROM ix LEFT JOIN f USING (i) GROUP BY ix.i)"""


@query("label_model", MODEL + ", z AS (SELECT doc_id, sum(coalesce(s[i], 0) * ln(a / (1 - a))) AS z FROM s, acc GROUP BY 1) SELECT doc_id, round(1 / (1 + exp(-z)), 6) AS probability, CASE WHEN round(z, 9) > 0 THEN 1 WHEN round(z, 9) < 0 THEN 0 ELSE -1 END AS label FROM z")
def label_model(spark, d):
    docs = documents(spark, d)
    model = W.LabelModel().fit(docs, len(LFS))
    return docs.select("doc_id", R(model.probability()).alias("probability"), model.predict().alias("label"))


@query("label_model_accuracies", MODEL + " SELECT ['symbols', 'shouting', 'long_enough', 'sentences', 'even_lines'][i] AS lf, round(a, 6) AS accuracy FROM acc")
def label_model_accuracies(spark, d):
    model = W.LabelModel().fit(documents(spark, d), len(LFS))
    return spark.createDataFrame(list(zip(NAMES, model.accuracy)), "lf string, accuracy double").select("lf", R(F.col("accuracy")).alias("accuracy"))


@query("em_accuracies")
def em_accuracies(spark, d):
    a = W.em_accuracies(documents(spark, d), len(LFS))
    return spark.createDataFrame(list(zip(NAMES, a)), "lf string, accuracy double")


@query("pairs_quartile_votes", SUPPLIERS + ", q AS (SELECT quantile_cont(mean_diff, 0.25) AS m1, quantile_cont(mean_diff, 0.75) AS m3, quantile_cont(hcs_diff, 0.25) AS h1, quantile_cont(hcs_diff, 0.75) AS h3 FROM p) SELECT id1, id2, CASE WHEN mean_diff <= m1 THEN 0 WHEN mean_diff >= m3 THEN 1 ELSE -1 END AS by_mean, CASE WHEN hcs_diff <= h1 THEN 0 WHEN hcs_diff >= h3 THEN 1 ELSE -1 END AS by_hcs FROM p, q")
def pairs_quartile_votes(spark, d):
    f = written(supplier_features(spark, d).select("id", "mean", "hcs"), "features")
    p = P.differences(P.pairs(f, "id"), "id", ["mean", "hcs"])
    return W.votes(p, [W.quartile_lf(p, f"{n}_diff", P.gaps(f, n)) for n in ("mean", "hcs")]).select("id1", "id2", F.col("votes")[0].alias("by_mean"), F.col("votes")[1].alias("by_hcs"))


@query("worker_votes", """WITH x AS (SELECT user_id % 5 AS worker, event_type, CASE WHEN value > 50 THEN 1 ELSE 0 END AS label, event_id FROM events),
y AS (SELECT (event_id // 7) AS item, worker, arg_min(label, event_id) AS label FROM x GROUP BY 1, 2)
SELECT item, coalesce(max(label) FILTER (WHERE worker = 0), -1) AS w0, coalesce(max(label) FILTER (WHERE worker = 1), -1) AS w1, coalesce(max(label) FILTER (WHERE worker = 2), -1) AS w2, coalesce(max(label) FILTER (WHERE worker = 3), -1) AS w3, coalesce(max(label) FILTER (WHERE worker = 4), -1) AS w4 FROM y GROUP BY 1""")
def worker_votes(spark, d):
    x = table(spark, d, "events").select(F.floor(F.col("event_id") / 7).alias("item"), F.concat(F.lit("w"), F.col("user_id") % 5).alias("worker"), F.when(F.col("value") > 50, 1).otherwise(0).alias("label"), "event_id")
    first = x.groupBy("item", "worker").agg(F.min_by("label", "event_id").alias("label"))
    return W.worker_votes(first, "item", "worker", "label")


@query("keyword_lf", VOTES + "SELECT doc_id, CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'copyright') THEN 0 ELSE -1 END AS vote FROM v")
def keyword_lf(spark, d):
    return table(spark, d, "documents").select("doc_id", W.keyword_lf("text", ["License", "copyright"], 0).column().alias("vote"))


@query("slice_metrics", VOTES + """, y AS (SELECT lang, n, quality AS t, CASE WHEN votes[1] = 0 THEN 0 ELSE 1 END AS p FROM v WHERE quality IS NOT NULL), s AS (SELECT 'short' AS slice, t, p FROM y WHERE n < 500 UNION ALL SELECT 'english', t, p FROM y WHERE lang = 'en' UNION ALL SELECT 'all', t, p FROM y)
SELECT slice, count(*) AS n, round(avg((t = p)::INT), 6) AS accuracy, round(2.0 * count(*) FILTER (WHERE t = 1 AND p = 1) / (count(*) FILTER (WHERE t = 1) + count(*) FILTER (WHERE p = 1)), 6) AS f1 FROM s GROUP BY 1""")
def slice_metrics(spark, d):
    docs = documents(spark, d).where("quality IS NOT NULL").withColumn("p", F.when(F.col("votes")[0] == 0, 0).otherwise(1))
    out = W.slice_metrics(docs, {"short": F.length("text") < 500, "english": F.col("lang") == "en", "all": F.lit(True)}, "quality", "p")
    return out.select("slice", "n", R(F.col("accuracy")).alias("accuracy"), R(F.col("f1")).alias("f1"))


@query("probabilities_to_labels", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > l_tax THEN 0 WHEN l_tax > l_discount THEN 1 ELSE -1 END AS label FROM lineitem")
def probabilities_to_labels(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.argmax_label(F.array("l_discount", "l_tax")).alias("label"))


@query("augmented", r"""WITH c AS (SELECT doc_id, text, copy, (('0x' || substr(md5(concat_ws('|', '3', doc_id::VARCHAR, copy::VARCHAR)), 1, 8))::BIGINT % 1000000) % 3 AS j FROM documents, range(1, 3) r(copy)),
n AS (SELECT doc_id, text, copy, CASE j WHEN 0 THEN regexp_replace(text, '\bthe\b', 'this', 'g') WHEN 1 THEN replace(text, ',', '') ELSE regexp_replace(text, '^(\S+)', '\1 \1') END AS t FROM c)
SELECT doc_id, 0 AS copy, CAST(length(text) AS INT) AS n_chars FROM documents UNION ALL SELECT doc_id, CAST(copy AS INT), CAST(length(t) AS INT) FROM n WHERE t <> text""")
def augmented(spark, d):
    """Documents and, for each, two drawn transformations of its text."""
    swap = lambda t: F.regexp_replace(t, r"\bthe\b", "this")
    drop = lambda t: F.regexp_replace(t, r",", "")
    twice = lambda t: F.regexp_replace(t, r"^(\S+)", "$1 $1")
    made = W.augment(table(spark, d, "documents").select("doc_id", "text"), "doc_id", [swap, drop, twice], "text", 2, seed=3)
    return made.select("doc_id", "copy", F.length("text").alias("n_chars"))
