"""Queries of sources, positions, formats, windows of pairs, survival summaries, cluster quality and further weak supervision."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import alignment as A
from seqloom.functions import scalars
from seqloom.functions import sequences as S
from seqloom.operators import distances as D
from seqloom.operators import evaluation as E
from seqloom.operators import pairs as P
from seqloom.operators import relational as RL
from seqloom.operators import statistics as ST
from seqloom.operators import survival as SV
from seqloom.operators import weak as W
from seqloom.sources import files, generators
from seqloom.sources.scratch import scratch, written

from .evaluation_queries import KM, lives
from .pair_queries import SUPPLIERS, nation_pairs, supplier_sequences
from .registry import query, rounded as R, table as T
from .weak_queries import VOTES, documents

# --- positions, splits, formats ---------------------------------------------------------------------------------------


@query("columns_by_position", "SELECT n_nationkey, n_name FROM nation")
def columns_by_position(spark, d):
    return RL.by_position(T(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), 0, -1)


@query("columns_reordered", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def columns_reordered(spark, d):
    return RL.reordered(T(spark, d, "customer").select("c_acctbal", "c_mktsegment", "c_custkey"), ["c_mktsegment"], ["c_acctbal"])


@query("rows_side_by_side", """WITH a AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS place FROM nation), b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS place FROM supplier)
SELECT place, n_name, s_suppkey FROM a FULL JOIN b USING (place)""")
def rows_side_by_side(spark, d):
    """Two tables next to each other by their rows' places."""
    a, b = T(spark, d, "nation").select("n_nationkey", "n_name"), T(spark, d, "supplier").select("s_suppkey")
    return RL.side_by_side(a, "n_nationkey", b, "s_suppkey").select("place", "n_name", "s_suppkey")


@query("split_numbers", "SELECT o_orderkey, list_sum(list_filter(list_transform(regexp_split_to_array(concat(o_orderkey, ';', o_custkey, ',x,', o_orderkey % 7), '[;,]'), lambda x: try_cast(x AS BIGINT)), lambda x: x IS NOT NULL))::BIGINT AS total FROM orders")
def split_numbers(spark, d):
    text = F.concat(F.col("o_orderkey").cast("string"), F.lit(";"), F.col("o_custkey").cast("string"), F.lit(",x,"), (F.col("o_orderkey") % 7).cast("string"))
    return T(spark, d, "orders").select("o_orderkey", F.aggregate(scalars.split_ints(text), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("number_formats", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'NA' ELSE format('{:.3e}', (o_totalprice::DOUBLE + 0.003::DOUBLE) / 7) END AS shown,
format('{:.2f} ({:.2f}-', (o_orderkey % 1000) / 7.0::DOUBLE, (o_orderkey % 100) / 7.0::DOUBLE) || CASE WHEN o_orderstatus = 'P' THEN 'NA' ELSE format('{:.2f}', (o_custkey % 100) / 7.0::DOUBLE) END || ')' AS span FROM orders""")
def number_formats(spark, d):
    known = lambda c: F.when(F.col("o_orderstatus") != "P", c)
    price = (F.col("o_totalprice").cast("double") + 0.003) / 7
    parts = (F.col("o_orderkey") % 1000) / F.lit(7.0), (F.col("o_orderkey") % 100) / F.lit(7.0), known((F.col("o_custkey") % 100) / F.lit(7.0))
    return T(spark, d, "orders").select("o_orderkey", scalars.scientific(known(price)).alias("shown"), scalars.interval_text(*parts).alias("span"))


@query("ngram_ranges", """WITH w AS (SELECT doc_id, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram FROM w, range(1, 6) r(n))
SELECT n, count(*) AS grams, count(DISTINCT gram) AS distinct_grams FROM g GROUP BY 1""")
def ngram_ranges(spark, d):
    """Runs of one to five tokens over all documents, and how many different ones there are."""
    w = F.filter(F.split(F.lower("text"), " "), lambda x: x != "")
    tokens = T(spark, d, "documents").select(w.alias("w"))
    grams = tokens.select(F.explode(scalars.ngrams(F.col("w"), 1, 5)).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("c")).withColumn("n", F.size(F.split("gram", " ")).cast("long"))
    return counts.groupBy("n").agg(F.sum("c").alias("grams"), F.count("*").alias("distinct_grams"))


@query("text_guard", "SELECT event_id, try_cast(v AS DOUBLE) IS NULL AND v IS NOT NULL AS is_text FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN value::VARCHAR END AS v FROM events)")
def text_guard(spark, d):
    v = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, F.col("value").cast("string"))
    return T(spark, d, "events").select("event_id", scalars.is_text(v).alias("is_text"))


# --- sources and sinks ------------------------------------------------------------------------------------------------


@query("timed_events_file", "SELECT user_id AS num_patient, string_agg(event_type, '>' ORDER BY event_id, event_type) AS path, max(event_id)::DOUBLE AS last FROM events GROUP BY 1")
def timed_events_file(spark, d):
    """A file of entity;event;time rows, read as one sequence an entity."""
    path = scratch(spark, "timed-events")
    e = T(spark, d, "events").select(F.col("user_id").alias("num_patient"), F.col("event_type").alias("event_name"), F.col("event_id").cast("double").alias("difftime"))
    files.write_csv(e, path, ";")
    q = files.read_timed_events(spark, path)
    return q.select("num_patient", F.array_join(F.col("events")["event_name"], ">").alias("path"), F.element_at("events", -1)["difftime"].alias("last"))


@query("many_files", "SELECT CAST(n_regionkey + 1 AS INT) AS part, n_nationkey, n_name FROM nation")
def many_files(spark, d):
    """A folder of files with headers, each row with its file's ordinal."""
    path, n = scratch(spark, "many-files"), T(spark, d, "nation")
    for (k,) in sorted(tuple(r) for r in n.select("n_regionkey").distinct().collect()):  # five regions
        n.where(F.col("n_regionkey") == k).select(F.col("n_nationkey").alias("N_NATIONKEY"), F.col("n_name").alias("N_NAME")).coalesce(1).write.option("header", True).csv(f"{path}/file{k}")
    return files.read_many_csv(spark, f"{path}/*", "N_NATIONKEY INT, N_NAME STRING").select(F.col("part").cast("int"), "n_nationkey", "n_name")


@query("word_vectors", "SELECT 'w' || vec_id AS word, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 4) + 0 AS total FROM embeddings")
def word_vectors(spark, d):
    """A file of words and their vectors without header or quotes."""
    path = scratch(spark, "word-vectors")
    numbers = F.array_join(F.transform(F.col("embedding").cast("array<double>"), lambda x: x.cast("string")), " ")
    T(spark, d, "embeddings").select(F.concat(F.lit("w"), F.col("vec_id").cast("string"), F.lit(" "), numbers).alias("value")).write.text(path)
    return files.read_word_vectors(spark, path).select("word", F.size("vector").cast("long").alias("n"), R(S.total(F.col("vector")), 4).alias("total"))


@query("matrix_file", "SELECT a.r_regionkey AS id1, a.r_name AS class, abs(a.r_regionkey - 0)::DOUBLE AS d0, abs(a.r_regionkey - 2)::DOUBLE AS d2 FROM region a")
def matrix_file(spark, d):
    """Distances of regions as a matrix with a class column."""
    path, r = scratch(spark, "matrix"), T(spark, d, "region").select("r_regionkey", "r_name")
    both = P.pairs(r, "r_regionkey", ordered=True).select(F.col("a.r_regionkey").alias("id1"), F.col("b.r_regionkey").alias("id2"), F.abs(F.col("a.r_regionkey") - F.col("b.r_regionkey")).cast("double").alias("d"))
    own = r.select(F.col("r_regionkey").alias("id1"), F.col("r_regionkey").alias("id2"), F.lit(0.0).alias("d"))
    files.write_matrix(both.unionByName(own), r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("label")), "d", path)
    back = files.read_csv(spark, path)
    return back.select(F.col("id1").cast("int").alias("id1"), "class", F.col("0").cast("double").alias("d0"), F.col("2").cast("double").alias("d2"))


@query("small_sample", "WITH s AS (SELECT c_custkey FROM customer WHERE ('0x' || substr(md5(concat_ws('|', '4', c_custkey::VARCHAR, c_nationkey::VARCHAR)), 1, 8))::BIGINT < 858993459) SELECT c_custkey, count(o_orderkey) AS n FROM s LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def small_sample(spark, d):
    """A share of the customers and the orders that refer to them."""
    c, o = T(spark, d, "customer").select("c_custkey", "c_nationkey"), T(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    some, related = files.small_sample(c, o, "c_custkey", 0.2, seed=4)
    return some.join(related.groupBy("c_custkey").agg(F.count("*").alias("n")), "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


UNIFORM = "('0x' || substr(md5('{0}|' || {1}), 1, 10))::BIGINT / 1099511627776.0::DOUBLE"


@query("generated_squares", f"""WITH p AS (SELECT id, {UNIFORM.format(3, 'id')} * 2 - 1 AS x, {UNIFORM.format(10, 'id')} * 2 - 1 AS y FROM range(1000) r(id))
SELECT id, round(x, 9) AS x, round(y, 9) AS y, (abs(x) < 0.5 AND abs(y) < 0.5)::INT AS label FROM p""")
def generated_squares(spark, d):
    g = generators.square(spark, 1000, 1.0, seed=3)
    return g.select("id", R(F.col("x"), 9).alias("x"), R(F.col("y"), 9).alias("y"), "label")


@query("generated_survival", f"SELECT id, round(-ln(1 - {UNIFORM.format(5, 'id')}) * 20, 6) + 0 AS duration, {UNIFORM.format(8, 'id')} >= 0.3 AS event FROM range(500) r(id)")
def generated_survival(spark, d):
    return generators.survival(spark, 500, 20.0, 0.3, seed=5).select("id", R(F.col("duration")).alias("duration"), "event")


# --- pairs ------------------------------------------------------------------------------------------------------------

#: Windows of the pair differences, in months: (suffix, after, up to).
WINDOWS = (("3m", None, 3), ("6m", None, 6), ("3m6m", 3, 6))


def _in_window(after, upto, alias="") -> str:
    return f"{alias}t <= {upto}" + (f" AND {alias}t > {after}" if after is not None else "")


@query("pairs_windowed", SUPPLIERS + ", " + ", ".join(f"""w{n} AS (SELECT id, (arg_max(v, k) - arg_min(v, k)) / (max(t) - min(t)) AS slope FROM l WHERE {_in_window(a, b)} GROUP BY id HAVING count(*) >= 2),
h{n} AS (SELECT id, min((v2 - v) / (t2 - t)) AS hcs FROM (SELECT id, t, v, lead(t) OVER x AS t2, lead(v) OVER x AS v2 FROM l WHERE {_in_window(a, b)} WINDOW x AS (PARTITION BY id ORDER BY k)) GROUP BY id HAVING count(*) >= 2)""" for n, a, b in WINDOWS) + " SELECT id1, id2, round(abs((a.lv - a.fv) / a.fv - (b.lv - b.fv) / b.fv), 6) AS variation_diff, " + ", ".join(f"round(abs(a{n}.slope - b{n}.slope), 6) AS slope_diff_{n}, round(abs(c{n}.hcs - e{n}.hcs), 6) AS hcs_diff_{n}" for n, _, _ in WINDOWS) + " FROM p JOIN f a ON a.id = id1 JOIN f b ON b.id = id2 " + " ".join(f"LEFT JOIN w{n} a{n} ON a{n}.id = id1 LEFT JOIN w{n} b{n} ON b{n}.id = id2 LEFT JOIN h{n} c{n} ON c{n}.id = id1 LEFT JOIN h{n} e{n} ON e{n}.id = id2" for n, _, _ in WINDOWS))
def pairs_windowed(spark, d):
    """Differences of relative variation, and of slopes and steepest falls inside windows; null unless both have two points."""
    q = F.col("seq")
    made = {"variation": S.relative_variation(q)}
    for n, a, b in WINDOWS:
        inside = S.between(q, a, b)
        made |= {f"slope_{n}": S.bind(inside, lambda w: F.when(F.size(w) >= 2, S.slope(w))), f"hcs_{n}": S.bind(inside, lambda w: F.when(F.size(w) >= 2, S.min_step_slope(w)))}
    features = supplier_sequences(spark, d).select("id", *[c.alias(n) for n, c in made.items()])
    out = P.differences(P.pairs(features, "id"), "id", list(made))
    shown = lambda n: f"{n.split('_')[0]}_diff" + (f"_{n.split('_')[1]}" if "_" in n else "")
    return out.select("id1", "id2", *[R(F.col(f"{n}_diff")).alias(shown(n)) for n in made])


@query("breakpoint_differences")
def breakpoint_differences(spark, d):
    """By how many points the simplified sequences of two nations differ."""
    count = A.metric(A.breakpoints, "long")
    points = lambda s: count(F.transform(F.col(f"{s}.t"), lambda x: x.cast("double")), F.col(f"{s}.v"))
    return nation_pairs(spark, d).select("id1", "id2", F.abs(points("a") - points("b")).alias("breakpoint_diff"))


# --- survival, cluster quality, selection of nominal features ----------------------------------------------------------


@query("survival_summary", KM + """, c AS (SELECT *, sum(CASE WHEN at_risk > d THEN d / (at_risk * (at_risk - d))::DOUBLE END) OVER (PARTITION BY grp ORDER BY t) AS g FROM k),
b AS (SELECT *, CASE WHEN s > 0 AND s < 1 THEN pow(s, exp(1.959963984540054 * sqrt(g) / -ln(s))) ELSE s END AS lo, CASE WHEN s > 0 AND s < 1 THEN pow(s, exp(-1.959963984540054 * sqrt(g) / -ln(s))) ELSE s END AS hi FROM c)
SELECT grp, max(at_risk) AS n, min(t) FILTER (WHERE s <= 0.5) AS median, min(t) FILTER (WHERE lo <= 0.5) AS median_low, min(t) FILTER (WHERE hi <= 0.5) AS median_high FROM b GROUP BY 1""")
def survival_summary(spark, d):
    """Median survival with its confidence interval and the number of entities, for each group."""
    return SV.survival_summary(lives(spark, d), "grp", "t", "e")


@query("internal_quality", """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings), d AS (SELECT a.id AS i, a.label AS la, b.label AS lb, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.id <> b.id),
m AS (SELECT i, la, lb, avg(d) AS m FROM d GROUP BY ALL), s AS (SELECT i, max(m) FILTER (WHERE la = lb) AS a, min(m) FILTER (WHERE la <> lb) AS b FROM m GROUP BY 1),
x AS (SELECT id, label, unnest(e) AS x, generate_subscripts(e, 1) AS dim FROM v), c AS (SELECT label, dim, avg(x) AS c, count(*) AS n FROM x GROUP BY 1, 2), t AS (SELECT dim, avg(x) AS m FROM x GROUP BY 1),
b AS (SELECT sum(n * (c - m) ** 2) AS b, count(DISTINCT label) AS k FROM c JOIN t USING (dim)), w AS (SELECT sum((x - c) ** 2) AS w, count(DISTINCT id) AS n FROM x JOIN c USING (label, dim)),
p AS (SELECT count(*) / sum(count(*)) OVER () AS p, count(*) OVER () AS k FROM v GROUP BY label)
SELECT round((SELECT avg(coalesce((b - a) / greatest(a, b), 0)) FROM s), 6) + 0 AS silhouette_avg, round((SELECT stddev_pop(coalesce((b - a) / greatest(a, b), 0)) FROM s), 6) AS silhouette_std, round(b * (n - k) / (w * (k - 1)), 5) AS calinski_harabasz,
round((SELECT -sum(p * log2(p)) / log2(max(k)) FROM p), 6) AS entropy, round((SELECT 100 * avg(((la <> lb)::INT = (d > 1)::INT)::INT) FROM d WHERE d <= 0.9 OR d > 1), 6) AS matching FROM b, w""")
def internal_quality(spark, d):
    """The bundle of internal quality measures; pairs vote apart beyond a distance of 1, together up to 0.9."""
    v = T(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    totals = written(D.totals_by_label(v, "id", "vector", "label", (0.9, 1.0)), "totals")
    s, m = E.vector_silhouettes(v, "id", "vector", "label", totals), E.vector_matching(v, "id", "label", totals)
    out = E.internal_quality(None, v.select("id", "label"), v.select("id", "vector"), silhouette=s, matching=m)
    return out.select(*[R(F.col(c)).alias(c) for c in ("silhouette_avg", "silhouette_std")], R(F.col("calinski_harabasz"), 5).alias("calinski_harabasz"), R(F.col("entropy")).alias("entropy"), R(F.col("matching")).alias("matching"))


@query("nominal_not_associated")
def nominal_not_associated(spark, d):
    """Nominal columns left when of each pair with Cramer's V of 0.7 or more the first goes; two of them say the same."""
    x = T(spark, d, "orders").select("o_orderstatus", "o_orderpriority", F.substring("o_orderpriority", 1, 1).alias("priority"))
    return spark.createDataFrame([(c,) for c in ST.drop_associated(x, x.columns)], "feature string")


@query("nominal_not_explained")
def nominal_not_explained(spark, d):
    """Nominal columns whose groups differ in no numeric one; returnflag does by construction of the score."""
    x = T(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_tax", (F.col("l_quantity") + F.when(F.col("l_returnflag") == "A", 20).otherwise(0)).alias("score"))
    return spark.createDataFrame([(c,) for c in ST.drop_explained(x, ["l_returnflag", "l_linestatus"], ["score"])], "feature string")


# --- weak supervision -------------------------------------------------------------------------------------------------


@query("lf_preprocessed", "SELECT doc_id, CASE WHEN len(string_split(t, ' ')) < 40 THEN 0 WHEN contains(t, 'the the') THEN 0 ELSE -1 END AS vote FROM (SELECT doc_id, lower(replace(text, E'\\n', ' ')) AS t FROM documents)")
def lf_preprocessed(spark, d):
    """A vote on columns that preprocessors made, the second from the first's."""
    flat = lambda df: {"flat": F.lower(F.replace("text", F.lit("\n"), F.lit(" ")))}
    words = lambda df: {"n_tokens": F.size(F.split("flat", " "))}
    made = W.preprocessed(T(spark, d, "documents"), flat, words)
    lf = W.LabelingFunction("brief", lambda: F.when(F.col("n_tokens") < 40, 0).when(F.contains("flat", F.lit("the the")), 0).otherwise(-1))
    return W.votes(made, [lf]).select("doc_id", F.col("votes")[0].alias("vote"))


#: A toy lexicon of frequent words.
TONES = {"the": 0.5, "and": -0.25, "of": 0.25, "der": -0.5, "und": -0.75, "que": 1.0, "de": 0.125}


@query("lf_tone", "WITH x AS (SELECT unnest(['the', 'and', 'of', 'der', 'und', 'que', 'de']) AS w, unnest([0.5, -0.25, 0.25, -0.5, -0.75, 1.0, 0.125]::DOUBLE[]) AS s), t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\P{L}+')) AS w FROM documents), m AS (SELECT doc_id, avg(s) AS s FROM t JOIN x USING (w) GROUP BY 1) SELECT doc_id, round(coalesce(s, 0), 6) AS tone, CASE WHEN coalesce(s, 0) > 0.2 THEN 1 WHEN coalesce(s, 0) < -0.2 THEN 0 ELSE -1 END AS vote FROM documents LEFT JOIN m USING (doc_id)")
def lf_tone(spark, d):
    """Votes by thresholds on the mean weight of the words that a lexicon knows."""
    docs = T(spark, d, "documents").withColumn("tone", R(W.lexicon_score(F.col("text"), TONES)))
    return W.votes(docs, [W.threshold_lf("tone", "tone", -0.2, 0.2)]).select("doc_id", "tone", F.col("votes")[0].alias("vote"))


SETS = "WITH e AS (SELECT user_id, list(DISTINCT event_type) AS s FROM events WHERE value > 60 GROUP BY 1), p AS (SELECT a.user_id AS id, a.s AS a, b.s AS b, len(list_intersect(a.s, b.s)) AS n FROM e a JOIN e b ON b.user_id = a.user_id + 1)"


@query("lf_ratios", SETS + """ SELECT id, CASE WHEN n / len(a) >= 0.6 THEN 1 WHEN n / len(a) < 0.4 THEN -1 ELSE 0 END AS recall, CASE WHEN n / len(b) >= 0.6 THEN 1 WHEN n / len(b) < 0.4 THEN -1 ELSE 0 END AS precision,
CASE WHEN n = 0 THEN 0 WHEN n / len(a) >= 0.6 THEN 1 WHEN n / len(a) < 0.4 THEN -1 ELSE 0 END AS recall_non_zero, CASE WHEN n / least(len(a), len(b)) >= 0.8 THEN 1 WHEN n / least(len(a), len(b)) < 0.5 THEN -1 ELSE 0 END AS common FROM p""")
def lf_ratios(spark, d):
    """What the sets of neighbouring users share, as a part of either: 1 together, -1 apart, 0 undecided."""
    e = T(spark, d, "events").where("value > 60").groupBy("user_id").agg(F.collect_set("event_type").alias("a"))
    p = e.join(e.select((F.col("user_id") - 1).alias("user_id"), F.col("a").alias("b")), "user_id")
    lfs = [W.ratio_lf("recall", "a", "b", 0.4, 0.6), W.ratio_lf("precision", "a", "b", 0.4, 0.6), W.ratio_lf("recall", "a", "b", 0.4, 0.6, True), W.ratio_lf("common", "a", "b", 0.5, 0.8)]
    return p.select(F.col("user_id").alias("id"), *[f.column().alias(f.name) for f in lfs])


@query("majority_drawn", VOTES + ", c AS (SELECT doc_id, len(list_filter(votes, lambda x: x = 0)) AS a, len(list_filter(votes, lambda x: x = 1)) AS b FROM v) SELECT doc_id, CASE WHEN a > b THEN 0 WHEN b > a THEN 1 WHEN a + b = 0 THEN -1 ELSE (('0x' || substr(md5('9|' || doc_id), 1, 8))::BIGINT % 2)::INT END AS label FROM c")
def majority_drawn(spark, d):
    """Majority with ties decided by draw."""
    return documents(spark, d).select("doc_id", W.majority_or_drawn(F.col("doc_id"), seed=9).alias("label"))


@query("slice_matrix", "SELECT doc_id, length(text) < 500 AS short, coalesce(lang = 'en', false) AS english, coalesce(lang = 'en', false) AND length(text) < 500 AS short_english FROM documents")
def slice_matrix(spark, d):
    short, english = F.length("text") < 500, F.col("lang") == "en"
    return W.slice_matrix(T(spark, d, "documents"), {"short": short, "english": english, "short_english": short & english}).select("doc_id", "short", "english", "short_english")


@query("soft_labels", "SELECT * FROM (SELECT doc_id, unnest([1, 0]) AS label, unnest([p, 1 - p]) AS weight FROM (SELECT doc_id, (doc_id % 5) / 4.0::DOUBLE AS p FROM documents)) WHERE weight > 0")
def soft_labels(spark, d):
    """Training rows of uncertain labels: one for each label, weighted."""
    p = T(spark, d, "documents").select("doc_id", ((F.col("doc_id") % 5) / F.lit(4.0)).alias("p"))
    return W.soft_label_rows(p, "p").select("doc_id", "label", "weight")
