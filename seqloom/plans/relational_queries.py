"""Queries of the relational idioms: projections, filters, joins, aggregations, sorts, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqloom.functions import scalars
from seqloom.operators import ranges as RG
from seqloom.operators import relational as RL

from .registry import query, rounded as R, table as T


# --- projections and filters ------------------------------------------------------------------------------------------


@query("project_rename_derive", "SELECT l_orderkey AS order_key, l_linenumber AS line, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, 'x' AS tag, CAST(l_quantity AS INT) AS quantity, l_returnflag = 'R' AS returned FROM lineitem")
def project_rename_derive(spark, d):
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return T(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), R(charge).alias("charge"), F.lit("x").alias("tag"), F.col("l_quantity").cast("int").alias("quantity"), (F.col("l_returnflag") == "R").alias("returned"))


@query("filter_conjunction", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 30 AND (l_returnflag = 'R' OR l_discount >= 0.05) AND l_shipdate < TIMESTAMP '1999-01-01'")
def filter_conjunction(spark, d):
    c = F.col
    return T(spark, d, "lineitem").where(c("l_quantity").between(5, 30) & ((c("l_returnflag") == "R") | (c("l_discount") >= 0.05)) & (c("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz"))).select("l_orderkey", "l_linenumber")


@query("filter_group_size", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) BETWEEN 8 AND 12")
def filter_group_size(spark, d):
    return T(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n BETWEEN 8 AND 12")


@query("keep_entities_with_rows", "SELECT o_orderkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) >= 10")
def keep_entities_with_rows(spark, d):
    return T(spark, d, "orders").withColumn("n", F.count("*").over(Window.partitionBy("o_custkey"))).where("n >= 10").select("o_orderkey")


@query("lenient_casts", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k, try_cast(event_type AS INT) AS none, coalesce(try_cast(event_type AS INT), 0) AS filled FROM events")
def lenient_casts(spark, d):
    return T(spark, d, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') AS INT)").alias("k"), F.expr("try_cast(event_type AS INT)").alias("none"), F.coalesce(F.expr("try_cast(event_type AS INT)"), F.lit(0)).alias("filled"))


@query("value_map", "SELECT event_type, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'look' WHEN 'click' THEN 'look' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def value_map(spark, d):
    kinds = F.create_map(*[F.lit(x) for x in ("signup", "start", "view", "look", "click", "look")])
    return T(spark, d, "events").withColumn("kind", F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("other"))).groupBy("event_type", "kind").agg(F.count("*").alias("n"))


@query("label_encode", "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type) AS INT) AS code FROM part")
def label_encode(spark, d):
    return RL.label_encode(T(spark, d, "part").select("p_partkey", "p_type"), "p_type").select("p_partkey", F.col("p_type_code").alias("code"))


@query("dense_index", "SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS INT) AS idx FROM (SELECT DISTINCT user_id FROM events)")
def dense_index(spark, d):
    return RG.numbered(T(spark, d, "events").select("user_id").distinct(), "user_id", "place").select("user_id", (F.col("place") - 1).cast("int").alias("idx"))


@query("one_hot", "SELECT event_id, (event_type = 'click')::INT::DOUBLE AS click, (event_type = 'error')::INT::DOUBLE AS error, (event_type = 'purchase')::INT::DOUBLE AS purchase FROM events")
def one_hot(spark, d):
    code = F.array_position(F.array(F.lit("click"), F.lit("error"), F.lit("purchase")), F.col("event_type")).cast("int") - 1
    hot = scalars.one_hot(code, 3)
    return T(spark, d, "events").select("event_id", *[hot[i].alias(n) for i, n in enumerate(("click", "error", "purchase"))])


@query("fill_and_round", "SELECT c_custkey, coalesce(max(o_orderkey), 0) AS last_order, round_even(coalesce(sqrt(max(o_totalprice)), 0), 1) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1")
def fill_and_round(spark, d):
    o = T(spark, d, "orders").where("o_orderstatus = 'P'")
    x = T(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.max("o_orderkey").alias("last_order"), F.sqrt(F.max("o_totalprice")).alias("spent"))
    return x.fillna(0).withColumn("spent", F.bround("spent", 1))


@query("drop_nulls", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def drop_nulls(spark, d):
    return T(spark, d, "documents").join(T(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality").dropna()


@query("boolean_columns", "SELECT quality AS quality_bool, toxic AS toxic_bool, count(*) AS n FROM labels GROUP BY 1, 2")
def boolean_columns(spark, d):
    return RL.suffix_booleans(T(spark, d, "labels").drop("doc_id")).groupBy("quality_bool", "toxic_bool").agg(F.count("*").alias("n"))


# --- joins ------------------------------------------------------------------------------------------------------------


@query("join_inner", "SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey")
def join_inner(spark, d):
    c = T(spark, d, "customer").join(T(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return T(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment", "n_name")


@query("join_left_two_keys", "SELECT l.l_orderkey, l.l_linenumber, o.o_orderpriority FROM lineitem l JOIN part ON p_partkey = l_partkey LEFT JOIN (SELECT o_orderkey, 1 AS line, o_orderpriority FROM orders) o ON o.o_orderkey = l.l_orderkey AND o.line = l.l_linenumber WHERE p_size < 10")
def join_left_two_keys(spark, d):
    first = T(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), "o_orderpriority")
    small = T(spark, d, "part").where("p_size < 10")
    return T(spark, d, "lineitem").join(small, F.col("p_partkey") == F.col("l_partkey")).join(first, ["l_orderkey", "l_linenumber"], "left").select("l_orderkey", "l_linenumber", "o_orderpriority")


@query("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def join_semi(spark, d):
    big = T(spark, d, "orders").where("o_totalprice > 300000")
    return T(spark, d, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_anti(spark, d):
    open_ = T(spark, d, "orders").where("o_orderstatus = 'P'")
    return T(spark, d, "customer").join(open_, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("join_suffixed", "SELECT a.r_regionkey, a.r_name AS name_l, b.n AS n_r FROM region a JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) b ON a.r_regionkey = b.n_regionkey")
def join_suffixed(spark, d):
    a, b = T(spark, d, "region").alias("a"), T(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")).alias("b")
    return a.join(b, F.col("a.r_regionkey") == F.col("b.n_regionkey")).select("r_regionkey", F.col("a.r_name").alias("name_l"), F.col("b.n").alias("n_r"))


@query("join_symmetric_pairs", "SELECT count(*) AS n, count(*) FILTER (WHERE k) AS known FROM (SELECT least(l_partkey % 50, l_suppkey % 50) AS a, greatest(l_partkey % 50, l_suppkey % 50) AS b, EXISTS (SELECT 1 FROM nation x WHERE least(x.n_nationkey, 24 - x.n_regionkey) = least(l_partkey % 50, l_suppkey % 50) AND greatest(x.n_nationkey, 24 - x.n_regionkey) = greatest(l_partkey % 50, l_suppkey % 50)) AS k FROM lineitem)")
def join_symmetric_pairs(spark, d):
    """Pairs known in either order."""
    x = T(spark, d, "nation").select(F.col("n_nationkey").alias("p"), (24 - F.col("n_regionkey")).alias("q"))
    known = x.select(F.least("p", "q").cast("long").alias("a"), F.greatest("p", "q").cast("long").alias("b"), F.lit(True).alias("k")).distinct()
    m, n = F.col("l_partkey") % 50, F.col("l_suppkey") % 50
    pairs = T(spark, d, "lineitem").select(F.least(m, n).alias("a"), F.greatest(m, n).alias("b")).join(known, ["a", "b"], "left")
    return pairs.agg(F.count("*").alias("n"), F.count_if(F.col("k")).alias("known"))


@query("join_point_lookup", "SELECT conv_id, turn, length(text) AS chars FROM conversations WHERE (conv_id, turn) IN (SELECT conv_id, max(turn) FROM conversations GROUP BY 1)")
def join_point_lookup(spark, d):
    c = T(spark, d, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return c.join(last, ["conv_id", "turn"]).select("conv_id", "turn", F.length("text").cast("long").alias("chars"))


# --- aggregations -----------------------------------------------------------------------------------------------------


@query("group_first_row", "SELECT o_custkey, arg_min(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS first_order, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS last_order FROM orders GROUP BY 1")
def group_first_row(spark, d):
    at = F.struct("o_orderdate", "o_orderkey")
    return T(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", at).alias("first_order"), F.max_by("o_orderkey", at).alias("last_order"))


@query("collected_sets", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, count(DISTINCT event_type) AS n_kinds, string_agg(event_type, '>' ORDER BY ts, event_id) AS path FROM events GROUP BY 1")
def collected_sets(spark, d):
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return T(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.count_distinct("event_type").alias("n_kinds"), F.array_join(ordered["event_type"], ">").alias("path"))


@query("relative_frequency", "SELECT c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY 1")
def relative_frequency(spark, d):
    c = T(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return c.withColumn("share", R(F.col("n") / F.sum("n").over(Window.partitionBy())))


@query("missing_profile", "WITH x AS (SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)), s AS (SELECT 100 * avg((doc_id IS NULL)::INT) AS doc_id, 100 * avg((quality IS NULL)::INT) AS quality, 100 * avg((toxic IS NULL)::INT) AS toxic FROM x) SELECT \"column\", round(missing, 6) AS missing FROM (UNPIVOT s ON doc_id, quality, toxic INTO NAME \"column\" VALUE missing)")
def missing_profile(spark, d):
    x = T(spark, d, "documents").join(T(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")
    return RL.missing_profile(x).select("column", R(F.col("missing")).alias("missing"))


@query("missing_rows", "SELECT (quality IS NULL)::INT + (toxic IS NULL)::INT AS missing, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def missing_rows(spark, d):
    x = T(spark, d, "documents").join(T(spark, d, "labels"), "doc_id", "left")
    return x.groupBy(RL.missing_per_row(x, ["quality", "toxic"]).alias("missing")).agg(F.count("*").alias("n"))


@query("mean_without_zeros", "SELECT p_brand, round(coalesce(avg(nullif(p_size % 4, 0)), 0), 6) AS mean FROM part GROUP BY 1")
def mean_without_zeros(spark, d):
    return T(spark, d, "part").groupBy("p_brand").agg(R(F.coalesce(F.avg(F.nullif(F.col("p_size") % 4, F.lit(0))), F.lit(0.0))).alias("mean"))


@query("mode_smallest", "WITH c AS (SELECT l_suppkey, l_quantity AS q, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, arg_min(q, struct_pack(a := -n, b := q)) AS mode FROM c GROUP BY 1")
def mode_smallest(spark, d):
    return RL.mode(T(spark, d, "lineitem"), ["l_suppkey"], "l_quantity")


@query("percentiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(quantile_cont(l_extendedprice, 0.5), 6) AS q2, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3, round(quantile_cont(l_quantity, 0.9), 6) AS p90 FROM lineitem GROUP BY 1")
def percentiles(spark, d):
    lines = T(spark, d, "lineitem")
    price = RG.percentiles(lines, "l_returnflag", "l_extendedprice", [0.25, 0.5, 0.75])
    quantity = RG.percentiles(lines, "l_returnflag", "l_quantity", [0.9]).select(F.col("l_returnflag").alias("flag"), F.col("p0").alias("p90"))
    return price.join(quantity, F.col("l_returnflag").eqNullSafe(F.col("flag"))).select("l_returnflag", *[R(F.col(f"p{i}")).alias(f"q{i + 1}") for i in range(3)], R(F.col("p90")).alias("p90"))


@query("weighted_average", "SELECT l_shipdate::DATE AS day, round(sum(l_quantity * l_discount) / nullif(sum(l_quantity), 0), 6) AS mean FROM lineitem GROUP BY 1")
def weighted_average(spark, d):
    return T(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(R(F.try_divide(F.sum(F.col("l_quantity") * F.col("l_discount")), F.sum("l_quantity"))).alias("mean"))


@query("histogram", "SELECT CAST(least(floor(value / 10), 99) AS INT) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def histogram(spark, d):
    return T(spark, d, "events").where("value IS NOT NULL").groupBy(F.least(F.floor(F.col("value") / 10), F.lit(99)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("crosstab", "SELECT o_orderstatus AS status, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS p1, count(*) FILTER (WHERE o_orderpriority LIKE '2%') AS p2, count(*) FILTER (WHERE o_orderpriority LIKE '3%') AS p3 FROM orders GROUP BY 1")
def crosstab(spark, d):
    o = T(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("p"))
    return o.groupBy("status").pivot("p", ["p1", "p2", "p3"]).agg(F.count(F.lit(1))).fillna(0)


@query("cube_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(spark, d):
    return T(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("unpivot_labels", "SELECT doc_id, 'quality' AS workflow, quality AS label FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels")
def unpivot_labels(spark, d):
    return T(spark, d, "labels").unpivot("doc_id", ["quality", "toxic"], "workflow", "label")


@query("mean_absolute_deviation", "WITH m AS (SELECT *, avg(round(l_quantity, 2)) OVER (PARTITION BY l_suppkey) AS m FROM lineitem) SELECT l_suppkey, round(avg(abs(l_quantity - m)), 6) AS mad FROM m GROUP BY 1")
def mean_absolute_deviation(spark, d):
    l = T(spark, d, "lineitem")  # noqa: E741
    means = l.groupBy("l_suppkey").agg(F.avg(F.round("l_quantity", 2)).alias("m"))
    return l.join(means, "l_suppkey").groupBy("l_suppkey").agg(R(F.avg(F.abs(F.col("l_quantity") - F.col("m")))).alias("mad"))


@query("confusion_counters", "SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn FROM labels")
def confusion_counters(spark, d):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return T(spark, d, "labels").agg(F.count_if(q & t).alias("tp"), F.count_if(~q & ~t).alias("tn"), F.count_if(~q & t).alias("fp"), F.count_if(q & ~t).alias("fn"))


@query("soft_f1", "SELECT l_returnflag AS batch, round(sum(l_tax * l_discount) / (sum(l_discount) + 1e-7), 6) AS recall, round(sum(l_tax * l_discount) / (sum(l_tax) + 1e-7), 6) AS precision FROM lineitem GROUP BY 1")
def soft_f1(spark, d):
    hit = F.sum(F.col("l_tax") * F.col("l_discount"))
    return T(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("batch")).agg(R(hit / (F.sum("l_discount") + 1e-7)).alias("recall"), R(hit / (F.sum("l_tax") + 1e-7)).alias("precision"))


@query("explained_share", "WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, c_nationkey) AS k, sum(n) OVER (ORDER BY n DESC, c_nationkey) / sum(n) OVER () AS share FROM c) SELECT c_nationkey, n, CAST(k AS INT) AS k, round(share, 6) AS share, share >= 0.8 AND share - n / sum(n) OVER () < 0.8 AS cutoff FROM r")
def explained_share(spark, d):
    """Running share of the counts, and where it first reaches 80 %."""
    c = T(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    w, everything = Window.orderBy(F.desc("n"), "c_nationkey"), Window.partitionBy()
    r = c.withColumns({"k": F.row_number().over(w), "s": F.sum("n").over(w) / F.sum("n").over(everything), "own": F.col("n") / F.sum("n").over(everything)})
    return r.select("c_nationkey", "n", "k", R(F.col("s")).alias("share"), ((F.col("s") >= 0.8) & (F.col("s") - F.col("own") < 0.8)).alias("cutoff"))


# --- sorts, samples, sets ---------------------------------------------------------------------------------------------


@query("top_k_per_group", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS k FROM orders QUALIFY k <= 3")
def top_k_per_group(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return T(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("k")).where("k <= 3")


@query("head_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def head_rows(spark, d):
    return T(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("recent_events", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def recent_events(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return T(spark, d, "events").withColumn("k", F.row_number().over(w)).where("k <= 5").select("user_id", "event_id")


@query("sample_n", "SELECT p_partkey FROM part ORDER BY md5('7|' || p_partkey::VARCHAR), p_partkey LIMIT 100")
def sample_n(spark, d):
    return RL.sample_n(T(spark, d, "part").select("p_partkey"), 100, "p_partkey", seed=7)


@query("sample_share", "SELECT o_orderkey FROM orders WHERE ('0x' || substr(md5('1|' || o_orderkey::VARCHAR), 1, 8))::BIGINT < 429496729")
def sample_share(spark, d):
    return RL.sample_share(T(spark, d, "orders").select("o_orderkey"), 0.1, "o_orderkey", seed=1)


@query("stratified_split", "WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('5|' || c_custkey::VARCHAR), c_custkey) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_custkey, k <= floor(n * 0.2::DOUBLE) AS is_test FROM r")
def stratified_split(spark, d):
    return RL.stratified_split(T(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 0.2, 5).select("c_custkey", "is_test")


@query("balanced_classes", "WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('2|' || doc_id::VARCHAR), doc_id) AS k FROM labels) SELECT doc_id, toxic FROM r WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic))")
def balanced_classes(spark, d):
    return RL.balanced(T(spark, d, "labels"), "toxic", "doc_id", 2).select("doc_id", "toxic")


@query("folds", "SELECT c_custkey, CAST(ntile(5) OVER (ORDER BY c_custkey) AS INT) AS fold FROM customer")
def folds(spark, d):
    return RL.folds(T(spark, d, "customer").select("c_custkey"), "c_custkey", 5)


@query("negative_samples", "WITH c AS (SELECT DISTINCT o_custkey, pmod AS part FROM (SELECT o_custkey, ('0x' || substr(md5('n|' || o_orderkey::VARCHAR), 1, 8))::BIGINT % (SELECT count(*) FROM part) AS pmod FROM orders)) SELECT o_custkey, part FROM c WHERE NOT EXISTS (SELECT 1 FROM orders o JOIN lineitem ON l_orderkey = o_orderkey WHERE o.o_custkey = c.o_custkey AND l_partkey = part)")
def negative_samples(spark, d):
    """For each order a part drawn by hash, unless its customer ever had it."""
    n = T(spark, d, "part").count()
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("n|"), F.col("o_orderkey").cast("string"))), 1, 8), 16, 10).cast("long") % n
    o = T(spark, d, "orders")
    had = o.join(T(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", F.col("l_partkey").alias("part"))
    return o.select("o_custkey", draw.alias("part")).distinct().join(had, ["o_custkey", "part"], "left_anti")


@query("set_operations", "SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT 'all', count(*) FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def set_operations(spark, d):
    c, s = T(spark, d, "customer").select(F.col("c_nationkey").alias("k")), T(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_acctbal")
    n, s1 = T(spark, d, "nation").select(F.col("n_nationkey").alias("k")), s.select("k")
    parts = {"union": c.union(s1).distinct(), "intersect": c.intersect(s1), "except": n.subtract(s.where("s_acctbal > 5000").select("k")), "all": c.unionByName(s1)}
    out = None
    for name, x in parts.items():
        one = x.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("array_sets", "WITH u AS (SELECT user_id, list(DISTINCT event_type) AS s FROM events WHERE value > 80 GROUP BY 1), w AS (SELECT user_id, list(DISTINCT event_type) AS s FROM events WHERE value < 10 GROUP BY 1) SELECT u.user_id, len(list_intersect(u.s, w.s)) AS both, len(list_distinct(list_concat(u.s, w.s))) AS either, len(list_filter(u.s, lambda x: NOT list_contains(w.s, x))) AS only, list_has_any(u.s, w.s) AS overlap, list_has_all(w.s, u.s) AS contained FROM u JOIN w USING (user_id)")
def array_sets(spark, d):
    e = T(spark, d, "events")
    u, w = (e.where(c).groupBy("user_id").agg(F.collect_set("event_type").alias(n)) for c, n in (("value > 80", "u"), ("value < 10", "w")))
    size = lambda c: F.size(c).cast("long")
    return u.join(w, "user_id").select("user_id", size(F.array_intersect("u", "w")).alias("both"), size(F.array_union("u", "w")).alias("either"), size(F.array_except("u", "w")).alias("only"), F.arrays_overlap("u", "w").alias("overlap"), (F.size(F.array_except("u", "w")) == 0).alias("contained"))


# --- scalar functions -------------------------------------------------------------------------------------------------


@query("text_predicates", r"SELECT doc_id, contains(lower(text), 'license') AS has_license, regexp_matches(text, '(?i)the.*and') AS the_and, len(list_filter(regexp_split_to_array(trim(text, E' \t\n'), '\s+'), lambda w: w <> '')) < 60 AS brief, replace(substr(text, 1, 12), 'e', 'E') AS head, len(string_split(text, ' ')) AS pieces FROM documents")
def text_predicates(spark, d):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    t = F.col("text")
    return T(spark, d, "documents").select("doc_id", F.lower(t).contains("license").alias("has_license"), t.rlike("(?i)the.*and").alias("the_and"), (F.size(words) < 60).alias("brief"), F.replace(F.substring(t, 1, 12), F.lit("e"), F.lit("E")).alias("head"), F.size(F.split(t, " ")).cast("long").alias("pieces"))


@query("token_functions", "WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents) SELECT doc_id, CASE WHEN len(w) > 1 THEN w[-1] END AS last_token, array_to_string(w[1:3], '_') AS head, array_to_string(list_concat(w, ['', '', '', '', ''])[1:5], '|') AS padded, CAST(('0x' || substr(md5(w[1]), 1, 8))::BIGINT % 1000 AS BIGINT) AS bucket FROM w")
def token_functions(spark, d):
    x = T(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w"))
    w = F.col("w")
    return x.select("doc_id", F.when(F.size(w) > 1, F.element_at(w, -1)).alias("last_token"), F.array_join(F.slice(w, 1, 3), "_").alias("head"), F.array_join(scalars.padded(w, 5, ""), "|").alias("padded"), scalars.hash_bucket(w[0], 1000).alias("bucket"))


@query("ngram_counts", "WITH w AS (SELECT doc_id, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w) SELECT g AS gram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) >= 20")
def ngram_counts(spark, d):
    """Bigrams of at least 20 documents."""
    w = F.filter(F.split(F.lower("text"), " "), lambda x: x != "")
    n = F.greatest(F.size("w") - 1, F.lit(0))
    grams = F.zip_with(F.slice("w", F.lit(1), n), F.slice("w", F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    g = T(spark, d, "documents").select("doc_id", w.alias("w")).select("doc_id", F.explode(grams).alias("gram"))
    per_doc = g.groupBy("gram", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("gram").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).where("docs >= 20")


@query("dates", "SELECT o_orderkey, strftime(o_orderdate, '%a %b %d %Y') AS shown, CAST(epoch(strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y')) AS BIGINT) AS seconds, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS days, round(date_diff('day', DATE '1995-01-01', o_orderdate::DATE) / 365.25, 6) AS years FROM orders")
def dates(spark, d):
    t = F.col("o_orderdate")
    days = F.date_diff(F.to_date(t), F.lit("1995-01-01").cast("date"))
    parsed = F.to_timestamp_ntz(F.date_format(t, "dd/MM/yyyy"), F.lit("dd/MM/yyyy"))
    return T(spark, d, "orders").select("o_orderkey", F.date_format(t, "EEE MMM dd yyyy").alias("shown"), (F.date_diff(F.to_date(parsed), F.lit("1970-01-01").cast("date")).cast("long") * 86400).alias("seconds"), days.cast("long").alias("days"), R(days / 365.25).alias("years"))


@query("math_functions", "SELECT l_orderkey, l_linenumber, round(48 / (1 + exp(0.05 * (l_quantity - 25))) + 1, 6) AS sigmoid, round(48 * exp(-pow(l_quantity / 30, 1.5)), 6) AS weibull, round(exp(-0.5 * l_discount), 6) AS rbf, round(degrees(asin(l_discount)), 6) AS angle, round(sqrt(l_quantity * l_quantity + l_tax * l_tax), 6) AS hypot, round(ln(48 / (10 + l_tax) - 1) / 0.05 + 25, 6) AS inverse, greatest(least(l_quantity, 30), 10) AS clipped FROM lineitem")
def math_functions(spark, d):
    q = F.col("l_quantity")
    L = lambda x: F.lit(float(x))
    return T(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", R(scalars.sigmoid(q, L(48), L(0.05), L(25), L(1))).alias("sigmoid"), R(scalars.weibull(q, L(48), L(30), L(1.5))).alias("weibull"), R(scalars.rbf(F.col("l_discount"), 0.5)).alias("rbf"),
        R(F.degrees(F.asin("l_discount"))).alias("angle"), R(F.hypot(q, F.col("l_tax"))).alias("hypot"), R(scalars.inverse_sigmoid(10 + F.col("l_tax"), L(48), L(0.05), L(25), L(0))).alias("inverse"), F.greatest(F.least(q, L(30)), L(10)).alias("clipped"),
    )


@query("boxes", "SELECT p_partkey, (p_size % 7 + 1) * (p_size % 5 + 2) AS area, greatest(p_size % 7 + 1, p_size % 11 + 3) * greatest(p_size % 5 + 2, p_size % 3 + 1) AS union_area, p_size % 7 + 1 < p_size % 5 + 2 AS wider FROM part")
def boxes(spark, d):
    s = F.col("p_size")
    zero = F.lit(0)
    a, b = F.array(zero, s % 7 + 1, zero, s % 5 + 2), F.array(zero, s % 11 + 3, zero, s % 3 + 1)
    return T(spark, d, "part").select("p_partkey", scalars.bbox_area(a).alias("area"), scalars.bbox_area(scalars.bbox_union(a, b)).alias("union_area"), (a[1] < a[3]).alias("wider"))


@query("label_colours", "SELECT c_custkey, ['red', 'green', 'blue'][(dense_rank() OVER (ORDER BY c_mktsegment) - 1) % 3 + 1] AS colour FROM customer")
def label_colours(spark, d):
    coded = RL.label_encode(T(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")
    return coded.select("c_custkey", scalars.palette_color(F.col("c_mktsegment_code"), ["red", "green", "blue"]).alias("colour"))


@query("linspace_grid", "SELECT n_nationkey, round(sum(n_regionkey + i * (n_nationkey - n_regionkey) / 4.0), 6) AS total FROM nation, range(5) r(i) GROUP BY 1")
def linspace_grid(spark, d):
    from seqloom.functions import sequences as S

    return T(spark, d, "nation").select("n_nationkey", R(S.total(F.transform(S.linspace(F.col("n_regionkey"), F.col("n_nationkey"), 5), lambda x: x.cast("double")))).alias("total"))


@query("token_windows", "WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents) SELECT doc_id, array_to_string(w[greatest(list_position(w, 'the') - 3, 1):greatest(list_position(w, 'the') - 1, 0)], ' ') AS before FROM w WHERE list_position(w, 'the') > 1")
def token_windows(spark, d):
    """The three tokens before the first ``the``."""
    x = T(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w")).withColumn("at", F.array_position("w", F.lit("the")).cast("int")).where("at > 1")
    start = F.greatest(F.col("at") - 3, F.lit(1))
    return x.select("doc_id", F.array_join(F.slice("w", start, F.col("at") - start), " ").alias("before"))
