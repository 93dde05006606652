"""Queries of the pair operators and the sequence metrics.

Entities with features are suppliers (monthly scores); entities with short sequences are nations, by quarter: ``e`` counts
orders modulo 5, ``v`` is a price score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import alignment as A
from seqloom.functions import fits, scalars
from seqloom.functions import sequences as S
from seqloom.operators import pairs as P
from seqloom.sources.scratch import written

from .registry import query, rounded as R, table

SUPPLIERS = """WITH m AS (SELECT l_suppkey AS id, year(l_shipdate) * 12 + month(l_shipdate) AS mon, sqrt(max(l_extendedprice)) / 10 AS v FROM lineitem GROUP BY 1, 2),
l AS (SELECT id, mon - min(mon) OVER (PARTITION BY id) AS t, v, row_number() OVER (PARTITION BY id ORDER BY mon) AS k FROM m),
s AS (SELECT id, k, t, v, lead(t) OVER w - t AS dt, lead(v) OVER w - v AS dv, lead(v) OVER w AS v2 FROM l WINDOW w AS (PARTITION BY id ORDER BY k)),
f AS (SELECT id, max(t)::DOUBLE AS duration, (arg_max(v, k) - arg_min(v, k)) / max(t) AS slope, arg_min(v, k) AS fv, arg_max(v, k) AS lv, min(dv / dt) AS hcs, avg(v) AS mean,
sum(abs(dt * least(v, v2) + dt * dv / 2)) AS auc FROM s GROUP BY id),
p AS (SELECT a.id AS id1, b.id AS id2, abs(a.duration - b.duration) AS duration_diff, abs(a.slope - b.slope) AS slope_diff, abs(a.fv - b.fv) AS fv_diff, abs(a.lv - b.lv) AS lv_diff, abs(a.hcs - b.hcs) AS hcs_diff,
abs(a.mean - b.mean) AS mean_diff, abs(a.auc - b.auc) AS auc_diff FROM f a JOIN f b ON a.id < b.id)
"""
NAMES = ["duration", "slope", "fv", "lv", "hcs", "mean", "auc"]
DIFFS = [f"{n}_diff" for n in NAMES]


def supplier_sequences(spark, d) -> DataFrame:
    months = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("month")).agg((F.sqrt(F.max("l_extendedprice")) / 10).alias("v"))
    return S.to_sequences(months.select("id", (F.col("month") - F.min("month").over(Window.partitionBy("id"))).alias("t"), "v"), "id", "t", "v")


def supplier_features(spark, d) -> DataFrame:
    """Features are made once for each entity, before pairs are."""
    q = F.col("seq")
    made = {"duration": S.duration(q).cast("double"), "slope": S.slope(q), "fv": S.first_value(q), "lv": S.last_value(q), "hcs": S.min_step_slope(q), "mean": S.mean(q["v"]), "auc": S.auc_reference(q)}
    return supplier_sequences(spark, d).select("id", *[c.alias(n) for n, c in made.items()])


def supplier_pairs(spark, d) -> DataFrame:
    return P.differences(P.pairs(supplier_features(spark, d), "id"), "id", NAMES)


@query("pairs_features", SUPPLIERS + f"SELECT id1, id2, {', '.join(f'round({n}, 6) AS {n}' for n in DIFFS)} FROM p")
def pairs_features(spark, d):
    return P.measured_differences(supplier_features(spark, d), "id", NAMES)


@query("pairs_ordered", SUPPLIERS + "SELECT a.id AS id1, b.id AS id2, round(a.mean / b.mean, 6) AS ratio FROM f a JOIN f b ON a.id <> b.id")
def pairs_ordered(spark, d):
    found = P.pairs(supplier_features(spark, d).select("id", "mean"), "id", ordered=True)
    return found.select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), R(F.col("a.mean") / F.col("b.mean")).alias("ratio"))


WEIGHTS = [0.5, 3.0, 1.25, -0.5]


@query("pairs_weighted_measure", SUPPLIERS + "SELECT id1, id2, round(0.25 + 0.5 * duration_diff + 3.0 * slope_diff + 1.25 * fv_diff - 0.5 * hcs_diff, 6) + 0 AS measure, round(duration_diff + slope_diff + fv_diff + hcs_diff, 6) AS manhattan, round(sqrt(duration_diff ** 2 + slope_diff ** 2 + fv_diff ** 2 + hcs_diff ** 2), 6) AS euclid FROM p")
def pairs_weighted_measure(spark, d):
    x = [F.col(n) for n in ("duration_diff", "slope_diff", "fv_diff", "hcs_diff")]
    zero = F.array(*[F.lit(0.0)] * 4)
    return supplier_pairs(spark, d).select("id1", "id2", R(scalars.weighted_sum(WEIGHTS, x, 0.25)).alias("measure"), R(scalars.weighted_sum([1.0] * 4, x)).alias("manhattan"), R(scalars.minkowski(F.array(*x), zero, 2.0)).alias("euclid"))


@query("pairs_normalised", SUPPLIERS + "SELECT id1, id2, round((mean_diff - min(mean_diff) OVER ()) / (max(mean_diff) OVER () - min(mean_diff) OVER ()), 6) AS minmax, round(1 / (1 + exp(avg(mean_diff) OVER () - mean_diff)), 6) AS sigmoid FROM p")
def pairs_normalised(spark, d):
    f = written(supplier_features(spark, d).select("id", "mean"), "features")
    known = P.gaps(f, "mean")
    if known:
        return P.measured_normalised(f, "id", "mean", known)
    out = P.normalised(P.differences(P.pairs(f, "id"), "id", ["mean"]), "mean_diff")
    return out.select("id1", "id2", R(F.col("mean_diff_minmax")).alias("minmax"), R(F.col("mean_diff_sigmoid")).alias("sigmoid"))


@query("pairs_similarity", SUPPLIERS + "SELECT id1, id2, round(exp(-(mean_diff ** 2) / (2 * (SELECT median(mean_diff) FROM p WHERE mean_diff > 0) ** 2)), 6) AS similarity FROM p")
def pairs_similarity(spark, d):
    f = written(supplier_features(spark, d).select("id", "mean"), "features")
    return P.similarity(P.differences(P.pairs(f, "id"), "id", ["mean"]), "mean_diff", known=P.gaps(f, "mean")).select("id1", "id2", R(F.col("similarity")).alias("similarity"))


@query("pairs_matrix", SUPPLIERS + ", e AS (SELECT id1, id2, mean_diff FROM p UNION ALL SELECT id2, id1, mean_diff FROM p) SELECT id1 AS id, round(sum(mean_diff), 5) AS row_sum, round(max(mean_diff), 6) AS farthest, round(min(mean_diff), 6) AS nearest FROM e GROUP BY 1")
def pairs_matrix(spark, d):
    e = P.symmetric(supplier_pairs(spark, d), "mean_diff")
    return e.groupBy(F.col("id1").alias("id")).agg(R(F.sum("mean_diff"), 5).alias("row_sum"), R(F.max("mean_diff")).alias("farthest"), R(F.min("mean_diff")).alias("nearest"))


ALIGNED = """, h AS (SELECT a.id AS id1, b.id AS id2, CAST(ceil(greatest(a.duration, b.duration) / 6) AS INT) AS n FROM f a JOIN f b ON a.id < b.id),
g AS (SELECT id1, id2, who, x * 6 AS x FROM h, range(0, 200) r(x), (VALUES (1), (2)) w(who) WHERE x <= n),
st AS (SELECT id, t, v, t + dt AS t2, dt, dv FROM s),
i AS (SELECT g.id1, g.id2, g.who, g.x, greatest(coalesce(max(st.v + st.dv * (g.x - st.t) / st.dt), 0), 0) AS y FROM g LEFT JOIN st ON st.id = CASE WHEN who = 1 THEN id1 ELSE id2 END AND st.t <= g.x AND (g.x < st.t2 OR g.x = st.t2 AND g.x = (SELECT max(t) FROM l WHERE l.id = st.id)) GROUP BY ALL),
k AS (SELECT *, lead(y) OVER w AS y2 FROM i WINDOW w AS (PARTITION BY id1, id2, who ORDER BY x)),
u AS (SELECT id1, id2, who, sum(abs(6 * least(y, y2) + 6 * (y2 - y) / 2)) AS auc FROM k GROUP BY 1, 2, 3)
SELECT id1, id2, round(abs(max(auc) FILTER (WHERE who = 1) - max(auc) FILTER (WHERE who = 2)), 6) AS auc_diff FROM u GROUP BY 1, 2"""


@query("pairs_aligned_auc", SUPPLIERS + ALIGNED)
def pairs_aligned_auc(spark, d):
    """Both sequences on one grid of six months up to the longer one's end, 0 outside; difference of the areas."""
    q, steps = F.col("seq"), F.floor(S.duration(F.col("seq")) / 6).cast("int")

    def area(last):
        on_grid = F.transform(F.sequence(F.lit(0), last * 6, F.lit(6)), lambda x: F.struct(x.alias("t"), F.greatest(S.interpolate(q, x, F.lit(0.0)), F.lit(0.0)).alias("v")))
        return S.bind(on_grid, S.auc_reference)

    # beyond its own end a sequence falls to 0 in one step and then adds nothing: two areas for each are enough
    made = supplier_sequences(spark, d).select("id", S.duration(q).alias("duration"), steps.alias("steps"), area(steps).alias("inside"), area(steps + 1).alias("fallen"))
    last = F.ceil(F.greatest(F.col("a.duration"), F.col("b.duration")) / 6)
    upto = lambda x: F.when(last > F.col(f"{x}.steps"), F.col(f"{x}.fallen")).otherwise(F.col(f"{x}.inside"))
    return P.pairs(made, "id").select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), R(F.abs(upto("a") - upto("b"))).alias("auc_diff"))


R2 = """, q AS (SELECT a.id AS id1, b.id AS id2 FROM f a JOIN f b ON a.id < b.id), y AS (SELECT id, list(v ORDER BY v) AS v FROM l GROUP BY id),
c AS (SELECT id1, id2, a.v[1:least(len(a.v), len(b.v))] AS x, b.v[1:least(len(a.v), len(b.v))] AS y FROM q JOIN y a ON a.id = id1 JOIN y b ON b.id = id2),
e AS (SELECT id1, id2, unnest(x) AS x, unnest(y) AS y FROM c)
SELECT id1, id2, round(1 - sum((y - x) ** 2) / (var_pop(y) * count(*)), 6) + 0 AS r2, round(degrees(atan(abs(regr_slope(y, x)))), 6) AS angle FROM e GROUP BY 1, 2"""


@query("pairs_r2_angle", SUPPLIERS + R2)
def pairs_r2_angle(spark, d):
    """How well one's sorted values foretell the other's, and the angle of the trend between them."""
    sorted_values = supplier_sequences(spark, d).select("id", F.sort_array(F.col("seq")["v"]).alias("v"))
    return P.measured(sorted_values, "id", A.foretold, ["r2", "angle"])


# --- sequence metrics -------------------------------------------------------------------------------------------------

NATIONS = """WITH q AS (SELECT c_nationkey AS id, (year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) - 1 AS t, count(*) % 5 AS e, sqrt(max(o_totalprice)) / 12 AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
n AS (SELECT id, list(t ORDER BY t) AS t, list(e ORDER BY t) AS e, list(v ORDER BY t) AS v FROM q GROUP BY id),
p AS (SELECT a.id AS id1, b.id AS id2, a.t AS ta, b.t AS tb, a.e AS ea, b.e AS eb, a.v AS va, b.v AS vb FROM n a JOIN n b ON a.id < b.id)
"""


def _fold(first: str, costs: str, row: str, out: str) -> str:
    """SQL of a dynamic programme over (x, y): a recursion over x with a list for each row."""
    return (
        NATIONS.replace("WITH q", "WITH RECURSIVE q")
        + f""", z AS (SELECT id1, id2, {costs}), dp AS (SELECT id1, id2, x, y, 0 AS i, {first} AS r FROM z
UNION ALL SELECT id1, id2, x, y, i + 1, {row} FROM (SELECT *, list_transform(range(0, len(y) + 1), lambda j: coalesce(list_sum(list_transform(y[1:j], lambda w: abs(x[i + 1] - w))), 0)) AS s FROM dp WHERE i < len(x)))
SELECT id1, id2, {out} FROM dp WHERE i = len(x)"""
    )


def nations(spark, d) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    q = o.groupBy(F.col("c_nationkey").alias("id"), ((F.year("o_orderdate") - 1995) * 4 + F.quarter("o_orderdate") - 1).alias("t")).agg((F.count("*") % 5).alias("e"), (F.sqrt(F.max("o_totalprice")) / 12).alias("v"))
    return q.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("t", "e", "v"))).alias("seq"))


def nation_pairs(spark, d) -> DataFrame:
    # few keys and much work for each pair: spread the pairs before the work
    found = P.pairs(nations(spark, d), "id").select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), F.col("a.seq").alias("a"), F.col("b.seq").alias("b"))
    return found.repartition(spark.sparkContext.defaultParallelism, "id1", "id2")


@query("dtw", _fold("list_concat([0.0::DOUBLE], list_transform(y, lambda w: 'inf'::DOUBLE))", "va AS x, vb AS y FROM p",
    "list_concat(['inf'::DOUBLE], list_transform(range(1, len(y) + 1), lambda j: s[j + 1] + list_min(list_transform(range(1, j + 1), lambda k: least(r[k + 1], r[k]) - s[k]))))", "round(r[len(r)], 6) AS dtw"))
def dtw(spark, d):
    return nation_pairs(spark, d).select("id1", "id2", R(A.dtw(F.col("a.v"), F.col("b.v"))).alias("dtw"))


@query("levenshtein", _fold("list_transform(range(0, len(y) + 1), lambda j: j::DOUBLE)", "ea AS x, eb AS y FROM p",
    "list_concat([(i + 1)::DOUBLE], list_transform(range(1, len(y) + 1), lambda j: j + least((i + 1)::DOUBLE, list_min(list_transform(range(1, j + 1), lambda k: least(r[k + 1] + 1, r[k] + (x[i + 1] <> y[k])::INT) - k)))))", "r[len(r)] AS edits"))
def levenshtein(spark, d):
    return nation_pairs(spark, d).select("id1", "id2", A.levenshtein(F.col("a.e"), F.col("b.e")).alias("edits"))


@query("lcss", _fold("list_transform(range(0, len(y) + 1), lambda j: 0::BIGINT)", "ea AS x, eb AS y FROM p",
    "list_concat([0::BIGINT], list_transform(range(1, len(y) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN x[i + 1] = y[k] THEN r[k] + 1 ELSE r[k + 1] END))))", "r[len(r)] AS length, round(1 - r[len(r)] / least(len(x), len(y)), 6) + 0 AS distance"))
def lcss(spark, d):
    n = A.lcss_length(F.col("a.e"), F.col("b.e"))
    return nation_pairs(spark, d).select("id1", "id2", n.cast("long").alias("length"), R(A.lcss_distance(F.col("a.e"), F.col("b.e"))).alias("distance"))


@query("lcss_time", _fold("list_transform(range(0, len(y) + 1), lambda j: 0::BIGINT)", "ea AS x, eb AS y FROM p",
    "list_concat([0::BIGINT], list_transform(range(1, len(y) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN abs(x[i + 1] - y[k]) <= 1 AND abs(i - (k - 1)) < 4 THEN r[k] + 1 ELSE r[k + 1] END))))", "r[len(r)] AS length"))
def lcss_time(spark, d):
    """Events at most one apart and less than four places apart are the same; places stand for times here."""
    place = lambda q: F.transform(F.col(q), lambda x, i: F.struct(i.alias("t"), x["e"].alias("e")))
    return nation_pairs(spark, d).select("id1", "id2", A.lcss_length(place("a"), place("b"), A.within(1, 4)).cast("long").alias("length"))


@query("euclid_sequences", NATIONS + ", x AS (SELECT id1, id2, unnest(va[1:least(len(va), len(vb))]) AS a, unnest(vb[1:least(len(va), len(vb))]) AS b FROM p) SELECT id1, id2, round(sqrt(sum((a - b) ** 2)), 6) AS euclid, round(1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) + 0 AS cosine_distance, round(corr(a, b), 6) + 0 AS pearson FROM x GROUP BY 1, 2")
def euclid_sequences(spark, d):
    n = F.least(F.size("a"), F.size("b"))
    a, b = F.slice(F.col("a.v"), 1, n), F.slice(F.col("b.v"), 1, n)

    def centred(x):
        return S.bind(x, lambda y: S.bind(S.mean(y), lambda m: F.transform(y, lambda z: z - m)))

    return nation_pairs(spark, d).select("id1", "id2", R(A.euclidean(F.col("a.v"), F.col("b.v"))).alias("euclid"), R(1 - scalars.cosine(a, b)).alias("cosine_distance"), R(scalars.cosine(centred(a), centred(b))).alias("pearson"))


@query("set_metric", NATIONS + ", x AS (SELECT id1, id2, unnest(ea) AS a, eb FROM p), y AS (SELECT id1, id2, a, unnest(eb) AS b FROM x) SELECT id1, id2, sum(abs(a - b))::DOUBLE AS total, round(avg(abs(a - b)), 6) AS mean, min(abs(a - b))::DOUBLE AS least FROM y GROUP BY 1, 2")
def set_metric(spark, d):
    a, b = F.col("a.e"), F.col("b.e")
    return nation_pairs(spark, d).select("id1", "id2", A.set_metric(a, b, "sum").alias("total"), R(A.set_metric(a, b, "mean")).alias("mean"), A.set_metric(a, b, "min").alias("least"))


@query("long_metrics")
def long_metrics(spark, d):
    """Metrics that have no short SQL: banded DTW, TWED, Drop-DTW one- and two-sided, in Arrow batches of pairs."""
    tv = [F.col(c).cast("array<double>") for c in ("a.v", "b.v", "a.t", "b.t")]
    te = [F.col(c).cast("array<double>") for c in ("a.e", "b.e", "a.t", "b.t")]
    return nation_pairs(spark, d).select(
        "id1", "id2",
        R(A.metric(lambda a, b: A.np_dtw(a, b, radius=4))(*tv[:2])).alias("dtw_band"), R(A.metric(A.twed)(*tv)).alias("twed"), R(A.metric(A.drop_dtw_hats)(*tv)).alias("drop_dtw_hats"),
        R(A.metric(lambda a, b, ta, tb: A.drop_dtw_one_sided(A.event_costs(a, b, ta, tb), 3.0))(*te)).alias("drop_dtw_partial"),
        R(A.metric(lambda a, b, ta, tb: A.drop_dtw_two_sided(A.event_costs(a, b, ta, tb), 1.0)[0])(*te)).alias("drop_dtw_full"),
    )


@query("curve_fits")
def curve_fits(spark, d):
    """Sigmoid, logistic and Weibull fits of each customer's sequence with at least three points, and the time to half."""
    from .sequence_queries import sequences

    kind = "id long, b double, k double, a double, c double, sse double, d50 double, top double, t0 double, s double, steepness double, t75 double, scale double, shape double"

    def run(batches):
        for pdf in batches:
            x = fits.padded(list(pdf["t"]), list(pdf["v"]))
            (sig, sse), (log, log_sse), (wei, wei_sse) = fits.fit_sigmoid(*x), fits.fit_logistic(*x), fits.fit_weibull(*x)
            log[~np.isfinite(log_sse)], wei[~np.isfinite(wei_sse)] = np.nan, np.nan
            columns = [pdf["id"], *sig.T, sse, fits.d50(*x, sig), *log.T, 1 / np.abs(log[:, 2]), log[:, 1] + log[:, 2] * np.log(3), *wei[:, 1:].T]
            yield type(pdf)(dict(zip([n.split()[0] for n in kind.split(", ")], columns)))

    long = sequences(spark, d).where(F.size("seq") >= 3)
    # little data and much work: as many parts as there are cores at least
    return long.select("id", F.col("seq")["t"].alias("t"), F.col("seq")["v"].alias("v")).repartition(spark.sparkContext.defaultParallelism, "id").mapInPandas(run, kind)


@query("breakpoint_counts")
def breakpoint_counts(spark, d):
    """Points that Ramer-Douglas-Peucker simplification keeps of each customer's sequence."""
    from .sequence_queries import sequences

    q = F.col("seq")
    return sequences(spark, d).select("id", A.metric(A.breakpoints, "long")(q["t"].cast("array<double>"), q["v"]).alias("breakpoints"))
