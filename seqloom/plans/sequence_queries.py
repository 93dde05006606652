"""Queries of the per-entity sequence operators, over the orders of a customer.

A customer's sequence has one point a day with orders: t is the day since the first, v a score made of the largest price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import sequences as S
from seqloom.operators import windows as W

from .registry import query, rounded as R, table

LONG = """WITH m AS (SELECT o_custkey AS id, CAST(o_orderdate AS DATE) AS d, sqrt(max(o_totalprice)) / 12 AS v FROM orders GROUP BY 1, 2),
l AS (SELECT id, date_diff('day', min(d) OVER (PARTITION BY id), d) AS t, v, row_number() OVER (PARTITION BY id ORDER BY d) AS k, count(*) OVER (PARTITION BY id) AS n FROM m),
s AS (SELECT id, k, t, v, n, lead(t) OVER w AS t2, lead(v) OVER w AS v2, lead(t) OVER w - t AS dt, lead(v) OVER w - v AS dv FROM l WINDOW w AS (PARTITION BY id ORDER BY k))
"""


def at(x: int) -> str:
    return f"coalesce(min_by(v + dv * ({x} - t) / dt, k) FILTER (WHERE t <= {x} AND {x} <= t2), arg_max(v, k))"


def measurements(spark, d) -> DataFrame:
    """(id, t, v) rows, one for each day of a customer."""
    days = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), F.to_date("o_orderdate").alias("day")).agg((F.sqrt(F.max("o_totalprice")) / 12).alias("v"))
    return days.select("id", F.date_diff("day", F.min("day").over(Window.partitionBy("id"))).alias("t"), "v")


def sequences(spark, d) -> DataFrame:
    return S.to_sequences(measurements(spark, d), "id", "t", "v")


def of(spark, d, **columns) -> DataFrame:
    return sequences(spark, d).select("id", *[c.alias(n) for n, c in columns.items()])




@query("seq_features", LONG + f"""SELECT id, max(t) AS duration, round((arg_max(v, k) - arg_min(v, k)) / nullif(max(t), 0), 6) + 0 AS slope,
round(arg_min(v, k), 6) AS fv, round(arg_max(v, k), 6) AS lv, round(min(dv / dt), 6) + 0 AS hcs,
round(coalesce(sum(abs(dt * least(v, v2) + dt * dv / 2)), 0), 6) AS auc, round(coalesce(sum(dt * (v + v2) / 2), 0), 6) AS auc_trapezoid,
round((arg_min(v, k) - {at(183)}) * 100 / arg_min(v, k), 6) + 0 AS pc_change_m6, round({at(365)}, 6) AS score_m12,
round(max(abs(dv)), 6) AS max_change, max(dt) AS max_gap, round((arg_max(v, k) - arg_min(v, k)) / arg_min(v, k), 6) + 0 AS variation
FROM s GROUP BY id""")
def seq_features(spark, d):
    q = F.col("seq")
    return of(
        spark, d, duration=S.duration(q).cast("long"), slope=R(S.slope(q)), fv=R(S.first_value(q)), lv=R(S.last_value(q)), hcs=R(S.min_step_slope(q)), auc=R(S.auc_reference(q)),
        auc_trapezoid=R(S.auc_trapezoid(q)), pc_change_m6=R(S.percent_change(q)), score_m12=R(S.interpolate(q, F.lit(365))), max_change=R(S.max_step_change(q)),
        max_gap=S.max_step_gap(q).cast("long"), variation=R(S.relative_variation(q)),
    )


def _window_slope(cond: str) -> str:
    return f"CASE WHEN count(*) FILTER (WHERE {cond}) >= 2 THEN round((arg_max(v, k) FILTER (WHERE {cond}) - arg_min(v, k) FILTER (WHERE {cond})) / (max(t) FILTER (WHERE {cond}) - min(t) FILTER (WHERE {cond})), 6) + 0 END"


@query("seq_windowed_slopes", LONG + f"SELECT id, {_window_slope('t <= 91')} AS slope_m3, {_window_slope('t > 91 AND t <= 182')} AS slope_m3m6, {_window_slope('t <= 182')} AS slope_m6, round(min(dv / dt) FILTER (WHERE t2 <= 182), 6) + 0 AS hcs_m6 FROM s GROUP BY id")
def seq_windowed_slopes(spark, d):
    q = F.col("seq")
    w = lambda a, b: R(S.slope(S.between(q, a, b)))
    return of(spark, d, slope_m3=w(None, S.M3), slope_m3m6=w(S.M3, S.M6), slope_m6=w(None, S.M6), hcs_m6=R(S.min_step_slope(S.between(q, None, S.M6))))


@query("seq_ols", LONG + "SELECT id, CASE WHEN count(*) >= 2 THEN round(regr_slope(v, t), 6) + 0 END AS slope, CASE WHEN count(*) >= 2 THEN round(regr_intercept(v, t), 6) + 0 END AS intercept FROM l GROUP BY id")
def seq_ols(spark, d):
    line = S.ols(F.col("seq"))
    return of(spark, d, slope=R(line["slope"]), intercept=R(line["intercept"]))


@query("seq_quadratic", LONG + """, c AS (SELECT id, t - avg(t) OVER (PARTITION BY id) AS x, v, n FROM l),
z AS (SELECT id, count(*)::DOUBLE AS n, sum(x ** 2) AS x2, sum(x ** 3) AS x3, sum(x ** 4) AS x4, sum(v) AS y, sum(x * v) AS xy, sum(x * x * v) AS x2y FROM c GROUP BY id),
f AS (SELECT *, (x2 * (n * x2y - x2 * y) - n * x3 * xy) / (x2 * (n * x4 - x2 * x2) - n * x3 * x3) AS a FROM z WHERE n >= 3)
SELECT id, round(a * 1000, 6) + 0 AS a1000, round((xy - a * x3) / x2, 6) + 0 AS b, round((y - a * x2) / n, 6) + 0 AS c FROM f""")
def seq_quadratic(spark, d):
    c = S.quadratic(F.col("seq"))
    return of(spark, d, fit=c).where("fit IS NOT NULL").select("id", R(F.col("fit.a") * 1000).alias("a1000"), R(F.col("fit.b")).alias("b"), R(F.col("fit.c")).alias("c"))


@query("seq_early_slope", LONG + """SELECT id, round(CASE WHEN count(*) FILTER (WHERE t <= 365) >= 2 THEN regr_slope(v, t) FILTER (WHERE t <= 365)
WHEN max(t) > 365 THEN (arg_min(v, k) FILTER (WHERE t > 365) - arg_min(v, k)) / (min(t) FILTER (WHERE t > 365) - min(t)) END, 6) + 0 AS early_slope FROM l GROUP BY id""")
def seq_early_slope(spark, d):
    return of(spark, d, early_slope=R(S.early_slope(F.col("seq"))))


@query("seq_curvature", LONG + ", b AS (SELECT *, lead(dv) OVER (PARTITION BY id ORDER BY k) - dv AS bend FROM s) SELECT id, round(1000 * sum(abs(bend)) / (avg(dt) * avg(dt)), 6) + 0 AS curvature FROM b GROUP BY id HAVING count(*) >= 3")
def seq_curvature(spark, d):
    return of(spark, d, curvature=R(S.curvature(F.col("seq")) * 1000)).where("curvature IS NOT NULL")


@query("seq_plateau", LONG + "SELECT id, CAST(coalesce(sum(dt) FILTER (WHERE abs(dv) <= 5 AND dt <= 180), 0) AS BIGINT) AS plateau FROM s GROUP BY id")
def seq_plateau(spark, d):
    return of(spark, d, plateau=S.plateau(F.col("seq"), 5, 180))


def _threshold(h: int) -> str:
    return f"round(coalesce(min_by(t + dt * (v - {h}) / (v - v2), k) FILTER (WHERE v >= {h} AND v2 < {h}), CASE WHEN arg_max(v, k) < {h} THEN max(t) END), 6) AS thr_{h}"


@query("seq_time_to_threshold", LONG + f"SELECT id, {', '.join(map(_threshold, (40, 30, 20, 10)))} FROM s GROUP BY id")
def seq_time_to_threshold(spark, d):
    return of(spark, d, **{f"thr_{h}": R(S.time_to_threshold(F.col("seq"), h)) for h in (40, 30, 20, 10)})


@query("seq_change_point", LONG + """, p AS (SELECT a.id, a.k AS i, a.t AS time, b.t, b.v, b.k <= a.k AS l FROM l a JOIN l b USING (id) WHERE a.n >= 5 AND a.k BETWEEN 2 AND a.n - 2),
r AS (SELECT id, i, time, regr_syy(v, t) FILTER (WHERE l) - regr_sxy(v, t) FILTER (WHERE l) ** 2 / regr_sxx(v, t) FILTER (WHERE l) + regr_syy(v, t) FILTER (WHERE NOT l) - regr_sxy(v, t) FILTER (WHERE NOT l) ** 2 / regr_sxx(v, t) FILTER (WHERE NOT l) AS rss,
regr_syy(v, t) - regr_sxy(v, t) ** 2 / regr_sxx(v, t) AS rss0, regr_slope(v, t) FILTER (WHERE l) AS ls, regr_slope(v, t) FILTER (WHERE NOT l) AS rs FROM p GROUP BY 1, 2, 3),
b AS (SELECT *, (rss0 - rss) / (rss0 + 1e-9) AS gain FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY rss, i) = 1)
SELECT id, CAST(i - 1 AS INT) AS index, CAST(time AS BIGINT) AS time, round(gain, 6) AS improvement, round(ls, 6) + 0 AS left_slope, round(rs, 6) + 0 AS right_slope FROM b WHERE gain >= 0.15""")
def seq_change_point(spark, d):
    found = of(spark, d, c=S.change_point(F.col("seq"))).where("c IS NOT NULL")
    return found.select("id", F.col("c.index").alias("index"), F.col("c.time").cast("long").alias("time"), *[R(F.col(f"c.{n}")).alias(n) for n in ("improvement", "left_slope", "right_slope")])


@query("seq_interval_stats", LONG + "SELECT id, round(avg(dv / dt), 6) + 0 AS mean, round(stddev_pop(dv / dt), 6) + 0 AS std, round(min(dv / dt), 6) + 0 AS max_drop, round(max(dv / dt), 6) + 0 AS max_rise, round(max(abs(dv / dt)), 6) AS max_abs FROM s GROUP BY id HAVING count(*) >= 2")
def seq_interval_stats(spark, d):
    x = S.step_slopes(F.col("seq"))
    return of(spark, d, mean=R(S.mean(x)), std=R(S.std(x)), max_drop=R(F.array_min(x)), max_rise=R(F.array_max(x)), max_abs=R(F.array_max(F.transform(x, F.abs)))).where("mean IS NOT NULL")


@query("seq_descriptive", LONG + """SELECT id, count(*) AS n_visits, max(t) AS time_span, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(min(v), 6) AS low, round(max(v), 6) AS high, round(max(v) - min(v), 6) AS value_range,
round(arg_min(v, k) - arg_max(v, k), 6) + 0 AS total_decline, round((arg_min(v, k) - arg_max(v, k)) / (abs(arg_min(v, k)) + 1e-9), 6) + 0 AS pct_decline, round(stddev_pop(dv), 6) AS variability FROM s GROUP BY id""")
def seq_descriptive(spark, d):
    q, v = F.col("seq"), F.sort_array(F.col("seq")["v"])
    n, decline = F.size(q), S.first_value(q) - S.last_value(q)
    middle = (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2
    return of(
        spark, d, n_visits=n.cast("long"), time_span=S.duration(q).cast("long"), mean=R(S.mean(q["v"])), median=R(middle), low=R(F.array_min(v)), high=R(F.array_max(v)), value_range=R(F.array_max(v) - F.array_min(v)),
        total_decline=R(decline), pct_decline=R(decline / (F.abs(S.first_value(q)) + 1e-9)), variability=R(S.progression_variability(q)),
    )


@query("seq_first_last_three", LONG + "SELECT id, round(regr_slope(v, t) FILTER (WHERE k <= 3), 6) + 0 AS slope_early, round(regr_slope(v, t) FILTER (WHERE k > n - 3), 6) + 0 AS slope_late FROM l GROUP BY id HAVING count(*) >= 3")
def seq_first_last_three(spark, d):
    q = F.col("seq")
    three = sequences(spark, d).where(F.size("seq") >= 3)
    return three.select("id", R(S.ols(F.slice(q, 1, 3))["slope"]).alias("slope_early"), R(S.ols(F.slice(q, -3, 3))["slope"]).alias("slope_late"))


def _grid(x: int) -> str:
    return f"round_even(coalesce(min_by(v + dv * ({x} - t) / dt, k) FILTER (WHERE t <= {x} AND {x} <= t2), CASE WHEN {x} = 0 THEN min_by(v, k) END, 0), 1) AS g{x}"


@query("seq_grid_90", LONG + f"SELECT id, {', '.join(_grid(90 * i) for i in range(6))} FROM s GROUP BY id")
def seq_grid_90(spark, d):
    g = S.grid(F.col("seq"), 90, 6, 1)
    return of(spark, d, g=g).select("id", *[F.col("g")[i].alias(f"g{90 * i}") for i in range(6)])


@query("nearest_visit", LONG + "SELECT id, CAST(min_by(k - 1, struct_pack(a := abs(t - 180), b := k)) FILTER (WHERE abs(t - 180) <= 60) AS INT) AS visit FROM l GROUP BY id")
def nearest_visit(spark, d):
    return of(spark, d, visit=S.nearest(F.col("seq"), F.lit(180), 60))


@query("forward_asof", LONG + "SELECT id, CAST(min(t) FILTER (WHERE t > 365) AS BIGINT) AS t, round(min_by(v, k) FILTER (WHERE t > 365), 6) AS v FROM l GROUP BY id")
def forward_asof(spark, d):
    later = F.try_element_at(S.between(F.col("seq"), S.M12), F.lit(1))
    return of(spark, d, t=later["t"].cast("long"), v=R(later["v"]))


@query("seq_selection", LONG + "SELECT id, count(*) FILTER (WHERE t < 100) AS before_100, count(*) FILTER (WHERE t >= 100) AS from_100, count(*) FILTER (WHERE v > 20) AS above, CAST(list(t ORDER BY k)[1:2] AS VARCHAR) AS head, round(min_by(v, k) FILTER (WHERE t >= 50), 6) AS at_50 FROM l GROUP BY id HAVING count(*) >= 4")
def seq_selection(spark, d):
    q = F.col("seq")
    long = sequences(spark, d).where(F.size("seq") >= 4)
    n = lambda f: F.size(F.filter(q, f)).cast("long")
    head = F.concat(F.lit("["), F.array_join(F.transform(F.slice(q, 1, 2), lambda p: p["t"].cast("string")), ", "), F.lit("]"))
    return long.select("id", n(lambda p: p["t"] < 100).alias("before_100"), n(lambda p: p["t"] >= 100).alias("from_100"), n(lambda p: p["v"] > 20).alias("above"), head.alias("head"), R(F.try_element_at(F.filter(q, lambda p: p["t"] >= 50), F.lit(1))["v"]).alias("at_50"))


@query("seq_anchored", LONG + ", a AS (SELECT id, t / 365.25 AS y, v FROM l UNION ALL SELECT DISTINCT id, 0, 48 FROM l) SELECT id, count(*) AS n, round(avg(y), 6) AS mean_years, round(avg((v - 24) / 12), 6) + 0 AS mean_z FROM a GROUP BY id")
def seq_anchored(spark, d):
    a = S.anchored(F.col("seq"))
    return of(spark, d, n=F.size(a).cast("long"), mean_years=R(S.mean(F.transform(a, lambda p: p["t"] / S.DAYS_PER_YEAR))), mean_z=R(S.mean(F.transform(a, lambda p: (p["v"] - 24) / 12))))


SERIES = """round(sum(v), 6) AS sum_values, round(var_pop(v), 6) AS variance, round(sum(v * v), 6) AS abs_energy, round(avg(abs(dv)), 6) AS mean_abs_change, round(avg(dv), 6) + 0 AS mean_change, round(sqrt(sum(dv * dv)), 6) AS cid,
count(*) FILTER (WHERE v > m) AS above_mean, count(*) FILTER (WHERE v < m) AS below_mean, round(sum((v - m) * (v2 - m)) / ((count(*) - 1) * var_pop(v)), 6) + 0 AS autocorrelation, round(regr_slope(v, k - 1), 6) + 0 AS trend, round(max(v) / sqrt(avg(v * v)), 6) AS crest"""


@query("seq_series_features", LONG + f", x AS (SELECT *, avg(v) OVER (PARTITION BY id) AS m FROM s) SELECT id, {SERIES} FROM x GROUP BY id HAVING count(*) >= 3")
def seq_series_features(spark, d):
    """Features of a series by its order alone, as aggregates over the long form."""
    w = Window.partitionBy("id").orderBy("t")
    x = measurements(spark, d).withColumns({"v2": F.lead("v").over(w), "k": F.row_number().over(w) - 1, "m": F.avg("v").over(Window.partitionBy("id"))}).withColumn("dv", F.col("v2") - F.col("v"))
    n = F.count("*")
    out = x.groupBy("id").agg(
        R(F.sum("v")).alias("sum_values"), R(F.var_pop("v")).alias("variance"), R(F.sum(F.col("v") * F.col("v"))).alias("abs_energy"), R(F.avg(F.abs("dv"))).alias("mean_abs_change"), R(F.avg("dv")).alias("mean_change"),
        R(F.sqrt(F.sum(F.col("dv") * F.col("dv")))).alias("cid"), F.count_if(F.col("v") > F.col("m")).alias("above_mean"), F.count_if(F.col("v") < F.col("m")).alias("below_mean"),
        R(F.try_divide(F.sum((F.col("v") - F.col("m")) * (F.col("v2") - F.col("m"))), (n - 1) * F.var_pop("v"))).alias("autocorrelation"), R(F.regr_slope("v", "k")).alias("trend"), R(F.max("v") / F.sqrt(F.avg(F.col("v") * F.col("v")))).alias("crest"), n.alias("n"),
    )
    return out.where("n >= 3").drop("n")


@query("snapshots", """WITH o AS (SELECT o_custkey AS id, o_orderkey AS k, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders),
w AS (SELECT a.id, CAST(a.r - 1 AS INT) AS start, a.k AS k0, b.k AS k1, c.k AS k2 FROM o a JOIN o b ON b.id = a.id AND b.r = a.r + 1 JOIN o c ON c.id = a.id AND c.r = a.r + 2 WHERE a.s <> 'F' AND b.s <> 'F')
SELECT * FROM w""")
def snapshots(spark, d):
    """Three orders in a row of which the first two are not finished."""
    o = table(spark, d, "orders")
    found = W.snapshots(o, "o_custkey", ["o_orderdate", "o_orderkey"], 3, ["o_orderkey", "o_orderstatus"], lambda row: row["o_orderstatus"] == "F")
    return found.select(F.col("o_custkey").alias("id"), "start", *[F.col("snapshot")[i]["o_orderkey"].alias(f"k{i}") for i in range(3)])


@query("snapshots_first_wide", """WITH o AS (SELECT o_custkey AS id, o_orderpriority AS p, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders)
SELECT id, max(p) FILTER (WHERE r = 1) AS p0, max(p) FILTER (WHERE r = 2) AS p1, max(p) FILTER (WHERE r = 3) AS p2 FROM o GROUP BY id HAVING count(*) >= 3""")
def snapshots_first_wide(spark, d):
    o = table(spark, d, "orders")
    found = W.snapshots(o, "o_custkey", ["o_orderdate", "o_orderkey"], 3, ["o_orderpriority"]).where("start = 0")
    return found.select(F.col("o_custkey").alias("id"), *[F.col("snapshot")[i]["o_orderpriority"].alias(f"p{i}") for i in range(3)])


@query("event_grid", """WITH e AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS code FROM events),
b AS (SELECT user_id, CAST((day - (SELECT min(day) FROM e)) // 3 AS INT) AS bucket, code FROM e),
g AS (SELECT u.user_id, CAST(r.range AS INT) AS bucket FROM (SELECT DISTINCT user_id FROM b) u, range((SELECT max(bucket) + 1 FROM b)) r)
SELECT g.user_id, g.bucket, CAST(coalesce(max(b.code), 20) AS INT) AS code FROM g LEFT JOIN b USING (user_id, bucket) GROUP BY 1, 2""")
def event_grid(spark, d):
    """Events on a grid of three days common to all users: the most important code of each cell, 20 where there is none."""
    codes = F.create_map(*[x for k, v in {"signup": 1, "view": 2, "click": 3, "purchase": 4, "error": 5}.items() for x in (F.lit(k), F.lit(v))])
    e = table(spark, d, "events").select("user_id", F.date_diff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("day"), F.coalesce(F.try_element_at(codes, F.col("event_type")), F.lit(5)).alias("code"))
    return W.event_grid(e, "user_id", "day", "code", 3, 20)


@query("event_sessions", """WITH e AS (SELECT user_id, event_id, ts, event_type, CASE WHEN ts - lag(ts) OVER w > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e)
SELECT user_id, CAST(session AS BIGINT) AS session, event_id AS first_event, lead(event_id) OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS next_event FROM s
QUALIFY next_event IS NOT NULL""")
def event_sessions(spark, d):
    """Neighbouring events of a session, a session ending with a gap of more than 12 hours."""
    return W.session_pairs(table(spark, d, "events"), "user_id", "ts", "event_id", 12 * 3600).withColumnsRenamed({"a": "first_event", "b": "next_event"})


@query("ci95_by_position", """WITH o AS (SELECT c_mktsegment AS segment, sqrt(o_totalprice) AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT segment, CAST(pos AS INT) AS pos, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) + 0 AS std, round(1.96 * stddev_pop(x) / sqrt(count(*)), 6) + 0 AS half FROM o WHERE pos <= 5 GROUP BY 1, 2""")
def ci95_by_position(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select(F.col("c_mktsegment").alias("segment"), F.sqrt("o_totalprice").alias("x"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("pos")).where("pos <= 5")
    return o.groupBy("segment", "pos").agg(F.count("*").alias("n"), R(F.avg("x")).alias("mean"), R(F.stddev_pop("x")).alias("std"), R(1.96 * F.stddev_pop("x") / F.sqrt(F.count("*"))).alias("half"))


@query("trajectory_slopes", """WITH o AS (SELECT c_mktsegment AS segment, sqrt(o_totalprice) AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT segment, CAST(pos AS INT) AS pos, avg(x) AS mean FROM o WHERE pos <= 5 GROUP BY 1, 2)
SELECT segment, pos, round(mean - lag(mean) OVER (PARTITION BY segment ORDER BY pos), 6) + 0 AS slope FROM m""")
def trajectory_slopes(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select(F.col("c_mktsegment").alias("segment"), F.sqrt("o_totalprice").alias("x"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("pos")).where("pos <= 5")
    m = o.groupBy("segment", "pos").agg(F.avg("x").alias("mean"))
    return m.select("segment", "pos", R(F.col("mean") - F.lag("mean").over(Window.partitionBy("segment").orderBy("pos"))).alias("slope"))
