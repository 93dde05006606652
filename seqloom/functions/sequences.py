"""Sequences: one array of (t, v) structs per entity, in order of time, and Column functions on them.

Every function takes the sequence column and returns a Column built from Spark's own array functions, so a feature is
computed where its row is, without a shuffle.  Sequences are short of points where a result isn't defined: NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25
M3, M6, M6_PREDICT, M12 = 91, 182, 183, 365


def to_sequences(df: DataFrame, id: str, t: str, v: str, out: str = "seq") -> DataFrame:
    """(id, seq): rows with a null time or value are left out; points of equal time are in order of value."""
    points = F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(v).cast("double").alias("v"))))
    return df.where(F.col(t).isNotNull() & F.col(v).isNotNull()).groupBy(id).agg(points.alias(out))


def bind(value: Column, body) -> Column:
    """``body(x)`` with x bound to ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def point(seq: Column, k: int) -> Column:
    """The k-th point (negative: from the end), NULL if there is none."""
    return F.try_element_at(seq, F.lit(k))


def first_value(seq: Column) -> Column:
    return point(seq, 1)["v"]


def last_value(seq: Column) -> Column:
    return point(seq, -1)["v"]


def duration(seq: Column) -> Column:
    return point(seq, -1)["t"]


def steps(seq: Column) -> Column:
    """One struct (a, b, dt, dv) for each pair of neighbouring points."""
    n = F.greatest(F.size(seq) - 1, F.lit(0))
    return F.zip_with(F.slice(seq, 1, n), F.slice(seq, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b"), (b["t"] - a["t"]).alias("dt"), (b["v"] - a["v"]).alias("dv")))


def step_slopes(seq: Column) -> Column:
    """Slope of each step; steps without duration have none."""
    return F.filter(F.transform(steps(seq), lambda s: F.try_divide(s["dv"], s["dt"])), lambda x: x.isNotNull())


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def mean(array: Column) -> Column:
    return F.try_divide(total(array), F.size(array))


def std(array: Column) -> Column:
    """Population standard deviation."""
    return bind(array, lambda a: bind(mean(a), lambda m: F.sqrt(mean(F.transform(a, lambda x: (x - m) * (x - m))))))


def slope(seq: Column) -> Column:
    """Slope from the first to the last point."""
    a, b = point(seq, 1), point(seq, -1)
    return F.try_divide(b["v"] - a["v"], b["t"] - a["t"])


def relative_variation(seq: Column) -> Column:
    return F.try_divide(last_value(seq) - first_value(seq), first_value(seq))


def auc_reference(seq: Column) -> Column:
    """Sum over steps of |dt * min(v) + dt * dv / 2| with signed dv: short of the trapezoid on falling steps."""
    return total(F.transform(steps(seq), lambda s: F.abs(s["dt"] * F.least(s["a"]["v"], s["b"]["v"]) + s["dt"] * s["dv"] / 2)))


def auc_trapezoid(seq: Column) -> Column:
    return total(F.transform(steps(seq), lambda s: s["dt"] * (s["a"]["v"] + s["b"]["v"]) / 2))


def min_step_slope(seq: Column) -> Column:
    """The steepest fall (the "highest consecutive slope" of declining scores)."""
    return F.array_min(step_slopes(seq))


def max_step_change(seq: Column) -> Column:
    return F.array_max(F.transform(steps(seq), lambda s: F.abs(s["dv"])))


def max_step_gap(seq: Column) -> Column:
    return F.array_max(F.transform(steps(seq), lambda s: F.abs(s["dt"])))


def interpolate(seq: Column, x: Column, outside: Column | None = None) -> Column:
    """Value at time x by straight lines; beyond the ends the end value, or ``outside`` if given."""
    step = F.try_element_at(F.filter(steps(seq), lambda s: (s["a"]["t"] <= x) & (x <= s["b"]["t"])), F.lit(1))
    inside = bind(step, lambda s: F.when(s["dt"] == 0, s["a"]["v"]).otherwise(s["a"]["v"] + s["dv"] * (x - s["a"]["t"]) / s["dt"]))
    a, b = point(seq, 1), point(seq, -1)
    below, above = (a["v"], b["v"]) if outside is None else (outside, outside)
    return F.when(x < a["t"], below).when(x > b["t"], above).when(F.size(seq) == 1, a["v"]).otherwise(inside)


def percent_change(seq: Column, x: int = M6_PREDICT) -> Column:
    """Fall in per cent of the first value, at x days or at the end if that is sooner."""
    return F.try_divide((first_value(seq) - interpolate(seq, F.lit(x))) * 100, first_value(seq))


def linspace(a: Column, b: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: a + i * (b - a) / F.lit(n - 1))


def grid(seq: Column, interval: int = 90, n: int = 6, digits: int | None = None) -> Column:
    """Values at 0, interval, ... (n points), 0 outside the observed range.

    ``digits`` rounds the scaled double, a half to the even digit, as numpy does: 0.8500000000000001 * 10 is 8.5 and gives 0.8.
    """
    out = F.transform(F.sequence(F.lit(0), F.lit((n - 1) * interval), F.lit(interval)), lambda x: interpolate(seq, x, F.lit(0.0)))
    return out if digits is None else F.transform(out, lambda v: F.rint(v * F.lit(10.0**digits)) / F.lit(10.0**digits))


def between(seq: Column, low: float | None = None, high: float | None = None) -> Column:
    """Points with low < t <= high."""
    return F.filter(seq, lambda p: (F.lit(True) if low is None else p["t"] > low) & (F.lit(True) if high is None else p["t"] <= high))


def ols(seq: Column) -> Column:
    """Least squares line: struct(slope, intercept at t = 0); NULL with fewer than two different times."""
    def fit(p: Column) -> Column:
        def sums(m: Column) -> Column:
            sxx = total(F.transform(p, lambda x: (x["t"] - m["t"]) * (x["t"] - m["t"])))
            sxy = total(F.transform(p, lambda x: (x["t"] - m["t"]) * (x["v"] - m["v"])))
            return bind(F.try_divide(sxy, sxx), lambda b: F.when(b.isNotNull(), F.struct(b.alias("slope"), (m["v"] - b * m["t"]).alias("intercept"))))

        means = F.struct(mean(F.transform(p, lambda x: x["t"].cast("double"))).alias("t"), mean(F.transform(p, lambda x: x["v"])).alias("v"))
        return F.when(F.size(p) >= 2, bind(means, sums))

    return bind(seq, fit)


def quadratic(seq: Column) -> Column:
    """Least squares a x^2 + b x + c on centred times x = t - mean(t): struct(a, b, c); NULL with fewer than three points."""
    def fit(p: Column) -> Column:
        def centred(m: Column) -> Column:
            def solve(q: Column) -> Column:
                def with_sums(s: Column) -> Column:
                    # normal equations; the sum of x is zero
                    det = s["x2"] * (s["n"] * s["x4"] - s["x2"] * s["x2"]) - s["n"] * s["x3"] * s["x3"]
                    a = F.try_divide(s["x2"] * (s["n"] * s["x2y"] - s["x2"] * s["y"]) - s["n"] * s["x3"] * s["xy"], det)
                    return bind(a, lambda k: bind(F.try_divide(s["xy"] - k * s["x3"], s["x2"]), lambda b: F.when(k.isNotNull(), F.struct(k.alias("a"), b.alias("b"), ((s["y"] - k * s["x2"]) / s["n"]).alias("c")))))

                power = lambda k, y=False: total(F.transform(q, lambda z: F.pow(z["x"], F.lit(float(k))) * (z["y"] if y else F.lit(1.0))))
                return bind(F.struct(F.size(q).cast("double").alias("n"), power(2).alias("x2"), power(3).alias("x3"), power(4).alias("x4"), power(0, True).alias("y"), power(1, True).alias("xy"), power(2, True).alias("x2y")), with_sums)

            return bind(F.transform(p, lambda z: F.struct((z["t"] - m).alias("x"), z["v"].alias("y"))), solve)

        return F.when(F.size(p) >= 3, bind(mean(F.transform(p, lambda z: z["t"].cast("double"))), centred))

    return bind(seq, fit)


def early_slope(seq: Column, window: int = M12) -> Column:
    """OLS slope of the points up to ``window``; with only one such point, the slope from it to the next point."""
    early = between(seq, None, window)
    later = F.try_element_at(between(seq, window), F.lit(1))
    only = F.try_element_at(early, F.lit(1))
    return F.when(F.size(early) >= 2, ols(early)["slope"]).when(F.size(early) == 1, F.try_divide(later["v"] - only["v"], later["t"] - only["t"]))


def curvature(seq: Column) -> Column:
    """Sum of absolute second differences over the squared mean time step; NULL with fewer than three points."""
    s = steps(seq)
    n = F.greatest(F.size(seq) - 2, F.lit(0))
    bends = F.zip_with(F.slice(s, 1, n), F.slice(s, 2, n), lambda a, b: F.abs(b["dv"] - a["dv"]))
    gap = mean(F.transform(s, lambda x: x["dt"].cast("double")))
    return F.when(F.size(seq) >= 3, F.try_divide(total(bends), gap * gap))


def plateau(seq: Column, delta: float = 1, window: int = 90) -> Column:
    """Total duration of steps that change by at most ``delta`` and last at most ``window``."""
    return F.aggregate(F.filter(steps(seq), lambda s: (F.abs(s["dv"]) <= delta) & (s["dt"] <= window)), F.lit(0).cast("long"), lambda z, s: z + s["dt"])


def progression_variability(seq: Column) -> Column:
    return F.when(F.size(seq) >= 2, std(F.transform(steps(seq), lambda s: s["dv"])))


def time_to_threshold(seq: Column, threshold: float) -> Column:
    """Time of the first fall below the threshold, by straight lines; the last time if the sequence ends below it without a fall."""
    fall = F.try_element_at(F.filter(steps(seq), lambda s: (s["a"]["v"] >= threshold) & (s["b"]["v"] < threshold)), F.lit(1))
    at = bind(fall, lambda s: s["a"]["t"] + s["dt"] * (s["a"]["v"] - threshold) / (s["a"]["v"] - s["b"]["v"]))
    return F.when(fall.isNotNull(), at).when(last_value(seq) < threshold, point(seq, -1)["t"].cast("double"))


def rss(seq: Column) -> Column:
    """Residual sum of squares of the least squares line; around the mean if all times are equal."""
    def of(p: Column) -> Column:
        line = F.coalesce(ols(p), F.struct(F.lit(0.0).alias("slope"), mean(F.transform(p, lambda x: x["v"])).alias("intercept")))
        return bind(line, lambda m: total(F.transform(p, lambda x: F.pow(x["v"] - m["intercept"] - m["slope"] * x["t"], F.lit(2.0)))))

    return bind(seq, of)


def change_point(seq: Column, least: int = 2, gain: float = 0.15) -> Column:
    """Best split into two lines: struct(index, time, improvement, left_slope, right_slope).

    The left part ends with the point at ``index`` (from 0); both parts have at least ``least`` points.  NULL with fewer
    than 2 * least + 1 points, or if the residual sum falls by less than a share of ``gain``.  The first of equal splits.
    """
    def search(p: Column) -> Column:
        def split(i: Column) -> Column:
            left, right = F.slice(p, F.lit(1), i + 1), F.slice(p, i + 2, F.size(p))
            return F.struct((rss(left) + rss(right)).alias("rss"), i.alias("i"))

        def gated(x: Column) -> Column:
            i = x["best"]["i"]
            improvement = (x["all"] - x["best"]["rss"]) / (x["all"] + F.lit(1e-9))
            return F.when(
                improvement >= gain,
                F.struct(i.alias("index"), p[i]["t"].alias("time"), improvement.alias("improvement"), ols(F.slice(p, F.lit(1), i + 1))["slope"].alias("left_slope"), ols(F.slice(p, i + 2, F.size(p)))["slope"].alias("right_slope")),
            )

        best = F.array_min(F.transform(F.sequence(F.lit(least - 1), F.size(p) - least - 1), split))
        return F.when(F.size(p) >= 2 * least + 1, bind(F.struct(best.alias("best"), rss(p).alias("all")), gated))

    return bind(seq, search)


def nearest(seq: Column, target: Column, tolerance: float) -> Column:
    """Index (from 0) of the point nearest in time to ``target``, the first of equals; NULL beyond the tolerance."""
    best = F.array_min(F.transform(seq, lambda p, i: F.struct(F.abs(p["t"] - target).alias("gap"), i.alias("i"))))
    return F.when(best["gap"] <= tolerance, best["i"])


def anchored(seq: Column, t: float = 0.0, v: float = 48.0) -> Column:
    """The sequence with an onset point put before it."""
    return F.concat(F.array(F.struct(F.lit(t).alias("t"), F.lit(v).alias("v"))), F.transform(seq, lambda p: F.struct(p["t"].cast("double").alias("t"), p["v"].alias("v"))))
