"""Survival statistics from (group, duration, event) rows.

Everything is computed from counts by distinct duration, so the amount of ordered data does not depend on the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def risk_sets(df: DataFrame, group: str, duration: str, event: str) -> DataFrame:
    """(group, t, d, at_risk): events at each distinct duration and entities still there."""
    by = df.groupBy(F.col(group).alias("grp"), F.col(duration).alias("t")).agg(F.sum(F.col(event).cast("long")).alias("d"), F.count("*").alias("n"))
    return by.withColumn("at_risk", F.sum("n").over(Window.partitionBy("grp").orderBy(F.desc("t"))))


def kaplan_meier(df: DataFrame, group: str, duration: str, event: str) -> DataFrame:
    """(grp, t, at_risk, d, survival): the product of 1 - d / at_risk; 0 from the first time at which all go."""
    w = Window.partitionBy("grp").orderBy("t")
    r = risk_sets(df, group, duration, event)
    gone = F.max(F.when(F.col("d") == F.col("at_risk"), 1).otherwise(0)).over(w)
    logs = F.sum(F.when(F.col("d") < F.col("at_risk"), F.log(1 - F.col("d") / F.col("at_risk"))).otherwise(0.0)).over(w)
    return r.select("grp", "t", "at_risk", "d", F.when(gone == 1, 0.0).otherwise(F.exp(logs)).alias("survival"))


def median_survival(curve: DataFrame) -> DataFrame:
    """(grp, median): the first time at which survival is one half or less; NULL if it never is."""
    return curve.groupBy("grp").agg(F.min(F.when(F.col("survival") <= 0.5 + 1e-12, F.col("t"))).alias("median"))


def survival_summary(df: DataFrame, group: str, duration: str, event: str, z: float = 1.959963984540054) -> DataFrame:
    """(grp, n, median, median_low, median_high): the median and its confidence interval, the times at which the bounds of
    the survival curve (by Greenwood's variance of log(-log S)) first reach one half; NULL where they never do."""
    curve = kaplan_meier(df, group, duration, event)
    w = Window.partitionBy("grp").orderBy("t")
    left = F.col("at_risk") - F.col("d")
    curve = curve.withColumn("g", F.sum(F.try_divide(F.col("d").cast("double"), F.col("at_risk") * left)).over(w))
    inside = (F.col("survival") > 0) & (F.col("survival") < 1)
    log_s = F.when(inside, F.log("survival"))
    wide = F.when(inside, F.lit(z) * F.sqrt("g") / -log_s)
    # S ** exp(-+ z * se); where S is 0 or 1 both bounds are S
    upper = F.coalesce(F.pow("survival", F.exp(-wide)), F.col("survival"))
    lower = F.coalesce(F.pow("survival", F.exp(wide)), F.col("survival"))
    first = lambda s: F.min(F.when(s <= 0.5 + 1e-12, F.col("t")))
    found = curve.groupBy("grp").agg(F.max("at_risk").alias("n"), first(F.col("survival")).alias("median"), first(lower).alias("median_low"), first(upper).alias("median_high"))
    return found


def logrank(df: DataFrame, group: str, duration: str, event: str) -> DataFrame:
    """(group1, group2, logrank, wilcoxon): statistics of each pair of groups, unweighted and weighted by those at risk."""
    by = df.groupBy(F.col(group).alias("grp"), F.col(duration).alias("t")).agg(F.sum(F.col(event).cast("long")).alias("d"), F.count("*").alias("n"))
    groups = df.select(F.col(group).alias("grp")).distinct()
    two = groups.select(F.col("grp").alias("g1")).join(groups.select(F.col("grp").alias("g2")), F.col("g1") < F.col("g2"))
    # each pair under either of its groups: an equi-join of two small tables
    rows = two.select(F.explode(F.array("g1", "g2")).alias("grp"), "g1", "g2").join(by, "grp")
    first = F.col("grp") == F.col("g1")
    at = rows.groupBy("g1", "g2", "t").agg(F.sum("d").alias("d"), F.sum("n").alias("n"), F.sum(F.when(first, F.col("d")).otherwise(0)).alias("d1"), F.sum(F.when(first, F.col("n")).otherwise(0)).alias("n1"))
    w = Window.partitionBy("g1", "g2").orderBy(F.desc("t"))
    at = at.withColumns({"n": F.sum("n").over(w).cast("double"), "n1": F.sum("n1").over(w).cast("double")}).where("d > 0")
    expected = F.col("d") * F.col("n1") / F.col("n")
    variance = F.when(F.col("n") > 1, F.col("d") * (F.col("n1") / F.col("n")) * (1 - F.col("n1") / F.col("n")) * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    at = at.withColumns({"o_e": F.col("d1") - expected, "v": variance})
    stat = lambda k: F.try_divide(F.pow(F.sum(F.col("o_e") * F.pow(F.col("n"), F.lit(k))), F.lit(2)), F.sum(F.col("v") * F.pow(F.col("n"), F.lit(2 * k))))
    return at.groupBy(F.col("g1").alias("group1"), F.col("g2").alias("group2")).agg(stat(0).alias("logrank"), stat(1).alias("wilcoxon"))


def chi2_tail(x: float | None, df: int = 1) -> float | None:
    """P(chi-square with df degrees of freedom > x), by the series and the continued fraction of the incomplete gamma."""
    if x is None or x < 0:
        return None
    a, x = df / 2, x / 2
    if x == 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h
