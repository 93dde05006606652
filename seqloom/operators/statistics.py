"""Association of columns, and selections of features by it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.ranges import running
from seqloom.operators.survival import chi2_tail


def with_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with <column>_rank, the average rank of equal values, found from counts by distinct value in ranges."""
    for c in columns:
        counts = df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).where("value IS NOT NULL")
        ranks = running(counts, "value", "n", "upto").select("value", (F.col("upto") - (F.col("n") - 1) / 2).alias(f"{c}_rank"))
        df = df.join(ranks, df[c] == ranks["value"], "left").drop("value")
    return df


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    return with_ranks(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b), [a, b]).agg(F.corr(f"{a}_rank", f"{b}_rank").alias("spearman"))


def cramers_v(df: DataFrame, a: str, b: str, yates: bool = True) -> DataFrame:
    """One row: chi2, Cramér's V; with Yates' correction for tables of two by two."""
    df = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    n = F.sum("n").over(Window.partitionBy())
    # every combination of values, met or not
    full = rows.withColumnRenamed("a", "ra").join(cols.withColumnRenamed("b", "rb"), F.lit(True)).join(cells.withColumn("total", n), (F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb")), "left")
    r, c, total = rows.count(), cols.count(), F.max("total").over(Window.partitionBy())
    gap = F.abs(F.coalesce("n", F.lit(0)) - F.col("na") * F.col("nb") / total)
    if yates and r == 2 and c == 2:
        gap = F.greatest(gap - 0.5, F.lit(0.0))
    parts = full.select((gap * gap / (F.col("na") * F.col("nb") / total)).alias("part"), total.alias("total"))
    k = max(1, min(r, c) - 1)
    return parts.agg(F.sum("part").alias("chi2"), F.sqrt(F.sum("part") / (F.max("total") * k)).alias("cramers_v"))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: the Kruskal-Wallis statistic, raw and corrected for ties, and the number of groups."""
    df = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(value, group)
    ranked = with_ranks(df, [value])
    by = ranked.groupBy(group).agg(F.sum(f"{value}_rank").alias("r"), F.count("*").alias("n"))
    h = by.agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("n").alias("n"), F.count("*").alias("k"))
    ties = df.groupBy(value).agg(F.count("*").cast("double").alias("m")).agg(F.sum(F.pow("m", F.lit(3)) - F.col("m"))).first()[0] or 0.0
    n = F.col("n").cast("double")
    raw = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    return h.select(raw.alias("h"), F.try_divide(raw, 1 - F.lit(ties) / (n * n * n - n)).alias("h_corrected"), F.col("k").alias("groups"))


def correlation_matrix(df: DataFrame, columns: list[str], method: str = "pearson") -> dict[tuple[str, str], float]:
    """Correlations of all pairs of columns in one aggregation."""
    names = columns
    if method == "spearman":
        df, names = with_ranks(df.select(*columns), columns), [f"{c}_rank" for c in columns]
    two = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    if not two:
        return {}
    row = df.agg(*[F.corr(names[i], names[j]) for i, j in two]).first()
    return {(columns[i], columns[j]): row[k] for k, (i, j) in enumerate(two)}


def drop_correlated(df: DataFrame, first: list[str], second: list[str], method: str = "spearman", threshold: float = 0.7) -> list[str]:
    """The columns of ``first`` that are not correlated, at the threshold or beyond, with any other column of ``second`` still kept."""
    found = correlation_matrix(df, list(dict.fromkeys([*first, *second])), method)
    kept = list(first)
    for c in first:
        others = [o for o in second if o != c and (o not in first or o in kept)]
        if any(abs(found.get((c, o), found.get((o, c))) or 0) >= threshold for o in others):
            kept.remove(c)
    return kept


def drop_associated(df: DataFrame, columns: list[str], threshold: float = 0.7) -> list[str]:
    """The nominal columns left when, of each pair whose Cramér's V reaches the threshold, the first is removed (pairs in
    order; removed columns are compared no more)."""
    kept = list(columns)
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            if a in kept and b in kept and (cramers_v(df, a, b).first()["cramers_v"] or 0.0) >= threshold:
                kept.remove(a)
    return kept


def drop_explained(df: DataFrame, nominal: list[str], numeric: list[str], level: float = 0.05) -> list[str]:
    """The nominal columns whose groups differ in no numeric column by the Kruskal-Wallis test; one of fewer than two
    groups is not tested and stays."""
    kept = []
    for c in nominal:
        tests = [kruskal(df, x, c).first() for x in numeric]
        tails = [chi2_tail(t["h_corrected"], t["groups"] - 1) for t in tests if t["h_corrected"] is not None and t["groups"] > 1]
        if not any(p is not None and p < level for p in tails):
            kept.append(c)
    return kept


def principal_features(df: DataFrame, columns: list[str], share: float = 0.8, seed: int = 42) -> list[str]:
    """Principal feature analysis: the components that explain ``share`` of the variance of the standardised columns, their
    loadings clustered into as many groups, and the column nearest to each group's centre.

    Only the correlation matrix, of the number of columns squared, reaches the driver.
    """
    found = correlation_matrix(df, columns)
    m = np.eye(len(columns))
    for (a, b), r in found.items():
        i, j = columns.index(a), columns.index(b)
        m[i, j] = m[j, i] = r if r is not None else 0.0
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(-values)
    q = int(np.searchsorted(np.cumsum(values[order]) / values.sum(), share) + 1)
    loadings = vectors[:, order[:q]] * np.sign(vectors[np.abs(vectors[:, order[:q]]).argmax(0), order[:q]])
    rng = np.random.default_rng(seed)
    centres = loadings[rng.choice(len(columns), q, replace=False)]
    for _ in range(100):
        nearest = ((loadings[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        again = np.array([loadings[nearest == k].mean(0) if (nearest == k).any() else centres[k] for k in range(q)])
        if np.allclose(again, centres):
            break
        centres = again
    return sorted({columns[int(((loadings - c) ** 2).sum(1).argmin())] for c in centres})
