"""Weak supervision: labelling functions as Columns, their votes, their analysis, and models of the hidden label.

A labelling function is a name and a function of nothing that returns a Column of votes: -1 abstains, 0.. are classes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.pairs import Gaps
from seqloom.operators.ranges import percentiles

ABSTAIN = -1


@dataclass
class LabelingFunction:
    name: str
    vote: Callable[..., Column]
    resources: dict = field(default_factory=dict)

    def column(self) -> Column:
        return F.coalesce(self.vote(**self.resources).cast("int"), F.lit(ABSTAIN))


def labeling_function(name: str | None = None, **resources):
    """Decorator: a function returning a Column becomes a labelling function."""
    return lambda f: LabelingFunction(name or f.__name__, f, resources)


def keyword_lf(column: str, keywords: list[str], label: int) -> LabelingFunction:
    """Votes ``label`` where the text contains one of the keywords, in any case."""
    def vote() -> Column:
        text = F.lower(column)
        found = F.lit(False)
        for k in keywords:
            found = found | text.contains(k.lower())
        return F.when(found, label).otherwise(ABSTAIN)

    return LabelingFunction(f"keyword_{keywords[0]}", vote)


def quartile_lf(df: DataFrame, column: str, known: Gaps | None = None) -> LabelingFunction:
    """0 (together) up to the first quartile, 1 (apart) from the third, abstaining between them and on nulls.

    The quartiles are computed once, here; from the gaps of the feature, if ``column`` holds its differences for all pairs.
    """
    if known:
        low, high = known.percentiles([0.25, 0.75])
    else:
        found = percentiles(df.select(F.lit(0).alias("all"), column), "all", column, [0.25, 0.75]).first()
        low, high = (found["p0"], found["p1"]) if found else (None, None)
    return LabelingFunction(f"quartile_{column}", lambda: F.when(F.col(column) <= F.lit(low), 0).when(F.col(column) >= F.lit(high), 1).otherwise(ABSTAIN))


def votes(df: DataFrame, lfs: list[LabelingFunction], into: str = "votes") -> DataFrame:
    return df.withColumn(into, F.array(*[f.column() for f in lfs]))


def worker_votes(df: DataFrame, item: str, worker: str, label: str) -> DataFrame:
    """(item, one column for each worker): crowd labels as votes, -1 where a worker has none."""
    wide = df.groupBy(item).pivot(worker).agg(F.first(label, ignorenulls=True))
    return wide.fillna(ABSTAIN, subset=[c for c in wide.columns if c != item])


def voted(into: str = "votes") -> Column:
    """Whether any function voted."""
    return F.exists(F.col(into), lambda v: v != ABSTAIN)


def majority(into: str = "votes", classes: int = 2) -> Column:
    """The class with most votes; -1 on a tie and where nobody voted."""
    of = lambda c: F.size(F.filter(F.col(into), lambda v: v == c))
    counts = F.array(*[of(c) for c in range(classes)])
    top = F.array_max(counts)
    tie = F.size(F.filter(counts, lambda n: n == top)) > 1
    return F.when((top == 0) | tie, ABSTAIN).otherwise(F.array_position(counts, top).cast("int") - 1)


def analysis(df: DataFrame, names: list[str], into: str = "votes", truth: str | None = None) -> DataFrame:
    """One row per function: polarity, coverage, overlaps, conflicts and, with a truth column, correct, incorrect, accuracy."""
    v = F.col(into)
    rows = df.select(*([F.col(truth).alias("truth")] if truth else []), v.alias("all"), F.posexplode(v).alias("j", "vote"))
    active = F.col("vote") != ABSTAIN
    others = F.filter(F.col("all"), lambda x: x != ABSTAIN)
    made = [
        F.array_sort(F.collect_set(F.when(active, F.col("vote")))).alias("polarity"),
        F.avg(active.cast("int")).alias("coverage"),
        F.avg((active & (F.size(others) > 1)).cast("int")).alias("overlaps"),
        F.avg((active & F.exists(others, lambda x: x != F.col("vote"))).cast("int")).alias("conflicts"),
    ]
    if truth:
        made += [F.count_if(active & (F.col("vote") == F.col("truth"))).alias("correct"), F.count_if(active & (F.col("vote") != F.col("truth"))).alias("incorrect"), F.avg(F.when(active, (F.col("vote") == F.col("truth")).cast("int"))).alias("accuracy")]
    named = F.create_map(*[x for j, n in enumerate(names) for x in (F.lit(j), F.lit(n))])
    return rows.groupBy("j").agg(*made).withColumn("lf", named[F.col("j")])


class LabelModel:
    """Two classes: each function's accuracy from the agreement of triplets, votes combined as independent evidence.

    With votes in -1, 0, 1 (0 for abstaining) and functions independent given the label, the mean product of two
    functions' votes, where both vote, is the product of their biases 2 * accuracy - 1; three such products give each.
    Only the matrix of pairwise means reaches the driver, and predictions are Columns of the votes.
    """

    def __init__(self, balance: float = 0.5):
        self.balance = balance
        self.accuracy: list[float] = []

    def fit(self, df: DataFrame, n: int, into: str = "votes") -> "LabelModel":
        s = [F.when(F.col(into)[j] == 1, 1.0).when(F.col(into)[j] == 0, -1.0) for j in range(n)]
        two = [(i, j) for i in range(n) for j in range(i + 1, n)]
        row = df.agg(*[F.avg(s[i] * s[j]) for i, j in two]).first() if two else []
        m = np.full((n, n), np.nan)
        for k, (i, j) in enumerate(two):
            m[i, j] = m[j, i] = row[k] if row[k] is not None else np.nan
        for i in range(n):
            found = []
            for j in range(n):
                for k in range(j + 1, n):
                    if i not in (j, k) and np.isfinite([m[i, j], m[i, k], m[j, k]]).all() and abs(m[j, k]) > 1e-3:
                        found.append(abs(m[i, j] * m[i, k] / m[j, k]) ** 0.5)
            bias = float(np.clip(np.median(found), 0.02, 0.96)) if found else 0.4
            self.accuracy.append((1 + bias) / 2)
        return self

    def log_odds(self, into: str = "votes") -> Column:
        out = F.lit(float(np.log(self.balance / (1 - self.balance))))
        for j, a in enumerate(self.accuracy):
            w = float(np.log(a / (1 - a)))
            out = out + F.when(F.col(into)[j] == 1, w).when(F.col(into)[j] == 0, -w).otherwise(0.0)
        return out

    def probability(self, into: str = "votes") -> Column:
        """P(label = 1)."""
        return 1 / (1 + F.exp(-self.log_odds(into)))

    def predict(self, into: str = "votes") -> Column:
        """The likelier label; -1 where both are equally likely."""
        z = F.round(self.log_odds(into), 9)
        return F.when(z > 0, 1).when(z < 0, 0).otherwise(ABSTAIN)


def em_accuracies(df: DataFrame, n: int, into: str = "votes", rounds: int = 50) -> list[float]:
    """Accuracies by expectation-maximisation over counted vote patterns, at most 3 ** n rows."""
    patterns = [(tuple(r[0]), r[1]) for r in df.groupBy(into).count().collect()]
    a = np.full(n, 0.7)
    v = np.array([p for p, _ in patterns]).reshape(-1, n)
    c = np.array([k for _, k in patterns], dtype=float)
    for _ in range(rounds):
        z = (np.where(v == 1, 1, np.where(v == 0, -1, 0)) * np.log(a / (1 - a))).sum(axis=1)
        p = 1 / (1 + np.exp(-z))
        right = np.where(v == 1, p[:, None], np.where(v == 0, 1 - p[:, None], 0))
        a = np.clip(((right * c[:, None]).sum(0) + 0.7) / (((v >= 0) * c[:, None]).sum(0) + 1), 0.05, 0.95)
    return a.tolist()


# --- augmentation and slices ------------------------------------------------------------------------------------------


def augment(df: DataFrame, id: str, transformations: list[Callable[[Column], Column]], text: str, n: int = 1, seed: int = 0, keep: bool = True, share: float = 1.0) -> DataFrame:
    """Each row n times with a transformation drawn by hash (or none, with probability 1 - share); the originals too, if kept.

    Copies that a transformation leaves as they were are dropped.  Column ``copy`` is 0 for originals.
    """
    key = F.concat_ws("|", F.lit(str(seed)), F.col(id).cast("string"), F.col("copy").cast("string"))
    draw = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % 1_000_000
    made = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))
    new = F.col(text)
    k = len(transformations)
    for j, f in enumerate(transformations):
        new = F.when((draw < F.lit(int(share * 1_000_000))) & (draw % k == j), f(F.col(text))).otherwise(new)
    made = made.withColumn("new_text", new).where(F.col("new_text") != F.col(text)).withColumn(text, F.col("new_text")).drop("new_text")
    return df.withColumn("copy", F.lit(0)).unionByName(made) if keep else made


def augment_each(df: DataFrame, id: str, transformations: list[Callable[[Column], Column]], text: str, p: list[float], n: int = 1, seed: int = 0, keep: bool = True) -> DataFrame:
    """Each row n times, every transformation applied in turn with its own probability, drawn by hash; the originals too,
    if kept.  Copies that stay as they were are dropped.  Column ``copy`` is 0 for originals.
    """
    made = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))
    new = F.col(text)
    for j, (f, share) in enumerate(zip(transformations, p, strict=True)):
        key = F.concat_ws("|", F.lit(str(seed)), F.col(id).cast("string"), F.col("copy").cast("string"), F.lit(str(j)))
        made = made.withColumn("new_text", F.when(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % 1_000_000 < F.lit(int(share * 1_000_000)), f(new)).otherwise(new))
        new = F.col("new_text")
    made = made.where(new != F.col(text)).withColumn(text, new).drop("new_text")
    return df.withColumn("copy", F.lit(0)).unionByName(made) if keep else made


def preprocessed(df: DataFrame, *steps: Callable[[DataFrame], dict[str, Column]]) -> DataFrame:
    """``df`` with the columns that preprocessors make, each seeing those of the ones before; made once for all functions."""
    for step in steps:
        df = df.withColumns(step(df))
    return df


def lexicon_score(text: Column, weights: dict[str, float]) -> Column:
    """Mean weight of a text's words that the lexicon knows, 0 without any; words are runs of letters, in lower case."""
    known = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\P{L}+")
    found = F.filter(F.transform(words, lambda w: F.try_element_at(known, w)), lambda x: x.isNotNull())
    return F.coalesce(F.try_divide(F.aggregate(found, F.lit(0.0), lambda s, x: s + x), F.size(found)), F.lit(0.0))


def threshold_lf(name: str, score: str, low: float | None, high: float | None, below: int = 0, above: int = 1) -> LabelingFunction:
    """Votes ``above`` where a score exceeds ``high``, ``below`` where it is under ``low``; else abstains."""
    def vote() -> Column:
        out = F.lit(ABSTAIN)
        if low is not None:
            out = F.when(F.col(score) < low, below).otherwise(out)
        return F.when(F.col(score) > high, above).otherwise(out) if high is not None else out

    return LabelingFunction(name, vote)


def ratio_lf(kind: str, a: str, b: str, apart: float, together: float, non_zero: bool = False) -> LabelingFunction:
    """Of two sets, what they share as a part of the first (``recall``), the second (``precision``) or the smaller one
    (``common``): -1 below ``apart``, 1 from ``together``, 0 between; 0 too where the part isn't defined or, if ``non_zero``,
    where nothing is shared.
    """
    def vote() -> Column:
        both = F.size(F.array_intersect(a, b))
        of = {"recall": F.size(a), "precision": F.size(b), "common": F.least(F.size(a), F.size(b))}[kind]
        part = F.try_divide(both, of)
        out = F.when(part >= together, 1).when(part < apart, -1).otherwise(0)
        return F.when(both == 0, 0).otherwise(out) if non_zero else F.when(part.isNull(), 0).otherwise(out)

    return LabelingFunction(f"{kind}{'_non_zero' if non_zero else ''}", vote)


def majority_or_drawn(key: Column, into: str = "votes", seed: int = 0) -> Column:
    """Majority of two classes, ties decided by a hash of the key; abstains where nobody voted."""
    zero, one = F.size(F.filter(into, lambda x: x == 0)), F.size(F.filter(into, lambda x: x == 1))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long") % 2
    return F.when(zero > one, 0).when(one > zero, 1).when(zero + one == 0, ABSTAIN).otherwise(drawn.cast("int"))


def slice_matrix(df: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """``df`` with a boolean column for each slice; null conditions count as false."""
    return df.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in slices.items()})


def soft_label_rows(df: DataFrame, probability: str, label: str = "label", weight: str = "weight") -> DataFrame:
    """Two rows for each one, labelled 1 and 0 and weighted by the probability of that label; rows of weight 0 go."""
    both = F.array(F.struct(F.lit(1).alias("y"), F.col(probability).alias("w")), F.struct(F.lit(0).alias("y"), (1 - F.col(probability)).alias("w")))
    out = df.withColumn("soft", F.explode(both)).withColumns({label: F.col("soft.y"), weight: F.col("soft.w")}).drop("soft")
    return out.where(F.col(weight) > 0)


def slice_metrics(df: DataFrame, slices: dict[str, Column], truth: str, predicted: str) -> DataFrame:
    """(slice, n, accuracy, f1) for each slicing condition, all in one aggregation."""
    rows = df.select(truth, predicted, F.explode(F.array(*[F.when(c, F.lit(n)) for n, c in slices.items()])).alias("slice")).where("slice IS NOT NULL")
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    return rows.groupBy("slice").agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(predicted)).cast("int")).alias("accuracy"), F.try_divide(2 * F.count_if(t & p), F.count_if(t) + F.count_if(p)).alias("f1"))
