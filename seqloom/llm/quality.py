"""Quality rules by weak supervision, in DataFrame operations only.

Each rule looks at one measure of a text and votes good (1), bad (0) or abstains (-1).  Rules overlap, and each is wrong
at times.  Expectation-maximisation over the counts of vote patterns estimates the share of good documents and, for each
rule, how likely its vote is right on good and on bad documents; a document is kept if its posterior probability of being
good is at least ``KEEP``.  So a lone bad vote of a rule that often errs is overruled, and several weak ones add up.  A few
base conditions reject outright.

Cost: one pass over the texts, in which every measure is a function of the row alone (no window or word is shuffled);
the pattern counts, at most 3 ** len(RULES) rows, are the only thing that reaches the driver.

Defined cases: a null or blank text has no words, fails the base conditions and is not kept; a rule whose ratio isn't
defined abstains; a very long text is measured whole; equal rows, equal and null doc_ids are judged row by row; an empty
table gives an empty result; ``judge`` keeps any further columns untouched, and new ones whose names are taken get a ``_``.
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import GAP, bind, fresh, materialize, table, words

SYMBOLS = r"[#*$%&|<>]"
#: Posterior probability from which a document is kept.
KEEP = 0.5
MIN_WORDS = 50
#: Ratios of measures that the rules look at: (name, numerator, denominator).
RATIOS = (
    ("word_length", "word_chars", "n_words"),
    ("symbols", "n_symbols", "n_words"),
    ("marks", "n_marks", "word_chars"),
    ("dup_lines", "n_dup_lines", "n_lines"),
    ("repeats", "n_repeat_words", "n_words"),
    ("capitals", "n_capitals", "word_chars"),
    ("exclaims", "n_exclaims", "n_words"),
    ("stops", "n_stops", "n_words"),
)
#: (rule, its ratio, bad below, good from, good up to, bad above); between them a rule abstains.
RULES = (
    ("word_length", "word_length", 3.0, 4.0, 7.0, 9.0),
    ("symbols", "symbols", None, 0.0, 0.02, 0.1),
    ("marks", "marks", None, 0.0, 0.08, 0.16),
    ("dup_lines", "dup_lines", None, 0.0, 0.1, 0.3),
    ("repeats", "repeats", None, 0.0, 0.05, 0.2),
    ("capitals", "capitals", 0.001, 0.005, 0.15, 0.4),
    ("exclaims", "exclaims", None, 0.0, 0.05, 0.2),
    ("stops", "stops", 0.005, 0.02, 0.25, 0.5),
)
#: What is believed at first: a rule's vote is good with these probabilities on good and on bad documents (a document is bad
#: in one way or another, so most rules don't mind it, but few mind a good one), and so many are good.  The belief weighs
#: as much as ``BELIEF`` of the documents seen, and as one document at least.
FIRST_RATES, FIRST_SHARE, BELIEF = (0.98, 0.7), 0.8, 0.002
#: No vote is believed to be right or wrong with a probability beyond these.
SURE = 0.999


def _covered(places: Column) -> Column:
    """How many words the 3-word windows that start at these sorted places cover."""
    n = F.size(places)
    steps = F.zip_with(F.slice(places, 1, n - 1), F.slice(places, 2, n - 1), lambda a, b: F.least(F.lit(3), b - a))
    return F.aggregate(steps, F.lit(3), lambda s, x: s + x)


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that a text has twice or more, from the array of its words."""
    windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, w[i + 1], w[i + 2]))

    def found(h: Column) -> Column:
        def again(s: Column) -> Column:
            n = F.size(s)
            pairs = F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])).otherwise(F.array().cast("array<int>")))
            return bind(F.sort_array(F.array_distinct(F.flatten(pairs))), _covered)

        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(placed, again))

    return bind(windows, found)


def measures(text: Column) -> Column:
    """Struct column of all counts of a whole text."""
    t = F.coalesce(text, F.lit(""))
    removed = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    without = lambda mark: F.length(t) - F.length(F.replace(t, F.lit(mark)))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = (
        ("word_chars", F.length(F.regexp_replace(t, GAP, ""))),
        ("n_symbols", removed(SYMBOLS)),
        ("n_marks", removed(r"[^\p{L}\p{N}\x20\x09-\x0D]+")),
        ("n_capitals", removed(r"\p{Lu}+")),
        ("n_exclaims", without("!")),
        ("n_stops", without(".")),
    )
    by_word = lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("again"))
    by_line = lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct"))
    return bind(
        F.struct(bind(words(text), by_word).alias("w"), bind(lines, by_line).alias("l")),
        lambda x: F.struct(
            x["w"]["n"].cast("long").alias("n_words"),
            x["w"]["again"].cast("long").alias("n_repeat_words"),
            x["l"]["n"].cast("long").alias("n_lines"),
            (x["l"]["n"] - x["l"]["distinct"]).cast("long").alias("n_dup_lines"),
            *[c.cast("long").alias(name) for name, c in counts],
        ),
    )


def measured(docs: DataFrame, text: str, into: str) -> DataFrame:
    """``docs`` with one more column, a struct of the measures of its ``text``."""
    return docs.withColumn(into, measures(F.col(text)))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * 50)


def votes(m: Column) -> list[Column]:
    """One vote for each rule: 1 good, 0 bad, -1 abstains."""
    ratio = {name: F.try_divide(m[a].cast("double"), m[b].cast("double")) for name, a, b in RATIOS}
    out = []
    for _, name, low, good_from, good_to, high in RULES:
        x = ratio[name]
        bad = (x > high) if low is None else (x < low) | (x > high)
        out.append(F.when(bad, 0).when(x.between(good_from, good_to), 1).otherwise(-1))
    return out


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 500) -> tuple[float, list[tuple[float, float]]]:
    """EM over counted vote patterns: the share of good documents and, for each rule, the probabilities that a vote is good
    on a good and on a bad document.

    Abstaining tells nothing.  A rule is never believed to vote good more readily on bad documents than on good ones.
    """
    k = len(patterns[0][0]) if patterns else len(RULES)
    total = sum(n for _, n in patterns)
    share, rates = FIRST_SHARE, [FIRST_RATES] * k
    own = max(1.0, BELIEF * total)
    sure = lambda p: min(SURE, max(1 - SURE, p))
    for _ in range(rounds):
        good = [1 / (1 + math.exp(-min(700, max(-700, log_odds(share, rates, p))))) for p, _ in patterns]
        again = []
        for r in range(k):
            cast = [(g, p[r], n) for g, (p, n) in zip(good, patterns) if p[r] >= 0]
            on_good = sure((sum(g * n * v for g, v, n in cast) + FIRST_RATES[0] * own) / (sum(g * n for g, _, n in cast) + own))
            on_bad = sure((sum((1 - g) * n * v for g, v, n in cast) + FIRST_RATES[1] * own) / (sum((1 - g) * n for g, _, n in cast) + own))
            if on_bad > on_good:
                on_good = on_bad = sure((sum(n * v for _, v, n in cast) + sum(FIRST_RATES) / 2 * own) / (sum(n for _, _, n in cast) + own))
            again.append((on_good, on_bad))
        new = sure((sum(g * n for g, (_, n) in zip(good, patterns)) + FIRST_SHARE * own) / (total + own))
        moved = max([abs(new - share), *(abs(a - b) for x, y in zip(rates, again) for a, b in zip(x, y))])
        share, rates = new, again
        if moved < 1e-9:
            break
    return share, rates


def weights(rates: tuple[float, float]) -> tuple[float, float]:
    """What a good and what a bad vote of a rule add to the log odds of good to bad."""
    on_good, on_bad = rates
    return math.log(on_good / on_bad), math.log((1 - on_good) / (1 - on_bad))


def log_odds(share: float, rates: list[tuple[float, float]], pattern: tuple[int, ...]) -> float:
    """Log odds of good to bad, given the votes."""
    return math.log(share / (1 - share)) + sum(weights(x)[0 if v else 1] for x, v in zip(rates, pattern) if v >= 0)


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with measures (a struct), base_failed, posterior and kept added; names that clash get a ``_``."""
    names = {n: fresh(docs, n) for n in ("measures", "base_failed", "posterior", "kept")}
    seen = measured(docs, text, names["measures"])
    seen = materialize(seen.select(*keep, names["measures"]) if keep is not None else seen, "quality")
    m = F.col(names["measures"])
    # what the base conditions reject teaches nothing about the rest
    counted = seen.where(~base_failed(m)).groupBy(F.array(*votes(m)).alias("votes")).count().collect()
    share, rates = fit(sorted((tuple(r["votes"]), r["count"]) for r in counted))
    score = F.lit(math.log(share / (1 - share)))
    for v, x in zip(votes(m), rates):
        good, bad = weights(x)
        score = score + F.when(v == 0, F.lit(bad)).when(v == 1, F.lit(good)).otherwise(F.lit(0.0))
    posterior = F.lit(1.0) / (F.lit(1.0) + F.exp(-score))
    return seen.withColumns({names["base_failed"]: base_failed(m), names["posterior"]: posterior}).withColumn(names["kept"], ~F.col(names["base_failed"]) & (F.col(names["posterior"]) >= KEEP))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, columns unchanged."""
    return judge(docs, text).where(F.col(fresh(docs, "kept"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Nulls, blank and very long texts, repeated rows and an empty table: as the module states."""
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    m = F.col("measures")
    counts = [m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, "base_failed", "kept", "posterior")
