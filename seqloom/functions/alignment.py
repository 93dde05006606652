"""Sequence metrics.

The first part holds Columns: dynamic programmes as folds over arrays, for short sequences.  The second part holds the
same and further metrics in numpy, a row of the table at a time: the dependence inside a row, x[j] = min(y[j], x[j-1] +
step[j]), is a running minimum of y minus the running sum of the steps.  ``metric`` makes an Arrow-batched function of a
numpy metric, for long sequences.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


# --- Columns ----------------------------------------------------------------------------------------------------------


def dtw(a: Column, b: Column, cost=lambda x, y: F.abs(x - y)) -> Column:
    """Dynamic time warping; NULL if a sequence is empty."""
    first = F.concat(F.array(F.lit(0.0)), F.array_repeat(F.lit(INF), F.size(b)))

    def row(previous: Column, x: Column) -> Column:
        cell = lambda made, j: F.concat(made, F.array(cost(x, b[j - 1]).cast("double") + F.least(previous[j], previous[j - 1], made[j - 1])))
        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.lit(INF)), cell)

    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.element_at(F.aggregate(a, first, row), -1))


def hamming(x: Column, y: Column) -> Column:
    """0 for equal events, else 1."""
    return F.when(x == y, 0.0).otherwise(1.0)


def looked_up(costs: list[list[float]]):
    """The cost of two events that are codes from 0, from a matrix; NULL for codes beyond it."""
    rows = F.array(*[F.array(*[F.lit(float(c)) for c in row]) for row in costs])
    return lambda x, y: F.get(F.get(rows, x.cast("int")), y.cast("int"))


def in_time(tc: float, cost=lambda x, y: F.abs(x - y)):
    """The cost of two (t, v) points, infinite where their squared time difference exceeds ``tc``."""
    return lambda x, y: F.when((x["t"] - y["t"]) * (x["t"] - y["t"]) > tc, F.lit(INF)).otherwise(cost(x["v"], y["v"]))


def levenshtein(a: Column, b: Column, substitution=hamming, insert: float = 1.0, delete: float = 1.0, substitute: float | None = None) -> Column:
    """Edit distance with any cost of substitution, or one cost where the substitution isn't free; what precedes the first
    element of either sequence costs 1 an element, whatever insertions and deletions cost.
    """
    swap = substitution if substitute is None else lambda x, y: F.when(substitution(x, y) == 0, 0.0).otherwise(float(substitute))
    first = F.transform(F.sequence(F.lit(0), F.size(b)), lambda j: j.cast("double"))

    def row(previous: Column, x: Column) -> Column:
        cell = lambda made, j: F.concat(made, F.array(F.least(previous[j] + delete, made[j - 1] + insert, previous[j - 1] + swap(x, b[j - 1]).cast("double"))))
        return F.when(F.size(b) == 0, F.array(previous[0] + 1)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))), F.array(previous[0] + 1), cell))

    return F.element_at(F.aggregate(a, first, row), -1)


def lcss_length(a: Column, b: Column, same=lambda x, y: x == y) -> Column:
    """Length of the longest common subsequence of elements that are ``same``."""
    first = F.array_repeat(F.lit(0), F.size(b) + 1)

    def row(previous: Column, x: Column) -> Column:
        cell = lambda made, j: F.concat(made, F.array(F.when(same(x, b[j - 1]), previous[j - 1] + 1).otherwise(F.greatest(previous[j], made[j - 1]))))
        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.lit(0)), cell)

    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.element_at(F.aggregate(a, first, row), -1))


def lcss_distance(a: Column, b: Column, same=lambda x, y: x == y) -> Column:
    return 1 - F.try_divide(lcss_length(a, b, same), F.least(F.size(a), F.size(b)))


def within(epsilon: float, delta: float | None = None):
    """Whether two (t, e) points are the same: events at most epsilon apart, times less than delta."""
    return lambda x, y: (F.abs(x["e"] - y["e"]) <= epsilon) & (F.lit(True) if delta is None else F.abs(x["t"] - y["t"]) < delta)


def euclidean(a: Column, b: Column, cost=lambda x, y: F.abs(x - y)) -> Column:
    """Root of the summed squared costs over the length of the shorter sequence."""
    n = F.least(F.size(a), F.size(b))
    return F.sqrt(F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.pow(cost(x, y).cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def set_metric(a: Column, b: Column, how: str = "sum", base=lambda x, y: F.abs(x - y)) -> Column:
    """Base costs of all pairs of events of two sets: their sum, mean or minimum."""
    costs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: base(x, y).cast("double"))))
    total = F.aggregate(costs, F.lit(0.0), lambda s, x: s + x)
    return {"sum": total, "mean": F.try_divide(total, F.size(costs)), "min": F.array_min(costs)}[how]


# --- numpy ------------------------------------------------------------------------------------------------------------


def _chain(start: float, own: np.ndarray, step: np.ndarray) -> np.ndarray:
    """x with x[-1] = start and x[j] = min(own[j], x[j-1] + step[j])."""
    if not np.isfinite(step).all():
        out, x = np.empty(len(own)), start
        for j in range(len(own)):
            out[j] = x = min(own[j], x + step[j])
        return out
    run = np.cumsum(step)
    return run + np.minimum(np.minimum.accumulate(own - run), start)


def _band(n: int, m: int, i: int, radius: int | None) -> tuple[int, int]:
    """Columns (from 0) of row i (from 0) within the Sakoe-Chiba band; all if there is none."""
    if radius is None:
        return 0, m
    r = max(radius, abs(n - m))
    return max(0, i - r), min(m, i + r + 1)


def np_dtw(a: np.ndarray, b: np.ndarray, radius: int | None = None, tc: float | None = None, ta: np.ndarray | None = None, tb: np.ndarray | None = None) -> float:
    """DTW with |a - b| cost, optionally in a band or with squared time differences of at most ``tc``."""
    previous = np.full(len(b) + 1, INF)
    previous[0] = 0
    for i, x in enumerate(a):
        c = np.abs(b - x).astype(float)
        lo, hi = _band(len(a), len(b), i, radius)
        c[:lo], c[hi:] = INF, INF
        if tc is not None:
            c[(tb - ta[i]) ** 2 > tc] = INF
        row = _chain(INF, c + np.minimum(previous[1:], previous[:-1]), c)
        previous = np.concatenate([[INF], row])
    return float(previous[-1])


def np_levenshtein(a: np.ndarray, b: np.ndarray, insert: float = 1.0, delete: float = 1.0, substitute: float = 1.0) -> float:
    """Edit distance; what precedes the first element of either sequence costs 1 an element."""
    previous = np.arange(len(b) + 1, dtype=float)
    for i, x in enumerate(a):
        row = _chain(i + 1.0, np.minimum(previous[1:] + delete, previous[:-1] + substitute * (b != x)), np.full(len(b), insert))
        previous = np.concatenate([[i + 1.0], row])
    return float(previous[-1])


def np_lcss(a: np.ndarray, b: np.ndarray) -> float:
    previous = np.zeros(len(b) + 1)
    for x in a:
        previous = np.concatenate([[0.0], np.maximum.accumulate(np.where(b == x, previous[:-1] + 1, previous[1:]))])
    return float(previous[-1])


def event_costs(ea: np.ndarray, eb: np.ndarray, ta: np.ndarray, tb: np.ndarray, time_weight: float = 1.0, event_weight: float = 1.0) -> np.ndarray:
    """|time_weight dt^2 + event_weight d|: for codes d is 2 where they differ (squared one-hot difference)."""
    if ea.ndim == 1:
        events = 2.0 * (ea[:, None] != eb[None, :])
    else:
        events = ((ea[:, None, :] - eb[None, :, :]) ** 2).sum(axis=2)
    return np.abs(time_weight * (ta[:, None] - tb[None, :]) ** 2.0 + event_weight * events)


def drop_dtw_one_sided(cost: np.ndarray, drop: float | None = None) -> float:
    """Drop-DTW in which elements of the second sequence may be left out, each for the drop cost (None: not at all)."""
    n, m = cost.shape
    d = INF if drop is None else float(drop)
    best = np.concatenate([[0.0], np.full(m, INF) if drop is None else d * np.arange(1, m + 1)])
    kept = np.full(m, INF)  # the row above, with its element matched
    for i in range(n):
        own = np.minimum(best[:-1], kept)
        row = _chain(INF, cost[i] + own, np.minimum(cost[i], d))
        kept = cost[i] + np.minimum(own, np.concatenate([[INF], row[:-1]]))
        best = np.concatenate([[INF], row])
    return float(best[-1])


def drop_dtw_two_sided(cost: np.ndarray, drop: float) -> tuple[float, list[tuple[int, int]]]:
    """Drop-DTW in which elements of either sequence may be left out; the value and the matched pairs.

    Four tables: both last elements matched, only the first's, only the second's, neither.
    """
    n, m = cost.shape
    t = np.full((4, n + 1, m + 1), INF)
    t[:, 0, 0] = 0
    t[1, 0, 1:] = t[3, 0, 1:] = drop * np.arange(1, m + 1)
    t[2, 1:, 0] = t[3, 1:, 0] = drop * np.arange(1, n + 1)
    for i in range(1, n + 1):
        above = t[:, i - 1]
        t[0, i, 1:] = cost[i - 1] + above[:, :-1].min(axis=0)
        t[2, i, 1:] = drop + np.minimum(above[0, 1:], above[2, 1:])
        t[1, i, 1:] = _chain(t[1, i, 0], drop + t[0, i, :-1], np.full(m, drop))
        t[3, i, 1:] = _chain(t[3, i, 0], drop + np.minimum(np.minimum(t[2, i, :-1], above[1, 1:]), above[3, 1:]), np.full(m, drop))
    i, j, path = n, m, []
    while i and j:
        k = int(t[:, i, j].argmin())
        if k == 0:
            path.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif k == 1:
            j -= 1
        elif k == 2:
            i -= 1
        else:
            left = min(t[2, i, j - 1], t[3, i, j - 1])
            i, j = (i, j - 1) if left <= min(t[1, i - 1, j], t[3, i - 1, j]) else (i - 1, j)
    return float(t[:, n, m].min()), path[::-1]


def hats_costs(va: np.ndarray, vb: np.ndarray, ta: np.ndarray, tb: np.ndarray, event_weight: float = 1.0, time_weight: float = 1.0) -> np.ndarray:
    """event_weight * |va - vb| + time_weight * (tb - ta)^2, for scalars or vectors."""
    events = np.abs(va[:, None] - vb[None, :]) if va.ndim == 1 else np.linalg.norm(va[:, None, :] - vb[None, :, :], axis=2)
    return event_weight * events + time_weight * (tb[None, :] - ta[:, None]) ** 2.0


def drop_dtw_hats(va, vb, ta, tb, event_weight: float = 1.0, time_weight: float = 1.0, percentile: float = 50.0) -> float:
    """Two-sided Drop-DTW on vectors with times; the drop cost is a percentile of the costs."""
    cost = hats_costs(va, vb, ta, tb, event_weight, time_weight)
    return drop_dtw_two_sided(cost, float(np.percentile(cost, percentile)))[0]


def twed(a: np.ndarray, b: np.ndarray, ta: np.ndarray, tb: np.ndarray, nu: float = 0.001, penalty: float = 1.0) -> float:
    """Time warp edit distance; both sequences start with a zero at time zero.  NaN if nu is negative or lengths differ."""
    if nu < 0 or len(a) != len(ta) or len(b) != len(tb):
        return float("nan")
    a, b, ta, tb = (np.concatenate([[0.0], np.asarray(x, dtype=float)]) for x in (a, b, ta, tb))
    drop_a = np.abs(np.diff(a)) + nu * np.diff(ta) + penalty
    drop_b = np.abs(np.diff(b)) + nu * np.diff(tb) + penalty
    previous = np.full(len(b), INF)
    previous[0] = 0
    for i in range(1, len(a)):
        keep = previous[:-1] + np.abs(b[1:] - a[i]) + np.abs(b[:-1] - a[i - 1]) + nu * (np.abs(tb[1:] - ta[i]) + np.abs(tb[:-1] - ta[i - 1]))
        previous = np.concatenate([[INF], _chain(INF, np.minimum(previous[1:] + drop_a[i - 1], keep), drop_b)])
    return float(previous[-1])


def breakpoints(t: np.ndarray, v: np.ndarray, epsilon: float = 1.35) -> int:
    """Number of points that Ramer-Douglas-Peucker simplification keeps."""
    kept, todo = {0, len(v) - 1} if len(v) else set(), [(0, len(v) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dt, dv = float(t[b] - t[a]), float(v[b] - v[a])
        length = np.hypot(dt, dv)
        rt, rv = t[a + 1 : b] - t[a], v[a + 1 : b] - v[a]
        gap = np.abs(dt * rv - dv * rt) / length if length else np.hypot(rt, rv)
        k = int(gap.argmax())
        if gap[k] > epsilon:
            kept.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return len(kept)


def metric(f, kind: str = "double"):
    """An Arrow-batched function of array columns from a function of numpy arrays; NULL if an argument is."""

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else f(*(np.asarray(x, dtype=float) for x in row)) for row in zip(*columns)])

    return run


# --- all pairs of sorted values -----------------------------------------------------------------------------------------


def _foretold_one(x: np.ndarray, y: np.ndarray) -> tuple[float | None, float | None]:
    """r2 and angle of one pair, from differences to the means; None where y, or x, has only one value."""
    n = min(len(x), len(y))
    x, y = x[:n], y[:n]
    total = lambda v: float(np.cumsum(v)[-1])
    p, q = x - total(x) / n, y - total(y) / n
    tot, sxx = total(q * q), total(p * p)
    r2 = 1 - total((y - x) ** 2) / tot if (y != y[0]).any() and tot else None
    return r2, float(np.degrees(np.arctan(abs(total(p * q) / sxx)))) if (x != x[0]).any() and sxx else None


def foretold(rows, digits: int = 6):
    """For ``pairs.measured``: how well a's values (id, v) foretell b's, up to the shorter one's end, and the trend's angle.

    Sums of products of all pairs are a product of two matrices filled up with zeros, the other sums running ones.  Pairs
    whose sums could decide a rounding otherwise are computed by themselves.
    """
    from seqloom.operators.pairs import half_up

    lists = rows["v"].to_pylist()
    size = np.array([len(v) for v in lists])
    values = [np.array(v, dtype=float) for v in lists]
    middle = np.concatenate(values).mean() if size.sum() else 0.0
    m = np.zeros((len(values), int(size.max(initial=0))))
    for row, v in zip(m, values):
        row[: len(v)] = v - middle
    upto, squares = np.cumsum(m, axis=1), np.cumsum(m * m, axis=1)

    def measure(a, b):
        n = np.minimum(size[a][:, None], size[b])
        sx, sxx, sy, syy = upto[a[:, None], n - 1], squares[a[:, None], n - 1], upto[b, n - 1], squares[b, n - 1]
        sxy, both = m[a] @ m[b].T, sxx + syy
        with np.errstate(divide="ignore", invalid="ignore"):
            tot, wide = syy - sy * sy / n, sxx - sx * sx / n
            slope = (sxy - sx * sy / n) / wide
            found = [1 - (both - 2 * sxy) / tot, np.degrees(np.arctan(np.abs(slope)))]
            error = [1e-13 * both / tot * (1 + np.abs(found[0])), 6e-12 * both / wide * (1 + np.abs(slope)) / (1 + slope * slope)]
            scaled = [np.abs(f) * 10.0**digits for f in found]
            unsure = np.logical_or.reduce([~(np.abs(s - np.floor(s) - 0.5) > 10.0**digits * e) | (e < 0) for s, e in zip(scaled, error)] + [tot <= 1e-9 * syy, wide <= 1e-9 * sxx])
        null = [np.zeros(n.shape, dtype=bool) for _ in found]
        for i, j in zip(*np.nonzero(unsure)):
            for f, o, v in zip(found, null, _foretold_one(values[a[i]], values[b[j]])):
                f[i, j], o[i, j] = (0.0, True) if v is None else (v, False)
        return [(half_up(f, digits), o) for f, o in zip(found, null)]

    return measure
