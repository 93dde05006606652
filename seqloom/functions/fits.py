"""Bounded least squares fits of decline curves to many sequences at once.

Damped Gauss-Newton steps, projected onto the bounds; every sequence of a batch has its own damping and keeps its own best
parameters, so the work is a fixed number of small array operations whatever the number of sequences.
"""

from __future__ import annotations

import numpy as np


def padded(ts, vs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times, values and a mask of equal length from lists of sequences."""
    n = max((len(t) for t in ts), default=1)
    t, v, mask = (np.zeros((len(ts), n)) for _ in range(3))
    for i, (a, b) in enumerate(zip(ts, vs)):
        t[i, : len(a)], v[i, : len(a)], mask[i, : len(a)] = a, b, 1
    return t, v, mask


def least_squares(model, p0, low, high, t, v, mask, rounds: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """(parameters, residual sums of squares) of each sequence; infinite where no finite fit is found.

    ``model(t, p)`` returns values and their derivatives by the parameters, p being parameters by sequence.
    """
    low, high = (np.broadcast_to(x, p0.shape) for x in (low, high))
    p = np.clip(p0, low, high)

    def at(p):
        f, j = model(t, p)
        r = (v - f) * mask
        return r, j * mask[..., None], np.where(np.isfinite(f).all(axis=1), (r * r).sum(axis=1), np.inf)

    with np.errstate(all="ignore"):
        r, j, best = at(p)
        damping = np.full(len(p), 1e-3)
        eye = np.eye(p.shape[1])
        for _ in range(rounds):
            g = np.nan_to_num(np.einsum("nlp,nl->np", j, r))
            h = np.nan_to_num(np.einsum("nlp,nlq->npq", j, j))
            # parameters at a bound that the step would leave stay there
            free = ~(((p <= low) & (g < 0)) | ((p >= high) & (g > 0)))
            g = g * free
            h = h * free[:, :, None] * free[:, None, :]
            diagonal = np.maximum(np.einsum("npp->np", h), 1e-12)
            h = h + eye * np.where(free, damping[:, None] * diagonal + 1e-14, 1.0)[:, None, :]
            step = np.nan_to_num(np.linalg.solve(h, g[..., None])[..., 0], posinf=0, neginf=0)
            q = np.clip(p + step, low, high)
            r2, j2, value = at(q)
            better = value < best
            done = not (better & (best - value > 1e-10 * best)).any() and (damping > 1e8).all()
            damping = np.clip(np.where(better, damping / 5, damping * 4), 1e-12, 1e12)
            p, r, j, best = np.where(better[:, None], q, p), np.where(better[:, None], r2, r), np.where(better[:, None, None], j2, j), np.where(better, value, best)
            if done:
                break
    return p, best


def _exp(x):
    return np.exp(np.clip(x, -700, 700))


def sigmoid(t, p):
    b, k, a, c = (p[:, i : i + 1] for i in range(4))
    e = _exp(k * (t - a))
    s = 1 / (1 + e)
    d = -b * s * s * e
    return b * s + c, np.stack([s, d * (t - a), -d * k, np.ones_like(s)], axis=2)


def logistic(t, p):
    top, t0, s = (p[:, i : i + 1] for i in range(3))
    e = _exp((t - t0) / s)
    f = 1 / (1 + e)
    d = top * f * f * e
    return top * f, np.stack([f, d / s, d * (t - t0) / (s * s)], axis=2)


def weibull(t, p):
    top, scale, shape = (p[:, i : i + 1] for i in range(3))
    x = np.maximum(t, 0) / scale
    w = np.power(x, shape)
    e = _exp(-w)
    return top * e, np.stack([e, top * e * w * shape / scale, -top * e * w * np.log(np.maximum(x, 1e-300))], axis=2)


def fit_sigmoid(t, v, mask, top: float = 48.0):
    """b / (1 + exp(k (t - a))) + c with b in [38, 48], k in [0, 10], a in [0, last t], c in [-10, 10]; best of several starts."""
    last = np.maximum((t * (mask > 0)).max(axis=1), 1e-9)
    zero = np.zeros_like(last)
    low = np.array([38.0, 0.0, 0.0, -10.0])
    high = np.stack([zero + 48, zero + 10, last, zero + 10], axis=1)
    found = [least_squares(sigmoid, np.stack(x, axis=1), low, high, t, v, mask) for x in ((zero + top, zero + 1e-5, zero, zero), (zero + top, 4 / last, last / 2, zero), (zero + top, 10 / last, last, zero))]
    pick = np.argmin([f[1] for f in found], axis=0)
    rows = np.arange(len(pick))
    return np.array([f[0] for f in found])[pick, rows], np.array([f[1] for f in found])[pick, rows]


def _middle(t, mask):
    return np.nanmedian(np.where(mask > 0, t, np.nan), axis=1)


def fit_logistic(t, v, mask):
    """top / (1 + exp((t - t0) / s)), unbounded but for s > 0; an infinite residual sum on failure."""
    top = (v * mask).max(axis=1)
    return least_squares(logistic, np.stack([top, _middle(t, mask), np.full(len(t), 100.0)], axis=1), np.array([0, -np.inf, 1e-6]), np.inf, t, v, mask)


def fit_weibull(t, v, mask):
    """top * exp(-(t / scale) ** shape); an infinite residual sum on failure."""
    top = (v * mask).max(axis=1)
    return least_squares(weibull, np.stack([top, np.maximum(_middle(t, mask), 1), np.full(len(t), 1.5)], axis=1), np.array([0, 1e-6, 1e-3]), np.array([np.inf, np.inf, 50]), t, v, mask)


def d50(t, v, mask, p, half: float = 24.0) -> np.ndarray:
    """Years until the score is half: 0 if it starts below, the time of a point that hits it, else by the fitted sigmoid p."""
    b, k, a, c = p.T
    with np.errstate(all="ignore"):
        by_curve = np.where((k > 0) & (half - c > 0) & (half - c < b), np.log(b / (half - c) - 1) / k + a, np.nan)
    hit = (v == half) & (mask > 0)
    at = np.take_along_axis(t, hit.argmax(axis=1)[:, None], axis=1)[:, 0]
    return np.where(v[:, 0] < half, 0.0, np.where(hit.any(axis=1), at, by_curve) / 365.25)


def band(t, v, mask, p, sse, points=None) -> np.ndarray:
    """Standard errors of the sigmoid's parameters of each sequence, from the curvature at the fit.

    ``points`` is the number of points fitted, if the mask holds weights (roots of counts).
    """
    _, j = sigmoid(t, p)
    j = j * mask[..., None]
    h = np.einsum("nlp,nlq->npq", j, j) + np.eye(p.shape[1]) * 1e-9
    freedom = np.maximum((mask.sum(axis=1) if points is None else points) - p.shape[1], 1)
    return np.sqrt(np.maximum(np.einsum("npp->np", np.linalg.inv(h)), 0) * (sse / freedom)[:, None])
