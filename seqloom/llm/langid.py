"""Language identification by a convolutional network over bytes.

The text's bytes are cut into windows of ``WINDOW``; filters of two, three and four bytes slide over each window, the
largest response of each filter in a window goes through a rectifier into a softmax over the languages, and a document's
log probabilities are the mean of its windows', weighted by their bytes.  Every byte of a text is looked at.

Filters work on one-hot bytes, so a response is a sum of table entries, one for each byte of the stretch; for speed, pairs
of neighbouring bytes are looked up together.

The network is trained in numpy on the driver, on windows of a sample of labelled texts of expected size ``TRAIN_DOCS``
for each language.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is every text if there is nothing to learn
from; equal doc_ids are predicted row by row; rows with a null language teach nothing; an empty table gives an empty
result; a very long text's windows are all looked at; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import table
from .toxicity import held_out

#: Expected number of texts of a language to learn from.
TRAIN_DOCS = 1_000
#: Windows of a text taken for training, spread over all of it.
TRAIN_WINDOWS = 4
WINDOW = 512
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Windows whose responses are held at once.
AT_ONCE = 64
ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class Net:
    langs: list[str]
    tables: list[list[np.ndarray]]  # for each width, for each place in the stretch: 256 x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "ignore"))


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes in windows of equal length; each window's text and number of bytes.

    A text ends in at least three zero bytes, so that no stretch reaches into the next.
    """
    n = np.array([len(t) for t in texts], dtype=np.int64)
    windows = (n + 3 + WINDOW - 1) // WINDOW
    flat = np.zeros(int(windows.sum()) * WINDOW + 4, dtype=np.uint8)
    start = np.concatenate([[0], np.cumsum(windows)]) * WINDOW
    for t, at in zip(texts, start):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
    owner = np.repeat(np.arange(len(texts)), windows)
    place = np.arange(len(owner)) - np.repeat(start[:-1] // WINDOW, windows)
    return flat, owner, np.clip(n[owner] - place * WINDOW, 0, WINDOW)


class Responses:
    """The largest response of each filter in each window, by tables of pairs of bytes."""

    def __init__(self, net: Net):
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        t = net.tables
        self.two, self.three, self.four, self.more = pair(*t[0]), pair(*t[1][:2]), pair(*t[2][:2]), pair(*t[2][2:])
        self.third, self.net = t[1][2], net

    def __call__(self, flat: np.ndarray, windows: int) -> np.ndarray:
        out = np.empty((windows, len(WIDTHS) * FILTERS), dtype=np.float32)
        for a in range(0, windows, AT_ONCE):
            b = min(windows, a + AT_ONCE)
            n = (b - a) * WINDOW
            x = flat[a * WINDOW : a * WINDOW + n + 3].astype(np.int64)
            first, live = x[:n] * 256, x[:n] != 0  # a stretch that begins in the zeros between texts ends in them
            head, third = first + x[1 : n + 1] * live, x[2 : n + 2] * live
            for k, r in enumerate((self.two[head], self.three[head] + self.third[third], self.four[head] + self.more[third * 256 + x[3 : n + 3] * live])):
                out[a:b, k * FILTERS : (k + 1) * FILTERS] = _window_max(r.reshape(b - a, WINDOW, FILTERS))
        return out


def _window_max(r: np.ndarray) -> np.ndarray:
    """Largest over the middle axis, halving it while it is even."""
    while r.shape[1] % 2 == 0:
        half = r.shape[1] // 2
        r = np.maximum(r[:, :half], r[:, half:])
    return r.max(axis=1)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def predict(net: Net, responses: Responses, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language, probability) of each text."""
    flat, owner, size = _laid_out(texts)
    hidden = np.maximum(0, responses(flat, len(owner)) + net.bias)
    logs = _log_softmax(hidden @ net.out + net.out_bias)
    total = np.zeros((len(texts), len(net.langs)))
    np.add.at(total, owner, logs * size[:, None])
    mean = _log_softmax(total / np.maximum(1, np.array([len(t) for t in texts]))[:, None])
    best = mean.argmax(axis=1)
    return best, np.exp(mean[np.arange(len(texts)), best])


def train(rows: list[tuple[bytes, str]], epochs: int = 6, batch: int = 64, rate: float = 0.05, seed: int = 8) -> Net | None:
    """A network of (text, language) rows, by AdaGrad; the gradient of a filter reaches the stretch of its largest response."""
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in rows})
    flat, owner, size = _laid_out([t for t, _ in rows])
    # spread over each text: the first window and then every so many-th
    count = np.bincount(owner, minlength=len(rows))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    step = np.maximum(1, count // TRAIN_WINDOWS)[owner]
    taken = np.flatnonzero((place % step == 0) & (size > 0))
    x = np.stack([flat[i * WINDOW : (i + 1) * WINDOW] for i in taken]).astype(np.int64) if len(taken) else np.zeros((0, WINDOW), np.int64)
    y = np.array([langs.index(rows[o][1]) for o in owner[taken]], dtype=np.int64)
    init = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    net = Net(langs, [[init(256, FILTERS) for _ in range(w)] for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, np.float32), init(len(WIDTHS) * FILTERS, len(langs)), np.zeros(len(langs), np.float32))
    flats = [*(t for ts in net.tables for t in ts), net.bias, net.out, net.out_bias]
    seen = [np.full_like(p, 1e-6) for p in flats]
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            if not len(at):
                continue
            xb, n = x[at], len(at)
            peaks, responses = [], []
            for w, ts in zip(WIDTHS, net.tables):
                r = sum(t[xb[:, o : WINDOW - w + 1 + o]] for o, t in enumerate(ts))
                peaks.append(r.argmax(axis=1))
                responses.append(np.take_along_axis(r, peaks[-1][:, None, :], axis=1)[:, 0])
            pre = np.concatenate(responses, axis=1) + net.bias
            hidden = np.maximum(0, pre)
            error = np.exp(_log_softmax(hidden @ net.out + net.out_bias))
            error[np.arange(n), y[at]] -= 1
            error /= n
            back = (error @ net.out.T) * (pre > 0)
            grads = []
            for k, (w, ts) in enumerate(zip(WIDTHS, net.tables)):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                for o in range(w):
                    g = np.zeros((256, FILTERS), np.float32)
                    np.add.at(g, (xb[np.arange(n)[:, None], peaks[k] + o], np.arange(FILTERS)[None, :]), part)
                    grads.append(g)
            for p, s, g in zip(flats, seen, [*grads, back.sum(0), hidden.T @ error, error.sum(0)]):
                s += g * g
                p -= rate * g / np.sqrt(s)
    return net


def sample(docs: DataFrame, learn: Column, most: int = TRAIN_DOCS) -> list[tuple[bytes, str]]:
    """(text, language) rows for learning: of the rows that ``learn`` holds for, about ``most`` of each language, by hash."""
    given = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    share = F.lit(0)
    for lang, n in given.groupBy("lang").count().collect():
        share = F.when(F.col("lang") == lang, F.lit(round(1_000_000 * min(1.0, most / n)))).otherwise(share)
    rows = given.where(F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1_000_000)) < share).collect()
    return [(r["text"].encode(), r["lang"]) for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"]))]


_responses: dict[bytes, Responses] = {}


def identify(docs: DataFrame, net: Net | None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    kind = docs.schema[id].dataType.simpleString()
    if net is None:
        return docs.select(F.col(id).alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = sent.value
        key = net.out.tobytes()
        if key not in _responses:
            _responses.clear()
            _responses[key] = Responses(net)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = [t or b"" for t in some.column(1).cast(pa.binary()).to_pylist()]
                best, p = predict(net, _responses[key], texts)
                known = [has_letter(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([net.langs[b] if k else "und" for b, k in zip(best, known)], pa.string()), pa.array([float(q) if k else 0.0 for q, k in zip(p, known)], pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )

    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op8_langid(spark, sf_dir: str) -> DataFrame:
    """Nulls, empty and very long texts, repeated rows and an empty table: as the module states."""
    docs = table(spark, sf_dir, "documents")
    net = train(sample(docs, ~held_out(4, 2)))
    return identify(docs, net).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
