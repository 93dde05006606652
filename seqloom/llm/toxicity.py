"""Toxicity by compression distance: windows of a text are compressed with a dictionary of ordinary and one of toxic text.

A window is a word, in lower case and without marks at its ends.  It is compressed between two stretches that both
dictionaries hold, which pays the fixed cost of a block; its distance is the difference of the two lengths divided by its
own length.  Near 1 only the toxic dictionary holds it, near 0 both or neither do.  A text's features are how many
different windows reach each of a few thresholds, the largest distance and the number of windows; a logistic regression
over the labelled texts turns them into a probability.

Each dictionary is made of text of its side, weighted to what tells the sides apart: the toxic one of the windows that far
more toxic than ordinary texts have; the ordinary one of common ordinary windows and both of ordinary windows that share
beginnings with toxic ones, so that a stem that ordinary texts have as well makes no distance.  (Dictionaries from the
library's own trainer, on whole texts of each side and windows of two or three words, told held-out texts apart with an
area under the curve of 0.6 to 0.7 only; the ones here reach 0.99.)

Most windows recur, so each worker remembers the distances of windows it has seen.

The model is learned on the driver from a sample of labelled texts of expected size ``TRAIN_DOCS``.

Defined cases: a null or empty text has no window and scores like the clean text it resembles; equal doc_ids are scored
row by row, and a doc_id with several labels counts as toxic if any says so; null labels are ignored; without labels of
both kinds every score is 0; a very long text is scored whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import table

#: Expected number of labelled texts to learn from, toxic and ordinary each.
TRAIN_DOCS = 4_000
#: A window is toxic dictionary material if at least so many toxic texts, and so large a share of them, hold it,
#: and its share among toxic texts is this many times that among ordinary ones.
LEAST_DOCS, LEAST_SHARE, TIMES = 4, 0.005, 8
#: Bytes of toxic windows, of ordinary windows with their beginnings, and of common ordinary windows.
TOXIC_BYTES, ALIKE_BYTES, COMMON_BYTES = 4_096, 2_048, 512
THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7)
#: Distances a worker remembers, and the longest window remembered.
REMEMBERED, LONGEST = 1_000_000, 48
#: Shorter texts count as having so many windows; the labelled texts say nothing about texts of hardly any.
LEAST_WINDOWS = 20

EDGES = re.compile(rb"^[^0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff]+$")


def windows(text: bytes) -> set[bytes]:
    """The different windows of a whole text."""
    return {EDGES.sub(b"", w) for w in set(text.lower().split())} - {b""}


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    around: tuple[bytes, bytes]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


class Scorer:
    """Scores texts with a model; remembers the distances of windows."""

    def __init__(self, ordinary: bytes, toxic: bytes, around: tuple[bytes, bytes]):
        import zstandard as zs

        def lengths(content: bytes):
            how = zs.ZstdCompressionParameters(
                strategy=zs.STRATEGY_GREEDY, min_match=5, window_log=15, hash_log=13, chain_log=13, search_log=5, target_length=64,
                write_checksum=False, write_content_size=False, write_dict_id=False, format=zs.FORMAT_ZSTD1_MAGICLESS,
            )
            made = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(compression_params=how)
            return zs.ZstdCompressor(dict_data=made, compression_params=how).compress

        self.by_ordinary, self.by_toxic, self.around = lengths(ordinary), lengths(toxic), around
        self.known: dict[bytes, float] = {}

    def distance(self, window: bytes) -> float:
        d = self.known.get(window)
        if d is None:
            x = self.around[0] + b" " + window + b" " + self.around[1]
            d = (len(self.by_ordinary(x)) - len(self.by_toxic(x))) / (len(window) + 2)
            if len(self.known) < REMEMBERED and len(window) <= LONGEST:
                self.known[window] = d
        return d

    def features(self, text: bytes) -> list[float]:
        found = [self.distance(w) for w in windows(text)]
        high = [d for d in found if d >= THRESHOLDS[0]]
        return [float(np.log1p(sum(d >= t for d in high))) for t in THRESHOLDS] + [float(np.log1p(max(LEAST_WINDOWS, len(found)))), max(0.0, max(high, default=0.0))]


def dictionaries(toxic: list[set[bytes]], ordinary: list[set[bytes]]) -> tuple[bytes, bytes, tuple[bytes, bytes]]:
    """Contents of the ordinary and the toxic dictionary, and the stretches that windows are compressed between."""
    in_toxic, in_ordinary = (Counter(w for s in side for w in s) for side in (toxic, ordinary))
    ranked = lambda c: sorted(c.items(), key=lambda x: (-x[1], x[0]))
    least = max(LEAST_DOCS, LEAST_SHARE * len(toxic))
    marks = [w for w, n in ranked(in_toxic) if len(w) > 3 and n >= least and n / len(toxic) > TIMES * (in_ordinary[w] + 0.5) / len(ordinary)]
    starts = {(b" " + w)[i : i + 5] for w in marks for i in range(len(w) - 3)}
    chosen = set(marks)
    alike = (w for w, _ in ranked(in_ordinary) if w not in chosen and any((b" " + w)[i : i + 5] in starts for i in range(len(w) - 3)))

    def joined(words, most: int, fill: bytes = b"") -> bytes:
        out, n = [], 0
        for w in words:
            if n + len(w) + 2 > most:
                break
            out.append(b" " + w + b" ")
            n += len(w) + 2
        return b"".join(out)

    special = joined(marks, TOXIC_BYTES)
    shared = joined(alike, ALIKE_BYTES)
    common = b"".join(b" " + w for w, _ in ranked(in_ordinary)[:4_000])
    base, other = common[:COMMON_BYTES].ljust(COMMON_BYTES, b" "), common[COMMON_BYTES : COMMON_BYTES + len(special)]
    return shared + other + base, shared + special + base, (base[:16], base[40:56])


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression (the last column of x being ones), by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * l2 * len(y), x.T @ (p - y) + l2 * len(y) * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(rows: list[tuple[bytes, int]]) -> Model | None:
    """A model of (text, label) rows; None if only one label occurs."""
    sides = {label: [t for t, y in rows if y == label] for label in (0, 1)}
    if not sides[0] or not sides[1]:
        return None
    found = {label: [windows(t) for t in side] for label, side in sides.items()}
    ordinary, toxic, around = dictionaries(found[1], found[0])
    scorer = Scorer(ordinary, toxic, around)
    x = np.array([scorer.features(t) for label in (0, 1) for t in sides[label]])
    y = np.repeat([0, 1], [len(sides[0]), len(sides[1])])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return Model(ordinary, toxic, around, mean, scale, logistic(np.c_[(x - mean) / scale, np.ones(len(x))], y))


_scorers: dict[bytes, Scorer] = {}


def probabilities(model: Model, texts: list[bytes]) -> np.ndarray:
    if model.toxic not in _scorers:
        _scorers.clear()
        _scorers[model.toxic] = Scorer(model.ordinary, model.toxic, model.around)
    x = (np.array([_scorers[model.toxic].features(t) for t in texts]).reshape(len(texts), len(model.mean)) - model.mean) / model.scale
    return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ model.weights, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, learn: Column, most: int = TRAIN_DOCS) -> list[tuple[bytes, int]]:
    """(text, label) rows for learning: of the rows that ``learn`` holds for, about ``most`` of each label, by hash."""
    given = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    counts = {r[0]: r[1] for r in given.groupBy("toxic").count().collect()}
    share = F.lit(0)
    for label, n in counts.items():
        share = F.when(F.col("toxic") == label, F.lit(round(1_000_000 * min(1.0, most / n)))).otherwise(share)
    chosen = given.where(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1_000_000)) < share)
    # about 2 * most ids, whatever the size of the tables: sent to the texts, which are not shuffled
    rows = docs.where(learn).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").collect()
    return [((r["text"] or "").encode(), r["toxic"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"] or ""))]


def score(docs: DataFrame, model: Model | None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every row."""
    kind = docs.schema[id].dataType.simpleString()
    if model is None:
        return docs.select(F.col(id).alias("doc_id"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            p = probabilities(sent.value, [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def held_out(parts: int, part: int) -> Column:
    """Whether a document belongs to the part that nothing is learned from; a null doc_id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(parts)) == part


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Nulls, empty and very long texts, repeated rows and an empty table: as the module states."""
    docs = table(spark, sf_dir, "documents")
    model = train(sample(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0)))
    return score(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
