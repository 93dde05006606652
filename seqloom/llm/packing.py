"""Packing of documents into sequences of fixed length, first-fit decreasing in randomised groups.

A document's ids are cut into pieces of the sequence length and one rest.  Whole pieces are sequences by themselves.
The rests are dealt into random groups of about ``GROUP`` and each group packs its rests, longest first, into the first
sequence with room, found in a tournament tree over the sequences' remaining capacities.

Texts are encoded where they are read; what is shuffled is a row of four numbers for each piece.

Defined cases: a null or empty text is the end id alone; a very long text makes many whole pieces; equal and null doc_ids
are separate documents with pieces of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import give_back, materialize, table
from .tokens import encoder, vocabulary

LENGTH = 4096
#: Expected number of rests in a group.
GROUP = 2_000


class Tournament:
    """A complete binary tree of the largest capacity below each node; finds the first bin that holds a size."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1 << max(0, (bins - 1).bit_length())
        self.best = [capacity] * (2 * self.width)

    def place(self, size: int) -> tuple[int, int]:
        """Puts ``size`` into the first bin with room; returns the bin and the capacity it had."""
        best, node = self.best, 1
        while node < self.width:
            node = 2 * node if best[2 * node] >= size else 2 * node + 1
        room, at = best[node], node - self.width
        best[node] = room - size
        node >>= 1
        while node:
            left, right = best[2 * node], best[2 * node + 1]
            best[node] = left if left > right else right
            node >>= 1
        return at, room


def first_fit_decreasing(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size; sizes are 1..length, ties in the order given."""
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    tree = Tournament(max(1, len(sizes)), length)
    for i in np.argsort(-sizes, kind="stable"):
        at, room = tree.place(int(sizes[i]))
        bins[i], offsets[i] = at, length - room
    return bins, offsets


#: Ids in a batch of pieces that are returned with them, at least, unless no more follow.
BATCH_IDS = 1 << 18
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str | None = None, end_id: int = 2, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document; with its ids as little-endian unsigned 32-bit integers, if asked for."""
    path = path or vocabulary()
    end = np.array([end_id], dtype="<u4")
    names = [x.split()[0] for x in PIECE.split(", ")] + ["ids"] * with_ids

    def record(rows, ids):
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
        return pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names=names)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            rows, cut, held = [], [], 0
            for doc_id, found in zip(batch.column(0).to_pylist(), enc.encode_many(batch.column(1))):
                ids = np.concatenate([found, end]).astype("<u4").tobytes()
                n = len(ids) // 4
                for start in range(0, n, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n))
                    if with_ids:
                        cut.append(piece)
                        held += len(piece) // 4
                    if held >= BATCH_IDS:
                        yield record(rows, cut)
                        rows, cut, held = [], [], 0
            yield record(rows, cut)
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE + ", ids binary" * with_ids)


def pack(docs: DataFrame, path: str | None = None, end_id: int = 2, length: int = LENGTH, group: int = GROUP, seed: int = 6, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` with sequence_id and offset (and their ids, if asked for)."""
    cut = materialize(pieces(docs, path, end_id, length, with_ids).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    rests = cut.where(F.col("length") < length)
    groups = max(1, -(-rests.count() // group))
    # dealt by row, not by document: copies of a document under one doc_id go to any group
    dealt = rests.select("piece", "length", F.pmod(F.xxhash64(F.lit(seed), "piece"), F.lit(groups)).alias("group"))

    def run(key, got):
        got = got.sort_by([("length", "descending"), ("piece", "ascending")])
        bins, offsets = first_fit_decreasing(got.column("length").to_numpy(), length)
        return pa.table({"piece": got.column("piece"), "sequence_id": (key[0].as_py() << 32) + bins, "offset": offsets})

    placed = dealt.groupBy("group").applyInArrow(run, "piece long, sequence_id long, offset long")
    # a sequence of one whole piece is numbered after the piece, above all groups' numbers
    whole = cut.where(F.col("length") == length).withColumn("sequence_id", F.lit(1 << 62) + F.col("piece")).withColumn("offset", F.lit(0).cast("long"))
    return cut.join(placed, "piece").unionByName(whole).drop("piece")


def op6_pack(spark, sf_dir: str) -> DataFrame:
    """Nulls, empty and very long texts, repeated doc_ids and an empty table: as the module states."""
    return pack(table(spark, sf_dir, "documents"))
