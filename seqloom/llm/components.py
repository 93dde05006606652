"""Connected components of a graph given as an edge list, by repeated contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import look_up, materialize


#: Edges that one task contracts at once.
FEW = 10_000


def _at_once(batches):
    """(node, root) of all nodes of the edges (u, v) of one part; at most ``FEW`` of them."""
    got = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1) for b in batches]
    nodes, at = np.unique(np.concatenate(got) if got else np.zeros((0, 2), np.int64), return_inverse=True)
    at = at.reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[local_roots(len(nodes), at[:, 0], at[:, 1])])], names=["node", "root"])


def contract(edges: DataFrame) -> DataFrame:
    """(u, v) edges of longs in, (node, root) out: one row per node of an edge, nodes of a component having one root.

    In each round every node moves to the first of itself and its neighbours, by value in even rounds and by a hash in
    odd ones; edges follow their ends, loops and repeats go.  Even rounds fold stars, odd ones shorten paths, so the
    number of rounds grows with the logarithm of the graph.  First neighbours are found by an aggregation that combines
    on the map side, and ends and roots are renamed by ``look_up``, so neither a node with very many neighbours nor a
    giant component is a single task's work.  The last ``FEW`` edges are contracted in one task, at once.
    Empty and looping edges are allowed; a node all of whose edges are loops has no row.
    """
    rounds: list[DataFrame] = []
    edges = materialize(edges.select("u", "v").where("u <> v").distinct(), "edges")
    while left := edges.count():
        if left <= FEW:
            rounds.append(materialize(edges.coalesce(1).mapInArrow(_at_once, "node long, root long"), "moved"))
            break
        k = len(rounds)
        rank = (lambda c: F.struct(F.col(c).alias("r"), F.col(c).alias("n"))) if k % 2 == 0 else (lambda c: F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("r"), F.col(c).alias("n")))
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min(rank("v")).alias("near"), F.count("*").alias("n"))
        moved = materialize(near.select(F.col("u").alias("node"), F.least(rank("u"), F.col("near"))["n"].alias("root"), "n"), "moved")
        rounds.append(moved.select("node", "root"))
        renamed = edges
        for end in ("u", "v"):
            named = moved.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
            renamed = look_up(renamed, end, named, moved.select(F.col("node").alias(end), "n"))
        edges = materialize(renamed.where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = rounds[-1]
    for earlier in rounds[-2::-1]:
        later = out.select(F.col("node").alias("root"), F.col("root").alias("further"))
        out = materialize(look_up(earlier, "root", later).select("node", F.coalesce("further", "root").alias("root")), "roots")
    return out


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of the component of each of n nodes, for edges a-b held in arrays."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(up := root[root], root):
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root
