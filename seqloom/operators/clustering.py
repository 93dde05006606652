"""Clustering: sequences with Drop-DTW barycentres, hierarchies of a bounded number of vectors, spectral, and Hopkins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.alignment import drop_dtw_two_sided, event_costs
from seqloom.operators.evaluation import silhouettes
from seqloom.sources.scratch import written

#: Largest number of points that the hierarchies take; they hold all distances on the driver.
MOST_POINTS = 3_000


def _distance(a, b, drop: float) -> tuple[float, list[tuple[int, int]]]:
    return drop_dtw_two_sided(event_costs(a[1], b[1], a[0], b[0]), drop)


def align_mean(seqs: list[tuple[np.ndarray, np.ndarray]], drop: float, rounds: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Barycentre of (times, event distributions): all aligned to the longest (the first of equals), matched points averaged.

    Positions that nothing matches are dropped.
    """
    ref = max(seqs, key=lambda s: len(s[0]))
    for _ in range(rounds):
        t, e, n = np.zeros(len(ref[0])), np.zeros(ref[1].shape), np.zeros(len(ref[0]))
        for s in seqs:
            for i, j in _distance(ref, s, drop)[1]:
                t[i] += s[0][j]
                e[i] += s[1][j]
                n[i] += 1
        if not n.any():
            return ref
        ref = (t[n > 0] / n[n > 0], e[n > 0] / n[n > 0, None])
    return ref


def sequence_kmeans(df: DataFrame, id: str, k: int, width: int, drop: float = 1.0, rounds: int = 5, seed: int = 0) -> DataFrame:
    """(id, cluster, distance) for rows (id, t array, e array of codes below ``width``), by Drop-DTW and barycentres.

    The first centres are k rows drawn by hash.  A round assigns every row where it is, aligns it to its centre there, and
    averages matched points by an aggregation over (cluster, position); only the k centres reach the driver.  A cluster
    that gets nothing keeps its centre.  Always returns the last assignment.
    """
    df = df.select(F.col(id).alias("id"), F.col("t").cast("array<double>").alias("t"), F.col("e").cast("array<int>").alias("e"))
    hot = lambda e: np.eye(width)[np.asarray(e, int)]
    first = df.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k).collect()
    centres = [(np.asarray(r["t"]), hot(r["e"])) for r in first]
    kind = "id long, cluster int, distance double, pos int, pt double, pe array<double>"

    def assign(centres):
        def run(batches):
            for pdf in batches:
                rows = []
                for i, t, e in zip(pdf["id"], pdf["t"], pdf["e"]):
                    s = (np.asarray(t), hot(e))
                    found = [_distance(c, s, drop) for c in centres]
                    best = int(np.argmin([f[0] for f in found]))
                    rows += [(i, best, found[best][0], p, s[0][q], s[1][q].tolist()) for p, q in found[best][1]] or [(i, best, found[best][0], None, None, None)]
                yield type(pdf)(rows, columns=["id", "cluster", "distance", "pos", "pt", "pe"]).astype({"pos": "Int32"})

        return df.mapInPandas(run, kind)

    for _ in range(rounds):
        if not centres:
            break
        means = [F.avg(F.col("pe")[j]).alias(f"e{j}") for j in range(width)]
        got = assign(centres).where("pos IS NOT NULL").groupBy("cluster", "pos").agg(F.avg("pt").alias("t"), *means).orderBy("cluster", "pos").collect()
        again = [(np.array([r["t"] for r in got if r["cluster"] == c]), np.array([[r[f"e{j}"] for j in range(width)] for r in got if r["cluster"] == c])) for c in range(len(centres))]
        again = [a if len(a[0]) else b for a, b in zip(again, centres)]
        still = all(len(a[0]) == len(b[0]) and np.allclose(a[0], b[0]) and np.allclose(a[1], b[1]) for a, b in zip(again, centres))
        centres = again
        if still:
            break
    return assign(centres).select("id", "cluster", "distance").distinct()


def _points(df: DataFrame, id: str, *columns: str) -> list:
    n = df.count()
    if n > MOST_POINTS:
        raise ValueError(f"{n} points; a hierarchy takes {MOST_POINTS} at most")
    return df.select(id, *columns).orderBy(id).collect()


def ward(df: DataFrame, id: str, vector: str) -> tuple[list, np.ndarray]:
    """Ward's hierarchy: the ids in order, and merges (a, b, height, size), numbered as points then merges."""
    rows = _points(df, id, vector)
    x = np.array([r[1] for r in rows], dtype=float)
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(2) if n else np.zeros((0, 0))
    np.fill_diagonal(d, np.inf)
    size, name, merges = np.ones(n), list(range(n)), []
    alive = np.ones(n, bool)
    for step in range(n - 1):
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        merges.append((min(name[i], name[j]), max(name[i], name[j]), float(np.sqrt(d[i, j])), int(size[i] + size[j])))
        # Lance-Williams update of squared distances
        k = alive.copy()
        k[[i, j]] = False
        total = size[i] + size[j] + size[k]
        d[i, k] = d[k, i] = ((size[i] + size[k]) * d[i, k] + (size[j] + size[k]) * d[j, k] - size[k] * d[i, j]) / total
        d[j], d[:, j], alive[j] = np.inf, np.inf, False
        size[i] += size[j]
        name[i] = n + step
    return [r[0] for r in rows], np.array(merges).reshape(-1, 4)


def cut(merges: np.ndarray, n: int, k: int) -> list[int]:
    """Labels 0.. of n points with k clusters, numbered in order of their first point."""
    root = list(range(2 * n))
    for step, (a, b, _, _) in enumerate(merges[: max(0, n - k)]):
        root[int(a)] = root[int(b)] = n + step

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    order: dict[int, int] = {}
    return [order.setdefault(top(i), len(order)) for i in range(n)]


def agglomerate_sequences(df: DataFrame, id: str, k: int, width: int, drop: float = 1.0) -> list[tuple[object, int]]:
    """(id, cluster) by repeatedly merging the two nearest sequences into their barycentre."""
    rows = _points(df, id, "t", "e")
    seqs = {i: (np.asarray(r["t"], float), np.eye(width)[np.asarray(r["e"], int)]) for i, r in enumerate(rows)}
    members = {i: [i] for i in seqs}
    far = {(a, b): _distance(seqs[a], seqs[b], drop)[0] for a in seqs for b in seqs if a < b}
    while len(seqs) > k:
        a, b = min(far, key=lambda p: (far[p], p))
        seqs[a] = align_mean([seqs[a], seqs.pop(b)], drop)
        members[a] += members.pop(b)
        far = {p: d for p, d in far.items() if b not in p}
        far |= {(min(a, c), max(a, c)): _distance(seqs[min(a, c)], seqs[max(a, c)], drop)[0] for c in seqs if c != a}
    return [(rows[i][0], n) for n, (_, m) in enumerate(sorted(members.items())) for i in sorted(m)]


def spectral(edges: DataFrame, k: int, neighbours: int, seed_rounds: int = 20) -> DataFrame:
    """(id, cluster) by power iteration on the graph of each point's nearest neighbours (id1, id2, d both ways round)."""
    from pyspark.ml.clustering import PowerIterationClustering
    from pyspark.sql import Window

    near = edges.withColumn("k", F.row_number().over(Window.partitionBy("id1").orderBy("d", "id2"))).where(F.col("k") <= neighbours)
    graph = near.select(F.least("id1", "id2").alias("src"), F.greatest("id1", "id2").alias("dst"), F.exp(-F.col("d")).alias("weight")).distinct()
    return PowerIterationClustering(k=k, maxIter=seed_rounds, weightCol="weight").assignClusters(graph)


def best_neighbours(edges: DataFrame, k: int, grid: list[int]) -> list[tuple[int, float]]:
    """(neighbours, mean silhouette) of spectral clusterings over a grid, the best first, of equals the fewest neighbours."""
    scores = []
    for n in grid:
        mean = silhouettes(edges, spectral(edges, k, n).select("id", F.col("cluster").alias("label"))).agg(F.avg("silhouette")).first()[0]
        scores.append((n, -1.0 if mean is None else float(mean)))
    return sorted(scores, key=lambda x: (-x[1], x[0]))


def matrix_kmeans(edges: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """(id, cluster) by k-means on the rows of the upper triangle of a distance matrix (id1, id2, d; id1 below id2).

    A row is a vector as long as there are points, so there may be no more than ``MOST_POINTS``.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ids = edges.select(F.col("id1").alias("id")).union(edges.select("id2")).distinct()
    places = {r[0]: i for i, r in enumerate(_points(ids, "id"))}
    at = edges.sparkSession.createDataFrame(list(places.items()), ids.withColumn("place", F.lit(0).cast("int")).schema) if places else ids.withColumn("place", F.lit(0))
    to = at.select(F.col("id").alias("id2"), "place")
    rows = edges.join(F.broadcast(to), "id2").groupBy("id1").agg(F.map_from_entries(F.collect_list(F.struct("place", F.col("d").cast("double").alias("d")))).alias("held"))
    wide = at.join(rows, F.col("id") == F.col("id1"), "left").withColumn("held", F.coalesce("held", F.expr("map_from_arrays(cast(array() as array<int>), cast(array() as array<double>))")))
    v = wide.select("id", array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(max(0, len(places) - 1))), lambda j: F.coalesce(F.try_element_at("held", j), F.lit(0.0)))).alias("features"))
    return KMeans(k=k, seed=seed).fit(v).transform(v).select("id", F.col("prediction").alias("cluster"))


def workflows(measures: dict[str, DataFrame], methods: dict[str, Callable[[DataFrame, int], DataFrame]], ks: list[int]) -> DataFrame:
    """(id, measure, method, k, cluster): every method (of a distance list and a number of clusters) on every measure."""
    out = None
    for m, edges in measures.items():
        edges = written(edges, "measure")
        for name, f in methods.items():
            for k in ks:
                one = f(edges, k).select("id", F.lit(m).alias("measure"), F.lit(name).alias("method"), F.lit(k).alias("k"), "cluster")
                out = one if out is None else out.unionByName(one)
    return out


def hopkins(df: DataFrame, id: str, vector: str, m: int = 50, seed: int = 0) -> float | None:
    """Hopkins statistic: distances from m points drawn in the bounding box, and from m rows, to their nearest rows.

    The draws are few and sent to the rows; the least distances are found by an aggregation.
    """
    x = df.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    dims = x.select(F.size("v")).first()
    if dims is None:
        return None
    box = x.agg(*[f(F.col("v")[j]) for j in range(dims[0]) for f in (F.min, F.max)]).first()
    low, high = np.array(box[0::2]), np.array(box[1::2])
    rng = np.random.default_rng(seed)
    drawn = [(j, None, p.tolist()) for j, p in enumerate(rng.uniform(low, high, (m, dims[0])))]
    rows = [(m + j, r["id"], r["v"]) for j, r in enumerate(x.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(m).collect())]
    probes = df.sparkSession.createDataFrame([(a, b, c) for a, b, c in drawn + rows], "k int, own long, p array<double>")
    gap = F.sqrt(F.aggregate(F.zip_with("v", "p", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, z: s + z))
    least = x.join(F.broadcast(probes), F.col("own").isNull() | (F.col("own") != F.col("id"))).groupBy("k").agg(F.min(gap).alias("d"))
    u, w = least.agg(F.sum(F.when(F.col("k") < m, F.col("d"))), F.sum(F.when(F.col("k") >= m, F.col("d")))).first()
    return None if not u and not w else (u or 0) / ((u or 0) + (w or 0))
