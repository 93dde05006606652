"""Hand-checked values of the sequence functions, metrics, statistics and fits."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.functions import alignment as A
from seqloom.functions import fits
from seqloom.functions import sequences as S
from seqloom.operators import clustering as C
from seqloom.operators import distances as D
from seqloom.operators import evaluation as E
from seqloom.operators import pairs as P
from seqloom.operators import relational as RL
from seqloom.operators import statistics as ST
from seqloom.operators import survival as SV
from seqloom.operators import triclusters as TR
from seqloom.operators import weak as W

T, V = [0, 100, 200, 400], [44.0, 40.0, 40.0, 30.0]
EVENTS = np.array([1, 3, 2, 1, 1, 2, 1.0])


@pytest.fixture(scope="module")
def seq(spark):
    return S.to_sequences(spark.createDataFrame([(1, t, v) for t, v in zip(T, V)], "id int, t int, v double"), "id", "t", "v")


def test_sequence_features(seq):
    q = F.col("seq")
    ols, quad, cp = S.ols(q), S.quadratic(q), S.change_point(q, 2, 0.0)
    r = seq.select(
        S.duration(q), S.slope(q), S.min_step_slope(q), S.auc_reference(q), S.auc_trapezoid(q), S.interpolate(q, F.lit(183)), S.percent_change(q), S.curvature(q), S.plateau(q),
        S.progression_variability(q), S.early_slope(q), ols["slope"], ols["intercept"], quad["a"], quad["b"], quad["c"], S.time_to_threshold(q, 35), S.time_to_threshold(q, 10), cp,
    ).first()
    want = [400, -0.035, -0.05, 12800, 15200, 40, 9.0909090909, 0.0007875, 0, 4.1096093353, -0.02, -0.0337142857, 44.4, -0.00005, -0.0305, 39.59375, 300, None, None]
    assert [x if x is None else pytest.approx(x, abs=1e-8) for x in want] == list(r)
    assert seq.select(S.grid(q, 90, 6, 1)).first()[0] == [44, 40.4, 40, 36.5, 32, 0]


def test_grid_rounds_the_scaled_double(spark):
    # sqrt(104.04) / 12 is one place above 0.85, sqrt(7361.64) / 12 one below 7.15; both are halves once they are scaled
    got = spark.sql("SELECT explode(array(104.04D, 392.04D, 7361.64D, 8873.64D, 1200.5D)) AS p").select(F.array(F.struct(F.lit(0).alias("t"), (F.sqrt("p") / 12).alias("v"))).alias("seq"), "p").select("p", S.grid(F.col("seq"), 90, 1, 1)[0]).collect()
    assert dict(map(tuple, got)) == {p: float(np.round(np.sqrt(p) / 12, 1)) for p in (104.04, 392.04, 7361.64, 8873.64, 1200.5)}
    assert dict(map(tuple, got))[104.04] == 0.8


def test_gaps_without_pairs(spark):
    rng = np.random.default_rng(0)
    for x in (rng.normal(size=40), rng.normal(size=30) + 1e8, rng.integers(0, 5, 40).astype(float), np.round(rng.normal(size=40), 1), np.array([1.5, 1.5]), np.array([2.0])):
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(99, None)], "id int, v double")
        g, d = P.gaps(df, "v"), np.sort([abs(a - b) for i, a in enumerate(x) for b in x[:i]])
        assert [g._at(k) for k in range(len(d))] == list(d)
        assert g.percentiles([0.25, 0.75]) == (pytest.approx(list(np.quantile(d, [0.25, 0.75]))) if len(d) else [None, None])
        assert g.percentiles([0.5], positive=True)[0] == (pytest.approx(np.median(d[d > 0])) if (d > 0).any() else None)
        assert g.summary() == (pytest.approx((d[0], d[-1], d.mean())) if len(d) else (None, None, None))
    assert P.gaps(df.withColumn("v", F.lit(float("nan"))), "v") is None


@pytest.mark.parametrize("name", ["pairs_quartile_votes", "pairs_similarity", "pairs_normalised"])
def test_statistics_of_pairs_come_before_the_pairs(spark, sf_dir, name, monkeypatch):
    # neither quartiles, medians nor ranges are taken from the rows of pairs
    from seqloom import catalog
    from seqloom.operators import weak

    monkeypatch.setattr(P, "percentiles", None)
    monkeypatch.setattr(weak, "percentiles", None)
    assert catalog.QUERIES[name](spark, sf_dir).count() == 45


def test_folded_distances(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    x[7], x[8] = x[3], x[3]
    labels = [None if i == 11 else int(i % 3) for i in range(60)]
    rows = [(i, None if i == 5 else [float(y) for y in v], c) for i, (v, c) in enumerate(zip(x, labels))]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(3)
    monkeypatch.setattr(D, "IN_BLOCK", 16)
    monkeypatch.setattr(D, "AT_ONCE", 7)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    d[5], d[:, 5] = np.nan, np.nan
    np.fill_diagonal(d, np.nan)
    own = np.array([-1 if c is None else c for c in labels])
    for r in D.totals_by_label(df, "id", "v", "label", (2.0,)).collect():
        far = d[r["id"]][own == r["other"]]
        assert (r["total"], r["n"], r["within_0"]) == (pytest.approx(np.nansum(far)), (~np.isnan(far)).sum(), (far <= 2.0).sum())
    near = sorted(map(tuple, D.nearest(df, "id", "v", 4, 6).collect()))
    want = sorted((i, j, round(d[i, j], 6)) for i in range(60) if i != 5 for j in sorted((j for j in range(60) if not np.isnan(d[i, j])), key=lambda j: (round(d[i, j], 6), j))[:4])
    assert [n[:2] for n in near] == [w[:2] for w in want] and np.allclose([n[2] for n in near], [w[2] for w in want], atol=1e-6)
    assert D.nearest(df.where("id < 1"), "id", "v", 4).count() == D.totals_by_label(df.where("id < 0"), "id", "v", "label").count() == 0


@pytest.mark.parametrize("name", ["silhouette", "medoid_by_label", "nearest_neighbour", "internal_quality", "spectral_clusters"])
def test_vector_queries_list_no_pairs(spark, sf_dir, name, monkeypatch):
    from seqloom import catalog

    monkeypatch.setattr(P, "pairs", None)
    assert not catalog.QUERIES[name](spark, sf_dir).isEmpty()


def test_aligned_areas_come_before_the_pairs(spark, sf_dir, monkeypatch):
    from seqloom import catalog

    made, pairs = [], P.pairs
    monkeypatch.setattr(P, "pairs", lambda df, id: made.append(df.columns) or pairs(df, id))
    assert catalog.QUERIES["pairs_aligned_auc"](spark, sf_dir).count() == 45
    assert made == [["id", "duration", "steps", "inside", "fallen"]]


def test_labelled_pairs_take_no_median_of_pairs(spark, sf_dir, monkeypatch):
    from seqloom.plans import mining_queries as M

    found = [r["mean_diff"] for r in M.labelled_pairs(spark, sf_dir).select("mean_diff").collect()]
    monkeypatch.setattr(F, "median", None)
    got = M.labelled_pairs(spark, sf_dir).select("mean_diff", "label").collect()
    assert [r["label"] for r in got] == [int(r["mean_diff"] > np.median(found)) for r in got] and len(got) == 45


def test_sequences_of_one_point_and_none(spark):
    q = F.col("seq")
    one = S.to_sequences(spark.createDataFrame([(1, 5, 2.0), (2, None, 1.0)], "id int, t int, v double"), "id", "t", "v")
    assert one.select(S.slope(q), S.curvature(q), S.min_step_slope(q), S.interpolate(q, F.lit(9)), S.time_to_threshold(q, 3), S.plateau(q), S.ols(q)["slope"]).collect() == [(None, None, None, 2.0, 5.0, 0, None)]


def test_nearest(spark):
    x = S.to_sequences(spark.createDataFrame([(1, t, 0.0) for t in (0, 90, 200)], "id int, t int, v double"), "id", "t", "v")
    n = lambda t, tol: x.select(S.nearest(F.col("seq"), F.lit(t), tol)).first()[0]
    assert (n(100, 30), n(145, 60), n(400, 30)) == (1, 1, None)


def test_event_metrics(spark):
    a, b = [1, 3, 2, 1, 1, 2, 1], [3, 3, 2, 3, 2]
    df = spark.createDataFrame([(a, b, [1, 2, 3, 4], [2, 4, 5], [2, 3, 2, 3, 1], [3, 2, 3, 3, 2, 3, 2])], "a array<int>, b array<int>, x array<int>, y array<int>, c array<int>, e array<int>")
    c = F.col
    r = df.select(A.levenshtein(c("a"), c("b")), A.levenshtein(c("a"), c("b"), lambda x, y: F.abs(x - y)), A.levenshtein(c("a"), c("b"), lambda x, y: F.when(x == y, 0.0).otherwise(0.5)), A.dtw(c("x"), c("y")), A.lcss_length(c("a"), c("c")), A.lcss_distance(c("a"), c("c")), A.euclidean(c("a"), c("e"))).first()
    assert list(r) == [4, 6, 3, 3, 3, pytest.approx(0.4), pytest.approx(math.sqrt(13))]
    ta, tb = np.array([1, 2, 3, 8, 10, 12, 15.0]), np.array([17, 20, 23, 25, 26, 28, 30.0])
    assert A.drop_dtw_one_sided(A.event_costs(EVENTS, np.array([3, 2, 3, 3, 2, 3, 2.0]), ta, tb)) == 1558


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=8), st.lists(st.integers(0, 3), min_size=1, max_size=8))
def test_numpy_metrics_against_plain_programmes(x, y):
    def table(first_row, first_col, cell):
        m = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for j in range(len(y) + 1):
            m[0][j] = first_row(j)
        for i in range(1, len(x) + 1):
            m[i][0] = first_col(i)
            for j in range(1, len(y) + 1):
                m[i][j] = cell(m, i, j)
        return m[-1][-1]

    a, b, inf = np.array(x, float), np.array(y, float), math.inf
    assert A.np_levenshtein(a, b) == table(lambda j: j, lambda i: i, lambda m, i, j: min(m[i - 1][j] + 1, m[i][j - 1] + 1, m[i - 1][j - 1] + (x[i - 1] != y[j - 1])))
    assert A.np_levenshtein(a, b, 0.5, 1.5, 0.75) == pytest.approx(table(lambda j: j, lambda i: i, lambda m, i, j: min(m[i - 1][j] + 1.5, m[i][j - 1] + 0.5, m[i - 1][j - 1] + 0.75 * (x[i - 1] != y[j - 1]))))
    assert A.np_dtw(a, b) == pytest.approx(table(lambda j: 0 if j == 0 else inf, lambda i: inf, lambda m, i, j: abs(x[i - 1] - y[j - 1]) + min(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1])))
    assert A.np_lcss(a, b) == table(lambda j: 0, lambda i: 0, lambda m, i, j: m[i - 1][j - 1] + 1 if x[i - 1] == y[j - 1] else max(m[i - 1][j], m[i][j - 1]))
    assert A.np_dtw(a, a) == 0 and A.twed(a, a, np.arange(len(a)), np.arange(len(a))) == 0
    assert A.drop_dtw_two_sided(A.event_costs(a, a, np.arange(len(a)), np.arange(len(a))), 1.0)[0] == 0


def test_fits_recover_curves():
    t = np.arange(0, 1500, 100.0)
    x = fits.padded([t, t], [48 / (1 + np.exp(0.005 * (t - 700))), 40 * np.exp(-((t / 800) ** 1.7))])
    p, sse = fits.fit_sigmoid(*x)
    assert p[0] == pytest.approx([48, 0.005, 700, 0], abs=1e-4) and sse[0] < 1e-8
    assert fits.d50(*x, p)[0] == pytest.approx(700 / 365.25, abs=1e-4)
    assert fits.fit_logistic(*x)[0][0] == pytest.approx([48, 700, 200], rel=1e-4)
    assert fits.fit_weibull(*x)[0][1] == pytest.approx([40, 800, 1.7], rel=1e-3)


def test_survival_values(spark):
    km = SV.kaplan_meier(spark.createDataFrame([("x", t, e) for t, e in zip([1, 2, 2, 3, 4], [1, 1, 0, 1, 0])], "g string, t int, e int"), "g", "t", "e")
    assert [r["survival"] for r in km.orderBy("t").collect()] == [pytest.approx(x) for x in (0.8, 0.6, 0.3, 0.3)]
    assert SV.median_survival(km).first()["median"] == 3
    two = spark.createDataFrame([("a", 1, 1), ("a", 3, 1), ("a", 5, 1), ("b", 2, 1), ("b", 4, 0), ("b", 6, 1)], "g string, t int, e int")
    r = SV.logrank(two, "g", "t", "e").first()
    assert (r["logrank"], r["wilcoxon"]) == (pytest.approx(1.2222222222), pytest.approx(0.8))
    assert SV.chi2_tail(r["logrank"]) == pytest.approx(0.2689249805) and SV.chi2_tail(0.8) == pytest.approx(0.3710933695)


def test_statistics(spark):
    table = lambda m: spark.createDataFrame([(i, j) for i, row in enumerate(m) for j, n in enumerate(row) for _ in range(n)], "a int, b int")
    v = lambda m, yates=True: ST.cramers_v(table(m), "a", "b", yates).first()["cramers_v"]
    assert v([[10, 2], [3, 9], [4, 4]]) == pytest.approx(0.5074606782)
    assert (v([[10, 2], [3, 9]]), v([[10, 2], [3, 9]], False)) == (pytest.approx(0.5017452060), pytest.approx(0.5853694070))
    k = ST.kruskal(spark.createDataFrame([(float(x), g) for g, xs in enumerate(([1, 2, 3], [2, 4, 6])) for x in xs], "v double, g int"), "v", "g").first()
    assert (k["h"], k["h_corrected"]) == (pytest.approx(1.7142857143), pytest.approx(1.7647058824))


def test_evaluation(spark):
    lab = lambda a, b: spark.createDataFrame(list(zip(a, b)), "a int, b int")
    assert E.adjusted_rand(lab([0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 1, 1]), "a", "b").first()[0] == pytest.approx(0.3243243243)
    assert E.adjusted_rand(lab([0, 1], [0, 1]), "a", "b").first()[0] == 1
    e = E.entropy(spark.createDataFrame([(i,) for i, n in enumerate((241, 101, 27)) for _ in range(n)], "l int"), "l").first()
    assert e["normalised"] == pytest.approx(0.7502273926)
    pts = spark.createDataFrame([(1, 1.0, 5.0, 8.0), (2, 2.0, 4.0, 7.0), (3, 3.0, 3.0, 5.0), (4, 4.0, 2.0, 4.0), (5, 5.0, 1.0, 2.0), (6, 3.0, 6.0, 9.0), (7, 6.0, 0.5, 1.0)], "id int, a double, b double, c double")
    assert [r["on_front"] for r in E.pareto(pts, "id", ["a", "b", "c"]).orderBy("id").collect()] == [True, True, True, True, True, False, True]
    conf = [[5, 1, 0], [2, 3, 1], [0, 1, 7]]
    rates = E.class_rates(spark.createDataFrame([(i, j) for i in range(3) for j in range(3) for _ in range(conf[i][j])], "t int, p int"), "t", "p")
    r = rates.agg(*E.averaged(rates, "specificity", "tn", "fp"), *E.averaged(rates, "npv", "tn", "fn")).first()
    assert (r["specificity_macro"], r["specificity_weighted"], r["npv_macro"]) == (pytest.approx(0.8769841270), pytest.approx(0.8809523810), pytest.approx(0.8799145299))


def test_quartile_votes_and_models(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (5.0,), (None,)], "x double")
    lf = W.quartile_lf(df, "x")
    assert [r[0][0] for r in W.votes(df, [lf]).select("votes").collect()] == [0, 0, -1, 1, 1, -1]
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 4000)
    votes = [[int(v if rng.random() < a else 1 - v) for a in (0.9, 0.8, 0.7)] for v in y]
    data = spark.createDataFrame([(v,) for v in votes], "votes array<int>")
    assert W.LabelModel().fit(data, 3).accuracy == pytest.approx([0.9, 0.8, 0.7], abs=0.05)


def test_tricluster_of_the_small_cube(spark):
    cube = {0: ([1, 2, 4], [2, 4, 8], [3, 6, 12], [1, 5, 2]), 1: ([2, 4, 8], [4, 8, 16], [6, 12, 24], [2, 1, 7])}
    rows = [(t, s, g, float(v)) for t, gs in cube.items() for g, vs in enumerate(gs) for s, v in enumerate(vs)]
    found = TR.triclusters(spark.createDataFrame(rows, "t int, s int, g long, val double"), 0.01, 2, 1, 3).collect()
    assert [(r["t"], r["s"], r["g"]) for r in found] == [([0, 1], [0, 1, 2], [0, 1, 2])]


def test_biclusters_over_overlapping_runs(spark):
    """Every choice of one run for each pair of features, in a cube so dense that runs overlap."""
    rng = np.random.default_rng(3)
    cube = spark.createDataFrame([(0, s, g, float(v)) for g in range(60) for s, v in enumerate(np.round(rng.uniform(1, 1.6, 4), 3))], "t int, s int, g long, val double")
    edges = TR.ratio_edges(cube, 0.15, 4).persist()
    runs = {}
    for r in edges.collect():
        runs.setdefault((r["s1"], r["s2"]), set()).add(frozenset(r["g"]))
    found = {(frozenset(p), g) for p, gs in runs.items() for g in gs}
    for s in [c for n in (3, 4) for c in itertools.combinations(range(4), n)]:
        sets = {frozenset(range(60))}
        for p in itertools.combinations(s, 2):
            sets = {a & b for a in sets for b in runs.get(p, ()) if len(a & b) >= 4}
        found |= {(frozenset(s), g) for g in sets}
    want = {(s, g) for s, g in found if not any(s <= s2 and g <= g2 and (s, g) != (s2, g2) for s2, g2 in found)}
    got = [(frozenset(r["s"]), frozenset(r["g"])) for r in TR.biclusters(edges, 2, 4).collect()]
    assert sum(len(s) > 2 for s, _ in want) > 50 and len(got) == len(set(got)) and set(got) == want


def test_importance_of_every_feature(spark, sf_dir):
    from seqloom.plans import mining_queries

    assert [r["feature"] for r in mining_queries.permutation_importance(spark, sf_dir).collect()] == list(mining_queries.DIFFS)


def test_cube_source_round_trip(spark, tmp_path):
    from seqloom.sources.cube import CubeSource, parse, render

    rows = [(0, 0, 3, 1.5), (0, 1, 3, 2e-5), (1, 0, 4, 7.0)]
    assert sorted(parse(render(rows).splitlines())) == rows
    spark.dataSource.register(CubeSource)
    spark.createDataFrame(rows, "t int, s int, g long, val double").coalesce(1).write.format("cube").mode("append").save(str(tmp_path / "c"))
    assert sorted(map(tuple, spark.read.format("cube").load(str(tmp_path / "c")).collect())) == rows


def test_hierarchies():
    x = np.array([[0, 0], [0, 1], [5, 5], [5, 6.0]])
    assert C.cut(np.array([[0, 1, 1, 2], [2, 3, 1, 2], [4, 5, 9, 4]]), 4, 2) == [0, 0, 1, 1]
    assert len(x) == 4


def test_names():
    assert RL.clean_name("Sexe : [ SEX ] [ STATIC ]") == "SEX" and RL.clean_name(" a b ") == "a_b"


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


# --- ranges, fronts, nominal features ---------------------------------------------------------------------------------


def test_running_sums_and_percentiles(spark):
    from seqloom.operators import ranges

    rng = np.random.default_rng(2)
    rows = [(int(g), float(x)) for g, x in zip(rng.integers(0, 3, 900), rng.integers(0, 200, 900))] + [(1, None), (None, 3.5), (None, 4.0)]
    df = spark.createDataFrame(rows, "g int, x double")
    counts = df.where("x IS NOT NULL").groupBy("x").count()
    got = {r["x"]: r["upto"] for r in ranges.running(counts, "x", "count", "upto", ranges=7).collect()}
    values = [x for _, x in rows if x is not None]
    assert got == {x: sum(v <= x for v in values) for x in set(values)}
    p = {r["g"]: (r["p0"], r["p1"], r["p2"]) for r in ranges.percentiles(df, "g", "x", [0.0, 0.3, 0.95]).collect()}
    for g in (0, 1, 2, None):
        assert p[g] == pytest.approx(np.percentile([x for h, x in rows if h == g and x is not None], [0, 30, 95]))
    assert ranges.numbered(spark.createDataFrame([], "x int"), "x", "k").count() == 0


def test_fronts(spark, monkeypatch):
    from seqloom.operators import evaluation

    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    rows = [(i, *map(float, r)) for i, r in enumerate(x)] + [(900, None, 0.0, 0.0), (901, float("nan"), 50.0, 50.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double").repartition(5)
    want = {i for i in range(300) if not ((x <= x[i]).all(axis=1) & (x < x[i]).any(axis=1)).any()} | {900, 901}
    for most in (20_000, 3):
        monkeypatch.setattr(evaluation, "FRONT_ROWS", most)
        assert {r["id"] for r in evaluation.pareto(df, "id", ["a", "b", "c"]).collect() if r["on_front"]} == want


def test_nominal_features(spark):
    from seqloom.operators import statistics

    rows = [(f"a{i % 3}", f"b{i % 3}", f"c{(i // 3) % 4}", float(i % 3 * 10 + i % 7), float(i // 3)) for i in range(240)]
    df = spark.createDataFrame(rows, "a string, b string, c string, x double, y double")
    assert statistics.drop_associated(df, ["a", "b", "c"]) == ["b", "c"]
    assert statistics.drop_explained(df, ["a", "c"], ["x"]) == ["c"]
    # a difference whose tail is zero in doubles, and a column of one group
    far = spark.createDataFrame([("u" if i % 2 else "v", "w", float(i % 2 * 1000 + i)) for i in range(4000)], "a string, b string, x double")
    assert statistics.drop_explained(far, ["a", "b"], ["x"]) == ["b"]


def test_internal_quality_without_parts(spark):
    from seqloom.operators import evaluation

    points = [(0, 0.0, "p"), (1, 1.0, "p"), (2, 10.0, "q"), (3, 11.0, "q")]
    edges = spark.createDataFrame([(i, j, abs(x - y)) for i, x, _ in points for j, y, _ in points if i != j], "id1 int, id2 int, d double")
    labels = spark.createDataFrame([(i, k) for i, _, k in points], "id int, label string")
    r = evaluation.internal_quality(edges, labels, hopkins=[0.5, 0.7]).first()
    assert r["silhouette_avg"] == pytest.approx((2 * (1 - 1 / 10.5) + 2 * (1 - 1 / 9.5)) / 4) and r["entropy"] == pytest.approx(1.0)
    assert (r["calinski_harabasz"], r["matching"]) == (-1.0, -1.0) and r["hopkins_avg"] == pytest.approx(0.6) and r["hopkins_std"] == pytest.approx(0.1)


def test_soft_labels_and_ratios(spark):
    from seqloom.operators import weak

    soft = weak.soft_label_rows(spark.createDataFrame([(1, 0.25), (2, 1.0)], "id int, p double"), "p").collect()
    assert sorted((r["id"], r["label"], r["weight"]) for r in soft) == [(1, 0, 0.75), (1, 1, 0.25), (2, 1, 1.0)]
    sets = spark.createDataFrame([(["x"], ["x", "y"]), (["x"], ["z"]), ([], ["z"]), (None, ["z"])], "a array<string>, b array<string>")
    lf = weak.ratio_lf("recall", "a", "b", 0.4, 0.6)
    assert [r[0] for r in sets.select(lf.column()).collect()] == [1, -1, 0, 0]
    scored = spark.createDataFrame([("Good good, bad!",), ("none",), (None,)], "t string").select(weak.lexicon_score(F.col("t"), {"good": 1.0, "bad": -1.0}))
    assert [round(r[0], 6) for r in scored.collect()] == [0.333333, 0.0, 0.0]


# --- cubes after mining -----------------------------------------------------------------------------------------------


def random_cubes(seed, n=25):
    rng = np.random.default_rng(seed)
    some = lambda m, k: sorted(rng.choice(m, rng.integers(1, k + 1), replace=False).tolist())
    return [(i, some(3, 3), some(3, 3), some(7, 6)) for i in range(n)]


def cells_of(c):
    return set(itertools.product(*c[1:]))


@pytest.mark.parametrize("share", [0.5, 0.75, 1.0])
def test_cubes_not_covered(spark, share):
    from seqloom.operators import triclusters

    cubes = random_cubes(1)
    kept = []
    for c in sorted(cubes, key=lambda c: (-len(cells_of(c)), c[0])):
        if not any(len(cells_of(c) & cells_of(k)) >= share * len(cells_of(c)) for k in kept):
            kept.append(c)
    df = spark.createDataFrame(cubes, "cube long, t array<int>, s array<int>, g array<int>")
    got = {r["cube"] for r in triclusters.drop_covered(df, share).collect()}
    assert got == {c[0] for c in kept} and len(got) < len(cubes)


def test_cubes_merged(spark):
    from seqloom.operators import triclusters

    left, share, merges = {c[0]: c for c in random_cubes(2, 14)}, 0.7, 0
    start = list(left.values())
    while True:
        fits = {}
        for a, b in itertools.combinations(sorted(left), 2):
            box = [sorted({*x, *y}) for x, y in zip(left[a][1:], left[b][1:])]
            filled = len(cells_of(left[a]) | cells_of(left[b])) / math.prod(map(len, box))
            if filled >= share:
                fits[a, b] = filled, box
        if not fits:
            break
        wish = {}
        for (a, b), (f, _) in fits.items():
            for who, partner in ((a, b), (b, a)):
                wish[who] = max(wish.get(who, (0.0, -math.inf)), (f, -partner))
        for (a, b), (_, box) in fits.items():
            if wish[a][1] == -b and wish[b][1] == -a:
                del left[b]
                left[a] = (a, *box)
                merges += 1
    df = spark.createDataFrame(start, "cube long, t array<int>, s array<int>, g array<int>")
    got = {(r["cube"], *map(tuple, (r["t"], r["s"], r["g"]))) for r in triclusters.merge_filled(df, share).collect()}
    assert got == {(c[0], *map(tuple, c[1:])) for c in left.values()} and merges
    with pytest.raises(ValueError):
        triclusters.merge_filled(df, 0.2)


def gapped_cube(seed):
    rng = np.random.default_rng(seed)
    return {(t, s, g): float(rng.integers(1, 5)) for t in range(3) for s in range(4) for g in range(12) if rng.random() < 0.75}


@pytest.mark.parametrize("share, w, rounds", [(0.5, 0.0, 1), (0.4, 1.0, 1), (0.5, 1.0, 2), (0.0, 1.0, 1)])
def test_biclusters_with_missing_values(spark, share, w, rounds):
    """Against a loop over all entities and members; a zero is missing too."""
    val = gapped_cube(5)
    found = [(0, [0, 1, 2], [0, 1]), (0, [1, 3], [4]), (1, [0, 2, 3], [2, 5, 7]), (2, [0], [1])]
    want = set()
    for t, s, g in found:
        inside = set(g)
        for _ in range(rounds):
            more = set()
            for e in set(range(12)) - inside:
                own = [i for i in s if (t, i, e) in val]
                if own and len(s) - len(own) <= share * len(s) and any(all((t, i, m) in val and abs(val[t, i, e] - val[t, i, m]) <= w for i in own) for m in inside):
                    more.add(e)
            inside |= more
        if len(inside) >= 2:
            want.add((t, tuple(s), tuple(sorted(inside))))
    cube = spark.createDataFrame([(*k, val.get(k, 0.0)) for k in itertools.product(range(3), range(4), range(12))], "t int, s int, g long, val double")
    got = TR.with_missing(cube, spark.createDataFrame(found, "t int, s array<int>, g array<long>"), share, w, 2, rounds).collect()
    assert {(r["t"], tuple(r["s"]), tuple(r["g"])) for r in got} == want and len(got) == len(want)
    assert any(len(g) > len(f[2]) for f in found for t, s, g in want if (t, list(s)) == (f[0], f[1]))


def test_even_triclusters_inside_uneven_ones(spark):
    """The whole cube deviates along its entities; the part over later times and fewer entities doesn't."""
    cube = {0: ([1, 2, 4], [2, 4, 8], [50, 100, 200]), 1: ([2, 4, 8], [2, 4, 8], [60, 120, 240]), 2: ([3, 6, 12], [3, 6, 12], [1, 9, 2])}
    df = spark.createDataFrame([(t, s, g, float(v)) for t, gs in cube.items() for g, vs in enumerate(gs) for s, v in enumerate(vs)], "t int, s int, g long, val double")
    whole = {(tuple(r["t"]), tuple(r["g"])) for r in TR.triclusters(df, 0.01, 2, 2, 2).collect()}
    calm = {(tuple(r["t"]), tuple(r["g"])) for r in TR.triclusters(df, 0.01, 2, 2, 2, most=(None, None, 1.0)).collect()}
    assert whole == {((0, 1), (0, 1, 2)), ((0, 1, 2), (0, 1))} and calm == {((0, 1, 2), (0, 1))}


def test_report_round_trip(spark, tmp_path):
    from seqloom.sources import reports

    cube = spark.createDataFrame([(3, 0, 10, 1.25), (3, 2, 10, -7.5), (4, 0, 10, 1234567.0), (3, 0, 2, 0.004)], "t int, s int, g long, val double")
    cubes = spark.createDataFrame([(12, [3, 4], [0, 2], [2, 10]), (7, [3], [2], [10])], "cube long, t array<int>, s array<int>, g array<long>")
    reports.write_report(cube, cubes, str(tmp_path / "r"))
    got = {tuple(r) for r in reports.read_report(spark, str(tmp_path / "r")).collect()}
    want = {(12, t, s, g, 0.0) for t in (3, 4) for s in (0, 2) for g in (2, 10)} - {(12, 3, 0, 10, 0.0), (12, 3, 2, 10, 0.0), (12, 4, 0, 10, 0.0)}
    assert got == want | {(12, 3, 0, 10, 1.25), (12, 3, 2, 10, -7.5), (12, 4, 0, 10, 1234567.0), (7, 3, 2, 10, -7.5)}
    assert list(reports.parse("text before the first cluster")) == []


def test_report_in_blocks_joins_no_cells(spark, tmp_path, monkeypatch):
    """Against the values themselves: several tasks, pieces of values and batches, compressed; nulls, halves and ids that no time has."""
    from seqloom.sources import reports

    rng = np.random.default_rng(3)
    val = {(t, s, g): round(float(rng.normal(0, 2000)), 3) for t in range(3) for s in range(3) for g in range(40) if rng.random() < 0.8}
    val[0, 0, 0], val[0, 1, 0] = 0.125, -1e9
    cubes = [(100 + k, sorted(rng.choice(4, 2, replace=False).tolist()), sorted(rng.choice(4, 1 + k % 3, replace=False).tolist()), sorted(rng.choice(45, 9, replace=False).tolist())) for k in range(30)]
    cube = spark.createDataFrame([(*k, v) for k, v in val.items()] + [(0, 0, 44, None)], "t int, s int, g long, val double")
    for name, n in (("TEXT", 900), ("ENTITIES", 7), ("LINES", 60), ("CELLS", 50)):
        monkeypatch.setattr(reports, name, n)
    monkeypatch.setattr(TR, "cells", lambda *x: pytest.fail("cells were listed"))
    reports.write_report(cube, spark.createDataFrame([*cubes, (1, [], [0], [1])], "cube long, t array<int>, s array<int>, g array<long>"), str(tmp_path / "r"), "gzip")
    got = [tuple(r) for r in reports.read_report(spark, str(tmp_path / "r")).collect()]
    shown = cube.where("val IS NOT NULL").withColumn("val", F.round("val", 2)).collect()
    known = {(r["t"], r["s"], r["g"]): r["val"] for r in shown}
    want = [(k, *c, known.get(c, 0.0)) for k, *dims in cubes for c in itertools.product(*dims)]
    assert sorted(got) == sorted(want) and all(p.name.endswith(".gz") for p in (tmp_path / "r").glob("part-*"))


def test_reports_are_read_the_same_at_once_and_by_lines():
    from seqloom.sources import reports

    whole = "7: \n===\n|T|x|S|x|G|: 2x2x2\n    Time: 3\n   S-0  S-2\n  G-10\t  1.25   -7.50  \n  G-2\t 0.00  1e3 \n\n    Time: 4\n S-0 S-2\n G-10\t 1 2\n G-2\t NaN -3\n\n\n"
    ragged = whole.replace("  1e3 ", "")
    no_names = whole.replace("\n S-0 S-2", "")
    for text in (whole, ragged, no_names, "no cluster", "5:\n", "5: Time: 3\n", whole + "\nnote: G-5\n"):
        got = [tuple(r) for c in reports.cells(text) for r in zip(*(x.tolist() for x in c))]
        assert sorted(map(repr, got)) == sorted(map(repr, reports.parse(text))), text
    assert len(list(reports.parse(whole))) == 8 and len(list(reports.parse(ragged))) == 7 and len(list(reports.parse(no_names))) == 8


def test_half_up_rounds_as_spark_does(spark):
    x = [0.5e-6, 1.5e-6, 2.5e-6, -0.4e-6, 0.1234565, 1.0000005, 123456.7890125, 1e9 + 0.1234565, 3e12 + 0.3, 1e17, -2.0000005, math.inf]
    rng = np.random.default_rng(1)
    x += (rng.integers(0, 10**9, 500) / 1e7).tolist() + rng.normal(0, 50, 500).tolist()
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6) + F.lit(0.0)).collect()]
    assert P.half_up(np.array(x)).tolist() == want


def test_measured_pairs_are_made_without_joining_rows(spark, monkeypatch):
    """Against a loop: several blocks and pieces, nulls, equal values, sequences of one value and of different lengths."""
    rng = np.random.default_rng(2)
    seqs = {int(k): sorted(np.round(rng.uniform(0, 9, int(n)), 2).tolist()) for k, n in zip(rng.permutation(60) * 7, rng.integers(1, 9, 50))}
    seqs[5], seqs[6], seqs[8] = [0.1] * 7, [0.1] * 3, [4.0, 4.0 + 1e-9]
    df = spark.createDataFrame([(k, v, None if k % 5 == 0 else v[0], v[-1]) for k, v in seqs.items()], "id long, v array<double>, p double, q double")
    monkeypatch.setattr(P, "AT_ONCE", 37)
    monkeypatch.setattr(P, "pairs", lambda *x: pytest.fail("rows were joined"))
    got = {(r["id1"], r["id2"]): (r["r2"], r["angle"]) for r in P.measured(df.select("id", "v"), "id", A.foretold, ["r2", "angle"]).collect()}
    assert sorted(got) == [(a, b) for a in sorted(seqs) for b in sorted(seqs) if a < b]
    for (a, b), (r2, angle) in got.items():
        x, y = (np.array(z[: min(len(seqs[a]), len(seqs[b]))]) for z in (seqs[a], seqs[b]))
        assert (r2 is None) == (len(set(y)) == 1) and (angle is None) == (len(set(x)) == 1)
        assert r2 is None or r2 == pytest.approx(1 - ((y - x) ** 2).sum() / ((y - y.mean()) ** 2).sum(), rel=1e-6, abs=1e-6)
        assert angle is None or angle == pytest.approx(np.degrees(np.arctan(abs(np.cov(x, y, bias=True)[0, 1] / x.var()))), abs=2e-6)
    rows = P.measured_differences(df, "id", ["p", "q"]).collect()
    assert len(rows) == len(got) and {(r["id1"], r["id2"]) for r in rows} == set(got)
    for r in rows:
        (a, b), hole = (seqs[r["id1"]], seqs[r["id2"]]), r["id1"] % 5 == 0 or r["id2"] % 5 == 0
        assert r["q_diff"] == round(abs(a[-1] - b[-1]), 6) and (r["p_diff"] is None if hole else r["p_diff"] == round(abs(a[0] - b[0]), 6))


def test_settings():
    from seqloom import settings as SE

    s = SE.parse("# a run\nTOP_FOLDER: /data/run1/  # here\nmin_app: 3\nINCLUDE_STATIC: true\nREF_FEATURE: 'score'\n")
    assert (s.min_app, s.include_static, s.ref_feature, s.n_clust, s.folder("tricluster_matrices")) == (3, True, "score", 2, "/data/run1/matrices/trics")
    for wrong in ("top_folder: a\nunknown: 1", "top_folder"):
        with pytest.raises(ValueError):
            SE.parse(wrong)


def test_clusterings_of_distances(spark):
    """Points on a line in two far groups."""
    from seqloom.operators import clustering
    from seqloom.operators import pairs as PA

    at = {i: (i if i < 6 else 100 + i) for i in range(12)}
    edges = spark.createDataFrame([(a, b, float(abs(at[a] - at[b]))) for a in at for b in at if a < b], "id1 int, id2 int, d double")
    parts = lambda rows: {frozenset(r["id"] for r in rows if r["cluster"] == c) for c in {r["cluster"] for r in rows}}
    got = clustering.matrix_kmeans(edges, 2).collect()
    assert sorted(r["id"] for r in got) == list(range(12)) and parts(got) == {frozenset(range(6)), frozenset(range(6, 12))}
    best = clustering.best_neighbours(PA.symmetric(edges, "d"), 2, [3, 4])
    assert sorted(n for n, _ in best) == [3, 4] and best[0][1] >= best[1][1]
    grid = clustering.workflows({"line": edges}, {"km": clustering.matrix_kmeans}, [2, 3]).collect()
    assert len(grid) == 24 and {(r["measure"], r["method"], r["k"]) for r in grid} == {("line", "km", 2), ("line", "km", 3)}


def test_curves_of_clusters(spark):
    """The fit of added-up points is that of all points."""
    from seqloom.operators import models as M

    rng = np.random.default_rng(0)
    t = np.repeat(np.arange(0, 1500, 100.0), 4)
    v = 46 / (1 + np.exp(0.005 * (t - 700))) + rng.normal(0, 1, len(t))
    rows = [("x", float(a), float(b)) for a, b in zip(t, v)] + [("y", None, 1.0)]
    r = M.cluster_curves(spark.createDataFrame(rows, "c string, t double, v double"), "c", "t", "v", 5).collect()
    assert len(r) == 1 and r[0]["n"] == len(t) and r[0]["x"] == pytest.approx([0, 350, 700, 1050, 1400])
    x = fits.padded([t], [v])
    p, sse = fits.fit_sigmoid(*x)
    assert [r[0][n] for n in "bkac"] == pytest.approx(p[0], rel=1e-3, abs=1e-3)
    assert [r[0][f"se_{n}"] for n in "bkac"] == pytest.approx(fits.band(*x, p, sse)[0], rel=1e-2)
    assert r[0]["middle"] == pytest.approx(fits.sigmoid(np.array([r[0]["x"]]), p)[0][0], rel=1e-2)


def test_one_against_rest(spark):
    """Only the first feature tells the classes apart; the larger class is thinned."""
    from seqloom.operators import models as M

    rows = [(i, "a" if i % 4 == 0 else "b", float(i % 4 == 0) + (i % 7) / 100, float(i % 5)) for i in range(400)]
    got = {(r["class"], r["feature"]): r for r in M.one_against_rest(spark.createDataFrame(rows, "id long, y string, u double, w double"), "id", ["u", "w"], "y", 2).collect()}
    assert set(got) == {(c, f) for c in "ab" for f in "uw"}
    assert all(r["accuracy"] > 0.95 for r in got.values()) and got["a", "u"]["loss"] > 0.3 and abs(got["a", "w"]["loss"]) < 0.05


def test_overlaps_over_several_blocks(spark, monkeypatch):
    from seqloom.operators import overlaps as O

    monkeypatch.setattr(O, "IN_BLOCK", 5)
    monkeypatch.setattr(O, "AT_ONCE", 3)
    cubes = random_cubes(4, 23)
    df = spark.createDataFrame(cubes, "cube long, t array<int>, s array<int>, g array<int>")
    got = {tuple(r) for r in O.overlaps(df, "cube", ["t", "s", "g"], lambda na, nb, common, a, b: (common[0] > 0) & (common[2] >= 0.5 * na[2])).collect()}
    want = {(a[0], b[0], *(len({*x} & {*y}) for x, y in zip(a[1:], b[1:]))) for a, b in itertools.permutations(cubes, 2)}
    want = {w for w in want if w[2] > 0 and w[4] >= 0.5 * len(dict((c[0], c[3]) for c in cubes)[w[0]])}
    assert got == want and len(want) > 20
    assert O.overlaps(df.limit(0), "cube", ["t", "s", "g"], lambda *x: True).count() == 0


def test_cover_lists_no_cells(spark, monkeypatch):
    from seqloom.operators import triclusters

    # two cubes of two million cells each: what they share comes from sets, of which cells would be listed by the million
    wide = list(range(2_000))
    cubes = [(1, [1, 2], list(range(500)), wide), (2, [1, 2], list(range(499)), wide), (3, [2], [0], [5_000])]
    monkeypatch.setattr(triclusters, "cells", lambda cubes: pytest.fail("cells were listed"))
    df = spark.createDataFrame(cubes, "cube long, t array<int>, s array<int>, g array<int>")
    assert {r["cube"] for r in triclusters.drop_covered(df, 0.75).collect()} == {1, 3}


def test_merging_compares_cubes_that_stay_once(spark, monkeypatch):
    from seqloom.operators import triclusters

    compared = []
    monkeypatch.setattr(triclusters, "overlaps", lambda df, *x, f=triclusters.overlaps: compared.append({r["cube"]: len(r["fresh"]) for r in df.collect()}) or f(df, *x))
    cubes = [(k, [1], [k], list(range(100 * k, 100 * k + 10))) for k in range(1, 6)] + [(6, [1], [1], list(range(100, 109)))]
    df = spark.createDataFrame(cubes, "cube long, t array<int>, s array<int>, g array<int>")
    assert triclusters.merge_filled(df, 0.85).count() == 5
    # of all six first, then of the one that two became
    assert [sum(c.values()) for c in compared] == [6, 1]


def test_patterns_copy_no_names(spark, monkeypatch):
    from seqloom.operators import triclusters as TC

    cube = spark.createDataFrame([(1, s, g, float(g % 3)) for s in (0, 1) for g in range(40)], "t int, s int, g long, val double")
    rows = [([1], [0, 1], list(range(30))), ([1], [1], list(range(10, 40))), ([1], [0, 1], list(range(30)))]
    clusters = spark.createDataFrame(rows, "t array<int>, s array<int>, g array<long>")
    got = {(r["cluster"], r["s"]): round(r["val"], 6) for r in TC.representative_patterns(cube, clusters, nominal=[0], over_time=False).collect()}
    name = lambda r: "/".join(",".join(map(str, c)) for c in r)
    want = {}
    for r in rows:
        for s in r[1]:
            v = [float(g % 3) for g in r[2]]
            want[name(r), s] = min(v, key=lambda x: (-v.count(x), x)) if s == 0 else round(sum(x for x in v if x) / sum(x != 0 for x in v), 6)
    assert got == want
    # what is made for cells goes by numbers
    names, found = TC._patterns(cube, clusters)
    assert found.columns == ["number", "t", "s", "val"] and names.count() == 2


def test_similarity_lists_no_names(spark, monkeypatch):
    """Against a loop; a pattern's name comes once for a block of entities, missing values and zeros count as they did."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    rng = np.random.default_rng(8)
    val = {(t, s, g): float(rng.integers(0, 4)) for t in range(3) for s in range(3) for g in range(30) if rng.random() < 0.8}
    pattern = {("a", 0, 0): 1.0, ("a", 0, 2): 2.5, ("a", 1, 2): 3.0, ("b", 2, 1): 0.0, ("c", 1, 0): 2.0, ("d", 7, 0): 1.0}
    want = {}
    for name in "abcd":
        for g in range(30):
            both = [(val[t, s, g], p) for (n, t, s), p in pattern.items() if n == name and (t, s, g) in val]
            if both:
                norms = math.sqrt(sum(v * v for v, _ in both)) * math.sqrt(sum(p * p for _, p in both))
                want[g, name] = (round(math.sqrt(sum((v - p) ** 2 for v, p in both)), 9), round(sum(v * p for v, p in both) / norms, 9) if norms else None)
    sent = []
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda self, *x, f=PandasCogroupedOps.applyInArrow: sent.append(f(self, *x)) or sent[-1])
    monkeypatch.setattr(TR, "ENTITIES", 7)
    monkeypatch.setattr(TR, "LEAST", 40)
    cube = spark.createDataFrame([(*k, v) for k, v in val.items()], "t int, s int, g long, val double")
    got = TR.pattern_similarity(cube, spark.createDataFrame([(*k, v) for k, v in pattern.items()], "cluster string, t int, s int, val double")).collect()
    assert {(r["g"], r["cluster"]): (round(r["distance"], 9), None if r["cosine"] is None else round(r["cosine"], 9)) for r in got} == want and len(got) == len(want)
    assert sent and sent[0].count() <= 3 * 5 < len(want)


def test_biclusters_compare_no_sets(spark, monkeypatch):
    """Runs dealt to several tasks, entities with equal values counted as one: each set once, and none compared with another."""
    from seqloom.operators import runs as RU

    rng = np.random.default_rng(4)
    g = {k: sorted(rng.choice(40, 14, replace=False).tolist()) for k in itertools.product((0, 1), (0, 1), (1, 2), range(6)) if k[1] < k[2]}
    rows = [(t, i, j, 1.0, sorted(e * 10 + c for e in m for c in range(3))) for (t, i, j, _), m in g.items()]
    edges = spark.createDataFrame(rows, "t int, s1 int, s2 int, low double, g array<long>")
    monkeypatch.setattr(RU, "STARTS", 2)
    monkeypatch.setattr(TR, "maximal", lambda *x: pytest.fail("sets were compared"))
    got = [(r["t"], tuple(r["s"]), tuple(r["g"])) for r in TR.biclusters(edges, 2, 6).collect()]
    pairs = [(t, (i, j), frozenset(m)) for t, i, j, _, m in rows]
    found = set(pairs)
    for t in (0, 1):
        a, b = [[m for u, p, m in pairs if (u, p) == (t, q)] for q in ((0, 1), (1, 2))]
        c = [m for u, p, m in pairs if (u, p) == (t, (0, 2))]
        found |= {(t, (0, 1, 2), x & y & z) for x in a for y in b for z in c if len(x & y & z) >= 6}
    want = {f for f in found if not any(f[0] == o[0] and {*f[1]} <= {*o[1]} and f[2] <= o[2] and f != o for o in found)}
    assert {(t, s, frozenset(m)) for t, s, m in got} == want and len(got) == len(want) and sum(len(s) == 3 for _, s, _ in got) > 2


def test_triclusters_over_overlapping_runs(spark, monkeypatch):
    """Every choice of runs at neighbouring times, in a cube so dense that runs overlap; no sets are compared."""
    from seqloom.operators import runs as RU

    rng = np.random.default_rng(11)
    cube = spark.createDataFrame([(t, s, g, float(v)) for t in (1, 2, 3, 5) for g in range(40) for s, v in enumerate(np.round(rng.uniform(1, 1.6, 3), 3))], "t int, s int, g long, val double")
    runs = {}
    for r in TR.ratio_edges(cube, 0.2, 3).collect():
        runs.setdefault((r["t"], r["s1"], r["s2"]), set()).add(frozenset(r["g"]))
    found = set()
    for t in [(1, 2), (2, 3), (1, 2, 3)]:
        for s in [c for n in (2, 3) for c in itertools.combinations(range(3), n)]:
            sets = {frozenset(range(40))}
            for k in ((u, *p) for u in t for p in itertools.combinations(s, 2)):
                sets = {a & b for a in sets for b in runs.get(k, ()) if len(a & b) >= 3}
            found |= {(frozenset(t), frozenset(s), g) for g in sets}
    want = {f for f in found if not any(f != o and all(x <= y for x, y in zip(f, o)) for o in found)}
    monkeypatch.setattr(RU, "STARTS", 3)
    monkeypatch.setattr(TR, "maximal", lambda *x: pytest.fail("sets were compared"))
    got = [tuple(frozenset(r[c]) for c in ("t", "s", "g")) for r in TR.triclusters(cube, 0.2, 2, 2, 3).collect()]
    assert set(got) == want and len(got) == len(want) and any(len(t) == 3 for t, _, _ in want) and any(len(s) == 3 for _, s, _ in want)


@pytest.mark.parametrize("missing", [0.0, 0.5])
def test_triclusters_whose_values_cannot_be_uneven(spark, monkeypatch, missing):
    """Every choice of one bicluster for each time; where the range of the values settles the bound no chains are listed."""
    from seqloom.operators import runs as RU

    rng = np.random.default_rng(4)
    val = np.round(rng.uniform(1, 1.6, (5, 3, 24)), 2)
    val[rng.random(val.shape) < 0.15] = np.nan
    cube = spark.createDataFrame([(t, s, g, None if np.isnan(v) else float(v)) for (i, s, g), v in np.ndenumerate(val) for t in [(1, 2, 3, 4, 6)[i]]], "t int, s int, g long, val double")
    at = TR.biclusters(TR.ratio_edges(cube, 0.15, 3), 2, 3)
    at = TR.with_missing(cube, at, missing, 0.15, 3) if missing else at
    by_time = {}
    for r in at.collect():
        by_time.setdefault(r["t"], set()).add((frozenset(r["s"]), frozenset(r["g"])))
    found = set()
    for t in (c for n in (2, 3, 4) for k in range(4) for c in [tuple(range(1, 5))[k : k + n]] if len(c) == n):
        sets = by_time[t[0]]
        for u in t[1:]:
            sets = {(s, g) for a, x in sets for b, y in by_time[u] for s, g in [(a & b, x & y)] if len(s) >= 2 and len(g) >= 3}
        found |= {(frozenset(t), *x) for x in sets}
    want = {f for f in found if not any(f != o and all(x <= y for x, y in zip(f, o)) for o in found)}
    monkeypatch.setattr(RU, "STARTS", 40)
    monkeypatch.setattr(RU, "HELD", 3)
    monkeypatch.setattr(TR, "even", lambda *x: pytest.fail("chains were listed"))
    got = [tuple(frozenset(r[c]) for c in ("t", "s", "g")) for r in TR.triclusters(cube, 0.15, 2, 2, 3, missing, (1.0, None, 0.81)).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 10 and len({s for _, s, _ in want}) > 2 and len({len(t) for t, _, _ in want}) > 1


def test_values_that_may_be_uneven_are_not_taken_for_even(spark):
    df = spark.createDataFrame([(0, 0, 0, 3.0), (0, 0, 1, 5.0), (0, 1, 0, -1.0), (1, 0, 0, None)], "t int, s int, g long, val double")
    for most, want in [((None, None, None), True), ((None, None, 2.51), True), ((None, None, 2.5), False), ((None, 2.1, None), False), ((None, 2.51, None), True), ((2.51, None, 2.4), False), ((None, None, -1.0), False)]:
        assert TR.always_even(df, most) == want, most
    odd = df.union(spark.createDataFrame([(2, 0, 0, math.nan)], df.schema))
    assert not TR.always_even(odd, (None, None, 1e9)) and TR.always_even(df.limit(0), (None, None, 1.0))


def test_missing_values_meet_near_ones_only():
    """Against all pairs: columns of many equal values, gaps of just the width, and only a few members in reach at a time."""
    rng = np.random.default_rng(6)
    for w in (0.0, 0.3, 2.0):
        points, others = (np.round(rng.uniform(0, 150, (n, 3)), 1) for n in (300, 400))
        points[:, 2], others[:, 2] = rng.integers(0, 3, 300), rng.integers(0, 3, 400)
        points[:20] = others[:20]
        want = (np.abs(points[:, None] - others[None]) <= w).all(2).any(1)
        assert (TR._near(points, others, w) == want).all() and want.any() and not want.all()
        assert (TR._near(points[:, 2:], others[:, 2:], w)).all() and not TR._near(points, others[:0], w).any()


def test_deviations_list_no_cells(spark, monkeypatch):
    """Against a loop, with missing cells, nulls and times and features without any value."""
    rng = np.random.default_rng(9)
    val = {(t, s, g): round(float(rng.uniform(0, 9)), 3) for t in range(3) for s in range(3) for g in range(20) if rng.random() < 0.7}
    cubes = [(k, sorted(rng.choice(4, 2, replace=False).tolist()), sorted(rng.choice(4, 2, replace=False).tolist()), sorted(rng.choice(22, 6, replace=False).tolist())) for k in range(12)]
    monkeypatch.setattr(TR, "cell_values", lambda *x: pytest.fail("cells were joined"))
    monkeypatch.setattr(TR, "MEMBERS", 10)
    cube = spark.createDataFrame([(*k, v) for k, v in val.items()] + [(0, 0, 21, None)], "t int, s int, g long, val double")
    got = {r["cube"]: tuple(round(r[c], 6) for c in ("dev_t", "dev_s", "dev_g")) for r in TR.deviations(cube, spark.createDataFrame(cubes, "cube long, t array<int>, s array<int>, g array<long>")).collect()}
    want, half_up = {}, lambda x: math.floor(round(x * 1000) / 10 + 0.5) / 100
    for k, *dims in cubes:
        v = np.array([val.get(c, 0.0) for c in itertools.product(*dims)]).reshape([len(d) for d in dims])
        near = np.vectorize(half_up)(v)
        want[k] = tuple(round(float(np.abs(v - near.mean(a, keepdims=True)).mean()), 6) for a in range(3))
    assert got == want


@pytest.fixture(scope="module")
def few_kinds(spark):
    """150 rows of few different values, one of them with nearly half of the rows, and a null."""
    rng = np.random.default_rng(1)
    ids = rng.choice(10**9, 150, replace=False).tolist()
    return spark.createDataFrame([(i, 1.0 if k < 70 else float(rng.integers(0, 6)), None if k == 80 else float(rng.integers(0, 2))) for k, i in enumerate(ids)], "id long, x double, y double").persist()


def test_differences_once_for_equal_rows(spark, few_kinds, monkeypatch):
    """As many pairs and held ones as all pairs give, with a value's rows dealt over pieces and blocks."""
    monkeypatch.setattr(P, "IN_BLOCK", 30)
    monkeypatch.setattr(P, "TOGETHER", 8)
    found = P.counted_differences(few_kinds, "id", ["x", "y"], 5)
    got = found.groupBy("x_diff", "y_diff").agg(F.sum("n"), F.sum("held"))
    held = (F.pmod(F.xxhash64("id1", "id2"), F.lit(5)) == 0).cast("long")
    want = P.differences(P.pairs(few_kinds, "id"), "id", ["x", "y"]).groupBy("x_diff", "y_diff").agg(F.count("*"), F.sum(held))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and found.count() < 150 * 149 / 2 / 10


def test_loss_of_a_feature_is_the_mean_of_all_deals(spark):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    from seqloom.operators import models as M

    rng = np.random.default_rng(5)
    v = rng.integers(0, 8, (60, 3)).astype(float)
    rows = [(*map(float, x), int(x[0] + x[1] > 7), int(n)) for x, n in zip(v, rng.integers(1, 4, 60))]
    x = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, c double, label int, n int"))
    model = DecisionTreeClassifier(maxDepth=3, seed=1, weightCol="n").fit(x)
    got = M.tree_losses(model, x, ["a", "b", "c"], "label", "n")
    n = np.array([r[4] for r in rows], dtype=float)
    many = np.repeat(np.arange(60), n.astype(int))
    whole, label = v[many], np.array([r[3] for r in rows])[many]
    dealt = [np.concatenate([np.column_stack([np.full(len(whole), w) if j == k else whole[:, j] for j in range(3)]) for w in whole[:, k]]) for k in range(3)]
    told = lambda z: np.array([r[0] for r in model.transform(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(z.tolist(), "a double, b double, c double"))).select("prediction").collect()])
    base = (told(whole) == label).mean()
    assert got == pytest.approx([base - (told(z) == np.tile(label, len(whole))).mean() for z in dealt]) and max(got) > 0.1


def test_models_of_pairs_count_equal_suppliers(spark, sf_dir, tmp_path):
    """Three copies of lineitem under other suppliers: differences once for the copies, and an SVM as good as one of all pairs."""
    from pyspark.ml.classification import LinearSVC

    from seqloom.plans import mining_queries as MQ

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    copies = lines.withColumn("l_suppkey", F.explode(F.array(*[F.col("l_suppkey") + 1_000 * k for k in range(3)])))
    copies.write.parquet(str(tmp_path / "lineitem.parquet"))
    x = MQ.labelled_pairs(spark, str(tmp_path)).persist()
    n = copies.select("l_suppkey").distinct().count()
    assert x.agg(F.sum("n")).first()[0] == n * (n - 1) // 2 and x.count() < n * (n - 1) / 10
    whole = LinearSVC(maxIter=20, regParam=0.01).fit(x.withColumn("one", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))))
    got = [r["weight"] for r in MQ.svm_distance_weights(spark, str(tmp_path)).collect()]
    rows = x.select(*MQ.DIFFS, "label", "n").toPandas().to_numpy(float)
    lost = lambda w: (np.maximum(0, 1 - (2 * rows[:, -2] - 1) * (rows[:, :-2] @ np.array(w[:-1]) + w[-1])) * rows[:, -1]).sum() / rows[:, -1].sum()
    assert lost(got) == pytest.approx(lost([*whole.coefficients, whole.intercept]), abs=0.02)


def test_pairs_of_equal_rows_are_measured_once(spark, monkeypatch):
    """All pairs, whatever blocks and pieces rows are in, and next to one another those of the same two kinds of rows."""
    monkeypatch.setattr(P, "IN_BLOCK", 1_000)
    df = spark.createDataFrame([(i * 7 % 101, float(i % 4), None if i % 4 == 3 else 0.25 * (i % 4)) for i in range(100)], "id long, x double, y double")
    rows = P.measured_differences(df, "id", ["x", "y"]).collect()
    value = {r["id"]: (r["x"], r["y"]) for r in df.collect()}
    want = {(a, b): tuple(None if p is None or q is None else abs(p - q) for p, q in zip(value[a], value[b])) for a, b in itertools.combinations(sorted(value), 2)}
    assert len(rows) == len(want) and {(r["id1"], r["id2"]): (r["x_diff"], r["y_diff"]) for r in rows} == want
    # ten ways to choose two of four values, some of them with a's below b's and the other way round
    assert len(list(itertools.groupby(rows, lambda r: (value[r["id1"]], value[r["id2"]])))) <= 16
    monkeypatch.setattr(P, "IN_BLOCK", 15)
    monkeypatch.setattr(P, "TOGETHER", 4)
    again = P.measured_differences(df, "id", ["x", "y"]).collect()
    assert len(again) == len(want) and {(r["id1"], r["id2"]): (r["x_diff"], r["y_diff"]) for r in again} == want


def test_entities_of_the_same_runs_are_mined_as_one(spark):
    """Copies of every entity under other keys: rows hold one of each kind, and biclusters hold all copies."""
    from seqloom.operators.overlaps import condensed

    rng = np.random.default_rng(3)
    cells = [(0, s, g, float(v)) for g in range(40) for s, v in enumerate(np.round(rng.uniform(1, 1.6, 3), 3))]
    cube = lambda copies: spark.createDataFrame([(t, s, g + 100 * k, v) for t, s, g, v in cells for k in range(copies)], "t int, s int, g long, val double")
    runs = TR.ratio_edges(cube(3), 0.15, 12).withColumn("row", F.monotonically_increasing_id()).persist()
    kinds, few = condensed(runs.select("t", "row", "g"), ["t"], "row", "g")
    assert all({x % 100 for x in r["all"]} == {x for x in r["all"] if x < 100} and len(r["all"]) % 3 == 0 for r in kinds.collect())
    assert all(len(a["g"]) <= len(b["g"]) / 3 for a, b in zip(few.orderBy("row").collect(), runs.orderBy("row").collect()))
    assert [sum(r["n"]) for r in few.orderBy("row").collect()] == [len(r["g"]) for r in runs.orderBy("row").collect()]
    one = {(tuple(r["s"]), tuple(r["g"])) for r in TR.biclusters(TR.ratio_edges(cube(1), 0.15, 4), 2, 4).collect()}
    got = {(tuple(r["s"]), tuple(r["g"])) for r in TR.biclusters(TR.ratio_edges(cube(3), 0.15, 12), 2, 12).collect()}
    assert len(one) > 10 and got == {(s, tuple(sorted(x + 100 * k for x in g for k in range(3)))) for s, g in one}


def test_covers_count_members_that_stand_for_many(spark):
    from seqloom.operators import overlaps as O

    rng = np.random.default_rng(9)
    sets = [(k, [0], sorted(x + 50 * c for x in rng.choice(50, int(rng.integers(5, 30)), replace=False).tolist() for c in range(4))) for k in range(30)]
    df = spark.createDataFrame([*sets, (99, [0], [])], "id long, s array<int>, g array<long>")
    keep = lambda na, nb, common, a, b: common[1] >= 0.5 * na[1]
    whole, alike = ({tuple(r) for r in O.overlaps(df, "id", ["s", "g"], keep, x).collect()} for x in (False, True))
    assert whole == alike and len(whole) > 50


def test_lineitem_is_added_up_once_for_a_cube(spark, sf_dir):
    """What a query's steps read is the cube as written, not lineitem again."""
    from seqloom.plans import mining_queries as MQ

    x = MQ.cube(spark, sf_dir)
    for frame in (x, MQ.numbered_cubes(x)):
        assert frame.inputFiles() and not any("lineitem" in f for f in frame.inputFiles())
