"""Small fixtures with known answers, invariants of selection and repair, and rejections."""

from __future__ import annotations

import itertools
import math
import random
import time
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.functions import exact, hashing, text, vectors
from gleanery.operators import evaluation, exact_states, graph, guards, inference, moments, selection, states, structure, windows, workload
from gleanery.streaming.deletes import DeletionState, ExactState, stream_requests


def graph_of(spark, owners, blockers):
    """Rows and edges of an abstract graph: owners by record, blockers as lists of earlier records."""
    rows = spark.createDataFrame([(i, u, f"{i:064x}", [1.0]) for i, u in enumerate(owners)], "id long, unit long, p string, z array<double>")
    edges = spark.createDataFrame([(v, owners[v], b, owners[b], 0.9) for v, bs in enumerate(blockers) for b in bs], "rid long, rown long, bid long, bown long, score double")
    return rows, edges


def plain_selection(owners, blockers, deleted):
    return {v for v, bs in enumerate(blockers) if owners[v] not in deleted and {owners[b] for b in bs} <= deleted}


def units(spark, values):
    return spark.createDataFrame([(v,) for v in values], "unit long")


def ids(df):
    return {r["id"] for r in df.select("id").collect()}


CHAIN = ([0, 1, 2], [[], [0], [1]])
STAR = ([0, 1, 2, 3], [[], [], [], [0, 1, 2]])
CLIQUE = ([0, 1, 2, 3, 4], [list(range(i)) for i in range(5)])
OWN = ([0, 0, 1], [[], [0], [0, 1]])


@pytest.mark.parametrize("owners,blockers", [CHAIN, STAR, CLIQUE, OWN])
def test_every_deletion_of_small_graphs(spark, owners, blockers):
    rows, edges = graph_of(spark, owners, blockers)
    found = structure.terms(rows, edges)
    polynomial = structure.count_polynomial(found).cache()
    first = ids(selection.initial_selection(rows, edges))
    assert first == plain_selection(owners, blockers, set())
    for deleted in itertools.chain.from_iterable(itertools.combinations(sorted(set(owners)), k) for k in range(1, 3)):
        gone = set(deleted)
        after = ids(selection.selection_after(rows, edges, units(spark, deleted)))
        assert after == plain_selection(owners, blockers, gone)
        assert {i for i in first if owners[i] not in gone} <= after
        assert ids(selection.admissions_after(rows, edges, units(spark, deleted))) == after - first
        assert structure.evaluate(polynomial, list(deleted)).first()["n_selected"] == len(after)
        shorter = structure.substitute(polynomial, list(deleted))
        assert structure.evaluate(shorter, []).first()["n_selected"] == len(after)
    assert ids(selection.selection_after(rows, edges, units(spark, set(owners)))) == set()
    polynomial.unpersist()


def test_raw_neighbors_differ_from_greedy(spark):
    rows, edges = graph_of(spark, *CHAIN)
    assert ids(selection.initial_selection(rows, edges)) == {0} and ids(selection.greedy_selection(rows, edges)) == {0, 2}


def test_own_blocked_records_are_never_admitted(spark):
    rows, edges = graph_of(spark, *OWN)
    assert ids(selection.eligible(rows, edges, 5)) == {0, 2}
    assert ids(selection.admissions_after(rows, edges, units(spark, [0]))) == {2}


def test_horizon_eligibility(spark):
    rows, edges = graph_of(spark, *CLIQUE)
    assert ids(selection.eligible(rows, edges, 2)) == {0, 1, 2}


def test_expected_admissions_are_the_mean_over_requests(spark):
    rng = random.Random(1)
    owners = list(range(7))
    blockers = [[b for b in range(v) if rng.random() < 0.4] for v in owners]
    rows, edges = graph_of(spark, owners, blockers)
    first = plain_selection(owners, blockers, set())
    for k in (2, 3):
        mean = np.mean([len(plain_selection(owners, blockers, set(d)) - first) for d in itertools.combinations(owners, k)])
        got = sum(r["n_records"] * r["probability"] for r in structure.expected_admissions(structure.terms(rows, edges), 7, k).collect())
        assert got == pytest.approx(mean, abs=1e-12)
        exactly = sum(exact.activation_probability(7, len(b), 1, k) for b in blockers if b)
        assert float(exactly) == pytest.approx(mean, abs=1e-12)


def test_rank_of_incidence(spark):
    rng = random.Random(5)
    owners = [rng.randrange(4) for _ in range(9)]
    blockers = [[b for b in range(v) if rng.random() < 0.3] for v in range(9)]
    rows, edges = graph_of(spark, owners, blockers)
    found = structure.terms(rows, edges)
    for h in (1, 2):
        usable = [(tuple(sorted({owners[b] for b in bs})), owners[v]) for v, bs in enumerate(blockers)]
        usable = [(t, o) for t, o in usable if o not in t and len(t) <= h]
        keys = sorted({t for t, _ in usable} | {tuple(sorted((*t, o))) for t, o in usable if len(t) < h})
        matrix = np.zeros((max(1, len(keys)), max(1, len(usable))))
        for j, (t, o) in enumerate(usable):
            matrix[keys.index(t), j] += 1
            if len(t) < h:
                matrix[keys.index(tuple(sorted((*t, o)))), j] -= 1
        assert structure.incidence_census(found, h).first()["query_rank"] == np.linalg.matrix_rank(matrix)


def test_scores_at_the_threshold_are_no_edges(spark):
    rows = graph.nodes(spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 1, [0.5, math.sqrt(0.75)]), (2, 2, [1.0, 0.0]), (3, 3, [0.0, 0.0])], "i long, u int, v array<double>"), "i", "u", "v")
    assert rows.count() == 3
    half = graph.theta_pairs(rows, 0.5).count()
    assert {frozenset((r["lid"], r["rid"])) for r in graph.theta_pairs(rows, 0.6).collect()} == {frozenset((0, 2))} and half <= 1 + 2


@pytest.mark.parametrize("tile", [5, 4096])
def test_grid_meets_every_pair_once(spark, tile):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, i % 3, rng.standard_normal(6).tolist()) for i in range(37)], "i long, u int, v array<double>")
    rows = graph.nodes(df, "i", "u", "v")
    got = graph.theta_pairs(rows, -2.0, tile_rows=tile).collect()
    assert len(got) == 37 * 36 // 2 == len({frozenset((r["lid"], r["rid"])) for r in got})
    p = {r["id"]: (r["p"], r["id"]) for r in rows.collect()}
    assert all(p[r["rid"]] < p[r["lid"]] for r in got)
    assert graph.pair_counts(rows, [-2.0, 0.1], tile_rows=tile).first() == (666, sum(r["score"] > 0.1 for r in got))
    close = {r["lid"]: (r["rid"], r["score"]) for r in graph.nearest(rows.where("id < 20"), rows.where("id >= 20"), tile_rows=tile).collect()}
    every = {(r["lid"], r["rid"]): r["score"] for r in graph.theta_pairs(rows.where("id < 20"), -2.0, rows.where("id >= 20"), tile_rows=tile).collect()}
    assert all(close[i] == (max(range(20, 37), key=lambda j: every[i, j]), max(every[i, j] for j in range(20, 37))) for i in range(20))
    two = graph.theta_pairs(rows.where("id < 20"), -2.0, rows.where("id >= 20"), tile_rows=tile)
    assert two.count() == 20 * 17 and two.where("lid >= 20 or rid < 20").count() == 0


@pytest.mark.parametrize("tile,reach", [(5, 1), (5, 4), (4096, 1)])
def test_first_pairs_of_each_bin(spark, tile, reach):
    """Whatever the tiles are, and where few pairs meet the first bounds, so that they widen."""
    rng = np.random.default_rng(3)
    z = {i * 7: rng.standard_normal(3) for i in range(37)}
    rows = graph.nodes(spark.createDataFrame([(i, 0, v.tolist()) for i, v in z.items()], "i long, u int, v array<double>"), "i", "u", "v")
    bins = {}
    for a, b in itertools.combinations(sorted(z), 2):
        score = z[a] @ z[b] / np.linalg.norm(z[a]) / np.linalg.norm(z[b])
        bins.setdefault(int((score + 1) * 10), []).append(f"{a}|{b}")
    want = {(x, b, min(3, len(names)), len(names)) for b, names in bins.items() for x in sorted(names, key=lambda x: sha256(f"s\0{x}".encode()).digest())[:3]}
    got = [tuple(r) for r in graph.binned_pair_sample(rows, 3, "s", tile_rows=tile, reach=reach).collect()]
    assert set(got) == want and len(got) == len(want)
    assert graph.binned_pair_sample(rows.where("id < 0"), 3, "s").count() == 0


def test_pair_sample_of_many_pairs(spark):
    """18 million pairs, more than are named and hashed one by one in this time."""
    rows = graph.nodes(spark.range(6000).select("id", F.lit(0).alias("u"), F.array(*[F.randn(k) for k in range(8)]).alias("v")), "id", "u", "v")
    began = time.monotonic()
    got = graph.binned_pair_sample(rows, 30, "s").collect()
    assert time.monotonic() - began < 40
    assert sum({r["bin"]: r["den"] for r in got}.values()) == 6000 * 5999 // 2


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (7, 8), (5, 5)], "a long, b long")
    assert {r["node"]: r["label"] for r in graph.components(links).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 5: 5}


def test_requests(spark):
    known, ask = units(spark, range(5)), lambda *v: units(spark, v)
    check = lambda r, h, gone=None, mode="strict": sorted(x["unit"] for x in selection.validate_request(known, r, h, gone, mode).collect())
    assert check(ask(1, 2), 2) == [1, 2]
    for request, horizon, gone, mode in [(ask(1, 1), 3, None, "strict"), (ask(9), 3, None, "strict"), (ask(1, 2), 1, None, "strict"), (ask(1), 3, ask(1), "strict"), (ask(9), 3, None, "idempotent"), (ask(2, 3), 2, ask(1), "idempotent")]:
        with pytest.raises(ValueError):
            check(request, horizon, gone, mode)
    assert check(ask(1, 1, 2), 2, ask(1), "idempotent") == [2]


def test_streamed_deletes_equal_one_batch(spark, tmp_path):
    rng = random.Random(8)
    owners = [rng.randrange(8) for _ in range(30)]
    blockers = [[b for b in range(v) if rng.random() < 0.15] for v in range(30)]
    rows, edges = graph_of(spark, owners, blockers)
    state = DeletionState(spark, str(tmp_path / "state"), 4)
    state.create(rows, edges)
    (tmp_path / "in").mkdir()
    for i, batch in enumerate([[3], [1, 1, 6], [3]]):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(f'{{"request_id": {i}, "unit": {u}}}' for u in batch))
    state.follow(stream_requests(spark, str(tmp_path / "in")), str(tmp_path / "checkpoint")).awaitTermination()
    assert ids(state.selection(3)) == plain_selection(owners, blockers, {1, 3, 6})
    state.apply(2, units(spark, [0]))  # a batch that comes again finds its version written
    assert ids(state.selection(3)) == plain_selection(owners, blockers, {1, 3, 6})
    with pytest.raises(ValueError):
        state.apply(3, units(spark, [0, 2]))


# Guards, windows, workloads -----------------------------------------------------------------------------------------


def test_guards_are_simultaneous_and_idempotent(spark):
    rows = [(1, "a  b", "train", None), (2, "a b", "test", None), (3, "A b", "train", "2"), (4, "c", "train", "3"), (5, "c", "calibration", "0"), (6, "d", "train", "-1")]
    df = spark.createDataFrame(rows, "record_id long, text string, partition string, parent_id string")
    one = lambda x: guards.unite_reasons(guards.exact_text_guard(x, text.collapse_space(F.col("text"))), guards.parent_guard(x))
    reasons = {r["record_id"]: r["reasons"] for r in one(df).collect()}
    assert reasons == {1: ["exact_text"], 3: ["heldout_parent"], 4: ["exact_text"]}
    left = guards.apply_guards(df, one(df))
    assert {r["record_id"] for r in left.collect()} == {2, 5, 6} and one(left).count() == 0


def test_text_forms(spark):
    rows = [("a  b",), (" é x\n",), ("é x",), ("E x",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.normalized_text(F.col("t"))).collect()]
    assert got == ["a b", "é x", "é x", "E x", None]
    hosts = spark.createDataFrame([("WWW.Example.com.",), ("1.2.3.4",), ("a:80",), ("münchen.de",)], "h string")
    assert [r[0] for r in hosts.select(text.international_host(F.col("h"))).collect()] == ["www.example.com", None, None, "xn--mnchen-3ya.de"]
    news = spark.createDataFrame([("T x", "\n T  x\nbody"), ("T", "body\nT")], "t string, b string")
    assert [r[0] for r in news.select(text.news_text(F.col("t"), F.col("b"))).collect()] == ["T x body", "T body T"]
    html = spark.createDataFrame([("<p>a<a href='u'>b</a><script>x</script><div class='post-notice'>n</div><img alt='p'>",), ("a</b>",)], "h string")
    assert [tuple(r[0]) for r in html.select(text.html_body(F.col("h"))).collect()] == [("ab (u) p", 1), ("a", 1)]


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], -1.0, 1.0)], "v array<double>, lo double, hi double")
    got = row.select(vectors.unit_vector(F.col("v")).alias("u"), vectors.score_bin(F.col("lo")).alias("a"), vectors.score_bin(F.col("hi")).alias("b"), vectors.score_bin(F.lit(-0.9)).alias("c"), vectors.outward_product(F.lit(0.1), F.lit(0.2)).alias("i")).first()
    assert got["u"] == [0.6, 0.8] and (got["a"], got["b"], got["c"]) == (0, 19, 1)
    assert got["i"]["lower"] < 0.1 * 0.2 < got["i"]["upper"]
    q = vectors.orthonormal_projection(8, 3, 1)
    assert np.allclose(q.T @ q, np.eye(3))


def test_hash_bounds():
    assert hashing.hash_bound(Fraction(1, 2)) == "7" + "f" * 63 and hashing.hash_bound(Fraction(7, 10)) == "b" + "3" * 63
    assert hashing.derive_seed("a", "bc") != hashing.derive_seed("ab", "c")


def test_calendar_gap_stops_the_prefix(spark):
    m = spark.createDataFrame([("01", 5, True), ("02", 5, True), ("03", 50, False), ("04", 5, True)], "month string, n long, complete boolean")
    assert sorted(r["month"] for r in windows.calendar_prefix(m, 40).collect()) == ["01", "02"]
    assert [r["month"] for r in windows.calendar_prefix(m, 5).collect()] == ["01"]


def test_samples_repeat_and_census_small_strata(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 3, "small").otherwise("big").alias("s"))
    a = workload.stratified_sample(df, ["s"], F.col("id"), 10, "x").collect()
    b = workload.stratified_sample(df.repartition(5), ["s"], F.col("id"), 10, "x").collect()
    assert sorted(a) == sorted(b) and sum(r["s"] == "small" for r in a) == 3 and len(a) == 13
    assert {(r["num"], r["den"]) for r in a} == {(3, 3), (10, 97)}


def test_successive_sampling_favours_mass(spark):
    m = spark.createDataFrame([("a", 1000)] + [(f"s{i}", 1) for i in range(20)], "source string, mass long")
    first = [workload.successive_sources(m, f"salt{i}", 1).first()["source"] for i in range(12)]
    assert first.count("a") > 9


# Metrics and bounds -------------------------------------------------------------------------------------------------


def test_ranking_conventions(spark):
    df = lambda rows: spark.createDataFrame(rows, "score double, target long")
    tied = evaluation.ranking_metrics(df([(0.5, 1), (0.5, 0), (0.1, 0)])).first()
    assert tied["average_precision"] == 0.5 and tied["auroc"] == 0.75
    assert evaluation.ranking_metrics(df([(0.5, 0), (0.4, 0)])).first()["auroc"] is None
    assert evaluation.best_f1_threshold(df([(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0)])).first()["threshold"] == 0.7
    zero = evaluation.f1_scores(spark.createDataFrame([("a", 0, 0)], "output string, predicted int, target int")).first()
    assert (zero["micro_f1"], zero["macro_f1"]) == (0.0, 0.0)
    flat = evaluation.effect_metrics(spark.createDataFrame([(1.0, 1.0, 0.5, 1.0)] * 2, "y double, before double, frozen double, oracle double")).first()
    assert flat["signed_normalized_loss"] is None and flat["normalized_prediction_rms"] is None


def test_ratings(spark):
    r = spark.createDataFrame([("p", "yes"), ("p", "yes"), ("p", "no"), ("q", "yes"), ("q", "no"), ("q", "unsure")], "pair string, label string")
    assert {x["pair"]: x["label"] for x in evaluation.majority_labels(r, "pair", "label").collect()} == {"p": "yes", "q": "no_majority"}


def test_registry_rejects_extras(spark):
    plan = spark.createDataFrame([("a", 1), ("b", 1)], "k string, c int")
    seen = spark.createDataFrame([("a", 1, "done")], "k string, c int, status string")
    assert sorted(r["status"] for r in evaluation.planned_vs_observed(plan, seen, ["k", "c"]).collect()) == ["done", "missing"]
    for bad in ([("z", 1, "done")], [("a", 1, "done"), ("a", 1, "done")]):
        with pytest.raises(ValueError):
            evaluation.planned_vs_observed(plan, spark.createDataFrame(bad, "k string, c int, status string"), ["k", "c"])


def test_population_bounds_by_brute_force():
    for population, sample in [(12, 5), (9, 9), (20, 7)]:
        for x in range(sample + 1):
            tail = lambda k: sum(math.comb(k, j) * math.comb(population - k, sample - j) for j in range(x, min(sample, k) + 1)) / math.comb(population, sample)
            want = x if sample == population else min(k for k in range(population + 1) if tail(k) > 0.05 + 1e-15)
            assert exact.population_lower_bound(population, sample, x) == want
    assert exact.population_lower_bound(0, 0, 0) is None
    low, high = exact.population_interval(30, 10, 6, 1)
    assert 0 <= low <= 6 / 10 * 30 <= high <= 30
    assert exact.quality_gate(9, 10) and not exact.quality_gate(8, 9 + 1)


def test_exact_arithmetic():
    root = exact.sqrt_up(Fraction(2), 5)
    assert root * root >= 2 > (root - Fraction(1, 10**5)) ** 2
    for x in (Fraction(0), Fraction(3, 2), Fraction(-7), Fraction(40)):
        low, high = exact.sigmoid_bounds(x)
        assert low <= high and float(low) <= 1 / (1 + math.exp(-float(x))) + 1e-15 and float(high) >= 1 / (1 + math.exp(-float(x))) - 1e-15 and high - low < Fraction(1, 10**12)
    low, high = exact.binomial_interval(10, 3)
    assert low == pytest.approx(0.06674, abs=1e-4) and high == pytest.approx(0.65245, abs=1e-4)
    gram, cross = [[Fraction(2), Fraction(1)], [Fraction(1), Fraction(3)]], [[Fraction(1)], [Fraction(2)]]
    w = exact.solve_exact(gram, cross, Fraction(1, 10))
    assert exact.ridge_certificate(gram, cross, Fraction(1, 10), w) == 0
    off = [[w[0][0] + Fraction(1, 1000)], w[1]]
    assert exact.ridge_certificate(gram, cross, Fraction(1, 10), off) >= Fraction(1, 1000)


# Models -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, 5))
    y = x @ np.arange(1, 6) + rng.standard_normal(120) * 0.1
    return x, y, spark.createDataFrame([(i, v.tolist(), float(t), i % 4, int(t > 0)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "i long, x array<double>, y double, fold int, c int")


def test_moments_and_solvers(regression):
    x, y, df = regression
    gram, cross, n = moments.unpack(moments.packed_moments(df, "x", "y"), 5)["0"]
    assert np.allclose(gram, x.T @ x) and np.allclose(cross, x.T @ y) and n == 120
    w = moments.solve_ridge(gram, cross, n, 1e-2)
    assert np.allclose(w, moments.solve_dual(x, y, 1e-2)) and np.allclose(w, moments.solve_gated(gram, cross, n, 1e-2, "cg"))
    assert moments.extended_residual(gram, cross, n, 1e-2, w) < 1e-9 and not moments.solve_gated(gram, cross, 0, 1e-2).any()
    less = df.where("i >= 20").withColumn("s", F.lit(1)).union(df.where("i < 10").withColumn("s", F.lit(-1))).union(df.where("i < 20").withColumn("s", F.lit(1)))
    delta, _, m = moments.unpack(moments.packed_moments(less, "x", "y", sign="s"), 5)["0"]
    assert np.allclose(delta, x[10:].T @ x[10:]) and m == 110
    ordered = np.array(moments.ordered_moments(df, "x", "y", "i", np.float64).first()["values"])
    assert np.allclose(ordered[:15], gram[np.triu_indices(5)])


def test_fold_grid_equals_refits(regression):
    x, y, df = regression
    fold = np.arange(120) % 4
    for ridge, loss in moments.ridge_grid(df, "x", "y", "fold", 5, [1e-3, 1e-1]):
        errors = 0.0
        for f in range(4):
            a, b = x[fold != f], y[fold != f]
            w = np.linalg.solve(a.T @ a + ridge * len(a) * np.eye(5), a.T @ b)
            errors += ((x[fold == f] @ w - y[fold == f]) ** 2).sum()
        assert loss == pytest.approx(errors / 120)


def test_logistic_regression_is_stationary(regression):
    x, _, df = regression
    c = np.array([r["c"] for r in df.orderBy("i").collect()])
    w = moments.fit_logistic(df, "x", "c", 5, 0.1)
    gradient = x.T @ (1 / (1 + np.exp(-(x @ w))) - c) / len(x) + 0.1 * w
    assert np.linalg.norm(gradient) < 1e-8
    keep = slice(20, None)
    changed = -(x[:20].T @ (1 / (1 + np.exp(-(x[:20] @ w))) - c[:20]))
    direct = x[keep].T @ (1 / (1 + np.exp(-(x[keep] @ w))) - c[keep]) / 100 + 0.1 * w
    assert np.allclose(moments.warm_gradient(gradient, 120, changed, 100, 0.1, w), direct)


# Inference ----------------------------------------------------------------------------------------------------------


def test_intervals_hold_the_estimate(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(f"p{i % 8}", f"s{i % 5}", "RS"[i % 2], rng.random(), 1.0, 0.5) for i in range(80)], "path string, source string, arm string, a double, b double, c double")
    for got, centre in [
        (inference.crossed_bootstrap(df, "path", "source", "a", "b", 200, "x"), "ratio"), (inference.paired_ratio_bootstrap(df, "path", "a", "c", 200, "x"), "ratio"),
        (inference.equal_arm_bootstrap(df, "arm", "path", "a", 200, "x"), "mean"), (workload.bootstrap(df, "path", "a", 200, "x"), "mean"),
    ]:
        r = got.first()
        assert r["low"] < r[centre] < r["high"]


def test_envelope_holds_every_threshold(spark):
    rng = np.random.default_rng(1)
    rows = graph.nodes(spark.createDataFrame([(i, i % 4, rng.standard_normal(5).tolist()) for i in range(40)], "i long, u long, v array<double>"), "i", "u", "v").cache()
    gone = units(spark, [2])
    got = inference.envelope(rows, 0.6, 0.1, gone)
    for tau in (0.51, 0.6, 0.69):
        now = selection.selection_after(rows, graph.blocker_edges(rows, tau), gone)
        assert inference.contained(got.where("certain"), now) and inference.contained(now, got)
    rows.unpersist()


def test_panel_and_strata(spark):
    label = lambda rows: spark.createDataFrame(rows, "pair_id long, label long")
    first, again = label([(i, 1) for i in range(10)]), label([(i, int(i != 3)) for i in range(20)])
    assert inference.validate_panel(first, again, 20) == {"lower": 19, "passes": True, "overlap": 10, "changed": 1}
    low, high = inference.stratified_interval([(10, 10, 4, 0), (30, 0, 0, 0)])
    assert (low, high) == (4, 34)


def test_certificates_charts_and_words():
    rows = [([Fraction(1), Fraction(i, 3)], Fraction(i % 2)) for i in range(6)]
    w = np.zeros(2)
    x, y = np.array([[float(a) for a in r] for r, _ in rows]), np.array([float(t) for _, t in rows])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / 6 + 0.1 * np.eye(2), x.T @ (p - y) / 6 + 0.1 * w)
    assert inference.logistic_certificate(rows, [Fraction(float(v)) for v in w], Fraction(1, 10)) < Fraction(1, 10**8)
    assert inference.logistic_certificate(rows, [Fraction(0), Fraction(0)], Fraction(1, 10)) > Fraction(1, 100)
    assert inference.canonical_chart([[1, 2, 3], [2, 4, 7]]) == inference.canonical_chart([[0, 0, 5], [3, 6, 0]]) == ([0, 2], [[1, 2, 0], [0, 0, 1]])
    state = (9, [0, 4, 8], [1, 0, 1])
    assert inference.decode_words(inference.encode_words(*state)) == state
    for bad in (inference.encode_words(*state)[:-1] + b"\xff", inference.encode_words(*state)[:-1], b"W1"):
        with pytest.raises(ValueError):
            inference.decode_words(bad)
    one = [[Fraction(1)]]
    with pytest.raises(ArithmeticError):
        inference.strict_release(one, one, Fraction(1), [[Fraction(9)]], Fraction(1, 10))
    assert inference.strict_release(one, one, Fraction(1), [[Fraction(1, 2)]], Fraction(0)) == [[Fraction(1, 2)]]
    assert inference.envelope_radius(Fraction(1), Fraction(2), Fraction(3), Fraction(1, 2)) == 10
    plan = dict(inference.precision_plan([0.1, -0.2, 0.3, 0.0, 0.2], [5, 200], 0.1))
    assert plan[200] > plan[5]


@pytest.mark.parametrize("owners,blockers", [CHAIN, STAR, CLIQUE, OWN])
def test_factored_states_equal_refits(spark, owners, blockers):
    rows, edges = graph_of(spark, owners, blockers)
    rng = np.random.default_rng(len(owners))
    w = rng.standard_normal((len(owners), 3))
    stats = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(w)], "id long, w array<double>")
    found = structure.terms(rows, edges)
    state = states.factor_polynomial(found, stats, 3).cache()
    for deleted in [[], [0], [0, 1]]:
        chosen = sorted(plain_selection(owners, blockers, set(deleted)))
        want = w[chosen].T @ w[chosen]
        for got in (states.evaluate_factors(state, deleted, 3), states.evaluate_factors(states.substitute_factors(state, deleted, 3), [], 3)):
            row = got.collect()
            assert np.allclose(states.dense(row[0]["weights"], row[0]["factors"], 3) if row else 0, want)
    spans = {tuple(r["key"]): r for r in states.joint_spans(state, 3, 2).collect()}
    for r in state.collect():
        m, s = states.dense(r["weights"], r["factors"], 3), spans[tuple(r["key"])]
        basis = np.array(s["basis"]).reshape(2, s["rank"])
        assert np.allclose(basis @ np.array(s["core"]).reshape(s["rank"], s["rank"]) @ basis.T, m[:2, :2])
        assert np.allclose(basis @ np.array(s["cross"]).reshape(s["rank"], 1), m[:2, 2:])


def plain_gram(w, chosen):
    return [[sum((w[v][i] * w[v][j] for v in chosen), Fraction(0)) for j in range(len(w[0]))] for i in range(len(w[0]))]


@pytest.mark.parametrize("owners,blockers", [CHAIN, STAR, CLIQUE, OWN])
def test_exact_states_equal_refits(spark, owners, blockers):
    rows, edges = graph_of(spark, owners, blockers)
    rng = random.Random(len(owners))
    w = [[Fraction(rng.randrange(-(2**40), 2**40), 2**20) for _ in range(3)] for _ in owners]
    stats = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(w)], "id long, w array<double>")
    found = structure.terms(rows, edges)
    state = exact_states.exact_polynomial(found, stats, 20).cache()
    for deleted in [[], [0], [0, 1]]:
        want = plain_gram(w, sorted(plain_selection(owners, blockers, set(deleted))))
        for got in (exact_states.evaluate_exact(state, deleted), exact_states.evaluate_exact(exact_states.substitute_exact(state, deleted), [])):
            assert exact_states.exact_matrix(got, 3, 20) == want
    assert exact_states.exact_polynomial(found.limit(0), stats, 20).count() == 0
    for bad in ([0.1, 1.0, 1.0], [None, 1.0, 1.0], [math.nan, 1.0, 1.0], [math.inf, 1.0, 1.0], [2.0**60, 1.0, 1.0]):
        with pytest.raises(Exception, match="grid"):
            exact_states.exact_polynomial(found, spark.createDataFrame([(0, bad)], "id long, w array<double>"), 20).collect()


def test_exact_state_commits_whole_batches(spark, tmp_path):
    owners, blockers = STAR
    rows, edges = graph_of(spark, owners, blockers)
    w = [[Fraction(i + 1), Fraction(1, 2)] for i in range(4)]
    stats = rows.select("id", F.array((F.col("id") + 1).cast("double"), F.lit(0.5)).alias("w"))
    state = ExactState(spark, str(tmp_path / "exact"), 3, "strict")
    state.create(rows, structure.terms(rows, edges), stats, 4)
    with pytest.raises(ValueError):
        state.apply(0, units(spark, [0, 77]))
    for version, batch in enumerate([[0], [2, 1]]):
        state.apply(version, units(spark, batch))
    for version, gone in enumerate([set(), {0}, {0, 1, 2}]):
        assert exact_states.exact_matrix(state.moments(version), 2, 4) == plain_gram(w, sorted(plain_selection(owners, blockers, gone)))
    with pytest.raises(ValueError):
        state.apply(2, units(spark, [3]))  # nothing of the horizon is left
    assert not (tmp_path / "exact" / "v3").exists()


def test_exact_chart_is_one_form_of_a_row_space():
    m = [[Fraction(x) for x in r] for r in ([2, 4, 1], [4, 8, 2], [1, 2, 5])]
    assert exact_states.exact_chart(m, 2) == ([0], [[1, 2]]) == exact_states.exact_chart([[3 * x for x in r] for r in m], 2)


def test_numbers_go_to_the_nearest_multiple(spark):
    got = spark.range(1).select(exact_states.to_grid(F.array(F.lit(0.3), F.lit(-0.3), F.lit(0.125), F.lit(-0.125)), 2)).first()[0]
    assert got == [0.25, -0.25, 0.25, 0.0]


def test_a_hot_key_merges_in_parts_and_an_empty_state_stays_empty(spark):
    rows, edges = graph_of(spark, [0] * 300 + [1], [[] for _ in range(301)])
    stats = rows.select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("w"))
    found = structure.terms(rows, edges)
    state = states.factor_polynomial(found.repartition(7), stats, 2)
    assert {tuple(r["key"]): len(r["weights"]) for r in state.collect()} == {(): 2, (0,): 2, (1,): 1}
    assert states.factor_polynomial(found.limit(0), stats, 2).count() == 0
    assert states.evaluate_factors(state.limit(0), [0], 2).count() == 0


def test_tie_curve_over_slices(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, float("nan"), *[k / 7 for k in range(40)]]), rng.randint(0, 1), rng.choice(["a", None])) for _ in range(400)]
    df = spark.createDataFrame(rows, "score double, target long, g string")
    for group in ([], ["g"]):
        curve = lambda n: sorted(map(str, evaluation.tie_curve(df, group, n).collect()))  # noqa: E731,B023
        assert curve(8) == curve(1) == curve(64)
    assert evaluation.tie_curve(df.limit(0)).count() == 0


def test_rank_coordinates_restore(spark):
    rows, edges = graph_of(spark, *STAR)
    found = structure.terms(rows, edges)
    polynomial = structure.count_polynomial(found, 2)
    short, members = states.rank_coordinates(polynomial, found, 2)
    want = {(r["name"], r["coefficient"]) for r in polynomial.select(structure.key_text(F.col("key")).alias("name"), "coefficient").collect()}
    assert short.count() < len(want)
    assert {tuple(r) for r in states.restore_keys(short, members).collect()} == want


def test_refit_arms(spark):
    rng = np.random.default_rng(3)
    angles = [*rng.uniform(0, 0.6, 12), *rng.uniform(1.6, 2.4, 12)]
    z = {i: np.array([math.cos(a), math.sin(a)]) for i, a in enumerate(angles)}
    rows = spark.createDataFrame([(i, i % 5, f"{i:064x}", v.tolist()) for i, v in z.items()], "id long, unit long, p string, z array<double>")
    found = moments.refit_arms(rows, units(spark, [2]), 2, 0.99).collect()
    arm = lambda name: {r["id"] for r in found if r["arm"] == name}
    alive = [i for i in z if i % 5 != 2]

    def plain(fit_on, among):
        out = set()
        for side in (range(12), range(12, 24)):
            centre = np.mean([z[i] for i in fit_on if i in side], axis=0)
            order = sorted((i for i in side if i in among), key=lambda i: (-round(float(z[i] @ centre), 9), i))
            out |= {i for n, i in enumerate(order) if not any(z[i] @ z[j] > 0.99 for j in order[:n])}
        return out

    assert arm("frozen_selection") == plain(z, z) & set(alive) and arm("frozen_selection") <= arm("frozen_fit")
    assert arm("frozen_fit") == plain(z, alive) and arm("full_refit") == plain(alive, alive)
    assert moments.refit_arms(rows.limit(0), units(spark, [2]), 2, 0.99).count() == 0


def test_indexed_state_as_in_substitution(spark, tmp_path):
    """Random graphs: every version equals the polynomial of all deletions so far, with and without compaction; bad batches leave nothing."""
    import random

    from gleanery.streaming.deletes import IndexedState

    rng = random.Random(5)
    found = [(i, rng.randrange(6), sorted(rng.sample(range(6), rng.randrange(4)))) for i in range(60)]
    terms = spark.createDataFrame(found, "id long, own int, tail array<int>")
    rows = spark.createDataFrame([(u,) for u in range(6)], "unit int")
    units = lambda *u: spark.createDataFrame([(x,) for x in u], "unit int")
    for compact in (0.0, 10.0):
        state = IndexedState(spark, str(tmp_path / f"c{compact}"), 4, "strict", compact)
        state.create(rows, terms)
        with pytest.raises(ValueError):
            state.apply(0, units(1, 99))
        for version, batch in enumerate(((2,), (4, 0))):
            state.apply(version, units(*batch))
            state.apply(version, units(5))  # a batch that comes again does nothing
        for version, gone in ((0, []), (1, [2]), (2, [2, 4, 0])):
            want = structure.substitute(structure.count_polynomial(terms, 4), gone, 4)
            assert {tuple(r["key"]): r["coefficient"] for r in state.polynomial(version).collect()} == {tuple(r["key"]): r["coefficient"] for r in want.collect()}
            assert state.n_selected(version) == sum(set(t) <= set(gone) and o not in gone for _, o, t in found if o not in t)
        with pytest.raises(ValueError):
            state.apply(2, units(1, 3))


def test_certified_state_releases_whole_or_nothing(spark, tmp_path):
    from fractions import Fraction

    from gleanery.functions import exact
    from gleanery.streaming.deletes import CertifiedState

    found = [(1, 0, []), (2, 1, [0]), (3, 2, [0]), (4, 2, [])]
    weights = {1: [0.5, 0.25, 1.0], 2: [0.25, -0.5, 2.0], 3: [1.0, 0.75, -1.0], 4: [-0.5, 0.5, 3.0]}
    terms = spark.createDataFrame(found, "id long, own int, tail array<int>")
    rows = spark.createDataFrame([(u,) for u in range(3)], "unit int")
    stats = spark.createDataFrame(list(weights.items()), "id long, w array<double>")
    ridge = Fraction(1, 10)
    state = CertifiedState(spark, str(tmp_path / "s"), 2, 4, 2, ridge, Fraction(1, 10**12))
    state.create(rows, terms, stats)
    state.apply(0, spark.createDataFrame([(0,)], "unit int"))
    for version, chosen in ((0, (1, 4)), (1, (2, 3, 4))):
        x = [[Fraction(v) for v in weights[i]] for i in chosen]
        gram = [[sum(r[a] * r[b] for r in x) for b in range(2)] for a in range(2)]
        cross = [[sum(r[a] * r[2] for r in x)] for a in range(2)]
        want = exact.solve_exact(gram, cross, ridge)
        assert all(abs(Fraction(w) - v[0]) < Fraction(1, 10**12) for w, v in zip(state.weights(version), want, strict=True))
    strict = CertifiedState(spark, str(tmp_path / "t"), 2, 4, 2, ridge, Fraction(1, 10**60))
    with pytest.raises(ArithmeticError):
        strict.create(rows, terms, stats)
    assert not strict._exists(0)


def test_digests_and_outputs(spark):
    from hashlib import sha256

    import numpy as np

    row = spark.createDataFrame([([1.5, -0.0, 3.25],), (None,)], "v array<float>")
    assert [r[0] for r in row.select(vectors.vector_hash(F.col("v"))).collect()] == [sha256(np.array([1.5, -0.0, 3.25], "<f4").tobytes()).hexdigest(), None]
    df = spark.createDataFrame([([1.0, float(i % 3)], float(i % 2), float(i % 3 == 0)) for i in range(60)], "v array<double>, a double, b double")
    both = inference.fit_outputs(df, "v", ["a", "b"], 2, 0.1)
    assert np.allclose(both["b"], moments.fit_logistic(df, "v", "b", 2, 0.1)) and both["b"][1] < 0
    assert workload.one_percent_horizon(0) == (0, []) and workload.one_percent_horizon(1050) == (11, [1, 8, 11]) and workload.one_percent_horizon(1050, 3) == (3, [1, 3])
    assert inference.envelope_radius(1, 2, 3, 4) == 5 / 4 and sum(p for _, p in inference.precision_plan([0.1, 0.2, 0.3], [5, 50], 0.2)) > 1


def test_convex_program_of_three_arms(spark):
    """A graph by hand: fresh and warm agree with a plain fit of the repaired selection, frozen with one of what is left."""
    rng = np.random.default_rng(3)
    owners, blockers = [0, 1, 1, 2, 2, 3, 3, 1], [[], [0], [0], [], [3], [], [], [5]]
    rows, edges = graph_of(spark, owners, blockers)
    x, y = rng.standard_normal((8, 2)), rng.integers(0, 2, (8, 2)).astype(float)
    data = spark.createDataFrame([(i, x[i].tolist(), *y[i].tolist()) for i in range(8)], "id long, v array<double>, a double, b double")
    full = rows.join(data, "id")
    found = {(r["checkpoint"], r["arm"]): r for r in inference.convex_program(full, edges, [0, 2], [1, 2], full, "v", ["a", "b"], 2, 0.1)}
    assert len(found) == 9 and all(r["released"] for r in found.values())

    def plain(chosen):
        bce = mse = 0.0
        for c in range(2):
            w = np.zeros(2)
            for _ in range(60):
                p = 1 / (1 + np.exp(-x[chosen] @ w))
                g = x[chosen].T @ (p - y[chosen, c]) / len(chosen) + 0.1 * w
                h = (x[chosen] * (p * (1 - p))[:, None]).T @ x[chosen] / len(chosen) + 0.1 * np.eye(2)
                w = w - np.linalg.solve(h, g)
            p = 1 / (1 + np.exp(-x @ w))
            bce += -np.mean(y[:, c] * np.log(p) + (1 - y[:, c]) * np.log(1 - p)) / 2
            mse += np.mean((p - y[:, c]) ** 2) / 2
        return bce, mse

    for k in (0, 1, 2):
        gone = {0, 2} if k == 2 else {0} if k else set()
        repaired = sorted(plain_selection(owners, blockers, gone))
        frozen = [i for i in plain_selection(owners, blockers, set()) if owners[i] not in gone]
        for arm, chosen in (("fresh", repaired), ("warm", repaired), ("frozen", sorted(frozen))):
            assert np.allclose([found[k, arm]["bce"], found[k, arm]["mse"]], plain(chosen), atol=1e-7)
