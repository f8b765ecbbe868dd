"""The registry of measures and both correlations, against the single operators and NumPy; class k-means and label pairs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from silovalue.operators import distance as X, domain_shift as Y, fit as T, measures, partition as D, prep as P, stats as C


def test_registry_leaves_class_measures_out_of_regression(spark):
    rows = spark.createDataFrame([(i, i % 2, [float(i), float(i * i % 7)], float(i), "train" if i % 3 else "test") for i in range(30)],
                                 "row_id bigint, client_id bigint, features array<double>, y double, split string")
    silos = measures.Silos(rows)
    assert set(measures.registry(silos, regression=True)) == set(measures.NAMES) - set(measures.CLASS_ONLY)
    assert list(measures.registry(silos)) == list(measures.NAMES)
    with pytest.raises(ValueError):
        measures.all_measures(silos, regression=True, only=("hellinger",))
    got = {(r.measure, r.src, r.tgt): r.value for r in measures.all_measures(silos, regression=True, only=("relevance", "performanceDegradation")).collect()}
    single = {(r.src, r.tgt): r.relevance for r in X.relevance_diversity(rows, components=measures.COMPONENTS).collect()}
    assert {k[1:]: v for k, v in got.items() if k[0] == "relevance"} == pytest.approx(single)
    assert got["performanceDegradation", "0", "0"] == 0


def test_both_correlations_by_hand(spark):
    rng = np.random.default_rng(2)
    silos, evaluators = ["0", "1", "2", "3"], ["0", "1", "2", "3", "Global"]
    values = {(e, s): float(v) for (e, s), v in zip(itertools.product(evaluators, silos), rng.normal(size=20))}
    found = {(m, s, t): float(v) for (m, s, t), v in zip(itertools.product(["yShift", "hellinger", "volume"], silos, evaluators), rng.normal(size=60))}
    found["yShift", "1", "Global"] = float("inf")
    sv = spark.createDataFrame([(e, "MCC", int(s), v) for (e, s), v in values.items()], "evaluator string, metric string, client_id int, value double")
    table = spark.createDataFrame([(*k, v) for k, v in found.items()], "measure string, src string, tgt string, value double")
    got = {(r.measure, r.side): r for r in measures.both_correlations(sv, table).collect()}
    assert set(got) == {(m, s) for m in ("yShift", "hellinger") for s in ("Centralized", "Decentralized")} | {("volume", "Centralized")}
    x = np.array([values["Global", s] for s in silos])
    for measure in ("hellinger", "volume"):
        y = np.array([found[measure, s, "Global"] for s in silos])
        assert got[measure, "Centralized"].pearson == pytest.approx(np.corrcoef(x, y)[0, 1])
        assert got[measure, "Centralized"].spearman == pytest.approx(np.corrcoef(x.argsort().argsort(), y.argsort().argsort())[0, 1])
    y = np.array([0.0 if s == "1" else found["yShift", s, "Global"] for s in silos])
    assert got["yShift", "Centralized"].pearson == pytest.approx(np.corrcoef(x, y)[0, 1])


def test_permutations_are_chosen_by_the_caller(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=8), rng.normal(size=8)
    r, exact = C.permutation_p(x, y)
    _, drawn = C.permutation_p(x, y, "sampled", 20_000, 3)
    assert drawn == pytest.approx(exact, abs=0.02) and r == pytest.approx(np.corrcoef(x, y)[0, 1])
    with pytest.raises(ValueError):
        C.permutation_p(np.arange(11.0), np.arange(11.0))
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y)] + [("one", 1.0, 2.0), ("k", None, 1.0)], "k string, x double, y double")
    got = {row.k: row for row in C.spearman_permutation_p(df, ["k"], method="sampled", resamples=50).collect()}
    assert got["one"].r is None and 0 < got["k"].p <= 1


def test_t_tail_by_integration():
    def integrated(t, df):
        import math

        at = np.linspace(0, t, 400_001)
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        return 1 - 2 * np.trapezoid(c * (1 + at * at / df) ** (-(df + 1) / 2), at)

    for t, df in [(0.0, 3), (0.3, 1), (1.0, 2), (2.5, 7), (4.0, 40), (1.96, 900)]:
        assert C.t_tail(np.array([t]), np.array([df]))[0] == pytest.approx(integrated(t, df), abs=1e-9)
    assert C.t_tail(np.array([1.959963984540054]), np.array([1e8]))[0] == pytest.approx(0.05, abs=1e-7)
    assert np.isnan(C.t_tail(np.array([np.nan, 1.0]), np.array([3.0, 0.0]))).all()


def test_lloyd_steps_equal_numpy_class_by_class(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 2)) + rng.integers(0, 3, size=(90, 1)) * 4
    labels = [None if i % 9 == 0 else i % 3 for i in range(90)]
    df = spark.createDataFrame([(i, labels[i], x[i].tolist()) for i in range(90)] + [(99, 1, None)], "row_id bigint, label int, features array<double>").repartition(4)
    centres = D.first_centres(df, 3)
    for _ in range(2):
        moved = D.moved_centres(df, centres)
        for c, own in centres.items():
            rows = x[[i for i in range(90) if labels[i] == c]]
            near = ((rows[:, None] - own) ** 2).sum(axis=2).argmin(axis=1)
            want = np.array([rows[near == j].mean(axis=0) if (near == j).any() else own[j] for j in range(len(own))])
            assert moved[c] == pytest.approx(want)
        centres = moved
    found = {r.row_id: r.client_id for r in D.assign_clusters(df, centres).collect()}
    assert found[99] is None
    assert all(found[i] == ((x[i] - centres[labels[i]]) ** 2).sum(axis=1).argmin() for i in range(90))


def test_labels_at_one_place_are_counted_for_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(0, 3)), "xyz"[rng.integers(0, 3)]) for i in range(80)] + [(200, None, "x"), (201, 0, None)]
    df = spark.createDataFrame(rows, "row_id bigint, client_id bigint, label string").repartition(3)
    lists = {str(c): [l for _, s, l in rows if s == c] for c in range(3)}
    lists["Global"] = [l for _, _, l in rows]
    want = {}
    for s in "012":
        for t, theirs in lists.items():
            for z, y in zip(lists[s], theirs):
                if z is not None and y is not None:
                    want[s, t, z, y] = want.get((s, t, z, y), 0) + 1
    for numbers in (X.JOINT_NUMBERS, 40):
        monkeypatch.setattr(X, "JOINT_NUMBERS", numbers)
        assert {(r.src, r.tgt, r.z, r.y): r.n for r in X.paired_label_counts(df).collect()} == want


def test_domain_classifiers_reach_the_newton_solution(spark):
    rng = np.random.default_rng(7)
    rows = [(i, i % 2, [float(rng.normal() + (i % 2))], [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(120)]
    df = spark.createDataFrame(rows + [(500, None, [1.0], [1.0, 0.0]), (501, 0, None, [1.0, 0.0])], "row_id bigint, client_id bigint, features array<double>, target array<double>")
    kept = Y.shift_rows(df, 4)
    data = kept.collect()
    pairs = Y.Pairs([0, 1])
    weights = Y.domain_classifiers(kept.where("client_id IS NOT NULL"), pairs, 2, 4, steps=60)
    for p, (s, t) in enumerate(pairs.all):
        for f in range(4):
            side = [(r.features[0], 0) for r in data if r.client_id == s and r.fold != f]
            side += [(r.features[0], 1) for r in data if (t == "Global" or r.client_id == t) and r.fold != f]
            a, y = np.array([[x, 1.0] for x, _ in side]), np.array([v for _, v in side])
            w = np.zeros(2)
            for _ in range(30):
                q = 1 / (1 + np.exp(-a @ w))
                w += np.linalg.solve((a.T * (q * (1 - q))) @ a + 1e-9 * np.eye(2), a.T @ (y - q))
            assert weights[p, f] == pytest.approx(w, abs=1e-3)
    models = {0: np.array([[1.0, 0.0], [-1.0, 0.0]]), 1: np.array([[0.0, 1.0], [0.0, 0.0]])}
    got = {(r.src, r.tgt): r for r in Y.y_shift_features(df, models, 4, steps=3).collect()}
    assert len(got) == 6 and got["0", "0"].degradation == 0 and got["0", "0"].shift is None


def test_unknown_class_ends_the_encoding(spark):
    known = spark.createDataFrame([("a",), ("b",)], "label string")
    rows = spark.createDataFrame([("b",), (None,)], "label string")
    assert [r.class_index for r in P.encode_labels(rows, known).collect()] == [1, None]
    with pytest.raises(Exception, match="unknown class"):
        P.encode_labels(spark.createDataFrame([("c",)], "label string"), known).collect()
