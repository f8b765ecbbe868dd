"""Regression values and tree values against plain NumPy, over all orders and all subsets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from silovalue.operators import fit as T, distance as D, linear_value as L, trees

SILOS = "abcd"


def data(seed, rows=160):
    rng = np.random.default_rng(seed)
    x = rng.normal(3, 2, size=(rows, 2))
    y = 50_000 + x @ [3.0, -2.0] + rng.normal(size=rows) + np.arange(rows) % 4
    return [(SILOS[i % 4], x[i].tolist(), float(y[i])) for i in range(rows)]


def frame(spark, rows):
    odd = [(None, [1.0, 1.0], 5.0), ("a", None, 5.0), ("a", [1.0, None], 5.0), ("b", [1.0, 2.0], None)]
    schema = "client_id string, features array<double>, y double, mask string"
    return L.clean_rows(spark.createDataFrame([(*r, "z") for r in rows + odd], schema).repartition(3))


def brute_utility(train, test):
    fits, sizes = {}, {}
    for s in SILOS:
        own = [(x, y) for c, x, y in train if c == s]
        a = np.hstack([np.array([x for x, _ in own]), np.ones((len(own), 1))])
        fits[s], sizes[s] = np.linalg.lstsq(a, np.array([y for _, y in own]), rcond=None)[0], len(own)
    out = {}
    for mask in range(16):
        members = [s for p, s in enumerate(SILOS) if mask >> p & 1]
        w = sum(sizes[s] * fits[s] for s in members) / sum(sizes[s] for s in members) if members else np.zeros(3)
        for evaluator in (*SILOS, "Global"):
            rows = [(x, y) for c, x, y in test if evaluator in (c, "Global")]
            x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            e = y - np.hstack([x, np.ones((len(x), 1))]) @ w
            values = {"MSE": (e**2).mean(), "RMSE": (e**2).mean() ** 0.5, "MAE": np.abs(e).mean(), "R2": 1 - (e**2).sum() / ((y - y.mean()) ** 2).sum()}
            out |= {(evaluator, mask, m): v for m, v in values.items()}
    return out


def test_utilities_and_values_equal_numpy(spark):
    train, test = data(1), data(2, 90)
    utility = L.coalition_utility_regression(frame(spark, train), frame(spark, test)).cache()
    want = brute_utility(train, test)
    got = {(r.evaluator, r["mask"], r.metric): r.value for r in utility.collect()}
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, rel=1e-7, abs=1e-7), key
    for r in L.shapley_values_regression(utility, frame(spark, train)).collect():
        bit = 1 << SILOS.index(r.client_id)
        sign = 1 if r.metric == "R2" else -1
        value = sum(
            math.factorial(bin(m).count("1")) * math.factorial(3 - bin(m).count("1")) / 24 * sign * (want[r.evaluator, m | bit, r.metric] - want[r.evaluator, m, r.metric])
            for m in range(16) if not m & bit)
        assert r.value == pytest.approx(value, rel=1e-6, abs=1e-6)


def test_all_orders_of_four_silos_give_the_exact_values(spark):
    train, test = frame(spark, data(3)), frame(spark, data(4, 90))
    listed = [(i, False, place, s) for i, order in enumerate(itertools.permutations(SILOS)) for place, s in enumerate(order, 1)]
    orders = spark.createDataFrame(listed, "pair int, turned boolean, place int, client_id string")
    sampled = L.shapley_sampled_regression(train, test, orders=orders)
    exact = L.shapley_values_regression(L.coalition_utility_regression(train, test, ("RMSE", "R2")), train)
    want = {(r.evaluator, r.metric, r.client_id): r.value for r in exact.collect()}
    got = {(r.evaluator, r.metric, r.client_id): r for r in sampled.collect()}
    assert got.keys() == want.keys()
    for key, r in got.items():
        assert r.value == pytest.approx(want[key], rel=1e-6, abs=1e-6) and r.orders == 24


def test_drawn_orders_come_with_their_reverse(spark):
    silos = spark.createDataFrame([(i,) for i in range(15)] + [(None,)], "client_id int")
    rows = L.sampled_orders(silos, 6, seed=3).collect()
    for pair in range(6):
        there, back = ([r.client_id for r in sorted(rows, key=lambda r: r.place) if r.pair == pair and r.turned is t] for t in (False, True))
        assert there == back[::-1] and sorted(there) == list(range(15))


def test_sampled_values_add_up_and_have_errors(spark):
    train, test = frame(spark, data(5)), frame(spark, data(6, 90))
    got = L.shapley_sampled_regression(train, test, pairs=8).where("evaluator = 'Global' AND metric = 'R2'").collect()
    utility = {r["mask"]: r.value for r in L.coalition_utility_regression(train, test, ("R2",)).where("evaluator = 'Global'").collect()}
    assert sum(r.value for r in got) == pytest.approx(utility[15] - utility[0], rel=1e-6)
    assert all(r.standard_error >= 0 and r.orders == 16 for r in got)
    with pytest.raises(ValueError):
        L.shapley_sampled_regression(train, test, metrics=("MAE",))


def grown_by_hand(x, y, edges, depth, rounds, rate, l2):
    """Boosted regression trees on one target, by recursion."""
    total = np.zeros(len(x))

    def grow(rows, level):
        slope = (total - y)[rows]
        leaf = np.where(rows, -rate * slope.sum() / (rows.sum() + l2), 0.0)
        if level == depth:
            return leaf
        best = (1e-9, None)
        for f, cuts in enumerate(edges):
            for cut in cuts:
                low = rows & (x[:, f] <= cut)
                high = rows & ~low
                if low.any() and high.any():
                    g = [(total - y)[s].sum() for s in (low, high, rows)]
                    gain = g[0] ** 2 / (low.sum() + l2) + g[1] ** 2 / (high.sum() + l2) - g[2] ** 2 / (rows.sum() + l2)
                    if gain > best[0]:
                        best = (gain, (low, high))
        return leaf if best[1] is None else grow(best[1][0], level + 1) + grow(best[1][1], level + 1)

    for _ in range(rounds):
        total = total + grow(np.ones(len(x), dtype=bool), 0)
    return total


def test_trees_equal_growing_by_hand(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 3)).round(1)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    rows = [(i, i % 2, x[i].tolist(), [float(y[i]), float(1 - y[i])]) for i in range(120)]
    odd = [(900, None, [0.0] * 3, [1.0, 0.0]), (901, 0, None, [1.0, 0.0]), (902, 1, [0.0, None, 0.0], [1.0, 0.0])]
    df = spark.createDataFrame(rows + odd, "row_id bigint, client_id bigint, features array<double>, target array<double>").repartition(4)
    edges = [[-1.0, -0.35, 0.05, 0.45], [-0.5, 0.05, 0.75], [0.05]]
    forest = trees.fit_trees_per_client(df, 2, rounds=3, depth=2, edges=edges)
    scored = {r.row_id: r.silo_scores for r in trees.silo_scores(df.select("row_id", "features"), forest).collect()}
    for silo in (0, 1):
        own = np.arange(120) % 2 == silo
        for c, target in enumerate((y, 1 - y)):
            want = grown_by_hand(x[own], target[own], edges, 2, 3, 0.3, 1.0)
            got = [scored[i][str(silo)][c] for i in np.flatnonzero(own)]
            assert got == pytest.approx(list(want))
    assert scored[901] is None and scored[902] is None
    assert len(trees.quantile_edges(trees.clean_rows(df), 4)) == 3
    utility = {(r.evaluator, r["mask"], r.metric): r.value for r in trees.tree_coalition_utility(df, forest).collect()}
    for mask in range(4):
        s = np.array([[sum(scored[i][str(p)][c] for p in (0, 1) if mask >> p & 1) for c in (0, 1)] for i in range(120)])
        p = np.exp(s) / np.exp(s).sum(axis=1, keepdims=True)
        true = (1 - y).astype(int)
        assert utility["Global", mask, "CrossEntropyLoss"] == pytest.approx(-np.log(p[np.arange(120), true]).mean())
        assert utility["Global", mask, "Accuracy"] == pytest.approx((s.argmax(axis=1) == true).mean())


def test_null_silos_and_null_vectors_in_moments(spark):
    rows = [(1, [1.0, 2.0]), (None, [3.0, 4.0]), (None, [5.0, 6.0]), (1, None)]
    df = spark.createDataFrame(rows, "client_id bigint, features array<double>")
    got = {r.client_id: (r.n, r.means) for r in D.gramian(df).collect()}
    assert got["Global"] == (3, [3.0, 4.0]) and got["1"] == (1, [1.0, 2.0]) and got[None] == (2, [4.0, 5.0])


def test_gradient_sums_leave_incomplete_rows_out(spark):
    rows = [(0, [1.0], [1.0, 0.0]), (None, [1.0], [1.0, 0.0]), (0, None, [1.0, 0.0]), (0, [3.0], None)]
    df = spark.createDataFrame(rows, "client_id bigint, features array<double>, target array<double>")
    step = T.gradient_step(df, T.zero_models([0], 2, 1))
    assert step.rows == {0: 1.0}
