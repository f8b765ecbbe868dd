"""Shapley values, metrics and rewards: properties and brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from silovalue.operators import combine as A, fit as T, metrics as M, rewards as G, shapley as S


def game(spark, n, v):
    rows = [(mask, "Accuracy", float(v[mask])) for mask in range(1, 2**n)]
    utility = spark.createDataFrame(rows, "mask bigint, metric string, value double")
    clients = spark.createDataFrame([(10 + i,) for i in range(n)], "client_id bigint")
    found = S.shapley_values(utility, clients, F.lit(float(v[0])), ["metric"]).collect()
    return np.array([r.value for r in sorted(found, key=lambda r: r.client_id)])


def by_orders(n, v):
    phi = np.zeros(n)
    orders = list(itertools.permutations(range(n)))
    for order in orders:
        mask = 0
        for i in order:
            phi[i] += v[mask | 1 << i] - v[mask]
            mask |= 1 << i
    return phi / len(orders)


def test_lattice_equals_all_orders(spark):
    v = np.random.RandomState(0).normal(size=32)
    found = game(spark, 5, v)
    assert np.allclose(found, by_orders(5, v), atol=1e-12)
    assert math.isclose(found.sum(), v[31] - v[0], abs_tol=1e-12)


def test_null_and_equal_players(spark):
    worth = lambda mask: (mask & 1) + (mask >> 1 & 1)
    found = game(spark, 3, [worth(m) for m in range(8)])
    assert np.allclose(found, [1, 1, 0], atol=1e-12)


def test_losses_are_turned_round(spark):
    utility = spark.createDataFrame([(1, "RMSE", 2.0), (2, "RMSE", 5.0), (3, "RMSE", 1.0)], "mask bigint, metric string, value double")
    clients = spark.createDataFrame([(0,), (1,)], "client_id bigint")
    found = {r.client_id: r.value for r in S.shapley_values(utility, clients, F.lit(6.0), ["metric"]).collect()}
    assert found == {0: pytest.approx(4.0), 1: pytest.approx(1.0)}


def test_too_many_players_are_refused(spark):
    clients = spark.range(13).withColumnRenamed("id", "client_id")
    with pytest.raises(Exception, match="more than 12"):
        S.coalitions(clients).collect()


def test_tree_scores_add_up_over_members(spark):
    base = spark.createDataFrame([(1, "a", 0.5)], "row_id int, class string, score double")
    members = spark.createDataFrame(
        [(0, 1, "a", 1.0), (1, 1, "a", 2.0), (2, 1, "a", 4.0)], "client_id int, row_id int, class string, score double"
    )
    found = {r["mask"]: r.score for r in S.tree_coalition_scores(base, members, ["row_id"]).collect()}
    assert found == {m: 0.5 + m for m in range(1, 8)}


def test_bagging_numbers_trees_on(spark):
    base = spark.createDataFrame([(9, 0, 0.1), (9, 1, 0.2)], "client_id int, tree_id bigint, score double")
    new = spark.createDataFrame([(1, 0, 1.0), (1, 0, 1.5), (1, 1, 2.0), (2, 0, 3.0)], "client_id int, tree_id bigint, score double")
    pooled = A.bag_trees(base, new).collect()
    assert sorted((r.client_id, r.tree_id, r.score) for r in pooled) == [
        (1, 2, 1.0), (1, 2, 1.5), (1, 3, 2.0), (2, 4, 3.0), (9, 0, 0.1), (9, 1, 0.2)
    ]
    assert sorted(r.tree_id for r in A.bag_trees(None, new).collect()) == [0, 0, 1, 2]


def counted(spark, cells):
    return spark.createDataFrame([("e", t, p, n, 0.0) for t, p, n in cells], "evaluator string, label string, predicted string, n bigint, ce double")


def test_class_metrics_by_hand(spark):
    counts = counted(spark, [("a", "a", 5), ("a", "b", 2), ("b", "b", 3), ("c", "a", 1)])
    labels = F.array(*[F.lit(x) for x in "abcd"])
    found = {r.metric: r.value for r in M.classification_metrics(counts, ["evaluator"], labels).collect()}
    f1 = [2 * 5 / (7 + 6), 2 * 3 / (3 + 5), 0, 0]
    assert found["Accuracy"] == pytest.approx(8 / 11) and found["F1ScoreMicro"] == pytest.approx(8 / 11)
    assert found["F1ScoreMacro"] == pytest.approx(sum(f1) / 4)
    assert found["WeightedF1Score"] == pytest.approx((7 * f1[0] + 3 * f1[1]) / 11)
    s, c, pt = 11, 8, 7 * 6 + 3 * 5
    assert found["MCC"] == pytest.approx((c * s - pt) / math.sqrt((s * s - 36 - 25) * (s * s - 49 - 9 - 1)))


def test_undefined_metrics_are_zero(spark):
    counts = counted(spark, [("a", "a", 4)])
    labels = F.array(F.lit("a"), F.lit("b"))
    found = {r.metric: r.value for r in M.classification_metrics(counts, ["evaluator"], labels).collect()}
    assert found["MCC"] == 0 and found["F1ScoreMacro"] == 0.5


def test_r2_of_a_constant_target(spark):
    rows = spark.createDataFrame([("x", 2.0, 2.0), ("x", 2.0, 2.0), ("y", 2.0, 3.0), ("y", 2.0, 2.0)], "evaluator string, y double, y_hat double")
    counts = M.regression_counts(rows, ["evaluator"])
    found = {r.evaluator: r.value for r in M.regression_metric(counts, ["evaluator"], "R2").collect()}
    assert found == {"x": 1.0, "y": 0.0}


def test_unknown_metric_is_refused(spark):
    rows = spark.createDataFrame([(1, 2.0, 2.0)], "client_id int, y double, y_hat double")
    with pytest.raises(ValueError, match="unknown metrics"):
        M.evaluate(rows, ["Precision"])


def test_squared_rmse_values_on_request(spark):
    sv = spark.createDataFrame([("0", "RMSE", 7, 3.0), ("1", "RMSE", 7, -1.0)], "evaluator string, metric string, client_id int, value double")
    shares = spark.createDataFrame([(0, 0.25), (1, 0.75)], "client_id int, share double")
    keys = ["metric", "client_id"]
    assert S.shapley_aggregated(sv, shares, None, keys).first().value == pytest.approx(0.0)
    assert S.shapley_aggregated(sv, shares, None, keys, squared_rmse=True).first().value == pytest.approx(3.0)


def test_rewards_of_like_and_unlike_gradients(spark):
    rows = [(0, 0, 2.0), (0, 1, 0.0), (1, 0, 1.0), (1, 1, 0.0), (2, 0, 0.0), (2, 1, 3.0), (3, 0, 0.0), (3, 1, 0.0)]
    gradients = spark.createDataFrame(rows, "client_id int, pos int, value double")
    sizes = spark.createDataFrame([(0, 10), (1, 10), (2, 5), (3, 5)], "client_id int, n int")
    found = {r.client_id: r.value for r in G.gradient_reward(gradients, sizes, ["pos"]).collect()}
    norm = math.sqrt(20**2 + 5**2)
    assert found == {0: pytest.approx(20 / norm), 1: pytest.approx(20 / norm), 2: pytest.approx(5 / norm), 3: 0.0}


def silo_rows(spark, n=60, d=3, k=3, silos=2, seed=1):
    random = np.random.RandomState(seed)
    x = random.normal(size=(n, d))
    y = (x @ random.normal(size=(d, k))).argmax(axis=1)
    rows = [(i, int(i % silos), [float(v) for v in x[i]], [1.0 if c == y[i] else 0.0 for c in range(k)]) for i in range(n)]
    return spark.createDataFrame(rows, "row_id bigint, client_id bigint, features array<double>, target array<double>"), x, y


def test_gradient_is_the_slope_of_the_loss(spark):
    df, _, _ = silo_rows(spark)
    models = {0: np.random.RandomState(2).normal(size=(3, 4)), 1: np.zeros((3, 4))}
    step = T.gradient_step(df, models)
    for i, j in ((0, 0), (2, 3)):
        moved = {s: w.copy() for s, w in models.items()}
        for w in moved.values():
            w[i, j] += 1e-5
        other = T.gradient_step(df, moved)
        for s in models:
            assert (other.loss[s] - step.loss[s]) / 1e-5 == pytest.approx(step.gradient[s][i, j], abs=1e-4)


def test_mean_absolute_error_gradient(spark):
    df = spark.createDataFrame([(0, [1.0], [3.0]), (0, [2.0], [-1.0])], "client_id int, features array<double>, target array<double>")
    step = T.gradient_step(df, {0: np.zeros((1, 2))}, "MAE")
    assert step.loss[0] == 2.0 and np.allclose(step.gradient[0], [[(-1 + 2) / 2, 0.0]])


def test_rounds_lower_the_loss_and_average_by_rows(spark):
    df, x, _ = silo_rows(spark)
    run = T.federated_rounds(df, 4, rate=1.0, local_steps=2)
    means = [np.mean(list(step.values())) for step in run.losses]
    assert means[-1] < means[0] and run.rows == {0: 30, 1: 30}
    assert np.allclose(run.models[-1], (run.silo_models[-1][0] + run.silo_models[-1][1]) / 2)


def test_outcomes_count_every_row_once_per_model(spark):
    df, x, y = silo_rows(spark)
    w = np.random.RandomState(5).normal(size=(3, 4))
    got = T.class_outcomes(df, {"m": w, "zero": np.zeros((3, 4))}).collect()
    predicted = (T.with_bias(x) @ w.T).argmax(axis=1)
    assert sum(r.n for r in got if r.model == "m") == 60
    assert sum(r.n for r in got if r.model == "m" and r.true == r.predicted) == int((predicted == y).sum())
    assert sum(r.ce for r in got if r.model == "zero") == pytest.approx(60 * math.log(3))


def test_early_stop_keeps_the_best_model(spark):
    df, _, _ = silo_rows(spark)
    models, history = T.early_stop(df, max_steps=6, rate=50.0, patience=2)
    for s in (0, 1):
        losses = [h[3] for h in history if h[1] == s]
        after_best = len(losses) - 1 - losses.index(min(losses))
        assert after_best <= 2 and models[s].shape == (3, 4)


def test_distilled_model_nears_its_teachers(spark):
    df, _, _ = silo_rows(spark)
    teacher = np.random.RandomState(3).normal(size=(3, 4))
    _, losses = T.distill_soft_labels(df, [teacher, teacher], np.zeros((3, 4)), rate=1.0, steps=4)
    assert losses == sorted(losses, reverse=True)


def test_decay():
    assert T.decayed(0.1, 0.9, 20, 10) == pytest.approx(0.1 * 0.9**2)
