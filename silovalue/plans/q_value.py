"""Registered queries: regression value of silos, exact and over sampled orders; fitted trees and their value."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from silovalue.functions.hashing import hash_below
from silovalue.functions.lineage import cut_lineage
from silovalue.operators import distance as X, domain_shift as Y, fit as T, linear_value as L, measures, metrics as M, prep as P, trees
from silovalue.plans import fixtures as fx
from silovalue.plans.catalog import query, view
from silovalue.plans.fixtures import rounded

PAIRS = 16


def price_rows(spark, d, owner: str = "client_id"):
    """(client_id, features, y, split): price in thousands from the account balance; the owner is a market segment or nation."""
    rows = fx.silo_orders(spark, d)
    if owner != "client_id":
        rows = rows.join(fx.read_table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_custkey"), "row_id").join(
            fx.read_table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), owner), "o_custkey").withColumn("client_id", F.col(owner))
    split = F.when(hash_below(fx.SEED, 0.3, "row_id"), "test").otherwise("train")
    return cut_lineage(rows.select("client_id", F.array(F.col("c_acctbal") / 10000).alias("features"), (F.col("y") / 1000).alias("y"), split.alias("split")))


def _parts(rows):
    return tuple(L.clean_rows(rows.where(F.col("split") == s)) for s in ("train", "test"))


view("price_rows", """
SELECT client_id, c_acctbal / 10000 AS x, y / 1000 AS y, CASE WHEN md5('7:' || row_id) < '4ccccccc' THEN 'test' ELSE 'train' END AS split
FROM silo_orders""")
view("price_fits", """
SELECT client_id, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS bias FROM price_rows WHERE split = 'train' GROUP BY client_id""")
view("price_players", """
SELECT *, row_number() OVER (ORDER BY client_id) - 1 AS pos, count(*) OVER () AS players FROM price_fits""")
view("price_models", """
SELECT 0::BIGINT AS mask, 0::DOUBLE AS slope, 0::DOUBLE AS bias
UNION ALL SELECT CAST(mask AS BIGINT), sum(n * slope) / sum(n), sum(n * bias) / sum(n)
FROM price_players, LATERAL (SELECT unnest(range(1, 1 << CAST(players AS INTEGER))) AS mask) WHERE (mask >> pos) & 1 = 1 GROUP BY mask""")
view("price_scored", """
SELECT evaluator, mask, sqrt(avg(e * e)) AS rmse, avg(e * e) AS mse, avg(abs(e)) AS mae, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2
FROM (SELECT evaluator, mask, y, y - slope * x - bias AS e FROM (
  SELECT client_id AS evaluator, x, y FROM price_rows WHERE split = 'test' UNION ALL SELECT 'Global', x, y FROM price_rows WHERE split = 'test')
  CROSS JOIN price_models) GROUP BY ALL""")
view("price_utility", """
SELECT evaluator, mask, 'RMSE' AS metric, rmse AS value, -1 AS direction FROM price_scored
UNION ALL SELECT evaluator, mask, 'MSE', mse, -1 FROM price_scored
UNION ALL SELECT evaluator, mask, 'MAE', mae, -1 FROM price_scored
UNION ALL SELECT evaluator, mask, 'R2', r2, 1 FROM price_scored""")


@query("coalition_utility_regression", "SELECT evaluator, mask, metric, round(value, 5) AS value FROM price_utility")
def coalition_utility_regression(spark, d):
    return rounded(L.coalition_utility_regression(*_parts(price_rows(spark, d))), 5)


@query("fit_linear_per_client", """
SELECT client_id, 0 AS pos, round(slope, 5) AS value, n AS n_examples FROM price_fits
UNION ALL SELECT client_id, 1, round(bias, 5), n FROM price_fits""")
def fit_linear_per_client(spark, d):
    train, _ = _parts(price_rows(spark, d))
    around = L.centre(train)
    return rounded(L.fit_linear_per_client(L.product_sums(train, around), around), 5)


@query("shapley_values_regression", """
SELECT w.evaluator, w.metric, p.client_id, round(sum(w.direction * (w.value - o.value)
  * factorial(CAST(bit_count(w.mask) - 1 AS INTEGER))::DOUBLE * factorial(CAST(players - bit_count(w.mask) AS INTEGER))::DOUBLE
  / factorial(CAST(players AS INTEGER))::DOUBLE), 5) AS value
FROM price_utility w JOIN price_players p ON (w.mask >> p.pos) & 1 = 1
JOIN price_utility o ON o.mask = w.mask - (1 << CAST(p.pos AS INTEGER)) AND o.evaluator = w.evaluator AND o.metric = w.metric GROUP BY ALL""")
def shapley_values_regression(spark, d):
    train, test = _parts(price_rows(spark, d))
    return rounded(L.shapley_values_regression(L.coalition_utility_regression(train, test), train), 5)


@query("shapley_values_sampled", f"""
WITH owned AS (SELECT c_nationkey AS client_id, c.c_acctbal / 10000 AS x, o_totalprice / 1000 AS y,
  CASE WHEN md5('7:' || o_orderkey) < '4ccccccc' THEN 'test' ELSE 'train' END AS split FROM orders JOIN customer c ON o_custkey = c_custkey),
fits AS (SELECT client_id, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS bias FROM owned WHERE split = 'train' GROUP BY client_id),
drawn AS (SELECT f.*, pair, row_number() OVER (PARTITION BY pair ORDER BY md5('1:' || pair || ':' || client_id), client_id) AS place, count(*) OVER (PARTITION BY pair) AS players
  FROM fits f, (SELECT unnest(range({PAIRS})) AS pair)),
orders_ AS (SELECT client_id, n, slope, bias, pair, false AS turned, place FROM drawn UNION ALL SELECT client_id, n, slope, bias, pair, true, players + 1 - place FROM drawn),
models AS (SELECT client_id, pair, turned, place, sum(n * slope) OVER w / sum(n) OVER w AS slope, sum(n * bias) OVER w / sum(n) OVER w AS bias
  FROM orders_ WINDOW w AS (PARTITION BY pair, turned ORDER BY place)
  UNION ALL SELECT DISTINCT NULL, pair, turned, 0, 0, 0 FROM orders_),
sums AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(y, x) AS c FROM owned WHERE split = 'test'),
scored AS (SELECT m.*, vy + slope * slope * vx - 2 * slope * c + (my - slope * mx - bias) ** 2 AS mse, vy FROM models m, sums),
steps AS (SELECT client_id, pair, place, lag(sqrt(mse)) OVER w - sqrt(mse) AS rmse, (lag(mse) OVER w - mse) / vy AS r2 FROM scored
  WINDOW w AS (PARTITION BY pair, turned ORDER BY place)),
gains AS (SELECT client_id, pair, avg(rmse) AS rmse, avg(r2) AS r2, count(*) AS orders FROM steps WHERE place > 0 GROUP BY ALL)
SELECT client_id, 'RMSE' AS metric, round(avg(rmse), 5) AS value, round(stddev_samp(rmse) / sqrt(count(*)), 5) AS standard_error, sum(orders)::BIGINT AS orders FROM gains GROUP BY client_id
UNION ALL SELECT client_id, 'R2', round(avg(r2), 5), round(stddev_samp(r2) / sqrt(count(*)), 5), sum(orders)::BIGINT FROM gains GROUP BY client_id""")
def shapley_values_sampled(spark, d):
    """The 25 nations as owners of orders: more than a lattice can hold."""
    train, test = _parts(price_rows(spark, d, "c_nationkey"))
    found = L.shapley_sampled_regression(train, test, PAIRS).where(F.col("evaluator") == "Global").drop("evaluator")
    return rounded(found, 5, "value", "standard_error")


# ---------------------------------------------------------------- trees

TREE_EDGES = [[0.1, 0.3, 0.5, 0.7, 0.9], [0.15, 0.35, 0.55, 0.75]]
FLAGS = ("A", "N", "R")


def line_rows(spark, d):
    """(client_id, features, target, split) of order lines: quantity and discount, the return flag as class."""
    lines = fx.read_table(spark, d, "lineitem")
    split = F.when(hash_below(fx.SEED, 0.3, "l_orderkey"), "test").otherwise("train")
    return cut_lineage(lines.select(
        (F.col("l_suppkey") % 5).alias("client_id"), F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("features"),
        F.array(*[(F.col("l_returnflag") == f).cast("double") for f in FLAGS]).alias("target"), split.alias("split")))


def stumps(rows):
    """One tree of depth 1 per silo and class."""
    return trees.fit_trees_per_client(rows.where(F.col("split") == "train"), len(FLAGS), rounds=1, depth=1, loss="softmax", edges=TREE_EDGES)


view("stump_rows", """
SELECT l_suppkey % 5 AS client_id, l_quantity / 50 AS a, l_discount * 10 AS b, l_returnflag AS label,
  CASE WHEN md5('7:' || l_orderkey) < '4ccccccc' THEN 'test' ELSE 'train' END AS split FROM lineitem""")
view("stump_cells", """
SELECT client_id, a, b, label, count(*) AS n FROM stump_rows WHERE split = 'train' GROUP BY ALL""")
view("stump_borders", "SELECT 0 AS feature, unnest([{}]) AS threshold UNION ALL SELECT 1, unnest([{}])".format(
    *(", ".join(f"{e}::DOUBLE" for e in edges) for edges in TREE_EDGES)))
view("stump_sums", """
SELECT client_id, class, feature, threshold, sum(n * s) AS g, sum(n) * 2 / 9.0::DOUBLE AS h,
  coalesce(sum(n * s) FILTER (WHERE x <= threshold), 0) AS gl, coalesce(sum(n) FILTER (WHERE x <= threshold), 0) * 2 / 9.0::DOUBLE AS hl
FROM (SELECT client_id, n, t.class, feature, threshold, CASE feature WHEN 0 THEN a ELSE b END AS x,
        1 / 3.0::DOUBLE - CASE WHEN label = ['A', 'N', 'R'][t.class + 1] THEN 1 ELSE 0 END AS s
      FROM stump_cells, (SELECT unnest([0, 1, 2]) AS class) t, stump_borders) GROUP BY ALL""")
view("stump_trees", """
SELECT * FROM (SELECT *, gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1) AS gain,
  row_number() OVER (PARTITION BY client_id, class ORDER BY gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) DESC, feature, threshold) AS best
  FROM stump_sums WHERE hl >= 1 AND h - hl >= 1) WHERE best = 1""")
view("stump_leaves", """
SELECT client_id, class, feature, threshold, true AS below, -0.3 * gl / (hl + 1) AS score FROM stump_trees
UNION ALL SELECT client_id, class, feature, threshold, false, -0.3 * (g - gl) / (h - hl + 1) FROM stump_trees""")


@query("fit_stumps_per_client", """
SELECT CAST(client_id AS VARCHAR) AS client_id, class::INT AS class, feature::INT AS feature, threshold, below, round(score, 6) AS score FROM stump_leaves""")
def fit_stumps_per_client(spark, d):
    table = trees.tree_table(spark, stumps(line_rows(spark, d)))
    one = F.element_at("conditions", 1)
    return rounded(table.select("client_id", "class", one["feature"].alias("feature"), one["threshold"].alias("threshold"), one["below"].alias("below"), "score"), 6, "score")


@query("shapley_values_fitted_trees", """
WITH cells AS (SELECT CAST(client_id AS VARCHAR) AS evaluator, a, b, label, count(*) AS n FROM stump_rows WHERE split = 'test' GROUP BY ALL
  UNION ALL SELECT 'Global', a, b, label, count(*) FROM stump_rows WHERE split = 'test' GROUP BY ALL),
places AS (SELECT DISTINCT a, b FROM cells),
owners AS (SELECT client_id, row_number() OVER (ORDER BY client_id) - 1 AS pos, count(*) OVER () AS players FROM (SELECT DISTINCT client_id FROM stump_trees)),
masks AS (SELECT CAST(unnest(range(0, 32)) AS BIGINT) AS mask),
member_scores AS (SELECT a, b, class, pos, score FROM places JOIN stump_leaves ON (CASE feature WHEN 0 THEN a ELSE b END <= threshold) = below JOIN owners USING (client_id)),
scored AS (SELECT mask, a, b, class, sum(CASE WHEN (mask >> pos) & 1 = 1 THEN score ELSE 0 END) AS s FROM member_scores, masks GROUP BY ALL),
probs AS (SELECT mask, a, b, class, exp(s) / sum(exp(s)) OVER (PARTITION BY mask, a, b) AS p FROM scored),
utility AS (SELECT evaluator, mask, sum(n * -ln(p)) / sum(n) AS value FROM cells c JOIN probs p ON p.a = c.a AND p.b = c.b AND ['A', 'N', 'R'][p.class + 1] = c.label GROUP BY ALL)
SELECT w.evaluator, p.client_id, round(sum((o.value - w.value) * factorial(CAST(bit_count(w.mask) - 1 AS INTEGER))::DOUBLE
  * factorial(CAST(players - bit_count(w.mask) AS INTEGER))::DOUBLE / factorial(CAST(players AS INTEGER))::DOUBLE), 7) AS value
FROM utility w JOIN owners p ON (w.mask >> p.pos) & 1 = 1
JOIN utility o ON o.evaluator = w.evaluator AND o.mask = w.mask - (1 << CAST(p.pos AS INTEGER)) GROUP BY ALL""")
def shapley_values_fitted_trees(spark, d):
    """What each silo's fitted trees add to the cross entropy on every silo's test rows and on all."""
    rows = line_rows(spark, d)
    utility = trees.tree_coalition_utility(rows.where(F.col("split") == "test"), stumps(rows))
    sv = trees.shapley_values_fitted_trees(utility.where(F.col("metric") == "CrossEntropyLoss"), rows.where(F.col("split") == "train"))
    return rounded(sv.select("evaluator", "client_id", "value"), 7)


# ---------------------------------------------------------------- regression and shift between silos


@query("performance_degradation_regression", """
WITH fits AS (SELECT client_id, slope, bias FROM price_fits
  UNION ALL SELECT 'Global', regr_slope(y, x), regr_intercept(y, x) FROM price_rows WHERE split = 'train'),
tests AS (SELECT client_id, x, y FROM price_rows WHERE split = 'test' UNION ALL SELECT 'Global', x, y FROM price_rows WHERE split = 'test'),
losses AS (SELECT f.client_id AS model, t.client_id AS silo, avg(abs(y - slope * x - bias)) AS value FROM tests t, fits f GROUP BY ALL)
SELECT a.model AS src, a.silo AS tgt, round(a.value - b.value, 5) AS value FROM losses a JOIN losses b ON b.silo = a.silo AND b.model = a.silo
WHERE a.model <> 'Global'""")
def performance_degradation_regression(spark, d):
    """Mean absolute error of each segment's model on the others' test rows against that of their own models."""
    return rounded(X.performance_degradation(L.cross_losses_regression(*_parts(price_rows(spark, d)))), 5)


@query("loss_gradient_mae", """
SELECT client_id, i::BIGINT AS pos, round(avg(CASE WHEN y < 150 THEN 1 WHEN y > 150 THEN -1 ELSE 0 END * CASE i WHEN 0 THEN x ELSE 1 END), 6) AS value
FROM price_rows, (SELECT unnest([0, 1]) AS i) WHERE split = 'train' GROUP BY ALL""")
def loss_gradient_mae(spark, d):
    """Mean gradient of the absolute error at the model that says 150 for every order."""
    rows = L.clean_rows(price_rows(spark, d).where(F.col("split") == "train"))
    silos = [r[0] for r in rows.select("client_id").distinct().collect()]
    return rounded(T.loss_gradient(rows.withColumn("target", F.array("y")), {s: np.array([[0.0, 150.0]]) for s in silos}, "MAE"))


view("shift_lines", """
SELECT l_suppkey % 5 AS client_id, l_quantity / 50 AS a, list_position(['A', 'N', 'R'], l_returnflag) - 1 AS label,
  ('0x' || substr(md5('13:' || l_orderkey), 1, 8))::BIGINT % 8 AS fold FROM lineitem""")
view("shift_domains", """
SELECT s.client_id AS src, t.tgt FROM (SELECT DISTINCT client_id FROM shift_lines) s,
  (SELECT DISTINCT CAST(client_id AS VARCHAR) AS tgt FROM shift_lines UNION ALL SELECT 'Global') t""")
view("shift_sides", """
SELECT src, tgt, 0 AS side, a, label, fold FROM shift_domains JOIN shift_lines ON client_id = src
UNION ALL SELECT src, tgt, 1, a, label, fold FROM shift_domains JOIN shift_lines ON tgt = 'Global' OR tgt = CAST(client_id AS VARCHAR)""")


@query("y_shift_features", """
WITH cells AS (SELECT src, tgt, side, a, fold, count(*)::DOUBLE AS n FROM shift_sides GROUP BY ALL),
sums AS (SELECT src, tgt, f.fold, sum(n) AS n, sum(n * a) AS x, sum(n * a * a) AS xx, sum(n * side) AS y, sum(n * side * a) AS xy
  FROM cells c, (SELECT unnest(range(8)) AS fold) f WHERE c.fold <> f.fold GROUP BY ALL),
fits AS (SELECT src, tgt, fold, 4 * (n * xy - x * y) / (n * xx - x * x) AS slope, 4 * ((y - (n * xy - x * y) / (n * xx - x * x) * x) / n - 0.5) AS bias FROM sums),
sizes AS (SELECT src, tgt, sum(side * n) / sum(n) AS alpha FROM cells GROUP BY ALL),
scored AS (SELECT s.src, s.tgt, side, alpha, 1 / (1 + exp(-slope * a - bias)) AS pi,
  CASE WHEN label = CASE WHEN 0.5 + 0.1 * s.src - a >= a THEN 0 ELSE 1 END THEN 1.0::DOUBLE ELSE 0 END AS hit
  FROM shift_sides s JOIN fits f ON f.src = s.src AND f.tgt = s.tgt AND f.fold = s.fold JOIN sizes z ON z.src = s.src AND z.tgt = s.tgt),
weighed AS (SELECT *, CASE side WHEN 0 THEN pi ELSE 1 - pi END / ((1 - alpha) * pi + alpha * (1 - pi)) AS w FROM scored),
found AS (SELECT src, tgt, avg(hit) FILTER (WHERE side = 0) - avg(hit) FILTER (WHERE side = 1) AS degradation,
  sum(w * hit) FILTER (WHERE side = 0) / sum(w) FILTER (WHERE side = 0) - sum(w * hit) FILTER (WHERE side = 1) / sum(w) FILTER (WHERE side = 1) AS shared
  FROM weighed GROUP BY ALL)
SELECT CAST(src AS VARCHAR) AS src, tgt, round(degradation, 6) AS degradation, round(shared, 6) AS shared FROM found""")
def y_shift_features(spark, d):
    """One Newton step of the domain classifiers on the quantity, with fixed class models, over all order lines."""
    lines = fx.read_table(spark, d, "lineitem")
    rows = lines.select(
        F.col("l_orderkey").alias("row_id"), (F.col("l_suppkey") % 5).alias("client_id"), F.array(F.col("l_quantity") / 50).alias("features"),
        F.array(*[(F.col("l_returnflag") == f).cast("double") for f in FLAGS]).alias("target"))
    models = {s: np.array([[-1.0, 0.5 + 0.1 * s], [1.0, 0.0], [0.0, -9.0]]) for s in range(5)}
    found = Y.y_shift_features(rows, models, steps=1, ridge=0.0)
    return rounded(found.drop("shift"))


# ---------------------------------------------------------------- all measures


def vector_silos(spark, d) -> measures.Silos:
    """The vector silos with one softmax step from zero as class models of each silo and of all rows."""
    labels = F.array(*[F.lit(i) for i in range(10)])
    rows = cut_lineage(P.train_test_split(T.class_targets(fx.silo_vectors(spark, d), labels), fx.SEED))
    train = rows.where(F.col("split") == "train")
    step = T.gradient_step(X.with_global_silo(train.select("client_id", "features", "target")), T.zero_models(["0", "1", "2", "3", "4", M.GLOBAL], 10, 64))
    models = {(int(s) if s != M.GLOBAL else s): -4.0 * g for s, g in step.gradient.items()}
    return measures.Silos(rows, models, 0.5)


@query("all_measures")
def all_measures(spark, d):
    return rounded(measures.all_measures(vector_silos(spark, d)))


view("vector_numbers", """
SELECT row_id, client_id, label, i, x FROM (SELECT row_id, client_id, label, unnest(list_append(features, 1.0::DOUBLE)) AS x, unnest(range(65)) AS i FROM silo_vectors)""")
view("vector_steps", """
SELECT CAST(s.client_id AS VARCHAR) AS silo, class, i, -4 * avg((0.1::DOUBLE - CASE WHEN label = class THEN 1 ELSE 0 END) * x) AS w
FROM (SELECT CAST(client_id AS VARCHAR) AS client_id, row_id, label, i, x FROM vector_numbers UNION ALL SELECT 'Global', row_id, label, i, x FROM vector_numbers) s,
  (SELECT unnest(range(10)) AS class) WHERE md5('7:' || row_id) >= '4ccccccc' GROUP BY ALL""")


@query("class_degradation", """
WITH models AS (SELECT silo, class, list(w ORDER BY i) AS w FROM vector_steps GROUP BY ALL),
tests AS (SELECT CAST(client_id AS VARCHAR) AS silo, row_id, label, list_append(features, 1.0::DOUBLE) AS x FROM silo_vectors WHERE md5('7:' || row_id) < '4ccccccc'),
scores AS (SELECT m.silo AS model, t.silo, row_id, label, class, list_dot_product(x, w) AS s FROM tests t, models m),
losses AS (SELECT model, silo, row_id, ln(sum(exp(s))) - max(s) FILTER (WHERE class = label) AS ce FROM scores GROUP BY ALL),
means AS (SELECT model, silo, avg(ce) AS value FROM losses GROUP BY ALL UNION ALL SELECT model, 'Global', avg(ce) FROM losses GROUP BY ALL)
SELECT 'performanceDegradation' AS measure, a.model AS src, a.silo AS tgt, round(a.value - b.value, 5) AS value FROM means a JOIN means b ON b.silo = a.silo AND b.model = a.silo
WHERE a.model <> 'Global'""")
def class_degradation(spark, d):
    """Cross entropy of each silo's softmax model on the others' test rows against their own models."""
    return rounded(measures.all_measures(vector_silos(spark, d), only=("performanceDegradation",)), 5)


@query("all_measures_regression")
def all_measures_regression(spark, d):
    """The measures that a regression target allows, of the order prices."""
    rows = price_rows(spark, d).withColumn("row_id", F.monotonically_increasing_id())
    return rounded(measures.all_measures(measures.Silos(rows), regression=True, only=("performanceDegradation", "relevance", "diversity", "volume")))
