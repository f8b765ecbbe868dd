"""Registered queries: combining silo results, rounds, ensembles, pooled trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from silovalue.functions.lineage import control_table, small_side
from silovalue.operators import combine as A, count_model, metrics as M, shapley as S
from silovalue.plans import fixtures as fx
from silovalue.plans.catalog import query, view
from silovalue.plans.fixtures import rounded

KEY = ["evaluator"]


def _profile(model: fx.EventModel) -> DataFrame:
    """Rows per silo, split and class, from the counted table."""
    return model.counts.groupBy("client_id", "split", "label").agg(F.sum("n").alias("n"))


def _by_silo(spark, d):
    """The event model, its profile, and the scalar and class metrics of the pooled model on every silo."""
    model = fx.EventModel(spark, d)
    counts = control_table(M.add_global(M.class_counts(fx.predictions(spark, d, model), model.labels, ["client_id"])))
    return model, _profile(model), counts


@query("weighted_loss", """
SELECT 'events' AS experiment, round(sum(n * loss) / sum(n), 6) AS value FROM (
  SELECT evaluator, sum(n) AS n, sum(ce) / sum(n) AS loss FROM confusion WHERE evaluator <> 'Global' GROUP BY evaluator)""")
def weighted_loss(spark, d):
    _, _, counts = _by_silo(spark, d)
    losses = counts.where(F.col("evaluator") != M.GLOBAL).groupBy("evaluator").agg(
        F.sum("n").alias("n"), (F.sum("ce") / F.sum("n")).alias("loss")
    )
    return rounded(A.weighted_loss(losses.withColumn("experiment", F.lit("events")), ["experiment"]))


@query("aggregate_metric", """
SELECT metric, round(sum(share * value), 6) AS value FROM scalar_metrics m
JOIN shares s ON m.evaluator = CAST(s.client_id AS VARCHAR) GROUP BY metric""")
def aggregate_metric(spark, d):
    model, profile, counts = _by_silo(spark, d)
    values = M.classification_metrics(counts, KEY, model.labels)
    return rounded(A.aggregate_metric(values, A.train_shares(profile), ["metric"]))


@query("aggregate_f1", """
SELECT 'F1Score' AS metric, m.class, round(coalesce(sum(share * value), 0), 6) AS value FROM f1_table m
JOIN label_shares s ON m.evaluator = CAST(s.client_id AS VARCHAR) AND m.class = s.class GROUP BY m.class""")
def aggregate_f1(spark, d):
    model, profile, counts = _by_silo(spark, d)
    values = M.f1_per_class(counts, KEY, model.labels).withColumn("metric", F.lit(M.PER_CLASS))
    return rounded(A.aggregate_f1(values, A.class_shares(profile), ["metric"]))


view("order_shares", """
SELECT client_id, count(*)::DOUBLE / (SELECT count(*) FROM silo_orders) AS share FROM silo_orders GROUP BY client_id""")


def _order_rmse(spark, d):
    counts = fx.regression_counts(spark, d).where(F.col("evaluator") != M.GLOBAL)
    total = counts.agg(F.sum("n")).scalar()
    shares = counts.select(F.col("evaluator").alias("client_id"), (F.col("n") / total).alias("share"))
    return M.regression_metric(counts, KEY, "RMSE").withColumn("metric", F.lit("RMSE")), shares


@query("aggregate_rmse", """
SELECT 'RMSE' AS metric, round(sqrt(sum(share * value * value)), 4) AS value, round(sum(share * value), 4) AS plain
FROM (SELECT client_id, sqrt(avg((y - y_hat) ** 2)) AS value FROM regression_predictions GROUP BY client_id)
JOIN order_shares USING (client_id)""")
def aggregate_rmse(spark, d):
    values, shares = _order_rmse(spark, d)
    rooted = A.aggregate_rmse(values, shares, ["metric"])
    plain = A.aggregate_rmse(values, shares, ["metric"], plain=True).withColumnRenamed("value", "plain")
    return rounded(rooted.join(plain, "metric"), 4)


@query("aggregate_all", """
SELECT m.metric, NULL::VARCHAR AS class, round(sum(share * value), 6) AS value FROM scalar_metrics m
JOIN shares s ON m.evaluator = CAST(s.client_id AS VARCHAR) GROUP BY metric
UNION ALL SELECT 'F1Score', m.class, round(coalesce(sum(share * value), 0), 6) FROM f1_table m
JOIN label_shares s ON m.evaluator = CAST(s.client_id AS VARCHAR) AND m.class = s.class GROUP BY m.class""")
def aggregate_all(spark, d):
    model, profile, counts = _by_silo(spark, d)
    scalar = M.classification_metrics(counts, KEY, model.labels).withColumn("class", F.lit(None).cast("string"))
    listed = M.f1_per_class(counts, KEY, model.labels).withColumn("metric", F.lit(M.PER_CLASS))
    values = scalar.unionByName(listed)
    return rounded(A.aggregate_all(values, A.train_shares(profile), A.class_shares(profile), ["metric"]))


@query("global_metric", "SELECT metric, round(value, 6) AS value FROM scalar_metrics WHERE evaluator = 'Global'")
def global_metric(spark, d):
    model, _, counts = _by_silo(spark, d)
    pooled = counts.where(F.col("evaluator") == M.GLOBAL)
    return rounded(M.classification_metrics(pooled, KEY, model.labels).select("metric", "value"))


@query("average_parameters", "SELECT bucket, label, round(value, 6) AS value FROM global_params")
def average_parameters(spark, d):
    return rounded(fx.EventModel(spark, d).global_params())


@query("fit_per_client", "SELECT client_id, bucket, label, round(value, 6) AS value, n_examples FROM params")
def fit_per_client(spark, d):
    return rounded(fx.EventModel(spark, d).params())


@query("previous_round", """
SELECT evaluator, metric, round, round(value, 6) AS value,
       round(lag(value) OVER (PARTITION BY evaluator, metric ORDER BY round), 6) AS previous
FROM round_evaluation WHERE metric IN ('Accuracy', 'MCC', 'CrossEntropyLoss', 'F1ScoreMacro')""")
def previous_round(spark, d):
    names = ["CrossEntropyLoss", "Accuracy", "F1ScoreMacro", "MCC"]
    evaluation = fx.round_evaluation(fx.round_utility(fx.round_model(spark, d), names)).drop("class")
    return rounded(A.previous_round(evaluation, ["evaluator", "metric"]))


@query("scale_rate_by_share", "SELECT client_id, round(0.3 * share, 6) AS rate FROM shares")
def scale_rate_by_share(spark, d):
    return rounded(A.scale_rate_by_share(_profile(fx.EventModel(spark, d)), 0.3))


# ---------------------------------------------------------------- trees
# A silo's tree of the event data has one leaf per bucket; its leaf score for a class is the log of the class
# probability counted on one third of its rows, so three trees per silo come out of one count.

TREES = 3

view("tree_nodes", """
SELECT client_id, fold AS tree_id, bucket, label AS class,
       ln((coalesce(k, 0) + 1.0::DOUBLE) / (coalesce(total, 0) + (SELECT count(*) FROM class_names))) AS score
FROM train_sizes CROSS JOIN (SELECT unnest([0, 1, 2]) AS fold) CROSS JOIN bucket_names CROSS JOIN class_names
LEFT JOIN (SELECT client_id, row_id % 3 AS fold, bucket, label, count(*) AS k FROM silo_events
           WHERE split = 'train' GROUP BY ALL) USING (client_id, fold, bucket, label)
LEFT JOIN (SELECT client_id, row_id % 3 AS fold, bucket, count(*) AS total FROM silo_events
           WHERE split = 'train' GROUP BY ALL) USING (client_id, fold, bucket)""")


def _trees(model: fx.EventModel) -> DataFrame:
    fitted = count_model.fit_per_client(model.train, model.labels, model.buckets, extra=("fold",))
    return fitted.select(
        "client_id", F.col("fold").alias("tree_id"), "bucket", F.col("label").alias("class"), F.ln("value").alias("score")
    )


@query("bag_trees", """
SELECT client_id, b.tree_id + 3 + 3 * pos AS tree_id, bucket, class, round(score, 6) AS score
FROM tree_nodes b JOIN player_list USING (client_id)
UNION ALL SELECT client_id, tree_id, bucket, class, round(score, 6) FROM tree_nodes
WHERE client_id = (SELECT min(client_id) FROM player_list)""")
def bag_trees(spark, d):
    trees = _trees(fx.round_model(spark, d))
    base = trees.where(F.col("client_id") == trees.agg(F.min("client_id")).scalar())
    return rounded(A.bag_trees(base, trees))


@query("ensemble_average", """
SELECT row_id, class, round(avg(score), 6) AS score
FROM (SELECT * FROM silo_events WHERE split = 'test') t JOIN tree_nodes n ON t.bucket = n.bucket
GROUP BY row_id, class""")
def ensemble_average(spark, d):
    """The average over models depends on the bucket only, so models are averaged before they meet the rows."""
    means = A.ensemble_average(_trees(fx.round_model(spark, d)), ["bucket", "class"])
    rows = fx.test_rows(spark, d).select("row_id", "bucket")
    return rounded(rows.join(small_side(means), "bucket").select("row_id", "class", "score"))


view("silo_outputs", """
SELECT client_id AS model, bucket, label, exp(value) / sum(exp(value)) OVER (PARTITION BY client_id, bucket) AS p FROM params""")
view("ensemble_outputs", """
SELECT bucket, list(p ORDER BY label) AS probs, arg_max(label, (p, -pos)) AS predicted FROM (
  SELECT bucket, label, avg(p) AS p, row_number() OVER (PARTITION BY bucket ORDER BY label) AS pos
  FROM silo_outputs GROUP BY bucket, label) GROUP BY bucket""")


@query("ensemble_evaluate", """
SELECT client_id, round(avg(-ln(e.p)), 6) AS loss, round(avg(CASE WHEN o.predicted = t.label THEN 1.0 ELSE 0 END), 6) AS accuracy
FROM (SELECT * FROM silo_events WHERE split = 'test') t JOIN ensemble_outputs o ON t.bucket = o.bucket
JOIN (SELECT bucket, label, avg(p) AS p FROM silo_outputs GROUP BY bucket, label) e
  ON e.bucket = t.bucket AND e.label = t.label GROUP BY client_id""")
def ensemble_evaluate(spark, d):
    model = fx.EventModel(spark, d)
    silos = [r[0] for r in model.silos.orderBy("client_id").collect()]
    vectors = model.params().groupBy("bucket", "client_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("label", "value"))), lambda s: s["value"]).alias("v")
    ).groupBy("bucket").agg(*[F.max(F.when(F.col("client_id") == s, F.col("v"))).alias(f"m{s}") for s in silos])
    rows = fx.test_rows(spark, d).join(small_side(vectors), "bucket")
    return rounded(A.ensemble_evaluate(rows, [f"m{s}" for s in silos], model.labels, ["client_id"]))


# ---------------------------------------------------------------- Shapley values over rounds


@query("shapley_rounds", """
SELECT round, evaluator, metric, class, client_id, round(value, 6) AS value FROM round_shapley""")
def shapley_rounds(spark, d):
    model = fx.round_model(spark, d)
    return rounded(fx.round_shapley(model, fx.round_utility(model)))


def _round_sv(spark, d, names):
    model = fx.round_model(spark, d)
    return model, fx.round_shapley(model, fx.round_utility(model, names))


@query("shapley_aggregated", """
SELECT round, metric, NULL::VARCHAR AS class, v.client_id, round(sum(share * value), 6) AS value
FROM round_shapley v JOIN shares s ON v.evaluator = CAST(s.client_id AS VARCHAR)
WHERE metric IN ('CrossEntropyLoss', 'MCC') GROUP BY round, metric, v.client_id
UNION ALL SELECT round, metric, v.class, v.client_id, round(sum(share * value), 6)
FROM round_shapley v JOIN label_shares s ON v.evaluator = CAST(s.client_id AS VARCHAR) AND v.class = s.class
WHERE metric = 'F1Score' GROUP BY round, metric, v.class, v.client_id""")
def shapley_aggregated(spark, d):
    model, sv = _round_sv(spark, d, ["CrossEntropyLoss", "MCC", M.PER_CLASS])
    profile = _profile(model)
    return rounded(S.shapley_aggregated(
        sv, A.train_shares(profile), A.class_shares(profile), ["round", "metric", "client_id"]
    ).select("round", "metric", "class", "client_id", "value"))


@query("shapley_totals", """
SELECT evaluator, metric, client_id, round(sum(value), 6) AS value FROM round_shapley
WHERE metric IN ('CrossEntropyLoss', 'MCC') GROUP BY ALL""")
def shapley_totals(spark, d):
    _, sv = _round_sv(spark, d, ["CrossEntropyLoss", "MCC"])
    return rounded(S.shapley_totals(sv, ["evaluator", "metric", "client_id"]))


@query("shapley_round_mean", """
SELECT evaluator, metric, class, client_id, round(avg(value), 6) AS value FROM round_shapley
WHERE metric IN ('MCC', 'F1Score') AND round < 3 GROUP BY ALL""")
def shapley_round_mean(spark, d):
    _, sv = _round_sv(spark, d, ["MCC", M.PER_CLASS])
    return rounded(S.shapley_round_mean(sv, ["evaluator", "metric", "class", "client_id"]))


@query("shapley_values_trees", """
WITH base AS (SELECT bucket, class, sum(score) AS score FROM tree_nodes WHERE tree_id = 0 GROUP BY ALL),
added AS (SELECT client_id, bucket, class, sum(score) AS score FROM tree_nodes WHERE tree_id > 0 GROUP BY ALL),
scores AS (SELECT m.mask, a.bucket, a.class, any_value(b.score) + sum(a.score) AS score
  FROM added a JOIN member_table m USING (client_id) JOIN base b ON b.bucket = a.bucket AND b.class = a.class GROUP BY ALL
  UNION ALL SELECT 0, bucket, class, score FROM base),
probs AS (SELECT mask, bucket, class, exp(score - max(score) OVER w) / sum(exp(score - mx)) OVER w AS p
  FROM (SELECT *, max(score) OVER (PARTITION BY mask, bucket) AS mx FROM scores)
  WINDOW w AS (PARTITION BY mask, bucket)),
utility AS (SELECT mask, sum(n * -ln(least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16))) / sum(n) AS value
  FROM probs p JOIN test_counts t ON t.evaluator = 'Global' AND t.bucket = p.bucket AND t.label = p.class GROUP BY mask)
SELECT p.client_id, round(sum((o.value - w.value) * factorial(CAST(bit_count(w.mask) - 1 AS INTEGER))::DOUBLE
  * factorial(CAST(players - bit_count(w.mask) AS INTEGER))::DOUBLE / factorial(CAST(players AS INTEGER))::DOUBLE), 6) AS value
FROM utility w JOIN player_list p ON (w.mask >> p.pos) & 1 = 1
JOIN utility o ON o.mask = w.mask - (1 << CAST(p.pos AS INTEGER)) GROUP BY p.client_id""")
def shapley_values_trees(spark, d):
    """The base ensemble holds every silo's first tree; a coalition adds its members' later trees."""
    from silovalue.functions import arrays

    model = fx.round_model(spark, d)
    trees = _trees(model)
    base = trees.where(F.col("tree_id") == 0).groupBy("bucket", "class").agg(F.sum("score").alias("score"))
    added = trees.where(F.col("tree_id") > 0).groupBy("client_id", "bucket", "class").agg(F.sum("score").alias("score"))
    scores = S.tree_coalition_scores(base, added, ["bucket"]).unionByName(
        base.withColumn("mask", F.lit(0).cast("bigint"))
    )
    probabilities = scores.groupBy("mask", "bucket").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("class", "score"))), lambda s: s["score"]).alias("s")
    ).select("mask", "bucket", arrays.softmax(F.col("s")).alias("probs"))
    test = model.test.groupBy("bucket", "label").agg(F.sum("n").alias("n"))
    p_true = F.element_at("probs", F.array_position(model.labels, F.col("label")).cast("int"))
    utility = test.join(probabilities, "bucket").groupBy("mask").agg(
        (F.sum(F.col("n") * M.cross_entropy(p_true)) / F.sum("n")).alias("value")
    ).withColumn("metric", F.lit("CrossEntropyLoss"))
    start = utility.where(F.col("mask") == 0).select("metric", "value")
    sv = S.shapley_values(utility.where(F.col("mask") > 0), model.silos, start, ["metric"])
    return rounded(sv.select("client_id", "value"))
