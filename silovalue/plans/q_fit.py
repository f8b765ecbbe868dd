"""Registered queries: gradients, rewards, fitted models, distillation, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from silovalue.functions.lineage import cut_lineage
from silovalue.operators import combine as A, count_model, fit as T, metrics as M, prep as P, reduce as R, rewards as G
from silovalue.operators import shapley as S, trees
from silovalue.plans import fixtures as fx
from silovalue.plans.catalog import query, view
from silovalue.plans.fixtures import rounded

CLASSES = 10


def vectors(spark, d):
    """Training and test rows of the vector silos with one-hot targets."""
    rows = fx.silo_vectors(spark, d)
    labels = F.array(*[F.lit(i) for i in range(CLASSES)])
    return P.train_test_split(T.class_targets(rows, labels), fx.SEED)


def trained(spark, d):
    return vectors(spark, d).where(F.col("split") == "train")


def tested(spark, d):
    return vectors(spark, d).where(F.col("split") == "test")


# At the zero model every class has probability 1/10, so the gradient is a plain mean that SQL can check.
view("vector_train", """
SELECT * FROM silo_vectors WHERE md5('7:' || row_id) >= '4ccccccc'""")
view("zero_gradient", """
SELECT client_id, CAST(class * 65 + i AS BIGINT) AS pos, avg((0.1::DOUBLE - CASE WHEN label = class THEN 1 ELSE 0 END) * x) AS value
FROM (SELECT client_id, label, unnest(list_append(features, 1.0::DOUBLE)) AS x, unnest(range(65)) AS i FROM vector_train)
CROSS JOIN (SELECT unnest(range(10)) AS class) GROUP BY client_id, class, i""")


def _zero(silos):
    return T.zero_models(silos, CLASSES, 64)


def zero_gradient(spark, d):
    rows = trained(spark, d)
    silos = [r[0] for r in rows.select("client_id").distinct().collect()]
    return rows, T.loss_gradient(rows, _zero(silos))


@query("loss_gradient", "SELECT client_id, pos, round(value, 6) AS value FROM zero_gradient")
def loss_gradient(spark, d):
    return rounded(zero_gradient(spark, d)[1])


view("vector_sizes", "SELECT client_id, count(*) AS n FROM vector_train GROUP BY client_id")
view("reward_table", """
WITH norms AS (SELECT client_id, sqrt(sum(value * value)) AS norm FROM zero_gradient GROUP BY client_id),
unit AS (SELECT g.client_id, pos, CASE WHEN norm = 0 THEN 0 ELSE value / norm END AS value FROM zero_gradient g JOIN norms USING (client_id)),
pooled AS (SELECT pos, sum(n * value) AS p FROM unit JOIN vector_sizes USING (client_id) GROUP BY pos)
SELECT client_id, sum(value * p) / sqrt(sum(value * value) * sum(p * p)) AS value FROM unit JOIN pooled USING (pos) GROUP BY client_id""")


def rewards(spark, d):
    rows, gradient = zero_gradient(spark, d)
    sizes = rows.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))
    return G.gradient_reward(cut_lineage(gradient), sizes, ["pos"])


@query("gradient_reward", "SELECT client_id, round(value, 6) AS value FROM reward_table")
def gradient_reward(spark, d):
    return rounded(rewards(spark, d))


@query("gradient_reward_running", """
SELECT 1 AS round, client_id, round(avg(value) OVER (ORDER BY client_id), 6) AS value FROM reward_table""")
def gradient_reward_running(spark, d):
    return rounded(G.gradient_reward_running(rewards(spark, d).withColumn("round", F.lit(1))))


def federation(spark, d, rounds=3, local_steps=1):
    rows = cut_lineage(trained(spark, d).select("row_id", "client_id", "features", "target"))
    return rows, T.federated_rounds(rows, rounds, rate=2.0, local_steps=local_steps, decay=0.9, decay_steps=10)


@query("gradient_reward_totals", """
WITH grads AS (SELECT round, client_id, class * 65 + i AS pos, avg((0.1::DOUBLE - CASE WHEN label = class THEN 1 ELSE 0 END) * x) AS value
  FROM (SELECT round, client_id, label, unnest(list_append(features, 1.0::DOUBLE)) AS x, unnest(range(65)) AS i
        FROM vector_train JOIN round_numbers ON row_id % 3 < round)
  CROSS JOIN (SELECT unnest(range(10)) AS class) GROUP BY ALL),
norms AS (SELECT round, client_id, sqrt(sum(value * value)) AS norm FROM grads GROUP BY ALL),
unit AS (SELECT round, client_id, pos, CASE WHEN norm = 0 THEN 0 ELSE value / norm END AS value FROM grads JOIN norms USING (round, client_id)),
pooled AS (SELECT round, pos, sum(n * value) AS p FROM unit JOIN vector_sizes USING (client_id) GROUP BY ALL),
rewards AS (SELECT round, client_id, sum(value * p) / sqrt(sum(value * value) * sum(p * p)) AS value FROM unit JOIN pooled USING (round, pos) GROUP BY ALL)
SELECT client_id, round(sum(value), 6) AS value FROM rewards GROUP BY client_id""")
def gradient_reward_totals(spark, d):
    """Three rounds in which the silos' training rows grow, each at the untrained model."""
    rows = cut_lineage(trained(spark, d).select("row_id", "client_id", "features", "target"))
    silos, k, width = T.shape_of(rows)
    models = T.zero_models(silos, k, width)
    parts = [
        T.loss_gradient(rows.where(F.col("row_id") % 3 < r), models).withColumn("round", F.lit(r)) for r in (1, 2, 3)
    ]
    gradients = cut_lineage(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    sizes = rows.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))
    return rounded(G.gradient_reward_totals(G.gradient_reward(gradients, sizes, ["pos"], by=("round",))))


@query("federated_rewards")
def federated_rewards(spark, d):
    """Rewards of each round of a federated run, from the gradients at the shared model of that round."""
    rows, run = federation(spark, d)
    sizes = rows.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))
    return rounded(G.gradient_reward(T.gradient_table(run, rows), sizes, ["pos"], by=("round",)))


@query("federated_rounds")
def federated_rounds(spark, d):
    """Three rounds over the vector silos; Global metrics after each round from one scoring job."""
    _, run = federation(spark, d)
    models = {r: w for r, w in enumerate(run.models)}
    outcomes = T.class_outcomes(tested(spark, d), models)
    counts = outcomes.select(
        F.col("model").cast("int").alias("round"), "client_id", F.col("true").alias("label"), "predicted", "n", "ce"
    )
    pooled = cut_lineage(M.add_global(counts))
    labels = F.array(*[F.lit(i) for i in range(CLASSES)])
    return rounded(M.classification_metrics(pooled, ["round", "evaluator"], labels))


@query("federated_shapley")
def federated_shapley(spark, d):
    """Every coalition of the last round's silo models scored in one job, then the silos' values."""
    rows, run = federation(spark, d, rounds=2)
    last, silos = run.silo_models[-1], sorted(run.silo_models[-1])
    models = {0: run.models[-2]}
    for mask in range(1, 2 ** len(silos)):
        members = {s: last[s] for i, s in enumerate(silos) if mask >> i & 1}
        models[mask] = T.model_average(members, run.rows)
    outcomes = T.class_outcomes(tested(spark, d), models)
    counts = outcomes.select(
        F.col("model").cast("bigint").alias("mask"), "client_id", F.col("true").alias("label"), "predicted", "n", "ce"
    )
    utility = cut_lineage(M.cross_entropy_loss(M.add_global(counts), ["evaluator", "mask"]).withColumn("metric", F.lit("CrossEntropyLoss")))
    start = utility.where(F.col("mask") == 0).select("evaluator", "metric", "value")
    sv = S.shapley_values(utility.where(F.col("mask") > 0), rows.select("client_id"), start, ["evaluator", "metric"])
    return rounded(sv.select("evaluator", "client_id", "value"))


@query("fit_softmax_per_client")
def fit_softmax_per_client(spark, d):
    """One softmax model per silo, all silos moved by the same jobs; their losses on every silo's test rows."""
    rows = cut_lineage(trained(spark, d).select("client_id", "features", "target"))
    silos, k, width = T.shape_of(rows)
    models = T.zero_models(silos, k, width)
    for _ in range(3):
        step = T.gradient_step(rows, models)
        models = {s: models[s] - 2.0 * step.gradient[s] for s in models}
    outcomes = T.class_outcomes(tested(spark, d), models)
    return rounded(outcomes.groupBy("model", "client_id").agg((F.sum("ce") / F.sum("n")).alias("value")))


@query("early_stop")
def early_stop(spark, d):
    rows = cut_lineage(trained(spark, d).select("row_id", "client_id", "features", "target"))
    _, history = T.early_stop(rows, max_steps=4, rate=2.0)
    kinds = "step int, client_id bigint, train double, validation double"
    return rounded(spark.createDataFrame(history, kinds))


@query("fit_central")
def fit_central(spark, d):
    model, rows = T.fit_central(trained(spark, d), maxIter=10, regParam=0.01)
    scored = model.transform(rows)
    return rounded(scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy")))


@query("fit_central_linear", """
SELECT round(regr_slope(b, a), 4) AS slope, round(regr_intercept(b, a), 4) AS intercept FROM silo_lines""")
def fit_central_linear(spark, d):
    lines = fx.silo_lines(spark, d)
    rows = lines.select(F.array("a").alias("features"), F.col("b").alias("label"))
    model, _ = T.fit_central(rows, "linear")
    found = [(float(model.coefficients[0]), float(model.intercept))]
    return rounded(spark.createDataFrame(found, "slope double, intercept double"), 4)


@query("hyperparameter_search")
def hyperparameter_search(spark, d):
    return rounded(T.hyperparameter_search(trained(spark, d), 3)[1])


@query("fit_trees_per_client")
def fit_trees_per_client(spark, d):
    """Boosted trees per document silo group for document quality, as a table of leaves, pooled into one ensemble."""
    rows = document_features(spark, d)
    models = trees.fit_trees_per_client(rows, 1, rounds=2, depth=2)
    table = trees.tree_table(spark, models)
    return rounded(A.bag_trees(None, table).select("client_id", "tree_id", "class", "leaf", "score"))


def document_features(spark, d):
    docs = fx.silo_docs(spark, d)
    return cut_lineage(docs.select(
        "row_id", F.pmod(F.xxhash64("client_id"), F.lit(3)).alias("client_id"),
        F.array(F.log1p("n_chars"), (F.col("lang") == "en").cast("double"), F.col("toxic").cast("double")).alias("features"),
        F.array(F.col("label").cast("double")).alias("target"), "label",
    ))


@query("distill_soft_labels")
def distill_soft_labels(spark, d):
    rows, run = federation(spark, d, rounds=1, local_steps=2)
    teachers = list(run.silo_models[-1].values())
    _, losses = T.distill_soft_labels(rows, teachers, run.models[0], rate=2.0, steps=3)
    return rounded(spark.createDataFrame([(i, v) for i, v in enumerate(losses)], "step int, loss double"))


# The teacher of a test row is the averaged model, the student its own silo's model.
view("kd_rows", """
SELECT t.client_id, t.bucket, t.label, s.probs AS student, g.probs AS teacher, list_position(s.names, t.label) AS true_pos
FROM (SELECT * FROM silo_events WHERE split = 'test') t
JOIN (SELECT client_id, bucket, list(value ORDER BY label) AS probs, list(label ORDER BY label) AS names FROM params GROUP BY ALL) s
  ON s.client_id = t.client_id AND s.bucket = t.bucket
JOIN (SELECT bucket, list(value ORDER BY label) AS probs FROM global_params GROUP BY bucket) g ON g.bucket = t.bucket""")


def kd_rows(spark, d):
    model = fx.EventModel(spark, d)
    rows = fx.test_rows(spark, d)
    student = count_model.predict(rows, model.params(), ["client_id", "bucket"]).withColumnRenamed("probs", "student")
    both = count_model.predict(student, model.global_params(), ["bucket"]).withColumnRenamed("probs", "teacher")
    return both.select("client_id", F.array_position(model.labels, F.col("label")).cast("int").alias("true"), "student", "teacher")


@query("kd_loss", """
SELECT client_id, round(avg(-ln(student[true_pos])) + 0.2 / (2 * count(*)) * avg(list_sum(list_transform(range(1, 6),
  lambda i: teacher[i] * ln(teacher[i] / student[i])))), 6) AS value FROM kd_rows GROUP BY client_id""")
def kd_loss(spark, d):
    return rounded(T.kd_loss(kd_rows(spark, d), ["client_id"]))


@query("decoupled_kd_loss", """
WITH scored AS (SELECT client_id, true_pos, list_transform(student, lambda x: ln(x) / 4) AS zs, list_transform(teacher, lambda x: ln(x) / 4) AS zt FROM kd_rows),
soft AS (SELECT client_id, true_pos, list_transform(zs, lambda x: exp(x)) AS es, list_transform(zt, lambda x: exp(x)) AS et FROM scored),
probs AS (SELECT client_id, true_pos, es, et, list_sum(es) AS ss, list_sum(et) AS st FROM soft),
parts AS (SELECT client_id, es[true_pos] / ss AS ps, et[true_pos] / st AS pt, list_sum(list_transform(list_filter(range(1, 6), lambda i: i <> true_pos),
  lambda i: et[i] / (st - et[true_pos]) * ln((et[i] / (st - et[true_pos])) / (es[i] / (ss - es[true_pos]))))) AS rest FROM probs)
SELECT client_id, round(16 * avg(pt * ln(pt / ps) + (1 - pt) * ln((1 - pt) / (1 - ps)) + 8 * rest), 6) AS value FROM parts GROUP BY client_id""")
def decoupled_kd_loss(spark, d):
    rows = kd_rows(spark, d)
    logs = lambda c: F.transform(c, lambda x: F.ln(x))
    return rounded(T.decoupled_kd_loss(rows.withColumn("student", logs("student")).withColumn("teacher", logs("teacher")), ["client_id"]))


@query("pca_project")
def pca_project(spark, d):
    return R.pca_project(fx.silo_vectors(spark, d), 2).select("row_id", "label", "scores")


@query("lda_project")
def lda_project(spark, d):
    return R.lda_project(fx.silo_vectors(spark, d), 3).select("row_id", "label", "scores")
