"""Silo tables derived from the given tables, as DataFrames and as the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from silovalue.functions.hashing import hash_below
from silovalue.functions.lineage import control_table, small_side
from silovalue.operators import count_model, metrics as M
from silovalue.plans.catalog import view
from silovalue.sources.tables import dataset, read_table

SEED = 7
ROUNDS = 3


@dataset("events")
def silo_events(spark: SparkSession, d: str) -> DataFrame:
    """Class silos: owner = user_id % 4, class = event type, bucket = quarter of the day."""
    e = read_table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("row_id"), (F.col("user_id") % 4).alias("client_id"),
        F.when(hash_below(SEED, 0.3, "event_id"), "test").otherwise("train").alias("split"),
        F.col("event_type").alias("label"), F.floor(F.hour("ts") / 6).cast("bigint").alias("bucket"), "value",
    )


view("silo_events", """
SELECT event_id AS row_id, user_id % 4 AS client_id,
       CASE WHEN md5('7:' || event_id) < '4ccccccc' THEN 'test' ELSE 'train' END AS split,
       event_type AS label, CAST(hour(ts) // 6 AS BIGINT) AS bucket, value
FROM events""")


@dataset("embeddings")
def silo_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    return e.select(
        F.col("vec_id").alias("row_id"), (F.col("vec_id") % 5).alias("client_id"), "label",
        F.col("embedding").cast("array<double>").alias("features"),
    )


view("silo_vectors", """
SELECT vec_id AS row_id, vec_id % 5 AS client_id, label, CAST(embedding AS DOUBLE[]) AS features FROM embeddings""")


@dataset("documents")
def silo_docs(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    return docs.select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id").select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("client_id"), F.col("quality").alias("label"),
        "toxic", "lang", "n_chars",
    )


view("silo_docs", """
SELECT doc_id AS row_id, source AS client_id, quality AS label, toxic, lang, n_chars
FROM documents JOIN labels USING (doc_id)""")


@dataset("orders")
def silo_orders(spark: SparkSession, d: str) -> DataFrame:
    """Regression silos: target = order price, owner = market segment of the customer."""
    orders, customer = read_table(spark, d, "orders"), read_table(spark, d, "customer")
    rows = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus").join(
        customer.select("c_custkey", "c_mktsegment", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey")
    )
    return rows.select(
        F.col("o_orderkey").alias("row_id"), F.col("c_mktsegment").alias("client_id"),
        F.col("o_totalprice").alias("y"), "c_mktsegment", "c_acctbal", "o_orderpriority", "o_orderstatus",
    )


view("silo_orders", """
SELECT o_orderkey AS row_id, c_mktsegment AS client_id, o_totalprice AS y, c_mktsegment, c_acctbal,
       o_orderpriority, o_orderstatus
FROM orders JOIN customer ON o_custkey = c_custkey""")


@dataset("lines")
def silo_lines(spark: SparkSession, d: str) -> DataFrame:
    """Two numeric features per order line, spread over five owners; the largest table."""
    lines = read_table(spark, d, "lineitem")
    return lines.select(
        (F.col("l_suppkey") % 5).alias("client_id"), (F.col("l_quantity") / 50).alias("a"),
        (F.col("l_discount") * 10).alias("b"), F.col("l_returnflag").alias("label"),
    )


view("silo_lines", """
SELECT l_suppkey % 5 AS client_id, l_quantity / 50 AS a, l_discount * 10 AS b, l_returnflag AS label FROM lineitem""")


class EventModel:
    """The counted event table and what follows from it: class list, bucket list, count models.

    Rows are read once, when the counts are made.
    """

    def __init__(self, spark: SparkSession, d: str, extra: dict[str, Column] | None = None):
        extra = extra or {}
        rows = silo_events(spark, d).withColumns(extra) if extra else silo_events(spark, d)
        self.counts = count_model.count_rows(rows, ["client_id", "split", "bucket", "label", *extra])
        self.train = self.counts.where(F.col("split") == "train")
        self.test = self.counts.where(F.col("split") == "test")
        self.labels, self.buckets = count_model.literal_lists(self.train, ["label", "bucket"])
        self.silos = self.train.select("client_id").distinct()

    def params(self) -> DataFrame:
        return count_model.fit_per_client(self.train, self.labels, self.buckets)

    def global_params(self) -> DataFrame:
        return count_model.average_parameters(self.params(), ["bucket", "label"])


def test_rows(spark: SparkSession, d: str) -> DataFrame:
    return silo_events(spark, d).where(F.col("split") == "test")


view("class_names", "SELECT DISTINCT label FROM silo_events WHERE split = 'train'")
view("bucket_names", "SELECT DISTINCT bucket FROM silo_events WHERE split = 'train'")
view("train_sizes", """
SELECT client_id, count(*) AS n_examples FROM silo_events WHERE split = 'train' GROUP BY client_id""")
view("params", """
SELECT client_id, bucket, label,
       (coalesce(k, 0) + 1.0::DOUBLE) / (coalesce(total, 0) + (SELECT count(*) FROM class_names)) AS value, n_examples
FROM train_sizes CROSS JOIN bucket_names CROSS JOIN class_names
LEFT JOIN (SELECT client_id, bucket, label, count(*) AS k FROM silo_events WHERE split = 'train' GROUP BY ALL)
  USING (client_id, bucket, label)
LEFT JOIN (SELECT client_id, bucket, count(*) AS total FROM silo_events WHERE split = 'train' GROUP BY ALL)
  USING (client_id, bucket)""")
view("global_params", """
SELECT bucket, label, sum(n_examples * value) / sum(n_examples) AS value FROM params GROUP BY bucket, label""")


def predictions(spark: SparkSession, d: str, model: EventModel | None = None) -> DataFrame:
    """Test rows with the class probabilities of the averaged model."""
    model = model or EventModel(spark, d)
    return count_model.predict(test_rows(spark, d), model.global_params(), ["bucket"]).select(
        "row_id", "client_id", "label", "probs"
    )


# The class that wins, its probability for the true class, per test row.
view("predictions", """
SELECT row_id, client_id, t.label, v.probs, v.predicted, p.value AS p_true
FROM (SELECT * FROM silo_events WHERE split = 'test') t
JOIN (SELECT bucket, list(value ORDER BY label) AS probs, arg_max(label, (value, -pos)) AS predicted
      FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY label) AS pos FROM global_params)
      GROUP BY bucket) v USING (bucket)
JOIN global_params p ON p.bucket = t.bucket AND p.label = t.label""")
view("evaluated", """
SELECT CAST(client_id AS VARCHAR) AS evaluator, label, predicted, p_true FROM predictions
UNION ALL SELECT 'Global', label, predicted, p_true FROM predictions""")
view("confusion", """
SELECT evaluator, label, predicted, count(*) AS n, sum(-ln(p_true)) AS ce FROM evaluated GROUP BY ALL""")
view("marginals", """
SELECT evaluator, label AS class, sum(support) AS support, sum(predicted) AS predicted, sum(hits) AS hits FROM (
  SELECT evaluator, label, n AS support, 0 AS predicted, CASE WHEN label = predicted THEN n ELSE 0 END AS hits FROM confusion
  UNION ALL SELECT evaluator, predicted, 0, n, 0 FROM confusion
  UNION ALL SELECT evaluator, label, 0, 0, 0 FROM (SELECT DISTINCT evaluator FROM confusion) CROSS JOIN class_names)
GROUP BY ALL""")
view("f1_table", """
SELECT evaluator, class, support,
       CASE WHEN support + predicted = 0 THEN 0 ELSE 2.0::DOUBLE * hits / (support + predicted) END AS value FROM marginals""")
view("scalar_metrics", """
SELECT evaluator, 'CrossEntropyLoss' AS metric, sum(ce) / sum(n) AS value FROM confusion GROUP BY evaluator
UNION ALL SELECT evaluator, 'Accuracy', sum(hits)::DOUBLE / sum(support) FROM marginals GROUP BY evaluator
UNION ALL SELECT evaluator, 'F1ScoreMicro', sum(hits)::DOUBLE / sum(support) FROM marginals GROUP BY evaluator
UNION ALL SELECT evaluator, 'F1ScoreMacro', avg(value) FROM f1_table GROUP BY evaluator
UNION ALL SELECT evaluator, 'WeightedF1Score', sum(support * value) / sum(support) FROM f1_table GROUP BY evaluator
UNION ALL SELECT evaluator, 'MCC', CASE WHEN d = 0 THEN 0 ELSE (c * s - pt) / sqrt(d) END FROM (
  SELECT evaluator, sum(hits)::DOUBLE AS c, sum(support)::DOUBLE AS s, sum(predicted::DOUBLE * support) AS pt,
         (sum(support)::DOUBLE ** 2 - sum(predicted::DOUBLE ** 2)) * (sum(support)::DOUBLE ** 2 - sum(support::DOUBLE ** 2)) AS d
  FROM marginals GROUP BY evaluator)""")


def counts(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    """Counted predictions per evaluator, and the class list."""
    model = EventModel(spark, d)
    scored = M.class_counts(predictions(spark, d, model), model.labels, ["client_id"])
    return control_table(M.add_global(scored)), model.labels


def regression_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Order price against the mean price of its priority class."""
    rows = silo_orders(spark, d)
    means = small_side(rows.groupBy("o_orderpriority").agg(F.avg("y").alias("y_hat")))
    return rows.join(means, "o_orderpriority").select("row_id", "client_id", "y", "y_hat")


view("regression_predictions", """
SELECT row_id, client_id, y, avg(y) OVER (PARTITION BY o_orderpriority) AS y_hat FROM silo_orders""")
view("regression_evaluated", """
SELECT client_id AS evaluator, y, y_hat FROM regression_predictions
UNION ALL SELECT 'Global', y, y_hat FROM regression_predictions""")


def regression_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.add_global_regression(M.regression_counts(regression_predictions(spark, d), ["client_id"]))


def profile(spark: SparkSession, d: str) -> DataFrame:
    from silovalue.operators.partition import partition_profile

    return partition_profile(silo_events(spark, d))


view("profile", """
SELECT client_id, split, label, coalesce(n, 0) AS n
FROM (SELECT DISTINCT client_id FROM silo_events) CROSS JOIN (SELECT DISTINCT split FROM silo_events)
CROSS JOIN (SELECT DISTINCT label FROM silo_events)
LEFT JOIN (SELECT client_id, split, label, count(*) AS n FROM silo_events GROUP BY ALL) USING (client_id, split, label)""")
view("shares", """
SELECT client_id, sum(n)::DOUBLE / (SELECT sum(n) FROM profile WHERE split = 'train') AS share
FROM profile WHERE split = 'train' GROUP BY client_id""")
view("label_shares", """
SELECT client_id, label AS class, n::DOUBLE / nullif(sum(n) OVER (PARTITION BY label), 0) AS share
FROM profile WHERE split = 'train'""")


def round_model(spark: SparkSession, d: str) -> EventModel:
    return EventModel(spark, d, {"fold": F.col("row_id") % ROUNDS})


def round_params(model: EventModel) -> DataFrame:
    """Count models after each of three rounds; in round r a silo has learnt from the row ids with id % 3 < r."""
    learnt = model.train.withColumn("round", F.explode(F.sequence((F.col("fold") + 1).cast("int"), F.lit(ROUNDS))))
    return count_model.fit_per_client(learnt, model.labels, model.buckets, extra=("round",))


view("round_numbers", "SELECT unnest([1, 2, 3]) AS round")
view("round_rows", """
SELECT r.round, s.* FROM silo_events s JOIN round_numbers r ON s.row_id % 3 < r.round WHERE split = 'train'""")
view("round_params", """
SELECT round, client_id, bucket, label,
       (coalesce(k, 0) + 1.0::DOUBLE) / (coalesce(total, 0) + (SELECT count(*) FROM class_names)) AS value, n_examples
FROM (SELECT round, client_id, count(*) AS n_examples FROM round_rows GROUP BY ALL)
CROSS JOIN bucket_names CROSS JOIN class_names
LEFT JOIN (SELECT round, client_id, bucket, label, count(*) AS k FROM round_rows GROUP BY ALL)
  USING (round, client_id, bucket, label)
LEFT JOIN (SELECT round, client_id, bucket, count(*) AS total FROM round_rows GROUP BY ALL)
  USING (round, client_id, bucket)""")


# Coalition lattice of the four event silos.
view("player_list", """
SELECT client_id, row_number() OVER (ORDER BY client_id) - 1 AS pos, count(*) OVER () AS players FROM train_sizes""")
view("member_table", """
SELECT CAST(mask AS BIGINT) AS mask, client_id FROM player_list,
  LATERAL (SELECT unnest(range(1, 1 << CAST(players AS INTEGER))) AS mask) WHERE (mask >> pos) & 1 = 1""")


def lattice_views(prefix: str, source: str, round_column: str) -> None:
    """Views <prefix>_models, _counts, _utility and _sv over parameters ``source``, per round when there is one."""
    r = f"{round_column}, " if round_column else ""
    m = f"m.{r}" if r else ""
    on = f" AND w.{round_column} = m.{round_column}" if r else ""
    view(f"{prefix}_models", f"""
SELECT {r}mask, bucket, label, sum(n_examples * value) / sum(n_examples) AS value
FROM {source} JOIN member_table USING (client_id) GROUP BY ALL""")
    view(f"{prefix}_winners", f"""
SELECT {r}mask, bucket, arg_max(label, (value, -pos)) AS predicted FROM (
  SELECT *, row_number() OVER (PARTITION BY {r}mask, bucket ORDER BY label) AS pos FROM {prefix}_models)
GROUP BY ALL""")
    view(f"{prefix}_counts", f"""
SELECT {m}evaluator, m.mask, t.label, predicted, sum(n) AS n, sum(-n * ln(value)) AS ce
FROM test_counts t JOIN {prefix}_models m ON t.bucket = m.bucket AND t.label = m.label
JOIN {prefix}_winners w ON w.mask = m.mask AND w.bucket = m.bucket{on} GROUP BY ALL""")
    view(f"{prefix}_marginals", f"""
SELECT {r}evaluator, mask, class, sum(support) AS support, sum(predicted) AS predicted, sum(hits) AS hits FROM (
  SELECT {r}evaluator, mask, label AS class, n AS support, 0 AS predicted,
         CASE WHEN label = predicted THEN n ELSE 0 END AS hits FROM {prefix}_counts
  UNION ALL SELECT {r}evaluator, mask, predicted, 0, n, 0 FROM {prefix}_counts
  UNION ALL SELECT {r}evaluator, mask, label, 0, 0, 0
  FROM (SELECT DISTINCT {r}evaluator, mask FROM {prefix}_counts) CROSS JOIN class_names) GROUP BY ALL""")
    view(f"{prefix}_f1", f"""
SELECT {r}evaluator, mask, class, support,
       CASE WHEN support + predicted = 0 THEN 0 ELSE 2.0::DOUBLE * hits / (support + predicted) END AS value
FROM {prefix}_marginals""")
    view(f"{prefix}_utility", f"""
SELECT {r}evaluator, mask, 'CrossEntropyLoss' AS metric, NULL::VARCHAR AS class, sum(ce) / sum(n) AS value
FROM {prefix}_counts GROUP BY {r}evaluator, mask
UNION ALL SELECT {r}evaluator, mask, 'Accuracy', NULL, sum(hits)::DOUBLE / sum(support)
FROM {prefix}_marginals GROUP BY {r}evaluator, mask
UNION ALL SELECT {r}evaluator, mask, 'F1ScoreMacro', NULL, avg(value) FROM {prefix}_f1 GROUP BY {r}evaluator, mask
UNION ALL SELECT {r}evaluator, mask, 'MCC', NULL, CASE WHEN q = 0 THEN 0 ELSE (c * s - pt) / sqrt(q) END FROM (
  SELECT {r}evaluator, mask, sum(hits)::DOUBLE AS c, sum(support)::DOUBLE AS s, sum(predicted::DOUBLE * support) AS pt,
         (sum(support)::DOUBLE ** 2 - sum(predicted::DOUBLE ** 2)) * (sum(support)::DOUBLE ** 2 - sum(support::DOUBLE ** 2)) AS q
  FROM {prefix}_marginals GROUP BY {r}evaluator, mask)
UNION ALL SELECT {r}evaluator, mask, 'F1Score', class, value FROM {prefix}_f1""")


view("test_counts", """
SELECT CAST(client_id AS VARCHAR) AS evaluator, bucket, label, count(*) AS n
FROM silo_events WHERE split = 'test' GROUP BY ALL
UNION ALL SELECT 'Global', bucket, label, count(*) FROM silo_events WHERE split = 'test' GROUP BY ALL""")
lattice_views("lattice", "params", "")
lattice_views("rounds", "round_params", "round")

UTILITY_METRICS = ["CrossEntropyLoss", "Accuracy", "F1ScoreMacro", "MCC", "F1Score"]


def round_utility(model: EventModel, metrics: list[str] = UTILITY_METRICS) -> DataFrame:
    """(round, evaluator, mask, metric, class, value) of every coalition in every round."""
    from silovalue.operators import shapley as S

    fitted = round_params(model)
    models = count_model.average_parameters(
        fitted.join(S.coalition_members(model.silos), "client_id"), ["bucket", "label"], ["round", "mask"]
    )
    test = model.test.groupBy("client_id", "bucket", "label").agg(F.sum("n").alias("n"))
    return control_table(S.coalition_utility(models, test, metrics, model.labels, extra=("round",)))


def round_evaluation(utility: DataFrame) -> DataFrame:
    """(round, evaluator, metric, class, value) of the model of all silos: the largest coalition."""
    full = utility.agg(F.max("mask")).scalar()
    return utility.where(F.col("mask") == full).select("round", "evaluator", "metric", "class", "value")


view("round_evaluation", """
SELECT round, evaluator, metric, class, value FROM rounds_utility
WHERE mask = (SELECT max(mask) FROM member_table)""")


def round_shapley(model: EventModel, utility: DataFrame) -> DataFrame:
    """(round, evaluator, metric, class, client_id, value); the empty coalition is last round's result.

    Round 1 starts from the untrained model, whose metrics are 0 and whose cross entropy is that of a uniform guess.
    """
    from silovalue.operators import shapley as S

    evaluation = round_evaluation(utility)
    later = evaluation.where(F.col("round") < ROUNDS).withColumn("round", F.col("round") + 1)
    uniform = F.when(F.col("metric") == "CrossEntropyLoss", F.ln(F.size(model.labels).cast("double"))).otherwise(0.0)
    first = evaluation.where(F.col("round") == 1).withColumn("value", uniform)
    keys = ["round", "evaluator", "metric", "class"]
    return S.shapley_values(utility, model.silos, first.unionByName(later), keys)


view("round_empty", """
SELECT round + 1 AS round, evaluator, metric, class, value FROM round_evaluation WHERE round < 3
UNION ALL SELECT 1, evaluator, metric, class,
  CASE WHEN metric = 'CrossEntropyLoss' THEN ln((SELECT count(*) FROM class_names)) ELSE 0 END
FROM round_evaluation WHERE round = 1""")
view("round_shapley", """
SELECT w.round, w.evaluator, w.metric, w.class, p.client_id, sum(
  CASE WHEN w.metric = 'CrossEntropyLoss' THEN -1 ELSE 1 END * (w.value - coalesce(o.value, e.value))
  * factorial(CAST(bit_count(w.mask) - 1 AS INTEGER))::DOUBLE * factorial(CAST(players - bit_count(w.mask) AS INTEGER))::DOUBLE
  / factorial(CAST(players AS INTEGER))::DOUBLE) AS value
FROM rounds_utility w JOIN player_list p ON (w.mask >> p.pos) & 1 = 1
LEFT JOIN rounds_utility o ON o.mask = w.mask - (1 << CAST(p.pos AS INTEGER)) AND o.round = w.round AND o.evaluator = w.evaluator
  AND o.metric = w.metric AND o.class IS NOT DISTINCT FROM w.class
JOIN round_empty e ON e.round = w.round AND e.evaluator = w.evaluator AND e.metric = w.metric
  AND e.class IS NOT DISTINCT FROM w.class
GROUP BY ALL""")


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    """Doubles rounded for comparison between engines."""
    chosen = columns or [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return df.select(*[F.round(c, digits).alias(c) if c in chosen else F.col(c) for c in df.columns])
