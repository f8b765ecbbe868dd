"""Registered queries: cleaning, imputation, scaling, encoding, splitting, scans and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from silovalue.functions.lineage import control_table, scratch_path
from silovalue.operators import combine as A, prep as P
from silovalue.plans import fixtures as fx
from silovalue.plans.catalog import query, view
from silovalue.plans.fixtures import rounded
from silovalue.sources import tables as T

# A part table with holes: missing text is '?', missing numbers are null, by fixed rules on the key.
view("raw_parts", """
SELECT p_partkey AS row_id, CASE WHEN p_partkey % 7 = 0 THEN '?' ELSE p_brand END AS brand,
       CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS type,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS size, p_retailprice AS price,
       CASE WHEN p_partkey % 13 = 0 THEN 'NaN'::DOUBLE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size / 2.0 END AS weight,
       CASE WHEN md5('7:' || p_partkey) < '4ccccccc' THEN 'test' ELSE 'train' END AS split
FROM part""")


@T.dataset("parts")
def raw_parts(spark, d):
    p = T.read_table(spark, d, "part")
    key = F.col("p_partkey")
    rows = p.select(
        key.alias("row_id"), F.when(key % 7 == 0, "?").otherwise(F.col("p_brand")).alias("brand"),
        F.when(key % 11 != 0, F.col("p_type")).alias("type"), F.when(key % 5 != 0, F.col("p_size")).alias("size"),
        F.col("p_retailprice").alias("price"),
        F.when(key % 13 == 0, F.lit(float("nan"))).when(key % 17 == 0, F.lit(None).cast("double"))
        .otherwise(F.col("p_size") / 2).alias("weight"),
    )
    return P.train_test_split(rows, fx.SEED)


def train(rows):
    return rows.where(F.col("split") == "train")


@query("drop_columns", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def drop_columns(spark, d):
    return P.drop_columns(T.read_table(spark, d, "customer"), ["c_name", "c_nationkey"])


@query("rename_columns", """
SELECT c_custkey AS id, c_name, c_nationkey, c_acctbal AS balance, c_mktsegment AS segment FROM customer""")
def rename_columns(spark, d):
    names = {"c_custkey": "id", "c_acctbal": "balance", "c_mktsegment": "segment"}
    return P.rename_columns(T.read_table(spark, d, "customer"), names)


@query("null_token", "SELECT row_id, nullif(brand, '?') AS brand, nullif(type, '?') AS type FROM raw_parts")
def null_token(spark, d):
    return P.null_token(raw_parts(spark, d).select("row_id", "brand", "type"))


@query("recode_values", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS o_orderstatus,
       CASE o_orderpriority WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def recode_values(spark, d):
    orders = T.read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return P.recode_values(orders, {"o_orderstatus": {"F": "Finished", "O": "Open"}, "o_orderpriority": {"5-LOW": "low"}})


@query("drop_null_rows", """
SELECT row_id, type, size FROM raw_parts WHERE type IS NOT NULL AND size IS NOT NULL""")
def drop_null_rows(spark, d):
    return P.drop_null_rows(raw_parts(spark, d).select("row_id", "type", "size"))


@query("dedupe_rows", """
SELECT user_id, event_type, hour(ts) AS hour, min(event_id) AS event_id FROM events GROUP BY ALL""")
def dedupe_rows(spark, d):
    rows = T.read_table(spark, d, "events").select("event_id", "user_id", "event_type", F.hour("ts").cast("bigint").alias("hour"))
    return P.dedupe_rows(rows, "event_id")


@query("dedupe_full_rows", """
SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem""")
def dedupe_full_rows(spark, d):
    columns = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return P.dedupe_rows(T.read_table(spark, d, "lineitem").select(*columns))


@query("fill_zero", """
SELECT row_id, coalesce(size, 0) AS size, CASE WHEN weight IS NULL OR isnan(weight) THEN 0 ELSE weight END AS weight
FROM raw_parts""")
def fill_zero(spark, d):
    return P.fill_zero(raw_parts(spark, d).select("row_id", "size", "weight"))


@query("impute_mean", """
SELECT row_id, split, round(coalesce(size, (SELECT avg(size) FROM raw_parts WHERE split = 'train')), 6) AS size
FROM raw_parts""")
def impute_mean(spark, d):
    rows = raw_parts(spark, d).select("row_id", "split", "size")
    return rounded(P.impute_mean(rows, train(rows), ["size"]))


MODE = """(SELECT {c} FROM (SELECT {c}, count(*) AS n FROM {t} WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c})
ORDER BY n DESC, {c} LIMIT 1)"""


@query("impute_mode", f"""
SELECT row_id, split, coalesce(type, {MODE.format(c='type', t='raw_parts')}) AS type,
       coalesce(nullif(brand, '?'), (SELECT b FROM (SELECT nullif(brand, '?') AS b, count(*) AS n FROM raw_parts
         WHERE split = 'train' GROUP BY b) WHERE b IS NOT NULL ORDER BY n DESC, b LIMIT 1)) AS brand FROM raw_parts""")
def impute_mode(spark, d):
    rows = P.null_token(raw_parts(spark, d).select("row_id", "split", "type", "brand"), columns=["brand"])
    return P.impute_mode(rows, train(rows), ["type", "brand"])


BOUNDS = "(SELECT {f}({c}) FROM {t} WHERE split = 'train')"


def scaled(c: str, t: str) -> str:
    low, high = BOUNDS.format(f="min", c=c, t=t), BOUNDS.format(f="max", c=c, t=t)
    return f"({c} - {low}) / CASE WHEN {high} = {low} THEN 1 ELSE {high} - {low} END"


view("customer_rows", """
SELECT c_custkey AS row_id, c_acctbal, c_nationkey, c_mktsegment, 3.0::DOUBLE AS constant,
       CASE WHEN md5('7:' || c_custkey) < '4ccccccc' THEN 'test' ELSE 'train' END AS split FROM customer""")


def customer_rows(spark, d):
    c = T.read_table(spark, d, "customer")
    rows = c.select(F.col("c_custkey").alias("row_id"), "c_acctbal", "c_nationkey", "c_mktsegment", F.lit(3.0).alias("constant"))
    return P.train_test_split(rows, fx.SEED)


@query("minmax_scale", f"""
SELECT row_id, split, round({scaled('c_acctbal', 'customer_rows')}, 6) AS c_acctbal,
       round({scaled('c_nationkey', 'customer_rows')}, 6) AS c_nationkey, constant - 3 AS constant FROM customer_rows""")
def minmax_scale(spark, d):
    rows = customer_rows(spark, d).drop("c_mktsegment")
    return rounded(P.minmax_scale(rows, train(rows), ["c_acctbal", "c_nationkey", "constant"]))


@query("onehot_encode", """
SELECT row_id, split, list_transform((SELECT list(type ORDER BY type) FROM (SELECT DISTINCT type FROM raw_parts
  WHERE split = 'train' AND type IS NOT NULL AND type <> 'SMALL')), lambda k: CASE WHEN k = type THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS type_onehot
FROM raw_parts""")
def onehot_encode(spark, d):
    """One category is held back while fitting, so it is unknown later and becomes all zeros."""
    rows = raw_parts(spark, d).select("row_id", "split", "type")
    known = train(rows).where(F.col("type") != "SMALL")
    return P.onehot_encode(rows, known, ["type"]).drop("type")


@query("onehot_strict", """
SELECT c_custkey, list_transform((SELECT list(s ORDER BY s) FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)),
  lambda k: CASE WHEN k = c_mktsegment THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS segment FROM customer""")
def onehot_strict(spark, d):
    rows = T.read_table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    encoded = P.onehot_encode(rows, rows, ["c_mktsegment"], strict=True)
    return encoded.select("c_custkey", F.col("c_mktsegment_onehot").alias("segment"))


view("priority_classes", """
SELECT list(p ORDER BY p) AS classes FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)""")


@query("encode_labels", """
SELECT o_orderkey, CAST(list_position((SELECT classes FROM priority_classes), o_orderpriority) - 1 AS INTEGER) AS class_index,
       replace(replace(o_orderpriority, '-', '_'), ' ', '_') AS display
FROM orders""")
def encode_labels(spark, d):
    rows = T.read_table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label"))
    encoded = P.encode_labels(rows, rows)
    name = F.concat(F.lit("label_"), F.translate("label", "- ", "__"))  # as an encoder names its columns
    return encoded.select("o_orderkey", "class_index", P.display_label(name, "label").alias("display"))


@query("decode_labels", """
SELECT row_id, predicted AS decoded FROM predictions""")
def decode_labels(spark, d):
    model = fx.EventModel(spark, d)
    return P.decode_labels(fx.predictions(spark, d, model), model.train, "probs").select("row_id", "decoded")


@query("order_columns", """
SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END::DOUBLE AS "c_mktsegment_BUILDING",
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0 ELSE 0.0 END::DOUBLE AS "c_mktsegment_MACHINERY", c_acctbal, c_custkey
FROM customer""")
def order_columns(spark, d):
    rows = T.read_table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    flags = P.onehot_columns(rows, "c_mktsegment", ["BUILDING", "MACHINERY"]).drop("c_mktsegment")
    return P.order_columns(flags, ["c_mktsegment", "c_acctbal"])


@query("downcast_types", """
SELECT p_partkey, CAST(p_size AS SMALLINT) AS p_size, CAST(p_retailprice AS FLOAT) AS p_retailprice FROM part""")
def downcast_types(spark, d):
    return P.downcast_types(T.read_table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), skip=("p_partkey",))


@query("bool_to_int", """
SELECT c_custkey, CAST(c_acctbal > 0 AS INTEGER) AS positive, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS building
FROM customer""")
def bool_to_int(spark, d):
    c = T.read_table(spark, d, "customer")
    return P.bool_to_int(c.select(
        "c_custkey", (F.col("c_acctbal") > 0).alias("positive"), (F.col("c_mktsegment") == "BUILDING").alias("building")
    ))


@query("assign_row_ids", """
SELECT o_orderkey, split, row_number() OVER (ORDER BY split DESC, o_orderkey) - 1 AS row_id FROM (
  SELECT o_orderkey, CASE WHEN md5('7:' || o_orderkey) < '4ccccccc' THEN 'test' ELSE 'train' END AS split FROM orders)""")
def assign_row_ids(spark, d):
    rows = P.train_test_split(T.read_table(spark, d, "orders").select("o_orderkey"), fx.SEED, "o_orderkey")
    return P.assign_row_ids(
        rows.where(F.col("split") == "train").drop("split"), rows.where(F.col("split") == "test").drop("split"), "o_orderkey"
    )


@query("train_test_split", """
SELECT o_orderkey, CASE WHEN md5('7:' || o_orderkey) < '4ccccccc' THEN 'test' ELSE 'train' END AS split FROM orders""")
def train_test_split(spark, d):
    return P.train_test_split(T.read_table(spark, d, "orders").select("o_orderkey"), fx.SEED, "o_orderkey")


@query("column_min_max", """
SELECT 'l_quantity' AS "column", min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem
UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice) FROM lineitem
UNION ALL SELECT 'l_discount', min(l_discount), max(l_discount) FROM lineitem""")
def column_min_max(spark, d):
    return P.column_min_max(T.read_table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("standardize", """
SELECT row_id, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer_rows WHERE split = 'train'))
  / (SELECT stddev_pop(c_acctbal) FROM customer_rows WHERE split = 'train'), 6) AS c_acctbal, constant - 3 AS constant
FROM customer_rows""")
def standardize(spark, d):
    rows = customer_rows(spark, d).select("row_id", "split", "c_acctbal", "constant")
    return rounded(P.standardize(rows, train(rows), ["c_acctbal", "constant"]).drop("split"))


# ---------------------------------------------------------------- scans and sinks

CSV_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("scan_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv(spark, d):
    path = scratch_path(spark, "csv")
    T.read_table(spark, d, "customer").write.csv(path, header=True)
    return T.scan_csv(spark, path, CSV_SCHEMA)


def _stored(spark, d):
    path = scratch_path(spark, "silos")
    T.sink_partition(fx.silo_events(spark, d), path)
    return path


@query("sink_partition", "SELECT row_id, label, bucket, value, client_id, split FROM silo_events")
def sink_partition(spark, d):
    return T.scan_partition(spark, _stored(spark, d)).withColumn("client_id", F.col("client_id").cast("bigint"))


@query("scan_partition", "SELECT row_id, label, bucket, value FROM silo_events WHERE client_id = 2 AND split = 'train'")
def scan_partition(spark, d):
    return T.scan_partition(spark, _stored(spark, d), 2, "train").drop("client_id", "split")


@query("scan_all_test", "SELECT row_id, label, client_id FROM silo_events WHERE split = 'test'")
def scan_all_test(spark, d):
    rows = T.scan_all_test(spark, _stored(spark, d))
    return rows.select("row_id", "label", F.col("client_id").cast("bigint").alias("client_id"))


@query("scan_all_train", "SELECT row_id, label, client_id FROM silo_events WHERE split = 'train'")
def scan_all_train(spark, d):
    rows = T.scan_all_train(spark, _stored(spark, d))
    return rows.select("row_id", "label", F.col("client_id").cast("bigint").alias("client_id"))


def _evaluation(spark, d):
    """Evaluation of the silos, of Global and of the share-weighted mean, per round."""
    model = fx.round_model(spark, d)
    rows = fx.round_evaluation(fx.round_utility(model, ["Accuracy", "MCC"])).drop("class")
    profile = model.counts.groupBy("client_id", "split", "label").agg(F.sum("n").alias("n"))
    pooled = A.aggregate_metric(rows, A.train_shares(profile), ["round", "metric"]).withColumn("evaluator", F.lit("Aggregated"))
    return rows.unionByName(pooled.select(*rows.columns))


view("evaluation_long", """
SELECT round, evaluator, metric, value FROM round_evaluation WHERE metric IN ('Accuracy', 'MCC')
UNION ALL SELECT round, 'Aggregated', metric, sum(share * value) FROM round_evaluation e
JOIN shares s ON e.evaluator = CAST(s.client_id AS VARCHAR) WHERE metric IN ('Accuracy', 'MCC') GROUP BY round, metric""")
EVALUATORS = ["0", "1", "2", "3", "Global", "Aggregated"]


@query("sink_evaluation", "SELECT round, " + ", ".join(
    f"round(max(value) FILTER (WHERE evaluator = '{e}'), 6) AS \"{e}\"" for e in EVALUATORS
) + " FROM evaluation_long WHERE metric = 'Accuracy' GROUP BY round")
def sink_evaluation(spark, d):
    return rounded(T.sink_evaluation(_evaluation(spark, d), "Accuracy", EVALUATORS))


@query("scan_metric_matrix", """
SELECT round, evaluator AS silo, round(value, 6) AS value FROM evaluation_long WHERE metric = 'MCC'""")
def scan_metric_matrix(spark, d):
    path = scratch_path(spark, "evaluation")
    T.write_report(T.sink_evaluation(_evaluation(spark, d), "MCC", EVALUATORS), path)
    schema = "round int, " + ", ".join(f"`{e}` double" for e in EVALUATORS)
    return rounded(T.scan_metric_matrix(T.scan_csv(spark, path, schema)))


@query("sink_shapley", "SELECT round, evaluator, " + ", ".join(
    f"round(max(value) FILTER (WHERE client_id = {c}), 6) AS \"{c}\"" for c in range(4)
) + " FROM round_shapley WHERE metric = 'MCC' GROUP BY round, evaluator")
def sink_shapley(spark, d):
    model = fx.round_model(spark, d)
    sv = fx.round_shapley(model, fx.round_utility(model, ["CrossEntropyLoss", "MCC"])).drop("class")
    return rounded(T.sink_shapley(sv, "MCC", ["0", "1", "2", "3"]))


def _reported(spark, long, names, sink, melt, by="metric"):
    """A long table written as the matrices of all its metrics and read back."""
    path = scratch_path(spark, "reports")
    return T.scan_reports(spark, path, T.write_reports(control_table(long), path, sink, names, by), melt, by)


@query("reports_evaluation", "SELECT round, metric, class, evaluator AS silo, round(value, 6) AS value FROM round_evaluation")
def reports_evaluation(spark, d):
    """All metrics of all rounds, the one by class included, through their files."""
    model = fx.round_model(spark, d)
    rows = fx.round_evaluation(fx.round_utility(model))
    found = _reported(spark, rows, ["0", "1", "2", "3", "Global"], T.sink_evaluation, T.scan_metric_matrix)
    return rounded(found.select("round", "metric", "class", "silo", "value"))


@query("reports_shapley", """
SELECT round, metric, class, evaluator, CAST(client_id AS VARCHAR) AS silo, round(value, 6) AS value FROM round_shapley""")
def reports_shapley(spark, d):
    model = fx.round_model(spark, d)
    sv = fx.round_shapley(model, fx.round_utility(model))
    found = _reported(spark, sv, ["0", "1", "2", "3"], T.sink_shapley, T.scan_metric_matrix)
    return rounded(found.select("round", "metric", "class", "evaluator", "silo", "value"))
