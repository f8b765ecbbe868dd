"""Registered queries: the preparation recipes on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from silovalue.plans import fixtures as fx, recipes as R
from silovalue.plans.catalog import query, view
from silovalue.plans.fixtures import rounded
from silovalue.plans.q_prep import customer_rows, raw_parts, scaled
from silovalue.sources.tables import read_table

SPLIT = "CASE WHEN md5('7:' || {id}) < '4ccccccc' THEN 'test' ELSE 'train' END AS split"


def position(value: str, column: str, table: str, where: str = "split = 'train'") -> str:
    """0-based place of a value in the sorted distinct values of a column, -1 when absent."""
    return (
        f"CAST(coalesce(list_position((SELECT list(v ORDER BY v) FROM (SELECT DISTINCT {column} AS v FROM {table} "
        f"WHERE {where})), {value}), 0) - 1 AS INTEGER)"
    )


def onehot(value: str, column: str, table: str) -> str:
    return (
        f"list_transform((SELECT list(v ORDER BY v) FROM (SELECT DISTINCT {column} AS v FROM {table} WHERE split = 'train' "
        f"AND {column} IS NOT NULL)), lambda k: CASE WHEN k = {value} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    )


@query("prep_scaled_numeric", f"""
SELECT row_id, c_mktsegment, split, round({scaled('c_acctbal', 'customer_rows')}, 6) AS balance,
       round({scaled('c_nationkey', 'customer_rows')}, 6) AS c_nationkey, {position('c_mktsegment', 'c_mktsegment', 'customer_rows', 'true')} AS class_index
FROM customer_rows""")
def prep_scaled_numeric(spark, d):
    rows = customer_rows(spark, d).drop("split", "constant")
    return rounded(R.prep_scaled_numeric(rows, "c_mktsegment", ["c_acctbal", "c_nationkey"], fx.SEED, {"c_acctbal": "balance"}))


view("order_rows", f"""
SELECT o_orderkey AS row_id, o_totalprice, o_orderpriority AS label, {SPLIT.format(id='o_orderkey')} FROM orders""")


@query("prep_plain", f"""
SELECT row_id, o_totalprice, label, split, {position('label', 'label', 'order_rows')} AS class_index FROM order_rows""")
def prep_plain(spark, d):
    rows = read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"), "o_totalprice", F.col("o_orderpriority").alias("label")
    )
    return R.prep_plain(rows, "label", fx.SEED)


@query("prep_given_split", f"""
SELECT event_id, split, value AS reading, label AS activity, row_number() OVER (ORDER BY split DESC, event_id) - 1 AS row_id,
       {position('label', 'label', 'silo_events')} AS class_index
FROM (SELECT row_id AS event_id, split, value, label FROM silo_events)""")
def prep_given_split(spark, d):
    rows = fx.silo_events(spark, d).select(F.col("row_id").alias("event_id"), "split", "value", "label")
    parts = [rows.where(F.col("split") == s).drop("split") for s in ("train", "test")]
    return R.prep_given_split(*parts, "event_id", "label", {"value": "reading", "label": "activity"})


view("typed_parts", "SELECT * FROM raw_parts WHERE type IS NOT NULL")
view("filled_parts", """
SELECT row_id, split, type, price, size, coalesce(nullif(brand, '?'), (SELECT b FROM (SELECT nullif(brand, '?') AS b, count(*) AS n FROM typed_parts
  WHERE split = 'train' GROUP BY b) WHERE b IS NOT NULL ORDER BY n DESC, b LIMIT 1)) AS brand FROM typed_parts""")


@query("prep_mixed_impute_mode", f"""
SELECT row_id, split, type, {position('type', 'type', 'typed_parts')} AS class_index, round({scaled('price', 'typed_parts')}, 6) AS price,
       {onehot('brand', 'brand', 'filled_parts')} AS brand_onehot FROM filled_parts""")
def prep_mixed_impute_mode(spark, d):
    rows = raw_parts(spark, d).where(F.col("type").isNotNull())
    return rounded(R.prep_mixed_impute_mode(rows, ["size", "weight"], "type", ["price"], ["brand"]))


view("clean_weights", """
SELECT row_id AS part_id, split, type, price, CASE WHEN isnan(weight) THEN NULL ELSE weight END AS weight FROM typed_parts""")


@query("prep_scale_fill_zero", f"""
SELECT part_id, split, type, {position('type', 'type', 'clean_weights')} AS class_index, round({scaled('price', 'clean_weights')}, 6) AS price,
       coalesce(round({scaled('weight', 'clean_weights')}, 6), 0) AS weight, row_number() OVER (ORDER BY split DESC, part_id) - 1 AS row_id
FROM clean_weights""")
def prep_scale_fill_zero(spark, d):
    rows = raw_parts(spark, d).where(F.col("type").isNotNull()).select(
        F.col("row_id").alias("part_id"), "split", "type", "price", "weight"
    )
    return rounded(R.prep_scale_fill_zero(rows, "type", ["price", "weight"], "part_id"))


view("priced_orders", f"""
SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority, {SPLIT.format(id='o_orderkey')} FROM orders""")


@query("prep_scale_onehot", f"""
SELECT o_orderkey, split, o_orderpriority, {position('o_orderpriority', 'o_orderpriority', 'priced_orders')} AS class_index,
       round({scaled('o_totalprice', 'priced_orders')}, 6) AS o_totalprice, {onehot('o_orderstatus', 'o_orderstatus', 'priced_orders')} AS o_orderstatus_onehot,
       row_number() OVER (ORDER BY split DESC, o_orderkey) - 1 AS row_id FROM priced_orders""")
def prep_scale_onehot(spark, d):
    from silovalue.operators.prep import train_test_split

    rows = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    rows = train_test_split(rows, fx.SEED, "o_orderkey")
    return rounded(R.prep_scale_onehot(rows, "o_orderpriority", ["o_totalprice"], ["o_orderstatus"], "o_orderkey"))


view("distinct_events", f"""
SELECT row_id, hour, kind, label, {SPLIT.format(id='row_id')} FROM (
  SELECT min(event_id) AS row_id, hour(ts) AS hour, CASE event_type WHEN 'error' THEN 'fault' ELSE event_type END AS kind,
         CAST(user_id % 6 AS VARCHAR) AS label FROM events WHERE event_id % 9 <> 0 GROUP BY ALL)""")


@query("prep_clean_dedupe", f"""
SELECT row_id, label, split, round({scaled('hour', 'distinct_events')}, 6) AS hour, {onehot('kind', 'kind', 'distinct_events')} AS kind_onehot,
       {position('label', 'label', 'distinct_events')} AS class_index FROM distinct_events""")
def prep_clean_dedupe(spark, d):
    """Events without their value and time stamp repeat a lot; every ninth has no hour."""
    e = read_table(spark, d, "events")
    rows = e.select(
        F.col("event_id").alias("row_id"), F.when(F.col("event_id") % 9 != 0, F.hour("ts")).alias("hour"),
        F.col("event_type").alias("kind"), (F.col("user_id") % 6).cast("string").alias("label"), "value",
    )
    recodes = {"kind": {"error": "fault"}}
    return rounded(R.prep_clean_dedupe(rows, ["value"], recodes, "label", ["hour"], ["kind"], fx.SEED))


view("filled_both", """
SELECT row_id, split, price, coalesce(size, (SELECT avg(size) FROM raw_parts WHERE split = 'train')) AS size,
       coalesce(type, (SELECT type FROM (SELECT type, count(*) AS n FROM raw_parts WHERE split = 'train' AND type IS NOT NULL GROUP BY type)
         ORDER BY n DESC, type LIMIT 1)) AS type FROM raw_parts""")


@query("prep_impute_both", f"""
SELECT row_id, split, price, round({scaled('size', 'filled_both')}, 6) AS size, {onehot('type', 'type', 'filled_both')} AS type_onehot
FROM filled_both""")
def prep_impute_both(spark, d):
    rows = raw_parts(spark, d).drop("split")
    return rounded(R.prep_impute_both(rows, ["brand", "weight"], ["size"], ["type"], fx.SEED))


SERIES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("prep_scale_series", "SELECT l_shipdate, " + ", ".join(
    f"round(({c} - (SELECT min({c}) FROM lineitem)) / (SELECT max({c}) - min({c}) FROM lineitem), 6) AS {c}" for c in SERIES
) + " FROM lineitem")
def prep_scale_series(spark, d):
    return rounded(R.prep_scale_series(read_table(spark, d, "lineitem").select("l_shipdate", *SERIES), SERIES))
