"""Registered queries: relational steps and partition schemes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from silovalue.functions.lineage import scratch_path
from silovalue.operators import distance as X, partition as D, prep as P
from silovalue.plans import fixtures as fx
from silovalue.plans.catalog import query, view
from silovalue.sources import tables as T

# ---------------------------------------------------------------- joins and set operations


@query("align_features_labels", """
SELECT o_orderkey AS row_id, o_totalprice, o_orderpriority AS label FROM orders""")
def align_features_labels(spark, d):
    orders = T.read_table(spark, d, "orders")
    features = orders.select(F.col("o_orderkey").alias("row_id"), "o_totalprice")
    labels = orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("label"))
    return features.join(labels, "row_id")


@query("rows_with_label", """
SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def rows_with_label(spark, d):
    docs = T.read_table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    good = T.read_table(spark, d, "labels").where(F.col("quality") == 1)
    return D.rows_with_label(docs, good, "doc_id")


@query("remaining_rows", """
SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def remaining_rows(spark, d):
    docs = T.read_table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return D.remaining_rows(docs, T.read_table(spark, d, "labels"), "doc_id")


@query("client_pairs", """
WITH silos AS (SELECT DISTINCT source AS s FROM documents)
SELECT a.s AS src, b.t AS tgt FROM silos a CROSS JOIN (SELECT s AS t FROM silos UNION ALL SELECT 'Global') b""")
def client_pairs(spark, d):
    return X.client_pairs(T.read_table(spark, d, "documents").select(F.col("source").alias("client_id")))


@query("concat_partitions", "SELECT row_id, client_id, label, split FROM silo_events")
def concat_partitions(spark, d):
    rows = fx.silo_events(spark, d).select("row_id", "client_id", "label", "split")
    parts = [
        rows.where((F.col("client_id") == c) & (F.col("split") == s)).select("split", "label", "client_id", "row_id")
        for c in range(4) for s in ("train", "test")
    ]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part)
    return joined


# ---------------------------------------------------------------- label skew

view("class_counts", "SELECT split, label, count(*) AS n FROM silo_events GROUP BY split, label")
view("class_places", """
SELECT *, row_number() OVER (PARTITION BY split ORDER BY label) - 1 AS pos, count(*) OVER (PARTITION BY split) AS classes
FROM class_counts""")


@query("label_counts", "SELECT split, label, n FROM class_counts")
def label_counts(spark, d):
    return D.label_counts(fx.silo_events(spark, d))


@query("partition_profile", "SELECT client_id, split, label, n FROM profile")
def partition_profile(spark, d):
    return D.partition_profile(fx.silo_events(spark, d))


@query("dirichlet_quota")
def dirichlet_quota(spark, d):
    return D.dirichlet_quota(D.label_counts(fx.silo_events(spark, d)), [10, 20, 30, 40], 1.0, 5)


@query("partition_dirichlet")
def partition_dirichlet(spark, d):
    rows = fx.silo_events(spark, d).drop("client_id")
    drawn = D.partition_dirichlet(rows, [10, 20, 30, 40], 1.0, 5, scratch_path(spark, "dirichlet"))
    return drawn.select("row_id", "split", "label", F.col("client_id").cast("bigint").alias("client_id"))


def quota_sql(n_clients: int, rule: str) -> str:
    return f"""
SELECT client_id, label, split, CAST({rule} AS BIGINT) AS n
FROM class_places CROSS JOIN (SELECT unnest(range({n_clients})) AS client_id)"""


QUOTAS = {
    "quota_balanced": (4, "CASE WHEN split = 'test' THEN CASE WHEN pos < classes - 2 THEN n // 6 ELSE 0 END ELSE n // 4 END",
                       lambda c: D.quota_balanced(c, 4, test_parts=6, test_skip_last=2)),
    "quota_maverick_full": (6, "CASE WHEN pos = classes - 1 THEN CASE WHEN client_id = 5 THEN n ELSE 0 END ELSE n // 6 END",
                            lambda c: D.quota_maverick_full(c, 6)),
    "quota_maverick_first": (6, "CASE WHEN pos = 0 THEN CASE WHEN client_id = 0 THEN n ELSE 0 END ELSE n // 6 END",
                             lambda c: D.quota_maverick_full(c, 6, 0, 0)),
    "quota_maverick_less_labels": (6, """CASE WHEN pos = classes - 1 THEN CASE WHEN client_id = 5 THEN n ELSE 0 END
WHEN pos = classes - 2 THEN CASE WHEN client_id = 0 THEN 0 ELSE n // 5 END ELSE n // 6 END""",
                                   lambda c: D.quota_maverick_less_labels(c, 6)),
    "quota_maverick_missing_two": (6, """CASE WHEN pos = classes - 1 THEN CASE WHEN client_id = 5 THEN n ELSE 0 END
WHEN pos >= classes - 3 THEN CASE WHEN client_id = 0 THEN 0 ELSE n // 5 END ELSE n // 6 END""",
                                   lambda c: D.quota_maverick_missing_two(c, 6)),
    "quota_maverick_balanced": (6, """CASE WHEN client_id = 0 THEN n // 6
  - sum(CASE WHEN pos = 0 THEN 0 ELSE n // 6 END) OVER (PARTITION BY split, client_id) // (6 * classes)
WHEN pos = 0 THEN 0 ELSE n // 6 END""", lambda c: D.quota_maverick_balanced(c, 6)),
    "quota_disjoint_labels": (3, "CASE WHEN client_id = pos * 3 // classes THEN n ELSE 0 END",
                              lambda c: D.quota_disjoint_labels(c, 3)),
}


def _register_quota(name, n_clients, rule, build):
    @query(name, quota_sql(n_clients, rule))
    def run(spark, d):
        return build(D.label_counts(fx.silo_events(spark, d)))


for _name, (_k, _rule, _build) in QUOTAS.items():
    _register_quota(_name, _k, _rule, _build)


# The trap's class mix does not depend on the data: a flat Dirichlet draw for the four classes beside the last.
TRAP_MIX = [float(v) for v in np.random.RandomState(5).dirichlet(np.ones(4) * 1000.0)]


@query("quota_hellinger_trap", f"""
WITH even AS (SELECT client_id, label, split, pos, classes, n // 7 AS e FROM class_places CROSS JOIN (SELECT unnest(range(6)) AS client_id)),
cut AS (SELECT *, e - sum(CASE WHEN pos = classes - 1 THEN 0 ELSE e END) OVER (PARTITION BY split, client_id) // (7 * classes) AS own FROM even)
SELECT client_id, label, split, CAST(CASE WHEN client_id < 5 THEN CASE WHEN pos = classes - 1 THEN 0 ELSE e END
  WHEN pos = classes - 1 THEN own
  ELSE floor(({TRAP_MIX!r}::DOUBLE[])[pos + 1] * sum(CASE WHEN pos = classes - 1 THEN 0 ELSE own END) OVER (PARTITION BY split, client_id)) END AS BIGINT) AS n
FROM cut""")
def quota_hellinger_trap(spark, d):
    return D.quota_hellinger_trap(D.label_counts(fx.silo_events(spark, d)), 6, 5)


view("ranked_events", """
SELECT row_id, split, label, row_number() OVER (PARTITION BY split, label ORDER BY md5('3:' || row_id), row_id) - 1 AS rank
FROM silo_events""")


@query("sample_by_quota", """
WITH quota AS (SELECT split, label, client_id, n * (client_id + 1) // 12 AS q
  FROM class_counts CROSS JOIN (SELECT unnest(range(4)) AS client_id)),
ranges AS (SELECT *, sum(q) OVER (PARTITION BY split, label ORDER BY client_id) AS upto FROM quota)
SELECT row_id, split, label, client_id FROM ranked_events JOIN ranges USING (split, label)
WHERE rank < upto AND rank >= upto - q""")
def sample_by_quota(spark, d):
    """Silo k takes (k + 1) / 12 of each class."""
    rows = fx.silo_events(spark, d).select("row_id", "split", "label")
    quota = D.label_counts(rows).withColumn("client_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3)))).select(
        "client_id", "label", "split", F.floor(F.col("n") * (F.col("client_id") + 1) / 12).alias("n")
    )
    return D.sample_by_quota(rows, quota, 3).select("row_id", "split", "label", "client_id")


@query("partition_random", """
SELECT row_id, split, label, rank // each AS client_id FROM (
  SELECT row_id, split, label, row_number() OVER (PARTITION BY split ORDER BY md5('1:' || row_id), row_id) - 1 AS rank,
         count(*) OVER (PARTITION BY split) // 7 AS each FROM silo_events) WHERE rank < each * 7""")
def partition_random(spark, d):
    return D.partition_random(fx.silo_events(spark, d).select("row_id", "split", "label"), 7, 1)


# ---------------------------------------------------------------- feature skew

view("split_orders", """
SELECT row_id, y, c_mktsegment, o_orderpriority, c_acctbal,
       CASE WHEN md5('7:' || row_id) < '4ccccccc' THEN 'test' ELSE 'train' END AS split FROM silo_orders""")
PART = """CASE WHEN rank < size % {k} * (size // {k} + 1) THEN rank // (size // {k} + 1)
ELSE size % {k} + (rank - size % {k} * (size // {k} + 1)) // greatest(size // {k}, 1) END"""


def orders(spark, d):
    rows = fx.silo_orders(spark, d).select("row_id", "y", "c_mktsegment", "o_orderpriority", "c_acctbal")
    return P.train_test_split(rows, fx.SEED)


def sliced_sql(slices: list[str], parts: int, seed: int) -> str:
    union = " UNION ALL ".join(f"SELECT row_id, split, {i} AS slice FROM split_orders WHERE {s}" for i, s in enumerate(slices))
    return f"""
SELECT row_id, split, slice * {parts} + {PART.format(k=parts)} AS client_id FROM (
  SELECT *, row_number() OVER (PARTITION BY slice, split ORDER BY md5('{seed}:' || row_id), row_id) - 1 AS rank,
         count(*) OVER (PARTITION BY slice, split) AS size FROM ({union}))"""


@query("partition_feature_slices", sliced_sql(["c_acctbal < 0", "c_acctbal >= 0 AND c_acctbal < 5000", "c_acctbal > 4000"], 3, 1))
def partition_feature_slices(spark, d):
    """Three predicates, two of them overlapping, each shared by three silos."""
    balance = F.col("c_acctbal")
    slices = [balance < 0, (balance >= 0) & (balance < 5000), balance > 4000]
    return D.partition_feature_slices(orders(spark, d), slices, 3).select("row_id", "split", "client_id")


GROUPS = [["BUILDING", "MACHINERY"], ["FURNITURE", "HOUSEHOLD"], ["AUTOMOBILE"]]


def in_list(column: str, values: list[str]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


@query("partition_by_state", sliced_sql([in_list("c_mktsegment", g) for g in GROUPS], 2, 1))
def partition_by_state(spark, d):
    return D.partition_by_category(orders(spark, d), "c_mktsegment", GROUPS, 2).select("row_id", "split", "client_id")


PRIORITIES = [["1-URGENT", "2-HIGH"], ["3-MEDIUM"], ["4-NOT SPECIFIED", "5-LOW"]]


@query("partition_by_facility", sliced_sql([in_list("o_orderpriority", g) for g in PRIORITIES], 1, 1))
def partition_by_facility(spark, d):
    return D.partition_by_category(orders(spark, d), "o_orderpriority", PRIORITIES).select("row_id", "split", "client_id")


@query("partition_by_building", sliced_sql([in_list("c_mktsegment", ["BUILDING"]), in_list("c_mktsegment", ["HOUSEHOLD"])], 3, 1))
def partition_by_building(spark, d):
    return D.partition_by_category(
        orders(spark, d), "c_mktsegment", [["BUILDING"], ["HOUSEHOLD"]], 3
    ).select("row_id", "split", "client_id")


@query("partition_target_range", """
SELECT row_id, y, CASE WHEN y < 100000 THEN 0 WHEN y > 100000 AND y < 200000 THEN 1
  WHEN y > 200000 AND y < 350000.5 THEN 2 WHEN y > 350000.5 THEN 3 END::BIGINT AS client_id
FROM silo_orders WHERE y NOT IN (100000, 200000, 350000.5)""")
def partition_target_range(spark, d):
    rows = fx.silo_orders(spark, d).select("row_id", "y")
    return D.partition_target_range(rows, [100000.0, 200000.0, 350000.5])


@query("partition_maverick_category", f"""
SELECT row_id, split, {PART.format(k=5)} AS client_id FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('1:' || row_id), row_id) - 1 AS rank,
         count(*) OVER (PARTITION BY split) AS size FROM split_orders WHERE o_orderpriority <> '2-HIGH')
UNION ALL SELECT row_id, split, 4 FROM split_orders WHERE o_orderpriority = '2-HIGH'""")
def partition_maverick_category(spark, d):
    return D.partition_maverick_category(orders(spark, d), "o_orderpriority", "2-HIGH", 5).select("row_id", "split", "client_id")


@query("partition_feature_clusters")
def partition_feature_clusters(spark, d):
    """Silos by k-means inside every class of the vectors."""
    rows = fx.silo_vectors(spark, d).drop("client_id")
    return D.partition_feature_clusters(rows, 4).select("row_id", "label", "client_id")


@query("cluster_step", """
WITH hashed AS (SELECT row_id, label, features, row_number() OVER (PARTITION BY label ORDER BY md5('1:' || row_id), row_id) - 1 AS place FROM silo_vectors),
centres AS (SELECT label, place AS cluster, features AS c FROM hashed WHERE place < 4),
near AS (SELECT row_id, label, arg_min(cluster, (list_sum(list_transform(list_zip(features, c), lambda p: (p[1] - p[2]) ** 2)), cluster)) AS cluster
  FROM silo_vectors JOIN centres USING (label) GROUP BY row_id, label),
long AS (SELECT n.label, cluster, unnest(features) AS x, unnest(range(len(features))) AS i FROM near n JOIN silo_vectors USING (row_id)),
means AS (SELECT label, cluster, i, avg(x) AS m FROM long GROUP BY ALL),
moved AS (SELECT label, cluster, list(m ORDER BY i) AS c FROM means GROUP BY ALL)
SELECT row_id, label, arg_min(cluster, (list_sum(list_transform(list_zip(features, c), lambda p: (p[1] - p[2]) ** 2)), cluster)) AS client_id
FROM silo_vectors JOIN moved USING (label) GROUP BY row_id, label""")
def cluster_step(spark, d):
    """Silos by the classes' nearest centres after one step from the four rows of smallest hash of each class."""
    rows = fx.silo_vectors(spark, d).drop("client_id")
    centres = D.moved_centres(rows, D.first_centres(rows, 4, candidates=1))
    return D.assign_clusters(rows, centres).select("row_id", "label", "client_id")
