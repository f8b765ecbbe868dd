"""Registered queries: correlations of values and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from silovalue.functions.lineage import control_table
from silovalue.operators import combine as A, metrics as M, shapley as S, stats as C
from silovalue.plans import fixtures as fx
from silovalue.plans.catalog import query, view
from silovalue.plans.fixtures import rounded
from silovalue.plans.q_distance import event_measures
from silovalue.sources.tables import read_table

# Silos of documents by source: share of good documents and mean length, two numbers per silo and language.
view("source_stats", """
SELECT lang, source AS client_id, avg(n_chars) AS x, count(*)::DOUBLE AS y FROM documents GROUP BY lang, source""")


def source_stats(spark, d):
    docs = read_table(spark, d, "documents")
    return docs.groupBy("lang", F.col("source").alias("client_id")).agg(
        F.avg("n_chars").alias("x"), F.count(F.lit(1)).cast("double").alias("y")
    )


RANKS = """
SELECT lang, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2 AS x,
       rank() OVER (PARTITION BY lang ORDER BY y) + (count(*) OVER (PARTITION BY lang, y) - 1) / 2 AS y FROM source_stats"""
view("source_ranks", RANKS)


@query("pearson", "SELECT lang, round(corr(x, y), 6) AS r, count(*) AS n FROM source_stats GROUP BY lang")
def pearson(spark, d):
    return rounded(C.pearson(source_stats(spark, d), ["lang"]))


@query("spearman", "SELECT lang, round(corr(x, y), 6) AS r, count(*) AS n FROM source_ranks GROUP BY lang")
def spearman(spark, d):
    return rounded(C.spearman(source_stats(spark, d), ["lang"]))


view("lang_p", """
WITH r AS (SELECT lang, corr(x, y) AS r, count(*) AS n FROM source_stats GROUP BY lang),
t AS (SELECT *, atan(abs(r * sqrt((n - 2) / (1 - r * r))) / sqrt(n - 2)) AS a FROM r)
SELECT lang, r, n, 1 - CASE WHEN n % 2 = 0 THEN sin(a) * (1 + coalesce(list_sum(list_transform(
    range(1, n // 2 - 1), lambda k: list_aggregate(list_transform(range(1, k + 1), lambda j: (2 * j - 1) / (2.0 * j)), 'product')
      * cos(a) ** (2 * k))), 0))
  ELSE 2 / pi() * (a + CASE WHEN n > 3 THEN sin(a) * cos(a) * (1 + coalesce(list_sum(list_transform(
    range(1, (n - 3) // 2), lambda k: list_aggregate(list_transform(range(1, k + 1), lambda j: (2.0 * j) / (2 * j + 1)), 'product')
      * cos(a) ** (2 * k))), 0)) ELSE 0 END) END AS p
FROM t""")


@query("pearson_p_value", "SELECT lang, round(r, 6) AS r, n, round(p, 6) AS p FROM lang_p")
def pearson_p_value(spark, d):
    return rounded(C.pearson_p_value(C.pearson(source_stats(spark, d), ["lang"])))


@query("fisher_mean", """
SELECT lang IN ('en', 'de') AS germanic, round(tanh(avg(atanh(r))), 6) AS r, round(avg(p), 6) AS p FROM lang_p GROUP BY 1""")
def fisher_mean(spark, d):
    """Coefficients and p-values of the languages, averaged by family."""
    found = C.pearson_p_value(C.pearson(source_stats(spark, d), ["lang"]))
    return rounded(C.fisher_mean(found.withColumn("germanic", F.col("lang").isin("en", "de")), ["germanic"]))


@query("average_ranks", "SELECT lang, round(x, 6) AS x, round(y, 6) AS y FROM source_ranks")
def average_ranks(spark, d):
    return rounded(C.average_ranks(source_stats(spark, d), ["lang"], ["x", "y"]).select("lang", "x", "y"))


def permuted(source: str, keys: str, item: str) -> str:
    """SQL of the rank coefficient of x and y for each key with 2 to 4 items, and its p over all permutations."""
    return f"""
WITH ranked AS (SELECT {keys}, count(*) OVER (PARTITION BY {keys}) AS n, row_number() OVER (PARTITION BY {keys} ORDER BY {item}) - 1 AS i,
  rank() OVER (PARTITION BY {keys} ORDER BY x) + (count(*) OVER (PARTITION BY {keys}, x) - 1) / 2 AS x,
  rank() OVER (PARTITION BY {keys} ORDER BY y) + (count(*) OVER (PARTITION BY {keys}, y) - 1) / 2 AS y FROM {source}),
packed AS (SELECT {keys}, any_value(n) AS n, list(x ORDER BY i) AS xs, list(y ORDER BY i) AS ys, corr(x, y) AS r FROM ranked GROUP BY {keys}),
idx AS (SELECT unnest(range(4)) AS v),
perms AS (SELECT 2 AS size, [a.v, b.v] AS p FROM idx a, idx b WHERE a.v <> b.v AND a.v < 2 AND b.v < 2
  UNION ALL SELECT 3, [a.v, b.v, c.v] FROM idx a, idx b, idx c WHERE a.v <> b.v AND a.v <> c.v AND b.v <> c.v AND greatest(a.v, b.v, c.v) < 3
  UNION ALL SELECT 4, [a.v, b.v, c.v, e.v] FROM idx a, idx b, idx c, idx e
  WHERE a.v <> b.v AND a.v <> c.v AND a.v <> e.v AND b.v <> c.v AND b.v <> e.v AND c.v <> e.v),
tried AS (SELECT {keys}, any_value(r) AS r, corr(xs[i + 1], ys[p[i + 1] + 1]) AS q
  FROM packed JOIN perms ON size = n JOIN (SELECT unnest(range(4)) AS i) AS places ON i < n GROUP BY {keys}, p)
SELECT {keys}, round(any_value(r), 6) AS r,
       round(least(1, 2 * least(avg(CASE WHEN q >= r - 1e-12 THEN 1.0 ELSE 0 END), avg(CASE WHEN q <= r + 1e-12 THEN 1.0 ELSE 0 END))), 6) AS p
FROM tried WHERE NOT isnan(r) GROUP BY {keys}"""


# Four languages are few enough for all permutations: per source, documents against mean length over its languages.
PERMUTED = permuted("source_stats", "client_id", "lang")


@query("spearman_permutation_p", PERMUTED)
def spearman_permutation_p(spark, d):
    """Every source with at least two languages whose numbers are not all equal: all pairings."""
    found = C.spearman_permutation_p(source_stats(spark, d), ["client_id"])
    return rounded(found.where(F.col("r").isNotNull()))


view("line_correlations", """
SELECT l_returnflag AS flag, l_suppkey % 9 AS grp, corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem
GROUP BY l_returnflag, l_suppkey % 9""")


def line_correlations(spark, d):
    """Quantity against price per return flag and supplier group: one coefficient per group of the largest table."""
    lines = read_table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("flag"), (F.col("l_suppkey") % 9).alias("grp"), F.col("l_quantity").alias("x"),
        F.col("l_extendedprice").alias("y"),
    )
    return C.pearson(lines, ["flag", "grp"])


@query("clean_nonfinite", """
SELECT event_id, CASE WHEN event_id % 10 IN (0, 1, 2, 3) THEN 0 ELSE value END AS value FROM events""")
def clean_nonfinite(spark, d):
    """Every tenth value is infinite, minus infinite, not a number or missing by a fixed rule."""
    e = read_table(spark, d, "events")
    k = F.col("event_id") % 10
    broken = F.when(k == 0, float("inf")).when(k == 1, -float("inf")).when(k == 2, float("nan")).when(
        k == 3, F.lit(None).cast("double")).otherwise(F.col("value"))
    return C.clean_nonfinite(e.select("event_id", broken.alias("value")))


@query("correlation_summary", """
SELECT flag, count(*) AS n, round(min(r), 6) AS min, round(quantile_cont(r, 0.25), 6) AS q1, round(quantile_cont(r, 0.5), 6) AS median,
       round(quantile_cont(r, 0.75), 6) AS q3, round(max(r), 6) AS max FROM line_correlations WHERE grp <> 3 GROUP BY flag""")
def correlation_summary(spark, d):
    return rounded(C.correlation_summary(line_correlations(spark, d), ["flag"], F.col("grp") != 3))


@query("correlation_summary_all", """
SELECT flag, count(*) AS n, round(min(r), 6) AS min, round(quantile_cont(r, 0.25), 6) AS q1, round(quantile_cont(r, 0.5), 6) AS median,
       round(quantile_cont(r, 0.75), 6) AS q3, round(max(r), 6) AS max FROM line_correlations GROUP BY flag""")
def correlation_summary_all(spark, d):
    return rounded(C.correlation_summary(line_correlations(spark, d), ["flag"]))


@query("correlation_group_means", "SELECT flag, round(avg(r), 6) AS r FROM line_correlations GROUP BY flag")
def correlation_group_means(spark, d):
    return rounded(C.correlation_group_means(line_correlations(spark, d), ["flag"]))


# ---------------------------------------------------------------- Shapley values against measures

NAMES = ["CrossEntropyLoss", "MCC"]
view("sv_totals", """
SELECT evaluator, metric, client_id, sum(value) AS value FROM round_shapley
WHERE metric IN ('CrossEntropyLoss', 'MCC') GROUP BY ALL""")


def _totals(model):
    sv = fx.round_shapley(model, fx.round_utility(model, NAMES))
    return S.shapley_totals(sv, ["evaluator", "metric", "client_id"])


view("sv_sides", """
WITH agg AS (SELECT metric, v.client_id, sum(share * value) AS y FROM sv_totals v
  JOIN shares s ON v.evaluator = CAST(s.client_id AS VARCHAR) GROUP BY ALL)
SELECT metric, client_id, value AS x, y FROM sv_totals JOIN agg USING (metric, client_id) WHERE evaluator = 'Global'""")
view("sv_ranked", permuted("sv_sides", "metric", "client_id"))


@query("sv_agreement", """
SELECT b.metric, any_value(r.r) AS spearman, any_value(r.p) AS spearman_p, round(corr(x, y), 6) AS pearson, round(1 - abs(corr(x, y)), 6) AS pearson_p
FROM sv_sides b JOIN sv_ranked r ON r.metric = b.metric GROUP BY b.metric""")
def sv_agreement(spark, d):
    """Centralized against share-weighted values over the event silos; with four silos p of Pearson is 1 − |r|."""
    model = fx.round_model(spark, d)
    totals = control_table(_totals(model))
    profile = model.counts.groupBy("client_id", "split", "label").agg(F.sum("n").alias("n"))
    pooled = S.shapley_aggregated(totals, A.train_shares(profile), None, ["metric", "client_id"])
    both = totals.where(F.col("evaluator") == M.GLOBAL).withColumn("evaluator", F.lit("Centralized")).unionByName(
        pooled.withColumn("evaluator", F.lit("Aggregated")).select("evaluator", "metric", "client_id", "value")
    )
    return rounded(C.sv_agreement(both, ["metric"]))


@query("sv_distance_join", """
SELECT v.evaluator, CAST(v.client_id AS VARCHAR) AS client_id, metric, measure, round(v.value, 6) AS x, round(m.value, 6) AS y
FROM sv_totals v JOIN event_measures m ON v.evaluator = m.tgt AND CAST(v.client_id AS VARCHAR) = m.src""")
def sv_distance_join(spark, d):
    model = fx.round_model(spark, d)
    joined = C.sv_distance_join(_totals(model), event_measures(spark, d, model))
    return rounded(joined.select("evaluator", "client_id", "metric", "measure", "x", "y"))


view("sv_measure_pearson", """
SELECT metric, measure, v.evaluator, corr(v.value, m.value) AS r FROM sv_totals v
JOIN event_measures m ON v.evaluator = m.tgt AND CAST(v.client_id AS VARCHAR) = m.src GROUP BY ALL""")
CORRELATION_SQL = """
SELECT metric, measure, 'Centralized' AS side, round(r, 6) AS r, round(1 - abs(r), 6) AS p FROM sv_measure_pearson WHERE evaluator = 'Global'
UNION ALL SELECT metric, measure, 'Decentralized', round(tanh(avg(atanh(r))), 6), round(avg(1 - abs(r)), 6)
FROM sv_measure_pearson WHERE evaluator <> 'Global' GROUP BY metric, measure"""


@query("sv_distance_correlation", CORRELATION_SQL)
def sv_distance_correlation(spark, d):
    model = fx.round_model(spark, d)
    return rounded(C.sv_distance_correlation(_totals(model), event_measures(spark, d, model)))


view("sv_measured", """
SELECT metric, measure, v.evaluator, v.client_id, v.value AS x, m.value AS y FROM sv_totals v
JOIN event_measures m ON v.evaluator = m.tgt AND CAST(v.client_id AS VARCHAR) = m.src""")
view("sv_measure_ranked", permuted("sv_measured", "metric, measure, evaluator", "client_id"))
view("sv_measure_straight", """
SELECT metric, measure, evaluator, corr(x, y) AS r, 1 - abs(corr(x, y)) AS p FROM sv_measured GROUP BY ALL""")


@query("join_correlations", """
WITH both_ AS (SELECT metric, measure, evaluator, a.r AS s, a.p AS sp, b.r AS r, b.p AS p FROM sv_measure_ranked a JOIN sv_measure_straight b USING (metric, measure, evaluator))
SELECT metric, measure, side, round(spearman, 5) AS spearman, round(spearman_p, 5) AS spearman_p, round(pearson, 5) AS pearson, round(pearson_p, 5) AS pearson_p FROM (
  SELECT metric, measure, 'Centralized' AS side, s AS spearman, sp AS spearman_p, r AS pearson, p AS pearson_p FROM both_ WHERE evaluator = 'Global'
  UNION ALL SELECT metric, measure, 'Decentralized', tanh(avg(atanh(greatest(least(s, 1 - 1e-15), -1 + 1e-15)))), avg(sp),
    tanh(avg(atanh(greatest(least(r, 1 - 1e-15), -1 + 1e-15)))), avg(p) FROM both_ WHERE evaluator <> 'Global' GROUP BY metric, measure)""")
def join_correlations(spark, d):
    """Both coefficients with their p-values, against Global and as the mean over the silos."""
    model = fx.round_model(spark, d)
    totals, measures = control_table(_totals(model)), control_table(event_measures(spark, d, model))
    ranks, straight = (C.sv_distance_correlation(totals, measures, m) for m in ("spearman", "pearson"))
    return rounded(C.join_correlations(ranks, straight, ["metric", "measure", "side"]), 5)
