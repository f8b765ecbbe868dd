"""Registered queries: distances, volumes, transfer measures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from silovalue.functions import arrays
from silovalue.operators import count_model, distance as X, metrics as M
from silovalue.plans import fixtures as fx
from silovalue.plans.catalog import query, view
from silovalue.plans.fixtures import rounded


def line_features(spark, d):
    rows = fx.silo_lines(spark, d)
    return rows.select("client_id", F.array("a", "b").alias("features"))


def event_classes(spark, d):
    return fx.silo_events(spark, d).select("client_id", "row_id", "label")


view("event_silos", """
SELECT CAST(client_id AS VARCHAR) AS silo, * FROM silo_events UNION ALL SELECT 'Global', * FROM silo_events""")
view("silo_pairs", """
SELECT s.silo AS src, t.silo AS tgt FROM (SELECT DISTINCT silo FROM event_silos WHERE silo <> 'Global') s
CROSS JOIN (SELECT DISTINCT silo FROM event_silos) t""")
view("hellinger_table", """
WITH shares AS (SELECT silo, label, coalesce(n, 0)::DOUBLE / sum(n) OVER (PARTITION BY silo) AS p
  FROM (SELECT DISTINCT silo FROM event_silos) CROSS JOIN (SELECT DISTINCT label FROM events2)
  LEFT JOIN (SELECT silo, label, count(*) AS n FROM event_silos GROUP BY ALL) USING (silo, label))
SELECT src, tgt, sqrt(sum((sqrt(a.p) - sqrt(b.p)) ** 2)) / sqrt(2) AS value
FROM silo_pairs JOIN shares a ON a.silo = src JOIN shares b ON b.silo = tgt AND b.label = a.label GROUP BY src, tgt""")
view("events2", "SELECT DISTINCT label FROM silo_events")


@query("hellinger", "SELECT src, tgt, round(value, 6) AS value FROM hellinger_table")
def hellinger(spark, d):
    return rounded(X.hellinger(event_classes(spark, d)))


view("nce_table", """
WITH places AS (
  SELECT CAST(client_id AS VARCHAR) AS silo, label, row_number() OVER (PARTITION BY client_id ORDER BY row_id) AS pos FROM silo_events
  UNION ALL SELECT 'Global', label, row_number() OVER (ORDER BY row_id) FROM silo_events),
sizes AS (SELECT silo, count(*) AS rows FROM places GROUP BY silo),
joint AS (SELECT s.silo AS src, t.silo AS tgt, s.label AS z, t.label AS y, count(*) AS n
  FROM places s JOIN places t ON s.pos = t.pos WHERE s.silo <> 'Global' GROUP BY ALL),
cells AS (SELECT src, tgt, z, y, coalesce(n, 0) AS n, sum(n) OVER (PARTITION BY src, tgt, z) AS nz
  FROM (SELECT DISTINCT src, tgt, z FROM joint) CROSS JOIN (SELECT label AS y FROM events2)
  LEFT JOIN joint USING (src, tgt, z, y))
SELECT src, tgt, sum(nz::DOUBLE / rows * (n::DOUBLE / nz + 1e-20) * ln(n::DOUBLE / nz + 1e-20)) AS value
FROM cells JOIN sizes ON sizes.silo = src GROUP BY src, tgt""")


@query("negative_conditional_entropy", "SELECT src, tgt, round(value, 6) AS value FROM nce_table")
def negative_conditional_entropy(spark, d):
    return rounded(X.negative_conditional_entropy(event_classes(spark, d)))


# ---------------------------------------------------------------- moments and cells (order lines, two features)

view("line_silos", """
SELECT CAST(client_id AS VARCHAR) AS silo, a, b FROM silo_lines UNION ALL SELECT 'Global', a, b FROM silo_lines""")
view("line_moments", """
SELECT silo, count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb,
       var_samp(a) AS va, covar_samp(a, b) AS vab, var_samp(b) AS vb FROM line_silos GROUP BY silo""")


@query("gramian", "SELECT silo AS client_id, n, round(aa, 4) AS aa, round(ab, 4) AS ab, round(bb, 4) AS bb FROM line_moments")
def gramian(spark, d):
    moments = X.gramian(line_features(spark, d))
    s = F.col("second")
    return rounded(moments.select("client_id", "n", s[0].alias("aa"), s[1].alias("ab"), s[3].alias("bb")), 4)


@query("volume", "SELECT silo AS client_id, round(sqrt(aa * bb - ab * ab + 1e-8), 3) AS value FROM line_moments")
def volume(spark, d):
    return rounded(X.volume(line_features(spark, d)), 3)


view("line_cells", """
WITH lows AS (SELECT silo, min(a) AS la, min(b) AS lb FROM line_silos GROUP BY silo)
SELECT silo, CAST(floor((a - la) / 0.1) AS BIGINT) AS ca, CAST(floor((b - lb) / 0.1) AS BIGINT) AS cb,
       count(*) AS n, avg(a) AS ma, avg(b) AS mb FROM line_silos JOIN lows USING (silo) GROUP BY ALL""")


@query("cube_compress", """
SELECT silo AS client_id, [ca, cb] AS cell, n, [round(ma * n, 4), round(mb * n, 4)] AS total FROM line_cells""")
def cube_compress(spark, d):
    cells = X.cube_compress(line_features(spark, d))
    return cells.select("client_id", "cell", "n", F.transform("center", lambda x: F.round(x * F.col("n"), 4)).alias("total"))


@query("robust_volume", """
WITH sizes AS (SELECT silo, count(*) AS cells, sum(ma * ma) AS aa, sum(ma * mb) AS ab, sum(mb * mb) AS bb FROM line_cells GROUP BY silo),
weights AS (SELECT silo, exp(sum(ln(1 - (1.0 / (10 * cells)) ** (n + 1)) - ln(1 - 1.0 / (10 * cells)))) AS w
  FROM line_cells JOIN sizes USING (silo) GROUP BY silo)
SELECT silo AS client_id, round(sqrt(aa * bb - ab * ab + 1e-8) * w, 3) AS value FROM sizes JOIN weights USING (silo)""")
def robust_volume(spark, d):
    return X.robust_volume(line_features(spark, d))


@query("relevance_diversity", """
WITH squares AS (SELECT silo, (va * va + vab * vab) / n AS p, (va * vab + vab * vb) / n AS q, (vab * vab + vb * vb) / n AS r FROM line_moments),
eigen AS (SELECT silo, unnest([(p + r) / 2 + sqrt(((p - r) / 2) ** 2 + q * q), (p + r) / 2 - sqrt(((p - r) / 2) ** 2 + q * q)]) AS l, p, q, r FROM squares),
axes AS (SELECT silo, l, CASE WHEN q = 0 THEN CASE WHEN abs(l - p) <= abs(l - r) THEN 1 ELSE 0 END ELSE q / sqrt(q * q + (l - p) ** 2) END AS x,
  CASE WHEN q = 0 THEN CASE WHEN abs(l - p) <= abs(l - r) THEN 0 ELSE 1 END ELSE (l - p) / sqrt(q * q + (l - p) ** 2) END AS y FROM eigen),
found AS (SELECT s.silo AS src, t.silo AS tgt, abs(s.l) AS l, sqrt((t.p * s.x + t.q * s.y) ** 2 + (t.q * s.x + t.r * s.y) ** 2) AS m
  FROM axes s CROSS JOIN squares t WHERE s.silo <> 'Global')
SELECT src, tgt, round(exp(sum(ln(least(l, m) / greatest(l, m))) / 2), 5) AS relevance,
       round(exp(sum(ln(greatest(abs(l - m), 1e-300) / greatest(l, m))) / 2), 5) AS diversity FROM found GROUP BY src, tgt""")
def relevance_diversity(spark, d):
    return rounded(X.relevance_diversity(line_features(spark, d)), 5)


@query("relevance_diversity_pca", """
WITH scores AS (SELECT silo, n, unnest([1 + abs(vab) / sqrt(va * vb), 1 - abs(vab) / sqrt(va * vb)]) AS variance, unnest([1, 2]) AS component FROM line_moments),
squares AS (SELECT silo, component, (variance * n / (n - 1)) ** 2 / n AS l FROM scores)
SELECT s.silo AS src, t.silo AS tgt, round(exp(sum(ln(least(s.l, t.l) / greatest(s.l, t.l))) / 2), 5) AS relevance,
       round(exp(sum(ln(greatest(abs(s.l - t.l), 1e-300) / greatest(s.l, t.l))) / 2), 5) AS diversity
FROM squares s JOIN squares t USING (component) WHERE s.silo <> 'Global' GROUP BY s.silo, t.silo""")
def relevance_diversity_pca(spark, d):
    """On standardised principal scores, of which two features have two."""
    return rounded(X.relevance_diversity(line_features(spark, d), components=2), 5)


@query("pca_fit")
def pca_fit(spark, d):
    return rounded(X.pca_fit(fx.silo_vectors(spark, d)).select("client_id", "component", "variance"), 6)


@query("pca_transform")
def pca_transform(spark, d):
    rows = fx.silo_vectors(spark, d)
    return X.pca_transform(rows, X.pca_fit(rows), "Global").select("row_id", "client_id", "scores")


@query("robust_volume_pca")
def robust_volume_pca(spark, d):
    """As in the published measures: ten standardised components per silo, then cells and volume."""
    rows = fx.silo_vectors(spark, d)
    scores = X.pca_transform(rows, X.pca_fit(rows)).select("client_id", F.col("scores").alias("features"))
    return X.robust_volume(scores)


# ---------------------------------------------------------------- kernels and transport (vectors)


def kernel_views(prefix: str, rate: int) -> None:
    """Views of all-pairs kernel sums exp(-rate · distance²) per pair of silos, and the distances from them."""
    view(f"{prefix}_pairs", f"""
SELECT CAST(a.client_id AS VARCHAR) AS s, CAST(b.client_id AS VARCHAR) AS t, sum(exp(-{rate} * list_distance(a.features, b.features) ** 2)) AS k
FROM silo_vectors a CROSS JOIN silo_vectors b GROUP BY ALL""")
    view(f"{prefix}_kernel", f"""
WITH sides AS (SELECT s, t, k FROM {prefix}_pairs UNION ALL SELECT s, 'Global', sum(k) FROM {prefix}_pairs GROUP BY s
  UNION ALL SELECT 'Global', 'Global', sum(k) FROM {prefix}_pairs),
sizes AS (SELECT CAST(client_id AS VARCHAR) AS silo, count(*) AS n FROM silo_vectors GROUP BY client_id
  UNION ALL SELECT 'Global', count(*) FROM silo_vectors),
own AS (SELECT s AS silo, k / n / n AS m FROM sides JOIN sizes ON silo = s WHERE s = t)
SELECT x.s AS src, x.t AS tgt, a.m / 2 + b.m / 2 - x.k / p.n / q.n AS value
FROM sides x JOIN own a ON a.silo = x.s JOIN own b ON b.silo = x.t JOIN sizes p ON p.silo = x.s JOIN sizes q ON q.silo = x.t
WHERE x.s <> 'Global'""")


kernel_views("wide", 2)
kernel_views("narrow", 200)


@query("gaussian_mmd", "SELECT src, tgt, round(value, 6) AS value FROM wide_kernel")
def gaussian_mmd(spark, d):
    """Kernel width 0.5, where the unit vectors of the table do see each other."""
    return rounded(X.gaussian_mmd(fx.silo_vectors(spark, d), sigma=0.5))


@query("gaussian_mmd_narrow", "SELECT src, tgt, round(value, 8) AS value FROM narrow_kernel")
def gaussian_mmd_narrow(spark, d):
    """The published width 0.05."""
    return rounded(X.gaussian_mmd(fx.silo_vectors(spark, d)), 8)


FREQUENCIES = np.round(np.random.RandomState(3).normal(scale=2.0, size=(12, 64)), 3)
DIRECTIONS = np.round(X.directions(64, 6, 5), 6)


def matrix_sql(m: np.ndarray) -> str:
    return "[" + ", ".join("[" + ", ".join(repr(float(v)) for v in row) + "]" for row in m) + "]::DOUBLE[][]"


@query("gaussian_mmd_rff", f"""
WITH w AS (SELECT unnest({matrix_sql(FREQUENCIES)}) AS w, unnest(range(12)) AS i),
rows AS (SELECT CAST(client_id AS VARCHAR) AS silo, features FROM silo_vectors UNION ALL SELECT 'Global', features FROM silo_vectors),
means AS (SELECT silo, i, avg(cos(list_dot_product(features, w))) AS c, avg(sin(list_dot_product(features, w))) AS s
  FROM rows CROSS JOIN w GROUP BY ALL)
SELECT a.silo AS src, b.silo AS tgt, round(sum((a.c - b.c) ** 2 + (a.s - b.s) ** 2) / 24, 6) AS value
FROM means a JOIN means b USING (i) WHERE a.silo <> 'Global' GROUP BY ALL""")
def gaussian_mmd_rff(spark, d):
    return rounded(X.gaussian_mmd_rff(fx.silo_vectors(spark, d), FREQUENCIES))


@query("wasserstein_sliced", f"""
WITH w AS (SELECT unnest({matrix_sql(DIRECTIONS)}) AS w, unnest(range(6)) AS i),
rows AS (SELECT CAST(client_id AS VARCHAR) AS silo, features FROM silo_vectors UNION ALL SELECT 'Global', features FROM silo_vectors),
ranked AS (SELECT silo, i, list_dot_product(features, w) AS v, row_number() OVER (PARTITION BY silo, i ORDER BY list_dot_product(features, w)) AS rank,
  count(*) OVER (PARTITION BY silo, i) AS n FROM rows CROSS JOIN w),
quantiles AS (SELECT silo, i, q, v FROM ranked JOIN (SELECT unnest(range(100)) AS q) ON rank = CAST(ceil((q + 0.5) * n / 100) AS BIGINT))
SELECT a.silo AS src, b.silo AS tgt, round(avg((a.v - b.v) ** 2), 6) AS value
FROM quantiles a JOIN quantiles b USING (i, q) WHERE a.silo <> 'Global' GROUP BY ALL""")
def wasserstein_sliced(spark, d):
    return rounded(X.wasserstein_sliced(fx.silo_vectors(spark, d), DIRECTIONS))


@query("wasserstein_sinkhorn")
def wasserstein_sinkhorn(spark, d):
    return rounded(X.wasserstein_sinkhorn(fx.silo_vectors(spark, d)))


view("coupling", """
WITH s AS (SELECT value, sum(count(*)) OVER (ORDER BY value) AS hi, count(*) AS n FROM silo_events WHERE client_id = 0 GROUP BY value),
t AS (SELECT value, sum(count(*)) OVER (ORDER BY value) AS hi, count(*) AS n FROM silo_events WHERE client_id = 1 GROUP BY value),
z AS (SELECT (SELECT sum(n) FROM s)::BIGINT AS ns, (SELECT sum(n) FROM t)::BIGINT AS nt),
x AS (SELECT value, (hi * nt)::BIGINT AS hi, ((hi - n) * nt)::BIGINT AS lo FROM s CROSS JOIN z),
y AS (SELECT value, (hi * ns)::BIGINT AS hi, ((hi - n) * ns)::BIGINT AS lo FROM t CROSS JOIN z)
SELECT x.value AS src_value, y.value AS tgt_value, (least(x.hi, y.hi) - greatest(x.lo, y.lo))::DOUBLE / ns / nt AS mass
FROM x JOIN y ON x.lo < y.hi AND y.lo < x.hi CROSS JOIN z""")


def _coupling(spark, d):
    rows = fx.silo_events(spark, d).select("client_id", "value")
    return X.transport_1d(rows.where(F.col("client_id") == 0), rows.where(F.col("client_id") == 1))


@query("transport_1d", "SELECT src_value, tgt_value, round(mass, 9) AS mass FROM coupling")
def transport_1d(spark, d):
    return rounded(_coupling(spark, d), 9, "mass")


@query("transport_cost", "SELECT round(sum(mass * (src_value - tgt_value) ** 2), 4) AS cost FROM coupling")
def transport_cost(spark, d):
    return rounded(X.transport_cost(_coupling(spark, d)), 4)


@query("label_coupling_entropy", """
WITH joint AS (SELECT CAST(floor(src_value / 20) AS BIGINT) AS y1, CAST(floor(tgt_value / 25) AS BIGINT) AS y2, sum(mass) AS p
  FROM coupling GROUP BY ALL)
SELECT round(sum(-p * ln(p / p1)), 6) AS value FROM (SELECT *, sum(p) OVER (PARTITION BY y1) AS p1 FROM joint) WHERE p > 0""")
def label_coupling_entropy(spark, d):
    """The class of a source value is its band of 20, that of a target value its band of 25."""
    plan = _coupling(spark, d).withColumnsRenamed({"src_value": "src", "tgt_value": "tgt"})
    left = plan.select("src").distinct().withColumn("y1", F.floor(F.col("src") / 20))
    right = plan.select("tgt").distinct().withColumn("y2", F.floor(F.col("tgt") / 25))
    return rounded(X.label_coupling_entropy(plan, left, right))


view("coupling_pairs", """
WITH c AS (SELECT client_id, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY client_id ORDER BY value) AS hi FROM silo_events GROUP BY client_id, value),
z AS (SELECT client_id, sum(n)::BIGINT AS rows FROM c GROUP BY client_id),
x AS (SELECT s.client_id AS src, t.client_id AS tgt, value, s.rows AS ns, t.rows AS nt, (hi * t.rows)::BIGINT AS hi, ((hi - n) * t.rows)::BIGINT AS lo
  FROM c JOIN z s ON s.client_id = c.client_id JOIN z t ON t.client_id <> c.client_id),
y AS (SELECT s.client_id AS src, t.client_id AS tgt, value, (hi * s.rows)::BIGINT AS hi, ((hi - n) * s.rows)::BIGINT AS lo
  FROM c JOIN z t ON t.client_id = c.client_id JOIN z s ON s.client_id <> c.client_id)
SELECT x.src, x.tgt, x.value AS src_value, y.value AS tgt_value, (least(x.hi, y.hi) - greatest(x.lo, y.lo))::DOUBLE / ns / nt AS mass
FROM x JOIN y ON x.src = y.src AND x.tgt = y.tgt AND x.lo < y.hi AND y.lo < x.hi""")


def _all_couplings(spark, d):
    rows = fx.silo_events(spark, d).select("client_id", "value")
    pairs = X.client_pairs(rows).where((F.col("src") != F.col("tgt")) & (F.col("tgt") != M.GLOBAL))
    return X.transport_pairs(rows, pairs)


@query("transport_cost_pairs", """
SELECT CAST(src AS VARCHAR) AS src, CAST(tgt AS VARCHAR) AS tgt, round(sum(mass * (src_value - tgt_value) ** 2), 4) AS cost FROM coupling_pairs GROUP BY src, tgt""")
def transport_cost_pairs(spark, d):
    return rounded(X.transport_cost(_all_couplings(spark, d), ["src", "tgt"]), 4)


@query("label_coupling_entropy_pairs", """
WITH joint AS (SELECT src, tgt, CAST(floor(src_value / 20) AS BIGINT) AS y1, CAST(floor(tgt_value / 25) AS BIGINT) AS y2, sum(mass) AS p FROM coupling_pairs GROUP BY ALL)
SELECT CAST(src AS VARCHAR) AS source, CAST(tgt AS VARCHAR) AS target, round(sum(-p * ln(p / p1)), 6) AS value
FROM (SELECT *, sum(p) OVER (PARTITION BY src, tgt, y1) AS p1 FROM joint) WHERE p > 0 GROUP BY src, tgt""")
def label_coupling_entropy_pairs(spark, d):
    """All pairs of silos; the class of a source value is its band of 20, that of a target value its band of 25."""
    plan = _all_couplings(spark, d).toDF("source", "target", "src", "tgt", "mass")
    left = plan.select("src").distinct().withColumn("y1", F.floor(F.col("src") / 20))
    right = plan.select("tgt").distinct().withColumn("y2", F.floor(F.col("tgt") / 25))
    return rounded(X.label_coupling_entropy(plan, left, right, ["source", "target"]))


# ---------------------------------------------------------------- transfer (events)

view("silo_models", """
SELECT silo, bucket, label, (coalesce(k, 0) + 1.0::DOUBLE) / (sum(coalesce(k, 0)) OVER (PARTITION BY silo, bucket) + count(*) OVER (PARTITION BY silo, bucket)) AS value
FROM (SELECT DISTINCT silo FROM event_silos) CROSS JOIN bucket_names CROSS JOIN class_names
LEFT JOIN (SELECT silo, bucket, label, count(*) AS k FROM event_silos WHERE split = 'train' GROUP BY ALL) USING (silo, bucket, label)""")
view("degradation_table", """
WITH losses AS (SELECT m.silo AS model, t.silo, avg(-ln(m.value)) AS value FROM event_silos t JOIN silo_models m
  ON m.bucket = t.bucket AND m.label = t.label WHERE t.split = 'test' GROUP BY ALL)
SELECT a.model AS src, a.silo AS tgt, a.value - b.value AS value FROM losses a JOIN losses b ON b.silo = a.silo AND b.model = a.silo
WHERE a.model <> 'Global'""")


def silo_models(model: fx.EventModel):
    """Count models of every silo and of Global's rows."""
    both = X.with_global_silo(model.train).groupBy("client_id", "bucket", "label").agg(F.sum("n").alias("n"))
    return count_model.fit_per_client(both, model.labels, model.buckets)


def cross_losses(model: fx.EventModel):
    """(model, client_id, value): cross entropy of every model on every test set, from counts."""
    test = X.with_global_silo(model.test).groupBy("client_id", "bucket", "label").agg(F.sum("n").alias("n"))
    fitted = silo_models(model).select(F.col("client_id").alias("model"), "bucket", "label", "value")
    return test.join(fitted, ["bucket", "label"]).groupBy("model", "client_id").agg(
        (F.sum(F.col("n") * M.cross_entropy(F.col("value"))) / F.sum("n")).alias("value")
    )


@query("performance_degradation", "SELECT src, tgt, round(value, 6) AS value FROM degradation_table")
def performance_degradation(spark, d):
    return rounded(X.performance_degradation(cross_losses(fx.EventModel(spark, d))))


view("shift_rows", """
SELECT silo, bucket, label, ('0x' || substr(md5('13:' || row_id), 1, 8))::BIGINT % 8 AS fold FROM event_silos""")
view("shift_cells", """
WITH cnt AS (SELECT silo, fold, bucket, count(*) AS inside FROM shift_rows GROUP BY ALL),
tot AS (SELECT silo, bucket, sum(inside) AS n FROM cnt GROUP BY ALL),
outside AS (SELECT silo, fold, bucket, coalesce(n, 0) - coalesce(inside, 0) AS m
  FROM (SELECT DISTINCT silo FROM cnt) CROSS JOIN (SELECT DISTINCT fold FROM cnt) CROSS JOIN (SELECT DISTINCT bucket FROM cnt)
  LEFT JOIN cnt USING (silo, fold, bucket) LEFT JOIN tot USING (silo, bucket)),
sizes AS (SELECT silo, count(*)::DOUBLE AS rows FROM shift_rows GROUP BY silo),
winners AS (SELECT silo AS src, bucket, arg_max(label, (value, -pos)) AS predicted FROM (
  SELECT *, row_number() OVER (PARTITION BY silo, bucket ORDER BY label) AS pos FROM silo_models) GROUP BY ALL),
hits AS (SELECT silo, src, fold, r.bucket, count(*) AS n, sum(CASE WHEN label = predicted THEN 1 ELSE 0 END) AS hit
  FROM shift_rows r JOIN winners w ON w.bucket = r.bucket GROUP BY ALL),
pis AS (SELECT src, tgt, s.fold, s.bucket, (t.m + 1) / (s.m + t.m + 2)::DOUBLE AS pi, b.rows / (a.rows + b.rows) AS alpha
  FROM silo_pairs JOIN outside s ON s.silo = src JOIN outside t ON t.silo = tgt AND t.fold = s.fold AND t.bucket = s.bucket
  JOIN sizes a ON a.silo = src JOIN sizes b ON b.silo = tgt)
SELECT p.src, p.tgt, pi / ((1 - alpha) * pi + alpha * (1 - pi)) AS w_s, (1 - pi) / ((1 - alpha) * pi + alpha * (1 - pi)) AS w_t,
       coalesce(x.n, 0) AS n_s, coalesce(x.hit, 0) AS hit_s, coalesce(y.n, 0) AS n_t, coalesce(y.hit, 0) AS hit_t
FROM pis p LEFT JOIN hits x ON x.silo = p.src AND x.src = p.src AND x.fold = p.fold AND x.bucket = p.bucket
LEFT JOIN hits y ON y.silo = p.tgt AND y.src = p.src AND y.fold = p.fold AND y.bucket = p.bucket""")
view("shift_table", """
SELECT src, tgt, p2p - q2q AS degradation, (p2s - s2q) / nullif(p2p - q2q, 0) AS shift FROM (
  SELECT src, tgt, sum(hit_s)::DOUBLE / sum(n_s) AS p2p, sum(hit_t)::DOUBLE / sum(n_t) AS q2q,
         sum(w_s * hit_s) / sum(w_s * n_s) AS p2s, sum(w_t * hit_t) / sum(w_t * n_t) AS s2q FROM shift_cells GROUP BY src, tgt)""")


def winners(model: fx.EventModel):
    """(src, bucket, predicted) of every silo's model."""
    vectors = silo_models(model).groupBy("client_id", "bucket").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("label", "value"))), lambda s: s["value"]).alias("p")
    )
    return vectors.where(F.col("client_id") != M.GLOBAL).select(
        F.col("client_id").alias("src"), "bucket", F.element_at(model.labels, arrays.argmax(F.col("p")) + 1).alias("predicted")
    )


@query("y_shift", "SELECT src, tgt, round(degradation, 6) AS degradation, round(shift, 4) AS shift FROM shift_table")
def y_shift(spark, d):
    model = fx.EventModel(spark, d)
    found = X.y_shift(X.domain_counts(fx.silo_events(spark, d)), winners(model))
    return found.select("src", "tgt", F.round("degradation", 6).alias("degradation"), F.round("shift", 4).alias("shift"))


@query("shared_density_ratio", """
WITH t AS (SELECT 0.4::DOUBLE AS alpha)
SELECT 'orders' AS src, 'lines' AS tgt, round(p2p - q2q, 6) AS degradation, round((p2s - s2q) / nullif(p2p - q2q, 0), 4) AS shift FROM (
  SELECT avg(CASE WHEN side = 0 THEN hit END) AS p2p, avg(CASE WHEN side = 1 THEN hit END) AS q2q,
    sum(CASE WHEN side = 0 THEN w * hit END) / sum(CASE WHEN side = 0 THEN w END) AS p2s,
    sum(CASE WHEN side = 1 THEN w * hit END) / sum(CASE WHEN side = 1 THEN w END) AS s2q FROM (
    SELECT side, hit, CASE WHEN side = 0 THEN pi ELSE 1 - pi END / (0.6 * pi + 0.4 * (1 - pi)) AS w FROM (
      SELECT CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS side, CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0 END AS hit,
        (l_quantity + 1) / 52 AS pi FROM lineitem)))""")
def shared_density_ratio(spark, d):
    """The last step alone, on scored rows: all order lines, two domains by return flag, π from the quantity."""
    from silovalue.sources.tables import read_table

    pi = (F.col("l_quantity") + 1) / 52
    mix = 0.6 * pi + 0.4 * (1 - pi)
    source = F.col("l_returnflag") == "A"
    hit = (F.col("l_linestatus") == "F").cast("int")
    rows = read_table(spark, d, "lineitem").select(
        F.lit("orders").alias("src"), F.lit("lines").alias("tgt"), (pi / mix).alias("w_s"), ((1 - pi) / mix).alias("w_t"),
        source.cast("int").alias("n_s"), F.when(source, hit).otherwise(0).alias("hit_s"),
        (~source).cast("int").alias("n_t"), F.when(~source, hit).otherwise(0).alias("hit_t"),
    )
    found = X.shared_density_ratio(rows)
    return found.select("src", "tgt", F.round("degradation", 6).alias("degradation"), F.round("shift", 4).alias("shift"))


@query("global_reference", "SELECT silo AS client_id, row_id, label FROM event_silos")
def global_reference(spark, d):
    return X.with_global_silo(event_classes(spark, d)).select("client_id", "row_id", "label")


def event_measures(spark, d, model: fx.EventModel):
    """Long table of the class measures of the event silos."""
    return X.distance_matrix({
        "hellinger": X.hellinger(event_classes(spark, d)),
        "negativeConditionalEntropy": X.negative_conditional_entropy(event_classes(spark, d)),
        "performanceDegradation": X.performance_degradation(cross_losses(model)),
    })


view("event_measures", """
SELECT 'hellinger' AS measure, src, tgt, value FROM hellinger_table
UNION ALL SELECT 'negativeConditionalEntropy', src, tgt, value FROM nce_table
UNION ALL SELECT 'performanceDegradation', src, tgt, value FROM degradation_table""")


@query("distance_matrix", "SELECT measure, src, tgt, round(value, 6) AS value FROM event_measures")
def distance_matrix(spark, d):
    return rounded(event_measures(spark, d, fx.EventModel(spark, d)))


WIDE = ", ".join(f"round(max(value) FILTER (WHERE tgt = '{t}'), 6) AS \"{t}\"" for t in ("Global", "0", "1", "2", "3"))


@query("sink_distances", f"SELECT src, {WIDE} FROM hellinger_table GROUP BY src")
def sink_distances(spark, d):
    from silovalue.sources.tables import sink_distances as sink

    table = X.distance_matrix({"hellinger": X.hellinger(event_classes(spark, d))})
    return rounded(sink(table, "hellinger", ["Global", "0", "1", "2", "3"]))


@query("scan_distance_matrix", "SELECT src, tgt, round(value, 6) AS value FROM nce_table")
def scan_distance_matrix(spark, d):
    from silovalue.functions.lineage import scratch_path
    from silovalue.sources import tables as T

    names = ["Global", "0", "1", "2", "3"]
    table = X.distance_matrix({"negativeConditionalEntropy": X.negative_conditional_entropy(event_classes(spark, d))})
    path = scratch_path(spark, "distance")
    T.write_report(T.sink_distances(table, "negativeConditionalEntropy", names), path)
    schema = "src string, " + ", ".join(f"`{n}` double" for n in names)
    return rounded(T.scan_distance_matrix(T.scan_csv(spark, path, schema)))


@query("reports_distances", "SELECT measure, src, tgt, round(value, 6) AS value FROM event_measures")
def reports_distances(spark, d):
    from silovalue.plans.q_prep import _reported
    from silovalue.sources import tables as T

    table = event_measures(spark, d, fx.EventModel(spark, d))
    found = _reported(spark, table, ["Global", "0", "1", "2", "3"], T.sink_distances, T.scan_distance_matrix, "measure")
    return rounded(found.select("measure", "src", "tgt", "value"))
