"""Distances, volumes and transfer measures between silos.

Statistics are computed once per silo (class counts, moments, cells, quantiles) and only then paired; Global is a silo of
its own that every row also belongs to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from silovalue.functions import arrays
from silovalue.functions.hashing import fold
from silovalue.functions.lineage import control_table, small_side
from silovalue.functions.ranking import cumulative_counts, ordered_rank, quantile_bounds, quantile_bucket
from silovalue.operators.count_model import distinct_list
from silovalue.operators.fit import partial_sums
from silovalue.operators.metrics import GLOBAL

MAX_SILOS = 10_000


def with_global_silo(df: DataFrame, client: str = "client_id") -> DataFrame:
    """Every row under its own silo and under Global."""
    return df.withColumn(client, F.explode(F.array(F.col(client).cast("string"), F.lit(GLOBAL))))


def client_pairs(df: DataFrame, client: str = "client_id") -> DataFrame:
    """(src, tgt): every silo against every silo, itself and Global included."""
    silos = distinct_list(df, client, MAX_SILOS)
    names = F.transform("a", lambda c: c.cast("string"))
    one = silos.select(names.alias("a"))
    return one.select("a", F.explode("a").alias("src")).select(
        "src", F.explode(F.concat("a", F.array(F.lit(GLOBAL)))).alias("tgt")
    )


def pair_up(stats: DataFrame, columns: list[str], client: str = "client_id") -> DataFrame:
    """(src, tgt, <column>_s, <column>_t) from one row of statistics per silo; Global only as target."""
    pairs = client_pairs(stats.where(F.col(client) != GLOBAL), client)
    left = stats.select(F.col(client).alias("src"), *[F.col(c).alias(f"{c}_s") for c in columns])
    right = stats.select(F.col(client).alias("tgt"), *[F.col(c).alias(f"{c}_t") for c in columns])
    return pairs.join(left, "src").join(right, "tgt")


# ---------------------------------------------------------------- classes


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """(client_id, shares): class shares of every silo and of Global as arrays over the sorted class list."""
    counts = df.groupBy("client_id", label).agg(F.count(F.lit(1)).alias("n"))
    both = control_table(with_global_silo(counts).groupBy("client_id", label).agg(F.sum("n").alias("n")))
    labels = distinct_list(both, label).scalar()
    grid = both.select("client_id").distinct().withColumn(label, F.explode(labels))
    filled = grid.join(both, ["client_id", label], "left").select("client_id", label, F.coalesce("n", F.lit(0)).alias("n"))
    listed = filled.groupBy("client_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(label, "n"))), lambda s: s["n"].cast("double")).alias("n")
    )
    return listed.withColumn("total", arrays.total(F.col("n"))).select(
        "client_id", F.transform("n", lambda x: x / F.col("total")).alias("shares")
    )


def hellinger(df: DataFrame, label: str = "label") -> DataFrame:
    """(src, tgt, value): (1/√2)·‖√p − √q‖ of the class shares."""
    pairs = pair_up(class_distribution(df, label), ["shares"])
    gap = arrays.total(F.zip_with("shares_s", "shares_t", lambda p, q: F.pow(F.sqrt(p) - F.sqrt(q), F.lit(2.0))))
    return pairs.select("src", "tgt", F.sqrt(gap / 2).alias("value"))


JOINT_NUMBERS = 4_000_000  # of the table of joint counts that a task holds for one block of sources


def paired_label_counts(df: DataFrame, order: str = "row_id", label: str = "label") -> DataFrame:
    """(src, tgt, z, y, n): how often the source's label z and the target's label y stand at the same place in row order.

    The labels of one place, one of each silo and one of Global at most, are gathered in one row; a task turns its rows into
    one-hot vectors and adds up their products, so that all pairs of silos are counted in one matrix product and only counts
    leave the task. Rows without a label or a silo keep their place but pair with nothing.
    """
    spark = df.sparkSession
    silos = sorted(str(r[0]) for r in df.select("client_id").where("client_id IS NOT NULL").distinct().limit(MAX_SILOS + 1).collect())
    if len(silos) > MAX_SILOS:
        raise ValueError(f"more than {MAX_SILOS} silos")
    labels = sorted(r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().collect())
    names, k = [*silos, GLOBAL], len(labels)
    own = quantile_bucket(df.select("client_id", order, label), [order], ["_place"])
    local = ordered_rank(own, ["client_id"], order, "_pos", "_place").withColumn("client_id", F.col("client_id").cast("string"))
    pooled = ordered_rank(own, [], order, "_pos", "_place").withColumn("client_id", F.lit(GLOBAL))
    place = lambda values, column: F.array_position(F.array(*[F.lit(v) for v in values]), column).cast("int") - 1
    coded = local.unionByName(pooled.select(*local.columns)).where(F.col("client_id").isNotNull() & F.col(label).isNotNull()).select(
        "_pos", (place(names, F.col("client_id")) * k + place(labels, F.col(label))).alias("code"))
    gathered = coded.groupBy("_pos").agg(F.collect_list("code").alias("codes")).select("codes")  # one for each silo at most
    wide = len(names) * k

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(k, JOINT_NUMBERS // max(1, wide) // max(1, k) * k)
        sums = {a: np.zeros((min(step, len(silos) * k - a), wide)) for a in range(0, len(silos) * k, step)}
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, JOINT_NUMBERS // max(1, wide))):
                codes = batch.column("codes").slice(at, max(1, JOINT_NUMBERS // max(1, wide)))
                hot = np.zeros((len(codes), wide), dtype=np.float32)
                sizes = codes.value_lengths().to_numpy(zero_copy_only=False)
                hot[np.repeat(np.arange(len(codes)), sizes), codes.flatten().to_numpy(zero_copy_only=False)] = 1
                for a, found in sums.items():
                    found += hot[:, a : a + len(found)].T @ hot
        for a, found in sums.items():
            i, j = np.nonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array((i + a).astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(found[i, j].astype(np.int64))], ["s", "t", "n"])

    counted = gathered.mapInArrow(count, "s int, t int, n bigint").groupBy("s", "t").agg(F.sum("n").alias("n"))
    name = lambda values, column: F.element_at(F.array(*[F.lit(v) for v in values]), (column + 1).cast("int"))
    if not names or not k:
        return spark.createDataFrame([], f"src string, tgt string, z {dict(df.dtypes)[label]}, y {dict(df.dtypes)[label]}, n bigint")
    return counted.select(
        name(names, F.floor(F.col("s") / k)).alias("src"), name(names, F.floor(F.col("t") / k)).alias("tgt"),
        name(labels, F.col("s") % k).alias("z"), name(labels, F.col("t") % k).alias("y"), "n")


def negative_conditional_entropy(df: DataFrame, order: str = "row_id", label: str = "label") -> DataFrame:
    """(src, tgt, value): labels paired by position in row order, Σ P(z) Σ_y P(y|z) ln P(y|z) with +1e-20.

    Pairing stops at the shorter side; the joint is divided by the rows of the source. y runs over classes up to the largest
    one of the target. Sizes and classes come from one count of silo and class.
    """
    cells = control_table(df.groupBy(F.col("client_id").cast("string").alias("client_id"), label).agg(F.count(F.lit(1)).alias("n")))
    joint = control_table(paired_label_counts(df, order, label))
    sizes = cells.groupBy(F.col("client_id").alias("src")).agg(F.sum("n").alias("rows"))
    labels = distinct_list(cells, label)
    largest = cells.groupBy(F.col("client_id").alias("tgt")).agg(F.max(label).alias("top"))
    everywhere = cells.agg(F.lit(GLOBAL).alias("tgt"), F.max(label).alias("top"))
    width = largest.unionByName(everywhere).withColumn("a", labels.scalar()).select(
        "tgt", F.array_position("a", F.col("top")).alias("classes")
    )
    given = joint.groupBy("src", "tgt", "z").agg(F.sum("n").alias("nz"), F.collect_list("n").alias("ns"))
    tiny = F.lit(1e-20)
    seen = F.aggregate(
        "ns", F.lit(0.0), lambda s, n: s + (n / F.col("nz") + tiny) * F.ln(n / F.col("nz") + tiny)
    )
    unseen = (F.col("classes") - F.size("ns")) * tiny * F.ln(tiny)
    return given.join(sizes, "src").join(width, "tgt").groupBy("src", "tgt").agg(
        F.sum(F.col("nz") / F.col("rows") * (seen + unseen)).alias("value")
    )


# ---------------------------------------------------------------- moments


def gramian(df: DataFrame, features: str = "features") -> DataFrame:
    """(client_id, n, means, second) for every silo and Global: Σx/n and Σxxᵀ, d×d numbers per silo.

    Tasks multiply their batches with NumPy; Global is the sum of the silos' sums. It is a small checkpointed table. Rows
    without a vector are left out; a null silo is one of its own and part of Global.
    """

    def statistics(_, rows: pd.DataFrame) -> np.ndarray:
        x = np.stack(rows[features].to_numpy())
        return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])

    sums = partial_sums(df.select("client_id", features).where(F.col(features).isNotNull()), statistics)
    both = with_global_silo(sums).groupBy("client_id", "pos").agg(F.sum("value").alias("value"))
    listed = both.groupBy("client_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("v")
    )
    # The vector holds 1 + d + d² numbers.
    d = F.round((F.sqrt(4 * F.size("v") - F.lit(3.0)) - 1) / 2).cast("int")
    return control_table(listed.select(
        "client_id", F.element_at("v", 1).cast("bigint").alias("n"),
        F.transform(F.slice("v", F.lit(2), d), lambda s: s / F.element_at("v", 1)).alias("means"),
        F.slice("v", d + 2, d * d).alias("second"),
    ))


def covariance(n: float, means: np.ndarray, second: np.ndarray, ddof: int = 1) -> np.ndarray:
    """Covariance matrix from the moments of one silo."""
    d = len(means)
    return (second.reshape(d, d) - n * np.outer(means, means)) / max(n - ddof, 1)


def _principal(n: float, means: np.ndarray, second: np.ndarray, k: int, scale: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scale, components, explained variance); the largest loading of a component is positive."""
    c = covariance(n, means, second, 0)
    std = np.sqrt(np.clip(np.diag(c), 0, None)) if scale else np.ones(len(means))
    std = np.where(std > 0, std, 1.0)
    values, vectors = np.linalg.eigh(c / np.outer(std, std))
    order = np.argsort(-values)[:k]
    components = vectors[:, order].T
    signs = np.sign(components[np.arange(len(components)), np.abs(components).argmax(axis=1)])
    return std, components * signs[:, None], values[order]


def pca_fit(df: DataFrame, k: int = 10, scale: bool = True, features: str = "features") -> DataFrame:
    """(client_id, component, variance, loadings, means, scales) per silo and Global, from one pass of moments."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                means, second = np.asarray(row.means), np.asarray(row.second)
                std, components, variance = _principal(row.n, means, second, min(k, len(means)), scale)
                yield pd.DataFrame({
                    "client_id": row.client_id, "component": np.arange(len(components), dtype=np.int32),
                    "variance": variance, "loadings": list(components), "means": [means] * len(components),
                    "scales": [std] * len(components),
                })

    schema = "client_id string, component int, variance double, loadings array<double>, means array<double>, scales array<double>"
    return gramian(df, features).mapInPandas(solve, schema)


def pca_transform(
    df: DataFrame, fitted: DataFrame, basis: str | None = None, features: str = "features"
) -> DataFrame:
    """Adds ``scores``. Every silo uses its own components, or all use those of the silo ``basis`` (such as Global).

    The model has components × features numbers per silo and is joined by silo.
    """
    packed = fitted.groupBy("client_id").agg(
        F.array_sort(F.collect_list(F.struct("component", "loadings"))).alias("_parts"),
        F.first("means").alias("_means"), F.first("scales").alias("_scales"),
    )
    if basis is None:
        named = small_side(packed.withColumnRenamed("client_id", "_silo"))
        joined = df.join(named, F.col("client_id").cast("string") == F.col("_silo")).drop("_silo")
    else:
        one = packed.where(F.col("client_id") == basis).select(F.struct("_parts", "_means", "_scales").alias("m"))
        joined = df.withColumn("_m", one.scalar()).select("*", "_m.*").drop("_m")

    keep = df.columns
    centred = F.zip_with(F.zip_with(F.col(features), F.col("_means"), lambda a, b: a - b), F.col("_scales"), lambda a, s: a / s)
    scored = joined.withColumn("_z", centred).withColumn(
        "scores", F.transform("_parts", lambda p: arrays.dot(p["loadings"], F.col("_z")))
    )
    return scored.select(*keep, "scores")


def component_moments(moments: DataFrame, components: int, scale: bool = True) -> DataFrame:
    """(client_id, n, means, second) of each silo's own principal scores, from its moments alone.

    The scores of a silo's own components have mean 0 and a diagonal second moment, n times the components' variances.
    """

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                means, second = np.asarray(r.means), np.asarray(r.second)
                own = covariance(r.n, means, second, ddof=0)
                if scale:
                    spread = np.sqrt(np.diag(own))
                    spread = np.where(spread > 0, spread, 1.0)
                    own = own / np.outer(spread, spread)
                kept = np.sort(np.linalg.eigvalsh(own))[::-1][:components]
                out.append((r.client_id, r.n, [0.0] * len(kept), (r.n * np.diag(kept)).ravel().tolist()))
            yield pd.DataFrame(out, columns=["client_id", "n", "means", "second"])

    return moments.mapInPandas(project, "client_id string, n bigint, means array<double>, second array<double>")


def relevance_diversity(df: DataFrame, features: str = "features", legacy: bool = False, components: int | None = None) -> DataFrame:
    """(src, tgt, relevance, diversity) from the silos' moments: one eigendecomposition per silo, matrix times vector per pair.

    With ``components`` the silos are compared on that many standardised principal scores, each on its own. ``legacy`` walks
    the rows of the eigenvector matrix, as published results did.
    """
    moments = gramian(df, features)
    if components is not None:
        moments = component_moments(moments, components)

    def decompose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                own = covariance(r.n, np.asarray(r.means), np.asarray(r.second))
                square = own.T @ own / r.n
                values, vectors = np.linalg.eigh(square)
                out.append((r.client_id, square.ravel().tolist(), np.abs(values).tolist(), (vectors if legacy else vectors.T).ravel().tolist()))
            yield pd.DataFrame(out, columns=["client_id", "square", "values", "axes"])

    solved = control_table(moments.mapInPandas(decompose, "client_id string, square array<double>, values array<double>, axes array<double>"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            relevance, diversity = [], []
            for values, axes, square in zip(batch["values_s"], batch["axes_s"], batch["square_t"]):
                d = len(values)
                found = np.linalg.norm(np.asarray(axes).reshape(d, d) @ np.asarray(square).reshape(d, d).T, axis=1)
                low, high = np.minimum(values, found), np.maximum(values, found)
                top = np.where(high > 0, high, 1.0)
                relevance.append(float(np.prod((low / top) ** (1 / d))))
                diversity.append(float(np.prod(((high - low) / top) ** (1 / d))))
            yield batch[["src", "tgt"]].assign(relevance=relevance, diversity=diversity)

    return pair_up(solved, ["square", "values", "axes"]).mapInPandas(compare, "src string, tgt string, relevance double, diversity double")


def volume(df: DataFrame, features: str = "features") -> DataFrame:
    """(client_id, value): √(det(XᵀX) + 1e-8)."""
    return _volumes(gramian(df, features))


def _volumes(moments: DataFrame) -> DataFrame:
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = []
            for second in batch["second"]:
                d = int(round(len(second) ** 0.5))
                values.append(float(np.sqrt(np.linalg.det(np.asarray(second).reshape(d, d)) + 1e-8)))
            yield batch[["client_id"]].assign(value=values)

    return moments.mapInPandas(solve, "client_id string, value double")


# ---------------------------------------------------------------- cells


def cube_compress(df: DataFrame, omega: float = 0.1, features: str = "features") -> DataFrame:
    """(client_id, cell, n, center): mean row and row count of every grid cell of every silo and of Global.

    Cells start at the silo's own minimum in each dimension. Both aggregations combine on the map side, so a crowded cell
    is never gathered row by row.
    """
    rows = with_global_silo(df.select("client_id", features))
    width = df.select(F.size(features)).first()[0]
    at = [F.element_at(features, i + 1) for i in range(width)]
    lows = small_side(rows.groupBy("client_id").agg(F.array(*[F.min(x) for x in at]).alias("_low")))
    placed = rows.join(lows, "client_id").select(
        "client_id", F.zip_with(features, "_low", lambda x, m: F.floor((x - m) / omega)).alias("cell"), features
    )
    return placed.groupBy("client_id", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(x) for x in at]).alias("center")
    )


def robust_volume(df: DataFrame, omega: float = 0.1, features: str = "features") -> DataFrame:
    """(client_id, value): volume of the cell means × Π (1 − α^{n+1}) / (1 − α), α = 1 / (10 · cells), to 3 decimals.

    The product is a sum of logarithms over cells, taken from counts of cells of equal size; no cell meets its silo again.
    """
    cells = control_table(cube_compress(df, omega, features))

    def statistics(_, rows: pd.DataFrame) -> np.ndarray:
        x = np.stack(rows["center"].to_numpy())
        return (x.T @ x).ravel()

    sums = partial_sums(cells.select("client_id", "center"), statistics)
    second = sums.groupBy("client_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("second")
    )
    equal = control_table(cells.groupBy("client_id", "n").agg(F.count(F.lit(1)).alias("m")))
    counts = equal.groupBy("client_id").agg(F.sum("m").alias("cells"))
    alpha = 1 / (10 * F.col("cells"))
    weight = equal.join(counts, "client_id").groupBy("client_id").agg(
        F.exp(F.sum(F.col("m") * (F.log1p(-F.pow(alpha, F.col("n") + 1)) - F.log1p(-alpha)))).alias("weight")
    )
    return _volumes(second).join(weight, "client_id").select(
        "client_id", F.round(F.col("value") * F.col("weight"), 3).alias("value")
    )


# ---------------------------------------------------------------- transport


def _cell_pieces(cumulative: DataFrame, total: str, scale: str, cells: int) -> DataFrame:
    """Splits each value's mass interval at the borders of ``cells`` equal cells of the mass axis.

    Positions are whole numbers on an axis of n·m·cells, so that both sides and the borders meet exactly.
    """
    exact = "decimal(38,0)"
    size, other = F.col(total).cast(exact), F.col(scale).cast(exact)
    high = (F.col("upto").cast(exact) * other * cells).cast(exact)
    low = ((F.col("upto") - F.col("n")).cast(exact) * other * cells).cast(exact)
    spanned = cumulative.withColumn("_w", (size * other).cast(exact)).withColumn("_lo", low).withColumn("_hi", high)
    first = F.floor(F.col("_lo") / F.col("_w")).cast("int")
    last = F.ceil(F.col("_hi") / F.col("_w")).cast("int") - 1
    return spanned.withColumn("cell", F.explode(F.sequence(first, last))).withColumn(
        "_end", F.least(F.col("_hi"), ((F.col("cell") + 1).cast(exact) * F.col("_w")).cast(exact))
    ).withColumn("_start", F.greatest(F.col("_lo"), (F.col("cell").cast(exact) * F.col("_w")).cast(exact)))


def transport_pairs(df: DataFrame, pairs: DataFrame, value: str = "value", cells: int | None = None, client: str = "client_id") -> DataFrame:
    """(src, tgt, src_value, tgt_value, mass): the exact optimal coupling of two silos' samples on a line for each pair.

    Both sides of a pair have mass 1. Values are counted once per silo; the sorted mass intervals of both sides are cut at
    common cell borders, and inside a cell the two lists of interval ends are merged by a window. No pairs of values are
    formed and no cell holds more than a 1/cells share of the mass; without ``cells`` there are 16 for each shuffle partition
    of the session, 1,024 at least. Null and NaN values take no part; a silo without values couples with nothing.
    """
    if cells is None:
        cells = max(1024, 16 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    known = df.select(F.col(client).cast("string").alias("c"), value).where(
        F.col(client).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counted = control_table(cumulative_counts(known, ["c"], value))
    sizes = counted.groupBy("c").agg(F.max("upto").alias("rows"))
    wanted = control_table(pairs.select(F.col("src").cast("string").alias("src"), F.col("tgt").cast("string").alias("tgt")).join(
        sizes.toDF("src", "_n"), "src").join(sizes.toDF("tgt", "_m"), "tgt"))
    left = _cell_pieces(wanted.join(counted.withColumnRenamed("c", "src"), "src"), "_n", "_m", cells)
    right = _cell_pieces(wanted.join(counted.withColumnRenamed("c", "tgt"), "tgt"), "_m", "_n", cells)
    kind = dict(df.dtypes)[value]
    none = F.lit(None).cast(kind)
    ends = left.select("src", "tgt", "cell", "_start", "_end", "_w", F.col(value).alias("_s"), none.alias("_t")).unionByName(
        right.select("src", "tgt", "cell", "_start", "_end", "_w", none.alias("_s"), F.col(value).alias("_t"))
    )
    merged = ends.groupBy("src", "tgt", "cell", "_end", "_w").agg(F.max("_s").alias("_s"), F.max("_t").alias("_t"), F.min("_start").alias("_start"))
    order = Window.partitionBy("src", "tgt", "cell").orderBy("_end")
    after = order.rowsBetween(0, Window.unboundedFollowing)
    from_here = F.coalesce(F.lag("_end").over(order), (F.col("cell").cast("decimal(38,0)") * F.col("_w")).cast("decimal(38,0)"))
    pieces = merged.select(
        "src", "tgt", F.first("_s", ignorenulls=True).over(after).alias("src_value"),
        F.first("_t", ignorenulls=True).over(after).alias("tgt_value"),
        (F.col("_end") - from_here).cast("double").alias("piece"), "_w",
    )
    return pieces.groupBy("src", "tgt", "src_value", "tgt_value").agg(
        (F.sum("piece") / F.max(F.col("_w").cast("double") * cells)).alias("mass")
    )


def transport_1d(source: DataFrame, target: DataFrame, value: str = "value", cells: int | None = None) -> DataFrame:
    """(source value, target value, mass): ``transport_pairs`` of two samples."""
    rows = source.select(F.lit("source").alias("client_id"), value).unionByName(target.select(F.lit("target").alias("client_id"), value))
    pair = source.sparkSession.createDataFrame([("source", "target")], "src string, tgt string")
    return transport_pairs(rows, pair, value, cells).select("src_value", "tgt_value", "mass")


def transport_cost(coupling: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Σ mass · (x − y)², one row for each key."""
    gap = F.col("src_value") - F.col("tgt_value")
    return coupling.groupBy(*(keys or [])).agg(F.sum(F.col("mass") * gap * gap).alias("cost"))


def label_coupling_entropy(coupling: DataFrame, src_labels: DataFrame, tgt_labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Conditional entropy of the target label given the source label under a transport plan, one row for each key.

    ``coupling`` is (keys, src, tgt, mass); the label tables are (src, y1) and (tgt, y2).
    """
    by = keys or []
    joint = coupling.join(src_labels, "src").join(tgt_labels, "tgt").groupBy(*by, "y1", "y2").agg(F.sum("mass").alias("p"))
    given = Window.partitionBy(*by, "y1")
    return joint.where(F.col("p") > 0).withColumn("p1", F.sum("p").over(given)).groupBy(*by).agg(
        F.sum(-F.col("p") * F.ln(F.col("p") / F.col("p1"))).alias("value")
    )


def directions(d: int, count: int, seed: int = 1) -> np.ndarray:
    """Fixed unit vectors for projections."""
    v = np.random.RandomState(seed).normal(size=(count, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def wasserstein_sliced(
    df: DataFrame, vectors: np.ndarray, grid: int = 100, features: str = "features", buckets: int = 256
) -> DataFrame:
    """(src, tgt, value): mean squared gap of quantile functions over fixed directions and a quantile grid.

    Rows are projected, ranked per (silo, direction) by buckets of the projection, and only grid × directions numbers per
    silo are paired.
    """
    import pyspark.ml.feature as feature

    rows = with_global_silo(df.select("client_id", features))
    names = [f"_p{i}" for i in range(len(vectors))]
    flat = rows.select("client_id", *[
        arrays.dot(F.col(features), arrays.literal(v)).alias(n) for n, v in zip(names, vectors)
    ])
    base = df.select(*[arrays.dot(F.col(features), arrays.literal(v)).alias(n) for n, v in zip(names, vectors)])
    bounds = quantile_bounds(base, names, buckets)
    bucketed = feature.Bucketizer(
        inputCols=names, outputCols=[f"_b{n}" for n in names],
        splitsArray=[[-float("inf"), *b, float("inf")] if b else [-float("inf"), 0.0, float("inf")] for b in bounds],
    ).transform(flat)
    long = bucketed.select("client_id", F.explode(F.array(*[
        F.struct(F.lit(i).alias("dir"), F.col(n).alias("value"), F.col(f"_b{n}").alias("bucket")) for i, n in enumerate(names)
    ])).alias("p")).select("client_id", "p.*")
    ranked = cumulative_counts(long, ["client_id", "dir"], "value", "bucket")
    sizes = rows.groupBy("client_id").agg(F.count(F.lit(1)).alias("rows"))
    # Grid point q (0 … grid-1) reads the value whose rank interval holds ceil((q + 0.5) / grid · rows).
    sized = ranked.join(small_side(sizes), "client_id")
    place = lambda upto: F.floor(upto * grid / F.col("rows") - 0.5)
    first, last = place(F.col("upto") - F.col("n")) + 1, place(F.col("upto"))
    picked = sized.where(last >= first).select(
        "client_id", "dir", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("q"), "value"
    )
    packed = control_table(picked.groupBy("client_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dir", "q", "value"))), lambda s: s["value"]).alias("z")
    ))
    gap = arrays.total(F.zip_with("z_s", "z_t", lambda a, b: (a - b) * (a - b)))
    return pair_up(packed, ["z"]).select("src", "tgt", (gap / F.size("z_s")).alias("value"))


# ---------------------------------------------------------------- kernels


def gaussian_mmd_rff(
    df: DataFrame, frequencies: np.ndarray, features: str = "features"
) -> DataFrame:
    """(src, tgt, value): half the squared distance of the mean random Fourier features. One pass over the rows."""

    def statistics(_, rows: pd.DataFrame) -> np.ndarray:
        z = np.stack(rows[features].to_numpy()) @ frequencies.T
        return np.concatenate([[len(z)], np.cos(z).sum(axis=0), np.sin(z).sum(axis=0)])

    sums = with_global_silo(partial_sums(df.select("client_id", features), statistics)).groupBy("client_id", "pos").agg(
        F.sum("value").alias("value")
    )
    packed = control_table(sums.groupBy("client_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("v")
    ).select("client_id", F.transform(
        F.slice("v", 2, 2 * len(frequencies)), lambda x: x / F.element_at("v", 1)
    ).alias("z")))
    gap = arrays.total(F.zip_with("z_s", "z_t", lambda a, b: (a - b) * (a - b)))
    return pair_up(packed, ["z"]).select("src", "tgt", (gap / (2 * len(frequencies))).alias("value"))


BLOCK_ROWS = 1024
TILE_BLOCKS = 16
HELD_SUMS = 100_000


class KernelBlock:
    """Rows of a block sorted by silo: their silos, where each begins, the vectors and their squared lengths."""

    def __init__(self, silos: pa.Array, flat: pa.Array):
        coded = silos.dictionary_encode(null_encoding="encode")
        codes = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        found, self.starts = np.unique(codes[order], return_index=True)
        names = coded.dictionary.to_pylist()
        self.silos = [names[i] for i in found]
        self.own = np.searchsorted(self.starts, np.arange(len(codes)), side="right") - 1
        self.x = flat.to_numpy(zero_copy_only=False).reshape(len(codes), -1)[order]
        self.squares = (self.x * self.x).sum(axis=1)


def _kernel_table(a: KernelBlock, b: KernelBlock, rate: float, least: float) -> np.ndarray:
    """Sums of exp(rate ‖x−y‖²) by silo of a and silo of b. Where few exponents reach ``least``, only those are raised."""
    power = a.x @ (b.x.T * (-2 * rate))
    power += (rate * a.squares)[:, None]
    power += (rate * b.squares)[None, :]
    np.minimum(power, 0, out=power)
    near = power >= least
    if 8 * np.count_nonzero(near) < power.size:
        x, y = np.nonzero(near)
        at = a.own[x] * len(b.silos) + b.own[y]
        return np.bincount(at, np.exp(power[x, y]), len(a.silos) * len(b.silos)).reshape(len(a.silos), -1)
    np.exp(power, out=power)
    return np.add.reduceat(np.add.reduceat(power, a.starts, axis=0), b.starts, axis=1)


def _kernel_sums(batches: Iterator[pa.RecordBatch], rate: float, least: float) -> Iterator[pa.RecordBatch]:
    """(src, tgt, value) of the blocks that meet under a key: those of side 0 come first and are held, one tile at most.

    An unordered pair of blocks is worked out once and counts for both orders of its silos.
    """
    sums: dict[tuple[str | None, str | None], float] = {}
    key, held = None, []

    def add(a: KernelBlock, b: KernelBlock, both: bool) -> None:
        table = _kernel_table(a, b, rate, least).tolist()
        for s, row in zip(a.silos, table):
            for t, value in zip(b.silos, row):
                sums[s, t] = sums.get((s, t), 0.0) + value
                if both:
                    sums[t, s] = sums.get((t, s), 0.0) + value

    def out() -> pa.RecordBatch:
        columns = [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array(list(sums.values()), pa.float64())]
        sums.clear()
        return pa.RecordBatch.from_arrays(columns, ["src", "tgt", "value"])

    for batch in batches:
        for i, (now, side, alone) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "side", "alone")))):
            if now != key:
                key, held = now, []
            block = KernelBlock(batch.column("silos")[i].values, batch.column("flat")[i].values)
            for other in held if alone or side else ():
                add(other, block, True)
            if alone:
                add(block, block, False)
            if side == 0:
                held.append(block)
            if len(sums) > HELD_SUMS:
                yield out()
    yield out()


def gaussian_mmd(
    df: DataFrame, sigma: float = 0.05, features: str = "features", id_col: str = "row_id", axes: int = 2
) -> DataFrame:
    """(src, tgt, value): ½ (mean k(x,x′) + mean k(y,y′) − 2 mean k(x,y)), k = exp(−‖x−y‖² / 2σ²), self pairs included.

    Beyond a distance of 9σ a kernel value is under 3e-18 and adds nothing to a mean. Rows are put in a grid of that width
    along the main directions of the data, which never stretch distances, so only rows of neighbouring grid cells have to
    meet. Inside a cell rows stand in blocks of bounded size, and blocks in tiles; each unordered pair of tiles is one key,
    to which a task holds the blocks of one tile and streams those of the other. What leaves it is one sum per pair of silos.
    Rows without a vector are left out.
    """
    moments = gramian(df, features)
    pooled = moments.where(F.col("client_id") == GLOBAL).first()
    n_rows = pooled.n
    _, components, _ = _principal(
        pooled.n, np.asarray(pooled.means), np.asarray(pooled.second), min(axes, len(pooled.means)), False
    )
    reach = 9 * sigma
    spots = [F.floor(arrays.dot(F.col(features), arrays.literal(c)) / reach).cast("bigint") for c in components]
    placed = df.where(F.col(features).isNotNull()).select(
        F.col("client_id").cast("string").alias("c"), id_col, F.col(features).cast("array<double>").alias("x"), F.array(*spots).alias("cell"))
    sizes = small_side(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")))
    count = F.ceil(F.col("rows") / BLOCK_ROWS)
    # Rows that share an id are spread by their vectors.
    blocks = placed.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64(id_col, "x"), count)).withColumn(
        "tiles", F.ceil(F.col("rows") / BLOCK_ROWS / TILE_BLOCKS)
    ).groupBy("cell", "block", "tiles").agg(F.collect_list(F.struct("c", "x")).alias("rows"))
    blocks = blocks.select(
        "cell", F.pmod("block", "tiles").alias("tile"), F.col("rows.c").alias("silos"), F.flatten("rows.x").alias("flat"))
    around = [[]]
    for _ in components:
        around = [a + [s] for a in around for s in (-1, 0, 1)]
    steps = F.array(*[F.array(*[F.lit(s).cast("bigint") for s in a]) for a in around])
    # A block goes once to each tile of its own and the neighbouring cells: the lesser of two cells or tiles is side 0.
    others = sizes.select(F.col("cell").alias("other"), F.ceil(F.col("rows") / BLOCK_ROWS / TILE_BLOCKS).alias("tiles"))
    met = blocks.withColumn("step", F.explode(steps)).withColumn("other", F.zip_with("cell", "step", lambda x, s: x + s)).drop("step").join(
        others, "other").withColumn("tile_o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
    mine, theirs = F.struct("cell", "tile"), F.struct(F.col("other").alias("cell"), F.col("tile_o").alias("tile"))
    key = F.concat_ws("/", F.least(mine, theirs).cast("string"), F.greatest(mine, theirs).cast("string"))
    met = met.select(key.alias("key"), F.when(mine <= theirs, 0).otherwise(1).alias("side"), (mine == theirs).alias("alone"), "silos", "flat")
    dealt = met.repartition("key").sortWithinPartitions("key", "side")
    rate = -1 / (2 * sigma * sigma)
    sums = control_table(dealt.mapInArrow(
        lambda batches: _kernel_sums(batches, rate, rate * reach * reach), "src string, tgt string, value double"
    ).groupBy("src", "tgt").agg(F.sum("value").alias("value")))
    return _mmd_from_sums(sums, moments.select("client_id", "n"), n_rows)


def _mmd_from_sums(sums: DataFrame, counts: DataFrame, n_rows: int) -> DataFrame:
    """Kernel sums of silo pairs to distances; Global's sums are those of all silos."""
    to_global = sums.groupBy("src").agg(F.sum("value").alias("value")).withColumn("tgt", F.lit(GLOBAL))
    everything = sums.agg(F.sum("value")).scalar()
    all_pairs = sums.unionByName(to_global.select("src", "tgt", "value"))
    own = sums.where(F.col("src") == F.col("tgt")).select(F.col("src").alias("client_id"), "value").unionByName(
        counts.where(F.col("client_id") == GLOBAL).select("client_id", everything.alias("value"))
    )
    means = own.join(counts, "client_id").select("client_id", "n", (F.col("value") / F.col("n") / F.col("n")).alias("own"))
    pairs = pair_up(means, ["n", "own"])
    cross = F.coalesce(F.col("value"), F.lit(0.0)) / F.col("n_s") / F.col("n_t")
    return pairs.join(all_pairs, ["src", "tgt"], "left").select(
        "src", "tgt", (F.col("own_s") / 2 + F.col("own_t") / 2 - cross).alias("value")
    )


def quantized(df: DataFrame, points: int, features: str = "features", seed: int = 1, id_col: str = "row_id") -> DataFrame:
    """(client_id, atoms): every silo and Global as at most ``points`` weighted vectors whose weights are row counts.

    Silos of every size share one set of ``points`` k-means centres and are represented by the means of their rows around
    them, so no row is dropped, the weights are exact, and all silos are measured alike.
    """
    width = df.select(F.size(features)).first()[0]
    vectors = df.select("client_id", features, array_to_vector(features).alias("_v"))
    model = KMeans(featuresCol="_v", predictionCol="_cell", k=points, seed=seed, maxIter=10).fit(vectors)
    cells = with_global_silo(model.transform(vectors).select("client_id", "_cell", features))
    means = cells.groupBy("client_id", "_cell").agg(
        F.count(F.lit(1)).cast("double").alias("w"),
        F.array(*[F.avg(F.element_at(features, i + 1)) for i in range(width)]).alias("x"),
    )
    return control_table(means.groupBy("client_id").agg(F.collect_list(F.struct("w", "x")).alias("atoms")))


def sinkhorn_divergence(
    x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, blur: float = 0.01, scaling: float = 0.8
) -> float:
    """Debiased entropic transport cost of ½‖x−y‖² with annealing from the diameter down to the blur."""
    cost = lambda p, q: 0.5 * np.clip((p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * p @ q.T, 0, None)
    both = np.vstack([x, y])
    diameter = max(float(np.linalg.norm(both.max(axis=0) - both.min(axis=0))), blur)
    # Lengths shrink by ``scaling`` from the diameter until the blur is reached.
    count = int(np.ceil(np.log(blur / diameter) / np.log(scaling)))
    steps = [(diameter * scaling**k) ** 2 for k in range(count)] + [blur**2]
    la, lb = np.log(a), np.log(b)
    cxy, cxx, cyy = cost(x, y), cost(x, x), cost(y, y)

    def soft(eps: float, c: np.ndarray, h: np.ndarray) -> np.ndarray:
        z = h[None, :] - c / eps
        top = z.max(axis=1)
        return -eps * (top + np.log(np.exp(z - top[:, None]).sum(axis=1)))

    eps = steps[0]
    f, g = soft(eps, cxy, lb), soft(eps, cxy.T, la)
    fx, gy = soft(eps, cxx, la), soft(eps, cyy, lb)
    for eps in steps:
        nf, ng = soft(eps, cxy, lb + g / eps), soft(eps, cxy.T, la + f / eps)
        nx, ny = soft(eps, cxx, la + fx / eps), soft(eps, cyy, lb + gy / eps)
        f, g, fx, gy = (f + nf) / 2, (g + ng) / 2, (fx + nx) / 2, (gy + ny) / 2
    f, g = soft(eps, cxy, lb + g / eps), soft(eps, cxy.T, la + f / eps)
    fx, gy = soft(eps, cxx, la + fx / eps), soft(eps, cyy, lb + gy / eps)
    return float(a @ (f - fx) + b @ (g - gy))


def wasserstein_sinkhorn(
    df: DataFrame, blur: float = 0.01, scaling: float = 0.8, points: int = 256, features: str = "features", seed: int = 1
) -> DataFrame:
    """(src, tgt, value): twice the debiased Sinkhorn divergence between silos.

    Silos enter as weighted k-means cells, whatever their size: ``points`` is the resolution (see ``quantized``). One task
    solves one pair of bounded size.
    """
    pairs = pair_up(quantized(df, points, features, seed), ["atoms"])
    spread = pairs.repartition(F.col("src"), F.col("tgt"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = []
            for s, t in zip(batch["atoms_s"], batch["atoms_t"]):
                x, y = np.stack([np.asarray(r["x"]) for r in s]), np.stack([np.asarray(r["x"]) for r in t])
                a, b = np.array([r["w"] for r in s]), np.array([r["w"] for r in t])
                values.append(2 * sinkhorn_divergence(x, a / a.sum(), y, b / b.sum(), blur, scaling))
            yield batch[["src", "tgt"]].assign(value=values)

    return spread.mapInPandas(solve, "src string, tgt string, value double")


# ---------------------------------------------------------------- transfer


def domain_counts(df: DataFrame, folds: int = 8, seed: int = 13, id_col: str = "row_id") -> DataFrame:
    """(client_id, fold, bucket, label, n) of every silo and Global: all that the shift measure needs from the rows."""
    counted = df.groupBy(
        F.col("client_id").cast("string").alias("client_id"), fold(seed, folds, id_col).alias("fold"), "bucket", "label"
    ).agg(F.count(F.lit(1)).alias("n"))
    return control_table(with_global_silo(counted).groupBy("client_id", "fold", "bucket", "label").agg(F.sum("n").alias("n")))


def y_shift(counts: DataFrame, models: DataFrame) -> DataFrame:
    """(src, tgt, degradation, shift): how much of the source model's accuracy loss on the target comes from Y|X.

    ``counts`` comes from ``domain_counts``; ``models`` is (src, bucket, predicted). The domain classifier is counted per
    bucket on the other folds (cross fitting), for all pairs and folds at once: π = (target + 1) / (both + 2).
    Shared-density weights follow from π; shift is null when the accuracies tie.
    """
    per_fold = counts.groupBy("client_id", "fold", "bucket").agg(F.sum("n").alias("n"))
    per_bucket = counts.groupBy("client_id", "bucket").agg(F.sum("n").alias("n"))
    folds, buckets = distinct_list(counts, "fold").scalar(), distinct_list(counts, "bucket").scalar()
    silos = counts.select("client_id").distinct()
    grid = silos.withColumn("fold", F.explode(folds)).withColumn("bucket", F.explode(buckets))
    # Rows of a silo in a bucket outside a fold.
    outside = control_table(grid.join(per_fold.withColumnRenamed("n", "inside"), ["client_id", "fold", "bucket"], "left").join(
        per_bucket, ["client_id", "bucket"], "left"
    ).select("client_id", "fold", "bucket", (F.coalesce("n", F.lit(0)) - F.coalesce("inside", F.lit(0))).alias("m")))
    sizes = counts.groupBy("client_id").agg(F.sum("n").alias("rows"))
    pairs = pair_up(sizes, ["rows"])
    source = outside.select(F.col("client_id").alias("src"), "fold", "bucket", F.col("m").alias("m_s"))
    target = outside.select(F.col("client_id").alias("tgt"), "fold", "bucket", F.col("m").alias("m_t"))
    pi = (F.col("m_t") + 1) / (F.col("m_s") + F.col("m_t") + 2)
    alpha = F.col("rows_t") / (F.col("rows_s") + F.col("rows_t"))
    classified = pairs.join(source, "src").join(target, ["tgt", "fold", "bucket"]).select(
        "src", "tgt", "fold", "bucket",
        (pi / ((1 - alpha) * pi + alpha * (1 - pi))).alias("w_s"),
        ((1 - pi) / ((1 - alpha) * pi + alpha * (1 - pi))).alias("w_t"),
    )
    hits = counts.join(models, "bucket").groupBy("client_id", "src", "fold", "bucket").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit")
    )
    own = hits.where(F.col("client_id") == F.col("src")).select("src", "fold", "bucket", F.col("n").alias("n_s"), F.col("hit").alias("hit_s"))
    other = hits.select(F.col("client_id").alias("tgt"), "src", "fold", "bucket", F.col("n").alias("n_t"), F.col("hit").alias("hit_t"))
    joined = classified.join(own, ["src", "fold", "bucket"], "left").join(other, ["tgt", "src", "fold", "bucket"], "left").na.fill(
        0, ["n_s", "hit_s", "n_t", "hit_t"]
    )
    return shared_density_ratio(joined)


def shared_density_ratio(scored: DataFrame) -> DataFrame:
    """(src, tgt, degradation, shift) from (src, tgt, w_s, n_s, hit_s, w_t, n_t, hit_t) cells or rows."""
    sums = scored.groupBy("src", "tgt").agg(
        (F.sum("hit_s") / F.sum("n_s")).alias("p2p"), (F.sum("hit_t") / F.sum("n_t")).alias("q2q"),
        (F.sum(F.col("w_s") * F.col("hit_s")) / F.sum(F.col("w_s") * F.col("n_s"))).alias("p2s"),
        (F.sum(F.col("w_t") * F.col("hit_t")) / F.sum(F.col("w_t") * F.col("n_t"))).alias("s2q"),
    )
    loss = F.col("p2p") - F.col("q2q")
    return sums.select("src", "tgt", loss.alias("degradation"), F.try_divide(F.col("p2s") - F.col("s2q"), loss).alias("shift"))


def performance_degradation(losses: DataFrame) -> DataFrame:
    """(src, tgt, value): loss of the source's model on the target's test rows minus that of the target's own model.

    ``losses`` is (model, client_id, value): every model on every test set, Global included.
    """
    own = losses.where(F.col("model") == F.col("client_id")).select(F.col("client_id").alias("tgt"), F.col("value").alias("_own"))
    return losses.where(F.col("model") != GLOBAL).select(
        F.col("model").alias("src"), F.col("client_id").alias("tgt"), "value"
    ).join(own, "tgt").select("src", "tgt", (F.col("value") - F.col("_own")).alias("value"))


def distance_matrix(measures: dict[str, DataFrame]) -> DataFrame:
    """(measure, src, tgt, value): several measures as one long table."""
    parts = [df.select(F.lit(name).alias("measure"), "src", "tgt", "value") for name, df in measures.items()]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table
