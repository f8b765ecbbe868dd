"""Splitting one table over silos: label skew by quotas, feature skew by slices, bands and clusters.

Quotas are tiny control tables (silo × class × split). Rows take part by their exact random rank inside a class, and a
silo owns a range of ranks; no row is drawn twice and nothing row-sized is sorted in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from silovalue.functions.hashing import row_hash
from silovalue.functions.lineage import small_side
from silovalue.functions.ranking import hash_rank
from silovalue.operators.count_model import distinct_list
from silovalue.operators.fit import partial_sums
from silovalue.sources.tables import sink_partition

MAX_CENTRE_NUMBERS = 20_000_000
QUOTA_SCHEMA = "client_id bigint, label string, split string, n bigint"


def label_counts(df: DataFrame) -> DataFrame:
    """(split, label, n): rows per class."""
    return df.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


def partition_profile(df: DataFrame, client: str = "client_id") -> DataFrame:
    """(client, split, label, n) with 0 for an absent class. The grid is built from the counts, not from the rows."""
    counts = df.groupBy(client, "split", "label").agg(F.count(F.lit(1)).alias("n"))
    splits, labels = distinct_list(counts, "split").scalar(), distinct_list(counts, "label").scalar()
    grid = counts.select(client).distinct().withColumn("split", F.explode(splits)).withColumn("label", F.explode(labels))
    return grid.join(counts, [client, "split", "label"], "left").select(
        client, "split", "label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


# ---------------------------------------------------------------- quotas


def dirichlet_quota(
    counts: DataFrame, percentages: list[float], alpha: float, seed: int
) -> DataFrame:
    """Quota table of a Dirichlet label split; ``counts`` is (split, label, n).

    Each silo aims at its percentage of all rows. It draws a class mix from Dirichlet(alpha · class share) and takes
    floor(mix · missing) of each class, capped by what is left, until its total is reached or nothing remains. When a
    pass gives nothing the mix is redrawn and one row of each likely class is taken. The test side uses the mix that the
    pass began with and stops with the training side. Only class counts reach the driver.
    """
    spark = counts.sparkSession
    rows = counts.collect()
    labels = sorted({r.label for r in rows})
    left = {
        split: np.array([sum(r.n for r in rows if r.label == l and r.split == split) for l in labels], dtype=np.int64)
        for split in ("train", "test")
    }
    share = {s: left[s] / max(left[s].sum(), 1) for s in left}
    target = {s: np.floor(np.asarray(percentages) / 100 * left[s].sum()) for s in left}
    random = np.random.RandomState(seed)

    def draw(split: str) -> np.ndarray:
        return random.dirichlet(np.maximum(share[split] * alpha, 1e-12))

    def take(split: str, mix: np.ndarray, given: np.ndarray, client: int) -> tuple[np.ndarray, np.ndarray]:
        missing = max(target[split][client] - given.sum(), 0)
        part = np.minimum((mix * missing).astype(np.int64), left[split])
        if not part.any():
            mix = draw(split)
            part = np.minimum((mix > 0).astype(np.int64), left[split])
        left[split] -= part
        return given + part, mix

    quota = []
    for client in range(len(percentages)):
        given = {s: np.zeros(len(labels), dtype=np.int64) for s in left}
        mix = draw("train")
        while left["train"].any() and given["train"].sum() < target["train"][client]:
            before = mix
            given["train"], mix = take("train", before, given["train"], client)
            given["test"], redrawn = take("test", before, given["test"], client)
            mix = mix if redrawn is before else redrawn
        quota += [(client, l, s, int(given[s][i])) for s in ("train", "test") for i, l in enumerate(labels)]
    return spark.createDataFrame(quota, QUOTA_SCHEMA)


def _class_grid(counts: DataFrame, n_clients: int) -> DataFrame:
    """counts × clients with 0-based class position ``pos`` and number of classes ``classes``."""
    labels = distinct_list(counts, "label").scalar()
    placed = counts.withColumn("pos", F.array_position(labels, F.col("label")) - 1).withColumn("classes", F.size(labels))
    return placed.withColumn("client_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_clients - 1))))


def _share(n: Column, parts: int) -> Column:
    return F.floor(n / parts).cast("bigint")


def _quota(grid: DataFrame, n: Column) -> DataFrame:
    return grid.select("client_id", "label", "split", n.cast("bigint").alias("n"))


def quota_balanced(
    counts: DataFrame, n_clients: int, test_parts: int | None = None, test_skip_last: int = 0
) -> DataFrame:
    """int(n / k) of each class; the test side may use another divisor and leave the last classes out."""
    grid = _class_grid(counts, n_clients)
    test = F.when(
        F.col("pos") < F.col("classes") - test_skip_last, _share(F.col("n"), test_parts or n_clients)
    ).otherwise(F.lit(0))
    return _quota(grid, F.when(F.col("split") == "test", test).otherwise(_share(F.col("n"), n_clients)))


def quota_maverick_full(counts: DataFrame, n_clients: int, maverick_class: int = -1, maverick: int = -1) -> DataFrame:
    """Every class but one is split evenly; the maverick's class goes wholly to the maverick."""
    grid = _class_grid(counts, n_clients)
    owner = maverick % n_clients
    special = F.col("pos") == F.pmod(F.lit(maverick_class), F.col("classes"))
    return _quota(grid, F.when(
        special, F.when(F.col("client_id") == owner, F.col("n")).otherwise(0)
    ).otherwise(_share(F.col("n"), n_clients)))


def quota_maverick_missing(counts: DataFrame, n_clients: int, missing: int) -> DataFrame:
    """The last class wholly at the last silo; silo 0 has none of the ``missing`` classes before it."""
    grid = _class_grid(counts, n_clients)
    last = F.col("pos") == F.col("classes") - 1
    lacking = (F.col("pos") >= F.col("classes") - 1 - missing) & ~last
    return _quota(grid, F.when(last, F.when(F.col("client_id") == n_clients - 1, F.col("n")).otherwise(0))
                  .when(lacking, F.when(F.col("client_id") == 0, 0).otherwise(_share(F.col("n"), n_clients - 1)))
                  .otherwise(_share(F.col("n"), n_clients)))


def quota_maverick_less_labels(counts: DataFrame, n_clients: int) -> DataFrame:
    return quota_maverick_missing(counts, n_clients, 1)


def quota_maverick_missing_two(counts: DataFrame, n_clients: int) -> DataFrame:
    return quota_maverick_missing(counts, n_clients, 2)


def quota_maverick_balanced(
    counts: DataFrame, n_clients: int, maverick_class: int = 0, maverick: int = 0, parts: int | None = None
) -> DataFrame:
    """The maverick has int(n / parts) of its class, and each of its classes is cut by
    trunc(rows of a plain silo / (parts · classes)), so that silo sizes match."""
    parts = parts or n_clients
    grid = _class_grid(counts, n_clients)
    special = F.col("pos") == F.pmod(F.lit(maverick_class), F.col("classes"))
    own = F.col("client_id") == maverick % n_clients
    even = _share(F.col("n"), parts)
    plain_total = F.sum(F.when(special, 0).otherwise(even)).over(Window.partitionBy("split", "client_id"))
    cut = F.floor(plain_total / (parts * F.col("classes")))
    return _quota(grid, F.when(own, even - cut).when(special, F.lit(0)).otherwise(even))


def quota_hellinger_trap(
    counts: DataFrame, n_clients: int, seed: int, parts: int | None = None, concentration: float = 1000.0
) -> DataFrame:
    """The balanced maverick (last class, last silo) with its other classes redrawn from a flat Dirichlet."""
    base = quota_maverick_balanced(counts, n_clients, -1, -1, parts or n_clients + 1)
    rows = base.collect()
    labels = sorted({r.label for r in rows})
    mix = np.random.RandomState(seed).dirichlet(np.ones(len(labels) - 1) * concentration)
    totals = {
        s: sum(r.n for r in rows if r.client_id == n_clients - 1 and r.split == s and r.label != labels[-1])
        for s in {r.split for r in rows}
    }
    quota = [
        (r.client_id, r.label, r.split, int(mix[labels.index(r.label)] * totals[r.split]))
        if r.client_id == n_clients - 1 and r.label != labels[-1] else tuple(r)
        for r in rows
    ]
    return counts.sparkSession.createDataFrame(quota, QUOTA_SCHEMA)


def quota_disjoint_labels(counts: DataFrame, n_clients: int) -> DataFrame:
    """Each silo owns a run of neighbouring classes fully."""
    grid = _class_grid(counts, n_clients)
    owner = F.floor(F.col("pos") * n_clients / F.col("classes"))
    return _quota(grid, F.when(F.col("client_id") == owner, F.col("n")).otherwise(0))


# ---------------------------------------------------------------- drawing rows


def sample_by_quota(df: DataFrame, quota: DataFrame, seed: int, id_col: str = "row_id") -> DataFrame:
    """Rows with the silo that drew them; rows outside every quota are left out.

    Silos draw in id order without replacement, so silo k owns the rank range [Σ before, Σ before + n) of a class. The
    ranges of one class stand as an array in one row, and the rows find theirs by an equi-join on (split, class).
    """
    order = Window.partitionBy("split", "label").orderBy("client_id")
    ranges = quota.where(F.col("n") > 0).withColumn("upto", F.sum("n").over(order))
    lists = ranges.groupBy("split", "label").agg(
        F.array_sort(F.collect_list(F.struct("upto", "client_id"))).alias("_ranges")
    )
    ranked = hash_rank(df, ["split", "label"], id_col, seed, name="_rank")
    found = F.filter(F.col("_ranges"), lambda r: F.col("_rank") < r["upto"])
    return ranked.join(small_side(lists), ["split", "label"]).where(
        F.col("_rank") < F.element_at("_ranges", -1)["upto"]
    ).withColumn("client_id", F.element_at(found, 1)["client_id"]).drop("_rank", "_ranges")


def partition_dirichlet(
    df: DataFrame, percentages: list[float], alpha: float, seed: int, path: str | None = None
) -> DataFrame:
    """Counts, quotas and drawing in one go; with a path the scheme is stored, and an existing one is kept."""
    quota = dirichlet_quota(label_counts(df), percentages, alpha, seed)
    drawn = sample_by_quota(df, quota, seed)
    if path is None:
        return drawn
    sink_partition(drawn, path, mode="ignore")
    return df.sparkSession.read.parquet(path)


def rows_with_label(df: DataFrame, ids: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Rows whose id is among the ids of the chosen labels."""
    return df.join(ids.select(id_col), id_col, "left_semi")


def remaining_rows(df: DataFrame, assigned: DataFrame, id_col: str = "row_id") -> DataFrame:
    return df.join(assigned.select(id_col), id_col, "left_anti")


def partition_random(df: DataFrame, n_clients: int, seed: int, id_col: str = "row_id") -> DataFrame:
    """n random shares of int(N / n) rows in each split; the remainder is not assigned."""
    group = ["split"] if "split" in df.columns else []
    ranked = hash_rank(df, group, id_col, seed, name="_rank")
    sizes = df.groupBy(*group).agg(F.floor(F.count(F.lit(1)) / n_clients).alias("_each"))
    sized = ranked.join(small_side(sizes), group) if group else ranked.withColumn("_each", sizes.scalar())
    return sized.where(F.col("_rank") < F.col("_each") * n_clients).withColumn(
        "client_id", F.floor(F.col("_rank") / F.col("_each")).cast("bigint")
    ).drop("_rank", "_each")


def _part(rank: Column, size: Column, parts: int) -> Column:
    """Part of a row when ``size`` rows are cut into nearly equal parts: the first size mod parts are one larger."""
    small, extra = F.floor(size / parts), size % parts
    head = extra * (small + 1)
    return F.when(rank < head, F.floor(rank / (small + 1))).otherwise(
        extra + F.floor((rank - head) / F.greatest(small, F.lit(1)))
    )


def partition_feature_slices(
    df: DataFrame, slices: list[Column], parts: int = 1, seed: int = 1, id_col: str = "row_id"
) -> DataFrame:
    """Silos by slice predicates, each slice shuffled over ``parts`` silos; rows in no slice are left out.

    Slices may overlap: a row belongs to every slice whose predicate holds.
    """
    hits = F.filter(F.array(*[F.when(p, F.lit(i)) for i, p in enumerate(slices)]), lambda x: x.isNotNull())
    sliced = df.withColumn("_slice", F.explode(hits))
    if parts == 1:
        return sliced.withColumn("client_id", F.col("_slice").cast("bigint")).drop("_slice")
    group = ["_slice", "split"] if "split" in df.columns else ["_slice"]
    sizes = sliced.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    ranked = hash_rank(sliced, group, id_col, seed, name="_rank").join(small_side(sizes), group)
    part = _part(F.col("_rank"), F.col("_size"), parts)
    return ranked.withColumn("client_id", (F.col("_slice") * parts + part).cast("bigint")).drop("_slice", "_rank", "_size")


def category_slices(column: str, groups: list[list[str]]) -> list[Column]:
    """One predicate per group of category values."""
    return [F.col(column).isin(*g) for g in groups]


def partition_by_category(
    df: DataFrame, column: str, groups: list[list[str]], parts: int = 1, seed: int = 1
) -> DataFrame:
    """Feature skew by the values of one category column: region, facility type, building class."""
    return partition_feature_slices(df, category_slices(column, groups), parts, seed)


def partition_target_range(df: DataFrame, cuts: list[float], y: str = "y") -> DataFrame:
    """Silos by open bands of a numeric target; a row equal to a cut belongs to none."""
    edges = [None, *cuts, None]
    owner = F.lit(None).cast("bigint")
    for i in range(len(edges) - 2, -1, -1):
        low, high = edges[i], edges[i + 1]
        inside = F.lit(True)
        if low is not None:
            inside = inside & (F.col(y) > low)
        if high is not None:
            inside = inside & (F.col(y) < high)
        owner = F.when(inside, F.lit(i).cast("bigint")).otherwise(owner)
    return df.withColumn("client_id", owner).where(F.col("client_id").isNotNull())


def partition_maverick_category(
    df: DataFrame, column: str, value: str, n_clients: int, seed: int = 1, id_col: str = "row_id"
) -> DataFrame:
    """Rows without the category are shuffled over all silos; every row with it goes to the last silo."""
    is_special = F.coalesce(F.col(column) == value, F.lit(False))
    spread = partition_feature_slices(df.where(~is_special), [F.lit(True)], n_clients, seed, id_col)
    special = df.where(is_special).withColumn("client_id", F.lit(n_clients - 1).cast("bigint"))
    return spread.unionByName(special.select(*spread.columns))


Centres = dict[object, np.ndarray]  # class -> clusters × features


def first_centres(
    df: DataFrame, k: int, seed: int = 1, features: str = "features", label: str = "label", id_col: str = "row_id", candidates: int = 16
) -> Centres:
    """For each class k of its ``candidates`` × k rows of smallest hash: the first, then always the one farthest from those taken.

    With ``candidates`` 1 they are the k rows of smallest hash. A class with fewer rows has fewer centres.
    """
    hashed = df.where(F.col(features).isNotNull()).select(label, F.col(features).cast("array<double>").alias("v"), row_hash(seed, id_col).alias("_h"), id_col)
    drawn = hashed.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy("_h", id_col))).where(F.col("_n") <= candidates * k)

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_n")
        x = np.stack(frame["v"].to_numpy())
        taken = [0] if candidates > 1 else list(range(min(k, len(x))))
        gap = ((x - x[0]) ** 2).sum(axis=1)
        while len(taken) < min(k, len(x)):
            taken.append(int(np.argmax(gap)))
            gap = np.minimum(gap, ((x - x[taken[-1]]) ** 2).sum(axis=1))
        return pd.DataFrame({label: [frame[label].iloc[0]] * len(taken), "centre": x[taken].tolist()})

    kind = dict(df.dtypes)[label]
    found = drawn.select(label, "v", "_n").groupBy(label).applyInPandas(choose, f"{label} {kind}, centre array<double>").collect()
    if sum(len(r.centre) for r in found) > MAX_CENTRE_NUMBERS:
        raise ValueError("centres of all classes are too large to be shipped to every task")
    return {c: np.array([r.centre for r in found if r[label] == c]) for c in {r[label] for r in found}}


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)).argmin(axis=1)


def moved_centres(df: DataFrame, centres: Centres, features: str = "features", label: str = "label") -> Centres:
    """One Lloyd step of all classes in one job: tasks add up their rows by class and nearest centre, only sums are shuffled.

    A centre that no row is nearest to stays where it is.
    """
    shipped = df.sparkSession.sparkContext.broadcast(centres)

    def statistics(key, rows: pd.DataFrame) -> np.ndarray:
        x, own = np.stack(rows["v"].to_numpy()), shipped.value[key]
        near = _nearest(x, own)
        sums = np.zeros((len(own), x.shape[1] + 1))
        np.add.at(sums, near, np.hstack([x, np.ones((len(x), 1))]))
        return sums.ravel()

    rows = df.where(F.col(features).isNotNull()).select(label, F.col(features).cast("array<double>").alias("v"))
    moved = dict(centres)
    for r in partial_sums(rows, statistics, label).groupBy(label).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("v")
    ).collect():
        sums = np.array(r.v).reshape(len(centres[r[label]]), -1)
        used = sums[:, -1:] > 0
        moved[r[label]] = np.where(used, sums[:, :-1] / np.maximum(sums[:, -1:], 1), centres[r[label]])
    return moved


def assign_clusters(df: DataFrame, centres: Centres, features: str = "features", label: str = "label") -> DataFrame:
    """Adds ``client_id``, the number of the nearest centre of the row's class, in one pass; rows without a vector get none."""
    shipped = df.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("bigint")
    def nearest(labels: pd.Series, vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(labels), dtype="Int64")
        whole = vectors.notna()
        for key, rows in vectors[whole].groupby(labels[whole], sort=False, dropna=False):
            own = shipped.value[None if pd.isna(key) else key]
            out.loc[rows.index] = _nearest(np.stack(rows.to_numpy()), own)
        return out

    return df.withColumn("client_id", nearest(F.col(label), F.col(features).cast("array<double>")))


def partition_feature_clusters(
    df: DataFrame, k: int, seed: int = 1, features: str = "features", label: str = "label", max_iter: int = 20, id_col: str = "row_id",
    tolerance: float = 1e-9,
) -> DataFrame:
    """k-means inside every class; the cluster number is the silo.

    All classes move together, one job a step, until no centre moves further than ``tolerance`` or after ``max_iter`` steps.
    The centres (classes × k vectors) are the only data on the driver; all rows are assigned in one pass.
    """
    centres = first_centres(df, k, seed, features, label, id_col)
    for _ in range(max_iter):
        moved = moved_centres(df, centres, features, label)
        still = all(np.abs(moved[c] - centres[c]).max(initial=0) <= tolerance for c in centres)
        centres = moved
        if still:
            break
    return assign_clusters(df, centres, features, label)


def shuffle_key(seed: int, id_col: str = "row_id") -> Column:
    """Random but repeatable sort key of a row."""
    return row_hash(seed, id_col)
