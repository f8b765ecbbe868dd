"""Correlating values with measures: coefficients, p-values, summaries. Tables here have one row per silo or result."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from silovalue.functions.lineage import control_table
from silovalue.operators.metrics import GLOBAL

MOST_EXACT = 10  # values of which all permutations are tried
MOST_VALUES = 100_000  # values of one key, which meet in one task
PERMUTED_AT_ONCE = 2_000_000
MOST_FRACTION_STEPS = 1_000_000


def pearson(df: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(keys, r, n); r is null when a side is constant."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = F.corr(x, y)
    return both.groupBy(*keys).agg(F.when(~F.isnan(r), r).alias("r"), F.count(F.lit(1)).alias("n"))


def _log_gamma_step(a: np.ndarray) -> np.ndarray:
    """ln Γ(a + 1/2) − ln Γ(a); by its asymptotic series where the two are large and their difference would lose digits."""
    small = np.array([math.lgamma(v + 0.5) - math.lgamma(v) if v < 50 else 0.0 for v in a])
    big = np.maximum(a, 50.0)
    series = 0.5 * np.log(big) - 1 / (8 * big) + 1 / (192 * big**3) - 1 / (640 * big**5)
    return np.where(a < 50, small, series)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, evaluated from the front until no value moves any more."""
    tiny = 1e-300
    away = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / away(1 - (a + b) * x / (a + 1))
    value = d.copy()
    for m in range(1, MOST_FRACTION_STEPS):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / away(1 + term * d), away(1 + term / c)
            value = value * c * d
        if (np.abs(c * d - 1) < 1e-15).all():
            break
    return value


def t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tail of Student's t: the regularised incomplete beta function I(df/2, 1/2) at df / (df + t²).

    The number of steps grows at most with the root of df; the relative error is about df times 1e-16.
    """
    t, a = np.abs(np.asarray(t, dtype=float)), np.asarray(df, dtype=float) / 2
    out = np.full(len(t), np.nan)
    fine = np.isfinite(t) & (a > 0)
    t, a = t[fine], a[fine]
    rest = t * t / (2 * a + t * t)  # 1 − x, without its rounding
    half = np.full_like(a, 0.5)
    with np.errstate(divide="ignore"):
        front = np.exp(_log_gamma_step(a) - 0.5 * math.log(math.pi) - a * np.log1p(t * t / (2 * a)) + 0.5 * np.log(rest))
    direct = rest > 1.5 / (a + 2.5)
    x = np.where(direct, 1 - rest, rest)
    first, second = np.where(direct, a, half), np.where(direct, half, a)
    part = front * _beta_fraction(first, second, x) / first
    out[fine] = np.clip(np.where(direct, part, 1 - part), 0.0, 1.0)
    return out


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided tail of Student's t of a table with one row per result."""

    @F.pandas_udf("double")
    def tail(values: pd.Series, freedom: pd.Series) -> pd.Series:
        found = t_tail(values.to_numpy(float, na_value=np.nan), freedom.to_numpy(float, na_value=np.nan))
        return pd.Series(found).where(~np.isnan(found), None)

    return tail(t.cast("double"), df.cast("double"))


def pearson_p_value(correlations: DataFrame) -> DataFrame:
    """Adds ``p`` to (…, r, n): t test with n − 2 degrees of freedom."""
    df = F.col("n") - 2
    t = F.col("r") * F.sqrt(F.try_divide(df.cast("double"), 1 - F.col("r") * F.col("r")))  # may be worked out where exact, too
    exact = F.abs("r") >= 1 - 1e-15
    p = F.when(F.col("r").isNull() | (df < 1), F.lit(None).cast("double")).when(exact, F.lit(0.0)).otherwise(t_two_sided(t, df))
    return correlations.withColumn("p", p)


def average_ranks(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Replaces columns by their ranks inside a key; equal values share the mean rank."""
    ranked = {}
    for c in columns:
        order = Window.partitionBy(*keys).orderBy(c)
        same = Window.partitionBy(*keys, c)
        ranked[c] = F.rank().over(order) + (F.count(F.lit(1)).over(same) - 1) / 2
    return df.withColumns(ranked)


def spearman(df: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(keys, r, n): Pearson coefficient of average ranks."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return pearson(average_ranks(both, keys, [x, y]), keys, x, y)


def permutation_p(
    x: np.ndarray, y: np.ndarray, method: str | None = None, resamples: int = 9_999, seed: int = 1
) -> tuple[float | None, float | None]:
    """Coefficient and two-sided permutation p of two rank vectors, over all permutations or over ``resamples`` drawn ones.

    Without a method, all permutations are tried where they are no more than ``resamples``, and else drawn for up to
    ``MOST_EXACT`` values; for more values the caller has to choose.
    """
    if method is None:
        method = "exact" if len(x) > MOST_EXACT or math.factorial(len(x)) <= resamples else "sampled"
    x, y = x - x.mean(), y - y.mean()
    scale = np.sqrt((x * x).sum() * (y * y).sum())
    if scale == 0:
        return None, None
    r = float(x @ y / scale)
    if method == "exact":
        if len(x) > MOST_EXACT:
            raise ValueError(f"all permutations of more than {MOST_EXACT} values are too many; choose method='sampled'")
        tried, extra = itertools.permutations(range(len(x))), 0
    else:
        random, extra = np.random.RandomState(seed), 1
        tried = (random.permutation(len(x)) for _ in range(resamples))
    count = upper = lower = extra
    while block := list(itertools.islice(tried, max(1, PERMUTED_AT_ONCE // len(x)))):
        null = (x[np.array(block)] @ y) / scale
        count, upper, lower = count + len(block), upper + int((null >= r - 1e-12).sum()), lower + int((null <= r + 1e-12).sum())
    return r, float(min(1.0, 2 * min(upper, lower) / count))


def spearman_permutation_p(
    df: DataFrame, keys: list[str], x: str = "x", y: str = "y", seed: int = 1, method: str = "exact", resamples: int = 9_999
) -> DataFrame:
    """(keys, r, p) of each key's silos; the permutations of one key are tried inside one task.

    The caller chooses ``method``: "exact" tries all permutations (up to 10 silos a key), "sampled" draws ``resamples``. A key
    with more than ``MOST_VALUES`` silos is refused, so that what one task gathers is bounded.
    """
    if method not in ("exact", "sampled"):
        raise ValueError("method is exact or sampled")
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    sizes = Window.partitionBy(*keys)
    counted = average_ranks(both, keys, [x, y]).withColumn("_n", F.count(F.lit(1)).over(sizes))
    checked = counted.where(F.when(F.col("_n") <= MOST_VALUES, True).otherwise(F.raise_error(F.lit(f"more than {MOST_VALUES} values of a key")).cast("boolean")))
    packed = checked.groupBy(*keys).agg(F.collect_list(F.struct(x, y)).alias("pairs"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in packed.select(*keys).dtypes)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                permutation_p(np.array([q[x] for q in pairs]), np.array([q[y] for q in pairs]), method, resamples, seed)
                for pairs in batch["pairs"]
            ]
            yield batch[keys].assign(r=[f[0] for f in found], p=[f[1] for f in found])

    return packed.mapInPandas(solve, f"{kinds}, r double, p double")


def fisher_mean(correlations: DataFrame, keys: list[str], r: str = "r", p: str = "p") -> DataFrame:
    """(keys, r, p): tanh of the mean atanh, and the mean p. A coefficient of ±1 is kept just inside the open interval."""
    inside = F.greatest(F.least(F.col(r), F.lit(1 - 1e-15)), F.lit(-1 + 1e-15))
    return correlations.groupBy(*keys).agg(F.tanh(F.avg(F.atanh(inside))).alias("r"), F.avg(p).alias("p"))


def clean_nonfinite(df: DataFrame, column: str = "value") -> DataFrame:
    """±infinity, NaN and missing become 0."""
    c = F.col(column)
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumn(column, F.when(bad, F.lit(0.0)).otherwise(c))


def sv_agreement(sv: DataFrame, keys: list[str], seed: int = 1) -> DataFrame:
    """(keys, spearman, spearman_p, pearson, pearson_p): Centralized against Aggregated values over the silos.

    ``sv`` is (keys, evaluator, client_id, value) with the two evaluators.
    """
    wide = sv.groupBy(*keys, "client_id").agg(
        F.max(F.when(F.col("evaluator") == "Centralized", F.col("value"))).alias("x"),
        F.max(F.when(F.col("evaluator") == "Aggregated", F.col("value"))).alias("y"),
    )
    ranks = spearman_permutation_p(wide, keys, seed=seed).withColumnsRenamed({"r": "spearman", "p": "spearman_p"})
    straight = pearson_p_value(pearson(wide, keys)).select(*keys, F.col("r").alias("pearson"), F.col("p").alias("pearson_p"))
    return ranks.join(straight, keys)


def sv_distance_join(sv: DataFrame, distance: DataFrame) -> DataFrame:
    """(evaluator, client_id, metric, measure, x, y): value of a silo against its distance to the evaluator.

    Global as evaluator meets the distances to Global.
    """
    d = distance.select(
        F.col("tgt").alias("evaluator"), F.col("src").alias("client_id"), "measure", F.col("value").alias("y")
    )
    s = sv.select("evaluator", F.col("client_id").cast("string").alias("client_id"), "metric", F.col("value").alias("x"))
    return s.join(d, ["evaluator", "client_id"])


def sv_distance_correlation(
    sv: DataFrame, distance: DataFrame, method: str = "pearson", keys: tuple[str, ...] = ("metric", "measure")
) -> DataFrame:
    """(keys, side, r, p): Centralized values against the distances to Global, and the Fisher mean over evaluators."""
    joined = sv_distance_join(sv, distance)
    by = [*keys, "evaluator"]
    found = (
        pearson_p_value(pearson(joined, by)).select(*by, "r", "p") if method == "pearson" else spearman_permutation_p(joined, by)
    )
    found = control_table(found)
    central = found.where(F.col("evaluator") == GLOBAL).select(*keys, F.lit("Centralized").alias("side"), "r", "p")
    others = fisher_mean(found.where(F.col("evaluator") != GLOBAL), list(keys)).select(
        *keys, F.lit("Decentralized").alias("side"), "r", "p"
    )
    return central.unionByName(others)


def join_correlations(spearmans: DataFrame, pearsons: DataFrame, keys: list[str]) -> DataFrame:
    """Pearson columns next to the Spearman rows, matched by key."""
    return spearmans.select(*keys, F.col("r").alias("spearman"), F.col("p").alias("spearman_p")).join(
        pearsons.select(*keys, F.col("r").alias("pearson"), F.col("p").alias("pearson_p")), keys
    )


def correlation_summary(correlations: DataFrame, keys: list[str], only: Column | None = None) -> DataFrame:
    """(keys, n, min, q1, median, q3, max) of the coefficients: the numbers of a box plot."""
    rows = correlations if only is None else correlations.where(only)
    q = F.percentile("r", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.where(F.col("r").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("r").alias("min"), q.alias("q"), F.max("r").alias("max")
    ).select(*keys, "n", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")


def correlation_group_means(correlations: DataFrame, keys: list[str]) -> DataFrame:
    return correlations.groupBy(*keys).agg(F.avg("r").alias("r"))
