"""All measures of silo pairs in one long table, and their correlation with values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from silovalue.functions.lineage import control_table
from silovalue.operators import distance as X, domain_shift as Y, linear_value as L, stats as C
from silovalue.operators.fit import Models, class_outcomes
from silovalue.operators.metrics import GLOBAL

COMPONENTS = 10
# Names of the measures in reports; those that need classes are left out for a regression target.
NAMES = (
    "wasserstein", "gaussianMMD", "performanceDegradation", "yShift", "negativeConditionalEntropy", "relevance", "diversity", "hellinger", "volume")
CLASS_ONLY = ("yShift", "negativeConditionalEntropy", "hellinger")


@dataclass
class Silos:
    """What the measures are taken of: rows (row_id, client_id, features, split) with label and target, or with y.

    ``models`` are class models per silo, and one for Global, as fitted weights; regression fits its own.
    """

    rows: DataFrame
    models: Models | None = None
    omega: float = 0.1

    def part(self, split: str) -> DataFrame:
        return self.rows.where(F.col("split") == split)


def class_losses(silos: Silos) -> DataFrame:
    """(model, client_id, value): cross entropy of every model on every silo's test rows and on all."""
    counted = X.with_global_silo(class_outcomes(silos.part("test"), silos.models))
    return counted.groupBy("model", "client_id").agg((F.sum("ce") / F.sum("n")).alias("value"))


def _paired(df: DataFrame, value: str = "value") -> DataFrame:
    return df.select("src", "tgt", F.col(value).alias("value"))


def registry(silos: Silos, regression: bool = False) -> dict[str, Callable[[], DataFrame]]:
    """Measure name → its (src, tgt, value); a volume belongs to one silo and stands beside Global."""
    rows, features = silos.rows, silos.rows.select("row_id", "client_id", "features")
    both = control_table(X.relevance_diversity(features, components=COMPONENTS))

    def volume() -> DataFrame:
        scores = X.pca_transform(features, X.pca_fit(features, COMPONENTS)).select("client_id", F.col("scores").alias("features"))
        found = X.robust_volume(scores, silos.omega).where(F.col("client_id") != GLOBAL)
        return found.select(F.col("client_id").alias("src"), F.lit(GLOBAL).alias("tgt"), "value")

    def degradation() -> DataFrame:
        losses = L.cross_losses_regression(*(L.clean_rows(silos.part(s)) for s in ("train", "test"))) if regression else class_losses(silos)
        return X.performance_degradation(losses)

    own = {s: w for s, w in (silos.models or {}).items() if s != GLOBAL}
    every = {
        "wasserstein": lambda: X.wasserstein_sinkhorn(rows),
        "gaussianMMD": lambda: X.gaussian_mmd(rows),
        "performanceDegradation": degradation,
        "yShift": lambda: _paired(Y.y_shift_features(rows, own), "shift"),
        "negativeConditionalEntropy": lambda: X.negative_conditional_entropy(rows),
        "relevance": lambda: _paired(both, "relevance"),
        "diversity": lambda: _paired(both, "diversity"),
        "hellinger": lambda: X.hellinger(rows),
        "volume": volume,
    }
    return {name: every[name] for name in NAMES if not (regression and name in CLASS_ONLY)}


def all_measures(silos: Silos, regression: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """(measure, src, tgt, value) of every measure that the target allows, or of those asked for."""
    chosen = registry(silos, regression)
    unknown = set(only or ()) - set(chosen)
    if unknown:
        raise ValueError(f"no such measures here: {sorted(unknown)}")
    return control_table(X.distance_matrix({name: run() for name, run in chosen.items() if only is None or name in only}))


def both_correlations(sv: DataFrame, measures: DataFrame, keys: tuple[str, ...] = ("metric", "measure")) -> DataFrame:
    """(keys, side, pearson, pearson_p, spearman, spearman_p) of values against measures.

    A volume has one value per silo, so it stands against the Centralized values only. Shares of a shift that are not finite
    count as 0 for Pearson, as published results did; Spearman leaves them out.
    """
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    cleaned = C.clean_nonfinite(measures.where(F.col("measure") == "yShift")).unionByName(measures.where(F.col("measure") != "yShift"))
    straight = C.sv_distance_correlation(sv, cleaned, "pearson", keys)
    ranked = C.sv_distance_correlation(sv, measures.where(finite), "spearman", keys)
    named = lambda df, name: df.select(*keys, "side", F.col("r").alias(name), F.col("p").alias(f"{name}_p"))
    return named(straight, "pearson").join(named(ranked, "spearman"), [*keys, "side"], "left").where(
        (F.col("measure") != "volume") | (F.col("side") == "Centralized"))
