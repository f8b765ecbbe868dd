"""Preparation chains of the dataset loaders, as named recipes over any table with a ``row_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from silovalue.operators import prep as P


def _train(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "train")


def prep_scaled_numeric(df: DataFrame, label: str, features: list[str], seed: int, renames: dict[str, str] | None = None) -> DataFrame:
    """Class index, renamed columns, random split, features scaled by training bounds."""
    rows = P.rename_columns(P.encode_labels(df, df, label), renames or {})
    named = [(renames or {}).get(c, c) for c in features]
    rows = P.train_test_split(rows, seed)
    return P.minmax_scale(rows, _train(rows), named)


def prep_plain(df: DataFrame, label: str, seed: int) -> DataFrame:
    """Random split and class index; features stay as they are."""
    rows = P.train_test_split(df, seed)
    return P.encode_labels(rows, _train(rows), label)


def prep_given_split(train: DataFrame, test: DataFrame, key: str, label: str, renames: dict[str, str]) -> DataFrame:
    """Two given parts: renamed, numbered through, class index fitted on the first."""
    rows = P.rename_columns(P.assign_row_ids(train, test, key), renames)
    return P.encode_labels(rows, _train(rows), renames.get(label, label))


def prep_mixed_impute_mode(df: DataFrame, dropped: list[str], label: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Null tokens, scaled numbers, categories filled by mode and one-hot encoded; given split."""
    rows = P.encode_labels(P.drop_columns(df, dropped), _train(df), label)
    rows = P.null_token(rows, "?", categorical)
    rows = P.minmax_scale(rows, _train(rows), numeric)
    rows = P.impute_mode(rows, _train(rows), categorical)
    encoded = P.onehot_encode(rows, _train(rows), categorical).drop(*categorical)
    return P.order_columns(encoded, [c for c in df.columns if c not in dropped])


def prep_scale_fill_zero(df: DataFrame, label: str, scaled: list[str], key: str) -> DataFrame:
    """Class index, some columns scaled, missing numbers 0, consecutive ids."""
    rows = P.encode_labels(df, _train(df), label)
    rows = P.fill_zero(P.minmax_scale(rows, _train(rows), scaled), scaled)
    parts = [rows.where(F.col("split") == s).drop("split") for s in ("train", "test")]
    return P.assign_row_ids(*parts, key)


def prep_scale_onehot(df: DataFrame, label: str, scaled: list[str], categorical: list[str], key: str) -> DataFrame:
    """As above with categories one-hot encoded; a category that training has not seen is an error."""
    rows = P.encode_labels(df, _train(df), label)
    rows = P.minmax_scale(rows, _train(rows), scaled)
    rows = P.onehot_encode(rows, _train(rows), categorical, strict=True).drop(*categorical)
    rows = P.fill_zero(rows, scaled)
    parts = [rows.where(F.col("split") == s).drop("split") for s in ("train", "test")]
    return P.assign_row_ids(*parts, key)


def prep_clean_dedupe(
    df: DataFrame, dropped: list[str], recodes: dict[str, dict[str, str]], label: str, numeric: list[str],
    categorical: list[str], seed: int, id_col: str = "row_id",
) -> DataFrame:
    """Incomplete and repeated rows go, values are recoded, then split, scaling and encoding."""
    rows = P.dedupe_rows(P.drop_null_rows(P.drop_columns(df, dropped)), id_col)
    rows = P.train_test_split(P.recode_values(rows, recodes), seed, id_col)
    rows = P.encode_labels(rows, _train(rows), label)
    rows = P.minmax_scale(rows, _train(rows), numeric)
    encoded = P.onehot_encode(rows, _train(rows), categorical).drop(*categorical)
    return P.order_columns(encoded, [c for c in df.columns if c not in dropped])


def prep_impute_both(df: DataFrame, dropped: list[str], numeric: list[str], categorical: list[str], seed: int) -> DataFrame:
    """Regression: numbers filled by mean and scaled, categories filled by mode and one-hot encoded."""
    rows = P.train_test_split(P.drop_columns(df, dropped), seed)
    rows = P.impute_mean(rows, _train(rows), numeric)
    rows = P.minmax_scale(rows, _train(rows), numeric)
    rows = P.impute_mode(rows, _train(rows), categorical)
    return P.onehot_encode(rows, _train(rows), categorical).drop(*categorical)


def prep_scale_series(df: DataFrame, columns: list[str]) -> DataFrame:
    """A time series scaled by the bounds of all its rows."""
    return P.minmax_scale(df, df, columns)
