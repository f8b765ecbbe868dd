"""Cleaning, imputation, scaling, encoding, splitting.

Fitted state is one row (minimum, mean, mode, category list per column) and reaches the rows as a scalar subquery, so no
join is planned for it and its size cannot grow with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, FloatType, IntegralType, NumericType, ShortType, StringType

from silovalue.functions import arrays
from silovalue.functions.hashing import hash_below
from silovalue.functions.ranking import ordered_rank

MAX_CATEGORIES = 10_000


def numeric_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in skip]


def string_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType) and f.name not in skip]


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def null_token(df: DataFrame, token: str = "?", columns: list[str] | None = None) -> DataFrame:
    """The token stands for a missing value in text columns."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(token)) for c in columns or string_columns(df)})


def recode_values(df: DataFrame, mapping: dict[str, dict[str, str]]) -> DataFrame:
    """Literal replacement per column; other values stay."""
    for column, pairs in mapping.items():
        df = df.replace(pairs, subset=[column])
    return df


def drop_null_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def dedupe_rows(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """Full-row duplicates go; with a row id the lowest id of each set of equal rows stays.

    The grouped form combines on the map side, so many copies of one row never meet as rows in a single task.
    """
    if id_col is None:
        return df.dropDuplicates()
    others = [c for c in df.columns if c != id_col]
    return df.groupBy(*others).agg(F.min(id_col).alias(id_col)).select(*df.columns)


def fill_zero(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null and NaN become 0 in numeric columns."""
    chosen = set(columns or numeric_columns(df))
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    cells = [
        (F.coalesce(F.nanvl(c, F.lit(0.0)) if c in floats else F.col(c), F.lit(0)).alias(c) if c in chosen else F.col(c))
        for c in df.columns
    ]
    return df.select(*cells)


def _fitted(stats: DataFrame) -> Column:
    """The one row of fitted state as a struct literal."""
    return stats.select(F.struct(*[F.col(f"`{c}`") for c in stats.columns])).scalar()


def _number(column: str) -> Column:
    """The column as a double in which NaN counts as missing."""
    c = F.col(column).cast("double")
    return F.when(~F.isnan(c), c)


def impute_mean(df: DataFrame, fit_on: DataFrame, columns: list[str]) -> DataFrame:
    means = _fitted(fit_on.agg(*[F.avg(_number(c)).alias(c) for c in columns]))
    return df.withColumns({c: F.coalesce(_number(c), means[c]) for c in columns})


def column_modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the most frequent value of each column; the smallest value wins on ties."""
    typed = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("cell")).select("cell.*").where(F.col("value").isNotNull())
    counts = typed.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("name").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
    return best.agg(*[F.max(F.when(F.col("name") == c, F.col("mode"))).alias(c) for c in columns])


def impute_mode(df: DataFrame, fit_on: DataFrame, columns: list[str]) -> DataFrame:
    modes = _fitted(column_modes(fit_on, columns))
    types = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(F.col(c), modes[c].cast(types[c])) for c in columns})


def minmax_scale(df: DataFrame, fit_on: DataFrame, columns: list[str]) -> DataFrame:
    """(x - min) / (max - min) with bounds of ``fit_on``, not clipped; a constant column becomes x - min.

    NaN is ignored while fitting and stays NaN.
    """
    bounds = _fitted(fit_on.agg(
        *[F.min(_number(c)).alias(f"{c}_min") for c in columns],
        *[F.max(_number(c)).alias(f"{c}_max") for c in columns],
    ))
    scaled = {}
    for c in columns:
        low, high = bounds[f"{c}_min"], bounds[f"{c}_max"]
        width = F.when(high == low, F.lit(1.0)).otherwise(high - low)
        scaled[c] = (F.col(c).cast("double") - low) / width
    return df.withColumns(scaled)


def standardize(df: DataFrame, fit_on: DataFrame, columns: list[str]) -> DataFrame:
    """Mean 0 and population standard deviation 1; a constant column becomes 0."""
    stats = _fitted(fit_on.agg(
        *[F.avg(_number(c)).alias(f"{c}_mean") for c in columns],
        *[F.stddev_pop(_number(c)).alias(f"{c}_std") for c in columns],
    ))
    return df.withColumns({
        c: (F.col(c) - stats[f"{c}_mean"])
        / F.when(stats[f"{c}_std"] == 0, F.lit(1.0)).otherwise(stats[f"{c}_std"])
        for c in columns
    })


def column_min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, min, max), one row per column."""
    ends = df.agg(*[
        F.struct(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c) for c in columns
    ])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("ends")) for c in columns])
    return ends.select(F.explode(rows).alias("r")).select(
        "r.column", F.col("r.ends.min").alias("min"), F.col("r.ends.max").alias("max")
    )


def categories(df: DataFrame, column: str) -> DataFrame:
    """One row with the sorted category list of a column. A column with too many values is refused, not truncated."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v")).distinct().limit(MAX_CATEGORIES + 1)
    return values.agg(F.array_sort(F.collect_list("v")).alias("c")).select(
        F.when(F.size("c") > MAX_CATEGORIES, F.raise_error(F.lit(f"{column}: too many categories")))
        .otherwise(F.col("c")).alias("c")
    )


def category_lists(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the sorted category list of every column, fitted in one pass.

    The limit only bounds memory: if it cuts anything, one column is over its own limit and the query fails below.
    """
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("cell")).select("cell.*").where(F.col("value").isNotNull()).distinct()
    cells = cells.limit(MAX_CATEGORIES * len(columns) + 1)
    lists = cells.groupBy("name").agg(F.array_sort(F.collect_list("value")).alias("c"))
    return lists.agg(*[F.max(F.when(F.col("name") == c, F.col("c"))).alias(c) for c in columns]).select(*[
        F.when(F.size(c) > MAX_CATEGORIES, F.raise_error(F.lit(f"{c}: too many categories")))
        .otherwise(F.coalesce(F.col(c), F.array().cast("array<string>"))).alias(c) for c in columns
    ])


def onehot_encode(
    df: DataFrame, fit_on: DataFrame, columns: list[str], strict: bool = False, suffix: str = "_onehot"
) -> DataFrame:
    """Adds a 0/1 vector per column in sorted category order.

    A value not seen while fitting gives all zeros, or an error with ``strict``.
    """
    known = df.withColumn("_known", _fitted(category_lists(fit_on, columns)))
    encoded = {}

    def indicator(names: Column, value: Column) -> Column:
        return F.transform(names, lambda k: F.when(k == value, F.lit(1.0)).otherwise(F.lit(0.0)))

    for c in columns:
        value, names = F.col(c).cast("string"), F.col("_known")[c]
        flags = indicator(names, value)
        if strict:
            flags = F.when(F.array_contains(names, value), flags).otherwise(
                F.raise_error(F.concat(F.lit(f"{c}: unknown category "), value)).cast("array<double>")
            )
        encoded[f"{c}{suffix}"] = flags
    return known.withColumns(encoded).drop("_known")


def onehot_columns(df: DataFrame, column: str, values: list[str], name: str | None = None) -> DataFrame:
    """One 0/1 column per given category, for reports and slice predicates."""
    return df.withColumns({
        f"{name or column}_{v}": F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for v in values
    })


def display_label(label: str | Column, prefix: str) -> Column:
    """Class name without the encoder's ``prefix`` and its underscore; other underscores stay."""
    c = (F.col(label) if isinstance(label, str) else label).cast("string")
    return F.when(c.startswith(f"{prefix}_"), F.substring(c, len(prefix) + 2, 1 << 30)).otherwise(c)


def encode_labels(df: DataFrame, fit_on: DataFrame, label: str = "label", name: str = "class_index") -> DataFrame:
    """Adds the 0-based class index in the sorted class list of ``fit_on``; a class that is not in it ends the job, a null stays null."""
    place = arrays.label_position(categories(fit_on, label).scalar(), F.col(label))
    unknown = F.raise_error(F.concat(F.lit("unknown class "), F.col(label).cast("string"))).cast("int")
    return df.withColumn(name, F.when(place < 0, unknown).otherwise(place))


def decode_labels(df: DataFrame, fit_on: DataFrame, vector: str, label: str = "label", name: str = "decoded") -> DataFrame:
    """Class of the largest entry of a one-hot or probability vector; the first one wins on ties."""
    classes = categories(fit_on, label).scalar()
    return df.withColumn(name, F.element_at(classes, arrays.argmax(F.col(vector)) + 1))


def order_columns(df: DataFrame, order: list[str]) -> DataFrame:
    """Columns in the given order of original features; the encoded columns of a feature follow at its place."""
    placed = []
    for feature in order:
        placed += [c for c in df.columns if c == feature or (c.startswith(f"{feature}_") and c not in order)]
    rest = [c for c in df.columns if c not in placed]
    return df.select(*dict.fromkeys(placed), *rest)


def downcast_types(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Integers to 16 bit, floats to 32 bit. An integer that does not fit raises instead of wrapping."""
    cells = []
    for f in df.schema:
        c = F.col(f.name)
        if f.name in skip:
            cells.append(c)
        elif isinstance(f.dataType, IntegralType) and not isinstance(f.dataType, ShortType):
            cells.append(c.cast("smallint").alias(f.name))
        elif f.dataType.typeName() == "double":
            cells.append(c.cast(FloatType()).alias(f.name))
        else:
            cells.append(c)
    return df.select(*cells)


def bool_to_int(df: DataFrame) -> DataFrame:
    flags = [f.name for f in df.schema if isinstance(f.dataType, BooleanType)]
    return df.withColumns({c: F.col(c).cast("int") for c in flags})


def assign_row_ids(train: DataFrame, test: DataFrame, key: str, name: str = "row_id") -> DataFrame:
    """Consecutive ids in key order; test ids go on after the last train id."""
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    n_train = train.agg(F.count(F.lit(1))).scalar()
    ranked = ordered_rank(both, ["split"], key, name)
    return ranked.withColumn(name, F.col(name) + F.when(F.col("split") == "test", n_train).otherwise(F.lit(0)))


def train_test_split(df: DataFrame, seed: int, id_col: str = "row_id", test_share: float = 0.3) -> DataFrame:
    """Adds ``split``; every row decides by the hash of its id, so reruns and other engines agree."""
    return df.withColumn(
        "split", F.when(hash_below(seed, test_share, id_col), F.lit("test")).otherwise(F.lit("train"))
    )
