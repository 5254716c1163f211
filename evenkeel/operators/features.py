"""Feature encoding. ``fit_*`` learn a bounded set of parameters in one aggregation and
return a transform that is a plain projection, so train, test and counterfactual tables
are all encoded alike without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.operators.contracts import ContractError
from evenkeel.operators.sizing import broadcast_if_small
from evenkeel.session import cut_lineage

# From this many input columns on, inputs are treated as one numeric matrix (fixed value).
MATRIX_COLUMNS = 100


def categories(df: DataFrame, col: str, limit: int | None = None) -> list | None:
    """Sorted distinct non-null values, or None when there are more than ``limit``."""
    found = df.select(col).where(F.col(col).isNotNull()).distinct()
    rows = (found if limit is None else found.limit(limit + 1)).collect()
    return None if limit is not None and len(rows) > limit else sorted(r[0] for r in rows)


def category_codes(
    df: DataFrame, col: str, limit: int, least: int = 1
) -> Callable[[Column], Column]:
    """Expression mapping a value to its position among the sorted categories."""
    cats = categories(df, col, limit)
    if cats is None or len(cats) < least:
        raise ContractError(f"{col} needs between {least} and {limit} categories")
    arr = F.array(*[F.lit(v) for v in cats]).cast(T.ArrayType(df.schema[col].dataType))
    return lambda c: F.nullif(F.array_position(arr, c).cast("bigint"), F.lit(0)) - 1


def label_index(
    df: DataFrame, y: str, out: str, fit_on: DataFrame | None = None, codes: DataFrame | None = None
) -> DataFrame:
    """0-based code of a label in sorted order, learned on ``fit_on``; unseen is null.

    ``codes`` takes a stored result of :func:`dense_codes` (y, out), learned once for several
    tables. Any number of labels will do."""
    codes = dense_codes(df if fit_on is None else fit_on, y, out) if codes is None else codes
    return df.join(broadcast_if_small(codes), y, "left").select(*df.columns, out)


def ordinal_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """Position of each value in the sorted distinct values, for any number of values."""
    return df.join(broadcast_if_small(dense_codes(df, col, out)), col, "left")


def dense_codes(df: DataFrame, col: str, out: str) -> DataFrame:
    """(value, position) of all distinct values without a single-task sort: range partitions
    are numbered each for itself and shifted by the sizes of those before."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    distinct = df.select(col).where(F.col(col).isNotNull()).distinct()
    dealt = distinct.repartitionByRange(parts, col).withColumn("__part", F.spark_partition_id())
    dealt = cut_lineage(dealt, "values")
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(col))
    numbered = dealt.withColumn("__in", within).join(F.broadcast(before), "__part")
    return numbered.select(col, (F.col("__before") + F.col("__in") - 1).cast("bigint").alias(out))


def value_dictionary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Stored (column, value, at): every distinct non-null value of ``cols`` as text, numbered from
    0 in the order of the columns and, within each, of the values. All columns share one
    shuffle; no value passes through the driver."""
    cells = [F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(cols)]
    found = df.select(F.explode(F.array(*cells)).alias("k")).where("k.value is not null").distinct()
    return cut_lineage(dense_codes(found, "k", "at").select("k.column", "k.value", "at"), "dictionary")


def sparse_one_hot(df: DataFrame, id_col: str, cols: Sequence[str], dictionary: DataFrame) -> DataFrame:
    """(id, indices): the positions of each row's values in a :func:`value_dictionary`, ascending; null
    and unseen values have none. For any number of values, as cells meet them by a join."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols]
    long = df.select(id_col, F.explode(F.array(*cells)).alias("k")).select(id_col, "k.*")
    met = long.join(broadcast_if_small(dictionary), ["column", "value"], "left")
    return met.groupBy(id_col).agg(F.array_sort(F.collect_list("at")).alias("indices"))


@dataclass(frozen=True)
class OneHot:
    """Indicator columns for the categories seen at fit time; unseen gives all zeros."""

    cats: dict[str, list]

    def names(self) -> list[str]:
        return [f"{c}_{v}" for c, vals in self.cats.items() for v in vals]

    def transform(self, df: DataFrame) -> DataFrame:
        cols = [
            F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{c}_{v}")
            for c, vals in self.cats.items()
            for v in vals
        ]
        return df.select("*", *cols)


def fit_one_hot(df: DataFrame, cols: Sequence[str]) -> OneHot:
    """One indicator column per value, as many as there are; model fits encode categories as
    sparse vectors instead."""
    return OneHot({c: categories(df, c) for c in cols})


def exact_variance(c: Column) -> Column:
    """Population variance that is exactly zero for a constant column: merging partial
    sums can leave rounding noise, the range cannot."""
    return F.when(F.max(c) == F.min(c), F.lit(0.0)).otherwise(F.var_pop(c))


@dataclass(frozen=True)
class Scaler:
    """(x - mean) / population std; a constant column is only centred."""

    mean: dict[str, float]
    std: dict[str, float]

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns(
            {
                c + suffix: (F.col(c) - F.lit(m)) / F.lit(self.std[c] or 1.0)
                for c, m in self.mean.items()
            }
        )


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> Scaler:
    if not cols:
        return Scaler({}, {})
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.sqrt(exact_variance(F.col(c))).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    return Scaler(
        {c: float(row[f"m{i}"] or 0.0) for i, c in enumerate(cols)},
        {c: float(row[f"s{i}"] or 0.0) for i, c in enumerate(cols)},
    )


def varying_columns(df: DataFrame, cols: Sequence[str], threshold: float = 0.0) -> list[str]:
    """Columns whose population variance exceeds the threshold (one aggregation)."""
    row = df.agg(*[exact_variance(F.col(c)).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if (row[f"v{i}"] or 0.0) > threshold]


def element_variances(df: DataFrame, vec: str) -> DataFrame:
    """(element, variance) of an array column; partial sums merge before the shuffle, so
    only one row per element and task moves."""
    cells = df.select(F.posexplode(vec).alias("element", "__v"))
    return cells.groupBy(F.col("element").cast("bigint").alias("element")).agg(
        exact_variance(F.col("__v").cast("double")).alias("variance")
    )


def varying_elements(df: DataFrame, vec: str, threshold: float = 0.0) -> DataFrame:
    """Indexes of array elements whose population variance exceeds the threshold."""
    return element_variances(df, vec).where(F.col("variance") > threshold).select("element")


def polynomial(
    df: DataFrame, cols: Sequence[str], degree: int, interaction_only: bool = False
) -> tuple[DataFrame, list[str]]:
    """Product columns up to ``degree`` without a bias term; degree 0 adds nothing.

    Names follow ``a``, ``a^2``, ``a b``. Degree 1 returns the inputs."""
    pick = combinations if interaction_only else combinations_with_replacement
    names, new = [], {}
    for d in range(1, degree + 1):
        for combo in pick(cols, d):
            powers = [(c, combo.count(c)) for c in dict.fromkeys(combo)]
            name = " ".join(c if p == 1 else f"{c}^{p}" for c, p in powers)
            names.append(name)
            if d > 1:
                value = F.col(f"`{combo[0]}`")
                for c in combo[1:]:
                    value = value * F.col(f"`{c}`")
                new[name] = value
    return (df.withColumns(new) if new else df), names


def infer_task(df: DataFrame, y: str) -> DataFrame:
    """One row: distinct count, all numeric?, and regression or classification.

    Distinct values are collapsed first, so the test runs once per value."""
    distinct = df.select(F.col(y).cast("string").alias("v")).where(F.col("v").isNotNull()).distinct()
    row = distinct.agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.bool_and(F.col("v").try_cast("double").isNotNull()).alias("numeric"),
    )
    task = F.when((F.col("n_distinct") > 2) & F.col("numeric"), "regression")
    return row.select(
        F.lit(y).alias("label"), "n_distinct", "numeric",
        task.otherwise("classification").alias("task"),
    )


def route_columns(df: DataFrame, cols: Sequence[str]) -> tuple[list[str], list[str]]:
    """(categorical, numeric) input columns by type; from 100 inputs on all are one matrix."""
    numeric_types = (T.NumericType, T.BooleanType)
    kinds = {f.name: isinstance(f.dataType, numeric_types) for f in df.schema}
    cats = [c for c in cols if not kinds[c]]
    if len(cols) >= MATRIX_COLUMNS and cats:
        raise ContractError(f"a matrix of {len(cols)} inputs must be numeric: {cats[:3]}")
    return cats, [c for c in cols if kinds[c]]


def scaled_tag(df: DataFrame, ordinal: str, out: str) -> DataFrame:
    """Ordinal of a tagged value divided by the largest ordinal of the table."""
    top = df.agg(F.max(ordinal)).scalar()
    return df.withColumn(out, F.try_divide(F.col(ordinal).cast("double"), top))


def cut_equal_width(
    df: DataFrame, col: str, out: str, bins: int = 3, min_distinct: int = 6
) -> DataFrame:
    """Right-closed equal-width bin 1..bins; columns with few distinct values stay as is."""
    few = df.select(col).where(F.col(col).isNotNull()).distinct().limit(min_distinct)
    if few.count() < min_distinct:
        return df.withColumn(out, F.col(col))
    edge = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"))).scalar()
    raw = F.ceil((F.col(col) - edge["lo"]) / ((edge["hi"] - edge["lo"]) / F.lit(float(bins))))
    return df.withColumn(out, F.least(F.greatest(raw, F.lit(1)), F.lit(bins)).cast("bigint"))
