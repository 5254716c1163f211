"""Column selection by role, row filters and schema tidying."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.stats import clip

# Column-name prefixes that state a column's role (fixed values).
LABEL_PREFIX = "lbl_"
COVARIATE_PREFIX = "cov_"
PROBAS_PREFIX = "probas_"


@dataclass(frozen=True)
class Roles:
    """Columns of a sample table by role."""

    labels: list[str] = field(default_factory=list)
    covariates: list[str] = field(default_factory=list)
    probas: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)


def columns_by_role(df: DataFrame, id_col: str | None = None) -> Roles:
    """Resolve roles from name prefixes; whatever has none is an attribute."""
    roles = Roles()
    for c in df.columns:
        if c == id_col:
            continue
        if c.startswith(LABEL_PREFIX):
            roles.labels.append(c)
        elif c.startswith(COVARIATE_PREFIX):
            roles.covariates.append(c)
        elif c.startswith(PROBAS_PREFIX):
            roles.probas.append(c)
        else:
            roles.attributes.append(c)
    return roles


def select_matching(df: DataFrame, pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` plus every column whose name matches the regular expression."""
    rx = re.compile(pattern)
    return df.select(*keep, *[c for c in df.columns if c not in keep and rx.search(c)])


def select_prefix(df: DataFrame, prefixes: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    hit = [c for c in df.columns if c not in keep and c.startswith(tuple(prefixes))]
    return df.select(*keep, *hit)


def model_frame(
    df: DataFrame, features: Sequence[str], label: str, confounds: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Only the columns one fit needs: features, label, its probabilities, confounds."""
    wanted = [*keep, *features, label, PROBAS_PREFIX + label, *confounds]
    return df.select(*[c for c in dict.fromkeys(wanted) if c in df.columns])


def filter_allowed(df: DataFrame, allowed: Mapping[str, Sequence]) -> DataFrame:
    """Keep rows whose value is listed; None in a list also keeps nulls."""
    def test(c: str, vals: Sequence) -> Column:
        hit = F.col(c).isin([v for v in vals if v is not None])
        return hit | F.col(c).isNull() if None in vals else hit

    return reduce(lambda d, kv: d.where(test(*kv)), allowed.items(), df)


def drop_null(df: DataFrame, subset: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    return df.dropna(how, subset=list(subset) if subset else None)


def clip_lower(df: DataFrame, cols: Sequence[str], lo: float = 0.0) -> DataFrame:
    return df.withColumns({c: clip(F.col(c), lo=lo) for c in cols})


def sort_columns(df: DataFrame) -> DataFrame:
    return df.select(*sorted(df.columns))


def feature_sets(
    edges: DataFrame, kinds: Sequence[str], label: str = "",
    attributes: Sequence[str] = (), covariates: Sequence[str] = (),
) -> DataFrame:
    """Named input sets (kind, name, features) of a causal graph.

    Subsets group the children of each parent; the superset is their union; the label
    is removed from every set. Set sizes are bounded by the number of variables."""
    is_cov = F.col("child").contains(COVARIATE_PREFIX) | F.col("child").contains(LABEL_PREFIX)

    def children(rows: DataFrame) -> DataFrame:
        return rows.groupBy("parent").agg(F.array_sort(F.collect_set("child")).alias("f"))

    def subset(rows: DataFrame, kind: str, prefix: str) -> DataFrame:
        name = F.concat(F.lit(prefix), F.array_join("f", ", "))
        return children(rows).select(F.lit(kind).alias("kind"), name.alias("name"), "f").distinct()

    def fixed(kind: str, cols: Sequence[str]) -> DataFrame:
        arr = F.array(*[F.lit(c) for c in cols]).cast("array<string>")
        return edges.sparkSession.range(1).select(
            F.lit(kind).alias("kind"), F.lit(kind).alias("name"), arr.alias("f")
        )

    build = {
        "attr_subsets": lambda: subset(edges.where(~is_cov), "attr_subsets", "attr_"),
        "cov_subsets": lambda: subset(edges.where(is_cov), "cov_subsets", ""),
        "attr_superset": lambda: edges.where(~is_cov).agg(
            F.array_sort(F.collect_set("child")).alias("f")
        ).select(
            F.lit("attr_superset").alias("kind"), F.lit("attr_superset").alias("name"), "f"
        ),
        "attr_all": lambda: fixed("attr_all", attributes),
        "cov_all": lambda: fixed("cov_all", covariates),
    }
    unknown = [k for k in kinds if k not in build]
    if unknown:
        raise ValueError(f"feature sets are {sorted(build)}, not {unknown}")
    sets = reduce(DataFrame.unionByName, [build[k]() for k in kinds])
    return sets.select("kind", "name", F.array_remove("f", label).alias("features"))
