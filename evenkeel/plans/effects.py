"""The two end-to-end studies: generate counterfactual tables and score a model on them,
then compare the scores with regression effects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.stats import logit
from evenkeel.operators.features import fit_one_hot, fit_scaler, polynomial, route_columns
from evenkeel.operators.rules import (
    counterfactual_subsets,
    counterfactual_tables,
    layered_assign,
)
from evenkeel.plans.models import NO_PARAMS, gaussian_glm
from evenkeel.plans.reports import (
    average_coefs,
    effect_deviation,
    effect_share,
    gate_coefs,
    label_coefs,
    ood_scores,
)
from evenkeel.plans.runs import estimate_associations
from evenkeel.session import cut_lineage

# Names of the evaluation sets with all and with no sources switched on (fixed values).
ALL_ON, ALL_OFF, SOME_ON = "test_all", "test_none", "test_with_"


@dataclass(frozen=True)
class Sources:
    """Variables acting on the label: direct attributes, confounders with the attributes
    they show up in, and mediators."""

    direct: tuple[str, ...]
    confounders: tuple[str, ...]
    mediators: tuple[str, ...] = ()
    indirect_attributes: tuple[str, ...] = ()

    @property
    def indirect(self) -> tuple[str, ...]:
        return (*self.confounders, *self.mediators)


@dataclass(frozen=True)
class Experiment:
    train: DataFrame
    counterfactuals: DataFrame
    scores: DataFrame
    coefs: DataFrame


def counterfactual_experiment(
    df: DataFrame, states: DataFrame, rules: DataFrame, id_col: str, label: str,
    sources: Sources, features: Sequence[str], model: str = "LR",
    params: Mapping[str, Any] = NO_PARAMS, metrics: Sequence = ("balanced_accuracy", "d2"),
    folds: int = 5, dataset: str = "", seed: str | int = 42,
) -> Experiment:
    """Assign the rule variables, build every counterfactual table, fit on the attributes
    and score each fold on all tables. Train and test rows use different draws."""
    train = cut_lineage(layered_assign(df, states, rules, id_col, f"{seed}:train"), "train")
    names = [*sources.direct, *sources.indirect]
    subsets = counterfactual_subsets(
        df.sparkSession.createDataFrame([(n,) for n in names], "source string"))
    tables = cut_lineage(
        counterfactual_tables(df, states, rules, subsets, id_col, sources.direct,
                              sources.indirect, f"{seed}:test"), "counterfactuals")
    scores, coefs = estimate_associations(
        train, id_col, [label], {"attr_all": list(features)},
        tagged=tables.withColumnRenamed("split", "eval_set"), model=model, params=params, metrics=metrics, folds=folds, dataset=dataset, seed=seed)
    return Experiment(train, tables, scores, coefs)


def set_role(split: Column, sources: Sources) -> Column:
    """a_total, a_none, a_minus_dir (all indirect sources kept) or a_minus_con (all direct
    ones kept); null for other sets."""
    def keeping(names: Sequence[str]) -> str:
        return SOME_ON + "--".join(sorted(names))

    return (
        F.when(split == ALL_ON, "a_total").when(split == ALL_OFF, "a_none")
        .when(split == keeping(sources.indirect), "a_minus_dir")
        .when(split == keeping(sources.direct), "a_minus_con")
    )


def effect_scores(scores: DataFrame, sources: Sources, by: Sequence[str] = ("dataset", "metric")) -> DataFrame:
    """Mean score per role of evaluation set, and the normalised scores of both effects."""
    roles = ("a_total", "a_none", "a_minus_dir", "a_minus_con")
    tagged = scores.withColumn("role", set_role(F.col("eval_set"), sources))
    wide = tagged.groupBy(*by).agg(
        *[F.avg(F.when(F.col("role") == r, F.col("value"))).alias(r) for r in roles])
    return ood_scores(wide)


def encode_columns(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Indicators and standardised columns beside the originals, with their names."""
    cats, nums = route_columns(df, cols)
    hot, scaler = fit_one_hot(df, cats), fit_scaler(df, nums)
    out = scaler.transform(hot.transform(df), "_z")
    return out, [*hot.names(), *[f"{c}_z" for c in nums]]


def regression_effects(
    df: DataFrame, target: str, sources: Sources, trial: str | None = None, degree: int = 0
) -> DataFrame:
    """Log-odds of ``target`` regressed on direct attributes plus confounders (model
    ``gamma``) and plus the confounders' attributes (``theta``), optionally on polynomial
    terms (``poly``): (model, feature, role, coef, stderr, pseudo_r2).

    With ``trial`` one regression per fold is fit from one aggregation and averaged.
    Insignificant coefficients count as zero."""
    groups = {"direct": sources.direct, "confounder": sources.indirect,
              "indirect": sources.indirect_attributes}
    wide, names = df.withColumn("__t", logit(F.col(target))), {}
    for role, cols in groups.items():
        wide, names[role] = encode_columns(wide, cols)
    by = [trial] if trial else []
    role_of = {n: r for r, ns in names.items() for n in ns}

    def fit(model: str, xs: Sequence[str], frame: DataFrame) -> DataFrame:
        coefs = gate_coefs(gaussian_glm(frame, xs, "__t", by))
        quality = coefs.groupBy("feature").agg(F.avg("pseudo_r2").alias("pseudo_r2"))
        pairs = [F.lit(v) for n in xs for v in (n, role_of.get(n, "product"))]
        means = average_coefs(coefs, []).join(quality, "feature")
        return means.select(
            F.lit(model).alias("model"), "feature",
            F.element_at(F.create_map(*pairs), F.col("feature")).alias("role"),
            "coef", "stderr", "pseudo_r2")

    gamma = [*names["direct"], *names["confounder"]]
    out = fit("gamma", gamma, wide)
    if names["indirect"]:
        out = out.unionByName(fit("theta", [*names["direct"], *names["indirect"]], wide))
    if degree:
        frame, terms = polynomial(wide, gamma, degree, interaction_only=degree == 1)
        out = out.unionByName(fit("poly", terms, frame))
    return out


def attribute_effects(
    predictions: DataFrame, scores: DataFrame, sources: Sources, p: str = "p",
    trial: str | None = "trial",
) -> DataFrame:
    """Per metric: out-of-distribution scores beside the shares of the regression effects
    of the predictions, and their absolute deviations.

    ``predictions`` holds p and the source columns of the full test table."""
    coefs = regression_effects(predictions, p, sources, trial).where(F.col("model") == "gamma")
    sums = coefs.agg(
        F.sum(F.when(F.col("role") == "direct", F.abs("coef"))).alias("beta"),
        F.sum(F.when(F.col("role") == "confounder", F.abs("coef"))).alias("gamma"),
    )
    share = effect_share(sums, "beta", "gamma").agg(
        F.struct(F.first("beta_share").alias("b"), F.first("gamma_share").alias("g"))).scalar()
    out = effect_scores(scores, sources).withColumns({"beta_share": share["b"], "gamma_share": share["g"]})
    return effect_deviation(out)


def labelled_effects(effects: DataFrame, suffix: str = "", hat: bool = False) -> DataFrame:
    """Display names for :func:`regression_effects`."""
    roles = effects.select(F.col("feature").alias("var"), "role").distinct()
    return label_coefs(effects.drop("role"), roles, suffix, hat)
