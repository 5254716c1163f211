"""Association estimates: every (label, feature set, confound control, fold) is fit and
scored on its test fold and on all holdout tables."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.balance import balanced_times, control_confounds
from evenkeel.operators.contracts import require_columns, require_rows
from evenkeel.operators.features import dense_codes, infer_task, label_index
from evenkeel.operators.frames import model_frame
from evenkeel.operators.metrics import score_predictions
from evenkeel.operators.splits import stratified_holdout, stratified_kfold
from evenkeel.plans.batched import Layout, Run, each_counted, fit_runs, layout, predict_runs
from evenkeel.plans.models import NO_PARAMS, fit_model, predict_tagged
from evenkeel.session import cut_lineage

BASELINE = "baseline"
TAGGED = "__tagged"


def run_matrix(
    feature_sets: DataFrame, labels: Sequence[str], controls: Mapping[str | None, Sequence[str]],
    folds: int,
) -> DataFrame:
    """(out, inp, features, type, trial) of all runs.

    The baseline control is always present; an empty set, or one holding only the label,
    is skipped. Settings unfold from arrays, one explode per dimension."""
    types = [BASELINE] + [f"{m}[{','.join(c)}]" for m, c in controls.items() if m is not None]
    runs = (
        feature_sets.select(F.col("name").alias("inp"), "features")
        .withColumn("out", F.explode(F.array(*[F.lit(v) for v in labels])))
        .withColumn("type", F.explode(F.array(*[F.lit(t) for t in types])))
        .withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    )
    only_label = (F.size("features") == 1) & (F.element_at("features", 1) == F.col("out"))
    return runs.where((F.size("features") > 0) & ~only_label).select(
        "out", "inp", F.array_remove("features", F.col("out")).alias("features"), "type",
        F.col("trial").cast("bigint").alias("trial"),
    )


@dataclass(frozen=True)
class Associations:
    """Long scores and coefficients per run and, where asked for, the predictions of all
    evaluation rows: (run columns.., eval_set, id, y, p, pred, probas, p_true)."""

    scores: DataFrame
    coefs: DataFrame
    predictions: DataFrame | None
    runs: DataFrame

    def __iter__(self):
        return iter((self.scores, self.coefs))


def batch_layout(
    own: DataFrame, labels: Sequence[str], sets: Mapping[str, Sequence[str]], model: str,
    params: Mapping[str, Any], classes: int | None,
) -> Layout | None:
    """The inputs as one matrix, where all runs can be fit together: a logistic or ridge regression
    or a linear SVM of two classes, and few enough inputs. Others are fit one by one."""
    kind = model.upper()
    if kind == "SVM" and (classes is None or classes > 2) or kind not in ("LR", "SVM") or params.get("penalty") == "l1":
        return None
    used = sorted({f for feats in sets.values() for f in feats} - set(labels))
    return layout(own, used) if used else None


def _together(
    tables: Sequence[DataFrame], plan: Layout, feature_sets: Mapping[str, Sequence[str]],
    controls: Mapping[str, Sequence[str]], label: str, id_col: str, model: str, params: Mapping[str, Any],
    regression: bool, classes: int | None, folds: int, seed: str | int, keep: Sequence[str],
    metrics: Sequence, with_predictions: bool, dataset: str,
) -> tuple | None:
    """(scores, coefficients, predictions, run metadata) of all runs of one label, fit together."""
    began = time.monotonic()
    own, rest = tables[0], tables[1:]
    methods = {None: [], **controls}
    refused: dict[str | None, list[int]] = {}
    if controls:
        own = cut_lineage(own, "own-rows")
        parts = []
        for at, (method, cons) in enumerate(controls.items()):
            times, refused[method] = balanced_times(own, method, "__y", id_col, list(cons), folds, seed=seed)
            parts.append(times.select(F.col(id_col).alias("__id"), F.struct((F.lit(at * folds) + F.col("trial")).cast("int").alias("w"), F.col("times").cast("int").alias("n")).alias("e")))
        times = reduce(DataFrame.unionByName, parts).groupBy("__id").agg(F.collect_list("e").alias("__times"))
        own = own.join(times, F.col(id_col) == F.col("__id"), "left").drop("__id")
        rest = [t.withColumn("__times", F.lit(None).cast(own.schema["__times"].dataType)) for t in rest]
    stored = cut_lineage(reduce(DataFrame.unionByName, [own, *rest]), "folds")
    runs = []
    for inp, feats in feature_sets.items():
        used = tuple(f for f in feats if f != label)
        for at, (method, cons) in enumerate(methods.items()):
            for trial in range(folds if used else 0):
                if trial not in refused.get(method, []):
                    name = f"{method}[{','.join(cons)}]" if method else BASELINE
                    runs.append(Run(inp, used, name, trial, None if method is None else (at - 1) * folds + trial))
    fits = fit_runs(stored, plan, runs, model.upper(), params, regression, classes or 0) if runs else None
    if fits is None:
        return None
    spark = stored.sparkSession
    took = round(time.monotonic() - began, 3)
    rows = [(i, dataset, label, runs[i].inp, runs[i].trial, model, str(dict(params)), runs[i].type, int(fits.problems[i].n), str(seed), took) for i in fits.fitted()]
    tags = ["dataset", "out", "inp", "trial", "model", "model_params", "type"]
    about = spark.createDataFrame(rows, "run int, dataset string, out string, inp string, trial int, model string, model_params string, type string, n_samples bigint, seed string, runtime double")
    tagged = lambda df: df.join(F.broadcast(about.select("run", *tags)), "run")  # noqa: E731 - one row per run
    # scores need no more than y, p and the rows' number, unless they hold p against the truth
    counted = not with_predictions and (classes or 0) <= 2 and not (keep and "loglikelihood_ratio" in [m if isinstance(m, str) else m[0] for m in metrics])
    pred = predict_runs(stored, fits, id_col, keep, counted)
    pred = pred.withColumnRenamed("__p_true", "p_true") if keep else pred
    if with_predictions or "roc_auc" in metrics:
        pred = cut_lineage(pred, "predictions")
    if counted:
        pred = each_counted(pred)
    long = tagged(cut_lineage(score_predictions(pred, ["run", "eval_set"], metrics, classes), "scores"))
    cells = [(i, name, value) for i in fits.fitted() for name, value in fits.coefficients(i)]
    table = tagged(spark.createDataFrame(cells, "run int, feature string, coef double"))
    if not keep and not counted:
        pred = pred.withColumn("p_true", F.lit(None).cast("double"))
    return (
        long.select(*tags, "eval_set", "metric", "value"), table.select(*tags, "feature", "coef"),
        None if counted else tagged(pred).select(*tags, "eval_set", "id", "y", "p", "pred", "probas", "p_true"), about.select(*tags, "n_samples", "seed", "runtime"),
    )


def estimate_associations(
    df: DataFrame, id_col: str, labels: Sequence[str], feature_sets: Mapping[str, Sequence[str]],
    holdouts: Mapping[str, DataFrame] | None = None,
    controls: Mapping[str, Sequence[str]] | None = None,
    model: str = "LR", params: Mapping[str, Any] = NO_PARAMS,
    metrics: Sequence = ("balanced_accuracy", "d2"), folds: int = 5, dataset: str = "",
    seed: str | int = 42, parallelism: int = 4, regression_metrics: Sequence = ("r2",),
    with_predictions: bool = False, tagged: DataFrame | None = None,
) -> Associations:
    """Scores per run and evaluation set, coefficients, run metadata and predictions.

    A numeric label of more than two values is a regression, scored by
    ``regression_metrics``; other labels are classes in sorted order. Holdouts are named tables,
    or one table ``tagged`` by a column eval_set for any number of sets. Folds are assigned once
    and stored together with the holdouts, tagged by set, so a run reads one table once (and
    once more for a balanced training set). Where a column ``probas_<label>`` exists, it
    holds the true probabilities and travels with the rows. Rows without a label are left
    out. A control that cannot balance its groups drops the run.

    All logistic, ridge and linear SVM runs of a label are fit together: the number of Spark jobs
    follows the solver's steps, whatever the number of runs; their ``runtime`` is that of all.
    Other models, L1 penalties and very wide inputs are fit run by run, from a small thread
    pool."""
    spark = df.sparkSession
    require_rows(df)
    every = sorted({c for f in feature_sets.values() for c in f})
    controls = dict(controls or {})
    confounds = sorted({c for cols in controls.values() for c in cols})
    require_columns(df, [id_col, *labels, *every, *confounds])
    scores, coefs, preds, metas = [], [], [], []
    for label in labels:
        regression = infer_task(df, label).first()["task"] == "regression"
        sources = {None: df, **(holdouts or {})}
        if tagged is not None:
            sources[TAGGED] = tagged
        if regression:
            classes, coded = None, {n: t.withColumn("__y", F.col(label).cast("double")) for n, t in sources.items()}
        else:
            codes = cut_lineage(dense_codes(df, label, "__y"), "label-codes")
            classes = max(2, codes.count())
            coded = {n: label_index(t, label, "__y", codes=codes) for n, t in sources.items()}
        truth = f"probas_{label}"
        if not regression and truth in df.columns:
            last = F.element_at(F.col(truth), -1).cast("double")
            coded = {n: t.withColumn("__p_true", last if truth in t.columns else F.lit(None).cast("double")) for n, t in coded.items()}
        cols = [id_col, "__y", *(["__p_true"] if "__p_true" in coded[None].columns else []), *dict.fromkeys([*every, *confounds])]
        base = coded[None].select(*cols)
        strata = "__y"
        if regression:  # folds of a value are not stratified
            base, strata = base.withColumn("__all", F.lit(0)), "__all"
        if folds > 1:
            folded = stratified_kfold(base, strata, id_col, folds, seed)
        else:
            held = stratified_holdout(base, strata, id_col, 0.2, seed)
            folded = held.withColumn("fold", F.when(F.col("part") == "test", 0).otherwise(1))
        tables = [folded.select(*cols, F.col("fold").cast("int").alias("fold"), F.lit(None).cast("string").alias("__set"))]
        for name, held in coded.items():
            if name is not None:
                have = [F.col(c) if c in held.columns else F.lit(None).cast(folded.schema[c].dataType).alias(c) for c in cols]
                which = F.col("eval_set") if name == TAGGED else F.lit(name)
                tables.append(held.select(*have, F.lit(None).cast("int").alias("fold"), which.alias("__set")))
        keep = ["__p_true"] if "__p_true" in cols else []
        together = batch_layout(base, labels=[label], sets=feature_sets, model=model, params=params, classes=classes)
        if together is not None:
            found = _together(
                tables, together, feature_sets, controls, label, id_col, model, params, regression, classes,
                folds, seed, keep, regression_metrics if regression else metrics, with_predictions, dataset,
            )
            if found is not None:
                for have, part in zip((scores, coefs, preds, metas), found):
                    have.append(part)
                continue
        stored = cut_lineage(reduce(DataFrame.unionByName, tables), "folds")
        jobs = []
        for inp, feats in feature_sets.items():
            used = [f for f in feats if f != label]
            for method, cons in {None: [], **controls}.items():
                for trial in range(folds):
                    if used:
                        jobs.append((inp, used, method, list(cons), trial))

        def one(job):
            inp, used, method, cons, trial = job
            began = time.monotonic()
            data = model_frame(stored, used, "__y", cons, keep=[id_col, "fold", "__set", *keep])
            own = F.col("__set").isNull()
            train, ok = control_confounds(
                data.where(own & (F.col("fold") != trial)), method, "__y", id_col, cons, seed=seed
            )
            if not ok:
                return None
            fitted = fit_model(train, used, "__y", model, params, regression=regression)
            in_train = own & (F.col("fold") != trial)
            named = F.coalesce("__set", F.when(F.col("fold") == trial, "test").otherwise("train"))
            rows = data.withColumn("eval_set", named)
            if method is not None:
                rows = rows.where(~in_train).unionByName(train.select(*data.columns).withColumn("eval_set", F.lit("train")))
            pred = predict_tagged(fitted, rows, id_col, keep)
            pred = pred.withColumnRenamed("__p_true", "p_true") if keep else pred
            tag = {
                "dataset": F.lit(dataset), "out": F.lit(label), "inp": F.lit(inp),
                "trial": F.lit(trial), "model": F.lit(model), "model_params": F.lit(str(dict(params))),
                "type": F.lit(f"{method}[{','.join(cons)}]" if method else BASELINE),
            }
            if with_predictions:
                pred = cut_lineage(pred, "predictions")
            long = score_predictions(pred, ["eval_set"], regression_metrics if regression else metrics, classes).withColumns(tag)
            table = fitted.coefficient_table(spark).withColumns(tag)
            # A run's scores are a few rows; storing them ends the run inside its thread.
            long = cut_lineage(long.select(*tag, "eval_set", "metric", "value"), "scores")
            meta = spark.range(1).select(
                *[c.alias(k) for k, c in tag.items()], F.lit(fitted.n).cast("bigint").alias("n_samples"),
                F.lit(str(seed)).alias("seed"), F.lit(round(time.monotonic() - began, 3)).alias("runtime"),
            )
            if not keep:
                pred = pred.withColumn("p_true", F.lit(None).cast("double"))
            return long, table.select(*tag, "feature", "coef"), pred.withColumns(tag).select(*tag, "eval_set", "id", "y", "p", "pred", "probas", "p_true"), meta

        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            for result in pool.map(one, jobs):
                if result:
                    for found, part in zip((scores, coefs, preds, metas), result):
                        found.append(part)
    if not scores:
        raise ValueError("no run could be fit")
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return Associations(union(scores), union(coefs), union(preds) if with_predictions else None, union(metas))
