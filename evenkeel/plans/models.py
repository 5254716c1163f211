"""Distributed model fits with the encoders, coefficient tables and predictions around
them. Penalties are given the way the usual single-node libraries define them and
converted to Spark's scaling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from types import MappingProxyType
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    PCA,
    OneHotEncoder,
    OneHotEncoderModel,
    StandardScaler,
    VarianceThresholdSelector,
    VectorAssembler,
)
from pyspark.ml.linalg import DenseVector
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.stats import expit
from evenkeel.operators.features import (
    MATRIX_COLUMNS,
    Scaler,
    fit_scaler,
    infer_task,
    route_columns,
    value_dictionary,
    varying_columns,
)
from evenkeel.operators.metrics import accuracy, r2
from evenkeel.operators.sizing import broadcast_if_small
from evenkeel.operators.splits import stratified_holdout
from evenkeel.plans.batched import fit_vectors
from evenkeel.plans.forests import BinnedForest, fit_forest
from evenkeel.plans.perceptron import Perceptron, fit_perceptron

NO_PARAMS: Mapping[str, Any] = MappingProxyType({})
# Default model settings (fixed values).
MAX_ITER = 2000
FOREST_TREES, FOREST_DEPTH = 200, 5
HIDDEN_LAYERS = (200, 100, 20)
MLP_ITER = 1000
GRID_C = (0.1, 1.0, 10.0, 100.0)
# Limits of Spark's solvers: inputs of the normal equations, depth of a tree.
NORMAL_WIDTH, DEEPEST = 4096, 30


@dataclass(frozen=True)
class Encoder:
    """One-hot for categorical inputs, standardisation for numeric ones, fit on train.

    Categories are numbered by a stored dictionary (column, value, at) and encoded as sparse
    vectors, whatever their number; null and unseen values are all zeros. ``codes`` has each
    column's part of the dictionary, broadcast where it is small."""

    cats: tuple[str, ...]
    scaler: Scaler
    dictionary: DataFrame | None = None
    codes: tuple[DataFrame, ...] = ()
    sizes: tuple[int, ...] = ()
    onehot: OneHotEncoderModel | None = None

    @property
    def inputs(self) -> list[str]:
        return [*self.cats, *self.scaler.mean]

    @property
    def width(self) -> int:
        return sum(self.sizes) + len(self.scaler.mean)

    def names_table(self, spark: SparkSession) -> DataFrame:
        """(at, feature) of all inputs after encoding."""
        rows = [(sum(self.sizes) + i, c) for i, c in enumerate(self.scaler.mean)]
        numbers = spark.createDataFrame(rows, "at bigint, feature string")
        if self.dictionary is None:
            return numbers
        return self.dictionary.select("at", F.concat_ws("_", "column", "value").alias("feature")).unionByName(numbers)

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        wide = self.scaler.transform(df, "__z")
        cols = [c + "__z" for c in self.scaler.mean]
        dense = array_to_vector(F.array(*[F.col(f"`{c}`").cast("double") for c in cols]))
        if self.onehot is None:
            return wide.withColumn(out, dense).select(*df.columns, out)
        wide = wide.withColumn("__dense", dense)
        for i, (c, codes) in enumerate(zip(self.cats, self.codes)):
            wide = wide.join(codes, F.col(f"`{c}`").cast("string") == F.col(f"__v{i}"), "left")
            # the slot behind the last is dropped and leaves zeros
            wide = wide.withColumn(f"__ix_{i}", F.coalesce(f"__at{i}", F.lit(float(max(self.sizes[i], 1))))).drop(f"__v{i}", f"__at{i}")
        wide = self.onehot.transform(wide)
        vectors = [f"__oh_{i}" for i, n in enumerate(self.sizes) if n] + (["__dense"] if cols else [])
        return VectorAssembler(inputCols=vectors, outputCol=out).transform(wide).select(*df.columns, out)


def fit_encoder(train: DataFrame, features: Sequence[str]) -> Encoder:
    cats, nums = route_columns(train, features)
    if len(features) >= MATRIX_COLUMNS:
        nums = varying_columns(train, nums)
    if not cats:
        return Encoder((), fit_scaler(train, nums))
    spark = train.sparkSession
    dictionary = value_dictionary(train, cats)
    counted = {r["column"]: r["count"] for r in dictionary.groupBy("column").count().collect()}
    sizes = tuple(counted.get(c, 0) for c in cats)
    codes = []
    for i, c in enumerate(cats):
        at = (F.col("at") - sum(sizes[:i])).cast("double")
        codes.append(broadcast_if_small(dictionary.where(F.col("column") == c).select(F.col("value").alias(f"__v{i}"), at.alias(f"__at{i}"))))
    places = range(len(cats))
    coder = OneHotEncoder(inputCols=[f"__ix_{i}" for i in places], outputCols=[f"__oh_{i}" for i in places], dropLast=True, handleInvalid="keep")
    # the encoder learns no more than the largest code of each column
    largest = spark.createDataFrame([tuple(float(max(n, 1) - 1) for n in sizes)], ", ".join(f"__ix_{i} double" for i in places))
    return Encoder(tuple(cats), fit_scaler(train, nums), dictionary, tuple(codes), sizes, coder.fit(largest))


@dataclass(frozen=True)
class Fitted:
    """A fitted model with its encoder; ``regression`` tells what ``p`` means."""

    encoder: Encoder
    model: Model | MarginModel | BinnedForest | Perceptron
    label: str
    regression: bool
    classes: int
    n: int = 0

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        """Probability of the last class, or the predicted value, as one more column."""
        return self.predict_all(df, out).select(*df.columns, out)

    def predict_all(self, df: DataFrame, out: str = "p") -> DataFrame:
        """As :meth:`predict`, with the predicted class or value ``pred`` and the classes'
        probabilities ``probas`` (null for a regression)."""
        scored = self.model.transform(self.encoder.transform(df, "features"))
        if self.regression:
            probas = F.lit(None).cast("array<double>")
        elif "probability" in scored.columns:
            probas = vector_to_array("probability")
        else:  # a margin classifier
            margin = expit(F.col("__margin"))
            probas = F.array(1 - margin, margin)
        p = F.col("prediction") if self.regression else probas[self.classes - 1]
        named = {out: p, "pred": F.col("prediction"), "probas": probas}
        return scored.withColumns(named).select(*df.columns, *named)

    def _values(self):
        m = self.model
        if hasattr(m, "coefficientMatrix") and self.classes > 2:
            return m.coefficientMatrix.toArray()[0]
        return m.coefficients.toArray() if hasattr(m, "coefficients") else []

    def coefficients(self) -> list[tuple[str, float]]:
        """(feature after encoding, value); the first class's row for multi-class."""
        return [(r.feature, r.coef) for r in self._table(SparkSession.getActiveSession()).orderBy("at").collect()]

    def _table(self, spark: SparkSession) -> DataFrame:
        cells = pd.DataFrame({"at": range(len(self._values())), "coef": [float(v) for v in self._values()]})
        values = spark.createDataFrame(cells, "at bigint, coef double")
        return self.encoder.names_table(spark).join(broadcast_if_small(values), "at")

    def coefficient_table(self, spark) -> DataFrame:
        """(feature, coef); names come from the stored dictionary."""
        return self._table(spark).select("feature", "coef")


@dataclass(frozen=True)
class MarginModel:
    """A linear classifier of the sign of its margin."""

    coefficients: DenseVector
    intercept: float

    def transform(self, df: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(float(w)) for w in self.coefficients]).cast("array<double>")
        terms = F.zip_with(vector_to_array("features"), weights, lambda x, w: x * w)
        margin = F.aggregate(terms, F.lit(self.intercept), lambda a, x: a + x)
        return df.withColumn("__margin", margin).withColumn("prediction", (F.col("__margin") > 0).cast("double"))


def _forest_size(params: Mapping[str, Any], regression: bool) -> tuple[int, int]:
    """Trees and their depth. A classifier's are not limited; Spark's ceiling stands for that."""
    trees = int(params.get("n_estimators", FOREST_TREES if regression else 100))
    return trees, int(params.get("max_depth", FOREST_DEPTH if regression else DEEPEST))


def _estimator(kind: str, params: Mapping[str, Any], regression: bool, width: int,
               classes: int, n: int, y_std: float, seed: int | None):
    cols = {"featuresCol": "features", "labelCol": "__y"}
    c = float(params.get("C", 1.0))
    penalty = params.get("penalty", "l2")
    if kind == "LR" and regression:
        alpha = 0.0 if penalty is None else float(params.get("alpha", 1.0 / c))
        if penalty == "l1":
            return LinearRegression(
                regParam=alpha, elasticNetParam=1.0, standardization=False, **cols
            )
        # An L2 penalty of alpha on the mean squared error; the solver rescales by the label.
        # The normal equations hold the inputs' covariances, so wide inputs are iterated.
        return LinearRegression(
            regParam=alpha * y_std, elasticNetParam=0.0, standardization=False,
            solver="normal" if width <= NORMAL_WIDTH else "l-bfgs", **cols
        )
    if kind == "LR":
        reg = 0.0 if penalty is None else 1.0 / (c * n)
        return LogisticRegression(
            regParam=reg, elasticNetParam=1.0 if penalty == "l1" else 0.0,
            standardization=False, maxIter=int(params.get("max_iter", MAX_ITER)), **cols
        )
    if kind == "RF":
        forest = RandomForestRegressor if regression else RandomForestClassifier
        trees, depth = _forest_size(params, regression)
        return forest(numTrees=trees, maxDepth=depth, seed=seed or 0, **cols)
    raise ValueError(f"no distributed {'regressor' if regression else 'classifier'} {kind!r}; "
                     "models: LR, SVM (classes), RF, MLP (classes)")


def fit_model(
    train: DataFrame, features: Sequence[str], label: str, kind: str = "LR",
    params: Mapping[str, Any] = NO_PARAMS, regression: bool | None = None,
    seed: int | None = None,
) -> Fitted:
    """Encode and fit. The label must be numeric (class codes 0..k-1 or a value); the
    task is inferred from it unless given."""
    kind = kind.upper()
    y = F.col(label).cast("double")
    # The inputs are kept for the encoder passes and the solver's own block cache.
    base = train.select(*dict.fromkeys(features), y.alias("__y")).persist()
    try:
        if regression is None:
            regression = infer_task(base, "__y").first()["task"] == "regression"
        encoder = fit_encoder(base, features)
        n, y_std, top = base.agg(F.count("__y"), F.stddev_pop("__y"), F.max("__y")).first()
        classes = 0 if regression else max(2, int(top) + 1)
        rows = encoder.transform(base).select("features", "__y")
        if kind == "SVM" and not regression and classes == 2:
            coef, intercept = fit_vectors(rows, "features", "__y", "squared_hinge", float(params.get("C", 1.0)), encoder.width)
            model = MarginModel(DenseVector(coef), intercept)
        else:
            model = None
            if kind == "RF":
                model = fit_forest(rows, sum(encoder.sizes), encoder.width, classes, *_forest_size(params, regression), seed or 0)
            elif kind == "MLP" and not regression:
                layers = [encoder.width, *params.get("hidden_layer_sizes", HIDDEN_LAYERS), classes]
                model = fit_perceptron(rows, layers, int(params.get("max_iter", MLP_ITER)), seed or 0)
            if model is None:
                est = _estimator(
                    kind, params, regression, encoder.width, classes, n, float(y_std or 0.0), seed
                )
                model = est.fit(rows)
    finally:
        base.unpersist()
    return Fitted(encoder, model, label, regression, classes, n)


def predictions(
    fitted: Fitted, sets: Mapping[str, DataFrame], id_col: str, keep: Sequence[str] = ()
) -> DataFrame:
    """(eval_set, id, y, p, ..keep) of all evaluation sets, predicted in one pass."""
    need = list(dict.fromkeys([id_col, fitted.label, *keep, *fitted.encoder.inputs]))
    tagged = [df.select(*need).withColumn("eval_set", F.lit(n)) for n, df in sets.items()]
    every = reduce(DataFrame.unionByName, tagged)
    return predict_tagged(fitted, every, id_col, keep).drop("pred", "probas")


def predict_tagged(fitted: Fitted, rows: DataFrame, id_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """(eval_set, id, y, p, pred, probas, ..keep) of rows that carry their ``eval_set``: one
    scan whatever the number of sets."""
    need = list(dict.fromkeys(["eval_set", id_col, fitted.label, *keep, *fitted.encoder.inputs]))
    return fitted.predict_all(rows.select(*need)).select(
        "eval_set", F.col(id_col).alias("id"), F.col(fitted.label).cast("double").alias("y"),
        "p", "pred", "probas", *keep,
    )


# --- Gaussian GLM from sufficient statistics ---------------------------------------------

# Relative size below which an eigenvalue counts as zero.
RANK_TOL = 1e-10


def _least_squares(m: Mapping[str, Any]) -> list[tuple]:
    """(coef, stderr, p, r2) per input from one group's moments."""
    import math

    import numpy as np

    n, mx, my, c = m["__n"], np.array(m["__mx"], float), m["__my"], np.array(m["__cxy"], float)
    k = len(mx)
    s = np.zeros((k, k))
    s[np.triu_indices(k)] = np.array(m["__cov"], float)
    s += np.triu(s, 1).T
    scale = np.sqrt(np.maximum(np.diag(s), 0))
    moving = scale > 1e-9 * np.maximum(np.abs(mx), 1e-300)
    unit = np.where(moving, scale, 1.0)
    if moving.all() and np.linalg.eigvalsh(s / np.outer(unit, unit)).min() > RANK_TOL:
        rank, inverse = k + 1, np.linalg.inv(s)
        coef, spread = inverse @ c, np.diag(inverse)
    else:
        s[~moving, :], s[:, ~moving], c[~moving] = 0.0, 0.0, 0.0
        full = np.block([[np.ones((1, 1)), mx[None, :]], [mx[:, None], s + np.outer(mx, mx)]])
        u, sizes, v = np.linalg.svd(full)
        kept = sizes > RANK_TOL * sizes[0]
        inverse, rank = (v[kept].T / sizes[kept]) @ u[:, kept].T, int(kept.sum())
        coef = (inverse @ np.r_[my, c + mx * my])[1:]
        spread = np.diag(inverse)[1:]
    if n <= rank or not np.isfinite(coef).all():
        return [(0.0, 0.0, None, None)] * k
    rss = max(n * (m["__vy"] - 2 * coef @ c + coef @ s @ coef), 0.0)
    stderr = np.sqrt(np.maximum(rss / (n - rank) * spread / n, 0))
    r2_ = 1 - rss / (n * m["__vy"]) if m["__vy"] > 0 else None
    return [
        (float(b), float(e), math.erfc(abs(b / e) / math.sqrt(2)) if e > 0 else 0.0, r2_)
        for b, e in zip(coef, stderr)
    ]


# From this many inputs on, moments are summed as blocks of a matrix; side of a block, and bytes of
# unfinished groups that a task holds.
GRAM_INPUTS, GRAM_BLOCK, GRAM_BYTES = 32, 128, 256 << 20


def _gram_moments(df: DataFrame, xs: Sequence[Column], y: Column, by: Sequence[str]) -> DataFrame:
    """Per group the moments that :func:`_least_squares` takes, of any number of inputs.

    Tasks sum up products of (1, y, inputs), each taken from its overall mean, as dense blocks keyed
    by (group, block row, block column). Blocks are merged in the JVM, one vector each, and a
    group's blocks then meet in one row. The plan does not grow with the number of inputs."""
    k = len(xs) + 1
    values = F.array(y, *xs)
    keys = [f"__by{i}" for i in range(len(by))]
    rows = df.select(*[F.col(b).alias(key) for b, key in zip(by, keys)], values.alias("x")).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    centre = rows.groupBy(F.lit(0).alias("one")).agg(Summarizer.mean(array_to_vector("x")).alias("m")).first()
    shift = np.zeros(k) if centre is None else centre.m.toArray()
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    edges = [*range(0, k + 1, GRAM_BLOCK), k + 1]
    spans = [(a, b) for a, b in zip(edges, edges[1:]) if a < b]

    def blocks(batches):
        open_: dict[tuple, np.ndarray] = {}

        def close():
            out = [(key, i, j, m[a:b, c:d].reshape(-1)) for key, m in open_.items() for i, (a, b) in enumerate(spans) for j, (c, d) in enumerate(spans) if i <= j]
            open_.clear()
            for at in range(0, len(out), 64):
                some = out[at : at + 64]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([key[n] for key, *_ in some], types[n]) for n in range(len(keys))], pa.array([x[1] for x in some], pa.int32()), pa.array([x[2] for x in some], pa.int32()), pa.array([x[3] for x in some], pa.list_(pa.float64()))],
                    names=[*keys, "i", "j", "v"],
                )

        for batch in batches:
            types = [batch.schema.field(n).type for n in keys]
            groups: dict[tuple, list[int]] = {}
            for at, key in enumerate(zip(*[batch.column(n).to_pylist() for n in keys]) if keys else [()] * batch.num_rows):
                groups.setdefault(key, []).append(at)
            x = pc.list_flatten(batch.column("x")).to_numpy(zero_copy_only=False).reshape(batch.num_rows, k) - shift
            x = np.concatenate([np.ones((batch.num_rows, 1)), x], axis=1)
            for key, at in groups.items():
                some = x[at]
                product = some.T @ some
                open_[key] = open_[key] + product if key in open_ else product
                if len(open_) * product.nbytes > GRAM_BYTES:
                    yield from close()
        if open_:
            yield from close()

    schema = "".join(f"`{c}` {kinds[c]}, " for c in keys) + "i int, j int, v array<double>"
    summed = rows.mapInArrow(blocks, schema).groupBy(*keys, "i", "j").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
    gathered = summed.groupBy(*keys).agg(F.collect_list(F.struct("i", "j", vector_to_array("v").alias("v"))).alias("blocks"))

    def moments(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                if not len(row["blocks"]):  # no complete row, all of them one group
                    continue
                m = np.zeros((k + 1, k + 1))
                for part in row["blocks"]:
                    (a, b), (c, d) = spans[part["i"]], spans[part["j"]]
                    m[a:b, c:d] = np.array(part["v"]).reshape(b - a, d - c)
                    m[c:d, a:b] = m[a:b, c:d].T
                n = m[0, 0]
                mean = m[0, 1:] / n
                cov = m[1:, 1:] / n - np.outer(mean, mean)
                yield pd.DataFrame([{
                    **{key: row[key] for key in keys}, "__n": int(n), "__my": mean[0] + shift[0], "__vy": max(cov[0, 0], 0.0),
                    "__mx": mean[1:] + shift[1:], "__cov": cov[1:, 1:][np.triu_indices(k - 1)], "__cxy": cov[0, 1:],
                }])

    schema = "".join(f"`{c}` {kinds[c]}, " for c in keys) + "__n bigint, __my double, __vy double, __mx array<double>, __cov array<double>, __cxy array<double>"
    found = gathered.mapInPandas(moments, schema)
    return found.select(*[F.col(key).alias(b) for b, key in zip(by, keys)], *[c for c in found.columns if c not in keys])


def gaussian_glm(
    df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str] = (), gate: bool = False
) -> DataFrame:
    """Least squares with intercept per group: (by.., feature, coef, stderr, p, pseudo_r2).

    One aggregation yields every group's means and covariances, so data size only matters
    to the scan; each small system is solved where its row lives. ``p`` is two-sided
    normal; ``gate`` zeroes coefficients with p > 0.05. The pseudo R2 is Cox-Snell at
    maximum likelihood variances. A collinear design (say, all indicators of a category
    beside the intercept) gets the minimum-norm solution; a group too small to fit gets
    zeros and no R2. Rows with a null or NaN are left out."""
    from evenkeel.plans.reports import gate_coefs

    xs, by = list(xs), list(by)
    dbl = [F.col(f"`{c}`").cast("double") for c in xs]
    out = F.col(f"`{y}`").cast("double")
    complete = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) for c in [*dbl, out]])
    if len(xs) > GRAM_INPUTS:
        moments = _gram_moments(df, dbl, out, by)
    else:
        moments = df.where(complete).groupBy(*by).agg(
            F.count(F.lit(1)).alias("__n"), F.avg(out).alias("__my"), F.var_pop(out).alias("__vy"),
            F.array(*[F.avg(a) for a in dbl]).alias("__mx"),
            F.array(*[F.covar_pop(a, b) for i, a in enumerate(dbl) for b in dbl[i:]]).alias("__cov"),
            F.array(*[F.covar_pop(a, out) for a in dbl]).alias("__cxy"),
        )
    names = [*by, "feature", "coef", "stderr", "p", "pseudo_r2"]

    def solve(batches):
        import pandas as pd

        for pdf in batches:
            rows = [
                [*[r[b] for b in by], x, *cell]
                for r in pdf.to_dict("records")
                for x, cell in zip(xs, _least_squares(r))
            ]
            yield pd.DataFrame(rows, columns=names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in moments.schema if f.name in by]
    schema = ", ".join(
        [*fields, "feature string", "coef double", "stderr double", "p double", "pseudo_r2 double"]
    )
    coefs = moments.mapInPandas(solve, schema)
    return gate_coefs(coefs) if gate else coefs


# --- matrix inputs ------------------------------------------------------------------------

def vector_column(df: DataFrame, arr: str, out: str = "raw") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(arr).cast("array<double>")))


def fit_pca(train: DataFrame, arr: str, n: int):
    """Centre and project on the first n principal axes, learned on ``train``."""
    stages = [
        StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False),
        PCA(k=n, inputCol="centred", outputCol="pca"),
    ]
    model = Pipeline(stages=stages).fit(vector_column(train, arr))

    def transform(df: DataFrame) -> DataFrame:
        out = model.transform(vector_column(df, arr))
        return out.withColumn("pca", vector_to_array("pca")).drop("raw", "centred")

    return transform


def grid_search_logistic(
    train: DataFrame, arr: str, label: str, cs: Sequence[float] = GRID_C, folds: int = 5,
    seed: int = 42, max_iter: int = 1000,
) -> CrossValidatorModel:
    """Drop constant inputs, standardise, logistic regression; C chosen by accuracy."""
    n = train.count() * (folds - 1) / folds
    lr = LogisticRegression(
        featuresCol="scaled", labelCol=label, elasticNetParam=0.0, standardization=False,
        maxIter=max_iter,
    )
    chain = Pipeline(stages=[
        VarianceThresholdSelector(featuresCol="raw", outputCol="kept"),
        StandardScaler(inputCol="kept", outputCol="scaled", withMean=True),
        lr,
    ])
    grid = ParamGridBuilder().addGrid(lr.regParam, [1.0 / (c * n) for c in cs]).build()
    metric = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    cv = CrossValidator(estimator=chain, estimatorParamMaps=grid, evaluator=metric,
                        numFolds=folds, seed=seed, parallelism=2)
    return cv.fit(vector_column(train, arr))


def reduced_grid_search(
    train: DataFrame, sets: Mapping[str, DataFrame], arr: str, label: str,
    components: Sequence[int], cs: Sequence[float] = GRID_C, folds: int = 5,
) -> DataFrame:
    """Accuracy of the grid-searched model on every set for each number of components."""
    out = []
    for n in components:
        project = fit_pca(train, arr, n)
        model = grid_search_logistic(project(train), "pca", label, cs, folds)
        for name, df in sets.items():
            scored = model.transform(vector_column(project(df), "pca"))
            hit = (F.col("prediction") == F.col(label)).cast("double")
            out.append(scored.agg(F.avg(hit).alias("accuracy")).select(
                F.lit(n).alias("components"), F.lit(name).alias("eval_set"), "accuracy"))
    return reduce(DataFrame.unionByName, out)


def baseline_fit(
    df: DataFrame, features: Sequence[str], label: str, value: str, id_col: str,
    seed: str | int = 42,
) -> DataFrame:
    """Quick 90/10 check: accuracy above chance for ``label`` and linear R2 for ``value``."""
    parts = stratified_holdout(df, label, id_col, 0.1, seed)
    train, test = parts.where(F.col("part") == "train"), parts.where(F.col("part") == "test")
    cls = fit_model(train, features, label, regression=False).predict(test)
    reg = fit_model(train, features, value, "LR", {"penalty": None}, regression=True).predict(test)
    a = cls.agg((accuracy(F.col(label), F.col("p")) - 0.5).alias("score"))
    b = reg.agg(r2(F.col(value), F.col("p")).alias("score"))
    return a.select(F.lit(label).alias("target"), "score").unionByName(
        b.select(F.lit(value).alias("target"), "score"))


__all__ = [
    "Encoder", "Fitted", "baseline_fit", "fit_encoder", "fit_model",
    "fit_pca", "gaussian_glm", "grid_search_logistic", "predict_tagged", "predictions", "reduced_grid_search",
]
