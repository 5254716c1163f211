"""Scores of a prediction table.

Each metric is an aggregate over (label, probability); any number of runs and evaluation
sets is scored by one grouped aggregation whose partial results merge map-side."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.hashing import unit_hash
from evenkeel.functions.stats import LOG_EPS, clip, expit, log_loss, logit
from evenkeel.functions.vectors import softmax
from evenkeel.operators.ranking import value_ranks
from evenkeel.operators.sizing import broadcast_if_small, stratum

# Labels are pulled to these pseudo-probabilities before comparing log-odds (fixed values).
PSEUDO_LO, PSEUDO_HI = 0.01, 0.99
LN2 = 0.6931471805599453

Metric = Callable[[Column, Column], Column]


def _pred(p: Column, threshold: float = 0.5) -> Column:
    return (p > threshold).cast("int")


def pseudo_proba(y: Column) -> Column:
    return clip(y.cast("double"), PSEUDO_LO, PSEUDO_HI)


def accuracy(y: Column, p: Column) -> Column:
    return F.avg((y == _pred(p)).cast("double"))


def balanced_accuracy(y: Column, p: Column) -> Column:
    """Mean recall over the classes present."""
    tpr = F.avg(F.when(y == 1, _pred(p).cast("double")))
    tnr = F.avg(F.when(y == 0, 1.0 - _pred(p)))
    return (F.coalesce(tpr, tnr) + F.coalesce(tnr, tpr)) / 2


def r2(y: Column, p: Column) -> Column:
    return 1 - F.try_divide(F.sum((y - p) * (y - p)), F.count(y) * F.var_pop(y))


def deviance(y: Column, p: Column) -> Column:
    """-2 * (log-likelihood - saturated log-likelihood), sums rounded to 5 digits."""
    saturated = F.bround(-F.sum(log_loss(y, y.cast("double"))), 5)
    return -2 * (F.bround(-F.sum(log_loss(y, p)), 5) - saturated)


def d2(y: Column, p: Column) -> Column:
    """Explained deviance against a uniform null model of two classes."""
    return 1 - F.avg(log_loss(y, p)) / LN2


def d2_prior(y: Column, p: Column) -> Column:
    """Explained deviance against the class frequencies."""
    q = F.avg(y.cast("double"))
    null = -(q * F.log(clip(q, LOG_EPS)) + (1 - q) * F.log(clip(1 - q, LOG_EPS)))
    return 1 - F.try_divide(F.avg(log_loss(y, p)), null)


def d2_most_frequent(y: Column, p: Column) -> Column:
    """Explained deviance against always predicting the larger class (0 on a tie)."""
    ones, n = F.sum(y.cast("double")), F.count(y)
    wrong = F.when(ones > n - ones, n - ones).otherwise(ones)
    lo, hi = F.log(F.lit(LOG_EPS)), F.log(F.lit(1 - LOG_EPS))
    return 1 - F.try_divide(F.sum(log_loss(y, p)), -(wrong * lo + (n - wrong) * hi))


def d2_constant(c: float) -> Metric:
    """Explained deviance against always predicting class ``c``."""
    def metric(y: Column, p: Column) -> Column:
        return 1 - F.try_divide(F.sum(log_loss(y, p)), F.sum(log_loss(y, F.lit(float(c)))))

    return metric


def _log_odds_gap(y: Column, p: Column) -> Column:
    return logit(pseudo_proba(y), None) - logit(p)


def logodds_r2(y: Column, p: Column) -> Column:
    gap, truth = _log_odds_gap(y, p), logit(pseudo_proba(y), None)
    return 1 - F.try_divide(F.sum(gap * gap), F.count(y) * F.var_pop(truth))


def logodds_mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(_log_odds_gap(y, p)))


def logodds_mse(y: Column, p: Column) -> Column:
    gap = _log_odds_gap(y, p)
    return F.avg(gap * gap)


def loglikelihood_ratio(y: Column, p: Column, p_true: Column | None = None) -> Column:
    """Mean log loss of the prediction over that of the true (or pseudo) probability."""
    truth = pseudo_proba(y) if p_true is None else p_true
    return F.try_divide(F.avg(log_loss(y, p)), F.avg(log_loss(y, truth)))


# roc_auc is not an aggregate of (y, p): see score_predictions.
METRICS: dict[str, Metric] = {
    "accuracy": accuracy,
    "balanced_accuracy": balanced_accuracy,
    "r2": r2,
    "deviance": deviance,
    "d2": d2,
    "d2_prior": d2_prior,
    "d2_most_frequent": d2_most_frequent,
    "logodds_r2": logodds_r2,
    "logodds_mae": logodds_mae,
    "logodds_mse": logodds_mse,
    "loglikelihood_ratio": loglikelihood_ratio,
}


def resolve(metrics: Sequence[str | tuple[str, Metric]]) -> dict[str, Metric]:
    """Metrics by registered name, or (name, function) pairs of the user's own."""
    out: dict[str, Metric] = {}
    for m in metrics:
        name, fn = m if isinstance(m, tuple) else (m, METRICS.get(m))
        if fn is None:
            raise ValueError(f"unknown metric {name!r}; known: {sorted(METRICS)}")
        out[name] = fn
    return out


def score(
    df: DataFrame, y: str, p: str, by: Sequence[str] = (),
    metrics: Sequence[str | tuple[str, Metric]] = ("balanced_accuracy", "d2"),
) -> DataFrame:
    """One row per group with one column per metric."""
    fns: Mapping[str, Metric] = resolve(metrics)
    return df.groupBy(*by).agg(*[f(F.col(y), F.col(p)).alias(n) for n, f in fns.items()])


def score_long(
    df: DataFrame, y: str, p: str, by: Sequence[str],
    metrics: Sequence[str | tuple[str, Metric]],
) -> DataFrame:
    """(by.., metric, value) rows."""
    names = list(resolve(metrics))
    wide = score(df, y, p, by, metrics)
    return wide.unpivot(list(by), names, "metric", "value")


#: Metrics that are defined for any number of classes, by predicted class and probabilities.
MULTICLASS = ("accuracy", "balanced_accuracy", "d2")


def score_predictions(
    pred: DataFrame, by: Sequence[str], metrics: Sequence[str | tuple[str, Metric]],
    classes: int | None = 2,
) -> DataFrame:
    """(by.., metric, value) of predictions (y, p, pred, probas and, if known, p_true).

    ``classes`` is None for a regression, whose metrics compare y with p. With more than two
    classes, metrics of two classes are refused. Where there is a column p_true, the
    log-likelihood ratio holds the predictions against it. ``roc_auc`` ranks each group's
    probabilities; all other metrics come from one aggregation."""
    names = [m if isinstance(m, str) else m[0] for m in metrics]
    if classes is not None and classes > 2:
        refused = [m for m in metrics if isinstance(m, str) and m not in MULTICLASS]
        if refused:
            raise ValueError(f"{refused} are defined for two classes, not for {classes}")
        return _score_classes(pred, by, metrics, classes)
    wide_names = [m for m in metrics if m != "roc_auc"]
    fns = dict(resolve(wide_names))
    if classes is None and "roc_auc" in names:
        raise ValueError("roc_auc is defined for classes")
    cells = {n: f(F.col("y"), F.col("p")) for n, f in fns.items()}
    if "loglikelihood_ratio" in cells and "p_true" in pred.columns:
        cells["loglikelihood_ratio"] = loglikelihood_ratio(F.col("y"), F.col("p"), F.col("p_true"))
    out = pred.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), *[c.alias(n) for n, c in cells.items()])
    if "roc_auc" in names:
        auc = roc_auc(pred, "y", "p", by)
        out = out.join(auc, list(by), "left") if by else out.withColumn("roc_auc", auc.select("roc_auc").scalar())
    return out.unpivot(list(by), names, "metric", "value")


def _score_classes(pred: DataFrame, by: Sequence[str], metrics: Sequence, classes: int) -> DataFrame:
    """As :func:`score_predictions`, for three or more classes."""
    known = pred.where(F.col("y").isNotNull())
    recall = known.groupBy(*by, "y").agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("__r"), *[
        c.alias(f"__s{i}") for i, c in enumerate(_class_sums(classes))
    ])
    hits, n = F.sum(F.col("__r") * F.col("__s0")), F.sum("__s0")
    found = {
        "accuracy": F.try_divide(hits, n), "balanced_accuracy": F.avg("__r"),
        "d2": 1 - F.try_divide(F.sum("__s1"), n) / F.log(F.lit(float(classes))),
    }
    out = recall.groupBy(*by).agg(*[found[m].alias(m) for m in metrics if isinstance(m, str)])
    for m in metrics:
        if not isinstance(m, str):
            own = known.groupBy(*by).agg(m[1](F.col("y"), F.col("pred")).alias(m[0]))
            out = out.join(own, list(by), "left") if by else out.withColumn(m[0], own.select(m[0]).scalar())
    names = [m if isinstance(m, str) else m[0] for m in metrics]
    return out.unpivot(list(by), names, "metric", "value")


def _class_sums(classes: int) -> tuple[Column, Column]:
    q = F.element_at("probas", (F.col("y") + 1).cast("int"))
    return F.count("y").cast("double"), F.sum(-F.log(clip(q, LOG_EPS, 1 - LOG_EPS)))


def score_wide(scores: DataFrame, keys: Sequence[str], sets: Sequence[str],
               metrics: Sequence[str]) -> DataFrame:
    """Long scores to columns ``score_<set>_<metric>`` (underscores inside become dashes).

    Sets other than train and test are holdouts."""
    def label(s: str, m: str) -> str:
        s = s if s in ("train", "test") else "holdout_" + s.replace("_", "-")
        return f"score_{s}_{m.replace('_', '-')}"

    cells = [
        F.max(F.when((F.col("eval_set") == s) & (F.col("metric") == m), F.col("value")))
        .alias(label(s, m))
        for s in sets
        for m in metrics
    ]
    return scores.groupBy(*keys).agg(*cells)


def balanced_accuracy_multiclass(
    df: DataFrame, y: str, pred: str, by: Sequence[str] = ()
) -> DataFrame:
    recall = df.groupBy(*by, y).agg(
        F.avg((F.col(y) == F.col(pred)).cast("double")).alias("__r")
    )
    return recall.groupBy(*by).agg(F.avg("__r").alias("balanced_accuracy"))


def roc_auc(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve from average ranks, tied scores sharing a rank.

    Positives are counted per distinct score, so no group is ever sorted row by row."""
    valid = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    pos = F.sum((F.col(y) == 1).cast("bigint")).alias("pos")
    avg_rank = F.col("below") + (F.col("n") + 1) / 2
    parts = value_ranks(valid, by, p, [pos]).groupBy("s").agg(
        F.sum(F.col("pos") * avg_rank).alias("rank_sum"),
        F.sum("pos").alias("p1"),
        F.sum("n").alias("n"),
    )
    n1, n0 = F.col("p1").cast("double"), (F.col("n") - F.col("p1")).cast("double")
    auc = F.try_divide(F.col("rank_sum") - n1 * (n1 + 1) / 2, n1 * n0)
    keys = [F.col(f"s.{b}").alias(b) for b in by]
    return parts.select(*keys, auc.alias("roc_auc"))


def d2_from_logits(df: DataFrame, y: str, z: str, by: Sequence[str] = ()) -> DataFrame:
    """Binary D2 with a sigmoid applied to a logit column first."""
    return score(df.withColumn("__p", expit(F.col(z))), y, "__p", by, ["d2"])


def d2_multiclass(
    df: DataFrame, y: str, probas: str, k: int, by: Sequence[str] = (), from_logits: bool = False
) -> DataFrame:
    """D2 of a k-class label code and a k-vector of probabilities or logits."""
    vec = softmax(F.col(probas)) if from_logits else F.col(probas)
    q = clip(F.element_at(vec, (F.col(y) + 1).cast("int")), LOG_EPS, 1 - LOG_EPS)
    loss = F.avg(-F.log(q)) / F.log(F.lit(float(k)))
    return df.groupBy(*by).agg((1 - loss).alias("d2"))


def d2_stratified(
    df: DataFrame, y: str, p: str, id_col: str, by: Sequence[str] = (), seed: str | int = 42
) -> DataFrame:
    """D2 against labels drawn at the class frequency of each group."""
    prior = df.groupBy(stratum(by).alias("s")).agg(F.avg(F.col(y).cast("double")).alias("q"))
    rows = df.withColumn("s", stratum(by)).join(broadcast_if_small(prior), "s")
    drawn = (unit_hash(F.col(id_col), "null", seed) < F.col("q")).cast("double")
    ratio = F.try_divide(
        F.sum(log_loss(F.col(y), F.col(p))), F.sum(log_loss(F.col(y), drawn))
    )
    return rows.groupBy(*by).agg((1 - ratio).alias("d2"))
