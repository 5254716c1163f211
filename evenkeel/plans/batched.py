"""Linear models of many runs at once: Newton's method over all of them, one aggregation a step.

A step scans the stored rows once. Every task adds its rows' loss, gradient and curvature to the
runs that train on them, and the tasks' sums are merged in the JVM, so the number of jobs follows
the number of steps, whatever the number of runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.features import categories, route_columns

#: Parameters of one run, at most: its curvature has the square of that on the driver.
WIDTH = 512
#: Categories of one column that become indicators here; wider ones are fit as sparse vectors.
LEVELS = 400
STEPS = 100
TOLERANCE = 1e-11
#: Rows of a matrix that a task works on at once.
BLOCK = 20_000


# --- losses ---------------------------------------------------------------------------------
# Each gives (loss, gradient, curvature) of weighted rows for parameters ``b`` (inputs x outputs).

def logistic(a: np.ndarray, y: np.ndarray, m: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    z = a @ b[:, 0]
    p = 0.5 * (1 + np.tanh(z / 2))
    loss = float(m @ (np.logaddexp(0, z) - y * z))
    return loss, (a.T @ (m * (p - y)))[:, None], a.T @ (a * (m * p * (1 - p))[:, None])


def softmax(a: np.ndarray, y: np.ndarray, m: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    z = a @ b
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    total = e.sum(axis=1, keepdims=True)
    p, own = e / total, y.astype(int)
    loss = float(m @ (np.log(total[:, 0]) - z[np.arange(len(y)), own]))
    apart = p.copy()
    apart[np.arange(len(y)), own] -= 1
    k, c = b.shape
    curve = np.empty((k, c, k, c))
    for i in range(c):
        for j in range(i, c):
            w = m * p[:, i] * ((i == j) - p[:, j])
            curve[:, i, :, j] = a.T @ (a * w[:, None])
            curve[:, j, :, i] = curve[:, i, :, j].T
    return loss, a.T @ (apart * m[:, None]), curve.reshape(k * c, k * c)


def squared_hinge(a: np.ndarray, y: np.ndarray, m: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Labels 0 and 1 stand for -1 and 1."""
    sign = 2 * y - 1
    short = np.maximum(1 - sign * (a @ b[:, 0]), 0)
    active = m * (short > 0)
    return float(m @ short**2), (a.T @ (-2 * m * sign * short))[:, None], 2 * a.T @ (a * active[:, None])


def squares(a: np.ndarray, y: np.ndarray, m: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    left = a @ b[:, 0] - y
    return float(m @ left**2) / 2, (a.T @ (m * left))[:, None], a.T @ (a * m[:, None])


LOSSES = {"logistic": logistic, "softmax": softmax, "squared_hinge": squared_hinge, "squares": squares}


@dataclass
class Problem:
    """Newton's method for one run. ``change`` maps its own parameters to those of the rows as they
    are stored; the ridge penalty ``ridge`` is on its own ones, on the intercept only if
    ``whole``."""

    loss: str
    outputs: int
    ridge: float
    whole: bool
    inputs: int
    scaled: np.ndarray
    change: np.ndarray | None = None
    seen: np.ndarray | None = None
    n: float = 0.0
    b: np.ndarray = field(default=None)  # type: ignore[assignment]
    best: tuple[float, np.ndarray] | None = None
    move: np.ndarray | None = None
    steps: int = 0
    done: bool = False

    def __post_init__(self) -> None:
        self.b = np.zeros((self.inputs + 1, self.outputs))

    def raw(self) -> np.ndarray:
        return self.b if self.change is None else self.change @ self.b

    def _start(self, weights: np.ndarray) -> None:
        """Scale as the training rows ask for: the weighted moments are in the first curvature."""
        self.n = weights[0, 0]
        mean = weights[0] / self.n
        var = np.diag(weights) / self.n - mean**2
        moving = self.scaled & (var > 1e-12)
        self.seen = self.scaled | (mean > 0)
        std = np.where(moving, np.sqrt(np.maximum(var, 1e-300)), 1.0)
        self.change = np.diag(1 / std)
        self.change[0] -= np.where(self.scaled, mean, 0.0) / std

    def step(self, loss: float, gradient: np.ndarray, curve: np.ndarray, n: float, total: np.ndarray) -> None:
        """Take the sums at the present parameters and move on."""
        if self.change is None:
            if n <= 0:
                self.done = True
                return
            self._start(total)
        k, c = self.b.shape
        t = self.change
        bent = np.einsum("ai,icjd,jb->acbd", t.T, curve.reshape(k, c, k, c), t, optimize=True).reshape(k * c, k * c)
        pull = np.full((k, c), self.ridge)
        if not self.whole:
            pull[0] = 0.0
        slope = (t.T @ gradient + pull * self.b).reshape(-1)
        value = loss + float((pull * self.b**2).sum()) / 2
        if self.best is not None and value > self.best[0] + 1e-12 * abs(self.best[0]) and np.abs(self.move).max() > 1e-12:
            self.move = self.move / 2
            self.b = self.best[1] + self.move
            self.steps += 1
            return
        self.best = (value, self.b)
        move = -np.linalg.pinv(bent + np.diag(pull.reshape(-1)), rcond=1e-12, hermitian=True) @ slope
        self.done = bool(-(slope @ move) <= TOLERANCE * self.n or self.steps >= STEPS)
        if self.loss == "squares" or not self.done:
            self.move, self.steps = move.reshape(k, c), self.steps + 1
            self.b = self.b + self.move
        if self.loss == "squares":
            self.done = True


#: One pass over the rows for the given parameters: run -> (loss, gradient, curvature, n, moments).
Pass = Callable[[Mapping[int, np.ndarray]], Mapping[int, tuple]]


def newton(problems: Sequence[Problem], evaluate: Pass) -> None:
    """Solve all problems together; those done drop out of the next pass."""
    while active := {i: p.raw() for i, p in enumerate(problems) if not p.done}:
        sums = evaluate(active)
        for i in active:
            if i in sums:
                problems[i].step(*sums[i])
            else:
                problems[i].done = True  # no row trains it


def merged(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums of ``parts`` (run, v) per run. The driver gets one vector per run."""
    rows = parts.select("run", array_to_vector("v").alias("v")).groupBy("run").agg(Summarizer.sum(F.col("v")).alias("v"))
    return {r.run: r.v.toArray() for r in rows.collect()}


def packed(loss: float, gradient: np.ndarray, curve: np.ndarray, n: float, moments: np.ndarray | None) -> np.ndarray:
    return np.concatenate([[loss, n], gradient.reshape(-1), curve.reshape(-1), [] if moments is None else moments.reshape(-1)])


def unpacked(v: np.ndarray, k: int, c: int) -> tuple:
    """(loss, gradient, curvature, n, moments or None) of a packed vector."""
    a, b = 2 + k * c, 2 + k * c + (k * c) ** 2
    moments = v[b:].reshape(k, k) if len(v) > b else None
    return v[0], v[2:a].reshape(k, c), v[a:b].reshape(k * c, k * c), v[1], moments


def weighed(v: np.ndarray, problem: Problem, c: float) -> tuple:
    """The sums of :func:`unpacked`; those of the squared hinge times ``c``."""
    loss, gradient, curve, n, moments = unpacked(v, *problem.b.shape)
    by = c if problem.loss == "squared_hinge" else 1.0
    return by * loss, by * gradient, by * curve, n, moments


# --- runs over a table of folds and holdouts ----------------------------------------------

@dataclass(frozen=True)
class Run:
    """One (feature set, control, fold) of a label; ``weight`` names its entry of ``__times``, or
    is None where the fold alone decides."""

    inp: str
    features: tuple[str, ...]
    type: str
    trial: int
    weight: int | None = None


@dataclass(frozen=True)
class Layout:
    """Inputs of all runs as the columns of one matrix: indicators of categories, then numbers
    around their overall mean and deviation; column 0 is one."""

    levels: Mapping[str, tuple]
    centre: Mapping[str, tuple[float, float]]

    def names(self, features: Sequence[str]) -> list[tuple[str, int]]:
        """(name, column) of a run's inputs."""
        at, found = 1, {}
        for c, values in self.levels.items():
            found[c] = [(f"{c}_{v}", at + i) for i, v in enumerate(values)]
            at += len(values)
        for c in self.centre:
            found[c] = [(c, at)]
            at += 1
        return [x for c in [*self.levels, *self.centre] if c in features for x in found[c]]

    @property
    def width(self) -> int:
        return 1 + sum(map(len, self.levels.values())) + len(self.centre)

    def matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        """A null category or one not in the table is all zeros; a null number the mean."""
        out = np.zeros((batch.num_rows, self.width))
        out[:, 0], at = 1.0, 1
        for c, values in self.levels.items():
            code = pc.index_in(batch.column(c), pa.array(values, pa.string()))
            seen = np.flatnonzero(np.asarray(code.is_valid()))
            out[seen, at + code.drop_null().to_numpy(zero_copy_only=False)] = 1.0
            at += len(values)
        for c, (mean, std) in self.centre.items():
            x = pc.fill_null(batch.column(c), float("nan")).to_numpy(zero_copy_only=False)
            out[:, at] = np.where(np.isnan(x), 0.0, (x - mean) / std)
            at += 1
        return out

    def columns(self) -> list:
        texts = [F.col(f"`{c}`").cast("string").alias(c) for c in self.levels]
        return texts + [F.col(f"`{c}`").cast("double").alias(c) for c in self.centre]


def layout(own: DataFrame, features: Sequence[str]) -> Layout | None:
    """The matrix of ``features``, or None where it is too wide to be fit here."""
    cats, nums = route_columns(own, features)
    if len(nums) >= WIDTH:
        return None
    levels = {}
    for c in cats:
        found = categories(own.select(F.col(f"`{c}`").cast("string").alias(c)), c, LEVELS)
        if found is None:
            return None
        levels[c] = tuple(found)
    if not nums:
        return Layout(levels, {})
    value = [F.col(f"`{c}`").cast("double") for c in nums]
    value = [F.when(~F.isnan(v), v) for v in value]
    row = own.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(value)], *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(value)]).first()
    return Layout(levels, {c: (float(row[f"m{i}"] or 0.0), float(row[f"s{i}"] or 0.0) or 1.0) for i, c in enumerate(nums)})


def trained(batch: pa.RecordBatch, run: Run, own: np.ndarray, fold: np.ndarray, times: dict) -> np.ndarray:
    """How often each row trains the run."""
    if run.weight is None:
        return (own & (fold != run.trial)).astype(float)
    if run.weight not in times:
        found = batch.column("__times")
        keys = np.asarray(pc.list_flatten(found).field(0)) if len(found) else np.zeros(0, dtype=int)
        counts = np.asarray(pc.list_flatten(found).field(1)) if len(found) else np.zeros(0, dtype=int)
        rows = np.asarray(pc.list_parent_indices(found))
        for w in np.unique(keys):
            m = np.zeros(batch.num_rows)
            m[rows[keys == w]] = counts[keys == w]
            times[int(w)] = m
    return times.get(run.weight, np.zeros(batch.num_rows))


def row_state(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    own = np.asarray(batch.column("__set").is_null())
    fold = pc.fill_null(batch.column("fold"), -1).to_numpy(zero_copy_only=False)
    return own, fold


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


@dataclass(frozen=True)
class RunFits:
    """Fitted runs: per run its problem, or None where nothing trained it, and its inputs."""

    layout: Layout
    runs: Sequence[Run]
    problems: Sequence[Problem]
    regression: bool
    classes: int
    loss: str

    def fitted(self) -> list[int]:
        return [i for i, p in enumerate(self.problems) if p.n > 0]

    def coefficients(self, i: int) -> list[tuple[str, float]]:
        """(input after encoding, coefficient); the first class's with three or more. Categories
        that the run has not trained on are left out."""
        p, names = self.problems[i], self.layout.names(self.runs[i].features)
        return [(name, float(p.b[j, 0])) for j, (name, _) in enumerate(names, 1) if p.seen[j]]


def _scaled(names: Sequence[tuple[str, int]], plan: Layout) -> np.ndarray:
    """Which inputs of a run are standardised: the numbers."""
    return np.array([False, *[n in plan.centre for n, _ in names]])


def fit_runs(
    stored: DataFrame, plan: Layout, runs: Sequence[Run], kind: str, params: Mapping[str, Any], regression: bool, classes: int
) -> RunFits | None:
    """Fit all ``runs`` on ``stored`` (fold, __set, __y, [__times], inputs); None where a run has
    more than WIDTH parameters."""
    c = float(params.get("C", 1.0))
    penalty = params.get("penalty", "l2")
    loss = "squares" if regression else "squared_hinge" if kind == "SVM" else "softmax" if classes > 2 else "logistic"
    outputs = classes if loss == "softmax" else 1
    columns = [np.array([0, *[j for _, j in plan.names(r.features)]]) for r in runs]
    if max(len(x) for x in columns) * outputs > WIDTH:
        return None
    problems = [Problem(loss, outputs, 0.0, loss == "squared_hinge", len(x) - 1, _scaled(plan.names(r.features), plan)) for r, x in zip(runs, columns)]
    fn = LOSSES[loss]
    need = [x for x in ("fold", "__set", "__times") if x in stored.columns]
    rows = stored.where("__set is null and __y is not null").select(*need, F.col("__y").cast("double").alias("__y"), *plan.columns())

    def evaluate(active: Mapping[int, np.ndarray]) -> Mapping[int, tuple]:
        first = {i: problems[i].change is None for i in active}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in in_blocks(batches):
                a, times = plan.matrix(batch), {}
                y = batch.column("__y").to_numpy(zero_copy_only=False)
                own, fold = row_state(batch)
                for i, b in active.items():
                    m = trained(batch, runs[i], own, fold, times)
                    some = np.flatnonzero(m)
                    if not len(some):
                        continue
                    x, w = a[np.ix_(some, columns[i])], m[some]
                    v = packed(*fn(x, y[some], w, b), w.sum(), x.T @ (x * w[:, None]) if first[i] else None)
                    sums[i] = sums[i] + v if i in sums else v
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["run", "v"])

        found = merged(rows.mapInArrow(run, "run int, v array<double>"))
        for i, v in found.items():
            if first[i]:
                problems[i].ridge = _ridge(loss, penalty, params, c, v[1])
        return {i: weighed(v, problems[i], c) for i, v in found.items()}

    newton(problems, evaluate)
    return RunFits(plan, runs, problems, regression, classes, loss)


def _ridge(loss: str, penalty: str | None, params: Mapping[str, Any], c: float, n: float) -> float:
    """The penalty's factor beside a sum over rows: alpha times n for squares, 1 for the squared
    hinge and 1/C else."""
    if loss == "squared_hinge":
        return 1.0
    if penalty is None:
        return 0.0
    return float(params.get("alpha", 1.0 / c)) * n if loss == "squares" else 1.0 / c


def predict_runs(stored: DataFrame, fits: RunFits, id_col: str, keep: Sequence[str] = (), counted: bool = False) -> DataFrame:
    """(run, eval_set, id, y, p, pred, probas, ..keep) of every run's training, test and holdout rows,
    in one scan; a row trained on several times comes as often.

    ``counted`` gives (run, eval_set, y, p, n) instead, for two classes or values: a task counts equal
    predictions where a block has few."""
    plan, wanted = fits.layout, fits.fitted()
    columns = {i: np.array([0, *[j for _, j in plan.names(fits.runs[i].features)]]) for i in wanted}
    raw = {i: fits.problems[i].raw() for i in wanted}
    runs, regression, loss = list(fits.runs), fits.regression, fits.loss
    rows = stored.select(F.col(id_col).alias("id"), "fold", "__set", F.col("__y").cast("double").alias("__y"), *[c for c in ("__times",) if c in stored.columns], *keep, *plan.columns())
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"run int, eval_set string, id {kinds['id']}, y double, p double, pred double, probas array<double>"
    schema += "".join(f", {c} {kinds[c]}" for c in keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches):
            a, times = plan.matrix(batch), {}
            own, fold = row_state(batch)
            y = pc.fill_null(batch.column("__y"), float("nan")).to_numpy(zero_copy_only=False)
            sets = batch.column("__set").dictionary_encode()
            names = pa.array(["train", "test", *sets.dictionary.to_pylist()], pa.string())
            held = pc.fill_null(sets.indices, -2).to_numpy(zero_copy_only=False).astype(np.int64) + 2
            for i in wanted:
                m = trained(batch, runs[i], own, fold, times)
                n = np.where(own & (fold != runs[i].trial), m, 1).astype(np.int64)
                at = np.flatnonzero(n)
                if not len(at):
                    continue
                z = a[np.ix_(at, columns[i])] @ raw[i][:, 0]
                p, n, truth = z if regression else 0.5 * (1 + np.tanh(z / 2)), n[at], y[at]
                part = np.where(own[at], (fold[at] == runs[i].trial).astype(np.int64), held[at])
                some, own_p = np.unique(p, return_inverse=True)
                if not regression and 2 * len(some) <= len(p):
                    code = (own_p * len(names) + part) * 3 + np.where(np.isnan(truth), 2, truth).astype(np.int64)
                    codes, back = np.unique(code, return_inverse=True)
                    n = np.bincount(back, n).astype(np.int64)
                    p, part, truth = some[codes // 3 // len(names)], codes // 3 % len(names), np.array([0.0, 1.0, np.nan])[codes % 3]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(p), i, dtype=np.int32)), names.take(pa.array(part)), pa.array(truth, from_pandas=True), pa.array(p), pa.array(n)],
                    names=["run", "eval_set", "y", "p", "n"],
                )

    if counted:
        return rows.drop("id", *keep).mapInArrow(count, "run int, eval_set string, y double, p double, n bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches):
            a, times = plan.matrix(batch), {}
            own, fold = row_state(batch)
            held = np.asarray(pc.fill_null(batch.column("__set"), ""))
            for i in wanted:
                m = trained(batch, runs[i], own, fold, times)
                at = np.repeat(np.arange(batch.num_rows), np.where(own & (fold != runs[i].trial), m, 1).astype(int))
                if not len(at):
                    continue
                z = a[np.ix_(at, columns[i])] @ raw[i]
                probas = pa.nulls(len(at), pa.list_(pa.float64()))
                if regression:
                    p = pred = z[:, 0]
                else:
                    if loss == "softmax":
                        e = np.exp(z - z.max(axis=1, keepdims=True))
                        share = e / e.sum(axis=1, keepdims=True)
                    else:
                        one = 0.5 * (1 + np.tanh(z[:, 0] / 2))
                        share = np.stack([1 - one, one], axis=1)
                    p, pred = share[:, -1], share.argmax(axis=1).astype(float)
                    probas = pa.ListArray.from_arrays(pa.array(np.arange(0, share.size + 1, share.shape[1]), pa.int32()), pa.array(share.reshape(-1)))
                part = np.where(own[at], np.where(fold[at] == runs[i].trial, "test", "train"), held[at])
                taken = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), i, dtype=np.int32)), pa.array(part, pa.string()), taken.column("id"), taken.column("__y"), pa.array(p), pa.array(pred), probas, *[taken.column(c) for c in keep]],
                    names=["run", "eval_set", "id", "y", "p", "pred", "probas", *keep],
                )

    return rows.mapInArrow(run, schema)


def each_counted(pred: DataFrame) -> DataFrame:
    """The rows that counted predictions stand for; they are repeated where they are aggregated."""
    return pred.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("__i", "n")


# --- one run over a vector column -----------------------------------------------------------

def fit_vectors(df: DataFrame, features: str, label: str, loss: str, c: float, width: int) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) that minimise c times the loss of ``df`` (features vector, label 0/1)
    plus half the squared length of both."""
    from pyspark.ml.functions import vector_to_array

    problem = Problem(loss, 1, 1.0, True, width, np.zeros(width + 1, dtype=bool))
    fn = LOSSES[loss]
    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")).where("y is not null")

    def evaluate(active: Mapping[int, np.ndarray]) -> Mapping[int, tuple]:
        b, first = active[0], problem.change is None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in in_blocks(batches):
                x = np.concatenate([np.ones((batch.num_rows, 1)), pc.list_flatten(batch.column("x")).to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)], axis=1)
                v = packed(*fn(x, batch.column("y").to_numpy(zero_copy_only=False), np.ones(len(x)), b), len(x), x.T @ x if first else None)
                total = v if total is None else total + v
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["run", "v"])

        return {i: weighed(v, problem, c) for i, v in merged(rows.mapInArrow(run, "run int, v array<double>")).items()}

    newton([problem], evaluate)
    return problem.b[1:, 0], float(problem.b[0, 0])
