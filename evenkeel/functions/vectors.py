"""Vector maths on array<double> columns with higher-order functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Probabilities closer to 0 or 1 than this are snapped to 0 or 1 (fixed value).
PROBA_SNAP = 1e-5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def zeros(k: int | Column) -> Column:
    k = F.lit(k) if isinstance(k, int) else k
    return F.array_repeat(F.lit(0.0), k)


def vsum(w: Column) -> Column:
    return F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x)


def vadd(*vectors: Column) -> Column:
    """Element-wise sum; a null vector counts as zeros of the other's length."""
    out = vectors[0]
    for v in vectors[1:]:
        out = F.when(out.isNull(), v).when(v.isNull(), out).otherwise(
            F.zip_with(out, v, lambda a, b: a + b)
        )
    return out


def vscale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def normalise(v: Column) -> Column:
    return let(vsum(v), lambda total: F.transform(v, lambda x: x / total))


def softmax(z: Column) -> Column:
    def shifted(v: Column) -> Column:
        return let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m)))

    return let(let(z, shifted), normalise)


def sigmoid(z: Column) -> Column:
    return F.transform(z, lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


LINKS: dict[str, Callable[[Column], Column]] = {
    "softmax": softmax,
    "sigmoid": sigmoid,
    "identity": lambda z: z,
}


def link_probas(
    w: Column,
    link: str | Callable[[Column], Column] = "softmax",
    basis: Callable[[Column], Column] | None = None,
    uniform_on_zero_sum: bool = False,
) -> Column:
    """Weights to probabilities.

    All-zero weights give the uniform distribution (``uniform_on_zero_sum`` widens
    that to weights that merely sum to zero). Values within ``PROBA_SNAP`` of 0 or 1
    are snapped, then the vector is renormalised."""
    fn = LINKS[link] if isinstance(link, str) else link
    z = F.transform(w, basis) if basis else w
    snapped = F.transform(
        fn(z),
        lambda p: F.when(p < PROBA_SNAP, F.lit(0.0))
        .when(p > 1 - PROBA_SNAP, F.lit(1.0))
        .otherwise(p),
    )
    probas = let(snapped, normalise)
    unset = vsum(w) == 0 if uniform_on_zero_sum else F.forall(w, lambda x: x == 0)
    uniform = F.transform(w, lambda _: F.lit(1.0) / F.size(w))
    return F.when(unset, uniform).otherwise(probas)


def cdf(p: Column) -> Column:
    """Running sums of a probability vector."""
    return F.transform(p, lambda _, i: vsum(F.slice(p, F.lit(1), i + 1)))


def draw_index(p: Column, u: Column) -> Column:
    """0-based index of the category whose CDF interval holds the uniform ``u``."""
    below = F.size(F.filter(let(p, cdf), lambda c: c <= u))
    return F.least(F.size(p) - 1, below)


def draw_from_cdf(running: Column, u: Column, k: int) -> Column:
    """:func:`draw_index` on precomputed running sums of known length, as plain
    comparisons."""
    below = sum(((running[i] <= u).cast("int") for i in range(1, k)), (running[0] <= u).cast("int"))
    return F.least(F.lit(k - 1), below)


def state_at(states: Sequence | Column, ix: Column) -> Column:
    arr = states if isinstance(states, Column) else F.array(*[F.lit(s) for s in states])
    return F.element_at(arr, (ix + 1).cast("int"))


def round_vector(p: Column, digits: int = 2) -> Column:
    """Half-even rounding of every element."""
    return F.transform(p, lambda x: F.bround(x, digits))
