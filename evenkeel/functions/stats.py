"""Scalar statistics used across the metrics and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Clip used before taking log-odds, and before taking logs of probabilities (fixed values).
LOGIT_EPS = 1e-6
LOG_EPS = 2.220446049250313e-16


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Force values into [lo, hi]; nulls stay null."""
    out = x
    if lo is not None:
        out = F.when(out < lo, F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(out > hi, F.lit(hi)).otherwise(out)
    return out


def logit(p: Column, eps: float | None = LOGIT_EPS) -> Column:
    if eps is not None:
        p = clip(p, eps, 1 - eps)
    return F.log(p / (F.lit(1.0) - p))


def expit(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def percent_to_unit(p: Column, observed_max: Column) -> Column:
    """Divide by 100 when the column's observed maximum shows it holds percents."""
    return F.when(observed_max > 1, p / 100.0).otherwise(p.cast("double"))


def log_odds(p: Column, observed_max: Column) -> Column:
    """Log-odds of a probability or percent column, clipped away from 0 and 1."""
    return logit(percent_to_unit(p, observed_max))


def percent_log_odds(pct: Column) -> Column:
    """Configured effect of a percent key: ln(p / (1 - p))."""
    u = pct / 100.0
    return F.log(u / (F.lit(1.0) - u))


def log_loss(y: Column, p: Column) -> Column:
    """Per-row negative log-likelihood of a 0/1 label under P(y = 1) = p."""
    q = clip(p, LOG_EPS, 1 - LOG_EPS)
    return F.when(y == 1, -F.log(q)).otherwise(-F.log(F.lit(1.0) - q))


