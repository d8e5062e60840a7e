"""Probability transforms as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def clip(x, low=None, high=None) -> Column:
    """x held between two bounds; NULL and NaN give NULL (greatest and least would skip them)."""
    v = _c(x)
    kept = v if low is None else F.greatest(v, F.lit(low))
    kept = kept if high is None else F.least(kept, F.lit(high))
    return F.when(v.isNotNull() & ~F.isnan(v.cast("double")), kept)


def clip_probability(p, eps: float = EPS) -> Column:
    return clip(p, eps, 1.0 - eps)


def logit(p) -> Column:
    q = clip_probability(p)
    return F.log(q) - F.log1p(-q)


def sigmoid(x) -> Column:
    """1/(1+exp(-x)) written so that exp never overflows."""
    v = _c(x)
    e = F.exp(-F.abs(v))
    return F.when(v >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def intensity_to_probability(rate) -> Column:
    return -F.expm1(-clip(rate, 0.0, 50.0))


def prior_shift(p, train_prior: float, deploy_prior: float, is_logit: bool = False) -> Column:
    """Move scores from the training prevalence to the deployment prevalence."""
    if not 0.0 < train_prior < 1.0 or not 0.0 < deploy_prior < 1.0:
        raise ValueError("priors must lie strictly between 0 and 1")
    shift = math.log(deploy_prior / (1 - deploy_prior)) - math.log(train_prior / (1 - train_prior))
    base = _c(p) if is_logit else logit(p)
    return sigmoid(base + F.lit(shift))


def ratio(num, den) -> Column:
    """num / den, NULL where the denominator is zero."""
    n, d = _c(num), _c(den)
    return F.when(d != 0, n / d)


def ratio_or_zero(num, den) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x
