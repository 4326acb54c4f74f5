"""Weighted water-quality index as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from ..defaults import (
    CLASSES,
    DEVIATION_CUTS,
    DEVIATION_PARAMETERS,
    GAUSSIAN_CUTS,
    GAUSSIAN_PARAMETERS,
    Parameter,
    UNKNOWN_CLASS,
)
from .numeric import clip, ratio

PARAMETERS = {"deviation": DEVIATION_PARAMETERS, "gaussian": GAUSSIAN_PARAMETERS}
CUTS = {"deviation": DEVIATION_CUTS, "gaussian": GAUSSIAN_CUTS}


def sub_index(value: Column, parameter: Parameter, method: str) -> Column:
    """Score of one parameter before weighting."""
    distance = value - parameter.ideal
    if method == "deviation":
        span = parameter.scale - parameter.ideal or 1.0
        return F.abs(distance / span) * 100.0
    if method == "gaussian":
        return 100.0 * F.exp(-(distance * distance) / (2.0 * parameter.scale**2))
    raise ValueError(f"unknown index method: {method}")


def combine(
    contributions: Sequence[Column],
    weights: Sequence[float],
    method: str,
    null_policy: str = "null",
) -> Column:
    """Index from weighted sub-indices.

    ``null_policy``: "null" leaves the index unknown when an input is missing,
    "zero" scores such a row 0, "renormalise" spreads the weight over the
    inputs that are there.
    """
    if not contributions:
        raise ValueError("the quality index needs at least one parameter column")
    if null_policy == "renormalise":
        total = reduce(add, (F.coalesce(c, F.lit(0.0)) for c in contributions))
        present = reduce(add, (F.when(c.isNotNull(), w).otherwise(0.0) for c, w in zip(contributions, weights)))
        score = ratio(total, present)
        return score if method == "deviation" else clip(score, F.lit(0.0), F.lit(100.0))
    total = reduce(add, contributions)
    if method == "deviation":
        score = total / sum(weights)
    else:
        score = clip(total, F.lit(0.0), F.lit(100.0))
    if null_policy == "zero":
        return F.coalesce(score, F.lit(0.0))
    if null_policy == "null":
        return score
    raise ValueError(f"unknown null policy: {null_policy}")


def classify(score: Column, cuts: Sequence[float] = DEVIATION_CUTS) -> Column:
    """Class label. Rising cuts mean lower is better, falling cuts higher is better."""
    lower_is_better = cuts[0] < cuts[-1]
    label = F.when(score.isNull(), UNKNOWN_CLASS)
    for cut, name in zip(cuts, CLASSES):
        label = label.when(score <= cut if lower_is_better else score >= cut, name)
    return label.otherwise(CLASSES[-1])


def level(value: Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """First label whose upper bound lies above the value."""
    label = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, name in steps:
        label = label.when(value < bound, name)
    return label.otherwise(otherwise)
