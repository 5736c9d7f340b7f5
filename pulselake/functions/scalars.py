"""Scores and transforms of single values, as columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least score of each grade.
GRADES = {"A+": 85, "A": 75, "B": 60, "C": 40, "D": 20}


def sigmoid_score(x: Column, midpoint: float, steepness: float = 10.0) -> Column:
    """Rises from 0 to 1 around the midpoint."""
    return 1 / (1 + F.exp(-steepness * (x - midpoint)))


def inverse_sigmoid_score(x: Column, midpoint: float, steepness: float = 10.0) -> Column:
    """Falls from 1 to 0 around the midpoint."""
    return 1 - sigmoid_score(x, midpoint, steepness)


def gaussian_score(x: Column, centre: float, width: float) -> Column:
    """1 at the centre, falling off to both sides."""
    return F.exp(-0.5 * F.pow((x - centre) / width, 2))


def safe_log2(x: Column) -> Column:
    """log2, and 0 where there is none."""
    return F.when(x > 0, F.log2(x)).otherwise(0.0)


def unit_range(x: Column, low: float, high: float) -> Column:
    """The place of x between two bounds, clipped to 0 and 1; 0.5 if the bounds are no range."""
    if high <= low:
        return F.when(x.isNotNull(), 0.5)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))


def widened(values: list[float], share: float = 0.2) -> tuple[float, float]:
    """Bounds of the values, wider by a share of their span (of 1, if all are equal) on each side."""
    low, high = min(values), max(values)
    edge = share * ((high - low) or 1.0)
    return low - edge, high + edge


def weighted_distance(pairs: Mapping[str, tuple[Column, Column]], weights: Mapping[str, float]) -> Column:
    """Euclidean distance over named features, each difference weighted."""
    return F.sqrt(sum((weights[k] * F.pow(a - b, 2) for k, (a, b) in pairs.items()), F.lit(0.0)))


def exponential_decay(n: Column, start: float, tau: float, floor: float) -> Column:
    """What is left after n steps of a decay towards start + floor at 0 and floor at the end."""
    return start * F.exp(-n / max(tau, 0.01)) + floor


def grade(score: Column) -> Column:
    """Letter of a 0 to 100 score; F below all others."""
    letter = F.when(score.isNull(), F.lit(None).cast("string"))
    for name, least in GRADES.items():
        letter = letter.when(score >= least, F.lit(name))
    return letter.otherwise(F.lit("F"))


def timescale_label(ms: Column) -> Column:
    """A duration in whole milliseconds, seconds or minutes, whichever is the largest unit below it."""
    whole = lambda x: F.floor(x).cast("long").cast("string")
    return F.when(ms < 1000, F.concat(whole(ms), F.lit("ms"))).when(ms < 60000, F.concat(whole(ms / 1000), F.lit("s"))).otherwise(F.concat(whole(ms / 60000), F.lit("min")))
