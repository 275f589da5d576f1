"""Column expressions of the transfer domain."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Logarithms are summed as whole multiples of 2^-30, so windowed sums don't depend on their order.
LOG_UNIT = 1 << 30


def cents(amount: Column) -> Column:
    """Whole cents, halves away from zero."""
    return F.round(amount * 100).cast("long")


def is_round(paid_c: Column, unit: int = 1000) -> Column:
    """A positive whole multiple of `unit` hundredths of a cent amount."""
    return (paid_c > 0) & (paid_c % unit == 0)


def in_band(usd: Column, low: float, high: float) -> Column:
    """Just below a reporting limit."""
    return (usd >= low) & (usd < high)


def code_in(value: Column, vocabulary: list[str]) -> Column:
    """Place in the vocabulary; -1 for an unknown or null value."""
    return F.coalesce(F.array_position(F.array(*(F.lit(v) for v in vocabulary)), value) - 1, F.lit(-1)).cast("int") if vocabulary else F.lit(-1)


def log_amount(usd: Column) -> Column:
    return F.log1p(usd)


def units(x: Column) -> Column:
    return F.round(x * LOG_UNIT).cast("long")


def capped_gap(minute: Column, last: Column, cap: int) -> Column:
    """Minutes since the last earlier event, at most cap; 0 for none."""
    return F.when(last.isNull(), F.lit(0)).otherwise(F.least(minute - last, F.lit(cap))).cast("long")


def window_tag(minutes: int) -> str:
    """1440 -> 1d, 720 -> 12h, 45 -> 45m."""
    return f"{minutes // 1440}d" if minutes % 1440 == 0 and minutes else f"{minutes // 60}h" if minutes % 60 == 0 and minutes else f"{minutes}m"


def rate_tag(rate: float) -> str:
    """0.005 -> 0p005."""
    return f"{rate:g}".replace(".", "p")


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def interpolate(x: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise-linear through points in ascending x; flat outside them."""
    out = F.lit(float(points[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:]))):
        out = F.when(x < x1, F.lit(float(y0)) + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x <= points[0][0], F.lit(float(points[0][1]))).otherwise(out)


def decision_tree(tree: dict) -> Column:
    """A tree of {feature, threshold, left, right} with {label} leaves as nested conditions; a missing value goes left."""
    if "label" in tree:
        return F.lit(tree["label"])
    left = F.coalesce(F.col(tree["feature"]) <= tree["threshold"], F.lit(True))
    return F.when(left, decision_tree(tree["left"])).otherwise(decision_tree(tree["right"]))


def decision_list(rules: list[tuple[str, Column]], default: str) -> Column:
    """The label of the first rule that holds; one that is null doesn't."""
    out = F.lit(default)
    for label, condition in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(label)).otherwise(out)
    return out
