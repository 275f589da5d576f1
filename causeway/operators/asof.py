"""As-of windows: an event in minute m sees events in minutes [m - W, m - 1] and nothing else.

Sums and counts over [m - W, m - 1] are the difference of two running sums, up to m - 1 and up to
m - W - 1: each row enters each sum once, however many rows a window holds, where a sliding frame
would add a window's rows again for every row. All values are integers, so differences are exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upto(by: list[str], last: int, minute: str = "minute"):
    """All rows of minutes up to the row's own plus `last`."""
    return Window.partitionBy(*by).orderBy(minute).rangeBetween(Window.unboundedPreceding, last)


def sliding(by: list[str], window: int, minute: str = "minute"):
    return Window.partitionBy(*by).orderBy(minute).rangeBetween(-window, -1)


def sum_before(value: Column, by: list[str], window: int | None, minute: str = "minute") -> Column:
    """Sum of an integer column over [m - window, m - 1]; over [.., m - 1] if window is None. Empty: 0."""
    now = F.coalesce(F.sum(value).over(upto(by, -1, minute)), F.lit(0))
    return now if window is None else now - F.coalesce(F.sum(value).over(upto(by, -window - 1, minute)), F.lit(0))


def last_before(by: list[str], value: str = "minute", minute: str = "minute") -> Column:
    return F.max(value).over(upto(by, -1, minute))


def distinct_steps(rows: DataFrame, key: str, other: str, windows: dict[str, int], minute: str = "minute") -> DataFrame:
    """(key, minute, step_<tag>, ...): the running sum of step_<tag>, up to and including minute m, is the number
    of distinct values of other in [m - W, m - 1]. Each value counts from the minute after it is seen
    until it leaves the window or is seen again, so the work is linear in the rows."""
    seen = rows.select(F.col(key), F.col(other), F.col(minute)).distinct()
    following = F.lead(minute).over(Window.partitionBy(key, other).orderBy(minute))
    seen = seen.withColumn("_next", following)
    tags = list(windows)
    steps = [F.struct((F.col(minute) + 1).alias("minute"), *(F.lit(1).alias(f"step_{t}") for t in tags))]
    for t in tags:
        leaves = F.least(F.col(minute) + windows[t], F.col("_next")) + 1  # least() passes over null
        steps.append(F.struct(leaves.alias("minute"), *(F.lit(-1 if s == t else 0).alias(f"step_{s}") for s in tags)))
    return seen.select(F.col(key), F.explode(F.array(*steps)).alias("s")).select(key, "s.*")


def union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def by_row(*parts: DataFrame, key: str = "row_id") -> DataFrame:
    """Columns that several passes computed for the same rows, side by side: one exchange, whatever the number of parts."""
    whole = union(*parts)
    return whole.groupBy(key).agg(*(F.max(c).alias(c) for c in whole.columns if c != key))
