"""Joins on intervals of time as equi-joins on buckets, and as-of top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], at: str, of: str, low: int, high: int, how: str = "inner", condition: Column | None = None) -> DataFrame:
    """Rows of left and right with equal keys and low <= right.of - left.at <= high.

    Time is cut into buckets as wide as the interval. A left row goes to the bucket of at + low and the next
    one, a right row to its own, so each pair meets exactly once, and a key's rows are spread over its
    buckets. Columns of both sides must have different names. how: inner, left_semi or left_anti.
    """
    width = max(high - low + 1, 1)
    bucket = F.expr(f"cast(floor((`{at}` + {low}) / {width}) as bigint)")
    a = left.withColumn("_bucket", F.explode(F.array(bucket, bucket + 1)))
    b = right.withColumn("_of_bucket", F.expr(f"cast(floor(`{of}` / {width}) as bigint)"))
    on = (F.col("_bucket") == F.col("_of_bucket")) & (F.col(of) - F.col(at)).between(low, high)
    for x, y in keys:
        on &= F.col(x) == F.col(y)
    if condition is not None:
        on &= condition
    if how == "inner":
        return a.join(b, on).drop("_bucket", "_of_bucket")
    # a left row stands in two buckets: it is in if either copy is
    found = a.join(b, on, "left_semi").drop("_bucket").distinct()
    return found if how == "left_semi" else left.exceptAll(found)


def newest(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in an order that has no ties."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_n", n).where(F.col("_n") <= k).drop("_n")


def _placed(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """df sorted by range and written, with _p, its rows' partition."""
    from causeway.sources.store import cut

    by = [F.col(c) if isinstance(c, str) else c for c in order]
    return cut(df.orderBy(*by).withColumn("_p", F.spark_partition_id()))


def running(df: DataFrame, order: list[str | Column], sums: dict[str, str]) -> DataFrame:
    """df with running sums, {name: column}, in a total order over the whole table, each row's own value included. Rows are sorted by range; each
    partition sums its own rows, and only one row of totals for each partition meets in one place."""
    rows = _placed(df, order)
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    totals = rows.groupBy("_p").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("_p").alias("_q"), *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_t_{n}") for n in sums))
    inside = Window.partitionBy("_p").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(F.broadcast(totals), F.col("_p") == F.col("_q"))  # a row for each partition
    rows = rows.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_t_{n}") for n, c in sums.items()})
    return rows.drop("_p", "_q", *(f"_t_{n}" for n in sums))


def lagged(df: DataFrame, order: list[str | Column], value: str, name: str) -> DataFrame:
    """df with the value of the row before in a total order over the whole table; null for the first. One row for each partition, its last, meets
    in one place."""
    rows = _placed(df, order)
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    inside = Window.partitionBy("_p").orderBy(*by)
    ends = rows.groupBy("_p").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*by)).alias("_last"))
    ends = ends.select(F.col("_p").alias("_q"), F.lag("_last").over(Window.orderBy("_p")).alias("_last"))
    rows = rows.withColumn("_n", F.row_number().over(inside)).join(F.broadcast(ends), F.col("_p") == F.col("_q"))  # a row for each partition
    rows = rows.withColumn(name, F.when(F.col("_n") == 1, F.col("_last.v")).otherwise(F.lag(value).over(inside)))
    return rows.drop("_p", "_q", "_n", "_last")


def running_before(sums: DataFrame, points: DataFrame, at: str, upto: str) -> DataFrame:
    """points: (at). The running sum `upto` of the last row of sums at or before each point as `before`; 0 if there is none."""
    both = sums.select(F.col(at), F.col(upto).alias("_v"), F.lit(0).alias("_point")).unionByName(points.select(F.col(at), F.lit(0).cast("long").alias("_v"), F.lit(1).alias("_point")))
    rows = _placed(both, [at, "_point"])
    inside = Window.partitionBy("_p").orderBy(at, "_point").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy("_p").agg(F.max("_v").alias("_m"))  # running sums don't fall
    ends = ends.select(F.col("_p").alias("_q"), F.coalesce(F.max("_m").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_m"))
    rows = rows.join(F.broadcast(ends), F.col("_p") == F.col("_q"))  # a row for each partition
    return rows.withColumn("before", F.greatest(F.max("_v").over(inside), F.col("_m"))).where("_point = 1").select(at, "before")


def last_before(rows: DataFrame, nodes: DataFrame, k: int, window: int | None = None) -> DataFrame:
    """rows: (at, t, row_id, ...); nodes: (case_id, node, minute). Of each node the newest k rows at it in [minute - window, minute - 1], or before
    minute if window is None; of equal minutes the highest row_id first.

    Rows are numbered within their place and minutes looked up as numbers, so a node asks for just the numbers of its k rows: the join is
    by (place, number) and never meets the rows of a busy place before them."""
    from causeway.sources.store import written

    by_minute = rows.groupBy("at", "t").agg(F.count("*").alias("_n"))
    ask = nodes.select(F.col("node").alias("at"), F.col("minute").alias("t")).distinct()
    asked = ask.withColumn("_end", F.lit(True))
    line = by_minute.withColumn("_end", F.lit(False))
    if window is not None:
        asked = asked.unionByName(ask.select("at", (F.col("t") - window).alias("t"), F.lit(True).alias("_end")))
    line = line.unionByName(asked.distinct(), allowMissingColumns=True)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("at").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    line = written(line.withColumn("_before", before))
    counts = line.where("_end").select(F.col("at").alias("node"), F.col("t").alias("minute"), "_before").distinct()
    asks = nodes.join(counts.withColumnRenamed("_before", "_upto"), ["node", "minute"])
    if window is None:
        asks = asks.withColumn("_low", F.lit(0).cast("long"))
    else:
        asks = asks.join(counts.select("node", (F.col("minute") + window).alias("minute"), F.col("_before").alias("_low")), ["node", "minute"])
    asks = asks.withColumn("_from", F.greatest("_low", F.col("_upto") - k) + 1).where("_from <= _upto")
    asks = asks.withColumn("_number", F.explode(F.sequence("_from", "_upto"))).drop("_low", "_upto", "_from")
    # a row's number: those of earlier minutes, and its place among its own minute's rows
    starts = line.where(~F.col("_end")).select("at", "t", "_before")
    place = F.row_number().over(Window.partitionBy("at", "t").orderBy("row_id"))
    numbered = rows.withColumn("_place", place).join(starts, ["at", "t"]).withColumn("_number", F.col("_before") + F.col("_place")).drop("_before", "_place")
    return asks.join(numbered, (F.col("node") == F.col("at")) & (asks["_number"] == numbered["_number"])).drop("_number", "at")


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds 0, 1, ... in a total order. Rows are sorted by range; only one number for each partition meets in one
    place, never the rows, so this holds for tables that a window without partitions couldn't sort."""
    from causeway.sources.store import cut

    rows = cut(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_p", before.alias("_before"))
    return rows.join(F.broadcast(sizes), part == F.col("_p")).withColumn(name, F.col("_before") + place).drop("_m", "_p", "_before")
