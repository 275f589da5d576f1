"""Ranking metrics, operating points, attempts and drift, as aggregations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.operators.joins import running


def tie_curve(scored: DataFrame) -> DataFrame:
    """scored: (score, y[, w]). One row per distinct score, highest first: threshold, n, tp, fp up to and including it. The
    running sums are over distinct scores, by range (joins.running): a model's scores may be as many as its rows."""
    w = F.col("w") if "w" in scored.columns else F.lit(1)
    ties = scored.groupBy(F.col("score").alias("threshold")).agg(F.sum(w).alias("_n"), F.sum(w * F.col("y")).alias("_pos"))
    sums = running(ties, [F.desc("threshold")], {"n": "_n", "tp": "_pos"})
    return sums.select("threshold", "n", "tp", (F.col("n") - F.col("tp")).alias("fp"), "_n", "_pos")


def _with_before(curve: DataFrame) -> DataFrame:
    """Each row with the sums before it, which are its own less its tie's, and the totals."""
    total = curve.agg(F.max("tp").alias("p"), F.max("fp").alias("f"))
    return curve.crossJoin(F.broadcast(total)).withColumns({"tp0": F.col("tp") - F.col("_pos"), "fp0": F.col("fp") - (F.col("_n") - F.col("_pos"))})


def pr_auc(scored: DataFrame) -> DataFrame:
    """Average precision: precision at each step of recall. Null without positives."""
    c = _with_before(tie_curve(scored))
    return c.agg(F.sum(F.when(F.col("p") > 0, (F.col("tp") - F.col("tp0")) / F.col("p") * F.col("tp") / F.col("n"))).alias("pr_auc"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area by trapezoids; ties count half. Null without both classes."""
    c = _with_before(tie_curve(scored))
    return c.agg(F.sum(F.when((F.col("p") > 0) & (F.col("f") > 0), (F.col("fp") - F.col("fp0")) / F.col("f") * (F.col("tp") + F.col("tp0")) / F.col("p") / 2)).alias("roc_auc"))


def prf(flagged: DataFrame, flag: str = "flag") -> DataFrame:
    """alerts, tp, precision (null without alerts), recall and F1 (null without positives)."""
    a = flagged.agg(F.count_if(flag).alias("alerts"), F.count_if(F.col(flag) & (F.col("y") == 1)).alias("tp"), F.sum("y").alias("pos"))
    p = F.when(F.col("alerts") > 0, F.col("tp") / F.col("alerts"))
    r = F.when(F.col("pos") > 0, F.col("tp") / F.col("pos"))
    f1 = F.when(F.col("pos") > 0, 2 * F.col("tp") / (F.col("alerts") + F.col("pos")))
    return a.select("alerts", "tp", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def best_f1(scored: DataFrame) -> DataFrame:
    """The threshold of the greatest F1; of equal ones the highest."""
    c = _with_before(tie_curve(scored))
    f1 = 2 * F.col("tp") / (F.col("n") + F.col("p"))
    return c.agg(F.max(F.struct(f1.alias("f1"), "threshold")).alias("b")).select("b.threshold", "b.f1")


def budget(n: Column, rate: float) -> Column:
    return F.floor(F.lit(rate) * n + F.lit(1e-6))


def threshold_for_rate(scored: DataFrame, rate: float) -> DataFrame:
    """The least score whose ties still fit into the alert budget; null (never) if none does."""
    c = tie_curve(scored)
    total = c.agg(F.max("n").alias("total"))
    return c.crossJoin(F.broadcast(total)).agg(F.min(F.when(F.col("n") <= budget(F.col("total"), rate), F.col("threshold"))).alias("threshold"))


def top_k(scored: DataFrame, k: int, order: list[str]) -> DataFrame:
    """The k rows of highest score, ties by `order`; a bounded heap per task, no global sort."""
    return scored.orderBy(F.desc("score"), *order).limit(k)


def attempts(flagged: DataFrame) -> DataFrame:
    """flagged: (attempt_id, typology, minute, flag). Per attempt: size, detected, minutes from its first transfer to the first alert."""
    first, hit = F.min("minute"), F.min(F.when(F.col("flag"), F.col("minute")))
    return flagged.where("attempt_id is not null").groupBy("attempt_id", "typology").agg(F.count("*").alias("size"), F.max(F.col("flag").cast("int")).alias("detected"), (hit - first).alias("delay"))


def psi(base: DataFrame, now: DataFrame, column: str, bins: int = 10, smooth: float = 1e-4) -> DataFrame:
    """Population stability index over the base's exact quantile bins."""
    edges = base.agg(F.sort_array(F.array_distinct(F.array(*(F.expr(f"percentile_disc({i / bins}) within group (order by {column})") for i in range(1, bins))))).alias("edges"))
    place = F.size(F.filter("edges", lambda e: e < F.col(column)))

    def counts(df, name):
        return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(place.alias("bin")).agg(F.count("*").alias(name))

    c = counts(base, "a").join(counts(now, "b"), "bin", "full")
    total = c.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    share = lambda x, n: F.greatest(F.coalesce(F.col(x), F.lit(0)) / F.col(n), F.lit(smooth))
    c = c.crossJoin(F.broadcast(total)).select((share("b", "nb") - share("a", "na")).alias("d"), F.log(share("b", "nb") / share("a", "na")).alias("r"))
    return c.agg(F.sum(F.col("d") * F.col("r")).alias("psi"))


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """ranges: (grp, lo, hi), inclusive. Ranges that overlap or touch become one."""
    w = Window.partitionBy("grp").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = ranges.withColumn("_new", F.when(F.col("lo") <= reach + 1, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w))
    return r.groupBy("grp", "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


#: Clusters that a bootstrap holds in each task: their sums are broadcast.
MAX_CLUSTERS = 2_000_000


def bootstrap(clusters: DataFrame, values: list[str], replicates: int, seed: int) -> DataFrame:
    """clusters: (stratum, cluster, values...). Sums of the values, as (replicate, values...), in each replicate of a stratified cluster
    bootstrap: of each stratum as many clusters as it has are drawn with replacement. All values of a cluster are drawn together, so
    the columns of several models are paired.

    What is drawn are clusters, not rows: the rows are summed in Spark first, and the sums, whose number is checked, are broadcast; the
    replicates are dealt out. A replicate's draws depend on the seed and its number alone."""
    found = clusters.groupBy("stratum", "cluster").agg(*(F.sum(v).alias(v) for v in values)).orderBy("stratum", "cluster").limit(MAX_CLUSTERS + 1).toPandas()
    if len(found) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    spark = clusters.sparkSession
    shared = spark.sparkContext.broadcast([g[values].to_numpy(float) for _, g in found.groupby("stratum", sort=True, dropna=False)])
    schema = pa.schema([("replicate", pa.int64()), *((v, pa.float64()) for v in values)])

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0).to_numpy(), []
            for r in ids.tolist():
                random = np.random.Generator(np.random.PCG64([seed, r]))
                total = np.zeros(len(values))
                for part in shared.value:
                    total += np.bincount(random.integers(0, len(part), len(part)), minlength=len(part)) @ part
                out.append(total)
            sums = np.array(out).reshape(-1, len(values))
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(sums[:, k]) for k in range(len(values)))], schema=schema)

    return spark.range(replicates).mapInArrow(run, ", ".join(["replicate long", *(f"{v} double" for v in values)]))


def interval(values: DataFrame, column: str, level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    return values.agg(F.percentile(column, a).alias("low"), F.percentile(column, 1 - a).alias("high"))


def covered(rows: DataFrame, ranges: DataFrame, at: str) -> DataFrame:
    """The values `at` of rows that lie in one of ranges (lo, hi), inclusive. Ranges are merged, and both are sorted into one line, in which a
    running count of ranges begun less ranges ended tells who is inside: no row meets a range that it isn't near."""
    one = merged_ranges(ranges.select(F.lit(0).alias("grp"), "lo", "hi"))  # ranges are few
    line = rows.select(F.col(at).alias("_x"), F.lit(0).alias("_step"), F.lit(1).alias("_kind"))
    line = line.unionByName(one.select(F.col("lo").alias("_x"), F.lit(1).alias("_step"), F.lit(0).alias("_kind"))).unionByName(one.select(F.col("hi").alias("_x"), F.lit(-1).alias("_step"), F.lit(2).alias("_kind")))
    return running(line, ["_x", "_kind"], {"_open": "_step"}).where("_kind = 1 and _open > 0").select(F.col("_x").alias(at))


def mismatches(a: DataFrame, b: DataFrame, key: str, columns: list[str], tolerance: dict[str, float] | None = None) -> DataFrame:
    """Rows in which two tables differ: (key, side, differs). side: left or right for a key that the other lacks, both for one whose
    values differ; differs: the columns that do. Nulls equal nulls; a column with a tolerance may differ by that share of the greater value."""
    x = a.select(key, F.struct(*columns).alias("_a"))
    y = b.select(key, F.struct(*columns).alias("_b"))
    both = x.join(y, key, "full")

    def differs(c: str) -> Column:
        u, v = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        if (tolerance or {}).get(c):
            near = F.coalesce(F.abs(u - v) <= tolerance[c] * F.greatest(F.abs(u), F.abs(v)), F.lit(False))
            return ~(u.eqNullSafe(v) | near)
        return ~u.eqNullSafe(v)

    side = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both")
    names = F.array_compact(F.array(*(F.when(differs(c), F.lit(c)) for c in columns)))
    return both.select(key, side.alias("side"), names.alias("differs")).where("side <> 'both' or size(differs) > 0")


def parity(a: DataFrame, b: DataFrame, key: str, columns: list[str], tolerance: dict[str, float] | None = None) -> DataFrame:
    """One row: rows of a, keys that only one table has, and for each column the number of rows that differ in it."""
    m = mismatches(a, b, key, columns, tolerance)
    counts = m.agg(F.count_if(F.col("side") == "left").alias("only_left"), F.count_if(F.col("side") == "right").alias("only_right"), *(F.count_if((F.col("side") == "both") & F.array_contains("differs", c)).alias(f"{c}_differs") for c in columns))
    return a.agg(F.count("*").alias("n")).crossJoin(F.broadcast(counts))


def model_flags(scored: DataFrame, thresholds: dict[str, float | None]) -> DataFrame:
    """scored with alert_<tag> for each rate's tag: score at its threshold or over; never without a threshold or a score."""
    return scored.withColumns({f"alert_{tag}": F.coalesce(F.col("score") >= F.lit(t), F.lit(False)) if t is not None else F.lit(False) for tag, t in thresholds.items()})


def buckets(df: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """(le, n) of a cumulative histogram: how many values are at most each bound, and, at infinity, all that are not null. One pass."""
    edges = [*sorted(bounds), float("inf")]
    counts = F.array(*(F.struct(F.lit(e).alias("le"), F.count_if(F.col(column) <= e).alias("n")) for e in edges))
    return df.agg(counts.alias("b")).select(F.explode("b").alias("b")).select("b.*")
