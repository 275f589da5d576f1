"""Streams that run to their end and return what they wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from causeway.operators import asof as A
from causeway.operators.joins import numbered
from causeway.plans.registry import oracle, query, table  # noqa: F401
from causeway.sources import transfers as T
from causeway.sources.store import cut
from causeway.streaming import replay as R


def folder(spark) -> str:
    cut(spark.range(1))  # a checkpoint folder exists
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


@query("SELECT epoch_us(ts) // 86400000000 AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, sf_dir):
    base, events = folder(spark), table(spark, sf_dir, "events")
    events.repartition(4, "event_id").write.parquet(f"{base}/in")
    name = f"daily_{uuid.uuid4().hex}"
    counts = R.daily_counts(R.files_as_stream(spark, f"{base}/in", events.schema, 4), "60 days")
    q = counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.expr("unix_micros(window.start) div 86400000000").alias("day"), "event_type", "n")


def windowed(tx):
    return tx.select("row_id", A.sum_before(F.lit(1), ["src"], 1440).alias("u_out_cnt"), A.sum_before(F.col("usd_c"), ["dst"], 4320).alias("v_in_sum"))


@query("SELECT row_id, count(*) OVER (PARTITION BY src ORDER BY minute RANGE BETWEEN 1440 PRECEDING AND 1 PRECEDING) AS u_out_cnt, coalesce(CAST(sum(usd_c) OVER (PARTITION BY dst ORDER BY minute RANGE BETWEEN 4320 PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS v_in_sum FROM tx")
def stream_equals_batch(spark, sf_dir):
    """Five days a micro-batch, as many as the table has, stopped after every second batch and started again; the result is the batch query's."""
    base = folder(spark)
    tx = numbered(T.transfers(spark, sf_dir).drop("ts"), [F.col("minute"), F.col("row_id")])
    tx = cut(tx)
    batches = -(-(tx.agg(F.max("day")).first()[0] or 0) // 5)
    for k in range(batches):
        tx.where(F.col("day").between(5 * k + 1, 5 * k + 5)).coalesce(1).write.mode("append").parquet(f"{base}/in")
        if k % 2 or k == batches - 1:  # a run sees two files at most
            source = R.files_as_stream(spark, f"{base}/in", tx.schema)
            R.score_stream(source, f"{base}/history", f"{base}/out", f"{base}/check", windowed, 4320).awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("SELECT row_id, src, dst, payment_format, round(amount_usd, 6) AS amount_usd FROM tx")
def wire_round_trip(spark, sf_dir):
    tx = T.transfers(spark, sf_dir).withColumn("rank", F.col("row_id"))
    return R.decode(R.encode(tx)).select("row_id", "src", "dst", "payment_format", F.round("amount_usd", 6).alias("amount_usd"))
