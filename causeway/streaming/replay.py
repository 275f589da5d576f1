"""The features on a stream: micro-batches of whole minutes over a bounded history.

Each micro-batch sees the transfers that its windows can reach and no later ones, so what a batch query
computes for a transfer is what the stream computed when it arrived. Order is checked, not repaired:
a late or missing transfer stops the stream. A restart continues from the checkpoint, and the sink
writes no row twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from causeway.sources.store import append_new

#: The wire message's fields, in order.
MESSAGE = "v int, rank long, row_id long, minute long, src int, dst int, amount_usd double, amount_paid double, payment_format string, payment_currency string, receiving_currency string, from_bank string, to_bank string"
VERSION = 1


class OrderError(RuntimeError):
    """A transfer is late, or one is missing."""


def encode(tx: DataFrame) -> DataFrame:
    """(key, value) messages: the decimal row_id and JSON with the fields of MESSAGE."""
    names = [f.split()[0] for f in MESSAGE.split(", ")]
    return tx.withColumn("v", F.lit(VERSION)).select(F.col("row_id").cast("string").alias("key"), F.to_json(F.struct(*names)).alias("value"))


def decode(messages: DataFrame) -> DataFrame:
    """Transfers of messages; one of another version, or that lacks a field, raises."""
    m = messages.select(F.from_json("value", MESSAGE, {"mode": "FAILFAST"}).alias("m"), "value")
    whole = F.col("m.v") == VERSION
    for f in MESSAGE.split(", "):
        whole &= F.col(f"m.{f.split()[0]}").isNotNull()
    checked = F.when(whole, F.col("m")).otherwise(F.raise_error(F.concat(F.lit("bad message "), F.col("value"))))
    return m.select(checked.alias("m")).select("m.*").drop("v")


def check_order(batch: DataFrame, clock: tuple[int, int] | None) -> tuple[int, int]:
    """clock: the last (rank, minute). The batch must go on with the next rank, without gaps, and never back in time."""
    from pyspark.sql import Window

    back = F.col("minute") < F.lag("minute").over(Window.orderBy("rank"))
    r = batch.withColumn("_back", back).agg(F.min("rank"), F.max("rank"), F.count("*"), F.min("minute"), F.max("minute"), F.count_if("_back")).first()
    first, last, n, start, end, wrong = r
    if last - first + 1 != n or (clock and first != clock[0] + 1):
        raise OrderError(f"ranks {first} to {last} hold {n} transfers after {clock}")
    if wrong or (clock and start <= clock[1]):
        raise OrderError(f"minute {start} after {clock}: late, or a minute came in two batches")
    return last, end


def score_stream(source: DataFrame, history: str, out: str, checkpoint: str, features: Callable[[DataFrame], DataFrame], reach: int) -> StreamingQuery:
    """source: a streaming DataFrame of transfers with rank and minute, whole minutes a batch. history and out are Parquet
    folders. features(transfers) gives one row per row_id; reach: minutes that its windows look back.
    Features over a whole lifetime need reach to cover it."""

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            try:
                past = spark.read.parquet(history)
            except Exception as missing:
                if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER" not in str(missing):
                    raise
                past = batch.limit(0)
            past = past.join(batch.select("row_id"), "row_id", "left_anti")  # of a batch that is run again
            last = past.agg(F.max("rank"), F.max("minute")).first()
            check_order(batch, tuple(last) if last[0] is not None else None)
            start = batch.agg(F.min("minute")).first()[0]
            seen = past.where(F.col("minute") >= start - reach).unionByName(batch)
            append_new(features(seen).join(batch.select("row_id"), "row_id", "left_semi"), out)
            append_new(batch, history)
        finally:
            batch.unpersist()

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(source: DataFrame, watermark: str = "1 minute") -> DataFrame:
    """source: a streaming DataFrame with ts and event_type. Events of each day and type."""
    return source.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", watermark).groupBy(F.window("t", "1 day"), "event_type").agg(F.count("*").alias("n"))


def files_as_stream(spark: SparkSession, folder: str, schema, files_a_batch: int = 1) -> DataFrame:
    """Files in order of their time, some a batch: a replay without a broker."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def kafka_source(spark: SparkSession, servers: str, topic: str, offsets: str = "earliest", most: int | None = None) -> DataFrame:
    """Messages of a topic, with headers; needs Spark's Kafka package on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", offsets).option("includeHeaders", "true")
    reader = reader.option("maxOffsetsPerTrigger", most) if most else reader
    return reader.load().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "partition", "offset", "headers")
