"""The transfer table over the driver's event stream, and labels for it.

A transfer is an event: its user pays the account in its props. Currencies, banks and labels, which the
stream lacks, are fixed functions of the event's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import scalars as S

DAY = 1440
#: Inclusive ranges of days.
SPLITS = {"train": (1, 18), "val_early": (19, 21), "val_late": (22, 24), "test": (25, 30)}


def split_of(day: Column, splits: dict[str, tuple[int, int]] = SPLITS) -> Column:
    check_splits(splits)
    out = F.lit(None).cast("string")
    for name, (a, b) in splits.items():
        out = F.when(day.between(a, b), F.lit(name)).otherwise(out)
    return out


def check_splits(splits: dict[str, tuple[int, int]]) -> None:
    """Ranges must not overlap, nor leave a day between them out."""
    days = sorted(splits.values())
    for (a, b), (c, _) in zip(days, days[1:]):
        if c <= b or c != b + 1:
            raise ValueError(f"days {a}-{b} and {c}-... overlap or leave a gap")


def from_events(events: DataFrame) -> DataFrame:
    """Columns row_id, ts, minute, day, split, src, dst, from_bank, to_bank, amounts, currencies, payment_format."""
    origin = events.agg(F.date_trunc("day", F.min(F.col("ts").cast("timestamp"))).alias("origin"))
    t = events.crossJoin(F.broadcast(origin))  # one row
    minute = F.expr("(unix_micros(cast(ts as timestamp)) - unix_micros(origin)) div 60000000")
    k = F.get_json_object("props", "$.k").cast("int")
    t = t.select(
        F.col("event_id").alias("row_id"),
        "ts",
        minute.alias("minute"),
        F.col("user_id").cast("int").alias("src"),
        k.alias("dst"),
        F.lpad((F.col("user_id") % 7).cast("string"), 3, "0").alias("from_bank"),
        F.lpad((k % 7).cast("string"), 3, "0").alias("to_bank"),
        (F.col("value") * 100.0).alias("amount_paid"),
        (F.col("value") * 25.0).alias("amount_usd"),
        F.element_at(F.array(F.lit("Euro"), F.lit("US Dollar"), F.lit("Yen")), (F.col("event_id") % 3 + 1).cast("int")).alias("payment_currency"),
        F.element_at(F.array(F.lit("Euro"), F.lit("US Dollar"), F.lit("Yen")), (F.floor(F.col("event_id") / 2) % 3 + 1).cast("int")).alias("receiving_currency"),
        F.col("event_type").alias("payment_format"),
    )
    t = t.withColumn("day", (F.expr("minute div 1440") + 1).cast("int")).withColumn("split", split_of(F.col("day")))
    return t.withColumns({"usd_c": S.cents(F.col("amount_usd")), "paid_c": S.cents(F.col("amount_paid")), "self_loop": F.col("src") == F.col("dst")})


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def labels(tx: DataFrame) -> DataFrame:
    """row_id, is_laundering, attempt_id, typology: positives in small attempts, kept apart from the transfers."""
    positive = F.col("row_id") % 97 == 0
    attempt = F.floor(F.col("row_id") / 485).cast("int")
    names = F.array(*(F.lit(n) for n in ("CYCLE", "FAN-IN", "FAN-OUT", "STACK")))
    in_attempt = positive & (F.col("row_id") % 2 == 0)
    return tx.select(
        "row_id",
        positive.cast("int").alias("is_laundering"),
        F.when(in_attempt, attempt).alias("attempt_id"),
        F.when(in_attempt, F.element_at(names, (attempt % 4 + 1).cast("int"))).alias("typology"),
    )


def score(row_id: Column) -> Column:
    """A fixed pseudo-score with ties that leans to positives; stands in for a model's."""
    return ((row_id * 7919) % 1000 + F.when(row_id % 97 == 0, 400).otherwise(0)) / 1400.0


#: The same tables in DuckDB's SQL, for the oracles; names tx and lab.
SQL = """tx0 AS (
 SELECT event_id AS row_id, ts,
  (epoch_us(ts) - epoch_us(date_trunc('day', (SELECT min(ts) FROM events)))) // 60000000 AS minute,
  CAST(user_id AS INTEGER) AS src, CAST(regexp_extract(props, '-?[0-9]+') AS INTEGER) AS dst,
  value * 100.0 AS amount_paid, value * 25.0 AS amount_usd,
  ['Euro','US Dollar','Yen'][CAST(event_id % 3 + 1 AS INTEGER)] AS payment_currency,
  ['Euro','US Dollar','Yen'][CAST((event_id // 2) % 3 + 1 AS INTEGER)] AS receiving_currency,
  event_type AS payment_format
 FROM events),
tx AS (
 SELECT *, lpad(CAST(src % 7 AS VARCHAR), 3, '0') AS from_bank, lpad(CAST(dst % 7 AS VARCHAR), 3, '0') AS to_bank,
  CAST(minute // 1440 + 1 AS INTEGER) AS day,
  CASE WHEN minute // 1440 + 1 BETWEEN 1 AND 18 THEN 'train' WHEN minute // 1440 + 1 BETWEEN 19 AND 21 THEN 'val_early'
       WHEN minute // 1440 + 1 BETWEEN 22 AND 24 THEN 'val_late' WHEN minute // 1440 + 1 BETWEEN 25 AND 30 THEN 'test' END AS split,
  CAST(round(amount_usd * 100) AS BIGINT) AS usd_c, CAST(round(amount_paid * 100) AS BIGINT) AS paid_c, src = dst AS self_loop
 FROM tx0),
lab AS (
 SELECT row_id, CAST(row_id % 97 = 0 AS INTEGER) AS is_laundering,
  CASE WHEN row_id % 97 = 0 AND row_id % 2 = 0 THEN CAST(row_id // 485 AS INTEGER) END AS attempt_id,
  CASE WHEN row_id % 97 = 0 AND row_id % 2 = 0 THEN ['CYCLE','FAN-IN','FAN-OUT','STACK'][CAST((row_id // 485) % 4 + 1 AS INTEGER)] END AS typology
 FROM tx),
sc AS (SELECT row_id, ((row_id * 7919) % 1000 + CASE WHEN row_id % 97 = 0 THEN 400 ELSE 0 END) / 1400.0::DOUBLE AS score FROM tx)"""
