"""Named queries and, where SQL can express them, their oracles for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from causeway.sources import transfers as T

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(text: str) -> str:
    """DuckDB SQL over the tables and, if it names them, tx, lab and sc."""
    if not re.search(r"\b(tx|lab|sc)\b", text):
        return text
    return f"WITH {T.SQL}, {text[5:]}" if text.lstrip()[:5].upper() == "WITH " else f"WITH {T.SQL}\n{text}"


def query(sql: str | None = None, name: str | None = None):
    """Registers f(spark, sf_dir); sql is its oracle."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = oracle(sql.strip())
        return f

    return add


def on_transfers(sql: str | None = None, name: str | None = None):
    """Registers f(tx), over the transfers."""

    def add(f):
        query(sql, name or f.__name__)(lambda spark, sf_dir: f(T.transfers(spark, sf_dir)))
        return f

    return add


def both(name: str, sql: str) -> None:
    """One text that both engines run: // is integer division."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = sql
        if re.search(r"\b(tx|lab|sc)\b", sql):
            tx = T.transfers(spark, sf_dir)
            tx.createOrReplaceTempView("tx")
            T.labels(tx).createOrReplaceTempView("lab")
            tx.select("row_id", T.score(tx.row_id).alias("score")).createOrReplaceTempView("sc")
        for t in TABLES:
            if re.search(rf"\b{t}\b", sql):
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text.replace("//", " div "))

    query(sql, name)(run)
