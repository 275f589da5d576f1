"""Reading and writing: raw CSV, pattern files, Parquet tables, digests, idempotent sinks, cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The raw log's header, in order; one name stands twice.
RAW_HEADER = ["Timestamp", "From Bank", "Account", "To Bank", "Account", "Amount Received", "Receiving Currency", "Amount Paid", "Payment Currency", "Payment Format", "Is Laundering"]
RAW_COLUMNS = ["timestamp", "from_bank", "from_account", "to_bank", "to_account", "amount_received", "receiving_currency", "amount_paid", "payment_currency", "payment_format", "is_laundering"]
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
TIME_FORMAT = "yyyy/MM/dd HH:mm"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names. Only a session on a local master gets a temporary one; on a cluster, where
    executors wouldn't see it, a missing setting raises."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="causeway-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df from the shared checkpoint folder, written once; the cluster's own folder if it names one."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df from Parquet files in the shared folder, written once: whoever reads it takes only the columns and rows that it needs."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).first()
    return [c.strip() for c in first[0].lstrip("﻿").rstrip("\r").split(",")] if first else []


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """The raw log, every column a string: bank codes keep their zeros and ids that look like numbers stay ids; an
    empty field is '' and not null. Adds row_id, the place in the file. A line with another number of fields raises. The header must be the known one."""
    if (header := read_header(spark, path)) != RAW_HEADER:
        raise ValueError(f"unknown header {header}")
    # a header line is not skipped but known by its place, so files need no option that depends on their split
    rows = spark.read.csv(path, schema=RAW_SCHEMA, header=False, mode="FAILFAST", encoding="UTF-8").na.fill("")
    from causeway.operators.joins import numbered

    placed = numbered(rows.withColumns({"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()}), [F.col("_file"), F.col("_start"), F.col("_id")], "row_id")
    return placed.where("row_id > 0").withColumn("row_id", F.col("row_id") - 1).drop("_file", "_start", "_id")


def parsed(raw: DataFrame) -> DataFrame:
    """Typed columns; a value that doesn't parse raises (ANSI casts)."""
    return raw.select("row_id", F.to_timestamp_ntz("timestamp", F.lit(TIME_FORMAT)).alias("ts"), "from_bank", "from_account", "to_bank", "to_account", F.col("amount_received").cast("double").alias("amount_received"), "receiving_currency", F.col("amount_paid").cast("double").alias("amount_paid"), "payment_currency", "payment_format", F.col("is_laundering").cast("int").alias("is_laundering"))


BEGIN = r"^BEGIN LAUNDERING ATTEMPT - ([A-Z-]+)(?::\s*(.*))?$"
END = r"^END LAUNDERING ATTEMPT - ([A-Z-]+)"


#: The typologies that a pattern file may name.
TYPOLOGIES = "FAN-OUT FAN-IN CYCLE GATHER-SCATTER SCATTER-GATHER STACK BIPARTITE RANDOM".split()


def pattern_errors(lines: DataFrame) -> DataFrame:
    """(line_no, error) of what is wrong with a pattern file: an unknown typology, a block begun within another or never ended, an end without
    its beginning or of another typology, a transfer line outside a block or with another number of fields."""
    line = F.trim(F.regexp_replace(F.regexp_replace("line", "\r$", ""), "^\ufeff", ""))
    t = lines.select("line_no", line.alias("line")).where("line <> ''")
    begun, ended = F.regexp_extract("line", BEGIN, 1), F.regexp_extract("line", END, 1)
    t = t.withColumns({"kind": F.when(F.col("line").startswith("BEGIN"), "begin").when(F.col("line").startswith("END"), "end").otherwise("row"), "name": F.when(F.col("line").startswith("BEGIN"), begun).otherwise(ended)})
    order = Window.orderBy("line_no")  # one small file
    marks = t.where("kind <> 'row'").withColumns({"kind0": F.lag("kind").over(order), "name0": F.lag("name").over(order), "next": F.lead("kind").over(order)})
    error = (
        F.when(~F.col("name").isin(*TYPOLOGIES), "unknown typology")
        .when((F.col("kind") == "begin") & (F.col("kind0") == "begin"), "begins within a block")
        .when((F.col("kind") == "end") & (F.coalesce("kind0", F.lit("")) != "begin"), "ends no block")
        .when((F.col("kind") == "end") & (F.col("name") != F.col("name0")), "ends another typology")
        .when((F.col("kind") == "begin") & F.col("next").isNull(), "never ends")
    )
    inside = F.last(F.when(F.col("kind") != "row", F.col("kind")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = t.withColumn("inside", inside).where("kind = 'row'")
    wrong = F.when(F.coalesce("inside", F.lit("end")) == "end", "outside a block").when(F.size(F.split("line", ",", -1)) != len(RAW_COLUMNS), "wrong number of fields")
    return marks.select("line_no", error.alias("error")).unionByName(rows.select("line_no", wrong.alias("error"))).where("error is not null")


def pattern_rows(lines: DataFrame) -> DataFrame:
    """lines: (line_no, line) of a pattern file. (attempt_id, typology, detail, line_no, and the raw columns) of each
    transfer line: its block is the number of BEGIN lines so far. Byte order marks and CRs are dropped.
    A file with an error (see pattern_errors) raises, with the first one's line."""
    if bad := pattern_errors(lines).orderBy("line_no").limit(1).collect():
        raise ValueError(f"line {bad[0].line_no}: {bad[0].error}")
    line = F.regexp_replace(F.regexp_replace("line", "\r$", ""), "^﻿", "")
    t = lines.select("line_no", F.trim(line).alias("line")).withColumns({"begin": F.col("line").rlike(BEGIN), "end": F.col("line").rlike(END)})
    running = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)  # one small file
    t = t.withColumns({"block": F.sum(F.col("begin").cast("int")).over(running), "ended": F.sum(F.col("end").cast("int")).over(running)})
    head = F.when(F.col("begin"), F.struct(F.regexp_extract("line", BEGIN, 1).alias("typology"), F.nullif(F.regexp_extract("line", BEGIN, 2), F.lit("")).alias("detail")))
    t = t.withColumn("head", F.last(head, ignorenulls=True).over(running))
    t = t.where("not begin and not end and line <> ''")
    field = F.split("line", ",", -1)
    inside = F.when(F.col("block") == F.col("ended") + 1, F.col("block") - 1).otherwise(F.raise_error(F.concat(F.lit("outside a block: line "), F.col("line_no").cast("string"))))
    return t.select(inside.cast("int").alias("attempt_id"), "head.typology", "head.detail", "line_no", *(F.trim(F.get(field, i)).alias(c) for i, c in enumerate(RAW_COLUMNS)))


def attempt_labels(raw: DataFrame, patterns: DataFrame) -> DataFrame:
    """row_id, is_laundering, attempt_id, typology: pattern lines meet the positives that are equal in all raw
    columns, the first with the first and so on."""
    keys = RAW_COLUMNS
    nth = lambda df, order: df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    positives = nth(raw.where("is_laundering = '1'"), "row_id").select("row_id", *keys, "_nth")
    marks = nth(patterns, "line_no").select(*keys, "_nth", "attempt_id", "typology")
    found = positives.join(marks, [*keys, "_nth"], "left").select("row_id", "attempt_id", "typology")
    return raw.join(found, "row_id", "left").select("row_id", F.col("is_laundering").cast("int").alias("is_laundering"), "attempt_id", "typology")


def accounts(tx: DataFrame) -> DataFrame:
    """account_id (dense, by bank then account), bank, account of every end of a transfer."""
    from causeway.operators.joins import numbered

    ends = tx.select(F.col("from_bank").alias("bank"), F.col("from_account").alias("account")).union(tx.select("to_bank", "to_account")).distinct()
    return numbered(ends, [F.col("bank"), F.col("account")], "account_id").withColumn("account_id", F.col("account_id").cast("int"))


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet with zstd, by partition if named; Spark's committer makes the new files visible all at once."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """One JSON object a line, by partition if named; nulls are left out. Files become visible all at once."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """A line that is no object of the schema raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def digest(df: DataFrame) -> DataFrame:
    """One row that identifies a table whatever its order: row count, and two folds of the rows' hashes."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("folded"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("summed"))


def append_new(batch: DataFrame, path: str, key: str = "row_id") -> None:
    """An idempotent sink: rows whose key the table at path already has are not written again."""
    spark = batch.sparkSession
    batch = batch.dropDuplicates([key])
    try:
        batch = batch.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as missing:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER" not in str(missing):
            raise
    cut(batch).write.mode("append").parquet(path)
