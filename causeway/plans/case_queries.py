"""Cases: packs, narratives, examples, the search for decision-list thresholds, sampling and load plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.operators import evaluate as E
from causeway.operators import graph as G
from causeway.operators import rules as R
from causeway.plans.exploration_queries import cases
from causeway.plans.feature_queries import SEVERITIES
from causeway.plans.registry import both, on_transfers
from causeway.sources import transfers as T

both("narrative", "SELECT row_id, concat('Account ', CAST(src AS VARCHAR(12)), ' paid account ', CAST(dst AS VARCHAR(12)), ' by ', payment_format, ' on day ', CAST(day AS VARCHAR(12)), CASE WHEN self_loop THEN ' (itself)' ELSE '' END, '.') AS line FROM tx")
both("negative_sample", "SELECT row_id FROM tx JOIN lab USING (row_id) WHERE is_laundering = 0 AND split = 'train' ORDER BY md5(concat(CAST(row_id AS VARCHAR(20)), ':1')), row_id LIMIT 500")
both("case_keys", "SELECT src AS case_key, count(*) AS alerts, max(row_id) AS newest FROM tx JOIN sc USING (row_id) WHERE score >= 0.7 GROUP BY src")
both("alert_lookup", "SELECT row_id, src, dst, usd_c FROM tx JOIN sc USING (row_id) WHERE row_id = (SELECT max(row_id) FROM sc WHERE score >= 0.9)")
both("label_guard", "SELECT split, count(*) AS visible FROM tx JOIN lab USING (row_id) WHERE split IN ('train', 'val_early') GROUP BY split")
both("majority_baseline", "SELECT round(max(n) / CAST(sum(n) AS DOUBLE), 9) AS majority, count(*) AS classes FROM (SELECT typology, count(*) AS n FROM lab WHERE typology IS NOT NULL GROUP BY typology) t")
both("seed_pairs", "SELECT a.row_id % 5 AS seed, round(avg(a.score - b.score), 9) + 0.0 AS diff, count(*) AS n FROM sc a JOIN sc b ON b.row_id = a.row_id + 1 GROUP BY a.row_id % 5")

@on_transfers("WITH p AS (SELECT split, min(row_id) AS lo, max(row_id) AS hi FROM tx WHERE split IN ('val_late', 'test') GROUP BY split) SELECT count(*) AS off_plan FROM tx LEFT JOIN p ON tx.row_id BETWEEN p.lo AND p.hi WHERE p.split IS NULL")
def off_plan(tx):
    """Transfers outside the ranges of a load plan: ranges that touch are one, so each row needs only the last that begins before it."""
    plan = tx.where("split in ('val_late', 'test')").groupBy("split").agg(F.min("row_id").alias("lo"), F.max("row_id").alias("hi"))
    return tx.select("row_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(E.covered(tx, plan, "row_id").agg(F.count("*").alias("inside")))).select((F.col("n") - F.col("inside")).alias("off_plan"))


GRID = [(a, b, c) for a in (3, 5, 7) for b in (3, 5, 7) for c in (0.5, 0.9)]


@on_transfers(SEVERITIES + ", g AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(GRID)) + """) v(i, fan_out, fan_in, pass)),
 m AS (SELECT i, CASE WHEN round_trip >= 1 THEN 'CYCLE' WHEN fan_out_velocity >= fan_out THEN 'FAN-OUT' WHEN fan_in_velocity >= fan_in THEN 'FAN-IN' WHEN rapid_pass_through >= pass THEN 'STACK' ELSE 'OTHER' END = typology AS hit FROM sev JOIN lab USING (row_id), g WHERE typology IS NOT NULL)
 SELECT CAST(i AS INTEGER) AS i, count_if(hit) AS correct FROM m GROUP BY i ORDER BY count_if(hit) DESC, i LIMIT 1""")
def grid_search(tx):
    """The first best thresholds of the decision list: labelled rows times a grid of fixed size, summed before any shuffle."""
    s = R.severities(tx).join(T.labels(tx).where("typology is not null"), "row_id")
    points = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("fan_out"), F.lit(b).alias("fan_in"), F.lit(c).alias("pass")) for i, (a, b, c) in enumerate(GRID)))
    s = s.withColumn("g", F.explode(points))
    label = F.when(F.col("round_trip") >= 1, "CYCLE").when(F.col("fan_out_velocity") >= F.col("g.fan_out"), "FAN-OUT").when(F.col("fan_in_velocity") >= F.col("g.fan_in"), "FAN-IN").when(F.col("rapid_pass_through") >= F.col("g.pass"), "STACK").otherwise("OTHER")
    return s.groupBy(F.col("g.i").alias("i")).agg(F.count_if(label == F.col("typology")).alias("correct")).orderBy(F.desc("correct"), "i").limit(1)


@on_transfers()
def case_packs(tx):
    """Who, what and where of each case as one JSON document, with its subgraph's transfers."""
    edges = G.case_subgraph(tx, cases(tx)).join(tx.select("row_id", "src", "dst", "usd_c", "minute"), "row_id")
    where = edges.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("minute", "row_id", "src", "dst", "usd_c"))).alias("edges"))
    who = tx.where(T.score(F.col("row_id")) >= 0.7).select(F.col("row_id").alias("case_id"), F.struct("src", "dst", "from_bank", "to_bank").alias("who"), F.struct("usd_c", "payment_format").alias("what"), F.struct("day", "minute").alias("when"))
    return who.join(where, "case_id", "left").select("case_id", F.to_json(F.struct("who", "what", "when", F.col("edges").alias("where"))).alias("pack"))
