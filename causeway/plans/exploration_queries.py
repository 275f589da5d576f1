"""Exploration, sizing, ETL and graph-neighbourhood queries over the transfers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from causeway.operators import graph as G
from causeway.operators import joins as J
from causeway.operators import validate as V
from causeway.plans.registry import both, on_transfers, query, table
from causeway.sources import store
from causeway.sources import transfers as T

COLUMNS = "row_id, minute, day, split, src, dst, from_bank, to_bank, round(amount_paid, 6) AS amount_paid, round(amount_usd, 6) AS amount_usd, usd_c, paid_c, payment_currency, receiving_currency, payment_format, self_loop"


both("tx_view", f"SELECT {COLUMNS} FROM tx")
both("scan_filter_project", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value >= 50 AND user_id < 100")
both("rank_range_scan", "SELECT event_id, event_type FROM events WHERE event_id BETWEEN 1000 AND 1999")
both("split_counts", "SELECT split, count(*) AS n, min(day) AS first_day, max(day) AS last_day, CAST(sum(is_laundering) AS BIGINT) AS positives FROM tx JOIN lab USING (row_id) GROUP BY split")
both("eda_overview", "SELECT count(*) AS n, min(minute) AS first_minute, max(minute) AS last_minute, count(DISTINCT src) AS senders, count(DISTINCT dst) AS receivers, count(DISTINCT payment_format) AS formats, CAST(sum(CAST(self_loop AS INTEGER)) AS BIGINT) AS self_loops FROM tx")
both("eda_per_day", "WITH d AS (SELECT day, count(*) AS n, CAST(sum(is_laundering) AS BIGINT) AS positives FROM tx JOIN lab USING (row_id) GROUP BY day) SELECT day, n, positives, n < 0.01 * (SELECT max(n) FROM d) OR positives >= 0.5 * n AS tail FROM d")
both("eda_rows_per_minute", "WITH m AS (SELECT minute, count(*) AS n FROM tx GROUP BY minute) SELECT count(*) AS occupied, max(n) AS most, percentile_disc(0.5) WITHIN GROUP (ORDER BY n) AS p50, percentile_disc(0.99) WITHIN GROUP (ORDER BY n) AS p99, round(avg(n), 9) AS mean FROM m")
both("eda_payment", "SELECT payment_format, payment_currency, count(*) AS n, count_if(is_laundering = 1) AS positives, count(*) FILTER (WHERE payment_currency <> receiving_currency) AS cross_currency, round(avg(amount_usd), 6) AS mean_usd FROM tx JOIN lab USING (row_id) GROUP BY payment_format, payment_currency")
both("eda_patterns", "SELECT typology, count(DISTINCT attempt_id) AS attempts, count(*) AS n, min(minute) AS first_minute FROM tx JOIN lab USING (row_id) WHERE attempt_id IS NOT NULL GROUP BY typology")
both("eda_top_degree", "WITH d AS (SELECT acct, count(*) AS deg FROM (SELECT src AS acct FROM tx UNION ALL SELECT dst AS acct FROM tx) a GROUP BY acct) SELECT acct, deg FROM d ORDER BY deg DESC, acct LIMIT 20")
both("eda_repeat_accounts", "WITH p AS (SELECT DISTINCT src AS acct FROM tx JOIN lab USING (row_id) WHERE is_laundering = 1 AND split = 'train' UNION SELECT DISTINCT dst FROM tx JOIN lab USING (row_id) WHERE is_laundering = 1 AND split = 'train') SELECT count(*) AS positives, count_if(src IN (SELECT acct FROM p) OR dst IN (SELECT acct FROM p)) AS touching FROM tx JOIN lab USING (row_id) WHERE is_laundering = 1 AND split = 'test'")
both("eda_splits", "SELECT split, count(*) AS n, round(count_if(is_laundering = 1) / CAST(count(*) AS DOUBLE), 9) AS rate, round(count(*) / CAST((SELECT count(*) FROM tx) AS DOUBLE), 9) AS share FROM tx JOIN lab USING (row_id) GROUP BY split")
both("eda_train_degree", "WITH o AS (SELECT src AS acct, count(*) AS d_out FROM tx WHERE split = 'train' GROUP BY src), i AS (SELECT dst AS acct, count(*) AS d_in FROM tx WHERE split = 'train' GROUP BY dst), d AS (SELECT coalesce(o.acct, i.acct) AS acct, coalesce(d_out, 0) AS d_out, coalesce(d_in, 0) AS d_in FROM o FULL OUTER JOIN i ON o.acct = i.acct) SELECT count(*) AS accounts, max(d_out) AS most_out, max(d_in) AS most_in, percentile_disc(0.5) WITHIN GROUP (ORDER BY d_out + d_in) AS p50, percentile_disc(0.99) WITHIN GROUP (ORDER BY d_out + d_in) AS p99 FROM d")
both("eda_ties", "WITH m AS (SELECT minute, count(*) AS n FROM tx GROUP BY minute), s AS (SELECT src, minute, count(*) AS n FROM tx GROUP BY src, minute) SELECT round((SELECT sum(n) FROM m WHERE n > 1) / CAST((SELECT count(*) FROM tx) AS DOUBLE), 9) AS in_minute, round(coalesce((SELECT sum(n) FROM s WHERE n > 1), 0) / CAST((SELECT count(*) FROM tx) AS DOUBLE), 9) AS in_src_minute")
both("sizing_pairs", "SELECT count(*) AS pairs, max(n) AS most FROM (SELECT src, dst, count(*) AS n FROM tx GROUP BY src, dst) p")
both("sizing_in_window", "SELECT max(n) AS most FROM (SELECT count(*) OVER (PARTITION BY dst ORDER BY minute RANGE BETWEEN 1440 PRECEDING AND CURRENT ROW) AS n FROM tx) w")
both("sizing_sums", "SELECT CAST(max(s) AS BIGINT) AS most, max(s) < 9007199254740992 AS exact FROM (SELECT sum(usd_c) OVER (PARTITION BY dst ORDER BY minute RANGE BETWEEN 4320 PRECEDING AND CURRENT ROW) AS s FROM tx) w")
both("amount_domains", "SELECT min(usd_c) AS least, max(usd_c) AS most, CAST(sum(usd_c % 100) AS BIGINT) AS remainders, CAST(sum(CASE WHEN usd_c > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM tx")
both("json_scan", "SELECT count(*) AS n, count(DISTINCT props) AS kinds, max(length(props)) AS longest FROM events")
both("vocabulary", "SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT payment_format AS v FROM tx WHERE split = 'train') t")
both("zscore_fit", "SELECT round(avg(ln(1 + amount_usd)), 6) AS mu, round(greatest(stddev_pop(ln(1 + amount_usd)), 0.000001), 6) AS sigma FROM tx WHERE split = 'train'")
both("snapshot_zscore", "SELECT day, round(avg(amount_usd), 6) AS mu, round(stddev_samp(amount_usd), 6) AS sigma FROM tx GROUP BY day")
both("split_bounds", "SELECT split, min(row_id) AS first_row, max(row_id) AS last_row, count(*) AS n, max(row_id) - min(row_id) + 1 = count(*) AS contiguous FROM tx GROUP BY split")
both("degree_hist", "WITH d AS (SELECT dst AS acct, count(*) AS deg FROM tx WHERE split = 'train' GROUP BY dst), a AS (SELECT src AS acct FROM tx UNION SELECT dst FROM tx) SELECT coalesce(deg, 0) AS deg, count(*) AS accounts FROM a LEFT JOIN d ON a.acct = d.acct GROUP BY coalesce(deg, 0)")
both("plan_points", "WITH p AS (SELECT day, count(*) AS n FROM tx GROUP BY day) SELECT day, n, CAST(coalesce(sum(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_offset FROM p")
both("negative_sample_sizes", "SELECT split, CAST(round(0.1 * count_if(is_laundering = 0)) AS BIGINT) AS negatives, count_if(is_laundering = 1) AS positives FROM tx JOIN lab USING (row_id) GROUP BY split")


@on_transfers("SELECT max(n) AS most_live FROM (SELECT count(*) OVER (ORDER BY minute RANGE BETWEEN 4320 PRECEDING AND CURRENT ROW) AS n FROM tx) w")
def sizing_ring(tx):
    """Most transfers alive at once, from running sums over minutes: no row is ever sorted in one task."""
    m = J.running(tx.groupBy("minute").agg(F.count("*").alias("n")), ["minute"], {"upto": "n"})
    w = J.running_before(m, tx.select((F.col("minute") - 4321).alias("minute")).distinct(), "minute", "upto")
    return m.join(w.select((F.col("minute") + 4321).alias("minute"), F.col("before")), "minute").agg(F.max(F.col("upto") - F.col("before")).alias("most_live"))


@on_transfers("SELECT row_id, min(row_id) OVER (PARTITION BY minute) - 1 AS bound, count(*) OVER (ORDER BY minute RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS visible FROM tx")
def first_rank_bound(tx):
    m = J.running(tx.groupBy("minute").agg(F.count("*").alias("n"), F.min("row_id").alias("first")), ["minute"], {"upto": "n"})
    return tx.select("row_id", "minute").join(m, "minute").select("row_id", (F.col("first") - 1).alias("bound"), (F.col("upto") - F.col("n")).alias("visible"))


@on_transfers("SELECT count_if(from_bank LIKE '0%') AS zero_padded, count_if(try_cast(from_bank AS INTEGER) IS NULL) AS not_numbers, count(DISTINCT length(from_bank)) AS lengths, (SELECT count(*) FROM (SELECT row_id, minute, lag(minute) OVER (ORDER BY row_id) AS before FROM tx) t WHERE before > minute) AS inversions FROM tx")
def eda_csv_traps(tx):
    banks = tx.agg(F.count_if(F.col("from_bank").startswith("0")).alias("zero_padded"), F.count_if(F.expr("try_cast(from_bank as int) is null")).alias("not_numbers"), F.countDistinct(F.length("from_bank")).alias("lengths"))
    order = J.lagged(tx.select("row_id", "minute"), ["row_id"], "minute", "before")
    return banks.crossJoin(F.broadcast(order.agg(F.count_if(F.col("before") > F.col("minute")).alias("inversions"))))


@on_transfers("WITH m AS (SELECT minute, count(*) AS n FROM tx GROUP BY minute), g AS (SELECT minute, n, least(minute - coalesce(lag(minute) OVER (ORDER BY minute), minute), 15) AS gap FROM m) SELECT minute, n, CAST(sum(gap) OVER (ORDER BY minute) AS BIGINT) AS tau FROM g")
def trace_offsets(tx):
    m = J.lagged(tx.groupBy("minute").agg(F.count("*").alias("n")), ["minute"], "minute", "before")
    m = m.withColumn("gap", F.least(F.col("minute") - F.coalesce("before", "minute"), F.lit(15)))
    return J.running(m, ["minute"], {"tau": "gap"}).select("minute", "n", "tau")


@on_transfers("WITH r AS (SELECT row_id, row_number() OVER (ORDER BY ts, row_id) - 1 AS rank FROM tx) SELECT row_id, rank FROM r")
def global_rank(tx):
    return J.numbered(tx.select("row_id", "ts"), [F.col("ts"), F.col("row_id")]).select("row_id", "rank")


@on_transfers("WITH a AS (SELECT DISTINCT bank, acct FROM (SELECT from_bank AS bank, CAST(src AS VARCHAR) AS acct FROM tx UNION ALL SELECT to_bank, CAST(dst AS VARCHAR) FROM tx)) SELECT CAST(row_number() OVER (ORDER BY bank, acct) - 1 AS INTEGER) AS account_id, bank, acct AS account FROM a")
def accounts_dense_ids(tx):
    return store.accounts(tx.withColumns({"from_account": F.col("src").cast("string"), "to_account": F.col("dst").cast("string")}))


@on_transfers("WITH a AS (SELECT DISTINCT bank, acct FROM (SELECT from_bank AS bank, src AS acct FROM tx UNION ALL SELECT to_bank, dst FROM tx)), n AS (SELECT *, row_number() OVER (ORDER BY bank, CAST(acct AS VARCHAR)) - 1 AS id FROM a) SELECT row_id, s.id AS src_id, d.id AS dst_id FROM tx JOIN n s ON s.bank = from_bank AND s.acct = src JOIN n d ON d.bank = to_bank AND d.acct = dst")
def accounts_mapped(tx):
    t = tx.withColumns({"from_account": F.col("src").cast("string"), "to_account": F.col("dst").cast("string")})
    a = store.accounts(t)
    s = a.select(F.col("account_id").cast("long").alias("src_id"), F.col("bank").alias("from_bank"), F.col("account").alias("from_account"))
    d = a.select(F.col("account_id").cast("long").alias("dst_id"), F.col("bank").alias("to_bank"), F.col("account").alias("to_account"))
    return t.join(s, ["from_bank", "from_account"]).join(d, ["to_bank", "to_account"]).select("row_id", "src_id", "dst_id")


@on_transfers("WITH p AS (SELECT src, payment_format, row_id, row_number() OVER (PARTITION BY src, payment_format ORDER BY row_id) AS nth FROM tx), q AS (SELECT dst, payment_format, row_id, row_number() OVER (PARTITION BY dst, payment_format ORDER BY row_id DESC) AS nth FROM tx) SELECT p.row_id, q.row_id AS matched FROM p LEFT JOIN q ON p.src = q.dst AND p.payment_format = q.payment_format AND p.nth = q.nth")
def labels_dup_join(tx):
    """Each account's transfers out of one format meet those into it, the first out with the last in and so on."""
    nth = lambda d, key, order: d.withColumn("nth", F.row_number().over(Window.partitionBy(key, "payment_format").orderBy(order)))
    p = nth(tx.select("src", "payment_format", "row_id"), "src", F.col("row_id"))
    q = nth(tx.select(F.col("dst").alias("src"), "payment_format", F.col("row_id").alias("matched")), "src", F.desc("matched"))
    return p.join(q, ["src", "payment_format", "nth"], "left").select("row_id", "matched")


@on_transfers("SELECT payment_currency, receiving_currency, count(*) AS n, round(median(amount_usd / amount_paid), 9) AS rate FROM tx WHERE split = 'train' AND amount_paid > 0 AND payment_currency <> receiving_currency GROUP BY payment_currency, receiving_currency")
def fx_pair_medians(tx):
    t = tx.where("split = 'train' and amount_paid > 0 and payment_currency <> receiving_currency")
    return t.groupBy("payment_currency", "receiving_currency").agg(F.count("*").alias("n"), F.round(F.median(F.col("amount_usd") / F.col("amount_paid")), 9).alias("rate"))


@query()
def fx_rates(spark, sf_dir):
    return V.fx_rates(T.transfers(spark, sf_dir).withColumn("amount_received", F.col("amount_paid") * F.when(F.col("receiving_currency") == "Yen", 150.0).when(F.col("receiving_currency") == "Euro", 0.9).otherwise(1.0) / F.when(F.col("payment_currency") == "Yen", 150.0).when(F.col("payment_currency") == "Euro", 0.9).otherwise(1.0)), "US Dollar")


@on_transfers("SELECT 'rows' AS check_name, count(*) - count(DISTINCT row_id) AS violations FROM tx UNION ALL SELECT 'day', count_if(day <> minute // 1440 + 1) FROM tx UNION ALL SELECT 'amount', count_if(amount_paid < 0 OR isnan(amount_paid)) FROM tx UNION ALL SELECT 'split', count_if(split IS NULL) FROM tx UNION ALL SELECT 'self_loop', count_if(self_loop <> (src = dst)) FROM tx")
def validate_violations(tx):
    return V.violations(tx, {"day": F.col("day") != F.expr("minute div 1440") + 1, "amount": (F.col("amount_paid") < 0) | F.isnan("amount_paid"), "split": F.col("split").isNull(), "self_loop": F.col("self_loop") != (F.col("src") == F.col("dst"))}, unique="row_id")


#: Every transfer whose score raises an alert is a case.
CASES = "c AS (SELECT row_id AS case_id, src AS u, dst AS v, minute FROM tx JOIN sc USING (row_id) WHERE score >= 0.7)"
NEAR = """o AS (SELECT src AS a, dst AS other, minute AS t, row_id, 'out' AS direction FROM tx UNION ALL SELECT dst, src, minute, row_id, 'in' FROM tx)"""


def cases(tx):
    return tx.where(T.score(F.col("row_id")) >= 0.7).select(F.col("row_id").alias("case_id"), F.col("src").alias("u"), F.col("dst").alias("v"), "minute")


@on_transfers(f"""WITH {CASES}, {NEAR}, n AS (SELECT case_id, u AS node, minute FROM c), j AS (SELECT n.case_id, n.node, o.direction, o.other, o.row_id, o.t, row_number() OVER (PARTITION BY n.case_id, n.node, o.direction ORDER BY o.t DESC, o.row_id DESC) AS nth
  FROM n JOIN o ON o.a = n.node AND o.t BETWEEN n.minute - 4320 AND n.minute - 1) SELECT case_id, node, direction, other, row_id, t FROM j WHERE nth <= 5""")
def neighbours_topk(tx):
    return G.neighbours(tx, cases(tx).select("case_id", F.col("u").alias("node"), "minute"), 4320, 5)


SUBGRAPH = f"""WITH {CASES}, {NEAR}, n AS (SELECT DISTINCT case_id, unnest([u, v]) AS node, minute FROM c),
 one AS (SELECT * FROM (SELECT n.case_id, n.node, o.direction, o.other, o.row_id, row_number() OVER (PARTITION BY n.case_id, n.node, o.direction ORDER BY o.t DESC, o.row_id DESC) AS nth FROM n JOIN o ON o.a = n.node AND o.t BETWEEN n.minute - 4320 AND n.minute - 1) WHERE nth <= 10),
 m AS (SELECT DISTINCT case_id, other AS node, direction FROM one WHERE (case_id, other) NOT IN (SELECT (case_id, node) FROM n)),
 two AS (SELECT * FROM (SELECT m.case_id, o.row_id, row_number() OVER (PARTITION BY m.case_id, m.node, o.direction ORDER BY o.t DESC, o.row_id DESC) AS nth FROM m JOIN c USING (case_id) JOIN o ON o.a = m.node AND o.direction = m.direction AND o.t BETWEEN c.minute - 4320 AND c.minute - 1) WHERE nth <= 4),
 g AS (SELECT case_id, row_id FROM one UNION SELECT case_id, row_id FROM two)"""


@on_transfers(SUBGRAPH + " SELECT case_id, row_id FROM g")
def case_subgraph(tx):
    return G.case_subgraph(tx, cases(tx))


@on_transfers(SUBGRAPH + " SELECT case_id, count(*) AS edges, count(DISTINCT src) AS senders, count(DISTINCT dst) AS receivers, count_if(src = dst) AS loops, CAST(sum(usd_c) AS BIGINT) AS usd_c FROM g JOIN tx USING (row_id) GROUP BY case_id")
def graph_stats(tx):
    g = G.case_subgraph(tx, cases(tx)).join(tx.select("row_id", "src", "dst", "usd_c"), "row_id")
    return g.groupBy("case_id").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("senders"), F.countDistinct("dst").alias("receivers"), F.count_if(F.col("src") == F.col("dst")).alias("loops"), F.sum("usd_c").alias("usd_c"))


@on_transfers("SELECT row_id, src, dst, 0 AS reversed FROM tx UNION ALL SELECT row_id, dst, src, 1 FROM tx WHERE src <> dst")
def bidirected(tx):
    return G.bidirected(tx)


ALL_BEFORE = "t AS (SELECT row_id, src, dst, minute FROM tx)"
KNN = f"""WITH {ALL_BEFORE}, c AS (SELECT row_id AS case_id, src AS u, minute FROM t), j AS (SELECT c.case_id, t.src AS neighbour, t.row_id, row_number() OVER (PARTITION BY c.case_id ORDER BY t.minute DESC, t.row_id DESC) AS nth FROM c JOIN t ON t.dst = c.u AND t.minute < c.minute), k AS (SELECT * FROM j WHERE nth <= 8)"""


def last_neighbours(tx):
    """The newest eight transfers into the sender of every transfer, before its minute."""
    into = tx.select(F.col("dst").alias("at"), F.col("minute").alias("t"), "row_id", F.col("src").alias("neighbour"))
    nodes = tx.select(F.col("row_id").alias("case_id"), F.col("src").alias("node"), "minute")
    return J.last_before(into, nodes, 8)


@on_transfers(KNN + " SELECT case_id, neighbour, row_id FROM k")
def knn_temporal_last(tx):
    return last_neighbours(tx).select("case_id", "neighbour", "row_id")


@on_transfers(KNN + " SELECT count(*) AS sampled, count_if(t.minute >= c.minute) AS violations, count_if(k.row_id = k.case_id) AS target_hits, max(c.minute - t.minute) AS most_slack FROM k JOIN c USING (case_id) JOIN tx t ON t.row_id = k.row_id")
def asof_guard(tx):
    k = last_neighbours(tx)
    return k.agg(F.count("*").alias("sampled"), F.count_if(F.col("t") >= F.col("minute")).alias("violations"), F.count_if(F.col("row_id") == F.col("case_id")).alias("target_hits"), F.max(F.col("minute") - F.col("t")).alias("most_slack"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def parquet_round_trip(spark, sf_dir):
    """Written with zstd by partition and read again with partition pruning and a narrow schema."""
    import uuid

    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    store.cut(e.limit(1))  # a checkpoint folder exists
    path = f"{spark.sparkContext.getCheckpointDir()}/events-{uuid.uuid4().hex}"
    store.write_table(e, path, by="event_type")
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query()
def table_digest(spark, sf_dir):
    return store.digest(table(spark, sf_dir, "events"))


@query("SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND epoch_us(b.ts) // 60000000 - epoch_us(a.ts) // 60000000 BETWEEN 1 AND 60 WHERE a.event_type = 'signup'")
def join_band(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("m", F.expr("unix_micros(cast(ts as timestamp)) div 60000000"))
    left = e.where("event_type = 'signup'").select(F.col("event_id").alias("left_id"), F.col("user_id").alias("u"), F.col("m").alias("ma"))
    right = e.select(F.col("event_id").alias("right_id"), F.col("user_id").alias("w"), F.col("m").alias("mb"))
    return J.band_join(left, right, [("u", "w")], "ma", "mb", 1, 60).select("left_id", "right_id")
