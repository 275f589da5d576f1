"""Generic relational coverage over the star schema: joins, set operations, grouping sets, windows, functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.plans.registry import both, query, table

both("group_agg_having", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_shipdate) AS first_ship FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10")
both("join_inner_multi", "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' OR n_nationkey < 10 GROUP BY n_name")
both("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000 GROUP BY c_custkey")
both("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
both("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
both("join_full", "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 20 GROUP BY c_nationkey) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 5 GROUP BY s_nationkey) b ON a.k = b.k")
both("join_cross_values", "SELECT r_name, k FROM region CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) v")
both("join_membership_or", "SELECT count_if(l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)) AS n, count(*) AS total FROM lineitem")
both("set_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
both("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
both("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
both("set_except_all", "SELECT o_orderstatus AS s FROM orders EXCEPT ALL SELECT l_linestatus FROM lineitem")
both("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
both("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
both("grouping_sets", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
both("rank_functions", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS d, ntile(3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS t FROM orders")
both("window_lag_lead", "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, lead(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders")
both("window_rows_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS most FROM orders")
both("top_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders) t WHERE nth <= 2")
both("top_n", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
both("scalar_subquery", "SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 6) + 0.0 AS above FROM customer WHERE c_acctbal > (SELECT percentile_disc(0.9) WITHIN GROUP (ORDER BY c_acctbal) FROM customer)")
both("correlated_subquery", "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)")
both("distinct_counts", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
both("conditional_aggregates", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count_if(o_totalprice > 100000) AS large, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o FROM orders GROUP BY o_orderpriority")
both("quantiles", "SELECT l_linestatus, percentile_disc(0.25) WITHIN GROUP (ORDER BY l_extendedprice) AS q1, median(l_extendedprice) AS med, percentile_disc(0.99) WITHIN GROUP (ORDER BY l_extendedprice) AS p99 FROM lineitem GROUP BY l_linestatus")
both("variances", "SELECT o_orderstatus, round(var_pop(o_totalprice / 1000), 4) AS vp, round(stddev_samp(o_totalprice / 1000), 6) AS ss FROM orders GROUP BY o_orderstatus")
both("string_functions", "SELECT p_partkey, upper(p_brand) AS b, length(p_name) AS n, substring(p_type, 1, 5) AS t, replace(p_name, ' ', '_') AS r, concat(p_brand, '/', p_type) AS c, lpad(CAST(p_size AS VARCHAR(10)), 4, '0') AS z, trim(concat(' ', p_name, ' ')) AS tr, CASE WHEN p_name LIKE '%e%' THEN 1 ELSE 0 END AS has_e FROM part")
both("math_functions", "SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 6) AS s, round(ln(1 + l_extendedprice), 6) AS l, round(exp(l_discount), 6) AS e, abs(l_quantity - 25) AS a, greatest(l_quantity, 10) AS g, least(l_tax, 0.05) AS m, CAST(l_orderkey % 7 AS INTEGER) AS r FROM lineitem")
both("null_functions", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, c_acctbal IS NOT DISTINCT FROM c_acctbal AS same FROM customer")
both("recursive_chain", "WITH RECURSIVE c(n, s) AS (SELECT 1, 1 UNION ALL SELECT n + 1, s + n + 1 FROM c WHERE n < 30) SELECT n, s FROM c")
both("pages_scan", "SELECT page_id, length(html) AS n FROM pages WHERE url LIKE 'http%'")
both("conversation_turns", "SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")


@query("SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 2) AS O, round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 2) AS F FROM lineitem GROUP BY l_returnflag")
def pivot(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.round(F.sum("l_quantity"), 2))
    return p


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_functions(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT vec_id, len(embedding) AS n, round(list_sum(embedding), 3) + 0.0 AS s, label FROM embeddings")
def array_functions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return e.select("vec_id", F.size("embedding").alias("n"), (F.round(total, 3) + 0.0).alias("s"), "label")


@query("SELECT user_id, len(list(DISTINCT event_type)) AS kinds, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS names FROM events GROUP BY user_id")
def collect_sets(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("s"))
    return e.select("user_id", F.size("s").cast("long").alias("kinds"), F.array_join("s", ",").alias("names"))


@query("SELECT user_id, event_type AS k, count(*) AS v FROM events GROUP BY user_id, event_type")
def map_functions(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", F.explode("m").alias("k", "v"))


@query("SELECT epoch_us(ts) // 86400000000 AS day, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1, 2")
def tumbling_daily(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("t", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v"))
    return g.select(F.expr("unix_micros(window.start) div 86400000000").alias("day"), "event_type", "n", "v")


@query("WITH d AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), s AS (SELECT *, sum(CASE WHEN before IS NULL OR t - before > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS sess FROM d) SELECT user_id, min(t) AS first_t, count(*) AS n FROM s GROUP BY user_id, sess")
def sessions(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr("unix_micros(cast(ts as timestamp))").alias("t"))
    e = e.withColumn("sess", F.sum(F.when(F.col("t") - F.lag("t").over(w) > 3_600_000_000, 1).otherwise(0)).over(w))
    return e.groupBy("user_id", "sess").agg(F.min("t").alias("first_t"), F.count("*").alias("n")).drop("sess")


both("date_functions", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(hour(o_orderdate) AS INTEGER) AS h FROM orders")
