"""Evaluation of a score against labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions import scalars as S
from causeway.operators import asof as A
from causeway.operators import evaluate as E
from causeway.operators import features as X
from causeway.operators import rules as R
from causeway.operators import validate as V
from causeway.operators.joins import numbered
from causeway.plans.feature_queries import SEVERITIES, THRESHOLDS
from causeway.plans.registry import both, on_transfers
from causeway.sources import transfers as T


def scored(tx, split: str = "test"):
    lab = T.labels(tx)
    return tx.where(F.col("split") == split).join(lab, "row_id").withColumns({"score": T.score(F.col("row_id")), "y": F.col("is_laundering")})


SCORED = "s AS (SELECT tx.*, is_laundering AS y, attempt_id, typology, score FROM tx JOIN lab USING (row_id) JOIN sc USING (row_id) WHERE split = 'test')"
CURVE = f"""WITH {SCORED}, c AS (SELECT score AS threshold, CAST(sum(count(*)) OVER (ORDER BY score DESC) AS BIGINT) AS n, CAST(sum(sum(y)) OVER (ORDER BY score DESC) AS BIGINT) AS tp FROM s GROUP BY score),
 b AS (SELECT *, n - tp AS fp, coalesce(lag(tp) OVER (ORDER BY threshold DESC), 0) AS tp0, coalesce(lag(n - tp) OVER (ORDER BY threshold DESC), 0) AS fp0, max(tp) OVER () AS p, max(n - tp) OVER () AS f FROM c)"""
RATE = 0.05


@on_transfers(CURVE + " SELECT round(threshold, 9) AS threshold, n, tp, fp FROM b")
def tie_curve(tx):
    return E.tie_curve(scored(tx)).select(F.round("threshold", 9).alias("threshold"), "n", "tp", "fp")


@on_transfers(CURVE + " SELECT round(sum((tp - tp0) / CAST(p AS DOUBLE) * tp / CAST(n AS DOUBLE)), 9) AS pr_auc FROM b")
def pr_auc(tx):
    return E.pr_auc(scored(tx)).select(F.round("pr_auc", 9).alias("pr_auc"))


@on_transfers(CURVE + " SELECT round(sum((fp - fp0) / CAST(f AS DOUBLE) * (tp + tp0) / CAST(p AS DOUBLE) / 2), 9) AS roc_auc FROM b")
def roc_auc(tx):
    return E.roc_auc(scored(tx)).select(F.round("roc_auc", 9).alias("roc_auc"))


@on_transfers(f"WITH {SCORED} SELECT (SELECT count(*) FROM s WHERE score >= 0.7) AS alerts, count(*) FILTER (WHERE score >= 0.7 AND y = 1) AS tp, round(count(*) FILTER (WHERE score >= 0.7 AND y = 1) / CAST(count(*) FILTER (WHERE score >= 0.7) AS DOUBLE), 9) AS precision, round(count(*) FILTER (WHERE score >= 0.7 AND y = 1) / CAST(sum(y) AS DOUBLE), 9) AS recall, round(2 * count(*) FILTER (WHERE score >= 0.7 AND y = 1) / CAST(count(*) FILTER (WHERE score >= 0.7) + sum(y) AS DOUBLE), 9) AS f1 FROM s")
def precision_recall(tx):
    r = E.prf(scored(tx).withColumn("flag", F.col("score") >= 0.7))
    return r.select("alerts", "tp", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@on_transfers(CURVE + " SELECT round(threshold, 9) AS threshold, round(2 * tp / CAST(n + p AS DOUBLE), 9) AS f1 FROM b ORDER BY 2 * tp / CAST(n + p AS DOUBLE) DESC, b.threshold DESC LIMIT 1")
def best_f1(tx):
    return E.best_f1(scored(tx)).select(F.round("threshold", 9).alias("threshold"), F.round("f1", 9).alias("f1"))


@on_transfers(CURVE + f" SELECT round(min(threshold), 9) AS threshold FROM b WHERE n <= floor({RATE} * (SELECT count(*) FROM s) + 1e-6)")
def threshold_rate(tx):
    return E.threshold_for_rate(scored(tx), RATE).select(F.round("threshold", 9).alias("threshold"))


@on_transfers(f"WITH {SCORED} SELECT row_id, round(score, 9) AS score FROM s ORDER BY s.score DESC, row_id LIMIT 50")
def topk_flags(tx):
    return E.top_k(scored(tx), 50, ["row_id"]).select("row_id", F.round("score", 9).alias("score"))


@on_transfers(f"""WITH {SCORED}, k AS (SELECT CAST(floor({RATE} * count(*) + 1e-6) AS BIGINT) AS k FROM s), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, row_id) AS nth FROM s),
 f AS (SELECT y, score >= 0.7 AS a, nth <= k AS b, score >= 0.7 OR payment_format = 'signup' AS c FROM r, k)
 SELECT point, sum(CAST(hit AS INTEGER))::BIGINT AS alerts, sum(CAST(hit AND y = 1 AS INTEGER))::BIGINT AS tp FROM (SELECT y, 'deployable' AS point, a AS hit FROM f UNION ALL SELECT y, 'iso_volume', b FROM f UNION ALL SELECT y, 'union', c FROM f) GROUP BY point""")
def operating_points(tx):
    s = scored(tx).select("row_id", "score", "y", "payment_format")
    k = s.agg(E.budget(F.count("*"), RATE).alias("k"))
    top = numbered(s, [F.desc("score"), F.col("row_id")], "nth").crossJoin(F.broadcast(k))
    points = F.array(*(F.struct(F.lit(n).alias("point"), hit.alias("hit")) for n, hit in (("deployable", F.col("score") >= 0.7), ("iso_volume", F.col("nth") < F.col("k")), ("union", (F.col("score") >= 0.7) | (F.col("payment_format") == "signup")))))
    p = top.select("y", F.explode(points).alias("p")).select("y", "p.*")
    return p.groupBy("point").agg(F.count_if("hit").alias("alerts"), F.count_if(F.col("hit") & (F.col("y") == 1)).alias("tp"))


@on_transfers(f"WITH {SCORED} SELECT round(count(DISTINCT (day, src)) / CAST((SELECT count(DISTINCT day) FROM s) AS DOUBLE), 9) AS per_day FROM s WHERE score >= 0.7")
def alerted_accounts(tx):
    s = scored(tx)
    days = s.agg(F.countDistinct("day").alias("days"))
    return s.where("score >= 0.7").agg(F.countDistinct("day", "src").alias("n")).crossJoin(F.broadcast(days)).select(F.round(F.col("n") / F.col("days"), 9).alias("per_day"))


@on_transfers(f"WITH {SCORED} SELECT coalesce(t, '+ALL') AS typology, count(*) AS positives, round(avg(CAST(score >= 0.7 AS INTEGER)), 9) AS recall FROM (SELECT coalesce(typology, 'OTHER') AS t, score FROM s WHERE y = 1) GROUP BY ROLLUP (t)")
def recall_typology(tx):
    s = scored(tx).where("y = 1").select(F.coalesce("typology", F.lit("OTHER")).alias("t"), "score")
    return s.rollup("t").agg(F.count("*").alias("positives"), F.round(F.avg((F.col("score") >= 0.7).cast("int")), 9).alias("recall")).select(F.coalesce("t", F.lit("+ALL")).alias("typology"), "positives", "recall")


@on_transfers("WITH s AS (SELECT attempt_id, typology, minute, score >= 0.7 AS flag FROM tx JOIN lab USING (row_id) JOIN sc USING (row_id)) SELECT attempt_id, typology, count(*) AS size, CAST(max(CAST(flag AS INTEGER)) AS INTEGER) AS detected, min(CASE WHEN flag THEN minute END) - min(minute) AS delay FROM s WHERE attempt_id IS NOT NULL GROUP BY attempt_id, typology")
def attempt_detection(tx):
    s = tx.join(T.labels(tx), "row_id").withColumn("flag", T.score(F.col("row_id")) >= 0.7)
    return E.attempts(s)


@on_transfers(f"WITH {SCORED}, seen AS (SELECT DISTINCT src FROM tx JOIN lab USING (row_id) WHERE split = 'train' AND is_laundering = 1) SELECT src IN (SELECT src FROM seen) AS seen, count(*) AS positives, round(avg(CAST(score >= 0.7 AS INTEGER)), 9) AS recall FROM s WHERE y = 1 GROUP BY 1")
def memorisation(tx):
    train = tx.where("split = 'train'").join(T.labels(tx).where("is_laundering = 1"), "row_id", "left_semi").select(F.col("src").alias("known")).distinct()
    s = scored(tx).where("y = 1").join(train, F.col("src") == F.col("known"), "left")
    return s.groupBy(F.col("known").isNotNull().alias("seen")).agg(F.count("*").alias("positives"), F.round(F.avg((F.col("score") >= 0.7).cast("int")), 9).alias("recall"))


@on_transfers("""WITH e AS (SELECT list_sort(list_distinct([""" + ", ".join(f"quantile_disc(usd_c, {i / 10})" for i in range(1, 10)) + """])) AS edges FROM tx WHERE split = 'train'),
 c AS (SELECT len(list_filter(edges, lambda x: x < usd_c)) AS bin, count(*) FILTER (WHERE split = 'train') AS a, count(*) FILTER (WHERE split = 'test') AS b FROM tx, e WHERE split IN ('train', 'test') GROUP BY 1),
 p AS (SELECT greatest(a / CAST(sum(a) OVER () AS DOUBLE), 1e-4) AS a, greatest(b / CAST(sum(b) OVER () AS DOUBLE), 1e-4) AS b FROM c) SELECT round(sum((b - a) * ln(b / a)), 9) AS psi FROM p""")
def psi_gate(tx):
    return E.psi(tx.where("split = 'train'"), tx.where("split = 'test'"), "usd_c").select(F.round("psi", 9).alias("psi"))


@on_transfers()
def bootstrap_ci(tx):
    s = scored(tx).withColumn("flag", (F.col("score") >= 0.7).cast("int"))
    stratum = F.when(F.col("attempt_id").isNotNull(), "attempt").when(F.col("y") == 1, "other positive").otherwise("negative")
    cluster = F.coalesce(F.col("attempt_id").cast("long"), F.col("src").cast("long"))
    other = ((F.col("score") >= 0.7) | (F.col("payment_format") == "signup")).cast("int")
    c = s.select(stratum.alias("stratum"), cluster.alias("cluster"), F.col("y").alias("pos"), "flag", (F.col("flag") * F.col("y")).alias("tp"), (other * F.col("y")).alias("tp_union"))
    r = E.bootstrap(c, ["pos", "tp", "tp_union"], 2000, 0).where("pos > 0")
    r = r.select((F.col("tp") / F.col("pos")).alias("recall"), ((F.col("tp_union") - F.col("tp")) / F.col("pos")).alias("gain"))
    return E.interval(r, "recall").crossJoin(F.broadcast(E.interval(r, "gain").select(F.col("low").alias("gain_low"), F.col("high").alias("gain_high"))))


@on_transfers("WITH d AS (SELECT src, CAST(minute - lag(minute) OVER (PARTITION BY src ORDER BY minute, row_id) AS BIGINT) AS gap FROM tx) SELECT src % 10 AS grp, count(gap) AS n, quantile_disc(gap, 0.5) AS p50, CASE WHEN count(gap) * 0.05 >= 10 THEN quantile_disc(gap, 0.95) END AS p95, CASE WHEN count(gap) * 0.001 >= 10 THEN quantile_disc(gap, 0.999) END AS p999 FROM d GROUP BY 1")
def latency_quantiles(tx):
    from pyspark.sql import Window

    d = tx.select("src", (F.col("minute") - F.lag("minute").over(Window.partitionBy("src").orderBy("minute", "row_id"))).alias("gap"))
    q = lambda x: F.when(F.count("gap") * (1 - x) >= 10 - 1e-9, F.expr(f"percentile_disc({x}) within group (order by gap)"))
    return d.groupBy((F.col("src") % 10).alias("grp")).agg(F.count("gap").alias("n"), F.expr("percentile_disc(0.5) within group (order by gap)").alias("p50"), q(0.95).alias("p95"), q(0.999).alias("p999"))


@on_transfers("""WITH r AS (SELECT src AS grp, minute AS lo, minute + 700 AS hi FROM tx), m AS (SELECT *, max(hi) OVER (PARTITION BY grp ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
 i AS (SELECT *, sum(CASE WHEN lo <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY grp ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isl FROM m) SELECT grp, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY grp, isl""")
def range_merge(tx):
    return E.merged_ranges(tx.select(F.col("src").alias("grp"), F.col("minute").alias("lo"), (F.col("minute") + 700).alias("hi")))


@on_transfers(SEVERITIES + f""", f AS (SELECT s.row_id, is_laundering AS y, {' OR '.join(f'({c} >= {t} AND {c} > 0)' for c, t in THRESHOLDS.items() if t)} AS flag FROM sev s JOIN lab USING (row_id))
 SELECT y, flag, count(*) AS n FROM f GROUP BY y, flag""")
def confusion(tx):
    s = R.apply_thresholds(R.severities(tx), THRESHOLDS).join(T.labels(tx), "row_id")
    return s.groupBy(F.col("is_laundering").alias("y"), F.col("rules_any").alias("flag")).agg(F.count("*").alias("n"))


POINTS = [(0.1, 0.0), (0.4, 0.2), (0.7, 0.5), (0.9, 0.95)]


@on_transfers("SELECT row_id, round(CASE WHEN score <= 0.1 THEN 0.0 WHEN score < 0.4 THEN (score - 0.1) * (0.2 / 0.3) WHEN score < 0.7 THEN 0.2 + (score - 0.4) * (0.3 / 0.3) WHEN score < 0.9 THEN 0.5 + (score - 0.7) * (0.45 / 0.2) ELSE 0.95 END, 6) AS p FROM sc")
def calibration_interp(tx):
    return tx.select("row_id", F.round(S.interpolate(T.score(F.col("row_id")), POINTS), 6).alias("p"))


@on_transfers("WITH a AS (SELECT row_id, score, amount_usd FROM sc JOIN tx USING (row_id)) SELECT row_id, CASE WHEN coalesce(score <= 0.5, true) THEN CASE WHEN amount_usd <= 800.0 THEN 'low' ELSE 'mid' END ELSE CASE WHEN amount_usd <= 300.0 THEN 'mid' ELSE 'high' END END AS label FROM a")
def tree_walk(tx):
    tree = {"feature": "score", "threshold": 0.5, "left": {"feature": "amount_usd", "threshold": 800.0, "left": {"label": "low"}, "right": {"label": "mid"}}, "right": {"feature": "amount_usd", "threshold": 300.0, "left": {"label": "mid"}, "right": {"label": "high"}}}
    return tx.withColumn("score", T.score(F.col("row_id"))).select("row_id", S.decision_tree(tree).alias("label"))


@on_transfers(SEVERITIES + " SELECT row_id, CASE WHEN round_trip >= 1 THEN 'CYCLE' WHEN fan_out_velocity >= 6 THEN 'FAN-OUT' WHEN fan_in_velocity >= 6 THEN 'FAN-IN' WHEN rapid_pass_through >= 0.7 THEN 'STACK' ELSE 'OTHER' END AS label FROM sev")
def typology_list(tx):
    s = R.severities(tx)
    rules = [("CYCLE", s.round_trip >= 1), ("FAN-OUT", s.fan_out_velocity >= 6), ("FAN-IN", s.fan_in_velocity >= 6), ("STACK", s.rapid_pass_through >= 0.7)]
    return s.select("row_id", S.decision_list(rules, "OTHER").alias("label"))


both("alerts_page", "SELECT row_id, minute, src, dst FROM tx JOIN sc USING (row_id) WHERE score >= 0.8 ORDER BY row_id DESC LIMIT 20")
both("multi_seed", "WITH r AS (SELECT row_id % 5 AS seed, avg(CAST(CASE WHEN score >= 0.7 THEN 1 ELSE 0 END AS DOUBLE)) AS v FROM sc GROUP BY row_id % 5) SELECT round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS std, count(v) AS n_defined FROM r")
both("histogram", "SELECT CAST(floor(score * 10) AS BIGINT) AS bucket, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY CAST(floor(score * 10) AS BIGINT)) AS BIGINT) AS upto FROM sc GROUP BY CAST(floor(score * 10) AS BIGINT)")


@on_transfers("SELECT count(*) AS n, CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right, CAST(0 AS BIGINT) AS cnt_differs, CAST(0 AS BIGINT) AS sum_differs FROM tx")
def parity_mismatch(tx):
    """The states by minute against sliding frames, for every transfer."""
    states = X.of_ends(X.prepared(tx), u=["out_cnt_s"], v=["in_sum_l"]).select("row_id", F.col("u_out_cnt_s").alias("cnt"), F.col("v_in_sum_l").alias("sum"))
    frames = tx.select("row_id", F.count("*").over(A.sliding(["src"], X.P.short)).alias("cnt"), F.coalesce(F.sum("usd_c").over(A.sliding(["dst"], X.P.long)), F.lit(0)).alias("sum"))
    return E.parity(states, frames, "row_id", ["cnt", "sum"])


@on_transfers("SELECT le, (SELECT count(*) FROM sc WHERE score <= le) AS n FROM (VALUES (0.1), (0.25), (0.5), (0.75), (0.9), (CAST('inf' AS DOUBLE))) v(le)")
def histogram_buckets(tx):
    return E.buckets(tx.select(T.score(F.col("row_id")).alias("score")), "score", [0.1, 0.25, 0.5, 0.75, 0.9])


@on_transfers("SELECT row_id, score >= 0.7 AS alert_0p02, score >= 0.95 AS alert_0p005, false AS alert_0p0001 FROM sc")
def model_flags(tx):
    scored = tx.select("row_id", T.score(F.col("row_id")).alias("score"))
    return E.model_flags(scored, {S.rate_tag(0.02): 0.7, S.rate_tag(0.005): 0.95, "0p0001": None}).drop("score")


@on_transfers("SELECT row_id, round(amount_paid / CASE payment_currency WHEN 'Euro' THEN 0.9 WHEN 'Yen' THEN 150.0 ELSE 1.0 END, 6) AS amount_usd FROM tx")
def fx_applied(tx):
    rates = tx.sparkSession.createDataFrame([("US Dollar", 1.0), ("Euro", 0.9), ("Yen", 150.0)], "currency string, rate double")
    return V.with_usd(tx, rates).select("row_id", F.round("amount_usd", 6).alias("amount_usd"))


both("example_per_typology", "SELECT typology, row_id FROM (SELECT typology, row_id, row_number() OVER (PARTITION BY typology ORDER BY CASE WHEN score >= 0.7 THEN 0 ELSE 1 END, row_id) AS nth FROM lab JOIN sc USING (row_id) WHERE typology IS NOT NULL) t WHERE nth = 1")
both("false_positives_top", "SELECT row_id, round(score, 9) AS score FROM sc JOIN lab USING (row_id) WHERE is_laundering = 0 ORDER BY sc.score DESC, row_id LIMIT 25")
