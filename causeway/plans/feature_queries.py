"""The per-transfer features by group. The oracles use plain sliding frames; the plans read states by minute."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions import scalars as S
from causeway.operators import features as X
from causeway.operators import graph as G
from causeway.operators import rules as R
from causeway.operators import timelines as TL
from causeway.operators.table import feature_table as feature_row
from causeway.plans.registry import ORACLES, on_transfers, query
from causeway.sources import transfers as T

P = X.P
FORMATS = ", ".join(f"'{f}'" for f in P.formats)
EV = f"""ev AS (
 SELECT t.*, ln(1 + amount_usd) AS l, CAST(round(ln(1 + amount_usd) * {S.LOG_UNIT}) AS BIGINT) AS lq, CAST(round(ln(1 + amount_usd) * ln(1 + amount_usd) * {S.LOG_UNIT}) AS BIGINT) AS l2q,
  amount_usd >= {P.band[0]} AND amount_usd < {P.band[1]} AS in_band, paid_c > 0 AND paid_c % {P.round_cents} = 0 AS is_round,
  payment_format IN ({", ".join(f"'{f}'" for f in P.high_risk)}) AS high_risk, coalesce(list_position([{FORMATS}], payment_format) - 1, -1) AS fmt,
  minute = min(minute) OVER (PARTITION BY src, dst) AS is_new
 FROM tx t)"""


def frame(by: str, n: int | str) -> str:
    return f"OVER (PARTITION BY {by} ORDER BY minute RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def gap_sql(last: str) -> str:
    return f"CASE WHEN {last} IS NULL THEN 0 ELSE least(minute - {last}, {P.cap_gap}) END"


def both_ends(direction: str, columns: str, where: str = "") -> str:
    """DuckDB: a stream of the accounts' own transfers and of query rows for the other end."""
    key, other = ("src", "dst") if direction == "out" else ("dst", "src")
    return f"""far AS (SELECT {columns} FROM (
  SELECT {key} AS acct, minute, {other} AS cp, usd_c, CASE WHEN NOT self_loop THEN usd_c END AS nsl_c, minute AS t, NULL::BIGINT AS row_id FROM ev
  UNION ALL SELECT {other}, minute, NULL, NULL, NULL, NULL, row_id FROM ev) QUALIFY row_id IS NOT NULL)"""


def _velocity(end: str, by: str, other: str):
    cols = ", ".join(f"count(*) {frame(by, w)} AS {end}_cnt_{k}, count(DISTINCT {other}) {frame(by, w)} AS {end}_uniq_{k}" for k, w in (("s", P.short), ("l", P.long)))
    return f"WITH {EV} SELECT row_id, {cols} FROM ev"


def _far_velocity(end: str, direction: str):
    cols = ", ".join(f"count(cp) {frame('acct', w)} AS {end}_cnt_{k}, count(DISTINCT cp) {frame('acct', w)} AS {end}_uniq_{k}" for k, w in (("s", P.short), ("l", P.long)))
    return f"WITH {EV}, {both_ends(direction, 'row_id, ' + cols)} SELECT * FROM far"


VEL = ["cnt_s", "cnt_l", "uniq_s", "uniq_l"]


@on_transfers(_velocity("u_out", "src", "dst"))
def vel_sender(tx):
    return X.of_ends(X.prepared(tx), u=[f"out_{c}" for c in VEL])


@on_transfers(_velocity("v_in", "dst", "src"))
def vel_receiver(tx):
    return X.of_ends(X.prepared(tx), v=[f"in_{c}" for c in VEL])


@on_transfers(_far_velocity("v_out", "out"))
def vel_query_rows_out(tx):
    return X.of_ends(X.prepared(tx), v=[f"out_{c}" for c in VEL])


@on_transfers(_far_velocity("u_in", "in"))
def vel_query_rows_in(tx):
    return X.of_ends(X.prepared(tx), u=[f"in_{c}" for c in VEL])


@on_transfers(f"""WITH {EV} SELECT row_id,
 round(ln(1 + coalesce(CAST(sum(usd_c) {frame('src', P.short)} AS BIGINT), 0) / 100.0::DOUBLE), 6) AS u_out_sum_1d, round(ln(1 + coalesce(CAST(sum(usd_c) {frame('src', P.long)} AS BIGINT), 0) / 100.0::DOUBLE), 6) AS u_out_sum_3d,
 round(ln(1 + coalesce(CAST(sum(usd_c) {frame('dst', P.short)} AS BIGINT), 0) / 100.0::DOUBLE), 6) AS v_in_sum_1d, round(ln(1 + coalesce(CAST(sum(usd_c) {frame('dst', P.long)} AS BIGINT), 0) / 100.0::DOUBLE), 6) AS v_in_sum_3d FROM ev""")
def amt_sums(tx):
    both = X.of_ends(X.prepared(tx), ["out_sum_s", "out_sum_l"], ["in_sum_s", "in_sum_l"])
    return both.select("row_id", *(F.round(X.log_cents(f"{e}_sum_{k}"), 6).alias(f"{e}_sum_{n}") for e in ("u_out", "v_in") for k, n in (("s", "1d"), ("l", "3d"))))


def _moments(by: str, end: str) -> str:
    out = []
    for k, w in (("1d", P.short), ("3d", P.long)):
        n, s, q = (f"{f} {frame(by, w)}" for f in ("count(*)", "sum(lq)", "sum(l2q)"))
        m = f"(CAST({s} AS DOUBLE) / {S.LOG_UNIT}.0::DOUBLE / {n})"
        out.append(f"CASE WHEN {n} > 0 THEN round({m}, 4) END AS {end}_mean_{k}, CASE WHEN {n} > 0 THEN round(sqrt(greatest(CAST({q} AS DOUBLE) / {S.LOG_UNIT}.0::DOUBLE / {n} - {m} * {m}, 0.0)), 3) END AS {end}_std_{k}")
    return ", ".join(out)


@on_transfers(f"WITH {EV} SELECT row_id, {_moments('src', 'u_out')}, {_moments('dst', 'v_in')} FROM ev")
def amt_moments(tx):
    need = ["cnt_s", "cnt_l", *X.MOMENTS]
    m = X.of_ends(X.prepared(tx), [f"out_{c}" for c in need], [f"in_{c}" for c in need])
    out = [F.col("row_id")]
    for e in ("u_out", "v_in"):
        for k, n in (("s", "1d"), ("l", "3d")):
            out += [F.round(X.mean(f"{e}_cnt_{k}", f"{e}_lq_{k}"), 4).alias(f"{e}_mean_{n}"), F.round(X.std(f"{e}_cnt_{k}", f"{e}_lq_{k}", f"{e}_l2q_{k}"), 3).alias(f"{e}_std_{n}")]
    return m.select(*out)


@on_transfers(f"""WITH {EV} SELECT row_id, round(max(l) {frame('src', P.short)}, 6) AS u_out_max_1d, round(max(l) {frame('dst', P.short)}, 6) AS v_in_max_1d,
 round(l - CAST(sum(lq) {frame('src', P.short)} AS DOUBLE) / {S.LOG_UNIT}.0::DOUBLE / count(*) {frame('src', P.short)}, 4) + 0.0 AS u_amt_dev_1d,
 round(l - CAST(sum(lq) {frame('dst', P.short)} AS DOUBLE) / {S.LOG_UNIT}.0::DOUBLE / count(*) {frame('dst', P.short)}, 4) + 0.0 AS v_amt_dev_1d FROM ev""")
def amt_max_dev(tx):
    need = ["cnt_s", "lq_s", "max_s"]
    m = X.of_ends(X.prepared(tx), [f"out_{c}" for c in need], [f"in_{c}" for c in need], ["l"])
    dev = lambda e: F.round(F.col("l") - X.mean(f"{e}_cnt_s", f"{e}_lq_s"), 4) + 0.0
    return m.select("row_id", F.round("u_out_max_s", 6).alias("u_out_max_1d"), F.round("v_in_max_s", 6).alias("v_in_max_1d"), dev("u_out").alias("u_amt_dev_1d"), dev("v_in").alias("v_amt_dev_1d"))


@on_transfers(f"""WITH {EV} SELECT row_id, count(*) {frame('src, dst', P.short)} AS pair_cnt_1d, count(*) {frame('src, dst', P.long)} AS pair_cnt_3d,
 {gap_sql("max(minute) " + frame('src, dst', 'UNBOUNDED'))} AS pair_gap, CAST(is_new AS INTEGER) AS pair_is_new FROM ev""")
def flow_pair(tx):
    t = X.prepared(tx)
    p = t.select("row_id", "src", "dst", "minute").join(TL.pair_minutes(t, P), ["src", "dst", "minute"])
    is_new = F.col("minute") == F.col("first_min")
    return p.select("row_id", F.col("pair_cnt_s").alias("pair_cnt_1d"), F.col("pair_cnt_l").alias("pair_cnt_3d"), S.capped_gap(F.col("minute"), F.col("pair_last"), P.cap_gap).alias("pair_gap"), is_new.cast("int").alias("pair_is_new"))


@on_transfers(f"""WITH {EV}, {both_ends('in', f"row_id, coalesce(CAST(sum(nsl_c) {frame('acct', P.pass_through)} AS BIGINT), 0) AS inflow_c")}
 SELECT row_id, inflow_c, round(ln(1 + inflow_c / 100.0::DOUBLE), 6) AS u_inflow_12h, CASE WHEN NOT self_loop AND inflow_c > 0 THEN round(usd_c / CAST(inflow_c AS DOUBLE), 6) END AS pt_ratio_12h FROM far JOIN ev USING (row_id)""")
def flow_inflow(tx):
    i = X.of_ends(X.prepared(tx), u=["in_inflow_c"], keep=["usd_c", "self_loop"])
    ratio = F.when(~F.col("self_loop") & (F.col("u_in_inflow_c") > 0), F.round(F.col("usd_c") / F.col("u_in_inflow_c"), 6))
    return i.select("row_id", F.col("u_in_inflow_c").alias("inflow_c"), F.round(X.log_cents("u_in_inflow_c"), 6).alias("u_inflow_12h"), ratio.alias("pt_ratio_12h"))


def _balance(end: str, own: str, far: str) -> str:
    return f"CASE WHEN {own} + {far} > 0 THEN round(({own} - {far}) / CAST({own} + {far} AS DOUBLE), 6) + 0.0 END AS {end}_bal_3d"


@on_transfers(f"""WITH {EV}, o AS (SELECT row_id, coalesce(CAST(sum(usd_c) {frame('src', P.long)} AS BIGINT), 0) AS uo, coalesce(CAST(sum(usd_c) {frame('dst', P.long)} AS BIGINT), 0) AS vi FROM ev),
 s AS (SELECT src AS a, minute, usd_c AS out_c, NULL AS in_c, NULL::BIGINT AS row_id, 0 AS k FROM ev UNION ALL SELECT dst, minute, NULL, usd_c, NULL, 0 FROM ev
  UNION ALL SELECT src, minute, NULL, NULL, row_id, 1 FROM ev UNION ALL SELECT dst, minute, NULL, NULL, row_id, 2 FROM ev),
 w AS (SELECT row_id, k, coalesce(CAST(sum(out_c) {frame('a', P.long)} AS BIGINT), 0) AS o_c, coalesce(CAST(sum(in_c) {frame('a', P.long)} AS BIGINT), 0) AS i_c FROM s QUALIFY row_id IS NOT NULL)
 SELECT u.row_id, {_balance('u', 'u.o_c', 'u.i_c')}, {_balance('v', 'v.o_c', 'v.i_c')} FROM w u JOIN w v ON u.row_id = v.row_id AND u.k = 1 AND v.k = 2""")
def flow_balance(tx):
    s = X.of_ends(X.prepared(tx), ["out_sum_l", "in_sum_l"], ["out_sum_l", "in_sum_l"])
    bal = lambda e: F.when(F.col(f"{e}_out_sum_l") + F.col(f"{e}_in_sum_l") > 0, F.round((F.col(f"{e}_out_sum_l") - F.col(f"{e}_in_sum_l")) / (F.col(f"{e}_out_sum_l") + F.col(f"{e}_in_sum_l")), 6) + 0.0)
    return s.select("row_id", bal("u").alias("u_bal_3d"), bal("v").alias("v_bal_3d"))


@on_transfers("""WITH p AS (SELECT src, dst, min(minute) AS first_min FROM tx GROUP BY ALL)
 SELECT p.src, p.dst, p.first_min, (SELECT count(*) FROM p q WHERE q.src = p.src AND q.first_min < p.first_min) AS port_out, (SELECT count(*) FROM p q WHERE q.dst = p.dst AND q.first_min < p.first_min) AS port_in FROM p""")
def ports(tx):
    return X.ports(X.prepared(tx))


@on_transfers("""WITH f AS (SELECT src, dst, min(minute * 1000000000 + row_id) AS f FROM tx GROUP BY ALL) SELECT src, dst, CAST(row_number() OVER (PARTITION BY dst ORDER BY f) - 1 AS INTEGER) AS port FROM f""")
def ports_ordinal(tx):
    return G.ordinal_ports(tx)


@on_transfers(f"""WITH {EV}, s AS (SELECT src AS a, minute, 1 AS o, 0 AS i, NULL::BIGINT AS row_id, 0 AS k FROM ev UNION ALL SELECT dst, minute, 0, 1, NULL, 0 FROM ev UNION ALL SELECT src, minute, 0, 0, row_id, 1 FROM ev UNION ALL SELECT dst, minute, 0, 0, row_id, 2 FROM ev),
 w AS (SELECT row_id, k, {gap_sql("max(CASE WHEN o = 1 THEN minute END) " + frame('a', 'UNBOUNDED'))} AS og, {gap_sql("max(CASE WHEN i = 1 THEN minute END) " + frame('a', 'UNBOUNDED'))} AS ig FROM s QUALIFY row_id IS NOT NULL)
 SELECT u.row_id, u.og AS u_out_gap, u.ig AS u_in_gap, v.ig AS v_in_gap, v.og AS v_out_gap FROM w u JOIN w v ON u.row_id = v.row_id AND u.k = 1 AND v.k = 2""")
def gaps(tx):
    s = X.of_ends(X.prepared(tx), ["out_last", "in_last"], ["out_last", "in_last"], ["minute"])
    return s.select("row_id", *(S.capped_gap(F.col("minute"), F.col(f"{e}_last"), P.cap_gap).alias(f"{e}_gap") for e in ("u_out", "u_in", "v_in", "v_out")))


@on_transfers(f"""WITH {EV} SELECT row_id, CAST(in_band AS INTEGER) AS in_band, count(*) FILTER (WHERE in_band) {frame('src', P.short)} AS u_out_inband_1d,
 count(*) FILTER (WHERE is_round) {frame('src', P.short)} AS u_out_round_1d, count(*) FILTER (WHERE is_new) {frame('src', P.short)} AS u_out_newcp_1d FROM ev""")
def rule_support_counts(tx):
    s = X.of_ends(X.prepared(tx), u=["out_n_in_band", "out_n_is_round", "out_n_is_new"], keep=["in_band"])
    return s.select("row_id", F.col("in_band").cast("int").alias("in_band"), F.col("u_out_n_in_band").alias("u_out_inband_1d"), F.col("u_out_n_is_round").alias("u_out_round_1d"), F.col("u_out_n_is_new").alias("u_out_newcp_1d"))


@on_transfers(f"WITH {EV} SELECT row_id, " + ", ".join(f"count(*) FILTER (WHERE fmt = {k}) {frame('src', P.short)} AS u_out_fmt_{f}_1d" for k, f in enumerate(P.formats)) + " FROM ev")
def fmt_counts(tx):
    s = X.of_ends(X.prepared(tx), u=[f"out_n_fmt_{k}" for k in range(len(P.formats))])
    return s.select("row_id", *(F.col(f"u_out_n_fmt_{k}").alias(f"u_out_fmt_{f}_1d") for k, f in enumerate(P.formats)))


@on_transfers(f"WITH {EV} SELECT row_id, CASE WHEN fmt < 0 THEN 0 ELSE count(*) {frame('dst, fmt', P.short)} END AS v_in_same_fmt FROM ev")
def same_fmt(tx):
    s = X.of_ends(X.prepared(tx), v=[f"in_n_fmt_{k}" for k in range(len(P.formats))], keep=["fmt"])
    return s.select("row_id", X.same_format().alias("v_in_same_fmt"))


@on_transfers(f"""WITH {EV}, s AS (SELECT src AS a, minute, dst AS o, NULL AS i, NULL::BIGINT AS row_id, 0 AS k FROM ev UNION ALL SELECT dst, minute, NULL, src, NULL, 0 FROM ev UNION ALL SELECT src, minute, NULL, NULL, row_id, 1 FROM ev UNION ALL SELECT dst, minute, NULL, NULL, row_id, 2 FROM ev),
 w AS (SELECT row_id, k, least(count(DISTINCT o) {frame('a', P.short)}, count(DISTINCT i) {frame('a', P.short)}) AS gs FROM s QUALIFY row_id IS NOT NULL)
 SELECT u.row_id, u.gs AS gs_u_1d, v.gs AS gs_v_1d FROM w u JOIN w v ON u.row_id = v.row_id AND u.k = 1 AND v.k = 2""")
def gather_scatter(tx):
    s = X.of_ends(X.prepared(tx), ["out_uniq_s", "in_uniq_s"], ["out_uniq_s", "in_uniq_s"])
    return s.select("row_id", *(F.least(f"{e}_in_uniq_s", f"{e}_out_uniq_s").alias(f"gs_{e}_1d") for e in "uv"))


@on_transfers(f"""WITH {EV} SELECT row_id, round(l, 6) AS log_amount_usd, CAST(list_position(['Euro','US Dollar','Yen'], payment_currency) - 1 AS INTEGER) AS payment_currency, CAST(list_position(['Euro','US Dollar','Yen'], receiving_currency) - 1 AS INTEGER) AS receiving_currency,
 CAST(payment_currency <> receiving_currency AS INTEGER) AS cross_currency, CAST(fmt AS INTEGER) AS payment_format, CAST(self_loop AS INTEGER) AS self_loop, CAST(from_bank = to_bank AS INTEGER) AS same_bank, CAST(is_round AS INTEGER) AS round_amount, (minute % 1440) // 60 AS hour_of_day FROM ev""")
def tx_features(tx):
    t = X.prepared(tx)
    money = ["Euro", "US Dollar", "Yen"]
    flag = lambda c: c.cast("int")
    return t.select("row_id", F.round("l", 6).alias("log_amount_usd"), S.code_in(F.col("payment_currency"), money).alias("payment_currency"), S.code_in(F.col("receiving_currency"), money).alias("receiving_currency"), flag(F.col("payment_currency") != F.col("receiving_currency")).alias("cross_currency"), F.col("fmt").alias("payment_format"), flag(F.col("self_loop")).alias("self_loop"), flag(F.col("from_bank") == F.col("to_bank")).alias("same_bank"), flag(F.col("is_round")).alias("round_amount"), F.expr("(minute % 1440) div 60").alias("hour_of_day"))


HUBS = f"""e AS (SELECT row_id, src, dst, minute FROM tx WHERE src <> dst),
 deg AS (SELECT acct, count(*) AS deg FROM (SELECT src AS acct FROM tx WHERE split = 'train' UNION ALL SELECT dst FROM tx WHERE split = 'train') GROUP BY acct),
 hub AS (SELECT acct FROM deg WHERE deg > (SELECT quantile_disc(deg, {P.hub_quantile}) FROM deg))"""


@on_transfers(f"WITH {HUBS} SELECT quantile_disc(deg, {P.hub_quantile}) AS cap FROM deg")
def hub_degree_cap(tx):
    return G.hub_cap(tx, P.hub_quantile)


@on_transfers(f"WITH {HUBS} SELECT acct FROM hub")
def hub_accounts(tx):
    return G.hubs(tx)


#: Literal joins of transfers with every path in their window.
CYCLES = f"""WITH {HUBS}, p2 AS (SELECT a.src AS a, b.dst AS b, a.minute AS t1, b.minute AS t2 FROM e a JOIN e b ON a.dst = b.src AND b.minute BETWEEN a.minute AND a.minute + {P.hop} WHERE a.src <> b.dst AND a.dst NOT IN (SELECT acct FROM hub)),
 p3 AS (SELECT a.src AS a, c.dst AS b, a.minute AS t1, c.minute AS t2 FROM e a JOIN e b ON a.dst = b.src AND b.minute BETWEEN a.minute AND a.minute + {P.hop} JOIN e c ON b.dst = c.src AND c.minute BETWEEN b.minute AND b.minute + {P.hop}
  WHERE a.src <> b.dst AND a.src <> c.dst AND a.dst <> c.dst AND a.dst NOT IN (SELECT acct FROM hub) AND b.dst NOT IN (SELECT acct FROM hub)),
 n AS (SELECT t.row_id, (SELECT count(*) FROM e p WHERE p.src = t.dst AND p.dst = t.src AND p.minute BETWEEN t.minute - {P.round_trip} AND t.minute - 1 AND NOT t.self_loop) AS n2,
  (SELECT count(*) FROM p2 p WHERE p.a = t.dst AND p.b = t.src AND p.t1 >= t.minute - {P.round_trip} AND p.t2 <= t.minute - 1) AS n3,
  (SELECT count(*) FROM p3 p WHERE p.a = t.dst AND p.b = t.src AND p.t1 >= t.minute - {P.round_trip} AND p.t2 <= t.minute - 1) AS n4 FROM tx t)"""


@on_transfers(CYCLES + f" SELECT row_id, least(n2, {P.cap_count}) AS cyc2, least(n3, {P.cap_count}) AS cyc3, least(n4, {P.cap_count}) AS cyc4, least(n2 + n3, {P.cap_count}) AS round_trip FROM n")
def cycles(tx):
    return G.cycle_counts(tx)


@on_transfers(f"""WITH {HUBS}, xs AS (SELECT DISTINCT t.row_id, xv.src AS x, sx.src AS s FROM e t JOIN e xv ON xv.dst = t.dst AND xv.minute BETWEEN t.minute - {P.scatter} AND t.minute - 1 AND xv.src NOT IN (t.src, t.dst)
  JOIN e sx ON sx.dst = xv.src AND sx.minute BETWEEN t.minute - {P.scatter} AND t.minute - 1 JOIN e su ON su.dst = t.src AND su.src = sx.src AND su.minute BETWEEN t.minute - {P.scatter} AND t.minute - 1
  WHERE sx.src <> t.dst AND sx.src NOT IN (SELECT acct FROM hub))
 SELECT row_id, least(count(DISTINCT x), {P.cap_count}) AS sg_mids, least(count(DISTINCT s), {P.cap_count}) AS sg_srcs FROM xs GROUP BY row_id""")
def sg_counts(tx):
    return G.scatter_gather(tx)


SEVERITIES = f"""{CYCLES}, {EV},
 s AS (SELECT dst AS acct, minute, usd_c AS in_c, NULL::BIGINT AS row_id FROM ev WHERE NOT self_loop UNION ALL SELECT src, minute, NULL, row_id FROM ev WHERE NOT self_loop),
 w AS (SELECT row_id, sum(in_c) {frame('acct', P.pass_through)} AS in_c FROM s QUALIFY row_id IS NOT NULL),
 sev AS (SELECT ev.row_id, ev.split, ev.day, CAST(count(DISTINCT src) {frame('dst', P.short)} AS DOUBLE) AS fan_in_velocity,
  CAST(CASE WHEN src IN (SELECT acct FROM hub) THEN 0 ELSE count(DISTINCT dst) {frame('src', P.short)} END AS DOUBLE) AS fan_out_velocity,
  coalesce(CASE WHEN w.in_c > 0 THEN greatest(0.0, 1.0 - abs(CAST(usd_c AS DOUBLE) / CAST(w.in_c AS DOUBLE) - 1.0)) END, 0.0)::DOUBLE AS rapid_pass_through,
  CAST(least(n2 + n3, {P.cap_count}) AS DOUBLE) AS round_trip,
  CAST(CASE WHEN in_band AND src NOT IN (SELECT acct FROM hub) THEN 1 + count(*) FILTER (WHERE in_band) {frame('src', P.short)} ELSE 0 END AS DOUBLE) AS structuring,
  CAST(CASE WHEN is_round AND src NOT IN (SELECT acct FROM hub) THEN 1 + count(*) FILTER (WHERE is_round) {frame('src', P.short)} ELSE 0 END AS DOUBLE) AS round_amount_burst,
  CAST(CASE WHEN high_risk AND src NOT IN (SELECT acct FROM hub) THEN 1 + count(*) FILTER (WHERE high_risk) {frame('src', P.short)} ELSE 0 END AS DOUBLE) AS high_risk_format_burst
  FROM ev LEFT JOIN w USING (row_id) JOIN n USING (row_id))"""


@on_transfers(SEVERITIES + " SELECT * REPLACE (round(rapid_pass_through, 9) AS rapid_pass_through) FROM sev")
def severities(tx):
    return R.severities(tx).withColumn("rapid_pass_through", F.round("rapid_pass_through", 9))


THRESHOLDS = {"fan_in_velocity": 8.0, "fan_out_velocity": 7.0, "rapid_pass_through": 0.95, "round_trip": 2.0, "structuring": 2.0, "round_amount_burst": 3.0, "high_risk_format_burst": None}


@on_transfers(SEVERITIES + " SELECT row_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} >= {t} AND {c} > 0 THEN '{c}' END" for c, t in THRESHOLDS.items() if t) + "], lambda x: x IS NOT NULL), ',') AS fired, " + " OR ".join(f"({c} >= {t} AND {c} > 0)" for c, t in THRESHOLDS.items() if t) + " AS rules_any FROM sev")
def apply_thresholds(tx):
    return R.apply_thresholds(R.severities(tx), THRESHOLDS).select("row_id", F.array_join("fired", ",").alias("fired"), "rules_any")


@query()
def rule_tuning(spark, sf_dir):
    tx = T.transfers(spark, sf_dir)
    grid = {"fan_in_velocity": [4.0, 6.0, 8.0], "round_amount_burst": [1.0, 2.0, 3.0], "rapid_pass_through": [0.9, 0.99], "high_risk_format_burst": [3.0, 5.0]}
    best = R.tune(R.severities(tx), T.labels(tx).select("row_id", "is_laundering"), 0.02, grid)
    return spark.createDataFrame([(c, t) for c, t in best.items()], "scenario string, threshold double")


@on_transfers(CYCLES + " SELECT (SELECT count(*) FROM tx) AS rows, (SELECT count(*) FROM hub) AS hubs, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM e)) AS closed_pairs, (SELECT count(*) FROM p2 WHERE (b, a) IN (SELECT (src, dst) FROM e)) AS candidate_paths")
def severity_stats(tx):
    return R.severity_stats(tx)


def _whole_row() -> str:
    """The groups' oracles, which are written as plain frames and joins, side by side."""
    by_row = ["tx_features", "vel_sender", "vel_receiver", "vel_query_rows_out", "vel_query_rows_in", "amt_sums", "amt_moments", "amt_max_dev", "flow_pair", "flow_inflow", "flow_balance", "gaps", "gather_scatter", "rule_support_counts", "fmt_counts", "same_fmt", "cycles"]
    far = ", ".join(f"round(ln(1 + coalesce(CAST(sum(c) {frame('a', w)} AS BIGINT), 0) / 100.0::DOUBLE), 6) AS s_{k}" for k, w in (("1d", P.short), ("3d", P.long)))
    far_sums = lambda own, other: f"(WITH {T.SQL}, s AS (SELECT {own} AS a, minute, usd_c AS c, NULL::BIGINT AS row_id FROM tx UNION ALL SELECT {other}, minute, NULL, row_id FROM tx) SELECT row_id, {far} FROM s QUALIFY row_id IS NOT NULL)"
    rev = f"(WITH {T.SQL}, s AS (SELECT src AS a, dst AS b, minute, minute AS t, NULL::BIGINT AS row_id FROM tx UNION ALL SELECT dst, src, minute, NULL, row_id FROM tx), l AS (SELECT row_id, minute, max(t) {frame('a, b', 'UNBOUNDED')} AS last FROM s QUALIFY row_id IS NOT NULL) SELECT row_id, {gap_sql('last')} AS rev_pair_gap FROM l)"
    pick = ["t.row_id", "t.day", "t.split", "tx_features.* EXCLUDE (row_id)"]
    names = {"vel_sender": "u_out", "vel_receiver": "v_in", "vel_query_rows_out": "v_out", "vel_query_rows_in": "u_in"}
    for q, end in names.items():
        pick += [f"{q}.{end}_{c}_{k} AS {end}_{c}_{tag}" for c in ("cnt", "uniq") for k, tag in (("s", "1d"), ("l", "3d"))]
    pick += [f"{q}.* EXCLUDE (row_id)" for q in ("amt_sums", "amt_moments", "amt_max_dev", "flow_pair", "flow_balance", "gaps", "gather_scatter", "rule_support_counts", "fmt_counts")]
    pick += ["o.s_1d AS v_out_sum_1d", "o.s_3d AS v_out_sum_3d", "i.s_1d AS u_in_sum_1d", "i.s_3d AS u_in_sum_3d", "flow_inflow.inflow_c", "flow_inflow.u_inflow_12h", "flow_inflow.pt_ratio_12h"]
    pick += [f"round(ln(1 + least(ports.port_{k}, {P.cap_port})), 6) AS {k}_port" for k in ("out", "in")] + ["r.rev_pair_gap", "same_fmt.v_in_same_fmt AS v_in_same_fmt_1d"]
    pick += [f"cycles.cyc{k} AS cyc{k}_2d" for k in (2, 3, 4)] + [f"coalesce(sg_counts.sg_{k}, 0) AS sg_{k}_1d" for k in ("mids", "srcs")] + [f"severities.{c} AS sev_{c}" for c in R.SCENARIOS]
    joins = " ".join(f"JOIN ({ORACLES[q]}) {q} ON {q}.row_id = t.row_id" for q in [*by_row, "severities"])
    return f"""SELECT {', '.join(pick)} FROM tx t {joins} LEFT JOIN ({ORACLES['sg_counts']}) sg_counts ON sg_counts.row_id = t.row_id
 JOIN ({ORACLES['ports']}) ports ON ports.src = t.src AND ports.dst = t.dst JOIN {far_sums('src', 'dst')} o ON o.row_id = t.row_id JOIN {far_sums('dst', 'src')} i ON i.row_id = t.row_id JOIN {rev} r ON r.row_id = t.row_id"""


#: Digits that two engines' logarithms and roots agree to.
DIGITS = {"_mean_": 4, "_std_": 3, "_amt_dev_": 4, "sev_rapid": 9}


@query(_whole_row())
def feature_table(spark, sf_dir):
    f = feature_row(T.transfers(spark, sf_dir))
    doubles = [c for c, t in f.dtypes if t == "double"]
    digits = lambda c: next((n for part, n in DIGITS.items() if part in c), 6)
    return f.withColumns({c: F.round(c, digits(c)) + 0.0 for c in doubles})
