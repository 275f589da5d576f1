"""The whole feature row of every transfer."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions import scalars as S
from causeway.operators import features as X
from causeway.operators import graph as G
from causeway.operators import rules as R
from causeway.operators.features import P, Params
from causeway.sources import store


def feature_table(tx: DataFrame, p: Params = P) -> DataFrame:
    """One row per transfer: the features under their public names, null where undefined; then, never inputs of a model, the
    severities as sev_* and the sender's inflow in cents. Transfers are prepared and written once; everything else reads that."""
    t = store.written(X.prepared(tx, p))
    graph = G.prepared(t, p)
    with ThreadPoolExecutor(3) as side_by_side:  # their jobs share the executors
        parts = [side_by_side.submit(f) for f in (lambda: X.features(t, p), lambda: store.written(G.cycle_counts(t, p, graph)), lambda: store.written(G.scatter_gather(t, p, graph)))]
    f, cycles, siblings = (x.result() for x in parts)
    f = f.join(cycles, "row_id").join(siblings, "row_id", "left")
    f = f.join(graph.hubs.select(F.col("acct").alias("src"), F.lit(True).alias("hub")), "src", "left").withColumn("hub", F.coalesce("hub", F.lit(False)))
    s, long, trip, scatter, through = (S.window_tag(w) for w in (p.short, p.long, p.round_trip, p.scatter, p.pass_through))
    tags = {"s": s, "l": long}
    c = {k: F.col(k) for k in ("row_id", "day", "split")}
    c["log_amount_usd"] = F.col("l")
    for side in ("payment", "receiving"):
        c[f"{side}_currency"] = S.code_in(F.col(f"{side}_currency"), list(p.currencies))
    c["cross_currency"] = (F.col("payment_currency") != F.col("receiving_currency")).cast("int")
    c["payment_format"] = F.col("fmt")
    c["self_loop"] = F.col("self_loop").cast("int")
    c["same_bank"] = (F.col("from_bank") == F.col("to_bank")).cast("int")
    c["round_amount"] = F.col("is_round").cast("int")
    c["hour_of_day"] = F.expr("(minute % 1440) div 60")
    for end in ("u_out", "u_in", "v_in", "v_out"):
        for k, tag in tags.items():
            c[f"{end}_cnt_{tag}"], c[f"{end}_uniq_{tag}"], c[f"{end}_sum_{tag}"] = F.col(f"{end}_cnt_{k}"), F.col(f"{end}_uniq_{k}"), X.log_cents(f"{end}_sum_{k}")
    for end, one in (("u_out", "u"), ("v_in", "v")):
        for k, tag in tags.items():
            c[f"{end}_mean_{tag}"] = X.mean(f"{end}_cnt_{k}", f"{end}_lq_{k}")
            c[f"{end}_std_{tag}"] = X.std(f"{end}_cnt_{k}", f"{end}_lq_{k}", f"{end}_l2q_{k}")
        c[f"{end}_max_{s}"] = F.col(f"{end}_max_s")
        c[f"{one}_amt_dev_{s}"] = F.col("l") - X.mean(f"{end}_cnt_s", f"{end}_lq_s")
    c[f"pair_cnt_{s}"], c[f"pair_cnt_{long}"] = F.col("pair_cnt_s"), F.col("pair_cnt_l")
    c[f"u_inflow_{through}"] = X.log_cents("u_in_inflow_c")
    c[f"pt_ratio_{through}"] = F.when(~F.col("self_loop") & (F.col("u_in_inflow_c") > 0), F.col("usd_c") / F.col("u_in_inflow_c"))
    for one in "uv":
        a, b = F.col(f"{one}_out_sum_l"), F.col(f"{one}_in_sum_l")
        c[f"{one}_bal_{long}"] = F.when(a + b > 0, (a - b) / (a + b))
    c["pair_is_new"] = F.col("is_new").cast("int")
    for k in ("out", "in"):
        c[f"{k}_port"] = F.log1p(F.least(F.col(f"port_{k}"), F.lit(p.cap_port)).cast("double"))
    for name, last in (("u_out", "u_out_last"), ("u_in", "u_in_last"), ("v_in", "v_in_last"), ("v_out", "v_out_last"), ("pair", "pair_last"), ("rev_pair", "rev_last")):
        c[f"{name}_gap"] = S.capped_gap(F.col("minute"), F.col(last), p.cap_gap)
    for k in (2, 3, 4):
        c[f"cyc{k}_{trip}"] = F.col(f"cyc{k}")
    for k in ("mids", "srcs"):
        c[f"sg_{k}_{scatter}"] = F.coalesce(f"sg_{k}", F.lit(0))
    for one in "uv":
        c[f"gs_{one}_{s}"] = F.least(f"{one}_in_uniq_s", f"{one}_out_uniq_s")
    c["in_band"] = F.col("in_band").cast("int")
    c |= {f"u_out_inband_{s}": F.col("u_out_n_in_band"), f"u_out_round_{s}": F.col("u_out_n_is_round"), f"u_out_newcp_{s}": F.col("u_out_n_is_new")}
    for k, name in enumerate(p.formats):
        c[f"u_out_fmt_{S.slug(name)}_{s}"] = F.col(f"u_out_n_fmt_{k}")
    c[f"v_in_same_fmt_{s}"] = F.col("v_in_same_fmt")
    c |= {f"sev_{k}": v.cast("double") for k, v in R.severity_columns(F.col("hub")).items()}
    c["inflow_c"] = F.col("u_in_inflow_c")
    return f.select(*(v.alias(k) for k, v in c.items()))
