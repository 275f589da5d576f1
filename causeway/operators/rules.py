"""The seven monitoring rules as severities, their application and the tuning of their thresholds."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators import features as X
from causeway.operators import graph as G
from causeway.operators.features import P, Params
from causeway.sources import store

SCENARIOS = ["fan_in_velocity", "fan_out_velocity", "rapid_pass_through", "round_trip", "structuring", "round_amount_burst", "high_risk_format_burst"]


def severity_columns(hub: Column) -> dict[str, Column]:
    """Each scenario's severity, from a prepared transfer with the state of its ends and its round trips; hub: whether its sender is one that
    is left out of the sender's scenarios."""
    burst = lambda flag, n: F.when(F.col(flag) & ~hub, F.col(n) + 1).otherwise(0)
    share = F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("usd_c") / F.col("u_in_inflow_c") - 1.0))
    return {
        "fan_in_velocity": F.col("v_in_uniq_s"),
        "fan_out_velocity": F.when(hub, 0).otherwise(F.col("u_out_uniq_s")),
        "rapid_pass_through": F.when(~F.col("self_loop") & (F.col("u_in_inflow_c") > 0), share).otherwise(0.0),
        "round_trip": F.col("round_trip"),
        "structuring": burst("in_band", "u_out_n_in_band"),
        "round_amount_burst": burst("is_round", "u_out_n_is_round"),
        "high_risk_format_burst": burst("high_risk", "u_out_n_high_risk"),
    }


def severities(tx: DataFrame, p: Params = P, hub_senders_excluded: bool = True) -> DataFrame:
    """row_id, split, day and one double for each scenario, for every transfer."""
    t = store.written(X.prepared(tx, p))
    graph = G.prepared(t, p)
    sender = ["out_uniq_s", "out_n_in_band", "out_n_is_round", "out_n_high_risk", "in_inflow_c"]
    s = X.of_ends(t, sender, ["in_uniq_s"], ["split", "day", "src", "usd_c", "self_loop", "in_band", "is_round", "high_risk"], p)
    s = s.join(G.cycle_counts(t, p, graph).select("row_id", "round_trip"), "row_id")
    hubs = graph.hubs.select(F.col("acct").alias("src"), F.lit(True).alias("hub"))  # a share of all accounts: Spark sees to its size
    s = s.join(hubs, "src", "left")
    columns = severity_columns(F.coalesce("hub", F.lit(False)) & F.lit(hub_senders_excluded))
    return s.select("row_id", "split", "day", *(columns[c].cast("double").alias(c) for c in SCENARIOS))


def severity_stats(tx: DataFrame, p: Params = P) -> DataFrame:
    """One row: transfers, hubs, distinct pairs that some transfer closes, and the paths of two edges that could close a cycle."""
    graph = G.prepared(tx, p)
    two, _ = G.paths(graph, p.hop, three=False)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [count(tx, "rows"), count(graph.hubs, "hubs"), count(graph.closed, "closed_pairs"), count(two, "candidate_paths")]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # one row each


def apply_thresholds(sev: DataFrame, thresholds: dict[str, float | None]) -> DataFrame:
    """Adds fired_<scenario> (severity at the threshold or over, and over 0; never without a threshold), fired and rules_any."""
    fires = {c: (F.col(c) >= t) & (F.col(c) > 0) if t is not None else F.lit(False) for c, t in thresholds.items()}
    names = F.array_compact(F.array(*(F.when(f, F.lit(c)) for c, f in fires.items())))
    out = sev.withColumns({f"fired_{c}": f for c, f in fires.items()}).withColumn("fired", names)
    return out.withColumn("rules_any", F.size("fired") > 0)


def tune(sev: DataFrame, positives: DataFrame, rate: float, grid: dict[str, list[float]], split: str = "val_late") -> dict[str, float | None]:
    """Greedy choice of thresholds under one alert budget for the union of all scenarios. The transfers are reduced to the
    distinct vectors of highest thresholds reached, with their numbers; at most the product of the grid's sizes
    comes to the driver, whatever the number of transfers."""
    cells = 1
    for values in grid.values():
        cells *= len(values) + 1
    if cells > 1_000_000:
        raise ValueError("the grid has too many cells")
    reached = lambda c, values: sum((F.when((F.col(c) >= v) & (F.col(c) > 0), 1).otherwise(0) for v in values), F.lit(0))
    level = {c: reached(c, values) for c, values in grid.items()}
    rows = sev.where(F.col("split") == split).join(positives, "row_id", "left").select(*(level[c].alias(c) for c in grid), F.coalesce("is_laundering", F.lit(0)).alias("y"))
    counted = [r.asDict() for r in rows.groupBy(*grid).agg(F.count("*").alias("n"), F.sum("y").alias("pos")).collect()]
    budget = int(rate * sum(r["n"] for r in counted) + 1e-6)
    chosen: dict[str, int | None] = dict.fromkeys(grid)
    covered = lambda pick: [r for r in counted if any(k is not None and r[c] >= k for c, k in pick.items())]
    best = (0, 0)
    while True:
        options = []
        for c, k in product(grid, range(1, max(len(v) for v in grid.values()) + 1)):
            if k > len(grid[c]) or (chosen[c] is not None and k >= chosen[c]):
                continue
            hit = covered({**chosen, c: k})
            n, pos = sum(r["n"] for r in hit), sum(r["pos"] for r in hit)
            if n <= budget and pos > best[1]:
                options.append(((pos - best[1]) / max(n - best[0], 1), pos, -n, c, k))
        if not options:
            return {c: None if k is None else sorted(grid[c])[k - 1] for c, k in chosen.items()}
        _, pos, n, c, k = max(options)
        chosen[c], best = k, (-n, pos)
