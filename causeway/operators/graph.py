"""Graph operators: hubs, temporal paths and cycles, scatter-gather, ports, neighbourhoods."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.operators import asof as A
from causeway.operators.features import P, Params
from causeway.operators.joins import band_join, last_before
from causeway.sources import store


def degrees(tx: DataFrame) -> DataFrame:
    """(acct, deg): transfers in and out; a self-loop counts twice."""
    return tx.select(F.explode(F.array("src", "dst")).alias("acct")).groupBy("acct").agg(F.count("*").alias("deg"))


def hub_cap(tx: DataFrame, q: float) -> DataFrame:
    """One row: the exact discrete q-quantile of the train degrees."""
    return degrees(tx.where("split = 'train'")).agg(F.expr(f"percentile_disc({q}) within group (order by deg)").alias("cap"))


def hubs(tx: DataFrame, q: float = P.hub_quantile) -> DataFrame:
    """(acct) with more than the cap's train degree."""
    return degrees(tx.where("split = 'train'")).crossJoin(F.broadcast(hub_cap(tx, q))).where("deg > cap").select("acct")


def edges(tx: DataFrame) -> DataFrame:
    return tx.where("src <> dst").select("row_id", "src", "dst", "minute")


def closed_pairs(e: DataFrame) -> DataFrame:
    """(a, b) such that some transfer goes from b to a: only paths from a to b can close a cycle."""
    return e.select(F.col("dst").alias("a"), F.col("src").alias("b")).distinct()


class Graph(NamedTuple):
    """What the searches for paths read over and over, each written once: edges between two accounts, hubs, and the closed pairs."""

    edges: DataFrame
    hubs: DataFrame
    closed: DataFrame


def prepared(tx: DataFrame, p: Params = P) -> Graph:
    e = store.written(edges(tx))
    return Graph(e, store.written(hubs(tx, p.hub_quantile)), store.written(closed_pairs(e)))


def paths(graph: Graph, hop: int, three: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Paths of two and of three edges over distinct accounts: each edge follows the one before within `hop` minutes,
    equal minutes allowed; no hub inside; parallel edges multiply. (a, b, t1, t2): first and last account and
    minute. Only paths that some transfer closes are kept."""
    e, h, closed = graph
    to_plain = e.join(h, e.dst == h.acct, "left_anti")
    from_plain = e.join(h, e.src == h.acct, "left_anti")
    first = to_plain.select(F.col("src").alias("a"), F.col("dst").alias("w"), F.col("minute").alias("t1"))
    last = from_plain.select(F.col("src").alias("s"), F.col("dst").alias("b"), F.col("minute").alias("t2"))
    two = band_join(first, last, [("w", "s")], "t1", "t2", 0, hop, condition=F.col("a") != F.col("b"))
    keep = lambda p: p.join(closed, ["a", "b"], "left_semi").select("a", "b", "t1", "t2")
    if not three:
        return keep(two), None
    middle = from_plain.join(h, from_plain.dst == h.acct, "left_anti").select(F.col("src").alias("s"), F.col("dst").alias("w2"), F.col("minute").alias("tm"))
    half = band_join(first, middle, [("w", "s")], "t1", "tm", 0, hop, condition=F.col("a") != F.col("w2")).select("a", "w", "w2", "t1", "tm")
    long = band_join(half, last, [("w2", "s")], "tm", "t2", 0, hop, condition=(F.col("a") != F.col("b")) & (F.col("w") != F.col("b")))
    return keep(two), keep(long)


def cycle_counts(tx: DataFrame, p: Params = P, graph: Graph | None = None) -> DataFrame:
    """(row_id, cyc2, cyc3, cyc4, round_trip): earlier paths from the receiver back to the sender, of one, two and three edges,
    with every edge in [m - R, m - 1]; 0 for a self-loop, capped.

    No transfer is joined with paths. As a path lasts at most (edges - 1) hops, which is at most R, the paths in
    the window are those that ended before m less those that began before m - R: two running sums over one
    stream for each pair.
    """
    graph = graph or prepared(tx, p)
    e, _, closed = graph
    two, three = paths(graph, p.hop)
    one = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("minute").alias("t1"), F.col("minute").alias("t2")).join(closed, ["a", "b"], "left_semi")
    parts = []
    for k, q in ((2, one), (3, two), (4, three)):
        parts.append(q.select("a", "b", F.col("t2").alias("minute"), F.lit(1).alias(f"ended{k}")))
        parts.append(q.select("a", "b", F.col("t1").alias("minute"), F.lit(1).alias(f"begun{k}")))
    query = e.select(F.col("dst").alias("a"), F.col("src").alias("b"), "minute", "row_id")
    s = A.union(query, *parts)
    by = ["a", "b"]
    ended = lambda k: F.coalesce(F.sum(f"ended{k}").over(A.upto(by, -1)), F.lit(0))
    begun = lambda k: F.coalesce(F.sum(f"begun{k}").over(A.upto(by, -p.round_trip - 1)), F.lit(0))
    s = s.withColumns({f"n{k}": ended(k) - begun(k) for k in (2, 3, 4)}).where("row_id is not null")
    cap = lambda c: F.least(c, F.lit(p.cap_count)).cast("long")
    found = s.select("row_id", *(cap(F.col(f"n{k}")).alias(f"cyc{k}") for k in (2, 3, 4)), cap(F.col("n2") + F.col("n3")).alias("round_trip"))
    zero = tx.where("src = dst").select("row_id", *(F.lit(0).cast("long").alias(c) for c in ("cyc2", "cyc3", "cyc4", "round_trip")))
    return found.unionByName(zero)


def scatter_gather(tx: DataFrame, p: Params = P, graph: Graph | None = None) -> DataFrame:
    """(row_id, sg_mids, sg_srcs) of transfers u -> v with at least one sibling: accounts x that paid v and were paid by a
    non-hub s that also paid u, all in the window; and the number of such s. Counts are capped."""
    (e, h, _), w = graph or prepared(tx, p), p.scatter
    seen = e.select("src", "dst", "minute").distinct()
    plain = seen.join(h, seen.src == h.acct, "left_anti")
    target = e.select("row_id", F.col("src").alias("u"), F.col("dst").alias("v"), F.col("minute").alias("m"))
    # most senders were paid by no one in the window: the transfers of the others are found first
    into_u = plain.select(F.col("src").alias("s"), F.col("dst").alias("u1"), F.col("minute").alias("t2"))
    su = band_join(target, into_u, [("u", "u1")], "m", "t2", -w, -1, condition=F.col("s") != F.col("v")).select(F.col("row_id").alias("r"), "s").distinct()
    target = target.join(su.select(F.col("r").alias("row_id")), "row_id", "left_semi")
    into_v = seen.select(F.col("src").alias("x"), F.col("dst").alias("v1"), F.col("minute").alias("t1"))
    xv = band_join(target, into_v, [("v", "v1")], "m", "t1", -w, -1, condition=(F.col("x") != F.col("u")) & (F.col("x") != F.col("v"))).select("row_id", "u", "v", "m", "x").distinct()
    into_x = plain.select(F.col("src").alias("s2"), F.col("dst").alias("x1"), F.col("minute").alias("t3"))
    sx = band_join(xv, into_x, [("x", "x1")], "m", "t3", -w, -1).select("row_id", "x", "s2").distinct()
    both = sx.join(su, (F.col("row_id") == F.col("r")) & (F.col("s") == F.col("s2")))
    return both.groupBy("row_id").agg(F.least(F.countDistinct("x"), F.lit(p.cap_count)).cast("long").alias("sg_mids"), F.least(F.countDistinct("s"), F.lit(p.cap_count)).cast("long").alias("sg_srcs"))


def ordinal_ports(tx: DataFrame) -> DataFrame:
    """(src, dst, port): the place of each sender among the receiver's senders by first transfer."""
    first = tx.groupBy("src", "dst").agg(F.min(F.struct("minute", "row_id")).alias("first"))
    return first.select("src", "dst", (F.row_number().over(Window.partitionBy("dst").orderBy("first")) - 1).alias("port"))


def neighbours(tx: DataFrame, nodes: DataFrame, window: int, k: int) -> DataFrame:
    """nodes: (case_id, node, minute). Of each node the newest k transfers in and out in [minute - window, minute - 1]:
    (case_id, node, direction, other, row_id, t)."""
    found = []
    for direction, at, other in (("out", "src", "dst"), ("in", "dst", "src")):
        rows = tx.select(F.col(at).alias("at"), F.col("minute").alias("t"), "row_id", F.col(other).alias("other"))
        found.append(last_before(rows, nodes, k, window).withColumn("direction", F.lit(direction)))
    return found[0].unionByName(found[1]).select("case_id", "node", "direction", "other", "row_id", "t")


def temporal_sample(tx: DataFrame, nodes: DataFrame, fan_out: tuple[int, ...] = (25, 10)) -> DataFrame:
    """nodes: (case_id, node, minute). Hop by hop the newest transfers into each node found so far, before its case's minute:
    (case_id, hop, node, neighbour, row_id, t). A node that several paths of a case reach is asked once a hop."""
    rows = tx.select(F.col("dst").alias("at"), F.col("minute").alias("t"), "row_id", F.col("src").alias("neighbour"))
    out, now = None, nodes.select("case_id", "node", "minute").distinct()
    for hop, k in enumerate(fan_out, 1):
        found = store.written(last_before(rows, now, k))
        step = found.select("case_id", F.lit(hop).alias("hop"), "node", "neighbour", "row_id", "t")
        out = step if out is None else out.unionByName(step)
        now = found.select("case_id", F.col("neighbour").alias("node"), "minute").distinct()
    return out


def case_subgraph(tx: DataFrame, alerts: DataFrame, window: int = 4320, k1: int = 10, k2: int = 4) -> DataFrame:
    """alerts: (case_id, u, v, minute). The distinct (case_id, row_id) of the newest transfers of both ends in both
    directions, and of those found, of their other ends' newest in the same direction."""
    ends = alerts.select("case_id", F.explode(F.array("u", "v")).alias("node"), "minute").distinct()
    one = neighbours(tx, ends, window, k1)
    next_nodes = one.select("case_id", F.col("other").alias("node"), "direction").distinct()
    next_nodes = next_nodes.join(ends.select("case_id", "node"), ["case_id", "node"], "left_anti")
    minutes = alerts.select("case_id", "minute")
    two = neighbours(tx, next_nodes.select("case_id", "node").distinct().join(minutes, "case_id"), window, k2)
    two = two.join(next_nodes, ["case_id", "node", "direction"], "left_semi")
    return one.select("case_id", "row_id").union(two.select("case_id", "row_id")).distinct()


def bidirected(tx: DataFrame) -> DataFrame:
    """Every transfer as an edge, and reversed unless it is a self-loop."""
    forward = tx.select("row_id", "src", "dst", F.lit(0).alias("reversed"))
    return forward.union(tx.where("src <> dst").select("row_id", "dst", "src", F.lit(1)))
