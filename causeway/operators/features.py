"""The per-transfer features: each transfer reads the state of its sender, its receiver and its pair before its
minute (timelines.py), and counts of paths (graph.py)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions import scalars as S
from causeway.operators import timelines as TL
from causeway.sources import store


@dataclass(frozen=True)
class Params:
    short: int = 1440
    long: int = 4320
    pass_through: int = 720
    round_trip: int = 2880
    hop: int = 1440
    scatter: int = 1440
    cap_count: int = 100
    cap_port: int = 16383
    cap_gap: int = 4320
    band: tuple[float, float] = (5000.0, 10000.0)
    round_cents: int = 1000
    high_risk: tuple[str, ...] = ("click", "error")
    formats: tuple[str, ...] = ("click", "error", "purchase", "signup", "view")
    currencies: tuple[str, ...] = ("Euro", "US Dollar", "Yen")
    hub_quantile: float = 0.99
    sizes: dict = field(default_factory=dict)


P = Params()
#: More values than this of a format or currency are no vocabulary.
MAX_VOCABULARY = 1000


def fitted(tx: DataFrame, p: Params = P, split: str = "train") -> Params:
    """p with the vocabularies of formats and currencies that one split has, sorted."""

    def words(*columns: str) -> tuple[str, ...]:
        values = tx.where(F.col("split") == split).select(F.explode(F.array(*columns)).alias("v")).where("v is not null").distinct().orderBy("v").limit(MAX_VOCABULARY + 1)
        found = tuple(r.v for r in values.collect())
        if len(found) > MAX_VOCABULARY:
            raise ValueError(f"{columns} have more than {MAX_VOCABULARY} values")
        return found

    return replace(p, formats=words("payment_format"), currencies=words("payment_currency", "receiving_currency"))


def prepared(tx: DataFrame, p: Params = P) -> DataFrame:
    """Transfers with flags, format code and logarithms in whole units."""
    l = S.log_amount(F.col("amount_usd"))  # noqa: E741
    return tx.withColumns(
        {
            "l": l,
            "lq": S.units(l),
            "l2q": S.units(l * l),
            "in_band": S.in_band(F.col("amount_usd"), *p.band),
            "is_round": S.is_round(F.col("paid_c"), p.round_cents),
            "high_risk": F.col("payment_format").isin(*p.high_risk),
            "fmt": S.code_in(F.col("payment_format"), list(p.formats)),
        }
    )

def of_ends(t: DataFrame, u: list[str] = (), v: list[str] = (), keep: list[str] = (), p: Params = P) -> DataFrame:
    """row_id and `keep` of every prepared transfer, with columns of its sender's state as u_* and of its receiver's as v_* (see
    timelines.account_minutes)."""
    accounts = TL.account_minutes(store.written(TL.pair_minutes(t, p)), p)  # each pair is read from both its ends
    accounts = store.written(accounts) if u and v else accounts  # both ends read it
    own = t.select("row_id", "src", "dst", "minute", *(c for c in keep if c not in ("src", "dst", "minute")))
    if u:
        own = TL.state_at(own, accounts, "src", "u", list(u))
    if v:
        own = TL.state_at(own, accounts, "dst", "v", list(v))
    return own.select("row_id", *keep, *(f"u_{c}" for c in u), *(f"v_{c}" for c in v))


def ports(t: DataFrame, pairs: DataFrame | None = None, accounts: DataFrame | None = None, p: Params = P) -> DataFrame:
    """(src, dst, first_min, port_out, port_in): how many of the sender's receivers, and of the receiver's senders, are first seen in an earlier minute than the pair."""
    pairs = store.written(TL.pair_minutes(t, p)) if pairs is None else pairs
    accounts = store.written(TL.account_minutes(pairs, p)) if accounts is None else accounts
    first = pairs.where("minute = first_min").select("src", "dst", "minute", "first_min")
    first = TL.state_at(TL.state_at(first, accounts, "src", "port", ["out_pairs"]), accounts, "dst", "port", ["in_pairs"])
    return first.select("src", "dst", "first_min", F.col("port_out_pairs").alias("port_out"), F.col("port_in_pairs").alias("port_in"))


def same_format(p: Params = P) -> F.Column:
    """The receiver's earlier transfers in this one's format, of its state v_*; 0 for an unknown format."""
    return F.coalesce(F.get(F.array(*(F.col(f"v_in_n_fmt_{k}") for k in range(len(p.formats)))), F.when(F.col("fmt") >= 0, F.col("fmt"))), F.lit(0))


def mean(n: str, total: str):
    return F.when(F.col(n) > 0, F.col(total) / F.lit(float(S.LOG_UNIT)) / F.col(n))


def std(n: str, total: str, squares: str):
    m = mean(n, total)
    var = F.col(squares) / F.lit(float(S.LOG_UNIT)) / F.col(n) - m * m
    return F.when(F.col(n) > 0, F.sqrt(F.greatest(var, F.lit(0.0))))


def log_cents(c: str):
    return F.log1p(F.col(c) / F.lit(100.0))


SUMS = ["cnt_s", "cnt_l", "uniq_s", "uniq_l", "sum_s", "sum_l"]
MOMENTS = ["lq_s", "lq_l", "l2q_s", "l2q_l", "max_s"]


def features(t: DataFrame, p: Params = P) -> DataFrame:
    """t: prepared transfers. Adds to every transfer all window, flow, port, gap and rule-support features. Pairs and accounts by minute
    are written once each, and read with the columns that are needed."""
    pairs = store.written(TL.pair_minutes(t, p))
    accounts = store.written(TL.account_minutes(pairs, p))
    counts = ["out_n_in_band", "out_n_is_round", "out_n_high_risk", "out_n_is_new", *(f"out_n_fmt_{k}" for k in range(len(p.formats)))]
    out, into = ([f"{e}_{c}" for c in [*SUMS, "last"]] for e in ("out", "in"))
    own = TL.state_at(t, accounts, "src", "u", [*out, *(f"out_{c}" for c in MOMENTS), *counts, *into, "in_inflow_c"])
    own = TL.state_at(own, accounts, "dst", "v", [*out, *into, *(f"in_{c}" for c in MOMENTS), *(f"in_n_fmt_{k}" for k in range(len(p.formats)))])
    own = own.join(pairs.select("src", "dst", *(c for c in TL.STATE if c not in ("n", "next"))), ["src", "dst", "minute"]).withColumn("is_new", F.col("minute") == F.col("first_min"))
    return own.join(ports(t, pairs, accounts, p).drop("first_min"), ["src", "dst"]).withColumn("v_in_same_fmt", same_format(p))
