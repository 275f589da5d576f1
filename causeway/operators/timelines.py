"""The state of accounts and of pairs, minute by minute, from which transfers read their features.

What an account has sent and received before a minute depends on the account and the minute alone. So
transfers are summed by (account, minute) first, combined before the shuffle, and a hub has no more rows than
minutes, however many transfers it has (nor a pair). Each account's rows are then read in order by one vectorized kernel: sums over
[m - W, m - 1] are differences of prefix sums, distinct counts come from three of them, maxima come from a
table of powers of two. Native window frames give the same numbers, but
read each window's rows again for each row (maxima) and run some fifty aggregates over several frames for every
row. All sums are integers, so differences are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators import asof as A

#: Rows that a kernel looks at together, about; a group is never cut.
ROWS = 1 << 17


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted rows in tables of whole groups."""
    held, n, last = [], 0, None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(len(batch), bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        now = tuple(c[0] for c in columns)
        new[0] = last is not None and now != last
        last = tuple(c[-1] for c in columns)
        cuts = np.flatnonzero(new)
        if len(cuts) and n + int(cuts[-1]) >= ROWS:
            at = int(cuts[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, at)]).combine_chunks()
            held, n = [batch.slice(at)], len(batch) - at
        else:
            held.append(batch)
            n += len(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Line:
    """Rows of groups in time order, (group, minute) unique: sums over what came before."""

    def __init__(self, group: np.ndarray, minute: np.ndarray, reach: int):
        n = len(group)
        new = np.r_[True, group[1:] != group[:-1]]
        rank = np.cumsum(new) - 1
        self.span = int(minute.max(initial=0)) + reach + 2
        self.key = rank * self.span + minute
        self.start = np.flatnonzero(new)[rank]
        self.at = np.arange(n)
        self.lows: dict[int, np.ndarray] = {}

    def low(self, window: int) -> np.ndarray:
        """The first row of a row's group in [m - window, m]."""
        if window not in self.lows:
            self.lows[window] = np.searchsorted(self.key, self.key - window)
        return self.lows[window]

    def before(self, values: np.ndarray, window: int | None) -> np.ndarray:
        """Sum over [m - window, m - 1], or over all before m."""
        upto = np.r_[0, np.cumsum(values)]
        return upto[self.at] - upto[self.start if window is None else self.low(window)]

    def beyond(self, values: np.ndarray, window: int) -> np.ndarray:
        """Sum over all before m - window."""
        upto = np.r_[0, np.cumsum(values)]
        return upto[self.low(window)] - upto[self.start]

    def last(self, minute: np.ndarray, there: np.ndarray) -> np.ndarray:
        """The last minute before m with a row that is there; -1 for none."""
        near = np.maximum.accumulate(np.where(there, self.at, -1))
        near = np.r_[-1, near[:-1]]
        return np.where(near >= self.start, minute[near], -1)

    def most(self, values: np.ndarray, window: int) -> np.ndarray:
        """Greatest value over [m - window, m - 1]; -inf for none."""
        low, out = self.low(window), np.full(len(values), -np.inf)
        n = self.at - low
        level, table = 0, values
        while True:
            mine = np.flatnonzero((n >> level) == 1)
            out[mine] = np.maximum(table[low[mine]], table[self.at[mine] - (1 << level)])
            if not (n >> (level + 1)).any():
                return out
            table = np.maximum(table[: -(1 << level)], table[1 << level :])
            level += 1


def _kernel(schema: pa.Schema, keys: list[str], columns: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]) -> Callable:
    """columns(arrays) gives the schema's columns; in those of doubles -inf is null, in longs named *last -1 is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            out = columns({c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in table.column_names})
            made = []
            for f in schema:
                x = out[f.name]
                none = np.isneginf(x) if f.type == pa.float64() else x < 0 if f.name.endswith("last") else None
                made.append(pa.array(x, f.type, mask=none))
            yield from pa.Table.from_arrays(made, schema=schema).to_batches(max_chunksize=ROWS)

    return run


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'double' if f.type == pa.float64() else 'int' if f.type == pa.int32() else 'long'}" for f in schema)


#: What transfers of one minute are summed to.
SUMMED = ("usd_c", "flow", "lq", "l2q", "in_band", "is_round", "high_risk")
STATE = ("minute", "n", "pair_cnt_s", "pair_cnt_l", "pair_last", "rev_cnt", "rev_last", "first_min", "next")


def _sums(formats: int) -> list[str]:
    return [*SUMMED, *(f"fmt_{k}" for k in range(formats))]


def pair_minutes(t: DataFrame, p) -> DataFrame:
    """One row for each (src, dst, minute): its transfers n; earlier ones in both windows and the last minute with one; those of the
    reverse pair in the round-trip window, and their last minute; the pair's first minute and, -1 for none, its next one; and the
    sums, by flag and format too, and greatest logarithm of the minute's own transfers."""
    formats = len(p.formats)
    flags = [F.count_if(c).alias(c) for c in ("in_band", "is_round", "high_risk")]
    own = [F.sum(c).alias(c) for c in ("usd_c", "lq", "l2q")] + flags + [F.count_if(F.col("fmt") == k).alias(f"fmt_{k}") for k in range(formats)]
    flow = F.coalesce(F.sum(F.when(~F.col("self_loop"), F.col("usd_c"))), F.lit(0)).alias("flow")
    sums = t.groupBy("src", "dst", "minute").agg(F.count("*").alias("n"), *own, flow, F.max("l").alias("l"))
    sums = sums.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), "minute", (F.col("src") > F.col("dst")).cast("int").alias("back"), "n", *_sums(formats), "l")
    short, long, trip = p.short, p.long, p.round_trip
    schema = pa.schema([("src", pa.int32()), ("dst", pa.int32()), *((c, pa.int64()) for c in [*STATE, *_sums(formats)]), ("l", pa.float64())])

    def columns(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        lo, hi, minute, back, n = a["lo"], a["hi"], a["minute"], a["back"], a["n"]
        pair = np.cumsum(np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        span = int(minute.max(initial=0)) + max(short, long, trip) + 2
        key = pair * span + minute
        out = {c: np.zeros(len(key), np.int64) for c in STATE} | {c: a[c] for c in [*_sums(formats), "l"]}
        out["src"], out["dst"], out["minute"], out["n"] = np.where(back == 1, hi, lo), np.where(back == 1, lo, hi), minute, n
        rows = [np.flatnonzero(back == b) for b in (0, 1)]
        keys = [key[r] for r in rows]
        total = [np.r_[0, np.cumsum(n[r])] for r in rows]

        def count(own: int, at: np.ndarray, window: int) -> np.ndarray:
            return total[own][np.searchsorted(keys[own], at)] - total[own][np.searchsorted(keys[own], at - window)]

        def last(own: int, at: np.ndarray) -> np.ndarray:
            if not len(keys[own]):
                return np.full(len(at), -1)
            near = np.searchsorted(keys[own], at) - 1
            found = keys[own][np.maximum(near, 0)]
            return np.where((near >= 0) & (found // span == at // span), found % span, -1)

        for own, r in enumerate(rows):
            if not len(r):
                continue
            at = key[r]
            out["pair_cnt_s"][r], out["pair_cnt_l"][r], out["pair_last"][r] = count(own, at, short), count(own, at, long), last(own, at)
            new = np.r_[True, pair[r][1:] != pair[r][:-1]]
            out["first_min"][r] = minute[r][new][np.cumsum(new) - 1]
            out["next"][r] = np.where(np.r_[new[1:], True], -1, np.r_[minute[r][1:], -1])
            loop = lo[r] == hi[r]
            out["rev_cnt"][r] = np.where(loop, count(own, at, trip), count(1 - own, at, trip))
            out["rev_last"][r] = np.where(loop, last(own, at), last(1 - own, at))
        return out

    lined = sums.repartition("lo", "hi").sortWithinPartitions("lo", "hi", "minute", "back")
    return lined.mapInArrow(_kernel(schema, ["lo", "hi"], columns), _ddl(schema))


def _account_schema(formats: int) -> pa.Schema:
    names = ["minute"]
    for end in ("out", "in"):
        names += [f"{end}_{c}_{w}" for c in ("cnt", "sum", "lq", "l2q", "uniq") for w in "sl"] + [f"{end}_last", f"{end}_pairs", *(f"{end}_n_fmt_{k}" for k in range(formats))]
    names += ["out_n_in_band", "out_n_is_round", "out_n_high_risk", "out_n_is_new", "in_inflow_c"]
    return pa.schema([("acct", pa.int32()), *((c, pa.int64()) for c in names), ("out_max_s", pa.float64()), ("in_max_s", pa.float64())])


def account_minutes(pairs: DataFrame, p) -> DataFrame:
    """pairs: as pair_minutes() gives them. One row for each (acct, minute) at which the account has a transfer: what it sent (out_*) and received (in_*) before the minute:
    numbers, cents, sums of logarithms and distinct counterparties in both windows, the last minute, greatest logarithm, counts by flag
    and format in the short window, inflow without self-loops, and *_pairs, the pairs first seen in an earlier minute.

    A counterparty seen at s counts in [m - W, m - 1] if s is its last minute before m. So their number is that of all (counterparty, minute)
    before m, less those that came back within W before m, less those from before m - W that didn't come back within W: three prefix sums."""
    formats, short, long, through = len(p.formats), p.short, p.long, p.pass_through
    windows = {"s": short, "l": long}
    sums, rows = [], []
    for side, key in (("o", "src"), ("i", "dst")):
        rows.append(pairs.withColumns({"acct": F.col(key), "side": F.lit(side)}).drop("src", "dst"))
        mine = F.col("side") == side
        total = lambda c: F.coalesce(F.sum(F.when(mine, F.col(c))), F.lit(0))  # noqa: B023, E731
        sums += [total(c).alias(f"{side}_{c}") for c in ("n", "usd_c", "lq", "l2q", *(f"fmt_{k}" for k in range(formats)))]
        sums += [F.count_if(mine).alias(f"{side}_seen"), F.count_if(mine & (F.col("minute") == F.col("first_min"))).alias(f"{side}_pair")]
        sums += [F.count_if(mine & (F.col("minute") - F.col("pair_last") <= w)).alias(f"{side}_back_{k}") for k, w in windows.items()]
        sums += [F.count_if(mine & ((F.col("next") < 0) | (F.col("next") - F.col("minute") > w))).alias(f"{side}_gone_{k}") for k, w in windows.items()]
        sums.append(F.coalesce(F.max(F.when(mine, F.col("l"))), F.lit(float("-inf"))).alias(f"{side}_l"))
    out = F.col("side") == "o"
    sums += [F.coalesce(F.sum(F.when(out, F.col(c))), F.lit(0)).alias(f"o_{c}") for c in ("in_band", "is_round", "high_risk")]
    sums += [F.coalesce(F.sum(F.when(out & (F.col("minute") == F.col("first_min")), F.col("n"))), F.lit(0)).alias("o_new"), F.coalesce(F.sum(F.when(~out, F.col("flow"))), F.lit(0)).alias("i_flow")]
    schema = _account_schema(formats)

    def columns(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        line = Line(a["acct"], a["minute"], max(short, long, through))
        made = {"acct": a["acct"], "minute": a["minute"]}
        for side, end in (("o", "out"), ("i", "in")):
            for source, name in (("n", "cnt"), ("usd_c", "sum"), ("lq", "lq"), ("l2q", "l2q")):
                made[f"{end}_{name}_s"], made[f"{end}_{name}_l"] = (line.before(a[f"{side}_{source}"], w) for w in (short, long))
            for k, w in windows.items():
                made[f"{end}_uniq_{k}"] = line.before(a[f"{side}_seen"], None) - line.before(a[f"{side}_back_{k}"], None) - line.beyond(a[f"{side}_gone_{k}"], w)
            made[f"{end}_last"] = line.last(a["minute"], a[f"{side}_n"] > 0)
            made[f"{end}_pairs"] = line.before(a[f"{side}_pair"], None)
            made[f"{end}_max_s"] = line.most(a[f"{side}_l"], short)
            made |= {f"{end}_n_fmt_{k}": line.before(a[f"{side}_fmt_{k}"], short) for k in range(formats)}
        for name, source in (("in_band", "in_band"), ("is_round", "is_round"), ("high_risk", "high_risk"), ("is_new", "new")):
            made[f"out_n_{name}"] = line.before(a[f"o_{source}"], short)
        made["in_inflow_c"] = line.before(a["i_flow"], through)
        return made

    lined = A.union(*rows).groupBy("acct", "minute").agg(*sums).repartition("acct").sortWithinPartitions("acct", "minute")
    return lined.mapInArrow(_kernel(schema, ["acct"], columns), _ddl(schema))


def state_at(t: DataFrame, accounts: DataFrame, key: str, one: str, columns: list[str]) -> DataFrame:
    """t with the state of the account in its column `key`, before the transfer's minute, as <one>_<column>. The join is by account and
    minute, so a hub's transfers are spread over its minutes."""
    state = accounts.select(F.col("acct").alias(key), "minute", *(F.col(c).alias(f"{one}_{c}") for c in columns))
    return t.join(state, [key, "minute"])
