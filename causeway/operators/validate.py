"""Checks that count violations in one pass, and exchange rates fitted from the transfers themselves."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The world has some 180 currencies; more pairs than this are an error in the data.
MAX_PAIRS = 40_000


def violations(df: DataFrame, rules: dict[str, Column], unique: str | None = None) -> DataFrame:
    """(check_name, violations): for each rule the rows for which it holds, all in one aggregation; and, as 'rows', the
    rows beyond one for each value of `unique`."""
    counts = [F.struct(F.lit(n).alias("check_name"), F.count_if(c).alias("violations")) for n, c in rules.items()]
    out = df.agg(F.array(*counts).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    if unique:
        out = df.agg(F.lit("rows").alias("check_name"), (F.count("*") - F.countDistinct(unique)).alias("violations")).unionByName(out)
    return out


def fx_rates(tx: DataFrame, base: str, split: str = "train") -> DataFrame:
    """(currency, rate): units of each currency for one of the base, from the median ratio of each pair of currencies in
    cross-currency transfers of the split. Pairs of currencies are few, so the least-squares fit of the logarithms,
    weighted by the pairs' transfers, is solved here. No pair is left out: too many raise, as does a currency that no chain of pairs links to the base."""
    t = tx.where((F.col("split") == split) & (F.col("payment_currency") != F.col("receiving_currency")) & (F.col("amount_paid") > 0) & (F.col("amount_received") > 0))
    pairs = t.groupBy("payment_currency", "receiving_currency").agg(F.count("*").alias("n"), F.median(F.col("amount_received") / F.col("amount_paid")).alias("ratio"))
    pairs = pairs.limit(MAX_PAIRS + 1).collect()
    if len(pairs) > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} pairs of currencies")
    names = sorted({base, *(r.payment_currency for r in pairs), *(r.receiving_currency for r in pairs)})
    reached, edges = {base}, {(r.payment_currency, r.receiving_currency) for r in pairs}
    while more := {y for a, b in edges for x, y in ((a, b), (b, a)) if x in reached and y not in reached}:
        reached |= more
    if missing := set(names) - reached:
        raise ValueError(f"no chain of pairs links {sorted(missing)} to {base}")
    import numpy as np

    place = {c: i for i, c in enumerate(c for c in names if c != base)}
    rows, values = np.zeros((len(pairs), len(place))), np.zeros(len(pairs))
    for k, r in enumerate(pairs):
        weight = math.sqrt(r.n)
        for c, sign in ((r.receiving_currency, 1), (r.payment_currency, -1)):
            if c != base:
                rows[k, place[c]] += sign * weight
        values[k] = weight * math.log(r.ratio)
    solved = np.linalg.lstsq(rows, values, rcond=None)[0] if place else []
    return tx.sparkSession.createDataFrame([(base, 1.0), *((c, round(math.exp(solved[i]), 9)) for c, i in place.items())], "currency string, rate double")


def with_usd(tx: DataFrame, rates: DataFrame) -> DataFrame:
    """tx with amount_usd: the amount paid over the rate of its currency (units for one of the base). rates: (currency, rate), one row each
    and few, as fx_rates() gives them. A currency without a rate, or a rate that isn't positive, raises."""
    r = rates.select(F.col("currency").alias("payment_currency"), F.col("rate").alias("_rate"))
    found = tx.drop("amount_usd").join(F.broadcast(r), "payment_currency", "left")
    rate = F.when(F.col("_rate") > 0, F.col("_rate")).otherwise(F.raise_error(F.concat(F.lit("no rate for "), F.coalesce("payment_currency", F.lit("null")))))
    return found.withColumn("amount_usd", F.col("amount_paid") / rate).drop("_rate")
