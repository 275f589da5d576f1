"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash. A source's copies are nested: copy c takes the documents below a
threshold, and the thresholds fall with c. Whole copies need none; for the one partial copy, the
words are summed by source and hash bucket, the bucket in which the running sum passes the budget
is found, and only that bucket is split again, until it holds one hash. Nothing is sorted, and what
is gathered is at most (sources x 2^BITS) sums a level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm import _common as C

HASH_BITS = 60
BITS = 12
#: A table of up to this many sources is broadcast (a name and four numbers each).
MAX_BROADCAST_SOURCES = 50_000
OUTPUTS = ("size", "source_size", "target", "copies", "taken")


def words_in(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(C.WORD)), F.lit(0)).cast("long")


def hash_of(id_col: str, text_col: str, seed: str):
    """60 bits that depend on the id alone; on the text where there is no id."""
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 15), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds place: 0, 1, ... by code point, null last. The sort is by range; only one number for each
    partition comes to the driver."""
    numbered = C.cut(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    counts = sorted(tuple(r) for r in numbered.groupBy(part.alias("p")).count().collect())
    before, total = {}, 0
    for p, n in counts:
        before[p], total = total, total + n
    offsets = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else F.create_map(F.lit(0), F.lit(0))
    return numbered.withColumn("place", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.try_element_at(offsets, part)).drop("_m")


def source_targets(sources: DataFrame, weights=(5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """sources: (source, source_size). Adds target: sources by code point, null last, weigh `weights`,
    repeating, and share `share` of all sizes; no target is above `most` times its source, the excess
    goes to the others by weight. Only the level at which the rest is shared is kept between rounds; each round
    is one sum over the sources and closes one of them at least, so there are no more rounds than sources, and few where few are over."""
    place = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    s = C.cut(ranked(sources).withColumn("weight", place))
    total, weight = s.agg(F.sum("source_size"), F.sum("weight")).first()
    goal, level, closed = share * (total or 0), 0.0, -1
    if weight:
        level = goal / weight
    full = lambda v: F.lit(most) * F.col("source_size") < F.lit(v) * F.col("weight")
    while weight:
        n, held, open_weight = s.agg(F.count_if(full(level)), F.sum(F.when(full(level), F.col("source_size"))), F.sum(F.when(~full(level), F.col("weight")))).first()
        if n == closed or not open_weight:
            break
        closed, level = n, (goal - most * (held or 0)) / open_weight
    target = F.when(full(level), F.lit(float(most)) * F.col("source_size")).otherwise(F.lit(level) * F.col("weight"))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame, small: bool) -> DataFrame:
    """sized: (source, hash, size); budgets: (source, budget). Returns (source, threshold): the documents
    whose hash is below it have, together, as near to budget words as whole documents in hash order allow. small: budgets are few enough to be broadcast."""
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("base"), F.lit(False).alias("done"))
    running = Window.partitionBy("source").orderBy("bucket")
    shift = HASH_BITS
    while shift > 0:
        span, shift = shift, max(0, shift - BITS)
        # only documents in the bucket that the budget ends in are looked at again
        mine = state.where("not done").select(F.col("source").alias("_s"), "budget", "low", "base")
        mine = F.broadcast(mine) if small else mine
        inside = sized.join(mine, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("hash", span) == F.shiftright("low", span)))
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket"), "budget", "base").agg(F.sum("size").alias("words"), F.min("hash").alias("least"), F.max("hash").alias("greatest"))
        sums = sums.withColumn("upto", F.col("base") + F.sum("words").over(running))
        edge = sums.where("upto > budget").groupBy("source").agg(F.min(F.struct("bucket", "upto", "words", "least", "greatest")).alias("e"))
        edge = edge.select(F.col("source").alias("_s"), "e.*")
        state = state.join(edge, F.col("source").eqNullSafe(F.col("_s")), "left")
        start = F.shiftleft("bucket", shift)
        base = F.col("upto") - F.col("words")
        one = F.col("least") == F.col("greatest")  # a single hash: to take it or leave it
        state = C.cut(
            state.select(
                "source",
                "budget",
                F.when(F.col("done"), F.col("low")).when(F.col("bucket").isNull(), F.lit(1 << HASH_BITS)).when(one, F.col("least") + F.when(F.col("upto") - F.col("budget") < F.col("budget") - base, 1).otherwise(0)).otherwise(start).alias("low"),
                F.when(F.col("done") | F.col("bucket").isNull(), F.col("base")).otherwise(base).alias("base"),
                (F.col("done") | F.col("bucket").isNull() | F.coalesce(one, F.lit(False))).alias("done"),
            )
        )
        if state.where("not done").isEmpty():
            break
    return state.select("source", F.col("low").alias("threshold"))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.0, most: int = 3, seed: str = "mix:", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with size (words in the text), source_size (of its source), target (its source's), copies
    (how often the mix takes it) and taken (copies x size). Columns of docs with these names are replaced, all others
    pass through, whatever their names.

    A null text has no words, null is a source of its own, and a source without words has target 0. Rows
    that repeat an id share its hash and are taken together. Reruns agree, whatever the partitions."""
    rest = docs.drop(*OUTPUTS)
    name, full, below = (C.free(n, [*rest.columns, *OUTPUTS]) for n in ("_source", "_whole", "_below"))
    sized = C.cut(docs.select(F.col(source_col).alias("source"), hash_of(id_col, text_col, seed).alias("hash"), words_in(text_col).alias("size")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sources, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = C.cut(plan.withColumn("_whole", F.least(whole, F.lit(most).cast("long"))))
    budgets = plan.select("source", (F.col("target") - F.col("_whole") * F.col("source_size")).alias("budget"))
    small = plan.count() <= MAX_BROADCAST_SOURCES
    # at a budget of 0 nothing is below the threshold, and a full source has no partial copy
    cut = thresholds(sized.where("size > 0"), budgets.where("budget > 0"), small).select(F.col("source").alias("_t"), "threshold")
    plan = plan.join(cut, F.col("source").eqNullSafe(F.col("_t")), "left").select(F.col("source").alias(name), "source_size", "target", F.col("_whole").alias(full), F.coalesce("threshold", F.lit(0)).alias(below))
    if small:
        plan = F.broadcast(plan)
    out = rest.withColumn("size", words_in(text_col)).join(plan, F.col(source_col).eqNullSafe(F.col(name)), "left")
    copies = F.col(full) + F.when(hash_of(id_col, text_col, seed) < F.col(below), 1).otherwise(0)
    out = out.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*(F.col(f"`{c}`") for c in rest.columns), *OUTPUTS)
