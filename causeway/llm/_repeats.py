"""The distributed frame in which exact-substring dedup runs.

0. Of equal texts, all but the first are repeats of it; only the first gives fragments.
1. Every text gives its anchors (see _windows); anchors met once in the whole corpus drop out.
2. Each remaining anchor gives a fragment: the windows that it stands for. Fragments go to the
   partition of their anchor, so equal windows meet in one task.
3. That task finds, by the operator's own method, the windows that start earlier elsewhere.
4. Runs of those windows go back to their texts.

Skew: equal anchors or fragments of one map task become one row before the shuffle. An anchor
with more than `hot_limit` fragments spreads its windows over all partitions by their own hash;
as at most (all anchors / hot_limit) anchors can be hot, their list has a fixed bound (MAX_HOT).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm import _common as C
from causeway.llm import _windows as W

MAX_HOT = 1_000_000
HOT_LIMIT = 10_000

ANCHOR = pa.schema([("key", pa.int64()), ("local", pa.int32()), ("unit", pa.int64()), ("pos", pa.int32())])
FOUND = pa.schema([("unit", pa.int64()), ("pos", pa.int32()), ("key", pa.int64()), ("met", pa.int64())])
FRAGMENT = pa.schema([("key", pa.int64()), ("unit", pa.int64()), ("start", pa.int32()), ("n", pa.int16()), ("body", pa.binary())])
RUN = pa.schema([("unit", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
#: Bytes of texts whose anchors or fragments make one partition; fragments take up to twice that.
PARTITION = 64 << 20
#: Bytes of fragments that are compared at a time; anchors are not split.
SLICE = 4 << 20
#: Bytes of texts that are cut into units at a time; a longer text is by itself.
GROUP = 2 << 20


def ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.int16(): "short", pa.int8(): "byte", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def spread(unit: np.ndarray) -> np.ndarray:
    """Keys that only deal rows out evenly; small, as they compress better."""
    return W.scramble(unit.astype(np.uint64)) & np.uint64(0xFFFF)


class Scan:
    """How a text becomes units, and how a fragment travels."""

    def __init__(self, window: int, k: int):
        self.window, self.k = window, k

    def units(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units of a batch of texts, and the texts' bounds in them."""
        raise NotImplementedError

    def values(self, part: np.ndarray) -> np.ndarray:
        """A 64-bit number for each unit."""
        raise NotImplementedError

    def body(self, part: np.ndarray, spans: W.Spans, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes, and their lengths, that stand for the windows from lo to hi."""
        raise NotImplementedError

    def pieces(self, data: np.ndarray, bounds: np.ndarray):
        a, n = 0, len(bounds) - 1
        while a < n:  # some texts at a time: their units take many times their bytes
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + GROUP, "right")) - 1)
            units, within = self.units(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            for first, text, cut in W.pieces(within, self.window - 1):
                part = units[first : first + int(cut[-1])]
                values = self.values(part)
                grams = W.grams(values, self.k)
                at, lo, hi, doc = W.anchors(grams, cut, self.window, self.k)
                yield part, values, grams, at, lo, hi, doc + text + a, first - within[doc + text] if len(doc) else at
            a = b


def find_anchors(scan: Scan) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = batch.column(0).to_numpy()
            keys, units, poss = [], [], []
            for _, _, grams, at, lo, hi, doc, shift in scan.pieces(*C.text_bytes(batch.column(1))):
                keys.append(grams[at])
                units.append(unit[doc])
                poss.append(at + shift)
            if not keys:
                continue
            key, u, pos = (np.concatenate(x) for x in (keys, units, poss))
            order = np.argsort(key, kind="stable")
            key, u, pos = key[order], u[order], pos[order]
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            local = np.zeros(len(key), np.int32)
            local[new] = np.diff(np.r_[new, len(key)])
            rest = local == 0
            key[rest] = spread(u[rest])
            yield _rows(ANCHOR, C.longs(key), local, u, pos.astype(np.int32))

    return run


def keep_repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """local 0: known to be repeated; else the number that one map task met."""
    t = C.gathered(batches, ANCHOR)
    if not len(t):
        return
    key, local, unit, pos = (C.array_of(t, c) for c in ANCHOR.names)
    known = local == 0
    yield _rows(FOUND, unit[known], pos[known], np.zeros(known.sum(), np.int64), np.zeros(known.sum(), np.int64))
    own = np.flatnonzero(~known)
    own = own[np.argsort(key[own], kind="stable")]
    if len(own):
        new = np.flatnonzero(np.r_[True, key[own][1:] != key[own][:-1]])
        met = np.repeat(np.add.reduceat(local[own].astype(np.int64), new), np.diff(np.r_[new, len(own)]))
        own, met = own[met > 1], met[met > 1]
        yield _rows(FOUND, unit[own], pos[own], key[own], met)


def find_fragments(scan: Scan, hot: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            unit = batch.column(0).to_numpy()
            lists = batch.column(2)
            wanted = lists.flatten().to_numpy()
            row_of = np.repeat(np.arange(len(unit)), lists.value_lengths().to_numpy().astype(np.int64))
            wanted = np.sort(row_of.astype(np.int64) << 32 | wanted.astype(np.int64))
            if not len(wanted):
                continue
            found = []
            for part, values, grams, at, lo, hi, doc, shift in scan.pieces(*C.text_bytes(batch.column(1))):
                mine = doc.astype(np.int64) << 32 | (at + shift)
                ok = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)] == mine)
                if not len(ok):
                    continue
                at, lo, hi, doc, shift = at[ok], lo[ok], hi[ok], doc[ok], shift[ok]
                key, spans = grams[at], W.Spans(values, W.CHUNK)
                if len(hot):
                    many = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                    n = np.where(many, hi - lo + 1, 1)
                    src = np.repeat(np.arange(len(at)), n)
                    many, one = many[src], C.ranges(lo, n)
                    doc, shift, key = doc[src], shift[src], key[src]
                    lo, hi = np.where(many, one, lo[src]), np.where(many, one, hi[src])
                    key[many] = W.scramble(key[many] ^ spans(lo[many], lo[many] + scan.window))
                found.append((key, spans(lo, hi + scan.window) ^ W.scramble(key), unit[doc], lo + shift, hi - lo + 1, *scan.body(part, spans, lo, hi)))
            if not found:
                continue
            key, same, u, start, n, data, size = (np.concatenate(x) for x in zip(*found))
            del found
            order = np.lexsort((start, u, same))
            first = np.zeros(len(order), bool)
            first[order] = np.r_[True, same[order][1:] != same[order][:-1]]
            rest = np.flatnonzero(~first)
            yield _rows(FRAGMENT, C.longs(spread(u[rest])), u[rest], start[rest].astype(np.int32), n[rest].astype(np.int16), pa.nulls(len(rest), pa.binary()))
            own, offsets = np.flatnonzero(first), np.cumsum(size) - size
            for a in range(0, len(own), 100_000):
                g = own[a : a + 100_000]
                yield _rows(FRAGMENT, C.longs(key[g]), u[g], start[g].astype(np.int32), n[g].astype(np.int16), C.binaries(data[C.ranges(offsets[g], size[g])], np.r_[0, np.cumsum(size[g])]))

    return run


def find_runs(repeated: Callable) -> Callable:
    """repeated(key, unit, start of first window, n, data, offsets) -> for each fragment's windows, in order, whether they start earlier elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = C.gathered(batches, FRAGMENT)
        if not len(t):
            return
        key, unit, start, n = (C.array_of(t, c) for c in FRAGMENT.names[:4])
        column = t.column("body").combine_chunks()
        del t
        known = column.is_null().to_numpy(zero_copy_only=False)
        k = np.flatnonzero(known)
        yield _rows(RUN, unit[k], start[k], n[k].astype(np.int32))
        own = np.flatnonzero(~known)
        own = own[np.argsort(key[own], kind="stable")]
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)[own]
        slices = np.cumsum(sizes) // SLICE
        first = np.searchsorted(key[own], key[own], "left")  # an anchor goes with its first fragment
        for part in np.split(own, np.flatnonzero(np.diff(slices[first])) + 1) if len(own) else []:
            data, offsets = C.text_bytes(column.take(pa.array(part)))
            m = n[part].astype(np.int64)
            flags = repeated(key[part], unit[part], start[part].astype(np.int64), m, data, offsets)
            # runs of flags, cut at the fragments' ends
            ends = np.cumsum(m)
            before, after = np.r_[False, flags[:-1]], np.r_[flags[1:], False]
            before[ends - m] = after[ends - 1] = False
            a, b = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after)
            row = np.searchsorted(ends, a, "right")
            yield _rows(RUN, unit[part][row], (start[part][row] + a - (ends - m)[row]).astype(np.int32), (b - a + 1).astype(np.int32))

    return run


def covered(starts: np.ndarray, runs: np.ndarray, n: int, window: int) -> np.ndarray:
    """Of n units, those that a window of a run covers."""
    if n < window:
        return np.zeros(n, bool)
    step = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(starts + runs - 1 + window, n), minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, flags.view(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def exact_copies(texts: DataFrame) -> DataFrame:
    """(_u) of the texts that are equal to one with a smaller _u; only digests are shuffled."""
    digests = texts.select("_u", F.sha2("text", 256).alias("d"))
    # written by itself, so that the join gets plain rows, which Spark can split where very many texts are equal
    first = C.cut(digests.groupBy("d").agg(F.min("_u").alias("first"), F.count("*").alias("c")).where("c > 1"))
    return digests.join(first, "d").where("_u > first").select("_u")


def repeated_windows(texts: DataFrame, scan: Scan, repeated: Callable, hot_limit: int = HOT_LIMIT) -> DataFrame:
    """texts: (_u, text). Returns texts with start and n, the first and the number of the windows of each run
    that starts earlier elsewhere; null where a text has none. Both joins are left joins of the same texts, so Spark
    deals the texts out once and uses that twice."""
    n = C.partitions(texts.sparkSession, texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0, PARTITION)
    found = texts.mapInArrow(find_anchors(scan), ddl(ANCHOR)).repartition(n, "key").mapInArrow(keep_repeated, ddl(FOUND))
    found = C.cut(found)
    limit = max(hot_limit, found.count() // MAX_HOT)  # so no more than MAX_HOT anchors are over it
    hot = found.where(F.col("met") > limit).select("key").distinct().toArrow()
    hot = np.sort(hot.column(0).combine_chunks().to_numpy().view(np.uint64)) if hot.num_rows else np.zeros(0, np.uint64)
    copies = C.cut(exact_copies(texts))
    wanted = found.groupBy(F.col("unit").alias("_u")).agg(F.collect_list("pos").alias("at")).join(copies, "_u", "left_anti")
    fragments = texts.join(wanted, "_u", "left").select("_u", "text", "at").mapInArrow(find_fragments(scan, hot), ddl(FRAGMENT))
    found = fragments.repartition(n, "key").mapInArrow(find_runs(repeated), ddl(RUN))
    found = found.union(copies.select(F.col("_u").alias("unit"), F.lit(0).alias("start"), F.lit((1 << 30)).alias("n")))
    found = found.groupBy(F.col("unit").alias("_u")).agg(F.collect_list("start").alias("start"), F.collect_list("n").alias("n"))
    return texts.join(found, "_u", "left").select("_u", "text", "start", "n")
