"""Substring dedup over words, by level-wise doubling.

A level holds the windows of one length. Level one counts every window of `base` words; windows met
once drop out. A longer level, of up to twice the length, holds only the places whose first and last
windows of the level before were both repeated, and drops those met once again; so it goes until the
window asked for, or until no candidate survives.

How a level runs. Texts are dealt out once, by the hash of their number, and that exchange serves all
levels. Each task reads its texts in number order, in chunks of a fixed number of bytes, and sends for each chunk
its distinct windows, sorted and delta-coded, to the range of hashes that they belong to: about three
bytes a window, and a window that stands in a chunk a thousand times is sent once. There they
are counted, and each chunk is told which of its own are repeated. At the last level the first place is told, too: a
chunk learns which of its windows start earlier elsewhere. Below the last level keys are short (32 bits
within a range of hashes), so now and then a window passes for repeated that isn't; the last level's keys are 64 bits within the range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm import _common as C
from causeway.llm import _windows as W

BASE = 5
#: Bytes of texts in a chunk; a longer text is a chunk by itself, of several pieces.
CHUNK = 4 << 20
#: Words of a piece.
PIECE = 1 << 20
#: Bytes of texts in one partition, and windows in one range of hashes, about.
PARTITION, RANGE = 32 << 20, 8 << 20
LOW = np.uint64(0xFFFFFFFF)
SIGN = np.uint64(1 << 63)

#: Distinct windows of a chunk in a range. more: which of them the chunk holds twice or more, as bits. At the last level, units: numbers
#: of the texts with their first places, place: which of them each window's is.
SENT = pa.schema([("part", pa.int32()), ("route", pa.int64()), ("chunk", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("units", pa.binary()), ("place", pa.binary())])
SENT_DDL = "part int, route long, chunk int, n int, keys binary, more binary, units binary, place binary"
#: What a chunk is told; a row without a route has the numbers of a range's windows, and of those repeated.
TOLD = pa.schema([("route", pa.int64()), ("chunk", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("windows", pa.int64()), ("repeated", pa.int64())])
TOLD_DDL = "route long, chunk int, part int, keys binary, windows long, repeated long"
OUT = pa.schema([("_u", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])
OUT_DDL = "_u long, n_words long, n_removed long, kept string, spans array<struct<first:int,last:int>>"


def packed(ascending: np.ndarray) -> bytes:
    """Ascending numbers as their differences, in as few bytes as the largest needs, lowest bytes first."""
    step = np.diff(ascending, prepend=np.uint64(0))
    width = max(1, (int(step.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width, body = data[0], np.frombuffer(data, np.uint8, offset=1)
    step = np.zeros((len(body) // width, 8), np.uint8)
    step[:, :width] = body.reshape(width, -1).T
    return np.cumsum(step.view(np.uint64).ravel(), dtype=np.uint64)


def among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (_u, text, copy, ...) in their order, cut into chunks by their own bytes, wherever Arrow cut them: a chunk ends with
    the row that fills it. Copies count for nothing."""
    held, size = [], 0
    for batch in batches:
        n = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        n[pc.is_valid(batch.column("copy")).to_numpy(zero_copy_only=False)] = 0
        upto, at = np.cumsum(n), 0
        while at < len(batch):
            to = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK - size)) + 1
            held.append(batch.slice(at, to - at))
            if to > len(batch):
                size += int(upto[-1] - (upto[at - 1] if at else 0))
                break
            yield _joined(held)
            held, size, at = [], 0, to
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=None)[0]


def _text_words(group: pa.RecordBatch, copies: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the texts, and their words; without those of copies if so asked."""
    text = group.column("text")
    if not copies:
        text = pc.if_else(pc.is_valid(group.column("copy")), pa.scalar("", text.type), text)
    data, bounds = C.text_bytes(text)
    return data, *W.words(data, bounds)


def _cut(within: np.ndarray, window: int):
    """Pieces of about PIECE words, in which each window starts once; whole texts if windows may be as long as a piece."""
    return W.pieces(within, window - 1, PIECE) if window <= PIECE // 2 else W.pieces(within, 0, 1 << 62)


def _starts(bounds: np.ndarray, length: int) -> np.ndarray:
    """The places in a piece at which a window within one text starts."""
    n = int(bounds[-1])
    if n < length:
        return np.zeros(0, np.int64)
    at = np.arange(n - length + 1)
    return at[at + length <= np.repeat(bounds[1:], np.diff(bounds))[: n - length + 1]]


def _short_keys(values: np.ndarray, length: int, parts: int) -> np.ndarray:
    """For the window from each place, its range of hashes and 32 more bits."""
    h = W.grams(values, length)
    return ((h >> np.uint64(32)) * np.uint64(parts) & ~LOW) | (h & LOW)


def _candidates(values: np.ndarray, bounds: np.ndarray, length: int, before: int | None, told: np.ndarray, parts: int) -> np.ndarray:
    """Places whose windows can be repeated: all at the first level, else those whose first and last `before` words are."""
    at = _starts(bounds, length)
    if before is None or not len(at):
        return at
    again = among(_short_keys(values, before, parts), told)
    return at[again[at] & again[at + (length - before)]]


def _told(lists: pa.Array, wide: bool) -> dict[int, np.ndarray]:
    """Keys by chunk, ascending, of the first row that has any."""
    out: dict[int, list[np.ndarray]] = {}
    for row in lists.drop_null():
        for t in row.as_py():
            keys = unpacked(t["keys"])
            out.setdefault(t["chunk"], []).append(keys if wide else keys | np.uint64(t["part"]) << np.uint64(32))
    return {k: np.sort(np.concatenate(v)) for k, v in out.items()}


def _pieces(batches: Iterator[pa.RecordBatch], window: int):
    """(route, chunk, what it was told, numbers of the group's texts, the first text, hashes, bounds) of each piece, which is a chunk of its own.
    The route is the task's first text, by whose number answers come back to the task."""
    route, told, chunk = None, {}, -1
    for group in groups(batches):
        units = group.column("_u").to_numpy()
        if route is None:
            route, told = int(units[0]), _told(group.column("found").slice(0, 1), False) if "found" in group.schema.names else {}
        data, starts, ends, within = _text_words(group, copies=False)
        hashes = W.word_hashes(data, starts, ends)
        for first, text, bounds in _cut(within, window):
            chunk += 1
            yield route, chunk, told.get(chunk, np.zeros(0, np.uint64)), units, text, hashes[first : first + int(bounds[-1])], bounds


def send(length: int, before: int | None, window: int, parts: int):
    """One level: of each chunk its distinct candidates of `length` words, to their ranges of hashes."""
    last = length == window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for route, chunk, told, units, text, values, bounds in _pieces(batches, window):
            at = _candidates(values, bounds, length, before, told, parts)
            if not len(at):
                continue
            short = _short_keys(values, length, parts)[at]
            if last:
                part, key = (short >> np.uint64(32)).astype(np.int64), W.grams(values, length, seed=13)[at]
                order = np.lexsort((key, part))
                part, key, at = part[order], key[order], at[order]
                new = np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]
            else:
                key = np.sort(short)
                new = np.r_[True, key[1:] != key[:-1]]
                part = (key >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(new)
            more = np.diff(np.r_[first, len(key)]) > 1
            part, key = part[first], key[first]
            if last:
                owner = text + np.searchsorted(bounds, at[first], "right") - 1
            edges = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
            rows = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                row = [int(part[a]), route, chunk, b - a, packed(key[a:b] if last else key[a:b] & LOW), np.packbits(more[a:b]).tobytes(), None, None]
                if last:
                    mine, place = np.unique(units[owner[a:b]].view(np.uint64) ^ SIGN, return_inverse=True)
                    row[6:] = [packed(mine), place.astype(np.uint16 if len(mine) <= 1 << 16 else np.uint32).tobytes()]
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SENT)], schema=SENT)

    return run


def count(last: bool):
    """Which windows of a range are repeated; at the last level, which start earlier in another chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = C.gathered(batches, SENT)
        part = C.array_of(t, "part")
        for p in np.unique(part).tolist():
            rows = t.filter(pa.array(part == p)).combine_chunks()
            n, chunk = C.array_of(rows, "n").astype(np.int64), C.array_of(rows, "chunk")
            key = np.concatenate([unpacked(k.as_py()) for k in rows.column("keys")])
            row = np.repeat(np.arange(len(n)), n)
            more = np.concatenate([np.unpackbits(np.frombuffer(m.as_py(), np.uint8), count=k) for m, k in zip(rows.column("more"), n.tolist())]).astype(bool)
            if last:
                unit = np.concatenate([unpacked(u.as_py())[np.frombuffer(i.as_py(), np.uint16 if len(i.as_py()) == 2 * k else np.uint32)] for u, i, k in zip(rows.column("units"), rows.column("place"), n.tolist())])
                order = np.lexsort((chunk[row], unit, key))
            else:
                order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            first = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
            times = np.diff(np.r_[first, len(order)])
            again = (times > 1) | np.logical_or.reduceat(more[order], first)
            tell = np.zeros(len(key), bool)
            if last:  # all but those with the first place
                tell[order] = True
                tell[order[first]] = False
            else:
                tell[order] = np.repeat(again, times)
            kept = np.add.reduceat(tell.astype(np.int64), np.cumsum(n) - n)
            ends = np.cumsum(n)
            route = C.array_of(rows, "route")
            out = [(int(route[i]), int(chunk[i]), p, packed(key[ends[i] - n[i] : ends[i]][tell[ends[i] - n[i] : ends[i]]]), None, None) for i in np.flatnonzero(kept)]
            out.append((None, None, p, None, len(first), int(again.sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), TOLD)], schema=TOLD)

    return run


def _finish(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, chunk, first_row = {}, -1, True
        for group in groups(batches):
            if first_row:
                told, first_row = _told(group.column("found").slice(0, 1), True), False
            data, starts, ends, within = _text_words(group, copies=True)
            copy = pc.is_valid(group.column("copy")).to_numpy(zero_copy_only=False)
            size = np.diff(within)
            gone = np.repeat(copy & (size >= window), size)
            # words of texts that are no copies, as the levels saw them
            mine = np.repeat(~copy, size)
            where = np.flatnonzero(mine)
            hashes = W.word_hashes(data, starts[mine], ends[mine])
            for first, _, bounds in _cut(np.r_[0, np.cumsum(np.where(copy, 0, size))], window):
                chunk += 1
                n = int(bounds[-1])
                at = _starts(bounds, window)
                if not len(at):
                    continue
                key = W.grams(hashes[first : first + n], window, seed=13)[at]
                order = np.argsort(key, kind="stable")
                same = np.zeros(len(key), bool)
                same[order[1:]] = key[order[1:]] == key[order[:-1]]
                hit = at[same | among(key, told.get(chunk, np.zeros(0, np.uint64)))]
                if len(hit):
                    step = np.bincount(hit, minlength=n + 1) - np.bincount(hit + window, minlength=n + 1)[: n + 1]
                    gone[where[first : first + n][np.cumsum(step)[:n] > 0]] = True
            yield _result(group.column("_u"), data, starts, ends, within, gone)

    return run


def _result(units: pa.Array, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, within: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    text = np.repeat(np.arange(len(units)), np.diff(within))
    size, stay = np.diff(within), ~gone
    removed = np.bincount(text[gone], minlength=len(units))
    # kept words, each with one space after it, but for a text's last
    s, n, t = starts[stay], ends[stay] - starts[stay], text[stay]
    more = np.r_[t[1:] == t[:-1], False].astype(np.int64) if len(t) else t
    length = np.bincount(t, n + more, len(units)).astype(np.int64) if len(t) else np.zeros(len(units), np.int64)
    parts = []
    for a in range(0, len(s), 1 << 18):
        b = slice(a, a + (1 << 18))
        at = C.ranges(s[b], n[b] + more[b])
        piece = data[np.minimum(at, len(data) - 1)]
        piece[np.cumsum(n[b] + more[b])[more[b] > 0] - 1] = 32
        parts.append(piece)
    body = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    kept = pa.Array.from_buffers(pa.large_string(), len(units), [None, pa.py_buffer(np.r_[0, np.cumsum(length)].astype(np.int64)), pa.py_buffer(body)]).cast(pa.string())
    # runs of removed words, which end with their text
    edge = np.r_[True, text[1:] != text[:-1]] if len(text) else np.zeros(0, bool)
    begin = np.flatnonzero(gone & (edge | ~np.r_[False, gone[:-1]]))
    final = np.flatnonzero(gone & (np.r_[edge[1:], True] | ~np.r_[gone[1:], False])) if len(text) else begin
    spans = pa.StructArray.from_arrays([pa.array((x - within[text[x]]).astype(np.int32)) for x in (begin, final)], fields=list(OUT.field("spans").type.value_type))
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(text[begin], minlength=len(units)))].astype(np.int32)), spans).cast(OUT.field("spans").type)
    return pa.RecordBatch.from_arrays([units, pa.array(size.astype(np.int64)), pa.array(removed.astype(np.int64)), kept, lists], schema=OUT)


def lengths(window: int, base: int) -> list[int]:
    """base, twice that, ..., window."""
    out = [min(base, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


class _Levels:
    """The texts, dealt out, and the numbers of partitions, from the bytes that there are."""

    def __init__(self, texts: DataFrame, partition: int, hashes: int):
        digests = C.cut(texts.select("_u", F.sha2("text", 256).alias("d"), F.octet_length("text").alias("bytes")))
        total = digests.agg(F.sum("bytes")).first()[0] or 0
        # of equal texts all but the first are repeats of it; written by itself, so that Spark can split the join where very many are equal
        first = C.cut(digests.groupBy("d").agg(F.min("_u").alias("first"), F.count("*").alias("c")).where("c > 1"))
        self.copies = C.cut(digests.join(first, "d").where("_u > first").select("_u", F.lit(True).alias("copy")))
        least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.n = max(least, total // partition)
        self.parts = max(least, total // 6 // hashes)
        self.texts = texts.repartition(self.n, "_u")

    def rows(self, told: DataFrame | None) -> DataFrame:
        """(_u, text, copy[, found]), each task's in the order of _u. All joins are by the number that the texts are dealt out by."""
        out = self.texts.join(self.copies, "_u", "left")
        if told is not None:
            answers = told.where("route is not null").groupBy(F.col("route").alias("_u")).agg(F.collect_list(F.struct("chunk", "part", "keys")).alias("found"))
            out = out.join(answers, "_u", "left")
        return out.sortWithinPartitions("_u")

    def level(self, told: DataFrame | None, length: int, before: int | None, window: int) -> DataFrame:
        sent = self.rows(told).mapInArrow(send(length, before, window, self.parts), SENT_DDL)
        return sent.repartition(self.parts, "part").mapInArrow(count(length == window), TOLD_DDL)


def remove_repeated_words(docs: DataFrame, window: int = 20, base: int = BASE, id_col: str = "doc_id", text_col: str = "text", partition: int = PARTITION, hashes: int = RANGE) -> DataFrame:
    """Remove every word covered by a `window`-word sequence that also starts earlier (smaller id,
    or the same text further left). Words are runs of anything but space, \\t, \\n, \\v, \\f and \\r.
    Levels are `base` words, twice that, and so on up to `window`.

    Returns (doc_id, n_words, n_removed, kept, spans): the kept words joined by one space, and the
    removed runs as word numbers. Other columns of docs are not read.
    Null or empty texts have no words and give kept = ''. Null ids sort last; rows that repeat an id
    sort by their text's digest, and of equal rows one counts as the first. An empty table gives none.
    """
    if not 1 <= base <= window:
        raise ValueError("base must be from 1 to window words")
    texts, names = C.unit_texts(docs, id_col, text_col)
    levels, told, before = _Levels(texts, partition, hashes), None, None
    for length in lengths(window, base):  # one plan: each level's answers feed the next, and the texts' exchange is made once
        told, before = levels.level(told, length, before, window), length
    return C.named(levels.rows(told).mapInArrow(_finish(window), OUT_DDL), names)


def level_counts(docs: DataFrame, base: int = BASE, id_col: str = "doc_id", text_col: str = "text", partition: int = PARTITION, hashes: int = RANGE) -> DataFrame:
    """(length, windows, repeated) of each level: candidates, and those met twice or more, among texts that are no copy of another.
    Lengths double until no candidate survives; the last level has none repeated. An empty table has one level, of no window."""
    texts, _ = C.unit_texts(docs, id_col, text_col)
    levels, told, before, length, found = _Levels(texts, partition, hashes), None, None, base, []
    while True:
        told, before = C.cut(levels.level(told, length, before, 1 << 30)), length
        windows, repeated = told.agg(F.sum("windows"), F.sum("repeated")).first()
        found.append((length, windows or 0, repeated or 0))
        if not repeated:
            return docs.sparkSession.createDataFrame(found, "length long, windows long, repeated long")
        length *= 2
