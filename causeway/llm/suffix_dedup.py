"""Exact-substring dedup over bytes by suffix sorting in two stages.

Suffixes smaller than their successors are sorted directly, by eight bytes at a time; all others
are induced from them by scanning the buckets of first bytes from left to right. Adjacent common
prefixes of `length` bytes or more then give the strings that occur more than once.

The suffixes of a corpus don't fit one task. Each `length`-byte string is routed by its anchor
(see _windows), so all its occurrences reach one task; each task sorts the suffixes of its own
fragments, to `length` bytes, which is the depth at which equality is decided.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from causeway.llm import _common as C
from causeway.llm import _repeats as R
from causeway.llm import _windows as W

#: A random number for each byte.
BYTE = W._random(11, 256)

OUT = pa.schema([("_u", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])


class Bytes(R.Scan):
    def units(self, data, bounds):
        return data, bounds

    def values(self, part):
        return BYTE[part]

    def body(self, part, spans, lo, hi):
        """The bytes of the windows."""
        n = hi - lo + self.window
        return part[C.ranges(lo, n)], n


def _words_at(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as numbers that sort as the bytes do."""
    view = np.lib.stride_tricks.as_strided(text, (len(text) - 7, 8), (1, 1))
    return np.ascontiguousarray(view[at]).view(">u8").ravel().astype(np.uint64)


def _sort_directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """at, in the order of the first `depth` bytes from each."""
    order = np.argsort(first := _words_at(text, at), kind="stable")
    at, first = at[order], first[order]
    group = np.cumsum(np.r_[True, first[1:] != first[:-1]]) if len(at) else np.zeros(0, np.int64)
    done = 8
    while done < depth and len(at):
        tied = np.zeros(len(at), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        k = np.flatnonzero(tied)
        if not len(k):
            break
        near = _words_at(text, at[k] + done)
        order = np.lexsort((near, group[k]))
        at[k] = at[k][order]
        near, g = near[order], group[k][order]
        # a new number for each (group, next bytes); numbers stay in order as they only grow within a group
        fresh = np.cumsum(np.r_[True, (g[1:] != g[:-1]) | (near[1:] != near[:-1])])
        whole = group.astype(np.float64)
        whole[k] += (fresh - fresh[np.searchsorted(g, g, "left")]) / (len(k) + 1)
        group = np.cumsum(np.r_[True, whole[1:] != whole[:-1]])
        done += 8
    return at


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The positions in `wanted`, in the order of their suffixes to `depth` bytes. text ends in `depth` + 8 zero bytes or more."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16)))
    at = np.arange(n - 1, dtype=np.int32)
    nearest = np.minimum.accumulate(np.where(step != 0, at, np.int32(n - 1))[::-1])[::-1]  # the next change of byte
    smaller = np.r_[np.r_[step, 1][nearest] > 0, True]  # than its successor; the zeros at the end count as smaller
    need = np.zeros(n, bool)
    need[wanted] = True
    chain = wanted[~smaller[wanted]]
    while len(chain):  # an induced suffix needs its successor in the order
        chain = chain + 1
        chain = chain[~need[chain]]
        need[chain] = True
        chain = chain[~smaller[chain]]
    direct = _sort_directly(text, np.flatnonzero(need & smaller), depth)
    head = text[direct]
    cuts = np.searchsorted(head, np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        induced = np.concatenate(pending[c]) if pending[c] else np.zeros(0, np.int64)
        pending[c] = []
        full = [induced]
        wave = induced
        while len(wave):  # runs of one byte: each wave is induced from the last
            wave = wave[wave > 0] - 1
            wave = wave[need[wave] & ~smaller[wave] & (text[wave] == c)]
            full.append(wave)
        full.append(direct[cuts[c] : cuts[c + 1]])
        bucket = np.concatenate(full)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[need[before] & ~smaller[before] & (text[before] > c)]
        heads = text[before]
        before = before[np.argsort(heads, kind="stable")]
        heads = np.sort(heads)
        edges = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]]) if len(heads) else []
        for a, b in zip(edges, [*edges[1:], len(heads)]):
            pending[heads[a]].append(before[a:b])
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    mine = np.zeros(n, bool)
    mine[wanted] = True
    return order[mine[order]]


def common_prefix_reaches(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each adjacent pair of order, whether their common prefix has `depth` bytes."""
    alike = np.ones(max(len(order) - 1, 0), bool)
    k = np.arange(len(alike))
    for d in [*range(0, depth - 8, 8), depth - 8] if depth >= 8 else []:
        k = k[_words_at(text, order[k] + d) == _words_at(text, order[k + 1] + d)]
        if not len(k):
            break
    if depth < 8:
        for d in range(depth):
            k = k[text[order[k] + d] == text[order[k + 1] + d]]
    alike[:] = False
    alike[k] = True
    return alike


def _repeated(length: int):
    def run(key, unit, start, n, data, offsets):
        sizes = np.diff(offsets)
        column = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
        same = column.dictionary_encode().indices.to_numpy()
        order = np.lexsort((start, unit, same))
        first = order[np.r_[True, same[order][1:] != same[order][:-1]]] if len(order) else order
        ends = np.cumsum(n)
        flags = np.ones(int(n.sum()), bool)  # of equal fragments, all but the first start earlier elsewhere
        first = np.sort(first)
        text = np.r_[data[C.ranges(offsets[:-1][first], sizes[first])], np.zeros(length + 16, np.uint8)]
        begin = np.cumsum(sizes[first]) - sizes[first]
        wanted = C.ranges(begin, n[first])
        # where each window stands in the corpus, as one number: the text's rank here, then the start
        rank = np.unique(unit[first], return_inverse=True)[1]
        stands = C.ranges(rank << 32 | start[first], n[first])
        slot = np.empty(len(text), np.int32)
        slot[wanted] = np.arange(len(wanted), dtype=np.int32)
        order = suffix_order(text, wanted, length)
        new = np.flatnonzero(np.r_[True, ~common_prefix_reaches(text, order, length)]) if len(order) else np.zeros(0, np.int64)
        order = slot[order]
        least = np.minimum.reduceat(stands[order], new)
        flags[C.ranges((ends - n)[first], n[first])[order]] = stands[order] != np.repeat(least, np.diff(np.r_[new, len(order)]))
        return flags

    return run


def _apply(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, kept, spans = [], [], [], []
            start, n = batch.column("start"), batch.column("n")
            for i, text in enumerate(batch.column("text")):
                raw = (text.as_py() or "").encode()
                n_bytes.append(len(raw))
                if not start[i].is_valid:
                    n_removed.append(0), kept.append(raw), spans.append([])
                    continue
                gone = R.covered(start[i].values.to_numpy().astype(np.int64), n[i].values.to_numpy().astype(np.int64), len(raw), window)
                n_removed.append(int(gone.sum()))
                first, last = R.runs(gone)
                spans.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(first, last)])
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("_u"), *(pa.array(x, f.type) for x, f in zip((n_bytes, n_removed, kept, spans), list(OUT)[1:]))], schema=OUT)

    return run


def remove_repeated_bytes(docs: DataFrame, length: int = 100, gram: int = 24, id_col: str = "doc_id", text_col: str = "text", hot_limit: int = R.HOT_LIMIT) -> DataFrame:
    """Remove every byte covered by a `length`-byte string that also starts earlier (smaller id, or
    the same text further left); overlapping strings count, and matches don't cross texts.

    Returns (doc_id, n_bytes, n_removed, kept, spans): the bytes left, which need not be valid UTF-8,
    and the removed runs as byte positions. Other columns of docs are not read.
    Null or empty texts have no bytes. Null ids sort last; rows that repeat an id sort by their text's
    digest, and of equal rows one counts as the first. An empty table gives none.
    """
    if not 8 <= gram <= length:
        raise ValueError("gram must be from 8 to length bytes")
    texts, names = C.unit_texts(docs, id_col, text_col)
    found = R.repeated_windows(texts, Bytes(length, gram), _repeated(length), hot_limit)
    return C.named(found.mapInArrow(_apply(length), "_u long, n_bytes long, n_removed long, kept binary, spans array<struct<first:int,last:int>>"), names)
