"""SimHash near-dedup with anchor-point covering.

Two 64-bit fingerprints with at most 3 differing bits differ in at most one bit of one of their
halves. The anchors of a half are the words of the [31, 26] Hamming code times the last bit;
every 32-bit value lies within the code's covering radius, 1, of its home anchor. A fingerprint
goes to its home and, as a copy, to every anchor within the covering radius plus 1: so of two
that differ in at most one bit of the half, the copy of one meets the other at its home. Each anchor
compares its homes with all that came, in blocks, and reports only links that join two so far
unjoined fingerprints, which keeps every component and no more rows than fingerprints.

near_copies, for the pipeline, verifies such links by the texts' sets of shingles. Texts at a similarity of
0.8 differ in about 10 bits, beyond any covering of bounded size, so an exact search adds what the links lack.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm import _common as C
from causeway.llm import _windows as W
from causeway.llm._components import Forest, components

THRESHOLD = 3
BLOCK = 1 << 21
#: Rows that a task holds at most, about, and the mean number of anchors that a fingerprint goes to.
ROWS_A_TASK, COPIES = 4 << 20, 31
SEED = 42
#: Hashes whose bits are counted at once.
SLICE = 1 << 15

_POSITION = np.arange(1, 32, dtype=np.uint64)
#: For a syndrome s, the masks that lead from a value to all code words at distance 1 or 2.
_STEPS = np.array([[(1 << (s - 1)) if i == s else (1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i == s or i < i ^ s] for s in range(1, 32)], np.uint64)
_BYTE_SYNDROME = np.zeros((4, 256), np.uint64)
for _i in range(31):
    _BYTE_SYNDROME[_i // 8] ^= np.where((np.arange(256) >> (_i % 8)) & 1, np.uint64(_i + 1), np.uint64(0))


def majority(slices: Iterable[np.ndarray]) -> int:
    """The SimHash of hashes that come in slices: a bit is 1 if over half of them have it; 0 without any."""
    counts, n = np.zeros(64, np.int64), 0
    for h in slices:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """A bit is 1 if it is set in over half of the XXH64 values (seed 42) of the text's shingles of
    `words` words, repeats included; A-Z count as a-z. A shorter text is one shingle; without words, 0."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    n = max(len(parts) - words + 1, 1)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    ends = ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[a : a + SLICE], ends[a : a + SLICE])), np.uint64) for a in range(0, n, SLICE))


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), C.longs(prints)], names=["doc_id", "fp"])

    return run


def with_fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp), one row per row of docs."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints(words), "doc_id long, fp long")


def anchors_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index into fp, whether it is the home), for both halves."""
    keys, owners, homes = [], [], []
    every = np.arange(len(fp))
    for half in (0, 1):
        v = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        top, x = v & np.uint64(1 << 31), v & np.uint64((1 << 31) - 1)
        s = np.zeros(len(fp), np.uint64)
        for byte in range(4):
            s ^= _BYTE_SYNDROME[byte][((x >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)]
        tag = np.uint64(half << 32)
        home = x ^ np.where(s > 0, np.uint64(1) << (np.maximum(s, 1) - np.uint64(1)), np.uint64(0))
        keys += [home | top | tag, home | (top ^ np.uint64(1 << 31)) | tag]
        owners += [every, every]
        homes += [np.ones(len(fp), bool), np.zeros(len(fp), bool)]
        off = np.flatnonzero(s)
        steps = _STEPS[s[off].astype(np.int64) - 1]
        around = x[off][:, None] ^ steps
        far = around != home[off][:, None]
        keys.append((around | (top[off] | tag)[:, None])[far])
        owners.append(np.repeat(off, steps.shape[1])[far.ravel()])
        homes.append(np.zeros(int(far.sum()), bool))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(homes)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, fp) for each anchor of each fingerprint; a home has the odd number."""
    for batch in batches:
        every = batch.column(0).to_numpy().view(np.uint64)
        for a in range(0, len(every), 10_000):
            fp = every[a : a + 10_000]
            key, owner, home = anchors_of(fp)
            yield pa.RecordBatch.from_arrays([C.longs(key << np.uint64(1) | home), C.longs(fp[owner])], names=["anchor", "fp"])


def _spread(members: np.ndarray, near):
    """Links that reach every member of a large group from those already reached: each new one is
    compared with the unreached only, so a group of close fingerprints shrinks at once."""
    left = members
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            found = []
            size = max(1, BLOCK // len(left))
            for a in range(0, len(front), size):
                close = near(front[a : a + size, None], left[None, :])
                hit = close.any(0)
                if hit.any():
                    found.append(left[hit])
                    yield front[a : a + size][close[:, hit].argmax(0)], found[-1]
                    left = left[~hit]
                if not len(left):
                    break
            front = np.concatenate(found) if found else front[:0]


def _compare(threshold: int, most: int = BLOCK):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = C.gathered(batches, pa.schema([("anchor", pa.int64()), ("fp", pa.int64())]))
        if not len(t):
            return
        anchor = C.array_of(t, "anchor").view(np.uint64)
        own, fp = np.unique(C.array_of(t, "fp").view(np.uint64), return_inverse=True)
        order = np.argsort(anchor, kind="stable")
        home, key, fp = (anchor[order] & np.uint64(1)).astype(bool), anchor[order] >> np.uint64(1), fp[order]
        value = own[fp]

        def near(i, j):
            return np.bitwise_count(value[i] ^ value[j]) <= threshold

        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[new, len(key)])
        n_home = np.add.reduceat(home.astype(np.int64), new)
        # homes have the larger number, so they are the last of their anchor
        forest, links = Forest(len(own)), []

        def add(i, j):
            kept = forest.join(fp[i], fp[j])
            if kept:
                links.append((fp[i][kept], fp[j][kept]))

        some = np.flatnonzero((n_home > 0) & (sizes > 1))
        pairs = n_home[some] * sizes[some]
        for g in some[pairs > most]:
            members = np.arange(new[g], new[g] + sizes[g])
            for i, j in _spread(members[np.unique(fp[members], return_index=True)[1]], near):
                add(i, j)
        some = some[pairs <= most]
        pairs = n_home[some] * sizes[some]
        block = (np.cumsum(pairs) - 1) // most if len(pairs) else pairs
        for part in np.split(some, np.flatnonzero(np.diff(block)) + 1) if len(some) else []:
            hs = C.ranges(new[part] + sizes[part] - n_home[part], n_home[part])
            reach = np.repeat(sizes[part], n_home[part])
            i, j = np.repeat(hs, reach), C.ranges(np.repeat(new[part], n_home[part]), reach)
            close = np.flatnonzero((fp[i] != fp[j]) & near(i, j))
            add(i[close], j[close])
        if links:
            a, b = (np.concatenate(x) for x in zip(*links))
            yield pa.RecordBatch.from_arrays([C.longs(own[a]), C.longs(own[b])], names=["a", "b"])

    return run


def near_links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """prints: distinct fingerprints, column fp. Links (a, b) between fingerprints at most `threshold`
    (3 or less) bits apart: enough of them to give every component."""
    if not 0 <= threshold <= 3:
        raise ValueError("the covering holds for up to 3 bits")
    n = C.partitions(prints.sparkSession, prints.count() * COPIES, ROWS_A_TASK)
    copies = prints.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    return copies.repartition(n, F.shiftright("anchor", 1)).mapInArrow(C.lean(_compare(threshold)), "a long, b long").distinct()


def simhash_components(docs: DataFrame, words: int = 3, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of docs: the 64-bit SimHash as 16
    hexadecimal digits, and the smallest id that the document reaches by links of at most
    `threshold` differing bits, its own included.

    Equal fingerprints are one node, so a group of copies of any size costs one row. Null or empty
    texts have fingerprint zero and link like any other. A null id takes part in links but is never a
    component's id, unless all its ids are null. Other columns of docs are not read.
    """
    prints = C.cut(with_fingerprints(docs, words, id_col, text_col))
    nodes = C.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(near_links(nodes, threshold))
    nodes = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = nodes.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Near copies share at least LIKE[0] / LIKE[1] of the union of their sets of shingles.
LIKE = 4, 5
#: Texts that tell how common shingles are, and the number of them from which a shingle is common.
SAMPLE, COMMON = 10_000, 2


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted hashes of a text's shingles of `words` words (a shorter text is one shingle; without words, none). A-Z count as a-z."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _ = W.words(data, np.array([0, len(data)]))
    h = W.word_hashes(data, starts, ends, lower=True)
    return np.unique(W.grams(h, min(words, len(h)))) if len(h) else np.zeros(0, np.uint64)


#: What a cell gets: a set, without `other`, or a link (node, other) between two of its sets that the fingerprints propose, without shingles.
CELLS = "c long, low long, high long, node long, other long, shingles binary"


#: Bytes of sets that leave a worker at once, about.
SENT = 4 << 20


def _sets(words: int):
    """Of (c, _in, _of, text): the text's set for each cell of component c that its block, _in of _of, is in."""
    schema = pa.schema([*((k, pa.int64()) for k in ("c", "low", "high", "node", "other")), ("shingles", pa.binary())])

    def packed(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for c, own, of, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                found = shingle_set(text.as_py(), words).tobytes()
                node = int(np.uint64(xxhash.xxh3_64_intdigest(found)).view(np.int64))
                for to in range(of):
                    if to != own or of == 1:
                        rows.append((c, min(own, to), max(own, to), node, None, found))
                        held += len(found)
                        if held > SENT:
                            yield packed(rows)
                            rows, held = [], 0
            if rows:
                yield packed(rows)

    return run


def _shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([C.longs(shingle_set(t.as_py(), words))], names=["shingle"])

    return run


def shared_at_least(size):
    """How many shingles of its prefix a set shares with that of any near copy at least. Of a near copy no smaller than
    itself, a set of n shingles has 0.8 n or more, and 0.8 n less this number are beyond its prefix; and as 0.8 n less this
    number, rounded as here, never falls with n, it holds for the larger of the two as well."""
    return -(-size // 10)


def prefix(shingles: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles in one order for all sets (common ones last, by how often they are), as many as two sets of a
    similarity of LIKE or more need to have shared_at_least() of them in common."""
    n = len(shingles)
    if not n:
        return shingles
    k = n - -(-n * LIKE[0] // LIKE[1]) + shared_at_least(n)
    if not len(common):
        return shingles[:k]
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    return shingles[np.argsort(np.where(common[at] == shingles, often[at], 0), kind="stable")[:k]]


def _prefixes(words: int, common: np.ndarray, often: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, firsts = np.zeros(len(batch), np.uint64), np.zeros(len(batch), np.int64), []
            prints = np.zeros(len(batch), np.uint64)
            for k, t in enumerate(batch.column(1)):
                own = shingle_set(t.as_py(), words)
                nodes[k], sizes[k] = xxhash.xxh3_64_intdigest(own.tobytes()), len(own)
                prints[k] = majority(own[a : a + SLICE] for a in range(0, len(own), SLICE))
                firsts.append(prefix(own, common, often).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), C.longs(nodes), C.longs(sizes), C.longs(prints), pa.array(firsts, pa.binary())], names=["_u", "node", "size", "fp", "prefix"])

    return run


#: Parts of the hash range for each partition, so that partitions are of about one size.
PARTS = 8


def _by_shingle(parts: int):
    """Of (node, size, prefix): the shingles of prefixes with their nodes and sizes, packed for each part of the hash range;
    once for each node in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            batch = batch.filter(pa.array([x not in seen and not seen.add(x) for x in nodes], pa.bool_()))
            for a in range(0, len(batch), 1024):
                some = batch.slice(a, 1024)
                data, bounds = C.text_bytes(some.column(2))
                shingle, n = np.frombuffer(data.tobytes(), np.uint64), np.diff(bounds) // 8
                part = ((W.scramble(shingle) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                columns = [shingle[order], *(np.repeat(some.column(k).to_numpy().astype(t), n)[order] for k, t in ((0, np.int64), (1, np.int32)))]
                counts = np.bincount(part, minlength=parts)
                of = np.flatnonzero(counts)
                ends = np.r_[0, np.cumsum(counts[of])]
                yield pa.RecordBatch.from_arrays([C.longs(of), *(C.binaries(c.view(np.uint8), ends * c.itemsize) for c in columns)], names=["part", "shingle", "node", "size"])

    return run


PACKED, MET, PAIRS = "part long, shingle binary, node binary, size binary", "shingle long, node long, size long", "a long, b long"


def _met(shingle: np.ndarray, node: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by shingle and size without repeats, and whether each of its rows has the shingle of the next row and a size that a near copy of that
    may have. As sizes are in order, two near copies with a shingle in common are joined by a chain of such rows."""
    order = np.lexsort([node, size, shingle])
    new = np.r_[True, np.diff(shingle[order]) != 0]
    order = order[new | np.r_[True, np.diff(node[order]) != 0]] if len(order) else order
    same = shingle[order[1:]] == shingle[order[:-1]]
    return order, same & (size[order[:-1]] * LIKE[1] >= size[order[1:]] * LIKE[0])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose shingle has another node, too, of a size that allows a near copy; each once."""
    kinds = (("shingle", np.uint64), ("node", np.int64), ("size", np.int32))
    t = C.gathered(batches, pa.schema([("part", pa.int64()), *((c, pa.binary()) for c, _ in kinds)]))
    if len(t):
        columns = [C.text_bytes(t.column(c))[0].view(kind) for c, kind in kinds]
        order, chained = _met(*(c.astype(np.int64) if c.itemsize == 4 else c for c in columns))
        order = order[np.r_[chained, False] | np.r_[False, chained]]
        for a in range(0, len(order), 1 << 16):
            yield pa.RecordBatch.from_arrays([C.longs(c[order[a : a + (1 << 16)]]) for c in columns], names=["shingle", "node", "size"])


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between nodes that may be near copies by a shingle here, enough of them to give every component."""
    t = C.gathered(batches, pa.schema([(c.split()[0], pa.int64()) for c in MET.split(", ")]))
    if len(t):
        shingle, node, size = (C.array_of(t, c) for c in ("shingle", "node", "size"))
        order, chained = _met(shingle, node, size)
        own, node = np.unique(node[order], return_inverse=True)
        pairs = np.unique(np.minimum(node[:-1], node[1:])[chained] * len(own) + np.maximum(node[:-1], node[1:])[chained])
        a, b = pairs // len(own), pairs % len(own)
        kept = Forest(len(own)).join(a, b)
        yield pa.RecordBatch.from_arrays([C.longs(own[a[kept]]), C.longs(own[b[kept]])], names=["a", "b"])


def _suffix(size: np.ndarray) -> np.ndarray:
    """How many shingles of a set are beyond the first of which two near copies share one."""
    return -(-size * LIKE[0] // LIKE[1]) - 1


def near_in_cell(sets: list[np.ndarray], group: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) between sets at a similarity of LIKE or more, enough of them to give every component; sets of equal group are
    joined already. Each set is compared with those not yet reached only, and of these with those that share enough of its
    rarest shingles, so sets that are joined, or unlike, cost little; no pair leaves this function unless it joins two components."""
    m, size = len(sets), np.array([len(x) for x in sets])
    start = np.cumsum(size) - size
    values, flat, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), size)
    flat = flat[np.lexsort([flat, often[flat], owner])]
    few = size - _suffix(size)
    first = np.flatnonzero((np.arange(len(flat)) - start[owner] < few[owner]) & (often[flat] > 1))
    first = first[np.argsort(flat[first], kind="stable")]
    key, at = flat[first], owner[first]
    by = np.argsort(group, kind="stable")
    bounds = np.flatnonzero(np.r_[True, np.diff(group[by]) != 0, True])
    members = [by[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    mine = np.empty(m, np.int64)
    mine[by] = np.repeat(np.arange(len(members)), np.diff(bounds))
    reached, own, links = np.zeros(m, bool), np.zeros(len(values), bool), []
    left = indexed = m + 1
    for x in range(m):
        if reached[x]:
            continue
        front = members[mine[x]].tolist()
        reached[front] = True
        left -= len(front)
        while front and left > 1:
            if 2 * left <= indexed or indexed > m:  # the index has only those not yet reached
                still = ~reached[at]
                key, at, indexed = key[still], at[still], left
                counts = np.bincount(key, minlength=len(values))
                begin = np.cumsum(counts) - counts
            i = front.pop()
            ids = flat[start[i] : start[i] + few[i]]
            met = at[C.ranges(begin[ids], counts[ids])]
            met, n = np.unique(met[~reached[met]], return_counts=True)
            both = size[i] + size[met]
            may = n >= -(-both * LIKE[0] // sum(LIKE)) - np.maximum(_suffix(size[i]), _suffix(size[met]))
            met = met[may & (np.minimum(size[i], size[met]) * LIKE[1] >= np.maximum(size[i], size[met]) * LIKE[0])]
            if not len(met):
                continue
            ids = flat[start[i] : start[i] + size[i]]
            own[ids] = True
            for a in range(0, len(met), 256):
                j = met[a : a + 256]
                shared = np.add.reduceat(own[flat[C.ranges(start[j], size[j])]].astype(np.int64), np.cumsum(size[j]) - size[j])
                for k in j[shared * sum(LIKE) >= (size[i] + size[j]) * LIKE[0]].tolist():
                    if not reached[k]:
                        links.append((i, k))
                        reached[members[mine[k]]] = True
                        front += members[mine[k]].tolist()
                        left -= len(members[mine[k]])
            own[ids] = False
    return links


def _in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of CELLS: links between near copies in each cell (c, low, high), enough of them to give every component of the cell. Those that
    the fingerprints propose are verified first, and what they join isn't compared again."""
    keys = ("c", "low", "high", "node")
    t = C.gathered(batches, pa.schema([*((k, pa.int64()) for k in (*keys, "other")), ("shingles", pa.binary())]))
    proposed = pc.is_valid(t.column("other"))
    pairs, t = t.filter(proposed), t.filter(pc.invert(proposed))
    if not len(t):
        return
    *cell, node = (C.array_of(t, k) for k in keys)
    data, bounds = C.text_bytes(t.column("shingles"))
    data, bounds = data.view(np.uint64), bounds // 8
    order = np.lexsort([node, *cell])
    new = np.flatnonzero(np.r_[True, np.any([np.diff(k[order]) != 0 for k in cell], axis=0), True])
    by: dict[tuple, list] = {}
    for *at, x, y in zip(*(C.array_of(pairs, k).tolist() for k in (*keys, "other"))):
        by.setdefault(tuple(at), []).append((x, y))
    a, b = [], []
    for rows in (order[x:y] for x, y in zip(new[:-1], new[1:]) if y > x + 1):
        sets, own = [data[bounds[r] : bounds[r + 1]] for r in rows.tolist()], node[rows]
        forest, links = Forest(len(rows)), []
        for i, j in np.searchsorted(own, np.array(by.get(tuple(int(k[rows[0]]) for k in cell), []), np.int64).reshape(-1, 2)).tolist():
            if forest.root(i) != forest.root(j) and similar(sets[i], sets[j]):
                forest.join(np.array([i]), np.array([j]))
                links.append((i, j))
        for i, j in links + near_in_cell(sets, np.fromiter(map(forest.root, range(len(rows))), np.int64, len(rows))):
            a.append(own[i])
            b.append(own[j])
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * LIKE[1] >= (len(x) + len(y) - both) * LIKE[0]


#: Rows of one to four numbers that are broadcast at most, instead of texts being shuffled: texts to compare, and those to drop.
NAMES = 2_000_000
#: Shingles of the sets that are compared in one place, about.
CELL = 2 << 20


def linked(nodes: DataFrame) -> DataFrame:
    """nodes (node, fp), node unique: pairs a < b of nodes that are linked by fingerprints, each node with the least one of its
    fingerprint and these with each other by the covering's links."""
    heads = C.cut(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    of = lambda end: heads.select(F.col("fp").alias(end), F.col("head").alias(f"h{end}"))
    across = near_links(heads).join(of("a"), "a").join(of("b"), "b").select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
    return nodes.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).union(across)


def near_copies(texts: DataFrame, words: int = 5) -> DataFrame:
    """texts: (_u, text), _u unique. Returns (_u, first): of each text with near copies, the smallest _u among them.

    Texts are near copies if the Jaccard similarity of their sets of five-word shingles is 0.8 or more, and by chains of
    such pairs. Links between SimHash fingerprints of the sets, by anchor points, give the first candidates. They alone would lose
    most pairs near 0.8, so the search is made exact: near copies share a tenth of their shingles among the first of each (see prefix),
    whatever the order, so a text that shares fewer there with all others has none. The rest are linked by those shingles, and each
    component's sets meet in one place, or block by block if it is large (CELL), where the fingerprints' links are verified and all that they haven't
    joined are compared. Only links that join two components leave a task, so no rows grow with the square of a group. Texts with equal
    sets are one node; texts without a word are copies of each other.
    """
    spark, total = texts.sparkSession, texts.count()
    # a sample decides only on the order, which no result depends on
    some = texts.where(F.pmod(F.xxhash64("_u"), F.lit(max(1, total // SAMPLE))) == 0).select("text")
    counts = some.mapInArrow(_shingles(words), "shingle long").groupBy("shingle").count().where(F.col("count") >= COMMON).toArrow()
    common, often = counts.column(0).to_numpy().view(np.uint64), counts.column(1).to_numpy()
    common, often = common[order := np.argsort(common)], often[order].astype(np.int32)
    prints = C.cut(texts.mapInArrow(_prefixes(words, common, often), "_u long, node long, size long, fp long, prefix binary"))
    # as many partitions as their rows need, three tenths of all shingles
    n = C.partitions(spark, (prints.agg(F.sum("size")).first()[0] or 0) * 3 // 10, ROWS_A_TASK)
    packed = prints.select("node", "size", "prefix").mapInArrow(_by_shingle(n * PARTS), PACKED)
    met = C.cut(packed.repartition(n, "part").mapInArrow(C.lean(_shared), MET))
    enough = met.groupBy("node", "size").agg(F.count("*").alias("_n")).where(F.col("_n") >= F.expr("(size + 9) div 10"))
    nodes = C.cut(enough.select("node", "size").join(prints.groupBy("node").agg(F.min("_u").alias("_first"), F.min("fp").alias("fp")), "node"))
    # while they are few, no text moves
    small = (lambda df: F.broadcast(df)) if nodes.count() <= NAMES else (lambda df: df)
    # all that may be near copies of each other, by cells: one for a component, or one for each two blocks of it
    chained = met.join(small(nodes.select("node")), "node", "left_semi").select("shingle", "node", "size")
    places = C.cut(components(C.cut(chained.repartition(n, "shingle").mapInArrow(C.lean(_chains), PAIRS))))
    places = places.withColumnRenamed("component", "c").join(nodes.select("node", "size", "_first"), "node")
    blocks = places.groupBy("c").agg(F.expr(f"cast(ceil(sum(size) / {CELL}) as int)").alias("_of"))
    places = C.cut(places.join(blocks, "c").withColumn("_in", F.expr("cast(pmod(xxhash64(node), _of) as int)")))
    # near copies share a shingle, so links between two components need no verification
    of = lambda end: places.select(F.col("node").alias(end), F.col("c").alias(f"c{end}"), F.col("_in").alias(f"i{end}"), F.col("_of").alias(f"of{end}"))
    others = F.explode(F.expr("if(ia <> ib, array(ib), if(ofa = 1, array(0), filter(sequence(0, ofa - 1), x -> x <> ia)))"))
    links = linked(nodes.select("node", "fp")).join(of("a"), "a").join(of("b"), "b").where("ca = cb").select("ca", "a", "b", "ia", others.alias("_to"))
    links = links.select("ca", F.least("ia", "_to").cast("long"), F.greatest("ia", "_to").cast("long"), "a", "b", F.lit(None).cast("binary"))
    m = C.partitions(spark, places.agg(F.sum(F.col("size") * F.greatest(F.lit(1), F.col("_of") - 1))).first()[0] or 0, ROWS_A_TASK)
    # the sets move once, from the texts to their cells
    sets = texts.join(small(places.select("_first", "c", "_in", "_of")), F.col("_u") == F.col("_first")).select("c", "_in", "_of", "text")
    cells = sets.mapInArrow(_sets(words), CELLS).union(links).repartition(m, "c", "low", "high")
    joined = C.cut(components(C.cut(cells.mapInArrow(C.lean(_in_cells), PAIRS))))
    named = prints.select("_u", "node").join(joined, "node", "left").select("_u", F.coalesce("component", "node").alias("c"))
    named = C.cut(named)
    # written by itself, so that the join below gets plain rows, which Spark can split where a group is very large
    least = C.cut(named.groupBy("c").agg(F.min("_u").alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    return named.join(least, "c").select("_u", "first")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs without those that are near copies (see near_copies) of a row with a smaller id; all columns
    pass through, whatever their names. Rows that repeat an id, and null ids, which sort last, count as rows of their own."""
    row, dropped = C.free("_row", docs.columns), C.free("_gone", docs.columns)
    twice = docs.groupBy(F.col(id_col).alias("_id")).count().where("count > 1 or _id is null").limit(1)
    key, repeated = id_col, not twice.isEmpty()
    if repeated:
        docs = docs.orderBy(F.col(id_col).asc_nulls_last(), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
        docs, key = C.cut(docs.withColumn(row, F.monotonically_increasing_id())), row
    gone = near_copies(docs.select(F.col(key).cast("long").alias("_u"), F.col(text_col).cast("string").alias("text")), **kw).where("_u <> first")
    gone = C.cut(gone.select(F.col("_u").alias(dropped)))
    kept = docs.join(F.broadcast(gone) if gone.count() <= NAMES else gone, F.col(key) == F.col(dropped), "left_anti")
    return kept.drop(row) if repeated else kept
