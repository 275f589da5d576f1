"""Benchmark decontamination by q-gram lemma filtering.

A place where an item of m characters stands with at most e edits shares at least m - q + 1 - q e of the
item's q-grams, all of them on diagonals at most e apart. So shared q-grams are counted in
overlapping bands of diagonals; bands that reach the bound are verified by banded alignment.

A q-gram that stands in an item many times (a rule of dashes) would meet every place of a like text at each of
its own. Such q-grams are left out, and the bound falls by the places that they had. An item that has too few
places left is searched by the lemma without diagonals: the text's windows of m + e characters that hold as many
places with any of the item's q-grams as the bound asks, which takes time in proportion to the text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm import _common as C
from causeway.llm import _windows as W

#: Characters of a q-gram.
Q = 8
#: Edits allowed, as a share of an item's characters.
EDITS = 0.1
#: Least width of a band without its overlap.
STEP = 64
#: A q-gram with more places than this in an item is left out of the item's count.
OFTEN = 4
#: Characters of items in one index; a larger benchmark is searched in several passes.
MAX_INDEX_CHARS = 4 << 20
#: Characters of texts, and pairs of places, that are looked at at a time.
PIECE, PAIRS = 1 << 20, 1 << 20


def normalized(text: str) -> str:
    """Lower case, and each run of white space as one space; none at the ends."""
    return " ".join(text.lower().split())


def budget(m: int, edits: float = EDITS) -> int:
    """Edits allowed in an item of m characters: the share, but no more than leave the lemma two q-grams."""
    return max(0, min(int(edits * m), (m - Q + 1 - 2) // Q))


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(data: np.ndarray) -> np.ndarray:
    return W.grams(data.astype(np.uint64), Q)


class Index:
    """q-grams of the items, and where they stand. Arrays are of the size of the items' texts."""

    def __init__(self, items: list[tuple[int, str]], edits: float = EDITS):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.texts = [letters(t) for _, t in items]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([budget(m, edits) for m in self.size.tolist()], np.int64)
        self.step = np.maximum(STEP, 2 * self.edits)
        self.reach = int((self.size + self.edits).max(initial=0))
        n = np.maximum(self.size - Q + 1, 0)
        keys = np.concatenate([_grams(t) for t in self.texts]) if items else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(items), dtype=np.int32), n)
        place = C.ranges(np.zeros(len(n), np.int64), n).astype(np.int32)
        order = np.lexsort((item, keys))
        keys, item, place = keys[order], item[order], place[order]
        # places of q-grams that an item has often are left out of its count
        group = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (item[1:] != item[:-1])]) if len(keys) else np.zeros(0, np.int64)
        times = np.diff(np.r_[group, len(keys)])
        often = np.repeat(times > OFTEN, times)
        self.least = np.bincount(item[~often], minlength=len(items)) - Q * self.edits
        #: Items whose own q-grams leave no evidence, and the bound on places that have any of their q-grams.
        self.hard = [(k, np.unique(_grams(self.texts[k])), int(n[k] - Q * self.edits[k])) for k in np.flatnonzero(self.least < 2).tolist()]
        easy = ~often & (self.least >= 2)[item] if len(item) else often
        keys, self.item, self.place = keys[easy], item[easy], place[easy]
        self.keys, first = np.unique(keys, return_index=True)
        #: Postings as one ascending number each: the q-gram's rank, then the item.
        self.flat = np.repeat(np.arange(len(self.keys)), np.diff(np.r_[first, len(keys)])) * max(len(items), 1) + self.item
        self.bits = max(10, (8 * len(self.keys)).bit_length())
        self.bitmap = np.zeros(1 << self.bits, bool)
        self.bitmap[self._slot(self.keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def candidates(self, data: np.ndarray, bounds: np.ndarray):
        """Arrays (text, item, first diagonal of the band) that share enough q-grams; diagonals count from the text's start."""
        if len(data) < Q or not len(self.keys):
            return
        keys = _grams(data)
        at = np.flatnonzero(self.bitmap[self._slot(keys)])
        near = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        ok = self.keys[near] == keys[at]
        at, near = at[ok], near[ok]
        text = np.searchsorted(bounds, at, "right") - 1
        ok = at + Q <= bounds[text + 1]
        at, near, text = at[ok], near[ok], text[ok]
        # texts with few shared q-grams can't hold any item
        ok = (np.bincount(text, minlength=len(bounds)) >= self.least[self.least >= 2].min())[text]
        at, near, text = at[ok], near[ok], text[ok]
        todo = [(0, len(self.ids))]
        while todo and len(at):  # as many items at a time as make PAIRS pairs
            a, b = todo.pop()
            from_, to = (np.searchsorted(self.flat, near * len(self.ids) + x) for x in (a, b))
            if (to - from_).sum() > PAIRS and b - a > 1:
                todo += [((a + b) // 2, b), (a, (a + b) // 2)]
                continue
            yield self._bands(at, text, bounds, from_, to - from_)

    def _bands(self, at: np.ndarray, text: np.ndarray, bounds: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        post = C.ranges(first, n)
        item, place, text, at = self.item[post].astype(np.int64), self.place[post].astype(np.int64), np.repeat(text, n), np.repeat(at, n)
        _, which, n = np.unique(text * len(self.ids) + item, return_inverse=True, return_counts=True)
        ok = (n[which] >= self.least[item]) if len(item) else np.zeros(0, bool)
        text, item, place, at = text[ok], item[ok], place[ok], at[ok]
        if not len(text):
            return text, item, place
        diagonal = at - bounds[text] - place + self.edits[item]
        step = self.step[item]
        band = diagonal // step
        twice = np.flatnonzero(diagonal % step < 2 * self.edits[item])  # bands overlap by twice the edits, which is a step at most
        row = np.r_[np.arange(len(text)), twice]
        band = np.r_[band, band[twice] - 1]
        # distinct q-grams of the item in each (text, item, band)
        order = np.lexsort((place[row], band, item[row], text[row]))
        key = np.c_[text[row], item[row], band, place[row]][order]
        key = key[np.r_[True, (key[1:] != key[:-1]).any(1)]]
        group = np.flatnonzero(np.r_[True, (key[1:, :3] != key[:-1, :3]).any(1)])
        n = np.diff(np.r_[group, len(key)])
        key = key[group][n >= self.least[key[group, 1]]]
        return key[:, 0], key[:, 1], key[:, 2] * self.step[key[:, 1]] - self.edits[key[:, 1]]

    def verify(self, text: np.ndarray, item: int, low: int) -> tuple[int, int, int] | None:
        """(edits, first, last character) of the best place of an item on diagonals from low, if within its budget."""
        pattern, e = self.texts[item], int(self.edits[item])
        width = int(self.step[item]) + 2 * e
        a, b = max(0, low - e), min(len(text), low + width + len(pattern) + e)
        return self._best(text, item, a, b, low - e - a, low + width + e - a)

    def _best(self, text: np.ndarray, item: int, a: int, b: int, low: int, high: int) -> tuple[int, int, int] | None:
        pattern = self.texts[item]
        if (exact := _find(text[a:b], pattern)) >= 0:
            return 0, a + exact, a + exact + len(pattern) - 1
        found = align(pattern, text[a:b], int(self.edits[item]), low, high)
        return None if found is None else (found[0], a + found[1], a + found[2] - 1)

    def search_hard(self, text: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """The best places of the hard items."""
        out = {}
        keys = _grams(text) if self.hard else np.zeros(0, np.uint64)
        for k, own, bound in self.hard:
            at = np.flatnonzero(own[np.minimum(np.searchsorted(own, keys), len(own) - 1)] == keys) if len(keys) else np.zeros(0, np.int64)
            m, e = int(self.size[k]), int(self.edits[k])
            # windows of m + e characters with as many places
            begin = at[: len(at) - bound + 1][at[bound - 1 :] - at[: len(at) - bound + 1] <= m + e - Q] if len(at) >= bound else at[:0]
            if not len(begin):
                continue
            edge = np.flatnonzero(np.diff(begin) > m + e)
            best = None
            for a, b in zip(begin[np.r_[0, edge + 1]].tolist(), begin[np.r_[edge, len(begin) - 1]].tolist()):
                a, b = max(0, a - m - 2 * e), min(len(text), b + 2 * (m + e))
                for c in range(a, b, PIECE // 8):  # slices that overlap by more than a place of the item is long
                    to = min(b, c + PIECE // 8 + m + e)
                    hit = self._best(text, k, c, to, -m - e, to - c)
                    best = hit if hit and (best is None or hit < best) else best
                    if best and not best[0]:
                        break
                if best and not best[0]:
                    break
            if best:
                out[k] = best
        return out

    def search(self, texts: list[np.ndarray]) -> list[dict[int, tuple[int, int, int]]]:
        """Of each text the items that it holds, as {item: (edits, first, last)}. A long text comes in overlapping pieces."""
        found: list[dict[int, tuple]] = [{} for _ in texts]
        piece, overlap = max(PIECE, 4 * self.reach), self.reach + Q
        some: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            data = np.concatenate([t for *_, t in some]) if some else np.zeros(0, np.uint32)
            bounds = np.r_[0, np.cumsum([len(t) for *_, t in some])].astype(np.int64)
            for rows in self.candidates(data, bounds):
                for t, item, low in zip(*(x.tolist() for x in rows)):
                    row, shift, part = some[t]
                    hit = self.verify(part, item, low)
                    if hit is not None and (hit := (hit[0], hit[1] + shift, hit[2] + shift)) < found[row].get(item, (1 << 40,)):
                        found[row][item] = hit

        for row, text in enumerate(texts):
            found[row] |= self.search_hard(text)
            for a in range(0, max(len(text) - overlap, 1), piece):
                part = text[a : a + piece + overlap]
                if size and size + len(part) > piece + overlap:
                    flush()
                    some, size = [], 0
                some.append((row, a, part))
                size += len(part)
        flush()
        return found


def _find(text: np.ndarray, pattern: np.ndarray) -> int:
    """The first place of pattern, as characters; -1 if there is none."""
    data, wanted, at = text.tobytes(), pattern.tobytes(), 0
    while (at := data.find(wanted, at)) >= 0:
        if at % 4 == 0:
            return at // 4
        at += 1
    return -1


def align(pattern: np.ndarray, text: np.ndarray, limit: int, low: int, high: int) -> tuple[int, int, int] | None:
    """Least edits with which pattern stands in text, within diagonals low to high, and where; None if over limit.
    One row for each character of the pattern; a row is only as wide as the band."""
    width = high - low + 1
    big = 1 << 20
    column = np.arange(low, high + 1)
    cost = np.where((column >= 0) & (column <= len(text)), 0, big)
    start = column.copy()
    step = np.arange(width)
    for i, letter in enumerate(pattern.tolist(), 1):
        column = column + 1
        inside = (column >= 1) & (column <= len(text))
        differs = np.where(inside, text[np.clip(column - 1, 0, max(len(text) - 1, 0))] != letter, True) if len(text) else np.ones(width, bool)
        diagonal = np.where(inside, cost + differs, big)
        down = np.r_[cost[1:] + 1, big]  # a character of the pattern that the text lacks
        down = np.where((column >= 0) & (column <= len(text)), down, big)
        take = down < diagonal
        best = np.where(take, down, diagonal)
        origin = np.where(take, np.r_[start[1:], 0], start)
        # characters that the pattern lacks: from the left, one edit a step
        shifted = best - step
        least = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == least, step, 0))
        cost, start = least + step, origin[source]
        cost = np.where((column >= 0) & (column <= len(text)), cost, big)
        if cost.min() > limit:
            return None
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), int(column[end])


def _search(shared):
    def run(texts: pd.Series) -> pd.Series:
        index: Index = shared.value
        found = index.search([letters(normalized(t)) if isinstance(t, str) else np.zeros(0, np.uint32) for t in texts])
        return pd.Series([[[int(index.ids[k]), first, last, edits] for k, (edits, first, last) in sorted(hits.items())] for hits in found])

    return run


def _found_in_passes(docs: DataFrame, items: DataFrame, parts: int, edits: float, text_col: str) -> DataFrame:
    """(_digest, _hits) of the distinct texts that hold an item. One pass for each part of the items, whose index is
    given up before the next is made; what a pass finds is written to the shared folder."""
    context, out = docs.sparkSession.sparkContext, None
    for k in range(parts):
        shared = context.broadcast(_index(items.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == k), edits))
        hits = docs.select(F.col(text_col).cast("string").alias("_text")).where("_text is not null").withColumn("_hits", F.pandas_udf(_search(shared), "array<array<bigint>>")("_text"))
        now = C.cut(hits.where(F.size("_hits") > 0).select(F.sha2("_text", 256).alias("_digest"), "_hits").dropDuplicates(["_digest"]))
        shared.destroy()
        out = now if out is None else out.unionByName(now)
    return out.groupBy("_digest").agg(F.array_sort(F.flatten(F.collect_list("_hits"))).alias("_hits"))


def _index(items: DataFrame, edits: float) -> Index:
    """Of items whose size has been checked."""
    rows = sorted((r.i, normalized(r.t)) for r in items.collect())
    return Index([r for r in rows if len(r[1]) > Q], edits)


def with_matches(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", name: str = "matches", most: int = MAX_INDEX_CHARS) -> DataFrame:
    """docs with the benchmark items that each whole text holds, in a column `name`, which replaces one of that
    name: array of (item_id, first, last, edits), by item_id; of each item its best place, as characters of the
    normalized text. An item counts if it stands in the text, whole, with at most edits x its characters edits,
    and in an item of under 45 characters no more than leave two of its q-grams whole (see budget).

    Case and runs of white space make no difference. Items of fewer than Q + 1 characters after that are no
    evidence and never match, nor do null texts or items; an empty benchmark gives empty arrays. Rows that repeat
    are searched each by itself. Up to `most` characters of items are broadcast as one index, and no row of docs moves. A larger benchmark is
    dealt into parts by the hash of its ids and searched in as many passes, each with the index of its own part; then
    docs are joined by their texts' digests with the texts found, and all other columns pass through, whatever their names.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    parts = -(-(items.agg(F.sum(F.length("t"))).first()[0] or 0) // most) or 1
    as_struct = lambda m: F.struct(m[0].alias("item_id"), m[1].cast("int").alias("first"), m[2].cast("int").alias("last"), m[3].cast("int").alias("edits"))
    if parts == 1:
        shared = docs.sparkSession.sparkContext.broadcast(_index(items, edits))
        hits = F.pandas_udf(_search(shared), "array<array<bigint>>")(F.col(text_col).cast("string"))
        docs = docs.withColumn(name, hits)
        return docs.withColumn(name, F.transform(name, as_struct))
    digest, found, passed = (C.free(n, docs.columns) for n in ("_key", "_found", "_passed"))
    hits = _found_in_passes(docs, items, parts, edits, text_col).select(F.col("_digest").alias(passed), F.col("_hits").alias(found))
    joined = docs.withColumn(digest, F.sha2(F.col(text_col).cast("string"), 256)).join(hits, F.col(digest) == F.col(passed), "left")
    none = F.array().cast("array<array<bigint>>")
    return joined.withColumn(name, F.transform(F.coalesce(F.col(found), none), as_struct)).drop(digest, found, passed)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs that hold no benchmark item (see with_matches), with their own columns, whatever their names."""
    name = C.free("_matches", docs.columns)
    return with_matches(docs, benchmark, edits, text_col, name=name, **kw).where(F.size(name) == 0).drop(name)
