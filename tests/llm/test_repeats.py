"""Exact-substring operators against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from causeway.llm import substring_dedup as D
from causeway.llm import suffix_dedup as S
from causeway.llm.substring_dedup import level_counts, lengths, remove_repeated_words
from causeway.llm.suffix_dedup import remove_repeated_bytes


def corpus(seed, n=60, words=40):
    r = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(words)]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(15, 60))] for _ in range(6)]
    docs = []
    for i in range(n):
        text = []
        for _ in range(r.randint(0, 5)):
            text += r.choice(passages) if r.random() < 0.5 else [r.choice(vocabulary) for _ in range(r.randint(1, 40))]
            if r.random() < 0.3 and text:
                text[r.randrange(len(text))] = "edit"
        docs.append((i, r.choice([" ", "\n", "\t "]).join(text)))
    docs += [(n, docs[3][1]), (n + 1, docs[3][1]), (n + 2, ""), (n + 3, None), (n + 4, "a" * 500), (n + 5, "b" + "a" * 300 + "b"), (n + 6, " ".join(["x"] * 90)), (n + 7, "ab" * 200)]
    r.shuffle(docs)
    return docs


def brute(units, window):
    """units: texts in their order, as sequences. Which units go."""
    seen, out = set(), []
    for text in units:
        gone = [False] * len(text)
        for i in range(len(text) - window + 1):
            key = tuple(text[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out.append(gone)
    return out


@pytest.mark.parametrize("sizes", [{}, {"partition": 2000, "hashes": 50}, {"base": 1}, {"base": 20}, {"base": 7}])
def test_words(spark, sizes):
    docs = corpus(1)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, kept string").repartition(5)
    got = {r.doc_id: r for r in remove_repeated_words(df, **sizes).collect()}
    ordered = sorted(docs)
    units = [(t or "").encode().split() for _, t in ordered]
    assert len(got) == len(docs)
    removed = 0
    for (i, _), words, gone in zip(ordered, units, brute(units, 20)):
        assert got[i].n_words == len(words)
        assert got[i].kept == b" ".join(w for w, g in zip(words, gone) if not g).decode(), i
        assert got[i].n_removed == sum(gone) == sum(s.last - s.first + 1 for s in got[i].spans)
        removed += sum(gone)
    assert removed > 500


def doubling(units, base):
    """Windows of base, 2 base, ... units: those met, among candidates, and those met twice or more, until none is."""
    out, length, again = [], base, None
    while True:
        seen = {}
        for t in units:
            for i in range(len(t) - length + 1):
                a, b = tuple(t[i : i + length // 2]), tuple(t[i + length // 2 : i + length])
                if again is None or (a in again and b in again):
                    key = tuple(t[i : i + length])
                    seen[key] = seen.get(key, 0) + 1
        again = {k for k, n in seen.items() if n > 1}
        out.append((length, len(seen), len(again)))
        if not again:
            return out
        length *= 2


def test_levels_double_until_none_survives(spark):
    docs = corpus(3)
    units, seen = [], set()
    for _, t in sorted(docs):
        units += [] if t in seen else [(t or "").encode().split()]
        seen.add(t)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in level_counts(df, 5, partition=4000).collect()]
    assert got == doubling(units, 5) and len(got) >= 4 and got[-1][2] == 0
    assert lengths(20, 5) == [5, 10, 20] and lengths(50, 7) == [7, 14, 28, 50] and lengths(4, 5) == [4]
    assert [tuple(r) for r in level_counts(df.limit(0)).collect()] == [(5, 0, 0)]


@pytest.mark.parametrize("chunk,piece", [(300, 60), (4000, 45), (1 << 20, 1 << 20)])
def test_levels_in_chunks_and_pieces(monkeypatch, chunk, piece):
    """The tasks' own code, over many small chunks, texts cut into pieces, and batches cut elsewhere."""
    monkeypatch.setattr(D, "CHUNK", chunk)
    monkeypatch.setattr(D, "PIECE", piece)
    docs = sorted((i, t) for i, t in corpus(4) if t)
    first = {}
    copy = [None if first.setdefault(t, i) == i else True for i, t in docs]
    tasks = [[k for k in range(len(docs)) if k % 3 == p] for p in range(3)]
    found = pa.list_(pa.struct([("chunk", pa.int32()), ("part", pa.int32()), ("keys", pa.binary())]))

    def rows(told, size):
        for task in tasks:
            heard = [{"chunk": c, "part": p, "keys": k} for r, c, p, k in told if r == docs[task[0]][0]]
            t = pa.table({"_u": pa.array([docs[k][0] for k in task], pa.int64()), "text": pa.array([docs[k][1] for k in task], pa.string()), "copy": pa.array([copy[k] for k in task], pa.bool_()), "found": pa.array([heard, *[None] * (len(task) - 1)], found)})
            yield iter(t.to_batches(max_chunksize=size))

    told, before = [], None
    for length in (5, 10, 20):
        sent = [b for k, task in enumerate(rows(told, 4 + before if before else 3)) for b in D.send(length, before, 20, 7)(task)]
        answers = [b for b in D.count(length == 20)(iter(sent))]
        told = [(r["route"], r["chunk"], r["part"], r["keys"]) for b in answers for r in b.to_pylist() if r["route"] is not None]
        before = length
    got = {r["_u"]: r for task in rows(told, 9) for b in D._finish(20)(task) for r in b.to_pylist()}
    units = [t.encode().split() for _, t in docs]
    for (i, _), words, gone in zip(docs, units, brute(units, 20)):
        assert got[i]["kept"] == b" ".join(w for w, g in zip(words, gone) if not g).decode()
        assert got[i]["n_removed"] == sum(gone) == sum(s["last"] - s["first"] + 1 for s in got[i]["spans"])


def test_packed_numbers():
    r = np.random.default_rng(1)
    for top in (1, 255, 1 << 20, 1 << 32, 1 << 64):
        a = np.sort(r.integers(0, top, 500, np.uint64, endpoint=top < 1 << 64))
        assert (D.unpacked(D.packed(a)) == a).all()
    assert len(D.unpacked(D.packed(np.zeros(0, np.uint64)))) == 0


@pytest.mark.parametrize("hot", [10_000, 1])
def test_bytes(spark, hot):
    docs = corpus(2)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in remove_repeated_bytes(df, hot_limit=hot).collect()}
    ordered = sorted(docs)
    units = [(t or "").encode() for _, t in ordered]
    removed = 0
    for (i, _), raw, gone in zip(ordered, units, brute(units, 100)):
        assert got[i].n_bytes == len(raw)
        assert bytes(got[i].kept) == bytes(b for b, g in zip(raw, gone) if not g), i
        assert got[i].n_removed == sum(gone) == sum(s.last - s.first + 1 for s in got[i].spans)
        removed += sum(gone)
    assert removed > 3000


def test_repeated_and_missing_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text), (None, None), (2, "z " + text)]
    for f in (remove_repeated_words, remove_repeated_bytes):
        got = f(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == 5
        assert sorted(r.n_removed == 0 for r in got if r[1] > 0) == [False, False, False, True]
        assert f(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order(seed):
    r = np.random.default_rng(seed)
    text = r.integers(97, 97 + [1, 2, 3, 26, 2, 4][seed], 700).astype(np.uint8)
    text[100:300] = text[400:600]
    text[250:290] = 97
    text = np.r_[text, np.zeros(40, np.uint8)]
    wanted = np.sort(r.choice(660, 300, replace=False))
    order = S.suffix_order(text, wanted, 24)
    assert sorted(order) == list(wanted)
    keys = [text[i : i + 24].tobytes() for i in order]
    assert keys == sorted(keys)
    assert list(S.common_prefix_reaches(text, order, 24)) == [a == b for a, b in zip(keys, keys[1:])]
