"""SimHash fingerprints, covering and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from causeway.llm import _components as K
from causeway.llm import simhash as S
from causeway.llm._components import components


def plain(text, words):
    parts = []
    word = ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            parts += [word] * bool(word)
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or [" ".join(parts)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "Ab", "É Ü x", "a b c", "A b c d\x85e", "x " * 70_000, "One TWO three four five one two three"])
def test_fingerprint(text):
    for words in (3, 5):
        assert S.fingerprint(text, words) == plain(text, words)


def reach(fps, t):
    fps = sorted(set(fps))
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= t:
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in fps}


@pytest.mark.parametrize("most", [S.BLOCK, 3])
def test_covering_finds_every_link(most):
    r = random.Random(5)
    fps = [0, 1, 2**64 - 1, 7, 2**31, 2**63, 2**63 + 2**31]
    for _ in range(60):
        f = r.getrandbits(64)
        for _ in range(r.randint(1, 8)):
            fps.append(f)
            for bit in r.sample(range(64), r.randint(1, 4)):
                f ^= 1 << bit
    fp = np.array(sorted(set(fps)), np.uint64)
    key, owner, home = S.anchors_of(fp)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([S.C.longs(key << np.uint64(1) | home), S.C.longs(fp[owner])], names=["anchor", "fp"])
    got = [b for b in S._compare(3, most)(iter([batch]))]
    up = {int(f): int(f) for f in fp}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for b in got:
        for x, y in zip(*(c.to_numpy().view(np.uint64).tolist() for c in b.columns)):
            assert bin(x ^ y).count("1") <= 3
            x, y = root(x), root(y)
            up[max(x, y)] = min(x, y)
    assert {f: root(f) for f in up} == reach([int(f) for f in fp], 3)


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(300, 301), (301, 300), (5, 5), (None, 3), (900, 5), (900, 901)] + [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 300: 300, 301: 300, 900: 0, 901: 0, **{1000 + i: 1000 for i in range(300)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_are_joined_in_one_task(spark, monkeypatch):
    """A long path and a hub: written once and joined at once when one task can hold them, by stars when not, with the same result."""
    r = random.Random(7)
    edges = [(i, i + 1) for i in range(300)] + [(5000, 1000 + i) for i in range(400)] + [(9000 + r.randrange(200), 9000 + r.randrange(200)) for _ in range(150)]
    edges = spark.createDataFrame(edges + edges[:50] + [(None, 1), (8, 8)], "a long, b long").repartition(4)
    written, cut = [], K.cut

    def counted(df):
        written.append(cut(df))
        return written[-1]

    monkeypatch.setattr(K, "cut", counted)
    once = sorted(map(tuple, components(edges).collect()))
    assert len(written) == 1
    counts = []
    for most in (0, 450):  # never few, and few after some rounds
        monkeypatch.setattr(K, "ONE_TASK", most)
        written.clear()
        assert sorted(map(tuple, components(edges).collect())) == once
        counts.append(len(written))
    assert counts[0] >= counts[1] >= 3
    links = [(x, y) for x, y in edges.collect() if x is not None and x != y]
    up = {x: x for e in links for x in e}
    while any(up[x] != up[y] for x, y in links):
        for x, y in links:
            up[x] = up[y] = min(up[x], up[y])
    assert once == sorted(up.items())


def test_operator(spark):
    r = random.Random(2)
    base = [" ".join(r.choice(["ta", "Po", "ke", "lu", "mi"]) + str(r.randint(0, 30)) for _ in range(120)) for _ in range(8)]
    docs = [(None, base[0]), (77, None), (78, ""), (3, "two words")]
    for i in range(60):
        words = r.choice(base).split()
        for _ in range(r.randint(0, 3)):
            words[r.randrange(120)] = "edit"
        docs.append((100 + i, " ".join(words)))
    docs.append((100, docs[-1][1]))
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, component_id int").repartition(3)
    roots = reach([plain(t, 3) for _, t in docs], 3)
    least = {}
    for i, t in docs:
        if i is not None:
            k = roots[plain(t, 3)]
            least[k] = min(i, least.get(k, i))
    got = sorted(map(tuple, S.simhash_components(df).collect()), key=str)
    assert got == sorted(((i, f"{plain(t, 3):016x}", least.get(roots[plain(t, 3)])) for i, t in docs), key=str)
    assert S.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
