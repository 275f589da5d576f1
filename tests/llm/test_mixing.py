import hashlib
import random

import pytest

from causeway.llm import mixing as M


def rows(seed):
    r = random.Random(seed)
    out = [(i, " ".join(["w"] * r.choice([0, 1, 3, 10, 40])), r.choice(["b", "a", "a", "a", "a", "z", "é", None])) for i in range(300)]
    return out + [(7, out[7][1], out[7][2]), (None, "x y", "a"), (None, None, "only null"), (1000, "    x\x0b", "A")]


def expected(rows, weights, most):
    words = lambda t: len([w for w in (t or "").encode().replace(b"\x0b", b" ").split()])
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, full = sum(sizes.values()), set()
    while True:
        rest = goal - sum(most * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / open_weight for s in order}
        over = {s for s in order if target[s] > most * sizes[s]}
        if not over:
            break
        full |= over
    taken = {}
    for s in order:
        copies, budget = (int(target[s] // sizes[s]), target[s] % sizes[s]) if sizes[s] else (0, 0)
        copies = min(copies, most)
        budget = target[s] - copies * sizes[s]
        by_hash = {}
        for d, t, q in rows:
            if q == s and words(t):
                key = str(d) if d is not None else "text " + hashlib.md5((t or "").encode()).hexdigest()
                h = int(hashlib.md5(("mix:" + key).encode()).hexdigest()[:15], 16)
                by_hash[h] = by_hash.get(h, 0) + words(t)
        upto, below = 0, 0
        for h in sorted(by_hash):
            if budget <= 0 or (upto + by_hash[h] > budget and upto + by_hash[h] - budget >= budget - upto):
                break
            upto, below = upto + by_hash[h], h + 1
            if upto > budget:
                break
        taken[s] = (copies, below)
    return sizes, target, taken, words


@pytest.mark.parametrize("weights", [(5, 2, 1), (1,), (1, 50)])
def test_mix(spark, weights):
    docs = rows(3)
    sizes, target, taken, words = expected(docs, weights, 3)
    df = spark.createDataFrame([(*d, 1, "k", 3, 4) for d in docs], "doc_id long, text string, source string, taken int, _source string, _whole int, _BELOW int").repartition(5)
    got = M.mix(df, weights=weights).collect()
    assert len(got) == len(docs)
    by_source = {}
    for r in got:
        assert r.size == words(r.text) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        key = str(r.doc_id) if r.doc_id is not None else "text " + hashlib.md5((r.text or "").encode()).hexdigest()
        h = int(hashlib.md5(("mix:" + key).encode()).hexdigest()[:15], 16)
        copies, below = taken[r.source]
        if r.size:
            assert r.taken == r.size * (copies + (h < below)), r
        assert r.taken <= 3 * r.size and (r._source, r._whole, r._BELOW) == ("k", 3, 4)
        by_source[r.source] = by_source.get(r.source, 0) + r.taken
    for s, n in by_source.items():
        assert abs(n - target[s]) <= 80


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(empty).count() == 0
    assert [r.taken for r in M.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], empty.schema)).collect()] == [0, 0]


def test_very_long_texts_and_equal_rows(spark):
    rows = [(1, "w " * 200_000, "a"), (1, "w " * 200_000, "a"), (2, "x", "a"), (3, "y " * 100_000, "b")]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 4 and {r.size for r in got} == {200_000, 1, 100_000}
    assert len({r.taken for r in got if r.doc_id == 1}) == 1  # rows that repeat an id are taken together
