"""The pipeline on small tables with the cases that large ones have, stage by stage and as a whole."""

import random

import numpy as np
import pytest

import corpus_pipeline as C
from causeway.llm import simhash as S
from causeway.llm.decontaminate import normalized
from causeway.llm.pii import detect
from tests.llm.test_classifiers import good, junk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
MAIL = "ab.12@mail5.example.com"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(9)
    folder = str(tmp_path_factory.mktemp("corpus"))
    item = " ".join(good(r) for _ in range(2))[:200]
    rows = [(i, good(r) + " " + good(r) if i % 4 else junk(r), "en", f"s{i % 3}") for i in range(240)]
    long = " ".join(f"word{r.randint(0, 3000)}" for _ in range(400))
    near = long.split()
    near[100] = "changed"
    extra = {1000: long, 1001: " ".join(near), 1002: long, 1003: item + " " + good(r), 1004: f"{good(r)} {MAIL} {good(r)}", 1005: None, 1006: "", 1007: "x" * 300_000, 1008: good(r)}
    rows += [(i, t, None, None if i == 1008 else "big") for i, t in extra.items()]
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(bool(i % 4)), None) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, item


def test_run(spark, corpus):
    folder, item = corpus
    got = {r.doc_id: r for r in C.run(spark, folder).collect()}
    before = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert set(got) <= set(before) and len(got) > 100
    assert not {1001, 1002, 1003} & set(got)  # near and exact copies, and the benchmark's item
    assert all(normalized(item) not in normalized(r.text or "") and MAIL not in (r.text or "") for r in got.values())
    assert sum(i % 4 == 0 for i in got if i < 240) <= 3
    if 1004 in got:
        assert [k for *_, k in detect(got[1004].text)] == ["email"] and len(got[1004].text) == got[1004].n_chars
    for r in got.values():
        assert r.copies >= 1 and r.taken == r.copies * r.size <= 3 * r.size


@pytest.mark.parametrize("name,stage", C.STAGES)
def test_each_stage(spark, corpus, name, stage):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    last = name == C.STAGES[-1][0]
    out = stage(spark, docs, folder)
    assert last or out.columns == docs.columns
    assert out.count() <= docs.count()
    # rows that repeat an id and a text, null ids, nulls in every column
    odd = spark.createDataFrame([(1, "a b c", "en", "x", 5), (1, "a b c", "en", "x", 5), (None, "a b d " * 9, None, None, None), (None, None, None, None, None), (2, "", "en", "y", 0)], SCHEMA)
    found = stage(spark, odd, folder)
    assert found.count() <= 5 and (last or found.columns == odd.columns)
    assert stage(spark, odd.limit(0), folder).count() == 0


def test_near_copies_are_near(spark):
    r = random.Random(3)
    texts, n = {}, 0
    for family in range(12):
        base = [f"w{r.randint(0, 5000)}" for _ in range(r.choice([60, 150, 500]))]
        for copy in range(4):
            words = list(base)
            for _ in range(copy * len(words) // 300):
                words[r.randrange(len(words))] = f"e{r.randint(0, 10**6)}"
            texts[n] = " ".join(words)
            n += 1
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(900, None, "x"), (901, "", "x"), (902, " ", "x")], "doc_id long, text string, component string").repartition(4)
    kept = {x.doc_id for x in S.keep_one_of_each(df).collect()}
    assert all(4 * f in kept for f in range(12))  # the smallest id of each family stays, and no two families are one
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    near = [i for i in texts if i % 4 and len(sets[i] & sets[i - i % 4]) / len(sets[i] | sets[i - i % 4]) >= 0.9]
    assert sum(i not in kept for i in near) >= 0.95 * len(near)
    assert kept & {900, 901, 902} == {900}


def test_unlike_documents_stay(spark):
    r = random.Random(4)
    df = spark.createDataFrame([(i, good(r) + " " + good(r) + " " + good(r)) for i in range(400)], "doc_id long, text string")
    kept = S.keep_one_of_each(df).count()
    assert kept >= 396  # a few of these are very short


def test_near_copies_equal_brute_force(spark):
    """Families around a similarity of 0.8, with lines in common: every pair at 0.8 is found and no other."""
    r = random.Random(8)
    line = [f"common{k}" for k in range(30)]
    texts = []
    for _ in range(40):
        size = r.choice([3, 7, 12, 40, 90, 300])
        base = [f"v{r.randint(0, 9000)}" for _ in range(size)]
        for _ in range(6):
            words = list(base)
            for _ in range(r.randint(0, max(1, size // 25))):
                words[r.randrange(len(words))] = f"e{r.randint(0, 10**6)}"
            texts.append(" ".join(words + line if r.random() < 0.3 else words))
    # templates: like each other at 0.5 to 0.8, but no near copies
    frame = [f"t{k}" for k in range(100)]
    texts += [" ".join(frame[:60] + [f"x{i}.{k}" for k in range(20)] + frame[60:]) for i in range(30)]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    likes = []
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            likes.append(both / (len(sets[i]) + len(sets[j]) - both))
            if likes[-1] >= 0.8:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    assert sum(0.5 <= x < 0.8 for x in likes) > 300 and sum(0.8 <= x < 0.9 for x in likes) > 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = {i for i in range(len(texts)) if root(i) == i}
    assert {x.doc_id for x in S.keep_one_of_each(df).collect()} == want


def test_helper_columns_may_clash(spark):
    rows = [(1, "a b c d e f", 5, 6), (1, "a b c d e f", 7, 8), (None, "x y", 1, 1), (2, "a b c d e f g h i j k", 2, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int, _gone int")
    got = S.keep_one_of_each(df)
    assert got.columns == df.columns and got.count() == 3
    assert S.keep_one_of_each(df.where("doc_id = 2")).collect()[0]._gone == 2


def roots(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in links:
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    return [root(x) for x in range(n)]


def test_cell_equals_brute_force():
    r = np.random.Generator(np.random.PCG64(6))
    for n in (2, 7, 60, 300):
        bases = [np.unique(r.integers(0, 1 << 63, int(r.integers(1, 200)), np.uint64)) for _ in range(max(1, n // 12))]
        sets = []
        for _ in range(n):
            x = bases[r.integers(len(bases))]
            x = x[r.random(len(x)) > r.choice([0, 0.05, 0.1, 0.15])]
            sets.append(np.unique(np.r_[x, r.integers(0, 1 << 63, max(1 - len(x), len(x) // 30), np.uint64)]))
        pairs = [(i, j) for i in range(n) for j in range(i) if S.similar(sets[i], sets[j])]
        for group in (np.arange(n), np.array(roots(n, pairs[::3]))):
            got = S.near_in_cell(sets, group)
            assert all(S.similar(sets[i], sets[j]) for i, j in got) and len(got) < n
            assert roots(n, got + [(i, int(g)) for i, g in enumerate(group)]) == roots(n, pairs)


@pytest.mark.parametrize("cell", [None, 20_000])
def test_pairs_do_not_grow_with_the_square(spark, monkeypatch, cell):
    """A large family of texts that are alike at 0.7 to 0.8, whole or in blocks: rows of two nodes stay in proportion to the texts."""
    r = random.Random(12)
    lines = [" ".join(f"l{k}.{i}" for i in range(20)) for k in range(40)]
    texts = [" ".join(x for x in lines if r.random() < 0.85) for _ in range(200)]
    sets = [S.shingle_set(t) for t in texts]
    pairs = [(i, j) for i in range(200) for j in range(i) if S.similar(sets[i], sets[j])]
    counts, cut = [], S.C.cut

    def counted(df):
        out = cut(df)
        if out.columns == ["a", "b"]:
            counts.append(out.count())
        return out

    monkeypatch.setattr(S.C, "cut", counted)
    if cell:
        monkeypatch.setattr(S, "CELL", cell)
    kept = {x.doc_id for x in S.keep_one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert 20 < len(pairs) and kept == {i for i, x in enumerate(roots(200, pairs)) if x == i}
    assert counts and max(counts) <= 5 * len(texts) and len(kept) > 20


def test_cells_verify_what_fingerprints_propose():
    """Right, wrong and missing proposals give the components of brute force, cell by cell."""
    r = np.random.Generator(np.random.PCG64(7))
    sets, where = [], []
    for cell in ((1, 0, 0), (1, 0, 1), (5, 0, 0)):
        for base in [np.unique(r.integers(0, 1 << 63, 80, np.uint64)) for _ in range(6)]:
            for _ in range(5):
                sets.append(base[r.random(len(base)) > r.choice([0, 0.06, 0.12])])
                where.append(cell)
    n = len(sets)
    pairs = [(i, j) for i in range(n) for j in range(i) if where[i] == where[j] and S.similar(sets[i], sets[j])]
    wrong = [(i, j) for i in range(n) for j in range(i) if where[i] == where[j] and not S.similar(sets[i], sets[j])]
    for proposed in ([], pairs[::2] + wrong[::9], pairs + wrong):
        rows = [(*where[i], 100 + i, None, x.tobytes()) for i, x in enumerate(sets)] + [(*where[i], 100 + j, 100 + i, None) for i, j in proposed]
        r.shuffle(rows)
        kinds = [S.pa.int64()] * 5 + [S.pa.binary()]
        batch = S.pa.RecordBatch.from_arrays([S.pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names=["c", "low", "high", "node", "other", "shingles"])
        got = [(x["a"] - 100, x["b"] - 100) for b in S._in_cells(iter([batch])) for x in b.to_pylist()]
        assert all(S.similar(sets[i], sets[j]) for i, j in got) and len(got) < n
        assert roots(n, got) == roots(n, pairs)


@pytest.mark.parametrize("names", [None, 0])
def test_texts_and_sets_move_once(spark, monkeypatch, names):
    """The texts are not shuffled while names are few, and no set is written but to its cells; beyond that the same rows stay."""
    r = random.Random(13)
    base = [[f"w{r.randint(0, 5000)}" for _ in range(100)] for _ in range(20)]
    texts = [" ".join(b[:50] + [f"n{k}"] * (k > 0) + b[50:]) for b in base for k in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    written, cut = [], S.C.cut
    monkeypatch.setattr(S.C, "cut", lambda frame: written.append(frame.columns) or cut(frame))
    if names is not None:
        monkeypatch.setattr(S, "NAMES", names)
    kept = S.keep_one_of_each(df)
    assert {x.doc_id for x in kept.collect()} == set(range(0, 60, 3))
    assert not any({"text", "shingles"} & set(columns) for columns in written)
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    assert ("BroadcastHashJoin" in plan) == (names is None) and ("SortMergeJoin" in plan) == (names is not None)
