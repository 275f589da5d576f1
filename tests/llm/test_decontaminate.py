import random

import resource
import time

from causeway.llm import decontaminate as D


def best(pattern: str, text: str) -> int:
    """Least edits with which pattern stands anywhere in text (Sellers)."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edit(r, text, n):
    text = list(text)
    for _ in range(n):
        i = r.randrange(len(text))
        k = r.randrange(3)
        if k == 0:
            text[i] = r.choice("xyz")
        elif k == 1:
            del text[i]
        else:
            text.insert(i, r.choice("xyz "))
    return "".join(text)


def test_against_brute_force(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice(["ta", "ri", "on", "es", "he"]) for _ in range(r.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 8, 12, 12, 20, 30])]
    items += [(20, "".join(r.choice("бвгдаеио ") for _ in range(80))), (21, "-" * 60), (22, "ab" * 30 + " " + word() * 4), (23, "=" * 25 + "".join(r.choice("κλμνο") for _ in range(40)))]
    docs = [(1, None), (2, ""), (3, "short"), (4, "-" * 300), (5, "-" * 40 + "+" + "-" * 30), (6, "ab" * 200), (7, "-" * 300)]
    for i in range(90):
        parts = [" ".join(word() for _ in range(r.randint(0, 30)))]
        _, text = r.choice(items)
        text = edit(r, text, r.choice([0, 1, 3, len(text) // 10, len(text) // 9, len(text) // 5, len(text) // 3]))
        if r.random() < 0.3:
            text = text.upper().replace(" ", " \n ")
        docs.append((10 + i, " ".join([*parts, text, " ".join(word() for _ in range(r.randint(0, 30)))])))
    bench = spark.createDataFrame([*items, (None, "x" * 50), (99, None)], "item_id long, text string")
    df = spark.createDataFrame([(*d, 5, 6, 7) for d in docs], "doc_id long, text string, matches int, _key int, _matches int").repartition(4)
    found = 0
    for most in (1 << 24, 60):
        for row in D.with_matches(df, bench, most=most).collect():
            text = D.normalized(row.text or "")
            want = {}
            for i, t in items:
                p = D.normalized(t)
                e = best(p, text)
                if len(p) > D.Q and e <= D.budget(len(p)):
                    want[i] = e
            assert {m.item_id: m.edits for m in row.matches} == want, row
            for m in row.matches:
                p = D.normalized(dict(items)[m.item_id])
                assert best(p, text[m.first : m.last + 1]) == m.edits
            found += len(want)
    assert found > 30
    kept = {r.doc_id for r in D.without_contaminated(df, bench).collect()}
    assert {1, 2, 3} <= kept and len(kept) < len(docs)
    assert D.without_contaminated(df, bench.limit(0)).count() == len(docs)
    assert D.with_matches(df.limit(0), bench).count() == 0


def test_alignment_in_a_band():
    r = random.Random(3)
    for _ in range(200):
        p = "".join(r.choice("abc") for _ in range(r.randint(9, 40)))
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 9))) + edit(r, p, r.randint(0, 4)) + "".join(r.choice("abc") for _ in range(r.randint(0, 9)))
        got = D.align(D.letters(p), D.letters(t), 6, -20, 60)
        want = best(p, t)
        assert (got is None and want > 6) or got[0] == want


def test_long_texts_in_pieces(monkeypatch):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([10, 20, 200])]
    parts, want = [], {}
    for k, item in items:
        for _ in range(3):
            parts += [word() for _ in range(300)]
            parts.append(edit(r, item, len(item) // 12))
    text = D.normalized(" ".join(parts))
    index = D.Index([(k, D.normalized(t)) for k, t in items])
    want = index.search([D.letters(text)])
    assert set(want[0]) == {0, 1, 2}
    monkeypatch.setattr(D, "PIECE", 500)
    monkeypatch.setattr(D, "PAIRS", 50)
    assert index.search([D.letters(text)]) == want


def test_long_items_spread_over_many_diagonals():
    """All edits of an item of 1,500 characters are insertions: its q-grams lie on 150 diagonals."""
    r = random.Random(2)
    item = "".join(r.choice("abcdefghijkl ") for _ in range(1500))
    item = D.normalized(item)
    step = len(item) // 120
    text = "xyz " * 50 + "".join(c + ("#" if k % step == 0 and k else "") for k, c in enumerate(item)) + " zyx" * 50
    index = D.Index([(1, item)])
    (found,) = index.search([D.letters(D.normalized(text))])
    assert found[0][0] == best(item, D.normalized(text)) <= D.budget(len(item))


def test_runs_of_one_character_cost_little():
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    index = D.Index([(1, "-" * 2000), (2, "some words, then a rule " + "-" * 200), (3, "=" * 2000)])
    texts = ["-" * 1_000_000, "=-" * 200_000, "- " * 1000, "some words, then a rule " + "-" * 190 + "++" + "-" * 500]
    found = index.search([D.letters(D.normalized(t)) for t in texts])
    assert [set(f) for f in found] == [{0}, set(), set(), {1}]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000 and time.time() - began < 60
