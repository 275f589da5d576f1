import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from causeway.llm import quality as Q
from causeway.llm import toxicity as T


def word(r):
    return "".join(r.choice(["ta", "ri", "on", "es", "he", "lu"]) for _ in range(r.randint(1, 4)))


def good(r):
    return " ".join(word(r) for _ in range(r.randint(3, 120))).capitalize() + "."


def junk(r):
    return r.choice([lambda: good(r).upper().replace(" ", "!! "), lambda: good(r).replace(" ", "%%% "), lambda: " ".join(w for w in [word(r) for _ in range(8)] for _ in range(6))])()


def toxic(r):
    parts = good(r).split()
    for _ in range(r.randint(1, 3)):
        parts.insert(r.randrange(len(parts) + 1), r.choice(["gromp", "blarf", "zikkelig", "zikkelon"]))
    return " ".join(parts)


def test_dual_coordinate_descent_separates():
    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])]
    w, b = Q.dual_coordinate_descent(rows, np.ones(4), np.array([1, 1, 0, 0]), 10.0, epochs=200)
    assert w[0] > 0.5 > -0.5 > w[1] and abs(w[2] - w[3]) < 1e-2
    # rows have unit length, so margins of 1 need weights of the square root of 2
    assert abs(w[0] - 2**0.5) < 0.01 and abs(w[1] + 2**0.5) < 0.01 and abs(b) < 0.01


def test_indicators_cover_whole_texts(monkeypatch):
    r = random.Random(1)
    text = (good(r) * 40).encode()
    whole = Q.indicators(text)
    monkeypatch.setattr(Q, "PIECE", 100)
    assert (Q.indicators(text) == whole).all()
    assert len(Q.indicators(b"")) == 0


def test_quality(spark):
    r = random.Random(5)
    docs = [(i, good(r) if i % 3 else junk(r), 0.0) for i in range(600)] + [(1000, None, 0.0), (1001, "", 0.0)]
    labels = spark.createDataFrame([(i, int(bool(i % 3)), None) for i in range(0, 500)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string, score double").repartition(4)
    model = Q.fit_quality(df, labels, F.col("doc_id") % 2 == 0)
    got = {x.doc_id: x.score for x in Q.with_quality(df, model).collect()}
    assert len(got) == 602 and all(0 <= s <= 1 for s in got.values())
    wrong = sum((got[i] >= 0.3) != bool(i % 3) for i in range(600))
    assert wrong <= 6
    again = {x.doc_id: x.score for x in Q.with_quality(df.repartition(2), Q.fit_quality(df.repartition(7), labels, F.col("doc_id") % 2 == 0)).collect()}
    assert again == got
    for none in (labels.limit(0), labels.where("quality = 1")):
        model = Q.fit_quality(df, none, F.lit(True))
        assert all(0 <= x.score <= 1 for x in Q.with_quality(df, model).collect())


def test_toxicity(spark):
    r = random.Random(6)
    docs = [(i, toxic(r) if i % 5 == 0 else good(r), "x") for i in range(900)] + [(1000, None, "x"), (1001, "", "x")]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(700)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(4)
    model = T.fit_toxicity(df, labels, F.col("doc_id") % 3 != 1)
    got = {x.doc_id: x.score for x in T.with_toxicity(df, model).collect()}
    assert len(got) == 902
    assert sum((got[i] >= 0.7) != (i % 5 == 0) for i in range(900)) <= 9
    assert got[1000] == got[1001] == min(got.values())
    assert all(0 <= x.score <= 1 for x in T.with_toxicity(df, T.fit_toxicity(df, labels.limit(0), F.lit(True))).collect())


def test_grammar_reads_clauses():
    g = T.Grammar({"gromp": 4.0, "zikk*": 3.0})
    plain = g.clause("the gromp came")
    assert plain == 4.0 and g.clause("the zikkeloni came") == 3.0 and g.clause("nothing came") == 0
    assert g.clause("you are a gromp") > plain  # aimed at a target
    assert g.clause("this is not a gromp") < plain  # denied
    assert g.clause("it was said that some gromp came") < plain  # reported
    assert g.clause("kill the weeds") == 0 < g.clause("i will kill you")  # a threat needs a target
    assert g.clause("i will never kill you") < g.clause("i will kill you")
    # negation ends with the clause
    assert g.features("not me. gromp")[1] == g.features("gromp")[1]
    assert g.features("agromp megromp") == (0.0, 0.0, 0.0, 0.0) == g.features(None)


def test_compose_is_function_composition():
    a = T.Transducer(0, {(0, T.NEGATION): (1, T.NEGATION, 1.0), (1, T.INSULT): (0, T.INSULT, 0.5)})
    b = T.Transducer(0, {(0, T.INSULT): (0, T.HIT, 3.0)})
    c = T.compose(a, b)
    state = c.start
    out = []
    for s in (T.INSULT, T.NEGATION, T.INSULT, T.OTHER):
        state, symbol, weight = c.step(state, s)
        out.append((symbol, weight))
    assert out == [(T.HIT, 3.0), (T.NEGATION, 1.0), (T.HIT, 1.5), (T.OTHER, 1.0)]
    step, hit, weight = T.grammar()
    assert step.max() < len(step) and hit.any() and (weight > 0).all()


def test_scores_are_whole_text(spark):
    g = T.Grammar({"gromp": 4.0})
    assert g.features("la " * 200_000 + ". gromp")[2] > 0
    assert isinstance(T._score(T.fit([b"a", b"gromp"], np.array([0, 1])))(pd.Series(["x", None])), pd.Series)


def test_texts_with_one_header_all_count():
    """A license line before every text must neither hide labelled texts nor put them into one fold."""
    r = random.Random(11)
    header = "This text is licensed to all under the terms of the common license. "
    texts = [toxic(r) if i % 6 == 0 else good(r) for i in range(240)]
    y = np.array([int(i % 6 == 0) for i in range(240)])
    plain, headed = T.learn_lexicon(texts, y), T.learn_lexicon([header + t for t in texts], y)
    assert plain and {w.rstrip("*")[:4] for w in plain} == {w.rstrip("*")[:4] for w in headed}
    assert T.learn_lexicon(texts * 3, np.tile(y, 3)) == plain  # equal texts count once
    fold = T.L.folds([(header + t).encode() for t in texts], 3)
    assert min(np.bincount(fold, minlength=3)) > 30
    twin = [t.encode() for t in texts if len(t.split()) > 40]
    near = [t.replace(b" ", b"  ", 1).upper() if k % 2 else t + b" end" for k, t in enumerate(twin)]
    assert (T.L.folds(twin, 3) == T.L.folds(near, 3)).mean() > 0.9


def brute_clause(g, text):
    """The rules of the grammar, one by one, without transducers."""
    total, reported, denied, aimed, threatened = 0.0, False, 0, 0, 0
    for word in T.WORD.findall(text):
        kind, value = g.classes.get(word), 2.0
        if kind is None:
            value = max([g.lexicon.get(word, 0.0), *(g.lexicon.get(word[:k] + "*", 0.0) for k in T.STEMS if len(word) >= k)])
            kind = T.INSULT if value else T.OTHER
        weight = 0.5 if reported and kind in (T.INSULT, T.TARGET) else 1.0
        reported |= kind == T.REPORT
        if denied and kind == T.INSULT:
            weight *= 0.4
        now = T.OTHER if denied and kind == T.THREAT else kind
        denied = 3 if kind == T.NEGATION else max(denied - 1, 0)
        if aimed and now == T.INSULT:
            weight *= 1.5
        aimed = 4 if now == T.TARGET else max(aimed - 1, 0)
        hit = now == T.INSULT or (threatened and now == T.TARGET)
        threatened = 4 if now == T.THREAT else max(threatened - 1, 0)
        total += value * weight if hit else 0.0
    return total


def test_scores_equal_brute_force(spark):
    r = random.Random(12)
    g = T.Grammar({"gromp": 4.0, "zikk*": 3.0, "blarf": 2.5})
    bag = ["gromp", "zikkelon", "blarf", "you", "they", "not", "never", "said", "calls", "kill", "burn", "la", "tarion", "é"]
    clauses = [" ".join(r.choice(bag) for _ in range(r.randint(1, 14))) for _ in range(800)]
    assert all(abs(g.clause(c) - brute_clause(g, c)) < 1e-9 for c in clauses)
    texts = ["".join(r.choice(clauses[:60]) + r.choice([". ", "! ", ", ", ": ", "\n", " - "]) for _ in range(r.randint(0, 6))) for _ in range(300)]
    weights = [0.7, 0.9, -0.2, 1.1, -2.0]

    def brute(text):
        parts = T.BREAK.split(text.lower())
        found = [w for w in map(lambda c: brute_clause(g, c), parts) if w > 0]
        x = [np.log1p(sum(found)), np.log1p(max(found)), np.log1p(len(found)), sum(found) / len(parts)] if found else [0.0] * 4
        return 1 / (1 + np.exp(-(np.dot(x, weights[:-1]) + weights[-1])))

    model = T.pickle.dumps((dict(g.lexicon), weights))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for x in T.with_toxicity(df, model).collect():
        assert abs(x.score - brute(x.text)) < 1e-9, x.text


def test_reported_speech_reaches_over_a_colon():
    g = T.Grammar({"idiot": 4.0})
    top = lambda t: g.features(t)[1]
    assert top("she said: you are an idiot") == top("she said you are an idiot") < top("you are an idiot")
    assert top('"he said: i will kill you"') < top("i will kill you")
    assert top("she said so. you are an idiot") == top("you are an idiot")


def test_quality_equals_a_dense_model():
    """Dense matrices: the primal and dual objectives of the fit meet, and each margin is that of the dense model."""
    r = random.Random(13)
    texts = [(good(r) if i % 3 else junk(r)).encode() for i in range(90)]
    y = np.array([int(bool(i % 3)) for i in range(90)])
    rows = [Q.indicators(t).astype(np.int32) for t in texts]
    x = np.zeros((90, 1 << Q.BITS))
    for k, row in enumerate(rows):
        x[k, row] = 1
    p, q = x[y == 1].sum(0) + 1, x[y == 0].sum(0) + 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    assert np.allclose(ratio, Q.log_count_ratios(rows, y))
    scaled = x * ratio
    scaled /= np.linalg.norm(scaled, axis=1, keepdims=True)
    w, bias = Q.dual_coordinate_descent(rows, ratio, y, 10.0, epochs=400)
    sign, cost = np.where(y == 1, 1.0, -1.0), np.where(y == 1, 45 / (y == 1).sum(), 45 / (y == 0).sum()) * 10.0
    loss = np.maximum(0, 1 - sign * (scaled @ w + bias))
    primal = (w @ w + bias**2) / 2 + cost @ loss
    # any dense descent from here gains next to nothing
    active = loss > 0
    slope = w - scaled[active].T @ (cost * sign)[active]
    for step in (1e-3, 1e-4, 1e-5):
        v, b = w - step * slope, bias - step * (bias - (cost * sign)[active].sum())
        assert (v @ v + b**2) / 2 + cost @ np.maximum(0, 1 - sign * (scaled @ v + b)) > primal * 0.999
    margins = [Q._margin(row, (w * ratio), ratio * ratio, bias) for row in rows]
    assert np.allclose(margins, scaled @ w + bias)


def test_odd_tables(spark):
    """No documents, null ids, repeated rows with contradicting labels, one very long text, columns of the outputs' names."""
    long = good(random.Random(1)) * 3000
    rows = [(None, "x", 1.0), (1, "a b", 2.0), (1, "a b", 2.0), (2, None, None), (3, "", 3.0), (4, long, 4.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (None, 1, 1), (3, 1, 0), (4, 0, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    for fit, score in ((Q.fit_quality, Q.with_quality), (T.fit_toxicity, T.with_toxicity)):
        got = score(df, fit(df, labels, F.lit(True))).collect()
        assert len(got) == 6 and all(0 <= x.score <= 1 for x in got)
        assert score(df.limit(0), fit(df.limit(0), labels, F.lit(True))).count() == 0
