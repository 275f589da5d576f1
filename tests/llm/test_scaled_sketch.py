import hashlib
import random

from pyspark.sql import functions as F

from causeway.llm import scaled_sketch as S


def test_next_and_edited(spark, monkeypatch):
    monkeypatch.setattr(S, "ROWS_A_BUCKET", 7)
    r = random.Random(4)
    texts = {i: " ".join(r.choice(["né", "ba", "co", "𝄞x"]) + str(r.randint(0, 99)) for _ in range(r.choice([0, 1, 3, 200]))) for i in r.sample(range(10_000), 80)}
    df = spark.createDataFrame([(i, t or None, "x") for i, t in texts.items()], "doc_id long, text string, edited string").repartition(6)
    got = S.edited_fingerprints(df).select("doc_id", "n_chars", "edited", S.likeness("sketch", "edited_sketch").alias("e"), S.likeness("sketch", "next_sketch").alias("n"), S.as_text("sketch").alias("s")).collect()
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    assert len(got) == len(texts)
    for x in got:
        t, n = texts[x.doc_id], texts[after[x.doc_id]]
        k = len(t) // 3
        assert x.n_chars == len(t)
        assert x.edited == t[: len(t) - k] + n[:k]
        assert 0 <= x.n <= 1 and 0 <= x.e <= 1
        if len(t.split()) > 100:
            a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split(), x.edited.split()))
            assert abs(x.e - len(a & b) / len(a | b)) < 0.35
        assert len(x.s) % 16 == 0 and len(x.s) >= 16


def test_sketch_is_native_and_mergeable(spark):
    words = [f"w{i}" for i in range(4000)]
    a, b = " ".join(words[:3000]), " ".join(words[2000:])
    df = spark.createDataFrame([(a, b, a + " " + b, a[: len(a) // 20])], "a string, b string, c string, d string")
    for c in "abcd":
        df = S.with_sketch(df, c, f"s{c}")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    r = df.select(S.likeness("sa", "sb").alias("j"), S.containment("sd", "sa").alias("in"), S.containment("sa", "sd").alias("out"), F.size("sa.hashes").alias("n"), F.size(F.array_except(S.merged(F.array("sa", "sb"))["hashes"], F.col("sc.hashes"))).alias("rest"), F.col("sa.n").alias("all")).first()
    assert abs(r.j - 1 / 4) < 0.06 and getattr(r, "in") > 0.9 and r.out < 0.1 and 650 < r.n < 850 and r.rest == 0 and r.all == 2996


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None), (3, "x"), (3, "x"), (3, "y"), (9, "")], "doc_id long, text string")
    got = S.edited_fingerprints(df).select("doc_id", "edited", S.likeness("sketch", "next_sketch").alias("n")).collect()
    assert len(got) == 6 and all(0 <= r.n <= 1 for r in got)
    one = S.edited_fingerprints(spark.createDataFrame([(1, "abc def")], df.schema)).first()
    assert one.edited == "abc d" + "ab"
    assert S.edited_fingerprints(spark.createDataFrame([], df.schema)).count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256).alias("h")).first().h


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_merged_sketch_is_the_sketch_of_the_union(spark):
    """Short and long texts: merging keeps exactly the hashes that the union of the sets keeps, for any parts."""
    r = random.Random(1)
    texts = [" ".join(f"w{r.randint(0, 40)}" for _ in range(n)) for n in (0, 1, 3, 5, 6, 8, 12, 40, 300) for _ in range(6)]
    df = S.with_sketch(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = {x.doc_id: x.sketch for x in df.collect()}
    kept, every = {}, {}
    for scale, into in ((4, kept), (1, every)):  # at scale 1 every hash is kept
        for x in S.with_sketch(df, scale=scale).collect():
            into[x.doc_id] = set(x.sketch.hashes)
    limit = S.LEAST + (1 << 64) // 4
    assert all(kept[i] == {h for h in every[i] if h < limit} and rows[i].n == len(every[i]) == len(shingles(texts[i])) for i in kept)
    parts = df.withColumn("g", F.col("doc_id") % 5).groupBy("g").agg(F.collect_list("sketch").alias("s")).select("g", S.merged("s").alias("m"))
    for x in parts.collect():
        union = set().union(*(every[i] for i in every if i % 5 == x.g))
        assert list(x.m.hashes) == sorted(h for h in union if h < limit)


def test_containment_error_by_length(spark):
    """A part of a long text: the estimate's error falls with the part's length, and is none where nothing can be told."""
    r = random.Random(2)
    long = [f"w{i}" for i in range(6000)]
    rows = []
    for n in (8, 30, 120, 500, 2000):
        for k in range(40):
            a = r.randrange(0, 4000)
            part = long[a : a + n // 2] + [f"x{k}.{n}.{j}" for j in range(n - n // 2)]
            rows.append((n, " ".join(part), " ".join(long)))
    df = spark.createDataFrame(rows, "n int, a string, b string")
    df = S.with_sketch(S.with_sketch(df, "a", "sa"), "b", "sb").select("n", "a", "b", S.containment("sa", "sb").alias("c"))
    error = {}
    for x in df.collect():
        a, b = shingles(x.a), shingles(x.b)
        if x.c is not None:
            error.setdefault(x.n, []).append(abs(x.c - len(a & b) / len(a)))
    mean = {n: sum(e) / len(e) for n, e in error.items()}
    assert len(error[30]) >= 38 and mean[30] < 0.25 and mean[120] < 0.1 and mean[500] < 0.05 and mean[2000] < 0.03
    short = S.with_sketch(S.with_sketch(spark.createDataFrame([("one two three", "one two three four five six seven eight"), ("a b", "a b"), ("", "x"), ("p q", "r s")], "a string, b string"), "a", "sa"), "b", "sb")
    got = [tuple(x) for x in short.select(S.containment("sa", "sb"), S.likeness("sa", "sb")).collect()]
    assert got[0][0] in (None, 0.0) and got[1] == (1.0, 1.0) and got[2] == (1.0, 0.0) and got[3][1] == 0.0


def test_clashing_names_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    df = spark.createDataFrame([(2, long, 1, "x", None), (1, "a b", 2, "y", "z")], "doc_id long, text string, _order int, _h string, _to string")
    got = S.with_next(S.with_sketch(df), ("text",)).collect()
    assert {(x.doc_id, x._order, x._h, x._to) for x in got} == {(2, 1, "x", None), (1, 2, "y", "z")}
    assert {x.doc_id: x.next_text for x in got} == {2: "a b", 1: long}
