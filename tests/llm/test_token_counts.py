import random

import pytest

from causeway.llm.token_counts import Counting, read_vocabulary, with_token_counts

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


def reference(vocabulary, unknown, byte_fallback):
    t = tokenizers.Tokenizer(tokenizers.models.Unigram(vocabulary, unknown, byte_fallback))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


TEXTS = ["", " ", "a", "  a  b ", "Hello world", "naïve ▁x▁▁y", "梦ң𝄞𝄞 zz", "<s> <0x0A> <unk>", "line\nbreak\ttab", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ab" * 300]


def test_public_vocabulary():
    vocabulary, unknown = read_vocabulary(public.path("piece_bpe_32k.model"))
    mine, theirs = Counting(vocabulary), reference(vocabulary, unknown, True)
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice("abcdefghe tion  é\n.,;梦ң") for _ in range(r.randint(1, 200))) for _ in range(300)]
    for t in texts:
        assert mine.count(t) == len(theirs.encode(t, add_special_tokens=False).ids), repr(t)


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_ties_and_unknowns(byte_fallback):
    r = random.Random(2)
    for _ in range(40):
        pieces = {"<unk>", "▁", *("".join(r.choice("▁aabbc") for _ in range(r.randint(1, 4))) for _ in range(15))}
        vocabulary = [(p, float(r.choice([-1, -2, -2, -3, -4]))) for p in sorted(pieces)]
        vocabulary = [(p, s) for p, s in vocabulary if "▁" not in p[1:]]
        unknown = [p for p, _ in vocabulary].index("<unk>")
        mine, theirs = Counting(vocabulary, byte_fallback), reference(vocabulary, unknown, byte_fallback)
        for _ in range(60):
            t = "".join(r.choice("aabbcd é") for _ in range(r.randint(0, 30)))
            assert mine.count(t) == len(theirs.encode(t, add_special_tokens=False).ids), (vocabulary, t)


def test_operator(spark):
    vocabulary, _ = read_vocabulary(public.path("piece_bpe_32k.model"))
    mine = Counting(vocabulary)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in with_token_counts(df, vocabulary).collect()}
    assert got == {i: mine.count(t) for i, t in enumerate([*TEXTS, None])}
    assert with_token_counts(spark.createDataFrame([], df.schema), vocabulary).count() == 0
