"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary entries that end at each position; dynamic
programming carries the best score and its number of pieces, nothing else. Texts are split as the
tokenizer splits them (a word begins at each space), so each distinct word is decoded once per task.

Ties follow the tokenizer: positions are relaxed from left to right and a path replaces another
only if its score is greater, so of equal paths into a position the one with the longest last
piece stays; the unknown piece, for a character that is no piece itself, comes last.
"""

from __future__ import annotations

from collections import Counter

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: An unknown character scores this much less than the least piece.
UNKNOWN_PENALTY = 10.0
#: Decoded words that one task remembers, and the longest that it does.
CACHE, LONGEST = 400_000, 64


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """(piece, score) in the order of ids, and the id of the unknown piece, of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())], model.unk_id()


class Counting:
    """Counts the pieces of texts. byte_fallback: an unknown character is one piece for each of its
    bytes; else a run of unknown characters is one piece."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        names = {p for p, _ in vocabulary}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        self.find = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.find.add_word(piece, (len(piece), score))
        if len(self.find):
            self.find.make_automaton()
        self.known: dict[str, int] = {}

    def decode(self, word: str) -> int:
        """The number of pieces on the best path through a word."""
        n = len(word)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at, best, pieces, single = 0, None, 0, False

        def close(end: int) -> None:
            # the piece entries that end here have been seen; the unknown piece is the last candidate
            nonlocal best, pieces
            is_unknown = False
            if not single:
                candidate = score[end - 1] + self.unknown
                if best is None or candidate > best:
                    best, is_unknown = candidate, True
                    pieces = count[end - 1] + (len(word[end - 1].encode()) if self.bytes else not unknown[end - 1])
            score[end], count[end], unknown[end] = best, pieces, is_unknown

        for last, (length, value) in self.find.iter(word) if len(self.find) else ():
            end = last + 1
            while at + 1 < end:
                at += 1
                close(at)
                best, single = None, False
            candidate = score[end - length] + value
            if best is None or candidate > best:
                best, pieces = candidate, count[end - length] + 1
            single = single or length == 1
        while at < n:
            at += 1
            close(at)
            best, single = None, False
        return int(count[n])

    def count(self, text: str | None) -> int:
        """Pieces of a text: spaces become word starts, and a text begins with one. Null and '' have none."""
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        words = text[1:].split(SPACE) if text[0] == SPACE else text.split(SPACE)
        total, known = 0, self.known
        for word, times in Counter(words).items():
            n = known.get(word)
            if n is None:
                n = self.decode(SPACE + word)
                if len(word) <= LONGEST:
                    if len(known) >= CACHE:
                        known.clear()
                    known[word] = n
            total += n * times
        return total


def with_token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]], byte_fallback: bool = True, text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """docs with the number of unigram pieces of each whole text in a column `name` (long), which replaces
    one of that name. Null and empty texts have 0. The vocabulary, whose size is fixed, goes to every task."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    ready: list[Counting] = []

    def run(texts: pd.Series) -> pd.Series:
        if not ready:
            ready.append(Counting(shared.value, byte_fallback))
        return pd.Series([ready[0].count(t) for t in texts], dtype="int64")

    return docs.withColumn(name, F.pandas_udf(run, "long")(F.col(text_col).cast("string")))
