"""Toxicity by a weighted finite-state pattern grammar over clauses.

Small transducers over token classes say what insults, threats, targets, negation and reported speech
do to each other; they are composed into one deterministic machine. A lexicon, learned from labelled
texts, gives the insults and their weights. The machine reads the clauses that hold an insult or a
threat; a text's score is a calibrated function of its matched clauses, not of isolated words.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_right
from collections import Counter
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm import _labels as L

#: At most about this many labelled rows are fitted on.
SAMPLE = 12_000
WORD = re.compile(r"[^\W\d_]+")
#: What ends a clause. A colon doesn't: what it introduces is reported with it.
BREAK = re.compile(r"[.!?;\n…。！？]+")
STEMS = (4, 5, 6, 7)
#: Least share of toxic texts among those with a lexicon entry.
PRECISION = 0.3

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, HIT = range(7)

#: Closed word classes in four languages. Insults are learned.
WORDS = {
    TARGET: "you your yours yourself yall u they them their he him she her his these those du dich dir dein deine ihr euch euer sie ihn ihm tu te toi ton ta tes vous votre vos ils elles lui tú ti tuyo vosotros ustedes usted ellos ellas él ella",
    NEGATION: "not no never neither nor without isn aren wasn weren don doesn didn nobody nicht kein keine keinen niemals nie ohne ne pas jamais aucun aucune sans nunca jamás ningún ninguna sin tampoco",
    REPORT: "said says say saying called calls wrote writes quoted quotes told tells claimed claims alleged allegedly reported reportedly according sagte sagt nannte nennt schrieb schreibt behauptete laut disait dit écrit affirmé appelé selon dijo dice llamó escribió afirmó según",
    THREAT: "kill killing hurt destroy beat attack stab shoot burn crush murder smash töten umbringen schlagen zerstören tuer frapper détruire brûler matar golpear destruir quemar atacar",
}


class Transducer(NamedTuple):
    """arcs[state, class] = (next state, class passed on, weight); a missing arc stays and passes on."""

    start: object
    arcs: dict

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, 1.0))


def _timed(opens: int, steps: int, weights: dict[int, float], becomes: dict[int, int] | None = None) -> Transducer:
    """After a word of class `opens`, for `steps` tokens, words of the classes in weights are scaled and passed on as `becomes` says."""
    arcs = {}
    for left in range(steps + 1):
        for symbol in range(HIT + 1):
            after = steps if symbol == opens else max(left - 1, 0)
            out, weight = symbol, 1.0
            if left and symbol in weights:
                out, weight = (becomes or {}).get(symbol, symbol), weights[symbol]
            arcs[left, symbol] = (after, out, weight)
    return Transducer(0, arcs)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """What a passes on goes to b; weights multiply. Only states that can be reached are made."""
    start = (a.start, b.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in range(HIT + 1):
            p, middle, v = a.step(state[0], symbol)
            q, out, w = b.step(state[1], middle)
            arcs[state, symbol] = ((p, q), out, v * w)
            if (p, q) not in seen:
                seen.add((p, q))
                todo.append((p, q))
    return Transducer(start, arcs)


#: What follows reported speech in its clause weighs less, as do insults denied within three tokens; a denied
#: threat is none; an insult with a target near weighs more.
REPORTED = Transducer(0, {(0, REPORT): (1, REPORT, 1.0), (1, INSULT): (1, INSULT, 0.5), (1, TARGET): (1, TARGET, 0.5)})
DENIED = _timed(NEGATION, 3, {INSULT: 0.4, THREAT: 1.0}, {THREAT: OTHER})
AIMED = _timed(TARGET, 4, {INSULT: 1.5})
THREATENED = _timed(THREAT, 4, {TARGET: 1.0}, {TARGET: HIT})  # a threat needs a target after it
INSULTED = Transducer(0, {(0, INSULT): (0, HIT, 1.0)})


def grammar() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The composed machine as tables over (state, class): next state, whether a hit is passed on, weight."""
    whole = REPORTED
    for part in (DENIED, AIMED, THREATENED, INSULTED):
        whole = compose(whole, part)
    number = {s: i for i, s in enumerate(dict.fromkeys([whole.start, *(s for s, _ in whole.arcs)]))}
    step, hit, weight = (np.zeros((len(number), HIT + 1), t) for t in (np.int64, bool, float))
    for (s, symbol), (after, out, w) in whole.arcs.items():
        step[number[s], symbol], hit[number[s], symbol], weight[number[s], symbol] = number[after], out == HIT, w
    return step, hit, weight


def learn_lexicon(texts: list[str], y: np.ndarray) -> dict[str, float]:
    """Words and stems ("lemo*") that mark toxic texts, with their log odds. A term must be found so often in
    toxic texts that among all terms none is expected by chance; equal texts of one label count once."""
    counts, n, seen = (Counter(), Counter()), [0, 0], set()
    for text, label in zip(texts, y.tolist()):
        if (text, label) in seen:
            continue
        seen.add((text, label))
        n[label] += 1
        words = set(WORD.findall(text.lower()))
        counts[label].update(words)
        counts[label].update({w[:k] + "*" for w in words for k in STEMS if len(w) >= k})
    if not n[0] or not n[1]:
        return {}
    base, tests = n[1] / (n[0] + n[1]), math.log(len(counts[1]) + len(counts[0]) + 1)
    found = {}
    for term, t in counts[1].items():
        c = counts[0].get(term, 0)
        share = t / (t + c)
        if t < 3 or share < PRECISION or share <= base:
            continue
        gain = t * math.log(share / base) + (c * math.log((1 - share) / (1 - base)) if c else 0.0)
        if gain > tests + 1:
            found[term] = math.log((t + 0.5) / (n[1] - t + 0.5)) - math.log((c + 0.5) / (n[0] - c + 0.5))
    # a term adds nothing to a shorter stem of about its weight
    covered = lambda t: [found.get(t[:k] + "*", 0.0) for k in STEMS if k < len(t.rstrip("*")) or t[-1] != "*"]
    return {t: w for t, w in found.items() if w > max(covered(t), default=0.0) + 0.5}


class Grammar:
    """Scores clauses with a lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.step, self.hit, self.weight = (t.tolist() for t in grammar())
        self.classes = {w: c for c, words in WORDS.items() for w in words.split()}
        self.lexicon = {t: w for t, w in lexicon.items() if t not in self.classes}
        self.find = ahocorasick.Automaton()
        for term in [*self.lexicon, *(w for w, c in self.classes.items() if c == THREAT)]:
            self.find.add_word(term.rstrip("*"), len(term.rstrip("*")))
        if len(self.find):
            self.find.make_automaton()

    def insult(self, word: str) -> float:
        found = self.lexicon.get(word, 0.0)
        for k in STEMS:
            if len(word) >= k:
                found = max(found, self.lexicon.get(word[:k] + "*", 0.0))
        return found

    def clause(self, text: str) -> float:
        """The weight of the hits that the machine finds in one clause."""
        state, total = 0, 0.0
        for word in WORD.findall(text):
            symbol = self.classes.get(word)
            value = 2.0
            if symbol is None:
                value = self.insult(word)
                symbol = INSULT if value else OTHER
            if self.hit[state][symbol]:
                total += value * self.weight[state][symbol]
            state = self.step[state][symbol]
        return total

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Of the matched clauses: sum, greatest and number, on a log scale, and the mean over all clauses."""
        text = (text or "").lower()
        if not text or not len(self.find):
            return 0.0, 0.0, 0.0, 0.0
        places = [e - n + 1 for e, n in self.find.iter(text)]
        places = [p for p in places if p == 0 or not (text[p - 1].isalpha())]
        if not places:
            return 0.0, 0.0, 0.0, 0.0
        breaks = [m.end() for m in BREAK.finditer(text)]
        scores = {}
        for p in places:
            i = bisect_right(breaks, p)
            if i not in scores:
                a = breaks[i - 1] if i else 0
                scores[i] = self.clause(text[a : breaks[i] if i < len(breaks) else len(text)])
        matched = [s for s in scores.values() if s > 0]
        if not matched:
            return 0.0, 0.0, 0.0, 0.0
        return math.log1p(sum(matched)), math.log1p(max(matched)), math.log1p(len(matched)), sum(matched) / (len(breaks) + 1)


def fit(texts: list[bytes], y: np.ndarray) -> bytes:
    plain = [t.decode() for t in texts]
    if len(set(y.tolist())) < 2:
        return pickle.dumps(({}, [0.0, 0.0, 0.0, 0.0, float(np.clip(((y[0] if len(y) else 0.5) - 0.5) * 8, -4, 4))]))
    fold, x = L.folds(texts, 3), np.zeros((len(y), 4))
    for k in range(3):  # features of a fold come from the others' lexicon
        inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        g = Grammar(learn_lexicon([plain[i] for i in inside], y[inside]))
        for i in outside:
            x[i] = g.features(plain[i])
    return pickle.dumps((learn_lexicon(plain, y), L.logistic(x, y).tolist()))


def _score(model: bytes):
    loaded: list = []

    def run(texts: pd.Series) -> pd.Series:
        if not loaded:
            lexicon, weights = pickle.loads(model)
            loaded.append((Grammar(lexicon), np.array(weights)))
        g, w = loaded[0]
        x = np.array([g.features(t) for t in texts], float).reshape(-1, 4)
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -500, 500))))

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", sample: int = SAMPLE) -> bytes:
    """A lexicon and calibration for labels[label], from about `sample` labelled documents at most for whose
    doc_id `train` holds. Only texts are inputs. Without labels of both classes every text gets one score."""
    return L.fitted(L.labelled_sample(docs, labels, label, train, sample), fit)


def with_toxicity(docs: DataFrame, model: bytes, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the probability that a text is toxic in a column `name`, which replaces one of that name;
    from whole texts. Null and empty texts score as texts without a matched clause."""
    return docs.withColumn(name, F.pandas_udf(_score(model), "double")(F.col(text_col).cast("string")))
