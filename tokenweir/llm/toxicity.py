"""Toxicity by a weighted finite-state pattern grammar over clauses.

A clause is the words between two marks of punctuation. Five transducers read it, each in its own few states: INSULT (a word
of learned weight was met), THREAT (an intent, a verb of harm, or both), TARGET (somebody is spoken to, or of), NEGATION
and REPORTED (a verb of saying, or inside quotation marks). ``compose`` builds their product, one automaton whose state is
theirs together, over the symbols of the words; arcs of insults carry the word's weight, and weights add up along a path.
What a clause scores is decided at its end: the path's weight, and THREATENED for a threat, times the factor of its last
state, so that a target counts on either side of a match. A denied clause scores less than a plain one, a reported one
too, an aimed one more. The score of a document comes from its clauses that score alone (the sum of their scores, the
strongest, how many they are, their score for a hundred words, the share of the words that they hold, the best of the threats,
how many different insults their paths have), through a logistic link.

Verbs of harm and the closed word classes are fixed lists by language; a text is read with the list of the language whose
closed classes it has most words of (a tie goes to the first), so that a German article is no English verb. Insults are learned
from labelled rows alone (crc32 of the doc_id as text, modulo 5, not 0), of which TRAIN_ROWS at most are taken by a hash of
their id: stem weights are log odds of document frequencies in one half of them, and the link is fitted on the other half, so
that a stem that marks a few copied documents weighs little.

Defined cases: a null or empty text has no clause and gets the score of a text without a match; a null doc_id is not held
out (its remainder is null) and not learned from; repeated rows are scored each, and one label counts for all rows of its
doc_id; contradictory labels of one doc_id count as toxic; a text is read whole whatever its length, a batch of texts at most
CHUNK_BYTES long or one text at a time; with no usable label every score is PRIOR; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_views

#: Labelled rows that are learned from at most: a documented bound on a sample.
TRAIN_ROWS = 12_000
LEAST_DOCS = 8
LEAST_WEIGHT = 1.2
PRIOR = 0.1
STEM = (4, 8)

# Closed word classes of the corpus languages.
LANGUAGES = ("en", "de", "fr", "es")
TARGETS = {
    "en": "you your yours you're yourself he she they them him her his their this that these those",
    "de": "du dich dir dein deine sie ihr euch ihn er ihm ihnen",
    "fr": "tu te toi ton ta vous votre vos il elle ils elles lui leur",
    "es": "tú ti te usted ustedes su él ella ellos ellas os vosotros",
}
NEGATIONS = {
    "en": "not no never none nobody isn't aren't wasn't don't doesn't didn't won't can't cannot",
    "de": "nicht kein keine keinen nie niemals",
    "fr": "pas jamais aucun aucune",
    "es": "no nunca jamás ningún ninguna tampoco",
}
REPORTS = {
    "en": "said says say quoted quote wrote claimed called reported according alleged",
    "de": "sagte sagt schrieb behauptete zitierte laut",
    "fr": "dit disait écrit selon affirme",
    "es": "dijo dice escribió según afirma citó",
}
INTENTS = {
    "en": "will shall gonna going must should deserve deserves i'll we'll",
    "de": "werde werden wird wirst sollst soll musst muss verdienst",
    "fr": "vais vas va allons doit dois devrais mérites",
    "es": "voy vas va vamos debes debe deberías mereces",
}
HARMS = {
    "en": "kill hurt destroy beat burn shoot die murder attack strangle stab",
    "de": "töten töte umbringen schlagen vernichten verbrennen sterben erschießen",
    "fr": "tuer détruire frapper brûler mourir massacrer",
    "es": "matar destruir golpear quemar morir disparar",
}
ARTICLES = {
    "en": "the a an and of to in is it on for with as at by from",
    "de": "der die das den dem des ein eine und ist zu mit auf für von im",
    "fr": "le la les un une des et est dans pour sur avec du au",
    "es": "el la los las un una y es en para con del al por",
}

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:,\n\"“”«»]")
_END = frozenset(".!?;:,\n")
_QUOTE = frozenset("\"“”«»")

OTHER, INSULT, HARM, INTENT, TARGET, NEGATION, REPORT, QUOTE, END = range(9)


class Transducer:
    """States from 0 on, its start; ``arcs``: (state, symbol) to state. Without an arc a symbol leaves the state, and END starts anew."""

    def __init__(self, states: int, arcs: dict[tuple[int, int], int]) -> None:
        self.states, self.arcs = states, arcs

    def step(self, state: int, symbol: int) -> int:
        return self.arcs.get((state, symbol), 0 if symbol == END else state)


INSULTED = Transducer(2, {(0, INSULT): 1})
#: 1: an intent, 2: a verb of harm, 3: both.
THREATENING = Transducer(4, {(0, INTENT): 1, (0, HARM): 2, (1, HARM): 3, (2, INTENT): 3})
AIMED = Transducer(2, {(0, TARGET): 1})
DENIED = Transducer(2, {(0, NEGATION): 1})
#: 1: a verb of saying, or a match in quotation marks before; 2: inside quotation marks, which the end of a clause does not
#: close; 3: the same, after a match.
REPORTED = Transducer(4, {(0, REPORT): 1, (0, QUOTE): 2, (1, QUOTE): 2, (2, QUOTE): 0, (2, INSULT): 3, (2, HARM): 3, (3, QUOTE): 1, (2, END): 2, (3, END): 2})


def compose(*parts: Transducer) -> tuple[list[list[int]], list[tuple[int, ...]]]:
    """The product automaton: for each state its next by symbol, and the parts' states that it stands for. State 0 is its start."""
    states = list(product(*(range(p.states) for p in parts)))
    number = {s: k for k, s in enumerate(states)}
    return [[number[tuple(p.step(x, symbol) for p, x in zip(parts, s, strict=True))] for symbol in range(END + 1)] for s in states], states


# Weights of the grammar.
THREATENED = {2: 2.0, 3: 4.0}
AIMED_FACTOR, DENIED_FACTOR, REPORTED_FACTOR = 1.5, 0.4, 0.6

NEXT, STATES = compose(INSULTED, THREATENING, AIMED, DENIED, REPORTED)


def _factor(state: tuple[int, ...]) -> float:
    _, _, aimed, denied, reported = state
    return (AIMED_FACTOR if aimed else 1.0) * (DENIED_FACTOR if denied else 1.0) * (REPORTED_FACTOR if reported else 1.0)


#: By last state of a clause: the factor of its path's weight, and what a threat adds, which needs a target.
FACTORS = [_factor(s) for s in STATES]
THREATS = [THREATENED.get(s[1], 0.0) * _factor(s) if s[2] else 0.0 for s in STATES]
#: Whether a clause that ends in the state can score.
MATCHED = [bool(s[0] or THREATENED.get(s[1]) and s[2]) for s in STATES]
N_FEATURES = 7


def stems(word: str) -> list[str]:
    """The word itself, and its fronts of STEM letters marked as open."""
    return [word, *(word[:k] + "*" for k in range(STEM[0], min(STEM[1], len(word)) + 1))]


def _symbols(language: str) -> dict[str, int]:
    """Of one language's closed classes; a word of two classes has the first of END, QUOTE, NEGATION, REPORT, HARM, INTENT, TARGET."""
    out: dict[str, int] = {}
    for symbol, words in ((TARGET, TARGETS), (INTENT, INTENTS), (HARM, HARMS), (REPORT, REPORTS), (NEGATION, NEGATIONS)):
        out |= dict.fromkeys(words[language].split(), symbol)
    return out | dict.fromkeys(_QUOTE, QUOTE) | dict.fromkeys(_END, END)


_CLASSES = [_symbols(k) for k in LANGUAGES]
_CLOSED = [frozenset(f"{TARGETS[k]} {NEGATIONS[k]} {ARTICLES[k]}".split()) for k in LANGUAGES]
_HARMS = frozenset(" ".join(HARMS.values()).split())


class Grammar:
    """The composed automaton with the insults' ``weights`` by stem."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.words: dict[str, float] = {}

    def weight(self, word: str) -> float:
        w = self.words.get(word)
        if w is None:
            w = max((self.weights.get(s, 0.0) for s in stems(word)), default=0.0)
            if len(self.words) > 400_000:
                self.words.clear()
            self.words[word] = w
        return w

    def clauses(self, tokens: list[str]) -> Iterator[tuple[float, float, int, list[str]]]:
        """(score, what of it is a threat, words, insults) of each clause that scores."""
        held = Counter(tokens)
        known = [sum(n for w, n in held.items() if w in c) for c in _CLOSED]
        symbol, weight = _CLASSES[known.index(max(known))], self.weight
        state, path, words, met = 0, 0.0, 0, []
        for t in tokens:
            s = symbol.get(t)
            if s is None:
                words += 1
                w = weight(t)
                if w:
                    path, state = path + w, NEXT[state][INSULT]
                    met.append(t)
                continue
            if s == END:
                if MATCHED[state]:
                    yield path * FACTORS[state] + THREATS[state], THREATS[state], words, met
                path, words, met = 0.0, 0, []
            elif s != QUOTE:
                words += 1
            state = NEXT[state][s]

    def features(self, text: str) -> list[float]:
        tokens = _TOKEN.findall(text.lower())
        if not any(map(self.weight, tokens)) and _HARMS.isdisjoint(tokens):
            return [0.0] * N_FEATURES
        found = list(self.clauses([*tokens, "."]))
        if not found:
            return [0.0] * N_FEATURES
        scores = [x[0] for x in found]
        words = sum(t not in _END and t not in _QUOTE for t in tokens)
        kinds = len({t for x in found for t in x[3]})
        return [float(np.log1p(x)) for x in (sum(scores), max(scores), len(scores), 100 * sum(scores) / max(1, words), 100 * sum(x[2] for x in found) / max(1, words), max(x[1] for x in found), kinds)]


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows with their texts, of a bounded size or one row long."""
    for batch in batches:
        for first, end, _, _ in text_views(batch.column("text")):
            own = batch.slice(first, end - first)
            yield own, [t or "" for t in own.column("text").to_pylist()]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a task that hold each stem, by label."""
    found: tuple[Counter, Counter] = (Counter(), Counter())
    for own, texts in _tokens(batches):
        for text, toxic in zip(texts, own.column("toxic").to_pylist(), strict=True):
            words = set(_TOKEN.findall(text.lower()))
            found[bool(toxic)].update({s for w in words if w not in _END and w not in _QUOTE for s in stems(w)})
    keys = list(found[0] | found[1])
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([found[0][k] for k in keys], pa.int64()), pa.array([found[1][k] for k in keys], pa.int64())], ["stem", "clean", "toxic"])


def _featured(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(weights)
        for own, texts in _tokens(batches):
            yield pa.RecordBatch.from_arrays([own.column("toxic"), pa.array(list(map(grammar.features, texts)), pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def fit_link(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic link, the last one its constant, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[dict[str, float], np.ndarray]:
    """Stem weights and the link, from at most ``rows`` labelled documents, which bound what the driver gathers: the stems that
    LEAST_DOCS of them share, and a row of features for each."""
    mine = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    taken = F.broadcast(mine.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    train = docs.select("doc_id", "text").join(taken, "doc_id")
    half = F.xxhash64("doc_id", F.lit(3)) % 2 == 0
    counted = train.where(half).select("text", "toxic").mapInArrow(_frequencies, "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in taken.where(half).groupBy("toxic").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    weights: dict[str, float] = {}
    if n0 and n1:
        odds = F.log((F.col("toxic") + 0.2) / F.lit(n1 + 0.4)) - F.log((F.col("clean") + 0.2) / F.lit(n0 + 0.4))
        best = counted.where(F.col("toxic") >= min(LEAST_DOCS, max(2, n1 // 20))).withColumn("w", odds).where(F.col("w") > LEAST_WEIGHT)
        weights = {r["stem"]: r["w"] for r in best.select("stem", "w").collect()}
    held = train.where(~half).select("text", "toxic").mapInArrow(_featured(weights), "toxic int, x array<double>").collect()
    y = np.array([r["toxic"] for r in held], float)
    if len(set(y)) < 2:
        p = (n1 + 2 * PRIOR) / (n0 + n1 + 2)
        return weights, np.array([0.0] * N_FEATURES + [float(np.log(p / (1 - p)))])
    return weights, fit_link(np.array([r["x"] for r in held]), y)


def score(docs: DataFrame, weights: dict[str, float], link: np.ndarray) -> DataFrame:
    """doc_id and score of each whole text, from the text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(weights)
        for own, texts in _tokens(batches):
            x = np.array([grammar.features(t) for t in texts]).reshape(len(texts), N_FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ link[:-1] + link[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op10_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    weights, link = learn(docs, labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score(docs, weights, link).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
