"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are classes (insult, threat, target, negation, reported speech, other). Transducers
run over a clause's classes and are composed, each reading what the one before it writes:
negation marks what it governs, reported speech marks what is quoted, targets near an
insult and threats aimed at a target add weight. A clause's score is the weight of its path
times what its words weigh; scattered words never meet in a clause. A text is described by
its clauses' scores, and a booster calibrates these to a probability.

Weights of insult words and of stems (the first ``STEMS`` letters of words, so that compounds
and endings share evidence) are learned: the lower bound of the share of toxic texts among
those labelled texts that hold one, where it is over a half. Learning reads at most
``MAX_TRAINING_ROWS`` labelled rows outside the held-out fold, and such a bound takes five
toxic texts at least, so the list is bounded by a fifth of their words. Labels, lang, source
and doc_id are no inputs of a score.

Defined cases: a null or empty text has no clauses and scores like any text without a
match; with no labelled rows, the fixed words alone give scores; an empty table gives an
empty result; ids may be null or repeated (each row is scored on its own), and a repeated id
is learned from once; other columns, whatever their names, are never looked at; words are
compared in lower case. A very long text is scored whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearspan.llm.common import MAX_TRAINING_ROWS, Booster, held_out, map_rows, training_ids

CUT = 0.3
#: Lengths of stems, and what marks one in the list of learned words.
STEMS, MARK = (4, 5, 6, 7), "*"

# Words of each class.
INSULTS = ("idiot", "moron", "stupid", "worthless", "pathetic", "disgusting", "clown", "trash", "scum", "loser", "imbecile", "vermin", "filth", "dumb", "idiote", "dummkopf", "abschaum", "imbécile", "basura", "estúpido")
THREATS = ("kill", "hurt", "destroy", "beat", "stab", "shoot", "strangle", "burn", "töten", "tuer", "matar")
TARGETS = ("you", "your", "yours", "yourself", "he", "she", "they", "them", "him", "her", "du", "dich", "dir", "ihr", "tu", "toi", "vous", "tú", "ustedes", "people")
NEGATIONS = ("not", "never", "no", "isn't", "aren't", "wasn't", "don't", "without", "nicht", "kein", "keine", "pas", "jamais", "nunca")
REPORTS = ("said", "says", "wrote", "called", "claimed", "quoted", "alleged", "reported", "according", "sagte", "schrieb", "dit", "écrit", "dijo")

_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")

#: A transducer is (start, step): step(state, symbol) -> (state, symbol out, weight added).
Machine = tuple[object, Callable[[object, str], tuple[object, str, float]]]


def negation(reach: int = 3) -> Machine:
    """I and H become i and h for ``reach`` words after a negation."""

    def step(left: int, s: str):
        if s == "N":
            return reach, s, 0.0
        out = s.lower() if left and s in "IH" else s
        return max(0, left - 1), out, 0.0

    return 0, step


def reported() -> Machine:
    """After a word of reporting, the rest of the clause is quoted: I becomes q, H becomes o."""

    def step(quoted: bool, s: str):
        if s == "R":
            return True, s, 0.0
        return quoted, {"I": "q", "H": "o"}.get(s, s) if quoted else s, 0.0

    return False, step


def insults(reach: int = 4) -> Machine:
    """Weights of insults by their marks, and more for a target within reach on either side."""
    weights = {"I": 1.0, "q": 0.35, "i": 0.2}

    def step(state: tuple[int, int], s: str):
        target, insult = state
        gain = weights.get(s, 0.0)
        if s == "I" and target:
            gain += 0.5
        if s == "T" and insult:
            gain += 0.5
        return (reach if s == "T" else max(0, target - 1), reach if s == "I" else max(0, insult - 1)), s, gain

    return (0, 0), step


def threats(reach: int = 3) -> Machine:
    """A threat counts when a target follows within reach."""

    def step(left: int, s: str):
        if s == "T" and left:
            return 0, s, 1.0
        return (reach if s == "H" else max(0, left - 1)), s, 0.0

    return 0, step


def compose(*machines: Machine) -> Machine:
    """One machine: each reads what the one before wrote, weights add up. Steps are remembered."""
    steps = [m[1] for m in machines]
    seen: dict = {}

    def step(state: tuple, s: str):
        key = (state, s)
        if key not in seen:
            out, total, symbol = [], 0.0, s
            for one, f in zip(state, steps, strict=True):
                one, symbol, w = f(one, symbol)
                out.append(one)
                total += w
            seen[key] = (tuple(out), symbol, total)
        return seen[key]

    return tuple(m[0] for m in machines), step


class Grammar:
    """The composed machine with the classes and weights of words and stems."""

    #: Words remembered with their class and weight; beyond that the memory starts anew.
    REMEMBERED = 200_000

    def __init__(self, weights: dict[str, float]):
        self.weights = {w: 0.6 for w in INSULTS} | {w: x for w, x in weights.items() if not w.endswith(MARK)}
        self.stems = {w[:-1]: x for w, x in weights.items() if w.endswith(MARK)}
        # Words of the fixed classes stay what they are, whatever was learned.
        self.classes = {w: "I" for w in self.weights} | {w: c for words, c in ((REPORTS, "R"), (NEGATIONS, "N"), (TARGETS, "T"), (THREATS, "H")) for w in words}
        self.start, self.step = compose(negation(), reported(), insults(), threats())
        self.seen: dict[str, tuple[str, float]] = {}

    def look(self, word: str) -> tuple[str, float]:
        """Class and weight of a word; a word of no class is an insult if one of its stems is."""
        got = self.seen.get(word)
        if got is None:
            c = self.classes.get(word)
            weight = self.weights.get(word, 0.0) if c == "I" else 0.0
            if c is None:
                weight = max((self.stems.get(word[:k], 0.0) for k in STEMS if k <= len(word)), default=0.0)
                c = "I" if weight else "o"
            if len(self.seen) >= self.REMEMBERED:
                self.seen.clear()
            got = self.seen[word] = c, weight
        return got

    def clause(self, words: list[str]) -> float:
        """Score of one clause: its path's weight times the largest weight of its insults."""
        state, total, heavy = self.start, 0.0, 0.0
        for w in words:
            s, weight = self.look(w)
            state, _, gain = self.step(state, s)
            total += gain
            heavy = max(heavy, weight)
        return total * (heavy or 0.6)

    def features(self, text: str | None) -> list[float]:
        """Largest and summed clause scores, matched clauses and their share, logged length."""
        low = (text or "").lower()
        words, look = _WORD.findall(low), self.look
        if all(look(w)[0] not in "IH" for w in set(words)):
            return [0.0, 0.0, 0.0, 0.0, 0.0]
        clauses = (_WORD.findall(c) for c in _CLAUSE.split(low))
        scores = [s for own in clauses if any(look(w)[0] in "IH" for w in own) and (s := self.clause(own)) > 0]
        return [max(scores, default=0.0), sum(scores), float(len(scores)), 100 * sum(scores) / len(words), math.log1p(len(words))]


def learn_words(docs: DataFrame, labels: DataFrame, text: str, bound: int = MAX_TRAINING_ROWS) -> dict[str, float]:
    """Weights of words and stems: Wilson's lower bound of the share of toxic texts among those with one."""
    ids = F.broadcast(training_ids(labels, "toxic", bound))
    words = rf"array_distinct(regexp_extract_all(lower(coalesce(`{text}`, '')), '[\\p{{L}}]+(?:[\'’][\\p{{L}}]+)?', 0))"
    stems = f"array_distinct(flatten(transform(w, x -> transform(filter(array({', '.join(map(str, STEMS))}), k -> k <= length(x)), k -> concat(substring(x, 1, k), '{MARK}')))))"
    held = docs.select("doc_id", text).join(ids, "doc_id").select("label", F.expr(words).alias("w")).select("label", F.explode(F.expr(f"concat(w, {stems})")).alias("word"))
    z = 2.0
    counted = held.groupBy("word").agg(F.count("*").alias("n"), F.sum("label").alias("k"))
    low = F.expr(f"(k / n + {z * z / 2} / n - {z} * sqrt(k * (n - k) / n + {z * z / 4}) / n) / (1 + {z * z} / n)")
    rows = counted.select("word", low.alias("low")).where("low > 0.5").collect()
    return {r["word"]: round(float(r["low"]), 6) for r in sorted(rows, key=lambda r: r["word"])}


_FEATURES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
_SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", bound: int = MAX_TRAINING_ROWS) -> tuple[dict[str, float], Booster | None]:
    words = learn_words(docs, labels, text, bound)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(words)
    ids = F.broadcast(training_ids(labels, "toxic", bound))

    def run(rows: dict) -> dict:
        g = grammar(shared)
        return {"doc_id": rows["doc_id"], "x": [g.features(t) for t in rows[text]]}

    x = map_rows(docs.select("doc_id", text).join(ids, "doc_id"), ["doc_id", text], _FEATURES, run)
    rows = x.groupBy("doc_id").agg(F.max("x").alias("x")).join(ids, "doc_id").orderBy("doc_id").select("label", "x").collect()
    if not rows:
        return words, None
    return words, Booster(rounds=40, depth=3).fit(np.array([r["x"] for r in rows]), np.array([float(r["label"]) for r in rows]))


_GRAMMARS: dict[int, tuple[object, Grammar]] = {}


def grammar(shared) -> Grammar:
    """One grammar per worker process and word list."""
    words = shared.value
    if id(words) not in _GRAMMARS:
        _GRAMMARS.clear()
        _GRAMMARS[id(words)] = (words, Grammar(words))
    return _GRAMMARS[id(words)][1]


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""
    sc = docs.sparkSession.sparkContext
    words, booster = learn(docs, labels, text)
    shared, trees = sc.broadcast(words), sc.broadcast(booster)

    def run(rows: dict) -> dict:
        g, b = grammar(shared), trees.value
        x = np.array([g.features(t) for t in rows[text]]).reshape(-1, 5)
        p = b.probability(x) if b else 1 - np.exp(-x[:, 0])
        return {"doc_id": rows["doc_id"], "score": p.tolist()}

    scored = map_rows(docs, ["doc_id", text], _SCORED, run)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
