"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features, each step adding a shallow tree over the bins of one
feature to that feature's lookup table; pairs of features then get two-dimensional tables
the same way, fitted to what the single tables leave. A text's score is the sum of one
entry per table, looked up for whole batches at once.

The model learns from at most ``MAX_TRAINING_ROWS`` labelled rows outside the held-out
fold; only their features reach the driver. Labels, lang, source and doc_id are no inputs.

Defined cases: a null or empty text has zero features and is scored like any other; with no
labelled rows every score is 0.5; ids may be null (never held out, never trained on) or
repeated (each row is scored on its own, and learned from once); an empty table gives an empty
result; other columns, whatever their names, are never looked at; a very long text is read whole;
of equal values all fall into one bin, and of equally good splits the first is taken.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearspan.llm.common import MAX_TRAINING_ROWS, held_out, map_rows, training_ids

CUT = 0.7
FEATURES = ("chars", "words", "word_length", "symbols", "shouts", "upper", "digits", "dup_lines", "distinct", "stutter", "trigrams", "spaces", "stops", "longest", "top_word")
_SYMBOL, _SHOUT, _UPPER, _DIGIT, _STOP = (re.compile(p) for p in ("[#*$%&|<>]", "!", "[A-Z]", "[0-9]", "[.,;:?]"))


def features(text: str | None) -> list[float]:
    """Shape and repetition of a text; shares are of its characters, words or lines."""
    text = text or ""
    words = text.split()
    chars, n = len(text), len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lines = [x for x in text.split("\n") if x.strip()]
    count = Counter(words)
    solid = sum(map(len, words))
    return [
        math.log1p(chars),
        math.log1p(n),
        solid / n,
        len(_SYMBOL.findall(text)) / chars,
        len(_SHOUT.findall(text)) / chars,
        len(_UPPER.findall(text)) / chars,
        len(_DIGIT.findall(text)) / chars,
        1 - len(set(lines)) / len(lines),
        len(count) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, n - 2),
        (chars - solid) / chars,
        len(_STOP.findall(text)) / n,
        math.log1p(max(map(len, words))),
        max(count.values()) / n,
    ]


class AdditiveModel:
    """Lookup tables over quantile bins, one per feature and one per chosen pair."""

    def __init__(self, rounds: int = 60, pair_rounds: int = 30, bins: int = 24, pairs: int = 5, rate: float = 0.2, l2: float = 1.0):
        self.rounds, self.pair_rounds, self.bins, self.pairs, self.rate, self.l2 = rounds, pair_rounds, bins, pairs, rate, l2
        self.base, self.edges, self.single, self.double = 0.0, [], [], {}

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)

    def _tree(self, g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
        """Values by bin of a tree of the given depth over one feature's gradient sums."""
        if depth and len(g) > 1:
            gl, hl = g.cumsum()[:-1], h.cumsum()[:-1]
            gain = gl**2 / (hl + self.l2) + (g.sum() - gl) ** 2 / (h.sum() - hl + self.l2)
            cut = int(gain.argmax()) + 1
            if gain[cut - 1] > g.sum() ** 2 / (h.sum() + self.l2) + 1e-9:
                return np.concatenate([self._tree(g[:cut], h[:cut], depth - 1), self._tree(g[cut:], h[cut:], depth - 1)])
        return np.full(len(g), g.sum() / (h.sum() + self.l2))

    def _quadrants(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """Best cut of both axes of a pair: gain and the values of its cells."""
        gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
        if min(g.shape) < 2:
            return 0.0, np.zeros_like(g)
        a, b = gc[:-1, :-1], hc[:-1, :-1]
        right, below, all_ = gc[:-1, -1:], gc[-1:, :-1], gc[-1, -1]
        hright, hbelow, hall = hc[:-1, -1:], hc[-1:, :-1], hc[-1, -1]
        parts = [(a, b), (right - a, hright - b), (below - a, hbelow - b), (all_ - right - below + a, hall - hright - hbelow + b)]
        gain = sum(x**2 / (y + self.l2) for x, y in parts)
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        values = np.zeros_like(g)
        for (x, y), cells in zip(parts, (np.s_[: i + 1, : j + 1], np.s_[: i + 1, j + 1 :], np.s_[i + 1 :, : j + 1], np.s_[i + 1 :, j + 1 :]), strict=True):
            values[cells] = x[i, j] / (y[i, j] + self.l2)
        return float(gain[i, j] - all_**2 / (hall + self.l2)), values

    def fit(self, x: np.ndarray, y: np.ndarray) -> "AdditiveModel":
        d = x.shape[1]
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(d)]
        c = self.codes(x)
        width = [len(e) + 1 for e in self.edges]
        self.single = [np.zeros(w) for w in width]
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(x), self.base)
        slope = lambda: (y - (q := 1 / (1 + np.exp(-score))), q * (1 - q))
        for _ in range(self.rounds):
            for f in range(d):
                g, h = slope()
                step = self.rate * self._tree(np.bincount(c[:, f], g, width[f]), np.bincount(c[:, f], h, width[f]), 2)
                self.single[f] += step
                score += step[c[:, f]]
        cell = lambda f, k: c[:, f] * width[k] + c[:, k]
        sums = lambda f, k, v: np.bincount(cell(f, k), v, width[f] * width[k]).reshape(width[f], width[k])
        g, h = slope()
        order = sorted(((-self._quadrants(sums(f, k, g), sums(f, k, h))[0], f, k) for f in range(d) for k in range(f)))
        self.double = {(f, k): np.zeros((width[f], width[k])) for _, f, k in order[: self.pairs]}
        for _ in range(self.pair_rounds):
            for (f, k), values in self.double.items():
                g, h = slope()
                step = self.rate * self._quadrants(sums(f, k, g), sums(f, k, h))[1]
                values += step
                score += step[c[:, f], c[:, k]]
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        c, score = self.codes(x), np.full(len(x), self.base)
        for f, values in enumerate(self.single):
            score += values[c[:, f]]
        for (f, k), values in self.double.items():
            score += values[c[:, f], c[:, k]]
        return 1 / (1 + np.exp(-score))


_FEATURES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
_SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", bound: int = MAX_TRAINING_ROWS) -> AdditiveModel | None:
    """The model, from at most ``bound`` labelled documents; None if there are none."""
    ids = F.broadcast(training_ids(labels, label, bound))  # the bound proves its size
    chosen = docs.select("doc_id", text).join(ids, "doc_id")
    x = map_rows(chosen, ["doc_id", text], _FEATURES, lambda rows: {"doc_id": rows["doc_id"], "x": [features(t) for t in rows[text]]})
    # Of rows that repeat an id one is learned from, so that the bound holds for them too.
    rows = x.groupBy("doc_id").agg(F.min("x").alias("x")).join(ids, "doc_id").orderBy("doc_id").select("label", "x").collect()
    if not rows:
        return None
    return AdditiveModel().fit(np.array([r["x"] for r in rows]), np.array([float(r["label"]) for r in rows]))


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, text))

    def run(rows: dict) -> dict:
        m = model.value
        x = np.array([features(t) for t in rows[text]]).reshape(-1, len(FEATURES))
        return {"doc_id": rows["doc_id"], "score": (m.probability(x) if m else np.full(len(x), 0.5)).tolist()}

    scored = map_rows(docs, ["doc_id", text], _SCORED, run)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
