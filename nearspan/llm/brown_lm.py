"""Language-model scoring with Brown classes: exchange clustering, class bigrams, emissions.

1. Every token of the training texts is counted, map-side first; the table of all words stays
   in the shared folder.
2. Words are of three kinds by their share of the training tokens, at every size of the corpus
   alike: *clustered* (at least 1 / 2**17 and five times), *listed* (at least 1 / 2**20) and the
   rest. A share of 1 / m belongs to m words at most, so that the listed words with their counts
   (a million at the very most) can be sent to all tasks. Words that are not clustered take a
   class by their form: letters, digits, signs, ending, length.
3. Neighbouring symbols (clustered words, forms, ends of texts) are counted over all training
   texts. Exchange: every clustered word may move to the class that raises the class bigrams'
   mutual information most, the others standing still. A round offers a move to half of the words;
   if the moves together lowered the objective, they are taken back and fewer words move.
   A round reads a word's neighbours from one row, so it shuffles next to nothing.
4. log10 P(text) = sum of log10 P(class | class before) + log10 P(word | class). Transitions are
   smoothed with the classes' own shares, emissions of form classes by one added to each count,
   with one more word for all that were never seen.
5. Scoring is one pass; only words that are not listed are joined with the table of all words, one
   row for each of a text's words, and what they add is summed by text.

No word, text or count is left out at any size. The end of a text is a token of its own.

Defined cases: a null text is empty (one token, the end); a null id belongs to the training
texts; repeated ids or rows are rows of their own; words are bytes, so nothing is lost in texts
of any length or script; an empty corpus, or one without training texts, gives N = 0 and V = 0
and still scores every row; an empty table gives an empty result; other columns, of any name, are
not read; ties of counts go by the word, ties of classes to the smaller number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from nearspan.llm.common import slices, stored
from nearspan.shipping import ship

#: One over the share of the training tokens from which a word is listed, or clustered.
LISTED, CLUSTERED = 1 << 20, 1 << 17
#: Occurrences a clustered word has at least.
LEAST = 5
#: Classes of the exchange, its rounds at most, and the pull of the classes' own shares on transitions.
CLASSES, ROUNDS, SMOOTHING = 64, 10, 10.0
#: Distinct words, and neighbours, that a task gathers before it hands their counts on.
WORDS_AT_ONCE, PAIRS_AT_ONCE = 400_000, 4_000_000

END = b""
_SIGNS = bytes(ord("a") if chr(b).isalpha() and b < 128 else ord("0") if 48 <= b < 58 else ord("e") if b > 127 else ord("-") for b in range(256))
#: Form classes: six kinds of word, three endings, two lengths.
FORMS = 36

_WORDS = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("form", T.IntegerType()), T.StructField("n", T.LongType())])
_PAIRS = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("n", T.LongType())])
_MOVES = T.StructType([T.StructField("word", T.IntegerType()), T.StructField("to", T.IntegerType())])
_RARE = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())]))
_SCORED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("rare", _RARE)]
)


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8: A-Z lower-cased, split at white space of ASCII (which bytes do), and the end."""
    return [*text.lower().split(), END] if text else [END]


def form(word: bytes) -> int:
    """The form class of a word: its kind, its ending, whether it is long."""
    signs = word.translate(_SIGNS)
    letters, digits = b"a" in signs or b"e" in signs, b"0" in signs
    kind = (1 if letters else 0) if digits else 2 if not letters else 3 if b"-" in signs.strip(b"-") else 4 if b"e" in signs else 5
    ending = 0 if not signs.endswith(b"-") else 1 if word[-1:] in b",;:" else 2
    return (kind * 3 + ending) * 2 + (len(word) > 8)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        for part in slices(batch):
            yield part, part.column(column).to_pylist()


def count_words(texts: DataFrame) -> DataFrame:
    """word, form, n of all tokens, ends included, of a column of texts in UTF-8."""
    arrow = to_arrow_schema(_WORDS)

    def rows(counts: Counter) -> pa.RecordBatch:
        words = list(counts)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([form(w) if w else -1 for w in words], pa.int32()), pa.array(list(counts.values()), pa.int64())], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for _, part in _texts(batches, 0):
            for text in part:
                counts.update(tokens(text))
                if len(counts) > WORDS_AT_ONCE:
                    yield rows(counts)
                    counts.clear()
        if counts:
            yield rows(counts)

    return texts.mapInArrow(run, _WORDS).groupBy("word", "form").agg(F.sum("n").alias("n"))


class Symbols:
    """Numbers of symbols: clustered words, then forms, then the end, then the other listed words.

    ``known`` are listed words as (word, form, count), in falling order of count.
    """

    def __init__(self, known: list[tuple[bytes, int, int]], total: int):
        known = sorted((x for x in known if x[0] != END), key=lambda x: (-x[2], x[0]))
        clustered = [x for x in known if x[2] >= LEAST and x[2] * CLUSTERED >= total]
        others = known[len(clustered) :]
        self.clustered, self.end = len(clustered), len(clustered) + FORMS
        self.words = [x[0] for x in clustered] + [x[0] for x in others]
        self.counts = np.array([x[2] for x in clustered] + [0] * (FORMS + 1) + [x[2] for x in others], np.int64)
        #: Every symbol as one that neighbours are counted for, a clustered word, a form or the end.
        self.plain = np.concatenate([np.arange(self.end + 1), np.array([self.clustered + x[1] for x in others], np.int64)]).astype(np.int64)
        self.clustered_forms = np.array([x[1] for x in clustered], np.int64)

    def reader(self) -> Callable[[list[bytes]], np.ndarray]:
        """A function from tokens to symbols. It remembers the forms of some words, which saves time only."""
        first = self.clustered

        class Numbers(dict):
            def __missing__(self, word: bytes) -> int:
                made = first + form(word)
                if len(self) < 2_000_000:
                    self[word] = made
                return made

        numbers = Numbers(zip(self.words[:first], range(first)))
        numbers.update(zip(self.words[first:], range(self.end + 1, self.end + 1 + len(self.words) - first)))
        numbers[END] = self.end
        get = numbers.__getitem__
        return lambda words: np.fromiter(map(get, words), np.int64, len(words))


def count_neighbours(texts: DataFrame, symbols) -> DataFrame:
    """a, b, n of all neighbouring symbols; an end stands before the first token of a text. ``symbols`` is a broadcast variable."""
    arrow = to_arrow_schema(_PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = symbols.value
        read, size, codes, held = s.reader(), s.end + 1, [], 0

        def rows() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((code // size).astype(np.int32)), pa.array((code % size).astype(np.int32)), pa.array(n.astype(np.int64))], schema=arrow)

        for _, part in _texts(batches, 0):
            stream = [END]
            for text in part:
                stream += tokens(text)
            at = s.plain[read(stream)]
            codes.append(at[:-1] * size + at[1:])
            held += len(at)
            if held > PAIRS_AT_ONCE:
                yield rows()
                codes, held = [], 0
        if codes:
            yield rows()

    return texts.mapInArrow(run, _PAIRS).groupBy("a", "b").agg(F.sum("n").alias("n"))


def neighbour_rows(pairs: DataFrame, clustered: int) -> DataFrame:
    """One row for each clustered word: its neighbours (those before it as -1 - number) and their counts.

    A word has at most twice as many neighbours as there are symbols.
    """
    sides = F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), (-1 - F.col("a")).alias("other"))))
    return pairs.select("n", sides).where(F.col("word") < clustered).groupBy("word").agg(F.collect_list("other").alias("others"), F.collect_list("n").alias("counts"))


def class_counts(pairs: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """How often class follows class: counts of the pairs' classes, at most k * k rows from each task."""
    schema = T.StructType([T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k * k, np.int64)
        for b in batches:
            codes = classes[b.column(0).to_numpy()] * k + classes[b.column(1).to_numpy()]
            out += np.bincount(codes, b.column(2).to_numpy(), k * k).astype(np.int64)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], schema=arrow)

    out = np.zeros(k * k, np.int64)
    for r in pairs.select("a", "b", "n").mapInArrow(run, schema).groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r["code"]] = r["n"]
    return out.reshape(k, k)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def objective(n: np.ndarray) -> float:
    """The part of the training texts' log likelihood that depends on the classes."""
    n = n.astype(float)
    return float(xlogx(n).sum() - xlogx(n.sum(1)).sum() - xlogx(n.sum(0)).sum())


def gains(n: np.ndarray, own: int, before: np.ndarray, after: np.ndarray, alone: float, among: int) -> np.ndarray:
    """What moving a word from class ``own`` to each of the first ``among`` classes adds to the objective.

    n: class counts; before, after: counts of the classes before and after the word, without
    ``alone``, how often it follows itself.
    """
    m = n.astype(float)
    m[own] -= after
    m[:, own] -= before
    m[own, own] -= alone
    # Whatever class the word takes, what stands before it keeps its sum, and what stands after it, too.
    rows, cols = m.sum(1) + before, m.sum(0) + after
    a, b = np.flatnonzero(after), np.flatnonzero(before)
    to_right, to_left = m[:among, a], m[b, :among]
    out = (xlogx(to_right + after[a]) - xlogx(to_right)).sum(1) + (xlogx(to_left + before[b][:, None]) - xlogx(to_left)).sum(0)
    d, x, y = np.diagonal(m)[:among], after[:among], before[:among]
    out += xlogx(d + x + y + alone) - xlogx(d + x) - xlogx(d + y) + xlogx(d)
    right, left = after.sum() + alone, before.sum() + alone
    rows, cols = rows[:among], cols[:among]
    out -= xlogx(rows + right) - xlogx(rows) + xlogx(cols + left) - xlogx(cols)
    return out - out[own]


def word_moves(words: DataFrame, classes: np.ndarray, n: np.ndarray, among: int, chance: Callable[[int], bool]) -> DataFrame:
    """word, to: the best move of every word that may move and gains by it."""
    arrow, k = to_arrow_schema(_MOVES), len(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moves = []
            ids, lists, values = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            for i, w in enumerate(ids):
                if not chance(w):
                    continue
                other, count = lists[i].values.to_numpy(), values[i].values.to_numpy().astype(float)
                left = other < 0
                alone = float(count[~left & (other == w)].sum())
                after = np.bincount(classes[other[~left]], count[~left], k)
                before = np.bincount(classes[-1 - other[left]], count[left], k)
                after[classes[w]] -= alone
                before[classes[w]] -= alone
                gain = gains(n, int(classes[w]), before, after, alone, among)
                to = int(gain.argmax())
                if gain[to] > 1e-6:
                    moves.append((w, to))
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in moves], pa.int32()), pa.array([m[1] for m in moves], pa.int32())], schema=arrow)

    return words.select("word", "others", "counts").mapInArrow(run, _MOVES)


def exchange(pairs: DataFrame, clustered: int, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of all symbols, their class counts, and the objective of every round that was kept.

    Symbols beyond the clustered words keep classes of their own (after the first k).
    """
    size = clustered + FORMS + 1
    classes = np.concatenate([np.arange(clustered) % k, k + np.arange(FORMS + 1)])
    every = k + FORMS + 1
    words = stored(neighbour_rows(pairs, clustered), "neighbours") if clustered else None
    n = class_counts(pairs, classes, every)
    history, part = [objective(n)], 2
    for number in range(rounds if clustered else 0):
        chance = lambda w, number=number, part=part: (w * 2_654_435_761 + number * 40_503) % 4_294_967_296 % part == 0
        moves = word_moves(words, classes, n, k, chance).collect()
        if not moves:
            continue
        new = classes.copy()
        for r in moves:
            new[r["word"]] = r["to"]
        counted = class_counts(pairs, new, every)
        reached = objective(counted)
        if reached > history[-1]:
            classes, n = new, counted
            history.append(reached)
        else:
            part *= 2
    assert len(classes) == size
    return classes, n, history


class BrownModel:
    """Log probabilities (base 10) by symbol and by pair of classes."""

    def __init__(self, symbols: Symbols, classes: np.ndarray, n: np.ndarray, forms: dict[int, tuple[int, int]], total: int, distinct: int, ends: int, k: int):
        """forms: tokens and distinct words of each form among all words but the clustered ones."""
        self.symbols, self.total, self.distinct = symbols, total, distinct
        plain, n = symbols.plain, n.astype(float)
        self.classes = classes[plain]
        share = (n.sum(0) + 1) / (n.sum() + len(n))
        self.transition = np.log10((n + SMOOTHING * share) / (n.sum(1)[:, None] + SMOOTHING))
        counts = symbols.counts.copy()
        counts[symbols.end] = ends
        #: log10(count + 1) of listed words, of others 0; the smoothed unigram's numerator.
        self.numerator, self.known = np.log10(counts + 1.0), (counts > 0).astype(np.int64)
        c, word_class = symbols.clustered, classes[: symbols.clustered]
        of_class = np.bincount(word_class, counts[:c], k)
        of_form = np.array([sum(forms.get(f, (0, 0))) + 1 for f in range(FORMS)], float)
        emission = np.empty(len(plain))
        emission[:c] = np.log10(counts[:c] / np.maximum(of_class[word_class], 1))
        emission[c : c + FORMS] = -np.log10(of_form)
        emission[symbols.end] = 0.0
        emission[symbols.end + 1 :] = self.numerator[symbols.end + 1 :] - np.log10(of_form[plain[symbols.end + 1 :] - c])
        self.emission = emission
        self.denominator = float(np.log10(total + distinct + 1))

    def score(self, words: list[list[bytes]], read: Callable[[list[bytes]], np.ndarray]) -> tuple[np.ndarray, ...]:
        """Of texts as tokens: n_tokens, n_known, base_score, score without what words that are not listed add, and where those are."""
        size = np.array([len(w) for w in words])
        at = read([t for w in words for t in w])
        starts = np.concatenate([[0], size.cumsum()[:-1]])
        end = self.classes[self.symbols.end]
        cls = self.classes[at]
        before = np.concatenate([[end], cls[:-1]])  # every text ends in the end
        each = self.transition[before, cls] + self.emission[at]
        rare = (at >= self.symbols.clustered) & (at < self.symbols.end)
        return size, np.add.reduceat(self.known[at], starts), np.add.reduceat(self.numerator[at], starts) - size * self.denominator, np.add.reduceat(each, starts), rare


def train(texts: DataFrame, k: int = CLASSES, rounds: int = ROUNDS) -> tuple[BrownModel, DataFrame, list[float]]:
    """The model of a column of texts in UTF-8, the table of all words, and the objective by round."""
    spark = texts.sparkSession
    ship(spark)
    words = stored(count_words(texts), "words")
    sums = words.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.length("word") == 0, F.col("n"))).alias("ends")).collect()[0]
    total, distinct = sums["n"] or 0, sums["v"]
    listed = words.where(F.col("n") * F.lit(LISTED).cast("long") >= total).toArrow() if total else None
    known = list(zip(*(listed.column(c).to_pylist() for c in ("word", "form", "n")), strict=True)) if listed is not None else []
    symbols = Symbols(known, total)
    sent = spark.sparkContext.broadcast(symbols)
    pairs = stored(count_neighbours(texts, sent), "pairs")
    classes, n, history = exchange(pairs, symbols.clustered, k, rounds)
    forms = {r["form"]: [r["n"], r["v"]] for r in words.where("form >= 0").groupBy("form").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    for f, c in zip(symbols.clustered_forms.tolist(), symbols.counts[: symbols.clustered].tolist(), strict=True):
        forms[f][0] -= c
        forms[f][1] -= 1
    return BrownModel(symbols, classes, n, {f: tuple(x) for f, x in forms.items()}, total, distinct, sums["ends"] or 0, k), words, history


def fold(doc_id: Column) -> Column:
    """The texts a model does not learn from: crc32 of the id as text leaves 2 modulo 7."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def score_texts(docs: DataFrame, k: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    model, words, _ = train(rows.where(~F.col("held_out")).select("text"), k, rounds)
    sent, arrow = spark.sparkContext.broadcast(model), to_arrow_schema(_SCORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, read = None, None
        for part, texts in _texts(batches, 2):
            if m is None:
                m = sent.value
                read = m.symbols.reader()
            split = [tokens(t) for t in texts]
            size, known, base, score, rare = m.score(split, read)
            lists, at = [], 0
            for w in split:
                found = np.flatnonzero(rare[at : at + len(w)])
                lists.append([{"word": x, "n": c} for x, c in Counter(w[i] for i in found).items()])
                at += len(w)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(lists, arrow.field("rare").type)], schema=arrow
            )

    scored = stored(rows.mapInArrow(run, _SCORED).withColumn("row", F.monotonically_increasing_id()), "scored")
    unlisted = words.where(F.col("n") * F.lit(LISTED).cast("long") < model.total).select("word", F.col("n").alias("c"))
    found = scored.select("row", F.inline("rare")).join(unlisted, "word")
    more = found.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + F.lit(1.0))).alias("more"), F.sum("n").alias("seen"))
    out = scored.drop("rare").join(more, "row", "left").na.fill(0, ["more", "seen"])
    score = F.col("score") + F.col("more")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("seen")).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base_score") + F.col("more")).alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity")
    )
