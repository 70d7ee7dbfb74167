"""Benchmark decontamination by pigeonhole edit matching over words.

An item of m words may differ by k = floor(MAX_ERRORS * m) word edits. It is split into
k + 1 pieces; an occurrence with at most k edits holds one piece unchanged, so exact hits
of pieces (one Aho-Corasick pass over a document's normalised words) find every place.
Each place is verified with Myers' bit-parallel distance over words.

An item of fewer than five words may differ by no word: it is its own single piece.

Defined cases: null texts and items, and those without words, match nothing; null ids
stay; repeated items are matched once each; words are runs of letters and digits in lower
case; of equally good places the first counts; an empty table of items matches nothing, and an
empty table of documents gives an empty result; other columns, whatever their names, pass
through or are not looked at; a very long text is read whole.

A benchmark of at most ``BROADCAST_BYTES`` of text is one automaton that every task gets. A
larger one never passes through the driver: hashes of pieces are joined with those of the
documents' word n-grams (``_found_by_join``), which gives the same rows.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from nearspan.llm.common import fresh, map_rows, replace_text, stored

MAX_ERRORS = 0.2
#: Bytes of item texts up to which their automaton is broadcast.
BROADCAST_BYTES = 8 << 20
#: Bits of the filter of piece hashes (16 MB, whatever the benchmark), as a power of two.
FILTER_BITS = 27
#: Tasks that share the rows of one piece, or of one item, at least.
SALTS = 8
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def pieces_of(item: list[str]) -> tuple[int, list[tuple[int, int]]]:
    """The word errors an item may have, and its pieces as (first, end) words."""
    k = int(MAX_ERRORS * len(item))
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return k, list(zip(cuts, cuts[1:], strict=False))


class Masks:
    """Bit masks of an item's words, for Myers' algorithm over words."""

    def __init__(self, item: list[str]):
        self.m, self.at = len(item), {}
        for i, w in enumerate(item):
            self.at[w] = self.at.get(w, 0) | 1 << i

    def best(self, window: list[str]) -> tuple[int, int]:
        """Least distance between the item and any stretch of the window, and where it ends.

        The first row is free: a stretch may begin anywhere. Ties take the first end.
        """
        full, last = (1 << self.m) - 1, 1 << (self.m - 1)
        pv, mv, score, best = full, 0, self.m, (self.m, 0)
        for j, w in enumerate(window):
            eq = self.at.get(w, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv) & full, pv & xh
            if ph & last:
                score += 1
            elif mh & last:
                score -= 1
            ph, mh = ph << 1 & full, mh << 1 & full
            pv, mv = mh | ~(xv | ph) & full, ph & xv
            if score < best[0]:
                best = (score, j + 1)
        return best


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]]):
        import ahocorasick

        self.automaton, self.items = ahocorasick.Automaton(), []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            item = words(text)
            if not item:
                continue
            k, cuts = pieces_of(item)
            n = len(self.items)
            self.items.append((item_id, item, k, Masks(item), Masks(item[::-1])))
            for a, b in cuts:
                pieces.setdefault(" " + " ".join(item[a:b]) + " ", []).append((n, a))
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def matches(self, text: str | None) -> list[tuple[int | None, int, int, int, int]]:
        """(item id, item words, errors, first word, end word) of the best place of each item found."""
        if self.empty or not text:
            return []
        doc = words(text)
        joined = " " + " ".join(doc) + " "
        hits: dict[int, set[int]] = {}
        starts: dict[int, int] | None = None
        for end, (n, where) in self.automaton.iter(joined):
            if starts is None:
                starts, at = {}, 0
                for i, w in enumerate(doc):
                    starts[at] = i
                    at += len(w) + 1
            word = starts[end - n + 1]
            for item, a in where:
                hits.setdefault(item, set()).add(word - a)
        out = []
        for item, diagonals in hits.items():
            item_id, seq, k, masks, back = self.items[item]
            best: tuple[int, int, int] | None = None
            # Diagonals close together share one window, which reaches as far as each alone would.
            runs: list[list[int]] = []
            for d in sorted(diagonals):
                if runs and d <= runs[-1][1] + k:
                    runs[-1][1] = d
                else:
                    runs.append([d, d])
            for first, last in runs:
                a, b = max(0, first - k), min(len(doc), last + len(seq) + 2 * k)
                errors, end = masks.best(doc[a:b])
                if errors <= k and (best is None or errors < best[0]):
                    end += a
                    low = max(0, end - len(seq) - k)
                    _, length = back.best(doc[low:end][::-1])
                    best = (errors, end - length, end)
                    if not errors:
                        break
            if best:
                out.append((item_id, len(seq), *best))
        return out


_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType())]
    + [T.StructField(c, T.IntegerType()) for c in ("item_words", "errors", "first_word", "end_word")]
)


def _bytes(items: DataFrame, text: str) -> int:
    return items.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def _rows(items: DataFrame, text: str) -> list[tuple[int | None, str]]:
    """The items with text; only called for tables of at most BROADCAST_BYTES."""
    return [tuple(r) for r in items.select(F.col("item_id").cast("long"), F.col(text)).where(F.col(text).isNotNull()).collect()]


_MATCHERS: dict[int, Matcher] = {}


def _matcher(shared) -> Matcher:
    if shared.id not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[shared.id] = Matcher(shared.value)
    return _MATCHERS[shared.id]


class _Shared:
    """Broadcast items with a key by which workers remember its automaton."""

    def __init__(self, sc, items):
        self.id, self._b = hash(tuple(items)) & 0x7FFFFFFFFFFF, sc.broadcast(items)

    @property
    def value(self):
        return self._b.value


def _struct(**kinds: str) -> T.StructType:
    types = {"long": T.LongType(), "int": T.IntegerType(), "longs": T.ArrayType(T.LongType()), "ints": T.ArrayType(T.IntegerType()), "words": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(name, types[kind]) for name, kind in kinds.items()])


_ITEMS = _struct(item_id="long", seq="words")
_PIECES = _struct(hash="long", n="long", m="int", k="int", first="int", length="int")
_HITS = _struct(row="long", doc="words", hashes="longs", ats="ints")
_PLACES = _struct(row="long", n="long", item_id="long", item_words="int", errors="int", start="int", first_word="int", end_word="int")


def _ngram(seq: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(seq)) >> 1


def _split_words(rows: dict) -> dict:
    seqs = [(i, words(t)) for i, t in zip(rows["item_id"], rows["t"], strict=True)]
    return {"item_id": [i for i, x in seqs if x], "seq": [x for _, x in seqs if x]}


def _split_pieces(rows: dict) -> dict:
    out = {f.name: [] for f in _PIECES}
    for n, seq in zip(rows["n"], rows["seq"], strict=True):
        k, cuts = pieces_of(seq)
        for a, b in cuts:
            for f, v in zip(_PIECES, (_ngram(seq[a:b]), n, len(seq), k, a, b - a), strict=True):
                out[f.name].append(v)
    return out


def _filter_of(pieces: DataFrame) -> np.ndarray:
    """A bitmap of the pieces' hashes; 2 ** FILTER_BITS bits at any size."""
    at = F.expr(f"(hash % {1 << FILTER_BITS}) div 64").alias("i")
    found = pieces.groupBy(at).agg(F.expr("bit_or(shiftleft(1L, CAST(hash % 64 AS INT)))").alias("x")).toArrow()
    bits = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    bits[found.column("i").to_numpy()] = found.column("x").to_numpy()
    return bits.view(np.uint64)


def _salted(many: DataFrame, few: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The join of many rows with few; the rows of one key are dealt to SALTS tasks by a hash."""
    salted = many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return salted.join(few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "salt"]).drop("salt")


def _verify(rows: dict) -> dict:
    out, masks = {f.name: [] for f in _PLACES}, {}
    for row, n, item_id, k, seq, start, lead, window in zip(*(rows[c] for c in ("row", "n", "item_id", "k", "seq", "start", "lead", "window")), strict=True):
        if n not in masks:
            masks[n] = Masks(seq), Masks(seq[::-1])
        errors, end = masks[n][0].best(window[start - lead :])
        if errors <= k:
            end += start - lead
            _, length = masks[n][1].best(window[max(0, end - len(seq) - k) : end][::-1])
            for f, v in zip(_PLACES, (row, n, item_id, len(seq), errors, start, lead + end - length, lead + end), strict=True):
                out[f.name].append(v)
    return out


def _found_by_join(docs: DataFrame, items: DataFrame, item_text: str) -> DataFrame:
    """row, item_id, item_words, errors, first_word, end_word of the items in docs (row, text).

    Pieces have seven words at most, so a document has few kinds of n-grams; those the filter
    lets through are joined with the pieces. What the two share gives diagonals, close ones
    are merged, and only the window of each run meets the item's words.
    """
    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.col(item_text).alias("t"))
    indexed = stored(map_rows(named, ["item_id", "t"], _ITEMS, _split_words).withColumn("n", F.monotonically_increasing_id()), "items")
    pieces = stored(map_rows(indexed, ["n", "seq"], _PIECES, _split_pieces), "pieces")
    lengths = sorted(r[0] for r in pieces.select("length").distinct().collect())  # seven at most
    shared, top = docs.sparkSession.sparkContext.broadcast(_filter_of(pieces)), np.uint64((1 << FILTER_BITS) - 1)

    def hit(rows: dict) -> dict:
        out, bits = {f.name: [] for f in _HITS}, shared.value
        for row, t in zip(rows["row"], rows["text"], strict=True):
            doc, hashes, ats = words(t), [], []
            for length in lengths:
                made = np.fromiter((_ngram(doc[i : i + length]) for i in range(len(doc) - length + 1)), np.uint64)
                at = made & top
                known = np.flatnonzero(bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))
                hashes += made[known].tolist()
                ats += known.tolist()
            if hashes:
                for f, v in zip(_HITS, (row, doc, hashes, ats), strict=True):
                    out[f.name].append(v)
        return out

    found = stored(map_rows(docs, ["row", "text"], _HITS, hit), "hits")
    hits = found.select("row", F.explode(F.arrays_zip("hashes", "ats")).alias("h")).select("row", F.col("h.hashes").alias("hash"), F.col("h.ats").alias("at"))
    diagonals = _salted(hits, pieces, ["hash"], "row").select("row", "n", "m", "k", (F.col("at") - F.col("first")).alias("d")).distinct()
    order = Window.partitionBy("row", "n").orderBy("d")
    opens = F.coalesce(F.col("d") > F.lag("d").over(order) + F.col("k"), F.lit(True)).cast("int")
    runs = diagonals.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order)).groupBy("row", "n", "m", "k", "run").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    # The stretch found may begin up to k words before the window in which it ends.
    windows = (
        runs.join(found.select("row", "doc"), "row")
        .withColumn("start", F.greatest(F.lit(0), F.col("low") - F.col("k")))
        .withColumn("lead", F.greatest(F.lit(0), F.col("start") - 2 * F.col("k")))
        .withColumn("window", F.expr("slice(doc, lead + 1, least(size(doc), high + m + 2 * k) - lead)"))
        .select("row", "n", "k", "start", "lead", "window")
    )
    columns = ["row", "n", "item_id", "k", "seq", "start", "lead", "window"]
    places = map_rows(_salted(windows, indexed, ["n"], "row"), columns, _PLACES, _verify)
    names = ["errors", "start", "item_id", "item_words", "first_word", "end_word"]
    best = places.groupBy("row", "n").agg(F.min(F.struct(*names)).alias("best"))
    return best.select("row", *[F.col(f"best.{c}").alias(c) for c in names if c != "start"])


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, errors and the words' span."""
    if _bytes(items, item_text) > BROADCAST_BYTES:
        rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")), "documents")
        return _found_by_join(rows, items, item_text).join(rows.select("row", "doc_id"), "row").select(*_SCHEMA.names)
    shared = _Shared(docs.sparkSession.sparkContext, _rows(items, item_text))

    def run(rows: dict) -> dict:
        m, out = _matcher(shared), {f.name: [] for f in _SCHEMA}
        for doc_id, t in zip(rows["doc_id"], rows[text], strict=True):
            for row in m.matches(t):
                for f, v in zip(_SCHEMA, (doc_id, *row), strict=True):
                    out[f.name].append(v)
        return out

    return map_rows(docs, ["doc_id", text], _SCHEMA, run)


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """The documents that hold no item, with their own columns."""
    if _bytes(items, item_text) > BROADCAST_BYTES:
        row = fresh(docs, "__row")
        rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
        leaks = _found_by_join(rows.select(F.col(row).alias("row"), F.col(text).alias("text")), items, item_text)
        return rows.join(leaks.select(F.col("row").alias(row)).distinct(), row, "left_anti").select(*docs.columns)
    shared = _Shared(docs.sparkSession.sparkContext, _rows(items, item_text))
    return replace_text(docs, text, lambda texts: [not _matcher(shared).matches(t) for t in texts], keep=True)
