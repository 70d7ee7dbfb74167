"""Language-model scores against plain counting of a small corpus, and the exchange against its objective."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from nearspan.llm import brown_lm as lm

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row long, word string, n int, score string")


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def trains(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2


def plain_base(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) by the contract alone."""
    count = Counter(w for i, t in rows if trains(i) for w in words_of(t))
    total, distinct = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        w = words_of(t)
        out.append((i, not trains(i), len(w), sum(count[x] > 0 for x in w), total, sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in w)))
    return out


def agree(got, rows):
    key = lambda r: (-1 if r[0] is None else r[0], r[2], r[5])
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    want = sorted(plain_base(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 1e-9 * max(1, abs(w[5])) for g, w in zip(got, want, strict=True))


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def small():
    """Few words in a fixed order of kinds, so that classes can be found."""
    rng, kinds = np.random.default_rng(4), ["the a this", "cat dog bird Cow", "sees eats hears", "12 7 2024", "bread-1 milk, tea!"]
    texts = [" ".join(rng.choice(k.split()) for _ in range(4) for k in kinds) for _ in range(120)]
    return [(i, t + (" once%d" % i if i % 3 else "")) for i, t in enumerate(texts)]


def slow_scores(rows, model):
    """Scores from a model's classes and plain counts, token by token."""
    count = Counter(w for i, t in rows if trains(i) for w in words_of(t))
    names, k = model.symbols, lm.CLASSES
    place = {w.decode(): int(model.classes[i]) for i, w in enumerate(names.words[: names.clustered])}
    cls = lambda w: k + lm.FORMS if w == "" else place.get(w, k + lm.form(w.encode()))
    follow, of_class, distinct = Counter(), Counter(), Counter()
    for i, t in rows:
        if trains(i):
            line = [cls(x) for x in ["", *words_of(t)]]
            follow.update(zip(line, line[1:]))
    for w, n in count.items():
        of_class[cls(w)] += n
        distinct[cls(w)] += 1
    every = k + lm.FORMS + 1
    total, out = sum(follow.values()), []
    after = Counter()
    into = Counter()
    for (a, b), n in follow.items():
        after[a] += n
        into[b] += n
    for i, t in rows:
        line, at, sum_ = ["", *words_of(t)], 0, 0.0
        for a, b in zip(line, line[1:]):
            x, y = cls(a), cls(b)
            share = (into[y] + 1) / (total + every)
            p = (follow[x, y] + lm.SMOOTHING * share) / (after[x] + lm.SMOOTHING)
            q = 1 if b == "" else count[b] / of_class[y] if b in place else (count[b] + 1) / (of_class[y] + distinct[y] + 1)
            sum_ += math.log10(p) + math.log10(q)
        out.append(sum_)
    return out


def train_of(spark, rows):
    texts = frame(spark, [(i, t, "", 0, "", 0, "") for i, t in rows if trains(i)]).selectExpr("CAST(text AS BINARY) AS text")
    return lm.train(texts)


@pytest.mark.parametrize("listed", [lm.LISTED, 100])
def test_scores_equal_plain_counting(spark, small, documents, monkeypatch, listed):
    """With few listed words most of a text is joined with the table of words; the scores stay."""
    monkeypatch.setattr(lm, "LISTED", listed)
    monkeypatch.setattr(lm, "CLUSTERED", min(lm.CLUSTERED, listed // 2))
    for rows in (small, documents):
        got = lm.score_texts(frame(spark, [(i, t, "", 0, "", 0, "") for i, t in rows])).collect()
        agree(got, rows)
        model, _, _ = train_of(spark, rows)
        want = dict(zip((i for i, _ in rows), slow_scores(rows, model), strict=True))
        assert max(abs(r["score"] - want[r["doc_id"]]) / max(1, abs(want[r["doc_id"]])) for r in got) < 1e-9


def test_gains_are_differences_of_the_objective():
    rng = np.random.default_rng(2)
    line = rng.integers(0, 12, 3000)
    n = np.zeros((12, 12))
    np.add.at(n, (line[:-1], line[1:]), 1)
    classes = rng.integers(0, 4, 12)
    by = lambda c: np.array([[n[np.ix_(c == i, c == j)].sum() for j in range(4)] for i in range(4)])
    for w in range(12):
        after, before, alone = np.bincount(classes, n[w], 4), np.bincount(classes, n[:, w], 4), n[w, w]
        after[classes[w]] -= alone
        before[classes[w]] -= alone
        got = lm.gains(by(classes), classes[w], before, after, alone, 4)
        for to in range(4):
            new = classes.copy()
            new[w] = to
            assert abs(got[to] - (lm.objective(by(new)) - lm.objective(by(classes)))) < 1e-6


def test_exchange_puts_words_of_one_kind_together(spark, small):
    texts = frame(spark, [(i, t, "", 0, "", 0, "") for i, t in small]).selectExpr("CAST(text AS BINARY) AS text")
    model, _, history = lm.train(texts, k=5, rounds=20)
    assert history == sorted(history) and len(history) > 2
    place = {w.decode(): int(model.classes[i]) for i, w in enumerate(model.symbols.words[: model.symbols.clustered])}
    for kind in (["the", "a", "this"], ["sees", "eats", "hears"], ["12", "7", "2024"]):
        assert len({place[w] for w in kind}) == 1


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    got = lm.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").toPandas()
    assert got["score"].sum() > got["base_score"].sum() and (got["perplexity"] > 1).all()


def test_transitions_and_emissions_are_shares(spark, small):
    model, _, _ = train_of(spark, small)
    assert np.allclose((10**model.transition).sum(1), 1)
    c = model.symbols.clustered
    sums = np.bincount(model.classes[:c], 10 ** model.emission[:c], lm.CLASSES)
    assert np.allclose(sums[np.unique(model.classes[:c])], 1)


def test_odd_rows(spark):
    odd = [(None, "Null id"), (1, None), (1, None), (2, ""), (3, " \t\n "), (4, "İ É straße x y   z\x1cq"), (5, "word " * 300_000), (6, "new " * 3), (10, "a b"), (11, "A B")]
    agree(lm.score_texts(frame(spark, [(i, t, "x", 1, "w", 2, "s") for i, t in odd])).collect(), odd)
    none = lm.score_texts(frame(spark, []))
    assert none.count() == 0 and none.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    alone = [i for i in range(100) if not trains(i)][:3]
    got = lm.score_texts(frame(spark, [(i, "nothing learned", "", 0, "", 0, "") for i in alone])).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"]) for r in got} == {(0, 0, 0.0)} and all(math.isfinite(r["score"]) for r in got)


def test_forms():
    assert len({lm.form(w) for w in (b"abc", b"12", b"a1", b"--", "é".encode(), b"a-b", b"abc,", b"abc.", b"abcdefghijk")}) == 9
    assert all(0 <= lm.form(bytes([x, y])) < lm.FORMS for x in range(33, 256) for y in range(33, 256))
