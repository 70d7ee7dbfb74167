"""A benchmark too large to broadcast gives the rows of a small one."""

import random

import pytest

from nearspan.llm import decontaminate
from nearspan.llm.decontaminate import Matcher, drop_leaks, find_leaks


def edited(r: random.Random, seq: list[str], edits: int) -> list[str]:
    seq = list(seq)
    for _ in range(edits):
        at = r.randrange(len(seq))
        kind = r.randrange(3)
        seq[at : at + (kind != 0)] = [] if kind == 2 else [r.choice("pqrs")]
    return seq


@pytest.fixture
def tables():
    r = random.Random(8)
    some = lambda n: [r.choice("abcdefgh") + r.choice("xyz") for _ in range(n)]
    items = [(i, " ".join(some(r.choice((1, 3, 7, 8, 9, 20, 41, 70))))) for i in range(30)]
    items += [(None, items[3][1]), (3, items[3][1]), (50, ""), (51, "?!"), (52, None)]
    docs = []
    for i in range(60):
        text = some(r.randrange(0, 60))
        for _ in range(r.randrange(3)):
            seq = r.choice(items[:30])[1].split()
            at = r.randrange(len(text) + 1)
            text[at:at] = edited(r, seq, r.randrange(max(1, len(seq) // 4)))
        docs.append((i, " ".join(text)))
    docs += [(None, docs[0][1]), (5, docs[5][1]), (90, ""), (91, None), (92, " ".join(some(30_000)))]
    return docs, items


def test_join_gives_the_rows_of_the_automaton(spark, tables, monkeypatch):
    docs, items = tables
    matcher = Matcher([x for x in items if x[1] is not None])
    want = sorted((repr((i, *row)) for i, t in docs for row in matcher.matches(t)))
    assert len(want) > 100
    rows = spark.createDataFrame([(i, t, i, "x") for i, t in docs], "doc_id long, text string, row long, __ROW string").repartition(7)
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = sorted(repr((i, t)) for i, t in docs if not matcher.matches(t))
    for most in (1 << 20, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
        assert sorted(repr(tuple(r)) for r in find_leaks(rows, bench).collect()) == want
        kept = drop_leaks(rows, bench)
        assert kept.columns == rows.columns
        assert sorted(repr((r["doc_id"], r["text"])) for r in kept.collect()) == clean


def test_large_benchmark_of_nothing(spark, tables, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    rows = spark.createDataFrame(tables[0], "doc_id long, text string")
    nothing = spark.createDataFrame([(1, "?!"), (2, None)], "item_id long, text string")
    for bench in (nothing, nothing.limit(0)):
        assert find_leaks(rows, bench).count() == 0
        assert drop_leaks(rows, bench).count() == rows.count()
    assert find_leaks(rows.limit(0), spark.createDataFrame(tables[1], "item_id long, text string")).count() == 0
