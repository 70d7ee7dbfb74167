"""Benchmark items of few words."""

from nearspan.llm.decontaminate import Matcher, drop_leaks, find_leaks

from .test_rules import documents


def test_short_items_are_found(spark):
    """Six and seven words may differ by one, fewer than five by none."""
    items = [(1, "What is the capital of France?"), (2, "日本の首都はどこ"), (3, "one two three four five six seven"), (4, ""), (5, " ?! "), (6, None)]
    texts = ["so: what is the capital of france, he asked", "what is the capital of spain", "x 日本の首都はどこ。", "one two three four five six eight", "One, two; three four five six seven", None, "", "the capital of France? What is", "What was the capital of France", "What was a capital of France", "x 日本の首都はどれ。"]
    rows = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in find_leaks(documents(spark, texts), rows).collect()}
    assert got == {(0, 1, 6, 0, 1, 7), (1, 1, 6, 1, 0, 5), (2, 2, 1, 0, 1, 2), (3, 3, 7, 1, 0, 6), (4, 3, 7, 0, 0, 7), (8, 1, 6, 1, 0, 6)}
    assert {r["doc_id"] for r in drop_leaks(documents(spark, texts), rows).collect()} == {5, 6, 7, 9, 10}


def test_repeated_short_item_is_counted_once_a_document():
    assert Matcher([(1, "a b a"), (1, "c")]).matches("a b a b a c c") == [(1, 3, 0, 0, 3), (1, 1, 0, 5, 6)]
