"""License scans by diagonal voting, in SQL functions only.

Hashes of all two-word grams of every text are joined to the positions they have in the
templates (a fixed table, so broadcasting it is bounded), and the words of each hit are
compared, so that no collision votes. Hits of one document, template and diagonal (position
in the text minus position in the template) are votes. Diagonals at most ``SLACK`` apart are
merged, since a word left out or put in shifts the diagonal. A merged span is verified by
its best window: the stretch of text, not much longer than the template, that holds most of
the template's grams, among them all that tell it from kindred licenses (``is_telling``). Base phrases need every one of their grams on one diagonal.

Templates are sentences that name a license and the full texts or notices of
``license_texts``; the latter need more of their grams, as kindred licenses share clauses.

Defined cases: a null or empty text has no words and no labels; ids may be null or
repeated, rows are told apart by a row number; an empty table gives an empty result; other
columns, whatever their names, are never looked at; scores tie freely, being a maximum. A
very long text is read whole; what meets in one task is one text's hits.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearspan.llm.license_texts import TEXTS

SLACK = 3
# What tells kindred licenses apart, being a word by itself, a number after one of these, or what follows "gnu".
TELLING, BEFORE_NUMBER = ("lesser", "affero", "nc", "sa", "nd"), ("version", "v", "by", "sa", "nc", "license")
#: Share of the grams a sentence must have, and a full text or notice.
LEAST_COVER, LEAST_OF_TEXT = 0.7, 0.9
MOST_STRETCH = 1.3

# Phrases and labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0",
    "released under the mit license": "mit",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "under the terms of the gnu affero general public license": "agpl",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def template_words(text: str) -> list[str]:
    """The words of a text by the rule of the scan."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(_UPPER, _LOWER)))


def phrases() -> list[tuple[int, str, bool, float, list[str]]]:
    """(number, label, whether a base phrase, least share of its grams, words) of every template."""
    all_ = [(label, True, 1.0, text) for text, label in BASE.items()] + [(label, False, LEAST_COVER, text) for text, label in TEMPLATES.items()]
    all_ += [(label, False, LEAST_OF_TEXT, text) for label, text in TEXTS.items()]
    return [(k, label, base, least, template_words(text)) for k, (label, base, least, text) in enumerate(all_)]


def is_telling(a: str, b: str) -> bool:
    return a == "gnu" or b in TELLING or a in BEFORE_NUMBER and b.isdigit()


def _positions() -> list[tuple]:
    """(a, b, template, position, whether telling, grams, telling ones, longest window, hits it may hold, base, least, label) of every gram."""
    out = []
    for k, label, base, least, words in phrases():
        grams = [(i, a, b) for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
        most = int(MOST_STRETCH * len(words)) - 1
        often = max(Counter(g[1:] for g in grams).values())
        keys = sum(is_telling(*g[1:]) for g in grams)
        out += [(a, b, k, i, is_telling(a, b), len(grams), keys, most, (most + 1) * often, base, least, label) for i, a, b in grams]
    return out


_TEMPLATE = ("grams", "keys", "most", "reach", "base", "least", "label")


def _tables(spark) -> tuple[DataFrame, DataFrame]:
    """The templates' grams by hash and words, and what holds for a template; a sentinel row marks every document."""
    rows = [*_positions(), ("", "", -1, 0, False, 1, 0, 0, 1, False, 2.0, "")]
    grams = spark.createDataFrame([(a, b, k, 2 * i + telling) for a, b, k, i, telling, *_ in rows], "ta string, tb string, template int, code int")
    facts = spark.createDataFrame(sorted({(x[2], *x[5:]) for x in rows}), "template int, grams int, keys int, most int, reach int, base boolean, least double, label string")
    return grams.withColumn("gram", F.xxhash64("ta", "tb")), facts


def license_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    words = docs.select(F.col("doc_id"), F.col(f"`{text}`").alias("t"), F.monotonically_increasing_id().alias("row")).select(
        "row", "doc_id", F.expr(f"array_remove(split(translate(coalesce(t, ''), '{_UPPER}', '{_LOWER}'), '{_BETWEEN}'), '')").alias("w")
    )
    pair = "named_struct('gram', xxhash64({0}, {1}), 'a', {0}, 'b', {1})"
    grams = (
        words.withColumn("g", F.expr(f"transform(w, (x, i) -> {pair.format('x', 'get(w, i + 1)')})"))
        .select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.expr(f"concat(g, array({pair.format(repr(''), repr(''))}))").alias("g"))
        .select("row", "doc_id", "n_words", F.posexplode_outer("g").alias("pos", "g"))
        .select("row", "doc_id", "n_words", "pos", "g.gram", "g.a", "g.b")
    )
    found, facts = _tables(docs.sparkSession)
    own = F.col("template") < 0
    # The hash finds, the words decide. What holds for a document travels with its sentinel row alone.
    hits = grams.join(F.broadcast(found), "gram").where("a = ta AND b = tb").select(
        "row", "template", F.when(own, 0).otherwise(F.col("pos") - F.shiftright("code", 1)).alias("diagonal"), "code", F.when(own, F.col("doc_id")).alias("doc_id"), F.when(own, F.col("n_words")).alias("n_words")
    )
    # A text's votes are aggregated where the text is read; a row for each diagonal moves.
    votes = hits.groupBy("row", "template", "diagonal").agg(F.collect_list("code").alias("codes"), F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words")).join(F.broadcast(facts), "template")
    # A document's votes meet in one task: as many as its own text holds, after aggregation.
    spans = votes.withColumn(
        "gap",
        F.expr("CASE WHEN base OR template < 0 OR diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) > {} THEN 1 ELSE 0 END".format(SLACK)),
    ).withColumn("span", F.expr("sum(gap) OVER (PARTITION BY row, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING)"))
    merged = spans.groupBy("row", "template", *_TEMPLATE, "span").agg(
        F.sort_array(F.flatten(F.collect_list(F.expr("transform(codes, c -> named_struct('pos', shiftright(c, 1) + diagonal, 'at', shiftright(c, 1), 'telling', c % 2 = 1))")))).alias("hits"),
        F.min("diagonal").alias("start"),
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
    )
    held = "size(array_distinct(transform(filter(slice(hits, i + 1, reach), y -> y.pos <= x.pos + most{}), y -> y.at)))"
    window = f"CASE WHEN {held.format(' AND y.telling')} = keys THEN {held.format('')} ELSE 0 END"
    verified = (
        merged.withColumn("covered", F.expr("CASE WHEN template < 0 THEN 0 ELSE size(array_distinct(transform(hits, y -> y.at))) END"))
        .withColumn("best", F.expr(f"CASE WHEN base THEN covered WHEN covered >= least * grams THEN array_max(transform(hits, (x, i) -> {window})) ELSE 0 END"))
        .withColumn("cover", F.expr("best / CAST(grams AS DOUBLE)"))
        .withColumn("whole", F.expr("base AND covered = grams"))
        .withColumn("good", F.expr("NOT base AND best >= least * grams"))
    )
    return (
        verified.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_words").alias("n_words"),
            F.count_if("whole").cast("long").alias("n_base"),
            F.min(F.expr("CASE WHEN whole THEN CAST(start AS BIGINT) END")).alias("first_word"),
            F.max(F.expr("CASE WHEN whole THEN CAST(start AS BIGINT) END")).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.expr("CASE WHEN whole THEN label END"))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set(F.expr("CASE WHEN whole OR good THEN label END"))), ",").alias("labels"),
            F.round(F.max(F.expr("CASE WHEN whole OR good THEN cover ELSE 0D END")), 6).alias("score"),
        )
        .drop("row")
    )


def license_sql() -> str:
    """The same scan for DuckDB over the table documents."""
    rows = ", ".join(f"('{a}', '{b}', {k}, {i}, {str(telling).lower()}, {grams}, {keys}, {most}, {str(base).lower()}, {least}, '{label}')" for a, b, k, i, telling, grams, keys, most, _, base, least, label in _positions())
    return rf"""
WITH grams(a, b, template, "at", telling, grams, keys, most, base, least, label) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT r, w, unnest(range(0, greatest(len(w) - 1, 0))) AS pos FROM d),
h AS (SELECT r, pos, "at", pos - "at" AS diagonal, template, telling, grams, keys, most, base, least, label FROM p JOIN grams ON w[pos + 1] = a AND w[pos + 2] = b),
v AS (SELECT r, template, base, diagonal FROM h GROUP BY ALL),
g AS (SELECT *, CASE WHEN base OR diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {SLACK} THEN 1 ELSE 0 END AS gap FROM v),
s AS (SELECT r, template, diagonal, sum(gap) OVER (PARTITION BY r, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM g),
k AS (SELECT h.*, span FROM h JOIN s USING (r, template, diagonal)),
m AS (SELECT r, template, grams, base, least, label, span, count(DISTINCT "at") AS covered, min(diagonal) AS start FROM k GROUP BY ALL),
b AS (SELECT x.r, x.template, x.span, x.pos, count(DISTINCT y."at") AS n FROM k x JOIN k y ON x.r = y.r AND x.template = y.template AND x.span = y.span AND y.pos BETWEEN x.pos AND x.pos + x.most WHERE NOT x.base GROUP BY x.r, x.template, x.span, x.pos, x.keys HAVING count(DISTINCT CASE WHEN y.telling THEN y."at" END) = x.keys),
e AS (SELECT r, template, span, max(n) AS n FROM b GROUP BY ALL),
f AS (SELECT m.*, base AND covered = grams AS whole, NOT base AND coalesce(n, 0) >= least * grams AS good, CASE WHEN base THEN covered ELSE n END / CAST(grams AS DOUBLE) AS cover FROM m LEFT JOIN e USING (r, template, span)),
x AS (SELECT r, count(*) FILTER (WHERE whole) AS n_base, min(start) FILTER (WHERE whole) AS first_word, max(start) FILTER (WHERE whole) AS last_word,
      array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE whole)), ',') AS base_labels,
      array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE whole OR good)), ',') AS labels,
      round(max(cover) FILTER (WHERE whole OR good), 6) AS score FROM f GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN x USING (r)"""
