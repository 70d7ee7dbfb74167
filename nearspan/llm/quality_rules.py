"""Quality rules: counting rules, then a hashed n-gram log-likelihood ratio, all in SQL functions.

Two multinomials over hashed n-grams (every word, and every two neighbouring words) are
estimated from all documents: the raw corpus, and the trusted target, being the documents
that meet a strict set of counting rules (``TRUST``). A document's score is the sum of
log(p_target / p_raw) over its n-grams divided by their number; below ``MIN_RATIO`` it goes.

Defined cases: a null or empty text has no words and fails the base rules; ids and other
columns may be null, repeated or of any name (they are packed away and never looked at); an
empty table gives an empty result, and a corpus without a trusted document equal
multinomials (ratio 0). Each row is judged on its own, so repeated rows agree. A very long
text is one row's arrays: whole, some dozens of bytes a word.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
SMOOTHING = 1.0
MIN_RATIO = -0.08
MIN_WORDS = 20
WINDOW = 8

#: The strict rules a trusted document meets; none of them depends on its length beyond the first.
TRUST = "size(h) >= 50 AND clean AND repeat * 10 <= size(h) AND dups * 10 <= size(lines)"

_SPACE = r"[\\x20\\x09-\\x0D]+"
_TRIMMED = r"trim(BOTH ' \t\n\u000B\u000C\r' FROM text)"


def _words(then: str) -> str:
    """SQL: an expression over each word x of text, as an array."""
    return f"CASE WHEN {_TRIMMED} = '' THEN array() ELSE transform(split({_TRIMMED}, '{_SPACE}'), x -> {then}) END"


def _spaces_removed(text: str) -> str:
    for c in (" ", "\\t", "\\n", "\\u000B", "\\u000C", "\\r"):
        text = f"replace({text}, '{c}', '')"
    return text


def _measured(docs: DataFrame, text: str, *own: str, **more: str) -> DataFrame:
    """own (a struct of the columns named), h (hashes of the words), g (their n-grams), lines, dups, repeat.

    The arrays are columns of their own projections: what refers to neighbours inside a
    lambda must find a stored array, not an expression. ``repeat`` counts the words inside
    8-word windows that the text holds at least twice: windows of four words settle most
    rows; only where those repeat are (hash, position) of the windows of eight sorted and
    the union of the repeated ones measured.
    """
    packed = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.lit(None)
    return (
        docs.select(packed.alias("own"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
        .withColumns(
            {
                "h": F.expr(_words("xxhash64(x)")),
                "lines": F.expr(r"filter(split(text, '\\n'), x -> rlike(x, '[^\\x20\\x09-\\x0D]'))"),
                **{k: F.expr(v) for k, v in more.items()},
            }
        )
        .drop("text")
        .withColumn("g2", F.expr("transform(h, (x, i) -> xxhash64(x, get(h, i + 1)))"))
        .withColumn("g4", F.expr("transform(g2, (x, i) -> xxhash64(x, get(g2, i + 2)))"))
        .withColumn("g8", F.expr(f"CASE WHEN size(h) > {WINDOW} AND size(array_distinct(g4)) < size(g4) THEN slice(transform(g4, (x, i) -> xxhash64(x, get(g4, i + 4))), 1, size(h) - {WINDOW - 1}) END"))
        .withColumn("s", F.expr("CASE WHEN size(array_distinct(g8)) < size(g8) THEN sort_array(transform(g8, (x, i) -> named_struct('x', x, 'i', i))) END"))
        .withColumn("p", F.expr("sort_array(filter(transform(s, (e, i) -> CASE WHEN e.x = get(s, i - 1).x OR e.x = get(s, i + 1).x THEN e.i END), v -> v IS NOT NULL))"))
        .withColumn(
            "repeat",
            F.expr(
                f"CAST(CASE WHEN p IS NULL THEN 0 ELSE aggregate(p, named_struct('last', {-WINDOW}, 'n', 0), "
                f"(a, p) -> named_struct('last', p, 'n', a.n + least({WINDOW}, p - a.last)), a -> a.n) END AS BIGINT)"
            ),
        )
        .withColumn("dups", F.expr("CAST(size(lines) - size(array_distinct(lines)) AS BIGINT)"))
        .withColumn("g", F.expr("concat(h, g2)"))
        .drop("g2", "g4", "g8", "s", "p")
    )


def learn_ratios(docs: DataFrame, text: str = "text") -> list[float]:
    """log(p_target / p_raw) of every bucket; one partial aggregation over all documents.

    BUCKETS rows of two counts reach the driver whatever the size of the corpus.
    """
    measured = _measured(docs, text, clean="NOT rlike(text, '[#*$%&|<>]|[A-Z]{4}')")
    # The outer form: for the inner one the optimizer infers size(g) > 0 and inlines all of g into the scan's filter.
    rows = (
        measured.select(F.expr(f"CAST({TRUST} AS INT)").alias("trust"), "g")
        .select("trust", F.explode_outer("g").alias("g"))
        .where("g IS NOT NULL")
        .groupBy(F.expr(f"CAST(pmod(g, {BUCKETS}) AS INT)").alias("b"))
        .agg(F.count("*").alias("raw"), F.sum("trust").alias("target"))
        .collect()
    )
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in rows:
        raw[r["b"]], target[r["b"]] = r["raw"], r["target"]
    return ratios(raw, target)


def ratios(raw: list[int], target: list[int]) -> list[float]:
    a = SMOOTHING
    if not sum(target):
        return [0.0] * len(raw)
    r, t = math.log(sum(raw) + a * len(raw)), math.log(sum(target) + a * len(raw))
    return [round(math.log(y + a) - t - math.log(x + a) + r, 6) for x, y in zip(raw, target, strict=True)]


def score(docs: DataFrame, text: str, *own: str, learned: list[float] | None = None) -> DataFrame:
    """For every row of docs own (a struct of its columns named), n, chars, symbols, dups, repeat, failed, ratio and kept.

    The results pass through a one-element generator, below which no filter is pushed
    (pushing would repeat the whole expression tree, lambdas included).
    """
    learned = learn_ratios(docs, text) if learned is None else learned
    measured = _measured(
        docs,
        text,
        *own,
        chars=f"CAST(length({_spaces_removed('text')}) AS BIGINT)",
        symbols="CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '')) AS BIGINT)",
    )
    # One literal array, folded from one string: no join is needed to look a bucket up.
    table = F.split(F.lit(",".join(map(str, learned))), ",").cast("array<double>")
    scored = (
        measured.withColumn("table", table)
        .withColumns(
            {
                "n": F.expr("CAST(size(h) AS BIGINT)"),
                "ratio": F.expr(f"round(CASE WHEN size(g) = 0 THEN 0D ELSE aggregate(g, 0D, (a, g) -> a + get(table, CAST(pmod(g, {BUCKETS}) AS INT))) / size(g) END, 6)"),
            }
        )
        .drop("table", "lines", "h", "g")
        .withColumn("failed", F.expr(f"n < {MIN_WORDS} OR 100 * repeat > 30 * n"))
        .withColumn("kept", F.expr(f"NOT failed AND ratio >= {MIN_RATIO}"))
    )
    return scored.select("own", F.explode_outer(F.array(F.struct(*scored.columns[1:]))).alias("x")).select("own", "x.*")


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document: doc_id, counts, base_failed, kept and the method's ratio."""
    return score(docs, text, "doc_id").select(
        F.col("own.doc_id").alias("doc_id"),
        F.col("n").alias("n_words"),
        F.col("chars").alias("word_chars"),
        F.col("symbols").alias("n_symbols"),
        F.col("dups").alias("n_dup_lines"),
        F.col("repeat").alias("n_repeat_words"),
        F.col("failed").alias("base_failed"),
        "kept",
        "ratio",
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    return score(docs, text, *docs.columns).where("kept").select("own.*")


def base_sql() -> str:
    """The counting columns for DuckDB over the table documents; the ratio is learned and tested against brute force."""
    space = r"[\x20\x09-\x0D]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS x FROM w, unnest(range(1, len(w) - {WINDOW - 2})) AS u(i)),
o AS (SELECT r, i FROM p QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
c AS (SELECT r, sum(least({WINDOW}, i - last)) AS n FROM (SELECT r, i, lag(i, 1, {-WINDOW}) OVER (PARTITION BY r ORDER BY i) AS last FROM o) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{space}', '', 'g')) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(w) < {MIN_WORDS} OR 100 * coalesce(c.n, 0) > 30 * len(w) AS base_failed
FROM w LEFT JOIN c USING (r)"""
