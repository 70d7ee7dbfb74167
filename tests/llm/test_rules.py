"""Quality rules and license scans against brute force, with odd inputs."""

import math
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nearspan.llm import license_scan as lic
from nearspan.llm import quality_rules as q
from nearspan.llm.license_texts import TEXTS

ODD = [None, "", " \t\n", "word", "a b c d e f g h " * 40, "x " * 30000, "l1 a\nl1 a\n\nl2\nl1 a", "#*$%&|<> é ü", "é ü\u000bz", "  wide"]


def documents(spark, texts, **more):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(at)
    hit = {k for i, w in enumerate(at) if often[w] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


@pytest.fixture(scope="module")
def some(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    return [r["text"] for r in rows] + ODD


def test_base_counts(spark, some):
    got = {r["doc_id"]: tuple(r)[1:7] for r in q.quality_rules(documents(spark, some)).collect()}
    assert got == {i: base(t) for i, t in enumerate(some)}


def test_base_counts_in_sql(spark):
    """The whole query over a whole table, its counting columns by SQL."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    c = duckdb.connect()
    c.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = c.sql(q.base_sql()).df()
    got = q.quality_rules(docs).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


def plain_ratios(spark, texts):
    """The ratio of every text, rebuilt with python alone but for the hash, which Spark gives word by word."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    pairs = sorted({(x, y) for w in split for x, y in zip(w, w[1:] + [None] * bool(w), strict=True)}, key=str)
    rows = spark.createDataFrame(pairs, "x string, y string").select("x", "y", F.xxhash64("x").alias("one"), F.xxhash64(F.xxhash64("x"), F.when(F.col("y").isNotNull(), F.xxhash64("y"))).alias("two")).collect()
    one, two = {r["x"]: r["one"] % q.BUCKETS for r in rows}, {(r["x"], r["y"]): r["two"] % q.BUCKETS for r in rows}
    raw, target, grams = Counter(), Counter(), []
    for t, w in zip(texts, split, strict=True):
        g = [one[x] for x in w] + [two[p] for p in zip(w, w[1:] + [None] * bool(w), strict=True)] if w else []
        grams.append(g)
        raw.update(g)
        n, _, _, dups, repeat, _ = base(t)
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        if n >= 50 and not re.search("[#*$%&|<>]|[A-Z]{4}", t) and repeat * 10 <= n and dups * 10 <= len(lines):
            target.update(g)
    assert sum(target.values())
    R, T = sum(raw.values()) + q.BUCKETS, sum(target.values()) + q.BUCKETS
    return [sum(math.log((target[x] + 1) / T) - math.log((raw[x] + 1) / R) for x in g) / max(1, len(g)) for g in grams]


def test_ratio_is_the_multinomials(spark, some):
    got = {r["doc_id"]: r for r in q.quality_rules(documents(spark, some)).collect()}
    for i, want in enumerate(plain_ratios(spark, some)):
        assert abs(got[i]["ratio"] - want) < 1e-4
        assert got[i]["kept"] == (not got[i]["base_failed"] and got[i]["ratio"] >= q.MIN_RATIO)


def test_rules_leave_labelled_documents_alone(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = q.quality_rules(docs).join(labels, "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in rows}
    assert kept[1] > 0.999 and kept[0] < 0.2


def test_rules_keep_columns_and_stand_empty_tables(spark, some):
    docs = documents(spark, some).withColumn("ratio", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("own", F.lit(2)).withColumn("__text", F.lit(3)).withColumn("h", F.lit(4))
    kept = q.keep_good(docs)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in q.quality_rules(docs).collect() if r["kept"]}
    rows = kept.collect()
    assert {r["doc_id"] for r in rows} == want and want and {(r["own"], r["__text"], r["h"]) for r in rows} == {(2, 3, 4)}
    assert q.quality_rules(docs.limit(0)).collect() == []
    twice = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert q.quality_rules(twice).count() == 2 * len(some)


def test_rules_use_no_python(spark, some):
    plan = q.quality_rules(documents(spark, some[:3]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


LICENSED = [
    "licensed under cc by 4 0 by 4 0 by 4 0 by 4 0",
    "licensed under the apache apache license version 2 0 version 2 0 version 2 0",
    "// " + TEXTS["bsd-3-clause"].replace("\n", "\n// "),
    "Copyright X. " + TEXTS["bsd-2-clause"],
    TEXTS["mit"].replace("person", "human being").upper(),
    TEXTS["mit"][:300],
    TEXTS["gpl-2.0"],
    TEXTS["lgpl-2.1"] + TEXTS["isc"],
    "Licensed under the Apache License, Version 2.0.",
    "X mit license MIT License mit mit license",
    "this work is licensed under the GNU General\nPublic License, version 3 and cc by-nc",
    "Released under MIT License, and (CC BY) gnu general public",
    "Licensed under CC BY-NC 4.0. " * 500,
    "released under the GNU General Public License, version 2; not 3",
    "permission is hereby granted free of charge to anyone obtaining a copy of this software and associated documentation files",
    "Apache KKLicense apache é license",
    None,
    "",
    "mit",
]


def test_license_scan_equals_sql_and_brute_force(spark, some):
    texts = LICENSED + some[:60]
    got = lic.license_scan(documents(spark, texts)).toPandas().sort_values("doc_id", ignore_index=True)
    c = duckdb.connect()
    table = pd.DataFrame({"doc_id": range(len(texts)), "text": pd.Series(texts, dtype="str")})
    c.register("t", table)
    c.sql("CREATE TABLE documents AS SELECT doc_id, text FROM t")
    want = c.sql(lic.license_sql()).df().sort_values("doc_id", ignore_index=True)
    for name in want.columns:
        assert [None if pd.isna(x) else x for x in got[name]] == [None if pd.isna(x) else x for x in want[name]], name
    for k, t in enumerate(texts):
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for p, label in lic.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        row = got.iloc[k]
        assert (row.n_words, row.n_base, row.base_labels) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        assert [None if pd.isna(x) else x for x in (row.first_word, row.last_word)] == ([min(places)[0], max(places)[0]] if places else [None, None])
        labels = {x for _, x in places} | {x for x in (slow_label(words, *p[1:]) for p in lic.phrases()) if x}
        assert row.labels == ",".join(sorted(labels))
    assert "cc-by-4.0" in got.labels[0] and "apache-2.0" in got.labels[1]
    assert got.labels[2] == "bsd,bsd-3-clause" and got.labels[3] == "bsd,bsd-2-clause" and got.labels[4] == got.labels[5] == "mit"
    assert got.labels[6] == "gpl,gpl-2.0" and got.labels[7] == "isc,lgpl,lgpl-2.1"
    assert "gpl-3.0" in got.labels[10] and got.labels[13] == "gpl" and "mit" in got.labels[14] and got.labels[17] == ""


def slow_label(words, label, base, least, template):
    """The label, if some window on neighbouring diagonals holds enough of the template's pairs of words."""
    if base:
        return ""
    pairs = dict(enumerate(zip(template, template[1:], strict=False)))
    hits = [(p, a) for p in range(len(words) - 1) for a, x in pairs.items() if (words[p], words[p + 1]) == x]
    diagonals = sorted({p - a for p, a in hits})
    spans, k = {}, 0
    for i, d in enumerate(diagonals):
        k += i > 0 and d - diagonals[i - 1] > lic.SLACK
        spans[d] = k
    for low, a in hits:
        most = low + int(lic.MOST_STRETCH * len(template)) - 1
        held = {y for p, y in hits if low <= p <= most and spans[p - y] == spans[low - a]}
        if len(held) >= least * len(pairs) and all(y in held for y, x in pairs.items() if lic.is_telling(*x)):
            return label
    return ""


def test_short_words_of_a_license_count(spark):
    """Only words of two or three letters are others, more than a tenth of the pairs: the text's label goes."""
    words, changed, short = TEXTS["bsd-2-clause"].split(), 0, 0
    for i, w in enumerate(words):
        if len(w) <= 3 and w.isalpha():
            short += 1
            if short % 3 == 0:
                words[i], changed = "zz", changed + 1
    assert changed > 0.06 * len(words)
    got = {r["doc_id"]: r["labels"].split(",") for r in lic.license_scan(documents(spark, [" ".join(words), TEXTS["bsd-2-clause"]])).collect()}
    assert "bsd-2-clause" in got[1] and "bsd-2-clause" not in got[0]


def test_license_scan_edges(spark):
    docs = documents(spark, LICENSED).withColumn("labels", F.lit(1))
    both = docs.unionByName(docs).withColumn("doc_id", F.lit(None).cast("long"))
    assert lic.license_scan(both).count() == 2 * len(LICENSED)
    assert lic.license_scan(docs.limit(0)).count() == 0
    plan = lic.license_scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_fold(spark):
    """The held-out rows are those whose id, as text, has a crc32 of 2 modulo 4; null ids are not."""
    from nearspan.llm.common import held_out

    rows = spark.createDataFrame([(i,) for i in [None, *range(400), -7]], "doc_id long")
    got = {r["doc_id"] for r in rows.where(held_out(F.col("doc_id"))).collect()}
    assert got == {i for i in [*range(400), -7] if zlib.crc32(str(i).encode()) % 4 == 2} and 80 < len(got) < 120
