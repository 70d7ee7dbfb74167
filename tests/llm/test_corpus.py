"""Joins, decontamination, models and the pipeline."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from nearspan.llm import jaccard_join as jj
from nearspan.llm.common import join_heavy, slices
from nearspan.llm.decontaminate import MAX_ERRORS, Masks, Matcher, drop_leaks, find_leaks, words
from nearspan.llm.quality_model import score_quality
from nearspan.llm.toxicity import Grammar, score_toxicity

from .test_rules import ODD, documents

DATA = "/root/testdata/sf0.001"


def brute_join(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    links, parent = [0] * len(texts), list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: (root(i), links[i]) for i in range(len(texts))}


def test_jaccard_join_equals_brute_force(spark):
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.randint(5, 120))]
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 5))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [*ODD, "one two", "One  two!", "one two", "..."]
    docs = documents(spark, texts).withColumn("n_links", F.lit("clash"))
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in jj.jaccard_join(docs).collect()}
    assert got == brute_join(texts)
    kept = {x["doc_id"] for x in jj.keep_one(docs).collect()}
    assert len(kept) == len({c for c, _ in got.values()})
    assert jj.jaccard_join(docs.limit(0)).count() == 0


def test_blocks_count_every_link(spark, monkeypatch):
    """A group larger than a block: every pair of blocks is compared once."""
    monkeypatch.setattr(jj, "BLOCK", 8)
    monkeypatch.setattr(jj, "SMALL_BLOCK", 8)
    base = [f"a{i}" for i in range(200)]
    texts = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(0, 90, 3)]
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in jj.jaccard_join(documents(spark, texts)).collect()}
    assert got == brute_join(texts)


def test_rows_keep_their_numbers(spark, tmp_path):
    """Files read with another parallelism from job to job: the rows' numbers are written once."""
    r, texts = random.Random(4), []
    for _ in range(40):
        base = [f"w{r.randrange(900)}" for _ in range(60)]
        texts += [" ".join(base), " ".join([*base, "more"])]
    documents(spark, texts).repartition(3).write.parquet(f"{tmp_path}/d")
    key, was = "spark.sql.leafNodeDefaultParallelism", spark.sparkContext.defaultParallelism
    docs = spark.read.parquet(f"{tmp_path}/d")
    try:
        spark.conf.set(key, "1")
        rows, row = jj.numbered(docs)
        spark.conf.set(key, "8")
        signed, named = jj.jaccard_classes(rows, row, "text", "doc_id")
        spark.conf.set(key, "2")
        got = {x["id"]: x["class_id"] for x in signed.join(named, "set_key").select("id", "class_id").collect()}
        first = {x["doc_id"]: x[row] for x in rows.collect()}
        spark.conf.set(key, "5")
        assert {x["doc_id"]: x[row] for x in rows.collect()} == first
    finally:
        spark.conf.set(key, str(was))
    assert got == {i: c for i, (c, _) in brute_join(texts).items()}


def test_hot_keys_are_spread(spark, monkeypatch):
    """Copies, near copies and texts without words each hold a third of the rows."""
    monkeypatch.setattr(jj, "BAND_BLOCK", 16)
    monkeypatch.setattr(jj, "BLOCK", 8)
    monkeypatch.setattr(jj, "SMALL_BLOCK", 8)
    base = [f"a{i}" for i in range(150)]
    texts = ["the very same text in every one of these rows"] * 60 + [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(60)] + ["?"] * 60
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in jj.jaccard_join(documents(spark, texts)).collect()}
    assert got == brute_join(texts)


def test_internal_names_do_not_clash(spark):
    docs = documents(spark, ["one two three four five six", "one two three four five six", "other words"]).withColumn("__row", F.lit(7)).withColumn("__Row_", F.lit(8)).withColumn("set_key", F.lit(1))
    kept = jj.keep_one(docs)
    assert kept.columns == docs.columns and {tuple(x)[5:] for x in kept.collect()} == {(7, 8, 1)} and kept.count() == 2


def test_join_heavy(spark):
    left = spark.createDataFrame([(k % 7 if k % 2 else 100, k) for k in range(200)], "k long, v long")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    want = sorted(map(tuple, left.join(right.drop("n"), "k").collect()))
    assert sorted(map(tuple, join_heavy(left, right, "k", "n", 200).collect())) == want


def test_slices_bound_rows_and_bytes():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * 3_000_000, "y" * 3_000_000, "z", *["w"] * 1500, "v" * 9_000_000]})
    parts = list(slices(batch))
    assert sum(([*p.column(0).to_pylist()] for p in parts), []) == batch.column(0).to_pylist()
    assert all(p.num_rows <= 512 and (p.num_rows == 1 or p.nbytes <= 4 << 20) for p in parts)
    assert list(slices(batch.slice(0, 0))) == []


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100), (100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in jj.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def distance(item, window):
    """Least edit distance of the item to any stretch of the window."""
    row = [0] * (len(window) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(window):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance():
    r = random.Random(3)
    for _ in range(300):
        item = [r.choice("abcd") for _ in range(r.randint(1, 70))]
        window = [r.choice("abcd") for _ in range(r.randint(0, 90))]
        assert Masks(item).best(window)[0] == min(distance(item, window), len(item))


def test_leaks_equal_brute_force(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 5)))
    items = [(k, " ".join(word() for _ in range(r.randint(8, 40)))) for k in range(12)]
    texts = []
    for k in range(60):
        body = [word() for _ in range(r.randint(0, 80))]
        if k % 2:
            leak = items[k % 12][1].split()
            for _ in range(r.randrange(len(leak) // 3)):
                i = r.randrange(len(leak))
                leak[i : i + 1] = r.choice(([], [word()], [leak[i], word()]))
            at = r.randint(0, len(body))
            body[at:at] = leak
        texts.append(" ".join(body))
    texts += ODD
    rows = spark.createDataFrame([*items, (98, None), (99, "too short"), (97, "")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["errors"] for x in find_leaks(documents(spark, texts), rows).collect()}
    want = {}
    for i, t in enumerate(texts):
        for k, item in items:
            d = distance(item.split(), words(t))
            if d <= int(MAX_ERRORS * len(item.split())):
                want[i, k] = d
    assert got == want and want
    left = drop_leaks(documents(spark, texts), rows)
    assert left.columns == documents(spark, texts).columns
    assert {x["doc_id"] for x in left.collect()} == set(range(len(texts))) - {i for i, _ in want}
    assert find_leaks(documents(spark, texts), rows.limit(0)).count() == 0
    assert Matcher([]).matches("x") == []


def held_out_scores(spark, score, label):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    return np.array([r["score"] for r in rows]), np.array([r[label] for r in rows])


def auc(s, y):
    a, b = s[y == 1][:, None], s[y == 0][None, :]
    return ((a > b) + 0.5 * (a == b)).mean()


def test_quality_held_out(spark):
    assert auc(*held_out_scores(spark, score_quality, "quality")) > 0.95


def test_toxicity_held_out(spark):
    assert auc(*held_out_scores(spark, score_toxicity, "toxic")) > 0.75
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    s, y = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    assert auc(s, y) > 0.95 and (s[y == 1] >= 0.3).mean() > 0.85 and (s[y == 0] >= 0.3).mean() < 0.01


def test_models_take_odd_tables(spark):
    docs = documents(spark, ODD).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 0), (3, 0, None), (None, 1, 1), (77, None, None)], "doc_id long, quality int, toxic int")
    for score in (score_quality, score_toxicity):
        for table in (labels, labels.limit(0)):
            rows = score(docs.unionByName(docs), table).collect()
            assert len(rows) == 2 * len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
        assert score(docs.limit(0), labels).count() == 0


def test_grammar_scores_clauses_not_words():
    g = Grammar({})
    s = lambda t: g.features(t)[0]
    assert s("you are an idiot") > s("an idiot") > s("you are not an idiot") > 0
    assert s("she wrote that you are an idiot") < s("you are an idiot")
    assert s("i will kill you") > 0 == s("kill the process") == s("a fine day") == s(None)
    assert s("not here. you idiot") == s("you idiot")


def test_pipeline_takes_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, empty and long texts, clashing names, an empty benchmark and table."""
    prose = lambda k: " ".join(f"{w}{(i * k) % 97}" for i, w in enumerate(["some", "other", "words", "stand", "here", "and", "there"] * 20))
    texts = [prose(3), prose(3), prose(5) + " a@b.co and 10.0.0.1", prose(7) + " " + " ".join(f"long{i}" for i in range(30_000)), *ODD]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs).unionByName(spark.createDataFrame([(None,) * 5], docs.schema))
    for c in ("__row", "own", "kept", "set_key", "row", "h"):
        docs = docs.withColumn(c, F.when(F.col("doc_id") > 2, F.lit(1)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.createDataFrame([(1, prose(5)[:200]), (None, None), (2, "")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 0 in got and 1 not in got and 2 not in got and 3 in got and len(got) == 2
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    documents(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    items.limit(0).write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert 0 < out.count() < 200
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, DATA)
        assert after.columns == docs.columns, name
        assert stage(spark, docs.limit(0), DATA).count() == 0
        now = spark.createDataFrame(after.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, now, DATA)
    assert sorted(map(tuple, last.collect()), key=str) == sorted(map(tuple, out.collect()), key=str)
