"""The whole pipeline against plain versions of its stages, text by text."""

import hashlib

import sentencepiece

import corpus_pipeline
from nearspan.llm import quality_rules as q
from nearspan.llm.pieces import default_model

from .test_corpus import brute_join
from .test_queries_by_hand import PERSONAL, plain_leaks, plain_spans, split_words
from .test_rules import ODD, base, documents, plain_ratios

DATA = "/root/testdata/sf0.001"


def redacted(t):
    out, at = "", 0
    for kind, a, b in plain_spans(t)[1]:
        if a >= at:
            out += f"{t[at:a]}[{kind.upper()}]"
        at = max(at, b)
    return out + t[at:]


def test_pipeline_equals_its_stages_by_hand(spark, tmp_path):
    given = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").select("text").collect()]
    prose = [t for t in given if t and 300 < len(t) < 3000]
    # Copies, near copies, personal data in the middle of prose, odd texts.
    texts = [*given, *prose[:8], *[t.replace(" ", "  ", 3) for t in prose[8:14]], *[f"{t} {p}" for t, p in zip(prose[14:], PERSONAL, strict=False)], *ODD]
    documents(spark, texts).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [i for i, (t, ratio) in enumerate(zip(texts, plain_ratios(spark, texts), strict=True)) if not base(t)[-1] and round(ratio, 6) >= q.MIN_RATIO]
    assert 0 < len(left) < len(texts)
    classes = brute_join([texts[i] for i in left])
    single = [i for k, i in enumerate(left) if classes[k][0] == k]
    assert len(single) < len(left)
    leaks = {i for i, _ in plain_leaks([(i, split_words(texts[i])) for i in single], [(r["item_id"], split_words(r["text"])) for r in items.collect()])}
    clean = [i for i in single if i not in leaks]
    assert leaks and clean
    lib = sentencepiece.SentencePieceProcessor(model_file=default_model())
    sha = lambda b: hashlib.sha256(b.encode("utf-8")).hexdigest()
    want, changed = [], 0
    for i in clean:
        text = redacted(texts[i])
        changed += text != texts[i]
        ids = lib.encode(text)
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == want and changed >= 3
