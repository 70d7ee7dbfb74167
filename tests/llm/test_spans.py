"""Scans and encodings against plain regular expressions, the library itself and each other."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearspan.llm import pii, secret_scan
from nearspan.llm.html_extract import decode, example_page, extract_html, main_texts, model
from nearspan.llm.pieces import SPACE, PieceCodec, default_model, digest_pieces, encode_pieces

from .test_rules import ODD, documents

CODEC = PieceCodec(default_model())


def plain_base(text):
    luhn = lambda d: sum((n if i % 2 == 0 else n * 2 - 9 * (n > 4)) for i, n in enumerate(map(int, reversed(d)))) % 10 == 0
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(k, a, b) for a, _, k, b in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@+-1 20(9)5é_%\n", max_size=60))
def test_base_pii_equals_the_expressions(text):
    assert pii.base_spans(text) == plain_base(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["password", "Secret", "token", "api_key", "APIKEY", "AKIA", "=", ": ", '"', "'", " ", "abcdef0123", "0123456789abcdef", "XY9", "K", "é", "tok", "-"]), max_size=14).map("".join))
def test_base_secrets_equal_the_expressions(text):
    want = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    want += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    want += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    got = [s for s in secret_scan.Scanner().spans(text) if s[0] in secret_scan.KINDS[:3]]
    assert got == [(k, a, b) for a, _, k, b in sorted(want)]


def test_checksums():
    body = "a1B2" * 7 + "zz"
    good = "ghp_" + body + secret_scan._base62(zlib.crc32(body.encode()), 6)
    spans = secret_scan.Scanner().spans(f"x {good} y {good[:-1]}{'0' if good[-1] != '0' else '1'} z")
    assert [s for s in spans if s[0] == "github"] == [("github", 2, 42)]


def test_added_pii_and_redaction():
    m = pii.model()
    text = "call me: 555-123-4567 or mail: jo.do [at] site [dot] com, card 4111 1111 1111 1111, on 2021-10-11"
    kinds = {k for k, _, _ in pii.all_spans(text, m)[1]}
    assert {"phone", "email", "card"} <= kinds
    out = pii.redacted(text, m)
    assert "4111" not in out and "555" not in out and "2021-10-11" in out and "[EMAIL]" in out
    assert pii.redacted(None, m) is None and pii.redacted("", m) == ""


def test_pii_scores_hold_out(spark):
    spans, marks = pii.examples(2000, 77)
    b, least = pii.model()
    p = b.probability(np.array([pii._features(*s) for s in spans]))
    chosen = np.array([q >= least[s[1]] for q, s in zip(p, spans, strict=True)])
    y = np.array(marks)
    assert y[chosen].mean() > 0.97 and chosen[y == 1].mean() > 0.9


@pytest.mark.parametrize("scan", [pii.find_pii, secret_scan.scan_secrets, digest_pieces])
def test_scans_take_odd_rows(spark, scan):
    docs = documents(spark, [*ODD, "a@b.c " * 3, "token=abcdefgh"]).withColumn("spans", F.lit(1))
    rows = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert scan(rows).count() == rows.count()
    assert scan(docs.limit(0)).count() == 0


def test_redact_keeps_columns(spark):
    docs = documents(spark, ["x a@b.cd y", None, ""]).withColumn("more", F.lit(3))
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert {(r["text"], r["n_chars"], r["more"]) for r in out.collect()} == {("x [EMAIL] y", 11, 3), (None, None, 3), ("", 0, 3)}


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_pieces_cover_the_bytes(text):
    if "\ud800" <= max(text, default="") <= "\udfff":
        return
    ids = CODEC.encode([text])[0][0]
    spans = CODEC.spans(text, ids)
    data = text.encode()
    assert not len(spans) or (spans[0, 0] == 0 and spans[-1, 1] == len(data) and (spans[1:, 0] == spans[:-1, 1]).all())
    for i, (a, b) in zip(ids, spans, strict=True):
        piece = CODEC.library.id_to_piece(i)
        if not piece.startswith("<0x"):
            assert piece.replace(SPACE, " ").encode() in (data[a:b].replace(SPACE.encode(), b" "), b" " + data[a:b].replace(SPACE.encode(), b" "))


def test_encoding_is_the_librarys(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=default_model())
    texts = [*ODD, "plain words", "tab\tand▁mark", "<s> </s>"]
    got = {r["doc_id"]: r for r in digest_pieces(documents(spark, texts)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, t in enumerate(texts):
        ids = lib.encode(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids) if ids else ""))
    full = {r["doc_id"]: r for r in encode_pieces(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        spans = np.array([full[i]["begins"], full[i]["ends"]], "<i8").T.copy()
        assert got[i]["spans_sha256"] == hashlib.sha256(spans.tobytes()).hexdigest()
        found = lib.encode(t or "", return_type="proto").pieces
        byte = [lib.is_byte(x.id) for x in found]
        assert [tuple(x) for x, y in zip(spans.tolist(), byte, strict=True) if not y] == [(x.begin, x.end) for x, y in zip(found, byte, strict=True) if not y]
    assert full[3]["ids"] == lib.encode("word") and full[3]["begins"][0] == 0 and full[3]["ends"][-1] == 4


def test_html_on_pages_and_layouts(spark):
    trees, r, exact = model(), random.Random(991), 0
    for _ in range(100):
        page, kept = example_page(r)
        exact += set(main_texts([page], trees)[0].split("\n")) - {""} == kept
    assert exact >= 95
    pages = ["", None, "<p>", "no markup at all", "<article><p>One &amp; two<br>three<p>Four</article><footer>f</footer>", "<script>x</script>", "<div" * 50]
    rows = spark.createDataFrame([(i, None, p, "x") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    out = {x["page_id"]: x for x in extract_html(rows).collect()}
    assert len(out) == len(pages) and out[0]["text"] == out[1]["text"] == ""
    assert out[4]["text"] == "One & two three\nFour" and out[4]["n_chars"] == 20
    assert extract_html(rows.limit(0)).count() == 0


def test_decoding_never_contradicts_itself():
    r = random.Random(8)
    for _ in range(50):
        parents = [-1] + [r.randrange(i) for i in range(1, 12)]
        odds = np.array([r.gauss(0, 1) for _ in parents])
        kept = decode(parents, odds)
        assert all(not k or i == 0 or kept[parents[i]] for i, k in enumerate(kept))
        best = max(
            sum(odds[i] for i in range(12) if s >> i & 1)
            for s in range(1 << 12)
            if all(not s >> i & 1 or i == 0 or s >> parents[i] & 1 for i in range(12))
        )
        assert abs(sum(odds[i] for i, k in enumerate(kept) if k) - best) < 1e-9


def test_html_of_pages_without_names():
    from nearspan.llm.html_extract import bare_page

    trees, r, exact = model(), random.Random(77), 0
    for _ in range(100):
        page, kept = bare_page(r)
        exact += set(main_texts([page], trees)[0].split("\n")) - {""} == kept
    assert exact >= 95
    prose = "<p>The committee met on Tuesday, and it decided, after a long debate, to build the bridge.</p><p>Work begins in May.</p>"
    pages = [
        f"<div><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></div><div>{prose}</div><div>Copyright 2020 Foo</div>",
        f"<table><tr><td><a href=/a>Home</a> | <a href=/b>News</a> | <a href=/c>Contact</a></td></tr></table><table><tr><td>{prose}</td></tr></table><table><tr><td>&copy; 2020 Foo Inc. All rights reserved.</td></tr></table>",
    ]
    assert main_texts(pages, trees) == [re.sub("</p><p>", "\n", prose)[3:-4]] * 2
