"""Texts of two megabytes full of what an operator looks for end in time."""

import random
import time

import pytest

from nearspan.llm import html_extract, pii, secret_scan


def within(seconds, make):
    began = time.monotonic()
    made = make()
    assert time.monotonic() - began < seconds
    return made


@pytest.mark.parametrize("piece", ["555-123-4567 ", "Tel. 030 1234567, ", "1999-01-02 12 Main Street "])
def test_personal_data(piece):
    learned = pii.model()
    text = piece * (2_000_000 // len(piece))
    base, spans = within(60, lambda: pii.all_spans(text, learned))
    assert all(b <= c for (_, _, b), (_, c, _) in zip(spans, spans[1:], strict=False))


def test_spans_do_not_overlap_and_none_is_left_out():
    r = random.Random(2)
    chosen, kept = pii.SpanSet(), []
    for _ in range(400):
        a = r.randrange(300)
        b = a + r.randrange(1, 9)
        free = all(b <= x or a >= y for x, y in kept)
        assert chosen.add(a, b) == free
        kept += [(a, b)] * free


@pytest.mark.parametrize("text", ["eyJ" * 700_000, "eyJ" * 600_000 + ".eyJabcdefghijk.abcdefghijklmnopqrstuvw", "password=" * 220_000, "token " * 330_000, "AKIA" * 500_000])
def test_secrets(text):
    within(20, lambda: secret_scan.Scanner().spans(text))


def test_a_token_inside_a_run_is_found():
    import base64

    head = base64.urlsafe_b64encode(b'{"alg":"none"}').decode().rstrip("=")
    token = f"{head}.eyJabcdefghijk.abcdefghijklmnopqrstuvw"
    for lead in ("", "eyJx", "eyJxx", "eyJxxx", "eyJeyJ", "x-"):
        got = secret_scan.Scanner().spans(f"a {lead}{token} b")
        assert ("jwt", 2 + len(lead), 2 + len(lead) + len(token)) in got


@pytest.mark.parametrize("page", ["<button>" + "<div>" * 300_000, "<button>" + "<div>" * 150_000 + "</div>" * 150_000 + "</button>", "<p>a" * 300_000, "<div>" * 200_000 + "x"])
def test_pages(page):
    within(20, lambda: html_extract.parse(page))
