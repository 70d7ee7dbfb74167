"""Pages whose markup is not closed or quoted as it should be."""

import html
import re

import pytest

from nearspan.llm.html_extract import describe, extract_html, parse


def texts(page):
    return [t for t in describe(parse(page))[3] if t]


@pytest.mark.parametrize("tag", ["button", "select", "svg", "object", "math", "noscript", "canvas", "template"])
def test_unclosed_elements_do_not_end_the_page(tag):
    assert texts(f"<article><p>One</p><{tag}><p>Two</p><p>Three</p></article><p>Four</p>")[-3:] == ["Two", "Three", "Four"]


@pytest.mark.parametrize("tag", ["math", "object", "noscript", "svg", "canvas"])
def test_text_of_closed_elements_stays(tag):
    assert texts(f"<p>One <{tag}>two</{tag}> three</p>") == ["One two three"]


@pytest.mark.parametrize("tag", ["button", "select", "template", "textarea", "script", "style", "title", "iframe"])
def test_what_is_no_text_is_dropped(tag):
    assert texts(f"<p>One <{tag}>no</{tag}> two</p><p>three</p>") == ["One two", "three"]


def test_dropped_elements_hold_blocks_and_end_with_their_parent():
    assert texts("<p>a</p><button><div>no</div></button><p>b</p>") == ["a", "b"]
    assert texts("<div><button>no</div><p>b</p><button>no</button><p>c</p>") == ["b", "c"]
    assert texts("<form><select><option>x<option>y</form><p>b</p>") == ["b"]
    assert texts("<template><p>x</p><template>y</template>z</template><p>b</p>") == ["b"]
    assert texts("<article><button>no<div>in</div></article><p>b</p><button>no</button>") == ["in", "b"]


def test_stray_quotes_do_not_join_tags():
    assert texts("<p title=Bob's>One</p><p>Two</p><p>It's three</p><p>Four</p>") == ["One", "Two", "It's three", "Four"]
    assert texts("<p title=Bob's>One</p><p 5\" x>Two</p>") == ["One", "Two"]
    assert texts("<p title=\"a > b\" id = 'c > d'>One</p>") == ["One"]
    assert texts("<p title=\"open>One</p><p>Two</p>") == ["One", "Two"]
    assert texts("<p a=\"x>y\"" + " b=\"y\"" * 5000)


def test_stray_end_tags_cost_no_walk_up_the_tree():
    import time

    at = time.perf_counter()
    page = "<div>" * 60_000 + "x</p>" * 60_000
    assert texts(page) and time.perf_counter() - at < 20


def plain(page):
    """The given layout by one expression: the blocks of the article element, tags taken out."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)
    if not inner:
        return None
    body = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", inner[1], flags=re.S)
    body = re.sub(r"<div class=\"ad\">.*?</div>|<(form|aside|nav)\b.*?</\1>", "\n\0", body, flags=re.S).replace("\0", "")
    blocks = re.split(r"</?(?:p|h[1-6]|div|ul|li|section|blockquote|table|tr|td)\b[^>]*>", body)
    return [x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", lambda m: " " if m[0][:3] == "<br" else "", b)).split()) for b in blocks) if x]


def test_every_page_of_the_table_by_a_plain_expression(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in extract_html(rows).collect()}
    pages = rows.collect()
    assert len(got) == len(pages)
    same = 0
    for r in pages:
        want = plain(r["html"])
        out = got[r["page_id"]]
        assert out["url"] == r["url"] and out["n_chars"] == len(out["text"])
        same += want is not None and out["text"].split("\n") == want
    assert same == len(pages)


def test_repeated_null_and_long_pages(spark):
    long = "<nav><a href=/>menu</a></nav><article>" + "<p>Some words, and more of them.</p>" * 40_000 + "</article><footer>foot</footer>"
    docs = spark.createDataFrame([(1, "u", "<article><p>One.</p></article>", 5), (1, "u", "<article><p>One.</p></article>", 6), (None, None, None, 7), (2, "v", long, 8)], "page_id long, url string, html string, n_chars int")
    got = sorted((tuple(r) for r in extract_html(docs).collect()), key=lambda r: r[3])
    assert [r[0] for r in got] == [None, 1, 1, 2] and got[1] == got[2] and got[0][2] == ""
    assert got[3][2].count("\n") == 39_999 and "menu" not in got[3][2]
