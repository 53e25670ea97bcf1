"""Pages that break a reader of markup: unfinished tags, odd quotes, nested raw elements."""

import time

import pytest

from vanewatch.llm import html, language


def read(page):
    return [value.strip() for kind, value, _ in html.tokens(page) if kind == "text" and value.strip()]


@pytest.mark.parametrize("page, want", [
    ("<form action=x><p>All words of the page stand here</p><button>Go</button></form>",
     ["All words of the page stand here"]),
    ("<article>The article.<form>Leave a comment</form></article>", ["The article."]),
    ("<p>a</p><script src=/a/>code</script><p>b</p>", ["a", "b"]),
    ("<p>x <math><mi>y</mi></math> z</p>", ["x", "y", "z"]),
    ("<p>a<svg><svg><text>in</text></svg><text>label</text></svg>b</p>", ["a", "b"]),
    ("a<svg/>b", ["a", "b"]),
    ('<p>a <a href="x>link</a> b</p> 1 < 2', ["a", "link", "b", "1 < 2"]),
    ("<p>a</p><script>if (a<b && c == 'x) {}</script><p title='y'>b</p>", ["a", "b"]),
    ("a<!-- never closed <p>b", ["a"]),
])
def test_odd_markup(page, want):
    assert read(page) == want


@pytest.mark.parametrize("page", ["<div " * 200_000, '<div a="x' * 110_000 + ">", "<p a='>" * 140_000])
def test_unfinished_tags_are_read_in_linear_time(page):
    start = time.monotonic()
    read(page)
    assert time.monotonic() - start < 20


def test_numerals_are_no_letters():
    assert language.NO_LETTER.sub("", "½ ² a1 é Ⅷ 一_x") == "aé一x"
