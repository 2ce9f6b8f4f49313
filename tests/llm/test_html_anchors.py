"""Ids that are made from headings, and parse time with very many open elements."""

import random
import time

import pytest

from cairn.llm import html_extract as H

PROSE = "<p>The quick brown fox jumps over the lazy dog and goes on with a story of some length here, really.</p>"
IDS = "related-work social-impact search login notice-to-readers share-price navigation-in-birds header-1 menu-planning comments-on-kant reply-to-critics sponsors-of-war hidden-markov-models discussion alerts promotion-rules copyright-law subscribers"


@pytest.mark.parametrize("name", IDS.split())
@pytest.mark.parametrize("form", ['<section id="{0}"><h2>Its head</h2>{1}</section>', '<h2 id="{0}">Its head</h2>{1}', '<div id="{0}"><div><h3>Its head</h3></div>{1}</div>'])
def test_sections_named_after_their_headings_stay(name, form):
    page = f"<html><body><nav><a href=x>Menu one</a></nav><article><h1>Title</h1>{PROSE * 3}{form.format(name, PROSE.replace('quick', 'second'))}</article><footer>foot</footer></body></html>"
    text = H.main_text(page)
    assert "Its head" in text and "second brown fox" in text and "Menu" not in text and "foot" not in text


@pytest.mark.parametrize("furniture", ['<section id="comments"><h2>Two comments</h2><p>I say nay</p></section>', '<div id="share">nay <a href=x>on</a></div>', '<div class="related"><h3>Related</h3><p>nay</p></div>', '<section id="related-posts"><h2>More</h2><p><a href=x>nay one</a> <a href=y>nay two</a></p></section>', '<div class="newsletter" id="read-on"><h2>Sign up</h2><p>nay</p></div>'])
def test_furniture_inside_an_article_goes(furniture):
    assert "nay" not in H.main_text(f"<html><body><article><h1>Title</h1>{PROSE * 3}{furniture}{PROSE}</article></body></html>")


@pytest.mark.parametrize("page", ["<b>" * 15000 + "</i>" * 15000, "<span>" * 15000 + "<li>x" * 15000, "<div><p>" * 20000, "<table><tr><td>" * 8000, "<ul><li>" * 10000 + "</p>" * 10000])
def test_many_open_elements(page):
    began = time.perf_counter()
    H.main_text(page)
    assert time.perf_counter() - began < 10


def slow_parents(page):
    """The depth of each start tag by a walk over the whole stack."""
    stack, depths = ["#root"], []
    for found in H._token.finditer(page):
        closing, tag = found[1], (found[2] or "").lower()
        if closing:
            if tag in stack:
                while stack.pop() != tag:
                    pass
            continue
        ends, place = (*H._CLOSES.get(tag, ()), *(["p"] if tag in H._CLOSES_P else [])), None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k] in ends:
                place = k
            elif stack[k] in H._SCOPE:
                break
        if place:
            del stack[place:]
        depths.append((tag, len(stack)))
        if tag not in H._VOID:
            stack.append(tag)
    return depths


def test_open_elements_equal_a_walk():
    rng = random.Random(9)
    tags = "div p li ul table tr td th span b dl dt dd option select section h2 br body".split()
    for _ in range(400):
        page = "".join(f"<{'/' if rng.random() < 0.4 else ''}{rng.choice(tags)}>" for _ in range(rng.randrange(60)))
        got = []
        todo = [(H.parse(page), 0)]
        while todo:
            node, depth = todo.pop()
            if node.tag != "#root":
                got.append((node.tag, depth))
            todo += [(x, depth + 1) for x in reversed(node.parts) if type(x) is H.Node]
        assert got == slow_parents(page), page
