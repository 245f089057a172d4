"""Articles in layouts written by hand: every paragraph stays, no junk does; and menus of any words go."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

import layouts

from loam.llm import extraction

NAMES = [x[0] for x in layouts.layouts()]


def read(pages):
    got = [extraction.blocks(p) for p in pages]
    extraction.label(extraction.model(), got)
    return got


@pytest.mark.parametrize("name", NAMES)
def test_layout(name):
    for seed in range(5):
        _, page, keep, junk = next(x for x in layouts.layouts(seed) if x[0] == name)
        (bs,) = read([page])
        text = extraction.main_text(bs)
        assert [k for k in keep if k not in text] == []
        assert set(junk) & set(text.split("\n")) == set()
        if "Canal floods" in page:
            assert "Canal floods after storm" in text


def test_words_alone_decide_nothing():
    """Short blocks of made-up words: their place on the page tells what they are."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzñóéüß") for _ in range(r.randint(1, 9)))
    pages = []
    for k in range(400):
        item = (lambda: f"<li>{word()}</li>") if k % 2 else (lambda: f"<li><a href=x>{word()}</a></li>")
        menu, text = "".join(item() for _ in range(5)), " ".join(word() for _ in range(30))
        pages.append(f"<html><body><nav><ul>{menu}</ul></nav><div class=ad>{word()} {word()}</div><article><h1>{word()}</h1><p>{text}.</p><p>{word()}.</p></article><footer>(c) {word()} {word()}</footer></body></html>")
    wrong = sum([b.label for b in bs] != [0] * 6 + [1] * 3 + [0] for bs in read(pages))
    assert wrong <= 4
