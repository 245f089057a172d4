"""Pages written by hand in layouts of their own: (name, html, paragraphs that must stay, junk that must go)."""

import random

_WORDS = "the river rose after three days of rain and people moved their boats to higher ground while engineers checked every gate along the old canal because nobody trusted the numbers that came from upstream".split()


def _paragraphs(n, seed, lo=35, hi=70):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = [r.choice(_WORDS) for _ in range(r.randint(lo, hi))]
        for k in range(9, len(w) - 4, 13):
            w[k] += "."
        out.append(f"Part {i} " + " ".join(w) + ".")
    return out


MENU = ["Home", "World news", "Sports", "About us", "Contact"]
SIDE = ["Popular this week", "Ten recipes for autumn", "Subscribe to our letter"]
FOOT = ["Copyright 2020 The Gazette. All rights reserved.", "Privacy policy"]
_TOP = "<nav><ul>" + "".join(f'<li><a href="/{i}">{x}</a></li>' for i, x in enumerate(MENU)) + "</ul></nav>"
_SIDE = '<div class="sidebar"><h3>' + SIDE[0] + "</h3>" + "".join(f'<p><a href="/s">{x}</a></p>' for x in SIDE[1:]) + "</div>"
_FOOT = f"<footer><p>{FOOT[0]}</p><p><a href='/p'>{FOOT[1]}</a></p></footer>"
JUNK = [*MENU, *SIDE, *FOOT]


def _page(body, top=_TOP, side=_SIDE, foot=_FOOT):
    return f"<!DOCTYPE html><html><head><title>News</title></head><body>{top}{body}{side}{foot}</body></html>"


def layouts(seed=0):
    p = _paragraphs(8, seed)
    q = _paragraphs(8, seed + 100, 6, 14)
    h = "Canal floods after storm"
    join = lambda f: "".join(f(x) for x in p)
    box = '<div class="related"><h3>Related stories</h3><ul><li><a href="/a">Older storm story</a></li><li><a href="/b">Another tale</a></li></ul></div>'
    extra = ["Related stories", "Older storm story", "Another tale"]
    half = "".join(f"<p>{x}</p>" for x in p[:4]), "".join(f"<p>{x}</p>" for x in p[4:])
    table = f'<table><tr><td class="menu">{"".join(f"<p><a href=/x>{x}</a></p>" for x in MENU)}</td><td><h1>{h}</h1>{join(lambda x: f"<p>{x}</p>")}</td><td class="sidebar">{"".join(f"<p><a href=/y>{x}</a></p>" for x in SIDE)}</td></tr></table>'
    return [
        ("article p", _page(f"<article><h1>{h}</h1>{join(lambda x: f'<p>{x}</p>')}</article>"), p, JUNK),
        ("div in div.content", _page(f'<div class="content"><h1>{h}</h1>{join(lambda x: f"<div>{x}</div>")}</div>'), p, JUNK),
        ("div.para in div#article", _page(f'<div id="article"><h1>{h}</h1>{join(lambda x: f"<div class=para>{x}</div>")}</div>'), p, JUNK),
        ("span and br", _page(f'<div class="post"><h1>{h}</h1>{"<br><br>".join(f"<span>{x}</span>" for x in p)}</div>'), p, JUNK),
        ("text and br", _page(f'<div class="post"><h1>{h}</h1>{"<br><br>".join(p)}</div>'), p, JUNK),
        ("table cells", _page(table, top="", side=""), p, JUNK),
        ("p in a cell", _page(f"<table><tr><td>{join(lambda x: f'<p>{x}</p>')}</td></tr></table>"), p, JUNK),
        ("sections", _page(f"<main><h1>{h}</h1>{join(lambda x: f'<section><p>{x}</p></section>')}</main>"), p, JUNK),
        ("main without p", _page(f"<main><h1>{h}</h1>{join(lambda x: f'<div><div>{x}</div></div>')}</main>"), p, JUNK),
        ("nested blockquotes", _page(f"<article><h1>{h}</h1>{join(lambda x: f'<blockquote><blockquote><p>{x}</p></blockquote></blockquote>')}</article>"), p, JUNK),
        ("definition list", _page(f"<article><h1>{h}</h1><dl>{join(lambda x: f'<dt>{x[:6]}</dt><dd>{x}</dd>')}</dl></article>"), p, JUNK),
        ("related box inside", _page(f"<article><h1>{h}</h1>{half[0]}{box}{half[1]}</article>"), p, JUNK + extra),
        ("bare body", _page(f"<h1>{h}</h1>{join(lambda x: f'<p>{x}</p>')}"), p, JUNK),
        ("unknown class names", _page(f'<div class="zxq"><div class="kk-17"><h1>{h}</h1>{join(lambda x: f"<div class=vv>{x}</div>")}</div></div>'), p, JUNK),
        ("list of long items", _page(f"<article><h1>{h}</h1><ol>{join(lambda x: f'<li>{x}</li>')}</ol></article>"), p, JUNK),
        ("short paragraphs", _page(f"<main><h1>{h}</h1>{''.join(f'<div>{x}</div>' for x in q)}</main>"), q, JUNK),
        ("paragraphs with links", _page(f"<div class=story><h1>{h}</h1>{join(lambda x: '<p>' + x[:60] + '<a href=/z>' + x[60:90] + '</a>' + x[90:] + '</p>')}</div>"), p, JUNK),
        ("text without tags", "\n\n".join(p), p, []),
        ("text in body alone", f"<html><body>{' '.join(p)}</body></html>", p, []),
    ]
