"""Main text of web pages: a bidirectional LSTM in numpy reads a page's leaf blocks in order and labels each.

A page is cut into blocks, runs of text without a block-level tag between them. A block's input is the sum of hashed vectors of its
tag path (tags, and words of class, id and role), the mean of hashed vectors of its words, and four plain measures. Both directions of the LSTM see
the whole page, so a block is judged in its context. Blocks labelled as main text are joined by line feeds.

The network is trained here on pages that ``sample_page`` writes, with labels known from their making: articles in several
layouts, among menus, headers, sidebars, notices, adverts, forms, comments and footers. Its words are made up, so that it learns
structure and tell-tale words. Nothing is learned from the input, so the model is the same for every table.

Scripts, styles, markup comments and the head hold no blocks. Inline tags don't cut a block; nor does a line break, which is white space.

Edge cases: null, empty and block-less pages have an empty text; unclosed tags run to the next block, unclosed comments, scripts and styles
to the page's end; a head without an end tag ends at what can't be in one;
repeated rows get a row each; an empty table gives no rows. Nothing is capped, however long a page is. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loam.llm import common

PATH_SLOTS, WORD_SLOTS, DIM, HIDDEN, PLAIN = 2048, 2048, 12, 8, 4
PAGES, EPOCHS = 2500, 8
#: By which word vectors shrink each step: what a few pages have taught of a word, or of others in its slot, fades, so that a single word decides little.
DECAY = 0.01

# fixed values: HTML's block-level elements, elements without an end, and those whose content isn't text
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Raw text runs to its own end tag or the page's end; the others, if they have no end tag, to the next block-level tag.
RAW_TAGS, FLAT_TAGS, DEEP_TAGS = "script|style", "noscript|iframe|title", "template|svg"
#: What a head may hold; any other start tag, or text, ends one that isn't closed.
HEAD_TAGS = frozenset("head html base basefont bgsound link meta".split())
#: A start tag of these ends an open one of the same kind, or of those named.
IMPLIED = {"p": {"p"}, "li": {"li", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
ENDS_P = BLOCK_TAGS - {"button", "caption", "html", "body", "li", "option", "td", "th", "tr", "tbody", "thead", "tfoot"}
_TO_BLOCK = rf".*?(?=</?(?:{'|'.join(sorted(BLOCK_TAGS))})\b|\Z)"
#: To the element's end tag, over whole elements of its kind inside it.
_NESTED = r"(?:(?!</?\3\b).)*+(?:<\3\b(?:(?!</?\3\b).)*+</\3\s*+>(?:(?!</?\3\b).)*+)*+</\3\s*+>"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW_TAGS})\b[^>]*+>.*?(?:</\1\s*>|\Z)|<({FLAT_TAGS})\b[^>]*+>(?:(?:(?!<\2\b).)*?</\2\s*>|{_TO_BLOCK})|<svg\b[^>]*+(?<=/)>|<({DEEP_TAGS})\b[^>]*+>(?:{_NESTED}|{_TO_BLOCK})"
    r"|<[!?][^>]*+>|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs2>[^>]*+)>",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")
_SPLIT = re.compile(r"[^\W_]+")


class Block:
    __slots__ = ("label", "linked", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], linked: int):
        self.text, self.path, self.linked, self.label = text, path, linked, 0


def blocks(page: str | None) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked, link, head = 0, 0, False

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(text, tuple(k for _, ks in stack for k in ks), linked))
            held.clear()
        linked = 0

    def put(raw: str) -> None:
        nonlocal linked, head
        head = head and not raw.strip()
        if raw and not head:
            raw = html.unescape(raw) if "&" in raw else raw
            held.append(raw)
            if link:
                linked += len(raw)

    last = 0
    page = page or ""
    for m in _TOKEN.finditer(page):
        put(page[last : m.start()])
        last = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        closing, attrs = (m["end"], m["attrs"]) if m["name"] else (m["end2"], m["attrs2"])
        if name == "head":
            head = not closing
        elif not closing and name not in HEAD_TAGS:
            head = False
        if name not in BLOCK_TAGS:
            if name == "a":
                link = 0 if closing else 1
            elif name == "br":
                held.append(" ")
            continue
        flush()
        link = 0
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        ends = IMPLIED.get(name, {"p"} if name in ENDS_P else ())
        while stack and stack[-1][0] in ends:
            stack.pop()
        if name not in VOID_TAGS:
            keys = [name]
            for a in _ATTR.finditer(attrs or ""):
                keys += [f".{w.lower()}" for w in _NAME.findall(a[2] or a[3] or a[4] or "")]
            stack.append((name, tuple(keys)))
    put(page[last:])
    flush()
    return out


# the network's inputs


def _slot(x: str, n: int) -> int:
    return zlib.crc32(x.encode()) % n


_path_slots: dict[str, int] = {}


class Pages:
    """Blocks of pages, padded to steps x pages, with their hashed inputs."""

    def __init__(self, pages: list[list[Block]]):
        self.n = max(map(len, pages), default=0)
        flat = [b for p in pages for b in p]
        at = [(t, k) for k, p in enumerate(pages) for t in range(len(p))]
        self.t, self.k = (np.array(x, np.int64) for x in zip(*at, strict=True)) if at else (np.zeros(0, np.int64),) * 2
        self.width = len(pages)
        self.mask = np.zeros((self.n, self.width), bool)
        self.mask[self.t, self.k] = True
        paths, words = [], []
        for b in flat:
            keys = [*b.path, f"last:{b.path[-1] if b.path else ''}"]
            for x in keys:
                if x not in _path_slots:
                    if len(_path_slots) > 50_000:
                        _path_slots.clear()
                    _path_slots[x] = _slot(x, PATH_SLOTS)
            paths.append([_path_slots[x] for x in keys])
            words.append(_SPLIT.findall(b.text.lower()) or [""])
        self.path_len = np.fromiter(map(len, paths), np.int64, len(flat))
        self.path = np.array([s for p in paths for s in p], np.int64)
        names = [w for x in words for w in x]
        known = {w: _slot(w, WORD_SLOTS) for w in set(names)}
        self.word_len = np.fromiter(map(len, words), np.int64, len(flat))
        self.word = np.fromiter(map(known.__getitem__, names), np.int64, len(names))
        chars = np.array([len(b.text) for b in flat], np.float64)
        self.plain = np.stack([
            np.log1p(self.word_len) / 3, np.array([b.linked for b in flat]) / np.maximum(chars, 1),
            np.array([b.text[-1:] in ".!?…\"'”" for b in flat], float), np.minimum(self.path_len / 10, 2),
        ], 1).astype(np.float32) if flat else np.zeros((0, PLAIN), np.float32)
        self.label = np.array([b.label for b in flat], np.float32)

    def inputs(self, m: dict) -> np.ndarray:
        x = np.zeros((self.n, self.width, 2 * DIM + PLAIN), np.float32)
        if len(self.t):
            p = np.add.reduceat(m["path"][self.path], np.cumsum(self.path_len) - self.path_len, axis=0)
            w = np.add.reduceat(m["word"][self.word], np.cumsum(self.word_len) - self.word_len, axis=0) / self.word_len[:, None]
            x[self.t, self.k] = np.concatenate([p, w, self.plain], 1)
        return x


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(x: np.ndarray, mask: np.ndarray, m: dict, d: str, keep: bool):
    gx = x @ m[f"x{d}"] + m[f"b{d}"]
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    c, H = h, HIDDEN
    hs, cache = np.empty((*x.shape[:2], H), np.float32), []
    for t in range(len(x)):
        a = gx[t] + h @ m[f"h{d}"]
        ifo, g = _sig(a[:, : 3 * H]), np.tanh(a[:, 3 * H :])
        i, f, o = ifo[:, :H], ifo[:, H : 2 * H], ifo[:, 2 * H :]
        new = f * c + i * g
        tc = np.tanh(new)
        on = mask[t][:, None]
        if keep:
            cache.append((h, c, i, f, o, g, tc))
        h, c = np.where(on, o * tc, h), np.where(on, new, c)
        hs[t] = h
    return hs, cache


def logits(m: dict, pages: Pages, keep: bool = False):
    x = pages.inputs(m)
    f, cf = _lstm(x, pages.mask, m, "f", keep)
    b, cb = _lstm(x[::-1], pages.mask[::-1], m, "b", keep)
    hs = np.concatenate([f, b[::-1], x], 2)
    return (hs @ m["out"] + m["bias"])[pages.t, pages.k], (x, hs, {"f": cf, "b": cb})


def gradients(m: dict, pages: Pages) -> tuple[float, dict]:
    z, (x, hs, caches) = logits(m, pages, True)
    H, n = HIDDEN, len(z)
    dz = (_sig(z) - pages.label) / n
    loss = float((np.logaddexp(0, z) - pages.label * z).mean())
    dhs = np.zeros_like(hs)
    dhs[pages.t, pages.k] = dz[:, None] * m["out"]
    g = {"out": hs[pages.t, pages.k].T @ dz, "bias": np.array([dz.sum()], np.float32)}
    dx = dhs[:, :, 2 * H :].copy()
    for d in "fb":
        part, xs, mask = (dhs[:, :, :H], x, pages.mask) if d == "f" else (dhs[::-1, :, H : 2 * H], x[::-1], pages.mask[::-1])
        wh = m[f"h{d}"]
        da = np.zeros((*part.shape[:2], 4 * H), np.float32)
        dh, dc, dwh = np.zeros_like(part[0]), np.zeros_like(part[0]), np.zeros_like(wh)
        for t in range(len(part) - 1, -1, -1):
            h, c, i, f, o, gg, tc = caches[d][t]
            on = mask[t][:, None]
            total = dh + part[t]
            live = total * on
            dcell = dc * on + live * o * (1 - tc * tc)
            da[t] = np.concatenate([dcell * gg * i * (1 - i), dcell * c * f * (1 - f), live * tc * o * (1 - o), dcell * i * (1 - gg * gg)], 1)
            dwh += h.T @ da[t]
            dh = np.where(on, da[t] @ wh.T, total)
            dc = np.where(on, dcell * f, dc)
        g[f"h{d}"] = dwh
        g[f"x{d}"] = np.einsum("tnx,tna->xa", xs, da)
        g[f"b{d}"] = da.sum(axis=(0, 1))
        back = da @ m[f"x{d}"].T
        dx += back if d == "f" else back[::-1]
    own = dx[pages.t, pages.k]
    for name, slots, lens, part in (("path", pages.path, pages.path_len, own[:, :DIM]), ("word", pages.word, pages.word_len, own[:, DIM : 2 * DIM] / pages.word_len[:, None])):
        g[name] = np.zeros_like(m[name])
        np.add.at(g[name], slots, np.repeat(part, lens, axis=0))
    return loss, g


# pages to learn from

_BODY = ["article", "main", "section", "div.content", "div.post body", "div.entry content", "div.article text", "div#main content", "div.story", "td.content", "div", "div#article", "div.post", "div.text", "div.page"]
#: How an article's paragraphs are written: in p; in div, plain or named; as lines between br, in spans or not; in sections; in dd, blockquote or li.
_FORMS = ["p"] * 10 + ["div"] * 4 + ["named"] * 4 + ["lines"] * 4 + ["section", "dl", "quote", "list", "mixed"]
_PARAS = ["div.para", "div.paragraph", "div.text", "div.p", "div.block", "div.line", "div.copy", "p.para", "p.text"]
_TELL = {
    "nav": "home about contact login menu search news sports products categories next previous".split(),
    "footer": "copyright rights reserved privacy terms imprint contact sitemap all".split(),
    "ad": "sponsored advertisement buy now offer sale discount click".split(),
    "notice": "cookies accept consent we use agree settings subscribe newsletter".split(),
    "comment": "reply posted said ago comments likes report great thanks".split(),
    "form": "email name submit search password sign up send".split(),
    "side": "related popular recent posts tags archives trending more".split(),
}


class _Writer:
    def __init__(self, r: random.Random):
        self.r, self.vocab = r, ["".join(r.choice("bcdfghklmnprstvz") + r.choice("aeiouy") for _ in range(r.randint(1, 4))) for _ in range(400)]
        self.parts: list[tuple[str, int | None]] = []
        # how this page's text is written: plainly, shouted, with signs, or with no ends of sentences
        self.style = r.choice(["", "", "", "shout", "signs", "bare"])

    def words(self, lo: int, hi: int, tell: str = "") -> str:
        w = [self.r.choice(self.vocab) for _ in range(self.r.randint(lo, hi))]
        if tell and self.r.random() < 0.7:
            for _ in range(self.r.randint(1, 4)):
                w.insert(self.r.randint(0, len(w)), self.r.choice(_TELL[tell]))
        return " ".join(w)

    def sentence(self, tell: str = "") -> str:
        lo, hi, n = self.r.choice([(1, 3, 1), (1, 14, 5), (1, 14, 5), (4, 30, 8)])
        x = ". ".join(self.words(lo, hi, tell).capitalize() for _ in range(self.r.randint(1, n))) + "."
        if self.style == "shout":
            return " ".join(f"{w}!!" for w in x.upper().split())
        if self.style == "signs":
            return " ".join(w + self.r.choice(["%%%", "***", "&&&", "$$$", "###"]) for w in x.split())
        return x[:-1] if self.style == "bare" else x

    def open(self, spec: str) -> str:
        tag, _, rest = re.match(r"(\w+)([.#]?)(.*)", spec).groups()
        kind = "id" if "#" in spec else "class"
        self.raw(f'<{tag} {kind}="{rest.replace(" ", self.r.choice("-_ "))}">' if rest else f"<{tag}>")
        return f"</{tag}>"

    def raw(self, x: str) -> None:
        self.parts.append((x, None))

    def leaf(self, tag: str, text: str, label: int, link: bool = False) -> None:
        inner = f'<a href="/x">{html.escape(text)}</a>' if link else html.escape(text)
        self.parts.append((f"<{tag}>{inner}</{tag}>", label))

    def bare(self, text: str, label: int) -> None:
        self.parts.append((html.escape(text), label))

    def menu(self, spec: str, tell: str) -> None:
        end = self.open(spec)
        if self.r.random() < 0.7:
            self.raw("<ul>")
            for _ in range(self.r.randint(2, 9)):
                self.leaf("li", self.words(1, 3, tell), 0, True)
            self.raw("</ul>")
        else:
            for _ in range(self.r.randint(2, 6)):
                self.leaf(self.r.choice(["div", "p"]), self.words(1, 3, tell), 0, True)
        self.raw(end)

    def junk(self, spec: str, tell: str) -> None:
        end = self.open(spec)
        if self.r.random() < 0.4:
            self.bare(self.sentence(tell), 0)
        else:
            for _ in range(self.r.randint(1, 4)):
                self.leaf(self.r.choice(["p", "p", "div", "h3", "li"]), self.sentence(tell) if self.r.random() < 0.6 else self.words(1, 6, tell), 0, self.r.random() < 0.3)
        self.raw(end)

    def para(self, form: str, text: str) -> None:
        """A paragraph of an article."""
        r = self.r
        form = r.choice(_FORMS) if form == "mixed" else form
        if form == "named":
            end = self.open(r.choice(_PARAS) if r.random() < 0.7 else f"div.{r.choice(self.vocab)}")
            self.bare(text, 1)
            self.raw(end)
        elif form == "section":
            self.raw("<section>")
            self.leaf(r.choice(["p", "div"]), text, 1)
            self.raw("</section>")
        elif form == "dl":
            self.raw("<dl>")
            if r.random() < 0.6:
                self.leaf("dt", self.words(1, 5), 1)
            self.leaf("dd", text, 1)
            self.raw("</dl>")
        elif form == "list":
            end = self.open(r.choice(["ol", "ul"]))
            for _ in range(r.randint(1, 6)):
                self.leaf("li", self.sentence(), 1)
            self.raw(end)
        elif form == "quote":
            self.raw("<blockquote>" * r.randint(1, 2))
            self.leaf(r.choice(["p", "blockquote", "div"]), text, 1)
            self.raw("</blockquote>" * 2)
        else:
            self.leaf(form if form == "div" else "p", text, 1)

    def lines(self) -> None:
        """Paragraphs with breaks between them: one block."""
        r = self.r
        span, gap = r.random() < 0.5, r.choice(["<br>", "<br><br>", "<br/>\n<br/>"])
        one = [html.escape(self.sentence()) for _ in range(r.randint(1, 8))]
        self.parts.append((gap.join(f"<span>{x}</span>" if span else x for x in one), 1))

    def article(self, inside: bool, body: str = "") -> None:
        r = self.r
        body = body or r.choice(_BODY[:3] if r.random() < 0.4 else _BODY)
        end = self.open(f"div.{r.choice(self.vocab)}" if r.random() < 0.08 else body) if body == "td" or r.random() < 0.95 else ""
        form = r.choice(_FORMS)
        if r.random() < 0.85:
            self.leaf(r.choice(["h1", "h1", "h2"]), self.words(1, 10) + r.choice(["", "."]), 1)
        for _ in range(r.randint(1, 16)):
            x = r.random()
            if x < 0.72:
                if form == "lines":
                    self.lines()
                    self.leaf("h3", self.words(1, 6), 1)
                else:
                    self.para(form, self.sentence() if r.random() < 0.85 else self.words(1, 4))
            elif x < 0.80:
                self.leaf(r.choice(["h2", "h3"]), self.words(1, 6), 1)
            elif x < 0.86:
                end = self.open(r.choice(["ul", "ol"]))
                for _ in range(r.randint(1, 5)):
                    self.leaf("li", self.words(1, 12) if r.random() < 0.6 else self.sentence(), 1)
                self.raw(end)
            elif x < 0.90:
                self.leaf(r.choice(["blockquote", "pre", "figcaption"]), self.sentence(), 1)
            elif inside:
                self.junk(r.choice(["aside", "div.ad", "aside.related", "div.advert", "div.promo", "div.share", "form.newsletter", "nav.toc", "div.banner", "div.related"]), r.choice(["ad", "side", "form", "nav"]))
        if form == "lines":
            self.raw("<hr>")
            self.lines()
        if inside and r.random() < 0.3:
            self.junk(r.choice(["section.comments", "div#comments", "div.comment list", "footer"]), "comment")
        self.raw(end)

    def table(self) -> None:
        """An article in a cell, with menus and side boxes in others."""
        r = self.r
        self.raw("<table><tr>")
        if r.random() < 0.7:
            self.menu(r.choice(["td", "td.nav", "td.menu", "td.left"]), r.choice(["nav", "side"]))
        self.article(r.random() < 0.3, "td")
        if r.random() < 0.5:
            self.junk(r.choice(["td.sidebar", "td.right", "td.ad"]), "side")
        self.raw("</tr></table>")


def sample_page(seed: int) -> tuple[str, list[int]]:
    """A page and the label of each of its blocks."""
    r = random.Random(seed)
    w = _Writer(r)
    if r.random() < 0.02:  # text without a tag
        w.bare(" ".join(w.sentence() for _ in range(r.randint(1, 12))), 1)
        return w.parts[0][0], [1]
    w.raw("<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>")
    some = lambda p, f, specs, tell: r.random() < p and f(r.choice(specs), tell)
    some(0.5, w.junk, ["header", "div.header", "div#top", "header.site", "div.masthead"], "nav")
    some(0.8, w.menu, ["nav", "nav.main", "div.menu", "div#navigation", "ul.navbar", "div.breadcrumbs"], "nav")
    some(0.4, w.junk, ["div.ad", "div.ads", "div.advertisement", "aside.ad", "div.banner", "div.sponsor"], "ad")
    some(0.3, w.junk, ["div.cookie notice", "div#cookies", "div.notice", "dialog.consent", "div.alert"], "notice")
    left = r.random() < 0.3
    if left:
        w.menu(r.choice(["aside", "div.sidebar", "div#sidebar", "aside.widget"]), "side")
    wrap = w.open(r.choice(["div.wrapper", "div#page", "main", "div"])) if r.random() < 0.4 else ""
    w.table() if r.random() < 0.08 else w.article(r.random() < 0.4)
    w.raw(wrap)
    some(0.35, w.junk, ["aside", "div.sidebar", "aside.related", "div.widget", "div#secondary"], "side")
    some(0.3, w.junk, ["form", "form.search", "div.subscribe", "form#newsletter", "div.signup"], "form")
    some(0.35, w.junk, ["section.comments", "div#comments", "div.comment", "ol.comment list", "div.responses"], "comment")
    some(0.2, w.junk, ["div.ad", "div.promo", "div.sponsored"], "ad")
    some(0.9, w.junk, ["footer", "div.footer", "div#footer", "footer.site", "div.copyright"], "footer")
    w.raw("</body></html>")
    return "".join(x for x, _ in w.parts), [k for _, k in w.parts if k is not None]


def _sample(seed: int) -> list[Block]:
    page, labels = sample_page(seed)
    bs = blocks(page)
    if len(bs) != len(labels):
        return []
    for b, k in zip(bs, labels, strict=True):
        b.label = k
    return bs


@cache
def model(pages: int = PAGES, epochs: int = EPOCHS) -> dict:
    r = np.random.default_rng(3)
    g = lambda *s, k=0.25: (r.standard_normal(s) * k).astype(np.float32)
    m = {"path": g(PATH_SLOTS, DIM), "word": g(WORD_SLOTS, DIM, k=0.05), "out": g(2 * HIDDEN + 2 * DIM + PLAIN), "bias": g(1)}
    for d in "fb":
        m |= {f"x{d}": g(2 * DIM + PLAIN, 4 * HIDDEN), f"h{d}": g(HIDDEN, 4 * HIDDEN), f"b{d}": g(4 * HIDDEN, k=0.0)}
    data = [b for s in range(pages) if (b := _sample(s))]
    data.sort(key=len)
    batches = [Pages(data[i : i + 24]) for i in range(0, len(data), 24)]
    a, b = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / (epochs + 1))
        for i in r.permutation(len(batches)):
            _, grad = gradients(m, batches[i])
            step += 1
            for k, v in grad.items():
                a[k] = 0.9 * a[k] + 0.1 * v
                b[k] = 0.99 * b[k] + 0.01 * v * v
                m[k] = (m[k] - np.float32(rate) * (a[k] / (1 - 0.9**step)) / (np.sqrt(b[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            m["word"] *= np.float32(1 - DECAY)
    return m


def label(m: dict, pages: list[list[Block]]) -> None:
    """Sets the blocks' labels. Pages of like length go together, few at once where they are long."""
    order = sorted((p for p in pages if p), key=len)
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and hi - lo < 512 and len(order[hi]) * (hi - lo + 1) < 20_000:
            hi += 1
        some = order[lo:hi]
        z, _ = logits(m, Pages(some))
        for b, v in zip((b for p in some for b in p), z.tolist(), strict=True):
            b.label = int(v > 0)
        lo = hi


def main_text(bs: list[Block]) -> str:
    return "\n".join(b.text for b in bs if b.label)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks."""
    m = model()

    def run(batches):
        for b in batches:
            got = [blocks(h) for h in b.column("html").to_pylist()]
            label(m, got)
            texts = [main_text(x) for x in got]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(x) for x in got], pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_blocks"],
            )

    common.python_ready(pages.sparkSession)
    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long")


def op10_extraction(pages: DataFrame) -> DataFrame:
    return extract(pages)
