"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's vector is the sum of a hashed word vector and the mean of its hashed character trigrams' vectors, so spellings near a known
word are near it. Windows of WINDOW words, each overlapping the next by half, are read in both directions and pooled by
attention; a document's score is its highest window's, calibrated on the training documents.

Training is by document labels alone: of a toxic document the windows that the model finds most toxic are its positive
examples (at first those with the words most over-represented in toxic documents), of others random windows and the
highest ones. It uses at most TRAIN_DOCS labelled documents (a documented bound, the least of a hash), none of them held out. Every
window that starts at a STRIDE-th word of a whole text is scored, so every word of it is in one; distinct words of a batch are embedded once, and windows advance in step.

Edge cases: null and empty texts have one empty window and a low score; repeated rows get a score each; conflicting
labels of an id each count; documents of equal scores are equal in ``predicted``, and windows of equal logits are interchangeable; a text of any length is
scored whole, windows few at once; a null id isn't held out and has no label; other columns, whatever their names, are not read; without labels of both kinds every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import common

WINDOW, STRIDE = 32, 16
HIDDEN, DIM, ATT = 8, 16, 8
WORD_SLOTS, CHAR_SLOTS = 1 << 14, 1 << 13
#: Labelled documents that training uses, at most.
TRAIN_DOCS = 6000
EPOCHS = 7
#: Windows of documents that aren't toxic, an epoch, at least; and the part of words hidden from the network in training.
LEAST_NEGATIVES = 4000
HIDDEN_WORDS = 0.1
HELD_FOLDS, HELD_FOLD = 3, 1
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Lexicon:
    """Word slots and character slots of distinct words."""

    def __init__(self, words: list[str]):
        raw = [w.encode() for w in words]
        self.slot = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) % WORD_SLOTS
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b" " + b" ".join(raw) + b"  ", np.uint8).astype(np.int64)
        gram = (flat[:-2] * 0x01000193 + flat[1:-1] * 0x9E3779B1 + flat[2:] * 0x85EBCA77) & 0xFFFFFFFF
        gram = (gram ^ (gram >> 15)) % CHAR_SLOTS
        # the trigram around each byte of each word
        starts = np.cumsum(lens + 1) - lens - 1
        keep = np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
        self.gram, self.lens = gram[keep], lens
        self.first = np.cumsum(lens) - lens

    def vectors(self, m: dict) -> np.ndarray:
        out = m["word"][self.slot]
        if len(self.gram):
            for lo in range(0, len(self.lens), 50_000):
                hi = min(lo + 50_000, len(self.lens))
                a, b = self.first[lo], self.first[hi - 1] + self.lens[hi - 1]
                out[lo:hi] += np.add.reduceat(m["char"][self.gram[a:b]], self.first[lo:hi] - a, axis=0) / self.lens[lo:hi, None]
        return out


def windows(lens: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of each document's windows on the words laid end to end, and each window's document."""
    n = np.array(lens, np.int64)
    k = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(n)), k)
    i = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
    start = i * STRIDE
    return np.stack([start + np.repeat(np.cumsum(n) - n, k), np.minimum(WINDOW, n[doc] - start)], 1), doc


def fresh(seed: int = 7) -> dict:
    r = np.random.default_rng(seed)
    g = lambda *s, k=0.3: (r.standard_normal(s) * k).astype(np.float32)
    m = {"word": g(WORD_SLOTS, DIM), "char": g(CHAR_SLOTS, DIM), "wa": g(2 * HIDDEN, ATT), "ba": g(ATT) * 0, "va": g(ATT), "wo": g(2 * HIDDEN), "bo": np.float32([-2.0])}
    for d in "fb":
        m |= {f"x{d}": g(DIM, 3 * HIDDEN), f"h{d}": g(HIDDEN, 3 * HIDDEN), f"b{d}": g(3 * HIDDEN) * 0}
    return m


def _gru(gx: np.ndarray, mask: np.ndarray, wh: np.ndarray, keep: bool):
    """gx: steps x rows x 3H, of the words in reading order; mask: steps x rows."""
    h = np.zeros((gx.shape[1], HIDDEN), np.float32)
    hs, cache = np.empty((*gx.shape[:2], HIDDEN), np.float32), []
    H = HIDDEN
    for t in range(len(gx)):
        gh = h @ wh
        zr = sigmoid(gx[t, :, : 2 * H] + gh[:, : 2 * H])
        z, r = zr[:, :H], zr[:, H:]
        n = np.tanh(gx[t, :, 2 * H :] + r * gh[:, 2 * H :])
        new = n + z * (h - n)
        new = np.where(mask[t][:, None], new, h)
        if keep:
            cache.append((h, z, r, n, gh[:, 2 * H :]))
        hs[t] = h = new
    return hs, cache


def forward(m: dict, vec: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows. ids, mask: rows x steps, ids into vec's rows."""
    it, mt = ids.T, mask.T
    got = {}
    for d in "fb":
        proj = vec @ m[f"x{d}"] + m[f"b{d}"]
        order = it if d == "f" else it[::-1]
        got[d] = _gru(proj[order], mt if d == "f" else mt[::-1], m[f"h{d}"], keep)
    hs = np.concatenate([got["f"][0], got["b"][0][::-1]], axis=2)
    u = np.tanh(hs @ m["wa"] + m["ba"])
    e = np.where(mt, u @ m["va"], -30.0)
    p = np.exp(e - e.max(axis=0))
    p /= p.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", p, hs)
    return pooled @ m["wo"] + m["bo"][0], (got, hs, u, p, pooled)


def gradients(m: dict, lex: Lexicon, vec: np.ndarray, ids: np.ndarray, mask: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict:
    logit, (got, hs, u, p, pooled) = forward(m, vec, ids, mask, True)
    H, mt = HIDDEN, mask.T
    dl = ((sigmoid(logit) - y) * w / len(y)).astype(np.float32)
    g = {"wo": pooled.T @ dl, "bo": np.float32([dl.sum()])}
    dpool = dl[:, None] * m["wo"]
    dhs = p[:, :, None] * dpool
    dp = np.einsum("tnh,nh->tn", hs, dpool)
    de = p * (dp - (p * dp).sum(axis=0)) * mt
    du = de[:, :, None] * m["va"] * (1 - u * u)
    g["va"] = np.einsum("tn,tna->a", de, u)
    g["wa"] = np.einsum("tnh,tna->ha", hs, du)
    g["ba"] = du.sum(axis=(0, 1))
    dhs += du @ m["wa"].T
    dvec = np.zeros_like(vec)
    for d in "fb":
        part = dhs[:, :, :H] if d == "f" else dhs[::-1, :, H:]
        order, mk = (ids.T, mt) if d == "f" else (ids.T[::-1], mt[::-1])
        wh, dwh, dh = m[f"h{d}"], np.zeros_like(m[f"h{d}"]), np.zeros_like(part[0])
        dgx = np.zeros((*part.shape[:2], 3 * H), np.float32)
        for t in range(len(part) - 1, -1, -1):
            h, z, r, n, ghn = got[d][1][t]
            total = dh + part[t]
            live = total * mk[t][:, None]
            dz, dn = live * (h - n) * z * (1 - z), live * (1 - z) * (1 - n * n)
            dr = dn * ghn * r * (1 - r)
            dgx[t] = np.concatenate([dz, dr, dn], 1)
            dgh = np.concatenate([dz, dr, dn * r], 1)
            dwh += h.T @ dgh
            dh = np.where(mk[t][:, None], live * z + dgh @ wh.T, total)
        g[f"h{d}"] = dwh
        flat = dgx.reshape(-1, 3 * H)
        dproj = np.zeros((len(vec), 3 * H), np.float32)
        np.add.at(dproj, order.reshape(-1), flat)
        g[f"x{d}"], g[f"b{d}"] = vec.T @ dproj, dproj.sum(axis=0)
        dvec += dproj @ m[f"x{d}"].T
    dvec[(vec == 0).all(axis=1)] = 0  # hidden words
    g["word"] = np.zeros_like(m["word"])
    np.add.at(g["word"], lex.slot, dvec)
    g["char"] = np.zeros_like(m["char"])
    np.add.at(g["char"], lex.gram, np.repeat(dvec / np.maximum(lex.lens, 1)[:, None], lex.lens, axis=0))
    return g


class Words:
    """Texts as ids of their distinct words; id 0 is no word."""

    def __init__(self, texts: list[str | None]):
        toks = [tokens(t) for t in texts]
        flat = [w for t in toks for w in t]
        kinds = {w: i + 1 for i, w in enumerate(dict.fromkeys(flat))}
        self.lex = Lexicon(["", *kinds][1:] or ["-"])
        self.names = list(kinds)
        self.ids = np.fromiter(map(kinds.__getitem__, flat), np.int64, len(flat))
        self.lens = [len(t) for t in toks]
        self.win, self.doc = windows(self.lens)

    def vectors(self, m: dict) -> np.ndarray:
        v = self.lex.vectors(m)
        return np.concatenate([np.zeros((1, v.shape[1]), v.dtype), v])

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.win[which]
        step = np.arange(WINDOW)
        mask = step < w[:, 1:2]
        at = np.minimum(w[:, :1] + step, max(0, len(self.ids) - 1))
        ids = np.where(mask, self.ids[at], 0) if len(self.ids) else np.zeros(mask.shape, np.int64)
        return ids, mask


def window_logits(m: dict, x: Words, size: int = 4096) -> np.ndarray:
    """Of every window; equal words are embedded once."""
    proj = x.vectors(m)
    out = np.empty(len(x.win), np.float32)
    for lo in range(0, len(out), size):
        which = np.arange(lo, min(lo + size, len(out)))
        ids, mask = x.rows(which)
        kinds, local = np.unique(ids, return_inverse=True)
        out[which] = forward(m, proj[kinds], local.reshape(ids.shape), mask)[0]
    return out


def document_logits(m: dict, texts: list[str | None]) -> np.ndarray:
    x = Words(texts)
    out = np.full(len(texts), -np.inf)
    np.maximum.at(out, x.doc, window_logits(m, x))
    return out


def train(texts: list[str | None], toxic: list[int], epochs: int = EPOCHS, seed: int = 7) -> dict | None:
    y = np.array(toxic, bool)
    if y.all() or not y.any():
        return None
    r = np.random.default_rng(seed)
    x, m = Words(texts), fresh(seed)
    bounds = np.searchsorted(x.doc, np.arange(len(texts) + 1))
    # a first guess of where a toxic document is so
    ends = np.cumsum(x.lens)
    pos, neg = Counter(), Counter()
    for k, (lo, hi) in enumerate(zip(ends - x.lens, ends, strict=True)):
        (pos if y[k] else neg).update(set(x.ids[lo:hi].tolist()))
    odds = np.zeros(len(x.names) + 1, np.float32)
    for w, c in pos.items():
        if c >= max(3, 0.03 * y.sum()):
            odds[w] = np.log((c + 0.5) / (y.sum() + 1)) - np.log((neg[w] + 0.5) / ((~y).sum() + 1)) + 0.5 * np.log(c)
    guess = np.empty(len(x.win), np.float32)
    for lo in range(0, len(guess), 8192):
        which = np.arange(lo, min(lo + 8192, len(guess)))
        guess[which] = odds[x.rows(which)[0]].max(axis=1)
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    step, draws = 0, max(2, LEAST_NEGATIVES // int((~y).sum()))
    for epoch in range(epochs):
        score = guess if epoch < 3 else window_logits(m, x)
        picked, label = [], []
        for k in range(len(texts)):
            lo, hi = bounds[k], bounds[k + 1]
            best = lo + int(score[lo:hi].argmax())
            if y[k]:
                strong = score[best] > (3.0 if epoch < 3 else -1.0)
                if strong:
                    near = lo + np.flatnonzero(score[lo:hi] > (3.0 if epoch < 3 else 0.0))
                    some = [best, *near[:4].tolist()]
                    picked += some
                    label += [1] * len(some)
            else:
                some = [best, *r.integers(lo, hi, draws).tolist()]
                picked += some
                label += [0] * len(some)
        picked_, label_ = np.array(picked), np.array(label, np.float32)
        heavy = np.where(label_ > 0, max(1.0, min(16.0, (label_ == 0).sum() / max(1, (label_ > 0).sum()))), 1.0).astype(np.float32)
        order = r.permutation(len(picked_))
        for at in range(0, len(order), 256):
            some = order[at : at + 256]
            ids, mask = x.rows(picked_[some])
            ids = np.where(r.random(ids.shape) < HIDDEN_WORDS, 0, ids)
            kinds, local = np.unique(ids, return_inverse=True)
            lex = Lexicon([x.names[k - 1] if k else "-" for k in kinds.tolist()])
            vec = lex.vectors(m)
            vec[kinds == 0] = 0
            g = gradients(m, lex, vec, local.reshape(ids.shape), mask, label_[some], heavy[some])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            step += 1
            for k, v in g.items():
                v = v * min(1.0, 5.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                m[k] = m[k] - np.float32(0.01) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-6)
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, x.doc, window_logits(m, x))
    m["cal"] = np.float64(calibrate(top, y))
    return m


def calibrate(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (of a few) and shift of a logistic fit of the labels by the documents' logits."""
    x = np.clip(logit, -20, 20)
    best = (np.inf, 1.0, 0.0)
    for a in (0.25, 0.5, 1.0, 2.0, 4.0):
        b = 0.0
        for _ in range(60):
            p = sigmoid(a * x + b)
            b -= float(np.clip(((p - y).sum() + 0.01 * b) / ((p * (1 - p)).sum() + 0.01), -2, 2))
        p = np.clip(sigmoid(a * x + b), 1e-9, 1 - 1e-9)
        loss = float(-np.where(y, np.log(p), np.log(1 - p)).sum())
        best = min(best, (loss, a, b))
    return best[1], best[2]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_FOLDS == HELD_FOLD, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> dict | None:
    """From the ``limit`` labelled documents of least hash that aren't held out; the driver holds only those."""
    some = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(limit)  # bounded, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").orderBy(F.xxhash64("doc_id", "text")).limit(limit).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return train([r["text"] for r in rows], [r["toxic"] for r in rows]) if rows else None


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score."""

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            if model is None:
                s = np.zeros(len(texts))
            else:
                a, c = model["cal"]
                s = np.empty(len(texts))
                lo = 0
                while lo < len(texts):  # about 2 million characters at once
                    hi, size = lo, 0
                    while hi < len(texts) and (hi == lo or size < 2_000_000):
                        size += len(texts[hi] or "")
                        hi += 1
                    s[lo:hi] = sigmoid(a * np.clip(document_logits(model, texts[lo:hi]), -20, 20) + c)
                    lo = hi
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    common.python_ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op2_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    got = score(docs, fit(docs, labels))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
