"""Unigram vocabularies: pieces with probabilities, fitted to all ways to cut words into them, and pruned to a size.

Everything runs over the distinct words and their counts (``bpe.word_pieces``), which stay distributed. What is shared is the vocabulary, bounded by
SEEDS pieces.

* Seeds are the substrings of words that occur twice or more, by occurrences times length, and all characters.
* Each task runs forward and backward over the lattice of each of its words and sums the expected count of each piece; Spark adds these up.
  A piece's probability becomes its share of the sum, so the likelihood of the words can't fall from one round to the next.
* After some rounds the pieces that are missed least go: a piece that words' best cuts hold n times, and that would otherwise be cut into others at a
  probability p, costs n (log its own - log p). Characters stay.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Mapping

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators import bpe
from loam.operators.dedup import settled

# tasks get this module's functions with them, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEEDS, ROUNDS, KEEP = 50_000, 2, 0.75
# fixed value: products below this are left to logarithms; they lose no digits above
LEAST = 1e-250
# fixed values: characters of a word up to which it is worked on together with others; a span from i to j is j * SPAN + i, in 16 bits
LONG, SPAN = 200, 256


def seeds(words: DataFrame, size: int, longest: int) -> dict[str, float]:
    """Log-probabilities of the characters and the ``size`` best substrings of ``words`` (p, c)."""

    def cut(batches):
        from collections import Counter

        import pyarrow as pa

        for b in batches:
            n: Counter = Counter()
            for p, c in zip(b.column("p").to_pylist(), b.column("c").to_pylist(), strict=True):
                for i in range(len(p)):
                    for j in range(i + 1, min(len(p), i + longest) + 1):
                        n["".join(p[i:j])] += c
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["piece", "n"])

    found = settled(words.mapInArrow(cut, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")))
    letters = found.filter(F.length("piece") == 1).collect()
    score = F.col("n") * F.length("piece")
    best = found.filter((F.length("piece") > 1) & (F.col("n") > 1)).withColumn("score", score).orderBy(F.desc("score"), "piece").limit(size).collect()
    weight = {r["piece"]: r["n"] for r in letters} | {r["piece"]: r["score"] for r in best}
    total = math.log(sum(weight.values())) if weight else 0.0
    return {k: math.log(v) - total for k, v in weight.items()}


def _lattice(word: str, scores: Mapping[str, float], longest: int):
    """The pieces (start, end, piece, score) that a word can be cut into, by end."""
    n = len(word)
    for j in range(1, n + 1):
        for i in range(max(0, j - longest), j):
            s = scores.get(word[i:j])
            if s is not None:
                yield i, j, word[i:j], s


def best_cut(word: str, scores: Mapping[str, float], longest: int, without: str | None = None) -> tuple[float, list[str]]:
    """The most probable cut of a word, and its log-probability; of equal ones the one with longer pieces last."""
    top: list = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for i, j, piece, s in _lattice(word, scores, longest):
        if piece != without and top[i][0] + s > top[j][0]:
            top[j] = (top[i][0] + s, i)
    out, j = [], len(word)
    if top[j][0] == -math.inf:
        return -math.inf, []
    while j:
        i = top[j][1]
        out.append(word[i:j])
        j = i
    return top[-1][0], out[::-1]


def expected(word: str, scores: Mapping[str, float], longest: int) -> tuple[float, dict[str, float]]:
    """A word's log-probability, over all its cuts, and the expected count of each piece."""
    edges = list(_lattice(word, scores, longest))
    n = len(word)

    def add(a: float, b: float) -> float:
        if a < b:
            a, b = b, a
        return a if b == -math.inf else a + math.log1p(math.exp(b - a))

    ahead, back = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for i, j, _, s in edges:
        ahead[j] = add(ahead[j], ahead[i] + s)
    for i, j, _, s in reversed(edges):
        back[i] = add(back[i], back[j] + s)
    counts: dict[str, float] = {}
    if ahead[n] > -math.inf:
        for i, j, piece, s in edges:
            x = ahead[i] + s + back[j] - ahead[n]
            if x > -50:
                counts[piece] = counts.get(piece, 0.0) + math.exp(x)
    return ahead[n], counts


def expected_fast(word: str, probabilities: Mapping[str, float], longest: int) -> tuple[float, dict[str, float]] | None:
    """What ``expected`` gives, by products of probabilities instead of sums of their logarithms; None where they come near to the least number there is."""
    n, get = len(word), probabilities.get
    ahead, edges = [1.0] + [0.0] * n, []
    for j in range(1, n + 1):
        a = 0.0
        for i in range(max(0, j - longest), j):
            p = get(piece := word[i:j])
            if p is not None:
                a += ahead[i] * p
                edges.append((i, j, piece, p))
        ahead[j] = a
        if a < LEAST:
            return None
    back = [0.0] * n + [1.0 / ahead[n]]
    counts: dict[str, float] = {}
    # by falling ends, so all that starts at an end is there before
    for i, j, piece, p in reversed(edges):
        x = p * back[j]
        back[i] += x
        counts[piece] = counts.get(piece, 0.0) + ahead[i] * x
    return math.log(ahead[n]), counts


def laid(words: DataFrame, pieces: list[str], longest: int) -> DataFrame:
    """``words`` (p, c) to (c, n, spans, ids, w): a word's length and, by its ends, what of ``pieces`` it can be cut into, as j * SPAN + i and their places; of one over LONG characters, itself instead (w)."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def look(batches):
        import pyarrow as pa

        get = {x: k for k, x in enumerate(shared.value)}.get
        for b in batches:
            said = ["".join(p) for p in b.column("p").to_pylist()]
            spans, ids, ends = [], [], [0]
            for w in said:
                if len(w) <= LONG:
                    for j in range(1, len(w) + 1):
                        for i in range(max(0, j - longest), j):
                            if (k := get(w[i:j])) is not None:
                                spans.append(j * SPAN + i)
                                ids.append(k)
                ends.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (spans, ids)]
            alone = [w if len(w) > LONG else None for w in said]
            yield pa.RecordBatch.from_arrays([b.column("c"), pa.array(list(map(len, said)), pa.int32()), *lists, pa.array(alone, pa.string())], names=["c", "n", "spans", "ids", "w"])

    return words.select("p", "c").mapInArrow(look, "c long, n int, spans array<int>, ids array<int>, w string")


def _by_span(spans: np.ndarray, ids: np.ndarray, lens: np.ndarray, logs: np.ndarray):
    """Of all words' pieces that have a probability, in order of their ends, (i, j, words, ids) for each span."""
    rows = np.repeat(np.arange(len(lens)), lens)
    kept = np.flatnonzero(logs[ids] > -np.inf)
    kept = kept[np.argsort(spans[kept].astype(np.uint16), kind="stable")]
    spans, ids, rows = spans[kept], ids[kept], rows[kept]
    cuts = np.flatnonzero(np.diff(spans, prepend=-1, append=-1)).tolist() if len(spans) else [0]
    return [(int(spans[lo]) % SPAN, int(spans[lo]) // SPAN, rows[lo:hi], ids[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


def expected_all(n: np.ndarray, c: np.ndarray, edges: list, logs: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Of all words at once, of lengths n and counts c, by products of probabilities: count times what ``expected`` gives, summed, the pieces' by place; and the words, left out, whose products come near to the least number there is."""
    chances, every = np.exp(logs), np.arange(len(n))
    ahead, back = np.zeros((int(n.max(initial=0)) + 1, len(n))), np.zeros((int(n.max(initial=0)) + 1, len(n)))
    ahead[0], out = 1.0, np.zeros(len(logs))
    for i, j, rows, ids in edges:
        ahead[j, rows] += ahead[i, rows] * chances[ids]
    ok = ((ahead >= LEAST) | (np.arange(len(ahead))[:, None] > n)).all(axis=0)
    back[n[ok], every[ok]] = c[ok] / ahead[n[ok], every[ok]]
    # by falling ends, so all that starts at an end is there before
    for i, j, rows, ids in reversed(edges):
        x = chances[ids] * back[j, rows]
        back[i, rows] += x
        np.add.at(out, ids, x * ahead[i, rows])
    return float(c[ok] @ np.log(ahead[n[ok], every[ok]])), out, np.flatnonzero(~ok)


def best_all(n: np.ndarray, c: np.ndarray, edges: list, logs: np.ndarray) -> tuple[float, np.ndarray]:
    """Of all words at once: count times what ``best_cut`` gives, its log-probability and its pieces by place, summed."""
    top = np.full((int(n.max(initial=0)) + 1, len(n)), -np.inf)
    start, by, out = np.zeros(top.shape, np.int32), np.zeros(top.shape, np.int32), np.zeros(len(logs))
    top[0] = 0.0
    for i, j, rows, ids in edges:
        v = top[i, rows] + logs[ids]
        better = v > top[j, rows]
        rows = rows[better]
        top[j, rows], start[j, rows], by[j, rows] = v[better], i, ids[better]
    last = top[n, np.arange(len(n))]
    left = np.flatnonzero((last > -np.inf) & (n > 0))
    ends = n[left]
    while len(left):
        np.add.at(out, by[ends, left], c[left])
        ends = start[ends, left]
        left, ends = left[ends > 0], ends[ends > 0]
    return float((c * last).sum()), out


def _summed(words: DataFrame, scores: Mapping[str, float], longest: int, best: bool, pieces: list[str] | None = None) -> tuple[float, dict[str, float]]:
    """The words' log-likelihood and each piece's count: expected ones, or those of the best cuts. With ``pieces``, words are ``laid`` by them."""
    if pieces is None:
        pieces = list(scores)
        words = laid(words, pieces, longest)
    sc = words.sparkSession.sparkContext
    shared, names = sc.broadcast(dict(scores)), sc.broadcast(pieces)

    def run(batches):
        import pyarrow as pa

        scores, pieces = shared.value, names.value
        logs = np.array([scores.get(k, -np.inf) for k in pieces])
        total, n, by_itself = 0.0, np.zeros(len(pieces)), {}
        for b in batches:
            c, lens = b.column("c").to_numpy().astype(np.float64), b.column("n").to_numpy()
            spans, ids = b.column("spans"), b.column("ids")
            texts = b.column("w").to_pylist()
            short = np.array([t is None for t in texts], bool)
            edges = _by_span(spans.flatten().to_numpy(), ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy()), logs)
            size, mine = np.where(short, lens, 0), np.where(short, c, 0.0)
            alone = np.flatnonzero(~short).tolist()
            if best:
                found, more = best_all(size, mine, edges, logs)
            else:
                found, more, rest = expected_all(size, mine, edges, logs)
                alone += rest.tolist()
            total, n = total + found, n + more
            for k in alone:
                word = texts[k] or _word(spans[k].as_py(), ids[k].as_py(), pieces)
                found, more = best_cut(word, scores, longest) if best else expected(word, scores, longest)
                total += c[k] * found
                for x, v in ((x, 1.0) for x in more) if best else more.items():
                    by_itself[x] = by_itself.get(x, 0.0) + c[k] * v
        held = np.flatnonzero(n).tolist()
        # words by themselves may hold pieces that others don't; Spark adds up
        yield pa.RecordBatch.from_arrays([pa.array([None, *(pieces[i] for i in held), *by_itself], pa.string()), pa.array([total, *n[held], *by_itself.values()], pa.float64())], names=["piece", "n"])

    got = words.mapInArrow(run, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # a row per piece
    counts = {r["piece"]: r["n"] for r in got}
    return counts.pop(None, 0.0), counts


def _word(spans: list[int], ids: list[int], pieces: list[str]) -> str:
    """A word that is laid, by its characters: all of them are pieces."""
    at = {s // SPAN: pieces[k] for s, k in zip(spans, ids, strict=True) if s // SPAN - s % SPAN == 1}
    return "".join(at[j] for j in sorted(at))


def fitted(words: DataFrame, scores: Mapping[str, float], longest: int = bpe.LONGEST, pieces: list[str] | None = None) -> tuple[float, dict[str, float]]:
    """One round: the likelihood under ``scores``, and the scores that it leads to. Characters never lose all their probability. ``pieces``: words are ``laid`` by them."""
    likelihood, counts = _summed(words, scores, longest, False, pieces)
    counts = {k: max(counts.get(k, 0.0), 1e-3 if len(k) == 1 else 0.0) for k in scores}
    total = math.log(sum(counts.values())) if counts else 0.0
    return likelihood, {k: math.log(v) - total for k, v in counts.items() if v > 1e-9}


def pruned(words: DataFrame, scores: Mapping[str, float], size: int, longest: int = bpe.LONGEST, pieces: list[str] | None = None) -> dict[str, float]:
    """The ``size`` pieces whose loss would cost most, characters included whatever their number."""
    _, counts = _summed(words, scores, longest, True, pieces)
    cost = {}
    for piece, s in scores.items():
        if len(piece) > 1:
            other, _ = best_cut(piece, scores, longest, without=piece)
            cost[piece] = counts.get(piece, 0.0) * (s - other)
    keep = sorted(cost, key=lambda k: (-cost[k], -scores[k], k))[: max(0, size - (len(scores) - len(cost)))]
    return {k: v for k, v in scores.items() if len(k) == 1} | {k: scores[k] for k in keep}


def vocabulary(docs: DataFrame, size: int, specials: tuple[str, ...] = bpe.SPECIALS, longest: int = bpe.LONGEST, n_seeds: int = SEEDS) -> DataFrame:
    """(id, piece, score): ``specials`` at zero, then pieces by falling log-probability; ``size`` rows or, if words hold fewer substrings, fewer."""
    words = settled(bpe.word_pieces(docs))
    words = settled(words.repartition(words.sparkSession.sparkContext.defaultParallelism))
    scores, room = seeds(words, n_seeds, longest), size - len(specials)
    # looked up once: later rounds only have fewer of these pieces
    pieces = list(scores)
    words = settled(laid(words, pieces, longest))
    while True:
        for _ in range(ROUNDS):
            _, scores = fitted(words, scores, longest, pieces)
        if len(scores) <= room or all(len(k) == 1 for k in scores):
            break
        scores = pruned(words, scores, max(room, int(KEEP * len(scores))), longest, pieces)
    rows = [(x, 0.0) for x in specials] + sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    return docs.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, piece string, score double")
