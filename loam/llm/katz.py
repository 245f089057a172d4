"""Katz backoff language model over the whole corpus, bigrams backing off to unigrams.

Counts r up to K are discounted by Good-Turing's estimate, larger ones are not. ``P(b|a) = d(r) r / c(a)`` for bigrams seen in training,
``alpha(a) P(b)`` for others, where alpha makes the sum over all words and one unknown word exactly 1. Unigrams are
discounted alike; what that leaves is the unknown word's.

The corpus is cut into chunks of about CHUNK_TOKENS tokens, one row each. Between chunks and the model's partitions
move not single n-grams but sorted, delta-coded blobs: a chunk asks for its distinct words, then for its distinct bigrams,
each once, so a word that is a third of all tokens is one entry a chunk. Partitions of the model are

* ``vocab``: words by crc32 bucket, with counts; the answer to a chunk is each word's number and count;
* ``bigrams``: by the first word's bucket, that of a word of over HOT_CONTEXT tokens spread by the second word as well;
  the answer is the count in training;
* ``backoff``: alpha of each word, from the bigram partitions' sums.

All are written tables. The driver sees sums and counts of counts only.

Edge cases: null and empty texts have the end token only; repeated rows each count and each get a score; a null id counts as the
empty text in the choice of training rows; no training rows: every word is unknown; an empty table gives no rows.
A text of any length is scored whole, and a chunk grows to hold it; nothing is ordered, so there are no ties; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import common

CHUNK_TOKENS = 2_000_000
K = 5
DOCS_A_BUCKET = 4000
LEAST_BUCKETS = 32
#: A context of more tokens is spread over several partitions.
HOT_CONTEXT = 2_000_000


# blobs: integers by byte planes, zstd


def enc(x: np.ndarray) -> bytes:
    import zstandard

    planes = np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8).T
    n = 8
    while n > 1 and not planes[n - 1].any():
        n -= 1
    return bytes([n]) + len(x).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:n]).tobytes())


def dec(b: bytes) -> np.ndarray:
    import zstandard

    k, n = b[0], int.from_bytes(b[1:9], "little")
    planes = np.zeros((8, n), np.uint8)
    planes[:k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[9:], max_output_size=max(1, k * n)), np.uint8).reshape(k, n)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


def enc_floats(x: np.ndarray) -> bytes:
    return enc(np.ascontiguousarray(x, "<f8").view("<i8"))


def dec_floats(b: bytes) -> np.ndarray:
    return dec(b).view("<f8")


def enc_sorted(x: np.ndarray) -> bytes:
    return enc(np.diff(x, prepend=0))


def dec_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(dec(b))


def enc_words(w: list[bytes]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"\n".join(w) + b"\n")


def dec_words(b: bytes) -> list[bytes]:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(b).split(b"\n")[:-1]


def enc_pairs(keys: np.ndarray) -> bytes:
    """Sorted keys ``a << 32 | b``: a's steps, b's steps where a stays."""
    a, b = keys >> 32, keys & 0xFFFFFFFF
    same = np.diff(a, prepend=-1) == 0
    one, two = enc(np.diff(a, prepend=0)), enc(np.where(same, b - np.concatenate([[0], b[:-1]]), b) if len(b) else b)
    return len(one).to_bytes(8, "little") + one + two


def dec_pairs(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    a, step = np.cumsum(dec(blob[8 : 8 + n])), dec(blob[8 + n :])
    total = np.cumsum(step)
    start = np.flatnonzero(np.diff(a, prepend=-1) != 0)
    sizes = np.diff(np.append(start, len(a)))
    return a << 32 | (total - np.repeat(total[start] - step[start], sizes))


# Katz's numbers


def discounts(nr: list[int]) -> np.ndarray:
    """d[r] for r = 0 to K from the counts of counts n[1] to n[K + 1]; where they give nothing sound, half a count is taken off."""
    n = [0, *nr]
    d = np.ones(K + 1)
    common_ = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - common_) / (1 - common_) if n[r] and common_ < 1 else -1.0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


class Unigrams:
    def __init__(self, total: int, kinds: int, nr: list[int]):
        self.total, self.kinds, self.d = total, kinds, discounts(nr)
        seen = sum(self.d[r] * r * nr[r - 1] for r in range(1, K + 1))
        many = total - sum(r * nr[r - 1] for r in range(1, K + 1))
        left = 1 - (seen + many) / total if total else 1.0
        least = 1 / (total + kinds + 1)
        self.scale = 1.0 if left >= least or not total else (1 - least) / (1 - left)
        self.unknown = max(left, least)

    def p(self, c: np.ndarray) -> np.ndarray:
        got = np.where(c <= K, self.d[np.minimum(c, K)], 1.0) * c * (self.scale / max(1, self.total))
        return np.where(c > 0, got, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.total + self.kinds + 1))


def backoff(c: np.ndarray, mass: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha and the factor on seen bigrams, from a context's count, its sum of d(r) r, and its seen words' unigram sum.

    A context that discounting leaves nothing to back off with gives up half a count.
    """
    left, least = 1 - mass / np.maximum(c, 1), 0.5 / (c + 1)
    few = left < least
    scale = np.where(few, (1 - least) / np.maximum(1 - left, 1e-300), 1.0)
    return np.where(few, least, left) / np.maximum(1 - lower, 1e-12), scale


# steps

_CHUNK = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lens", pa.list_(pa.int64())), ("words", pa.binary()), ("splits", pa.binary()), ("train", pa.binary()), ("toks", pa.binary())])
_CHUNK_SQL = "chunk long, doc_ids array<long>, held array<boolean>, lens array<long>, words binary, splits binary, train binary, toks binary"


def _chunks(docs: DataFrame, buckets: int, folds: int, held_fold: int, chunk_tokens: int) -> DataFrame:
    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0

        def fresh():
            return {b"": 0}, [], [], [], [], 0

        known, toks, names, held, lens, n = fresh()

        def close():
            words = list(known)
            bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
            order = sorted(range(len(words)), key=words.__getitem__)
            order = np.array(order)[np.argsort(bucket[order], kind="stable")]
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            ids = place[np.concatenate(toks)]
            train = np.repeat(~np.array(held, bool), lens)
            row = [
                [part << 32 | seq], [names], [held], [lens], [enc_words([words[i] for i in order])],
                [enc(np.bincount(bucket, minlength=buckets))], [enc(np.bincount(ids[train], minlength=len(words)))], [enc(ids)],
            ]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _CHUNK, strict=True)], schema=_CHUNK)

        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = (t or "").encode().lower().split()
                for x in set(w).difference(known):
                    known[x] = len(known)
                w.append(b"")
                toks.append(np.fromiter(map(known.__getitem__, w), np.int32, len(w)))
                names.append(d)
                held.append(zlib.crc32(b"" if d is None else str(d).encode()) % folds == held_fold)
                lens.append(len(w))
                n += len(w)
                if n >= chunk_tokens:
                    yield close()
                    known, toks, names, held, lens, n = fresh()
                    seq += 1
        if names:
            yield close()

    common.python_ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _CHUNK_SQL)


#: Rows between chunks and partitions: chunk -1 is the partition's own table.
_ROW = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("nr", pa.list_(pa.int64()))])
_ROW_SQL = "kind string, bucket long, chunk long, a binary, b binary, c binary, nr array<long>"


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _ROW]
    return pa.table([pa.array(v, f.type) for v, f in zip(cols, _ROW, strict=True)], schema=_ROW)


def _batches(rows: list[tuple]):
    yield from _rows(rows).to_batches()


def _counts_of_counts(c: np.ndarray) -> list[int]:
    n = np.bincount(np.minimum(c[c > 0], K + 2), minlength=K + 3)
    return [*n[1 : K + 2].tolist(), int((c > 0).sum()), int(c.sum())]


def _ask_words(batches):
    for b in batches:
        for r in b.to_pylist():
            words, n, train = dec_words(r["words"]), dec(r["splits"]), dec(r["train"])
            at, out = 0, []
            for k, m in enumerate(n.tolist()):
                if m:
                    out.append(("ask", k, r["chunk"], enc_words(words[at : at + m]), enc(train[at : at + m]), b"", None))
                at += m
            yield from _batches(out)


def _vocab(table: pa.Table) -> pa.Table:
    """A bucket's words: its table, and to each chunk its words' numbers in the bucket and counts."""
    bucket = table.column("bucket")[0].as_py()
    asked = [(r["chunk"], dec_words(r["a"]), dec(r["b"])) for r in table.select(["chunk", "a", "b"]).to_pylist()]
    words = sorted(set().union(*(w for _, w, _ in asked)))
    at = dict(zip(words, range(len(words)), strict=True))
    idx = [np.fromiter(map(at.__getitem__, w), np.int64, len(w)) for _, w, _ in asked]
    total = np.zeros(len(words), np.int64)
    for i, (_, _, c) in zip(idx, asked, strict=True):
        total[i] += c
    rows = [("vocab", bucket, -1, enc_words(words), enc(total), b"", _counts_of_counts(total))]
    rows += [("word", bucket, chunk, enc_sorted(i), enc(total[i]), b"", None) for i, (chunk, _, _) in zip(idx, asked, strict=True)]
    return _rows(rows)


def _numbers(chunk: dict, rows: list[dict], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The global numbers and training counts of a chunk's words."""
    rows = sorted((r for r in rows if r["kind"] == "word"), key=lambda r: r["bucket"])
    ids = [dec_sorted(r["a"]) * buckets + r["bucket"] for r in rows]
    return np.concatenate(ids), np.concatenate([dec(r["b"]) for r in rows])


def _bigrams(chunk: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids, those before them (the end token before a document's first), and which are of training rows."""
    ids, lens = dec(chunk["toks"]), np.array(chunk["lens"], np.int64)
    starts = np.cumsum(lens) - lens
    before = np.concatenate([[0], ids[:-1]])
    before[starts] = ids[starts + lens - 1]
    return ids, before, np.repeat(~np.array(chunk["held"], bool), lens)


def _distinct(chunk: dict, number: np.ndarray, count: np.ndarray, buckets: int, hot: int):
    """The chunk's distinct bigrams in the order of (bucket, key), their keys, buckets, and each token's place among them."""
    ids, before, train = _bigrams(chunk)
    size = len(number)
    local, where = np.unique(before * size + ids, return_inverse=True)
    a, b = local // size, local % size
    key = number[a] << 32 | number[b]
    spread = count[a] // hot
    mixed = (number[a] * 0x9E3779B1 + (number[b] % (spread + 1)) * 0x85EBCA6B) % 0x7FFFFFFF
    bucket = np.where(spread > 0, mixed, number[a]) % buckets
    order = np.lexsort((key, bucket))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return ids, before, train, a[order], b[order], key[order], bucket[order], place[where]


def _split(table: pa.Table) -> tuple[dict, list[dict]]:
    rows = table.to_pylist()
    chunk = next(r for r in rows if r["kind"] == "chunk")
    return chunk, [r for r in rows if r["kind"] != "chunk"]


def _ask_bigrams(buckets: int, hot: int):
    def run(table: pa.Table) -> pa.Table:
        chunk, rows = _split(table)
        number, count = _numbers(chunk, rows, buckets)
        _, _, train, _, b, key, bucket, where = _distinct(chunk, number, count, buckets, hot)
        c = np.bincount(where[train], minlength=len(key))
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        out = []
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True):
            out.append(("ask2", int(bucket[lo]), chunk["chunk"], enc_pairs(key[lo:hi]), enc(c[lo:hi]), enc(count[b[lo:hi]]), None))
        return _rows(out)

    return run


def _merge_bigrams(table: pa.Table) -> pa.Table:
    bucket = table.column("bucket")[0].as_py()
    rows = table.select(["chunk", "a", "b", "c"]).to_pylist()
    keys = [dec_pairs(r["a"]) for r in rows]
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    r = np.bincount(where, weights=np.concatenate([dec(x["b"]) for x in rows]), minlength=len(every)).astype(np.int64)
    second = np.zeros(len(every), np.int64)
    second[where] = np.concatenate([dec(x["c"]) for x in rows])
    seen = r > 0
    out = [("bigrams", bucket, -1, enc_pairs(every[seen]), enc(r[seen]), enc(second[seen]), _counts_of_counts(r))]
    at = 0
    for x, k in zip(rows, keys, strict=True):
        out.append(("count", bucket, x["chunk"], b"", enc(r[where[at : at + len(k)]]), b"", None))
        at += len(k)
    return _rows(out)


def _context_sums(buckets: int, one: Unigrams, d2: np.ndarray):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                a, r, c = dec_pairs(row["a"]) >> 32, dec(row["b"]), dec(row["c"])
                if not len(a):
                    continue
                starts = np.flatnonzero(np.diff(a, prepend=-1))
                mass = np.add.reduceat(np.where(r <= K, d2[np.minimum(r, K)], 1.0) * r, starts)
                lower = np.add.reduceat(one.p(c), starts)
                first = a[starts]
                home = first % buckets
                out = []
                for k in np.unique(home).tolist():
                    m = home == k
                    out.append(("sums", k, -1, enc_sorted(first[m] // buckets), enc_floats(mass[m]), enc_floats(lower[m]), None))
                yield from _batches(out)

    return run


def _alphas(table: pa.Table) -> pa.Table:
    """Of a vocabulary bucket: its words' sums, and to each chunk its words' alpha and factor."""
    bucket = table.column("bucket")[0].as_py()
    rows = table.to_pylist()
    mine = next(r for r in rows if r["kind"] == "vocab")
    c = dec(mine["b"])
    mass, lower = np.zeros(len(c)), np.zeros(len(c))
    for r in sorted((r for r in rows if r["kind"] == "sums"), key=lambda r: (r["a"], r["b"])):
        i = dec_sorted(r["a"])
        mass[i] += dec_floats(r["b"])
        lower[i] += dec_floats(r["c"])
    alpha, scale = backoff(c, mass, lower)
    alpha, scale = np.where(c > 0, alpha, 1.0), np.where(c > 0, scale, 1.0)
    out = [("backoff", bucket, -1, b"", enc_floats(alpha), enc_floats(scale), None)]
    for r in rows:
        if r["kind"] == "word":
            i = dec_sorted(r["a"])
            out.append(("alpha", bucket, r["chunk"], b"", enc_floats(alpha[i]), enc_floats(scale[i]), None))
    return _rows(out)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(buckets: int, hot: int, one: Unigrams, d2: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        chunk, rows = _split(table)
        number, count = _numbers(chunk, rows, buckets)
        by = lambda kind: sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["bucket"])
        alpha = np.concatenate([dec_floats(r["b"]) for r in by("alpha")])
        scale = np.concatenate([dec_floats(r["c"]) for r in by("alpha")])
        r = np.concatenate([dec(x["b"]) for x in by("count")])
        ids, _, _, a, b, _, _, where = _distinct(chunk, number, count, buckets, hot)
        seen = scale[a] * np.where(r <= K, d2[np.minimum(r, K)], 1.0) * r / np.maximum(count[a], 1)
        logs = np.log10(np.where(r > 0, seen, alpha[a] * one.p(count[b])))
        lens = np.array(chunk["lens"], np.int64)
        starts = np.cumsum(lens) - lens
        add = lambda x: np.add.reduceat(x, starts)
        n = len(lens)
        return pa.table([
            pa.array(chunk["doc_ids"], pa.int64()), pa.array(chunk["held"], pa.bool_()), pa.array(lens), pa.array(add((count > 0)[ids].astype(np.int64))),
            pa.array(np.full(n, one.total, np.int64)), pa.array(add(one.base(count)[ids])), pa.array(add(logs[where])),
        ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _summed(rows: DataFrame, kind: str) -> list[int]:
    """n[1] to n[K + 1], kinds, tokens."""
    nr = F.col("nr")
    got = rows.filter(F.col("kind") == kind).agg(*[F.sum(nr[i]) for i in range(K + 3)]).first()
    return [int(x or 0) for x in got]


def score(docs: DataFrame, folds: int = 7, held_fold: int = 2, chunk_tokens: int = CHUNK_TOKENS, hot_context: int = HOT_CONTEXT) -> DataFrame:
    spark = docs.sparkSession
    buckets = max(LEAST_BUCKETS, docs.count() // DOCS_A_BUCKET)
    chunks = common.written(_chunks(docs, buckets, folds, held_fold, chunk_tokens), "chunks", "none")
    common.python_ready(spark)
    words = common.written(chunks.select("chunk", "words", "splits", "train").mapInArrow(_ask_words, _ROW_SQL).groupBy("bucket").applyInArrow(_vocab, _ROW_SQL), "vocab", "none")
    *nr, kinds, total = _summed(words, "vocab")
    one = Unigrams(total, kinds, nr)
    as_row = chunks.select(F.lit("chunk").alias("kind"), "chunk", "doc_ids", "held", "lens", "toks")
    to_chunk = lambda df, kind: df.filter(F.col("kind") == kind).select("kind", "chunk", "bucket", "a", "b", "c")
    asked = as_row.unionByName(to_chunk(words, "word"), allowMissingColumns=True).groupBy("chunk").applyInArrow(_ask_bigrams(buckets, hot_context), _ROW_SQL)
    pairs = common.written(asked.groupBy("bucket").applyInArrow(_merge_bigrams, _ROW_SQL), "bigrams", "none")
    *nr2, _, _ = _summed(pairs, "bigrams")
    d2 = discounts(nr2)
    sums = pairs.filter(F.col("kind") == "bigrams").mapInArrow(_context_sums(buckets, one, d2), _ROW_SQL)
    back = common.written(sums.unionByName(words).groupBy("bucket").applyInArrow(_alphas, _ROW_SQL), "backoff", "none")
    every = as_row
    for df, kind in ((words, "word"), (pairs, "count"), (back, "alpha")):
        every = every.unionByName(to_chunk(df, kind), allowMissingColumns=True)
    return every.groupBy("chunk").applyInArrow(_score(buckets, hot_context, one, d2), SCORES)


def op7_katz(docs: DataFrame) -> DataFrame:
    return score(docs)
