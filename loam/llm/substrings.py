"""Substring deduplication with a compressed FM-index per shard.

A word goes if a window of WINDOW consecutive words of its document covers it whose words also start in a document of a smaller id.

1. Texts of the same words are one class; all but those of its smallest id are covered by that one.
2. Every window has an anchor: its GRAM-word run of least hash. Equal windows have equal anchors, so only windows whose anchor
   occurs in two classes or more can be covered; an anchor's windows of a document lie together and make a segment.
3. Segments are dealt to shards by anchor. Each shard builds an FM-index of its distinct segments and streams them through it by backward
   search; where WINDOW words match, the interval's smallest document decides. Matches become intervals of words.
4. A passage that very many documents hold gives anchors of very many segments. Of those of more segments than a bound, equal segments are first put
   together by a 128-bit hash, in partial sums: of all but the smallest document the whole segment goes. Each distinct one is then cut finer, into its single
   windows, put together in the same way, and each that is left in two documents or more goes to a shard by its hash, where the same index finds its
   smallest document. So no shard gets a group that grows with the corpus, and windows are made of distinct segments only.

Edge cases: null and empty texts have no words; documents shorter than a window lose nothing; rows that repeat an id are judged by
that id, so they don't remove each other; a null id counts as larger than all others; an empty table gives no rows; a text of any length is
searched whole. Other columns of the input may have any names.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm import common
from loam.llm.fmindex import FMIndex

WINDOW = 50
GRAM = 10
#: Segments in a shard, about.
SHARD_SEGMENTS = 8_000
#: An anchor of more segments than its share of all is cut finer, but none of up to the first number, and all above the second, half a shard.
HOT_ANCHOR, HOT_SHARE = (400, SHARD_SEGMENTS // 2), 1 / 300
LAST = (1 << 63) - 1
_P = np.uint64(0x9E3779B97F4A7C15)


def anchors(h: np.ndarray, lens: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents' word hashes laid end to end: window starts, the place of each one's anchor, and the anchors' hashes by place."""
    n = len(h)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        g = g * _P + h[k : n - gram + 1 + k]
    g = common.mixed(g)
    ends = np.cumsum(lens)
    starts = np.arange(n - window + 1)
    starts = starts[starts + window <= np.repeat(ends, lens)[: len(starts)]]
    view = np.lib.stride_tricks.sliding_window_view(g, window - gram + 1)
    place = np.empty(len(starts), np.int64)
    for lo in range(0, len(starts), 1 << 16):
        s = starts[lo : lo + (1 << 16)]
        place[lo : lo + len(s)] = s + view[s[0] : s[-1] + 1].argmin(axis=1)[s - s[0]]
    return starts, place, g


_SKETCH = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("sha", pa.binary()), ("anchors", pa.list_(pa.int64()))])


def _runs_of(keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where a run of equal keys, or a document, starts."""
    return np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | cuts])) if len(keys) else np.zeros(0, np.int64)


def sketch(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """id (null last), key (XXH64 of the text), n_words, sha (SHA-256 of the words joined by a space), and the anchor of each segment."""

    def run(batches):
        common.lean()
        hashes = common.Shingles(1)
        for b in batches:
            words = [(t or "").encode().split() for t in b.column("text").to_pylist()]
            lens = np.fromiter(map(len, words), np.int64, len(words))
            starts, place, g = anchors(hashes.words([w for x in words for w in x]), lens, window, gram)
            mine = g.view(np.int64)[place]
            doc = np.searchsorted(np.cumsum(lens), starts, side="right")
            first = _runs_of(mine, doc[1:] != doc[:-1])
            offsets = np.searchsorted(doc[first], np.arange(len(words) + 1)).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(mine[first]))
            sha = pa.array([hashlib.sha256(b" ".join(w)).digest() for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), pa.array(lens), sha, found], schema=_SKETCH)

    common.python_ready(docs.sparkSession)
    return _keyed(docs).mapInArrow(run, "id long, key long, n_words long, sha binary, anchors array<long>")


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def _keyed(docs: DataFrame) -> DataFrame:
    """id and key, which tell texts apart, and the text."""
    return docs.select(_id().alias("id"), F.xxhash64("text").alias("key"), "text")


_SEG = pa.schema([("shard", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("starts", pa.int32()), ("words", pa.binary()), ("w1", pa.int64()), ("w2", pa.int64())])
_SEG_SQL = "shard long, id long, key long, at long, starts int, words binary, w1 long, w2 long"
#: Segments or windows that a task remembers to have given the words of.
REMEMBERED = 500_000


class _Met:
    """128-bit hashes of words, and whether this task meets them first, as far as it remembers."""

    def __init__(self):
        self.met: set[bytes] = set()

    def of(self, said: bytes) -> tuple[int, int, bool]:
        import xxhash

        digest = xxhash.xxh3_128_digest(said)
        new = digest not in self.met
        if new and len(self.met) < REMEMBERED:
            self.met.add(digest)
        return *struct.unpack("<qq", digest), new


def _segments(window: int, gram: int, shards: int, hot: int):
    """Of candidates (id, key, text, hits: anchors of two classes or more, with their number of segments): segments; those of hot anchors (shard -1) with
    their hash, and with the words where this task meets them first."""

    def run(batches):
        common.lean()
        hashes, met = common.Shingles(1), _Met()
        for b in batches:
            cols: list[list] = [[] for _ in _SEG]
            for i, key, text, hits in zip(*(b.column(c).to_pylist() for c in ("id", "key", "text", "hits")), strict=True):
                w = (text or "").encode().split()
                starts, place, g = anchors(hashes.words(w), np.array([len(w)]), window, gram)
                wanted = {x["anchor"]: x["n"] for x in hits}
                # neighbouring windows of one anchor hash are one segment, however often a repetitive text has that run
                mine = g.view(np.int64)[place]
                cut = _runs_of(mine, np.zeros(max(0, len(mine) - 1), bool)).tolist()
                for x, y in zip(cut, [*cut[1:], len(starts)], strict=True):
                    anchor, lo = int(mine[x]), int(starts[x])
                    n = wanted.get(anchor)
                    if n is None:
                        continue
                    said = b" ".join(w[lo : lo + y - x + window - 1])
                    if n <= hot:
                        row = (anchor % shards, i, key, lo, y - x, said, None, None)
                    else:
                        w1, w2, new = met.of(said)
                        row = (-1, i, key, lo, y - x, said if new else None, w1, w2)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SEG, strict=True)], schema=_SEG)

    return run


_WINDOWS = pa.schema([("v1", pa.int64()), ("v2", pa.int64()), ("id", pa.int64()), ("at", pa.int64()), ("words", pa.binary()), ("w1", pa.int64()), ("w2", pa.int64())])
_WINDOWS_SQL = "v1 long, v2 long, id long, at long, words binary, w1 long, w2 long"


def _windows(window: int):
    """Of distinct segments (v1, v2, id, words): their windows, by their place in the segment."""

    def run(batches):
        met = _Met()
        for b in batches:
            cols: list[list] = [[] for _ in _WINDOWS]
            for v1, v2, i, said in zip(*(b.column(c).to_pylist() for c in ("v1", "v2", "id", "words")), strict=True):
                w = said.split(b" ")
                for s in range(len(w) - window + 1):
                    part = b" ".join(w[s : s + window])
                    w1, w2, new = met.of(part)
                    for c, v in zip(cols, (v1, v2, i, s, part if new else None, w1, w2), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _WINDOWS, strict=True)], schema=_WINDOWS)

    return run


_RUNS = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64())])
_RUNS_SQL = "id long, key long, lo long, hi long, w1 long, w2 long"


def _search(window: int):
    def run(table: pa.Table) -> pa.Table:
        """A shard's segments to runs of words that go: lo to hi of the text (id, key). A window of a hot anchor gives its smallest document as id."""
        common.lean()
        ids, ats, counts, texts = (table.column(c).to_pylist() for c in ("id", "at", "starts", "words"))
        others = [table.column(c).to_pylist() for c in ("key", "w1", "w2")]
        kinds: dict[bytes, int] = {}
        which = np.fromiter((kinds.setdefault(t, len(kinds)) for t in texts), np.int64, len(texts))
        least = np.full(len(kinds), LAST, np.int64)
        np.minimum.at(least, which, np.array(ids, np.int64))
        vocab: dict[bytes, int] = {}
        segs = [np.fromiter((vocab.setdefault(w, len(vocab) + 1) for w in t.split(b" ")), np.int64) for t in kinds]
        index = FMIndex(segs, least, len(vocab) + 1, window)
        found = index.matches(segs)
        cols: list[list] = [[] for _ in _RUNS]
        runs: dict[int, list] = {}
        for k, (at, smallest) in enumerate(found):
            s = np.unique(at[smallest < least[k]])
            edge = np.flatnonzero(np.diff(s) > 1)
            runs[k] = list(zip(s[np.append(0, edge + 1)].tolist(), s[np.append(edge, len(s) - 1)].tolist(), strict=True)) if len(s) else []
        for i, at, n, k, key, w1, w2 in zip(ids, ats, counts, which.tolist(), *others, strict=True):
            if w1 is not None:
                rows = [(int(found[k][1].min()), None, None, None, w1, w2)]
            else:
                rows = [(i, key, at + x, at + y + window, None, None) for x, y in ([(0, n - 1)] if i > least[k] else runs[k])]
            for row in rows:
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, _RUNS, strict=True)], schema=_RUNS)

    return run


def kept_words(text: str | None, runs: list) -> list[bytes]:
    w = (text or "").encode().split()
    gone = np.zeros(len(w) + 1, np.int64)
    for r in runs:
        gone[r["lo"]] += 1
        gone[min(r["hi"], len(w))] -= 1
    return [x for x, k in zip(w, np.cumsum(gone)[:-1].tolist(), strict=True) if not k]


def find(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: tuple[int, int] = HOT_ANCHOR, shard_segments: int = SHARD_SEGMENTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, candidates, runs): every row's id, key, n_words, sha, its class's number of rows, and id and key of the class's first text (least, first); id, key and
    text of such texts that may lose words; by id and key of one, the list of runs of words that go from it."""
    spark = docs.sparkSession
    rows = common.written(sketch(docs, window, gram), "sketch")
    classes = rows.groupBy("sha").agg(F.min(F.struct("id", "key")).alias("s"), F.count("*").alias("copies"))
    classes = common.written(classes.select("sha", F.col("s.id").alias("least"), F.col("s.key").alias("first"), "copies", F.col("copies").alias("n")), "text-classes")
    total = rows.count()
    every = common.written(common.join_unique(rows.drop("anchors"), classes, "sha", "n", total), "texts")
    mine = common.written(rows.filter(F.size("anchors") > 0).join(classes.select("sha", F.col("least").alias("id"), F.col("first").alias("key")), ["sha", "id", "key"], "left_semi").dropDuplicates(["id", "key"]).select("id", "key", "anchors"), "firsts")
    mine = mine.select("id", "key", F.explode("anchors").alias("anchor"))
    seen = mine.groupBy("anchor").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"), F.min("key").alias("c"), F.max("key").alias("d"))
    again = common.written(seen.filter("a <> b OR c <> d").select("anchor", "n", F.col("n").alias("size")), "anchors")
    segments = int(again.agg(F.sum("n")).first()[0] or 0)
    above = min(max(hot[0], int(segments * HOT_SHARE)), hot[1])
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), segments // shard_segments)
    hits = common.join_unique(mine, again, "anchor", "size", segments).filter("n is not null").groupBy("id", "key").agg(F.collect_set(F.struct("anchor", "n")).alias("hits"))
    # written, as these few texts move again where words go
    cand = common.written(_keyed(docs).join(hits, ["id", "key"]).dropDuplicates(["id", "key"]), "candidates")
    common.python_ready(spark)
    segs = common.written(cand.mapInArrow(_segments(window, gram, shards, above), _SEG_SQL), "segments")
    dealt = segs.filter("shard >= 0")
    alone = segs.filter("shard < 0").select(F.col("w1").alias("v1"), F.col("w2").alias("v2"), "id", "key", "at", "starts", "words")
    kinds = common.written(alone.groupBy("v1", "v2").agg(F.min("id").alias("least"), F.count("*").alias("n")), "segment-kinds")
    hottest = bool(kinds.head(1))
    if hottest:
        said = alone.filter("words is not null").select("v1", "v2", "words").join(kinds.select("v1", "v2", F.col("least").alias("id")), ["v1", "v2"]).dropDuplicates(["v1", "v2"])
        alone = common.written(common.join_unique(alone.drop("words"), kinds, ["v1", "v2"], "n", segments), "hot-segments")
        wins = common.written(said.mapInArrow(_windows(window), _WINDOWS_SQL), "windows")
        seen = wins.groupBy("w1", "w2").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.count("*").alias("n"))
        seen = common.written(seen.filter("id <> last").drop("last"), "window-kinds")
        said = wins.filter("words is not null").select("w1", "w2", "words")
        said = said.join(seen.select("w1", "w2", "id"), ["w1", "w2"]).dropDuplicates(["w1", "w2"])
        one = said.select(F.pmod("w1", F.lit(shards)).alias("shard"), "id", F.lit(None).cast("long").alias("key"), F.lit(0).cast("long").alias("at"), F.lit(1).alias("starts"), "words", "w1", "w2")
        dealt = dealt.unionByName(one)
    found = common.written(dealt.groupBy("shard").applyInArrow(_search(window), _RUNS_SQL), "found")
    runs = found.filter("w1 is null").select("id", "key", "lo", "hi")
    if hottest:
        first = found.filter("w1 is not null").select("w1", "w2", F.col("id").alias("least")).join(seen.select("w1", "w2", "n"), ["w1", "w2"])
        late = common.join_unique(wins.drop("words"), first, ["w1", "w2"], "n", segments).filter("id > least").select("v1", "v2", F.col("at").alias("s"))
        # copies in larger documents go whole; of the smallest one the windows that others have
        runs = runs.unionByName(alone.filter("id > least").select("id", "key", F.col("at").alias("lo"), (F.col("at") + F.col("starts") + (window - 1)).alias("hi")))
        cut_ = alone.filter("id = least").select("v1", "v2", "id", "key", "at").join(late, ["v1", "v2"])
        runs = runs.unionByName(cut_.select("id", "key", (F.col("at") + F.col("s")).alias("lo"), (F.col("at") + F.col("s") + window).alias("hi")))
    runs = runs.distinct().groupBy("id", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    return every, cand.select("id", "key", "text"), common.written(runs, "runs")


_CUT = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n_removed", pa.int64()), ("kept_sha", pa.binary()), ("kept", pa.string())])


def cut(cand: DataFrame, runs: DataFrame) -> DataFrame:
    """Of each text with runs: id, key, n_removed, kept_sha and the words that stay."""

    def run(batches):
        for b in batches:
            out = []
            for i, key, text, r in zip(*(b.column(c).to_pylist() for c in ("id", "key", "text", "runs")), strict=True):
                kept = kept_words(text, r)
                joined = b" ".join(kept)
                out.append((i, key, len((text or "").encode().split()) - len(kept), hashlib.sha256(joined).digest(), joined.decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 5, _CUT, strict=True)], schema=_CUT)

    common.python_ready(cand.sparkSession)
    return cand.join(runs, ["id", "key"]).mapInArrow(run, "id long, key long, n_removed long, kept_sha binary, kept string")


EMPTY = hashlib.sha256(b"").hexdigest()


def judged(every: DataFrame, cand: DataFrame, runs: DataFrame, window: int = WINDOW, text: bool = False) -> DataFrame:
    """``every`` with n_removed, kept_sha256 and, if asked for, the kept words where any went."""
    done = common.written(cut(cand, runs), "cut")
    cols = ["n_removed", "kept_sha", *(["kept"] if text else [])]
    sizes = every.select("least", "first", "copies").distinct()
    done = done.select(F.col("id").alias("least"), F.col("key").alias("first"), *cols).join(sizes, ["least", "first"])
    j = common.join_unique(every, done.withColumnRenamed("copies", "n"), ["least", "first"], "n", every.count(), "copies")
    late = (F.col("id") > F.col("least")) & (F.col("n_words") >= window)
    j = j.withColumn("n_removed", F.when(late, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))))
    j = j.withColumn("kept_sha256", F.when(late, F.lit(EMPTY)).otherwise(F.lower(F.hex(F.coalesce("kept_sha", "sha")))))
    j = j.withColumn("doc_id", F.when(F.col("id") < LAST, F.col("id")))
    return j.withColumn("kept", F.when(late, F.lit("")).otherwise(F.col("kept"))) if text else j


def op9_substrings(docs: DataFrame) -> DataFrame:
    return judged(*find(docs)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the words that go removed from their texts (then joined by spaces); texts that keep all their words stay as they
    are, and documents that keep none go. ``n_chars``, if there, is counted again."""
    rows = judged(*find(docs), text=True).filter("n_removed > 0").select("id", "key", "kept")
    changed = common.written(rows.dropDuplicates(["id", "key"]), "changed")
    mine = common.boxed(docs, id=_id(), key=F.xxhash64("text")).join(changed, ["id", "key"], "left").filter(F.col("kept").isNull() | (F.col("kept") != ""))
    new = {"text": F.coalesce("kept", F.col("_doc.text"))}
    if "n_chars" in docs.columns:
        old = F.col("_doc.n_chars")
        new["n_chars"] = F.when(F.col("kept").isNull(), old).otherwise(F.length("kept")).cast(docs.schema["n_chars"].dataType)
    return mine.select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])
