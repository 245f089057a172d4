"""Byte-pair vocabularies, trained in batches of merges that are exact.

A merge needs the counts of all pairs, but no round over the corpus. Of the pairs counted now let S be all that occur v times or more. A pair that comes
up later is made by a merge from one that stood in its place, so it occurs no more often than that did: every merge of v or more occurrences, until the
next count, joins pieces of runs that S holds together. So a round

* counts pairs over the distinct words (Spark) and takes S, whole levels of counts, from the top;
* cuts words into runs of pieces that pairs of S join, and sums the equal ones (Spark): far fewer and shorter than the words;
* merges on the runs with a pair index and the list of runs that hold each pair, until no pair occurs v times. S shrinks until the runs are within
  RUNS pieces, so the one task that does this is bounded, whatever the corpus;
* applies the batch to words that hold one of its pairs.

A merge whose product is a piece already ends its batch, as then the bound doesn't hold. Counts, order (the more frequent pair, then by its text) and result are those of one merge after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.operators.dedup import settled

MARK = "▁"
#: Pieces of all runs that one task merges; pairs that the driver sees a round.
RUNS, PAIRS = 2_000_000, 20_000
#: Characters of the longest piece.
LONGEST = 16
# fixed values: pieces without text, in order
SPECIALS = ("<pad>", "<unk>", "<bos>", "<eos>")


def word_pieces(docs: DataFrame) -> DataFrame:
    """``docs`` (text) to (p, c): each distinct word's characters after MARK, and how often it occurs."""
    w = docs.select(F.explode(F.array_remove(F.split("text", r"\s+"), "")).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    return w.select(F.array_remove(F.split(F.concat(F.lit(MARK), "w"), ""), "").alias("p"), "c")


def _pairs(p: Column) -> Column:
    lefts, rights = F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1)
    return F.zip_with(lefts, rights, lambda a, b: F.struct(a.alias("l"), b.alias("r")))


def pair_counts(words: DataFrame, longest: int) -> DataFrame:
    z = words.filter(F.size("p") > 1).select("c", F.inline(_pairs(F.col("p"))))
    return z.filter(F.length("l") + F.length("r") <= longest).groupBy("l", "r").agg(F.sum("c").alias("n"))


def _level(top: list, whole: bool, wanted: int) -> int:
    """The count down to which pairs are taken: that of pair ``wanted``, or the one above if pairs of it are missing from ``top``."""
    v = top[min(wanted, len(top)) - 1]["n"]
    if not whole and v == top[-1]["n"]:
        v = next((r["n"] for r in reversed(top) if r["n"] > v), 0)
    return v


def runs(words: DataFrame, chosen: list) -> DataFrame:
    """(p, c): maximal runs of pieces whose neighbours are pairs of ``chosen``."""
    joined = words.sparkSession.sparkContext.broadcast({(r["l"], r["r"]) for r in chosen})

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            out, counts = [], []
            for p, c in zip(b.column("p").to_pylist(), b.column("c").to_pylist(), strict=True):
                lo = 0
                for i in range(1, len(p) + 1):
                    if i == len(p) or (p[i - 1], p[i]) not in joined.value:
                        if i - lo > 1:
                            out.append(p[lo:i])
                            counts.append(c)
                        lo = i
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string())), pa.array(counts, pa.int64())], names=["p", "c"])

    return words.mapInArrow(cut, "p array<string>, c long").groupBy("p").agg(F.sum("c").alias("c"))


def merged(held: DataFrame, least: int, room: int, longest: int, known: list[str]) -> list[tuple[str, str, int]]:
    """The merges (left, right, n) of the runs ``held``, a bounded table, down to ``least`` occurrences, at most ``room``; ends at a product that is known."""
    known_ = held.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        import heapq
        from collections import Counter, defaultdict

        import pyarrow as pa

        words, of, pieces = [], [], set(known_.value)
        for b in batches:
            words += b.column("p").to_pylist()
            of += b.column("c").to_pylist()
        counts: Counter = Counter()
        where = defaultdict(set)
        for i, (p, c) in enumerate(zip(words, of, strict=True)):
            for z in zip(p, p[1:], strict=False):
                if len(z[0]) + len(z[1]) <= longest:
                    counts[z] += c
                    where[z].add(i)
        heap = [(-n, *z) for z, n in counts.items()]
        heapq.heapify(heap)
        out = []
        while heap and len(out) < room:
            n, left, right = heapq.heappop(heap)
            pair = left, right
            if counts[pair] != -n:
                continue
            if -n < least:
                break
            out.append((left, right, -n))
            both, changed = left + right, set()
            for i in where.pop(pair):
                p, new, k = words[i], [], 0
                while k < len(p):
                    if k + 1 < len(p) and p[k] == left and p[k + 1] == right:
                        new.append(both)
                        k += 2
                    else:
                        new.append(p[k])
                        k += 1
                for z in zip(p, p[1:], strict=False):
                    counts[z] -= of[i]
                    changed.add(z)
                for z in zip(new, new[1:], strict=False):
                    counts[z] += of[i]
                    changed.add(z)
                    where[z].add(i)
                words[i] = new
            for z in changed:
                if counts[z] > 0 and len(z[0]) + len(z[1]) <= longest:
                    heapq.heappush(heap, (-counts[z], *z))
            if both in pieces:
                break
            pieces.add(both)
        left, right, n = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(n, pa.int64())], names=["i", "l", "r", "n"])

    found = held.coalesce(1).mapInArrow(run, "i int, l string, r string, n long").collect()
    return [(r["l"], r["r"], r["n"]) for r in sorted(found, key=lambda r: r["i"])]


def applied(words: DataFrame, merges: list[tuple[str, str, int]]) -> DataFrame:
    """``words`` after ``merges``, one after the other."""
    rank = words.sparkSession.sparkContext.broadcast({(left, right): i for i, (left, right, _) in enumerate(merges)})

    def run(batches):
        import pyarrow as pa

        get = rank.value.get
        for b in batches:
            out = b.column("p").to_pylist()
            for i, p in enumerate(out):
                while len(p) > 1:
                    first = min((x for x in map(get, zip(p, p[1:], strict=False)) if x is not None), default=None)
                    if first is None:
                        break
                    left, right, _ = merges[first]
                    new, k = [], 0
                    while k < len(p):
                        if k + 1 < len(p) and p[k] == left and p[k + 1] == right:
                            new.append(left + right)
                            k += 2
                        else:
                            new.append(p[k])
                            k += 1
                    p = new
                out[i] = p
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string())), b.column("c")], names=["p", "c"])

    return words.mapInArrow(run, "p array<string>, c long")


def merges(docs: DataFrame, n: int, longest: int = LONGEST, most_runs: int = RUNS, most_pairs: int = PAIRS) -> tuple[list[tuple[str, str, int]], list[str]]:
    """The first ``n`` merges over the words of ``docs`` (text), fewer if no pair is left, and the characters, the frequent first."""
    words = settled(word_pieces(docs))
    letters = [r["p"] for r in words.select(F.explode("p").alias("p"), "c").groupBy("p").agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "p").collect()]
    out: list[tuple[str, str, int]] = []
    wanted = 64
    while len(out) < n:
        top = pair_counts(words, longest).orderBy(F.desc("n"), "l", "r").limit(most_pairs).collect()
        if not top:
            break
        while True:
            v = _level(top, len(top) < most_pairs, wanted)
            chosen = [r for r in top if v and r["n"] >= v]
            if not chosen:  # a level of more pairs than the driver takes, at the top
                batch = [(top[0]["l"], top[0]["r"], top[0]["n"])]
                break
            held = settled(runs(words, chosen))
            size = held.agg(F.sum(F.size("p"))).first()[0] or 0
            if size <= most_runs:
                batch = merged(held, v, n - len(out), longest, letters + [a + b for a, b, _ in out])
                wanted = wanted * 4 if size * 4 <= most_runs else wanted
                break
            if wanted == 1:
                batch = [(top[0]["l"], top[0]["r"], top[0]["n"])]
                break
            wanted //= 2
        out += batch
        words = settled(applied(words, batch))
    return out, letters


def vocabulary(docs: DataFrame, size: int, specials: tuple[str, ...] = SPECIALS, longest: int = LONGEST) -> DataFrame:
    """(id, piece, left, right, n): ``specials``, then merges, then the characters, ``size`` rows or fewer; all characters stay, whatever the size."""
    spark = docs.sparkSession
    letters = word_pieces(docs).select(F.explode("p").alias("p")).distinct().count()
    found, chars = merges(docs, max(0, size - len(specials) - letters), longest)
    rows = [(x, None, None, None) for x in specials] + [(a + b, a, b, n) for a, b, n in found] + [(x, None, None, None) for x in chars]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, piece string, left string, right string, n long")
