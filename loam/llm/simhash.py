"""SimHash near-duplicates by the generalised pigeonhole principle.

1. A fingerprint per document: of each bit of the shingles' XXH64 (seed 42) the majority. Equal fingerprints are one node from here on, so
   groups of copies cost one row.
2. Correlated bits are grouped into m parts. If two fingerprints differ in at most t bits, then in some part p they differ in at most
   T[p], for any thresholds with sum(T) = t - m + 1. Parts, m and T are chosen by dynamic programming on estimated
   costs: the estimated candidates of each part and threshold, and the probes it needs. The estimate is from a bounded
   sample and only decides the speed: the links found are all there are, whatever is chosen.
3. Each fingerprint is indexed by its part's bits and probes all values within T[p]; hits are verified by their XOR.
   An index bucket of more than BUCKET fingerprints is instead cut into blocks; each pair of blocks is compared by one
   task, which returns not pairs but the connected classes it sees as stars, so nothing grows with the square of a group.
4. Components of the links, in Spark; the component id is its smallest document id.

Edge cases: null or empty texts have fingerprint 0 and link to each other; texts with fewer words than a shingle have one shingle of
all their words; rows that repeat an id each get a row; a null id counts only where a component has no other; an empty table
gives no rows. A text of any length is read whole. Fingerprints at equal distances all link, so there are no ties to break. Other columns, whatever their names, are
not read, or kept by ``one_of_each``.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm import common, jaccard
from loam.llm.components import components

BITS = 64
#: Fingerprints that the estimates are made from, at most.
SAMPLE = 4000
LAST = (1 << 63) - 1
BUCKET = 64
BLOCK = 2048


def fingerprint(text: str | None, shingle: int) -> int:
    return int(_fingerprints([text], shingle)[0])


def _fingerprints(texts: list[str | None], shingle: int) -> np.ndarray:
    return np.array([majority(common.shingle_hashes(common.lower_words(t), shingle)) for t in texts], np.uint64)


def majority(h: np.ndarray) -> np.uint64:
    """Each bit that over half of the hashes have."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, key (XXH64 of the text), fp (the fingerprint's bits as a long)."""

    def run(batches):
        common.lean()
        for b in batches:
            fp = _fingerprints(b.column("text").to_pylist(), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(fp)], names=["doc_id", "key", "fp"])

    common.python_ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text").mapInArrow(run, "doc_id long, key long, fp long")


def grouped_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """m parts of near-equal width, correlated bits together."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    x = bits - bits.mean(axis=0)
    norm = np.sqrt((x * x).sum(axis=0)) + 1e-9
    near = np.abs(x.T @ x) / np.outer(norm, norm)
    np.fill_diagonal(near, 0)
    left, parts = list(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        sub = near[np.ix_(left, left)]
        part = [left[int(sub.sum(axis=0).argmax())]]
        while len(part) < size:
            rest = [b for b in left if b not in part]
            part.append(rest[int(near[np.ix_(part, rest)].sum(axis=0).argmax())])
        left = [b for b in left if b not in part]
        parts.append(sorted(part))
    return parts


def estimates(sample: np.ndarray, part: list[int], n: int, most: int) -> list[float]:
    """Candidate pairs expected of n fingerprints if this part may differ in 0, 1, ... most bits."""
    mask = np.uint64(sum(1 << b for b in part))
    one = ((sample[:, None] >> np.array(part, np.uint64)) & np.uint64(1)).mean(axis=0)
    dist = np.zeros(most + 2)
    dist[0] = 1.0
    for q in np.clip(2 * one * (1 - one), 1e-6, 1):  # as if bits were independent
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    seen = np.zeros(most + 1)
    cut = sample & mask
    for i in range(0, len(cut), 256):
        d = np.bitwise_count(cut[i : i + 256, None] ^ cut[None, :])
        seen += [(d == k).sum() for k in range(most + 1)]
    seen[0] -= len(cut)
    pairs = max(1, len(cut) * (len(cut) - 1))
    both = [max(a, b / pairs if b >= 20 else 0) for a, b in zip(np.cumsum(dist[: most + 1]), np.cumsum(seen), strict=True)]
    return [x * n * n for x in both]


def thresholds(cost: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """One threshold per part, -1 or more, of the given sum, of the least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (v, picks) in best.items():
            for t, w in c.items():
                if s + t not in step or v + w < step[s + t][0]:
                    step[s + t] = (v + w, [*picks, t])
        best = step
    return best.get(total, (float("inf"), []))


def design(sample: np.ndarray, n: int, bits: int) -> list[tuple[int, int, list[int]]]:
    """(part's mask, its threshold, the XOR masks to probe) of the cheapest choice."""
    found = (float("inf"), [], [])
    for m in range(1, min(bits + 1, 6) + 1):
        parts = grouped_bits(sample, m)
        cost = []
        for p in parts:
            most = min(bits, len(p), 3)
            est = estimates(sample, p, n, most)
            probes = np.cumsum([comb(len(p), k) for k in range(most + 1)])
            cost.append({-1: 0.0} | {t: est[t] + 3.0 * n * float(probes[t]) for t in range(most + 1)})
        v, t = thresholds(cost, bits - m + 1)
        if v < found[0]:
            found = (v, parts, t)
    out = []
    for p, t in zip(found[1], found[2], strict=True):
        if t >= 0:
            flips = [sum(1 << b for b in c) for k in range(t + 1) for c in combinations(p, k)]
            out.append((sum(1 << b for b in p), t, flips))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(bits: int):
    """Of the rows of a pair of blocks: (u, v) with u the first fingerprint of v's class among links index x probe."""

    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        probe = table.column("probe").to_numpy(zero_copy_only=False)
        nodes, where = np.unique(fp, return_inverse=True)
        a, b = np.unique(where[~probe]), np.unique(where[probe])
        label = np.arange(len(nodes))
        while len(a) and len(b):
            before = label.copy()
            for i in range(0, len(a), 512):
                rows = a[i : i + 512]
                near = np.bitwise_count(nodes[rows][:, None] ^ nodes[b][None, :]) <= bits
                big = len(nodes)
                low = np.minimum(label[rows], np.where(near, label[b][None, :], big).min(axis=1))
                label[rows] = low
                label[b] = np.minimum(label[b], np.where(near, low[:, None], big).min(axis=0))
            label = np.minimum(label, label[label])
            if (label == before).all():
                break
        moved = label != np.arange(len(nodes))
        return pa.table({"u": nodes[label[moved]].view(np.int64), "v": nodes[moved].view(np.int64)})

    return run


def links(fps: DataFrame, n: int, bits: int) -> DataFrame:
    """``fps`` (fp: long, distinct, a written table of n rows) to (u, v): links whose components are those of all links."""
    spark = fps.sparkSession
    if n < 2:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).filter("false")
    # the least hashes: a uniform sample of bounded size that reruns agree on
    some = [r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    parts = design(np.array(some, np.int64).view(np.uint64), n, bits)

    def lit_parts(flips: bool):
        rows = []
        for k, (mask, _, xs) in enumerate(parts):
            for x in xs if flips else [0]:
                rows.append(F.struct(F.lit(k).alias("p"), F.lit(_signed(mask)).cast("long").alias("m"), F.lit(_signed(x)).cast("long").alias("x")))
        return F.explode(F.array(*rows))

    def keyed(flips: bool) -> DataFrame:
        e = fps.select("fp", lit_parts(flips).alias("e"))
        return e.select("fp", F.col("e.p").alias("p"), F.col("fp").bitwiseAND(F.col("e.m")).bitwiseXOR(F.col("e.x")).alias("key"))

    index, probes = keyed(False), keyed(True)
    sizes = index.groupBy("p", "key").agg(F.count("*").alias("n"))
    large = common.written(sizes.filter(F.col("n") > BUCKET), "large-buckets")
    cold = index.join(large, ["p", "key"], "left_anti") if large.head(1) else index
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= bits
    # merged, as a broadcast would be chosen by the size before probes are made
    pairs = cold.alias("a").hint("merge").join(probes.alias("b"), (F.col("a.p") == F.col("b.p")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & near)
    found = pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    if large.head(1):
        blocks = large.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        i = index.join(blocks, ["p", "key"]).select("p", "key", "fp", F.lit(False).alias("probe"), mine.alias("i"), every.alias("j"))
        j = probes.join(blocks, ["p", "key"]).select("p", "key", "fp", F.lit(True).alias("probe"), mine.alias("j"), every.alias("i"))
        common.python_ready(spark)
        stars = i.unionByName(j).groupBy("p", "key", "i", "j").applyInArrow(_stars(bits), "u long, v long")
        found = found.unionByName(stars)
    return found


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, key, fp, component_id: one row per row of ``docs``."""
    marked = common.written(fingerprints(docs, shingle), "fingerprints")
    total = marked.count()
    fps = common.written(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    n = fps.count()
    if n < 2:
        return marked.join(F.broadcast(fps.select("fp", F.col("least").alias("component_id"))), "fp").select("doc_id", "key", "fp", "component_id")  # a row at most
    comp = common.written(components(links(fps.select("fp"), n, bits)), "components")
    fps = fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    of = fps.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("k"))
    classes = common.join_unique(fps.select("fp", "n", "label"), of, "label", "k", n).select("fp", "n", "component_id")
    return common.join_unique(marked, common.written(classes, "class-components"), "fp", "n", total)


def op4_simhash(docs: DataFrame) -> DataFrame:
    got = near_duplicates(docs)
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """_id, _key (XXH64 of the text), node (the words in lower case, hashed), fp (the fingerprint) and bands (MinHash keys): a row per row."""

    def run(batches):
        import xxhash

        common.lean()
        odd, shingles = jaccard.odd_numbers(), common.Shingles(shingle)
        for b in batches:
            texts = b.column("text").to_pylist()
            n = len(texts)
            nodes, fps, low = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros((n, len(odd)), np.uint32)
            for k, t in enumerate(texts):
                w = common.lower_words(t)
                h = shingles.of(w)
                nodes[k], fps[k], low[k] = xxhash.xxh64_intdigest(b" ".join(w), 7), majority(h), jaccard.minima(h, odd)
            bands = jaccard.keys(low).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * jaccard.BANDS), pa.array(bands))
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_key"), pa.array(nodes.view(np.int64)), pa.array(fps.view(np.int64)), lists], names=["_id", "_key", "node", "fp", "bands"])

    common.python_ready(docs.sparkSession)
    return docs.select(_id().alias("_id"), F.xxhash64("text").alias("_key"), "text").mapInArrow(run, "_id long, _key long, node long, fp long, bands array<long>")


def _id() -> Column:
    """doc_id, where a null one comes last. Rows that agree in it and in the hash of the text have one text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def _of_block(shingle: int, least: float, bits: int):
    """Of a block of a fingerprint class: (u, v) with u the first node of v's class by verified links."""

    def run(table: pa.Table) -> pa.Table:
        common.lean()
        node, fp, sets = table.column("node").to_numpy(), table.column("fp").to_numpy().view(np.uint64), jaccard.Sets(table.column("text"), shingle)
        label = np.arange(len(node))
        for x in range(1, len(node)):
            far = np.bitwise_count(fp[:x] ^ fp[x])
            hits = np.flatnonzero(far <= bits)
            jaccard.connect(x, hits[np.argsort(far[hits], kind="stable")], label, sets, least)
        moved = node[label] != node
        return pa.table({"u": node[label[moved]], "v": node[moved]})

    return run


def _of_band(shingle: int, least: float):
    """Of a block of a band's nodes, each of its few: links to nodes of other classes, as (u, v)."""

    def run(table: pa.Table) -> pa.Table:
        common.lean()
        node, few, sets = table.column("node").to_numpy(), table.column("few").to_numpy(zero_copy_only=False), jaccard.Sets(table.column("text"), shingle)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, jaccard.BANDS)
        kind, label = np.unique(table.column("label").to_numpy(), return_inverse=True)
        here = bands == table.column("band")[0].as_py()
        first, rep = here.argmax(axis=1), np.zeros(len(kind), np.int64)
        rep[label] = np.arange(len(label))
        before = label.copy()
        for x in np.flatnonzero(few).tolist():
            same = bands == bands[x]
            # a pair that shares several bands is looked at in the first of them only
            hits = np.flatnonzero(same.argmax(axis=1) == first[x])
            jaccard.connect(x, hits[np.argsort(-same[hits].sum(axis=1), kind="stable")], label, sets, least)
        moved = label != before
        return pa.table({"u": node[rep[label[moved]]], "v": node[moved]})

    return run


#: Nodes that one task compares, at most; nodes of a large fingerprint class that all its blocks get, about.
NODES, PIVOTS = 256, 8


def _blocks(n: Column) -> Column:
    return F.ceil(n / NODES).cast("int")


def similar_classes(docs: DataFrame, shingle: int = 5, least: float = 0.8, bits: int = 6) -> DataFrame:
    """_id, _key, label: one row per row of ``docs``, equal labels for what pairs of that Jaccard similarity or more connect.

    1. Texts of the same words are one node. Fingerprint classes by ``links`` are cut into blocks, to which a few pivots of the class are
       added; links inside a block are verified on whole shingle sets. That is linear, and joins what is much alike.
    2. Fingerprints of so few bits tell a pair at 0.8 seldom, so MinHash bands add candidates. Of a band whose nodes are in different classes
       by now, all outside its largest class are verified against all its nodes, in bounded blocks. So every pair that shares a band is connected or looked at.
    """
    spark = docs.sparkSession
    marked = common.written(sketches(docs, shingle), "sketches")
    total = marked.count()
    reps = marked.groupBy("node").agg(F.min(F.struct("_id", "_key", "fp", "bands")).alias("s")).select("node", "s.*")
    nodes = common.written(reps, "nodes")
    n = nodes.count()
    fps = common.written(nodes.groupBy("fp").agg(F.count("*").alias("n")), "node-fingerprints")
    near = common.written(components(links(fps.select("fp"), fps.count(), bits)), "fingerprint-classes").withColumnRenamed("node", "fp")
    of = common.written(fps.join(near, "fp", "left").select("fp", "n", F.coalesce("label", "fp").alias("group")), "groups-of-fingerprints")
    sizes = of.groupBy("group").agg(F.sum("n").alias("size"), F.count("*").alias("k")).filter("size > 1")
    of = common.join_unique(of, sizes, "group", "k", n).filter("size > 1").select("fp", "n", "group", "size")
    texts = docs.select(_id().alias("_id"), F.xxhash64("text").alias("_key"), "text")
    placed = common.join_unique(nodes.select("_id", "_key", "node", "fp"), of, "fp", "n", n).filter("group is not null")
    placed = placed.withColumns({"blocks": _blocks(F.col("size")), "block": F.pmod(F.xxhash64("node"), _blocks(F.col("size"))).cast("int")})
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(2)), F.greatest(F.ceil(F.col("size") / PIVOTS), F.lit(1))) == 0)
    every = F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block")))
    alike = texts.join(placed, ["_id", "_key"]).dropDuplicates(["node"]).select("node", "fp", "text", "group", every.alias("block"))
    common.python_ready(spark)
    first = common.written(alike.groupBy("group", "block").applyInArrow(_of_block(shingle, least, bits), "u long, v long"), "verified")
    label = common.written(components(first), "first-classes")

    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = common.written(banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "shared-bands")
    labelled = nodes.select("node", "_id", "_key", "bands").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    in_band = common.join_unique(labelled.select("node", "label", F.explode("bands").alias("band")), shared.withColumn("all", F.col("n")), "band", "n", n * jaccard.BANDS).filter("all is not null")
    in_band = common.written(in_band.select("node", "label", "band", "all"), "in-bands")
    shares = in_band.groupBy("band", "label").agg(F.count("*").alias("c")).groupBy("band").agg(F.count("*").alias("kinds"), F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("n"))
    mixed = common.written(shares.filter("kinds > 1").select("band", F.col("most.label").alias("largest"), (F.col("n") - F.col("most.c")).alias("others"), "n"), "mixed-bands")
    rows = common.join_unique(in_band, mixed, "band", "n", n * jaccard.BANDS, "all").filter("largest is not null")
    few = F.col("label") != F.col("largest")
    place = lambda seed, k: F.pmod(F.xxhash64("node", F.lit(seed)), k).cast("int")
    rows = rows.select("node", "label", "band", few.alias("few"), _blocks(F.col("all")).alias("ka"), _blocks(F.col("others")).alias("kb"))
    rows = rows.withColumns({"a": place(3, F.col("ka")), "b": place(4, F.col("kb"))})
    upto = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    one = F.transform(upto("kb"), lambda j: F.struct(F.col("a").alias("i"), j.alias("j"), (F.col("few") & (F.col("b") == j)).alias("few")))
    two = F.transform(F.filter(upto("ka"), lambda i: F.col("few") & (i != F.col("a"))), lambda i: F.struct(i.alias("i"), F.col("b").alias("j"), F.lit(True).alias("few")))
    rows = rows.select("node", "label", "band", F.explode(F.concat(one, two)).alias("to"))
    held = nodes.join(rows.select("node").distinct(), "node", "left_semi").select("node", "_id", "_key", "bands")
    held = texts.join(held, ["_id", "_key"]).dropDuplicates(["node"]).select("node", "bands", "text")
    pairs = rows.join(held, "node").select("node", "label", "bands", "text", "band", F.col("to.i").alias("i"), F.col("to.j").alias("j"), F.col("to.few").alias("few"))
    common.python_ready(spark)
    more = common.written(pairs.groupBy("band", "i", "j").applyInArrow(_of_band(shingle, least), "u long, v long"), "verified-in-bands")
    if more.head(1):
        # between classes, so that few links are left
        names = labelled.select("node", "label")
        between = more.join(names.withColumnsRenamed({"node": "u", "label": "a"}), "u").join(names.withColumnsRenamed({"node": "v", "label": "b"}), "v")
        merged = common.written(components(between.select(F.col("a").alias("u"), F.col("b").alias("v"))), "merged-classes").select(F.col("node").alias("label"), F.col("label").alias("into"))
        labelled = common.join_unique(labelled.select("node", "label"), merged, "label", None, n).select("node", F.coalesce("into", "label").alias("label"))
    final = common.written(labelled.select("node", "label"), "similar-classes")
    return common.join_unique(marked.select("_id", "_key", "node"), final, "node", None, total).select("_id", "_key", "label")


def one_of_each(docs: DataFrame, shingle: int = 5, least: float = 0.8, bits: int = 6) -> DataFrame:
    """``docs`` with the row of the smallest id of each class of near-duplicates (of equal rows, one)."""
    stay = similar_classes(docs, shingle, least, bits).groupBy("label").agg(F.min(F.struct("_id", "_key")).alias("s")).select("s.*")
    mine = common.boxed(docs, _id=_id(), _key=F.xxhash64("text"))
    return mine.join(common.written(stay, "stay"), ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"]).select("_doc.*")
