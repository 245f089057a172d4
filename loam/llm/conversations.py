"""Conversation prefix trie: every distinct beginning of a conversation is a node, with what sharing it would save.

A node is keyed by a digest of its turns, so equal beginnings meet without their texts being moved: only digests and lengths leave the scan. The
digest of a beginning is the sum, modulo 2^32 in each of four limbs, of SHA-256 digests of (place, turn), so beginnings are running sums.

* Places and running sums come from one pass over rows in range order (``running``): tasks hold ranges of rows, so a conversation of any length is
  dealt to several; what a range needs of those before it is a row a range.
* Nodes are sums over keys, pre-aggregated where the rows are. Each has a parent edge by digest.
* Leaf counts and savings reach all ancestors by pointer jumping (``rolled``): in round k a node hands its sums to its 2^k-th ancestor and
  takes that one's pointer, so a trie of depth d takes about log2(d) rounds, each a written table of the nodes that have such an ancestor.
* The digest of the conversations that end in a node is one SHA-256 over their ids in order. Ranges of ids are joined into strings where they lie,
  then each node's strings stream through one hash, in memory of one string.

Edge cases: rows with a null conv_id take no part; a null turn comes first; a null role or text is empty; rows of one conversation and turn follow
each other by SHA-256 of role and text, so repeated rows are turns of their own; a text of any length counts whole; an empty table gives no node, also
no root. Columns beyond conv_id, turn, role and text, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import python_ready, quoted, written

#: A conversation takes its first turns, h of them, from the first of its FAMILY; h is below HEADS.
FAMILY, HEADS = 100, 6
#: Ids in one string on the way to a node's digest.
IDS = 4096
LIMBS = ["l0", "l1", "l2", "l3"]
_LOW, _FULL = 0x7FFFFFFF, 0xFFFFFFFF


def running(df: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """``df`` with each of ``sums`` (long, not negative) summed over the rows of the same ``order[0]`` up to and with this row.

    The rows are dealt in ranges of ``order``. At most one key goes on from a range to the next, so what is carried over is at most a row a range.
    """
    key = order[0]

    def run(batches):
        part, last, carry = TaskContext.get().partitionId(), None, [0] * len(sums)
        for b in batches:
            if not b.num_rows:
                continue
            of = b.column(key).to_numpy()
            new = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            at = np.zeros(len(of), np.int64)
            at[new[1:]] = 1
            at = np.cumsum(at)
            goes_on = (new[1] if len(new) > 1 else len(of)) if of[0] == last else 0
            last, cols = of[-1], {name: b.column(name) for name in b.schema.names}
            for j, name in enumerate(sums):
                c = np.cumsum(b.column(name).to_numpy())
                c = c - np.where(new == 0, 0, c[new - 1])[at]
                c[:goes_on] += carry[j]
                carry[j] = c[-1]
                cols[f"{name}_run"] = pa.array(c)
            yield pa.RecordBatch.from_pydict(cols | {"_part": pa.array(np.full(len(of), part, np.int32))})

    python_ready(df.sparkSession)
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + "".join(f", {s}_run long" for s in sums) + ", _part int"
    local = written(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, out), "running")
    parts = local.groupBy(key, "_part").agg(*[F.max(f"{s}_run").alias(s) for s in sums])
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(key, "_part", *[F.sum(s).over(before).alias(f"{s}_before") for s in sums]).filter(F.col(f"{sums[0]}_before").isNotNull())
    both = local.join(F.broadcast(carried), [key, "_part"], "left")
    return both.select(*df.columns, *[(F.col(f"{s}_run") + F.coalesce(f"{s}_before", F.lit(0))).alias(f"{s}_run") for s in sums])


def _number(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, a, b, chars): each turn's place from 0, 120 bits of its SHA-256 and its text's code points."""
    role, text = (F.coalesce(quoted(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.select(quoted("conv_id").cast("long").alias("conv_id"), quoted("turn").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    rows = rows.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", _number(F.col("digest"), 1, 15).alias("a"), _number(F.col("digest"), 16, 15).alias("b"), "chars", F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("tie")
    )
    return running(rows, ["conv_id", "turn", "a", "b", "tie"], ["one"]).select("conv_id", (F.col("one_run") - 1).alias("place"), "a", "b", "chars")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, place, a, b, chars, n_turns) and all conversations (conv_id, n_turns).

    The first h turns of conversation c are those of c - c % FAMILY, all if it has fewer; then come c's own after its first h; h is crc32(c) % HEADS.
    """
    own = turns(conversations)
    c = F.col("conv_id")
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"h": F.crc32(c.cast("string").cast("binary")) % HEADS, "base": c - c % FAMILY})
    convs = written(convs, "conversations")
    bases = convs.filter(c % FAMILY == 0).select(c.alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.join(bases, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    # a base has few turns here and fewer than 2 * FAMILY conversations
    first = own.filter((c % FAMILY == 0) & (F.col("place") < HEADS - 1)).withColumnRenamed("conv_id", "base")
    heads = first.join(convs, "base").filter("place < h").select("conv_id", "place", "a", "b", "chars", "n_turns")
    rest = own.join(convs.select("conv_id", "h", "taken", "n_turns"), "conv_id").filter("place >= h")
    rest = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "a", "b", "chars", "n_turns")
    return heads.unionByName(rest), convs.select("conv_id", "n_turns")


def _key(depth: Column, limbs: list[Column]) -> Column:
    pair = lambda x, y: F.shiftleft(x.bitwiseAND(_LOW), 32).bitwiseOR(y.bitwiseAND(_FULL))
    return F.struct(depth.cast("long").alias("depth"), pair(*limbs[:2]).alias("k0"), pair(*limbs[2:]).alias("k1"))


def _root() -> Column:
    return F.struct(*[F.lit(0).cast("long").alias(x) for x in ("depth", "k0", "k1")])


def prefixes(rows: DataFrame) -> DataFrame:
    """Each rebuilt turn with the digest key of the beginning that ends with it (at) and of the one before (up)."""
    place = F.sha2(F.concat_ws(":", F.col("place").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256)
    rows = rows.withColumn("_d", place).withColumns({x: _number(F.col("_d"), 1 + 8 * i, 8) for i, x in enumerate(LIMBS)}).drop("_d", "a", "b")
    runs = running(rows, ["conv_id", "place"], LIMBS)
    now, before = [F.col(f"{x}_run") for x in LIMBS], [F.col(f"{x}_run") - F.col(x) for x in LIMBS]
    at, up = _key(F.col("place") + 1, now), _key(F.col("place"), before)
    return runs.select("conv_id", at.alias("at"), up.alias("up"), "chars", (F.col("place") + 1 == F.col("n_turns")).alias("ends"))


def rolled(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(at, *values): ``values`` of ``nodes`` (at, up, depth, *values; up null at the root) summed over each node's subtree, by pointer jumping."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = [nodes.select("at", *values)]
    active = written(nodes.filter("up IS NOT NULL").select("at", "up", *values), "pointers")
    for k in range(deepest.bit_length()):  # up leads to the 2^k-th ancestor; values hold the sums of descendants nearer than that
        handed = active.groupBy(F.col("up").alias("at")).agg(*[F.sum(v).alias(v) for v in values])
        sums.append(handed)
        if 2 << k > deepest:
            break
        more = handed.select("at", *[F.col(v).alias(f"{v}_more") for v in values])
        fed = active.join(more, "at", "left").select("at", "up", *[(F.col(v) + F.coalesce(f"{v}_more", F.lit(0))).alias(v) for v in values])
        hops = active.select(F.col("at").alias("up"), F.col("up").alias("next"))
        active = written(fed.join(hops, "up").select("at", F.col("next").alias("up"), *values), "pointers")
    total = sums[0]
    for s in sums[1:]:
        total = total.unionByName(s)
    return total.groupBy("at").agg(*[F.sum(v).alias(v) for v in values])


_PIECES = pa.schema([("depth", pa.int64()), ("k0", pa.int64()), ("k1", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])


def _pieces(batches):
    """Rows in order of (depth, k0, k1, conv_id) to strings of at most IDS ids of one node."""
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy() for c in ("depth", "k0", "k1")]
        ids = b.column("conv_id").to_numpy()
        new = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols]))
        new[::IDS] = True
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(ids))
        strings = [",".join(map(str, ids[i:j].tolist())) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*[pa.array(c[lo]) for c in cols], pa.array(ids[lo]), pa.array(strings)], schema=_PIECES)


def _hashed(batches):
    """Strings in order of (depth, k0, k1, first) to one digest a node; holds a hash and one batch."""
    now, h = None, None
    names = ["depth", "k0", "k1", "sha"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([*[pa.array([r[0][i] for r in rows], pa.int64()) for i in range(3)], pa.array([r[1] for r in rows], pa.string())], names=names)

    for b in batches:
        out = []
        for *key, ids in zip(*(b.column(c).to_pylist() for c in ("depth", "k0", "k1", "ids")), strict=True):
            if key == now:
                h.update(b"," + ids.encode())
            else:
                if h:
                    out.append((now, h.hexdigest()))
                now, h = key, hashlib.sha256(ids.encode())
        yield batch(out)
    if h:
        yield batch([(now, h.hexdigest())])


def ends(members: DataFrame) -> DataFrame:
    """(at, ends_sha256): SHA-256 of the ids, ascending and joined by commas, of each node's rows in ``members`` (at, conv_id)."""
    python_ready(members.sparkSession)
    key = ["depth", "k0", "k1"]
    rows = members.select("at.*", "conv_id")
    pieces = rows.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(_pieces, "depth long, k0 long, k1 long, first long, ids string")
    got = pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(_hashed, "depth long, k0 long, k1 long, sha string")
    return got.select(F.struct(*key).alias("at"), F.col("sha").alias("ends_sha256"))


def trie(conversations: DataFrame) -> DataFrame:
    """A row per node: its key (at), its parent's (up) and what the op11 query returns."""
    rows, convs = rebuilt(conversations)
    convs = written(convs, "lengths")
    marks = written(prefixes(rows), "prefixes")
    found = marks.groupBy("at").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("up").alias("up"), F.first("chars").alias("chars"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(_root().alias("at"), "conv_id", "n_convs", F.lit(None).cast("struct<depth:long,k0:long,k1:long>").alias("up"), F.lit(0).cast("long").alias("chars"))
    nodes = written(found.unionByName(root), "nodes")
    children = nodes.filter("up IS NOT NULL").groupBy(F.col("up").alias("at")).agg(F.count("*").alias("n_children"))
    ended = ends(marks.filter("ends").select("at", "conv_id").unionByName(convs.filter("n_turns = 0").select(_root().alias("at"), "conv_id")))
    nodes = nodes.join(children, "at", "left").join(ended, "at", "left")
    nodes = written(nodes.fillna({"n_children": 0, "ends_sha256": hashlib.sha256().hexdigest()}), "nodes")
    own = nodes.select(
        "at", "up", F.col("at.depth").alias("depth"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")
    )
    parents = nodes.select(F.col("at").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.drop("chars").join(rolled(own, ["n_leaves", "saved_tokens"]), "at").join(parents, "up", "left")


def op11_prefix_trie(conversations: DataFrame) -> DataFrame:
    got = trie(conversations).withColumn("depth", F.col("at.depth"))
    return got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: crc32 of the decimal id, by its definition: a byte at a time, eight shifts each.
_CRC = """xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT),
    lambda c, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda a, z: xor(a >> 1, (a & 1) * 3988292384::UBIGINT), xor(c, x)),
    4294967295::UBIGINT), 4294967295::UBIGINT)"""

OP11_SQL = f"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) - 1 AS place, d, chars FROM (
    SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
      sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d
    FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, count(*) AS n, ({_CRC} % 6)::BIGINT AS h, conv_id - conv_id % 100 AS base FROM own GROUP BY conv_id
), sized AS (
  SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken FROM convs c LEFT JOIN convs b ON b.conv_id = c.base
), turns AS (
  SELECT s.conv_id, o.place, o.d, o.chars FROM sized s JOIN own o ON o.conv_id = s.base AND o.place < s.h
  UNION ALL
  SELECT s.conv_id, o.place - s.h + s.taken, o.d, o.chars FROM sized s JOIN own o ON o.conv_id = s.conv_id AND o.place >= s.h
), marks AS (
  SELECT conv_id, place + 1 AS depth, chars, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY place) AS pre FROM turns
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs
), ended AS (
  SELECT pre, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(pre, depth) AS pre FROM marks GROUP BY conv_id) GROUP BY pre
), nodes AS (
  SELECT pre, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved FROM marks GROUP BY pre, depth
), kin AS (
  SELECT n.*, left(n.pre, 64 * (n.depth - 1)::INTEGER) AS up, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND left(c.pre, length(n.pre)) = n.pre) AS n_children FROM nodes n
), below AS (
  SELECT m.pre, sum((k.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(k.saved)::BIGINT AS saved_tokens
  FROM kin k JOIN marks m ON m.conv_id = k.conv_id AND m.depth <= k.depth GROUP BY m.pre
)
SELECT k.conv_id, k.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, b.n_leaves, b.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM kin k JOIN below b USING (pre) LEFT JOIN ended e USING (pre) LEFT JOIN nodes p ON k.depth > 0 AND p.pre = k.up
"""
