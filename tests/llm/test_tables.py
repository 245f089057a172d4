"""Prefix trie, archives and hard negatives on odd tables: against SQL, brute force and plain readers of the formats."""

import gzip
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import conversations, negatives, queries, warc

R = random.Random(11)


def talk():
    """(conv_id, turn, role, text): shared beginnings, gaps, ties, repeats, nulls, a long text and a deep conversation."""
    say = [f"turn {i} " + "é" * i for i in range(4)]
    out = [(c, t, ["user", "assistant", None][t % 3], R.choice(say)) for c in [*range(0, 40), *range(95, 130), 205, 301, 399] for t in range(R.randint(1, 7))]
    out += [(400 + k, t, "user", "the same") for k in range(12) for t in range(9)]
    out += [(500, 1, "a", "bc"), (501, 1, "ab", "c"), (502, None, "x", "first"), (502, 0, "x", "second"), (502, 0, "x", "second"), (502, 0, None, None), (503, 3, "", "")]
    out += [(600, t, "u", f"deep {t}") for t in range(300)] + [(601, t, "u", f"deep {t}") for t in range(299)] + [(700, 0, "u", "z" * 200_000)]
    out += [(None, 0, "u", "no id"), (-5, 0, "u", "below zero"), (-150, 0, "u", "b"), (-150, 1, "u", "c"), (9_000_000_000_077, 0, "u", "far")]
    R.shuffle(out)
    return [(*r, "at", "up", 7, "n", "first") for r in out]


TALK = "conv_id long, turn long, role string, text string, at string, up string, place int, n_turns string, first string"


def brute_trie(rows):
    own: dict = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            d = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((t is not None, t or 0, d, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members: dict = {}
    last = Counter()
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        seq = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
        last[c] = len(seq)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    out = []
    for k, m in members.items():
        ids = ",".join(str(c) for c in sorted(c for c in m if last[c] == len(k)))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ids.encode()).hexdigest()))
    return Counter(out)


def test_trie(spark, same, tmp_path, monkeypatch):
    rows = talk()
    df = spark.createDataFrame(rows, TALK)
    monkeypatch.setattr(conversations, "IDS", 3)
    got = Counter(map(tuple, conversations.op11_prefix_trie(df.repartition(5)).collect()))
    assert got == brute_trie(rows)
    df.filter("conv_id IS NULL OR conv_id < 600").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    same(queries.queries()["op11_prefix_trie"](spark, str(tmp_path)), conversations.OP11_SQL, {"conversations": f"{tmp_path}/conversations.parquet/*.parquet"})


def test_trie_of_nothing(spark):
    assert conversations.op11_prefix_trie(spark.createDataFrame([], TALK)).count() == 0
    assert conversations.op11_prefix_trie(spark.createDataFrame([(None, 0, "u", "x", "", "", 0, "", "")], TALK)).count() == 0
    (r,) = conversations.op11_prefix_trie(spark.createDataFrame([(1, 0, "u", "x", "", "", 0, "", "")], TALK)).collect()
    h = zlib.crc32(b"1") % 6
    assert h and tuple(r) == (1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())


def test_running_sums_of_a_key_that_many_tasks_share(spark):
    rows = [(7, i, 1 + i % 5) for i in range(3000)] + [(8, 0, 4), (6, 1, 2), (6, 0, 3)]
    df = spark.createDataFrame(rows, "k long, i long, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["k"], r["i"]): r["v_run"] for r in conversations.running(df, ["k", "i"], ["v"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, sums = {}, Counter()
    for k, i, v in sorted(rows):
        sums[k] += v
        want[k, i] = sums[k]
    assert got == want


PAGES = "page_id long, url string, html string, digest string, n int, size string, file string, first string, _file string"


def site():
    long_, other = "<p>" + "long é " * 60, "<p>" + "x" * 200
    out = [(i, f"http://a/{i}", f"<p>page {i} " + "w " * R.randint(0, 80)) for i in range(40)]
    out += [(50 + i, f"http://b/{i} ü\r\nX: y", long_) for i in range(9)] + [(49, None, long_), (None, "http://c", long_), (None, "", other), (None, "", other)]
    out += [(70, "u", "short"), (71, "u", "short"), (72, "v", None), (73, "v", ""), (74, "w", "y" * 100), (75, "w", "y" * 100), (76, "w", "y" * 99), (77, "w", "y" * 99)]
    out += [(80, "r", "z" * 300), (80, "r", "z" * 300), (80, "r", "z" * 300), (81, "big", "<b>\r\n\r\n" * 300_000)]
    return [(*r, "d", 1, "s", "f", "o", "p") for r in out]


def test_archives(spark, same, tmp_path):
    rows = site()
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    table = {"pages": f"{tmp_path}/pages.parquet/*.parquet"}
    same(warc.op12_warc(df), warc.OP12_SQL, table)
    same(queries.queries()["op12_warc"](spark, str(tmp_path)), warc.OP12_SQL, table)
    index = warc.write(df, file_bytes=2000)
    held = index.collect()
    assert len(held) == len(rows) and len({r["file"] for r in held}) > 3
    assert Counter((r["page_id"], r["url"]) for r in held) == Counter(r[:2] for r in rows)
    n = 0
    for f in {r["file"] for r in held}:  # a plain reader of the whole file finds what the index names
        data = open(f.removeprefix("file:"), "rb").read()
        plain = gzip.decompress(data)
        assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        n += sum(plain.count(f"WARC-Type: {t}\r\n".encode()) for t in ("response", "revisit"))
        for r in (r for r in held if r["file"] == f):
            one = gzip.decompress(data[r["offset"] : r["offset"] + r["length"]])
            assert one.startswith(b"WARC/1.1\r\n") and r["digest"].encode() in one
    assert n == len(rows)
    some = warc.read(index.filter("page_id IN (3, 81, 55, 49)")).collect()
    texts = {r[0]: r[2] for r in rows}
    assert {(r["page_id"], r["record_type"]) for r in some} == {(3, "response"), (81, "response"), (55, "revisit"), (49, "response")}
    assert all(r["payload"].decode() == texts[r["page_id"]] for r in some if r["record_type"] == "response")


def test_archives_of_nothing(spark):
    assert warc.op12_warc(spark.createDataFrame([], PAGES)).count() == 0


def test_ranges():
    assert warc.ranges([], [], []) == []
    assert warc.ranges(["a", "a", "a", "b"], [0, 10, 10 + warc.GAP + 11, 0], [10, 10, 5, 5]) == [(0, 2), (2, 3), (3, 4)]
    assert warc.ranges(["a", "a"], [0, warc.READ_BYTES], [warc.READ_BYTES, 1]) == [(0, 1), (1, 2)]


def test_a_changed_archive_is_found(spark):
    index = warc.write(spark.createDataFrame([(1, "u", "h" * 500)], "page_id long, url string, html string"))
    (r,) = index.collect()
    name = r["file"].removeprefix("file:")
    data = open(name, "rb").read()
    fields, block = warc.parsed(data[r["offset"] :])
    forged = warc.record([(k, v) for k, v in fields.items() if k != "Content-Length"], block[:-1] + b"j")
    open(name, "wb").write(data[: r["offset"]] + forged)
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read(index.withColumn("length", F.lit(len(forged)))).collect()


VECTORS = "vec_id long, embedding array<double>, label int, id long, q string, place long, near string, score int"


def vectors():
    g = np.random.default_rng(13)
    out = [(i, (g.normal(size=6) + 2 * (i % 3 == 0)).tolist(), i % 4) for i in range(160)]
    out += [(200 + i, out[50][1], 50 % 4) for i in range(30)] + [(300 + i, out[100][1], i % 4) for i in range(30)]  # copies, ties
    out += [(100, out[100][1], 0), (None, out[3][1], 0), (None, out[50][1], 1), (450, [0.0] * 6, 1), (451, [0.0] * 6, 2), (452, [0.0] * 6, 1), (500, out[0][1], 77), (550, [1.0, 2.0], 2), (600, [], 3)]
    out += [(350, None, 1), (400, [1.0] * 6, None), (650, [1.0, None, 1.0, 1.0, 1.0, 1.0], 2), (700, [float("nan")] * 6, 2), (750, [float("inf")] * 6, 1), (800, [-float("inf")] * 6, 1), (950, [1e5] * 6, 1)]
    return [(*r, 1, "q", 2, "n", 3) for r in out]


def brute_negatives(rows, low=50, high=95):
    v = []
    for i, x, label, *_ in rows:
        if label is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            v.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [int(np.floor(256 * c)) for c in x]))
    order = lambda s: (-s[1], v[s[0]][0] is None, v[s[0]][0] or 0)
    out = Counter()
    for a, (i, label, q) in enumerate(v):
        if i is None or i % 50:
            continue
        s = sorted(((b, sum(m * n for m, n in zip(q, w[2], strict=False))) for b, w in enumerate(v) if b != a), key=order)
        for p, ps in [x for x in s if v[x[0]][1] == label][:5]:
            hits = [x for x in s if v[x[0]][1] != label and low * ps <= 100 * x[1] <= high * ps][:3]
            for k, (b, ns) in enumerate(hits):
                out[i, v[p][0], k + 1, v[b][0], ps, ns] += 1
    return out


@pytest.mark.parametrize("block", [negatives.ANCHORS, 3])
def test_negatives(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mined(negatives.prepared(df, "vec_id", label, "embedding"), F.col("id") % 50 == 0, block=block)
    want = brute_negatives(rows)
    assert sum(want.values()) > 30 and Counter(map(tuple, got.collect())) == want


def test_negatives_sql_and_none(spark, same, tmp_path):
    df = spark.createDataFrame([r for r in vectors() if r[1] is None or len(r[1]) == 6], VECTORS)
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    same(queries.queries()["op13_hard_negatives"](spark, str(tmp_path)), negatives.OP13_SQL, {"embeddings": f"{tmp_path}/embeddings.parquet/*.parquet"})
    assert negatives.op13_hard_negatives(df.limit(0)).count() == 0
    assert negatives.op13_hard_negatives(df.filter("embedding IS NULL")).count() == 0


def test_brackets_hold_and_prune():
    g = np.random.default_rng(5)
    centres = g.normal(size=(6, 16)) * 300
    x = np.floor(np.concatenate([c + g.normal(size=(40, 16)) for c in centres]))
    space = negatives.Space(float((x * x).sum(1).max()), x[::7])
    q = x[::40]
    low, high = space.bracket((q * q).sum(1), space.anchors(q), space.rows(x))
    s = q @ x.T
    assert (low <= s).all() and (s <= high).all()
    ceiling = np.sort(s, axis=1)[:, -30, None]
    assert (high < ceiling).mean() > 0.3  # rows that needn't be scored to find the best thirty


def test_large_components_are_exact():
    q = np.array([[1 << 27, -(1 << 27), 12345]])
    assert negatives.exact(q, q).tolist() == [[2 * (1 << 54) + 12345**2]]


def test_repeated_rows_each_get_one_place(spark):
    """Rows that share id, source and text meet by number: the join's rows are those of its sides, and neither side moves for it."""
    from loam.llm import mixing

    rows = [(1, "same words here", f"l{i % 3}", "s") for i in range(4000)] + [(2 + i, f"other {i} " * 3, "l", "t") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mix = mixing.ordered(df)
    plan = mixing.plan(df.select("doc_id", "source", "text"))
    copies = plan.select((F.when(2 * F.col("_first") >= F.col("size"), 1).otherwise(0) + F.when(2 * F.col("_second") >= F.col("size"), 1).otherwise(0)).alias("n"))
    assert mix.count() == copies.agg(F.sum("n")).first()[0]
    text = mix._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in text.split("\n") if "SortMergeJoin" in x and "key" in x and "m" in x]
    assert any("[key" in x and ", m" in x for x in joins)
