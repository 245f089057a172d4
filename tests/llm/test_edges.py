"""Odd rows through the queries, held against plain versions that take nothing from the operators but their parameters."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from test_llm import SCHEMA, rows, words

import corpus_pipeline
from loam.llm import common, extraction, media, mixing, packing, quality, simhash, substrings, toxicity


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def plain_logit(m, text):
    """One window after the other, one word after the other."""
    found = regex.findall(r"[^\W_]+", (text or "").lower())
    W, S, H = toxicity.WINDOW, toxicity.STRIDE, toxicity.HIDDEN
    best = -math.inf
    for start in range(0, max(1, math.ceil((len(found) - W) / S) * S + 1), S):
        vec = []
        for w in found[start : start + W]:
            b = w.encode()
            around = b" " + b + b" "
            char = np.zeros(toxicity.DIM)
            for i in range(len(b)):
                g = (around[i] * 0x01000193 + around[i + 1] * 0x9E3779B1 + around[i + 2] * 0x85EBCA77) & 0xFFFFFFFF
                char += m["char"][(g ^ (g >> 15)) % toxicity.CHAR_SLOTS]
            vec.append(m["word"][zlib.crc32(b) % toxicity.WORD_SLOTS] + char / len(b))
        states = {}
        for d in "fb":
            h, states[d] = np.zeros(H), []
            for x in vec if d == "f" else vec[::-1]:
                a, g = x @ m[f"x{d}"] + m[f"b{d}"], h @ m[f"h{d}"]
                z, r = (1 / (1 + np.exp(-(a[i : i + H] + g[i : i + H]))) for i in (0, H))
                n = np.tanh(a[2 * H :] + r * g[2 * H :])
                h = (1 - z) * n + z * h
                states[d].append(h)
        both = [np.concatenate(x) for x in zip(states["f"], states["b"][::-1], strict=True)]
        e = [math.exp(float(np.tanh(h @ m["wa"] + m["ba"]) @ m["va"])) for h in both]
        pooled = sum((k * h for k, h in zip(e, both, strict=True)), np.zeros(2 * H)) / (sum(e) or 1)
        best = max(best, float(pooled @ m["wo"] + m["bo"][0]))
    return best


def test_toxicity_of_odd_rows(spark, odd):
    ids = [i for i, t, *_ in rows() if i is not None]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in ids] + [(3, 0, 0), (99, 1, 1), (None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.op2_toxicity(odd.withColumns({"score": F.lit("x"), "held_out": F.lit("y"), "toxic": F.lit(1)}), labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, *_ in rows())
    a, c = model["cal"]
    want: dict = {}
    for i, t, *_ in rows():
        want.setdefault(i, set()).add(round(1 / (1 + math.exp(-(a * min(20, max(-20, plain_logit(model, t))) + c))), 3))
    for r in got:
        assert any(abs(r["score"] - x) < 2e-3 for x in want[r["doc_id"]]), r
        assert r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    assert len({r["score"] for r in got if r["doc_id"] == 31}) == 1


def test_fingerprints(odd):
    """Majorities of the shingles' XXH64, from the texts themselves."""
    want = Counter()
    for i, t, *_ in rows():
        w = [x.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for x in words(t)]
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        want[i, f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"] += 1
    assert Counter((r["doc_id"], r["fingerprint"]) for r in simhash.op4_simhash(odd).collect()) == want


def test_pages_with_clashing_columns(spark):
    said = [f"Paragraph {k} tells of the long walk over the hills and of the people who went along with it." for k in range(1500)]
    page = "<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article>" + "".join(f"<p>{s}</p>" for s in said) + "</article><footer>&copy; all rights reserved</footer></body></html>"
    d = spark.createDataFrame([(1, "u", page, "a", 1, "b", "c"), (1, "u", page, "a", 1, "b", "c"), (None, "v", "", "a", 1, "b", "c")], "page_id long, url string, html string, text string, n_chars int, _doc string, blocks string")
    got = extraction.op10_extraction(d).collect()
    assert Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got) == Counter({(1, "u", "\n".join(said), len("\n".join(said))): 2, (None, "v", "", 0): 1})


def test_near_copies_share_chunks(spark):
    """Lists in order give the files again, and an insertion costs the chunks near it."""
    r = random.Random(6)
    long_ = " ".join(f"w{r.randrange(10**6)}" for _ in range(60_000))
    d = spark.createDataFrame([(1, long_), (2, long_[:200_000] + " inserted " + long_[200_000:]), (3, long_), (4, "short")], "doc_id long, text string")
    s = media.spool(d)
    lists = {r["doc_id"]: [bytes(x) for x in r["chunks"]] for r in media.manifests(s).collect()}
    data = {bytes(r["digest"]): bytes(r["data"]) for r in s.filter("data IS NOT NULL").collect()}
    files = {r["doc_id"]: media.stored(r["text"]) for r in d.collect()}
    assert {k: hashlib.sha256(b"".join(data[x] for x in v)).digest() for k, v in lists.items()} == {k: hashlib.sha256(v).digest() for k, v in files.items()}
    one, two = set(lists[1]), set(lists[2])
    # the header, which holds the file's size, and what is near the insertion and the end
    assert len(one) >= 20 and len(two - one) <= 5 and lists[1] == lists[3] and len(lists[4]) == 1


def test_bins_are_nearly_full():
    r = random.Random(2)
    for _ in range(40):
        cap, most = r.choice([100, 1024]), r.random()
        counts = Counter(r.randint(1, max(1, int(cap * most))) for _ in range(r.randint(1, 400)))
        made = packing.best_two_fit(dict(counts), cap)
        total = sum(k * n for k, n in counts.items())
        used = sum(n for _, n in made)
        # the bound of first-fit decreasing, over what no packing can go below
        alone = sum(n for k, n in counts.items() if 2 * k > cap)
        assert used <= 11 / 9 * max(-(-total // cap), alone) + 1


def test_mix_comes_in_training_order(odd):
    at = [r["position"] for r in mixing.op6_mixing(odd).collect()]
    taken = [x for x in at if x is not None]
    assert taken == sorted(taken) and at[: len(taken)] == taken and len(at) == len(rows())


def test_names_with_marks(spark):
    d = spark.createDataFrame([(1, "word " * 60 + "and other things that differ.", "x")], "doc_id long, text string, `a``b.c` string")
    assert quality.accepted(d, quality.POLICIES[0]).columns == d.columns


def test_every_stage_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0, name
        assert name == "pack" or out.columns == docs.columns


def test_files_by_number(spark, tmp_path):
    """Sequences follow files 99,999 and 100,000 in the order of their numbers."""
    import os

    for n, i in ((99_999, 1), (100_000, 2)):
        spark.createDataFrame([(i, "word " * 900)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/{n}")
        made = next(f for f in os.listdir(f"{tmp_path}/{n}") if f.startswith("part-"))
        os.makedirs(f"{tmp_path}/docs", exist_ok=True)
        os.rename(f"{tmp_path}/{n}/{made}", f"{tmp_path}/docs/part-{n:05d}-x.parquet")
    got = {r["doc_id"]: r["sequence_id"] for r in corpus_pipeline.pack(spark, spark.read.parquet(f"{tmp_path}/docs"), "").collect()}
    assert got[1] < got[2]


def test_a_passage_of_many_documents_makes_few_windows(spark, monkeypatch):
    """400 documents hold a passage and 300 more are near copies of one text: windows are made of distinct segments, not of each document's."""
    passage, base = [f"p{j}" for j in range(120)], [f"b{j}" for j in range(200)]
    say = lambda i: " ".join([f"x{i}", *passage, f"y{i}"])
    near = lambda i: " ".join([*base[: 20 + i % 5], f"z{i % 5}", *base[21 + i % 5 :], f"end{i}"])
    texts = [(i, say(i)) for i in range(400)] + [(1000 + i, near(i)) for i in range(300)] + [(1000, near(7)), (None, say(1)), (None, say(2000))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    made = {}
    written = common.written
    monkeypatch.setattr(common, "written", lambda df, tag, *a: made.setdefault(tag, written(df, tag, *a)))
    got = Counter(map(tuple, substrings.judged(*substrings.find(docs, hot=(20, 20))).select(F.coalesce("doc_id", F.lit(substrings.LAST)), "n_words", "n_removed").collect()))
    docs_ = [(substrings.LAST if i is None else i, t.split()) for i, t in texts]
    first: dict = {}
    for i, w in docs_:
        for k in range(len(w) - 49):
            first[tuple(w[k : k + 50])] = min(first.get(tuple(w[k : k + 50]), i), i)
    want = Counter()
    for i, w in docs_:
        gone = {x for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for x in range(k, k + 50)}
        want[i, len(w), len(gone)] += 1
    assert got == want
    assert made["segments"].count() + made["windows"].count() < 20_000  # of about 75,000 windows in all
