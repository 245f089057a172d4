"""Searches and records over kept answers, by file URLs; digests that must equal others'."""

import hashlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from loam import config as C
from loam.config import LICENCE_FILTERS
from loam.functions import digests
from loam.operators import classify, dedup
from loam.sources import articles, search
from test_corpus_operators import loop

TOPICS = [("gait", "gait AND training"), ("hand", "hand OR wrist")]


def answers(tmp_path, found, size):
    for (topic, licence), ids in found.items():
        for start in range(0, len(ids) + size, size):
            (tmp_path / f"{topic}-{licence}-{start}.json").write_text(json.dumps({"esearchresult": {"idlist": ids[start : start + size]}}))
    return f"file://{tmp_path}/{{topic}}-{{licence}}-{{start}}.json"


@pytest.mark.parametrize("tasks", [1, 3, 50])
def test_pages_of_searches(spark, tmp_path, tasks):
    r = random.Random(3)
    found = {(t, k): [str(r.randrange(30)) for _ in range(n)] for (t, _), n in zip(TOPICS, (7, 0), strict=True) for k in LICENCE_FILTERS}
    url = answers(tmp_path, found, 3)
    for start in range(0, 12, 3):  # tasks that share a search's pages may ask past its end
        for t, k in found:
            p = tmp_path / f"{t}-{k}-{start}.json"
            if not p.exists():
                p.write_text('{"esearchresult": {"idlist": []}}')
    got = search.search(spark, url, TOPICS, size=3, most=12, tasks=tasks, interval=0)
    assert got.rdd.getNumPartitions() == min(tasks, 24)
    assert {(r["topic"], r["licence"], r["rank"], r["id"]) for r in got.collect()} == {(t, k, i, x) for (t, k), ids in found.items() for i, x in enumerate(ids)}
    merged = {r["id"]: (r["score"], tuple(r["topics"]), tuple(r["licences"])) for r in articles.merge_found(got, {"gait": 2.0, "hand": 1.0}).collect()}
    ids = {x for v in found.values() for x in v}
    assert merged == {x: (2.0, ("gait",), tuple(sorted(k for (_, k), v in found.items() if x in v))) for x in ids}


def test_most_limits_a_search(spark, tmp_path):
    url = answers(tmp_path, {("gait", k): [str(i) for i in range(9)] for k in LICENCE_FILTERS}, 3)
    got = search.search(spark, url, TOPICS[:1], size=3, most=6, interval=0)
    assert sorted(r["rank"] for r in got.collect()) == sorted(list(range(6)) * 3)
    with pytest.raises(Exception, match="must be positive"):
        search.search(spark, url, TOPICS[:1], size=0).collect()


RECORD = """<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><GetRecord><record><header><identifier>oai:1</identifier></header><metadata>
<oai_dc:dc xmlns:oai_dc="http://www.openarchives.org/OAI/2.0/oai_dc/" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title> A walk </dc:title><dc:language>en</dc:language>
<dc:identifier>PMC1</dc:identifier><dc:identifier>10.1/x</dc:identifier><dc:rights>https://creativecommons.org/licenses/by/4.0/</dc:rights><dc:rights> </dc:rights></oai_dc:dc></metadata></record></GetRecord></OAI-PMH>"""


def test_records(spark, tmp_path):
    (tmp_path / "1.xml").write_text(RECORD)
    (tmp_path / "2.xml").write_text("<OAI-PMH><error>none</error></OAI-PMH>")
    ids = spark.createDataFrame([("1",), ("2",), ("1",), ("3",), (None,)], "id string")
    got = search.fetched(ids, f"file://{tmp_path}/{{id}}.xml", tasks=2, interval=0).withColumn("r", search.record(F.col("body")))
    rows = {r["id"]: r for r in got.withColumn("licence", classify.licence_of_rights(F.col("r.rights"))).collect()}
    assert len(rows) == 3 and rows["3"]["body"] is None and "URLError" in rows["3"]["error"] and rows["1"]["error"] is None
    assert rows["1"]["r"].asDict() == {"rights": ["https://creativecommons.org/licenses/by/4.0/"], "language": ["en"], "title": ["A walk"], "identifier": ["PMC1", "10.1/x"]}
    assert rows["1"]["licence"] == "CC-BY" and rows["2"]["r"].asDict() == {k: [] for k in ("rights", "language", "title", "identifier")} and rows["2"]["licence"] is None


def test_requests_keep_apart(tmp_path):
    (tmp_path / "x").write_text("y")
    client, t = search.Client(0.05), time.monotonic()
    assert [client.get(f"file://{tmp_path}/x") for _ in range(4)] == [b"y"] * 4
    assert time.monotonic() - t >= 0.15


def blake(s):
    return int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big")


def test_blake2b(spark):
    texts = ["", "a", "é" * 100, "x" * 127, "x" * 128, "x" * 129, "long " * 5000]
    df = spark.createDataFrame([(0, texts), (1, []), (2, None), (3, [None, "a"])], "k int, t array<string>").repartition(2)
    got = {r["k"]: r["h"] for r in df.select("k", digests.blake2b_64(F.col("t")).alias("h")).collect()}
    assert [x % 2**64 for x in got[0]] == [blake(t) for t in texts]
    assert got[1] == [] and got[2] is None and got[3][0] is None and got[3][1] % 2**64 == blake("a")


def plain_signature(values, d):
    p, r = 2**61 - 1, random.Random(d["seed"])
    perm = [(r.randrange(1, p), r.randrange(0, p)) for _ in range(d["num_perm"])]
    return [min(((a * (v % p) + b) % p for v in values), default=p) for a, b in perm]


def test_signature_is_that_of_whole_numbers(spark):
    """Over all 64 bits, the prime and its neighbours included."""
    p, r = 2**61 - 1, random.Random(4)
    sets = [[0], [p], [p - 1], [p + 1], [2**64 - 1], [2**63], [2**63 - 1], [7 * p], [8 * p + 7], [], [r.randrange(2**64) for _ in range(300)], [r.randrange(2**60) for _ in range(50)]]
    sets = [[v % 2**64 for v in s] for s in sets]
    rows = [(k, [v - 2**64 if v >= 2**63 else v for v in s]) for k, s in enumerate(sets)]
    got = {r["ord"]: r["sig"] for r in dedup.signatures(spark.createDataFrame(rows, "ord long, shingles array<long>"), C.NEAR).collect()}
    assert got == {k: plain_signature(s, C.NEAR) for k, s in enumerate(sets)}


def test_near_by_blake2b_is_the_loop(spark):
    """Nothing of the library in what it is held against: shingles, signatures and bands by Python's whole numbers."""
    r, d, n = random.Random(9), {**C.NEAR, "jaccard_threshold": 0.6}, C.NEAR["shingle_size"]
    base = [[f"b{i}w{j}" for j in range(60)] for i in range(3)]
    rows = []
    for o in range(60):
        w = list(base[o % 3])
        for _ in range(r.choice([0, 1, 2, 3])):
            w[r.randrange(60)] = f"X{r.randrange(6)}"
        rows.append((o, " ".join(w) + r.choice(["", " "]), w))
    rows += [(100, "", []), (101, "-", []), (102, "one", ["one"])]
    sets, bands, per = {}, {}, d["num_perm"] // d["bands"]
    for o, _, w in rows:
        w = [x.lower() for x in w]
        sets[o] = frozenset(blake(" ".join(w[i : i + n])) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
        sig = plain_signature(sets[o], d)
        bands[o] = {(b, tuple(sig[b * per : (b + 1) * per])) for b in range(d["bands"])}
    df = spark.createDataFrame(rows, "ord long, sha string, words array<string>")
    got = {r["ord"]: (r["verdict"], r["duplicate_of"], r["jaccard"]) for r in dedup.near(df, d, shingles=digests.shingles).collect()}
    assert got == loop([(o, sha, sets[o]) for o, sha, _ in rows], bands, d)
    assert {v[0] for v in got.values()} == {"accepted", "exact_duplicate", "near_duplicate"}
    assert all({x % 2**64 for x in r["s"]} == sets[r["ord"]] for r in df.select("ord", digests.shingles(F.col("words"), n).alias("s")).collect())
