"""A stream that fails and goes on gives what one pass over all files gives; snapshots are there while it runs."""

import json
import random
import time
from collections import Counter

import pytest

from loam import config as C
from loam.streaming import progress
from loam.streaming.select import STAGES, json_documents, select_stream, stage_counts


def documents():
    r = random.Random(4)
    long_ = [" ".join(r.choice(["the", "der", "que", "words", f"w{k}"]) for _ in range(300)) for k in range(12)]
    out = [(f"d{i:03}", r.choice(long_) + r.choice(["", " ", "  "]), "cc by") for i in range(60)]
    out += [(None, long_[0], "cc by"), ("x1", long_[1], None), ("x2", "xyz " * 300, "cc0"), ("x3", "the", "cc0"), ("x4", None, "cc0")]
    return out


def files(path, rows, n):
    path.mkdir(parents=True)
    for k in range(n):
        f = path / f"part-{k}.json"
        f.write_text("".join(json.dumps({"id": i, "text": t, "licence": x}) + "\n" for i, t, x in rows[k::n]))
        time.sleep(0.02)  # files are taken by their time


def expected(rows, n):
    """Files in turn; in each, the least id of a text is first."""
    firsts, out = {}, {}
    for k in range(n):
        part = rows[k::n]
        for i, t, x in sorted(part, key=lambda r: r[0] or ""):
            if i is None or x is None:
                stage = STAGES[0]
            elif "xyz" in (t or "xyz"):
                stage = STAGES[1]
            elif len(t.split()) < 250:
                stage = STAGES[2]
            else:
                stage = STAGES[3] if t.strip() in firsts else STAGES[4]
                firsts.setdefault(t.strip(), i)
            out[i] = (stage, firsts[t.strip()] if stage == STAGES[3] else None)
    return out


def found(spark, sink):
    return {r["id"]: (r["stage"], r["duplicate_of"]) for r in spark.read.parquet(f"{sink}/rows").collect()}


def test_a_restart_changes_nothing(spark, tmp_path):
    rows = documents()
    files(tmp_path / "in", rows, 6)
    sink = f"{tmp_path}/out"

    def fails(trigger):
        if trigger == 2:
            raise RuntimeError("lost the sink")

    q = select_stream(json_documents(spark, f"{tmp_path}/in", 1), sink, f"{tmp_path}/check", C.TEST_TOPICS, then=fails)
    with pytest.raises(Exception, match="lost the sink"):
        q.awaitTermination(120)
    assert 0 < sum(r["n"] for r in stage_counts(spark, sink).collect()) < len(rows)
    select_stream(json_documents(spark, f"{tmp_path}/in", 1), sink, f"{tmp_path}/check", C.TEST_TOPICS).awaitTermination(120)
    want = expected(rows, 6)
    assert found(spark, sink) == want
    assert {r["stage"]: r["n"] for r in stage_counts(spark, sink).collect()} == Counter(s for s, _ in want.values())
    # nothing new: nothing changes
    select_stream(json_documents(spark, f"{tmp_path}/in", 1), sink, f"{tmp_path}/check", C.TEST_TOPICS).awaitTermination(120)
    assert found(spark, sink) == want


def test_snapshots_while_it_runs(spark, tmp_path):
    rows = documents()
    files(tmp_path / "in", rows, 4)
    path = f"file://{tmp_path}/state/progress.json"
    seen = []
    watch = progress.Snapshots(path)
    spark.streams.addListener(watch)

    def look(trigger):
        for _ in range(100):  # listeners hear of a trigger a little after it
            now = progress.get(path)
            if trigger == 0 or (now and now["trigger"] >= trigger - 1):
                break
            time.sleep(0.1)
        seen.append(now)

    try:
        select_stream(json_documents(spark, f"{tmp_path}/in", 1), f"{tmp_path}/out", f"{tmp_path}/check", C.TEST_TOPICS, then=look).awaitTermination(120)
        for _ in range(100):
            if progress.get(path)["state"] == "done":
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(watch)
    scanned = [s["counts"].get("scanned", 0) for s in seen if s]
    assert scanned == sorted(scanned) and 0 < scanned[-1] < len(rows) and all(s["state"] == "running" for s in seen if s)
    last = progress.get(path)
    assert last["state"] == "done" and last["counts"]["scanned"] == len(rows)
    assert {s: last["counts"][s] for s in STAGES} == {s: sum(x == s for x, _ in expected(rows, 4).values()) for s in STAGES}
    assert progress.Snapshots(path).now == last
    assert [p.name for p in (tmp_path / "state").iterdir() if not p.name.endswith(".crc")] == ["progress.json"]


def test_a_stream_is_read_once(spark, tmp_path):
    """Each row is read and judged once, whether it passes or fails; what fails leaves no state."""
    rows = documents()
    files(tmp_path / "in", rows, 3)
    q = select_stream(json_documents(spark, f"{tmp_path}/in", 1), f"{tmp_path}/out", f"{tmp_path}/check", C.TEST_TOPICS)
    q.awaitTermination(120)
    assert sum(p["numInputRows"] for p in q.recentProgress) == len(rows)
    want = expected(rows, 3)
    assert found(spark, f"{tmp_path}/out") == want
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) == sum(s == "accepted" for s, _ in want.values())
