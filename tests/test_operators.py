"""The rules of the operators on small inputs, and brute-force restatements."""

import random
import re

import pytest
import sentencepiece
from pyspark.sql import functions as F

from loam import config as C
from loam.functions import text as T
from loam.operators import classify, cleaning, dedup, instructions, numeric, quality, reports, tokens
from loam.plans import corpus
from loam.sources import articles, sinks


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


def test_normalise(spark):
    assert one(spark, "A   rehab\r\n\r\n\r\nrobot  \n", T.normalise_text) == "A rehab\n\nrobot"
    assert one(spark, None, T.normalise_text) == ""


def test_normalise_random(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(["a", "B", " ", "\t", "\n", "\r\n", "\r", "\x00", "\x0b", "\x1c", "\x85", " ", "\xa0", "　"]) for _ in range(r.randint(0, 20))) for _ in range(400)]

    def plain(t):
        t = t.replace("\x00", " ").replace("\r\n", "\n").replace("\r", "\n")
        t = "\n".join(re.sub(r"[ \t]+", " ", x).strip() for x in t.splitlines())
        return re.sub(r"\n{3,}", "\n\n", t).strip()

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", T.normalise_text(F.col("t")).alias("y")).collect()
    assert {r["i"]: r["y"] for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def test_words_random(spark):
    r = random.Random(6)
    texts = ["".join(r.choice(list("ab_1-' .é漢²")) for _ in range(r.randint(0, 12))) for _ in range(300)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", T.word_tokens(F.col("t")).alias("y")).collect()
    assert {r["i"]: r["y"] for r in got} == {i: re.findall(r"\b[\w'-]+\b", t) for i, t in enumerate(texts)}


def test_metrics_of_nothing(spark):
    m = one(spark, "", quality.metrics)
    assert (m["words"], m["median_word_length"], m["duplicate_line_fraction"]) == (0, 0.0, 1.0)
    m = one(spark, "A a\nb\na A\na a\n\n", quality.metrics)
    assert m["duplicate_line_fraction"] == 1 - 1 / 4


def test_cleaning(spark):
    t = "Introduction {#sec1}\nText.\n2. Competing interests\nThe authors declare that they have no competing interests.\n\nAuthors' contributions\nAll did.\nConclusion\nFine."
    c = one(spark, t, cleaning.clean)
    assert c["text"] == "Introduction\nText.\nConclusion\nFine."
    assert c["sections"] == {"competing_interests": 3, "author_contributions": 2} and c["anchors"] == 1
    c = one(spark, "Clean text.\n\nMore of it.", cleaning.clean)
    assert c["text"] == "Clean text.\n\nMore of it." and c["removed_chars"] == 0
    m = one(spark, t, cleaning.contamination)
    assert m["heading:competing_interests"] == 1 and m["inline:no_competing_interests"] == 1 and m["markup:section_anchor"] == 1


def test_classifier(spark):
    of = lambda t: one(spark, t, lambda c: classify.classify_text(c, C.TOPICS))
    assert of("Stroke rehabilitation with an exoskeleton and wheelchair") == "robotics"
    assert of("Rehabilitation by motor imagery") == "neurotechnology"
    assert of("Physiotherapy after stroke") == "core_rehab"
    assert of("A recipe for soup") is None


def test_licences(spark):
    of = lambda x: one(spark, [x], classify.licence_of_rights, "array<string>")
    urls = ["licenses/by/4.0/", "licenses/by-sa/4.0/", "publicdomain/zero/1.0/", "licenses/by-nc/4.0/"]
    assert [of(f"https://creativecommons.org/{u}") for u in urls] == ["CC-BY", "CC-BY-SA", "CC0", None]
    assert [one(spark, f"https://creativecommons.org/{u}", classify.licence_of_value) for u in urls] == ["CC-BY", "CC-BY-SA", "CC0", None]


def test_targets():
    q = classify.quotas(6000, C.MIX)
    assert q["core_rehab"] == 2700 and q["robotics"] == 1800 and sum(q.values()) == 6000
    assert sum(classify.quotas(12001, C.HOSTED_MIX, whole=12_000, least=1, exact=round).values()) == 12001
    with pytest.raises(ValueError):
        classify.quotas(0, C.MIX)
    with pytest.raises(ValueError):
        classify.split_of(F.lit("x"), {"train": 0.5, "val": 0.1, "test": 0.1, "seed": 1})


def test_curation(spark):
    base = [f"token{i}" for i in range(400)]
    near = [*base]
    near[200] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, " ".join(f"other{i}" for i in range(400)))]
    d = spark.createDataFrame(rows, "ord long, t string").select("ord", T.content_hash(F.col("t")).alias("sha"), T.word_tokens(F.col("t")).alias("words"))
    got = {r["ord"]: (r["verdict"], r["duplicate_of"]) for r in dedup.near(d, {**C.NEAR, "jaccard_threshold": 0.8}).collect()}
    assert got == {1: ("accepted", None), 2: ("exact_duplicate", 1), 3: ("near_duplicate", 1), 4: ("accepted", None)}


def test_greedy_order(spark):
    r = random.Random(2)
    edges = {(a, b) for a, b in ((r.randrange(40), r.randrange(40)) for _ in range(90)) if a < b}
    got = {x["node"]: x["ok"] for x in dedup.accepted_in_order(spark.createDataFrame(sorted(edges), "l long, r long")).collect()}
    taken: set = set()
    for n in sorted({x for e in edges for x in e}):
        if not any((m, n) in edges for m in taken):
            taken.add(n)
    assert {n for n, ok in got.items() if ok} == taken


def test_mask(spark):
    d = spark.createDataFrame([([10, 11], [20, 21])], "p array<long>, r array<long>").select(instructions.masked(F.col("p"), F.col("r"), 8).alias("m")).first()["m"]
    assert d["x"] == [2, 10, 11, 20, 21, 0, 0, 0]
    assert d["y"] == [-100, -100, 20, 21, 3, -100, -100, -100]


def test_instruction_strict(spark):
    ex = spark.createDataFrame([(1, " ", "", "r")], "ord long, instruction string, context string, response string")
    assert instructions.valid(ex).count() == 0
    with pytest.raises(Exception, match="required"):
        instructions.valid(ex, strict=True).collect()


def test_latest(spark):
    names = spark.createDataFrame([("step_500.pt",), ("step_1500.pt",), ("step_x.pt",)], "name string")
    assert numeric.latest_step(names).first()["name"] == "step_1500.pt"


def test_readiness(spark):
    sel = spark.createDataFrame([(c, s) for c, n in (("robotics", 30), ("neurotechnology", 15), ("core_rehab", 55)) for s in ["val"] * 5 + ["test"] * 5 + ["train"] * (n - 10)], "category string, split string")
    sums = spark.createDataFrame([(100, 10)], "original_chars long, removed_chars long")
    assert reports.readiness(sel, sums, {**C.GATE, "enough_documents": 100, "validation_size": 10, "test_size": 10}).first()["ready"]
    r = reports.readiness(sel, sums, C.GATE).first()
    assert not r["ready"] and len(r["reasons"]) == 3


def test_sources_and_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", "t é", "train"), ("b", "u", "val")], "id string, text string, split string")
    sinks.jsonl(d, f"{tmp_path}/j")
    back = articles.jsonl(spark, f"{tmp_path}/j", "id string, text string, split string")
    assert {r["text"] for r in back.collect()} == {"t é", "u"} and "_input_source" in back.columns
    sinks.split_texts(d, f"{tmp_path}/s")
    assert [r["text"] for r in articles.eos_files(spark, f"{tmp_path}/s/split=train/*.txt").collect()] == ["t é"]
    payload = '{"documents":[{"passages":[{"infons":{"section_type":"INTRO"},"text":" a "},{"infons":{"section_type":"REF"},"text":"b"}]}]}'
    assert one(spark, payload, articles.flatten_passages) == "a"
    xml = '<r xmlns:dc="u"><dc:rights>x</dc:rights><dc:rights>y</dc:rights></r>'
    assert one(spark, xml, articles.rights) == ["x", "y"]


def test_gate_says_what_it_found(spark):
    sel = spark.createDataFrame([(i, "robotics" if i % 20 == 0 else "core_rehab", "train") for i in range(3546)], "doc_id long, category string, split string")
    sums = spark.createDataFrame([(1000, 400)], "original_chars long, removed_chars long")
    r = reports.readiness(sel, sums, C.GATE)
    assert r.first()["reasons"] == [
        "Need robotics fraction >= 12%; found 5.0% (178 documents).",
        "Need neurotechnology fraction >= 5%; found 0.0% (0 documents).",
        "Need robotics + neurotechnology >= 20%; found 5.0%.",
        "Need at least 100 validation documents; found 0.",
        "Need at least 100 test documents; found 0.",
        "Cleaning statistics are missing or the cleaner removed more than 30% of source characters.",
    ]
    with pytest.raises(SystemExit):
        reports.require_ready(r)
    with pytest.raises(SystemExit):
        reports.require_documents(spark.createDataFrame([("accepted", 9)], "item string, n long"), 10)


def test_tokens_back_to_text(spark):
    d = spark.createDataFrame([(1, "The gait trainer helps."), (2, ""), (3, None)], "ord long, text string")
    assert {r["ord"]: r["text"] for r in tokens.decode(tokens.encode(d)).collect()} == {1: "The gait trainer helps.", 2: "", 3: ""}
    tokens.require_vocabulary(32_000)
    with pytest.raises(ValueError):
        tokens.require_vocabulary(8_000)


def test_blocks_and_their_shift(spark):
    d = spark.createDataFrame([(0, [1, 2, 3]), (1, []), (2, [4, 5]), (3, [6, 7, 8, 9, 10])], "ord long, ids array<int>")
    got = {r["block"]: (r["ids"], r["y"]) for r in tokens.blocks(d, 4).collect()}
    assert got == {0: ([1, 2, 3, 4], [2, 3, 4, 5]), 1: ([5, 6, 7, 8], [6, 7, 8, 9])}


def test_token_files_and_manifest(spark, tmp_path):
    d = spark.createDataFrame([([1, -2, 3],), ([70_000],)], "ids array<int>").coalesce(1)
    sinks.token_files(d, f"file://{tmp_path}/ids")
    assert [tuple(r)[1:] for r in sinks.token_ranges(spark, f"file://{tmp_path}/ids").collect()] == [(0, [1, -2, 3, 70_000])]
    made = sinks.run_manifest(spark, [f"{tmp_path}/ids/*.bin"], {"context": 512}, f"{tmp_path}/run")
    assert made["bytes"] == 16 and made["parameters"] == {"context": 512} and len(made["data"][0]["sha256"]) == 64
    sinks.jsonl(spark.range(2), f"{tmp_path}/rows")
    sinks.jsonl(spark.range(9), f"{tmp_path}/rows", keep=True)
    assert spark.read.json(f"{tmp_path}/rows").count() == 2


def test_instruction_rows(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "instruction": "do", "response": "done"}\n')
    r = articles.instruction_rows(spark, f"{tmp_path}/a.jsonl").first()
    assert (r["id"], r["instruction"], r["context"], r["response"]) == ("1", "do", "", "done")


def test_sampling(spark):
    logits = spark.createDataFrame([(v, t, x) for v in range(400) for t, x in enumerate([0.0, 1.0, -30.0])], "vec_id long, token int, logit double")
    got = [r["token"] for r in numeric.draw(logits, 5).collect()]
    assert len(got) == 400 and set(got) == {0, 1} and 220 < sum(got) < 360
    assert got == [r["token"] for r in numeric.draw(logits, 5).collect()]


def test_parameter_counts():
    assert numeric.parameter_count(8000, 512, 8, 384, 1536) == 17_437_440
    assert numeric.parameter_count(8000, 256, 4, 256, 1024) == 5_263_872


def test_blocks_across_ranges(spark):
    """Texts of many ranges of numbers, some empty, one over several blocks, laid end to end."""
    r = random.Random(3)
    docs = [(o, [r.randrange(99) for _ in range(r.choice([0, 1, 2, 5, 300]))]) for o in r.sample(range(60_000), 200)]
    d = spark.createDataFrame(docs, "ord long, ids array<int>")
    flat = [x for _, ids in sorted(docs) for x in ids]
    for ctx in (7, 5000):
        got = {x["block"]: (x["ids"], x["y"]) for x in tokens.blocks(d, ctx).collect()}
        assert got == {k: (flat[k * ctx : k * ctx + ctx], flat[k * ctx + 1 : k * ctx + ctx + 1]) for k in range(max(1, (len(flat) - 1) // ctx))}


def test_encoding_in_parts(spark, monkeypatch):
    """Ids are made a few texts at a time, in batches of bounded bytes, and are those of the texts one by one; null is an empty text."""
    monkeypatch.setattr(tokens, "PART", 64)
    texts = [None, "", "one text", "wörter " * 90, *[f"t{i}" for i in range(40)]]
    got = {r["ord"]: r["ids"] for r in tokens.encode(spark.createDataFrame(list(enumerate(texts)), "ord long, text string"), bos=True, eos=True).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=tokens._piece_model())
    assert got == {i: sp.encode(t or "", add_bos=True, add_eos=True) for i, t in enumerate(texts)}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"


def test_corpus_is_encoded_whole(spark, tmp_path):
    """Texts are split at the mark, stripped, and blank parts dropped; every id of the stream is in a row, those after the last full one too."""
    r = random.Random(4)
    say = lambda n: " ".join(r.choice(["gait", "wörter", "arm", "the"]) for _ in range(n))
    docs = [(o, r.choice([None, "", "  \n", say(3), f" {say(40)}\n<eos>\n {say(2)} ", f"<eos>{say(900)}<eos> <eos>"])) for o in r.sample(range(10**6), 60)]
    sp = sentencepiece.SentencePieceProcessor(model_file=tokens._piece_model())
    parts = [x for _, t in sorted(docs) for x in (t or "").split("<eos>")]
    flat = [i for x in parts if x.strip() for i in sp.encode(x.strip(), add_bos=True, add_eos=True)]
    d = spark.createDataFrame(docs, "ord long, text string").repartition(3)
    got = {x["block"]: (x["start"], x["ids"]) for x in corpus.encoded_corpus(d, f"file://{tmp_path}/ids").collect()}
    assert len(flat) % 512 and got == {k: (512 * k, flat[512 * k : 512 * k + 512]) for k in range(-(-len(flat) // 512))}
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "ids").glob("*.bin"))) == b"".join(i.to_bytes(4, "little") for i in flat)
    assert corpus.encoded_corpus(d.limit(0), f"file://{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="no ids"):
        sinks.token_files(spark.createDataFrame([(None,)], "ids array<int>"), f"file://{tmp_path}/null")
