"""The training-data operators against brute force, exact round trips and held-out accuracy, on odd tables too."""

import glob
import hashlib
import io
import os
import random
import wave
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loam.llm import components, extraction, idfile, katz, media, mixing, packing, quality, queries, simhash, substrings, tokens, toxicity
from loam.llm.fmindex import FMIndex, Wavelet

SF = "/root/testdata/sf0.001"
TABLES = {os.path.basename(p)[:-8]: p for p in glob.glob(f"{SF}/*.parquet")}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, least string, n string, sha string, key string"
SAID = " ".join(f"w{i % 37}x{i}" for i in range(70))


def rows():
    r = random.Random(4)
    say = lambda n: " ".join(r.choice(["the", "of", "Reh", "aé", "ob,", "x."]) + str(r.randrange(60)) for _ in range(n))
    out = [(i, f"{say(r.randint(0, 30))} {SAID if i % 3 == 0 else ''}\n{say(60)}", "s" + str(i % 3)) for i in range(24)]
    out += [(30, out[3][1], "s0"), (31, out[3][1], None), (31, out[3][1], None), (40, None, "s1"), (41, "", "s1"), (42, " \t\n", None), (None, "null id", "s2"), (None, None, None)]
    out += [(50, "long " * 4000 + "a  b   c", "s0"), (51, "y" * 90_000, "s1"), (1, "same id " + say(55), "s2"), (52, "an <|endoftext|> inside\n<|endoftext|>", "s2")]
    return [(i, t, None, s, None, "1", "2", "3", "4", "5") for i, t, s in out]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, same, name):
    same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], TABLES)


@pytest.mark.parametrize("name", ["op1_quality_rules", "op6_mixing"])
def test_sql_on_odd_documents(spark, same, odd, tmp_path, name):
    odd.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    same(queries.queries()[name](spark, str(tmp_path)), queries.oracle_sql()[name], {"documents": f"{tmp_path}/documents.parquet/*.parquet"})


def test_empty_tables(spark, none):
    docs = none
    for f in (quality.op1_quality_rules, packing.op3_packing, simhash.op4_simhash, media.op5_media, mixing.op6_mixing, katz.op7_katz, idfile.op8_token_ids, substrings.op9_substrings):
        assert f(docs).count() == 0, f
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.op2_toxicity(docs, labels).count() == 0
    assert extraction.op10_extraction(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_ablations(odd):
    led = quality.ledger(odd)
    got = {(r["policy"], r["rule"]): r for r in quality.ablations(led).collect()}
    bits = [r["fail_bits"] for r in led.collect()]
    for p in quality.POLICIES:
        m = quality.mask(p)
        for rule in quality.RULES:
            if rule.name in p.rules:
                r = got[p.version, rule.name]
                assert r["failed"] == sum(bool(b & rule.value) for b in bits)
                assert r["failed_alone"] == sum(b & m == rule.value for b in bits)
                assert r["kept"] == sum(not b & m for b in bits) and r["kept_without"] == sum(not b & m & ~rule.value for b in bits)


def library():
    """The library, as it comes."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def test_tokens_exact():
    t = library()
    e, r = tokens.Encoder(tokens.default_tokenizer()), random.Random(1)
    parts = [*"abZ 12.'\n\t ", *"    ", "é", "'s", "%%", "<|endoftext|>", "\x1c", "\u0085", "漢", "²", "ñ", ".\n", "_"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(800)]
    ids, n = e.encode(texts)
    texts += ["<|endoftext|>", "", "a <|endoftext|> b", "<|endoftext", "|>"]
    ids, n = e.encode(texts)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def ids_of(text):
    return library().encode(text or "", add_special_tokens=False).ids


def test_packing(odd):
    got = packing.op3_packing(odd).collect()
    seqs: dict = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    want = Counter()
    for i, t, *_ in rows():
        ids, at = [*ids_of(t), 2], 0
        step = len(ids) % 1024 or 1024
        k = 0
        while at < len(ids):
            want[i, k, at, step, zlib.crc32(np.array(ids[at : at + step], "<u4").tobytes())] += 1
            at, k, step = at + step, k + 1, 1024
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want


def test_best_two_fit():
    assert packing.best_two_fit({60: 1, 30: 1, 21: 1, 18: 1}, 100) == [((60, 18, 21), 1), ((30,), 1)]
    r = random.Random(3)
    counts = Counter(r.randint(1, 100) for _ in range(500))
    used = Counter()
    for p, k in packing.best_two_fit(dict(counts), 100):
        assert sum(p) <= 100
        for x in p:
            used[x] += k
    assert used == counts


def test_simhash(odd):
    df = simhash.op4_simhash(odd).collect()
    fp = np.array([int(r["fingerprint"], 16) for r in df], np.uint64)
    label = list(range(len(df)))
    for _ in df:
        for i, f in enumerate(fp):
            near = np.flatnonzero(np.bitwise_count(fp ^ f) <= 4)
            low = min(label[j] for j in near)
            for j in near:
                label[j] = low
    least: dict = {}
    for r, k in zip(df, label, strict=True):
        if r["doc_id"] is not None:
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    assert [r["component_id"] for r in df] == [least.get(k) for k in label]
    kept = simhash.one_of_each(odd).collect()
    assert len(kept) < len(df) and sum(r["text"] == rows()[3][1] for r in kept) <= 1


def test_one_of_each_keeps_unrelated_texts(spark):
    say = lambda k: " ".join(f"u{k}x{i}" for i in range(80))
    texts = [(None, say(0)), (None, say(1)), (None, say(2)), (7, say(3)), (7, say(4)), (None, say(5)), (9, say(5)), (7, say(3))]
    kept = simhash.one_of_each(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in kept) == sorted([(0, say(0)), (0, say(1)), (0, say(2)), (7, say(3)), (7, say(4)), (9, say(5))])


def jaccard_classes(texts, least=0.8):
    """Labels by brute force."""

    def shingles(t):
        w = t.lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and len(a & b) / len(a | b) >= least:
                label = [label[j] if k == label[i] else k for k in label]
    return label


@pytest.mark.parametrize("nodes", [256, 4])
def test_near_duplicates_by_jaccard(spark, monkeypatch, nodes):
    monkeypatch.setattr(simhash, "NODES", nodes)
    r, texts = random.Random(6), []
    for k in range(40):
        base = [f"v{r.randrange(4000)}" for _ in range(r.randint(60, 300))]
        texts.append(" ".join(base))
        for _ in range(12 if k == 0 else 2):
            edited = list(base)
            at, n = r.randrange(len(base) - 30), round(len(base) * r.uniform(0.02, 0.2))
            edited[at : at + n] = [f"e{r.randrange(4000)}" for _ in range(n)]  # a replaced passage
            texts.append(" ".join(edited))
    want: dict = {}
    for i, k in enumerate(jaccard_classes(texts)):
        want.setdefault(k, i)
    assert 40 < len(want) < len(texts)
    kept = simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(x["doc_id"] for x in kept) == sorted(want.values())


def test_simhash_large_buckets(spark, monkeypatch):
    r = random.Random(8)
    base = r.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in r.sample(range(12), r.randint(0, 6))) for _ in range(400)} | {r.getrandbits(64) for _ in range(100)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    monkeypatch.setattr(simhash, "BUCKET", 3)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), len(fps), 4)
    got = {x["node"]: x["label"] for x in components.components(links).collect()}
    a = np.array(fps, np.uint64)
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for f in a:
            near = np.flatnonzero(np.bitwise_count(a ^ f) <= 4)
            low = min(label[j] for j in near)
            for j in near:
                changed |= label[j] != low
                label[j] = low
    groups = Counter(label)
    mine = Counter(got.get(s, s) for s in signed)
    assert sorted(groups.values()) == sorted(mine.values())


def test_components(spark):
    r = random.Random(12)
    links = [(a, a + 1) for a in range(-60, 60)] + [(r.randrange(1000, 1300), r.randrange(1000, 1300)) for _ in range(120)] + [(5000, k) for k in range(5001, 5100)]
    label = {x: x for p in links for x in p}
    for _ in range(400):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(links, "u long, v long")
    want = {x: k for x, k in label.items() if any(x in p and p[0] != p[1] for p in links)}
    for small in (10**6, 0):
        assert {x["node"]: x["label"] for x in components.components(df, small).collect()} == want
    assert components.components(df.filter("u is null")).count() == 0


def test_media(odd):
    got = media.op5_media(odd).collect()
    want = Counter()
    for i, t, *_ in rows():
        p = media.payload(t)
        with io.BytesIO() as f:
            with wave.open(f, "wb") as w:  # the standard library's own writer
                w.setparams((1, 1, media.RATE, 0, "NONE", ""))
                w.writeframes(p)
            m = f.getvalue()
        want[i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), media.features(p)] += 1
    cols = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    assert Counter(tuple(r[c] for c in cols) for r in got) == want


def test_what_is_stored_are_media_files(odd):
    s = media.spool(odd).collect()
    have = {r["digest"]: bytes(r["data"]) for r in s if r["data"] is not None}
    lists: dict = {}
    for r in s:
        lists.setdefault(r["row"], []).append((r["seq"], r["digest"]))
    texts = Counter()
    for x in lists.values():
        file = b"".join(have[d] for _, d in sorted(x))
        with wave.open(io.BytesIO(file)) as w:
            texts[w.readframes(w.getnframes())] += 1
    assert texts == Counter(media.payload(t) for _, t, *_ in rows())
    assert sum(map(len, have.values())) < sum(len(media.stored(t)) for _, t, *_ in rows())


def test_cuts_move_little():
    r = np.random.default_rng(2)
    a = r.integers(32, 120, 300_000, dtype=np.uint8).tobytes()
    b = a[:1000] + b"some more" + a[1000:]
    parts = lambda x: {x[i:j] for i, j in zip([0, *media.cuts(x)], media.cuts(x), strict=False)}
    assert b"".join(a[i:j] for i, j in zip([0, *media.cuts(a)], media.cuts(a), strict=False)) == a
    assert len(parts(a) & parts(b)) > 0.8 * len(parts(a))


def test_mix(odd):
    p = mixing.op6_mixing(odd).collect()
    taken: dict = {}
    for r in p:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken.setdefault(r["source"], [0, r["target"], r["source_size"]])[0] += r["taken"]
    for got, target, size in taken.values():
        assert abs(got - target) <= 1 and target <= 2 * size + 1e-6
    assert abs(sum(t[1] for t in taken.values()) - 1.5 * sum(t[2] for t in taken.values())) < 1e-3
    at = [r["train_position"] for r in mixing.curriculum(odd).collect()]
    assert at == sorted(at) and len(at) > 20


@pytest.mark.parametrize("hot", [2_000_000, 20])
def test_katz(odd, hot):
    docs = [(i, zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2, [*(t or "").encode().lower().split(), b""]) for i, t, *_ in rows()]
    c, pairs = Counter(), Counter()
    for _, held, w in docs:
        if not held:
            c.update(w)
            pairs.update(zip([b"", *w[:-1]], w, strict=True))
    of = lambda x: [Counter(x.values())[i] for i in range(1, katz.K + 2)]
    one, d2 = katz.Unigrams(sum(c.values()), len(c), of(c)), katz.discounts(of(pairs))
    p1 = {w: float(one.p(np.array([n]))[0]) for w, n in c.items()}
    assert abs(sum(p1.values()) + one.unknown - 1) < 1e-9
    disc = lambda r: (d2[r] if r <= katz.K else 1.0) * r
    back = {}
    for a in c:
        seen = {b: r for (x, b), r in pairs.items() if x == a}
        al, sc = katz.backoff(np.array([c[a]]), np.array([sum(map(disc, seen.values()))]), np.array([sum(p1[b] for b in seen)]))
        back[a] = al[0], sc[0]
        total = sum(sc[0] * disc(r) / c[a] for r in seen.values()) + al[0] * (1 - sum(p1[b] for b in seen))
        assert abs(total - 1) < 1e-9
    want = []
    for i, held, w in docs:
        s = 0.0
        for a, b in zip([b"", *w[:-1]], w, strict=True):
            al, sc = back.get(a, (1.0, 1.0))
            r = pairs[a, b]
            s += np.log10(sc * disc(r) / c[a] if r else al * p1.get(b, one.unknown))
        base = sum(np.log10((c[b] + 1) / (one.total + len(c) + 1)) for b in w)
        want.append((str(i), held, len(w), sum(b in c for b in w), one.total, round(float(base), 5), round(float(s), 5)))
    got = [(str(r[0]), *r[1:5], round(r[5], 5), round(r[6], 5)) for r in katz.score(odd, chunk_tokens=500, hot_context=hot).collect()]
    assert sorted(got) == sorted(want)


def test_id_files(spark, odd):
    store = idfile.write(odd, shard_ids=3000)
    got = sorted(idfile.read(store).collect(), key=lambda r: r["start"])
    at, have = 0, Counter()
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        have[r["doc_id"], r["n_tokens"], r["ids_crc32"]] += 1
    ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert ids == sorted(ids)
    want = Counter()
    for i, t, *_ in rows():
        x = np.array([*ids_of(t), 0], "<u4")
        want[i, len(x), zlib.crc32(x.tobytes())] += 1
    assert have == want


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 32])
def test_bits(bits):
    ids = np.random.default_rng(bits).integers(0, min(1 << bits, 1 << 31), 10_000).astype(np.uint32)
    ends = np.array([0, 5, 4096, 9000, 10_000])
    s = idfile.Shard(idfile.make_shard(ids, ends, bits))
    assert (s.ids(0, 10_000) == ids).all() and (s.doc(2) == ids[5:4096]).all() and len(s.doc(0)) == 0 and (s.ids(4095, 4097) == ids[4095:4097]).all()


def test_index():
    r = np.random.default_rng(1)
    x = r.integers(0, 13, 700)
    w = Wavelet(x, 13)
    for _ in range(100):
        c, i = int(r.integers(0, 13)), int(r.integers(0, 701))
        assert w.rank(np.array([c]), np.array([i]))[0] == (x[:i] == c).sum()
    for _ in range(10):
        segs, docs = [r.integers(1, 4, r.integers(1, 40)) for _ in range(12)], r.permutation(12)
        index = FMIndex(segs, docs, 5, 6)
        for streams in (segs, [r.integers(1, 5, 60) for _ in range(4)]):
            for q, (at, least) in zip(streams, index.matches(streams), strict=True):
                want = {}
                for i in range(len(q) - 5):
                    hit = [docs[k] for k, g in enumerate(segs) if any((g[j : j + 6] == q[i : i + 6]).all() for j in range(len(g) - 5))]
                    if hit:
                        want[i] = min(hit)
                assert dict(zip(at.tolist(), least.tolist(), strict=True)) == want


@pytest.mark.parametrize(("window", "gram", "hot"), [(50, 10, (400, 4000)), (12, 4, (400, 4000)), (12, 4, (2, 2))])
def test_substrings(odd, window, gram, hot):
    last, first = substrings.LAST, {}
    docs = [(last if i is None else i, words(t)) for i, t, *_ in rows()]
    for i, w in docs:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, last), i)
    want = Counter()
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        want[i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, c in zip(w, gone, strict=True) if not c)).hexdigest()] += 1
    got = substrings.judged(*substrings.find(odd, window, gram, hot), window=window).select(F.coalesce("doc_id", F.lit(last)), "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == want


def test_toxicity_gradients():
    m = {k: v.astype(np.float64) for k, v in toxicity.fresh().items()}
    x = toxicity.Words(["a bad word b c d e", "good x y"])
    ids, mask = x.rows(np.arange(len(x.win)))
    kinds, local = np.unique(ids, return_inverse=True)
    lex, y = toxicity.Lexicon([x.names[k - 1] if k else "-" for k in kinds]), np.array([1.0, 0.0])

    def loss():
        z = toxicity.forward(m, lex.vectors(m), local.reshape(ids.shape), mask)[0]
        return float((np.log1p(np.exp(z)) - y * z).mean())

    g = toxicity.gradients(m, lex, lex.vectors(m), local.reshape(ids.shape), mask, y, np.ones(2))
    for k in g:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        keep = m[k][i]
        m[k][i] = keep + 1e-3
        a = loss()
        m[k][i] = keep - 1e-3
        b = loss()
        m[k][i] = keep
        assert abs((a - b) / 2e-3 - g[k][i]) < 1e-3


def test_toxicity_learns():
    r = random.Random(5)
    plain = [f"w{i}" for i in range(300)]
    bad = ["vile", "foul", "scum"]

    def make(n):
        out = []
        for _ in range(n):
            t, y = [r.choice(plain) for _ in range(r.randint(5, 120))], r.random() < 0.2
            for _ in range(3 * y):
                t.insert(r.randint(0, len(t)), r.choice(bad))
            out.append((" ".join(t), int(y)))
        return out

    tr, te = make(500), make(200)
    m = toxicity.train(*zip(*tr, strict=True), epochs=4)
    z = toxicity.document_logits(m, [t for t, _ in te])
    y = np.array([k for _, k in te], bool)
    assert z[y].min() > np.median(z[~y]) and (z[y][:, None] > z[~y][None, :]).mean() > 0.97
    assert np.isfinite(toxicity.document_logits(m, [None, "", "one"])).all()


def test_extraction_held_out():
    m = extraction.model()
    wrong = total = 0
    for seed in range(90_000, 90_100):
        bs = extraction._sample(seed)
        want = [b.label for b in bs]
        extraction.label(m, [bs])
        total += len(bs)
        wrong += sum(b.label != k for b, k in zip(bs, want, strict=True))
    assert total > 1500 and wrong <= 0.005 * total


def test_extraction(spark):
    page = "<html><head><title>no</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A &amp; b</h1><p><b>One\n two.<br><p>Three &lt;p&gt; words here.</article><footer>&copy; all rights reserved</footer>"
    d = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (3, "u", "", "x"), (4, "u", "<!-- open", "x")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extraction.op10_extraction(d).collect()}
    assert got[1] == ("A & b\nOne two.\nThree <p> words here.", 36)
    assert got[2] == got[3] == got[4] == ("", 0)


def test_blocks_of_unclosed_elements():
    body = "<article><h1>Big news</h1><p>All of it &amp; more.</p></article>"
    texts = lambda page: [b.text for b in extraction.blocks(page)]
    want = ["Big news", "All of it & more."]
    assert texts(f"<html><head><title>x</title></head><body>{body}") == want
    assert texts(f"<html><head><title>x</title><meta charset=utf-8><script>'<p>no</p>'</script><body>{body}") == want
    assert texts(f"<html><head><title>x</title>{body}") == want
    assert texts("<head><title>x</title>Bare text") == ["Bare text"]
    for tag in ("title", "svg", "iframe", "noscript", "template"):
        assert texts(f"<body><{tag}>gone{body}") == want, tag
        assert texts(f"<body><{tag}>gone<p>too</p></{tag}>{body}") == want, tag
    assert texts(f"<head><title>x<body>{body}<svg><title>y</title></svg>") == want
    assert texts(f"<body><script>gone{body}") == []
    assert texts(f'<body><svg width="1"/>{body}<svg><path/></svg>') == want
    assert texts(f"<body><svg>{body}<svg><text>no</text></svg>") == want
    assert texts(f"<body><svg><svg><text>no</text></svg><title>no</title></svg>{body}") == want
    assert texts(f"<body><template><p>a</p><template><p>b</p></template><p>c</p></template>{body}") == want


def test_pages_of_other_layouts():
    """Pages that the writer of the training pages doesn't make."""
    m = extraction.model()
    prose = ["The river rose again last night, and the lower road was closed before dawn.", "Farmers moved their cattle to the hill, where the ground is dry.", "No one was hurt, the mayor said, but two bridges need repair."]
    body = "".join(f"<p>{p}</p>" for p in prose)
    pages = [
        f"<body><div id=nav><a href=/>Home</a> <a href=/x>News</a> <a href=/y>Sports</a></div><div class=content><h1>River rises</h1>{body}</div><div id=footer>Copyright 2024 all rights reserved</div>",
        f"<html><body><nav><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></nav><main><article><header><h1>River rises</h1></header><section>{body}</section></article></main><footer><p>Contact us, privacy, terms</footer>",
        f"<body><article><h1>River rises</h1>{body * 400}</article>",
    ]
    for k, page in enumerate(pages):
        bs = extraction.blocks(page)
        extraction.label(m, [bs])
        got = extraction.main_text(bs).split("\n")
        assert [x for x in got if x in prose] == prose * (400 if k == 2 else 1), k
        assert not {"Home", "Contact us, privacy, terms", "Copyright 2024 all rights reserved"} & set(got), k


def test_pipeline(spark):
    docs, sizes = spark.read.parquet(f"{SF}/documents.parquet"), []
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        after = spark.createDataFrame(after.collect(), docs.schema)
        sizes.append(after.count())
        if name == "quality_rules":
            kept = {r["doc_id"] for r in quality.op1_quality_rules(before).filter("kept").collect()}
            assert {r["doc_id"] for r in after.collect()} == kept
        if name == "near_dedup":
            had = sorted(before.collect(), key=lambda r: r["doc_id"])
            first = {}
            for r, k in zip(had, jaccard_classes([r["text"] for r in had]), strict=True):
                first.setdefault(k, r["doc_id"])
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(first.values())
        if name == "substring_dedup":
            rows_ = {r["doc_id"]: r["kept_sha256"] for r in substrings.op9_substrings(before).collect()}
            assert all(hashlib.sha256(b" ".join(words(r["text"]))).hexdigest() == rows_[r["doc_id"]] for r in after.collect())
        if name == "mix":
            plan = {r["doc_id"]: r for r in mixing.op6_mixing(before).collect()}
            n = Counter(r["doc_id"] for r in after.collect())
            assert all(abs(n[i] * r["size"] - r["taken"]) <= r["size"] / 2 for i, r in plan.items())
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert packed.filter("piece = 0").count() == sizes[-1]


CLASHING = ["_id", "_key", "_sha", "_kept", "_k", "_size", "_m", "_doc", "key", "id", "label", "train_position", "a.b", "n", "range", "position"]


def test_stages_on_odd_rows(spark, odd, tmp_path):
    """Nulls, empty and long texts, repeats, repeated ids, and columns named as the stages' own."""
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", *[F.xxhash64("text", "doc_id", "source", F.lit(c)).alias(c) for c in CLASHING])
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, before, SF).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert after.columns == docs.columns, name
        was = {tuple(r[c] for c in CLASHING): r for r in before.collect()}
        for r in after.collect():
            x = was[tuple(r[c] for c in CLASHING)]
            assert (r["doc_id"], r["source"]) == (x["doc_id"], x["source"])
            assert r["text"] == x["text"] or name == "substring_dedup"
        before = after
        assert stage(spark, spark.createDataFrame([], docs.schema), SF).count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert packed.filter("piece = 0").count() == before.count()


def test_sequences_follow_the_curriculum(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.ordered(docs).select("_doc.*", "train_position").repartitionByRange(6, "train_position").sortWithinPartitions("train_position")
    mixed.write.parquet(f"{tmp_path}/mixed")
    got = corpus_pipeline.STAGES[-1][1](spark, spark.read.parquet(f"{tmp_path}/mixed"), SF).filter("piece = 0").groupBy("doc_id").agg(F.avg("sequence_id").alias("s"))
    at = mixed.groupBy("doc_id").agg(F.avg("train_position").alias("t"))
    assert got.join(at, "doc_id").select(F.corr("s", "t")).first()[0] > 0.9
