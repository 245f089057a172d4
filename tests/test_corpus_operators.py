"""Vocabularies, near duplicates in hot bands, early stops and settings, against plain loops."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loam import config as C
from loam.functions import digests
from loam.functions import text as T
from loam.operators import bpe, dedup, quality, unigram
from loam.plans import corpus

SF = "/root/testdata/sf0.001"


def plain_merges(words, n, longest=bpe.LONGEST):
    """One merge after the other: the most frequent pair, then the least by its text."""
    words = [(list(p), c) for p, c in words]
    counts, out = Counter(), []

    def count(p, c):
        for a, b in zip(p, p[1:], strict=False):
            if len(a) + len(b) <= longest:
                counts[a, b] += c

    for p, c in words:
        count(p, c)
    while len(out) < n and counts:
        (left, right), k = min(counts.items(), key=lambda x: (-x[1], x[0]))
        if k <= 0:
            break
        out.append((left, right, k))
        for w, (p, c) in enumerate(words):
            if left in p:
                new, i = [], 0
                while i < len(p):
                    two = p[i : i + 2] == [left, right]
                    new.append(left + right if two else p[i])
                    i += 1 + two
                count(p, -c)
                count(new, c)
                words[w] = (new, c)
        counts = +counts
    return out


def pieces(spark, texts):
    return [(r["p"], r["c"]) for r in bpe.word_pieces(spark.createDataFrame([(t,) for t in texts], "text string")).collect()]


@pytest.mark.parametrize("bounds", [{}, {"most_pairs": 7, "most_runs": 40}, {"most_pairs": 3, "most_runs": 5}])
def test_merges_of_odd_words(spark, bounds):
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abé") for _ in range(r.randint(1, 7))) for _ in range(30)) for _ in range(6)]
    texts += ["aaaaaaa aaaaa " * 3, "y" * 50, "", None, " \t\n", "ab" * 30, "xyz xyz yz xy x"]
    got, letters = bpe.merges(spark.createDataFrame([(t,) for t in texts], "text string"), 25, **bounds)
    assert got == plain_merges(pieces(spark, texts), 25) and set(letters) == set("abéyxz" + bpe.MARK)


def test_merges_run_out_of_pairs(spark):
    got, _ = bpe.merges(spark.createDataFrame([("ab b",)], "text string"), 99)
    assert got == plain_merges(pieces(spark, ["ab b"]), 99) and len(got) == 3
    assert bpe.merges(spark.createDataFrame([], "text string"), 5) == ([], [])


def test_vocabulary_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60)
    v = [r["piece"] for r in bpe.vocabulary(docs, 500).orderBy("id").collect()]
    words = [(r["p"], r["c"]) for r in bpe.word_pieces(docs).collect()]
    letters = {x for p, _ in words for x in p}
    assert len(v) == 500 and tuple(v[:4]) == bpe.SPECIALS and letters <= set(v)
    assert v[4 : 500 - len(letters)] == [a + b for a, b, _ in plain_merges(words, 496 - len(letters))]


def loop(docs, bands, d):
    """One text after the other: (verdict, duplicate_of, jaccard) of each."""
    taken, shas, out = [], {}, {}
    sets = {o: s for o, _, s in docs}
    for o, sha, s in sorted(docs):
        if sha in shas:
            out[o] = ("exact_duplicate", shas[sha], None)
            continue
        like = [(len(s & sets[k]) / len(s | sets[k]) if s | sets[k] else 1.0, -k) for k in taken if bands[o] & bands[k]]
        best = max((x for x in like if x[0] >= d["jaccard_threshold"]), default=None)
        if best:
            out[o] = ("near_duplicate", -best[1], round(best[0], 6))
        else:
            taken.append(o)
            shas[sha] = o
            out[o] = ("accepted", None, None)
    return out


def near_and_loop(spark, rows, d, heads):
    """``rows``: (ord, sha, words)."""
    df = spark.createDataFrame(rows, "ord long, sha string, words array<string>")
    got = {r["ord"]: (r["verdict"], r["duplicate_of"], r["jaccard"]) for r in dedup.near(df, d, heads).collect()}
    sh = df.select("ord", "sha", T.shingles(F.col("words"), d["shingle_size"]).alias("shingles"))
    bands: dict = {}
    for r in dedup.bands(dedup.signatures(sh, d), d).collect():
        bands.setdefault(r["ord"], set()).add((r["band"], r["key"]))
    return got, loop([(r["ord"], r["sha"], frozenset(r["shingles"])) for r in sh.collect()], bands, d)


@pytest.mark.parametrize("heads", [1, 16])
def test_near_is_the_loop(spark, heads):
    r = random.Random(8)
    base = [[f"b{i}w{j}" for j in range(40)] for i in range(3)]
    rows = []
    for o in range(90):
        w = list(base[o % 3])
        for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
            w[r.randrange(40)] = f"x{r.randrange(6)}"
        rows.append((o, " ".join(w) + r.choice(["", " ", "."]), w))
    rows += [(200, "", []), (201, "-", []), (202, "", []), (203, "one", ["one"]), (204, "One", ["One"])]
    got, want = near_and_loop(spark, rows, {**C.NEAR, "jaccard_threshold": 0.6, "shingle_size": 2}, heads)
    assert got == want
    assert {"accepted", "exact_duplicate", "near_duplicate"} == {v[0] for v in got.values()}


def test_a_band_of_many_copies(spark):
    """20,000 texts of one shingle set and 3,000 that each differ by a word: no pair among the copies is made."""
    base = [f"w{j}" for j in range(60)]
    rows = [(o, f"s{o}", base) for o in range(20_000)] + [(30_000 + o, f"t{o}", [*base[:59], f"end{o}"]) for o in range(3000)]
    df = spark.createDataFrame(rows, "ord long, sha string, words array<string>")
    got = dedup.near(df, C.NEAR).groupBy("verdict", "duplicate_of").count().collect()
    assert {(r["verdict"], r["duplicate_of"], r["count"]) for r in got} == {("accepted", None, 1), ("near_duplicate", 0, 22_999)}


def test_a_band_of_unlike_texts(spark):
    """All share a passage that gives them bands in common, and none is like another."""
    r = random.Random(1)
    passage = [f"p{j}" for j in range(30)]
    rows = [(o, f"s{o}", passage + [f"w{r.randrange(10**6)}" for _ in range(30)]) for o in range(250)]
    got, want = near_and_loop(spark, rows, C.NEAR, 16)
    assert got == want and {v[0] for v in got.values()} == {"accepted"}


def test_first_accepted_reads_few_ranges(spark):
    docs = spark.range(100_000).withColumnRenamed("id", "ord").unionByName(spark.createDataFrame([(None,)], "ord long"))
    judged = []

    def accept(d):
        judged.append(d)
        return d.filter("ord % 10 = 3")

    got = [x["ord"] for x in quality.first_accepted(docs, 7, accept, step=20).collect()]
    assert got == [3, 13, 23, 33, 43, 53, 63]
    assert sum(d.count() for d in judged) == 20 + 40 + 80
    assert quality.first_accepted(docs, 99, lambda d: d.filter("ord >= 99999"), step=1000).count() == 1
    assert quality.first_accepted(docs.limit(0), 5, accept).count() == 0


def test_settings():
    s = C.settings({"quality": {"min_words": 10}, "dedup": {"bands": 8}, "splits": None})
    assert s["limits"][0][3] == 10 and s["limits"][1:] == C.LIMITS[1:]
    assert s["near"] == {**C.NEAR, "bands": 8} and s["split"] == C.SPLIT
    for bad in ({"quality": {"min_word": 1}}, {"colour": {}}, {"dedup": {"bands": 7}}, {"splits": {"train": 0.5}}, {"quality": {"min_words": "ten"}}, {"dedup": {"jaccard_threshold": 1.5}}):
        with pytest.raises(ValueError):
            C.settings(bad)
    with pytest.raises(ValueError):
        C.limits(too_shrt=1)


def all_cuts(word, scores, longest):
    if not word:
        return [[]]
    return [[word[:k], *rest] for k in range(1, min(len(word), longest) + 1) if word[:k] in scores for rest in all_cuts(word[k:], scores, longest)]


def test_unigram_rounds_are_those_of_all_cuts(spark):
    texts = ["abab abc ab cab", "abcab ab", "é éa"]
    words = bpe.word_pieces(spark.createDataFrame([(t,) for t in texts], "text string"))
    of = [("".join(p), c) for p, c in pieces(spark, texts)]
    scores = unigram.seeds(words, 1000, 4)
    subs = Counter()
    for w, c in of:
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + 4) + 1):
                subs[w[i:j]] += c
    assert set(scores) == {x for x, n in subs.items() if len(x) == 1 or n > 1}
    assert math.isclose(sum(map(math.exp, scores.values())), 1)
    last = -math.inf
    for _ in range(4):
        got, new = unigram.fitted(words, scores, 4)
        total, counts = 0.0, Counter()
        for w, c in of:
            chances = [(math.exp(sum(scores[x] for x in cut)), cut) for cut in all_cuts(w, scores, 4)]
            z = sum(p for p, _ in chances)
            total += c * math.log(z)
            for p, cut in chances:
                for x in cut:
                    counts[x] += c * p / z
        assert math.isclose(got, total, rel_tol=1e-9) and got >= last - 1e-9
        mass = sum(max(counts[x], 1e-3 if len(x) == 1 else 0) for x in scores)
        assert all(math.isclose(math.exp(v), max(counts[x], 1e-3 if len(x) == 1 else 0) / mass, rel_tol=1e-6, abs_tol=1e-12) for x, v in new.items())
        last, scores = got, new


def test_unigram_pruning_keeps_what_is_missed_most(spark):
    texts = ["abcabc abc abd", "abd xyz xyz"]
    words = bpe.word_pieces(spark.createDataFrame([(t,) for t in texts], "text string"))
    scores = unigram.fitted(words, unigram.seeds(words, 1000, 4), 4)[1]
    best = lambda w, without=None: max((c for c in all_cuts(w, scores, 4) if without not in c), key=lambda c: sum(scores[x] for x in c))
    used = Counter()
    for w, c in pieces(spark, texts):
        for x in best("".join(w)):
            used[x] += c
    cost = {x: used[x] * (scores[x] - sum(scores[y] for y in best(x, x))) for x in scores if len(x) > 1}
    letters = [x for x in scores if len(x) == 1]
    kept = unigram.pruned(words, scores, len(letters) + 3, 4)
    assert len(kept) == len(letters) + 3 and set(letters) <= set(kept)
    least = min(cost[x] for x in kept if len(x) > 1)
    assert all(cost[x] <= least + 1e-9 for x in cost if x not in kept)


def test_unigram_vocabulary(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(40)
    v = unigram.vocabulary(docs, 400, n_seeds=3000).orderBy("id").collect()
    assert len(v) == 400 and tuple(r["piece"] for r in v[:4]) == bpe.SPECIALS
    assert [r["score"] for r in v[4:]] == sorted((r["score"] for r in v[4:]), reverse=True)
    assert math.isclose(sum(math.exp(r["score"]) for r in v[4:]), 1, rel_tol=1e-6)
    none = unigram.vocabulary(spark.createDataFrame([("",), (None,)], "text string"), 50).collect()
    assert [r["piece"] for r in none] == list(bpe.SPECIALS)


def test_near_keeps_no_words(spark):
    """What is kept on the way is digests, and sets of those texts alone that share a band with another: far fewer bytes than the texts' words."""
    top = dedup.shared_dir(spark).removeprefix("file://")
    bytes_ = lambda: sum(p.stat().st_size for p in Path(top).rglob("*") if p.is_file())
    r = random.Random(5)
    rows = [(o, f"s{o}", [f"w{r.randrange(10**9)}" for _ in range(2000)]) for o in range(300)] + [(900, "twice", [f"v{j}" for j in range(2000)]), (901, "again", [f"v{j}" for j in range(2000)] + ["end"])]
    df = spark.createDataFrame(rows, "ord long, sha string, words array<string>")
    before = bytes_()
    got = {r["ord"]: r["verdict"] for r in dedup.near(df, C.NEAR).collect()}
    assert [o for o, v in got.items() if v != "accepted"] == [901]
    assert bytes_() - before < 2_000_000  # 600,000 words, and as many shingles of 8 bytes


@pytest.mark.parametrize("words", [[], ["One"], ["a", "B", "c"], [f"W{i % 7}" for i in range(60)], ["ÄÖ", "ΑΣ", "ſt", "日本", "a", "b", "ÄÖ"]])
def test_shingles_by_batches_are_those_of_spark(spark, words):
    df = dedup.settled(spark.createDataFrame([(1, words), (2, None)], "ord long, words array<string>").filter("ord = 1"))
    a, b = df.select(T.shingles(F.col("words"), 5).alias("a"), digests.md5_shingles(F.col("words"), 5).alias("b")).first()
    assert a == b


def test_minima_of_numbers_in_python(spark):
    r = random.Random(6)
    sets = [[], [0], [-1], [dedup.PRIME], [r.randrange(-(2**63), 2**63) for _ in range(1300)]]
    df = spark.createDataFrame(list(enumerate(sets)), "ord long, shingles array<long>")
    got = {x["ord"]: x["sig"] for x in dedup.signatures(df, C.NEAR).collect()}
    for o, s in enumerate(sets):
        assert got[o] == [min(((a * (x % 2**64 % dedup.PRIME) + b) % dedup.PRIME for x in s), default=dedup.PRIME) for a, b in dedup.permutations(C.NEAR)]


def test_expected_counts_by_products():
    """As by logarithms; words that no product can hold are left to those."""
    r = random.Random(7)
    scores = {x: math.log(r.uniform(1e-9, 0.1)) for x in {"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(120)} | {"a", "b", "c"}}
    chances = {k: math.exp(v) for k, v in scores.items()}
    for _ in range(60):
        word = "".join(r.choice("abc") for _ in range(r.randint(0, 25)))
        (a, x), (b, y) = unigram.expected_fast(word, chances, 5), unigram.expected(word, scores, 5)
        assert a == pytest.approx(b, abs=1e-9) and all(x[k] == pytest.approx(y.get(k, 0.0), abs=1e-9) for k in x) and set(y) <= set(x)
    assert unigram.expected_fast("a" * 5000, {"a": 1e-6}, 5) is None
    assert unigram.expected_fast("ad", chances, 5) is None


def test_curate_keeps_no_rejected_text(spark, tmp_path):
    """Of a rejected document its measures are kept on the way, of others a digest and the words."""
    r = random.Random(8)
    rows = [(o, "".join(chr(r.randrange(33, 48)) for _ in range(20_000)), "en", "s", 20_000) for o in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    top = dedup.shared_dir(spark).removeprefix("file://")
    bytes_ = lambda: sum(p.stat().st_size for p in Path(top).rglob("*") if p.is_file())
    before = bytes_()
    assert corpus.curated(spark, str(tmp_path)).filter("reasons <> ''").count() == 200
    assert bytes_() - before < 500_000  # of 4,000,000


def test_texts_that_are_plain_and_others(spark):
    """Texts that are normal already take a short way to the same lines and text, those a character off don't."""
    r = random.Random(12)
    odd = ["\t", "\r", "\r\n", "\x00", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2000", "\u200a", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "  ", " \n", "\n ", "\n\n\n"]
    plain = ["a b", "A b", "é", "日本", "\U0001f600", "\u200b", "-", "x\ny", "a b\n\nA B"]
    texts = [" ".join(r.choices(plain, k=r.randint(0, 6))) for _ in range(150)]
    texts += [t[:k] + x + t[k:] for x in odd for t in r.choices(texts, k=8) for k in {0, len(t), r.randint(0, len(t))}]

    def normal(t):
        t = "\n".join(re.sub(r"[ \t]+", " ", x).strip() for x in t.replace("\x00", " ").splitlines())
        return re.sub(r"\n{3,}", "\n\n", t).strip()

    def lines(t):
        found = [x.strip().lower() for x in t.splitlines() if x.strip()]
        return sum(n for n in Counter(found).values() if n > 1), len(found)

    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", T.normalise_text(F.col("t")).alias("n"), T.duplicate_lines(F.col("t")).alias("d"))
    assert {x["i"]: (x["n"], tuple(x["d"])) for x in df.collect()} == {i: (normal(t), lines(t)) for i, t in enumerate(texts)}


@pytest.mark.parametrize("shingles", [digests.shingles, digests.md5_shingles])
def test_near_of_words_joined_is_that_of_arrays(spark, shingles):
    """A text's words as one string, hashed where the signature is made."""
    r = random.Random(13)
    base = [[f"B{i}w{j}" for j in range(40)] for i in range(4)]
    words = [[], ["One"], ["ΑΣ", "ſt", "İ", "日本", "a", "ΣΑ", "ÄÖ"]] + [[f"X{r.randrange(4)}" if r.random() < 0.03 else w for w in base[k % 4]] for k in range(60)]
    df = spark.createDataFrame([(o, " ".join(w), w) for o, w in enumerate(words)], "ord long, sha string, words array<string>")
    said = df.withColumn("words", F.array_join("words", " "))
    d = {**C.NEAR, "jaccard_threshold": 0.6}
    a, b = ({tuple(x) for x in dedup.near(x, d, shingles=shingles).collect()} for x in (df, said))
    assert a == b and {x[1] for x in a} == {"accepted", "exact_duplicate", "near_duplicate"}


@pytest.mark.parametrize("query", ["reject_reasons", "corpus_totals", "topic_counts", "curation_stats"])
def test_counts_look_for_no_links(spark, monkeypatch, query):
    """Counts need each text's verdict, not what it is like best; the rows are those of the whole curation."""
    from loam.plans import registry

    run = registry.queries()[query]
    with monkeypatch.context() as m:
        m.setattr(corpus, "curated", lambda spark, sf, links=True, f=corpus.curated: f(spark, sf))
        want = {tuple(x) for x in run(spark, SF).collect()}
    monkeypatch.setattr(dedup, "near", None)
    assert {tuple(x) for x in run(spark, SF).collect()} == want


def test_sets_move_to_groups_once(spark, monkeypatch):
    """Pairs verified by groups are those verified one by one, also where a bucket is in several groups, and a set moves once to a group whatever its pairs."""
    monkeypatch.setattr(dedup, "GROUP", 20)
    monkeypatch.setattr(dedup, "TOGETHER", 30)
    r = random.Random(5)
    base = [r.randrange(1 << 60) for _ in range(40)]
    rows = [(o, r.sample(base, r.randint(30, 40)) + [r.randrange(1 << 60) for _ in range(r.randint(0, 9))]) for o in range(200)] + [(500, []), (501, [])]
    sh = spark.createDataFrame(rows, "ord long, shingles array<long>")
    buckets = spark.createDataFrame([(b, 7, o) for o, _ in rows for b in range(2) if b == 0 or o % 3 == 0], "band int, key long, ord long")
    home = dedup.homes(buckets)
    assert home.count() == len(rows) and home.select("g").distinct().count() > 1
    cand = spark.createDataFrame([(a, b) for a, _ in rows for b, _ in rows if a < b], "l long, r long")
    for t in (0.5, 0.82):
        got = {tuple(x) for x in dedup.verified(sh, cand, home, t).collect()}
        assert got == {tuple(x) for x in dedup.pairs(sh, cand, t).collect()} and len(got) > 50
    assert dedup.verified(sh, cand.limit(0), home, 0.5).count() == 0


@pytest.mark.parametrize("least", [0.01, 1e-30])
def test_words_are_cut_together(spark, least):
    """All words of a batch at once, laid once by more pieces than are left, give what each word gives: expected counts and best cuts, also of words that no product can hold and very long ones."""
    r = random.Random(8)
    first = {x: math.log(r.choice([least, 0.01, 0.1])) for x in sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(120)} | {"a", "b", "c", bpe.MARK})}
    scores = {k: v for k, v in first.items() if len(k) == 1 or r.random() < 0.7}
    texts = ["".join(r.choice("abc") for _ in range(r.randint(1, 25))) for _ in range(300)] + ["ab" * 90, "abc" * 100]
    words = bpe.word_pieces(spark.createDataFrame([(t,) for t in texts + texts[:50]], "text string"))
    of = [("".join(x["p"]), x["c"]) for x in words.collect()]
    table = unigram.laid(words, list(first), 5)
    assert {x["n"] for x in table.filter("w IS NOT NULL").collect()} == {301}
    for best, one in ((False, unigram.expected), (True, unigram.best_cut)):
        total, got = unigram._summed(table, scores, 5, best, list(first))
        want, sums = Counter(), 0.0
        for w, c in of:
            found, more = one(w, scores, 5)
            sums += c * found
            for x, v in more.items() if isinstance(more, dict) else Counter(more).items():
                want[x] += c * v
        assert total == pytest.approx(sums) and set(got) <= set(scores) and all(got.get(x, 0) == pytest.approx(want[x], abs=1e-9) for x in scores)
