"""Queries over a whole corpus: sources, duplicates, reports, splits, mixtures, instructions, tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam import config as C
from loam.functions import digests
from loam.functions import text as T
from loam.operators import bpe, classify, dedup, instructions, quality, reports, tokens, unigram
from loam.plans import duck as D
from loam.plans import texts as X
from loam.plans.registry import query
from loam.sources import articles, sinks
from loam.streaming import select

DEDUP = C.NEAR
# fixed values: small dimensions of the discovery queries
TOPICS = {"a": 2.0, "b": 1.5, "c": 1.0}


@query("scan_lineage", "SELECT doc_id, 'documents.parquet' AS origin FROM documents")
def _(spark, sf):
    origin = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+\.parquet)(?:/[^/]+)?$", 1)
    return X.docs(spark, sf).select("doc_id", origin.alias("origin"))


_STREAM = "coalesce(text, '') || '<eos>' || chr(10) || ' <eos>' || source || '<eos>'"


@query("eos_scan", f"""WITH x AS (SELECT doc_id, string_split({_STREAM}, '<eos>') AS p FROM documents), y AS (SELECT doc_id, unnest(p) AS c, generate_subscripts(p, 1) - 1 AS i FROM x)
SELECT doc_id, i::BIGINT AS i, doc_id || '-' || i || '-' || substr(sha256({D.strip('c')}), 1, 16) AS id FROM y WHERE {D.strip('c')} <> ''""")
def _(spark, sf):
    return articles.eos_chunks(X.docs(spark, sf).select(F.col("doc_id"), F.col("doc_id").cast("string").alias("stem"), F.expr(_STREAM).alias("text"))).select("doc_id", "i", "id")


_SEARCHES = C.SEARCHES + C.ROBOTICS_SEARCHES
_TOPIC_ROWS = ", ".join("('{}', '{}')".format(name, q) for name, q, _ in _SEARCHES)
_FILTER_ROWS = """('CC0', '"cc0 license"[filter]'), ('CC-BY', '"cc by license"[filter]'), ('CC-BY-SA', '"cc by-sa license"[filter]')"""


@query("query_plan", f"WITH t(topic, q) AS (VALUES {_TOPIC_ROWS}), l(licence, f) AS (VALUES {_FILTER_ROWS}) SELECT topic, licence, '(' || q || ') AND ' || f || ' {articles.INTEGRITY}' AS query FROM t, l")
def _(spark, sf):
    return articles.query_plan(spark, _SEARCHES)


_FOUND = "SELECT doc_id::VARCHAR AS id, CASE doc_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS topic, lang AS licence FROM documents UNION ALL SELECT (doc_id % 50)::VARCHAR, 'c', source FROM documents"
_MERGED = f"""f AS ({_FOUND}), w(topic, weight) AS (VALUES ('a', 2.0::DOUBLE), ('b', 1.5), ('c', 1.0)),
m AS (SELECT id, sum(weight) AS score, string_agg(topic, ',' ORDER BY topic) AS topics FROM (SELECT DISTINCT id, topic FROM f) JOIN w USING (topic) GROUP BY id)"""


def found(spark: SparkSession, sf: str) -> DataFrame:
    d = X.docs(spark, sf)
    topic = F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b").otherwise("c")
    one = d.select(F.col("doc_id").cast("string").alias("id"), topic.alias("topic"), F.col("lang").alias("licence"))
    return one.unionByName(d.select((F.col("doc_id") % 50).cast("string").alias("id"), F.lit("c").alias("topic"), F.col("source").alias("licence")))


@query("discovery_merge", f"WITH {_MERGED} SELECT id, score, topics, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM f JOIN m USING (id) GROUP BY id, score, topics")
def _(spark, sf):
    m = articles.merge_found(found(spark, sf), TOPICS)
    return m.select("id", "score", F.array_join("topics", ",").alias("topics"), F.array_join("licences", ",").alias("licences"))


@query("ranked_topn", f"WITH {_MERGED} SELECT id, score FROM m ORDER BY score DESC, id LIMIT 25")
def _(spark, sf):
    return articles.merge_found(found(spark, sf), TOPICS).orderBy(F.desc("score"), "id").limit(25).select("id", "score")


_PASS = f"{D.NORM}, {D.metrics()}, q AS (SELECT *, {D.reasons(C.TEST_LIMITS)} AS rs FROM m), p AS (SELECT doc_id AS ord, source, lang, t, words, chars, sha256(t) AS sha FROM q WHERE len(rs) = 0)"


@query("early_stop", f"WITH {_PASS} SELECT ord AS doc_id FROM p QUALIFY row_number() OVER (ORDER BY ord) <= 100")
def _(spark, sf):
    accepted = lambda d: judged(d).filter("size(rs) = 0").select("ord")
    return quality.first_accepted(X.docs(spark, sf).withColumnRenamed("doc_id", "ord"), 100, accepted).select(F.col("ord").alias("doc_id"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return judged(X.spread(X.docs(spark, sf)).withColumnRenamed("doc_id", "ord"))


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` (ord, source, lang, text) normalised (t), measured (m, with the words joined by spaces) and with the reasons against each (rs)."""
    n = docs.select("ord", "source", "lang", T.normalise_text(F.col("text")).alias("t"))
    both = T.let(quality.metrics(F.col("t"), said=True), lambda m: F.struct(m.alias("m"), quality.with_missing_id(quality.reasons(m, C.TEST_LIMITS), F.col("ord").cast("string")).alias("rs")))
    return X.once(n, both)


@query("missing_identifier", f"""WITH {D.NORM}, {D.metrics()}, q AS (SELECT doc_id, {D.reasons(C.TEST_LIMITS)} AS rs FROM m)
SELECT doc_id, array_to_string(CASE WHEN doc_id % 7 = 0 THEN list_append(rs, 'missing_identifier') ELSE rs END, ',') AS reasons FROM q""")
def _(spark, sf):
    given = F.when(F.col("doc_id") % 7 == 0, F.lit(" ")).otherwise(F.col("doc_id").cast("string"))
    found = quality.with_missing_id(quality.reasons(quality.metrics(F.col("t")), C.TEST_LIMITS), given)
    return X.normalised(spark, sf).select("doc_id", F.array_join(found, ",").alias("reasons"))


def passed(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).filter("size(rs) = 0").select("ord", "source", "lang", "m", "t", T.content_hash(F.col("t")).alias("sha"), F.col("m.said").alias("words"))


def kept_texts(p: DataFrame) -> DataFrame:
    """(ord, sha, words) of ``p``: the words that were cut to be measured, joined by spaces and kept once, compressed, instead of the texts; as arrays they would take several times that."""
    return dedup.settled(p.select("ord", "sha", "words"))


@query("exact_dedup", f"WITH {_PASS} SELECT ord AS doc_id, first, first <> ord AS duplicate FROM (SELECT ord, min(ord) OVER (PARTITION BY sha) AS first FROM p)")
def _(spark, sf):
    return dedup.exact(dedup.settled(passed(spark, sf).select("ord", "sha"))).select(F.col("ord").alias("doc_id"), "first", (F.col("first") != F.col("ord")).alias("duplicate"))


_SH = f"""sh0 AS (SELECT ord, list_transform({D.words('t')}, lambda x: lower(x)) AS w FROM p WHERE ord = (SELECT min(p2.ord) FROM p p2 WHERE p2.sha = p.sha)),
sh AS (SELECT DISTINCT ord, ('0x' || substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 15))::BIGINT AS h FROM sh0, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS g(i) WHERE len(w) > 0)"""


def shingled(spark: SparkSession, sf: str, shingles=digests.md5_shingles) -> DataFrame:
    p = kept_texts(passed(spark, sf))
    dedup.small_batches(spark)
    first = dedup.exact(p.select("ord", "sha")).filter("ord = first").select("ord")
    return p.join(first, "ord").select("ord", digests.said_shingles(F.col("words"), DEDUP["shingle_size"], shingles).alias("shingles"))


@query("word_shingles", f"WITH {_PASS}, {_SH} SELECT ord AS doc_id, count(*)::BIGINT AS n, min(h) AS least, bit_xor(h) AS mixed FROM sh GROUP BY ord")
def _(spark, sf):
    s = shingled(spark, sf).select("ord", F.explode("shingles").alias("h"))
    return s.groupBy(F.col("ord").alias("doc_id")).agg(F.count("*").alias("n"), F.min("h").alias("least"), F.bit_xor("h").alias("mixed"))


_PERM = dedup.permutations(DEDUP)
_SIG = "sg AS (SELECT ord, [" + ", ".join(f"min(({a}::HUGEINT * (h % {dedup.PRIME}) + {b}) % {dedup.PRIME})::BIGINT" for a, b in _PERM) + "] AS sig FROM sh GROUP BY ord)"


@query("minhash_signature", f"WITH {_PASS}, {_SH}, {_SIG} SELECT ord AS doc_id, array_to_string(sig, ',') AS sig FROM sg")
def _(spark, sf):
    return dedup.signatures(shingled(spark, sf), DEDUP).select(F.col("ord").alias("doc_id"), F.array_join(F.col("sig").cast("array<string>"), ",").alias("sig"))


@query("blake2b_signature")
def _(spark, sf):
    sh = dedup.settled(shingled(spark, sf, digests.shingles))
    return dedup.signatures(sh, DEDUP).join(sh, "ord").select(F.col("ord").alias("doc_id"), F.size("shingles").alias("n"), "sig")


@query("blake2b_near_dedup")
def _(spark, sf):
    return dedup.near(kept_texts(passed(spark, sf)), DEDUP, shingles=digests.shingles).withColumnRenamed("ord", "doc_id")


@query("lsh_candidates", f"""WITH {_PASS}, {_SH}, {_SIG}, b AS (SELECT ord, i AS band, array_to_string(sig[i * 4 + 1:i * 4 + 4], ',') AS key FROM sg, unnest(generate_series(0, 15)) AS g(i))
SELECT DISTINCT x.ord AS l, y.ord AS r FROM b x JOIN b y ON x.band = y.band AND x.key = y.key AND x.ord < y.ord""")
def _(spark, sf):
    return dedup.candidates(dedup.settled(dedup.signatures(shingled(spark, sf), DEDUP)), DEDUP)


_EDGES = """sz AS (SELECT ord, count(*) AS k FROM sh GROUP BY ord),
e AS (SELECT x.ord AS l, y.ord AS r, count(*) AS inter, any_value(a.k + b.k) - count(*) AS "all" FROM sh x JOIN sh y ON x.h = y.h AND x.ord < y.ord JOIN sz a ON a.ord = x.ord JOIN sz b ON b.ord = y.ord
  GROUP BY x.ord, y.ord HAVING count(*) >= 0.82 * (any_value(a.k + b.k) - count(*)))"""


@query("jaccard_pairs", f"WITH {_PASS}, {_SH}, {_EDGES} SELECT l, r, round(inter / \"all\", 6) AS jaccard FROM e")
def _(spark, sf):
    p = kept_texts(passed(spark, sf))
    dedup.small_batches(spark)
    sh = p.select("ord", digests.said_shingles(F.col("words"), DEDUP["shingle_size"], digests.md5_shingles).alias("shingles"))
    first = dedup.exact(p.select("ord", "sha")).filter("ord = first").select("ord")
    cand = dedup.settled(dedup.candidates(dedup.settled(dedup.signatures(sh, DEDUP)).join(first, "ord"), DEDUP))
    # only of texts in a candidate pair are whole sets needed
    sets = dedup.settled(sh.join(cand.select(F.explode(F.array("l", "r")).alias("ord")).distinct(), "ord", "left_semi"))
    got = dedup.pairs(sets, cand, DEDUP["jaccard_threshold"])
    return got.select("l", "r", F.round(F.col("both") / F.col("all"), 6).alias("jaccard"))


_NEAR = f"""{_PASS}, {_SH}, {_EDGES}, nb AS (SELECT r AS n, row_number() OVER (ORDER BY r) AS k, list(l) AS nb FROM e GROUP BY r),
st(k, rej) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT st.k + 1, CASE WHEN len(list_filter(nb.nb, lambda x: NOT list_contains(st.rej, x))) > 0 THEN list_append(st.rej, nb.n) ELSE st.rej END FROM st JOIN nb ON nb.k = st.k + 1),
rej AS (SELECT unnest(rej) AS n FROM (SELECT rej FROM st ORDER BY k DESC LIMIT 1)),
al AS (SELECT ord, source, lang, words, chars, min(ord) OVER (PARTITION BY sha) AS first FROM p),
two AS (SELECT r AS first, l AS kept, inter, "all" FROM e UNION ALL SELECT l, r, inter, "all" FROM e),
hit AS (SELECT al.ord, kept, inter / "all" AS j FROM al JOIN rej ON rej.n = al.first JOIN two ON two.first = al.first WHERE kept < al.ord AND kept NOT IN (SELECT n FROM rej)),
best AS (SELECT ord, kept, j FROM hit QUALIFY row_number() OVER (PARTITION BY ord ORDER BY j DESC, kept) = 1),
nd AS (SELECT al.ord, source, lang, words, chars, CASE WHEN best.ord IS NOT NULL THEN 'near_duplicate' WHEN al.ord = first THEN 'accepted' ELSE 'exact_duplicate' END AS verdict,
  CASE WHEN best.ord IS NOT NULL THEN kept WHEN al.ord <> first THEN first END AS duplicate_of, round(j, 6) AS jaccard FROM al LEFT JOIN best ON best.ord = al.ord)"""


def near(spark: SparkSession, sf: str, p: DataFrame | None = None) -> DataFrame:
    return dedup.near(p or kept_texts(passed(spark, sf)), DEDUP)


@query("near_dedup", f"WITH RECURSIVE {_NEAR} SELECT ord AS doc_id, verdict, duplicate_of, jaccard FROM nd")
def _(spark, sf):
    return near(spark, sf).withColumnRenamed("ord", "doc_id")


_CUR = f"""{_NEAR}, cu AS (SELECT m.doc_id, m.source, m.lang, m.words, m.chars, round(m.alpha_word_fraction, 6) AS alpha_word_fraction, round(m.symbol_to_word_ratio, 6) AS symbol_to_word_ratio, m.median_word_length, round(m.duplicate_line_fraction, 6) AS duplicate_line_fraction, CASE WHEN len(q.rs) > 0 THEN array_to_string(q.rs, ',') WHEN verdict <> 'accepted' THEN verdict ELSE '' END AS reasons,
  duplicate_of, jaccard, CASE WHEN len(q.rs) = 0 AND verdict = 'accepted' THEN {D.split('m.doc_id')} END AS split FROM m JOIN q USING (doc_id) LEFT JOIN nd ON nd.ord = m.doc_id)"""


def curated(spark: SparkSession, sf: str, links: bool = True) -> DataFrame:
    """Every document: reasons ('' if accepted), what it duplicates (unless ``links`` is false, for counts), its six measures and, if accepted, its split."""
    passes = F.size("rs") == 0
    # of a text that passes, its digest and words are kept, of others the measures alone
    s = dedup.settled(scored(spark, sf).select("ord", "source", "lang", F.col("m").dropFields("said").alias("m"), "rs", F.when(passes, T.content_hash(F.col("t"))).alias("sha"), F.when(passes, F.col("m.said")).alias("words")))
    v = (dedup.near if links else dedup.verdicts)(s.filter(passes).select("ord", "sha", "words"), DEDUP)
    why = F.when(F.size("rs") > 0, F.array_join("rs", ",")).when(F.col("verdict") != "accepted", F.col("verdict")).otherwise("")
    split = F.when(why == "", classify.split_of(F.col("ord").cast("string"), C.SPLIT))
    got = s.drop("sha", "words").join(v, "ord", "left")
    measures = [F.round(f"m.{c}", 6).alias(c) for c in ("alpha_word_fraction", "symbol_to_word_ratio", "duplicate_line_fraction")] + [F.col("m.median_word_length")]
    return got.select(F.col("ord").alias("doc_id"), "source", "lang", F.col("m.words").cast("long").alias("words"), F.col("m.chars").cast("long").alias("chars"), *measures, why.alias("reasons"), *(["duplicate_of", "jaccard"] if links else []), split.alias("split"))


@query("curate", f"WITH RECURSIVE {_CUR} SELECT * EXCLUDE (source, lang) FROM cu")
def _(spark, sf):
    return curated(spark, sf).drop("source", "lang")


@query("reject_reasons", f"WITH RECURSIVE {_CUR} SELECT reason, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM cu WHERE reasons <> '') GROUP BY reason")
def _(spark, sf):
    return reports.reason_counts(curated(spark, sf, links=False))


@query("topic_counts", f"WITH RECURSIVE {_CUR} SELECT topic, count(*)::BIGINT AS n, min(doc_id) AS first FROM (SELECT doc_id, unnest([source, lang]) AS topic FROM cu WHERE reasons = '') GROUP BY topic")
def _(spark, sf):
    got = curated(spark, sf, links=False).filter("reasons = ''").select("doc_id", F.explode(F.array("source", "lang")).alias("topic"))
    return got.groupBy("topic").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("corpus_totals", f"WITH RECURSIVE {_CUR} SELECT count(*)::BIGINT AS docs, sum(words)::BIGINT AS words, sum(chars)::BIGINT AS chars FROM cu WHERE reasons = ''")
def _(spark, sf):
    return curated(spark, sf, links=False).filter("reasons = ''").agg(F.count("*").alias("docs"), F.sum("words").alias("words"), F.sum("chars").alias("chars"))


@query("hash_split", f"SELECT doc_id, {D.split('doc_id')} AS split FROM documents")
def _(spark, sf):
    return X.docs(spark, sf).select("doc_id", classify.split_of(F.col("doc_id").cast("string"), C.SPLIT).alias("split"))


@query("output_shuffle", "SELECT doc_id, sha256('9:' || doc_id) AS place FROM documents")
def _(spark, sf):
    return classify.shuffled(X.docs(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("id")), "id", 9).select("doc_id", F.col("_order").alias("place"))


@query("curation_stats", f"""WITH RECURSIVE {_CUR}, ok AS (SELECT * FROM cu WHERE reasons = ''), r AS (SELECT 'raw' AS item, count(*)::BIGINT AS n FROM cu UNION ALL SELECT 'accepted', count(*) FROM ok UNION ALL SELECT 'rejected', count(*) FROM cu WHERE reasons <> ''
 UNION ALL SELECT 'words', sum(words)::BIGINT FROM ok UNION ALL SELECT 'chars', sum(chars)::BIGINT FROM ok UNION ALL SELECT 'split:' || split, count(*) FROM ok GROUP BY split
 UNION ALL SELECT 'source:' || coalesce(source, 'unknown'), count(*) FROM ok GROUP BY source UNION ALL SELECT 'lang:' || coalesce(lang, 'unknown'), count(*) FROM ok GROUP BY lang
 UNION ALL SELECT 'licence:' || coalesce({X.LICENCE_SQL}, 'unknown'), count(*) FROM ok GROUP BY {X.LICENCE_SQL}) SELECT item, n FROM r WHERE n > 0""")
def _(spark, sf):
    return reports.curation_stats(curated(spark, sf, links=False).withColumn("licence", X.licence()))


# reports


@query("autopsy", f"""WITH {X.MARKERS_SQL}, {D.cleaned()}, r AS (SELECT 'documents' AS item, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'contaminated', count(DISTINCT doc_id) FROM mk
 UNION ALL SELECT 'source:' || source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'marker:' || marker, sum(n)::BIGINT FROM mk GROUP BY marker
 UNION ALL SELECT 'original_chars', sum(original)::BIGINT FROM c UNION ALL SELECT 'removed_chars', sum(removed)::BIGINT FROM c
 UNION ALL SELECT 'category:' || coalesce({D.category('x', C.TEST_TOPICS)}, 'unclassified'), count(*) FROM x GROUP BY 1
 UNION ALL SELECT 'contaminated_fraction_ppm', round_even(1e6 * (SELECT count(DISTINCT doc_id) FROM mk) / count(*), 0)::BIGINT FROM documents
 UNION ALL SELECT 'removed_fraction_ppm', round_even(1e6 * sum(removed) / greatest(1, sum(original)), 0)::BIGINT FROM c) SELECT item, n FROM r""")
def _(spark, sf):
    d = X.derived(spark, sf)
    return reports.autopsy(d.withColumn("category", classify.classify_text(F.col("text"), C.TEST_TOPICS)))


@query("marker_examples", f"WITH {X.MARKERS_SQL} SELECT marker, doc_id, md5(replace(substr(x, 1, 500), chr(10), ' ')) AS snippet FROM mk JOIN x USING (doc_id) QUALIFY row_number() OVER (PARTITION BY marker ORDER BY doc_id) <= 3")
def _(spark, sf):
    return reports.marker_examples(X.markers(spark, sf), 3).select("marker", "doc_id", F.md5("snippet").alias("snippet"))


@query("cleaning_stats", f"""WITH {D.cleaned()}, r AS (SELECT 'removed_section:' || sec AS item, count(*)::BIGINT AS n FROM s WHERE sec IS NOT NULL GROUP BY sec
 UNION ALL SELECT 'removed_inline:no_competing_interests', sum(s0)::BIGINT FROM c UNION ALL SELECT 'removed_inline:authors_approved', sum(s1)::BIGINT FROM c UNION ALL SELECT 'removed_inline:authors_contributed', sum(s2)::BIGINT FROM c
 UNION ALL SELECT 'anchors', sum(anchors)::BIGINT FROM c UNION ALL SELECT 'tags', sum(tags)::BIGINT FROM c UNION ALL SELECT 'original_chars', sum(original)::BIGINT FROM c UNION ALL SELECT 'removed_chars', sum(removed)::BIGINT FROM c
 UNION ALL SELECT 'removed_fraction_ppm', round_even(1e6 * sum(removed) / sum(original), 0)::BIGINT FROM c) SELECT item, n FROM r WHERE n <> 0""")
def _(spark, sf):
    return reports.cleaning_stats(X.cleaned(spark, sf))


_CATEGORY = D.category("text", C.TEST_TOPICS)


def categorised(spark: SparkSession, sf: str) -> DataFrame:
    c = classify.classify_text(F.col("text"), C.TEST_TOPICS)
    return X.docs(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("id"), "source", c.alias("category"))


@query("category_counts", f"SELECT coalesce({_CATEGORY}, 'unclassified') AS category, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def _(spark, sf):
    return reports.category_counts(categorised(spark, sf))


QUOTAS = classify.quotas(6000, C.MIX)
_MIX = f"""ca AS (SELECT doc_id, doc_id::VARCHAR AS id, source, {_CATEGORY} AS category FROM documents), qu(category, quota) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in QUOTAS.items())}),
rk AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha256('42:' || id), id) AS r FROM ca WHERE category IS NOT NULL),
top AS (SELECT rk.* EXCLUDE (r) FROM rk JOIN qu USING (category) WHERE r <= quota),
mx AS (SELECT *, 'quota' AS picked FROM top UNION ALL SELECT * EXCLUDE (b), 'backfill' FROM (SELECT *, row_number() OVER (ORDER BY sha256('43:' || id), id) AS b FROM ca WHERE category IS NOT NULL AND id NOT IN (SELECT id FROM top)) WHERE b <= {sum(QUOTAS.values())} - (SELECT count(*) FROM top))"""


@query("target_counts", "SELECT * FROM (VALUES ('core_rehab', 2700::BIGINT), ('robotics', 1800), ('neurotechnology', 900), ('assistive', 600)) AS t(category, quota)")
def _(spark, sf):
    return spark.createDataFrame(list(QUOTAS.items()), "category string, quota long")


@query("scaled_targets", "SELECT * FROM (VALUES ('core_rehab', 2084::BIGINT), ('robotics', 1250), ('neurotechnology', 833), ('assistive', 833)) AS t(category, quota)")
def _(spark, sf):
    return spark.createDataFrame(list(classify.quotas(5000, C.HOSTED_MIX, whole=12_000, least=1, exact=round).items()), "category string, quota long")


@query("mixture_quota", f"WITH {_MIX} SELECT doc_id, category FROM top")
def _(spark, sf):
    return classify.select_mixture(categorised(spark, sf), QUOTAS, 42).filter("picked = 'quota'").select("doc_id", "category")


@query("select_mixture", f"WITH {_MIX} SELECT doc_id, category, picked FROM mx")
def _(spark, sf):
    return classify.select_mixture(categorised(spark, sf), QUOTAS, 42).select("doc_id", "category", "picked")


@query("build_report", f"""WITH {_MIX}, s AS (SELECT *, {D.split('id')} AS split FROM mx) SELECT coalesce('split:' || split, 'category:' || category, 'source:' || source, 'selected') AS item, count(*)::BIGINT AS n
 FROM s GROUP BY GROUPING SETS ((split), (category), (source), ())
 UNION ALL SELECT 'raw', count(*) FROM ca UNION ALL SELECT 'rejected', count(*) FROM ca WHERE category IS NULL UNION ALL SELECT 'accepted', count(*) FROM ca WHERE category IS NOT NULL
 UNION ALL SELECT 'words', coalesce(sum(len({D.words('text')})), 0)::BIGINT FROM s JOIN documents USING (doc_id)""")
def _(spark, sf):
    every = categorised(spark, sf)
    m = classify.select_mixture(every, QUOTAS, 42).withColumn("split", classify.split_of(F.col("id"), C.SPLIT))
    m = m.join(X.docs(spark, sf).select("doc_id", "text"), "doc_id").withColumn("words", F.size(T.word_tokens(F.col("text")))).drop("text")
    return reports.build_report(m, every)


@query("readiness", f"""WITH {_MIX}, sp AS (SELECT *, {D.split('id')} AS split FROM mx), a AS (SELECT count(*) AS n, count(*) FILTER (category = 'robotics') AS ro, count(*) FILTER (category = 'neurotechnology') AS ne,
 count(*) FILTER (split = 'val') AS v, count(*) FILTER (split = 'test') AS te FROM sp), {D.cleaned()}, z AS (SELECT sum(original) AS o, sum(removed) AS r FROM c),
 f AS (SELECT n >= 3500 AS enough_documents, ro / greatest(1, n) >= 0.12 AS robotics_representation, ne / greatest(1, n) >= 0.05 AS neurotechnology_representation, (ro + ne) / greatest(1, n) >= 0.2 AS combined_technology_representation,
 v >= 100 AS validation_size, te >= 100 AS test_size, o > 0 AND r / greatest(1, o) <= 0.3 AS cleaning_not_excessive, n, ro, ne, v, te FROM a, z)
 SELECT * EXCLUDE (n, ro, ne, v, te), array_to_string(list_filter([CASE WHEN NOT enough_documents THEN format('Need at least 3,500 selected documents; found {{:,}}.', n) END,
 CASE WHEN NOT robotics_representation THEN format('Need robotics fraction >= 12%; found {{:.1f}}% ({{:,}} documents).', 100 * (ro / greatest(1, n)), ro) END,
 CASE WHEN NOT neurotechnology_representation THEN format('Need neurotechnology fraction >= 5%; found {{:.1f}}% ({{:,}} documents).', 100 * (ne / greatest(1, n)), ne) END,
 CASE WHEN NOT combined_technology_representation THEN format('Need robotics + neurotechnology >= 20%; found {{:.1f}}%.', 100 * ((ro + ne) / greatest(1, n))) END,
 CASE WHEN NOT validation_size THEN format('Need at least 100 validation documents; found {{:,}}.', v) END, CASE WHEN NOT test_size THEN format('Need at least 100 test documents; found {{:,}}.', te) END,
 CASE WHEN NOT cleaning_not_excessive THEN 'Cleaning statistics are missing or the cleaner removed more than 30% of source characters.' END], lambda x: x IS NOT NULL), chr(10)) AS reasons, enough_documents AND robotics_representation AND neurotechnology_representation AND combined_technology_representation AND validation_size AND test_size AND cleaning_not_excessive AS ready FROM f""")
def _(spark, sf):
    m = classify.select_mixture(categorised(spark, sf), QUOTAS, 42).withColumn("split", classify.split_of(F.col("id"), C.SPLIT))
    c = X.cleaned(spark, sf).agg(F.sum("c.original_chars").alias("original_chars"), F.sum("c.removed_chars").alias("removed_chars"))
    return reports.readiness(m, c, C.GATE).select("checks.*", "ready", F.array_join("reasons", "\n").alias("reasons"))


@query("scan_stats", f"""WITH {D.NORM}, {D.metrics()}, s AS (SELECT doc_id, words, {X.LICENCE_SQL} AS licence, {D.category('t', C.TEST_TOPICS)} AS category, {D.reasons(C.HOSTED_LIMITS)} AS rs FROM m),
st AS (SELECT CASE WHEN licence IS NULL THEN 'missing_id_or_licence' WHEN category IS NULL THEN 'no_category' WHEN len(rs) > 0 THEN 'quality' END AS stage FROM s),
 a AS (SELECT *, {D.split('doc_id')} AS split FROM s WHERE licence IS NOT NULL AND category IS NOT NULL AND len(rs) = 0),
 r AS (SELECT 'scanned' AS item, count(*)::BIGINT AS n FROM s UNION ALL SELECT 'accepted', count(*) FROM a UNION ALL SELECT 'words', sum(words)::BIGINT FROM a UNION ALL SELECT 'category:' || category, count(*) FROM a GROUP BY category
 UNION ALL SELECT 'split:' || split, count(*) FROM a GROUP BY split UNION ALL SELECT 'licence:' || licence, count(*) FROM a GROUP BY licence
 UNION ALL SELECT 'rejected:' || stage, count(*) FROM st WHERE stage IS NOT NULL GROUP BY stage) SELECT item, n FROM r""")
def _(spark, sf):
    return reports.scan_stats(X.staged(spark, sf))


@query("stream_scan", f"""WITH {D.NORM}, {D.metrics()}, s AS (SELECT doc_id, sha256(t) AS sha, CASE WHEN {X.LICENCE_SQL} IS NULL THEN 'missing_id_or_licence' WHEN {D.category('t', C.TEST_TOPICS)} IS NULL THEN 'no_category'
 WHEN len({D.reasons(C.HOSTED_LIMITS)}) > 0 THEN 'quality' ELSE 'accepted' END AS stage FROM m),
 d AS (SELECT CASE WHEN stage = 'accepted' AND row_number() OVER (PARTITION BY sha, stage ORDER BY doc_id) > 1 THEN 'exact_duplicate' ELSE stage END AS stage FROM s) SELECT stage, count(*)::BIGINT AS n FROM d GROUP BY stage""")
def _(spark, sf):
    """The documents as a stream of files: judged, duplicates found by keyed state, and counted."""
    top = f"{dedup.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    docs = spark.readStream.schema(X.docs(spark, sf).schema).option("maxFilesPerTrigger", 100).parquet(f"{sf}/documents.parque[t]")  # a pattern may be a file or a folder
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text", F.expr(X.right("doc_id % 8")).alias("licence"))
    select.select_stream(rows, f"{top}/sink", f"{top}/checkpoint", C.TEST_TOPICS).awaitTermination()
    return select.stage_counts(spark, f"{top}/sink")


# instructions


_TURNS = """t AS (SELECT *, lag(role) OVER w AS pr, lag(text) OVER w AS pt, max(CASE WHEN role = 'system' THEN text END) OVER (PARTITION BY conv_id) AS sys FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
ex0 AS (SELECT conv_id * 1000 + turn AS ord, """ + ", ".join(f"{D.strip(x)} AS {n}" for x, n in (("pt", "instruction"), ("coalesce(sys, '')", "context"), ("text", "response"))) + " FROM t WHERE role = 'assistant' AND pr = 'user'), ex AS (SELECT * FROM ex0 WHERE instruction <> '' AND response <> '')"
_FP = f"{_TURNS}, fp AS (SELECT *, sha256(concat_ws(chr(10), instruction, context, response)) AS fp FROM ex), last AS (SELECT * FROM fp QUALIFY row_number() OVER (PARTITION BY fp ORDER BY ord DESC) = 1)"


def examples(spark: SparkSession, sf: str) -> DataFrame:
    return instructions.from_conversations(spark.read.parquet(f"{sf}/conversations.parquet"))


@query("instruction_valid", f"WITH {_TURNS} SELECT ord, md5(instruction) AS i, md5(context) AS c, md5(response) AS r FROM ex")
def _(spark, sf):
    return instructions.valid(examples(spark, sf)).select("ord", F.md5("instruction").alias("i"), F.md5("context").alias("c"), F.md5("response").alias("r"))


@query("instruction_dedup", f"WITH {_FP} SELECT fp, ord FROM last")
def _(spark, sf):
    return instructions.last_of_each(instructions.valid(examples(spark, sf))).select("fp", "ord")


@query("instruction_split", f"WITH {_FP} SELECT fp, CASE WHEN (row_number() OVER (ORDER BY fp) - 1) % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM last")
def _(spark, sf):
    return instructions.every_kth(instructions.last_of_each(instructions.valid(examples(spark, sf))), 0.1).select("fp", "split")


@query("format_prompt", f"WITH {_TURNS} SELECT ord, md5('### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || CASE WHEN context <> '' THEN '### Context:' || chr(10) || context || chr(10) || chr(10) ELSE '' END || '### Response:' || chr(10)) AS prompt FROM ex")
def _(spark, sf):
    return instructions.valid(examples(spark, sf)).select("ord", F.md5(T.format_prompt(F.col("instruction"), F.col("context"))).alias("prompt"))


@query("prepare_instructions", f"WITH {_FP}, s AS (SELECT ord, substr(fp, 1, 12) AS id, CASE WHEN (row_number() OVER (ORDER BY fp) - 1) % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM last) SELECT split, count(*)::BIGINT AS n, min(id) AS least FROM s GROUP BY split")
def _(spark, sf):
    s = instructions.every_kth(instructions.last_of_each(instructions.valid(examples(spark, sf))), 0.1)
    return s.groupBy("split").agg(F.count("*").alias("n"), F.min(F.substring("fp", 1, 12)).alias("least"))


# a tokenizer that any engine has: a word's id is its length and first code point
_IDS = "list_transform(regexp_extract_all({0}, '[^ ]+'), lambda x: (10 + length(x) * 7 + unicode(x) % 50)::BIGINT)"
_CTX = 64


@query("label_mask", f"""WITH {_TURNS}, p AS (SELECT ord, list_concat([2::BIGINT], {_IDS.format("'### ' || instruction")})[1:{_CTX}] AS p, list_append({_IDS.format('response')}, 3::BIGINT) AS r FROM ex),
 f AS (SELECT ord, len(p) AS np, list_concat(p, r[1:greatest(0, {_CTX + 1} - len(p))])[1:{_CTX + 1}] AS fl FROM p),
 x AS (SELECT ord, list_concat(fl[1:len(fl) - 1], list_resize([]::BIGINT[], {_CTX} - len(fl) + 1, 0::BIGINT)) AS x, list_concat(list_resize([]::BIGINT[], np - 1, -100::BIGINT), fl[np + 1:len(fl)], list_resize([]::BIGINT[], {_CTX} - len(fl) + 1, -100::BIGINT)) AS y FROM f)
 SELECT ord, array_to_string(x, ',') AS x, array_to_string(y, ',') AS y FROM x""")
def _(spark, sf):
    ids = lambda c: F.transform(F.regexp_extract_all(c, F.lit("[^ ]+"), F.lit(0)), lambda x: (10 + F.length(x) * 7 + F.ascii(x) % 50).cast("long"))
    v = instructions.valid(examples(spark, sf))
    got = v.select("ord", instructions.masked(ids(F.concat(F.lit("### "), F.col("instruction"))), ids(F.col("response")), _CTX).alias("m"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return got.select("ord", text("m.x").alias("x"), text("m.y").alias("y"))


# tokens


@query("token_blocks", f"""WITH w AS (SELECT doc_id, unnest(list_transform(list_concat(['s'], regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), ['e']), lambda x: length(x)::BIGINT)) AS tok, generate_subscripts(list_concat(['s'], regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), ['e']), 1) AS i FROM documents),
 p AS (SELECT tok, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos FROM w), n AS (SELECT greatest(1, (count(*) - 1) // 128) AS n FROM p),
 x AS (SELECT pos // 128 AS block, count(*)::BIGINT AS n, sum(tok * (pos % 128 + 1))::BIGINT AS digest FROM p, n WHERE pos // 128 < n.n GROUP BY 1),
 y AS (SELECT (pos - 1) // 128 AS block, sum(tok * ((pos - 1) % 128 + 1))::BIGINT AS shifted FROM p WHERE pos > 0 GROUP BY 1) SELECT block, n, digest, shifted FROM x JOIN y USING (block)""")
def _(spark, sf):
    w = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    d = X.docs(spark, sf).select(F.col("doc_id").alias("ord"), F.transform(F.concat(F.array(F.lit("s")), w, F.array(F.lit("e"))), lambda x: F.length(x).cast("long")).alias("ids"))
    b = tokens.blocks(d, 128)
    digest = lambda c: F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return b.select("block", F.size("ids").cast("long").alias("n"), digest("ids").alias("digest"), digest("y").alias("shifted"))


@query("encode_tokens")
def _(spark, sf):
    return tokens.encode(X.docs(spark, sf).select(F.col("doc_id").alias("ord"), "text")).select(F.col("ord").alias("doc_id"), F.size("ids").cast("long").alias("n"))


@query("decode_tokens")
def _(spark, sf):
    """Texts that a tokenizer has taken apart and put together again."""
    d = tokens.decode(tokens.encode(X.docs(spark, sf).select(F.col("doc_id").alias("ord"), "text")))
    return d.select(F.col("ord").alias("doc_id"), F.md5("text").alias("digest"))


def encoded_corpus(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (ord, text) as one stream of ids, written to flat int32 files in ``path`` and read from them: (block, start, ids), every id of it."""
    spark = docs.sparkSession
    sinks.token_files(tokens.encode(tokens.in_order(docs), bos=True, eos=True, mark="<eos>"), path)
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1).alias("file")
    lengths = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.bin").load(path).select(name("path"), F.floor(F.col("length") / 4).alias("n"))
    return tokens.stream(sinks.token_ranges(spark, path).select(name("file"), "start", "ids"), lengths, 512)


@query("encode_corpus")
def _(spark, sf):
    rows = encoded_corpus(X.docs(spark, sf).select(F.col("doc_id").alias("ord"), "text"), f"{dedup.shared_dir(spark)}/loam/tokens-{uuid.uuid4().hex}")
    return rows.select("block", F.size("ids").cast("long").alias("n"), "start", F.xxhash64("ids").alias("digest"))


@query("random_windows")
def _(spark, sf):
    d = tokens.encode(X.docs(spark, sf).select(F.col("doc_id").alias("ord"), "text"), bos=True, eos=True)
    return tokens.random_windows(tokens.blocks(d, 512), 512, 64, seed=7)


@query("bpe_merges")
def _(spark, sf):
    """A vocabulary of 8,000 pieces with the special ones, as (step, left, right, n) for its merges."""
    v = bpe.vocabulary(X.docs(spark, sf).select("text"), 8000)
    return v.filter("left IS NOT NULL").select((F.col("id") - len(bpe.SPECIALS)).alias("step"), "left", "right", "n")


@query("unigram_vocabulary")
def _(spark, sf):
    """A vocabulary of 8,000 pieces of the other model: (id, piece, score)."""
    return unigram.vocabulary(X.docs(spark, sf).select("text"), 8000)


@query("flatten_nested", f"SELECT doc_id, md5(array_to_string(list_filter([{D.strip('source')}, {D.strip('text')}], lambda x: x <> ''), chr(10) || chr(10))) AS digest FROM documents")
def _(spark, sf):
    d = X.docs(spark, sf)
    passage = lambda kind, c: F.struct(F.lit(kind).alias("section_type"), c.alias("text"))
    payload = F.to_json(F.array(F.struct(F.array(F.struct(F.array(passage("TITLE", F.col("source")), passage("REF", F.lit("gone")), passage("INTRO", F.col("text"))).alias("passages"))).alias("documents"))))
    return d.select("doc_id", articles.flatten_passages(payload).alias("text")).select("doc_id", F.md5("text").alias("digest"))
