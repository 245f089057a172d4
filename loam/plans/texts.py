"""Queries of one text at a time: functions, quality, cleaning, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam import config as C
from loam.functions import text as T
from loam.operators import classify, cleaning, quality
from loam.plans import duck as D
from loam.plans.registry import query


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows dealt to all cores where their files make fewer tasks than that, as a small table or one row group does; larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def normalised(spark: SparkSession, sf: str) -> DataFrame:
    return spread(docs(spark, sf)).select("doc_id", "source", "lang", T.normalise_text(F.col("text")).alias("t"))


def measured(df: DataFrame, c: str = "t", *keep: str) -> DataFrame:
    return df.select(*keep, quality.metrics(F.col(c)).alias("m"))


def once(df: DataFrame, made: Column) -> DataFrame:
    """``df`` and the fields of a struct that is worked out once a row: a filter on them can't be moved before, where it would work them out again."""
    return df.select("*", F.inline(F.array(made)))


def derived(spark: SparkSession, sf: str) -> DataFrame:
    return spread(docs(spark, sf)).select("doc_id", "source", "lang", F.expr(D.DERIVED).alias("text"))


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf).select("doc_id", "source", "lang", cleaning.clean(F.col("text")).alias("c"))


def longs(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


@query("normalise_text", f"WITH {D.NORM} SELECT doc_id, t AS text FROM n")
def _(spark, sf):
    return normalised(spark, sf).select("doc_id", F.col("t").alias("text"))


@query("word_tokens", f"WITH {D.NORM}, w AS (SELECT doc_id, {D.words('t')} AS w FROM n) SELECT doc_id, len(w)::BIGINT AS n, md5(array_to_string(w, ' ')) AS digest FROM w")
def _(spark, sf):
    w = normalised(spark, sf).select("doc_id", T.word_tokens(F.col("t")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


_METRICS = "doc_id, words, chars, round(alpha_word_fraction, 6) AS alpha_word_fraction, round(symbol_to_word_ratio, 6) AS symbol_to_word_ratio, median_word_length, round(duplicate_line_fraction, 6) AS duplicate_line_fraction"


@query("quality_metrics", f"WITH {D.NORM}, {D.metrics()} SELECT {_METRICS} FROM m")
def _(spark, sf):
    m = longs(measured(normalised(spark, sf), "t", "doc_id").select("doc_id", "m.*"), "words", "chars")
    return m.withColumns({c: F.round(c, 6) for c in ("alpha_word_fraction", "symbol_to_word_ratio", "duplicate_line_fraction")})


@query("quality_reasons", f"WITH {D.NORM}, {D.metrics()} SELECT doc_id, array_to_string({D.reasons(C.LIMITS)}, ',') AS reasons FROM m")
def _(spark, sf):
    return measured(normalised(spark, sf), "t", "doc_id").select("doc_id", F.array_join(quality.reasons(F.col("m"), C.LIMITS), ",").alias("reasons"))


@query("dup_line_fraction", f"WITH {D.NORM}, {D.metrics()} SELECT doc_id, round(duplicate_line_fraction, 6) AS fraction FROM m")
def _(spark, sf):
    d = normalised(spark, sf).select("doc_id", T.duplicate_lines(F.col("t")).alias("d"))
    return d.select("doc_id", F.round(F.when(F.col("d.lines") == 0, 1.0).otherwise(F.col("d.duplicated") / F.col("d.lines")), 6).alias("fraction"))


@query("content_hash", f"WITH {D.NORM} SELECT doc_id, sha256(t) AS sha FROM n")
def _(spark, sf):
    return normalised(spark, sf).select("doc_id", T.content_hash(F.col("t")).alias("sha"))


@query("heading_key", f"WITH {D.cleaned()} SELECT doc_id, pos::BIGINT AS pos, {D.heading('line')} AS heading FROM ln WHERE {D.heading('line')} IS NOT NULL")
def _(spark, sf):
    lines = derived(spark, sf).select("doc_id", F.posexplode(T.splitlines(T.unix_newlines(F.col("text")))).alias("p", "line"))
    return lines.select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), cleaning.heading_key(F.col("line")).alias("heading")).filter("heading IS NOT NULL")


@query("html_strip", f"SELECT page_id, {D.count('html', cleaning.ANCHOR)} AS anchors, {D.count('html', cleaning.TAG)} AS tags, md5({D.sub(D.sub('html', cleaning.ANCHOR), cleaning.TAG, "' '")}) AS digest FROM pages")
def _(spark, sf):
    p, h = spark.read.parquet(f"{sf}/pages.parquet"), F.col("html")
    count = lambda x: F.regexp_count(h, F.lit(x)).cast("long")
    return p.select("page_id", count(cleaning.ANCHOR).alias("anchors"), count(cleaning.TAG).alias("tags"), F.md5(cleaning.strip_markup(h)).alias("digest"))


def _inline() -> str:
    x, out = D.DERIVED, []
    for k, p in cleaning.SENTENCES.items():
        out.append(f"{D.count(x, p)} AS {k}")
        x = D.sub(x, p)
    return f"SELECT doc_id, {', '.join(out)}, md5({x}) AS digest FROM documents"


@query("inline_removal", _inline())
def _(spark, sf):
    t, counts = cleaning.remove_sentences(F.col("text"))
    return derived(spark, sf).select("doc_id", *[v.cast("long").alias(k) for k, v in counts.items()], F.md5(t).alias("digest"))


# licence texts made of the documents' numbers, alike in both engines
_RIGHTS = ("https://creativecommons.org/licenses/by/4.0/", "https://creativecommons.org/licenses/by-sa/4.0/", "https://creativecommons.org/publicdomain/zero/1.0/", "https://creativecommons.org/licenses/by-nc/4.0/", "CC BY 4.0", "xcc0y", "CC0 1.0", "all rights reserved")


def right(i: str) -> str:
    return f"CASE {i} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_RIGHTS)) + " END"


def _ladder(x: str, zero: str, by: str) -> str:
    return f"""CASE WHEN {zero} THEN 'CC0' WHEN contains({x}, 'creativecommons.org/licenses/by-sa/') OR contains({x}, 'cc by-sa') THEN 'CC-BY-SA'
 WHEN (contains({x}, 'creativecommons.org/licenses/by/') OR {by}) AND NOT contains({x}, 'by-nc') AND NOT contains({x}, 'by-nd') THEN 'CC-BY' END"""


_ZERO = r"(contains(r, 'creativecommons.org/publicdomain/zero') OR regexp_matches(r, '\bcc0\b'))"
_BY = r"regexp_matches(r, '\bcc by\b')"


@query("licence_rights", f"WITH r AS (SELECT doc_id, lower({right('doc_id % 8')} || ' ' || {right('doc_id % 5')}) AS r FROM documents) SELECT doc_id, {_ladder('r', _ZERO, _BY)} AS licence FROM r")
def _(spark, sf):
    rights = F.array(F.expr(right("doc_id % 8")), F.expr(right("doc_id % 5")))
    return docs(spark, sf).select("doc_id", classify.licence_of_rights(rights).alias("licence"))


LICENCE_SQL = _ladder("lower(" + right("doc_id % 8") + ")", "(contains(lower(" + right("doc_id % 8") + "), 'publicdomain/zero') OR contains(lower(" + right("doc_id % 8") + "), 'cc0'))", "contains(lower(" + right("doc_id % 8") + "), 'cc by')")


def licence():
    return classify.licence_of_value(F.expr(right("doc_id % 8")))


@query("licence_meta", f"SELECT doc_id, {LICENCE_SQL} AS licence FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", licence().alias("licence"))


@query("rights_filter", f"SELECT doc_id, {LICENCE_SQL} AS licence FROM documents WHERE {LICENCE_SQL} IN ('CC0', 'CC-BY', 'CC-BY-SA')")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", licence().alias("licence")).filter(classify.allowed(F.col("licence")))


@query("min_length", "SELECT doc_id, length(text)::BIGINT AS chars FROM documents WHERE length(text) >= 500")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.length("text").cast("long").alias("chars")).filter("chars >= 500")


@query("classify_document", f"SELECT doc_id, {D.category('text', C.TEST_TOPICS)} AS category FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", classify.classify_text(F.col("text"), C.TEST_TOPICS).alias("category"))


_TAG = "CASE doc_id % 9 WHEN 0 THEN 'Gait_Robot' WHEN 1 THEN 'professional' WHEN 2 THEN 'Wheelchair' ELSE 'other' END"
_GIVEN = "CASE WHEN doc_id % 11 = 0 THEN ' assistive ' WHEN doc_id % 11 = 1 THEN 'unknown' END"


@query("classify_record", f"""WITH x AS (SELECT doc_id, trim(coalesce({_GIVEN}, '')) AS g, lower({_TAG} || ' ' || source) AS j, text FROM documents)
SELECT doc_id, CASE WHEN g IN ('core_rehab', 'robotics', 'neurotechnology', 'assistive') THEN g WHEN regexp_matches(j, 'robot|exoskeleton|gait_robot') THEN 'robotics'
 WHEN regexp_matches(j, 'fes|bci|neurotechnology|emg') THEN 'neurotechnology' WHEN regexp_matches(j, 'assistive|prosthe|orthot|wheelchair') THEN 'assistive' ELSE {D.category('text', C.TEST_TOPICS)} END AS category FROM x""")
def _(spark, sf):
    got = classify.classify_record(F.expr(_GIVEN), F.array(F.expr(_TAG)), F.array("source"), F.col("text"), C.TEST_TOPICS)
    return docs(spark, sf).select("doc_id", got.alias("category"))


@query("staged_filter", f"""WITH {D.NORM}, {D.metrics()}, s AS (SELECT doc_id, CASE WHEN {LICENCE_SQL} IS NULL THEN 'missing_id_or_licence' WHEN {D.category('t', C.TEST_TOPICS)} IS NULL THEN 'no_category'
 WHEN len({D.reasons(C.HOSTED_LIMITS)}) > 0 THEN 'quality' ELSE 'accepted' END AS stage FROM m) SELECT stage, count(*)::BIGINT AS n FROM s GROUP BY stage""")
def _(spark, sf):
    return staged(spark, sf).groupBy("stage").agg(F.count("*").alias("n"))


def staged(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's first stage that fails; later stages are only worked out for rows that reach them."""
    n = normalised(spark, sf).select("doc_id", licence().alias("licence"), classify.classify_text(F.col("t"), C.TEST_TOPICS).alias("category"), "t")
    bad = quality.reasons(quality.metrics(F.col("t")), C.HOSTED_LIMITS)
    stage = F.when(F.col("licence").isNull(), "missing_id_or_licence").when(F.col("category").isNull(), "no_category").when(F.size(bad) > 0, "quality").otherwise("accepted")
    return n.select("doc_id", "licence", "category", "t", stage.alias("stage"))


@query("clean_filter", f"WITH {D.cleaned()}, n AS (SELECT doc_id, text AS t FROM c), {D.metrics()} SELECT doc_id, words FROM m WHERE len({D.reasons(C.CLEAN_LIMITS)}) = 0")
def _(spark, sf):
    c = cleaned(spark, sf).select("doc_id", F.col("c.text").alias("t"))
    m = T.let(quality.metrics(F.col("t")), lambda x: F.struct(x["words"].cast("long").alias("words"), F.size(quality.reasons(x, C.CLEAN_LIMITS)).alias("broken")))
    return once(c, m).filter("broken = 0").select("doc_id", "words")


def _markers() -> str:
    x = D.DERIVED
    out = [f"SELECT doc_id, 'heading:{k}' AS marker, count(*)::BIGINT AS n FROM h WHERE regexp_matches(b, {D.lit(p)}) GROUP BY doc_id" for k, p in cleaning.BOILERPLATE.items()]
    more = [(f"inline:{k}", p) for k, p in cleaning.SENTENCES.items()] + [("markup:section_anchor", cleaning.ANCHOR), ("markup:html_tag", cleaning.TAG)]
    out += [f"SELECT doc_id, '{k}', {D.count('x', p)} FROM x" for k, p in more]
    return f"""x AS (SELECT doc_id, source, {x} AS x FROM documents), h AS (SELECT doc_id, {D.bare('l')} AS b FROM (SELECT doc_id, unnest(string_split(regexp_replace(x, '{D.BREAK}', chr(10), 'g'), chr(10))) AS l FROM x)),
mk AS (SELECT * FROM ({' UNION ALL '.join(out)}) WHERE n > 0)"""


MARKERS_SQL = _markers()


def markers(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf).select("doc_id", "source", "text", F.explode(cleaning.contamination(F.col("text"))).alias("marker", "n"))


@query("contamination", f"WITH {MARKERS_SQL} SELECT doc_id, marker, n FROM mk")
def _(spark, sf):
    return markers(spark, sf).select("doc_id", "marker", "n")


@query("clean_document", f"WITH {D.cleaned()} SELECT doc_id, md5(text) AS digest, original AS original_chars, length(text)::BIGINT AS cleaned_chars, removed AS removed_chars, anchors, tags FROM c")
def _(spark, sf):
    c = cleaned(spark, sf)
    return c.select("doc_id", F.md5("c.text").alias("digest"), *[F.col(f"c.{k}").cast("long").alias(k) for k in ("original_chars", "cleaned_chars", "removed_chars", "anchors", "tags")])


@query("removed_sections", f"WITH {D.cleaned()} SELECT doc_id, sec AS section, count(*)::BIGINT AS n FROM s WHERE sec IS NOT NULL GROUP BY doc_id, sec")
def _(spark, sf):
    return cleaned(spark, sf).select("doc_id", F.explode("c.sections").alias("section", "n"))
