"""Counts and gates over a corpus."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.config import SPLIT
from loam.functions import text as T
from loam.operators import classify, cleaning


def reason_counts(curated: DataFrame) -> DataFrame:
    return curated.filter("reasons <> ''").select(F.explode(F.split("reasons", ",")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def category_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("category", F.lit("unclassified")).alias("category")).agg(F.count("*").alias("n"))


def _ppm(sums: DataFrame, item: str, part: str, whole: str) -> DataFrame:
    """``part`` of ``whole``, two items of ``sums`` (item, n), in millionths, as a row."""
    of = lambda k: F.sum(F.when(F.col("item") == k, F.col("n")))
    return sums.agg(F.lit(item).alias("item"), F.bround(1e6 * of(part) / F.greatest(of(whole), F.lit(1)), 0).cast("long").alias("n"))


def autopsy(docs: DataFrame) -> DataFrame:
    """``docs`` (source, category, text) to (item, n) in one pass: each document gives its items, summed as they are met; then fractions of them."""
    c = docs.select("source", "category", cleaning.contamination(F.col("text")).alias("m"), cleaning.clean(F.col("text")).alias("c"))
    pair = lambda k, v: F.struct(k.alias("item"), v.cast("long").alias("n"))
    items = F.concat(
        F.array(
            pair(F.lit("documents"), F.lit(1)), pair(F.lit("contaminated"), (F.size("m") > 0).cast("int")), pair(F.concat(F.lit("source:"), F.coalesce("source", F.lit("unknown"))), F.lit(1)),
            pair(F.concat(F.lit("category:"), F.coalesce("category", F.lit("unclassified"))), F.lit(1)),
            pair(F.lit("original_chars"), F.col("c.original_chars")), pair(F.lit("removed_chars"), F.col("c.removed_chars")),
        ),
        F.transform(F.map_entries("m"), lambda e: pair(F.concat(F.lit("marker:"), e["key"]), e["value"])),
    )
    sums = c.select(F.inline(items)).groupBy("item").agg(F.sum("n").alias("n"))
    fractions = _ppm(sums, "contaminated_fraction_ppm", "contaminated", "documents").unionByName(_ppm(sums, "removed_fraction_ppm", "removed_chars", "original_chars"))
    return sums.unionByName(fractions.filter("n IS NOT NULL"))


def marker_examples(markers: DataFrame, k: int) -> DataFrame:
    """The first k documents of each marker; all but k a task are cut before the shuffle."""
    r = F.row_number().over(Window.partitionBy("marker").orderBy("doc_id"))
    return markers.withColumn("_r", r).filter(F.col("_r") <= k).withColumn("snippet", T.snippet(F.col("text"))).drop("_r")


def cleaning_stats(cleaned: DataFrame) -> DataFrame:
    pair = lambda k, v: F.struct(k.alias("item"), v.cast("long").alias("n"))
    named = lambda prefix, m: F.transform(F.map_entries(m), lambda e: pair(F.concat(F.lit(prefix), e["key"]), e["value"]))
    plain = F.array(*[pair(F.lit(k), F.col(f"c.{k}")) for k in ("anchors", "tags", "original_chars", "removed_chars")])
    sums = cleaned.select(F.inline(F.concat(plain, named("removed_section:", "c.sections"), named("removed_inline:", "c.sentences")))).groupBy("item").agg(F.sum("n").alias("n"))
    return sums.unionByName(_ppm(sums, "removed_fraction_ppm", "removed_chars", "original_chars")).filter("n <> 0")


def build_report(selected: DataFrame, offered: DataFrame) -> DataFrame:
    """(item, n): what was ``offered`` (category), and ``selected`` (split, category, source, words) of it by split, category and source, and in all."""
    g = selected.groupingSets([["split"], ["category"], ["source"], []], "split", "category", "source").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = lambda p, c: F.concat(F.lit(p), F.coalesce(c, F.lit("unknown")))
    item = F.when(F.col("g") == 3, name("split:", "split")).when(F.col("g") == 5, name("category:", "category")).when(F.col("g") == 6, name("source:", "source")).otherwise("selected")
    pair = lambda k, v: F.struct(F.lit(k).alias("item"), v.cast("long").alias("n"))
    raw = offered.agg(F.count("*").alias("raw"), F.count(F.when(F.col("category").isNull(), 1)).alias("rejected"))
    raw = raw.select(F.inline(F.array(pair("raw", F.col("raw")), pair("rejected", F.col("rejected")), pair("accepted", F.col("raw") - F.col("rejected")))))
    words = selected.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).select(F.lit("words").alias("item"), F.col("n").cast("long"))
    return g.select(item.alias("item"), "n").unionByName(raw).unionByName(words)


def scan_stats(staged: DataFrame) -> DataFrame:
    ok = F.col("stage") == "accepted"
    split = classify.split_of(F.col("doc_id").cast("string"), SPLIT)
    pair = lambda k, v: F.struct(k.alias("item"), v.cast("long").alias("n"))
    named = lambda p, c: F.when(ok, pair(F.concat(F.lit(p), c), F.lit(1)))
    items = F.array(
        pair(F.lit("scanned"), F.lit(1)), F.when(ok, pair(F.lit("accepted"), F.lit(1))), F.when(ok, pair(F.lit("words"), F.size(T.word_tokens(F.col("t"))))),
        named("category:", F.col("category")), named("split:", split), named("licence:", F.col("licence")),
        F.when(~ok, pair(F.concat(F.lit("rejected:"), F.col("stage")), F.lit(1))),
    )
    return staged.select(F.inline(F.array_compact(items))).groupBy("item").agg(F.sum("n").alias("n"))


# fixed values: what the gate says of each check that fails
MESSAGES = (
    ("enough_documents", "Need at least {bound:,} selected documents; found {found}."),
    ("robotics_representation", "Need robotics fraction >= {bound:.0%}; found {found}."),
    ("neurotechnology_representation", "Need neurotechnology fraction >= {bound:.0%}; found {found}."),
    ("combined_technology_representation", "Need robotics + neurotechnology >= {bound:.0%}; found {found}."),
    ("validation_size", "Need at least {bound:,} validation documents; found {found}."),
    ("test_size", "Need at least {bound:,} test documents; found {found}."),
    ("cleaning_not_excessive", "Cleaning statistics are missing or the cleaner removed more than {bound:.0%} of source characters."),
)


def readiness(selected: DataFrame, cleaning_sums: DataFrame, gate: Mapping[str, float]) -> DataFrame:
    """One row: checks (struct), metrics (struct), ready, reasons (of the checks that fail, in order). ``gate``: each check's bound."""
    n = lambda c: F.count(F.when(c, 1))
    a = selected.agg(
        F.count("*").alias("selected"), n(F.col("category") == "robotics").alias("robotics"), n(F.col("category") == "neurotechnology").alias("neuro"),
        n(F.col("split") == "val").alias("val"), n(F.col("split") == "test").alias("test"),
    )
    x = a.crossJoin(F.broadcast(cleaning_sums))  # one row each
    of = lambda c: c / F.greatest(F.lit(1), F.col("selected"))
    robotics, neuro, tech = of(F.col("robotics")), of(F.col("neuro")), of(F.col("robotics") + F.col("neuro"))
    removed = F.coalesce("removed_chars", F.lit(0)) / F.greatest(F.lit(1), F.coalesce("original_chars", F.lit(0)))
    whole = lambda c: F.format_number(F.col(c), 0)
    percent = lambda c: F.format_string("%.1f%%", 100 * c)
    documents = lambda share, c: F.concat(percent(share), F.lit(" ("), whole(c), F.lit(" documents)"))
    checks = {  # what is measured, whether it must be the bound at least or at most, and how it is said
        "enough_documents": (F.col("selected"), True, whole("selected")),
        "robotics_representation": (robotics, True, documents(robotics, "robotics")),
        "neurotechnology_representation": (neuro, True, documents(neuro, "neuro")),
        "combined_technology_representation": (tech, True, percent(tech)),
        "validation_size": (F.col("val"), True, whole("val")),
        "test_size": (F.col("test"), True, whole("test")),
        "cleaning_not_excessive": (F.when(F.col("original_chars") > 0, removed).otherwise(F.lit(float("inf"))), False, F.lit("")),
    }
    holds = {k: found >= gate[k] if least else found <= gate[k] for k, (found, least, _) in checks.items()}
    named = F.struct(*[holds[k].alias(k) for k, _ in MESSAGES])
    metrics = F.struct(
        F.col("selected").alias("selected_documents"), F.col("robotics").alias("robotics_documents"), F.col("neuro").alias("neurotechnology_documents"),
        robotics.alias("robotics_fraction"), neuro.alias("neurotechnology_fraction"), tech.alias("combined_technology_fraction"),
        F.col("val").alias("validation_documents"), F.col("test").alias("test_documents"), removed.alias("cleaning_removed_fraction"),
    )

    def said(check: str, message: str) -> Column:
        before, mark, after = message.format(bound=gate[check], found="\0").partition("\0")
        return F.concat(F.lit(before), checks[check][2], F.lit(after)) if mark else F.lit(before)

    why = F.array_compact(F.array(*[F.when(~holds[k], said(k, m)) for k, m in MESSAGES]))
    return x.select(named.alias("checks"), metrics.alias("metrics"), (F.size(why) == 0).alias("ready"), why.alias("reasons"))


def require_ready(verdict: DataFrame) -> None:
    """The strict gate: raises with the reasons of a verdict by ``readiness``, which is one row."""
    row = verdict.select("ready", "reasons").first()
    if not row["ready"]:
        raise SystemExit("\n".join(row["reasons"]))


def curation_stats(curated: DataFrame) -> DataFrame:
    """(item, n) of a curation: raw, accepted and rejected documents, accepted words and characters, and accepted documents by split, source, language and licence."""
    ok = F.col("reasons") == ""
    pair = lambda k, v: F.struct(k.alias("item"), v.cast("long").alias("n"))
    of = lambda p, c: F.when(ok, pair(F.concat(F.lit(p), F.coalesce(F.col(c), F.lit("unknown"))), F.lit(1)))
    items = F.array(
        pair(F.lit("raw"), F.lit(1)), pair(F.when(ok, "accepted").otherwise("rejected"), F.lit(1)), F.when(ok, pair(F.lit("words"), F.col("words"))),
        F.when(ok, pair(F.lit("chars"), F.col("chars"))), of("split:", "split"), of("source:", "source"), of("lang:", "lang"), of("licence:", "licence"),
    )
    return curated.select(F.inline(F.array_compact(items))).groupBy("item").agg(F.sum("n").alias("n"))


def require_documents(stats: DataFrame, least: int) -> None:
    """Raises if a scan's statistics (item, n) count fewer accepted documents."""
    found = stats.filter("item = 'accepted'").agg(F.sum("n")).first()[0] or 0
    if found < least:
        raise SystemExit(f"{found:,} documents were accepted; at least {least:,} are needed")
