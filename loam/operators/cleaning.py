"""Removal of boilerplate sections, sentences and markup from articles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.functions import text as T

# fixed values: headings of sections that go, headings that end them, sentences that go, and markup
BOILERPLATE = {
    "competing_interests": r"(?i)^(conflicts? of interest|conflict-of-interest|competing interests?|declaration of interests?)\s*:?$",
    "author_contributions": r"(?i)^(authors?'? contributions?|author contributions?|contributions?)\s*:?$",
    "acknowledgements": r"(?i)^(acknowledg(e)?ments?)\s*:?$",
    "funding": r"(?i)^(funding|funding information|financial support)\s*:?$",
    "data_availability": r"(?i)^(availability of data and materials|data availability|data sharing statement)\s*:?$",
    "ethics": r"(?i)^(ethics approval|ethical approval|ethics statement|consent for publication)\s*:?$",
    "references": r"(?i)^(references|bibliography)\s*:?$",
}
CONTENT = r"(?i)^(\d+(?:\.\d+)*[.)]?\s*)?(abstract|introduction|background|methods?|materials and methods|results?|discussion|limitations?|conclusions?|clinical implications|future work)\s*:?$"
SENTENCES = {
    "no_competing_interests": r"(?i)\bthe authors? declare(?:s)? that (?:they|he|she) ha(?:ve|s) no (?:competing|conflicting) interests?\.?",
    "authors_approved": r"(?i)\ball authors? read and approved the final manuscript\.?",
    "authors_contributed": r"(?i)\ball authors? contributed to (?:the )?(?:study|manuscript)[^.]*\.",
}
ANCHOR = r"\{#[-\w:.]+\}"
TAG = r"</?[A-Za-z][^>]*>"
NUMBERING = r"^\s*\d+(\.\d+)*[.)]?\s*"


def bare_heading(line: Column) -> Column:
    """Without numbering, then without blanks and heading marks around it."""
    return F.regexp_replace(F.regexp_replace(line, NUMBERING, ""), r"\A[ #*_-]+|[ #*_-]+\z", "")


def _kind(bare: Column) -> Column:
    return F.coalesce(*[F.when(bare.rlike(p), F.lit(k)) for k, p in BOILERPLATE.items()])


def heading_key(line: Column) -> Column:
    """The boilerplate section that a line is the heading of, if any."""
    return T.let(bare_heading(line), lambda b: F.when((b != "") & (F.length(b) <= 100), _kind(b)))


def is_content(line: Column) -> Column:
    return T.strip(line).rlike(CONTENT)


def remove_sentences(c: Column) -> tuple[Column, dict[str, Column]]:
    """The text without them, and how many went, one kind after the other."""
    counts = {}
    for k, p in SENTENCES.items():
        counts[k] = F.regexp_count(c, F.lit(p))
        c = F.regexp_replace(c, p, "")
    return c, counts


def strip_markup(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, ANCHOR, ""), TAG, " ")


def contamination(c: Column) -> Column:
    """Map of markers to counts, those of zero left out."""
    lines = T.splitlines(c)
    heads = F.transform(lines, bare_heading)

    def matching(h: Column, pattern: str) -> Column:
        return F.size(F.filter(h, lambda x: x.rlike(pattern)))

    def of(h: Column) -> Column:
        pairs = [(f"heading:{k}", matching(h, p)) for k, p in BOILERPLATE.items()]
        pairs += [(f"inline:{k}", F.regexp_count(T.filled(c), F.lit(p))) for k, p in SENTENCES.items()]
        pairs += [("markup:section_anchor", F.regexp_count(T.filled(c), F.lit(ANCHOR))), ("markup:html_tag", F.regexp_count(T.filled(c), F.lit(TAG)))]
        return F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v.cast("long") for _, v in pairs])), lambda _, v: v > 0)

    return T.let(heads, of)


def _sections(lines: Column) -> Column:
    """Of each line the section it is removed with, null if it stays: a fold over the lines, no shuffle.

    A boilerplate heading starts skipping and goes; while skipping, lines go until a content heading, which stays.
    """
    kinds = F.transform(lines, lambda x: F.coalesce(heading_key(x), F.when(is_content(x), F.lit("")), F.lit("-")))

    def at(k: Column) -> Column:
        # the last line up to each one that starts or ends skipping; an array's last non-"-" by a running index
        marks = F.filter(F.transform(k, lambda x, i: F.when(x != "-", i)), lambda i: i.isNotNull())

        def spread(m: Column) -> Column:
            first = F.array_repeat(F.lit("").cast("string"), F.coalesce(F.get(m, F.lit(0)), F.size(k)))
            rest = F.flatten(F.transform(m, lambda i, j: F.array_repeat(F.get(k, i), F.coalesce(F.get(m, j + 1), F.size(k)) - i)))
            return F.transform(F.concat(first, rest), lambda x: F.nullif(x, F.lit("")))

        return T.let(marks, spread)

    return T.let(kinds, at)


def clean(c: Column) -> Column:
    """Struct of text, original_chars, cleaned_chars, removed_chars, sections (map), sentences (map), anchors, tags."""
    base = T.unix_newlines(c)

    def of(x: Column) -> Column:
        ls, sec = x["lines"], x["sections"]
        kept = F.array_join(F.transform(F.filter(F.arrays_zip(ls.alias("l"), sec.alias("s")), lambda z: z["s"].isNull()), lambda z: z["l"]), "\n")
        gone = F.filter(sec, lambda s: s.isNotNull())
        body = T.let(kept, _tail)
        return F.struct(body.alias("b"), gone.alias("gone"))

    def _tail(k: Column) -> Column:
        anchors, t = F.regexp_count(k, F.lit(ANCHOR)), F.regexp_replace(k, ANCHOR, "")
        tags, t = F.regexp_count(t, F.lit(TAG)), F.regexp_replace(t, TAG, " ")
        t, counts = remove_sentences(t)
        return F.struct(
            T.tidy_lines(t, r"[ \t]{2,}").alias("text"), anchors.cast("long").alias("anchors"), tags.cast("long").alias("tags"),
            F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in counts]), F.array(*[v.cast("long") for v in counts.values()])), lambda _, v: v > 0).alias("sentences"),
        )

    lines = T.let(T.splitlines(base), lambda ls: F.struct(ls.alias("lines"), _sections(ls).alias("sections")))
    done = T.let(T.let(lines, of), lambda d: F.struct(d["b"].alias("b"), T.let(d["gone"], lambda g: F.map_from_entries(F.transform(F.array_distinct(g), lambda s: F.struct(s, F.size(F.filter(g, lambda y: y == s)).cast("long"))))).alias("sections")))
    return T.let(done, lambda d: F.struct(
        d["b"]["text"].alias("text"),
        F.length(base).alias("original_chars"), F.length(d["b"]["text"]).alias("cleaned_chars"),
        F.greatest(F.lit(0), F.length(base) - F.length(d["b"]["text"])).alias("removed_chars"),
        d["sections"].alias("sections"), d["b"]["sentences"].alias("sentences"), d["b"]["anchors"].alias("anchors"), d["b"]["tags"].alias("tags"),
    ))
