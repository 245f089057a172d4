"""Text functions, Column to Column: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: character classes that equal the usual notions of white space, letters and words over Unicode
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# those that aren't \n already, so that most texts have nothing to replace
OTHER_BREAK = r"\r\n?|[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
INNER_SPACE = r"[\t\x{1f}\p{Z}]"
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"
NOT_SYMBOL = r"[\p{L}\p{N}\s\x{1c}-\x{1f}\x{85}\p{Z}]"
# no NUL and no white space but blanks and \n; by ranges, most frequent first, as those are looked up several times as fast as classes
PLAIN = r"\A[ -\x{84}\n\x{86}-\x{9f}\x{a1}-\x{167f}\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}\x{2030}-\x{205e}\x{2060}-\x{2fff}\x{3001}-\x{10ffff}]*+\z"


def let(value: Column, body) -> Column:
    """``body`` of a value computed once a row, however often it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def filled(c: Column, default: str = "") -> Column:
    return F.coalesce(c, F.lit(default))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def unix_newlines(c: Column) -> Column:
    return F.regexp_replace(filled(c), r"\r\n?", "\n")


def _trim(c: Column) -> Column:
    """Of most texts, by one search: white space is plain, and none is at the ends of lines."""
    blank = F.contains(c, F.lit(" \n")) | F.contains(c, F.lit("\n ")) | F.startswith(c, F.lit(" ")) | F.endswith(c, F.lit(" "))
    return ~blank & c.rlike(PLAIN)


def splitlines(c: Column) -> Column:
    """Lines without their ends; a break at the end of the text starts no further line."""
    t = F.regexp_replace(filled(c), OTHER_BREAK, "\n")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, r"\n\z", ""), "\n", -1))


def tidy_lines(c: Column, runs: str) -> Column:
    """Runs of blanks become a space, lines are stripped, and at most one line in a row is empty."""
    t = F.regexp_replace(c, runs, " ")
    t = F.regexp_replace(t, rf"(?m)^{INNER_SPACE}+|{INNER_SPACE}+$", "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def normalise_text(c: Column) -> Column:
    t = F.translate(filled(c), "\x00", " ")
    # single spaces between words are left alone
    tidied = tidy_lines(F.regexp_replace(t, OTHER_BREAK, "\n"), r"\t[ \t]*| [ \t]+")
    more = F.contains(c, F.lit("  ")) | F.contains(c, F.lit("\n\n\n")) | F.startswith(c, F.lit("\n")) | F.endswith(c, F.lit("\n"))
    return F.when(~more & _trim(c), c).otherwise(tidied)  # texts that are normal already are left as they are


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(filled(c), F.lit(WORD), F.lit(0))


def median(sorted_: Column) -> Column:
    """Of a sorted array; the mean of the middle two, 0 if there is none."""
    n = F.size(sorted_)
    at = lambda i: F.get(sorted_, i.cast("int")).cast("double")
    return F.when(n == 0, F.lit(0.0)).otherwise((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def duplicate_lines(c: Column) -> Column:
    """(duplicated, lines): of the lines that aren't blank, stripped and lower-cased, those that occur more than once."""
    # white space around a break goes with it, and so do blank lines, for all lines at once
    t = F.regexp_replace(F.regexp_replace(filled(c), OTHER_BREAK, "\n"), rf"{SPACE}*\n{SPACE}*", "\n")
    trimmed = F.when(_trim(filled(c)), filled(c)).otherwise(strip(t))
    lines = F.filter(F.split(F.lower(trimmed), "\n", -1), lambda x: x != "")

    def count(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (F.get(s, i - 1) == x) | (F.get(s, i + 1) == x))
        return F.struct(F.size(twice).alias("duplicated"), F.size(s).alias("lines"))

    return let(F.sort_array(lines), count)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def portable_hash(c: Column) -> Column:
    """60 bits of MD5 as a long, which SQL engines agree on."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def shingles(words: Column, n: int) -> Column:
    """Distinct hashes of lower-cased word n-grams; fewer words make one, none none."""

    def of(w: Column) -> Column:
        k = F.size(w)
        grams = F.transform(F.sequence(F.lit(0), F.greatest(k - n, F.lit(0))), lambda i: portable_hash(F.array_join(F.slice(w, i + 1, n), " ")))
        return F.when(k == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(grams))

    return let(F.transform(words, F.lower), of)


def stable_rank(seed: int, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)


def unit_hash(seed: int, key: Column) -> Column:
    """The first 8 bytes of a SHA-256 as a fraction of 2^64."""
    head = F.conv(F.substring(stable_rank(seed, key), 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return head / F.lit(18446744073709551616.0)


def snippet(c: Column, n: int = 500) -> Column:
    return F.translate(F.substring(c, 1, n), "\n", " ")


def fingerprint(instruction: Column, context: Column, response: Column) -> Column:
    return F.sha2(F.concat_ws("\n", strip(instruction), strip(context), strip(response)), 256)


def format_prompt(instruction: Column, context: Column) -> Column:
    middle = F.when(context != "", F.concat(F.lit("### Context:\n"), context, F.lit("\n\n"))).otherwise(F.lit(""))
    return F.concat(F.lit("### Instruction:\n"), instruction, F.lit("\n\n"), middle, F.lit("### Response:\n"))
