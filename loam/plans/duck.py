"""Pieces of the SQL that queries are held against."""

from __future__ import annotations

from loam.config import Lexicon, Limit
from loam.operators import cleaning

WS = r"[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]"
INNER = r"[\t\x{1f}\p{Z}]"
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_''-]*[\p{L}\p{N}_])?"
BREAK = r"\r\n|[\n\r\x0b\x0c\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
NL = "chr(10)"


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "''") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {to}, 'g')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(pattern)}))::BIGINT"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def tidy(x: str, runs: str) -> str:
    t = f"regexp_replace({x}, '{runs}', ' ', 'g')"
    t = f"regexp_replace({t}, '(?m)^{INNER}+|{INNER}+$', '', 'g')"
    return strip(f"regexp_replace({t}, '\\n{{3,}}', {NL} || {NL}, 'g')")


def norm(x: str) -> str:
    return tidy(f"regexp_replace(replace(coalesce({x}, ''), chr(0), ' '), '{BREAK}', {NL}, 'g')", "[ \\t]+")


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORD}')"


#: doc_id, source, lang, t (the normalised text)
NORM = f"n AS (SELECT doc_id, source, lang, {norm('text')} AS t FROM documents)"


def metrics(src: str = "n", extra: str = "") -> str:
    """CTEs w, m over ``src`` (doc_id, t): m has the metrics."""
    line = strip("x")
    return f"""w AS (SELECT *, {words('t')} AS w, list_filter(list_transform(string_split(t, {NL}), lambda x: lower({line})), lambda x: x <> '') AS ls FROM {src}),
m AS (SELECT * EXCLUDE (w, ls), len(w)::BIGINT AS words, length(t)::BIGINT AS chars,
  len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) / greatest(1, len(w)) AS alpha_word_fraction,
  length(regexp_replace(t, '[\\p{{L}}\\p{{N}}\\s\\x0b\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]', '', 'g')) / greatest(1, len(w)) AS symbol_to_word_ratio,
  coalesce(list_median(list_transform(w, lambda x: length(x))), 0.0)::DOUBLE AS median_word_length,
  CASE WHEN len(ls) = 0 THEN 1.0 ELSE len(list_filter(ls, lambda x: len(list_filter(ls, lambda y: y = x)) > 1)) / len(ls) END::DOUBLE AS duplicate_line_fraction{extra} FROM w)"""


def reasons(limits: tuple[Limit, ...]) -> str:
    """A list over m's columns."""
    cases = [f"CASE WHEN {measure} {side} {bound} THEN '{reason}' END" for reason, measure, side, bound, _ in limits]
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


def category(x: str, lex: Lexicon) -> str:
    def has(terms: tuple[str, ...]) -> str:
        return "(" + " OR ".join(f"contains(lower({x}), {lit(t)})" for t in terms) + ")"

    return f"CASE WHEN NOT {has(lex.base)} THEN NULL " + " ".join(f"WHEN {has(t)} THEN '{k}'" for k, t in lex.categories) + f" ELSE '{lex.default}' END"


def split(key: str, seed: int = 42) -> str:
    u = f"(('0x' || substr(sha256('{seed}:' || {key}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"
    return f"CASE WHEN {u} < 0.9 THEN 'train' WHEN {u} < {0.9 + 0.05!r} THEN 'val' ELSE 'test' END"


def bare(x: str) -> str:
    return sub(sub(x, cleaning.NUMBERING), r"\A[ #*_-]+|[ #*_-]+\z")


def heading(x: str) -> str:
    kinds = " ".join(f"WHEN regexp_matches({bare(x)}, {lit(p)}) THEN '{k}'" for k, p in cleaning.BOILERPLATE.items())
    return f"CASE WHEN {bare(x)} = '' OR length({bare(x)}) > 100 THEN NULL {kinds} END"


#: Texts with boilerplate, made alike in both engines.
DERIVED = """CASE doc_id % 7
 WHEN 0 THEN text || chr(10) || '2.1 Funding:' || chr(10) || 'Paid by nobody.' || chr(10) || chr(10) || 'Conclusions' || chr(10) || 'All is well.'
 WHEN 1 THEN 'Results {#sec1-2}' || chr(10) || text || chr(10) || '## References' || chr(10) || '[1] A book.'
 WHEN 2 THEN replace(text, chr(10), chr(13) || chr(10)) || '  The authors declare that they have no competing interests. All authors read and approved the final manuscript.'
 WHEN 3 THEN '<b>' || text || '</b><br/>' || chr(10) || 'All authors contributed to the study design.' || chr(10) || 'Acknowledgements' || chr(10) || 'Thanks.' || chr(10) || 'Methods' || chr(10) || 'We did.'
 WHEN 4 THEN 'Competing Interests' || chr(10) || 'None.' || chr(10) || chr(10) || chr(10) || chr(10) || text
 ELSE text END"""

_S = [("no_competing_interests", 0), ("authors_approved", 1), ("authors_contributed", 2)]


def cleaned() -> str:
    """CTEs up to c: doc_id, source, original, text, removed, anchors, tags, s0 to s2; and s: doc_id, pos, line, sec of each line."""
    a = cleaning
    p = list(a.SENTENCES.values())
    return f"""d0 AS (SELECT doc_id, source, lang, regexp_replace({DERIVED}, '\\r\\n?', {NL}, 'g') AS base FROM documents),
ln AS (SELECT doc_id, unnest(string_split(base, {NL})) AS line, generate_subscripts(string_split(base, {NL}), 1) AS pos FROM d0),
ev AS (SELECT *, coalesce({heading('line')}, CASE WHEN regexp_matches({strip('line')}, {lit(a.CONTENT)}) THEN '' END) AS ev FROM ln),
s AS (SELECT doc_id, pos, line, nullif(last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), '') AS sec FROM ev),
k AS (SELECT doc_id, coalesce(string_agg(line, {NL} ORDER BY pos) FILTER (sec IS NULL), '') AS k FROM s GROUP BY doc_id),
k1 AS (SELECT doc_id, {count('k', a.ANCHOR)} AS anchors, {sub('k', a.ANCHOR)} AS k FROM k),
k2 AS (SELECT doc_id, anchors, {count('k', a.TAG)} AS tags, {sub('k', a.TAG, "' '")} AS k FROM k1),
k3 AS (SELECT doc_id, anchors, tags, {count('k', p[0])} AS s0, {sub('k', p[0])} AS k FROM k2),
k4 AS (SELECT doc_id, anchors, tags, s0, {count('k', p[1])} AS s1, {sub('k', p[1])} AS k FROM k3),
k5 AS (SELECT doc_id, anchors, tags, s0, s1, {count('k', p[2])} AS s2, {sub('k', p[2])} AS k FROM k4),
c AS (SELECT doc_id, source, lang, length(base)::BIGINT AS original, {tidy('k', '[ \\t]{2,}')} AS text, anchors, tags, s0, s1, s2,
  greatest(0, length(base) - length({tidy('k', '[ \\t]{2,}')}))::BIGINT AS removed FROM d0 JOIN k5 USING (doc_id))"""
