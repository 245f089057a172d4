"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger row keeps the measurements and one failure bit per rule. A
policy is a versioned mask over the bits, so changing a policy, or asking what a rule costs, never touches a text
again: both are bitwise operations on the ledger, and ablations aggregate it by its (at most 2^rules) bit patterns.

Everything is a projection of built-in functions: no shuffle, no Python on the executors.

Edge cases: a null text counts as empty (no words, fails ``too_short``); repeated rows and ids each get their own
ledger row; an empty table gives an empty ledger; other columns of the input, whatever their names, are not read.
Three-word windows are compared by XXH64 over the three words, chained, within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import boxed, let, words


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the measurements

    @property
    def value(self) -> int:
        return 1 << self.bit


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]


RULES = (
    Rule(0, "too_short", "n_words < 50"),
    Rule(1, "repeats", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    Rule(5, "shouting", "2 * n_bangs > n_words"),
)
BASE = Policy("base-1", ("too_short", "repeats"))
FULL = Policy("full-1", tuple(r.name for r in RULES))
POLICIES = (BASE, FULL)


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    known = {r.name: r.value for r in rules}
    return sum(known[n] for n in dict.fromkeys(policy.rules))


def _repeat_words(w: Column) -> Column:
    """Words in three-word windows that the text holds twice or more."""
    n = F.size(w)
    grams = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")),
        ),
    ).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))

    def repeated(s: Column) -> Column:
        # equal windows are neighbours now
        at = F.transform(
            s, lambda a, i: F.when((F.get(s, i + 1)["h"] == a["h"]) | (F.get(s, i - 1)["h"] == a["h"]), a["p"])
        )
        return F.sort_array(F.filter(at, lambda p: p.isNotNull()))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    return let(let(F.sort_array(grams), repeated), covered)


def measure(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The measurements, all long."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = let(
        words(t),
        lambda w: F.struct(
            F.size(w).alias("n_words"),
            F.length(F.array_join(w, "")).alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    ruled = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), F.size(F.array_distinct(x)).alias("n_kinds")))
    got = df.select(
        F.col(id_col),
        found.alias("_w"),
        ruled.alias("_l"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).alias("_s"),
        F.regexp_count(t, F.lit("!")).alias("_b"),
    )
    return got.select(
        id_col,
        F.col("_w.n_words").cast("long").alias("n_words"),
        F.col("_w.word_chars").cast("long").alias("word_chars"),
        F.col("_s").cast("long").alias("n_symbols"),
        (F.col("_l.n_lines") - F.col("_l.n_kinds")).cast("long").alias("n_dup_lines"),
        F.col("_w.n_repeat_words").cast("long").alias("n_repeat_words"),
        F.col("_l.n_lines").cast("long").alias("n_lines"),
        F.col("_b").cast("long").alias("n_bangs"),
    )


def ledger(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The measurements and ``fail_bits`` (long), bit ``r.bit`` set where rule r fails."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(r.value)).otherwise(F.lit(0)).cast("long"))
    return measure(df, text, id_col).withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES, out: str = "kept") -> DataFrame:
    return led.withColumn(out, F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules))) == 0)


def accepted(docs: DataFrame, policy: Policy = FULL, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the policy keeps; one projection and a filter."""
    held = boxed(docs, text=F.col("text"))
    return apply_policy(ledger(held, rules, id_col="_doc"), policy, rules).filter("kept").select("_doc.*")


def ablations(led: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy and rule: documents and words that fail it, that fail it alone, and that the policy keeps with and
    without it. The ledger is first summed by bit pattern, so what is crossed with the policies has at most 2^rules rows.
    """
    patterns = led.groupBy("fail_bits").agg(F.count("*").alias("docs"), F.sum("n_words").alias("words"))
    pairs = [(p.version, r.name, mask(p, rules), r.value) for p in policies for r in rules if r.name in p.rules]
    grid = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(q, ("policy", "rule", "mask", "bit"), strict=True)]) for q in pairs])
    x = patterns.select("fail_bits", "docs", "words", F.explode(grid).alias("q")).select("*", "q.*").drop("q")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    fails = hit.bitwiseAND(F.col("bit")) != 0
    return x.groupBy("policy", "rule").agg(
        F.sum(F.when(fails, F.col("docs")).otherwise(0)).alias("failed"),
        F.sum(F.when(hit == F.col("bit"), F.col("docs")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(hit == F.col("bit"), F.col("words")).otherwise(0)).alias("words_alone"),
        F.sum(F.when(hit == 0, F.col("docs")).otherwise(0)).alias("kept"),
        F.sum(F.when((hit == 0) | (hit == F.col("bit")), F.col("docs")).otherwise(0)).alias("kept_without"),
    )


def op1_quality_rules(df: DataFrame) -> DataFrame:
    led = apply_policy(apply_policy(ledger(df), BASE, out="_base"), FULL)
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs",
        "fail_bits", (~F.col("_base")).alias("base_failed"), "kept", F.lit(FULL.version).alias("policy"),
    )


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS g FROM w, unnest(generate_series(1, len(w) - 2)) AS s(i)),
rep AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS c FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS dup
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
  coalesce(c, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
  len(regexp_extract_all(text, '!'))::BIGINT AS n_bangs FROM w LEFT JOIN cov USING (r) LEFT JOIN ln USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN 16 ELSE 0 END
  + CASE WHEN 2 * n_bangs > n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, 'full-1' AS policy FROM b
"""
