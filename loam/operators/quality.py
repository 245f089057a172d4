"""Quality metrics of a text and the reasons to reject it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.config import Limit
from loam.functions import text as T


def metrics(c: Column, said: bool = False) -> Column:
    """Struct of words, chars, alpha_word_fraction, symbol_to_word_ratio, median_word_length, duplicate_line_fraction; and, if asked for, said: the words joined by spaces."""

    def of(w: Column, c: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        alpha = F.size(F.filter(w, lambda x: x.rlike(r"\p{L}")))
        symbols = F.length(F.regexp_replace(T.filled(c), f"{T.NOT_SYMBOL}+", ""))
        lines = T.duplicate_lines(c)
        return F.struct(
            F.size(w).alias("words"),
            F.length(T.filled(c)).alias("chars"),
            (alpha / n).alias("alpha_word_fraction"),
            (symbols / n).alias("symbol_to_word_ratio"),
            T.let(F.sort_array(F.transform(w, F.length)), T.median).alias("median_word_length"),
            T.let(lines, lambda x: F.when(x["lines"] == 0, F.lit(1.0)).otherwise(x["duplicated"] / x["lines"])).alias("duplicate_line_fraction"),
            *([F.array_join(w, " ").alias("said")] if said else []),
        )

    return T.let(T.filled(c), lambda t: T.let(T.word_tokens(t), lambda w: of(w, t)))


def reasons(m: Column, limits: tuple[Limit, ...]) -> Column:
    """The reasons of all limits that are broken, in their order; being on a limit is fine."""

    def broken(x: Column) -> Column:
        beyond = {"<": lambda v, bound: v < bound, ">": lambda v, bound: v > bound}
        return F.array_compact(F.array(*[F.when(beyond[side](x[measure], bound), F.lit(reason)) for reason, measure, side, bound, _ in limits]))

    return T.let(m, broken)


def with_missing_id(found: Column, *ids: Column) -> Column:
    """``found`` and a reason for rows of which no identifier is set."""
    given = F.coalesce(*[F.nullif(T.strip(T.filled(i)), F.lit("")) for i in ids])
    return F.when(given.isNull(), F.array_append(found, "missing_identifier")).otherwise(found)


def first_accepted(docs: DataFrame, n: int, accept: Callable[[DataFrame], DataFrame], step: int | None = None) -> DataFrame:
    """The first ``n`` rows by ``ord`` of those that ``accept`` returns of ``docs``, reading no more of it than that takes.

    Ranges of ord are judged in order, each twice as wide as the one before, until there are enough; their bounds are pushed down to the files. Rows
    without an ord have no place in the order and aren't taken.
    """
    from loam.operators.dedup import settled

    low, high = docs.agg(F.min("ord"), F.max("ord")).first()
    out, found, width = accept(docs.limit(0)), 0, step or 4 * n
    while low is not None and low <= high and found < n:
        part = settled(accept(docs.filter(F.col("ord").between(low, low + width - 1))))
        found += part.count()
        out = out.unionByName(part)
        low, width = low + width, 2 * width
    return out.orderBy("ord").limit(n)
