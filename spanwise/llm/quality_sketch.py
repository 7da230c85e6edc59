"""Quality rules whose thresholds adapt to each language and source.

Every rule compares one statistic of a text with a fence around the middle of its group: the quartiles
come from mergeable quantile sketches (KLL) per (language, source), which are merged again into one
sketch per language and one for the whole table. A group with few documents borrows: its fences are
the weighted mean of its own and its parent's, with the number of documents as weight, so that a
handful of junk documents cannot set their own standard. Fences join back on (language, source).

Defined results: a null text has no words, a text with fewer than 50 words fails the base rules; null
languages and sources are groups of their own; repeated rows are judged each and counted each; null
doc_ids pass through; empty input gives no rows; columns other than the four used are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.llm.textstats import with_counts
from spanwise.session import keep

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: A group of this many documents trusts its own quartiles as much as its parent's.
BORROW = 30


@dataclass(frozen=True)
class Rule:
    """A statistic, its fences in quartile distances below and above, and the least distance that counts."""

    name: str
    value: str
    below: float | None
    above: float | None
    least: float


RULES = (
    Rule("word_length", "word_chars / greatest(n_words, 1)", 5.0, 5.0, 0.35),
    Rule("symbol_share", "n_symbols / greatest(word_chars, 1)", None, 5.0, 0.01),
    Rule("mark_share", "n_marks / greatest(word_chars, 1)", None, 6.0, 0.02),
    Rule("upper_share", "n_upper / greatest(n_upper + n_lower, 1)", None, 6.0, 0.05),
    Rule("repeat_share", "n_repeat_words / greatest(n_words, 1)", None, 6.0, 0.06),
    Rule("same_next_share", "n_same_next / greatest(n_words, 1)", None, 6.0, 0.06),
    Rule("dup_line_share", "n_dup_lines / greatest(n_lines, 1)", None, 6.0, 0.06),
)


def statistics(docs: DataFrame) -> DataFrame:
    """Base counts, group columns and one double per rule, for every document."""
    counted = with_counts(docs, ("doc_id", "lang", "source"))
    return counted.select("doc_id", "lang", "source", *BASE, *[F.expr(f"cast({r.value} as double)").alias(r.name) for r in RULES])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def fences(stats: DataFrame, rules: tuple[Rule, ...] = RULES, borrow: float = BORROW) -> DataFrame:
    """lang, source, n and for each rule its low and high fence (null where a side is open).

    Documents that fail the base rules do not shape the quartiles. The join keys are (has value, value)
    pairs, so that null groups join like any other.
    """
    sketches = (
        stats.where(~base_failed()).groupBy("lang", "source")
        .agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(r.name).alias(r.name) for r in rules])
    )
    names = [r.name for r in rules]

    def quartiles(frame: DataFrame, mark: str) -> list[Column]:
        return [F.kll_sketch_get_quantile_double(c, F.lit(q)).alias(f"{mark}_{c}_{k}") for c in names for k, q in (("q1", 0.25), ("q3", 0.75))]

    def merged(*keys: str) -> DataFrame:
        return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(c).alias(c) for c in names])

    own = sketches.select("lang", "source", F.col("n").alias("g_n"), *quartiles(sketches, "g"))
    by_lang = merged("lang").select(F.col("lang").alias("l_lang"), F.col("n").alias("l_n"), *quartiles(sketches, "l"))
    overall = merged().select(*quartiles(sketches, "t"))
    groups = stats.groupBy("lang", "source").agg(F.count("*").alias("n"))
    mine = own.toDF("o_lang", "o_source", *own.columns[2:])
    joined = (
        groups.join(mine, F.col("lang").eqNullSafe(F.col("o_lang")) & F.col("source").eqNullSafe(F.col("o_source")), "left")
        .join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left").crossJoin(F.broadcast(overall))
    )

    def level(c: str, k: str) -> Column:
        top = F.col(f"t_{c}_{k}")
        lang_n, own_n = F.coalesce("l_n", F.lit(0)), F.coalesce("g_n", F.lit(0))
        mid = (F.coalesce(f"l_{c}_{k}", top) * lang_n + top * borrow) / (lang_n + borrow)
        return (F.coalesce(f"g_{c}_{k}", mid) * own_n + mid * borrow) / (own_n + borrow)

    out = []
    for r in rules:
        q1, q3 = level(r.name, "q1"), level(r.name, "q3")
        width = F.greatest(q3 - q1, F.lit(r.least))
        out.append((q1 - r.below * width if r.below is not None else F.lit(None).cast("double")).alias(f"{r.name}_low"))
        out.append((q3 + r.above * width if r.above is not None else F.lit(None).cast("double")).alias(f"{r.name}_high"))
    return joined.select("lang", "source", "n", *out)


def judged(stats: DataFrame, limits: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every document with its base counts, base_failed, kept and the names of the rules it breaks."""
    limits = limits.drop("n").withColumnRenamed("lang", "f_lang").withColumnRenamed("source", "f_source")
    both = stats.join(limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    broken = F.array_compact(F.array(*[
        F.when((F.col(r.name) < F.col(f"{r.name}_low")) | (F.col(r.name) > F.col(f"{r.name}_high")), F.lit(r.name)) if r.below is not None
        else F.when(F.col(r.name) > F.col(f"{r.name}_high"), F.lit(r.name))
        for r in rules
    ]))
    out = both.select("doc_id", *BASE, base_failed().alias("base_failed"), broken.alias("broken"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the five base counts, base_failed, kept, broken; the statistics are written once and read twice."""
    stats = keep(statistics(docs), "quality-statistics")
    return judged(stats, fences(stats)).select("doc_id", *BASE, "base_failed", "kept", "broken")
