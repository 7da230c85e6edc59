"""Rule packs, boundary rules and bindings: checked before use, refused if ambiguous or unsourced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.versions import OPERATORS

_SHOWN = 20


def _blank(name: str) -> Column:
    return F.coalesce(F.trim(name) == "", F.lit(True))


def _problems(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """One row per failed check, and one per key that is claimed more than once."""
    failed = F.array_compact(F.array(*[F.when(bad, problem) for problem, bad in checks.items()]))
    single = rows.select(key, F.explode(failed).alias("problem"))
    repeated = (
        rows.filter(~_blank(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select(key, F.lit("duplicate").alias("problem"))
    )
    return single.unionByName(repeated)


def _refuse(problems: DataFrame, what: str) -> None:
    shown = problems.take(_SHOWN)
    if shown:
        raise ValueError(f"{what} rejected: " + "; ".join(f"{r[0]}: {r[1]}" for r in shown))


def rule_problems(rules: DataFrame) -> DataFrame:
    """``rules``: rule_id, source_url, recorded_at, when_kind, when_name, require_kind, require_name."""
    return _problems(
        rules,
        "rule_id",
        {
            "missing id": _blank("rule_id"),
            "source url missing": ~F.coalesce(F.col("source_url").rlike("^https?://"), F.lit(False)),
            "source date missing": _blank("recorded_at"),
            "no target to apply to": ~F.coalesce(F.col("when_kind").isin("package", "fact"), F.lit(False)) | _blank("when_name"),
            "no requirement": ~F.coalesce(F.col("require_kind").isin("package", "fact", "absent"), F.lit(False))
            | _blank("require_name"),
        },
    )


def resolve_sources(rules: DataFrame, sources: DataFrame) -> DataFrame:
    """Replace each rule's source key (pack, source_key) by the pack's source record."""
    return rules.join(sources.select("pack", "source_key", "source_url", "recorded_at"), ["pack", "source_key"], "left")


def load_rules(rules: DataFrame) -> DataFrame:
    _refuse(rule_problems(rules), "rule")
    return rules


def fact_declaration_problems(declarations: DataFrame) -> DataFrame:
    """``declarations``: name, file, key. The same name must always mean the same place."""
    return (
        declarations.groupBy("name")
        .agg(F.countDistinct("file", "key").alias("places"))
        .filter("places > 1")
        .select("name", F.lit("declared differently").alias("problem"))
    )


def boundary_rule_problems(rules: DataFrame) -> DataFrame:
    """Boundary rules, one row per version condition (see ``drift.boundary_findings``), with sources."""
    c = F.col
    per_rule = rules.groupBy("rule_id").agg(
        F.first("from_package").alias("from_package"), F.first("to_package").alias("to_package"), F.first("claim").alias("claim"),
        F.count_distinct("from_package", "to_package", "claim", "source_url", "section", "recorded_ms", "review_by_ms").alias("texts"),
        F.min((c("from_op").isin(*OPERATORS) & c("from_value").isNotNull()).cast("int")).alias("from_ok"),
        F.min((c("op").isin(*OPERATORS) & c("value").isNotNull()).cast("int")).alias("op_ok"),
        *[F.first(k).alias(k) for k in ("source_url", "section", "recorded_ms", "review_by_ms")],
    )
    bad = {
        "missing id": _blank("rule_id"),
        "package or claim missing": _blank("from_package") | _blank("to_package") | _blank("claim"),
        "condition outside the vocabulary": F.coalesce(c("from_ok"), F.lit(0)) + F.coalesce(c("op_ok"), F.lit(0)) < 2,
        "source url must be https": ~F.coalesce(c("source_url").rlike("^https://"), F.lit(False)),
        "source section missing": _blank("section"),
        "review dates missing or reversed": ~F.coalesce(c("review_by_ms") >= c("recorded_ms"), F.lit(False)),
        "duplicate": c("texts") > 1,
    }
    failed = F.array_compact(F.array(*[F.when(test, problem) for problem, test in bad.items()]))
    return per_rule.select("rule_id", F.explode(failed).alias("problem"))


def load_boundary_rules(rules: DataFrame) -> DataFrame:
    _refuse(boundary_rule_problems(rules), "boundary rule")
    return rules


def binding_problems(bindings: DataFrame) -> DataFrame:
    return _problems(
        bindings,
        "service",
        {
            "service missing": _blank("service"),
            "manifest path missing": _blank("manifest_path"),
            "not attributable": _blank("declared_by"),
        },
    )


def load_bindings(bindings: DataFrame) -> DataFrame:
    _refuse(binding_problems(bindings), "binding")
    return bindings
