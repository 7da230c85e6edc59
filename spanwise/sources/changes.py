"""Change events from feeds and from git logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Separators of `git log --name-only` output, record first.
RECORD, FIELD = "\x1e", "\x1f"
LOG_FORMAT = RECORD + FIELD.join(["%H", "%aI", "%an", "%s"])


def epoch_ms(timestamp: Column) -> Column:
    """Milliseconds from an epoch number or an ISO text, else NULL."""
    text = F.trim(timestamp.cast("string"))
    number = F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), text.try_cast("double").cast("bigint"))
    iso = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), text.try_cast("timestamp"))
    return F.coalesce(number, F.unix_millis(iso))


def load_changes(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a change without a readable time cannot be correlated and is refused."""
    for name, kind in (("id", "string"), ("type", "string"), ("service", "string"), ("version", "string"),
                       ("commit", "string"), ("author", "string"), ("description", "string"),
                       ("files_changed", "array<string>")):
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast(kind))
    timed = raw.withColumn("change_ms", epoch_ms(F.col("timestamp")))

    def given(name: str) -> Column:
        return F.nullif(name, F.lit(""))

    accepted = timed.filter(F.col("change_ms").isNotNull()).select(
        F.coalesce(given("id"), F.concat(F.lit("CHG-"), F.col("change_ms").cast("string"))).alias("change_id"),
        "change_ms",
        F.coalesce(given("type"), F.lit("UNKNOWN")).alias("change_type"),
        *[given(n).alias(n) for n in ("service", "version", "commit", "author")],
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("files_changed", F.array().cast("array<string>")).alias("files_changed"),
    )
    rejected = timed.filter(F.col("change_ms").isNull()).select(
        F.coalesce(given("id"), F.lit("(no id)")).alias("id"), F.lit("missing or unparseable timestamp").alias("reason")
    )
    return accepted, rejected


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per commit record of saved log output."""
    return spark.read.option("lineSep", RECORD).text(path)


def changes_from_git_log(records: DataFrame, column: str = "value", service: str | None = None) -> DataFrame:
    """Commit records as raw changes for ``load_changes``; other columns pass through."""
    lines = F.split(F.trim(F.regexp_replace(column, r"^[\s]+|[\s]+$", "")), "\n")
    header = F.split(F.get(lines, F.lit(0)), FIELD)
    files = F.filter(
        F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(x)), lambda x: x != ""
    )
    rows = records.withColumns({"header": header, "files_changed": files})
    sha = F.get("header", F.lit(0))
    kept = [c for c in records.columns if c != column]
    return rows.filter(F.length(sha) > 0).select(
        *kept,
        F.concat(F.lit("CHG-GIT-"), F.left(sha, F.lit(12))).alias("id"),
        F.get("header", F.lit(1)).alias("timestamp"),
        F.lit("CODE_COMMIT").alias("type"),
        F.lit(service).cast("string").alias("service"),
        F.left(sha, F.lit(7)).alias("version"),
        sha.alias("commit"),
        F.get("header", F.lit(2)).alias("author"),
        F.get("header", F.lit(3)).alias("description"),
        "files_changed",
    )
