"""Component inventories and advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.operators.ordered import newest_per_key

_AUDIT = "struct<vulnerabilities:map<string,struct<severity:string,via:array<string>>>>"
_VIA = (
    "struct<source:string,name:string,title:string,url:string,severity:string,cwe:array<string>,"
    "cvss:struct<score:double,vectorString:string>,range:string>"
)
_TREE = "map<string,struct<version:string,dependencies:string>>"


MAX_DEPTH = 1_000


def load_components(reports: DataFrame) -> DataFrame:
    """Components of the latest report of each service: a new report replaces the old one.

    ``reports``: service, name, version, ecosystem, reported_ms.
    """
    usable = reports.filter((F.length("service") > 0) & (F.length("name") > 0))
    latest = reports.filter(F.length("service") > 0).groupBy("service").agg(F.max("reported_ms").alias("reported_ms"))
    return usable.join(latest, ["service", "reported_ms"]).select(
        "service",
        F.col("name").alias("package"),
        F.nullif("version", F.lit("")).alias("version"),
        F.coalesce(F.nullif("ecosystem", F.lit("")), F.lit("npm")).alias("ecosystem"),
        "reported_ms",
    )


def components_from_npm_ls(trees: DataFrame, column: str = "tree", depth: int = MAX_DEPTH) -> DataFrame:
    """Flatten `npm ls --json` output with all nested dependencies, or down to ``depth`` (0: direct ones).

    Levels are opened until none is left, which is looked up when the plan is built.
    """
    kept = [c for c in trees.columns if c != column]
    level = trees.select(*kept, F.from_json(column, "struct<dependencies:string>")["dependencies"].alias("deps"))
    found = None
    for _ in range(depth + 1):
        opened = level.select(*kept, F.explode(F.from_json("deps", _TREE)).alias("name", "info"))
        part = opened.filter(F.col("info").isNotNull()).select(
            *kept, "name", F.col("info.version").alias("version"), F.lit("npm").alias("ecosystem")
        )
        found = part if found is None else found.unionByName(part)
        level = opened.select(*kept, F.col("info.dependencies").alias("deps")).filter(F.col("deps").isNotNull())
        if level.isEmpty():
            break
    return found


def load_advisories(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); the last write per id wins.

    ``raw``: id, package, ecosystem, severity, title, url, cwe, cvss, vulnerable_range, seq.
    """
    complete = F.coalesce((F.length("id") > 0) & (F.length("package") > 0), F.lit(False))
    latest = newest_per_key(raw.filter(complete), ["id"], [F.desc("seq")], 1)
    accepted = latest.select(
        F.col("id").alias("advisory_id"),
        "package",
        F.coalesce(F.nullif("ecosystem", F.lit("")), F.lit("npm")).alias("ecosystem"),
        F.coalesce(F.nullif("severity", F.lit("")), F.lit("unknown")).alias("severity"),
        F.coalesce("title", F.lit("")).alias("title"),
        "url",
        F.coalesce("cwe", F.array().cast("array<string>")).alias("cwe"),
        "cvss",
        "vulnerable_range",
    )
    rejected = raw.filter(~complete).select(
        F.coalesce(F.nullif("id", F.lit("")), F.lit("(no id)")).alias("id"),
        F.lit("advisory requires id and package").alias("reason"),
    )
    return accepted, rejected


def advisories_from_npm_audit(reports: DataFrame, column: str = "report") -> DataFrame:
    """Advisory rows from `npm audit --json`; textual pointers to other packages are skipped.

    ``reports``: seq and the JSON text. The first record per id wins, in report order.
    """
    packages = reports.select("seq", F.from_json(column, _AUDIT)["vulnerabilities"].alias("v")).select(
        "seq", F.explode("v").alias("pkg", "entry")
    )
    vias = packages.select(
        "seq", "pkg", F.col("entry.severity").alias("own"), F.posexplode("entry.via").alias("at", "raw")
    ).filter(F.col("raw").startswith("{"))
    read = vias.withColumn("via", F.from_json("raw", _VIA)).filter(F.length("via.url") > 0)
    ghsa = F.nullif(F.regexp_extract("via.url", r"(?i)/advisories/(GHSA-[a-z0-9-]+)", 1), F.lit(""))
    rows = read.select(
        F.coalesce(ghsa, F.concat(F.lit("NPM-"), F.nullif("via.source", F.lit("")))).alias("id"),
        F.coalesce(F.nullif("via.name", F.lit("")), F.col("pkg")).alias("package"),
        F.lit("npm").alias("ecosystem"),
        F.coalesce(F.nullif("via.severity", F.lit("")), F.nullif("own", F.lit("")), F.lit("unknown")).alias("severity"),
        F.col("via.title").alias("title"),
        F.col("via.url").alias("url"),
        F.col("via.cwe").alias("cwe"),
        F.when(F.col("via.cvss.score").isNotNull(), F.col("via.cvss")).alias("cvss"),
        F.col("via.range").alias("vulnerable_range"),
        "seq", "pkg", "at",
    ).filter(F.col("id").isNotNull())
    order = [F.asc("seq"), F.asc("pkg"), F.asc("at")]
    return newest_per_key(rows, ["id"], order, 1).drop("pkg", "at")
