"""Dependency manifests and configuration files of many repositories.

``files``: repo, path, dir, basename, text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.functions.versions import coerce_declared_range

MANIFEST_FILES = (
    "package.json", "package-lock.json", "requirements.txt", "requirements-dev.txt", "pyproject.toml", "pom.xml",
)
IGNORED_DIRS = ("node_modules", "venv", ".venv", "site-packages", "__pycache__", ".tox", "target")

_PKG = "struct<version:string,dependencies:map<string,string>,devDependencies:map<string,string>>"
_LOCK = "struct<packages:map<string,struct<version:string>>,dependencies:map<string,struct<version:string>>>"
_REQUIREMENT = r"^([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*(===|==|>=|<=|~=|!=|>|<)?\s*([0-9][^\s;,]*)?"


def read_files(spark: SparkSession, root: str, names: Sequence[str] = MANIFEST_FILES) -> DataFrame:
    """Whole files below ``root``; the first directory level is the repository."""
    pattern = "{" + ",".join(names) + "}"
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    )
    below = F.regexp_extract("path", "^(?:file:)?/*" + root.strip("/") + "/(.*)$", 1)
    parts = F.split(below, "/")
    ignored = F.arrays_overlap(parts, F.array(*[F.lit(d) for d in IGNORED_DIRS]))
    return raw.filter(~ignored).select(
        F.get(parts, F.lit(0)).alias("repo"),
        below.alias("path"),
        F.regexp_replace(below, "/?[^/]*$", "").alias("dir"),
        F.element_at(parts, -1).alias("basename"),
        F.decode("content", "UTF-8").alias("text"),
    )


def _packages(df: DataFrame, ecosystem: str, version: Column, declared: Column, dev: Column, provenance: Column, note: Column):
    return df.select(
        "repo", "path", F.lit(ecosystem).alias("ecosystem"), "name", version.cast("string").alias("version"),
        declared.cast("string").alias("declared"), dev.alias("dev"), provenance.alias("provenance"), note.alias("note"),
    )


def npm_packages(files: DataFrame) -> DataFrame:
    """Declared dependencies, resolved by the sibling lock file where it lists them at top level."""
    manifests = files.filter(F.col("basename") == "package.json").withColumn("pkg", F.from_json("text", _PKG))

    def listed(field: str, dev: bool) -> Column:
        entries = F.transform(
            F.map_entries(F.col("pkg")[field]),
            lambda e: F.struct(e["key"].alias("name"), e["value"].alias("range"), F.lit(dev).alias("dev")),
        )
        return F.coalesce(entries, F.array().cast("array<struct<name:string,range:string,dev:boolean>>"))

    wanted = F.concat(listed("dependencies", False), listed("devDependencies", True))
    declared = manifests.select("repo", "dir", "path", F.explode(wanted).alias("d")).select("repo", "dir", "path", "d.*")
    locks = files.filter(F.col("basename") == "package-lock.json").select("repo", "dir", F.from_json("text", _LOCK).alias("lock"))

    def entries(field: str) -> Column:
        empty = F.array().cast("array<struct<key:string,value:struct<version:string>>>")
        return F.coalesce(F.map_entries(F.col("lock")[field]), empty)

    def with_version(e: Column) -> Column:
        return e["value"]["version"].isNotNull()

    prefix = "node_modules/"
    top = F.filter(
        entries("packages"),
        lambda e: e["key"].startswith(prefix) & ~F.substring(e["key"], len(prefix) + 1, 10_000).contains("/node_modules/") & with_version(e),
    )
    old = F.filter(entries("dependencies"), with_version)
    chosen = F.when(F.size(top) > 0, top).otherwise(old)
    resolved = locks.select("repo", "dir", F.explode(chosen).alias("e")).select(
        "repo", "dir", F.regexp_replace("e.key", "^" + prefix, "").alias("name"), F.col("e.value.version").alias("resolved")
    )
    rows = declared.join(resolved, ["repo", "dir", "name"], "left").withColumn("floor", coerce_declared_range(F.col("range")))
    hit = F.col("resolved").isNotNull()
    floor = F.col("floor.version")
    return _packages(
        rows, "npm",
        F.coalesce("resolved", floor),
        F.col("range"),
        F.col("dev"),
        F.when(hit, "OBSERVED").when(floor.isNotNull(), "INFERRED").otherwise("UNKNOWN"),
        F.when(hit, "resolved in package-lock.json").otherwise(F.coalesce("floor.reason", F.lit("declared exactly, not resolved"))),
    )


def _requirement_rows(lines: DataFrame) -> DataFrame:
    """``lines``: repo, path, line (one requirement each)."""
    clean = F.trim(F.get(F.split("line", "#"), F.lit(0)))
    parsed = lines.withColumn("clean", clean).filter((F.col("clean") != "") & ~F.col("clean").startswith("-"))
    parsed = parsed.filter(F.col("clean").rlike(_REQUIREMENT)).select(
        "repo",
        "path",
        "clean",
        F.regexp_extract("clean", _REQUIREMENT, 1).alias("name"),
        F.regexp_extract("clean", _REQUIREMENT, 2).alias("op"),
        F.nullif(F.regexp_extract("clean", _REQUIREMENT, 3), F.lit("")).alias("version"),
    )
    pinned = F.col("op").isin("==", "===") & F.col("version").isNotNull()
    return _packages(
        parsed, "pip",
        F.col("version"),
        F.when(F.col("version").isNotNull(), F.concat("op", "version")).otherwise(F.col("clean")),
        F.lit(False),
        F.when(pinned, "OBSERVED").when(F.col("version").isNotNull(), "INFERRED").otherwise("UNKNOWN"),
        F.when(pinned, "pinned").when(F.col("version").isNotNull(), "unpinned constraint").otherwise("no version constraint"),
    )


def pip_packages(files: DataFrame) -> DataFrame:
    plain = files.filter(F.col("basename").isin("requirements.txt", "requirements-dev.txt")).select(
        "repo", "path", F.explode(F.split("text", "\r?\n")).alias("line")
    )
    block = F.regexp_extract("text", r"(?s)dependencies\s*=\s*\[(.*?)\]", 1)
    project = files.filter(F.col("basename") == "pyproject.toml").select(
        "repo", "path", F.explode(F.split(block, "[\n,]")).alias("raw")
    )
    # Quotes around an entry are dropped, once on each side.
    entry = F.trim(F.regexp_replace(F.trim("raw"), "^[\"']|[\"']$", ""))
    project = project.filter(~F.trim("raw").startswith("#")).select("repo", "path", entry.alias("line"))
    return _requirement_rows(plain.unionByName(project))


def _tag(xml: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(xml, rf"<{name}>\s*([^<]*?)\s*</{name}>", 1), F.lit(""))


def _without_comments(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)<!--.*?-->", "")


def maven_packages(files: DataFrame) -> DataFrame:
    """Literal versions only: properties, ranges and managed versions stay unknown."""
    poms = files.filter(F.col("basename") == "pom.xml")
    blocks = F.regexp_extract_all(_without_comments(F.col("text")), F.lit("(?s)<dependency>(.*?)</dependency>"), F.lit(1))
    deps = poms.select("repo", "path", F.explode(blocks).alias("b")).select(
        "repo",
        "path",
        F.concat(_tag(F.col("b"), "groupId"), F.lit(":"), _tag(F.col("b"), "artifactId")).alias("name"),
        _tag(F.col("b"), "version").alias("declared"),
        F.coalesce(_tag(F.col("b"), "scope").isin("test", "provided"), F.lit(False)).alias("is_dev"),
    ).filter(F.col("name").isNotNull())
    version = F.col("declared")
    literal = version.isNotNull() & ~version.contains("${") & ~version.rlike(r"^[\[(]")
    return _packages(
        deps, "maven",
        F.when(literal, version),
        version,
        F.col("is_dev"),
        F.when(literal, "OBSERVED").otherwise("UNKNOWN"),
        F.when(version.isNull(), "no version; managed elsewhere")
        .when(version.contains("${"), "version is a property")
        .when(~literal, "version range")
        .otherwise("literal version"),
    )


def packages_from_manifests(files: DataFrame) -> DataFrame:
    return npm_packages(files).unionByName(pip_packages(files)).unionByName(maven_packages(files))


def self_versions(files: DataFrame) -> DataFrame:
    """The version each repository declares for itself, first file in path order."""
    xml = _without_comments(F.col("text"))
    head = F.regexp_replace(xml, r"(?s)<(?:dependencies|build|profiles|modules)\b.*$", "")
    own = _tag(F.regexp_replace(head, "(?s)<parent>.*?</parent>", ""), "version")
    parent = _tag(F.regexp_extract(head, "(?s)<parent>(.*?)</parent>", 1), "version")
    own = F.when(~own.contains("${"), own)
    parent = F.when(~parent.contains("${"), parent)
    project = F.regexp_extract("text", r"(?s)\[project\](.*?)(?=\n\[|$)", 1)
    toml = F.nullif(F.regexp_extract(project, r"(?m)^\s*version\s*=\s*[\"']([^\"']+)[\"']", 1), F.lit(""))
    npm = F.from_json("text", _PKG)["version"]
    name = F.col("basename")
    value = F.when(name == "package.json", npm).when(name == "pyproject.toml", toml).when(
        name == "pom.xml", F.coalesce(own, parent)
    )
    inherited = (name == "pom.xml") & own.isNull()
    rows = files.filter(name.isin("package.json", "pyproject.toml", "pom.xml")).select(
        "repo",
        "path",
        F.when(name == "package.json", "npm").when(name == "pyproject.toml", "pip").otherwise("maven").alias("ecosystem"),
        value.alias("value"),
        F.when(inherited, "INFERRED").otherwise("OBSERVED").alias("provenance"),
    )
    found = rows.groupBy("repo", "ecosystem").agg(
        F.min_by(F.struct("value", "provenance", "path"), F.when(F.col("value").isNotNull(), F.col("path"))).alias("v")
    )
    return found.select(
        "repo", "ecosystem", F.col("v.value").alias("self_version"),
        F.coalesce("v.provenance", F.lit("UNKNOWN")).alias("provenance"), F.col("v.path").alias("source"),
    )


def manifest_warnings(files: DataFrame, packages: DataFrame) -> DataFrame:
    """What limits the reading: unreadable files, missing lock files, unresolved versions."""
    broken = files.filter(
        F.col("basename").isin("package.json", "package-lock.json") & F.expr("try_parse_json(text)").isNull()
    ).select("repo", F.col("path").alias("subject"), F.lit("UNPARSEABLE").alias("warning"))
    manifests = files.filter(F.col("basename") == "package.json").select("repo", "dir")
    locks = files.filter(F.col("basename") == "package-lock.json").select("repo", "dir")
    unlocked = manifests.join(locks, ["repo", "dir"], "left_anti").select(
        "repo", F.col("dir").alias("subject"), F.lit("NO_LOCK_FILE").alias("warning")
    )
    loose = (
        packages.filter(
            ((F.col("ecosystem") == "pip") & (F.col("provenance") != "OBSERVED"))
            | ((F.col("ecosystem") == "maven") & (F.col("provenance") == "UNKNOWN"))
        )
        .groupBy("repo", "ecosystem")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("repo", F.concat_ws(":", "ecosystem", F.col("n").cast("string")).alias("subject"), F.lit("UNRESOLVED_VERSIONS").alias("warning"))
    )
    return broken.unionByName(unlocked).unionByName(loose)


def facts_from_configs(files: DataFrame, declarations: Sequence[Mapping[str, object]]) -> DataFrame:
    """Declared facts per repository: OBSERVED with value and type, or UNKNOWN with the reason.

    A declaration has ``name``, ``file`` and ``path`` (list of keys). A default is never assumed.
    """
    first = files.groupBy("repo", "basename").agg(F.min_by(F.struct("path", "text"), "path").alias("f"))
    listed = F.array(
        *[
            F.struct(
                F.lit(d["name"]).alias("name"), F.lit(d["file"]).alias("file"), F.lit(".".join(d["path"])).alias("key")
            )
            for d in declarations
        ]
    )
    repos = files.select("repo").distinct().select("repo", F.explode(listed).alias("d")).select("repo", "d.*")
    rows = repos.join(first.withColumnRenamed("basename", "file"), ["repo", "file"], "left").withColumn(
        "v", F.expr("try_parse_json(f.text)")
    )
    # One branch per declaration: variant paths are literals.
    value, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in declarations:
        path = "$." + ".".join(d["path"])
        here = F.col("name") == d["name"]
        value = F.when(here, F.try_variant_get("v", path, "string")).otherwise(value)
        kind = F.when(here, F.schema_of_variant(F.try_variant_get("v", path, "variant"))).otherwise(kind)
    rows = rows.withColumns({"value": value, "sql_type": kind})
    found = F.col("sql_type").isNotNull()
    return rows.select(
        "repo",
        "name",
        F.when(found, F.col("value")).alias("value"),
        F.when(F.col("sql_type") == "BOOLEAN", "boolean")
        .when(F.col("sql_type") == "STRING", "string")
        .when(F.col("sql_type").startswith("OBJECT") | F.col("sql_type").startswith("ARRAY"), "object")
        .when(found & (F.col("sql_type") != "VOID"), "number")
        .alias("value_type"),
        F.when(found, "OBSERVED").otherwise("UNKNOWN").alias("provenance"),
        F.when(F.col("f").isNull(), F.concat("file", F.lit(" not found in this repository")))
        .when(F.col("v").isNull(), F.concat("f.path", F.lit(" could not be parsed")))
        .when(~found, F.concat("f.path", F.lit(": key "), "key", F.lit(" absent")))
        .otherwise(F.concat_ws(" ", "f.path", "key"))
        .alias("source"),
    )
