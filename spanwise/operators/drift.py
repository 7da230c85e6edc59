"""Compatibility drift: rules over packages and facts, along requests and across boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.attributes import attr_strict
from spanwise.functions.timing import span_kind
from spanwise.functions.versions import eval_constraint, is_exact
from spanwise.operators.ordered import newest_per_key
from spanwise.operators.traces import CLIENT, SERVER, repeated_spans, service_edges, trace_tree
from spanwise.session import keep

_DAY_MS = 86_400_000
PACKAGES = "array<struct<name:string,declared:string,resolved:string>>"


def targets(packages: DataFrame, facts: DataFrame) -> DataFrame:
    """Packages (first per repository and name) and facts as one lookup of observed values.

    ``packages``: repo, name, version, declared, provenance, seq. ``facts``: repo, name, value,
    value_type, provenance.
    """
    first = newest_per_key(packages, ["repo", "name"], [F.col("seq")], 1)
    p = first.select(
        "repo", F.lit("package").alias("kind"), "name", F.col("version").alias("value"),
        F.when(F.col("version").isNotNull(), "string").alias("value_type"), "provenance", "declared",
    )
    f = facts.select(
        "repo", F.lit("fact").alias("kind"), "name", "value", "value_type", "provenance",
        F.lit(None).cast("string").alias("declared"),
    )
    return p.unionByName(f)


def _side(found: DataFrame, prefix: str) -> DataFrame:
    return found.select(
        F.col("repo"),
        F.col("kind").alias(f"{prefix}_kind"),
        F.col("name").alias(f"{prefix}_name"),
        F.lit(True).alias(f"{prefix}_found"),
        F.col("value").alias(f"{prefix}_value_seen"),
        F.col("value_type").alias(f"{prefix}_type"),
        F.col("provenance").alias(f"{prefix}_provenance"),
        F.col("declared").alias(f"{prefix}_declared"),
    )


def check_drift(packages: DataFrame, facts: DataFrame, rules: DataFrame) -> DataFrame:
    """One finding per repository and rule whose subject is present.

    ``rules``: rule_id, severity, when_kind, when_name, when_op, when_value, require_kind ('package',
    'fact' or 'absent'), require_name, require_op, require_value.
    """
    c = F.col
    known = targets(packages, facts)
    subject = rules.join(_side(known, "when"), ["when_kind", "when_name"])
    lookup_kind = F.when(c("require_kind") == "absent", "package").otherwise(c("require_kind"))
    required = _side(known, "require").withColumnRenamed("require_kind", "lookup_kind")
    both = subject.withColumn("lookup_kind", lookup_kind).join(
        required, ["repo", "lookup_kind", "require_name"], "left"
    )
    applies = eval_constraint(c("when_op"), c("when_value"), c("when_value_seen"), c("when_type"))
    outcome = eval_constraint(c("require_op"), c("require_value"), c("require_value_seen"), c("require_type"))
    judged = both.withColumns({"applies": applies, "outcome": outcome}).filter(c("applies.result") != "VIOLATED")
    present = F.coalesce(c("require_found"), F.lit(False))
    status = (
        F.when(c("applies.result") == "UNKNOWN", "UNKNOWN")
        .when((c("require_kind") == "absent") & present, "VIOLATION")
        .when(c("require_kind") == "absent", "SATISFIED")
        .when(~present | c("require_value_seen").isNull(), "UNKNOWN")
        .when(c("outcome.result") == "VIOLATED", "VIOLATION")
        .otherwise(c("outcome.result"))
    )
    resolved = (c("when_provenance") == "OBSERVED") & (c("require_provenance") == "OBSERVED")
    provenance = (
        F.when(c("applies.result") == "UNKNOWN", "UNKNOWN")
        .when((c("require_kind") == "absent") & present, c("require_provenance"))
        .when(c("require_kind") == "absent", "OBSERVED")
        .when(status == "UNKNOWN", "UNKNOWN")
        .when(resolved, "OBSERVED")
        .otherwise("INFERRED")
    )
    detail = (
        F.when(c("applies.result") == "UNKNOWN", F.concat(F.lit("subject "), "when_name", F.lit(": "), "applies.reason"))
        .when(
            (c("require_kind") == "absent") & present,
            F.concat("require_name", F.lit(" is declared as "), F.coalesce("require_declared", F.lit("?"))),
        )
        .when(c("require_kind") == "absent", "not declared in any manifest")
        .when(~present | c("require_value_seen").isNull(), F.concat("require_name", F.lit(": not available")))
        .otherwise(
            F.concat("when_name", F.lit(" "), "when_value_seen", F.lit(" -> "), "require_name", F.lit(": "), "outcome.reason")
        )
    )
    return judged.select(
        "repo", "rule_id", "severity", status.alias("status"), provenance.alias("provenance"), detail.alias("detail"),
        "when_kind", "when_name", "require_kind", "require_name", c("applies.result").alias("applicability"),
    )


def drift_coverage(packages: DataFrame, findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Per repository: what was read, what any rule covers, and counts that never add up to 'compatible'."""
    c = F.col
    subject = findings.filter(c("when_kind") == "package").select("repo", c("when_name").alias("name"))
    # What a rule requires counts as covered only once the rule is known to apply.
    required = findings.filter(
        (c("applicability") == "SATISFIED") & c("require_kind").isin("package", "absent")
    ).select("repo", c("require_name").alias("name"))
    covered = subject.unionByName(required).distinct()
    n_covered = covered.groupBy("repo").agg(F.count(F.lit(1)).alias("packages_covered"))
    read = packages.groupBy("repo").agg(F.count(F.lit(1)).alias("packages_read"))
    open_ = packages.join(covered, ["repo", "name"], "left_anti").groupBy("repo").agg(
        F.count(F.lit(1)).alias("packages_uncovered")
    )
    counts = findings.groupBy("repo").agg(
        F.count(F.lit(1)).alias("rules_applied"),
        *[
            F.sum((c("status") == s).cast("bigint")).alias(n)
            for s, n in (("VIOLATION", "violations"), ("SATISFIED", "satisfied"), ("UNKNOWN", "unknown"))
        ],
    )
    loaded = rules.groupBy().agg(F.count(F.lit(1)).alias("rules_loaded"))
    rows = read.join(n_covered, "repo", "left").join(open_, "repo", "left").join(counts, "repo", "left").crossJoin(loaded)
    numbers = ["packages_covered", "packages_uncovered", "rules_applied", "violations", "satisfied", "unknown"]
    sentence = F.format_string(
        "%d rule(s) applied: %d VIOLATION, %d SATISFIED, %d UNKNOWN. "
        "%d of %d dependencies are covered by no rule; their compatibility is UNKNOWN.",
        "rules_applied", "violations", "satisfied", "unknown", "packages_uncovered", "packages_read",
    )
    return rows.fillna(0, numbers).withColumn("summary", sentence)


def uncovered_packages(packages: DataFrame, findings: DataFrame) -> DataFrame:
    """The packages no rule speaks about, one row each."""
    c = F.col
    covered = (
        findings.filter(c("when_kind") == "package")
        .select("repo", c("when_name").alias("name"))
        .unionByName(
            findings.filter((c("applicability") == "SATISFIED") & c("require_kind").isin("package", "absent")).select(
                "repo", c("require_name").alias("name")
            )
        )
        .distinct()
    )
    return packages.join(covered, ["repo", "name"], "left_anti")


def path_components(spans: DataFrame) -> DataFrame:
    """Per trace and service: hops, first deployed version, whether versions conflict, environment."""
    seq = F.col("ingest_seq")

    def first(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), seq))

    return (
        spans.filter(F.length("service") > 0)
        .groupBy("trace_id", "service")
        .agg(
            F.count(F.lit(1)).alias("hop_count"),
            first("service_version").alias("deployed_version"),
            F.coalesce(F.min("service_version") != F.max("service_version"), F.lit(False)).alias("version_conflict"),
            first("deployment_environment").alias("deployment_environment"),
        )
    )


def request_drift(components: DataFrame, bindings: DataFrame, manifests: DataFrame, findings: DataFrame) -> DataFrame:
    """Each component of each request against the manifest its service is bound to.

    ``bindings``: service, manifest_path. ``manifests``: manifest_path, readable, declared_version;
    each manifest is judged once. ``findings`` come from ``check_drift`` with repo = manifest_path.
    """
    c = F.col
    per_manifest = findings.groupBy(c("repo").alias("manifest_path")).agg(
        F.count(F.lit(1)).alias("findings"), F.sum((c("status") == "VIOLATION").cast("bigint")).alias("violations")
    )
    sources = (
        bindings.select("service", "manifest_path")
        .join(manifests.select("manifest_path", "readable", "declared_version"), "manifest_path", "left")
        .join(per_manifest, "manifest_path", "left")
        .withColumn("bound", F.lit(True))
    )
    rows = components.join(sources, "service", "left").withColumns(
        {
            "bound": F.coalesce("bound", F.lit(False)),
            "readable": F.coalesce("readable", F.lit(False)),
            "findings": F.coalesce("findings", F.lit(0)),
            "violations": F.coalesce("violations", F.lit(0)),
        }
    )
    usable = c("bound") & c("readable")
    agreement = (
        F.when(~usable, F.lit(None))
        .when(c("deployed_version").isNull() | c("declared_version").isNull(), "UNKNOWN")
        .when(c("deployed_version") == c("declared_version"), "AGREES")
        .otherwise("DISAGREES")
    )
    status = F.when(~usable, "UNKNOWN").when(c("violations") > 0, "VIOLATION").when(c("findings") > 0, "CHECKED").otherwise("UNKNOWN")
    reason = (
        F.when(~c("bound"), "no binding declares a version source for this component")
        .when(~c("readable"), "bound, but the manifest could not be read")
        .when(c("findings") == 0, "bound, but no rule applies")
    )
    return rows.select(
        "trace_id", "service", "hop_count", "deployed_version", "version_conflict", "bound", "manifest_path",
        agreement.alias("version_agreement"), status.alias("status"), reason.alias("reason"),
        F.when(usable, c("violations")).otherwise(0).alias("violations"),
    )


def request_drift_summary(drift: DataFrame) -> DataFrame:
    """Counts and a sentence per request; unbound hops are always named first."""
    c = F.col

    def count(test: Column) -> Column:
        return F.sum(test.cast("bigint"))

    rows = drift.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("components"),
        count(c("bound")).alias("bound"),
        count(~c("bound")).alias("unbound"),
        count(c("status") == "VIOLATION").alias("components_with_violations"),
        F.sum("violations").alias("violations"),
        count(F.coalesce(c("version_agreement") == "DISAGREES", F.lit(False))).alias("different_build"),
    )
    sentence = F.concat(
        F.format_string("%d component(s); %d bound, %d UNKNOWN. ", "components", "bound", "unbound"),
        F.when(c("violations") > 0, F.format_string("%d violation(s) in source manifests.", "violations")).otherwise(
            "No violation among the components that could be checked."
        ),
        F.when(c("unbound") > 0, " Not shown to be free of drift.").otherwise(""),
    )
    return rows.withColumn("summary", sentence)


def _bind(rows: DataFrame, builds: DataFrame, prefix: str = "") -> DataFrame:
    """Add state, reason and packages of the inventory bound to (service, artifact_digest).

    ``builds``: service, artifact_digest, declared_version, declared_by, evidence, packages.
    """
    c = F.col
    service, version, digest = f"{prefix}service", f"{prefix}service_version", f"{prefix}artifact_digest"
    inventories = (
        builds.groupBy("service", "artifact_digest")
        .agg(
            F.count(F.lit(1)).alias("_matches"),
            F.first(F.struct("declared_version", "declared_by", "evidence", "packages")).alias("_i"),
        )
        .withColumnsRenamed({"service": service, "artifact_digest": digest})
    )
    joined = rows.join(inventories, [service, digest], "left")

    def blank(x: Column) -> Column:
        return F.coalesce(x == "", F.lit(True))

    reason = (
        F.when(~F.coalesce(c(digest).rlike("^sha256:[a-f0-9]{64}$"), F.lit(False)), "DIGEST_INVALID")
        .when(F.coalesce(c("_matches"), F.lit(0)) != 1, "INVENTORY_NOT_UNIQUE")
        .when(
            blank(c("_i.declared_by")) | blank(c("_i.evidence")) | c("_i.packages").isNull(),
            "INVENTORY_UNATTRIBUTED",
        )
        .when(blank(c(version)) | blank(c("_i.declared_version")), "VERSION_MISSING")
        .when(c(version) != c("_i.declared_version"), "VERSION_DISAGREES")
    )
    return joined.withColumns(
        {
            f"{prefix}state": F.when(reason.isNull(), "CORRELATED").otherwise("UNKNOWN"),
            f"{prefix}reason": reason,
            f"{prefix}packages": F.coalesce("_i.packages", F.array().cast(PACKAGES)),
        }
    ).drop("_matches", "_i")


def deployment_evidence(spans: DataFrame, builds: DataFrame) -> DataFrame:
    """Is the running artifact of each span bound to exactly one attributed inventory?"""
    rows = spans.select("trace_id", "span_id", "ingest_seq", "service", "service_version", "artifact_digest")
    return _bind(rows, builds)


def boundary_findings(
    spans: DataFrame, builds: DataFrame, rules: DataFrame, now_ms: int, edges: DataFrame | None = None
) -> DataFrame:
    """Per observed boundary and applicable rule: VIOLATED, SATISFIED or UNKNOWN with what is missing.

    ``rules``: rule_id, from_package, from_op, from_value, to_package, op, value, when_key,
    when_value, recorded_ms, review_by_ms. A rule with several version conditions has one row per
    condition and the same rule_id.
    """
    c = F.col
    keys = ["trace_id", "span_id"]
    # Connection settings travel only if a rule asks for one.
    asked = not rules.filter(c("when_key").isNotNull()).isEmpty()
    settings = F.transform("attributes", lambda a: F.struct(a["key"].alias("key"), a["value"]["stringValue"].alias("v")))
    none = F.lit(None).cast("array<struct<key:string,v:string>>")
    facts = spans.select(
        *keys, "ingest_seq", "service_version", "artifact_digest", span_kind(c("kind")).alias("kind"),
        attr_strict(c("attributes"), "client.package").alias("client_package"), (settings if asked else none).alias("settings"),
    )
    measured = ["service_version", "artifact_digest", "client_package", "settings"]
    repeated = repeated_spans(spans)

    def latest(kind: int) -> DataFrame:
        """Newest observation of each span that may be such an end: of this kind, or seen more than once."""
        single = facts if repeated is None else facts.join(repeated, keys, "left_anti")
        single = single.filter(c("kind") == kind).select(*keys, *measured)
        if repeated is None:
            return single
        newest = facts.join(repeated, keys, "left_semi").groupBy(*keys).agg(F.max_by(F.struct(*measured), "ingest_seq").alias("x"))
        return single.unionByName(newest.select(*keys, "x.*"))

    client = latest(CLIENT).select(
        "trace_id",
        c("span_id").alias("client_span_id"),
        c("service_version").alias("from_service_version"),
        c("artifact_digest").alias("from_artifact_digest"),
        "client_package",
        "settings",
    )
    server = latest(SERVER).select(
        "trace_id",
        c("span_id").alias("server_span_id"),
        c("service_version").alias("to_service_version"),
        c("artifact_digest").alias("to_artifact_digest"),
    )
    tree = trace_tree(spans, boundary=True).select("trace_id", c("state").alias("tree"))
    observed = service_edges(spans) if edges is None else edges
    ends = ["from_service", "from_service_version", "from_artifact_digest", "to_service", "to_service_version", "to_artifact_digest"]
    rows = keep(
        observed.join(client, ["trace_id", "client_span_id"]).join(server, ["trace_id", "server_span_id"]).join(tree, "trace_id", "left"),
        "boundaries",
    )
    # Inventories and rules meet each pair of builds once, not every boundary between them.
    judged = keep(_judged_pairs(_bind(_bind(rows.select(*ends).distinct(), builds, "from_"), builds, "to_"), rules, now_ms), "judged-pairs")
    judged = judged.withColumnsRenamed({e: f"_{e}" for e in ends})
    same = c(ends[0]).eqNullSafe(c(f"_{ends[0]}"))
    for e in ends[1:]:
        same = same & c(e).eqNullSafe(c(f"_{e}"))
    found = F.filter("settings", lambda s: s["key"] == c("when_key"))
    pairs = rows.join(judged, same).withColumn("setting", F.when(F.size(found) == 1, F.get(found, F.lit(0))["v"]))
    outside = F.coalesce(c("when_key").isNotNull() & (c("setting") != c("when_value")), F.lit(False))
    missing = F.array_compact(
        F.array(
            F.when(~F.coalesce(c("client_package") == c("from_package"), F.lit(False)), "client package not observed"),
            F.when(~F.coalesce(c("tree") == "OBSERVED_TREE", F.lit(False)), "trace is not one intact tree"),
            F.when(c("uncorrelated"), "deployment inventory missing on an endpoint"),
            F.when(c("inexact"), "no unique exact package version"),
            F.when(c("unscoped"), "rule applicability unknown"),
            F.when(c("stale"), "rule is stale or future-dated"),
            F.when(c("when_key").isNotNull() & c("setting").isNull(), "connection setting not observed"),
        )
    )
    return (
        pairs.filter(~outside)
        .withColumn("missing", missing)
        .select(
            "trace_id", "from_service", "to_service", "client_span_id", "server_span_id", "rule_id",
            F.when(F.size("missing") > 0, "UNKNOWN").otherwise(c("verdict.result")).alias("status"),
            F.when(F.size("missing") > 0, F.array_join("missing", "; ")).otherwise(c("verdict.reason")).alias("reason"),
            "missing",
        )
    )


def _judged_pairs(bound: DataFrame, rules: DataFrame, now_ms: int) -> DataFrame:
    """The rules that apply to each pair of builds, with what they say and what they lack."""
    c = F.col
    ends = [x for x in bound.columns if x.endswith(("_service", "_service_version", "_artifact_digest"))]
    names = bound.withColumn("from_package", F.explode(F.array_distinct(F.transform("from_packages", lambda p: p["name"]))))
    scoped = rules.groupBy("rule_id").agg(
        F.first("from_package").alias("from_package"),
        F.first("to_package").alias("to_package"),
        F.collect_list(F.struct(c("from_op").alias("op"), c("from_value").alias("value"))).alias("from_version"),
        *[F.first(k).alias(k) for k in ("op", "value", "when_key", "when_value", "recorded_ms", "review_by_ms")],
    )
    pairs = names.join(scoped, "from_package").filter(
        F.exists("to_packages", lambda p: p["name"] == c("to_package"))
    )
    a = F.filter("from_packages", lambda p: p["name"] == c("from_package"))
    b = F.filter("to_packages", lambda p: p["name"] == c("to_package"))
    pairs = pairs.withColumns({"a": a, "b": b}).withColumns(
        {
            "a_version": F.when((F.size("a") == 1) & is_exact(F.get("a", F.lit(0))["resolved"]), F.get("a", F.lit(0))["resolved"]),
            "b_version": F.when((F.size("b") == 1) & is_exact(F.get("b", F.lit(0))["resolved"]), F.get("b", F.lit(0))["resolved"]),
        }
    )
    scope = F.transform("from_version", lambda v: eval_constraint(v["op"], v["value"], c("a_version"))["result"])
    now = F.lit(now_ms)
    correlated = (c("from_state") == "CORRELATED") & (c("to_state") == "CORRELATED")
    return (
        pairs.withColumn("scope", scope)
        .filter(~F.array_contains("scope", "VIOLATED"))
        .select(
            *ends, "rule_id", "from_package", "when_key", "when_value",
            (~correlated).alias("uncorrelated"),
            (c("a_version").isNull() | c("b_version").isNull()).alias("inexact"),
            F.array_contains("scope", "UNKNOWN").alias("unscoped"),
            ((now < c("recorded_ms")) | (now > c("review_by_ms") + _DAY_MS - 1)).alias("stale"),
            eval_constraint(c("op"), c("value"), c("b_version")).alias("verdict"),
        )
    )


def boundary_compatibility(spans: DataFrame, findings: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Every observed boundary with the verdict over its findings."""
    keys = ["trace_id", "client_span_id"]
    summed = findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("findings"),
        F.max((F.col("status") == "VIOLATED").cast("int")).alias("violated"),
        F.min((F.col("status") == "SATISFIED").cast("int")).alias("satisfied"),
    )
    return (
        (service_edges(spans) if edges is None else edges)
        .join(summed, keys, "left")
        .select(
            "trace_id", "from_service", "to_service", "client_span_id", "server_span_id",
            F.coalesce("findings", F.lit(0)).alias("findings"),
            F.when(F.col("violated") == 1, "VIOLATED")
            .when(F.col("satisfied") == 1, "CHECKED_PREREQUISITES")
            .otherwise("UNKNOWN")
            .alias("status"),
        )
    )


def trace_compatibility(spans: DataFrame, boundaries: DataFrame) -> DataFrame:
    """VIOLATED or UNKNOWN per trace: passing checks never add up to compatibility."""
    tree = trace_tree(spans, boundary=True).select("trace_id", "state")
    per_trace = boundaries.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("observed_boundaries"),
        F.sum((F.col("status") != "UNKNOWN").cast("bigint")).alias("checked_boundaries"),
        F.max((F.col("status") == "VIOLATED").cast("int")).alias("violated"),
    )
    return tree.join(per_trace, "trace_id", "left").select(
        "trace_id",
        F.coalesce("observed_boundaries", F.lit(0)).alias("observed_boundaries"),
        F.coalesce("checked_boundaries", F.lit(0)).alias("checked_boundaries"),
        F.when((F.col("state") == "OBSERVED_TREE") & (F.col("violated") == 1), "VIOLATED").otherwise("UNKNOWN").alias("status"),
    )


def expected_coverage(expected: DataFrame, edges: DataFrame) -> DataFrame:
    """Declared interactions (from_service, to_service, declared_by, evidence) that were observed."""
    seen = edges.groupBy("from_service", "to_service").agg(F.count(F.lit(1)).alias("observed_edges"))
    rows = expected.join(seen, ["from_service", "to_service"], "left")
    attributed = (F.length("declared_by") > 0) & (F.length("evidence") > 0)
    attributed = F.coalesce(attributed, F.lit(False))
    return rows.select(
        "from_service", "to_service",
        F.coalesce("observed_edges", F.lit(0)).alias("observed_edges"),
        F.when(attributed & F.col("observed_edges").isNotNull(), "OBSERVED_BOUNDARY").otherwise("UNKNOWN").alias("state"),
        F.when(~attributed, "expectation lacks attribution or evidence")
        .otherwise("an expectation creates no edge and no compatibility")
        .alias("reason"),
    )
