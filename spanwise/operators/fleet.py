"""Fleet-wide views: services, incidents, coverage, ingestion lag, retention."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.numbers import round_exact, round_half_up
from spanwise.operators.ordered import newest_per_key
from spanwise.operators.traces import duration, worst_status
from spanwise.session import keep

RTI_DIMENSIONS = ("structural", "performance", "semantic", "dependency", "infrastructure", "change", "causal")
RETENTION_MS = 30 * 86_400_000


def service_rollup(spans: DataFrame, inventoried: DataFrame | None = None) -> DataFrame:
    """Hops, failures and latency per service, worst first."""
    rolled = (
        spans.filter(F.length("service") > 0)
        .groupBy("service")
        .agg(
            F.count(F.lit(1)).alias("hops"),
            F.sum((F.col("status") == "DEGRADED").cast("bigint")).alias("degraded"),
            F.sum((F.col("status") == "ERROR").cast("bigint")).alias("errors"),
            F.sum(duration()).alias("total_ms"),
        )
        .withColumn("avg_ms", round_half_up(F.col("total_ms") / F.col("hops")))
    )
    if inventoried is None:
        rolled = rolled.withColumn("inventory_known", F.lit(False))
    else:
        known = inventoried.select("service").distinct().withColumn("inventory_known", F.lit(True))
        rolled = rolled.join(known, "service", "left").fillna(False, ["inventory_known"])
    return rolled.orderBy(F.desc(F.col("errors") + F.col("degraded")), F.desc("hops"), "service")


def all_incidents(spans: DataFrame) -> DataFrame:
    """Every trace that is not OK, with the hop where it first went wrong."""
    bad = F.col("status") != "OK"
    return (
        spans.groupBy("trace_id")
        .agg(
            worst_status().alias("severity"),
            F.sum(duration()).alias("total_ms"),
            F.min_by("service", F.when(bad, F.col("ingest_seq"))).alias("first_service"),
            F.min_by("duration_ms", F.when(bad, F.col("ingest_seq"))).alias("first_duration_ms"),
            F.min(F.when(F.col("observed_ms") != 0, F.col("observed_ms"))).alias("observed_ms"),
            F.sort_array(F.collect_set("service")).alias("services"),
        )
        .filter(F.col("severity") != "OK")
        .select(
            "trace_id",
            "severity",
            "total_ms",
            "first_service",
            "first_duration_ms",
            "observed_ms",
            "services",
        )
    )


def _worst_first() -> list[Column]:
    return [
        F.when(F.col("severity") == "ERROR", 0).otherwise(1).asc(), F.desc("total_ms"), F.asc("trace_id"),
    ]


def incidents(spans: DataFrame, top: int = 100) -> DataFrame:
    """The report of the worst incidents: errors before degradations, then slowest."""
    return all_incidents(spans).orderBy(*_worst_first()).limit(top)


def incident_clusters(spans: DataFrame, ids_per_cluster: int = 10) -> DataFrame:
    """Incidents by the service where they began, with the worst few trace ids of each.

    The incidents are written once, a narrow row each, for the count and for the worst.
    """
    found = all_incidents(spans).select(
        F.coalesce(F.nullif("first_service", F.lit("")), F.lit("unattributed")).alias("service"),
        "trace_id", "severity", "total_ms",
    )
    found = keep(found, "incidents")
    counts = found.groupBy("service").agg(F.count(F.lit(1)).alias("incidents"))
    named = newest_per_key(found, ["service"], _worst_first(), ids_per_cluster)
    rank = F.struct(
        F.when(F.col("severity") == "ERROR", 0).otherwise(1).alias("s"), (-F.col("total_ms")).alias("t"), "trace_id"
    )
    ids = named.groupBy("service").agg(
        F.transform(F.sort_array(F.collect_list(rank)), lambda r: r["trace_id"]).alias("trace_ids")
    )
    return counts.join(ids, "service").orderBy(F.desc("incidents"), "service")


def coverage(spans: DataFrame, inventoried: DataFrame, changes: DataFrame, advisories: DataFrame) -> DataFrame:
    """One row: what is known about the services seen. No inventory means unknown, not clean."""
    seen = spans.filter(F.length("service") > 0).select("service").distinct()
    known = inventoried.select("service").distinct().withColumn("known", F.lit(True))
    services = (
        seen.join(known, "service", "left")
        .groupBy()
        .agg(
            F.count(F.lit(1)).alias("services_seen"),
            F.count("known").alias("services_with_inventory"),
            F.sort_array(F.collect_list(F.when(F.col("known").isNull(), F.col("service")))).alias("services_unknown"),
        )
    )
    n_changes = changes.groupBy().agg(F.count(F.lit(1)).alias("changes_known"))
    n_advisories = advisories.groupBy().agg(F.countDistinct("advisory_id").alias("advisories_known"))
    # Three one-row aggregates side by side.
    return services.crossJoin(n_changes).crossJoin(n_advisories)


def fleet_overview(spans: DataFrame, inventoried: DataFrame, changes: DataFrame, advisories: DataFrame) -> DataFrame:
    """Totals, service table and clusters as (section, name, metric, value) rows."""
    totals = (
        spans.groupBy("trace_id")
        .agg(worst_status().alias("status"))
        .groupBy()
        .agg(F.count(F.lit(1)).alias("traces"), F.sum((F.col("status") != "OK").cast("bigint")).alias("incidents"))
        .withColumn("name", F.lit("all"))
    )
    sections = [
        ("total", totals, ["traces", "incidents"]),
        ("service", service_rollup(spans, inventoried).withColumnRenamed("service", "name"),
         ["hops", "degraded", "errors", "total_ms", "avg_ms"]),
        ("cluster", incident_clusters(spans).withColumnRenamed("service", "name"), ["incidents"]),
        ("coverage", coverage(spans, inventoried, changes, advisories).withColumn("name", F.lit("all")),
         ["services_seen", "services_with_inventory", "changes_known", "advisories_known"]),
    ]
    out = None
    for section, frame, metrics in sections:
        part = frame.unpivot(
            ["name"], [F.col(m).cast("bigint").alias(m) for m in metrics], "metric", "value"
        ).select(F.lit(section).alias("section"), "name", "metric", "value")
        out = part if out is None else out.unionByName(part)
    return out


def lag_metrics(collections: DataFrame, keep: int = 1000) -> DataFrame:
    """Average, p50, p95 and maximum lag over the last ``keep`` collections of each source.

    The percentile index is floor(n*p), counted from zero.
    """
    recent = newest_per_key(
        collections, ["source"], [F.desc("collected_ms"), F.desc("event_id")], keep
    )
    lists = recent.groupBy("source").agg(
        F.sort_array(F.collect_list("lag_ms")).alias("lags"), F.avg("lag_ms").alias("mean")
    )

    def at(share: float) -> Column:
        return F.element_at("lags", (F.floor(F.size("lags") * F.lit(share)) + 1).cast("int"))

    counts = collections.groupBy("source").agg(F.count(F.lit(1)).alias("collected"))
    return lists.join(counts, "source").select(
        "source",
        "collected",
        round_exact("mean", 2).alias("avg_lag_ms"),
        at(0.5).alias("p50_lag_ms"),
        at(0.95).alias("p95_lag_ms"),
        F.element_at("lags", -1).alias("max_lag_ms"),
    )


def rti(df: DataFrame) -> DataFrame:
    """Request truth index: mean of the seven dimension scores, or NULL with the gaps named."""
    gaps = F.array_compact(F.array(*[F.when(F.col(d).isNull(), d) for d in RTI_DIMENSIONS]))
    total = F.col(RTI_DIMENSIONS[0])
    for d in RTI_DIMENSIONS[1:]:
        total = total + F.col(d)
    return df.withColumns({"rti": round_exact(total / len(RTI_DIMENSIONS), 1), "gaps": gaps})


def journey_rti(scored: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """One weighted index over journeys (``rti`` and ``weight`` columns); NULL if one is unknown."""
    weight = F.col("weight")
    if weights is not None:
        weight = None
        for journey, w in weights.items():
            test = F.col("journey") == journey
            weight = F.when(test, F.lit(w)) if weight is None else weight.when(test, F.lit(w))
    unknown = F.max(F.col("rti").isNull().cast("int")) == 1
    return scored.groupBy().agg(
        F.when(~unknown, round_exact(F.sum(F.col("rti") * weight), 1)).alias("weighted_rti"),
        F.count(F.lit(1)).alias("journeys"),
    )


def storage_report(spans: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """Traces, spans and retained bytes beside their limits."""
    size = F.octet_length(F.to_json(F.struct(*spans.columns)))
    usage = (
        spans.groupBy("trace_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"))
        .groupBy()
        .agg(
            F.count(F.lit(1)).alias("traces"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("spans"),
            F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"),
        )
    )
    limit = None
    for measure, value in limits.items():
        test = F.col("measure") == measure
        limit = F.when(test, F.lit(value)) if limit is None else limit.when(test, F.lit(value))
    return (
        usage.unpivot([], ["traces", "spans", "bytes"], "measure", "used")
        .withColumn("maximum", limit.cast("bigint") if limit is not None else F.lit(None).cast("bigint"))
        .withColumn(
            "state",
            F.when(F.col("maximum").isNull(), "UNKNOWN")
            .when(F.col("used") > F.col("maximum"), "EXCEEDED")
            .otherwise("WITHIN"),
        )
    )


def retention_review(spans: DataFrame, now_ms: int, horizon_ms: int = RETENTION_MS) -> DataFrame:
    """Traces old enough to review, and traces whose age cannot be told. Nothing is deleted."""
    at = F.col("received_ms")
    bad = at.isNull() | (at <= 0) | (at > now_ms)
    return (
        spans.groupBy("trace_id")
        .agg(F.max("received_ms").alias("latest_ms"), F.max(bad.cast("int")).alias("bad"))
        .withColumn(
            "review",
            F.when(F.col("bad") == 1, "UNKNOWN_AGE")
            .when(F.lit(now_ms) - F.col("latest_ms") >= horizon_ms, "REVIEW_REQUIRED")
            .otherwise("HELD"),
        )
        .drop("bad")
    )
