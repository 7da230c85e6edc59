"""The composed assessment of request journeys, many traces in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.operators import correlate, diagnose, graph
from spanwise.operators.ordered import oversized
from spanwise.session import keep

_LEVELS = ("LEVEL_1_EXACT", "LEVEL_2_PROTOCOL", "LEVEL_3_TOPOLOGY", "UNMATCHED")
#: Envelopes of a trace that one task may bring together. It says how the work is cut up; no answer depends on it.
GATHER = 1000
_FACTS = (
    "trace_id", "envelope_count", "total_ms", "failed", "p_message_id", "p_event_ms", "c_message_id", "c_event_ms",
    "conflicts", "violations", "inversions", "identity_level", "blockage_node", "n", "p",
)


def _level_rank() -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in _LEVELS]), F.col("level"))


def worst_identity_level(matches: DataFrame) -> DataFrame:
    """Weakest link between consecutive envelopes of each trace."""
    return matches.groupBy("trace_id").agg(F.max_by("level", _level_rank()).alias("identity_level"))


def _totals() -> list[Column]:
    producer, consumer = F.col("component_type") == "WEBSPHERE", F.col("component_type") == "MESSAGE_BROKER"
    return [
        F.count(F.lit(1)).alias("envelope_count"),
        F.sum("observed_ms").alias("total_ms"),
        F.max(F.col("status").isin("FAILED", "DEGRADED").cast("int")).alias("failed"),
        F.min_by("message_id", F.when(producer, F.col("ingest_seq"))).alias("p_message_id"),
        F.min(F.when(producer, F.col("event_ms"))).alias("p_event_ms"),
        F.min_by("message_id", F.when(consumer, F.col("ingest_seq"))).alias("c_message_id"),
        F.min(F.when(consumer, F.col("event_ms"))).alias("c_event_ms"),
    ]


def _joined(envelopes: DataFrame, ignore_identity: Sequence[str]) -> DataFrame:
    """The facts of traces of any size: each step splits a large trace, and the steps are joined."""
    unique = correlate.unique_envelopes(envelopes)
    per_trace = [
        correlate.source_conflicts(unique).groupBy("trace_id").agg(F.count(F.lit(1)).alias("conflicts")),
        correlate.causality_violations(unique).groupBy("trace_id").agg(F.count(F.lit(1)).alias("violations")),
        correlate.topology_anomalies(unique).groupBy("trace_id").agg(F.count(F.lit(1)).alias("inversions")),
        worst_identity_level(correlate.consecutive_matches(unique, ignore_identity)),
        graph.root_blockage(graph.graph_edges(unique)).select("trace_id", "blockage_node"),
        diagnose.claim_facts(unique),
    ]
    rows = unique.groupBy("trace_id").agg(*_totals())
    for part in per_trace:
        rows = rows.join(part, "trace_id", "left")
    return rows.fillna(0, ["conflicts", "violations", "inversions"]).select(*_FACTS)


def _gathered(envelopes: DataFrame, ignore_identity: Sequence[str], tolerance_ms: int = 50) -> DataFrame:
    """The same facts for traces that fit one task: the envelopes are shuffled once, every step runs where they are."""
    c = F.col
    keys = correlate.identity_columns(envelopes, ignore_identity)
    used = [
        "trace_id", "evidence_id", "ingest_seq", "component_type", "component_name", "event_type", "span_id", "event_ms",
        "observed_ms", "expected_ms", "lock_wait_ms", "cpu_pct", "status", "message_id", "sql_fingerprint", "db_pid",
    ]
    # Envelopes of no trace belong to no journey.
    rows = envelopes.filter(c("trace_id").isNotNull()).select(*dict.fromkeys(used + keys)).repartition("trace_id")
    same = Window.partitionBy("trace_id", correlate.signature())
    first = rows.withColumn("first_id", F.min_by("evidence_id", "ingest_seq").over(same))
    unique = first.filter(~F.coalesce(c("first_id") != c("evidence_id"), F.lit(False))).drop("first_id")

    # A component type is judged on its first envelope.
    by_type = Window.partitionBy("trace_id", "component_type").orderBy("ingest_seq")
    whole = by_type.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    judged = unique.withColumns(
        {
            "reports": F.count(F.lit(1)).over(whole),
            "min_ms": F.min("observed_ms").over(whole),
            "max_ms": F.max("observed_ms").over(whole),
            "place": F.row_number().over(by_type),
        }
    ).withColumn("conflict", (c("place") == 1) & correlate.sources_disagree())
    tier = correlate.stage_precedence(c("component_type"), c("component_name"))
    causal = Window.partitionBy("trace_id").orderBy(tier, "event_ms", "ingest_seq")
    arrival = Window.partitionBy("trace_id").orderBy("ingest_seq")
    linked = (
        judged.withColumn("early", F.lead("event_ms").over(causal) - c("event_ms") < -tolerance_ms)
        .withColumn("cur", F.struct("evidence_id", *keys))
        .withColumns({"prev": F.lag("cur").over(arrival), "arrived": F.row_number().over(arrival)})
        .withColumn("level", F.when(c("arrived") > 1, correlate.match_identity("prev", "cur", keys)["level"]))
    )

    def seen(component_type: str) -> Column:
        return F.min(F.when(c("component_type") == component_type, c("ingest_seq")))

    def times(test: Column) -> Column:
        return F.coalesce(F.sum(test.cast("bigint")), F.lit(0).cast("bigint"))

    inverted = [F.coalesce(seen(after) < seen(before), F.lit(False)).cast("bigint") for before, after in correlate.TOPOLOGY_ORDER]
    return linked.groupBy("trace_id").agg(
        *_totals(),
        times(c("conflict")).alias("conflicts"),
        times(c("early")).alias("violations"),
        sum(inverted, F.lit(0).cast("bigint")).alias("inversions"),
        F.max_by("level", _level_rank()).alias("identity_level"),
        F.min_by("component_name", F.when(c("status") == "FAILED", c("ingest_seq"))).alias("blockage_node"),
        F.count(F.lit(1)).alias("n"),
        F.max_by(*diagnose.primary_hop()).alias("p"),
    ).select(*_FACTS)


def journey_facts(envelopes: DataFrame, ignore_identity: Sequence[str] = (), gather: int = GATHER) -> DataFrame:
    """One row of facts per trace. Whether a trace is too large for one task is counted when the plan is built."""
    large = oversized(envelopes, ["trace_id"], gather).select("trace_id")
    if large.isEmpty():
        return _gathered(envelopes, ignore_identity)
    large = keep(large, "large-journeys")
    few = envelopes.join(large, "trace_id", "left_anti")
    many = envelopes.join(large, "trace_id", "left_semi")
    return _gathered(few, ignore_identity).unionByName(_joined(many, ignore_identity))


def process_journeys(
    envelopes: DataFrame,
    changes: DataFrame | None = None,
    expected_hops: int = 10,
    ignore_identity: Sequence[str] = (),
    gather: int = GATHER,
) -> DataFrame:
    """Deduplicate, link, order, check, blame and grade every journey."""
    facts = journey_facts(envelopes, ignore_identity, gather)
    rows = diagnose.claims_from(facts, changes, [f for f in _FACTS if f not in ("trace_id", "envelope_count", "n", "p")])
    rows = rows.withColumnRenamed("confidence", "causal_confidence").withColumns(
        {
            "has_conflicts": F.col("conflicts") > 0,
            "is_consistent": F.col("violations") == 0,
            # A single envelope has no link that could be weak.
            "identity_level": F.coalesce("identity_level", F.lit(_LEVELS[0])),
        }
    )
    pairs = rows.drop("status").withColumns({"p_correlation_id": F.lit(None).cast("string"), "c_correlation_id": F.lit(None).cast("string")})
    stitched = correlate.stitch_pairs(pairs).drop("confidence")
    graded = correlate.correlation_quality(stitched, expected_hops)
    unhealthy = (F.col("failed") == 1) | (F.col("classification") == "INFERRED")
    return graded.select(
        "trace_id", "envelope_count", "total_ms", "conflicts", "violations", "inversions", "identity_level",
        F.col("correlated").alias("async_correlated"), "transit_ms", "blockage_node", "primary_component", "statement",
        "classification", "causal_confidence", "evidence_completeness", "truth_status",
        F.when(unhealthy, "FAILED").otherwise("HEALTHY").alias("technical_status"),
    )
