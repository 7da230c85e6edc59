"""The evidence graph as two DataFrames: nodes and typed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.schema import EDGE_TYPES


def edge_type(kind: Column) -> Column:
    """Unknown kinds count as mere correlation."""
    return F.when(kind.isin(*EDGE_TYPES), kind).otherwise("CORRELATED_WITH")


def graph_nodes(envelopes: DataFrame, slow_ms: int = 200) -> DataFrame:
    requests = (
        envelopes.groupBy("trace_id")
        .agg(F.sum("observed_ms").alias("total_ms"))
        .select(
            F.col("trace_id").cast("string").alias("id"),
            F.lit("REQUEST").alias("type"),
            F.when(F.col("total_ms") > slow_ms, "DEGRADED").otherwise("NOMINAL").alias("state"),
        )
    )
    components = envelopes.select(F.col("component_name").alias("id")).distinct()
    return requests.unionByName(
        components.select("id", F.lit("COMPONENT").alias("type"), F.lit(None).cast("string").alias("state"))
    )


def graph_edges(envelopes: DataFrame) -> DataFrame:
    """Trace to component: BLOCKED_BY where the hop failed, else OBSERVED_AT."""
    kind = F.when(F.col("status") == "FAILED", "BLOCKED_BY").otherwise("OBSERVED_AT")
    return envelopes.select(
        "trace_id",
        "ingest_seq",
        F.col("trace_id").cast("string").alias("from_id"),
        edge_type(kind).alias("type"),
        F.col("component_name").alias("to_id"),
        F.col("observed_ms").alias("duration_ms"),
        F.col("db_pid").cast("string").alias("lock_pid"),
    )


def call_edges(spans: DataFrame) -> DataFrame:
    """Trace to service, one edge per retained span."""
    return spans.select(
        "trace_id",
        "ingest_seq",
        F.col("trace_id").alias("from_id"),
        F.lit("CALLS").alias("type"),
        F.col("service").alias("to_id"),
        "duration_ms",
        F.lit(None).cast("string").alias("lock_pid"),
    )


def lineage(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.filter((F.col("from_id") == node_id) | (F.col("to_id") == node_id))


def causal_chains(edges: DataFrame) -> DataFrame:
    """Per trace: how many direct edges it has and which of them block or cause."""
    causal = F.col("type").isin("BLOCKED_BY", "CAUSED")
    return edges.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("direct_edges"),
        F.sum(causal.cast("bigint")).alias("cascade_edges"),
        F.sort_array(F.collect_set(F.when(causal, F.col("to_id")))).alias("cascade_components"),
    )


def root_blockage(edges: DataFrame) -> DataFrame:
    """The first BLOCKED_BY edge of each trace."""
    blocked = edges.filter(F.col("type") == "BLOCKED_BY")
    return (
        blocked.groupBy("trace_id")
        .agg(F.min_by(F.struct("to_id", "duration_ms", "lock_pid"), "ingest_seq").alias("b"))
        .select(
            "trace_id",
            F.col("b.to_id").alias("blockage_node"),
            F.col("b.duration_ms").alias("duration_ms"),
            F.col("b.lock_pid").alias("lock_pid"),
            F.lit("Resource Contention").alias("reason"),
        )
    )
