"""Merging incoming observations with the retained ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.identity import observation_key
from spanwise.operators.ordered import newest_per_key

KEYS = ["trace_id", "span_id", "obs_key"]


def with_obs_key(df: DataFrame) -> DataFrame:
    return df if "obs_key" in df.columns else df.withColumn("obs_key", observation_key(df))


def new_observations(existing: DataFrame | None, incoming: DataFrame, order: Column) -> DataFrame:
    """``merge_observations`` with the hash of an observation, which covers its ids, as 32 bytes in ``obs_key``."""
    keyed = incoming.withColumn("obs_key", F.unhex(observation_key(incoming)))
    fresh = newest_per_key(keyed, ["obs_key"], [order], 1)
    if existing is None:
        return fresh
    return fresh.join(with_obs_key(existing).select(F.unhex("obs_key").alias("obs_key")), "obs_key", "left_anti").select(*fresh.columns)


def merge_observations(existing: DataFrame | None, incoming: DataFrame, order: Column) -> DataFrame:
    """The incoming observations that are new evidence.

    An exact resend is dropped, within the batch (first in ``order`` stays) and against the
    retained table. The same span with other evidence is kept.
    """
    if "obs_key" not in incoming.columns:
        return new_observations(existing, incoming, order).withColumn("obs_key", F.lower(F.hex("obs_key")))
    # A key that came with the spans may not cover their ids.
    fresh = newest_per_key(incoming, KEYS, [order], 1)
    if existing is None:
        return fresh
    return fresh.join(with_obs_key(existing).select(*KEYS), KEYS, "left_anti")


def merge_counts(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Per trace: observations received, added, dropped as resends, kept as conflicts."""
    arrived = with_obs_key(incoming).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("copies"))
    if existing is None:
        merged = arrived.withColumn("known", F.lit(False))
        variants = None
    else:
        kept = with_obs_key(existing).select(*KEYS).distinct()
        merged = arrived.join(kept.withColumn("known", F.lit(True)), KEYS, "left").fillna(False, ["known"])
        variants = kept.groupBy("trace_id", "span_id").agg(F.count(F.lit(1)).alias("retained"))
    per_span = merged.groupBy("trace_id", "span_id").agg(
        F.sum("copies").alias("received"),
        F.sum(F.when(F.col("known"), 0).otherwise(1)).alias("added"),
    )
    if variants is None:
        per_span = per_span.withColumn("retained", F.lit(0))
    else:
        per_span = per_span.join(variants, ["trace_id", "span_id"], "left").fillna(0, ["retained"])
    # The first variant of a span is no conflict; every further one is.
    conflicts = F.when(F.col("retained") > 0, F.col("added")).otherwise(F.greatest(F.col("added") - 1, F.lit(0)))
    return per_span.groupBy("trace_id").agg(
        F.sum("received").alias("received"),
        F.sum("added").alias("added"),
        F.sum(F.col("received") - F.col("added")).alias("duplicates"),
        F.sum(conflicts).alias("conflicts"),
    )


def duplicate_conflicts(spans: DataFrame) -> DataFrame:
    """Spans observed with differing evidence, and how many variants each has."""
    variants = with_obs_key(spans).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    return (
        variants.groupBy("trace_id", "span_id")
        .agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("observations"))
        .filter(F.col("variants") > 1)
    )
