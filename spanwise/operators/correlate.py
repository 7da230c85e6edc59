"""Correlating evidence envelopes: duplicates, conflicts, clocks, causal order, identity, quality.

Envelope columns: trace_id, evidence_id, ingest_seq, component_type, component_name, event_type,
span_id, event_ms, observed_ms, expected_ms, lock_wait_ms, cpu_pct, status, identity keys,
source_system.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions.numbers import round_exact
from spanwise.operators.ordered import last_known, running_total

# Place of each tier on the request path; unknown tiers come last.
STAGE_PRECEDENCE = {
    "CLIENT-BROWSER": 1, "BROWSER": 1, "CLIENT": 1,
    "DNS-RESOLVER": 2, "DNS": 2,
    "PERIMETER-FIREWALL": 3, "FIREWALL": 3,
    "F5-BIG-IP": 4, "F5": 4, "LOAD_BALANCER": 4,
    "IBM-HTTP-SERVER": 5, "IHS": 5, "WEB_SERVER": 5,
    "WEBSPHERE-COREAPP": 6, "WEBSPHERE": 6, "APP_SERVER": 6,
    "IBM-MQ-SERIES": 7, "IBM-MQ": 7, "MESSAGE_BROKER": 7,
    "IBM-DB2-CLUSTER": 8, "DB2": 8, "DATABASE": 8,
    "EXTERNAL-PAYMENT-GATEWAY": 9, "STRIPE-GATEWAY": 9, "EXTERNAL_GATEWAY": 9,
    "RETURN-JOURNEY-EGRESS": 10, "RETURN-EGRESS": 10, "CLIENT_RETURN": 10,
}
UNKNOWN_PRECEDENCE = 50

# Tiers that must not be seen in the opposite order.
TOPOLOGY_ORDER = (("WEBSPHERE", "DB2"), ("LOAD_BALANCER", "WEBSPHERE"))
EXPECTED_PATH = (
    "CLIENT", "DNS", "FIREWALL", "LOAD_BALANCER", "WEB_SERVER", "WEBSPHERE", "MESSAGE_BROKER", "DB2",
    "EXTERNAL_GATEWAY", "CLIENT_RETURN",
)

# Identity keys by level, in order of preference, with the confidence of a match.
IDENTITY_LEVELS = (
    ("LEVEL_1_EXACT", 1.0, ("trace_id", "request_id", "correlation_id", "message_id")),
    ("LEVEL_2_PROTOCOL", 0.92, ("sql_fingerprint", "idempotency_key", "stream_id")),
    ("LEVEL_3_TOPOLOGY", 0.82, ("thread_id", "db_pid", "vip")),
)


def signature() -> Column:
    part = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("component_type", "event_type", "span_id", "observed_ms")]
    return F.concat_ws("-", *part)


def deduplicate_envelopes(envelopes: DataFrame) -> DataFrame:
    """Every envelope, with ``duplicate_of`` naming the first of its signature (NULL on the first)."""
    signed = envelopes.withColumn("signature", signature())
    first = signed.groupBy("trace_id", "signature").agg(
        F.min_by("evidence_id", "ingest_seq").alias("first_id")
    )
    return (
        signed.join(first, ["trace_id", "signature"])
        .withColumn("duplicate_of", F.when(F.col("first_id") != F.col("evidence_id"), F.col("first_id")))
        .drop("first_id", "signature")
    )


def unique_envelopes(envelopes: DataFrame) -> DataFrame:
    return deduplicate_envelopes(envelopes).filter(F.col("duplicate_of").isNull()).drop("duplicate_of")


def sources_disagree() -> Column:
    """Whether ``reports`` reports between ``min_ms`` and ``max_ms`` are too far apart."""
    apart = (F.col("max_ms") - F.col("min_ms") > 100) & (F.col("max_ms") / F.greatest(F.lit(1), F.col("min_ms")) > 2)
    return (F.col("reports") > 1) & apart


def source_conflicts(envelopes: DataFrame) -> DataFrame:
    """Component types whose sources disagree on latency. Both extremes are named, none dropped."""
    rank = F.struct("observed_ms", "ingest_seq")
    grouped = envelopes.groupBy("trace_id", "component_type").agg(
        F.count(F.lit(1)).alias("reports"),
        F.min("observed_ms").alias("min_ms"),
        F.max("observed_ms").alias("max_ms"),
        F.min_by("source_system", rank).alias("fastest_source"),
        F.max_by("source_system", rank).alias("slowest_source"),
    )
    return (
        grouped.filter(sources_disagree())
        .withColumns({"variance_ms": F.col("max_ms") - F.col("min_ms"), "conflict_type": F.lit("LATENCY_DISCREPANCY"),
                      "resolution": F.lit("PRESERVE_BOTH_SOURCES")})
    )


def conflict_sources(envelopes: DataFrame) -> DataFrame:
    """The reports behind each conflict, one row per report."""
    keys = ["trace_id", "component_type"]
    return envelopes.join(source_conflicts(envelopes).select(*keys), keys, "left_semi").select(
        *keys, "evidence_id", "source_system", "observed_ms"
    )


def normalize_clock(envelopes: DataFrame, offsets: DataFrame) -> DataFrame:
    """Subtract each component's clock offset (``component_name``, ``offset_ms``); raw time is kept."""
    offset = F.coalesce(F.col("offset_ms"), F.lit(0))
    return (
        envelopes.join(offsets.select("component_name", "offset_ms"), "component_name", "left")
        .withColumn("raw_event_ms", F.col("event_ms"))
        .withColumn("event_ms", F.col("event_ms") - offset)
        .withColumn("clock_offset_ms", offset)
        .drop("offset_ms")
    )


def stage_precedence(component_type: Column, component_name: Column | None = None) -> Column:
    name = F.lit(None).cast("string") if component_name is None else component_name
    tier = F.upper(F.coalesce(F.nullif(component_type, F.lit("")), name, F.lit("")))
    by_rank: dict[int, list[str]] = {}
    for label, rank in STAGE_PRECEDENCE.items():
        by_rank.setdefault(rank, []).append(label)
    result = None
    for rank, labels in by_rank.items():
        test = tier.isin(*labels)
        result = F.when(test, rank) if result is None else result.when(test, rank)
    return result.otherwise(UNKNOWN_PRECEDENCE)


def causal_order(envelopes: DataFrame) -> DataFrame:
    """Add ``precedence`` and ``position`` (from 1): by tier, then time, then arrival."""
    ranked = envelopes.withColumn("precedence", stage_precedence(F.col("component_type"), F.col("component_name")))
    order = [F.col("precedence"), F.col("event_ms"), F.col("ingest_seq")]
    hour = F.struct(F.col("precedence").alias("p"), F.floor(F.col("event_ms") / 3_600_000).alias("h"))
    return running_total(ranked, ["trace_id"], order, F.lit(1).cast("bigint"), hour, "position", inclusive=True)


def causality_violations(envelopes: DataFrame, tolerance_ms: int = 50) -> DataFrame:
    """Neighbours in causal order where the next one started clearly before the current one.

    Inside one tier the order is the time order, so only the last envelope of a tier and the first
    of the next tier can violate it: two summary rows per (trace, tier) are enough.
    """
    ranked = envelopes.withColumn("precedence", stage_precedence(F.col("component_type"), F.col("component_name")))
    at = F.struct("event_ms", "ingest_seq")
    hop = F.struct("component_name", "event_ms")
    tiers = ranked.groupBy("trace_id", "precedence").agg(
        F.min_by(hop, at).alias("first"), F.max_by(hop, at).alias("last")
    )
    following = F.lead("first").over(Window.partitionBy("trace_id").orderBy("precedence"))
    delta = F.col("next.event_ms") - F.col("last.event_ms")
    return (
        tiers.withColumn("next", following)
        .filter(delta < -tolerance_ms)
        .select(
            "trace_id",
            F.col("last.component_name").alias("source_hop"),
            F.col("next.component_name").alias("target_hop"),
            delta.alias("delta_ms"),
        )
    )


def topology_anomalies(envelopes: DataFrame, rules: Sequence[tuple[str, str]] = TOPOLOGY_ORDER) -> DataFrame:
    """TOPOLOGY_INVERSION rows: a tier first seen before the tier that must precede it."""
    types = sorted({t for rule in rules for t in rule})

    def first(t: str) -> list[Column]:
        seq = F.when(F.col("component_type") == t, F.col("ingest_seq"))
        return [F.min(seq).alias(f"seq_{t}"), F.min_by("component_name", seq).alias(f"name_{t}")]

    firsts = (
        envelopes.filter(F.col("component_type").isin(*types))
        .groupBy("trace_id")
        .agg(*[c for t in types for c in first(t)])
    )
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"seq_{after}") < F.col(f"seq_{before}"),
                    F.struct(
                        F.lit("TOPOLOGY_INVERSION").alias("anomaly"),
                        F.lit(after).alias("early_type"),
                        F.col(f"name_{after}").alias("early_name"),
                        F.lit(before).alias("expected_before"),
                    ),
                )
                for before, after in rules
            ]
        )
    )
    return firsts.select("trace_id", F.explode(found).alias("a")).select("trace_id", "a.*")


def match_identity(a: str, b: str, columns: Sequence[str]) -> Column:
    """Struct (matched, level, matched_key, matched_value, confidence) for structs ``a`` and ``b``.

    A component's name is no identity. ``columns`` are the identity keys present on both sides.
    """

    def outcome(matched: bool, level: str, key: Column, value: Column, confidence: float) -> Column:
        return F.struct(
            F.lit(matched).alias("matched"),
            F.lit(level).alias("level"),
            key.cast("string").alias("matched_key"),
            value.cast("string").alias("matched_value"),
            F.lit(confidence).alias("confidence"),
        )

    steps = []
    for level, confidence, keys in IDENTITY_LEVELS:
        for key in keys:
            if key in columns:
                left, right = F.col(f"{a}.{key}").cast("string"), F.col(f"{b}.{key}").cast("string")
                same = (left == right) & (left != "")
                steps.append(F.when(same, outcome(True, level, F.lit(key.upper()), left, confidence)))
    none = F.lit(None)
    return F.coalesce(*steps, outcome(False, "UNMATCHED", none, none, 0.0))


def identity_columns(df: DataFrame, ignore: Sequence[str] = ()) -> list[str]:
    return [k for _, _, keys in IDENTITY_LEVELS for k in keys if k in df.columns and k not in ignore]


def consecutive_matches(envelopes: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Identity of each envelope with the one that arrived before it in the same trace."""
    keys = identity_columns(envelopes, ignore)
    this = F.struct("evidence_id", *keys)
    block = F.floor(F.col("ingest_seq") / 1000)
    paired = last_known(
        envelopes.select("trace_id", "ingest_seq", this.alias("cur")),
        ["trace_id"], [F.col("ingest_seq")], F.col("cur"), block, "prev", inclusive=False,
    ).filter(F.col("prev").isNotNull())
    match = match_identity("prev", "cur", keys)
    return paired.select(
        "trace_id",
        F.col("prev.evidence_id").alias("evidence_a"),
        F.col("cur.evidence_id").alias("evidence_b"),
        match.alias("m"),
    ).select("trace_id", "evidence_a", "evidence_b", "m.*")


def identity_links(envelopes: DataFrame, ignore: Sequence[str] = ("trace_id",)) -> DataFrame:
    """Open-ended linking: each envelope to the earliest one that shares its strongest shared key.

    Rows sharing a key value are reduced to one representative first, so a key held by a third of
    all rows costs one row on that side and never produces pairs.
    """
    ladder = [
        (rank, level, confidence, key)
        for rank, (level, confidence, key) in enumerate(
            (level, confidence, key) for level, confidence, keys in IDENTITY_LEVELS for key in keys
        )
        if key in envelopes.columns and key not in ignore
    ]
    key_rows = F.array_compact(
        F.array(
            *[
                F.when(
                    F.length(F.col(key).cast("string")) > 0,
                    F.struct(
                        F.lit(rank).alias("rank"), F.lit(level).alias("level"), F.lit(confidence).alias("confidence"),
                        F.lit(key.upper()).alias("matched_key"), F.col(key).cast("string").alias("matched_value"),
                    ),
                )
                for rank, level, confidence, key in ladder
            ]
        )
    )
    keyed = envelopes.select("evidence_id", "event_ms", F.explode(key_rows).alias("k")).select(
        "evidence_id", "event_ms", "k.*"
    )
    heads = keyed.groupBy("matched_key", "matched_value").agg(
        F.min_by("evidence_id", F.struct("event_ms", "evidence_id")).alias("linked_to")
    )
    linked = keyed.join(heads, ["matched_key", "matched_value"]).filter(F.col("linked_to") != F.col("evidence_id"))
    best = linked.groupBy("evidence_id").agg(
        F.min_by(F.struct("linked_to", "level", "matched_key", "matched_value", "confidence"), "rank").alias("b")
    )
    return best.select("evidence_id", "b.*")


def rejected_candidates(matches: DataFrame) -> DataFrame:
    """Pairs that were considered and not linked, so that a missing link can be explained."""
    return matches.filter(~F.col("matched")).select(
        F.col("trace_id").alias("target_trace_id"),
        F.col("evidence_a").alias("target_evidence_id"),
        F.col("evidence_b").alias("candidate_evidence_id"),
        F.lit("NO_SHARED_IDENTITY").alias("reason"),
        F.lit("all identity levels").alias("divergent_factor"),
    )


def stitch_async(
    producers: DataFrame, consumers: DataFrame, ids: Sequence[str] = ("message_id", "correlation_id"),
    delayed_ms: int = 2000, scope: str | None = None,
) -> DataFrame:
    """Producer to consumer over message boundaries: one row per consumer, and one per producer nobody consumed.

    Both sides have ``evidence_id``, ``event_ms`` and id columns, tried in the order of ``ids``. A consumer
    meets the earliest producer that holds its id value (``producer_count`` says how many do), so fan-out
    loses nobody and no pairs are built. A producer is unmatched only if none of its ids has a consumer.
    With ``scope`` (a column of both, a trace say), a consumer without a match is aligned by timing with the
    earliest unmatched producer of its scope that carries no first id, and says so. Without a counterpart
    the transit is unknown, never a default.
    """
    c = F.col
    ids = [i for i in ids if i in producers.columns and i in consumers.columns]
    order = F.struct("event_ms", "evidence_id")

    def key(i: str) -> Column:
        # A missing id gets a key of its own, so that rows without one do not meet in one task.
        return F.coalesce(c(i).cast("string"), F.concat(F.lit("\x00"), c("evidence_id").cast("string")))

    rows = consumers
    matched = None
    for n, i in enumerate(ids):
        held = producers.filter(c(i).isNotNull()).groupBy(c(i).cast("string").alias("_key")).agg(
            F.min_by(F.struct(c("evidence_id").alias("producer"), "event_ms"), order).alias(f"_p{n}"), F.count(F.lit(1)).alias(f"_n{n}")
        )
        rows = rows.withColumn("_key", key(i)).join(held, "_key", "left").drop("_key")
        taken = consumers.filter(c(i).isNotNull()).select(c(i).cast("string").alias("_key")).distinct().withColumn(f"_t{n}", F.lit(True))
        matched = (producers if matched is None else matched).withColumn("_key", key(i)).join(taken, "_key", "left").drop("_key")

    def first(column: Callable[[int, str], Column]) -> Column:
        out = F.lit(None)
        for n, i in reversed(list(enumerate(ids))):
            out = F.when(c(f"_p{n}").isNotNull(), column(n, i)).otherwise(out)
        return out

    met = rows.select(
        first(lambda n, i: F.lit(i)).cast("string").alias("id_type"),
        first(lambda n, i: c(i).cast("string")).alias("id_value"),
        first(lambda n, i: c(f"_p{n}.producer")).alias("producer"),
        c("evidence_id").alias("consumer"),
        F.coalesce(first(lambda n, i: c(f"_n{n}")), F.lit(0)).cast("bigint").alias("producer_count"),
        first(lambda n, i: c(f"_p{n}.event_ms")).cast("bigint").alias("producer_ms"),
        c("event_ms").alias("consumer_ms"),
        *([c(scope).alias("_scope")] if scope else []),
    )
    loose = matched.filter(~F.greatest(F.lit(False), *[F.coalesce(f"_t{n}", F.lit(False)) for n in range(len(ids))]))
    level = F.when(c("producer").isNotNull(), "EXACT_MESSAGE_CORRELATION").otherwise("UNMATCHED")
    met = met.withColumn("correlation_level", level)
    used = None
    if scope:
        plain = loose.filter(c(scope).isNotNull() & (c(ids[0]).isNull() if ids else F.lit(True)))
        earliest = plain.groupBy(c(scope).alias("_scope")).agg(F.min_by(F.struct("evidence_id", "event_ms"), order).alias("_e"))
        met = met.withColumn("_key", F.when(c("producer").isNull(), c("_scope").cast("string")))
        met = met.withColumn("_key", F.coalesce("_key", F.concat(F.lit("\x00"), c("consumer").cast("string"))))
        met = met.join(earliest.select(c("_scope").cast("string").alias("_key"), "_e"), "_key", "left")
        aligned = c("_e").isNotNull() & c("consumer_ms").isNotNull()
        met = met.withColumns({
            "correlation_level": F.when(aligned, "PROBABILISTIC_TIMING_ALIGNMENT").otherwise(c("correlation_level")),
            "producer": F.when(aligned, c("_e.evidence_id")).otherwise(c("producer")),
            "producer_ms": F.when(aligned, c("_e.event_ms")).otherwise(c("producer_ms")),
            "producer_count": F.when(aligned, F.lit(1)).otherwise(c("producer_count")).cast("bigint"),
        })
        used = met.filter(c("correlation_level") == "PROBABILISTIC_TIMING_ALIGNMENT").select(c("producer").alias("evidence_id")).distinct()
    if used is not None:
        loose = loose.join(used, "evidence_id", "left_anti")
    alone = loose.select(
        F.lit(None).cast("string").alias("id_type"), F.lit(None).cast("string").alias("id_value"), c("evidence_id").alias("producer"),
        F.lit(None).cast(dict(consumers.dtypes)["evidence_id"]).alias("consumer"), F.lit(1).cast("bigint").alias("producer_count"),
        F.lit(None).cast("bigint").alias("producer_ms"), F.lit(None).cast("bigint").alias("consumer_ms"), F.lit("UNMATCHED").alias("correlation_level"),
    )
    both = met.select(alone.columns).unionByName(alone)
    transit = c("consumer_ms") - c("producer_ms")
    return both.select(
        "id_type", "id_value", "producer", "consumer", "producer_count", (c("correlation_level") != "UNMATCHED").alias("correlated"), "correlation_level",
        transit.alias("transit_ms"), (transit > delayed_ms).alias("is_delayed"),
        F.when(c("correlation_level") == "EXACT_MESSAGE_CORRELATION", 1.0).when(c("correlation_level") == "UNMATCHED", 0.0).otherwise(0.85).alias("confidence"),
    )


def stitch_pairs(pairs: DataFrame, delayed_ms: int = 2000) -> DataFrame:
    """One producer/consumer candidate pair per row (``p_*`` and ``c_*`` columns), as in one trace.

    Equal ids are exact; otherwise, if the producer carries no message id, the pair is aligned by
    timing only and says so.
    """
    c = F.col
    exact = F.coalesce(c("p_message_id") == c("c_message_id"), F.lit(False)) | F.coalesce(
        c("p_correlation_id") == c("c_correlation_id"), F.lit(False)
    )
    transit = c("c_event_ms") - c("p_event_ms")
    return pairs.select(
        *[k for k in pairs.columns if not k.startswith(("p_", "c_"))],
        (exact | (c("p_message_id").isNull() & c("c_event_ms").isNotNull())).alias("correlated"),
        F.when(exact, "EXACT_MESSAGE_CORRELATION").otherwise("PROBABILISTIC_TIMING_ALIGNMENT").alias("correlation_level"),
        transit.alias("transit_ms"),
        (transit > delayed_ms).alias("is_delayed"),
        F.when(exact, 1.0).otherwise(0.85).alias("confidence"),
    )


def correlation_quality(df: DataFrame, expected_hops: int = 10) -> DataFrame:
    """Quality of the reconstruction of each trace.

    Needs ``envelope_count``, ``has_conflicts``, ``is_consistent``, ``identity_level`` and
    ``causal_confidence``; other columns are passed through.
    """
    c = F.col
    completeness = F.least(F.lit(1.0), c("envelope_count") / max(1, expected_hops))
    identity = (
        F.when(c("identity_level") == "LEVEL_1_EXACT", 1.0)
        .when(c("identity_level") == "LEVEL_2_PROTOCOL", 0.85)
        .when(c("identity_level") == "LEVEL_3_TOPOLOGY", 0.7)
        .otherwise(0.5)
    )
    truth = (
        F.when(completeness < 0.3, "INSUFFICIENT_EVIDENCE")
        .when(c("has_conflicts"), "CONFLICTED")
        .when((completeness >= 0.8) & (identity >= 0.9) & (c("causal_confidence") >= 0.8), "VERIFIED")
        .when((completeness >= 0.5) & (c("causal_confidence") >= 0.7), "STRONGLY_SUPPORTED")
        .otherwise("PARTIALLY_SUPPORTED")
    )
    return df.withColumns(
        {
            "evidence_completeness": round_exact(completeness, 2),
            "identity_integrity": identity,
            "temporal_integrity": F.when(c("is_consistent"), 0.98).otherwise(0.60),
            "source_agreement": F.when(c("has_conflicts"), 0.65).otherwise(0.98),
            "truth_status": truth,
        }
    )


EXPLANATIONS: Mapping[str, str] = {
    "LEVEL_1_EXACT": "Joined on trace id %s.",
    "LEVEL_2_PROTOCOL": "Joined on protocol keys where %s has no trace id.",
    "LEVEL_3_TOPOLOGY": "Joined on host or process for %s.",
}


def explain_correlation(df: DataFrame) -> DataFrame:
    """A sentence and a status per row from ``method``, ``confidence`` and ``trace_id``."""
    text = None
    for method, sentence in EXPLANATIONS.items():
        made = F.format_string(sentence, F.col("trace_id").cast("string"))
        test = F.col("method") == method
        text = F.when(test, made) if text is None else text.when(test, made)
    other = F.format_string("No identity level covers all of %s.", F.col("trace_id").cast("string"))
    return df.withColumns(
        {
            "correlation_status": F.when(F.col("confidence") >= 0.8, "STRONGLY_SUPPORTED").otherwise(
                "PARTIALLY_SUPPORTED"
            ),
            "explanation": text.otherwise(other),
        }
    )
