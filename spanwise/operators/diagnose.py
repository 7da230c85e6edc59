"""Scoring hypotheses over observed evidence only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.attributes import attr, attr_number, is_db_hop
from spanwise.functions.numbers import round_exact, round_half_up
from spanwise.operators.traces import hop_name
from spanwise.session import keep

HYPOTHESIS_BASE = 50

# Assumed shares of a degraded population, all estimates.
IMPACT_SHARES = {"failed": 0.42, "timed_out": 0.38, "pending": 0.15, "retried": 0.05, "duplicate_risk": 0.01}


def factor(name: str, weight: Column, measure: Column, supports: Column) -> Column:
    """Struct (id, weight, state); an unmeasured factor is UNKNOWN, never a contradiction."""
    state = F.when(measure.isNull(), "UNKNOWN").when(supports, "SUPPORTS").otherwise("CONTRADICTS")
    return F.struct(F.lit(name).alias("id"), weight.cast("int").alias("weight"), state.alias("state"))


def hypothesis_score(factors: Column) -> Column:
    """Struct (support, observed, expected, unknown) over an array of factors."""
    moved = F.aggregate(
        factors,
        F.lit(HYPOTHESIS_BASE),
        lambda acc, f: acc
        + F.when(f["state"] == "SUPPORTS", f["weight"]).when(f["state"] == "CONTRADICTS", -f["weight"]).otherwise(0),
    )
    unknown = F.filter(factors, lambda f: f["state"] == "UNKNOWN")
    return F.struct(
        F.greatest(F.lit(0), F.least(F.lit(100), moved)).alias("support"),
        (F.size(factors) - F.size(unknown)).alias("observed"),
        F.size(factors).alias("expected"),
        F.transform(unknown, lambda f: f["id"]).alias("unknown"),
    )


def db_lock_factors(
    latency_ratio: Column, pool_pct: Column, fingerprint: Column, cpu_pct: Column, low_cpu_contradicts: bool = True
) -> Column:
    """Factors of the lock-contention hypothesis. The direction of the CPU factor is a judgement."""
    high_cpu = cpu_pct >= 70
    return F.array(
        factor("latency", F.when(latency_ratio > 100, 20).otherwise(10), latency_ratio, latency_ratio > 10),
        factor("connectionPool", F.lit(15), pool_pct, pool_pct > 90),
        factor("queryFingerprint", F.lit(10), fingerprint, F.lit(True)),
        factor("cpu", F.lit(5), cpu_pct, high_cpu if low_cpu_contradicts else ~high_cpu),
    )


def db_lock_candidates(spans: DataFrame, verdicts: DataFrame, hop_baselines: DataFrame, slow_ms: int = 1000) -> DataFrame:
    """The first database hop of each trace, if slow, scored as a lock-contention candidate.

    ``verdicts`` gives trace_id, request_key and baseline_source; without a learned baseline the
    latency ratio is unknown.
    """
    a = F.col("attributes")
    db = spans.filter(is_db_hop(F.col("service"), F.col("name"), a)).select(
        "trace_id",
        "ingest_seq",
        "span_id",
        "duration_ms",
        hop_name().alias("hop"),
        attr_number(a, "db.lock_wait_ms").cast("bigint").alias("lock_wait_ms"),
        attr_number(a, "db.connection_pool.saturation_pct").alias("pool_pct"),
        attr(a, "db.query.fingerprint").alias("fingerprint"),
        attr_number(a, "db.cpu_utilization_pct").alias("cpu_pct"),
        attr(a, "db.holding_lock_pid").alias("holder_pid"),
        attr(a, "db.blocking_trace_id").alias("blocking_trace_id"),
    )
    kept = [c for c in db.columns if c not in ("trace_id", "ingest_seq")]
    first = db.groupBy("trace_id").agg(F.min_by(F.struct(*kept), "ingest_seq").alias("h")).select("trace_id", "h.*")
    slow = first.filter(F.col("duration_ms") > slow_ms)
    learned = verdicts.select(
        "trace_id", F.when(F.col("baseline_source") == "LEARNED", F.col("request_key")).alias("request_key")
    )
    base = hop_baselines.select(
        "request_key", "hop", F.col("p95").alias("hop_p95"), F.col("observations").alias("hop_observations")
    )
    ratio = F.when(F.col("hop_p95") > 0, round_half_up(F.col("duration_ms") / F.col("hop_p95")))
    scored = (
        slow.join(learned, "trace_id", "left")
        .join(base, ["request_key", "hop"], "left")
        .withColumn("latency_ratio", ratio)
        .withColumn(
            "factors",
            db_lock_factors(F.col("latency_ratio"), F.col("pool_pct"), F.nullif("fingerprint", F.lit("")), F.col("cpu_pct")),
        )
        .withColumn("score", hypothesis_score(F.col("factors")))
    )
    complete = F.col("lock_wait_ms").isNotNull() & F.col("pool_pct").isNotNull()
    blast = (
        F.when(F.col("blocking_trace_id").isNotNull(), F.concat(F.lit("behind request "), "blocking_trace_id"))
        .when(F.col("holder_pid").isNotNull(), F.concat(F.lit("behind lock holder "), "holder_pid"))
        .otherwise("UNKNOWN")
    )
    action = (
        F.when(F.col("blocking_trace_id").isNotNull(), "INVESTIGATE_BLOCKING_REQUEST")
        .when(F.col("holder_pid").isNotNull(), "INVESTIGATE_LOCK_HOLDER")
        .otherwise("INSUFFICIENT_EVIDENCE")
    )
    measured = F.transform(
        F.filter("factors", lambda f: f["state"] != "UNKNOWN"), lambda f: F.concat_ws(":", f["id"], f["state"])
    )
    return scored.select(
        "trace_id",
        "span_id",
        "duration_ms",
        "latency_ratio",
        F.col("score.support").alias("support"),
        F.col("score.observed").alias("factors_observed"),
        F.col("score.unknown").alias("factors_unknown"),
        measured.alias("factors_measured"),
        "lock_wait_ms",
        F.when(complete, "INFERRED").otherwise("INFERRED_FROM_PARTIAL_EVIDENCE").alias("provenance"),
        blast.alias("blast_radius"),
        action.alias("recommended_action"),
    )


def rca_generic(
    hops: DataFrame, baseline: DataFrame, changes: DataFrame | None = None, network: DataFrame | None = None,
    legacy: bool = False,
) -> DataFrame:
    """Generic root-cause ranking: the hop furthest above its service baseline, scored.

    ``baseline``: service, baseline_ms. ``changes``: trace_id, minutes_ago of the change to weigh.
    ``network``: trace_id, cpu_pct. A failed hop outranks a slow one unless ``legacy``, where a
    failure at normal latency is never a cause.
    """
    c = F.col
    base = (
        baseline.filter(c("service").isNotNull())
        .groupBy(F.lower("service").alias("service_key"))
        .agg(F.min("baseline_ms").alias("baseline_ms"))
    )
    observed = F.coalesce(c("duration_ms"), F.lit(0))
    ratio = observed / F.greatest(F.lit(1), F.coalesce(c("baseline_ms"), F.lit(20)))
    joined = hops.withColumn("service_key", F.lower("service")).join(base, "service_key", "left").withColumn("ratio", ratio)
    error = c("status") == "ERROR"
    deviates = (c("ratio") > 1.5) | (observed > 200) | error | (c("status") == "DEGRADED")
    eligible = deviates & (c("ratio") > 1) if legacy else deviates & ((c("ratio") > 1) | error)
    rank = F.struct((F.lit(0) if legacy else error.cast("int")).alias("e"), c("ratio").alias("r"), (-c("ingest_seq")).alias("s"))
    best = joined.groupBy("trace_id").agg(
        F.max_by(F.struct("service", "duration_ms", "ratio", "status"), F.when(eligible, rank)).alias("p"),
        F.max((c("status") == "UNREACHED").cast("int")).alias("unreached"),
    )
    if changes is None:
        best = best.withColumn("minutes_ago", F.lit(None).cast("bigint"))
    else:
        best = best.join(changes.select("trace_id", "minutes_ago"), "trace_id", "left")
    if network is None:
        best = best.withColumn("cpu_pct", F.lit(None).cast("double"))
    else:
        best = best.join(network.select("trace_id", "cpu_pct"), "trace_id", "left")
    r, ago = c("p.ratio"), c("minutes_ago")
    found = c("p").isNotNull() & ((r >= 1.3) | (F.lit(not legacy) & (c("p.status") == "ERROR")))
    evidence = F.least(F.lit(30), F.when(r > 100, 30).otherwise(round_half_up(r * 0.3)))
    temporal = F.when(ago < 30, 20).when(ago.isNotNull(), 10).otherwise(0)
    deviation = F.least(F.lit(25), F.when(r > 50, 25).otherwise(round_half_up(r * 0.5)))
    changed = F.when(ago.isNotNull(), 10).otherwise(0)
    contradiction = F.when((c("cpu_pct") > 0) & (c("cpu_pct") < 70), 1.3).otherwise(1.0)
    uncertainty = F.when(c("unreached") == 1, 4).otherwise(2)
    raw = 15 + evidence + temporal + 20 + deviation + changed - contradiction - uncertainty
    score = F.least(F.lit(99.4), F.greatest(F.lit(10.0), round_exact(raw, 1)))
    return best.select(
        "trace_id",
        F.when(found, "DEVIATION_DETECTED").otherwise("GOLDEN_PATH_MATCH").alias("status"),
        F.when(found, c("p.service")).alias("target"),
        F.when(found, c("p.duration_ms")).alias("duration_ms"),
        F.when(found, round_exact(r, 2)).alias("deviation_ratio"),
        F.when(found, score).otherwise(99.8).alias("confidence"),
        F.when(found, F.greatest(F.lit(10.0), round_exact(score - 22.2, 1))).alias("second_confidence"),
        F.when(found, "INFERRED").otherwise("OBSERVED").alias("provenance"),
    )


def confidence_envelope(rca: DataFrame) -> DataFrame:
    """What is known, thought, unknown, and what would change the conclusion."""
    c = F.col
    hit = c("status") == "DEVIATION_DETECTED"
    ratio = round_half_up(c("deviation_ratio")).cast("string")
    return rca.select(
        "trace_id",
        F.when(
            hit,
            F.concat("target", F.lit(" took "), c("duration_ms").cast("string"), F.lit("ms, "), ratio, F.lit("x its baseline")),
        ).otherwise("every hop is within its baseline").alias("what_we_know"),
        F.when(hit, F.concat(F.lit("contention or exhaustion at "), "target"))
        .otherwise("the request took its usual path")
        .alias("what_we_think"),
        F.when(hit, F.concat(F.lit("uninstrumented internals of "), "target"))
        .otherwise("anything below the resolution of spans")
        .alias("what_we_dont_know"),
        F.when(hit, F.concat(F.lit("the same latency on requests that bypass "), "target"))
        .otherwise("a hop above 1.5x its baseline")
        .alias("what_would_change_our_mind"),
    )


def primary_hop() -> tuple[Column, Column]:
    """The facts of an envelope as the primary of its trace's claim, and its rank (NULL where nothing deviates)."""
    c = F.col
    expected = F.when(c("expected_ms") != 0, c("expected_ms")).otherwise(20)
    ratio = c("observed_ms") / F.greatest(F.lit(0.1), expected)
    locked = F.coalesce(c("lock_wait_ms") > 0, F.lit(False))
    deviates = (ratio > 1.5) | c("status").isin("FAILED", "DEGRADED") | F.coalesce(c("lock_wait_ms") > 500, F.lit(False))
    shown = round_exact(ratio, 1)
    primary = F.struct(
        "component_name", shown.alias("ratio"), locked.alias("locked"), "cpu_pct",
        (c("db_pid").isNotNull() | c("sql_fingerprint").isNotNull()).alias("identified"),
    )
    rank = F.struct((shown + F.when(locked, 50).otherwise(0)).alias("r"), (-c("ingest_seq")).alias("s"))
    return primary, F.when(deviates, rank)


def claim_facts(envelopes: DataFrame) -> DataFrame:
    """Per trace: its envelopes (``n``) and the one that deviates most (``p``)."""
    return envelopes.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.max_by(*primary_hop()).alias("p"))


def causal_claims(envelopes: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """One root-cause claim per trace over its envelopes, with a reproducible confidence."""
    return claims_from(claim_facts(envelopes), changes)


def claims_from(per_trace: DataFrame, changes: DataFrame | None = None, kept: Sequence[str] = ()) -> DataFrame:
    """The claims over rows of ``claim_facts``; columns ``kept`` are passed through."""
    c = F.col
    if changes is None:
        per_trace = per_trace.withColumn("minutes_ago", F.lit(None).cast("bigint"))
    else:
        per_trace = per_trace.join(changes.select("trace_id", "minutes_ago"), "trace_id", "left")
    score = (
        0.98 * F.lit(0.2)
        + F.when(c("minutes_ago") <= 30, 0.96).otherwise(0.85) * 0.15
        + F.when(c("p.locked"), 0.99).otherwise(0.88) * 0.25
        + F.when(c("p.identified"), 0.99).otherwise(0.85) * 0.15
        + F.least(F.lit(1.0), c("p.ratio") / 50) * 0.15
        + F.when(c("n") >= 4, 0.98).otherwise(0.75) * 0.1
        - F.when(c("p.cpu_pct") < 70, 0.01).otherwise(0.0)
        - F.when(c("n") < 5, 0.15).otherwise(0.0)
    )
    some = c("p").isNotNull()
    statement = F.when(
        some,
        F.concat(
            "p.component_name",
            F.when(c("p.locked"), " lock contention and pool saturation").otherwise(" slowdown"),
            F.lit(" started the failure of this request"),
        ),
    ).otherwise("every hop stayed within its expected duration")
    return per_trace.select(
        "trace_id",
        F.lit("ROOT_CAUSE_CANDIDATE").alias("type"),
        statement.alias("statement"),
        F.when(some, "INFERRED").otherwise("OBSERVED").alias("classification"),
        F.when(some, round_exact(F.least(F.lit(0.999), F.greatest(F.lit(0.1), score)), 3)).otherwise(0.998).alias("confidence"),
        F.when(some, "OPEN").otherwise("VERIFIED").alias("status"),
        c("p.component_name").alias("primary_component"),
        c("p.ratio").alias("primary_ratio"),
        c("n").alias("envelope_count"),
        *kept,
    )


def why_not(envelopes: DataFrame, claims: DataFrame) -> DataFrame:
    """Why each other component is not the cause, from what was measured on it."""
    c = F.col
    primary = claims.filter(c("primary_component").isNotNull()).select("trace_id", "primary_component")
    expected = F.when(c("expected_ms") != 0, c("expected_ms")).otherwise(20)
    others = (
        envelopes.join(primary, "trace_id")
        .filter((c("component_name") != c("primary_component")) & (c("component_type") != c("primary_component")))
        .groupBy("trace_id", "component_name")
        .agg(
            F.max("observed_ms").alias("observed_ms"),
            F.max((c("observed_ms") / expected > 1.5).cast("int")).alias("slow"),
            F.max(c("status").isin("FAILED", "DEGRADED").cast("int")).alias("bad"),
        )
    )
    ms = F.concat(c("observed_ms").cast("string"), F.lit("ms"))
    return others.select(
        "trace_id",
        "component_name",
        F.when((c("slow") == 0) & (c("bad") == 0), F.concat(F.lit("within budget and successful at "), ms))
        .when(c("bad") == 0, F.concat(F.lit("slower than expected but successful at "), ms))
        .otherwise(F.concat(F.lit("deviated too, less than the primary, at "), ms))
        .alias("elimination_reason"),
        ((c("slow") == 0) & (c("bad") == 0)).alias("eliminated"),
    )


def first_deviation(hops: DataFrame, baseline: DataFrame, floor: float = 1.5) -> DataFrame:
    """The hop with the largest multiple of its expected duration above ``floor``, if any.

    The baseline is written once. Its size is then known when the plan is built: a small one reaches the hops where
    they are, instead of all hops of a service meeting it in one task.
    """
    c = F.col
    baseline = keep(baseline.select("service", "baseline_ms"), "service-baselines")
    multiple = c("duration_ms") / F.greatest(F.lit(0.1), F.coalesce(c("baseline_ms"), F.lit(20)))
    rank = F.struct(c("multiple").alias("m"), (-c("ingest_seq")).alias("s"))
    joined = hops.join(baseline, "service", "left").withColumn("multiple", multiple)
    picked = joined.groupBy("trace_id").agg(
        F.max_by(
            F.struct("service", "duration_ms", F.coalesce("baseline_ms", F.lit(20)).alias("expected_ms"), "multiple"),
            F.when(c("multiple") > floor, rank),
        ).alias("d")
    )
    return picked.select(
        "trace_id",
        c("d.service").alias("service"),
        c("d.duration_ms").alias("duration_ms"),
        c("d.expected_ms").cast("bigint").alias("expected_ms"),
        round_exact("d.multiple", 1).alias("multiple"),
    )


def business_impact(journeys: DataFrame, reconciliation: DataFrame | None = None) -> DataFrame:
    """Estimated exposure of degraded journeys; confirmed figures only from settled records.

    ``journeys``: journey_id, technical_status, affected_count, average_value. ``reconciliation``:
    journey_id, is_settled, confirmed_loss, net_exposure, reversed_count.
    """
    c = F.col
    degraded = F.coalesce(
        c("technical_status").isin("FAILED", "DEGRADED") | (c("technical_status").try_cast("int") >= 500), F.lit(False)
    )
    n = c("affected_count")

    def share(name: str) -> Column:
        return F.when(degraded, F.floor(n * F.lit(IMPACT_SHARES[name]))).otherwise(0)

    if reconciliation is None:
        rows = journeys.withColumns(
            {"is_settled": F.lit(False), "confirmed_loss": F.lit(None).cast("double"),
             "net_exposure": F.lit(None).cast("double"), "reversed_count": F.lit(None).cast("bigint")}
        )
    else:
        rows = journeys.join(reconciliation, "journey_id", "left")
    settled = F.coalesce(c("is_settled"), F.lit(False))
    at_risk = F.when(degraded, n * c("average_value")).otherwise(0)
    return rows.select(
        "journey_id",
        F.when(degraded, "UNHEALTHY").otherwise("HEALTHY").alias("technical_status"),
        n.alias("affected"),
        share("failed").cast("bigint").alias("failed"),
        share("timed_out").cast("bigint").alias("timed_out"),
        share("pending").cast("bigint").alias("pending"),
        F.when(degraded, F.floor(n * F.lit(IMPACT_SHARES["retried"]))).otherwise(n).cast("bigint").alias("retried"),
        share("duplicate_risk").cast("bigint").alias("duplicate_risk"),
        F.when(settled, F.coalesce("reversed_count", F.lit(0))).otherwise(0).alias("reversed"),
        at_risk.alias("estimated_at_risk"),
        F.when(settled, c("confirmed_loss")).otherwise(0).alias("confirmed_loss"),
        F.when(settled, c("net_exposure")).otherwise(at_risk).alias("reconciled_exposure"),
        F.when(settled, "AUTHORITATIVELY_RECONCILED").otherwise("ESTIMATED_PENDING_RECONCILIATION").alias("classification"),
        (degraded & (n > 10000)).alias("compliance_report_required"),
    )


def claims(df: DataFrame) -> DataFrame:
    """Claim rows with a content-derived id and three-decimal confidence.

    Input: trace_id, type, statement, classification, confidence, and optionally the evidence
    arrays. A claim without a statement is UNKNOWN and says what would settle it.
    """
    c = F.col
    unknown = c("statement").isNull()
    empty = F.array().cast("array<string>")

    def evidence(name: str) -> Column:
        return F.coalesce(c(name), empty) if name in df.columns else empty

    statement = F.coalesce("statement", F.lit("root cause is unknown: insufficient telemetry"))
    kind = F.coalesce("type", F.lit("ROOT_CAUSE_CANDIDATE"))
    return df.select(
        F.concat(F.lit("claim-"), F.sha2(F.concat_ws("|", c("trace_id").cast("string"), kind, statement), 256)).alias("claim_id"),
        "trace_id",
        kind.alias("type"),
        statement.alias("statement"),
        F.when(unknown, "UNKNOWN").otherwise(F.coalesce("classification", F.lit("INFERRED"))).alias("classification"),
        F.when(unknown, 0.0).otherwise(round_exact("confidence", 3)).alias("confidence"),
        evidence("supporting").alias("supporting"),
        evidence("contradicting").alias("contradicting"),
        F.when(unknown, F.array(F.lit("collect the missing telemetry"), F.lit("evaluate the trace again")))
        .otherwise(evidence("falsifiability"))
        .alias("falsifiability"),
        F.when(unknown, "INSUFFICIENT_EVIDENCE").otherwise(F.coalesce("status", F.lit("OPEN"))).alias("status"),
    )
