"""Recovery checks and audits of workflows, approvals, sources and clients."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.numbers import round_exact
from spanwise.operators.correlate import topology_anomalies
from spanwise.operators.ordered import last_known
from spanwise.session import keep

RECOVERY_BUDGET_MS = 180
MAX_STALENESS_MS = 30_000
RATE_LIMIT = 300

# Legal transitions of the three workflows.
REMEDIATION_TRANSITIONS: Mapping[str, Sequence[str]] = {
    "DETECTED": ("DIAGNOSED", "REFUSED"),
    "DIAGNOSED": ("RECOMMENDED", "REFUSED"),
    "RECOMMENDED": ("RISK_ASSESSED", "REFUSED"),
    "RISK_ASSESSED": ("AWAITING_APPROVAL", "REFUSED"),
    "AWAITING_APPROVAL": ("APPROVED", "REFUSED"),
    "APPROVED": ("EXECUTING", "REFUSED"),
    "EXECUTING": ("VERIFYING", "ROLLING_BACK", "REFUSED"),
    "VERIFYING": ("COMPLETED", "ROLLING_BACK", "REFUSED"),
    "ROLLING_BACK": ("ROLLED_BACK", "REFUSED"),
}
RECOVERY_TRANSITIONS: Mapping[str, Sequence[str]] = {
    "INCIDENT_DETECTED": ("HYPOTHESIS_CREATED",),
    "HYPOTHESIS_CREATED": ("ACTION_RECOMMENDED",),
    "ACTION_RECOMMENDED": ("APPROVAL_REQUIRED",),
    "APPROVAL_REQUIRED": ("APPROVED", "REJECTED"),
    "APPROVED": ("EXECUTED",),
    "EXECUTED": ("OBSERVING",),
    "OBSERVING": ("RECOVERY_CANDIDATE", "VERIFICATION_FAILED"),
    "RECOVERY_CANDIDATE": ("VERIFIED", "ROLLED_BACK", "VERIFICATION_INCONCLUSIVE"),
}
CASE_TRANSITIONS: Mapping[str, Sequence[str]] = {
    "OPEN": ("INVESTIGATING", "BLOCKED"),
    "INVESTIGATING": ("BLOCKED",),
    "BLOCKED": ("INVESTIGATING",),
}
CASE_STATES = ("OPEN", "INVESTIGATING", "BLOCKED")

# The action catalogue (risk, distinct approvers, roles).
ACTIONS = {
    "connection-pool.restart": ("LOW", 1, ("sre", "platform-oncall")),
    "cache.flush": ("LOW", 1, ("sre", "platform-oncall", "app-engineer")),
    "readreplica.scale-out": ("MEDIUM", 2, ("sre-lead", "dba")),
    "readreplica.scale-in": ("MEDIUM", 2, ("sre-lead", "dba")),
    "db.terminate-session": ("HIGH", 2, ("dba-lead",)),
}

_BAD = ("FAILED", "DEGRADED")


def verify_recovery(pre: DataFrame, post: DataFrame, budget_ms: int = RECOVERY_BUDGET_MS) -> DataFrame:
    """Six signals per trace over envelopes before and after a fix; verified only if all hold."""
    c = F.col
    rank = F.struct("observed_ms", (-c("ingest_seq")).alias("s"))
    before = pre.groupBy("trace_id").agg(
        F.max_by(F.struct("component_name", "observed_ms"), rank).alias("worst"), F.sum("observed_ms").alias("pre_total_ms")
    )
    hops = post.groupBy("trace_id", "component_name").agg(
        F.min_by("observed_ms", "ingest_seq").alias("first_ms"),
        F.sum("observed_ms").alias("ms"),
        F.sum(c("status").isin(*_BAD).cast("bigint")).alias("bad"),
        F.sum(c("event_ms").isNull().cast("bigint")).alias("untimed"),
    )
    after = hops.groupBy("trace_id").agg(
        F.sum("ms").alias("post_total_ms"), F.sum("bad").alias("failed_hops"), F.sum("untimed").alias("untimed")
    )
    failed_before = pre.filter(c("status") == "FAILED").select("trace_id", "component_name").distinct()
    regressions = (
        hops.filter(c("bad") > 0)
        .join(failed_before, ["trace_id", "component_name"], "left_anti")
        .groupBy("trace_id")
        .agg(F.sum("bad").alias("new_regressions"))
    )
    inversions = topology_anomalies(post).groupBy("trace_id").agg(F.count(F.lit(1)).alias("inversions"))
    matching = hops.select("trace_id", "component_name", "first_ms")
    rows = (
        before.withColumn("component_name", c("worst.component_name"))
        .join(matching, ["trace_id", "component_name"], "left")
        .join(after, "trace_id", "left")
        .join(regressions, "trace_id", "left")
        .join(inversions, "trace_id", "left")
        .fillna(0, ["new_regressions", "inversions"])
    )
    signals = rows.withColumns(
        {
            "has_post": c("post_total_ms").isNotNull(),
            "deviation_removed": F.coalesce(c("first_ms") < c("worst.observed_ms") * 0.1, F.lit(True)),
            "topology_valid": c("inversions") == 0,
            "within_budget": F.coalesce(c("post_total_ms") <= budget_ms, F.lit(False)),
            "errors_cleared": c("failed_hops") == 0,
            "no_regression": c("new_regressions") == 0,
            "observed": c("untimed") == 0,
        }
    )
    verified = (
        c("deviation_removed") & c("topology_valid") & c("within_budget") & c("errors_cleared") & c("no_regression") & c("observed")
    )
    reduction = round_exact((c("pre_total_ms") - c("post_total_ms")) / c("pre_total_ms") * 100, 1)
    return signals.select(
        "trace_id", "pre_total_ms", "post_total_ms",
        *[
            F.when(c("has_post"), c(s)).alias(s)
            for s in ("deviation_removed", "topology_valid", "within_budget", "errors_cleared", "no_regression", "observed")
        ],
        reduction.alias("reduction_pct"),
        F.when(~c("has_post"), "INSUFFICIENT_EVIDENCE").when(verified, "RECOVERY_VERIFIED").otherwise("VERIFICATION_FAILED").alias("verdict"),
    )


def recovery_claims(recoveries: DataFrame) -> DataFrame:
    """Claim rows for ``diagnose.claims`` from recovery verdicts."""
    ok = F.col("verdict") == "RECOVERY_VERIFIED"
    return recoveries.filter(F.col("verdict") != "INSUFFICIENT_EVIDENCE").select(
        "trace_id",
        F.lit("RECOVERY_VERIFICATION").alias("type"),
        F.when(ok, F.concat(F.lit("recovery confirmed at "), F.col("post_total_ms").cast("string"), F.lit("ms")))
        .otherwise("recovery was not confirmed by all signals")
        .alias("statement"),
        F.when(ok, "VERIFIED").otherwise("FALSIFIED").alias("classification"),
        F.when(ok, 0.999).otherwise(0.0).alias("confidence"),
        F.when(ok, "VERIFIED").otherwise("FALSIFIED").alias("status"),
    )


def counterfactual_accuracy(predictions: DataFrame, post: DataFrame) -> DataFrame:
    """How many predicted effects of a fix were observed, per trace.

    ``predictions``: trace_id, target_component, metric. A prediction is checked on the first
    envelope whose component name contains the target or is contained in it. Nothing to check
    means UNKNOWN.
    """
    c = F.col
    names = post.groupBy("trace_id", "component_name").agg(
        F.min_by(F.struct("observed_ms", "status", "pool_utilization"), "ingest_seq").alias("e"),
        F.min("ingest_seq").alias("at"),
    )
    similar = c("component_name").contains(c("target_component")) | c("target_component").contains(c("component_name"))
    matched = (
        predictions.join(names, "trace_id")
        .filter(similar)
        .groupBy("trace_id", "target_component", "metric")
        .agg(F.min_by("e", "at").alias("e"))
    )
    holds = (
        F.when(c("metric") == "latencyMs", c("e.observed_ms") < 100)
        .when(c("metric") == "connectionPoolUtilization", c("e.pool_utilization") < 0.5)
        .otherwise(c("e.status") == "SUCCESS")
    )
    scored = matched.withColumn("holds", holds).groupBy("trace_id").agg(
        F.count("holds").alias("evaluated"), F.sum(c("holds").cast("bigint")).alias("confirmed")
    )
    total = predictions.groupBy("trace_id").agg(F.count(F.lit(1)).alias("predicted"))
    accuracy = F.when(c("evaluated") > 0, round_exact(c("confirmed") / c("evaluated"), 2))
    return (
        total.join(scored, "trace_id", "left")
        .fillna(0, ["evaluated", "confirmed"])
        .withColumn("accuracy", accuracy)
        .withColumn(
            "hypothesis",
            F.when(c("accuracy").isNull(), "UNKNOWN").when(c("accuracy") >= 0.8, "CONFIRMED").otherwise("NOT_CONFIRMED"),
        )
    )


def what_if(spans: DataFrame, component: str, target_ms: int, budget_ms: int = 200) -> DataFrame:
    """Total per trace if every hop of the component took ``target_ms``."""
    hit = F.lower("service").contains(component.lower())
    ms = F.coalesce("duration_ms", F.lit(0))
    return (
        spans.groupBy("trace_id")
        .agg(
            F.sum(ms).alias("original_ms"),
            F.sum(F.when(hit, F.lit(target_ms)).otherwise(ms)).alias("replayed_ms"),
            F.sum(F.coalesce(hit.cast("bigint"), F.lit(0))).alias("hops_changed"),
        )
        .withColumn("within_budget", F.col("replayed_ms") <= budget_ms)
    )


def transitions(table: Mapping[str, Sequence[str]]) -> Column:
    """The legal moves as an array of 'from>to' texts."""
    return F.array(*[F.lit(f"{a}>{b}") for a, bs in table.items() for b in bs])


def illegal_transitions(events: DataFrame, legal: Mapping[str, Sequence[str]]) -> DataFrame:
    """Moves outside the legal table, and breaks in the numbering of revisions.

    ``events``: entity_id, revision, to_state. The previous event is found by joining on
    revision - 1, so one busy entity does not have to fit into one task.
    """
    c = F.col
    states = events.groupBy("entity_id", "revision").agg(
        F.min("to_state").alias("to_state"), F.count(F.lit(1)).alias("copies")
    )
    previous = states.select("entity_id", (c("revision") + 1).alias("revision"), c("to_state").alias("from_state"))
    rows = states.join(previous, ["entity_id", "revision"], "left")
    move = F.concat_ws(">", "from_state", "to_state")
    problem = (
        F.when(c("copies") > 1, "REVISION_REPEATED")
        .when(c("from_state").isNull() & (c("revision") > 1), "REVISION_GAP")
        .when(
            c("from_state").isNotNull() & (c("from_state") != c("to_state")) & ~F.array_contains(transitions(legal), move),
            "ILLEGAL_TRANSITION",
        )
    )
    return rows.withColumn("problem", problem).filter(c("problem").isNotNull()).select(
        "entity_id", "revision", "from_state", "to_state", "problem"
    )


def action_catalogue(action_id: Column) -> Column:
    """Struct (risk, min_approvals, roles) of a known action, NULL otherwise."""
    result = None
    for name, (risk, needed, roles) in ACTIONS.items():
        entry = F.struct(
            F.lit(risk).alias("risk"), F.lit(needed).alias("min_approvals"), F.array(*[F.lit(r) for r in roles]).alias("roles")
        )
        result = F.when(action_id == name, entry) if result is None else result.when(action_id == name, entry)
    return result


def approval_checks(approvals: DataFrame, requests: DataFrame, approvers: DataFrame, now_ms: int) -> DataFrame:
    """Each approval with the first reason it is not valid (NULL when it is).

    ``approvals``: approval_id, request_id, incident_id, action_id, target, ticket_id, approver_id,
    nonce, expires_ms. ``requests``: request_id, incident_id, action_id, target. ``approvers``:
    approver_id, roles.
    """
    c = F.col
    wanted = requests.select(
        "request_id", c("incident_id").alias("r_incident"), c("action_id").alias("r_action"), c("target").alias("r_target")
    )
    first_use = approvals.filter(c("nonce").isNotNull()).groupBy("approver_id", "nonce").agg(
        F.min("approval_id").alias("nonce_first")
    )
    rows = (
        approvals.join(wanted, "request_id", "left")
        .join(approvers.select("approver_id", "roles"), "approver_id", "left")
        .join(first_use, ["approver_id", "nonce"], "left")
        .withColumn("action", action_catalogue(c("r_action")))
    )
    fields = ["incident_id", "action_id", "target", "ticket_id", "approver_id", "nonce", "expires_ms"]
    absent = F.lit(False)
    for f in fields:
        absent = absent | c(f).isNull() | (c(f).cast("string") == "")
    bound = (c("incident_id") == c("r_incident")) & (c("action_id") == c("r_action")) & (c("target") == c("r_target"))
    reason = (
        F.when(absent, "MISSING_FIELD")
        .when(~c("ticket_id").rlike("^[A-Z][A-Z0-9]*-[0-9]+$"), "BAD_TICKET")
        .when(c("roles").isNull(), "UNKNOWN_APPROVER")
        .when(~F.coalesce(bound, F.lit(False)), "BOUND_TO_ANOTHER_REQUEST")
        .when(c("expires_ms") <= now_ms, "EXPIRED")
        .when(c("nonce_first") != c("approval_id"), "NONCE_REUSED")
        .when(c("action").isNull(), "UNKNOWN_ACTION")
        .when(~F.arrays_overlap("roles", "action.roles"), "ROLE_NOT_HELD")
    )
    return rows.select("approval_id", "request_id", "approver_id", reason.alias("reason"))


def approval_quorum(approvals: DataFrame, requests: DataFrame, approvers: DataFrame, now_ms: int) -> DataFrame:
    """Per request: distinct valid approvers against the number its action needs."""
    c = F.col
    valid = approval_checks(approvals, requests, approvers, now_ms).filter(c("reason").isNull())
    counts = valid.select("request_id", "approver_id").distinct().groupBy("request_id").agg(
        F.count(F.lit(1)).alias("approvers")
    )
    action = action_catalogue(c("action_id"))
    return (
        requests.join(counts, "request_id", "left")
        .fillna(0, ["approvers"])
        .select(
            "request_id", "action_id", action["risk"].alias("risk"), action["min_approvals"].alias("required"), "approvers",
            F.when(action.isNull(), "UNKNOWN_ACTION")
            .when(c("approvers") >= action["min_approvals"], "APPROVED")
            .otherwise("PENDING")
            .alias("state"),
        )
    )


def case_audit(case_events: DataFrame) -> DataFrame:
    """Per case: contiguous revisions, unique operations, CREATE first, current state, verdict.

    ``case_events``: case_id, revision, operation_id, action, state, current_state.
    """
    c = F.col
    operations = case_events.groupBy("case_id", "operation_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = operations.groupBy("case_id").agg(F.max("n").alias("most"))
    rows = case_events.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.min("revision").alias("first_revision"),
        F.max("revision").alias("last_revision"),
        F.min_by("action", "revision").alias("first_action"),
        F.max_by("state", "revision").alias("last_state"),
        F.max_by("current_state", "revision").alias("current_state"),
        F.max((~F.coalesce(c("state").isin(*CASE_STATES), F.lit(False))).cast("int")).alias("unknown_state"),
    )
    gaps = case_events.select("case_id", "revision").distinct().groupBy("case_id").agg(F.count(F.lit(1)).alias("revisions"))
    joined = rows.join(repeated, "case_id").join(gaps, "case_id")
    contiguous = (
        (c("first_revision") == 1) & (c("last_revision") == c("events")) & (c("revisions") == c("events"))
    )
    problems = F.array_compact(
        F.array(
            F.when(~contiguous, "REVISIONS_NOT_CONTIGUOUS"),
            F.when(c("most") > 1, "OPERATION_REPEATED"),
            F.when(~F.coalesce(c("first_action") == "CREATE", F.lit(False)), "NOT_CREATED_FIRST"),
            F.when(~c("last_state").eqNullSafe(c("current_state")), "STATE_MISMATCH"),
            F.when(c("unknown_state") == 1, "UNKNOWN_STATE"),
        )
    )
    return joined.select("case_id", "events", "last_revision", "last_state", problems.alias("problems")).withColumn(
        "valid", F.size("problems") == 0
    )


def case_list(cases: DataFrame, limit: int = 25, offset: int = 0, trace_id: str | None = None) -> DataFrame:
    """A page of cases (case_id, updated_ms, trace_ids...), latest first."""
    rows = cases if trace_id is None else cases.filter(F.array_contains("trace_ids", trace_id))
    return rows.orderBy(F.desc("updated_ms"), "case_id").offset(offset).limit(limit)


def source_health(
    registry: DataFrame, collections: DataFrame, now_ms: int, max_stale_ms: int = MAX_STALENESS_MS
) -> DataFrame:
    """State of every registered source; one that never reported stays UNKNOWN.

    ``registry``: source, capabilities (map<string, boolean>). ``collections``: source,
    collected_ms, event_id, lag_ms, outcome.
    """
    c = F.col
    ok = c("outcome") == "OK"
    at = F.struct("collected_ms", "event_id")
    latest = collections.groupBy("source").agg(
        F.max_by("outcome", at).alias("last_outcome"),
        F.max_by("lag_ms", at).alias("lag_ms"),
        F.max(F.when(ok, c("collected_ms"))).alias("last_success_ms"),
        F.sum(ok.cast("bigint")).alias("collected"),
        F.sum((~ok).cast("bigint")).alias("failures"),
    )
    stale = F.lit(now_ms) - c("last_success_ms") > max_stale_ms
    state = (
        F.when(c("last_outcome").isNull(), "UNKNOWN")
        .when((c("last_outcome") == "OK") & stale, "STALE")
        .when(c("last_outcome") == "OK", "HEALTHY")
        .when(c("last_outcome") == "PERMISSION_DENIED", "PERMISSION_DENIED")
        .when(c("last_outcome").isin("DISCONNECTED", "SOCKET_TIMEOUT"), "DISCONNECTED")
        .otherwise("DEGRADED")
    )
    disabled = F.sort_array(F.map_keys(F.map_filter("capabilities", lambda _, on: ~on)))
    return registry.join(latest, "source", "left").select(
        "source",
        state.alias("state"),
        "last_success_ms",
        "lag_ms",
        F.coalesce("collected", F.lit(0)).alias("collected"),
        F.coalesce("failures", F.lit(0)).alias("failures"),
        F.when(state != "HEALTHY", disabled).otherwise(F.array().cast("array<string>")).alias("missing_visibility"),
    )


def observability_completeness(health: DataFrame) -> DataFrame:
    healthy = F.sum((F.col("state") == "HEALTHY").cast("bigint"))
    n = F.count(F.lit(1))
    return health.groupBy().agg(
        n.alias("sources"),
        F.coalesce(healthy, F.lit(0)).alias("healthy"),
        F.when(n > 0, round_exact(healthy / n, 2)).otherwise(0.0).alias("completeness"),
    )


def rate_windows(requests: DataFrame, window_ms: int = 60_000, block_windows: int = 16) -> DataFrame:
    """client, window_start_ms and requests of every fixed window, opened as a limiter opens them: by a request.

    A client's first request opens a window; the first one more than ``window_ms`` after a window's start opens the
    next. Each distinct request time points to the one that would open the next window after it; the starts are
    what the pointers reach from the first time. They are found by doubling the pointers, so a client with w windows takes
    log2(w) rounds of one join on (client, time), and no client is gathered anywhere: times are looked up in
    blocks of ``block_windows`` windows, which hold as many distinct milliseconds at most.

    Rows without a client or a time are left out; requests of one time belong to one window.
    """
    c = F.col
    block = F.floor(c("at_ms") / (window_ms * block_windows))
    times = requests.filter("client is not null and at_ms is not null").groupBy("client", "at_ms").agg(F.count(F.lit(1)).alias("n"))
    times = keep(times, "rate-times")
    # From the latest time down, the last request seen before a window's end is the first one after it.
    ends = times.select("client", (c("at_ms") + window_ms).alias("at_ms"), c("at_ms").alias("from_ms"), F.lit(None).cast("long").alias("seen"))
    both = ends.unionByName(times.select("client", "at_ms", F.lit(None).cast("long").alias("from_ms"), c("at_ms").alias("seen")))
    # A request at the very end of a window still belongs to it: ends come before requests of their time.
    pointers = last_known(both, ["client"], [-c("at_ms"), c("seen").isNotNull()], c("seen"), -block, "to_ms")
    jumps = keep(pointers.filter("from_ms is not null and to_ms is not null").select("client", "from_ms", "to_ms"), "rate-jumps")
    starts = keep(times.groupBy("client").agg(F.min("at_ms").alias("at_ms")), "rate-starts")
    while not jumps.isEmpty():
        reached = starts.join(jumps, (starts["client"] == jumps["client"]) & (starts["at_ms"] == jumps["from_ms"])).select(starts["client"], c("to_ms").alias("at_ms"))
        starts = keep(starts.unionByName(reached), "rate-starts")
        further = jumps.select("client", c("from_ms").alias("to_ms"), c("to_ms").alias("further_ms"))
        jumps = keep(jumps.join(further, ["client", "to_ms"]).select("client", "from_ms", c("further_ms").alias("to_ms")), "rate-jumps")
    marked = times.join(starts.withColumn("opens", c("at_ms")), ["client", "at_ms"], "left")
    placed = last_known(marked, ["client"], [c("at_ms")], c("opens"), block, "window_start_ms")
    return placed.groupBy("client", "window_start_ms").agg(F.sum("n").alias("requests"))


def rate_limit_audit(requests: DataFrame, limit: int = RATE_LIMIT, window_ms: int = 60_000) -> DataFrame:
    """Clients above the limit in one of their windows, which start with a request; the rest of the window is refused."""
    return rate_windows(requests, window_ms).filter(F.col("requests") > limit).withColumn("refused", F.col("requests") - limit)


def case_evidence_freshness(case_evidence: DataFrame, current: DataFrame) -> DataFrame:
    """Per case and trace: is the saved investigation revision still the current one?

    ``case_evidence``: case_id, trace_id, revision, captured_ms. ``current``: trace_id, revision.
    """
    saved = case_evidence.groupBy("case_id", "trace_id").agg(F.max_by("revision", "captured_ms").alias("saved_revision"))
    now = current.select("trace_id", F.col("revision").alias("current_revision"))
    return saved.join(now, "trace_id", "left").withColumn(
        "state",
        F.when(F.col("current_revision").isNull(), "CURRENT_EVIDENCE_UNAVAILABLE")
        .when(F.col("saved_revision") == F.col("current_revision"), "CURRENT")
        .otherwise("NEW_EVIDENCE_AVAILABLE"),
    )
