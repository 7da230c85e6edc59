"""Investigations, recovery checks, audits, hash chains and shared money."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwise.operators import audit, drift, investigate, ledger, traces
from spanwise.plans.catalog_correlation import _topology
from spanwise.plans.catalog_drift import _STATE, BUILDS, _builds
from spanwise.plans.catalog_requests import EDGES, UNCHECKED
from spanwise.plans.fixtures import derive, duck_with, spans, stored_spans, view
from spanwise.plans.registry import query
from spanwise.session import keep

# --- investigations ---------------------------------------------------------------------------


def _reported(spark, sf):
    """Spans where some carry a second, possibly different, status attribute."""
    value = F.struct(
        F.lit(None).cast("string").alias("stringValue"), F.lit("200").alias("intValue"),
        F.lit(None).cast("double").alias("doubleValue"), F.lit(None).cast("boolean").alias("boolValue"),
    )
    second = F.array(F.struct(F.lit("http.status_code").alias("key"), value.alias("value")))
    frame = spans(spark, sf)
    return frame.withColumn(
        "attributes", F.when(F.col("trace_id").endswith("e"), F.concat("attributes", second)).otherwise(F.col("attributes"))
    )


INVESTIGATION = {
    "ids": "select trace_id, span_id from spans",
    "rep": """select s.*, s.parent_span_id is not null and i.span_id is null as ext,
        case when s.trace_id like '%e' then case when http_status is null or http_status = 200 then 200 end else http_status end as hv,
        s.trace_id like '%e' and coalesce(http_status <> 200, false) as hc,
        case when start_ns is not null and end_ns >= start_ns then (end_ns - start_ns) / 1e6 end as own_ms
      from spans s left join ids i on i.trace_id = s.trace_id and i.span_id = s.parent_span_id""",
    "tree": """select trace_id, trace_id = repeat('0', 32) as bad_id, count(*) filter (where parent_span_id is null) as roots,
        bool_or(ext) as missing, trace_id <> repeat('0', 32) and count(*) filter (where parent_span_id is null) = 1 and not bool_or(ext)
        as intact from rep group by 1""",
    "outcomes": """select t.trace_id, case when r.span_id is null or clash then 'UNKNOWN' when hv >= 500 then 'HTTP_SERVER_ERROR'
        when hv >= 400 then 'HTTP_CLIENT_ERROR' when hv is not null then 'HTTP_RESPONSE_OBSERVED' when code = 2 then 'SPAN_ERROR_REPORTED'
        when code = 1 then 'SPAN_OK_REPORTED' else 'UNKNOWN' end as outcome, coalesce(clash, false) as outcome_conflict,
        hv as http_status, code as otel_status_code, r.span_id as root_span_id, r.service, r.name as operation, own_ms as root_ms
      from tree t left join (select *, otel_status_code as code, hc or coalesce((otel_status_code = 2 and hv < 400)
          or (otel_status_code = 1 and hv >= 400), false) as clash from rep where parent_span_id is null) r
        on r.trace_id = t.trace_id and t.intact""",
    "signals": """select trace_id, span_id, service, name as operation, case when otel_status_code = 2 then 'SPAN_ERROR_REPORTED'
        else 'HTTP_ERROR_RESPONSE' end as code, hv as http_status, 'NONE' as causal_claim from rep
        where otel_status_code = 2 or hv >= 400""",
    "edges": EDGES,
    "unchecked": UNCHECKED,
    "builds": BUILDS,
    "gaps": f"""
      select trace_id, 'TRACE_IDENTITY' as code, '' as span_ids, 0 as reference_count from tree where not intact
      union all select trace_id, 'TIMING', array_to_string((list_sort(list(span_id)))[1:20], ','), count(*) from rep where own_ms is null group by 1
      union all select trace_id, 'OUTCOME', coalesce(root_span_id, ''), (root_span_id is not null)::int from outcomes where outcome = 'UNKNOWN'
      union all select trace_id, 'BUSINESS', '', 0 from tree
      union all select trace_id, 'PEER', array_to_string((list_sort(list(span_id)))[1:20], ','), count(*) from unchecked group by 1
      union all select distinct s.trace_id, 'DEPLOYMENT', '', 0 from spans s join builds b on b.service = s.service
        where {_STATE.format(a='b', s='s')} is not null
      union all select trace_id, 'COMPATIBILITY', '', 0 from tree""",
    "steps": """select trace_id, row_number() over (partition by trace_id order by r) as step_order, code from (
        select distinct trace_id, code, list_position(['SIGNAL', 'LIMIT', 'TRACE_IDENTITY', 'TIMING', 'OUTCOME', 'PEER', 'EXPECTATIONS',
          'DEPLOYMENT', 'COMPATIBILITY', 'BUSINESS'], code) as r
        from (select trace_id, code from gaps union all select trace_id, 'SIGNAL' from signals))""",
}


def _investigation(spark, sf):
    frame = _reported(spark, sf)
    unique = investigate.base_spans(frame)
    # Statuses are read from the attributes of roots and signals only; what every span is looked at for is written once.
    every = keep(unique.select("trace_id", "span_id", "parent_span_id", "own_ms", "exact_copies", "conflicting"), "unique-spans")
    tree = keep(traces.tree_of(every), "trees")
    outcomes = investigate.root_outcome(unique, tree)
    gaps = investigate.evidence_gaps(every, tree, outcomes, **_evidence(spark, sf, frame))
    return tree, unique, outcomes, gaps


def _evidence(spark, sf, frame):
    return {
        # Counted and named: found once.
        "unchecked": keep(traces.unchecked_edges(frame), "unchecked"),
        "deployments": drift.deployment_evidence(frame, _builds(spark, sf)),
    }


@query(
    "root_outcome",
    duck_with("spans", **INVESTIGATION)
    + """select trace_id, outcome, case when outcome = 'UNKNOWN' then 'UNKNOWN' else 'OBSERVED' end as outcome_provenance,
      outcome_conflict, http_status, otel_status_code, root_span_id, service, operation, root_ms,
      case when root_ms is null then 'UNKNOWN' else 'OBSERVED' end as timing_provenance from outcomes""",
)
def _(spark, sf):
    unique = keep(investigate.base_spans(_reported(spark, sf)), "unique-spans")
    return investigate.root_outcome(unique, traces.tree_of(unique))


@query("error_signals", duck_with("spans", **INVESTIGATION) + "select * from signals")
def _(spark, sf):
    return investigate.error_signals(investigate.base_spans(_reported(spark, sf)))


@query(
    "evidence_gaps",
    duck_with("spans", **INVESTIGATION)
    + "select *, case when code in ('LIMIT', 'BUSINESS') then 'CAPABILITY' else 'DATA' end as kind from gaps",
)
def _(spark, sf):
    return _investigation(spark, sf)[3].withColumn("span_ids", F.array_join("span_ids", ","))


@query("next_steps", duck_with("spans", **INVESTIGATION) + "select trace_id, step_order, code from steps")
def _(spark, sf):
    _, unique, _, gaps = _investigation(spark, sf)
    return investigate.next_steps(gaps, investigate.error_signals(unique)).select("trace_id", "step_order", "code")


_REPORT = """, g as (select trace_id, string_agg(code, ',' order by step_order) filter (where code <> 'SIGNAL') as gaps,
    count(*) filter (where code <> 'SIGNAL') as gap_count from steps group by 1),
  n as (select trace_id, count(*) as n from spans group by 1),
  s as (select trace_id, count(*) as signals from signals group by 1),
  report as (select t.trace_id, case when signals > 0 then 'ERROR_OBSERVED' else 'EVIDENCE_NEEDED' end as triage,
    case when intact then 'OBSERVED_TREE' else 'UNKNOWN' end as shape, o.service, o.operation, o.outcome, o.http_status, o.root_ms,
    coalesce(signals, 0) as signals, g.gap_count, g.gaps, n.n as observations
  from tree t join outcomes o using (trace_id) left join s using (trace_id) left join g using (trace_id) left join n using (trace_id))
"""
_REPORT_COLUMNS = "trace_id triage shape service operation outcome http_status root_ms signals gap_count gaps observations".split()


@query("investigations", duck_with("spans", **INVESTIGATION) + _REPORT + "select * from report")
def _(spark, sf):
    frame = _reported(spark, sf)
    report = investigate.investigations(frame, **_evidence(spark, sf, frame))
    return report.withColumn("gaps", F.array_join("gaps", ",")).select(*_REPORT_COLUMNS)


@query(
    "worklist_page",
    duck_with("spans", **INVESTIGATION)
    + _REPORT
    + "select trace_id, triage, outcome, signals, observations from report order by trace_id limit 25 offset 50",
)
def _(spark, sf):
    page = investigate.worklist_page(_reported(spark, sf), limit=25, offset=50)
    return page.select("trace_id", "triage", "outcome", "signals", "observations")


@query(
    "worklist_total",
    duck_with("spans")
    + "select count(distinct trace_id) as total, case when count(distinct trace_id) > 75 then 75 end as next_offset from spans",
)
def _(spark, sf):
    return investigate.worklist(stored_spans(spark, sf), limit=25, offset=50)[1]


CASE_EVIDENCE = """select concat('case-', cast(o_custkey % 100 as varchar(10))) as case_id, lpad(lower(hex(o_orderkey)), 32, '0') as trace_id,
  o_orderkey % 2 as stale, cast(o_orderkey as bigint) as captured_ms from orders"""


@query(
    "case_evidence_freshness",
    duck_with("spans", saved=CASE_EVIDENCE)
    + """select case_id, trace_id, case when trace_id not in (select trace_id from spans) then 'CURRENT_EVIDENCE_UNAVAILABLE'
      when stale = 0 then 'CURRENT' else 'NEW_EVIDENCE_AVAILABLE' end as state from saved""",
)
def _(spark, sf):
    current = investigate.revisions(stored_spans(spark, sf))
    saved = derive(spark, sf, CASE_EVIDENCE).join(current.select("trace_id", "revision"), "trace_id", "left")
    saved = saved.withColumn("revision", F.when(F.col("stale") == 0, F.col("revision")).otherwise("earlier"))
    return audit.case_evidence_freshness(saved, current).select("case_id", "trace_id", "state")


# --- recovery ---------------------------------------------------------------------------------

POST = """select e.trace_id, e.component_name, e.component_type, e.ingest_seq, e.evidence_id, e.event_ms,
  case when o_orderstatus = 'O' then e.observed_ms else cast(floor(e.observed_ms / 20) as bigint) end as observed_ms,
  case when o_orderstatus = 'O' or e.component_name = 'node-3' then e.status else 'SUCCESS' end as status,
  cast(coalesce(e.db_pid, 9) as double) / 10 as pool_utilization
from envelopes e join orders on o_orderkey = e.trace_id where o_orderpriority <> '5-LOW'"""


def _post(spark, sf):
    view(spark, sf, "envelopes").createOrReplaceTempView("envelopes")
    return derive(spark, sf, POST)


@query(
    "verify_recovery",
    duck_with("envelopes", post=POST, inv=_topology("post"))
    + """, w as (select trace_id, (list(component_name order by observed_ms desc, ingest_seq))[1] as name,
        max(observed_ms) as ms, sum(observed_ms)::bigint as pre from envelopes group by 1),
      a as (select trace_id, sum(observed_ms)::bigint as post, count(*) filter (where status <> 'SUCCESS') as bad,
        count(*) filter (where status <> 'SUCCESS' and not exists (select 1 from envelopes e where e.trace_id = post.trace_id
          and e.component_name = post.component_name and e.status = 'FAILED')) as fresh from post group by 1),
      m as (select trace_id, component_name, (list(observed_ms order by ingest_seq))[1] as ms from post group by 1, 2),
      s as (select w.trace_id, w.pre as pre_total_ms, a.post as post_total_ms, a.trace_id is not null as has,
        coalesce(m.ms < w.ms * 0.1, true) as deviation_removed, not exists (select 1 from inv where inv.trace_id = w.trace_id) as topology_valid,
        a.post <= 180 as within_budget, a.bad = 0 as errors_cleared, a.fresh = 0 as no_regression
        from w left join a using (trace_id) left join m on m.trace_id = w.trace_id and m.component_name = w.name)
    select trace_id, pre_total_ms, post_total_ms, case when has then deviation_removed end as deviation_removed,
      case when has then topology_valid end as topology_valid, within_budget, errors_cleared, no_regression,
      case when has then true end as observed,
      round(cast((pre_total_ms - post_total_ms) / pre_total_ms * 100 as decimal(28,10)), 1) as reduction_pct,
      case when not has then 'INSUFFICIENT_EVIDENCE' when deviation_removed and topology_valid and within_budget and errors_cleared
        and no_regression then 'RECOVERY_VERIFIED' else 'VERIFICATION_FAILED' end as verdict from s""",
)
def _(spark, sf):
    post = _post(spark, sf)
    return audit.verify_recovery(view(spark, sf, "envelopes"), post)


PREDICTIONS = """select distinct trace_id, 'node-1' as target_component, 'latencyMs' as metric from envelopes
union all select distinct trace_id, 'node-7', 'connectionPoolUtilization' from envelopes
union all select distinct trace_id, 'node-3', 'timeoutRate' from envelopes"""


@query(
    "counterfactual_accuracy",
    duck_with("envelopes", post=POST, predictions=PREDICTIONS)
    + """, m as (select p.trace_id, p.metric, (list({'ms': observed_ms, 'st': status, 'pu': pool_utilization} order by ingest_seq))[1] as e
        from predictions p join post on post.trace_id = p.trace_id and (contains(component_name, target_component)
          or contains(target_component, component_name)) group by p.trace_id, p.target_component, p.metric),
      s as (select trace_id, count(*) as evaluated, count(*) filter (where case metric when 'latencyMs' then e.ms < 100
        when 'connectionPoolUtilization' then e.pu < 0.5 else e.st = 'SUCCESS' end) as confirmed from m group by 1)
    select p.trace_id, 3 as predicted, coalesce(evaluated, 0) as evaluated, coalesce(confirmed, 0) as confirmed,
      case when evaluated > 0 then round(cast(confirmed / evaluated as decimal(28,10)), 2) end as accuracy,
      case when evaluated is null then 'UNKNOWN' when round(confirmed / evaluated, 2) >= 0.8 then 'CONFIRMED' else 'NOT_CONFIRMED' end as hypothesis
    from (select distinct trace_id from predictions) p left join s using (trace_id)""",
)
def _(spark, sf):
    post = _post(spark, sf)
    return audit.counterfactual_accuracy(spark.sql(PREDICTIONS), post)


@query(
    "what_if",
    duck_with("spans")
    + """select trace_id, sum(duration_ms)::bigint as original_ms, sum(case when service = 'svc-2' then 18 else duration_ms end)::bigint
      as replayed_ms, sum((service = 'svc-2')::int)::bigint as hops_changed,
      sum(case when service = 'svc-2' then 18 else duration_ms end) <= 200 as within_budget from spans group by 1""",
)
def _(spark, sf):
    return audit.what_if(stored_spans(spark, sf), "SVC-2", 18)


# --- workflows --------------------------------------------------------------------------------

_LEGAL = {"O": ("F", "P"), "P": ("F",)}
EVENTS_WITH_GAPS = """select entity_id, to_state, revision + case when entity_id % 5 = 0 and revision > 3 then 1 else 0 end as revision,
  operation_id from state_events"""


@query(
    "illegal_transitions",
    duck_with("state_events", ev=EVENTS_WITH_GAPS)
    + """, p as (select e.entity_id, e.revision, f.to_state as from_state, e.to_state from ev e
        left join ev f on f.entity_id = e.entity_id and f.revision = e.revision - 1)
    select *, case when from_state is null then 'REVISION_GAP' else 'ILLEGAL_TRANSITION' end as problem from p
    where (from_state is null and revision > 1) or (from_state <> to_state and from_state || to_state not in ('OF', 'OP', 'PF'))""",
)
def _(spark, sf):
    view(spark, sf, "state_events").createOrReplaceTempView("state_events")
    return audit.illegal_transitions(spark.sql(EVENTS_WITH_GAPS), _LEGAL)


CASES = """select entity_id as case_id, revision + case when entity_id % 5 = 0 and revision > 3 then 1 else 0 end as revision,
  case when entity_id % 7 = 0 then cast(floor(revision / 2.0) as bigint) else operation_id end as operation_id,
  case when revision = 1 and entity_id % 6 <> 0 then 'CREATE' else 'NOTE' end as action,
  case to_state when 'O' then 'OPEN' when 'F' then 'INVESTIGATING' else 'BLOCKED' end as state,
  case when entity_id % 8 = 0 then 'OPEN' else last_value(case to_state when 'O' then 'OPEN' when 'F' then 'INVESTIGATING' else 'BLOCKED' end)
    over (partition by entity_id order by revision rows between unbounded preceding and unbounded following) end as current_state
from state_events"""


@query(
    "case_audit",
    duck_with("state_events", cases=CASES)
    + """, a as (select case_id, count(*) as events, max(revision) as last_revision, (list(state order by revision desc))[1] as last_state,
        (list(current_state order by revision desc))[1] as cur, (list(action order by revision))[1] as first_action,
        min(revision) = 1 and max(revision) = count(*) and count(distinct revision) = count(*) as contiguous,
        count(distinct operation_id) < count(*) as repeated from cases group by 1),
      p as (select *, array_to_string(list_filter([case when not contiguous then 'REVISIONS_NOT_CONTIGUOUS' end,
        case when repeated then 'OPERATION_REPEATED' end, case when first_action <> 'CREATE' then 'NOT_CREATED_FIRST' end,
        case when last_state <> cur then 'STATE_MISMATCH' end], lambda x: x is not null), ',') as problems from a)
    select case_id, events, last_revision, last_state, problems, problems = '' as valid from p""",
)
def _(spark, sf):
    view(spark, sf, "state_events").createOrReplaceTempView("state_events")
    return audit.case_audit(spark.sql(CASES)).withColumn("problems", F.array_join("problems", ","))


CASE_ROWS = """select entity_id as case_id, max(operation_id) as updated_ms, min(concat('t', cast(entity_id % 40 as varchar(10)))) as trace
  from state_events group by 1"""


@query(
    "case_list",
    duck_with("state_events", cases=CASE_ROWS)
    + "select case_id, updated_ms from cases where trace = 't7' order by updated_ms desc, case_id limit 10 offset 5",
)
def _(spark, sf):
    view(spark, sf, "state_events").createOrReplaceTempView("state_events")
    cases = spark.sql(CASE_ROWS).withColumn("trace_ids", F.array("trace"))
    return audit.case_list(cases, limit=10, offset=5, trace_id="t7").select("case_id", "updated_ms")


_ACTION = """case {k} % 6 when 0 then 'connection-pool.restart' when 1 then 'cache.flush' when 2 then 'readreplica.scale-out'
  when 3 then 'readreplica.scale-in' when 4 then 'db.terminate-session' else 'disk.format' end"""
REQUESTS = f"""select c_custkey as request_id, concat('INC-', cast(c_custkey as varchar(20))) as incident_id,
  {_ACTION.format(k='c_custkey')} as action_id, concat('pool:', cast(c_custkey as varchar(20))) as target from customer"""
APPROVALS = f"""select o_orderkey as approval_id, o_custkey as request_id,
  concat('INC-', cast(o_custkey + case when o_orderkey % 13 = 0 then 1 else 0 end as varchar(20))) as incident_id,
  {_ACTION.format(k='o_custkey')} as action_id, concat('pool:', cast(o_custkey as varchar(20))) as target,
  case when o_orderkey % 17 = 0 then '' when o_orderkey % 11 = 0 then 'chg 1' else concat('CHG-', cast(o_orderkey as varchar(20))) end as ticket_id,
  concat('a', cast(o_orderkey % 30 as varchar(10))) as approver_id, cast(o_orderkey % 700 as varchar(10)) as nonce,
  (o_orderkey % 10) * 1000 as expires_ms from orders"""
APPROVERS = """select concat('a', cast(n_nationkey as varchar(10))) as approver_id,
  case n_regionkey when 0 then 'sre' when 1 then 'platform-oncall' when 2 then 'dba' when 3 then 'sre-lead' else 'dba-lead,app-engineer' end as roles
from nation"""
_CHECKS = """select a.approval_id, a.request_id, a.approver_id, case when ticket_id = '' then 'MISSING_FIELD'
    when ticket_id = 'chg 1' then 'BAD_TICKET' when p.roles is null then 'UNKNOWN_APPROVER'
    when a.incident_id <> r.incident_id or a.action_id <> r.action_id or a.target <> r.target then 'BOUND_TO_ANOTHER_REQUEST'
    when expires_ms <= 1000 then 'EXPIRED'
    when a.approval_id <> min(a.approval_id) over (partition by a.approver_id, a.nonce) then 'NONCE_REUSED'
    when r.action_id = 'disk.format' then 'UNKNOWN_ACTION'
    when not list_has_any(string_split(p.roles, ','), case r.action_id when 'connection-pool.restart' then ['sre', 'platform-oncall']
      when 'cache.flush' then ['sre', 'platform-oncall', 'app-engineer'] when 'db.terminate-session' then ['dba-lead'] else ['sre-lead', 'dba'] end)
      then 'ROLE_NOT_HELD' end as reason
  from approvals a left join requests r using (request_id) left join approvers p on p.approver_id = a.approver_id"""
_APPROVAL_CTES = {"requests": REQUESTS, "approvals": APPROVALS, "approvers": APPROVERS, "checks": _CHECKS}


def _approvals(spark, sf):
    approvers = derive(spark, sf, APPROVERS).withColumn("roles", F.split("roles", ","))
    return derive(spark, sf, APPROVALS), derive(spark, sf, REQUESTS), approvers, 1000


@query("approval_checks", duck_with(**_APPROVAL_CTES) + "select * from checks")
def _(spark, sf):
    return audit.approval_checks(*_approvals(spark, sf))


@query(
    "approval_quorum",
    duck_with(**_APPROVAL_CTES)
    + """, n as (select request_id, count(distinct approver_id) as n from checks where reason is null group by 1),
      q as (select r.request_id, action_id, case when action_id in ('connection-pool.restart', 'cache.flush') then 'LOW'
        when action_id like 'readreplica%' then 'MEDIUM' when action_id like 'db%' then 'HIGH' end as risk,
        case when action_id in ('connection-pool.restart', 'cache.flush') then 1 when action_id <> 'disk.format' then 2 end as required,
        coalesce(n, 0) as approvers from requests r left join n using (request_id))
    select *, case when required is null then 'UNKNOWN_ACTION' when approvers >= required then 'APPROVED' else 'PENDING' end as state from q""",
)
def _(spark, sf):
    return audit.approval_quorum(*_approvals(spark, sf))


# --- sources and clients ----------------------------------------------------------------------

REGISTRY = """select concat('src-', cast(c_custkey % 14 as varchar(10))) as source, max(c_custkey) % 3 as missing from customer group by 1"""
_HEALTH_NOW = 1706600000000
_HEALTH = f"""select r.source, case when l.source is null then 'UNKNOWN'
    when l.o = 'OK' and {_HEALTH_NOW} - l.ok_ms > 86400000 then 'STALE' when l.o = 'OK' then 'HEALTHY'
    when l.o in ('PERMISSION_DENIED', 'DISCONNECTED') then l.o else 'DEGRADED' end as state,
  l.ok_ms as last_success_ms, l.lag_ms, coalesce(collected, 0) as collected, coalesce(failures, 0) as failures, missing
from registry r left join (select source, (list(outcome order by collected_ms desc, event_id desc))[1] as o,
    (list(lag_ms order by collected_ms desc, event_id desc))[1] as lag_ms, max(collected_ms) filter (where outcome = 'OK') as ok_ms,
    count(*) filter (where outcome = 'OK') as collected, count(*) filter (where outcome <> 'OK') as failures
  from collections group by 1) l using (source)"""


def _health(spark, sf):
    flags = F.create_map(
        F.lit("lockEvidence"), F.col("missing") != 0, F.lit("metrics"), F.col("missing") != 1, F.lit("traceId"), F.col("missing") != 2
    )
    registry = derive(spark, sf, REGISTRY).withColumn("capabilities", flags)
    return audit.source_health(registry, view(spark, sf, "collections"), _HEALTH_NOW, max_stale_ms=86_400_000)


@query(
    "source_health",
    duck_with("collections", registry=REGISTRY, health=_HEALTH)
    + """select * exclude (missing), case when state = 'HEALTHY' then '' when missing = 0 then 'lockEvidence' when missing = 1 then 'metrics'
      else 'traceId' end as missing_visibility from health""",
)
def _(spark, sf):
    return _health(spark, sf).withColumn("missing_visibility", F.array_join("missing_visibility", ","))


@query(
    "observability_completeness",
    duck_with("collections", registry=REGISTRY, health=_HEALTH)
    + """select count(*) as sources, count(*) filter (where state = 'HEALTHY') as healthy,
      round(count(*) filter (where state = 'HEALTHY') / count(*), 2) as completeness from health""",
)
def _(spark, sf):
    return audit.observability_completeness(_health(spark, sf))


CLIENT_REQUESTS = "select concat('10.0.0.', cast(user_id % 5 as varchar(10))) as client, cast(epoch_ms(ts) as bigint) as at_ms from events"


_RATE_WINDOWS = (
    duck_with(requests=CLIENT_REQUESTS)
    + """, opened(client, start_ms) as (
      select client, min(at_ms) from requests group by client
      union all
      select r.client, min(r.at_ms) from opened o join requests r on r.client = o.client and r.at_ms > o.start_ms + 3600000 group by r.client, o.start_ms),
    counted as (select r.client, o.start_ms as window_start_ms, count(*) as requests from requests r
      asof join opened o on r.client = o.client and r.at_ms >= o.start_ms group by all)
    """
)


@query("rate_windows", _RATE_WINDOWS + "select client, window_start_ms, requests from counted")
def _(spark, sf):
    return audit.rate_windows(derive(spark, sf, CLIENT_REQUESTS), window_ms=3_600_000)


@query("rate_limit_audit", _RATE_WINDOWS + "select client, window_start_ms, requests, requests - 5 as refused from counted where requests > 5")
def _(spark, sf):
    return audit.rate_limit_audit(derive(spark, sf, CLIENT_REQUESTS), limit=5, window_ms=3_600_000)


# --- hash chains ------------------------------------------------------------------------------

_SEG = 4
_CHAIN = f"""
  base as (select o_custkey as chain, row_number() over (partition by o_custkey order by o_orderkey) - 1 as block_index,
    '{{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}}' as payload from orders),
  digests as (select chain, block_index // {_SEG} as seg, sha256(string_agg(sha256(payload), '' order by block_index)) as digest
    from base group by 1, 2),
  anchors(chain, seg, anchor) as (
    select chain, seg, repeat('0', 64) from digests where seg = 0
    union all select d.chain, d.seg + 1, sha256(a.anchor || '|' || d.digest) from anchors a join digests d on d.chain = a.chain and d.seg = a.seg),
  chained(chain, block_index, payload, previous_hash, hash) as (
    select b.chain, b.block_index, payload, anchor, sha256(b.chain || '|' || b.block_index || '|' || anchor || '|' || payload)
    from base b join anchors a on a.chain = b.chain and a.seg = b.block_index // {_SEG} where b.block_index % {_SEG} = 0
    union all
    select b.chain, b.block_index, b.payload, c.hash, sha256(b.chain || '|' || b.block_index || '|' || c.hash || '|' || b.payload)
    from chained c join base b on b.chain = c.chain and b.block_index = c.block_index + 1 and b.block_index % {_SEG} <> 0)
"""


def _ledger(spark, sf):
    orders = derive(spark, sf, "select o_custkey, o_orderkey, o_orderstatus from orders")
    return ledger.ledger_append(orders, "o_custkey", ["o_orderkey"], ["o_orderkey", "o_orderstatus"], segment=_SEG)


@query("ledger_append", "with recursive " + _CHAIN + "select * from chained")
def _(spark, sf):
    return _ledger(spark, sf)


@query(
    "ledger_verify",
    "with recursive "
    + _CHAIN
    + """select chain, count(*) as blocks, not (count(*) > 2 and chain % 10 = 3) and not (count(*) > 1 and chain % 10 = 4) as intact,
      case when count(*) > 2 and chain % 10 = 3 then 2 when count(*) > 1 and chain % 10 = 4 then 1 end as first_bad_index,
      case when count(*) > 2 and chain % 10 = 3 then 'CONTENT_CHANGED' when count(*) > 1 and chain % 10 = 4 then 'LINK_BROKEN' end as problem,
      (list(hash order by block_index desc))[1] as head_hash
    from chained group by chain""",
)
def _(spark, sf):
    tampered = _ledger(spark, sf).withColumns(
        {
            "payload": F.when((F.col("chain") % 10 == 3) & (F.col("block_index") == 2), "{}").otherwise(F.col("payload")),
            "previous_hash": F.when((F.col("chain") % 10 == 4) & (F.col("block_index") == 1), "0").otherwise(
                F.col("previous_hash")
            ),
        }
    )
    return ledger.ledger_verify(tampered, segment=_SEG)


@query("ledger_append_twice", "with recursive " + _CHAIN + "select * from chained")
def _(spark, sf):
    """The older half of every chain, then the rest appended to it."""
    orders = derive(spark, sf, "select o_custkey, o_orderkey, o_orderstatus, ntile(2) over (partition by o_custkey order by o_orderkey) as half from orders")
    shape = ("o_custkey", ["o_orderkey"], ["o_orderkey", "o_orderstatus"])
    first = keep(ledger.ledger_append(orders.filter("half = 1"), *shape, segment=_SEG), "ledger")
    return first.unionByName(ledger.ledger_append(orders.filter("half = 2"), *shape, existing=first, segment=_SEG))


@query(
    "ledger_forgery",
    f"""select o_custkey as chain, not (o_custkey % 10 = 5 and count(*) > {2 * _SEG}) as intact,
      case when o_custkey % 10 = 5 and count(*) > {2 * _SEG} then {2 * _SEG} end as first_bad_index,
      not (o_custkey % 10 = 5 and count(*) between 2 and {2 * _SEG}) as same_head from orders group by 1""",
)
def _(spark, sf):
    """Block 1 of some chains replaced, and its segment and the next one hashed again as if nothing had happened."""
    true = keep(_ledger(spark, sf), "ledger")
    c = F.col
    payload = F.when((c("chain") % 10 == 5) & (c("block_index") == 1), "{}").otherwise(c("payload"))
    forged = ledger._link(true.filter(c("block_index") < 2 * _SEG).select("chain", "block_index", payload.alias("payload")), None, _SEG)
    mixed = forged.unionByName(true.filter(c("block_index") >= 2 * _SEG))
    heads = true.groupBy("chain").agg(F.max_by("hash", "block_index").alias("true_head"))
    found = ledger.ledger_verify(mixed, segment=_SEG).join(heads, "chain")
    return found.select("chain", "intact", "first_bad_index", (c("head_hash") == c("true_head")).alias("same_head"))


QUEUE = """select concat(cast(o_custkey as varchar(20)), '-', o_orderstatus) as idempotency_key, o_orderkey as queued_seq,
  o_orderpriority as operation from orders"""
DONE = """select concat(cast(o_custkey as varchar(20)), '-', o_orderstatus) as idempotency_key from orders
  where o_orderstatus = 'F' and o_totalprice > 300000"""


@query(
    "offline_queue",
    f"""with q as ({QUEUE}), d as ({DONE}) select * from (select *, row_number() over (partition by idempotency_key order by queued_seq) as r
      from q) where r = 1 and idempotency_key not in (select idempotency_key from d)""".replace("select * from (", "select * exclude (r) from ("),
)
def _(spark, sf):
    return ledger.apply_offline_queue(derive(spark, sf, QUEUE), derive(spark, sf, DONE))


# --- shared money -----------------------------------------------------------------------------

_BALANCES = """select group_id, member, sum(cents)::bigint as balance_cents from (
    select group_id, paid_by as member, amount_cents as cents from expenses
    union all select group_id, (paid_by + i) % 10, -(amount_cents // split_n + case when i < amount_cents % split_n then 1 else 0 end)
      from expenses, range(10) t(i) where i < split_n) group by 1, 2"""


def _balances(spark, sf):
    rows = view(spark, sf, "expenses")
    members = F.transform(F.sequence(F.lit(0), F.col("split_n") - 1), lambda i: (F.col("paid_by") + i) % 10)
    return ledger.group_balances(rows.withColumn("split_with", members))


@query("group_balances", duck_with("expenses") + _BALANCES)
def _(spark, sf):
    return _balances(spark, sf)


@query(
    "balance_invariant",
    duck_with("expenses", balances=_BALANCES)
    + """select group_id, count(*) as members, sum(balance_cents)::bigint as total_cents, sum(balance_cents) = 0 as valid
    from balances group by 1""",
)
def _(spark, sf):
    return ledger.balance_invariant(_balances(spark, sf))


@query(
    "settlements",
    duck_with("expenses", balances=_BALANCES)
    + """, r as (select *, abs(balance_cents) as c, sum(abs(balance_cents)) over (partition by group_id, balance_cents < 0
          order by abs(balance_cents) desc, member) as hi from balances where balance_cents <> 0)
    select d.group_id, d.member as from_member, k.member as to_member,
      cast(least(d.hi, k.hi) - greatest(d.hi - d.c, k.hi - k.c) as bigint) as amount_cents
    from r d join r k on k.group_id = d.group_id and d.balance_cents < 0 and k.balance_cents > 0
      and least(d.hi, k.hi) > greatest(d.hi - d.c, k.hi - k.c)""",
)
def _(spark, sf):
    return ledger.settlements(_balances(spark, sf))
