"""Envelopes, evidence graph, changes, advisories and diagnosis."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwise.operators import baseline, change, correlate, diagnose, graph
from spanwise.plans import journeys
from spanwise.plans.catalog_requests import LEARN_CTES, learned_from
from spanwise.plans.fixtures import derive, duck_with, spans, view
from spanwise.plans.registry import query


def envelopes(spark, sf):
    return view(spark, sf, "envelopes")


_PREC = """case component_type when 'LOAD_BALANCER' then 4 when 'WEB_SERVER' then 5 when 'WEBSPHERE' then 6
  when 'MESSAGE_BROKER' then 7 when 'DB2' then 8 when 'EXTERNAL_GATEWAY' then 9 when 'CLIENT_RETURN' then 10 else 50 end"""
_SIGNED = """select *, first_value(evidence_id) over (partition by trace_id, component_type, event_type, span_id, observed_ms
  order by ingest_seq) as first_id from envelopes"""
_UNIQ = "select * exclude (first_id) from signed where first_id = evidence_id"


@query(
    "deduplicate_envelopes",
    duck_with("envelopes", signed=_SIGNED)
    + "select evidence_id, case when first_id <> evidence_id then first_id end as duplicate_of from signed",
)
def _(spark, sf):
    return correlate.deduplicate_envelopes(envelopes(spark, sf)).select("evidence_id", "duplicate_of")


def _conflicts(source: str) -> str:
    return f"""select trace_id, component_type, count(*) as reports, min(observed_ms) as min_ms, max(observed_ms) as max_ms,
      max(observed_ms) - min(observed_ms) as variance_ms,
      (list(source_system order by observed_ms, ingest_seq))[1] as fastest_source,
      (list(source_system order by observed_ms desc, ingest_seq desc))[1] as slowest_source
    from {source} group by 1, 2 having count(*) > 1 and max(observed_ms) - min(observed_ms) > 100
      and max(observed_ms) / greatest(1, min(observed_ms)) > 2"""


@query("source_conflicts", duck_with("envelopes") + _conflicts("envelopes"))
def _(spark, sf):
    return correlate.source_conflicts(envelopes(spark, sf)).drop("conflict_type", "resolution")


@query(
    "conflict_sources",
    duck_with("envelopes", conf=_conflicts("envelopes"))
    + """select trace_id, component_type, evidence_id, source_system, observed_ms from envelopes
    where (trace_id, component_type) in (select (trace_id, component_type) from conf)""",
)
def _(spark, sf):
    return correlate.conflict_sources(envelopes(spark, sf))


OFFSETS = """select concat('node-', cast(s_suppkey % 20 as varchar(10))) as component_name,
  cast(max(s_suppkey) % 7 * 1000 - 2500 as bigint) as offset_ms from supplier where s_suppkey % 20 < 12 group by 1"""


@query(
    "clock_normalize",
    duck_with("envelopes", offsets=OFFSETS)
    + """select evidence_id, event_ms as raw_event_ms, event_ms - coalesce(offset_ms, 0) as event_ms,
      coalesce(offset_ms, 0) as clock_offset_ms from envelopes left join offsets using (component_name)""",
)
def _(spark, sf):
    normal = correlate.normalize_clock(envelopes(spark, sf), derive(spark, sf, OFFSETS))
    return normal.select("evidence_id", "raw_event_ms", "event_ms", "clock_offset_ms")


@query(
    "causal_order",
    duck_with("envelopes")
    + f"""select evidence_id, {_PREC} as precedence, row_number() over (partition by trace_id
      order by {_PREC}, event_ms, ingest_seq) as position from envelopes""",
)
def _(spark, sf):
    return correlate.causal_order(envelopes(spark, sf)).select("evidence_id", "precedence", "position")


def _violations(source: str) -> str:
    return f"""select trace_id, component_name as source_hop, next_name as target_hop, next_ms - event_ms as delta_ms from (
      select trace_id, component_name, event_ms,
        lead(component_name) over w as next_name, lead(event_ms) over w as next_ms from {source}
      window w as (partition by trace_id order by {_PREC}, event_ms, ingest_seq)) where next_ms < event_ms - 50"""


@query("causality_violations", duck_with("envelopes") + _violations("envelopes"))
def _(spark, sf):
    return correlate.causality_violations(envelopes(spark, sf))


def _topology(source: str) -> str:
    return f"""
    select trace_id, 'TOPOLOGY_INVERSION' as anomaly, a.t as early_type, a.n as early_name, b.t as expected_before
    from (select trace_id, component_type as t, min(ingest_seq) as s,
            (list(component_name order by ingest_seq))[1] as n from {source} group by 1, 2) a
    join (select trace_id, component_type as t, min(ingest_seq) as s from {source} group by 1, 2) b using (trace_id)
    where a.s < b.s and ((a.t = 'DB2' and b.t = 'WEBSPHERE') or (a.t = 'WEBSPHERE' and b.t = 'LOAD_BALANCER'))"""


# Envelopes in order of time, so that tiers are really seen out of order.
BY_TIME = """select trace_id, evidence_id, component_type, component_name, row_number() over (partition by trace_id
  order by event_ms, evidence_id) as ingest_seq from envelopes"""


@query("topology_anomalies", duck_with("envelopes", timed=BY_TIME) + _topology("timed"))
def _(spark, sf):
    envelopes(spark, sf).createOrReplaceTempView("envelopes")
    return correlate.topology_anomalies(spark.sql(BY_TIME))


def _match(a: str, b: str) -> dict[str, str]:
    test = {k: f"{a}.{k} = {b}.{k}" for k in ("message_id", "sql_fingerprint", "db_pid")}
    return {
        "level": f"""case when {test['message_id']} then 'LEVEL_1_EXACT' when {test['sql_fingerprint']} then 'LEVEL_2_PROTOCOL'
          when {test['db_pid']} then 'LEVEL_3_TOPOLOGY' else 'UNMATCHED' end""",
        "key": f"""case when {test['message_id']} then 'MESSAGE_ID' when {test['sql_fingerprint']} then 'SQL_FINGERPRINT'
          when {test['db_pid']} then 'DB_PID' end""",
        "value": f"""case when {test['message_id']} then {a}.message_id when {test['sql_fingerprint']} then {a}.sql_fingerprint
          when {test['db_pid']} then cast({a}.db_pid as varchar) end""",
    }


_M = _match("a", "b")


def _matches(source: str) -> str:
    return f"""select a.trace_id, a.evidence_id as evidence_a, b.evidence_id as evidence_b, {_M['level']} as level,
      {_M['key']} as matched_key, {_M['value']} as matched_value
    from (select *, row_number() over (partition by trace_id order by ingest_seq) as r from {source}) a
    join (select *, row_number() over (partition by trace_id order by ingest_seq) as r from {source}) b
      on a.trace_id = b.trace_id and b.r = a.r + 1"""


@query(
    "identity_match",
    duck_with("envelopes", matches=_matches("envelopes"))
    + """select *, level <> 'UNMATCHED' as matched, case level when 'LEVEL_1_EXACT' then 1.0 when 'LEVEL_2_PROTOCOL' then 0.92
      when 'LEVEL_3_TOPOLOGY' then 0.82 else 0.0 end as confidence from matches""",
)
def _(spark, sf):
    return correlate.consecutive_matches(envelopes(spark, sf), ignore=["trace_id"])


@query(
    "rejected_candidates",
    duck_with("envelopes", matches=_matches("envelopes"))
    + """select trace_id as target_trace_id, evidence_a as target_evidence_id, evidence_b as candidate_evidence_id,
      'NO_SHARED_IDENTITY' as reason, 'all identity levels' as divergent_factor from matches where level = 'UNMATCHED'""",
)
def _(spark, sf):
    return correlate.rejected_candidates(correlate.consecutive_matches(envelopes(spark, sf), ignore=["trace_id"]))


@query(
    "identity_links",
    duck_with("envelopes")
    + """, keyed as (
        select evidence_id, event_ms, 0 as rank, 'LEVEL_1_EXACT' as level, 'MESSAGE_ID' as matched_key,
          message_id as matched_value from envelopes where message_id is not null
        union all select evidence_id, event_ms, 1, 'LEVEL_2_PROTOCOL', 'SQL_FINGERPRINT', sql_fingerprint
          from envelopes where sql_fingerprint is not null
        union all select evidence_id, event_ms, 2, 'LEVEL_3_TOPOLOGY', 'DB_PID', cast(db_pid as varchar)
          from envelopes where db_pid is not null),
      linked as (select *, first_value(evidence_id) over (partition by matched_key, matched_value
          order by event_ms, evidence_id) as linked_to from keyed)
    select evidence_id, linked_to, level, matched_key, matched_value, case level when 'LEVEL_1_EXACT' then 1.0
      when 'LEVEL_2_PROTOCOL' then 0.92 else 0.82 end as confidence
    from (select *, row_number() over (partition by evidence_id order by rank) as r from linked
          where linked_to <> evidence_id) where r = 1""",
)
def _(spark, sf):
    return correlate.identity_links(envelopes(spark, sf))


PRODUCERS = """select concat('P', cast(correlation_id as varchar(20))) as evidence_id, producer_ms as event_ms,
  case when correlation_id % 10 = 0 then concat('M', cast(correlation_id % 70 as varchar(20))) end as message_id,
  correlation_id, cast(floor(correlation_id / 4) as bigint) as scope from messages"""
CONSUMERS = """select concat('C', cast(correlation_id as varchar(20))) as evidence_id, consumer_ms as event_ms,
  case when correlation_id % 10 = 0 then concat('M', cast(correlation_id % 90 as varchar(20))) end as message_id,
  case when correlation_id % 7 <> 0 then correlation_id end as correlation_id, cast(floor(correlation_id / 4) as bigint) as scope
  from messages where consumer_ms is not null"""
_STITCH = """, by_m as (select message_id as v, arg_min(evidence_id, (event_ms, evidence_id)) as p, min(event_ms) as ms, count(*) as n from producers where message_id is not null group by 1),
    by_x as (select correlation_id as v, arg_min(evidence_id, (event_ms, evidence_id)) as p, min(event_ms) as ms, count(*) as n from producers where correlation_id is not null group by 1),
    met as (select case when m.v is not null then 'message_id' when x.v is not null then 'correlation_id' end as id_type,
        case when m.v is not null then m.v when x.v is not null then cast(x.v as varchar) end as id_value, coalesce(m.p, x.p) as producer, c.evidence_id as consumer,
        case when m.v is not null then m.n else coalesce(x.n, 0) end as producer_count, case when m.v is not null then m.ms else x.ms end as p_ms, c.event_ms as c_ms, c.scope
      from consumers c left join by_m m on m.v = c.message_id left join by_x x on x.v = c.correlation_id),
    loose as (select * from producers p where not exists (select 1 from consumers c where c.message_id = p.message_id)
      and not exists (select 1 from consumers c where c.correlation_id = p.correlation_id)),
    lead as (select scope, arg_min(evidence_id, (event_ms, evidence_id)) as p, arg_min(event_ms, (event_ms, evidence_id)) as ms from loose where message_id is null group by 1),
    timed as (select met.*, l.p as t_p, l.ms as t_ms from met left join lead l on met.producer is null and l.scope = met.scope),
    stitched as (select id_type, id_value, coalesce(producer, t_p) as producer, consumer, case when t_p is not null then 1 else producer_count end as producer_count,
        coalesce(p_ms, t_ms) as p_ms, c_ms, case when t_p is not null then 'PROBABILISTIC_TIMING_ALIGNMENT' when producer is not null then 'EXACT_MESSAGE_CORRELATION' else 'UNMATCHED' end as correlation_level
      from timed union all select null, null, evidence_id, null, 1, null, null, 'UNMATCHED' from loose where evidence_id not in (select t_p from timed where t_p is not null))
    select id_type, id_value, producer, consumer, producer_count, correlation_level <> 'UNMATCHED' as correlated, correlation_level, c_ms - p_ms as transit_ms,
      c_ms - p_ms > 2000 as is_delayed, case correlation_level when 'UNMATCHED' then 0.0 when 'EXACT_MESSAGE_CORRELATION' then 1.0 else 0.85 end as confidence from stitched"""


@query("async_stitch", duck_with("messages", producers=PRODUCERS, consumers=CONSUMERS) + _STITCH)
def _(spark, sf):
    view(spark, sf, "messages").createOrReplaceTempView("messages")
    return correlate.stitch_async(spark.sql(PRODUCERS), spark.sql(CONSUMERS), scope="scope")


# --- evidence graph ---------------------------------------------------------------------------

_EDGES = """select trace_id, ingest_seq, cast(trace_id as varchar) as from_id,
  case when status = 'FAILED' then 'BLOCKED_BY' else 'OBSERVED_AT' end as type, component_name as to_id,
  observed_ms as duration_ms, cast(db_pid as varchar) as lock_pid from envelopes"""


@query("graph_edges", duck_with("envelopes") + _EDGES)
def _(spark, sf):
    return graph.graph_edges(envelopes(spark, sf))


@query(
    "graph_nodes",
    duck_with("envelopes")
    + """select cast(trace_id as varchar) as id, 'REQUEST' as type,
      case when sum(observed_ms) > 200 then 'DEGRADED' else 'NOMINAL' end as state from envelopes group by 1
    union all select distinct component_name, 'COMPONENT', null from envelopes""",
)
def _(spark, sf):
    return graph.graph_nodes(envelopes(spark, sf))


@query(
    "lineage",
    duck_with("envelopes", edges=_EDGES) + "select from_id, type, to_id, duration_ms from edges where to_id = 'node-7'",
)
def _(spark, sf):
    return graph.lineage(graph.graph_edges(envelopes(spark, sf)), "node-7").select("from_id", "type", "to_id", "duration_ms")


@query(
    "causal_chains",
    duck_with("envelopes", edges=_EDGES)
    + """select trace_id, count(*) as direct_edges, sum(case when type = 'BLOCKED_BY' then 1 else 0 end)::bigint as cascade_edges,
      coalesce(string_agg(distinct case when type = 'BLOCKED_BY' then to_id end, ','
        order by case when type = 'BLOCKED_BY' then to_id end), '') as cascade_components
    from edges group by 1""",
)
def _(spark, sf):
    chains = graph.causal_chains(graph.graph_edges(envelopes(spark, sf)))
    return chains.withColumn("cascade_components", F.array_join("cascade_components", ","))


_BLOCKAGE = """select trace_id, (list(to_id order by ingest_seq))[1] as blockage_node,
  (list(duration_ms order by ingest_seq))[1] as duration_ms, (list(lock_pid order by ingest_seq))[1] as lock_pid,
  'Resource Contention' as reason from edges where type = 'BLOCKED_BY' group by 1"""


@query("root_blockage", duck_with("envelopes", edges=_EDGES) + _BLOCKAGE)
def _(spark, sf):
    return graph.root_blockage(graph.graph_edges(envelopes(spark, sf)))


# --- claims over envelopes --------------------------------------------------------------------

AGO = """select trace_id, cast(min(ingest_seq) * 11 + trace_id % 50 as bigint) as minutes_ago from envelopes
  where trace_id % 3 = 0 group by trace_id"""


def _claims(source: str) -> str:
    return f"""select *, case when p is null then 0.998 else round(cast(least(0.999::double, greatest(0.1::double,
        0.98::double * 0.2::double + (case when minutes_ago <= 30 then 0.96 else 0.85 end)::double * 0.15::double
        + (case when p.locked then 0.99 else 0.88 end)::double * 0.25::double
        + (case when p.identified then 0.99 else 0.85 end)::double * 0.15::double
        + least(1.0::double, p.shown / 50) * 0.15::double + (case when n >= 4 then 0.98 else 0.75 end)::double * 0.1::double
        - (case when p.cpu_pct < 70 then 0.01 else 0 end)::double - (case when n < 5 then 0.15 else 0 end)::double))
      as decimal(28,10)), 3) end as confidence
    from (select trace_id, count(*) as n, (list({{'name': component_name, 'shown': shown, 'locked': locked, 'cpu_pct': cpu_pct,
        'identified': db_pid is not null or sql_fingerprint is not null}}
        order by shown + case when locked then 50 else 0 end desc, ingest_seq) filter (where dev))[1] as p
      from (select *, round(cast(observed_ms / greatest(0.1, expected_ms)::double as decimal(28,10)), 1)::double as shown,
          lock_wait_ms > 0 as locked, observed_ms / expected_ms > 1.5 or status in ('FAILED', 'DEGRADED') or lock_wait_ms > 500
            as dev from {source}) group by 1) left join ago using (trace_id)"""


_CLAIM_COLUMNS = """trace_id, case when p is null then 'every hop stayed within its expected duration' else p.name
  || case when p.locked then ' lock contention and pool saturation' else ' slowdown' end
  || ' started the failure of this request' end as statement,
  case when p is null then 'OBSERVED' else 'INFERRED' end as classification, confidence,
  case when p is null then 'VERIFIED' else 'OPEN' end as status, p.name as primary_component"""


@query(
    "causal_claims",
    duck_with("envelopes", ago=AGO, cl=_claims("envelopes"))
    + f"select {_CLAIM_COLUMNS}, p.shown as primary_ratio, n as envelope_count from cl",
)
def _(spark, sf):
    rows = envelopes(spark, sf)
    rows.createOrReplaceTempView("envelopes")
    return diagnose.causal_claims(rows, spark.sql(AGO)).drop("type")


@query(
    "why_not",
    duck_with("envelopes", ago=AGO, cl=_claims("envelopes"))
    + """, o as (select e.trace_id, component_name, max(observed_ms) as ms, bool_or(observed_ms / expected_ms > 1.5) as slow,
        bool_or(status in ('FAILED', 'DEGRADED')) as bad
      from envelopes e join cl on cl.trace_id = e.trace_id and p is not null
      where component_name <> p.name group by 1, 2)
    select trace_id, component_name, case when not slow and not bad then 'within budget and successful at '
        when not bad then 'slower than expected but successful at ' else 'deviated too, less than the primary, at ' end
        || ms || 'ms' as elimination_reason, not slow and not bad as eliminated from o""",
)
def _(spark, sf):
    rows = envelopes(spark, sf)
    rows.createOrReplaceTempView("envelopes")
    return diagnose.why_not(rows, diagnose.causal_claims(rows, spark.sql(AGO)))


@query(
    "claims",
    duck_with("envelopes", ago=AGO, cl=_claims("envelopes"))
    + """, s as (select trace_id, case when n > 1 then case when p is null then 'every hop stayed within its expected duration'
        else p.name || case when p.locked then ' lock contention and pool saturation' else ' slowdown' end
          || ' started the failure of this request' end end as st, confidence, p from cl),
      t as (select *, coalesce(st, 'root cause is unknown: insufficient telemetry') as statement from s)
    select trace_id, statement, 'claim-' || sha256(trace_id || '|ROOT_CAUSE_CANDIDATE|' || statement) as claim_id,
      case when st is null then 'UNKNOWN' when p is null then 'OBSERVED' else 'INFERRED' end as classification,
      case when st is null then 0.0 else confidence end as confidence,
      case when st is null then 'INSUFFICIENT_EVIDENCE' when p is null then 'VERIFIED' else 'OPEN' end as status,
      case when st is null then 2 else 0 end as falsifiers from t""",
)
def _(spark, sf):
    rows = envelopes(spark, sf)
    rows.createOrReplaceTempView("envelopes")
    found = diagnose.causal_claims(rows, spark.sql(AGO)).withColumn(
        "statement", F.when(F.col("envelope_count") > 1, F.col("statement"))
    )
    return diagnose.claims(found).select(
        "trace_id", "statement", "claim_id", "classification", "confidence", "status",
        F.size("falsifiability").alias("falsifiers"),
    )


_JOURNEY = """, conf as ({conf}), viol as ({viol}), topo as ({topo}), matches as ({matches}), edges as ({edges}),
  block as ({block}), cl as ({cl}),
  agg as (select trace_id, count(*) as n, sum(observed_ms)::bigint as total_ms, bool_or(status in ('FAILED', 'DEGRADED')) as failed,
      (list(message_id order by ingest_seq) filter (where component_type = 'WEBSPHERE'))[1] as p_id,
      min(event_ms) filter (where component_type = 'WEBSPHERE') as p_ms,
      (list(message_id order by ingest_seq) filter (where component_type = 'MESSAGE_BROKER'))[1] as c_id,
      min(event_ms) filter (where component_type = 'MESSAGE_BROKER') as c_ms from uniq group by 1),
  lev as (select trace_id, max(case level when 'UNMATCHED' then 4 when 'LEVEL_3_TOPOLOGY' then 3 when 'LEVEL_2_PROTOCOL' then 2
      else 1 end) as l from matches group by 1),
  j as (select a.*, coalesce(lev.l, 1) as l, cl.confidence, cl.p, block.blockage_node,
      (select count(*) from conf where conf.trace_id = a.trace_id) as conflicts,
      (select count(*) from viol where viol.trace_id = a.trace_id) as violations,
      (select count(*) from topo where topo.trace_id = a.trace_id) as inversions
    from agg a left join lev using (trace_id) left join cl using (trace_id) left join block using (trace_id)),
  g as (select *, least(1.0, n / 4.0) as comp, case l when 1 then 1.0 when 2 then 0.85 when 3 then 0.7 else 0.5 end as ident from j),
  journeys as (select trace_id, n as envelope_count, total_ms, conflicts, violations, inversions,
    case l when 1 then 'LEVEL_1_EXACT' when 2 then 'LEVEL_2_PROTOCOL' when 3 then 'LEVEL_3_TOPOLOGY' else 'UNMATCHED' end
      as identity_level,
    coalesce(p_id = c_id, false) or (p_id is null and c_ms is not null) as async_correlated,
    c_ms - p_ms as transit_ms, blockage_node, p.name as primary_component,
    case when p is null then 'OBSERVED' else 'INFERRED' end as classification, confidence as causal_confidence,
    round(comp, 2) as evidence_completeness,
    case when comp < 0.3 then 'INSUFFICIENT_EVIDENCE' when conflicts > 0 then 'CONFLICTED'
      when comp >= 0.8 and ident >= 0.9 and confidence >= 0.8 then 'VERIFIED'
      when comp >= 0.5 and confidence >= 0.7 then 'STRONGLY_SUPPORTED' else 'PARTIALLY_SUPPORTED' end as truth_status,
    case when failed or p is not null then 'FAILED' else 'HEALTHY' end as technical_status from g)
""".format(
    conf=_conflicts("uniq"), viol=_violations("uniq"), topo=_topology("uniq"), matches=_matches("uniq"),
    edges=_EDGES.replace("from envelopes", "from uniq"), block=_BLOCKAGE, cl=_claims("uniq"),
)


def _journeys(spark, sf):
    rows = envelopes(spark, sf)
    rows.createOrReplaceTempView("envelopes")
    return journeys.process_journeys(rows, spark.sql(AGO), expected_hops=4, ignore_identity=["trace_id"])


@query("process_journeys", duck_with("envelopes", signed=_SIGNED, uniq=_UNIQ, ago=AGO) + _JOURNEY + "select * from journeys")
def _(spark, sf):
    return _journeys(spark, sf).drop("statement")


@query(
    "correlation_quality",
    duck_with("envelopes", signed=_SIGNED, uniq=_UNIQ, ago=AGO)
    + _JOURNEY
    + "select truth_status, count(*) as journeys, sum(total_ms)::bigint as total_ms from journeys group by 1",
)
def _(spark, sf):
    return _journeys(spark, sf).groupBy("truth_status").agg(
        F.count(F.lit(1)).alias("journeys"), F.sum("total_ms").alias("total_ms")
    )


@query(
    "explain_correlation",
    duck_with("envelopes", signed=_SIGNED, uniq=_UNIQ, ago=AGO)
    + _JOURNEY
    + """select trace_id, case when causal_confidence >= 0.8 then 'STRONGLY_SUPPORTED' else 'PARTIALLY_SUPPORTED' end
        as correlation_status,
      case identity_level when 'LEVEL_1_EXACT' then 'Joined on trace id ' || trace_id || '.'
        when 'LEVEL_2_PROTOCOL' then 'Joined on protocol keys where ' || trace_id || ' has no trace id.'
        when 'LEVEL_3_TOPOLOGY' then 'Joined on host or process for ' || trace_id || '.'
        else 'No identity level covers all of ' || trace_id || '.' end as explanation from journeys""",
)
def _(spark, sf):
    rows = _journeys(spark, sf).select(
        "trace_id", F.col("identity_level").alias("method"), F.col("causal_confidence").alias("confidence")
    )
    return correlate.explain_correlation(rows).select("trace_id", "correlation_status", "explanation")


# --- diagnosis over spans ---------------------------------------------------------------------

SERVICE_BASE = """select service, cast(floor(sum(duration_ms) / count(*) / 8.0) as bigint) as baseline_ms
  from spans where status = 'OK' group by service"""
SPAN_AGO = """select trace_id, cast(max(ingest_seq) * 11 as bigint) as minutes_ago from spans
  where trace_id like '%2' or trace_id like '%7' group by trace_id"""
SPAN_CPU = "select trace_id, cast(max(db_cpu_pct) as double) as cpu_pct from spans where ingest_seq < 3 group by trace_id"

_RCA = f"""
  r as (select s.*, s.duration_ms / greatest(1, coalesce(b.baseline_ms, 20)) as ratio from spans s
    left join ({SERVICE_BASE}) b on b.service = s.service),
  picked as (select trace_id, (list({{'service': service, 'duration_ms': duration_ms, 'ratio': ratio, 'status': status}}
      order by case when status = 'ERROR' then 1 else 0 end desc, ratio desc, ingest_seq)
      filter (where (ratio > 1.5 or duration_ms > 200 or status <> 'OK') and (ratio > 1 or status = 'ERROR')))[1] as p
    from r group by 1),
  j as (select picked.*, minutes_ago, cpu_pct, p is not null and (p.ratio >= 1.3 or p.status = 'ERROR') as found
    from picked left join ({SPAN_AGO}) a using (trace_id) left join ({SPAN_CPU}) c using (trace_id)),
  k as (select *, 15 + least(30, case when p.ratio > 100 then 30 else floor(p.ratio * 0.3::double + 0.5) end)
      + case when minutes_ago < 30 then 20 when minutes_ago is not null then 10 else 0 end + 20
      + least(25, case when p.ratio > 50 then 25 else floor(p.ratio * 0.5::double + 0.5) end)
      + case when minutes_ago is not null then 10 else 0 end
      - case when cpu_pct > 0 and cpu_pct < 70 then 1.3 else 1.0 end - 2 as raw from j),
  rca as (select trace_id, case when found then 'DEVIATION_DETECTED' else 'GOLDEN_PATH_MATCH' end as status,
    case when found then p.service end as target, case when found then p.duration_ms end as duration_ms,
    case when found then round(cast(p.ratio as decimal(28,10)), 2) end as deviation_ratio,
    case when found then least(99.4, greatest(10.0, round(cast(raw as decimal(28,10)), 1))) else 99.8 end as confidence,
    case when found then greatest(10.0, round(cast(least(99.4, greatest(10.0, round(cast(raw as decimal(28,10)), 1))) - 22.2
      as decimal(28,10)), 1)) end as second_confidence,
    case when found then 'INFERRED' else 'OBSERVED' end as provenance from k)
"""


def _rca(spark, sf):
    flat = view(spark, sf, "spans")
    flat.createOrReplaceTempView("spans")
    return diagnose.rca_generic(flat, spark.sql(SERVICE_BASE), spark.sql(SPAN_AGO), spark.sql(SPAN_CPU))


@query("rca_generic", duck_with("spans").rstrip() + "," + _RCA + "select * from rca")
def _(spark, sf):
    return _rca(spark, sf)


@query(
    "confidence_envelope",
    duck_with("spans").rstrip()
    + ","
    + _RCA
    + """select trace_id, case when target is null then 'every hop is within its baseline' else target || ' took '
        || duration_ms || 'ms, ' || cast(floor(deviation_ratio + 0.5) as bigint) || 'x its baseline' end as what_we_know,
      case when target is null then 'the request took its usual path' else 'contention or exhaustion at ' || target end
        as what_we_think,
      case when target is null then 'anything below the resolution of spans' else 'uninstrumented internals of ' || target end
        as what_we_dont_know,
      case when target is null then 'a hop above 1.5x its baseline' else 'the same latency on requests that bypass ' || target
        end as what_would_change_our_mind from rca""",
)
def _(spark, sf):
    return diagnose.confidence_envelope(_rca(spark, sf))


@query(
    "first_deviation",
    duck_with("spans")
    + f""", r as (select s.*, b.baseline_ms, s.duration_ms / greatest(0.1, coalesce(b.baseline_ms, 20))::double as m
        from spans s left join ({SERVICE_BASE}) b on b.service = s.service),
      p as (select trace_id, (list({{'s': service, 'd': duration_ms, 'e': coalesce(baseline_ms, 20), 'm': m}}
        order by m desc, ingest_seq) filter (where m > 1.5))[1] as p from r group by 1)
    select trace_id, p.s as service, p.d as duration_ms, p.e as expected_ms, round(cast(p.m as decimal(28,10)), 1) as multiple
    from p""",
)
def _(spark, sf):
    flat = view(spark, sf, "spans")
    flat.createOrReplaceTempView("spans")
    return diagnose.first_deviation(flat, spark.sql(SERVICE_BASE))


@query(
    "db_lock_candidates",
    duck_with("spans", **LEARN_CTES)
    + """, f as (select * from (select s.*, row_number() over (partition by s.trace_id order by ingest_seq) as r
          from spans s where name like '%query%') where r = 1 and duration_ms > 1000),
      k as (select f.*, case when p.duplicate_span_ids = 0 and p.root_count <= 1 and l.ready then p.request_key end as rk
        from f join profile p using (trace_id) left join learned l on l.request_key = p.request_key),
      m as (select k.*, case when h.p95 > 0 then cast(floor(k.duration_ms / h.p95 + 0.5) as bigint) end as lr
        from k left join hop_learned h on h.request_key = k.rk and h.hop = k.service || '::' || k.name)
    select trace_id, span_id, duration_ms, lr as latency_ratio,
      least(100, greatest(0, 50 + case when lr is null then 0 when lr > 100 then 20 when lr > 10 then 10 else -10 end
        + case when db_pool_pct > 90 then 15 when db_pool_pct is not null then -15 else 0 end
        + case when db_fingerprint is not null then 10 else 0 end
        + case when db_cpu_pct >= 70 then 5 when db_cpu_pct is not null then -5 else 0 end)) as support,
      (lr is not null)::int + (db_pool_pct is not null)::int + (db_fingerprint is not null)::int + (db_cpu_pct is not null)::int
        as factors_observed,
      array_to_string(list_filter([case when lr is null then 'latency' end, case when db_pool_pct is null then 'connectionPool' end,
        case when db_fingerprint is null then 'queryFingerprint' end, case when db_cpu_pct is null then 'cpu' end],
        lambda x: x is not null), ',') as factors_unknown,
      db_lock_wait_ms as lock_wait_ms,
      case when db_lock_wait_ms is not null and db_pool_pct is not null then 'INFERRED'
        else 'INFERRED_FROM_PARTIAL_EVIDENCE' end as provenance,
      case when db_blocking_trace is not null then 'behind request ' || db_blocking_trace
        when db_holder_pid is not null then 'behind lock holder ' || db_holder_pid else 'UNKNOWN' end as blast_radius,
      case when db_blocking_trace is not null then 'INVESTIGATE_BLOCKING_REQUEST'
        when db_holder_pid is not null then 'INVESTIGATE_LOCK_HOLDER' else 'INSUFFICIENT_EVIDENCE' end as recommended_action
    from m""",
)
def _(spark, sf):
    frame = spans(spark, sf)
    profile, samples, learned = learned_from(frame)
    verdicts = baseline.baseline_verdict(profile, learned)
    hops = baseline.hop_baselines(frame, samples)
    return (
        diagnose.db_lock_candidates(frame, verdicts, hops)
        .withColumn("factors_unknown", F.array_join("factors_unknown", ","))
        .drop("factors_measured")
    )


JOURNEYS = """select o_orderkey as journey_id, case o_orderstatus when 'F' then 'FAILED' when 'P' then '503' else 'OK' end
  as technical_status, cast(floor(o_totalprice / 20) as bigint) as affected_count, 100 + o_custkey % 50 as average_value from orders"""
SETTLED = """select o_orderkey as journey_id, o_orderkey % 2 = 0 as is_settled, o_custkey * 100 as confirmed_loss,
  o_custkey * 70 as net_exposure, cast(null as bigint) as reversed_count from orders where o_orderkey % 3 = 0"""


@query(
    "business_impact",
    f"""with j as ({JOURNEYS}), r as ({SETTLED}),
      x as (select j.*, technical_status in ('FAILED', '503') as bad, coalesce(is_settled, false) as settled, confirmed_loss as cl,
        net_exposure as ne from j left join r using (journey_id))
    select journey_id, case when bad then 'UNHEALTHY' else 'HEALTHY' end as technical_status, affected_count as affected,
      case when bad then cast(floor(affected_count * 0.42::double) as bigint) else 0 end as failed,
      case when bad then cast(floor(affected_count * 0.38::double) as bigint) else 0 end as timed_out,
      case when bad then cast(floor(affected_count * 0.15::double) as bigint) else 0 end as pending,
      case when bad then cast(floor(affected_count * 0.05::double) as bigint) else affected_count end as retried,
      case when bad then cast(floor(affected_count * 0.01::double) as bigint) else 0 end as duplicate_risk,
      0 as reversed, case when bad then affected_count * average_value else 0 end as estimated_at_risk,
      case when settled then cl else 0 end as confirmed_loss,
      case when settled then ne when bad then affected_count * average_value else 0 end as reconciled_exposure,
      case when settled then 'AUTHORITATIVELY_RECONCILED' else 'ESTIMATED_PENDING_RECONCILIATION' end as classification,
      bad and affected_count > 10000 as compliance_report_required from x""",
)
def _(spark, sf):
    return diagnose.business_impact(derive(spark, sf, JOURNEYS), derive(spark, sf, SETTLED))


# --- changes and advisories -------------------------------------------------------------------

_REQ = """select trace_id, min(observed_ms) as observed_ms, list_sort(list_distinct(list(service))) as services
  from ev_spans group by 1"""
_PAIRS = """select r.trace_id, r.observed_ms, c.change_id, c.change_ms, c.service as change_service, c.change_type,
  cast(floor((r.observed_ms - c.change_ms) / 60000 + 0.5) as bigint) as minutes_before,
  coalesce(len(list_filter(r.services, lambda s: contains(s, c.service) or contains(c.service, s))) > 0, false) as service_match
from req r join changes c on r.observed_ms - c.change_ms between 0 and 7200000"""


@query("correlate_changes", duck_with("ev_spans", "changes", req=_REQ, pairs=_PAIRS) + "select *, 'CORRELATED' as provenance from pairs")
def _(spark, sf):
    return change.correlate_changes(change.request_times(view(spark, sf, "ev_spans")), view(spark, sf, "changes"))


@query(
    "change_reasons",
    duck_with("ev_spans", "changes", req=_REQ, pairs=_PAIRS)
    + """select r.trace_id, count(p.trace_id) as correlations, coalesce(sum(p.service_match::int), 0)::bigint as matching,
      (select count(*) from changes) as changes_known, case when count(p.trace_id) = 0
        then 'no change landed within 120 minutes before this request' end as reason
    from req r left join pairs p using (trace_id) group by 1""",
)
def _(spark, sf):
    return change.change_reasons(change.request_times(view(spark, sf, "ev_spans")), view(spark, sf, "changes"))


_AFFECTED = """select advisory_id, a.package, a.ecosystem, service, min(version) as component_version
  from advisories a join components c on c.package = a.package and c.ecosystem = a.ecosystem group by 1, 2, 3, 4"""


@query("affected_services", duck_with("components", "advisories") + _AFFECTED)
def _(spark, sf):
    return change.affected_services(view(spark, sf, "advisories"), view(spark, sf, "components"))


@query(
    "advisory_impact",
    duck_with("components", "advisories", "spans", affected=_AFFECTED)
    + """, t as (select trace_id, sum(duration_ms)::bigint as total_ms from spans group by 1),
      hit as (select distinct advisory_id, trace_id, s.service from spans s join affected f on f.service = s.service)
    select advisory_id, trace_id, string_agg(service, ',' order by service) as via_services, any_value(total_ms) as total_ms
    from hit join t using (trace_id) group by 1, 2""",
)
def _(spark, sf):
    impact = change.advisory_impact(view(spark, sf, "advisories"), view(spark, sf, "components"), spans(spark, sf))
    return impact.withColumn("via_services", F.array_join("via_services", ","))


@query(
    "unknown_coverage",
    duck_with("components", "spans")
    + "select service, count(*) as hops from spans where service not in (select service from components) group by 1",
)
def _(spark, sf):
    return change.unknown_coverage(view(spark, sf, "components"), spans(spark, sf))


@query(
    "advisory_ranking",
    duck_with("components", "advisories", "spans", affected=_AFFECTED)
    + """select a.advisory_id, a.package, a.ecosystem, a.severity, count(distinct s.trace_id) as impacted_requests,
      case severity when 'critical' then 4 when 'high' then 3 when 'moderate' then 2 when 'low' then 1 else 0 end as severity_rank
    from advisories a left join affected f using (advisory_id) left join spans s on s.service = f.service group by all""",
)
def _(spark, sf):
    return change.advisory_ranking(view(spark, sf, "advisories"), view(spark, sf, "components"), spans(spark, sf))
