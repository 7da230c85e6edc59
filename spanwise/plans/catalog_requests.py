"""Requests put together from spans, their baselines and the fleet."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwise.operators import baseline, fleet, investigate, observations, traces
from spanwise.operators.ordered import running_total
from spanwise.plans.fixtures import VIEWS, derive, duck_with, once, spans, spark_sql_text, table, view
from spanwise.plans.registry import query
from spanwise.schema import ATTRIBUTES
from spanwise.session import keep

# --- oracle building blocks -------------------------------------------------------------------

IDS = "select trace_id, span_id, count(*) as n from spans group by 1, 2"
FLAGGED = """
select s.*, i.span_id is null as is_root, s.parent_span_id is not null and i.span_id is null as ext
from spans s left join ids i on i.trace_id = s.trace_id and i.span_id = s.parent_span_id"""
PROFILE = """
select f.trace_id, count(*) as span_count, sum(case when is_root then 1 else 0 end) as root_count,
  count(distinct case when ext then parent_span_id end) as external_parents,
  any_value(d.dups) as duplicate_span_ids,
  case when sum(case when is_root then 1 else 0 end) <= 1 and any_value(d.dups) = 0 then
    (list(service || '::' || name order by observed_ms, span_id) filter (where is_root))[1] end as request_key,
  sum(duration_ms) as total_ms, max(case when status <> 'OK' then 1 else 0 end) = 0 as healthy,
  min(observed_ms) as first_seen_ms, list_sort(list_distinct(list(service || '::' || name))) as structure
from flagged f join (select trace_id, sum(case when n > 1 then 1 else 0 end) as dups from ids group by 1) d
  on d.trace_id = f.trace_id
group by f.trace_id"""
SAMPLES = """
select request_key, trace_id, first_seen_ms, total_ms, array_to_string(structure, '|') as signature
from (select *, row_number() over (partition by request_key order by first_seen_ms desc, trace_id desc) as r
      from profile where request_key is not null and healthy) where r <= 200"""
COMMON = """
select request_key, signature, n from (
  select *, row_number() over (partition by request_key order by n desc, first_seen, first_id) as r from (
    select request_key, signature, count(*) as n, min(first_seen_ms) as first_seen,
      arg_min(trace_id, first_seen_ms::varchar || trace_id) as first_id
    from samples group by 1, 2)) where r = 1"""
LEARNED = """
select s.request_key, s.observations, s.observations >= 5 as ready,
  case when s.observations >= 5 then t[cast(ceil(s.observations * 0.5) as int)] end as p50,
  case when s.observations >= 5 then t[cast(ceil(s.observations * 0.95) as int)] end as p95,
  case when s.observations >= 5 then t[1] end as min_ms, case when s.observations >= 5 then t[-1] end as max_ms,
  case when s.observations >= 5 then string_split(c.signature, '|') end as structure,
  case when s.observations >= 5 then cast(c.n as double) / s.observations end as structure_agreement
from (select request_key, count(*) as observations, list_sort(list(total_ms)) as t from samples group by 1) s
join common c on c.request_key = s.request_key"""
HOPS = """
select request_key, hop, count(*) as observations, list_sort(list(ms))[cast(ceil(count(*) * 0.5) as int)] as p50,
  list_sort(list(ms))[cast(ceil(count(*) * 0.95) as int)] as p95
from (select m.request_key, p.trace_id, p.service || '::' || p.name as hop, sum(p.duration_ms) as ms
      from spans p join samples m on m.trace_id = p.trace_id group by 1, 2, 3) group by 1, 2"""
LEARN_CTES = {
    "ids": IDS, "flagged": FLAGGED, "profile": PROFILE, "samples": SAMPLES, "common": COMMON, "learned": LEARNED,
    "hop_learned": HOPS,
}
PROFILE_CTES = {k: LEARN_CTES[k] for k in ("ids", "flagged", "profile")}


def learned_from(frame):
    # One row per trace, read by the samples and by the verdicts.
    profile = keep(traces.trace_profile(frame), "profiles")
    samples = baseline.healthy_samples(profile)
    return profile, samples, baseline.baselines(samples)


# --- requests ---------------------------------------------------------------------------------


@query(
    "trace_summaries",
    duck_with("spans")
    + """select trace_id, count(*) as hop_count, cast(sum(duration_ms) as bigint) as total_ms,
      case max(case status when 'ERROR' then 2 when 'DEGRADED' then 1 else 0 end)
        when 2 then 'ERROR' when 1 then 'DEGRADED' else 'OK' end as status,
      array_to_string(list_sort(list_distinct(list(service))), ',') as services,
      (list(span_id order by duration_ms desc, ingest_seq))[1] as slowest_span_id
    from spans group by 1""",
)
def _(spark, sf):
    return traces.trace_summaries(spans(spark, sf)).select(
        "trace_id", "hop_count", "total_ms", "status", F.array_join("services", ",").alias("services"),
        F.col("slowest_hop.span_id").alias("slowest_span_id"),
    )


@query(
    "request_dna",
    duck_with("spans")
    + """select trace_id, string_agg(service, '->' order by ingest_seq) as path, count(*) as hop_count,
      cast(sum(duration_ms) as bigint) as total_ms,
      string_agg(cast(duration_ms as varchar), ',' order by ingest_seq) as latencies,
      (list(http_status order by ingest_seq) filter (where http_status is not null))[1] as http_status,
      case when count(http_status) > 0 then 'OBSERVED'
        when bool_or(status = 'ERROR') then 'UNKNOWN: a span reported an error but no HTTP status was ingested'
        else 'UNKNOWN: no HTTP status was ingested' end as http_status_provenance,
      array_to_string(list_sort(list_distinct(list(service))), ',') as dependencies,
      (select string_agg(service || '=' || v, ',' order by service) from (
         select service, (list(service_version order by ingest_seq desc))[1] as v from spans i
         where i.trace_id = o.trace_id and service_version is not null group by service)) as service_versions,
      (list(deployment_environment order by ingest_seq) filter (where deployment_environment is not null))[1]
        as deployment_environment
    from spans o group by trace_id""",
)
def _(spark, sf):
    dna = traces.request_dna(spans(spark, sf))
    versions = F.array_join(F.transform("service_versions", lambda v: F.concat_ws("=", v["service"], v["version"])), ",")
    return dna.select(
        "trace_id", "path", "hop_count", "total_ms",
        F.array_join(F.transform("hop_latencies", lambda h: h["ms"].cast("string")), ",").alias("latencies"),
        "http_status", "http_status_provenance", F.array_join("dependencies", ",").alias("dependencies"),
        versions.alias("service_versions"), "deployment_environment",
    )


@query(
    "request_path_chunks",
    duck_with("spans")
    + """select trace_id, cast(floor((ingest_seq - 1) / 3) as bigint) as chunk_no,
      string_agg(service, '->' order by ingest_seq) as path from spans group by 1, 2""",
)
def _(spark, sf):
    return traces.request_path_chunks(spans(spark, sf), chunk=3).select("trace_id", "chunk_no", "path")


_DNA = """select trace_id, string_agg(service, '->' order by ingest_seq) as path,
      cast(sum(duration_ms) as bigint) as total_ms,
      (list(http_status order by ingest_seq) filter (where http_status is not null))[1] as http_status
    from spans group by trace_id"""


@query(
    "dna_diff",
    duck_with("spans", **PROFILE_CTES, dna=_DNA)
    + """, keyed as (select d.*, p.request_key, p.healthy, p.first_seen_ms from dna d join profile p using (trace_id)
        where p.request_key is not null),
      golden as (select * from (select *, row_number() over (partition by request_key order by first_seen_ms, trace_id) r
        from keyed where healthy) where r = 1)
    select k.trace_id, k.request_key,
      (case when k.path <> g.path then 1 else 0 end) + (case when k.total_ms > g.total_ms then 1 else 0 end)
       + (case when k.http_status <> g.http_status then 1 else 0 end) as diff_count,
      k.path = g.path and k.total_ms <= g.total_ms and coalesce(k.http_status = g.http_status, true) as is_identical
    from keyed k join golden g on g.request_key = k.request_key""",
)
def _(spark, sf):
    frame = spans(spark, sf)
    profile = traces.trace_profile(frame)
    keyed = traces.request_dna(frame).join(
        profile.filter("request_key is not null").select("trace_id", "request_key", "healthy", "first_seen_ms"), "trace_id"
    )
    first = F.struct("first_seen_ms", "trace_id")
    golden = (
        keyed.filter("healthy")
        .groupBy("request_key")
        .agg(F.min_by(F.struct("path", "total_ms", "http_status"), first).alias("g"))
        .select("request_key", "g.*")
    )
    return traces.dna_diff(golden, keyed, "request_key").drop("deviations")


@query(
    "trace_shape",
    duck_with("spans", **PROFILE_CTES)
    + """select trace_id, span_count, cast(root_count as bigint) as root_count, external_parents,
      cast(duplicate_span_ids as bigint) as duplicate_span_ids from profile""",
)
def _(spark, sf):
    return traces.trace_shape(spans(spark, sf))


@query(
    "external_parents",
    duck_with("spans", ids=IDS, flagged=FLAGGED)
    + "select trace_id, parent_span_id, count(*) as children from flagged where ext group by 1, 2",
)
def _(spark, sf):
    return traces.external_parents(spans(spark, sf))


@query("request_key", duck_with("spans", **PROFILE_CTES) + "select trace_id, request_key from profile")
def _(spark, sf):
    return traces.request_key(spans(spark, sf))


@query(
    "structure_sets",
    duck_with("spans")
    + """select trace_id, array_to_string(list_sort(list_distinct(list(service || '::' || name))), '|') as signature
    from spans group by 1""",
)
def _(spark, sf):
    return traces.structure_of(spans(spark, sf)).select("trace_id", "signature")


# Exact resends, conflicting evidence, cycles and a bad id planted into the spans.
PLANTED = """
select trace_id, span_id,
  case when ingest_seq = 2 and trace_id like '%b' then lpad('4', 16, '0') else parent_span_id end as parent_span_id,
  service, duration_ms, ingest_seq from spans
union all select trace_id, span_id, parent_span_id, service, duration_ms, ingest_seq + 100 from spans
  where trace_id like '%3' and ingest_seq % 2 = 1
union all select trace_id, span_id, parent_span_id, service, duration_ms + 1, ingest_seq + 200 from spans
  where trace_id like '%5' and ingest_seq = 1"""


_TREE_FACTS = """firsts as (select *, row_number() over (partition by trace_id, span_id order by ingest_seq) as r from planted),
    uniq as (select trace_id, span_id, parent_span_id, service, duration_ms from firsts where r = 1),
    extra as (select f.trace_id, sum(case when f.duration_ms = u.duration_ms then 1 else 0 end) as same,
        count(distinct case when f.duration_ms <> u.duration_ms then f.span_id end) as conf
      from firsts f join uniq u on u.trace_id = f.trace_id and u.span_id = f.span_id where f.r > 1 group by 1),
    parented as (select u.*, p.span_id as found from uniq u left join uniq p
      on p.trace_id = u.trace_id and p.span_id = u.parent_span_id),
    grounded(trace_id, span_id) as (
      select trace_id, span_id from parented where found is null
      union select c.trace_id, c.span_id from grounded g join parented c
        on c.trace_id = g.trace_id and c.found = g.span_id),
    facts as (select p.trace_id, count(*) filter (where parent_span_id is null) as roots,
        bool_or(parent_span_id is not null and found is null) as missing, bool_or(g.span_id is null) as cyc
      from parented p left join grounded g on g.trace_id = p.trace_id and g.span_id = p.span_id group by 1)
    select f.trace_id, array_to_string(list_filter([
        case when f.trace_id = repeat('0', 32) then 'Invalid trace ID' end,
        case when roots <> 1 then 'Expected one root; observed ' || roots end,
        case when conf > 0 then 'Conflicting observations share a span ID' end,
        case when missing then 'Missing or invalid parent' end,
        case when cyc then 'Cycle in parent links' end], lambda x: x is not null), '; ') as reasons,
      cast(coalesce(same, 0) as bigint) as duplicates_collapsed, coalesce(conf, 0) as conflicts,
      case when f.trace_id <> repeat('0', 32) and roots = 1 and coalesce(conf, 0) = 0 and not missing and not cyc
        then 'OBSERVED_TREE' else 'UNKNOWN' end as state
    from facts f left join extra e on e.trace_id = f.trace_id"""


def _tree_row(frame):
    return traces.trace_tree(frame).select(
        "trace_id", F.array_join("reasons", "; ").alias("reasons"), "duplicates_collapsed",
        F.size("conflicts").cast("bigint").alias("conflicts"), "state",
    )


@query("trace_tree", duck_with("spans", planted=PLANTED) + ", " + _TREE_FACTS)
def _(spark, sf):
    planted = view(spark, sf, "spans")
    planted.createOrReplaceTempView("spans")
    return _tree_row(spark.sql(PLANTED))


# Eight traces that hold all lines: heaps, one of them with a chain a thousand spans deep, one with a cycle, one with
# missing parents, one with conflicting observations, one with a resend of every span.
_LARGE_NUMBERS = """select l_suppkey % 8 as t, row_number() over (partition by l_suppkey % 8 order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) as i, l_quantity from lineitem"""
LARGE = f"""
with n as ({_LARGE_NUMBERS}),
  s as (select t, lpad(lower(hex(t + 1)), 32, '0') as trace_id, i, case when i = 1 then null when t = 1 and i <= 1000 then i - 1
      when t = 2 and i = 5 then 10 when t = 3 and i % 97 = 0 then i + 100000000 else cast(floor(i / 2) as bigint) end as p, cast(l_quantity as bigint) as duration_ms from n)
select trace_id, lpad(lower(hex(i)), 16, '0') as span_id, lpad(lower(hex(p)), 16, '0') as parent_span_id, concat('svc-', cast(i % 5 as varchar(5))) as service,
  duration_ms, i as ingest_seq from s
union all select trace_id, lpad(lower(hex(i)), 16, '0'), lpad(lower(hex(p)), 16, '0'), concat('svc-', cast(i % 5 as varchar(5))), duration_ms, i + 500000000 from s where t = 5
union all select trace_id, lpad(lower(hex(i)), 16, '0'), lpad(lower(hex(p)), 16, '0'), concat('svc-', cast(i % 5 as varchar(5))), duration_ms + 1, i + 500000000 from s where t = 4 and i % 50 = 0"""


def large_spans(spark, sf):
    """LARGE, its lines numbered in blocks of order keys and written once: no task numbers a whole trace."""

    def numbered():
        lines = table(spark, sf, "lineitem").withColumn("t", F.expr("l_suppkey % 8"))
        order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")]
        block = F.floor(F.col("l_orderkey") / 1000)
        lines = lines.select("t", *order)
        return running_total(lines, ["t"], order, F.lit(1).cast("bigint"), block, "i", inclusive=True).select("t", "i", "l_quantity")

    once(spark, sf, "large-numbers", numbered).createOrReplaceTempView("large_numbers")
    return spark.sql(spark_sql_text(LARGE.replace(_LARGE_NUMBERS, "select t, i, l_quantity from large_numbers")))


@query("trace_tree_large", duck_with(planted=LARGE) + ", " + _TREE_FACTS)
def _(spark, sf):
    return _tree_row(large_spans(spark, sf))


@query(
    "request_dna_large",
    duck_with(planted=LARGE) + """ select trace_id, md5(string_agg(service, '->' order by ingest_seq)) as path_md5, count(*) as hop_count,
      cast(sum(duration_ms) as bigint) as total_ms from planted group by 1""",
)
def _(spark, sf):
    nothing = {"status": "string", "service_version": "string", "deployment_environment": "string", "attributes": ATTRIBUTES}
    frame = large_spans(spark, sf).withColumns({k: F.lit(None).cast(t) for k, t in nothing.items()})
    return traces.request_dna(frame).select("trace_id", F.md5("path").alias("path_md5"), "hop_count", "total_ms")


@query(
    "revisions_large",
    duck_with(planted=LARGE) + """ select 'observations of ' || trace_id as what, count(*) as observations from planted group by 1
      union all select 'traces whose revision changes with one observation', count(distinct trace_id) from planted
      union all select 'traces whose revision changes with the order of arrival', 0""",
)
def _(spark, sf):
    frame = large_spans(spark, sf)
    now = investigate.revisions(frame)
    changed = frame.withColumn("duration_ms", F.col("duration_ms") + (F.col("ingest_seq") == 1).cast("int"))
    moved = frame.withColumn("ingest_seq", -F.col("ingest_seq"))

    def differing(other, text):
        after = investigate.revisions(other).select("trace_id", F.col("revision").alias("after"))
        return now.join(after, "trace_id").agg(F.lit(text).alias("what"), F.sum((F.col("revision") != F.col("after")).cast("bigint")).alias("observations"))

    counts = now.select(F.concat(F.lit("observations of "), "trace_id").alias("what"), "observations")
    return counts.unionByName(differing(changed, "traces whose revision changes with one observation")).unionByName(
        differing(moved, "traces whose revision changes with the order of arrival")
    )


EDGES = """
select c.trace_id, c.service as from_service, min(t.service) as to_service, c.span_id as client_span_id,
  min(t.span_id) as server_span_id
from spans c join spans t on t.trace_id = c.trace_id and t.parent_span_id = c.span_id
where c.kind = 3 and t.kind = 2 and t.service <> c.service
group by c.trace_id, c.service, c.span_id having count(*) = 1"""
UNCHECKED = """
select c.trace_id, c.span_id, 'NO_UNIQUE_SERVER_CHILD' as reason from spans c
  left join edges e on e.trace_id = c.trace_id and e.client_span_id = c.span_id
  where c.kind = 3 and e.client_span_id is null
union all
select c.trace_id, c.span_id, 'CROSS_SERVICE_WITHOUT_CLIENT_SERVER' from spans c
  join spans p on p.trace_id = c.trace_id and p.span_id = c.parent_span_id
  where p.service <> c.service and not (p.kind = 3 and c.kind = 2)"""


@query("service_edges", duck_with("spans", edges=EDGES) + "select * from edges")
def _(spark, sf):
    return traces.service_edges(spans(spark, sf))


@query("unchecked_edges", duck_with("spans", edges=EDGES, unchecked=UNCHECKED) + "select * from unchecked")
def _(spark, sf):
    return traces.unchecked_edges(spans(spark, sf))


# --- observations -----------------------------------------------------------------------------

_OBS_SPLIT = """, keyed as (select *, concat_ws('/', service, duration_ms) as obs_key from span_obs),
  known as (select distinct trace_id, span_id, obs_key from keyed where arrival % 3 = 0),
  incoming as (select * from keyed where arrival % 3 <> 0)
"""


def _split_observations(spark, sf):
    rows = view(spark, sf, "span_obs").withColumn("obs_key", F.concat_ws("/", "service", "duration_ms"))
    return rows.filter("arrival % 3 = 0"), rows.filter("arrival % 3 <> 0")


@query(
    "merge_observations",
    duck_with("span_obs")
    + _OBS_SPLIT
    + """select trace_id, span_id, obs_key, min(arrival) as arrival from incoming i
    where not exists (select 1 from known k where k.trace_id = i.trace_id and k.span_id = i.span_id
                      and k.obs_key = i.obs_key) group by 1, 2, 3""",
)
def _(spark, sf):
    existing, incoming = _split_observations(spark, sf)
    merged = observations.merge_observations(existing, incoming, F.col("arrival"))
    return merged.select("trace_id", "span_id", "obs_key", "arrival")


@query(
    "merge_counts",
    duck_with("span_obs")
    + _OBS_SPLIT
    + """, v as (select i.trace_id, i.span_id, i.obs_key, count(*) as copies, bool_or(k.obs_key is not null) as known
        from incoming i left join known k on k.trace_id = i.trace_id and k.span_id = i.span_id and k.obs_key = i.obs_key
        group by 1, 2, 3),
      s as (select v.trace_id, v.span_id, sum(copies) as received, sum(case when known then 0 else 1 end) as added,
        (select count(*) from known k where k.trace_id = v.trace_id and k.span_id = v.span_id) as retained
        from v group by 1, 2)
    select trace_id, cast(sum(received) as bigint) as received, cast(sum(added) as bigint) as added,
      cast(sum(received - added) as bigint) as duplicates,
      cast(sum(case when retained > 0 then added else greatest(added - 1, 0) end) as bigint) as conflicts
    from s group by 1""",
)
def _(spark, sf):
    return observations.merge_counts(*_split_observations(spark, sf))


@query(
    "duplicate_conflicts",
    duck_with("span_obs")
    + """select trace_id, span_id, count(distinct (service, duration_ms)) as variants, count(*) as observations
    from span_obs group by 1, 2 having count(distinct (service, duration_ms)) > 1""",
)
def _(spark, sf):
    rows = view(spark, sf, "span_obs").drop("arrival", "received_ms")
    return observations.duplicate_conflicts(rows)


# --- baselines --------------------------------------------------------------------------------


@query(
    "healthy_samples",
    duck_with("spans", **PROFILE_CTES, samples=SAMPLES)
    + "select request_key, trace_id, first_seen_ms, cast(total_ms as bigint) as total_ms, signature from samples",
)
def _(spark, sf):
    samples = learned_from(spans(spark, sf))[1].drop("signature")
    return samples.withColumn("structure", F.array_join("structure", "|")).withColumnRenamed("structure", "signature")


@query(
    "baselines",
    duck_with("spans", **LEARN_CTES)
    + """select request_key, observations, ready, cast(p50 as bigint) as p50, cast(p95 as bigint) as p95,
      cast(min_ms as bigint) as min_ms, cast(max_ms as bigint) as max_ms, array_to_string(structure, '|') as structure,
      round(structure_agreement, 9) as structure_agreement from learned""",
)
def _(spark, sf):
    return learned_from(spans(spark, sf))[2].withColumns(
        {"structure": F.array_join("structure", "|"), "structure_agreement": F.round("structure_agreement", 9)}
    )


@query(
    "hop_baselines",
    duck_with("spans", **LEARN_CTES)
    + """select request_key, hop, observations, cast(p50 as bigint) as p50, cast(p95 as bigint) as p95 from hop_learned""",
)
def _(spark, sf):
    frame = spans(spark, sf)
    return baseline.hop_baselines(frame, learned_from(frame)[1])


VERDICT_SQL = """, judged as (
  select p.trace_id, p.request_key, p.total_ms, l.observations, l.p50, l.p95, l.structure_agreement as agr,
    case when p.duplicate_span_ids > 0 then 'several observations share a span id; identity is ambiguous'
      when p.root_count > 1 then p.root_count || ' independent roots over ' || p.span_count
        || ' spans: a batch, not a request'
      when p.request_key is null then 'request identity could not be established'
      when not coalesce(l.ready, false) then coalesce(l.observations, 0)
        || ' of 5 healthy observations; not measured yet' end as reason,
    list_filter(l.structure, lambda x: not list_contains(p.structure, x)) as missing,
    list_filter(p.structure, lambda x: not list_contains(l.structure, x)) as added,
    greatest(l.p95 * 1.5, l.p95 + 50) as threshold
  from profile p left join learned l on l.request_key = p.request_key)
select trace_id, request_key, cast(total_ms as bigint) as total_ms, reason,
  case when request_key is not null then coalesce(observations, 0) end as observations,
  case when reason is not null then 'UNKNOWN'
    when len(missing) + len(added) > 0 or total_ms > threshold then 'DEVIATION' else 'HEALTHY' end as verdict,
  case when reason is null then array_to_string(list_concat(
    [ 'STRUCTURE_MISSING:usual hop absent: ' || x for x in missing ],
    [ 'STRUCTURE_ADDED:hop outside the usual structure: ' || x for x in added ],
    case when total_ms > threshold then ['LATENCY:total ' || total_ms || 'ms above '
      || cast(floor(threshold + 0.5) as bigint) || 'ms'] else [] end), ';') end as deviations
from judged"""


@query("baseline_verdict", duck_with("spans", **LEARN_CTES) + VERDICT_SQL)
def baseline_verdict(spark, sf):
    profile, _, learned = learned_from(spans(spark, sf))
    text = F.transform("deviations", lambda d: F.concat_ws(":", d["type"], d["detail"]))
    return (
        baseline.baseline_verdict(profile, learned)
        .withColumn("deviations", F.array_join(text, ";"))
        .drop("baseline_source")
    )


@query(
    "baseline_summary",
    duck_with("spans", **LEARN_CTES)
    + "select request_key, observations, ready, cast(p95 as bigint) as p95 from learned",
)
def _(spark, sf):
    return baseline.baseline_summary(learned_from(spans(spark, sf))[2])


@query(
    "baseline_asof",
    duck_with("spans", **PROFILE_CTES)
    + """, numbered as (select *, sum(case when healthy then 1 else 0 end) over (partition by request_key
          order by first_seen_ms, trace_id rows between unbounded preceding and 1 preceding) as b
        from profile where request_key is not null),
      s as (select request_key, coalesce(b, 0) as b, total_ms from numbered where healthy),
      w as (select request_key, b + 1 as b, list_sort(list(total_ms) over (partition by request_key order by b
          rows between 199 preceding and current row)) as t from s)
    select n.trace_id, n.request_key, coalesce(len(t), 0) as prior_observations,
      case when len(t) >= 5 then cast(t[cast(ceil(len(t) * 0.95) as int)] as bigint) end as prior_p95,
      cast(n.total_ms as bigint) as total_ms,
      case when coalesce(len(t), 0) < 5 then 'UNKNOWN'
        when n.total_ms > greatest(t[cast(ceil(len(t) * 0.95) as int)] * 1.5, t[cast(ceil(len(t) * 0.95) as int)] + 50)
        then 'DEVIATION' else 'HEALTHY' end as latency_verdict
    from numbered n left join w on w.request_key = n.request_key and w.b = coalesce(n.b, 0)""",
)
def _(spark, sf):
    return baseline.baseline_asof(keep(traces.trace_profile(spans(spark, sf)), "profiles"))


# --- fleet ------------------------------------------------------------------------------------


@query(
    "service_rollup",
    duck_with("spans", "components")
    + """select s.service, count(*) as hops, sum(case when status = 'DEGRADED' then 1 else 0 end)::bigint as degraded,
      sum(case when status = 'ERROR' then 1 else 0 end)::bigint as errors, sum(duration_ms)::bigint as total_ms,
      cast(floor(sum(duration_ms) / count(*)::double + 0.5) as bigint) as avg_ms,
      s.service in (select service from components) as inventory_known
    from spans s group by 1""",
)
def _(spark, sf):
    return fleet.service_rollup(spans(spark, sf), view(spark, sf, "components"))


INCIDENTS = """
select trace_id, case when bool_or(status = 'ERROR') then 'ERROR' else 'DEGRADED' end as severity,
  sum(duration_ms)::bigint as total_ms,
  (list(service order by ingest_seq) filter (where status <> 'OK'))[1] as first_service,
  (list(duration_ms order by ingest_seq) filter (where status <> 'OK'))[1] as first_duration_ms,
  min(observed_ms) as observed_ms, array_to_string(list_sort(list_distinct(list(service))), ',') as services
from spans group by 1 having bool_or(status <> 'OK')"""


@query(
    "incidents",
    duck_with("spans", incidents=INCIDENTS)
    + "select * from incidents order by case when severity = 'ERROR' then 0 else 1 end, total_ms desc, trace_id limit 100",
)
def _(spark, sf):
    return fleet.incidents(spans(spark, sf)).withColumn("services", F.array_join("services", ","))


@query("all_incidents", duck_with("spans", incidents=INCIDENTS) + "select * from incidents")
def _(spark, sf):
    return fleet.all_incidents(spans(spark, sf)).withColumn("services", F.array_join("services", ","))


@query(
    "incident_clusters",
    duck_with("spans", incidents=INCIDENTS)
    + """select first_service as service, count(*) as incidents, array_to_string((list(trace_id order by
        case when severity = 'ERROR' then 0 else 1 end, total_ms desc, trace_id))[1:10], ',') as trace_ids
    from incidents group by 1""",
)
def _(spark, sf):
    return fleet.incident_clusters(spans(spark, sf)).withColumn("trace_ids", F.array_join("trace_ids", ","))


@query(
    "coverage",
    duck_with("spans", "components", "changes", "advisories")
    + """select count(*) as services_seen, count(c.service) as services_with_inventory,
      string_agg(case when c.service is null then s.service end, ',' order by s.service) as services_unknown,
      (select count(*) from changes) as changes_known, (select count(*) from advisories) as advisories_known
    from (select distinct service from spans) s left join (select distinct service from components) c using (service)""",
)
def _(spark, sf):
    return fleet.coverage(
        spans(spark, sf), view(spark, sf, "components"), view(spark, sf, "changes"), view(spark, sf, "advisories")
    ).withColumn("services_unknown", F.array_join("services_unknown", ","))


@query(
    "fleet_overview",
    duck_with("spans", "components", "changes", "advisories", incidents=INCIDENTS)
    + """, svc as (select service, count(*) as hops, sum(case when status = 'DEGRADED' then 1 else 0 end) as degraded,
        sum(case when status = 'ERROR' then 1 else 0 end) as errors, sum(duration_ms) as total_ms,
        floor(sum(duration_ms) / count(*)::double + 0.5) as avg_ms from spans group by 1),
      u as (
        select 'total' as section, 'all' as name, 'traces' as metric, count(distinct trace_id) as value from spans
        union all select 'total', 'all', 'incidents', count(*) from incidents
        union all select 'service', service, 'hops', hops from svc
        union all select 'service', service, 'degraded', degraded from svc
        union all select 'service', service, 'errors', errors from svc
        union all select 'service', service, 'total_ms', total_ms from svc
        union all select 'service', service, 'avg_ms', avg_ms from svc
        union all select 'cluster', first_service, 'incidents', count(*) from incidents group by 2
        union all select 'coverage', 'all', 'services_seen', count(distinct service) from spans
        union all select 'coverage', 'all', 'services_with_inventory', count(distinct service) from spans
          where service in (select service from components)
        union all select 'coverage', 'all', 'changes_known', count(*) from changes
        union all select 'coverage', 'all', 'advisories_known', count(*) from advisories)
    select section, name, metric, cast(value as bigint) as value from u""",
)
def _(spark, sf):
    return fleet.fleet_overview(
        spans(spark, sf), view(spark, sf, "components"), view(spark, sf, "changes"), view(spark, sf, "advisories")
    )


@query(
    "lag_metrics",
    duck_with("collections")
    + """, r as (select *, row_number() over (partition by source order by collected_ms desc, event_id desc) as r,
        count(*) over (partition by source) as collected from collections),
      l as (select source, any_value(collected) as collected, list_sort(list(lag_ms)) as x, avg(lag_ms) as m
        from r where r <= 1000 group by 1)
    select source, collected, round(m, 2) as avg_lag_ms, x[cast(floor(len(x) * 0.5) as int) + 1] as p50_lag_ms,
      x[cast(floor(len(x) * 0.95) as int) + 1] as p95_lag_ms, x[-1] as max_lag_ms from l""",
)
def _(spark, sf):
    return fleet.lag_metrics(view(spark, sf, "collections"))


_SCORES = """
select service, cast(100 as double) as structural,
  case when service = 'svc-3' then null else 100.0 * sum(case when duration_ms <= 1500 then 1 else 0 end) / count(*) end as performance,
  100.0 * sum(case when http_status < 400 then 1 else 0 end) / count(*) as semantic,
  100.0 * count(service_version) / count(*) as dependency,
  100.0 * count(deployment_environment) / count(*) as infrastructure,
  cast(100 as double) as change, 100.0 * sum(case when status = 'OK' then 1 else 0 end) / count(*) as causal
from spans group by service"""


def _scores(spark, sf):
    view(spark, sf, "spans").createOrReplaceTempView("spans")
    scores = spark.sql(_SCORES)
    return scores.select("service", *[F.col(d).cast("double").alias(d) for d in fleet.RTI_DIMENSIONS])


_RTI = """round((structural + performance + semantic + dependency + infrastructure + change + causal)::double / 7, 1)"""


@query(
    "rti",
    duck_with("spans", scores=_SCORES)
    + f"select service, {_RTI} as rti, case when performance is null then 'performance' else '' end as gaps from scores",
)
def _(spark, sf):
    return fleet.rti(_scores(spark, sf)).select("service", "rti", F.array_join("gaps", ",").alias("gaps"))


@query(
    "journey_rti",
    duck_with("spans", scores=_SCORES)
    + f"""select case when count(performance) = count(*) then round(sum({_RTI} * case service when 'svc-0' then 0.4 when 'svc-1' then 0.3
      when 'svc-2' then 0.2 else 0.1 end), 1) end as weighted_rti, count(*) as journeys from scores""",
)
def _(spark, sf):
    # Every service, also the one with an unknown dimension.
    scored = fleet.rti(_scores(spark, sf)).withColumnRenamed("service", "journey")
    return fleet.journey_rti(scored, {"svc-0": 0.4, "svc-1": 0.3, "svc-2": 0.2, "svc-3": 0.1})


def _json_bytes() -> str:
    """Bytes of a span as JSON, nulls left out, in SQL."""
    texts = "trace_id span_id parent_span_id service name status service_version artifact_digest deployment_environment".split()
    numbers = "kind duration_ms observed_ms received_ms otel_status_code start_ns end_ns ingest_seq".split()
    parts = [f"coalesce(strlen({c}::varchar) + {len(c) + 4 + 2 * (c in texts)}, 0)" for c in texts + numbers]
    attributes = {
        "http.response.status_code": "http_status", "db.connection_pool.saturation_pct": "db_pool_pct", "db.cpu_utilization_pct": "db_cpu_pct",
        "db.query.fingerprint": "db_fingerprint", "db.lock_wait_ms": "db_lock_wait_ms", "db.holding_lock_pid": "db_holder_pid",
        "db.blocking_trace_id": "db_blocking_trace", "client.package": "client_package",
    }
    strings = ("db_fingerprint", "db_blocking_trace", "client_package")
    for key, c in attributes.items():
        kind = "stringValue" if c in strings else "intValue"
        around = len('{"key":"' + key + '","value":{"' + kind + '":""}}') + 1
        parts.append(f"coalesce(strlen({c}::varchar) + {around}, 0)")
    none = f"coalesce({', '.join(f'{c}::varchar' for c in attributes.values())}) is null"
    return " + ".join(parts) + f" + {len('{"attributes":[]}')} - case when {none} then 0 else 1 end"


@query(
    "storage_report",
    duck_with("spans")
    + f"""select measure, used, maximum, case when used > maximum then 'EXCEEDED' else 'WITHIN' end as state from (
      select 'traces' as measure, count(distinct trace_id) as used, 10000 as maximum from spans
      union all select 'spans', count(*), 100000 from spans
      union all select 'bytes', sum({_json_bytes()})::bigint, {32 << 20} from spans)""",
)
def _(spark, sf):
    return fleet.storage_report(spans(spark, sf), {"traces": 10000, "spans": 100000, "bytes": 32 << 20})


_NOW = 946684800000


@query(
    "retention_review",
    duck_with("spans")
    + f"""select trace_id, max(received_ms) as latest_ms, case when max(received_ms) > {_NOW} then 'UNKNOWN_AGE'
      when {_NOW} - max(received_ms) >= 2592000000 then 'REVIEW_REQUIRED' else 'HELD' end as review
    from spans group by 1""",
)
def _(spark, sf):
    return fleet.retention_review(spans(spark, sf), _NOW)
