"""Version functions, drift rules and boundary compatibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwise.functions import versions
from spanwise.functions.timing import timing_valid
from spanwise.operators import drift, traces
from spanwise.plans.catalog_requests import EDGES
from spanwise.plans.fixtures import derive, duck_with, spans
from spanwise.plans.registry import query
from spanwise.session import keep

VERSION_PAIRS = """select p_partkey,
  concat(case when p_partkey % 11 = 0 then 'v' else '' end, cast(p_size % 4 as varchar(10)), '.', cast(p_partkey % 3 as varchar(10)),
    case when p_partkey % 2 = 0 then '.0' else '' end, case when p_partkey % 5 = 0 then '-rc.1' when p_partkey % 7 = 0 then '-beta' else '' end) as a,
  concat(cast(p_partkey % 4 as varchar(10)), '.', cast(p_size % 3 as varchar(10)), case when p_partkey % 13 = 0 then '-rc.1' else '' end) as b,
  concat(case p_partkey % 6 when 0 then '^' when 1 then '~' when 2 then '>=' when 3 then '' when 4 then '<' else '1 || ' end,
    cast(p_size as varchar(10)), '.', cast(p_partkey % 3 as varchar(10))) as declared
from part"""


def _seg(x: str) -> str:
    return (
        f"list_resize(list_transform(string_split(regexp_extract({x}, '^v?([0-9]+(?:\\.[0-9]+)*)', 1), '.'), "
        "lambda s: try_cast(s as bigint)), 6, 0)"
    )


@query(
    "version_compare",
    f"""with p as ({VERSION_PAIRS}), q as (select *, {_seg('a')} as x, {_seg('b')} as y,
        nullif(regexp_extract(a, '-(.+)$', 1), '') as pa, nullif(regexp_extract(b, '-(.+)$', 1), '') as pb from p)
    select p_partkey, a, b, case when x < y then -1 when x > y then 1 when pa is not distinct from pb then 0 when pa is null then 1
      when pb is null then -1 when pa < pb then -1 else 1 end as cmp from q""",
)
def _(spark, sf):
    rows = derive(spark, sf, VERSION_PAIRS)
    cmp = versions.compare_versions(versions.parse_version(F.col("a")), versions.parse_version(F.col("b")))
    return rows.select("p_partkey", "a", "b", cmp.alias("cmp"))


@query(
    "declared_ranges",
    f"""with p as ({VERSION_PAIRS}) select p_partkey, declared,
      case when p_partkey % 6 < 4 then p_size || '.' || p_partkey % 3 end as version, p_partkey % 6 = 3 as exact from p join part using (p_partkey)""",
)
def _(spark, sf):
    rows = derive(spark, sf, VERSION_PAIRS)
    return rows.select("p_partkey", "declared", versions.coerce_declared_range(F.col("declared")).alias("r")).select(
        "p_partkey", "declared", "r.version", "r.exact"
    )


PACKAGES = """select concat('repo-', cast(p_partkey % 50 as varchar(10))) as repo, p_brand as name, 'npm' as ecosystem,
  case when p_partkey % 9 = 0 then null else concat(cast(p_size as varchar(10)), '.', cast(p_partkey % 10 as varchar(10)), '.0') end as version,
  concat('^', cast(p_size as varchar(10))) as declared,
  case when p_partkey % 9 = 0 then 'UNKNOWN' when p_partkey % 4 = 0 then 'INFERRED' else 'OBSERVED' end as provenance,
  p_partkey as seq
from part"""
FACTS = """select concat('repo-', cast(s_suppkey % 50 as varchar(10))) as repo, 'strict' as name,
  case when max(s_suppkey) % 5 = 0 then null when max(s_acctbal) > 4000 then 'true' else 'false' end as value,
  case when max(s_suppkey) % 5 = 0 then null else 'boolean' end as value_type,
  case when max(s_suppkey) % 5 = 0 then 'UNKNOWN' else 'OBSERVED' end as provenance
from supplier group by 1"""
RULES = """select * from (values
  ('r-brand1-2', 'high', 'package', 'Brand#1', 'gte', '10', 'package', 'Brand#2', 'gte', '20.0'),
  ('r-brand3', 'low', 'package', 'Brand#3', 'lt', '40', 'package', 'Brand#4', 'minorMatch', '12.3'),
  ('r-absent', 'high', 'package', 'Brand#4', 'gt', '5', 'absent', 'Brand#5', cast(null as varchar(10)), cast(null as varchar(10))),
  ('r-fact', 'critical', 'fact', 'strict', 'boolEquals', 'true', 'package', 'Brand#6', 'majorEquals', '25'),
  ('r-needs-fact', 'low', 'package', 'Brand#7', 'lte', '30.5', 'fact', 'strict', 'boolEquals', 'true'),
  ('r-unsupported', 'low', 'package', 'Brand#8', 'approx', '1', 'package', 'Brand#9', 'gte', '1'),
  ('r-exact', 'low', 'package', 'Brand#9', 'gte', '1', 'package', 'Brand#10', 'exact', '7.1'),
  ('r-nowhere', 'low', 'package', 'Brand#11', 'gte', '0', 'package', 'Brand#99', 'gte', '1')
) as t(rule_id, severity, when_kind, when_name, when_op, when_value, require_kind, require_name, require_op, require_value)"""


def _eval(op: str, value: str, actual: str, kind: str) -> str:
    a, w = _seg(actual), _seg(value)
    return f"""case when {op} is null or {op} = 'approx' then 'UNKNOWN'
      when {op} = 'boolEquals' then case when {kind} is distinct from 'boolean' then 'UNKNOWN'
        when {actual} = {value} then 'SATISFIED' else 'VIOLATED' end
      when {kind} is distinct from 'string' then 'UNKNOWN'
      when case {op} when 'gte' then {a} >= {w} when 'gt' then {a} > {w} when 'lt' then {a} < {w} when 'lte' then {a} <= {w}
        when 'exact' then {a} = {w} when 'minorMatch' then ({a})[1:2] = ({w})[1:2] when 'majorEquals' then ({a})[1] = ({w})[1] end
      then 'SATISFIED' else 'VIOLATED' end"""


FINDINGS = f"""
select repo, rule_id, severity, when_kind, when_name, require_kind, require_name, applies, status,
  case when applies = 'UNKNOWN' then 'UNKNOWN' when require_kind = 'absent' and r_found then r_prov
    when require_kind = 'absent' then 'OBSERVED' when status = 'UNKNOWN' then 'UNKNOWN'
    when w_prov = 'OBSERVED' and r_prov = 'OBSERVED' then 'OBSERVED' else 'INFERRED' end as provenance
from (select *, case when applies = 'UNKNOWN' then 'UNKNOWN'
      when require_kind = 'absent' then case when r_found then 'VIOLATION' else 'SATISFIED' end
      when not r_found or r_value is null then 'UNKNOWN' when outcome = 'VIOLATED' then 'VIOLATION' else outcome end as status
  from (select w.repo, rules.*, w.provenance as w_prov, q.provenance as r_prov, q.name is not null as r_found, q.value as r_value,
      {_eval('when_op', 'when_value', 'w.value', 'w.value_type')} as applies,
      {_eval('require_op', 'require_value', 'q.value', 'q.value_type')} as outcome
    from rules join known w on w.kind = when_kind and w.name = when_name
    left join known q on q.repo = w.repo and q.name = require_name
      and q.kind = case when require_kind = 'absent' then 'package' else require_kind end) where applies <> 'VIOLATED')"""
DRIFT_CTES = {
    "packages": PACKAGES,
    "facts": FACTS,
    "rules": RULES,
    "known": """select repo, 'package' as kind, name, version as value, case when version is not null then 'string' end as value_type,
        provenance from (select *, row_number() over (partition by repo, name order by seq) as r from packages) where r = 1
      union all select repo, 'fact', name, value, value_type, provenance from facts""",
    "findings": FINDINGS,
}


def _findings(spark, sf):
    packages, facts, rules = (derive(spark, sf, q) for q in (PACKAGES, FACTS, RULES))
    return packages, rules, drift.check_drift(packages, facts, rules)


@query("check_drift", duck_with(**DRIFT_CTES) + "select repo, rule_id, severity, status, provenance, applies as applicability from findings")
def _(spark, sf):
    return _findings(spark, sf)[2].select("repo", "rule_id", "severity", "status", "provenance", "applicability")


_COVERED = """select repo, when_name as name from findings where when_kind = 'package'
  union select repo, require_name from findings where applies = 'SATISFIED' and require_kind in ('package', 'absent')"""


@query(
    "drift_coverage",
    duck_with(**DRIFT_CTES, covered=_COVERED)
    + """, n as (select repo, count(*) as packages_read,
        count(*) filter (where not exists (select 1 from covered c where c.repo = p.repo and c.name = p.name)) as packages_uncovered
        from packages p group by 1),
      f as (select repo, count(*) as rules_applied, count(*) filter (where status = 'VIOLATION') as violations,
        count(*) filter (where status = 'SATISFIED') as satisfied, count(*) filter (where status = 'UNKNOWN') as unknown
        from findings group by 1)
    select n.repo, packages_read, (select count(*) from covered c where c.repo = n.repo) as packages_covered, packages_uncovered,
      coalesce(rules_applied, 0) as rules_applied, coalesce(violations, 0) as violations, coalesce(satisfied, 0) as satisfied,
      coalesce(unknown, 0) as unknown, 8 as rules_loaded,
      format('{} rule(s) applied: {} VIOLATION, {} SATISFIED, {} UNKNOWN. {} of {} dependencies are covered by no rule; their compatibility is UNKNOWN.',
        coalesce(rules_applied, 0), coalesce(violations, 0), coalesce(satisfied, 0), coalesce(unknown, 0), packages_uncovered, packages_read) as summary
    from n left join f using (repo)""",
)
def _(spark, sf):
    packages, rules, findings = _findings(spark, sf)
    return drift.drift_coverage(packages, findings, rules)


@query(
    "uncovered_packages",
    duck_with(**DRIFT_CTES, covered=_COVERED)
    + """select repo, name, ecosystem, version, provenance from packages p
    where not exists (select 1 from covered c where c.repo = p.repo and c.name = p.name)""",
)
def _(spark, sf):
    packages, _, findings = _findings(spark, sf)
    return drift.uncovered_packages(packages, findings).drop("declared", "seq")


# --- along a request --------------------------------------------------------------------------

_COMPONENTS = """select trace_id, service, count(*) as hop_count,
  (list(service_version order by ingest_seq) filter (where service_version is not null))[1] as deployed_version,
  count(distinct service_version) > 1 as version_conflict,
  (list(deployment_environment order by ingest_seq) filter (where deployment_environment is not null))[1] as deployment_environment
from spans group by 1, 2"""
BINDINGS = """select distinct concat('svc-', cast(s_suppkey % 3 as varchar(10))) as service,
  concat('repo-', cast(s_suppkey % 3 as varchar(10))) as manifest_path from supplier"""
MANIFESTS = """select concat('repo-', cast(p_partkey % 50 as varchar(10))) as manifest_path, min(p_partkey) <> 2 as readable,
  case when min(p_partkey) % 2 = 0 then '1.1.0' end as declared_version from part group by 1"""


@query("path_components", duck_with("spans") + _COMPONENTS)
def _(spark, sf):
    return drift.path_components(spans(spark, sf))


_DRIFT = """select c.trace_id, c.service, c.hop_count, c.deployed_version, c.version_conflict, b.service is not null as bound,
  b.manifest_path, case when b.service is null or not m.readable then null
    when c.deployed_version is null or m.declared_version is null then 'UNKNOWN'
    when c.deployed_version = m.declared_version then 'AGREES' else 'DISAGREES' end as version_agreement,
  case when b.service is null or not m.readable then 'UNKNOWN' when v > 0 then 'VIOLATION' when n > 0 then 'CHECKED' else 'UNKNOWN' end as status,
  case when b.service is null then 'no binding declares a version source for this component'
    when not m.readable then 'bound, but the manifest could not be read' when coalesce(n, 0) = 0 then 'bound, but no rule applies' end as reason,
  case when m.readable then coalesce(v, 0) else 0 end as violations
from components_on_path c left join bindings b using (service) left join manifests m on m.manifest_path = b.manifest_path
left join (select repo, count(*) as n, count(*) filter (where status = 'VIOLATION') as v from findings group by 1) f on f.repo = b.manifest_path"""
_DRIFT_WITH = {**DRIFT_CTES, "components_on_path": _COMPONENTS, "bindings": BINDINGS, "manifests": MANIFESTS, "drift": _DRIFT}


def _drift(spark, sf):
    findings = _findings(spark, sf)[2]
    return drift.request_drift(
        drift.path_components(spans(spark, sf)), derive(spark, sf, BINDINGS), derive(spark, sf, MANIFESTS), findings
    )


@query("request_drift", duck_with("spans", **_DRIFT_WITH) + "select * from drift")
def _(spark, sf):
    return _drift(spark, sf)


@query(
    "request_drift_summary",
    duck_with("spans", **_DRIFT_WITH)
    + """, s as (select trace_id, count(*) as components, count(*) filter (where bound) as bound, count(*) filter (where not bound) as unbound,
        count(*) filter (where status = 'VIOLATION') as components_with_violations, sum(violations)::bigint as violations,
        count(*) filter (where version_agreement = 'DISAGREES') as different_build from drift group by 1)
    select *, format('{} component(s); {} bound, {} UNKNOWN. ', components, bound, unbound)
      || case when violations > 0 then format('{} violation(s) in source manifests.', violations)
         else 'No violation among the components that could be checked.' end
      || case when unbound > 0 then ' Not shown to be free of drift.' else '' end as summary from s""",
)
def _(spark, sf):
    return drift.request_drift_summary(_drift(spark, sf))


# --- boundaries -------------------------------------------------------------------------------

BUILDS = """select concat('svc-', cast(s_suppkey % 4 as varchar(10))) as service,
  concat('sha256:', repeat(cast(s_suppkey % 4 as varchar(10)), 64)) as artifact_digest, '1.1.0' as declared_version,
  case when s_suppkey % 4 = 3 then '' else 'release-team' end as declared_by, 'build-log' as evidence,
  case s_suppkey % 4 when 0 then '3.6.23' when 1 then '4.0' when 2 then '6.0.1' else '5.0' end as mongo
from (select distinct s_suppkey % 4 as s_suppkey from supplier) s"""
_NOW = 1790000000000
_RECORDED, _REVIEW = 1780000000000, 1800000000000


def _builds(spark, sf):
    def package(name, resolved):
        return F.struct(F.lit(name).alias("name"), F.lit(None).cast("string").alias("declared"), resolved.alias("resolved"))

    packages = F.array(package("pip:pymongo", F.lit("4.11.0")), package("server:mongodb", F.col("mongo")))
    return derive(spark, sf, BUILDS).withColumn("packages", packages).drop("mongo")


def _boundary_rules(spark):
    # One sourced prerequisite, once current and once past its review date.
    rows = [
        ("mongo-minimum", "pip:pymongo", "minorMatch", "4.11", "server:mongodb", "gte", "4.0", _RECORDED, _REVIEW),
        ("mongo-stale", "pip:pymongo", "minorMatch", "4.11", "server:mongodb", "gte", "4.0", _RECORDED, _RECORDED + 1),
        ("other-line", "pip:pymongo", "minorMatch", "4.10", "server:mongodb", "gte", "4.0", _RECORDED, _REVIEW),
    ]
    names = "rule_id from_package from_op from_value to_package op value recorded_ms review_by_ms".split()
    none = F.lit(None).cast("string")
    return spark.createDataFrame(rows, names).withColumns({"when_key": none, "when_value": none})


def _timed(spark, sf):
    return spans(spark, sf).withColumn("timing_valid", timing_valid(F.col("start_ns"), F.col("end_ns")))


_STATE = """case when {a}.declared_by = '' then 'INVENTORY_UNATTRIBUTED'
  when {s}.service_version is null then 'VERSION_MISSING'
  when {s}.service_version <> '1.1.0' then 'VERSION_DISAGREES' end"""
_INTACT = """select trace_id, trace_id <> repeat('0', 32) and count(*) filter (where parent_span_id is null) = 1
    and not bool_or(ext) and bool_and(start_ns is not null and end_ns >= start_ns and end_ns > 0) as intact from flagged group by 1"""
_BOUNDARY = f"""
select e.*, r.rule_id, case when c.client_package is null or not t.intact or {_STATE.format(a='a', s='c')} is not null
    or {_STATE.format(a='b', s='s')} is not null or r.stale then 'UNKNOWN'
    when {_seg('b.mongo')} >= {_seg("'4.0'")} then 'SATISFIED' else 'VIOLATED' end as status,
  array_to_string(list_filter([case when c.client_package is null then 'client package not observed' end,
    case when not t.intact then 'trace is not one intact tree' end,
    case when {_STATE.format(a='a', s='c')} is not null or {_STATE.format(a='b', s='s')} is not null
      then 'deployment inventory missing on an endpoint' end,
    case when r.stale then 'rule is stale or future-dated' end], lambda x: x is not null), '; ') as missing
from edges e join spans c on c.trace_id = e.trace_id and c.span_id = e.client_span_id
join spans s on s.trace_id = e.trace_id and s.span_id = e.server_span_id
join builds a on a.service = c.service join builds b on b.service = s.service join intact t on t.trace_id = e.trace_id
cross join (values ('mongo-minimum', false), ('mongo-stale', true)) r(rule_id, stale)"""
_BOUNDARIES = """select e.*, count(f.rule_id) as findings, case when bool_or(f.status = 'VIOLATED') then 'VIOLATED'
    when bool_and(f.status = 'SATISFIED') then 'CHECKED_PREREQUISITES' else 'UNKNOWN' end as status
  from edges e left join bfindings f on f.trace_id = e.trace_id and f.client_span_id = e.client_span_id group by all"""
_BOUNDARY_CTES = {
    "ids": "select trace_id, span_id, count(*) as n from spans group by 1, 2",
    "flagged": """select s.*, s.parent_span_id is not null and i.span_id is null as ext from spans s
      left join ids i on i.trace_id = s.trace_id and i.span_id = s.parent_span_id""",
    "intact": _INTACT, "builds": BUILDS, "edges": EDGES, "bfindings": _BOUNDARY, "boundaries": _BOUNDARIES,
}


def _boundaries(spark, sf):
    frame = _timed(spark, sf)
    edges = keep(traces.service_edges(frame), "edges")
    found = drift.boundary_findings(frame, _builds(spark, sf), _boundary_rules(spark), _NOW, edges)
    return frame, drift.boundary_compatibility(frame, found, edges)


@query(
    "deployment_evidence",
    duck_with("spans", builds=BUILDS)
    + f"""select trace_id, span_id, s.service, case when {_STATE.format(a='b', s='s')} is null then 'CORRELATED' else 'UNKNOWN' end as state,
      {_STATE.format(a='b', s='s')} as reason from spans s left join builds b on b.service = s.service""",
)
def _(spark, sf):
    evidence = drift.deployment_evidence(spans(spark, sf), _builds(spark, sf))
    return evidence.select("trace_id", "span_id", "service", "state", "reason")


@query("boundary_findings", duck_with("spans", **_BOUNDARY_CTES) + "select * from bfindings")
def _(spark, sf):
    found = drift.boundary_findings(_timed(spark, sf), _builds(spark, sf), _boundary_rules(spark), _NOW)
    return found.withColumn("missing", F.array_join("missing", "; ")).drop("reason")


@query("boundary_compatibility", duck_with("spans", **_BOUNDARY_CTES) + "select * from boundaries")
def _(spark, sf):
    return _boundaries(spark, sf)[1]


@query(
    "trace_compatibility",
    duck_with("spans", **_BOUNDARY_CTES)
    + """select t.trace_id, count(b.status) as observed_boundaries, count(*) filter (where b.status <> 'UNKNOWN') as checked_boundaries,
      case when t.intact and bool_or(coalesce(b.status = 'VIOLATED', false)) then 'VIOLATED' else 'UNKNOWN' end as status
    from intact t left join boundaries b using (trace_id) group by t.trace_id, t.intact""",
)
def _(spark, sf):
    return drift.trace_compatibility(*_boundaries(spark, sf))


EXPECTED = """select concat('svc-', cast(n_nationkey % 5 as varchar(10))) as from_service, concat('svc-', cast(n_regionkey as varchar(10))) as to_service,
  case when max(n_nationkey) % 3 = 0 then null else 'architect' end as declared_by, 'design-doc' as evidence from nation group by 1, 2"""


@query(
    "expected_coverage",
    duck_with("spans", edges=EDGES, expected=EXPECTED)
    + """, seen as (select from_service, to_service, count(*) as n from edges group by 1, 2)
    select from_service, to_service, coalesce(n, 0) as observed_edges,
      case when declared_by is not null and n > 0 then 'OBSERVED_BOUNDARY' else 'UNKNOWN' end as state,
      case when declared_by is null then 'expectation lacks attribution or evidence'
        else 'an expectation creates no edge and no compatibility' end as reason
    from expected left join seen using (from_service, to_service)""",
)
def _(spark, sf):
    return drift.expected_coverage(derive(spark, sf, EXPECTED), traces.service_edges(spans(spark, sf)))
