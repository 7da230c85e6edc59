"""Scalar functions and source readers, fed with text that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwise.functions import attributes, context, identity, numbers, provenance, text, timing
from spanwise.plans.fixtures import derive, duck_sql_text, duck_with, spans, spread, view
from spanwise.plans.registry import query
from spanwise.sources import changes, envelopes, inventory, manifests, monitoring, otlp, rules

# --- scalar functions -------------------------------------------------------------------------

PLANTED_TEXT = """select doc_id, concat(text, case doc_id % 5 when 0 then concat(' ssn 123-45-', lpad(cast(doc_id % 10000 as varchar(10)), 4, '0'), ' end')
  when 1 then ' password: hunter2 &x' when 2 then ' Authorization: Bearer abc.def-123== ok' when 3 then ' CVV=123, card 4111 1111 1111 1111.'
  else ' sk_live_abcdefghijklmnopqrstuvwx postgres://u:p@host' end) as text from documents"""
# The sensitive patterns in RE2 spelling.
_RE2 = (
    ("PAN / Credit Card", r"\b(?:[0-9][ -]*?){13,16}\b", "[REDACTED_PAN]", "g"),
    ("CVV / CVC", r"\b(?:cvv|cvc|security_code)[\s\x0b]*[:=][\s\x0b]*[\"'']?[0-9]{3,4}[\"'']?", "cvv=[REDACTED_CVV]", "gi"),
    ("Password / Secret", r"\b(?:password|passwd|secret|api_key)[\s\x0b]*[:=][\s\x0b]*[\"'']?[^\"''&\s\x0b]+[\"'']?",
     "password=[REDACTED_SECRET]", "gi"),
    ("Bearer Token", r"Bearer[\s\x0b]+[A-Za-z0-9\-._~+/]+=*", "Bearer [REDACTED_TOKEN]", "gi"),
    ("SSN / Tax ID", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "[REDACTED_SSN]", "g"),
)


def _re2_redact(column: str) -> str:
    for _, pattern, mask, flags in _RE2:
        column = f"regexp_replace({column}, '{pattern}', '{mask}', '{flags}')"
    return column


@query("redact_text", f"with p as ({PLANTED_TEXT}) select doc_id, {_re2_redact('text')} as text from p")
def _(spark, sf):
    return spread(derive(spark, sf, PLANTED_TEXT)).select("doc_id", text.redact_text(F.col("text")).alias("text"))


@query(
    "leak_audit",
    f"with p as ({PLANTED_TEXT}) "
    + " union all ".join(
        f"""select doc_id, '{name}' as pattern, len(regexp_extract_all(text, '{pattern}', 0, '{flags[1:]}')) as match_count,
        left(regexp_extract(text, '{pattern}', 0, '{flags[1:]}'), 4) as sample from p
        where regexp_matches(text, '{pattern}', '{flags[1:]}')"""
        for name, pattern, _, flags in _RE2
    ),
)
def _(spark, sf):
    return text.leak_audit(spread(derive(spark, sf, PLANTED_TEXT)), "text", ["doc_id"])


@query(
    "bundle_audit",
    f"""with p as ({PLANTED_TEXT}) select doc_id, 'payment live key' as pattern, 1 as match_count, 'sk_l' as sample from p where doc_id % 5 = 4
    union all select doc_id, 'database url', 1, 'post' from p where doc_id % 5 = 4""",
)
def _(spark, sf):
    return text.bundle_audit(spread(derive(spark, sf, PLANTED_TEXT)), "text", ["doc_id"])


RECORDS = """select event_id, concat('{"user":{"password":"p', cast(event_id as varchar(20)), '","note":"Bearer abc.x"},"card_no":"4111222233334444","items":[',
  cast(event_id % 9 as varchar(10)), ',"123-45-6789"]}') as record from events"""


@query(
    "redact_record",
    """select event_id, '{"user":{"password":"[REDACTED_FIELD]","note":"Bearer [REDACTED_TOKEN]"},"card_no":"[REDACTED_PAN]","items":['
      || event_id % 9 || ',"[REDACTED_SSN]"]}' as record,
      '{"user":{"password":"[REDACTED_SECRET]","note":"Bearer abc.x"},"card_no":"***4444","items":[' || event_id % 9 || ',"123-45-6789"]}' as mobile
    from events""",
)
def _(spark, sf):
    return derive(spark, sf, RECORDS).select(
        "event_id", text.redact_record("record").alias("record"), text.redact_mobile_record("record").alias("mobile")
    )


KEYS = """select event_id, case event_id % 12 when 0 then 'trace_id' when 1 then 'x-HTTP.Route' when 2 then 'service.name' when 3 then 'HOST.NAME'
  when 4 then 'tenant.tier' when 5 then 'customer.id' when 6 then 'auth.token' when 7 then 'app.user.password.hash' when 8 then 'color'
  when 9 then 'my.order.uuid' when 10 then 'rpc.method' else 'parent_span_id' end as key from events"""


@query(
    "attribute_tiers",
    f"""with k as ({KEYS}) select key, case when key in ('trace_id', 'parent_span_id') then 'IDENTITY' when key = 'service.name' then 'SERVICE'
      when key = 'HOST.NAME' then 'RESOURCE' when key in ('x-HTTP.Route', 'rpc.method') then 'REQUEST' when key = 'tenant.tier' then 'BUSINESS'
      when key in ('customer.id', 'my.order.uuid') then 'HIGH_CARDINALITY' when key in ('auth.token', 'app.user.password.hash') then 'SENSITIVE'
      else 'UNCLASSIFIED' end as tier, count(*) as uses from k group by all""",
)
def _(spark, sf):
    keys = derive(spark, sf, KEYS)
    return keys.groupBy("key", attributes.attribute_tier(F.col("key")).alias("tier")).agg(F.count(F.lit(1)).alias("uses"))


@query(
    "index_policy",
    f"""with k as ({KEYS}) select event_id, case when event_id % 12 in (5, 6, 7, 9) then 0 else 1 end + 1 as primary_keys,
      case when event_id % 12 in (5, 9) then 1 else 0 end as unindexed_keys, case when event_id % 12 in (6, 7) then 1 else 0 end as masked_keys from k""",
)
def _(spark, sf):
    keys = derive(spark, sf, KEYS).withColumn("p", attributes.index_policy(F.array("key", F.lit("span_id"))))
    return keys.select("event_id", *[F.size(f"p.{n}").alias(n) for n in ("primary_keys", "unindexed_keys", "masked_keys")])


@query(
    "span_attributes",
    duck_with("spans")
    + """select trace_id, span_id, http_status, false as http_conflict, db_pool_pct::double as pool_pct, client_package, name like '%query%' as is_db,
      db_fingerprint as fingerprint from spans""",
)
def _(spark, sf):
    a = F.col("attributes")
    return spans(spark, sf).withColumn("h", attributes.http_status(a)).select(
        "trace_id", "span_id", F.col("h.value").alias("http_status"), F.col("h.conflict").alias("http_conflict"),
        attributes.attr_number(a, "db.connection_pool.saturation_pct").alias("pool_pct"),
        attributes.attr_strict(a, "client.package").alias("client_package"),
        attributes.is_db_hop(F.col("service"), F.col("name"), a).alias("is_db"),
        attributes.attr(a, "db.query.fingerprint").alias("fingerprint"),
    )


@query(
    "span_timing",
    duck_with("spans")
    + """select trace_id, span_id, coalesce(end_ns >= start_ns, false) as timing_valid,
      case when end_ns >= start_ns then (end_ns - start_ns) / 1e6 end as timing_ms,
      case when otel_status_code = 2 then 'ERROR' when duration_ms > 2000 then 'DEGRADED' else 'OK' end as status from spans""",
)
def _(spark, sf):
    start, end = F.col("start_ns"), F.col("end_ns")
    named = F.when(F.col("otel_status_code") == 2, "STATUS_CODE_ERROR").otherwise("STATUS_CODE_OK")
    return view(spark, sf, "spans").select(
        "trace_id", "span_id", timing.timing_valid(start, end).alias("timing_valid"), timing.timing_ms(start, end).alias("timing_ms"),
        timing.span_status(named, F.col("duration_ms")).alias("status"),
    )


HEADERS = """select o_orderkey, concat(case o_orderkey % 9 when 1 then 'ff' when 2 then '0' else '00' end, '-', lpad(lower(hex(o_orderkey)), 32, '0'), '-',
  case when o_orderkey % 9 = 3 then '0000000000000000' else lpad(upper(hex(o_custkey + 1)), 16, '0') end, '-', case when o_orderkey % 2 = 0 then '01' else '00' end,
  case when o_orderkey % 9 = 4 then '-x' else '' end) as header from orders"""


@query(
    "traceparent_parse",
    f"""with h as ({HEADERS}), p as (select *, o_orderkey % 9 not in (1, 2, 3, 4) and o_orderkey <> 0 as ok, string_split(header, '-') as x from h)
    select o_orderkey, case when ok then lower(x[2]) end as trace_id, case when ok then lower(x[3]) end as span_id,
      case when ok then o_orderkey % 2 = 0 end as sampled, case when ok then lower(header) end as formatted from p""",
)
def _(spark, sf):
    rows = derive(spark, sf, HEADERS).withColumn("t", context.parse_traceparent(F.col("header")))
    formatted = context.format_traceparent(F.col("t.trace_id"), F.col("t.span_id"), F.col("t.sampled"))
    return rows.select("o_orderkey", "t.trace_id", "t.span_id", "t.sampled", formatted.alias("formatted"))


IDS = """select o_orderkey, lpad(lower(hex(o_orderkey)), 32, '0') as trace_id, lpad(lower(hex(o_custkey)), 16, '0') as span_id,
  lpad(hex(o_custkey * 100000007), 16, 'a') as wide_span_id, o_orderpriority as label from orders"""


@query(
    "db_client_info",
    f"""with i as ({IDS}), e as (select *, case when o_orderkey <> 0 then left(regexp_replace(label, '\\s+', '-', 'g'), 24) || ' vt=' || trace_id end as encoded from i)
    select o_orderkey, encoded, case when o_orderkey <> 0 then trace_id end as decoded from e""",
)
def _(spark, sf):
    rows = derive(spark, sf, IDS).withColumn("encoded", context.encode_db_client_info(F.col("trace_id"), F.col("label")))
    return rows.select("o_orderkey", "encoded", context.decode_db_client_info(F.upper("encoded")).alias("decoded"))


@query(
    "mq_correl_id",
    f"""with i as ({IDS}) select o_orderkey, case when o_orderkey <> 0 then upper('56544c53' || trace_id || left(lower(wide_span_id), 8)) end as encoded,
      case when o_orderkey <> 0 then trace_id end as decoded, case when o_orderkey <> 0 then left(lower(wide_span_id), 8) end as span_prefix from i""",
)
def _(spark, sf):
    rows = derive(spark, sf, IDS).withColumn("encoded", F.hex(context.encode_mq_correl_id(F.col("trace_id"), F.col("wide_span_id"))))
    decoded = context.decode_mq_correl_id(F.concat(F.lit("0x"), F.col("encoded")))
    return rows.withColumn("d", decoded).select(
        "o_orderkey", "encoded", F.col("d.trace_id").alias("decoded"), F.col("d.span_id_prefix").alias("span_prefix")
    )


STATEMENTS = """select o_orderkey, concat('SELECT  * FROM t', cast(o_custkey % 50 as varchar(10)), ' WHERE id = ', cast(o_orderkey as varchar(20)), ' AND s = ''',
  o_orderstatus, ' 7''  LIMIT 10') as q from orders"""


@query(
    "sql_fingerprint",
    f"""with s as ({STATEMENTS}) select o_orderkey,
      left(trim(regexp_replace(regexp_replace(regexp_replace(q, '\\s+', ' ', 'g'), '\\b\\d+\\b', 'N', 'g'), '''[^'']*''', '''?''', 'g')), 120) as fingerprint
    from s""",
)
def _(spark, sf):
    return derive(spark, sf, STATEMENTS).select("o_orderkey", text.sql_fingerprint(F.col("q")).alias("fingerprint"))


QUEUES = """select p_partkey, case when p_partkey % 11 = 0 then null else cast(p_size * 20 as bigint) end as depth,
  case when p_partkey % 4 = 0 then null when p_partkey % 9 = 0 then 0 else 1000 end as max_depth,
  case when p_partkey % 5 = 0 then 0 when p_partkey % 7 = 0 then null else 2 end as open_inputs from part"""


@query(
    "queue_assess",
    f"""with q as ({QUEUES}), s as (select *, case when max_depth <> 0 then cast(floor(depth * 100.0 / max_depth + 0.5) as bigint) end as sat from q)
    select p_partkey, case when max_depth > 0 then sat end as saturation_pct,
      case when depth is null then 'UNKNOWN' when depth > 0 and open_inputs = 0 then 'FAILED' when sat >= 80 then 'DEGRADED'
        when sat is null and depth > 500 then 'DEGRADED' else 'SUCCESS' end as status,
      case when depth is null then 'Queue depth was not reported' when depth > 0 and open_inputs = 0
          then depth || ' message(s) queued and no open input handle: nothing is consuming'
        when sat >= 80 then 'Queue is ' || sat || '% of its maximum depth'
        when sat is null and depth > 500 then 'Queue depth ' || depth || '; maximum unknown, saturation not computed'
        else 'Queue depth ' || depth end as reason from s""",
)
def _(spark, sf):
    rows = derive(spark, sf, QUEUES)
    verdict = numbers.assess_queue(F.col("depth"), F.col("max_depth"), F.col("open_inputs"))
    return rows.select(
        "p_partkey", numbers.saturation_pct(F.col("depth"), F.col("max_depth")).alias("saturation_pct"), verdict.alias("v")
    ).select("p_partkey", "saturation_pct", "v.status", "v.reason")


@query(
    "buffer_hit_ratio",
    """select p_partkey, case when p_size % 10 <> 0 then floor((p_size % 10 * 100 - p_partkey % 90) / (p_size % 10 * 100) * 1000 + 0.5) / 10 end as hit_pct
    from part""",
)
def _(spark, sf):
    reads = derive(spark, sf, "select p_partkey, p_size % 10 * 100 as logical, p_partkey % 90 as physical from part")
    return reads.select("p_partkey", numbers.buffer_hit_ratio(F.col("logical"), F.col("physical")).alias("hit_pct"))


@query(
    "content_hash",
    duck_with("span_obs")
    + """select trace_id, span_id, arrival, sha256('{"duration_ms":' || duration_ms || ',"service":"' || service || '","span_id":' || span_id || ',"trace_id":' || trace_id || '}') as obs_key
    from span_obs""",
)
def _(spark, sf):
    rows = view(spark, sf, "span_obs")
    key = identity.observation_key(rows.drop("arrival"))
    return rows.select("trace_id", "span_id", "arrival", key.alias("obs_key"))


@query(
    "provenance_labels",
    """select n_nationkey, 'CORRELATED' as stage, 'REAL' as source_type, case when n_nationkey % 2 = 0 then '' else 'unknown stage' end as errors from nation""",
)
def _(spark, sf):
    rows = provenance.labelled(derive(spark, sf, "select n_nationkey from nation"), "CORRELATED", "REAL")
    claimed = F.when(F.col("n_nationkey") % 2 == 0, F.col("stage")).otherwise("PROVEN")
    return rows.withColumn("errors", F.array_join(provenance.label_errors(claimed, F.col("source_type")), ","))


# --- ingest -----------------------------------------------------------------------------------


def otlp_payloads(spark, sf):
    """OTLP JSON of up to 100 spans of a trace each, written from the span view."""

    def attribute(key, value, kind="stringValue"):
        return F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), F.struct(value.cast("string").alias(kind)).alias("value")))

    c = F.col
    resource = F.array_compact(
        F.array(
            attribute("service.name", c("service")), attribute("service.version", c("service_version")),
            attribute("deployment.environment", c("deployment_environment")), attribute("acme.artifact.digest", c("artifact_digest")),
        )
    )
    owned = F.array_compact(F.array(attribute("user.password", F.lit("hunter2")), attribute("note", F.lit("Bearer abc123"))))
    code = F.when((c("otel_status_code") == 2) & (c("ingest_seq") % 2 == 0), "STATUS_CODE_ERROR").otherwise(c("otel_status_code").cast("string"))
    nameless = c("trace_id").endswith("7") & (c("ingest_seq") == 2)
    span = F.struct(
        c("trace_id").alias("traceId"), F.when(nameless, "").otherwise(c("span_id")).alias("spanId"), c("parent_span_id").alias("parentSpanId"),
        F.concat("name", F.lit(" card 4111111111111111")).alias("name"), c("kind"), c("start_ns").cast("string").alias("startTimeUnixNano"),
        c("end_ns").cast("string").alias("endTimeUnixNano"), c("duration_ms").alias("durationMs"), F.struct(code.alias("code")).alias("status"),
        owned.alias("attributes"),
    )
    entry = F.struct(
        "ingest_seq", F.struct(resource.alias("attributes")).alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans")
    )
    grouped = view(spark, sf, "spans").groupBy("trace_id", F.floor(c("ingest_seq") / 100).alias("part")).agg(
        F.sort_array(F.collect_list(entry)).alias("resourceSpans")
    )
    return grouped.select(
        F.concat_ws("-", "trace_id", c("part").cast("string")).alias("payload_id"), c("part").alias("payload_seq"),
        F.lit(1_700_000_000_000).alias("received_ms"), F.to_json(F.struct("resourceSpans")).alias("payload"),
    )


TAINTED = "select trace_id from spans where trace_id like '%7' and ingest_seq = 2"


@query(
    "spans_from_otlp_json",
    duck_with("spans", tainted=TAINTED)
    + """, t as (select *, case when start_ns is not null then cast(floor((end_ns - start_ns) / 1e6 + 0.5) as bigint) when duration_ms = 0 then 10
        else duration_ms end as ms from spans where trace_id not in (select trace_id from tainted))
    select trace_id, span_id, parent_span_id, kind, service, name || ' card [REDACTED_PAN]' as name,
      case when end_ns >= start_ns then (end_ns - start_ns) / 1e6 end as timing_ms, ms as duration_ms,
      case when start_ns is null then 1700000000000 else cast(floor(start_ns / 1e6 + 0.5) as bigint) end as observed_ms,
      case when otel_status_code = 2 then 'ERROR' when ms > 2000 then 'DEGRADED' else 'OK' end as status, otel_status_code,
      service_version, case when service_version is not null then artifact_digest end as artifact_digest, deployment_environment,
      '[REDACTED_FIELD]' as password, 'Bearer [REDACTED_TOKEN]' as note from t""",
)
def _(spark, sf):
    good, _ = otlp.spans_from_otlp_json(otlp_payloads(spark, sf))
    a = F.col("attributes")
    return good.select(
        "trace_id", "span_id", "parent_span_id", "kind", "service", "name", "timing_ms", "duration_ms", "observed_ms", "status",
        "otel_status_code", "service_version", "artifact_digest", "deployment_environment",
        attributes.attr(a, "user.password").alias("password"), attributes.attr(a, "note").alias("note"),
    )


@query(
    "otlp_rejects",
    duck_with("spans", tainted=TAINTED)
    + """select trace_id, case when ingest_seq = 2 then '' else span_id end as span_id, case when ingest_seq = 2 then 'span without trace or span id'
      else 'payload holds a span without trace or span id' end as reason from spans where trace_id in (select trace_id from tainted)""",
)
def _(spark, sf):
    return otlp.spans_from_otlp_json(otlp_payloads(spark, sf))[1].select("trace_id", "span_id", "reason")


LOGS = """select concat('p', cast(event_id as varchar(20))) as payload_id, concat('{"resourceLogs":[{"body":"Bearer abc","n":', cast(event_id as varchar(20)),
  '},{"token":"t","ok":true}]}') as payload from events"""


@query(
    "records_from_otlp_json",
    """select 'p' || event_id as payload_id, 0 as position, '{"body":"Bearer [REDACTED_TOKEN]","n":' || event_id || '}' as record from events
    union all select 'p' || event_id, 1, '{"token":"[REDACTED_FIELD]","ok":true}' from events""",
)
def _(spark, sf):
    return otlp.records_from_otlp_json(derive(spark, sf, LOGS), "logs")


RAW_CHANGES = """select event_id, case when event_id % 3 = 0 then null else concat('C', cast(event_id as varchar(20))) end as id,
  case event_id % 4 when 0 then cast(epoch_ms(ts) as varchar(20))
    when 1 then concat(substr(cast(ts as varchar(40)), 1, 10), 'T', substr(cast(ts as varchar(40)), 12, 8), 'Z')
    when 2 then '' else 'yesterday' end as timestamp,
  case when event_id % 5 = 0 then '' else 'DEPLOY' end as type, concat('svc-', cast(user_id % 6 as varchar(10))) as service
from events"""


@query(
    "load_changes",
    duck_sql_text(
        """with e as (select *, case event_id % 4 when 0 then epoch_ms(ts) else epoch_ms(ts) // 1000 * 1000 end as ms from events where event_id % 4 < 2)
    select case when event_id % 3 = 0 then 'CHG-' || ms else 'C' || event_id end as change_id, ms as change_ms,
      case when event_id % 5 = 0 then 'UNKNOWN' else 'DEPLOY' end as change_type, 'svc-' || user_id % 6 as service from e"""
    ),
)
def _(spark, sf):
    accepted, _ = changes.load_changes(derive(spark, sf, RAW_CHANGES))
    return accepted.select("change_id", "change_ms", "change_type", "service")


@query(
    "rejected_changes",
    """select case when event_id % 3 = 0 then '(no id)' else 'C' || event_id end as id, 'missing or unparseable timestamp' as reason
    from events where event_id % 4 >= 2""",
)
def _(spark, sf):
    return changes.load_changes(derive(spark, sf, RAW_CHANGES))[1]


COMMITS = """select concat(lpad(lower(hex(event_id)), 40, '0'), chr(31), '2024-01-01T00:00:00Z', chr(31), concat('dev', cast(user_id as varchar(20))), chr(31),
  'fix | things, all', chr(10), 'src/a.py', chr(10), chr(10), case when event_id % 2 = 0 then concat('src/b.py', chr(10)) else '' end) as value from events"""


@query(
    "changes_from_git_log",
    """select 'CHG-GIT-' || left(lpad(lower(hex(event_id)), 40, '0'), 12) as id, lpad(lower(hex(event_id)), 40, '0') as "commit",
      '0000000' as version, 'dev' || user_id as author, 'fix | things, all' as description,
      case when event_id % 2 = 0 then 'src/a.py,src/b.py' else 'src/a.py' end as files from events""",
)
def _(spark, sf):
    rows = changes.changes_from_git_log(derive(spark, sf, COMMITS))
    return rows.select("id", "commit", "version", "author", "description", F.array_join("files_changed", ",").alias("files"))


REPORTS = """select concat('svc-', cast(p_partkey % 7 as varchar(10))) as service, case when p_partkey % 13 = 0 then '' else p_brand end as name,
  cast(p_size as varchar(10)) as version, case when p_partkey % 2 = 0 then '' else 'pip' end as ecosystem, p_partkey % 35 as reported_ms from part"""


@query(
    "load_components",
    f"""with r as ({REPORTS}), l as (select service, max(reported_ms) as m from r group by 1)
    select r.service, name as package, version, case when ecosystem = '' then 'npm' else ecosystem end as ecosystem, reported_ms
    from r join l on l.service = r.service and m = reported_ms where name <> ''""",
)
def _(spark, sf):
    return inventory.load_components(derive(spark, sf, REPORTS))


TREES = """select p_partkey, concat('{"name":"root","dependencies":{"a":{"version":"', cast(p_size as varchar(10)),
  '.0.0","dependencies":{"b":{"version":"1.0.0","dependencies":{"c":{"version":"9"}}}}},"d":{}}}') as tree from part"""


@query(
    "components_from_npm_ls",
    """select p_partkey, 'a' as name, p_size || '.0.0' as version from part union all select p_partkey, 'd', null from part
    union all select p_partkey, 'b', '1.0.0' from part union all select p_partkey, 'c', '9' from part""",
)
def _(spark, sf):
    return inventory.components_from_npm_ls(derive(spark, sf, TREES)).select("p_partkey", "name", "version")


RAW_ADVISORIES = """select case when p_partkey % 10 = 0 then null else concat('ADV-', p_brand) end as id, case when p_partkey % 17 = 0 then '' else p_brand end as package,
  case when p_partkey % 2 = 0 then 'pip' end as ecosystem, case p_size % 3 when 0 then 'high' when 1 then 'low' else '' end as severity,
  p_name as title, cast(null as varchar(10)) as url, cast(null as double) as cvss, '<2' as vulnerable_range, p_partkey as seq from part"""


def _raw_advisories(spark, sf):
    return derive(spark, sf, RAW_ADVISORIES).withColumn("cwe", F.array(F.lit("CWE-79")))


@query(
    "load_advisories",
    f"""with r as ({RAW_ADVISORIES}) select id as advisory_id, package, coalesce(ecosystem, 'npm') as ecosystem,
      case when severity = '' then 'unknown' else severity end as severity, title, vulnerable_range
    from (select *, row_number() over (partition by id order by seq desc) as n from r where id is not null and package <> '') where n = 1""",
)
def _(spark, sf):
    accepted, _ = inventory.load_advisories(_raw_advisories(spark, sf))
    return accepted.select("advisory_id", "package", "ecosystem", "severity", "title", "vulnerable_range")


@query(
    "rejected_advisories",
    f"""with r as ({RAW_ADVISORIES}) select coalesce(id, '(no id)') as id, 'advisory requires id and package' as reason from r
    where id is null or package = ''""",
)
def _(spark, sf):
    return inventory.load_advisories(_raw_advisories(spark, sf))[1]


AUDITS = """select p_partkey as seq, concat('{"vulnerabilities":{"pkg', cast(p_partkey % 7 as varchar(10)), '":{"severity":"high","via":["other",{"source":',
  cast(p_size as varchar(10)), ',"title":"t","url":"https://x.test/', case when p_partkey % 2 = 0 then concat('advisories/GHSA-aa-', cast(p_size as varchar(10))) else 'none' end,
  '","range":"<', cast(p_size as varchar(10)), '","cvss":{"score":7.5}}]}}}') as report from part"""


@query(
    "advisories_from_npm_audit",
    """select id, 'pkg' || p_partkey % 7 as package, 'high' as severity, '<' || p_size as vulnerable_range, p_partkey as seq from (
      select *, row_number() over (partition by id order by p_partkey) as n from (
        select *, case when p_partkey % 2 = 0 then 'GHSA-aa-' || p_size else 'NPM-' || p_size end as id from part)) where n = 1""",
)
def _(spark, sf):
    found = inventory.advisories_from_npm_audit(derive(spark, sf, AUDITS))
    return found.select("id", "package", "severity", "vulnerable_range", "seq")


_N = "cast(p_size as varchar(10))"
FILES = f"""
select repo, concat(repo, '/', basename) as path, repo as dir, basename, text from (
  select concat('r', cast(p_partkey as varchar(20))) as repo, 'package.json' as basename, case when p_partkey % 10 = 9 then '{{broken' else
    concat('{{"version":"1.', {_N}, '.0","dependencies":{{"dep-a":"^', {_N}, '.1.0","dep-b":"~2.', {_N}, '","dep-c":"1 || 2"}},"devDependencies":{{"dev-d":"3.0.0"}}}}') end as text from part
  union all select concat('r', cast(p_partkey as varchar(20))), 'package-lock.json', case when p_partkey % 3 = 0
    then concat('{{"packages":{{"":{{"version":"0"}},"node_modules/dep-a":{{"version":"', {_N}, '.5.0"}},"node_modules/x/node_modules/dep-b":{{"version":"9.9.9"}}}}}}')
    else '{{"dependencies":{{"dep-b":{{"version":"2.7.0"}}}}}}' end from part where p_partkey % 3 < 2
  union all select concat('r', cast(p_partkey as varchar(20))), 'requirements.txt', concat('flask==', {_N}, '.0 # web', chr(10), 'requests[socks]>=2.', {_N}, chr(10), '-r other.txt', chr(10), chr(10), 'numpy') from part
  union all select concat('r', cast(p_partkey as varchar(20))), 'pyproject.toml', concat('[project]', chr(10), 'name = "x"', chr(10), 'version = "4.', {_N}, '"', chr(10), 'dependencies = ["attrs==', {_N}, '.1", "click"]', chr(10), '[tool.x]', chr(10), 'version = "0"') from part
  union all select concat('r', cast(p_partkey as varchar(20))), 'pom.xml', concat('<project><parent><version>8.', {_N}, '</version></parent><!-- <dependency><groupId>no</groupId></dependency> -->',
    case when p_partkey % 2 = 0 then '<version>5.0</version>' else '' end, '<dependencies><dependency><groupId>org.a</groupId><artifactId>b</artifactId><version>', {_N}, '.2</version></dependency>',
    '<dependency><groupId>org.a</groupId><artifactId>c</artifactId><version>${{v}}</version><scope>test</scope></dependency>',
    '<dependency><groupId>org.a</groupId><artifactId>d</artifactId></dependency></dependencies></project>') from part) f"""
_EXPECTED_PACKAGES = """
select 'r' || p_partkey as repo, 'npm' as ecosystem, 'dep-a' as name, p_size || case when p_partkey % 3 = 0 then '.5.0' else '.1.0' end as version, false as dev,
  case when p_partkey % 3 = 0 then 'OBSERVED' else 'INFERRED' end as provenance from part where p_partkey % 10 <> 9
union all select 'r' || p_partkey, 'npm', 'dep-b', case when p_partkey % 3 = 1 then '2.7.0' else '2.' || p_size end, false,
  case when p_partkey % 3 = 1 then 'OBSERVED' else 'INFERRED' end from part where p_partkey % 10 <> 9
union all select 'r' || p_partkey, 'npm', 'dep-c', null, false, 'UNKNOWN' from part where p_partkey % 10 <> 9
union all select 'r' || p_partkey, 'npm', 'dev-d', '3.0.0', true, 'INFERRED' from part where p_partkey % 10 <> 9
union all select 'r' || p_partkey, 'pip', 'flask', p_size || '.0', false, 'OBSERVED' from part
union all select 'r' || p_partkey, 'pip', 'requests', '2.' || p_size, false, 'INFERRED' from part
union all select 'r' || p_partkey, 'pip', 'numpy', null, false, 'UNKNOWN' from part
union all select 'r' || p_partkey, 'pip', 'attrs', p_size || '.1', false, 'OBSERVED' from part
union all select 'r' || p_partkey, 'pip', 'click', null, false, 'UNKNOWN' from part
union all select 'r' || p_partkey, 'maven', 'org.a:b', p_size || '.2', false, 'OBSERVED' from part
union all select 'r' || p_partkey, 'maven', 'org.a:c', null, true, 'UNKNOWN' from part
union all select 'r' || p_partkey, 'maven', 'org.a:d', null, false, 'UNKNOWN' from part"""


@query("packages_from_manifests", _EXPECTED_PACKAGES)
def _(spark, sf):
    found = manifests.packages_from_manifests(derive(spark, sf, FILES))
    return found.select("repo", "ecosystem", "name", "version", "dev", "provenance")


@query(
    "self_versions",
    """select 'r' || p_partkey as repo, 'npm' as ecosystem, case when p_partkey % 10 <> 9 then '1.' || p_size || '.0' end as self_version,
      case when p_partkey % 10 <> 9 then 'OBSERVED' else 'UNKNOWN' end as provenance from part
    union all select 'r' || p_partkey, 'pip', '4.' || p_size, 'OBSERVED' from part
    union all select 'r' || p_partkey, 'maven', case when p_partkey % 2 = 0 then '5.0' else '8.' || p_size end,
      case when p_partkey % 2 = 0 then 'OBSERVED' else 'INFERRED' end from part""",
)
def _(spark, sf):
    return manifests.self_versions(derive(spark, sf, FILES)).drop("source")


@query(
    "manifest_warnings",
    """select 'r' || p_partkey as repo, 'r' || p_partkey || '/package.json' as subject, 'UNPARSEABLE' as warning from part where p_partkey % 10 = 9
    union all select 'r' || p_partkey, 'r' || p_partkey, 'NO_LOCK_FILE' from part where p_partkey % 3 = 2
    union all select 'r' || p_partkey, 'pip:3', 'UNRESOLVED_VERSIONS' from part
    union all select 'r' || p_partkey, 'maven:2', 'UNRESOLVED_VERSIONS' from part""",
)
def _(spark, sf):
    files = derive(spark, sf, FILES)
    return manifests.manifest_warnings(files, manifests.packages_from_manifests(files))


CONFIGS = """select concat('e', cast(event_id as varchar(20))) as repo, concat('e', cast(event_id as varchar(20)), '/config.json') as path, 'config.json' as basename,
  case when event_id % 10 = 0 then '{bad' when event_id % 10 = 1 then '{"other":true}' when event_id % 10 = 2 then '{"k":true}' else props end as text from events"""


@query(
    "facts_from_configs",
    """select 'e' || event_id as repo, 'depth' as name, case when event_id % 10 = 2 then 'true' when event_id % 10 > 2 then regexp_extract(props, '[0-9]+') end as value,
      case when event_id % 10 = 2 then 'boolean' when event_id % 10 > 2 then 'number' end as value_type,
      case when event_id % 10 < 2 then 'UNKNOWN' else 'OBSERVED' end as provenance,
      case when event_id % 10 = 0 then 'e' || event_id || '/config.json could not be parsed' when event_id % 10 = 1 then 'e' || event_id || '/config.json: key k absent'
        else 'e' || event_id || '/config.json k' end as source from events
    union all select 'e' || event_id, 'engine', null, null, 'UNKNOWN', 'app.json not found in this repository' from events""",
)
def _(spark, sf):
    wanted = [{"name": "depth", "file": "config.json", "path": ["k"]}, {"name": "engine", "file": "app.json", "path": ["js", "engine"]}]
    return manifests.facts_from_configs(derive(spark, sf, CONFIGS), wanted)


RULE_ROWS = """select case when p_partkey % 19 = 0 then '' else concat('r', cast(p_partkey % 1900 as varchar(20))) end as rule_id,
  case when p_partkey % 7 = 0 then 'ftp://x' else 'https://docs.test/x' end as source_url, case when p_partkey % 11 = 0 then null else '2026-01-01' end as recorded_at,
  case when p_partkey % 13 = 0 then 'service' else 'package' end as when_kind, p_brand as when_name,
  case when p_partkey % 17 = 0 then null else 'absent' end as require_kind, p_brand as require_name from part"""


@query(
    "rule_problems",
    f"""with r as ({RULE_ROWS}) select rule_id, 'missing id' as problem from r where rule_id = ''
    union all select rule_id, 'source url missing' from r where source_url like 'ftp%' union all select rule_id, 'source date missing' from r where recorded_at is null
    union all select rule_id, 'no target to apply to' from r where when_kind = 'service' union all select rule_id, 'no requirement' from r where require_kind is null
    union all select rule_id, 'duplicate' from r where rule_id <> '' group by 1 having count(*) > 1""",
)
def _(spark, sf):
    return rules.rule_problems(derive(spark, sf, RULE_ROWS))


BINDING_ROWS = """select case when s_suppkey % 9 = 0 then '' else concat('svc-', cast(s_suppkey % 80 as varchar(10))) end as service,
  case when s_suppkey % 7 = 0 then null else s_name end as manifest_path, case when s_suppkey % 5 = 0 then ' ' else 'owner' end as declared_by from supplier"""


@query(
    "binding_problems",
    f"""with b as ({BINDING_ROWS}) select service, 'service missing' as problem from b where service = ''
    union all select service, 'manifest path missing' from b where manifest_path is null union all select service, 'not attributable' from b where declared_by = ' '
    union all select service, 'duplicate' from b where service <> '' group by 1 having count(*) > 1""",
)
def _(spark, sf):
    return rules.binding_problems(derive(spark, sf, BINDING_ROWS))


# --- monitoring -------------------------------------------------------------------------------

SESSIONS = """select o_custkey as snapshot_id, cast(1700000000000 as bigint) as now_ms, o_orderkey as pid,
  concat('UPDATE t SET a = ', cast(o_orderkey as varchar(20)), ' WHERE s = ''', o_orderstatus, '''') as query,
  case when o_orderkey % 8 = 0 then null else 1700000000000 - o_orderkey end as query_start_ms,
  case when o_orderkey % 3 = 0 then 'psql' else concat('app vt=', lpad(lower(hex(o_orderkey + 1)), 32, '0')) end as application_name,
  min(o_orderkey) over (partition by o_custkey) as head from orders"""


@query(
    "postgres_lock_spans",
    f"""with s as ({SESSIONS}), n as (select snapshot_id, count(*) as n from s group by 1)
    select snapshot_id, case when pid % 3 = 0 then 'fallback' else lpad(lower(hex(pid + 1)), 32, '0') end as trace_id, 'sp-pg-' || pid as span_id,
      coalesce(now_ms - query_start_ms, 0) as duration_ms, pid % 3 <> 0 as attributed, cast(head as varchar) as holder,
      cast(cast(floor(n * 100 / 40.0 + 0.5) as bigint) as varchar) as pool_pct, 'UPDATE t SET a = N WHERE s = ''?''' as fingerprint,
      case when head % 3 <> 0 then lpad(lower(hex(head + 1)), 32, '0') end as blocker
    from s join n using (snapshot_id) where pid <> head""",
)
def _(spark, sf):
    sessions = derive(spark, sf, SESSIONS).withColumn(
        "blocking_pids", F.when(F.col("pid") != F.col("head"), F.array("head")).otherwise(F.array().cast("array<bigint>"))
    )
    limits = sessions.select("snapshot_id").distinct().withColumn("max_connections", F.lit(40))
    a = F.col("attributes")
    return monitoring.postgres_lock_spans(sessions, limits, "fallback").select(
        "snapshot_id", "trace_id", "span_id", "duration_ms", "attributed", attributes.attr(a, "db.holding_lock_pid").alias("holder"),
        attributes.attr(a, "db.connection_pool.saturation_pct").alias("pool_pct"), attributes.attr(a, "db.query.fingerprint").alias("fingerprint"),
        attributes.attr(a, "db.blocking_trace_id").alias("blocker"),
    )


WAITS = """select o_custkey as snapshot_id, cast(1700000000000 as bigint) as now_ms, o_orderkey as blocked_handle, o_orderkey + 1 as holding_handle,
  case when o_orderkey % 2 = 0 then 'X' else '' end as lock_mode, case when o_orderkey % 5 = 0 then null else 1700000000000 - o_orderkey end as wait_start_ms from orders"""
ACTIVITIES = """select o_custkey as snapshot_id, o_orderkey as handle, 'select 1' as statement, o_orderkey % 700 as total_ms,
  case when o_orderkey % 3 = 0 then o_orderkey % 90 end as lock_wait_ms from orders where o_orderstatus <> 'P'"""
CONNECTIONS = """select o_custkey as snapshot_id, o_orderkey as handle, case when o_orderkey % 2 = 0 then concat('vt=', lpad(lower(hex(o_orderkey + 1)), 32, '0')) end as client_applname,
  concat('x vt=', lpad(lower(hex(o_orderkey + 2)), 32, '0')) as client_acctng from orders where o_orderpriority <> '5-LOW'"""


@query(
    "db2_lock_spans",
    f"""with w as ({WAITS}), a as ({ACTIVITIES}), c as ({CONNECTIONS}), n as (select snapshot_id, count(*) as n from c group by 1)
    select w.snapshot_id, 'sp-db2-' || blocked_handle as span_id, coalesce(total_ms, 0) as duration_ms,
      case when c.handle is null then null when blocked_handle % 2 = 0 then lpad(lower(hex(blocked_handle + 1)), 32, '0') else lpad(lower(hex(blocked_handle + 2)), 32, '0') end as trace_id,
      cast(coalesce(lock_wait_ms, now_ms - wait_start_ms) as varchar) as lock_wait, case when a.handle is not null then 'select N' end as fingerprint,
      case when w.snapshot_id % 2 = 0 then cast(cast(floor(n * 100 / 50.0 + 0.5) as bigint) as varchar) end as pool_pct, '90.0' as hit_pct, nullif(lock_mode, '') as lock_mode
    from w left join a on a.snapshot_id = w.snapshot_id and a.handle = blocked_handle left join c on c.snapshot_id = w.snapshot_id and c.handle = blocked_handle
    left join n on n.snapshot_id = w.snapshot_id""",
)
def _(spark, sf):
    waits = derive(spark, sf, WAITS)
    pools = waits.select("snapshot_id").distinct().select(
        "snapshot_id", F.when(F.col("snapshot_id") % 2 == 0, 50).otherwise(-1).alias("max_agents"),
        F.lit(1000).alias("logical_reads"), F.lit(100).alias("physical_reads"),
    )
    found = monitoring.db2_lock_spans(waits, derive(spark, sf, ACTIVITIES), derive(spark, sf, CONNECTIONS), pools)
    a = F.col("attributes")
    return found.select(
        "snapshot_id", "span_id", "duration_ms", "trace_id", attributes.attr(a, "db.lock_wait_ms").alias("lock_wait"),
        attributes.attr(a, "db.query.fingerprint").alias("fingerprint"), attributes.attr(a, "db.connection_pool.saturation_pct").alias("pool_pct"),
        attributes.attr(a, "db2.bufferpool.hit_ratio_pct").alias("hit_pct"), attributes.attr(a, "db2.lock.mode").alias("lock_mode"),
    )


MQSC = """select p_partkey as snapshot_id, 'QM1' as queue_manager, cast(1700000000000 as bigint) as observed_ms,
  case when p_partkey % 2 = 0 then upper(concat('56544c53', lpad(lower(hex(p_partkey + 1)), 32, '0'), '00000001')) else 'ABCD' end as correl_id,
  concat('AMQ8450I: Display queue status details.', chr(10), '   QUEUE(DEV.Q ', cast(p_partkey % 9 as varchar(10)), ')   TYPE(QUEUE)', chr(10), '   CURDEPTH(',
    cast(p_size * 20 as varchar(10)), ')  IPPROCS(', cast(p_partkey % 3 as varchar(10)), ')', chr(10), 'AMQ8450I: more', chr(10), ' QUEUE(OTHER)') as status_output,
  case when p_partkey % 4 = 0 then '' else concat('AMQ8409I: Display Queue details.', chr(10), '  QUEUE(X) MAXDEPTH(1000)') end as attributes_output from part"""


@query(
    "queue_spans",
    """select p_partkey as snapshot_id, case when p_partkey % 2 = 0 then lpad(lower(hex(p_partkey + 1)), 32, '0') end as trace_id,
      'sp-mq-DEV.Q_' || p_partkey % 9 as span_id,
      case when p_size * 20 > 0 and p_partkey % 3 = 0 then 'FAILED' when p_partkey % 4 <> 0 and floor(p_size * 2 + 0.5) >= 80 then 'DEGRADED'
        when p_partkey % 4 = 0 and p_size * 20 > 500 then 'DEGRADED' else 'SUCCESS' end as assessment,
      cast(p_size * 20 as varchar) as depth, case when p_partkey % 4 <> 0 then '1000' end as max_depth from part""",
)
def _(spark, sf):
    a = F.col("attributes")
    return monitoring.queue_spans(derive(spark, sf, MQSC)).select(
        "snapshot_id", "trace_id", "span_id", "assessment", attributes.attr(a, "messaging.ibmmq.queue_depth").alias("depth"),
        attributes.attr(a, "messaging.ibmmq.max_queue_depth").alias("max_depth"),
    )


HOPS = """select l_orderkey, l_linenumber, l_partkey, case l_linenumber when 1 then 'LOAD_BALANCER' when 2 then 'WEB_SERVER' when 3 then 'WEBSPHERE' when 4 then 'MESSAGE_BROKER'
    when 5 then 'DB2' when 6 then 'EXTERNAL_GATEWAY' else 'CLIENT_RETURN' end as component_type,
  case when l_partkey % 4 = 0 then null else l_extendedprice / 50 end as duration_ms, case when l_suppkey % 5 = 0 then null when l_returnflag = 'A' then 503 else 200 end as http_status,
  case when l_tax > 0.07 then 'BLOCK' when l_tax > 0.02 then 'PASS' end as waf_decision, case when l_quantity > 5 then l_quantity * 2 end as thread_pool_pct,
  case when l_discount > 0.02 then l_discount * 10000 end as lock_wait_ms, 50.0 as connection_pool_pct,
  case when l_partkey % 3 <> 0 then cast(l_quantity * 20 as bigint) end as queue_depth, case when l_suppkey % 2 = 0 then 1000 end as max_queue_depth,
  'QM1' as queue_manager, 'Q' as queue_name, case when l_linestatus = 'F' then 'RUNNING' when l_tax > 0.05 then 'STOPPED' end as channel_status from lineitem"""


@query(
    "hop_evidence",
    f"""with h as ({HOPS}) select component_type, case component_type
        when 'LOAD_BALANCER' then case when waf_decision = 'BLOCK' then 'FAILED' when duration_ms > 200 then 'DEGRADED' when waf_decision is not null or duration_ms is not null then 'SUCCESS' else 'UNKNOWN' end
        when 'WEB_SERVER' then case when http_status >= 500 then 'FAILED' when duration_ms > 300 then 'DEGRADED' when http_status is not null or duration_ms is not null then 'SUCCESS' else 'UNKNOWN' end
        when 'WEBSPHERE' then case when http_status >= 500 then 'FAILED' when thread_pool_pct > 90 then 'DEGRADED' when http_status is not null or thread_pool_pct is not null then 'SUCCESS' else 'UNKNOWN' end
        when 'EXTERNAL_GATEWAY' then case when http_status >= 500 then 'FAILED' when duration_ms > 2000 then 'DEGRADED' when http_status is not null or duration_ms is not null then 'SUCCESS' else 'UNKNOWN' end
        when 'CLIENT_RETURN' then case when http_status >= 500 then 'FAILED' when http_status is not null then 'SUCCESS' else 'UNKNOWN' end
        when 'DB2' then case when duration_ms is null then 'UNKNOWN' when lock_wait_ms > 500 or duration_ms > 1000 then 'FAILED' when duration_ms > 200 then 'DEGRADED' else 'SUCCESS' end
        else case when channel_status = 'STOPPED' then 'FAILED' when coalesce(queue_depth / max_queue_depth > 0.8, queue_depth > 500) then 'DEGRADED' when queue_depth is not null then 'SUCCESS' else 'UNKNOWN' end
      end as hop_status,
      case when case component_type when 'LOAD_BALANCER' then waf_decision is null or duration_ms is null when 'WEBSPHERE' then http_status is null or thread_pool_pct is null
        when 'CLIENT_RETURN' then http_status is null when 'DB2' then duration_ms is null or lock_wait_ms is null when 'MESSAGE_BROKER' then queue_depth is null
        else http_status is null or duration_ms is null end then 'PARTIAL' else 'OBSERVED' end as provenance, count(*) as readings from h group by 1, 2, 3""",
)
def _(spark, sf):
    rows = monitoring.hop_evidence(derive(spark, sf, HOPS))
    return rows.groupBy("component_type", "hop_status", "provenance").agg(F.count(F.lit(1)).alias("readings"))


# --- envelopes --------------------------------------------------------------------------------


@query(
    "validate_envelopes",
    duck_with("envelopes")
    + """select evidence_id, case when ingest_seq = 1 then 'UNASSOCIATED' else cast(trace_id as varchar) end as trace_id, status,
      case when ingest_seq = 3 then 'Missing component type' else '' end as errors, observed_ms::double as observed_ms from envelopes""",
)
def _(spark, sf):
    flat = view(spark, sf, "envelopes").withColumns(
        {"trace_id": F.when(F.col("ingest_seq") != 1, F.col("trace_id")).cast("string"),
         "component_type": F.when(F.col("ingest_seq") != 3, F.col("component_type"))}
    )
    checked = envelopes.validate_envelopes(envelopes.envelopes(flat))
    return checked.select(
        "evidence_id", F.regexp_replace("trace_id", "^(UNASSOCIATED)-[0-9a-f]{16}$", "$1").alias("trace_id"),
        F.col("event.status").alias("status"), F.array_join("errors", ",").alias("errors"), "measurements.observed_ms",
    )


@query(
    "request_dna_wide",
    duck_with("envelopes")
    + """, m as (select *, observed_ms / greatest(0.1, expected_ms)::double as m from envelopes)
    select trace_id, '2.1.0' as schema_version, sum(observed_ms)::bigint as total_ms,
      (list(component_name order by ingest_seq) filter (where component_type = 'DB2'))[1] as database_name,
      (list(component_name order by ingest_seq) filter (where component_type = 'LOAD_BALANCER'))[1] as balancer_name,
      count(distinct component_type) as tiers, (list(component_type order by m desc, ingest_seq) filter (where m > 1.5))[1] as deviation,
      round(cast(max(m) filter (where m > 1.5) as decimal(28,10)), 1) as multiple, true as is_valid from m group by 1""",
)
def _(spark, sf):
    wide = envelopes.validate_dna(envelopes.request_dna_wide(view(spark, sf, "envelopes")))
    return wide.select(
        "trace_id", "schema_version", F.col("temporal_lineage.total_ms").alias("total_ms"), F.col("database.component_name").alias("database_name"),
        F.col("load_balancer.component_name").alias("balancer_name"), F.size("temporal_lineage.hop_deltas").alias("tiers"),
        F.col("temporal_lineage.first_deviation.node").alias("deviation"), F.col("temporal_lineage.first_deviation.multiple").alias("multiple"), "is_valid",
    )
