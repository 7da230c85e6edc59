"""Snapshots of databases, queue managers and infrastructure tiers as request evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.context import decode_db_client_info, decode_mq_correl_id
from spanwise.functions.numbers import assess_queue, buffer_hit_ratio, round_half_up, saturation_pct
from spanwise.functions.text import sql_fingerprint
from spanwise.schema import ATTRIBUTES


def _attribute(key: str, value: Column, kind: str = "intValue") -> Column:
    fields = [
        (value if f.name == kind else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in ATTRIBUTES.elementType["value"].dataType.fields
    ]
    return F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), F.struct(*fields).alias("value")))


def _attributes(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def postgres_lock_spans(sessions: DataFrame, limits: DataFrame, fallback_trace_id: str | None = None) -> DataFrame:
    """One database span per (blocked session, blocker) of each snapshot.

    ``sessions``: snapshot_id, now_ms, pid, query, query_start_ms, application_name, blocking_pids.
    ``limits``: snapshot_id, max_connections.
    """
    c = F.col
    active = sessions.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("active"))
    pool = active.join(limits, "snapshot_id", "left").select(
        "snapshot_id", saturation_pct(c("active"), c("max_connections")).alias("pool_pct")
    )
    blocked = sessions.filter(F.size("blocking_pids") > 0).select(
        "snapshot_id", "now_ms", "pid", "query", "query_start_ms", "application_name",
        F.explode("blocking_pids").alias("blocking_pid"),
    )
    blocking = sessions.select(
        "snapshot_id", c("pid").alias("blocking_pid"), decode_db_client_info(c("application_name")).alias("blocking_trace_id")
    )
    rows = blocked.join(blocking, ["snapshot_id", "blocking_pid"]).join(pool, "snapshot_id", "left")
    own = decode_db_client_info(c("application_name"))
    wait = c("now_ms") - c("query_start_ms")
    return rows.select(
        "snapshot_id",
        F.coalesce(own, F.lit(fallback_trace_id)).alias("trace_id"),
        F.concat(F.lit("sp-pg-"), c("pid").cast("string")).alias("span_id"),
        F.lit("Postgres").alias("service"),
        F.lit("DB-Query").alias("name"),
        F.coalesce(wait, F.lit(0)).alias("duration_ms"),
        c("now_ms").alias("observed_ms"),
        own.isNotNull().alias("attributed"),
        _attributes(
            _attribute("db.holding_lock_pid", c("blocking_pid")),
            _attribute("db.connection_pool.saturation_pct", c("pool_pct")),
            _attribute("db.lock_wait_ms", wait),
            _attribute("db.query.fingerprint", sql_fingerprint(c("query")), "stringValue"),
            _attribute("db.blocking_trace_id", c("blocking_trace_id"), "stringValue"),
        ).alias("attributes"),
    )


def db2_lock_spans(
    waits: DataFrame, activities: DataFrame, connections: DataFrame, pools: DataFrame, fallback_trace_id: str | None = None
) -> DataFrame:
    """One database span per lock wait of each snapshot; what was not reported stays absent.

    ``waits``: snapshot_id, now_ms, blocked_handle, holding_handle, lock_mode, wait_start_ms.
    ``activities``: snapshot_id, handle, statement, total_ms, lock_wait_ms. ``connections``:
    snapshot_id, handle, client_applname, client_acctng. ``pools``: snapshot_id, max_agents,
    logical_reads, physical_reads.
    """
    c = F.col
    active = connections.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("active"))
    pool = pools.join(active, "snapshot_id", "left").select(
        "snapshot_id",
        saturation_pct(c("active"), c("max_agents")).alias("pool_pct"),
        buffer_hit_ratio(c("logical_reads"), c("physical_reads")).alias("hit_pct"),
    )
    rows = (
        waits.join(activities.withColumnRenamed("handle", "blocked_handle"), ["snapshot_id", "blocked_handle"], "left")
        .join(connections.withColumnRenamed("handle", "blocked_handle"), ["snapshot_id", "blocked_handle"], "left")
        .join(pool, "snapshot_id", "left")
    )
    own = F.coalesce(decode_db_client_info(c("client_applname")), decode_db_client_info(c("client_acctng")))
    wait = F.coalesce("lock_wait_ms", c("now_ms") - c("wait_start_ms"))
    return rows.select(
        "snapshot_id",
        F.coalesce(own, F.lit(fallback_trace_id)).alias("trace_id"),
        F.concat(F.lit("sp-db2-"), F.coalesce(c("blocked_handle").cast("string"), F.lit("unknown"))).alias("span_id"),
        F.lit("DB2").alias("service"),
        F.lit("DB-Query").alias("name"),
        F.coalesce("total_ms", F.lit(0)).alias("duration_ms"),
        c("now_ms").alias("observed_ms"),
        own.isNotNull().alias("attributed"),
        _attributes(
            _attribute("db.system", F.lit("db2"), "stringValue"),
            _attribute("db.holding_lock_pid", c("holding_handle")),
            _attribute("db.lock_wait_ms", wait),
            _attribute("db.connection_pool.saturation_pct", c("pool_pct")),
            _attribute("db.query.fingerprint", sql_fingerprint(c("statement"), literals_first=True), "stringValue"),
            _attribute("db2.bufferpool.hit_ratio_pct", c("hit_pct"), "doubleValue"),
            _attribute("db2.lock.mode", F.nullif("lock_mode", F.lit("")), "stringValue"),
        ).alias("attributes"),
    )


def mqsc_records(outputs: DataFrame, column: str = "output") -> DataFrame:
    """Command output split at its AMQ headers; each record a map of KEY to value."""
    kept = [c for c in outputs.columns if c != column]
    pieces = F.split(column, r"(?m)^\s*AMQ[0-9]+I[^\n]*$")
    rows = outputs.select(*kept, F.posexplode(pieces).alias("record_no", "piece"))
    keys = F.regexp_extract_all("piece", F.lit(r"([A-Z0-9_]+)\(([^)]*)\)"), F.lit(1))
    values = F.transform(F.regexp_extract_all("piece", F.lit(r"([A-Z0-9_]+)\(([^)]*)\)"), F.lit(2)), lambda v: F.trim(v))
    # A repeated key keeps its last value.
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    rows = rows.withColumn("pairs", pairs).filter(F.size("pairs") > 0)
    last = F.filter(
        F.col("pairs"), lambda p, i: ~F.exists(F.slice("pairs", i + 2, F.size("pairs")), lambda q: q["k"] == p["k"])
    )
    entries = F.transform(last, lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value")))
    return rows.select(*kept, "record_no", F.map_from_entries(entries).alias("fields"))


def queue_observations(outputs: DataFrame) -> DataFrame:
    """Queue status joined with its attributes.

    ``outputs``: snapshot_id, queue_manager, observed_ms, correl_id, status_output, attributes_output.
    """
    c = F.col
    status = mqsc_records(outputs.select("snapshot_id", c("status_output").alias("output"))).filter(
        F.map_contains_key("fields", "QUEUE")
    )
    attributes = mqsc_records(outputs.select("snapshot_id", c("attributes_output").alias("output"))).filter(
        F.map_contains_key("fields", "MAXDEPTH")
    )
    s = status.groupBy("snapshot_id").agg(F.min_by("fields", "record_no").alias("s"))
    a = attributes.groupBy("snapshot_id").agg(F.min_by("fields", "record_no").alias("a"))

    def number(record: str, key: str) -> Column:
        return F.try_element_at(c(record), F.lit(key)).try_cast("bigint")

    rows = outputs.select("snapshot_id", "queue_manager", "observed_ms", "correl_id").join(s, "snapshot_id").join(
        a, "snapshot_id", "left"
    )
    return rows.select(
        "snapshot_id", "queue_manager", "observed_ms",
        decode_mq_correl_id(c("correl_id"))["trace_id"].alias("trace_id"),
        F.try_element_at("s", F.lit("QUEUE")).alias("queue"),
        number("s", "CURDEPTH").alias("depth"),
        number("a", "MAXDEPTH").alias("max_depth"),
        number("s", "IPPROCS").alias("open_inputs"),
        number("s", "OPPROCS").alias("open_outputs"),
    ).withColumn("saturation_pct", F.when(c("max_depth") != 0, round_half_up(c("depth").cast("double") / c("max_depth") * 100)))


def queue_spans(outputs: DataFrame) -> DataFrame:
    """One messaging span per observed queue, with its assessment."""
    c = F.col
    rows = queue_observations(outputs).withColumn("a", assess_queue(c("depth"), c("max_depth"), c("open_inputs")))
    return rows.select(
        "snapshot_id",
        "trace_id",
        F.concat(F.lit("sp-mq-"), F.regexp_replace("queue", "[^A-Za-z0-9_.-]", "_")).alias("span_id"),
        F.lit("IBM-MQ").alias("service"),
        F.lit("MQ-Queue").alias("name"),
        F.lit(0).cast("bigint").alias("duration_ms"),
        "observed_ms",
        c("a.status").alias("assessment"),
        c("a.reason").alias("assessment_reason"),
        _attributes(
            _attribute("messaging.system", F.lit("ibmmq"), "stringValue"),
            _attribute("messaging.destination.name", c("queue"), "stringValue"),
            _attribute("messaging.ibmmq.queue_manager", c("queue_manager"), "stringValue"),
            _attribute("messaging.ibmmq.queue_depth", c("depth")),
            _attribute("messaging.ibmmq.max_queue_depth", c("max_depth")),
            _attribute("messaging.ibmmq.depth_saturation_pct", c("saturation_pct")),
            _attribute("messaging.ibmmq.open_input_count", c("open_inputs")),
            _attribute("messaging.ibmmq.open_output_count", c("open_outputs")),
            _attribute("messaging.ibmmq.assessment", c("a.reason"), "stringValue"),
        ).alias("attributes"),
    )


def channel_status(outputs: DataFrame, column: str = "output") -> DataFrame:
    records = mqsc_records(outputs, column)
    name = F.try_element_at("fields", F.lit("CHANNEL"))
    kept = [c for c in outputs.columns if c != column]
    return records.filter(name.isNotNull()).select(
        *kept, name.alias("channel"), F.coalesce(F.try_element_at("fields", F.lit("STATUS")), F.lit("UNKNOWN")).alias("status")
    )


# What must be present for a reading of each tier to count as complete.
CORE_FIELDS = {
    "DNS": ("resolved_ip",),
    "FIREWALL": ("action", "ips_decision"),
    "LOAD_BALANCER": ("waf_decision", "duration_ms"),
    "WEB_SERVER": ("http_status", "duration_ms"),
    "WEBSPHERE": ("http_status", "thread_pool_pct"),
    "NETWORK": ("retransmits",),
    "EXTERNAL_GATEWAY": ("http_status", "duration_ms"),
    "CLIENT_RETURN": ("http_status",),
    "DB2": ("duration_ms", "lock_wait_ms", "connection_pool_pct"),
    "MESSAGE_BROKER": ("queue_manager", "queue_name", "queue_depth"),
    "CLIENT": (),
}
HOP_FIELDS = {
    "resolved_ip": "string", "action": "string", "ips_decision": "string", "waf_decision": "string", "http_status": "int",
    "duration_ms": "double", "thread_pool_pct": "double", "retransmits": "int", "lock_wait_ms": "double",
    "connection_pool_pct": "double", "queue_manager": "string", "queue_name": "string", "queue_depth": "bigint",
    "max_queue_depth": "bigint", "channel_status": "string",
}


def _graded(failed: Column, degraded: Column, known: Column) -> Column:
    yes = F.lit(True)
    return (
        F.when(F.coalesce(failed, ~yes), "FAILED")
        .when(F.coalesce(degraded, ~yes), "DEGRADED")
        .when(known, "SUCCESS")
        .otherwise("UNKNOWN")
    )


def hop_evidence(raw: DataFrame) -> DataFrame:
    """Status and completeness of tier readings (``component_type`` plus any of ``HOP_FIELDS``).

    A tier is judged only from what was reported: nothing reported is UNKNOWN, and every missing
    core field is named.
    """
    for name, kind in HOP_FIELDS.items():
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast(kind))
    c = F.col
    never = F.lit(False)

    def known(*names: str) -> Column:
        test = never
        for n in names:
            test = test | c(n).isNotNull()
        return test

    full = F.when(c("max_queue_depth") > 0, c("queue_depth") / c("max_queue_depth") > 0.8).otherwise(c("queue_depth") > 500)
    stopped = F.length("channel_status") > 0
    rules = {
        "DNS": F.when(c("resolved_ip").isNull(), "UNKNOWN").when(c("resolved_ip") == "", "FAILED").otherwise("SUCCESS"),
        "FIREWALL": _graded((c("action") == "DENY") | (c("ips_decision") == "BLOCKED"), never, known("action", "ips_decision")),
        "LOAD_BALANCER": _graded(c("waf_decision") == "BLOCK", c("duration_ms") > 200, known("waf_decision", "duration_ms")),
        "WEB_SERVER": _graded(c("http_status") >= 500, c("duration_ms") > 300, known("http_status", "duration_ms")),
        "WEBSPHERE": _graded(c("http_status") >= 500, c("thread_pool_pct") > 90, known("http_status", "thread_pool_pct")),
        "NETWORK": _graded(never, c("retransmits") > 5, known("retransmits")),
        "EXTERNAL_GATEWAY": _graded(c("http_status") >= 500, c("duration_ms") > 2000, known("http_status", "duration_ms")),
        "CLIENT_RETURN": _graded(c("http_status") >= 500, never, known("http_status")),
        "DB2": F.when(c("duration_ms").isNull(), "UNKNOWN").otherwise(
            _graded((c("lock_wait_ms") > 500) | (c("duration_ms") > 1000), c("duration_ms") > 200, F.lit(True))
        ),
        "MESSAGE_BROKER": _graded(stopped & (c("channel_status") != "RUNNING"), full, known("queue_depth")),
        "CLIENT": _graded(never, never, known("duration_ms")),
    }
    kind = c("component_type")
    status, missing = None, None
    for name, rule in rules.items():
        absent = F.array_compact(
            F.array(*[F.when(c(f).isNull(), f) for f in CORE_FIELDS[name]], F.lit(None).cast("string"))
        )
        status = F.when(kind == name, rule) if status is None else status.when(kind == name, rule)
        missing = F.when(kind == name, absent) if missing is None else missing.when(kind == name, absent)
    rows = raw.withColumns(
        {"hop_status": status.otherwise("UNKNOWN"), "unobserved": missing.otherwise(F.array().cast("array<string>"))}
    )
    return rows.withColumn("provenance", F.when(F.size("unobserved") == 0, "OBSERVED").otherwise("PARTIAL"))
