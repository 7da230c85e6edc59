"""Views that give the benchmark tables the shape of request evidence.

The SQL is written once and runs in Spark and in DuckDB. The only translation is
``epoch_ms(ts)``, whole milliseconds since 1970.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.session import keep, path_exists

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

_NUMBERED = """(select *, l_orderkey as okey, (l_returnflag = 'A' and l_linestatus = 'F') as err,
        row_number() over (partition by l_orderkey
          order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as rn
      from lineitem)"""

VIEWS: dict[str, str] = {
    "spans": f"""
select lpad(lower(hex(okey)), 32, '0') as trace_id, lpad(lower(hex(rn)), 16, '0') as span_id,
  case when okey % 50 = 0 or rn = 1 then null
       when okey % 37 = 0 then lpad('3e7', 16, '0')
       else lpad(lower(hex(cast(floor(rn / 2.0) as bigint))), 16, '0') end as parent_span_id,
  case when rn = 1 or rn between 4 and 7 then 2 else 3 end as kind,
  concat('svc-', cast(l_suppkey % 4 as varchar(10))) as service,
  concat(case when l_partkey % 5 = 0 then 'query-' else 'op-' end, cast(l_partkey % 3 as varchar(10))) as name,
  cast(floor(l_extendedprice / 50) as bigint) as duration_ms,
  cast(epoch_ms(l_shipdate) as bigint) as observed_ms,
  cast(epoch_ms(l_shipdate) as bigint) + l_partkey * 3600000 as received_ms,
  case when err then 'ERROR' when floor(l_extendedprice / 50) > 2000 then 'DEGRADED' else 'OK' end as status,
  case when err then 2 else 1 end as otel_status_code,
  case when l_quantity < 3 then null when err then 500 when l_quantity > 48 then 404 else 200 end as http_status,
  case when l_suppkey % 7 = 0 then null else concat('1.', cast(l_suppkey % 3 as varchar(10)), '.0') end as service_version,
  concat('sha256:', repeat(cast(l_suppkey % 4 as varchar(10)), 64)) as artifact_digest,
  case when l_suppkey % 11 = 0 then null when l_suppkey % 5 = 0 then 'staging' else 'prod' end as deployment_environment,
  case when l_quantity < 2 then null else (cast(epoch_ms(l_shipdate) as bigint) + l_partkey) * 1000000 end as start_ns,
  case when l_quantity < 2 then null else
    (cast(epoch_ms(l_shipdate) as bigint) + l_partkey + cast(floor(l_extendedprice / 50) as bigint)) * 1000000
     + case when l_partkey % 9 = 0 then -900000000000000 else 250000 end end as end_ns,
  case when l_partkey % 3 = 0 then cast(l_partkey % 120 as bigint) end as db_pool_pct,
  case when l_suppkey % 4 <> 0 then cast(l_suppkey % 100 as bigint) end as db_cpu_pct,
  case when l_linenumber % 2 = 0 then concat('SELECT N FROM t', cast(l_partkey % 50 as varchar(10))) end as db_fingerprint,
  case when l_partkey % 2 = 0 then cast(floor(l_quantity * 100) as bigint) end as db_lock_wait_ms,
  case when l_partkey % 4 = 0 then l_suppkey + 4000 end as db_holder_pid,
  case when l_partkey % 8 = 0 then lpad(lower(hex(l_partkey + 1)), 32, '0') end as db_blocking_trace,
  case when l_partkey % 6 = 0 then null else 'pip:pymongo' end as client_package,
  cast(rn as bigint) as ingest_seq
from {_NUMBERED} t""",
    "span_obs": """
select l_orderkey as trace_id, l_linenumber as span_id,
  concat('svc-', cast(l_suppkey % 4 as varchar(10))) as service,
  cast(floor(l_extendedprice / 50) as bigint) as duration_ms,
  cast(epoch_ms(l_shipdate) as bigint) as received_ms,
  l_partkey * 1000000 + l_suppkey as arrival
from lineitem
union all
select l_orderkey, l_linenumber, concat('svc-', cast(l_suppkey % 4 as varchar(10))),
  cast(floor(l_extendedprice / 50) as bigint), cast(epoch_ms(l_shipdate) as bigint) + 60000,
  l_partkey * 1000000 + l_suppkey + 900000000000
from lineitem where l_orderkey % 10 = 0""",
    "ev_spans": """
select concat('u', cast(user_id as varchar(20)), '-', cast(cast(ts as date) as varchar(10))) as trace_id,
  event_id as span_id, concat('svc-', cast(event_id % 4 as varchar(10))) as service, event_type as name,
  cast(floor(value * 10) as bigint) as duration_ms, cast(epoch_ms(ts) as bigint) as observed_ms,
  event_id as ingest_seq,
  case when event_type = 'error' then 'ERROR' when value > 200 then 'DEGRADED' else 'OK' end as status
from events where event_type <> 'purchase'""",
    "changes": """
select concat('CHG-', cast(event_id as varchar(20))) as change_id, cast(epoch_ms(ts) as bigint) as change_ms,
  case when event_id % 7 = 0 then null else concat('svc-', cast(user_id % 6 as varchar(10))) end as service,
  case when event_id % 2 = 0 then 'DEPLOY' else 'CONFIG' end as change_type
from events where event_type = 'purchase'""",
    "components": """
select distinct concat('svc-', cast(p_partkey % 3 as varchar(10))) as service, p_brand as package,
  concat(cast(p_size as varchar(10)), '.', cast(p_partkey % 10 as varchar(10)), '.0') as version,
  case when p_partkey % 2 = 0 then 'npm' else 'pip' end as ecosystem
from part""",
    "advisories": """
select concat('ADV-', p_brand) as advisory_id, p_brand as package, 'npm' as ecosystem,
  case cast(max(p_size) % 4 as int) when 0 then 'critical' when 1 then 'high' when 2 then 'moderate' else 'low' end as severity
from part group by p_brand""",
    "envelopes": f"""
select l_orderkey as trace_id, concat(cast(l_orderkey as varchar(20)), '-', cast(rn as varchar(10))) as evidence_id,
  cast(rn as bigint) as ingest_seq,
  case l_linenumber when 1 then 'LOAD_BALANCER' when 2 then 'WEB_SERVER' when 3 then 'WEBSPHERE' when 4 then 'MESSAGE_BROKER'
       when 5 then 'DB2' when 6 then 'EXTERNAL_GATEWAY' else 'CLIENT_RETURN' end as component_type,
  concat('node-', cast(l_suppkey % 20 as varchar(10))) as component_name,
  'EXECUTION' as event_type, cast(null as varchar(10)) as span_id,
  cast(epoch_ms(l_shipdate) as bigint) as event_ms,
  cast(floor(l_quantity * 10) as bigint) as observed_ms, 20 + l_linenumber * 10 as expected_ms,
  case when l_discount > 0.08 then 600 else 0 end as lock_wait_ms,
  case when l_tax > 0.06 then cast(floor(l_tax * 1000) as int) end as cpu_pct,
  case when l_returnflag = 'A' and l_linestatus = 'F' then 'FAILED' when l_quantity > 45 then 'DEGRADED' else 'SUCCESS' end as status,
  case when l_partkey % 4 = 0 then null else concat('SQL-', cast(l_partkey % 5 as varchar(10))) end as sql_fingerprint,
  case when l_suppkey % 3 = 0 then null else cast(l_suppkey % 8 as bigint) end as db_pid,
  case when l_partkey % 10 < 7 then null else concat('M', cast(l_partkey % 2 as varchar(10))) end as message_id,
  concat('sys-', cast(l_partkey % 3 as varchar(10))) as source_system
from {_NUMBERED} t""",
    "messages": """
select o_orderkey as correlation_id, cast(epoch_ms(o_orderdate) as bigint) as producer_ms, ship_ms as consumer_ms
from orders left join (select l_orderkey, min(cast(epoch_ms(l_shipdate) as bigint)) as ship_ms
                       from lineitem group by l_orderkey) l on o_orderkey = l_orderkey""",
    "expenses": """
select o_orderkey as expense_id, cast(floor(o_custkey / 10) as bigint) as group_id, o_custkey % 10 as paid_by,
  cast(2 + o_orderkey % 9 as int) as split_n, cast(floor(o_totalprice * 100) as bigint) as amount_cents
from orders""",
    "state_events": """
select o_custkey as entity_id, o_orderstatus as to_state,
  lag(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey) as from_state,
  row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as revision, o_orderkey as operation_id
from orders""",
    "collections": """
select concat('src-', cast(user_id % 12 as varchar(10))) as source, cast(epoch_ms(ts) as bigint) as collected_ms,
  event_id, cast(floor(value * 100) as bigint) as lag_ms,
  case when event_type = 'error' then 'DISCONNECTED' when event_type = 'signup' then 'PERMISSION_DENIED'
       when event_type = 'view' then 'COLLECTION_ERROR' else 'OK' end as outcome
from events""",
}


def _tables_in(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", sql)]


def spark_sql_text(sql: str) -> str:
    return sql.replace("epoch_ms(", "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ")


def duck_sql_text(sql: str) -> str:
    """DuckDB rounds in epoch_ms; whole milliseconds are wanted."""
    return re.sub(r"epoch_ms\((\w+)\)", r"(epoch_us(\1) // 1000)", sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """Give CPU-heavy row work enough tasks when the input is a handful of files."""
    tasks = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(tasks) if len(frame.inputFiles()) < tasks else frame


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run shared SQL over the benchmark tables."""
    for name in _tables_in(sql):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(spark_sql_text(sql))


# Views that number the rows of each order. The numbering (a shuffle and a sort) is written once, as narrow as the
# table itself; the views are plain projections of it, so each query computes and carries the columns it uses only.
NUMBERED = ("spans", "envelopes")
_stored: dict[tuple[str, str, str], DataFrame] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """One written table per session, input and name."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    # Scratch folders may be cleared; a table that is gone is written again.
    if key not in _stored or not path_exists(spark, _stored[key].inputFiles()[0]):
        _stored[key] = keep(build(), name)
    return _stored[key]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in NUMBERED:
        numbered = once(spark, sf_dir, "numbered", lambda: derive(spark, sf_dir, f"select * from {_NUMBERED} t"))
        numbered.createOrReplaceTempView("numbered_lines")
        return spark.sql(spark_sql_text(VIEWS[name].replace(_NUMBERED, "numbered_lines")))
    return derive(spark, sf_dir, VIEWS[name])


def duck_with(*names: str, **extra: str) -> str:
    """A WITH clause holding the named views for the DuckDB side."""
    parts = [f"{n} as ({VIEWS[n]})" for n in names]
    parts += [f"{n} as ({sql})" for n, sql in extra.items()]
    return duck_sql_text("with recursive " + ",\n".join(parts) + "\n")


def _attribute(key: str, string: Column | None = None, integer: Column | None = None) -> Column:
    present = string if string is not None else integer
    value = F.struct(
        (string if string is not None else F.lit(None)).cast("string").alias("stringValue"),
        (integer if integer is not None else F.lit(None)).cast("string").alias("intValue"),
        F.lit(None).cast("double").alias("doubleValue"),
        F.lit(None).cast("boolean").alias("boolValue"),
    )
    return F.when(present.isNotNull(), F.struct(F.lit(key).alias("key"), value.alias("value")))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``spans`` view with its flat measures folded into an attribute list."""
    return _with_attributes(view(spark, sf_dir, "spans"))


def stored_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written once: for queries that go through whole spans with their attributes several times."""
    return once(spark, sf_dir, "spans", lambda: spans(spark, sf_dir))


def _with_attributes(flat: DataFrame) -> DataFrame:
    c = F.col
    attributes = F.array_compact(
        F.array(
            _attribute("http.response.status_code", integer=c("http_status")),
            _attribute("db.connection_pool.saturation_pct", integer=c("db_pool_pct")),
            _attribute("db.cpu_utilization_pct", integer=c("db_cpu_pct")),
            _attribute("db.query.fingerprint", string=c("db_fingerprint")),
            _attribute("db.lock_wait_ms", integer=c("db_lock_wait_ms")),
            _attribute("db.holding_lock_pid", integer=c("db_holder_pid")),
            _attribute("db.blocking_trace_id", string=c("db_blocking_trace")),
            _attribute("client.package", string=c("client_package")),
        )
    )
    return flat.withColumn("attributes", attributes).drop(
        "http_status", "db_pool_pct", "db_cpu_pct", "db_fingerprint", "db_lock_wait_ms",
        "db_holder_pid", "db_blocking_trace", "client_package",
    )
