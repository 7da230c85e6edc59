"""Putting requests together from their spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.attributes import http_status
from spanwise.functions.binding import let
from spanwise.functions.timing import span_kind
from spanwise.operators.observations import with_obs_key
from spanwise.operators.ordered import oversized
from spanwise.session import keep

SERVER, CLIENT = 2, 3
#: Hops of a path that are put together first, and spans of a trace that one row may hold while its tree is
#: judged. Both say how the work is cut up; no answer depends on them.
CHUNK = GATHER = 1000


def hop_name() -> Column:
    return F.concat(F.coalesce("service", F.lit("")), F.lit("::"), F.coalesce("name", F.lit("")))


def duration() -> Column:
    return F.coalesce(F.col("duration_ms"), F.lit(0))


def worst_status() -> Column:
    rank = F.max(F.when(F.col("status") == "ERROR", 2).when(F.col("status") == "DEGRADED", 1).otherwise(0))
    return F.when(rank == 2, "ERROR").when(rank == 1, "DEGRADED").otherwise("OK")


def trace_summaries(spans: DataFrame) -> DataFrame:
    """One row per trace, slowest first."""
    slowest = F.max_by(F.struct("span_id", "service", "name", "duration_ms"), F.struct(duration(), -F.col("ingest_seq")))
    return (
        spans.groupBy("trace_id")
        .agg(
            F.count(F.lit(1)).alias("hop_count"),
            F.sum(duration()).alias("total_ms"),
            worst_status().alias("status"),
            F.sort_array(F.collect_set("service")).alias("services"),
            slowest.alias("slowest_hop"),
        )
        .orderBy(F.desc("total_ms"), "trace_id")
    )


def _observed_http(spans: DataFrame) -> Column:
    """First status key of a hop, as the DNA record reads it (no agreement needed)."""
    codes = F.filter("attributes", lambda a: a["key"] == "http.status_code")
    newer = F.filter("attributes", lambda a: a["key"] == "http.response.status_code")
    value = F.coalesce(F.get(codes, F.lit(0))["value"], F.get(newer, F.lit(0))["value"])
    return F.coalesce(value["intValue"], value["stringValue"]).try_cast("int")


def request_dna(spans: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The observed shape of each request; nothing is filled in.

    Paths and hop latencies are complete for traces of any size: chunks of arrival numbers are put
    together first and then joined in order. ``request_path_chunks`` gives them as rows.
    """
    seq = F.col("ingest_seq")
    rows = spans.select(
        "trace_id", "ingest_seq", "service", "duration_ms", "status", "service_version", "deployment_environment",
        _observed_http(spans).alias("code"),
    )
    facts = rows.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("hop_count"),
        F.sum(duration()).alias("total_ms"),
        F.min_by("code", F.when(F.col("code").isNotNull(), seq)).alias("http_status"),
        F.max((F.col("status") == "ERROR").cast("int")).alias("errored"),
        F.sort_array(F.collect_set("service")).alias("dependencies"),
        F.min_by("deployment_environment", F.when(F.col("deployment_environment").isNotNull(), seq)).alias(
            "deployment_environment"
        ),
    )
    reported = F.col("service_version").isNotNull() & F.col("service").isNotNull()
    versions = (
        rows.filter(reported)
        .groupBy("trace_id", "service")
        .agg(F.max_by("service_version", seq).alias("version"))
        .groupBy("trace_id")
        .agg(F.sort_array(F.collect_list(F.struct("service", "version"))).alias("service_versions"))
    )
    # Each chunk becomes a piece of text, so a trace is put together from pieces and not from its hops.
    parts = (
        rows.groupBy("trace_id", F.floor((seq - 1) / chunk).alias("chunk_no"))
        .agg(F.sort_array(F.collect_list(F.struct("ingest_seq", "service", "duration_ms"))).alias("part"))
        .select(
            "trace_id",
            "chunk_no",
            F.array_join(F.transform("part", lambda h: F.coalesce(h["service"], F.lit(""))), "->").alias("path"),
            F.transform("part", lambda h: F.struct(h["service"].alias("service"), h["duration_ms"].alias("ms"))).alias("ms"),
        )
    )

    def in_order(column: str) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", column))), lambda p: p[column])

    paths = parts.groupBy("trace_id").agg(
        F.array_join(in_order("path"), "->").alias("path"), F.flatten(in_order("ms")).alias("hop_latencies")
    )
    return (
        facts.join(versions, "trace_id", "left")
        .join(paths, "trace_id", "left")
        .select(
            "trace_id",
            "path",
            "hop_count",
            "total_ms",
            "hop_latencies",
            "http_status",
            F.when(F.col("http_status").isNotNull(), "OBSERVED")
            .when(F.col("errored") == 1, "UNKNOWN: a span reported an error but no HTTP status was ingested")
            .otherwise("UNKNOWN: no HTTP status was ingested")
            .alias("http_status_provenance"),
            "dependencies",
            "service_versions",
            "deployment_environment",
        )
    )


def request_path_chunks(spans: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The path of every trace in pieces of bounded length, numbered in arrival order."""
    return (
        spans.groupBy("trace_id", F.floor((F.col("ingest_seq") - 1) / chunk).alias("chunk_no"))
        .agg(F.sort_array(F.collect_list(F.struct("ingest_seq", "service", "duration_ms"))).alias("hops"))
        .select(
            "trace_id",
            "chunk_no",
            F.array_join(F.transform("hops", lambda h: F.coalesce(h["service"], F.lit(""))), "->").alias("path"),
            F.transform("hops", lambda h: h["duration_ms"]).alias("latencies_ms"),
        )
    )


def dna_diff(golden: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """What is known to differ between two DNA records with the same key.

    ``is_identical`` is NULL where nothing differs but a path is unknown on either side.
    """
    known = F.col("g_path").isNotNull() & F.col("path").isNotNull()
    g = golden.select(key, F.col("path").alias("g_path"), F.col("total_ms").alias("g_total"), F.col("http_status").alias("g_http"))
    diffs = F.array_compact(
        F.array(
            F.when(
                F.col("g_path") != F.col("path"),
                F.concat(F.lit("STRUCTURE: expected ["), "g_path", F.lit("], observed ["), "path", F.lit("]")),
            ),
            F.when(
                F.col("total_ms") > F.col("g_total"),
                F.concat(
                    F.lit("PERFORMANCE: "), F.col("total_ms").cast("string"), F.lit("ms exceeds "),
                    F.col("g_total").cast("string"), F.lit("ms"),
                ),
            ),
            F.when(
                F.col("http_status") != F.col("g_http"),
                F.concat(
                    F.lit("SEMANTIC: status "), F.col("http_status").cast("string"), F.lit(", expected "),
                    F.col("g_http").cast("string"),
                ),
            ),
        )
    )
    return (
        live.join(g, key)
        .select("trace_id", key, diffs.alias("deviations"), known.alias("known"))
        .withColumn("diff_count", F.size("deviations"))
        .withColumn("is_identical", F.when(F.col("diff_count") > 0, False).when(F.col("known"), True))
        .drop("known")
    )


def _span_ids(spans: DataFrame) -> DataFrame:
    return spans.groupBy("trace_id", "span_id").agg(F.count(F.lit(1)).alias("observations"))


def trace_profile(spans: DataFrame, gather: int = GATHER) -> DataFrame:
    """Per trace: shape, identity, total, health and structure.

    Traces of up to ``gather`` spans are put together in one row each, after one shuffle; larger ones by joins.
    Whether there are larger ones is counted when the plan is built.
    """
    large = oversized(spans, ["trace_id"], gather).select("trace_id")
    if large.isEmpty():
        return _profile_gathered(spans)
    large = keep(large, "large-profiles")
    few, many = spans.join(large, "trace_id", "left_anti"), spans.join(large, "trace_id", "left_semi")
    return _profile_gathered(few).unionByName(_profile_joined(many))


def _profile_gathered(spans: DataFrame) -> DataFrame:
    """The profile of traces that fit one row."""
    c = F.col
    rows = spans.filter(c("trace_id").isNotNull()).select(
        "trace_id", "span_id", F.nullif("parent_span_id", F.lit("")).alias("parent"), "service", "name", "observed_ms",
        duration().alias("ms"), c("status").isin("ERROR", "DEGRADED").cast("int").alias("bad"),
    )
    grouped = rows.repartition("trace_id").groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("span_count"),
        F.sum("ms").alias("total_ms"),
        (F.max("bad") == 0).alias("healthy"),
        F.min("observed_ms").alias("first_seen_ms"),
        F.collect_list(F.struct("span_id", "parent", "service", "name", "observed_ms")).alias("hops"),
    )
    return _profile_of_hops(grouped)


def profile_of_observations(rows: DataFrame, largest: int, gather: int = GATHER) -> DataFrame:
    """The profile of traces whose ``observations`` stand in one row each already, so that nothing is shuffled.

    ``largest``: the most observations of one trace; traces beyond ``gather`` are taken apart and put together by joins.
    """
    some = rows.filter(F.col("trace_id").isNotNull())
    few = some.filter(F.size("observations") <= gather) if largest > gather else some
    bad = lambda o: o["status"].isin("ERROR", "DEGRADED")
    grouped = few.select(
        "trace_id",
        F.size("observations").cast("bigint").alias("span_count"),
        F.aggregate("observations", F.lit(0).cast("bigint"), lambda n, o: n + F.coalesce(o["duration_ms"], F.lit(0))).alias("total_ms"),
        F.when(F.exists("observations", lambda o: F.coalesce(bad(o), F.lit(False))), False)
        .when(F.exists("observations", lambda o: o["status"].isNotNull()), True).alias("healthy"),
        F.array_min(F.transform("observations", lambda o: o["observed_ms"])).alias("first_seen_ms"),
        F.transform("observations", lambda o: F.struct(
            o["span_id"].alias("span_id"), F.nullif(o["parent_span_id"], F.lit("")).alias("parent"), o["service"].alias("service"),
            o["name"].alias("name"), o["observed_ms"].alias("observed_ms"),
        )).alias("hops"),
    )
    if largest <= gather:
        return _profile_of_hops(grouped)
    many = some.filter(F.size("observations") > gather).select("trace_id", F.explode("observations").alias("o")).select("trace_id", "o.*")
    return _profile_of_hops(grouped).unionByName(_profile_joined(many))


def _profile_of_hops(grouped: DataFrame) -> DataFrame:
    c = F.col
    ids = F.transform("hops", lambda h: h["span_id"])
    parents = F.filter(F.transform("hops", lambda h: h["parent"]), lambda p: p.isNotNull())

    def first_hop(hops: Column) -> Column:
        return F.array_min(F.transform(hops, lambda h: F.struct(
            F.coalesce(h["observed_ms"], F.lit(0)).alias("at"), F.coalesce(h["span_id"], F.lit("")).alias("span_id"),
            h["service"].alias("service"), h["name"].alias("name"),
        )))

    def roots(missing: Column) -> Column:
        top = F.filter("hops", lambda h: h["parent"].isNull() | F.array_contains(missing, h["parent"]))
        return F.struct(F.size(missing).cast("bigint").alias("external"), top.alias("top"))

    def repeated(sorted_ids: Column) -> Column:
        again = F.filter(sorted_ids, lambda x, i: (i > 0) & x.eqNullSafe(F.get(sorted_ids, i - 1)))
        return F.size(F.array_distinct(again))

    several = F.size(F.array_distinct(ids)) < F.size(ids)
    names = F.transform(
        "hops", lambda h: F.concat(F.coalesce(h["service"], F.lit("")), F.lit("::"), F.coalesce(h["name"], F.lit("")))
    )
    shape = grouped.withColumn("walk", let(F.array_except(parents, ids), roots)).select(
        "trace_id", "span_count",
        F.size("walk.top").cast("bigint").alias("root_count"),
        c("walk.external").alias("external_parents"),
        F.when(several, let(F.array_sort(ids), repeated)).otherwise(0).cast("bigint").alias("duplicate_span_ids"),
        F.coalesce(first_hop(c("walk.top")), first_hop(c("hops"))).alias("root"),
        "total_ms", "healthy", "first_seen_ms", F.sort_array(F.array_distinct(names)).alias("structure"),
    )
    return shape.select(
        "trace_id", "span_count", "root_count", "external_parents", "duplicate_span_ids", _request_key(),
        "total_ms", "healthy", "first_seen_ms", "structure",
    )


def _request_key() -> Column:
    named = (F.length("root.service") > 0) & (F.length("root.name") > 0)
    single = (F.col("root_count") <= 1) & (F.col("duplicate_span_ids") == 0)
    return F.when(named & single, F.concat("root.service", F.lit("::"), "root.name")).alias("request_key")


def _profile_joined(spans: DataFrame) -> DataFrame:
    """The profile of traces of any size.

    Children are summed up per (trace, parent) before the parent is looked up, so a parent with
    millions of children costs one row.
    """
    hop = F.struct(
        F.coalesce("observed_ms", F.lit(0)).alias("at"),
        F.coalesce("span_id", F.lit("")).alias("span_id"),
        "service",
        "name",
    )
    by_parent = spans.groupBy("trace_id", F.nullif("parent_span_id", F.lit("")).alias("parent_span_id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(hop).alias("first_hop"),
        F.sum(duration()).alias("total_ms"),
        F.max((F.col("status").isin("ERROR", "DEGRADED")).cast("int")).alias("bad"),
        F.min("observed_ms").alias("first_seen_ms"),
    )
    ids = _span_ids(spans)
    present = ids.select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("present"))
    root = F.col("present").isNull()
    shape = (
        by_parent.join(present, ["trace_id", "parent_span_id"], "left")
        .groupBy("trace_id")
        .agg(
            F.sum("n").alias("span_count"),
            F.sum(F.when(root, F.col("n")).otherwise(0)).alias("root_count"),
            F.sum((root & F.col("parent_span_id").isNotNull()).cast("bigint")).alias("external_parents"),
            F.coalesce(F.min(F.when(root, F.col("first_hop"))), F.min("first_hop")).alias("root"),
            F.sum("total_ms").alias("total_ms"),
            (F.max("bad") == 0).alias("healthy"),
            F.min("first_seen_ms").alias("first_seen_ms"),
        )
    )
    repeated = ids.groupBy("trace_id").agg(
        F.sum((F.col("observations") > 1).cast("bigint")).alias("duplicate_span_ids")
    )
    structure = structure_of(spans).select("trace_id", "structure")
    return shape.join(repeated, "trace_id").join(structure, "trace_id").select(
        "trace_id", "span_count", "root_count", "external_parents", "duplicate_span_ids", _request_key(),
        "total_ms", "healthy", "first_seen_ms", "structure",
    )


def trace_shape(spans: DataFrame) -> DataFrame:
    return trace_profile(spans).select("trace_id", "span_count", "root_count", "external_parents", "duplicate_span_ids")


def external_parents(spans: DataFrame) -> DataFrame:
    """Parents that are referred to but were never ingested, one row each."""
    wanted = spans.filter(F.length("parent_span_id") > 0).groupBy("trace_id", "parent_span_id").agg(
        F.count(F.lit(1)).alias("children")
    )
    ids = _span_ids(spans).select("trace_id", F.col("span_id").alias("parent_span_id"))
    return wanted.join(ids, ["trace_id", "parent_span_id"], "left_anti")


def request_key(spans: DataFrame) -> DataFrame:
    """NULL where a trace is not one request or its root is unnamed."""
    return trace_profile(spans).select("trace_id", "request_key")


def structure_of(spans: DataFrame) -> DataFrame:
    """The set of hops of each trace; order of arrival means nothing here."""
    return (
        spans.groupBy("trace_id")
        .agg(F.sort_array(F.collect_set(hop_name())).alias("structure"))
        .withColumn("signature", F.array_join("structure", "|"))
    )


def repeated_spans(spans: DataFrame) -> DataFrame | None:
    """The (trace_id, span_id) seen more than once, written once; None where there are none.

    A table whose size is known when a plan is built: a small one filters the spans before anything of theirs is
    computed or shuffled.
    """
    keys = ["trace_id", "span_id"]
    several = spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select(*keys)
    several = keep(several, "repeated-spans")
    return None if several.isEmpty() else several


def unique_spans(spans: DataFrame) -> DataFrame:
    """First observation of each span, with its exact copies counted and conflicts marked.

    Only spans seen more than once are compared by content; the others pass through untouched. Which these are is
    looked up when the plan is built.
    """
    keys = ["trace_id", "span_id"]
    kept = [c for c in spans.columns if c not in (*keys, "obs_key")]
    repeated = repeated_spans(spans)
    once = (F.lit(0).cast("bigint").alias("exact_copies"), F.lit(False).alias("conflicting"))
    if repeated is None:
        return spans.select(*keys, *kept, *once)
    single = spans.join(repeated, keys, "left_anti").select(*keys, *kept, *once)
    variants = (
        with_obs_key(spans)
        .join(repeated, keys, "left_semi")
        .groupBy(*keys, "obs_key")
        .agg(F.count(F.lit(1)).alias("copies"), F.min_by(F.struct(*kept), "ingest_seq").alias("first"))
    )
    several = (
        variants.groupBy(*keys)
        .agg(
            F.min_by(F.struct("copies", "first"), F.col("first.ingest_seq")).alias("kept"),
            F.count(F.lit(1)).alias("variants"),
        )
        .select(
            *keys,
            *[F.col(f"kept.first.{c}").alias(c) for c in kept],
            (F.col("kept.copies") - 1).alias("exact_copies"),
            (F.col("variants") > 1).alias("conflicting"),
        )
    )
    return single.unionByName(several)


def trace_tree(spans: DataFrame, boundary: bool = False, gather: int = GATHER) -> DataFrame:
    """Is each trace one intact tree? (state, reasons, copies collapsed, conflicting spans)

    Traces of any size get the same answer. With ``boundary`` the stricter test applies: valid timing
    everywhere and no repeated span id at all.
    """
    columns = ["trace_id", "span_id", "parent_span_id", "ingest_seq", "obs_key"]
    if boundary:
        columns.append("timing_valid")
    return tree_of(unique_spans(with_obs_key(spans).select(*columns)), boundary, gather)


def tree_of(unique: DataFrame, boundary: bool = False, gather: int = GATHER) -> DataFrame:
    """``trace_tree`` over spans that are unique already.

    Traces of up to ``gather`` spans are walked in one row each; larger ones by joins, one per doubling of
    the climb. Whether there are larger ones is counted when the plan is built.
    """
    large = oversized(unique, ["trace_id"], gather).select("trace_id")
    if large.isEmpty():
        return _judged(_walked(unique, boundary), boundary)
    large = keep(large, "large-traces")
    small = unique.join(large, "trace_id", "left_anti")
    return _judged(_walked(small, boundary).unionByName(_climbed(unique.join(large, "trace_id", "left_semi"), boundary)), boundary)


def _bad_id(x: Column) -> Column:
    return F.coalesce(~x.rlike("^[a-f0-9]{16}$") | x.rlike("^0+$"), F.lit(True))


def _trace_facts(boundary: bool) -> list[Column]:
    return [
        F.sum("exact_copies").alias("duplicates_collapsed"),
        F.sort_array(F.collect_list(F.when(F.col("conflicting"), F.col("span_id")))).alias("conflicts"),
        (F.min(F.coalesce("timing_valid", F.lit(False))) if boundary else F.min(F.lit(True))).alias("timed"),
    ]


_FACTS = ("trace_id", "duplicates_collapsed", "conflicts", "timed", "roots", "bad_ids", "missing", "cyclic")


def _climbed(unique: DataFrame, boundary: bool) -> DataFrame:
    """The facts of large traces without gathering one: parents are looked up and climbed by joins."""
    kept = ["exact_copies", "conflicting", *(["timing_valid"] if boundary else [])]
    c = F.col
    rows = keep(unique.select("trace_id", "span_id", F.nullif("parent_span_id", F.lit("")).alias("parent"), *kept), "large-spans")
    facts = rows.groupBy("trace_id").agg(
        *_trace_facts(boundary), F.sum(c("parent").isNull().cast("int")).cast("int").alias("roots"), F.max(_bad_id(c("span_id"))).alias("bad_ids")
    )
    ids = rows.select("trace_id", c("span_id").alias("parent"), F.lit(True).alias("present"))
    parents = rows.filter(c("parent").isNotNull()).groupBy("trace_id", "parent").agg(F.count(F.lit(1)).alias("children"))
    missing = (
        parents.join(ids, ["trace_id", "parent"], "left").groupBy("trace_id")
        .agg(F.max(_bad_id(c("parent")) | c("present").isNull()).alias("missing"))
    )
    # Each round doubles the climb and drops whoever got out; spans on or below a cycle are left.
    up = rows.filter(c("parent").isNotNull()).select("trace_id", "span_id", c("parent").alias("up"))
    up = keep(up.join(ids.select("trace_id", c("parent").alias("up")), ["trace_id", "up"], "left_semi").select("trace_id", "span_id", "up"), "climb")
    left = up.count()
    while left:
        above = up.select("trace_id", c("span_id").alias("up"), c("up").alias("next"))
        up = keep(up.join(above, ["trace_id", "up"]).select("trace_id", "span_id", c("next").alias("up")), "climb")
        now = up.count()
        if now == left:
            break
        left = now
    cyclic = up.select("trace_id").distinct().withColumn("cyclic", F.lit(True))
    out = facts.join(missing, "trace_id", "left").join(cyclic, "trace_id", "left").fillna(False, ["missing", "cyclic"])
    return out.select(*_FACTS)


def _walked(unique: DataFrame, boundary: bool) -> DataFrame:
    """The same facts for traces that fit one row."""
    link = F.struct("span_id", F.nullif("parent_span_id", F.lit("")).alias("parent"))
    grouped = unique.groupBy("trace_id").agg(F.sort_array(F.collect_list(link)).alias("links"), *_trace_facts(boundary))

    def place(v: Column) -> Column:
        up = F.transform(
            v["parents"], lambda p: F.nullif(F.array_position(v["ids"], p), F.lit(0)).cast("int")
        )
        return let(F.struct(v["ids"].alias("ids"), v["parents"].alias("parents"), up.alias("up")), judge)

    def judge(w: Column) -> Column:
        # Each round doubles the climb; whoever still has an ancestor afterwards never gets out.
        rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(w["ids"]) + 1)).cast("int") + 1)
        far = F.aggregate(rounds, w["up"], lambda acc, _: F.transform(acc, lambda i: F.element_at(acc, i)))
        missing = F.exists(
            F.arrays_zip(w["parents"].alias("parent"), w["up"].alias("up")),
            lambda x: x["parent"].isNotNull() & (_bad_id(x["parent"]) | x["up"].isNull()),
        )
        return F.struct(
            F.size(F.filter(w["parents"], lambda p: p.isNull())).alias("roots"),
            F.exists(w["ids"], _bad_id).alias("bad_ids"),
            missing.alias("missing"),
            F.exists(far, lambda i: i.isNotNull()).alias("cyclic"),
        )

    ids = F.transform("links", lambda x: x["span_id"])
    parents = F.transform("links", lambda x: x["parent"])
    walked = grouped.withColumn("walk", let(F.struct(ids.alias("ids"), parents.alias("parents")), place))
    return walked.select("trace_id", "duplicates_collapsed", "conflicts", "timed", "walk.*").select(*_FACTS)


def _judged(facts: DataFrame, boundary: bool) -> DataFrame:
    roots = F.col("roots")
    bad_trace = F.coalesce(~F.col("trace_id").rlike("^[a-f0-9]{32}$") | F.col("trace_id").rlike("^0+$"), F.lit(True))
    repeated = F.size("conflicts") > 0
    if boundary:
        repeated = repeated | (F.col("duplicates_collapsed") > 0)
    judged = facts.select(
        "trace_id",
        F.array_compact(
            F.array(
                F.when(bad_trace, "Invalid trace ID"),
                F.when(roots != 1, F.concat(F.lit("Expected one root; observed "), roots.cast("string"))),
                F.when(repeated, "Conflicting observations share a span ID"),
                F.when(F.col("bad_ids"), "Invalid span ID"),
                F.when(F.col("missing"), "Missing or invalid parent"),
                F.when(F.col("cyclic"), "Cycle in parent links"),
                F.when(~F.col("timed"), "Missing or invalid span timestamps"),
            )
        ).alias("reasons"),
        "duplicates_collapsed",
        "conflicts",
    )
    return judged.withColumn("state", F.when(F.size("reasons") == 0, "OBSERVED_TREE").otherwise("UNKNOWN"))


def _servers_below(spans: DataFrame) -> DataFrame:
    """Children per (trace, parent, service): how many are SERVER spans, and the first of them."""
    server = span_kind(F.col("kind")) == SERVER
    return (
        spans.filter(server & (F.length("parent_span_id") > 0))
        .groupBy("trace_id", F.col("parent_span_id").alias("span_id"), F.col("service").alias("to_service"))
        .agg(F.count(F.lit(1)).alias("servers"), F.min("span_id").alias("server_span_id"))
    )


def _client_calls(spans: DataFrame) -> DataFrame:
    clients = spans.filter(span_kind(F.col("kind")) == CLIENT).select(
        "trace_id", "span_id", "ingest_seq", F.col("service").alias("from_service")
    )
    reached = clients.join(_servers_below(spans), ["trace_id", "span_id"], "left")
    remote = ~F.col("to_service").eqNullSafe(F.col("from_service")) & F.col("servers").isNotNull()
    return reached.groupBy("trace_id", "span_id", "ingest_seq", "from_service").agg(
        F.coalesce(F.sum(F.when(remote, F.col("servers"))), F.lit(0)).alias("targets"),
        F.min(F.when(remote, F.col("to_service"))).alias("to_service"),
        F.min(F.when(remote, F.col("server_span_id"))).alias("server_span_id"),
    )


def service_edges(spans: DataFrame) -> DataFrame:
    """CLIENT span to its only SERVER child in another service. Co-presence makes no edge."""
    return (
        _client_calls(spans)
        .filter(F.col("targets") == 1)
        .select(
            "trace_id", "from_service", "to_service", F.col("span_id").alias("client_span_id"), "server_span_id"
        )
    )


def unchecked_edges(spans: DataFrame) -> DataFrame:
    """Interactions that were seen but cannot be called an edge, with the reason."""
    no_peer = (
        _client_calls(spans)
        .filter(F.col("targets") != 1)
        .select("trace_id", "span_id", F.lit("NO_UNIQUE_SERVER_CHILD").alias("reason"))
    )
    kind = span_kind(F.col("kind"))
    parents = (
        spans.groupBy("trace_id", "span_id")
        .agg(F.max_by(F.struct("service", kind.alias("kind")), "ingest_seq").alias("parent"))
        .select("trace_id", F.col("span_id").alias("parent_span_id"), "parent")
    )
    children = spans.filter(F.length("parent_span_id") > 0).select(
        "trace_id", "parent_span_id", "span_id", "service", kind.alias("kind")
    )
    proper = F.coalesce((F.col("parent.kind") == CLIENT) & (F.col("kind") == SERVER), F.lit(False))
    wrong_kinds = (
        children.join(parents, ["trace_id", "parent_span_id"])
        .filter(~F.col("parent.service").eqNullSafe(F.col("service")) & ~proper)
        .select("trace_id", "span_id", F.lit("CROSS_SERVICE_WITHOUT_CLIENT_SERVER").alias("reason"))
    )
    return no_peer.unionByName(wrong_kinds)


def with_http_status(spans: DataFrame) -> DataFrame:
    """Add ``http_status`` and ``http_conflict`` read strictly from the attributes."""
    return (
        spans.withColumn("_http", http_status(F.col("attributes")))
        .withColumns({"http_status": F.col("_http.value"), "http_conflict": F.col("_http.conflict")})
        .drop("_http")
    )
