"""Traces, baselines and investigations on literal spans."""

import re

from pyspark.sql import functions as F

from spanwise.operators import baseline, fleet, investigate, observations, ordered, traces
from spanwise.schema import SPANS

T = "a" * 31 + "{}"
TRACE = "0123456789abcdef0123456789abcdef"


def sid(n):
    return f"{n:016x}"


def span(n, parent=None, trace=TRACE, **over):
    row = dict.fromkeys(SPANS.fieldNames())
    row.update(
        trace_id=trace, span_id=sid(n), parent_span_id=sid(parent) if parent else None, kind=2, service="api", name=f"op{n}",
        start_ns=1_000_000_000 + n, end_ns=1_005_000_000 + n, timing_valid=True, duration_ms=5, observed_ms=1000 + n, received_ms=2000,
        otel_status_code=1, status="OK", attributes=[], ingest_seq=n,
    )
    row.update(over)
    return tuple(row[f] for f in SPANS.fieldNames())


def frame(spark, *rows):
    from decimal import Decimal

    fixed = [tuple(Decimal(v) if f.name in ("start_ns", "end_ns") and v is not None else v for f, v in zip(SPANS, r)) for r in rows]
    return spark.createDataFrame(fixed, SPANS)


def code(value, key="http.status_code"):
    return {"key": key, "value": {"intValue": str(value)}}


def test_intact_tree(spark):
    row = traces.trace_tree(frame(spark, span(1), span(2, 1), span(3, 2))).first()
    assert row.state == "OBSERVED_TREE" and row.reasons == []


def test_cycle_and_everything_below_it(spark):
    row = traces.trace_tree(frame(spark, span(1, 3), span(2, 1), span(3, 2), span(4, 3))).first()
    assert row.state == "UNKNOWN" and "Cycle in parent links" in row.reasons


def test_long_chain_is_no_cycle(spark):
    rows = [span(1)] + [span(n, n - 1) for n in range(2, 301)]
    assert traces.trace_tree(frame(spark, *rows)).first().state == "OBSERVED_TREE"


def test_large_and_small_traces_are_judged_alike(spark):
    chain = [span(1)] + [span(n, n - 1) for n in range(2, 40)]
    cases = [chain, chain[1:], chain + [span(50, 51), span(51, 50)], chain + [span(3, 2, ingest_seq=99, duration_ms=77)], [span(1), span(2)]]
    for rows in cases:
        data = frame(spark, *rows)
        for boundary in (False, True):
            small, large = (traces.trace_tree(data, boundary, gather=g).first() for g in (1000, 1))
            assert small.asDict() == large.asDict()


def test_exact_copies_collapse_and_conflicts_do_not(spark):
    copy = traces.trace_tree(frame(spark, span(1), span(1, ingest_seq=9, received_ms=7))).first()
    assert copy.state == "OBSERVED_TREE" and copy.duplicates_collapsed == 1
    clash = traces.trace_tree(frame(spark, span(1), span(1, ingest_seq=9, duration_ms=6))).first()
    assert clash.conflicts == [sid(1)] and clash.state == "UNKNOWN"


def test_spans_seen_once_are_not_hashed(spark):
    def plan(*rows):
        return traces.unique_spans(observations.with_obs_key(frame(spark, *rows)))._jdf.queryExecution().optimizedPlan().toString()

    assert "sha2" not in plan(span(1), span(2, 1)).lower() and "Join" not in plan(span(1), span(2, 1))
    twice = traces.unique_spans(frame(spark, span(1), span(2, 1), span(2, 1, ingest_seq=7))).collect()
    assert sorted((r.span_id, r.exact_copies) for r in twice) == [(sid(1), 0), (sid(2), 1)]


def test_integral_timestamps_are_timed_like_text(spark):
    from spanwise.functions.timing import timing_ms

    rows = [(1, 3_000_001), (5, 4), (0, 7), (-1, 7), (None, 7), (7, None), (1, 2**63 - 1), (4, 4)]
    a, b = F.col("a"), F.col("b")
    got = spark.createDataFrame(rows, "a long, b long").select(timing_ms(a, b, True).alias("x"), timing_ms(a, b).alias("y"))
    assert all(r.x == r.y for r in got.collect())
    plan = investigate.base_spans(frame(spark, span(1)).withColumns({k: F.col(k).cast("long") for k in ("start_ns", "end_ns")}))
    assert "RLIKE" not in plan.select("own_ms")._jdf.queryExecution().optimizedPlan().toString()


def test_reordered_attributes_are_the_same_observation(spark):
    a, b = code(200), code(1, "retries")
    merged = observations.merge_observations(
        frame(spark, span(1, attributes=[a, b])), frame(spark, span(1, attributes=[b, a], ingest_seq=5)), F.col("ingest_seq")
    )
    assert merged.count() == 0


def test_repeated_attributes_are_evidence(spark):
    a = code(200)
    counts = observations.merge_counts(frame(spark, span(1, attributes=[a])), frame(spark, span(1, attributes=[a, a]))).first()
    assert (counts.added, counts.duplicates, counts.conflicts) == (1, 0, 1)


def test_batch_of_roots_is_unknown(spark):
    profile = traces.trace_profile(frame(spark, span(1, 99), span(2, 99), span(3, 99)))
    row = profile.first()
    assert row.root_count == 3 and row.request_key is None
    verdict = baseline.baseline_verdict(profile, baseline.baselines(baseline.healthy_samples(profile))).first()
    assert verdict.verdict == "UNKNOWN" and "batch" in verdict.reason


def history(n, ms=5, **over):
    return [span(1, trace=f"{i:032x}", duration_ms=ms, observed_ms=1000 + i, **over) for i in range(1, n + 1)]


def verdicts(spark, rows):
    profile = traces.trace_profile(frame(spark, *rows))
    return {r.trace_id: r for r in baseline.baseline_verdict(profile, baseline.baselines(baseline.healthy_samples(profile))).collect()}


def test_below_minimum_is_unknown_never_healthy(spark):
    assert {v.verdict for v in verdicts(spark, history(4)).values()} == {"UNKNOWN"}
    assert {v.verdict for v in verdicts(spark, history(5)).values()} == {"HEALTHY"}


def test_slow_and_missing_hops_deviate_and_unhealthy_is_not_learned(spark):
    rows = []
    for i in range(1, 8):
        rows += [span(1, trace=f"{i:032x}", observed_ms=i), span(2, 1, trace=f"{i:032x}", observed_ms=i)]
    slow, short = "f" * 32, "e" * 32
    rows += [span(1, trace=slow, duration_ms=5000, status="DEGRADED"), span(2, 1, trace=slow), span(1, trace=short)]
    found = verdicts(spark, rows)
    assert [d.type for d in found[slow].deviations] == ["LATENCY"]
    assert [d.type for d in found[short].deviations] == ["STRUCTURE_MISSING"]
    assert found[slow].request_key == "api::op1" and found[slow].observations == 8


def test_input_order_never_matters(spark):
    rows = [span(1), span(2, 1, service="db"), span(3, 1, service="web", status="ERROR", otel_status_code=2)]
    for operator in (traces.trace_summaries, traces.request_dna, fleet.all_incidents, investigate.investigations):
        one, two = operator(frame(spark, *rows)).first(), operator(frame(spark, *reversed(rows))).first()
        assert one == two


def test_sub_millisecond_timing(spark):
    row = investigate.investigations(frame(spark, span(1, start_ns=1_000_000_000, end_ns=1_000_250_000))).first()
    assert row.root_ms == 0.25 and row.timing_provenance == "OBSERVED"


def test_status_conflict_is_unknown(spark):
    attrs = [code(200), code(500, "http.response.status_code")]
    row = investigate.investigations(frame(spark, span(1, attributes=attrs))).first()
    assert row.outcome == "UNKNOWN" and "OUTCOME" in row.gaps


def test_resend_keeps_the_revision(spark):
    rows = frame(spark, span(1), span(2, 1))
    merged = observations.merge_observations(rows, frame(spark, span(2, 1, received_ms=9, ingest_seq=77)), F.col("ingest_seq"))
    before = investigate.revisions(rows).first().revision
    assert investigate.revisions(rows.unionByName(merged.select(*rows.columns))).first().revision == before


def test_edge_needs_one_server_child(spark):
    client = span(1, kind=3, service="web")
    one = traces.service_edges(frame(spark, client, span(2, 1, service="db")))
    assert [(r.from_service, r.to_service) for r in one.collect()] == [("web", "db")]
    two = frame(spark, client, span(2, 1, service="db"), span(3, 1, service="db"))
    assert traces.service_edges(two).count() == 0
    assert [r.reason for r in traces.unchecked_edges(two).collect()] == ["NO_UNIQUE_SERVER_CHILD"]


def test_blocked_running_total_equals_plain_window(spark):
    df = spark.range(500).selectExpr("id % 3 as k", "id as o", "id * 7 % 13 as v")
    for inclusive in (True, False):
        got = ordered.running_total(df, ["k"], [F.col("o")], F.col("v"), F.floor(F.col("o") / 10), "total", inclusive)
        total = {}
        for r in got.orderBy("o").collect():
            before = total.get(r.k, 0)
            total[r.k] = before + r.v
            assert r.total == (total[r.k] if inclusive else before)


def test_blocked_last_known_equals_plain_window(spark):
    df = spark.range(200).selectExpr("id % 2 as k", "id as o", "case when id % 17 = 0 then id end as v")
    got = ordered.last_known(df, ["k"], [F.col("o")], F.col("v"), F.floor(F.col("o") / 10), "last")
    seen = {}
    for r in got.orderBy("o").collect():
        seen[r.k] = r.v if r.v is not None else seen.get(r.k)
        assert r.last == seen[r.k]


def test_hot_trace_profile(spark):
    """One trace with most of the rows and one parent for all of them."""
    hot = spark.range(20_000).selectExpr(
        f"'{TRACE}' as trace_id", "lpad(hex(id + 2), 16, '0') as span_id", "lpad('1', 16, '0') as parent_span_id", "'api' as service",
        "'op' as name", "1L as duration_ms", "id as observed_ms", "'OK' as status", "id + 2 as ingest_seq", "2 as kind",
    )
    root = spark.sql(
        f"select '{TRACE}' trace_id, lpad('1',16,'0') span_id, cast(null as string) parent_span_id, 'web' service, 'root' name, 1L duration_ms, "
        "0L observed_ms, 'OK' status, 1L ingest_seq, 3 kind"
    )
    both = hot.unionByName(root)
    row = traces.trace_profile(both).first()
    assert (row.span_count, row.root_count, row.request_key) == (20_001, 1, "web::root")
    assert traces.request_dna(both.withColumns({
        "attributes": F.array().cast("array<struct<key:string,value:struct<stringValue:string,intValue:string>>>"),
        "service_version": F.lit(None).cast("string"), "deployment_environment": F.lit(None).cast("string"),
    })).first().hop_count == 20_001
    chunks = traces.request_path_chunks(both)
    assert chunks.count() == 21 and chunks.selectExpr("sum(size(latencies_ms)) n").first().n == 20_001


def test_a_bar_in_a_hop_name_is_part_of_the_name(spark):
    rows = [span(1, trace_id=f"{t:032x}", name="a|b", observed_ms=t, ingest_seq=t) for t in range(1, 7)]
    profile = traces.trace_profile(frame(spark, *rows))
    verdicts = baseline.baseline_verdict(profile, baseline.baselines(baseline.healthy_samples(profile))).collect()
    assert {r.verdict for r in verdicts} == {"HEALTHY"}, verdicts


def test_an_unknown_path_is_not_identical(spark):
    shape = "trace_id string, k string, path string, total_ms long, http_status int"
    golden = spark.createDataFrame([("g", "k", "a->b", 5, 200)], shape)
    live = spark.createDataFrame([("x", "k", None, 5, 200), ("y", "k", "a->b", 5, 200), ("z", "k", None, 9, 200)], shape)
    got = {r.trace_id: r.is_identical for r in traces.dna_diff(golden, live, "k").collect()}
    assert got == {"x": None, "y": True, "z": False}


def plain_windows(times, window):
    out, start = {}, None
    for t in sorted(times):
        if start is None or t > start + window:
            start = t
            out[start] = 0
        out[start] += 1
    return out


def test_rate_windows_open_with_a_request(spark):
    import random

    from spanwise.operators import audit

    rnd = random.Random(5)
    # A burst over a minute border, a request at the very end of a window, a busy client, ties and a lone request.
    clients = {
        "burst": [59_000 + 10 * i for i in range(400)], "edge": [0, 60_000, 60_001, 120_001, 120_002], "lone": [7],
        "busy": [rnd.randrange(0, 8_000_000) for _ in range(3000)] * 2, "late": [10**12 + rnd.randrange(0, 400_000) for _ in range(200)],
    }
    rows = [(c, t) for c, times in clients.items() for t in times] + [(None, 5), ("lone", None)]
    requests = spark.createDataFrame(rows, "client string, at_ms bigint").withColumn("n", F.lit("clash"))
    got = {}
    for r in audit.rate_windows(requests).collect():
        got.setdefault(r["client"], {})[r["window_start_ms"]] = r["requests"]
    assert got == {c: plain_windows(times, 60_000) for c, times in clients.items()}
    over = audit.rate_limit_audit(requests, limit=300).collect()
    assert [(r["client"], r["window_start_ms"], r["requests"], r["refused"]) for r in over] == [("burst", 59_000, 400, 100)]
    assert audit.rate_windows(requests.filter("false")).collect() == []


def test_incidents_are_found_once_for_their_clusters(spark):
    def row(trace, seq, service, status, ms):
        return (trace, service, status, ms, 1000 + seq, seq)

    rows = [row("t1", 1, "a", "OK", 1), row("t1", 2, "b", "ERROR", 5), row("t2", 1, "b", "DEGRADED", 9), row("t3", 1, "a", "OK", 2), row("t4", 1, None, "ERROR", 3)]
    frame = spark.createDataFrame(rows, "trace_id string, service string, status string, duration_ms long, observed_ms long, ingest_seq long")
    found = fleet.incident_clusters(frame)
    assert "trace_id" not in "".join(re.findall(r"Exchange hashpartitioning\(trace_id[^\n]*", found._jdf.queryExecution().executedPlan().toString()))
    assert [tuple(r) for r in found.collect()] == [("b", 2, ["t1", "t2"]), ("unattributed", 1, ["t4"])]


def test_profiles_are_the_same_gathered_and_joined(spark):
    rows = [
        ("t1", "1", None, "a", "x", 5, 1, "OK"), ("t1", "2", "1", "b", "y", 4, 2, "OK"), ("t1", "3", "1", "b", "y", 4, None, "ERROR"),
        ("t2", "1", "9", "a", "x", 5, 1, "OK"), ("t2", "2", "9", "b", None, 5, 1, "OK"), ("t2", "3", "8", "b", "", None, 1, "OK"),
        ("t3", "1", "2", "a", "x", 5, 1, "OK"), ("t3", "2", "1", "c", "x", 3, 1, "OK"),
        ("t4", "1", "", "a", "x", 5, 1, "OK"), ("t4", "1", "", "a", "x", 2, 1, "OK"), ("t4", "1", "1", "a", "x", 2, 1, "OK"), ("t4", None, "1", "a", "x", 2, 1, None),
        ("t4", None, "1", "z", "x", 2, 1, "DEGRADED"), ("t5", "1", "7", "", "x", None, None, "OK"), (None, "1", None, "a", "x", 5, 1, "OK"),
    ]
    frame = spark.createDataFrame(
        rows, "trace_id string, span_id string, parent_span_id string, service string, name string, observed_ms long, duration_ms long, status string"
    )
    gathered, joined = traces.trace_profile(frame), traces.trace_profile(frame, gather=0)
    assert gathered._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert gathered.dtypes == joined.dtypes
    assert sorted(gathered.collect(), key=str) == sorted(joined.collect(), key=str)
    mixed = traces.trace_profile(frame, gather=2)
    assert sorted(mixed.collect(), key=str) == sorted(gathered.collect(), key=str)
    assert {r.trace_id: (r.root_count, r.external_parents, r.duplicate_span_ids) for r in gathered.collect()} == {
        "t1": (1, 0, 0), "t2": (3, 2, 0), "t3": (0, 0, 0), "t4": (2, 0, 2), "t5": (1, 1, 0)
    }



def test_large_traces_are_numbered_in_blocks(spark):
    from spanwise.plans import catalog_requests, fixtures

    sf = "/root/testdata/sf0.001"
    frame, plain = catalog_requests.large_spans(spark, sf), fixtures.derive(spark, sf, catalog_requests.LARGE)
    assert "Window" not in frame._jdf.queryExecution().executedPlan().toString()
    assert frame.count() == plain.count() and frame.select(plain.columns).exceptAll(plain).isEmpty()
    rows = [("t", n, f"s{n}" if n != 4 else None, n) for n in range(1, 8)]
    nothing = {k: F.lit(None).cast("string") for k in ("status", "service_version", "deployment_environment")}
    hops = spark.createDataFrame(rows, "trace_id string, ingest_seq long, service string, duration_ms long").withColumns(
        nothing | {"attributes": F.lit(None).cast(SPANS["attributes"].dataType)}
    )
    dna = traces.request_dna(hops, chunk=3)
    assert dna.first().path == "s1->s2->s3->->s5->s6->s7"
    assert [h.ms for h in dna.first().hop_latencies] == [1, 2, 3, 4, 5, 6, 7]
    # Where only the path is asked for, no hop is gathered beyond its chunk.
    plan = dna.select("path")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 2 and "hop_latencies" not in plan
