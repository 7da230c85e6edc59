"""Correlation, drift, audit and money on literal rows."""

import re

import pytest
from pyspark.sql import functions as F

from spanwise.functions import context, numbers, sql, text, versions
from spanwise.operators import audit, change, correlate, diagnose, drift, ledger
from spanwise.sources import inventory, rules

ENV = "trace_id string, evidence_id string, ingest_seq long, component_type string, component_name string, event_ms long, observed_ms long"


def test_out_of_order_evidence_is_put_in_causal_order(spark):
    df = spark.createDataFrame(
        [("t", "1", 1, "DB2", "db", 30, 1), ("t", "2", 2, "WEBSPHERE", "app", 20, 1), ("t", "3", 3, "LOAD_BALANCER", "lb", 10, 1)], ENV
    )
    assert [r.component_name for r in correlate.causal_order(df).orderBy("position").collect()] == ["lb", "app", "db"]
    assert correlate.topology_anomalies(df).count() == 2


def test_clock_skew(spark):
    df = spark.createDataFrame([("t", "1", 1, "DB2", "db", 10_000, 1)], ENV)
    offsets = spark.createDataFrame([("db", -2500)], "component_name string, offset_ms long")
    row = correlate.normalize_clock(df, offsets).first()
    assert (row.raw_event_ms, row.event_ms) == (10_000, 12_500)


def test_identity_levels(spark):
    rows = [
        ("t1", "a", 1, "n1", "fp", None, None, "9.9.9.9"), ("t1", "b", 2, "n2", "fp", None, None, "9.9.9.9"),
        ("t1", "c", 3, "n1", None, 7, None, "9.9.9.9"), ("t1", "d", 4, "n1", None, 7, None, "9.9.9.9"),
        ("t1", "e", 5, "n1", None, None, None, "9.9.9.9"),
    ]
    schema = "trace_id string, evidence_id string, ingest_seq long, component_name string, sql_fingerprint string, db_pid long, message_id string, client_ip string"
    got = correlate.consecutive_matches(spark.createDataFrame(rows, schema), ignore=["trace_id"])
    levels = [r.level for r in got.orderBy("evidence_b").collect()]
    # Sharing a client address or a component name is no identity.
    assert levels == ["LEVEL_2_PROTOCOL", "UNMATCHED", "LEVEL_3_TOPOLOGY", "UNMATCHED"]


def test_unmeasured_is_not_a_contradiction(spark):
    def score(pool):
        factors = diagnose.db_lock_factors(F.lit(20), F.lit(pool).cast("double"), F.lit("q"), F.lit(None).cast("double"))
        return spark.range(1).select(diagnose.hypothesis_score(factors).alias("s")).first().s

    assert score(None).support == 70 and score(10.0).support == 55 and score(95.0).support == 85
    assert score(None).unknown == ["connectionPool", "cpu"]


def test_failed_hop_at_normal_latency_is_found(spark):
    hops = spark.createDataFrame(
        [("t", 1, "api", 10, "OK"), ("t", 2, "db", 10, "ERROR")],
        "trace_id string, ingest_seq long, service string, duration_ms long, status string",
    )
    base = spark.createDataFrame([("api", 10), ("db", 10)], "service string, baseline_ms long")
    assert diagnose.rca_generic(hops, base).first().target == "db"
    assert diagnose.rca_generic(hops, base, legacy=True).first().status == "GOLDEN_PATH_MATCH"


def test_changes_before_only_and_inside_the_window(spark):
    requests = spark.createDataFrame([("t", 10_000_000, ["Pay-API"])], "trace_id string, observed_ms long, services array<string>")
    changes = spark.createDataFrame(
        [("after", 10_000_001, "pay"), ("edge", 10_000_000 - 7_200_000, "pay"), ("old", 10_000_000 - 7_200_001, "pay"), ("x", 9_999_000, "web")],
        "change_id string, change_ms long, service string",
    )
    got = {r.change_id: r.service_match for r in change.correlate_changes(requests, changes).collect()}
    assert got == {"edge": True, "x": False}
    none = change.change_reasons(requests, changes.filter("change_id = 'after'")).first()
    assert none.correlations == 0 and "no change landed" in none.reason


@pytest.mark.parametrize(
    "op, value, actual, result",
    [
        ("exact", "11.5.4", "11.5.4.0", "SATISFIED"), ("lt", "11.5.8.0", "11.5.4.0", "SATISFIED"), ("gte", "1.0.0", "1.0.0-rc.1", "VIOLATED"),
        ("minorMatch", "4.1", "4.1.9", "SATISFIED"), ("majorEquals", "4", "5.0", "VIOLATED"), ("gte", "1", "^1.0", "UNKNOWN"),
        ("approx", "1", "1.0", "UNKNOWN"), ("boolEquals", "true", "1.0", "UNKNOWN"), ("gte", "1", None, "UNKNOWN"),
    ],
)
def test_constraints(spark, op, value, actual, result):
    column = versions.eval_constraint(F.lit(op), F.lit(value), F.lit(actual).cast("string"))
    assert spark.range(1).select(column.alias("r")).first().r.result == result


def boundary(spark, server="3.6.23", digest="a", package="pip:pymongo", now=15):
    from test_requests import frame, span

    def attr(value):
        return {"key": "client.package", "value": {"stringValue": value}}

    ident = {"service_version": "1.0", "artifact_digest": "sha256:" + digest * 64}
    spans = frame(
        spark, span(1, kind=3, service="web", attributes=[attr(package)] if package else [], **ident), span(2, 1, kind=2, service="db", **ident)
    )
    packages = [("pip:pymongo", None, "4.11.0"), ("server:mongodb", None, server)]
    builds = spark.createDataFrame(
        [(s, "sha256:" + "a" * 64, "1.0", "team", "log", packages) for s in ("web", "db")],
        "service string, artifact_digest string, declared_version string, declared_by string, evidence string, "
        "packages array<struct<name:string,declared:string,resolved:string>>",
    )
    pack = spark.createDataFrame(
        [("m", "pip:pymongo", "minorMatch", "4.11", "server:mongodb", "gte", "4.0", None, None, 10, 20)],
        "rule_id string, from_package string, from_op string, from_value string, to_package string, op string, value string, "
        "when_key string, when_value string, recorded_ms long, review_by_ms long",
    )
    found = drift.boundary_findings(spans, builds, pack, now)
    edges = drift.boundary_compatibility(spans, found)
    return edges.first().status, drift.trace_compatibility(spans, edges).first().status


def test_boundary_violation_and_satisfaction(spark):
    assert boundary(spark) == ("VIOLATED", "VIOLATED")
    # A satisfied prerequisite never makes a request compatible.
    assert boundary(spark, server="4.0") == ("CHECKED_PREREQUISITES", "UNKNOWN")


@pytest.mark.parametrize("missing", [{"digest": "b"}, {"package": None}, {"server": "^4"}, {"now": 5}, {"now": 10**12}])
def test_each_missing_proof_is_unknown(spark, missing):
    assert boundary(spark, **missing) == ("UNKNOWN", "UNKNOWN")


def test_rules_meet_pairs_of_builds_instead_of_boundaries(spark):
    bound = spark.createDataFrame(
        [("web", "1.0", "a", "db", "1.0", "b", "CORRELATED", "CORRELATED", [("pip:pymongo", None, "4.11.0")], [("server:mongodb", None, "3.6.23")])],
        "from_service string, from_service_version string, from_artifact_digest string, to_service string, to_service_version string, "
        f"to_artifact_digest string, from_state string, to_state string, from_packages {drift.PACKAGES}, to_packages {drift.PACKAGES}",
    )
    pack = spark.createDataFrame(
        [("m", "pip:pymongo", "minorMatch", "4.11", "server:mongodb", "gte", "4.0", None, None, 10, 20)],
        "rule_id string, from_package string, from_op string, from_value string, to_package string, op string, value string, "
        "when_key string, when_value string, recorded_ms long, review_by_ms long",
    )
    row = drift._judged_pairs(bound, pack, 15).first()
    assert row.verdict.result == "VIOLATED" and not (row.uncorrelated or row.inexact or row.unscoped or row.stale)


def test_newest_observation_of_a_boundary_end_counts(spark):
    from test_requests import frame, span

    def attr(value):
        return [{"key": "client.package", "value": {"stringValue": value}}]

    ident = {"service_version": "1.0", "artifact_digest": "sha256:" + "a" * 64}
    spans = frame(
        spark, span(1, kind=3, service="web", attributes=attr("pip:pymongo"), **ident),
        span(1, kind=3, service="web", attributes=attr("other"), ingest_seq=9, **ident), span(2, 1, kind=2, service="db", **ident),
    )
    packages = [("pip:pymongo", None, "4.11.0"), ("server:mongodb", None, "4.0")]
    builds = spark.createDataFrame(
        [(s, "sha256:" + "a" * 64, "1.0", "team", "log", packages) for s in ("web", "db")],
        f"service string, artifact_digest string, declared_version string, declared_by string, evidence string, packages {drift.PACKAGES}",
    )
    pack = spark.createDataFrame(
        [("m", "pip:pymongo", "minorMatch", "4.11", "server:mongodb", "gte", "4.0", None, None, 10, 20)],
        "rule_id string, from_package string, from_op string, from_value string, to_package string, op string, value string, "
        "when_key string, when_value string, recorded_ms long, review_by_ms long",
    )
    found = drift.boundary_findings(spans, builds, pack, 15).collect()
    assert found and all("client package not observed" in r.missing for r in found)


def test_no_inventory_is_unknown_not_safe(spark):
    spans = spark.createDataFrame([("t", "a"), ("t", "b")], "trace_id string, service string")
    components = spark.createDataFrame([("a", "p")], "service string, package string")
    assert [r.service for r in change.unknown_coverage(components, spans).collect()] == ["b"]


def test_four_way_split(spark):
    paid = [("g", p, ["a", "b", "c", "d"], c) for p, c in (("a", 12000), ("b", 16000), ("c", 4000), ("d", 8000))]
    rows = spark.createDataFrame(paid, "group_id string, paid_by string, split_with array<string>, amount_cents long")
    balances = ledger.group_balances(rows)
    assert {r.member: r.balance_cents for r in balances.collect()} == {"a": 2000, "b": 6000, "c": -6000, "d": -2000}
    pays = {(r.from_member, r.to_member, r.amount_cents) for r in ledger.settlements(balances).collect()}
    assert pays == {("c", "b", 6000), ("d", "a", 2000)}


def test_remainder_cents(spark):
    rows = spark.createDataFrame([("g", "a", ["a", "b", "c"], 1000)], "group_id string, paid_by string, split_with array<string>, amount_cents long")
    got = {r.member: r.balance_cents for r in ledger.group_balances(rows).collect()}
    assert got == {"a": 666, "b": -333, "c": -333} and sum(got.values()) == 0


def test_settlements_equal_greedy_on_random_groups(spark):
    import random

    rng, rows, want = random.Random(7), [], set()
    for g in range(60):
        values = [rng.randint(-500, 500) for _ in range(rng.randint(2, 9))]
        values.append(-sum(values))
        members = {f"m{i:02d}": v for i, v in enumerate(values)}
        rows += [(g, m, v) for m, v in members.items()]
        owing = sorted(([-v, m] for m, v in members.items() if v < 0), key=lambda x: (-x[0], x[1]))
        due = sorted(([v, m] for m, v in members.items() if v > 0), key=lambda x: (-x[0], x[1]))
        while owing and due:
            amount = min(owing[0][0], due[0][0])
            want.add((g, owing[0][1], due[0][1], amount))
            owing[0][0] -= amount
            due[0][0] -= amount
            owing, due = [x for x in owing if x[0]], [x for x in due if x[0]]
    got = ledger.settlements(spark.createDataFrame(rows, "group_id long, member string, balance_cents long"))
    assert {tuple(r) for r in got.collect()} == want


def test_tampering_is_located(spark):
    rows = spark.range(10).selectExpr("1 as chain", "id as seq", "id * 2 as amount")
    chain = ledger.ledger_append(rows, "chain", ["seq"], ["amount"], segment=4)
    assert ledger.ledger_verify(chain, segment=4).first().intact
    bad = chain.withColumn("payload", F.when(F.col("block_index") == 6, "{}").otherwise(F.col("payload")))
    row = ledger.ledger_verify(bad, segment=4).first()
    assert (row.intact, row.first_bad_index, row.problem) == (False, 6, "CONTENT_CHANGED")


def test_illegal_and_missing_revisions(spark):
    rows = [(1, 1, "DETECTED"), (1, 2, "APPROVED"), (2, 1, "DETECTED"), (2, 3, "DIAGNOSED")]
    events = spark.createDataFrame(rows, "entity_id long, revision long, to_state string")
    got = {(r.entity_id, r.problem) for r in audit.illegal_transitions(events, audit.REMEDIATION_TRANSITIONS).collect()}
    assert got == {(1, "ILLEGAL_TRANSITION"), (2, "REVISION_GAP")}


def test_two_person_rule(spark):
    requests = spark.createDataFrame([(1, "I", "readreplica.scale-out", "db:x")], "request_id long, incident_id string, action_id string, target string")
    people = spark.createDataFrame([("p", ["dba"]), ("q", ["sre-lead"]), ("r", ["intern"])], "approver_id string, roles array<string>")

    def state(*signers):
        rows = [(i, 1, "I", "readreplica.scale-out", "db:x", "CHG-1", who, str(i), 99) for i, who in enumerate(signers)]
        schema = "approval_id long, request_id long, incident_id string, action_id string, target string, ticket_id string, approver_id string, nonce string, expires_ms long"
        return audit.approval_quorum(spark.createDataFrame(rows, schema), requests, people, 10).first().state

    assert state("p", "q") == "APPROVED" and state("p", "p") == "PENDING" and state("p", "r") == "PENDING"


def test_unsourced_rules_are_refused(spark):
    rows = spark.createDataFrame(
        [("r1", None, "2026", "package", "a", "absent", "b")],
        "rule_id string, source_url string, recorded_at string, when_kind string, when_name string, require_kind string, require_name string",
    )
    with pytest.raises(ValueError, match="source url"):
        rules.load_rules(rows)


def test_new_report_replaces_inventory(spark):
    rows = [("a", "x", "1", None, 1), ("a", "y", "2", None, 2), ("a", "z", "3", "pip", 2)]
    got = inventory.load_components(spark.createDataFrame(rows, "service string, name string, version string, ecosystem string, reported_ms long"))
    assert {(r.package, r.ecosystem) for r in got.collect()} == {("y", "npm"), ("z", "pip")}


def test_redaction_patterns(spark):
    cases = {
        "card 4111 1111 1111 1111.": "card [REDACTED_PAN].", "CVC: 123": "cvv=[REDACTED_CVV]", "api_key=abc&x": "password=[REDACTED_SECRET]&x",
        "Bearer aa.bb==": "Bearer [REDACTED_TOKEN]", "123-45-6789": "[REDACTED_SSN]", "é4111111111111111": "é[REDACTED_PAN]", "x4111111111111111": "x4111111111111111",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.redact_text(F.col("t")).alias("r"))
    assert {r.t: r.r for r in df.collect()} == cases


def test_codecs_fail_closed(spark):
    row = spark.range(1).select(
        context.decode_db_client_info(F.lit("psql vt=" + "0" * 32)).alias("zero"),
        context.decode_mq_correl_id(F.lit("41" * 24)).alias("foreign"),
        context.parse_traceparent(F.lit("ff-" + "a" * 32 + "-" + "b" * 16 + "-01")).alias("version"),
        numbers.assess_queue(F.lit(None).cast("bigint"), F.lit(10), F.lit(0)).alias("queue"),
    ).first()
    assert row.zero is None and row.foreign is None and row.version is None and row.queue.status == "UNKNOWN"


def test_sql_functions(spark):
    names = sql.register(spark)
    assert "redact_text" in names
    row = spark.sql(
        "select span_status('STATUS_CODE_ERROR', 1) a, sql_fingerprint(\"select  7 from t where x = 'y'\") b, "
        "redact_text('ssn 123-45-6789') c, saturation_pct(9, 0) d, redact_record('{\"token\":1}') e, severity_rank('high') f"
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == (
        "ERROR", "select N from t where x = '?'", "ssn [REDACTED_SSN]", None, '{"token":"[REDACTED_FIELD]"}', 3,
    )


def test_the_first_listed_component_counts(spark):
    inventory = spark.createDataFrame([("s", "p", "npm", "9.0.0", 1), ("s", "p", "npm", "10.0.0", 2)], "service string, package string, ecosystem string, version string, position int")
    advisory = spark.createDataFrame([("A", "p", "npm")], "advisory_id string, package string, ecosystem string")
    assert change.affected_services(advisory, inventory).first().component_version == "9.0.0"


def test_a_ledger_goes_on_from_its_head(spark):
    rows = spark.range(11).selectExpr("1 as chain", "id as seq", "id * 2 as amount")
    whole = ledger.ledger_append(rows, "chain", ["seq"], ["amount"], segment=4)
    for cut in (4, 6, 8):
        first = ledger.ledger_append(rows.filter(f"seq < {cut}"), "chain", ["seq"], ["amount"], segment=4)
        rest = ledger.ledger_append(rows.filter(f"seq >= {cut}"), "chain", ["seq"], ["amount"], existing=first, segment=4)
        assert sorted(map(tuple, first.unionByName(rest).collect())) == sorted(map(tuple, whole.collect()))


def test_fan_out_loses_no_consumer_and_no_matched_producer(spark):
    shape = "evidence_id string, event_ms long, message_id string, correlation_id string, trace string"
    producers = spark.createDataFrame([("e1", 0, "m1", "x1", "t"), ("e2", 5, None, None, "u"), ("e3", 6, "m9", None, "u")], shape)
    consumers = spark.createDataFrame([("f1", 10, "m1", None, "t"), ("f2", 20, "m1", "zz", "t"), ("f3", 30, None, None, "u"), ("f4", 40, None, None, "w")], shape)
    got = {(r.producer, r.consumer, r.correlation_level) for r in correlate.stitch_async(producers, consumers, scope="trace").collect()}
    exact, timed = "EXACT_MESSAGE_CORRELATION", "PROBABILISTIC_TIMING_ALIGNMENT"
    assert got == {("e1", "f1", exact), ("e1", "f2", exact), ("e2", "f3", timed), (None, "f4", "UNMATCHED"), ("e3", None, "UNMATCHED")}


def test_a_tie_of_the_pool_rounds_up(spark):
    # 23 / 40 * 100 is 57.49999999999999 in binary.
    got = spark.range(1, 1001).select("id", numbers.saturation_pct(F.col("id"), F.lit(40)).alias("pct")).collect()
    assert [r.pct for r in got] == [(r.id * 100 * 2 + 40) // 80 for r in got]


def test_changes_are_counted_without_pairing(spark):
    width = change.WINDOW_MINUTES * 60_000
    times = [0, 1, 60_000, width - 1, width, width + 1, 2 * width, 5 * width]
    names = ["svc-1", "SVC-1", "svc", "", None, "*", "**", "=svc-1", "db"]
    changes = spark.createDataFrame(
        [(f"c{i}-{j}", t, n) for i, t in enumerate(times) for j, n in enumerate(names)] + [("no time", None, "svc-1")],
        "change_id string, change_ms long, service string",
    )
    served = [["svc-1", "web"], ["db", "*"], [], None]
    requests = spark.createDataFrame(
        [(f"r{i}-{j}", t, s) for i, t in enumerate([*times, -1, None]) for j, s in enumerate(served)], "trace_id string, observed_ms long, services array<string>"
    )
    pairs = change.correlate_changes(requests, changes).groupBy("trace_id").agg(F.count("*").alias("n"), F.sum(F.col("service_match").cast("long")).alias("m"))
    want = {r.trace_id: (r.n, r.m) for r in pairs.collect()}
    counted = change.change_reasons(requests, changes)
    got = counted.collect()
    assert len(got) == requests.count() and {r.trace_id: (r.correlations, r.matching) for r in got if r.correlations} == want
    assert all((r.reason is None) == (r.correlations > 0) for r in got)
    # The join of requests and changes on a slot of time, whose work is that of the pairs, is gone from the plan.
    assert "bucket" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_services_are_matched_once_per_set(spark):
    changes = spark.createDataFrame([(f"c{i}", i * 60_000, "SVC" if i % 2 else None) for i in range(8)], "change_id string, change_ms long, service string")
    requests = spark.createDataFrame([(f"r{i}", 600_000, ["svc-1"]) for i in range(50)], "trace_id string, observed_ms long, services array<string>")
    assert [r.matching for r in change._matching(requests, changes).collect()] == [["SVC"]]
    got = change.correlate_changes(requests, changes)
    assert got.count() == 400 and got.filter("service_match").count() == 200


def test_advisories_meet_sets_of_services_and_not_every_request(spark):
    spans = spark.createDataFrame(
        [("t1", "a", 5), ("t1", "b", 6), ("t1", "a", 1), ("t2", "a", 2), ("t3", "c", 3), ("t4", None, 4), (None, "a", 9)],
        "trace_id string, service string, duration_ms long",
    )
    parts = spark.createDataFrame([("a", "x", "1", None), ("b", "x", "1", "npm"), ("b", "y", "2", "npm")], "service string, package string, version string, ecosystem string")
    advisories = spark.createDataFrame(
        [("A1", "x", "npm", "high"), ("A2", "y", None, "low"), ("A3", "z", "npm", "low")], "advisory_id string, package string, ecosystem string, severity string"
    )
    impact = change.advisory_impact(advisories, parts, spans)
    got = {(r.advisory_id, r.trace_id): (r.via_services, r.total_ms) for r in impact.collect()}
    assert got == {("A1", "t1"): (["a", "b"], 12), ("A1", "t2"): (["a"], 2), ("A2", "t1"): (["b"], 12)}
    ranking = change.advisory_ranking(advisories, parts, spans)
    assert [(r.advisory_id, r.impacted_requests) for r in ranking.collect()] == [("A1", 3), ("A2", 1), ("A3", 0)]
    # No exchange of one row per advisory and request.
    for frame in (impact, ranking):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\([^)]*advisory_id#\d+, trace_id#", plan)


def _messy_envelopes(spark):
    from spanwise.plans import catalog_correlation

    rows, seq = catalog_correlation.envelopes(spark, "/root/testdata/sf0.001"), F.col("ingest_seq")
    resent = rows.filter("trace_id % 3 = 1").withColumn("ingest_seq", seq + 50)
    copied = rows.filter("trace_id % 5 = 1").withColumns({"evidence_id": F.concat("evidence_id", F.lit("x")), "ingest_seq": seq + 20})
    gaps = rows.filter("trace_id % 7 = 1").withColumns({
        "event_ms": F.when(seq % 2 == 0, F.col("event_ms")), "component_type": F.when(seq % 3 == 0, F.col("component_type")),
        "observed_ms": F.col("observed_ms") + 7, "ingest_seq": seq + 200,
    })
    return rows.unionByName(resent).unionByName(copied).unionByName(gaps)


def test_journeys_shuffle_their_envelopes_once(spark):
    from spanwise.plans import journeys

    rows = _messy_envelopes(spark)
    facts = journeys.journey_facts(rows, ["trace_id"])
    assert facts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    # Resends, copies under other names and gaps; traces of more than eight envelopes take the split way.
    whole, mixed = (sorted(f.collect(), key=str) for f in (facts, journeys.journey_facts(rows, ["trace_id"], gather=8)))
    assert whole and whole == mixed


def test_hops_do_not_meet_their_baseline_by_service(spark):
    hops = spark.createDataFrame([("t1", 1, "a", 40), ("t1", 2, "b", 90), ("t2", 1, "a", 10), ("t3", 1, None, 50)], "trace_id string, ingest_seq long, service string, duration_ms long")
    base = hops.filter("service = 'a'").groupBy("service").agg(F.lit(10).cast("bigint").alias("baseline_ms"))
    found = diagnose.first_deviation(hops, base)
    assert "Exchange hashpartitioning(service" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["trace_id"]: (r["service"], r["expected_ms"], r["multiple"]) for r in found.collect()}
    assert got == {"t1": ("b", 20, 4.5), "t2": (None, None, None), "t3": (None, 20, 2.5)}
