"""Streams give what the batch operators give, and resends change nothing."""

import json
import os
import shutil

from pyspark.sql import functions as F
from test_requests import frame, history, span

from spanwise.operators import baseline, observations, traces
from spanwise.session import run_folder
from spanwise.sources import sinks
from spanwise.streaming import windows
from spanwise.streaming.evidence import EvidenceStream


class Waves:
    """Span files that arrive one after the other."""

    def __init__(self, spark, **options):
        folder = run_folder(spark, "waves")
        self.spark, self.folder = spark, folder
        self.store = EvidenceStream(spark, f"{folder}/store", **options)

    def arrive(self, rows):
        rows.write.mode("append").parquet(f"{self.folder}/in")
        self.store.run(self.spark.readStream.schema(rows.schema).parquet(f"{self.folder}/in"), f"{self.folder}/checkpoint")
        return self.store


def test_late_bad_evidence_removes_the_sample(spark):
    waves = Waves(spark)
    store = waves.arrive(frame(spark, *history(6)))
    assert store.baselines().first().observations == 6
    late = span(2, 1, trace=f"{3:032x}", status="ERROR", otel_status_code=2, ingest_seq=50)
    waves.arrive(frame(spark, late))
    assert store.baselines().first().observations == 5
    assert store.read("late").count() == 1
    verdict = store.verdicts().filter(F.col("trace_id") == f"{3:032x}").first()
    assert verdict.batch_id == 1 and verdict.verdict == "DEVIATION"


def test_resends_change_nothing_and_streams_equal_batches(spark):
    waves = Waves(spark)
    store = waves.arrive(frame(spark, *history(5)))
    waves.arrive(frame(spark, *history(5)).withColumn("received_ms", F.lit(9_999).cast("long")))
    assert store.read("spans").count() == 5 and store.read("notifications").filter("batch_id = 1").count() == 0
    waves.arrive(frame(spark, *history(7)))
    assert store.read("spans").count() == 7
    profile = traces.trace_profile(frame(spark, *history(7)))
    batch = baseline.baselines(baseline.healthy_samples(profile))
    assert store.baselines().collect() == batch.collect()


def test_a_key_that_loses_all_samples_and_a_reserve(spark):
    waves = Waves(spark, max_samples=2, reserve=4)
    store = waves.arrive(frame(spark, *history(6)))
    assert store.baselines().first().observations == 2
    bad = [span(2, 1, trace=f"{i:032x}", status="ERROR", otel_status_code=2, ingest_seq=50 + i) for i in range(8)]
    waves.arrive(frame(spark, *bad[4:6]))
    assert store.baselines().first().observations == 2
    waves.arrive(frame(spark, *bad[:4], bad[6]))
    assert store.baselines().count() == 0
    assert {r["verdict"] for r in store.verdicts().collect()} == {"UNKNOWN"}


def test_no_batch_reads_earlier_batches(spark):
    waves, sizes = Waves(spark), []
    for wave in range(10):
        rows = frame(spark, *[span(1, trace=f"{wave * 100 + i:032x}", ingest_seq=i) for i in range(6)])
        store = waves.arrive(rows)
        sizes.append(store.read("touched").filter(F.col("batch_id") == wave).count())
        # What earlier batches wrote may be gone: only the newest marker is looked at.
        for name in ("spans", "profiles", "verdicts", "samples", "touched", "learned"):
            shutil.rmtree(f"{store.root}/{name}/batch_id={wave - 1}", ignore_errors=True)
    assert sizes == [6] * 10
    assert store.baselines().first().observations == 60 and store.verdicts().count() == 6


def test_span_table_append_is_idempotent(spark):
    path = run_folder(spark, "spans")
    for _ in range(2):
        sinks.append_new_spans(spark, frame(spark, span(1), span(2, 1)), path)
    assert sinks.read_spans(spark, path).count() == 2


def test_payload_files_to_deduplicated_spans(spark, tmp_path):
    entry = {"traceId": "a" * 32, "spanId": "b" * 16, "name": "n", "startTimeUnixNano": "1700000000000000000", "endTimeUnixNano": "1700000000000400000"}
    payload = json.dumps({"resourceSpans": [{"resource": {"attributes": []}, "scopeSpans": [{"spans": [entry]}]}]})
    for i in range(3):
        line = {"payload_id": f"p{i}", "payload_seq": i, "received_ms": 1700000000000 + i, "payload": payload}
        (tmp_path / f"{i}.json").write_text(json.dumps(line) + "\n")
    good, _ = windows.stream_spans(windows.stream_payloads(spark, str(tmp_path), files_per_trigger=1))
    out = run_folder(spark, "stream")
    deduplicated = windows.stream_dedup(good)
    query = (
        deduplicated.writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/cp")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.schema(deduplicated.schema).parquet(f"{out}/out").collect()
    assert len(rows) == 1 and rows[0].service == "UnknownService" and rows[0].timing_ms == 0.4


def test_traces_keep_no_attributes(spark):
    waves = Waves(spark)
    store = waves.arrive(frame(spark, *history(3)))
    waves.arrive(frame(spark, *history(4)))
    # What is kept of a trace and handed on again holds its shape only; whole spans are written once.
    assert not {"attributes", "artifact_digest", "obs_key"} & set(store.read("touched").columns)
    spans = store.read("spans")
    assert "attributes" in spans.columns and spans.count() == 4
    assert spans.groupBy("batch_id").count().orderBy("batch_id").collect() == [(0, 3), (1, 1)]


def test_state_has_the_asked_partitions_and_a_touched_trace_is_one_row(spark):
    waves = Waves(spark, partitions=2)
    store = waves.arrive(frame(spark, *history(3), span(2, 1, trace=f"{1:032x}", ingest_seq=50)))
    for stream in ("spans", "traces", "baselines"):
        assert {p for p in os.listdir(f"{waves.folder}/checkpoint/{stream}/state/0") if p.isdigit()} == {"0", "1"}
    assert store.partitions == 2 and spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert store.read("touched").count() == store.read("profiles").count() == 3


def test_profile_of_observations_is_the_profile(spark):
    rows = [span(i, i // 2 or None, trace=f"{k:032x}", ingest_seq=i, duration_ms=None if i == 3 else i) for k in range(4) for i in range(1, 3 + 2 * k)]
    rows += [span(2, 9, trace="b" * 32, status=None, ingest_seq=1, observed_ms=None), span(2, 9, trace="b" * 32, status="ERROR", ingest_seq=2)]
    rows += [span(1, trace="c" * 32, status=None, ingest_seq=1), span(1, trace="d" * 32, name="", ingest_seq=1)]
    spans = frame(spark, *rows)
    gathered = spans.groupBy("trace_id").agg(F.collect_list(F.struct(*[c for c in spans.columns if c != "trace_id"])).alias("observations"))
    want = sorted(traces.trace_profile(spans).collect())
    assert len(want) == 7
    assert sorted(traces.profile_of_observations(gathered, 8).collect()) == want
    assert sorted(traces.profile_of_observations(gathered, 8, gather=3).collect()) == want


def test_span_table_shuffles_hashes_as_bytes(spark):
    rows = frame(spark, span(1), span(2, 1), span(2, 1, ingest_seq=9), span(2, 1, status="ERROR", ingest_seq=3))
    first = observations.new_observations(None, rows, F.col("ingest_seq"))
    assert dict(first.dtypes)["obs_key"] == "binary" and first.count() == 3
    merged = observations.merge_observations(None, rows, F.col("ingest_seq"))
    assert {r["obs_key"] for r in merged.collect()} == {r["obs_key"] for r in observations.with_obs_key(rows).collect()}
    assert observations.merge_observations(merged, rows, F.col("ingest_seq")).count() == 0
    path = run_folder(spark, "spans")
    sinks.append_new_spans(spark, rows, path)
    keyed = observations.with_obs_key(frame(spark, span(2, 1), span(5)))
    sinks.append_new_spans(spark, keyed, path)
    kept = sinks.read_spans(spark, path)
    assert kept.count() == 4 and {r["obs_key"] for r in kept.collect()} == {r["obs_key"] for r in merged.unionByName(keyed).collect()}
