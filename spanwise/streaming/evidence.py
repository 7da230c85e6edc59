"""Learning and judging as spans arrive, from keyed state: a batch reads what it brings and the state of its keys.

Three streams, each with state that Spark keeps per key (RocksDB), checkpoints and moves between executors:

1. *Spans* (key: one observation). Resends are dropped against the keys of the observations seen; the rest is written
   whole, once, and no state holds it.
2. *Traces* (key: trace_id). What a profile needs of each new observation (``_SHAPE``, no attributes) is added to its
   trace, and all of a trace that has new evidence is handed on, with the batch of spans each observation came with.
   Profiles without and with the newest ones tell which sample of which request key goes and which comes.
3. *Baselines* (key: request_key). The state of a key is an ordered map of its newest healthy samples by trace,
   replaced or taken out as traces grow. It hands on the newest ``max_samples``; from these the baseline is made and the
   batch's profiles are judged.

No batch reads spans, profiles, samples or verdicts of earlier batches; results are appended below the batch's own
id, so a batch that is run again replaces itself. A key keeps ``reserve`` samples, so that late bad evidence can be
made up for by older samples; only when more than ``reserve - max_samples`` of a key's newest samples
are taken out are those beyond it missing until newer ones arrive. Evidence of any age takes effect: state is kept as long
as the checkpoint, and a new period starts with a new one.

A trace's evidence is handed on by one task, as its profile needs all of it. A hot request key sends at most ``reserve``
samples and one removal per changed trace of a batch. Of exact resends within one batch any one stays.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from spanwise.operators import baseline, traces
from spanwise.operators.observations import KEYS, with_obs_key
from spanwise.operators.ordered import newest_per_key
from spanwise.session import path_exists

_SHUFFLE = "spark.sql.shuffle.partitions"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COMPRESSION = "spark.sql.streaming.stateStore.rocksdb.compression"
#: What is kept of an observation while its trace may grow.
_SHAPE = "span_id parent_span_id service name duration_ms observed_ms status ingest_seq arrived".split()
_UPDATES = "request_key string, trace_id string, action string, first_seen_ms long, total_ms long, structure string, trace_batch long"


@contextmanager
def _state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    wanted = {_PROVIDER: _ROCKSDB, _COMPRESSION: "zstd"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


#: A key without samples gives one row without a trace.
_SAMPLES = "request_key string, trace_id string, first_seen_ms long, total_ms long, structure string, trace_batch long"


def key_samples(max_samples: int, reserve: int):
    """Per request key: the newest samples of each key that changed. State: the ``reserve`` newest ones, as JSON."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        by_trace = {s[0]: s for s in json.loads(state.get[0])} if state.exists else {}
        arrived = pd.concat(list(parts), ignore_index=True).sort_values(["trace_batch", "action"], kind="stable")
        for row in arrived.itertuples(index=False):
            if row.action == "drop":
                by_trace.pop(row.trace_id, None)
            elif row.action == "put":
                by_trace[row.trace_id] = (row.trace_id, int(row.first_seen_ms), int(row.total_ms), row.structure)
        newest = sorted(by_trace.values(), key=lambda s: (s[1], s[0]), reverse=True)[:reserve]
        state.update((json.dumps(newest),))
        out = pd.DataFrame(newest[:max_samples] or [(None, 0, 0, None)], columns=["trace_id", "first_seen_ms", "total_ms", "structure"])
        out.insert(0, "request_key", key[0])
        out["trace_batch"] = int(arrived["trace_batch"].max())
        yield out

    return update


class EvidenceStream:
    """Tables ``spans``, ``touched``, ``profiles``, ``updates``, ``notifications``, ``late``, ``learned`` and ``verdicts`` below one folder."""

    def __init__(
        self, spark: SparkSession, root: str, max_samples: int = baseline.MAX_SAMPLES, reserve: int | None = None, partitions: int | None = None
    ):
        """``partitions`` of the state, by default two per core and never more than other shuffles have: each costs a store to open and commit."""
        self.spark, self.root, self.max_samples = spark, root.rstrip("/"), max_samples
        self.reserve = reserve or 8 * max_samples
        self.partitions = partitions or min(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get(_SHUFFLE)))

    def _write(self, rows: DataFrame, table: str, batch_id: int, even: bool = False) -> DataFrame:
        path = f"{self.root}/{table}/batch_id={batch_id}"
        # Rows dealt by key are even as they are; others are rebalanced: small partitions are merged and a hot one is split.
        rows = rows if even else rows.hint("rebalance")
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def read(self, table: str) -> DataFrame | None:
        """All batches of a table; None when there are none."""
        path = f"{self.root}/{table}"
        return self.spark.read.option("basePath", path).parquet(path) if path_exists(self.spark, path) else None

    def baselines(self) -> DataFrame:
        """The newest baseline of every key that has samples."""
        return newest_per_key(self.read("learned"), ["request_key"], [F.desc("batch_id")], 1).filter("observations is not null").drop("batch_id")

    def profiles(self) -> DataFrame:
        """The newest profile of every trace."""
        return newest_per_key(self.read("profiles"), ["trace_id"], [F.desc("batch_id")], 1).drop("batch_id")

    def verdicts(self) -> DataFrame:
        """The newest verdict of every trace, with the batch of spans that it judged as ``batch_id``."""
        rows = self.read("verdicts").withColumnRenamed("batch_id", "_judged")
        newest = newest_per_key(rows, ["trace_id"], [F.desc("trace_batch"), F.desc("_judged")], 1)
        return newest.withColumnRenamed("trace_batch", "batch_id").drop("_judged")

    def _arrive(self, new: DataFrame, batch_id: int) -> None:
        self._write(new.withColumn("arrived", F.lit(batch_id).cast("long")), "spans", batch_id, even=True)

    def _take(self, rows: DataFrame, batch_id: int) -> None:
        """``rows``: a trace with new evidence and all its observations, in one row, so what follows is read off row by row."""
        rows = self._write(rows, "touched", batch_id, even=True)
        # A batch takes more than one batch of spans after a failure between the two streams.
        upto = self._upto("taken", "arrived", batch_id)
        arrivals = F.transform("observations", lambda o: o["arrived"])
        most = rows.agg(F.max(F.array_max(arrivals)).alias("arrived"), F.max(F.size("observations")).alias("observations")).first()
        single = rows.select("trace_id", F.array_min(arrivals).alias("first"), F.explode("observations").alias("o")).select("trace_id", "first", "o.*")
        late = single.filter((F.col("arrived") > upto) & (F.col("arrived") > F.col("first")))
        self._write(late.select("trace_id", "span_id", "observed_ms", "ingest_seq"), "late", batch_id, even=True)
        ingested = F.size(F.filter("observations", lambda o: o["arrived"] > upto)).cast("long").alias("ingested")
        self._write(rows.select("trace_id", ingested).filter("ingested > 0"), "notifications", batch_id, even=True)
        largest = most["observations"] or 0
        after = self._write(traces.profile_of_observations(rows, largest), "profiles", batch_id, even=True)
        earlier = rows.withColumn("observations", F.filter("observations", lambda o: o["arrived"] <= upto)).filter(F.size("observations") > 0)
        self._write(self._changes(traces.profile_of_observations(earlier, largest), after, batch_id), "updates", batch_id)
        newest = upto if most["arrived"] is None else most["arrived"]
        self._write(self.spark.range(1).select(F.lit(newest).cast("long").alias("arrived")), "taken", batch_id, even=True)

    def _changes(self, before: DataFrame, after: DataFrame, batch_id: int) -> DataFrame:
        """What the samples of each key lose and gain; one row without a key says that there was a batch."""
        usable = F.col("request_key").isNotNull() & F.col("healthy")
        gone = before.filter(usable).select("request_key", "trace_id", F.lit("drop").alias("action"))
        newest = newest_per_key(after.filter(usable), ["request_key"], [F.desc("first_seen_ms"), F.desc("trace_id")], self.reserve)
        come = newest.select("request_key", "trace_id", F.lit("put").alias("action"), "first_seen_ms", "total_ms", F.to_json("structure").alias("structure"))
        mark = self.spark.range(1).select(F.lit("").alias("request_key"), F.lit("mark").alias("action"))
        rows = come.unionByName(gone, allowMissingColumns=True).unionByName(mark, allowMissingColumns=True)
        return rows.withColumn("trace_batch", F.lit(batch_id).cast("long")).select(*(c.split(" ")[0] for c in _UPDATES.split(", ")))

    def _judge(self, rows: DataFrame, batch_id: int) -> None:
        rows = self._write(rows, "samples", batch_id)
        structure = F.from_json("structure", "array<string>")
        samples = rows.filter("trace_id is not null").withColumn("structure", structure).withColumn("signature", F.to_json("structure"))
        learned = rows.select("request_key").distinct().join(baseline.baselines(samples), "request_key", "left")
        learned = self._write(learned, "learned", batch_id)
        batches = [r[0] for r in rows.filter("request_key = ''").select(F.explode(F.sequence(F.lit(self._upto("judged", "trace_batch", batch_id)) + 1, "trace_batch"))).collect()]
        read = self.spark.read.option("basePath", f"{self.root}/profiles").parquet(*(f"{self.root}/profiles/batch_id={b}" for b in batches))
        if len(batches) == 1:
            verdicts = baseline.baseline_verdict(read, learned).withColumn("trace_batch", F.lit(batches[0]).cast("long"))
        else:
            profiles = newest_per_key(read, ["trace_id"], [F.desc("batch_id")], 1).withColumnRenamed("batch_id", "trace_batch")
            verdicts = baseline.baseline_verdict(profiles, learned).join(profiles.select("trace_id", F.col("trace_batch").cast("long")), "trace_id")
        self._write(verdicts, "verdicts", batch_id, even=True)
        self._write(rows.filter("request_key = ''").select("trace_batch"), "judged", batch_id)

    def _upto(self, table: str, column: str, batch_id: int) -> int:
        """The last batch of the stream before that an earlier batch of this one has dealt with."""
        if batch_id == 0:
            return -1
        return self.spark.read.parquet(f"{self.root}/{table}/batch_id={batch_id - 1}").first()[column]

    def run(self, spans: DataFrame, checkpoint: str) -> None:
        """Take everything that has arrived through the streams; ``spans`` is a stream of SPANS rows."""
        # The hash of an observation covers its ids; a key that came with the spans may not.
        new = with_obs_key(spans)
        new = new.dropDuplicates(KEYS) if "obs_key" in spans.columns else new.withColumn("_seen", F.unhex("obs_key")).dropDuplicates(["_seen"]).drop("_seen")
        kinds = {f.name: f.dataType.simpleString() for f in spans.schema} | {"arrived": "bigint"}
        with _state_in_rocksdb(self.spark):
            self._finish(new, self._arrive, f"{checkpoint}/spans")
            if not path_exists(self.spark, f"{self.root}/spans"):
                return
            shape = ", ".join(f"{name} {kinds[name]}" for name in ("trace_id", *_SHAPE))
            arrived = self.spark.readStream.schema(shape).parquet(f"{self.root}/spans/*")
            touched = arrived.groupBy("trace_id").agg(F.collect_list(F.struct(*_SHAPE)).alias("observations"))
            self._finish(touched, self._take, f"{checkpoint}/traces")
            if not path_exists(self.spark, f"{self.root}/updates"):
                return
            updates = self.spark.readStream.schema(_UPDATES).parquet(f"{self.root}/updates/*")
            samples = updates.groupBy("request_key").applyInPandasWithState(
                key_samples(self.max_samples, self.reserve), _SAMPLES, "samples string", "Update", "NoTimeout"
            )
            self._finish(samples, self._judge, f"{checkpoint}/baselines")

    def _finish(self, rows: DataFrame, take, checkpoint: str) -> None:
        running = rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True)
        before = self.spark.conf.get(_SHUFFLE)
        # A stream keeps the setting that it starts with; what its batches do besides keeps the session's.
        self.spark.conf.set(_SHUFFLE, str(self.partitions))
        try:
            started = running.start()
        finally:
            self.spark.conf.set(_SHUFFLE, before)
        started.awaitTermination()
