"""Ingest jobs and graph upserts as they arrive. The batch form of each is the same aggregation over a table."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgraph import schemas as S
from loomgraph.sources.loaders import upsert
from loomgraph.streaming.tables import BucketTable


def split_stages(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of known stages, and the rejects."""
    known = F.coalesce(F.col("stage").isin(*S.INGEST_STAGES), F.lit(False))
    return events.where(known), events.where(~known)


def latest_state(events: DataFrame) -> DataFrame:
    """job_id, stage, status, error, ts, n_events, details of events (job_id, ts, seq, stage, error, details): by the last event. Details
    are merged, the last value of each key standing, as JSON with sorted keys."""
    last = events.groupBy("job_id").agg(F.max_by(F.struct("stage", "error", "ts"), F.struct("ts", "seq")).alias("x"), F.count("*").alias("n_events"))
    status = F.when(F.col("x.stage") == "completed", "completed").when((F.col("x.stage") == "failed") | F.col("x.error").isNotNull(), "failed").otherwise("running")
    said = events.select("job_id", "ts", "seq", F.explode("details").alias("key", "value")).groupBy("job_id", "key").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))
    details = said.groupBy("job_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))).alias("details"))
    return last.join(details, "job_id", "left").select("job_id", "x.stage", status.alias("status"), "x.error", "x.ts", "n_events", F.coalesce("details", F.lit("{}")).alias("details"))


def stage_durations(events: DataFrame) -> DataFrame:
    """job_id, seq, stage, ms for each run of equal stages of a job but the last, from its first event to the next run's."""
    order = Window.partitionBy("job_id").orderBy("ts", "seq")
    starts = events.withColumn("before", F.lag("stage").over(order)).where("before is null or before <> stage")
    runs = starts.withColumn("until", F.lead("ts").over(order)).where("until is not null")
    return runs.select("job_id", "seq", "stage", (F.unix_millis("until") - F.unix_millis("ts")).alias("ms"))


# --- jobs as a stream

STATES = "job_id string, stage string, status string, error string, n_events long, details string"
DURATIONS = "job_id string, seq long, stage string, ms long"
#: Milliseconds that a job's state outlives its end, for events that come late, and any event, if its end never comes.
LINGER, ABANDONED = 3_600_000, 30 * 86_400_000


def _in_order(batches: Iterator[pd.DataFrame]) -> list[tuple]:
    """ts (microseconds), seq, stage, error, details of a job's rows in one batch, in the order of their events."""
    found = []
    for pdf in batches:
        ts = pdf["ts"].astype("int64").floordiv({"ns": 1000, "us": 1}[pdf["ts"].dt.unit])
        found += zip(ts.tolist(), pdf["seq"].astype("int64").tolist(), pdf["stage"], pdf["error"], pdf["details"], strict=True)
    return sorted(found, key=lambda r: r[:2])


def _settle(state: GroupState, ended: bool, linger: int, abandoned: int) -> None:
    """The state of an ended job goes soon, that of any other after a long time without an event."""
    state.setTimeoutDuration(max(1, linger if ended else abandoned))


def _states(linger: int, abandoned: int) -> Callable:
    def advance(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        found = _in_order(batches)
        stage, error, ts, seq, n, held = state.get if state.exists else (None, None, -(1 << 62), -1, 0, "{}")
        said = {k: tuple(v) for k, v in json.loads(held).items()}  # of each key the value, and when it was said
        at, order, new_stage, new_error, _ = found[-1]
        if (at, order) >= (ts, seq):
            stage, error, ts, seq = new_stage, new_error if isinstance(new_error, str) else None, at, order
        for at, order, _, _, details in found:
            for k, v in dict(details if details is not None else {}).items():
                if k not in said or (at, order) >= said[k][1:]:
                    said[k] = (v, at, order)
        state.update((stage, error, ts, seq, n + len(found), json.dumps(said)))
        status = "completed" if stage == "completed" else "failed" if stage == "failed" or error is not None else "running"
        _settle(state, status != "running", linger, abandoned)
        text = json.dumps({k: said[k][0] for k in sorted(said)}, separators=(",", ":"), ensure_ascii=False)
        yield pd.DataFrame({"job_id": [key[0]], "stage": [stage], "status": [status], "error": [error], "n_events": [n + len(found)], "details": [text]})

    return advance


def _durations(linger: int, abandoned: int) -> Callable:
    def advance(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # the run of equal stages that is open: its stage, and ts and seq of its first event
        stage, ts, seq = state.get if state.exists else (None, None, None)
        out = []
        for at, order, new, _, _ in _in_order(batches):
            if stage is not None and new != stage:
                out.append((key[0], seq, stage, at // 1000 - ts // 1000))
            if new != stage:
                stage, ts, seq = new, at, order
        state.update((stage, ts, seq))
        _settle(state, stage in ("completed", "failed"), linger, abandoned)
        yield pd.DataFrame(out, columns=["job_id", "seq", "stage", "ms"])

    return advance


def _stateful(events: DataFrame, advance: Callable, output: str, state: str, mode: str) -> DataFrame:
    return split_stages(events)[0].groupBy("job_id").applyInPandasWithState(advance, output, state, mode, GroupStateTimeout.ProcessingTimeTimeout)


def stream_states(events: DataFrame, linger: int = LINGER, abandoned: int = ABANDONED) -> DataFrame:
    """The state of each job after every batch that touches it, for a stream of events in any order. A job's state is let go ``linger``
    milliseconds after the batch that ended it, or after ``abandoned`` without an event; an event that comes still later starts anew."""
    return _stateful(events, _states(linger, abandoned), STATES, "stage string, error string, ts long, seq long, n long, details string", "update")


def stream_durations(events: DataFrame, linger: int = LINGER, abandoned: int = ABANDONED) -> DataFrame:
    """:func:`stage_durations` as a stream: a row when a job's stage changes. The events of a job come in the order of ts and seq from batch to
    batch, in any order within one."""
    return _stateful(events, _durations(linger, abandoned), DURATIONS, "stage string, ts long, seq long", "append")


# --- arrivals


def stream_arrivals(arrivals: DataFrame, watermark: str | None = "1 day") -> DataFrame:
    """A stream of documents (file_hash, arrived_at, ...) with near repeats of a hash dropped by the stream's own state, which forgets
    after the watermark; what comes later than the watermark allows is dropped too. :func:`arrivals_sink` knows the hashes of all time.
    Without a watermark the stream keeps no state and drops nothing: the sink alone decides."""
    return arrivals.withWatermark("arrived_at", watermark).dropDuplicatesWithinWatermark(["file_hash"]) if watermark else arrivals


def arrivals_sink(path: str, key: str = "file_hash", first: tuple[str, ...] = ("arrived_at",), buckets: int = 64, parts: int = 8, then: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that hands over from the stream to a registry of all hashes under ``path``: of a batch's rows, the first
    by ``first`` of each hash that no earlier batch brought is added, with the batch's number in ``batch_id``, and given to ``then``. Only the
    buckets that a batch touches are read, and there only hashes. A batch adds a part to a bucket; one that has ``parts`` of them is made one.
    A batch that comes again is compared with what stood before it, and adds the same."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = T.StructType([*batch.schema.fields, T.StructField("batch_id", T.LongType())])
        table = BucketTable(spark, path, schema, [key], buckets)
        others = [c for c in batch.columns if c != key]
        order = F.struct(*first, *[c for c in others if c not in first])  # of equals, the smaller by the other columns
        ours = batch.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in others]).select(*batch.columns).persist()
        try:
            before, touched = table.state_before(batch_id), table.touched(ours)
            known = table.rows({k: v for k, v in before.items() if k in touched}).select(key)
            fresh = ours.join(known, known[key].eqNullSafe(ours[key]), "left_anti").withColumn("batch_id", F.lit(batch_id).cast("long"))
            full = {k for k in touched if len(before.get(k, [])) >= parts}
            table.write(batch_id, fresh.unionByName(table.rows({k: before[k] for k in full})), before, full)
            if then:
                then(table.rows(table.state()).where(F.col("batch_id") == batch_id), batch_id)
        finally:
            ours.unpersist()

    return run


def registered(spark: SparkSession, path: str, schema: T.StructType, key: str = "file_hash") -> DataFrame:
    """The registry that an :func:`arrivals_sink` keeps for rows of ``schema``: each hash with its first row and its batch."""
    table = BucketTable(spark, path, T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())]), [key])
    return table.rows(table.state())


# --- upserts


def upsert_sink(path: str, keys: list[str], keep: tuple[str, ...] = (), buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that keeps a table under ``path``, cut into buckets by key. A batch rewrites only the buckets that it
    touches. All state is in the folder: a driver that comes back goes on from it, and a batch that comes again gives the same table.
    What fails in the store is tried again. The folder belongs to one stream's checkpoint."""

    def run(batch: DataFrame, batch_id: int) -> None:
        table = BucketTable(batch.sparkSession, path, batch.schema, keys, buckets)
        batch = batch.persist()
        try:
            before, touched = table.state_before(batch_id), table.touched(batch)
            old = {k: v for k, v in before.items() if k in touched}
            table.write(batch_id, upsert(table.rows(old), batch, keys, keep), before, set(touched))
        finally:
            batch.unpersist()

    return run


def upserted(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table that an :func:`upsert_sink` keeps, as of its last batch."""
    table = BucketTable(spark, path, schema, [])
    return table.rows(table.state())
