"""Streams and the tables they keep: late repeats, restarts, crashes, state that ends, files that stay few."""

import time

import pytest

from loomgraph.plans import service_queries as V
from loomgraph.plans.graph_tables import GraphTables
from loomgraph.sources import files
from loomgraph.streaming import jobs as J
from loomgraph.streaming.tables import BucketTable

ARRIVAL = "doc_id long, file_hash string, arrived_at timestamp"
EVENT = "job_id string, ts timestamp, seq long, stage string, error string, details map<string,string>"


def rows_of(spark, *rows, schema=ARRIVAL):
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    return spark.createDataFrame([tuple(day(x) if isinstance(x, float) else x for x in r) for r in rows], schema)


def registry(spark, path):
    return sorted(((r.file_hash, r.doc_id, r.batch_id) for r in J.registered(spark, path, rows_of(spark).schema).collect()), key=str)


def run(stream, path, sink):
    stream.writeStream.option("checkpointLocation", f"{path}/log").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def test_repeats_after_the_watermark_and_a_stream_that_comes_back(spark, tmp_path):
    at, inbox = f"{tmp_path}/registry", f"{tmp_path}/in"
    batches = [[(1, "a", 0.0), (2, "b", 0.1), (3, "a", 0.2)], [(4, "c", 9.0), (5, "a", 9.1)], [(6, "b", 30.0), (7, "d", 30.0), (8, None, 30.0)]]
    for k, b in enumerate(batches):  # a stream that stops after each file, and comes back
        rows_of(spark, *b).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(ARRIVAL).parquet(inbox)
        run(J.stream_arrivals(stream), tmp_path, J.arrivals_sink(at))
        time.sleep(0.01)
        assert len(registry(spark, at)) == [2, 3, 5][k]
    assert sorted(h or "" for h, _, _ in registry(spark, at)) == ["", "a", "b", "c", "d"]


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    at = str(tmp_path)
    seen = []
    sink = lambda: J.arrivals_sink(at, first=("doc_id",), buckets=4, parts=2, then=lambda df, n: seen.append((n, sorted(r.file_hash for r in df.collect()))))
    batches = [[(1, "a", 0.0), (2, "b", 0.0), (0, "b", 1.0)], [(3, "b", 2.0), (4, "c", 2.0)], [(5, "a", 3.0)], [(6, "d", 4.0), (7, "c", 4.0)]]
    for n, b in enumerate(batches):
        sink()(rows_of(spark, *b), n)
    want = [("a", 1, 0), ("b", 0, 0), ("c", 4, 1), ("d", 6, 3)]
    assert registry(spark, at) == want
    sink()(rows_of(spark, *batches[3]), 3)
    assert registry(spark, at) == want
    assert seen == [(0, ["a", "b"]), (1, ["c"]), (2, []), (3, ["d"]), (3, ["d"])]


def test_a_crash_between_rows_and_manifest(spark, tmp_path, monkeypatch):
    at = str(tmp_path)
    first, second = rows_of(spark, (1, "a", 0.0), (2, "b", 0.0)), rows_of(spark, (3, "b", 1.0), (4, "c", 1.0))
    J.arrivals_sink(at, buckets=4)(first, 0)
    with monkeypatch.context() as m:
        m.setattr(files.Files, "write_text", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            J.arrivals_sink(at, buckets=4)(second, 1)
    assert [r[0] for r in registry(spark, at)] == ["a", "b"]  # what was written isn't seen
    J.arrivals_sink(at, buckets=4)(second, 1)
    assert registry(spark, at) == [("a", 1, 0), ("b", 2, 0), ("c", 4, 1)]

    table = f"{at}/table"
    up = J.upsert_sink(table, ["doc_id"], buckets=4)
    frames = [rows_of(spark, (1, "x", 0.0, 1), schema=ARRIVAL + ", seq long"), rows_of(spark, (1, "y", 0.0, 2), (2, "z", 0.0, 2), schema=ARRIVAL + ", seq long")]
    up(frames[0], 0)
    with monkeypatch.context() as m:
        m.setattr(files.Files, "write_text", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            up(frames[1], 1)
    hashes = lambda: sorted(r.file_hash for r in J.upserted(spark, table, frames[0].schema).collect())
    assert hashes() == ["x"]
    up(frames[1], 1)
    assert hashes() == ["y", "z"]


def test_what_fails_in_the_store_is_tried_again():
    tries = []

    def act():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("busy")
        return "done"

    assert files.retried(act, wait=0) == "done" and len(tries) == 3
    with pytest.raises(OSError):
        files.retried(lambda: (_ for _ in ()).throw(OSError("gone")), wait=0)


def test_files_stay_few_over_many_batches(spark, tmp_path):
    buckets, parts = 2, 3
    up, reg = J.upsert_sink(f"{tmp_path}/t", ["doc_id"], buckets=buckets), J.arrivals_sink(f"{tmp_path}/r", buckets=buckets, parts=parts)
    schema = ARRIVAL + ", seq long"
    for n in range(50):
        up(rows_of(spark, (n % 7, f"h{n}", 0.0, n), (n % 5, f"g{n}", 0.0, n), schema=schema).coalesce(1), n)
        if n < 20:
            reg(rows_of(spark, (n, f"h{n % 15}", float(n))).coalesce(1), n)
    assert len(registry(spark, f"{tmp_path}/r")) == 15
    assert J.upserted(spark, f"{tmp_path}/t", rows_of(spark, schema=schema).schema).count() == 7
    folders = lambda p: [x for x in (tmp_path / p / "rows").glob("batch=*/bucket=*")]
    assert len(folders("t")) <= 2 * buckets and len(folders("r")) <= 2 * (parts + 1) * buckets
    assert sum(1 for _ in (tmp_path / "t").glob("manifest*")) == 1


def job(name, *stages):
    return [(name, float(d), i, s, e, {s: str(i)}) for i, (d, s, e) in enumerate(stages)]


def test_streamed_durations_and_a_state_that_ends(spark, tmp_path):
    events = job("j", (0, "uploaded", None), (1, "parsing", None), (1.5, "parsing", None), (2, "unheard_of", None), (3, "completed", None)) + job("k", (0, "uploaded", None), (2, "failed", "broken"))
    days = [[e for e in events if lo <= e[1] < lo + 1] for lo in (0, 1, 2, 3)]
    want = sorted(map(tuple, J.stage_durations(J.split_stages(rows_of(spark, *events, schema=EVENT))[0]).collect()))
    assert want
    for name, build, mode in (("durations", J.stream_durations, "append"), ("states", J.stream_states, "update")):
        at, out = f"{tmp_path}/{name}", []
        rows_of(spark, *days[0], schema=EVENT).coalesce(1).write.parquet(f"{at}/in")
        stream = build(spark.readStream.schema(EVENT).parquet(f"{at}/in"), linger=1)
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/log").trigger(processingTime="0 seconds").foreachBatch(lambda df, n, out=out: out.extend(map(tuple, df.collect()))).start()
        held, until, k = [], time.time() + 180, 1
        try:
            while time.time() < until and not (k == len(days) and held and held[-1] == 0 and len(out) >= (len(want) if name == "durations" else 6)):
                if k < len(days) and len(held) > 3 * k:
                    rows_of(spark, *days[k], schema=EVENT).coalesce(1).write.mode("append").parquet(f"{at}/in")
                    k += 1
                time.sleep(0.3)
                progress = query.lastProgress
                held.append(progress["stateOperators"][0]["numRowsTotal"] if progress and progress["stateOperators"] else -1)
        finally:
            query.stop()
        assert max(held) > 0 and held[-1] == 0  # all jobs have ended, and nothing is held
        if name == "durations":
            assert sorted(out) == want
        else:
            last = {r[0]: r[1:] for r in out}
            assert last["j"] == ("completed", "completed", None, 4, '{"completed":"4","parsing":"2","uploaded":"0"}') and last["k"][:3] == ("failed", "failed", "broken")


def test_buckets_are_read_alone(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path), rows_of(spark).schema, ["file_hash"], 4)
    rows = rows_of(spark, *[(i, f"h{i}", 0.0) for i in range(40)])
    table.write(0, rows, {}, set())
    state = table.state()
    assert sorted(state) == [0, 1, 2, 3] and table.rows(state).count() == 40
    one = table.rows({2: state[2]})
    assert all("bucket=2" in f for f in one.inputFiles()) and one.count() == rows.where(table.bucket() == 2).count()
    assert table.rows({}).count() == 0 and BucketTable(spark, f"{tmp_path}/none", table.schema, []).state() == {}


def test_a_streams_batch_writes_a_file_a_bucket(spark, tmp_path):
    rows = rows_of(spark, *[(i, f"h{i}", 0.0) for i in range(400)]).repartition(16)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as within a stream
    try:
        BucketTable(spark, str(tmp_path), rows.schema, ["file_hash"], 4).write(0, rows, {}, set())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(list(tmp_path.glob("rows/batch=0/bucket=*/*.parquet"))) <= 8  # two for each of four buckets: a shuffle has eight tasks


def test_streams_are_fed_by_many_tasks_in_order(spark, monkeypatch):
    monkeypatch.setattr(V, "ROWS_A_FILE", 100)
    seen = []
    at = V._fed(GraphTables(spark, "/root/testdata/sf0.001"), spark.range(3000).withColumnRenamed("id", "k"), "k", lambda stream, at: seen.append({r.k for r in spark.read.parquet(f"{at}/in").collect()}))
    assert seen[-1] == set(range(3000)) and [max(s) + 1 for s in seen] == [len(s) for s in seen]
    assert len(spark.read.parquet(f"{at}/all").inputFiles()) == 30 and len(seen) == 3
