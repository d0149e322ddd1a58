"""Streams in several batches: exact state, defined ties and late rows, replays, work that does not pile up."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from sitelens.plans import catalog_streams
from sitelens.streaming import jobs
from sitelens.streaming.state import KeyedState

T0 = dt.datetime(2026, 1, 1)
at = lambda days=0, hours=0: T0 + dt.timedelta(days=days, hours=hours)


@pytest.fixture
def arriving(spark, tmp_path):
    """A stream of which each list of rows is a batch, taken in order; more can be landed later."""
    def land(batches, schema, folder="landed"):
        path = str(tmp_path / folder)
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
            time.sleep(0.02)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    return land


DEDUPE = "scan_id int, domain string, event_time timestamp, detail string"


def test_dedupe_remembers_keys_for_good(spark, tmp_path, arriving):
    batches = [
        [(1, "a", at(0), "x"), (1, "a", at(0), "w"), (1, "b", at(1), "x"), (None, None, at(0), "n")],
        [(1, "a", at(60), "again"), (2, "a", at(60), "new")],
        [(1, "b", at(400), "again"), (None, None, at(400), "again"), (2, "a", at(1), "earlier, but later")],
        [(3, "c", at(2), "new")],
    ]
    events = arriving(batches, DEDUPE)
    jobs.stream_dedupe(events, ["scan_id", "domain"], str(tmp_path / "out"), str(tmp_path / "check"), buckets=4)
    got = sorted(((r.scan_id, r.domain, r.detail) for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()), key=str)
    assert got == sorted([(1, "a", "w"), (1, "b", "x"), (None, None, "n"), (2, "a", "new"), (3, "c", "new")], key=str)


def test_progress_adds_up_over_batches_and_restarts(spark, tmp_path, arriving):
    schema = "scan_id bigint, status string, event_time timestamp"
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    first = arriving([[(1, "completed", at()), (1, "failed", at())], [(1, "queued", at(50)), (2, "no_website", at())]], schema)
    jobs.stream_progress(first, out, check)
    read = lambda: {r.scan_id: (r.total, r.completed, r.failed) for r in jobs.progress_so_far(spark, out, "scan_id bigint").collect()}
    assert read() == {1: (3, 1, 1), 2: (1, 0, 1)}
    jobs.stream_progress(arriving([[(2, "completed", at(90))]], schema), out, check)
    assert read() == {1: (3, 1, 1), 2: (2, 1, 1)}


def test_change_with_ties_and_late_rows(spark, tmp_path, arriving):
    schema = "domain string, captured_at timestamp, score int"
    batches = [
        [("a", at(0), 5), ("a", at(1), 7), ("a", at(1), 6), ("b", at(0), 1), ("c", None, 3)],
        [("a", at(1), 7), ("a", at(0, 5), 9), ("b", at(2), 1)],
        [("b", at(2, 1), 4), ("d", at(0), 2), (None, at(0), 2)],
    ]
    jobs.stream_change(arriving(batches, schema), str(tmp_path / "out"), str(tmp_path / "check"), buckets=3)
    rows = lambda name: sorted(tuple(r)[:-1] for r in spark.read.parquet(str(tmp_path / f"out/{name}")).collect())
    # of captures of one moment the lower score comes first
    assert rows("rows") == [("a", at(1), 5, 6), ("a", at(1), 6, 7), ("b", at(2, 1), 1, 4)]
    assert rows("late") == [("a", at(0, 5), 9)]


STATE = "k int, v int"


def added(old, new):
    return old.unionByName(new).groupBy("k").agg(F.sum("v").cast("int").alias("v"))


def merged(spark, state, batch_id, rows):
    state.merge(spark.createDataFrame(rows, STATE), batch_id, added)


def test_state_survives_replays(spark, tmp_path):
    state = KeyedState(str(tmp_path), ("k",), 4)
    merged(spark, state, 0, [(n, 1) for n in range(20)])
    for _ in range(3):  # a batch that is replayed gives the same state
        merged(spark, state, 1, [(3, 10), (100, 1)])
    want = {**dict.fromkeys(range(20), 1), 3: 11, 100: 1}
    assert {r.k: r.v for r in state.latest(spark, STATE).collect()} == want
    # data without pointers: a batch that died; readers see the state before it
    spark.createDataFrame([(3, 999, 0)], "k int, v int, bucket int").write.partitionBy("bucket").parquet(str(tmp_path / "data/2"))
    assert {r.k: r.v for r in state.latest(spark, STATE).collect()} == want
    merged(spark, state, 2, [(3, 1)])
    assert {r.k: r.v for r in state.latest(spark, STATE).collect()} == {**want, 3: 12}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        merged(spark, state, 9, [(1, 1)])  # the batch before it is not there


def test_a_batch_reads_only_its_own_buckets(spark, tmp_path):
    state = KeyedState(str(tmp_path), ("k",), 64)
    merged(spark, state, 0, [(n, 1) for n in range(500)])
    sizes = []
    for batch in range(1, 8):
        merged(spark, state, batch, [(7, 1)])
        bucket = spark.createDataFrame([(7, 0)], STATE).select(state.bucket()).first()[0]
        files = state.at(spark, batch, STATE, {bucket}).inputFiles()
        sizes.append(len(files))
        written = [p for p in (tmp_path / f"data/{batch}").iterdir() if p.name.startswith("bucket=")]
        assert len(written) == 1
    assert set(sizes) == {1}
    assert {r.k: r.v for r in state.latest(spark, STATE).collect()}[7] == 8


def test_parts_land_in_many_files_and_are_a_batch_each(spark, tmp_path):
    rows = [(n, at(n % 600), n % 7, "click", float(n % 5), "{}") for n in range(4000)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").repartition(
        6).write.parquet(str(tmp_path / "events.parquet"))
    for events in catalog_streams.arriving(spark, str(tmp_path), "events"):
        jobs.stream_dedupe(events.select(events.ts.alias("event_time"), "event_id"), ["event_id"], str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out/rows")).count() == 4000
    assert sorted(p.name for p in (tmp_path / "out/rows").iterdir() if p.is_dir()) == [f"batch={n}" for n in range(catalog_streams.BATCHES)]
    for n in range(catalog_streams.BATCHES):
        assert spark.read.text(str(tmp_path / f"check/sources/0/{n}")).where("value LIKE '%.parquet%'").count() > 1
