"""Stored scans: a scan written again replaces itself, and a write that dies leaves the old one."""

import pytest

from sitelens.operators import scan_store as store


def rows(spark, path, table="t"):
    return sorted((r.scan_id, r.site, r.v) for r in store.read_scans(spark, path, table).collect())


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "site string, v int")


def test_scans_replace_themselves(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    store.store_scan({"t": table(spark, ("a", 1), ("b", 2)), "u": table(spark, ("a", 9))}, path, "007", "r1")
    store.store_scan({"t": table(spark, ("a", 5))}, path, "x/y=z %", "r1")
    store.store_scan({"t": table(spark, ("a", 3)), "u": table(spark)}, path, "007", "r2")
    assert rows(spark, path) == [("007", "a", 3), ("x/y=z %", "a", 5)] and rows(spark, path, "u") == []
    # a replay of an earlier run changes nothing
    store.store_scan({"t": table(spark, ("a", 1), ("b", 2))}, path, "007", "r1")
    assert rows(spark, path) == [("007", "a", 3), ("x/y=z %", "a", 5)]
    # a write that dies after its first table
    with monkeypatch.context() as m:
        m.setattr(store, "commit", lambda *a: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError, match="died"):
            store.store_scan({"t": table(spark, ("z", 0))}, path, "007", "r3")
    assert rows(spark, path) == [("007", "a", 3), ("x/y=z %", "a", 5)]
    store.store_scan({"t": table(spark, ("z", 0))}, path, "007", "r3")
    assert rows(spark, path) == [("007", "z", 0), ("x/y=z %", "a", 5)]
    store.delete_scan(spark, path, "007")
    assert rows(spark, path) == [("x/y=z %", "a", 5)]


def test_other_runs_are_not_read(spark, tmp_path):
    path = str(tmp_path)
    for run in range(4):
        store.store_scan({"t": table(spark, ("a", run))}, path, "s", str(run))
    frame = store.read_scans(spark, path, "t")
    assert [tuple(r) for r in frame.select("v").collect()] == [(3,)]
    scan = next(line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "tables/t" in line)
    # one folder of four is left before anything is read
    assert "PartitionFilters: [" in scan and "PartitionFilters: []" not in scan


def test_nothing_to_store(tmp_path):
    with pytest.raises(ValueError, match="no tables"):
        store.store_scan({}, str(tmp_path), "s", "r")
