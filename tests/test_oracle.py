"""Spark results against the checking SQL. SITELENS_ALL=1 runs every query."""

import decimal
import os

import duckdb
import pytest

from sitelens.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SOME = ("union_findings", "tech_evidence", "contact_dedupe", "opp_render_gate", "scores_all",
        "canonical_domain", "join_url", "version_compare", "days_between", "sink_flat_export",
        "scan_compare", "robots_allowed", "csv_dry_run", "stream_change", "rules_validate")
catalog.load()
KEYS = sorted(catalog.ORACLES) if os.environ.get("SITELENS_ALL") else SOME


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("key", KEYS)
def test_same_rows(spark, duck, key):
    df = catalog.QUERIES[key](spark, SMALL)
    names = sorted(df.columns)
    expected = duck.execute(catalog.ORACLES[key])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == names
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[columns.index(n)]) for n in names)
                     for r in expected.fetchall()), key=repr)
    assert ours == theirs
