"""A query beside its SQL on DuckDB, as sorted rows."""

from pathlib import Path

import duckdb

from sitelens.llm import queries


def agree(spark, name, sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    frame = queries.QUERIES[name](spark, sf)
    wanted = con.sql(queries.ORACLES[name])
    assert sorted(frame.columns) == sorted(wanted.columns)
    got = sorted(tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect())
    want = sorted(con.sql(f"SELECT {', '.join(sorted(frame.columns))} FROM wanted").fetchall())
    assert got == want
    return got
