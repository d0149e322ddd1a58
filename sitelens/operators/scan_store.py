"""Results stored by scan: a scan written again replaces itself, in one step for readers.

Every write of a scan is a run with a folder of its own in each table. When all tables are
written, a commit (one row: scan, run, time) makes the run the current one. Readers take
the rows of current runs only, so they see the old results or the new ones and never a mix,
also if a write dies on the way. A run that is replayed writes its folders again and is not
committed a second time, so it cannot push aside a later run. A commit without a run
deletes the scan.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_LISTED = 5000
COMMIT = "scan_id string, run string, committed_at timestamp"


def folder_of(name: str) -> str:
    """A folder name for any text; the text itself stands in the rows."""
    return "x" + hashlib.sha256(name.encode()).hexdigest()[:32]


def commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMIT).option("recursiveFileLookup", "true").parquet(f"{path}/commits")


def committed(spark: SparkSession, path: str, scan_id: str, run: str | None) -> bool:
    try:
        known = commits(spark, path)
    except Exception as error:  # nothing was ever stored here
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return False
    return not known.where((F.col("scan_id") == scan_id) & F.col("run").eqNullSafe(F.lit(run))).isEmpty()


def commit(spark: SparkSession, path: str, scan_id: str, run: str | None) -> None:
    row = spark.range(1).select(F.lit(scan_id).alias("scan_id"), F.lit(run).cast("string").alias("run"),
                                F.current_timestamp().alias("committed_at"))
    name = folder_of(scan_id) + "-" + (folder_of(run) if run is not None else "deleted")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{name}")


def store_scan(tables: dict[str, DataFrame], path: str, scan_id: str, run: str) -> None:
    """Store the result tables of a scan; ``run`` names this write and is used again if it is replayed."""
    if not tables:
        raise ValueError("no tables to store")
    spark = next(iter(tables.values())).sparkSession
    if committed(spark, path, scan_id, run):
        return
    for name, table in tables.items():
        table.withColumns({"scan_id": F.lit(scan_id), "run": F.lit(run)}).write.mode("overwrite").parquet(
            f"{path}/tables/{name}/scan={folder_of(scan_id)}/write={folder_of(run)}")
    commit(spark, path, scan_id, run)


def delete_scan(spark: SparkSession, path: str, scan_id: str) -> None:
    commit(spark, path, scan_id, None)


def current_runs(spark: SparkSession, path: str) -> DataFrame:
    """(scan, write) folders of the run of each scan that was committed last."""
    last = commits(spark, path).groupBy("scan_id").agg(F.max_by("run", F.struct("committed_at", "run")).alias("run")).where("run IS NOT NULL")
    name = lambda c: F.concat(F.lit("x"), F.substring(F.sha2(c, 256), 1, 32))
    return last.select(name("scan_id").alias("scan"), name("run").alias("write"))


def read_scans(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The current rows of a table, with ``scan_id``. Folders of other runs are not read, as
    long as the list of current ones is short enough to prune by."""
    rows = spark.read.option("basePath", f"{path}/tables/{table}").parquet(f"{path}/tables/{table}")
    runs = current_runs(spark, path)
    listed = runs.limit(MOST_LISTED + 1).collect()
    if len(listed) <= MOST_LISTED:
        rows = rows.where(F.col("scan").isin([r["scan"] for r in listed]) & F.col("write").isin([r["write"] for r in listed]))
    return rows.join(runs, ["scan", "write"], "left_semi").drop("scan", "write", "run")
