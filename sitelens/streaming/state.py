"""Keyed state of a stream as a table in buckets, of which a batch touches only its own.

Keys are dealt to buckets by a hash. A batch reads the buckets its keys fall in, combines
them with what is new, and writes these buckets anew under its own number; a small table of
pointers says which batch wrote each bucket last. So the work of a batch follows its keys
and their buckets, not the number of batches before it. A batch that is replayed reads the
pointers of the batch before it and writes the same files again; until its pointers are
written, readers see the state before it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTERS = "bucket int, batch bigint"


class KeyedState(NamedTuple):
    """Where the state is, what its keys are, and into how many buckets they are dealt."""

    path: str
    keys: tuple[str, ...]
    buckets: int = 32

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def pointers(self, spark: SparkSession, batch_id: int) -> dict[int, int]:
        """bucket -> the batch that wrote it last, after ``batch_id``; empty before the first."""
        if batch_id < 0:
            return {}
        # a lost state is an error, not a new start
        return {r["bucket"]: r["batch"] for r in spark.read.schema(POINTERS).parquet(f"{self.path}/pointers/{batch_id}").collect()}

    def at(self, spark: SparkSession, batch_id: int, schema, only=None) -> DataFrame:
        """The state after a batch, or the buckets ``only`` of it."""
        known = self.pointers(spark, batch_id)
        paths = [f"{self.path}/data/{batch}/bucket={b}" for b, batch in sorted(known.items()) if only is None or b in only]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def merge(self, fresh: DataFrame, batch_id: int, combine: Callable[[DataFrame, DataFrame], DataFrame], schema=None) -> DataFrame:
        """State after ``combine(old, fresh)`` in the buckets that ``fresh`` touches.

        Returns the old rows of these buckets, as they were before. ``schema`` is that of the
        state, where it differs from that of ``fresh``.
        """
        spark, schema = fresh.sparkSession, schema or fresh.schema
        touched = {r[0] for r in fresh.select(self.bucket()).distinct().collect()}  # at most one row per bucket
        known = self.pointers(spark, batch_id - 1)
        old = self.at(spark, batch_id - 1, schema, touched)
        names = [f.name for f in old.schema]
        combine(old, fresh).select(*names, self.bucket().alias("bucket")).repartition("bucket").write.mode(
            "overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{batch_id}")
        rows = sorted({**known, **dict.fromkeys(touched, batch_id)}.items())
        spark.createDataFrame(rows, POINTERS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pointers/{batch_id}")
        return old

    def latest(self, spark: SparkSession, schema) -> DataFrame:
        """The state after the newest batch that is complete."""
        # pointers are one file, which stands in its place once it is whole
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(
            f"{self.path}/pointers").select(F.regexp_extract("path", r"/(\d+)/[^/]*$", 1).cast("bigint").alias("batch"))
        return self.at(spark, files.agg(F.max("batch")).first()[0], schema)
