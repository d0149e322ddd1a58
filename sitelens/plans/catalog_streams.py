"""Streaming queries, drained to the end, and the analyzer surface."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators import checks
from sitelens.operators.facts import spread
from sitelens.plans.analyze import ANALYZERS
from sitelens.plans.catalog import register
from sitelens.plans.catalog_analysis import frame, shown
from sitelens.plans.catalog_results import EVENT_STATUS
from sitelens.session import work_folder
from sitelens.sources.captures import SUFFIXES, captured_pages, captured_sites, spark_sql
from sitelens.streaming import jobs


BATCHES = 3


def landing(parts: Iterable[DataFrame], folder: str) -> Iterator[DataFrame]:
    """A stream over ``folder`` after each of the parts has landed there, in as many files as it has partitions.

    Whoever drains it each time with one checkpoint gets a part as one batch, whatever its number of files.
    """
    for part in parts:
        part.write.mode("append").parquet(folder)
        yield part.sparkSession.readStream.schema(part.schema).parquet(folder)


def arriving(spark: SparkSession, sf_dir: str, table: str) -> Iterator[DataFrame]:
    """A table that lands in parts, in the order of their times."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    ends = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    part = F.width_bucket(F.unix_micros(F.col("ts").cast("timestamp")).cast("double"), F.unix_micros(F.col("lo").cast("timestamp")).cast("double"),
                          F.unix_micros(F.col("hi").cast("timestamp")).cast("double"), F.lit(BATCHES))
    numbered = rows.crossJoin(ends).withColumn("part", F.least(part, F.lit(BATCHES))).drop("lo", "hi")
    parts = (numbered.where(F.col("part") == n).drop("part") for n in range(1, BATCHES + 1))
    return landing(parts, f"{work_folder(spark)}/landed")


def status_events(spark, sf_dir) -> Iterator[DataFrame]:
    for events in arriving(spark, sf_dir, "events"):
        yield events.select(F.col("ts").cast("timestamp").alias("event_time"), F.col("user_id").alias("scan_id"),
                            spark_sql(EVENT_STATUS).alias("status"), "event_id")


@register("stream_progress", f"""
SELECT user_id AS scan_id, count(*) AS total, count(*) FILTER (s = 'completed') AS completed,
  count(*) FILTER (s = 'failed') AS failed FROM (SELECT *, {EVENT_STATUS} AS s FROM events)
GROUP BY user_id""")
def stream_progress(spark, sf_dir):
    folder = work_folder(spark)
    for events in status_events(spark, sf_dir):
        jobs.stream_progress(events, f"{folder}/out", f"{folder}/check")
    return jobs.progress_so_far(spark, f"{folder}/out", "scan_id bigint")


@register("stream_progress_hourly", f"""
SELECT epoch_us(date_trunc('hour', ts)) // 1000000 AS hour, user_id AS scan_id, count(*) AS total,
  count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'failed') AS failed
FROM (SELECT *, {EVENT_STATUS} AS s FROM events) GROUP BY ALL""")
def stream_progress_hourly(spark, sf_dir):
    folder = work_folder(spark)
    for events in status_events(spark, sf_dir):
        jobs.stream_progress(events, f"{folder}/out", f"{folder}/check", window="1 hour")
    rows = jobs.progress_so_far(spark, f"{folder}/out", "slot struct<start:timestamp,end:timestamp>, scan_id bigint")
    return rows.select(F.unix_seconds("slot.start").alias("hour"), "scan_id", "total", "completed",
                       "failed")


@register("stream_dedupe", "SELECT DISTINCT user_id AS scan_id, event_type AS domain FROM events")
def stream_dedupe(spark, sf_dir):
    folder = work_folder(spark)
    for events in arriving(spark, sf_dir, "events"):
        named = events.select(F.col("ts").cast("timestamp").alias("event_time"), F.col("user_id").alias("scan_id"),
                              F.col("event_type").alias("domain"))
        jobs.stream_dedupe(named, ["scan_id", "domain"], f"{folder}/out", f"{folder}/check")
    return spark.read.parquet(f"{folder}/out/rows").select("scan_id", "domain")


@register("stream_change", """
SELECT 'd' || user_id AS domain, epoch_us(ts) AS captured_us, before, after FROM (
  SELECT user_id, ts, lag(CAST(floor(value) AS INT)) OVER w AS before, CAST(floor(value) AS INT)
    AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, CAST(floor(value) AS INT)))
WHERE before IS NOT NULL AND before <> after""")
def stream_change(spark, sf_dir):
    folder = work_folder(spark)
    for events in arriving(spark, sf_dir, "events"):
        captures = events.select(
            F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("domain"),
            F.col("ts").cast("timestamp").alias("captured_at"),
            F.floor("value").cast("int").alias("score"))
        jobs.stream_change(captures, f"{folder}/out", f"{folder}/check")
    return spark.read.parquet(f"{folder}/out/rows").select(
        "domain", F.unix_micros("captured_at").alias("captured_us"), "before", "after")


@register("stream_analyze", "SELECT site, lead, website, security, opportunity FROM scores_all "
                            "JOIN (SELECT DISTINCT site FROM pg_all) USING (site)")
def stream_analyze(spark, sf_dir):
    folder = work_folder(spark)
    # dealt by page, so that the pages of a site land in both parts, one batch each
    captured, sites = captured_pages(spark, sf_dir), captured_sites(spark, sf_dir)
    parts = [spread(captured.where(F.pmod(F.hash("page_no"), F.lit(2)) == n)) for n in range(2)]
    for pages in landing(parts, f"{folder}/landed"):
        jobs.stream_analyze(pages, sites, f"{folder}/out", f"{folder}/check", suffixes=SUFFIXES)
    return jobs.analyzed(spark, f"{folder}/out").select("site", "lead", "website", "security", "opportunity")


# --- the analyzer surface ------------------------------------------------------------------
@register("analyzer_disabled", "SELECT site, check_id, status FROM f_all WHERE analyzer NOT IN "
                               "('technologies', 'cms')")
def analyzer_disabled(spark, sf_dir):
    """Without technologies, what depends on them is left out as well."""
    table = checks.explode_findings(frame(spark, sf_dir, disabled=("technologies",)))
    return table.select("site", "check_id", "status")


@register("analyzer_single", "SELECT site, check_id, analyzer, category, status, severity, evidence "
                             "FROM f_all WHERE analyzer = 'dns'")
def analyzer_single(spark, sf_dir):
    return shown(checks.explode_findings(frame(spark, sf_dir, only="dns")))


def _described() -> list[tuple[str, ...]]:
    return [(n, a.name, a.kind, ",".join(a.depends_on), ",".join(a.provides)) for n, a in ANALYZERS.items()]


_LISTED = ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in _described())


@register("analyzer_listing", f"""
SELECT l.*, count(f.site) AS findings, count(DISTINCT f.site) AS sites
FROM (VALUES {_LISTED}) AS l(analyzer, name, kind, depends_on, provides)
LEFT JOIN (SELECT site, analyzer FROM f_all) AS f ON f.analyzer = l.analyzer GROUP BY ALL""")
def analyzer_listing(spark, sf_dir):
    """Every analyzer with what it needs, what it publishes and what it found, which may be nothing."""
    from sitelens.plans.catalog_analysis import stored_findings

    known = spark.createDataFrame(_described(), "analyzer string, name string, kind string, depends_on string, provides string")
    per_site = stored_findings(spark, sf_dir).groupBy("analyzer", "site").agg(
        F.count("*").alias("k"))
    found = per_site.groupBy("analyzer").agg(F.sum("k").alias("findings"),
                                             F.count("*").alias("sites"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return known.join(found, "analyzer", "left").select(*known.columns, zero("findings"), zero("sites"))
