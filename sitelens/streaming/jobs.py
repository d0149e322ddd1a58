"""Structured Streaming over the same operators as the batch plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens import fixed
from sitelens.operators import facts
from sitelens.operators.scores import score_table
from sitelens.plans.analyze import analyze
from sitelens.rules import FINGERPRINTS
from sitelens.session import written
from sitelens.streaming.state import KeyedState


def run_to_end(query_writer, checkpoint: str):
    """Drain what is there now and stop; a cluster job would keep running."""
    query = query_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def merged_facts(parts: DataFrame) -> DataFrame:
    """First facts of several batches as those of all their pages together."""
    return parts.groupBy("site", "fact", "key").agg(
        F.min_by("body", "ord").alias("body"), F.min("ord").alias("ord"), F.sum("n").alias("n"),
        F.sum("page_bytes").alias("page_bytes"))


def stream_analyze(pages: DataFrame, sites: DataFrame, out: str, checkpoint: str, *,
                   fingerprints=FINGERPRINTS, suffixes=None,
                   placeholders=fixed.PLACEHOLDER_DOMAINS, dial_plan=None, buckets: int = 32, **options):
    """Analyse the sites of each newly landed batch of pages.

    The pages of a site may come in any number of batches: the first facts of a site are
    kept as keyed state (no page source), and a touched site is analysed from those of all
    its pages so far. ``analyzed(spark, out)`` gives one row of scores per site. A replayed
    batch writes the same files again.
    """
    kept, scores = analysis_state(out, buckets)

    def analyse(batch: DataFrame, batch_id: int) -> None:
        found = written(facts.first_facts(facts.page_facts(
            facts.spread(batch), fingerprints, facts.PARTS, suffixes, placeholders, dial_plan)), "found")
        touched = found.select("site").distinct()
        kept.merge(found, batch_id, lambda old, new: merged_facts(old.unionByName(new)))
        firsts = kept.at(batch.sparkSession, batch_id, found.schema, {
            r[0] for r in touched.select(kept.bucket()).distinct().collect()}).join(touched, "site", "left_semi")
        scored = score_table(analyze(
            sites.join(touched, "site", "left_semi"), batch, fingerprints=fingerprints,
            suffixes=suffixes, placeholders=placeholders, dial_plan=dial_plan, firsts=firsts,
            **options))
        flat = scored.select("site", F.to_json(F.struct(*[c for c in scored.columns if c != "site"])).alias("scores"))
        scores.merge(flat, batch_id, newer)
        scored.limit(0).write.mode("overwrite").parquet(f"{out}/schema")

    return run_to_end(pages.writeStream.foreachBatch(analyse), checkpoint)


def analysis_state(out: str, buckets: int = 32) -> tuple[KeyedState, KeyedState]:
    return KeyedState(f"{out}/facts", ("site",), buckets), KeyedState(f"{out}/scores", ("site",), buckets)


def analyzed(spark: SparkSession, out: str) -> DataFrame:
    """The scores of every site that a stream has analysed so far."""
    shape = spark.read.parquet(f"{out}/schema").drop("site").schema
    rows = analysis_state(out)[1].latest(spark, "site string, scores string")
    return rows.select("site", F.from_json("scores", shape).alias("s")).select("site", "s.*")


def newer(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new``, and those of other sites as they were."""
    return old.join(new.select("site"), "site", "left_anti").unionByName(new)


def progress(events: DataFrame, *, window: str | None = None, watermark: str = "1 day") -> DataFrame:
    """Completed and failed counts per scan (and per hour, with a window)."""
    keys = [F.col("scan_id")]
    if window:
        events = events.withWatermark("event_time", watermark)
        keys = [F.window("event_time", window).alias("slot"), *keys]
    return events.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status").isin("failed", "no_website")).alias("failed"))


COUNTS = "total bigint, completed bigint, failed bigint"


def stream_progress(events: DataFrame, out: str, checkpoint: str, *, buckets: int = 32, **options):
    """Keep the latest counts per scan (and hour, with a window): keyed state that every
    batch updates. Without a window the counts of a batch are added to those so far; with
    one, Spark keeps the open hours and the closed ones leave its memory.
    """
    windowed = options.get("window") is not None
    keys = ("slot", "scan_id") if windowed else ("scan_id",)
    state = KeyedState(out, keys, buckets)

    def store(batch: DataFrame, batch_id: int) -> None:
        counts = [c.split()[0] for c in COUNTS.split(", ")]
        if windowed:  # the stream has aggregated: a key that changed comes with its whole count
            state.merge(batch.select(*keys, *counts), batch_id, lambda old, new: old.join(
                new, list(keys), "left_anti").unionByName(new))
        else:
            state.merge(written(progress(batch), "counts").select(*keys, *counts), batch_id, lambda old, new: old.unionByName(
                new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts]))

    if windowed:
        return run_to_end(progress(events, **options).writeStream.outputMode("update").foreachBatch(store), checkpoint)
    return run_to_end(events.writeStream.foreachBatch(store), checkpoint)


def progress_so_far(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """What ``stream_progress`` knows; ``schema`` is that of its keys."""
    return KeyedState(out, ()).latest(spark, f"{schema}, {COUNTS}")


def stream_dedupe(events: DataFrame, keys: list[str], out: str, checkpoint: str, *, buckets: int = 32):
    """The first row of each key, whenever it comes again: the keys seen so far are keyed
    state, met by an exact anti-join in the buckets that a batch touches.

    Of rows of one key in one batch the one of the least ``event_time`` counts, on ties the
    least of the other columns; a row that comes in a later batch is a repeat, even if its
    time is earlier. Null keys are keys like others.
    """
    state = KeyedState(f"{out}/seen", tuple(keys), buckets)

    def store(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in (*keys, "event_time")]
        body = F.struct("event_time", *rest)
        first = written(batch.groupBy(*keys).agg(F.min(body).alias("r")).select(*keys, "r.*").select(*batch.columns), "first")
        seen = state.merge(first.select(*keys), batch_id, lambda old, new: old.unionByName(new).distinct())
        same = [first[k].eqNullSafe(seen[k]) for k in keys]
        first.join(seen, same, "left_anti").write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    return run_to_end(events.writeStream.foreachBatch(store), checkpoint)


CAPTURE = "domain string, captured_at timestamp, score int"


def in_order() -> list[Column]:
    """Captures of one moment are in the order of their scores."""
    return [F.col("captured_at"), F.col("score")]


def changes(batch: DataFrame, before: DataFrame | None) -> DataFrame:
    """Score changes of each domain against its previous capture.

    ``before`` holds the last capture per domain from earlier batches. A domain's
    captures are cut into hours: inside an hour a window finds the previous
    capture, and the first of an hour takes the last score of the hour before.
    A domain with most of the rows is thereby spread over its hours.
    """
    rows = batch.withColumn("hour", F.date_trunc("hour", "captured_at"))
    inside = Window.partitionBy("domain", "hour").orderBy(*in_order())
    paired = rows.withColumn("near", F.lag("score").over(inside))
    hours = rows.groupBy("domain", "hour").agg(F.max_by("score", F.struct(*in_order())).alias("closing"))
    opening = hours.withColumn("earlier", F.lag("closing").over(
        Window.partitionBy("domain").orderBy("hour"))).drop("closing")
    joined = paired.join(opening, ["domain", "hour"])
    carried = F.lit(None).cast("int")
    if before is not None:
        joined = joined.join(before.select("domain", F.col("score").alias("carried")), "domain",
                             "left")
        carried = F.col("carried")
    known = joined.withColumn("before", F.coalesce("near", "earlier", carried))
    return known.where("before <> score").select(
        "domain", "captured_at", "before", F.col("score").alias("after"))


def last_captures(old: DataFrame, new: DataFrame) -> DataFrame:
    order = F.struct(*in_order())
    return old.unionByName(new).groupBy("domain").agg(F.max(order).alias("o")).select("domain", "o.*")


def stream_change(captures: DataFrame, out: str, checkpoint: str, *, buckets: int = 32):
    """Emit a row whenever a domain's score differs from its previous capture.

    The last capture per domain is keyed state: a batch rewrites the buckets of its domains
    only. A capture older than the last one known when its batch begins is late: it goes to
    ``out/late`` and changes nothing. Rows without a domain, time or score are left out.
    """
    state = KeyedState(f"{out}/state", ("domain",), buckets)

    def detect(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("domain", "captured_at", F.col("score").cast("int").alias("score")).dropna()
        touched = {r[0] for r in rows.select(state.bucket()).distinct().collect()}
        before = state.at(spark, batch_id - 1, CAPTURE, touched)
        known = before.select("domain", F.col("captured_at").alias("known_at"))
        timed = written(rows.join(known, "domain", "left").withColumn(
            "late", F.coalesce(F.col("captured_at") < F.col("known_at"), F.lit(False))), "timed")
        fresh = timed.where("NOT late").select("domain", "captured_at", "score")
        timed.where("late").select("domain", "captured_at", "score").write.mode("overwrite").parquet(f"{out}/late/batch={batch_id}")
        changes(fresh, before).write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
        state.merge(fresh, batch_id, last_captures, schema=CAPTURE)

    return run_to_end(captures.writeStream.foreachBatch(detect), checkpoint)
