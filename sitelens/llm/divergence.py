"""How the vocabulary of a source differs from its language, and from each other source of it.

A language keeps the terms that stand in at least LEAST_DOCS of its rows. A term with
``count`` occurrences in a group has the share ``p = 1 + floor(SCALE * (count + 1) /
(N + V))`` there (N: occurrences of kept terms in the group, V: kept terms), and two
shares diverge by ``f = floor((p - q)^2 / q)``.

1. Counting. Tasks count terms per (language, source) in plain dictionaries, which
   they give away whenever they grow large; Spark adds the parts up.
2. Cells. Terms of a group with equal counts in the group and in the language have
   one f. It is evaluated once for each such cell, with the number of its terms.
3. Ranking. Cells of equal value are merged; values in descending order get the
   number of terms before them as cumulative multiplicity. Only values that begin
   within the limit are expanded into terms, in the byte order of UTF-8.
4. Pairs of sources. Terms in both sources fall into cells of (count, other count);
   those of one source alone come from its histogram of counts, because
   sum f(a, b) = sum over both of (f(a, b) - f(a, 0) - f(0, b) + f(0, 0))
   + sum over a of (f(a, 0) - f(0, 0)) + sum over b of (f(0, b) - f(0, 0)) + V f(0, 0).
   A term brings one row for two sources that both have it, and these are counted
   before they are shuffled; the result itself has a row for every two sources.

Nothing depends on the size of a group: a hot source is split by its terms while it
is counted, and only its best LIMIT values or terms of every task meet.

Defined results: null text, lang and source count as ''. Each row is a document, also
if ids repeat. A group without terms is listed among the pairs, with counts of zero; a
language without kept terms has pairs of value 0. Ties go to the smaller term in UTF-8.
Texts of any length are counted whole, in blocks. Other columns are not read. An empty
table gives none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.session import written

SCALE, LEAST_DOCS, LIMIT = 1_000_000_000, 3, 200
FITS = 2**63 // SCALE - 1
HELD = 400_000  # entries that a task holds before it gives its counts away
BLOCK = 1 << 22  # bytes that are cut into words at once
GROUP = ["lang", "source"]
PARTS = "lang string, source string, term binary, n bigint, docs bigint"
#: A-Z in lower case, a-z and everything beyond ASCII as they are, all else a blank
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def blocks(text: bytes) -> Iterator[bytes]:
    """The text in parts that end between words."""
    start = 0
    while len(text) - start > BLOCK:
        end = text.find(b" ", start + BLOCK)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


def as_batch(held: dict) -> pa.RecordBatch:
    columns = [[], [], [], [], []]
    for (lang, source), (counts, rows) in held.items():
        for column, values in zip(columns, ([lang] * len(counts), [source] * len(counts), counts.keys(), counts.values(),
                                            [rows[t] for t in counts]), strict=True):
            column.extend(values)
    kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                           names=["lang", "source", "term", "n", "docs"])


def counted(docs: DataFrame, most: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs), in parts that are still to be added up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                counts, rows = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                before, seen = len(counts), set()
                for part in blocks(text.as_buffer().to_pybytes().translate(LETTERS)):
                    words = part.split()
                    counts.update(words)
                    seen.update(words)
                rows.update(seen)
                size += len(counts) - before
                if size > most:
                    yield as_batch(held)
                    held, size = {}, 0
        yield as_batch(held)

    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    return docs.select(name("lang"), name("source"), text).mapInArrow(run, PARTS)


def kept_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, lang_n, lead) of kept terms; ``lead`` marks one row of each term of a language.

    Dealt out by language and term once: sums per source and per language need no
    other shuffle. A term has a row for each source at most.
    """
    sums = counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    return sums.select(*GROUP, "term", "n", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("d"),
                       (F.col("source") == F.min("source").over(term)).alias("lead")).filter(
        F.col("d") >= LEAST_DOCS).drop("d")


def share(count: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + vocabulary)), exactly; in decimals only where 64 bits would not do."""
    wide = lambda c: c.cast("decimal(19,0)")
    all_of = F.nullif(total + vocabulary, F.lit(0))
    by = lambda value, all_: F.call_function("div", value, all_)
    return F.when(count < FITS, by((count + 1) * SCALE, all_of)).otherwise(
        by(wide(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), wide(all_of))) + 1


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most SCALE + 1, so the square fits in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, vocabulary) of every group that occurs."""
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP]).distinct()
    by_source = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("lead").alias("vocabulary"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return every.join(by_source, GROUP, "left").join(by_lang, "lang", "left").select(
        *GROUP, zero("total"), zero("lang_total"), zero("vocabulary"))


def term_part(kept: DataFrame, groups: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(lang, source, item, value, rank): the terms whose share is above that of the language."""
    key = [*GROUP, "n", "lang_n"]
    cells = kept.groupBy(*key).agg(F.count(F.lit(1)).alias("terms")).join(groups, GROUP)
    p = share(F.col("n"), F.col("total"), F.col("vocabulary"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary"))
    cells = written(cells.select(*key, "terms", p.alias("p"), q.alias("q")).filter("p > q").select(
        *key, "terms", divergence(F.col("p"), F.col("q")).alias("value")), "cells")
    falling = Window.partitionBy(*GROUP).orderBy(F.desc("value"))
    best = cells.groupBy(*GROUP, "value").agg(F.sum("terms").alias("terms")).withColumn(
        "place", F.row_number().over(falling)).filter(F.col("place") <= limit)
    before = F.coalesce(F.sum("terms").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = best.withColumn("before", before).filter(F.col("before") < limit).select(*GROUP, "value", "before")
    chosen = cells.join(begun, [*GROUP, "value"]).select(*key, "value", "before")
    tied = Window.partitionBy(*GROUP, "value").orderBy("term")
    terms = kept.join(chosen, key).select(*GROUP, "term", "value", "before").withColumn(
        "place", F.row_number().over(tied)).filter(F.col("place") <= limit)
    return terms.withColumn("rank", F.col("before") + F.col("place")).filter(F.col("rank") <= limit).select(
        *GROUP, F.col("term").cast("string").alias("item"), "value", "rank")


def pair_part(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): every other source of the language."""
    side = lambda name: groups.select("lang", F.col("source").alias(name), F.col("total").alias(f"{name}_total"))
    pairs = written(side("source").join(side("item"), "lang").filter(F.col("source") != F.col("item")).join(
        groups.groupBy("lang").agg(F.max("vocabulary").alias("vocabulary")), "lang"), "pairs")
    here = lambda c: share(c, F.col("source_total"), F.col("vocabulary"))
    there = lambda c: share(c, F.col("item_total"), F.col("vocabulary"))
    p0, q0 = here(F.lit(0)), there(F.lit(0))
    none = divergence(p0, q0)
    times = lambda number, change: number.cast("decimal(18,0)") * change.cast("decimal(19,0)")
    key = ["lang", "source", "item"]

    mine = kept.select("lang", "term", F.col("source").alias("a"), F.col("n").alias("x"))
    other = kept.select("lang", "term", F.col("source").alias("b"), F.col("n").alias("y"))
    cells = mine.join(other, ["lang", "term"]).filter(F.col("a") < F.col("b")).groupBy("lang", "a", "b", "x", "y").agg(
        F.count(F.lit(1)).alias("terms"))
    both_ways = cells.select("lang", "terms", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("x"), F.col("y")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("y").alias("x"), F.col("x").alias("y")),
    )).alias("c")).select("lang", "terms", "c.*")
    p, q = here(F.col("x")), there(F.col("y"))
    in_both = both_ways.join(pairs, key).select(*key, times(
        F.col("terms"), divergence(p, q) - divergence(p, q0) - divergence(p0, q) + none).alias("part"))

    counts = kept.groupBy(*GROUP, "n").agg(F.count(F.lit(1)).alias("terms"))
    here_only = pairs.join(counts, GROUP).select(*key, times(
        F.col("terms"), divergence(here(F.col("n")), q0) - none).alias("part"))
    there_only = pairs.join(counts.withColumnRenamed("source", "item"), ["lang", "item"]).select(*key, times(
        F.col("terms"), divergence(p0, there(F.col("n"))) - none).alias("part"))
    all_terms = pairs.select(*key, F.coalesce(times(F.col("vocabulary"), none), F.lit(0).cast("decimal(38,0)")).alias("part"))
    sums = in_both.unionByName(here_only).unionByName(there_only).unionByName(all_terms).groupBy(*key).agg(
        F.sum("part").cast("bigint").alias("value"))
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    return sums.select(*key, "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of sources, and the first ``limit`` terms of every group."""
    kept = written(kept_terms(docs), "kept")
    groups = written(groups_of(docs, kept), "groups")
    columns = [*GROUP, "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    pair = pair_part(kept, groups).withColumn("part", F.lit("pair")).select(*columns)
    return pair.unionByName(term_part(kept, groups, limit).withColumn("part", F.lit("term")).select(*columns))
