"""Benchmark passages in documents: a prefix-filtered containment join over item-sized windows.

1. A window is ten consecutive words of an item (or all of a shorter one). Its
   tokens are its five-word shingles. Documents are read once; of their shingles
   only those that occur in some window are kept, with their places.
2. Shingles are ordered by how often all documents hold them. A window that lacks
   any of its shingles cannot occur; of the others the rarest shingle is the whole
   prefix, since containment must be complete.
3. Occurrences of prefix shingles propose a start (place minus offset), subject
   to the bounds that the window lies inside the document.
4. A proposal is verified by the exact words: the shingles at the window's two
   ends, which together cover it, must stand at their places.

The windows are broadcast only while they are few (``BROADCAST_WINDOWS``, about
300 bytes each); beyond it the same joins are shuffled, and Spark splits skewed
ones. Nothing is gathered per document but its places, and never per shingle.

Defined results: a null text or item has no words, and such an item has no
windows; items without ``item_id`` are left out; items of one id count once;
rows that agree in ``doc_id`` and text get the same answer, others are apart;
other columns are not read; without items nothing is hit.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.session import written

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # fixed value: what separates words once A-Z are lower case
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 5
BROADCAST_WINDOWS = 200_000
KEY = ["doc_id", "text_hash"]


def words(text: Column) -> Column:
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, BETWEEN), lambda w: w != "")


def runs(of: Column, width) -> Column:
    """All runs of ``width`` consecutive words, as text."""
    starts = F.when(F.size(of) >= width, F.sequence(F.lit(1), F.size(of) - width + 1)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", F.slice(of, i, width)))


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, window, n): the windows of each item, n words each."""
    split = items.select(F.col("item_id"), words(F.col("text").cast("string")).alias("words")).filter(
        F.col("item_id").isNotNull() & (F.size("words") > 0))
    n = F.least(F.size("words"), F.lit(WINDOW))
    return split.select("item_id", F.explode(runs(F.col("words"), n)).alias("window"), n.alias("n")).distinct()


def window_shingles(windows: DataFrame) -> DataFrame:
    """(window, n, k, offset, shingle) of distinct windows; k words to a shingle."""
    k = F.least(F.col("n"), F.lit(SHINGLE))
    split = windows.select("window", "n", F.split("window", " ").alias("words"), k.alias("k"))
    return split.select("window", "n", "k", F.posexplode(runs(F.col("words"), F.col("k"))).alias("offset", "shingle"))


def small(frame: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(frame) if few else frame


def rows_of(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"),
                       F.xxhash64(text).alias("text_hash"))


def occurrences(docs: DataFrame, shingles: DataFrame, few: bool) -> DataFrame:
    """(doc_id, text_hash, n_words, pos, shingle) where a document has a shingle of some window."""
    split = rows_of(docs).select(*KEY, words(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    known = small(shingles.select("shingle").distinct(), few)
    parts = []
    for (k,) in shingles.select("k").distinct().collect():  # at most SHINGLE different lengths
        placed = split.select(*KEY, "n_words",
                              F.posexplode(runs(F.col("words"), k)).alias("pos", "shingle"))
        parts.append(placed.join(known, "shingle", "left_semi"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def proposals(occ: DataFrame, shingles: DataFrame, few: bool) -> DataFrame:
    """(key, start, window, n) proposed by the rarest shingle of each possible window."""
    counts = occ.groupBy("shingle").agg(F.count("*").alias("times"))
    rated = shingles.join(counts, "shingle", "left")
    prefix = rated.groupBy("window", "n").agg(
        F.min(F.struct("times", "shingle", "offset")).alias("p"), F.count("times").alias("have"),
        F.count("*").alias("all")).filter("have = all").select("window", "n", "p.shingle", "p.offset")
    start = F.col("pos") - F.col("offset")
    return occ.join(small(prefix, few), "shingle").withColumn("start", start).filter(
        (F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words"))).select(*KEY, "start", "window", "n")


def verified(found: DataFrame, occ: DataFrame, shingles: DataFrame, few: bool) -> DataFrame:
    """Proposals whose first and last shingle stand where they should."""
    ends = shingles.groupBy("window").agg(
        F.min(F.struct("offset", "shingle")).alias("first"), F.max(F.struct("offset", "shingle")).alias("last"))
    found = found.join(small(ends, few), "window")
    for end in ("first", "last"):
        there = occ.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"),
                           F.col("pos").alias("p"), F.col("shingle").alias("s"))
        found = found.join(there, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_hash").eqNullSafe(F.col("t"))
                           & (F.col("start") + F.col(f"{end}.offset") == F.col("p"))
                           & (F.col(f"{end}.shingle") == F.col("s")), "left_semi")
    return found.select(*KEY, "start", "window", "n").distinct()


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, item_ids (sorted as text), contaminated of every row."""
    windows = written(item_windows(items), "windows")
    shingles = written(window_shingles(windows.select("window", "n").distinct()), "window_shingles")
    few = windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    n_words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_ANY_CASE)), F.lit(0)).cast("bigint")
    base = rows_of(docs).select(*KEY, n_words.alias("n_words"))
    none = base.select(*KEY, "n_words", F.lit(0).cast("bigint").alias("n_hit"), F.lit(0).cast("bigint").alias("n_items"),
                       F.array().cast("array<string>").alias("item_ids"), F.lit(False).alias("contaminated"))
    if shingles.isEmpty():
        return none
    occ = written(occurrences(docs, shingles, few), "occurrences")
    hits = written(verified(proposals(occ, shingles, few), occ, shingles, few), "hits")
    end = F.col("start") + F.col("n")
    before = F.max(end).over(Window.partitionBy(*KEY).orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1))
    covered = hits.select(*KEY, "start", "n").distinct().select(
        *KEY, (end - F.least(end, F.greatest("start", F.coalesce(before, F.lit(0))))).alias("new")).groupBy(*KEY).agg(
        F.sum("new").cast("bigint").alias("n_hit"))
    ids = hits.select(*KEY, "window").distinct().join(small(windows.select("window", "item_id"), few), "window").groupBy(
        *KEY).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    both = covered.join(ids, [covered[k].eqNullSafe(ids[k]) for k in KEY]).select(
        covered["doc_id"].alias("d"), covered["text_hash"].alias("t"), "n_hit", "item_ids")
    out = base.join(both, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_hash").eqNullSafe(F.col("t")), "left")
    return out.select(
        *KEY, "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
