"""Near duplicates: one-permutation MinHash, banded buckets, star-shaped candidates, full verification.

1. One pass over the texts: the set of word shingles, its fingerprint, and a
   one-permutation sketch (one hash of each shingle; the smallest per bin).
   Empty bins borrow by optimal densification: bin ``i`` probes pseudo-random
   bins of its own until one is occupied.
2. Equal sets collapse into one class before anything is compared (combined
   before the shuffle), so a group of copies costs one member.
3. Bands of the sketch are bucket keys. In a bucket every class is paired with
   the bucket's hub only: the pairs are fewer than the members. The hub is the
   class that meets the most others, so a group meets the same few everywhere.
4. Pairs are verified on the full sets, and linked classes form components.
5. What the stars may have missed are links between two classes of one bucket
   that are in different components. Such classes carry their differences from
   the bucket's hub, from which the join's condition computes the similarity of
   the full sets: only links come out. Then the components are drawn again.

A pair at the threshold shares no band with a probability of about 5e-8
(32 bands of 4 rows). Sets hold 64-bit hashes of shingles.

Defined results: a null text, or one without words, has an empty set, links with
nothing and is kept. A null ``doc_id`` gets a null component and is kept; it
does not name a component. Rows with one ``doc_id`` twice count as they are:
each belongs to its own text's class. A component is named by its smallest
``doc_id``. Other columns are not read; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.components import components
from sitelens.session import written

BINS, BANDS = 128, 32
SIMILARITY_PERCENT = 80
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))  # A-Z only
REMEMBERED_WORDS = 500_000
SKETCH = "doc_id bigint, text_hash bigint, n_shingles int, class binary, bands array<bigint>"
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def probes(columns: int) -> np.ndarray:
    """Which bins an empty bin tries, one row for each bin."""
    return (mix(np.arange(BINS * columns, dtype=np.uint64) * ODD + np.uint64(1)) % np.uint64(BINS)).reshape(
        BINS, columns).astype(np.int64)


FEW_PROBES, MANY_PROBES = probes(16), probes(4096)
BIN_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1))
BAND_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * ODD)


class Shingler:
    """Sorted distinct shingle hashes of texts; hashes of words met before are kept in bounded memory."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > REMEMBERED_WORDS:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        if not words:
            return np.empty(0, np.uint64)
        h, width = self.hashes(words), min(self.width, len(words))
        out = np.full(len(h) - width + 1, len(words) if len(words) < self.width else self.width, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                out = mix(out * ODD + h[k:len(h) - width + 1 + k])
        return np.unique(out)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin; the leading bits of a hash are its bin."""
    first = np.searchsorted(shingles, BIN_EDGES)
    full = first < np.append(first[1:], len(shingles))
    source = np.arange(BINS)
    empty = np.flatnonzero(~full)
    for table in (FEW_PROBES, MANY_PROBES):
        if not len(empty):
            break
        hit = full[table[empty]]
        at = hit.argmax(1)
        source[empty] = table[empty, at]
        empty = empty[~hit[np.arange(len(empty)), at]]
    source[empty] = np.flatnonzero(full)[0]  # all probes missed, which is possible for one in e**32 bins
    return shingles[first[source]]


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(BANDS, -1)
    key = BAND_SALT
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            key = mix(key * ODD + rows[:, k])
    return key.view(np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            sizes, names, keys = [], [], []
            for value in batch.column(2):
                shingles = shingler(value.as_py())
                sizes.append(len(shingles))
                names.append(name_of(shingles))
                keys.append(band_keys(sketch(shingles)) if len(shingles) else np.empty(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys) if keys else [], pa.int64()))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(names, pa.binary()), bands],
                                  names=["doc_id", "text_hash", "n_shingles", "class", "bands"])

    return docs.mapInArrow(run, SKETCH)


def name_of(shingles: np.ndarray) -> bytes | None:
    """The fingerprint of a set names its class; an empty set has none."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(class, shingles) of (class, text) rows whose text is of that class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            every = zip(batch.column(0).to_pylist(), (shingler(v.as_py()) for v in batch.column(1)), strict=True)
            sets = [(c, s.view(np.int64)) for c, s in every if name_of(s) == c]
            ends = np.cumsum([0, *[len(s) for _, s in sets]]).astype(np.int32)
            flat = np.concatenate([s for _, s in sets]) if sets else np.empty(0, np.int64)
            yield pa.record_batch([pa.array([c for c, _ in sets], pa.binary()),
                                   pa.ListArray.from_arrays(ends, pa.array(flat, pa.int64()))],
                                  names=["class", "shingles"])

    return texts.mapInArrow(run, "class binary, shingles array<bigint>")


def meetings(classes: DataFrame) -> DataFrame:
    """(bucket, class, n) for the classes that share a bucket with another."""
    rows = classes.select(F.explode("bands").alias("bucket"), "class", F.col("n_shingles").alias("n"))
    order = Window.partitionBy("bucket").orderBy("class")
    beside = F.lead("class").over(order).isNotNull() | F.lag("class").over(order).isNotNull()
    return rows.withColumn("beside", beside).filter("beside").drop("beside")


def star_members(met: DataFrame) -> DataFrame:
    """(bucket, class, n, hub, hub_n): the hub is the class that meets the most others over all its buckets.

    In a group of copies that is the text they were made from, or one close to it.
    """
    sizes = met.groupBy("bucket").agg(F.count("*").alias("size"))
    score = met.join(sizes, "bucket").groupBy("class").agg(F.sum("size").alias("score"))
    order = Window.partitionBy("bucket").orderBy(F.desc("score"), "class")
    return met.join(score, "class").select(
        "bucket", "class", "n", F.first("class").over(order).alias("hub"), F.first("n").over(order).alias("hub_n"))


def with_differences(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """``rest`` with the shingles of the hub that a class lacks, and those it has besides."""
    of = lambda c: sets.select(F.col("class").alias(c), F.col("shingles").alias(f"{c}_set"))
    each = rest.select("class", "hub").distinct().join(of("class"), "class").join(of("hub"), "hub").select(
        "class", "hub", F.array_except("hub_set", "class_set").alias("lacks"), F.array_except("class_set", "hub_set").alias("besides"))
    return rest.join(each, ["class", "hub"])


def linked_across(rest: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between classes of one bucket and different components.

    Both are known by their differences from the bucket's hub, so the join's own
    condition verifies the full sets, and pairs that are no links are never made.
    """
    other = rest.select("bucket", *[F.col(c).alias(f"o_{c}") for c in ("class", "n", "root", "lacks", "besides")])
    sizes = 100 * F.least("n", "o_n") >= percent * F.greatest("n", "o_n")
    both = (F.col("hub_n") - F.size("lacks") - F.size("o_lacks") + F.size(F.array_intersect("lacks", "o_lacks"))
            + F.size(F.array_intersect("besides", "o_besides")))
    # what they can share at most, from the sizes alone
    most = F.col("hub_n") - F.greatest(F.size("lacks"), F.size("o_lacks")) + F.least(F.size("besides"), F.size("o_besides"))
    enough = lambda x: 100 * x >= percent * (F.col("n") + F.col("o_n") - x)
    return rest.join(other, "bucket").filter(
        (F.col("root") != F.col("o_root")) & (F.col("class") < F.col("o_class")) & sizes & enough(most) & enough(both)
    ).select(F.col("class").alias("u"), F.col("o_class").alias("v")).distinct()


def candidate(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (u, v), u < v, whose sizes allow the similarity."""
    fit = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    return pairs.filter(fit & (F.col("class") != F.col("hub"))).select(
        F.least("class", "hub").alias("u"), F.greatest("class", "hub").alias("v")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    of = lambda c: sets.select(F.col("class").alias(c), F.col("shingles").alias(f"{c}_set"))
    both = F.size(F.array_intersect("u_set", "v_set"))
    return pairs.join(of("u"), "u").join(of("v"), "v").filter(
        100 * both >= percent * (F.size("u_set") + F.size("v_set") - both)).select("u", "v")


def cluster(docs: DataFrame, width: int, percent: int = SIMILARITY_PERCENT,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row, and the hash of its text, which tells rows of one id apart."""
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    drawn = written(sketches(rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), width), "sketches")
    named = drawn.filter(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    classes = named.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"),
                                         F.first("bands").alias("bands"))
    members = written(star_members(written(meetings(classes), "meetings")), "members")
    # the texts of the classes that met another one: their first rows
    met = members.select("class").distinct().join(named.groupBy("class").agg(F.min("doc_id").alias("doc_id")), "class")
    texts = rows.join(met, "doc_id").select("class", "text")
    sets = written(shingle_sets(texts, width), "sets")
    links = written(verified(candidate(members, percent), sets, percent), "links")
    first = components(links)
    placed = members.join(first.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "root", F.coalesce("root", "class"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b")
    apart = written(placed.join(mixed.select("bucket"), "bucket", "left_semi"), "apart")
    # of two classes of one bucket neither is the hub here: those pairs are verified already
    rest = with_differences(apart.filter("class <> hub").select("bucket", "class", "n", "root", "hub", "hub_n"), sets)
    more = written(linked_across(rest, percent), "more_links")
    joined = first
    if not more.isEmpty():
        # the stars found so far stand for the links they came from
        joined = components(first.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    roots = named.select("class", "doc_id").groupBy("class").agg(F.min("doc_id").alias("doc_id")).join(
        joined.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    names = roots.select("class", "root").join(
        roots.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("class", "component_id")
    out = drawn.select("doc_id", "text_hash", F.col("n_shingles").cast("bigint").alias("n_shingles"), "class").join(names, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")
