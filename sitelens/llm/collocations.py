"""Frequent phrases whose words belong together, from FM-indexes of shards.

1. Shards. Tasks cut texts into pieces at punctuation and into words at blanks, and
   pack about SHARD_WORDS words of one language into a shard: numbers of its own
   vocabulary, 0 between pieces. Shards are written once and read from there on.
2. Words. The words of all shards are added up per language; those that occur LEAST
   times or more get a number of their own. Rarer ones cannot be in a phrase.
3. FM-index. Each shard meets the numbers of its frequent words, makes breaks of all
   others, and sorts its places by the next DEPTH words, and again by the last ones:
   two Burrows-Wheeler transforms. From the interval of every word, one step to the
   left gives the intervals of all two-word phrases in both transforms (the second
   narrows as the first is extended), and one step to the right those of three words.
   A step extends intervals by all words at once, some STEP_PLACES of their places after
   another; a count is a width.
4. Sums. Phrases with their counts go to buckets of about BUCKET_GRAMS of them, packed
   as arrays, and are added up there. A phrase comes once from each shard, so a
   frequent one weighs no more than others.
5. Scores. Joins bring the counts of the parts. With l and r occurrences of the two
   sides of a cut the score is floor(SCALE a a / (l r)); the lowest cut counts. A
   phrase inside a longer one that has at least half its occurrences is dropped: the
   longer ones are its extensions to the left and to the right.

Sums are 64 bits, products decimals of 38 digits.

Defined results: a null text is empty, a null language is ``und`` (and joins a language
of that name). Every row counts, also if ids or texts repeat. A text of any length is
used whole; a shard ends with the piece that fills it, never within one. Phrases that
tie in score and count are in the byte order of UTF-8. A language without a word has
no rows. Other columns are not read. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.session import written

LEAST, SCALE, FIRST, INSIDE_PERCENT = 10, 1_000_000, 2000, 50
SHARD_WORDS = 1 << 20
BUCKET_GRAMS = 1 << 20
BLOCK = 1 << 22  # bytes that are cut into words at once
STEP_PLACES = 1 << 17  # places that are extended at once
BREAK = b"."
#: A-Z in lower case; the signs that end a piece become one sign that no word holds
PIECES = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
SHARDS = "shard bigint, lang string, words bigint, ids binary, vocabulary array<binary>, counts array<bigint>"
GRAMS = "bucket bigint, n int, grams binary"


class Numbers(dict):
    """Numbers of words in the order of their first occurrence; 0 is the break."""

    def __init__(self) -> None:
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def blocks(text: bytes) -> Iterator[bytes]:
    """The text in parts that end with a piece."""
    start = 0
    while len(text) - start > BLOCK:
        end = text.find(BREAK, start + BLOCK)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


class Shard:
    def __init__(self) -> None:
        self.numbers, self.parts, self.size = Numbers(), [np.zeros(1, np.int32)], 0

    def add(self, text: bytes) -> None:
        words = text.replace(BREAK, b" . ").split()
        if words:
            self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
            self.parts.append(np.zeros(1, np.int32))
            self.size += len(words)

    def row(self, shard: int, lang: str) -> list:
        ids = np.concatenate(self.parts)
        counts = np.bincount(ids, minlength=len(self.numbers))[1:]
        return [shard, lang, int(counts.sum()), ids.tobytes(), list(self.numbers)[1:], counts.tolist()]


def shards(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row for each shard: its places as 32-bit numbers, its vocabulary and the counts of that."""
    schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("words", pa.int64()), ("ids", pa.binary()),
                        ("vocabulary", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, open_shards = TaskContext.get().partitionId() << 32, {}

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            row = open_shards.pop(lang).row(number, lang)
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                for part in blocks(text.as_buffer().to_pybytes().translate(PIECES)):
                    shard = open_shards.setdefault(lang, Shard())
                    shard.add(part)
                    if shard.size >= shard_words:
                        yield closed(lang)
                if sum(s.size for s in open_shards.values()) >= 2 * shard_words:  # many languages, none of them full
                    yield closed(max(open_shards, key=lambda x: open_shards[x].size))
        for lang in list(open_shards):
            if open_shards[lang].size:
                yield closed(lang)

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    return docs.select(lang, text).mapInArrow(run, SHARDS)


class Interval(NamedTuple):
    """Intervals of phrases: their words, and where each begins in one transform and in the other."""

    words: tuple[np.ndarray, ...]
    lo: np.ndarray
    count: np.ndarray
    other: np.ndarray


class FMIndex:
    """Both transforms of a text of numbers below ``top`` (0: break), sorted to a depth of three.

    Signs are kept in 32 bits, and what a step needs besides its result is bounded by
    STEP_PLACES and by the widest interval.
    """

    def __init__(self, text: np.ndarray, top: int) -> None:
        self.text, self.top, self.size = text, top, len(text)
        self.before = self._transform(text)
        self.after = self._transform(text[::-1])

    def _transform(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sign before each place in sorted order, and (sign, row) of all rows in the order of signs."""
        if self.top < 1 << 21:
            key = text.astype(np.int64)
            for ahead in (1, 2):
                key *= self.top
                key[:-ahead] += text[ahead:]
            order = np.argsort(key, kind="stable")
            del key
        else:
            order = np.lexsort((np.r_[text[2:], 0, 0][:len(text)], np.r_[text[1:], 0], text))
        order -= 1  # the first place has the last sign before it, which is a break
        sign = text[order].astype(np.int32)
        del order
        ranks = sign.astype(np.int64)
        ranks *= self.size
        ranks += np.arange(self.size, dtype=np.int32 if self.size < 1 << 31 else np.int64)
        ranks.sort()
        return sign, ranks

    def words(self) -> Interval:
        count = np.bincount(self.text, minlength=self.top)
        lo = np.cumsum(count) - count
        there = np.flatnonzero(count[1:]) + 1
        return Interval((there,), lo[there], count[there], lo[there])

    def _step(self, of: Interval, transform: tuple) -> tuple[np.ndarray, ...]:
        """Every extension of every interval: (its interval, the sign, count, where it begins here, and there)."""
        ends = np.cumsum(of.count)
        places = int(ends[-1]) if len(ends) else 0
        # intervals are extended each by itself, so any cut between them gives the same
        cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(STEP_PLACES, places, STEP_PLACES)), len(ends)])
        parts = [self._extended(of, lo, hi, transform) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        parts = parts or [self._extended(of, 0, 0, transform)]
        return tuple(np.concatenate(column) for column in zip(*parts, strict=True))

    def _extended(self, every: Interval, lo: int, hi: int, transform: tuple) -> tuple[np.ndarray, ...]:
        """The step for the intervals from ``lo`` to ``hi``."""
        sign, ranks = transform
        of = Interval((), every.lo[lo:hi], every.count[lo:hi], every.other[lo:hi])
        first = np.cumsum(of.count) - of.count
        rows = np.arange(int(of.count.sum())) + np.repeat(of.lo - first, of.count)
        key = np.sort(np.repeat(np.arange(len(of.lo)), of.count) * self.top + sign[rows])
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        count = np.diff(np.r_[start, len(key)])
        parent, extension = np.divmod(key[start], self.top)
        there = of.other[parent] + start - first[parent]  # smaller signs stand before it
        use = extension > 0
        parent, extension, count, there = (x[use] for x in (parent, extension, count, there))
        # the rows of one sign keep their order: the rank of the first row within it is where the interval begins
        here = np.searchsorted(ranks, extension * self.size + of.lo[parent])
        return parent + lo, extension.astype(np.int32), count, here, there

    def left(self, of: Interval) -> Interval:
        parent, sign, count, here, there = self._step(of, self.before)
        return Interval((sign, *(w[parent] for w in of.words)), here, count, there)

    def right(self, of: Interval) -> Interval:
        parent, sign, count, here, there = self._step(Interval(of.words, of.other, of.count, of.lo), self.after)
        return Interval((*(w[parent] for w in of.words), sign), there, count, here)


def packed(grams: np.ndarray) -> bytes:
    """Rows of 64-bit numbers column by column and byte by byte, which compresses well."""
    return np.ascontiguousarray(grams.T).view(np.uint8).reshape(grams.shape[1], grams.shape[0], 8).transpose(0, 2, 1).tobytes()


def unpacked(data: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(columns, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64).reshape(columns, -1).T


def bucket_of(words: tuple[np.ndarray, ...], buckets: int) -> np.ndarray:
    h = np.zeros(len(words[0]), np.uint64)
    with np.errstate(over="ignore"):
        for w in words:
            h = (h ^ w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return (h % np.uint64(buckets)).astype(np.int64)


def phrases_of(shards_: DataFrame, frequent: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n, grams): the phrases of two and three frequent words of each shard with their counts."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int32()), ("grams", pa.binary())])

    def run(shard: pa.Table, vocabulary: pa.Table) -> pa.Table:
        rows = ([], [], [])
        if shard.num_rows and vocabulary.num_rows:
            local, number = (vocabulary[c].to_numpy() for c in ("local", "number"))
            # numbers of frequent words within the shard, in the order of their global ones
            order = np.argsort(number)
            local, number = local[order], np.r_[-1, number[order]]
            for ids in shard["ids"]:
                ids = np.frombuffer(ids.as_buffer(), np.int32)
                to = np.zeros(max(int(ids.max(initial=0)), int(local.max())) + 1, np.int64)
                to[local] = np.arange(1, len(number))
                text = to[ids].astype(np.int32)
                # of breaks in a row one is enough
                text = text[np.r_[True, (text[1:] > 0) | (text[:-1] > 0)]]
                index = FMIndex(text, len(number))
                two = index.left(index.words())
                for step in (lambda: two, lambda: index.right(two)):  # three only when two is packed
                    found = step()
                    if not len(found.count):  # no two frequent words stand beside each other
                        continue
                    words = tuple(number[w] for w in found.words)
                    bucket = bucket_of(words, buckets)
                    by = np.argsort(bucket, kind="stable")
                    grams, bucket = np.stack([*words, found.count], axis=1)[by], bucket[by]
                    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
                    for lo, hi in zip(cut, [*cut[1:], len(bucket)], strict=True):
                        rows[0].append(bucket[lo])
                        rows[1].append(len(words))
                        rows[2].append(packed(grams[lo:hi]))
        return pa.Table.from_arrays([pa.array(r, f.type) for r, f in zip(rows, schema, strict=True)], schema=schema)

    return shards_.select("shard", "ids").groupBy("shard").cogroup(frequent.groupBy("in_shard")).applyInArrow(run, GRAMS)


def added(grams: np.ndarray, least: int) -> np.ndarray:
    """Distinct phrases with the sums of their counts, of ``least`` or more."""
    grams = grams[np.lexsort(grams.T[-2::-1])]
    new = np.flatnonzero(np.r_[True, (grams[1:, :-1] != grams[:-1, :-1]).any(axis=1)])
    sums = np.add.reduceat(grams[:, -1], new)
    return np.column_stack([grams[new, :-1], sums])[sums >= least]


def summed(found: DataFrame, least: int) -> DataFrame:
    """(u, v, w, a): phrases of two (w null) or three words over all shards."""
    def run(bucket: pa.Table) -> pa.Table:
        parts = []
        for n in (2, 3):
            own = [unpacked(g.as_buffer(), n + 1) for g, k in zip(bucket["grams"], bucket["n"].to_pylist(), strict=True) if k == n]
            if own:
                grams = added(np.concatenate(own), least)
                third = pa.array(grams[:, 2]) if n == 3 else pa.nulls(len(grams), pa.int64())
                parts.append(pa.table([pa.array(grams[:, 0]), pa.array(grams[:, 1]), third, pa.array(grams[:, -1])], names=["u", "v", "w", "a"]))
        return pa.concat_tables(parts)

    return found.groupBy("bucket").applyInArrow(run, "u bigint, v bigint, w bigint, a bigint")


def numbered(shards_: DataFrame, least: int) -> DataFrame:
    """(number, lang, word, f) of the frequent words; written once, since the numbers depend on the partition."""
    each = shards_.select("lang", F.explode(F.arrays_zip("vocabulary", "counts")).alias("v")).select(
        "lang", F.col("v.vocabulary").alias("word"), F.col("v.counts").alias("f"))
    return written(each.groupBy("lang", "word").agg(F.sum("f").alias("f")).filter(F.col("f") >= least).select(
        F.monotonically_increasing_id().alias("number"), "lang", "word", "f"), "words")


def candidates(docs: DataFrame, least: int = LEAST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, phrase, a, l, r, n, score, left_ext, right_ext, dropped) of every phrase of two or three words.

    ``left_ext`` and ``right_ext`` are the counts of the most frequent longer candidate
    that adds a word on that side (0 if none does).
    """
    made = written(shards(docs, shard_words), "shards")
    words = numbered(made, least)
    totals = made.groupBy("lang").agg(F.sum("words").alias("n"))
    local = made.select("shard", "lang", F.posexplode("vocabulary").alias("pos", "word")).join(
        words.select("lang", "word", "number"), ["lang", "word"]).select(
        F.col("shard").alias("in_shard"), (F.col("pos") + 1).cast("bigint").alias("local"), "number")
    size = made.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    phrases = written(summed(phrases_of(made, local, max(1, 2 * size // BUCKET_GRAMS)), least), "phrases")

    two = phrases.filter("w IS NULL").select("u", "v", "a")
    three = phrases.filter("w IS NOT NULL")
    longest = lambda x, y: three.groupBy(F.col(x).alias("u"), F.col(y).alias("v")).agg(F.max("a").alias("ext"))
    word = lambda c, *more: words.select(F.col("number").alias(c), F.col("word").alias(f"{c}_word"), F.col("f").alias(f"{c}_f"), *more)
    pair = lambda x, y, f: two.select(F.col("u").alias(x), F.col("v").alias(y), F.col("a").alias(f))
    spelt = lambda *c: F.array_join(F.array(*[F.col(f"{x}_word").cast("string") for x in c]), " ").alias("phrase")
    extended = two.join(longest("v", "w").withColumnRenamed("ext", "left_ext"), ["u", "v"], "left").join(
        longest("u", "v").withColumnRenamed("ext", "right_ext"), ["u", "v"], "left")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = lambda left, right: F.call_function(
        "div", wide("a") * wide("a") * F.lit(SCALE).cast("decimal(7,0)"), wide(left) * wide(right))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    of_two = extended.join(word("u", "lang"), "u").join(word("v"), "v").select(
        "lang", spelt("u", "v"), "a", F.col("u_f").alias("l"), F.col("v_f").alias("r"), score("u_f", "v_f").alias("score"),
        zero("left_ext"), zero("right_ext"))
    cuts = three.join(pair("v", "w", "vw"), ["v", "w"]).join(pair("u", "v", "uv"), ["u", "v"]).join(word("u", "lang"), "u").join(
        word("v"), "v").join(word("w"), "w").select(
        "*", score("u_f", "vw").alias("first_cut"), score("uv", "w_f").alias("second_cut"))
    early = F.col("first_cut") <= F.col("second_cut")
    of_three = cuts.select(
        "lang", spelt("u", "v", "w"), "a", F.when(early, F.col("u_f")).otherwise(F.col("uv")).alias("l"),
        F.when(early, F.col("vw")).otherwise(F.col("w_f")).alias("r"),
        F.least("first_cut", "second_cut").alias("score"), F.lit(0).cast("bigint").alias("left_ext"), F.lit(0).cast("bigint").alias("right_ext"))
    inside = 100 * F.greatest("left_ext", "right_ext") >= INSIDE_PERCENT * F.col("a")
    return of_two.unionByName(of_three).join(totals, "lang").withColumn("dropped", inside)


def collocations(docs: DataFrame, first: int = FIRST, least: int = LEAST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return candidates(docs, least, shard_words).filter(~F.col("dropped")).withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= first).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
