"""Language identification by interpolated Kneser-Ney models over characters.

Learning: texts are folded to letters and single spaces, letters to symbols of 12
bits, and five neighbouring symbols to one integer. Each task counts these in
sorted arrays and emits what it has; Spark adds the counts up. Lower orders use
continuation counts (distinct left neighbours), derived from the next higher
order, so the texts are read once. Probabilities of all languages are computed by
joins of an order with its contexts and with the order below.

The model is a set of sorted arrays of grams, one per order, with one column per
language, and exact. What is sent to the workers is bounded: where an order has
more than MOST_GRAMS grams, they get one gram of the highest order per slot of
SLOT_BITS bits, the most frequent, and what they do not find there is counted by
row and met with the tables of all orders by joins. Languages beyond
LANGUAGES_AT_ONCE are scored in further blocks.

Scoring: cross-entropy per symbol in every language over the whole text; the
lowest wins. ``score`` is the posterior of the winner for at most EVIDENCE
symbols. A text is ``rejected`` when its cross-entropy lies above the
REJECT_QUANTILE of the learning texts of the language; the label is given anyway.

Defined results: ``und`` with score 0 for a null text, one without letters, or
when nothing was learned; rows with null ``lang`` or ``doc_id`` are not learned
from; ties go to the first language in alphabetical order; rows are answered one
by one, so repeated rows stay; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.session import written

ORDER, SYMBOL_BITS, SLOT_BITS = 5, 12, 22
SYMBOLS = 1 << SYMBOL_BITS
MOST_GRAMS = 1 << SLOT_BITS  # of an order in a task's memory
LANGUAGES_AT_ONCE = 8
BLOCK_CHARS = 500_000
HELD_GRAMS = 3_000_000  # distinct counts that a task keeps before it emits them
EVIDENCE = 40
REJECT_QUANTILE, REJECT_LEAST_SYMBOLS = 0.999, 20


@functools.lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter; later letters share the upper half."""
    codes = np.arange(0x110000)
    letters = np.array([chr(c).isalpha() for c in codes])
    folded = (codes * 0x9E3779B1 >> 7) % (SYMBOLS // 2) + SYMBOLS // 2
    return np.where(letters, np.where(codes < SYMBOLS // 2, codes, folded), 0).astype(np.int64)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The packed n-gram that ends at each symbol, its text's number, and whether a text has letters."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    symbols = symbol_table()[codes]
    begins = np.r_[True, owner[1:] != owner[:-1]]
    keep = (symbols > 0) | ~(begins | np.r_[True, symbols[:-1] == 0])
    symbols, owner = symbols[keep], owner[keep]
    out = symbols.copy()
    for k in range(1, ORDER):
        same = owner[k:] == owner[:-k]
        out[k:] |= np.where(same, symbols[:-k], 0) << (SYMBOL_BITS * k)
    return out, owner, np.bincount(owner[symbols > 0], minlength=len(texts)) > 0


def blocks(texts: list[str]) -> Iterator[slice]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BLOCK_CHARS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, c): counts of the highest order over (lang, text) rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, (keys, counts) in held.items():
                yield pa.record_batch([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)],
                                      names=["lang", "gram", "c"])
            held.clear()

        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for part in blocks(texts):
                found, owner, _ = grams(texts[part])
                for lang in sorted(set(langs[part])):
                    counted = np.unique(found[(langs[part] == lang)[owner]], return_counts=True)
                    held[lang] = add_up([held[lang], counted]) if lang in held else counted
                if sum(len(k) for k, _ in held.values()) > HELD_GRAMS:
                    yield from emit()
        yield from emit()

    return rows.mapInArrow(run, "lang string, gram bigint, c bigint").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def low(gram: Column, symbols: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (SYMBOL_BITS * symbols)) - 1))


def model_tables(counts: DataFrame, langs: list[str]) -> tuple[list[DataFrame], list[DataFrame]]:
    """For each order its grams with v_i = p, and its contexts with v_i = what they leave; i numbers languages."""
    span = range(len(langs))
    wide = counts.groupBy("gram").agg(*[F.sum(F.when(F.col("lang") == lang, F.col("c"))).alias(f"c_{i}")
                                       for i, lang in enumerate(langs)])
    orders = {ORDER: written(wide, "grams")}
    for k in range(ORDER - 1, 0, -1):
        above = orders[k + 1]
        orders[k] = written(above.groupBy(low(F.col("gram"), k).alias("gram")).agg(
            *[F.nullif(F.count(f"c_{i}"), F.lit(0)).alias(f"c_{i}") for i in span]), "grams")
    uniform = [F.lit(1.0 / SYMBOLS)] * len(langs)
    tables, contexts, below = [], [], None
    for k in range(1, ORDER + 1):
        seen = orders[k].agg(*[F.count(F.when(F.col(f"c_{i}") == n, 1)).alias(f"n{n}_{i}") for n in (1, 2) for i in span]).first()
        cut = [seen[f"n1_{i}"] / (seen[f"n1_{i}"] + 2 * seen[f"n2_{i}"]) if seen[f"n1_{i}"] else 0.5 for i in span]
        context = F.shiftright("gram", SYMBOL_BITS)
        left = orders[k].groupBy(context.alias("context")).agg(
            *[F.sum(f"c_{i}").alias(f"s_{i}") for i in span],
            *[(F.lit(cut[i]) * F.count(f"c_{i}") / F.sum(f"c_{i}")).alias(f"b_{i}") for i in span])
        contexts.append(left.select(F.col("context").alias("gram"), *[F.col(f"b_{i}").alias(f"v_{i}") for i in span]))
        frame = orders[k].withColumn("context", context).join(left, "context")
        if below is not None:
            lower = below.select(F.col("gram").alias("suffix"), *[F.col(f"v_{i}").alias(f"q_{i}") for i in span])
            frame = frame.withColumn("suffix", low(F.col("gram"), k - 1)).join(lower, "suffix")
        backing = [F.col(f"q_{i}") for i in span] if below is not None else uniform
        p = [F.coalesce(F.coalesce(F.greatest(F.col(f"c_{i}") - cut[i], F.lit(0.0)), F.lit(0.0)) / F.col(f"s_{i}"), F.lit(0.0))
             + F.coalesce(F.col(f"b_{i}"), F.lit(1.0)) * backing[i] for i in span]
        often = sum((F.coalesce(F.col(f"c_{i}"), F.lit(0)) for i in span), F.lit(0))
        below = written(frame.select("gram", often.alias("often"), *[x.alias(f"v_{i}") for i, x in enumerate(p)]), "probabilities")
        tables.append(below)
    return tables, contexts


#: The multipliers of the public xxHash64, which Spark has as xxhash64() with this seed.
PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
SEED = np.uint64(42)


def slot(gram: np.ndarray) -> np.ndarray:
    """The slot of each gram: leading bits of the hash that ``F.xxhash64`` gives for a bigint."""
    turn = lambda x, by: x << np.uint64(by) | x >> np.uint64(64 - by)
    one, two, three, four, five = PRIMES
    with np.errstate(over="ignore"):
        h = (SEED + five + np.uint64(8)) ^ (turn(gram.astype(np.uint64) * two, 31) * one)
        h = turn(h, 27) * one + four
        h = (h ^ h >> np.uint64(33)) * two
        h = (h ^ h >> np.uint64(29)) * three
    return ((h ^ h >> np.uint64(32)) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def one_per_slot(table: DataFrame, order: Column | str = "gram") -> DataFrame:
    """At most 2**SLOT_BITS rows: of the grams that share a slot the first in the order."""
    values = F.struct(*[c for c in table.columns if c != "gram"])
    return table.groupBy(F.shiftrightunsigned(F.xxhash64("gram"), 64 - SLOT_BITS).cast("int").alias("slot")).agg(
        F.min_by(values, order).alias("v")).select("slot", "v.*")


class Model:
    """Sorted grams and contexts of each order, with a log2 for every language.

    With ``rest``, the tables and contexts that are too long for a task, it holds grams of
    the highest order only.
    """

    def __init__(self, langs: list[str], tables: list[pa.Table], contexts: list[pa.Table],
                 rest: tuple[list[DataFrame], list[DataFrame]] | None = None):
        self.langs, self.rest = langs, rest
        self.grams, self.contexts = ([self.sorted(t) for t in every] for every in (tables, contexts))

    def __getstate__(self) -> dict:
        return {**self.__dict__, "rest": None}

    def sorted(self, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        grams = table.column("gram").to_numpy()
        value = np.stack([table.column(f"v_{i}").to_numpy() for i in range(len(self.langs))], 1).astype(float)
        order = np.argsort(grams)
        return grams[order], np.log2(np.nan_to_num(value[order], nan=1.0)).astype(np.float32)

    @staticmethod
    def find(held: tuple[np.ndarray, np.ndarray], gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(held[0], gram), len(held[0]) - 1)
        return held[1][at], held[0][at] == gram

    def log_p(self, gram: np.ndarray, k: int = ORDER) -> np.ndarray:
        """log2 p of each gram in all languages; a gram that no language has backs off."""
        if k == 0:
            return np.full((len(gram), len(self.langs)), -float(SYMBOL_BITS), np.float32)
        out, there = self.find(self.grams[k - 1], gram)
        missing = np.flatnonzero(~there)
        if len(missing):
            lost = gram[missing]
            left, known = self.find(self.contexts[k - 1], lost >> SYMBOL_BITS)
            out[missing] = self.log_p(lost & ((1 << (SYMBOL_BITS * (k - 1))) - 1), k - 1) + left * known[:, None]
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol in each language, and the number of symbols (0: no letter)."""
        found, owner, letters = grams(texts)
        n = np.bincount(owner, minlength=len(texts))
        total = np.zeros((len(texts), len(self.langs)))
        if len(found):
            bits, starts = self.log_p(found), np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            total[owner[starts]] = -np.add.reduceat(bits, starts, dtype=np.float64)
        return total / np.maximum(n, 1)[:, None], np.where(letters, n, 0)


DRAWN = "doc_id bigint, lang string, text string, bits array<double>, n bigint"


def with_bits(rows: DataFrame, model: Broadcast) -> DataFrame:
    """The rows with the cross-entropies of the model's languages added to ``bits``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            before = batch.column("bits").to_pylist()
            for part in blocks(texts):
                bits, n = model.value.cross_entropies(texts[part])
                size = part.stop - part.start
                columns = [batch.column(c).slice(part.start, size) for c in ("doc_id", "lang", "text")]
                added = [[*old, *new] for old, new in zip(before[part], bits.tolist(), strict=True)]
                yield pa.record_batch([*columns, pa.array(added, pa.list_(pa.float64())), pa.array(n, pa.int64())],
                                      names=["doc_id", "lang", "text", "bits", "n"])

    return rows.mapInArrow(run, DRAWN)


def log_p_table(grams: DataFrame, model: Model) -> DataFrame:
    """(gram, p_0, ...): what ``Model.log_p`` says of each gram, by joins with the tables of all orders."""
    span = range(len(model.langs))
    frame = grams.withColumns({f"p_{i}": F.lit(-float(SYMBOL_BITS)) for i in span})
    for k, (table, context) in enumerate(zip(*model.rest, strict=True), start=1):
        table = table.select(F.col("gram").alias("of"), *[F.log2(f"v_{i}").alias(f"g_{i}") for i in span])
        context = context.select(F.col("gram").alias("after"), *[F.log2(f"v_{i}").alias(f"l_{i}") for i in span])
        frame = frame.withColumn("of", low(F.col("gram"), k)).withColumn("after", F.shiftright("of", SYMBOL_BITS)).join(
            table, "of", "left").join(context, "after", "left").select(
            "gram", *[F.coalesce(f"g_{i}", F.coalesce(f"l_{i}", F.lit(0.0)) + F.col(f"p_{i}")).alias(f"p_{i}") for i in span])
    return frame


def with_bits_by_joins(rows: DataFrame, model: Model) -> DataFrame:
    """``with_bits`` of a model whose grams do not all fit a task: the others are counted by row and joined."""
    span = range(len(model.langs))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, values = held.value.grams[0]
        for batch in batches:
            ids, texts = batch.column("row").to_numpy(), [t or "" for t in batch.column("text").to_pylist()]
            for part in blocks(texts):
                found, owner, letters = grams(texts[part])
                size = part.stop - part.start
                bits, there = held.value.find((head, values), found)
                total = np.stack([np.bincount(owner, np.where(there, bits[:, i], 0), size) for i in span], 1)
                n = np.where(letters, np.bincount(owner, minlength=size), 0)
                yield pa.record_batch([pa.array(ids[part]), pa.nulls(size, pa.int64()), pa.array(n, pa.int64()),
                                       pa.array(total.tolist(), pa.list_(pa.float64()))], names=["row", "gram", "n", "known"])
                order = np.lexsort((found[~there], owner[~there]))
                lost, of = found[~there][order], owner[~there][order]
                starts = np.flatnonzero(np.r_[len(lost) > 0, (lost[1:] != lost[:-1]) | (of[1:] != of[:-1])])
                yield pa.record_batch([pa.array(ids[part][of[starts]]), pa.array(lost[starts]), pa.array(np.diff(np.r_[starts, len(lost)]), pa.int64()),
                                       pa.nulls(len(starts), pa.list_(pa.float64()))], names=["row", "gram", "n", "known"])

    counted = written(rows.select("row", "text").mapInArrow(run, "row bigint, gram bigint, n bigint, known array<double>"), "counted")
    lost = counted.filter("gram IS NOT NULL").select("row", "gram", F.col("n").alias("times"))
    sums = lost.join(log_p_table(lost.select("gram").distinct(), model), "gram").groupBy("row").agg(
        *[F.sum(F.col("times") * F.col(f"p_{i}")).alias(f"s_{i}") for i in span])
    per_row = counted.filter("gram IS NULL").select("row", F.col("n").alias("symbols"), "known").join(sums, "row", "left")
    # a text without letters has no symbol that counts
    added = F.array(*[F.when(F.col("symbols") > 0, -(F.get("known", F.lit(i)) + F.coalesce(f"s_{i}", F.lit(0.0))) / F.col("symbols")).otherwise(0.0)
                      for i in span])
    return rows.drop("n").join(per_row, "row").select("doc_id", "lang", "text", F.concat("bits", added).alias("bits"), F.col("symbols").alias("n"))


def learn(rows: DataFrame) -> list[Model]:
    """Models of blocks of languages from (lang, text) rows; both are not null."""
    counts = written(count_grams(rows), "gram_counts")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    models = []
    for i in range(0, len(langs), LANGUAGES_AT_ONCE):
        some = langs[i:i + LANGUAGES_AT_ONCE]
        tables, contexts = model_tables(counts.filter(F.col("lang").isin(some)), some)
        # no order below has more grams, and no order more contexts than grams
        if tables[-1].count() <= MOST_GRAMS:
            models.append(Model(some, *[[t.toArrow() for t in part] for part in (tables, contexts)]))
        else:
            often = one_per_slot(tables[-1].withColumn("key", F.col("gram")), F.struct(-F.col("often"), F.col("gram")))
            models.append(Model(some, [often.drop("slot").withColumnRenamed("key", "gram").toArrow()], [], (tables, contexts)))
    return models


def identify(docs: DataFrame, learn_from: Column, id_col: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score, bits (lowest cross-entropy per symbol) and rejected of every row."""
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"), F.coalesce(learn_from, F.lit(False)).alias("learn"))
    known = rows.filter(F.col("learn") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    models = learn(known.select("lang", "text"))
    if not models:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(None).cast("double").alias("bits"), F.lit(False).alias("rejected"))
    langs = [lang for m in models for lang in m.langs]
    drawn = rows.select("doc_id", F.when(F.col("learn"), F.col("lang")).alias("lang"), "text",
                        F.array().cast("array<double>").alias("bits"), F.lit(0).cast("bigint").alias("n"))
    for model in models:
        if model.rest is None:
            drawn = with_bits(drawn, docs.sparkSession.sparkContext.broadcast(model))
        else:
            drawn = with_bits_by_joins(drawn, model)
    best = F.array_min("bits")
    odds = F.aggregate("bits", F.lit(0.0), lambda s, b: s + F.pow(
        F.lit(2.0), -(b - F.array_min("bits")) * F.least(F.col("n"), F.lit(float(EVIDENCE)))))
    pred = F.element_at(F.array(*map(F.lit, langs)), F.array_position("bits", best).cast("int"))
    judged = written(drawn.select("doc_id", "lang", "n", F.when(F.col("n") > 0, pred).otherwise("und").alias("lang_pred"),
                                  F.when(F.col("n") > 0, 1 / odds).otherwise(0.0).alias("score"),
                                  F.when(F.col("n") > 0, best).alias("bits")), "judged")
    limits = judged.filter((F.col("lang") == F.col("lang_pred")) & (F.col("n") >= REJECT_LEAST_SYMBOLS)).groupBy(
        "lang").agg(F.percentile_approx("bits", REJECT_QUANTILE, 10_000).alias("limit")).collect()  # one row a language
    limit = F.lit(None).cast("double")
    for r in limits:
        limit = F.when(F.col("lang_pred") == r["lang"], F.lit(r["limit"])).otherwise(limit)
    return judged.select("doc_id", "lang_pred", "score", "bits", F.coalesce(F.col("bits") > limit, F.lit(False)).alias("rejected"))
