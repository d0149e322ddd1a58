"""Quality rules with thresholds that follow each language and source.

1. Every text gives five counts, computed in its row (no shuffle).
2. Each (language, source) gathers a KLL quantile sketch of each ratio, combined
   before the shuffle; sketches of a language and of everything are merged from
   those, and stand in where a group has too few rows to judge itself.
3. A bound is the upper quartile plus a multiple of the spread between quartiles,
   never narrower than a stated least spread; the bounds are joined to the counts
   and a text outside one of its bounds is not kept.

Counts are written to the shared folder once, so that texts are read a single
time and a lost executor repeats only its part.

Defined results: a null text has no words; null ``lang`` or ``source`` is a group
of its own; rows are answered one by one, so repeated rows and repeated or null
``doc_id`` stay; other columns are not read; an empty table gives none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.arrays import NOT_SPACE, SPACE, let, pairs_with_next, words_of
from sitelens.session import written

SYMBOLS = "#*$%&|<>"
FEWEST_WORDS, MOST_REPEATED_PERCENT = 50, 50
SKETCH_K = 800
LEAST_ROWS = 200  # a group with fewer rows takes the bounds of its language, a small language all rows'
SPREADS = 4.0
BROADCAST_ROWS = 50_000
#: Ratio, the least spread between its quartiles, and whether it has a lower bound as well.
RATIOS = {
    "chars_per_word": (0.75, True),
    "symbols_per_word": (0.03, False),
    "dup_lines_per_line": (0.12, False),
    "repeats_per_word": (0.09, False),
    "capitals_per_char": (0.06, False),
}


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text."""
    pair = pairs_with_next(words, lambda a, b: F.concat(a, F.lit(" "), b))
    grams = let(words, lambda w: F.zip_with(
        F.slice(pair, F.lit(1), F.size(w) - 2), F.slice(w, F.lit(3), F.size(w) - 2),
        lambda ab, c: F.concat(ab, F.lit(" "), c)))

    def covered(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        twins = pairs_with_next(placed, lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
        starts = F.array_distinct(F.flatten(F.filter(twins, lambda t: t.isNotNull())))
        return F.size(F.array_distinct(F.flatten(F.transform(
            starts, lambda i: F.array(i, i + 1, i + 2)))))

    count = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(covered(g)))
    return F.when(F.size(words) < 4, 0).otherwise(count)


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each row's whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    return rows.select("doc_id", "lang", "source", text.alias("text"), words_of(text).alias("words"),
                       lines.alias("lines")).select(
        "doc_id", "lang", "source",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("bigint").alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("bigint").alias("n_capitals"))


def with_ratios(counts: DataFrame) -> DataFrame:
    per = lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1))
    return counts.withColumns({
        "base_failed": (F.col("n_words") < FEWEST_WORDS)
        | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")),
        "chars_per_word": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_lines_per_line": per("n_dup_lines", "n_lines"),
        "repeats_per_word": per("n_repeat_words", "n_words"),
        "capitals_per_char": per("n_capitals", "word_chars"),
    })


def sketches(ratios: DataFrame) -> DataFrame:
    """One mergeable sketch of each ratio for each language and source; base failures do not count."""
    return ratios.filter(~F.col("base_failed")).groupBy("lang", "source").agg(
        F.count("*").alias("n"), *[F.kll_sketch_agg_double(r, F.lit(SKETCH_K)).alias(r) for r in RATIOS])


def merged(parts: DataFrame, *by: str) -> DataFrame:
    return parts.groupBy(*by).agg(F.sum("n").alias("n"),
                                  *[F.kll_merge_agg_double(r, F.lit(SKETCH_K)).alias(r) for r in RATIOS])


def bounds(parts: DataFrame) -> DataFrame:
    """Bounds of each (lang, source): its own, or its language's, or those of all rows."""
    def of(frame: DataFrame, name: str) -> DataFrame:
        columns = []
        for ratio, (least, two_sided) in RATIOS.items():
            q1, q3 = (F.kll_sketch_get_quantile_double(ratio, F.lit(q)) for q in (0.25, 0.75))
            reach = SPREADS * F.greatest(q3 - q1, F.lit(least))
            low = q1 - reach if two_sided else F.lit(None).cast("double")
            columns += [low.alias(f"{ratio}_low"), (q3 + reach).alias(f"{ratio}_high")]
        keys = [c for c in ("lang", "source") if c in frame.columns]
        return frame.select(*keys, F.struct(F.col("n"), *columns).alias(name))

    by_lang = of(merged(parts, "lang"), "of_lang").withColumnRenamed("lang", "l")
    own = of(parts, "own").join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left").drop("l")
    # one row: the sketch of all, whose size does not depend on the number of rows
    every = own.join(F.broadcast(of(merged(parts), "of_all")))
    enough = lambda x: F.when(F.col(f"{x}.n") >= LEAST_ROWS, F.col(x))
    return every.select("lang", "source", F.coalesce(enough("own"), enough("of_lang"), "of_all").alias("bound"))


def outside(ratio: str) -> Column:
    high = F.col(ratio) > F.col(f"bound.{ratio}_high")
    return high | (F.col(ratio) < F.col(f"bound.{ratio}_low")) if RATIOS[ratio][1] else high


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the names of the ratios out of bounds."""
    counts = with_ratios(written(text_counts(docs), "text_counts"))
    table = written(bounds(sketches(counts)), "bounds").select(
        F.col("lang").alias("l"), F.col("source").alias("s"), "bound")
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # else a shuffled join, split where skewed
        table = F.broadcast(table)
    judged = counts.join(table, F.col("lang").eqNullSafe(F.col("l"))
                         & F.col("source").eqNullSafe(F.col("s")), "left")
    reasons = F.array_compact(F.array(*[F.when(outside(r), F.lit(r)) for r in RATIOS]))
    bad = reduce(lambda a, b: a | b, [F.coalesce(outside(r), F.lit(False)) for r in RATIOS])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~bad).alias("kept"), reasons.alias("reasons"), "lang", "source")
