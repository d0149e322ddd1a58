import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitelens.llm import quality
from sitelens.llm.queries import op5_quality


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


def check(rows, texts):
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                 for r in rows)
    want = []
    for d, t in texts:
        c = counts(t)
        want.append((str(d), *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert got == sorted(want)


def test_odd_rows(spark, documents, odd_rows):
    rows = quality.assess(documents([*odd_rows, (20, "b a " * 7), (21, "a b c d a b c")])).collect()
    check(rows, [*odd_rows, (20, "b a " * 7), (21, "a b c d a b c")])
    assert not any(r.kept for r in rows)
    assert quality.assess(documents([])).collect() == []


def test_counts_of_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = op5_quality(spark, sf).collect()
    check(rows, [(d.doc_id, d.text) for d in docs])
    assert not any(r.kept and r.base_failed for r in rows)


def test_bounds_follow_the_group(spark):
    """A ratio usual in one source is unusual in another; small groups take their language's bounds."""
    rows = [("en", s, 0.2 + i % 7 / 100 + (1.0 if s == "b" else 0.0)) for s in "ab" for i in range(400)]
    rows += [("en", "small", 0.2)] * 3
    frame = spark.createDataFrame(rows, "lang string, source string, symbols_per_word double").withColumns(
        {"base_failed": F.lit(False), **{r: F.lit(0.0) for r in quality.RATIOS if r != "symbols_per_word"}})
    high = {r.source: r.bound.symbols_per_word_high for r in quality.bounds(quality.sketches(frame)).collect()}
    assert high["a"] < 1.2 < high["b"]
    exact = frame.groupBy().agg(F.percentile("symbols_per_word", F.array(F.lit(0.25), F.lit(0.75)))).first()[0]
    assert high["small"] == pytest.approx(exact[1] + quality.SPREADS * (exact[1] - exact[0]), abs=0.1)
