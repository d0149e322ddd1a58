import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import language_id as li
from sitelens.llm.queries import op1_language


def fold(text):
    """Letters, single spaces between them, none in front."""
    out = re.sub(r"[\W\d_]+", " ", text.lower())
    return out[1:] if out.startswith(" ") else out


class PlainModel:
    """Interpolated Kneser-Ney with dictionaries, one language."""

    def __init__(self, texts):
        self.counts = [Counter() for _ in range(6)]
        for t in texts:
            s = "\0" * 4 + fold(t)
            s = s.replace(" ", "\0")
            for i in range(4, len(s)):
                self.counts[5][s[i - 4:i + 1]] += 1
        for k in range(4, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.cut, self.total, self.types = {}, {}, {}
        for k in range(1, 6):
            n1, n2 = (sum(c == n for c in self.counts[k].values()) for n in (1, 2))
            self.cut[k] = n1 / (n1 + 2 * n2) if n1 else 0.5
            self.total[k], self.types[k] = defaultdict(int), defaultdict(int)
            for g, c in self.counts[k].items():
                self.total[k][g[:-1]] += c
                self.types[k][g[:-1]] += 1

    def p(self, g):
        k = len(g)
        if k == 0:
            return 1 / li.SYMBOLS
        q, total = self.p(g[1:]), self.total[k].get(g[:-1], 0)
        if not total:
            return q
        return max(self.counts[k].get(g, 0) - self.cut[k], 0) / total + self.cut[k] * self.types[k][g[:-1]] / total * q

    def bits(self, text):
        s = "\0" * 4 + fold(text).replace(" ", "\0")
        return -sum(math.log2(self.p(s[i - 4:i + 1])) for i in range(4, len(s))) / (len(s) - 4)


def test_model_equals_plain_kneser_ney(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    rows = [(lang, text[:1500]) for lang, text in rows]
    (model,) = li.learn(spark.createDataFrame(rows, "lang string, text string"))
    unseen = ["Überall zzz ñandú qqq", "the of and", "x", "Éa! 42 b-c"]
    bits, n = model.cross_entropies(unseen)
    for i, lang in enumerate(model.langs):
        plain = PlainModel([t for other, t in rows if other == lang])
        for j, text in enumerate(unseen):
            assert bits[j, i] == pytest.approx(plain.bits(text), abs=0.15), (lang, text)  # slots may collide
    assert n.tolist() == [len(fold(t)) for t in unseen]


def test_slots_of_both_engines(spark):
    grams = np.random.default_rng(3).integers(0, 1 << 60, 500)
    frame = spark.createDataFrame([(int(g),) for g in grams], "gram bigint").withColumn("p", F.col("gram"))
    got = {r.p: r.slot for r in li.one_per_slot(frame).collect()}
    assert all(got[g] == s for g, s in zip(grams.tolist(), li.slot(grams).tolist(), strict=True) if g in got)
    assert len(got) > 490


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_language(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert 100 < len(held) < 300
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) < 0.05 * len(rows)


def test_odd_rows(spark, documents, odd_rows):
    rows = [(r[0], r[1], "en") for r in odd_rows] + [(50, "αβγ δεζ " * 30, "el"), (51, "αβγ", None), (52, "12 !", "el")]
    got = li.identify(documents(rows), learn_from=F.lit(True)).collect()
    assert len(got) == len(rows)
    named = {r.doc_id: r for r in got}
    assert named[51].lang_pred == "el" and named[4].lang_pred == "en"
    assert all(named[d].lang_pred == "und" and named[d].score == 0 for d in (1, 2, 3, 52))
    nothing = li.identify(documents(rows), learn_from=F.lit(False)).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and len(nothing) == len(rows)
    assert li.identify(documents([]), learn_from=F.lit(True)).collect() == []


def test_many_languages_in_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(li, "LANGUAGES_AT_ONCE", 2)
    rows = [(i, w * 40, lang) for i, (w, lang) in enumerate([("aba ", "a"), ("cdc ", "b"), ("efe ", "c"), ("ghg ", "d"), ("iji ", "e")])]
    got = {r.doc_id: r.lang_pred for r in li.identify(documents(rows), learn_from=F.lit(True)).collect()}
    assert got == {i: lang for i, (_, lang) in enumerate((r[1], r[2]) for r in rows)}


def test_grams_are_exact_and_those_beyond_memory_are_joined(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).select(
        "doc_id", F.substring("text", 1, 800).alias("text"), "lang").collect()
    frame = spark.createDataFrame([*rows, *rows[:3], (900, None, "en"), (901, " 12", "de"), (None, "\u00dcberall zzz qqq", None)], "doc_id bigint, text string, lang string")
    learnt = frame.filter("lang IS NOT NULL AND text IS NOT NULL")
    answers = []
    for bits, most in ((22, 1 << 22), (8, 100), (3, 100)):
        # slots that nearly all grams share change nothing
        monkeypatch.setattr(li, "SLOT_BITS", bits)
        monkeypatch.setattr(li, "MOST_GRAMS", most)
        (model,) = li.learn(learnt.select("lang", "text"))
        assert (model.rest is not None) == (bits < 22)
        answers.append(sorted(((r.doc_id is None, r.doc_id, r.lang_pred, r.rejected, r.score, r.bits) for r in li.identify(
            frame, learn_from=F.lit(True)).collect()), key=repr))
    for other in answers[1:]:
        assert [a[:4] for a in other] == [a[:4] for a in answers[0]]
        for a, b in zip(answers[0], other, strict=True):
            assert a[4] == pytest.approx(b[4], abs=1e-4) and (a[5] == b[5] if a[5] is None else a[5] == pytest.approx(b[5], abs=1e-4))
