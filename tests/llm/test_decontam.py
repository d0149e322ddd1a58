import random
import re

from pyspark.sql import functions as F

from sitelens.llm import decontam, queries
from tests.llm.oracle import agree


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items):
    windows = {}
    for i, text in items:
        w = words(text)
        if w and i is not None:
            n = min(10, len(w))
            for p in range(len(w) - n + 1):
                windows.setdefault(tuple(w[p:p + n]), set()).add(str(i))
    out = []
    for d, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in windows}:
            for p in range(len(w) - n + 1):
                if (g := tuple(w[p:p + n])) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[g]
        out.append((str(d), len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return sorted(out)


def got(frame):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, ",".join(r.item_ids), r.contaminated)
                  for r in frame.collect())


def test_against_brute_force(spark, documents, odd_rows, monkeypatch):
    random.seed(2)
    letters = [*"abcÉé", "Zz", "x1"]
    rows = [*odd_rows, *[(100 + i, random.choice([" ", "-"]).join(random.choices(letters, k=random.randint(0, 400))))
                         for i in range(60)], (4, "one two")]
    items = [(i, " ".join(random.choices(letters[:4], k=random.randint(4, 13)))) for i in range(30)]
    items += [(50, "only"), (51, ""), (52, None), (None, "no id here"), (53, "tie tie tie tie tie tie tie tie tie tie tie"),
              (54, "word word"), (55, "one"), (55, "no id")]
    for d in range(20):
        rows.append((300 + d, "- ".join(["lead", items[d][1], "tail", items[(d * 7) % 30][1]])))
    table = spark.createDataFrame(items, "item_id bigint, text string").withColumn("window", F.lit(1))
    want = brute(rows, items)
    assert got(decontam.contamination(documents(rows), table)) == want
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)  # the way without broadcasts
    assert got(decontam.contamination(documents(rows), table)) == want


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert got(decontam.contamination(documents([(1, "a b")]), none)) == [("1", 2, 0, 0, "", False)]
    assert got(decontam.contamination(documents([]), none)) == []


def test_oracle(spark):
    rows = agree(spark, "op2_decontamination", "/root/testdata/sf0.01")
    assert len(rows) == 1000 and sum(r[0] for r in rows) > 5
    assert queries.ORACLES
