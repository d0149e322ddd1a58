import base64
import hashlib

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sitelens.llm import toxicity
from tests.llm import test_decontam, test_line_dedup, test_near_dup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, docs, corpus_pipeline.written(stage(spark, docs, SF), f"test_{name}")))
        docs = out[-1][2]
    return {name: (before, after) for name, before, after in out}


def rows(frame):
    return sorted((r.doc_id, r.text) for r in frame.collect())


def test_stages_keep_the_columns(stages):
    for name, (before, after) in stages.items():
        if name != "bpe":
            assert after.schema == before.schema


def test_toxicity_takes_out_what_it_rejects(spark, stages):
    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(before, labels, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    assert rows(after) == [(d, t) for d, t in rows(before) if model.score(t) < 0.3]


def test_lines_against_brute_force(stages):
    before, after = stages["line_dedup"]
    cleaned = test_line_dedup.brute(rows(before))
    want = sorted((int(d), t) for d, n, gone, t in cleaned if gone < n or not n)
    assert rows(after) == want


def test_near_duplicates_against_all_pairs(stages):
    before, after = stages["near_dedup"]
    groups = test_near_dup.brute(rows(before), width=5)
    assert rows(after) == [(d, t) for d, t in rows(before) if groups[d][1] == d]


def test_decontamination_against_brute_force(spark, stages):
    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {int(r[0]) for r in test_decontam.brute(rows(before), items) if r[5]}
    assert rows(after) == [(d, t) for d, t in rows(before) if d not in hit]


def test_tokens_against_library(stages):
    before, after = stages["bpe"]
    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    texts = dict(rows(before))
    for r in after.collect():
        ids = np.frombuffer(base64.b64decode(r.ids_base64), "<u4").tolist()
        assert ids == tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids and len(ids) == r.n_tokens
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert after.count() == before.count()


def test_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() <= len(odd_rows)
        assert stage(spark, documents([]), SF).count() == 0


def test_rows_of_one_id_are_judged_by_their_own_texts(spark, documents):
    a, b = ("alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3).strip(), "another text of some eight words or so here"
    docs = documents([(3, a), (5, a), (5, b), (None, a)])
    assert rows(corpus_pipeline.near_duplicates(spark, docs.filter("doc_id IS NOT NULL"), SF)) == [(3, a), (5, b)]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 100").first().text
    out = corpus_pipeline.decontamination(spark, documents([(1, a), (1, item), (2, b)]), SF)
    assert rows(out) == [(1, a), (2, b)]


def test_columns_of_any_name(spark, documents):
    names = ("hit", "hit_id", "hit_hash", "row", "text_hash", "class", "gone", "lines", "doc", "a.b")
    docs = documents([(1, "some words in a line of text"), (2, None)]).select("*", *[F.lit(n).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 2 and (name == "bpe" or out.schema == docs.schema), name
