import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from sitelens.llm import toxicity
from sitelens.llm.queries import op4_toxicity


def test_label_model_finds_accuracies_and_dependence():
    rng = np.random.default_rng(4)
    truth = rng.random(6000) < 0.2
    fires = lambda a, b: np.where(truth, rng.random(6000) < a, rng.random(6000) < b)
    votes = np.stack([fires(0.7, 0.02), fires(0.5, 0.01), fires(0.6, 0.05), fires(0.3, 0.3)], 1).astype(float)
    votes = np.concatenate([votes, votes[:, :1], votes[:, :1]], 1)  # two copies of the first voter
    votes = np.column_stack([votes, votes[:, [0, 1, 2, 4, 5]].max(1) == 0])
    model = toxicity.LabelModel(votes, 0.2, np.where(rng.random(6000) < 0.1, ~truth, truth).astype(float))
    assert abs(model.toxic[1] - 0.5) < 0.2 and model.clean[1] < 0.06
    assert abs(np.log(model.toxic[3] / model.clean[3])) < 0.4  # says nothing
    assert model.voice[0] < 0.75 * model.voice[1]
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.88


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op4_toxicity(spark, sf).collect()
    assert len(rows) == 10000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    hit = sum(p and t for p, t in held)
    assert hit >= 0.9 * sum(t for _, t in held)
    assert hit >= 0.9 * sum(p for p, _ in held)


def test_odd_rows(spark, documents, odd_rows):
    rows = [*odd_rows, (60, "you are a stupid idiot, a worthless loser"), (61, "a fine day")]
    labels = spark.createDataFrame([(1, 0), (2, 0), (4, 0), (4, 1), (None, 1), (60, None), (99, 1)], "doc_id bigint, toxic int")
    for table in (labels, labels.limit(0)):
        docs = documents(rows)
        model = toxicity.fit(docs, table, F.lit(True))
        got = docs.select("doc_id", toxicity.score_column(docs, model, F.col("text")).alias("s")).collect()
        assert len(got) == len(rows) and all(0 <= r.s <= 1 for r in got)
    named = {r.doc_id: r.s for r in got}
    assert named[60] > 0.5 > 0.1 > named[61]
    assert named[1] == named[2] == named[61]
    empty = documents([])
    assert empty.select(toxicity.score_column(empty, toxicity.fit(empty, labels, F.lit(True)), F.col("text"))).collect() == []


def test_votes_take_columns_of_voters_only():
    rng = np.random.default_rng(2)
    features = [rng.choice(4096, n, replace=False) for n in rng.integers(0, 60, 3000)]
    voters = rng.choice(4096, 40, replace=False).tolist()
    tracemalloc.start()
    votes = toxicity.votes_of(features, 4096, voters)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (votes == [[v in set(f.tolist()) for v in voters] for f in features]).all()
    # a column for each of the 4,096 features would take 49 MB
    assert peak < 8 << 20
