import math

import numpy as np
from pyspark.sql import functions as F

from sitelens.llm import pivot_search
from tests.llm.oracle import agree

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, top, every=20):
    usable = []
    for vec_id, vector in rows:
        if vec_id is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            usable.append((vec_id, [math.floor(64 * float(np.float32(x))) for x in vector]))
    out = []
    for i, (query, q) in enumerate(usable):
        if query % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), vec_id)
                            for j, (vec_id, v) in enumerate(usable) if j != i)
            out += [(query, rank, vec_id, -s) for rank, (s, vec_id) in enumerate(scores[:top], 1)]
    return sorted(out)


def frame(spark, rows):
    made = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return made.select("*", *[F.lit(1).alias(c) for c in ("row", "v", "n", "score", "block", "cell")])


def got(found):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())


def clustered(n, dims, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims)) * 3
    # a third of all vectors are alike
    return [(i, (centres[0] if i % 3 == 0 else centres[i % 6] + rng.normal(size=dims) * 0.2).tolist()) for i in range(n)]


def test_against_brute_force(spark):
    rows = clustered(700, 12)
    rows += [(700, None), (720, [1.0, None]), (740, [float("nan")] * 12), (760, [float("inf")] * 12), (None, [1.0] * 12),
             (780, []), (800, [2.5, -1.0]), (820, [0.0] * 12), (20, [1.0] * 12), (20, rows[20][1])]
    found = pivot_search.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, top=9, block_rows=64)
    assert dict(found.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert got(found) == brute(rows, 9)


def test_few_rows_and_none(spark):
    none = pivot_search.top_k(frame(spark, []), F.col("vec_id") % 20 == 0)
    assert none.collect() == []
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 0.5])]
    assert got(pivot_search.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0)) == brute(rows, 20)
    assert got(pivot_search.top_k(frame(spark, rows[:1]), F.col("vec_id") % 20 == 0)) == []
    zeros = [(i, [0.0] * 3) for i in range(30)]
    assert got(pivot_search.top_k(frame(spark, zeros), F.col("vec_id") % 20 == 0)) == brute(zeros, 20)


def test_products_are_exact():
    rng = np.random.default_rng(0)
    for size in (2**5, 2**10, 2**27, 2**45):
        x, q = rng.integers(-size, size, (40, 6)), rng.integers(-size, size, (2, 6))
        want = [max(1 - 2**63, min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(r, q[1], strict=True)))) for r in x]
        products = pivot_search.Products(x, q)
        assert products.of(1, np.arange(40)).tolist() == want and products.of(1, np.array([7, 3])).tolist() == [want[7], want[3]]


def test_bounds_hold_and_save_work():
    rows = np.floor(64 * np.array([v for _, v in clustered(900, 16)])).astype(np.int64)
    pivots = np.vstack([np.zeros(16), rows[[1, 2, 3, 4, 5]]]).astype(float)
    d = pivot_search.distances(rows, pivots)
    block = {"ids": np.arange(900), "rows": np.arange(900), "vectors": rows, "distances": d}
    q = {k: v[:30] for k, v in block.items()}
    exact = rows @ q["vectors"].T
    for i in range(30):
        gap = np.abs(d - d[i]).max(axis=1)
        bound = pivot_search.bounds(d[i, 0], d[:, 0], gap)
        assert (bound >= exact[:, i]).all()
        assert bound.mean() < pivot_search.bounds(d[i, 0], d[:, 0], np.abs(d[:, 0] - d[i, 0])).mean()
    for i, ids, scores in pivot_search.search(q, block, np.full(30, -np.inf), 20):
        want = sorted((-int(s), j) for j, s in enumerate(exact[:, i]) if j != i)[:20]
        assert [(-int(s), int(j)) for j, s in zip(ids, scores, strict=True)] == want


def test_box_bound_holds_for_all_rows(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(50, 5)) * 20, rng.normal(size=(40, 5)) * 30 + 10
    pivots = np.vstack([np.zeros(5), x[:3]])
    dx, dy = pivot_search.distances(x, pivots), pivot_search.distances(y, pivots)
    box = spark.createDataFrame([(dx.min(0).tolist(), dx.max(0).tolist(), float(dx[:, 0].max()), dy.min(0).tolist(), dy.max(0).tolist(), float(dy[:, 0].max()))],
                                "q_near array<double>, q_far array<double>, q_norm double, near array<double>, far array<double>, norm double")
    assert box.select(pivot_search.box_bound()).first()[0] >= (x @ y.T).max()


def test_query_equals_sql(spark):
    assert agree(spark, "op11_topk", "/root/testdata/sf0.001")
