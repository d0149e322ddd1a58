import random
import re

import numpy as np
import pytest

from sitelens.llm import near_dup
from sitelens.llm.components import components
from sitelens.llm.queries import op6_minhash


def shingle_set(text, width=2):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} - {()}
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width=2):
    """{doc_id: (set size, component)} with all pairs compared."""
    sets = [(d, shingle_set(t, width)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: (len(s), find(d)) for d, s in sets}


def as_dict(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def test_whole_table_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows)
    frame = op6_minhash(spark, sf)
    assert as_dict(frame) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in frame.collect())
    assert len({c for _, c in want.values()}) < len(rows)


def test_chains_ties_and_copies(spark, documents):
    random.seed(3)
    word = lambda: "".join(random.choices("abcdefgh", k=6))
    base = [word() for _ in range(40)]
    rows, text = [], list(base)
    for i in range(60):  # a chain: neighbours are similar, the ends are not
        text[i % 40] = word()
        rows.append((1000 - i, " ".join(text)))
    rows += [(2000 + i, " ".join(base)) for i in range(50)]
    rows += [(3000, "a b c d e f"), (3001, "A B C d e f"), (3002, "f e d c b a"), (3003, "only"), (3004, "ONLY")]
    for width in (2, 5):
        assert as_dict(near_dup.cluster(documents(rows), width)) == brute(rows, width)


def test_odd_rows(spark, documents, odd_rows):
    got = sorted(map(str, near_dup.cluster(documents(odd_rows), 2).collect()))
    named = brute([r for r in odd_rows if r[0] is not None])
    assert len(got) == len(odd_rows)
    for r in near_dup.cluster(documents(odd_rows), 2).collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == named[r.doc_id]
    assert near_dup.cluster(documents([]), 2).collect() == []


def test_densified_sketch_estimates_similarity():
    """Also for sets far smaller than the number of bins."""
    rng = np.random.default_rng(7)
    for size in (1, 2, 5, 40, 3000):
        hits = []
        for _ in range(60):
            x = np.unique(rng.integers(0, 2**64, size, np.uint64))
            y = np.unique(np.r_[x[: max(1, int(len(x) * 0.8))], rng.integers(0, 2**64, size - max(1, int(len(x) * 0.8)), np.uint64)])
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            hits.append((near_dup.sketch(x) == near_dup.sketch(y)).mean() - true)
        assert abs(np.mean(hits)) < 0.06


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7000, 7000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}


@pytest.mark.parametrize("text", ["", "x", "x y", "x y x y x"])
def test_shingler(text):
    for width in (2, 5):
        assert len(near_dup.Shingler(width)(text)) == len(shingle_set(text, width))


def test_links_across_components_from_differences(spark):
    random.seed(8)
    pool = list(range(60))
    sets = {bytes([i]): sorted(random.sample(pool, random.randint(40, 55))) for i in range(1, 40)}
    hub = bytes([0])
    sets[hub] = pool[:50]
    table = spark.createDataFrame(list(sets.items()), "class binary, shingles array<bigint>")
    rest = spark.createDataFrame([(k, c, len(s), bytes([c[0] % 7]), hub, 50) for c, s in sets.items() for k in (1, 2) if c != hub],
                                 "bucket bigint, class binary, n int, root binary, hub binary, hub_n int")
    got = {(bytes(r.u), bytes(r.v)) for r in near_dup.linked_across(near_dup.with_differences(rest, table), 80).collect()}
    want = {(a, b) for a in sets for b in sets if hub < a < b and a[0] % 7 != b[0] % 7
            and 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})}
    assert got == want and want
