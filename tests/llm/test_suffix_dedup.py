import hashlib
import random

import numpy as np

from sitelens.llm import suffix_dedup as sd
from sitelens.llm.queries import op9_suffix


def brute(rows):
    """[(doc_id, bytes, removed, spans, kept digest)] with every window in one dictionary."""
    texts = sorted({(2**63 - 1 if d is None else d, t or "") for d, t in rows})
    seen, marks = {}, {}
    for key in texts:
        data = key[1].encode()
        mark = np.zeros(len(data) + 1, np.int8)
        for i in range(len(data) - 99):
            w = data[i:i + 100]
            if w in seen:
                mark[i:i + 100] = 1
            else:
                seen[w] = key
        marks[key] = mark
    out = []
    for d, t in rows:
        data, mark = (t or "").encode(), marks[2**63 - 1 if d is None else d, t or ""]
        kept = bytes(b for b, m in zip(data, mark, strict=False) if not m)
        out.append((str(d), len(data), int(mark.sum()), int((np.diff(np.r_[0, mark]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(frame):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in frame.collect())


def planted():
    random.seed(11)
    text = lambda n: "".join(random.choices("abcdefgh é", k=n))
    passages = [text(n) for n in (60, 99, 100, 101, 150, 400)]
    rows = []
    for d in range(80):
        rows.append((d, "".join(x for _ in range(4) for x in (text(random.randint(0, 150)), random.choice(passages)))))
    whole = text(900)
    rows += [(200 + i, whole) for i in range(6)] + [(300 + i, whole[:i * 37] + "X" + whole[i * 37 + 1:]) for i in range(20)]
    rows += [(400, "ab" * 400), (401, "a" * 777), (402, "ab" * 150 + "c" + "ab" * 150), (403, ("0123456789" * 12 + "x") * 5)]
    return rows


def test_against_dictionary(spark, documents, odd_rows, monkeypatch):
    rows = [*planted(), *odd_rows]
    assert got(sd.deduplicate(documents(rows))) == brute(rows)
    monkeypatch.setattr(sd, "RECORDS_PER_BUCKET", 50)
    assert got(sd.deduplicate(documents(rows).repartition(7))) == brute(rows)
    assert sd.deduplicate(documents([])).collect() == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op9_suffix(spark, sf).collect())
    assert found == brute(rows)
    assert sum(r[2] for r in found) > 0


def test_loser_tree_reads_known_prefixes_once(monkeypatch):
    random.seed(1)
    runs = [sorted(bytes(random.choices(b"ab", k=random.randint(0, 30))) for _ in range(random.randint(0, 60))) for _ in range(13)]
    lcps = [sd.front_code(r) for r in runs]
    order, shares = sd.merge(runs, lcps)
    merged = [runs[r][i] for r, i in order]
    assert merged == sorted(s for r in runs for s in r)
    assert shares == sd.front_code(merged)
    asked = []
    monkeypatch.setattr(sd, "common", lambda a, b, known, f=sd.common: asked.append(a[:known] == b[:known]) or f(a, b, known))
    sd.merge(runs, lcps)
    assert asked and all(asked)


def test_anchors_are_consistent():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 700, np.uint8)
    moved = np.concatenate([rng.integers(97, 101, 45, np.uint8), data])
    a, b = sd.window_anchors(data), sd.window_anchors(moved)
    of = lambda x: {int(s) + i: int(p) for p, s, n in zip(*x[1:], strict=True) for i in range(n)}
    one, two = of(a), of(b)
    assert set(one) == set(range(601)) and all(two[s + 45] == p + 45 for s, p in one.items())
