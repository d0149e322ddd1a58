import random
import re
from collections import Counter, defaultdict

import pytest

from sitelens.llm import divergence
from tests.llm.oracle import agree

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, limit):
    counts, docs, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = LETTERS.findall((text or "").translate(LOWER))
        counts.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    kept = defaultdict(list)
    for (lang, term), n in docs.items():
        if n >= 3:
            kept[lang].append(term)
    sources = defaultdict(list)
    for lang, source in groups:
        sources[lang].append(source)

    def shares(lang, count):
        n = sum(count(t) for t in kept[lang])
        return {t: 1 + 1_000_000_000 * (count(t) + 1) // (n + len(kept[lang])) for t in kept[lang]}

    out = []
    for lang, source in groups:
        p = shares(lang, lambda t: counts[lang, source, t])  # noqa: B023
        whole = shares(lang, lambda t: sum(counts[lang, s, t] for s in sources[lang]))  # noqa: B023
        pairs = []
        for other in sources[lang]:
            if other != source:
                q = shares(lang, lambda t: counts[lang, other, t])  # noqa: B023
                pairs.append((-sum((p[t] - q[t]) ** 2 // q[t] for t in kept[lang]), other.encode(), other))
        terms = [(-((p[t] - whole[t]) ** 2 // whole[t]), t.encode(), t) for t in kept[lang]
                 if counts[lang, source, t] and p[t] > whole[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:limit])):
            out += [(lang, source, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def got(frame):
    assert dict(frame.dtypes)["value"] == "bigint" and dict(frame.dtypes)["rank"] == "int"
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in frame.collect())


@pytest.mark.parametrize("limit", [1, 7, 200])
def test_against_brute_force(spark, documents, odd_rows, limit):
    random.seed(limit)
    vocabulary = [chr(97 + i % 26) * (1 + i // 26) for i in range(90)] + ["Ünï", "漢字", "ééé", "🙂"]
    rows = [(*r, None, None) for r in odd_rows]
    for i in range(300):
        # one source has a third of all rows; ties are frequent; one language keeps no term
        source = random.choice(["hot"] * 4 + ["a", "b", "c", None, "", "Ärger"])
        lang = random.choice(["en", "en", "de", None])
        words = random.choices(vocabulary, weights=[1 / (k + 1) for k in range(len(vocabulary))], k=random.randint(0, 30))
        rows.append((i, " 3.".join(w.upper() if random.random() < 0.3 else w for w in words), lang, source))
    rows += [(1000, "only here", "xx", "a"), (1001, "nothing", "xx", "b"), (1002, None, "yy", "alone")]
    assert got(divergence.audit(documents(rows), limit)) == brute(rows, limit)


def test_shares_beyond_64_bits(spark):
    counts = [0, 5, divergence.FITS - 1, divergence.FITS, 10**13]
    frame = spark.createDataFrame([(c, 10**15, 10**6) for c in counts], "c bigint, t bigint, v bigint")
    got = [r[0] for r in frame.select(divergence.share(*map(frame.__getitem__, "ctv"))).collect()]
    assert got == [1 + 10**9 * (c + 1) // (10**15 + 10**6) for c in counts]


def test_empty_table(documents):
    assert divergence.audit(documents([])).collect() == []


def test_tasks_give_away_what_they_hold(documents):
    rows = [(i, f"word{chr(97 + i % 7)} again", "en", "s") for i in range(50)]
    few, all_at_once = (divergence.counted(documents(rows), most).groupBy("term").sum("n", "docs").collect() for most in (1, 10**6))
    assert sorted(few) == sorted(all_at_once) and len(few) == 9 - 0 - 1


def test_blocks_end_between_words(monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 10)
    text = b"aa bbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbb c dddddd e" * 20
    parts = list(divergence.blocks(text))
    assert len(parts) > 5 and b"".join(parts) == text
    assert [w for p in parts for w in p.split()] == text.split()


def test_very_long_text(documents):
    long = "lorem ipsum " * 400_000  # over one block
    frame = divergence.counted(documents([(1, long + "z", "en", "s")])).groupBy("term").sum("n", "docs")
    assert sorted(tuple(r) for r in frame.collect()) == [(b"ipsum", 400_000, 1), (b"lorem", 400_000, 1), (b"z", 1, 1)]


def test_query_equals_sql(spark):
    assert agree(spark, "op12_divergence", "/root/testdata/sf0.001")
