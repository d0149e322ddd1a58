import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from sitelens.llm import collocations as c
from tests.llm.oracle import agree

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, first):
    grams, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            grams[lang].update(tuple(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = []
    for lang, f in grams.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        listed = []
        for g, a in found.items():
            longer = [b for h, b in found.items() if len(h) > len(g) and g in (h[:2], h[1:])]
            if any(100 * b >= 50 * a for b in longer):
                continue
            score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            listed.append((-score, -a, " ".join(g).encode(), " ".join(g), a, f[g[:k]], f[g[k:]], score))
        for rank, (*_, phrase, a, left, right, score) in enumerate(sorted(listed)[:first], 1):
            out.append((lang, rank, phrase, a, left, right, total[lang], score))
    return sorted(out)


def got(frame):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


def texts(seed, n=300):
    random.seed(seed)
    vocabulary = ["the", "New", "york", "times", "of", "a", "b", "ß", "漢", "\x1cx", "x-y", "9%"]
    fixed = ["new york times", "a b a b a", "of the", "x-y x-y x-y"]
    for i in range(n):
        words = [random.choice(fixed) if random.random() < 0.3 else random.choice(vocabulary) for _ in range(random.randint(0, 20))]
        yield i, "".join(w + random.choice([" ", " ", " ", "\t", ", ", "\n", ".  "]) for w in words), random.choice(["en", "en", "de", None, "und"])


@pytest.mark.parametrize(("seed", "least", "first", "shard_words"), [(1, 10, 2000, 1 << 20), (2, 3, 15, 40), (3, 2, 2000, 7)])
def test_against_brute_force(documents, odd_rows, seed, least, first, shard_words):
    rows = [*((*r, None) for r in odd_rows), *texts(seed)]
    assert got(c.collocations(documents(rows), first, least, shard_words)) == brute(rows, least, first)


def test_empty_table_and_texts_without_phrases(documents):
    assert c.collocations(documents([])).collect() == []
    assert c.collocations(documents([(1, None, "en"), (2, "one. two", "en"), (3, "", None)])).collect() == []


def test_intervals_count_all_phrases():
    rng = np.random.default_rng(5)
    for top, size in ((2, 30), (4, 200), (9, 1000), (40, 3000)):
        text = np.r_[0, rng.integers(0, top, size), 0]
        index = c.FMIndex(text, top)
        one = index.words()
        two, two_right = index.left(one), index.right(one)
        three, three_left = index.right(two), index.left(two)
        of = lambda found: {tuple(int(w[i]) for w in found.words): int(n) for i, n in enumerate(found.count)}
        for found, k in ((one, 1), (two, 2), (two_right, 2), (three, 3), (three_left, 3)):
            want = Counter(g for g in zip(*(text[i:].tolist() for i in range(k)), strict=False) if all(g))
            assert of(found) == dict(want)
        # the interval in each transform is where the phrase stands among the sorted places
        for found in (two, two_right):
            for text_, lo, flip in ((text, found.lo, 1), (text[::-1], found.other, -1)):
                keys = sorted((tuple([*text_[i:i + 3], 0, 0][:3]) for i in range(len(text_))))
                for i, begin in enumerate(lo):
                    phrase = tuple(w[i] for w in found.words)[::flip]
                    assert keys[begin][:2] == phrase and (begin == 0 or keys[begin - 1][:2] < phrase)


def test_steps_need_little_memory(monkeypatch):
    rng = np.random.default_rng(6)
    text = np.minimum(rng.zipf(1.3, 1 << 18), 20_000).astype(np.int32)
    text[rng.random(1 << 18) < 0.1] = 0

    def phrases():
        index = c.FMIndex(text, 20_001)
        two = index.left(index.words())
        return [(*found.words, found.count) for found in (two, index.right(two))]

    whole = phrases()
    monkeypatch.setattr(c, "STEP_PLACES", 1 << 13)
    tracemalloc.start()
    parts = phrases()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((x == y).all() for a, b in zip(whole, parts, strict=True) for x, y in zip(a, b, strict=True))
    assert peak < 72 * len(text)  # bytes for each place, results included


def test_packing_round_trip():
    grams = np.random.default_rng(1).integers(-(2**62), 2**62, (13, 4))
    assert (c.unpacked(c.packed(grams), 4) == grams).all()
    assert c.unpacked(c.packed(grams[:0]), 4).shape == (0, 4)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(c, "BLOCK", 20)
    text = b"one two. three four five six seven eight nine ten. eleven. twelve" * 5
    parts = list(c.blocks(text))
    assert len(parts) > 4 and b"".join(parts) == text and all(p.startswith(b".") for p in parts[1:])


def test_very_long_text(documents):
    rows = [(1, "alpha beta gamma. " * 300_000, "en")]  # over one block and one shard
    frame = c.collocations(documents(rows), shard_words=1 << 18)
    assert got(frame) == [("en", 1, "alpha beta gamma", 300_000, 300_000, 300_000, 900_000, 1_000_000)]


def test_query_equals_sql(spark):
    assert agree(spark, "op13_collocations", "/root/testdata/sf0.001")
