"""Secrets: known forms, and strings whose sliding-window entropy is high for their class.

All work is done in the row of the text, so nothing is shuffled. Regular
expressions give matches without places; the places are running sums over the
lengths of the matches and of the gaps between them. Candidate strings of each
character class are rated by the Shannon entropy of every window: the sum of
``c * log2(c)`` over the counts in a window changes only by the sign that enters
and the one that leaves, so a step costs the width of the window and not its
alphabet. Strings that the allow list covers as a whole are not reported.

Defined results: a null text counts as an empty one without spans; rows are
answered one by one, so repeated rows and repeated or null ``doc_id`` stay;
equal starts are ordered by kind; other columns are not read; an empty table
gives none. A string may be reported under several kinds.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.arrays import let, running_sum

#: The known forms, in the order of their kinds. Each pattern finds the
#: leftmost matches; ``least`` is the length of group ``group`` below which one is dropped.
FORMS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # a run is one match, so its length can stand in the pattern
)


class CharClass(NamedTuple):
    kind: str
    pattern: str  # candidate strings
    window: int
    bits: float  # least entropy of some window


CLASSES = (
    CharClass("entropy_hex", r"(?<![0-9A-Fa-f])(?=[A-F]*[0-9])[0-9A-F]{20,}(?![0-9A-Fa-f])", 20, 2.9),
    CharClass("entropy_base64", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])"
              r"[A-Za-z0-9+/_-]{24,}", 24, 3.9),
    # one case with digits, and a letter that is no hexadecimal digit
    CharClass("entropy_lower", r"(?<![A-Za-z0-9])(?=[a-z]*[0-9])(?=[0-9a-f]*[g-z])[a-z0-9]{20,}(?![A-Za-z0-9])", 20, 3.4),
    CharClass("entropy_upper", r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[0-9A-F]*[G-Z])[A-Z0-9]{20,}(?![A-Za-z0-9])", 20, 3.4),
)
#: What makes a whole candidate no secret. A listed part counts where less than a window stands
#: on either side of it, so that a key with such a part in it, or beside it, is still rated. Runs
#: of letters count where no lower-case letter stands alone: so are names written, not random strings.
ALLOWED = (
    r"^.{0,19}(?:(?i:example|sample|dummy|placeholder|changeme|your[_-]?(?:key|token|secret))"
    r"|abcdefghij|0123456789|(.)\1{5,}).{0,19}$|bPxRfiCYEXAMPLEKEY$"
    r"|^(?=.*[A-Za-z]{16})(?=.*[a-z])(?!.*(?<![a-z])[a-z](?![a-z]))"
)


def places(text: Column, pattern: str) -> tuple[Column, Column]:
    """Start and length of each match, as two arrays."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.transform(found, lambda m: F.length(m).cast("bigint"))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("bigint"))
    # gap 0, match 0, gap 1, ...: a match starts after all before it
    starts = F.zip_with(running_sum(F.slice(gaps, F.lit(1), F.size(gaps) - 1)),
                        running_sum(lengths), lambda g, m: g + m)
    return F.zip_with(starts, lengths, lambda s, n: s - n), lengths


def spans(text: Column, rank: int, pattern: str, keep: Column) -> Column:
    """Spans (start, kind rank, end) of the matches whose flag in ``keep`` is set."""
    starts, lengths = places(text, pattern)
    every = F.zip_with(F.zip_with(starts, lengths, lambda s, n: F.struct(
        s.alias("start"), F.lit(rank).alias("kind"), (s + n).alias("end"))), keep,
        lambda span, ok: F.when(ok, span))
    return F.when(text.rlike(pattern), F.filter(every, lambda s: s.isNotNull()))


def windows_are_random(candidate: Column, of: CharClass) -> Column:
    """Whether some window of the class's width has at least its entropy."""
    width = of.window
    weight = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    times = lambda sign, among: F.size(F.filter(among, lambda x: x == sign))

    def least_sum(signs: Column) -> Column:
        first = F.slice(signs, 1, width)
        start = F.aggregate(F.array_distinct(first), F.lit(0.0), lambda s, c: s + weight(times(c, first)))

        def step(state: Column, at: Column) -> Column:
            between = F.slice(signs, at - width + 1, F.lit(width - 1))
            gone, come = times(signs[at - width - 1], between), times(signs[at - 1], between)
            total = state["s"] - (weight(gone + 1) - weight(gone)) + (weight(come + 1) - weight(come))
            return F.struct(total.alias("s"), F.least(state["best"], total).alias("best"))

        later = F.when(F.size(signs) > width, F.sequence(F.lit(width + 1), F.size(signs))).otherwise(
            F.array().cast("array<int>"))
        return let(start, lambda s: F.aggregate(later, F.struct(s.alias("s"), s.alias("best")), step)["best"])

    most = width * (math.log2(width) - of.bits)
    return let(F.split(candidate, ""), lambda signs: least_sum(signs) <= most)


def long_enough(groups: Column, least: int) -> Column:
    return F.transform(groups, lambda g: F.length(g) >= least)


def random_strings(candidates: Column, of: CharClass, allowed: str) -> Column:
    return F.transform(candidates, lambda c: F.when(c.rlike(allowed), False).otherwise(windows_are_random(c, of)))


def scan(docs: DataFrame, forms=FORMS, classes=CLASSES, allowed: str = ALLOWED) -> DataFrame:
    """doc_id and all spans of each text, ordered by start and kind."""
    text = F.col("text")
    kinds = [f[0] for f in forms] + [c.kind for c in classes]
    found = {}
    for rank, (kind, pattern, group, least) in enumerate(forms):
        groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        found[kind] = spans(text, rank, pattern, long_enough(groups, least))
    for rank, of in enumerate(classes, len(forms)):
        candidates = F.regexp_extract_all(text, F.lit(of.pattern), F.lit(0))
        found[of.kind] = spans(text, rank, of.pattern, random_strings(candidates, of, allowed))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    every = F.sort_array(F.concat(*[F.coalesce(found[k], none) for k in kinds]))
    names = F.array(*map(F.lit, kinds))
    return rows.select("doc_id", every.alias("spans")).select("doc_id", F.transform("spans", lambda s: F.struct(
        F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def digest(found: DataFrame, forms=FORMS) -> DataFrame:
    """Counts of the known forms, the digest of their spans, and all spans as text."""
    base = [f[0] for f in forms]
    write = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    known = F.filter("spans", lambda s: s["kind"].isin(*base))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(write(known), 256).alias("base_sha256"), write(F.col("spans")).alias("spans"))
