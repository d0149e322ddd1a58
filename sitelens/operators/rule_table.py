"""Technology rules of any number, kept as a table and met by joins.

A pack (``rule_packs``) goes to every task, so its length is bounded. Here the rules stay
rows. Each needle of a pattern, a literal that every match holds, becomes a hash. A page
is cut into all its substrings of the lengths that needles have; a bitmap of bounded size
says which of their hashes may be a needle's, and a join finds the rules. A page meets
these rules only, and the patterns run in the JVM against its text. So work grows with
the pages and with the rules, not with their product, where patterns hold literals that tell
them apart.

Rules that need no table stay in a pack, ``core``: those on headers, cookies and
generators, and page patterns without a needle, which must be run on every page anyway.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens import fixed
from sitelens.operators import rule_packs
from sitelens.operators.rule_packs import PAGE_TYPES, PackError, RulePack, bounded, folded, needles_of, stop_on
from sitelens.session import written

LONGEST_NEEDLE = 32  # of longer ones the beginning
LEAST_BITS, MOST_BITS = 15, 28  # a bitmap of 32 MB at most
BITMAP = 1 << 15  # bits of one of Spark's bitmaps
BASE, MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
FACT = "rule"


# --- hashes of substrings ------------------------------------------------------------------
@functools.lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i below n."""
    base, back = (np.full(n, b, np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))
    base[0] = back[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(back)


def substrings(text: str, lengths: list[int]) -> np.ndarray:
    """Hashes of all substrings of the given lengths; equal substrings have equal ones."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    up, down = powers(1 << max(n, 1).bit_length())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * up[:n], out=sums[1:])
    out = [(sums[k:] - sums[:n + 1 - k]) * down[:n + 1 - k] * np.uint64(2 * k + 1) for k in lengths if k <= n]
    h = np.concatenate(out) if out else np.zeros(0, np.uint64)
    h = (h ^ h >> np.uint64(32)) * np.uint64(MIX)
    return h ^ h >> np.uint64(29)


def needle_hashes(patterns: Column) -> Column:
    def of(needle: str) -> dict:
        return {"hash": int(substrings(needle, [len(needle)]).view(np.int64)[0]), "length": len(needle)}

    @F.pandas_udf("array<struct<hash:bigint,length:int>>")
    def run(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: [of(n) for n in sorted({n[:LONGEST_NEEDLE] for n in needles_of(p)})])

    return run(patterns)


def shifts(bits: int) -> list[int]:
    """A needle sets three bits of the bitmap, named by its hash from these places on: of strangers one in a thousand finds all three."""
    return [64 - bits, (64 - bits) // 2, 0]


def slots(hashed: Column, bits: int) -> Column:
    return F.array(*[F.shiftrightunsigned(hashed, s).bitwiseAND((1 << bits) - 1) for s in shifts(bits)])


# --- the table -------------------------------------------------------------------------------
class RuleTable:
    """Checked rules; pass it as ``fingerprints`` to ``facts.page_facts`` and ``technologies.hits_table``."""

    def __init__(self, rules: DataFrame, about: DataFrame) -> None:
        spark, has_needle = rules.sparkSession, F.col("type").isin(*PAGE_TYPES) & (F.size("needles") > 0)
        core = rules.where(~has_needle)
        self.core = RulePack(bounded(core.select("tech_id", "name", "category", "signal_no", "type", "signal_name", "pattern", "version_group",
                                                 "confidence"), "signals without a literal on pages, or on headers, cookies and generators"), {})
        self.rules = rules.where(has_needle)
        self.about = about
        needles = self.rules.select(F.explode("needles").alias("n"))
        self.lengths = sorted(r[0] for r in needles.select("n.length").distinct().collect())  # LONGEST_NEEDLE at most
        self.bits = min(MOST_BITS, max(LEAST_BITS, (needles.count() * 32).bit_length()))
        place = F.col("slot") + 1  # Spark's first bitmap begins with 1
        parts = needles.select(F.explode(slots(F.col("n.hash"), self.bits)).alias("slot")).groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")).collect()  # the bitmap's size at most
        bitmap = np.zeros((1 << self.bits) // 8, np.uint8)
        for part in parts:
            at = (part["bucket"] - 1) * BITMAP // 8
            bitmap[at:at + BITMAP // 8] = np.frombuffer(part["bitmap"], np.uint8)
        self.bitmap = spark.sparkContext.broadcast(bitmap)

    def candidates(self, *texts: Column) -> Column:
        """Hashes of substrings that may be needles."""
        bitmap, lengths, bits = self.bitmap, self.lengths, self.bits

        def met(text: str | None) -> np.ndarray:
            hashed = substrings(folded(text or ""), lengths)
            for shift in shifts(bits):
                place = (hashed >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)
                hashed = hashed[bitmap.value[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0]
            return hashed.view(np.int64)

        @F.pandas_udf("array<bigint>")
        def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in parts:
                yield pd.Series([np.unique(np.concatenate([met(t) for t in row])) for row in zip(*columns, strict=True)])

        return run(*texts)

    def page_facts(self, pages: DataFrame, make_fact: Callable) -> DataFrame:
        """(site, f) of every rule of the table that matches a page."""
        # what pages of one key may match is put together; the patterns decide for each page
        named = pages.select("site", "page_no", "final_url", "html", F.xxhash64("site", "page_no", "final_url").alias("page"))
        met = named.select("page", F.explode(self.candidates(F.col("html"), F.col("final_url"))).alias("hash")).distinct()
        rule = F.struct(F.col("key"), F.col("type"), F.col("pattern"), F.col("version_group").alias("grp")).alias("rule")
        by_needle = self.rules.withColumn("pattern", F.concat(F.lit("(?iu)"), "pattern")).select(
            F.explode("needles.hash").alias("hash"), rule)
        wanted = met.join(by_needle, "hash").groupBy("page").agg(F.collect_set("rule").alias("rules"))
        found = rule_packs.facts_of(F.col("rules"), functools.partial(make_fact, FACT))
        return named.join(wanted, "page").select("site", F.explode(found).alias("f"))


def first_error(rules: DataFrame) -> str | None:
    """What the engine that runs the patterns says of the first it cannot, or whose group does not exist."""
    pattern = F.concat(F.lit("(?iu)"), F.col("pattern"))
    # with an empty alternative every pattern matches, and a match is what makes the engine look at the group
    always = F.call_function("regexp_extract", F.lit(""), F.concat(pattern, F.lit("\n|")), F.coalesce("version_group", F.lit(0)))
    try:
        rules.agg(F.count_if(F.rlike(F.lit(""), pattern)), F.max(F.length(always))).collect()
    except Exception as error:
        said = next((line for line in str(error).splitlines() if "INVALID_PARAMETER_VALUE" in line or "PatternSyntaxException" in line), None)
        if said is None:
            raise
        return f"broken pattern: {said}"
    return None


def load_rule_table(signals: DataFrame, latest: DataFrame | None = None) -> RuleTable:
    """The rules of a signals table (``rules.SIGNAL_SCHEMA``) and a table (tech_id, latest), however many.

    One bad row stops it, as in ``load_pack``.
    """
    from sitelens.operators.technologies import rules_validate

    signals = written(signals, "signals")
    rejected = rules_validate(signals)[1].limit(11).collect()
    stop_on([f"{r['tech_id']}#{r['signal_no']}: {r['reason']}" for r in rejected], "technology rules")
    broken = first_error(signals)
    if broken:
        raise PackError(f"technology rules: {broken}")
    about = signals.groupBy("tech_id").agg(F.min(F.struct("name", "category")).alias("a"), F.max(F.struct("name", "category")).alias("b"))
    several = about.where(~F.col("a").eqNullSafe(F.col("b"))).limit(11).collect()
    stop_on([f"{r['tech_id']}: several names or categories" for r in several], "technology rules")
    about = about.select("tech_id", F.col("a.name").alias("name"), F.col("a.category").alias("category"))
    if latest is None:
        about = about.withColumn("latest", F.lit(None).cast("string"))
    else:
        about = about.join(latest.groupBy("tech_id").agg(F.max("latest").alias("latest")), "tech_id", "left")
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in fixed.CONFIDENCE_WEIGHT.items() for x in pair]), F.col("confidence"))
    on_pages = F.when(F.col("type").isin(*PAGE_TYPES), F.col("pattern")).otherwise("")
    rules = signals.select("*", F.concat_ws("#", "tech_id", F.col("signal_no").cast("string")).alias("key"), weight.alias("weight"),
                           needle_hashes(on_pages).alias("needles"))
    return RuleTable(written(rules, "rules"), written(about, "about"))
