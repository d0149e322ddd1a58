"""Pages -> facts -> one small row per site.

The page source is read once, in a narrow stage, and leaves that stage only as
short facts: "this signal first matched here", "this address was published
there". Every fact carries an order (``ord``) and a key, and one aggregation
keeps the first per (site, fact, key). That aggregation combines on the map
side, and its key is finer than the site, so a site that owns a third of all
pages is spread over many tasks and never gathered into one.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens import fixed
from sitelens.functions.columns import any_contains, built_once, found
from sitelens.operators import contacts as contact_ops
from sitelens.operators import rule_packs
from sitelens.operators.rule_table import RuleTable
from sitelens.rules import FINGERPRINTS

HOME_TYPE = (
    "struct<page_no:bigint,final_url:string,status:int,headers:map<string,string>,"
    "bytes:bigint,response_time_ms:int,has_html:boolean,has_viewport:boolean,generator:string>"
)
PARTS = ("page", "signals", "contacts")
# every match of the consent pattern holds one of these
CONSENT_NEEDLES = ("cookie", "gdpr", "onetrust", "termly", "iubenda", "klaro", "didomi")
# columns of the rollup, for sites whose pages are not asked for
ROLLUP = {
    "home": HOME_TYPE, "page_count": "bigint", "total_bytes": "bigint",
    "flags": "array<struct<key:string,n:bigint>>", "generator": "string",
    "admin_pages": "array<struct<key:string,url:string>>",
    "signals": "array<struct<key:string,text:string,version:string>>",
    "primary_email": "string", "primary_phone": "string", "n_emails": "bigint",
    "n_phones": "bigint", "n_socials": "bigint", "n_forms": "bigint", "n_addresses": "bigint",
}


def fact(name: str, key, first, pos, text=None, extra=None, category=None, rank=None, home=None):
    """One fact; the fields not given stay NULL."""
    as_col = lambda v, kind: (v if isinstance(v, Column) else F.lit(v)).cast(kind)
    return F.struct(
        F.lit(name).alias("fact"),
        as_col(key, "string").alias("key"),
        F.struct(
            as_col(first, "int").alias("first"),
            F.col("page_no").cast("bigint").alias("page_no"),
            as_col(pos, "int").alias("pos"),
        ).alias("ord"),
        F.struct(
            as_col(text, "string").alias("text"),
            as_col(extra, "string").alias("extra"),
            as_col(category, "string").alias("category"),
            F.col("final_url").alias("source_url"),
            as_col(rank, "int").alias("rank"),
            (home if home is not None else F.lit(None)).cast(HOME_TYPE).alias("home"),
        ).alias("body"),
    )


def _flag(name: str, test: Column) -> Column:
    return F.when(test, fact("flag", name, 0, 0, text=F.col("final_url")))


@built_once
def _page_facts() -> list[Column]:
    has_html = F.coalesce(F.col("html"), F.lit("")) != ""
    low = F.col("low")
    generator = F.when(low.contains("generator"), found(F.col("html"), fixed.GENERATOR_PATTERN, 1))
    viewport = F.when(
        low.contains("viewport"), F.col("html").rlike(fixed.VIEWPORT_PATTERN)
    ).otherwise(F.lit(False))
    home = F.struct(
        F.col("page_no").cast("bigint").alias("page_no"),
        F.col("final_url"),
        F.col("status").cast("int").alias("status"),
        F.transform_keys("headers", lambda k, _: F.lower(k)).alias("headers"),
        F.col("bytes").cast("bigint").alias("bytes"),
        F.col("response_time_ms").cast("int").alias("response_time_ms"),
        has_html.alias("has_html"),
        viewport.alias("has_viewport"),
        generator.alias("generator"),
    )
    not_home = F.when(F.col("page_type") == "home", 0).otherwise(1)
    facts = [
        fact("page", "", not_home, 0, home=home),
        _flag("html", has_html),
        _flag("mixed", low.contains("http://") & F.col("html").rlike(fixed.MIXED_CONTENT_PATTERN)),
        _flag("privacy", low.contains("privacy") & low.rlike(fixed.PRIVACY_PATTERN)),
        _flag("consent", any_contains(low, CONSENT_NEEDLES) & low.rlike(fixed.CONSENT_PATTERN)),
        F.when(generator.isNotNull(), fact("generator", "", 0, 0, text=generator)),
    ]
    for cms, path in fixed.ADMIN_PATHS.items():
        insecure = F.col("final_url").contains(path) & F.col("final_url").startswith("http://")
        facts.append(F.when(insecure, fact("admin", cms, 0, 0, text=F.col("final_url"))))
    return facts


def signal_key(tech_id: str, number: int) -> str:
    return f"{tech_id}#{number}"


def has_group(signal) -> bool:
    """Whether the rule names a capture group that its pattern really has."""
    return signal.version_group is not None and (
        signal.version_group <= re.compile(signal.pattern).groups)


def page_signals(fingerprints=FINGERPRINTS):
    """Signals that look at the pages themselves, with their keys."""
    for f in fingerprints:
        for number, signal in enumerate(f.signals, start=1):
            if signal.type in ("html", "script_src", "url"):
                yield signal_key(f.id, number), signal


@built_once
def _signal_facts(fingerprints) -> list[Column]:
    facts = []
    for key, signal in page_signals(fingerprints):
        source = F.col("final_url") if signal.type == "url" else F.col("html")
        pattern = f"(?iu){signal.pattern}"
        version = F.lit(None)
        if has_group(signal):
            version = F.nullif(F.trim(F.regexp_extract(source, pattern, signal.version_group)),
                               F.lit(""))
        text = source if signal.type == "url" else F.regexp_extract(source, pattern, 0)
        test = source.rlike(pattern)
        if signal.type != "url" and signal.needles:
            test = any_contains(F.col("low"), signal.needles) & test
        facts.append(F.when(test, fact("signal", key, 0, 0, text=text,
                                       extra=version)))
    return facts


@built_once
def _contact_facts(suffixes: tuple, placeholders: tuple, dial_plan: tuple) -> Column:
    every = contact_ops.page_contacts(suffixes, placeholders, dict(dial_plan))
    return F.transform(every, lambda c: fact(
        "contact", F.concat(c["kind"], F.lit(":"), c["normalized_value"]),
        c["rank"], c["pos"], text=c["value"], extra=c["kind"],
        category=c["category"], rank=c["rank"]))


def spread(pages: DataFrame) -> DataFrame:
    """The pages dealt to all tasks: a file may hold them in one row group, which only one task can read."""
    return pages.repartition("site", "page_no")


def page_facts(pages: DataFrame, fingerprints=FINGERPRINTS, parts=PARTS,
               suffixes=None, placeholders=fixed.PLACEHOLDER_DOMAINS,
               dial_plan=None) -> DataFrame:
    """Every fact of every page: (site, fact, key, ord, body, page_bytes)."""
    if isinstance(fingerprints, RuleTable):
        rest = page_facts(pages, fingerprints.core, parts, suffixes, placeholders, dial_plan)
        if "signals" not in parts:
            return rest
        return rest.unionByName(fingerprints.page_facts(pages, fact).select(
            "site", "f.fact", "f.key", "f.ord", "f.body", F.lit(None).cast(rest.schema["page_bytes"].dataType).alias("page_bytes")))
    base = pages.withColumn("low", F.lower(F.coalesce(F.col("html"), F.lit(""))))
    single: list[Column] = []
    if "page" in parts:
        single += _page_facts()
    lists = []
    if "signals" in parts and isinstance(fingerprints, rule_packs.RulePack):
        base = base.withColumn("candidates", fingerprints.page_candidates(F.col("html"), F.col("final_url")))
        lists.append(rule_packs.page_facts(fingerprints, fact))
    elif "signals" in parts:
        single += _signal_facts(tuple(fingerprints))
    if single:
        lists.append(F.array_compact(F.array(*single)))
    if "contacts" in parts:
        plan = tuple((dial_plan or fixed.DIAL_PLAN).items())
        lists.append(_contact_facts(None if suffixes is None else tuple(suffixes), tuple(placeholders), plan))
    every = lists[0] if len(lists) == 1 else F.concat(*lists)
    return base.select("site", "bytes", F.explode(every).alias("f")).select(
        "site", "f.fact", "f.key", "f.ord", "f.body",
        F.when(F.col("f.fact") == "page", F.col("bytes")).alias("page_bytes"))


def first_facts(facts: DataFrame) -> DataFrame:
    """The first fact per (site, fact, key), with how often it occurred."""
    return facts.groupBy("site", "fact", "key").agg(
        F.min_by("body", "ord").alias("body"),
        F.min("ord").alias("ord"),
        F.count(F.lit(1)).alias("n"),
        F.sum("page_bytes").alias("page_bytes"),
    )


def site_rollup(firsts: DataFrame) -> DataFrame:
    """First facts -> one row per site.

    The lists gathered here are bounded by the rule pack (signals, flags, admin
    paths), not by the size of a site; contacts enter as counts and minima only.
    """
    is_ = lambda name: F.col("fact") == name
    kind = lambda name: is_("contact") & (F.col("body.extra") == name)
    count = lambda test: F.count(F.when(test, 1))

    def best(name: str) -> Column:
        order = F.struct(F.col("body.rank"), F.col("key"))
        return F.min_by(F.when(kind(name), F.col("body.text")), F.when(kind(name), order))

    return firsts.groupBy("site").agg(
        F.first(F.when(is_("page"), F.col("body.home")), ignorenulls=True).alias("home"),
        F.sum(F.when(is_("page"), F.col("n"))).alias("page_count"),
        F.sum("page_bytes").alias("total_bytes"),
        F.collect_list(F.when(is_("flag"), F.struct("key", "n"))).alias("flags"),
        F.first(F.when(is_("generator"), F.col("body.text")), ignorenulls=True)
        .alias("generator"),
        F.collect_list(F.when(is_("admin"), F.struct("key", F.col("body.text").alias("url"))))
        .alias("admin_pages"),
        F.collect_list(F.when(is_("signal"), F.struct(
            "key", F.col("body.text").alias("text"), F.col("body.extra").alias("version"))))
        .alias("signals"),
        best("email").alias("primary_email"),
        best("phone").alias("primary_phone"),
        count(kind("email")).alias("n_emails"),
        count(kind("phone")).alias("n_phones"),
        count(kind("social")).alias("n_socials"),
        count(kind("form")).alias("n_forms"),
        count(kind("address")).alias("n_addresses"),
    )


def site_frame(sites: DataFrame, pages: DataFrame | None = None, *, firsts: DataFrame | None = None,
               **options) -> DataFrame:
    """Sites with what their pages say. A site without pages keeps NULLs."""
    if firsts is None and pages is None:
        joined = sites.select("*", *[F.lit(None).cast(t).alias(c) for c, t in ROLLUP.items()])
    else:
        if firsts is None:
            firsts = first_facts(page_facts(pages, **options))
        joined = sites.join(site_rollup(firsts), "site", "left")
    zero = ("n_emails", "n_phones", "n_socials", "n_forms", "n_addresses", "page_count",
            "total_bytes")
    flag_keys = F.transform("flags", lambda f: f["key"])
    has = lambda name: F.coalesce(F.array_contains(flag_keys, name), F.lit(False))
    return (
        joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})
        .withColumns({
            "is_https": F.coalesce(F.col("final_url"), F.col("requested_url"))
            .startswith("https://"),
            "home_ok": F.coalesce(F.col("home.status").between(200, 299), F.lit(False)),
            "any_html": has("html"),
            "has_mixed": has("mixed"),
            "has_privacy": has("privacy"),
            "has_consent": has("consent"),
            "n_contacts": reduce(lambda a, b: a + b, [F.col(c) for c in zero[:5]]),
        })
    )

