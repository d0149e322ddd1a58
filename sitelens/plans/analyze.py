"""The analysis plan: one lazy frame per site, long tables exploded from it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens import fixed
from sitelens.functions.columns import top_rows
from sitelens.operators import checks, contacts, facts, opportunities, scores, technologies
from sitelens.rules import FINGERPRINTS, LATEST_VERSIONS, OPPORTUNITY_RULES
from sitelens.session import written


class Analyzer(NamedTuple):
    name: str
    kind: str
    depends_on: tuple[str, ...]
    provides: tuple[str, ...]
    parts: tuple[str, ...]  # page facts it needs


ANALYZERS = {
    "technologies": Analyzer("Technologies", "analyzer", (), (
        "technologies", "by_category", "has_analytics", "has_cdn", "has_waf"), ("page", "signals")),
    "cms": Analyzer("CMS", "analyzer", ("technologies",), ("cms",), ("page", "signals")),
    "contacts": Analyzer("Contacts", "analyzer", (), (
        "contacts", "primary_email", "primary_phone", "contact_count"), ("page", "contacts")),
    "dns": Analyzer("DNS and e-mail authentication", "analyzer", (), (
        "spf", "dmarc", "mx", "dmarc_policy", "lookup_failed"), ()),
    "headers": Analyzer("Headers and cookies", "analyzer", (), (
        "security_headers", "missing_headers"), ("page",)),
    "performance": Analyzer("Performance and mobile", "analyzer", (), ("timings", "has_cdn"),
                            ("page",)),
    "ssl": Analyzer("TLS", "analyzer", (), ("certificate",), ()),
    "opportunities": Analyzer("Opportunities", "synthesizer", (
        "ssl", "dns", "headers", "technologies", "cms", "performance", "contacts"), (
        "opportunities", "opportunity_count"), ()),
}


def choose(only: str | None = None, disabled=()) -> list[str]:
    """Analyzers to run: without the disabled ones and whatever needs them,
    or a single one with all it depends on."""
    names = [n for n in ANALYZERS if n not in set(disabled)]
    names = [n for n in names if set(ANALYZERS[n].depends_on) <= set(names)]
    if only is None:
        return names
    if only not in names:
        raise ValueError(f"unknown or disabled analyzer: {only}")
    chain = {only}
    while True:
        more = {d for n in chain for d in ANALYZERS[n].depends_on} - chain
        if not more:
            return [n for n in names if n in chain]
        chain |= more


def analyze(sites: DataFrame, pages: DataFrame, *, only: str | None = None, disabled=(),
            fingerprints=FINGERPRINTS, latest=LATEST_VERSIONS, rules=OPPORTUNITY_RULES,
            suffixes=None, placeholders=fixed.PLACEHOLDER_DOMAINS,
            dial_plan=None, warn_days=fixed.CERT_EXPIRY_WARN_DAYS,
            slow_ttfb_ms=fixed.SLOW_TTFB_MS, check_ids=None, firsts=None,
            lists: bool = False) -> DataFrame:
    """One row per site with findings, technologies, artifacts, opportunities
    and scores.

    Pages are dealt to all tasks, then two shuffles: the first facts, then the sites. Everything after is computed
    in place, so unused columns cost nothing. ``firsts`` passes facts that were
    written before; ``lists`` adds the page lists to the evidence.
    """
    names = choose(only, disabled)
    wanted = {p for n in names for p in ANALYZERS[n].parts}
    parts = [p for p in facts.PARTS if p in wanted]
    if firsts is None and parts:
        firsts = facts.first_facts(facts.page_facts(
            facts.spread(pages), fingerprints, parts, suffixes, placeholders, dial_plan))
    frame = facts.site_frame(sites, firsts=firsts)
    if lists:
        frame = with_page_lists(frame, pages, firsts)
    if {"technologies", "cms"} & set(names):
        frame = technologies.with_technologies(frame, fingerprints, latest)
    checkers = tuple(n for n in names if n in checks.FAMILIES)
    frame = checks.prepare(frame).withColumns({
        "findings": checks.finding_array(checkers, check_ids, warn_days=warn_days,
                                         slow_ttfb_ms=slow_ttfb_ms, lists=lists),
        "artifacts": opportunities.artifact_array(checkers),
    })
    if "opportunities" not in names:
        return frame
    frame = opportunities.with_opportunities(frame, rules)
    frame = frame.withColumn("findings", F.concat(
        "findings", F.array(opportunities.summary_finding())))
    return scores.with_scores(frame)


def with_page_lists(frame: DataFrame, pages: DataFrame, firsts: DataFrame) -> DataFrame:
    """The first five pages with mixed content and the first five contact
    sources of each site, as JSON text."""
    mixed = pages.where(F.col("html").rlike(fixed.MIXED_CONTENT_PATTERN)).select(
        "site", "page_no", "final_url")
    five = top_rows(mixed, ["site"], [F.col("page_no")], 5)
    listed = five.groupBy("site").agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct("page_no", "final_url"))),
        lambda r: r["final_url"])).alias("mixed_pages"))
    sources = contacts.contacts(firsts).select("site", "source_url").distinct()
    named = top_rows(sources, ["site"], [F.col("source_url")], 5).groupBy("site").agg(
        F.to_json(F.array_sort(F.collect_list("source_url"))).alias("contact_sources"))
    return frame.join(listed, "site", "left").join(named, "site", "left")


def analyze_once(sites: DataFrame, pages: DataFrame, **options) -> dict[str, DataFrame]:
    """All result tables from a single read of the page sources.

    The first facts and the site frame are written to the shared folder, so the
    long tables are cheap projections of a stored table.
    """
    pack = options.get("fingerprints", FINGERPRINTS)
    firsts = written(facts.first_facts(facts.page_facts(
        facts.spread(pages), pack, facts.PARTS, options.get("suffixes"),
        options.get("placeholders", fixed.PLACEHOLDER_DOMAINS), options.get("dial_plan"))),
        "facts")
    frame = written(analyze(sites, pages, firsts=firsts, **options).drop(
        "hits", "signals", "tech_ids", "produced", "primary_cms"), "sites")
    return {
        "sites": frame,
        "findings": checks.explode_findings(frame),
        "technologies": technologies.explode_technologies(frame),
        "contacts": contacts.contacts(firsts),
        "artifacts": opportunities.explode_artifacts(frame),
        "opportunities": opportunities.explode_opportunities(frame),
        "scores": scores.score_table(frame),
    }
