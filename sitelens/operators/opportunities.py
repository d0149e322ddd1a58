"""Opportunities: rules over findings and artifacts, with a specificity gate.

Rules are literal expressions over the site row, so "all conditions of a rule
hold" needs neither a cross join nor a shuffle: every site tests every rule in
place. A placeholder without a value makes the text NULL, and a NULL text drops
the opportunity.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens import fixed
from sitelens.functions.columns import as_json, built_once
from sitelens.operators.checks import (
    LIST_EVIDENCE,
)
from sitelens.rules import OPPORTUNITY_RULES

PLACEHOLDER = re.compile(r"\$\{(\w+)\}|\$(\w+)")
ARTIFACT = "struct<analyzer:string,key:string,value:string,truthy:boolean,scalar:boolean>"


# --- artifacts -----------------------------------------------------------------------
def _artifact(analyzer: str, key: str, value, truthy: Column, scalar: bool, when=None) -> Column:
    entry = F.struct(
        F.lit(analyzer).alias("analyzer"), F.lit(key).alias("key"),
        (value if isinstance(value, Column) else F.lit(value)).cast("string").alias("value"),
        F.coalesce(truthy, F.lit(False)).alias("truthy"), F.lit(scalar).alias("scalar"),
    ).cast(ARTIFACT)
    return entry if when is None else F.when(when, entry)


@built_once
def artifact_array(analyzers: tuple) -> Column:
    """What each analyzer publishes. An entry that is missing was not published."""
    looked, home = F.col("dns").isNotNull(), F.col("home_ok")
    seen, https = F.col("page_count") > 0, F.col("is_https")
    spf, dmarc, policy = F.col("spf"), F.col("dns.dmarc"), F.col("policy")
    tls, cms = F.col("tls"), F.col("cms")
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    certificate = as_json(F.struct(
        F.col("tls.issuer"), F.col("tls.subject"), F.col("until").alias("not_after"),
        F.col("days_left").alias("days_remaining"), F.col("tls.protocol")))
    headers = as_json(F.map_filter(
        F.col("home.headers"), lambda k, _: k.isin(*fixed.SECURITY_HEADERS)))
    timings = as_json(F.struct(
        F.col("timings.ttfb_ms"), F.col("timings.total_ms"),
        F.col("home.response_time_ms").alias("home_response_ms")))
    cdn = home & F.col("cdn").isNotNull()
    published = {
        "ssl": [_artifact("ssl", "certificate", F.when(https & tls.isNotNull(), certificate),
                          https & tls.isNotNull(), False)],
        "dns": [
            _artifact("dns", "spf", spf, filled(spf), True),
            _artifact("dns", "dmarc", dmarc, filled(dmarc), True),
            _artifact("dns", "mx", as_json(F.col("dns.mx")), F.size("dns.mx") > 0, False),
            _artifact("dns", "dmarc_policy", policy, policy.isNotNull(), True, looked),
            _artifact("dns", "lookup_failed", as_json(F.col("dns.lookup_failed")),
                      F.size("dns.lookup_failed") > 0, False, looked),
        ],
        "headers": [
            _artifact("headers", "security_headers", F.when(home, headers), home, False),
            _artifact("headers", "missing_headers", F.when(home, as_json(F.col("missing"))),
                      home & (F.size("missing") > 0), False),
        ],
        "performance": [
            _artifact("performance", "timings", F.when(home, timings), home, False),
            _artifact("performance", "has_cdn", cdn, cdn, True),
        ],
        "technologies": [
            _artifact("technologies", "technologies", F.size("technologies"),
                      F.size("technologies") > 0, False),
            *[_artifact("technologies", f, F.col(f), F.col(f), True, seen)
              for f in ("has_analytics", "has_cdn", "has_waf")],
        ],
        "cms": [_artifact("cms", "cms", F.col("cms.tech_id"), cms.isNotNull(), False)],
        "contacts": [
            _artifact("contacts", "contacts", F.col("n_contacts"), F.col("n_contacts") > 0, False),
            _artifact("contacts", "primary_email", F.col("primary_email"),
                      F.col("primary_email").isNotNull(), True),
            _artifact("contacts", "primary_phone", F.col("primary_phone"),
                      F.col("primary_phone").isNotNull(), True),
            _artifact("contacts", "contact_count", F.col("n_contacts"),
                      F.col("n_contacts") > 0, True),
        ],
    }
    entries = [a for name in analyzers if name in published for a in published[name]]
    return F.array_compact(F.array(*entries))


def explode_artifacts(frame: DataFrame) -> DataFrame:
    return frame.select("site", F.explode_outer("artifacts").alias("a")).select(
        "site", "a.*").where("key is not null")


# --- conditions --------------------------------------------------------------------------
def with_lookups(frame: DataFrame) -> DataFrame:
    """Adds maps check -> status / evidence and artifact name -> entry.

    Each is bounded by the number of checks or artifacts, not by the site.
    """
    name = lambda a: F.concat(a["analyzer"], F.lit("."), a["key"])
    return frame.withColumns({
        "status_of": F.map_from_entries(
            F.transform("findings", lambda f: F.struct(f["check_id"], f["status"]))),
        "evidence_of": F.map_from_entries(
            F.transform("findings", lambda f: F.struct(f["check_id"], f["evidence"]))),
        "artifact_of": F.map_from_entries(
            F.transform("artifacts", lambda a: F.struct(name(a), a))),
    })


def condition_holds(c) -> Column:
    """One condition; an artifact that was not published satisfies none."""
    if c.kind.startswith("finding_"):
        status = F.element_at("status_of", c.check_id)
        test = {
            "finding_failed": status.isin(*fixed.PROBLEM_STATUSES),
            "finding_passed": status == "pass",
            "finding_absent": status.isNull() | (status == "not_applicable"),
        }[c.kind]
    else:
        entry = F.element_at("artifact_of", f"{c.analyzer}.{c.key}")
        test = {
            "artifact_truthy": entry["truthy"],
            "artifact_falsy": ~entry["truthy"],
            "artifact_equals": entry["value"] == F.lit(c.value),
        }[c.kind]
    return F.coalesce(test, F.lit(False))


def rule_matches(rule) -> Column:
    return reduce(lambda a, b: a & b, map(condition_holds, rule.requires), F.lit(True))


def explode_conditions(frame: DataFrame, rules=OPPORTUNITY_RULES) -> DataFrame:
    """(site, rule_id, cond_no, kind, target, holds) for every rule condition."""
    rows = [
        F.struct(F.lit(r.id).alias("rule_id"), F.lit(n).alias("cond_no"),
                 F.lit(c.kind).alias("kind"),
                 F.lit(c.check_id or f"{c.analyzer}.{c.key}").alias("target"),
                 condition_holds(c).alias("holds"))
        for r in rules for n, c in enumerate(r.requires, start=1)
    ]
    return with_lookups(frame).select("site", F.explode_outer(F.array(*rows)).alias("c")).select(
        "site", "c.*")


# --- text ----------------------------------------------------------------------------------
def _artifact_names(rule) -> list[str]:
    return [f"{c.analyzer}.{c.key}" for c in rule.requires if c.analyzer and c.key]


def placeholder_value(rule, name: str) -> Column:
    """First source wins: the site itself, the listed checks, then artifacts."""
    sources: list[Column] = []
    if name == "domain":
        sources.append(F.col("site"))
    if name == "generated_at":
        sources.append(F.col("now"))
    if name not in LIST_EVIDENCE:
        sources += [F.element_at(F.element_at("evidence_of", c), name)
                    for c in rule.evidence_from]
    for artifact in _artifact_names(rule):
        if artifact.replace(".", "_") == name:
            entry = F.element_at("artifact_of", artifact)
            sources.append(F.when(entry["scalar"], entry["value"]))
    value = F.coalesce(*sources) if sources else F.lit(None).cast("string")
    return F.nullif(value, F.lit(""))


def render(rule, template: str) -> Column:
    """Template text, or NULL when any placeholder has no value."""
    pieces: list[Column] = []
    position = 0
    for match in PLACEHOLDER.finditer(template):
        if match.start() > position:
            pieces.append(F.lit(template[position:match.start()]))
        pieces.append(placeholder_value(rule, match.group(1) or match.group(2)))
        position = match.end()
    if position < len(template) or not pieces:
        pieces.append(F.lit(template[position:]))
    return F.trim(F.regexp_replace(F.concat(*pieces), r"\s+", " "))


def rule_evidence(rule) -> Column:
    """Domain, time, each listed check's evidence and the scalar artifacts used."""
    base = F.create_map(F.lit("domain"), F.col("site"),
                        F.lit("generated_at"), F.col("now"))
    none = F.create_map().cast("map<string,string>")
    maps = [base]
    for check in rule.evidence_from:
        found = F.coalesce(F.element_at("evidence_of", check), none)
        maps.append(F.transform_keys(found, _prefixed(check)))
    for name in dict.fromkeys(_artifact_names(rule)):
        entry = F.element_at("artifact_of", name)
        maps.append(F.when(entry["scalar"] & entry["value"].isNotNull(),
                           F.create_map(F.lit(name), entry["value"])).otherwise(none))
    return F.map_concat(*maps)


def _prefixed(check: str):
    return lambda key, _: F.concat(F.lit(f"{check}."), key)


def template_values(rule) -> Column:
    """The flat name -> value map a rule's texts are filled from."""
    entries = [F.array(F.struct(F.lit("domain").alias("key"), F.col("site").alias("value")),
                       F.struct(F.lit("generated_at").alias("key"),
                                F.col("now").alias("value")))]
    none = F.array().cast("array<struct<key:string,value:string>>")
    for check in rule.evidence_from:
        found = F.map_entries(F.element_at("evidence_of", check))
        scalars = F.filter(found, lambda e: ~e["key"].isin(*LIST_EVIDENCE))
        entries.append(F.coalesce(scalars, none))
    for name in dict.fromkeys(_artifact_names(rule)):
        entry = F.element_at("artifact_of", name)
        entries.append(F.when(
            entry["scalar"] & entry["value"].isNotNull(),
            F.array(F.struct(F.lit(name.replace(".", "_")).alias("key"),
                             entry["value"].alias("value")))).otherwise(none))
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(F.concat(*entries), empty, lambda acc, e: F.when(
        F.map_contains_key(acc, e["key"]), acc).otherwise(
        F.map_concat(acc, F.create_map(e["key"], e["value"]))))


# --- generation ------------------------------------------------------------------------------
@built_once
def _candidate(rule) -> Column:
    text = render(rule, rule.template)
    triggers = sorted(rule.evidence_from) or [rule.id]
    opportunity = F.struct(
        F.lit(rule.id).alias("rule_id"),
        F.coalesce(render(rule, rule.title), F.lit(rule.title)).alias("title"),
        F.lit(rule.category).alias("category"),
        F.lit(rule.urgency).alias("urgency"),
        F.lit(fixed.URGENCY_WEIGHT[rule.urgency]).alias("weight"),
        text.alias("description"),
        F.lit(rule.pitch).alias("pitch"),
        rule_evidence(rule).alias("evidence"),
        F.array(*map(F.lit, triggers)).alias("triggered_by"),
        F.array(*map(F.lit, rule.supersedes)).cast("array<string>").alias("supersedes"),
    )
    return F.when(rule_matches(rule) & text.isNotNull(), opportunity)


def with_opportunities(frame: DataFrame, rules=OPPORTUNITY_RULES,
                       supersede: bool = True) -> DataFrame:
    """Adds ``opportunities``, most urgent first, then by rule id."""
    ordered = sorted(rules, key=lambda r: (fixed.URGENCY_RANK[r.urgency], r.id))
    produced = with_lookups(frame).withColumn(
        "produced", F.array_compact(F.array(*map(_candidate, ordered))))
    beaten = F.flatten(F.transform("produced", lambda o: o["supersedes"]))
    kept = F.filter("produced", lambda o: ~F.array_contains(F.col("beaten"), o["rule_id"]))
    return produced.withColumn("beaten", beaten).withColumn(
        "opportunities", kept if supersede else F.col("produced")
    ).drop("beaten", "status_of", "evidence_of", "artifact_of")


@built_once
def summary_finding() -> Column:
    """OPP-01: how many opportunities, by urgency and category, and the top five."""
    from sitelens.operators.checks import evidence, finding

    def counts(field: str) -> Column:
        values = F.transform("opportunities", lambda o: o[field])
        keys = F.array_sort(F.array_distinct(values))
        return as_json(F.map_from_arrays(keys, F.transform(
            keys, lambda k: F.size(F.filter(values, lambda v: v == k)))))

    titles = F.transform("opportunities", lambda o: o["title"])
    return finding("OPP-01", "opportunities", "opportunities", "info", "info", evidence(
        count=F.size("opportunities"), by_urgency=counts("urgency"),
        by_category=counts("category"), top=as_json(titles)))


def explode_opportunities(frame: DataFrame, column: str = "opportunities") -> DataFrame:
    return frame.select("site", F.posexplode_outer(column).alias("position", "o")).select(
        "site", (F.col("position") + 1).alias("position"), "o.*"
    ).where("rule_id is not null").drop("weight", "supersedes")


def supersede(opportunities: DataFrame, rules=OPPORTUNITY_RULES) -> DataFrame:
    """The same merge over a stored opportunities table: a left anti self-join."""
    pairs = [(r.id, s) for r in rules for s in r.supersedes]
    if not pairs:
        return opportunities
    beaten = F.array(*[F.struct(F.lit(a).alias("by"), F.lit(b).alias("rule_id"))
                       for a, b in pairs])
    drop = opportunities.select("site", F.explode(F.filter(
        beaten, lambda p: p["by"] == F.col("rule_id"))).alias("p")).select("site", "p.rule_id")
    return opportunities.join(drop, ["site", "rule_id"], "left_anti")


# --- rule validation -----------------------------------------------------------------------------
def opportunity_rules_validate(rules: DataFrame, conditions: DataFrame) -> DataFrame:
    """Rejected rules with a reason; empty means the pack is usable."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    listed = lambda c, words: F.coalesce(F.col(c).isin(*words), F.lit(False))
    reason = (
        F.when(blank("rule_id"), "missing id")
        .when(~listed("category", fixed.OPPORTUNITY_CATEGORIES), "bad category")
        .when(~listed("urgency", fixed.URGENCY_RANK), "bad urgency")
        .when(blank("title"), "missing title")
        .when(blank("template"), "missing template")
        .when(blank("pitch"), "missing pitch")
    )
    fields = rules.select("rule_id", reason.alias("reason")).where("reason is not null")
    doubled = rules.groupBy("rule_id").count().where("count > 1").select(
        "rule_id", F.lit("duplicate id").alias("reason"))
    kinds = conditions.where(~listed("kind", fixed.CONDITION_KINDS)).select(
        "rule_id", F.lit("unknown condition kind").alias("reason")).distinct()
    return fields.unionByName(doubled).unionByName(kinds)


# --- external rewrites ------------------------------------------------------------------------------
def numbers_in(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(fixed.NUMBER_PATTERN), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit(""))))


def rewrite_guard(opportunities: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Attach outside wording where it is safe; the original text never changes.

    ``rewrites`` holds (site, rule_id, text). A text that is empty, names a
    number the original does not, or changes nothing is not attached.
    """
    joined = opportunities.join(rewrites, ["site", "rule_id"], "left")
    clean = F.trim("text")
    invented = F.array_except(numbers_in(F.col("text")), numbers_in(F.col("description")))
    verdict = (
        F.when(F.col("text").isNull(), "none")
        .when(clean == "", "empty")
        .when(F.size(invented) > 0, "invented numbers")
        .when(clean == F.trim("description"), "unchanged")
        .otherwise("accepted")
    )
    return joined.withColumn("verdict", verdict).withColumn(
        "description_ai", F.when(F.col("verdict") == "accepted", clean)).drop("text")
