"""Queries over the analysis: checks, technologies, contacts, opportunities, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens import fixed, rules
from sitelens.functions.columns import all_found, show_map, top_rows
from sitelens.operators import checks, contacts, facts, opportunities, scores, technologies
from sitelens.plans.analyze import analyze
from sitelens.plans.catalog import register
from sitelens.plans.oracle_base import clamp, q
from sitelens.plans.stored import stored, stored_sites
from sitelens.sources.captures import SUFFIXES, captured_pages, captured_sites


def frame(spark: SparkSession, sf_dir: str, scan: str = "all", **options) -> DataFrame:
    return analyze(captured_sites(spark, sf_dir, scan), captured_pages(spark, sf_dir, scan),
                   suffixes=SUFFIXES, **options)


def first_facts(spark, sf_dir, *parts, scan="all") -> DataFrame:
    return facts.first_facts(facts.page_facts(
        facts.spread(captured_pages(spark, sf_dir, scan)), parts=parts, suffixes=SUFFIXES))


def tech_frame(spark, sf_dir, scan="all") -> DataFrame:
    base = facts.site_frame(captured_sites(spark, sf_dir, scan),
                            firsts=first_facts(spark, sf_dir, "page", "signals", scan=scan))
    return technologies.with_technologies(base)


def contact_table(spark, sf_dir, scan="all") -> DataFrame:
    return contacts.contacts(first_facts(spark, sf_dir, "contacts", scan=scan))


def shown(findings: DataFrame) -> DataFrame:
    """Findings as plain columns; the wording of a reason is not a result."""
    return findings.select(
        "site", "check_id", "analyzer", "category", "status", "severity",
        F.when(F.col("status") == "not_applicable", "").otherwise(show_map(F.col("evidence")))
        .alias("evidence"))


# --- checks ----------------------------------------------------------------------------
def _check_ids() -> dict[str, str]:
    ids = {}
    for name in checks.FAMILIES:
        for check in ({"ssl": [f"TLS-0{n}" for n in range(1, 9)],
                       "dns": [f"DNS-0{n}" for n in range(1, 8)],
                       "headers": [f"HDR-0{n}" for n in range(1, 8)]
                       + ["CKY-01", "CKY-02", "CKY-03", "CNT-01", "CNT-02", "PRV-01", "PRV-02"],
                       "performance": [f"PERF-0{n}" for n in range(1, 5)],
                       "technologies": ["TECH-01", "TECH-OUTDATED"],
                       "cms": ["CMS-01", "CMS-02", "CMS-03"],
                       "contacts": ["CONTACT-01"]}[name]):
            ids[check] = name
    return ids


def _register_check(check_id: str, analyzer: str) -> None:
    @register(check_id, "SELECT site, check_id, analyzer, category, status, severity, evidence "
                        f"FROM f_all WHERE check_id LIKE '{check_id}%' ORDER BY site, check_id")
    def query(spark, sf_dir):
        table = checks.explode_findings(
            frame(spark, sf_dir, only=analyzer, check_ids=frozenset([check_id])))
        mine = table.where(F.col("analyzer") == analyzer)
        return shown(mine).orderBy("site", "check_id")


for _id, _name in _check_ids().items():
    _register_check(_id, _name)



def stored_findings(spark, sf_dir) -> DataFrame:
    """The stored findings of the checks, without the synthesizer's summary."""
    return stored(spark, sf_dir)["findings"].where("check_id <> 'OPP-01'")


ALL_FINDINGS = "SELECT site, check_id, analyzer, category, status, severity, evidence FROM f_all"


@register("union_findings", ALL_FINDINGS)
def union_findings(spark, sf_dir):
    table = checks.explode_findings(frame(spark, sf_dir, disabled=("opportunities",)))
    return shown(table)


@register("OPP-01", """
SELECT sr_all.site, 'OPP-01' AS check_id, 'info' AS status, count(rule_id) AS n,
  '{' || coalesce((SELECT string_agg('"' || urgency || '":' || k, ',' ORDER BY urgency) FROM (
     SELECT urgency, count(*) AS k FROM opp_all o WHERE o.site = sr_all.site GROUP BY urgency)), '')
  || '}' AS by_urgency,
  '{' || coalesce((SELECT string_agg('"' || category || '":' || k, ',' ORDER BY category) FROM (
     SELECT category, count(*) AS k FROM opp_all o WHERE o.site = sr_all.site
     GROUP BY category)), '') || '}' AS by_category
FROM sr_all LEFT JOIN opp_all USING (site) GROUP BY sr_all.site""")
def opp_01(spark, sf_dir):
    summary = frame(spark, sf_dir).select("site", opportunities.summary_finding().alias("f"))
    return summary.select(
        "site", "f.check_id", "f.status", F.col("f.evidence")["count"].cast("bigint").alias("n"),
        F.col("f.evidence")["by_urgency"].alias("by_urgency"),
        F.col("f.evidence")["by_category"].alias("by_category"))


@register("evidence_guard", "SELECT count(*) AS problems, "
                            "count(*) FILTER (evidence = '') AS without_evidence FROM f_all "
                            "WHERE status IN ('fail', 'warn')")
def evidence_guard(spark, sf_dir):
    table = stored_findings(spark, sf_dir)
    return table.where(checks.is_problem()).agg(
        F.count("*").alias("problems"),
        F.count_if(F.size("evidence") == 0).alias("without_evidence"))


@register("finding_lookup", """
SELECT site, max(status) FILTER (check_id = 'TLS-03') AS tls_03,
  max(status) FILTER (check_id = 'DNS-02') AS dns_02,
  max(status) FILTER (check_id = 'HDR-07') AS hdr_07,
  bool_or(check_id = 'CMS-02') AS has_cms_02 FROM f_all GROUP BY site""")
def finding_lookup(spark, sf_dir):
    table = stored_findings(spark, sf_dir)
    status = lambda c: F.max(F.when(F.col("check_id") == c, F.col("status")))
    return table.groupBy("site").agg(
        status("TLS-03").alias("tls_03"), status("DNS-02").alias("dns_02"),
        status("HDR-07").alias("hdr_07"),
        F.bool_or(F.col("check_id") == "CMS-02").alias("has_cms_02"))


@register("finding_sort", """
SELECT site, check_id, status, severity, row_number() OVER (PARTITION BY site ORDER BY
  status NOT IN ('fail', 'warn'), list_position(['critical', 'high', 'medium', 'low', 'info'],
  severity), check_id) AS position FROM f_all""")
def finding_sort(spark, sf_dir):
    rank = checks.severity_rank
    analysed = stored_sites(spark, sf_dir).withColumn("findings", F.filter(
        "findings", lambda f: f["check_id"] != "OPP-01"))
    # a site has at most one finding per check, so it sorts within its own row
    ordered = F.array_sort(F.transform("findings", lambda f: F.struct(
        (~f["status"].isin(*fixed.PROBLEM_STATUSES)).alias("calm"),
        rank(f["severity"]).alias("rank"), f["check_id"].alias("check_id"),
        f["status"].alias("status"), f["severity"].alias("severity"))))
    return analysed.select("site", F.posexplode_outer(ordered).alias("at", "f")).select(
        "site", "f.check_id", "f.status", "f.severity", (F.col("at") + 1).alias("position"))


@register("finding_groups", """
SELECT site, CASE WHEN status IN ('fail', 'warn') THEN 'problems' WHEN status = 'not_applicable'
  THEN 'unchecked' ELSE 'passing' END AS bucket, count(*) AS n,
  string_agg(check_id, ',' ORDER BY check_id) AS checks FROM f_all GROUP BY ALL""")
def finding_groups(spark, sf_dir):
    table = stored_findings(spark, sf_dir)
    bucket = (
        F.when(checks.is_problem(), "problems")
        .when(F.col("status") == "not_applicable", "unchecked").otherwise("passing")
    )
    return table.groupBy("site", bucket.alias("bucket")).agg(
        F.count("*").alias("n"),
        F.array_join(F.array_sort(F.collect_list("check_id")), ",").alias("checks"))


@register("finding_counts", """
SELECT site, """ + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in
                             fixed.SEVERITIES[:4]) + """
FROM f_all WHERE status IN ('fail', 'warn') GROUP BY site""")
def finding_counts(spark, sf_dir):
    table = stored_findings(spark, sf_dir)
    return table.where(checks.is_problem()).groupBy("site").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in fixed.SEVERITIES[:4]])


@register("export_counts", """
SELECT site, count(*) FILTER (severity = 'critical') AS critical_findings,
  count(*) FILTER (severity = 'high') AS high_findings FROM f_all WHERE status = 'fail'
GROUP BY site""")
def export_counts(spark, sf_dir):
    table = stored_findings(spark, sf_dir)
    return table.where(F.col("status") == "fail").groupBy("site").agg(
        F.count_if(F.col("severity") == "critical").alias("critical_findings"),
        F.count_if(F.col("severity") == "high").alias("high_findings"))


@register("certificate", """
SELECT site, CASE WHEN tls_seen THEN 'Test CA' END AS issuer, CASE WHEN tls_seen THEN site END
  AS subject, CASE WHEN tls_seen THEN until END AS not_after,
  CASE WHEN tls_seen THEN days_left END AS days_remaining,
  CASE WHEN tls_seen THEN protocol END AS protocol FROM sr_all""")
def certificate(spark, sf_dir):
    base = checks.prepare(facts.site_frame(captured_sites(spark, sf_dir)))
    return base.select("site", F.col("tls.issuer").alias("issuer"),
                       F.col("tls.subject").alias("subject"), F.col("until").alias("not_after"),
                       F.col("days_left").alias("days_remaining"),
                       F.col("tls.protocol").alias("protocol"))


_SIX = {
    "strict-transport-security": "h_strict_transport_security IS NULL",
    "content-security-policy": "h_content_security_policy IS NULL",
    "x-content-type-options": "h_x_content_type_options IS NULL",
    "referrer-policy": "h_referrer_policy IS NULL",
    "permissions-policy": "h_permissions_policy IS NULL",
    "x-frame-options": "h_x_frame_options IS NULL AND NOT framed",
}


@register("missing_headers", "SELECT site, concat_ws(',', " + ", ".join(
    f"CASE WHEN {t} THEN '{h}' END" for h, t in _SIX.items()) + ") AS missing FROM sr_all "
    "WHERE home_ok")
def missing_headers(spark, sf_dir):
    base = checks.prepare(facts.site_frame(
        captured_sites(spark, sf_dir), firsts=first_facts(spark, sf_dir, "page")))
    return base.where("home_ok").select("site", F.array_join("missing", ",").alias("missing"))


@register("security_headers", "SELECT site, " + ", ".join(
    f"h_{h.replace('-', '_')} AS {h.replace('-', '_')}" for h in fixed.SECURITY_HEADERS)
    + " FROM sr_all WHERE home_ok")
def security_headers(spark, sf_dir):
    base = facts.site_frame(captured_sites(spark, sf_dir),
                            firsts=first_facts(spark, sf_dir, "page"))
    return base.where("home_ok").select("site", *[
        F.element_at("home.headers", h).alias(h.replace("-", "_"))
        for h in fixed.SECURITY_HEADERS])


# --- technologies ------------------------------------------------------------------------------
@register("tech_match", "SELECT site, tech_id, signal_no, type, text FROM hits_all")
def tech_match(spark, sf_dir):
    return tech_frame(spark, sf_dir).select("site", F.explode_outer("hits").alias("h")).select(
        "site", "h.tech_id", "h.signal_no", "h.type", "h.text").where("tech_id is not null")


def _techs(spark, sf_dir):
    return technologies.explode_technologies(tech_frame(spark, sf_dir))


@register("tech_version", "SELECT site, tech_id, version FROM tech_all")
def tech_version(spark, sf_dir):
    return _techs(spark, sf_dir).select("site", "tech_id", "version")


@register("tech_confidence", "SELECT site, tech_id, confidence FROM tech_all")
def tech_confidence(spark, sf_dir):
    return _techs(spark, sf_dir).select("site", "tech_id", "confidence")


@register("tech_evidence", "SELECT site, tech_id, string_agg(type || '=' || text, '|' "
                           "ORDER BY type) AS evidence FROM tx_all GROUP BY ALL")
def tech_evidence(spark, sf_dir):
    return _techs(spark, sf_dir).select("site", "tech_id",
                                        show_map(F.col("evidence")).alias("evidence"))


@register("tech_outdated", "SELECT site, tech_id, version, latest, is_outdated, versions_behind "
                           "FROM tech_all")
def tech_outdated(spark, sf_dir):
    return _techs(spark, sf_dir).select("site", "tech_id", "version", "latest", "is_outdated",
                                        "versions_behind")


@register("tech_order", "SELECT site, tech_id, category, row_number() OVER (PARTITION BY site "
                        "ORDER BY category, tech_id) AS position FROM tech_all")
def tech_order(spark, sf_dir):
    return tech_frame(spark, sf_dir).select(
        "site", F.posexplode_outer("technologies").alias("at", "t")).select(
        "site", "t.tech_id", "t.category", (F.col("at") + 1).alias("position")
    ).where("tech_id is not null")


@register("by_category", "SELECT site, category, string_agg(name, ',' ORDER BY tech_id) AS names "
                         "FROM tech_all GROUP BY ALL")
def by_category(spark, sf_dir):
    return technologies.technologies_by_category(_techs(spark, sf_dir)).select(
        "site", "category", F.array_join("names", ",").alias("names"))


@register("tech_flags", "SELECT site, has_analytics, has_cdn, has_waf FROM st_all")
def tech_flags(spark, sf_dir):
    return tech_frame(spark, sf_dir).select("site", "has_analytics", "has_cdn", "has_waf")


@register("cms_primary", "SELECT site, cms_id AS tech_id, cms_name AS name, cms_confidence AS "
                         "confidence FROM st_all WHERE cms_id IS NOT NULL")
def cms_primary(spark, sf_dir):
    return tech_frame(spark, sf_dir).select(
        "site", "cms.tech_id", "cms.name", "cms.confidence").where("tech_id is not null")


@register("fingerprints_by_category", """
SELECT category, tech_id, count(DISTINCT site) AS sites FROM (SELECT DISTINCT category, tech_id
FROM rules) LEFT JOIN (SELECT site, tech_id FROM tech_all) USING (tech_id) GROUP BY ALL""")
def fingerprints_by_category(spark, sf_dir):
    known = rules.signals_table(spark).select("category", "tech_id").distinct()
    used = _techs(spark, sf_dir).groupBy("tech_id").agg(F.count("*").alias("sites"))
    return known.join(used, "tech_id", "left").select(
        "category", "tech_id", F.coalesce("sites", F.lit(0)).alias("sites"))


_RULE_ROWS = """
SELECT 'tech' || CAST(p_partkey % 1500 AS VARCHAR) AS tech_id, p_name AS name,
  CASE WHEN p_partkey % 23 = 0 THEN 'gadget' ELSE 'cms' END AS category, 1 AS signal_no,
  CASE p_partkey % 7 WHEN 0 THEN 'header' WHEN 1 THEN 'cookie' WHEN 2 THEN 'smell'
    ELSE 'html' END AS type,
  CASE WHEN p_partkey % 3 <> 0 THEN 'server' END AS signal_name,
  CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'a([0-9]+)b' END AS pattern,
  CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey % 3 AS INT) END AS version_group,
  CASE WHEN p_partkey % 13 = 0 THEN 'sure' ELSE 'likely' END AS confidence FROM part"""


@register("rules_validate", """
SELECT tech_id, signal_no, reason FROM (SELECT tech_id, signal_no, CASE
  WHEN category <> 'cms' THEN 'unknown category' WHEN type = 'smell' THEN 'unknown signal type'
  WHEN pattern = '' THEN 'missing pattern'
  WHEN type IN ('header', 'cookie') AND signal_name IS NULL THEN 'signal requires a name'
  WHEN confidence = 'sure' THEN 'unknown confidence'
  WHEN version_group > 1 THEN 'no such group' END AS reason FROM rulerows)
WHERE reason IS NOT NULL
UNION ALL SELECT tech_id, signal_no, 'duplicate id' FROM rulerows GROUP BY ALL
HAVING count(*) > 1""", {"rulerows": _RULE_ROWS})
def rules_validate(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("sitelens_part")
    rows = spark.sql(_RULE_ROWS.replace("AS VARCHAR", "AS STRING").replace(
        "FROM part", "FROM sitelens_part"))
    return technologies.rules_validate(rows)[1]


# --- contacts -------------------------------------------------------------------------------------
@register("email_extract", "SELECT site, page_no, a AS address, count(*) AS n FROM mail1_all "
                           "GROUP BY ALL")
def email_extract(spark, sf_dir):
    found = captured_pages(spark, sf_dir).select(
        "site", "page_no", F.explode(contacts.email_candidates(F.col("html"))).alias("address"))
    return found.groupBy("site", "page_no", "address").agg(F.count("*").alias("n"))


def _owned(spark, sf_dir):
    found = captured_pages(spark, sf_dir).select(
        "site", "page_no", F.explode(F.array_distinct(
            contacts.email_candidates(F.col("html")))).alias("address"))
    return found.withColumn("owner", contacts.email_owner(F.col("address"), SUFFIXES))


@register("email_filter", "SELECT DISTINCT site, page_no, a AS address, business FROM mailok_all")
def email_filter(spark, sf_dir):
    return _owned(spark, sf_dir).select("site", "page_no", "address", contacts.is_business_email(
        F.col("address"), F.col("owner")).alias("business"))


@register("email_own_domain", "SELECT DISTINCT site, page_no, a AS address, owner, own "
                              "FROM mailok_all")
def email_own_domain(spark, sf_dir):
    return _owned(spark, sf_dir).select(
        "site", "page_no", "address", "owner",
        contacts.belongs_to(F.col("owner"), F.col("site")).alias("own"))


@register("email_role", "SELECT category, rank, count(*) AS n FROM con_all WHERE kind = 'email' "
                        "GROUP BY ALL")
def email_role(spark, sf_dir):
    return contact_table(spark, sf_dir).where("kind = 'email'").groupBy("category", "rank").agg(
        F.count("*").alias("n"))


@register("phone_extract", "SELECT DISTINCT site, page_no, num AS phone FROM phonerow_all "
                           "WHERE num IS NOT NULL")
def phone_extract(spark, sf_dir):
    numbers = F.transform(contacts.phone_candidates(F.col("html")),
                          lambda n: contacts.normalize_phone(n))
    return captured_pages(spark, sf_dir).select("site", "page_no", F.explode(
        F.array_distinct(F.array_compact(numbers))).alias("phone"))


@register("social_extract", "SELECT site, category, normalized_value, value, source_url "
                            "FROM con_all WHERE kind = 'social'")
def social_extract(spark, sf_dir):
    return contact_table(spark, sf_dir).where("kind = 'social'").select(
        "site", "category", "normalized_value", "value", "source_url")


@register("form_detect", "SELECT site, page_no, regexp_extract(final_url, '^(https?://[^/?#]*)', "
                         "1) || '/send' AS target FROM pg_all "
                         "WHERE html LIKE '%<form action=\"/send\">%'")
def form_detect(spark, sf_dir):
    return captured_pages(spark, sf_dir).select(
        "site", "page_no", contacts.contact_form(F.col("html"), F.col("final_url"))
        .alias("target")).where("target is not null")


@register("address_extract", "SELECT site, page_no, norm, rank FROM craw_all "
                             "WHERE kind = 'address'")
def address_extract(spark, sf_dir):
    return captured_pages(spark, sf_dir).select(
        "site", "page_no", contacts.postal_address(F.col("html")).alias("a")
    ).where("a is not null").select("site", "page_no", F.lower("a.text").alias("norm"), "a.rank")


@register("contact_dedupe", "SELECT site, kind, category, value, normalized_value, source_url, "
                            "rank FROM con_all")
def contact_dedupe(spark, sf_dir):
    return contact_table(spark, sf_dir)


@register("contact_primary", "SELECT site, primary_email, primary_phone, n_contacts AS "
                             "contact_count FROM sc_all")
def contact_primary(spark, sf_dir):
    base = facts.site_frame(captured_sites(spark, sf_dir),
                            firsts=first_facts(spark, sf_dir, "contacts"))
    return base.select("site", "primary_email", "primary_phone",
                       F.col("n_contacts").alias("contact_count"))


# text tables carry contacts too: whole texts of the documents
@register("text_contacts", f"""
SELECT doc_id, 'email' AS kind, lower(trim(unnest(regexp_extract_all(text,
  {q(fixed.EMAIL_PATTERN)})), '.,;:')) AS value FROM documents""")
def text_contacts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.lit("email").alias("kind"), F.explode(F.transform(
        all_found(F.col("text"), fixed.EMAIL_SCAN_PATTERN),
        lambda a: F.lower(F.btrim(a, F.lit(".,;:"))))).alias("value"))


# --- opportunities ---------------------------------------------------------------------------------
def _analysed(spark, sf_dir):
    return frame(spark, sf_dir, disabled=("opportunities",))


_CONDITIONS = [
    (r.id, n, c) for r in rules.OPPORTUNITY_RULES for n, c in enumerate(r.requires, start=1)]


def _conditions_sql(kinds: str) -> str:
    rows = []
    for rule_id, n, c in _CONDITIONS:
        if not c.kind.startswith(kinds):
            continue
        if c.check_id:
            test = (f"EXISTS (SELECT 1 FROM f_all WHERE f_all.site = s.site AND check_id = "
                    f"'{c.check_id}' AND status IN ('fail', 'warn'))")
            target = c.check_id
        else:
            test = "coalesce(%shas_analytics, false)" % (
                "" if c.kind == "artifact_truthy" else "NOT ")
            target = f"{c.analyzer}.{c.key}"
        rows.append(f"SELECT site, '{rule_id}' AS rule_id, {n} AS cond_no, '{c.kind}' AS kind, "
                    f"'{target}' AS target, {test} AS holds FROM st_all s")
    return " UNION ALL ".join(rows)


@register("cond_finding", _conditions_sql("finding"))
def cond_finding(spark, sf_dir):
    return opportunities.explode_conditions(_analysed(spark, sf_dir)).where(
        F.col("kind").startswith("finding"))


@register("cond_artifact", _conditions_sql("artifact"))
def cond_artifact(spark, sf_dir):
    return opportunities.explode_conditions(_analysed(spark, sf_dir)).where(
        F.col("kind").startswith("artifact"))


@register("opp_match", "SELECT site, rule_id, count(*) AS conditions FROM ("
          + _conditions_sql("") + ") GROUP BY ALL HAVING bool_and(holds)")
def opp_match(spark, sf_dir):
    table = opportunities.explode_conditions(_analysed(spark, sf_dir))
    return table.groupBy("site", "rule_id").agg(
        F.count("*").alias("conditions"), F.bool_and("holds").alias("all_hold")
    ).where("all_hold").drop("all_hold")


def _opps(spark, sf_dir, **options):
    return opportunities.explode_opportunities(frame(spark, sf_dir, **options))


_EVIDENCE = " UNION ALL ".join(
    f"SELECT o.site, o.rule_id, concat_ws('|', 'domain=' || o.site, "
    f"'generated_at=2026-07-30T12:00:00Z'" + "".join(
        f", (SELECT nullif(regexp_replace(regexp_replace(evidence, '(^|\\|)', '\\1{c}.', 'g'), "
        f"'^{c}\\.$', ''), '') FROM f_all f WHERE f.site = o.site AND check_id = '{c}' AND "
        f"status <> 'not_applicable')" for c in sorted(r.evidence_from))
    + ("" if not any(c.key for c in r.requires) else
       ", 'technologies.has_analytics=' || (SELECT has_analytics::VARCHAR FROM st_all s "
       "WHERE s.site = o.site)")
    + f") AS evidence FROM opp_all o WHERE rule_id = '{r.id}'" for r in rules.OPPORTUNITY_RULES)


@register("opp_evidence", "SELECT site, rule_id, array_to_string(list_sort(string_split(evidence, "
                          "'|')), '|') AS evidence FROM (" + _EVIDENCE + ")")
def opp_evidence(spark, sf_dir):
    # keys carry their check id; records that were not evaluated only carry wording
    def real(found):
        return F.map_filter(found, lambda k, _: ~k.endswith(".reason"))

    return _opps(spark, sf_dir).select(
        "site", "rule_id", F.array_join(F.array_sort(F.transform(
            F.map_entries(real(F.col("evidence"))),
            lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|").alias("evidence"))


_TEMPLATED = ("ssl_renewal", "dmarc_not_enforcing", "outdated_cms", "performance_no_cdn")


@register("opp_template_values", """
SELECT site, 'ssl_renewal' AS rule_id, until AS v1, days_left::VARCHAR AS v2 FROM sr_all
  WHERE tls_seen AND days_left BETWEEN 0 AND 29
UNION ALL SELECT site, 'performance_no_cdn', home_page_url, first_byte::VARCHAR FROM sr_all
  WHERE home_ok AND first_byte > 1500 AND cdn IS NULL
UNION ALL SELECT site, 'outdated_cms', cms_name, cms_version FROM st_all WHERE cms_outdated""")
def opp_template_values(spark, sf_dir):
    named = {"ssl_renewal": ("not_after", "days_remaining"),
             "performance_no_cdn": ("url", "ttfb_ms"),
             "outdated_cms": ("cms", "detected_version")}
    ready = opportunities.with_lookups(_analysed(spark, sf_dir))
    rows = []
    for rule in rules.OPPORTUNITY_RULES:
        if rule.id in named:
            values = opportunities.template_values(rule)
            a, b = named[rule.id]
            rows.append(F.when(opportunities.rule_matches(rule), F.struct(
                F.lit(rule.id).alias("rule_id"), F.element_at(values, a).alias("v1"),
                F.element_at(values, b).alias("v2"))))
    return ready.select("site", F.explode_outer(F.array_compact(F.array(*rows))).alias("r")).select(
        "site", "r.*").where("rule_id is not null")


@register("opp_render_gate", "SELECT site, rule_id, title, description FROM opp0_all")
def opp_render_gate(spark, sf_dir):
    produced = opportunities.with_opportunities(_analysed(spark, sf_dir), supersede=False)
    return opportunities.explode_opportunities(produced).select(
        "site", "rule_id", "title", "description")


@register("opp_supersede", "SELECT site, rule_id FROM opp_all")
def opp_supersede(spark, sf_dir):
    produced = opportunities.with_opportunities(_analysed(spark, sf_dir), supersede=False)
    table = opportunities.explode_opportunities(produced)
    return opportunities.supersede(table).select("site", "rule_id")


@register("opp_sort", "SELECT site, rule_id, urgency, row_number() OVER (PARTITION BY site ORDER "
                      "BY urank, rule_id) AS position FROM opp_all")
def opp_sort(spark, sf_dir):
    return stored(spark, sf_dir)["opportunities"].select("site", "rule_id", "urgency", "position")


@register("opp_counts", "SELECT urgency, category, count(*) AS n, count(DISTINCT site) AS sites "
                        "FROM opp_all GROUP BY ALL")
def opp_counts(spark, sf_dir):
    # a site holds each rule once, so sites are counted after a first roll-up
    per_site = stored(spark, sf_dir)["opportunities"].groupBy("site", "urgency", "category").agg(
        F.count("*").alias("k"))
    return per_site.groupBy("urgency", "category").agg(
        F.sum("k").alias("n"), F.count("*").alias("sites"))


@register("opp_triggered_by", "SELECT site, rule_id, triggered_by FROM opp_all")
def opp_triggered_by(spark, sf_dir):
    return stored(spark, sf_dir)["opportunities"].select(
        "site", "rule_id", F.array_join("triggered_by", ", ").alias("triggered_by"))


_REWRITE = """CASE length(site) % 5
  WHEN 0 THEN 'Shorter: ' || description WHEN 1 THEN '  ' WHEN 2 THEN description || ' Saves 987%.'
  WHEN 3 THEN description ELSE NULL END"""


@register("rewrite_guard", f"""
SELECT site, rule_id, verdict, CASE WHEN verdict = 'accepted' THEN trim(text) END AS description_ai
FROM (SELECT site, rule_id, text, CASE WHEN text IS NULL THEN 'none' WHEN trim(text) = '' THEN
  'empty' WHEN text LIKE '%987%' THEN 'invented numbers' WHEN trim(text) = description THEN
  'unchanged' ELSE 'accepted' END AS verdict FROM (SELECT *, {_REWRITE} AS text FROM opp_all))""")
def rewrite_guard(spark, sf_dir):
    table = _opps(spark, sf_dir)
    rewrites = table.select("site", "rule_id", F.expr(_REWRITE).alias("text"))
    return opportunities.rewrite_guard(table, rewrites).select(
        "site", "rule_id", "verdict", "description_ai")


@register("opp_rules_validate", """
SELECT rule_id, reason FROM (SELECT rule_id, CASE WHEN category = 'magic' THEN 'bad category'
  WHEN urgency = 'soon' THEN 'bad urgency' WHEN title = '' THEN 'missing title'
  WHEN template = '' THEN 'missing template' END AS reason FROM opprows) WHERE reason IS NOT NULL
UNION ALL SELECT rule_id, 'duplicate id' FROM opprows GROUP BY rule_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT rule_id, 'unknown condition kind' FROM opprows WHERE kind = 'guess'""", {
    "opprows": """SELECT 'rule' || CAST(s_suppkey % 90 AS VARCHAR) AS rule_id,
  CASE WHEN s_suppkey % 7 = 0 THEN 'magic' ELSE 'security' END AS category,
  CASE WHEN s_suppkey % 5 = 0 THEN 'soon' ELSE 'high' END AS urgency,
  CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE s_name END AS title,
  CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE 'On ${domain}' END AS template, 'pitch' AS pitch,
  CASE WHEN s_suppkey % 4 = 0 THEN 'guess' ELSE 'finding_failed' END AS kind FROM supplier"""})
def opp_rules_validate(spark, sf_dir):
    key, name = F.col("s_suppkey"), F.col("s_name")
    every = lambda n, bad, good: F.when(key % n == 0, bad).otherwise(good)
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.concat(F.lit("rule"), (key % 90).cast("string")).alias("rule_id"),
        every(7, "magic", "security").alias("category"), every(5, "soon", "high").alias("urgency"),
        every(11, "", name).alias("title"), every(13, "", "On ${domain}").alias("template"),
        F.lit("pitch").alias("pitch"), every(4, "guess", "finding_failed").alias("kind"))
    return opportunities.opportunity_rules_validate(
        rows.drop("kind"), rows.select("rule_id", "kind"))


# --- scores ------------------------------------------------------------------------------------------
def _score_query(name: str, columns: dict[str, str], total: str, confidence: str) -> None:
    shown_parts = ", ".join(f"round_even({sql}, 1) AS {part}" for part, sql in columns.items())

    @register(f"score_{name}", f"SELECT site, {clamp(total)} AS total, {shown_parts}, "
                               f"round_even({confidence}, 2) AS confidence FROM sco_all")
    def query(spark, sf_dir):
        scored = frame(spark, sf_dir)
        return scored.select(
            "site", f"scores.{name}.total", f"scores.{name}.components.*",
            f"scores.{name}.confidence")


_score_query("security", {
    "tls": "sec_tls", "headers": "sec_headers", "email_auth": "sec_email_auth",
    "disclosure": "sec_disclosure", "critical_penalty": "sec_penalty"},
    "sec_tls + sec_headers + sec_email_auth + sec_disclosure + coalesce(sec_penalty, 0)",
    "security_confidence")
_score_query("website", {
    "performance": "web_performance", "mobile": "web_mobile", "delivery": "web_delivery",
    "secure_transport": "web_transport", "modernity": "web_modernity"},
    "web_performance + web_mobile + web_delivery + web_transport + web_modernity",
    "website_confidence")
_score_query("lead", {
    "contactability": "lead_contact", "business_signals": "lead_signals",
    "site_reachable": "lead_reachable", "engagement_surface": "lead_engagement"},
    "lead_contact + lead_signals + lead_reachable + lead_engagement", "lead_confidence")
_score_query("opportunity", {
    "opportunity_value": "opp_value", "urgency_bonus": "opp_urgency", "reachable": "opp_reach"},
    "(opp_value + opp_urgency + opp_reach) * CASE WHEN opp_reach = 0 THEN 0.5::DOUBLE "
    "ELSE 1.0::DOUBLE END", "1.0::DOUBLE")


@register("score_confidence", "SELECT site, round_even(security_confidence, 2) AS security, "
                              "round_even(website_confidence, 2) AS website FROM sco_all")
def score_confidence(spark, sf_dir):
    needed = frozenset(fixed.WEBSITE_CHECKS) | {
        c for _, _, members in fixed.SECURITY_GROUPS for c in members}
    base = frame(spark, sf_dir, disabled=("opportunities", "contacts"), check_ids=needed)
    scored = scores.with_scores(base, ("security", "website"))
    return scored.select("site", F.col("scores.security.confidence").alias("security"),
                         F.col("scores.website.confidence").alias("website"))


@register("score_clamp", "SELECT c_custkey, " + clamp("(c_acctbal / 100)::DOUBLE")
          + " AS clamped, " + clamp("(c_custkey / 2.0)::DOUBLE") + " AS halved FROM customer")
def score_clamp(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return customers.select(
        "c_custkey", scores.clamp(F.col("c_acctbal") / 100).alias("clamped"),
        scores.clamp(F.col("c_custkey") / F.lit(2.0)).alias("halved"))


@register("scores_all", "SELECT site, lead, website, security, opportunity FROM scores_all")
def scores_all(spark, sf_dir):
    return scores.score_table(frame(spark, sf_dir))


@register("score_band", """
SELECT site, CASE WHEN security >= 75 THEN 'good' WHEN security >= 50 THEN 'medium'
  WHEN security >= 25 THEN 'high' ELSE 'critical' END AS security_band,
  CASE WHEN opportunity >= 70 THEN 'critical' WHEN opportunity >= 45 THEN 'high'
  WHEN opportunity >= 20 THEN 'medium' ELSE 'good' END AS opportunity_band FROM scores_all""")
def score_band(spark, sf_dir):
    table = stored(spark, sf_dir)["scores"]
    return table.select("site", scores.health_band(F.col("security")).alias("security_band"),
                        scores.opportunity_band(F.col("opportunity")).alias("opportunity_band"))


@register("artifacts", """
SELECT site, 'technologies' AS analyzer, 'has_analytics' AS key, has_analytics::VARCHAR AS value
FROM st_all WHERE page_count > 0
UNION ALL SELECT site, 'dns', 'spf', CASE WHEN has_dns THEN spf END FROM sr_all
UNION ALL SELECT site, 'dns', 'dmarc_policy', policy FROM sr_all WHERE has_dns
UNION ALL SELECT site, 'performance', 'has_cdn', (home_ok AND cdn IS NOT NULL)::VARCHAR
FROM sr_all""")
def artifacts(spark, sf_dir):
    table = opportunities.explode_artifacts(_analysed(spark, sf_dir))
    wanted = ("technologies.has_analytics", "dns.spf", "dns.dmarc_policy", "performance.has_cdn")
    return table.where(F.concat("analyzer", F.lit("."), "key").isin(*wanted)).select(
        "site", "analyzer", "key", "value")


@register("worst_sites", "SELECT site, security, row_number() OVER (ORDER BY security, site) AS "
                         "place FROM scores_all QUALIFY place <= 20")
def worst_sites(spark, sf_dir):
    """The report of the twenty weakest sites (a top-k)."""
    table = scores.score_table(frame(spark, sf_dir)).select("site", "security")
    top = table.orderBy("security", "site").limit(20)
    return top_rows(top.withColumn("all", F.lit(1)), ["all"], [F.col("security"), F.col("site")],
                    20, "place").drop("all")

