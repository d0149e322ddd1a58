"""Queries over result tables: listing, export, reports, comparison, upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens import fixed
from sitelens.operators import checks, opportunities, results, scores
from sitelens.plans.catalog import register
from sitelens.plans.catalog_analysis import tech_frame
from sitelens.plans.oracle_base import col
from sitelens.plans.stored import stored_contacts, stored_sites
from sitelens.session import work_folder
from sitelens.sources.captures import captured_sites, spark_sql

BRAND = "upper(substr(site, 1, strpos(site, '.') - 1))"
BUSINESS = {
    "scan_id": "'scan-' || CAST(seed % 4 AS VARCHAR(20))",
    "name": f"CASE seed % 6 WHEN 0 THEN '=' WHEN 1 THEN '-' ELSE '' END || {BRAND} || ' Ltd'",
    "city": "CASE seed % 3 WHEN 1 THEN 'Leeds' WHEN 2 THEN 'York' END",
    "country_code": "CASE WHEN seed % 2 = 0 THEN 'GB' END",
}
BIZ = {"biz": "SELECT site, site AS domain, requested_url AS website_url, failed, "
              "CASE WHEN failed THEN 'failed' ELSE 'completed' END AS business_status, "
              + ", ".join(f"{sql} AS {name}" for name, sql in BUSINESS.items()) + " FROM sr_all"}


def businesses(spark, sf_dir):
    return captured_sites(spark, sf_dir).select(
        "site", F.col("site").alias("domain"), F.col("requested_url").alias("website_url"),
        F.when(F.col("status") == "failed", "failed").otherwise("completed")
        .alias("business_status"),
        *[spark_sql(sql).alias(name) for name, sql in BUSINESS.items()])


ROW = {**BIZ, "listing": """
SELECT biz.*, primary_email, n_contacts, lead, website, security, opportunity, n_tech, tech_names,
  n_opp, top_rule, critical_findings, high_findings
FROM biz JOIN sc_all USING (site) JOIN scores_all USING (site) JOIN st_all s USING (site)
LEFT JOIN (SELECT site, count(*) AS n_opp, first(rule_id ORDER BY urank, rule_id) AS top_rule
  FROM opp_all GROUP BY site) USING (site)
LEFT JOIN (SELECT site, count(*) FILTER (severity = 'critical') AS critical_findings,
  count(*) FILTER (severity = 'high') AS high_findings FROM f_all WHERE status IN ('fail', 'warn')
  GROUP BY site) USING (site)"""}


def listing(spark, sf_dir):
    return results.result_rows(stored_sites(spark, sf_dir), businesses(spark, sf_dir))


@register("result_row", """
SELECT site, scan_id, name, primary_email, n_contacts AS contact_count, opportunity AS
  opportunity_score, array_to_string(tech_names, ',') AS top_technologies,
  coalesce(n_opp, 0) AS opportunity_count, top_rule, coalesce(critical_findings, 0) AS
  critical_findings, coalesce(high_findings, 0) AS high_findings FROM (SELECT * REPLACE
  (coalesce(tech_names, []::VARCHAR[]) AS tech_names) FROM listing)""", ROW)
def result_row(spark, sf_dir):
    return listing(spark, sf_dir).select(
        "site", "scan_id", "name", "primary_email", "contact_count", "opportunity_score",
        F.array_join("top_technologies", ",").alias("top_technologies"), "opportunity_count",
        "top_rule", "critical_findings", "high_findings")


@register("result_list", """
SELECT site, name, opportunity AS opportunity_score, security AS security_score FROM listing
WHERE business_status = 'completed' AND primary_email IS NOT NULL AND opportunity >= 40
ORDER BY opportunity DESC NULLS LAST, site LIMIT 20 OFFSET 5""", ROW)
def result_list(spark, sf_dir):
    page = results.result_list(listing(spark, sf_dir), has_contact=True, min_opportunity=40,
                               limit=20, offset=5)
    return page.select("site", "name", "opportunity_score", "security_score")


@register("result_count", "SELECT scan_id, business_status, count(*) AS n FROM biz GROUP BY ALL",
          BIZ)
def result_count(spark, sf_dir):
    return businesses(spark, sf_dir).groupBy("scan_id", "business_status").agg(
        F.count("*").alias("n"))


@register("result_ok", "SELECT site, NOT failed AS ok, CASE WHEN failed THEN 'failed' ELSE "
                       "'completed' END AS label FROM sr_all")
def result_ok(spark, sf_dir):
    ok = results.result_ok(F.col("status"))
    return captured_sites(spark, sf_dir).select(
        "site", ok.alias("ok"), F.when(ok, "completed").otherwise("failed").alias("label"))


@register("rank_by_score", "SELECT site, security AS score FROM scores_all JOIN sr_all USING (site) "
                           "WHERE NOT failed ORDER BY score DESC, site")
def rank_by_score(spark, sf_dir):
    return results.rank_by_score(stored_sites(spark, sf_dir), "security")


# --- scans: the orders table stands in for the scan history ----------------------------------
def scans(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("scan_id"), F.col("o_orderdate").cast("timestamp")
        .alias("created_at"), F.col("o_orderstatus").alias("state"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("total"),
        F.col("o_custkey").alias("owner"))


SCANS_SQL = {"scans": "SELECT o_orderkey AS scan_id, o_orderdate AS created_at, o_orderstatus AS "
                      "state, CAST(floor(o_totalprice / 1000) AS INT) AS total, o_custkey AS owner "
                      "FROM orders"}


@register("scan_history", "SELECT scan_id, state, total FROM scans ORDER BY created_at DESC, scan_id "
                          "LIMIT 50 OFFSET 50", SCANS_SQL)
def scan_history(spark, sf_dir):
    return scans(spark, sf_dir).orderBy(F.col("created_at").desc(), "scan_id").offset(50).limit(
        50).select("scan_id", "state", "total")


@register("scan_count", "SELECT count(*) AS n FROM scans", SCANS_SQL)
def scan_count(spark, sf_dir):
    return scans(spark, sf_dir).agg(F.count("*").alias("n"))


@register("dashboard_stats", "SELECT count(*) AS scans, count(*) FILTER (state = 'O') AS running, "
                             "sum(total)::BIGINT AS analysed FROM scans", SCANS_SQL)
def dashboard_stats(spark, sf_dir):
    return scans(spark, sf_dir).agg(
        F.count("*").alias("scans"), F.count_if(F.col("state") == "O").alias("running"),
        F.sum("total").alias("analysed"))


EVENT_STATUS = """CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed'
  WHEN 'error' THEN 'failed' ELSE 'running' END"""


@register("scan_progress", f"""
SELECT *, CASE WHEN total > 0 THEN least(100, CAST(floor((completed + failed)::DOUBLE / total * 100)
  AS INT)) ELSE 0 END AS percent FROM (SELECT user_id AS scan_id, count(*) AS total,
  count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'failed') AS failed
  FROM (SELECT *, {EVENT_STATUS} AS s FROM events) GROUP BY user_id)""")
def scan_progress(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("scan_id"), spark_sql(EVENT_STATUS).alias("status"))
    return results.scan_progress(events, ["scan_id"])


@register("scan_elapsed", "SELECT user_id AS scan_id, greatest(0, CAST(floor((epoch_us(max(ts)) - "
                          "epoch_us(min(ts))) / 1000000.0) AS BIGINT)) AS elapsed_seconds "
                          "FROM events GROUP BY user_id")
def scan_elapsed(spark, sf_dir):
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = micros(F.max("ts")) - micros(F.min("ts"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(
        F.col("user_id").alias("scan_id")).agg(
        F.greatest(F.lit(0), F.floor(gap / 1000000)).cast("bigint").alias("elapsed_seconds"))


@register("dq_constraints", """
SELECT 'one finding per site and check' AS rule, (SELECT count(*) FROM (SELECT 1 FROM f_all
  GROUP BY site, check_id HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'one opportunity per site and rule', (SELECT count(*) FROM (SELECT 1 FROM opp_all
  GROUP BY site, rule_id HAVING count(*) > 1))
UNION ALL SELECT 'one score row per site', (SELECT count(*) FROM (SELECT 1 FROM scores_all
  GROUP BY site HAVING count(*) > 1))
UNION ALL SELECT 'scores within 0..100', (SELECT count(*) FROM scores_all WHERE NOT
  (lead BETWEEN 0 AND 100 AND website BETWEEN 0 AND 100 AND security BETWEEN 0 AND 100
   AND opportunity BETWEEN 0 AND 100))
UNION ALL SELECT 'one business per scan and domain', (SELECT count(*) FROM (SELECT 1 FROM orders
  GROUP BY o_custkey, o_orderdate HAVING count(*) > 1))
UNION ALL SELECT 'scan limit within 1..500', (SELECT count(*) FROM scans WHERE NOT
  total BETWEEN 1 AND 500)""", SCANS_SQL)
def dq_constraints(spark, sf_dir):
    analysed = stored_sites(spark, sf_dir)
    table = scores.score_table(analysed)
    bounded = F.lit(True)
    for name in scores.SCORES:
        bounded = bounded & F.col(name).between(0, 100)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return (
        results.violations(checks.explode_findings(analysed), ["site", "check_id"],
                           "one finding per site and check")
        .unionByName(results.violations(
            opportunities.explode_opportunities(analysed), ["site", "rule_id"],
            "one opportunity per site and rule"))
        .unionByName(results.violations(table, ["site"], "one score row per site"))
        .unionByName(results.range_violations(table, bounded, "scores within 0..100"))
        .unionByName(results.violations(orders, ["o_custkey", "o_orderdate"],
                                        "one business per scan and domain"))
        .unionByName(results.range_violations(
            scans(spark, sf_dir), F.col("total").between(1, 500), "scan limit within 1..500"))
    )


# --- export -------------------------------------------------------------------------------
@register("formula_guard", "SELECT site, CASE WHEN regexp_matches(name, '^[=+\\-@\\t\\r]') THEN "
                           "'''' || name ELSE name END AS cell FROM biz", BIZ)
def formula_guard(spark, sf_dir):
    return businesses(spark, sf_dir).select(
        "site", results.formula_guard(F.col("name")).alias("cell"))


@register("nul_scrub", "SELECT c_custkey, c_name || c_mktsegment AS text, c_name AS value "
                       "FROM customer")
def nul_scrub(spark, sf_dir):
    nul = F.lit("\x00")
    dirty = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey", F.concat("c_name", nul, "c_mktsegment").alias("text"),
        F.create_map(F.lit("k"), F.concat(nul, F.col("c_name"))).alias("m"))
    return results.scrub_all(dirty).select("c_custkey", "text",
                                           F.element_at("m", "k").alias("value"))


@register("yes_no_unknown", """
SELECT site, CASE WHEN has_dns AND spf IS NOT NULL THEN 'yes' WHEN has_dns AND lookup_failed = 'TXT'
  THEN 'unknown' ELSE 'no' END AS has_spf, CASE WHEN has_dns AND dmarc IS NOT NULL THEN 'yes'
  WHEN has_dns AND lookup_failed = 'DMARC' THEN 'unknown' ELSE 'no' END AS has_dmarc
FROM sr_all""")
def yes_no_unknown(spark, sf_dir):
    return captured_sites(spark, sf_dir).select(
        "site",
        results.yes_no_unknown(checks.dns_spf(F.col("dns.txt")), "TXT").alias("has_spf"),
        results.yes_no_unknown(F.col("dns.dmarc"), "DMARC").alias("has_dmarc"))


@register("first_per_category", """
SELECT site, first(name ORDER BY tech_id) FILTER (category = 'server') AS server,
  first(name ORDER BY tech_id) FILTER (category = 'cdn') AS cdn FROM sr_all LEFT JOIN tech_all
  USING (site) GROUP BY site""")
def first_per_category(spark, sf_dir):
    return tech_frame(spark, sf_dir).select(
        "site", results.first_of_category("server").alias("server"),
        results.first_of_category("cdn").alias("cdn"))


@register("joined_names", """
SELECT site, coalesce(string_agg(name, '; ' ORDER BY category, tech_id), '') AS technologies,
  coalesce(string_agg(name, '; ' ORDER BY tech_id) FILTER (category = 'analytics'), '')
  AS analytics FROM sr_all LEFT JOIN tech_all USING (site) GROUP BY site""")
def joined_names(spark, sf_dir):
    return tech_frame(spark, sf_dir).select(
        "site", results.names_of_category().alias("technologies"),
        results.names_of_category("analytics").alias("analytics"))


def _guard(sql: str) -> str:
    return (f"CASE WHEN regexp_matches(coalesce({sql}, ''), '^[=+\\-@\\t\\r]') THEN '''' || "
            f"({sql}) ELSE coalesce({sql}, '') END")


_TEXT = lambda sql: f"CAST({sql} AS VARCHAR)"
_CELLS = {
    "business_name": "name", "website": "website_url", "domain": "domain", "city": "city",
    "country": "country_code",
    "status": "CASE WHEN failed THEN 'timeout' ELSE 'completed' END",
    "primary_email": "primary_email", "all_emails": "mails", "phone": "primary_phone",
    "address": "address", "linkedin": "linkedin", "facebook": "facebook", "twitter": "twitter",
    "instagram": "instagram", "contact_form_url": "form", "cms": "cms_name",
    "cms_version": "cms_version",
    "cms_outdated": "CASE WHEN cms_outdated THEN 'yes' WHEN NOT cms_outdated THEN 'no' "
                    "ELSE 'unknown' END",
    "server": "server", "cdn": "cdn_name", "analytics": "analytics",
    "technologies": "array_to_string(tech_names, '; ')",
    "has_ssl": "CASE WHEN is_https THEN 'yes' ELSE 'no' END",
    "ssl_expires_at": "CASE WHEN tls_seen THEN until END",
    "ssl_days_remaining": "CASE WHEN tls_seen THEN CAST(nullif(days_left, 0) AS VARCHAR) END",
    "tls_version": "CASE WHEN tls_seen THEN protocol END",
    "has_hsts": f"CASE WHEN home_ok AND {col('strict-transport-security')} IS NOT NULL THEN 'yes' "
                "ELSE 'no' END",
    "has_csp": f"CASE WHEN home_ok AND {col('content-security-policy')} IS NOT NULL THEN 'yes' "
               "ELSE 'no' END",
    "has_spf": "CASE WHEN has_dns AND spf IS NOT NULL THEN 'yes' WHEN has_dns AND "
               "lookup_failed = 'TXT' THEN 'unknown' ELSE 'no' END",
    "has_dmarc": "CASE WHEN has_dns AND dmarc IS NOT NULL THEN 'yes' WHEN has_dns AND "
                 "lookup_failed = 'DMARC' THEN 'unknown' ELSE 'no' END",
    "dmarc_policy": "CASE WHEN has_dns THEN policy END",
    "missing_headers_count": _TEXT("CASE WHEN home_ok THEN " + " + ".join(
        f"({t})::INT" for t in (
            *[f"({col(h)} IS NULL)" for _, h, _ in fixed.HEADER_CHECKS],
            f"({col('x-frame-options')} IS NULL AND NOT framed)")) + " ELSE 0 END"),
    "critical_findings": _TEXT("coalesce(n_crit, 0)"), "high_findings": _TEXT("coalesce(n_high, 0)"),
    **{f"{s}_score": _TEXT(s) for s in scores.SCORES},
    "opportunity_count": _TEXT("coalesce(n_opp, 0)"), "top_opportunity": "top_title",
    "opportunities": "titles", "scanned_at": "'2026-07-30T12:00:00Z'",
}
EXPORT = {**BIZ, "wide": """
SELECT s.*, biz.* EXCLUDE (site, failed), c.* EXCLUDE (site), x.* EXCLUDE (site), t.* EXCLUDE (site),
  o.* EXCLUDE (site), f.* EXCLUDE (site), sc.primary_email, sc.primary_phone,
  lead, website, security, opportunity
FROM st_all s JOIN biz ON biz.site = s.site JOIN scores_all x0 ON x0.site = s.site
JOIN sc_all sc ON sc.site = s.site
LEFT JOIN (SELECT site, string_agg(value, '; ' ORDER BY rank, normalized_value) FILTER
    (kind = 'email') AS mails, first(value ORDER BY rank, normalized_value) FILTER
    (kind = 'address') AS address, first(value ORDER BY rank, normalized_value) FILTER
    (kind = 'form') AS form FROM con_all GROUP BY site) c ON c.site = s.site
LEFT JOIN (SELECT site, """ + ", ".join(
    f"first(value ORDER BY normalized_value) FILTER (kind = 'social' AND category = '{n}') AS {n}"
    for n in ("linkedin", "facebook", "twitter", "instagram")) + """ FROM con_all GROUP BY site) x
  ON x.site = s.site
LEFT JOIN (SELECT site, first(name ORDER BY tech_id) FILTER (category = 'server') AS server,
    first(name ORDER BY tech_id) FILTER (category = 'cdn') AS cdn_name,
    string_agg(name, '; ' ORDER BY tech_id) FILTER (category = 'analytics') AS analytics
    FROM tech_all GROUP BY site) t ON t.site = s.site
LEFT JOIN (SELECT site, count(*) AS n_opp, first(title ORDER BY urank, rule_id) AS top_title,
    string_agg(title, ' | ' ORDER BY urank, rule_id) AS titles FROM opp_all GROUP BY site) o
  ON o.site = s.site
LEFT JOIN (SELECT site, count(*) FILTER (severity = 'critical') AS n_crit,
    count(*) FILTER (severity = 'high') AS n_high FROM f_all WHERE status = 'fail' GROUP BY site) f
  ON f.site = s.site"""}


@register("sink_flat_export", "SELECT " + ", ".join(
    f"{_guard(_CELLS[c])} AS {c}" for c in fixed.EXPORT_COLUMNS) + " FROM wide", EXPORT)
def sink_flat_export(spark, sf_dir):
    return results.export_rows(stored_sites(spark, sf_dir), businesses(spark, sf_dir),
                               stored_contacts(spark, sf_dir))


# --- reports ---------------------------------------------------------------------------------
@register("ranked_summary", """
SELECT site, name AS business, opportunity, security, lead,
  coalesce(primary_email, '-') AS contact,
  coalesce(top_title, '-') AS top_opportunity FROM wide WHERE NOT failed""", EXPORT)
def ranked_summary(spark, sf_dir):
    return results.scan_summary(stored_sites(spark, sf_dir), businesses(spark, sf_dir))


@register("ranked_summary_totals", """
SELECT count(*) FILTER (NOT failed) AS analyzed, count(*) AS total,
  CAST(coalesce(sum(n_opp) FILTER (NOT failed), 0) AS BIGINT) AS opportunities FROM wide""", EXPORT)
def ranked_summary_totals(spark, sf_dir):
    return results.summary_totals(stored_sites(spark, sf_dir))


@register("site_report_rows", """
SELECT site, 'opportunities' AS section, row_number() OVER (PARTITION BY site ORDER BY urank,
  rule_id) AS position, urgency AS label, title AS detail FROM opp_all JOIN sr_all USING (site)
  WHERE NOT failed
UNION ALL SELECT site, 'contacts', rn, category, value FROM (SELECT *, row_number()
  OVER (PARTITION BY site ORDER BY kind, rank, normalized_value) AS rn FROM con_all)
UNION ALL SELECT site, 'technologies', rn, name, coalesce(version, '-') || CASE WHEN is_outdated
  THEN ' (outdated)' ELSE '' END FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY
  category, tech_id) AS rn FROM tech_all)""")
def site_report_rows(spark, sf_dir):
    rows = results.site_report(stored_sites(spark, sf_dir), stored_contacts(spark, sf_dir))
    return rows.where("section <> 'findings'")


@register("business_detail", """
SELECT site, name, n_contacts AS contacts, n_tech AS technologies, (SELECT count(*) FROM f_all f
  WHERE f.site = l.site) AS findings, coalesce(n_opp, 0) AS opportunities, lead, security
FROM listing l""", ROW)
def business_detail(spark, sf_dir):
    """Every business with its children as nested columns; counted here."""
    detail = businesses(spark, sf_dir).join(stored_sites(spark, sf_dir), "site", "left")
    return detail.select(
        "site", "name", F.col("n_contacts").alias("contacts"),
        F.size("technologies").alias("technologies"),
        # the summary finding of the synthesizer is not one of the checks
        F.size(F.filter("findings", lambda f: f["check_id"] != "OPP-01")).alias("findings"),
        F.size("opportunities").alias("opportunities"),
        F.col("scores.lead.total").alias("lead"),
        F.col("scores.security.total").alias("security"))


# --- upkeep ---------------------------------------------------------------------------------------
@register("rerun_targets", "SELECT o_orderkey AS scan_id, 'https://c' || CAST(o_custkey AS VARCHAR) "
                           "|| '.example.com/' AS website_url FROM orders WHERE o_orderstatus IN "
                           "('F', 'P') AND o_custkey % 7 <> 0")
def rerun_targets(spark, sf_dir):
    owner = F.col("owner")
    sites = F.when(owner % 7 != 0, F.concat(F.lit("https://c"), owner.cast("string"),
                                            F.lit(".example.com/")))
    return scans(spark, sf_dir).where(F.col("state").isin("F", "P")).select(
        "scan_id", sites.alias("website_url")).where("website_url is not null")


@register("upsert_result", """
SELECT site, 'new' AS version, security FROM scores_B UNION ALL SELECT site, 'old', security
FROM scores_A WHERE site NOT IN (SELECT site FROM scores_B)""")
def upsert_result(spark, sf_dir):
    table = lambda scan, label: scores.score_table(stored_sites(spark, sf_dir, scan)).select(
        "site", F.lit(label).alias("version"), "security")
    return results.upsert(table("A", "old"), table("B", "new"))


@register("scans_stored", """
SELECT 'B' AS scan_id, site, security FROM scores_B UNION ALL SELECT 'A', site, security FROM scores_A WHERE security > 50""")
def scans_stored(spark, sf_dir):
    """Scan A, B, A again with fewer sites, a replay of the first, a write that dies, and a scan that is deleted."""
    from sitelens.operators import scan_store

    path = f"{work_folder(spark)}/scans"
    table = lambda scan: scores.score_table(stored_sites(spark, sf_dir, scan)).select("site", "security")
    scan_store.store_scan({"scores": table("A")}, path, "A", "first")
    scan_store.store_scan({"scores": table("B")}, path, "B", "first")
    scan_store.store_scan({"scores": table("A").where("security > 50")}, path, "A", "second")
    scan_store.store_scan({"scores": table("A")}, path, "A", "first")
    scan_store.store_scan({"scores": table("B")}, path, "C", "first")
    scan_store.delete_scan(spark, path, "C")
    return scan_store.read_scans(spark, path, "scores").select("scan_id", "site", "security")


@register("cascade_delete", "SELECT l_orderkey AS scan_id, count(*) AS n FROM lineitem WHERE "
                            "l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE "
                            "o_orderstatus = 'P') GROUP BY ALL")
def cascade_delete(spark, sf_dir):
    children = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("scan_id"))
    gone = scans(spark, sf_dir).where(F.col("state") == "P")
    return results.cascade_delete(children, gone).groupBy("scan_id").agg(F.count("*").alias("n"))


# --- comparison --------------------------------------------------------------------------------------
def summaries(spark, sf_dir, scan):
    return results.scan_summaries(stored_sites(spark, sf_dir, scan))


def _summary_cte(scan: str) -> str:
    return (f"SELECT site AS domain, lead, website, security, opportunity, coalesce(rules, "
            f"[]::VARCHAR[]) AS rules, coalesce(list_sort(tech_names), []::VARCHAR[]) AS "
            f"technologies FROM scores_{scan} JOIN st_{scan} USING (site) LEFT JOIN (SELECT site, "
            f"list(rule_id ORDER BY rule_id) AS rules FROM opp_{scan} GROUP BY site) USING (site)")


def _minus(a: str, b: str) -> str:
    return (f"array_to_string(list_sort(list_filter({a}, lambda v: NOT list_contains({b}, v))), "
            "',')")


COMPARE = {
    "before_t": _summary_cte("A"), "after_t": _summary_cte("B"),
    "cmp": f"""
SELECT coalesce(a.domain, b.domain) AS domain, a.domain IS NULL AS is_new, b.domain IS NULL AS
  is_gone, {', '.join(f'b.{s} - a.{s} AS {s}_change' for s in scores.SCORES)},
  {', '.join(f'a.{s} AS {s}_before, b.{s} AS {s}_after' for s in scores.SCORES)},
  {_minus('b.rules', 'a.rules')} AS opportunities_gained,
  {_minus('a.rules', 'b.rules')} AS opportunities_resolved,
  {_minus('b.technologies', 'a.technologies')} AS technologies_added,
  {_minus('a.technologies', 'b.technologies')} AS technologies_removed
FROM before_t a FULL OUTER JOIN after_t b ON a.domain = b.domain""",
    "cmps": """
SELECT *, CASE WHEN is_new THEN 'added' WHEN is_gone THEN 'removed' WHEN opportunities_gained <> ''
  OR opportunities_resolved <> '' OR technologies_added <> '' OR technologies_removed <> '' OR
  lead_change <> 0 OR website_change <> 0 OR security_change <> 0 OR opportunity_change <> 0
  THEN 'changed' ELSE 'unchanged' END AS state FROM cmp"""}


def comparison(spark, sf_dir):
    return results.compare_scans(summaries(spark, sf_dir, "A"), summaries(spark, sf_dir, "B"))


@register("scan_summaries", "SELECT domain, lead, website, security, opportunity, array_to_string("
                            "rules, ',') AS rules, array_to_string(technologies, ',') AS "
                            "technologies FROM after_t", COMPARE)
def scan_summaries(spark, sf_dir):
    return summaries(spark, sf_dir, "B").withColumns({
        c: F.array_join(c, ",") for c in ("rules", "technologies")})


@register("scan_compare", "SELECT state, count(*) AS domains FROM cmps GROUP BY state", COMPARE)
def scan_compare(spark, sf_dir):
    return comparison(spark, sf_dir).groupBy("state").agg(F.count("*").alias("domains"))


@register("score_delta", "SELECT domain, " + ", ".join(
    f"{s}_before, {s}_after, {s}_change" for s in scores.SCORES) + " FROM cmp", COMPARE)
def score_delta(spark, sf_dir):
    return comparison(spark, sf_dir).select(
        "domain", *[f"{s}_{p}" for s in scores.SCORES for p in ("before", "after", "change")])


@register("set_delta", "SELECT domain, opportunities_gained, opportunities_resolved, "
                       "technologies_added, technologies_removed FROM cmp WHERE NOT is_new AND "
                       "NOT is_gone", COMPARE)
def set_delta(spark, sf_dir):
    sets = ("opportunities_gained", "opportunities_resolved", "technologies_added",
            "technologies_removed")
    return comparison(spark, sf_dir).where(~F.col("state").isin("added", "removed")).select(
        "domain", *[F.array_join(c, ",").alias(c) for c in sets])


@register("compare_order", "SELECT domain, state FROM cmps ORDER BY list_position(['changed', "
                           "'added', 'removed', 'unchanged'], state), domain", COMPARE)
def compare_order(spark, sf_dir):
    return comparison(spark, sf_dir).select("domain", "state").orderBy(*results.compare_order())


