"""Queries over capture decisions: links, robots, addresses, outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens import fixed
from sitelens.operators import crawlplan
from sitelens.plans.catalog import register
from sitelens.plans.oracle_base import q
from sitelens.sources.captures import SUFFIXES, captured_pages, captured_sites, spark_sql

LINK_SQL = {"links": """
SELECT site, page_no, root || '/privacy-policy' AS url, 'privacy' AS page_type FROM (
  SELECT site, page_no, final_url, regexp_extract(final_url, '^(https?://[^/?#]*)', 1) AS root
  FROM pg_all WHERE html LIKE '%<a href="/privacy-policy">%')"""}


@register("link_extract", "SELECT site, page_no, url, page_type FROM links", LINK_SQL)
def link_extract(spark, sf_dir):
    return crawlplan.extract_links(captured_pages(spark, sf_dir), SUFFIXES)


ROBOTS = ("CASE seed % 5 WHEN 0 THEN '/contact*' WHEN 1 THEN '/' WHEN 2 THEN '/about$' "
          "WHEN 3 THEN '/privacy' ELSE '' END")
ALLOW = "CASE WHEN seed % 2 = 0 THEN '/contact-us' ELSE '/privacy-policy' END"
RULE_SQL = {"robotrules": f"SELECT site, 'disallow' AS verdict, {ROBOTS} AS rule FROM sx_all UNION "
                          f"ALL SELECT site, 'allow', {ALLOW} FROM sx_all"}
MATCH = ("CASE WHEN rule = '' THEN false WHEN rule LIKE '%$' THEN path = rule[:-2] WHEN rule LIKE "
         "'%*%' THEN regexp_matches(path, '^' || replace(rule, '*', '.*')) ELSE "
         "starts_with(path, rule) END")


def allowed_sql(source: str) -> str:
    return (f"SELECT t.*, coalesce(deny, -1) < 0 OR coalesce(allow, -1) >= coalesce(deny, -1) AS "
            f"allowed FROM {source} t LEFT JOIN (SELECT site, url, max(length(rule)) FILTER "
            f"(verdict = 'allow') AS allow, max(length(rule)) FILTER (verdict = 'disallow') AS deny "
            f"FROM (SELECT *, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path "
            f"FROM (SELECT DISTINCT site, url FROM {source})) JOIN robotrules USING (site) "
            f"WHERE {MATCH} GROUP BY ALL) USING (site, url)")


def robot_rules(spark, sf_dir):
    pair = F.array(
        F.struct(F.lit("disallow").alias("verdict"), F.expr(ROBOTS).alias("rule")),
        F.struct(F.lit("allow").alias("verdict"), F.expr(ALLOW).alias("rule")))
    return captured_sites(spark, sf_dir).select("site", F.explode(pair).alias("r")).select(
        "site", "r.*")


@register("robots_allowed", "SELECT site, page_no, url, allowed FROM askedurls",
          {**RULE_SQL, "asked": "SELECT site, page_no, final_url AS url FROM pg_all",
           "askedurls": allowed_sql("asked")})
def robots_allowed(spark, sf_dir):
    urls = captured_pages(spark, sf_dir).select("site", "page_no", F.col("final_url").alias("url"))
    return crawlplan.robots_allowed(urls, robot_rules(spark, sf_dir))


_PATHS = ", ".join(f"({q(p)}, {q(t)})" for p, t in fixed.CANDIDATE_PATHS)


@register("frontier_plan", """
SELECT site, position, url, page_type FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY
  page_type <> 'contact', url) AS position FROM okurls WHERE allowed) WHERE position <= 7""", {
    **LINK_SQL, **RULE_SQL,
    "planned": f"""SELECT site, url, arg_min(page_type, source) AS page_type FROM (
  SELECT site, url, page_type, 0 AS source FROM links JOIN (SELECT site, min(page_no) AS page_no
    FROM pg_all GROUP BY site) USING (site, page_no)
  UNION ALL SELECT site, regexp_extract(final_url, '^(https?://[^/?#]*)', 1) || path, page_type, 1
  FROM ho_all, (VALUES {_PATHS}) AS c(path, page_type)) GROUP BY site, url""",
    "okurls": allowed_sql("planned")})
def frontier_plan(spark, sf_dir):
    pages = captured_pages(spark, sf_dir)
    homes = pages.groupBy("site").agg(
        F.min_by(F.struct("page_no", "final_url"), "page_no").alias("h"))
    home_links = crawlplan.extract_links(pages, SUFFIXES).join(
        homes.select("site", F.col("h.page_no").alias("page_no")), ["site", "page_no"],
        "left_semi")
    return crawlplan.frontier_plan(
        homes.select("site", F.col("h.final_url").alias("home_url")), home_links,
        robot_rules(spark, sf_dir))


BODY = """CASE seed % 4
  WHEN 0 THEN 'User-agent: *\nDisallow: /private # keep out\nAllow: /private/open\nCrawl-delay: 2'
  WHEN 1 THEN 'User-agent: *\nDisallow: /\n\nUser-agent: lensbot\nDisallow: /tmp\nCrawl-delay: soon'
  WHEN 2 THEN 'Sitemap: https://x.test/s.xml\nUser-agent: other\nDisallow: /' ELSE
  'User-Agent: *\nDisallow: /' END"""


@register("robots_groups", """
SELECT site, CASE seed % 4 WHEN 0 THEN '*' WHEN 1 THEN 'lensbot' WHEN 3 THEN '*' END AS agent,
  CASE seed % 4 WHEN 0 THEN '/private' WHEN 1 THEN '/tmp' WHEN 3 THEN '/' ELSE '' END AS disallowed,
  CASE WHEN seed % 4 = 0 THEN '/private/open' ELSE '' END AS allowed,
  CASE WHEN seed % 4 = 2 THEN 'https://x.test/s.xml' ELSE '' END AS sitemaps,
  CASE WHEN seed % 4 = 0 THEN 2.0::DOUBLE END AS crawl_delay FROM sx_all""")
def robots_groups(spark, sf_dir):
    files = captured_sites(spark, sf_dir).select("site", F.expr(BODY).alias("body"))
    groups = crawlplan.parse_robots(files, "LensBot/1.0")
    return groups.select("site", "agent", "crawl_delay", *[
        F.array_join(c, ",").alias(c) for c in ("disallowed", "allowed", "sitemaps")])


@register("robots_blocked", "SELECT site, seed % 4 = 3 AS blocked FROM sx_all")
def robots_blocked(spark, sf_dir):
    files = captured_sites(spark, sf_dir).select("site", F.expr(BODY).alias("body"))
    return crawlplan.parse_robots(files, "LensBot/1.0").select(
        "site", crawlplan.robots_blocked().alias("blocked"))


IP = """CASE c_custkey % 16 WHEN 0 THEN '10.1.2.' WHEN 1 THEN '93.184.216.' WHEN 2 THEN '172.20.9.'
  WHEN 3 THEN '172.32.0.' WHEN 4 THEN '100.100.1.' WHEN 5 THEN '8.8.8.' WHEN 6 THEN '300.1.1.'
  WHEN 7 THEN 'fe80::' WHEN 8 THEN '2606:2800::' WHEN 9 THEN '1:' WHEN 10 THEN ':::'
  WHEN 11 THEN '12345::' WHEN 12 THEN '1:2:3:4:5:6:7:8:' WHEN 13 THEN '08.8.8.' WHEN 14 THEN '2001:db8:0:0:1:2:3:'
  ELSE '1::2::' END || CAST(c_custkey % 200 AS VARCHAR(20))"""


@register("public_address_filter", f"""
SELECT c_custkey, {IP} AS ip, c_custkey % 16 IN (1, 3, 5, 8, 14) AS public, c_custkey % 3 <> 0 AS
  port_ok FROM customer""")
def public_address_filter(spark, sf_dir):
    url = F.concat(F.lit("https://h.test"), F.expr(
        "CASE c_custkey % 3 WHEN 0 THEN ':8443/x' WHEN 1 THEN ':443/' ELSE '/y' END"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey", spark_sql(IP).alias("ip")).withColumns({
            "public": crawlplan.is_public_address(F.col("ip")),
            "port_ok": crawlplan.allowed_port(url)})


@register("cookie_dedupe", """
SELECT user_id AS site, event_type AS name, min(event_id) AS first_id, arg_min(value, event_id) AS
  value FROM events GROUP BY ALL""")
def cookie_dedupe(spark, sf_dir):
    seen = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("site"), F.col("event_type").alias("name"),
        F.col("event_id").alias("first_id"), "value")
    return crawlplan.cookie_dedupe(seen, F.col("first_id"))


@register("retention_purge", """
SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 OR c_acctbal >= 0 THEN c_mktsegment END AS category,
  CASE WHEN c_custkey % 5 <> 0 OR c_acctbal >= 0 THEN c_name END AS address FROM customer""")
def retention_purge(spark, sf_dir):
    now = F.lit("2026-07-30 12:00:00").cast("timestamp")
    day = F.make_dt_interval(F.lit(1))
    expiry = F.when(F.col("c_custkey") % 5 == 0, F.when(F.col("c_acctbal") < 0, now - day)
                    .otherwise(now + day))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey", F.col("c_mktsegment").alias("category"), F.col("c_name").alias("address"),
        expiry.alias("source_expires_at"), "c_acctbal")
    return crawlplan.retention_purge(rows, now).select("c_custkey", "category", "address")


@register("crawl_outcome", """
SELECT p AS page_no, CASE WHEN p % 11 = 0 OR p % 13 = 0 OR p % 7 = 0 OR p % 6 = 0 THEN 'failed'
  WHEN p % 5 = 0 THEN 'partial' ELSE 'complete' END AS status, CASE WHEN p % 11 = 0 THEN
  'dns_failure' WHEN p % 13 = 0 THEN 'blocked_address' WHEN p % 7 = 0 THEN 'robots_denied'
  WHEN p % 6 = 0 THEN 'timeout' WHEN p % 5 = 0 THEN 'parked_domain' WHEN p % 10 = 0 THEN 'http_5xx'
  WHEN p % 17 = 0 THEN 'http_4xx' END AS reason FROM nx_all""")
def crawl_outcome(spark, sf_dir):
    p = F.col("page_id")
    status = F.when(p % 6 == 0, None).otherwise(F.when(p % 17 == 0, 404).otherwise(200))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        p.alias("page_no"), crawlplan.crawl_outcome(
            p % 11 != 0, p % 13 == 0, p % 7 == 0, status, p % 5 == 0).alias("o")
    ).select("page_no", "o.*")


