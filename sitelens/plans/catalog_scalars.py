"""Queries over the scalar functions: URLs, domains, versions, time, page source."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens import fixed
from sitelens.functions import clock, html, urls, versions
from sitelens.operators import checks, facts
from sitelens.plans.catalog import register
from sitelens.plans.catalog_analysis import first_facts
from sitelens.plans.oracle_base import no_hidden, registrable, text_of, unescaped, version_key
from sitelens.sources.captures import (
    SUFFIXES,
    captured_pages,
    captured_sites,
    spark_sql,
)

# raw addresses as people write them, derived from the pages table
RAW_URL = """CASE page_id % 9 WHEN 0 THEN url WHEN 1 THEN upper(host) || '.' WHEN 2 THEN
  '  www.' || site || '/about ' WHEN 3 THEN 'not a domain' WHEN 4 THEN '' WHEN 5 THEN
  'ftp://' || host || '/x' WHEN 6 THEN 'user:pw' || chr(64) || host || ':8080/p?q=1#frag'
  WHEN 7 THEN 'https://shop.' || site || '#top' ELSE 'http://' || site END"""
RAW = {"rawurls": f"SELECT page_id, url, host, site, {RAW_URL} AS raw FROM num"}
LOWERED = "CASE WHEN contains(raw, '://') THEN lower(trim(raw)) ELSE 'http://' || lower(trim(raw)) END"
HOST_SQL = f"regexp_extract({LOWERED}, '^[^:/?#]*://(?:[^/?#]*@)?([^/?#:]*)', 1)"


def raw_urls(spark, sf_dir):
    from sitelens.sources.captures import HOST, SITE

    named = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", "url", F.regexp_extract("url", HOST, 1).alias("host"))
    return named.withColumn("site", F.regexp_extract("host", SITE, 1)).withColumn(
        "raw", spark_sql(RAW_URL))


@register("canonical_domain", f"SELECT page_id, {registrable(HOST_SQL)} AS domain FROM rawurls", RAW)
def canonical_domain(spark, sf_dir):
    return raw_urls(spark, sf_dir).select(
        "page_id", urls.canonical_domain(F.col("raw"), SUFFIXES).alias("domain"))


@register("normalize_url", """
SELECT page_id, CASE WHEN page_id % 9 IN (4, 5) THEN NULL ELSE regexp_replace(CASE WHEN
  contains(raw, '://') THEN trim(raw) ELSE 'https://' || trim(raw) END, '#.*$', '') END AS normal
FROM rawurls""", RAW)
def normalize_url(spark, sf_dir):
    return raw_urls(spark, sf_dir).select(
        "page_id", urls.normalize_url(F.col("raw")).alias("normal"))


@register("same_site", f"""
SELECT page_id, coalesce({registrable(HOST_SQL)} = site, false) AS same FROM rawurls""", RAW)
def same_site(spark, sf_dir):
    return raw_urls(spark, sf_dir).select(
        "page_id", urls.same_site(F.col("raw"), F.col("url"), SUFFIXES).alias("same"))


HREF = """CASE page_id % 11 WHEN 0 THEN '/contact' WHEN 1 THEN 'about.html' WHEN 2 THEN
  '../up/./x?y=1' WHEN 3 THEN '//cdn.example.net/a' WHEN 4 THEN 'mailto:a' WHEN 5 THEN '#top'
  WHEN 6 THEN 'https://other.example.org/z#f' WHEN 7 THEN '?page=3' WHEN 8 THEN ''
  WHEN 9 THEN '/a/b/../c/./d' ELSE 'javascript:void(0)' END"""


@register("join_url", f"""
SELECT page_id, CASE page_id % 11 WHEN 0 THEN root || '/contact' WHEN 1 THEN root || folder ||
  'about.html' WHEN 2 THEN root || regexp_replace(folder, '[^/]+/$', '') || 'up/x?y=1'
  WHEN 3 THEN scheme || '://cdn.example.net/a' WHEN 6 THEN 'https://other.example.org/z'
  WHEN 7 THEN root || path || '?page=3' WHEN 9 THEN root || '/a/c/d' END AS target
FROM (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
  regexp_extract(url, '^(https?://[^/]+)', 1) AS root,
  regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path,
  regexp_extract(url, '^https?://[^/]+([^?#]*/)', 1) AS folder FROM pages)""")
def join_url(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", "url", spark_sql(HREF).alias("href"))
    return pages.select("page_id", urls.join_url(F.col("url"), F.col("href")).alias("target"))


@register("url_path", "SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path "
                      "FROM pages")
def url_path(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", urls.url_path(F.col("url")).alias("path"))


@register("hostname_of", "SELECT page_id, nullif(regexp_extract(lower(raw), "
                         "'^[^:/?#]*://(?:[^/?#]*@)?([^/?#:]*)', 1), '') AS host FROM rawurls", RAW)
def hostname_of(spark, sf_dir):
    return raw_urls(spark, sf_dir).select("page_id", urls.hostname_of(F.col("raw")).alias("host"))


# versions derived from the parts table
VERSION = """CASE p_partkey % 6 WHEN 0 THEN 'unknown' ELSE CASE WHEN p_partkey % 5 = 0 THEN 'v'
  ELSE '' END || CAST(p_partkey % 12 AS VARCHAR(20)) || '.' || CAST(p_partkey % 10 AS VARCHAR(20))
  || CASE WHEN p_partkey % 4 = 0 THEN '.0' ELSE '' END
  || CASE WHEN p_partkey % 7 = 0 THEN '-beta' ELSE '' END END"""
OTHER = """CASE p_partkey % 8 WHEN 0 THEN '' ELSE CAST((p_partkey + 3) % 12 AS VARCHAR(20)) || '.' ||
  CAST(p_partkey % 10 AS VARCHAR(20)) END"""
VERSIONS = {"ver": f"""SELECT p_partkey, a, b, regexp_extract(a, '^v?([0-9.]+)', 1) AS na,
  regexp_extract(a, '-(.*)$', 1) AS pre FROM (SELECT p_partkey, {VERSION} AS a, {OTHER} AS b
  FROM part)"""}
KEY_A, KEY_B = version_key("na"), version_key("b")
KNOWN = "na <> '' AND b <> ''"


def version_pairs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_partkey", spark_sql(VERSION).alias("a"), spark_sql(OTHER).alias("b"))


@register("version_parse", """
SELECT p_partkey, CASE WHEN na <> '' THEN na END AS numbers, CASE WHEN na <> '' THEN
  CASE WHEN pre = '' THEN 1 ELSE 0 END END AS is_final, CASE WHEN na <> '' THEN pre END AS pre
FROM ver""", VERSIONS)
def version_parse(spark, sf_dir):
    parsed = version_pairs(spark, sf_dir).select(
        "p_partkey", versions.version_parse(F.col("a")).alias("v"))
    return parsed.select("p_partkey", F.array_join("v.parts", ".").alias("numbers"),
                         "v.is_final", "v.pre")


@register("version_compare", f"""
SELECT p_partkey, CASE WHEN {KNOWN} THEN CASE WHEN {KEY_A} < {KEY_B} THEN -1 WHEN {KEY_A} > {KEY_B}
  THEN 1 WHEN pre <> '' THEN -1 ELSE 0 END END AS ordering FROM ver""", VERSIONS)
def version_compare(spark, sf_dir):
    return version_pairs(spark, sf_dir).select(
        "p_partkey", versions.version_compare(F.col("a"), F.col("b")).alias("ordering"))


@register("is_outdated", f"""
SELECT p_partkey, CASE WHEN {KNOWN} THEN {KEY_A} < {KEY_B} OR ({KEY_A} = {KEY_B} AND pre <> '')
  END AS outdated FROM ver""", VERSIONS)
def is_outdated(spark, sf_dir):
    return version_pairs(spark, sf_dir).select(
        "p_partkey", versions.is_outdated(F.col("a"), F.col("b")).alias("outdated"))


@register("major_versions_behind", f"""
SELECT p_partkey, CASE WHEN {KNOWN} THEN greatest(0, {KEY_B}[1] - {KEY_A}[1]) END AS behind
FROM ver""", VERSIONS)
def major_versions_behind(spark, sf_dir):
    return version_pairs(spark, sf_dir).select(
        "p_partkey", versions.major_versions_behind(F.col("a"), F.col("b")).alias("behind"))


@register("days_between", """
SELECT event_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00'))
  / 86400000000.0) AS INT) AS days FROM events""")
def days_between(spark, sf_dir):
    fixed_time = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", clock.days_between(fixed_time, F.col("ts").cast("timestamp")).alias("days"))


@register("iso_z", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN ''
  ELSE '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END || 'Z' AS text
FROM events""")
def iso_z(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", clock.iso_z(F.col("ts").cast("timestamp")).alias("text"))


@register("ensure_utc", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN epoch_us(o_orderdate) -
  7200000000 ELSE epoch_us(o_orderdate) END AS micros FROM orders""")
def ensure_utc(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.concat(day, F.expr(
        "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Z' WHEN 2 THEN '+02:00' ELSE ' x' END"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", F.unix_micros(clock.ensure_utc(raw)).alias("micros"))


@register("evidence_timestamp", "SELECT site, '2026-07-30T12:00:00Z' AS checked_at FROM sr_all")
def evidence_timestamp(spark, sf_dir):
    return captured_sites(spark, sf_dir).select(
        "site", clock.iso_z(F.col("captured_at")).alias("checked_at"))


# --- the site row -----------------------------------------------------------------------
def _site_rows(spark, sf_dir):
    return facts.site_frame(captured_sites(spark, sf_dir),
                            firsts=first_facts(spark, sf_dir, "page"))


@register("home_page", "SELECT site, home_page_url AS home_url, home_status FROM sr_all")
def home_page(spark, sf_dir):
    return _site_rows(spark, sf_dir).select(
        "site", F.col("home.final_url").alias("home_url"), F.col("home.status").alias(
            "home_status"))


@register("is_https", "SELECT site, is_https FROM sr_all")
def is_https(spark, sf_dir):
    return facts.site_frame(captured_sites(spark, sf_dir)).select("site", "is_https")


@register("total_bytes", "SELECT site, page_count, total_bytes FROM sr_all")
def total_bytes(spark, sf_dir):
    return _site_rows(spark, sf_dir).select("site", "page_count", "total_bytes")


PAGE_TYPE = """CASE WHEN final_url LIKE '%contact%' OR final_url LIKE '%kontakt%' THEN 'contact'
  WHEN final_url LIKE '%about%' THEN 'about' WHEN final_url LIKE '%privacy%' THEN 'privacy'
  WHEN final_url LIKE '%legal%' OR final_url LIKE '%imprint%' OR final_url LIKE '%impressum%'
  THEN 'legal' ELSE 'other' END"""


@register("page_classify", f"SELECT site, page_no, {PAGE_TYPE} AS page_type FROM pg_all")
def page_classify(spark, sf_dir):
    return captured_pages(spark, sf_dir).select("site", "page_no", "page_type")


@register("pages_of", f"SELECT site, {PAGE_TYPE} AS page_type, count(*) AS n, min(page_no) AS "
                      "first_page FROM pg_all GROUP BY ALL")
def pages_of(spark, sf_dir):
    return captured_pages(spark, sf_dir).groupBy("site", "page_type").agg(
        F.count("*").alias("n"), F.min("page_no").alias("first_page"))


@register("html_documents", "SELECT site, count(*) AS documents, sum(length(html))::BIGINT AS "
                            "characters FROM pg_all WHERE html <> '' GROUP BY site")
def html_documents(spark, sf_dir):
    return captured_pages(spark, sf_dir).where("html <> ''").groupBy("site").agg(
        F.count("*").alias("documents"), F.sum(F.length("html")).alias("characters"))


@register("all_headers", "SELECT site, h_server AS server, h_via AS via, h_cf_ray AS cf_ray "
                         "FROM sr_all WHERE page_count > 0")
def all_headers(spark, sf_dir):
    return _site_rows(spark, sf_dir).where("page_count > 0").select(
        "site", *[F.element_at("home.headers", h).alias(h.replace("-", "_"))
                  for h in ("server", "via", "cf-ray")])


@register("header_lookup", "SELECT site, page_no, h_server AS server FROM pg_all")
def header_lookup(spark, sf_dir):
    shouted = captured_pages(spark, sf_dir).withColumn(
        "headers", F.transform_keys("headers", lambda k, _: F.upper(k)))
    lowered = F.transform_keys("headers", lambda k, _: F.lower(k))
    return shouted.select("site", "page_no", F.element_at(lowered, F.lower(F.lit("Server")))
                          .alias("server"))


@register("is_ok", "SELECT site, page_no, status BETWEEN 200 AND 299 AS is_ok FROM pg_all")
def is_ok(spark, sf_dir):
    return captured_pages(spark, sf_dir).select(
        "site", "page_no", F.col("status").between(200, 299).alias("is_ok"))


# --- DNS records --------------------------------------------------------------------------
@register("dns_spf", "SELECT site, spf FROM sr_all WHERE has_dns")
def dns_spf(spark, sf_dir):
    return captured_sites(spark, sf_dir).where("dns is not null").select(
        "site", checks.dns_spf(F.col("dns.txt")).alias("spf"))


@register("dns_resolved", """
SELECT site, coalesce(lookup_failed <> 'TXT', true) AS txt,
  coalesce(lookup_failed NOT IN ('MX', 'DMARC'), true) AS mx_and_dmarc FROM sr_all WHERE has_dns""")
def dns_resolved(spark, sf_dir):
    failed = F.col("dns.lookup_failed")
    return captured_sites(spark, sf_dir).where("dns is not null").select(
        "site", checks.dns_resolved(failed, "TXT").alias("txt"),
        checks.dns_resolved(failed, "MX", "DMARC").alias("mx_and_dmarc"))


@register("spf_qualifier", "SELECT site, qualifier FROM sr_all WHERE has_dns")
def spf_qualifier(spark, sf_dir):
    return captured_sites(spark, sf_dir).where("dns is not null").select(
        "site", checks.spf_qualifier(checks.dns_spf(F.col("dns.txt"))).alias("qualifier"))


@register("dmarc_policy", "SELECT site, policy FROM sr_all WHERE has_dns")
def dmarc_policy(spark, sf_dir):
    return captured_sites(spark, sf_dir).where("dns is not null").select(
        "site", checks.dmarc_policy(F.col("dns.dmarc")).alias("policy"))


TXT = """CASE s_suppkey % 3 WHEN 0 THEN 'v=spf1 inc" "lude:x ~all' WHEN 1 THEN 'v=DMARC1; p=none'
  ELSE 'note' || s_name END"""


@register("txt_unchunk", f"SELECT s_suppkey, replace({TXT}, '\" \"', '') AS txt FROM supplier")
def txt_unchunk(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        "s_suppkey", F.replace(spark_sql(TXT), F.lit('" "'), F.lit("")).alias("txt"))


@register("dmarc_pick", f"SELECT s_suppkey, CASE WHEN lower({TXT}) LIKE 'v=dmarc1%' THEN {TXT} END "
                        "AS dmarc FROM supplier")
def dmarc_pick(spark, sf_dir):
    answers = F.array(F.lit("unrelated"), spark_sql(TXT))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.get(F.filter(
        answers, lambda r: F.lower(r).startswith("v=dmarc1")), F.lit(0)).alias("dmarc"))


# --- page source -----------------------------------------------------------------------------
INVISIBLE_SQL = (
    "regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|"
    "<noscript\\b.*?</noscript\\s*>|<template\\b.*?</template\\s*>|<!--.*?-->', ' ', 'g')")
TEXTS = {"texts": f"SELECT site, page_no, {text_of(INVISIBLE_SQL)} AS txt FROM pg_all"}


@register("visible_text", "SELECT site, page_no, length(txt) AS characters, md5(txt) AS digest "
                          "FROM texts", TEXTS)
def visible_text(spark, sf_dir):
    text = captured_pages(spark, sf_dir).select(
        "site", "page_no", html.visible_text(F.col("html")).alias("txt"))
    return text.select("site", "page_no", F.length("txt").alias("characters"),
                       F.md5("txt").alias("digest"))


PARKING = "CASE WHEN doc_id % 4 = 0 THEN text || ' This Domain is for SALE' ELSE text END"


@register("parked_domain", f"SELECT doc_id, (" + " OR ".join(
    f"contains(lower({PARKING}), '{m}')" for m in fixed.PARKED_MARKERS) + ") AS parked "
    "FROM documents")
def parked_domain(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", html.is_parked(spark_sql(PARKING)).alias("parked"))


@register("content_hash", "SELECT page_id, 'sha256:' || substr(sha256(html), 1, 32) AS "
                          "content_hash FROM pages")
def content_hash(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", html.content_hash(F.col("html")).alias("content_hash"))


COOKIE = """'sid' || CAST(user_id AS VARCHAR(20)) || '=1; Path=/' || CASE WHEN event_id % 2 = 0 THEN
  '; Secure' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN '; HttpOnly' ELSE '' END ||
  CASE event_id % 5 WHEN 0 THEN '; SameSite=Lax' WHEN 1 THEN '; samesite=NONE' ELSE '' END"""


@register("cookie_parse", f"""
SELECT event_id, 'sid' || CAST(user_id AS VARCHAR) AS name, event_id % 2 = 0 AS secure,
  event_id % 3 = 0 AS http_only, CASE event_id % 5 WHEN 0 THEN 'Lax' WHEN 1 THEN 'None' END
  AS same_site FROM (SELECT *, {COOKIE} AS header FROM events)""")
def cookie_parse(spark, sf_dir):
    from sitelens.operators.crawlplan import parse_cookie

    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", parse_cookie(spark_sql(COOKIE)).alias("c")).select("event_id", "c.*")


@register("hostname_match", """
SELECT p AS page_no, host, CASE p % 3 WHEN 0 THEN host = site OR (host LIKE '%.' || site)
  WHEN 1 THEN host = site ELSE true END AS matches FROM nx_all""")
def hostname_match(spark, sf_dir):
    from sitelens.operators.crawlplan import hostname_matches
    from sitelens.sources.captures import _numbered

    site = F.col("site")
    named = _numbered(spark, sf_dir, "all").withColumn("sans", F.expr(
        "CASE p % 3 WHEN 0 THEN array(site, concat('*.', site)) WHEN 1 THEN array(upper(site)) "
        "ELSE array('other.test', concat(host, '.')) END"))
    return named.select(F.col("p").alias("page_no"), "host", hostname_matches(
        F.col("host"), F.lit(None).cast("string"), F.col("sans")).alias("matches"), site)\
        .drop("site")




_TOKEN = r"(?s)<(/?[A-Za-z][^\s/>]*)([^>]*)>([^<]*)"
_LINKED = r"""(?is)\shref\s*=\s*(?:"[^"]+"|''[^'']+''|[^\s"''>]+)"""


@register("html_elements", f"""
SELECT site, page_no, lower(ltrim(t.tag, '/')) AS tag, starts_with(t.tag, '/') AS closing, count(*) AS n,
  count(*) FILTER (regexp_matches(t.inside, '{_LINKED}')) AS n_linked, sum(length({unescaped('t.txt')}))::BIGINT AS characters
FROM (SELECT site, page_no, unnest(list_transform(range(1, len(a) + 1), lambda i: {{'tag': a[i], 'inside': b[i], 'txt': c[i]}})) AS t
  FROM (SELECT site, page_no, regexp_extract_all(h, '{_TOKEN}', 1) AS a, regexp_extract_all(h, '{_TOKEN}', 2) AS b,
    regexp_extract_all(h, '{_TOKEN}', 3) AS c FROM (SELECT site, page_no, {no_hidden('html')} AS h FROM pg_all))) GROUP BY ALL""")
def html_elements(spark, sf_dir):
    rows = html.page_elements(captured_pages(spark, sf_dir), "site", "page_no")
    linked = F.coalesce(F.element_at("attributes", "href"), F.lit("")) != ""
    return rows.groupBy("site", "page_no", "tag", "closing").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(linked).alias("n_linked"), F.sum(F.length("text")).alias("characters"))
