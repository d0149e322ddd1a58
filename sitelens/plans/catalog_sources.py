"""Queries over sources and sinks: snapshots, target lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sitelens.plans.catalog import register
from sitelens.plans.catalog_scalars import HOST_SQL, RAW, raw_urls
from sitelens.plans.oracle_base import registrable
from sitelens.session import work_folder
from sitelens.sources import businesses, snapshots
from sitelens.sources.captures import SUFFIXES, captured_pages, captured_sites


def documents(spark, sf_dir) -> snapshots.Snapshots:
    """The captures written as nested documents in the shared folder, beside some that are unusable, and read back."""
    path = f"{work_folder(spark)}/documents"
    sites, pages = captured_sites(spark, sf_dir).drop("seed"), captured_pages(spark, sf_dir)
    snapshots.write_documents(sites, pages, f"{path}/a", per_document=3)
    spoiled = sites.select(F.concat(F.lit('{"domain":"'), "site", F.lit('", ')).alias("value")).union(
        sites.select(F.concat(F.lit('{"domain":"'), "site", F.lit('","schema_version":2}')))).union(
        sites.select(F.concat(F.lit('{"requested_url":"https://'), "site", F.lit('/"}'))))
    spoiled.write.text(f"{path}/b")
    return snapshots.read_documents(spark, f"{path}/*")


_ROUND_TRIP = """
SELECT site, requested_url, final_url, CASE WHEN failed THEN 'failed' ELSE 'complete' END AS status,
  epoch_us(TIMESTAMP '2026-07-30 12:00:00') AS captured_us, CASE WHEN tls_seen THEN
  epoch_us(TIMESTAMP '2026-07-30 12:00:00') + days_left * 86400000000 END AS not_after_us,
  has_dns AS looked, CASE WHEN has_dns THEN dmarc END AS dmarc, n_cookies AS cookies,
  len(redirect_chain) AS hops, 'http' AS render_mode, 1 AS schema_version FROM sx_all"""


@register("src_snapshot_json", _ROUND_TRIP)
def src_snapshot_json(spark, sf_dir):
    sites = documents(spark, sf_dir).sites
    micros = lambda c: F.unix_micros(F.col(c))
    return sites.select(
        "site", "requested_url", "final_url", "status", micros("captured_at").alias("captured_us"),
        micros("tls.not_after").alias("not_after_us"), F.col("dns").isNotNull().alias("looked"),
        F.col("dns.dmarc").alias("dmarc"), F.size("cookies").alias("cookies"),
        F.size("redirect_chain").alias("hops"), "render_mode", "schema_version")


@register("sink_snapshot_json", "SELECT site, page_no, status, h_server AS server, md5(html) AS "
                                "digest FROM pg_all")
def sink_snapshot_json(spark, sf_dir):
    """Pages in nested documents and back without loss."""
    return documents(spark, sf_dir).pages.select(
        "site", "page_no", "status", F.element_at("headers", "server").alias("server"), F.md5("html").alias("digest"))


@register("snapshot_rejects", """
SELECT reason, count(*) AS documents FROM (SELECT unnest(['not a snapshot document', 'version 2', 'no domain']) AS reason
FROM sx_all) GROUP BY reason""")
def snapshot_rejects(spark, sf_dir):
    return documents(spark, sf_dir).rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("documents"))


def target_list(spark, sf_dir):
    """A target list written as CSV files in the shared folder, and read back by record."""
    rows = raw_urls(spark, sf_dir).select(
        F.concat(F.lit("Biz "), F.col("page_id").cast("string")).alias("Company Name"),
        F.col("raw").alias("Website URL"),
        F.when(F.col("page_id") % 3 == 0, "Leeds").otherwise("").alias("Town"),
        F.lit("gbr").alias("Country"), "page_id")
    path = f"{work_folder(spark)}/targets"
    # sorted over several files: their names are in the order of the rows
    rows.repartitionByRange(4, "page_id").sortWithinPartitions("page_id").drop("page_id").write.options(
        header=True, sep=";", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return businesses.read_csv(spark, path)


TARGETS = {**RAW, "targets": f"""
SELECT row_number() OVER (ORDER BY page_id) AS row_no, 'Biz ' || page_id AS name, trim(raw) AS cell, domain, website_url,
  CASE WHEN page_id % 3 = 0 THEN 'Leeds' END AS city, 'GB' AS country_code, 'gbr' AS country,
  CASE WHEN trim(raw) = '' THEN 'empty domain' WHEN domain IS NULL OR website_url IS NULL THEN
  'not a valid domain: ''' || trim(raw) || '''' END AS reason
FROM (SELECT *, {registrable(HOST_SQL)} AS domain, CASE WHEN page_id % 9 IN (4, 5) THEN NULL ELSE
  regexp_replace(CASE WHEN contains(raw, '://') THEN trim(raw) ELSE 'https://' || trim(raw) END,
  '#.*$', '') END AS website_url FROM rawurls)"""}


def judged(spark, sf_dir):
    return businesses.judge_rows(target_list(spark, sf_dir), SUFFIXES)


@register("src_business_csv", "SELECT row_no, name, website_url, domain, city, country_code, country FROM "
                              "targets WHERE reason IS NULL", TARGETS)
def src_business_csv(spark, sf_dir):
    return businesses.split_rows(judged(spark, sf_dir))[0].drop("source")


@register("csv_row_errors", "SELECT row_no, reason FROM targets WHERE reason IS NOT NULL", TARGETS)
def csv_row_errors(spark, sf_dir):
    return businesses.split_rows(judged(spark, sf_dir))[1]


@register("csv_dry_run", """
SELECT 'valid' AS part, count(DISTINCT domain) AS row_no, '' AS detail FROM targets WHERE reason
  IS NULL
UNION ALL SELECT * FROM (VALUES ('column', 1, 'city=Town'), ('column', 2, 'country=Country'), ('column', 3, 'domain=Website URL'),
  ('column', 4, 'name=Company Name')) AS roles
UNION ALL (SELECT 'error', row_no, reason FROM targets WHERE reason IS NOT NULL ORDER BY row_no
  LIMIT 50)
UNION ALL (SELECT 'sample', min(row_no), domain FROM targets WHERE reason IS NULL GROUP BY domain
  ORDER BY 2 LIMIT 5)""", TARGETS)
def csv_dry_run(spark, sf_dir):
    listed = target_list(spark, sf_dir)
    count, errors, sample = businesses.dry_run(businesses.judge_rows(listed, SUFFIXES))
    roles = businesses.detected_columns(spark, listed.columns)
    position = F.row_number().over(Window.orderBy("role")).cast("bigint")
    return (
        roles.select(F.lit("column").alias("part"), position.alias("row_no"),
                     F.concat("role", F.lit("="), "header").alias("detail")).unionByName(
        count.select(F.lit("valid").alias("part"), F.col("valid").alias("row_no"),
                     F.lit("").alias("detail")))
        .unionByName(errors.select(F.lit("error").alias("part"), "row_no",
                                   F.col("reason").alias("detail")))
        .unionByName(sample.select(F.lit("sample").alias("part"), "row_no",
                                   F.col("domain").alias("detail"))))


@register("business_dedupe", "SELECT domain, min(row_no) AS row_no, arg_min(name, row_no) AS name, "
                             "arg_min(website_url, row_no) AS website_url FROM targets WHERE "
                             "reason IS NULL GROUP BY domain", TARGETS)
def business_dedupe(spark, sf_dir):
    valid = businesses.split_rows(judged(spark, sf_dir))[0]
    return businesses.business_dedupe(valid).select("domain", "row_no", "name", "website_url")


@register("src_url_list", "SELECT domain AS name, website_url, domain FROM targets "
                          "WHERE domain IS NOT NULL AND website_url IS NOT NULL", TARGETS)
def src_url_list(spark, sf_dir):
    return businesses.businesses_from_urls(raw_urls(spark, sf_dir), SUFFIXES, "raw")


@register("business_status_init", "SELECT row_no, CASE WHEN website_url IS NULL THEN 'no_website' "
                                  "ELSE 'pending' END AS status FROM targets", TARGETS)
def business_status_init(spark, sf_dir):
    return judged(spark, sf_dir).select(
        "row_no", businesses.first_status(F.col("website_url")).alias("status"))


# --- suffix rules from a table -------------------------------------------------------------------
# a third of the nations is a suffix, a third makes suffixes of all labels below it (some with an
# exception), and the rest is in no rule
_NATION = "lower(replace(n_name, ' ', ''))"
_SUFFIX_RULES = f"""
SELECT {_NATION} AS suffix FROM nations WHERE n_nationkey % 3 = 0
UNION ALL SELECT 'co.' || {_NATION} FROM nations WHERE n_nationkey % 6 = 0
UNION ALL SELECT '*.' || {_NATION} FROM nations WHERE n_nationkey % 3 = 1
UNION ALL SELECT '!www.' || {_NATION} FROM nations WHERE n_nationkey % 6 = 1
UNION ALL SELECT '// a remark'"""
_HOSTS = f"""
SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'https://A.b' || c_custkey || '.' || {_NATION} || ':8080/x?y#z'
  WHEN 1 THEN {_NATION} WHEN 2 THEN 'www.' || {_NATION} WHEN 3 THEN ' x.WWW.' || {_NATION} || '. '
  WHEN 4 THEN 'b' || c_custkey || '.co.' || {_NATION} WHEN 5 THEN 'http://user@k.co.' || {_NATION} || '/'
  ELSE '.' || {_NATION} END AS raw FROM customer JOIN nations ON n_nationkey = c_nationkey"""


@register("canonical_domain_table", f"""
SELECT c_custkey, CASE WHEN coalesce(excepted, listed) > 1 AND l[coalesce(excepted, listed) - 1] <> ''
  THEN array_to_string(l[coalesce(excepted, listed) - 1:], '.') END AS domain
FROM hostlabels LEFT JOIN (SELECT c_custkey,
    min(i) FILTER (i > 1 AND EXISTS (SELECT 1 FROM suffixrules WHERE suffix = '!' || array_to_string(l[i - 1:], '.'))) AS excepted,
    min(i) FILTER (EXISTS (SELECT 1 FROM suffixrules WHERE suffix = array_to_string(l[i:], '.'))
      OR (i < len(l) AND EXISTS (SELECT 1 FROM suffixrules WHERE suffix = '*.' || array_to_string(l[i + 1:], '.')))) AS listed
  FROM hostlabels, unnest(range(1, len(l) + 1)) AS u(i) GROUP BY ALL) AS cuts USING (c_custkey)""", {
    "nations": "SELECT * FROM nation", "suffixrules": _SUFFIX_RULES, "hosts": _HOSTS,
    "hostlabels": "SELECT c_custkey, string_split(rtrim(regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), "
                  "'^[a-z]+://', ''), '^[^@/]*@', ''), '[:/?#].*$', ''), '.'), '.') AS l FROM hosts"})
def canonical_domain_table(spark, sf_dir):
    from sitelens.functions.urls import canonical_domain
    from sitelens.sources.suffixes import suffixes_from_table

    for table in ("nation", "customer"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView({"nation": "nations"}.get(table, table))
    suffixes = suffixes_from_table(spark.sql(_SUFFIX_RULES))
    return spark.sql(_HOSTS).select("c_custkey", canonical_domain(F.col("raw"), suffixes).alias("domain"))
