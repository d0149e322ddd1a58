"""Captured sites derived from the ``pages`` table.

The table has only an address and a source per page. Everything else a capture
holds (headers, certificate, DNS, cookies, timings) is arithmetic on two
numbers of the row itself: ``p``, the page id, and ``seed``, a hash of the
site's name. Both are known per row, so deriving a capture needs no window, no
join and no shuffle, whatever the size of a site. The formulas are SQL text
that Spark and the checking engine both read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLOCK = "2026-07-30 12:00:00"
HOST = r"^https?://([^/?#:]+)"
SITE = r"([^.]+\.example\.(?:com|net|org))$"
SUFFIXES = ("example.com", "example.net", "example.org", "com", "net", "org", "co.uk")

ROOT = "(CASE WHEN url LIKE 'https:%' THEN 'https://' ELSE 'http://' END || host)"
PAGE = {
    "final_url": f"CASE p % 10 WHEN 3 THEN {ROOT} || '/contact-us' WHEN 7 THEN {ROOT} || '/about' "
                 f"WHEN 9 THEN {ROOT} || '/wp-login.php' ELSE url END",
    "status": "CASE WHEN p % 10 = 0 THEN 500 WHEN p % 17 = 0 THEN 404 ELSE 200 END",
    "response_time_ms": "CAST(100 + (p * 37) % 3400 AS INT)",
    "bytes": "CAST(CASE WHEN p % 19 = 0 THEN 4000000 ELSE length(html) END AS BIGINT)",
}
HEADERS = {
    "strict-transport-security": "CASE WHEN p % 3 = 0 THEN 'max-age=31536000' END",
    "content-security-policy":
        "CASE WHEN p % 8 = 0 THEN 'default-src self; frame-ancestors none' "
        "WHEN p % 4 = 0 THEN 'default-src self' END",
    "x-content-type-options": "CASE WHEN p % 2 = 0 THEN 'nosniff' END",
    "x-frame-options": "CASE WHEN p % 5 = 0 THEN 'SAMEORIGIN' END",
    "referrer-policy": "CASE WHEN p % 7 < 3 THEN 'no-referrer' END",
    "permissions-policy": "CASE WHEN p % 11 = 0 THEN 'camera=()' END",
    "server": "CASE p % 6 WHEN 0 THEN 'nginx/1.18.0' WHEN 1 THEN 'Apache/2.4.41' "
              "WHEN 2 THEN 'cloudflare' WHEN 3 THEN 'Microsoft-IIS/10.0' "
              "WHEN 4 THEN 'LiteSpeed' END",
    "x-powered-by": "CASE p % 9 WHEN 4 THEN 'PHP/7.4.3' WHEN 5 THEN 'Express' END",
    "cf-ray": "CASE WHEN p % 6 = 2 THEN 'ray' || CAST(p AS VARCHAR(20)) END",
    "via": "CASE WHEN p % 13 = 1 THEN '1.1 edge (CloudFront)' END",
}
NUMBER = "lpad(CAST(p % 1000 AS VARCHAR(20)), 3, '0')"
BRAND = "substr(site, 1, strpos(site, '.') - 1)"
MARKUP = (
    """CASE p % 7 WHEN 0 THEN '<meta name="generator" content="WordPress 5.4.2">'
       WHEN 1 THEN '<meta name="generator" content="Drupal 11.1">'
       WHEN 2 THEN '<link href="/wp-content/themes/a.css">'
       WHEN 3 THEN '<script src="/js/jquery-3.4.1.min.js"></script>'
       WHEN 4 THEN '<script src="https://www.googletagmanager.com/gtag/js?id=G-ABC123"></script>'
       WHEN 5 THEN '<img src="http://cdn.example.com/x.js">' ELSE '' END""",
    """CASE WHEN p % 3 = 0 THEN '<meta name="viewport" content="width=device-width">'
       ELSE '' END""",
    """CASE WHEN p % 4 = 1 THEN '<a href="/privacy-policy">Privacy</a>' ELSE '' END""",
    """CASE WHEN p % 9 = 0 THEN '<div id="cookie-banner"></div>' ELSE '' END""",
    """CASE p % 5 WHEN 0 THEN '<a href="mailto:info@' || site || '?subject=Hi">Mail</a>'
       WHEN 1 THEN '<p>Write to sales@' || site || '.</p>'
       WHEN 2 THEN '<a href="mailto:jane.doe@' || site || '">Jane</a>'
       WHEN 3 THEN '<p>x@gmail.com</p>' ELSE '' END""",
    f"""CASE WHEN p % 4 = 0 THEN '<a href="tel:+44 20 7946 0' || {NUMBER} || '">Call</a>'
       ELSE '' END""",
    f"""CASE WHEN p % 6 = 4 THEN '<p>Call +1 (212) 555-0' || {NUMBER} || ' now</p>'
       ELSE '' END""",
    f"""CASE p % 6 WHEN 1 THEN '<a href="https://www.linkedin.com/company/' || {BRAND} || '/">In</a>'
       WHEN 2 THEN '<a href="https://twitter.com/intent/tweet">Share</a>'
       WHEN 3 THEN '<a href="https://twitter.com/' || {BRAND} || '">T</a>' ELSE '' END""",
    """CASE WHEN p % 8 = 3 THEN '<form action="/send"><input type="text" name="name">'
       || '<input type="email" name="mail"></form>' ELSE '' END""",
    """CASE p % 10 WHEN 4 THEN '<address>12 High Street<br>London</address>'
       WHEN 6 THEN '<div itemscope itemtype="https://schema.org/PostalAddress">'
       || '<span>9 Side Road</span> <span>Leeds</span></div>' ELSE '' END""",
)
ENRICHED = "html || " + " || ".join(MARKUP)

DAYS_LEFT = "((seed * 53) % 460 - 40)"
SITE_FIELDS = {
    "failed": "seed % 13 = 0",
    "has_tls": "seed % 9 <> 0",
    "protocol": "CASE seed % 4 WHEN 0 THEN 'TLSv1.3' WHEN 1 THEN 'TLSv1.2' "
                "WHEN 2 THEN 'TLSv1.1' END",
    "self_signed": "seed % 14 = 0",
    "chain_complete": "seed % 16 <> 0",
    "names_match": "seed % 15 <> 0",
    "starts_in_days": "CASE WHEN seed % 23 = 0 THEN 5 ELSE -30 END",
    "days_left": DAYS_LEFT,
    "has_dns": "seed % 8 <> 0",
    "spf": "CASE seed % 6 WHEN 0 THEN 'v=spf1 mx -all' WHEN 1 THEN 'v=spf1 mx ~all' "
           "WHEN 2 THEN 'v=spf1 ?all' WHEN 3 THEN 'v=spf1 +all' WHEN 4 THEN 'V=SPF1 mx' END",
    "dmarc": "CASE seed % 5 WHEN 0 THEN 'v=DMARC1; p=reject' "
             "WHEN 1 THEN 'v=DMARC1; p=quarantine' WHEN 2 THEN 'v=DMARC1; p=NONE' "
             "WHEN 3 THEN 'v=DMARC1; rua=mailto:a' END",
    "dnssec": "seed % 3 = 1",
    "mx": "CASE WHEN seed % 2 = 0 THEN '10 mail.' || site END",
    "dkim": "CASE WHEN seed % 3 = 0 THEN 'default' END",
    "lookup_failed": "CASE seed % 7 WHEN 1 THEN 'MX' WHEN 3 THEN 'TXT' WHEN 5 THEN 'DMARC' "
                     "WHEN 6 THEN 'DNSKEY' END",
    "n_cookies": "seed % 4",
    "cookie_secure": "seed % 3 = 0",
    "cookie_http_only": "seed % 2 = 0",
    "cookie_same_site": "CASE WHEN seed % 5 = 0 THEN 'Lax' END",
    "ttfb_ms": "CASE WHEN seed % 5 = 0 THEN 0 ELSE CAST(100 + (seed * 41) % 3400 AS INT) END",
}
COOKIE_NAMES = ("PHPSESSID", "c2", "csrftoken")
# A scan is the same captures with both numbers shifted and some sites left out.
SCANS = {
    "all": (0, "true"),
    "A": (0, "seed % 12 <> 5"),
    "B": (1, "seed % 11 <> 0"),
}


def spark_sql(formula: str) -> Column:
    return F.expr(formula.replace("strpos(", "instr(").replace("AS VARCHAR(20)", "AS STRING"))


def _numbered(spark: SparkSession, sf_dir: str, scan: str) -> DataFrame:
    shift, kept = SCANS[scan]
    host = F.regexp_extract("url", HOST, 1)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    named = pages.withColumn("host", host).withColumn("site", F.regexp_extract("host", SITE, 1))
    raw_seed = F.conv(F.substring(F.md5("site"), 1, 7), 16, 10).cast("bigint")
    numbered = named.withColumn("seed", raw_seed).where(F.expr(kept))
    return numbered.select(
        "site", "host", "url", "html",
        (F.col("seed") + shift).alias("seed"),
        (F.col("page_id") + shift).alias("p"),
    )


def captured_pages(spark: SparkSession, sf_dir: str, scan: str = "all") -> DataFrame:
    """One row per captured page. Failed captures have no pages."""
    from sitelens.functions.html import page_classify

    base = _numbered(spark, sf_dir, scan).where(~F.expr(SITE_FIELDS["failed"]))
    pairs = []
    for name, formula in HEADERS.items():
        pairs += [F.lit(name), spark_sql(formula)]
    return base.select(
        "site",
        F.col("p").alias("page_no"),
        "url",
        spark_sql(PAGE["final_url"]).alias("final_url"),
        spark_sql(PAGE["status"]).alias("status"),
        F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("headers"),
        spark_sql(ENRICHED).alias("html"),
        spark_sql(PAGE["bytes"]).alias("bytes"),
        spark_sql(PAGE["response_time_ms"]).alias("response_time_ms"),
    ).withColumn("page_type", page_classify(F.col("final_url")))


def _several(value: Column) -> Column:
    return F.array_compact(F.array(value))


def captured_sites(spark: SparkSession, sf_dir: str, scan: str = "all") -> DataFrame:
    """One row per site; reads only the addresses of the pages table."""
    pages = _numbered(spark, sf_dir, scan).select(
        "site", "seed", "p", spark_sql(PAGE["final_url"]).alias("final_url"))
    homes = pages.groupBy("site", "seed").agg(F.min_by("final_url", "p").alias("home_url"))
    f = {name: spark_sql(formula) for name, formula in SITE_FIELDS.items()}
    clock = F.lit(CLOCK).cast("timestamp")
    plain = F.concat(F.lit("http://"), "site", F.lit("/"))
    site = F.col("site")
    tls = F.struct(
        f["protocol"].alias("protocol"),
        F.lit("AES256").alias("cipher"),
        F.lit("Test CA").alias("issuer"),
        site.alias("subject"),
        F.array(site, F.concat(F.lit("*."), site)).alias("sans"),
        (clock + F.make_dt_interval(f["starts_in_days"])).alias("not_before"),
        (clock + F.make_dt_interval(f["days_left"].cast("int"))).alias("not_after"),
        f["self_signed"].alias("is_self_signed"),
        f["chain_complete"].alias("chain_complete"),
        f["names_match"].alias("hostname_matches"),
    )
    none = F.array().cast("array<string>")
    dns = F.struct(
        F.array(F.lit("93.184.216.34")).alias("a"),
        none.alias("aaaa"),
        _several(f["mx"]).alias("mx"),
        none.alias("ns"),
        F.array_compact(F.array(F.lit("site-verification=1"), f["spf"])).alias("txt"),
        F.lit(None).cast("string").alias("cname"),
        f["dmarc"].alias("dmarc"),
        _several(f["dkim"]).alias("dkim_selectors"),
        f["dnssec"].alias("dnssec"),
        F.lit("93.184.216.34").alias("resolved_ip"),
        _several(f["lookup_failed"]).alias("lookup_failed"),
    )
    cookies = [
        F.when(f["n_cookies"] >= n, F.struct(
            F.lit(name).alias("name"),
            f["cookie_secure"].alias("secure"),
            f["cookie_http_only"].alias("http_only"),
            f["cookie_same_site"].alias("same_site"),
            F.col("home_url").alias("source_url")))
        for n, name in enumerate(COOKIE_NAMES, start=1)
    ]
    failed, https = f["failed"], F.col("home_url").startswith("https://")
    return homes.select(
        "site",
        F.when(failed | (F.col("seed") % 2 == 0), plain).otherwise(F.col("home_url"))
        .alias("requested_url"),
        F.when(~failed, F.col("home_url")).alias("final_url"),
        F.when(failed, "failed").otherwise("complete").alias("status"),
        F.when(failed, "timeout").alias("failure_reason"),
        clock.alias("captured_at"),
        F.when(F.col("seed") % 4 == 0, F.array(plain)).otherwise(none).alias("redirect_chain"),
        F.when(~failed & https & f["has_tls"], tls).alias("tls"),
        F.when(f["has_dns"], dns).alias("dns"),
        F.when(~failed, F.array_compact(F.array(*cookies))).otherwise(
            F.array_compact(F.array(F.when(F.lit(False), cookies[0])))).alias("cookies"),
        F.struct(
            F.when(failed, 0).otherwise(f["ttfb_ms"]).alias("ttfb_ms"),
            F.when(failed, 0).otherwise(f["ttfb_ms"] + 50).alias("total_ms"),
        ).alias("timings"),
        "seed",
    )
