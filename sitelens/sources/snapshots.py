"""Stored snapshots: nested JSON in, flat site and page tables out, and back.

A snapshot nests all pages of a site. The engine keeps them as two tables, so
no site is ever gathered into one row: reading explodes the pages, writing
stores page rows next to site rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.clock import ensure_utc
from sitelens.session import written

PAGE_COLUMNS = (
    "page_no bigint, url string, final_url string, status int, headers map<string,string>, "
    "html string, text string, content_hash string, bytes bigint, response_time_ms int, "
    "page_type string"
)
PAGE = f"struct<{PAGE_COLUMNS}>"
COOKIES = (
    "array<struct<name:string,secure:boolean,http_only:boolean,same_site:string,"
    "source_url:string>>"
)
SNAPSHOT = f"""
domain string, requested_url string, final_url string, status string, captured_at string,
http_status int, render_mode string, redirect_chain array<string>, failure_reason string,
failure_detail string, pages array<{PAGE}>,
tls struct<protocol:string,cipher:string,issuer:string,subject:string,sans:array<string>,
  not_before:string,not_after:string,is_self_signed:boolean,chain_complete:boolean,
  hostname_matches:boolean>,
dns struct<a:array<string>,aaaa:array<string>,mx:array<string>,ns:array<string>,
  txt:array<string>,cname:string,dmarc:string,dkim_selectors:array<string>,dnssec:boolean,
  resolved_ip:string,lookup_failed:array<string>>,
cookies {COOKIES},
robots struct<exists:boolean,disallowed_paths:array<string>,sitemaps:array<string>,
  blocked_us:boolean>,
timings struct<dns_ms:int,connect_ms:int,ttfb_ms:int,total_ms:int>, duration_ms int,
schema_version int
"""


def _list(column: str) -> Column:
    return F.array_compact(F.coalesce(F.col(column), F.array().cast("array<string>")))


def _flag(column: str, default: bool) -> Column:
    return F.coalesce(F.col(column), F.lit(default))


def complete_sites(raw: DataFrame) -> DataFrame:
    """Site rows with the defaults of absent keys filled in."""
    tls = F.struct(
        "tls.protocol", "tls.cipher", "tls.issuer", "tls.subject", _list("tls.sans").alias("sans"),
        ensure_utc(F.col("tls.not_before")).alias("not_before"),
        ensure_utc(F.col("tls.not_after")).alias("not_after"),
        _flag("tls.is_self_signed", False).alias("is_self_signed"),
        _flag("tls.chain_complete", True).alias("chain_complete"),
        _flag("tls.hostname_matches", True).alias("hostname_matches"))
    lists = ("a", "aaaa", "mx", "ns", "txt", "dkim_selectors", "lookup_failed")
    dns = F.struct(
        *[_list(f"dns.{k}").alias(k) for k in lists], "dns.cname", "dns.dmarc",
        _flag("dns.dnssec", False).alias("dnssec"), "dns.resolved_ip")
    cookies = F.transform("cookies", lambda c: F.struct(
        c["name"].alias("name"), F.coalesce(c["secure"], F.lit(False)).alias("secure"),
        F.coalesce(c["http_only"], F.lit(False)).alias("http_only"),
        c["same_site"].alias("same_site"),
        F.coalesce(c["source_url"], F.lit("")).alias("source_url")))
    zero = lambda k: F.coalesce(F.col(f"timings.{k}"), F.lit(0)).alias(k)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp")
    return raw.select(
        F.col("domain").alias("site"), "requested_url",
        F.nullif(F.col("final_url"), F.lit("")).alias("final_url"), "status",
        F.coalesce(ensure_utc(F.col("captured_at")), epoch).alias("captured_at"), "http_status",
        F.coalesce("render_mode", F.lit("http")).alias("render_mode"),
        _list("redirect_chain").alias("redirect_chain"),
        F.nullif(F.col("failure_reason"), F.lit("")).alias("failure_reason"), "failure_detail",
        F.when(F.col("tls").isNotNull(), tls).alias("tls"),
        F.when(F.col("dns").isNotNull(), dns).alias("dns"),
        F.coalesce(cookies, F.array().cast(COOKIES)).alias("cookies"),
        "robots", F.struct(*map(zero, ("dns_ms", "connect_ms", "ttfb_ms", "total_ms")))
        .alias("timings"),
        F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"),
        F.coalesce("schema_version", F.lit(1)).alias("schema_version"))


def complete_pages(raw: DataFrame) -> DataFrame:
    """One row per page, in the order of the array, header names in lower case."""
    pages = raw.select(F.col("domain").alias("site"), F.posexplode("pages").alias("at", "p"))
    text = lambda k: F.coalesce(F.col(f"p.{k}"), F.lit("")).alias(k)
    number = lambda k, t: F.coalesce(F.col(f"p.{k}"), F.lit(0)).cast(t).alias(k)
    none = F.create_map().cast("map<string,string>")
    return pages.select(
        "site", F.coalesce("p.page_no", F.col("at") + 1).cast("bigint").alias("page_no"), "p.url",
        F.coalesce("p.final_url", "p.url").alias("final_url"), number("status", "int"),
        F.coalesce(F.transform_keys("p.headers", lambda k, _: F.lower(k)), none).alias("headers"),
        text("html"), text("text"), text("content_hash"), number("bytes", "bigint"),
        number("response_time_ms", "int"),
        F.coalesce("p.page_type", F.lit("other")).alias("page_type"))


def parse_snapshots(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sites, pages) from rows of the snapshot schema."""
    return complete_sites(raw), complete_pages(raw)


def read_snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_snapshots(spark.read.schema(SNAPSHOT).json(path))


VERSION = 1
PAGES_PER_DOCUMENT = 200


class Snapshots(NamedTuple):
    """What a folder of snapshot files holds: usable sites and pages, and the documents that are not."""

    sites: DataFrame
    pages: DataFrame
    rejects: DataFrame  # document, reason


def read_documents(spark: SparkSession, path: str) -> Snapshots:
    """Nested documents, one a line. Absent keys get their defaults.

    A document that is no JSON, has no domain or is of a newer version is rejected with a
    reason. A site may come in several documents with parts of its pages; its own fields
    are those of the latest capture (on ties the greatest document counts).
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    read = lines.select("value", F.from_json("value", SNAPSHOT + ", _corrupt string", {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("s"))
    reason = (
        F.when(F.col("s").isNull() | F.col("s._corrupt").isNotNull(), "not a snapshot document")
        .when(F.coalesce(F.trim("s.domain"), F.lit("")) == "", "no domain")
        .when(F.coalesce("s.schema_version", F.lit(VERSION)) > VERSION, F.concat(F.lit("version "), F.col("s.schema_version").cast("string")))
    )
    judged = written(read.withColumn("reason", reason), "documents")
    good = judged.where("reason IS NULL").select("value", "s.*").drop("_corrupt")
    sites = complete_sites(good.withColumn("pages", F.lit(None).cast(f"array<{PAGE}>")).groupBy("domain").agg(
        F.max_by(F.struct(*[c for c in good.columns if c not in ("domain", "pages", "value")]), F.struct("captured_at", "value")).alias("r"))
        .select("domain", "r.*"))
    return Snapshots(sites, complete_pages(good), judged.where("reason IS NOT NULL").select(F.col("value").alias("document"), "reason"))


def write_documents(sites: DataFrame, pages: DataFrame, path: str, per_document: int = PAGES_PER_DOCUMENT) -> None:
    """Nested documents, one a line. The pages of a site are dealt to as many documents as it
    takes for each to hold about ``per_document``, so no site is gathered into one row."""
    names = [c.split()[0] for c in PAGE_COLUMNS.split(", ")]
    parts = pages.groupBy("site").agg(F.ceil(F.count(F.lit(1)) / per_document).cast("int").alias("parts"))
    page = F.struct(*[F.col(c) for c in names if c in pages.columns])
    dealt = pages.join(parts, "site").groupBy("site", F.pmod(F.xxhash64("page_no"), "parts").alias("part")).agg(
        F.collect_list(page).alias("pages"))
    form = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"}
    document = F.struct(F.col("site").alias("domain"), *[F.col(c) for c in sites.columns if c != "site"], "pages")
    sites.join(dealt, "site", "left").select(F.to_json(document, form).alias("value")).write.text(path)


def site_payload() -> Column:
    """A site row as JSON; timestamps in ISO form, absent values left out."""
    return F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"})


def write_snapshots(sites: DataFrame, pages: DataFrame, path: str) -> None:
    """Site rows and page rows as two JSON tables under ``path``."""
    form = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"}
    sites.write.options(**form).json(f"{path}/sites")
    pages.write.json(f"{path}/pages")


def read_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What ``write_snapshots`` stored, as (sites, pages)."""
    raw = spark.read.schema(SNAPSHOT + ", site string").json(f"{path}/sites")
    sites = complete_sites(raw.withColumn("domain", F.col("site")).drop("site"))
    pages = spark.read.schema(f"site string, {PAGE_COLUMNS}").json(f"{path}/pages")
    return sites, pages
