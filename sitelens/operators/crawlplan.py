"""Capture decisions as table work: links, robots rules, addresses, outcomes."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens import fixed
from sitelens.functions.columns import any_contains, found, top_rows
from sitelens.functions.html import page_classify, strip_tags, without_hidden
from sitelens.functions.urls import canonical_domain, join_url, url_path

ANCHOR_START = r"(?i)(?=<a\s)"
ANCHOR = r"(?is)^<a\s[^>]*?href\s*=\s*[^>]*>.*?(?:</a\s*>|\z)"
ANCHOR_HREF = r"""(?is)^<a\s[^>]*?href\s*=\s*["']?([^"'\s>]*)"""


# --- cookies and certificates -----------------------------------------------------------
def parse_cookie(header: Column) -> Column:
    """struct(name, secure, http_only, same_site) from one Set-Cookie header."""
    low = F.lower(header)
    return F.struct(
        F.trim(F.regexp_extract(header, r"^([^=;]*)", 1)).alias("name"),
        low.contains("secure").alias("secure"),
        low.contains("httponly").alias("http_only"),
        F.initcap(found(low, r"samesite=(strict|lax|none)", 1)).alias("same_site"),
    )


def cookie_dedupe(cookies: DataFrame, order: Column) -> DataFrame:
    """First cookie per (site, name)."""
    kept = [c for c in cookies.columns if c not in ("site", "name")]
    first = cookies.groupBy("site", "name").agg(
        F.min_by(F.struct(*kept), order).alias("c"))
    return first.select("site", "name", "c.*")


def hostname_matches(host: Column, subject: Column, sans: Column) -> Column:
    """Exact name or one ``*.`` wildcard among the certificate's names."""
    clean = lambda c: F.regexp_replace(F.lower(c), r"\.+$", "")
    dots = lambda c: F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))
    mine = clean(host)

    def fits(raw: Column) -> Column:
        name = clean(raw)
        wild = name.startswith("*.") & (dots(mine) >= dots(name) - 1)
        return (name == mine) | (wild & mine.endswith(F.substring(name, 2, F.length(name))))

    names = F.array_compact(F.concat(sans, F.array(subject)))
    return F.exists(names, fits)


# --- outcomes -------------------------------------------------------------------------------
def crawl_outcome(usable: Column, blocked: Column, robots_denied: Column, home_status: Column,
                  parked: Column) -> Column:
    """struct(status, reason): what a capture attempt amounts to."""
    outcome = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))
    return (
        F.when(~usable, outcome("failed", "dns_failure"))
        .when(blocked, outcome("failed", "blocked_address"))
        .when(robots_denied, outcome("failed", "robots_denied"))
        .when(home_status.isNull(), outcome("failed", "timeout"))
        .when(parked, outcome("partial", "parked_domain"))
        .when(home_status >= 500, outcome("complete", "http_5xx"))
        .when(home_status >= 400, outcome("complete", "http_4xx"))
        .otherwise(F.struct(F.lit("complete").alias("status"),
                            F.lit(None).cast("string").alias("reason")))
    )


# --- addresses ------------------------------------------------------------------------------
def ipv4_number(ip: Column) -> Column:
    """Address as a number; NULL when the text is no dotted quad."""
    part = lambda n: F.regexp_extract(ip, r"^(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})$", n)
    octets = [part(n).try_cast("bigint") for n in (1, 2, 3, 4)]
    valid = octets[0] <= 255
    for octet in octets[1:]:
        valid = valid & (octet <= 255)
    number = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(valid, number)


def ipv6_digits(ip: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address; null for what does not parse."""
    low = F.lower(ip)
    sides = F.split(low, "::", -1)
    groups = lambda side: F.filter(F.split(side, ":", -1), lambda g: side != "")
    head, tail = groups(F.get(sides, F.lit(0))), F.when(F.size(sides) == 2, groups(F.get(sides, F.lit(1)))).otherwise(
        F.array().cast("array<string>"))
    given = F.size(head) + F.size(tail)
    fits = F.when(F.size(sides) == 2, given <= 7).otherwise((F.size(sides) == 1) & (given == 8))
    proper = F.forall(F.concat(head, tail), lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    filled = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(8 - given, F.lit(0))), tail)
    return F.when(low.contains(":") & fits & proper, F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), ""))


DOTTED_TAIL = r"^(.*:)(\d{1,3}(?:\.\d{1,3}){3})$"
# an IPv4 address inside an IPv6 one (fixed values): mapped, and the prefix of translation
EMBEDDED = ("00000000000000000000ffff", "0064ff9b0000000000000000")


def hexadecimal_tail(ip: Column) -> Column:
    """An IPv6 address whose end is written as an IPv4 one, in groups throughout."""
    number = ipv4_number(F.regexp_extract(ip, DOTTED_TAIL, 2))
    groups = F.lower(F.concat(F.hex(F.shiftright(number, 16)), F.lit(":"), F.hex(number.bitwiseAND(65535))))
    return F.when(ip.rlike(DOTTED_TAIL), F.concat(F.regexp_extract(ip, DOTTED_TAIL, 1), groups)).otherwise(ip)


def is_public_address(ip: Column) -> Column:
    """False for the blocked ranges and for anything that is no address.

    An IPv4 address inside an IPv6 one is judged as itself, in either spelling.
    """
    def is_blocked(number: Column) -> Column:
        blocked = F.lit(False)
        for block in fixed.BLOCKED_IPV4:
            net = ipaddress.ip_network(block)
            blocked = blocked | number.between(int(net[0]), int(net[-1]))
        return blocked

    number, digits = ipv4_number(ip), ipv6_digits(hexadecimal_tail(ip))
    six_blocked = digits == "0" * 32
    for block in fixed.BLOCKED_IPV6:
        net = ipaddress.ip_network(block)
        first, last = (f"{int(end):032x}" for end in (net[0], net[-1]))
        six_blocked = six_blocked | digits.between(first, last)
    inner = F.when(F.substring(digits, 1, 24).isin(*EMBEDDED), F.conv(F.substring(digits, 25, 8), 16, 10).cast("bigint"))
    return F.when(number.isNotNull(), ~is_blocked(number)).when(inner.isNotNull(), ~is_blocked(inner)).when(
        digits.isNotNull(), ~six_blocked).otherwise(False)


def allowed_port(url: Column) -> Column:
    port = F.regexp_extract(url, r"^[^:/?#]*://(?:[^/?#]*@)?[^/?#:]*:(\d+)", 1).try_cast("int")
    usual = F.when(F.lower(url).startswith("https://"), 443).otherwise(80)
    return F.coalesce(port, usual).isin(*fixed.ALLOWED_PORTS)


# --- robots ----------------------------------------------------------------------------------
def rule_as_pattern(rule: Column) -> Column:
    """Robots path rule -> anchored regular expression."""
    quoted = F.regexp_replace(rule, r"([\\.\[\]{}()+?^|$])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"))


def robots_matches(path: Column, rule: Column) -> Column:
    """Prefix match; ``*`` spans anything; a closing ``$`` asks for equality."""
    return (
        F.when(F.coalesce(rule, F.lit("")) == "", F.lit(False))
        .when(rule.endswith("$"), path == F.substring(rule, 1, F.length(rule) - 1))
        .when(rule.contains("*"), F.regexp_like(path, rule_as_pattern(rule)))
        .otherwise(path.startswith(rule))
    )


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``allowed``: the longest matching rule decides, allow wins a tie.

    ``rules`` holds (site, verdict, rule). A plain rule matches the paths that it is a prefix
    of, so paths are dealt out as their prefixes and meet the rules by equality, however
    many a site has; rules that ask for the whole path meet it whole. Only rules with ``*``
    are tried one by one.
    """
    known = rules.where("rule <> ''").select("site", "verdict", "rule", F.length("rule").alias("size")).distinct()
    whole = known.where(F.col("rule").endswith("$"))
    starred = known.where(~F.col("rule").endswith("$") & F.col("rule").contains("*"))
    plain = known.where(~F.col("rule").endswith("$") & ~F.col("rule").contains("*"))
    path = F.regexp_replace(url_path(F.col("url")), "^$", "/")
    placed = urls.withColumn("path", path)
    paths = placed.select("site", "path").where("path IS NOT NULL").distinct()
    prefixes = paths.select("site", "path", F.explode(F.sequence(F.lit(1), F.length("path"))).alias("n")).select(
        "site", "path", F.expr("substring(path, 1, n)").alias("rule"))
    hits = prefixes.join(plain, ["site", "rule"]).select("site", "path", "verdict", "size").unionByName(
        paths.join(whole.withColumn("path", F.expr("substring(rule, 1, size - 1)")), ["site", "path"]).select(
            "site", "path", "verdict", "size")).unionByName(
        paths.join(starred, "site").where(robots_matches(F.col("path"), F.col("rule"))).select("site", "path", "verdict", "size"))
    longest = lambda verdict: F.coalesce(F.max(F.when(F.col("verdict") == verdict, F.col("size"))), F.lit(-1))
    denied = hits.groupBy("site", "path").agg(longest("allow").alias("yes"), longest("disallow").alias("no")).where(
        "no >= 0 AND yes < no").select("site", "path", F.lit(False).alias("allowed"))
    return placed.join(denied, ["site", "path"], "left").select(
        *urls.columns, F.coalesce("allowed", F.lit(True)).alias("allowed"))


ROBOTS_LINE = r"^\s*([A-Za-z-]+)\s*:\s*(.*?)\s*(?:#.*)?$"


def parse_robots(files: DataFrame, user_agent: str) -> DataFrame:
    """(site, body) -> one row per site with its rules for ``user_agent``.

    The lines of one file are an array inside its row, read in order by an
    aggregate; nothing is shuffled.
    """
    line = lambda text, n: F.regexp_extract(text, ROBOTS_LINE, n)
    lines = F.filter(F.split("body", r"\r\n|\r|\n"), lambda t: t.rlike(ROBOTS_LINE))
    parsed = F.transform(lines, lambda t: F.struct(
        F.lower(line(t, 1)).alias("field"), line(t, 2).alias("value")))
    agent_type = "array<struct<agent:string,field:string,value:string>>"
    zero = F.struct(F.lit(None).cast("string").alias("agent"),
                    F.array().cast(agent_type).alias("rows"))

    def step(acc: Column, entry: Column) -> Column:
        row = F.struct(acc["agent"].alias("agent"), entry["field"].alias("field"),
                       entry["value"].alias("value"))
        named = F.struct(F.lower(entry["value"]).alias("agent"), F.concat(acc["rows"], F.array(
            F.struct(F.lower(entry["value"]).alias("agent"), F.lit("group").alias("field"),
                     F.lit("").alias("value")))).alias("rows"))
        ruled = F.struct(acc["agent"].alias("agent"),
                         F.concat(acc["rows"], F.array(row)).alias("rows"))
        is_rule = entry["field"].isin("disallow", "allow", "crawl-delay") & acc["agent"].isNotNull()
        return F.when(entry["field"] == "user-agent", named).when(is_rule, ruled).otherwise(acc)

    ours = user_agent.lower().split("/")[0]
    staged = files.select("site", "body", parsed.alias("entries")).withColumn(
        "rows", F.aggregate("entries", zero, step, lambda acc: acc["rows"]))
    agents = F.transform("rows", lambda r: r["agent"])
    chosen = F.coalesce(
        F.get(F.filter(agents, lambda a: a.contains(ours)), F.lit(0)),
        F.get(F.filter(agents, lambda a: a == "*"), F.lit(0)))
    picked = staged.withColumn("agent", chosen)

    def values(field: str) -> Column:
        mine = F.filter("rows", lambda r: (
            (r["agent"] == F.col("agent")) & (r["field"] == field) & (r["value"] != "")))
        return F.coalesce(F.transform(mine, lambda r: r["value"]),
                          F.array().cast("array<string>"))

    delays = F.array_compact(F.transform(values("crawl-delay"), lambda v: v.try_cast("double")))
    maps = F.filter("entries", lambda e: (e["field"] == "sitemap") & (e["value"] != ""))
    return picked.select(
        "site", "agent", values("disallow").alias("disallowed"), values("allow").alias("allowed"),
        F.transform(maps, lambda e: e["value"]).alias("sitemaps"),
        F.get(delays, F.lit(0)).alias("crawl_delay"),
        (F.col("agent").isNotNull() | (F.trim("body") != "")).alias("exists"))


def robots_blocked() -> Column:
    """Everything is disallowed and nothing is allowed."""
    return F.array_contains("disallowed", "/") & (F.size("allowed") == 0)


# --- links and the plan of pages ------------------------------------------------------------------
def extract_links(pages: DataFrame, suffixes) -> DataFrame:
    """Anchors that hint at contact or legal pages of the same site."""
    # an anchor ends where the next one begins, so each part of the page is read once
    parts = F.split(without_hidden(F.col("html")), ANCHOR_START)
    one = pages.select("site", "page_no", F.col("final_url").alias("base"), F.explode(parts).alias("part")).select(
        "site", "page_no", "base", F.regexp_extract("part", ANCHOR, 0).alias("anchor")).where("anchor <> ''")
    href = F.regexp_extract("anchor", ANCHOR_HREF, 1)
    hay = F.concat(F.lower(F.col("href")), F.lit(" "), F.lower(strip_tags(F.col("anchor"))))
    hinted = one.withColumn("href", href).where(any_contains(hay, fixed.LINK_HINTS))
    target = hinted.withColumn("url", join_url(F.col("base"), F.col("href")))
    same = canonical_domain(F.col("url"), suffixes) == canonical_domain(F.col("base"), suffixes)
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    return target.where(same & (bare("url") != bare("base"))).select(
        "site", "page_no", "url", page_classify(F.col("url")).alias("page_type"))


def frontier_plan(homes: DataFrame, links: DataFrame, robots: DataFrame,
                  max_pages: int = fixed.MAX_PAGES_PER_SITE) -> DataFrame:
    """Pages to capture next: offered links and the usual paths, without what
    robots rules forbid, contact pages first, at most ``max_pages - 1`` a site."""
    usual = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("page_type"))
                      for p, t in fixed.CANDIDATE_PATHS])
    guessed = homes.select("site", "home_url", F.explode(usual).alias("g")).select(
        "site", join_url(F.col("home_url"), F.col("g.path")).alias("url"),
        F.col("g.page_type").alias("page_type"), F.lit(1).alias("source"))
    offered = links.select("site", "url", "page_type", F.lit(0).alias("source"))
    planned = offered.unionByName(guessed).groupBy("site", "url").agg(
        F.min_by("page_type", "source").alias("page_type"))
    allowed = robots_allowed(planned, robots).where("allowed")
    order = [(F.col("page_type") != "contact").asc(), F.col("url")]
    return top_rows(allowed, ["site"], order, max_pages - 1, "position").select(
        "site", "position", "url", "page_type")


def retention_purge(businesses: DataFrame, now: Column) -> DataFrame:
    """Clear provider fields past their expiry; the external id stays."""
    gone = F.col("source_expires_at").isNotNull() & (F.col("source_expires_at") < now)
    cleared = ("address", "source_phone", "category", "source_expires_at")
    return businesses.withColumns(
        {c: F.when(~gone, F.col(c)) for c in cleared if c in businesses.columns})
