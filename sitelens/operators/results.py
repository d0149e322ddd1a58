"""Result tables: listing, export, report sections, comparison, upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens import fixed
from sitelens.functions.clock import iso_z
from sitelens.operators import checks
from sitelens.operators.scores import SCORES


# --- listing ----------------------------------------------------------------------------
def result_ok(status: Column) -> Column:
    return F.coalesce(status != "failed", F.lit(False))


def severity_count(severity: str, statuses) -> Column:
    """How many findings of the site's row have a severity and a status."""
    return F.size(F.filter("findings", lambda f: (
        (f["severity"] == severity) & f["status"].isin(*statuses))))


def result_rows(frame: DataFrame, businesses: DataFrame) -> DataFrame:
    """One listing row per business; everything comes from the site's row."""
    rows = businesses.join(frame, "site", "left")
    top = F.get(F.col("opportunities"), F.lit(0))
    return rows.select(
        "site", "scan_id", "name", "domain", "website_url", "city", "country_code",
        businesses["business_status"], "primary_email", "primary_phone",
        F.coalesce("n_contacts", F.lit(0)).alias("contact_count"),
        *[F.col(f"scores.{s}.total").alias(f"{s}_score") for s in SCORES],
        F.transform("technologies", lambda t: t["name"]).alias("top_technologies"),
        F.coalesce(F.size("opportunities"), F.lit(0)).alias("opportunity_count"),
        top["rule_id"].alias("top_rule"), top["title"].alias("top_title"),
        severity_count("critical", fixed.PROBLEM_STATUSES).alias("critical_findings"),
        severity_count("high", fixed.PROBLEM_STATUSES).alias("high_findings"),
    )


def result_list(rows: DataFrame, *, sort: str = "opportunity_score", descending: bool = True,
                status: str = "completed", has_contact: bool | None = None,
                min_opportunity: int | None = None, limit: int = 100,
                offset: int = 0) -> DataFrame:
    """A page of the listing. NULL scores come last in either direction, and
    the score filter applies whatever the sort column."""
    kept = rows if status == "all" else rows.where(F.col("business_status") == status)
    if has_contact is not None:
        known = F.col("primary_email").isNotNull()
        kept = kept.where(known if has_contact else ~known)
    if min_opportunity is not None:
        kept = kept.where(F.col("opportunity_score") >= min_opportunity)
    column = F.col(sort)
    order = column.desc_nulls_last() if descending else column.asc_nulls_last()
    return kept.orderBy(order, "site").offset(offset).limit(limit)


def rank_by_score(frame: DataFrame, score: str = "opportunity") -> DataFrame:
    """Successful sites, best first; a missing score sorts as -1."""
    value = F.coalesce(F.col(f"scores.{score}.total"), F.lit(-1))
    return frame.where(result_ok(F.col("status"))).select("site", value.alias("score")).orderBy(
        F.col("score").desc(), "site")


# --- export ------------------------------------------------------------------------------
def formula_guard(value: Column) -> Column:
    """Text that a spreadsheet will not run as a formula."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(fixed.FORMULA_PREFIX_PATTERN), F.concat(F.lit("'"), text)).otherwise(
        text)


def scrub(value: Column) -> Column:
    """Text without NUL characters."""
    return F.replace(value, F.lit("\x00"), F.lit(""))


def scrub_all(df: DataFrame) -> DataFrame:
    """Remove NULs from every text and text map; times become ISO text."""
    out = {}
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind == "string":
            out[field.name] = scrub(F.col(field.name))
        elif kind == "array<string>":
            out[field.name] = F.transform(field.name, scrub)
        elif kind == "map<string,string>":
            out[field.name] = F.transform_values(
                F.transform_keys(field.name, lambda k, _: scrub(k)), lambda _, v: scrub(v))
        elif kind == "timestamp":
            out[field.name] = iso_z(F.col(field.name))
    return df.withColumns(out) if out else df


def yes_no_unknown(record: Column, lookup: str) -> Column:
    """no only when the lookup answered; otherwise unknown."""
    failed = F.array_contains("dns.lookup_failed", lookup)
    return (
        F.when(F.coalesce(record, F.lit("")) != "", "yes")
        .when(F.coalesce(failed, F.lit(False)), "unknown").otherwise("no")
    )


def contact_columns(contacts: DataFrame) -> DataFrame:
    """Contact cells per site.

    First-of-kind cells are minima, combined before the shuffle. The e-mail
    list is one cell of the export and holds each own-domain address once.
    """
    order = F.struct("rank", "normalized_value")
    kind = lambda k: F.col("kind") == k
    first = lambda test: F.min_by(F.when(test, F.col("value")), F.when(test, order))
    networks = {n: first(kind("social") & (F.col("category") == n))
                for n in ("linkedin", "facebook", "twitter", "instagram")}
    mails = F.array_sort(F.collect_list(F.when(kind("email"), F.struct(
        "rank", "normalized_value", "value"))))
    return contacts.groupBy("site").agg(
        F.array_join(F.transform(mails, lambda m: m["value"]), "; ").alias("all_emails"),
        first(kind("address")).alias("address"),
        first(kind("form")).alias("contact_form_url"),
        *[c.alias(n) for n, c in networks.items()])


def first_of_category(category: str) -> Column:
    return F.get(F.transform(F.filter("technologies", lambda t: t["category"] == category),
                             lambda t: t["name"]), F.lit(0))


def names_of_category(category: str | None = None) -> Column:
    kept = F.col("technologies") if category is None else F.filter(
        "technologies", lambda t: t["category"] == category)
    return F.array_join(F.transform(kept, lambda t: t["name"]), "; ")


def export_rows(frame: DataFrame, businesses: DataFrame, contacts: DataFrame) -> DataFrame:
    """The flat export: one guarded text row per business, failed ones too."""
    rows = businesses.join(frame, "site", "left").join(contact_columns(contacts), "site", "left")
    yes = lambda test: F.when(F.coalesce(test, F.lit(False)), "yes").otherwise("no")
    outdated = F.col("cms.is_outdated")
    https = F.col("is_https") & F.col("tls").isNotNull()
    header = lambda h: F.coalesce(F.element_at("home.headers", h), F.lit("")) != ""
    titles = F.transform("opportunities", lambda o: o["title"])
    days = F.nullif(F.col("days_left"), F.lit(0))
    cells = {
        "business_name": F.col("name"), "website": F.col("website_url"),
        "domain": F.col("domain"), "city": F.col("city"), "country": F.col("country_code"),
        "status": F.when(result_ok(F.col("status")), "completed").otherwise(
            F.coalesce("failure_reason", F.lit("failed"))),
        "primary_email": F.col("primary_email"), "all_emails": F.col("all_emails"),
        "phone": F.col("primary_phone"), "address": F.col("address"),
        "linkedin": F.col("linkedin"), "facebook": F.col("facebook"),
        "twitter": F.col("twitter"), "instagram": F.col("instagram"),
        "contact_form_url": F.col("contact_form_url"),
        "cms": F.col("cms.name"), "cms_version": F.col("cms.version"),
        "cms_outdated": F.when(outdated, "yes").when(~outdated, "no").otherwise("unknown"),
        "server": first_of_category("server"), "cdn": first_of_category("cdn"),
        "analytics": names_of_category("analytics"), "technologies": names_of_category(),
        "has_ssl": yes(F.col("is_https")), "ssl_expires_at": F.when(https, F.col("until")),
        "ssl_days_remaining": F.when(https, days),
        "tls_version": F.when(https, F.col("tls.protocol")),
        "has_hsts": yes(F.col("home_ok") & header("strict-transport-security")),
        "has_csp": yes(F.col("home_ok") & header("content-security-policy")),
        "has_spf": yes_no_unknown(F.col("spf"), "TXT"),
        "has_dmarc": yes_no_unknown(F.col("dns.dmarc"), "DMARC"),
        "dmarc_policy": F.col("policy"),
        "missing_headers_count": F.when(F.col("home_ok"), F.size("missing")).otherwise(0),
        "critical_findings": severity_count("critical", ["fail"]),
        "high_findings": severity_count("high", ["fail"]),
        **{f"{s}_score": F.col(f"scores.{s}.total") for s in SCORES},
        "opportunity_count": F.size("opportunities"),
        "top_opportunity": F.get(titles, F.lit(0)),
        "opportunities": F.array_join(titles, " | "),
        "scanned_at": F.col("now"),
    }
    return rows.select(*[formula_guard(cells[c]).alias(c) for c in fixed.EXPORT_COLUMNS])


def write_export(rows: DataFrame, path: str) -> None:
    """CSV files with a byte-order mark before the header, as spreadsheets ask."""
    marked = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    marked.write.option("header", True).option("quoteAll", False).option(
        "escape", '"').option("lineSep", "\r\n").csv(path)


# --- reports -------------------------------------------------------------------------------
def scan_summary(frame: DataFrame, businesses: DataFrame) -> DataFrame:
    """Successful sites by opportunity score."""
    rows = businesses.join(frame, "site").where(result_ok(F.col("status")))
    dash = lambda c: F.coalesce(c, F.lit("-"))
    title = F.get(F.transform("opportunities", lambda o: o["title"]), F.lit(0))
    return rows.select(
        "site", dash(F.col("name")).alias("business"),
        F.col("scores.opportunity.total").alias("opportunity"),
        F.col("scores.security.total").alias("security"),
        F.col("scores.lead.total").alias("lead"),
        dash(F.col("primary_email")).alias("contact"),
        dash(title).alias("top_opportunity"),
    ).orderBy(F.col("opportunity").desc(), "site")


def summary_totals(frame: DataFrame) -> DataFrame:
    ok = result_ok(F.col("status"))
    return frame.agg(
        F.count_if(ok).alias("analyzed"), F.count("*").alias("total"),
        F.coalesce(F.sum(F.when(ok, F.size("opportunities"))), F.lit(0)).alias("opportunities"))


def site_report(frame: DataFrame, contacts: DataFrame) -> DataFrame:
    """Report rows (site, section, position, label, detail) of successful sites."""
    ok = frame.where(result_ok(F.col("status")))

    def section(name: str, column: Column, label, detail) -> DataFrame:
        rows = ok.select("site", F.posexplode_outer(column).alias("at", "x"))
        return rows.where("x is not null").select(
            "site", F.lit(name).alias("section"), (F.col("at") + 1).alias("position"),
            label(F.col("x")).alias("label"), detail(F.col("x")).alias("detail"))

    def proof(f: Column) -> Column:
        scalars = F.filter(F.map_entries(f["evidence"]),
                           lambda e: ~e["key"].isin(*checks.LIST_EVIDENCE))
        return F.array_join(F.array_sort(F.transform(
            scalars, lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "; ")

    version = lambda t: F.concat(F.coalesce(t["version"], F.lit("-")), F.when(
        t["is_outdated"], " (outdated)").otherwise(""))
    order = Window.partitionBy("site").orderBy("kind", "rank", "normalized_value")
    listed = contacts.withColumn("position", F.row_number().over(order))
    named = listed.join(ok.select("site"), "site", "left_semi").select(
        "site", F.lit("contacts").alias("section"), "position",
        F.col("category").alias("label"), F.col("value").alias("detail"))
    problems = F.filter("findings", lambda f: f["status"].isin(*fixed.PROBLEM_STATUSES))
    return (
        section("opportunities", F.col("opportunities"), lambda o: o["urgency"],
                lambda o: o["title"])
        .unionByName(named)
        .unionByName(section("technologies", F.col("technologies"),
                             lambda t: t["name"], version))
        .unionByName(section("findings", problems, lambda f: f["check_id"], proof))
    )


# --- comparison ---------------------------------------------------------------------------------
def scan_summaries(frame: DataFrame) -> DataFrame:
    """Per domain: scores, sorted rule ids, sorted technology names."""
    return frame.where(F.col("site").isNotNull()).select(
        F.col("site").alias("domain"),
        *[F.col(f"scores.{s}.total").alias(s) for s in SCORES],
        F.array_sort(F.transform("opportunities", lambda o: o["rule_id"])).alias("rules"),
        F.array_sort(F.transform("technologies", lambda t: t["name"])).alias("technologies"))


def compare_scans(before: DataFrame, after: DataFrame) -> DataFrame:
    """Full outer join of two summaries by domain."""
    old = before.select(F.col("domain"), F.struct(*before.columns).alias("old"))
    new = after.select(F.col("domain"), F.struct(*after.columns).alias("new"))
    both = old.join(new, "domain", "full_outer")
    minus = lambda a, b: F.array_sort(F.array_except(a, b))
    delta = {f"{s}_change": F.col(f"new.{s}") - F.col(f"old.{s}") for s in SCORES}
    sets = {
        "opportunities_gained": minus(F.col("new.rules"), F.col("old.rules")),
        "opportunities_resolved": minus(F.col("old.rules"), F.col("new.rules")),
        "technologies_added": minus(F.col("new.technologies"), F.col("old.technologies")),
        "technologies_removed": minus(F.col("old.technologies"), F.col("new.technologies")),
    }
    compared = both.select(
        "domain", F.col("old").isNull().alias("is_new"), F.col("new").isNull().alias("is_gone"),
        *[F.col(f"old.{s}").alias(f"{s}_before") for s in SCORES],
        *[F.col(f"new.{s}").alias(f"{s}_after") for s in SCORES],
        *[c.alias(n) for n, c in {**delta, **sets}.items()])
    moved = F.lit(False)
    for name in sets:
        moved = moved | (F.size(name) > 0)
    for name in delta:
        moved = moved | (F.coalesce(F.col(name), F.lit(0)) != 0)
    state = (
        F.when(F.col("is_new"), "added").when(F.col("is_gone"), "removed")
        .when(F.coalesce(moved, F.lit(False)), "changed").otherwise("unchanged")
    )
    return compared.withColumn("state", state).drop("is_new", "is_gone")


STATE_ORDER = ("changed", "added", "removed", "unchanged")


def compare_order() -> list[Column]:
    rank = F.array_position(F.array(*map(F.lit, STATE_ORDER)), F.col("state"))
    return [rank, F.col("domain")]


# --- upkeep ------------------------------------------------------------------------------------
def upsert(stored: DataFrame, fresh: DataFrame, keys=("site",)) -> DataFrame:
    """Replace all stored rows of the sites in ``fresh``; idempotent."""
    replaced = fresh.select(*keys).distinct()
    return stored.join(replaced, list(keys), "left_anti").unionByName(fresh)


def write_result(table: DataFrame, path: str) -> None:
    """Store a result table by scan; a scan written again replaces itself."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "scan_id").parquet(path)


def cascade_delete(table: DataFrame, scans: DataFrame) -> DataFrame:
    return table.join(scans.select("scan_id").distinct(), "scan_id", "left_anti")


def violations(rows: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """How many keys occur more than once."""
    return rows.groupBy(*keys).count().where("count > 1").agg(
        F.lit(rule).alias("rule"), F.count("*").alias("violations")).select("rule", "violations")


def range_violations(rows: DataFrame, test: Column, rule: str) -> DataFrame:
    return rows.agg(F.count_if(~test).alias("violations")).select(
        F.lit(rule).alias("rule"), "violations")


def scan_progress(businesses: DataFrame, keys: list[str]) -> DataFrame:
    """Counts recomputed from the rows, so they cannot drift."""
    done = F.col("status") == "completed"
    lost = F.col("status").isin("failed", "no_website")
    counted = businesses.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(done).alias("completed"),
        F.count_if(lost).alias("failed"))
    share = F.floor((F.col("completed") + F.col("failed")) / F.col("total") * 100)
    return counted.withColumn("percent", F.when(F.col("total") > 0, F.least(
        F.lit(100), share.cast("int"))).otherwise(0))
