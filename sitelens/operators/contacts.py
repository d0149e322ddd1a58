"""Published contacts: found per page, deduplicated per site, never invented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens import fixed
from sitelens.functions.columns import all_found, first_where, let, literal_map, top_rows
from sitelens.functions.html import element_text, strip_tags, unescape, without_hidden
from sitelens.functions.urls import join_url, registrable

CONTACT = "struct<kind:string,category:string,value:string,normalized_value:string,rank:int,pos:int>"
HREF = r"""(?is)<a\s[^>]*?href\s*=\s*["']?\s*%s([^"'\s>]*)"""
FORM_BLOCK = r"(?is)<form\b[^>]*>.*?(?:</form\s*>|$)"
FORM_INPUT = r"(?is)<(?:input|textarea)\b[^>]*>"
POSTAL_OPEN = r"""(?is)<([A-Za-z][A-Za-z0-9]*)\b[^>]*itemtype\s*=\s*["'][^"']*PostalAddress[^>]*>"""
ADDRESS_OPEN = r"(?is)<(address)\b[^>]*>"
PHONE_TEXT = r"\+\d[\d ().\x{00A0}/-]{5,24}\d"


def _none() -> Column:
    return F.array().cast(f"array<{CONTACT}>")


def _contact(kind, category, value, normalized, rank, pos) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        lit(kind).alias("kind"), lit(category).alias("category"), lit(value).alias("value"),
        lit(normalized).alias("normalized_value"), lit(rank).cast("int").alias("rank"),
        lit(pos).cast("int").alias("pos"),
    )


def _links(html: Column, scheme: str, pattern: str) -> Column:
    """Link targets after ``scheme``; the pattern runs only where it occurs."""
    possible = F.contains(F.lower(html), F.lit(scheme))
    return F.when(possible, all_found(html, pattern, 1)).otherwise(
        F.array().cast("array<string>"))


# --- e-mail -------------------------------------------------------------------------
def email_candidates(html: Column) -> Column:
    """mailto links first, then everything in the source shaped like an address."""
    links = F.transform(_links(html, "mailto:", HREF % "mailto:"),
                        lambda a: F.trim(unescape(F.substring_index(a, "?", 1))))
    shaped = all_found(html, fixed.EMAIL_SCAN_PATTERN)
    clean = F.transform(F.concat(links, shaped),
                        lambda a: F.lower(F.btrim(F.trim(a), F.lit(".,;:"))))
    return F.filter(clean, lambda a: a.rlike(f"^(?:{fixed.EMAIL_PATTERN})$"))


def email_domain(address: Column) -> Column:
    return F.substring(address, F.instr(address, "@") + 1, F.length(address))


def email_local(address: Column) -> Column:
    return F.substring_index(address, "@", 1)


def email_head(address: Column) -> Column:
    return F.regexp_extract(email_local(address), r"^([^._\-+]*)", 1)


def email_owner(address: Column, suffixes) -> Column:
    return registrable(email_domain(address), suffixes)


def is_business_email(address: Column, owner: Column,
                      placeholders=fixed.PLACEHOLDER_DOMAINS) -> Column:
    """``owner`` is the registrable domain behind the address."""
    personal = email_local(address).rlike(fixed.PERSONAL_LOCAL_PATTERN)
    role = email_head(address).isin(*fixed.ROLE_CATEGORIES)
    return (
        owner.isNotNull()
        & ~owner.isin(*placeholders) & ~email_domain(address).isin(*placeholders)
        & ~owner.isin(*fixed.FREEMAIL_DOMAINS)
        & ~address.rlike(fixed.ASSET_NAME_PATTERN)
        & ~(personal & ~role)
    )


def belongs_to(owner: Column, site: Column) -> Column:
    """The site's own domain, or one with the same first label."""
    brand = lambda d: F.lower(F.substring_index(d, ".", 1))
    return F.coalesce((owner == site) | (brand(owner) == brand(site)), F.lit(False))


def email_category(address: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(fixed.ROLE_CATEGORIES), email_head(address)), F.lit("other"))


def email_rank(category: Column) -> Column:
    return F.element_at(literal_map(fixed.CATEGORY_RANK, "int"), category)


def _emails(suffixes, placeholders) -> Column:
    owned = F.transform(
        F.array_distinct(email_candidates(F.col("html"))),
        lambda a: F.struct(a.alias("a"), email_owner(a, suffixes).alias("owner")))
    kept = F.filter(owned, lambda e: (
        is_business_email(e["a"], e["owner"], placeholders)
        & belongs_to(e["owner"], F.col("site"))))
    rows = F.transform(kept, lambda e, i: let(email_category(e["a"]), lambda c: _contact(
        "email", c, e["a"], e["a"], email_rank(c), i)))
    return F.when(F.col("html").contains("@"), rows).otherwise(_none())


# --- telephone -------------------------------------------------------------------------
def normalize_phone(raw: Column, dial_plan: dict | None = None) -> Column:
    """E.164 text, or NULL when the number has no country code or a wrong length."""
    entries = {code: dict(zip(("low", "high", "trunk"), entry))
               for code, entry in (dial_plan or fixed.DIAL_PLAN).items()}
    plan = literal_map(entries, "struct<low:int,high:int,trunk:string>")
    rest = lambda text, n: F.substring(text, n + 1, F.length(text))

    def parsed(digits: Column) -> Column:
        codes = F.array(*[F.substring(digits, 1, n) for n in (1, 2, 3)])
        return let(F.struct(
            digits.alias("digits"),
            F.get(F.filter(codes, lambda c: F.map_contains_key(plan, c)), F.lit(0)).alias("code"),
        ), dialled)

    def dialled(n: Column) -> Column:
        return let(F.struct(
            n["code"].alias("code"), F.element_at(plan, n["code"]).alias("entry"),
            rest(n["digits"], F.length(n["code"])).alias("national")), checked)

    def checked(n: Column) -> Column:
        trunk = n["entry"]["trunk"]
        bare = F.when((trunk != "") & n["national"].startswith(trunk),
                      rest(n["national"], F.length(trunk))).otherwise(n["national"])
        return let(bare, lambda b: F.when(
            F.length(b).between(n["entry"]["low"], n["entry"]["high"]),
            F.concat(F.lit("+"), n["code"], b)))

    digits = F.regexp_replace(raw, r"\D", "")
    dialable = F.regexp_replace(raw, r"[^\d+]", "").startswith("+")
    return let(F.when(dialable, digits), parsed)


def phone_candidates(html: Column) -> Column:
    links = _links(html, "tel:", r"""(?is)<a\s[^>]*?href\s*=\s*["']\s*tel:([^"']*)""")
    shaped = F.when(html.rlike(r"\+(?:<[^>]*>)*\d"), all_found(
        strip_tags(without_hidden(html)), PHONE_TEXT)).otherwise(F.array().cast("array<string>"))
    return F.concat(links, shaped)


def _phones(dial_plan) -> Column:
    numbers = F.array_distinct(F.array_compact(F.transform(
        phone_candidates(F.col("html")), lambda n: normalize_phone(n, dial_plan))))
    rows = F.transform(numbers, lambda n, i: _contact("phone", "general", n, n, 10, i))
    possible = F.col("low").contains("tel:") | F.col("html").contains("+")
    return F.when(possible, rows).otherwise(_none())


# --- social profiles ----------------------------------------------------------------------
def social_links(html: Column) -> Column:
    """array<struct(category, url)> in network order, share and login links dropped."""
    def links(category: str, pattern: str) -> Column:
        kept = F.filter(all_found(html, pattern), lambda u: ~u.rlike(fixed.SOCIAL_NOISE_PATTERN))
        host = F.lower(html).contains("x.com/" if category == "twitter" else f"{category}.com/")
        if category == "twitter":
            host = host | F.lower(html).contains("twitter.com/")
        kept = F.when(host, kept).otherwise(F.array().cast("array<string>"))
        return F.transform(kept, lambda u: F.struct(
            F.lit(category).alias("category"), u.alias("url")))

    return F.concat(*[links(*network) for network in fixed.SOCIAL_PATTERNS])


def social_normal(url: Column) -> Column:
    return F.regexp_replace(F.lower(url), "/+$", "")


def _socials() -> Column:
    rows = F.transform(social_links(F.col("html")), lambda s, i: _contact(
        "social", s["category"], F.concat(F.lit("https://"), s["url"]),
        social_normal(s["url"]), 40, i))
    low = F.col("low")
    possible = F.lit(False)
    for site in ("linkedin.com/", "facebook.com/", "twitter.com/", "x.com/", "instagram.com/",
                 "youtube.com/"):
        possible = possible | low.contains(site)
    return F.when(possible, rows).otherwise(_none())


# --- forms and addresses --------------------------------------------------------------------
def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?is)\s{name}\s*=\s*["']?([^"'\s>]*)"""
    return F.lower(F.regexp_extract(tag, pattern, 1))


def contact_form(html: Column, base: Column) -> Column:
    """Target of the first form with an e-mail or message field and two inputs."""
    def qualifies(form: Column) -> Column:
        inputs = all_found(form, FORM_INPUT)
        mail = F.exists(inputs, lambda t: (
            (_attribute(t, "type") == "email") | _attribute(t, "name").contains("email")
            | _attribute(t, "name").contains("message")))
        return mail & (F.size(inputs) >= 2)

    def target(form: Column) -> Column:
        action = F.regexp_extract(
            form, r"""(?is)^<form\b[^>]*?\saction\s*=\s*["']?([^"'\s>]*)""", 1)
        return F.when(form.isNotNull(), F.coalesce(join_url(base, unescape(action)), base))

    return let(first_where(all_found(without_hidden(html), FORM_BLOCK), qualifies), target)


def postal_address(html: Column) -> Column:
    """struct(text, rank): schema.org PostalAddress first, then <address>."""
    def read(source: Column) -> Column:
        return F.array(*[
            F.struct(F.when(F.lower(source).contains(hint), element_text(source, opening))
                     .alias("text"), F.lit(rank).alias("rank"))
            for hint, opening, rank in (("postaladdress", POSTAL_OPEN, 30),
                                        ("<address", ADDRESS_OPEN, 35))])

    return first_where(let(without_hidden(html), read),
                       lambda a: F.length(a["text"]) >= 10)


def _forms() -> Column:
    target = contact_form(F.col("html"), F.col("final_url"))
    rows = F.transform(F.array_compact(F.array(target)), lambda t: _contact(
        "form", "general", t, F.lower(t), 60, 0))
    return F.when(F.col("low").contains("<form"), rows).otherwise(_none())


def _addresses() -> Column:
    address = postal_address(F.col("html"))
    rows = F.transform(F.array_compact(F.array(address)), lambda a: _contact(
        "address", "general", a["text"], F.lower(a["text"]), a["rank"], 0))
    possible = F.col("low").contains("postaladdress") | F.col("low").contains("<address")
    return F.when(possible, rows).otherwise(_none())


# --- assembly -----------------------------------------------------------------------------------
def page_contacts(suffixes, placeholders=fixed.PLACEHOLDER_DOMAINS,
                  dial_plan=None) -> Column:
    """All contacts of one page, as an array column over a pages row."""
    return F.concat(_emails(suffixes, placeholders), _phones(dial_plan), _socials(), _forms(),
                    _addresses())


def contacts(firsts: DataFrame) -> DataFrame:
    """Contacts table from the first facts: one row per (site, kind, value).

    The first fact is ordered by (rank, page, position), so the best rank wins
    and the first seen breaks ties.
    """
    return firsts.where(F.col("fact") == "contact").select(
        "site",
        F.col("body.extra").alias("kind"),
        F.col("body.category").alias("category"),
        F.col("body.text").alias("value"),
        F.expr("substring(key, instr(key, ':') + 1)").alias("normalized_value"),
        F.col("body.source_url").alias("source_url"),
        F.col("body.rank").alias("rank"),
    )


def contact_order() -> list[Column]:
    return [F.col("kind"), F.col("rank"), F.col("normalized_value")]


def first_contacts(contacts_df: DataFrame, k: int) -> DataFrame:
    return top_rows(contacts_df, ["site"], contact_order(), k)

