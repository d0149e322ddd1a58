"""URL and domain scalars as column expressions (no Python in the tasks)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.fixed import SKIPPED_HREFS
from sitelens.functions.columns import let, lookup

AUTHORITY = r"^[^:/?#]*://(?:[^/?#]*@)?([^/?#:]*)"
PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def hostname_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, AUTHORITY, 1))
    return F.nullif(host, F.lit(""))


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


EXACT, WILD, EXCEPT = 1, 2, 4


def suffix_table(suffixes) -> dict[str, int]:
    """suffix -> what the rules say of it: a suffix, any label before it is one, or not."""
    if suffixes is None:
        raise ValueError("pass a public suffix list: see sitelens.sources.suffixes")
    table: dict[str, int] = {}
    for rule in suffixes:
        name, bit = (rule[2:], WILD) if rule.startswith("*.") else (rule[1:], EXCEPT) if rule.startswith("!") else (rule, EXACT)
        table[name] = table.get(name, 0) | bit
    return table


def registrable(host: Column, suffixes) -> Column:
    """Label before the longest public suffix, plus that suffix; NULL without one.

    ``suffixes`` is a suffix list in the published notation (``co.uk``, ``*.ck``,
    ``!www.ck``). The tails of the host are looked up by hash, so the cost per row does
    not depend on the length of the list. An exception makes the rest of it the suffix.
    """
    found = lookup(suffix_table(suffixes), "int")

    def tail(labels: Column, start: Column) -> Column:
        return F.array_join(F.slice(labels, start + 1, F.size(labels)), ".")

    def within(labels: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(labels) - 1)
        return let(F.transform(starts, lambda i: F.coalesce(found(tail(labels, i)), F.lit(0))),
                   lambda marks: let(cut(starts, marks), lambda i: F.when(
                       (i >= 1) & (F.get(labels, i - 1) != ""), tail(labels, i - 1))))

    def cut(starts: Column, marks: Column) -> Column:
        has = lambda i, bit: F.coalesce(F.get(marks, i).bitwiseAND(bit) > 0, F.lit(False))
        excepted = F.filter(starts, lambda i: (i > 0) & has(i - 1, EXCEPT))
        listed = F.filter(starts, lambda i: has(i, EXACT) | has(i + 1, WILD))
        return F.coalesce(F.get(excepted, F.lit(0)), F.get(listed, F.lit(0)))

    return let(F.split(F.regexp_replace(host, r"\.+$", ""), r"\."), within)


def canonical_domain(value: Column, suffixes) -> Column:
    return let(F.lower(F.trim(value)), lambda raw: registrable(hostname_of(
        F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit("http://"), raw))), suffixes))


def normalize_url(value: Column) -> Column:
    """Absolute http(s) URL without fragment, https by default, else NULL."""
    def normal(full: Column) -> Column:
        scheme = F.lower(F.regexp_extract(full, PARTS, 1))
        rest = F.regexp_replace(
            F.regexp_extract(full, r"(?s)^[^:]*(://.*)$", 1), r"(?s)#.*$", "")
        ok = scheme.isin("http", "https") & hostname_of(full).isNotNull()
        return F.when(ok, F.concat(scheme, rest))

    raw = F.trim(value)
    return let(F.when(raw.contains("://"), raw).otherwise(
        F.when(raw != "", F.concat(F.lit("https://"), raw))), normal)


def same_site(a: Column, b: Column, suffixes) -> Column:
    """True when both reduce to one registrable domain; False otherwise."""
    x, y = canonical_domain(a, suffixes), canonical_domain(b, suffixes)
    return x.isNotNull() & y.isNotNull() & x.eqNullSafe(y)


def remove_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, segment: Column) -> Column:
        shorter = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return (
            F.when(segment == "..", shorter)
            .when(segment == ".", acc)
            .otherwise(F.concat(acc, F.array(segment)))
        )

    def resolve(segments: Column) -> Column:
        kept = F.array_join(F.aggregate(segments, empty, step), "/")
        last = F.element_at(segments, -1)
        return let(kept, lambda k: F.concat(
            F.lit("/"), k, F.when(last.isin(".", "..") & (k != ""), "/").otherwise("")))

    return let(F.split(F.regexp_replace(path, "^/", ""), "/"), resolve)


def join_url(base: Column, href: Column) -> Column:
    """Resolve ``href`` against ``base``; NULL for links that are not pages."""
    skipped = F.lit(False)
    for prefix in SKIPPED_HREFS:
        skipped = skipped | href.startswith(prefix)
    scheme = F.regexp_extract(base, PARTS, 1)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(base, PARTS, 2))
    path = F.regexp_extract(base, PARTS, 3)
    folder = F.regexp_extract(F.when(path == "", "/").otherwise(path), r"^(.*/)", 1)
    link = F.regexp_replace(href, r"(?s)#.*$", "")
    link_path = F.regexp_extract(link, r"(?s)^([^?]*)", 1)
    link_query = F.regexp_extract(link, r"(?s)(\?.*)$", 1)
    resolved = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, remove_dots(link_path), link_query))
        .when(link.startswith("?"), F.concat(root, path, link))
        .otherwise(F.concat(root, remove_dots(F.concat(folder, link_path)), link_query))
    )
    return F.when((href != "") & ~skipped, normalize_url(resolved))
