"""Page-source scalars: text, structure and page kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.fixed import PARKED_MARKERS
from sitelens.functions.columns import any_contains, let

# What is not closed ends with the page, as browsers read it; so every pattern passes once.
INVISIBLE = (
    r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|"
    r"<noscript\b.*?(?:</noscript\s*>|\z)|<template\b.*?(?:</template\s*>|\z)|<!--.*?(?:-->|\z)"
)
HIDDEN_SOURCE = r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)"
# a tag and the text up to the next one; a name, and a value that is quoted or not
TOKEN = r"(?s)<(/?[A-Za-z][^\s/>]*)([^>]*)>([^<]*)"
ATTRIBUTE = r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?"""
TAG = r"(?s)<[^>]*>"
BLANKS = r"[\s\x{00A0}]+"
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&amp;", "&"),
)


def unescape(column: Column) -> Column:
    for entity, char in ENTITIES:
        column = F.replace(column, F.lit(entity), F.lit(char))
    return column


def tidy(column: Column) -> Column:
    return F.trim(F.regexp_replace(column, BLANKS, " "))


def strip_tags(column: Column) -> Column:
    return tidy(unescape(F.regexp_replace(column, TAG, " ")))


def visible_text(html: Column) -> Column:
    """Readable text of the whole page, blanks collapsed."""
    return strip_tags(F.regexp_replace(html, INVISIBLE, " "))


def without_hidden(html: Column) -> Column:
    """Source without scripts, styles and comments."""
    return F.regexp_replace(html, HIDDEN_SOURCE, " ")


def element_text(source: Column, opening: str) -> Column:
    """Text of the first element whose opening tag matches ``opening``.

    Nested elements of the same name are counted, so the text ends at the
    element's own closing tag, or with the page. The rest of the page is split at closing
    tags of that name, and the pieces are counted off: one pass, whatever its length.
    """
    def body(start: Column) -> Column:
        tag = F.regexp_extract(start, r"^<([A-Za-z0-9]+)", 1)
        after = F.substring(source, F.instr(source, start) + F.length(start), F.length(source))
        opened = F.concat(F.lit("(?i)<"), tag, F.lit(r"(?![A-Za-z0-9])"))
        pieces = F.call_function("split", after, F.concat(F.lit("(?i)</"), tag, F.lit(r"(?![A-Za-z0-9])[^>]*>")))

        def count(acc: Column, piece: Column) -> Column:
            depth = acc["depth"] + F.regexp_count(piece, opened) - 1
            more = F.struct(depth.alias("depth"), (acc["taken"] + 1).alias("taken"))
            return F.when(acc["depth"] > 0, more).otherwise(acc)

        zero = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("taken"))
        return let(pieces, lambda p: F.array_join(F.slice(p, F.lit(1), F.aggregate(
            p, zero, count, lambda acc: acc["taken"])), " "))

    return let(F.regexp_extract(source, opening, 0), lambda start: F.when(
        start != "", strip_tags(body(start))))


def elements(html: Column) -> Column:
    """Tags in order: array<struct(tag, closing, attributes, text)>, ``text`` being what follows
    the tag up to the next one. Scripts, styles and comments are left out. Names are in
    lower case; of an attribute that a tag has twice the first counts.
    """
    def parsed(token: Column) -> Column:
        part = lambda n: F.regexp_extract(token, TOKEN, n)
        return let(part(2), lambda inside: F.struct(
            F.lower(F.regexp_replace(part(1), "^/", "")).alias("tag"), part(1).startswith("/").alias("closing"),
            attributes(inside).alias("attributes"), unescape(part(3)).alias("text")))

    return F.transform(F.regexp_extract_all(without_hidden(html), F.lit(TOKEN), F.lit(0)), parsed)


def attributes(inside: Column) -> Column:
    """map<name, value> of the inside of a tag; no value is an empty one."""
    every = lambda n: F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(n))
    joined = lambda a, b: F.concat(a, b)
    names = F.transform(every(1), lambda n: F.lower(n))
    values = F.zip_with(F.zip_with(every(2), every(3), joined), every(4), joined)
    return let(names, lambda n: F.map_from_entries(F.filter(
        F.zip_with(n, values, lambda k, v: F.struct(k.alias("key"), unescape(v).alias("value"))),
        lambda e, i: F.array_position(n, e["key"]) == i + 1)))


def page_elements(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, tag, closing, attributes, text): one row for every tag of every page."""
    return pages.select(*keys, F.posexplode(elements(F.col("html"))).alias("pos", "e")).select(*keys, "pos", "e.*")


def page_classify(url: Column) -> Column:
    low = F.lower(url)
    return (
        F.when(any_contains(low, ("contact", "kontakt")), "contact")
        .when(low.contains("about"), "about")
        .when(low.contains("privacy"), "privacy")
        .when(any_contains(low, ("legal", "imprint", "impressum")), "legal")
        .otherwise("other")
    )


def is_parked(page_text: Column, max_chars: int | None = None) -> Column:
    """Whether a page says so; ``max_chars`` exempts longer texts, by default none."""
    low = F.lower(page_text)
    said = any_contains(low, PARKED_MARKERS)
    return said if max_chars is None else (F.length(low) <= max_chars) & said


def content_hash(body: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(body, 256), 1, 32))
