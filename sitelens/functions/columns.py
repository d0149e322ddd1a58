"""Small column helpers shared by the operators."""

from __future__ import annotations

import functools
import json
import zlib

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def built_once(builder):
    """Keep the columns a builder returns for given arguments.

    A column expression is a pure value, and building a large one costs many
    calls into the JVM; the arguments (rule packs, word lists) must be hashable.
    """
    kept: dict = {}

    @functools.wraps(builder)
    def wrapper(*args):
        key = (id(SparkContext._gateway), args)
        if key not in kept:
            kept[key] = builder(*args)
        return kept[key]

    return wrapper


def text(value) -> Column:
    """Literal, or column rendered as text (booleans as true/false)."""
    return value.cast("string") if isinstance(value, Column) else F.lit(
        str(value).lower() if isinstance(value, bool) else str(value)
    )


def evidence(**entries) -> Column:
    """Text map of the non-null entries, in the order given."""
    if not entries:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    pairs = []
    for key, value in entries.items():
        pairs += [F.lit(key), text(value)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def as_json(column: Column) -> Column:
    return F.to_json(column)


def show_map(column: Column) -> Column:
    """``k=v|k=v`` in key order: a stable text form of a text map."""
    return F.array_join(
        F.transform(
            F.array_sort(F.map_entries(column)),
            lambda e: F.concat(e["key"], F.lit("="), e["value"]),
        ),
        "|",
    )


def found(column: Column, pattern: str, group: int = 0) -> Column:
    """First regex match or NULL; an empty match counts as none."""
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def all_found(column: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(column, F.lit(pattern), F.lit(group))


def any_contains(column: Column, words) -> Column:
    test = F.lit(False)
    for word in words:
        test = test | column.contains(word)
    return test


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` written (and computed) once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_map(entries: dict, kind: str = "string") -> Column:
    """A lookup table as one literal; Catalyst folds it when it plans."""
    return F.from_json(F.lit(json.dumps(entries)), f"map<string,{kind}>")


def lookup(entries: dict, kind: str = "string"):
    """key -> entry. A long table is split by a hash of its keys, so that a test
    compares with a few of them only."""
    if len(entries) <= 64:
        table = literal_map(entries, kind)
        return lambda key: F.element_at(table, key)
    parts: list[dict] = [{} for _ in range(len(entries) // 8)]
    for key, entry in entries.items():
        parts[zlib.crc32(key.encode()) % len(parts)][key] = entry
    table = F.from_json(F.lit(json.dumps(parts)), f"array<map<string,{kind}>>")
    return lambda key: F.element_at(F.get(table, (F.crc32(key) % len(parts)).cast("int")), key)


def first_where(array: Column, test) -> Column:
    return F.get(F.filter(array, test), F.lit(0))


def top_rows(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rn") -> DataFrame:
    """First ``k`` rows per key.

    Spark plans ``row_number() <= k`` as a group limit on both sides of the
    shuffle, so a task never ships more than ``k`` rows per key and a hot key
    costs no more than any other.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
