"""Public suffix lists: read from a file or a table, checked, handed on as a tuple.

There is no built-in list: with a short one, sites under every other suffix would have no
domain and would be rejected. The published list has about ten thousand rules, so it is
configuration; it travels as one literal of the plan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_SUFFIXES = 200_000
RULE = re.compile(r"!?(?:\*\.)?[^\s.*!/]+(?:\.[^\s.*!/]+)*")


def suffixes_from_table(rules: DataFrame, column: str = "suffix") -> tuple[str, ...]:
    """Rules in the published notation (``co.uk``, ``*.ck``, ``!www.ck``), one a row; comments
    and blank rows are skipped. A row that is no rule is an error. Names beyond ASCII are
    added in the form that they have in addresses, too."""
    rows = rules.select(F.trim(F.col(column).cast("string")).alias("rule")).where(
        "rule <> '' AND NOT startswith(rule, '//')").distinct().limit(MOST_SUFFIXES + 1).collect()
    if len(rows) > MOST_SUFFIXES:
        raise ValueError(f"more than {MOST_SUFFIXES} suffix rules")
    found = {r["rule"].split()[0].lower().strip(".") for r in rows}
    wrong = sorted(r for r in found if not RULE.fullmatch(r) or r.startswith("!*"))
    if wrong:
        raise ValueError(f"not a suffix rule: {', '.join(wrong[:10])}")
    if not found:
        raise ValueError("the suffix list is empty")
    return tuple(sorted(found | {in_addresses(r) for r in found}))


def in_addresses(rule: str) -> str:
    mark, name = re.fullmatch(r"(!?(?:\*\.)?)(.*)", rule).groups()
    try:
        return mark + name.encode("idna").decode("ascii")
    except UnicodeError:
        return rule


def read_suffix_list(spark: SparkSession, path: str) -> tuple[str, ...]:
    """A list in the published text form, from any path that Spark reads."""
    return suffixes_from_table(spark.read.text(path), "value")
