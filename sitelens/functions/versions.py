"""Version text: parse, order, and judge currency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.fixed import VERSION_PATTERN
from sitelens.functions.columns import let


def version_parse(raw: Column) -> Column:
    """struct(parts, is_final, pre) or NULL when the text is no version."""
    def parsed(text: Column) -> Column:
        numbers = F.regexp_extract(text, VERSION_PATTERN, 1)
        pre = F.lower(F.regexp_extract(text, VERSION_PATTERN, 2))
        parts = F.transform(F.split(numbers, r"\."), lambda p: p.try_cast("bigint"))
        return F.when(
            numbers != "",
            F.struct(
                parts.alias("parts"),
                F.when(pre == "", 1).otherwise(0).alias("is_final"),
                pre.alias("pre"),
            ),
        )

    return let(F.trim(raw), parsed)


def _padded(version: Column, other: Column) -> Column:
    """Sort key of ``version``: parts zero-filled to the longer length."""
    longest = F.greatest(F.size(version["parts"]), F.size(other["parts"]))
    zeros = F.array_repeat(F.lit(0).cast("bigint"), longest - F.size(version["parts"]))
    return F.struct(
        F.concat(version["parts"], zeros).alias("parts"),
        version["is_final"].alias("is_final"),
        version["pre"].alias("pre"),
    )


def version_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 over two raw texts; NULL when either is no version."""
    def compare(pair: Column) -> Column:
        left, right = pair["a"], pair["b"]
        x, y = _padded(left, right), _padded(right, left)
        return (
            F.when(left.isNull() | right.isNull(), None)
            .when(x < y, -1).when(x > y, 1).otherwise(0)
        )

    return let(F.struct(version_parse(a).alias("a"), version_parse(b).alias("b")), compare)


def is_outdated(current: Column, latest: Column) -> Column:
    return version_compare(current, latest) == -1


def major_versions_behind(current: Column, latest: Column) -> Column:
    major = lambda v: F.get(version_parse(v)["parts"], F.lit(0))
    return let(major(latest) - major(current), lambda gap: F.when(
        gap.isNotNull(), F.greatest(F.lit(0).cast("bigint"), gap)))
