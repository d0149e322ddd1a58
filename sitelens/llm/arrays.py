"""Array expressions that several operators share; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"  # fixed value: the white space between words
NOT_SPACE = r"[^\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column, between: str = SPACE) -> Column:
    return F.filter(F.split(text, between), lambda w: w != "")


def pairs_with_next(values: Column, join, step: int = 1) -> Column:
    """``join(a, b)`` for each element and the one ``step`` after it, where there is one."""
    return let(values, lambda v: F.when(F.size(v) > step, F.zip_with(
        F.slice(v, F.lit(1), F.size(v) - step), F.slice(v, F.lit(step + 1), F.size(v) - step), join)))


def running_sum(values: Column) -> Column:
    """Sums of all prefixes in log2(n) passes; appending to an array would be quadratic."""
    def add_shifted(v: Column, k: Column) -> Column:
        by = F.least(F.call_function("shiftleft", F.lit(1), k), F.size(v))
        shifted = F.concat(F.array_repeat(F.lit(0).cast("bigint"), by),
                           F.slice(v, F.lit(1), F.size(v) - by))
        return F.zip_with(v, shifted, lambda a, b: a + b)

    # size - 1 in binary has as many digits as there are passes
    passes = lambda v: F.when(F.size(v) < 2, F.array().cast("array<int>")).otherwise(
        F.sequence(F.lit(0), F.length(F.bin((F.size(v) - 1).cast("bigint"))) - 1))
    return let(values, lambda v: F.aggregate(passes(v), v, add_shifted))
