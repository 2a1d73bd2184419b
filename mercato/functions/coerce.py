"""Lenient casts and date arithmetic.

Spark 4 runs with ANSI mode on, so a plain ``cast`` of a bad string raises.
Uploads are dirty by nature; every parse here is a ``try_*`` form that turns
bad input into NULL, exactly like the "coerce" error mode of the original
pandas code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mercato.operators._util import col_of

MICROS_PER_DAY = 86_400_000_000

# Shapes of strings that can parse as numbers (decimal / exponent forms and
# the usual special words).  Used to skip the cast for strings that cannot
# parse, which is much cheaper than a failing cast.
NUMBER_SHAPE = r"^\s*[+-]?((\d+(\.\d*)?)|(\.\d+))([eE][+-]?\d+)?\s*$"
SPECIAL_NUMBER_SHAPE = r"(?i)^\s*[+-]?(inf|infinity|nan)\s*$"
INTEGER_SHAPE = r"^\s*[+-]?\d+\s*$"


def number_shaped(c) -> Column:
    """TRUE when the string ``c`` has the shape of a number."""
    c = col_of(c)
    return c.rlike(NUMBER_SHAPE) | c.rlike(SPECIAL_NUMBER_SHAPE)


def parses_as(c, to: str) -> Column:
    """TRUE when the string ``c`` converts to ``to`` ("double" / "long"):
    a cheap shape test first, the exact cast only for candidates."""
    c = col_of(c)
    if to == "long":
        return c.rlike(INTEGER_SHAPE) & c.try_cast("long").isNotNull()
    return number_shaped(c) & c.try_cast(to).isNotNull()


def lenient_number(c) -> Column:
    """String/number -> DOUBLE, unparsable -> NULL (price handling)."""
    return col_of(c).try_cast("double")


def lenient_number_or_zero(c) -> Column:
    """String/number -> DOUBLE, unparsable or missing -> 0 (quantity handling)."""
    return F.coalesce(col_of(c).try_cast("double"), F.lit(0.0))


def lenient_timestamp(c, formats: tuple[str, ...] = ()) -> Column:
    """String -> TIMESTAMP, unparsable -> NULL.  With ``formats`` each pattern
    is tried in order and the first that parses wins."""
    c = col_of(c)
    if not formats:
        return F.try_to_timestamp(c)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def as_timestamp(c) -> Column:
    """TIMESTAMP_NTZ / DATE / TIMESTAMP -> TIMESTAMP (session zone is UTC)."""
    return col_of(c).cast("timestamp")


def days_elapsed(start, end) -> Column:
    """Whole days from ``start`` to ``end`` counting the time of day, floored
    (``datediff`` ignores the time of day and would be off by one)."""
    us = F.unix_micros(as_timestamp(end)) - F.unix_micros(as_timestamp(start))
    return F.floor(us / F.lit(MICROS_PER_DAY)).cast("long")


def weekday_mon0(c) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6."""
    return F.weekday(col_of(c)).cast("int")


def finite_or_zero(c) -> Column:
    """NaN, +inf, -inf and NULL -> 0.0 (JSON-safe numbers)."""
    c = col_of(c).cast("double")
    bad = c.isNull() | F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return F.when(bad, F.lit(0.0)).otherwise(c)
