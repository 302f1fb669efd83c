"""Numbers in Brazilian notation as decimal column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = "decimal(38,6)"
LITERAL = r"^[-−]?([0-9]{1,3}(\.[0-9]{3})+|[0-9]+)(,[0-9]+)?\s*%?$"


def normalized(c: Column) -> Column:
    """The number as plain digits with a decimal point; other texts unchanged.

    Point and comma: thousands and decimals; a comma alone: decimals; groups of three after points: thousands.
    """
    s = F.replace(F.trim(F.replace(F.trim(c), F.lit("%"), F.lit(""))), F.lit("−"), F.lit("-"))
    plain = F.replace(s, F.lit("."), F.lit(""))
    return F.when(s.contains(","), F.replace(plain, F.lit(","), F.lit("."))).when(s.rlike(r"^-?[0-9]{1,3}(\.[0-9]{3})+$"), plain).otherwise(s)


def literal_decimal(c: Column) -> Column:
    """The value of a strict literal, null for anything ambiguous."""
    return F.when(F.trim(c).rlike(LITERAL), normalized(c).try_cast(DECIMAL))


def operand(c: Column) -> Column:
    """A finite operand of at most 1e30 in size, null otherwise."""
    v = literal_decimal(c)
    return F.when(F.abs(v) <= F.lit("1e30").cast("decimal(38,0)"), v)


def formatted(c: Column) -> Column:
    """Two places, rounded half up, with a decimal comma."""
    return F.replace(F.round(c, 2).cast("decimal(38,2)").cast("string"), F.lit("."), F.lit(","))


def bounded(c: Column, default: float, low: float, high: float) -> Column:
    """A setting as a number within bounds; the default where it does not parse."""
    return F.least(F.greatest(F.coalesce(c.try_cast("double"), F.lit(default)), F.lit(low)), F.lit(high))
