"""Periods named in texts: days, months, quarters, years, the finer ones hiding the coarser ones they contain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names, folded; fixed values.
MONTHS = "janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro".split()
#: Patterns of dates in folded text; fixed values.
_Y = "(?:19|20)[0-9]{2}"
DAY_ISO = rf"\b({_Y})-([0-9]{{2}})-([0-9]{{2}})\b"
DAY = rf"\b([0-9]{{1,2}})[/-]([0-9]{{1,2}})[/-]({_Y})\b"
MONTH_ISO = rf"\b({_Y})-(0[1-9]|1[0-2])\b"
MONTH = rf"\b(0?[1-9]|1[0-2])[/-]({_Y})\b"
QUARTER = rf"\b([1-4])(?:[ºo°]?\s*(?:trimestre|tri(?:m)?\.?|t))\s*(?:de\s*)?({_Y})\b"
_NAMES = "|".join(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS)
NAMED = rf"\b({_NAMES})\.?\s*(?:de\s*|[/-]\s*)?({_Y})\b"
YEAR = rf"\b{_Y}\b"


def periods(folded: Column) -> Column:
    """Sorted distinct periods of a folded text as YYYY, YYYY-Qn, YYYY-MM or YYYY-MM-DD.

    Dates that do not exist name no period, nor does their year.
    """
    blank = " # "
    part = lambda p, g: (lambda x: F.regexp_extract(x, p, g))
    every = lambda t, p: F.regexp_extract_all(t, F.lit(p), F.lit(0))
    two = lambda c: F.lpad(c, 2, "0")
    join = lambda *c: F.concat_ws("-", *c)
    iso = F.transform(every(folded, DAY_ISO), lambda x: F.try_to_date(x, "yyyy-MM-dd").cast("string"))
    t1 = F.regexp_replace(folded, DAY_ISO, blank)
    day = F.transform(every(t1, DAY), lambda x: F.try_to_date(join(part(DAY, 3)(x), two(part(DAY, 2)(x)), two(part(DAY, 1)(x))), "yyyy-MM-dd").cast("string"))
    t2 = F.regexp_replace(t1, DAY, blank)
    month_iso = every(t2, MONTH_ISO)
    t3 = F.regexp_replace(t2, MONTH_ISO, blank)
    month = F.transform(every(t3, MONTH), lambda x: join(part(MONTH, 2)(x), two(part(MONTH, 1)(x))))
    t4 = F.regexp_replace(t3, MONTH, blank)
    quarter = F.transform(every(t4, QUARTER), lambda x: F.concat(part(QUARTER, 2)(x), F.lit("-Q"), part(QUARTER, 1)(x)))
    t5 = F.regexp_replace(t4, QUARTER, blank)
    number = lambda x: F.lpad(F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), F.substring(part(NAMED, 1)(x), 1, 3)).cast("string"), 2, "0")
    named = F.transform(every(t5, NAMED), lambda x: join(part(NAMED, 2)(x), number(x)))
    year = every(F.regexp_replace(t5, NAMED, blank), YEAR)
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(iso, day, month_iso, month, quarter, named, year))))


def granularity(c: Column) -> Column:
    return (
        F.when(c.rlike(r"^[0-9]{4}$"), "year").when(c.rlike(r"^[0-9]{4}-Q[1-4]$"), "quarter").when(c.rlike(r"^[0-9]{4}-[0-9]{2}$"), "month").when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "day").otherwise("unknown")
    )
