"""Date functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(c: Column) -> Column:
    """``Y-M-D`` padded; ``D/M/Y`` or ``D-M-Y``, day and month turned where only that makes a month; other text as it is."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    part = lambda p, i: F.regexp_extract(c, p, i)
    ymd, dmy = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
    d, m = part(dmy, 1).try_cast("int"), part(dmy, 2).try_cast("int")
    turn = (m > 12) & (d <= 12)
    return (
        F.when(c.rlike(ymd), F.concat_ws("-", part(ymd, 1), two(part(ymd, 2).try_cast("int")), two(part(ymd, 3).try_cast("int"))))
        .when(c.rlike(dmy), F.concat_ws("-", part(dmy, 3), two(F.when(turn, d).otherwise(m)), two(F.when(turn, m).otherwise(d))))
        .otherwise(c)
    )


def date_int(c: Column) -> Column:
    """``YYYYMMDD`` as an integer, the sortable key of a vector's payload."""
    return F.date_format(c, "yyyyMMdd").cast("int")


def window_around(c: Column, day: str, days: int) -> Column:
    """Whether a date lies within ``days`` days of another."""
    d = F.lit(day).cast("date")
    return c.between(F.date_sub(d, days), F.date_add(d, days))
