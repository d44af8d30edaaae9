"""Filter rules shared by the archive's routines."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """Optional filters; an exact date makes the range count for nothing."""

    newspaper: str | None = None
    newspaper_id: int | None = None
    issue_date: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    section: str | None = None
    article_type: str | None = None
    page: int | None = None
    words: tuple[str, ...] = ()


def contains_ci(c: str | Column, text: str) -> Column:
    """Case-insensitive containment; ``%`` and ``_`` in the text are wildcards."""
    return (F.col(c) if isinstance(c, str) else c).ilike(f"%{text}%")


def _predicates(f: Filters) -> list[tuple[str, Column]]:
    """(column, predicate) of each filter given."""
    date = lambda text: F.lit(iso(text)).cast("date")
    out: list[tuple[str, Column]] = []
    if f.newspaper:
        out.append(("newspaper", contains_ci("newspaper", f.newspaper)))
    if f.newspaper_id is not None:
        out.append(("newspaper_id", F.col("newspaper_id") == f.newspaper_id))
    if f.issue_date:
        out.append(("issue_date", F.col("issue_date") == date(f.issue_date)))
    else:
        out += [("issue_date", F.col("issue_date") >= date(f.date_from))] if f.date_from else []
        out += [("issue_date", F.col("issue_date") <= date(f.date_to))] if f.date_to else []
    if f.section:
        out.append(("section", contains_ci("section", f.section)))
    if f.article_type:
        out.append(("article_type", F.col("article_type") == f.article_type))
    return out


def apply_filters(df: DataFrame, f: Filters) -> DataFrame:
    """The filters as predicates, each only if given, so that they reach the scan."""
    for _, p in _predicates(f):
        df = df.where(p)
    return df


def apply_filters_to(f: Filters, columns: list[str]) -> Column | None:
    """The given filters on some columns as one predicate; None if there are none."""
    mine = [p for c, p in _predicates(f) if c in columns]
    return reduce(lambda a, b: a & b, mine) if mine else None


def iso(text: str) -> str:
    """P5 for a parameter: ``Y-M-D`` padded; ``D/M/Y`` or ``D-M-Y``, turned where only that makes a month; other text as it is."""
    text = text.strip()
    if m := re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})", text):
        return f"{m[1]}-{int(m[2]):02d}-{int(m[3]):02d}"
    if m := re.fullmatch(r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", text):
        d, mo = int(m[1]), int(m[2])
        if mo > 12 >= d:
            d, mo = mo, d
        return f"{m[3]}-{mo:02d}-{d:02d}"
    return text


def label(c: str, default: str) -> Column:
    """The default where the value is null or empty."""
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))


def page_numbers(text: str | list | None) -> list[int]:
    """Every number of one to three digits in a page filter."""
    parts = text if isinstance(text, (list, tuple)) else [text]
    return sorted({int(x) for p in parts if p is not None for x in re.findall(r"\b\d{1,3}\b", str(p))})


def pages_overlap(pages: str | Column, wanted: list[int], exclude: bool = False) -> Column:
    """Rows of which a page is among the wanted ones, or none."""
    hit = F.arrays_overlap(pages, F.array(*[F.lit(p) for p in wanted]).cast("array<int>"))
    return ~hit if exclude else hit


def names_compatible(a: Column, b: Column) -> Column:
    """One name contains the other, without case."""
    x, y = F.lower(a), F.lower(b)
    return x.contains(y) | y.contains(x)
