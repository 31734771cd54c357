"""Dates of feeds and items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Berlin"
#: German months.
MONTHS = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")


def parse_date(c: Column) -> Column:
    """yyyy-MM-dd, or null."""
    return F.try_to_date(c, "yyyy-MM-dd")


def parse_timestamp(c: Column) -> Column:
    """RFC 3339, RFC 1123, ISO with a bare offset, or a plain date; no offset means UTC; null on failure."""
    mail = F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z]{3},\s*", ""), r"GMT$", "+0000")
    return F.coalesce(
        F.try_to_timestamp(c),
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssZ")),
        F.try_to_timestamp(mail, F.lit("dd MMM yyyy HH:mm:ss Z")),
    )


def _quarter(c: Column) -> tuple[Column, Column]:
    q = F.regexp_extract(c, r"(\d)\.\s*Quartal\s+(\d{4})", 1)
    y = F.regexp_extract(c, r"(\d)\.\s*Quartal\s+(\d{4})", 2)
    return F.when(q.isin("1", "2", "3", "4"), q.cast("int")), F.when(y != "", y.cast("int"))


def quarter_start(c: Column) -> Column:
    """First moment of the first day of "2. Quartal 2022" in the city's time, as UTC; null for other texts."""
    q, y = _quarter(c)
    return F.to_utc_timestamp(F.make_date(y, (q - 1) * 3 + 1, F.lit(1)).cast("timestamp"), ZONE)


def quarter_end(c: Column) -> Column:
    """Midnight at the beginning of the quarter's last day in the city's time, as UTC; null for other texts."""
    q, y = _quarter(c)
    return F.to_utc_timestamp(F.last_day(F.make_date(y, q * 3, F.lit(1))).cast("timestamp"), ZONE)


def german_issue_date(page: Column) -> Column:
    """The date of "Ausgegeben zu Berlin am D. Monat YYYY"; null if a page has none."""
    pattern = r"Ausgegeben zu Berlin am (\d{1,2})\. (\p{L}+) (\d{4})"
    day, month, year = (F.regexp_extract(page, pattern, k) for k in (1, 2, 3))
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month).cast("int")
    return F.when((day != "") & (number > 0), F.make_date(year.cast("int"), number, day.cast("int")))


def date_range(*dates: Column) -> tuple[Column, Column]:
    """Least and greatest of dates; nulls are skipped."""
    return F.least(*dates), F.greatest(*dates)


def newest_date(as_of: Column, *dates: Column) -> Column:
    """The date closest to as_of in whole days, the first of equals; null if all are."""
    day = 86_400
    gap = lambda d: F.abs(((d.cast("timestamp").cast("double") - as_of.cast("timestamp").cast("double")) / day).cast("long"))
    entries = F.array(*[F.when(d.isNotNull(), F.struct(gap(d).alias("gap"), F.lit(k).alias("k"), d.alias("d"))) for k, d in enumerate(dates)])
    return F.array_min(F.filter(entries, lambda e: e.isNotNull()))["d"]


def whole_months(later: Column, earlier: Column) -> Column:
    """Months between two moments, cut towards zero."""
    m = F.months_between(later.cast("timestamp"), earlier.cast("timestamp"), False)
    return F.when(m < 0, F.ceil(m - 1e-9)).otherwise(F.floor(m + 1e-9)).cast("long")
