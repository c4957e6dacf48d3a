"""Calendar and time-of-day expressions. "Now" is always an ``as_of`` argument."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Day = dt.date | str


def day(value: Day) -> dt.date:
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def quarter_of(month_number: Column) -> Column:
    """1-3 to 1, 4-6 to 2, 7-9 to 3, 10-12 to 4."""
    return F.ceil(month_number / 3).cast("int")


def months_since(month: Column, first_month: int) -> Column:
    """Rank (1-12) of a calendar month in a year that starts at ``first_month``."""
    return (F.pmod(month - first_month, F.lit(12)) + 1).cast("int")


def quarter_in_year_from(month: Column, first_month: int = 7) -> Column:
    """Quarter of a calendar month in a year that starts at ``first_month``."""
    return quarter_of(months_since(month, first_month))


def in_days(column: Column, first: Day | None = None, last: Day | None = None) -> Column:
    """Inclusive day range; an open side is left out, so nothing hides the pushdown."""
    condition = F.lit(True)
    if first is not None:
        condition = condition & (column >= F.lit(day(first)))
    if last is not None:
        condition = condition & (column <= F.lit(day(last)))
    return condition


def last_n_days(column: Column, as_of: Day, n: int = 2) -> Column:
    """The ``n`` days up to and including ``as_of`` (2 = yesterday and today)."""
    today = day(as_of)
    return in_days(column, today - dt.timedelta(days=n - 1), today)


def year_before(value: Day) -> dt.date:
    """Same day one year earlier; 29 February becomes 28 February."""
    d = day(value)
    try:
        return d.replace(year=d.year - 1)
    except ValueError:
        return d.replace(year=d.year - 1, day=28)


def period(
    column: Column, current: tuple[Day, Day], previous: tuple[Day, Day] | None = None
) -> Column:
    """'Current Year' or 'Previous Year' for days in one of two ranges, NULL for
    all others. The previous range is the current one a year earlier, unless given."""
    previous = previous or (year_before(current[0]), year_before(current[1]))
    return F.when(in_days(column, *current), "Current Year").when(in_days(column, *previous), "Previous Year")


def local_time(utc: Column, zone: str | None) -> Column:
    """Zone-less UTC wall clock to the wall clock of ``zone``."""
    return utc if zone is None else F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def time_bucket(utc: Column, width: str = "30 minutes", zone: str | None = None) -> Column:
    """Start of the tumbling bucket, optionally on the local clock."""
    if width == "1 hour":
        return F.date_trunc("HOUR", local_time(utc, zone)).cast("timestamp_ntz")
    return F.window(local_time(utc, zone), width)["start"]


def _shape(pattern: str) -> str:
    """What a text must look like for the date pattern to read it; some of these it still cannot read."""
    out = []
    for letters, _, quoted, other in re.findall(r"(([A-Za-z])\2*)|('[^']*')|(.)", pattern):
        if letters:
            named = letters[0] in "aEGzvVOX" or (letters[0] in "ML" and len(letters) > 2)
            out.append(r".+" if named else r"[+-]?\d+")
        else:
            out.append(re.escape(quoted[1:-1] or "'" if quoted else other))
    return r"^\s*" + "".join(out) + r"\s*$"


def parse_day(text: Column, formats: Sequence[str] = ("yyyy-MM-dd",)) -> Column:
    """First format that reads the text, NULL when none does.

    A format is tried only on texts of its shape: a failing parse costs an
    exception, a pattern match next to nothing.
    """
    tried = [F.when(text.rlike(_shape(f)), F.try_to_timestamp(text, F.lit(f))) for f in formats]
    return F.coalesce(*(t.cast("date") for t in tried))
