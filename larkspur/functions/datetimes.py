"""Date and time functions: week modes, format patterns, interval arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_days(d: Column) -> Column:
    """Days since year 0."""
    return F.datediff(d, F.lit("1970-01-01").cast("date")) + 719528


def weekday(d: Column) -> Column:
    """0 = Monday."""
    return F.pmod(F.dayofweek(d) + 5, F.lit(7))


def _first(year: Column) -> Column:
    return F.make_date(year, F.lit(1), F.lit(1))


def _week_one(year: Column, monday: bool, four_days: bool) -> Column:
    """First day of week 1 of a year: the week that has the year's first Sunday (or
    Monday), or the one with at least four days in the year."""
    first = _first(year)
    into = weekday(first) if monday else F.dayofweek(first) - 1
    if four_days:
        back = F.when(into <= 3, -into).otherwise(7 - into)
    else:
        back = F.when(into == 0, 0).otherwise(7 - into)
    return F.date_add(first, back)


def _year_week(d: Column, mode: int) -> tuple[Column, Column]:
    monday, four = bool(mode & 1), bool(mode & 1) != bool(mode & 4)
    year = F.year(d)
    this, following, before = (_week_one(y, monday, four) for y in (year, year + 1, year - 1))
    of = F.when(d >= following, year + 1).when(d >= this, year).otherwise(year - 1)
    start = F.when(d >= following, following).when(d >= this, this).otherwise(before)
    return of, (F.floor(F.datediff(d, start) / 7) + 1).cast("int")


def week(d: Column, mode: int = 0) -> Column:
    """WEEK: bit 0 weeks begin on Monday, bit 1 weeks count 1 to 53 (of the year they
    belong to) instead of 0 to 53, bit 2 turns the rule for week 1."""
    d = d.cast("date")
    of, number = _year_week(d, mode)
    if mode & 2:
        return number
    monday, four = bool(mode & 1), bool(mode & 1) != bool(mode & 4)
    start = _week_one(F.year(d), monday, four)
    return F.when(d < start, 0).otherwise(F.floor(F.datediff(d, start) / 7) + 1).cast("int")


def yearweek(d: Column, mode: int = 0) -> Column:
    """Year and week (1 to 53) that the day belongs to, as yyyyww."""
    of, number = _year_week(d.cast("date"), mode | 2)
    return of * 100 + number


#: What each mark of a format stands for in Spark's patterns.
PATTERNS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh",
    "l": "h", "i": "mm", "s": "ss", "S": "ss", "p": "a", "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "EEE", "j": "DDD",
}


def pattern_of(fmt: str) -> str:
    """A format's marks in Spark's pattern language; other text quoted."""
    out, text, i = [], "", 0

    def close() -> None:
        nonlocal text
        if text:
            out.append("'" + text.replace("'", "''") + "'")
        text = ""

    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            i += 1
            if fmt[i] in PATTERNS:
                close()
                out.append(PATTERNS[fmt[i]])
            else:
                text += "%" if fmt[i] == "%" else "%" + fmt[i]
        else:
            text += fmt[i]
        i += 1
    close()
    return "".join(out)


def date_format(d: Column, fmt: str) -> Column:
    """DATE_FORMAT; an unknown mark is given as it stands."""
    return F.date_format(d.cast("timestamp"), pattern_of(fmt))


def str_to_date(s: Column, fmt: str) -> Column:
    """STR_TO_DATE; NULL for what doesn't fit."""
    return F.try_to_timestamp(s, F.lit(pattern_of(fmt))).cast("timestamp_ntz")


def add_interval(d: Column, n: Column | int, unit: str) -> Column:
    """d + n units; the day is clamped to the month's end; a date stays one for units of
    a day and more when it is cast so by the caller."""
    n = F.lit(n) if isinstance(n, int) else n
    unit = unit.lower()
    months = {"month": 1, "quarter": 3, "year": 12}
    if unit in months:
        return d + F.make_interval(months=n * months[unit])
    parts = {"week": "weeks", "day": "days", "hour": "hours", "minute": "mins", "second": "secs"}
    if unit == "microsecond":
        return d + F.make_interval(secs=n.cast("decimal(18,6)") / 1000000)
    return d + F.make_interval(**{parts[unit]: n})


def timestampdiff(unit: str, a: Column, b: Column) -> Column:
    """Whole units from a to b, truncated toward zero."""
    return F.timestamp_diff(unit, a.cast("timestamp"), b.cast("timestamp"))


def time_to_sec(t: Column) -> Column:
    """Seconds since midnight of a moment."""
    return F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def sec_to_time(n: Column) -> Column:
    """hh:mm:ss of a number of seconds, within one day."""
    s = F.pmod(n, F.lit(86400))
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat_ws(":", two(s / 3600), two(F.pmod(s, F.lit(3600)) / 60), two(F.pmod(s, F.lit(60))))


def unix_timestamp(t: Column) -> Column:
    """Seconds since 1970 in UTC; 0 if it can't be read."""
    return F.coalesce(F.unix_seconds(t.try_cast("timestamp")), F.lit(0))


def from_unixtime(n: Column) -> Column:
    return F.timestamp_seconds(n).cast("timestamp_ntz")


def dayname(d: Column) -> Column:
    return F.date_format(d.cast("timestamp"), "EEEE")


def monthname(d: Column) -> Column:
    return F.date_format(d.cast("timestamp"), "MMMM")
