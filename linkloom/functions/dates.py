"""Date parsing, arithmetic and rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"


def _ts(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt))


def _rfc3339(text: Column) -> Column:
    ok = text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    return F.when(ok, F.try_to_timestamp(F.regexp_replace(F.upper(text), " ", "T")))


def parse_rfc3339_loose(text: Column) -> Column:
    """RFC 3339, or its first 19 characters, or date and time, or a bare date."""
    return F.coalesce(
        _rfc3339(text),
        _rfc3339(F.concat(F.substring(text, 1, 19), F.lit("Z"))),
        _rfc3339(F.concat(F.regexp_replace(text, " ", "T"), F.lit("Z"))),
        _rfc3339(F.concat(text, F.lit("T00:00:00Z"))))


def parse_rfc2822(text: Column) -> Column:
    """``[Fri, ]23 Dec 2022 13:04:48 -0600``; the weekday is dropped before parsing."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(bare, r"\s(GMT|UT|UTC|Z)$", " +0000")
    padded = F.regexp_replace(zoned, r"^(\d) ", "0$1 ")
    ok = padded.rlike(rf"^\d{{2}} {_MONTHS} \d{{4}} \d{{2}}:\d{{2}}:\d{{2}} [+-]\d{{4}}$")
    return F.when(ok, _ts(padded, "dd MMM yyyy HH:mm:ss xx"))


def parse_slashdot_time(text: Column, eastern: bool = True) -> Column:
    """``on Monday January 09, 2023 @08:25PM``.

    The site prints Eastern wall time. ``eastern=True`` converts it; ``False`` keeps the
    wall time as if it were UTC.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), "^(on )+", ""), "[@,]", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z]+day ", "")
    bare = F.regexp_replace(F.upper(F.regexp_replace(bare, r"\s+", " ")), r"([AP]M)$", "$1")
    proper = F.initcap(F.lower(bare))
    fixed = F.concat(F.regexp_replace(proper, r"(?i)[ap]m$", ""),
                     F.upper(F.regexp_extract(proper, r"(?i)([ap]m)$", 1)))
    ok = fixed.rlike(r"^[A-Z][a-z]+ \d{1,2} \d{4} \d{2}:\d{2}[AP]M$")
    ts = F.when(ok, _ts(fixed, "MMMM d yyyy hh:mma"))
    return F.to_utc_timestamp(ts, "US/Eastern") if eastern else ts


def from_parts(year: Column, month: Column, day: Column) -> Column:
    return F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0))


def from_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def from_millis(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def to_rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def to_rfc2822(ts: Column) -> Column:
    return F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss '+0000'")


def absolute_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss 'UTC'")


def add_months(ts: Column, n: int | Column) -> Column:
    """Calendar months, keeping the time of day and clamping to the month's last day."""
    return ts + F.make_ym_interval(F.lit(0), F.lit(n) if isinstance(n, int) else n)


def add_days(ts: Column, n: int | Column) -> Column:
    return ts + F.make_dt_interval(F.lit(n) if isinstance(n, int) else n)


def age_seconds(now: Column, ts: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(1000000.0)


def relative_time(ts: Column, now: Column) -> Column:
    s = F.unix_seconds(now) - F.unix_seconds(ts)

    def label(unit: int, word: str) -> Column:
        return F.concat(F.floor(s / unit).cast("bigint").cast("string"), F.lit(word))

    return (F.when(s > 750 * 86400, label(365 * 86400, " years ago"))
            .when(s > 60 * 86400, label(30 * 86400, " months ago"))
            .when(s > 2 * 86400, label(86400, " days ago"))
            .when(s > 120 * 60, label(3600, " hours ago"))
            .when(s > 60 * 60, F.lit("an hour ago"))
            .otherwise(F.lit("recently added")))


def approx_time(ts: Column, now: Column) -> Column:
    past = F.unix_seconds(now) - F.unix_seconds(ts)
    s = F.abs(past)

    def label(unit: int, word: str) -> Column:
        # This form rounds the binary value exactly; printf style rounds its decimal text.
        shown = F.call_function("format_number", s / unit, F.lit("0.00"))
        return F.concat(shown, F.lit(word))

    size = (F.when(s > 86400, label(86400, " day(s)"))
            .when(s > 3600, label(3600, " hour(s)"))
            .when(s > 60, label(60, " minutes(s)"))
            .when(s > 1, F.concat(s.cast("string"), F.lit(" second(s)"))))
    return (F.when(past > 0, F.coalesce(F.concat(size, F.lit(" ago")), F.lit("just now")))
            .otherwise(F.coalesce(F.concat(F.lit("in "), size), F.lit("now"))))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)
