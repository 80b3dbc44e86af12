"""Dates, weeks and ages as column expressions; the clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieve.functions.text import blank

_FULL_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
_COMPACT = r"^\d{8}T\d{6}Z?$"
_DAY = 86_400_000_000
# The zones that mail dates may name, as offsets.
ZONES = {"EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700", "GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000"}


def instant(c: Column) -> Column:
    """A time without a zone as UTC, whatever the session's zone."""
    return F.try_to_timestamp(F.concat(c.cast("string"), F.lit("Z")))


def local_day(ts: Column, zone: str = "UTC") -> Column:
    """The date that a clock in the zone shows; from the microseconds, so the session's zone plays no part."""
    return F.date_from_unix_date(F.floor(_local_micros(ts, zone) / _DAY).cast("int"))


def _local_micros(ts: Column, zone: str) -> Column:
    return F.unix_micros(F.from_utc_timestamp(ts, zone))


def _local_part(ts: Column, zone: str, unit: int, most: int) -> Column:
    return F.pmod(F.floor(_local_micros(ts, zone) / unit), F.lit(most)).cast("int")


def iso(ts: Column) -> Column:
    """UTC ISO text in seconds."""
    parts = [F.lpad(_local_part(ts, "UTC", unit, most).cast("string"), 2, "0") for unit, most in ((3_600_000_000, 24), (60_000_000, 60), (1_000_000, 60))]
    return F.concat(local_day(ts).cast("string"), F.lit("T"), F.concat_ws(":", *parts), F.lit("+00:00"))


def parse_iso(c: Column) -> Column:
    """Timestamp of a full or compact ISO text; naive times are UTC; null otherwise."""
    text = F.trim(blank(c))
    naive = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z"))).when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & (F.length(text) > 10), text).otherwise(F.concat(text, F.lit("Z")))
    naive = F.regexp_replace(naive, r"^(.{10}[T ]\d{2}:\d{2})([Z+-])", "$1:00$2")
    compact = F.concat(F.regexp_replace(text, "Z$", ""), F.lit("+0000"))
    return F.when(text.rlike(_FULL_ISO), F.try_to_timestamp(naive)).when(text.rlike(_COMPACT), F.try_to_timestamp(compact, F.lit("yyyyMMdd'T'HHmmssxx")))


def parse_date(c: Column) -> Column:
    """UTC ISO text in seconds of epoch seconds or milliseconds, RFC 2822 or ISO; else the first 80 characters."""
    text = F.trim(blank(c))
    n = F.try_to_number(text, F.lit("9" * 18)).cast("long")
    epoch = F.when(text.rlike(r"^\d{1,18}$"), F.timestamp_seconds(F.when(n > 10_000_000_000, F.floor(n / 1000)).otherwise(n)))
    mail = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\s*\(.*\)$", ""), r"\s+", " ")
    named = F.create_map(*(F.lit(x) for pair in ZONES.items() for x in pair))
    zone = F.regexp_extract(mail, r" ([A-Za-z]+)$", 1)
    mail = F.when(zone != "", F.concat(F.substring_index(mail, " ", 4), F.lit(" "), F.try_element_at(named, F.upper(zone)))).when(mail.rlike(r":\d{2}$"), F.concat(mail, F.lit(" +0000"))).otherwise(mail)
    rfc = F.when(text.rlike(r"\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}"), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss xx")))
    return F.when(text == "", "").otherwise(F.coalesce(iso(F.coalesce(epoch, rfc, parse_iso(text))), F.left(text, F.lit(80))))


def age_days(posted: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(posted)) / F.lit(86_400_000_000.0)


def recent(age: Column, limit: float, missing_ok: bool = False) -> Column:
    """No limit passes all; a missing age passes if allowed; a day in the future is tolerated."""
    return F.lit(True) if limit <= 0 else F.when(age.isNull(), F.lit(missing_ok)).otherwise((age >= -1) & (age <= limit))


def week_key(ts: Column, zone: str = "UTC") -> Column:
    """ISO week of a timestamp in a zone, as 2026-W25."""
    day = local_day(ts, zone)
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def in_send_window(ts: Column, zone: str, weekday: int, hour: int) -> Column:
    return (F.weekday(local_day(ts, zone)) == weekday) & (_local_part(ts, zone, 3_600_000_000, 24) == hour)


def week_range(monday: Column) -> Column:
    """June 15-21, 2026; both months, or both years, where they differ."""
    sunday = F.date_add(monday, 6)
    same_month = F.concat(F.date_format(monday, "MMMM d"), F.lit("-"), F.date_format(sunday, "d, yyyy"))
    same_year = F.concat(F.date_format(monday, "MMMM d"), F.lit(" - "), F.date_format(sunday, "MMMM d, yyyy"))
    other = F.concat(F.date_format(monday, "MMMM d, yyyy"), F.lit(" - "), F.date_format(sunday, "MMMM d, yyyy"))
    return F.when(F.date_format(monday, "yyyyMM") == F.date_format(sunday, "yyyyMM"), same_month).when(F.year(monday) == F.year(sunday), same_year).otherwise(other)


def monday_of(key: Column) -> Column:
    """First day of a week key; null for other texts."""
    fourth = F.make_date(F.try_to_number(F.left(key, F.lit(4)), F.lit("9999")).cast("int"), F.lit(1), F.lit(4))
    weeks = F.try_to_number(F.substring(key, 7, 2), F.lit("99")).cast("int") - 1
    return F.when(key.rlike(r"^\d{4}-W\d{2}$"), F.date_add(F.date_sub(fourth, F.weekday(fourth)), weeks * 7))
