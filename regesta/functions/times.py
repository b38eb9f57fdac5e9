"""Instants as ISO text, periods and delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regesta.functions.keys import instant

RETENTION_YEARS, MX_DAYS, LONGEST_BACKOFF_MS = 3, 30, 300_000


def _utc(at: Column) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz"))


def iso_text(at: Column) -> Column:
    """A timestamp as ISO-8601 in UTC, to the millisecond."""
    return F.date_format(_utc(at), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def campaign_day(at: Column) -> Column:
    return F.date_format(_utc(at), "yyyy-MM-dd")


def years_before(now: Column, years: int) -> Column:
    """The same instant of an earlier year, as ISO text; 29 February becomes 1 March where there is none."""
    year = F.substring(now, 1, 4).cast("int") - years
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    day = F.when((F.substring(now, 6, 5) == "02-29") & ~leap, "03-01").otherwise(F.substring(now, 6, 5))
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), day, F.substr(now, F.lit(11)))


def backoff_ms(attempts: Column) -> Column:
    return F.least(F.lit(1000.0) * F.pow(F.lit(2.0), attempts - 1), F.lit(float(LONGEST_BACKOFF_MS))).cast("long")


def is_fresh(verified_at: Column, now: Column, days: int = MX_DAYS) -> Column:
    """Verified no longer ago than that; a null instant is stale."""
    return F.coalesce(instant(verified_at) >= instant(now) - F.make_dt_interval(F.lit(days)), F.lit(False))


def retry_after_ms(header: Column, now: Column) -> Column:
    """Milliseconds that a server asks to wait, in seconds or as a date; a minute if it does not say, an hour at most."""
    seconds = F.when(header.rlike(r"^\s*\d+\s*$"), F.trim(header).try_cast("long") * 1000)
    date = F.try_to_timestamp(F.regexp_replace(F.trim(header), r"^\w+,\s*|\s*GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    until = F.when(date.isNotNull(), F.greatest(F.unix_millis(date) - F.unix_millis(instant(now)), F.lit(0).cast("long")))
    return F.least(F.coalesce(seconds, until, F.lit(60_000).cast("long")), F.lit(3_600_000).cast("long"))


def is_transient(status: Column) -> Column:
    return status.isin(408, 429) | status.between(500, 599)


def commune_outcome(page_status: Column, depth: Column) -> Column:
    """What the outcome of a root page says of its municipality; null below the root and for a page that was read."""
    return F.when((depth == 0) & (page_status != "visitee"), F.when(page_status == "bloquee", "interdit_robots").when(page_status == "hors_type", "refuse").otherwise("injoignable"))
