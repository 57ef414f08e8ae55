"""Times, durations and severities as log lines write them, as Column expressions.

Null, empty and unreadable texts give null.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
# Severity words of CEF headers and levels of Windows events, as numbers.
CEF_SEVERITY = {"very-high": 10, "high": 8, "medium": 5, "low": 2, "unknown": 0}
WINDOWS_SEVERITY = {0: 6, 1: 2, 2: 3, 3: 4, 4: 6, 5: 7}


def _read(text: Column, form: str) -> Column:
    return F.try_to_timestamp(text, F.lit(form))


def epoch(text: Column, now: datetime.datetime) -> Column:
    """Seconds since 1970 of a syslog, access-log, mail-log or ISO time, or of a number of seconds or milliseconds, in UTC where no zone is told.

    A syslog time has no year: it gets that of ``now``, or the year before where
    it would lie more than a day ahead.
    """
    now = now if now.tzinfo else now.replace(tzinfo=datetime.UTC)
    bare = F.regexp_replace(F.trim(text), r"\s+", " ")
    # The session's zone doesn't count: a text without a zone is given one.
    year = lambda y: _read(F.concat(F.lit(f"{y} "), bare, F.lit(" +0000")), "yyyy MMM d HH:mm:ss Z")
    this, last = (F.unix_timestamp(year(y)) for y in (now.year, now.year - 1))
    ahead = int(now.timestamp()) + DAY
    # A leap day may not exist in this year.
    syslog = F.when(this.isNull() | (this > ahead), last).otherwise(this)
    zoned = bare.rlike(r"(?:Z|[+\-]\d{2}:?\d{2})$")
    iso = F.to_timestamp(F.when(zoned, bare).otherwise(F.concat(bare, F.lit("Z"))).try_cast("timestamp"))
    number = F.regexp_extract(bare, r"^(\d{9,10})(?:\.\d+)?$", 1).try_cast("long")
    return (
        F.when(bare.rlike(r"^[A-Z][a-z]{2} \d{1,2} \d{2}:\d{2}:\d{2}$"), syslog)
        .when(bare.rlike(r"^\d{1,2}/[A-Z][a-z]{2}/\d{4}:"), F.unix_timestamp(_read(bare, "d/MMM/yyyy:HH:mm:ss Z")))
        .when(bare.rlike(r"^[A-Z][a-z]{2} \d{1,2} \d{4} "), F.unix_timestamp(_read(F.concat(bare, F.lit(" +0000")), "MMM d yyyy HH:mm:ss Z")))
        .when(bare.rlike(r"^[A-Z][a-z]{2} [A-Z][a-z]{2} \d{1,2} .* \d{4}$"), F.unix_timestamp(_read(F.concat(F.substring_index(bare, " ", -4), F.lit(" +0000")), "MMM d HH:mm:ss yyyy Z")))
        .when(bare.rlike(r"^\d{13}$"), F.floor(bare.try_cast("long") / 1000))
        .when(bare.rlike(r"^\d{9,10}(?:\.\d+)?$"), number)
        .when(bare.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:"), F.unix_timestamp(iso))
    )


def seconds(text: Column) -> Column:
    """The length of a duration written as h:mm:ss or as 1h2m3s."""
    clock = F.regexp_extract(text, r"^(\d{1,9}):(\d{2}):(\d{2})$", 1) != ""
    part = lambda pattern: F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("long"), F.lit(0).cast("long"))
    by_clock = part(r"^(\d+):") * 3600 + part(r":(\d+):") * 60 + part(r":(\d+)$")
    by_unit = part(r"^(\d+)h") * 3600 + part(r"^(?:\d+h)?(\d+)m") * 60 + part(r"^(?:\d+h)?(?:\d+m)?(\d+)s$")
    return F.when(clock, by_clock).when(text.rlike(r"^(?=\d)(?:\d{1,9}h)?(?:\d{1,9}m)?(?:\d{1,9}s)?$"), by_unit)


def severity(text: Column) -> Column:
    """A CEF header's severity as a number: digits, or a word."""
    words = F.create_map(*[F.lit(x) for pair in CEF_SEVERITY.items() for x in pair])
    return F.coalesce(F.when(text.rlike(r"^\d{1,9}$"), text.try_cast("int")), words[F.lower(F.trim(text))])


def windows_severity(level: Column) -> Column:
    """The syslog severity of a Windows event's level."""
    return F.create_map(*[F.lit(x) for pair in WINDOWS_SEVERITY.items() for x in pair])[level.try_cast("int")]
