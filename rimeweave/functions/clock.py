"""Time stamps from the pieces that flight files carry.

All arithmetic is on microseconds since the epoch, so the results do not
depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import num

MICROS_PER_SECOND = 1_000_000
MICROS_PER_DAY = 86_400 * MICROS_PER_SECOND


def yymmdd_to_date(packed: Column) -> Column:
    """Decode 20YYMMDD held as a number; an impossible date is NULL."""
    return F.try_to_date(F.lpad((packed.cast("bigint") + F.lit(20_000_000)).cast("string"), 8, "0"), "yyyyMMdd")


def seconds_after(date: Column, seconds: Column) -> Column:
    """Midnight of ``date`` (UTC) plus seconds; fractions and values past a day are kept.

    Seconds beyond +-1e10 (an unmasked fill value) give NULL, not an overflow.
    """
    ticks = F.floor(seconds * num(MICROS_PER_SECOND) + num(0.5))
    micros = F.unix_date(date).cast("bigint") * F.lit(MICROS_PER_DAY) + ticks
    return F.when(F.abs(seconds) <= num(1e10), F.timestamp_micros(micros))


def hms_after(date: Column, hours: Column, minutes: Column, seconds: Column) -> Column:
    """Midnight of ``date`` plus H, M and S; missing parts count as zero, fractions are cut."""

    def whole(part: Column) -> Column:
        bounded = F.when(F.abs(part) <= num(1e9), part)
        return F.coalesce(bounded.cast("bigint"), F.lit(0).cast("bigint"))

    total = whole(hours) * F.lit(3600) + whole(minutes) * F.lit(60) + whole(seconds)
    return seconds_after(date, total.cast("double"))
