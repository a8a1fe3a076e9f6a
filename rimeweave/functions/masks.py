"""Null-out masks: a bad value becomes NULL, the row stays."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from .numeric import num


def drop_flags(value: Column, flags: Iterable[float]) -> Column:
    """NULL where the value equals one of the fill flags (compared as DOUBLE)."""
    literals = [num(f) for f in sorted(set(map(float, flags)))]
    return F.when(~value.isin(*literals), value) if literals else value


def drop_scaled_flags(value: Column, flags: Iterable[float], scale: float) -> Column:
    """Fill flags that went through a scale factor together with the data."""
    return drop_flags(value, [f * scale for f in flags])


def drop_header_flag(value: Column, flag: Column) -> Column:
    """NULL where the raw value equals the flag given in the file's own header."""
    return F.when(flag.isNull() | (value != flag), value)


def keep_range(value: Column, low: float, high: float) -> Column:
    """NULL outside the closed range."""
    return F.when(value.between(num(low), num(high)), value)


def keep_half_open(value: Column, above: float, high: float) -> Column:
    """NULL unless ``above < value <= high``."""
    return F.when((value > num(above)) & (value <= num(high)), value)


def keep_positive(value: Column) -> Column:
    return F.when(value > num(0), value)


def keep_magnitude(value: Column, limit: float) -> Column:
    return F.when(F.abs(value) <= num(limit), value)


def drop_if_above(value: Column, other: Column, margin: float) -> Column:
    """NULL where ``value > other + margin``; an unknown ``other`` masks nothing."""
    return F.when(~F.coalesce(value > other + num(margin), F.lit(False)), value)


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp into the closed range; NULL stays NULL (greatest/least would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, num(high)), num(low)))
