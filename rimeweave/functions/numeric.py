"""Number handling: coercion, finiteness and affine decoding.

Missing values are NULL everywhere in this package.  Spark orders NaN above
every number and lets it poison sums, so NaN and the infinities are turned
into NULL where a value enters and where an expression can create them.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip


def num(x: float) -> Column:
    """A DOUBLE literal (a bare SQL literal such as 0.01 would be DECIMAL)."""
    return F.lit(float(x))


def finite(value: Column) -> Column:
    """NaN and +-infinity become NULL."""
    return F.when(~F.isnan(value) & (F.abs(value) < num(float("inf"))), value)


def parse_double(trimmed: Column) -> Column:
    """Trimmed text to DOUBLE, NULL if it is no number; too large a number is infinite.

    A look at the first and last character keeps words away from the parser,
    where each would cost an exception, and so does with a type suffix ("12d"),
    which the JVM parser would accept.
    """
    first, last = F.ascii(trimmed), F.ascii(F.right(trimmed, F.lit(1)))
    # first: digit, sign or point; last: digit or point (',' and '/' fail in the parser)
    return F.when(first.between(43, 57) & last.between(46, 57), trimmed.try_cast("double"))


def to_number(text: Column) -> Column:
    """Text to DOUBLE; anything that is not a finite number becomes NULL."""
    return finite(parse_double(strip(text)))


def to_numbers(texts: Column, trimmed: bool = False) -> Column:
    """``to_number`` of each text of an array; texts that are ``trimmed`` are not trimmed again.

    Each step goes over the whole array: a lambda is interpreted, so that one with
    all steps would trim and parse a text again at each mention.
    """
    parsed = F.transform(texts if trimmed else F.transform(texts, strip), parse_double)
    return F.transform(parsed, lambda v: F.when(F.abs(v) < num(float("inf")), v))


def affine(raw: Column, scale: float, offset: float = 0.0) -> Column:
    """``raw * scale + offset``."""
    scaled = raw.cast("double") * num(scale)
    return scaled + num(offset) if offset else scaled


def packed_decimal(raw: Column) -> Column:
    """Decode integers stored as (value + 100) * 1000."""
    return raw.cast("double") / num(1000) - num(100)


def kelvin_to_celsius(kelvin: Column) -> Column:
    return kelvin - num(273.15)


def celsius_to_kelvin(celsius: Column) -> Column:
    return celsius + num(273.15)


def feet_to_metres(feet: Column) -> Column:
    return feet * num(0.3048)


def pascal_to_hectopascal(pascal: Column) -> Column:
    return pascal / num(100)
