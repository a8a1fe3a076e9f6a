"""Header text: column names and the choice of a column by name.

The ``*_expr`` helpers work on array columns inside a query; the plain Python
helpers work on the short list of distinct header names of a campaign.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, functions as F

from .text import strip


# ---------------------------------------------------------------- in a query

def strip_each(name: Column) -> Column:
    """:func:`strip` as a one-argument step over an array."""
    return strip(name)


def clean_name(name: Column) -> Column:
    """Trim, turn runs of non-word characters into one underscore, strip underscores."""
    return F.btrim(F.regexp_replace(strip(name), r"(?U)[^\w]+", "_"), F.lit("_"))


def names_with_units(line: Column) -> Column:
    """Blank-separated names; a token in parentheses belongs to the name before it."""
    pairs = F.regexp_extract_all(line, F.lit(r"(\S+(?:\s+\(\S*\)(?=\s|$))?)"), 1)
    return F.transform(pairs, clean_name)


def split_names(line: Column, separator: str) -> Column:
    """Trimmed, non-empty names."""
    return F.filter(F.transform(F.split(line, separator), strip_each), lambda n: n != "")


def unique_names(names: Column, joiner: str = "_") -> Column:
    """Second and later uses of a name get ``_1``, ``_2`` ...; empty becomes ``unnamed``."""
    filled = F.transform(F.transform(names, strip_each), lambda n: F.when(n == "", F.lit("unnamed")).otherwise(n))

    def suffixed(name: Column, position: Column) -> Column:
        earlier = F.size(F.filter(F.slice(filled, F.lit(1), position), lambda other: other == name))
        return F.when(earlier == 0, name).otherwise(F.concat(name, F.lit(joiner), earlier.cast("string")))

    return F.transform(filled, suffixed)


def first_where(names: Column, test: Callable[[Column], Column]) -> Column:
    """First array element that passes the test, else NULL."""
    return F.get(F.filter(names, test), F.lit(0))


def first_candidate(names: Column, candidates: Sequence[str]) -> Column:
    """First candidate that is among the names, in candidate order."""
    wanted = F.array(*[F.lit(c) for c in candidates])
    return first_where(wanted, lambda c: F.array_contains(names, c))


def three_tier(names: Column, candidates: Sequence[str]) -> Column:
    """Exact name, else equal after cleaning and lower-casing, else cleaned name contains one.

    The first two tiers follow candidate order, the last one follows column
    order.  Where cleaning makes two columns equal the later one is taken.
    """
    keys = [re.sub(r"[^\w]+", "_", c.strip()).strip("_").lower() for c in candidates]

    def key(name: Column) -> Column:
        return F.lower(clean_name(name))

    def last_with(k: str) -> Column:
        return F.get(F.reverse(F.filter(names, lambda n: key(n) == F.lit(k))), F.lit(0))

    by_key = [last_with(k) for k in keys]

    def contains_any(name: Column) -> Column:
        test = F.lit(False)
        for k in keys:
            test = test | F.contains(key(name), F.lit(k))
        return test

    return F.coalesce(first_candidate(names, candidates), *by_key, first_where(names, contains_any))


def time_column(names: Column, preferred: Column, fallbacks: Sequence[str]) -> Column:
    """Preferred name, else a fallback, else a name with time/utc in it, else the first."""
    return F.coalesce(
        F.when(F.array_contains(names, preferred), preferred),
        first_candidate(names, fallbacks),
        first_where(names, lambda n: F.lower(n).contains("time") | F.lower(n).contains("utc")),
        F.get(names, F.lit(0)),
    )


# ------------------------------------------------- on discovered header names

def pick(names: Iterable[str], candidates: Sequence[str]) -> str | None:
    present = set(names)
    return next((c for c in candidates if c in present), None)


def pick_containing(names: Iterable[str], *tokens: str) -> str | None:
    return next((n for n in names if any(t in n.lower() for t in tokens)), None)


def pick_suffix(names: Iterable[str], contains: str, suffix: str) -> str | None:
    return next((n for n in names if contains in n.lower() and n.upper().endswith(suffix.upper())), None)


def with_prefix(name: str, prefix: str, always: bool = False) -> str:
    """Prefixed name; unless it must be ``always``, a name that already starts with the prefix stays."""
    return name if name.startswith(prefix) and not always else f"{prefix}_{name}"
