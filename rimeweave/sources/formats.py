"""Descriptions of the text table shapes, as data."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from ..functions import names as N
from ..functions.text import strip


@dataclass(frozen=True)
class CountedHeader:
    """The first number of line 1 is the number of header lines."""

    names_back: int = 1   # names stand this many lines before the data


@dataclass(frozen=True)
class ScannedHeader:
    """The first line that passes ``test`` holds the names; data follow ``skip`` lines later."""

    test: Callable[[Column], Column]
    skip: int


@dataclass(frozen=True)
class WidestHeader:
    """Of the lines containing ``marker``, the one with most columns, ties to the later line."""

    marker: str
    least_columns: int


@dataclass(frozen=True)
class TableFormat:
    header: CountedHeader | ScannedHeader | WidestHeader = field(default_factory=CountedHeader)
    blank_separated: bool = False
    #: header line -> names; None when ``fixed_names`` is given
    names: Callable[[Column], Column] | None = None
    fixed_names: Sequence[str] = ()
    #: (header, file_name, metadata) -> DATE
    date: Callable[[Column, Column, Column], Column] | None = None
    date_required: bool = True
    required: Sequence[str] = ()
    metadata: bool = False
    #: header line index with one scale factor / one missing flag per column
    scale_line: int | None = None
    missing_line: int | None = None
    repeated_names_fail: bool = True

    def tokens(self, line: Column) -> Column:
        return F.split(strip(line), r"\s+") if self.blank_separated else comma_cells(line)

    def cell_count(self, line: Column) -> Column:
        """Number of cells without building them."""
        if self.blank_separated:
            return F.regexp_count(line, F.lit(r"\S+"))
        commas = F.length(line) - F.length(F.replace(line, F.lit(","), F.lit(""))) + 1
        quoted = F.regexp_count(F.concat(F.lit(","), line), F.lit(_CELL))
        return F.when(F.contains(line, F.lit('"')), quoted).otherwise(commas)


#: a comma and its cell: quoted to the next comma or the end, with doubled quotes inside, or anything up to a comma
_CELL = r',("[^"]*+(?:""[^"]*+)*+"(?=,|$)|[^,]*)'


def comma_cells(line: Column) -> Column:
    """Cells between commas; a quoted cell may hold commas, and loses its quotes.

    A quote that is not closed before a comma or the end of the line, or that
    does not come first in its cell, is an ordinary character.
    """
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(1))

    def bare(cell: Column) -> Column:
        inside = F.substring(cell, F.lit(2), F.length(cell) - 2)
        closed = cell.startswith('"') & cell.endswith('"') & (F.length(cell) > 1)
        return F.when(closed, F.replace(inside, F.lit('""'), F.lit('"'))).otherwise(cell)

    return F.when(F.contains(line, F.lit('"')), F.transform(cells, bare)).otherwise(F.split(line, ","))


# ------------------------------------------------------------------- names

def comma_names(line: Column) -> Column:
    return N.split_names(line, ",")


def blank_names(line: Column) -> Column:
    return F.filter(F.split(strip(line), r"\s+"), lambda n: n != "")


def clean_blank_names(line: Column) -> Column:
    return F.transform(blank_names(line), N.clean_name)


def unit_names(line: Column) -> Column:
    return N.names_with_units(line)


def unique_comma_names(line: Column) -> Column:
    return N.unique_names(F.split(line, ","))


def dotted_comma_names(line: Column) -> Column:
    return N.unique_names(F.split(line, ","), joiner=".")


# ------------------------------------------------------------------- dates

def date_from_blank_line(header: Column, file_name: Column, metadata: Column) -> Column:
    """First header line that starts with ``YYYY MM DD``."""
    pattern = r"^\s*(\d{4})\s+(\d{2})\s+(\d{2}).*$"
    line = N.first_where(header, lambda l: l.rlike(pattern))
    return F.try_to_date(F.regexp_replace(line, pattern, "$1-$2-$3"), "yyyy-MM-dd")


def date_from_comma_line(header: Column, file_name: Column, metadata: Column) -> Column:
    """First header line whose first three comma fields are a plausible year, month and day.

    Plausible: 1991 to 2099, 1 to 12, 1 to 31.
    """
    pattern = r"^\s*0*(199[1-9]|20\d\d)\s*,\s*0*(1[0-2]|[1-9])\s*,\s*0*(3[01]|[12]\d|[1-9])\s*(,.*)?$"
    line = N.first_where(header, lambda l: l.rlike(pattern))
    return F.try_to_date(F.regexp_replace(line, pattern, "$1-$2-$3"), "y-M-d")


def date_from_name(pattern: str, layout: str) -> Callable[[Column, Column, Column], Column]:
    """Date in the file name: the first group of ``pattern`` read as ``layout``."""

    def read(header: Column, file_name: Column, metadata: Column) -> Column:
        return F.try_to_date(F.regexp_extract(file_name, pattern, 1), layout)

    return read


def date_from_text(header: Column, file_name: Column, metadata: Column) -> Column:
    """First ``Flight Date: 2008/Mar/31`` in the header, any case."""
    pattern = r"(?i)flight\s+date\s*:\s*(\d{4}/\w{3}/\d{1,2})"
    dates = F.transform(header, lambda l: F.try_to_date(F.initcap(F.regexp_extract(l, pattern, 1)), "y/MMM/d"))
    return N.first_where(dates, lambda d: d.isNotNull())


def date_from_name_or_metadata(pattern: str, layout: str, keys: Sequence[str]) -> Callable[[Column, Column, Column], Column]:
    named = date_from_name(pattern, layout)

    def read(header: Column, file_name: Column, metadata: Column) -> Column:
        options = [named(header, file_name, metadata)]
        for key in keys:
            value = F.substring(metadata[key], 1, 10)
            options += [F.try_to_date(value, p) for p in ("y/M/d", "y-M-d", "yyyyMMdd")]
        return F.coalesce(*options)

    return read
