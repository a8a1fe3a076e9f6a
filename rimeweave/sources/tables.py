"""Text tables to rows.

Three ways in, one way out:

* ``open_files``: a file of normal size is one row; header, names, date and the
  rows all come from expressions over its lines.  One scan, no shuffle, no join.
* files above ``WHOLE_FILE_BYTES`` are read split by split as numbered lines,
  so that one giant file is the work of many tasks.
* ``open_lines``: numbered lines that already are a DataFrame.

A name is turned into a position once per file; a row then fetches its cells
by position.  Rows with more cells than names are corrupt and dropped, short
rows are padded with NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import masks, numeric
from ..functions.text import strip
from ..operators import filters, guards as unit_guards
from ..operators.project import union_all
from . import files as file_source
from .files import staged
from .formats import CountedHeader, ScannedHeader, TableFormat
from .faults import noted
from .layout import data_offset, header_count, header_position, widest_key, widest_position, with_layout

#: a wanted column: its name, or an expression over the file's ``names``
Wanted = str | Callable[[Column], Column]

_LAYOUT = ["path", "file_name", "names", "flight_date", "metadata", "scales", "flags", "error"]


def _add_header(df: DataFrame, fmt: TableFormat) -> DataFrame:
    h = header_position(fmt, F.col("lines"))
    h = F.when((h >= 0) & (h < F.size("lines")), h)
    return df.withColumn("_h", h).withColumn("header", F.slice("lines", F.lit(1), F.coalesce(F.col("_h") + 1, F.lit(0))))


def _header_of_lines(lines: DataFrame, fmt: TableFormat) -> DataFrame:
    """``path, file_name, _h, header`` of files given as numbered lines.

    The position of the header comes from one mergeable number per file; only
    lines up to it are gathered per file.  Lines beyond the last header line of
    all files are left out before the shuffle.
    """
    rule, number, value = fmt.header, F.col("line_no"), F.col("value")
    files = lines
    if isinstance(rule, CountedHeader):
        files, at = lines.filter(number == 0), F.max(header_count(value) - 1)
    elif isinstance(rule, ScannedHeader):
        at = F.min(F.when(rule.test(value), number))
    else:
        at = widest_position(F.max(widest_key(rule, value, number)))
    found = files.groupBy("path", "file_name").agg(at.cast("int").alias("_h"))
    found = found.withColumn("_h", F.when(F.col("_h") >= 0, F.col("_h")))
    last = found.agg(F.max("_h")).scalar()
    top = lines.filter(number <= last).join(found.select("path", "_h"), "path")
    gathered = top.filter(number <= F.col("_h")).groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("_top")
    )
    return found.join(gathered, "path", "left").select(
        "path", "file_name", "_h", F.coalesce(F.col("_top.value"), F.array().cast("array<string>")).alias("header")
    )


@dataclass
class TextTables:
    """Tables of one format, with layouts found but rows not yet parsed."""

    fmt: TableFormat
    whole: DataFrame | None        # layout columns and ``body ARRAY<STRING>``, one row per file
    split_layout: DataFrame | None  # layout columns and ``_h``, one row per file
    split_lines: DataFrame | None   # ``path, line_no, value``
    listed: DataFrame | None = None  # ``path, file_name`` of every file that was to be read
    marks: DataFrame | None = None   # ``path, file_name, error, n_corrupt`` per file that was read, once rows are staged

    def only(self, condition: Column) -> TextTables:
        """The tables of the files that meet a condition on ``path``, ``file_name`` or ``names``."""

        def kept(df: DataFrame | None) -> DataFrame | None:
            return None if df is None else df.filter(condition)

        return TextTables(self.fmt, kept(self.whole), kept(self.split_layout), self.split_lines)

    def requiring(self, condition: Column, reason: str) -> TextTables:
        """The same tables; files that do not meet the condition have ``reason`` as their error."""

        def judged(df: DataFrame | None) -> DataFrame | None:
            wrong = F.when(~F.coalesce(condition, F.lit(False)), reason)
            return None if df is None else df.withColumn("error", F.coalesce("error", wrong))

        return TextTables(self.fmt, judged(self.whole), judged(self.split_layout), self.split_lines, self.listed)

    def layouts(self) -> DataFrame:
        """One row per file: names, flight date, metadata, scales, flags, error."""
        parts = [p.select(*_LAYOUT) for p in (self.whole, self.split_layout) if p is not None]
        return union_all(parts)

    def errors(self) -> DataFrame:
        """Files that could not be used, with the reason; a listed file of which nothing was read is one of them.

        Once rows are staged this looks at the staged table, not at raw text.
        """
        read = (self.layouts() if self.marks is None else self.marks).select("path", "file_name", "error")
        found = read.filter(F.col("error").isNotNull())
        if self.listed is None:
            return found
        unread = self.listed.join(read.select("path"), "path", "left_anti")
        return found.unionByName(unread.select("path", "file_name", F.lit("file cannot be read").alias("error")))

    def corrupt_counts(self) -> DataFrame:
        """``path, file_name, n_rows``: rows with more cells than names, for each file that has some."""
        if self.marks is not None:
            counted = self.marks.filter(F.col("n_corrupt") > 0)
            return counted.select("path", "file_name", F.col("n_corrupt").alias("n_rows"))
        return self.corrupt_rows().groupBy("path", "file_name").agg(F.count("*").alias("n_rows"))

    def column_names(self, group: Column | None = None) -> dict[str, list[str]]:
        """Column names per group in the order in which files and headers bring them up.

        Read when the plan is built.  This is schema discovery: its size is the
        number of different column names, not of files.
        """
        key = (group if group is not None else F.lit("")).alias("group")
        usable = self.layouts().filter(F.col("error").isNull())
        named = usable.select(key, "path", F.posexplode("names").alias("at", "name"))
        seen = named.groupBy("group", "name").agg(F.min(F.struct("path", "at")).alias("first"))
        found: dict[str, list[str]] = {}
        for r in seen.orderBy("first").collect():
            found.setdefault(r["group"], []).append(r["name"])
        return found

    def _lines(self, carry: Mapping[str, Column], marked: bool = False) -> DataFrame:
        """Lines with text below the headers of usable files; with ``marked`` also a line -1, NULL, for every file."""
        carry = dict(carry)
        columns = ["path", "file_name", "names", "flight_date", "metadata", "scales", "flags"]
        parts = []
        if self.whole is not None:
            usable = self.whole if marked else self.whole.filter(F.col("error").isNull())
            body = F.col("body")
            if marked:
                kept = F.when(F.col("error").isNull(), F.coalesce("body", F.array().cast("array<string>")))
                body = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(kept, F.array().cast("array<string>")))
            usable = usable.withColumns(carry)
            parts.append(usable.select(*columns, *carry, F.posexplode(body).alias("_pos", "value")).select(
                *columns, *carry, (F.col("_pos") - (1 if marked else 0)).alias("line_no"), "value"
            ))
        if self.split_layout is not None:
            layout = self.split_layout.withColumns(carry).drop("header")
            usable = layout.filter(F.col("error").isNull())
            lines = self.split_lines.select("path", "line_no", "value").join(usable, "path")
            start = F.col("_h") + data_offset(self.fmt)
            rows = lines.filter(F.col("line_no") >= start).select(*columns, *carry, (F.col("line_no") - start).alias("line_no"), "value")
            parts.append(rows)
            if marked:
                parts.append(layout.select(*columns, *carry, F.lit(-1).cast("long").alias("line_no"), F.lit(None).cast("string").alias("value")))
        text = F.col("value").rlike(r"\S")
        return union_all(parts).filter((F.col("line_no") < 0) | text if marked else text)

    def corrupt_rows(self) -> DataFrame:
        """Rows with more cells than names."""
        rows = self._lines({}).filter(self.fmt.cell_count(F.col("value")) > F.size("names"))
        return rows.select("path", "file_name", "line_no", "value")

    def _tokens(self, carry: Mapping[str, Column], marked: bool = False) -> DataFrame:
        """Lines with their cells; with ``marked`` a corrupt line n is line -2 - n without cells, otherwise it is left out."""
        rows, tokens = self._lines(carry, marked), self.fmt.tokens(F.col("value"))
        if not marked:
            fits = self.fmt.cell_count(F.col("value")) <= F.size("names")
            return rows.filter(fits).withColumn("_tokens", tokens)
        rows = rows.withColumn("_tokens", tokens)
        cells = F.size("_tokens") if self.fmt.blank_separated else self.fmt.cell_count(F.col("value"))
        corrupt = (F.col("line_no") >= 0) & (cells > F.size("names"))
        return rows.withColumns(
            {"line_no": F.when(corrupt, F.lit(-2) - F.col("line_no")).otherwise(F.col("line_no")), "_tokens": F.when(~corrupt, F.col("_tokens"))}
        )

    def rows(
        self,
        numbers: Mapping[str, Wanted],
        texts: Mapping[str, Wanted] | None = None,
        sentinels: Iterable[float] = (),
        unmasked: Sequence[str] = (),
        carry: Mapping[str, Column] | None = None,
        quality: Callable[[Column], Column] | None = None,
        groups: Mapping[str, Callable[[Column], Column]] | None = None,
        marked: bool = False,
    ) -> DataFrame:
        """Parsed rows: ``source_file, row_no, flight_date``, carried columns, then the wanted ones.

        ``sentinels`` become NULL in all numbers except ``unmasked`` ones.
        Header scales and header flags, where the format has them, are applied
        by position.  ``carry`` adds per-file expressions over the layout.
        ``quality`` picks names whose cells are returned as ``quality ARRAY<STRING>``,
        ``groups`` names whose numbers are returned as arrays.  ``marked`` adds a
        row -1 without cells for each file, and a row -2 - n for a corrupt line n.
        """
        groups = dict(groups or {})
        texts = dict(texts or {})
        carry = dict(carry or {})
        position: dict[str, Column] = {}
        for out, wanted in {**numbers, **texts}.items():
            name = F.lit(wanted) if isinstance(wanted, str) else wanted(F.col("names"))
            at = F.array_position(F.col("names"), name)
            position[f"_at_{out}"] = F.when(at > 0, at.cast("int") - 1)
        if quality is not None:
            picked = quality(F.col("names"))
            position["_at_quality"] = F.transform(picked, lambda n: (F.array_position("names", n) - 1).cast("int"))
        for out, pick in groups.items():
            position[f"_at_{out}"] = F.transform(pick(F.col("names")), lambda n: (F.array_position("names", n) - 1).cast("int"))
        rows = self._tokens({**carry, **position}, marked)
        fixed = [
            F.col("file_name").alias("source_file"), F.col("line_no").cast("bigint").alias("row_no"), "flight_date",
            "scales", "flags", *carry, *position,
        ]
        if quality is not None:
            fixed.append(F.transform("_at_quality", lambda i: strip(F.get("_tokens", i))).alias("quality"))
        sentinel_values = tuple(sentinels)
        for out in groups:
            cells = F.transform(f"_at_{out}", lambda i: F.get("_tokens", i))
            values = numeric.to_numbers(cells, trimmed=self.fmt.blank_separated)
            fixed.append((values if out in unmasked else F.transform(values, lambda v: masks.drop_flags(v, sentinel_values))).alias(out))

        # cell text, number and masked number are steps of their own: as one
        # expression the text would be fetched and parsed once per mention
        def cell(out: str) -> Column:
            token = F.get("_tokens", F.col(f"_at_{out}"))
            return token if self.fmt.blank_separated else strip(token)

        rows = rows.select(*fixed, *[cell(o).alias(o) for o in {**numbers, **texts}])
        rows = rows.withColumns({o: numeric.parse_double(F.col(o)) for o in numbers})

        def masked(out: str) -> Column:
            value, at = F.col(out), F.col(f"_at_{out}")
            if self.fmt.missing_line is not None:
                value = masks.drop_header_flag(value, F.get("flags", at))
            if self.fmt.scale_line is not None:
                value = value * F.coalesce(F.get("scales", at), F.lit(1.0))
            value = F.when(F.abs(value) < F.lit(float("inf")), value)
            return value if out in unmasked else masks.drop_flags(value, sentinel_values)

        verdicts = ["quality"] if quality is not None else []
        return rows.select(
            "source_file", "row_no", "flight_date", *carry, *[masked(o).alias(o) for o in numbers], *texts, *verdicts, *groups
        )

    def late_rows(
        self, numbers: Mapping[str, Wanted], roles: Mapping[str, Callable[[Column], Column]], sentinels: Iterable[float] = (),
        unmasked: Sequence[str] = (),
    ) -> DataFrame:
        """Rows with ``numbers``, and with columns that are chosen over all files after these have been read once.

        A role is a test of a lower-case name.  Of the names that pass, the one
        that comes up first, by path and position, fills the role everywhere.
        Raw text is parsed in one pass: the numbers of all columns that could
        fill a role go to a staged table with their names, together with one
        row per file that says what was wrong with it.  The choice is then a
        minimum over that table, and no name goes to the driver. ``sentinels``
        become NULL in all numbers and roles except ``unmasked`` ones.
        """
        def fits(name: Column) -> Column:
            return reduce(or_, (test(F.lower(name)) for test in roles.values()), F.lit(False))

        def candidates(names: Column) -> Column:
            return F.filter(names, fits)

        carry = {"_names": candidates(F.col("names")), "_path": F.col("path"), "_error": F.col("error")}
        groups = {"_values": candidates} if roles else {}
        sentinels = tuple(sentinels)
        rows = self.rows(numbers, sentinels=sentinels, unmasked=[*unmasked, "_values"], carry=carry, groups=groups, marked=True)
        table = staged(rows, "rows")
        marks = table.filter("row_no < 0")
        self.marks = marks.groupBy(F.col("_path").alias("path"), F.col("source_file").alias("file_name")).agg(
            F.max("_error").alias("error"), F.count_if(F.col("row_no") < -1).alias("n_corrupt")
        )

        def first(role: str) -> Column:
            name = F.when(F.col("_error").isNull(), F.get(F.filter("_names", lambda n: roles[role](F.lower(n))), F.lit(0)))
            return F.min(F.when(name.isNotNull(), F.struct("_path", name.alias("name"))))["name"]

        rows = table.filter("row_no >= 0")
        if roles:
            chosen = marks.filter("row_no = -1").agg(*(first(r).alias(r) for r in roles)).select(F.struct(*roles)).scalar()
            rows = rows.withColumn("_chosen", chosen)

        def cell(role: str) -> Column:
            at = F.array_position("_names", F.col("_chosen")[role])
            value = F.get("_values", F.when(at > 0, at.cast("int") - 1))
            return (value if role in unmasked else masks.drop_flags(value, sentinels)).alias(role)

        return rows.select("source_file", "row_no", "flight_date", *numbers, *(cell(r) for r in roles))

    def guarded_rows(
        self,
        numbers: Mapping[str, Wanted],
        guards: Sequence[unit_guards.Guard],
        sentinels: Iterable[float] = (),
        forced: Mapping[str, Column] | None = None,
        quality: Callable[[Column], Column] | None = None,
    ) -> DataFrame:
        """Rows with units repaired per file, and without rows a quality cell marks bad.

        A file that is one row finds its medians right there, before its lines
        become rows: no shuffle and no second scan.  Files read split by split
        take the aggregate-and-join form of the guards.  ``forced`` maps a
        guarded column to an expression over the file's layout.
        """
        sentinels = tuple(sentinels)
        forced = dict(forced or {})
        force_flags = {f"_force_{c}": v for c, v in forced.items()}
        forced_rows = {c: F.col(f"_force_{c}") for c in forced}

        def is_bad(cell: Column) -> Column:
            return filters.flag_is_bad(cell, sentinels)

        def kept(rows: DataFrame) -> DataFrame:
            return rows.filter(~F.exists("quality", is_bad)).drop("quality") if quality is not None else rows

        def usable_cells() -> Column:
            """Tokens of the lines that become rows, before they do."""
            fits = F.filter("body", lambda l: l.rlike(r"\S") & (self.fmt.cell_count(l) <= F.size("names")))
            tokens = F.transform(fits, lambda l: self.fmt.tokens(l))
            if quality is None:
                return tokens
            at = F.transform(quality(F.col("names")), lambda n: (F.array_position("names", n) - 1).cast("int"))
            return F.filter(tokens, lambda t: ~F.exists(at, lambda i: is_bad(strip(F.get(t, i)))))

        def file_values(wanted: Wanted) -> Column:
            name = F.lit(wanted) if isinstance(wanted, str) else wanted(F.col("names"))
            at = F.array_position("names", name)
            at = F.when(at > 0, at.cast("int") - 1)
            texts = F.transform("_cells", lambda t: strip(F.get(t, at)))
            parsed = F.transform(texts, numeric.parse_double)
            finite = F.transform(parsed, lambda v: F.when(F.abs(v) < F.lit(float("inf")), v))
            return F.filter(F.transform(finite, lambda v: masks.drop_flags(v, sentinels)), lambda v: v.isNotNull())

        wanted_columns = ["source_file", "row_no", "flight_date", *force_flags, *numbers]
        parts = []
        if self.whole is not None:
            verdicts = {f"_fix_{i}": F.col(f"_fix_{i}") for i in range(len(guards))}
            judged = self.whole.withColumn("_cells", usable_cells())
            judged = judged.withColumns({f"_values_{i}": file_values(numbers[g.column]) for i, g in enumerate(guards)})
            judged = judged.withColumns(
                {f"_fix_{i}": unit_guards.array_verdict(g, F.col(f"_values_{i}")) for i, g in enumerate(guards)}
            ).drop("_cells", *[f"_values_{i}" for i in range(len(guards))])
            mine = TextTables(self.fmt, judged, None, None)
            rows = kept(mine.rows(numbers, sentinels=sentinels, carry={**force_flags, **verdicts}, quality=quality))
            parts.append(unit_guards.convert(rows, guards, list(verdicts.values()), forced_rows).select(*wanted_columns))
        if self.split_layout is not None:
            mine = TextTables(self.fmt, None, self.split_layout, self.split_lines)
            carry = {**force_flags, "_file": F.col("path")}  # files in different folders may share a name
            rows = kept(mine.rows(numbers, sentinels=sentinels, carry=carry, quality=quality))
            parts.append(unit_guards.apply_guards(rows, guards, ["_file"], forced_rows).select(*wanted_columns))
        return union_all(parts).drop(*force_flags)

    def cells(self, sentinels: Iterable[float] = ()) -> DataFrame:
        """Every number of every row as ``cells MAP<STRING,DOUBLE>``, for files without known names."""
        flags = tuple(sentinels)
        rows = self._tokens({}).withColumn("_numbers", numeric.to_numbers(F.col("_tokens")))
        padded = F.transform("names", lambda n, i: masks.drop_flags(F.get("_numbers", i), flags))
        return rows.select(
            F.col("file_name").alias("source_file"), F.col("line_no").cast("bigint").alias("row_no"), "flight_date",
            F.map_from_arrays("names", padded).alias("cells"),
        )


def _of_lines(lines: DataFrame, fmt: TableFormat, whole: DataFrame | None = None) -> TextTables:
    layout = with_layout(_header_of_lines(lines, fmt), fmt).select(*_LAYOUT, "_h")
    return TextTables(fmt, whole, layout, lines)


def open_lines(lines: DataFrame, fmt: TableFormat) -> TextTables:
    """Tables given as lines ``path, file_name, line_no, value`` numbered from 0.

    Numbers must grow down a file; only those of the header must be gapless.
    """
    return _of_lines(lines, fmt)


def open_files(
    spark: SparkSession,
    path: str,
    fmt: TableFormat,
    pattern: str = "*",
    recursive: bool = False,
    exclude: str | None = None,
    whole_limit: int = file_source.WHOLE_FILE_BYTES,
    require: tuple[Column, str] | None = None,
) -> TextTables:
    """Tables in the files below ``path``; no matching file is an error.

    ``require`` is a condition on a file's ``path``, ``file_name`` or ``names``, and the error of a file without it.
    """
    listed = file_source.list_files(spark, path, pattern, recursive, exclude)
    large = F.count_if(F.col("length") > whole_limit)
    sizes = listed.agg(F.count(F.lit(1)).alias("n"), large.alias("n_large")).first()
    if not sizes["n"]:
        raise FileNotFoundError(f"no files matching '{pattern}' under {path}")

    whole = _add_header(file_source.read_whole(spark, path, pattern, recursive, exclude, whole_limit), fmt)
    start = F.col("_h") + data_offset(fmt) + 1
    body = F.slice("lines", F.coalesce(start, F.lit(1)), F.size("lines"))
    whole = with_layout(whole, fmt).select(*_LAYOUT, body.alias("body"))
    if sizes["n_large"]:
        tables = _of_lines(file_source.read_split_lines(spark, path, pattern, recursive, exclude, whole_limit), fmt, whole)
    else:
        tables = TextTables(fmt, whole, None, None)
    tables.listed = listed.select("path", "file_name")
    return noted(tables.requiring(*require) if require else tables)
