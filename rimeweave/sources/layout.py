"""What a file says about itself: names, date, metadata, scales.

Everything here works on the ``header`` array of one file as expressions, so a
file's layout is found in the task that reads the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import clean_name
from ..functions.numeric import to_numbers
from ..functions.text import strip
from .formats import CountedHeader, ScannedHeader, TableFormat, WidestHeader

# fixed values: what marks a whole file as unusable in its metadata
FILE_FLAG_KEYS = ("flag", "qc", "quality", "status", "valid")
FILE_BAD_WORDS = (
    "invalid", "bad", "reject", "rejected", "failed", "suspect",
    "do_not_use", "do not use", "exclude", "excluded", "not valid",
)
FILE_FALSE_WORDS = ("0", "false", "no", "f")

#: room for a line number below the width of a header candidate
POSITION_SPAN = 1 << 40


def header_count(first_line: Column) -> Column:
    """Number of header lines stated at the start of line 1."""
    token = F.get(F.split(strip(first_line), r"[,\s]+"), F.lit(0))
    return F.when(token.rlike(r"^\d{1,9}$"), token.try_cast("int"))


def column_count(line: Column) -> Column:
    return F.size(F.split(line, ","))


def widest_key(rule: WidestHeader, line: Column, position: Column) -> Column:
    """Width and position of a header candidate as one ordered number; NULL for other lines."""
    fits = line.contains(rule.marker) & (column_count(line) >= rule.least_columns)
    return F.when(fits, column_count(line).cast("bigint") * F.lit(POSITION_SPAN) + position.cast("bigint"))


def widest_position(key: Column) -> Column:
    return F.pmod(key, F.lit(POSITION_SPAN)).cast("int")


def header_position(fmt: TableFormat, lines: Column) -> Column:
    """0-based index of the last header line of a file held as an array, NULL if not found."""
    rule = fmt.header
    if isinstance(rule, CountedHeader):
        return header_count(F.get(lines, F.lit(0))) - 1
    if isinstance(rule, ScannedHeader):
        at = F.array_position(F.transform(lines, rule.test), F.lit(True))
        return F.when(at > 0, at.cast("int") - 1)
    return widest_position(F.array_max(F.transform(lines, lambda l, i: widest_key(rule, l, i))))


def data_offset(fmt: TableFormat) -> int:
    """Lines from the last header line to the first data line."""
    return fmt.header.skip if isinstance(fmt.header, ScannedHeader) else 1


def key_value_metadata(header: Column) -> Column:
    """``key: value`` lines, else ``key, value`` lines with at most three commas; the last use of a key wins."""

    def entry(text: Column, at_line: Column) -> Column:
        colon, comma = F.locate(":", text), F.locate(",", text)
        at = F.when(colon > 0, colon).otherwise(comma)
        rest = strip(F.substr(text, at + 1))
        n_commas = F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))
        return F.struct(
            clean_name(F.left(text, at - 1)).alias("key"), at_line.alias("line"),
            F.when(colon > 0, rest).otherwise(F.regexp_replace(rest, r"\s*,\s*", ", ")).alias("value"),
            (colon > 0).alias("colon"),
            (n_commas.between(1, 3) & ~rest.startswith(",")).alias("listed"),
        )

    def usable(e: Column) -> Column:
        told = e["colon"] | (e["listed"] & ~e["key"].contains("Time_Start"))
        return told & (e["key"] != "") & (e["value"] != "")

    def last_of_key(entries: Column) -> Column:
        """Of entries in order of key and line, those that no entry of the same key follows."""
        return F.filter(entries, lambda e, i: ~F.coalesce(F.get(entries, i + 1)["key"] == e["key"], F.lit(False)))

    # an array of one element binds a value that a lambda uses more than once
    entries = F.array_sort(F.filter(F.transform(F.transform(header, strip), entry), usable))
    kept = F.get(F.transform(F.array(entries), last_of_key), F.lit(0))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e["value"])))


def metadata_marks_bad(metadata: Column) -> Column:
    """Whether a quality entry of the metadata rules the whole file out."""

    def bad(e: Column) -> Column:
        key, value = F.lower(e["key"]), F.lower(strip(e["value"]))
        quality = F.lit(False)
        for token in FILE_FLAG_KEYS:
            quality = quality | key.contains(token)
        worded = F.lit(False)
        for word in FILE_BAD_WORDS:
            worded = worded | value.contains(word)
        return quality & (worded | (key.contains("valid") & value.isin(*FILE_FALSE_WORDS)))

    return F.exists(F.map_entries(metadata), bad)


def numbers_before_comment(line: Column) -> Column:
    tokens = F.split(strip(F.substring_index(line, ";", 1)), r"\s+")
    return to_numbers(tokens)


def with_layout(files: DataFrame, fmt: TableFormat) -> DataFrame:
    """Add ``names, flight_date, metadata, scales, flags, error`` to rows that have ``header`` and ``_h``."""
    header, h = F.col("header"), F.col("_h")
    problems: list[Column] = [F.when(h.isNull() | (h < 0), "no table header found")]

    metadata = F.lit(None).cast("map<string,string>")
    if fmt.metadata:
        metadata = key_value_metadata(F.slice(header, F.lit(1), F.greatest(F.size(header) - 1, F.lit(0))))
    files = files.withColumn("metadata", metadata)

    if fmt.fixed_names:
        names = F.array(*[F.lit(n) for n in fmt.fixed_names])
    else:
        back = fmt.header.names_back if isinstance(fmt.header, CountedHeader) else 1
        names = fmt.names(F.get(header, h - (back - 1)))
    date = fmt.date(header, F.col("file_name"), F.col("metadata")) if fmt.date else F.lit(None).cast("date")
    files = files.withColumns({"names": names, "flight_date": date})

    problems.append(F.when(F.coalesce(F.size("names") < 1, F.lit(True)), "no column names"))
    if fmt.date and fmt.date_required:
        problems.append(F.when(F.col("flight_date").isNull(), "no flight date"))
    if fmt.repeated_names_fail:
        problems.append(F.when(F.size(F.array_distinct("names")) < F.size("names"), "repeated column name"))
    if fmt.required:
        lacking = F.array_except(F.array(*[F.lit(r) for r in fmt.required]), F.col("names"))
        problems.append(F.when(F.size(lacking) > 0, F.concat(F.lit("missing columns: "), F.concat_ws(", ", lacking))))
    if fmt.metadata:
        problems.append(F.when(metadata_marks_bad(F.col("metadata")), "file marked bad in its metadata"))

    def line_numbers(at: int | None) -> Column:
        if at is None:
            return F.lit(None).cast("array<double>")
        return numbers_before_comment(F.get(header, F.lit(at)))

    return files.withColumns(
        {
            "scales": line_numbers(fmt.scale_line),
            "flags": line_numbers(fmt.missing_line),
            "error": F.coalesce(*problems),
        }
    )
