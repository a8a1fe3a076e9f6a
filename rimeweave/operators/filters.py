"""Row filters and predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.masks import drop_flags
from ..functions.numeric import num, to_number

# fixed values: words that mark a bad row, and the level from which a numeric flag is bad
BAD_ROW_WORDS = "bad|invalid|fail|suspect|reject"
BAD_ROW_LEVEL = 2
# fixed values: parts of a column name that make it a quality column
QUALITY_COLUMN_TOKENS = ("flag", "qc", "status")


def keep_humidity(df: DataFrame, column: str, limit: float = 200.0) -> DataFrame:
    """Rows with humidity at or below the limit; a missing humidity drops the row."""
    return df.filter(F.col(column) <= num(limit))


def flag_is_bad(flag: Column, sentinels: Sequence[float] = ()) -> Column:
    """A flag value (as text) that marks its row bad; NULL and fill values are not bad."""
    numeric = F.coalesce(drop_flags(to_number(flag), sentinels) >= num(BAD_ROW_LEVEL), F.lit(False))
    worded = F.coalesce(F.lower(flag).rlike(BAD_ROW_WORDS), F.lit(False))
    return numeric | worded


def is_quality_column(name: str) -> bool:
    return any(token in name.lower() for token in QUALITY_COLUMN_TOKENS)


def drop_flagged_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows where any quality column is bad; the columns are found by name if not given."""
    chosen = [c for c in df.columns if is_quality_column(c)] if columns is None else columns
    keep = F.lit(True)
    for c in chosen:
        keep = keep & ~flag_is_bad(F.col(f"`{c}`").cast("string"))
    return df.filter(keep)


def is_valid_record(*needed: str) -> Column:
    """All of the named columns are present."""
    valid = F.lit(True)
    for c in needed or ("Timestamp", "Tair_C", "Si"):
        valid = valid & F.col(c).isNotNull()
    return valid
