"""Projection to the standard table and union of campaigns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# fixed values: the standard columns in output order
STANDARD_SCHEMA = T.StructType(
    [
        T.StructField("Timestamp", T.TimestampType()),
        T.StructField("Tair_C", T.DoubleType()),
        T.StructField("Si", T.DoubleType()),
        T.StructField("Lat", T.DoubleType()),
        T.StructField("Lon", T.DoubleType()),
        T.StructField("Alt_m", T.DoubleType()),
        T.StructField("Campaign", T.StringType()),
        T.StructField("source_file", T.StringType()),
    ]
)
EXTRA_COLUMNS = ("Tair_K", "Pressure_hPa")
STANDARD_COLUMNS = tuple(STANDARD_SCHEMA.names)


def standard_projection(
    df: DataFrame,
    campaign: str | Column,
    mapping: Mapping[str, Sequence[str] | Column | None],
    extras: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Project to the standard columns.

    ``mapping`` gives, per standard column, an expression or candidate column
    names of which the first existing one is used; what cannot be resolved is
    NULL.  The campaign name is always the given one.
    """

    def resolve(field: T.StructField) -> Column:
        source = mapping.get(field.name)
        if field.name == "Campaign":
            value = campaign if isinstance(campaign, Column) else F.lit(campaign)
        elif isinstance(source, Column):
            value = source
        else:
            name = next((c for c in source or () if c in df.columns), None)
            value = F.col(f"`{name}`") if name else F.lit(None)
        kind = field.dataType
        return (value if isinstance(kind, T.TimestampType) and name_is_time(value, df) else value.cast(kind)).alias(field.name)

    columns = [resolve(f) for f in STANDARD_SCHEMA]
    return df.select(*columns, *[c.alias(n) for n, c in (extras or {}).items()])


def name_is_time(value: Column, df: DataFrame) -> bool:
    """Keep TIMESTAMP_NTZ input as it is instead of shifting it into a time zone."""
    return isinstance(df.select(value).schema[0].dataType, T.TimestampNTZType)


def generic_projection(df: DataFrame, campaign: str | Column) -> DataFrame:
    """Projection for a campaign without rules of its own; positions are NULL."""
    return standard_projection(
        df,
        campaign,
        {"Timestamp": ["Timestamp"], "Tair_C": ["Air_Temp", "T_C"], "Si": ["Si"], "source_file": ["source_file"]},
    )


def joined_sources(columns: Sequence[str], separator: str) -> Column:
    """Source names of several instruments in one text; a missing one reads ``nan``."""
    return F.concat_ws(separator, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")) for c in columns])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; columns a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
