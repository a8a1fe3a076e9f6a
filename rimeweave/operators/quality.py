"""Checks on the combined table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.masks import drop_flags, keep_range
from ..functions.numeric import num

# fixed values: fills that may remain in the combined table, and the geographic bounds
TABLE_FILLS = (-9999, -99999, -999999, -9999999, -99999999, -999999999)
GEO_RANGES = {"Lat": (-90.0, 90.0), "Lon": (-180.0, 180.0)}
FILL_COLUMNS = ("Lat", "Lon", "Alt_m", "Tair_C", "Si")


def replace_fills(df: DataFrame, columns: Sequence[str] = FILL_COLUMNS) -> DataFrame:
    """Fill values and impossible positions of the combined table become NULL."""
    fixed = {}
    for c in columns:
        if c not in df.columns:
            continue
        value = drop_flags(F.col(c), TABLE_FILLS)
        if c in GEO_RANGES:
            value = keep_range(value, *GEO_RANGES[c])
        fixed[c] = value
    return df.withColumns(fixed)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Each row that occurs more than once, with its number of occurrences."""
    return df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("n_copies")).filter("n_copies > 1")


def duplicate_surplus(df: DataFrame) -> DataFrame:
    """One row: how many rows would go if duplicates were removed."""
    return duplicate_rows(df).agg(F.coalesce(F.sum(F.col("n_copies") - 1), F.lit(0)).cast("bigint").alias("n_surplus"))


def _per_campaign_checks() -> dict[str, tuple[Column, Column]]:
    """Check name -> (measured value, passed) over the rows of one campaign."""
    count = lambda test: F.count_if(test).cast("double")

    def extreme(agg, column: str, test) -> tuple[Column, Column]:
        value = agg(column)
        return value, F.coalesce(test(value), F.lit(True))

    rows = F.count(F.lit(1)).cast("double")
    no_time = count(F.col("Timestamp").isNull())
    no_name = count(F.col("Campaign").isNull())
    return {
        "rows": (rows, rows > 0),
        "null_timestamp": (no_time, no_time == 0),
        "null_campaign": (no_name, no_name == 0),
        "tair_min": extreme(F.min, "Tair_C", lambda v: v > num(-150)),
        "tair_max": extreme(F.max, "Tair_C", lambda v: v < num(200)),
        "lat_min": extreme(F.min, "Lat", lambda v: v >= num(-90)),
        "lat_max": extreme(F.max, "Lat", lambda v: v <= num(90)),
        "lon_min": extreme(F.min, "Lon", lambda v: v >= num(-180)),
        "lon_max": extreme(F.max, "Lon", lambda v: v <= num(180)),
        "alt_min": extreme(F.min, "Alt_m", lambda v: v >= num(-1000)),
    }


def quality_report(df: DataFrame, expected: Sequence[str] = ()) -> DataFrame:
    """Rows ``(check, campaign, value, passed)``.

    All per-campaign checks come from one aggregation.  ``present`` is one row
    per expected campaign, ``duplicates`` one row for the whole table.
    """
    checks = _per_campaign_checks()
    measured = df.groupBy("Campaign").agg(
        *[F.struct(v.alias("value"), p.alias("passed")).alias(n) for n, (v, p) in checks.items()]
    )
    entries = F.array(
        *[F.struct(F.lit(n).alias("check"), F.col(f"{n}.value").alias("value"), F.col(f"{n}.passed").alias("passed")) for n in checks]
    )
    rows = measured.select(F.col("Campaign").alias("campaign"), F.explode(entries).alias("_e")).select(
        "_e.check", "campaign", "_e.value", "_e.passed"
    )
    surplus = F.col("n_surplus").cast("double")
    duplicates = duplicate_surplus(df).select(
        F.lit("duplicates").alias("check"), F.lit(None).cast("string").alias("campaign"),
        surplus.alias("value"), (surplus == 0).alias("passed"),
    )
    report = rows.unionByName(duplicates)
    if expected:
        names = F.array(*[F.lit(n) for n in expected])
        seen = df.groupBy("Campaign").agg(F.count(F.lit(1)).alias("n")).filter(F.col("Campaign").isin(*expected))
        listed = seen.agg(F.collect_list(F.struct("Campaign", "n")).alias("seen"))  # at most len(expected) entries
        counted = listed.select(
            F.explode(F.transform(names, lambda c: F.struct(
                c.alias("campaign"),
                F.coalesce(F.get(F.filter("seen", lambda s: s["Campaign"] == c), F.lit(0))["n"], F.lit(0)).cast("double").alias("value"),
            ))).alias("_e")
        )
        present = counted.select(
            F.lit("present").alias("check"), "_e.campaign", "_e.value", (F.col("_e.value") > 0).alias("passed")
        )
        report = report.unionByName(present)
    return report
