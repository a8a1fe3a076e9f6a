"""Aggregates over the standard table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import num
from .filters import is_valid_record

# fixed values: the published distribution a campaign is checked against, and the tolerance
REFERENCE_DISTRIBUTION = {
    "min": -1.0000,
    "q1": -0.3599,
    "median": -0.1299,
    "q3": 0.0168,
    "max": 1.6811,
    "mean": -0.1615,
    "std": 0.3688,
}
DRIFT_CHECKED = ("q1", "median", "q3", "mean", "std")
DRIFT_TOLERANCE = 0.20


def campaign_summary(df: DataFrame) -> DataFrame:
    """Count, time span, mean and sample deviation per campaign."""
    return df.groupBy("Campaign").agg(
        F.count("Timestamp").alias("n_records"),
        F.min("Timestamp").alias("earliest"),
        F.max("Timestamp").alias("latest"),
        F.avg("Tair_C").alias("tair_mean"),
        F.stddev_samp("Tair_C").alias("tair_std"),
        F.avg("Si").alias("si_mean"),
        F.stddev_samp("Si").alias("si_std"),
    )


def campaign_statistics(df: DataFrame) -> DataFrame:
    """Row count, means and deviations per campaign, ordered by campaign."""
    return (
        df.groupBy("Campaign")
        .agg(
            F.count(F.lit(1)).alias("n_records"),
            F.avg("Tair_C").alias("temp_mean_C"),
            F.stddev_samp("Tair_C").alias("temp_std_C"),
            F.avg("Lat").alias("lat_mean"),
            F.avg("Lon").alias("lon_mean"),
            F.avg("Alt_m").alias("alt_mean_m"),
            F.avg("Si").alias("si_mean"),
            F.stddev_samp("Si").alias("si_std"),
        )
        .orderBy("Campaign")
    )


def valid_counts(df: DataFrame, by: Sequence[str] = ("Campaign",)) -> DataFrame:
    """Rows and rows with time, temperature and Si all present."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(is_valid_record()).alias("n_valid")
    )


def campaign_list(df: DataFrame) -> DataFrame:
    """Each campaign with its share of the total row count."""
    per = df.groupBy("Campaign").agg(F.count(F.lit(1)).alias("n_rows"))
    total = per.agg(F.sum("n_rows")).scalar()
    return per.withColumn("total_rows", total)


def _unpivot(one_row: DataFrame, keys: Sequence[str], names: Sequence[str], label: str, outs: Mapping[str, str]) -> DataFrame:
    """Columns ``<prefix><name>`` to rows ``(keys, label, outs...)`` without a shuffle."""
    entries = F.array(
        *[
            F.struct(F.lit(n).alias(label), *[F.col(f"{prefix}{n}").alias(out) for prefix, out in outs.items()])
            for n in names
        ]
    )
    return one_row.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*")


def missing_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and percentage of each column that has any; one pass over the data."""
    names = list(columns or df.columns)
    counted = df.agg(
        F.count(F.lit(1)).alias("_total"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n_{c}") for c in names]
    )
    rows = _unpivot(counted, ["_total"], names, "column_name", {"n_": "n_missing"})
    pct = F.round(F.col("n_missing") / F.col("_total") * num(100), 2)
    return rows.filter(F.col("n_missing") > 0).select("column_name", "n_missing", pct.alias("pct_missing"))


def mask_counters(df: DataFrame, rules: Mapping[str, tuple[Column, Column]], by: Sequence[str] = ()) -> DataFrame:
    """How many values each mask removed.  ``rules``: name -> (raw, masked)."""
    names = list(rules)
    counted = df.groupBy(*by).agg(
        *[F.count_if(raw.isNotNull() & masked.isNull()).alias(f"n_{n}") for n, (raw, masked) in rules.items()]
    )
    return _unpivot(counted, list(by), names, "rule", {"n_": "n_masked"})


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Mapping[str, float], by: Sequence[str] = (), accuracy: int = 10_000
) -> DataFrame:
    """Exact quantiles with linear interpolation, for groups of any size.

    The built-in exact percentile keeps every distinct value of a group in one
    task.  Here a mergeable sketch first brackets each wanted rank; a second
    pass folds what lies between the brackets into counts and keeps only the
    values inside, about ``4 / accuracy`` of the group per rank, folded by
    value.  The rank is then read off exactly.  A bracket that fails to enclose
    its rank raises.  For a group of at most ``10 * accuracy`` rows the bracket
    is the whole group.
    """
    by = list(by)
    # no filter on the value: it would be pushed below, and repeat, the expressions it comes from
    data = df.select(*by, F.col(value).alias("_v"))
    names = sorted(probabilities, key=probabilities.get)
    margin, k = 2.0 / accuracy, len(names)
    low = [max(0.0, probabilities[n] - margin) for n in names]
    high = [min(1.0, probabilities[n] + margin) for n in names]
    sketch = data.groupBy(*by).agg(
        F.count("_v").alias("_n"), F.percentile_approx("_v", low + high, accuracy).alias("_s"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"),
    )

    def edge(i: int, extreme: str, outermost: bool) -> Column:
        whole = F.lit(outermost) | (F.col("_n") <= 10 * accuracy)
        return F.when(whole, F.col(extreme)).otherwise(F.get("_s", F.lit(i)))

    plan = sketch.select(
        *by, "_n", F.array(*[edge(i, "_min", low[i] == 0.0) for i in range(k)]).alias("_lo"),
        F.array(*[edge(k + i, "_max", high[i] == 1.0) for i in range(k)]).alias("_hi"),
    )
    if by:
        rows = data.join(plan, by, "left")
    else:
        whole = plan.select(F.struct("_n", "_lo", "_hi")).scalar()
        rows = data.withColumn("_plan", whole).select("_v", "_plan.*")

    # brackets follow each other: a value in region r lies above r brackets, and
    # the values of a region that are in no bracket lie before those that are
    region, inside = F.lit(0), F.lit(False)
    for i in range(k):
        above = F.col("_v") > F.get("_hi", F.lit(i))
        region = region + above.cast("int")
        inside = inside | (~above & (F.col("_v") >= F.get("_lo", F.lit(i))))
    folded = rows.groupBy(*by, "_n", region.alias("_region"), F.when(inside, F.col("_v")).alias("_k")).agg(
        F.count("_v").alias("_c")
    )
    order = Window.partitionBy(*by).orderBy("_region", F.col("_k").asc_nulls_first())
    upto = F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = folded.withColumn("_upto", upto)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto")), F.col("_k")))

    ranks = {n: F.lit(probabilities[n]) * (F.col("_n") - 1) for n in names}
    picked = placed.groupBy(*by, "_n").agg(
        *[at(F.floor(r)).alias(f"_a_{n}") for n, r in ranks.items()], *[at(F.ceil(r)).alias(f"_z_{n}") for n, r in ranks.items()]
    )

    def answer(n: str) -> Column:
        a, z = F.col(f"_a_{n}"), F.col(f"_z_{n}")
        exact = a + (z - a) * (ranks[n] - F.floor(ranks[n]))
        missed = F.raise_error(F.lit("quantile bracket does not enclose its rank")).cast("double")
        nothing = F.lit(None).cast("double")
        return F.when(F.col("_n") == 0, nothing).when(a.isNotNull() & z.isNotNull(), exact).otherwise(missed).alias(n)

    return picked.select(*by, *[answer(n) for n in probabilities])


def distribution_stats(df: DataFrame, value: str = "Si", by: Sequence[str] = ("Campaign",)) -> DataFrame:
    """Min, quartiles, max, mean and population deviation; all NULL for a group without a value."""
    by = list(by)
    moments = df.groupBy(*by).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )
    quartiles = exact_quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
    columns = [*by, "min", "q1", "median", "q3", "max", "mean", "std"]
    if by:
        return moments.join(quartiles, by, "left").select(*columns)
    whole = quartiles.select(F.struct("q1", "median", "q3")).scalar()
    return moments.withColumn("_q", whole).select("min", "_q.q1", "_q.median", "_q.q3", "max", "mean", "std")


def distribution_drift(
    stats: DataFrame,
    reference: Mapping[str, float] = REFERENCE_DISTRIBUTION,
    tolerance: float = DRIFT_TOLERANCE,
    checked: Sequence[str] = DRIFT_CHECKED,
) -> DataFrame:
    """Absolute distance of each checked statistic from the reference, and the verdict."""
    deltas = {n: F.abs(F.col(n) - num(reference[n])) for n in checked}
    passed = F.lit(True)
    for d in deltas.values():
        passed = passed & (d <= num(tolerance))
    return stats.withColumns({**{f"d_{n}": d for n, d in deltas.items()}, "aligned": passed})
