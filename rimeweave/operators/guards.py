"""Unit guards: repair a unit when the median of a group gives it away.

A guard only asks on which side of a threshold the median lies.  That needs
no sort and no list of values: four mergeable numbers per group decide it
exactly (count, count at or below, largest at or below, smallest above).  The
aggregate is combined before the shuffle, so a group with a third of all rows
is no burden, and the result has one row per group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numeric
from ..functions.numeric import num


@dataclass(frozen=True)
class Threshold:
    """One side test on a group's median."""

    at: float
    inclusive: bool = False   # inclusive: median >= at, else median > at


@dataclass(frozen=True)
class Guard:
    """Convert ``column`` of a group where its median passes ``above`` and not ``beyond``.

    ``repair`` names the conversion for passing groups, ``otherwise`` the one
    for the rest (None leaves them).
    """

    column: str
    repair: str | None
    above: Threshold
    beyond: Threshold | None = None
    otherwise: str | None = None


# fixed values: conversion names and what they do
CONVERSIONS = {
    "kelvin_to_celsius": numeric.kelvin_to_celsius,
    "celsius_to_kelvin": numeric.celsius_to_kelvin,
    "pascal_to_hectopascal": numeric.pascal_to_hectopascal,
    "feet_to_metres": numeric.feet_to_metres,
}


def kelvin_guard(column: str) -> Guard:
    return Guard(column, "kelvin_to_celsius", Threshold(150))


def pascal_guard(column: str) -> Guard:
    return Guard(column, "pascal_to_hectopascal", Threshold(2000), Threshold(120000, inclusive=True))


def feet_guard(column: str) -> Guard:
    return Guard(column, "feet_to_metres", Threshold(12000, inclusive=True), Threshold(70000))


def celsius_to_kelvin_guard(column: str) -> Guard:
    return Guard(column, None, Threshold(200), otherwise="celsius_to_kelvin")


def _split(value: Column, t: Threshold) -> tuple[Column, Column]:
    below = value < num(t.at) if t.inclusive else value <= num(t.at)
    return below, ~below


def _side_aggregates(value: Column, t: Threshold, name: str) -> list[Column]:
    below, above = _split(value, t)
    return [
        F.count_if(below).alias(f"{name}_n"),
        F.max(F.when(below, value)).alias(f"{name}_lo"),
        F.min(F.when(above, value)).alias(f"{name}_hi"),
    ]


def _passes(t: Threshold, count: Column, below: Column, lo: Column, hi: Column) -> Column:
    """Whether the median lies above the threshold; NULL-free, false for an empty group."""
    twice, middle = below * F.lit(2), (lo + hi) / num(2)
    at_middle = middle >= num(t.at) if t.inclusive else middle > num(t.at)
    return F.coalesce((twice < count) | ((twice == count) & (count > 0) & at_middle), F.lit(False))


def _passes_aggregated(t: Threshold, count: Column, name: str) -> Column:
    return _passes(t, count, F.col(f"{name}_n"), F.col(f"{name}_lo"), F.col(f"{name}_hi"))


def _passes_array(t: Threshold, values: Column) -> Column:
    below = F.filter(values, lambda v: _split(v, t)[0])
    above = F.filter(values, lambda v: _split(v, t)[1])
    return _passes(t, F.size(values), F.size(below), F.array_max(below), F.array_min(above))


def array_verdict(guard: Guard, values: Column) -> Column:
    """The verdict of a guard on a group that is at hand as an array without NULLs."""
    verdict = _passes_array(guard.above, values)
    return verdict & ~_passes_array(guard.beyond, values) if guard.beyond is not None else verdict


def guard_verdicts(df: DataFrame, guards: Sequence[Guard], group: Sequence[str]) -> DataFrame:
    """One row per group with a boolean ``_fix_<i>`` per guard."""
    aggregates: list[Column] = []
    verdicts: list[Column] = []
    for i, g in enumerate(guards):
        value = F.col(g.column)
        count = F.col(f"_g{i}_count")
        aggregates.append(F.count(value).alias(f"_g{i}_count"))
        aggregates += _side_aggregates(value, g.above, f"_g{i}_a")
        verdict = _passes_aggregated(g.above, count, f"_g{i}_a")
        if g.beyond is not None:
            aggregates += _side_aggregates(value, g.beyond, f"_g{i}_b")
            verdict = verdict & ~_passes_aggregated(g.beyond, count, f"_g{i}_b")
        verdicts.append(verdict.alias(f"_fix_{i}"))
    keyed = df.groupBy(*group) if group else df.groupBy()
    return keyed.agg(*aggregates).select(*group, *verdicts)


def apply_guards(
    df: DataFrame,
    guards: Sequence[Guard],
    group: Sequence[str],
    forced: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Convert guarded columns group by group.  An empty ``group`` means the whole frame.

    ``forced`` maps a guarded column to a row predicate that converts it
    whatever the median says.
    """
    verdicts = guard_verdicts(df, guards, group)
    names = [f"_fix_{i}" for i in range(len(guards))]
    if not group:
        whole = verdicts.select(F.struct(*names)).scalar()
        return convert(df, guards, [whole.getField(n) for n in names], forced)
    keys = [f"_k{i}" for i in range(len(group))]
    verdicts = verdicts.select(*[F.col(g).alias(k) for g, k in zip(group, keys)], *names)
    condition = F.lit(True)
    for g, k in zip(group, keys):
        condition = condition & F.col(g).eqNullSafe(F.col(k))
    joined = df.join(verdicts, condition, "left")
    return convert(joined, guards, [F.col(n) for n in names], forced).select(*df.columns)


def convert(
    df: DataFrame, guards: Sequence[Guard], verdicts: Sequence[Column], forced: Mapping[str, Column] | None = None
) -> DataFrame:
    """Apply the conversions of guards whose verdicts are known."""
    forced = forced or {}
    converted: dict[str, Column] = {}
    for g, verdict in zip(guards, verdicts):
        value, fix = F.col(g.column), F.coalesce(verdict, F.lit(False))
        if g.column in forced:
            fix = fix | F.coalesce(forced[g.column], F.lit(False))
        yes = CONVERSIONS[g.repair](value) if g.repair else value
        no = CONVERSIONS[g.otherwise](value) if g.otherwise else value
        converted[g.column] = F.when(fix, yes).otherwise(no)
    return df.withColumns(converted)
