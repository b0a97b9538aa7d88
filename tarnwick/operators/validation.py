"""Checks of a feature table: each is one aggregate with a condition, all of them taken in one pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions import numeric as N


@dataclass(frozen=True)
class Check:
    """Name, value over the whole table, and whether a value passes; a value that cannot be taken (null) is skipped."""

    test: str
    value: Column
    passes: Callable[[Column], Column]


def report(rows: DataFrame, checks: list[Check], digits: int = 4) -> DataFrame:
    """(test, status, value): PASS, FAIL or SKIP for each check, from one aggregate over ``rows``."""
    one = rows.agg(*[c.value.cast("double").alias(f"v{i}") for i, c in enumerate(checks)])
    status = lambda v, c: F.when(v.isNull(), "SKIP").when(c.passes(v), "PASS").otherwise("FAIL")
    lines = [F.struct(F.lit(c.test).alias("test"), status(F.col(f"v{i}"), c).alias("status"), F.round(F.col(f"v{i}"), digits).alias("value")) for i, c in enumerate(checks)]
    return one.select(F.inline(F.array(*lines)))


def structure_checks(groups: dict[str, int], densities: list[str], entropy: str, label: str) -> list[Check]:
    """Soundness, finiteness and variance of each group of features, signs of densities and entropies, labels given."""
    sound = {g: F.coalesce(N.sound(F.col(g), n), F.lit(False)) for g, n in groups.items()}
    total = lambda of: F.sum(sum((F.coalesce(F.size(F.filter(g, of)), F.lit(0)) for g in groups), F.lit(0)))
    none = lambda v: v == 0
    found = [Check(f"sound_{g}", F.count_if(~ok), none) for g, ok in sound.items()]
    found += [Check("no_nan", total(lambda v: F.isnan(v)), none), Check("no_infinity", total(lambda v: F.abs(v) == float("inf")), none), Check(f"{label}_given", F.count_if(F.col(label).isNull()), none)]
    for g, n in groups.items():
        count = F.count_if(sound[g]) * n
        mean = F.sum(F.when(sound[g], N.array_sum(F.col(g)))) / F.nullif(count, F.lit(0))
        square = F.sum(F.when(sound[g], N.array_sum(F.col(g), lambda v: v * v))) / F.nullif(count, F.lit(0))
        found.append(Check(f"varies_{g}", square - mean * mean, lambda v: v > 1e-8))
    low = lambda g: F.min(F.when(sound[g], F.array_min(g)))
    found += [Check(f"not_negative_{g}", low(g), lambda v: v >= -1e-6) for g in densities]
    return [*found, Check(f"positive_{entropy}", low(entropy), lambda v: v > 0)]


def anchored(groups: dict[str, int], name: str) -> Callable[[str, str, Column], Column]:
    """A function (part of a name, group, value): the mean value over the sound rows whose ``name`` holds the part."""

    def mean(part: str, group: str, value: Column) -> Column:
        return F.avg(F.when(F.contains(F.lower(name), F.lit(part)) & N.sound(F.col(group), groups[group]), value))

    return mean
