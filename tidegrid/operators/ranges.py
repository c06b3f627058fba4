"""Running sums over a whole table in order, without one task that sees all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the order that are summed apart.
RANGES = 64


def edges(df: DataFrame, on: str, ranges: int = RANGES) -> list[float]:
    """Values that cut df into ranges of about equal size, few numbers whatever the input; fewer where values repeat."""
    found = df.select(F.col(on).cast("double").alias("v")).filter(F.col("v").isNotNull()).approxQuantile("v", [k / ranges for k in range(1, ranges)], 0.25 / ranges)
    return sorted(set(found))


def range_of(on: Column, cuts: Sequence[float]) -> Column:
    """How many cuts are at or below a value, by halving; equal values are in one range."""

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(on >= F.lit(float(cuts[mid])), within(mid + 1, high)).otherwise(within(low, mid))

    return within(0, len(cuts))


def running(df: DataFrame, keys: Sequence[str], on: str, sums: Sequence[str], cuts: Sequence[float] | None = None) -> DataFrame:
    """df with before_<sum> and total_<sum> for each column in sums: the sum over the keys' rows with a smaller `on`, and over all.

    Rows are one for each key and value of `on`, a number, no nulls. Each range of values is summed in its own task, and
    then the ranges' totals, so that a table without keys, or a hot key, is no one task's.
    """
    cuts = edges(df, on) if cuts is None else cuts
    rows = df.withColumn("__range", range_of(F.col(on).cast("double"), cuts))
    totals = rows.groupBy(*keys, "__range").agg(*(F.sum(c).alias(c) for c in sums))
    order = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    none = {c: F.lit(0).cast(df.schema[c].dataType) for c in sums}
    offsets = totals.select(
        *(F.col(k).alias(f"__{k}") for k in keys), F.col("__range").alias("__r"),
        *(F.coalesce(F.sum(c).over(order), none[c]).alias(f"__o_{c}") for c in sums), *(F.sum(c).over(whole).alias(f"total_{c}") for c in sums),
    )
    within = Window.partitionBy(*keys, "__range").orderBy(on).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"__l_{c}": F.coalesce(F.sum(c).over(within), none[c]) for c in sums})
    same = [F.col("__range") == F.col("__r"), *(F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)]
    out = local.join(offsets, same)
    return out.select(*df.columns, *((F.col(f"__l_{c}") + F.col(f"__o_{c}")).alias(f"before_{c}") for c in sums), *(f"total_{c}" for c in sums))
