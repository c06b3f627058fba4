"""As-of joins: the state that holds at a probe's time, by one window over the union of both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    probes: DataFrame, states: DataFrame, keys: Sequence[str], on: str, values: Sequence[str], direction: str = "backward",
    strict: bool = False, tolerance: float | None = None, ties: Sequence[str] = (), span: int | None = None,
) -> DataFrame:
    """probes with `values` of the last state at or before each probe (forward: the first at or after it); null if none.

    Keys are equal on both sides and `on` orders both. strict leaves out states at the probe's own time; tolerance
    (inclusive) is the largest distance. Of states at one time the last by `ties` counts (forward: the first). A state's
    null value is a value. Where probes have a column of a value's name, the value found takes its place. One shuffle by keys; with `span`, a key's time is cut into stretches of that length which
    are worked on apart, each with the state that comes in from the stretches before it, so a hot key is no one task's.
    """
    sign = 1 if direction == "backward" else -1
    order = lambda c: F.col(c).asc() if sign > 0 else F.col(c).desc()
    state = F.struct(F.col(on).alias("at"), *(F.col(v).alias(f"v{k}") for k, v in enumerate(values))).alias("__state")
    own = states.select(*keys, on, *(F.col(t).alias(f"__tie{k}") for k, t in enumerate(ties)), state, F.lit(2 if strict else 0).alias("__side"))
    both = probes.withColumn("__side", F.lit(1)).unionByName(own, allowMissingColumns=True)
    parts = list(keys)
    if span:
        both = both.withColumn("__part", F.floor(F.col(on) / span))
        parts.append("__part")
    w = Window.partitionBy(*parts).orderBy(order(on), F.col("__side"), *(order(f"__tie{k}") for k in range(len(ties))))
    found = F.last("__state", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = both.withColumn("__found", found).filter(F.col("__side") == 1).drop("__side", "__state", *(f"__tie{k}" for k in range(len(ties))))
    if span:
        place = F.struct(on, *(f"__tie{k}" for k in range(len(ties))))
        pick = F.max_by if sign > 0 else F.min_by
        ends = own.withColumn("__part", F.floor(F.col(on) / span)).groupBy(*parts).agg(pick("__state", place).alias("__in"))
        wanted = rows.select(*parts).distinct()
        carried = asof_join(wanted, ends, keys, "__part", ["__in"], direction, strict=True)
        carried = carried.toDF(*(f"__in_{p}" for p in parts), "__in")
        match = [F.col(p).eqNullSafe(F.col(f"__in_{p}")) for p in parts]
        rows = rows.join(carried, match, "left").withColumn("__found", F.coalesce("__found", "__in")).drop("__part", "__in", *(f"__in_{p}" for p in parts))
    if tolerance is not None:
        rows = rows.withColumn("__found", F.when(F.abs(F.col(on) - F.col("__found.at")) <= tolerance, F.col("__found")))
    return rows.select(*(c for c in probes.columns if c not in values), *(F.col(f"__found.v{k}").alias(v) for k, v in enumerate(values)))


def asof_or_default(probes: DataFrame, states: DataFrame, keys, on, values, defaults: dict[str, Column], **how) -> DataFrame:
    """asof_join with a default state for probes that have none before them; a found state's nulls stay."""
    held = states.withColumn("__held", F.lit(True))
    rows = asof_join(probes, held, keys, on, [*values, "__held"], **how)
    return rows.withColumns({v: F.when(F.col("__held"), F.col(v)).otherwise(defaults[v]) for v in values}).drop("__held")


def asof_guarded(probes: DataFrame, states: DataFrame, keys, on, values, guard: Column, guard_values=(), **how) -> DataFrame:
    """asof_join whose values are nulled where the guard fails on the state found; no earlier state takes its place."""
    names = [*values, *(g for g in guard_values if g not in values)]
    rows = asof_join(probes, states, keys, on, names, **how)
    kept = rows.withColumns({f"__{v}": F.when(guard, F.col(v)) for v in values})
    return kept.select(*(c for c in probes.columns if c not in values), *(F.col(f"__{v}").alias(v) for v in values))


def asof_index(probes: DataFrame, states: DataFrame, keys, on, name: str = "index", clamp: bool = False) -> DataFrame:
    """The place (from 0) of the last state at or before the probe; before the first state -1, or 0 with clamp."""
    numbered = states.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(on)) - 1)
    return asof_join(probes, numbered, keys, on, [name]).withColumn(name, F.coalesce(name, F.lit(0 if clamp else -1)))


def interval_join(points: DataFrame, intervals: DataFrame, keys, on: str, start: str, end: str, width: int, closed: bool = False) -> DataFrame:
    """Pairs of a point and an interval [start, end) of the same keys that holds it (closed: [start, end]).

    Intervals are listed under each stretch of `width` that they touch, so the join is on equal keys and stretch;
    choose width near the usual interval length. An interval with a null end never ends: it is in no stretch, and joins
    on the keys alone, as it holds every later point anyway.
    """
    ended = intervals.filter(F.col(end) >= F.col(start))
    listed = ended.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    binned = points.withColumn("__bin", F.floor(F.col(on) / width))
    within = (F.col(on) >= F.col(start)) & ((F.col(on) <= F.col(end)) if closed else (F.col(on) < F.col(end)))
    found = binned.join(listed, [*keys, "__bin"]).filter(within).drop("__bin")
    return found.unionByName(points.join(intervals.filter(F.col(end).isNull()), list(keys)).filter(F.col(on) >= F.col(start)))


def overlaps(rows: DataFrame, intervals: DataFrame, keys, start: str, end: str, a: str, b: str) -> DataFrame:
    """rows [a, b] that meet any interval [start, end] of their keys; each row once.

    Of the intervals that begin up to b, the one that ends last ends at a or later: one as-of join on running maxima, so
    no row meets more than one interval. Rows and intervals with a null bound, or that end before they begin, meet none.
    """
    fine = intervals.filter(F.col(end) >= F.col(start)).select(*keys, F.col(start).alias("__b"), F.col(end).alias("__end"))
    latest = fine.groupBy(*keys, "__b").agg(F.max("__end").alias("__end"))
    so_far = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = latest.withColumn("__end", F.max("__end").over(so_far))
    probes = rows.filter(F.col(b) >= F.col(a)).withColumn("__b", F.col(b))
    return asof_join(probes, latest, keys, "__b", ["__end"]).filter(F.col("__end") >= F.col(a)).drop("__b", "__end")
