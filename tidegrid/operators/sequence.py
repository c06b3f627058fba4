"""Sequence operators over rows ordered in time within keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]


def _w(keys: Names, order: Names) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def so_far(keys: Names, order: Names) -> Window:
    return _w(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def change_only(df: DataFrame, keys: Names, order: Names, signature: Names) -> DataFrame:
    """Rows whose signature is not that of the row before; the first row of the keys always stays, nulls equal nulls."""
    w, mark = _w(keys, order), F.struct(*signature)
    return df.withColumn("__b", F.lag(mark).over(w)).withColumn("__n", F.row_number().over(w)).filter((F.col("__n") == 1) | ~mark.eqNullSafe(F.col("__b"))).drop("__b", "__n")


def transitions(df: DataFrame, keys: Names, order: Names, state: str, was: dict[str, str] | None = None) -> DataFrame:
    """Adds changes (so far, the first row counts), previous (state before the current run) and sticky flags.

    A null state is a state: it begins a run, and is the previous one of the next.

    was: flag name -> state; the flag is true from the first row with that state on.
    """
    past = so_far(keys, order)
    before = F.lag(state).over(_w(keys, order))
    fresh = (~F.col(state).eqNullSafe(before)) | (F.row_number().over(_w(keys, order)) == 1)
    marked = df.withColumn("__b", before).withColumn("__c", fresh)
    out = marked.withColumn("changes", F.sum(F.col("__c").cast("long")).over(past)).withColumn("__p", F.last(F.when(F.col("__c"), F.struct("__b")), True).over(past)).withColumn("previous", F.col("__p.__b"))
    for name, value in (was or {}).items():
        out = out.withColumn(name, F.max(F.coalesce(F.col(state) == value, F.lit(False))).over(past))
    return out.drop("__b", "__c", "__p")


def since_change(df: DataFrame, keys: Names, on: str, state: str, name: str = "since", ties: Names = ()) -> DataFrame:
    """Time since the state last changed, never negative; the first row counts as a change."""
    order = [on, *ties]
    fresh = (~F.col(state).eqNullSafe(F.lag(state).over(_w(keys, order)))) | (F.row_number().over(_w(keys, order)) == 1)
    return df.withColumn("__at", F.when(fresh, F.col(on))).withColumn(name, F.greatest(F.lit(0), F.col(on) - F.last("__at", True).over(so_far(keys, order)))).drop("__at")


def sessions(df: DataFrame, keys: Names, on: str, gap: float, ties: Names = (), name: str = "session") -> DataFrame:
    """Numbers chains of rows, from 1, in which each is at most `gap` after the one before."""
    order = [on, *ties]
    fresh = F.coalesce((F.col(on) - F.lag(on).over(_w(keys, order)) > gap).cast("long"), F.lit(1))
    return df.withColumn("__f", fresh).withColumn(name, F.sum("__f").over(so_far(keys, order))).drop("__f")


def min_gap(df: DataFrame, keys: Names, on: str, gap: int, ties: Names = ()) -> DataFrame:
    """Greedy sampling: the first row of the keys, then each row at least `gap` after the last one kept.

    A row at least `gap` after the row before it is kept whatever came earlier, so such rows cut a key into islands that
    are folded apart; rows stream through the fold, and only the last kept time of an island is in memory.
    """
    cut = sessions(df.filter(F.col(on).isNotNull()), keys, on, gap - 1, ties, "__island")  # a distance of gap cuts
    part = F.xxhash64(*keys, "__island")
    dealt = cut.withColumn("__p", part).repartition("__p").sortWithinPartitions("__p", *keys, "__island", on, *ties)
    names = [*keys, "__island"]

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, last = None, None
        for batch in batches:
            ids = list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))
            keep = []
            for key, t in zip(ids, batch.column(on).to_pylist(), strict=True):
                if key != at or t - last >= gap:
                    at, last = key, t
                    keep.append(True)
                else:
                    keep.append(False)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return dealt.mapInArrow(fold, dealt.schema).drop("__island", "__p")


def first_per_bucket(df: DataFrame, keys: Names, on: str, width: int, ties: Names = ()) -> DataFrame:
    """The first row of each stretch of `width`."""
    w = _w([*keys, "__b"], [on, *ties])
    return df.withColumn("__b", F.floor(F.col(on) / width)).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__b", "__n")


def padded_windows(df: DataFrame, keys: Names, on: str, length: int, pad: int) -> DataFrame:
    """A row for each window that holds the row: window k is [k length - pad, (k + 1) length + pad], closed.

    Adds window and core (whether the row's own window it is). There are max(1, ceil(last / length)) windows for each
    key, and rows beyond the last one belong to it, so that core rows add up to the input.
    """
    ends = df.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.max(on) / length)).alias("__n"))
    own = F.least(F.floor(F.col(on) / length), F.col("__n") - 1)
    reach = F.sequence(F.greatest(F.ceil((F.col(on) - length - pad) / length), F.lit(0)), F.least(F.floor((F.col(on) + pad) / length), F.col("__n") - 1))
    return df.join(ends, list(keys)).withColumn("__own", own).withColumn("window", F.explode(reach)).withColumn("core", F.col("window") == F.col("__own")).drop("__n", "__own")


def window_slice(df: DataFrame, keys: Names, on: str, start: Column, end: Column, ties: Names = (), one_past: bool = True) -> DataFrame:
    """Rows with start < on <= end, the last row at or before start, and (one_past) the first row after end."""
    order = [on, *ties]
    after = F.lead(on).over(_w(keys, order))
    before = F.lag(on).over(_w(keys, order))
    carry = (F.col(on) <= start) & (F.col("__a").isNull() | (F.col("__a") > start))
    past = (F.col(on) > end) & (F.col("__b").isNull() | (F.col("__b") <= end))
    keep = ((F.col(on) > start) & (F.col(on) <= end)) | carry
    return df.withColumn("__a", after).withColumn("__b", before).filter(keep | past if one_past else keep).drop("__a", "__b")


def velocity(df: DataFrame, keys: Names, on: str, axes: Names, limit_squared: float, rate: float = 1.0) -> DataFrame:
    """Adds v_AXIS: change of each axis for a unit of time; zero on a key's first row and beyond the limit."""
    w = _w(keys, [on])
    dt = (F.col(on) - F.lag(on).over(w)) / rate
    raw = df.withColumns({f"v_{a}": F.try_divide(F.col(a).cast("double") - F.lag(F.col(a).cast("double")).over(w), dt) for a in axes})
    square = sum((F.col(f"v_{a}") * F.col(f"v_{a}") for a in axes[1:]), F.col(f"v_{axes[0]}") * F.col(f"v_{axes[0]}"))
    return raw.withColumn("__s", square).withColumns({f"v_{a}": F.when(F.col("__s") <= limit_squared, F.col(f"v_{a}")).otherwise(F.lit(0.0)) for a in axes}).drop("__s")


def dedupe_consecutive(df: DataFrame, keys: Names, on: str, point: Names, ties: Names = ()) -> DataFrame:
    """Drops rows at the time of the row before, and rows whose point is the one before."""
    w, here = _w(keys, [on, *ties]), F.struct(*point)
    old = F.lag(F.struct(F.col(on).alias("at"), here.alias("point"))).over(w)
    return df.withColumn("__o", old).filter(F.col("__o").isNull() | ((F.col("__o.at") != F.col(on)) & ~F.col("__o.point").eqNullSafe(here))).drop("__o")


def presence_tracks(df: DataFrame, keys: Names, on: str, grid: int, kind: str | None = None) -> DataFrame:
    """Stretches of grid times at which an entity was seen: keys, kind, start, end (the first grid time it is absent).

    A row counts at its grid time floor(on / grid); a change of kind opens another track.
    """
    cell = df.select(*keys, *([kind] if kind else []), F.floor(F.col(on) / grid).alias("__g")).distinct()
    ways = [*keys, *([kind] if kind else [])]
    island = F.col("__g") - F.row_number().over(_w(ways, ["__g"]))
    return cell.withColumn("__i", island).groupBy(*ways, "__i").agg((F.min("__g") * grid).alias("start"), ((F.max("__g") + 1) * grid).alias("end")).drop("__i")


def held_for(df: DataFrame, keys: Names, on: str, condition: Column, least: float, ties: Names = ()) -> DataFrame:
    """Rows at which the condition has held without a break for at least `least`; null counts as a break."""
    order = [on, *ties]
    yes = F.coalesce(condition, F.lit(False))
    marked = df.withColumn("__y", yes).withColumn("__i", F.sum((~yes).cast("long")).over(so_far(keys, order)))
    begin = F.min(F.when(F.col("__y"), F.col(on))).over(Window.partitionBy(*keys, "__i"))
    return marked.withColumn("__s", begin).filter(F.col("__y") & (F.col(on) - F.col("__s") >= least)).drop("__y", "__i", "__s")


def rising_edges(df: DataFrame, keys: Names, order: Names, flag: str) -> DataFrame:
    """Adds edge: start where the flag turns true, stop where it turns false; it takes an observed opposite before."""
    before = F.lag(flag).over(_w(keys, order))
    return df.withColumn("edge", F.when(F.col(flag) & ~before, "start").when(~F.col(flag) & before, "stop"))


def earliest_at_least_old(df: DataFrame, keys: Names, on: str, value: str, age: int, span: int, name: str = "earlier") -> DataFrame:
    """The first value within the last `span`, if it is at least `age` old; else null."""
    w = _w(keys, [on]).rangeBetween(-span, 0)
    oldest = F.min(F.struct(F.col(on).alias("at"), F.col(value).alias("v"))).over(w)
    return df.withColumn("__o", oldest).withColumn(name, F.when(F.col(on) - F.col("__o.at") >= age, F.col("__o.v"))).drop("__o")


def lookback_count(df: DataFrame, keys: Names, on: str, span: int, name: str = "seen") -> DataFrame:
    """The number of rows of the keys within [on - span, on]."""
    return df.withColumn(name, F.count(F.lit(1)).over(_w(keys, [on]).rangeBetween(-span, 0)))


def run_starts(df: DataFrame, keys: Names, order: Names, value: str, on: str, name: str = "run_start") -> DataFrame:
    """The time at which the current run of one value began."""
    fresh = (~F.col(value).eqNullSafe(F.lag(value).over(_w(keys, order)))) | (F.row_number().over(_w(keys, order)) == 1)
    return df.withColumn("__s", F.when(fresh, F.col(on))).withColumn(name, F.last("__s", True).over(so_far(keys, order))).drop("__s")


def largest_gap(df: DataFrame, keys: Names, on: str, stride: float) -> DataFrame:
    """keys, gap (the largest distance of neighbours; null for one row) and broken (whether it is over the stride)."""
    gaps = df.withColumn("__g", F.col(on) - F.lag(on).over(_w(keys, [on])))
    return gaps.groupBy(*keys).agg(F.max("__g").alias("gap")).withColumn("broken", F.coalesce(F.col("gap") > stride, F.lit(False)))


def interpolate(df: DataFrame, keys: Names, on: str, at: Column, axes: Names, angle: str | None = None, guards: Names = (), longest: float | None = None) -> DataFrame:
    """Rows that are the last at or before `at`, with axes moved linearly towards the next row's.

    The angle (degrees) turns the short way round. Where a guard column changes, the next row is missing, or it is
    further than `longest`, the row's own values stay. `at` may use the key columns.
    """
    nxt = F.lead(F.struct(*dict.fromkeys([on, *axes, *([angle] if angle else []), *guards]))).over(_w(keys, [on]))
    rows = df.withColumn("__n", nxt).withColumn("__at", at).filter((F.col(on) <= F.col("__at")) & (F.col("__n").isNull() | (F.col(f"__n.{on}") > F.col("__at"))))
    fine = F.col("__n").isNotNull()
    for g in guards:
        fine = fine & F.col(g).eqNullSafe(F.col(f"__n.{g}"))
    if longest is not None:
        fine = fine & (F.col(f"__n.{on}") - F.col(on) <= longest)
    share = (F.col("__at") - F.col(on)) / (F.col(f"__n.{on}") - F.col(on))
    out = rows.withColumn("__f", F.when(fine, share).otherwise(F.lit(0.0)))
    new = {a: F.col(a) + F.coalesce(F.col("__f") * (F.col(f"__n.{a}") - F.col(a)), F.lit(0.0)) for a in axes}
    if angle:
        turn = F.pmod(F.col(f"__n.{angle}") - F.col(angle) + 540, F.lit(360)) - 180
        new[angle] = F.pmod(F.col(angle) + F.coalesce(F.col("__f") * turn, F.lit(0.0)), F.lit(360))
    return out.withColumns(new).drop("__n", "__at", "__f")


def step_segments(df: DataFrame, keys: Names, on: str, phase: str, hold: float, end: Column) -> DataFrame:
    """Adds until = the least of end, on + hold and the next row's time, and joined (the next row follows at once in the same phase)."""
    w = _w(keys, [on])
    nxt = F.lead(on).over(w)
    out = df.withColumn("until", F.least(end, F.col(on) + hold, nxt))
    return out.withColumn("joined", F.coalesce((F.col("until") == nxt) & (F.lead(phase).over(w) == F.col(phase)), F.lit(False)))


def trail(df: DataFrame, keys: Names, on: str, value: str, rows: int, name: str = "trail") -> DataFrame:
    """The values of the last `rows` rows, oldest first."""
    w = _w(keys, [on]).rowsBetween(-(rows - 1), 0)
    return df.withColumn(name, F.collect_list(value).over(w))


def first_where(df: DataFrame, keys: Names, on: str, conditions: dict[str, Column]) -> DataFrame:
    """For each condition the first time it is true; conditions may compare a row with F.lag over the same window."""
    marked = df.withColumns({f"__{n}": c for n, c in conditions.items()})
    return marked.groupBy(*keys).agg(*(F.min(F.when(F.col(f"__{n}"), F.col(on))).alias(n) for n in conditions))


def keep_one(df: DataFrame, keys: Names, order: Names, last: bool = False) -> DataFrame:
    """The first (or last) row of the keys by the order, which should be total."""
    by = [F.col(c).desc() if last else F.col(c).asc() for c in order]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("__n = 1").drop("__n")
