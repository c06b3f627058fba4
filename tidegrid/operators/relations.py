"""Keyed joins, set operations and the checks that guard them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]


def duplicates(df: DataFrame, keys: Names) -> DataFrame:
    """keys and their number of rows, where that is over 1."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def unique_lookup(df: DataFrame, lookup: DataFrame, keys: Names, how: str = "inner") -> DataFrame:
    """An equi-join that fails while it runs if the lookup repeats a key."""
    w = Window.partitionBy(*keys)
    once = lookup.withColumn("__n", F.count(F.lit(1)).over(w))
    guard = F.when(F.col("__n") > 1, F.raise_error(F.lit("a lookup key repeats"))).otherwise(F.lit(True))
    return df.join(once.withColumn("__ok", guard.cast("boolean")).filter("__ok").drop("__n", "__ok"), list(keys), how)


def compared(a: DataFrame, b: DataFrame, keys: Names, columns: Names) -> DataFrame:
    """One row: both, only_a, only_b, differing (rows of both whose columns are not equal), repeated (keys on a side).

    Null keys equal each other.

    A companion table is whole and true to its base if all but both are 0.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        mark = F.struct(*columns).alias(name) if columns else F.lit(1).alias(name)
        return df.groupBy(*keys).agg(F.first(mark).alias(name), F.count(F.lit(1)).alias(f"{name}_n"))

    both = _full(side(a, "__a"), side(b, "__b"), keys)
    here, there = F.col("__a_n").isNotNull(), F.col("__b_n").isNotNull()
    return both.agg(
        F.count_if(here & there).alias("both"), F.count_if(~there).alias("only_a"), F.count_if(~here).alias("only_b"),
        F.count_if(here & there & ~F.col("__a").eqNullSafe(F.col("__b"))).alias("differing"),
        F.count_if((F.col("__a_n") > 1) | (F.col("__b_n") > 1)).alias("repeated"),
    )


def _full(a: DataFrame, b: DataFrame, keys: Names) -> DataFrame:
    """The full join on keys, null equal to null, with one column for each key."""
    other = b.withColumnsRenamed({k: f"__{k}" for k in keys}).withColumn("__there", F.lit(True))
    rows = a.join(other, [a[k].eqNullSafe(other[f"__{k}"]) for k in keys], "full")
    named = [F.when(F.col("__there"), F.col(f"__{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    rest = [c for c in (*a.columns, *b.columns) if c not in keys]
    return rows.select(*named, *rest)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows that one side has more often than the other, with side a or b."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def paired(a: DataFrame, b: DataFrame, keys: Names, group: Names, weight: str = "weight") -> DataFrame:
    """The rows of keys in both, with weights that add up to 1 in each group of what is left."""
    rows = a.join(b, list(keys))
    return rows.withColumn(weight, 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*group)))


def overlaid(base: DataFrame, overlay: DataFrame, keys: Names, columns: Names) -> DataFrame:
    """base with overlay's rows in place of those of the same key, and overlay's other rows added; overlaid tells which.

    Null keys equal each other.
    """
    over = overlay.select(*keys, F.struct(*columns).alias("__new"))
    out = _full(base.select(*keys, F.struct(*columns).alias("__old")), over, keys)
    pick = F.coalesce("__new", "__old")
    return out.select(*keys, *(pick[c].alias(c) for c in columns), F.col("__new").isNotNull().alias("overlaid"))


def conflicts(rows: DataFrame, place: Names, id_col: str) -> DataFrame:
    """Places that more than one id claims."""
    return rows.groupBy(*place).agg(F.count_distinct(id_col).alias("ids")).filter("ids > 1")


def strict_union(frames: Sequence[DataFrame], keys: Names) -> DataFrame:
    """The union with one row for each key; fails while it runs if rows of one key differ."""
    rows = frames[0]
    for other in frames[1:]:
        rows = rows.unionByName(other)
    rest = [c for c in rows.columns if c not in keys]
    whole = F.struct(*rest)
    one = rows.groupBy(*keys).agg(F.min(whole).alias("__a"), F.max(whole).alias("__b"), F.count_distinct(F.xxhash64(*rest)).alias("__n"))
    same = F.when((F.col("__n") > 1) | ~F.col("__a").eqNullSafe(F.col("__b")), F.raise_error(F.lit("rows of one key differ")))
    return one.withColumn("__e", F.coalesce(same.cast("boolean"), F.lit(True))).filter("__e").select(*keys, *(F.col("__a")[c].alias(c) for c in rest))


def only_value(column: Column) -> Column:
    """An aggregate: the one distinct non-null value, null without any; fails if there are more."""
    return F.when(F.min(column).eqNullSafe(F.max(column)), F.max(column)).otherwise(F.raise_error(F.lit("more than one value")))


def concat_keep(first: DataFrame, second: DataFrame, keys: Names, order: Names, last: bool = False) -> DataFrame:
    """The union, then the first (or last) row of each key; at a tie of the order first's rows are before second's."""
    both = first.withColumn("__side", F.lit(0)).unionByName(second.withColumn("__side", F.lit(1)))
    by = [F.col(c).desc() if last else F.col(c).asc() for c in (*order, "__side")]
    return both.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("__n = 1").drop("__n", "__side")


def merged_sets(df: DataFrame, keys: Names, column: str) -> DataFrame:
    """The sorted union of the keys' arrays."""
    return df.select(*keys, F.explode(column).alias("__x")).groupBy(*keys).agg(F.sort_array(F.collect_set("__x")).alias(column))


def repeated_rows(df: DataFrame, times: Column, group: Names, weight: str = "weight") -> DataFrame:
    """Each row `times` over (copy from 0), with weights 1 / rows of its group after that."""
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1)))
    return out.withColumn(weight, 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*group)))


def subset(inner: Column, outer: Column) -> Column:
    """Whether every member of one array is in the other; null if either is."""
    return F.size(F.array_except(inner, outer)) == 0


def in_several(df: DataFrame, split: str, members: Names) -> DataFrame:
    """members that more than one split holds, with the splits in order."""
    return df.groupBy(*members).agg(F.sort_array(F.collect_set(split)).alias("splits")).filter(F.size("splits") > 1)
