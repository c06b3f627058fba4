"""Facts about a frame by rules whose thresholds are data: formation of a side, and which side has isolated members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalar import at_least, at_most
from tidegrid.operators.spatial import distance, labelled, placed

Names = Sequence[str]

# The thresholds of the rules in use. Places are shares of the map.
FORMATION = {"link_distance": 0.1, "grouped_coverage": 0.8, "grouped_diameter": 0.18, "split_size": 2, "split_coverage": 0.8, "split_distance": 0.22}
ISOLATION = {"ally_distance": 0.18, "enemy_closer": 0.04}


def _centre(group: Column) -> Column:
    mean = lambda f: F.aggregate(group, F.lit(0.0), lambda a, p: a + p[f]) / F.nullif(F.size(group), F.lit(0))
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def formation(sides: DataFrame, frame: Names, side: str, rules: dict[str, float] = FORMATION) -> DataFrame:
    """frame and formation of a side (spatial.teams): unknown for fewer than two members or any without a place; grouped if
    the largest linked group holds enough of them and is not too wide; split if the two largest, of enough members each,
    hold enough of them and their centres are far enough apart; else spread. Also coverage and diameter of the largest.

    Of groups of a size the one with the smallest id is first. Nothing leaves the row.
    """
    rows = with_formation(sides, side, rules)
    return rows.select(*frame, "formation", "coverage", "diameter")


def with_formation(sides: DataFrame, side: str, rules: dict[str, float] = FORMATION) -> DataFrame:
    """sides with formation, coverage and diameter as above, and split_coverage and split_distance of the two largest groups,
    null where there are no two of enough members.
    """
    rows = sides.withColumn("__p", labelled(side, rules["link_distance"]))
    groups = F.transform(F.array_distinct(F.transform("__p", lambda p: p["label"])), lambda x: F.struct(
        (-F.size(F.filter("__p", lambda p: p["label"] == x))).alias("n"), x.alias("label"), F.filter("__p", lambda p: p["label"] == x).alias("members")))
    rows = rows.withColumn("__g", F.array_sort(groups))
    one, two, all_ = F.get("__g", F.lit(0)), F.get("__g", F.lit(1)), F.size(side)
    rows = rows.withColumn("__a", one["members"]).withColumn("__b", two["members"])
    coverage = F.try_divide(F.size("__a"), all_)
    diameter = F.array_max(F.flatten(F.transform("__a", lambda a: F.transform("__a", lambda b: distance(a, b)))))
    grouped = at_least(coverage, F.lit(rules["grouped_coverage"])) & at_most(diameter, F.lit(rules["grouped_diameter"]))
    large = F.coalesce((F.size("__a") >= rules["split_size"]) & (F.size("__b") >= rules["split_size"]), F.lit(False))
    both, apart = F.try_divide(F.size("__a") + F.size("__b"), all_), distance(_centre(F.col("__a")), _centre(F.col("__b")))
    split = large & at_least(both, F.lit(rules["split_coverage"])) & at_least(apart, F.lit(rules["split_distance"]))
    known = (all_ >= 2) & (F.size("__p") == all_)
    kind = F.when(~known, "unknown").when(grouped, "grouped").when(F.coalesce(split, F.lit(False)), "split").otherwise("spread")
    told = known & large & ~grouped
    made = {"formation": kind, "coverage": F.when(known, coverage), "diameter": F.when(known, diameter), "split_coverage": F.when(told, both), "split_distance": F.when(told, apart)}
    return rows.withColumns(made).drop("__p", "__g", "__a", "__b")


def isolated_side(sides: DataFrame, frame: Names, rules: dict[str, float] = ISOLATION) -> DataFrame:
    """frame, isolated (T, CT, both, none, or unknown if any place is), t_isolated and ct_isolated (ids in order).

    sides: spatial.teams of the living. Where a side is empty nobody is isolated; a side's last member always is. Else a
    member is whose nearest ally is far and whose nearest enemy is closer by the margin.
    """
    whole = (F.size("t") == F.size(placed("t"))) & (F.size("ct") == F.size(placed("ct")))
    near = lambda p, s: F.array_min(F.transform(F.filter(s, lambda q: q["id"] != p["id"]), lambda q: distance(p, q)))

    def alone(own: str, other: str) -> Column:
        def lonely(p: Column) -> Column:
            ally, enemy = near(p, own), near(p, other)
            return at_least(ally, F.lit(rules["ally_distance"])) & at_least(ally - enemy, F.lit(rules["enemy_closer"]))

        ids = lambda members: F.transform(members, lambda p: p["id"])
        some = F.when(F.size(own) == 1, ids(F.col(own))).otherwise(ids(F.filter(own, lonely)))
        return F.when(whole, F.when((F.size(own) == 0) | (F.size(other) == 0), F.slice(ids(F.col(own)), 1, 0)).otherwise(some))

    rows = sides.withColumn("t_isolated", alone("t", "ct")).withColumn("ct_isolated", alone("ct", "t"))
    t, ct = F.size("t_isolated") > 0, F.size("ct_isolated") > 0
    kind = F.when(F.col("t_isolated").isNull(), "unknown").when(t & ct, "both").when(t, "T").when(ct, "CT").otherwise("none")
    return rows.select(*frame, kind.alias("isolated"), "t_isolated", "ct_isolated")
