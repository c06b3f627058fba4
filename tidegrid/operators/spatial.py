"""Aggregates over the members of a frame: a small group of rows with team, place and state.

Each function groups by the frame's keys alone. Members of a frame meet in arrays inside one row, so pairs cost no join;
a frame has a handful of members (ten in a match), which is what bounds the arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalar import finite

Names = Sequence[str]


def distance(a: Column, b: Column) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy)


def teams(df: DataFrame, frame: Names, team: str = "team", member: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """frame, t and ct: arrays of (id, x, y) sorted by id; places that are no finite numbers are null."""
    place = F.struct(F.col(member).alias("id"), finite(F.col(x).cast("double")).alias("x"), finite(F.col(y).cast("double")).alias("y"))
    side = lambda name: F.sort_array(F.collect_list(F.when(F.col(team) == name, place))).alias(name.lower())
    return df.groupBy(*frame).agg(side("T"), side("CT"))


def placed(side: str) -> Column:
    return F.filter(side, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def dispersion(df: DataFrame, keys: Names, x: str = "x", y: str = "y") -> DataFrame:
    """Root of the mean squared distance to the centroid; one member gives 0."""
    return df.groupBy(*keys).agg(F.sqrt(F.var_pop(F.col(x).cast("double")) + F.var_pop(F.col(y).cast("double"))).alias("dispersion"))


def nearest_opponent(sides: DataFrame, frame: Names) -> DataFrame:
    """The smallest distance between the sides; null if either has no known place."""
    pairs = F.flatten(F.transform(placed("t"), lambda a: F.transform(placed("ct"), lambda b: distance(a, b))))
    return sides.select(*frame, F.array_min(pairs).alias("nearest_opponent"))


def neighbours(sides: DataFrame, frame: Names) -> DataFrame:
    """A row for each member: its nearest ally and nearest enemy distance (null without any)."""
    rows = None
    for own, other in (("t", "ct"), ("ct", "t")):
        near = lambda p, side: F.array_min(F.transform(F.filter(placed(side), lambda q: q["id"] != p["id"]), lambda q: distance(p, q)))  # noqa: B023, E731
        made = F.transform(own, lambda p: F.struct(p["id"].alias("id"), near(p, own).alias("ally"), near(p, other).alias("enemy")))  # noqa: B023
        side = sides.select(*frame, F.lit(own.upper()).alias("team"), F.explode(made).alias("m")).select(*frame, "team", "m.*")
        rows = side if rows is None else rows.unionByName(side)
    return rows


def around(sides: DataFrame, frame: Names, px: Column, py: Column, radius: float) -> DataFrame:
    """For each side: members, nearest and second-nearest distance to a point, members within the radius (inclusive), and
    the mean and largest distance to the nearest teammate; all but members null unless every place is known.
    """
    point = F.struct(px.cast("double").alias("x"), py.cast("double").alias("y"))
    out = [F.col(c) for c in frame]
    for s in ("t", "ct"):
        whole = F.size(s) == F.size(placed(s))
        dist = F.array_sort(F.transform(placed(s), lambda p: distance(p, point)))
        mates = F.transform(s, lambda p: F.array_min(F.transform(F.filter(s, lambda q: q["id"] != p["id"]), lambda q: distance(p, q))))  # noqa: B023
        some = whole & (F.size(s) >= 2)
        out += [
            F.size(s).alias(f"{s}_members"), F.when(whole, F.get(dist, F.lit(0))).alias(f"{s}_nearest"), F.when(whole, F.get(dist, F.lit(1))).alias(f"{s}_second"),
            F.when(whole, F.size(F.filter(dist, lambda d: d <= radius))).alias(f"{s}_within"),
            F.when(some, F.aggregate(mates, F.lit(0.0), lambda a, d: a + d) / F.size(s)).alias(f"{s}_support_mean"),
            F.when(some, F.array_max(mates)).alias(f"{s}_support_max"),
        ]
    return sides.select(*out)


def carrier_support(sides: DataFrame, frame: Names, carrier: str, radius: float) -> DataFrame:
    """How near the T side is to its member `carrier` (a column of sides): status, teammates, nearest, within."""
    own = F.get(F.filter("t", lambda p: p["id"] == F.col(carrier)), F.lit(0))
    mates = F.filter("t", lambda p: p["id"] != F.col(carrier))
    known = F.filter(mates, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    dist = F.transform(known, lambda p: distance(p, F.col("__own")))
    status = (
        F.when(F.col(carrier).isNull(), "not-applicable").when(F.col("__own").isNull(), "missing-carrier")
        .when(F.col("__own")["x"].isNull() | F.col("__own")["y"].isNull() | (F.size(known) != F.size(mates)), "missing-position")
        .when(F.size(mates) == 0, "no-teammates").otherwise("available")
    )
    rows = sides.withColumn("__own", own).withColumn("status", status)
    seen, fine = F.col("status").isin("missing-position", "available", "no-teammates"), F.col("status").isin("available", "no-teammates")
    return rows.select(*frame, "status", F.when(seen, F.size(mates)).alias("teammates"), F.when(fine, F.array_min(dist)).alias("nearest"), F.when(fine, F.size(F.filter(dist, lambda d: d <= radius))).alias("within"))


def labelled(side: str, reach: float) -> Column:
    """The members with known places as (id, x, y, label): the smallest id that can be reached in steps of `reach` or less.

    Labels spread from each member to those in reach as often as there are members; nothing leaves the row.
    """
    known = placed(side)
    start = F.transform(known, lambda p: F.struct(p["id"].alias("id"), p["x"].alias("x"), p["y"].alias("y"), p["id"].alias("label")))
    return F.aggregate(known, start, lambda acc, _: F.transform(acc, lambda p: F.struct(
        p["id"].alias("id"), p["x"].alias("x"), p["y"].alias("y"),
        F.array_min(F.transform(F.filter(acc, lambda q: distance(p, q) <= reach), lambda q: q["label"])).alias("label"))))


def linked_groups(sides: DataFrame, frame: Names, side: str, reach: float) -> DataFrame:
    """Groups of members linked at distance `reach` or less, chains included: (frame, groups, largest, diameter)."""
    known, spread = placed(side), labelled(side, reach)
    labels = F.transform(spread, lambda p: p["label"])
    rows = sides.withColumn("__l", labels)
    sizes = F.transform(F.array_distinct("__l"), lambda x: F.size(F.filter("__l", lambda y: y == x)))
    wide = F.array_max(F.flatten(F.transform(known, lambda a: F.transform(known, lambda b: distance(a, b)))))
    return rows.select(*frame, F.size(sizes).alias("groups"), F.coalesce(F.array_max(sizes), F.lit(0)).alias("largest"), wide.alias("diameter"))


def occupancy(df: DataFrame, frame: Names, region: str, team: str = "team") -> DataFrame:
    """Members of each side by region, and contested: both sides there; null if any region of the frame is unknown."""
    counts = df.groupBy(*frame, region).agg(F.count_if(F.col(team) == "T").alias("t"), F.count_if(F.col(team) == "CT").alias("ct"))
    unknown = df.groupBy(*frame).agg(F.count_if(F.col(region).isNull()).alias("__u"))
    rows = counts.join(unknown, list(frame)).filter(F.col(region).isNotNull())
    return rows.withColumn("contested", F.when(F.col("__u") == 0, (F.col("t") > 0) & (F.col("ct") > 0))).drop("__u")


def isolation(members: DataFrame, far: float, margin: float) -> DataFrame:
    """Rows of neighbours() with isolated: the ally is over `far` away (or there is none) and the enemy nearer by `margin`."""
    alone = F.col("ally").isNull()
    return members.withColumn("isolated", F.when(F.col("enemy").isNull(), None).otherwise(alone | ((F.col("ally") > far) & (F.col("enemy") + margin < F.col("ally")))))


def team_totals(df: DataFrame, frame: Names, health: str, money: str, alive: Column, team: str = "team") -> DataFrame:
    """T less CT of: members alive, health (negatives as 0), money (sum over known), and the share whose money is known."""
    live = df.filter(alive)
    aggs = []
    for s in ("T", "CT"):
        mine = F.col(team) == s
        aggs += [
            F.count_if(mine).alias(f"n{s}"), F.coalesce(F.sum(F.when(mine, F.greatest(F.col(health), F.lit(0)))), F.lit(0)).alias(f"h{s}"),
            F.coalesce(F.sum(F.when(mine, F.col(money))), F.lit(0)).alias(f"m{s}"),
            F.coalesce(F.try_divide(F.count_if(mine & F.col(money).isNotNull()), F.count_if(mine)), F.lit(0.0)).alias(f"k{s}"),
        ]
    g = live.groupBy(*frame).agg(*aggs)
    diff = lambda p, name: (F.col(f"{p}T") - F.col(f"{p}CT")).alias(name)
    return g.select(*frame, diff("n", "alive_diff"), diff("h", "health_diff"), diff("m", "money_diff"), F.col("kT").alias("t_coverage"), F.col("kCT").alias("ct_coverage"))
