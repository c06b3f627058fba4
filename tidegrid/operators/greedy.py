"""Greedy selections whose result is that of going through all rows in order, without one task that does."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.sources.shared import stored

Names = Sequence[str]


def first_of_keys(rows: DataFrame, keys: Names, order: Names, most_rounds: int = 10_000) -> DataFrame:
    """rows that share no key's value with an earlier row that stays: what a fold in the order of `order` keeps.

    keys: columns, each of which is unique in the result; a null value shares nothing. `order` must tell all rows apart,
    else it fails. Rows that are first in all their keys' groups stay, and whoever shares a value with them goes; then
    again for what is left. A round settles every chain's next link at least; where few rows conflict, two or three
    rounds do. Groups are reduced before they are shuffled, and what a round leaves is written, so a hot value is no one
    task's and a lost executor costs a round at most.
    """
    place = F.struct(*order)
    values = F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("v")) for k, c in enumerate(keys)))
    listed = rows.select(place.alias("place"), F.filter(values, lambda x: x["v"].isNotNull()).alias("values"))
    once = listed.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.first("values").alias("values"))
    left = stored(once.select("place", F.when(F.col("n") > 1, F.raise_error(F.lit("the order does not tell all rows apart"))).otherwise(F.col("values")).alias("values")))
    kept = None
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        each = left.select("place", F.size("values").alias("n"), F.explode_outer("values").alias("x"))
        first = stored(each.filter("x IS NOT NULL").groupBy("x").agg(F.min("place").alias("first")))
        wins = each.join(first, "x", "left").groupBy("place").agg(F.count_if(F.col("place") == F.col("first")).alias("wins"), F.first("n").alias("n"))
        now = stored(wins.filter(F.col("wins") == F.col("n")).select("place"))
        taken = stored(left.join(now, "place").select(F.explode("values").alias("x")))
        gone = each.join(taken, "x", "left_semi").select("place").distinct()
        kept = now if kept is None else kept.union(now)
        left = stored(left.join(now, "place", "left_anti").join(gone, "place", "left_anti"))
    else:
        raise ValueError(f"not settled after {most_rounds} rounds")
    if kept is None:
        return rows.filter("false")
    mine = kept.select(*(F.col(f"place.{c}").alias(f"__{c}") for c in order))
    return rows.join(mine, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in order], "left_semi")


#: How a candidate's tags count, given how often each tag is among the chosen: larger is better.
DEFICIT, UNCOVERED, RAREST = "deficit", "uncovered", "rarest"


def covering(
    rows: DataFrame, keys: Names, tags: str, order: Names, count: int, targets: dict[str, int], by: str = DEFICIT, taken: str | None = None,
    spread: str | None = None, existing: dict[str, int] | None = None,
) -> DataFrame:
    """Up to `count` rows of each group, one after the other the best by what it adds; adds pick (from 1) and score.

    tags: an array column; those in `targets` count, each once. by: deficit, the sum of what is missing to the targets;
    uncovered, how many tags no chosen row has; rarest, uncovered tags, then a million over one more than each tag's
    count (whole), then the number of tags, then rows of a `spread` value not chosen yet. Ties go by `order`, which must
    tell a group's rows apart. taken: a boolean column; such rows come first, by order. existing: counts of tags to begin
    with. Rows without any tag that counts are candidates too.

    Of rows with the same tags (and spread) only the first `count` can be chosen, so only those meet: a limit that Spark
    applies before it shuffles. A task then has a group's few candidates, whatever the size of the group.
    """
    wanted = F.array_sort(F.array_intersect(F.array_distinct(F.coalesce(F.col(tags), F.array().cast("array<string>"))), F.array(*map(F.lit, targets)))) if targets else F.array().cast("array<string>")
    base = rows.select(*keys, wanted.alias("__tags"), F.coalesce(F.col(taken), F.lit(False)).alias("__taken") if taken else F.lit(False).alias("__taken"), (F.col(spread).cast("string") if spread else F.lit("")).alias("__spread"), F.struct(*order).alias("__place"))
    alike = Window.partitionBy(*keys, "__tags", "__taken", "__spread").orderBy("__place")
    few = base.withColumn("__n", F.row_number().over(alike)).filter(F.col("__n") <= count).drop("__n")
    few = few.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy("__place")))
    few = few.withColumn("__id", F.to_json(F.struct(*(F.col(k) for k in keys), "__rank")))
    begin = dict(existing or {})

    def score(t: list[str], where: str | None, counts: dict[str, int], seen: set) -> tuple:
        if by == DEFICIT:
            return (sum(max(0, targets[x] - counts.get(x, 0)) for x in t),)
        fresh = sum(counts.get(x, 0) == 0 for x in t)
        return (fresh,) if by == UNCOVERED else (fresh, sum(1_000_000 // (1 + counts.get(x, 0)) for x in t), len(t), where not in seen)

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        left = list(frame.sort_values("__rank")[["__id", "__tags", "__taken", "__spread"]].itertuples(index=False, name=None))
        counts, seen, out = dict(begin), set(), []
        first = [r for r in left if r[2]]
        while left and len(out) < count:
            best = first.pop(0) if first else max(left, key=lambda r: score(r[1], r[3], counts, seen))  # the first of the best
            left.remove(best)
            out.append((best[0], len(out) + 1, float(score(best[1], best[3], counts, seen)[0])))
            seen.add(best[3])
            for x in best[1]:
                counts[x] = counts.get(x, 0) + 1
        return pd.DataFrame(out, columns=["__id", "pick", "score"])

    plain = few.select(*keys, "__id", F.col("__tags"), "__taken", "__spread", "__rank")
    if keys:
        picks = plain.groupBy(*keys).applyInPandas(lambda f: choose(_lists(f)), "__id string, pick int, score double")
    else:
        picks = plain.groupBy(F.lit(0)).applyInPandas(lambda f: choose(_lists(f)), "__id string, pick int, score double")
    chosen = few.join(picks, "__id").select(*(F.col(k).alias(f"__k{k}") for k in keys), *(F.col(f"__place.{c}").alias(f"__o{c}") for c in order), "pick", "score")
    same = [F.col(k).eqNullSafe(F.col(f"__k{k}")) for k in keys] + [F.col(c).eqNullSafe(F.col(f"__o{c}")) for c in order]
    return rows.join(chosen, same).select(*rows.columns, "pick", "score")


def _lists(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.assign(__tags=[tuple(t) for t in frame["__tags"]])


def missing_tags(chosen: DataFrame, groups: DataFrame, keys: Names, tags: str, targets: dict[str, int]) -> DataFrame:
    """(keys, tag, target, have, missing) for each group and target: what a selection falls short of."""
    wanted = groups.select(*keys).distinct().withColumn("t", F.explode(F.array(*(F.struct(F.lit(t).alias("tag"), F.lit(n).alias("target")) for t, n in targets.items())))).select(*keys, "t.*")
    have = chosen.select(*keys, F.explode(F.array_distinct(tags)).alias("tag")).groupBy(*keys, "tag").agg(F.count(F.lit(1)).alias("have"))
    out = wanted.join(have, [*keys, "tag"], "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return out.withColumn("missing", F.greatest(F.lit(0), F.col("target") - F.col("have")))


def assigned(events: Column, allowed: Names) -> Column:
    """Distinct events, one for each of a few rows, sorted; null if there is no such choice.

    events: an array with an array of events for each row, in the rows' order. Of several choices it is the first by the
    order of `allowed`, row by row. Choices for the rows so far are kept side by side: few, for three rows.
    """
    usable = lambda own: F.filter(F.array(*map(F.lit, allowed)), lambda e: F.array_contains(own, e))
    none = F.array(F.array().cast("array<string>"))
    grown = F.aggregate(events, none, lambda ways, own: F.flatten(F.transform(ways, lambda way: F.transform(
        F.filter(usable(own), lambda e: ~F.array_contains(way, e)), lambda e: F.concat(way, F.array(e))))))
    return F.array_sort(F.get(grown, 0))


def anchors(rows: DataFrame, keys: Names, category: str, on: str, priority: Names, cap: int, fill: str | None = "fill") -> DataFrame:
    """(keys, on, tags): the times that a group's categories choose in their order of priority, `cap` at most.

    A category chooses its first time that is not chosen yet, or else its first; a time that is chosen already gets the
    tag besides. With `fill`, times are added until there are cap, each the one farthest from all chosen (ties: the
    earlier; the first, where nothing is chosen), under that tag. rows: a row for each time and category, other categories
    (and null ones) for times that can but fill. Times are whole numbers. Of a group, a task holds each time once; Spark's
    own functions on arrays choose, so groups cost what their times do, however many there are.
    """
    kind = rows.schema[on].dataType
    own = F.when(F.col(category).isin(*priority), F.col(category)) if priority else F.lit(None).cast("string")
    times = rows.filter(F.col(on).isNotNull()).groupBy(*keys, on).agg(F.collect_set(own).alias("__c"))
    each = times.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(on).cast("long").alias("t"), F.col("__c").alias("c")))).alias("__times"))

    def taken(chosen: Column, t: Column) -> Column:
        return F.exists(chosen, lambda x: x["t"] == t)

    def add(chosen: Column, t: Column, tag: Column) -> Column:
        return F.concat(chosen, F.array(F.struct(t.alias("t"), F.array(tag).alias("tags"))))

    def named(chosen: Column, name: Column) -> Column:
        own = F.transform(F.filter("__times", lambda x: F.array_contains(x["c"], name)), lambda x: x["t"])
        first, free = F.get(own, 0), F.get(F.filter(own, lambda t: ~taken(chosen, t)), 0)
        again = F.transform(chosen, lambda x: F.struct(x["t"].alias("t"), F.when(x["t"] == first, F.array_append(x["tags"], name)).otherwise(x["tags"]).alias("tags")))
        return F.when(first.isNull(), chosen).when(free.isNull(), again).when(F.size(chosen) < cap, add(chosen, free, name)).otherwise(chosen)

    def filled(chosen: Column, _: Column) -> Column:
        far = lambda t: F.struct(F.array_min(F.transform(chosen, lambda x: F.abs(t - x["t"]))).alias("far"), (-t).alias("t"))
        best = F.array_max(F.transform(F.filter("__times", lambda x: ~taken(chosen, x["t"])), lambda x: far(x["t"])))
        return F.when((F.size(chosen) < cap) & best.isNotNull(), add(chosen, -best["t"], F.lit(fill))).otherwise(chosen)

    picks = F.array().cast("array<struct<t:bigint,tags:array<string>>>")
    if priority:
        picks = F.aggregate(F.array(*map(F.lit, priority)), picks, named)
    if fill:
        picks = F.aggregate(F.array_repeat(F.lit(0), cap), picks, filled)
    out = each.select(*keys, F.explode(picks).alias("__p"))
    return out.select(*keys, F.col("__p.t").cast(kind).alias(on), F.array_sort("__p.tags").alias("tags"))
