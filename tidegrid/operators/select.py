"""Deterministic sampling and selection. Every order ends in a hash or an id, so results don't depend on partitions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Names = Sequence[str]


def hash_order(domain: str, seed: str, *ids: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(domain), F.lit(seed), *(i.cast("string") for i in ids)), 256)


def hash_sample(df: DataFrame, keys: Names, id_col: str, k: int, domain: str = "sample", seed: str = "1") -> DataFrame:
    """k rows of the keys, first by hash; the same rows whatever else the table holds."""
    w = Window.partitionBy(*keys).orderBy(hash_order(domain, seed, F.col(id_col)), id_col)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")


def evenly_spaced(df: DataFrame, keys: Names, order: Names, m: int) -> DataFrame:
    """m rows at places round(i (n - 1) / (m - 1)) of n (halves go up); all rows if there are no more; m = 1: place n // 2."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    if m == 1:
        keep = F.col("__i") == F.floor(F.col("__n") / 2)
    else:
        places = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.floor(i * (F.col("__n") - 1) / (m - 1) + F.lit(0.5)))
        keep = (F.col("__n") <= m) | F.array_contains(places, F.col("__i").cast("long"))
    return rows.filter(keep).drop("__i", "__n")


def best_or_tie(df: DataFrame, keys: Names, score: str, name: str, slack: float = 5e-7) -> DataFrame:
    """keys and the name with the highest score; null where another is within the slack of it."""
    top = df.groupBy(*keys).agg(F.max(score).alias("__m"))
    near = df.join(top, list(keys)).filter(F.col(score) >= F.col("__m") - slack)
    return near.groupBy(*keys).agg(F.when(F.count(F.lit(1)) == 1, F.max(name)).alias(name))


def backups(df: DataFrame, chosen: DataFrame, keys: Names, id_col: str, k: int, seed: str = "1") -> DataFrame:
    """k more rows of the keys, none of them chosen, with their rank."""
    rest = df.join(chosen.select(id_col).distinct(), [id_col], "left_anti").dropDuplicates([*keys, id_col])
    w = Window.partitionBy(*keys).orderBy(hash_order("backup", seed, F.col(id_col)), id_col)
    return rest.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_to(df: DataFrame, keys: Names, on: str, middle: Column, taken: Column) -> DataFrame:
    """One row of the keys: not taken before taken, then closest to the middle, then the earliest."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce(taken, F.lit(False)), F.abs(F.col(on) - middle), on)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def capped(df: DataFrame, caps: Sequence[tuple[Names, int]], order: Sequence[Column]) -> DataFrame:
    """Rows that are among the first `cap` of each grouping in turn; later caps count what earlier ones left."""
    for group, cap in caps:
        df = df.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("__n") <= cap).drop("__n")
    return df


def shortfall(df: DataFrame, quotas: DataFrame, keys: Names, quota: str = "quota") -> DataFrame:
    """quotas with have and missing = max(0, quota - have)."""
    have = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("have"))
    out = quotas.join(have, list(keys), "left").withColumn("have", F.coalesce("have", F.lit(0)).cast("long"))
    return out.withColumn("missing", F.greatest(F.lit(0), F.col(quota) - F.col("have")))


def farthest_points(df: DataFrame, keys: Names, on: str, id_col: str, k: int) -> DataFrame:
    """Up to k rows of each group: the earliest, then again and again the one farthest in time from all chosen.

    Ties go to the earlier time, then to the smaller hash of the id. Groups are rounds: a task holds one group's times.
    Adds pick, the order of choice.
    """
    rows = df.withColumn("__h", F.sha2(F.col(id_col).cast("string"), 256))
    schema = T.StructType([*df.schema.fields, T.StructField("pick", T.IntegerType())])

    def choose(pdf):
        pdf = pdf.sort_values([on, "__h"], kind="stable").reset_index(drop=True)
        t = pdf[on].to_numpy().astype(float)
        picks, gap = [0], np.abs(t - t[0])
        gap[0] = -1
        while len(picks) < min(k, len(t)):
            best = int(np.argmax(gap))
            picks.append(best)
            gap = np.minimum(gap, np.abs(t - t[best]))
            gap[picks] = -1
        out = pdf.iloc[picks].drop(columns="__h")
        return out.assign(pick=np.arange(1, len(picks) + 1, dtype=np.int32))

    return rows.groupBy(*keys).applyInPandas(choose, schema)


def category_balanced(df: DataFrame, category: str, id_col: str, order: Names, each: int, cap: int) -> DataFrame:
    """At most `cap` rows: `each` of every category, evenly spaced in it, then others, all by order; each id once.

    category: an array column; a row of several categories counts in each. Added: balanced, whether a category chose it.
    """
    listed = df.select(id_col, *(c for c in order if c != id_col), F.explode(category).alias("__c"))
    chosen = evenly_spaced(listed, ["__c"], [*order, id_col], each).select(F.col(id_col).alias("__id")).distinct()
    rows = df.join(chosen, df[id_col] == chosen["__id"], "left").withColumn("balanced", F.col("__id").isNotNull()).drop("__id")
    return rows.orderBy(F.desc("balanced"), *order, id_col).limit(cap)


def plan_violations(plan: DataFrame, pool: DataFrame, id_col: str, unique: Sequence[Names], caps: Sequence[tuple[Names, int]], place: str, order: Sequence[Column]) -> DataFrame:
    """(rule, rows): how many rows of a selection break each rule; all 0 for a sound one.

    foreign: its id isn't in the pool; unique_KEYS: its keys repeat; cap_GROUP: it is beyond its group's cap; order: its
    place isn't that of the order.
    """
    known = pool.select(F.col(id_col).alias("__id")).distinct().withColumn("__known", F.lit(True))
    rows = plan.join(known, plan[id_col] == F.col("__id"), "left")
    marks = {"foreign": F.col("__known").isNull()}
    for names in unique:
        marks["unique_" + "_".join(names)] = F.count(F.lit(1)).over(Window.partitionBy(*names)) > 1
    for names, cap in caps:
        marks["cap_" + "_".join(names)] = F.row_number().over(Window.partitionBy(*names).orderBy(*order, id_col)) > cap
    rows = rows.withColumns({f"__{k}": c for k, c in marks.items()})
    ranked = rows.withColumn("__order", F.row_number().over(Window.orderBy(*order, id_col)) != F.col(place))  # a plan is small
    one = ranked.agg(*(F.count_if(F.col(f"__{k}")).alias(k) for k in [*marks, "order"]))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("rows")) for k in [*marks, "order"]))).alias("r")).select("r.*")
