"""Weighted evaluation of predicted probabilities, and audits of datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.ranges import edges, running

Names = Sequence[str]
EDGE = 1e-6


def unit_weights(df: DataFrame, group: Names, name: str = "weight") -> DataFrame:
    """Weights that add up to 1 in each group."""
    return df.withColumn(name, 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*group)))


def cardinality(df: DataFrame, keys: Names, match: str, group: Names, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(*group).alias("rounds"), F.count_distinct(match).alias("matches"), F.sum(weight).alias("weight"),
    )


def metric_columns(p: str, y: str, w: str) -> list[Column]:
    """Weighted log loss, Brier score and accuracy at 0.5 (inclusive); rows without a prediction take no part."""
    q = F.greatest(F.least(F.col(p), F.lit(1 - EDGE)), F.lit(EDGE))
    loss = -F.when(F.col(y) == 1, F.ln(q)).otherwise(F.ln(1 - q))
    known = lambda c: F.sum(F.when(F.col(p).isNotNull(), F.col(w) * c)) / F.sum(F.when(F.col(p).isNotNull(), F.col(w)))
    gap = F.col(p) - F.col(y)
    hit = ((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("double")
    return [known(loss).alias("log_loss"), known(gap * gap).alias("brier"), known(hit).alias("accuracy")]


def metrics(df: DataFrame, keys: Names, p: str = "p", y: str = "y", w: str = "w") -> DataFrame:
    """Metrics with coverage: rows and weight with a prediction, as shares of all."""
    seen = F.col(p).isNotNull()
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), (F.count_if(seen) / F.count(F.lit(1))).alias("row_coverage"),
        (F.coalesce(F.sum(F.when(seen, F.col(w))), F.lit(0.0)) / F.sum(w)).alias("weight_coverage"), *metric_columns(p, y, w),
    )


def auc(df: DataFrame, keys: Names, p: str = "p", y: str = "y", w: str = "w") -> DataFrame:
    """Weighted area under the ROC curve, ties counted half; null where a class is missing.

    Rows are summed by score first; running sums go range by range, so that no task sees all scores of a key.
    """
    by_score = df.filter(F.col(p).isNotNull()).groupBy(*keys, p).agg(
        F.sum(F.when(F.col(y) == 1, F.col(w)).otherwise(0.0)).alias("__pos"), F.sum(F.when(F.col(y) == 0, F.col(w)).otherwise(0.0)).alias("__neg"))
    wins = running(by_score, keys, p, ["__neg"], edges(df, p)).withColumn("__win", F.col("__pos") * (F.col("before___neg") + F.col("__neg") / 2))
    return wins.groupBy(*keys).agg(F.try_divide(F.sum("__win"), F.sum("__pos") * F.sum("__neg")).alias("auc"))


def calibration(df: DataFrame, keys: Names, p: str = "p", y: str = "y", w: str = "w", bins: int = 10) -> DataFrame:
    """Bins of equal width with rows, weight, mean prediction and observed rate; empty bins are left out."""
    q = F.greatest(F.least(F.col(p), F.lit(1 - EDGE)), F.lit(EDGE))
    placed = df.filter(F.col(p).isNotNull()).withColumn("bin", F.least(F.floor(q * bins), F.lit(bins - 1)).cast("int")).withColumn("__q", q)
    return placed.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(w).alias("weight"), (F.sum(F.col(w) * F.col("__q")) / F.sum(w)).alias("mean"), (F.sum(F.col(w) * F.col(y)) / F.sum(w)).alias("observed"))


def calibration_error(binned: DataFrame, keys: Names) -> DataFrame:
    """The weighted mean distance of prediction and observed rate over bins."""
    return binned.groupBy(*keys).agg((F.sum(F.col("weight") * F.abs(F.col("mean") - F.col("observed"))) / F.sum("weight")).alias("ece"))


def by_slices(df: DataFrame, slices: dict[str, Column], name: str = "slice") -> DataFrame:
    """A row for each slice that holds; slices overlap, a null is no hit, and weights stay as they are."""
    hits = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in slices.items())))
    return df.withColumn(name, F.explode(hits))


def nearest_rank(column: str, share: float) -> Column:
    """The value at rank ceil(share n)."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY `{column}`)")


def distribution(df: DataFrame, keys: Names, column: str) -> DataFrame:
    """n, least, p50, p95 and most of a number, by nearest rank; nulls don't count.

    Values are counted first and ranked range by range, so that no task holds all values of a key.
    """
    counts = df.groupBy(*keys, column).agg(F.count(column).alias("n"))
    ranked = running(counts.filter(F.col(column).isNotNull()), keys, column, ["n"], edges(df, column))
    at = lambda share: F.min(F.when(F.col("before_n") + F.col("n") >= F.ceil(F.lit(share) * F.col("total_n")), F.col(column)))
    found = ranked.groupBy(*keys).agg(F.min(column).alias("least"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max(column).alias("most"))
    named = found.select(*(F.col(k).alias(f"__{k}") for k in keys), "least", "p50", "p95", "most")
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("n"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return sizes.join(named, same or F.lit(True), "left").select(*keys, "n", "least", "p50", "p95", "most")


def size_histogram(df: DataFrame, group: Names) -> DataFrame:
    """How many groups have each number of rows."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def uniqueness(df: DataFrame, split: str, column: str) -> DataFrame:
    """total, distinct and duplicates of a column by split, and over all (split null)."""
    return df.rollup(split).agg(F.count(column).alias("total"), F.count_distinct(column).alias("distinct")).withColumn("duplicates", F.col("total") - F.col("distinct"))


def co_occurrence(df: DataFrame, id_col: str, tags: str) -> DataFrame:
    """(a, b, rows): rows whose tags hold both, a before b, and each tag with itself."""
    own = F.sort_array(F.array_distinct(tags))
    pairs = F.flatten(F.transform(own, lambda a: F.transform(F.filter(own, lambda b: b >= a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return df.select(id_col, F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("rows"))


def transition_matrix(df: DataFrame, keys: Names, order: Names, state: str) -> DataFrame:
    before = F.lag(state).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__b", before).filter(F.col("__b").isNotNull()).groupBy(F.concat_ws("->", "__b", state).alias("transition")).agg(F.count(F.lit(1)).alias("rows"))


def validation(df: DataFrame, key: Names, group: Names, label: str, weight: str) -> DataFrame:
    """One row: rows, distinct keys, groups with several labels, groups whose weights are off 1 by over a millionth."""
    groups = df.groupBy(*group).agg(F.count_distinct(label).alias("l"), F.sum(weight).alias("w"))
    a = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(*key).alias("keys"))
    b = groups.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("l") > 1).alias("mixed_labels"), F.count_if(F.abs(F.col("w") - 1) > 1e-6).alias("off_weights"))
    return a.crossJoin(b)  # one row by one row


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, rows): how many rows break each rule; a null is a break. One pass over the data."""
    one = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()))
    pairs = F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("rows")) for k in rules))
    return one.select(F.explode(pairs).alias("r")).select("r.*")


def null_counts(df: DataFrame, columns: Names) -> DataFrame:
    return violations(df, {c: F.col(c).isNotNull() for c in columns}).withColumnRenamed("rule", "column")


def weighted_loss(df: DataFrame, sample: str, loss: str, weight: str, total: float) -> DataFrame:
    """Sum of weight times a sample's mean loss, over a fixed number."""
    means = df.groupBy(sample, weight).agg(F.avg(loss).alias("m"))
    return means.agg((F.sum(F.col(weight) * F.col("m")) / F.lit(total)).alias("loss"))


def cluster_bootstrap(df: DataFrame, match: str, p: str = "p", other: str | None = None, y: str = "y", w: str = "w", rounds: int = 1000, seed: int = 7) -> DataFrame:
    """(metric, value, low, high) of the weighted log loss and Brier score, or of their differences from `other`'s, with the
    2.5th and 97.5th percentile over resamples of the matches; metric is log_loss or brier.

    Only rows with a prediction (of both, if other is given) take part. Each match is summed in Spark. A resample draws n
    of the n matches with replacement: the k-th draw of round r is a hash of (seed, r, k), so the same whatever the
    partitions, and rounds are summed in Spark. n is the number of matches, so a table has n times rounds draws. Fewer
    than two matches fail.
    """
    clip = lambda c: F.greatest(F.least(F.col(c), F.lit(1 - EDGE)), F.lit(EDGE))
    log_loss = lambda c: -F.when(F.col(y) == 1, F.ln(clip(c))).otherwise(F.ln(1 - clip(c)))
    brier = lambda c: (F.col(c) - F.col(y)) * (F.col(c) - F.col(y))
    seen = F.col(p).isNotNull() & (F.col(other).isNotNull() if other else F.lit(True))
    value = lambda f: F.sum(F.col(w) * (f(p) - f(other) if other else f(p)))
    sums = df.filter(seen).groupBy(F.col(match).cast("string").alias("m")).agg(value(log_loss).alias("log_loss"), value(brier).alias("brier"), F.sum(w).alias("w"))
    numbered = sums.withColumn("place", F.row_number().over(Window.orderBy("m")) - 1)  # one row a match
    total = sums.count()
    if total < 2:
        raise ValueError(f"{total} matches cannot be resampled")
    draws = df.sparkSession.range(rounds * total).select((F.col("id") / total).cast("long").alias("r"), draw(F.col("id"), total, seed).alias("place"))
    times = draws.groupBy("r", "place").agg(F.count(F.lit(1)).alias("times"))
    mean = lambda c, n=F.lit(1): F.sum(F.col(c) * n) / F.sum(F.col("w") * n)
    each = times.join(numbered, "place").groupBy("r").agg(mean("log_loss", F.col("times")).alias("log_loss"), mean("brier", F.col("times")).alias("brier"))
    bounds = lambda c: F.struct(F.lit(c).alias("metric"), F.expr(f"percentile({c}, 0.025)").alias("low"), F.expr(f"percentile({c}, 0.975)").alias("high"))
    ranges = each.agg(F.array(bounds("log_loss"), bounds("brier")).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    whole = sums.agg(F.array(*(F.struct(F.lit(c).alias("metric"), mean(c).alias("value")) for c in ("log_loss", "brier"))).alias("x"))
    return whole.select(F.explode("x").alias("x")).select("x.*").join(ranges, "metric").select("metric", "value", "low", "high")


def draw(number: Column, below: int, seed: int) -> Column:
    """A number from 0 to below - 1 by the first 13 hex digits of a hash, which any SQL has."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), number.cast("string"))), 1, 13), 16, 10).cast("long") % F.lit(below)).cast("int")


def edge_calibration_error(df: DataFrame, keys: Names, p: str = "p", y: str = "y", w: str = "w", bins: int = 10) -> DataFrame:
    """The weighted mean distance of prediction and observed rate over bins whose edges are multiples of 1 / bins as floating
    point has them; an edge belongs to the bin above it, and predictions are not clipped. It differs from
    calibration_error only where a prediction lies on an edge.
    """
    place = sum((F.col(p) >= F.lit(k * (1.0 / bins))).cast("int") for k in range(1, bins))
    placed = df.filter(F.col(p).isNotNull()).withColumn("__bin", place)
    means = placed.groupBy(*keys, "__bin").agg(F.sum(w).alias("weight"), (F.sum(F.col(w) * F.col(p)) / F.sum(w)).alias("mean"), (F.sum(F.col(w) * F.col(y)) / F.sum(w)).alias("observed"))
    return calibration_error(means, keys)


def fold_report(df: DataFrame, fold: str, phase: str, p: str = "p", y: str = "y", w: str = "w") -> DataFrame:
    """(fold, phase, rows, positive_rate, metrics): one row for each fold, for each phase, and one over all; what a row is
    not about is null, and level (fold, phase or all) tells rows of a null fold or phase apart. One pass over the data.
    """
    level = F.when(F.grouping(fold) == 0, "fold").when(F.grouping(phase) == 0, "phase").otherwise("all")
    return df.groupingSets([[fold], [phase], []], fold, phase).agg(
        level.alias("level"), F.count(F.lit(1)).alias("rows"), (F.sum(F.col(w) * F.col(y)) / F.sum(w)).alias("positive_rate"), *metric_columns(p, y, w),
    )


def prior_without(df: DataFrame, match: str, y: str = "y", w: str = "w", name: str = "prior") -> DataFrame:
    """(match, prior): the weighted rate of positives over all other matches; null if there are none."""
    own = df.groupBy(match).agg(F.sum(F.col(w) * F.col(y)).alias("__y"), F.sum(w).alias("__w"))
    total = own.agg(F.sum("__y").alias("__ty"), F.sum("__w").alias("__tw"), F.count(F.lit(1)).alias("__n"))
    other = F.when(F.col("__n") > 1, F.try_divide(F.col("__ty") - F.col("__y"), F.col("__tw") - F.col("__w")))
    return own.crossJoin(F.broadcast(total)).select(match, other.alias(name))  # the total is one row


def value_counts(df: DataFrame, keys: Names, column: str) -> DataFrame:
    """(keys, value, rows), nulls counted like values."""
    return df.groupBy(*keys, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def merged_counts(parts: Sequence[DataFrame], keys: Names, counts: Names) -> DataFrame:
    """Counts of several parts (matches, shards) by keys, added up: what counting all rows at once gives."""
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counts))
