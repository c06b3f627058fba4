"""Whole reports as tables: models over slices and matches, what an export covers, and predictions before and after events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import evaluate

Names = Sequence[str]

# What a review says of an event, in the order in which it is asked, and the triggers it knows.
ROUND_UNAVAILABLE, ROUND_ENDED, BEFORE_MISSING, AFTER_UNCONFIRMED, QUALITY_UNKNOWN, DATA_INCOMPLETE, READY = (
    "round-unavailable", "round-ended", "before-missing", "after-unconfirmed", "quality-unknown", "data-incomplete", "ready",
)
REGULAR, EVENT_AFTER = "regular", "event-after"
OUTCOMES = ("bomb-defused", "bomb-exploded")


def by_model(rows: DataFrame, models: Names, name: str = "model", p: str = "p") -> DataFrame:
    """A row for each row and model, with its prediction under one name; the models' own columns go."""
    rest = [c for c in rows.columns if c not in models]
    pairs = F.array(*(F.struct(F.lit(m).alias(name), F.col(m).cast("double").alias(p)) for m in models))
    return rows.select(*rest, F.explode(pairs).alias("__m")).select(*rest, "__m.*")


def evaluation(rows: DataFrame, models: Names, slices: dict[str, Column], match: str, y: str = "y", w: str = "w") -> DataFrame:
    """(model, part, slice, match, rows, row_coverage, weight_coverage, log_loss, brier, accuracy, auc, ece): each model over all
    rows, over each slice and over each match; what a row is not about is null.

    Slices overlap; weights stay as they are in a slice, and where a prediction is missing its row lowers the coverage. One
    pass makes all metrics of rows; areas and calibration come of scores and bins, range by range.
    """
    own = ["model", "part", "slice", "match"]
    long = by_model(rows, models).withColumn("match", F.col(match).cast("string"))
    whole = F.struct(F.lit("all").alias("part"), F.lit(None).cast("string").alias("slice"), F.lit(False).alias("by"))
    each = F.struct(F.lit("match").alias("part"), F.lit(None).cast("string").alias("slice"), F.lit(True).alias("by"))
    cut = [F.when(c, F.struct(F.lit("slice").alias("part"), F.lit(k).alias("slice"), F.lit(False).alias("by"))) for k, c in slices.items()]
    parts = long.withColumn("__p", F.explode(F.array_compact(F.array(whole, each, *cut))))
    parts = parts.select("model", "__p.part", "__p.slice", F.when(F.col("__p.by"), F.col("match")).alias("match"), "p", F.col(y).alias("y"), F.col(w).alias("w"))
    out = evaluate.metrics(parts, own)
    for more in (evaluate.auc(parts, own), evaluate.calibration_error(evaluate.calibration(parts, own), own)):
        named = more.withColumnsRenamed({c: f"__{c}" for c in own})
        out = out.join(named, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in own], "left").drop(*(f"__{c}" for c in own))
    return out


def uncertainty(rows: DataFrame, models: Names, reference: str, match: str, y: str = "y", w: str = "w", rounds: int = 1000, seed: int = 42) -> DataFrame:
    """(model, against, metric, value, low, high): match bootstraps of each model, and of its difference from the reference."""
    if reference not in models:
        raise ValueError(f"{reference} is not among the models")
    out = None
    for m in models:
        for other in (None, reference) if m != reference else (None,):
            one = evaluate.cluster_bootstrap(rows, match, m, other, y, w, rounds, seed).select(F.lit(m).alias("model"), F.lit(other).cast("string").alias("against"), "*")
            out = one if out is None else out.unionByName(one)
    return out


def coverage(kept: DataFrame, rejected: DataFrame, match: str, reason: str = "reason") -> DataFrame:
    """(match, retained, rejected, candidates, fraction, reasons): what an export holds of each match, and of all (match null).

    reasons: a map from each reason to its rows. Matches that only one side knows are there too.
    """
    both = kept.select(F.col(match).cast("string").alias("match"), F.lit(None).cast("string").alias("r"), F.lit(True).alias("k")).unionByName(
        rejected.select(F.col(match).cast("string").alias("match"), F.coalesce(F.col(reason), F.lit("unknown")).alias("r"), F.lit(False).alias("k")))
    counted = both.groupingSets([["match", "r", "k"], ["r", "k"]], "match", "r", "k").agg(F.grouping("match").alias("over"), F.count(F.lit(1)).alias("n"))
    table = counted.groupBy("over", "match").agg(
        F.coalesce(F.sum(F.when(F.col("k"), F.col("n"))), F.lit(0)).alias("retained"), F.coalesce(F.sum(F.when(~F.col("k"), F.col("n"))), F.lit(0)).alias("rejected"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(~F.col("k"), F.struct("r", "n"))))).alias("reasons"),
    )
    total = F.col("retained") + F.col("rejected")
    return table.select("match", "retained", "rejected", total.alias("candidates"), F.try_divide(F.col("retained"), total).alias("fraction"), "reasons")


def visible(points: DataFrame, triggers: str = "triggers") -> DataFrame:
    """Points that a timeline shows: those without triggers, regular ones, and those after an event."""
    return points.filter(F.col(triggers).isNull() | F.arrays_overlap(triggers, F.array(F.lit(REGULAR), F.lit(EVENT_AFTER))))


def review(groups: DataFrame, points: DataFrame, attempts: DataFrame, match: Names) -> DataFrame:
    """groups with status, before, after (predictions) and change, in points of a hundred, where both are sound.

    groups: match, round_id, before_tick (null: none), after_tick, events (an array of types). points: match, round_id,
    segment, tick (once a round), p, triggers, and missing (whether equipment or places are; null: unknown). attempts:
    match, round_id, segment, live_tick, end_tick, disposition. A point counts for a completed attempt of its segment, from
    live to before the end; the one after must have been confirmed by the event. Rounds meet by two joins on their keys.
    """
    key = [*match, "round_id"]
    rounds = attempts.select(*key, F.col("segment").alias("__s"), "live_tick", "end_tick", "disposition")
    fine = (F.col("disposition") == "completed") & (F.col("segment") == F.col("__s")) & (F.col("tick") >= F.col("live_tick")) & (F.col("tick") < F.col("end_tick"))
    known = points.join(rounds, key).filter(fine).select(*key, "tick", "p", "triggers", "missing")
    rows = groups.join(rounds.drop("__s"), key, "left")
    for side in ("before", "after"):
        named = known.select(*(F.col(c).alias(f"__{c}") for c in key), F.struct("tick", "p", "triggers", "missing").alias(f"__{side}"))
        rows = rows.join(named, [*(F.col(c) == F.col(f"__{c}") for c in key), F.col(f"{side}_tick") == F.col(f"__{side}.tick")], "left").drop(*(f"__{c}" for c in key))
    rows = rows.withColumn("__after", F.when(F.array_contains("__after.triggers", EVENT_AFTER), F.col("__after")))
    a, b = F.col("__before"), F.col("__after")
    status = (
        F.when(~F.coalesce(F.col("disposition") == "completed", F.lit(False)), ROUND_UNAVAILABLE)
        .when((F.col("after_tick") >= F.col("end_tick")) | F.arrays_overlap("events", F.array(*map(F.lit, OUTCOMES))), ROUND_ENDED)
        .when(a.isNull(), BEFORE_MISSING).when(b.isNull(), AFTER_UNCONFIRMED).when(a["missing"].isNull() | b["missing"].isNull(), QUALITY_UNKNOWN)
        .when(a["missing"] | b["missing"], DATA_INCOMPLETE).otherwise(READY)
    )
    rows = rows.withColumn("status", status)
    change = F.when(F.col("status") == READY, (b["p"] - a["p"]) * 100)
    return rows.select(*groups.columns, "status", a["p"].alias("before"), b["p"].alias("after"), change.alias("change"))
