"""The whole snapshot of a frame for a model, regular frames and those that an event adds between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalar import null_if_either
from tidegrid.operators import asof, relations, samples, sequence, spatial

Names = Sequence[str]

# The states of the bomb that a snapshot remembers.
REMEMBERED = {"bomb_was_dropped": "dropped", "bomb_was_planting": "planting", "bomb_was_planted": "planted", "bomb_was_defusing": "defusing"}
_CHANGES = ["previous_bomb", "bomb_changes", "since_bomb_change", *REMEMBERED]


def _spread(side: str) -> Column:
    """Root of the mean squared distance of a side's places to their centre; null without places."""
    known = spatial.placed(side)
    mean = lambda f: F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, p: a + f(p)), F.size(known))
    both = lambda c: mean(lambda p: p[c] * p[c]) - mean(lambda p: p[c]) * mean(lambda p: p[c])
    return F.sqrt(F.greatest(both("x") + both("y"), F.when(F.size(known) > 0, F.lit(0.0))))


def bomb_changes(frames: DataFrame, key: Names, tick_rate: float, on: str = "tick") -> DataFrame:
    """key, on and what a frame knows of the bomb's states so far: the one before the current run, how many there were,
    the seconds since the run began, and which of REMEMBERED came up.
    """
    out = sequence.transitions(frames.select(*key, on, "bomb"), key, [on], "bomb", REMEMBERED)
    out = sequence.since_change(out, key, on, "bomb", "__since")
    return out.select(*key, on, F.col("previous").alias("previous_bomb"), F.col("changes").alias("bomb_changes"), (F.col("__since") / tick_rate).alias("since_bomb_change"), *REMEMBERED)


def bomb_changes_at(frames: DataFrame, extras: DataFrame, key: Names, tick_rate: float, on: str = "tick") -> DataFrame:
    """The same for each extra row, as if it alone stood behind the frames strictly before it."""
    known = bomb_changes(frames, key, tick_rate, on).join(frames.select(*key, on, "bomb"), [*key, on])
    state = known.withColumn("began", F.col(on) - F.col("since_bomb_change") * tick_rate).withColumnRenamed("bomb", "last_bomb")
    rows = asof.asof_join(extras.select(*key, on, "bomb"), state.withColumn("there", F.lit(True)), key, on, ["last_bomb", "previous_bomb", "bomb_changes", "began", "there", *REMEMBERED], strict=True)
    there, fresh = F.coalesce("there", F.lit(False)), ~F.col("bomb").eqNullSafe(F.col("last_bomb")) | F.col("there").isNull()
    was = {n: F.coalesce(n, F.lit(False)) | F.coalesce(F.col("bomb") == v, F.lit(False)) for n, v in REMEMBERED.items()}
    return rows.withColumns({
        "previous_bomb": F.when(fresh & there, F.col("last_bomb")).otherwise(F.col("previous_bomb")), "bomb_changes": F.coalesce("bomb_changes", F.lit(0)) + fresh.cast("long"),
        "since_bomb_change": F.when(fresh, F.lit(0.0)).otherwise((F.col(on) - F.col("began")) / tick_rate), **was,
    }).select(*key, on, *_CHANGES)


def snapshots(frames: DataFrame, members: DataFrame, key: Names, sites: dict[str, tuple[float, float]], tick_rate: float, on: str = "tick", changes: DataFrame | None = None) -> DataFrame:
    """key, on and the 48 columns of a frame's snapshot.

    frames: key, on (once each), score_t, score_ct, losses_t, losses_ct, bomb, explosion, defuse. members: key, on, and
    those of samples.team_summaries with x and y. Places count for the living; where a side has none its measures are null
    and its mark of missing data is set. changes: bomb_changes of the frames, if they are known already. Differences are T
    less CT, but for the sites: CT less T, so that more means T is nearer. All parts meet by frame.
    """
    frame = [*key, on]
    changes = bomb_changes(frames, key, tick_rate, on) if changes is None else changes
    counts = samples.team_summaries(members, frame)
    base = samples.baseline(counts, frame)
    living = spatial.teams(members.filter("alive"), frame)
    near = spatial.nearest_opponent(living, frame)
    far = samples.site_distances(living, frame, sites)
    wide = living.select(*frame, _spread("t").alias("t_dispersion"), _spread("ct").alias("ct_dispersion"), *((F.size(spatial.placed(s)) == 0).alias(f"{s}_places_missing") for s in ("t", "ct")))
    rows = frames
    for part in (changes, base, wide, near, far):
        rows = rows.join(part, frame, "left")
    t, ct = F.col("t_dispersion"), F.col("ct_dispersion")
    none = lambda c: F.coalesce(c, F.lit(True))
    long = [c for c in base.columns if c not in frame]
    zero = {c: F.coalesce(c, F.lit(False) if base.schema[c].dataType.simpleString() == "boolean" else F.lit(0).cast(base.schema[c].dataType)) for c in long}
    return rows.select(
        *frame, (F.col("score_t") - F.col("score_ct")).alias("score_difference"), (F.col("losses_t") - F.col("losses_ct")).alias("losses_difference"), "bomb", *_CHANGES[:3],
        F.col("explosion").isNotNull().alias("has_explosion_timer"), F.col("defuse").isNotNull().alias("has_defuse_timer"), *REMEMBERED, "t_dispersion", "ct_dispersion", null_if_either(t, ct, t - ct).alias("dispersion_difference"),
        none(F.col("t_places_missing")).alias("t_places_missing"), none(F.col("ct_places_missing")).alias("ct_places_missing"), "nearest_opponent", F.col("nearest_opponent").isNull().alias("nearest_opponent_missing"),
        *(f"{s}_{m}_{n}" for m in ("mean", "least") for s in ("t", "ct") for n in sites), "t_closest", "ct_closest", *(f"{n}_difference" for n in sites), *(c.alias(n) for n, c in zero.items()),
    )


def with_event_states(rows: DataFrame, extra: DataFrame, keys: Names, keep_extra: bool) -> DataFrame:
    """rows and those that events add, one for each of keys: the regular one (frames), or the added one (equipment)."""
    both = relations.concat_keep(rows.withColumn("__from", F.lit(0)), extra.withColumn("__from", F.lit(1)), list(keys), ["__from"], last=keep_extra)
    return both.drop("__from")


def event_snapshots(frames: DataFrame, members: DataFrame, extras: DataFrame, extra_members: DataFrame, key: Names, sites: dict[str, tuple[float, float]], tick_rate: float, on: str = "tick") -> DataFrame:
    """snapshots of the frames, and of extra ones between them; adds source: regular or event.

    An extra frame has its own observation, and of what came before only the regular frames strictly before it; so extras
    never change each other or a regular row. An extra at a regular frame's time is left out: that frame's row stands.
    """
    off = extras.join(frames.select(*key, on), [*key, on], "left_anti")
    own = extra_members.join(off.select(*key, on), [*key, on], "left_semi")
    regular = snapshots(frames, members, key, sites, tick_rate, on).withColumn("source", F.lit("regular"))
    added = snapshots(off, own, key, sites, tick_rate, on, bomb_changes_at(frames, off, key, tick_rate, on)).withColumn("source", F.lit("event"))
    return regular.unionByName(added)


def active_samples(probes: DataFrame, tracks: DataFrame, keys: Names, on: str, start: str, end: str, points: str, width: int, lag: int = 0) -> DataFrame:
    """Pairs of a probe and a track [start, end + lag] that holds its time, with last: the track's last point up to then.

    points: an array of structs with tick. A track without a point yet gives no pair.
    """
    spans = tracks.withColumn("__until", F.col(end) + lag)
    met = asof.interval_join(probes, spans, keys, on, start, "__until", width, closed=True).drop("__until")
    seen = F.filter(F.array_sort(F.transform(points, lambda p: F.struct(p["tick"].alias("tick"), p.alias("p")))), lambda p: p["tick"] <= F.col(on))
    return met.withColumn("last", F.when(F.size(seen) > 0, F.element_at(seen, -1)["p"])).filter("last IS NOT NULL")


def nearest_track(probes: DataFrame, tracks: DataFrame, keys: Names, on: str, id_col: str, track_col: str, start: str, end: str, points: str, width: int, lag: int) -> DataFrame:
    """probes with track_col: of the tracks that ended `lag` ago at most, the one whose last point is nearest; null if none.

    Ties go to the earlier start, then to the smaller id. id_col tells probes apart; both have x and y.
    """
    met = active_samples(probes, tracks, keys, on, start, end, points, width, lag)
    dx, dy = F.col("last.x") - F.col("x"), F.col("last.y") - F.col("y")
    best = met.groupBy(id_col).agg(F.min(F.struct((dx * dx + dy * dy).alias("d"), start, track_col)).alias("b"))
    found = best.select(F.col(id_col).alias("__id"), F.col(f"b.{track_col}").alias(track_col))
    return probes.join(found, probes[id_col] == F.col("__id"), "left").drop("__id")


def merged_triggers(parts: Sequence[DataFrame], keys: Names, trigger: str = "trigger") -> DataFrame:
    """keys and the sorted set of triggers that any part names for them."""
    rows = parts[0].select(*keys, trigger)
    for other in parts[1:]:
        rows = rows.unionByName(other.select(*keys, trigger))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(trigger)).alias("triggers"))
