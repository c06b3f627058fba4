"""Queries of whole snapshots and of tracks, on vectors and events, with their SQL.

Twenty frames of ten vectors stand for a match, the frame's number for the bomb's state; a purchase begins a track of six
hours whose points are the user's events in that time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import snapshots
from tidegrid.plans import sample_queries, table_queries
from tidegrid.plans.timeline_queries import EV, events

QUERIES, SQL = {}, {}
BOMB = ("carried", "carried", "dropped", "planting", "planted", "planted", "defusing")
SITES = {"a": (0.1, 0.0), "b": (0.0, -0.2)}
SPAN = 6 * 3_600_000_000

_F = sample_queries.MB + f""", f AS (SELECT DISTINCT frame, frame // 20 AS match, (frame % 20) * 64 AS tick, ({list(BOMB)!r})[CAST(frame % 7 AS INT) + 1] AS bomb FROM m),
c AS (SELECT *, row_number() OVER w = 1 OR bomb IS DISTINCT FROM lag(bomb) OVER w AS fresh, lag(bomb) OVER w AS before FROM f WINDOW w AS (PARTITION BY match ORDER BY tick)),
h AS (SELECT *, count(*) FILTER (fresh) OVER w AS changes, last_value(CASE WHEN fresh THEN tick END IGNORE NULLS) OVER w AS began, last_value(CASE WHEN fresh THEN {{'b': before}} END IGNORE NULLS) OVER w AS previous,
  bool_or(bomb = 'planted') OVER w AS planted FROM c WINDOW w AS (PARTITION BY match ORDER BY tick)),
a AS (SELECT frame, sqrt(var_pop(x) FILTER (team = 't') + var_pop(y) FILTER (team = 't')) AS t, sqrt(var_pop(x) FILTER (team = 'ct') + var_pop(y) FILTER (team = 'ct')) AS ct FROM m WHERE alive GROUP BY frame),
n AS (SELECT p.frame, min(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))) AS d FROM m p JOIN m q ON p.frame = q.frame AND p.team = 't' AND q.team = 'ct' AND p.alive AND q.alive GROUP BY p.frame),
e AS (SELECT frame, count(*) FILTER (team = 't' AND alive) - count(*) FILTER (team = 'ct' AND alive) AS alive, coalesce(sum(label * 1000) FILTER (team = 't' AND known), 0) - coalesce(sum(label * 1000) FILTER (team = 'ct' AND known), 0) AS value FROM m GROUP BY frame)"""
_COLUMNS = """match, tick, bomb, previous.b AS previous_bomb, changes AS bomb_changes, (tick - began) / 64.0::DOUBLE AS since_bomb_change, planted AS bomb_was_planted, round(t, 6) AS t_dispersion, round(t - ct, 6) AS dispersion_difference,
  t IS NULL AS t_places_missing, round(d, 6) AS nearest_opponent, d IS NULL AS nearest_opponent_missing, alive AS alive_difference, CAST(value AS BIGINT) AS value_difference"""
_NAMES = "match tick bomb previous_bomb bomb_changes since_bomb_change bomb_was_planted t_dispersion dispersion_difference t_places_missing nearest_opponent nearest_opponent_missing alive_difference value_difference".split()


def _match(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = sample_queries.members(spark, sf_dir)
    at = {"match": F.floor(F.col("frame") / 20), "tick": F.col("frame") % 20 * 64}
    bomb = F.get(F.array(*map(F.lit, BOMB)), (F.col("frame") % 7).cast("int"))
    zero = {c: F.lit(0) for c in ("score_t", "score_ct", "losses_t", "losses_ct")}
    none = {c: F.lit(None).cast("double") for c in ("explosion", "defuse")}
    return m.select("frame").distinct().withColumns({**at, "bomb": bomb, **zero, **none}).drop("frame"), m.withColumns(at)


def _shown(out: DataFrame, *more: str) -> DataFrame:
    return table_queries._r(out.select(*_NAMES, *more), "t_dispersion", "dispersion_difference", "nearest_opponent")


def a09_snapshot(spark, sf_dir: str) -> DataFrame:
    frames, members = _match(spark, sf_dir)
    return _shown(snapshots.snapshots(frames, members, ["match"], SITES, 64.0))


def t30_event_snapshots(spark, sf_dir: str) -> DataFrame:
    """Every third frame of a match is an event's: it stands alone behind the regular ones before it."""
    frames, members = _match(spark, sf_dir)
    extra = F.col("tick") % 192 == 128
    return _shown(snapshots.event_snapshots(frames.filter(~extra), members.filter(~extra), frames.filter(extra), members.filter(extra), ["match"], SITES, 64.0), "source")


QUERIES |= {"a09_snapshot": a09_snapshot, "t30_event_snapshots": t30_event_snapshots}
SQL["a09_snapshot"] = _F + f" SELECT {_COLUMNS} FROM h LEFT JOIN a USING (frame) LEFT JOIN n USING (frame) LEFT JOIN e USING (frame)"
_REGULAR = _F.replace("FROM f WINDOW w", "FROM f WHERE tick % 192 <> 128 WINDOW w")
SQL["t30_event_snapshots"] = _REGULAR + f""", x AS (SELECT f.frame, f.match, f.tick, f.bomb, h.bomb IS DISTINCT FROM f.bomb OR h.frame IS NULL AS fresh, h.* EXCLUDE (frame, match, tick, bomb, fresh, before), h.bomb AS last, row_number() OVER (PARTITION BY f.frame ORDER BY h.tick DESC) AS pick
  FROM f LEFT JOIN h ON h.match = f.match AND h.tick < f.tick WHERE f.tick % 192 = 128),
y AS (SELECT frame, match, tick, bomb, coalesce(changes, 0) + fresh::INT AS changes, CASE WHEN fresh THEN tick ELSE began END AS began, CASE WHEN fresh THEN {{'b': last}} ELSE previous END AS previous, coalesce(planted, false) OR bomb = 'planted' AS planted FROM x WHERE pick = 1),
u AS (SELECT frame, match, tick, bomb, changes, began, previous, planted, 'regular' AS source FROM h UNION ALL SELECT *, 'event' FROM y)
SELECT {_COLUMNS}, source FROM u LEFT JOIN a USING (frame) LEFT JOIN n USING (frame) LEFT JOIN e USING (frame)"""


def _tracks(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = events(spark, sf_dir)
    begun = ev.filter("kind = 'purchase'").select(F.col("user_id").alias("u"), F.col("event_id").alias("track"), F.col("t").alias("start"), (F.col("t") + SPAN).alias("end"))
    own = begun.join(ev, (F.col("u") == F.col("user_id")) & F.col("t").between(F.col("start"), F.col("end")))
    point = F.struct(F.col("t").alias("tick"), F.col("value").alias("x"), F.col("event_id").cast("double").alias("y"))
    tracks = own.groupBy(F.col("u").alias("user_id"), "track", "start", "end").agg(F.collect_list(point).alias("points"))
    return ev.filter("kind = 'click'").select("user_id", "event_id", "t", F.col("value").alias("x"), F.col("event_id").cast("double").alias("y")), tracks


def j12_active_samples(spark, sf_dir: str) -> DataFrame:
    clicks, tracks = _tracks(spark, sf_dir)
    return snapshots.active_samples(clicks, tracks, ["user_id"], "t", "start", "end", "points", SPAN).select("event_id", "track", F.col("last.tick").alias("last_t"), F.col("last.x").alias("last_x"))


def j25_nearest_track(spark, sf_dir: str) -> DataFrame:
    clicks, tracks = _tracks(spark, sf_dir)
    return snapshots.nearest_track(clicks, tracks, ["user_id"], "t", "event_id", "track", "start", "end", "points", SPAN, SPAN).select("event_id", "track")


QUERIES |= {"j12_active_samples": j12_active_samples, "j25_nearest_track": j25_nearest_track}
_T = EV + """, k AS (SELECT c.event_id, c.t AS at, c.value AS cx, p.event_id AS track, p.t AS start, e.t AS last_t, e.value AS last_x, e.event_id AS last_y FROM c JOIN p ON p.user_id = c.user_id AND c.t BETWEEN p.t AND p.t + {reach}
  JOIN ev e ON e.user_id = c.user_id AND e.t BETWEEN p.t AND least(c.t, p.t + 21600000000) QUALIFY row_number() OVER (PARTITION BY c.event_id, p.event_id ORDER BY e.t DESC) = 1)"""
SQL["j12_active_samples"] = _T.replace("{reach}", "21600000000") + " SELECT event_id, track, last_t, last_x FROM k"
SQL["j25_nearest_track"] = _T.replace("{reach}", "43200000000") + """, b AS (SELECT event_id, track FROM k QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY (last_x - cx) * (last_x - cx) + (last_y - event_id) * (last_y - event_id), start, track) = 1)
SELECT event_id, track FROM c LEFT JOIN b USING (event_id)"""
