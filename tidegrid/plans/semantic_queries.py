"""Queries of whole timelines on the event log, with their SQL.

A user stands for a match: a sign-up starts an attempt, a view takes it live, a purchase or an error ends it for a side,
a click is a frame with ten members. The hour stands for a tick.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import semantics, sequence
from tidegrid.plans.timeline_queries import EV, HOUR, events

QUERIES, SQL = {}, {}

FEED_SQL = EV + """, o AS (SELECT user_id AS m, t // 3600000000 AS tick, event_id AS id, kind, value, t, kind = 'click' AS frame,
  CASE kind WHEN 'view' THEN 2 WHEN 'signup' THEN 1 WHEN 'purchase' THEN 0 WHEN 'error' THEN 0 END AS code FROM ev),
b AS (SELECT *, coalesce(last_value(code IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was, coalesce(last_value(code IGNORE NULLS) OVER w, 0) AS state,
  count(*) FILTER (kind IN ('purchase', 'error')) OVER w AS played, max(CASE WHEN kind = 'signup' THEN t / 1e6 END) OVER w AS begun FROM o WINDOW w AS (PARTITION BY m ORDER BY tick, id)),
k AS (SELECT *, count(*) FILTER (kind = 'signup' OR (kind = 'view' AND was = 0)) OVER (PARTITION BY m ORDER BY tick, id) AS n FROM b),
l AS (SELECT *, first_value(CASE WHEN kind = 'view' THEN played END IGNORE NULLS) OVER (PARTITION BY m, n ORDER BY tick, id) + 1 AS number FROM k WHERE NOT frame),
cm AS (SELECT m, tick, id, kind, value, t, begun, CASE WHEN n > 0 THEN 's0-a' || n END AS round_id, CASE WHEN n > 0 THEN number END AS number,
  CASE WHEN n > 0 AND state = 0 THEN 'ended' WHEN state < 2 THEN 'freeze' ELSE 'live' END AS phase, CASE WHEN value > 50 THEN 'tactical-timeout-flag' ELSE 'none' END AS pause FROM l)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(events(spark, sf_dir))
        if sql:
            SQL[f.__name__] = FEED_SQL + sql
        return f

    return add


def feed(ev: DataFrame) -> DataFrame:
    so_far = sequence.so_far(["user_id"], ["t", "event_id"])
    ended = F.col("kind").isin("purchase", "error")
    played, won = F.count_if(ended).over(so_far).cast("int"), F.count_if(F.col("kind") == "purchase").over(so_far).cast("int")
    begun = F.last(F.when(F.col("kind") == "signup", F.col("t") / 1e6), True).over(so_far)
    member = lambda k: F.struct(
        F.lit(f"{'T' if k < 5 else 'CT'}{k}").alias("member"), F.lit("T" if k < 5 else "CT").alias("team"), ((F.col("event_id") + k) % 4 != 0).alias("alive"),
        ((F.col("event_id") + k) % 7 != 0).alias("position"), ((F.col("event_id") + 3 * k) % 11 != 0).alias("equipment"),
    )
    made = {
        "match_id": F.col("user_id"), "tick": F.floor(F.col("t") / HOUR), "seq": F.col("event_id"), "kind": F.when(F.col("kind") == "click", semantics.FRAME).otherwise(semantics.COMMAND),
        "raw_round": played, "rounds_played": played, "score_t": won, "score_ct": played - won, "match_started": F.lit(True), "start_count": F.col("event_id").cast("int"), "start": F.col("kind") == "signup",
        "live": F.col("kind") == "view", "end": ended, "winner": F.when(F.col("kind") == "purchase", "T").when(F.col("kind") == "error", "CT"), "reason": F.col("kind"), "game_time": F.col("t") / 1e6,
        "round_start_time": begun, "round_time": F.lit(172_800), "t_timeout": F.col("value") > 50, "paused_ticks": F.lit(0), "members": F.array(*map(member, range(10))),
    }
    empty = {x.split()[0].strip("`"): x.split()[1] for x in semantics.FEED.split("members")[0].replace("\n", " ").split(", ") if x.strip()}
    return ev.select(*(made.get(c, F.lit(None).cast(empty.get(c, "string"))).alias(c) for c in ["match_id", *semantics.names(semantics.FEED)]))


@query("""SELECT m AS match_id, tick, id AS seq, round_id, CAST(number AS INTEGER) AS round_number, phase, pause FROM cm WINDOW w AS (PARTITION BY m ORDER BY tick, id)
QUALIFY kind IN ('signup', 'view', 'purchase', 'error') OR tick // 64 IS DISTINCT FROM lag(tick // 64) OVER w OR pause IS DISTINCT FROM lag(pause) OVER w""")
def t04_audit(ev):
    return semantics.collected(feed(ev)).audit.select("match_id", "tick", "seq", "round_id", "round_number", "phase", "pause")


@query(""", f AS (SELECT * FROM o WHERE frame QUALIFY row_number() OVER (PARTITION BY m, tick ORDER BY id DESC) = 1),
j AS (SELECT f.m, f.tick, f.id, cm.* EXCLUDE (m, tick, id), row_number() OVER (PARTITION BY f.m, f.tick ORDER BY cm.tick DESC, cm.id DESC) AS pick FROM f JOIN cm ON cm.m = f.m AND (cm.tick, cm.id) < (f.tick, f.id)),
x AS (SELECT *, round_id IS NOT NULL AND phase = 'live' AND coalesce(t / 1e6 - begun >= 0, false) AS known FROM j WHERE pick = 1),
r AS (SELECT m, tick, list(k) FILTER ((id + k) % 4 <> 0) AS alive FROM x, range(10) q(k) GROUP BY m, tick, id)
SELECT m AS match_id, tick, round_id, CAST(number AS INTEGER) AS round_number, phase, round(CASE WHEN known THEN t / 1e6 - begun END, 6) AS elapsed, round(CASE WHEN known THEN greatest(0, 172800 - (t / 1e6 - begun)) END, 6) AS remaining,
  known AS clock_known, pause, 10::BIGINT AS life_known, len(alive)::BIGINT AS alive, len(list_filter(alive, lambda k: (id + k) % 7 <> 0))::BIGINT AS position_known, len(list_filter(alive, lambda k: (id + 3 * k) % 11 <> 0))::BIGINT AS equipment_known,
  CASE WHEN len(list_filter(alive, lambda k: (id + k) % 7 = 0 OR (id + 3 * k) % 11 = 0)) > 0 THEN 'partial' ELSE 'usable' END AS quality FROM x JOIN r USING (m, tick)""")
def t04_frames(ev):
    out = semantics.collected(feed(ev)).frames
    return out.select(
        "match_id", "tick", "round_id", "round_number", "phase", F.round("elapsed", 6).alias("elapsed"), F.round("remaining", 6).alias("remaining"), "clock_known", "pause", "life_known", "alive", "position_known", "equipment_known", "quality"
    )
