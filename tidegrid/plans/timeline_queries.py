"""Queries of the time-series operators on the event log, with their SQL.

The tables hold no match recordings; a user stands for an entity, a user's day for a round, a purchase for a state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import asof, evaluate, relations, rounds, select, sequence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HOUR, DAY = 3_600_000_000, 86_400_000_000

EV = """WITH ev AS (SELECT event_id, user_id, event_type AS kind, value, epoch_us(ts) AS t, epoch_us(ts) // 86400000000 AS day FROM events),
p AS (SELECT * FROM ev WHERE kind = 'purchase'), c AS (SELECT * FROM ev WHERE kind = 'click'), s AS (SELECT * FROM ev WHERE kind = 'signup')"""


def query(sql: str | None = None):
    def add(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(events(spark, sf_dir))
        if sql:
            SQL[name] = EV + sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select("event_id", "user_id", F.col("event_type").alias("kind"), "value", t.alias("t"), F.floor(t / DAY).alias("day"))


def _of(ev: DataFrame, kind: str) -> DataFrame:
    return ev.filter(F.col("kind") == kind)


def _clicks(ev: DataFrame) -> DataFrame:
    return _of(ev, "click").select("event_id", "user_id", "day", "t")


def _asof(ev: DataFrame, keys=("user_id",), **how) -> DataFrame:
    states = _of(ev, "purchase").select(*keys, "t", F.col("value").alias("held"), F.col("t").alias("held_at"), "event_id")
    out = asof.asof_join(_clicks(ev), states, list(keys), "t", ["held", "held_at"], ties=["event_id"], **how)
    return out.select("event_id", "held", "held_at")


_J = "\nSELECT c.event_id, p.value AS held, p.t AS held_at FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND "


@query(_J + "c.t >= p.t")
def j01_asof_backward(ev):
    return _asof(ev)


@query(_J + "c.t >= p.t")
def j01_asof_backward_in_stretches(ev):
    return _asof(ev, span=5 * DAY)


@query(_J + "c.day = p.day AND c.t >= p.t")
def j02_asof_within_round(ev):
    return _asof(ev, keys=("user_id", "day"))


@query("\nSELECT c.event_id, coalesce(p.value, -1) AS held FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.t >= p.t")
def j03_asof_default(ev):
    states = _of(ev, "purchase").select("user_id", "t", F.col("value").alias("held"))
    return asof.asof_or_default(_clicks(ev), states, ["user_id"], "t", ["held"], {"held": F.lit(-1.0)}).select("event_id", "held")


@query("\nSELECT c.event_id, CASE WHEN p.day = c.day THEN p.value END AS held FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.t >= p.t")
def j04_asof_guarded(ev):
    states = _of(ev, "purchase").select("user_id", "t", F.col("value").alias("held"), F.col("day").alias("state_day"))
    return asof.asof_guarded(_clicks(ev), states, ["user_id"], "t", ["held"], F.col("state_day") == F.col("day"), ["state_day"]).select("event_id", "held")


@query("\nSELECT c.event_id, CASE WHEN c.t - p.t <= 43200000000 THEN p.value END AS held FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.t >= p.t")
def j05_asof_with_age(ev):
    return _asof(ev, tolerance=DAY // 2).select("event_id", "held")


@query("\nSELECT c.event_id, CASE WHEN c.t - p.t <= 43200000000 THEN p.value END AS held FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.t > p.t")
def j06_asof_strict(ev):
    return _asof(ev, strict=True, tolerance=DAY // 2).select("event_id", "held")


@query(_J + "c.t <= p.t")
def j07_asof_forward(ev):
    return _asof(ev, direction="forward")


@query("""\nSELECT c.event_id, greatest((SELECT count(*) FROM p WHERE p.user_id = c.user_id AND p.t <= c.t) - 1, 0) AS index FROM c""")
def j08_index_clamped(ev):
    return asof.asof_index(_clicks(ev), _of(ev, "purchase").select("user_id", "t"), ["user_id"], "t", clamp=True).select("event_id", F.col("index").cast("long"))


@query("""\n, r AS (SELECT user_id, t AS a, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS b FROM s)
SELECT p.event_id, r.a AS round_start FROM p JOIN r ON p.user_id = r.user_id AND p.t >= r.a AND (r.b IS NULL OR p.t < r.b)""")
def j10_interval_join(ev):
    starts = _of(ev, "signup").select("user_id", F.col("t").alias("a"))
    rounds = starts.withColumn("b", F.lead("a").over(sequence._w(["user_id"], ["a"])))
    points = _of(ev, "purchase").select("event_id", "user_id", "t")
    return asof.interval_join(points, rounds, ["user_id"], "t", "a", "b", 2 * DAY).select("event_id", F.col("a").alias("round_start"))


@query("\nSELECT event_id FROM c WHERE EXISTS (SELECT 1 FROM p WHERE p.user_id = c.user_id AND p.t + 7200000000 >= c.t AND p.t <= c.t)")
def j13_overlap_exists(ev):
    spans = _of(ev, "purchase").select("user_id", F.col("t").alias("a"), (F.col("t") + 2 * HOUR).alias("b"))
    points = _clicks(ev).withColumn("until", F.col("t"))
    return asof.overlaps(points, spans, ["user_id"], "a", "b", "t", "until").select("event_id")


@query("\nSELECT c.event_id, e.kind FROM c JOIN ev e USING (event_id)")
def j14_unique_lookup(ev):
    return relations.unique_lookup(_clicks(ev), ev.select("event_id", "kind"), ["event_id"]).select("event_id", "kind")


@query("""\n, a AS (SELECT event_id, value FROM ev WHERE event_id % 3 < 2), b AS (SELECT event_id, CASE WHEN event_id % 30 = 1 THEN -1 ELSE value END AS value FROM ev WHERE event_id % 3 > 0)
SELECT count(*) FILTER (a.event_id IS NOT NULL AND b.event_id IS NOT NULL) AS both, count(*) FILTER (b.event_id IS NULL) AS only_a, count(*) FILTER (a.event_id IS NULL) AS only_b,
count(*) FILTER (a.event_id IS NOT NULL AND b.event_id IS NOT NULL AND a.value IS DISTINCT FROM b.value) AS differing, 0::BIGINT AS repeated FROM a FULL JOIN b ON a.event_id = b.event_id""")
def j15_companion_check(ev):
    a = ev.filter("event_id % 3 < 2").select("event_id", "value")
    b = ev.filter("event_id % 3 > 0").select("event_id", F.when(F.expr("event_id % 30 = 1"), F.lit(-1.0)).otherwise(F.col("value")).alias("value"))
    return relations.compared(a, b, ["event_id"], ["value"])


@query("\nSELECT event_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY user_id, day) AS weight FROM ev WHERE event_id % 3 = 1")
def j16_paired_weights(ev):
    a, b = ev.filter("event_id % 3 < 2").select("event_id", "user_id", "day"), ev.filter("event_id % 3 > 0").select("event_id")
    return relations.paired(a, b, ["event_id"], ["user_id", "day"]).select("event_id", "weight")


@query("\nSELECT event_id, kind, value, false AS overlaid FROM ev WHERE kind = 'view' AND event_id % 5 <> 0 UNION ALL SELECT event_id, 'human', -value, true FROM ev WHERE event_id % 5 = 0")
def j29_overlay(ev):
    over = ev.filter("event_id % 5 = 0").select("event_id", F.lit("human").alias("kind"), (-F.col("value")).alias("value"))
    return relations.overlaid(_of(ev, "view"), over, ["event_id"], ["kind", "value"])


@query("\nSELECT user_id, kind, count(*) AS rows FROM ev GROUP BY ALL HAVING count(*) > 1")
def j14_duplicates(ev):
    return relations.duplicates(ev, ["user_id", "kind"])


@query("\n, l AS (SELECT *, lag(kind) OVER w AS b FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT event_id, kind FROM l WHERE b IS NULL OR b <> kind")
def t05_change_only(ev):
    return sequence.change_only(ev, ["user_id"], ["t", "event_id"], ["kind"]).select("event_id", "kind")


@query("""\n, l AS (SELECT *, lag(kind) OVER w AS b, row_number() OVER w AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
g AS (SELECT *, sum(CAST(n = 1 OR b <> kind AS BIGINT)) OVER (PARTITION BY user_id ORDER BY n) AS changes FROM l)
SELECT event_id, CAST(changes AS BIGINT) AS changes, first_value(b) OVER (PARTITION BY user_id, changes ORDER BY n) AS previous,
  coalesce(bool_or(kind = 'purchase') OVER (PARTITION BY user_id ORDER BY n), false) AS bought FROM g""")
def t06_transitions(ev):
    return sequence.transitions(ev, ["user_id"], ["t", "event_id"], "kind", {"bought": "purchase"}).select("event_id", "changes", "previous", "bought")


@query("""\n, l AS (SELECT *, lag(kind) OVER w AS b, row_number() OVER w AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, t - max(CASE WHEN n = 1 OR b <> kind THEN t END) OVER (PARTITION BY user_id ORDER BY n) AS since FROM l""")
def t07_since_change(ev):
    return sequence.since_change(ev, ["user_id"], "t", "kind", ties=["event_id"]).select("event_id", "since")


@query()
def t08_min_gap(ev):
    return sequence.min_gap(ev, ["user_id"], "t", 6 * HOUR, ["event_id"]).select("event_id", "user_id")


SQL["t08_min_gap"] = EV.replace("WITH ev", "WITH RECURSIVE ev") + """
, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM ev),
r AS (SELECT user_id, n, t, event_id FROM k WHERE n = 1
  UNION ALL SELECT x.user_id, x.n, x.t, x.event_id FROM (
    SELECT k.user_id, k.n, k.t, k.event_id, row_number() OVER (PARTITION BY k.user_id ORDER BY k.n) AS q FROM r JOIN k ON k.user_id = r.user_id AND k.n > r.n AND k.t - r.t >= 21600000000) x WHERE q = 1)
SELECT event_id, user_id FROM r"""


@query("\nSELECT event_id FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, t // 21600000000 ORDER BY t, event_id) = 1")
def t09_first_per_bucket(ev):
    return sequence.first_per_bucket(ev, ["user_id"], "t", 6 * HOUR, ["event_id"]).select("event_id")


_REL = "\n, z AS (SELECT event_id, user_id, t - min(t) OVER (PARTITION BY user_id) AS t FROM ev), n AS (SELECT user_id, greatest(1, CAST(ceil(max(t) / 172800000000.0) AS BIGINT)) AS n FROM z GROUP BY 1)"


def _relative(ev: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return ev.select("event_id", "user_id", (F.col("t") - F.min("t").over(Window.partitionBy("user_id"))).alias("t"))


@query(_REL + """ SELECT event_id, w AS window, w = least(t // 172800000000, n - 1) AS core FROM z JOIN n USING (user_id), range(0, 20) AS r(w)
WHERE w < n AND t >= w * 172800000000 - 7200000000 AND t <= (w + 1) * 172800000000 + 7200000000""")
def t10_padded_windows(ev):
    out = sequence.padded_windows(_relative(ev), ["user_id"], "t", 2 * DAY, 2 * HOUR)
    return out.select("event_id", F.col("window").cast("long").alias("window"), "core")


@query("""\n, z AS (SELECT *, 1704067200000000 + 5 * 86400000000 AS a, 1704067200000000 + 7 * 86400000000 AS b FROM ev)
SELECT event_id FROM z WHERE t > a AND t <= b UNION ALL (SELECT event_id FROM z WHERE t <= a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) = 1)
UNION ALL (SELECT event_id FROM z WHERE t > b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) = 1)""")
def t11_window_slice(ev):
    a = 1_704_067_200_000_000
    return sequence.window_slice(ev, ["user_id"], "t", F.lit(a + 5 * DAY), F.lit(a + 7 * DAY), ["event_id"]).select("event_id")


@query("""\n, l AS (SELECT *, CAST(coalesce(t - lag(t) OVER w > 21600000000, true) AS BIGINT) AS f FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS session FROM l""")
def t13_sessions(ev):
    return sequence.sessions(ev, ["user_id"], "t", 6 * HOUR, ["event_id"]).select("event_id", F.col("session").cast("long").alias("session"))


@query("""\n, v AS (SELECT event_id, (value - lag(value) OVER w) / ((t - lag(t) OVER w) / 3600000000.0) AS v FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT event_id, round(CASE WHEN v * v <= 400 THEN v ELSE 0 END, 6) AS v_value FROM v""")
def t14_velocity(ev):
    return sequence.velocity(ev, ["user_id"], "t", ["value"], 400.0, float(HOUR)).select("event_id", F.round("v_value", 6).alias("v_value"))


@query("""\n, g AS (SELECT DISTINCT user_id, kind, day AS g FROM ev), i AS (SELECT *, g - row_number() OVER (PARTITION BY user_id, kind ORDER BY g) AS i FROM g)
SELECT user_id, kind, min(g) * 86400000000 AS start, (max(g) + 1) * 86400000000 AS "end" FROM i GROUP BY user_id, kind, i""")
def t16_presence_tracks(ev):
    return sequence.presence_tracks(ev, ["user_id"], "t", DAY, "kind").select("user_id", "kind", "start", "end")


@query("""\nSELECT user_id, min(t) FILTER (kind = 'purchase') AS first_purchase, min(t) FILTER (value > 100) AS first_large FROM ev GROUP BY user_id""")
def t18_first_where(ev):
    return sequence.first_where(ev, ["user_id"], "t", {"first_purchase": F.col("kind") == "purchase", "first_large": F.col("value") > 100})


@query("""\n, m AS (SELECT *, kind <> 'error' AS y, sum(CAST(kind = 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM ev)
SELECT event_id FROM (SELECT *, min(t) FILTER (y) OVER (PARTITION BY user_id, i) AS a FROM m) WHERE y AND t - a >= 86400000000""")
def t19_held_for(ev):
    return sequence.held_for(ev, ["user_id"], "t", F.col("kind") != "error", DAY, ["event_id"]).select("event_id")


@query("""\n, o AS (SELECT event_id, t, arg_min(value, t) OVER w AS v, min(t) OVER w AS a FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN t - a >= 21600000000 THEN v END AS earlier FROM o""")
def t20_earliest_old_enough(ev):
    return sequence.earliest_at_least_old(ev, ["user_id"], "t", "value", 6 * HOUR, DAY).select("event_id", "earlier")


@query("\nSELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS seen FROM ev")
def t21_lookback(ev):
    return sequence.lookback_count(ev, ["user_id"], "t", DAY).select("event_id", "seen")


@query("""\n, l AS (SELECT *, lag(kind) OVER w AS b, row_number() OVER w AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, max(CASE WHEN n = 1 OR b <> kind THEN t END) OVER (PARTITION BY user_id ORDER BY n) AS run_start FROM l""")
def t22_run_starts(ev):
    return sequence.run_starts(ev, ["user_id"], ["t", "event_id"], "kind", "t").select("event_id", "run_start")


@query("""\n, l AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS g FROM ev)
SELECT user_id, max(g) AS gap, coalesce(max(g) > 172800000000, false) AS broken FROM l GROUP BY user_id""")
def t23_largest_gap(ev):
    return sequence.largest_gap(ev, ["user_id"], "t", 2 * DAY)


@query("""\n, l AS (SELECT *, lead(t) OVER w AS t2, lead(value) OVER w AS v2 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)),
a AS (SELECT *, 1704067200000000 + 9 * 86400000000 AS a FROM l)
SELECT user_id, round(value + coalesce((a - t) / (t2 - t) * (v2 - value), 0), 6) AS value FROM a WHERE t <= a AND (t2 IS NULL OR t2 > a)""")
def t24_interpolate(ev):
    at = F.lit(1_704_067_200_000_000 + 9 * DAY)
    return sequence.interpolate(ev, ["user_id"], "t", at, ["value"]).select("user_id", F.round("value", 6).alias("value"))


@query("""\n, l AS (SELECT *, lead(t) OVER w AS t2, lead(kind) OVER w AS k2 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)), u AS (SELECT *, least(t + 21600000000, coalesce(t2, t + 21600000000), (day + 1) * 86400000000) AS until FROM l)
SELECT event_id, until, coalesce(until = t2 AND k2 = kind, false) AS joined FROM u""")
def t26_step_segments(ev):
    return sequence.step_segments(ev, ["user_id"], "t", "kind", 6 * HOUR, (F.col("day") + 1) * DAY).select("event_id", "until", "joined")


@query("""\nSELECT event_id, list_aggregate(list(event_id) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 'string_agg', ',') AS trail FROM ev""")
def t27_trail(ev):
    return sequence.trail(ev, ["user_id"], "t", "event_id", 5).select("event_id", F.array_join(F.transform("trail", lambda x: x.cast("string")), ",").alias("trail"))


@query("\n, l AS (SELECT *, lag(kind) OVER w AS k, lag(t) OVER w AS b FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT event_id FROM l WHERE b IS NULL OR (b <> t AND k <> kind)")
def t15_dedupe_consecutive(ev):
    return sequence.dedupe_consecutive(ev, ["user_id"], "t", ["kind"], ["event_id"]).select("event_id")


@query("\n, l AS (SELECT event_id, kind = 'error' AS e, lag(kind = 'error') OVER (PARTITION BY user_id ORDER BY t, event_id) AS b FROM ev) SELECT event_id, CASE WHEN e AND NOT b THEN 'start' WHEN NOT e AND b THEN 'stop' END AS edge FROM l")
def t17_edges(ev):
    flagged = ev.withColumn("failing", F.col("kind") == "error")
    return sequence.rising_edges(flagged, ["user_id"], ["t", "event_id"], "failing").select("event_id", "edge")


@query("\nSELECT event_id, kind, value FROM ev WHERE event_id % 3 < 2 OR event_id % 2 = 0")
def u01_strict_union(ev):
    part = lambda cond: ev.filter(cond).select("event_id", "kind", "value")
    return relations.strict_union([part("event_id % 3 < 2"), part("event_id % 2 = 0")], ["event_id"])


@query("\nSELECT event_id, user_id, day FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY t DESC, event_id DESC) = 1")
def u04_concat_keep_last(ev):
    rows = ev.select("event_id", "user_id", "day", "t")
    return relations.concat_keep(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), ["user_id", "day"], ["t", "event_id"], last=True).select("event_id", "user_id", "day")


@query("\nSELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END AS side FROM ev WHERE event_id % 3 IN (0, 2)")
def u06_differences(ev):
    return relations.differences(ev.filter("event_id % 3 < 2").select("event_id"), ev.filter("event_id % 3 > 0").select("event_id"))


@query("\nSELECT user_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM ev GROUP BY user_id")
def u08_merged_sets(ev):
    sets = ev.groupBy("user_id", "day").agg(F.collect_set("kind").alias("kinds"))
    return relations.merged_sets(sets, ["user_id"], "kinds").select("user_id", F.array_join("kinds", ",").alias("kinds"))


@query("\nSELECT event_id, r.i AS copy, round(1.0::DOUBLE / count(*) OVER (PARTITION BY user_id), 9) AS weight FROM ev, range(0, 5) AS r(i) WHERE r.i < CASE WHEN kind = 'purchase' THEN 5 ELSE 1 END")
def u10_repeated_rows(ev):
    out = relations.repeated_rows(ev, F.when(F.col("kind") == "purchase", 5).otherwise(1), ["user_id"])
    return out.select("event_id", F.col("copy").cast("long").alias("copy"), F.round("weight", 9).alias("weight"))


@query("""\n, v AS (SELECT *, lag(kind) OVER w AS before, row_number() OVER w AS n FROM ev WHERE kind <> 'click' WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
a AS (SELECT *, count(*) FILTER (kind = 'signup' OR (kind = 'view' AND coalesce(before, 'error') IN ('purchase', 'error'))) OVER w AS k, count(*) FILTER (kind IN ('purchase', 'error')) OVER w AS played, count(*) FILTER (kind = 'purchase') OVER w AS won FROM v WINDOW w AS (PARTITION BY user_id ORDER BY n)),
g AS (SELECT user_id, k, min(t) AS start_tick, min(t) FILTER (kind = 'view') AS live_tick, arg_min(played, n) FILTER (kind = 'view') AS played, arg_min(won, n) FILTER (kind = 'view') AS won,
  arg_min(t, n) FILTER (kind IN ('purchase', 'error')) AS end_tick, arg_min(kind, n) FILTER (kind IN ('purchase', 'error')) AS last FROM a WHERE k > 0 GROUP BY ALL),
x AS (SELECT *, lead(start_tick) OVER (PARTITION BY user_id ORDER BY k) AS next FROM g)
SELECT user_id AS match_id, 's0-a' || k AS round_id, 0::INTEGER AS segment, CAST(played + 1 AS INTEGER) AS round_number, start_tick, live_tick, coalesce(end_tick, next) AS end_tick, CAST(won AS INTEGER) AS score_t, CAST(played - won AS INTEGER) AS score_ct,
  CASE WHEN end_tick IS NOT NULL AND live_tick < end_tick THEN 'completed' WHEN end_tick IS NOT NULL THEN 'result-unconfirmed' WHEN next IS NOT NULL THEN 'void' ELSE 'result-missing' END AS disposition,
  CASE last WHEN 'purchase' THEN 'T' WHEN 'error' THEN 'CT' END AS winner, CASE WHEN end_tick IS NOT NULL THEN last WHEN next IS NOT NULL THEN 'replaced-before-result' ELSE 'end-of-demo' END AS reason FROM x""")
def t01_round_attempts(ev):
    """A sign-up starts an attempt, a view takes it live, a purchase or an error ends it for one side."""
    played = F.coalesce(F.count_if(F.col("kind").isin("purchase", "error")).over(sequence.so_far(["user_id"], ["t", "event_id"])), F.lit(0)).cast("int")
    t_won = F.count_if(F.col("kind") == "purchase").over(sequence.so_far(["user_id"], ["t", "event_id"])).cast("int")
    no, yes = F.lit(False), F.lit(True)
    observed = ev.select(
        F.col("user_id").alias("match_id"), F.col("t").alias("tick"), F.col("event_id").alias("seq"), played.alias("raw_round"), played.alias("rounds_played"),
        t_won.alias("score_t"), (played - t_won).alias("score_ct"), no.alias("warmup"), yes.alias("match_started"), no.alias("freeze"), no.alias("team_intro"),
        F.col("event_id").cast("int").alias("start_count"), (F.col("kind") == "signup").alias("start"), (F.col("kind") == "view").alias("live"),
        F.col("kind").isin("purchase", "error").alias("end"), F.when(F.col("kind") == "purchase", "T").when(F.col("kind") == "error", "CT").alias("winner"), F.col("kind").alias("reason"),
    )
    return rounds.round_attempts(observed)


def _clock_rows(ev: DataFrame) -> DataFrame:
    """A sign-up starts a round of the user; values stand for pauses, the hour of the day for time-outs."""
    so_far = sequence.so_far(["user_id"], ["t", "event_id"])
    seconds = F.col("t") / 1e6
    started = F.last(F.when(F.col("kind") == "signup", seconds), True).over(so_far)
    no = F.lit(False)
    return ev.select(
        F.col("user_id").alias("match_id"), F.col("t").alias("tick"), "event_id", F.nullif(F.count_if(F.col("kind") == "signup").over(so_far), F.lit(0)).cast("string").alias("round_id"),
        F.when(F.col("kind") == "view", "live").when(F.col("kind") == "error", "post-plant").otherwise("freeze").alias("phase"),
        seconds.alias("game_time"), started.alias("round_start_time"), F.lit(172_800).alias("round_time"), (F.col("value") > 45).alias("paused"), no.alias("technical"),
        (F.col("value") > 30).alias("waiting"), (F.col("event_id") % 3 == 0).alias("t_timeout"), no.alias("ct_timeout"), F.count_if(F.col("value") > 40).over(so_far).cast("int").alias("paused_ticks"),
        (F.col("value") - 5).alias("explosion"), F.lit(None).cast("double").alias("defuse"),
    )


@query("""\n, o AS (SELECT user_id AS m, event_id AS id, row_number() OVER w AS n, nullif(count(*) FILTER (kind = 'signup') OVER w, 0) AS r, CASE kind WHEN 'view' THEN 'live' WHEN 'error' THEN 'post-plant' ELSE 'freeze' END AS phase,
  t / 1e6 - max(CASE WHEN kind = 'signup' THEN t / 1e6 END) OVER w AS elapsed, value > 45 OR (value > 30 AND event_id % 3 <> 0) AS hard, event_id % 3 = 0 AS tactical, count(*) FILTER (value > 40) OVER w AS ticks, value - 5 AS explosion
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
f AS (SELECT m, r, min(n) AS first, min(n) FILTER (phase <> 'freeze') AS play FROM o GROUP BY m, r),
g AS (SELECT f.*, a.ticks AS first_ticks, b.ticks AS play_ticks, coalesce(NOT b.hard AND b.elapsed BETWEEN 0 AND 21600, false) AS fresh FROM f JOIN o a ON a.m = f.m AND a.n = f.first LEFT JOIN o b ON b.m = f.m AND b.n = f.play),
u AS (SELECT o.*, EXISTS (SELECT 1 FROM o x WHERE x.m = o.m AND x.r IS NOT DISTINCT FROM o.r AND x.n <= o.n AND (NOT (g.fresh AND o.n >= g.play) OR x.n > g.play)
    AND (x.hard OR x.ticks <> CASE WHEN g.fresh AND o.n >= g.play THEN g.play_ticks WHEN g.r IS NOT NULL OR g.first > 1 THEN g.first_ticks END)) AS lost FROM o JOIN g ON g.m = o.m AND g.r IS NOT DISTINCT FROM o.r),
k AS (SELECT *, r IS NOT NULL AND phase <> 'freeze' AND NOT lost AND coalesce(elapsed >= 0, false) AS known FROM u)
SELECT id AS event_id, known, round(CASE WHEN known THEN elapsed END, 6) AS elapsed, round(CASE WHEN known AND phase = 'live' THEN greatest(0, 172800 - elapsed) END, 6) AS remaining,
  CASE WHEN known AND phase = 'post-plant' AND explosion >= 0 THEN explosion END AS to_explosion, CASE WHEN known THEN 'game-time-minus-rule-start' WHEN lost THEN 'unsupported-pause' ELSE 'not-applicable-or-unknown' END AS source,
  CASE WHEN lost THEN 'unverified-hard-pause-or-resume' WHEN tactical THEN 'tactical-timeout-flag' ELSE 'none' END AS pause FROM k""")
def t02_round_clocks(ev):
    out = rounds.round_clocks(_clock_rows(ev), fresh=21_600, ties=["event_id"])
    return out.select("event_id", "known", F.round("elapsed", 6).alias("elapsed"), F.round("remaining", 6).alias("remaining"), "to_explosion", "source", "pause")


@query("""\n, z AS (SELECT day, user_id % 7 AS r, t // 3600000000 AS tick, user_id AS member, CASE WHEN user_id % 2 = 0 THEN 'T' ELSE 'CT' END AS team, max(event_id) AS last_id FROM ev GROUP BY ALL),
l AS (SELECT z.*, e.kind, e.value FROM z JOIN ev e ON e.event_id = z.last_id),
n AS (SELECT day, r, tick, member, team, CASE WHEN kind = 'error' THEN false WHEN kind <> 'view' THEN true END AS alive, value > 10 AS position, value > 5 AS equipment FROM l),
f AS (SELECT DISTINCT day, r, tick FROM n), b AS (SELECT day, r, member, min(tick) AS first, any_value(team) AS team FROM n GROUP BY ALL),
d AS (SELECT day, user_id % 7 AS r, user_id AS member, min(t // 3600000000) AS died FROM p WHERE value > 60 GROUP BY ALL),
g AS (SELECT f.day, f.r, f.tick, b.member, b.team, n.position, n.equipment, n.member IS NOT NULL AS seen, CASE WHEN d.died <= f.tick THEN false WHEN n.alive IS NOT NULL THEN n.alive
    WHEN (SELECT arg_max(x.alive, x.tick) FROM n x WHERE x.day = f.day AND x.r = f.r AND x.member = b.member AND x.tick <= f.tick AND x.alive IS NOT NULL) = false THEN false END AS alive
  FROM f JOIN b ON b.day = f.day AND b.r = f.r AND b.first <= f.tick LEFT JOIN n ON n.day = f.day AND n.r = f.r AND n.tick = f.tick AND n.member = b.member LEFT JOIN d ON d.day = f.day AND d.r = f.r AND d.member = b.member),
h AS (SELECT day, r, tick, count(*) FILTER (team = 'T') AS t, count(*) FILTER (team = 'CT') AS ct, count(alive) AS life_known, count(*) FILTER (alive) AS alive, count(*) FILTER (alive AND position) AS position_known, count(*) FILTER (alive AND equipment) AS equipment_known, t = 5 AND ct = 5 AND NOT bool_or(member = 0) AS known FROM g GROUP BY ALL)
SELECT *, CASE WHEN NOT known OR life_known <> t + ct THEN 'unusable' WHEN position_known <> alive OR equipment_known <> alive THEN 'partial' ELSE 'usable' END AS quality FROM h""")
def t03_rosters(ev):
    keys = ["day", "r"]
    hour = F.floor(F.col("t") / HOUR).alias("tick")
    rows = ev.select("day", (F.col("user_id") % 7).alias("r"), hour, F.col("user_id").cast("string").alias("member"), F.when(F.col("user_id") % 2 == 0, "T").otherwise("CT").alias("team"), "event_id", "kind", "value")
    last = sequence.keep_one(rows, [*keys, "tick", "member"], ["event_id"], last=True)
    seen = last.select(*keys, "tick", "member", "team", F.when(F.col("kind") == "error", False).when(F.col("kind") != "view", True).alias("alive"), (F.col("value") > 10).alias("position"), (F.col("value") > 5).alias("equipment"))
    deaths = rows.filter("kind = 'purchase' AND value > 60").select(*keys, "tick", "member")
    return rounds.rosters(seen.select(*keys, "tick").distinct(), seen, deaths, keys).drop("reasons")


@query("\n, l AS (SELECT kind, lag(kind) OVER (PARTITION BY user_id ORDER BY t, event_id) AS b FROM ev) SELECT b || '->' || kind AS transition, count(*) AS rows FROM l WHERE b IS NOT NULL GROUP BY 1")
def a46_transition_matrix(ev):
    return evaluate.transition_matrix(ev, ["user_id"], ["t", "event_id"], "kind")


@query("\nSELECT event_id, user_id FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY kind = 'error', abs(t - 1705276800000000), t) = 1")
def o18_nearest_to(ev):
    return select.nearest_to(ev, ["user_id"], "t", F.lit(1_705_276_800_000_000), F.col("kind") == "error").select("event_id", "user_id")


@query("""\n, q AS (SELECT DISTINCT user_id, 14 + user_id % 3 AS quota FROM ev), h AS (SELECT user_id, count(*) AS have FROM p GROUP BY 1)
SELECT user_id, quota, coalesce(have, 0) AS have, greatest(0, quota - coalesce(have, 0)) AS missing FROM q LEFT JOIN h USING (user_id)""")
def o08_shortfall(ev):
    quotas = ev.select("user_id", (14 + F.col("user_id") % 3).alias("quota")).distinct()
    return select.shortfall(_of(ev, "purchase"), quotas, ["user_id"])


@query("\nSELECT user_id, day, count(DISTINCT kind) AS ids FROM ev GROUP BY ALL HAVING count(DISTINCT kind) > 1")
def j29_conflicts(ev):
    return relations.conflicts(ev, ["user_id", "day"], "kind")


@query("\n, m AS (SELECT user_id, avg(value) AS m FROM ev GROUP BY 1) SELECT round(sum(m) / 10, 6) AS loss FROM m")
def a48_weighted_loss(ev):
    return evaluate.weighted_loss(ev.withColumn("w", F.lit(1.0)), "user_id", "value", "w", 10.0).select(F.round("loss", 6).alias("loss"))


@query("\nSELECT user_id, day, max(CASE WHEN event_id % 2 = 0 THEN user_id % 9 + day END) AS boundary FROM ev GROUP BY user_id, day")
def u03_only_value(ev):
    """Half of the rows know the boundary of their user and day; those that do agree."""
    known = ev.withColumn("boundary", F.when(F.col("event_id") % 2 == 0, F.col("user_id") % 9 + F.col("day")))
    return known.groupBy("user_id", "day").agg(relations.only_value(F.col("boundary")).alias("boundary"))


@query("\nSELECT DISTINCT user_id FROM c WHERE user_id NOT IN (SELECT user_id FROM ev WHERE kind = 'purchase' AND value > 60)")
def j20_semi_and_anti(ev):
    large = _of(ev, "purchase").filter("value > 60").select("user_id").distinct()
    return ev.select("user_id").distinct().join(_of(ev, "click").select("user_id"), "user_id", "left_semi").join(large, "user_id", "left_anti")


@query("\nSELECT user_id, count(*) AS clicks, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY t, event_id) AS ids FROM c GROUP BY user_id")
def j18_group_lookup(ev):
    rows = F.sort_array(F.collect_list(F.struct("t", "event_id")))
    grouped = _clicks(ev).groupBy("user_id").agg(rows.alias("r"))
    return grouped.select("user_id", F.size("r").cast("long").alias("clicks"), F.array_join(F.transform("r", lambda x: x["event_id"].cast("string")), ",").alias("ids"))


@query("""\n, z AS (SELECT user_id, day, CASE WHEN kind = 'error' THEN 'error' ELSE 'fine' END AS state FROM ev)
SELECT day, state, count(*) AS rows FROM z GROUP BY GROUPING SETS ((day, state), (state), ())""")
def a19_build_report(ev):
    state = F.when(F.col("kind") == "error", "error").otherwise("fine").alias("state")
    return ev.select("day", state).groupingSets([["day", "state"], ["state"], []], "day", "state").agg(F.count(F.lit(1)).alias("rows"))
