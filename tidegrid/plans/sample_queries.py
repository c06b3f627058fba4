"""Queries of the sample operators on vectors, documents and events, with their SQL.

Ten vectors stand for a frame's members: the label for what they carry and did, components for places and health.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import evaluate, relations, samples, spatial
from tidegrid.plans import table_queries, timeline_queries

QUERIES, SQL = {}, {}
MB = """WITH m AS (SELECT vec_id // 10 AS frame, vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 't' ELSE 'ct' END AS team, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label,
CAST(round(embedding[3]::DOUBLE * 1000) AS INT) AS health, label > 2 AS alive, label % 3 > 0 AS known FROM embeddings)"""


def query(load, prefix: str, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(load(spark, sf_dir))
        if sql:
            SQL[f.__name__] = prefix + sql
        return f

    return add


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("int")
    item = lambda c, n: F.struct(c.alias("category"), n.cast("int").alias("count"))
    items = F.array(item(F.lit("grenade"), label), item(F.lit("rifle"), F.lit(1)), item(F.when(label > 5, "sniper").otherwise("grenade"), F.lit(2)))
    gear = F.struct(
        (label * 100).alias("money"), (label * 10).alias("armor"), (label % 2 == 0).alias("helmet"), (label % 5 == 0).alias("defuser"), (label * 1000).alias("value"), items.alias("items"),
    )
    return v.select(
        F.floor(F.col("vec_id") / 10).alias("frame"), F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 2 == 0, "T").otherwise("CT").alias("team"), F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"), label.alias("label"), F.round(F.col("embedding")[2].cast("double") * 1000).cast("int").alias("health"), (label > 2).alias("alive"),
        label.alias("kills"), (9 - label).alias("deaths"), F.when(label % 3 > 0, gear).alias("equipment"),
    )


_SUMS = {
    "alive": "count(*) FILTER (alive)", "health": "sum(greatest(health, 0))", "kills": "sum(label)", "deaths": "sum(9 - label)", "known": "count(*) FILTER (known)", "money": "sum(label * 100) FILTER (known)",
    "armor": "sum(label * 10) FILTER (known)", "helmets": "count(*) FILTER (known AND label % 2 = 0)", "defusers": "count(*) FILTER (known AND label % 5 = 0)", "value": "sum(label * 1000) FILTER (known)",
    "grenades": "sum(label + CASE WHEN label > 5 THEN 0 ELSE 2 END) FILTER (known)", "rifles": "count(*) FILTER (known)", "snipers": "sum(CASE WHEN label > 5 THEN 2 ELSE 0 END) FILTER (known)", "members": "count(*)",
}
_BY_TEAM = ", g AS (SELECT frame, team, " + ", ".join(f"{v} AS {k}" for k, v in _SUMS.items()) + " FROM m GROUP BY ALL), s AS (SELECT frame, " + ", ".join(
    f"CAST(coalesce(max({k}) FILTER (team = '{t}'), 0) AS BIGINT) AS {t}_{k}" for t in ("t", "ct") for k in _SUMS) + " FROM g GROUP BY frame)"


@query(members, MB, _BY_TEAM + " SELECT * FROM s")
def a02_team_summaries(m):
    return samples.team_summaries(m, ["frame"])


@query(members, MB, _BY_TEAM + " SELECT frame, " + ", ".join(f"t_{k} - ct_{k} AS {k}_difference" for k in ("value", "money", "armor", "helmets", "defusers", "grenades", "rifles", "snipers", "health", "alive")) + """,
  t_alive + ct_alive AS total_alive, round(coalesce(t_health / nullif(t_alive, 0)::DOUBLE, 0), 6) AS t_mean_health, round(coalesce(ct_health / nullif(ct_alive, 0)::DOUBLE, 0), 6) AS ct_mean_health, t_alive = 1 OR ct_alive = 1 AS clutch,
  round(coalesce(t_known / nullif(t_members, 0)::DOUBLE, 0), 6) AS t_coverage, round(coalesce(ct_known / nullif(ct_members, 0)::DOUBLE, 0), 6) AS ct_coverage,
  round(coalesce(t_known / nullif(t_members, 0)::DOUBLE, 0) - coalesce(ct_known / nullif(ct_members, 0)::DOUBLE, 0), 6) AS coverage_difference FROM s""")
def a09_baseline(m):
    out = samples.baseline(samples.team_summaries(m, ["frame"]), ["frame"])
    return table_queries._r(out, "t_mean_health", "ct_mean_health", "t_coverage", "ct_coverage", "coverage_difference")


@query(members, MB, """, d AS (SELECT frame, team, sqrt((x - 0.1) * (x - 0.1) + y * y) AS a, sqrt(x * x + (y + 0.2) * (y + 0.2)) AS b FROM m),
g AS (SELECT frame, avg(a) FILTER (team = 't') AS ta, avg(b) FILTER (team = 't') AS tb, avg(a) FILTER (team = 'ct') AS ca, avg(b) FILTER (team = 'ct') AS cb, min(a) FILTER (team = 't') AS la, min(b) FILTER (team = 't') AS lb FROM d GROUP BY frame)
SELECT frame, round(ta, 6) AS t_mean_a, round(tb, 6) AS t_mean_b, round(least(la, lb), 6) AS t_closest, round(ca - ta, 6) AS a_difference, round(cb - tb, 6) AS b_difference FROM g""")
def a06_site_distances(m):
    out = samples.site_distances(spatial.teams(m, ["frame"]), ["frame"], {"a": (0.1, 0.0), "b": (0.0, -0.2)})
    return table_queries._r(out, "t_mean_a", "t_mean_b", "t_closest", "a_difference", "b_difference").select("frame", "t_mean_a", "t_mean_b", "t_closest", "a_difference", "b_difference")


@query(members, MB, """ SELECT id, (['rifle', 'sniper', 'knife', 'objective', 'pistol', 'smg', 'shotgun', 'heavy', 'unknown', 'grenade'])[label + 1] AS weapon, (['A Site', 'B Site', 'T Spawn', 'CT Spawn', 'unknown', 'Mid', 'Mid', 'Mid', 'Mid', 'unknown'])[label + 1] AS region FROM m""")
def p04_p05_names(m):
    pick = lambda *names: F.array(*map(F.lit, names))[F.col("label")]
    weapon = pick("weapon_ak47", "weapon_awp", "weapon_knife_t", "weapon_c4", "weapon_glock", "weapon_mp9", "weapon_nova", "weapon_negev", " ", "weapon_flashbang")
    place = pick("BombsiteA", " BombsiteB ", "TSpawn", "CTSpawn", "  ", "Mid", "Mid ", " Mid", "Mid", None)
    return m.select("id", samples.weapon_class(weapon, F.coalesce(weapon == "weapon_flashbang", F.lit(False))).alias("weapon"), samples.region(place).alias("region"))


@query(members, MB, """ SELECT frame, coalesce(arg_min('r' || label, x * x + y * y) FILTER (label > 1), 'unknown') AS region FROM m GROUP BY frame""")
def j24_nearest_region(m):
    place = F.when(F.col("label") > 1, F.concat(F.lit("r"), F.col("label").cast("string"))).otherwise(F.when(F.col("label") == 1, "unknown"))
    points = m.select("frame").distinct().withColumn("x", F.lit(0.0)).withColumn("y", F.lit(0.0))
    return samples.nearest_region(m.select("frame", "x", "y", place.alias("region")), points, ["frame"]).select("frame", "region")


@query(members, MB, """, v AS (SELECT *, sqrt(2 * y * y) * 10 AS speed, x + y * 0.5 AS ex, y + y * 0.5 AS ey FROM m)
SELECT id, CASE WHEN speed <= 3 AND speed * 0.5 <= 1.2 AND ex BETWEEN 0 AND 1 AND ey BETWEEN 0 AND 1 THEN round(ex, 6) END AS x, CASE WHEN speed <= 3 AND speed * 0.5 <= 1.2 AND ex BETWEEN 0 AND 1 AND ey BETWEEN 0 AND 1 THEN round(ey, 6) END AS y FROM v""")
def t28_projected(m):
    end = samples.projected(F.col("x"), F.col("y"), F.col("y"), F.col("y"), 0.5, 10.0, 3.0, 1.2)
    return m.select("id", end.alias("e")).select("id", F.round("e.x", 6).alias("x"), F.round("e.y", 6).alias("y"))


@query(members, MB, """, a AS (SELECT frame, list(id) FILTER (alive) AS alive, list(id) FILTER (known OR NOT alive) AS known FROM m GROUP BY frame) SELECT frame, coalesce(list_has_all(coalesce(known, []), coalesce(alive, [])), true) AS known FROM a""")
def j21_subset(m):
    sets = m.groupBy("frame").agg(F.collect_list(F.when(F.col("alive"), F.col("id"))).alias("a"), F.collect_list(F.when(F.col("equipment").isNotNull() | ~F.col("alive"), F.col("id"))).alias("k"))
    return sets.select("frame", relations.subset(F.col("a"), F.col("k")).alias("known"))


_EV = timeline_queries.EV


@query(timeline_queries.events, _EV, """, z AS (SELECT event_id, CASE kind WHEN 'view' THEN 'live' WHEN 'error' THEN 'post-plant' WHEN 'click' THEN 'freeze' END AS phase, CAST(event_id % 7 AS INT) AS t, CAST(day % 6 AS INT) AS ct, value AS b, CASE WHEN event_id % 4 > 0 THEN CAST(event_id % 4 - 1 AS INT) END AS kits FROM ev)
SELECT event_id, CASE phase WHEN 'post-plant' THEN t - ct WHEN 'live' THEN 0 END::DOUBLE AS phase_alive, CASE WHEN kits > 0 THEN b WHEN kits <= 0 THEN b * 0 END AS bomb_kit,
  CAST(coalesce(phase IN ('live', 'post-plant') AND t BETWEEN 1 AND 5 AND ct BETWEEN 1 AND 5 AND t + ct <= 7, false) AS DOUBLE) AS endgame FROM z""")
def p19_p20_interactions(ev):
    phase = F.when(F.col("kind") == "view", "live").when(F.col("kind") == "error", "post-plant").when(F.col("kind") == "click", "freeze")
    kits = F.when(F.col("event_id") % 4 > 0, (F.col("event_id") % 4 - 1).cast("int"))
    return ev.select("event_id", *(c.alias(n) for n, c in samples.interactions(phase, (F.col("event_id") % 7).cast("int"), (F.col("day") % 6).cast("int"), F.col("value"), kits).items()))


@query(timeline_queries.events, _EV, """ SELECT event_id, CASE WHEN value > 60 THEN 'warmup' WHEN value > 50 THEN 'team-intro' WHEN value > 40 THEN 'ended' WHEN kind IN ('view', 'error') THEN 'post-plant' WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 'freeze' ELSE 'live' END AS phase FROM ev""")
def p08_round_phase(ev):
    v, bomb = F.col("value"), F.when(F.col("kind") == "view", "planted").when(F.col("kind") == "error", "defusing")
    return ev.select("event_id", samples.round_phase(v > 60, v > 50, v > 40, bomb, F.col("event_id") % 3 == 0, F.col("event_id") % 5 != 0).alias("phase"))


@query(timeline_queries.events, _EV, """ SELECT user_id, kind AS value, count(*) AS rows FROM ev GROUP BY ALL""")
def a38_value_counts(ev):
    return evaluate.value_counts(ev, ["user_id"], "kind")


@query(timeline_queries.events, _EV, """ SELECT kind, count(*) AS rows, count(*) FILTER (value > 20) AS large FROM ev GROUP BY kind""")
def a33_merged_counts(ev):
    part = lambda d: d.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value") > 20).alias("large"))
    return evaluate.merged_counts([part(ev.filter("user_id % 2 = 0")), part(ev.filter("user_id % 2 = 1"))], ["kind"], ["rows", "large"])


@query(timeline_queries.events, _EV, """ SELECT user_id, day, string_agg(DISTINCT kind, ',' ORDER BY kind) AS splits FROM ev GROUP BY ALL HAVING count(DISTINCT kind) > 1""")
def u05_in_several(ev):
    return relations.in_several(ev, "kind", ["user_id", "day"]).withColumn("splits", F.array_join("splits", ","))


_PR = table_queries.PR


@query(table_queries.predictions, _PR, """, b AS (SELECT lang, """ + " + ".join(f"CAST(p >= {k * 0.1!r}::DOUBLE AS INT)" for k in range(1, 10)) + """ AS bin, sum(w) AS w, sum(w * p) / sum(w) AS mean, sum(w * y) / sum(w) AS observed FROM e WHERE p IS NOT NULL GROUP BY ALL)
SELECT lang, round(sum(w * abs(mean - observed)) / sum(w), 6) AS ece FROM b GROUP BY lang""")
def a51_edge_calibration_error(e):
    return table_queries._r(evaluate.edge_calibration_error(e, ["lang"]), "ece")


_X = "round(sum(w * y) / sum(w), 6) AS positive_rate, " + table_queries._M.partition("AS weight_coverage,")[2]


@query(table_queries.predictions, _PR, f""" SELECT source, NULL AS lang, 'fold' AS level, count(*) AS rows, {_X} FROM e GROUP BY source UNION ALL SELECT NULL, lang, 'phase', count(*), {_X} FROM e GROUP BY lang UNION ALL SELECT NULL, NULL, 'all', count(*), {_X} FROM e""")
def a52_fold_report(e):
    return table_queries._r(evaluate.fold_report(e, "source", "lang"), "positive_rate", "log_loss", "brier", "accuracy")


@query(table_queries.predictions, _PR, """, g AS (SELECT source, sum(w * y) AS y, sum(w) AS w FROM e GROUP BY source) SELECT source, round(((SELECT sum(y) FROM g) - y) / ((SELECT sum(w) FROM g) - w), 6) AS prior FROM g""")
def a44_prior(e):
    return table_queries._r(evaluate.prior_without(e, "source"), "prior")
