"""Queries of the facts of frames on vectors, with their SQL.

Ten vectors stand for a frame's members: two components for the place, two for the heading, two for the way that a member
came; the frame's number says what the bomb does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import situation

QUERIES, SQL = {}, {}
SITES = {"A": (0.4, 0.4), "B": (0.7, 0.6)}

M = """WITH m AS (SELECT vec_id // 10 AS frame, CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id % 2 = 0 THEN 'T' ELSE 'CT' END AS team, embedding[1]::DOUBLE * 2 + 0.5 AS x, embedding[2]::DOUBLE * 2 + 0.5 AS y, 'r' || label % 4 AS region,
  embedding[3]::DOUBLE * 5 AS hx, embedding[4]::DOUBLE * 5 AS hy, CASE WHEN label % 5 > 0 OR vec_id % 40 < 20 THEN embedding[1]::DOUBLE * 2 + 0.5 + embedding[5]::DOUBLE END AS px, embedding[2]::DOUBLE * 2 + 0.5 + embedding[6]::DOUBLE AS py, label
  FROM embeddings WHERE label <> 9),
f AS (SELECT frame, CASE WHEN frame % 11 = 5 THEN 'ended' ELSE 'live' END AS phase, (['carried', 'planted', 'defusing', 'unknown', 'dropped', 'planted'])[CAST(frame % 6 AS INT) + 1] AS bomb,
  CASE frame % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE CASE WHEN frame % 5 > 0 THEN 'A' END END AS site, count(*) FILTER (team = 'T') + CASE WHEN frame % 13 = 4 THEN 1 ELSE 0 END AS t_alive, count(*) FILTER (team = 'CT') AS ct_alive,
  count(*) FILTER (team = 'T') AS t_n, count(*) FILTER (team = 'CT') AS ct_n, sum(label * 10) FILTER (team = 'T') AS t_health, sum(label * 10) FILTER (team = 'CT') AS ct_health FROM m GROUP BY frame),
-- contact
p AS (SELECT a.frame, a.id AS t, b.id AS ct, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS d, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, a.region = b.region AS same,
  (a.hx * (b.x - a.x) + a.hy * (b.y - a.y)) / sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) + 5e-7 >= 0.5 OR (b.hx * (a.x - b.x) + b.hy * (a.y - b.y)) / sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) + 5e-7 >= 0.5 AS faces,
  CASE WHEN a.px IS NOT NULL AND b.px IS NOT NULL THEN round(sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)), 6) END AS then_ FROM m a JOIN m b ON a.frame = b.frame AND a.team = 'T' AND b.team = 'CT'),
n AS (SELECT *, round(then_ - d, 6) AS closing FROM p JOIN f USING (frame) WHERE t_alive = t_n AND ct_alive = ct_n QUALIFY row_number() OVER (PARTITION BY frame ORDER BY d, t, ct) = 1),
cu AS (SELECT *, same::INT + faces::INT + coalesce(closing >= 0.03 - 5e-7, false)::INT AS cues FROM n),
co AS (SELECT f.frame, CASE WHEN f.t_alive = 0 OR f.ct_alive = 0 THEN 'low' WHEN d IS NULL THEN 'unknown' WHEN d <= 0.06 + 5e-7 OR (d <= 0.12 + 5e-7 AND cues >= 2) THEN 'high' WHEN d <= 0.12 + 5e-7 OR (d <= 0.20 + 5e-7 AND cues >= 1) THEN 'medium' ELSE 'low' END AS contact,
  d AS distance, cues, closing, ax, ay, bx, by_ FROM f LEFT JOIN cu USING (frame)),
-- pressure
g(site, sx, sy) AS (VALUES ('A', 0.4, 0.4), ('B', 0.7, 0.6)),
ac AS (SELECT *, CASE WHEN phase = 'ended' THEN NULL WHEN bomb IN ('carried', 'dropped') THEN 'T' WHEN bomb IN ('planted', 'defusing') AND site IS NOT NULL THEN 'CT' END AS side FROM f),
w AS (SELECT ac.frame, ac.side, g.site, round(sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)), 6) AS d, CASE WHEN px IS NOT NULL THEN round(round(sqrt((px - sx) * (px - sx) + (py - sy) * (py - sy)), 6) - round(sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)), 6), 6) END AS way
  FROM ac JOIN m ON m.frame = ac.frame AND m.team = ac.side JOIN g ON ac.side = 'T' OR g.site = ac.site WHERE CASE ac.side WHEN 'T' THEN t_alive = t_n ELSE ct_alive = ct_n END),
q AS (SELECT frame, side, site, count(*) FILTER (d <= 0.16 + 5e-7) AS near, count(*) FILTER (way >= 0.04 - 5e-7) AS coming, round(coalesce(sum(way) FILTER (way >= 0.04 - 5e-7), 0), 6) AS way, round(avg(d), 6) AS mean, count(*) = count(way) AS complete FROM w GROUP BY ALL),
z AS (SELECT *, near >= 2 OR coming >= 2 AS fits, row_number() OVER (PARTITION BY frame, near >= 2 OR coming >= 2 ORDER BY near DESC, coming DESC, way DESC, mean, site) AS rank FROM q),
y AS (SELECT frame, bool_or(fits) AS any_fits, bool_and(complete) AS complete, bool_or(NOT fits AND NOT complete) AS short, max(side || '-' || site) FILTER (fits AND rank = 1) AS best, max(side) AS side FROM z GROUP BY frame),
pr AS (SELECT ac.frame, CASE WHEN phase = 'ended' THEN 'none' WHEN y.frame IS NULL THEN 'unknown' WHEN any_fits AND NOT short THEN best WHEN NOT any_fits AND complete THEN 'none' ELSE 'unknown' END AS pressure FROM ac LEFT JOIN y USING (frame)),
-- isolation and advantage
nb AS (SELECT a.frame, a.team, a.id, min(round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6)) FILTER (a.team = b.team) AS ally, min(round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6)) FILTER (a.team <> b.team) AS enemy
  FROM m a JOIN m b ON a.frame = b.frame AND a.id <> b.id GROUP BY ALL),
i AS (SELECT frame, bool_or(team = 'T' AND (ally IS NULL OR (ally >= 0.18 - 5e-7 AND ally - enemy >= 0.04 - 5e-7))) AS t, bool_or(team = 'CT' AND (ally IS NULL OR (ally >= 0.18 - 5e-7 AND ally - enemy >= 0.04 - 5e-7))) AS ct FROM nb GROUP BY frame),
iso AS (SELECT frame, CASE WHEN NOT (t_alive = t_n AND ct_alive = ct_n) THEN 'unknown' WHEN t_n = 0 OR ct_n = 0 THEN 'none' WHEN t AND ct THEN 'both' WHEN t THEN 'T' WHEN ct THEN 'CT' ELSE 'none' END AS isolated FROM f LEFT JOIN i USING (frame)),
l AS (SELECT co.frame, count(*) FILTER (team = 'T' AND round(sqrt((x - (ax + bx) / 2) * (x - (ax + bx) / 2) + (y - (ay + by_) / 2) * (y - (ay + by_) / 2)), 6) <= 0.14 + 5e-7) - count(*) FILTER (team = 'CT' AND round(sqrt((x - (ax + bx) / 2) * (x - (ax + bx) / 2) + (y - (ay + by_) / 2) * (y - (ay + by_) / 2)), 6) <= 0.14 + 5e-7) AS n
  FROM co JOIN m ON m.frame = co.frame WHERE distance IS NOT NULL GROUP BY co.frame),
c6 AS (SELECT f.frame, greatest(least(t_alive - ct_alive, 2), -2)::DOUBLE AS alive, CASE WHEN t_health IS NOT NULL AND ct_health IS NOT NULL THEN round(greatest(least((t_health - ct_health) / 100 * 0.35, 1.0), -1.0), 6) END AS health, CASE WHEN l.n IS NOT NULL THEN greatest(least(l.n * 0.5, 1.0), -1.0) END AS local,
  CASE WHEN pressure = 'unknown' THEN NULL WHEN pressure LIKE 'T-%' THEN 0.5 WHEN pressure LIKE 'CT-%' THEN -0.5 ELSE 0 END AS pressure, CASE bomb WHEN 'unknown' THEN NULL WHEN 'planted' THEN 0.75 WHEN 'defusing' THEN -0.75 ELSE 0 END AS bomb, CASE isolated WHEN 'unknown' THEN NULL WHEN 'T' THEN -0.5 WHEN 'CT' THEN 0.5 ELSE 0 END AS isolation
  FROM f JOIN pr USING (frame) JOIN iso USING (frame) LEFT JOIN l USING (frame)),
sc AS (SELECT frame, round(coalesce(alive, 0) + coalesce(health, 0) + coalesce(local, 0) + coalesce(pressure, 0) + coalesce(bomb, 0) + coalesce(isolation, 0), 6) AS score,
  (alive IS NOT NULL)::INT + (health IS NOT NULL)::INT + (local IS NOT NULL)::INT + (pressure IS NOT NULL)::INT + (bomb IS NOT NULL)::INT + (isolation IS NOT NULL)::INT AS known FROM c6)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(frames(spark, sf_dir))
        if sql:
            SQL[f.__name__] = M + sql
        return f

    return add


def frames(spark, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("label <> 9")
    e = lambda k: F.col("embedding")[k].cast("double")
    x, y = e(0) * 2 + 0.5, e(1) * 2 + 0.5
    point = F.struct(F.lit(904).cast("long").alias("tick"), (x + e(4)).alias("x"), (y + e(5)).alias("y"))
    late = F.struct(F.lit(968).cast("long").alias("tick"), y.alias("x"), x.alias("y"))  # too new to count
    points = F.when((F.col("label") % 5 > 0) | (F.col("vec_id") % 40 < 20), F.array(late, point)).otherwise(F.array(late))
    m = v.select(
        F.floor(F.col("vec_id") / 10).alias("frame"), F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 2 == 0, "T").otherwise("CT").alias("team"), x.alias("x"), y.alias("y"), F.concat(F.lit("r"), (F.col("label") % 4).cast("string")).alias("region"),
        (e(2) * 5).alias("hx"), (e(3) * 5).alias("hy"), points.alias("points"), F.col("label"),
    )
    of = lambda t: F.col("team") == t
    n = F.col("frame")
    bomb = F.array(*map(F.lit, ("carried", "planted", "defusing", "unknown", "dropped", "planted")))
    f = m.groupBy("frame").agg(
        F.count_if(of("T")).alias("t_alive"), F.count_if(of("CT")).alias("ct_alive"), F.sum(F.when(of("T"), F.col("label") * 10)).alias("t_health"), F.sum(F.when(of("CT"), F.col("label") * 10)).alias("ct_health"),
    ).withColumns({
        "t_alive": F.col("t_alive") + F.when(n % 13 == 4, 1).otherwise(0), "phase": F.when(n % 11 == 5, "ended").otherwise("live"), "bomb": F.get(bomb, (n % 6).cast("int")),
        "site": F.when(n % 3 == 0, "A").when(n % 3 == 1, "B").when(n % 5 > 0, "A"), "tick": F.lit(1000).cast("long"), "tick_rate": F.lit(64), "quality": F.array().cast("array<struct<code:string,severity:string>>"),
    })
    return situation.scenes(f, m, ["frame"])


@query("SELECT frame, pressure FROM pr")
def g03_site_pressure(f):
    return situation.with_pressure(f, SITES).select("frame", "pressure")


@query("SELECT frame, contact, distance, CAST(cues AS INTEGER) AS cues, closing FROM co")
def g04_contact_risk(f):
    out = situation.with_contact(f)
    closing = F.get(F.transform(F.filter("contact_margins", lambda m: m["metric"] == "closing-delta"), lambda m: m["value"]), 0)
    return out.select("frame", "contact", F.col("contact_pair.distance").alias("distance"), F.col("contact_pair.cues").alias("cues"), closing.alias("closing"))


@query("""SELECT frame, CASE WHEN known < 4 THEN 'uncertain' WHEN score >= 1 - 5e-7 THEN 'T' WHEN score <= -1 + 5e-7 THEN 'CT' WHEN abs(score) <= 0.35 + 5e-7 THEN 'even' ELSE 'uncertain' END AS advantage, score, CAST(known AS INTEGER) AS known FROM sc""")
def g06_advantage(f):
    return situation.analysed(f, SITES).select("frame", "advantage", "score", F.size("components").alias("known"))


@query("""SELECT frame, 'contact-risk' AS rule, metric, round(value, 6) AS value, round(margin, 6) AS margin FROM (
  SELECT frame, unnest(['high-distance', 'medium-distance', 'cue-distance']) AS metric, distance AS value, distance - unnest([0.06, 0.12, 0.20]) AS margin FROM co WHERE distance IS NOT NULL UNION ALL SELECT frame, 'closing-delta', closing, closing - 0.03 FROM co WHERE closing IS NOT NULL)
UNION ALL SELECT frame, 'spatial-advantage', metric, round(abs(score), 6), round(abs(score) - t, 6) FROM sc, (VALUES ('decisive-score', 1.0), ('even-score', 0.35)) v(metric, t)
UNION ALL SELECT frame, 'pressure.' || lower(side) || '.' || lower(site), metric, n, n - 2 FROM (SELECT *, unnest(['near-count', 'approaching-count']) AS metric, unnest([near, coming])::DOUBLE AS n FROM q)""")
def g08_margins(f):
    rows = situation.margin_rows(situation.analysed(f, SITES), ["frame"])
    fits = F.col("rule").isin("contact-risk", "spatial-advantage") | F.col("metric").isin("near-count", "approaching-count")
    return rows.filter(fits & (F.col("decision") != "configured-radius")).select("frame", "rule", "metric", "value", "margin")


@query()
def g07_confidence(f):
    return situation.analysed(f, SITES).select("frame", "confidence", "unknowns", F.array_join("contested", ",").alias("contested"), "t_formation", "ct_formation", "isolated")
