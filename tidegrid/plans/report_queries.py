"""Queries of whole reports on labelled documents and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import reports
from tidegrid.plans import table_queries
from tidegrid.plans.timeline_queries import EV, HOUR, events

QUERIES, SQL = {}, {}
MODELS = ["p", "q"]


def _scored(spark, sf_dir: str) -> DataFrame:
    """Two functions of the length stand for two models."""
    return table_queries.predictions(spark, sf_dir).withColumn("q", F.round(F.col("n_chars") / (F.col("n_chars") + 3000.0), 2))


def a29_evaluation(spark, sf_dir: str) -> DataFrame:
    slices = {"short": F.col("n_chars") < 1000, "even": F.col("doc_id") % 2 == 0}
    out = reports.evaluation(_scored(spark, sf_dir), MODELS, slices, "source")
    return out.withColumns({c: F.round(c, 9) for c in ("weight_coverage", "log_loss", "brier", "accuracy", "auc", "ece")})


QUERIES["a29_evaluation"] = a29_evaluation
SQL["a29_evaluation"] = table_queries.PR + """, o AS (SELECT doc_id, source, n_chars, y, w, unnest(['p', 'q']) AS model, unnest([p, round(n_chars / (n_chars + 3000.0), 2)::DOUBLE]) AS p FROM e),
x AS (SELECT model, 'all' AS part, NULL::VARCHAR AS slice, NULL::VARCHAR AS match, p, y, w FROM o UNION ALL SELECT model, 'match', NULL, source, p, y, w FROM o
  UNION ALL SELECT model, 'slice', 'short', NULL, p, y, w FROM o WHERE n_chars < 1000 UNION ALL SELECT model, 'slice', 'even', NULL, p, y, w FROM o WHERE doc_id % 2 = 0),
c AS (SELECT *, greatest(least(p, 1 - 1e-6), 1e-6) AS c FROM x),
m AS (SELECT model, part, slice, match, count(*) AS rows, count(p) / count(*) AS row_coverage, round(sum(w) FILTER (p IS NOT NULL) / sum(w), 9) AS weight_coverage, round(sum(w * -CASE WHEN y = 1 THEN ln(c) ELSE ln(1 - c) END) FILTER (p IS NOT NULL) / sum(w) FILTER (p IS NOT NULL), 9) AS log_loss,
  round(sum(w * (p - y) * (p - y)) / sum(w) FILTER (p IS NOT NULL), 9) AS brier, round(sum(w * ((p >= 0.5)::INT = y)::INT) FILTER (p IS NOT NULL) / sum(w) FILTER (p IS NOT NULL), 9) AS accuracy FROM c GROUP BY ALL),
b AS (SELECT model, part, slice, match, least(floor(c * 10), 9) AS bin, sum(w) AS w, sum(w * c) / sum(w) AS mean, sum(w * y) / sum(w) AS seen FROM c WHERE p IS NOT NULL GROUP BY ALL),
g AS (SELECT model, part, slice, match, sum(w * abs(mean - seen)) / sum(w) AS ece FROM b GROUP BY ALL),
s AS (SELECT model, part, slice, match, p, sum(w) FILTER (y = 1) AS pos, sum(w) FILTER (y = 0) AS neg FROM x WHERE p IS NOT NULL GROUP BY ALL),
t AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model, part, slice, match ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s),
a AS (SELECT model, part, slice, match, CASE WHEN sum(pos) * sum(neg) > 0 THEN sum(coalesce(pos, 0) * (below + coalesce(neg, 0) / 2)) / (sum(pos) * sum(neg)) END AS auc FROM t GROUP BY ALL)
SELECT m.*, round(a.auc, 9) AS auc, round(g.ece, 9) AS ece FROM m LEFT JOIN g ON g.model = m.model AND g.part = m.part AND g.slice IS NOT DISTINCT FROM m.slice AND g.match IS NOT DISTINCT FROM m.match
  LEFT JOIN a ON a.model = m.model AND a.part = m.part AND a.slice IS NOT DISTINCT FROM m.slice AND a.match IS NOT DISTINCT FROM m.match"""


def a30_coverage(spark, sf_dir: str) -> DataFrame:
    """A user's rows but for errors and clicks are what was kept of a match."""
    ev = events(spark, sf_dir)
    lost = F.col("kind").isin("error", "click")
    out = reports.coverage(ev.filter(~lost), ev.filter(lost), "user_id", "kind")
    return out.select("match", "retained", "rejected", "candidates", F.round("fraction", 9).alias("fraction"), F.try_element_at("reasons", F.lit("error")).alias("errors"))


QUERIES["a30_coverage"] = a30_coverage
SQL["a30_coverage"] = EV + """ SELECT CAST(user_id AS VARCHAR) AS match, count(*) FILTER (kind NOT IN ('error', 'click')) AS retained, count(*) FILTER (kind IN ('error', 'click')) AS rejected, count(*) AS candidates,
  round(count(*) FILTER (kind NOT IN ('error', 'click')) / count(*), 9) AS fraction, nullif(count(*) FILTER (kind = 'error'), 0) AS errors FROM ev GROUP BY GROUPING SETS ((user_id), ())"""


def j19_review(spark, sf_dir: str) -> DataFrame:
    """A user's day is a round, its events' hours the points; an event is compared from its hour to the next one."""
    ev = events(spark, sf_dir).withColumn("tick", F.floor(F.col("t") / HOUR)).withColumn("round_id", F.col("day").cast("string"))
    key = ["user_id", "round_id"]
    points = ev.groupBy(*key, "tick").agg(
        F.max("value").alias("p"), F.lit(0).alias("segment"), F.when(F.max(F.col("kind") == "view"), F.array(F.lit("event-after"))).otherwise(F.array(F.lit("regular"))).alias("triggers"),
        F.when(F.max("event_id") % 5 > 0, F.max("event_id") % 7 == 0).alias("missing"),
    )
    attempts = ev.groupBy(*key).agg(F.lit(0).alias("segment"), F.min("tick").alias("live_tick"), (F.max("tick")).alias("end_tick"), F.when(F.min("event_id") % 4 > 0, "completed").otherwise("void").alias("disposition"))
    kind = F.when(F.col("kind") == "error", "bomb-exploded").otherwise("kill")
    groups = ev.select(*key, "event_id", F.when(F.col("kind") != "signup", F.col("tick")).alias("before_tick"), (F.col("tick") + F.col("event_id") % 3).alias("after_tick"), F.array(kind).alias("events"))
    out = reports.review(groups, points, attempts, ["user_id"])
    return out.select("event_id", "status", F.round("change", 6).alias("change"))


QUERIES["j19_review"] = j19_review
SQL["j19_review"] = EV + """, x AS (SELECT *, t // 3600000000 AS tick FROM ev),
q AS (SELECT user_id, day, tick, max(value) AS v, bool_or(kind = 'view') AS after, CASE WHEN max(event_id) % 5 > 0 THEN max(event_id) % 7 = 0 END AS missing FROM x GROUP BY ALL),
a AS (SELECT user_id, day, min(tick) AS live, max(tick) AS last_tick, min(event_id) % 4 > 0 AS completed FROM x GROUP BY ALL),
k AS (SELECT q.* FROM q JOIN a USING (user_id, day) WHERE completed AND tick >= live AND tick < last_tick),
g AS (SELECT x.event_id, x.kind, a.completed, a.last_tick, x.tick + x.event_id % 3 AS after_tick, b.v AS b, b.missing AS bm, b.tick AS bt, f.v AS f, f.missing AS fm, f.tick AS ft FROM x JOIN a USING (user_id, day)
  LEFT JOIN k b ON b.user_id = x.user_id AND b.day = x.day AND b.tick = x.tick AND x.kind <> 'signup' LEFT JOIN k f ON f.user_id = x.user_id AND f.day = x.day AND f.tick = x.tick + x.event_id % 3 AND f.after),
st AS (SELECT *, CASE WHEN NOT completed THEN 'round-unavailable' WHEN after_tick >= last_tick OR kind = 'error' THEN 'round-ended' WHEN bt IS NULL THEN 'before-missing' WHEN ft IS NULL THEN 'after-unconfirmed'
  WHEN bm IS NULL OR fm IS NULL THEN 'quality-unknown' WHEN bm OR fm THEN 'data-incomplete' ELSE 'ready' END AS status FROM g)
SELECT event_id, status, round(CASE WHEN status = 'ready' THEN (f - b) * 100 END, 6) AS change FROM st"""
