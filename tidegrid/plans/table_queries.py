"""Queries of the frame, evaluation, selection and scalar operators, with their SQL.

Ten vectors stand for a frame's members, the parity of their id for the side; labelled documents stand for predictions:
the label is the outcome, a function of the length the prediction, the source a match and the language a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import scalar
from tidegrid.operators import evaluate, facts, select, spatial

QUERIES, SQL = {}, {}
FR = """WITH m AS (SELECT vec_id // 10 AS frame, vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 'T' ELSE 'CT' END AS team, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings),
d AS (SELECT a.frame, a.id, a.team, b.id AS id2, b.team AS team2, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM m a JOIN m b ON a.frame = b.frame AND a.id <> b.id)"""
PR = """WITH e AS (SELECT d.doc_id, source, lang, n_chars, l.quality AS y, CASE WHEN d.doc_id % 11 > 0 THEN round(n_chars / (n_chars + 1000.0), 2)::DOUBLE END AS p, 1.0::DOUBLE / count(*) OVER (PARTITION BY source, lang) AS w
FROM documents d JOIN labels l USING (doc_id))"""


def query(load, prefix: str, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(load(spark, sf_dir))
        if sql:
            SQL[f.__name__] = prefix + sql
        return f

    return add


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    team = F.when(F.col("vec_id") % 2 == 0, "T").otherwise("CT")
    return v.select(F.floor(F.col("vec_id") / 10).alias("frame"), F.col("vec_id").alias("id"), team.alias("team"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars")
    rows = d.join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("y")), "doc_id")
    p = F.when(F.col("doc_id") % 11 > 0, F.round(F.col("n_chars") / (F.col("n_chars") + 1000.0), 2))
    return evaluate.unit_weights(rows.withColumn("p", p), ["source", "lang"], "w")


def tables(spark: SparkSession, sf_dir: str):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(members, FR, " SELECT frame, team, round(sqrt(var_pop(x) + var_pop(y)), 6) AS dispersion FROM m GROUP BY ALL")
def a04_dispersion(m):
    return _r(spatial.dispersion(m, ["frame", "team"]), "dispersion")


@query(members, FR, " SELECT frame, round(min(d), 6) AS nearest_opponent FROM d WHERE team <> team2 GROUP BY frame")
def a05_nearest_opponent(m):
    return _r(spatial.nearest_opponent(spatial.teams(m, ["frame"]), ["frame"]), "nearest_opponent")


@query(members, FR, """, s AS (SELECT frame, team, count(*) AS members, list(sqrt(x * x + y * y) ORDER BY sqrt(x * x + y * y)) AS o FROM m GROUP BY ALL),
n AS (SELECT frame, team, id, min(d) AS d FROM d WHERE team = team2 GROUP BY ALL), k AS (SELECT frame, team, avg(d) AS a, max(d) AS b FROM n GROUP BY ALL),
z AS (SELECT s.*, a, b FROM s LEFT JOIN k USING (frame, team))
SELECT frame, max(members) FILTER (team = 'T') AS t_members, round(max(o[1]) FILTER (team = 'T'), 6) AS t_nearest, round(max(o[2]) FILTER (team = 'T'), 6) AS t_second,
CAST(max(len(list_filter(o, lambda v: v <= 0.15))) FILTER (team = 'T') AS BIGINT) AS t_within, round(max(a) FILTER (team = 'T'), 6) AS t_support_mean, round(max(b) FILTER (team = 'T'), 6) AS t_support_max FROM z GROUP BY frame""")
def a10_around_a_point(m):
    out = spatial.around(spatial.teams(m, ["frame"]), ["frame"], F.lit(0.0), F.lit(0.0), 0.15)
    names = ["t_nearest", "t_second", "t_support_mean", "t_support_max"]
    return _r(out, *names).select("frame", F.col("t_members").cast("long").alias("t_members"), F.col("t_within").cast("long").alias("t_within"), *names)


@query(members, FR, """, c AS (SELECT frame, min(id) AS id FROM m WHERE team = 'T' GROUP BY frame)
SELECT c.frame, CASE WHEN count(d.d) = 0 THEN 'no-teammates' ELSE 'available' END AS status, count(d.d) AS teammates, round(min(d.d), 6) AS nearest, count(*) FILTER (d.d <= 0.2) AS within
FROM c LEFT JOIN d ON d.frame = c.frame AND d.id = c.id AND d.team2 = 'T' GROUP BY c.frame""")
def a11_carrier_support(m):
    sides = spatial.teams(m, ["frame"]).withColumn("carrier", F.col("t")[0]["id"])
    out = spatial.carrier_support(sides, ["frame"], "carrier", 0.2)
    return _r(out, "nearest").select("frame", "status", F.col("teammates").cast("long").alias("teammates"), "nearest", F.col("within").cast("long").alias("within"))


@query(members, FR.replace("WITH m", "WITH RECURSIVE m"), """, r AS (SELECT frame, id, id AS root FROM m WHERE team = 'T' UNION SELECT d.frame, d.id2, r.root FROM r JOIN d ON d.frame = r.frame AND d.id = r.id AND d.team2 = 'T' AND d.d <= 0.2),
l AS (SELECT frame, id, min(root) AS root FROM r GROUP BY ALL), g AS (SELECT frame, root, count(*) AS n FROM l GROUP BY ALL)
SELECT frame, count(*) AS groups, max(n) AS largest FROM g GROUP BY frame""")
def a14_linked_groups(m):
    out = spatial.linked_groups(spatial.teams(m, ["frame"]), ["frame"], "t", 0.2)
    return out.select("frame", F.col("groups").cast("long").alias("groups"), F.col("largest").cast("long").alias("largest"))


@query(members, FR.replace("WITH m", "WITH RECURSIVE m"), """, r AS (SELECT frame, id, id AS root FROM m WHERE team = 'T' UNION SELECT d.frame, d.id2, r.root FROM r JOIN d ON d.frame = r.frame AND d.id = r.id AND d.team2 = 'T' AND d.d <= 0.2),
l AS (SELECT frame, id, min(root) AS root FROM r GROUP BY ALL), g AS (SELECT frame, root, count(*) AS n, avg(x) AS cx, avg(y) AS cy, row_number() OVER (PARTITION BY frame ORDER BY count(*) DESC, root) AS k, sum(count(*)) OVER (PARTITION BY frame) AS all_n FROM l JOIN m USING (frame, id) GROUP BY frame, root),
w AS (SELECT g.frame, coalesce(max(d.d), 0) AS diameter FROM g JOIN l a ON a.frame = g.frame AND a.root = g.root LEFT JOIN d ON d.frame = g.frame AND d.id = a.id AND EXISTS (SELECT 1 FROM l b WHERE b.frame = g.frame AND b.root = g.root AND b.id = d.id2) WHERE k = 1 GROUP BY g.frame),
z AS (SELECT a.frame, a.n, b.n AS n2, a.all_n, w.diameter, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS apart FROM g a JOIN w USING (frame) LEFT JOIN g b ON b.frame = a.frame AND b.k = 2 WHERE a.k = 1)
SELECT frame, CASE WHEN all_n < 2 THEN 'unknown' WHEN n / all_n >= 0.6 - 5e-7 AND diameter <= 0.3 + 5e-7 THEN 'grouped' WHEN n >= 2 AND n2 >= 2 AND (n + n2) / all_n >= 0.8 - 5e-7 AND apart >= 0.1 - 5e-7 THEN 'split' ELSE 'spread' END AS formation,
  CASE WHEN all_n >= 2 THEN round(n / all_n, 6) END AS coverage, CASE WHEN all_n >= 2 THEN round(diameter, 6) END AS diameter FROM z""")
def g01_formation(m):
    rules = facts.FORMATION | {"link_distance": 0.2, "grouped_coverage": 0.6, "grouped_diameter": 0.3, "split_distance": 0.1}
    return _r(facts.formation(spatial.teams(m, ["frame"]), ["frame"], "t", rules), "coverage", "diameter")


@query(members, FR, """, n AS (SELECT frame, team, id, min(d) FILTER (team = team2) AS a, min(d) FILTER (team <> team2) AS e FROM d GROUP BY ALL),
i AS (SELECT frame, team, string_agg(id, ',' ORDER BY id) FILTER (a >= 0.18 - 5e-7 AND a - e >= 0.04 - 5e-7) AS ids FROM n GROUP BY ALL), p AS (SELECT frame, coalesce(max(ids) FILTER (team = 'T'), '') AS t, coalesce(max(ids) FILTER (team = 'CT'), '') AS ct FROM i GROUP BY frame)
SELECT frame, CASE WHEN t <> '' AND ct <> '' THEN 'both' WHEN t <> '' THEN 'T' WHEN ct <> '' THEN 'CT' ELSE 'none' END AS isolated, t AS t_isolated, ct AS ct_isolated FROM p""")
def g05_isolated_side(m):
    out = facts.isolated_side(spatial.teams(m, ["frame"]), ["frame"])
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("frame", "isolated", text("t_isolated"), text("ct_isolated"))


@query(members, FR, """, c AS (SELECT frame, label AS region, count(*) FILTER (team = 'T') AS t, count(*) FILTER (team = 'CT') AS ct FROM m GROUP BY ALL) SELECT *, t > 0 AND ct > 0 AS contested FROM c""")
def a16_occupancy(m):
    return spatial.occupancy(m.withColumnRenamed("label", "region"), ["frame"], "region")


@query(members, FR, """, n AS (SELECT frame, team, id, min(d) FILTER (team = team2) AS a, min(d) FILTER (team <> team2) AS e FROM d GROUP BY ALL)
SELECT frame, team, id, round(a, 6) AS ally, round(e, 6) AS enemy, a IS NULL OR (a > 0.1 AND e + 0.02 < a) AS isolated FROM n""")
def a17_neighbours_and_isolation(m):
    return _r(spatial.isolation(spatial.neighbours(spatial.teams(m, ["frame"]), ["frame"]), 0.1, 0.02), "ally", "enemy")


@query(members, FR, """ SELECT frame, count(*) FILTER (team = 'T') - count(*) FILTER (team = 'CT') AS alive_diff, CAST(sum(CASE WHEN team = 'T' THEN label ELSE -label END) AS BIGINT) AS money_diff FROM m WHERE label > 2 GROUP BY frame""")
def a02_team_totals(m):
    out = spatial.team_totals(m.withColumn("health", F.lit(1)), ["frame"], "health", "label", F.col("label") > 2)
    return out.select("frame", "alive_diff", "money_diff")


_M = """count(*) AS rows, round(count(p) / count(*), 6) AS row_coverage, round(sum(w) FILTER (p IS NOT NULL) / sum(w), 6) AS weight_coverage,
round(sum(w * -ln(CASE WHEN y = 1 THEN least(greatest(p, 1e-6), 1 - 1e-6) ELSE 1 - least(greatest(p, 1e-6), 1 - 1e-6) END)) FILTER (p IS NOT NULL) / sum(w) FILTER (p IS NOT NULL), 6) AS log_loss,
round(sum(w * (p - y) * (p - y)) / sum(w) FILTER (p IS NOT NULL), 6) AS brier, round(sum(w * CAST((p >= 0.5) = (y = 1) AS INT)) / sum(w) FILTER (p IS NOT NULL), 6) AS accuracy"""
_METRICS = ("row_coverage", "weight_coverage", "log_loss", "brier", "accuracy")


@query(predictions, PR, f" SELECT source, {_M} FROM e GROUP BY source")
def a22_metrics(e):
    return _r(evaluate.metrics(e, ["source"]), *_METRICS)


@query(predictions, PR, " SELECT a.source, round(sum(a.w * b.w * CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / sum(a.w * b.w), 6) AS auc FROM e a JOIN e b ON a.source = b.source AND a.y = 1 AND b.y = 0 WHERE a.p IS NOT NULL AND b.p IS NOT NULL GROUP BY a.source")
def a23_auc(e):
    return _r(evaluate.auc(e, ["source"]), "auc").filter(F.col("auc").isNotNull())


_BINS = ", b AS (SELECT lang, CAST(least(floor(least(greatest(p, 1e-6), 1 - 1e-6) * 10), 9) AS INT) AS bin, count(*) AS rows, sum(w) AS weight, sum(w * least(greatest(p, 1e-6), 1 - 1e-6)) / sum(w) AS mean, sum(w * y) / sum(w) AS observed FROM e WHERE p IS NOT NULL GROUP BY ALL)"


@query(predictions, PR, _BINS + " SELECT lang, bin, rows, round(weight, 6) AS weight, round(mean, 6) AS mean, round(observed, 6) AS observed FROM b")
def a24_calibration(e):
    return _r(evaluate.calibration(e, ["lang"]), "weight", "mean", "observed")


@query(predictions, PR, _BINS + " SELECT lang, round(sum(weight * abs(mean - observed)) / sum(weight), 6) AS ece FROM b GROUP BY lang")
def a25_calibration_error(e):
    return _r(evaluate.calibration_error(evaluate.calibration(e, ["lang"]), ["lang"]), "ece")


@query(predictions, PR, f", s AS (SELECT *, unnest(['long', 'sure', 'english']) AS slice, unnest([n_chars > 2000, p > 0.6, lang = 'en']) AS hit FROM e) SELECT slice, {_M} FROM s WHERE hit GROUP BY slice")
def a27_slices(e):
    sliced = evaluate.by_slices(e, {"long": F.col("n_chars") > 2000, "sure": F.col("p") > 0.6, "english": F.col("lang") == "en"})
    return _r(evaluate.metrics(sliced, ["slice"]), *_METRICS)


@query(predictions, PR, """, l AS (SELECT source AS m, sum(w * -ln(CASE WHEN y = 1 THEN least(greatest(p, 1e-6), 1 - 1e-6) ELSE 1 - least(greatest(p, 1e-6), 1 - 1e-6) END)) AS a, sum(w * (p - y) * (p - y)) AS b, sum(w) AS w FROM e WHERE p IS NOT NULL GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY m) - 1 AS place, count(*) OVER () AS n FROM l),
i AS (SELECT unnest(range(0, 1000 * (SELECT count(*) FROM l))) AS i, (SELECT count(*) FROM l) AS n),
d AS (SELECT i // n AS r, CAST('0x' || substr(md5('7|' || i), 1, 13) AS BIGINT) % n AS place FROM i),
v AS (SELECT r, sum(a) / sum(w) AS a, sum(b) / sum(w) AS b FROM d JOIN k USING (place) GROUP BY r)
SELECT 'log_loss' AS metric, round((SELECT sum(a) / sum(w) FROM l), 6) AS value, round(quantile_cont(a, 0.025), 6) AS low, round(quantile_cont(a, 0.975), 6) AS high FROM v
UNION ALL SELECT 'brier', round((SELECT sum(b) / sum(w) FROM l), 6), round(quantile_cont(b, 0.025), 6), round(quantile_cont(b, 0.975), 6) FROM v""")
def a28_cluster_bootstrap(e):
    return _r(evaluate.cluster_bootstrap(e, "source"), "value", "low", "high")


@query(predictions, PR, " SELECT count(*) AS rows, count(DISTINCT doc_id) AS keys, count(DISTINCT (source, lang)) AS groups, (SELECT count(*) FROM (SELECT 1 FROM e GROUP BY source, lang HAVING count(DISTINCT y) > 1)) AS mixed_labels, 0::BIGINT AS off_weights FROM e")
def a20_validation(e):
    return evaluate.validation(e, ["doc_id"], ["source", "lang"], "y", "w")


@query(predictions, PR, " SELECT lang, count(*) AS rows, count(DISTINCT (source, lang)) AS rounds, count(DISTINCT source) AS matches, round(sum(w), 6) AS weight FROM e GROUP BY lang")
def a21_cardinality(e):
    return _r(evaluate.cardinality(e, ["lang"], "source", ["source", "lang"], "w"), "weight")


@query(predictions, PR, " SELECT lang, count(n_chars) AS n, min(n_chars) AS least, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95, max(n_chars) AS most FROM e GROUP BY lang")
def a36_distribution(e):
    return evaluate.distribution(e, ["lang"], "n_chars")


@query(predictions, PR, " SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM e GROUP BY source, lang) GROUP BY size")
def a35_size_histogram(e):
    return evaluate.size_histogram(e, ["source", "lang"])


@query(predictions, PR, " SELECT lang, count(source) AS total, count(DISTINCT source) AS \"distinct\", count(source) - count(DISTINCT source) AS duplicates FROM e GROUP BY ROLLUP (lang)")
def a34_uniqueness(e):
    return evaluate.uniqueness(e, "lang", "source")


@query(predictions, PR, " SELECT 'finite' AS rule, count(*) FILTER (p IS NULL) AS rows FROM e UNION ALL SELECT 'short', count(*) FILTER (n_chars > 3000) FROM e")
def p32_violations(e):
    return evaluate.violations(e, {"finite": scalar.finite(F.col("p")) >= 0, "short": F.col("n_chars") <= 3000})


@query(predictions, PR, """ SELECT doc_id, CASE WHEN p IS NULL THEN 'no-prediction' WHEN lang = 'de' THEN 'language' WHEN n_chars < 500 THEN 'short' END AS reason,
concat_ws('+', CASE WHEN p IS NULL THEN 'no-prediction' END, CASE WHEN lang = 'de' THEN 'language' END, CASE WHEN n_chars < 500 THEN 'short' END) AS reasons FROM e""")
def p10_p11_reasons(e):
    rules = ((F.col("p").isNull(), "no-prediction"), (F.col("lang") == "de", "language"), (F.col("n_chars") < 500, "short"))
    return e.select("doc_id", scalar.first_reason(*rules).alias("reason"), scalar.all_reasons(*rules).alias("reasons"))


@query(predictions, PR, """, t AS (SELECT doc_id, list_filter([CASE WHEN y = 1 THEN 'good' END, CASE WHEN n_chars > 1500 THEN 'long' END, CASE WHEN lang = 'en' THEN 'english' END], lambda x: x IS NOT NULL) AS t FROM e),
u AS (SELECT doc_id, unnest(t) AS a FROM t) SELECT u.a, v.a AS b, count(*) AS rows FROM u JOIN u v ON u.doc_id = v.doc_id AND u.a <= v.a GROUP BY ALL""")
def a39_co_occurrence(e):
    tagged = e.withColumn("tags", scalar.tags(good=F.col("y") == 1, long=F.col("n_chars") > 1500, english=F.col("lang") == "en"))
    return evaluate.co_occurrence(tagged, "doc_id", "tags")


@query(predictions, PR, " SELECT doc_id, lang FROM e QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('sample|1|' || doc_id), doc_id) <= 7")
def o02_hash_sample(e):
    return select.hash_sample(e, ["lang"], "doc_id", 7).select("doc_id", "lang")


@query(predictions, PR, """, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM e)
SELECT doc_id, lang FROM r WHERE n <= 5 OR i IN (SELECT CAST(floor(g * (r.n - 1) / 4 + 0.5) AS BIGINT) FROM range(0, 5) AS x(g))""")
def o05_evenly_spaced(e):
    return select.evenly_spaced(e, ["lang"], ["n_chars", "doc_id"], 5).select("doc_id", "lang")


@query(predictions, PR, """, g AS (SELECT lang, source, CAST(count(*) AS DOUBLE) AS score FROM e GROUP BY ALL), m AS (SELECT lang, max(score) AS m FROM g GROUP BY lang)
SELECT g.lang, CASE WHEN count(*) = 1 THEN max(source) END AS source FROM g JOIN m USING (lang) WHERE score >= m - 5e-7 GROUP BY g.lang""")
def o03_best_or_tie(e):
    scored = e.groupBy("lang", "source").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return select.best_or_tie(scored, ["lang"], "score", "source")


@query(predictions, PR, """, a AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3) SELECT doc_id FROM a QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= 10""")
def o08_capped(e):
    return select.capped(e, [(["source"], 3), (["lang"], 10)], [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id")


@query(predictions, PR, """ SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('backup|1|' || doc_id), doc_id) AS rank FROM e WHERE doc_id % 3 > 0 QUALIFY rank <= 4""")
def o11_backups(e):
    return select.backups(e, e.filter("doc_id % 3 = 0"), ["lang"], "doc_id", 4).select("doc_id", "lang", F.col("rank").cast("long").alias("rank"))


_TAGS = ", t AS (SELECT *, list_filter([CASE WHEN y = 1 THEN 'good' END, CASE WHEN n_chars > 1500 THEN 'long' END, lang], lambda x: x IS NOT NULL) AS tags FROM e)"


@query(predictions, PR, _TAGS + """, u AS (SELECT doc_id, n_chars, unnest(tags) AS c FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY c) AS n FROM u),
k AS (SELECT DISTINCT doc_id FROM r WHERE n <= 2 OR i IN (0, n - 1)) SELECT t.doc_id, k.doc_id IS NOT NULL AS balanced FROM t LEFT JOIN k USING (doc_id) ORDER BY 2 DESC, n_chars, doc_id LIMIT 20""")
def o17_category_balanced(e):
    tagged = e.withColumn("tags", F.array_compact(F.array(F.when(F.col("y") == 1, "good"), F.when(F.col("n_chars") > 1500, "long"), F.col("lang"))))
    return select.category_balanced(tagged, "tags", "doc_id", ["n_chars"], 2, 20).select("doc_id", "balanced")


@query(predictions, PR, """, p AS (SELECT *, row_number() OVER (ORDER BY n_chars, doc_id) + CASE WHEN doc_id % 50 = 0 THEN 1 ELSE 0 END AS place, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS k, count(*) OVER (PARTITION BY source, lang) AS same FROM e WHERE doc_id % 5 = 0)
SELECT 'foreign' AS rule, count(*) FILTER (doc_id % 7 = 0) AS rows FROM p UNION ALL SELECT 'unique_doc_id', 0 UNION ALL SELECT 'unique_source_lang', count(*) FILTER (same > 1) FROM p UNION ALL SELECT 'cap_source', count(*) FILTER (k > 2) FROM p UNION ALL SELECT 'order', count(*) FILTER (doc_id % 50 = 0) FROM p""")
def a54_plan_violations(e):
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy("n_chars", "doc_id")) + F.when(F.col("doc_id") % 50 == 0, 1).otherwise(0)
    plan = e.filter("doc_id % 5 = 0").withColumn("place", place)
    return select.plan_violations(plan, e.filter("doc_id % 7 <> 0"), "doc_id", [["doc_id"], ["source", "lang"]], [(["source"], 2)], "place", [F.asc("n_chars")])


@query(predictions, PR.replace("WITH e", "WITH RECURSIVE e"), """, f AS (SELECT doc_id, source, n_chars FROM e QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars, sha256(CAST(doc_id AS VARCHAR))) = 1),
r AS (SELECT doc_id, source, n_chars, 1 AS pick, [doc_id] AS ids, [n_chars] AS times FROM f
  UNION ALL SELECT doc_id, source, n_chars, pick, list_append(ids, doc_id), list_append(times, n_chars) FROM (
    SELECT e.doc_id, e.source, e.n_chars, r.pick + 1 AS pick, r.ids, r.times, row_number() OVER (PARTITION BY e.source ORDER BY list_min(list_transform(r.times, lambda t: abs(t - e.n_chars))) DESC, e.n_chars, sha256(CAST(e.doc_id AS VARCHAR))) AS q
    FROM r JOIN e ON e.source = r.source AND NOT list_contains(r.ids, e.doc_id) WHERE r.pick < 8) WHERE q = 1)
SELECT doc_id, source, n_chars, CAST(pick AS INTEGER) AS pick FROM r""")
def o06_farthest_points(e):
    return select.farthest_points(e.select("doc_id", "source", "n_chars"), ["source"], "n_chars", "doc_id", 8)


@query(tables, "", """SELECT l_orderkey, l_partkey, round(round(l_extendedprice / 7, 6) + 0, 6) AS rounded, greatest(least(l_quantity, 30), 10) AS clamped,
round(ln(l_discount / (1 - l_discount)), 6) AS logit, lpad(CAST(CAST(l_quantity AS BIGINT) * 37 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(l_quantity AS BIGINT) * 37 % 60 AS VARCHAR), 2, '0') AS clock,
'order-' || sha256(concat_ws(chr(10), CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR))) AS ref, (90 - l_suppkey % 500 + 720) % 360 AS rotation FROM lineitem WHERE l_discount > 0""")
def f_scalars(t):
    rows = t("lineitem").filter("l_discount > 0")
    seconds = F.col("l_quantity").cast("long") * 37
    return rows.select(
        "l_orderkey", "l_partkey", scalar.rounded(F.col("l_extendedprice") / 7).alias("rounded"), scalar.clamp(F.col("l_quantity"), 10.0, 30.0).alias("clamped"),
        F.round(scalar.logit(F.col("l_discount")), 6).alias("logit"), scalar.clock(seconds).alias("clock"),
        scalar.private_ref("order", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("ref"), scalar.rotation(F.col("l_suppkey") % 500).alias("rotation"),
    )
