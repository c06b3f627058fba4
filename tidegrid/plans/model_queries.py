"""Queries of the logistic model and the calibrators on labelled documents, with their SQL.

The label is the outcome, a function of the length the prediction, the id modulo four the fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import calibrate, models
from tidegrid.plans import table_queries

QUERIES, SQL = {}, {}
NUMERIC, CATEGORICAL = ["n_chars", "gap", "p"], ["lang"]

_BASE = table_queries.PR + ", r AS (SELECT *, doc_id % 4 AS fold FROM e), fs AS (SELECT * FROM (VALUES (-1), (0), (1), (2), (3)) v(f))"
#: Newton steps of y on x, two coefficients a fold, from the rows t (f, x, y, w); fold -1 has all rows.
_NEWTON = """, nw AS (SELECT f, 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM fs UNION ALL
  SELECT f, i + 1, a - (bb * ga - ab * gb) / (aa * bb - ab * ab), b - (aa * gb - ab * ga) / (aa * bb - ab * ab) FROM (
    SELECT f, i, a, b, sum(w * (q - y) * x) + a AS ga, sum(w * (q - y)) AS gb, sum(w * q * (1 - q) * x * x) + 1 AS aa, sum(w * q * (1 - q) * x) AS ab, sum(w * q * (1 - q)) AS bb
    FROM (SELECT n.*, t.x, t.y, t.w, 1 / (1 + exp(-(n.a * t.x + n.b))) AS q FROM nw n JOIN t ON t.f = n.f WHERE n.i < 30) GROUP BY f, i, a, b)),
fit AS (SELECT f, a, b FROM nw WHERE i = 30)"""
_LOGIT = ", t AS (SELECT f, ln(q / (1 - q)) AS x, y, w FROM (SELECT f, greatest(least(p, 1 - 1e-6), 1e-6)::DOUBLE AS q, y, w FROM r, fs WHERE p IS NOT NULL AND r.fold <> f))"
_LENGTH = """, s AS (SELECT f, avg(n_chars) AS c, stddev_pop(n_chars) AS s FROM r, fs WHERE r.fold <> f GROUP BY f),
t AS (SELECT f, (n_chars - c) / s AS x, y, w FROM r JOIN s ON r.fold <> s.f)"""
_STEPS = """, g AS (SELECT f, p, sum(w) AS w, sum(w * y) AS wy FROM r, fs WHERE p IS NOT NULL AND r.fold <> f GROUP BY f, p), u AS (SELECT f, p, coalesce(sum(w) OVER b, 0) AS w0, coalesce(sum(wy) OVER b, 0) AS y0,
  sum(w) OVER i AS w1, sum(wy) OVER i AS y1, row_number() OVER i AS n FROM g WINDOW b AS (PARTITION BY f ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), i AS (PARTITION BY f ORDER BY p)),
m AS (SELECT a.f, a.n AS j, b.n AS k, (b.y1 - a.y0) / (b.w1 - a.w0) AS v FROM u a JOIN u b ON a.f = b.f AND b.n >= a.n),
l AS (SELECT f, j, k, min(v) OVER (PARTITION BY f, j ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM m),
iso AS (SELECT u.f, u.p, max(l.v) AS v FROM u JOIN l ON l.f = u.f AND l.k = u.n GROUP BY u.f, u.p)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(_rows(spark, sf_dir))
        if sql:
            SQL[f.__name__] = _BASE.replace("WITH e", "WITH RECURSIVE e", 1) + sql
        return f

    return add


def _rows(spark, sf_dir: str) -> DataFrame:
    return table_queries.predictions(spark, sf_dir).withColumn("fold", (F.col("doc_id") % 4).cast("int"))


def _table(rows: DataFrame, found: list[tuple], ddl: str) -> DataFrame:
    return rows.sparkSession.createDataFrame(found, ddl)


@query(_LENGTH + _NEWTON + """ SELECT CASE WHEN f >= 0 THEN CAST(f AS VARCHAR) END AS fold, 'n_chars' AS name, round(a, 6) AS value FROM fit UNION ALL SELECT CASE WHEN f >= 0 THEN CAST(f AS VARCHAR) END, 'intercept', round(b, 6) FROM fit""")
def m02_logistic(e):
    made = models.fit(e, ["n_chars"])
    return _table(e, [(f, c, round(b, 6)) for f, c, b in models.coefficients(made)], "fold string, name string, value double")


@query(_LENGTH + _NEWTON + """ SELECT doc_id, round(1 / (1 + exp(-(a * (n_chars - c) / s + b))), 6) AS p FROM r JOIN fit ON fit.f = r.fold JOIN s ON s.f = r.fold""")
def m03_out_of_fold(e):
    rows = e.drop("p")
    return models.with_predictions(rows, models.fit(rows, ["n_chars"]), ["n_chars"]).select("doc_id", F.round("p", 6).alias("p"))


@query()
def m01_mixed_columns(e):
    """Numbers with gaps and a category; every document gets a prediction out of fold."""
    rows = e.withColumn("gap", F.when(F.col("doc_id") % 5 > 0, F.col("n_chars") % 97))
    made = models.fit(rows, NUMERIC, CATEGORICAL)
    return models.with_predictions(rows, made, NUMERIC, CATEGORICAL, name="q").select("doc_id", "q")


@query()
def m08_explanation(e):
    rows = e.withColumn("gap", F.when(F.col("doc_id") % 5 > 0, F.col("n_chars") % 97))
    return models.explained(rows, models.fit(rows, NUMERIC, CATEGORICAL)[None], {"n_chars": "size", "p": "size", "lang": "language"}, NUMERIC, CATEGORICAL)


@query()
def m05_one_source_out(e):
    """Each source is its own fold: every document is scored by the model of all other sources."""
    return models.with_predictions(e.drop("p"), models.fit(e, ["n_chars"], ["lang"], fold="source"), ["n_chars"], ["lang"], fold="source").select("doc_id", "source", "p")


@query(_LOGIT + _NEWTON + """ SELECT CASE WHEN f >= 0 THEN f END AS fold, round(a, 6) AS slope, round(b, 6) AS intercept FROM fit""")
def m04_sigmoid(e):
    fits = calibrate.sigmoids(e, [0, 1, 2, 3])
    return _table(e, [(f, round(a, 6), round(b, 6)) for f, (a, b) in fits.items()], "fold int, slope double, intercept double")


@query(_STEPS + """ SELECT min(p) AS low, max(p) AS high, round(any_value(v), 6) AS value FROM iso WHERE f = -1 GROUP BY round(v, 9)""")
def m04_isotonic(e):
    return calibrate.isotonic(e).select("low", "high", F.round("value", 6).alias("value"))


_NEXT = """, bl AS (SELECT f, min(p) AS low, max(p) AS high, any_value(v) AS v FROM iso GROUP BY f, round(v, 9)),
bn AS (SELECT *, lead(low) OVER (PARTITION BY f ORDER BY low) AS next_low, lead(v) OVER (PARTITION BY f ORDER BY low) AS next_v, min(low) OVER (PARTITION BY f) AS first, first_value(v) OVER (PARTITION BY f ORDER BY low) AS first_v FROM bl),
h AS (SELECT r.*, b.*, row_number() OVER (PARTITION BY doc_id ORDER BY low DESC) AS pick FROM r LEFT JOIN bn b ON b.f = r.fold AND b.low <= r.p),
c AS (SELECT h.doc_id, h.lang, h.y, h.w, h.p AS identity, 1 / (1 + exp(-(a * ln(qp / (1 - qp)) + fit.b))) AS sigmoid,
  greatest(least(CASE WHEN h.low IS NULL THEN x.first_v WHEN h.next_low IS NULL OR h.p <= h.high THEN h.v ELSE h.v + (h.next_v - h.v) * (h.p - h.high) / (h.next_low - h.high) END, 1 - 1e-6), 1e-6) AS isotonic
  FROM (SELECT *, greatest(least(p, 1 - 1e-6), 1e-6)::DOUBLE AS qp FROM h WHERE pick = 1 AND p IS NOT NULL) h JOIN fit ON fit.f = h.fold JOIN (SELECT DISTINCT f, first_v FROM bn) x ON x.f = h.fold)"""


@query(_LOGIT + _NEWTON + _STEPS + _NEXT + """, o AS (UNPIVOT c ON identity, isotonic, sigmoid INTO NAME method VALUE q),
v AS (SELECT method, round(sum(w * -CASE WHEN y = 1 THEN ln(greatest(least(q, 1 - 1e-6), 1e-6)) ELSE ln(1 - greatest(least(q, 1 - 1e-6), 1e-6)) END) / sum(w), 6) AS log_loss FROM o GROUP BY method)
SELECT method, log_loss, row_number() OVER (ORDER BY log_loss, method) = 1 AS chosen FROM v""")
def m04_chosen(e):
    return calibrate.chosen(calibrate.cross_calibrated(e)).select("method", F.round("log_loss", 6).alias("log_loss"), "chosen")
