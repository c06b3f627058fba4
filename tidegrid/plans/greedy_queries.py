"""Queries of greedy selections on documents and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import greedy, select
from tidegrid.plans.timeline_queries import EV, events

QUERIES, SQL = {}, {}
TARGETS = {"short": 3, "long": 4, "even": 2, "third": 5}
ALLOWED = ["signup", "error", "purchase", "view"]

D = """WITH RECURSIVE d AS (SELECT doc_id, lang, source, n_chars, (n_chars < 800)::INT AS a, (n_chars > 3000)::INT AS b, (doc_id % 2 = 0)::INT AS c, (doc_id % 3 = 0)::INT AS e,
  doc_id % 389 AS k1, n_chars % 401 AS k2, lang || (doc_id * 7 % 97) AS k3, CASE lang WHEN 'en' THEN 0 ELSE 1 END AS split FROM documents)"""


def query(load, prefix: str, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(load(spark, sf_dir))
        if sql:
            SQL[f.__name__] = prefix + sql
        return f

    return add


def documents(spark, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    marks = {"short": F.col("n_chars") < 800, "long": F.col("n_chars") > 3000, "even": F.col("doc_id") % 2 == 0, "third": F.col("doc_id") % 3 == 0}
    return d.withColumns({
        "tags": F.array_compact(F.array(*(F.when(c, F.lit(t)) for t, c in marks.items()))), "split": F.when(F.col("lang") == "en", 0).otherwise(1), "k1": F.col("doc_id") % 389, "k2": F.col("n_chars") % 401,
        "k3": F.concat("lang", (F.col("doc_id") * 7 % 97).cast("string")),
    })


@query(documents, D, """, o AS (SELECT *, row_number() OVER (ORDER BY split, doc_id) AS n FROM d),
f(n, doc_id, kept, s1, s2, s3) AS (SELECT 0::BIGINT, NULL::BIGINT, false, []::BIGINT[], []::BIGINT[], []::VARCHAR[] UNION ALL
  SELECT n, doc_id, ok, CASE WHEN ok THEN list_append(s1, k1) ELSE s1 END, CASE WHEN ok THEN list_append(s2, k2) ELSE s2 END, CASE WHEN ok THEN list_append(s3, k3) ELSE s3 END FROM (
    SELECT o.n, o.doc_id, f.s1, f.s2, f.s3, o.k1, o.k2, o.k3, NOT (list_contains(f.s1, o.k1) OR list_contains(f.s2, o.k2) OR list_contains(f.s3, o.k3)) AS ok FROM f JOIN o ON o.n = f.n + 1))
SELECT doc_id FROM f WHERE kept""")
def u09_first_of_three_keys(d):
    return greedy.first_of_keys(d, ["k1", "k2", "k3"], ["split", "doc_id"]).select("doc_id")


def _cover(score: str) -> str:
    return f""", s(lang, pick, ids, doc_id, score, na, nb, nc, ne) AS (SELECT DISTINCT lang, 0, []::BIGINT[], NULL::BIGINT, 0, 0, 0, 0, 0 FROM d UNION ALL
  SELECT lang, pick + 1, list_append(ids, best.d), best.d, -best.s, na + best.a, nb + best.b, nc + best.c, ne + best.e FROM (
    SELECT s.lang, s.pick, s.ids, s.na, s.nb, s.nc, s.ne, min({{'s': -({score}), 'd': d.doc_id, 'a': d.a, 'b': d.b, 'c': d.c, 'e': d.e}}) AS best
    FROM s JOIN d ON d.lang = s.lang AND NOT list_contains(s.ids, d.doc_id) WHERE s.pick < 9 GROUP BY ALL))"""


_DEFICIT = _cover("d.a * greatest(0, 3 - na) + d.b * greatest(0, 4 - nb) + d.c * greatest(0, 2 - nc) + d.e * greatest(0, 5 - ne)")


@query(documents, D, _DEFICIT + " SELECT lang, doc_id, CAST(pick AS INTEGER) AS pick, score::DOUBLE AS score FROM s WHERE pick > 0")
def o12_coverage(d):
    return greedy.covering(d, ["lang"], "tags", ["doc_id"], 9, TARGETS).select("lang", "doc_id", "pick", "score")


@query(documents, D, _cover("d.a * (na = 0)::INT + d.b * (nb = 0)::INT + d.c * (nc = 0)::INT + d.e * (ne = 0)::INT") + " SELECT lang, doc_id, CAST(pick AS INTEGER) AS pick FROM s WHERE pick > 0")
def o16_uncovered_first(d):
    return greedy.covering(d, ["lang"], "tags", ["doc_id"], 9, TARGETS, greedy.UNCOVERED).select("lang", "doc_id", "pick")


@query(documents, D)
def o13_rarest_first(d):
    """Within each source, the rarest tags first, and languages that none is chosen of yet."""
    return greedy.covering(d, ["source"], "tags", ["doc_id"], 6, TARGETS, greedy.RAREST, spread="lang").select("source", "doc_id", "pick", "score")


@query(documents, D, _DEFICIT + """, h AS (SELECT lang, max(na) AS a, max(nb) AS b, max(nc) AS c, max(ne) AS e FROM s GROUP BY lang),
u AS (UNPIVOT (SELECT lang, a AS short, b AS long, c AS even, e AS third FROM h) ON short, long, even, third INTO NAME tag VALUE have), t(tag, target) AS (VALUES ('short', 3), ('long', 4), ('even', 2), ('third', 5))
SELECT lang, tag, target, have::BIGINT AS have, greatest(0, target - have)::BIGINT AS missing FROM u JOIN t USING (tag)""")
def o12_shortage(d):
    return greedy.missing_tags(greedy.covering(d, ["lang"], "tags", ["doc_id"], 9, TARGETS), d, ["lang"], "tags", TARGETS)


@query(events, EV, """, r AS (SELECT user_id, day, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id) AS n, event_id FROM ev QUALIFY n <= 3),
w AS (SELECT r.user_id, r.day, r.n, list_distinct(list(e.kind)) AS kinds FROM r JOIN ev e ON e.user_id = r.user_id AND e.event_id BETWEEN r.event_id AND r.event_id + 300 GROUP BY ALL),
k(kind, i) AS (VALUES ('signup', 1), ('error', 2), ('purchase', 3), ('view', 4)),
cc AS (SELECT w.*, k.kind, k.i FROM w JOIN k ON list_contains(w.kinds, k.kind)), sizes AS (SELECT user_id, day, max(n) AS m FROM r GROUP BY ALL),
ways AS (
  SELECT s.user_id, s.day, [x.i] AS o, [x.kind] AS events FROM sizes s JOIN cc x ON x.user_id = s.user_id AND x.day = s.day AND x.n = 1 WHERE s.m = 1
  UNION ALL SELECT s.user_id, s.day, [x.i, y.i], [x.kind, y.kind] FROM sizes s JOIN cc x ON x.user_id = s.user_id AND x.day = s.day AND x.n = 1 JOIN cc y ON y.user_id = s.user_id AND y.day = s.day AND y.n = 2 AND y.i <> x.i WHERE s.m = 2
  UNION ALL SELECT s.user_id, s.day, [x.i, y.i, z.i], [x.kind, y.kind, z.kind] FROM sizes s JOIN cc x ON x.user_id = s.user_id AND x.day = s.day AND x.n = 1 JOIN cc y ON y.user_id = s.user_id AND y.day = s.day AND y.n = 2 AND y.i <> x.i
    JOIN cc z ON z.user_id = s.user_id AND z.day = s.day AND z.n = 3 AND z.i NOT IN (x.i, y.i) WHERE s.m = 3),
b AS (SELECT user_id, day, arg_min(events, o) AS events FROM ways GROUP BY ALL)
SELECT user_id, day, array_to_string(list_sort(events), ',') AS events FROM sizes LEFT JOIN b USING (user_id, day)""")
def o10_event_assignment(ev):
    """The first three rows of a user's day; a row's events are the kinds that follow closely."""
    first = select.capped(ev, [(["user_id", "day"], 3)], [F.col("event_id")]).select(F.col("user_id").alias("u"), "day", F.col("event_id").alias("at"))
    near = first.join(ev.select("user_id", "event_id", "kind"), (F.col("u") == F.col("user_id")) & F.col("event_id").between(F.col("at"), F.col("at") + 300))
    own = near.groupBy("user_id", "day", "at").agg(F.collect_set("kind").alias("kinds"))
    rows = own.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("at", "kinds"))).alias("r"))
    return rows.select("user_id", "day", F.array_join(greedy.assigned(F.transform("r", lambda x: x["kinds"]), ALLOWED), ",").alias("events"))


@query(events, EV)
def o07_anchors(ev):
    """A user's day is a round, a kind of event a category; hours in which nothing of note happens fill up to six."""
    hour = F.floor(F.col("t") / 3_600_000_000)
    return greedy.anchors(ev.select("user_id", "day", hour.alias("hour"), "kind"), ["user_id", "day"], "kind", "hour", ["purchase", "error", "signup"], 6).select("user_id", "day", "hour", F.array_join("tags", ",").alias("tags"))
