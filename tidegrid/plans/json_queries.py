"""Queries of the JSON forms on records made of documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import codecs, jsonforms

QUERIES, SQL = {}, {}
D = """WITH d AS (SELECT doc_id, lang, source, n_chars, round(n_chars / 7.0, 6)::DOUBLE AS rate FROM documents),
t AS (SELECT *, CASE WHEN rate = floor(rate) THEN CAST(CAST(rate AS BIGINT) AS VARCHAR) ELSE CAST(rate AS VARCHAR) END AS shown FROM d)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(records(spark, sf_dir))
        if sql:
            SQL[f.__name__] = D + sql
        return f

    return add


def records(spark, sf_dir: str) -> DataFrame:
    """j: keys out of order, a fraction, like objects, a nested one with a slash in its key, and an empty array."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    part = lambda k: F.struct((F.col("n_chars") + k).alias("at"), F.col("source").alias("by"))
    record = F.struct(
        F.col("source").alias("s"), F.struct(F.col("lang").alias("a/b"), F.col("n_chars").alias("Winner")).alias("in"), F.array(part(0), part(3), part(6)).alias("parts"),
        (F.col("n_chars") / 7).alias("rate"), F.array().cast("array<int>").alias("none"), F.col("doc_id").alias("id"),
    )
    return d.select("doc_id", F.to_json(record).alias("j"))


@query(""", l AS (SELECT doc_id, unnest([{'p': '/s', 'k': 'string', 't': '"' || source || '"'}, {'p': '/in/a~1b', 'k': 'string', 't': '"' || lang || '"'}, {'p': '/in/Winner', 'k': 'number', 't': n_chars::VARCHAR},
  {'p': '/none', 'k': 'array', 't': '[]'}, {'p': '/id', 'k': 'number', 't': doc_id::VARCHAR}]) AS x FROM d UNION ALL
  SELECT doc_id, unnest([{'p': '/parts/' || i || '/at', 'k': 'number', 't': (n_chars + 3 * i)::VARCHAR}, {'p': '/parts/' || i || '/by', 'k': 'string', 't': '"' || source || '"'}]) FROM d, range(3) r(i))
SELECT doc_id, x.p AS pointer, x.k AS kind, x.t AS text FROM l""")
def f19_leaves(d):
    return jsonforms.leaves(d, ["doc_id"], "j").filter("pointer <> '/rate'").select("doc_id", "pointer", "kind", "text")


@query(""", j AS (SELECT doc_id, '{"id":' || doc_id || ',"in":{"Winner":' || n_chars || ',"a/b":"' || lang || '"},"none":[],"parts":[' ||
  array_to_string(list_transform(range(3), lambda i: '{"at":' || (n_chars + 3 * i) || ',"by":"' || source || '"}'), ',') || '],"rate":' || shown || ',"s":"' || source || '"}' AS canonical FROM t)
SELECT doc_id, canonical, 'rounded-6' AS form, sha256(canonical) AS sha256 FROM j""")
def f10_canonical(d):
    out = jsonforms.canonical(d, "j", jsonforms.ROUNDED)
    return out.select("doc_id", "canonical", jsonforms.digest(F.col("canonical"), jsonforms.ROUNDED).alias("x")).select("doc_id", "canonical", "x.*")


@query(""" SELECT doc_id, '{"id":' || doc_id || ',"s":"' || source || '","z":[' || n_chars || ',null,true]}' AS canonical FROM d""")
def f11_exact(d):
    own = d.select("doc_id", F.to_json(F.struct(F.get_json_object("j", "$.s").alias("s"), F.col("doc_id").alias("id"))).alias("a"), F.get_json_object("j", "$.in.Winner").alias("n"))
    text = F.concat(F.lit('{ "z": ['), F.col("n"), F.lit(" , null, true ], "), F.substring("a", F.lit(2), F.length("a")))
    return jsonforms.canonical(own.select("doc_id", text.alias("j")), "j").select("doc_id", "canonical")


@query(""" SELECT doc_id, '/in/Winner' AS pointer, 'Winner' AS key FROM d""")
def p33_forbidden(d):
    return jsonforms.forbidden_fields(d, ["doc_id"], "j", ["winner", "by"])


@query(""" SELECT doc_id, '/s' AS pointer, '"' || source || '"' AS actual, '"src0"' AS expected FROM d WHERE source <> 'src0'
UNION ALL SELECT doc_id, '/parts/2/by', NULL, '"' || source || '"' FROM d WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, '/parts/2/at', NULL, (n_chars + 6)::VARCHAR FROM d WHERE doc_id % 5 = 0""")
def f23_differences(d):
    """Against records with another source, a rate off by less than the tolerance, and every fifth with a part more."""
    kept = F.when(F.col("doc_id") % 5 == 0, F.regexp_replace("j", r',\{"at":\d+,"by":"[^"]*"\}\]', "]")).otherwise(F.col("j"))
    other = F.regexp_replace(F.regexp_replace("j", r'^\{"s":"[^"]*"', '{"s":"src0"'), r'"rate":([0-9.]+)', '"rate":$10000000000001')
    return jsonforms.differences(d.select("doc_id", kept.alias("j")), d.select("doc_id", other.alias("j")), ["doc_id"], "j")


@query(" SELECT doc_id, true AS restored, true AS shorter FROM d")
def f17_codec(d):
    many = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.struct(F.lit("x").alias("kind"), k.alias("at"), (k * F.col("doc_id")).alias("value")))
    text = d.withColumn("j", F.to_json(F.struct(many.alias("rows"), F.get_json_object("j", "$.s").alias("s"))))
    out = codecs.decoded(codecs.encoded(text, "j"), "encoded", "is_encoded")
    return out.select("doc_id", F.to_json(F.parse_json("decoded")).eqNullSafe(F.to_json(F.parse_json("j"))).alias("restored"), (F.length("encoded") < F.length("j") / 2).alias("shorter"))


@query(" SELECT doc_id, true AS restored FROM d")
def f16_f18_names_and_tables(d):
    names = {"parts": "p", "source": "s2", "rate": "r", "at": "t"}
    there = codecs.packed(codecs.renamed(F.col("j"), names))
    back = d.withColumn("b", codecs.renamed(codecs.unpacked(there), names, back=True))
    return back.select("doc_id", (F.to_json(F.parse_json("b")) == F.to_json(F.parse_json("j"))).alias("restored"))
