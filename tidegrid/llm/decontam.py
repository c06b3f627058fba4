"""Benchmark decontamination by size-partitioned MinHash containment search, with DataFrame functions alone.

A document is contaminated by a benchmark item if it holds at least `containment` of the item's distinct word shingles.
Comparing MinHash signatures of both sides fails where a short item lies in a long document, so only items are
sketched: items are partitioned by size (powers of two of their shingle counts), and an item's sketch is its smallest
shingle hashes, as many as its partition needs for any document over the threshold to hold one of them (of n shingles,
n - ceil(containment n) + 1). Documents look up their shingles among the sketches; a hit makes a candidate pair, which
is then verified by exact shingle containment on the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import WORD_GAPS, own_name, stored

#: Rows up to which a side of two short columns is broadcast (about 16 MB), and bytes up to which the items' own text
#: is; what is larger is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 16 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_GAPS), "")


def shingle_hashes(word_hashes: Column, length: int) -> Column:
    """Hashes of all runs of `length` words, from the words' hashes; none if there are fewer words."""
    count = F.size(word_hashes) - (length - 1)
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(word_hashes, i + k) for k in range(length))))


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_shingles(benchmark: DataFrame, id_col: str, text_col: str, length: int, least_words: int) -> DataFrame:
    """item, span (words of a shingle), shingles (distinct, as text), hashes (distinct); items of fewer words go.

    Items whose shingles are the same are one, under the smallest of their ids, so that copies cost one search.
    """
    found = benchmark.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") >= max(least_words, 1))
    found = found.withColumn("span", F.least(F.size("w"), F.lit(length))).withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    text = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("span") + 1), lambda i: F.array_join(F.slice("w", i, F.col("span")), " "))
    hashes = F.lit(None).cast("array<bigint>")
    for k in range(1, length + 1):
        hashes = F.when(F.col("span") == k, shingle_hashes(F.col("h"), k)).otherwise(hashes)
    each = found.select("item", "span", F.sort_array(F.array_distinct(text)).alias("shingles"), F.sort_array(F.array_distinct(hashes)).alias("hashes"))
    return each.groupBy("span", "shingles", "hashes").agg(F.min("item").alias("item"))


def sketches(items: DataFrame, containment: float) -> DataFrame:
    """(h, entry, item, least): each item's smallest hashes, as many as its size partition needs; least: the number of
    shingles below which a document cannot hold enough of any item of the partition.
    """
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("hashes"))))  # a partition: from over half of this number up to it
    need = F.floor(upper * F.lit(1 - containment) + F.lit(1e-9)).cast("int") + 1
    least = F.ceil((F.floor(upper / 2) + 1) * F.lit(containment) - F.lit(1e-9)).cast("int")
    taken = F.slice(F.array_sort("hashes"), F.lit(1), F.least(need, F.size("hashes")))
    return items.select("entry", "item", F.least(least, F.size("hashes")).alias("least"), F.explode(taken).alias("h"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, containment: float = 0.8, length: int = 5, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", least_words: int | None = None,
) -> DataFrame:
    """(id, item, shingles, held, containment): every pair in which a document holds enough of an item.

    Words are lower-cased runs without ASCII white space. Items of fewer than least_words words (by default `length`, as
    shorter ones occur by chance) match nothing; with a smaller least_words an item of fewer words than `length` is one
    shingle. A null text on either side matches nothing. Items with the same shingles are one, under the smallest of
    their ids; of different texts under one item id, the null id too, each is matched alone and the one held most is
    given (of equals, the one of more shingles). Documents that share an id count as one; the null id is one too. Items
    that occur in any part of all documents make one row for each such document and no more. Other columns take no part;
    an empty table on either side gives no rows.
    """
    items = item_shingles(benchmark, item_col, item_text_col, length, length if least_words is None else least_words)
    items = stored(items).withColumn("entry", F.xxhash64("span", "shingles"))
    keys = sketches(items, containment)
    spans = [r.span for r in items.select("span").distinct().collect()]  # at most `length` numbers
    key, text = "__doc", "__text"
    rows = docs.select(F.col(id_col).alias(key), F.col(text_col).alias(text))
    # n: no document has more shingles than words
    hashed = rows.select(key, F.size(words(F.col(text))).alias("n"), F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("w"))
    probes = F.concat(*(shingle_hashes(F.col("w"), k) for k in spans)) if spans else F.array().cast("array<bigint>")
    probe = hashed.select(key, "n", F.explode(probes).alias("h"))
    pairs = stored(probe.join(small(keys, keys.count()), "h").filter(F.col("n") >= F.col("least")).select(F.col(key).alias("__pair"), "entry").distinct())
    marked = F.concat(F.lit(" "), F.array_join(words(F.col(text)), " "), F.lit(" "))
    near = rows.join(small(pairs, pairs.count()), F.col(key).eqNullSafe(F.col("__pair"))).select(key, "entry", marked.alias("m"))
    size = items.agg(F.sum(F.octet_length(F.array_join("shingles", " ")) + 8 * F.size("hashes"))).first()[0] or 0
    exact = near.join(F.broadcast(items) if size <= BROADCAST_BYTES else items, "entry").select(
        F.col(key).alias(id_col), F.col("item").alias(item_col), F.size("shingles").alias("shingles"),
        F.size(F.filter("shingles", lambda s: F.contains(F.col("m"), F.concat(F.lit(" "), s, F.lit(" "))))).alias("held"),
    )
    best = F.max(F.struct((F.col("held") / F.col("shingles")).alias("containment"), "shingles", "held")).alias("best")  # of one text each
    held = exact.groupBy(id_col, item_col).agg(best).select(id_col, item_col, "best.shingles", "best.held", "best.containment")
    return held.filter(F.col("containment") >= containment)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """docs without the contaminated documents."""
    name = own_name(docs, "contaminated")
    ids = stored(contaminated(docs, benchmark, id_col=id_col, **how).select(F.col(id_col).alias(name)).distinct())
    return docs.join(small(ids, ids.count()), docs[id_col].eqNullSafe(ids[name]), "left_anti")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "shingles", "held", F.round("containment", 6).alias("containment"))


SQL_OP7 = r"""
WITH d AS (SELECT doc_id, [x for x in regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents),
b AS (SELECT item_id, [x for x in regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM benchmark),
e AS (SELECT min(item_id) AS item_id, s FROM (SELECT item_id, list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])) AS s FROM b) WHERE len(s) > 0 GROUP BY s),
ds AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) AS x FROM d),
bs AS (SELECT item_id, s, unnest(s) AS x FROM e),
m AS (SELECT doc_id, item_id, len(s) AS shingles, count(*) AS held FROM ds JOIN bs USING (x) GROUP BY doc_id, item_id, s)
SELECT doc_id, item_id, CAST(shingles AS INTEGER) AS shingles, CAST(held AS INTEGER) AS held, round(held / shingles, 6) AS containment
FROM m WHERE held / shingles >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY held / shingles DESC, shingles DESC) = 1
"""
