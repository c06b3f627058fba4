"""Quality rules: thresholds that each language and source sets itself, from quantile sketches that merge by addition.

A sketch counts values in buckets that widen with the value (the leading bits of an integer), so a quantile is off by one
64th at most, two sketches merge by adding their counts, and neither the order of rows nor a task that runs again changes
a threshold.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import map_column, own_name, read, written
from tidegrid.llm.words import bytes_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Bytes of text that a task works on at once; the counts take some sixty bytes for each.
SLICE_BYTES = 1 << 20

#: What the thresholds are on: name -> (count, unit); the value is unit * count / n_words, whole.
RATES = {"length": ("word_chars", 1000), "symbols": ("n_symbols", 10_000), "lines": ("n_dup_lines", 10_000), "repeats": ("n_repeat_words", 10_000)}
#: Rates of which a low value counts against a text too.
TWO_SIDED = ("length",)
#: A text fails beyond the quartile by so many interquartile ranges, and so many units besides, so that a group of like
#: texts, whose quartiles meet, does not reject what is hardly different.
RANGES = 3
SLACK = {"length": 1000, "symbols": 1000, "lines": 1000, "repeats": 2000}
#: Groups of fewer texts take the thresholds of their language, and languages of fewer those of all texts.
LEAST_TEXTS = 50
#: Leading bits that a bucket keeps.
BITS = 7

_GAP = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))


def _ids(strings: pa.Array) -> np.ndarray:
    return strings.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each distinct pair, from 0."""
    return np.unique(a * (int(b.max()) + 1 if len(b) else 1) + b, return_inverse=True)[1]


def text_counts(texts: pa.Array) -> list[np.ndarray]:
    """COUNTS of each text; a null one counts as empty."""
    texts = texts.fill_null("")
    data, sizes = bytes_of(texts)
    n, edges = len(texts), np.r_[0, np.cumsum(sizes)]
    inside = ~_GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[edges] = True
    begins = inside & (edge[:-1] | ~np.r_[False, inside[:-1]])
    starts = np.flatnonzero(begins)
    words = np.diff(np.searchsorted(starts, edges))
    by_text = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][edges])
    chars, symbols = by_text(inside & (data & 0xC0 != 0x80)), by_text(_SYMBOL[data])
    # the words alone, end to end, as a string column
    at = np.r_[0, np.cumsum(inside)][starts]
    places = np.r_[at, inside.sum()].astype(np.int64)
    word = _ids(pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(data[inside].tobytes())]))
    owner = np.repeat(np.arange(n), words)
    return [words, chars, symbols, _repeated_lines(texts), np.bincount(owner[_in_repeats(word, owner)], minlength=n)]


def _in_repeats(word: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each word whether it lies in a window of WINDOW words that its text has twice or more. Windows are told by exact numbers."""
    whole = np.zeros(len(word), bool)
    if len(word) < WINDOW:
        return whole
    seen = word
    for k in range(1, WINDOW):
        seen = _pairs(seen[:-1], word[k:])
    first = np.flatnonzero(owner[: len(seen)] == owner[WINDOW - 1 :])
    _, back, count = np.unique(owner[first] * (int(seen.max()) + 1) + seen[first], return_inverse=True, return_counts=True)
    twice = first[count[back] > 1]
    step = np.zeros(len(word) + 1, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + WINDOW, -1)
    return np.cumsum(step)[:-1] > 0


def _repeated_lines(texts: pa.Array) -> np.ndarray:
    """How many lines of each text have a word and equal an earlier line."""
    lines = pc.split_pattern(texts, "\n")
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    coded = lines.flatten().dictionary_encode()
    worded = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    line = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner, line = owner[worded[line]], line[worded[line]]
    distinct = np.unique(owner * (len(coded.dictionary) + 1) + line) // (len(coded.dictionary) + 1)
    return np.bincount(owner, minlength=len(texts)) - np.bincount(distinct, minlength=len(texts))


def with_counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with COUNTS of each whole text, longs, under names that docs hasn't.

    Words are runs without ASCII white space. Null texts count as empty. Each row stands alone: repeated rows keep a row each.
    """
    make = lambda: lambda texts: [pa.array(c.astype(np.int64)) for c in text_counts(texts)]
    return map_column(docs, text_col, make, [(own_name(docs, c), "long") for c in COUNTS], SLICE_BYTES, keep)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def rate(name: str) -> Column:
    count, unit = RATES[name]
    return F.floor(F.try_divide(F.lit(unit) * F.col(count), F.col("n_words"))).cast("long")


def bucket(value: Column) -> Column:
    """The least value of the bucket of a whole number, 0 or more: its BITS leading bits."""
    drop = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(counts: DataFrame, groups: list[str]) -> DataFrame:
    """groups, rate, bucket and n: of the texts that don't fail already, how many have a rate in the bucket.

    Sketches of parts of a table merge by adding n. A group has some hundred buckets at most, however many texts.
    """
    fine = counts.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rate"), bucket(rate(r)).alias("bucket")) for r in RATES))).alias("r")
    return fine.select(*groups, each).groupBy(*groups, "r.rate", "r.bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """groups, rate, texts, low, high: the first bucket at which a quarter, and three quarters, of the texts are reached."""
    order = Window.partitionBy(*groups, "rate").orderBy("bucket")
    run = sketch.withColumn("upto", F.sum("n").over(order)).withColumn("texts", F.sum("n").over(Window.partitionBy(*groups, "rate")))
    at = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("texts"), F.col("bucket")))
    return run.groupBy(*groups, "rate").agg(F.first("texts").alias("texts"), at(1).alias("low"), at(3).alias("high"))


def thresholds(counts: DataFrame, groups: tuple[str, str] = ("lang", "source"), least_texts: int = LEAST_TEXTS) -> DataFrame:
    """groups with from_<rate> (two-sided rates) and upto_<rate>: what a text of the group may have.

    One row for each group of the texts that don't fail by the fixed rules. Small groups take the thresholds of their first
    column, those of few texts the whole table's; all three come of the same sketch, merged. Null groups are groups.
    """
    outer, inner = groups
    own = sketches(counts, [outer, inner])
    wide = own.groupBy(outer, "rate", "bucket").agg(F.sum("n").alias("n"))
    whole = wide.groupBy("rate", "bucket").agg(F.sum("n").alias("n"))
    levels = [(quartiles(own, [outer, inner]), [outer, inner]), (quartiles(wide, [outer]), [outer]), (quartiles(whole, []), [])]
    out = levels[0][0].withColumnRenamed("texts", "texts0").withColumnRenamed("low", "low0").withColumnRenamed("high", "high0")
    for k, (table, keys) in enumerate(levels[1:], 1):
        named = table.select(*(F.col(c).alias(f"__{c}") for c in [*keys, "rate"]), *(F.col(c).alias(f"{c}{k}") for c in ("texts", "low", "high")))
        out = out.join(named, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*keys, "rate"])), "left").drop(*(f"__{c}" for c in [*keys, "rate"]))
    pick = lambda c: F.when(F.col("texts0") >= least_texts, F.col(f"{c}0")).when(F.col("texts1") >= least_texts, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    out = out.withColumn("low", pick("low")).withColumn("high", pick("high"))
    slack = reduce(lambda w, r: w.when(F.col("rate") == r, SLACK[r]), RATES, F)
    reach = RANGES * (F.col("high") - F.col("low")) + slack
    limits = out.select(outer, inner, "rate", (F.col("low") - reach).alias("from"), (F.col("high") + reach).alias("upto"))
    one = lambda r, c: F.max(F.when(F.col("rate") == r, F.col(c))).alias(f"{c}_{r}")
    return limits.groupBy(outer, inner).agg(*(one(r, "from") for r in TWO_SIDED), *(one(r, "upto") for r in RATES))


def with_verdicts(counts: DataFrame, limits: DataFrame, groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """counts with base_failed and kept; limits: of thresholds(), written, so that Spark knows their size.

    Spark broadcasts small limits and else shuffles both sides, where it splits a hot group. A text that fails by the
    fixed rules is not kept, nor is one outside its group's thresholds.
    """
    named = limits.select(*(F.col(c).alias(f"__{c}") if c in groups else F.col(c) for c in limits.columns))
    rows = counts.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    rows = rows.join(named, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in groups)), "left")
    fine = [rate(r) <= F.col(f"upto_{r}") for r in RATES] + [rate(r) >= F.col(f"from_{r}") for r in TWO_SIDED]
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(reduce(lambda a, b: a & b, fine), F.lit(False)))
    return rows.withColumn("kept", kept).drop(*named.columns)


def op12_rules(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    counts = written(with_counts(docs, keep=["doc_id", "lang", "source"]), "rule-counts")
    limits = written(thresholds(counts), "rule-limits")
    return with_verdicts(counts, limits).select("doc_id", *COUNTS, "base_failed", "kept")


def _sql_rates(alias: str = "") -> dict[str, str]:
    return {r: f"CAST(floor({unit} * {alias}{count} / {alias}n_words) AS BIGINT)" for r, (count, unit) in RATES.items()}


SQL_OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT k, regexp_extract_all(text, '[^ 	-
]+') AS ws FROM d)),
g AS (SELECT k, i, [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] AS g, lead(w, 4) OVER o AS last FROM w WINDOW o AS (PARTITION BY k ORDER BY i)),
twice AS (SELECT k, i FROM g WHERE last IS NOT NULL QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
rep AS (SELECT k, count(DISTINCT i + j) AS n FROM twice, range(5) t(j) GROUP BY k),
words AS (SELECT k, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY k),
lines AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^ 	-
]') GROUP BY k),
c AS (SELECT doc_id, lang, source, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN words USING (k) LEFT JOIN dup USING (k) LEFT JOIN rep USING (k)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
r AS (SELECT lang, source, unnest([{", ".join(f"{{'rate': '{r}', 'v': {x}}}" for r, x in _sql_rates().items())}]) AS r FROM f WHERE NOT base_failed),
b AS (SELECT lang, source, r.rate AS rate, (r.v >> s) << s AS b FROM (SELECT *, greatest(CASE WHEN r.v = 0 THEN 1 ELSE length(ltrim(bin(r.v), '0')) END - {BITS}, 0) AS s FROM r)),
h AS (SELECT lang, source, rate, b, count(*) AS n, grouping(lang, source) AS lvl FROM b GROUP BY GROUPING SETS ((lang, source, rate, b), (lang, rate, b), (rate, b))),
u AS (SELECT *, sum(n) OVER (PARTITION BY lvl, lang, source, rate ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lvl, lang, source, rate) AS t FROM h),
q AS (SELECT lvl, lang, source, rate, any_value(t) AS t, min(b) FILTER (4 * upto >= t) AS low, min(b) FILTER (4 * upto >= 3 * t) AS high FROM u GROUP BY lvl, lang, source, rate),
l AS (SELECT a.lang, a.source, a.rate,
    CASE WHEN a.t >= {LEAST_TEXTS} THEN a.low WHEN m.t >= {LEAST_TEXTS} THEN m.low ELSE z.low END AS low, CASE WHEN a.t >= {LEAST_TEXTS} THEN a.high WHEN m.t >= {LEAST_TEXTS} THEN m.high ELSE z.high END AS high
  FROM q a JOIN q m ON m.lvl = 1 AND m.rate = a.rate AND m.lang IS NOT DISTINCT FROM a.lang JOIN q z ON z.lvl = 3 AND z.rate = a.rate WHERE a.lvl = 0),
fences AS (SELECT lang, source, rate, low - {RANGES} * (high - low) - slack AS lo, high + {RANGES} * (high - low) + slack AS hi
  FROM (SELECT *, CASE rate {" ".join(f"WHEN '{r}' THEN {x}" for r, x in SLACK.items())} END AS slack FROM l)),
t AS (SELECT lang, source, {", ".join(f"max(hi) FILTER (rate = '{r}') AS hi_{r}, max(lo) FILTER (rate = '{r}') AS lo_{r}" for r in RATES)} FROM fences GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"{x} <= hi_{r}" for r, x in _sql_rates("f.").items())} AND {" AND ".join(f"{_sql_rates('f.')[r]} >= lo_{r}" for r in TWO_SIDED)} AS kept
FROM f LEFT JOIN t ON t.lang IS NOT DISTINCT FROM f.lang AND t.source IS NOT DISTINCT FROM f.source
"""
