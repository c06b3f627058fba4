"""Language-model scoring by cross-entropy difference.

A target and a background bigram model share one vocabulary, one smoothing and one order, so that their losses on a token
compare; a document's score is the mean over its tokens of target loss less background loss (nats; lower: more like the
target). The vocabulary is every word of the background. Words with at least 1 / `words` of all tokens, at most `words` of
them, are a class of their own each; all others are the class of rare words, each a member by its own count:

    p(w | v) = BIGRAM p(class of w | class of v) p(w | class of w) + UNIGRAM p(w) + UNIFORM / (words of the vocabulary + 1)

and after a class that the model has not seen, the bigram's weight goes to the unigram. So rare words differ from each
other, and their counts, like those of bigrams, are tables that grow with the corpus and are joined by a shuffle. What
tasks hold is bounded: classes, the most frequent bigrams of classes and the most frequent rare words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import read, slices, written

#: Shares of the bigram, unigram and uniform estimates.
BIGRAM, UNIGRAM, UNIFORM = 0.6, 0.35, 0.05

#: Bound on the classes of one word; bound on the bigrams and on the rare words that every task holds (12 MB each), which
#: have a `frequent`th of all tokens each; rows up to which the ids of the target are broadcast.
WORDS, FREQUENT, BROADCAST_ROWS = 50_000, 500_000, 1_000_000
SLICE_BYTES = 8 << 20


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (A-Z lowered, runs without ASCII white space), each token's place in them, and each token's text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    owner = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy())
    flat = split.flatten().dictionary_encode()
    place = flat.indices.to_numpy()
    real = pc.not_equal(pc.binary_length(flat.dictionary), 0).to_numpy(zero_copy_only=False)[place] if len(place) else np.zeros(0, bool)
    return flat.dictionary, place[real], owner[real]


def bigrams(texts: pa.Array, classes: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, each token's place in them, the classes before it and of it, and its text.

    Of V classes of one word, class V is that of rare words, and V + 1 what stands before a text.
    """
    distinct, place, owner = tokens(texts)
    size = len(classes)
    after = pc.index_in(distinct, value_set=classes).fill_null(size).to_numpy().astype(np.int64)[place]
    before = np.r_[size + 1, after[:-1]][: len(after)]
    before[np.r_[True, owner[1:] != owner[:-1]][: len(after)]] = size + 1
    return distinct, place, before, after, owner


def word_counts(marked: DataFrame) -> DataFrame:
    """(word, b, t) over all texts and over the target's; counted in each slice before the shuffle."""

    def run(batches):
        for batch in batches:
            target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for low, part in slices(batch.column(0), SLICE_BYTES):
                distinct, place, owner = tokens(part)
                b, t = (np.bincount(place, x, len(distinct)).astype(np.int64) for x in (None, target[low:][owner]))
                met = pa.array(np.flatnonzero(b))
                yield pa.RecordBatch.from_arrays([distinct.take(met), *(pa.array(x).take(met) for x in (b, t))], names=["word", "b", "t"])

    return marked.mapInArrow(run, "word string, b long, t long").groupBy("word").agg(F.sum("b").alias("b"), F.sum("t").alias("t"))


def bigram_counts(marked: DataFrame, classes) -> DataFrame:
    """(v, w, b, t): occurrences of each bigram of classes in all texts and in the target's."""

    def run(batches):
        for batch in batches:
            target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            size = len(classes.value) + 2
            for low, part in slices(batch.column(0), SLICE_BYTES):
                _, _, before, after, owner = bigrams(part, classes.value)
                key, at = np.unique(before * size + after, return_inverse=True)
                b, t = (np.bincount(at, x, len(key)).astype(np.int64) for x in (None, target[low:][owner]))
                yield pa.RecordBatch.from_arrays([*map(pa.array, (key // size, key % size, b, t))], names=["v", "w", "b", "t"])

    return marked.mapInArrow(run, "v long, w long, b long, t long").groupBy("v", "w").agg(F.sum("b").alias("b"), F.sum("t").alias("t"))


def _loss(share: Column, vocabulary: int) -> Column:
    return -F.ln(share + F.lit(UNIFORM / (vocabulary + 1)))


def _bigram_losses(counts: DataFrame, n: dict[str, int], size: int, vocabulary: int) -> tuple[DataFrame, DataFrame]:
    """(v, w, b, t_loss, b_loss) of bigrams that end in a class of one word; (v, t_rate, b_rate) of all classes v: what an
    occurrence of a rare word adds to its probability after v. What is broadcast has a row for each class.
    """
    sums = lambda by: counts.groupBy(by).agg(F.sum("b").alias(f"{by}b"), F.sum("t").alias(f"{by}t"))
    ends = F.broadcast(sums("w"))
    joined = counts.join(F.broadcast(sums("v")), "v").join(ends, "w")

    def share(m: str) -> Column:
        word = F.col(f"w{m}") / F.lit(float(max(n[m], 1)))
        known = F.lit(BIGRAM) * F.col(m) / F.greatest(F.col(f"v{m}"), F.lit(1)) + F.lit(UNIGRAM) * word
        return F.when(F.col(f"v{m}") > 0, known).otherwise(F.lit(BIGRAM + UNIGRAM) * word)

    losses = joined.filter(F.col("w") < size).select("v", "w", "b", *(_loss(share(m), vocabulary).alias(f"{m}_loss") for m in "tb"))
    each = sums("v").join(F.broadcast(counts.filter(F.col("w") == size).select("v", F.col("b").alias("rare_b"), F.col("t").alias("rare_t"))), "v", "left")
    rare = counts.filter(F.col("w") == size).agg(*(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in "tb")).first()

    def rate(m: str) -> Column:
        own, word = F.coalesce(f"rare_{m}", F.lit(0)) / F.greatest(F.col(f"v{m}"), F.lit(1)), 1 / max(n[m], 1)
        return F.when(F.col(f"v{m}") > 0, F.lit(BIGRAM) * own / F.lit(float(max(rare[m], 1))) + F.lit(UNIGRAM * word)).otherwise(F.lit((BIGRAM + UNIGRAM) * word))

    return losses, each.select("v", *(rate(m).alias(f"{m}_rate") for m in "tb"))


def _place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each of wanted in the sorted keys; -1: none."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return np.where(keys[at] == wanted, at, -1) if len(keys) else np.full(len(wanted), -1)


def _scored(classes, held):
    """(id, h, text) batches -> (id, h, rare, v, key, n, tokens, t, b).

    For each text a row with its tokens and the losses of what the task holds, under a key that nothing has; and a row with
    its number for each other bigram (v and key are its classes) and each other rare word (key is its hash, v the class
    before it).
    """
    import xxhash

    def run(batches):
        (pairs, pair_losses), (words, word_counts), rates, floor = held.value
        for batch in batches:
            size = len(classes.value)
            for low, part in slices(batch.column(2), SLICE_BYTES):
                rows = batch.slice(low, len(part))
                distinct, place, before, after, owner = bigrams(part, classes.value)
                rare = after == size
                odd = np.unique(place[rare])
                hashes, at_word = np.zeros(len(distinct), np.int64), np.full(len(distinct), -1)
                hashes[odd] = np.array([xxhash.xxh64_intdigest(w, 42) for w in distinct.take(pa.array(odd)).to_pylist()], np.uint64).view(np.int64)
                at_word[odd] = _place(words, hashes[odd])
                at = np.where(rare, at_word[place], -1)
                at[~rare] = _place(pairs, before[~rare] * (size + 2) + after[~rare])
                key, known = np.where(rare, hashes[place], after), at >= 0
                pair, word = known & ~rare, known & rare
                sums = []
                for m in (0, 1):
                    loss = np.zeros(len(key))
                    loss[pair] = pair_losses[m][at[pair]]
                    loss[word] = -np.log(rates[m][before[word]] * word_counts[m][at[word]] + floor)
                    sums.append(np.bincount(owner, loss, len(part)))
                left = np.stack([owner, before, rare, key])[:, ~known]
                left = left[:, np.lexsort(left[::-1])]
                fresh = np.flatnonzero(np.r_[True, (left[:, 1:] != left[:, :-1]).any(axis=0)][: left.shape[1]])
                table, n = left[:, fresh], np.diff(np.r_[fresh, left.shape[1]])
                texts = np.r_[np.arange(len(part)), table[0]]
                none, zeros = np.zeros(len(part), np.int64), np.zeros(len(n))
                columns = [
                    np.r_[none, table[2]].astype(bool), np.r_[none - 1, table[1]], np.r_[rows.column(1).to_numpy(), table[3]], np.r_[none, n],
                    pa.array(np.r_[np.bincount(owner, minlength=len(part)), np.zeros(len(n), np.int64)], mask=np.arange(len(texts)) >= len(part)), *(np.r_[s, zeros] for s in sums),
                ]
                ids = [rows.column(k).take(pa.array(texts)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, columns)], names=["id", "h", "rare", "v", "key", "n", "tokens", "t", "b"])

    return run


def cross_entropy_difference(
    docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, frequent: int = FREQUENT,
) -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score) of every document.

    The background model counts all docs, the target model those whose id is in target_ids (one column, any repeats).
    Losses are means over a document's tokens. Null, empty and white texts have no tokens, null losses and score 0. Rows
    that repeat an id and its text give one row; rows of one id with different texts, and the null id, one for each text.
    Without target documents the target model is uniform. Other columns take no part and do not come back.
    """
    target = target_ids.select(F.col(target_ids.columns[0]).alias("target_id")).distinct()
    target = F.broadcast(target) if target.count() <= BROADCAST_ROWS else target
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = rows.join(target, F.col("id") == F.col("target_id"), "left").select("text", F.col("target_id").isNotNull().alias("target"))
    share = 1 / words
    counts = written(word_counts(marked), "words")
    total = counts.agg(F.count(F.lit(1)).alias("size"), *(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in "tb")).first()
    own_class = F.col("b") >= F.lit(share * total.b)
    spark = rows.sparkSession
    names = sorted(r.word for r in counts.filter(own_class).select("word").collect())  # `words` at most
    classes = spark.sparkContext.broadcast(pa.array(names, pa.string()))
    losses, rates = _bigram_losses(written(bigram_counts(marked, classes), "bigrams"), total.asDict(), len(names), total.size)
    losses, rates = written(losses, "losses"), written(rates, "rates")
    rare = counts.filter(~own_class).select(F.xxhash64("word").alias("key"), "t", "b")
    often = F.col("b") * frequent >= F.lit(total.b)  # `frequent` rows at most
    pairs = losses.filter(often).withColumn("key", F.col("v") * (len(names) + 2) + F.col("w")).orderBy("key").toArrow()
    some = rare.filter(often).orderBy("key").toArrow()
    class_rates = np.zeros((2, len(names) + 2))
    found = rates.toArrow()  # a row for each class
    class_rates[:, found["v"].to_numpy()] = [found[f"{m}_rate"].to_numpy() for m in "tb"]
    columns = lambda table, *names: [table[c].to_numpy() for c in names]
    held = spark.sparkContext.broadcast((
        (pairs["key"].to_numpy(), columns(pairs, "t_loss", "b_loss")), (some["key"].to_numpy(), columns(some, "t", "b")), class_rates, UNIFORM / (total.size + 1),
    ))
    hashed = rows.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    parts = hashed.mapInArrow(_scored(classes, held), f"id {kind}, h long, rare boolean, v long, key long, n long, tokens long, t double, b double")
    # one table: losses of the bigrams, which have their v, and counts of the rare words, which have not
    value = lambda c, m: F.col(c).cast("double").alias(f"{m}_value")
    known = losses.filter(~often).select(F.lit(False).alias("rare"), "v", F.col("w").alias("key"), *(value(f"{m}_loss", m) for m in "tb"))
    known = known.union(rare.filter(~often).select(F.lit(True), F.lit(-2).cast("long"), "key", *(value(m, m) for m in "tb")))
    joined = parts.withColumn("at", F.when(F.col("rare"), F.lit(-2)).otherwise(F.col("v"))).join(known.withColumnRenamed("v", "at"), ["rare", "at", "key"], "left")
    joined = joined.join(F.broadcast(rates), "v", "left")
    more = lambda m: F.when(F.col("rare"), _loss(F.col(f"{m}_rate") * F.col(f"{m}_value"), total.size)).otherwise(F.col(f"{m}_value"))
    sums = joined.groupBy("id", "h").agg(
        F.sum("tokens").alias("all"), F.count("tokens").alias("rows"), *(F.sum(F.col(m) + F.coalesce(F.col("n") * more(m), F.lit(0.0))).alias(m) for m in "tb"),
    )
    mean = lambda c: F.when(F.col("all") > 0, F.col(c) / F.col("all"))
    return sums.select(
        F.col("id").alias(id_col), (F.col("all") / F.col("rows")).cast("long").alias("n_tokens"), mean("t").alias("target_loss"),
        mean("b").alias("background_loss"), F.coalesce(mean("t") - mean("b"), F.lit(0.0)).alias("score"),
    )


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as good; background: all."""
    good = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    out = cross_entropy_difference(read(spark, sf_dir, "documents"), good)
    return out.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))


SQL_OP1 = r"""
WITH d AS (SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS w,
  doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS target FROM documents),
t AS (SELECT doc_id, target, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
n AS (SELECT count(*) AS b, count(*) FILTER (target) AS t, count(DISTINCT word) AS size FROM t),
words AS (SELECT word, count(*) AS b, count(*) FILTER (target) AS t, CASE WHEN count(*) >= (1.0::DOUBLE / 50000) * (SELECT b FROM n) THEN word ELSE '' END AS class FROM t GROUP BY word),
k AS (SELECT doc_id, target, pos, word, words.b AS own_b, words.t AS own_t, class AS w FROM t JOIN words USING (word)),
g AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY pos), ' ') AS v FROM k),
c AS (SELECT v, w, count(*) AS b, count(*) FILTER (target) AS t FROM g GROUP BY v, w),
cv AS (SELECT v, sum(b) AS b, sum(t) AS t FROM c GROUP BY v), cw AS (SELECT w, sum(b) AS b, sum(t) AS t FROM c GROUP BY w),
p AS (SELECT v, w,
  CASE WHEN cv.t > 0 THEN 0.6::DOUBLE * c.t / cv.t / greatest(cw.t, 1) + 0.35::DOUBLE / greatest(n.t, 1) ELSE 0.95::DOUBLE / greatest(n.t, 1) END AS rt,
  0.6::DOUBLE * c.b / cv.b / cw.b + 0.35::DOUBLE / n.b AS rb, 0.05::DOUBLE / (n.size + 1) AS floor
  FROM c JOIN cv USING (v) JOIN cw USING (w), n),
l AS (SELECT doc_id, count(*) AS n_tokens, avg(-ln(rt * own_t + floor)) AS lt, avg(-ln(rb * own_b + floor)) AS lb FROM g JOIN p USING (v, w) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_tokens, 0) AS n_tokens, round(lt, 6) AS target_loss, round(lb, 6) AS background_loss, round(coalesce(lt - lb, 0), 6) AS score
FROM d LEFT JOIN l USING (doc_id)
"""
