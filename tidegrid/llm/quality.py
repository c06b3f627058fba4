"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import map_column, offsets_of, own_name, released

#: Byte classes of the statistics; each adds its share of a text's bytes.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:", "shout": b"!?", "bar": b"|",
    "symbol": b"#$%&*@^~_=+<>\\{}[]/`", "wide": bytes(range(128, 256)), "line": b"\n",
}
FEATURES = (*CLASSES, "word_length", "word_spread", "short_words", "repeats", "fresh_words")
D = len(FEATURES)
#: Bytes of text that a task works on at once; the statistics take some twenty bytes for each.
SLICE_BYTES = 1 << 20
#: Bytes and words of ordinary text that each text is taken to hold besides its own, so that the shares of a short one
#: stay moderate: such a word's log length, its variance, and the share of words of three letters or fewer.
EXTRA_BYTES, EXTRA_WORDS, WORD, WORD_VARIANCE, SHORT = 40, 8, 1.5, 0.35, 0.35
#: Every kind of white space as a space.
_ONE_GAP = np.arange(256, dtype=np.uint8)
_ONE_GAP[[9, 10, 11, 12, 13]] = 32
_LUT = {k: np.isin(np.arange(256), list(v)) for k, v in CLASSES.items()}
_PAIR = np.random.default_rng(5).integers(1, 1 << 63, 1 << 16, dtype=np.uint64) << np.uint64(1)
_PAIR[32 << 8 : 33 << 8] = 0  # pairs that begin with a gap belong to no word

def statistics(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """float64 [texts, D] from the bytes of texts laid end to end; edges: where each begins, and the end.

    Shares go through an arcsine of the square root, lengths through a logarithm, so that both spread like a Gaussian.
    A text's size itself is no statistic. Texts without words have the statistics of the extra words alone.
    """
    n = len(edges) - 1
    size = np.diff(edges)
    share = lambda part, whole: np.arcsin(np.sqrt(np.clip(part / whole, 0, 1)))
    counts = np.bincount(np.repeat(np.arange(n) << 8, size) + data, minlength=n << 8).reshape(n, 256)
    out = [share(counts[:, lut].sum(axis=1), size + EXTRA_BYTES) for lut in _LUT.values()]
    plain = _ONE_GAP[data]
    inside = plain != 32
    before = np.r_[False, inside[:-1]] if len(data) else inside
    before[edges[:-1][size > 0]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.r_[inside[1:], False] if len(data) else inside
    after[edges[1:][size > 0] - 1] = False
    length = np.flatnonzero(inside & ~after) + 1 - start
    words = np.diff(np.searchsorted(start, edges))
    owner = np.repeat(np.arange(n), words)
    by_doc = lambda x: np.bincount(owner, x, n)
    # a word is told by the sum of random numbers for its pairs of neighbouring bytes, its end included
    pairs = plain.astype(np.uint16) << 8
    pairs[:-1] |= plain[1:]
    pairs[edges[1:][size > 0] - 1] = plain[edges[1:][size > 0] - 1].astype(np.uint16) << 8 | 32
    word = np.add.reduceat(_PAIR[pairs], start) if len(start) else np.zeros(0, np.uint64)
    same = np.r_[False, (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])][: len(word)]
    key = np.sort(owner.astype(np.uint64) << np.uint64(40) | word >> np.uint64(24))
    new = np.r_[True, key[1:] != key[:-1]][: len(key)]
    distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n) + EXTRA_WORDS
    weight = words + EXTRA_WORDS
    logs = np.log(length)
    mean = (by_doc(logs) + EXTRA_WORDS * WORD) / weight
    square = (by_doc(logs**2) + EXTRA_WORDS * (WORD_VARIANCE + WORD**2)) / weight
    short = by_doc(length <= 3) + EXTRA_WORDS * SHORT
    out += [mean, np.sqrt(np.maximum(square - mean**2, 0)), share(short, weight), share(by_doc(same), weight), np.log(distinct) / np.log(weight)]
    return np.column_stack(out)


def text_statistics(texts: pa.Array) -> np.ndarray:
    texts = texts.fill_null("")
    edges = offsets_of(texts)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[edges[0] : edges[-1]] if raw and edges[-1] > edges[0] else np.zeros(0, np.uint8)
    return statistics(data, edges - edges[0])


@dataclass(frozen=True)
class Model:
    """For each class: log prior, mean, inverse of the Cholesky factor of its shrunk covariance, log determinant."""

    prior: np.ndarray
    mean: np.ndarray
    whiten: np.ndarray
    logdet: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 by the difference of Mahalanobis log-densities."""
        logs = [p - (((x - m) @ w.T) ** 2).sum(axis=1) / 2 - d / 2 for p, m, w, d in zip(self.prior, self.mean, self.whiten, self.logdet, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def solve(count: np.ndarray, total: np.ndarray, square: np.ndarray, to_pooled: float = 0.02, to_sphere: float = 0.002) -> Model:
    """A model from each class's count [2], sums [2, D] and sums of products [2, D, D].

    Each covariance shrinks towards the pooled one, and that towards a multiple of the identity. A class without rows
    takes the pooled moments and the prior of one row, so that a fit on no labels gives 0.5 for every text.
    """
    d, rows = total.shape[1], count.sum()
    pooled_mean = total.sum(0) / max(rows, 1)
    mean = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], pooled_mean)
    cov = [square[k] / count[k] - np.outer(mean[k], mean[k]) if count[k] else np.zeros((d, d)) for k in (0, 1)]
    pooled = (count[0] * cov[0] + count[1] * cov[1]) / max(rows, 1)
    whiten, logdet = [], []
    for k in (0, 1):
        own = (1 - to_pooled) * cov[k] + to_pooled * pooled if count[k] else pooled
        own = (1 - to_sphere) * own + np.eye(d) * max(to_sphere * np.trace(own) / d, 1e-9)
        factor = np.linalg.cholesky(own)
        whiten.append(np.linalg.inv(factor))
        logdet.append(2 * np.log(np.diag(factor)).sum())
    prior = np.log((count + 1) / (rows + 2))
    return Model(prior, mean, np.array(whiten), np.array(logdet))


def moments(labelled: DataFrame, features: str = "features", label: str = "label") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sums and sums of products of each class; summed in the tasks, then in Spark by class and entry."""

    def partial(batches):
        acc = np.zeros((2, 1 + D + D * D))
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(0).values).reshape(-1, D) if batch.num_rows else np.zeros((0, D))
            for k in (0, 1):
                own = x[y == k]
                acc[k] += np.r_[len(own), own.sum(0), (own.T @ own).ravel()]
        k, at = np.divmod(np.arange(acc.size), acc.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(at), pa.array(acc.ravel())], names=["k", "at", "v"])

    parts = labelled.select(F.col(features), F.col(label).cast("int")).mapInArrow(released(partial), "k long, at long, v double")
    acc = np.zeros((2, 1 + D + D * D))
    for row in parts.groupBy("k", "at").agg(F.sum("v").alias("v")).collect():  # twice D squared rows, whatever the input
        acc[row.k, row.at] = row.v
    return acc[:, 0], acc[:, 1 : 1 + D], acc[:, 1 + D :].reshape(2, D, D)


def with_statistics(docs: DataFrame, text_col: str = "text", out_col: str = "features") -> DataFrame:
    """docs with the statistics of each whole text, under a name that docs hasn't (underscores go in front).

    Null texts count as empty ones. Each row stands alone, so repeated rows and groups of copies change nothing; an empty
    table stays empty.
    """

    def make():
        def work(texts):
            x = text_statistics(texts)
            return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * D, pa.int32()), pa.array(x.ravel()))]

        return work

    return map_column(docs, text_col, make, [(own_name(docs, out_col), "array<double>")], SLICE_BYTES)


def held_out(id_column: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from all labelled documents that are not held out. Null ids and labels other than 0 and 1 take no part.

    Statistics, not texts, go to the labels. The model is a few kilobytes. A document that repeats, or that has several
    labels, counts once for each pair of rows. Without labelled documents, an empty table included, every text scores 0.5.
    """
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out(F.col(id_col)))
    rows = with_statistics(docs.select(id_col, text_col).filter(~held_out(F.col(id_col)))).select(id_col, "features")
    return solve(*moments(rows.join(known, id_col)))


def with_score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with the score (0 to 1; higher: class 1 likelier) of each whole text, under a name that docs hasn't.

    Null texts score as empty ones, equal texts alike; repeated rows each keep a row, an empty table stays empty.
    """

    def make():
        return lambda texts: [pa.array(model.score(text_statistics(texts)))]

    return map_column(docs, text_col, make, [(own_name(docs, out_col), "double")], SLICE_BYTES)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = with_score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
