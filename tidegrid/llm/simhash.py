"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints that differ in at most `radius` bits agree on all but `radius` of any m blocks of bits, so each distinct
fingerprint goes into one bucket for every choice of m - radius blocks, and only bucket mates are compared. In a
bucket the fingerprints are stored vertically, a plane for each bit. A fingerprint meets 64 others at once: carry-save
counters add up the differing bits lane by lane, overflow marks the lanes beyond the radius, and words in which all
lanes have overflowed are abandoned before the remaining planes are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import map_column, own_name, partitions, stored
from tidegrid.llm.components import connected_components

#: Rows that a bucket is compared in; a larger one is dealt into tiles, and each pair of tiles is a task's group.
TILE = 4096
ABANDON_EVERY, SLICE, CHUNK = 8, 1 << 16, 1 << 15


def shingle_hashes(text: str | None, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of the text's shingles, repeats included; of the whole sequence if it has fewer words; none if none."""
    import xxhash

    found = (text or "").encode().lower().split()
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed)] if found else [], np.uint64)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip((ends - sizes).tolist(), ends[words - 1 :].tolist(), strict=False)
    return np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half the hashes; no hashes: zero. As a signed 64-bit number."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    on = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(on, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint", words: int = 3, seed: int = 42) -> DataFrame:
    """docs with a 64-bit fingerprint of each whole text, under a name that docs hasn't (underscores go in front).

    Null, empty and white texts have fingerprint zero. Rows are marked alone; an empty table stays empty.
    """

    def make():
        return lambda texts: [pa.array([fingerprint(shingle_hashes(t, words, seed)) for t in texts.to_pylist()], pa.int64())]

    return map_column(docs, text_col, make, [(own_name(docs, out_col), "long")])


def bit_planes(values: np.ndarray) -> np.ndarray:
    """uint64 [64 W, words] of values [n, W]: bit k of word w of plane b is bit b of value 64 w + k."""
    padded = np.zeros((-(-len(values) // 64) * 64, values.shape[1]), "<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within_radius(queries: np.ndarray, planes: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For queries[i] ([n, W]) against the 64 values of word[i] (those in the mask lanes[i]), each within its radius[i]: the
    i left, and their lanes near.
    """
    left = np.arange(len(queries))
    counter_bits = max(1, int(radius.max(initial=0)).bit_length())
    bias = (1 << counter_bits) - 1 - radius  # so that the counter overflows just beyond the radius
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    zero, one = np.uint64(0), np.uint64(1)
    counters = [np.where(bias >> k & 1, full, zero) for k in range(counter_bits)]
    over = ~lanes

    def differs(bit: int) -> np.ndarray:
        return planes[bit][word] ^ (zero - (queries[:, bit >> 6] >> np.uint64(bit & 63) & one))

    for bit in range(0, len(planes), 2):
        a, b, low = differs(bit), differs(bit + 1), counters[0]
        half = low ^ a
        carry = (low & a) | (half & b)
        counters[0] = half ^ b
        for k in range(1, counter_bits):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if (bit + 2) % ABANDON_EVERY == 0:
            keep = np.flatnonzero(over != full)
            if len(keep) < len(left):
                left, over, queries, word = left[keep], over[keep], queries[keep], word[keep]
                counters = [c[keep] for c in counters]
            if not len(left):
                break
    return left, ~over


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label after joining a[i] and b[i]; the label of an item is the smallest item it is joined with."""
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while (deeper := label[label]).tobytes() != label.tobytes():
            label = deeper
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def near_pairs(values: np.ndarray, start: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the values ([n, W]) of one run (start[i]: where the run of i begins), j before i, within radius[i]."""
    planes, at = bit_planes(values), np.arange(len(values))
    n_words = np.where(at > start, (at - 1 >> 6) - (start >> 6) + 1, 0)
    total = np.cumsum(n_words)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for low in range(0, int(total[-1]) if len(total) else 0, SLICE):
        pair = np.arange(low, min(low + SLICE, int(total[-1])))
        query = np.searchsorted(total, pair, side="right")
        word = (start[query] >> 6) + pair - (total[query] - n_words[query])
        begin, end = np.maximum(start[query] - 64 * word, 0), np.minimum(query - 64 * word, 64)
        upto = np.where(end >= 64, full, (np.uint64(1) << (end & 63).astype(np.uint64)) - np.uint64(1))
        lanes = upto & ~((np.uint64(1) << begin.astype(np.uint64)) - np.uint64(1))
        left, near = within_radius(values[query], planes, word, lanes, radius[query])
        bits = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, lane = np.nonzero(bits)
        yield query[left[row]], 64 * word[left[row]] + lane


def links(values: np.ndarray, start: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within the radius in each run of a bucket.

    One link at most for each value, to the smallest of its local component, so nothing grows with a bucket's square.
    """
    label = np.arange(len(values))
    for i, j in near_pairs(values.reshape(-1, 1), start, np.full(len(values), radius)):
        label = unite(label, i, j)
    found = np.flatnonzero(label != np.arange(len(values)))
    return found, label[found]


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = CHUNK) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by their first column as tables of whole groups, of about so many rows at least; where each row's begins."""
    held: list[pa.Table] = []

    def joined() -> tuple[pa.Table, np.ndarray]:
        table = pa.concat_tables(held).combine_chunks()
        g = table.column(0).to_numpy()
        fresh = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        return table, np.repeat(fresh, np.diff(np.r_[fresh, len(g)]))

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if sum(map(len, held)) >= rows and len(table):
            g = table.column(0).to_numpy()
            change = np.flatnonzero(np.diff(np.r_[held[-1].column(0)[-1].as_py(), g]))
            if len(change):  # all groups held so far end before the last change
                cut = int(change[-1])
                held.append(table.slice(0, cut))
                yield joined()
                held, table = [], table.slice(cut)
        if len(table):
            held.append(table)
    if held:
        yield joined()


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in whole_groups(batches):
            v = table.column(1).to_numpy()
            a, b = links(v.view(np.uint64), start, radius)
            yield pa.RecordBatch.from_arrays([pa.array(v[a]), pa.array(v[b])], names=["src", "dst"])

    return run


def in_tiles(rows: DataFrame, bucket: str, node: str, tile: int = TILE, counted: DataFrame | None = None) -> DataFrame:
    """rows with g in front, sorted by it in their partitions: any two rows of a bucket share a g, and none has over about
    two tiles of rows. A larger bucket is dealt into tiles by its nodes, and each two tiles meet in a group. counted: a
    cheaper table of the same buckets, if there is one.
    """
    large = (counted or rows).groupBy(bucket).count().filter(F.col("count") > tile).select(F.col(bucket).alias("__b"), F.ceil(F.col("count") / tile).alias("__n"))
    tiled = rows.join(large, F.col(bucket) == F.col("__b"), "left").withColumn("__t", F.pmod(F.xxhash64(F.lit(7), node), F.coalesce("__n", F.lit(1))))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__n", F.lit(1)).cast("long") - 1))
    met = tiled.withColumn("__u", other).withColumn("g", F.xxhash64(bucket, F.least("__t", "__u"), F.greatest("__t", "__u")))
    return met.select("g", *rows.columns).repartition(partitions(rows), "g").sortWithinPartitions("g")


def near_links(values: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(src, dst): links that join all distinct 64-bit values within the radius; values: one long column, distinct."""
    name = values.columns[0]
    count = values.count()
    blocks = next((m for m in range(radius + 1, radius + 4) if count >> (64 * (m - radius) // m) <= 64), radius + 4)
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << edges[j + 1]) - 1) ^ ((1 << edges[j]) - 1) for j in chosen)
        keys.append(F.xxhash64(F.lit(k), F.col(name).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    # buckets by hash: two that fall together are compared as one, and all 64 bits count
    dealt = values.select(F.col(name).alias("v"), F.explode(F.array(*keys)).alias("bucket"))
    return in_tiles(dealt, "bucket", "v", tile).select("g", "v").mapInArrow(_compare(radius), "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """(id, fingerprint long, component_id): the smallest id that can be reached over links, its own included.

    Documents of one fingerprint are linked, so a group of copies of any size is one node; links join distinct
    fingerprints only. Null, empty and white texts have fingerprint zero and are linked like any other. Rows that
    repeat an id each get a row; the null id is a document like any other, and comes before all in "smallest".
    """
    marked = stored(with_fingerprints(docs.select(id_col, text_col), text_col, "__fp", words, seed).select(F.col(id_col), "__fp"))
    nodes = stored(marked.groupBy("__fp").agg(F.min(F.struct(F.col(id_col).isNotNull(), F.col(id_col))).alias("__first")))
    roots = connected_components(near_links(nodes.select("__fp"), radius))
    with_root = nodes.join(roots, nodes["__fp"] == roots["node"], "left").select("__fp", "__first", F.coalesce("root", "__fp").alias("__root"))
    firsts = with_root.groupBy("__root").agg(F.min("__first").alias("__least"))
    named = with_root.join(firsts, "__root").select("__fp", F.col("__least")[id_col].alias("component_id"))
    return marked.join(named, "__fp").select(id_col, F.col("__fp").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without near copies: of each group the document with the smallest id stays, and of rows with that id all."""
    groups = near_duplicates(docs, id_col, text_col, **how)
    gone = groups.filter(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(own_name(docs, "gone"))).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone[gone.columns[0]]), "left_anti")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    groups = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
