"""Token ids in Simple-8b word-aligned files.

A 64-bit word is a 4-bit selector and 60 bits of values: the selector says how many values the word packs and in how
many bits each. Two selectors stand for runs of 240 and 120 zeros. A word of selector 15 whose 60 bits are all set is
an escape: the word after it is one raw 64-bit value. A file is a Parquet folder; each of its rows is a block: the
words, and for each document in it the id and the number of tokens; a block knows the place of its first token among
its part's tokens, so blocks decode alone and all words of a block decode at once by selector.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import new_path, offsets_of, partitions, slices
from tidegrid.llm.words import Remembered, encode_column, gather

#: Values in a word and bits of each, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
SELECTOR_OF_COUNT = np.full(256, -1, np.int64)
SELECTOR_OF_COUNT[COUNTS] = np.arange(16)
WIDTHS = sorted({*BITS.tolist()} - {60})
RANK_OF_WIDTH = {w: k for k, w in enumerate(WIDTHS)}
LIMITS = np.array([1 << w for w in WIDTHS], np.uint64)
WIDTH_RANK = np.searchsorted(LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)
ESCAPE = np.uint64((1 << 64) - 1)
LARGEST = (1 << 60) - 2  # what a selector-15 word can hold besides the escape

#: Tokens after which a block ends (with the document in hand), and words that go to the library as one text.
BLOCK_TOKENS, JOINED = 1 << 17, 2000
#: Values that are packed apart from others; a multiple of nearly all of COUNTS.
SEGMENT = 480


def encode_words(values: np.ndarray) -> np.ndarray:
    """uint64 values -> Simple-8b words: from each value on, the selector that packs the most of its segment.

    No word crosses from one segment of SEGMENT values to the next, so that all segments are packed in step.
    """
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    rows = -(-n // SEGMENT)
    # how many of WIDTHS are too narrow for each value; after each segment comes what no word holds
    padded = np.full(rows * SEGMENT, 255, np.uint8)
    padded[:n] = WIDTH_RANK[values] if values.max() < 1 << 16 else np.searchsorted(LIMITS, values, side="right")
    size = np.column_stack([padded.reshape(rows, SEGMENT), np.full(rows, 255, np.uint8)]).ravel()
    widest, span = size, 1  # the largest size in the `span` values from here on
    packs = np.ones(len(size), np.uint8)
    for s in range(14, -1, -1):
        c = int(COUNTS[s])
        if c > min(n, SEGMENT):
            break
        more, left = c - span, len(size) - c + 1  # two overlapping windows of `span` make one of c, as c is at most twice span
        widest, span = np.maximum(widest[:left], widest[more : more + left]), c
        fits = widest <= RANK_OF_WIDTH[int(BITS[s])]
        if not fits.any():  # then none fits that packs more
            break
        packs[:left][fits] = c
    at = np.arange(rows) * (SEGMENT + 1)
    stop = at + SEGMENT
    stop[-1] -= rows * SEGMENT - n
    begins = np.zeros(len(size), bool)
    while len(at):
        begins[at] = True
        at = at + packs[at]
        inside = at < stop
        if not inside.all():
            at, stop = at[inside], stop[inside]
    first = np.flatnonzero(begins)
    packs = packs[first]
    first -= first // (SEGMENT + 1)
    chosen = SELECTOR_OF_COUNT[packs]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(2, 16):
        rows = np.flatnonzero(chosen == s)
        base = first[rows]
        if s == 15:
            words[rows] |= np.minimum(values[base], np.uint64((1 << 60) - 1))
        elif len(rows):
            packed = values[base]
            for k in range(1, int(COUNTS[s])):
                packed |= values[base + k] << np.uint64(k * int(BITS[s]))
            words[rows] |= packed
    raw = first[(chosen == 15) & (values[first] > LARGEST)]
    return np.insert(words, np.searchsorted(first, raw, side="right"), values[raw]) if len(raw) else words


def decode_words(words: np.ndarray) -> np.ndarray:
    """The values of Simple-8b words, all words of a selector at once."""
    words = np.ascontiguousarray(words, np.uint64)
    escape = words == ESCAPE
    raw = np.zeros(len(words), bool)
    if escape.any():  # a raw word may look like an escape: in a run of them every other one is
        at = np.flatnonzero(escape)
        run = np.r_[True, np.diff(at) > 1].cumsum()
        inside = at - at[np.searchsorted(run, run)]
        real = at[inside % 2 == 0]
        raw[real[real + 1 < len(words)] + 1] = True
        escape = np.zeros(len(words), bool)
        escape[real] = True
    kind = (words >> np.uint64(60)).astype(np.int64)
    count = np.where(raw, 1, np.where(escape, 0, COUNTS[kind]))
    place = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    packed = ~(raw | escape)
    for s in range(2, 16):
        rows = np.flatnonzero(packed & (kind == s))
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(int(COUNTS[s]) if len(rows) else 0):
            out[place[rows] + k] = words[rows] >> np.uint64(k * int(BITS[s])) & mask
    out[place[raw]] = words[raw]
    return out


class _Encoder:
    """Ids of text columns by the tokenizers library; of a slice, each distinct word goes to it once."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():
            self.token_bytes[i] = len(name)  # a byte-level name has a letter for each byte

        self.words = Remembered(self.letters)
        #: What the library cuts out of a text before all else; it sees texts with any of them whole.
        self.added = [str(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]

    def alone(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Encodes many runs as one text of words, and cuts the ids where the words' bytes end."""
        if not len(runs):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        sizes = np.diff(offsets_of(runs)) + 1
        cuts = pa.array(np.minimum(np.arange(0, len(runs) + JOINED, JOINED), len(runs)), pa.int32())
        joined = pc.binary_join_element_wise("", pc.binary_join(pa.ListArray.from_arrays(cuts, runs), " "), " ")
        ids = np.frombuffer(b"".join(self.alone(joined.to_pylist())), "<u4")
        stop = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum(sizes)) + 1
        return ids, np.diff(np.r_[0, stop])

    def marks(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows = self.alone(runs.to_pylist())
        return np.frombuffer(b"".join(rows), "<u4"), np.fromiter(map(len, rows), np.int64, len(rows)) // 4

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.fill_null("")
        whole = np.zeros(len(texts), bool)
        for added in self.added:
            whole |= pc.match_substring(texts, added).to_numpy(zero_copy_only=False)
        if not whole.any():
            return encode_column(texts, self.words, self.marks, self.alone)
        ids, edges = encode_column(pc.if_else(pa.array(whole), "", texts), self.words, self.marks, self.alone)
        rows = self.alone(texts.filter(pa.array(whole)).to_pylist())
        begin, size, n = edges[:-1].copy(), np.diff(edges), np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        begin[whole], size[whole] = len(ids) + np.cumsum(n) - n, n
        return gather(np.concatenate([ids, np.frombuffer(b"".join(rows), "<u4")]), begin, size, np.arange(len(texts))), np.r_[0, np.cumsum(size)]


@cache
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


BLOCKS = "part long, block long, first_token long, tokens long, ids array<long>, counts array<long>, words binary"


def _to_blocks(path: str, end_id: int):
    def block(part: int, number: int, first: int, ids: list, rows: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.concatenate(rows)
        columns = [
            pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([first], pa.int64()), pa.array([len(tokens)], pa.int64()),
            pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) for x in rows]], pa.list_(pa.int64())),
            pa.array([encode_words(tokens.astype(np.uint64)).tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = _encoder(path), TaskContext.get().partitionId()
        ids, rows, held, number, first = [], [], 0, 0, 0
        for batch in batches:
            keys = batch.column("k").to_pylist()
            for low, texts in slices(batch.column("t")):
                tokens, edges = encode(texts)
                tokens, edges = np.insert(tokens, edges[1:], end_id), edges + np.arange(len(edges))
                for k, (a, b) in enumerate(pairwise(edges.tolist()), low):
                    ids.append(keys[k])
                    rows.append(tokens[a:b])
                    held += b - a
                    if held >= BLOCK_TOKENS:
                        yield block(part, number, first, ids, rows)
                        ids, rows, held, number, first = [], [], 0, number + 1, first + held
        if rows:
            yield block(part, number, first, ids, rows)

    return run


def write_token_files(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes every whole text, adds end_id, and writes the ids in ascending order of id; returns the folder's path.

    Parts are ranges of ids, so no task sees more than its range. Null texts are empty: the end id alone. The null id
    comes first; rows of one id go by the hash of their text, equal texts as they come. An empty table makes an empty
    folder. tokenizer: a file that every executor can open.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    docs = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    order = [F.col("k").asc_nulls_first(), F.xxhash64("t")]
    ranged = docs.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order)
    ranged.mapInArrow(_to_blocks(tokenizer, end_id), BLOCKS).write.parquet(path)
    return path


def read_token_files(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row for each document of a folder: id, start (tokens of all documents before it), tokens (uint32 bytes)."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of the folder
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("at"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tokens = decode_words(np.frombuffer(row["words"], np.uint64)).astype("<u4")
                ends = np.cumsum(row["counts"])
                begin = ends - row["counts"]
                raw = tokens.tobytes()
                base = row["at"] + row["first_token"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(base + begin, pa.int64()), pa.array([raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), ends.tolist(), strict=True)], pa.binary())],
                    names=[id_col, "start", "tokens"],
                )

    placed = blocks.join(F.broadcast(starts) if parts.count() <= 1_000_000 else starts, "part")
    return placed.select("ids", "counts", "words", "first_token", "at").mapInArrow(run, f"`{id_col}` long, start long, tokens binary")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = write_token_files(docs, vocabularies.path("byte_bpe_50k.json"))
    return read_token_files(spark, path).select(
        "doc_id", "start", (F.octet_length("tokens") / 4).cast("long").alias("n_tokens"), F.crc32("tokens").alias("ids_crc32")
    )
