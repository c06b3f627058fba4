"""Byte-level BPE by a rank file: encoding and decoding of whole texts.

A pre-token's merges come from a hierarchical-bitmap rank queue. Each rank has a bucket of positions in a linked list
of parts; a bit for each rank, and a bit for each 64 ranks above, say which buckets hold entries, and find-first-set
gives the next rank. Entries whose pair has changed meanwhile are skipped. One queue serves many pre-tokens at once:
their positions lie in one list that is cut between them, and all positions of a rank merge in one step of array
operations. So a very long pre-token takes about as many steps as there are ranks in it, not as it has bytes.
"""

from __future__ import annotations

import base64
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import map_column, offsets_of, own_name
from tidegrid.llm.words import Remembered, as_binary, bytes_of, encode_column, gather


#: Bytes of text that a task encodes at once.
SLICE_BYTES = 2 << 20


class RankQueue:
    """Buckets of linked-list positions by rank; three levels of 64-bit words tell which ranks have any."""

    def __init__(self, ranks: int) -> None:
        self.levels: list[list[int]] = []
        while ranks > 1:
            ranks = -(-ranks // 64)
            self.levels.append([0] * ranks)
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        if (bucket := self.buckets.get(rank)) is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            word, old = rank >> 6, level[rank >> 6]
            level[word] = old | 1 << (rank & 63)
            if old:
                return
            rank = word

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if len(ranks) == 1:
            return self.push(int(ranks[0]), positions)
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        low = 0
        for rank, high in zip(ranks[np.r_[0, cut]].tolist(), [*cut.tolist(), len(ranks)], strict=True):
            self.push(rank, positions[low:high])
            low = high

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank that has positions, and all of them; find-first-set on each level leads to it."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return None
            at = at << 6 | ((word & -word).bit_length() - 1)
        bucket, rank = self.buckets.pop(at), at
        for level in self.levels:
            left = level[at >> 6] = level[at >> 6] & ~(1 << (at & 63))
            if left:
                break
            at >>= 6
        return rank, bucket[0] if len(bucket) == 1 else np.concatenate(bucket)


class Merger:
    """Merges many pre-tokens at once; no pair crosses from one to the next, so each merges as it would alone."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([k])] for k in range(256)])
        pairs, made = array("q"), array("q")
        #: Ranks whose token can form, with a neighbour, a token of lower rank; their merges go one by one.
        self.unsafe = np.zeros(self.size, bool)
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    made.append(rank)
                for part in (a, b):
                    if part is not None and part > rank:
                        self.unsafe[part] = True
        order = np.argsort(pairs)
        self.odd: dict[bytes, int] = {}
        self.odd_sizes: list[int] = []
        self.keys, self.values = np.append(np.array(pairs, np.int64)[order], np.iinfo(np.int64).max), np.append(np.array(made, np.int64)[order], -1)

        #: Tokens that merging does not reach; only a pre-token that is one as a whole gets it.
        tokens = list(ranks)
        for token, ids in zip(tokens, self.pieces(tokens), strict=True):
            if ids != np.uint32(ranks[token]).tobytes():
                self.odd[token] = ranks[token]
        self.odd_sizes = sorted({*map(len, self.odd)})

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids together; -1: none."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as bytes."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids, counts = self(data, sizes)
        raw, stop = ids.tobytes(), (np.cumsum(counts) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *stop], stop, strict=False)]

    def __call__(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens (their bytes end to end, and the number of each) end to end, and the number of each.

        Always the pair of lowest rank merges, the leftmost of equals first; a pre-token that is a token is that one.
        """
        ids, counts = self.merge(data, sizes)
        if not self.odd:
            return ids, counts
        edges = np.r_[0, np.cumsum(sizes)]
        raw = data.tobytes()
        hits = [(k, rank) for k in np.flatnonzero(np.isin(sizes, self.odd_sizes)).tolist() if (rank := self.odd.get(raw[edges[k] : edges[k + 1]])) is not None]
        if hits:
            at, ranks = map(np.array, zip(*hits, strict=True))
            drop = np.zeros(len(counts), bool)
            drop[at] = True
            first = np.cumsum(counts) - counts
            ids[first[at]] = ranks
            keep = ~np.repeat(drop, counts)
            keep[first[at]] = True
            ids, counts = ids[keep], np.where(drop, 1, counts)
        return ids, counts

    def merge(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(sizes), np.int64)
        every, sizes = sizes, sizes[sizes > 0]
        end = np.cumsum(sizes)
        piece = np.repeat(np.arange(len(sizes)), sizes)
        token = np.append(self.byte[data], 0)
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # position n stands for none
        after[end - 1] = n
        before[end - sizes] = n
        alive = np.ones(n, bool)
        now = np.full(n + 1, -1)
        queue = RankQueue(self.size)

        def renew(at: np.ndarray) -> None:
            then = after[at]
            at, then = at[then < n], then[then < n]
            if len(at):
                rank = now[at] = self.pair_ranks(token[at], token[then])
                found = rank >= 0
                if found.any():
                    queue.push_all(rank[found], at[found])

        renew(np.arange(n))
        while got := queue.pop():
            rank, at = got
            at = at[now[at] == rank]  # others are stale
            if len(at) > 1:
                at = np.unique(at)
                if self.unsafe[rank]:
                    first = np.r_[True, piece[at[1:]] != piece[at[:-1]]]
                    if not first.all():
                        queue.push(rank, at[~first])
                        at = at[first]
                else:
                    chain = np.r_[False, after[at[:-1]] == at[1:]]
                    if chain.any():  # of pairs that overlap, every other one merges
                        index = np.arange(len(at))
                        at = at[(index - np.maximum.accumulate(np.where(chain, 0, index))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            then = after[gone]
            after[at], before[then] = then, at
            token[at] = rank
            alive[gone] = False
            now[gone] = now[at] = -1
            left = before[at]
            renew(np.concatenate([left[left < n], at]))
        counts = np.zeros(len(every), np.int64)
        counts[every > 0] = np.add.reduceat(alive, end - sizes, dtype=np.int64)
        return token[:n][alive].astype("<u4"), counts


@cache
def _merger(path: str) -> Merger:
    return Merger(load_ranks(path))


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Encodes slices of a text column."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.merger, self.find = _merger(path), regex.compile(pattern).findall
        self.words = Remembered(self.letters)

    def alone(self, texts: list[str]) -> list[bytes]:
        found = [*map(self.find, texts)]
        distinct = list(set().union(*found))
        pieces = dict(zip(distinct, self.merger.pieces([p.encode() for p in distinct]), strict=True))
        return [b"".join(map(pieces.__getitem__, f)) for f in found]

    def letters(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.merger(*bytes_of(pc.binary_join_element_wise("", runs, " ")))

    def marks(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.merger(*bytes_of(runs))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return encode_column(texts, self.words, self.marks, self.alone)


@cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids of each whole text in ids_col, as little-endian unsigned 32-bit integers.

    Null texts encode as empty ones; both give no ids. Each row is encoded alone, so repeated rows, ties and groups of
    copies change nothing. path: the rank file, which every executor must be able to open.
    """

    def make():
        work = encoder(path, pattern)
        return lambda texts: [as_binary(*work(texts))]

    return map_column(docs, text_col, make, [(own_name(docs, ids_col), "binary")], SLICE_BYTES)


class Decoder:
    """The bytes that slices of an ids column stand for."""

    def __init__(self, path: str) -> None:
        ranks = load_ranks(path)
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8)

    def __call__(self, ids: np.ndarray, edges: np.ndarray) -> pa.Array:
        """ids end to end, and where each row's begin, with the end."""
        return as_binary(gather(self.flat, self.begin, self.size, ids), np.r_[0, np.cumsum(self.size[ids])][edges])


@cache
def decoder(path: str) -> Decoder:
    return Decoder(path)


def ids_of(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a binary column (null: none) end to end, and where each row's begin, with the end."""
    rows = rows.fill_null(b"")
    edges = offsets_of(rows)
    raw = rows.buffers()[2]
    ids = np.frombuffer(raw, np.uint8)[edges[0] : edges[-1]].view("<u4") if edges[-1] > edges[0] else np.zeros(0, np.uint32)
    return ids, (edges - edges[0]) // 4


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the bytes that the ids in ids_col (null: none) stand for."""

    def make():
        work = decoder(path)
        return lambda rows: [work(*ids_of(rows))]

    return map_column(df, ids_col, make, [(own_name(df, out_col), "binary")])


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of documents, by encoding and then decoding the ids.

    Both are done in one Python worker of a task, slice by slice; the ids that are decoded are those written out.
    """

    def make():
        work, back = encoder(path, pattern), decoder(path)

        def both(texts: pa.Array) -> list[pa.Array]:
            ids = as_binary(*work(texts))
            return [ids, back(*ids_of(ids))]

        return both

    coded = map_column(docs.select("doc_id", "text"), "text", make, [("ids", "binary"), ("decoded", "binary")], SLICE_BYTES, keep=["doc_id"])
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)
