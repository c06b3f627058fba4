"""Vector code compression: vectors as the numbers of codebook entries, in whole numbers alone.

Each part of a vector goes to the nearest entry of its position's codebook. Entries are filed by cells: each coordinate is
kept in a few bits, the cell it lies in. For a part, one table for each coordinate says how near and how far a cell's
entries can be; sums over the coordinates bound each entry's distance, and only entries whose lower bound does not exceed
the least upper bound are compared exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import own_name, read, with_fields, written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: A component x becomes floor(SCALE * x).
SCALE = 256
#: Bits of a coordinate's cell.
CELL_BITS = 4
#: Vectors that a task bounds at once.
STEP = 4096
#: Beyond this a whole number's squares may not fit 64 bits.
LARGEST = 1 << 27


@dataclass(frozen=True)
class Codebooks:
    """entries: int64 [parts, entries, part size]; cell: the cell of each coordinate; least, most: the bounds of each cell."""

    entries: np.ndarray
    cell: np.ndarray
    least: np.ndarray
    most: np.ndarray

    @staticmethod
    def of(entries: np.ndarray) -> Codebooks:
        """Cells hold equal numbers of a coordinate's distinct values, as near as may be, and reach from the least to the most."""
        parts, n, size = entries.shape
        cells = 1 << CELL_BITS
        cell = np.zeros(entries.shape, np.int64)
        least, most = np.zeros((parts, size, cells), np.int64), np.zeros((parts, size, cells), np.int64)
        for p in range(parts):
            for j in range(size):
                values, at = np.unique(entries[p, :, j], return_inverse=True)
                own = np.arange(len(values)) * min(cells, len(values)) // max(len(values), 1)
                cell[p, :, j] = own[at]
                for c in range(own[-1] + 1 if len(own) else 0):
                    least[p, j, c], most[p, j, c] = values[own == c][[0, -1]]
        return Codebooks(entries, cell, least, most)

    def digest_text(self) -> str:
        return ",".join(map(str, self.entries.ravel().tolist()))

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[rows, parts]: the nearest entry (ties: the lower index) of each part, and its squared distance."""
        rows, (parts, _, size) = len(vectors), self.entries.shape
        code, far = np.zeros((rows, parts), np.int64), np.zeros((rows, parts), np.int64)
        for low in range(0, rows, STEP):
            for p in range(parts):
                own = vectors[low : low + STEP, p * size : (p + 1) * size]
                code[low : low + STEP, p], far[low : low + STEP, p] = self._nearest(p, own)
        return code, far

    def _nearest(self, p: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.entries.shape[1]
        lower, upper = np.zeros((len(own), n), np.int64), np.zeros((len(own), n), np.int64)
        for j in range(own.shape[1]):
            below, above = self.least[p, j] - own[:, j, None], own[:, j, None] - self.most[p, j]
            near = np.maximum(np.maximum(below, above), 0) ** 2
            wide = np.maximum(np.abs(below), np.abs(above)) ** 2
            lower += near[:, self.cell[p, :, j]]
            upper += wide[:, self.cell[p, :, j]]
        row, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        exact = ((own[row] - self.entries[p, entry]) ** 2).sum(axis=1)
        best = np.minimum.reduceat(exact, np.searchsorted(row, np.arange(len(own))))
        hit = np.flatnonzero(exact == best[row])
        return entry[hit[np.searchsorted(row[hit], np.arange(len(own)))]], best


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def whole_numbers(column, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The components of an Arrow list column as floor(SCALE * x), [rows, width], and which rows have width components."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"a component lies beyond {LARGEST // SCALE}")
    width = width if width is not None else int(sizes.max(initial=0))
    fits = sizes == width
    return flat[np.repeat(fits, sizes)].astype(np.int64).reshape(int(fits.sum()), width), fits


def _split(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Zeros behind, so that parts of one size cover the vectors."""
    return np.pad(vectors, ((0, 0), (0, -vectors.shape[1] % parts)))


def first_entries(vectors: DataFrame, id_col: str, vector_col: str, parts: int = PARTS, entries: int = ENTRIES) -> tuple[Codebooks, int]:
    """Codebooks of the rows with the smallest ids (null ids last, ties by the vector), and the number of their components.

    At most `entries` rows come to the driver. The first row says how many components a vector has; rows of other numbers
    take no part.
    """
    ordered = vectors.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("k"), F.col(vector_col).alias("v")).orderBy(F.col("k").asc_nulls_last(), "v")
    first = ordered.limit(1).collect()
    width = len(first[0].v) if first else 0
    rows = ordered.filter(F.size("v") == width).limit(entries).collect()
    taken = _split(whole_numbers(pa.array([r.v for r in rows], pa.list_(pa.float64())), width)[0], parts)
    return Codebooks.of(taken.reshape(len(rows), parts, taken.shape[1] // parts).transpose(1, 0, 2)), width


def moved(vectors: DataFrame, vector_col: str, books: Codebooks, width: int) -> Codebooks:
    """books with each entry at the floor of the mean of the parts that are nearest to it; unused entries stay.

    Each task sums what it assigns, so that a task's entries, not its rows, are shuffled.
    """
    parts, n, size = books.entries.shape

    def partial(batches):
        total, count = np.zeros((parts * n, size), np.int64), np.zeros(parts * n, np.int64)
        for batch in batches:
            rows = _split(whole_numbers(batch.column(0), width)[0], parts)
            at = (books.assign(rows)[0] + np.arange(parts) * n).ravel()
            np.add.at(total, at, rows.reshape(-1, size))
            count += np.bincount(at, minlength=parts * n)
        used = np.flatnonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * size, pa.int32()), pa.array(total[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), sums], names=["at", "n", "total"])

    sums = vectors.filter(usable(F.col(vector_col))).select(vector_col).mapInArrow(partial, "at long, n long, total array<long>")
    whole = sums.groupBy("at").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[j]) for j in range(size))).alias("total"))
    entries = books.entries.copy().reshape(parts * n, size)
    for r in whole.collect():  # one row for each entry in use, whatever the input
        entries[r["at"]] = np.array(r.total, np.int64) // r.n
    return Codebooks.of(entries.reshape(parts, n, size))


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, int]:
    """Codebooks from all usable rows, and the number of components. An empty table gives codebooks without entries."""
    books, width = first_entries(vectors, id_col, vector_col, parts, entries)
    for _ in range(rounds if books.entries.size else 0):
        books = moved(vectors, vector_col, books, width)
    return books, width


def with_codes(vectors: DataFrame, books: Codebooks, width: int, vector_col: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The usable rows of vectors (columns in keep) with code (binary, a byte for each part) and error (long).

    error: the squared distances of the parts, summed. Rows whose vector is null or holds null or non-finite components go;
    rows with another number of components than `width` stay, with nulls. A component beyond 2^19 is an error, as its
    squares would not fit. Equal vectors get equal codes, repeated rows a row each. Added columns whose names are taken get
    underscores in front.
    """
    kept = vectors.columns if keep is None else keep
    code, error = own_name(vectors.select(*kept), "code"), own_name(vectors.select(*kept), "error")
    vec = "__vector"
    rows = vectors.filter(usable(F.col(vector_col))).select(*kept, F.col(vector_col).alias(vec))
    parts = len(books.entries)

    def run(batches):
        for batch in batches:
            found, fits = whole_numbers(batch.column(len(kept)), width)
            codes, errors = np.zeros((batch.num_rows, parts), np.uint8), np.zeros(batch.num_rows, np.int64)
            if books.entries.size:
                codes[fits], far = books.assign(_split(found, parts))
                errors[fits] = far.sum(axis=1)
            places = pa.py_buffer((np.arange(batch.num_rows + 1) * parts).astype(np.int32).tobytes())
            as_code = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, places, pa.py_buffer(codes.tobytes())])
            none = pa.array(~fits)
            made = [pc.if_else(none, None, as_code), pa.array(errors, mask=~fits)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *made], names=[*kept, code, error])

    return rows.mapInArrow(run, with_fields(vectors.select(*kept), [(code, "binary"), (error, "long")]))


def with_label_error(coded: DataFrame, label_col: str = "label", error_col: str = "error") -> DataFrame:
    """coded with label_error: error summed over the rows of one label; null labels are one.

    The sums are written first: Spark broadcasts them if they are few, and else splits a hot label when it joins.
    """
    name = own_name(coded, "label_error")
    sums = written(coded.groupBy(F.col(label_col).alias("__label")).agg(F.sum(error_col).alias(name)), "label-errors")
    return coded.join(sums, F.col(label_col).eqNullSafe(F.col("__label"))).drop("__label")


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books, width = fit(vectors)
    coded = written(with_codes(vectors, books, width, keep=["vec_id", "label"]), "vector-codes")
    return with_label_error(coded).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.sha2(F.lit(books.digest_text()), 256).alias("codebooks_sha256")
    )


def _sql_round(before: str, k: int) -> str:
    """SQL of one assignment and of the entries that it moves."""
    return f"""
near{k} AS MATERIALIZED (SELECT r, p, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (
    SELECT x.r, x.p, c.e, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN {before} c ON c.p = x.p) GROUP BY r, p),
sum{k} AS (SELECT p, e, j, sum(v) AS s, count(*) AS n FROM (SELECT x.p, n.e, unnest(x.v) AS v, unnest(range(len(x.v))) AS j FROM x JOIN near{k} n ON n.r = x.r AND n.p = x.p) GROUP BY p, e, j),
book{k} AS MATERIALIZED (SELECT c.p, c.e, coalesce(s.v, c.v) AS v FROM {before} c LEFT JOIN (
    SELECT p, e, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY j) AS v FROM sum{k} GROUP BY p, e) s ON s.p = c.p AND s.e = c.e)"""


SQL_OP13 = f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda z: CAST(floor(z::DOUBLE * {SCALE}) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
x AS MATERIALIZED (SELECT r, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS v FROM kept, range({PARTS}) t(p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM x WHERE r <= {ENTRIES}),
{_sql_round("book0", 1)},
{_sql_round("book1", 2)},
{_sql_round("book2", 3)},
whole AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near3 GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN whole USING (r), books
"""
