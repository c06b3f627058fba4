"""Global removal of repeated passages by overlapping pairs of lines.

A passage of several lines that occurs twice shares each of its pairs of adjacent lines, wherever it lies, so every such
pair is a chunk; so is a line of MIN_WORDS words or more by itself. Chunks whose hash occurs more than once in the whole
corpus are compared by their bytes. Of equal chunks the first (by document id, then place) stays; the lines of the
others go, and with them the whole of every passage of several lines, or of one long line, that occurs earlier.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import own_name, released, slices, stored

MIN_WORDS = 50

#: Bits of the broadcast bitmap (8 MB) of hashes that occur more than once. It only spares bytes in a shuffle: what it
#: lets through wrongly is sorted out by the comparison.
BITMAP_BITS = 1 << 26


def chunk_lines(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, line after the last) of each chunk."""
    long = [(k, k + 1) for k, line in enumerate(lines) if len(line) >= 2 * MIN_WORDS - 1 and len(line.split()) >= MIN_WORDS]
    return [*((k, k + 2) for k in range(len(lines) - 1)), *long]


def chunk_hash(chunk: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(chunk) - (1 << 63)


def chunks(text: str | None) -> list[tuple[int, bytes]]:
    """(hash, bytes) of each chunk of a text; null and empty texts have none."""
    if not text:
        return []
    lines = text.encode().split(b"\n")
    return [(chunk_hash(p), p) for p in (b"\n".join(lines[a:b]) for a, b in chunk_lines(lines))]


def without(text: str | None, gone: list[dict] | None) -> tuple[str | None, int]:
    """text without the lines of the chunks listed as repeated elsewhere (no, h); lines removed."""
    if not gone or not text:
        return text, 0
    lines = text.encode().split(b"\n")
    spans = chunk_lines(lines)
    same = lambda g: g["no"] < len(spans) and chunk_hash(b"\n".join(lines[slice(*spans[g["no"]])])) == g["h"]
    drop = {k for g in gone if same(g) for k in range(*spans[g["no"]])}
    return b"\n".join(line for k, line in enumerate(lines) if k not in drop).decode(), len(drop)


def _chunk_rows(bitmap: np.ndarray | None):
    """(id, nulls, text) batches -> (h) of all chunks, or (id, nulls, no, h, chunk) of those in the bitmap."""

    def run(batches):
        for batch in batches:
            for low, texts in slices(batch.column(2)):
                rows, no, h, parts = [], [], [], []
                for k, text in enumerate(texts.to_pylist(), low):
                    for j, (value, part) in enumerate(chunks(text)):
                        if bitmap is None or bitmap[(at := value & (BITMAP_BITS - 1)) >> 6] >> (at & 63) & 1:
                            rows.append(k)
                            no.append(j)
                            h.append(value)
                            parts.append(part)
                if bitmap is None:
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64())], names=["h"])
                    continue
                ids = [batch.column(k).take(pa.array(rows, pa.int64())) for k in (0, 1)]
                columns = [*ids, pa.array(no, pa.int32()), pa.array(h, pa.int64()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "nulls", "no", "h", "chunk"])

    return run


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, nulls, no, h): every chunk, by its number in its document, whose bytes also occur earlier in the corpus.

    nulls tells texts of the null id apart (their hash), so that no row gathers all of them.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).alias("nulls"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    hashes = rows.mapInArrow(released(_chunk_rows(None)), "h long")
    twice = hashes.groupBy("h").count().filter("count > 1").select(F.col("h").bitwiseAND(F.lit(BITMAP_BITS - 1)).alias("at"))
    words = twice.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    found = words.toArrow()  # a row for each 64 bits of the bitmap at most
    bitmap = np.zeros(BITMAP_BITS >> 6, np.uint64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    if not found.num_rows:
        return rows.select("id", "nulls", F.lit(0).alias("no"), F.lit(0).cast("long").alias("h")).limit(0)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def with_bytes(batches):
        yield from _chunk_rows(shared.value)(batches)

    seen = rows.mapInArrow(released(with_bytes), f"id {kind}, nulls long, no int, h long, chunk binary")
    place = F.struct(F.col("id").isNotNull().alias("known"), "id", "no")
    first = seen.groupBy("h", "chunk").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # stored, so that the join below has a shuffle on either side and Spark can split the rows of a very common chunk
    first = stored(first.select(F.col("h").alias("h1"), F.col("chunk").alias("chunk1"), "first"))
    same = seen.join(first, (F.col("h") == F.col("h1")) & (F.col("chunk") == F.col("chunk1")))
    return same.filter(~place.eqNullSafe(F.col("first"))).select("id", "nulls", "no", "h")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """docs with text_col freed of repeated passages; removed_col, if named, tells how many lines of each text went (where
    docs has that name, the new column gets underscores in front).

    A text all of whose lines go becomes empty. Null and empty texts stay as they are, and so does an empty table. Rows
    that share an id count as one document: equal chunks at one place of them all stay. The null id is a document, before
    all others.
    """
    name, lines = own_name(docs, "gone"), own_name(docs, removed_col or "removed")
    gone = repeated_chunks(docs, id_col, text_col).groupBy("id", "nulls").agg(F.collect_list(F.struct("no", "h")).alias(name))
    gone = gone.toDF(f"{name}_id", f"{name}_nulls", name)
    nulls = F.when(docs[id_col].isNull(), F.xxhash64(docs[text_col]))
    joined = docs.join(gone, docs[id_col].eqNullSafe(F.col(f"{name}_id")) & nulls.eqNullSafe(F.col(f"{name}_nulls")), "left").drop(f"{name}_id", f"{name}_nulls")
    kept = own_name(docs, "kept")

    def run(batches):
        for batch in batches:
            for low, texts in slices(batch.column(text_col)):
                rows = batch.slice(low, len(texts))
                made = [without(t, g) for t, g in zip(texts.to_pylist(), rows.column(name).to_pylist(), strict=True)]
                columns = [c for n, c in zip(rows.schema.names, rows.columns, strict=True) if n not in (name, text_col)]
                names = [n for n in rows.schema.names if n not in (name, text_col)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([t for t, _ in made], pa.string()), pa.array([n for _, n in made], pa.int32())], names=[*names, kept, lines])

    fields = [f for f in joined.schema.fields if f.name not in (name, text_col)]
    schema = joined.select(*(f.name for f in fields)).schema
    out = joined.mapInArrow(released(run), _schema(schema, kept, lines))
    order = [F.col(kept).alias(text_col) if c == text_col else F.col(c) for c in docs.columns]
    return out.select(*order, *([lines] if removed_col else []))


def _schema(base, kept: str, lines: str):
    from pyspark.sql import types as T

    return T.StructType([*base.fields, T.StructField(kept, T.StringType()), T.StructField(lines, T.IntegerType())])


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs, removed_col="removed_lines")
    return out.select("doc_id", "removed_lines", F.char_length(F.coalesce("text", F.lit(""))).alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
