"""Two-pass external shuffle into shards of equal row counts.

Pass one scatters the records by a seeded hash over so many buckets that each fits in a task's memory. Pass two puts
each bucket in memory, orders it (so that a repeated task gives the same result), permutes it by Fisher-Yates with a
generator seeded by the bucket, and writes it. A record's place in the whole is its bucket's offset plus its place in
the bucket; each shard holds a stretch of places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import new_path, own_name, partitions, with_fields

#: Bytes of a bucket, and buckets whose offsets are summed in one go.
BUCKET_BYTES, STRETCH = 16 << 20, 1024


def text_size(column: Column) -> Column:
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + F.lit(8).cast("long")


def _permuted(bucket: str, key: str, place: str, seed: int):
    """Arrow batches sorted by bucket and key -> the same rows, each bucket permuted, with their places in it."""

    def finish(parts: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(parts)
        rng = np.random.default_rng([seed & 0xFFFFFFFF, table[bucket][0].as_py()])
        order = np.arange(table.num_rows)
        rng.shuffle(order)  # Fisher-Yates
        return table.take(pa.array(order)).append_column(place, pa.array(np.arange(table.num_rows, dtype=np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            ids = table[bucket].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[0][bucket][0].as_py() != ids[a]:
                    yield from finish(held).to_batches(max_chunksize=10_000)
                    held = []
                held.append(table.slice(a, b - a))
        if held:
            yield from finish(held).to_batches(max_chunksize=10_000)

    return run


def _before(counts: DataFrame, bucket: str, n: str, out: str) -> DataFrame:
    """(bucket, out): the sum of n over smaller buckets. Summed within stretches of buckets and over them, so that no task
    gets them all.
    """
    stretch = counts.withColumn("__stretch", F.floor(F.col(bucket) / STRETCH))
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    whole = stretch.groupBy("__stretch").agg(F.sum(n).alias("__n"))
    ahead = whole.select(F.col("__stretch").alias("__s"), F.coalesce(F.sum("__n").over(upto().orderBy("__stretch")), F.lit(0)).alias("__ahead"))
    own = F.coalesce(F.sum(n).over(upto("__stretch").orderBy(bucket)), F.lit(0))
    inside = stretch.select(bucket, "__stretch", own.alias("__own"))
    return inside.join(ahead, F.col("__stretch") == F.col("__s")).select(bucket, (F.col("__own") + F.col("__ahead")).cast("long").alias(out))


def shuffle_into_shards(
    docs: DataFrame, shards: int = 24, seed: int = 20, id_col: str = "doc_id", text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES, path: str | None = None,
) -> DataFrame:
    """docs in random order in `shards` shards; returns what was written to path (by default in the shared folder), a
    folder for each shard.

    Law "rows": shard counts differ by one at most. Added columns: shard int, slot long (gapless from 0 in its shard).
    All columns of docs stay; where one is named shard or slot, the new one gets underscores in front. Null texts and
    null ids are records like others; repeated rows each get a slot of their own; an empty table gives no rows.
    The hash covers id and text, so a large group of equal texts spreads over all buckets, and a repeated task orders its
    rows by all columns (but maps), so it gives what it gave before. The buckets' order is the order of the whole, so a
    bucket's rows lie in one shard or two, and files are about as many as buckets. The offsets have one row a bucket; they
    are broadcast up to a million buckets (16 MB) and joined by a shuffle beyond.
    """
    spark = docs.sparkSession
    bucket, key, tie, place, shard, slot, at, start, of = (own_name(docs, x) for x in ("bucket", "key", "tie", "place", "shard", "slot", "at", "start", "of"))
    totals = docs.agg(F.sum(text_size(F.col(text_col))).alias("b"), F.count(F.lit(1)).alias("n")).first()
    buckets = max(1, -(-(totals.b or 0) // bucket_bytes))
    hashed = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    keyed = docs.withColumn(key, hashed).withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed + 1), key), F.lit(buckets)))
    offsets = _before(keyed.groupBy(F.col(bucket).alias(of)).agg(F.count(F.lit(1)).alias("n")), of, "n", start)
    rest = [f.name for f in docs.schema.fields if f.name not in (id_col, text_col) and "map<" not in f.dataType.simpleString()]
    tied = keyed.withColumn(tie, F.xxhash64(*map(F.col, rest)) if rest else F.lit(0).cast("long"))
    scattered = tied.repartition(min(buckets, partitions(docs)), bucket).sortWithinPartitions(bucket, key, id_col, text_col, tie)
    mixed = scattered.mapInArrow(_permuted(bucket, key, place, seed), with_fields(scattered, [(place, "long")]))
    # shard s holds the places from floor(s n / shards) on
    begin = F.expr(f"cast(`{shard}` as long) * {totals.n} div {shards}")
    placed = (
        mixed.join(F.broadcast(offsets) if buckets <= 1_000_000 else offsets, F.col(bucket) == F.col(of))
        .withColumn(at, F.col(start) + F.col(place))
        .withColumn(shard, F.expr(f"cast(({shards} * (`{at}` + 1) - 1) div {max(totals.n, 1)} as int)"))
        .withColumn(slot, F.col(at) - begin)
        .select(*docs.columns, shard, slot)
    )
    path = path or new_path(spark, "shards")
    placed.write.partitionBy(shard).parquet(path)
    return spark.read.schema(placed.schema).parquet(path).select(*placed.columns)


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards, read back from the written shards."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shuffle_into_shards(docs)
    return out.select(
        "doc_id", text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
