"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words, as all shingle operators take them: runs without ASCII white space.
WORD_GAPS = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets a folder
    of its own; a cluster gets an error, as no folder of one machine would do.
    """
    sc = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(folder)
        return folder
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidegrid-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder; what follows reads the copy, whichever executors are lost meanwhile."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, what: str) -> DataFrame:
    """As stored, but as Parquet, which takes less of the shared folder where there are many rows."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def own_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(column):
    """Lower case for A-Z alone; other letters stay, as the shingle contract has it."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_fields(df: DataFrame, fields: list[tuple[str, str]]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(name, T._parse_datatype_string(kind)) for name, kind in fields)])


def offsets_of(column):
    """The byte offsets of an Arrow string column, one more than it has rows."""
    import numpy as np
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(1, np.int64)
    got = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    return got[column.offset : column.offset + len(column) + 1].astype(np.int64)


def slices(column, step_bytes: int = 4 << 20):
    """(first row, slice) of an Arrow string or binary column, slices of about step_bytes each."""
    import numpy as np

    group = np.diff(offsets_of(column)).cumsum() // step_bytes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(column)]
    return [(a, column.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def give_back() -> None:
    """Returns to the system what Arrow's pool and, where the C library can, its heap keep of freed memory."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(run):
    """run, for mapInArrow, such that a task's end gives back what it no longer needs.

    Spark keeps idle Python workers for a minute and takes them in turn, so the memory of an executor holds several that
    wait, each as large as the largest task that it ever had.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def map_column(df: DataFrame, column: str, make, fields: list[tuple[str, str]], step_bytes: int = 4 << 20, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns in keep) with the columns `fields` (name, type) that make() gives.

    make() runs once in each task and returns a function from a slice of the string or binary column, as an Arrow array,
    to one Arrow array for each field. Slices are small, so that a task holds little however long the texts are.
    """
    kept = df.columns if keep is None else keep

    def run(batches):
        import pyarrow as pa

        work = make()
        for batch in batches:
            for low, part in slices(batch.column(column), step_bytes):
                rows = [batch.column(c).slice(low, len(part)) for c in kept]
                yield pa.RecordBatch.from_arrays([*rows, *work(part)], names=[*kept, *(n for n, _ in fields)])

    return df.mapInArrow(released(run), with_fields(df.select(*kept), fields))
