"""Scans and sinks: strict JSON lines, directories, guarded partitions, write-once and resumable tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Names = Sequence[str]


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines by an explicit schema; blank lines are skipped. strict: a malformed line fails the job, else its fields are null."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    return lines.select(F.from_json("value", ddl, {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("r")).select("r.*")


def field(column: str, path: str) -> Column:
    """A value by dotted path in a JSON string column; null if it isn't there."""
    return F.get_json_object(column, "$." + path)


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, length and modified of the files below a folder, contents unread; fails if there are none."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    if not found.inputFiles():
        raise FileNotFoundError(f"{path} holds no {pattern}")
    return found.select("path", "length", F.col("modificationTime").alias("modified")).orderBy(F.lower("path"))


def check_manifest(spark: SparkSession, path: str, manifest: DataFrame) -> int:
    """The number of files below path, after each was compared with the manifest (name below path, sha256); fails if any
    differs, is missing, or isn't listed. Files are hashed where they are read; a file must fit a task's memory.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    below = F.regexp_replace(F.substring("path", F.lit(len(root) + 1), F.length("path")), "^/+", "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    have = files.select(below.alias("name"), F.sha2("content", 256).alias("have"))
    both = have.join(manifest.select("name", "sha256"), ["name"], "full")
    bad = both.filter(~F.col("have").eqNullSafe(F.lower("sha256"))).agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first")).first()
    if bad.n:
        raise ValueError(f"{bad.n} files differ from the manifest, {bad.first} first")
    return both.count()


def read_prefix(df: DataFrame, on: str, last: int) -> DataFrame:
    """Rows up to a time; the filter reaches the Parquet scan."""
    return df.filter(F.col(on) <= last)


#: What each split may be read for.
PURPOSES = {"train": {"fit", "select", "report"}, "validation": {"select", "report"}, "test": {"report"}}


def read_split(spark: SparkSession, path: str, split: str, purpose: str, allowed: dict[str, set[str]] = PURPOSES) -> DataFrame:
    """One partition of a table written by split; refuses a purpose that the split is not for before any file is opened."""
    if purpose not in allowed.get(split, set()):
        raise PermissionError(f"{split} may not be read for {purpose}")
    return spark.read.parquet(path).filter(F.col("split") == split)


def saved_values(keys: DataFrame, saved: DataFrame, on: Names) -> DataFrame:
    """keys with the saved row of each; fails while it runs if a saved key repeats or is not among the keys."""
    once = saved.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*(c for c in saved.columns if c not in on))).alias("__v"))
    both = keys.withColumn("__k", F.lit(True)).join(once, list(on), "full")
    bad = F.when(F.col("__n") > 1, F.raise_error(F.lit("a saved key repeats"))).when(F.col("__k").isNull(), F.raise_error(F.lit("a saved key is foreign")))
    checked = both.withColumn("__e", F.coalesce(bad.cast("boolean"), F.lit(True))).filter("__e")
    return checked.select(*keys.columns, *(F.col("__v")[c].alias(c) for c in saved.columns if c not in on))


def write_once(df: DataFrame, path: str, partition_by: Names = ()) -> None:
    """A table that must not exist yet; Spark's commit makes it appear whole."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def write_checked(df: DataFrame, path: str, partition_by: Names = ()) -> int:
    """write_once, then the rows read back must be those written: the same number and the same sum of row hashes."""
    digest = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(d.columns)).cast("decimal(38,0)"))).first())
    write_once(df, path, partition_by)
    want, got = digest(df), digest(df.sparkSession.read.schema(df.schema).parquet(path))
    if want != got:
        raise ValueError(f"read back {got}, wrote {want}")
    return got[0]


def resume(df: DataFrame, path: str, key: str) -> DataFrame:
    """The rows of keys that the table at path doesn't hold yet; all rows if there is no table."""
    try:
        there = df.sparkSession.read.schema(df.select(key).schema).parquet(path)
        there.inputFiles()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return df
        raise
    return df.join(there.distinct(), [key], "left_anti")
