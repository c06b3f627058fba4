"""Tables that appear whole or not at all: staged by Spark, checked against what was meant, and listed in a manifest last.

A folder holds data/NAME/TABLE for each transaction and manifests/NAME.json for each committed one. Only what a manifest
lists is read, so a job that dies at any point, or an executor lost in the middle, leaves nothing visible, and the next
run adds what is missing. Files are touched through Spark's own file systems, wherever the folder lies.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "name string, tables array<struct<table:string,schema:string,member:string,rows:long,digest:string>>, skipped array<struct<member:string,reason:string>>"


class _Files:
    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _of(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._of(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._of(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        fs, p = self._of(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def appear(self, path: str, text: str) -> None:
        """A file that was not there, whole: written under another name first. Fails if it is there."""
        fs, p = self._of(path)
        _, hidden = self._of(f"{path}.part")
        out = fs.create(hidden, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(p) or not fs.rename(hidden, p):
            fs.delete(hidden, False)
            raise FileExistsError(path)


def summed(df: DataFrame, member: str) -> DataFrame:
    """(member, rows, digest): how many rows each member has, and a sum of their hashes that no order changes."""
    digest = F.sum(F.xxhash64(*(F.struct(c) for c in sorted(df.columns))).cast("decimal(38,0)")).cast("string")
    return df.groupBy(F.col(member).cast("string").alias("member")).agg(F.count(F.lit(1)).alias("rows"), digest.alias("digest"))


@dataclass
class Transaction:
    """One unit of work on a store: write() any number of tables, then commit() or abandon()."""

    store: Store
    name: str
    tables: dict[str, tuple[StructType, str, DataFrame]] = field(default_factory=dict)
    skipped: DataFrame | None = None
    ended: bool = False

    def _open(self) -> None:
        if self.ended:
            raise ValueError(f"transaction {self.name} has ended")

    def write(self, table: str, df: DataFrame, member: str) -> None:
        """Stages a table; member: the column that says which match a row is of. Writing a table again replaces it."""
        self._open()
        df.write.mode("overwrite").parquet(self.store.data(self.name, table))
        self.tables[table] = (df.schema, member, df)

    def skip(self, members: DataFrame) -> None:
        """(member, reason) of what was left out on purpose; it counts as done."""
        self._open()
        self.skipped = members.select(F.col("member").cast("string").alias("member"), "reason")

    def commit(self) -> DataFrame:
        """The manifest's rows. What was staged is read back and must be, member by member, what was given to write()."""
        self._open()
        spark, lines = self.store.spark, []
        for table, (schema, member, given) in self.tables.items():
            staged = summed(spark.read.schema(schema).parquet(self.store.data(self.name, table)), member)
            odd = staged.exceptAll(summed(given, member)).union(summed(given, member).exceptAll(staged)).limit(1).collect()
            if odd:
                self.abandon()
                raise ValueError(f"{table} was not written as given, {odd[0].member} first")
            lines.append((table, schema, staged))
        members = [{"table": t, "schema": s.json(), **r.asDict()} for t, s, d in lines for r in d.orderBy("member").toLocalIterator()]
        left = [r.asDict() for r in self.skipped.orderBy("member").collect()] if self.skipped is not None else []
        for table, schema, _ in lines:
            if not any(m["table"] == table for m in members):
                members.append({"table": table, "schema": schema.json(), "member": None, "rows": 0, "digest": None})
        self.store.files.appear(self.store.manifest(self.name), json.dumps({"name": self.name, "tables": members, "skipped": left}))
        self.ended = True
        return self.store.committed()

    def abandon(self) -> None:
        """Nothing of it remains."""
        self._open()
        self.store.files.delete(f"{self.store.path}/data/{self.name}")
        self.ended = True


@dataclass
class Store:
    """A folder of transactions. One row for each member and table comes to the driver when a transaction commits."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        self.files = _Files(self.spark)

    def data(self, name: str, table: str) -> str:
        return f"{self.path}/data/{name}/{table}"

    def manifest(self, name: str) -> str:
        return f"{self.path}/manifests/{name}.json"

    def begin(self, name: str) -> Transaction:
        """A new transaction; what one of that name left behind without committing goes. A committed name is refused."""
        if not name.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"{name!r} is no name of a folder")
        if self.files.exists(self.manifest(name)):
            raise FileExistsError(f"transaction {name} is committed")
        self.files.delete(f"{self.path}/data/{name}")
        return Transaction(self, name)

    def names(self) -> list[str]:
        return [n.removesuffix(".json") for n in self.files.names(f"{self.path}/manifests") if n.endswith(".json")]

    def _manifests(self) -> DataFrame:
        paths = [self.manifest(n) for n in self.names()]
        return self.spark.read.schema(MANIFEST).json(paths) if paths else self.spark.createDataFrame([], MANIFEST)

    def committed(self) -> DataFrame:
        """(name, table, member, rows, digest) of all that is committed."""
        return self._manifests().select("name", F.explode("tables").alias("t")).select("name", "t.table", "t.member", "t.rows", "t.digest").filter("member IS NOT NULL OR rows > 0")

    def skipped(self) -> DataFrame:
        return self._manifests().select("name", F.explode("skipped").alias("s")).select("name", "s.*")

    def read(self, table: str) -> DataFrame:
        """All committed rows of a table; fails if there are none to tell its columns, or if two transactions differ in them."""
        known = self._manifests().select("name", F.explode("tables").alias("t")).filter(F.col("t.table") == table).select("name", "t.schema").distinct().collect()
        if len({r.schema for r in known}) != 1:
            raise ValueError(f"{table} has {len({r.schema for r in known})} schemas")
        return self.spark.read.schema(StructType.fromJson(json.loads(known[0].schema))).parquet(*(self.data(r.name, table) for r in known))

    def missing(self, df: DataFrame, member: str, table: str) -> DataFrame:
        """The rows of members that are neither committed in the table nor skipped: what a run that goes on has to do."""
        done = self.committed().filter(F.col("table") == table).select("member").union(self.skipped().select("member")).distinct().withColumnRenamed("member", "__m")
        return df.join(done, F.col(member).cast("string").eqNullSafe(F.col("__m")), "left_anti")

    def merged(self, table: str, out: str, order: Sequence[str], unique: Sequence[Sequence[str]] = (), members: DataFrame | None = None) -> DataFrame:
        """Writes all committed rows as JSON lines, in order from file to file, and returns (file, rows, sha256) of them.

        out must not exist. Fails before writing if a member is in two transactions, if keys in `unique` repeat, or if
        members (member), where given, are not just those committed. The lines read back must be, as a multiset of bytes,
        those of the rows; the files' digests are of their bytes.
        """
        rows = self.read(table)
        listed = self.committed().filter(F.col("table") == table)
        if twice := listed.groupBy("member").count().filter("count > 1").limit(1).collect():
            raise ValueError(f"{twice[0].member} is in two transactions")
        for keys in unique:
            if again := rows.groupBy(*keys).count().filter("count > 1").limit(1).collect():
                raise ValueError(f"{list(keys)} repeats: {tuple(again[0])[:-1]}")
        if members is not None:
            want, have = members.select(F.col("member").cast("string")), listed.select("member").distinct()
            if odd := want.exceptAll(have).union(have.exceptAll(want)).limit(1).collect():
                raise ValueError(f"{odd[0].member} is not in both the members and the table")
        lines = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct(*rows.columns)).alias("value"))
        lines.write.mode("errorifexists").text(out)
        mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.octet_length("value")), F.sum(F.xxhash64("value").cast("decimal(38,0)"))).first())
        back = self.spark.read.text(out)
        if mark(back) != mark(rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))):
            raise ValueError("the lines read back are not those of the rows")
        whole = self.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out)
        name = F.element_at(F.split("path", "/"), -1)
        digests = whole.select(name.alias("file"), F.sha2("content", 256).alias("sha256"))
        counts = back.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.count(F.lit(1)).alias("rows"))
        return digests.join(counts, "file").select("file", "rows", "sha256").orderBy("file")
