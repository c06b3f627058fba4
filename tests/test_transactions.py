"""Tables that appear whole or not at all."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tidegrid.sources import tables, transactions


@pytest.fixture
def store(spark, tmp_path):
    return transactions.Store(spark, str(tmp_path / "store"))


def samples(spark, *matches):
    return spark.createDataFrame([(m, k, f"é{m}{k}", None if k == 1 else k / 3) for m in matches for k in range(4)], "match string, tick long, id string, x double")


def test_commit_and_resume(spark, store):
    df = samples(spark, "a", "b", "c")
    t = store.begin("first")
    t.write("samples", store.missing(df.filter("match < 'c'"), "match", "samples"), "match")
    t.write("audit", spark.createDataFrame([("a", 1)], "match string, n int"), "match")
    t.skip(spark.createDataFrame([("z", "unsupported map")], "member string, reason string"))
    assert store.committed().count() == 0 and store.names() == []
    t.commit()
    assert sorted((r.table, r.member, r.rows) for r in store.committed().collect()) == [("audit", "a", 1), ("samples", "a", 4), ("samples", "b", 4)]
    left = store.missing(df.union(samples(spark, "z")), "match", "samples")
    assert {r.match for r in left.collect()} == {"c"}
    with pytest.raises(FileExistsError):
        store.begin("first")
    with pytest.raises(ValueError, match="ended"):
        t.commit()
    again = store.begin("second")
    again.write("samples", left, "match")
    again.commit()
    assert sorted(map(tuple, store.read("samples").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert store.missing(df, "match", "samples").count() == 0 and store.skipped().collect()[0].reason == "unsupported map"


def test_nothing_of_a_dead_or_abandoned_one_is_seen(spark, store):
    t = store.begin("dies")
    t.write("samples", samples(spark, "a"), "match")
    broken = samples(spark, "b", "c").withColumn("x", F.when(F.col("tick") == 3, F.raise_error(F.lit("killed")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="killed"):
        t.write("more", broken, "match")
    assert store.committed().count() == 0  # the job ended here; the next begins anew
    t = store.begin("dies")
    assert not os.path.exists(store.data("dies", "samples"))
    t.write("samples", samples(spark, "a"), "match")
    t.abandon()
    assert not os.path.exists(store.data("dies", "samples")) and store.names() == []
    with pytest.raises(ValueError, match="ended"):
        t.write("samples", samples(spark, "a"), "match")
    with pytest.raises(ValueError, match="0 schemas"):
        store.read("samples")


def test_a_file_changed_before_the_commit_is_found(spark, store):
    t = store.begin("x")
    t.write("samples", samples(spark, "a", "b"), "match")
    samples(spark, "a").write.mode("overwrite").parquet(store.data("x", "samples"))
    with pytest.raises(ValueError, match="not written as given, b"):
        t.commit()
    assert store.names() == []


def test_two_that_commit_one_name(spark, store):
    one, two = store.begin("n"), store.begin("n")
    one.write("samples", samples(spark, "a"), "match")
    one.commit()
    with pytest.raises(FileExistsError):
        two.commit()


def test_ordered_merge(spark, store, tmp_path):
    for name, matches in (("one", ("c", "a")), ("two", ("b",))):
        t = store.begin(name)
        t.write("samples", samples(spark, *matches), "match")
        t.commit()
    out = str(tmp_path / "merged")
    members = spark.createDataFrame([(m,) for m in "abc"], "member string")
    files = store.merged("samples", out, ["match", "tick"], [["id"]], members).collect()
    names = sorted(f for f in os.listdir(out) if f.startswith("part-"))
    content = [open(os.path.join(out, f), "rb").read() for f in names]
    assert [(r.file, r.sha256, r.rows) for r in files] == [(f, hashlib.sha256(c).hexdigest(), c.count(b"\n")) for f, c in zip(names, content, strict=True) if c]
    assert [(r["match"], r["tick"]) for r in map(json.loads, b"".join(content).splitlines())] == [(m, k) for m in "abc" for k in range(4)]
    with pytest.raises(ValueError, match="d is not in both"):
        store.merged("samples", out + "2", ["match"], members=members.union(spark.createDataFrame([("d",)], "member string")))
    with pytest.raises(ValueError, match="repeats"):
        store.merged("samples", out + "2", ["match"], [["tick"]])
    t = store.begin("three")
    t.write("samples", samples(spark, "a"), "match")
    t.commit()
    with pytest.raises(ValueError, match="two transactions"):
        store.merged("samples", out + "2", ["match"])


def test_manifest_of_two_folders_with_one_name(spark, tmp_path):
    rows = []
    for folder in "ab":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.txt").write_text(folder)
        rows.append((f"{folder}/x.txt", hashlib.sha256(folder.encode()).hexdigest()))
    assert tables.check_manifest(spark, str(tmp_path), spark.createDataFrame(rows, "name string, sha256 string")) == 2
