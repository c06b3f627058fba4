import pytest
from pyspark.sql import functions as F
from test_operators import SCRIPT

from tidegrid.operators import rounds, sequence
from tidegrid.sources import tables
from tidegrid.streaming import state


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": {"c": "x"}}\n\n  \n{"a": 2}\n')
    assert [(r.a, r.b.c if r.b else None) for r in tables.read_jsonl(spark, str(tmp_path), "a int, b struct<c:string>").orderBy("a").collect()] == [(1, "x"), (2, None)]
    (tmp_path / "b.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_jsonl(spark, str(tmp_path), "a int, b struct<c:string>").collect()
    assert tables.read_jsonl(spark, str(tmp_path), "a int", strict=False).count() == 3
    assert tables.list_files(spark, str(tmp_path), "*.jsonl").count() == 2
    with pytest.raises(FileNotFoundError):
        tables.list_files(spark, str(tmp_path), "*.csv")


def test_manifest(spark, tmp_path):
    import hashlib

    for name in "ab":
        (tmp_path / name).write_text(name * 3)
    rows = [(n, hashlib.sha256((n * 3).encode()).hexdigest()) for n in "ab"]
    frame = lambda r: spark.createDataFrame(r, "name string, sha256 string")
    assert tables.check_manifest(spark, str(tmp_path), frame(rows)) == 2
    for bad in ([rows[0]], [*rows, ("c", "0")], [rows[0], ("b", rows[0][1])]):
        with pytest.raises(ValueError, match="1 files differ"):
            tables.check_manifest(spark, str(tmp_path), frame(bad))


def test_upserts_of_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, at int, v string")
    state.upsert_into(str(tmp_path / "o"), ["k"], ["at"])(rows, 0)
    assert sorted((r.k, r.v) for r in state.latest(spark.read.parquet(str(tmp_path / "o")), ["k"]).collect()) == [(1, "b"), (2, "c")]
    with pytest.raises(Exception, match="repeats"):
        state.upsert_into(str(tmp_path / "p"), ["k"])(rows, 0)


def test_splits_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("train", 1, "m"), ("test", 2, "n")], "split string, id int, match string")
    path = str(tmp_path / "t")
    assert tables.resume(df, path, "match").count() == 2
    assert tables.write_checked(df.filter("id = 1"), path, ["split"]) == 1
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_once(df, path)
    assert [r.id for r in tables.resume(df, path, "match").collect()] == [2]
    assert tables.read_split(spark, path, "train", "fit").count() == 1
    with pytest.raises(PermissionError):
        tables.read_split(spark, path, "test", "fit")


def test_saved_values(spark):
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    saved = spark.createDataFrame([(1, 0.5)], "k int, p double")
    assert sorted((r.k, r.p) for r in tables.saved_values(keys, saved, ["k"]).collect()) == [(1, 0.5), (2, None)]
    with pytest.raises(Exception, match="repeats"):
        tables.saved_values(keys, saved.union(saved), ["k"]).collect()
    with pytest.raises(Exception, match="foreign"):
        tables.saved_values(keys.filter("k = 2"), saved, ["k"]).collect()


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streamed_attempts_equal_the_batch(spark, tmp_path):
    names = [x.split()[0].strip("`") for x in rounds.OBSERVED.replace("\n", " ").split(", ")]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    ddl = f"match_id string, {rounds.OBSERVED}"
    for a in range(0, len(SCRIPT), 3):
        rows = [(m, *(r[n] for n in names)) for m in ("x", "y") for r in SCRIPT[a : a + 3]]
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(folder)
    made = state.stream_attempts(_stream(spark, folder, spark.read.parquet(folder).schema))
    q = made.writeStream.outputMode("update").foreachBatch(state.upsert_into(out, ["match_id", "round_id"])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    got = state.latest(spark.read.parquet(out), ["match_id", "round_id"])
    want = rounds.round_attempts(spark.read.parquet(folder))
    view = lambda d: sorted((r.match_id, r.round_id, r.round_number, r.live_tick, r.disposition) for r in d.collect() if r.disposition not in ("open", "result-missing"))
    assert view(got) == view(want) and len(view(got)) == 6


def test_streamed_min_gap_equals_the_batch(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([3, 9, 70], [80, 140], [141, 300]):
        spark.createDataFrame([("m", t) for t in part], "k string, t long").coalesce(1).write.mode("append").parquet(folder)
    made = state.stream_min_gap(_stream(spark, folder, "k string, t long"), "k", "t", 64)
    q = made.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    batch = sequence.min_gap(spark.read.parquet(folder), ["k"], "t", 64)
    assert sorted(spark.read.parquet(out).select("k", "t").collect()) == sorted(batch.collect())
    assert spark.read.parquet(out).agg(F.count("t")).first()[0] == 4


def test_last_write_with_late_rows(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    ddl = "k string, at timestamp, seq int, v string"
    day = "2024-01-01 00:00:"
    for part in ([("m", "01", 1, "provisional"), ("m", "02", 2, "two")], [("m", "01", 3, "final"), ("m", "20", 4, "later")], [("m", "20", 5, "last"), ("m", "40", 6, "passed")], [("m", "01", 7, "too late"), ("m", "59", 8, "open")]):
        spark.createDataFrame([(k, day + t, n, v) for k, t, n, v in part], "k string, at string, seq int, v string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(folder)
    made = state.last_write(_stream(spark, folder, ddl), ["k"], "at", "seq", "5 seconds")
    q = made.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    assert sorted((r.at.second, r.v) for r in spark.read.parquet(out).collect()) == [(1, "final"), (2, "two"), (20, "last"), (40, "passed")]


def test_fresh_values(spark):
    rows = spark.createDataFrame([(10.0, 8.5, "a"), (10.0, 8.4, "b"), (10.0, None, "c"), (10.0, 10.5, "d")], "t double, found double, v string")
    assert [r.v for r in state.fresh(rows, "found", "t", ["v"], 1.5).orderBy("found").collect()] == [None, None, "a", None]


def test_prefix_paths_and_slices(spark, tmp_path):
    rows = spark.createDataFrame([(k, '{"a": {"b.c": 1, "b": [%d]}}' % k) for k in range(6)], "tick int, j string")
    rows.write.parquet(str(tmp_path / "p"))
    read = tables.read_prefix(spark.read.parquet(str(tmp_path / "p")), "tick", 3)
    assert sorted(r.tick for r in read.collect()) == [0, 1, 2, 3] and "LessThanOrEqual(tick,3)" in read._jdf.queryExecution().executedPlan().toString()
    one = rows.filter("tick = 4").select(tables.field("j", "a.b[0]"), tables.field("j", "a.x"), tables.field("j", "z.b")).first()
    assert tuple(one) == ("4", None, None)
    log = spark.createDataFrame([("m", t) for t in (1, 5, 5, 8, 12, 20)] + [("n", 30)], "k string, t int")
    cut = lambda **how: sorted((r.k, r.t) for r in sequence.window_slice(log, ["k"], "t", F.lit(6), F.lit(12), **how).collect())
    assert cut(one_past=False) == [("m", 5), ("m", 8), ("m", 12)] and cut() == [("m", 5), ("m", 8), ("m", 12), ("m", 20), ("n", 30)]
