"""The timeline of a feed: windows, the kept state of a stream, and the fold of single rows agree on every prefix."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import rounds, semantics
from tidegrid.streaming import collector

COLUMNS = semantics.names(semantics.FEED)
TEN = [(str(k + 1), "T" if k < 5 else "CT") for k in range(10)]


def row(tick, kind="command", **kw):
    base = dict.fromkeys(COLUMNS) | {"tick": tick, "kind": kind}
    if kind == "command":
        base |= {"raw_round": 0, "rounds_played": 0, "score_t": 0, "score_ct": 0, "match_started": True, "start_count": 0, "game_time": tick / 64, "round_start_time": 0.0, "round_time": 115, "paused_ticks": 0}
        base |= dict.fromkeys(("warmup", "freeze", "team_intro", "start", "live", "end", "paused", "technical", "waiting", "t_timeout", "ct_timeout"), False)
    return base | kw


def members(rng, full=0.8):
    seen = [(m, t) for m, t in TEN if rng.random() < full] + ([("0", "T")] if rng.random() < 0.05 else []) + ([("9", "spectator")] if rng.random() < 0.2 else [])
    return [{"member": m, "team": t, "alive": rng.choice([True, True, True, False, None]), "position": rng.random() < 0.9, "equipment": rng.random() < 0.9} for m, t in seen]


def script(seed, length):
    rng = random.Random(seed)
    out, tick, won, starts, paused = [], 0, [0, 0], 0, 0
    origin = 0.0
    for n in range(length):
        tick += rng.choice([0, 8, 64, 130])
        what = rng.choice(["start", "live", "end", "none", "both", "death", "death", "frame", "frame", "frame"])
        if what == "death":
            out.append(row(tick, "death", seq=n, member=rng.choice([*(m for m, _ in TEN), None])))
            continue
        if what == "frame":
            out.append(row(tick, "frame", seq=n, bomb=rng.choice([None, "planted", "carried"]), explosion=rng.choice([None, 30.0, -1.0, float("nan")]), defuse=rng.choice([None, 5.0]), persist=rng.choice([None, True, True, False]), members=rng.choice([None, members(rng), members(rng, 1)])))
            continue
        kw = {}
        if what in ("end", "both"):
            kw = {"end": True, "winner": rng.choice(["T", "CT", None]), "reason": rng.choice(["bomb", None])}
            if kw["winner"]:
                won[kw["winner"] == "CT"] += 1
        if what in ("start", "both"):
            starts += rng.random() < 0.9
            kw["start"] = True
        if what == "live":
            kw["live"] = True
            origin = tick / 64 - rng.choice([0, 0.1, 1])
        if rng.random() < 0.08:
            won = [0, rng.randrange(2)]
        paused += rng.random() < 0.05
        kw |= {c: rng.random() < 0.07 for c in ("paused", "waiting", "t_timeout", "freeze", "warmup")}
        out.append(row(tick, seq=n, score_t=won[0], score_ct=won[1], rounds_played=sum(won), raw_round=sum(won), start_count=starts, paused_ticks=paused, round_start_time=origin, **kw))
    return out


def prefixes():
    feeds = {f"m{s}": script(s, 40) for s in range(3)}
    return {f"{m}:{n}": rows[:n] for m, rows in feeds.items() for n in range(1, len(rows) + 1)}


@pytest.fixture(scope="module")
def feed(spark):
    rows = [(m, *(r[c] for c in COLUMNS), datetime(2024, 1, 1) + timedelta(seconds=n)) for m, rows in prefixes().items() for n, r in enumerate(rows)]
    return spark.createDataFrame(rows, f"match_id string, {semantics.FEED}, at timestamp")


def folded(rows):
    """What the fold of single rows gives, as the last state of each key."""
    c = collector.Collector(collector.Now(), [], {}, set())
    out = {}
    for r in rows:
        for x in c.step(rounds.clean(r)):
            out[x["what"], x["round_id"] if x["what"] == "attempt" else x["tick"], x["seq"]] = x
    return out


def views(found):
    """match -> what -> sorted rows, of dicts; attempts that still run are left out, as a prefix does not end them."""
    out = {}
    for what, ddl in (("attempt", rounds.ATTEMPTS), ("frame", semantics.FRAMES), ("audit", semantics.AUDIT)):
        for match, r in found(what):
            if what == "attempt" and r["disposition"] in ("open", "result-missing"):
                continue
            out.setdefault(match, set()).add((what, *(tuple(r[c]) if isinstance(r[c], list) else r[c] for c in semantics.names(ddl))))
    return out


def test_windows_equal_the_fold_on_every_prefix(feed):
    line = semantics.collected(feed)
    tables = {w: [(r["match_id"], r) for r in (x.asDict() for x in d.collect())] for w, d in (("attempt", line.attempts), ("frame", line.frames), ("audit", line.audit))}
    got = views(lambda w: tables[w])
    plain = {m: folded(rows).values() for m, rows in prefixes().items()}
    want = views(lambda w: [(m, r) for m, rows in plain.items() for r in rows if r["what"] == w])
    assert got.keys() == want.keys()
    assert not {m: (got[m] - want[m], want[m] - got[m]) for m in want if got[m] != want[m]}
    kinds = {x[0] for rows in want.values() for x in rows}
    assert kinds == {"attempt", "frame", "audit"} and len({x[-2] for rows in want.values() for x in rows if x[0] == "frame"}) > 1


def test_streamed_timeline_equals_the_batch(spark, feed, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    some = feed.filter(F.split("match_id", ":")[1].cast("int").isin(7, 23, 40)).withColumn("part", F.floor(F.unix_timestamp("at") % 40 / 14))
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        some.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(folder)
    late = some.limit(1).select(F.lit("z").alias("match_id"), *(F.lit(None).cast(feed.schema[c].dataType).alias(c) if c not in ("tick", "seq", "kind") else c for c in COLUMNS), F.lit(datetime(2024, 1, 3)).cast("timestamp").alias("at"))
    for at in (1, 2):  # the day after, and one row more, so that the watermark passes the timers
        late.withColumn("at", F.col("at") + F.expr(f"INTERVAL {at} DAYS")).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    def write(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    q = collector.stream_timeline(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    rows = sorted((r.asDict() for r in spark.read.parquet(out).collect()), key=lambda r: r["batch"])
    last = {}
    for r in rows:
        last[r["match_id"], r["what"], r["round_id"] if r["what"] == "attempt" else r["tick"], r["seq"]] = r
    got = views(lambda w: [(k[0], r) for k, r in last.items() if k[1] == w])
    line = semantics.collected(some)
    tables = {w: [(r["match_id"], r) for r in (x.asDict() for x in d.collect())] for w, d in (("attempt", line.attempts), ("frame", line.frames), ("audit", line.audit))}
    want = views(lambda w: tables[w])
    assert not {m: (sorted(map(repr, got.get(m, set()) - want[m])), sorted(map(repr, want[m] - got.get(m, set())))) for m in want if got.get(m) != want[m]}
    # idle matches ended: what ran is missing its result, as in the batch
    ended = lambda found: {(m, r["round_id"]) for m, r in found if r["disposition"] == "result-missing"}
    assert ended([(k[0], r) for k, r in last.items() if k[1] == "attempt"]) == ended(tables["attempt"]) != set()


def test_attempts_by_windows_equal_the_fold(spark):
    names = semantics.names(rounds.OBSERVED)
    feeds = {f"m{s}": [r for r in script(100 + s, 90) if r["kind"] == "command"] for s in range(60)}
    rows = [(m, *(r[c] for c in names)) for m, rows in feeds.items() for r in rows]
    got = {}
    for r in rounds.round_attempts(spark.createDataFrame(rows, f"match_id string, {rounds.OBSERVED}")).collect():
        got.setdefault(r.match_id, {})[r.round_id] = tuple(r)[1:]
    want = {m: {a.round_id: tuple(getattr(a, c) for c in semantics.names(rounds.ATTEMPTS)) for a in rounds.fold_match(rows).attempts} for m, rows in feeds.items()}
    assert got == {m: w for m, w in want.items() if w}
    assert {"void", "completed", "result-missing", "result-unconfirmed"} == {a[8] for w in want.values() for a in w.values()} and any("score-rollback" in (a[10] or "") for w in want.values() for a in w.values())


def test_members_of_commands_do_not_travel(feed):
    """What is in no frame is not even made: it would be most of what is shuffled."""
    poison = F.when(F.col("kind") == semantics.COMMAND, F.raise_error(F.lit("a command's members")).cast(feed.schema["members"].dataType)).otherwise(F.col("members"))
    whole = feed.drop("at")
    got, want = (sorted(map(str, semantics.collected(f).frames.collect())) for f in (whole.withColumn("members", poison), whole))
    assert got == want and got
