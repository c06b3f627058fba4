"""Snapshots of frames and of events between them; tracks active at a time."""

import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import snapshots

FRAME = "match string, tick long, score_t int, score_ct int, losses_t int, losses_ct int, bomb string, explosion double, defuse double"
MEMBER = "match string, tick long, id int, team string, alive boolean, health int, kills int, deaths int, x double, y double, equipment struct<money:int,armor:int,helmet:boolean,defuser:boolean,value:int,items:array<struct<category:string,count:int>>>"
SITES = {"a": (0.1, 0.2), "b": (0.8, 0.5)}


def frame(rng, match, tick):
    return (match, tick, rng.randrange(9), rng.randrange(9), rng.randrange(4), rng.randrange(4), rng.choice(["carried", "dropped", "planted", "defusing", None]), rng.choice([None, 30.0]), rng.choice([None, 5.0]))


def members(rng, match, tick, n=10):
    return [
        (match, tick, k, "T" if k < 5 else "CT", rng.random() < 0.7, rng.randrange(100), k, 1, rng.choice([None, rng.random(), rng.random(), rng.random()]), rng.random(), rng.choice([None, (800, 100, True, False, 4000, [("rifle", 1), ("grenade", 2)])]))
        for k in range(n)
    ]


@pytest.fixture(scope="module")
def match(spark):
    rng = random.Random(6)
    frames = [frame(rng, m, t) for m in "xy" for t in range(0, 640, 64)]
    extras = [frame(rng, m, t) for m in "xy" for t in (-5, 10, 11, 64, 200, 630)]
    people = lambda rows: [p for r in rows if r[1] != 128 for p in members(rng, r[0], r[1])]
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl).repartition(3)
    return make(frames, FRAME), make(people(frames), MEMBER), make(extras, FRAME), make(people(extras), MEMBER)


def rows_of(df):
    return {(r.match, r.tick): r for r in df.collect()}


def test_a_snapshot_has_all_columns(match):
    frames, people, _, _ = match
    out = snapshots.snapshots(frames, people, ["match"], SITES, 64.0)
    assert len(out.columns) == 2 + 48 and out.count() == frames.count()
    got = rows_of(out)
    assert got["x", 128].t_places_missing and got["x", 128].nearest_opponent_missing and got["x", 128].total_alive == 0 and got["x", 128].t_mean_a is None
    source = {(r.match, r.tick): r for r in frames.collect()}
    for k, r in got.items():
        assert r.score_difference == source[k].score_t - source[k].score_ct and r.has_defuse_timer == (source[k].defuse is not None)
    states = [source["x", t].bomb for t in range(0, 640, 64)]
    assert got["x", 576].bomb_changes == 1 + sum(a != b for a, b in zip(states, states[1:], strict=False)) and got["x", 576].bomb_was_planted == ("planted" in states)
    living = [p for p in people.filter("match = 'x' AND tick = 64 AND alive AND x IS NOT NULL").collect()]
    t = [(p.x, p.y) for p in living if p.team == "T"]
    mx, my = (sum(c) / len(t) for c in zip(*t, strict=True))
    assert got["x", 64].t_dispersion == pytest.approx((sum((x - mx) ** 2 + (y - my) ** 2 for x, y in t) / len(t)) ** 0.5)
    assert got["x", 64].t_mean_a == pytest.approx(sum(((x - 0.1) ** 2 + (y - 0.2) ** 2) ** 0.5 for x, y in t) / len(t))


def test_events_change_no_regular_row_nor_each_other(match):
    frames, people, extras, others = match
    both = snapshots.event_snapshots(frames, people, extras, others, ["match"], SITES, 64.0)
    regular = rows_of(both.filter("source = 'regular'").drop("source"))
    assert regular == rows_of(snapshots.snapshots(frames, people, ["match"], SITES, 64.0))
    added = rows_of(both.filter("source = 'event'").drop("source"))
    assert set(added) == {(m, t) for m in "xy" for t in (-5, 10, 11, 200, 630)}  # the one at a regular tick is left out
    for tick in (-5, 11, 200, 630):
        alone = frames.filter(F.col("tick") < tick).unionByName(extras.filter(F.col("tick") == tick))
        seen = people.filter(F.col("tick") < tick).unionByName(others.filter(F.col("tick") == tick))
        want = rows_of(snapshots.snapshots(alone, seen, ["match"], SITES, 64.0).filter(F.col("tick") == tick))
        assert {k: r for k, r in added.items() if k[1] == tick} == want


def test_event_states(spark):
    frames = spark.createDataFrame([("x", 1, "old"), ("x", 2, "old")], "match string, tick int, v string")
    extra = spark.createDataFrame([("x", 2, "new"), ("x", 3, "new")], "match string, tick int, v string")
    keep = lambda k: {r.tick: r.v for r in snapshots.with_event_states(frames, extra, ["match", "tick"], k).collect()}
    assert keep(False) == {1: "old", 2: "old", 3: "new"} and keep(True) == {1: "old", 2: "new", 3: "new"}
    parts = [frames.select("match", "tick", F.lit("regular").alias("trigger")), extra.select("match", "tick", F.lit("event-after").alias("trigger"))]
    assert {r.tick: r.triggers for r in snapshots.merged_triggers(parts, ["match", "tick"]).collect()} == {1: ["regular"], 2: ["event-after", "regular"], 3: ["event-after"]}


def test_tracks_against_all_pairs(spark):
    rng = random.Random(3)
    tracks = []
    for k in range(60):
        start = rng.randrange(900)
        ticks = sorted(rng.sample(range(start, start + 200), rng.randrange(0, 6)))
        tracks.append((rng.choice("xy"), f"t{k}", start, start + rng.randrange(200), [(t, rng.choice([0.0, 1.0, rng.random()]), 0.5) for t in ticks]))
    probes = [(rng.choice("xy"), k, rng.randrange(1200), rng.choice([0.0, 0.5]), 0.5) for k in range(150)]
    t = spark.createDataFrame([(*r[:4], rng.sample(r[4], len(r[4]))) for r in tracks], "match string, track string, start_tick long, end_tick long, points array<struct<tick:long,x:double,y:double>>")
    p = spark.createDataFrame(probes, "match string, id int, tick long, x double, y double")

    def plain(lag):
        for m, k, at, x, y in probes:
            for n, name, a, b, points in tracks:
                seen = [q for q in points if q[0] <= at]
                if m == n and a <= at <= b + lag and seen:
                    yield k, name, a, seen[-1], (seen[-1][1] - x) ** 2 + (seen[-1][2] - y) ** 2

    got = {(r.id, r.track): tuple(r["last"]) for r in snapshots.active_samples(p, t, ["match"], "tick", "start_tick", "end_tick", "points", 128).collect()}
    assert got == {(k, name): last for k, name, _, last, _ in plain(0)}
    near = {r.id: r.track for r in snapshots.nearest_track(p, t, ["match"], "tick", "id", "track", "start_tick", "end_tick", "points", 128, 64).collect()}
    best = {}
    for k, name, a, _, d in plain(64):
        best[k] = min(best.get(k, (d, a, name)), (d, a, name))
    assert near == {r[1]: best[r[1]][2] if r[1] in best else None for r in probes}
