"""Operators on hand-made rows: ties, gaps, unknowns, and the guards that fail."""

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import scalar
from tidegrid.operators import asof, evaluate, facts, relations, rounds, samples, select, sequence, spatial


def test_asof_ties_nulls_and_later_rows(spark):
    probes = spark.createDataFrame([("a", 5, 1), ("a", 9, 2), ("b", 5, 3), (None, 5, 4)], "k string, t long, id int")
    states = spark.createDataFrame([("a", 5, 1, "x"), ("a", 5, 2, "y"), ("a", 8, 1, None), ("a", 10, 1, "late")], "k string, t long, seq int, v string")
    run = lambda **how: {r.id: r.v for r in asof.asof_join(probes, states, ["k"], "t", ["v"], ties=["seq"], **how).collect()}
    assert run() == run(span=3) == {1: "y", 2: None, 3: None, 4: None}
    assert run(strict=True)[1] is None and run(direction="forward") == run(direction="forward", span=3) == {1: "x", 2: "late", 3: None, 4: None}
    assert run(tolerance=0) == {1: "y", 2: None, 3: None, 4: None}


def test_asof_takes_the_place_of_a_column_of_that_name(spark):
    probes = spark.createDataFrame([(1, 5, "own"), (2, 1, "own")], "k int, t long, v string")
    states = spark.createDataFrame([(1, 4, "found"), (2, 4, "late")], "k int, t long, v string")
    got = asof.asof_join(probes, states, ["k"], "t", ["v"])
    assert got.columns == ["k", "t", "v"] and sorted((r.k, r.v or "") for r in got.collect()) == [(1, "found"), (2, "")]
    got = asof.asof_or_default(probes, states, ["k"], "t", ["v"], {"v": F.lit("none")})
    assert sorted((r.k, r.v) for r in got.collect()) == [(1, "found"), (2, "none")]
    got = asof.asof_guarded(probes, states, ["k"], "t", ["v"], F.col("t") > 5)
    assert sorted((r.k, r.v) for r in got.collect()) == [(1, None), (2, None)]


def test_intervals_without_end_and_overlaps(spark):
    points = spark.createDataFrame([(1, 0), (1, 5), (1, 1000), (2, 5), (1, None)], "k int, t long")
    spans = spark.createDataFrame([(1, 0, 5, "a"), (1, 4, None, "b"), (1, 9, 7, "never"), (2, None, 9, "none")], "k int, s long, e long, n string")
    got = sorted((r.k, r.t, r.n) for r in asof.interval_join(points, spans, ["k"], "t", "s", "e", 10).collect())
    assert got == [(1, 0, "a"), (1, 5, "b"), (1, 1000, "b")]
    got = sorted((r.k, r.t, r.n) for r in asof.interval_join(points, spans, ["k"], "t", "s", "e", 10, closed=True).collect())
    assert got == [(1, 0, "a"), (1, 5, "a"), (1, 5, "b"), (1, 1000, "b")]
    rows = spark.createDataFrame([(1, 6, 8), (1, 5, 5), (1, 0, 100), (1, 8, 6), (2, 0, 9), (1, None, 5)], "k int, a long, b long")
    got = sorted((r.k, r.a, r.b) for r in asof.overlaps(rows, spans, ["k"], "s", "e", "a", "b").collect())
    assert got == [(1, 0, 100), (1, 5, 5)]


def test_transitions_through_a_null_state(spark):
    rows = spark.createDataFrame([("k", 1, "x"), ("k", 2, None), ("k", 3, None), ("k", 4, "a")], "k string, t int, s string")
    got = [(r.changes, r.previous) for r in sequence.transitions(rows, ["k"], ["t"], "s").orderBy("t").collect()]
    assert got == [(1, None), (2, "x"), (2, "x"), (3, None)]


def test_null_keys_compare_and_overlay(spark):
    a = spark.createDataFrame([(None, "x"), (1, "y"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(None, "z"), (2, None), (3, "w")], "k int, v string")
    assert tuple(relations.compared(a, b, ["k"], ["v"]).first()) == (2, 1, 1, 1, 0)
    got = {(r.k, r.v, r.overlaid) for r in relations.overlaid(a, b, ["k"], ["v"]).collect()}
    assert got == {(None, "z", True), (1, "y", False), (2, None, True), (3, "w", True)}


def test_bootstrap_equals_naive_resampling(spark):
    import hashlib

    import numpy as np

    rows = [(f"m{k % 5}", 0.1 + 0.8 * (k * 7 % 11) / 11, 0.5, k % 2, 1.0 + k % 3) for k in range(40)] + [("m0", None, 0.5, 1, 9.0), ("m9", 0.2, None, 1, 9.0)]
    d = spark.createDataFrame(rows, "m string, p double, q double, y int, w double")
    got = {r.metric: (r.value, r.low, r.high) for r in evaluate.cluster_bootstrap(d, "m", other="q", rounds=50).collect()}
    seen = [r for r in rows if None not in r]
    loss = {"log_loss": lambda p, y: -np.log(p if y else 1 - p), "brier": lambda p, y: (p - y) ** 2}
    for metric, f in loss.items():
        mean = lambda taken: sum(w * (f(p, y) - f(q, y)) for m in taken for k, p, q, y, w in seen if k == m) / sum(r[4] for m in taken for r in seen if r[0] == m)  # noqa: B023, E731
        names = sorted({r[0] for r in seen})
        draws = [[names[int(hashlib.md5(f"7|{r * 5 + k}".encode()).hexdigest()[:13], 16) % 5] for k in range(5)] for r in range(50)]
        each = [mean(taken) for taken in draws]
        assert got[metric] == pytest.approx((mean(names), np.percentile(each, 2.5), np.percentile(each, 97.5)), abs=1e-12)
    with pytest.raises(ValueError, match="resampled"):
        evaluate.cluster_bootstrap(d.filter("m = 'm1'"), "m")


def test_min_gap_with_holes(spark):
    rows = spark.createDataFrame([("m", t) for t in (3, 9, 70, 80, 140, 141)] + [("n", None), ("n", 1)], "k string, t long")
    assert sorted((r.k, r.t) for r in sequence.min_gap(rows, ["k"], "t", 64).collect()) == [("m", 3), ("m", 70), ("m", 140), ("n", 1)]


def test_sessions_merge_an_exact_gap(spark):
    rows = spark.createDataFrame([(1, 0), (1, 64), (1, 129)], "k int, t long")
    assert [r.session for r in sequence.sessions(rows, ["k"], "t", 64).orderBy("t").collect()] == [1, 1, 2]


def test_interpolation_turns_the_short_way(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 350.0, True), (1, 10, 10.0, 10.0, True), (2, 0, 0.0, 0.0, True), (2, 10, 10.0, 90.0, False)], "k int, t long, x double, yaw double, alive boolean")
    out = {r.k: (r.x, round(r.yaw, 6)) for r in sequence.interpolate(rows, ["k"], "t", F.lit(5), ["x"], "yaw", ["alive"]).collect()}
    assert out == {1: (5.0, 0.0), 2: (0.0, 0.0)}


def test_guards_fail(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(Exception, match="rows of one key differ"):
        relations.strict_union([a, a], ["k"]).collect()
    with pytest.raises(Exception, match="a lookup key repeats"):
        relations.unique_lookup(a.select("k"), a, ["k"]).collect()
    with pytest.raises(Exception, match="more than one value"):
        a.groupBy("k").agg(relations.only_value(F.col("v"))).collect()


def test_spatial_distances_and_unknowns(spark):
    rows = [("T", 1, 0.0, 0.0), ("T", 2, 3.0, 4.0), ("T", 3, 6.0, 8.0), ("CT", 4, 0.0, 12.0), ("CT", 5, 0.0, 20.0)]
    d = spark.createDataFrame([(1, *r) for r in rows] + [(2, "T", 1, float("nan"), 0.0), (2, "CT", 2, 1.0, 1.0)], "frame int, team string, id int, x double, y double")
    out = {r.frame: r for r in spatial.around(spatial.teams(d, ["frame"]), ["frame"], F.lit(0.0), F.lit(0.0), 5.0).collect()}
    assert (out[1].t_nearest, out[1].t_second, out[1].t_within, out[1].ct_nearest, out[1].ct_second) == (0.0, 5.0, 2, 12.0, 20.0)
    assert out[1].t_support_max == 5.0 and out[2].t_nearest is None and out[2].t_within is None and out[2].ct_nearest is not None


def test_perfect_scores_and_single_class(spark):
    d = spark.createDataFrame([("a", 0.0, 0, 1.0), ("a", 1.0, 1, 1.0), ("b", 0.5, 1, 1.0), ("b", None, 1, 1.0)], "k string, p double, y int, w double")
    auc = {r.k: r.auc for r in evaluate.auc(d, ["k"]).collect()}
    assert auc == {"a": 1.0, "b": None}
    m = {r.k: r for r in evaluate.metrics(d, ["k"]).collect()}
    assert m["a"].brier == 0 and m["b"].row_coverage == 0.5


def boundary(tick, **kw):
    base = dict(tick=tick, seq=0, raw_round=0, rounds_played=0, score_t=0, score_ct=0, warmup=False, match_started=True, freeze=False, team_intro=False, start_count=0, start=False, live=False, end=False, winner=None, reason=None)
    return base | kw


SCRIPT = [
    boundary(100, start=True, start_count=1, freeze=True), boundary(200, live=True),
    boundary(300, end=True, winner="T", reason="bomb", rounds_played=1, score_t=1, start=True, start_count=2),
    boundary(400, live=True, raw_round=1, rounds_played=1, score_t=1), boundary(410, start=True, start_count=2),
    boundary(500, end=True, winner=None, reason="draw"), boundary(600, start=True, start_count=3),
    boundary(700, live=True, raw_round=0, rounds_played=0),
]


def test_rounds_end_before_start_and_roll_back(spark):
    match = rounds.fold_match(SCRIPT)
    found = [(a.round_id, a.round_number, a.disposition, a.reason) for a in match.attempts]
    assert found == [
        ("s0-a1", 1, "void", "score-rollback:bomb"), ("s0-a2", 2, "void", "draw"), ("s0-a3", None, "void", "rules-score-reset"), ("s1-a4", 1, "result-missing", "end-of-demo"),
    ]
    before = rounds.fold_match(SCRIPT[:3]).attempts[0]
    assert before.disposition == "completed"
    d = spark.createDataFrame([(m, *(r[x.split()[0].strip("`")] for x in rounds.OBSERVED.replace("\n", " ").split(", "))) for m in ("x", "y") for r in SCRIPT], f"match_id string, {rounds.OBSERVED}")
    out = sorted((r.match_id, r.round_id, r.round_number, r.disposition, r.reason) for r in rounds.round_attempts(d).collect())
    assert out == sorted((m, *f) for m in ("x", "y") for f in found)


CLOCK = "match_id string, tick long, round_id string, phase string, game_time double, round_start_time double, round_time int, paused boolean, technical boolean, waiting boolean, t_timeout boolean, ct_timeout boolean, paused_ticks int, explosion double, defuse double"


def test_round_clocks(spark):
    def row(match, tick, **kw):
        base = dict(round_id="r", phase="live", game_time=10.0, round_start_time=10.0, round_time=115, paused=False, technical=False, waiting=False, t_timeout=False, ct_timeout=False, paused_ticks=0, explosion=None, defuse=None)
        return (match, tick, *(base | kw).values())

    rows = [
        row("a", 1), row("a", 2, t_timeout=True, waiting=True, game_time=20.0), row("a", 3, paused=True), row("a", 4, game_time=30.0), row("a", 5, round_id="q", phase="freeze"),
        row("a", 6, round_id="q", phase="post-plant", game_time=50.0, explosion=9.0, defuse=float("nan")), row("a", 7, round_id="q", paused_ticks=4), row("a", 8, round_id=None),
        row("b", 1, phase="freeze", paused=True, paused_ticks=3), row("b", 2, paused_ticks=7, game_time=10.1), row("b", 3, paused_ticks=7, game_time=12.0), row("b", 4, paused_ticks=8),
        row("c", 1, phase="freeze", technical=True), row("c", 2, game_time=11.0), row("d", 1, phase=None, paused=None), row("d", 2, game_time=None), row("d", 3, game_time=float("inf"), paused_ticks=None),
    ]
    d = spark.createDataFrame(rows, CLOCK)
    out = {(r.match_id, r.tick): r for r in rounds.round_clocks(d).collect()}
    assert {k: r.remaining for k, r in out.items() if r.remaining is not None} == {("a", 1): 115.0, ("a", 2): 105.0, ("b", 2): pytest.approx(114.9), ("b", 3): 113.0}
    assert {k for k, r in out.items() if r.known} == {("a", 1), ("a", 2), ("a", 6), ("b", 2), ("b", 3)}
    assert (out["a", 6].elapsed, out["a", 6].to_explosion, out["a", 6].to_defuse) == (40.0, 9.0, None) and out["a", 2].pause == "tactical-timeout-flag"
    assert {k for k, r in out.items() if r.source == "unsupported-pause"} == {("a", 3), ("a", 4), ("a", 7), ("b", 1), ("b", 4), ("c", 1), ("c", 2), ("d", 3)}
    for last in (2, 4):  # what is known at a row never depends on later ones
        assert all(out[r.match_id, r.tick] == r for r in rounds.round_clocks(d.filter(f"tick <= {last}")).collect())
    assert rounds.round_clocks(d.filter("false")).count() == 0


def test_rosters(spark):
    ten = [(f"{t}{k}", t) for t in ("T", "CT") for k in range(5)]
    seen = [("r", 1, m, t, True, True, True) for m, t in ten]
    seen += [("r", 2, m, t, None if m == "T1" else True, True, m != "CT4") for m, t in ten[1:]]  # T0 out of sight, T1's life unknown
    seen += [("r", 3, m, t, m != "T1", True, True) for m, t in ten]
    seen += [("r", 4, m, t, None if m == "T1" else True, True, True) for m, t in ten] + [("r", 4, "s", "spectator", True, True, True)]
    seen += [("q", 5, m, t, True, True, True) for m, t in ten] + [("q", 5, "0", "CT", True, True, True)]
    s = spark.createDataFrame([("m", *r) for r in seen], "match_id string, round_id string, tick long, member string, team string, alive boolean, position boolean, equipment boolean")
    f = spark.createDataFrame([("m", "r", k) for k in range(5)] + [("m", "q", 5)], "match_id string, round_id string, tick long")
    deaths = spark.createDataFrame([("m", "r", 4, "CT0")], "match_id string, round_id string, tick long, member string")
    out = {r.tick: (r.t, r.ct, r.life_known, r.alive, r.quality, r.reasons) for r in rounds.rosters(f, s, deaths).collect()}
    assert out[0] == (0, 0, 0, 0, "unusable", ["roster-unconfirmed"]) and out[1] == (5, 5, 10, 10, "usable", [])
    assert out[2] == (5, 5, 8, 8, "unusable", ["life-unknown", "alive-equipment-unknown"])
    assert out[3] == (5, 5, 10, 9, "usable", []) and out[4] == (5, 5, 10, 8, "usable", [])
    assert out[5][:2] == (5, 6) and out[5][4:] == ("unusable", ["roster-unconfirmed"])


def test_farthest_points(spark):
    d = spark.createDataFrame([("r", t, t) for t in (0, 1, 2, 50, 99, 100)], "k string, t long, id long")
    assert [r.t for r in select.farthest_points(d, ["k"], "t", "id", 4).orderBy("pick").collect()] == [0, 100, 50, 2]


def test_scalars(spark):
    one = spark.range(1)
    row = one.select(scalar.rounded(F.lit(-2.5), 0).alias("a"), scalar.short_number(F.lit(1.5)).alias("b"), scalar.short_number(F.lit(3.0)).alias("c"), scalar.clock(F.lit(6005)).alias("d"),
                     scalar.clamp(F.lit(None).cast("double"), 0.0, 1.0).alias("e"), scalar.finite(F.lit(float("nan"))).alias("f"), scalar.finite_not_negative(F.lit(-1.0)).alias("g")).first()
    assert tuple(row) == (-3.0, "1.5", "3", "100:05", None, None, None)


def test_confirmed_states(spark):
    events = [(1, 1, "kill", "a"), (2, 1, "kill", None), (3, 1, "bomb-planted", None), (4, 1, "bomb-defuse-start", "c"), (5, 1, "bomb-defuse-start", "c"), (6, 1, "bomb-exploded", None), (7, 1, "kill", "x"), (8, 1, "bomb-planted", None), (8, 2, "bomb-defuse-abort", None), (9, 1, "chat", None)]
    states = [
        (1, ["b"], ["c"], None, None, None), (2, ["b"], ["c"], None, None, None), (3, ["b"], ["c"], "planted", None, None), (4, ["b", "c"], ["c"], "defusing", "c", 3.0), (5, ["b", "c"], ["c"], "defusing", "d", 3.0),
        (6, [], [], "planted", None, None), (7, ["x"], [], None, None, None), (8, [], [], "defusing", None, None), (9, [], [], None, None, None), (10, [], [], None, None, None),
    ]
    s = spark.createDataFrame([("m", *r) for r in states], "match_id string, tick int, alive_ids array<string>, ct_alive_ids array<string>, bomb_state string, defuser string, to_defuse double")
    e = spark.createDataFrame([("m", *r) for r in events], "match_id string, tick int, seq int, type string, subject string")
    assert {r.tick for r in samples.confirmed(s, e).filter("confirmed").collect()} == {1, 3, 4}


def test_samples_of_frames_without_members_or_equipment(spark):
    gear = "struct<money:int,armor:int,helmet:boolean,defuser:boolean,value:int,items:array<struct<category:string,count:int>>>"
    rows = [(1, "T", True, -5, 1, 0, (100, 50, True, False, 900, [("rifle", 1), ("grenade", 2)])), (1, "T", False, 0, 0, 1, None), (2, None, True, 10, 0, 0, None)]
    d = spark.createDataFrame(rows, f"frame int, team string, alive boolean, health int, kills int, deaths int, equipment {gear}")
    out = {r.frame: r for r in samples.team_summaries(d, ["frame"]).collect()}
    assert (out[1].t_alive, out[1].t_health, out[1].t_known, out[1].t_money, out[1].t_grenades, out[1].t_snipers, out[1].ct_money, out[1].ct_members) == (1, 0, 1, 100, 2, 0, 0, 0)
    assert out[2].t_members == out[2].ct_members == 0
    base = {r.frame: r for r in samples.baseline(samples.team_summaries(d, ["frame"]), ["frame"]).collect()}
    assert base[1].clutch and base[1].t_coverage == 0.5 and base[2].t_mean_health == 0.0 and not base[2].clutch
    row = spark.range(1).select(*(c.alias(n) for n, c in samples.presence_only(["id"]).items()), samples.broad_endgame(F.lit(None).cast("string"), F.lit(1), F.lit(1)).alias("b")).first()
    assert tuple(row) == (0.0, False)


def test_scalars_that_guard(spark):
    one = lambda *c: tuple(spark.range(1).select(*(x.alias(f"c{k}") for k, x in enumerate(c))).first())
    lit = lambda v: F.lit(v).cast("double")
    assert one(scalar.at_most(lit(1.0000004), lit(1)), scalar.at_most(lit(1.000001), lit(1)), scalar.at_least(lit(0.9999996), lit(1))) == (True, False, True)
    assert one(scalar.distance(lit(0), lit(0), lit(3), lit(4)), scalar.distance(lit(None), lit(0), lit(3), lit(4))) == (5.0, None)
    assert one(scalar.facing(lit(1), lit(0), lit(10), 0.9), scalar.facing(lit(-1), lit(0), lit(10), 0.9), scalar.facing(lit(0), lit(0), lit(10), 0.9)) == (True, False, None)
    assert one(scalar.null_if_either(lit(1), lit(None), lit(5)), scalar.affine(lit(3), 1.0, 2.0), scalar.affine(lit(3), 1.0, 2.0, True)) == (None, 1.0, -1.0)
    assert one(scalar.calibrated(lit(0.5), 2.0, 0.0), scalar.calibrated(lit(1.0), 5.0, 0.0)) == (0.5, 1 - 1e-6)
    assert one(*scalar.masked({"a": lit(1)}, F.lit(False)).values()) == (None,)


def test_formation_and_isolation_by_rules(spark):
    at = {1: [("T", 1, 0.1, 0.1), ("T", 2, 0.15, 0.1), ("T", 3, 0.2, 0.1), ("CT", 9, 0.9, 0.9)], 2: [("T", 1, 0.1, 0.1), ("T", 2, 0.15, 0.1), ("T", 3, 0.8, 0.1), ("T", 4, 0.85, 0.1)], 3: [("T", 1, 0.1, 0.1), ("T", 2, 0.5, 0.1), ("CT", 9, 0.45, 0.1), ("CT", 8, 0.46, 0.1)], 4: [("T", 1, None, 0.1), ("T", 2, 0.5, 0.1)]}
    d = spark.createDataFrame([(f, *r) for f, rows in at.items() for r in rows], "frame int, team string, id int, x double, y double")
    sides = spatial.teams(d, ["frame"])
    assert {r.frame: r.formation for r in facts.formation(sides, ["frame"], "t").collect()} == {1: "grouped", 2: "split", 3: "spread", 4: "unknown"}
    out = {r.frame: (r.isolated, r.t_isolated, r.ct_isolated) for r in facts.isolated_side(sides, ["frame"]).collect()}
    assert out == {1: ("CT", [], [9]), 2: ("none", [], []), 3: ("T", [1, 2], []), 4: ("unknown", None, None)}
