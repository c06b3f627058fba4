"""Greedy selections against the plain fold over all rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import greedy


def fold(rows, keys):
    seen, out = [set() for _ in keys], []
    for r in sorted(rows):
        if not any(r[k] is not None and r[k] in s for k, s in zip(keys, seen, strict=True)):
            out.append(r)
            for k, s in zip(keys, seen, strict=True):
                s.add(r[k])
    return out


@pytest.mark.parametrize("values", [3, 40, 400])
def test_first_of_keys_equals_the_fold(spark, values):
    rng = random.Random(values)
    pick = lambda: rng.choice([None, *range(values)])
    rows = [(k // 100, k, pick(), pick(), f"h{rng.randrange(values)}") for k in range(300)]
    df = spark.createDataFrame(rows, "split int, id int, a int, b int, c string").repartition(5)
    got = sorted(map(tuple, greedy.first_of_keys(df, ["a", "b", "c"], ["split", "id"]).collect()))
    assert got == fold(rows, (2, 3, 4))


def test_first_of_keys_on_chains_and_odd_rows(spark):
    chain = [(k, k // 2, (k + 1) // 2) for k in range(12)]  # each row shares a value with the next
    df = spark.createDataFrame(chain, "id int, a int, b int")
    assert sorted(map(tuple, greedy.first_of_keys(df, ["a", "b"], ["id"]).collect())) == fold(chain, (1, 2))
    assert greedy.first_of_keys(df.filter("false"), ["a"], ["id"]).count() == 0
    with pytest.raises(Exception, match="tell all rows apart"):
        greedy.first_of_keys(df.union(df), ["a"], ["id"]).collect()


def plain_cover(rows, count, targets, by, existing=None):
    counts, chosen, seen = dict(existing or {}), [], set()
    left = sorted(rows, key=lambda r: r["id"])
    for r in [r for r in left if r["taken"]][:count]:
        chosen.append(r)
        left.remove(r)
        seen.add(r["round"])
        for t in set(r["tags"]) & set(targets):
            counts[t] = counts.get(t, 0) + 1
    while left and len(chosen) < count:
        def worth(r):
            t = set(r["tags"]) & set(targets)
            fresh = sum(counts.get(x, 0) == 0 for x in t)
            return {
                "deficit": (sum(max(0, targets[x] - counts.get(x, 0)) for x in t),), "uncovered": (fresh,),
                "rarest": (fresh, sum(1_000_000 // (1 + counts.get(x, 0)) for x in t), len(t), r["round"] not in seen),
            }[by]
        best = max(left, key=worth)
        chosen.append(best)
        left.remove(best)
        seen.add(best["round"])
        for t in set(best["tags"]) & set(targets):
            counts[t] = counts.get(t, 0) + 1
    return [r["id"] for r in chosen]


@pytest.mark.parametrize("by", ["deficit", "uncovered", "rarest"])
def test_covering_equals_the_plain_greedy(spark, by):
    rng = random.Random(by)
    rows = [{"g": rng.choice(["x", "y", None]), "id": k, "round": rng.randrange(4), "tags": rng.sample("abcdez", rng.randrange(4)) + ["a"] * rng.randrange(2), "taken": rng.random() < 0.02} for k in range(300)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "g string, id int, round int, tags array<string>, taken boolean").repartition(4)
    targets = {"a": 3, "b": 2, "c": 5, "d": 1, "e": 4, "never": 2}
    how = {"spread": "round"} if by == "rarest" else {}
    out = greedy.covering(df, ["g"], "tags", ["id"], 12, targets, by, taken="taken", existing={"a": 1}, **how)
    got = {}
    for r in out.orderBy("pick").collect():
        got.setdefault(r.g, []).append(r.id)
    assert got == {g: plain_cover([r for r in rows if r["g"] == g], 12, targets, by, {"a": 1}) for g in ("x", "y", None)}
    short = {r.tag: (r.have, r.missing) for r in greedy.missing_tags(out.filter("g = 'x'"), df.filter("g = 'x'"), ["g"], "tags", targets).collect()}
    assert short["never"] == (0, 2) and all(missing == max(0, targets[t] - have) for t, (have, missing) in short.items())
    assert greedy.covering(df.filter("false"), ["g"], "tags", ["id"], 3, targets).count() == 0


def test_assignment_equals_all_choices(spark):
    rng = random.Random(9)
    allowed = ["plant", "kill", "defuse", "drop"]
    cases = [[rng.sample([*allowed, "other"], rng.randrange(4)) for _ in range(rng.randrange(4))] for _ in range(120)]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "id int, events array<array<string>>")
    got = {r.id: r.a for r in df.select("id", greedy.assigned(F.col("events"), allowed).alias("a")).collect()}
    for k, case in enumerate(cases):
        ways = [w for w in itertools.product(*([e for e in allowed if e in own] for own in case)) if len(set(w)) == len(w)]
        assert got[k] == (sorted(ways[0]) if ways else None)


def test_anchors(spark):
    rows = [("r", "start", 10), ("r", "bomb", 10), ("r", "bomb", 40), ("r", "split", 10), ("r", "split", 40), ("r", None, 90), ("r", None, 60), ("r", "late", 95), ("s", None, 5), ("s", None, 6), ("t", "late", None)]
    df = spark.createDataFrame(rows, "round string, kind string, tick long")
    run = lambda cap, **how: {(r.round, r.tick): r.tags for r in greedy.anchors(df, ["round"], "kind", "tick", ["start", "bomb", "split", "late"], cap, **how).collect()}
    assert run(4) == {("r", 10): ["split", "start"], ("r", 40): ["bomb"], ("r", 95): ["late"], ("r", 60): ["fill"], ("s", 5): ["fill"], ("s", 6): ["fill"]}
    assert run(2, fill=None) == {("r", 10): ["split", "start"], ("r", 40): ["bomb"]}


def plain_anchors(rows, priority, cap, fill):
    listed, chosen = {}, {}
    for _, name, t in rows:
        if t is not None:
            listed.setdefault(t, set()).add(name)
    for name in priority:
        own = [t for t in sorted(listed) if name in listed[t]]
        pick = next((t for t in own if t not in chosen), own[0] if own else None)
        if pick in chosen or (own and len(chosen) < cap):
            chosen.setdefault(pick, []).append(name)
    while fill and len(chosen) < min(cap, len(listed)):
        rest = [t for t in sorted(listed) if t not in chosen]
        chosen[max(rest, key=lambda t: min((abs(t - c) for c in chosen), default=0))] = [fill]
    return {t: sorted(names) for t, names in chosen.items()}


@pytest.mark.parametrize("cap", [0, 2, 6])
@pytest.mark.parametrize("fill", ["fill", None])
def test_anchors_equal_the_plain_choice_without_a_call_for_each_group(spark, cap, fill):
    """Groups are many and small: a Python call for each would cost more than all choices."""
    rng = random.Random(cap)
    rows = [(rng.choice([*range(40), None]), rng.choice(["a", "b", "c", "z", None]), rng.choice([None, *range(-20, 20)])) for _ in range(500)]
    out = greedy.anchors(spark.createDataFrame(rows, "g int, k string, t int").repartition(3), ["g"], "k", "t", ["b", "a", "c"], cap, fill)
    got = {}
    for r in out.collect():
        assert r.t not in got.setdefault(r.g, {})
        got[r.g][r.t] = r.tags
    whole = {g: plain_anchors([r for r in rows if r[0] == g], ["b", "a", "c"], cap, fill) for g in {r[0] for r in rows}}
    assert got == {g: w for g, w in whole.items() if w}
    assert "InPandas" not in out._jdf.queryExecution().toString()
