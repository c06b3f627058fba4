"""Samples of a match for a model: what a frame's members and their equipment add up to, and what events confirm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalar import finite, null_if_either

Names = Sequence[str]

# Names that inputs and results carry.
REGIONS = {"BombsiteA": "A Site", "BombsiteB": "B Site", "TSpawn": "T Spawn", "CTSpawn": "CT Spawn"}
WEAPONS = {
    "objective": ["weapon_c4"],
    "pistol": ["weapon_glock", "weapon_hkp2000", "weapon_usp_silencer", "weapon_p250", "weapon_deagle", "weapon_elite", "weapon_fiveseven", "weapon_tec9", "weapon_cz75a", "weapon_revolver"],
    "smg": ["weapon_mac10", "weapon_mp9", "weapon_mp7", "weapon_mp5sd", "weapon_ump45", "weapon_p90", "weapon_bizon"],
    "shotgun": ["weapon_nova", "weapon_xm1014", "weapon_mag7", "weapon_sawedoff"],
    "sniper": ["weapon_awp", "weapon_ssg08", "weapon_scar20", "weapon_g3sg1"],
    "heavy": ["weapon_m249", "weapon_negev"],
    "rifle": ["weapon_ak47", "weapon_galilar", "weapon_famas", "weapon_m4a1", "weapon_m4a1_silencer", "weapon_aug", "weapon_sg556"],
}
KEY_EVENTS = ["kill", "bomb-planted", "bomb-defuse-start", "bomb-defuse-abort", "bomb-defused", "bomb-exploded"]
OUTCOMES = ["bomb-defused", "bomb-exploded"]
ARMED = ["planted", "defusing"]
ROUND_PHASES = ["live", "post-plant"]


def region(name: Column) -> Column:
    """A place's usual name; unknown for a blank one."""
    trimmed = F.trim(name)
    other = F.create_map(*(F.lit(v) for kv in REGIONS.items() for v in kv))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", "unknown").otherwise(F.coalesce(other[trimmed], trimmed))


def weapon_class(weapon: Column, grenade: Column) -> Column:
    """A weapon's class; grenade: whether it is one by the caller's own list. Unknown for a blank one."""
    found = F.when(F.coalesce(F.trim(weapon), F.lit("")) == "", "unknown").when(grenade, "grenade").when(weapon.contains("knife") | (weapon == "weapon_bayonet"), "knife")
    for name, weapons in WEAPONS.items():
        found = found.when(weapon.isin(weapons), name)
    return found.otherwise("other")


def round_phase(warmup: Column, intro: Column, ended: Column, bomb: Column, freeze: Column, live: Column) -> Column:
    """The first that holds: warmup, team-intro, ended, post-plant, freeze (also before the round is live), live."""
    no = F.lit(False)
    return (
        F.when(F.coalesce(warmup, no), "warmup").when(F.coalesce(intro, no), "team-intro").when(F.coalesce(ended, no), "ended")
        .when(bomb.isin(ARMED), "post-plant").when(F.coalesce(freeze, no) | ~F.coalesce(live, no), "freeze").otherwise("live")
    )


def item_count(items: Column, category: str) -> Column:
    """How many items of a category an array of (category, count) holds; 0 for none, null for a null array."""
    return F.aggregate(F.filter(items, lambda x: x["category"] == category), F.lit(0).cast("long"), lambda n, x: n + x["count"])


def team_summaries(members: DataFrame, frame: Names) -> DataFrame:
    """frame, then for each side (t_, ct_): alive, health (negatives as 0), kills, deaths, and over the members whose
    equipment is known: known, money, armor, helmets, defusers, value, grenades, rifles, snipers.

    members: frame, team, alive, health, kills, deaths, equipment (null: unknown) with money, armor, helmet, defuser,
    value and items. A side without members has zeros; one shuffle by frame, sums combined before it.
    """
    e = lambda f: F.col(f"equipment.{f}")
    sums = {
        "alive": F.col("alive").cast("long"), "health": F.greatest(F.col("health"), F.lit(0)), "kills": F.col("kills"), "deaths": F.col("deaths"),
        "known": F.col("equipment").isNotNull().cast("long"), "money": e("money"), "armor": e("armor"), "helmets": e("helmet").cast("long"), "defusers": e("defuser").cast("long"), "value": e("value"),
        **{f"{c}s": item_count(e("items"), c) for c in ("grenade", "rifle", "sniper")},
    }
    each = [F.coalesce(F.sum(F.when(F.col("team") == s.upper(), c)), F.lit(0)).cast("long").alias(f"{s}_{n}") for s in ("t", "ct") for n, c in sums.items()]
    return members.groupBy(*frame).agg(*each, *(F.count_if(F.col("team") == s.upper()).alias(f"{s}_members") for s in ("t", "ct")))


def baseline(summaries: DataFrame, frame: Names) -> DataFrame:
    """The differences T less CT of team_summaries, the shares of known equipment (0 without members), mean health of the
    living (0 without any), alive in all, and clutch: one is left on a side.
    """
    less = lambda n: (F.col(f"t_{n}") - F.col(f"ct_{n}")).alias(f"{n}_difference")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    known = {s: share(f"{s}_known", f"{s}_members") for s in ("t", "ct")}
    names = ("value", "money", "armor", "helmets", "defusers", "grenades", "rifles", "snipers", "health", "alive")
    return summaries.select(
        *frame, *map(less, names), (F.col("t_alive") + F.col("ct_alive")).alias("total_alive"), *(share(f"{s}_health", f"{s}_alive").alias(f"{s}_mean_health") for s in ("t", "ct")),
        ((F.col("t_alive") == 1) | (F.col("ct_alive") == 1)).alias("clutch"), *(c.alias(f"{s}_coverage") for s, c in known.items()), (known["t"] - known["ct"]).alias("coverage_difference"),
    )


def site_distances(sides: DataFrame, frame: Names, sites: dict[str, tuple[float, float]]) -> DataFrame:
    """frame, and of each side (spatial.teams) and site the mean and least distance, the closest site's, and the difference
    CT less T of the means; null where a side has no known place.
    """
    out, place = [], lambda s: F.filter(s, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    for s in ("t", "ct"):
        for name, (x, y) in sites.items():
            d = F.transform(place(s), lambda p: F.sqrt((p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y)))  # noqa: B023
            out += [F.try_divide(F.aggregate(d, F.lit(0.0), lambda a, v: a + v), F.size(d)).alias(f"{s}_mean_{name}"), F.array_min(d).alias(f"{s}_least_{name}")]
    rows = sides.select(*frame, *out)
    closest = {f"{s}_closest": _smallest([F.col(f"{s}_least_{n}") for n in sites]) for s in ("t", "ct")}
    return rows.withColumns(closest | {f"{n}_difference": F.col(f"ct_mean_{n}") - F.col(f"t_mean_{n}") for n in sites})


def _smallest(columns: list[Column]) -> Column:
    """The smallest, or null if any is."""
    out = columns[0]
    for c in columns[1:]:
        out = null_if_either(out, c, F.least(out, c))
    return out


def broad_endgame(phase: Column, t: Column, ct: Column) -> Column:
    """One to five alive on either side of a running round, seven in all at most; never null."""
    return F.coalesce(phase.isin(ROUND_PHASES) & t.between(1, 5) & ct.between(1, 5) & (t + ct <= 7), F.lit(False))


def interactions(phase: Column, t_alive: Column, ct_alive: Column, bomb_seconds: Column, ct_kits: Column) -> dict[str, Column]:
    """phase_alive: the alive difference after the plant, 0 while live, else null; bomb_kit: the bomb's time if CT has a kit,
    0 without, null if that is unknown; endgame as 0 or 1.
    """
    return {
        "phase_alive": F.when(phase == ROUND_PHASES[1], t_alive - ct_alive).when(phase == ROUND_PHASES[0], (t_alive - ct_alive) * 0).cast("double"),
        "bomb_kit": F.when(ct_kits > 0, bomb_seconds).when(ct_kits <= 0, bomb_seconds * 0),
        "endgame": broad_endgame(phase, t_alive, ct_alive).cast("double"),
    }


def presence_only(columns: Names) -> dict[str, Column]:
    """0 where a value is known and null where it isn't, so that a model sees only what is missing."""
    return {c: F.when(finite(F.col(c).cast("double")).isNotNull(), F.lit(0.0)) for c in columns}


def confirmed(states: DataFrame, events: DataFrame, keys: Names = ("match_id",)) -> DataFrame:
    """states with confirmed: whether the state at a tick bears out the key events of that tick.

    states: keys, tick, alive_ids, ct_alive_ids, bomb_state, defuser, to_defuse; events: keys, tick, seq, type, subject.
    No key event: false. No one killed may be alive, and a kill names its subject. Of other key events the last counts:
    a plant needs an armed bomb, a defuse's start its living CT subject at work with time left, its end an armed one that
    is not being defused; an outcome is never confirmed.
    """
    keys = [*keys, "tick"]
    ours = events.filter(F.col("type").isin(KEY_EVENTS))
    kill = F.col("type") == "kill"
    at = ours.groupBy(*keys).agg(
        F.collect_set(F.when(kill, F.col("subject"))).alias("__killed"), F.count_if(kill & F.col("subject").isNull()).alias("__unnamed"),
        F.max_by(F.when(~kill, F.struct("type", "subject")), F.when(~kill, F.col("seq"))).alias("__last"),
    )
    last, who = F.col("__last.type"), F.col("__last.subject")
    bomb = (
        F.when(last == "bomb-planted", F.col("bomb_state").isin(ARMED)).when(last == "bomb-defuse-abort", F.col("bomb_state") == ARMED[0])
        .when(last == "bomb-defuse-start", (F.col("bomb_state") == ARMED[1]) & (F.col("defuser") == who) & (F.col("to_defuse") > 0) & F.array_contains("ct_alive_ids", who))
        .when(last.isin(OUTCOMES), F.lit(False)).otherwise(F.lit(True))
    )
    fine = (F.col("__unnamed") == 0) & ~F.arrays_overlap("__killed", "alive_ids") & F.coalesce(bomb, F.lit(False))
    return states.join(at, keys, "left").withColumn("confirmed", F.coalesce(fine, F.lit(False))).drop("__killed", "__unnamed", "__last")


def nearest_region(members: DataFrame, points: DataFrame, keys: Names, name: str = "region") -> DataFrame:
    """points (keys, x, y) with the region of the nearest member of the keys whose region is known; else unknown.

    members: keys, x, y, region. A key's members meet in one row's array: a frame has a handful.
    """
    known = members.filter(F.col("region").isNotNull() & (F.col("region") != "unknown"))
    here = known.groupBy(*keys).agg(F.collect_list(F.struct("x", "y", "region")).alias("__m"))
    near = lambda p: F.struct(((p["x"] - F.col("x")) * (p["x"] - F.col("x")) + (p["y"] - F.col("y")) * (p["y"] - F.col("y"))).alias("d"), p["region"].alias("r"))
    found = points.join(here, list(keys), "left")
    return found.withColumn(name, F.coalesce(F.array_min(F.transform("__m", near))["r"], F.lit("unknown"))).drop("__m")


def projected(x: Column, y: Column, vx: Column, vy: Column, seconds: float, scale: float, fastest: float, farthest: float) -> Column:
    """(x, y) after a steady move; null where the speed is unknown or over `fastest`, the way over `farthest`, or the end
    outside the unit square. Speeds are in map units of `scale`.
    """
    speed = F.sqrt(vx * vx + vy * vy) * scale
    end = F.struct((x + vx * seconds).alias("x"), (y + vy * seconds).alias("y"))
    fine = (finite(speed) <= fastest) & (speed * seconds <= farthest) & (x + vx * seconds).between(0, 1) & (y + vy * seconds).between(0, 1)
    return F.when(fine, end)
