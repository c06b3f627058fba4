"""What a match's feed says: attempts at rounds, frames with clock and roster, and an audit trail; by windows.

A feed has three kinds of rows, in order of tick and seq: commands (the rules and signals at a boundary), deaths, and
frames (the members in sight). The streamed twin in tidegrid.streaming.collector gives the same rows for every prefix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators import rounds
from tidegrid.operators.sequence import keep_one

# The kinds of rows, and the ticks of a second.
COMMAND, DEATH, FRAME = "command", "death", "frame"
TICKS_A_SECOND = 64

RULES = f"""{rounds.OBSERVED.replace("tick long, seq long, ", "")}, game_time double, round_start_time double, round_time int,
paused boolean, technical boolean, waiting boolean, t_timeout boolean, ct_timeout boolean, paused_ticks int"""
#: Rules that nothing needs once the states are known.
SPENT = ("raw_round", "rounds_played", "score_t", "score_ct", "warmup", "match_started", "freeze", "team_intro", "start_count")
#: A feed besides its key. persist: false for a frame that is shown and not kept (null: kept).
FEED = f"""tick long, seq long, kind string, {RULES}, member string, bomb string, explosion double, defuse double, persist boolean,
members array<struct<member:string,team:string,alive:boolean,position:boolean,equipment:boolean>>"""
FRAMES = """tick long, round_id string, round_number int, segment int, phase string, elapsed double, remaining double, to_explosion double, to_defuse double,
clock_known boolean, source string, pause string, t long, ct long, life_known long, alive long, position_known long, equipment_known long, roster_known boolean,
quality string, reasons array<string>"""
AUDIT = "tick long, seq long, start boolean, live boolean, `end` boolean, winner string, reason string, round_id string, round_number int, segment int, phase string, pause string"


def names(ddl: str) -> list[str]:
    """The columns of a schema in one line of text."""
    return [x.split()[0].strip("`") for x in ddl.split("<")[0].replace("\n", " ").split(", ")]


@dataclass(frozen=True)
class Timeline:
    attempts: DataFrame
    frames: DataFrame
    audit: DataFrame


def collected(feed: DataFrame, key: str = "match_id") -> Timeline:
    """The timeline of each match: key with ATTEMPTS, FRAMES and AUDIT.

    A frame has the rules of the last command before it; frames before any command are left out, and of frames at one tick
    the last one stays. A round's roster begins anew with its first command; a death counts from the next command on, if
    the round did not change there and was live. A command is audited if it has a signal, or if its second or its pause is
    not that of the command before. Nothing depends on later rows but an attempt's end. The feed is shuffled by its key,
    and members meet by round; a match bounds what one task sorts.
    """
    order = Window.partitionBy(key).orderBy("tick", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # only a frame's members count; those of commands would be most of what is shuffled and sorted
    commands = feed.filter(F.col("kind") == COMMAND).withColumn("members", F.lit(None).cast(feed.schema["members"].dataType))
    states = rounds.command_states(commands, key)
    placed = _placed(states, rounds.opened(states, key), key)
    facts = F.struct(*(c for c in names(RULES) if c not in SPENT), "round_id", "round_number", "segment", "phase")
    rest = [c for c in feed.columns if c not in names(RULES)]
    other = feed.filter(F.col("kind") != COMMAND).select(*rest, F.lit(None).cast(placed.select(facts.alias("f")).schema["f"].dataType).alias("f"))
    rows = placed.select(*rest, facts.alias("f")).unionByName(other)
    own = (F.col("kind") == COMMAND).alias("own")
    rows = rows.withColumn("held", F.coalesce("f", F.last("f", True).over(before))).withColumn("n", F.row_number().over(order))
    changed = own & ~F.col("f.round_id").eqNullSafe(F.last(F.when(own, F.struct("f.round_id")), True).over(before)["round_id"])
    rows = rows.withColumn("changed", changed)
    after = F.first(F.when(own, F.struct("n", "changed", "f.round_id", "f.phase")), True).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("next", F.when(F.col("kind") == DEATH, after))

    timed = rows.filter((F.col("kind") != DEATH) & F.col("held").isNotNull()).drop("f", "changed", "next")
    armed = (F.col("kind") == FRAME) & (F.col("phase") == rounds.PLAYING[0]) & F.coalesce(F.col("bomb").isin("planted", "defusing"), F.lit(False))
    timed = timed.select(*(c for c in timed.columns if c != "held"), "held.*")
    timed = timed.withColumn("phase", F.when(armed, rounds.PLAYING[1]).otherwise(F.col("phase")))
    clocked = rounds.round_clocks(timed, key, ties=["seq"]).withColumnRenamed("known", "clock_known")

    spoken = clocked.filter(F.col("kind") == COMMAND)
    second = F.floor(F.col("tick") / TICKS_A_SECOND)
    last = F.lag(F.struct(second.alias("second"), "pause")).over(order)
    signal = F.coalesce(F.col("start"), F.lit(False)) | F.coalesce(F.col("live"), F.lit(False)) | F.coalesce(F.col("end"), F.lit(False))
    audit = spoken.withColumn("w", last.isNull() | (last["second"] != second) | (last["pause"] != F.col("pause"))).filter(signal | F.col("w")).select(key, *names(AUDIT))

    kept = clocked.filter((F.col("kind") == FRAME) & F.coalesce("persist", F.lit(True))).withColumn("rid", F.coalesce("round_id", F.lit("")))
    each = kept.select(key, "rid", F.col("n").alias("tick"), F.posexplode("members").alias("at", "m"))
    seen = each.groupBy(key, "rid", "tick", F.col("m.member").alias("member")).agg(F.max_by("m", "at").alias("m")).select(key, "rid", "tick", "m.*")
    deaths = rows.filter((F.col("kind") == DEATH) & ~F.col("next.changed") & F.col("next.phase").isin(*rounds.PLAYING) & F.col("member").isNotNull())
    deaths = deaths.select(key, F.coalesce("next.round_id", F.lit("")).alias("rid"), F.col("next.n").alias("tick"), "member")
    whole = rounds.rosters(kept.withColumn("at", F.col("tick")).withColumn("tick", F.col("n")), seen, deaths, [key, "rid"])
    whole = whole.withColumn("tick", F.col("at")).withColumnRenamed("known", "roster_known")
    frames = keep_one(whole, [key, "tick"], ["seq"], last=True).select(key, *names(FRAMES))
    return Timeline(rounds.round_attempts(commands, key), frames, audit)


def _placed(states: DataFrame, opened: DataFrame, key: str) -> DataFrame:
    """states with the round_id, round_number and segment that hold after each row."""
    so_far = Window.partitionBy(key, "number").orderBy("tick", "seq").rowsBetween(Window.unboundedPreceding, 0)
    few = opened.select(F.col(key).alias("__k"), F.col("number").alias("__n"), "back", "live.round_number", "segment")
    rows = states.join(few, F.col(key).eqNullSafe(F.col("__k")) & (F.col("number") == F.col("__n")), "left")
    rows = rows.withColumn("running", F.max("goes_live").over(so_far))
    segment = F.coalesce(F.col("segment") - (F.col("back") & ~F.col("running")).cast("int"), F.lit(0)).cast("int")
    rows = rows.withColumn("segment", segment).withColumn("round_number", F.when(F.col("running"), F.col("round_number")))
    return rows.withColumn("round_id", F.when(F.col("number") > 0, F.concat(F.lit("s"), F.col("segment"), F.lit("-a"), F.col("number") + F.col("segment"))))
