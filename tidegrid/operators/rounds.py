"""The state of a match: attempts at rounds, their clock and roster, as windows; and the attempts as a fold, for streams."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.scalar import finite

#: One row for each boundary at which the rules were seen, in order of tick and seq.
OBSERVED = """tick long, seq long, raw_round int, rounds_played int, score_t int, score_ct int, warmup boolean, match_started boolean,
freeze boolean, team_intro boolean, start_count int, start boolean, live boolean, `end` boolean, winner string, reason string"""
ATTEMPTS = """round_id string, segment int, round_number int, start_tick long, live_tick long, end_tick long, score_t int, score_ct int,
disposition string, winner string, reason string"""


# Results and inputs carry these strings.
OPEN, VOID, COMPLETED, UNCONFIRMED, MISSING = "open", "void", "completed", "result-unconfirmed", "result-missing"
REPLACED, ROLLED_BACK, RESET, ENDED = "replaced-before-result", "score-rollback", "rules-score-reset", "end-of-demo"
PLAYING = ("live", "post-plant")
CLOCK_SOURCES = ("game-time-minus-rule-start", "unsupported-pause", "not-applicable-or-unknown")
PAUSES = ("unverified-hard-pause-or-resume", "tactical-timeout-flag", "none")
ROSTER_REASONS = ("roster-unconfirmed", "life-unknown", "alive-position-unknown", "alive-equipment-unknown")
NO_MEMBER = "0"


@dataclass
class Attempt:
    round_id: str
    segment: int
    start_tick: int
    round_number: int | None = None
    live_tick: int | None = None
    end_tick: int | None = None
    score_t: int | None = None
    score_ct: int | None = None
    disposition: str = OPEN
    winner: str | None = None
    reason: str | None = None


@dataclass
class Match:
    """What is known of a match so far. step() takes one boundary and returns the attempts that it changed."""

    attempts: list[Attempt] = field(default_factory=list)
    segment: int = 0
    start_count: int | None = None
    highest: int = 0
    phase: str = "unknown"
    serial: int = 0

    @property
    def current(self) -> Attempt | None:
        return self.attempts[-1] if self.attempts else None

    def _open(self, tick: int) -> Attempt:
        self.serial += 1
        self.attempts.append(Attempt(f"s{self.segment}-a{self.serial}", self.segment, tick))
        return self.attempts[-1]

    def step(self, o: dict) -> list[Attempt]:
        touched: dict[str, Attempt] = {}

        def close(a: Attempt, disposition: str, reason: str | None) -> None:
            a.end_tick, a.disposition, a.reason = o["tick"], disposition, reason
            touched[a.round_id] = a

        running = lambda: self.current is not None and self.current.end_tick is None
        # an end belongs to the attempt before a start at the same boundary
        if o["end"] and running():
            a = self.current
            a.winner = o["winner"]
            close(a, self._verdict(a, o), o["reason"])
        if o["start"] and (self.current is None or o["start_count"] != self.start_count):
            if running():
                close(self.current, VOID, REPLACED)
            a = self._open(o["tick"])
            touched[a.round_id] = a
            self.start_count = o["start_count"]
        if o["live"] and o["match_started"] and not (o["warmup"] or o["team_intro"] or o["freeze"]):
            if not running():
                self._open(o["tick"])
            if self.current.live_tick is None:
                self._go_live(o, touched, close)
                touched[self.current.round_id] = self.current
        self.phase = self._phase(o)
        return list(touched.values())

    @staticmethod
    def _verdict(a: Attempt, o: dict) -> str:
        if o["winner"] not in ("T", "CT"):
            return VOID
        if a.live_tick is None or a.round_number is None or a.live_tick >= o["tick"] or o["warmup"]:
            return UNCONFIRMED
        expected = (a.round_number, a.score_t + (o["winner"] == "T"), a.score_ct + (o["winner"] == "CT"))
        return COMPLETED if expected == (o["rounds_played"], o["score_t"], o["score_ct"]) else UNCONFIRMED

    def _go_live(self, o: dict, touched: dict, close) -> None:
        played = o["rounds_played"]
        number = None
        if o["raw_round"] >= 0 and o["raw_round"] == played == o["score_t"] + o["score_ct"]:
            number = o["raw_round"] + 1
            done = [a for a in self.attempts if a.segment == self.segment and a.disposition == COMPLETED]
            if number < self.highest or any(a.round_number == number for a in done):
                # the score went back: results from there on no longer stand, and a new segment begins
                for a in done:
                    if a.round_number >= number:
                        a.disposition, a.reason = VOID, f"{ROLLED_BACK}:{a.reason or ''}"
                        touched[a.round_id] = a
                close(self.current, VOID, RESET)
                self.segment += 1
                self._open(o["tick"])
                self.highest = 0
            self.highest = max(self.highest, number)
        a = self.current
        a.round_number, a.live_tick, a.score_t, a.score_ct = number, o["tick"], o["score_t"], o["score_ct"]

    def _phase(self, o: dict) -> str:
        if o["warmup"]:
            return "warmup"
        if o["team_intro"]:
            return "team-intro"
        if not o["match_started"]:
            return "unknown"
        if self.current is not None and self.current.end_tick is not None:
            return "ended"
        return "freeze" if o["freeze"] or self.current is None or self.current.live_tick is None else "live"

    def finish(self) -> None:
        if self.current is not None and self.current.end_tick is None:
            self.current.disposition, self.current.reason = MISSING, ENDED


def clean(row: dict) -> dict:
    return {k: None if v is None or (isinstance(v, float) and math.isnan(v)) else v for k, v in row.items()}


def fold_match(rows: Iterable[dict]) -> Match:
    match = Match()
    for row in rows:
        match.step(clean(row))
    match.finish()
    return match


def command_states(observed: DataFrame, key: str = "match_id") -> DataFrame:
    """observed (OBSERVED) with what its attempt's state is after each row: number (of attempts opened so far), state (0: none
    or ended, 1: begun, 2: live), closes, opens, goes_live, expected and phase.

    A state depends on the last row with a signal alone, so a window says it. One shuffle by key. Null flags are false.
    """
    order = Window.partitionBy(key).orderBy("tick", "seq")
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    last_start = F.last(F.when(flag("start"), F.struct("start_count")), True).over(before)
    rows = observed.withColumn("__s", flag("start") & (last_start.isNull() | ~last_start["start_count"].eqNullSafe(F.col("start_count"))))
    rows = rows.withColumn("__l", flag("live") & flag("match_started") & ~(flag("warmup") | flag("team_intro") | flag("freeze")))
    after = F.when(F.col("__l"), 2).when(F.col("__s"), 1).when(flag("end"), 0)
    rows = rows.withColumn("__after", after).withColumn("__was", F.coalesce(F.last("__after", True).over(before), F.lit(0)))
    rows = rows.withColumn("__mid", F.when(F.col("__s"), 1).when(flag("end"), 0).otherwise(F.col("__was")))
    opens = F.col("__s") | (F.col("__l") & (F.col("__mid") == 0))
    played = F.col("rounds_played")
    agreed = (F.col("raw_round") >= 0) & (F.col("raw_round") == played) & (played == F.col("score_t") + F.col("score_ct"))
    rows = rows.withColumns({
        "closes": flag("end") & (F.col("__was") > 0), "opens": opens, "goes_live": F.col("__l") & (F.col("__mid") < 2),
        "state": F.coalesce(F.col("__after"), F.col("__was")), "expected": F.when(agreed, F.col("raw_round") + 1).cast("int"),
    })
    rows = rows.withColumn("number", F.sum(F.col("opens").cast("int")).over(so_far))
    phase = (
        F.when(flag("warmup"), "warmup").when(flag("team_intro"), "team-intro").when(~flag("match_started"), "unknown").when((F.col("number") > 0) & (F.col("state") == 0), "ended")
        .when(flag("freeze") | (F.col("state") < 2), "freeze").otherwise("live")
    )
    return rows.withColumn("phase", phase).drop("__s", "__l", "__after", "__was", "__mid")


def opened(states: DataFrame, key: str) -> DataFrame:
    """One row for each attempt opened (key, number): its start, its going live, its end, and what they say together.

    A score that goes back is seen from the attempts in order: the number at going live is below the last known one, or
    equal to it although that attempt was completed. (Numbers never fall within a segment, so the last one is the highest.)
    """
    played, won = F.col("rounds_played"), F.col("winner")
    part = lambda n, **c: F.struct(F.col("number").alias("n") if n == 0 else (F.col("number") + n).alias("n"), *(v.alias(k) for k, v in c.items()))
    none = F.lit(None)
    live = F.struct("tick", F.col("expected").alias("round_number"), "score_t", "score_ct")
    ended = F.struct("tick", won.alias("winner"), "reason", F.coalesce("warmup", F.lit(False)).alias("warmup"), played.alias("played"), "score_t", "score_ct")
    signal = states.filter("opens OR goes_live OR closes")
    own = F.when(F.col("opens") | F.col("goes_live"), part(0, start=F.when(F.col("opens"), F.col("tick")), live=F.when(F.col("goes_live"), live), ended=F.when(none.cast("boolean"), ended)))
    # an end belongs to the attempt before a start at the same row
    other = F.when(F.col("closes"), F.struct((F.col("number") - F.col("opens").cast("int")).alias("n"), none.cast("long").alias("start"), F.when(none.cast("boolean"), live).alias("live"), ended.alias("ended")))
    each = signal.select(key, F.explode(F.array_compact(F.array(own, other))).alias("p")).select(key, "p.*")
    once = lambda c: F.max(c).alias(c)
    rows = each.groupBy(key, F.col("n").alias("number")).agg(F.min("start").alias("start"), once("live"), once("ended"))
    order = Window.partitionBy(key).orderBy("number")
    rows = rows.withColumn("replaced", F.lead("start").over(order))
    whole = F.struct(F.col("live.round_number") + 0, F.col("live.score_t") + (F.col("ended.winner") == "T").cast("int"), F.col("live.score_ct") + (F.col("ended.winner") == "CT").cast("int"))
    known = F.coalesce(F.col("live.round_number").isNotNull() & (F.col("live.tick") < F.col("ended.tick")) & ~F.col("ended.warmup"), F.lit(False))
    verdict = (
        F.when(F.col("ended").isNull(), F.when(F.col("replaced").isNotNull(), VOID).otherwise(MISSING)).when(~F.coalesce(F.col("ended.winner").isin("T", "CT"), F.lit(False)), VOID)
        .when(known & whole.eqNullSafe(F.struct("ended.played", "ended.score_t", "ended.score_ct")), COMPLETED).otherwise(UNCONFIRMED)
    )
    rows = rows.withColumn("disposition", verdict)
    numbered = F.when(F.col("live.round_number").isNotNull(), F.struct("live.round_number", "disposition"))
    last = F.last(numbered, True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    back = (F.col("live.round_number") < last["round_number"]) | ((F.col("live.round_number") == last["round_number"]) & (last["disposition"] == COMPLETED))
    rows = rows.withColumn("back", F.coalesce(back, F.lit(False)))
    rows = rows.withColumn("segment", F.sum(F.col("back").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # what the next segment begins with voids the completed attempts from there on
    again = F.first(F.when(F.col("back"), F.col("live.round_number")), True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("voided", (F.col("disposition") == COMPLETED) & F.coalesce(F.col("live.round_number") >= again, F.lit(False)))


def round_attempts(observed: DataFrame, key: str = "match_id") -> DataFrame:
    """key and ATTEMPTS for each match, by windows: one shuffle, and then a few rows for each attempt.

    An attempt at whose going live the score went back is two: what was begun is void, and a new segment begins live. A
    match without rows gives none. A match is what one task sorts.
    """
    rows = opened(command_states(observed, key), key)
    empty = lambda t: F.lit(None).cast(t)
    head = lambda segment, serial, start: (F.concat(F.lit("s"), segment, F.lit("-a"), serial).alias("round_id"), segment.alias("segment"))
    segment, serial = F.col("segment").cast("int"), F.col("number") + F.col("segment")
    reason = F.when(F.col("voided"), F.concat(F.lit(f"{ROLLED_BACK}:"), F.coalesce("ended.reason", F.lit("")))).when(F.col("ended").isNotNull(), F.col("ended.reason"))
    reason = reason.when(F.col("replaced").isNotNull(), REPLACED).otherwise(ENDED)
    stands = F.struct(
        *head(segment, serial, None), F.col("live.round_number").alias("round_number"), F.when(F.col("back"), F.col("live.tick")).otherwise(F.col("start")).alias("start_tick"), F.col("live.tick").alias("live_tick"),
        F.coalesce("ended.tick", "replaced").alias("end_tick"), F.col("live.score_t").alias("score_t"), F.col("live.score_ct").alias("score_ct"),
        F.when(F.col("voided"), VOID).otherwise(F.col("disposition")).alias("disposition"), F.col("ended.winner").alias("winner"), reason.alias("reason"),
    )
    reset = F.struct(
        *head(segment - 1, serial - 1, None), empty("int").alias("round_number"), F.col("start").alias("start_tick"), empty("long").alias("live_tick"), F.col("live.tick").alias("end_tick"),
        empty("int").alias("score_t"), empty("int").alias("score_ct"), F.lit(VOID).alias("disposition"), empty("string").alias("winner"), F.lit(RESET).alias("reason"),
    )
    return rows.select(key, F.explode(F.when(F.col("back"), F.array(reset, stands)).otherwise(F.array(stands))).alias("a")).select(key, "a.*")


def round_clocks(observed: DataFrame, key: str = "match_id", fresh: float = 0.125, ties: Sequence[str] = ()) -> DataFrame:
    """observed with the time into the round: elapsed, remaining, to_explosion, to_defuse, known, source, pause.

    observed: key, tick, round_id, phase, game_time, round_start_time, round_time, paused, technical, waiting, t_timeout,
    ct_timeout, paused_ticks, explosion, defuse. A hard pause (paused, technical, or waiting outside a tactical timeout),
    or a number of paused ticks other than the round's first, makes the time unknown for the rest of the round. If the
    round's first live row is fresh, with no hard pause and at most `fresh` seconds after the rule's start, what came
    before it no longer counts, and its own number of paused ticks is the one to compare with. A round is a run of rows
    with one round_id; rows before the first one have no first number to compare with. One shuffle by key; a match bounds
    what one task sorts.
    """
    order = Window.partitionBy(key).orderBy("tick", *ties)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    tactical = flag("t_timeout") | flag("ct_timeout")
    hard = flag("paused") | flag("technical") | (flag("waiting") & ~tactical)
    elapsed = F.col("game_time") - F.col("round_start_time")
    timed = finite(elapsed) >= 0
    changed = (~F.col("round_id").eqNullSafe(F.lag("round_id").over(order))) | (F.row_number().over(order) == 1)
    rows = observed.withColumn("__run", F.sum(changed.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(order))
    run = Window.partitionBy(key, "__run")
    playing = F.coalesce(F.col("phase").isin(*PLAYING), F.lit(False))
    rows = rows.withColumn("__play", F.min(F.when(playing, F.col("__n"))).over(run))
    entry = F.max(F.when(F.col("__n") == F.col("__play"), F.struct((~hard & F.coalesce(timed & (elapsed <= fresh), F.lit(False))).alias("fresh"), "paused_ticks")))
    rows = rows.withColumn("__entry", entry.over(run)).withColumn("__restarted", F.coalesce(F.col("__entry.fresh") & (F.col("__n") >= F.col("__play")), F.lit(False)))
    first = F.first(F.struct("paused_ticks")).over(run.orderBy("__n").rowsBetween(Window.unboundedPreceding, 0))["paused_ticks"]
    begun = (F.col("__run") > 1) | F.col("round_id").isNotNull()  # before any round no number of paused ticks is held
    base = F.when(F.col("__restarted"), F.col("__entry.paused_ticks")).when(begun, first)
    spoils = (hard | (base.isNotNull() & ~F.col("paused_ticks").eqNullSafe(base))) & ~(F.col("__restarted") & (F.col("__n") == F.col("__play")))
    so_far = Window.partitionBy(key, "__run", "__restarted").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__spoils", spoils).withColumn("__unknown", F.max("__spoils").over(so_far))
    known = F.col("round_id").isNotNull() & playing & ~F.col("__unknown") & F.coalesce(timed & (F.col("round_time") > 0), F.lit(False))
    planted = F.col("known") & (F.col("phase") == PLAYING[1])
    tail = lambda c: F.when(planted & (finite(F.col(c)) >= 0), F.col(c))
    rows = rows.withColumn("known", known)
    out = rows.withColumns({
        "elapsed": F.when(F.col("known"), elapsed), "remaining": F.when(F.col("known") & ~planted, F.greatest(F.lit(0.0), F.col("round_time") - elapsed)),
        "to_explosion": tail("explosion"), "to_defuse": tail("defuse"),
        "source": F.when(F.col("known"), CLOCK_SOURCES[0]).when(F.col("__unknown"), CLOCK_SOURCES[1]).otherwise(CLOCK_SOURCES[2]),
        "pause": F.when(F.col("__unknown"), PAUSES[0]).when(tactical, PAUSES[1]).otherwise(PAUSES[2]),
    })
    return out.select(*observed.columns, "elapsed", "remaining", "to_explosion", "to_defuse", "known", "source", "pause")


def rosters(frames: DataFrame, seen: DataFrame, deaths: DataFrame, keys: Sequence[str] = ("match_id", "round_id"), side: int = 5) -> DataFrame:
    """frames (keys, tick) with t, ct, life_known, alive, position_known, equipment_known, known, quality, reasons.

    seen: keys, tick, member, team, alive (null: unknown), position, equipment; one row for each member in sight at a
    frame. deaths: keys, tick, member; those of a live round. A member belongs to its round from the first sight on. Dead
    is who has died by then, or was last known to be dead; else a member in sight is what its row says, and one out of
    sight is unknown, without place and equipment. Rows of other teams take no part. Frames before any sight have zeros.
    Members and frames of a round meet by a join on the round: some ten rows for each frame.
    """
    keys = list(keys)
    ours = seen.filter(F.col("team").isin("T", "CT"))
    member = Window.partitionBy(*keys, "member").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    first = ours.groupBy(*keys, "member").agg(F.min("tick").alias("__first"))
    died = deaths.groupBy(*keys, "member").agg(F.min("tick").alias("__died"))
    grid = frames.select(*keys, "tick").distinct().join(first, keys).filter(F.col("tick") >= F.col("__first")).join(died, [*keys, "member"], "left")
    rows = grid.join(ours.withColumn("__seen", F.lit(True)), [*keys, "tick", "member"], "left")
    rows = rows.withColumn("team", F.last("team", True).over(member)).withColumn("__last", F.last("alive", True).over(member))
    dead = F.coalesce(F.col("tick") >= F.col("__died"), F.lit(False)) | F.coalesce(F.col("alive").isNull() & ~F.col("__last"), F.lit(False))
    rows = rows.withColumn("alive", F.when(dead, F.lit(False)).otherwise(F.col("alive")))
    there = lambda c: F.count_if(F.coalesce(F.col("alive") & F.col(c), F.lit(False)))
    count = rows.groupBy(*keys, "tick").agg(
        F.count_if(F.col("team") == "T").alias("t"), F.count_if(F.col("team") == "CT").alias("ct"), F.count("alive").alias("life_known"),
        F.count_if(F.coalesce("alive", F.lit(False))).alias("alive"), there("position").alias("position_known"), there("equipment").alias("equipment_known"),
        F.count_if(F.col("member") == NO_MEMBER).alias("__nobody"),
    )
    numbers = ["t", "ct", "life_known", "alive", "position_known", "equipment_known", "__nobody"]
    out = frames.join(count, [*keys, "tick"], "left").fillna(0, numbers)
    whole = (F.col("t") == side) & (F.col("ct") == side) & (F.col("__nobody") == 0)
    unknown = F.col("life_known") != F.col("t") + F.col("ct")
    bad = (~whole, unknown, F.col("position_known") != F.col("alive"), F.col("equipment_known") != F.col("alive"))
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in zip(bad, ROSTER_REASONS, strict=True))))
    quality = F.when(~whole | unknown, "unusable").when(F.size("reasons") > 0, "partial").otherwise("usable")
    return out.withColumn("known", whole).withColumn("reasons", reasons).withColumn("quality", quality).drop("__nobody")


def changed_attempts(match: Match, rows: Iterable[dict]) -> Iterator[dict]:
    """The last state of each attempt that the rows changed: what an update to a keyed table needs, voided ones too."""
    touched: dict[str, Attempt] = {}
    for row in rows:
        touched |= {a.round_id: a for a in match.step(clean(row))}
    yield from map(asdict, touched.values())
