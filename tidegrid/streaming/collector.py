"""The timeline of tidegrid.operators.semantics on a stream: kept state for each match, and timers that end idle ones."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from tidegrid.operators import rounds, semantics
from tidegrid.operators.rounds import ATTEMPTS, Attempt, Match
from tidegrid.operators.semantics import AUDIT, COMMAND, DEATH, FRAMES, TICKS_A_SECOND, names

_KINDS = [x.strip() for ddl in (ATTEMPTS, AUDIT, FRAMES) for x in ddl.replace("\n", " ").split(", ")]
#: what: attempt, frame or audit; then the columns of all three.
RESULT = "what string, " + ", ".join({x.split()[0].strip("`"): x for x in _KINDS}.values())
_RESULT = ["what", *{x.split()[0].strip("`"): x for x in _KINDS}]
_NONE = dict.fromkeys(_RESULT)
_WHOLE = [x.split()[0] for x in semantics.FEED.replace("\n", " ").split(", ") if x.split()[1] in ("int", "long")]


@dataclass
class Now:
    """What of a match is kept besides its attempts and members: the rules, and where clock, roster and audit stand."""

    segment: int = 0
    serial: int = 0
    highest: int = 0
    start_count: int | None = None
    phase: str = "unknown"
    rules: dict | None = None
    clock_round: str | None = None
    spoiled: bool = False
    base: int | None = None
    entered: bool = False
    roster_round: str | None = None
    second: int | None = None
    pause: str | None = None
    waiting: list[str] = field(default_factory=list)  # deaths until the next command


@dataclass
class Member:
    team: str
    alive: bool | None
    position: bool
    equipment: bool


class Collector:
    """One match. step() takes a row of the feed and gives the rows it changes."""

    def __init__(self, now: Now, attempts: list[Attempt], members: dict[str, Member], dead: set[str]) -> None:
        self.now, self.members, self.dead = now, members, dead
        self.match = Match(attempts, now.segment, now.start_count, now.highest, now.phase, now.serial)

    def step(self, row: dict) -> Iterator[dict]:
        if row["kind"] == COMMAND:
            yield from self._command(row)
        elif row["kind"] == DEATH:
            if row["member"] is not None:
                self.now.waiting.append(row["member"])
        elif self.now.rules is not None:
            yield from self._frame(row)

    def _place(self) -> dict:
        a = self.match.current
        return {"round_id": a and a.round_id, "round_number": a and a.round_number, "segment": a.segment if a else 0}

    def _command(self, row: dict) -> Iterator[dict]:
        now, match = self.now, self.match
        now.rules = {c: row[c] for c in names(semantics.RULES)}
        for a in match.step(row):
            yield _NONE | {"what": "attempt"} | asdict(a)
        match.attempts = [a for a in match.attempts if a.segment == match.segment]  # those of earlier segments can't change
        now.segment, now.start_count, now.highest, now.phase, now.serial = match.segment, match.start_count, match.highest, match.phase, match.serial
        place = self._place()
        if place["round_id"] != now.roster_round:
            now.roster_round = place["round_id"]
            self.members.clear()
            self.dead.clear()
        elif match.phase in rounds.PLAYING:
            self.dead |= set(now.waiting)
        now.waiting = []
        clock = self._clock(place["round_id"], match.phase, None, None)
        second = row["tick"] // TICKS_A_SECOND
        if row["start"] or row["live"] or row["end"] or second != now.second or clock["pause"] != now.pause:
            yield _NONE | {"what": "audit", "phase": match.phase, "pause": clock["pause"]} | place | {c: row[c] for c in ("tick", "seq", "start", "live", "end", "winner", "reason")}
        now.second, now.pause = second, clock["pause"]

    def _frame(self, row: dict) -> Iterator[dict]:
        armed = self.match.phase == rounds.PLAYING[0] and row["bomb"] in ("planted", "defusing")
        phase = rounds.PLAYING[1] if armed else self.match.phase
        place = self._place()
        clock = self._clock(place["round_id"], phase, row["explosion"], row["defuse"])
        if row["persist"] is not False:
            roster = self._roster({m["member"]: m for m in (row["members"] if row["members"] is not None else []) if m["team"] in ("T", "CT")})
            yield _NONE | {"what": "frame", "tick": row["tick"], "phase": phase} | place | clock | roster

    def _clock(self, round_id: str | None, phase: str, explosion: float | None, defuse: float | None) -> dict:
        r, now = self.now.rules, self.now
        if round_id != now.clock_round:
            now.clock_round, now.spoiled, now.entered, now.base = round_id, False, False, r["paused_ticks"]
        tactical = bool(r["t_timeout"] or r["ct_timeout"])
        hard = bool(r["paused"] or r["technical"] or (r["waiting"] and not tactical))
        playing = phase in rounds.PLAYING
        elapsed = None if r["game_time"] is None or r["round_start_time"] is None else r["game_time"] - r["round_start_time"]
        timed = elapsed is not None and math.isfinite(elapsed) and elapsed >= 0
        if playing and not now.entered and not hard and timed and elapsed <= 0.125:
            now.spoiled, now.base = False, r["paused_ticks"]  # a fresh origin: what came before does not count
        else:
            now.spoiled |= hard or (now.base is not None and r["paused_ticks"] != now.base)
        now.entered |= playing
        known = round_id is not None and playing and not now.spoiled and timed and (r["round_time"] or 0) > 0
        tail = lambda v: v if known and phase == rounds.PLAYING[1] and v is not None and math.isfinite(v) and v >= 0 else None
        return {
            "elapsed": elapsed if known else None, "remaining": max(0.0, r["round_time"] - elapsed) if known and phase == rounds.PLAYING[0] else None, "to_explosion": tail(explosion), "to_defuse": tail(defuse),
            "clock_known": known, "source": rounds.CLOCK_SOURCES[0 if known else 1 if now.spoiled else 2], "pause": rounds.PAUSES[0 if now.spoiled else 1 if tactical else 2],
        }

    def _roster(self, seen: dict[str, dict]) -> dict:
        for name in self.members.keys() - seen.keys():
            m = self.members[name]
            self.members[name] = Member(m.team, False if name in self.dead or m.alive is False else None, False, False)
        for name, s in seen.items():
            was = self.members.get(name)
            alive = False if name in self.dead or (s["alive"] is None and was and was.alive is False) else s["alive"]
            self.members[name] = Member(s["team"], alive, bool(s["position"]), bool(s["equipment"]))
        all_, there = list(self.members.values()), [m for m in self.members.values() if m.alive]
        count = {
            "t": sum(m.team == "T" for m in all_), "ct": sum(m.team == "CT" for m in all_), "life_known": sum(m.alive is not None for m in all_), "alive": len(there),
            "position_known": sum(m.position for m in there), "equipment_known": sum(m.equipment for m in there),
        }
        whole = count["t"] == count["ct"] == 5 and rounds.NO_MEMBER not in self.members
        bad = (not whole, count["life_known"] != len(all_), count["position_known"] != len(there), count["equipment_known"] != len(there))
        reasons = [r for r, b in zip(rounds.ROSTER_REASONS, bad, strict=True) if b]
        return count | {"roster_known": whole, "reasons": reasons, "quality": "unusable" if bad[0] or bad[1] else "partial" if reasons else "usable"}

    def finished(self) -> Iterator[dict]:
        self.match.finish()
        if self.match.current is not None and self.match.current.disposition == rounds.MISSING:
            yield _NONE | {"what": "attempt"} | asdict(self.match.current)


class _Processor(StatefulProcessor):
    """State of a match: one value (Now), a map of the segment's attempts, a map of members, a map of the dead; an idle match ends."""

    def __init__(self, key: str, at: str, idle_ms: int) -> None:
        self.key, self.at, self.idle_ms = key, at, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "now string")
        self.attempts = handle.getMapState("attempts", "round_id string", ATTEMPTS.replace("round_id string, ", ""))
        self.members = handle.getMapState("members", "member string", "team string, alive boolean, position boolean, equipment boolean")
        self.dead = handle.getMapState("dead", "member string", "dead boolean")

    def _load(self) -> Collector:
        # state comes through pandas, where whole numbers beside nulls are floats
        plain = lambda v: tuple((None if math.isnan(x) else int(x)) if isinstance(x, float) else x for x in v)
        attempts = [Attempt(k[0], *_reordered(plain(v))) for k, v in self.attempts.iterator()]
        attempts.sort(key=lambda a: int(a.round_id.rpartition("a")[2]))
        now = Now(**json.loads(self.now.get()[0])) if self.now.exists() else Now()
        members = {k[0]: Member(*plain(v)) for k, v in self.members.iterator()}
        return Collector(now, attempts, members, {k[0] for k in self.dead.keys()})

    def _save(self, c: Collector, was: tuple[dict, dict, set]) -> None:
        """Only what changed is written."""
        attempts, members, dead = was
        self.now.update((json.dumps(asdict(c.now)),))
        new = {a.round_id: tuple(asdict(a)[n] for n in names(ATTEMPTS)[1:]) for a in c.match.attempts}
        for state, old, fresh in ((self.attempts, attempts, new), (self.members, members, {k: tuple(asdict(m).values()) for k, m in c.members.items()}), (self.dead, dict.fromkeys(dead, (True,)), dict.fromkeys(c.dead, (True,)))):
            for k in old.keys() - fresh.keys():
                state.removeKey((k,))
            for k, v in fresh.items():
                if old.get(k) != v:
                    state.updateValue((k,), v)

    def _out(self, key, rows: list[dict]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([{self.key: key[0]} | r for r in rows], columns=[self.key, *_RESULT], dtype=object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        c = self._load()
        was = ({a.round_id: tuple(asdict(a)[n] for n in names(ATTEMPTS)[1:]) for a in c.match.attempts}, {k: tuple(asdict(m).values()) for k, m in c.members.items()}, set(c.dead))
        frame = pd.concat(rows).sort_values(["tick", "seq"], kind="stable")
        latest = int(frame[self.at].max().timestamp() * 1000)
        made = [x for row in frame.to_dict("records") for x in c.step(_whole(rounds.clean(row)))]
        self._save(c, was)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        self.handle.registerTimer(latest + self.idle_ms)
        yield from self._out(key, made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        made = list(self._load().finished())
        for state in (self.now, self.attempts, self.members, self.dead):
            state.clear()
        yield from self._out(key, made)

    def close(self) -> None:
        pass


def _whole(row: dict) -> dict:
    """Whole numbers beside nulls come as floats."""
    return row | {c: int(row[c]) for c in _WHOLE if row[c] is not None}


def _reordered(values: tuple) -> tuple:
    """From the order of ATTEMPTS to that of Attempt's fields."""
    by = dict(zip(names(ATTEMPTS)[1:], values, strict=True))
    return tuple(by[f] for f in list(Attempt.__dataclass_fields__)[1:])


def stream_timeline(feed: DataFrame, key: str = "match_id", at: str = "at", lateness: str = "10 seconds", idle_seconds: int = 3600) -> DataFrame:
    """key and RESULT: upserts of attempts (by round_id), frames (by tick) and audit rows (by tick and seq), for update mode.

    feed: semantics.FEED with key and at, a timestamp. Rows of a match come in order of tick and seq from one micro-batch
    to the next; within one they are sorted here. Each prefix of a feed gives what semantics.collected gives for it, but
    for the attempt that still runs. A match without rows for idle_seconds of event time ends, and its state goes. State
    holds the attempts of a match's current segment, the members of its current round and its dead, and nothing that grows
    with its frames. Needs the RocksDB state store.
    """
    kind = feed.schema[key].dataType.simpleString()
    rows = feed.withWatermark(at, lateness).groupBy(key)
    return rows.transformWithStateInPandas(_Processor(key, at, idle_seconds * 1000), f"`{key}` {kind}, {RESULT}", "update", "EventTime")
