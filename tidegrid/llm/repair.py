"""Conversation structure repair: the cheapest edits that give an optional system turn and then pairs of user and assistant.

What came so far is in one of four states: nothing, system, user, assistant. A turn is a 4x4 matrix: how to pass from
state to state while it is kept, given another role or deleted, and turns are inserted after it. Its elements are (cost,
audit), where the audit is the edits' initials; min takes the lower cost and then the lesser audit, plus adds costs and
joins audits. Matrices of stretches of a conversation multiply associatively, so a long one is reduced as a tree, across
partitions too. (Of two audits of one cost and the same turns none begins with the other: what is longer by insertions
costs more. So the lesser one stays the lesser whatever follows both.)
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import partitions, read, written

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: State -> the state after a user or assistant turn, whichever may come.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {USER: "user", ASSISTANT: "assistant"}
GAPS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
#: Turns whose matrix is looked up whole.
CHUNK = 8

Element = tuple[int, str] | None
Matrix = tuple[tuple[Element, ...], ...]


def product(a: Matrix, b: Matrix) -> Matrix:
    def element(i: int, j: int) -> Element:
        ways = [(x[0] + y[0], x[1], y[1]) for x, row in zip(a[i], b, strict=True) if x and (y := row[j])]
        if not ways:
            return None
        cost = min(w[0] for w in ways)
        return cost, min(x + y for c, x, y in ways if c == cost)

    return tuple(tuple(element(i, j) for j in range(4)) for i in range(4))


def _matrix(steps: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return tuple(tuple(steps.get((i, j)) for j in range(4)) for i in range(4))


def _closure() -> Matrix:
    """Insertions, as many as are worth it: after two more a state comes again."""
    none = {(i, i): (0, "") for i in range(4)}
    one = _matrix(none | {(i, j): (INSERT, "I") for i, j in NEXT.items()})
    return product(one, one)


CLOSURE = _closure()


@lru_cache(1 << 16)
def _chunk(kinds: str) -> Matrix:
    """The matrix of a few turns, each with the insertions after it. kinds: s, u, a or o (other) by the role's initial, in
    upper case if truncated; d for what must go.
    """
    out = None
    for kind in kinds:
        steps = {(i, i): (DELETE, "D") for i in range(4)}
        more = TRUNCATED if kind.isupper() else 0
        if kind != "d":
            steps |= {(i, j): (REROLE + more, "R") for i, j in NEXT.items()}
        low = kind.lower()
        if low == "s":
            steps[NOTHING, SYSTEM] = (more, "K")
        for i, j in NEXT.items():
            if low == "ua"[j == ASSISTANT]:
                steps[i, j] = (more, "K")
        own = product(_matrix(steps), CLOSURE)
        out = own if out is None else product(out, own)
    return out


def matrix_of(kinds: str) -> Matrix:
    """The product over all turns, as a tree; of no turns it lets each state as it is."""
    if len(kinds) <= CHUNK:
        return _chunk(kinds) if kinds else _matrix({(i, i): (0, "") for i in range(4)})
    half = (len(kinds) // CHUNK + 1) // 2 * CHUNK
    return product(matrix_of(kinds[:half]), matrix_of(kinds[half:]))


def cheapest(matrix: Matrix) -> tuple[int, str]:
    """Cost and audit of a whole conversation: it begins with nothing and ends with nothing or an assistant turn."""
    whole = product(CLOSURE, matrix)
    return min(x for x in (whole[NOTHING][NOTHING], whole[NOTHING][ASSISTANT]) if x)


@dataclass
class Stretch:
    """Neighbouring turns of one conversation: their matrix, faults, and what its neighbours need of its ends."""

    matrix: Matrix
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    turns: int  # distinct ones that are not null
    first: str  # initials
    last: str
    low: int | None
    high: int | None

    def __add__(self, other: Stretch) -> Stretch:
        known = [x for x in (self.low, other.low) if x is not None]
        return Stretch(
            product(self.matrix, other.matrix), self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated,
            self.illegal + other.illegal + (self.last + other.first not in LEGAL),
            self.turns + other.turns - (self.high is not None and self.high == other.low), self.first, other.last,
            min(known, default=None), other.high if other.high is not None else self.high,
        )

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


LEGAL = ("su", "ua", "au")


def reduced(stretches: list[Stretch]) -> Stretch:
    """Their sum, in order, as a tree."""
    while len(stretches) > 1:
        stretches = [stretches[k] + stretches[k + 1] if k + 1 < len(stretches) else stretches[k] for k in range(0, len(stretches), 2)]
    return stretches[0]


def _runs(column) -> list[tuple[int, int]]:
    """(begin, end) of the runs of equal values of an Arrow column; nulls are equal."""
    n = len(column)
    a, b = column.slice(0, n - 1), column.slice(1)
    differ = pc.or_kleene(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False) if n > 1 else np.zeros(0, bool)
    cuts = [0, *(np.flatnonzero(differ) + 1).tolist(), n]
    return list(zip(cuts, cuts[1:], strict=False)) if n else []


def _fields(rows: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    known = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), known(role).alias("role"), known(text).alias("text"),
        (F.col(copies).cast("long") if copies else F.lit(1).cast("long")).alias("copies"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))


def _kinds(rows: DataFrame) -> DataFrame:
    """conv, turn, role, digest, initial, blank, and kinds: a letter for each copy of a turn, as matrices know them."""
    initial = F.substring("role", 1, 1)
    end = F.right(F.rtrim(F.col("text"), F.lit(GAPS)), F.lit(1))
    light = rows.filter("copies > 0").groupBy(
        "conv", "turn", "role", "digest", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        (F.btrim(F.col("text"), F.lit(GAPS)) == "").alias("blank"), (~end.isin(*ENDS)).alias("cut"),
    ).agg(F.sum("copies").alias("copies"))
    light = written(light, "turns")
    # a text met again: where it was first; few keys have that, and Spark splits a hot one when it joins
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = light.filter(~F.col("blank")).groupBy("conv", "role", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = written(again.select(F.col("conv").alias("__conv"), F.col("role").alias("__role"), F.col("digest").alias("__digest"), "first"), "turns-again")
    same = F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("role") == F.col("__role")) & (F.col("digest") == F.col("__digest"))
    joined = light.join(again, same, "left")
    seen = F.coalesce(F.struct(F.col("turn").isNotNull().alias("known"), "turn") > F.col("first"), F.lit(False))
    head = F.when(F.col("blank") | seen, "d").when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial"))
    kinds = F.concat(head, F.repeat(F.lit("d"), (F.col("copies") - 1).cast("int")))
    return joined.select("conv", "turn", "role", "digest", "initial", "blank", kinds.alias("kinds"))


def _stretches(rows: DataFrame) -> DataFrame:
    """conv, part, state: a stretch for each conversation and range of rows, however many conversations a range holds."""
    kind = rows.schema["conv"].dataType.simpleString()
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    ranged = rows.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order).select("conv", "turn", "initial", "blank", "kinds")

    def run(batches):
        part = TaskContext.get().partitionId()
        held: tuple | None = None  # the last run of a batch may go on in the next

        def out(conv, stretches):
            return {"conv": conv, "part": part, "state": json.dumps(asdict(reduced(stretches)))}

        for batch in batches:
            made = []
            turn, initial, blank, kinds = (batch.column(c).to_pylist() for c in ("turn", "initial", "blank", "kinds"))
            for a, b in _runs(batch.column("conv")):
                conv, own = batch.column("conv")[a].as_py(), _stretch(turn[a:b], initial[a:b], blank[a:b], kinds[a:b])
                if held and held[0] == conv:
                    held[1].append(own)
                    continue
                if held:
                    made.append(out(*held))
                held = (conv, [own])
            if held and len(held[1]) > 64:
                held = (held[0], [reduced(held[1])])
            yield pa.RecordBatch.from_pylist(made, schema=pa.schema([batch.schema.field("conv"), ("part", pa.int32()), ("state", pa.string())]))
        if held:
            yield pa.RecordBatch.from_pylist([out(*held)], schema=pa.schema([batch.schema.field("conv"), ("part", pa.int32()), ("state", pa.string())]))

    return ranged.mapInArrow(run, f"conv {kind}, part int, state string")


def _stretch(turn: list, initial: list[str], blank: list[bool], kinds: list[str]) -> Stretch:
    counts = list(map(len, kinds))
    initials = "".join(initial)
    known = [t for t in turn if t is not None]
    return Stretch(
        matrix_of("".join(kinds)), sum(n for n, b in zip(counts, blank, strict=True) if b),
        sum(k.count("d") for k, b in zip(kinds, blank, strict=True) if not b), sum(k[0].isupper() for k in kinds),
        sum(initials[k : k + 2] not in LEGAL for k in range(len(initials) - 1)) + sum(counts) - len(counts),
        len(set(known)), initials[0], initials[-1], min(known, default=None), max(known, default=None),
    )


def _loaded(state: str) -> Stretch:
    d = json.loads(state)
    return Stretch(**d | {"matrix": tuple(tuple(tuple(x) if x else None for x in row) for row in d["matrix"])})


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> DataFrame:
    """For each conversation a report (position 0: REPORT), and then its repaired turns (position from 1: role, text, edit).

    Turns go by number (null ones first), then role and the SHA-256 of the text; null roles and texts are one space. A
    turn's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier), truncated (its last
    character that is no white space is none of . ! ?). Edits are keep, rerole (2), delete (3; blank and duplicate turns
    must go) and insert (2, an empty text); a truncated turn that stays costs 1. The cheapest edits are taken, and of them
    those whose initials come first in ASCII; inserted turns have the edit I, deleted ones are not among the turns.
    copies: a column that says how often a row stands there (0: it doesn't, but its conversation gets a report). A
    conversation without turns has zeros and an empty audit. Rows with a null conv are one conversation. Repeated rows are
    duplicates. Other columns take no part; an empty table gives no rows.

    A conversation's matrices are made where its rows lie, range by range, and reduced as a tree; its rows are then read
    once more in order, streamed, never held. Its audit is held by the task that reduces it: a byte or two for each turn,
    and up to 16 of them. Rows of a conversation come out in order, in one partition.
    """
    base = _fields(rows, conv, turn, role, text, copies)
    kind = base.schema["conv"].dataType.simpleString()
    states = _stretches(_kinds(base))
    null = lambda c, t: F.lit(None).cast(t).alias(c)
    both = states.select("conv", "part", "state", null("turn", "long"), null("role", "string"), null("digest", "binary"), null("text", "string"), null("copies", "long")).unionByName(
        base.select("conv", null("part", "int"), null("state", "string"), "turn", "role", "digest", "text", "copies")
    )
    order = [F.col("conv"), F.col("part").asc_nulls_last(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    sorted_ = both.repartition(partitions(rows), "conv").sortWithinPartitions(*order).select("conv", "state", "role", "text", "copies")
    schema = f"conv {kind}, position long, role string, text string, edit string, {REPORT}"

    def run(batches):
        for batch in batches:
            kinds = pa.schema([batch.schema.field("conv"), *_OUT])
            break
        else:
            return
        for made in _replayed(_chain(batch, batches)):
            yield pa.RecordBatch.from_pylist(made, schema=kinds)

    return sorted_.mapInArrow(run, schema).withColumnRenamed("conv", conv)


_OUT = [("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string()), *((c, pa.int64()) for c in _NUMBERS), ("audit", pa.string())]


def _chain(first, rest):
    yield first
    yield from rest


def _replayed(batches, most: int = 4096) -> Iterator[list[dict]]:
    """Rows of repair(), some thousand at a time, from rows sorted as there: a conversation's stretches, then its turns."""
    now = _Replay(None, [])
    begun, made = False, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "state", "role", "text", "copies")]
        for conv, state, role, text, copies in zip(*columns, strict=True):
            if not begun or conv != now.conv:
                if begun:
                    made += now.end()
                begun, now = True, _Replay(conv, [])
            if state is not None:
                now.stretches.append(_loaded(state))
            else:
                for _ in range(copies):
                    made += now.turn(role, text)
                    if len(made) >= most:
                        yield made
                        made = []
        if made:
            yield made
            made = []
    if begun:
        yield now.end()


class _Replay:
    """The edits of one conversation, carried out turn by turn. The report goes out with the first turn, or at the end."""

    def __init__(self, conv, stretches: list[Stretch]) -> None:
        self.conv, self.stretches, self.audit, self.at, self.position, self.state = conv, stretches, None, 0, 0, NOTHING

    def _row(self, **fields) -> dict:
        return {"conv": self.conv, "position": self.position} | fields

    def _begun(self) -> list[dict]:
        if self.audit is not None:
            return []
        if not self.stretches:
            self.audit = ""
            return [self._row(**dict.fromkeys(_NUMBERS, 0), audit="")]
        whole = reduced(self.stretches)
        self.stretches = []
        cost, self.audit = cheapest(whole.matrix)
        return [self._row(cost=cost, audit=self.audit, **{c: getattr(whole, c) for c in _NUMBERS[:-1]})]

    def _put(self, role: str, text: str, edit: str) -> dict:
        self.position += 1
        self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        return self._row(role=role, text=text, edit=edit)

    def _inserted(self) -> list[dict]:
        out = []
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            out.append(self._put(ROLES[NEXT[self.state]], "", "I"))
        return out

    def turn(self, role: str, text: str) -> list[dict]:
        out = self._begun() + self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            out.append(self._put(role if edit == "K" else ROLES[NEXT[self.state]], text, edit))
        return out

    def end(self) -> list[dict]:
        return self._begun() + self._inserted()


def with_digest(repaired: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The reports of repair(), with the SHA-256 of the repaired turns: role:text, joined by newlines. Turns are streamed."""
    kind = repaired.schema[conv].dataType.simpleString()

    def run(batches):
        held, digest = None, None
        for batch in batches:
            names, done = batch.schema, []
            schema = pa.schema([names.field(conv), *((c, names.field(c).type) for c in [*_NUMBERS, "audit"]), ("repaired_sha256", pa.string())])
            for row in batch.to_pylist():
                if row["position"] == 0:
                    if held is not None:
                        done.append(held | {"repaired_sha256": digest.hexdigest()})
                    held, digest = {c: row[c] for c in (conv, *_NUMBERS, "audit")}, hashlib.sha256()
                else:
                    digest.update(("\n" * (row["position"] > 1) + f"{row['role']}:{row['text']}").encode())
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([held | {"repaired_sha256": digest.hexdigest()}], schema=schema)

    return repaired.mapInArrow(run, f"`{conv}` {kind}, {REPORT}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults: rows by crc32 of `conv_id:turn` modulo 20, with copies (0, 1 or 2). Nulls are one space."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text: Column = F.when(fault == 1, "").when(fault == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def op11_repair(spark, sf_dir: str) -> DataFrame:
    return with_digest(repair(damaged(read(spark, sf_dir, "conversations")), copies="copies"))


SQL_OP11 = r"""
WITH RECURSIVE
bits AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i)),
k AS (SELECT *, list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda z: ascii(z)::BIGINT)) AS b FROM conversations),
f AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(b, lambda c, z: xor(c >> 8, tab[(xor(c, z) & 255) + 1])), 4294967295) % 20 AS fault FROM k, bits),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE fault <> 0),
o AS (SELECT *, row_number() OVER w AS n, lag(left(role, 1)) OVER w || left(role, 1) AS pair, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
x AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM o),
facts AS (SELECT conv_id, count(*) AS rows_, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY conv_id),
-- states: n nothing, s, u, a
nxt(i, j, r) AS (VALUES ('n', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')),
ins(i, j, c, e, t) AS (SELECT z, z, 0, '', [] FROM (VALUES ('n'), ('s'), ('u'), ('a')) q(z) UNION ALL SELECT i, j, 2, 'I', [r || ':'] FROM nxt
  UNION ALL SELECT p.i, q.j, 4, 'II', [p.r || ':', q.r || ':'] FROM nxt p JOIN nxt q ON q.i = p.j),
steps(n, conv_id, s, best) AS (
  SELECT 0::BIGINT, conv_id, j, {'c': c, 'e': e, 't': t::VARCHAR[]} FROM facts, ins WHERE i = 'n'
  UNION ALL
  SELECT n, conv_id, s, min(best) FROM (
    SELECT x.n, x.conv_id, ins.j AS s, {'c': p.best.c + m.c + ins.c, 'e': p.best.e || m.e || ins.e, 't': list_concat(p.best.t, m.t, ins.t::VARCHAR[])} AS best
    FROM steps p JOIN x ON x.n = p.n + 1 AND x.conv_id IS NOT DISTINCT FROM p.conv_id,
      LATERAL (SELECT p.s AS j, 3 AS c, 'D' AS e, []::VARCHAR[] AS t
        UNION ALL SELECT nxt.j, 2 + (x.fault = 't')::INT, 'R', [nxt.r || ':' || x.text] FROM nxt WHERE nxt.i = p.s AND x.fault NOT IN ('b', 'd')
        UNION ALL SELECT left(x.role, 1), (x.fault = 't')::INT, 'K', [x.role || ':' || x.text] WHERE x.fault NOT IN ('b', 'd') AND (p.s || left(x.role, 1)) IN ('ns', 'nu', 'su', 'ua', 'au')) m
      JOIN ins ON ins.i = m.j) GROUP BY n, conv_id, s),
done AS (SELECT s.conv_id, min(best) AS best FROM steps s JOIN facts f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.rows_ = s.n WHERE s.s IN ('n', 'a') GROUP BY s.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""
