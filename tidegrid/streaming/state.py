"""Keyed state for streams: the folds of the batch operators, kept from one micro-batch to the next."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.rounds import ATTEMPTS, Attempt, Match, changed_attempts

_COLUMNS = [x.split()[0] for x in ATTEMPTS.replace("\n", " ").split(", ")]


def _dump(match: Match) -> str:
    return json.dumps(asdict(match))


def _load(text: str) -> Match:
    d = json.loads(text)
    return Match(**d | {"attempts": [Attempt(**a) for a in d["attempts"]]})


def stream_attempts(observed: DataFrame, key: str = "match_id") -> DataFrame:
    """Upserts of attempts, keyed by key and round_id: a later row replaces an earlier one, and may void it.

    For update mode: a score that goes back changes attempts already given out, which appending could not. Rows of a
    match must come in order of tick and seq from one micro-batch to the next; within one they are sorted here.
    """
    kind = observed.schema[key].dataType.simpleString()

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        match = _load(state.get[0]) if state.exists else Match()
        rows = pd.concat(frames).sort_values(["tick", "seq"], kind="stable").to_dict("records")
        out = pd.DataFrame(list(changed_attempts(match, rows)), dtype=object)
        state.update((_dump(match),))
        if len(out):
            yield out.assign(**{key: keys[0]})[[key, *_COLUMNS]]

    return observed.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, {ATTEMPTS}", "match string", "update", "NoTimeout")


def stream_min_gap(rows: DataFrame, key: str, on: str, gap: int) -> DataFrame:
    """Greedy minimum-gap sampling of a stream: (key, on) of the rows kept; rows come in order of time by micro-batch."""
    kind = {c: rows.schema[c].dataType.simpleString() for c in (key, on)}

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, kept = (state.get[0] if state.exists else None), []
        for t in sorted(t for f in frames for t in f[on].dropna().astype("int64").tolist()):
            if last is None or t - last >= gap:
                last = t
                kept.append(t)
        if kept:
            state.update((last,))
            yield pd.DataFrame({key: keys[0], on: kept})

    return rows.select(key, on).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind[key]}, `{on}` {kind[on]}", "last long", "append", "NoTimeout")


def last_write(rows: DataFrame, keys: list[str], on: str, order: str, lateness: str) -> DataFrame:
    """Of a stream's rows of one key and event time the one written last (largest `order`), once the time can't change.

    A provisional row is replaced by what comes later. A time's result appears when the watermark, `lateness` behind the
    latest time seen, has passed it; rows that come in a later micro-batch are dropped. For append mode. on: a timestamp.
    """
    rest = [c for c in rows.columns if c not in (*keys, on, order)]
    last = rows.withWatermark(on, lateness).groupBy(*keys, F.window(on, "1 microsecond")).agg(F.max(F.struct(order, on, *rest)).alias("v"))
    return last.select(*keys, *(F.col("v")[c].alias(c) for c in (on, order, *rest)))


def fresh(probes: DataFrame, found_at: str, on: str, values: list[str], longest: float) -> DataFrame:
    """probes with values nulled where what they hold is over `longest` (inclusive) old, or unknown, or later than the probe.

    Row by row, so on a stream as on a table.
    """
    age = F.col(on) - F.col(found_at)
    return probes.withColumns({v: F.when((age >= 0) & (age <= longest), F.col(v)) for v in values})


def upsert_into(path: str, keys: list[str], order: list[str] | None = None):
    """A foreachBatch function that writes each micro-batch's last upsert of each key (by `order`) under its number.

    Writing a number again replaces it, so a batch that runs twice counts once. Without an order a batch must hold a key
    once; if it doesn't, the batch fails.
    """

    def write(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        last = F.max(F.struct(*(order or []), *(c for c in rest if c not in (order or [])))) if order else F.first(F.struct(*rest))
        once = batch.groupBy(*keys).agg(last.alias("v"), F.count(F.lit(1)).alias("n"))
        if not order:
            fine = F.when(F.col("n") > 1, F.raise_error(F.lit("a key repeats in a batch")).cast("boolean")).otherwise(F.lit(True))
            once = once.filter(fine)
        once.select(*keys, *(F.col("v")[c].alias(c) for c in rest)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest(upserts: DataFrame, keys: list[str]) -> DataFrame:
    """The last upsert of each key, from a table written by upsert_into."""
    rest = [c for c in upserts.columns if c not in (*keys, "batch")]
    last = upserts.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v"))
    return last.select(*keys, "v.*")
