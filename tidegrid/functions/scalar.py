"""Scalar functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, places: int = 6) -> Column:
    """Half away from zero; minus zero becomes zero."""
    return F.round(c, places) + F.lit(0.0)


def at_most(a: Column, b: Column, slack: float = 5e-7) -> Column:
    return a <= b + F.lit(slack)


def at_least(a: Column, b: Column, slack: float = 5e-7) -> Column:
    return a >= b - F.lit(slack)


def clamp(c: Column, low: float, high: float) -> Column:
    """Null stays null, which least and greatest alone would not do."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Euclidean, in doubles."""
    dx, dy = (x1.cast("double") - x2.cast("double")), (y1.cast("double") - y2.cast("double"))
    return F.sqrt(dx * dx + dy * dy)


def finite(c: Column) -> Column:
    """c, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def finite_not_negative(c: Column) -> Column:
    return F.when(finite(c) >= 0, c)


def logit(p: Column, edge: float = 1e-6) -> Column:
    q = clamp(p, edge, 1 - edge)
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def calibrated(p: Column, slope: float, intercept: float, edge: float = 1e-6) -> Column:
    """A sigmoid calibration of p, clipped to the open unit interval."""
    return clamp(sigmoid(F.lit(slope) * logit(p, edge) + F.lit(intercept)), edge, 1 - edge)


def null_if_either(a: Column, b: Column, value: Column) -> Column:
    """value, or null if a or b is: least, greatest and sums over columns skip nulls."""
    return F.when(a.isNotNull() & b.isNotNull(), value)


def facing(dx: Column, dy: Column, yaw_degrees: Column, least: float) -> Column:
    """Whether a heading points along (dx, dy): the cosine between them is at least `least`. No direction: null."""
    length = F.sqrt(dx * dx + dy * dy)
    cosine = F.try_divide(dx * F.cos(F.radians(yaw_degrees)) + dy * F.sin(F.radians(yaw_degrees)), length)
    return cosine >= F.lit(least)


def private_ref(prefix: str, *parts: Column) -> Column:
    """prefix-HASH of parts joined by newlines: the same parts give the same reference, and no way back."""
    return F.concat(F.lit(f"{prefix}-"), F.sha2(F.concat_ws("\n", *parts), 256))


def short_number(c: Column) -> Column:
    """Up to six decimals, without trailing zeros."""
    fixed = F.regexp_replace(F.format_string("%.6f", rounded(c)), r"(\.[0-9]*?)0+$", "$1")
    return F.regexp_replace(fixed, r"\.$", "")


def clock(seconds: Column) -> Column:
    """mm:ss; minutes may have more digits than two."""
    whole = F.floor(F.greatest(seconds, F.lit(0)))
    minutes = F.floor(whole / 60).cast("string")
    return F.concat(F.when(F.length(minutes) < 2, F.lpad(minutes, 2, "0")).otherwise(minutes), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds; null if none: the row is eligible."""
    return F.coalesce(*(F.when(c, F.lit(name)) for c, name in rules))


def all_reasons(*rules: tuple[Column, str], separator: str = "+") -> Column:
    """The names of all rules that hold, joined; empty if none."""
    return F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in rules))), separator)


def tags(**flags: Column) -> Column:
    """The names of the flags that are true, in the order given."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in flags.items())))


def masked(columns: dict[str, Column], known: Column) -> dict[str, Column]:
    """Each column, or null where what it rests on isn't known."""
    return {name: F.when(known, c) for name, c in columns.items()}


def affine(c: Column, origin: float, scale: float, flip: bool = False) -> Column:
    return ((F.lit(origin) - c) if flip else (c - F.lit(origin))) / F.lit(scale)


def rotation(yaw: Column) -> Column:
    """A heading on a map with north up, in [0, 360)."""
    return F.pmod(F.lit(90) - yaw, F.lit(360))
