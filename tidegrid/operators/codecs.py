"""Reversible forms of JSON texts, row by row: tables for arrays of like objects, runs, ranges, and other names for keys."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags of the encoded form (object, constant, range, table, array) and fields of the packed one.
OBJECT, CONSTANT, RANGE, TABLE, ARRAY = "o", "c", "r", "t", "a"
COLUMNS, ROWS = "columns", "rows"


def _text(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def _parsed(text: str) -> Any:
    def refuse(name: str):
        raise ValueError(f"{name} is no JSON number")

    return json.loads(text, parse_constant=refuse)


def _alike(items: list) -> list[str] | None:
    """The keys that all items have, if they are objects with the same ones."""
    if items and all(isinstance(x, dict) and x.keys() == items[0].keys() for x in items):
        return sorted(items[0])
    return None


def _encode(value: Any) -> Any:
    """Lists carry a tag; of an array's forms the shortest is taken, the simplest of equal ones."""
    if isinstance(value, dict):
        keys = sorted(value)
        return [OBJECT, keys, [_encode(value[k]) for k in keys]]
    if not isinstance(value, list):
        return value
    forms = [[ARRAY, [_encode(x) for x in value]]]
    if len({_text(x) for x in value}) == 1:
        forms.append([CONSTANT, _encode(value[0]), len(value)])
    if len(value) > 1 and all(type(x) is int for x in value) and len({b - a for a, b in zip(value, value[1:], strict=False)}) == 1:
        forms.append([RANGE, value[0], value[1] - value[0], len(value)])
    if keys := _alike(value):
        forms.append([TABLE, keys, [_encode([x[k] for x in value]) for k in keys], len(value)])
    return min(forms, key=lambda f: len(_text(f)))


def _decode(value: Any) -> Any:
    if not isinstance(value, list):
        return value
    match value:
        case [str(tag), list(keys), list(inner)] if tag == OBJECT and len(set(keys)) == len(keys) == len(inner):
            return dict(zip(keys, map(_decode, inner), strict=True))
        case [str(tag), list(inner)] if tag == ARRAY:
            return [_decode(x) for x in inner]
        case [str(tag), inner, int(n)] if tag == CONSTANT and n > 0:
            return [_decode(inner) for _ in range(n)]
        case [str(tag), int(first), int(step), int(n)] if tag == RANGE and n > 0:
            return [first + k * step for k in range(n)]
        case [str(tag), list(keys), list(inner), int(n)] if tag == TABLE and len(set(keys)) == len(keys) == len(inner) and n > 0:
            columns = [_decode(x) for x in inner]
            if all(isinstance(c, list) and len(c) == n for c in columns):
                return [dict(zip(keys, row, strict=True)) for row in zip(*columns, strict=True)]
    raise ValueError("no encoded form")


def _pack(value: Any) -> Any:
    if isinstance(value, list):
        keys = _alike(value)
        return {COLUMNS: keys, ROWS: [[_pack(x[k]) for k in keys] for x in value]} if keys is not None else [_pack(x) for x in value]
    if isinstance(value, dict):
        if value.keys() == {COLUMNS, ROWS}:
            raise ValueError("an object has the fields of a packed table")
        return {k: _pack(x) for k, x in value.items()}
    return value


def _unpack(value: Any) -> Any:
    if isinstance(value, dict):
        if value.keys() != {COLUMNS, ROWS}:
            return {k: _unpack(x) for k, x in value.items()}
        keys, rows = value[COLUMNS], value[ROWS]
        if not (isinstance(keys, list) and keys == sorted(set(keys)) and isinstance(rows, list) and rows and all(isinstance(r, list) and len(r) == len(keys) for r in rows)):
            raise ValueError("no packed table")
        return [dict(zip(keys, map(_unpack, r), strict=True)) for r in rows]
    return [_unpack(x) for x in value] if isinstance(value, list) else value


def _rename(value: Any, names: dict[str, str]) -> Any:
    if isinstance(value, list):
        return [_rename(x, names) for x in value]
    if not isinstance(value, dict):
        return value
    new = {names.get(k, k): _rename(x, names) for k, x in value.items()}
    if len(new) != len(value):
        raise ValueError("two keys get one name")
    return new


def _each(column: Column, work) -> Column:
    """work on each parsed text; nulls stay."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _text(work(_parsed(t))))

    return F.pandas_udf(run, "string")(column)


def encoded(rows: DataFrame, json_col: str, name: str = "encoded") -> DataFrame:
    """rows with name and is_<name>: the encoded text where it is shorter than the plain one with sorted keys, else that.

    Numbers, their kinds included, and texts come back as they are; NaN and infinities fail, null stays null.
    """
    plain, coded = _each(F.col(json_col), lambda v: v), _each(F.col(json_col), _encode)
    both = rows.withColumn("__p", plain).withColumn("__e", coded)
    shorter = F.length("__e") < F.length("__p")
    return both.withColumn(name, F.when(shorter, F.col("__e")).otherwise(F.col("__p"))).withColumn(f"is_{name}", shorter).select(*rows.columns, name, f"is_{name}")


def decoded(rows: DataFrame, coded_col: str, flag_col: str, name: str = "decoded") -> DataFrame:
    """rows with the JSON that encoded() took, keys sorted; a text that is marked as encoded and is not fails."""
    return rows.withColumn(name, F.when(F.col(flag_col), _each(F.when(F.col(flag_col), F.col(coded_col)), _decode)).otherwise(F.col(coded_col)))


def packed(json_col: Column) -> Column:
    """Arrays of objects with the same keys as {"columns": [...], "rows": [[...]]}; an object with just these keys fails."""
    return _each(json_col, _pack)


def unpacked(json_col: Column) -> Column:
    return _each(json_col, _unpack)


def renamed(json_col: Column, names: dict[str, str], back: bool = False) -> Column:
    """Keys at any depth by other names (back: the other way round). Two names for one key, or two keys of an object that get
    one name, fail; so what one way gives the other takes back.
    """
    if len(set(names.values())) < len(names):
        raise ValueError("two keys have one name")
    way = {v: k for k, v in names.items()} if back else names
    return _each(json_col, lambda v: _rename(v, way))
