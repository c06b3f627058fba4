"""JSON forms against the standard library's, and the reversible codecs on random records."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import jsonforms

VALUES = [0, 1, -7, 2**62, 10**25, 0.1, 1.0, -2.5, 1e-5, 2.5e-7, 123456.7890125, 1e16, 1.5e300, 99999.9999995, True, False, None, "", "plain", 'q"\\/\b\f\n\r\t', "ß é 世界 😀", "<a href='x'>&+`</a>", "\x01\x1f\x7f", [], {}]
KEYS = ["a", "b", "a/b", "m~n", "Z", "é", "", "10", "9"]


def record(rng, depth=0):
    kind = rng.random()
    if depth > 4 or kind < 0.4:
        return rng.choice(VALUES)
    if kind < 0.7:
        return {k: record(rng, depth + 1) for k in rng.sample(KEYS, rng.randrange(5))}
    return [record(rng, depth + 1) for _ in range(rng.randrange(5))]


def records(n=120):
    rng = random.Random(8)
    return [*VALUES, [[]], [None, None], {"": {}}, [[[[[[[1]]]]]]], *(record(rng) for _ in range(n))]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = [(k, json.dumps(r, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))) for k, r in enumerate(records())] + [(-1, None)]
    return spark.createDataFrame(rows, "id int, j string").repartition(4)


def exact(v):
    return json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def plain_leaves(v, path=""):
    if isinstance(v, dict) and v:
        for k in v:
            yield from plain_leaves(v[k], f"{path}/{k.replace('~', '~0').replace('/', '~1')}")
    elif isinstance(v, list) and v:
        for k, x in enumerate(v):
            yield from plain_leaves(x, f"{path}/{k}")
    else:
        yield path, exact(v)


def test_leaves(table):
    got = {}
    for r in jsonforms.leaves(table, ["id"], "j").collect():
        got.setdefault(r.id, {})[r.pointer] = r.text
    assert got == {k: dict(plain_leaves(r)) for k, r in enumerate(records())}


def test_exact_form(table):
    out = {r.id: r for r in jsonforms.canonical(table, "j").withColumn("d", jsonforms.digest(F.col("canonical"), jsonforms.EXACT)).collect()}
    for k, r in enumerate(records()):
        assert out[k].canonical == exact(r) and tuple(out[k].d) == ("exact", hashlib.sha256(exact(r).encode()).hexdigest())
    assert out[-1].canonical is None and out[-1].d is None


def rounded(v):
    if isinstance(v, dict):
        return "{" + ",".join(f"{rounded(k)}:{rounded(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(rounded, v)) + "]"
    if isinstance(v, str):
        out = ""
        for c in v:
            if c in jsonforms.SHORT:
                out += jsonforms.SHORT[c]
            elif c in jsonforms.ESCAPED or not " " <= c <= "~":
                units = c.encode("utf-16-be")
                out += "".join(f"\\u{units[i]:02X}{units[i + 1]:02X}" for i in range(0, len(units), 2))
            else:
                out += c
        return f'"{out}"'
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    if isinstance(v, int) and abs(v) < 2**63:
        return str(v)
    x = float(v)
    if abs(x) < 1e15:
        x = math.copysign(math.floor(abs(x) * 1e6 + 0.5) / 1e6, x)
    if x == 0:
        return "0"
    if 1e-4 <= abs(x) < 1e15:
        return f"{x:.6f}".rstrip("0").rstrip(".")
    head, _, power = f"{x!r}".partition("e") if "e" in repr(x) else f"{x:.17e}".partition("e")
    return f"{head.removesuffix('.0')}E{'-' if int(power) < 0 else '+'}{abs(int(power)):02d}"


def test_rounded_form(table):
    out = {r.id: r.canonical for r in jsonforms.canonical(table, "j", jsonforms.ROUNDED).collect()}
    for k, r in enumerate(records()):
        assert out[k] == rounded(r), (k, r)


def test_odd_json(spark):
    bad = spark.createDataFrame([(1, '{"a": NaN}')], "id int, j string")
    with pytest.raises(Exception, match="MALFORMED|parse"):
        jsonforms.canonical(bad, "j").collect()
    huge = spark.createDataFrame([(1, "[1e400]")], "id int, j string")
    with pytest.raises(Exception, match="finite|MALFORMED|parse|range"):
        jsonforms.canonical(huge, "j").collect()
    assert jsonforms.canonical(bad.filter("false"), "j").count() == jsonforms.leaves(bad.filter("false"), ["id"], "j").count() == 0


def test_forbidden_and_differences(spark):
    a = spark.createDataFrame([(1, '{"x": 1.0, "in": {"Winner": 2, "l": [{"winner": 3}]}, "s": "t"}'), (2, '{"a": [1, 2]}'), (None, "1")], "id int, j string")
    found = [tuple(r) for r in jsonforms.forbidden_fields(a, ["id"], "j", ["WINNER", "end"]).collect()]
    assert found == [(1, "/in/Winner", "Winner")]
    b = spark.createDataFrame([(1, '{"s": "u", "x": 1.000000001, "in": {"Winner": 2, "l": [{"winner": 3.1}]}}'), (2, '{"a": [1]}'), (None, "1.0")], "id int, j string")
    got = sorted(map(tuple, jsonforms.differences(a, b, ["id"], "j").collect()))
    assert got == [(1, "/in/l/0/winner", "3", "3.1"), (1, "/s", '"t"', '"u"'), (2, "/a/1", "2", None)]


def like_rows(rng):
    keys = rng.sample("abcd", 3)
    kinds = {k: rng.choice(["n", "const", "range", "nest"]) for k in keys}
    step = rng.randrange(-3, 4)
    return [{k: {"n": rng.random(), "const": [1, "x"], "range": i * step, "nest": {"u": i, "v": None}}[kinds[k]] for k in keys} for i in range(rng.randrange(12))]


def test_codecs_give_back_what_they_took(spark):
    from tidegrid.operators import codecs

    rng = random.Random(4)
    values = [*records(), *(like_rows(rng) for _ in range(60)), *({"rows": like_rows(rng), "x": record(rng)} for _ in range(30)), [True, True], [1, 1.0], [1, True], list(range(50)), ["o", [], []], [["a", []]]]
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)] + [(-1, None)], "id int, j string").repartition(3)
    out = codecs.decoded(codecs.encoded(rows, "j"), "encoded", "is_encoded").withColumn("u", codecs.unpacked(codecs.packed(F.col("j")))).collect()
    assert sum(bool(r.is_encoded) for r in out) > 50
    for r in out:
        if r.id < 0:
            assert r.encoded is r.decoded is r.u is None
            continue
        assert r.decoded == r.u == exact(values[r.id]) and len(r.encoded) <= len(exact(values[r.id]))


def test_codecs_refuse(spark):
    from tidegrid.operators import codecs

    one = lambda text: spark.createDataFrame([(text, True)], "j string, f boolean")
    for text in ('["c",1,0]', '["t",["a"],[["a",[1]]],2]', '["z"]', '["o",["a","a"],[1,2]]'):
        with pytest.raises(Exception, match="no encoded form"):
            codecs.decoded(one(text), "j", "f").collect()
    with pytest.raises(Exception, match="packed table"):
        one('{"columns": 1, "rows": 2}').select(codecs.packed(F.col("j"))).collect()
    with pytest.raises(Exception, match="no JSON number"):
        codecs.encoded(one("[NaN]"), "j").collect()
    short = {"position": "p", "velocity": "v"}
    got = one('{"position": {"velocity": [{"position": 1}], "other": 2}}').select(codecs.renamed(F.col("j"), short).alias("s")).select("s", codecs.renamed(F.col("s"), short, back=True).alias("b")).first()
    assert tuple(got) == ('{"p":{"other":2,"v":[{"p":1}]}}', '{"position":{"other":2,"velocity":[{"position":1}]}}')
    with pytest.raises(Exception, match="one name"):
        one('{"position": 1, "p": 2}').select(codecs.renamed(F.col("j"), short)).collect()
    with pytest.raises(ValueError, match="one name"):
        codecs.renamed(F.col("j"), {"a": "x", "b": "x"})
