"""JSON as a table of its nodes: leaves by pointer, canonical texts and their digests, tolerant comparison, forbidden fields.

Records are parsed once, as variants, and taken apart one level after the other by DataFrame functions; a level is as many
rows as it has nodes, so neither a large record nor a deep one is parsed again. A level's containers are written to the
shared folder before the next is read from them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.sources.shared import stored

Names = Sequence[str]
#: The two canonical forms. Their digests are never equal by meaning, so each carries its form.
ROUNDED, EXACT = "rounded-6", "exact"
ABSOLUTE, RELATIVE = 1e-8, 1e-10
#: Levels beyond which a record is refused.
DEEPEST = 200

# What the rounded form escapes besides control and other than ASCII characters, and short escapes.
ESCAPED = "\"&'+<>`"
SHORT = {"\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _kind(v: Column) -> Column:
    """object, array, string, number, boolean or null."""
    s = F.schema_of_variant(v)
    return (
        F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").otherwise("number")
    )


def _filled(kind: Column, v: Column) -> Column:
    return kind.isin("object", "array") & ~F.schema_of_variant(v).isin("OBJECT<>", "ARRAY<VOID>") | ((F.schema_of_variant(v) == "ARRAY<VOID>") & (F.to_json(v) != "[]"))


def _levels(records: DataFrame, json: str) -> tuple[DataFrame, list[DataFrame]]:
    """records with a number for each row, and the nodes of each level: row, parent, pointer, key, pos, kind, v, open, plain."""
    numbered = stored(records.withColumn("__row", F.monotonically_increasing_id()))
    value = F.parse_json(F.col(json))
    root = numbered.filter(F.col(json).isNotNull()).select(
        "__row", F.lit(None).cast("string").alias("parent"), F.lit("").alias("pointer"), F.lit(None).cast("string").alias("key"), F.lit(0).alias("pos"), value.alias("v"), F.lit(True).alias("plain"),
    )
    levels = []
    nodes = root
    for _ in range(DEEPEST):
        nodes = nodes.withColumn("kind", _kind(F.col("v"))).withColumn("open", _filled(F.col("kind"), F.col("v")))
        levels.append(nodes)
        boxes = stored(nodes.filter("open").select("__row", F.col("pointer").alias("parent"), F.col("kind").alias("box"), F.col("v").alias("inside"), F.col("plain").alias("was")))
        if boxes.isEmpty():
            return numbered, levels
        each = boxes.lateralJoin(boxes.sparkSession.tvf.variant_explode(F.col("inside").outer()))
        step = F.when(F.col("box") == "array", F.col("pos").cast("string")).otherwise(F.replace(F.replace(F.col("key"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
        nodes = each.select("__row", "parent", F.concat("parent", F.lit("/"), step).alias("pointer"), "key", "pos", F.col("value").alias("v"), (F.col("was") & (F.col("box") == "object")).alias("plain"))
    raise ValueError(f"a record has more than {DEEPEST} levels")


def _union(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for d in levels[1:]:
        out = out.unionByName(d)
    return out


def _number(v: Column) -> Column:
    return F.when(_kind(v) == "number", F.try_variant_get(v, "$", "double"))


def leaves(records: DataFrame, ids: Names, json: str) -> DataFrame:
    """(ids, pointer, kind, text, number) of each scalar and empty container of a JSON column, by its pointer.

    A pointer joins keys and places with /; ~ and / in a key are ~0 and ~1. text is the exact canonical form, number that of
    numbers as a double. Null records have no leaves; what is no JSON fails. Repeated rows have leaves each.
    """
    numbered, levels = _levels(records, json)
    found = _union(levels).filter(~F.col("open")).select("__row", "pointer", "kind", _scalar(F.col("v"), F.col("kind"), EXACT).alias("text"), _number(F.col("v")).alias("number"))
    return numbered.select("__row", *ids).join(found, "__row").drop("__row")


def forbidden_fields(records: DataFrame, ids: Names, json: str, fields: Names) -> DataFrame:
    """(ids, pointer, key) of each key, in any case of letters, that a record must not have; objects within arrays don't count."""
    numbered, levels = _levels(records, json)
    names = sorted({f.lower() for f in fields})
    found = _union(levels).filter(F.col("plain") & F.lower("key").isin(names)).select("__row", "pointer", "key")
    return numbered.select("__row", *ids).join(found, "__row").drop("__row")


def differences(actual: DataFrame, expected: DataFrame, ids: Names, json: str) -> DataFrame:
    """(ids, pointer, actual, expected) of each leaf that differs; a side's text is null where it has no such leaf.

    Numbers are equal within 1e-8, or 1e-10 of the larger; other leaves only to their like. ids tell records apart.
    """
    a, b = (leaves(d, ids, json).select(*ids, "pointer", *(F.col(c).alias(f"{c}{k}") for c in ("kind", "text", "number"))) for k, d in enumerate((actual, expected)))
    right = b.select(*(F.col(c).alias(f"__{c}") for c in (*ids, "pointer")), "kind1", "text1", "number1")
    rows = a.join(right, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*ids, "pointer")], "full")
    x, y = F.col("number0"), F.col("number1")
    near = (F.col("kind0") == "number") & (F.col("kind1") == "number") & (F.abs(x - y) <= F.greatest(F.lit(ABSOLUTE), RELATIVE * F.greatest(F.abs(x), F.abs(y))))
    same = (F.col("kind0") == F.col("kind1")) & (F.col("text0") == F.col("text1"))
    odd = rows.filter(~F.coalesce(near | same, F.lit(False)))
    return odd.select(*(F.coalesce(c, f"__{c}").alias(c) for c in (*ids, "pointer")), F.col("text0").alias("actual"), F.col("text1").alias("expected"))


def canonical(records: DataFrame, json: str, form: str = EXACT, name: str = "canonical") -> DataFrame:
    """records with one text for each JSON value, whatever the order of its keys and its white space; null stays null.

    exact: keys in order of their characters, no white space, numbers as they are (a fraction in its shortest form, 1.0
    apart from 1), characters other than quotes, backslashes and controls as they are. rounded-6: numbers rounded half away
    from zero to six decimals, no negative zero, whole ones without a point; quotes, &, ', +, <, >, ` and all that is not
    ASCII as escapes. A number that is no finite double fails. Texts grow together from the deepest level up; a record's
    is one value in the end.
    """
    numbered, levels = _levels(records, json)
    below = None
    for depth in range(len(levels) - 1, -1, -1):
        nodes = levels[depth]
        text = _scalar(F.col("v"), F.col("kind"), form)
        if below is None:
            own = nodes.withColumn("text", text)
        else:
            named = below.select("__row", F.col("parent").alias("__p"), F.struct("key", "pos", "text").alias("c")).groupBy("__row", "__p").agg(F.collect_list("c").alias("inner"))
            own = nodes.join(named.withColumnRenamed("__row", "__r"), (F.col("__row") == F.col("__r")) & (F.col("pointer") == F.col("__p")), "left")
            pairs = F.transform(F.array_sort(F.transform("inner", lambda c: F.struct(c["key"].alias("key"), c["text"].alias("text")))), lambda c: F.concat(_quoted(c["key"], form), F.lit(":"), c["text"]))
            items = F.transform(F.array_sort(F.transform("inner", lambda c: F.struct(c["pos"].alias("pos"), c["text"].alias("text")))), lambda c: c["text"])
            whole = F.when(F.col("kind") == "object", F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
            own = own.withColumn("text", F.when(F.col("inner").isNotNull(), whole).otherwise(text))
        below = own.select("__row", "parent", "key", "pos", "text")
    made = below.select("__row", F.col("text").alias(name))
    return numbered.join(made, "__row", "left").drop("__row").select(*records.columns, name)


def digest(text: Column, form: str) -> Column:
    """(form, sha256) of a canonical text: digests of two forms are told apart by their first field."""
    return F.when(text.isNotNull(), F.struct(F.lit(form).alias("form"), F.sha2(text, 256).alias("sha256")))


def _scalar(v: Column, kind: Column, form: str) -> Column:
    number = _rounded(v) if form == ROUNDED else _exact(v)
    return (
        F.when(kind == "string", _quoted(F.variant_get(v, "$", "string"), form)).when(kind == "number", number).when(kind == "boolean", F.variant_get(v, "$", "boolean").cast("string"))
        .when(kind == "null", "null").when(kind == "object", "{}").otherwise("[]")
    )


def _quoted(s: Column, form: str) -> Column:
    """A JSON string; most have nothing to escape, and are only put in quotes."""
    odd = s.rlike(r"[^\x20-\x7e]|[\"&'+<>`\\]") if form == ROUNDED else s.rlike(r"[\x00-\x1f\"\\]")
    short = F.create_map(*(F.lit(x) for kv in SHORT.items() for x in kv))

    def escape(c: Column) -> Column:
        code = F.ascii(c)
        four = lambda n: F.concat(F.lit("\\u"), F.lpad(F.hex(n), 4, "0"))
        if form == EXACT:
            return F.coalesce(short[c], F.when(c == '"', '\\"').when(code < 32, F.lower(four(code))).otherwise(c))
        pair = F.concat(four(F.lit(0xD800) + F.shiftright(code - 0x10000, 10)), four(F.lit(0xDC00) + (code - 0x10000).bitwiseAND(1023)))
        return F.coalesce(short[c], F.when(code > 0xFFFF, pair).when((code < 32) | (code > 126) | c.isin(*ESCAPED), four(code)).otherwise(c))

    return F.concat(F.lit('"'), F.when(odd, F.array_join(F.transform(F.split(s, ""), escape), "")).otherwise(s), F.lit('"'))


def _double(v: Column) -> Column:
    x = F.try_variant_get(v, "$", "double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit("a number is not finite")).cast("double")).otherwise(x)


def _whole(v: Column) -> Column:
    """The text of a number written without a fraction, else null."""
    s = F.schema_of_variant(v)
    return F.when(s.isin("BIGINT", "LONG") | s.rlike(r"^DECIMAL\((19|2\d|3\d),0\)$"), F.variant_get(v, "$", "string"))


def _trimmed(x: Column, decimals: int) -> Column:
    return F.rtrim(F.rtrim(x.cast(f"decimal(38,{decimals})").cast("string"), F.lit("0")), F.lit("."))


def _scientific(x: Column, mark: str) -> Column:
    """The shortest digits with an exponent of two digits at least and a sign: 1.5E+17, 1E-06."""
    s = x.cast("string")
    head, power = F.regexp_replace(F.substring_index(s, "E", 1), r"\.0$", ""), F.substring_index(s, "E", -1).cast("int")
    return F.concat(head, F.lit(mark), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))


def _rounded(v: Column) -> Column:
    x = _double(v)
    near = F.when(F.abs(x) < 1e15, F.round(x, 6)).otherwise(x)
    tiny = F.round(near * 1e6).cast("long")  # below 0.0001 the millionths are written with an exponent
    few = F.when(F.abs(tiny) < 10, F.concat(tiny.cast("string"), F.lit("E-06"))).otherwise(F.concat(_trimmed(tiny / 10, 1), F.lit("E-05")))
    text = F.when(near == 0, "0").when(F.abs(near) < 1e-4, few).when(F.abs(near) < 1e15, _trimmed(near, 6)).otherwise(_scientific(near, "E"))
    return F.when(F.schema_of_variant(v).isin("BIGINT", "LONG"), F.variant_get(v, "$", "string")).otherwise(text)


def _exact(v: Column) -> Column:
    x = _double(v)
    plain = _trimmed(x, 20)
    text = F.when(x == 0, F.when(x.cast("string").startswith("-"), "-0.0").otherwise("0.0")).when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16), F.when(plain.contains("."), plain).otherwise(F.concat(plain, F.lit(".0")))).otherwise(_scientific(x, "e"))
    return F.coalesce(_whole(v), text)
