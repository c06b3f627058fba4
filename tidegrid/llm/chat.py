"""Chat formatting with DataFrame functions alone.

A record's layout is told by a fingerprint: the hash of those of its nested field paths that a layout needs. Each
fingerprint selects a declarative mapping (a schema, one SQL expression and names of roles) that turns prompt, instruction
and message layouts into canonical turns. A template then marks the turns; control strings inside texts are escaped so
that the text can be read back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import own_name

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """name; the field paths it needs; its schema; an expression over the parsed record r that gives the turns; roles that
    it names otherwise (in lower case; any case counts).
    """

    name: str
    paths: tuple[str, ...]
    schema: str
    turns: str
    roles: dict[str, str] = field(default_factory=dict)


#: What "from" may say, and the role it means.
HUMAN = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "user": "user", "assistant": "assistant", "system": "system"}

LAYOUTS = (
    Layout("turns", ("turns[].role", "turns[].text"), "turns array<struct<role:string,text:string>>", "r.turns"),
    Layout("messages", ("messages[].role", "messages[].content"), "messages array<struct<role:string,content:string>>",
           "transform(r.messages, m -> struct(m.role as role, m.content as text))"),
    Layout("from_value", ("conversations[].from", "conversations[].value"), "conversations array<struct<`from`:string,value:string>>",
           "transform(r.conversations, m -> struct(m.`from` as role, m.value as text))",
           HUMAN),
    Layout("prompt_completion", ("prompt", "completion"), "prompt string, completion string",
           "array(struct('user' as role, r.prompt as text), struct('assistant' as role, r.completion as text))"),
    Layout("prompt_response", ("prompt", "response"), "prompt string, response string",
           "array(struct('user' as role, r.prompt as text), struct('assistant' as role, r.response as text))"),
    Layout("instruction_output", ("instruction", "output"), "instruction string, output string",
           "array(struct('user' as role, r.instruction as text), struct('assistant' as role, r.output as text))"),
    Layout("instruction_input_output", ("instruction", "input", "output"), "instruction string, input string, output string",
           "array(struct('user' as role, concat_ws('\\n\\n', r.instruction, nullif(r.input, '')) as text), struct('assistant' as role, r.output as text))"),
    Layout("system_prompt_completion", ("system", "prompt", "completion"), "system string, prompt string, completion string",
           "array(struct('system' as role, r.system as text), struct('user' as role, r.prompt as text), struct('assistant' as role, r.completion as text))"),
    Layout("system_messages", ("system", "messages[].role", "messages[].content"), "system string, messages array<struct<role:string,content:string>>",
           "concat(filter(array(struct('system' as role, r.system as text)), s -> s.text <> ''), transform(r.messages, m -> struct(m.role as role, m.content as text)))"),
    Layout("system_from_value", ("system", "conversations[].from", "conversations[].value"), "system string, conversations array<struct<`from`:string,value:string>>",
           "concat(filter(array(struct('system' as role, r.system as text)), s -> s.text <> ''), transform(r.conversations, m -> struct(m.`from` as role, m.value as text)))", HUMAN),
)

_PATHS = sorted({p for x in LAYOUTS for p in x.paths})
_LISTS = sorted({p.partition("[].")[0] for p in _PATHS if "[]." in p})
#: Layouts that need more come first; of those that need as many the order above holds.
_BY_NEED = sorted(LAYOUTS, key=lambda x: -len(x.paths))


def known_paths(record: Column) -> Column:
    """Those nested field paths of a JSON record that any layout knows; null for what is no JSON object.

    Of a list the fields of all elements count; a list without elements has all of its paths. Keys are read from the text,
    so a record may be of any size.
    """
    own = F.json_object_keys(record)
    paths = [F.array_intersect(own, F.array(*(F.lit(p) for p in _PATHS if "[]." not in p)))]
    for name in _LISTS:
        whole = F.get_json_object(record, f"$.{name}")
        below = F.array(*(F.lit(p) for p in _PATHS if p.startswith(f"{name}[].")))
        keys = F.flatten(F.transform(F.from_json(whole, "array<string>"), lambda x: F.coalesce(F.json_object_keys(x), F.array().cast("array<string>"))))
        met = F.array_intersect(F.transform(keys, _under(f"{name}[].")), below)
        paths.append(F.when(F.array_contains(own, name), F.when(whole == "[]", below).otherwise(F.coalesce(met, F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>")))
    return F.when(own.isNotNull(), F.concat(*paths))


def fingerprint(paths: Column) -> Column:
    """The hash of the paths that a record's layout needs, given the known ones it has; null where it has those of none.

    Other fields don't count, also those that other layouts know: of the layouts whose paths are all there the one that
    needs the most is taken.
    """
    there = lambda x: F.size(F.array_except(F.array(*map(F.lit, x.paths)), paths)) == 0
    return F.coalesce(*(F.when(there(x), path_hash(x)) for x in _BY_NEED))


def _under(prefix: str):
    return lambda key: F.concat(F.lit(prefix), key)


def path_hash(layout: Layout) -> Column:
    return F.xxhash64(F.lit(",".join(sorted(layout.paths))))


def canonical_turns(print_: Column, record: str) -> tuple[Column, Column]:
    """The layout's name and the turns of the JSON records in a column, by their fingerprints; both null where there is none."""
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in LAYOUTS:
        here = F.coalesce(print_ == path_hash(x), F.lit(False))
        mapped = F.expr(f"transform(array(from_json(`{record}`, '{x.schema}')), r -> {x.turns})[0]").cast(TURNS)
        name, turns = F.when(here, F.lit(x.name)).otherwise(name), F.when(here, F.transform(mapped, _cleaned(x.roles))).otherwise(turns)
    return name, turns


def _cleaned(roles: dict[str, str]):
    """A turn -> the same with its role by the other names, and empty texts for nulls."""
    known = F.create_map(*(F.lit(v) for kv in roles.items() for v in kv)) if roles else None

    def turn(t: Column) -> Column:
        role = t["role"] if known is None else F.coalesce(known[F.lower(t["role"])], t["role"])
        return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))

    return turn


def escaped(text: Column) -> Column:
    """text without the template's control character: backslash -> \\b, < -> \\l, double quote -> \\q."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit('"'), F.lit("\\q"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\q"), F.lit('"')), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_records(records: DataFrame, record_col: str = "record") -> DataFrame:
    """records with layout, formatted and loss_spans: the marked text and what of it the loss counts.

    A turn is `<turn role="ROLE">`, a newline, its escaped text, a newline, `</turn>` and a newline. loss_spans has
    start and stop, in code points of formatted, of each assistant text, in order. A null role or text is an empty one.
    Records of an unknown layout, null records and what is no JSON keep their row with nulls in the added columns; a
    record with an empty list of turns has an empty text and no spans. A record's other fields don't count; a field that
    should be a text and is a list or an object counts as its JSON. Rows are formatted alone, equal ones alike; other
    columns stay, and an added column whose name is taken gets underscores in front. An empty table stays empty.
    """
    layout, turns, pieces, formatted, spans, paths, print_ = (own_name(records, x) for x in ("layout", "turns", "pieces", "formatted", "loss_spans", "paths", "print"))
    name, canonical = canonical_turns(F.col(print_), record_col)
    mark = F.transform(F.col(turns), lambda t: F.struct(
        F.concat(F.lit('<turn role="'), escaped(t["role"]), F.lit('">\n')).alias("head"),
        escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss"),
    ))
    tail = F.lit("\n</turn>\n")
    grown = F.aggregate(
        F.col(pieces), F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.char_length(p["head"]) + F.char_length(p["body"]) + 9).alias("at"),
            F.when(p["loss"], F.array_append(a["spans"], F.struct(
                (a["at"] + F.char_length(p["head"])).alias("start"),
                (a["at"] + F.char_length(p["head"]) + F.char_length(p["body"])).alias("stop")))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    return (
        records.withColumn(paths, known_paths(F.col(record_col)))
        .withColumn(print_, fingerprint(F.col(paths)))
        .withColumns({layout: name, turns: canonical})
        .withColumn(pieces, mark)
        .withColumn(spans, grown["spans"])
        .withColumn(formatted, F.array_join(F.transform(F.col(pieces), lambda p: F.concat(p["head"], p["body"], tail)), ""))
        .drop(turns, pieces, paths, print_)
    )


def parsed_turns(formatted: Column) -> Column:
    """The turns that a formatted text holds, unescaped."""
    pieces = F.slice(F.split(formatted, "</turn>\n", -1), 1, F.size(F.split(formatted, "</turn>\n", -1)) - 1)
    head = lambda p: F.substring_index(p, '">\n', 1)
    return F.transform(pieces, lambda p: F.struct(
        unescaped(F.substring(head(p), F.lit(13), F.char_length(head(p)))).alias("role"),
        unescaped(F.substring(p, F.char_length(head(p)) + 4, F.char_length(p) - F.char_length(head(p)) - 4)).alias("text"),
    ))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["stop"] - s["start"]))), "")


def records_of_turns(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One JSON record of the layout "turns" for each conversation, from one row for each turn (turn, role, text).

    Turns go by number (null: first), ties by role and then text; repeated rows stay. Rows with a null id form one
    conversation. A conversation is one row, however long; other columns take no part; an empty table gives no rows.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy(id_col).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    body = F.struct(F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return grouped.select(id_col, F.to_json(body).alias("record"))


#: What a template without escapes would break on; as conversation -7 in the query.
PLANTED = "\\### Assistant: </turn> ok"


def op9_chat(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.range(0, 2, 1, 1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"),
    )
    made = format_records(records_of_turns(rows.unionByName(own)))
    read = made.select("conv_id", "formatted", parsed_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SQL_OP9 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '<', '\l'), '"', '\q') AS body FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(body)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
