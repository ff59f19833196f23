"""Chat formatting with tool-call linking, in DataFrame functions alone.

Messages are ``(conversation, turn, kind, call_id, name, arguments, content)``; kind is ``call``, ``result`` or anything
else.  Calls and results meet in a hash join on conversation and call id.  A result is placed after its call even where its
turn says otherwise, so that (sort_turn, sort_phase, turn) is a topological order of the links.  Arguments are parsed and
checked against the tool's schema: types, required and further properties, listed values and items, at any depth.  The
message is written as canonical JSON: keys sorted, no white space, nulls left out.

No conversation is ever gathered: every output row comes from one message and its partner, so one conversation may hold
any share of the rows.  Messages that can't be linked don't take part in the join.

Defined results: nulls in ids link with nothing; of calls with one id in one conversation the one of the smallest turn
(then the smallest arguments text, then name) is linked, and the others are not, but copies of that one are; all
results of an id are linked to it; arguments that aren't JSON are invalid and written as a string, absent ones are
invalid and left out; a tool without a schema has no valid calls; texts of any length are written whole; repeated rows
stay repeated; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def type_ok(value: Column, kind: str) -> Column:
    """Whether a variant is of the named JSON type; whole numbers of any size and form are integers."""
    found = F.schema_of_variant(value)
    number = found.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    real = F.try_variant_get(value, "$", "double")
    return {
        "string": found == "STRING",
        "integer": (found == "BIGINT") | found.rlike(r"^DECIMAL\(\d+,0\)$") | (number & (real == F.floor(real))),
        "number": number,
        "boolean": found == "BOOLEAN",
        "null": found == "VOID",
        "array": found.startswith("ARRAY"),
        "object": found.startswith("OBJECT"),
    }[kind]


def satisfies(value: Column, schema: dict | str) -> Column:
    """Whether a variant satisfies a schema: a type's name, or a dict of ``type`` (a name or several), ``enum``,
    ``properties``, ``required``, ``additionalProperties`` and ``items``."""
    if isinstance(schema, str):
        schema = {"type": schema}
    ok = value.isNotNull()
    if kinds := schema.get("type"):
        one = [type_ok(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)]
        ok = ok & reduce(lambda a, b: a | b, one)
    if "enum" in schema:
        ok = ok & F.to_json(value).isin([json.dumps(x, separators=(",", ":"), sort_keys=True, ensure_ascii=False) for x in schema["enum"]])
    fields, required = schema.get("properties", {}), schema.get("required", ())
    more = schema.get("additionalProperties", True)
    if fields or required or more is not True:
        held = F.try_variant_get(value, "$", "map<string,variant>")
        for name in dict.fromkeys((*fields, *required)):
            inner = held[name]
            here = satisfies(inner, fields[name]) if name in fields else inner.isNotNull()
            ok = ok & (held.isNull() | (here if name in required else inner.isNull() | here))
        if more is not True:
            known = F.lit(list(fields)) if fields else F.array().cast("array<string>")
            other = F.filter(F.map_entries(held), lambda e: ~F.array_contains(known, e["key"]))
            ok = ok & (held.isNull() | (F.size(other) == 0 if more is False else F.forall(other, lambda e: satisfies(e["value"], more))))
    if "items" in schema:
        ok = ok & F.coalesce(F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: satisfies(x, schema["items"])), F.lit(True))
    return F.coalesce(ok, F.lit(False))


def arguments_ok(name: Column, parsed: Column, schemas: dict[str, dict]) -> Column:
    """Whether parsed arguments are an object that satisfies the schema of the tool ``name``; a missing schema is not satisfied."""
    out = F.lit(False)
    for tool, schema in schemas.items():
        out = F.when(name == tool, satisfies(parsed, {"type": "object"} | schema)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def quoted(text: Column) -> Column:
    """A JSON string, by way of a struct of one field."""
    held = F.to_json(F.struct(F.coalesce(text.cast("string"), F.lit("")).alias("v")))
    return held.substr(F.lit(6), F.length(held) - 6)


def link_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per message, with its link, place, verdict and canonical JSON."""
    m = messages.select("conversation", "turn", "kind", "call_id", "name", "arguments", "content")
    ids = F.col("conversation").isNotNull() & F.col("call_id").isNotNull()
    calls = m.where((F.col("kind") == "call") & ids)
    first = calls.groupBy("conversation", "call_id").agg(F.min(F.struct("turn", F.col("arguments").alias("args"), "name")).alias("first"))
    first = first.select(F.col("conversation").alias("c"), F.col("call_id").alias("i"), F.col("first.turn").alias("call_turn"), F.col("first.name").alias("call_name"), "first")
    answered = m.where((F.col("kind") == "result") & ids).groupBy("conversation", "call_id").agg(F.min("turn").alias("result_turn"))
    links = first.hint("shuffle_hash").join(answered.select(F.col("conversation").alias("c"), F.col("call_id").alias("i"), "result_turn"), ["c", "i"], "left")
    tool = F.coalesce(F.col("kind").isin("call", "result") & ids, F.lit(False))
    both = m.where(tool).join(links.hint("shuffle_hash"), (F.col("conversation") == F.col("c")) & (F.col("call_id") == F.col("i")), "left")
    both = both.unionByName(m.where(~tool), allowMissingColumns=True)

    is_call, is_result = F.coalesce(F.col("kind") == "call", F.lit(False)), F.coalesce(F.col("kind") == "result", F.lit(False))
    parsed = F.try_parse_json("arguments")
    chosen = F.col("first").eqNullSafe(F.struct("turn", F.col("arguments").alias("args"), "name"))
    linked = F.when(is_call, F.col("result_turn").isNotNull() & chosen).when(is_result, F.col("call_turn").isNotNull())
    rows = both.select(
        "conversation",
        "turn",
        "kind",
        "call_id",
        F.when(is_result, F.greatest("turn", "call_turn")).otherwise(F.col("turn")).alias("sort_turn"),
        F.when(is_result, 1).otherwise(0).alias("sort_phase"),
        linked.alias("linked"),
        F.when(is_call, arguments_ok(F.col("name"), parsed, schemas)).alias("valid"),
        F.when(is_result, F.col("call_name")).otherwise(F.col("name")).alias("name"),
        F.when(is_call & F.col("arguments").isNotNull(), F.coalesce(F.to_json(parsed), quoted(F.col("arguments")))).alias("canonical_arguments"),
        "content",
    )

    fields = [
        F.when(F.col("canonical_arguments").isNotNull(), F.concat(F.lit('"arguments":'), "canonical_arguments")),
        F.when(F.col("call_id").isNotNull(), F.concat(F.lit('"call_id":'), quoted(F.col("call_id")))),
        F.when(F.col("content").isNotNull(), F.concat(F.lit('"content":'), quoted(F.col("content")))),
        F.when(F.col("kind").isNotNull(), F.concat(F.lit('"kind":'), quoted(F.col("kind")))),
        F.when(F.col("name").isNotNull(), F.concat(F.lit('"name":'), quoted(F.col("name")))),
    ]
    message = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    return rows.select("conversation", "turn", "kind", "call_id", "sort_turn", "sort_phase", "linked", "valid", message.alias("message"))


def turns_as_calls(conversations: DataFrame) -> DataFrame:
    """A dialogue as tool calls: a user's turn asks the tool ``reply``, the assistant's next turn brings its result."""
    call, result = F.col("role") == "user", F.col("role") == "assistant"
    return conversations.select(
        F.col("conv_id").alias("conversation"),
        F.col("turn"),
        F.when(call, "call").when(result, "result").otherwise(F.col("role")).alias("kind"),
        F.when(call, F.concat(F.lit("t"), F.col("turn"))).when(result, F.concat(F.lit("t"), F.col("turn") - 1)).alias("call_id"),
        F.when(call, F.lit("reply")).alias("name"),
        F.when(call, F.to_json(F.struct(F.col("turn").alias("turn"), F.coalesce("text", F.lit("")).alias("prompt")))).alias("arguments"),
        F.when(~call, F.col("text")).when(call, F.lit(None).cast("string")).otherwise(F.col("text")).alias("content"),
    )


#: Schema of the tool that ``turns_as_calls`` speaks of.
REPLY_SCHEMA = {"reply": {"properties": {"prompt": "string", "turn": "integer"}, "required": ["prompt", "turn"]}}
