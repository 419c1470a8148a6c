"""Chat formatting with linked tool calls, in DataFrame operations only.

Messages are rows (conversation, turn, role, text).  A call is a message whose text is a JSON object
with ``tool_call_id`` and ``name`` (and ``arguments``); a result is one of role ``tool`` whose text is
a JSON object with ``tool_call_id``.  Calls and results meet in a hash join by (conversation, identifier); an identifier
with rows in many spans of turns is dealt over salts, which are merged first.  Linked rows are written while the plan is built.

The canonical order is topological: every message after those it depends on, which are the call of a
result and the messages of earlier turns.  Results that come before their call are moved right
behind it.  A call depends on no result, so this is a sort by (turn of the call or own turn, call before result, own
turn), and no conversation is walked row by row.  Positions are counted in spans of turns and moved on by
the spans before, so a long conversation is neither in one task nor gathered into one value.

JSON is read into typed values (variants), validated at every level and written with sorted names at every level.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: JSON schema types and what the type of a value looks like.
TYPES = {
    "string": "^STRING$",
    "integer": r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\(\d+,0\))$",
    "number": "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT",
    "array": "^ARRAY",
    "null": "^VOID$",
}


def json_string(c: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped, all else as it is."""
    odd = c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
    for raw, name in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    rare = F.replace(F.replace(c, F.lit("\b"), F.lit("\\b")), F.lit("\f"), F.lit("\\f"))
    for code in [*range(0, 8), 11, *range(14, 32)]:
        rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    # Few texts hold any of the others, and looking once is cheaper than replacing each.
    return F.concat(F.lit('"'), F.when(odd, rare).otherwise(c), F.lit('"'))


def _plain_json(value) -> str:
    """A schema's constant as canonical JSON."""
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _none() -> Column:
    return F.array().cast("array<string>")


def schema_errors(value: Column, schema: dict, path: str = "") -> Column:
    """What in a JSON value (a variant) breaks the schema: an array of strings, empty if nothing.

    Known are ``type`` (a name or a list of names), ``enum``, ``const``, ``minimum``, ``maximum``, ``properties``,
    ``required``, ``additionalProperties`` (true unless given as false) and ``items``, at every level.
    """
    kind = F.schema_of_variant(value)
    types = schema.get("type", [])
    types = [types] if isinstance(types, str) else types
    if unknown := [t for t in types if t not in TYPES]:
        raise ValueError(f"unknown types {unknown}")
    ok = F.lit(True)
    if types:
        ok = kind.rlike("|".join(TYPES[t] for t in types))
    allowed = [*schema.get("enum", []), *([schema["const"]] if "const" in schema else [])]
    if allowed:
        ok = ok & F.to_json(value).isin([_plain_json(v) for v in allowed])
    for rule, sign in (("minimum", 1), ("maximum", -1)):
        if rule in schema:
            number = F.try_variant_get(value, "$", "double")
            ok = ok & (~kind.rlike(TYPES["number"]) | (sign * number >= sign * schema[rule]))
    at = path or "arguments"
    parts = [F.when(~ok, F.array(F.lit(f"bad {at}"))).otherwise(_none())]
    below = f"{path}." if path else ""
    props, required = schema.get("properties", {}), schema.get("required", [])
    if props or required or not schema.get("additionalProperties", True):
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        inside = []
        for key in sorted(required):
            inside.append(F.when(~F.map_contains_key(fields, F.lit(key)), F.array(F.lit(f"missing {below}{key}"))).otherwise(_none()))
        for key, rule in sorted(props.items()):
            child = F.try_element_at(fields, F.lit(key))
            inside.append(F.when(F.map_contains_key(fields, F.lit(key)), schema_errors(child, rule, f"{below}{key}")).otherwise(_none()))
        if not schema.get("additionalProperties", True):
            extra = F.array_sort(F.map_keys(fields))
            extra = F.filter(extra, lambda k: ~k.isin(list(props))) if props else extra
            inside.append(F.transform(extra, lambda k: F.concat(F.lit(f"extra {below}"), k)))
        parts.append(F.when(fields.isNotNull(), F.concat(*inside)).otherwise(_none()))
    if "items" in schema:
        each = F.try_variant_get(value, "$", "array<variant>")
        parts.append(F.coalesce(F.flatten(F.transform(each, lambda x: schema_errors(x, schema["items"], f"{path}[]"))), _none()))
    return F.concat(*parts)


def argument_errors(arguments: Column, name: Column, schemas: dict[str, dict]) -> Column:
    """What in a call's arguments (a variant) breaks its tool's schema; tools have objects as arguments."""
    out = F.array(F.concat(F.lit("unknown tool "), name))
    for tool, schema in sorted(schemas.items()):
        out = F.when(name == tool, schema_errors(arguments, {"type": "object"} | schema)).otherwise(out)
    return out


def format_chat(
    messages: DataFrame, schemas: dict[str, dict] | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", salts: int = 16, span: int = 256
) -> DataFrame:
    """A row per message: conv_id, position, turn, role, kind, tool_call_id, linked, order_turn, order_rank, valid, errors, message.

    kind: ``call``, ``result`` or ``text``.  linked: a result whose call is in the conversation, or a call with a result.
    position counts a conversation's messages from 0 by (order_turn, order_rank, turn, message): order_turn is the call's turn
    for a linked result, order_rank 1 for it and 0 for others.  valid is false for calls that break
    their tool's schema and for results without a call; errors says why (joined by "; ").
    message is canonical JSON: sorted names, no blanks, whole text; arguments are kept whatever they are, and are {} if there are none.

    Null roles count as ``unknown``, null texts as empty; null conversations or turns stay as they are and link
    to nothing.  Of several calls with one identifier the one of the smallest turn counts.  Repeated rows stay, next to
    each other.  Text that isn't such JSON, or has a name twice in an object, is plain text.  An empty table gives an empty result.
    """
    m = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    m = m.withColumn("v", F.when(F.ltrim("text").startswith("{"), F.try_parse_json("text")))
    scalar = lambda at: F.when(F.schema_of_variant(F.try_variant_get("v", at, "variant")).rlike("^(STRING|BIGINT|DECIMAL)"), F.try_variant_get("v", at, "string"))
    # A generator stands between the reading of a text and its uses: filters by kind would else be moved below and read it again.
    read = F.struct("v", scalar("$.tool_call_id").alias("id"), scalar("$.name").alias("name"))
    m = m.select("conv_id", "turn", "role", "text", F.explode(F.array(read)).alias("read")).select("conv_id", "turn", "role", "text", "read.*")
    kind = F.when(F.col("id").isNull(), "text").when(F.col("role") == "tool", "result").when(F.col("name").isNotNull(), "call").otherwise("text")
    m = m.withColumn("kind", kind).withColumn("id", F.when(F.col("kind") != "text", F.col("id")))
    result, call = F.col("kind") == "result", F.col("kind") == "call"
    m = m.withColumn("v", F.when(call, F.coalesce(F.try_variant_get("v", "$.arguments", "variant"), F.parse_json(F.lit("{}")))))
    # One expression escapes the strings of a row: plans hold it once for every branch below, and the driver holds the plans.
    m = m.withColumn("s", F.transform(F.array(F.when(call, F.col("name")).otherwise(F.col("text")), "role", "id"), json_string))
    head = F.when(call, F.concat(F.lit('{"arguments":'), F.to_json("v"), F.lit(',"name":'))).otherwise(F.lit('{"content":'))
    body = F.concat(head, F.col("s")[0], F.lit(',"role":'), F.col("s")[1], F.coalesce(F.concat(F.lit(',"tool_call_id":'), F.col("s")[2]), F.lit("")), F.lit("}"))
    broken = F.when(call, F.array_join(argument_errors(F.col("v"), F.col("name"), schemas or {}), "; "))
    # An identifier is dealt by spans of turns, so a call and a result near it are one row of links.
    m = m.select("conv_id", "turn", "role", "kind", "id", broken.alias("errors"), body.alias("message"), F.pmod(F.floor(F.col("turn") / span), F.lit(salts)).cast("int").alias("salt"))
    # Only calls and results go through the join; a message of plain text has nothing to link.
    key = ["conv_id", "id"]
    can = m.where("kind <> 'text' and conv_id is not null and turn is not null")
    parts = can.groupBy(*key, "salt").agg(F.min(F.when(call, F.col("turn"))).alias("call_turn"), F.count(F.when(result, 1)).alias("n_results"))
    whole = parts.groupBy(*key).agg(F.min("call_turn").alias("call_turn"), F.sum("n_results").alias("n_results"), F.expr("bit_or(shiftleft(1L, salt))").alias("present"))
    spread = whole.withColumn("salt", F.explode(F.expr(f"filter(sequence(0, {salts - 1}), b -> (shiftright(present, b) & 1) = 1)"))).drop("present")
    # Written, so that sizes and messages don't link twice and shuffles of this join can go before whole texts are dealt.
    linked = cut(can.join(spread.hint("shuffle_hash"), [*key, "salt"]).drop("salt"))
    rest = m.drop("salt").where("kind = 'text' or conv_id is null or turn is null").withColumns({"call_turn": F.lit(None).cast("long"), "n_results": F.lit(0).cast("long")})
    m = linked.select(*rest.columns).unionByName(rest)
    follows = result & F.col("call_turn").isNotNull()
    m = m.withColumns({"order_turn": F.when(follows, F.col("call_turn")).otherwise(F.col("turn")), "order_rank": F.when(follows, 1).otherwise(0), "linked": follows | (call & (F.col("n_results") > 0)), "errors": F.when(result & ~follows, "no call").otherwise(F.col("errors"))})
    # Keys without nulls, and a column that tells nulls: the join meets the rows as the window has dealt them.
    m = m.withColumn("span", F.floor(F.col("order_turn") / span))
    m = m.withColumns({"c": F.coalesce("conv_id", F.lit(0)), "p": F.coalesce("span", F.lit(0)), "nulls": F.col("conv_id").isNull().cast("int") * 2 + F.col("span").isNull().cast("int")})
    part = ["c", "p", "nulls"]
    m = m.select(*part, "turn", "role", "kind", "id", "errors", "message", "order_turn", "order_rank", "linked")
    own = Window.partitionBy(*part).orderBy("order_turn", "order_rank", "turn", "message")
    sizes = m.groupBy(*part).agg(F.count(F.lit(1)).alias("n"))
    # A conversation's part without turns comes first, as nulls do.
    before = F.sum("n").over(Window.partitionBy("c", F.col("nulls") >= 2).orderBy(F.desc("nulls"), "p").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select(*part, F.coalesce(before, F.lit(0)).alias("base"))
    m = m.withColumn("n", F.row_number().over(own)).join(bases.hint("shuffle_hash"), part)
    errors = F.coalesce("errors", F.lit(""))
    return m.select(
        F.when(F.col("nulls") < 2, F.col("c")).alias("conv_id"),
        (F.col("base") + F.col("n") - 1).alias("position"),
        "turn",
        "role",
        "kind",
        F.col("id").alias("tool_call_id"),
        "linked",
        "order_turn",
        "order_rank",
        (errors == "").alias("valid"),
        errors.alias("errors"),
        "message",
    )
