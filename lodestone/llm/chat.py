"""Chat formatting with linked tool calls.

A message is read as tool traffic if its text is a JSON object: `tool_calls` (a list of id and name and arguments, or of
id and function) beside `content` in a message of any role; `tool_call_id` beside `content` for a result; `tools` (name
and parameters, a JSON schema) for declarations. All other texts are plain content.

Calls and results are hash-joined by conversation and identifier, and arguments are validated against the schema that
the conversation declares for the tool. A result depends on the message of its call, which may be a result itself; so
links form chains. The topological order keeps turns where it can: along its chain a message has the largest turn so
far, and, within that turn, one step more than the message before it. Both come from pointer doubling over the linked
messages, in as many rounds as the logarithm of the longest chain, whatever the size of a conversation. Links that
close a cycle (calls that wait for each other's results) are cut. Each message is serialised as canonical JSON (sorted
keys, no blanks, no escapes but needed ones) in a row of its own, so one conversation may hold any share of all rows.
Plain messages take no part in any exchange.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, with_row

_TYPES = {
    "object": lambda x: isinstance(x, dict),
    "array": lambda x: isinstance(x, list),
    "string": lambda x: isinstance(x, str),
    "boolean": lambda x: isinstance(x, bool),
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer(),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
    "null": lambda x: x is None,
}


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


#: Lists and objects in each other that a JSON text may have.
DEPTH = 100


def _finite(number: str) -> float:
    x = float(number)
    if not math.isfinite(x):
        raise ValueError(f"{number} is too large")
    return x


def _deep(value: Any) -> bool:
    level = [value]
    for _ in range(DEPTH):
        level = [y for x in level if isinstance(x, (list, dict)) for y in (x.values() if isinstance(x, dict) else x)]
        if not level:
            return False
    return any(isinstance(x, (list, dict)) for x in level)


def parsed(text: str | None) -> Any:
    """The value of a JSON text. None if it is none, or holds a number that isn't finite as a double, a lone surrogate
    (no UTF-8 has it), or more than DEPTH lists and objects in each other: such a text is plain content."""
    try:
        value = json.loads(text, parse_constant=_finite, parse_float=_finite) if text else None
        if text and text.count("[") + text.count("{") > DEPTH and _deep(value):
            return None
        if text and "\\u" in text:
            canonical(value).encode()
        return value
    except (ValueError, RecursionError):
        return None


def errors(value: Any, schema: Any, at: str = "$") -> list[str]:
    """What is wrong with a value, for a schema of type, enum, const, required, properties, additionalProperties,
    items, minimum, maximum, minLength, maxLength, minItems, maxItems. Other keywords are ignored."""
    if schema is False:
        return [f"{at}: not allowed"]
    if not isinstance(schema, dict):
        return []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds if isinstance(kinds, list) else []
    if kinds and not any(_TYPES.get(k, lambda _: False)(value) for k in kinds if isinstance(k, str)):
        return [f"{at}: not {' or '.join(map(str, kinds))}"]
    out = []
    if isinstance(schema.get("enum"), list) and not any(type(x) is type(value) and x == value for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if "const" in schema and schema["const"] != value:
        out.append(f"{at}: not const")
    for low, high, size in (("minimum", "maximum", value if _TYPES["number"](value) else None), ("minLength", "maxLength", len(value) if isinstance(value, str) else None), ("minItems", "maxItems", len(value) if isinstance(value, list) else None)):
        if size is not None and _TYPES["number"](schema.get(low)) and size < schema[low]:
            out.append(f"{at}: under {low}")
        if size is not None and _TYPES["number"](schema.get(high)) and size > schema[high]:
            out.append(f"{at}: over {high}")
    if isinstance(value, dict):
        known = schema.get("properties") if isinstance(schema.get("properties"), dict) else {}
        required = schema.get("required") if isinstance(schema.get("required"), list) else []
        out += [f"{at}.{k}: missing" for k in required if isinstance(k, str) and k not in value]
        for k in sorted(value):
            out += errors(value[k], known.get(k, schema.get("additionalProperties")), f"{at}.{k}")
    if isinstance(value, list):
        for k, x in enumerate(value):
            out += errors(x, schema.get("items"), f"{at}[{k}]")
    return out


def _call(x: Any) -> dict[str, str | None]:
    x = x if isinstance(x, dict) else {}
    f = x["function"] if isinstance(x.get("function"), dict) else x
    arguments = f.get("arguments")
    if isinstance(arguments, str):
        arguments = parsed(arguments) if parsed(arguments) is not None else arguments
    text = lambda v: v if isinstance(v, str) or v is None else canonical(v)
    return {"id": text(x.get("id")), "name": text(f.get("name")), "arguments": canonical(arguments)}


def read(role: str | None, text: str | None) -> dict[str, Any]:
    """content, calls, result (the identifier it answers) and tools (name, schema) of a message."""
    out: dict[str, Any] = {"content": text, "calls": [], "result": None, "tools": []}
    body = parsed(text) if text and text.lstrip()[:1] == "{" else None
    if not isinstance(body, dict) or not {"tool_calls", "tool_call_id", "tools"} & body.keys():
        return out
    content = body.get("content")
    out["content"] = content if content is None or isinstance(content, str) else canonical(content)
    if isinstance(body.get("tool_calls"), list):
        out["calls"] = [_call(x) for x in body["tool_calls"]]
    if isinstance(body.get("tool_call_id"), str):
        out["result"] = body["tool_call_id"]
    for x in body["tools"] if isinstance(body.get("tools"), list) else ():
        f = x.get("function", x) if isinstance(x, dict) else {}
        if isinstance(f, dict) and isinstance(f.get("name"), str):
            out["tools"].append({"name": f["name"], "schema": canonical(f.get("parameters"))})
    return out


def _message(role: str | None, m: dict[str, Any], calls: list[dict[str, Any]], answers: bool | None) -> str:
    body: dict[str, Any] = {"role": role, "content": m["content"]}
    if m["tools"]:
        body["tools"] = [{"name": x["name"], "parameters": json.loads(x["schema"])} for x in m["tools"]]
    if m["calls"]:
        body["tool_calls"] = [{"id": c["id"], "name": c["name"], "arguments": json.loads(c["arguments"]), "answered": c["answered"], "errors": c["errors"]} for c in calls]
    if m["result"] is not None:
        body["tool_call_id"] = m["result"]
        body["linked"] = answers
    return canonical(body)


_OUT = "order_turn {turn}, order_step int, role string, message string, n_calls int, n_answered int, n_invalid int, linked boolean"
_LOOKS = r"^\s*\{"
#: Copies of a conversation's schemas, over which its calls are dealt.
_SALTS = 16


def _after(first: Column, second: Column) -> Column:
    """The way of two pieces of a chain, one after the other: largest turn (null is the least), messages since it
    was first reached, messages. This is associative."""
    stays = second["turn"].isNull() | (first["turn"] >= second["turn"])
    return F.when(F.coalesce(stays, F.lit(False)), F.struct(first["turn"].alias("turn"), (first["since"] + second["n"]).alias("since"), (first["n"] + second["n"]).alias("n"))).otherwise(
        F.struct(second["turn"].alias("turn"), second["since"].alias("since"), (first["n"] + second["n"]).alias("n"))
    )


def places(links: DataFrame, turn: str = "turn") -> DataFrame:
    """(file, row, order_turn, order_step) of the messages of links that are results and in no cycle.

    links: file, row and turn of a result, of its call's message call_file, call_row and call_turn; one row a result.
    A message on a cycle loses its link, those that hang on it keep theirs. Each round joins every pointer with the
    pointer of its target, which halves what is left of each chain."""
    one = lambda t: F.struct(F.col(t).alias("turn"), F.lit(0).cast("long").alias("since"), F.lit(1).cast("long").alias("n"))
    links = materialise(links.select("file", "row", F.col(turn).alias("turn"), "call_file", "call_row", "call_turn"))
    n = links.count()
    own = links.select("file", "row", "turn", "call_turn", "call_file", "call_row")
    if not n:
        return own.select("file", "row", F.col("turn").alias("order_turn"), F.lit(0).alias("order_step"))

    def doubled(state: DataFrame, rounds: int | None) -> DataFrame:
        """Pointers over 2 ** rounds links, or all; null past a start, whose piece of the way is then in way."""
        done = 0
        while (rounds is None and not state.where("to_file is not null").isEmpty()) or (rounds is not None and done < rounds):
            target = state.select(F.col("file").alias("to_file"), F.col("row").alias("to_row"), F.col("to_file").alias("next_file"), F.col("to_row").alias("next_row"), F.col("way").alias("before"))
            joined = state.join(target, ["to_file", "to_row"], "left")
            way = F.when(F.col("before").isNull(), F.col("way")).otherwise(_after(F.col("before"), F.col("way")))
            state = materialise(joined.select("file", "row", F.col("next_file").alias("to_file"), F.col("next_row").alias("to_row"), way.alias("way")))
            done += 1
        return state

    # Which messages are on a cycle: after as many steps as there are links, all pointers that still lead on lead there.
    linked = own.select(F.col("file").alias("call_file"), F.col("row").alias("call_row"), F.lit(True).alias("inner"))
    state = own.join(linked, ["call_file", "call_row"], "left")
    start = F.col("inner").isNull()  # its call is in a message that is no linked result itself
    state = state.select("file", "row", F.when(~start, F.col("call_file")).alias("to_file"), F.when(~start, F.col("call_row")).alias("to_row"), one("turn").alias("way"))
    ends = doubled(state, n.bit_length()) if not state.where("to_file is not null").isEmpty() else state
    cycle = materialise(ends.where("to_file is not null").select(F.col("to_file").alias("file"), F.col("to_row").alias("row")).distinct())
    kept = own.join(cycle, ["file", "row"], "left_anti")
    # The first of a chain is no result: its way is its own turn.
    inner = kept.select(F.col("file").alias("call_file"), F.col("row").alias("call_row"), F.lit(True).alias("inner"))
    state = kept.join(inner, ["call_file", "call_row"], "left")
    start = F.col("inner").isNull()
    way = F.when(start, _after(one("call_turn"), one("turn"))).otherwise(one("turn"))
    state = doubled(materialise(state.select("file", "row", F.when(~start, F.col("call_file")).alias("to_file"), F.when(~start, F.col("call_row")).alias("to_row"), way.alias("way"))), None)
    return state.select("file", "row", F.col("way.turn").alias("order_turn"), F.col("way.since").cast("int").alias("order_step"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row for each row of conversations (conv_id, turn, role, text; others are ignored): conv_id, turn,
    order_turn and order_step (the topological order within conv_id; then turn, then the row's place in the table), role,
    message (canonical JSON), n_calls, n_answered and n_invalid (calls with a result, and with arguments against their
    schema or without a declared one), linked (for results: whether their call is there; null for other messages).

    A call whose identifier is used before in its conversation, and a result that is not the first of its call or that
    its own call waits for, are not linked: of several the least turn is first, then the row's place. Null or empty
    texts are null or empty content; null conversations or identifiers never link; a null turn is the least. Texts of
    any length are read whole, repeated rows stay, and no rows give no rows.
    """
    placed = with_row(conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")))
    kinds = dict(placed.dtypes)
    tool = F.coalesce(F.col("text").rlike(_LOOKS), F.lit(False))
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, " + _OUT.format(turn=kinds["turn"])
    names = ["conv_id", "turn", "order_turn", "order_step", "role", "message", "n_calls", "n_answered", "n_invalid", "linked"]

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, turn, role, text = (batch.column(k) for k in range(4))
            n = len(batch)
            zero = pa.array([0] * n, pa.int32())
            lines = [canonical({"role": r, "content": t}) for r, t in zip(role.to_pylist(), text.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([conv, turn, turn, zero, role, pa.array(lines, pa.string()), zero, zero, zero, pa.nulls(n, pa.bool_())], names=names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string())])
        for batch in batches:
            found = [read(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            tools = pa.array([m["tools"] for m in found], pa.list_(pa.struct([("name", pa.string()), ("schema", pa.string())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *batch.columns[4:], pa.array([m["content"] for m in found], pa.string()), pa.array([m["calls"] for m in found], pa.list_(call)), pa.array([m["result"] for m in found], pa.string()), tools], names=["conv_id", "turn", "role", "_file", "_row", "content", "calls", "result", "tools"])

    out = placed.where(~tool).select("conv_id", "turn", "role", "text").mapInArrow(plain, schema)
    messages = placed.where(tool).select("conv_id", "turn", "role", "text", "_file", "_row").mapInArrow(
        parse, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, _file long, _row long, content string, calls array<struct<id:string,name:string,arguments:string>>, result string, tools array<struct<name:string,schema:string>>"
    )
    place = F.struct("turn", "_file", "_row")
    calls = messages.select("conv_id", "turn", "_file", "_row", F.posexplode("calls").alias("n", "call")).select("*", "call.*").drop("call")
    first_call = calls.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "_file", "_row", "n")).alias("c"))
    first_result = messages.where("result is not null").groupBy("conv_id", F.col("result").alias("id")).agg(F.min(place).alias("r"))
    links = first_call.join(first_result, ["conv_id", "id"])  # nulls never match
    links = materialise(links.select(F.col("r._file").alias("file"), F.col("r._row").alias("row"), F.col("r.turn").alias("turn"), F.col("c._file").alias("call_file"), F.col("c._row").alias("call_row"), F.col("c.turn").alias("call_turn"), F.col("c.n").alias("n")))
    answers = places(links)
    declared = messages.select("conv_id", F.explode("tools").alias("t"), place.alias("p")).groupBy("conv_id", F.col("t.name").alias("name")).agg(F.min_by("t.schema", "p").alias("schema"))

    answered = links.join(answers, ["file", "row"], "left_semi").select(F.col("call_file").alias("_file"), F.col("call_row").alias("_row"), "n", F.lit(True).alias("answered"))
    # A conversation may hold most calls: each of its schemas has copies for them.
    salted = declared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    dealt = calls.withColumn("salt", F.pmod(F.xxhash64("_file", "_row"), F.lit(_SALTS)).cast("int"))
    checked = dealt.join(salted, ["conv_id", "name", "salt"], "left").join(answered, ["_file", "_row", "n"], "left")
    by_message = checked.groupBy("_file", "_row").agg(F.array_sort(F.collect_list(F.struct("n", "id", "name", "arguments", F.coalesce("answered", F.lit(False)).alias("answered"), "schema"))).alias("checked"))
    answers = answers.select(F.col("file").alias("_file"), F.col("row").alias("_row"), "order_turn", "order_step", F.lit(True).alias("answers"))
    known = messages.drop("calls").join(by_message, ["_file", "_row"], "left").join(answers, ["_file", "_row"], "left")
    order = F.when(F.col("answers"), F.col("order_turn")).otherwise(F.col("turn"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lines, counts = batch.to_pylist(), [], []
            for x in rows:
                checks = []
                for c in x["checked"] or ():
                    wrong = ["$: no schema"] if c["schema"] is None else errors(json.loads(c["arguments"]), json.loads(c["schema"]))
                    checks.append(c | {"errors": wrong})
                m = {"content": x["content"], "tools": x["tools"], "calls": checks, "result": x["result"]}
                linked = None if x["result"] is None else bool(x["answers"])
                lines.append(_message(x["role"], m, checks, linked))
                counts.append((len(checks), sum(c["answered"] for c in checks), sum(bool(c["errors"]) for c in checks), linked))
            columns = list(zip(*counts, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("order_turn"), batch.column("order_step"), batch.column("role"), pa.array(lines, pa.string()), *[pa.array(c, pa.int32()) for c in columns[:3]], pa.array(columns[3], pa.bool_())], names=names)

    linked = known.select("conv_id", "turn", order.alias("order_turn"), F.coalesce("order_step", F.lit(0)).alias("order_step"), "role", "content", "result", "tools", "checked", "answers").mapInArrow(write, schema)
    return out.unionByName(linked)
