import json
import random

from lodestone.llm import chat


def rows(spark, data):
    return [tuple(r) for r in chat.format_chats(spark.createDataFrame(data, "conv_id long, turn long, role string, text string, result string")).orderBy("conv_id", "order_turn", "order_step", "turn", "message").collect()]


TOOLS = json.dumps({"tools": [{"name": "f", "parameters": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}]})


def test_calls_results_order_and_schemas(spark):
    calls = json.dumps({"content": "c", "tool_calls": [{"id": "a", "function": {"name": "f", "arguments": '{"x": 1}'}}, {"id": "b", "name": "f", "arguments": {"x": "q", "y": 1}}, {"id": "a", "name": "g", "arguments": {}}]})
    got = rows(spark, [(1, 0, "system", TOOLS, ""), (1, 3, "assistant", calls, ""), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"b": 1, "a": 2}}), ""), (1, 5, "tool", json.dumps({"tool_call_id": "a", "content": "again"}), ""), (2, 0, "tool", json.dumps({"tool_call_id": "a"}), "")])
    assert [r[1] for r in got if r[0] == 1] == [0, 3, 2, 5]
    assert [r[2:4] for r in got if r[0] == 1] == [(0, 0), (3, 0), (3, 1), (5, 0)]
    by = {(r[0], r[1]): r for r in got}
    assert by[1, 3][6:9] == (3, 1, 2)
    assert [by[k][9] for k in ((1, 2), (1, 5), (2, 0))] == [True, False, False]
    assert by[1, 2][5] == '{"content":"{\\"a\\":2,\\"b\\":1}","linked":true,"role":"tool","tool_call_id":"a"}'
    assert json.loads(by[1, 3][5])["tool_calls"][1]["errors"] == ["$.x: not integer", "$.y: not allowed"]


def test_awkward_rows(spark):
    data = [(None, None, None, None, None), (1, 0, "user", "", None), (1, 0, "user", "", None), (1, 1, "user", "{oops", None), (1, 2, "user", '{"a": 1}', None), (None, 1, "tool", json.dumps({"tool_call_id": "a"}), None), (None, 0, "assistant", json.dumps({"tool_calls": [{"id": "a"}, 7, None]}), None), (3, 1, "user", "x" * 200_000, None), (3, 2, "user", '{"tool_calls": NaN}', None)]
    got = rows(spark, data)
    assert len(got) == len(data)
    assert all(json.dumps(json.loads(r[5]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r[5] for r in got)
    assert [r[9] for r in got if r[0] is None and r[9] is not None] == [False]
    assert rows(spark, []) == []


def test_plain_messages_are_rows_of_the_table(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    got = {(r.conv_id, r.turn): json.loads(r.message) for r in chat.format_chats(c).collect()}
    assert got == {(r.conv_id, r.turn): {"role": r.role, "content": r.text} for r in c.collect()}


def test_schema_errors():
    e = chat.errors
    assert e(True, {"type": "integer"}) == ["$: not integer"] and e(2.0, {"type": "integer"}) == []
    assert e([1, "a"], {"type": "array", "items": {"type": "number"}, "maxItems": 1}) == ["$: over maxItems", "$[1]: not number"]
    assert e(None, {"type": ["string", "null"]}) == [] and e("b", {"enum": ["a"]}) == ["$: not in enum"]
    assert e({"a": 1}, {"required": ["b"]}) == ["$.b: missing"] and e({"a": 1}, False) == ["$: not allowed"]


def _brute(messages):
    """(turn, place in the list) -> (order_turn, order_step), linked results: chains walked one message at a time."""
    calls, results = {}, {}
    for at, (turn, ids, answers) in sorted(enumerate(messages), key=lambda x: (x[1][0], x[0])):
        for i in ids:
            calls.setdefault(i, at)
        if answers is not None:
            results.setdefault(answers, at)
    parent = {at: calls[i] for i, at in results.items() if i in calls}

    def on_cycle(at):
        x = parent.get(at)
        for _ in messages:
            if x is None or x == at:
                break
            x = parent.get(x)
        return x == at

    parent = {at: p for at, p in parent.items() if not on_cycle(at)}
    out = {}
    for at, (turn, _, _) in enumerate(messages):
        way = [at]
        while way[-1] in parent:
            way.append(parent[way[-1]])
        most, step = messages[way[-1]][0], 0
        for x in way[-2::-1]:
            most, step = (messages[x][0], 0) if messages[x][0] > most else (most, step + 1)
        out[at] = (most, step)
    return out, set(parent)


def test_order_against_brute_force_on_random_chains(spark, monkeypatch):
    rng, data, want = random.Random(5), [], {}
    for conv in range(60):
        n = rng.choice([1, 3, 8, 30, 120])
        messages = []
        for k in range(n):
            ids = [f"i{rng.randrange(n)}" for _ in range(rng.choice([0, 1, 1, 2]))]
            messages.append((rng.randrange(n), ids, f"i{rng.randrange(n)}" if rng.random() < 0.8 else None))
        if conv == 0:  # one long chain, backwards in turns
            messages = [(120 - k, [f"i{k}"], f"i{k - 1}") for k in range(120)]
        if conv == 1:  # a cycle with a tail
            messages = [(0, ["a"], "c"), (1, ["b"], "a"), (2, ["c", "d"], "b"), (0, ["e"], "d"), (0, [], "e")]
        places, linked = _brute(messages)
        for k, (turn, ids, answers) in enumerate(messages):
            body = {"n": k, "tool_calls": [{"id": i, "name": "f", "arguments": {}} for i in ids]} | ({"tool_call_id": answers} if answers is not None else {})
            data.append((conv, turn, "m", json.dumps(body | {"content": str(k)}), ""))
            want[conv, k] = (*places[k], k in linked if answers is not None else None)
    d = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, result string").coalesce(1)
    got = {(r.conv_id, int(json.loads(r.message)["content"])): (r.order_turn, r.order_step, r.linked) for r in chat.format_chats(d).collect()}
    assert got == want


def test_a_result_follows_its_call_that_is_a_result_itself(spark):
    call = lambda i, **more: json.dumps({"tool_calls": [{"id": i}]} | more)
    got = rows(spark, [(1, 5, "a", call("x"), ""), (1, 1, "t", call("y", tool_call_id="x"), ""), (1, 2, "t", json.dumps({"tool_call_id": "y"}), "")])
    assert [r[1] for r in got] == [5, 1, 2] and [r[2:4] for r in got] == [(5, 0), (5, 1), (5, 2)]


def test_a_conversation_of_many_calls_and_long_texts(spark):
    n = 3000
    data = [(7, 0, "system", TOOLS, "")] + [(7, k, "a", json.dumps({"content": "c" * (100_000 if k == 5 else 1), "tool_calls": [{"id": str(k), "name": "f", "arguments": {"x": k % 3 - 1}}]}), "") for k in range(1, n)]
    data += [(7, k, "t", json.dumps({"tool_call_id": str(k)}), "") for k in range(1, n)]
    got = chat.format_chats(spark.createDataFrame(data, "conv_id long, turn long, role string, text string, result string")).collect()
    assert len(got) == 2 * n - 1 and sum(r.n_answered for r in got) == n - 1 and sum(r.n_invalid for r in got) == sum(k % 3 == 0 for k in range(1, n))
    assert all((r.order_turn, r.order_step) == (r.turn, 1 if r.linked else 0) for r in got)


def test_legal_json_that_no_canonical_form_has_is_plain_content(spark):
    deep = '{"tool_calls": ' + "[" * 3000 + "]" * 3000 + "}"
    nested = json.dumps({"type": "object", "properties": {}})
    for _ in range(2000):
        nested = '{"properties": {"a": ' + nested + "}}"
    texts = [
        '{"tool_calls": [{"id": "a", "name": "f", "arguments": {"x": 1e999}}]}',
        '{"tool_call_id": "a", "content": -1e999}',
        '{"tools": [{"name": "f", "parameters": {"minimum": 1e999}}]}',
        '{"tool_call_id": "x", "content": "\\ud800"}',
        '{"tool_calls": [{"id": "\\udfff"}]}',
        deep,
        '{"tools": [{"name": "f", "parameters": ' + nested + "}]}",
        '{"tool_call_id": "x", "content": ' + "9" * 5000 + "}",
    ]
    got = rows(spark, [(1, k, "user", t, None) for k, t in enumerate(texts)])
    assert [json.loads(r[5]) for r in got] == [{"content": t, "role": "user"} for t in texts]
    assert all(r[6:10] == (0, 0, 0, None) for r in got)


def test_odd_schemas_and_arguments(spark):
    tools = json.dumps({"tools": [{"name": "f", "parameters": {"required": [["a"], 3, None, "x"], "enum": [[]], "type": [["object"], "object"], "properties": {"x": {"minimum": "1"}}}}]})
    calls = json.dumps({"tool_calls": [{"id": "a", "name": "f", "arguments": '{"x": 1e999}'}, {"id": "b", "name": "f", "arguments": {"y": 1}}]})
    got = {r[1]: json.loads(r[5]) for r in rows(spark, [(1, 0, "s", tools, ""), (1, 1, "a", calls, "")])}
    assert [c["arguments"] for c in got[1]["tool_calls"]] == ['{"x": 1e999}', {"y": 1}]
    assert got[1]["tool_calls"][0]["errors"] == ["$: not ['object'] or object"]
    assert got[1]["tool_calls"][1]["errors"] == ["$: not in enum", "$.x: missing"]


def test_any_json_is_read(spark):
    rng = random.Random(6)

    def value(depth=0):
        kinds = [lambda: rng.choice([None, True, 0, -1, 1.5, 10**30, "", "a", "😀", "é", "type"])]
        if depth < 4:
            kinds += [lambda: [value(depth + 1) for _ in range(rng.randrange(3))], lambda: {rng.choice(["id", "name", "arguments", "function", "type", "required", "properties", "enum", "items", "minimum", "parameters", "x"]): value(depth + 1) for _ in range(rng.randrange(4))}]
        return rng.choice(kinds)()

    data = []
    for k in range(400):
        body = {rng.choice(["tool_calls", "tool_call_id", "tools", "content"]): value() if rng.random() < 0.3 else [value() for _ in range(2)] for _ in range(3)}
        text = json.dumps(body, ensure_ascii=rng.random() < 0.5).replace("1.5", rng.choice(["1.5", "1e400", "NaN", "1E5"]))
        data.append((k % 9, k, "user", text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"), None))
    got = rows(spark, data)
    assert len(got) == 400 and all(chat.canonical(json.loads(r[5])) == r[5] for r in got)
