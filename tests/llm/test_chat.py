"""Chat formatting through the registered query: tools and long chains."""

import json

from glyphloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
TOOLS = json.dumps({"tools": [{"name": "f", "parameters": {"type": "object", "properties": {"n": {"type": "integer"}}, "required": ["n"]}}]})


def call(name, key, arguments):
    return json.dumps({"tool_calls": [{"id": key, "name": name, "arguments": arguments}]})


def answer(key):
    return json.dumps({"tool_call_id": key})


def queried(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    return {(r["conv_id"], r["turn"]): r for r in chat.op7_chat_formatting(spark, str(tmp_path)).collect()}


def test_query_checks_declared_tools(spark, tmp_path):
    rows = [
        (1, 0, "system", TOOLS), (1, 1, "assistant", call("f", "a", {"n": 1})), (1, 2, "tool", answer("a")),
        (1, 3, "assistant", call("f", "b", {"n": "one"})), (1, 4, "tool", answer("b")), (1, 5, "assistant", call("g", "c", {})), (1, 6, "tool", answer("c")),
        (2, 0, "system", "plain"), (2, 1, "assistant", call("f", "a", {"n": 1})), (2, 2, "tool", answer("a")),
    ]
    got = queried(spark, tmp_path, rows)
    assert {k: r["problem"] for k, r in got.items() if r["problem"]} == {(1, 3): "bad_arguments", (1, 5): "unknown_tool", (2, 1): "unknown_tool"}


def chain(conv, n, closed=False):
    """Answer i at turn 2 i before its call, which uses the next answer: each stands before what it needs."""
    rows = [(conv, 2 * n, "system", TOOLS)]
    for i in range(n):
        used = [i + 1] if i + 1 < n else [0] if closed else []
        rows += [(conv, 2 * i, "tool", answer(f"k{i}")), (conv, 2 * i + 1, "assistant", call("f", f"k{i}", {"n": 1, "x": [{"$ref": f"k{u}"} for u in used]}))]
    return rows


def test_long_chains_and_cycles_do_not_touch_other_conversations(spark, tmp_path):
    got = queried(spark, tmp_path, chain(1, 20) + chain(2, 20, closed=True) + chain(3, 9))
    for conv, last in ((1, 39), (3, 17)):
        for turn in range(last + 1):
            r = got[conv, turn]
            assert (r["order_turn"], r["order_step"], r["problem"]) == (last, last - turn, None)
    assert all((got[2, t]["order_turn"], got[2, t]["order_step"], got[2, t]["problem"]) == (t, 0, "cycle") for t in range(40))


def test_order_linked_by_rounds():
    assert sorted(chat.order_linked([1, 2, 3, 4], [2, 1, 1, 9])) == [(1, 1, 0, True), (2, 2, 0, True), (3, 3, 0, True), (4, 9, 1, False), (9, 9, 0, False)]
    assert chat.order_linked([5], [5]) == [(5, 5, 0, True)]


def test_odd_json_is_content_or_escaped(spark, tmp_path):
    deep = '{"tool_calls":' + "[" * 100_000
    nested = '{"tool_calls":[{"id":"d","name":"f","arguments":' + '{"a":' * 5000 + "1" + "}" * 5000 + "}]}"
    rows = [
        (1, 0, "assistant", '{"tool_calls":[{"id":"\\ud800","name":"f","arguments":{"n":"\\ud801"}}]}'), (1, 1, "tool", '{"tool_call_id":"\\ud800"}'),
        (1, 2, "assistant", '{"tool_calls":[{"id":"x","name":"f","arguments":{"n":1e999}}]}'), (1, 3, "assistant", '{"tool_calls":[{"id":"y","arguments":NaN}]}'),
        (1, 4, "assistant", deep), (1, 5, "system", '{"tools":[{"name":"f","parameters":{"type":[1],"required":7,"properties":3,"enum":1}}]}'), (1, 6, "assistant", nested),
    ]
    got = queried(spark, tmp_path, rows)
    assert [got[1, t]["n_calls"] for t in (0, 2, 3, 4, 6)] == [1, 0, 0, 0, 0]
    assert got[1, 0]["problem"] is None and got[1, 1]["problem"] is None and "\\ud801" in got[1, 0]["json"]
    assert json.loads(got[1, 2]["json"])["content"].endswith("1e999}}]}")


def test_large_groups_are_ordered_alike_in_rounds(spark, tmp_path, monkeypatch):
    rows = chain(1, 5) + chain(2, 4, closed=True) + [(2, 50, "tool", answer("k0")), (3, 0, "tool", answer("a")), (3, 1, "assistant", call("f", "a", {"n": 1}))]
    one = queried(spark, tmp_path / "a", rows)
    monkeypatch.setattr(chat, "TASK_NEEDS", 1)
    assert queried(spark, tmp_path / "b", rows) == one


def brute_order(rows):
    """Whether each message stands after what it needs, and which messages no order can place."""
    call_at, answer_at, needs = {}, {}, {}
    for conv, turn, role, text in sorted(rows, key=lambda r: r[:2]):
        body = json.loads(text) if text.startswith("{") else {}
        for c in body.get("tool_calls", []):
            call_at.setdefault((conv, c["id"]), turn)
        if role == "tool":
            answer_at.setdefault((conv, body["tool_call_id"]), turn)
    for conv, turn, role, text in rows:
        body = json.loads(text) if text.startswith("{") else {}
        wanted = {call_at.get((conv, body["tool_call_id"]))} if role == "tool" else {answer_at.get((conv, r)) for c in body.get("tool_calls", []) for r in chat.references(c["arguments"])}
        needs[conv, turn] = wanted - {None}
    left = dict(needs)
    while ready := [k for k, w in left.items() if not any((k[0], t) in left for t in w)]:
        for k in ready:
            del left[k]
    return needs, set(left)


def test_order_by_brute_force(spark, tmp_path):
    import random

    rng, rows = random.Random(4), []
    for conv in range(60):
        n = rng.randrange(1, 9)
        turns = rng.sample(range(40), 2 * n)
        for i in range(n):
            refs = [{"$ref": f"k{rng.randrange(n)}"} for _ in range(rng.randrange(3))]
            rows += [(conv, turns[2 * i], "assistant", call("f", f"k{i}", {"n": 1, "x": refs})), (conv, turns[2 * i + 1], "tool", answer(f"k{i}"))]
        rows.append((conv, 99, "system", TOOLS))
    got = queried(spark, tmp_path, rows)
    needs, stuck = brute_order(rows)
    assert {k for k, r in got.items() if r["problem"] == "cycle"} == stuck
    place = {k: (r["order_turn"], r["order_step"], k[1]) for k, r in got.items()}
    assert all(place[k] > place[k[0], t] for k, wanted in needs.items() if k not in stuck for t in wanted)
