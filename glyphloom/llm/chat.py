"""Chat formatting with tool-call linking.

A call message is an assistant message whose text is a JSON object with ``tool_calls``, a list
of ``{"id", "name", "arguments"}``; a result is a message of role ``tool`` whose text has a
``tool_call_id``. Arguments may use an earlier result as ``{"$ref": "<call id>"}``. Results are
joined to calls by identifier, messages ordered so that each follows what it needs,
arguments checked against the tools' schemas, and messages written as canonical JSON.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from math import isfinite

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import written
from .components import components

TOOL_SCHEMA = "name string, schema string"
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


_SURROGATE = re.compile("[\ud800-\udfff]")


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces and no escapes but the needed ones, lone surrogates among these."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def well_formed(text: str) -> str:
    """The text with lone surrogates as U+FFFD, as a string column can hold no other."""
    return _SURROGATE.sub("\ufffd", text)


def references(value: object) -> list[str]:
    """Call ids that a value refers to."""
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            return [value["$ref"]]
        return [r for v in value.values() for r in references(v)]
    return [r for v in value for r in references(v)] if isinstance(value, list) else []


def fits(value: object, schema: object) -> bool:
    """Whether a value meets a JSON schema of types, enums, properties, required and items.

    A keyword whose own value is malformed asks nothing.
    """
    if not isinstance(schema, dict) or (isinstance(value, dict) and set(value) == {"$ref"}):
        return True
    kinds = schema.get("type", [])
    kinds = [k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)]
    if kinds and not any(isinstance(value, _TYPES.get(k, ())) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds):
        return False
    if isinstance(schema.get("enum"), list) and value not in schema["enum"]:
        return False
    if isinstance(value, dict):
        known = schema.get("properties")
        known = known if isinstance(known, dict) else {}
        required = schema.get("required")
        if any(k not in value for k in (required if isinstance(required, list) else ()) if isinstance(k, str)):
            return False
        if schema.get("additionalProperties") is False and any(k not in known for k in value):
            return False
        return all(fits(v, known[k]) for k, v in value.items() if k in known)
    if isinstance(value, list) and "items" in schema:
        return all(fits(v, schema["items"]) for v in value)
    return True


#: JSON nested deeper than this is taken as plain text.
DEEPEST = 200


def _too_deep(value: object) -> bool:
    level = [value]
    for _ in range(DEEPEST):
        level = [y for x in level if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]
    return bool(level)


def _object(text: str | None) -> dict:
    if text and text.lstrip().startswith("{"):
        try:
            value = json.loads(text, parse_constant=_no_number, parse_float=_finite)
        except (ValueError, RecursionError):  # no JSON, a number that JSON cannot write, or nested too deep to read
            return {}
        return value if isinstance(value, dict) and not _too_deep(value) else {}
    return {}


def _no_number(name: str) -> float:
    raise ValueError(name)


def _finite(digits: str) -> float:
    number = float(digits)
    return number if isfinite(number) else _no_number(digits)


def parse_message(role: str | None, text: str | None) -> tuple[list[dict], str | None, str]:
    """Calls ``(call_id, name, arguments, refs)``, the answered call id, canonical JSON."""
    body = _object(text) if role in ("assistant", "tool") else {}
    calls = []
    if role == "assistant" and isinstance(body.get("tool_calls"), list):
        for c in body["tool_calls"]:
            if isinstance(c, dict) and isinstance(c.get("id"), str):
                refs = [well_formed(r) for r in references(c.get("arguments"))]
                calls.append({"call_id": well_formed(c["id"]), "name": well_formed(str(c.get("name"))), "arguments": canonical(c.get("arguments")), "refs": refs})
    answers = body.get("tool_call_id") if role == "tool" else None
    answers = well_formed(answers) if isinstance(answers, str) else None
    content = body if calls or answers else text
    return calls, answers, canonical({"role": role, "content": content})


CALL_TYPE = pa.list_(pa.struct([("call_id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("refs", pa.list_(pa.string()))]))
CALL_SQL = "array<struct<call_id:string,name:string,arguments:string,refs:array<string>>>"


def _parsed(messages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse_message(r.as_py(), t.as_py()) for r, t in zip(batch.column("role"), batch.column("text"))]
            calls, answers, out = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "turn", "role")), pa.array(calls, CALL_TYPE), pa.array(answers, pa.string()), pa.array(out, pa.string())],
                names=["conv_id", "turn", "role", "calls", "answers", "json"],
            )

    kinds = ", ".join(f"{c} {messages.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn", "role"))
    return messages.mapInArrow(run, f"{kinds}, calls {CALL_SQL}, answers string, json string")


def declared_tools(messages: DataFrame) -> DataFrame:
    """``(conv_id, name, schema)`` of the tools that conversations declare.

    A declaration is a system message whose text is a JSON object with ``tools``, a list of
    ``{"name", "parameters"}`` or of such objects under ``function``. Parameters are a JSON schema;
    a tool without them takes any arguments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, names, schemas = [], [], []
            for i, text in enumerate(batch.column(1)):
                tools = _object(text.as_py()).get("tools")
                for tool in tools if isinstance(tools, list) else []:
                    tool = tool.get("function", tool) if isinstance(tool, dict) else None
                    if isinstance(tool, dict) and isinstance(tool.get("name"), str):
                        at.append(i)
                        names.append(well_formed(tool["name"]))
                        schemas.append(canonical(tool.get("parameters")))
            conv = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([conv, pa.array(names, pa.string()), pa.array(schemas, pa.string())], names=["conv_id", "name", "schema"])

    ship(messages.sparkSession)
    kind = messages.schema["conv_id"].dataType.simpleString()
    return messages.where("role = 'system'").select("conv_id", "text").mapInArrow(run, f"conv_id {kind}, {TOOL_SCHEMA}")


def _schema(text: str) -> object:
    try:
        schema = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return None if _too_deep(schema) else schema


def _checked(calls: DataFrame) -> DataFrame:
    """Whether the arguments of each row ``(.., arguments, schema)`` fit."""

    @F.pandas_udf("boolean")
    def ok(arguments, schema):
        parsed = {s: _schema(s) for s in schema.dropna().unique()}
        return arguments.combine(schema, lambda a, s: s is not None and fits(json.loads(a), parsed[s]))

    return calls.withColumn("fits", ok("arguments", "schema"))


def order_linked(turns: list[int], befores: list[int]) -> list[tuple[int, int, int, bool]]:
    """``(turn, at, step, stuck)`` of the messages of needs, by removal of messages without unmet needs.

    What is never removed lies in a cycle or behind one and keeps its own turn.
    """
    unmet: dict[int, int] = {}
    after: dict[int, list[int]] = {}
    for turn, before in zip(turns, befores):
        unmet[turn] = unmet.get(turn, 0) + 1
        unmet.setdefault(before, 0)
        after.setdefault(before, []).append(turn)
    place = {m: (m, 0) for m in unmet}
    ready = [m for m, n in unmet.items() if not n]
    while ready:
        m = ready.pop()
        at, step = place[m]
        for later in after.get(m, ()):
            place[later] = max(place[later], (at, step + 1))
            unmet[later] -= 1
            if not unmet[later]:
                ready.append(later)
    return [(m, m, 0, True) if n else (m, *place[m], False) for m, n in unmet.items()]


#: Needs of linked messages that one task orders; more are ordered in rounds of joins.
TASK_NEEDS = 200_000


def _by_rounds(needs: DataFrame) -> DataFrame:
    """The same order as ``order_linked`` for messages of any number: a round for each step of the longest chain."""
    keys = ["conv_id", "turn"]
    left = needs
    place = needs.select("conv_id", F.col("before").alias("turn")).join(needs, keys, "left_anti").distinct()
    place = written(place.select(*keys, F.struct(F.col("turn").cast("long").alias("at"), F.lit(0).alias("step")).alias("place")), "chat-placed")
    done, last = place, place
    best = needs.select(*keys).distinct().select(*keys, F.struct(F.col("turn").cast("long").alias("at"), F.lit(0).alias("step")).alias("best"))
    while not last.isEmpty():
        settled = last.select("conv_id", F.col("turn").alias("before"), "place")
        moved = left.join(settled, ["conv_id", "before"]).select(*keys, F.struct(F.col("place.at").alias("at"), (F.col("place.step") + 1).alias("step")).alias("best"))
        best = written(best.unionByName(moved).groupBy(*keys).agg(F.max("best").alias("best")), "chat-best")
        left = written(left.join(settled.drop("place"), ["conv_id", "before"], "left_anti"), "chat-left")
        ready = moved.select(*keys).distinct().join(left, keys, "left_anti")
        last = written(best.join(ready, keys).select(*keys, F.col("best").alias("place")), "chat-placed")
        done = done.unionByName(last)
    stuck = best.join(done, keys, "left_anti").select(*keys, F.col("turn").cast("long").alias("at"), F.lit(0).alias("step"), F.lit(True).alias("stuck"))
    return done.select(*keys, "place.at", "place.step", F.lit(False).alias("stuck")).unionByName(stuck)


def _placed(needs: DataFrame) -> DataFrame:
    """``(conv_id, turn, at, step, stuck)``: messages that needs link are ordered together, others apart."""

    def run(key: tuple, linked: pd.DataFrame) -> pd.DataFrame:
        rows = order_linked(linked["turn"].tolist(), linked["before"].tolist())
        out = pd.DataFrame(rows, columns=["turn", "at", "step", "stuck"])
        out.insert(0, "conv_id", [key[0]] * len(out))
        return out

    node = lambda turn: F.struct("conv_id", F.col(turn).alias("turn"))
    groups = components(needs.select(node("turn").alias("a"), node("before").alias("b")))
    groups = groups.select(F.col("node.conv_id").alias("conv_id"), F.col("node.turn").alias("turn"), F.col("component.turn").alias("_root"))
    linked = written(needs.join(groups, ["conv_id", "turn"], "left").withColumn("_root", F.coalesce("_root", "turn")), "chat-linked")
    large = written(linked.groupBy("conv_id", "_root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TASK_NEEDS).drop("n"), "chat-large")
    some_large = not large.isEmpty()
    small = linked.join(large, ["conv_id", "_root"], "left_anti") if some_large else linked
    kinds = ", ".join(f"{c} {needs.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn"))
    placed = small.groupBy("conv_id", "_root").applyInPandas(run, f"{kinds}, at long, step int, stuck boolean")
    if some_large:
        placed = placed.unionByName(_by_rounds(linked.join(large, ["conv_id", "_root"], "left_semi").select("conv_id", "turn", "before")))
    return placed


def format_chats(messages: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """One row per message: ``conv_id, turn, role, order_turn, order_step, n_calls, problem, json``.

    Sorting a conversation by ``(order_turn, order_step, turn)`` puts every message after those
    it needs: a result after its call, a call after the results it refers to. ``problem`` is
    null or the first of ``unknown_tool, bad_arguments, orphan_result, unanswered_call, cycle``.
    Without ``tools(name, schema)`` no tool is unknown and no argument bad. Tools with a
    ``conv_id`` are known to that conversation only.

    * Null texts and roles are kept as JSON null; a text that is no JSON object is content, and
      so is one that JSON cannot write again (an infinite number) or that nests deeper
      than DEEPEST. A very long text is parsed whole by its task. Other columns are ignored, whatever their names.
      A null ``conv_id`` or ``turn`` is kept but links nothing. Of calls that share an id, the
      earliest turn counts; repeated rows stay. Empty tables give an empty result.
    """
    spark = messages.sparkSession
    ship(spark)
    rows = written(_parsed(messages.select("conv_id", "turn", "role", "text")), "chat-messages")
    calls = rows.where("size(calls) > 0").select("conv_id", "turn", F.explode("calls").alias("c")).select("conv_id", "turn", "c.*")
    answers = rows.where("answers is not null").select("conv_id", F.col("turn").alias("answer_turn"), F.col("answers").alias("call_id"))
    calls, answers = written(calls, "chat-calls"), written(answers, "chat-answers")
    first_call = calls.groupBy("conv_id", "call_id").agg(F.min("turn").alias("call_turn"))
    first_answer = answers.groupBy("conv_id", "call_id").agg(F.min("answer_turn").alias("answer_turn"))
    linked = answers.hint("shuffle_hash").join(first_call, ["conv_id", "call_id"], "left")

    # problems, by message
    rank = {name: i for i, name in enumerate(("unknown_tool", "bad_arguments", "orphan_result", "unanswered_call", "cycle"))}
    said = lambda name: F.lit(rank[name]).alias("problem")
    found = linked.where("call_turn is null").select("conv_id", F.col("answer_turn").alias("turn"), said("orphan_result"))
    missing = calls.join(first_answer.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
    found = found.unionByName(missing.select("conv_id", "turn", said("unanswered_call")))
    if tools is not None:
        key = [c for c in ("conv_id", "name") if c in tools.columns]
        per_name = tools.groupBy(*key).agg(F.max("schema").alias("schema"), F.lit(True).alias("known"))
        against = _checked(calls.join(per_name, key, "left"))
        found = found.unionByName(against.where("known is null").select("conv_id", "turn", said("unknown_tool")))
        found = found.unionByName(against.where("known and not fits").select("conv_id", "turn", said("bad_arguments")))

    # needs: (conv_id, turn) follows (conv_id, before)
    by_result = linked.where("call_turn is not null").select("conv_id", F.col("answer_turn").alias("turn"), F.col("call_turn").alias("before"))
    refs = calls.select("conv_id", "turn", F.explode("refs").alias("call_id")).join(first_answer, ["conv_id", "call_id"])
    needs = by_result.unionByName(refs.select("conv_id", "turn", F.col("answer_turn").alias("before"))).distinct()
    needs = written(needs, "chat-needs")
    nodes = needs.select("conv_id", "turn").unionByName(needs.select("conv_id", F.col("before").alias("turn"))).distinct()
    if needs.isEmpty():
        place = nodes.select("conv_id", "turn", F.struct(F.col("turn").cast("long").alias("at"), F.lit(0).alias("step")).alias("place"))
    else:
        placed = written(_placed(needs), "chat-order")
        found = found.unionByName(placed.where("stuck").select("conv_id", "turn", said("cycle")))
        place = placed.select("conv_id", "turn", F.struct("at", "step").alias("place"))

    worst = found.groupBy("conv_id", "turn").agg(F.min("problem").alias("problem"))
    # only messages that call or answer can have a problem or be moved; the others never meet a join
    plain = (F.size("calls") == 0) & F.col("answers").isNull()
    names = F.array(*map(F.lit, rank))
    tooled = rows.where(~plain).join(place, ["conv_id", "turn"], "left").join(worst, ["conv_id", "turn"], "left")
    columns = lambda place, step, problem: [
        "conv_id", "turn", "role", place.alias("order_turn"), step.alias("order_step"), F.size("calls").alias("n_calls"), problem.alias("problem"), "json"
    ]
    own = F.col("turn").cast("long")
    return rows.where(plain).select(*columns(own, F.lit(0), F.lit(None).cast("string"))).unionByName(
        tooled.select(*columns(F.coalesce("place.at", own), F.coalesce("place.step", F.lit(0)), F.get(names, F.col("problem"))))
    )


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, each call checked against the tools that its conversation declares."""
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return format_chats(messages, declared_tools(messages))
