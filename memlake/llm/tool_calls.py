"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

Input messages: (conv_id, turn, role, content, tool_calls, tool_call_id). `tool_calls` is a JSON array of {id, name,
arguments, after}: `arguments` an object, or JSON text of one; `after` the ids of calls whose results it needs.

1. Calls and results are hash-joined on (conv_id, id). The first call and the first result of an id (by turn,
   then place) belong together; further ones get a status of their own, so a repeated id makes no pairs.
2. Order: a call stands at (turn, rank, place). A call that stands before one it needs moves behind it, to a rank above
   that of all it needs in that turn; this repeats
   over written tables until nothing moves, so the rounds are the length of the longest chain of moves. After 4, 8, 16, ... rounds
   cycles are searched among the moved calls (calls without open needs are taken away until none goes). Calls on a cycle, or behind
   one, keep their place with status `cyclic`, and no longer count in further rounds.
3. Arguments are checked against the tool's schema (basic JSON Schema, nested) and written as canonical JSON (sorted keys, no spaces).

One row per call or unmatched result, sorted by conversation and order with a range partitioning over all key columns: no task
needs a whole conversation.

Defined cases: null or empty tool_calls are none; unreadable ones give one row of status `unreadable`. A call
or result without id cannot be linked (`no_result`, `no_call`). A null conversation is one of its own.
A needed id that the conversation lacks is ignored for the order and reported as an error. Equal places cannot be: rows that repeat have
row numbers of their own, the smaller goes first. Texts of any length are kept whole. Empty tables give no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import materialize, register
from memlake.sources.tables import read_table

_CALLS = "array<struct<id:string,name:string,arguments:string,after:array<string>>>"
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _fits(value, kind: str) -> bool:
    return isinstance(value, _TYPES[kind]) and (kind == "boolean" or not isinstance(value, bool))


def as_json_schema(schema: dict) -> dict:
    """A tool's schema: JSON Schema as it is, the short form {argument: (type, required)} as an object without further arguments."""
    if all(isinstance(v, tuple) for v in schema.values()):
        return {"type": "object", "properties": {a: {"type": kind} for a, (kind, _) in schema.items()},
                "required": [a for a, (_, required) in schema.items() if required], "additionalProperties": False}
    return schema


def faults(value, schema: dict, path: str = "") -> list[str]:
    """What JSON Schema's basic keywords find wrong: type, enum, minimum, maximum, minLength, maxLength, pattern, items,
    minItems, maxItems, required, properties, additionalProperties. Sizes are told before members, members in order."""
    name = path or "arguments"
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_fits(value, k) for k in kinds):
        return [f"{name} is no {' or '.join(kinds)}"]
    wrong = []
    if "enum" in schema and canonical(value) not in {canonical(v) for v in schema["enum"]}:
        wrong.append(f"{name} is not in its list")
    size, least, most = None, None, None
    if _fits(value, "number"):
        size, least, most = value, "minimum", "maximum"
    elif isinstance(value, str):
        size, least, most = len(value), "minLength", "maxLength"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            wrong.append(f"{name} does not match its pattern")
    elif isinstance(value, list):
        size, least, most = len(value), "minItems", "maxItems"
    for bound, bad in ((least, lambda limit: size < limit), (most, lambda limit: size > limit)):
        if bound in schema and bad(schema[bound]):
            wrong.append(f"{name} breaks {bound} {schema[bound]}")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            wrong += faults(v, schema["items"], f"{path}[{i}]")
    if isinstance(value, dict):
        known, inner = schema.get("properties", {}), f"{path}." if path else ""
        more = schema.get("additionalProperties", True)
        wrong += [f"missing {inner}{a}" for a in sorted(schema.get("required", ())) if a not in value]
        for a in sorted(value):
            if a in known:
                wrong += faults(value[a], known[a], inner + a)
            elif more is False:
                wrong.append(f"unknown {inner}{a}")
            elif isinstance(more, dict):
                wrong += faults(value[a], more, inner + a)
    return wrong


def check(name: str | None, arguments: str | None, schemas: dict) -> tuple[object, list[str]]:
    """The parsed arguments and what is wrong with them by the tool's schema (see `as_json_schema`)."""
    try:
        value = json.loads(arguments) if arguments else {}
        if isinstance(value, str):
            value = json.loads(value)
        canonical(value)  # refuses numbers that JSON lacks
    except (ValueError, RecursionError):
        return arguments, ["arguments are not JSON"]
    if not isinstance(value, dict):
        return value, ["arguments are no object"]
    if name not in schemas:
        return value, ["unknown tool"]
    return value, faults(value, as_json_schema(schemas[name]))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def call_rows(messages: DataFrame) -> DataFrame:
    """(conv, turn, place, id, name, arguments, after, readable) of every call."""
    parsed = F.from_json("tool_calls", _CALLS)
    rows = (messages.where("trim(coalesce(tool_calls, '')) <> ''")
            .select(F.col("conv_id").alias("conv"), "turn", parsed.alias("calls")))
    fine = (rows.where("calls is not null").select("conv", "turn", F.posexplode("calls").alias("place", "c"))
            .where("c is not null")
            .select("conv", "turn", "place", "c.id", "c.name", "c.arguments", "c.after", F.lit(True).alias("readable")))
    none = rows.where("calls is null").select(
        "conv", "turn", F.lit(0).alias("place"), *[F.lit(None).cast("string").alias(c) for c in ("id", "name", "arguments")],
        F.lit(None).cast("array<string>").alias("after"), F.lit(False).alias("readable"))
    return fine.unionByName(none)


def link(messages: DataFrame) -> DataFrame:
    """Every call with its result, and every result that no call claims."""
    calls = materialize(call_rows(messages).withColumn("row", F.monotonically_increasing_id()), "tool_calls")
    results = materialize(messages.where("role = 'tool'").select(
        F.col("conv_id").alias("r_conv"), F.col("turn").alias("r_turn"), F.col("tool_call_id").alias("r_id"),
        F.col("content").alias("result"), F.monotonically_increasing_id().alias("r_row")), "tool_results")
    # narrow first rows per id: hot ids collapse before the shuffle
    first_call = (calls.where("id is not null").groupBy("conv", "id")
                  .agg(F.min(F.struct("turn", "place", "row")).alias("f")).select(F.col("f.row").alias("first_row")))
    first_result = (results.where("r_id is not null").groupBy("r_conv", "r_id")
                    .agg(F.min(F.struct("r_turn", "r_row")).alias("f")).select(F.col("f.r_row").alias("first_r_row")))
    calls = calls.join(first_call, F.col("row") == F.col("first_row"), "left")
    results = results.join(first_result, F.col("r_row") == F.col("first_r_row"), "left")
    heads = calls.where("first_row is not null")
    rest = calls.where("first_row is null")
    linked = heads.join(results.where("first_r_row is not null"), _same("conv", "r_conv") & (F.col("id") == F.col("r_id")), "full")
    status = (F.when(F.col("row").isNull(), "no_call").when(F.col("r_row").isNull(), "no_result").otherwise("linked"))
    columns = ["conv", "turn", "place", "id", "name", "arguments", "after", "result", "result_turn", "status", "row"]
    out = linked.select(
        F.when(F.col("row").isNull(), F.col("r_conv")).otherwise(F.col("conv")).alias("conv"),
        F.when(F.col("row").isNull(), F.col("r_turn")).otherwise(F.col("turn")).alias("turn"),
        F.coalesce("place", F.lit(0)).alias("place"), F.coalesce("id", "r_id").alias("id"), "name", "arguments", "after",
        "result", F.col("r_turn").alias("result_turn"), status.alias("status"), "row")
    spare = rest.select(
        "conv", "turn", "place", "id", "name", "arguments", "after", F.lit(None).cast("string").alias("result"),
        F.lit(None).cast("bigint").alias("result_turn"),
        F.when(~F.col("readable"), "unreadable").when(F.col("id").isNull(), "no_result").otherwise("duplicate_call").alias("status"), "row")
    more = results.where("first_r_row is null").select(
        F.col("r_conv").alias("conv"), F.col("r_turn").alias("turn"), F.lit(0).alias("place"), F.col("r_id").alias("id"),
        *[F.lit(None).cast("string").alias(c) for c in ("name", "arguments")], F.lit(None).cast("array<string>").alias("after"),
        "result", F.col("r_turn").alias("result_turn"),
        F.when(F.col("r_id").isNull(), "no_call").otherwise("duplicate_result").alias("status"), F.lit(None).cast("bigint").alias("row"))
    return out.select(*columns).unionByName(spare.select(*columns)).unionByName(more.select(*columns))


def unsettled(edges: DataFrame) -> DataFrame:
    """Rows on a cycle or behind one: what is left when rows without open needs are taken away again and again."""
    left, size = edges, -1
    while size != (now := left.count()):
        size = now
        left = materialize(left.join(left.select(F.col("row").alias("n_row")).distinct(), "n_row", "left_semi").select("row", "n_row"),
                           "tool_open")
    return left.select("row").distinct()


def behind(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """`rows` and all rows that need one of them, directly or not."""
    total = new = rows
    while True:
        met = edges.join(new.select(F.col("row").alias("n_row")), "n_row", "left_semi").select("row").distinct()
        new = materialize(met.join(total, "row", "left_anti"), "tool_behind")
        if new.limit(1).count() == 0:
            return total
        total = materialize(total.union(new), "tool_stuck")


#: Rounds after which the moved calls are searched for cycles the first time; then after twice as many, and so on.
FIRST_SEARCH = 4


def order(linked: DataFrame) -> DataFrame:
    """(row, base, rank, cyclic) of the calls that had to move behind a needed call, and of those that never can."""
    heads = linked.where("status in ('linked', 'no_result') and id is not null")
    needs = heads.select("conv", "row", F.explode(F.array_distinct("after")).alias("need"))
    edges = materialize(needs.join(heads.select(F.col("conv").alias("n_conv"), F.col("id").alias("n_id"), F.col("row").alias("n_row")),
                                   _same("conv", "n_conv") & (F.col("need") == F.col("n_id"))).select("row", "n_row"), "tool_edges")
    involved = edges.select("row").union(edges.select("n_row")).distinct()
    keys = materialize(heads.join(involved, "row").select("row", F.col("turn").alias("base"), F.lit(0).alias("rank"), "place"), "tool_keys")
    stuck = keys.select("row").limit(0)
    rounds, search = 0, FIRST_SEARCH
    while True:
        key = F.struct("base", "rank", "place", "row").alias("key")
        own = keys.select("row", key)
        need = keys.select(F.col("row").alias("n_row"), F.struct("base", "rank", "place", "row").alias("n_key"))
        late = materialize(edges.join(own, "row").join(need, "n_row")
                           .where("n_key >= key or (key.rank > 0 and n_key.base = key.base and n_key.rank = key.rank)")
                           .groupBy("row").agg(F.max(F.struct(F.col("n_key.base").alias("base"), (F.col("n_key.rank") + 1).alias("rank"))).alias("to")),
                           "tool_late")
        if late.limit(1).count() == 0:
            none = F.lit(None)
            return (keys.where("rank > 0").select("row", "base", "rank", F.lit(False).alias("cyclic"))
                    .unionByName(stuck.select("row", none.cast("bigint").alias("base"), none.cast("int").alias("rank"), F.lit(True).alias("cyclic"))))
        if rounds == search:
            search *= 2
            moved = materialize(keys.where("rank > 0").select("row"), "tool_moved")
            inner = edges.join(moved, "row", "left_semi").join(moved.select(F.col("row").alias("n_row")), "n_row", "left_semi").select("row", "n_row")
            found = materialize(unsettled(materialize(inner, "tool_inner")), "tool_cycles")
            if found.limit(1).count():
                found = behind(found, edges)
                stuck = materialize(stuck.union(found), "tool_stuck")
                edges = materialize(edges.join(found, "row", "left_anti").select("row", "n_row"), "tool_edges")
                keys = materialize(keys.join(found, "row", "left_anti").select("row", "base", "rank", "place"), "tool_keys")
                continue
        keys = materialize(keys.join(late, "row", "left").select(
            "row", F.coalesce("to.base", "base").alias("base"), F.coalesce("to.rank", "rank").alias("rank"), "place"), "tool_keys")
        rounds += 1


def format_tool_calls(messages: DataFrame, schemas: dict) -> DataFrame:
    """(conv_id, order_turn, order_rank, place, call_id, status, valid, errors, json), sorted."""
    linked = materialize(link(messages), "tool_linked")
    known = linked.where("status in ('linked', 'no_result') and id is not null").select(
        F.col("conv").alias("k_conv"), F.col("id").alias("k_id"))
    lacking = (linked.where("row is not null").select("conv", "row", F.explode(F.array_distinct("after")).alias("need"))
               .join(known, _same("conv", "k_conv") & (F.col("need") == F.col("k_id")), "left_anti")
               .groupBy("row").agg(F.array_sort(F.collect_set("need")).alias("lacking")))
    full = (linked.join(order(linked), "row", "left").join(lacking, "row", "left")
            .withColumn("status", F.when(F.coalesce("cyclic", F.lit(False)), "cyclic").otherwise(F.col("status"))))

    @F.pandas_udf("valid boolean, errors string, json string")
    def write(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for series in parts:
            out = []
            for i, name, arguments, after, result, status, missing in zip(*series, strict=True):
                record = {"id": i, "status": status}
                wrong = []
                if status not in ("no_call", "duplicate_result", "unreadable"):
                    value, wrong = check(name, arguments, schemas)
                    wrong = wrong + [f"needs unknown call {m}" for m in ([] if missing is None else missing)]
                    record |= {"name": name, "arguments": value, "after": sorted(a for a in ([] if after is None else after) if a is not None)}
                if status not in ("no_result", "duplicate_call", "unreadable"):
                    record["result"] = result
                out.append((not wrong, "; ".join(wrong), canonical(record)))
            yield pd.DataFrame(out, columns=["valid", "errors", "json"])
    done = full.withColumn("w", write("id", "name", "arguments", "after", "result", "status", "lacking"))
    return (done.select(F.col("conv").alias("conv_id"), F.coalesce("base", "turn").alias("order_turn"),
                        F.coalesce("rank", F.lit(0)).cast("bigint").alias("order_rank"), F.col("place").cast("bigint").alias("place"),
                        F.col("id").alias("call_id"), "status", "w.valid", "w.errors", "w.json")
            .orderBy("conv_id", "order_turn", "order_rank", "place", "call_id", "json"))


#: Schemas of the tools in the stand-in messages: {tool: {argument: (type, required)}}.
SCHEMAS = {"look_up": {"query": ("string", True), "limit": ("integer", False)},
           "take_note": {"text": ("string", True), "words": ("integer", True), "urgent": ("boolean", False)}}


def stand_in_messages(conversations: DataFrame) -> DataFrame:
    """Messages in the operator's schema from plain conversations, which hold no tool calls: an assistant turn
    calls a tool with its text, and needs the assistant turn two before; the next user turn is the result."""
    call = F.concat_ws("-", F.lit("call"), F.col("turn").cast("string"))
    before = F.concat_ws("-", F.lit("call"), (F.col("turn") - 2).cast("string"))
    size = F.size(F.split("text", " "))
    look = F.to_json(F.struct(F.col("text").alias("query"), size.alias("limit")))
    note = F.to_json(F.struct(F.col("text").alias("text"), size.alias("words"), (size > 50).alias("urgent")))
    long = F.length("text") > 200
    one = F.struct(call.alias("id"), F.when(long, "take_note").otherwise("look_up").alias("name"),
                   F.when(long, note).otherwise(look).alias("arguments"),
                   F.when(F.col("turn") > 2, F.array(before)).otherwise(F.array().cast("array<string>")).alias("after"))
    result = (F.col("role") == "user") & (F.col("turn") > 0)
    return conversations.select(
        "conv_id", "turn", F.when(result, "tool").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"),
        F.when(F.col("role") == "assistant", F.to_json(F.array(one))).alias("tool_calls"),
        F.when(result, F.concat_ws("-", F.lit("call"), (F.col("turn") - 1).cast("string"))).alias("tool_call_id"))


@register("op7_tool_calls")
def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls of the messages made from all conversations."""
    return format_tool_calls(stand_in_messages(read_table(spark, sf_dir, "conversations")), SCHEMAS)
