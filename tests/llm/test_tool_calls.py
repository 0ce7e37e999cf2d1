"""Tool calls: linking, order, validation, canonical JSON."""

from __future__ import annotations

import json
import random
from functools import cache

from pyspark.sql import functions as F

from memlake.llm import tool_calls as T

DDL = "conv_id bigint, turn bigint, role string, content string, tool_calls string, tool_call_id string"
SCHEMAS = {"f": {"x": ("integer", True), "s": ("string", False), "b": ("boolean", False), "n": ("number", False)}}


def call(i, args, name="f", after=()):
    return {"id": i, "name": name, "arguments": args, "after": list(after)}


def run(spark, rows):
    df = spark.createDataFrame(rows, DDL).withColumn("row", F.lit(1)).withColumn("id", F.lit("z"))
    return T.format_tool_calls(df, SCHEMAS).collect()


def asst(conv, turn, *calls, raw=None):
    return (conv, turn, "assistant", "text", raw if raw is not None else json.dumps(list(calls)), None)


def tool(conv, turn, i, text="ok"):
    return (conv, turn, "tool", text, None, i)


def test_linking_and_statuses(spark):
    rows = [asst(1, 0, call("a", {"x": 1}), call("b", {"x": 2})), tool(1, 1, "a", "ra"), tool(1, 2, "a", "again"), tool(1, 3, "zz"),
            asst(1, 4, call("a", {"x": 9})), asst(2, 0, call("a", {"x": 3})), tool(2, 1, "a", None), tool(1, 5, None),
            asst(1, 6, call(None, {"x": 1})), asst(3, 0, raw="not json"), asst(3, 1, raw=""), (3, 2, None, None, None, None),
            asst(None, 0, call("n", {"x": 1})), tool(None, 1, "n", "null conversation")]
    got = {(r.conv_id, r.order_turn, r.call_id): (r.status, json.loads(r.json).get("result")) for r in run(spark, rows)}
    assert got == {(1, 0, "a"): ("linked", "ra"), (1, 0, "b"): ("no_result", None), (1, 2, "a"): ("duplicate_result", "again"),
                   (1, 3, "zz"): ("no_call", "ok"), (1, 4, "a"): ("duplicate_call", None), (2, 0, "a"): ("linked", None),
                   (1, 5, None): ("no_call", "ok"), (1, 6, None): ("no_result", None), (3, 0, None): ("unreadable", None),
                   (None, 0, "n"): ("linked", "null conversation")}


def test_repeated_rows_make_no_pairs(spark):
    rows = [asst(1, 0, call("a", {"x": 1}))] * 30 + [tool(1, 1, "a")] * 40
    got = [r.status for r in run(spark, rows)]
    assert sorted(got) == sorted(["linked"] + ["duplicate_call"] * 29 + ["duplicate_result"] * 39)


def test_topological_order(spark):
    rows = [asst(1, 0, call("late", {"x": 1}, after=["early"]), call("later", {"x": 1}, after=["late"]), call("free", {"x": 1})),
            asst(1, 1, call("early", {"x": 1}, after=["gone"])), asst(1, 2, call("last", {"x": 1}, after=["later", "free"])),
            asst(2, 0, call("p", {"x": 1}, after=["q"]), call("q", {"x": 1}, after=["p"]), call("r", {"x": 1}, after=["q"]), call("self", {"x": 1}, after=["self"]))]
    out = run(spark, rows)
    first = [r.call_id for r in out if r.conv_id == 1]
    assert sorted(first) == ["early", "free", "last", "late", "later"]
    at = first.index
    assert at("early") < at("late") < at("later") < at("last") and at("free") < at("last")
    assert {r.call_id for r in out if r.status == "cyclic"} == {"p", "q", "r", "self"}
    assert next(r for r in out if r.call_id == "early").errors == "needs unknown call gone"


def test_long_inverted_chain_keeps_its_order(spark):
    n = 12
    rows = [asst(1, i, call(f"c{i}", {"x": 1}, after=[f"c{i + 1}"] if i + 1 < n else [])) for i in range(n)]
    assert [r.call_id for r in run(spark, rows)] == [f"c{i}" for i in reversed(range(n))]


def test_validation_and_canonical_json():
    ok = [({"x": 1}, []), ('{"x": 1}', []), ({"x": 1, "n": 1.5, "b": True}, []), ({}, ["missing x"]), ({"x": True}, ["x is no integer"]),
          ({"x": "1"}, ["x is no integer"]), ({"x": 1, "y": 2}, ["unknown y"]), ([1], ["arguments are no object"])]
    for value, wrong in ok:
        assert T.check("f", json.dumps(value), SCHEMAS)[1] == wrong
    assert T.check("g", "{}", SCHEMAS)[1] == ["unknown tool"]
    assert T.check("f", '{"x": NaN}', SCHEMAS)[1] == T.check("f", "{", SCHEMAS)[1] == ["arguments are not JSON"]
    assert T.check("f", None, SCHEMAS) == ({}, ["missing x"])
    assert T.canonical({"b": [1, {"d": 2, "c": "é"}], "a": None}) == '{"a":null,"b":[1,{"c":"é","d":2}]}'


def test_empty_table(spark):
    assert run(spark, []) == []


def test_query_against_plain_python(spark, sf_check):
    rows = spark.read.parquet(f"{sf_check}/conversations.parquet").collect()
    got = T.op7_tool_calls(spark, sf_check).collect()
    calls = {(r.conv_id, r.turn) for r in rows if r.role == "assistant"}
    results = {(r.conv_id, r.turn - 1): r.text for r in rows if r.role == "user" and r.turn > 0}
    assert {(r.conv_id, int(r.call_id[5:])) for r in got if r.status in ("linked", "no_result")} == calls
    for r in got:
        key = (r.conv_id, int(r.call_id[5:]))
        assert r.json == json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        if r.status == "linked":
            assert json.loads(r.json)["result"] == results[key]
    assert sum(r.status == "no_call" for r in got) == len(set(results) - calls)


def test_nested_schemas():
    schema = {"f": {"type": "object", "required": ["q", "at"], "additionalProperties": False, "properties": {
        "q": {"type": "string", "minLength": 2, "maxLength": 4, "pattern": "^[a-z]+$"}, "unit": {"enum": ["m", "km", 1]},
        "at": {"type": "object", "required": ["lat"], "properties": {"lat": {"type": "number", "minimum": -90, "maximum": 90}}},
        "tags": {"type": "array", "maxItems": 2, "items": {"type": ["string", "null"]}}}}}
    for value, wrong in [
            ({"q": "ab", "at": {"lat": 1.5, "more": 1}, "tags": ["x", None], "unit": 1}, []),
            ({"q": "a", "at": {}}, ["missing at.lat", "q breaks minLength 2"]),
            ({"q": "abcdE", "at": {"lat": 91}}, ["at.lat breaks maximum 90", "q does not match its pattern", "q breaks maxLength 4"]),
            ({"at": {"lat": "1"}, "q": "ab", "unit": True, "x": 0}, ["at.lat is no number", "unit is not in its list", "unknown x"]),
            ({"q": "ab", "at": {"lat": -90}, "tags": [1, "a", "b"]}, ["tags breaks maxItems 2", "tags[0] is no string or null"])]:
        assert T.check("f", json.dumps(value), schema) == (value, wrong)


def plain_order(rows):
    """{(conv, id): (turn, rank, cyclic)} by recursion over the needs of each conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        calls = {}
        for _, turn, _, _, raw, _ in sorted(r for r in rows if r[0] == conv):
            for place, c in enumerate(json.loads(raw)):
                calls[c["id"]] = (turn, place, c["after"])

        def reach(i, calls=calls):
            seen, todo = set(), [i]
            while todo:
                for n in calls[todo.pop()][2]:
                    if n in calls and n not in seen:
                        seen.add(n)
                        todo.append(n)
            return seen
        on_cycle = {i for i in calls if i in reach(i)}

        @cache
        def key(i, calls=calls):  # noqa: B023
            turn, place, after = calls[i]
            top = max((key(n) for n in after if n in calls), default=None)  # noqa: B023
            return (turn, 0, place) if top is None or top < (turn, 0, place) else (top[0], top[1] + 1, place)
        for i, (turn, _, _) in calls.items():
            bad = i in on_cycle or reach(i) & on_cycle
            out[conv, i] = (turn, 0, True) if bad else (*key(i)[:2], False)
    return out


def test_random_orders_match_the_plain_version(spark):
    rng = random.Random(7)
    rows = []
    for conv in range(60):
        n = rng.randint(1, 9)
        rows += [asst(conv, t, *[call(f"c{t}{p}", {"x": 1}, after=sorted({f"c{rng.randrange(n)}{rng.randrange(2)}" for _ in range(rng.choice((0, 1, 1, 2)))}))
                                 for p in range(2)]) for t in range(n)]
    got = {(r.conv_id, r.call_id): (r.order_turn, r.order_rank, r.status == "cyclic") for r in run(spark, rows)}
    want = plain_order(rows)
    assert got == want
    assert {c for *_, c in want.values()} == {True, False} and max(r for _, r, _ in want.values()) > 1


def test_many_moved_calls_beside_a_cycle_take_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(T, "materialize", lambda df, name, real=T.materialize: written.append(name) or real(df, name))
    rows = [asst(0, 0, call("p", {"x": 1}, after=["q"]), call("q", {"x": 1}, after=["p"]), call("r", {"x": 1}, after=["q"]))]
    rows += [asst(1 + i, 0, call("late", {"x": 1}, after=["early"]), call("early", {"x": 1})) for i in range(1000)]
    out = run(spark, rows)
    assert {r.call_id for r in out if r.status == "cyclic"} == {"p", "q", "r"}
    assert sum(r.order_rank == 1 for r in out) == 1000
    assert sum(n in ("tool_late", "tool_open", "tool_behind") for n in written) <= 20
