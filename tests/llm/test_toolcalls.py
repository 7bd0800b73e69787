"""Levels, schemas and canonical JSON of tool calls against plain versions."""

import json
import random

import duckdb
from pyspark.sql import functions as F

from xdoc.llm import toolcalls
from xdoc.llm.oracles import ORACLES
from xdoc.llm.queries import REPLY

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>"
MESSAGES = "conv_id long, turn long, role string, text string, value string, need string, level long, steps string"


def plain_levels(calls):
    """Rounds over all calls until nothing changes; calls on or after a circle stay null."""
    needs = {}
    for conv, call, after in calls:
        needs.setdefault((conv, call), set()).update((conv, n) for n in after)
    needs = {k: {n for n in v if n in needs} for k, v in needs.items()}
    level, left = {}, dict(needs)
    while ready := [k for k, v in left.items() if all(n in level for n in v)]:
        for k in ready:
            level[k] = max((level[n] + 1 for n in left[k]), default=0)
            del left[k]
    return {k: level.get(k) for k in needs}


def got_levels(spark, calls):
    df = spark.createDataFrame([(c, 0, i, "t", "{}", a) for c, i, a in calls], CALLS)
    return {(r.conv_id, r.call_id): r.level for r in toolcalls.levels(df).collect()}


def test_levels_of_random_graphs(spark):
    rnd, calls = random.Random(6), []
    for conv in range(40):
        n = rnd.randint(1, 14)
        for k in range(n):
            before = [str(x) for x in range(k)] if conv % 4 else [str(x) for x in range(n)]  # every fourth may have circles
            calls.append((conv, str(k), rnd.sample(before, min(len(before), rnd.choice([0, 1, 1, 2, 3]))) + ["gone"]))
    assert got_levels(spark, calls) == plain_levels(calls)


def test_levels_of_deep_chains_wide_fans_and_circles(spark):
    chain = [(1, str(k), [str(k - 1)] if k else []) for k in range(5000)]
    fan = [(2, "top", [])] + [(2, f"f{k}", ["top"]) for k in range(1000)] + [(2, "all", [f"f{k}" for k in range(1000)])]
    circles = [(3, f"c{k}", [f"c{(k + 1) % 7}"]) for k in range(7)] + [(3, "after", ["c0", "free"]), (3, "free", []), (4, "own", ["own"])]
    braid = [(5, f"{s}{k}", [f"{t}{k - 1}" for t in "ab"] if k else []) for k in range(12) for s in "ab"]
    calls = chain + fan + circles + braid
    want = {(1, str(k)): k for k in range(5000)} | plain_levels(fan + circles + braid)
    assert got_levels(spark, calls) == want


def test_rounds_of_a_chain_grow_with_its_logarithm(spark, monkeypatch):
    written = []
    real = toolcalls.materialize
    monkeypatch.setattr(toolcalls, "materialize", lambda df, name: (written.append(len(df._jdf.queryExecution().analyzed().toString())), real(df, name))[1])
    got_levels(spark, [(1, str(k), [str(k - 1)] if k else []) for k in range(600)])
    assert len(written) <= 13 and max(written[1:]) < 1.2 * min(written[1:])  # plans don't grow


def test_null_identifiers_and_tables(spark):
    df = spark.createDataFrame([(None, 0, "a", "t", "{}", []), (1, 0, None, "t", "{}", ["a"]), (1, 1, "a", "t", "{}", None)], CALLS)
    results = spark.createDataFrame([(1, 2, "a", "x"), (None, 3, "a", "y"), (1, 4, None, "z")], "conv_id long, turn long, call_id string, content string")
    messages = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    rows = toolcalls.link(df, results, messages, {"t": {}}).collect()
    assert sorted((r.kind, str(r.conv_id), str(r.call_id), r.level, r.status) for r in rows) == [
        ("call", "1", "None", None, "unanswered"), ("call", "1", "a", 0, "linked"), ("call", "None", "a", None, "unanswered"), ("orphan", "1", "None", None, "orphan"), ("orphan", "None", "a", None, "orphan")]


def test_many_schemas_long_texts_and_clashing_columns(spark):
    schemas = {f"tool{k}": {f"field{j}": ("integer", j == 0) for j in range(30)} for k in range(100)}  # 3000 fields
    long = "words and more " * 60_000
    data = [
        (1, 0, "user", long, "v", "n", 9, "s"), (1, 1, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "tool99", "arguments": {"field0": 1, "field29": "x", "other": None}}, {"id": "b", "name": "tool7", "arguments": {}}]}), "v", "n", 9, "s"),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": long}), "v", "n", 9, "s"),
    ]
    rows = toolcalls.link(*toolcalls.parse_messages(spark.createDataFrame(data, MESSAGES)), schemas).collect()
    by = {r.call_id: r for r in rows}
    assert by["a"].errors == "type of field29; unknown other" and by["b"].errors == "missing field0" and by[None].canonical == json.dumps({"content": long, "role": "user"}, separators=(",", ":"))
    assert json.loads(by["a"].canonical) == {"arguments": {"field0": 1, "field29": "x", "other": None}, "id": "a", "name": "tool99", "result": long}


def test_plain_turns_and_real_calls_in_one_table(spark):
    real = [(k, 0, "assistant", json.dumps({"tool_calls": [{"id": "x", "name": "reply", "arguments": {"text": "t", "turn": 1}, "after": []}]})) for k in range(3)]
    turns = [(k, t, ["user", "assistant"][t % 2], f"text {t}") for k in (7, 8) for t in range(9)]
    df = spark.createDataFrame(real + turns, "conv_id long, turn long, role string, text string")
    calls, results, others = toolcalls.parse_messages(df)
    more = toolcalls.turns_as_calls(others)
    rows = toolcalls.link(calls.unionByName(more[0]), results.unionByName(more[1]), more[2], REPLY).collect()
    con = duckdb.connect()
    con.register("conversations", df.where("conv_id > 5").toPandas())
    names = ["conv_id", "turn", "call_id", "kind", "status", "level", "n_results", "errors", "canonical"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES['op8_toolcalls']})").fetchall()
    assert sorted((tuple(r[n] for n in names) for r in rows if r.conv_id > 5), key=str) == sorted(want, key=str)
    assert {(r.kind, r.status, r.level) for r in rows if r.conv_id < 5} == {("call", "unanswered", 0)}
    assert df.select(F.count("*")).first()[0] == len(real) + len(turns)
