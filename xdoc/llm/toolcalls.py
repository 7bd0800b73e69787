"""Tool calls linked to their results, in DataFrame expressions only.

Calls and results meet in a hash join by conversation and identifier; calls are
levelled so that each stands after those that it needs, in rounds that double
what is known of a chain; arguments are validated against schemas; each call is
written with its result as canonical JSON (sorted keys, no white space). Nothing
is gathered by conversation: order is carried by the columns level, turn and
call_id.

Defined results: of several results of a call the earliest counts (ties: the
smallest content), the number is given; a call id that calls share in a
conversation is reported, and each of them gets the result; a result without a
call is an orphan; a null or empty text is a message with that content; calls
that need each other, or something after such, have a null level; a call without
a conversation or an identifier is linked with nothing and has a null level; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, scratch

#: Types of a schema's fields and what the arguments' own types begin with.
TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL", "FLOAT"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"], "null": ["VOID"]}
#: Steps between two calls count up to this; only calls that need each other get there.
FAR = 1 << 40

CALL = "struct<id:string,name:string,arguments:variant,after:array<string>>"


def parse_messages(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and other messages of a conversation table.

    An assistant's text with a ``tool_calls`` list of {id, name, arguments, after} makes calls; a tool's text with a
    ``tool_call_id`` and ``content`` is a result; all else is a message.
    """
    base = messages.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    base = base.withColumn("v", F.when(F.col("text").rlike(r"^\s*\{"), F.try_parse_json("text")))
    calls = F.try_variant_get("v", "$.tool_calls", f"array<{CALL}>")
    called = F.coalesce(F.col("role") == "assistant", F.lit(False)) & F.coalesce(F.size(calls) > 0, F.lit(False))
    answered = F.coalesce(F.col("role") == "tool", F.lit(False)) & F.try_variant_get("v", "$.tool_call_id", "string").isNotNull()
    c = base.where(called).select("conv_id", "turn", F.explode(calls).alias("c")).select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.to_json("c.arguments").alias("arguments"), F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))
    r = base.where(answered).select("conv_id", "turn", F.try_variant_get("v", "$.tool_call_id", "string").alias("call_id"), F.coalesce(F.try_variant_get("v", "$.content", "string"), F.to_json(F.try_variant_get("v", "$.content", "variant"))).alias("content"))
    return c, r, base.where(~called & ~answered).select("conv_id", "turn", "role", "text")


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of plain chat: a user's turn calls ``reply``, the assistant's next turn is its result, and a call needs the one two turns before."""
    base = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    name = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    user, assistant = F.coalesce(F.col("role") == "user", F.lit(False)), F.coalesce(F.col("role") == "assistant", F.lit(False))
    arguments = F.to_json(F.struct(F.col("text"), F.col("turn")), {"ignoreNullFields": "false"})
    calls = base.where(user).select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.array(name(F.col("turn") - 2)).alias("after"))
    results = base.where(assistant).select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results, base.where(~user & ~assistant)


def canonical(arguments: Column) -> Column:
    """JSON with sorted keys and no white space; null where it can't be parsed."""
    return F.to_json(F.try_parse_json(arguments))


def errors(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with a call: schemas give each tool's fields as (type, required). They become one literal of the plan."""
    known = {tool: {f: {"fits": TYPES[t], "must": must} for f, (t, must) in fields.items()} for tool, fields in schemas.items()}
    fields = F.element_at(F.from_json(F.lit(json.dumps(known)), "map<string,map<string,struct<fits:array<string>,must:boolean>>>"), name)
    parsed = F.try_parse_json(arguments)
    given = F.try_variant_get(parsed, "$", "map<string,variant>")
    missing = F.transform(F.array_sort(F.array_except(F.map_keys(F.map_filter(fields, lambda _, f: f["must"])), F.map_keys(given))), lambda f: F.concat(F.lit("missing "), f))
    fits = lambda e: F.array_contains(F.element_at(fields, e["key"])["fits"], F.regexp_extract(F.schema_of_variant(e["value"]), "^[A-Z]+", 0))
    wrong = F.filter(F.map_entries(given), lambda e: ~F.coalesce(fits(e), F.lit(False)))
    bad = F.transform(wrong, lambda e: F.concat(F.when(F.element_at(fields, e["key"]).isNull(), "unknown ").otherwise("type of "), e["key"]))
    found = F.when(parsed.isNull(), F.array(F.lit("arguments are not JSON"))).when(given.isNull(), F.array(F.lit("arguments are not an object"))).when(fields.isNull(), F.array(F.lit("unknown tool")))
    return F.array_join(found.otherwise(F.concat(missing, F.array_sort(bad))), "; ")


def levels(calls: DataFrame) -> DataFrame:
    """Each distinct (conv_id, call_id) with its level: 0 where it needs no other call that exists, else one more than the highest it needs.

    A row (call, need, steps) says that the call stands ``steps`` levels or more after ``need``, or
    ``steps`` levels or more from the start where need is null. A call with rows of the latter kind
    alone has its level. In each round, a need whose level is known becomes a number, and one that
    itself waits for a single call is replaced by that call; so what is known of a chain doubles, and
    rounds grow with the logarithm of its length. Rounds read and write tables: no plan grows with them.
    Calls that wait for themselves never get a level, and rounds end when no call gets one.
    """
    spark, at = calls.sparkSession, scratch(calls.sparkSession, "levels")
    key = ["conv_id", "call_id"]
    nodes = calls.select(*key).where("conv_id IS NOT NULL AND call_id IS NOT NULL").distinct()
    needs = calls.select(*key, F.explode("after").alias("need")).distinct().join(nodes.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_semi")
    number = lambda n: F.lit(n).cast("long")
    state = materialize(nodes.select(*key, F.lit(None).cast("string").alias("need"), number(0).alias("steps")).union(needs.select(*key, "need", number(1))), "needs")
    schema, k = None, 0
    while True:
        waits = F.col("need").isNotNull()
        one = state.groupBy(*key).agg(F.count("need").alias("open"), F.max(F.when(~waits, F.col("steps"))).alias("floor"), F.max("need").alias("next"), F.max(F.when(waits, F.col("steps"))).alias("further"))
        one.write.parquet(f"{at}/round={k}", compression="zstd")
        schema = schema or one.schema
        one = spark.read.schema(schema).parquet(f"{at}/round={k}")
        found = one.agg(F.count_if(F.col("open") == 0).alias("done"), F.count_if(F.col("open") > 0).alias("left")).first()
        if not (found.done and found.left):
            break
        # what is known of a need: its level (next is null), or that it waits for one call that has none yet
        done = one.where("open = 0").select("conv_id", F.col("call_id").alias("next"), F.col("floor").alias("level"))
        single = one.where("open = 1").join(done, ["conv_id", "next"], "left")
        floor = F.greatest("floor", F.col("level") + F.col("further"))  # greatest skips nulls
        known = single.select("conv_id", F.col("call_id").alias("need"), floor.alias("floor"), F.when(F.col("level").isNull(), F.col("next")).alias("next"), "further")
        known = known.union(done.select("conv_id", "next", "level", F.lit(None).cast("string"), F.lit(None).cast("long"))).withColumn("known", F.lit(True))
        left = one.where("open > 0").select(*key, "floor")
        far = lambda c: F.least(F.col("steps") + F.col(c), number(FAR))
        entry = lambda need, steps: F.struct(need.cast("string").alias("need"), steps.cast("long").alias("steps"))
        unknown = F.col("known").isNull()
        new = F.when(unknown, F.array(entry(F.col("need"), F.col("steps")))).when(F.col("next").isNull(), F.array(entry(F.lit(None), far("floor")))).otherwise(F.array(entry(F.lit(None), far("floor")), entry(F.col("next"), far("further"))))
        moved = state.where(waits).join(known, ["conv_id", "need"], "left").select(*key, F.explode(new).alias("e")).select(*key, "e.need", "e.steps")
        moved = moved.union(left.select(*key, F.lit(None).cast("string"), "floor")).groupBy(*key, "need").agg(F.max("steps").alias("steps"))
        old, state, k = state, materialize(moved, "needs"), k + 1
        discard(old)
    discard(state)
    whole = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(at)
    return nodes.join(whole.where("open = 0").select(*key, F.col("floor").alias("level")), key, "left")


def link(calls: DataFrame, results: DataFrame, messages: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """A row per call, orphaned result and message, with canonical JSON."""
    calls = calls.withColumn("errors", errors(F.col("name"), F.col("arguments"), schemas))
    answers = results.where(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("first"), F.count(F.lit(1)).alias("n_results"))
    same = calls.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n_calls"))
    joined = calls.join(answers.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(same.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(levels(calls).hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    # canonical arguments are JSON already: written around them, with the other keys in order
    quoted = lambda c: F.coalesce(F.expr(f"substring(to_json(named_struct('a', {c})), 6, length(to_json(named_struct('a', {c}))) - 6)"), F.lit("null"))
    null_as = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(quoted(c))
    body = F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")), F.lit(',"id":'), null_as("call_id"), F.lit(',"name":'), null_as("name"), F.lit(',"result":'), null_as("content"), F.lit("}"))
    status = F.when(F.coalesce(F.col("n_calls"), F.lit(1)) > 1, "ambiguous").when(F.col("errors") != "", "invalid").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    called = joined.withColumn("content", F.col("first.content")).select("conv_id", "turn", "call_id", F.lit("call").alias("kind"), status.alias("status"), F.col("level").cast("long").alias("level"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "errors", body.alias("canonical"))
    ids = calls.select("conv_id", "call_id").distinct()
    orphaned = results.join(ids, ["conv_id", "call_id"], "left_anti")
    orphans = orphaned.select("conv_id", "turn", "call_id", F.lit("orphan").alias("kind"), F.lit("orphan").alias("status"), F.lit(None).cast("long").alias("level"), F.lit(1).cast("long").alias("n_results"), F.lit("").alias("errors"), F.concat(F.lit('{"id":'), null_as("call_id"), F.lit(',"result":'), null_as("content"), F.lit("}")).alias("canonical"))
    plain = messages.select("conv_id", "turn", F.lit(None).cast("string").alias("call_id"), F.lit("message").alias("kind"), F.lit("message").alias("status"), F.lit(None).cast("long").alias("level"), F.lit(0).cast("long").alias("n_results"), F.lit("").alias("errors"), F.concat(F.lit('{"content":'), null_as("text"), F.lit(',"role":'), null_as("role"), F.lit("}")).alias("canonical"))
    return called.union(orphans).union(plain)
