"""Chat formatting: tool calls linked to results, in topological order, as
canonical JSON.

Messages come one a row; a message may be a call (``call_id``, ``tool``,
``arguments`` as JSON text, ``after``: the call whose result it needs) or a
result (``result_for``).  Calls and results meet in hash joins on
conversation and identifier, so the same identifier in two conversations is
two calls.  A call that repeats an identifier of its conversation, and a
further result of a call, are marked and stay; the first by turn links.  The level of a message
is its number of ancestors (a result's call, the result or else the call
that a call needs), found by pointer doubling in joins, so a chain of n
messages takes log2(n) rounds and no conversation is gathered anywhere.
Messages of a cycle have no level and come last.

position numbers the messages of a conversation by (level, turn, JSON), a
topological order, by two-level counting.  Canonical JSON has its keys in
order, no white space and no null fields.

Repeated rows are one message.  Null turns come first in their level; null
identifiers link nothing; null conversations are one of their own; null
texts leave out the content.  A call keeps its text as content next to the
call; arguments that don't parse as JSON stay as the text that they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.operators._util import null_safe_join, ordered_index
from mercato.session import materialize

TURNS_PER_TASK = 1024
LAST = (1 << 31) - 1


def valid_arguments(tool: str, arguments: str, schemas: dict[str, dict[str, tuple]]) -> Column:
    """True where the arguments are an object that fits the tool's schema:
    parameter -> (type name of Spark's schema_of_variant, required)."""
    value = F.try_parse_json(arguments)
    ok = F.lit(False)
    for name, parameters in schemas.items():
        fits = F.coalesce(F.size(F.array_except(
            F.json_object_keys(arguments), F.array(*map(F.lit, parameters)))) == 0, F.lit(False))
        for parameter, (kind, required) in parameters.items():
            part = F.variant_get(value, f"$.{parameter}", "variant")
            right = F.schema_of_variant(part) == kind
            fits = fits & F.coalesce(right, F.lit(not required))
        ok = F.when(F.col(tool) == name, fits).otherwise(ok)
    return F.when(F.col(tool).isNotNull(), ok)


def _levels(nodes: DataFrame) -> DataFrame:
    """(node, level) from (node, parent); level is null in a cycle."""
    state = materialize(nodes.select("node", F.col("parent").alias("jump"),
                                     F.when(F.col("parent").isNull(), 0).otherwise(1).alias("level")))
    rounds = max(1, state.count()).bit_length() + 1
    for _ in range(rounds):
        going = state.where("jump IS NOT NULL")
        if going.isEmpty():
            break
        at = state.select(F.col("node").alias("jump"), F.col("jump").alias("__next"),
                          F.col("level").alias("__more"))
        moved = going.join(at, "jump").select("node", F.col("__next").alias("jump"),
                                              (F.col("level") + F.col("__more")).alias("level"))
        state = materialize(state.where("jump IS NULL").union(moved))
    return state.select("node", F.when(F.col("jump").isNull(), F.col("level")).alias("level"))


def _within(rows: DataFrame, stats: DataFrame, identifier: str) -> DataFrame:
    """``rows`` with what ``stats`` has for the identifier in the same
    conversation."""
    return null_safe_join(rows, stats, ["conv_id", identifier], "left", equal=[identifier])


def formatted(messages: DataFrame, schemas: dict[str, dict[str, tuple]]) -> DataFrame:
    """(conv_id, turn, role, position, level, status, arguments_ok, json) of
    every message: conv_id, turn, role, text, call_id, tool, arguments,
    after, result_for."""
    body = ["conv_id", "turn", "role", "text", "call_id", "tool", "arguments", "after", "result_for"]
    parsed = F.coalesce(F.try_parse_json("arguments"), F.col("arguments").cast("variant"))
    call = F.when(F.col("call_id").isNotNull(), F.array(F.struct(
        parsed.alias("arguments"), F.col("call_id").alias("id"), F.col("tool").alias("name"))))
    rows = messages.select(*body).distinct().withColumn("json", F.to_json(F.struct(
        F.col("text").alias("content"), "role",
        F.col("result_for").alias("tool_call_id"), call.alias("tool_calls"))))
    rows = materialize(rows.withColumn("node", F.md5(F.to_json(F.struct(*body)).cast("binary"))))
    first = F.min(F.struct("turn", "node"))
    calls = (rows.where("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(first.alias("f"))
             .select("conv_id", "call_id", F.col("f.node").alias("call_node")))
    results = (rows.where("result_for IS NOT NULL").groupBy("conv_id", "result_for")
               .agg(first.alias("f"))
               .select("conv_id", "result_for", F.col("f.node").alias("result_node")))
    needed = (_within(calls, results.withColumnRenamed("result_for", "call_id"), "call_id")
              .select("conv_id", F.col("call_id").alias("after"),
                      F.coalesce("result_node", "call_node").alias("needed_node"),
                      F.col("result_node").isNotNull().alias("answered")))
    linked = _within(_within(rows, calls, "call_id"), results, "result_for")
    linked = _within(linked, needed.drop("answered"), "after")
    linked = _within(linked, needed.select("conv_id", F.col("after").alias("call_id"), "answered"),
                     "call_id")
    linked = _within(linked, calls.select("conv_id", F.col("call_id").alias("result_for"),
                                          F.col("call_node").alias("asked_node")), "result_for")
    is_call, is_result = F.col("call_id").isNotNull(), F.col("result_for").isNotNull()
    parent = (F.when(is_result, F.col("asked_node"))
              .when(is_call & (F.col("call_node") == F.col("node")), F.col("needed_node")))
    status = (F.when(is_result & F.col("asked_node").isNull(), "orphan_result")
              .when(is_result & (F.col("result_node") != F.col("node")), "repeated_result")
              .when(is_result, "linked")
              .when(is_call & (F.col("call_node") != F.col("node")), "repeated_call")
              .when(is_call & F.col("answered"), "linked")
              .when(is_call, "open").otherwise("plain"))
    linked = materialize(linked.withColumns({"parent": parent, "status": status}))
    levels = _levels(linked.select("node", "parent"))
    done = linked.join(levels, "node").select(
        "conv_id", "turn", "role", "level",
        F.when(F.col("level").isNull(), "cycle").otherwise(F.col("status")).alias("status"),
        valid_arguments("tool", "arguments", schemas).alias("arguments_ok"), "json",
        F.coalesce("level", F.lit(LAST)).alias("__rank"))
    block = F.struct("__rank", F.floor(F.col("turn") / TURNS_PER_TASK))
    return ordered_index(done, "__rank", ["conv_id"], block, "position",
                         ["turn", "json"]).drop("__rank")
