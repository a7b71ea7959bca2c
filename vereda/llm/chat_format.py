"""Tool-call linking in conversations, in DataFrame operations only.

Messages that call or answer carry an identifier. Calls are reduced to one owner for each identifier (the earliest), and
results are hash-joined to it. The order of a conversation is topological: a result that stands before its call moves
behind it. Arguments are parsed as JSON and checked against the schema of the called function (required names, types,
unknown names), and every message is serialised as canonical JSON: sorted names, no spaces, absent values left out.

No conversation is gathered in one task: a message's position is its rank among those of the same conversation and
stretch of 64 turns, plus the count of those in earlier stretches.
Defined cases: null conv_id is a conversation of its own; null turn comes last; null text is an absent content; a result
without call is an `orphan`, a later call with a used identifier a `repeated_call`, a later result of a call a
`repeated_result`; repeated rows get equal rows but for their position; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 64
#: The functions of the test conversations, where a user's turn calls for a reply: name -> parameter -> (type, required).
SCHEMAS = {"reply": {"text": ("STRING", True), "turn": ("BIGINT", True)}}


def schema_table(spark, schemas=None) -> DataFrame:
    rows = [(name, params) for name, params in (schemas or SCHEMAS).items()]
    return spark.createDataFrame(rows, "name string, params map<string, struct<type: string, required: boolean>>")


def canonical(json: Column) -> Column:
    """JSON text with sorted names and without spaces; null if it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def from_turns(conversations: DataFrame) -> DataFrame:
    """Messages of plain conversations: a user's turn calls `reply`, the assistant's next turn is its result."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    call = F.concat_ws(":", conv, F.col("turn").cast("string"))
    answer = F.concat_ws(":", conv, (F.col("turn") - 1).cast("string"))
    return conversations.select(
        "conv_id", "turn", "role", "text",
        F.when((F.col("role") == "user") & F.col("turn").isNotNull(), call).alias("call_id"),
        F.when((F.col("role") == "assistant") & F.col("turn").isNotNull(), answer).alias("result_of"),
        F.when(F.col("role") == "user", F.lit("reply")).alias("name"),
        F.when(F.col("role") == "user", F.to_json(F.struct("turn", "text"))).alias("arguments"),
    )


def from_json_chat(messages: DataFrame) -> DataFrame:
    """Messages whose text may be a JSON object with tool_calls [{id, name, arguments}] or tool_call_id and content."""
    form = "tool_calls array<struct<id: string, name: string, arguments: string>>, tool_call_id string, content string"
    parsed = messages.withColumn("_j", F.when(F.ltrim("text").startswith("{"), F.from_json("text", form)))
    calls = parsed.withColumn("_c", F.explode_outer("_j.tool_calls"))
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    return calls.select(
        "conv_id", "turn", "role", F.coalesce("_j.content", F.when(F.col("_j.tool_calls").isNull(), F.col("text"))).alias("text"),
        F.when(F.col("_c.id").isNotNull(), F.concat_ws(":", conv, "_c.id")).alias("call_id"),
        F.when(F.col("_j.tool_call_id").isNotNull(), F.concat_ws(":", conv, "_j.tool_call_id")).alias("result_of"),
        F.col("_c.name").alias("name"), F.col("_c.arguments").alias("arguments"),
    )


def faults(arguments: Column, params: Column) -> Column:
    """Sorted list of what is wrong with a call's arguments."""
    given = F.from_json(arguments, "map<string, variant>")
    names = F.coalesce(F.map_keys(given), F.array().cast("array<string>"))
    kinds = F.coalesce(F.map_from_entries(F.transform(F.map_entries(given), lambda e: F.struct(e["key"], F.schema_of_variant(e["value"])))), F.create_map().cast("map<string,string>"))
    wrong = F.flatten(
        F.array(
            F.transform(F.filter(F.map_entries(params), lambda e: e["value"]["required"] & ~F.array_contains(names, e["key"])), lambda e: F.concat(F.lit("missing "), e["key"])),
            F.transform(
                F.filter(F.map_entries(params), lambda e: F.array_contains(names, e["key"]) & ~F.coalesce(F.get(F.map_values(F.map_filter(kinds, lambda k, _: k == e["key"])), F.lit(0)).startswith(e["value"]["type"]), F.lit(False))),
                lambda e: F.concat(F.lit("type "), e["key"]),
            ),
            F.transform(F.filter(names, lambda k: ~F.array_contains(F.map_keys(params), k)), lambda k: F.concat(F.lit("unknown "), k)),
        )
    )
    return (
        F.when(params.isNull(), F.array(F.lit("unknown function")))
        .when(F.try_parse_json(arguments).isNull(), F.array(F.lit("no JSON")))
        .otherwise(F.array_sort(wrong))
    )


def link(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, kind, call_id, linked_turn, position, valid, faults, json.

    messages: conv_id, turn, role, text, call_id and result_of (null if none), name, arguments. An identifier belongs to
    its conversation: equal ones of two conversations, null among them, are different calls.
    """
    messages = messages.select("conv_id", "turn", "role", "text", "call_id", "result_of", "name", "arguments")
    last = F.lit(1 << 40)
    at = F.coalesce(F.col("turn").cast("long"), last)
    rank = F.struct(at.alias("at"), F.xxhash64("text", "role", "name", "arguments").alias("h"))
    messages = messages.withColumn("_rank", rank)
    conv = F.col("conv_id").cast("string")
    # The length before the conversation keeps its end apart from the identifier.
    within = lambda c: F.concat(F.coalesce(F.concat(F.length(conv).cast("string"), F.lit(":"), conv), F.lit("-")), c)
    owners = messages.where("call_id is not null").groupBy(within(F.col("call_id")).alias("_id")).agg(F.min("_rank").alias("_owner"))
    answers = messages.where("result_of is not null").groupBy(within(F.col("result_of")).alias("_id")).agg(F.min("_rank").alias("_answer"))
    pairs = owners.join(answers, "_id", "full").select("_id", "_owner", "_answer")
    key = within(F.coalesce("result_of", "call_id"))
    # Messages without an identifier take part in no join.
    linked = messages.where(key.isNotNull()).withColumn("_id", key).join(pairs, "_id", "left").drop("_id")
    alone = messages.where(key.isNull()).withColumns({"_owner": F.lit(None).cast(pairs.schema["_owner"].dataType), "_answer": F.lit(None).cast(pairs.schema["_answer"].dataType)})
    rows = linked.unionByName(alone)
    is_result, is_call = F.col("result_of").isNotNull(), F.col("call_id").isNotNull()
    kind = (
        F.when(is_result & F.col("_owner").isNull(), "orphan").when(is_result & (F.col("_rank") == F.col("_answer")), "result").when(is_result, "repeated_result")
        .when(is_call & (F.col("_rank") == F.col("_owner")), "call").when(is_call, "repeated_call").otherwise("message")
    )
    no_turn = lambda c: F.when(c == last, None).otherwise(c)
    linked_turn = F.when(is_result, no_turn(F.col("_owner.at"))).when(is_call, no_turn(F.col("_answer.at")))
    place = F.when(is_result & F.col("_owner").isNotNull(), F.greatest(at, F.col("_owner.at"))).otherwise(at)
    rows = rows.withColumns({"kind": kind, "linked_turn": linked_turn, "_place": place, "_after": F.when(is_result & F.col("_owner").isNotNull() & (at <= F.col("_owner.at")), 1).otherwise(0)})
    rows = rows.withColumn("_stretch", F.floor(F.col("_place") / STRETCH))

    counts = rows.groupBy("conv_id", "_stretch").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("conv_id").alias("_conv"), F.col("_stretch").alias("_s"), F.coalesce(before, F.lit(0)).alias("_before"))
    rows = rows.join(counts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_stretch") == F.col("_s")))
    own = Window.partitionBy("conv_id", "_stretch").orderBy("_place", "_after", at, "call_id", "result_of", "_rank")
    rows = rows.withColumn("position", F.col("_before") + F.row_number().over(own) - 1)

    rows = rows.join(schemas.select(F.col("name").alias("_name"), "params"), F.col("name") == F.col("_name"), "left")
    rows = rows.withColumn("_faults", F.when(is_call, faults(F.col("arguments"), F.col("params"))))
    json = (
        F.when(is_call, F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), "name", "role", F.col("turn"))))
        .when(is_result, F.to_json(F.struct(F.col("result_of").alias("call"), F.col("text").alias("content"), "role", "turn")))
        .otherwise(F.to_json(F.struct(F.col("text").alias("content"), "role", "turn")))
    )
    return rows.select(
        "conv_id", "turn", "role", "kind", F.coalesce("result_of", "call_id").alias("call_id"), "linked_turn", F.col("position").cast("long").alias("position"),
        (F.col("_faults").isNull() | (F.size("_faults") == 0)).alias("valid"), F.coalesce(F.array_join("_faults", "; "), F.lit("")).alias("faults"), json.alias("json"),
    )


def oracle() -> str:
    """The same for conversations whose turns are unique, with the functions of SCHEMAS, in DuckDB."""
    return """
WITH m AS (SELECT conv_id, turn, role, text,
    CASE WHEN role = 'user' THEN conv_id || ':' || turn END AS call_id, CASE WHEN role = 'assistant' THEN conv_id || ':' || (turn - 1) END AS result_of FROM conversations),
l AS (SELECT m.*, c.turn AS call_turn, r.turn AS result_turn FROM m LEFT JOIN m c ON c.call_id = m.result_of LEFT JOIN m r ON r.result_of = m.call_id)
SELECT conv_id, turn, role,
  CASE WHEN result_of IS NOT NULL AND call_turn IS NULL THEN 'orphan' WHEN result_of IS NOT NULL THEN 'result' WHEN call_id IS NOT NULL THEN 'call' ELSE 'message' END AS kind,
  coalesce(result_of, call_id) AS call_id, coalesce(call_turn, result_turn) AS linked_turn,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position,
  (call_id IS NULL OR text IS NOT NULL) AS valid, CASE WHEN call_id IS NOT NULL AND text IS NULL THEN 'missing text' ELSE '' END AS faults,
  CASE WHEN call_id IS NOT NULL THEN to_json({'arguments': {'text': text, 'turn': turn}, 'id': call_id, 'name': 'reply', 'role': role, 'turn': turn})
       WHEN result_of IS NOT NULL THEN to_json({'call': result_of, 'content': text, 'role': role, 'turn': turn})
       ELSE to_json({'content': text, 'role': role, 'turn': turn}) END::VARCHAR AS json
FROM l"""
