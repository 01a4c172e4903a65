"""Chat formatting with tool-call linking, with DataFrame functions only.

Messages that carry tools are JSON objects in ``text``:

* assistant: ``{"content": ..., "tool_calls": [{"id", "name", "arguments", "depends_on": [ids]}]}``
* tool: ``{"tool_call_id": ..., "content": ...}``
* system: ``{"content": ..., "tools": [{"name", "parameters": <JSON schema>}]}``

Any other text is plain content. Calls and results are hash-joined by (conversation, id).
Arguments are checked against the schema of their tool, objects and arrays in them to any
depth: types (one or a list), enumerations, bounds, required names, and no further names where
the schema forbids them. Where a schema asks for more than this (``NOT_CHECKED``) and nothing
checked is wrong, the verdict is null. Messages get a topological order, (order_turn,
order_level, turn): a result stands after its call, a call after the results that it depends
on, and turns decide otherwise. Each message is one row of canonical JSON (keys sorted, no
spaces), so a conversation of any length gathers in no task; plain messages pass without a
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .common import hash128

CALLS = "struct<content: string, tool_calls: array<struct<id: string, name: string, arguments: string, depends_on: array<string>>>>"
RESULT = "struct<tool_call_id: string, content: string>"
TOOLS = "struct<content: string, tools: array<struct<name: string, parameters: string>>>"
SCHEMA = "struct<type: string, enum: string, minimum: double, maximum: double, required: array<string>, properties: map<string, string>, additionalProperties: string, items: string>"
#: JSON type of a schema, and the types of a parsed value that it admits; whole numbers count as integers however they are written.
TYPES = {"string": "STRING", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "null": "VOID", "array": "ARRAY<.*", "object": "OBJECT<.*"}
#: Keywords of schemas that are not checked.
NOT_CHECKED = """
    $ref $dynamicRef allOf anyOf oneOf not if const pattern format minLength maxLength exclusiveMinimum exclusiveMaximum multipleOf minItems maxItems
    uniqueItems contains prefixItems minProperties maxProperties patternProperties propertyNames dependentRequired dependentSchemas
""".split()


def _wrong(value: str) -> F.Column:
    """Whether the parsed JSON ``value`` breaks the schema node ``s`` itself; what is inside it is a node of its own."""
    kind = f"schema_of_variant({value})"
    number = f"try_variant_get({value}, '$', 'double')"
    whole = f"coalesce({kind} = 'BIGINT' OR {kind} RLIKE '^DECIMAL\\\\([0-9]+,0\\\\)$' OR ({kind} RLIKE '^({TYPES['number']})$' AND {number} = floor({number})), false)"
    admits = " OR ".join([*(f"(t = '{t}' AND {kind} RLIKE '^({v})$')" for t, v in TYPES.items()), f"(t = 'integer' AND {whole})"])
    types = "if(s.type LIKE '[%', from_json(s.type, 'array<string>'), array(s.type))"
    keys = f"coalesce(json_object_keys(to_json({value})), cast(array() as array<string>))"
    return F.expr(f"""
        (s.type IS NOT NULL AND NOT exists({types}, t -> {admits}))
        OR (s.enum IS NOT NULL AND NOT array_contains(transform(from_json(s.enum, 'array<string>'), x -> coalesce(x, 'null')), coalesce(try_variant_get({value}, '$', 'string'), 'null')))
        OR coalesce({number} < s.minimum OR {number} > s.maximum, false)
        OR ({kind} LIKE 'OBJECT<%' AND (
             size(array_except(coalesce(s.required, cast(array() as array<string>)), {keys})) > 0
             OR (coalesce(s.additionalProperties = 'false', false) AND size(array_except({keys}, coalesce(map_keys(s.properties), cast(array() as array<string>)))) > 0)))""")


def _checked(calls: DataFrame, tools: DataFrame, scratch: Scratch) -> DataFrame:
    """``calls`` with ``valid``: false if arguments break the schema, null if the tool has none or it asks for more than is checked.

    Nodes, values with their schemas, are checked level by level; there are as many rounds
    as schemas are deep where arguments follow them.
    """
    known = tools.groupBy("conv", "name").agg(F.min("parameters").alias("parameters"))  # of repeated tools the first by text
    asked = scratch.save(calls.join(known, ["conv", "name"]).select("a", "b", "idx", "arguments", "parameters"))
    shaped = F.json_object_keys("arguments").isNotNull() & F.expr("try_parse_json(arguments)").isNotNull()
    verdicts = asked.select("a", "b", "idx", F.coalesce(~shaped, F.lit(True)).alias("wrong"), F.lit(False).alias("open"))
    more = " OR ".join(f"array_contains(json_object_keys(schema), '{k}')" for k in NOT_CHECKED)
    nodes = asked.where(shaped).select("a", "b", "idx", F.expr("try_parse_json(arguments)").alias("v"), F.col("parameters").alias("schema"))
    while True:
        nodes = scratch.save(nodes.withColumn("s", F.from_json("schema", SCHEMA)))
        if not nodes.limit(1).count():
            break
        verdicts = verdicts.unionByName(nodes.select("a", "b", "idx", F.coalesce(_wrong("v"), F.lit(False)).alias("wrong"), F.coalesce(F.expr(more), F.lit(False)).alias("open")))
        inside = nodes.lateralJoin(nodes.sparkSession.tvf.variant_explode(F.col("v").outer()))
        schema = F.expr("if(key IS NULL, s.items, coalesce(s.properties[key], if(s.additionalProperties LIKE '{%', s.additionalProperties, NULL)))")
        nodes = inside.select("a", "b", "idx", F.col("value").alias("v"), schema.alias("schema")).where("schema IS NOT NULL")
    found = verdicts.groupBy("a", "b", "idx").agg(F.max("wrong").alias("wrong"), F.max("open").alias("open"))
    valid = F.when(F.col("wrong"), F.lit(False)).when(~F.col("open"), F.lit(True))
    return calls.join(found.select("a", "b", "idx", valid.alias("valid")), ["a", "b", "idx"], "left")


def _levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, id, at, level): the effective turn of each call and how many calls it stands behind there.

    Where all calls of a conversation depend on earlier turns only, each has its own turn.
    Conversations with a call that depends on its own or a later turn are ordered round by
    round, each placing what has become ready: as many rounds as the longest chain among
    these. Calls in or behind a cycle keep their own turn; ids that no call of the
    conversation has are ignored.
    """
    first = scratch.save(calls.groupBy("conv", "id").agg(F.min(F.struct("turn", "idx", "depends_on")).alias("f")).select("conv", "id", "f.turn", "f.depends_on"))
    there = first.select("conv", F.col("id").alias("dep"), F.col("turn").alias("dep_turn"))
    every = scratch.save(first.select("conv", "id", "turn", F.explode("depends_on").alias("dep")).where("id <> dep").distinct().join(there, ["conv", "dep"]))
    late = every.where("dep_turn >= turn").select("conv").distinct()
    edges = scratch.save(every.join(late, "conv", "left_semi").drop("dep_turn"))
    settled = scratch.save(first.join(edges, ["conv", "id"], "left_anti").select("conv", "id", F.col("turn").alias("at"), F.lit(0).alias("level")))
    while True:
        before = settled.select("conv", F.col("id").alias("dep"), "at", (F.col("level") + 1).alias("level"))
        ready = edges.join(before, ["conv", "dep"], "left").groupBy("conv", "id", "turn").agg(F.count("*").alias("n"), F.count("at").alias("k"), F.max(F.struct("at", "level")).alias("need")).where("n = k")
        place = F.greatest(F.struct(F.col("turn").alias("at"), F.lit(0).alias("level")), F.col("need"))
        ready = scratch.save(ready.select("conv", "id", place.alias("p")).select("conv", "id", "p.at", "p.level"))
        if not ready.limit(1).count():
            return settled.unionByName(edges.select("conv", "id", F.col("turn").alias("at"), F.lit(0).alias("level")).distinct())
        settled = settled.unionByName(ready)
        edges = scratch.save(edges.join(ready, ["conv", "id"], "left_anti"))


def format_messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, order_turn, order_level, status, n_calls, n_invalid, json): one row for each message.

    ``status`` is plain, call, result (its call is there) or orphan (a result without one).
    Defined results: a null text is null content and left out of the JSON; a null or unknown role counts as
    plain; text that is not JSON of the forms above is plain content; of calls that share an
    id the first holds it; all results of a call are linked; repeated messages are repeated
    rows; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(conversations.sparkSession, "chat")
    base = conversations.select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    looks = F.coalesce(F.col("text").rlike(r"^\s*\{"), F.lit(False))
    base = base.withColumn("calls", F.when((F.col("role") == "assistant") & looks, F.from_json("text", CALLS)))
    base = base.withColumn("result", F.when((F.col("role") == "tool") & looks, F.from_json("text", RESULT)))
    kind = F.when(F.size("calls.tool_calls") > 0, "call").when(F.col("result.tool_call_id").isNotNull(), "result").otherwise("plain")
    base = base.withColumn("kind", F.coalesce(kind, F.lit("plain")))

    plain = base.where("kind = 'plain'").select(
        F.col("conv").alias("conv_id"), "turn", "role", F.col("turn").alias("order_turn"), F.lit(0).alias("order_level"), F.lit("plain").alias("status"),
        F.lit(0).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_invalid"), F.to_json(F.struct(F.col("text").alias("content"), "role")).alias("json"),
    )

    a, b = hash128("conv", "turn", "text")
    messages = base.where("kind = 'call'").select("conv", "turn", "role", a.alias("a"), b.alias("b"), F.col("calls.content").alias("content"), "calls.tool_calls")
    calls = messages.dropDuplicates(["a", "b"]).select("conv", "turn", "a", "b", F.posexplode("tool_calls").alias("idx", "c")).select("conv", "turn", "a", "b", "idx", "c.*")
    tools = base.where("role = 'system'").where(looks).select("conv", F.explode(F.from_json("text", TOOLS)["tools"]).alias("t")).select("conv", "t.*").where("parameters is not null")
    calls = scratch.save(_checked(scratch.save(calls), tools, scratch))
    levels = scratch.save(_levels(calls.where("id is not null"), scratch))

    canonical = F.coalesce(F.expr("to_json(try_parse_json(arguments))"), F.col("arguments"))
    item = F.struct(canonical.alias("arguments"), "id", "name", "valid")
    placed = calls.join(levels, ["conv", "id"], "left").groupBy("a", "b").agg(
        F.max(F.struct(F.coalesce("at", "turn").alias("at"), F.coalesce("level", F.lit(0)).alias("level"))).alias("p"), F.array_sort(F.collect_list(F.struct("idx", item.alias("item")))).alias("items"), F.count_if(F.col("valid") == F.lit(False)).alias("n_invalid"))  # one message's calls
    called = messages.join(placed, ["a", "b"]).select(
        F.col("conv").alias("conv_id"), "turn", "role", F.col("p.at").alias("order_turn"), (2 * F.col("p.level")).alias("order_level"), F.lit("call").alias("status"),
        F.size("items").cast("long").alias("n_calls"), F.col("n_invalid").cast("long"), F.to_json(F.struct("content", "role", F.transform("items", lambda x: x["item"]).alias("tool_calls"))).alias("json"),
    )
    results = base.where("kind = 'result'").select("conv", "turn", "role", F.col("result.tool_call_id").alias("id"), F.col("result.content").alias("content"))
    results = results.join(levels, ["conv", "id"], "left").select(
        F.col("conv").alias("conv_id"), "turn", "role", F.coalesce("at", "turn").alias("order_turn"), F.coalesce(2 * F.col("level") + 1, F.lit(0)).alias("order_level"), F.when(F.col("at").isNull(), "orphan").otherwise("result").alias("status"),
        F.lit(0).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_invalid"), F.to_json(F.struct("content", "role", F.col("id").alias("tool_call_id"))).alias("json"),
    )
    return plain.unionByName(called).unionByName(results)
