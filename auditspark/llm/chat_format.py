"""Chat formatting: tool calls linked to results, ordered, validated and written as canonical JSON.

Calls and results meet in a join on their conversation and identifier. Calls may wait for other
calls; peeling off, round by round, those that wait for nothing left gives each its level. Arguments
are compared with the tool's schema as rows, one per field. Everything is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import stored


def levels(calls: DataFrame) -> DataFrame:
    """(``conv_id``, ``call_id``, ``level``): 0 for calls that wait for none, else one more than the
    latest waited for. Calls that wait for each other in a circle get null. An identifier in
    ``after`` that no call of the conversation has is no wait."""
    names = calls.select("conv_id", "call_id").distinct()
    waits = stored(calls.select("conv_id", "call_id", F.explode("after").alias("first")).distinct().join(
        names.withColumnRenamed("call_id", "first"), ["conv_id", "first"], "left_semi"))
    done = stored(names.join(waits, ["conv_id", "call_id"], "left_anti").withColumn(
        "level", F.lit(0)))
    left = waits
    level = 0
    while left.limit(1).count():
        # waits whose first call is placed are met; calls all of whose waits are met come next
        open_waits = stored(left.join(
            done.select("conv_id", F.col("call_id").alias("first")), ["conv_id", "first"], "left_anti"))
        ready = left.select("conv_id", "call_id").distinct().join(
            open_waits.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")
        level += 1
        placed = stored(ready.withColumn("level", F.lit(level)))
        if not placed.limit(1).count():
            circle = left.select("conv_id", "call_id").distinct().withColumn(
                "level", F.lit(None).cast("int"))
            return done.unionByName(circle)
        done = done.unionByName(placed)
        left = open_waits
    return done


def _fits(kind: Column, wanted: Column) -> Column:
    """Whether a value of SQL type ``kind`` is of the schema type ``wanted``."""
    return (F.when(wanted == "string", kind == "STRING")
            .when(wanted == "integer", kind == "BIGINT")
            .when(wanted == "number", kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))
            .when(wanted == "boolean", kind == "BOOLEAN")
            .when(wanted == "array", kind.startswith("ARRAY"))
            .when(wanted == "object", kind.startswith("OBJECT"))
            .otherwise(F.lit(True)))


def problems(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(``conv_id``, ``call_id``, ``turn``, ``problems``) of calls whose arguments break their schema.

    ``schemas`` has a row per tool and field: ``name``, ``field``, ``type``, ``required``. Arguments
    that are no JSON object, unknown tools, missing and unknown fields and wrong types are problems.
    """
    parsed = calls.select("conv_id", "call_id", "turn", "name",
                          F.try_parse_json("arguments").alias("v"))
    key = ["conv_id", "call_id", "turn"]
    object_ = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    broken = parsed.where(~object_).select(*key, F.lit("arguments are no object").alias("problem"))
    known = schemas.select("name").distinct()
    unknown = parsed.join(known, "name", "left_anti").select(
        *key, F.concat(F.lit("unknown tool "), F.coalesce("name", F.lit("null"))).alias("problem"))
    sound = parsed.where(object_).join(known, "name", "left_semi")
    given = sound.select(*key, "name", F.explode(
        F.expr("cast(v as map<string, variant>)")).alias("field", "value")).select(
        *key, "name", "field", F.schema_of_variant("value").alias("kind"))
    checked = given.join(schemas, ["name", "field"], "left")
    wrong = checked.where(F.col("type").isNull() | ~_fits(F.col("kind"), F.col("type"))).select(
        *key, F.when(F.col("type").isNull(), F.concat(F.lit("unknown field "), "field")).otherwise(
            F.concat(F.col("field"), F.lit(" is no "), F.col("type"))).alias("problem"))
    wanted = sound.join(schemas.where("required"), "name").select(*key, "field")
    missing = wanted.join(given.select(*key, "field"), [*key, "field"], "left_anti").select(
        *key, F.concat(F.lit("missing field "), "field").alias("problem"))
    every = broken.unionByName(unknown).unionByName(wrong).unionByName(missing)
    return every.groupBy(*key).agg(F.array_sort(F.collect_set("problem")).alias("problems"))


def format_chats(messages: DataFrame, calls: DataFrame, results: DataFrame,
                 schemas: DataFrame) -> DataFrame:
    """One row per message, call and result: ``conv_id``, ``level``, ``turn``, ``kind``, ``call_id``,
    ``status``, ``problems`` and canonical ``json``.

    Within a conversation rows are read by (``level``, ``turn``, ``kind``): messages without a call
    keep level 0. ``messages``: ``conv_id``, ``turn``, ``role``, ``text``. ``calls``: ``conv_id``,
    ``call_id``, ``turn``, ``name``, ``arguments`` (JSON), ``after`` (identifiers). ``results``:
    ``conv_id``, ``call_id``, ``turn``, ``content``. A call is ``linked`` or ``unanswered``, a
    result ``linked`` or ``orphan``; a result of a conversation's identifier that two calls bear
    links to both. Null identifiers link to nothing. Canonical JSON has sorted keys, no white
    space and no null values; arguments that are no JSON stay a string. Repeated rows stay, except
    among the calls and results of one identifier, turn and content, which count once. Empty
    tables give an empty table.
    """
    calls = calls.dropDuplicates(["conv_id", "call_id", "turn", "name", "arguments"])
    results = results.dropDuplicates(["conv_id", "call_id", "turn", "content"])
    answered = results.where("call_id IS NOT NULL").select("conv_id", "call_id").distinct().withColumn(
        "answered", F.lit(True))
    ordered = levels(calls.where("call_id IS NOT NULL"))
    found = problems(calls.where("call_id IS NOT NULL"), schemas)
    linked = (calls.join(ordered, ["conv_id", "call_id"], "left")
              .join(answered, ["conv_id", "call_id"], "left")
              .join(found, ["conv_id", "call_id", "turn"], "left"))
    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.to_json(F.struct(
        F.col("arguments").alias("text"))))
    none = F.array().cast("array<string>")
    as_json = lambda **fields: F.to_json(F.struct(*[
        v.alias(k) for k, v in sorted(fields.items())]))
    call_rows = linked.select(
        "conv_id", "level", "turn", F.lit("call").alias("kind"), "call_id",
        F.when(F.col("answered"), "linked").otherwise("unanswered").alias("status"),
        F.coalesce("problems", none).alias("problems"),
        F.concat(F.lit('{"arguments":'), F.coalesce(arguments, F.lit("{}")), F.lit(","), F.substring(
            as_json(id=F.col("call_id"), name=F.col("name"), role=F.lit("call")),
            F.lit(2), F.lit(2_000_000_000))).alias("json"))
    of_call = ordered.select("conv_id", "call_id", "level").withColumn("known", F.lit(True))
    result_rows = results.join(of_call, ["conv_id", "call_id"], "left").select(
        "conv_id", "level", "turn", F.lit("result").alias("kind"), "call_id",
        F.when(F.col("known"), "linked").otherwise("orphan").alias("status"), none.alias("problems"),
        as_json(content=F.col("content"), id=F.col("call_id"), role=F.lit("result")).alias("json"))
    plain = messages.select(
        "conv_id", F.lit(0).alias("level"), "turn", F.lit("message").alias("kind"),
        F.lit(None).cast("string").alias("call_id"), F.lit("plain").alias("status"),
        none.alias("problems"),
        as_json(content=F.col("text"), role=F.col("role")).alias("json"))
    return plain.unionByName(call_rows).unionByName(result_rows)


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Messages, calls, results and schemas that a table of turns stands for.

    A user's turn asks the tool ``reply`` and bears the conversation and turn as identifier; the
    assistant's next turn is its result. Later questions wait for the conversation's first. Other
    roles are plain messages. A turn without conversation or number has no identifier: it stays and
    links to nothing.
    """
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    asked = conversations.where("role = 'user'")
    opening = asked.groupBy("conv_id").agg(F.min("turn").alias("__first"))
    calls = asked.join(opening, "conv_id", "left").select(
        "conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"),
        F.to_json(F.struct(F.length("text").alias("chars"), F.col("text"))).alias("arguments"),
        F.when(F.col("turn") > F.col("__first"), F.array(name(F.col("__first")))).otherwise(
            F.array().cast("array<string>")).alias("after"))
    results = conversations.where("role = 'assistant'").select(
        "conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    plain = conversations.where("role IS NULL OR role NOT IN ('user', 'assistant')").select(
        "conv_id", "turn", "role", "text")
    schemas = conversations.sparkSession.createDataFrame(
        [("reply", "chars", "integer", True), ("reply", "text", "string", True)],
        "name string, field string, type string, required boolean")
    return plain, calls, results, schemas
