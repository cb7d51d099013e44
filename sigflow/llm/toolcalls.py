"""Linking tool calls with their results in chats, DataFrame functions only.

Calls and results meet in a hash join on (conversation, identifier). A call
may follow another one; the links form a forest whose topological depth is
found by pointer doubling, so a chain of n calls takes about log2(n) joins.
Arguments are parsed and checked against the tool's schema, and every linked
call is written as canonical JSON: sorted keys, no blanks. Output is a row per
call or left-over result, never a row per conversation, so a conversation may
be of any length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigflow.llm.common import materialise
from sigflow.operators.components import heavy_keys, lookup
from sigflow.session import cut_lineage

KEY = ["conv_id", "call_id"]


def argument_errors(arguments: Column, schema: dict) -> Column:
    """Sorted faults of a variant object against {field: (type, required,
    least, most)}; types are STRING (limits on its length), BIGINT (limits on
    its value) or BOOLEAN. Fields outside the schema are faults."""
    faults = []
    for field, (kind, required, least, most) in sorted(schema.items()):
        value = F.try_variant_get(arguments, f"$.{field}", "variant")
        found = F.when(F.is_variant_null(value), "VOID").otherwise(F.schema_of_variant(value))
        if required:
            faults.append(F.when(found.isNull(), f"missing {field}"))
        faults.append(F.when(found.isNotNull() & (found != kind), f"type {field}"))
        if kind != "BOOLEAN":
            size = (F.char_length(F.try_variant_get(arguments, f"$.{field}", "string")) if kind == "STRING"
                    else F.try_variant_get(arguments, f"$.{field}", "bigint"))
            for limit, beyond in ((least, size < least if least is not None else None),
                                  (most, size > most if most is not None else None)):
                if limit is not None:
                    faults.append(F.when((found == kind) & beyond, f"range {field}"))
    keys = F.coalesce(F.json_object_keys(F.to_json(arguments)), F.array().cast("array<string>"))
    extra = F.transform(F.array_except(keys, F.array(*[F.lit(f) for f in schema])),
                        lambda k: F.concat(F.lit("unknown "), k))
    return F.array_sort(F.array_union(F.array_compact(F.array(*faults)), extra))


def depths(calls: DataFrame) -> DataFrame:
    """(row, depth, cyclic) of calls with a unique (conv_id, call_id), by
    pointer doubling over ``after``. A call without ``after``, or whose
    predecessor is not there, has depth 0."""
    n = calls.count()
    names = calls.select("conv_id", F.col("call_id").alias("after"), F.col("row").alias("up"))
    asks = calls.select("row", "conv_id", "after")
    state = cut_lineage(
        lookup(asks, names, ["conv_id", "after"], "left", heavy_keys(asks, ["conv_id", "after"], n))
        .select("row", "up", F.col("up").isNotNull().cast("long").alias("depth")))
    for _ in range(max(1, math.ceil(math.log2(n + 1))) + 1):
        if state.where(F.col("up").isNotNull()).isEmpty():
            break
        above = state.select(F.col("row").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"))
        # rows at a root already need no join
        open_ = state.where(F.col("up").isNotNull())
        state = cut_lineage(
            lookup(open_, above, ["up"], heavy=heavy_keys(open_, ["up"], n))
            .select("row", F.col("top").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
            .unionByName(state.where(F.col("up").isNull())))
    return state.select("row", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"),
                        F.col("up").isNotNull().alias("cyclic"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call and per left-over result: conv_id, call_id, turn, depth
    (topological; NULL in a cycle and for results), status, errors and json.

    ``calls``: conv_id, call_id, after, name, arguments (JSON text), turn;
    ``results``: conv_id, call_id, content, turn. Of calls (results) with the
    same conversation and identifier the first by turn, then by content, takes
    part; the others are ``duplicate_call`` (``extra_result``). A NULL
    conversation or identifier links to nothing: ``no_identifier``. Then, in
    this order: ``bad_json`` (not a JSON object), ``unknown_tool``,
    ``invalid_arguments``, ``cyclic``, ``unanswered``, ``ok``; a result without
    a call is an ``orphan_result``. Empty tables give empty results; other
    columns are not read."""
    calls = materialise(calls.select(*KEY, "after", "name", "arguments", "turn")
                        .withColumn("row", F.monotonically_increasing_id()), "calls")
    results = materialise(results.select(*KEY, "content", "turn")
                          .withColumn("row", F.monotonically_increasing_id()), "results")

    def first(df: DataFrame, content: str) -> DataFrame:
        named = df.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
        lead = named.groupBy(*KEY).agg(F.min(F.struct(
            F.col("turn").isNull(), F.col("turn"), F.xxhash64(content), F.col("row").alias("row")))["row"].alias("lead"))
        seen = lookup(named, lead, KEY, heavy=heavy_keys(named, KEY, named.count()))
        return seen.withColumn("again", F.col("row") != F.col("lead")).drop("lead").unionByName(
            df.where(F.col("conv_id").isNull() | F.col("call_id").isNull())
            .withColumn("again", F.lit(None).cast("boolean")))

    calls, results = materialise(first(calls, "arguments"), "calls"), materialise(first(results, "content"), "results")
    unique = calls.where(F.col("again") == F.lit(False))
    answer = results.where(F.col("again") == F.lit(False)).select(*KEY, "content", F.lit(True).alias("answered"))
    linked = (unique.join(answer, KEY, "left").join(depths(unique), "row", "left")
              .unionByName(calls.where("again or again is null"), allowMissingColumns=True))
    parsed = F.try_parse_json("arguments")
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    linked = linked.withColumn("variant", F.when(is_object, parsed))
    errors = F.array().cast("array<string>")
    for name, schema in sorted(schemas.items()):
        errors = F.when(F.col("name") == name, argument_errors(F.col("variant"), schema)).otherwise(errors)
    known = F.coalesce(F.col("name").isin(sorted(schemas)), F.lit(False))
    linked = linked.withColumn("errors", F.when(F.col("variant").isNotNull() & known, errors)
                               .otherwise(F.array().cast("array<string>")))
    status = (F.when(F.col("again").isNull(), "no_identifier").when(F.col("again"), "duplicate_call")
              .when(F.col("variant").isNull(), "bad_json").when(~known, "unknown_tool")
              .when(F.size("errors") > 0, "invalid_arguments").when(F.col("cyclic"), "cyclic")
              .when(F.col("answered").isNull(), "unanswered").otherwise("ok"))

    def canonical(**fields: Column) -> Column:
        return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})

    out = linked.withColumn("status", status)
    out = out.select(*KEY, "turn", "depth", "status", "errors", canonical(
        arguments=F.col("variant"), conversation=F.col("conv_id"), errors=F.col("errors"), id=F.col("call_id"),
        name=F.col("name"), result=F.col("content"), status=F.col("status")).alias("json"))
    # results without their call
    have = unique.select(*KEY, F.lit(True).alias("have"))
    left = (lookup(results, have, KEY, "left", heavy_keys(results, KEY, results.count()))
            .withColumn("status", F.when(F.col("again").isNull(), "no_identifier").when(F.col("again"), "extra_result")
                        .when(F.col("have").isNull(), "orphan_result")).where("status is not null"))
    return out.unionByName(left.select(
        *KEY, "turn", F.lit(None).cast("long").alias("depth"), "status",
        F.array().cast("array<string>").alias("errors"), canonical(
            conversation=F.col("conv_id"), id=F.col("call_id"), result=F.col("content"),
            status=F.col("status")).alias("json")))


# the tool that a chat's turns are taken to call
CHAT_SCHEMAS = {"reply": {"prompt": ("STRING", True, 1, 200), "turn": ("BIGINT", True, 0, None)}}


def chat_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of chat turns (conv_id, turn, role, text):
    a user's turn calls ``reply`` and follows the user's turn before it; the
    assistant's turn after it is the result."""
    def name(back: int) -> Column:
        return F.concat(F.lit("call-"), (F.col("turn") - back).cast("string"))

    calls = turns.where("role = 'user'").select(
        "conv_id", name(0).alias("call_id"), name(2).alias("after"), F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("turn"), F.col("text").alias("prompt"))).alias("arguments"), "turn")
    results = turns.where("role = 'assistant'").select("conv_id", name(1).alias("call_id"), F.col("text").alias("content"), "turn")
    return calls, results
