"""Chat formatting with tool-call linking.

Calls and results are joined by conversation and identifier, ordered so that every call comes after the calls it
refers to, checked against the argument schema of their tool, and written as canonical JSON: keys sorted at every
depth, no white space, the fewest escapes, numbers in one spelling. Values that are no JSON are told and not pasted in.

Native: only DataFrame functions, no Python on the executors. JSON is read and written by the JVM's variant type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise


def quoted(s: Column) -> Column:
    """``s`` as a JSON string: the fewest escapes, control characters as \\uXXXX or their short form."""
    s = F.regexp_replace(s, r"([\\\"])", r"\\$1")
    for char, short in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
        s = F.replace(s, F.lit(char), F.lit("\\" + short))
    rare = [c for c in range(0x20) if c not in (8, 9, 10, 12, 13)]
    plain = s
    for c in rare:
        s = F.replace(s, F.lit(chr(c)), F.lit(f"\\u{c:04x}"))
    return F.concat(F.lit('"'), F.when(plain.rlike(r"[\x00-\x1f]"), s).otherwise(plain), F.lit('"'))


def canonical(value: Column) -> Column:
    """The canonical JSON of a value's text, whatever its depth; null if it is no JSON or repeats a name in an object.

    Variants keep an object's names sorted and write no white space and the fewest escapes. Numbers lose the zeros that
    say nothing (1.50, 2e3, -0 are 1.5, 2000, 0); beyond 38 digits or with an exponent they are doubles, and one that
    no double holds is no value.
    """
    # in brackets, since a text with something after its first value would be read as that value alone
    listed = F.try_parse_json(F.concat(F.lit("["), value, F.lit("]")))
    one = F.to_json(F.try_variant_get(listed, "$[0]", "variant"))
    # of a string literal or the ".0" of a whole double only the literal stays
    text = F.regexp_replace(one, r'("(?:[^"\\]|\\.)*+")|(?<=[0-9])\.0(?=[,}\]E]|$)', "$1")
    lost = text.contains('Infinity"') & ~value.contains("Infinity")
    return F.when((F.json_array_length(F.to_json(listed)) == 1) & ~lost, text)


def kind(value: Column) -> Column:
    """The JSON type of a canonical value; whole numbers are integers."""
    first = F.substring(value, 1, 1)
    return F.when(first == '"', "string").when(first == "{", "object").when(first == "[", "array").when(first.isin("t", "f"), "boolean").when(first == "n", "null").when(value.rlike("^-?[0-9]+$"), "integer").when(value.isNotNull(), "number")


def arguments_json(values: Column) -> Column:
    """A map of names to canonical values as one object with its names sorted; values that are no JSON are null."""
    entries = F.array_sort(F.map_entries(values))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.coalesce(e["value"], F.lit("null")))), ","), F.lit("}"))


def has_type(value: Column, wanted: Column) -> Column:
    found = kind(value)
    return F.coalesce((found == wanted) | ((wanted == "number") & (found == "integer")), F.lit(False))


def at_path(values: Column, path: Column) -> Column:
    """The value at a dotted path of names ("a.b.c") in a map of canonical values; null if it isn't there."""
    first, rest = F.substring_index(path, ".", 1), F.regexp_replace(path, r"^[^.]*\.?", "")
    value = F.try_element_at(values, first)
    deep = F.aggregate(F.split(rest, r"\."), value, lambda v, name: F.to_json(F.try_element_at(F.try_variant_get(F.try_parse_json(v), "$", "map<string,variant>"), name)))
    return F.when(rest == "", value).otherwise(deep)


def problems(arguments: Column, values: Column, required: Column, types: Column) -> Column:
    """What is wrong with ``arguments`` (map of JSON texts) and their canonical ``values``: missing, unknown, mistyped and malformed names, sorted.

    Names in ``required`` and ``types`` may be paths into nested objects ("a.b"): a nested required name is missing
    where its object is there without it, and a nested type is checked where the value is there.
    """
    names, known = F.map_keys(arguments), F.map_keys(types)
    say = lambda what, xs: F.transform(xs, lambda n: F.concat(F.lit(f"{what}:"), n))
    above = lambda n: F.regexp_replace(n, r"\.[^.]*$", "")
    there = lambda n: at_path(values, n).isNotNull()
    missing = F.filter(required, lambda n: F.when(F.instr(n, ".") > 0, there(above(n)) & ~there(n)).otherwise(~F.array_contains(names, n)))
    malformed = F.filter(names, lambda n: F.try_element_at(values, n).isNull())
    unknown = F.array_except(names, F.transform(known, lambda n: F.substring_index(n, ".", 1)))
    wrong = F.filter(known, lambda n: there(n) & ~has_type(at_path(values, n), F.try_element_at(types, n)))
    return F.array_sort(F.concat(say("missing", missing), say("unknown", unknown), say("type", wrong), say("json", malformed)))


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """call_id and level: 0 for a call that refers to none, else one more than the highest it refers to; null in or behind a cycle.

    ``needs`` has call_id and needed, both known calls. Layers are peeled with joins, but a chain of any length costs
    only as many rounds as its length has binary digits: each round replaces a reference by what it refers to, keeping
    the number of steps, so the longest way to a call without references is found by doubling.
    """
    edges = needs.select("call_id", "needed").distinct().where(F.col("call_id").isNotNull() & F.col("needed").isNotNull())
    # ways of up to 2^k steps: (from, to, longest number of steps); a way that only grows past the number of calls is a cycle
    ways = materialise(edges.select("call_id", "needed", F.lit(1).cast("long").alias("steps")), "ways")
    if not ways.take(1):
        return calls.select("call_id", F.lit(0).cast("long").alias("level"))
    limit = ways.select("call_id").distinct().count() + 1
    sinks = ways.select(F.col("needed").alias("call_id")).join(ways.select("call_id"), "call_id", "left_anti").distinct()
    done = materialise(sinks.select("call_id", F.lit(0).cast("long").alias("level")), "levels")
    reach = ways
    size = 1
    while True:
        # a call is settled when all its ways end in settled calls
        ends = reach.join(done.withColumnRenamed("call_id", "needed"), "needed", "left")
        settled = ends.groupBy("call_id").agg(F.max(F.col("steps") + F.col("level")).alias("level"), F.count(F.when(F.col("level").isNull(), 1)).alias("open")).where("open = 0").select("call_id", "level")
        new = materialise(settled.join(done, "call_id", "left_anti"), "levels")
        done = materialise(done.union(new), "levels")
        left = reach.join(done, "call_id", "left_anti")
        if not left.take(1) or size > limit:
            break
        hop = left.join(left.select(F.col("call_id").alias("needed"), F.col("needed").alias("next"), F.col("steps").alias("more")), "needed", "left")
        longer = hop.select("call_id", F.coalesce("next", "needed").alias("needed"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        reach = materialise(longer.groupBy("call_id", "needed").agg(F.max("steps").alias("steps")), "ways")
        size *= 2
    known = needs.select("call_id").distinct().select("call_id", F.lit(True).alias("has"))
    return calls.select("call_id").join(done, "call_id", "left").join(known, "call_id", "left").select("call_id", F.when(F.col("has").isNull(), F.lit(0)).otherwise(F.col("level")).alias("level"))


KEY = ["conv_id", "call_id"]


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call: conv_id, call_id, tool, level, linked, problems, call_json, result_json.

    ``calls``: conv_id, call_id, tool, arguments (map of name to JSON value), needs (array of call ids it refers to).
    ``results``: conv_id, call_id, content. ``schemas``: tool, required (array of names), types (map of name to JSON
    type); names may be paths into nested objects.

    Calls and results are joined by conversation and call_id: an id of another conversation is another call. A call
    without a result has linked false and a null result_json; a result without a call is left out (``orphans`` gives
    those). Of repeated results the smallest content counts. Of repeated calls each gives a row. References to unknown
    calls are problems (``reference:id``); calls in or behind a cycle have a null level and the problem ``cycle``. A
    tool without a schema has the problem ``tool``. A value that is no JSON has the problem ``json:name``
    and is written as null. Null arguments count as none. Null ids of calls or conversations link to
    nothing. No calls give no rows.

    Only rows with both ids take part in the joins, so null ids meet nowhere, however many they are.
    """
    calls = calls.withColumn("arguments", F.coalesce("arguments", F.create_map().cast("map<string,string>"))).withColumn("needs", F.coalesce("needs", F.array().cast("array<string>")))
    calls = calls.withColumn("_values", F.transform_values("arguments", lambda _, v: canonical(v)))
    whole = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    # one key a call: the ids are told apart by a length, so that no two pairs are alike
    key = F.when(whole, F.concat_ws(":", F.length(F.col("conv_id").cast("string")).cast("string"), F.col("conv_id").cast("string"), "call_id"))
    calls = materialise(calls.withColumn("_key", key), "keyed")
    linking = calls.where("_key is not null")
    ids = materialise(linking.select("_key").distinct(), "call-ids")
    other = F.concat_ws(":", F.length(F.col("conv_id").cast("string")).cast("string"), F.col("conv_id").cast("string"), "needed")
    asked = linking.select("_key", "conv_id", F.explode("needs").alias("needed")).where("needed is not null").select(F.col("_key").alias("call_id"), other.alias("needed"), F.col("needed").alias("name")).distinct()
    known = ids.select(F.col("_key").alias("needed"))
    unknown = asked.join(known, "needed", "left_anti").groupBy("call_id").agg(F.sort_array(F.collect_set(F.concat(F.lit("reference:"), "name"))).alias("dangling"))
    level = levels(ids.select(F.col("_key").alias("call_id")), asked.join(known, "needed", "left_semi").select("call_id", "needed"))
    as_key = lambda df: df.withColumnRenamed("call_id", "_key")
    result = results.withColumn("_key", key).where("_key is not null").groupBy("_key").agg(F.min("content").alias("content"), F.lit(True).alias("linked"))
    joined = linking.hint("shuffle_hash").join(result, "_key", "left").join(as_key(level), "_key", "left").join(as_key(unknown), "_key", "left")
    alone = calls.where("_key is null").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in joined.schema if f.name not in calls.columns])
    found = joined.unionByName(alone).join(schemas, "tool", "left")
    none = F.array().cast("array<string>")
    wrong = F.concat(
        F.when(F.col("types").isNull(), F.concat(F.array(F.lit("tool")), F.transform(F.array_sort(F.filter(F.map_keys("arguments"), lambda n: F.try_element_at("_values", n).isNull())), lambda n: F.concat(F.lit("json:"), n)))).otherwise(problems(F.col("arguments"), F.col("_values"), F.col("required"), F.col("types"))),
        F.coalesce("dangling", none),
        F.when(F.col("level").isNull() & F.col("_key").isNotNull(), F.array(F.lit("cycle"))).otherwise(none),
    )
    call_json = F.concat(F.lit('{"arguments":'), arguments_json(F.col("_values")), F.lit(',"id":'), F.coalesce(quoted(F.col("call_id")), F.lit("null")), F.lit(',"name":'), F.coalesce(quoted(F.col("tool")), F.lit("null")), F.lit("}"))
    result_json = F.when(F.col("linked"), F.concat(F.lit('{"content":'), F.coalesce(quoted(F.col("content")), F.lit("null")), F.lit(',"tool_call_id":'), quoted(F.col("call_id")), F.lit("}")))
    return found.select("conv_id", "call_id", "tool", "level", F.coalesce("linked", F.lit(False)).alias("linked"), wrong.alias("problems"), call_json.alias("call_json"), result_json.alias("result_json"))


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose conversation and identifier no call has."""
    return results.join(calls.select(*KEY).distinct(), KEY, "left_anti")


# The plain chats of the table as calls: a turn that is not the assistant's asks the tool of its role, and the
# assistant's turn that follows is the result.
SCHEMA_ROWS = "SELECT explode(array(named_struct('tool','user','required',array('text','turn'),'types',map('text','string','turn','integer')), named_struct('tool','system','required',array('text'),'types',map('text','string','turn','integer')))) AS s"


def chats(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain chats (conv_id, turn, role, text).

    Turn t of a conversation has the identifier ``conv:t``. An assistant's turn t is the result of ``conv:t-1``. A turn
    that isn't the assistant's is a call of the tool named like its role; it refers to the call of turn t-2 if that is
    one too, as its answer came just before. Null ids, turns or roles make rows that link to nothing.
    """
    c = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("string").alias("text"))
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    asks = c.where(F.coalesce(F.col("role") != "assistant", F.lit(True)))
    before = asks.where(whole).select("conv_id", (F.col("turn") + 2).alias("turn")).distinct().withColumn("had", F.lit(True))
    asks = asks.join(before, ["conv_id", "turn"], "left")
    arguments = F.map_filter(F.create_map(F.lit("text"), quoted(F.col("text")), F.lit("turn"), F.col("turn").cast("string")), lambda _, v: v.isNotNull())
    calls = asks.select("conv_id", F.when(whole, name(F.col("turn"))).alias("call_id"), F.col("role").alias("tool"), arguments.alias("arguments"), F.when(F.col("had"), F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("needs"))
    results = c.where((F.col("role") == "assistant") & whole).select("conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def query(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    calls, results = chats(conversations)
    calls, results = materialise(calls, "calls"), materialise(results, "results")
    return link(calls, results, spark.sql(SCHEMA_ROWS).select("s.*"))


ORACLE = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, role, text, conv_id || ':' || turn AS id FROM conversations),
asks AS (SELECT * FROM c WHERE role <> 'assistant'),
r AS (SELECT conv_id || ':' || (turn - 1) AS id, min(text) AS content FROM c WHERE role = 'assistant' GROUP BY 1),
lv AS (
  SELECT id, conv_id, turn, 0 AS level FROM asks a WHERE NOT EXISTS (SELECT 1 FROM asks b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 2)
  UNION ALL
  SELECT a.id, a.conv_id, a.turn, lv.level + 1 FROM asks a JOIN lv ON a.conv_id = lv.conv_id AND a.turn = lv.turn + 2
)
SELECT a.conv_id, a.id AS call_id, a.role AS tool, lv.level::BIGINT AS level, r.id IS NOT NULL AS linked,
  CASE WHEN a.role IN ('user', 'system') THEN [] ELSE ['tool'] END::VARCHAR[] AS problems,
  '{"arguments":{"text":' || to_json(a.text)::VARCHAR || ',"turn":' || a.turn || '},"id":' || to_json(a.id)::VARCHAR || ',"name":' || to_json(a.role)::VARCHAR || '}' AS call_json,
  CASE WHEN r.id IS NOT NULL THEN '{"content":' || to_json(r.content)::VARCHAR || ',"tool_call_id":' || to_json(a.id)::VARCHAR || '}' END AS result_json
FROM asks a LEFT JOIN r ON r.id = a.id LEFT JOIN lv ON lv.id = a.id
"""
