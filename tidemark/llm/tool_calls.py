"""Tool calls linked to their results, ordered, checked and written as canonical JSON; DataFrame
functions only.

Calls and results meet in a hash join on (conversation, call id). A call may name calls it depends
on; calls are ordered so that it comes after them. Depths in that graph are found by pointer jumping:
a call with one open dependency skips to that call's own dependency, which halves long chains every
round, and a call with several waits until all are known. Calls on or behind a cycle stay open when
a round finds nothing new. Places inside a conversation come from range partitions, so a hot
conversation is spread over tasks. Arguments are checked against the tool's schema by row-local
functions; numbers get one spelling each, and objects become canonical JSON through VARIANT, whose
keys are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.mixing import numbered

# kinds of a schema, and the names under which VARIANT knows them
KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"),
         "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes``: id; ``edges``: child, parent (distinct, both among the nodes). Returns id, depth: the
    longest way from a node without parents; null on or behind a cycle."""
    waits = edges.groupBy("child").agg(F.count(F.lit(1)).alias("parents"))
    one = waits.filter("parents = 1").select("child")
    jumps = stored(edges.join(one, "child").select(F.col("child").alias("id"), F.col("parent").alias("to"), F.lit(1).cast("long").alias("steps")), "jumps")
    several = stored(edges.join(waits.filter("parents > 1"), "child"), "several")
    known = stored(nodes.join(edges.select(F.col("child").alias("id")).distinct(), "id", "left_anti")
                   .select("id", F.lit(0).cast("long").alias("depth")), "known")
    fresh = known
    while not fresh.isEmpty():
        at = known.select(F.col("id").alias("to"), F.col("depth").alias("base"))
        reached = jumps.join(at, "to").select("id", (F.col("base") + F.col("steps")).alias("depth"))
        met = (several.join(known.select(F.col("id").alias("parent"), "depth"), "parent").groupBy("child", "parents")
               .agg(F.count(F.lit(1)).alias("seen"), F.max("depth").alias("most")).filter("seen = parents")
               .select(F.col("child").alias("id"), (F.col("most") + 1).alias("depth")))
        fresh = stored(reached.unionByName(met), "fresh")
        ahead = jumps.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"))
        jumps = stored(jumps.join(fresh.select("id"), "id", "left_anti").join(ahead, "to", "left")
                       .select("id", F.coalesce("_to", "to").alias("to"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")), "jumps")
        several = stored(several.join(fresh.select(F.col("id").alias("child")), "child", "left_anti"), "several")
        known = stored(known.unionByName(fresh), "known")
    return nodes.join(known, "id", "left")


_TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++|.'
_NUMBER = r"^-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?$"


def one_spelling(json: Column) -> Column:
    """JSON text in which every number has the one spelling of its value.

    Whole numbers of up to 38 digits have neither point nor exponent, others no zeros at the end. Values with
    up to 20 digits before the point and 18 behind it are exact, as are whole numbers; any other is the
    nearest double. A number beyond a double's range is no JSON afterwards. Strings stay as they are.
    """
    def spelled(token: Column) -> Column:
        exact, wide, near = (token.try_cast(kind) for kind in ("decimal(38,18)", "decimal(38,0)", "double"))
        plain = F.regexp_replace(F.regexp_replace(exact.cast("string"), r"\.?0+$", ""), r"^-0$", "0")
        return (F.when(~token.rlike(_NUMBER), token)
                .when(near.isNull() | (F.abs(near) == float("inf")), "?")
                .when(token.rlike("^-?[0-9]++$"), F.when(token == "-0", "0").otherwise(token))
                .when(exact.cast("double") == near, plain)
                .when((F.abs(near) >= 1e18) & (wide.cast("double") == near), wide.cast("string"))
                .otherwise(near.cast("string")))

    tokens = F.regexp_extract_all(json, F.lit(_TOKEN), F.lit(0))
    # most texts have only whole numbers
    return F.when(json.rlike(r"[0-9][.eE]|-0|[0-9]{39}"), F.array_join(F.transform(tokens, spelled), "")).otherwise(json)


def _complaints(arguments: Column, rules: Column) -> Column:
    """Sorted list of what is wrong with a map<string, variant>, by map<string, rule>."""
    whole = lambda v: F.regexp_replace(F.schema_of_variant(v), r"^DECIMAL\([0-9]+,0\)$", "BIGINT")
    kind = lambda v: F.regexp_extract(whole(v), "^[A-Z]+", 0)
    wants = F.create_map(*(c for k, names in KINDS.items() for c in (F.lit(k), F.array(*map(F.lit, names)))))
    given = F.map_keys(arguments)
    missing = F.transform(F.filter(F.map_entries(rules), lambda r: r["value"]["required"] & ~F.array_contains(given, r["key"])),
                          lambda r: F.concat(F.lit("missing "), r["key"]))

    def check(entry: Column) -> Column:
        rule, value = F.element_at(rules, entry["key"]), entry["value"]
        number = F.try_variant_get(value, "$", "double")
        return (F.when(rule.isNull(), F.concat(F.lit("unexpected "), entry["key"]))
                .when(~F.array_contains(F.element_at(wants, rule["kind"]), kind(value)), F.concat(F.lit("kind "), entry["key"]))
                .when((number < rule["least"]) | (number > rule["most"]), F.concat(F.lit("range "), entry["key"]))
                .when(~F.array_contains(rule["allowed"], F.try_variant_get(value, "$", "string")), F.concat(F.lit("value "), entry["key"])))

    wrong = F.filter(F.transform(F.map_entries(arguments), check), lambda c: c.isNotNull())
    return F.array_sort(F.concat(missing, wrong))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and one per result that no call asked for.

    ``calls``: conv_id, pos, call_id, tool, arguments (JSON text), after (array of call ids);
    ``results``: conv_id, pos, call_id, content; ``schemas``: tool, argument, kind, required, least,
    most, allowed. Returns conv_id, call_id, place (from 1, after all it depends on), depth, tool,
    status, problems, message (canonical JSON).

    Status: ok; missing_result; invalid (see problems); bad_json; unknown_tool; cycle; missing_id (no
    call_id); duplicate_call (another call of that id comes first); orphan_result. A repeated result
    is left out: the first by pos, then content, counts. Dependencies on unknown calls are a problem
    but no obstacle. Null arguments are bad JSON, null conversations a conversation of their own,
    empty tables give an empty table.
    """
    calls = stored(calls.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("pos").cast("long").alias("pos"), "call_id", "tool", "arguments", "after",
                                F.monotonically_increasing_id().alias("id")), "calls")
    key = lambda df: [df["conv_id"].eqNullSafe(F.col("_conv")), df["call_id"] == F.col("_call")]
    first = (calls.filter("call_id is not null").groupBy(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"))
             .agg(F.min(F.struct("pos", "id")).alias("first")).select("_conv", "_call", F.col("first.id").alias("_first")))
    first = stored(first, "first")
    answers = (results.filter("call_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "call_id", "pos", "content")
               .groupBy(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"))
               .agg(F.min(F.struct("pos", "content")).alias("answer")))
    answers = stored(answers, "answers")

    # dependencies among the calls that count
    asked = calls.select("id", "conv_id", F.explode(F.array_distinct("after")).alias("call_id"))
    edges = (asked.join(first, key(asked), "left").select("id", F.col("_first").alias("parent")))
    unknown = edges.filter("parent is null").select("id").distinct().withColumn("_unknown", F.lit(True))
    edges = stored(edges.filter("parent is not null").select(F.col("id").alias("child"), "parent").distinct(), "edges")
    placed = depths(calls.select("id"), edges)

    rule = F.struct("kind", "required", "least", "most", "allowed")
    by_tool = (schemas.groupBy("tool").agg(F.map_from_entries(F.collect_list(F.struct("argument", rule))).alias("_rules"))
               .withColumnRenamed("tool", "_tool"))
    rows = calls.join(placed, "id").join(unknown, "id", "left")
    rows = rows.join(first, key(rows), "left").drop("_conv", "_call")
    rows = rows.join(answers, key(rows), "left").drop("_conv", "_call")
    rows = rows.join(by_tool, F.col("tool") == F.col("_tool"), "left")
    object_ = F.try_parse_json(one_spelling(F.col("arguments")))
    is_object = F.coalesce(F.schema_of_variant(object_).startswith("OBJECT"), F.lit(False))
    rows = rows.withColumn("_arguments", F.when(is_object, object_))
    entries = F.when(F.col("_arguments").isNotNull(), F.from_json(F.to_json("_arguments"), "map<string,variant>"))
    rows = rows.withColumn("problems", F.when(F.col("_rules").isNotNull() & F.col("_arguments").isNotNull(), _complaints(entries, F.col("_rules"))))
    rows = rows.withColumn("problems", F.concat(F.coalesce("problems", F.array().cast("array<string>")), F.when(
        F.col("_unknown"), F.array(F.lit("unknown dependency"))).otherwise(F.array().cast("array<string>"))))
    status = (F.when(F.col("call_id").isNull(), "missing_id").when(F.col("id") != F.col("_first"), "duplicate_call")
              .when(F.col("depth").isNull(), "cycle").when(F.col("_arguments").isNull(), "bad_json").when(F.col("_rules").isNull(), "unknown_tool")
              .when(F.size("problems") > 0, "invalid").when(F.col("answer").isNull(), "missing_result").otherwise("ok"))
    # keys in order; absent ones are left out
    message = F.to_json(F.struct(F.col("_arguments").alias("arguments"), F.col("call_id").alias("id"),
                                 F.col("answer.content").alias("result"), F.col("tool").alias("tool")))
    linked = stored(rows.select("conv_id", "call_id", "id", "pos", "depth", "tool", status.alias("status"), "problems", message.alias("message")), "linked")
    order = [F.col("conv_id"), F.col("depth").asc_nulls_last(), F.col("pos"), F.col("call_id"), F.col("id")]
    ordered = numbered(linked, ["conv_id"], order, "place")
    orphans = answers.join(first.withColumnsRenamed({"_conv": "_c", "_call": "_i"}),
                           F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_call") == F.col("_i")), "left_anti")
    orphans = orphans.select(F.col("_conv").alias("conv_id"), F.col("_call").alias("call_id"), F.lit(None).cast("long").alias("place"),
                             F.lit(None).cast("long").alias("depth"), F.lit(None).cast("string").alias("tool"), F.lit("orphan_result").alias("status"),
                             F.array().cast("array<string>").alias("problems"),
                             F.to_json(F.struct(F.col("_call").alias("id"), F.col("answer.content").alias("result"))).alias("message"))
    return ordered.select(*orphans.columns).unionByName(orphans)


#: tool, argument, kind, required, least, most, allowed: schemas of the tools that the query derives
SCHEMAS = [
    ("search", "query", "string", True, None, None, None), ("search", "limit", "integer", True, 1.0, 40.0, None),
    ("summarize", "text", "string", True, None, None, None), ("summarize", "max_words", "integer", False, 1.0, None, None),
    ("translate", "text", "string", True, None, None, None), ("translate", "to", "string", True, None, None, ["de", "en", "es", "fr"]),
]


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read from conversations: a user's turn asks a tool, which its length chooses,
    and depends on the user's turn before; the assistant's next turn is the result. Some arguments
    break their schema, as the length decides too."""
    n = F.length(F.coalesce("text", F.lit("")))
    name = lambda turn: F.concat(F.lit("call_"), F.col("conv_id"), F.lit("_"), turn)
    search = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("query"), (n % 50).alias("limit")))
    summary = F.when(n % 7 == 0, F.to_json(F.struct(F.col("text"), F.lit("few").alias("max_words")))).otherwise(
        F.to_json(F.struct(F.col("text"), (n % 90 + 1).alias("max_words"))))
    to = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es", "xx"))), (n % 5 + 1).cast("int"))
    translate = F.when(n % 11 == 0, F.concat(F.lit("{"), F.to_json(F.struct("text")))).otherwise(F.to_json(F.struct(to.alias("to"), F.col("text"))))
    calls = turns.filter(F.col("role") == "user").select(
        "conv_id", F.col("turn").alias("pos"), name(F.col("turn")).alias("call_id"),
        F.element_at(F.array(F.lit("search"), F.lit("summarize"), F.lit("translate")), (n % 3 + 1).cast("int")).alias("tool"),
        F.when(n % 3 == 0, search).when(n % 3 == 1, summary).otherwise(translate).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("after"))
    results = turns.filter(F.col("role") == "assistant").select(
        "conv_id", F.col("turn").alias("pos"), name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = from_conversations(table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(SCHEMAS, "tool string, argument string, kind string, required boolean, least double, most double, "
                                             "allowed array<string>")
    return link(calls, results, schemas).withColumn("problems", F.array_join("problems", ", "))
