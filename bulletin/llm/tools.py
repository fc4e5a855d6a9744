"""Tool-call linking, with DataFrame functions only.

Calls and results meet by a join on the call's identifier. A call may name one call that it comes after; these
links make a forest, whose depths are found by pointer doubling (a join a round, log2 of the longest chain rounds).
Arguments are checked against schemas that are compiled into column expressions, and every record is
serialised as canonical JSON: keys in order, no blanks.

Defined cases: a call without a result is ``unanswered``; a result whose identifier no call has, or is null, is an
``orphan``; a call that comes after itself over any number of links is in a ``cycle`` and has no step; a call that
names an unknown call counts as a first one, with an error. Null arguments, or such as are not a JSON object, are
invalid. Every input row is a row of the result: of several calls with one identifier the smallest by (turn, name, arguments) is
the one that results and other calls meet, the others, repeated rows among them, are ``duplicate``; calls without identifier are ``unidentified``. Neither
has a step, and their errors are those of their name and arguments. All results of a call are linked with it, repeated ones too. Null or
empty content is an empty string. Extra columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: By tool, by field: JSON type, whether it is required, smallest and largest length (strings) or value (numbers).
Schema = dict[str, dict[str, tuple[str, bool, int | None, int | None]]]
#: The type that a variant's schema begins with, by JSON type.
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}
#: Turns that one window sorts at most.
TURNS = 1024


def errors(args: Column, fields: dict[str, tuple[str, bool, int | None, int | None]]) -> Column:
    """What is wrong with a variant of arguments: an array of messages in the order of the fields."""
    found = []
    for name, (kind, required, least, most) in sorted(fields.items()):
        value = F.try_variant_get(args, f"$.{name}", "variant")
        missing = value.isNull()
        fits = F.schema_of_variant(value).rlike(f"^{KINDS[kind]}")
        measure = F.length(F.try_variant_get(args, f"$.{name}", "string")) if kind == "string" else F.try_variant_get(args, f"$.{name}", "double")
        say = F.when(~fits, f"{name}: not {kind}")
        if least is not None:
            say = say.when(measure < least, f"{name}: below {least}")
        if most is not None:
            say = say.when(measure > most, f"{name}: above {most}")
        found.append(F.when(missing, F.lit(f"{name}: missing") if required else F.lit(None)).otherwise(say))
    return F.filter(F.array(*found), lambda e: e.isNotNull())


def depths(calls: DataFrame) -> DataFrame:
    """(call_id, depth) of a forest (call_id, after); depth is null on and behind a cycle."""
    known = calls.select(F.col("call_id").alias("after"), F.lit(True).alias("_known"))
    up = calls.select("call_id", "after").join(known, "after", "left").select("call_id", F.when(F.col("_known"), F.col("after")).alias("up"))
    state = written(up.withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")), "tool-depth")
    reach, n = 1, state.count()
    while reach <= n and not state.where("up is not null").isEmpty():
        above = state.select(F.col("call_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        state = written(state.join(above, "up", "left").select("call_id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")), "tool-depth")
        reach *= 2
    return state.select("call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def link(calls: DataFrame, results: DataFrame, schemas: Schema) -> DataFrame:
    """calls (conv_id, turn, call_id, name, arguments as JSON, after), results (conv_id, turn, call_id, content).

    One row a call and a result: conv_id, turn, kind, call_id, name, step (topological level: a call's is above that of
    the call it comes after and of that call's results), status, valid, errors (joined by "; "), json.
    """
    calls = written(calls.select("conv_id", "turn", "call_id", "name", "arguments", "after").withColumn("_row", F.monotonically_increasing_id()), "tool-rows")
    first = calls.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("turn", "name", "arguments", "conv_id", "after", "_row")).alias("c")).select("call_id", "c.*")
    first = written(first, "tool-calls")
    others = calls.join(first.select("_row"), "_row", "left_anti").drop("_row").withColumn("_status", F.when(F.col("call_id").isNull(), "unidentified").otherwise("duplicate"))
    ids = first.select(F.col("call_id").alias("after"), F.lit(True).alias("_known"))
    answered = results.where("call_id is not null").select("call_id").distinct().withColumn("_answered", F.lit(True))
    depths_of = written(depths(first), "tool-depths")
    whole = first.drop("_row").join(depths_of, "call_id").join(answered, "call_id", "left").join(ids, "after", "left")
    whole = whole.withColumn("_status", F.when(F.col("depth").isNull(), "cycle").when(F.col("_answered"), "answered").otherwise("unanswered"))
    whole = whole.withColumn("_lost", F.col("after").isNotNull() & F.col("_known").isNull()).drop("_answered", "_known")
    whole = whole.unionByName(others.withColumns({"depth": F.lit(None).cast("long"), "_lost": F.lit(False)}))
    whole = whole.withColumn("_args", F.try_parse_json("arguments")).withColumn("_object", F.coalesce(F.schema_of_variant("_args").startswith("OBJECT"), F.lit(False)))
    wrong = F.when(~F.col("_object"), F.array(F.lit("arguments: not an object")))
    for tool, fields in sorted(schemas.items()):
        wrong = wrong.when(F.col("name") == tool, errors(F.col("_args"), fields))
    wrong = wrong.otherwise(F.array(F.lit("name: unknown tool")))
    wrong = F.concat(wrong, F.when(F.col("_lost"), F.array(F.lit("after: unknown call"))).otherwise(F.array().cast("array<string>")))
    quoted = lambda c: F.to_json(F.to_variant_object(F.array(c))).substr(F.lit(2), F.length(F.to_json(F.to_variant_object(F.array(c)))) - 2)
    plain = lambda c: quoted(F.coalesce(c, F.lit("")))
    named = lambda c: F.when(c.isNull(), "null").otherwise(plain(c))
    made = whole.withColumn("_wrong", wrong).select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call_id", "name", (2 * F.col("depth")).alias("step"),
        F.col("_status").alias("status"), (F.size("_wrong") == 0).alias("valid"), F.array_join("_wrong", "; ").alias("errors"),
        F.concat(F.lit('{"arguments":'), F.when(F.col("_object"), F.to_json("_args")).otherwise("null"), F.lit(',"call_id":'), named(F.col("call_id")), F.lit(',"name":'), plain(F.col("name")), F.lit(',"type":"call"}')).alias("json"),
    )
    targets = first.join(depths_of, "call_id").select("call_id", F.col("name").alias("_name"), (2 * F.col("depth")).alias("step"), F.lit(True).alias("_call"))
    back = results.select("conv_id", "turn", "call_id", "content").join(targets, "call_id", "left")
    said = back.select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id", F.col("_name").alias("name"), (F.col("step") + 1).alias("step"),
        F.when(F.col("_call"), "linked").otherwise("orphan").alias("status"), F.lit(None).cast("boolean").alias("valid"), F.lit("").alias("errors"),
        F.concat(F.lit('{"call_id":'), named(F.col("call_id")), F.lit(',"content":'), plain(F.col("content")), F.lit(',"type":"result"}')).alias("json"),
    )
    return made.unionByName(said)


#: What a dialogue's turns are as calls: a user's turn asks, a system's turn instructs.
DIALOGUE: Schema = {"ask": {"prompt": ("string", True, 1, 400), "turn": ("integer", True, 0, None)}, "instruct": {"prompt": ("string", True, 1, 300), "turn": ("integer", True, 0, 0)}}


def _last_call(turns: DataFrame) -> DataFrame:
    """turns with before: the turn of the last call before a row in its conversation. Windows run over distinct turns, TURNS at most; rows meet them in a join."""
    one = turns.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.max(F.when(F.col("kind") == "call", F.col("turn"))).alias("_call"))
    one = written(one.withColumn("_part", F.floor(F.col("turn") / TURNS)), "tool-turns")
    tops = one.groupBy("conv_id", "_part").agg(F.max("_call").alias("_top"))
    carried = tops.withColumn("_carry", F.max("_top").over(W.partitionBy("conv_id").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).drop("_top")
    near = F.max("_call").over(W.partitionBy("conv_id", "_part").orderBy("turn").rowsBetween(W.unboundedPreceding, -1))
    known = one.withColumn("_near", near).join(carried, ["conv_id", "_part"]).select("conv_id", "turn", F.coalesce("_near", "_carry").alias("before"))
    return turns.join(known, ["conv_id", "turn"], "left")


def dialogue_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of dialogues (conv_id, turn, role, text).

    A user's or system's turn is a call with the identifier conv_id:turn, which comes after the last such turn; any other
    turn is a result of the last call before it, or has none. Rows without conv_id or turn have no identifier and are left to
    :func:`link` as results without a call.
    """
    asks = F.coalesce(F.col("role").isin("user", "system"), F.lit(False)) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    kind = F.when(asks, "call").otherwise("result")
    turns = _last_call(conversations.select("conv_id", "turn", "role", "text", kind.alias("kind")))
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    before = F.when(F.col("before").isNotNull(), name(F.col("before")))
    arguments = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt"), "turn"))
    calls = turns.where("kind = 'call'").select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.when(F.col("role") == "system", "instruct").otherwise("ask").alias("name"), arguments.alias("arguments"), before.alias("after"))
    results = turns.where("kind = 'result'").select("conv_id", "turn", before.alias("call_id"), F.col("text").alias("content"))
    return calls, results


def link_dialogues(conversations: DataFrame) -> DataFrame:
    calls, results = dialogue_calls(conversations)
    return link(calls, results, DIALOGUE)
