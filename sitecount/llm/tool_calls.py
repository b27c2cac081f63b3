"""Tool calls in conversations: linked to their results, ordered, validated, and written as canonical JSON. DataFrame functions only.

A message whose text is a JSON object with ``tool_calls`` makes calls (id, name, arguments, depends_on), one with
``tool_call_id`` is the result of a call; every other message is plain. The first call and the first result of an id meet in a hash join on
(conversation, call id), in which each key has one row a side. Arguments are validated against the schemas of their tools, which are parameters, by type and by name.

Order: by (level, turn, place). Where every dependency stands before its call, turn and place alone are a topological order and the level is 0.
Only conversations in which some call depends on a later one are levelled: calls whose dependencies all have levels get the next
one, round by round, so the rounds are as many as the longest chain there. What never gets a level is on a cycle, and marked so.

Canonical JSON has sorted keys and no spaces; numbers are as Spark's variant type writes them. Text that isn't valid JSON is plain, not an
error. Null text is an empty message; a null role is empty; calls and results with a null conversation or id aren't linked, and are rows of their own. Of several
results for a call the first one (turn, then text) counts, and so does the first of several calls with an id; the others are rows with the status
``duplicate``, in the registered query and where they are asked for, and ``n_ignored`` counts them. What a call message says besides its calls is a message. A dependency on an id that isn't there is reported as missing
and doesn't delay the call. Repeated rows (same conversation and turn) are separate messages, of which the first by text counts in links. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop, scratch, written

#: Types of JSON values by the first word of the variant type's name.
TYPES = {"BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "STRING": "string", "BOOLEAN": "boolean", "OBJECT": "object", "ARRAY": "array", "VOID": "null"}

# The schemas of the registered query: by tool, (name, type, required).
SCHEMAS = {
    "reply": (("prompt", "string", True), ("turn", "integer", True), ("style", "string", False)),
    "search": (("query", "string", True), ("limit", "integer", False)),
}


def _literal(schemas: dict) -> Column:
    """tool -> array of (name, type, required); as large as the schemas."""
    if not schemas:
        return F.create_map().cast("map<string,array<struct<name:string,type:string,required:boolean>>>")
    pairs: list[Column] = []
    for tool, fields in schemas.items():
        specs = [F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(r).alias("required")) for n, t, r in fields]
        pairs += [F.lit(tool), F.array(*specs) if specs else F.array().cast("array<struct<name:string,type:string,required:boolean>>")]
    return F.create_map(*pairs)


def kind_of(value: Column) -> Column:
    first = F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair]), first), F.lit("other"))


def problems(name: Column, args: Column, schemas: dict) -> Column:
    """What is wrong with a call's arguments (map of variants), comma-joined; empty for nothing."""
    spec = F.element_at(_literal(schemas), name)

    def field(p):
        value = F.element_at(args, p["name"])
        fitting = F.array(p["type"], F.when(p["type"] == "number", "integer").otherwise(p["type"]))
        wrong = value.isNotNull() & ~F.array_contains(fitting, kind_of(value))
        return F.when(value.isNull() & p["required"], F.concat(F.lit("missing:"), p["name"])).when(wrong, F.concat(F.lit("type:"), p["name"]))

    known = F.transform(spec, lambda p: p["name"])
    extra = F.transform(F.array_sort(F.array_except(F.map_keys(args), known)), lambda k: F.concat(F.lit("unknown:"), k))
    found = F.concat(F.filter(F.transform(spec, field), lambda x: x.isNotNull()), extra)
    return F.when(name.isNull() | spec.isNull(), F.lit("unknown_tool")).when(args.isNull(), F.lit("arguments")).otherwise(F.array_join(found, ","))


_CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:variant,depends_on:array<string>>>,tool_call_id:string,content:variant>"


def tool_message(text: Column) -> Column:
    """The parts of a message that is a JSON object with calls or the id of one; null for others."""
    maybe = text.rlike(r"^[\x20\t\r\n]*\{") & (F.contains(text, F.lit('"tool_calls"')) | F.contains(text, F.lit('"tool_call_id"')))
    found = F.when(maybe & F.try_parse_json(text).isNotNull(), F.from_json(text, _CALLS))
    return F.when(found["tool_calls"].isNotNull() | found["tool_call_id"].isNotNull(), found)


def parse(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls (conv_id, turn, place, id, name, arguments JSON, depends_on), results (conv_id, turn, id, content JSON) and messages (conv_id, turn, role, content JSON): plain ones, and
    what a call message says besides its calls, if it says something or makes none."""
    text = F.coalesce("text", F.lit(""))
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text")).withColumn("m", tool_message(F.col("text")))
    made = F.transform("m.tool_calls", lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), F.to_json(c["arguments"]).alias("arguments"), c["depends_on"].alias("depends_on")))
    # parsed once, and written: every part below reads the result
    rows = written(rows.select("conv_id", "turn", "role", made.alias("calls"), F.col("m.tool_call_id").alias("answers"), F.to_json("m.content").alias("said"), F.when(F.col("m").isNull(), quoted(F.col("text"))).alias("content")), "messages")
    calls = rows.where("calls IS NOT NULL").select("conv_id", "turn", F.posexplode("calls").alias("place", "c")).select("conv_id", "turn", "place", "c.*")
    results = rows.where("answers IS NOT NULL").select("conv_id", "turn", F.col("answers").alias("id"), F.col("said").alias("content"))
    is_call, is_result = F.col("calls").isNotNull(), F.col("answers").isNotNull()
    speaks = is_call & ~is_result & ((F.coalesce("said", F.lit("null")) != "null") | (F.size("calls") == 0))
    content = F.when(is_call, F.coalesce("said", F.lit("null"))).otherwise(F.col("content"))
    plain = rows.where(~is_call & ~is_result | speaks).select("conv_id", "turn", "role", content.alias("content"))
    return calls, results, plain


def levels(calls: DataFrame) -> DataFrame:
    """Calls by (conv_id, id) with level and missing (dependencies that aren't there); level is null on cycles. ``calls`` has one row for each key."""
    key = ["conv_id", "id"]
    edges = calls.select("conv_id", F.col("id"), "turn", "place", F.explode(F.array_distinct("depends_on")).alias("on"))
    there = calls.select("conv_id", F.col("id").alias("on"), F.col("turn").alias("on_turn"), F.col("place").alias("on_place"))
    edges = written(edges.join(there, ["conv_id", "on"], "left"), "dependencies")
    missing = edges.where("on_turn IS NULL").groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set("on")), ",").alias("missing"))
    forward = F.struct("on_turn", "on_place") >= F.struct("turn", "place")
    tangled = written(edges.where("on_turn IS NOT NULL").where(forward).select("conv_id").distinct(), "tangled")
    nodes = written(calls.join(tangled, "conv_id", "left_semi").select(*key), "nodes")
    inner = written(edges.where("on_turn IS NOT NULL").join(tangled, "conv_id", "left_semi").select("conv_id", "id", "on"), "inner")
    left, known, level = nodes, None, 0
    while not left.isEmpty():
        waits = inner if known is None else inner.join(known.select("conv_id", F.col("id").alias("on")), ["conv_id", "on"], "left_anti")
        ready = written(left.join(waits.select(*key).distinct(), key, "left_anti").withColumn("level", F.lit(level)), "ready")
        if ready.isEmpty():
            break
        before, passed = known, left
        known = ready if known is None else written(known.unionByName(ready), "known")
        left = written(left.join(ready.select(*key), key, "left_anti"), "left")
        if before is not None:
            drop(before, ready, passed)
        level += 1
    found = nodes.withColumn("_in", F.lit(True))
    if known is not None:
        found = found.join(known, key, "left")
    else:
        found = found.withColumn("level", F.lit(None).cast("int"))
    out = calls.select(*key).join(found, key, "left").select(*key, F.when(F.col("_in"), F.col("level")).otherwise(0).cast("int").alias("level"))
    return out.join(missing, key, "left").withColumn("missing", F.coalesce("missing", F.lit("")))


def canonical(**parts: Column) -> Column:
    """A JSON object with sorted keys of JSON texts; null parts are null."""
    pieces = [F.concat(F.lit(f'"{k}":'), F.coalesce(parts[k], F.lit("null"))) for k in sorted(parts)]
    return F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}"))


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("t")))
    return F.when(text.isNotNull(), F.substring(whole, 6, F.length(whole) - 6))


KEY = ["conv_id", "id"]


def keyed() -> Column:
    return F.col("conv_id").isNotNull() & F.col("id").isNotNull()


def split(rows: DataFrame, name: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each key by ``order``, with ``same``, how many rows its key has, and the other rows, those without a key among them. Both have ``row``, a number of their own."""
    every = written(rows.withColumn("row", F.monotonically_increasing_id()), name)
    best = every.where(keyed()).groupBy(*KEY).agg(F.min(F.struct(*order, "row")).alias("best"), F.count(F.lit(1)).alias("same"))
    best = written(best.select(*KEY, F.col("best.row").alias("first"), "same"), f"heads_{name}")
    both = every.join(best, KEY)
    alone = every.where(~keyed()).withColumn("surplus", F.lit(False))
    return both.where("row = first").drop("first"), alone.unionByName(both.where("row <> first").drop("first", "same").withColumn("surplus", F.lit(True)))


def waits(lone: DataFrame, first: DataFrame, levelled: DataFrame) -> DataFrame:
    """``lone`` calls, on which nothing can depend, with the level (null on what is on a cycle) that puts each after its dependencies, and missing ones."""
    there = first.join(levelled.select(*KEY, "level"), KEY).select("conv_id", F.col("id").alias("on"), F.struct("turn", "place").alias("on_at"), F.col("level").alias("on_level"), F.lit(True).alias("there"))
    edges = lone.select("row", "conv_id", F.struct("turn", "place").alias("at"), F.explode(F.array_distinct("depends_on")).alias("on")).join(there, ["conv_id", "on"], "left")
    after = F.col("on_level") + F.when(F.col("on_at") < F.col("at"), 0).otherwise(1)
    found = edges.groupBy("row").agg(
        F.max(after).alias("level"),
        F.coalesce(F.bool_or(F.col("there") & F.col("on_level").isNull()), F.lit(False)).alias("stuck"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("there").isNull(), F.col("on")))), ",").alias("missing"),
    )
    level = F.when(F.coalesce("stuck", F.lit(False)), F.lit(None).cast("int")).otherwise(F.coalesce("level", F.lit(0)))
    return lone.join(found, "row", "left").withColumn("level", level).withColumn("missing", F.coalesce("missing", F.lit("")))


def link(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """Every call and every result that isn't in a call's row: conv_id, level, turn, place, kind, id, status and json."""
    first, lone = split(calls, "calls", "turn", "place", "name", "arguments", "depends_on")
    answer, late = split(results, "results", "turn", "content")
    places = written(first.select(*KEY, "turn", "place", "depends_on"), "first_calls")  # texts stay behind
    levelled = levels(places)
    said = F.struct(F.col("turn").alias("result_turn"), "content").alias("r")
    called = first.select(*KEY, "turn", "place", "name", "arguments", "same").join(levelled, KEY, "left")
    both = called.join(answer.select(*KEY, said, F.col("same").alias("answers")).hint("shuffle_hash"), KEY, "full_outer").withColumn("surplus", F.lit(False))
    own = waits(lone, places, levelled).select(*KEY, "turn", "place", "name", "arguments", F.lit(1).cast("long").alias("same"), "level", "missing", "surplus")
    both = both.unionByName(own, allowMissingColumns=True)
    both = both.unionByName(late.select(*KEY, said, F.lit(1).cast("long").alias("answers"), "surplus"), allowMissingColumns=True)
    args = F.when(F.col("arguments").startswith("{"), F.from_json("arguments", "map<string,variant>"))
    both = both.withColumn("wrong", F.when(F.col("same").isNotNull(), problems(F.col("name"), args, schemas)))
    called = F.col("same").isNotNull()
    status = (
        F.when(F.col("surplus"), "duplicate").when(~called, "orphan_result").when(F.col("level").isNull(), "cycle").when(F.col("wrong") != "", F.concat(F.lit("invalid:"), "wrong"))
        .when(F.col("missing") != "", F.concat(F.lit("missing:"), "missing")).when(F.col("r").isNull(), "no_result").otherwise("ok")
    )
    call = canonical(arguments=F.col("arguments"), id=quoted(F.col("id")), name=quoted(F.col("name")), result=F.col("r.content"))
    alone = canonical(content=F.col("r.content"), tool_call_id=quoted(F.col("id")))
    return both.select(
        "conv_id",
        F.when(called, F.col("level")).otherwise(0).alias("level"),
        F.coalesce("turn", "r.result_turn").alias("turn"),
        F.coalesce("place", F.lit(0)).alias("place"),
        F.when(called, "call").otherwise("result").alias("kind"),
        F.col("id").alias("call_id"),
        status.alias("status"),
        F.when(F.col("surplus"), 0).otherwise(F.coalesce("same", F.lit(0)) + F.coalesce("answers", F.lit(0)) - F.when(called, 1).otherwise(0) - F.when(F.col("r").isNotNull(), 1).otherwise(0)).cast("long").alias("n_ignored"),
        F.when(called, call).otherwise(alone).alias("json"),
    )


def format_chat(messages: DataFrame, schemas: dict = SCHEMAS, duplicates: bool = False) -> DataFrame:
    """One row for each call, orphan result and message, and with ``duplicates``, as in the registered query, for each later call or result of an
    id too; order by (conv_id, level, turn, place)."""
    calls, results, plain = parse(messages)
    linked = link(calls, results, schemas)
    if not duplicates:
        linked = linked.where("status <> 'duplicate'")
    plain = plain.select("conv_id", F.lit(0).alias("level"), "turn", F.lit(-1).alias("place"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit("ok").alias("status"), F.lit(0).cast("long").alias("n_ignored"), canonical(content=F.col("content"), role=quoted(F.col("role"))).alias("json"))
    return linked.unionByName(plain)


def numbered(rows: DataFrame) -> DataFrame:
    """``format_chat`` rows with ``seq``, their place in the conversation. All rows are sorted by ranges, and a conversation that lies in several
    parts goes on counting where it did in the part before, so that none has to fit a task."""
    order = ["conv_id", F.col("level").asc_nulls_last(), "turn", "place", "json"]
    rows = rows if hasattr(rows, "_table") else written(rows, "formatted")  # sorting by ranges reads its input twice
    every = written(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_at", 33))
    parts = every.groupBy("conv_id", "_part").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drop(rows)
    parts = written(parts.select(F.col("conv_id").alias("_conv"), F.col("_part").alias("_p"), "_from", before.alias("_before")), "parts")
    both = every.join(parts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_part") == F.col("_p")))
    return both.withColumn("seq", (F.col("_at") - F.col("_from") + F.col("_before") + 1).cast("long")).drop("_at", "_part", "_conv", "_p", "_from", "_before")


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """Plain conversations in the form above, for tables that hold no tool calls: a user's turn is a call of ``reply`` that depends on the user's turn
    before it, an assistant's is the result of the turn before it. Other roles, and messages that are tool messages already, stay.

    Calls are not all well made: by the remainder of conversation and turn, some depend on a later call, some of these in a circle, some start
    anew, have arguments of a wrong type, none or unknown ones, name an unknown tool, or come twice.
    """
    turn = F.col("turn")
    k = F.coalesce(F.pmod(F.col("conv_id") * 3 + turn + 3, F.lit(11)), F.lit(6))
    ident = lambda t: F.concat(F.lit("t"), t.cast("string"))
    prompt, number = quoted(F.coalesce("text", F.lit(""))), turn.cast("string")
    args = F.when(k == 1, canonical(prompt=prompt, turn=F.concat(F.lit('"'), number, F.lit('"')))).when(k == 3, canonical(turn=number))
    args = args.when(k == 7, canonical(prompt=prompt, tone=F.lit('"x"'), turn=number)).otherwise(canonical(prompt=prompt, turn=number))
    one = lambda t: F.concat(F.lit('["'), ident(t), F.lit('"]'))
    on = F.when(k.isin(0, 4), one(turn + 2)).when((turn >= 2) & ~k.isin(2, 8), one(turn - 2)).otherwise(F.lit("[]"))
    name = F.when(k == 10, F.lit('"lookup"')).otherwise(F.lit('"reply"'))
    again = canonical(id=quoted(ident(turn)), name=F.lit('"reply"'), arguments=canonical(prompt=F.lit('"again"'), turn=number), depends_on=F.lit("[]"))
    calls = F.concat(canonical(id=quoted(ident(turn)), name=name, arguments=args, depends_on=on), F.when(k == 9, F.concat(F.lit(","), again)).otherwise(""))
    call = F.concat(F.lit('{"tool_calls":['), calls, F.lit("]}"))
    result = canonical(tool_call_id=quoted(ident(turn - 1)), content=prompt)
    tool = tool_message(F.coalesce("text", F.lit(""))).isNotNull()
    said = F.when(tool | turn.isNull(), F.col("text")).when(F.col("role") == "user", call).when(F.col("role") == "assistant", result).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", "role", said.alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch() as made:
        rows = written(format_chat(as_tool_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet")), duplicates=True), "formatted")
    drop(*(t for t in made if t is not rows))
    return numbered(rows).select("conv_id", "seq", "level", "turn", "place", "kind", "call_id", "status", "n_ignored", "json")


ORACLE = """
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, coalesce((conv_id * 3 + turn + 3) % 11, 6) AS k FROM conversations),
u AS (SELECT *, to_json(text) AS p, CASE WHEN k IN (0, 4) THEN turn + 2 WHEN turn >= 2 AND k NOT IN (2, 8) THEN turn - 2 END AS dep FROM c WHERE role = 'user'),
a AS (SELECT * FROM c WHERE role = 'assistant'),
e AS (SELECT u.conv_id, u.turn, u.dep FROM u JOIN u AS o ON u.conv_id = o.conv_id AND u.dep = o.turn),
tangled AS (SELECT DISTINCT conv_id FROM e WHERE dep >= turn),
g AS (SELECT e.* FROM e JOIN tangled USING (conv_id)),
reach AS (SELECT conv_id, turn, dep FROM g UNION SELECT r.conv_id, r.turn, g.dep FROM reach AS r JOIN g ON r.conv_id = g.conv_id AND r.dep = g.turn),
ring AS (SELECT DISTINCT conv_id, turn FROM reach WHERE turn = dep),
stuck AS (SELECT conv_id, turn FROM ring UNION SELECT r.conv_id, r.turn FROM reach AS r JOIN ring ON r.conv_id = ring.conv_id AND r.dep = ring.turn),
steps AS (SELECT u.conv_id, u.turn, 0 AS n FROM u JOIN tangled USING (conv_id) ANTI JOIN stuck USING (conv_id, turn)
  UNION SELECT g.conv_id, g.turn, s.n + 1 FROM steps AS s JOIN g ON s.conv_id = g.conv_id AND s.turn = g.dep ANTI JOIN stuck ON stuck.conv_id = g.conv_id AND stuck.turn = g.turn),
l AS (SELECT conv_id, turn, max(n) AS n FROM steps GROUP BY ALL),
args AS (SELECT u.*, CASE k WHEN 1 THEN '{"prompt":' || p || ',"turn":"' || turn || '"}' WHEN 3 THEN '{"turn":' || turn || '}' WHEN 7 THEN '{"prompt":' || p || ',"tone":"x","turn":' || turn || '}'
    ELSE '{"prompt":' || p || ',"turn":' || turn || '}' END AS args, CASE k WHEN 1 THEN 'type:turn' WHEN 3 THEN 'missing:prompt' WHEN 7 THEN 'unknown:tone' WHEN 10 THEN 'unknown_tool' END AS wrong FROM u),
j AS (
  SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, CASE WHEN s.turn IS NOT NULL THEN NULL ELSE coalesce(l.n, 0) END::INT AS level, coalesce(u.turn, a.turn) AS turn, 0 AS place, CASE WHEN u.turn IS NULL THEN 'result' ELSE 'call' END AS kind,
    't' || coalesce(u.turn, a.turn - 1) AS call_id,
    CASE WHEN u.turn IS NULL THEN 'orphan_result' WHEN s.turn IS NOT NULL THEN 'cycle' WHEN wrong IS NOT NULL THEN 'invalid:' || wrong WHEN u.dep IS NOT NULL AND p.turn IS NULL THEN 'missing:t' || u.dep
      WHEN a.turn IS NULL THEN 'no_result' ELSE 'ok' END AS status, CASE WHEN u.k = 9 THEN 1 ELSE 0 END::BIGINT AS n_ignored,
    CASE WHEN u.turn IS NULL THEN '{"content":' || to_json(a.text) || ',"tool_call_id":"t' || (a.turn - 1) || '"}'
      ELSE '{"arguments":' || args || ',"id":"t' || u.turn || '","name":"' || CASE WHEN u.k = 10 THEN 'lookup' ELSE 'reply' END || '","result":' || coalesce(to_json(a.text)::VARCHAR, 'null') || '}' END AS json
  FROM args AS u FULL JOIN a ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 LEFT JOIN u AS p ON p.conv_id = u.conv_id AND p.turn = u.dep
    LEFT JOIN stuck AS s ON s.conv_id = u.conv_id AND s.turn = u.turn LEFT JOIN l ON l.conv_id = u.conv_id AND l.turn = u.turn),
every AS (SELECT * FROM j UNION ALL
  SELECT conv_id, 0, turn, 1, 'call', 't' || turn, 'duplicate', 0, '{"arguments":{"prompt":"again","turn":' || turn || '},"id":"t' || turn || '","name":"reply","result":null}' FROM u WHERE k = 9 UNION ALL
  SELECT conv_id, 0, turn, -1, 'message', NULL, 'ok', 0, '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' FROM c WHERE role NOT IN ('user', 'assistant'))
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY level NULLS LAST, turn, place, json) AS seq FROM every"""
