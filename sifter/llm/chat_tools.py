"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

Calls and results meet in a hash join on (conversation, call identifier). Results are reduced to
the earliest and a count for each identifier first, so one that repeats very often is one row.
A call may name calls that it depends on; its level is the longest chain of dependencies below
it, and sorting a conversation by (level, pos, call_id) is a topological order. Chains, of calls
with one dependency each, are followed by doubling, so that their length costs only its logarithm
in rounds of joins; calls with several dependencies take a round for each such call below them.
Arguments are parsed once, checked against the tool's schema, and written
with sorted keys and no blanks. DataFrame functions only.

Defined cases: null identifiers, of a call or its conversation, never link, so such calls are
unanswered at level 0 and such results orphans; very long texts are taken whole; other columns are
ignored; of results at one place the smallest content counts; a result without its call is an orphan row without level; calls that repeat are linked
each; dependencies on unknown calls and on itself are ignored; calls on a cycle, or above one,
have status ``cyclic`` and no level; arguments that are no JSON object are the error
``not_object`` and stand as a JSON string; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifter.llm.common import staged


@dataclass(frozen=True)
class Field:
    """One argument of a tool: string, integer, number, boolean, array or object."""

    name: str
    kind: str
    required: bool = True


Schemas = dict[str, tuple[Field, ...]]

_KINDS = {
    "string": "^STRING$",
    "integer": "^(BIGINT|DECIMAL\\([0-9]+,0\\))$",
    "number": "^(BIGINT|DOUBLE|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY<.*",
    "object": "^OBJECT<.*",
}


def json_string(x: Column) -> Column:
    """A string as a JSON string; null as the literal null."""
    quoted = F.to_json(F.array(x))
    return F.when(x.isNull(), F.lit("null")).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def errors(name: Column, args: Column, parsed: Column, schemas: Schemas) -> Column:
    """What a call's arguments break, as an array of short codes; empty if they are valid."""
    out = F.array(F.lit("unknown_tool"))
    for tool, fields in schemas.items():
        found = []
        for f in fields:
            at = f"$['{f.name}']"
            kind = F.schema_of_variant(F.try_variant_get(parsed, at, "variant"))
            absent = kind.isNull() | (kind == "VOID")
            found.append(
                F.when(absent, F.lit(f"missing:{f.name}") if f.required else F.lit(None).cast("string")).when(
                    ~kind.rlike(_KINDS[f.kind]), F.lit(f"type:{f.name}")
                )
            )
        known = F.array(*[F.lit(f.name) for f in fields]) if fields else F.array().cast("array<string>")
        keys = F.map_keys(F.from_json(args, "map<string,string>"))
        others = F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(F.lit("unknown:"), k))
        checked = F.concat(F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"), others)
        is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
        out = F.when(name == tool, F.when(is_object, checked).otherwise(F.array(F.lit("not_object")))).otherwise(out)
    return out


def _chains(single: DataFrame) -> DataFrame:
    """conv_id, call_id, top, steps: of calls with one dependency (dep), the first call up the chain with
    none or several, and how far up it is. Calls that lead to a cycle have no row."""
    keys = single.select("conv_id", F.col("call_id").alias("at"))
    chains = staged(single.select("conv_id", "call_id", F.col("dep").alias("top"), F.lit(1).cast("long").alias("steps")))
    arrived = None
    rounds = max(1, chains.count()).bit_length() + 1
    for _ in range(rounds):  # after so many doublings only cycles go on
        on = staged(chains.join(keys.withColumnRenamed("at", "top"), ["conv_id", "top"], "left_semi"))
        there = chains.join(on.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
        arrived = there if arrived is None else arrived.unionByName(there)
        if on.isEmpty():
            return arrived
        # Chains whose top has arrived go the rest of its way; the others double.
        every = staged(arrived.unionByName(on)).select("conv_id", F.col("call_id").alias("top"), F.col("top").alias("next"), F.col("steps").alias("more"))
        chains = staged(on.join(every, ["conv_id", "top"]).select("conv_id", "call_id", F.col("next").alias("top"), (F.col("steps") + F.col("more")).alias("steps")))
        arrived = staged(arrived)
    return arrived


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of calls that depend on no cycle."""
    nodes = calls.filter(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()).select("conv_id", "call_id").distinct()
    edges = staged(
        calls.filter(F.size("depends_on") > 0)
        .select("conv_id", "call_id", F.explode("depends_on").alias("dep"))
        .filter("dep <> call_id")
        .distinct()
        .join(nodes.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"], "left_semi")
    )
    zero = nodes.join(edges.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0).cast("long"))
    if edges.isEmpty():
        return zero
    counted = staged(edges.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("dep")))
    chains = staged(_chains(counted.filter("n = 1")))
    # Between calls with several dependencies: each goes to the top of its chain, so many steps away.
    several = edges.join(counted.filter("n > 1").select("conv_id", "call_id"), ["conv_id", "call_id"], "left_semi")
    one = counted.filter("n = 1").select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("chained"))
    up = chains.select("conv_id", F.col("call_id").alias("dep"), "top", "steps")
    waiting = staged(
        several.join(one, ["conv_id", "dep"], "left")
        .join(up, ["conv_id", "dep"], "left")
        .select("conv_id", "call_id", F.when(F.col("chained"), F.col("top")).otherwise(F.col("dep")).alias("top"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    )  # a null top leads to a cycle, and is never met
    known = staged(zero)
    while not waiting.isEmpty():
        below = known.select("conv_id", F.col("call_id").alias("top"), "level")
        met = staged(waiting.join(below, ["conv_id", "top"], "left"))
        ready = met.groupBy("conv_id", "call_id").agg(F.max(F.col("level") + F.col("steps")).alias("level"), F.bool_and(F.col("level").isNotNull()).alias("all"))
        ready = staged(ready.filter("all").select("conv_id", "call_id", "level"))
        if ready.isEmpty():
            break
        known = staged(known.unionByName(ready))
        waiting = staged(waiting.join(ready.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti"))
    tops = known.select("conv_id", F.col("call_id").alias("top"), "level")
    along = chains.join(tops, ["conv_id", "top"]).select("conv_id", "call_id", (F.col("level") + F.col("steps")).alias("level"))
    return known.unionByName(along)


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row a call, and one for each identifier of results without a call.

    calls: conv_id, call_id, pos, name, arguments (JSON), depends_on (array of call ids);
    results: conv_id, call_id, pos, content. Returns conv_id, call_id, pos, level, status,
    n_results, valid, errors (comma-joined) and json.
    """
    calls = calls.select("conv_id", "call_id", "pos", "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    answers = (
        results.select("conv_id", "call_id", F.struct("pos", "content").alias("r"))
        .filter(keyed)
        .groupBy("conv_id", "call_id")
        .agg(F.min("r").alias("r"), F.count(F.lit(1)).alias("n"))
    )
    linked = (
        calls.withColumn("is_call", F.lit(True))
        .join(answers, ["conv_id", "call_id"], "left")
        .join(levels(calls), ["conv_id", "call_id"], "left")
    )
    strays = answers.join(calls.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
    unkeyed = results.filter(~keyed).select("conv_id", "call_id", F.struct("pos", "content").alias("r"), F.lit(1).cast("long").alias("n"))
    orphans = strays.unionByName(unkeyed).withColumn("pos", F.col("r.pos"))
    rows = linked.unionByName(orphans, allowMissingColumns=True)
    is_call = F.coalesce("is_call", F.lit(False))
    rows = rows.withColumn("parsed", F.try_parse_json("arguments"))
    rows = rows.withColumn("broken", F.when(is_call, errors(F.col("name"), F.col("arguments"), F.col("parsed"), schemas)))
    level = F.when(is_call & ~keyed, F.lit(0)).otherwise(F.col("level"))
    status = (
        F.when(~is_call, "orphan").when(level.isNull(), "cyclic").when(F.col("n").isNull(), "unanswered").otherwise("linked")
    )
    is_object = F.coalesce(F.schema_of_variant("parsed").startswith("OBJECT"), F.lit(False))
    args = F.when(is_object, F.to_json("parsed")).otherwise(json_string(F.col("arguments")))
    json = F.concat(
        F.lit('{"arguments":'), args,
        F.lit(',"call_id":'), json_string(F.col("call_id").cast("string")),
        F.lit(',"name":'), json_string(F.col("name")),
        F.lit(',"result":'), json_string(F.col("r.content")),
        F.lit("}"),
    )
    return rows.select(
        "conv_id",
        "call_id",
        "pos",
        level.alias("level"),
        status.alias("status"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_results"),
        (F.size("broken") == 0).alias("valid"),
        F.array_join("broken", ",").alias("errors"),
        json.alias("json"),
    )


#: The tools of from_turns.
TURN_SCHEMAS: Schemas = {
    "reply": (Field("prompt", "string"), Field("turn", "integer"), Field("length", "integer")),
    "search": (Field("query", "string"), Field("limit", "integer"), Field("page", "integer", required=False)),
    "configure": (Field("prompt", "string"),),
}


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that stand for a table of turns, which has none: each row is one of them.

    An assistant's turn is the result of the turn before it. Every other turn is a call: of a user,
    `reply` and `search` by turns, the latter with a page that is sometimes no number; of the
    system, `configure` with an argument too many; of any other role, a tool that nobody knows. A
    call depends on those of the two turns before it, as far as they are calls.
    """

    def id_of(turn: Column) -> Column:
        return F.concat(F.lit("call_"), turn.cast("string"))

    text, turn = F.col("text"), F.col("turn")
    user = F.coalesce(F.col("role") == "user", F.lit(False))
    name = F.when(user, F.when(turn % 4 < 2, "reply").otherwise("search")).when(F.col("role") == "system", "configure").otherwise(F.col("role"))
    page = F.when(turn % 3 == 0, F.to_json(F.struct(F.lit("1").alias("page"), text.alias("query"), turn.alias("limit"))))
    search = F.coalesce(page, F.to_json(F.struct(F.lit(1).alias("page"), text.alias("query"), turn.alias("limit"))))
    reply = F.to_json(F.struct(turn, text.alias("prompt"), F.length(F.coalesce(text, F.lit(""))).alias("length")))
    arguments = F.when(F.col("name") == "reply", reply).when(F.col("name") == "search", search).otherwise(F.to_json(F.struct(text.alias("prompt"), F.lit(True).alias("extra"))))
    is_result = F.coalesce(F.col("role") == "assistant", F.lit(False))
    calls = turns.filter(~is_result).select("conv_id", "turn", "text", name.alias("name"))
    calls = calls.select(
        "conv_id", id_of(turn).alias("call_id"), turn.cast("long").alias("pos"), "name", arguments.alias("arguments"), F.array(id_of(turn - 1), id_of(turn - 2)).alias("depends_on")
    )
    results = turns.filter(is_result).select("conv_id", id_of(turn - 1).alias("call_id"), turn.cast("long").alias("pos"), text.alias("content"))
    return calls, results


def sql(table: str = "conversations") -> str:
    """link(from_turns(table)) in DuckDB SQL; levels by a walk along all dependencies."""
    quoted = lambda x: f"CAST(to_json({x}) AS VARCHAR)"
    given = lambda key: f"CASE WHEN text IS NULL THEN '' ELSE '\"{key}\":' || {quoted('text')} END"
    return f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, role IS NOT DISTINCT FROM 'assistant' AS is_result FROM {table}),
c AS (SELECT conv_id, turn, 'call_' || turn AS call_id, CAST(turn AS BIGINT) AS pos, text,
    CASE WHEN role = 'user' THEN CASE WHEN turn % 4 < 2 THEN 'reply' WHEN turn % 4 >= 2 THEN 'search' ELSE 'search' END WHEN role = 'system' THEN 'configure' ELSE role END AS name FROM t WHERE NOT is_result),
r AS (SELECT conv_id, 'call_' || (turn - 1) AS call_id, CAST(turn AS BIGINT) AS pos, text FROM t WHERE is_result),
a AS (SELECT conv_id, call_id, min(pos) AS pos, arg_min(coalesce(text, ''), (pos, text)) AS content, count(*) AS n
    FROM r WHERE conv_id IS NOT NULL AND call_id IS NOT NULL GROUP BY ALL),
n AS (SELECT DISTINCT conv_id, turn FROM c WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
e AS (SELECT n.conv_id, n.turn, m.turn AS dep FROM n JOIN n m ON n.conv_id = m.conv_id AND m.turn IN (n.turn - 1, n.turn - 2)),
w AS (SELECT conv_id, turn, 0 AS level FROM n WHERE NOT EXISTS (FROM e WHERE e.conv_id = n.conv_id AND e.turn = n.turn)
    UNION SELECT e.conv_id, e.turn, level + 1 FROM w JOIN e ON e.conv_id = w.conv_id AND e.dep = w.turn),
l AS (SELECT conv_id, turn, max(level) AS level FROM w GROUP BY ALL),
g AS (SELECT c.*, CASE name
        WHEN 'reply' THEN '{{' || '"length":' || length(coalesce(text, '')) || CASE WHEN text IS NULL THEN '' ELSE ',' END || {given("prompt")} || CASE WHEN turn IS NULL THEN '' ELSE ',"turn":' || turn END || '}}'
        WHEN 'search' THEN '{{' || CASE WHEN turn IS NULL THEN '' ELSE '"limit":' || turn || ',' END || '"page":' || CASE WHEN turn % 3 = 0 THEN '"1"' ELSE '1' END || CASE WHEN text IS NULL THEN '' ELSE ',' END || {given("query")} || '}}'
        ELSE '{{"extra":true' || CASE WHEN text IS NULL THEN '' ELSE ',' END || {given("prompt")} || '}}' END AS args,
    CASE name
        WHEN 'reply' THEN concat_ws(',', CASE WHEN text IS NULL THEN 'missing:prompt' END, CASE WHEN turn IS NULL THEN 'missing:turn' END)
        WHEN 'search' THEN concat_ws(',', CASE WHEN text IS NULL THEN 'missing:query' END, CASE WHEN turn IS NULL THEN 'missing:limit' END, CASE WHEN turn % 3 = 0 THEN 'type:page' END)
        WHEN 'configure' THEN concat_ws(',', CASE WHEN text IS NULL THEN 'missing:prompt' END, 'unknown:extra') ELSE 'unknown_tool' END AS errors FROM c),
j AS (SELECT g.conv_id, g.call_id, g.pos, coalesce(level, 0) AS level, CASE WHEN n IS NULL THEN 'unanswered' ELSE 'linked' END AS status, coalesce(n, 0) AS n_results, errors = '' AS valid, errors,
        '{{"arguments":' || args || ',"call_id":' || coalesce('"' || g.call_id || '"', 'null') || ',"name":' || coalesce({quoted("name")}, 'null') || ',"result":' || CASE WHEN n IS NULL THEN 'null' ELSE {quoted("content")} END || '}}' AS json
    FROM g LEFT JOIN a ON a.conv_id = g.conv_id AND a.call_id = g.call_id LEFT JOIN l ON l.conv_id = g.conv_id AND l.turn = g.turn)
SELECT conv_id, call_id, pos, level, status, n_results, valid, errors, json FROM j
UNION ALL
SELECT conv_id, call_id, pos, NULL, 'orphan', n, NULL, NULL,
    '{{"arguments":null,"call_id":' || coalesce('"' || call_id || '"', 'null') || ',"name":null,"result":' || {quoted("content")} || '}}'
FROM (SELECT conv_id, call_id, pos, content, n FROM a WHERE NOT EXISTS (FROM c WHERE c.conv_id = a.conv_id AND c.call_id = a.call_id)
    UNION ALL SELECT conv_id, call_id, pos, text, 1 FROM r WHERE conv_id IS NULL OR call_id IS NULL)"""
