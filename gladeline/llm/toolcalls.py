"""Tool calls linked to their results, checked and written as canonical JSON.

Calls and results meet in a hash join on conversation and call id. A call may need others, by ``"$ref:<call id>"``
among its arguments; calls are put in an order in which whatever is needed comes first: a round settles all calls
whose needs are settled, so the rounds follow the longest chain of needs, not the number of calls. Arguments are
checked against a table of parameters. Everything is joins and aggregates; a conversation that holds a third of all
calls is spread like the rest, positions included, which come from a range sort and one offset per conversation.

Inputs: ``calls(conv_id, turn, call_id, tool, arguments)`` with the arguments as JSON text, ``results(conv_id, turn,
call_id, content)`` and ``schemas(tool, parameter, kind, required)`` with the kinds of ``KINDS``.

Defined cases: the first call of an id (by turn, then tool and arguments) is the call, repeated ones are dropped and
noted as ``repeated_id``; of several results the first by turn, then content, is linked; results without a call are
left out, calls without a result have none; calls without a conversation or id are left out; null or broken arguments
are ``malformed`` and written as null, as are those nested deeper than the parser's 1000 levels; arguments that do not
parse and have more than ``PARSER_CHARS`` characters, the parser's limit of one text, are ``too_long`` and written
whole, as a JSON string; a need that no call meets is ``unknown_reference`` and does not hold up the
order; calls in a circle of needs, or after one, are ``circular`` and come last, by turn; duplicate rows of a schema
count once; empty inputs give an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gladeline.llm.tables import stored
from gladeline.operators.joins import join_to_unique
from gladeline.operators.ordering import number_rows

KINDS = ("string", "integer", "number", "boolean", "object", "array")
_KEY = ["conv_id", "call_id"]
_MEMBERS = "try_cast(try_parse_json(arguments) AS map<string, variant>)"  # null unless the text is a JSON object
#: Characters of one text that the JSON parser takes.
PARSER_CHARS = 20_000_000
_REFERENCE = r"^\$ref:(.+)$"


def json_kind(value: Column) -> Column:
    """The kind of a variant as a schema names it; null has none."""
    shape = F.schema_of_variant(value)
    return (
        F.when(shape == "STRING", "string").when(shape == "BIGINT", "integer").when(shape == "BOOLEAN", "boolean")
        .when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("DECIMAL") | shape.isin("DOUBLE", "FLOAT"), "number")
    )


def _fits(kind: Column, wanted: Column) -> Column:
    return (kind == wanted) | ((kind == "integer") & (wanted == "number"))


def first_calls(calls: DataFrame) -> DataFrame:
    """One row per call id of a conversation, whether its arguments are broken and whether its id is repeated."""
    known = calls.filter(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    body = F.struct(F.col("turn").cast("long").alias("turn"), F.col("tool").cast("string").alias("tool"), F.col("arguments").cast("string").alias("arguments"))
    one = known.groupBy(F.col("conv_id").cast("long").alias("conv_id"), F.col("call_id").cast("string").alias("call_id")).agg(
        F.min(body).alias("first"), F.count(F.lit(1)).alias("n")
    )
    return one.select(*_KEY, "first.turn", "first.tool", "first.arguments", (F.col("n") > 1).alias("repeated")).withColumn(
        "broken", F.expr(_MEMBERS).isNull()
    )


def _too_long() -> Column:
    return F.col("broken") & (F.char_length("arguments") > PARSER_CHARS)


def argument_rows(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, tool, parameter, kind, reference``: a row per argument of well-formed calls."""
    members = F.expr(_MEMBERS)
    rows = calls.select(*_KEY, "tool", F.explode(members).alias("parameter", "value"))
    text = F.expr("try_variant_get(value, '$', 'string')")
    found = F.when(json_kind(F.col("value")) == "string", F.regexp_extract(text, _REFERENCE, 1))
    return rows.select(*_KEY, "tool", "parameter", json_kind(F.col("value")).alias("kind"), F.nullif(found, F.lit("")).alias("reference"))


def validate(calls: DataFrame, arguments: DataFrame, schemas: DataFrame) -> DataFrame:
    """``conv_id, call_id, error``: what is wrong with each call, a row per finding."""
    # a table of parameters, whose size is that of the tools' description; adaptive execution decides how to join it
    schema = schemas.filter(F.col("tool").isNotNull() & F.col("parameter").isNotNull()).groupBy("tool", "parameter").agg(
        F.min("kind").alias("wanted"), F.max("required").alias("required")
    )
    malformed = calls.filter("broken").select(*_KEY, F.when(_too_long(), "too_long").otherwise("malformed").alias("error"))
    repeated = calls.filter("repeated").select(*_KEY, F.lit("repeated_id").alias("error"))
    tools = schema.select("tool").distinct().withColumn("known", F.lit(True))
    unknown = calls.join(tools, "tool", "left").filter(F.col("known").isNull()).select(*_KEY, F.lit("unknown_tool").alias("error"))
    # arguments against parameters: of another kind, or not described
    met = arguments.join(tools, "tool").join(schema, ["tool", "parameter"], "left")
    wrong = (
        F.when(F.col("wanted").isNull(), F.concat(F.lit("unexpected:"), "parameter"))
        .when(~F.coalesce(_fits(F.col("kind"), F.col("wanted")), F.lit(False)) & F.col("reference").isNull(), F.concat(F.lit("kind:"), "parameter"))
    )
    kinds = met.select(*_KEY, wrong.alias("error")).filter(F.col("error").isNotNull())
    # required parameters that are absent
    needed = calls.filter("NOT broken").join(schema.filter("required"), "tool").select(*_KEY, "parameter")
    absent = needed.join(arguments.select(*_KEY, "parameter"), [*_KEY, "parameter"], "left_anti")
    missing = absent.select(*_KEY, F.concat(F.lit("missing:"), "parameter").alias("error"))
    return malformed.unionByName(repeated).unionByName(unknown).unionByName(kinds).unionByName(missing)


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` of all calls that no circle holds up.

    ``needs(conv_id, call_id, needed)`` has different rows whose ends are calls; level 0 needs nothing.
    """
    waiting = stored(needs)
    settled = [stored(calls.join(waiting, _KEY, "left_anti").select(*_KEY).withColumn("level", F.lit(0)))]
    while not waiting.isEmpty():
        done = settled[-1].select("conv_id", F.col("call_id").alias("needed"))
        left = stored(waiting.join(done, ["conv_id", "needed"], "left_anti"))
        free = waiting.join(left, _KEY, "left_anti").select(*_KEY).distinct()
        settled.append(stored(free.withColumn("level", F.lit(len(settled)))))
        if settled[-1].isEmpty():
            break
        waiting = left
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """``conv_id, call_id, position, level, tool, valid, errors, result_turn, json`` per call.

    ``position`` counts from 0 in each conversation; ``json`` has sorted keys and no spaces.
    """
    known = stored(first_calls(calls))
    arguments = stored(argument_rows(known))
    references = arguments.filter(F.col("reference").isNotNull()).select(*_KEY, F.col("reference").alias("needed")).distinct()
    there = known.select("conv_id", F.col("call_id").alias("needed"))
    needs = references.join(there, ["conv_id", "needed"], "left_semi")
    dangling = references.join(there, ["conv_id", "needed"], "left_anti").select(*_KEY, F.concat(F.lit("unknown_reference:"), "needed").alias("error"))
    level = levels(known, needs)
    errors = validate(known, arguments, schemas).unionByName(dangling)
    errors = stored(errors.groupBy(*_KEY).agg(F.sort_array(F.collect_set("error")).alias("errors")))
    answer = F.min(F.struct(F.col("turn").cast("long").alias("turn"), F.col("content").cast("string").alias("content")))
    first = results.filter(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).groupBy(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("call_id").cast("string").alias("call_id")
    ).agg(answer.alias("answer"))
    whole = known.join(level, _KEY, "left").join(errors, _KEY, "left").join(first, _KEY, "left")
    all_errors = F.coalesce("errors", F.array().cast("array<string>"))
    circular = F.when(F.col("level").isNull(), F.array(F.lit("circular"))).otherwise(F.array().cast("array<string>"))

    def record(arguments):
        return F.to_json(F.struct(arguments.alias("arguments"), F.col("call_id"), F.col("answer.content").alias("result"), F.col("tool")), {"ignoreNullFields": "false"})

    parsed = F.expr("CASE WHEN NOT broken THEN try_parse_json(arguments) END")
    written = F.when(_too_long(), record(F.col("arguments"))).otherwise(record(parsed))
    rows = whole.select(
        *_KEY, "turn", "level", "tool", F.sort_array(F.concat(all_errors, circular)).alias("errors"),
        F.col("answer.turn").alias("result_turn"), written.alias("json"),
    )
    order = [F.col("conv_id"), F.col("level").isNull(), F.col("level"), F.col("turn"), F.col("call_id")]
    placed = stored(number_rows(stored(rows), order, "__at"))
    begins = placed.groupBy("conv_id").agg(F.min("__at").alias("__begin"))
    return join_to_unique(placed, begins, ["conv_id"]).select(
        *_KEY, (F.col("__at") - F.col("__begin")).alias("position"), "level", "tool", (F.size("errors") == 0).alias("valid"),
        "errors", "result_turn", "json",
    )


def calls_of(conversations: DataFrame) -> DataFrame:
    """Tool calls in the shape of a conversation table: every assistant turn asks a tool.

    The tool, the limit and now and then a fault (a limit written as text, a missing query, a parameter nobody
    described, broken JSON) follow from the turn's text, which is the query, whole; each call refers to the assistant turn two before it.
    """
    text, turn = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("turn").cast("long")
    n = F.char_length(text)
    tool = F.element_at(F.array(F.lit("search"), F.lit("translate"), F.lit("count"), F.lit("paint")), (F.pmod(n, F.lit(7)) % 4 + 1).cast("int"))
    quoted = F.to_json(F.struct(text.alias("query")))
    body = F.regexp_replace(quoted, r"^\{|\}$", "")
    members = F.concat_ws(
        ",",
        F.concat(F.lit('"limit":'), F.when(n % 11 == 0, F.concat(F.lit('"'), n.cast("string"), F.lit('"'))).otherwise((n % 50).cast("string"))),
        F.when(n % 13 != 0, body),
        F.when(n % 17 == 0, F.lit('"colour":"blue"')),
        F.when(turn >= 2, F.concat(F.lit('"after":"$ref:c'), (turn - 2).cast("string"), F.lit('"'))),
    )
    whole = F.concat(F.lit("{"), members, F.when(n % 19 == 0, F.lit("")).otherwise(F.lit("}")))
    said = conversations.filter(F.col("role") == "assistant")
    return said.select("conv_id", turn.alias("turn"), F.concat(F.lit("c"), turn.cast("string")).alias("call_id"), tool.alias("tool"), whole.alias("arguments"))


def results_of(conversations: DataFrame) -> DataFrame:
    """Results for :func:`calls_of`: what follows an assistant turn answers it."""
    turn = F.col("turn").cast("long")
    later = conversations.filter((F.col("role") != "assistant") & (turn > 0))
    return later.select("conv_id", turn.alias("turn"), F.concat(F.lit("c"), (turn - 1).cast("string")).alias("call_id"), F.col("text").alias("content"))


def described_tools(spark) -> DataFrame:
    """The parameters that the tools of :func:`calls_of` describe."""
    rows = [(t, p, k, r) for t in ("search", "translate", "count") for p, k, r in (("query", "string", True), ("limit", "number", True), ("after", "string", False))]
    return spark.createDataFrame(rows, "tool string, parameter string, kind string, required boolean")
