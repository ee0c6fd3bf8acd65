"""Tool calls in what models write: JSON and XML notation, typed arguments, masking, commands. All of it stays in the JVM.

Every call of a text is a row of its own with its own verdict; an error of one call does not hide the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.text import shell_quote

#: {function: {parameter: type}}; a function without parameters takes any.
Tools = dict[str, dict[str, str]]
MASK = "<MASKED>"

# Tools whose command line is not built from their arguments, and what ends a run.
FINISH, SHELL, CLI, END_MARK = "submit", "execute_bash", "lark-cli", "echo '<<<Finished>>>'"


def _is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def _json_text(x: Column) -> Column:
    """A string as JSON writes it."""
    listed = F.to_json(F.array(x))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def hermes_calls(df: DataFrame, id_col: str, text_col: str, tools: Tools | None = None) -> DataFrame:
    """(id, call_no, name, arguments, error) of every JSON call block of a text; arguments is JSON with keys in order.

    A text that opens a block and closes none has one row with error unclosed. Blank blocks are no calls. Errors, the first that
    applies: invalid_json, not_object, no_name, name_not_text, unknown_function (if ``tools`` are given), invalid_arguments
    (a JSON text inside a string that does not parse), arguments_not_object. Missing or null arguments are {}. Texts
    without a block, null ones among them, have no row."""
    text = F.col(text_col)
    blocks = F.filter(F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), F.lit(1)), lambda b: F.trim(b) != "")
    some = df.where(text.contains("<tool_call>")).select(id_col, text.contains("</tool_call>").alias("closed"), blocks.alias("blocks"))
    rows = some.select(id_col, "closed", F.posexplode(F.when(F.col("closed"), F.col("blocks")).otherwise(F.array(F.lit("")))).alias("call_no", "raw"))
    rows = rows.withColumn("v", F.try_parse_json("raw"))
    name, given = F.try_variant_get("v", "$.name", "variant"), F.try_variant_get("v", "$.arguments", "variant")
    rows = rows.select(id_col, "closed", "call_no", "v", name.alias("n"), given.alias("a"))
    inner = F.when(F.col("a").isNull() | F.is_variant_null("a"), F.parse_json(F.lit("{}"))).when(_is_text(F.col("a")), F.try_parse_json(F.try_variant_get("a", "$", "string"))).otherwise(F.col("a"))
    rows = rows.withColumn("args", inner).withColumn("name", F.when(_is_text(F.col("n")), F.try_variant_get("n", "$", "string")))
    unknown = ~F.col("name").isin(sorted(tools)) if tools is not None else F.lit(False)
    error = (
        F.when(~F.col("closed"), "unclosed").when(F.col("v").isNull(), "invalid_json").when(~_object(F.col("v")), "not_object").when(F.col("n").isNull(), "no_name")
        .when(F.col("name").isNull(), "name_not_text").when(unknown, "unknown_function").when(F.col("args").isNull(), "invalid_arguments").when(~_object(F.col("args")), "arguments_not_object")
    )
    rows = rows.withColumn("error", error)
    return rows.select(id_col, "call_no", "name", F.when(F.col("error").isNull(), F.to_json("args")).alias("arguments"), "error")


def _typed(value: Column, kind: Column) -> Column:
    """struct(json, error) of a parameter's text by its declared type; null in any case is null."""
    whole, number = F.trim(value).try_cast("bigint"), F.trim(value).try_cast("double")
    kind = F.lower(F.trim(F.coalesce(kind, F.lit("string"))))
    parsed = F.to_json(F.try_parse_json(value))
    is_whole = F.trim(value).rlike(r"^[+-]?\d+$")
    json = (
        F.when(F.lower(value) == "null", F.lit("null"))
        .when(kind.isin("string", "str", "text", "varchar", "char", "enum"), _json_text(value))
        .when(kind.rlike("^(int|uint|long|short|unsigned)"), F.when(is_whole, whole.cast("string")))
        .when(kind.rlike("^(num|float)"), F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string")))
        .when(kind.isin("boolean", "bool", "binary"), F.when(F.lower(value).isin("true", "false"), F.lower(value)))
        .otherwise(parsed)
    )
    return F.struct(json.alias("json"), F.when(json.isNull(), F.lit("invalid_value")).alias("error"))


def xml_calls(df: DataFrame, id_col: str, text_col: str, tools: Tools) -> DataFrame:
    """(id, call_no, name, arguments, error) of every ``<function=...>`` inside ``<tool_call>`` blocks, closed or cut off at the text's end.

    Parameters end at their closing tag, the next parameter, the function's end or the text's; one line break at either end of a
    value is dropped. Values are typed by ``tools``: whole and other numbers, true and false, JSON for objects and lists, all
    else text. Errors, the first that applies: no_name, unknown_function, no_parameter_name, unknown_parameter (if the
    function declares any), invalid_value. A parameter given twice has its last value. Texts without a call have no row."""
    declared = F.from_json(F.lit(_as_json(tools)), "map<string,map<string,string>>")
    blocks = F.regexp_extract_all(F.col(text_col), F.lit(r"(?s)<tool_call>(.*?)(?:</tool_call>|\z)"), F.lit(1))
    bodies = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"(?s)<function=(.*?)(?:</function>|\z)"), F.lit(1))))
    rows = df.where(F.col(text_col).contains("<tool_call>")).select(id_col, F.posexplode(bodies).alias("call_no", "body"))
    rows = rows.withColumn("named", F.col("body").contains(">")).withColumn("name", F.substring_index("body", ">", 1))
    rows = rows.withColumn("types", F.try_element_at(declared, F.col("name")))
    found = F.regexp_extract_all(F.substring("body", F.length("name") + 2, F.length("body")), F.lit(r"(?s)<parameter=(.*?)(?:</parameter>|(?=<parameter=)|(?=</function>)|\z)"), F.lit(1))
    rows = rows.withColumn("given", F.transform(found, lambda m: F.struct(m.contains(">").alias("named"), F.substring_index(m, ">", 1).alias("name"), F.regexp_replace(F.regexp_replace(F.substring(m, F.length(F.substring_index(m, ">", 1)) + 2, F.length(m)), r"^\n", ""), r"\n\z", "").alias("value"))))

    def one(p: Column) -> Column:
        known = F.map_contains_key("types", p["name"])
        typed = _typed(p["value"], F.try_element_at("types", p["name"]))
        error = F.when(~p["named"], "no_parameter_name").when((F.lower(p["value"]) != "null") & ~known & (F.size("types") > 0), "unknown_parameter").otherwise(typed["error"])
        return F.struct(p["name"].alias("name"), typed["json"].alias("json"), error.alias("error"))

    rows = rows.withColumn("args", F.transform("given", one))
    last = F.filter("args", lambda a, i: ~F.exists(F.slice("args", i + 2, F.size("args")), lambda b: b["name"] == a["name"]))
    wrong = F.get(F.filter("args", lambda a: a["error"].isNotNull()), F.lit(0))["error"]
    error = F.when(~F.col("named"), "no_name").when(F.col("types").isNull(), "unknown_function").otherwise(wrong)
    joined = F.concat(F.lit("{"), F.array_join(F.transform(last, lambda a: F.concat(_json_text(a["name"]), F.lit(":"), a["json"])), ","), F.lit("}"))
    rows = rows.withColumn("error", error)
    return rows.select(id_col, "call_no", "name", F.when(F.col("error").isNull(), joined).alias("arguments"), "error")


def _as_json(tools: Tools) -> str:
    import json

    return json.dumps(tools)


#: Parsers by the name of their notation.
PARSERS: dict[str, Callable] = {"hermes": hermes_calls, "xml": xml_calls}


def parser(name: str) -> Callable:
    if name not in PARSERS:
        raise KeyError(f"no tool-call parser {name!r}; there are {sorted(PARSERS)}")
    return PARSERS[name]


def mask_hermes(text: Column, names: list[str]) -> Column:
    """struct(text, removed): string values of the named arguments replaced by a mask in JSON calls, and the characters that saved."""
    removed = F.lit(0)
    for n in names:
        pattern = rf'("{n}"\s*:\s*")((?:[^"\\]|\\.)*)(")'
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        removed = removed + F.aggregate(found, F.lit(0), lambda a, x: a + F.greatest(F.lit(0), F.length(x) - len(MASK)))
        text = F.regexp_replace(text, pattern, f"$1{MASK}$3")
    return F.struct(text.alias("text"), removed.alias("removed"))


def mask_xml(text: Column, names: list[str]) -> Column:
    """The same for XML parameters."""
    removed = F.lit(0)
    for n in names:
        pattern = rf"(?s)(<parameter={n}>)(.*?)(</parameter>)"
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        removed = removed + F.aggregate(found, F.lit(0), lambda a, x: a + F.greatest(F.lit(0), F.length(x) - len(MASK)))
        text = F.regexp_replace(text, pattern, f"$1{MASK}$3")
    return F.struct(text.alias("text"), removed.alias("removed"))


def structured_calls(df: DataFrame, id_col: str, json_col: str, tools: list[str]) -> DataFrame:
    """(id, call_no, tool_call_id, type, name, arguments, error) of a JSON list of calls as chat interfaces send them.

    arguments may be an object or JSON text; error: unknown_function, or invalid_arguments for text that does not parse."""
    listed = F.try_variant_get(F.try_parse_json(json_col), "$", "array<variant>")
    rows = df.select(id_col, F.posexplode(listed).alias("call_no", "c"))
    get = lambda p, t: F.try_variant_get("c", p, t)
    rows = rows.select(id_col, "call_no", get("$.id", "string").alias("tool_call_id"), F.coalesce(get("$.type", "string"), F.lit("function")).alias("type"), get("$.function.name", "string").alias("name"), get("$.function.arguments", "variant").alias("a"))
    args = F.when(F.col("a").isNull(), F.parse_json(F.lit("{}"))).when(_is_text(F.col("a")), F.try_parse_json(F.try_variant_get("a", "$", "string"))).otherwise(F.col("a"))
    rows = rows.withColumn("args", args)
    error = F.when(~F.coalesce(F.col("name").isin(tools), F.lit(False)), "unknown_function").when(F.col("args").isNull(), "invalid_arguments")
    return rows.select(id_col, "call_no", "tool_call_id", "type", "name", F.when(error.isNull(), F.to_json("args")).alias("arguments"), error.alias("error"))


def shell_command(name: Column, arguments: Column) -> Column:
    """The command line of a call; ``arguments`` an array of struct(key, value), in order.

    FINISH prints its end mark; SHELL is its command; CLI its command behind its name; any other is its name, its
    command and --key value for the rest, each quoted."""
    command = F.get(F.filter(arguments, lambda a: a["key"] == "command"), F.lit(0))["value"]
    rest = F.transform(F.filter(arguments, lambda a: a["key"] != "command"), lambda a: F.concat(F.lit("--"), a["key"], F.lit(" "), shell_quote(a["value"])))
    built = F.concat_ws(" ", shell_quote(name), shell_quote(command), F.when(F.size(rest) > 0, F.array_join(rest, " ")))
    return (
        F.when(name == FINISH, F.lit(END_MARK)).when(name == SHELL, F.coalesce(command, F.lit("")))
        .when(name == CLI, F.when(F.coalesce(command, F.lit("")) != "", F.concat(F.lit(CLI + " "), command)).otherwise("")).otherwise(built)
    )


def arguments_example(arguments: Column, notation: str = "xml") -> Column:
    """Arguments, an array of struct(key, value), as a model of that notation writes them."""
    if notation == "hermes":
        return F.concat(F.lit("{"), F.array_join(F.transform(arguments, lambda a: F.concat(_json_text(a["key"]), F.lit(": "), _json_text(a["value"]))), ", "), F.lit("}"))
    return F.array_join(F.transform(arguments, lambda a: F.concat(F.lit("<parameter="), a["key"], F.lit(">"), a["value"], F.lit("</parameter>"))), " ")


def timeout(requested: Column, default: int, ceiling: int, remaining: Column) -> Column:
    """Seconds a call may take: what it asks for, if that is a positive whole number, else the default; not above the ceiling or what
    remains, rounded up; at least 1."""
    asked = F.trim(requested).try_cast("int")
    return F.greatest(F.lit(1), F.least(F.when(asked > 0, asked).otherwise(default), F.lit(ceiling), F.ceil(remaining).cast("int")))
