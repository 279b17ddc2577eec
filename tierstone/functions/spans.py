"""Reading OTLP attribute lists and classifying spans, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attribute names, first match wins.
INPUT_TOKENS = (
    "gen_ai.usage.input_tokens",
    "gen_ai.aggregated_usage.input_tokens",
    "gen_ai.usage.prompt_tokens",
)
OUTPUT_TOKENS = (
    "gen_ai.usage.output_tokens",
    "gen_ai.aggregated_usage.output_tokens",
    "gen_ai.usage.completion_tokens",
)
REASONING_TOKENS = (
    "gen_ai.usage.details.reasoning_tokens",
    "gen_ai.aggregated_usage.details.reasoning_tokens",
)
COST = ("operation.cost",)
AGENT_MODEL = ("model_name", "gen_ai.request.model")
FINAL_RESULT = ("final_result",)
MESSAGES = ("pydantic_ai.all_messages",)
TOOL_DEFINITIONS = ("gen_ai.tool.definitions",)
OPERATION = "gen_ai.operation.name"
TOOL_NAME = "gen_ai.tool.name"
GENAI_PREFIX = "gen_ai."
MODEL_OPERATIONS = ("chat", "generate_content", "text_completion")
# Where a task span carries the context its descendants inherit.
TASK_FIELDS = {
    "dag_id": "airflow.dag_id",
    "task_id": "airflow.task_id",
    "run_id": "airflow.dag_run.run_id",
    "map_index": "airflow.task_instance.map_index",
    "try_number": "airflow.task_instance.try_number",
}
TASK_MARK = TASK_FIELDS["task_id"]

# Lists inside lists inside attributes are parsed this deep with their types; what lies deeper is rewritten as text, in as many steps as it is deep.
NESTING = 3


# One typed OTLP value as from_json reads it. Lists and key lists stay JSON text and are
# only parsed where they occur.
_KINDS = ("string", "int", "double", "bool", "array", "kvlist")
_FIELDS = ", ".join(f"{k}Value string, {k}_value string" for k in _KINDS)
VALUE_TYPE = f"struct<{_FIELDS}>"
LIST_TYPE = f"array<struct<key string, value {VALUE_TYPE}>>"
# An element of a list is a value, one of a key list a key with a value: one type reads both.
_ELEMENTS = f"values array<struct<key string, value {VALUE_TYPE}, {_FIELDS}>>"


def _part(value: Column, kind: str) -> Column:
    return F.coalesce(value[f"{kind}Value"], value[f"{kind}_value"])


def _quoted(text: Column) -> Column:
    """A JSON string; the wrapper {"v":"..."} is cut off again."""
    wrapped = F.to_json(F.struct(text.alias("v")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


# Signs for what is not text inside a value, from the private use area, which no key of the format reaches.
_ARRAY, _KVLIST, _TEXT, _NUMBER, _BOOL, _BYTES, _VALUES, _KEY, _VALUE, _STRING, _OPEN, _CLOSE, _SLASH, _QUOTE = map(chr, range(0xE000, 0xE00E))
_SIGNS = {
    "array": _ARRAY, "kvlist": _KVLIST, "string": _TEXT, "int": _NUMBER, "double": _NUMBER, "bool": _BOOL, "bytes": _BYTES,
}


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value evaluated once, however often it is used; inside lambdas Spark shares nothing."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _deep(raw: Column, is_list: Column) -> Column:
    """A list or key list of any depth as plain JSON text.

    Strings are taken out and the rest is rewritten from the inside: a step replaces every list that holds no other any more, so there
    are as many steps as levels. A text without a list inside takes one, and so does one whose lists are arrays only.
    """
    wrapped = F.concat(F.when(is_list, '{"arrayValue":').otherwise('{"kvlistValue":'), F.to_json(F.try_parse_json(raw)), F.lit("}"))
    s = F.replace(F.replace(wrapped, F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))
    for kind, sign in _SIGNS.items():
        for spelling in ("Value", "_value"):
            s = F.replace(s, F.lit(f'"{kind}{spelling}":'), F.lit(sign))
    for name, sign in (("values", _VALUES), ("key", _KEY), ("value", _VALUE)):
        s = F.replace(s, F.lit(f'"{name}":'), F.lit(sign))
    s = F.regexp_replace(s, f'{_NUMBER}"(-?[0-9][0-9.eE+-]*)"', f"{_NUMBER}$1")
    s = F.regexp_replace(s, f'{_BYTES}"[^"]*"', f"{_BYTES}null")
    return F.when(raw.isNotNull(), _once(s, _rewritten))


def _rewritten(marked: Column) -> Column:
    """A wrapped list with signs for the names of the format as plain JSON text."""
    s = F.regexp_replace(marked, '"[^"]*"', _STRING)
    # single values, then empty lists, then values that are not there
    s = F.regexp_replace(s, f"\\{{[{_TEXT}{_NUMBER}{_BOOL}{_BYTES}]([^{{}}]*)\\}}", "$1")
    s = F.regexp_replace(s, f"\\{{{_ARRAY}\\{{(?:{_VALUES}\\[\\])?\\}}\\}}", "[]")
    s = F.regexp_replace(s, f"\\{{{_KVLIST}\\{{(?:{_VALUES}\\[\\])?\\}}\\}}", _OPEN + _CLOSE)
    s = F.replace(s, F.lit("{}"), F.lit("null"))
    s = F.regexp_replace(s, f"\\{{{_KEY}{_STRING}\\}}", f"{_STRING}:null")

    def inward(x: Column) -> Column:
        x = F.regexp_replace(x, f"\\{{{_KEY}{_STRING},{_VALUE}([^{{}}]*)\\}}", f"{_STRING}:$1")
        x = F.regexp_replace(x, f"\\{{{_ARRAY}\\{{{_VALUES}\\[([^{{}}]*)\\]\\}}\\}}", "[$1]")
        return F.regexp_replace(x, f"\\{{{_KVLIST}\\{{{_VALUES}\\[([^{{}}]*)\\]\\}}\\}}", f"{_OPEN}$1{_CLOSE}")

    def step(state: Column, _: Column) -> Column:
        return F.when(state["done"], state).otherwise(
            _once(inward(state["text"]), lambda x: F.struct(x.alias("text"), (x == state["text"]).alias("done")))
        )

    def walked(text: Column) -> Column:
        lists = F.length(text) - F.length(F.translate(text, _ARRAY + _KVLIST, ""))
        start = F.struct(text.alias("text"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(lists, F.lit(1))), start, step)["text"]

    def unnested(text: Column) -> Column:
        # where all braces are those of arrays, which end belongs to which does not matter
        flat = F.replace(F.replace(text, F.lit(f"{{{_ARRAY}{{{_VALUES}["), F.lit("[")), F.lit("]}}"), F.lit("]"))
        return _once(flat, lambda x: F.when(F.translate(x, "{}", "") == x, x).otherwise(walked(text)))

    strings = F.regexp_extract_all(marked, F.lit('"[^"]*"'), F.lit(0))
    pieces = F.split(F.translate(_once(s, unnested), _OPEN + _CLOSE, "{}"), _STRING)
    whole = F.array_join(F.flatten(F.zip_with(pieces, strings, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), "")
    return F.replace(F.replace(whole, F.lit(_QUOTE), F.lit('\\"')), F.lit(_SLASH), F.lit("\\\\"))


def _listed(raw: Column, is_list: Column, depth: int) -> Column:
    """A list or key list as plain JSON text, followed `depth` levels down."""

    def part(element: Column, kind: str) -> Column:
        return F.coalesce(_part(element, kind), _part(element["value"], kind))

    def plain(element: Column) -> Column:
        options = [part(element, k) for k in ("int", "double", "bool")]
        inner, is_list = F.coalesce(part(element, "array"), part(element, "kvlist")), part(element, "array").isNotNull()
        options.append((_listed(inner, is_list, depth - 1) if depth else _deep(inner, is_list)))
        text = part(element, "string")
        return F.when(text.isNotNull(), _quoted(text)).otherwise(F.coalesce(*options, F.lit("null")))

    def entry(element: Column) -> Column:
        key = F.when(element["key"].isNotNull(), F.concat(_quoted(element["key"]), F.lit(":")))
        return F.concat(F.coalesce(key, F.lit("")), plain(element))

    elements = F.coalesce(F.from_json(raw, _ELEMENTS)["values"], F.array())
    joined = F.array_join(F.transform(elements, entry), ",")
    opening, closing = F.when(is_list, "[").otherwise("{"), F.when(is_list, "]").otherwise("}")
    return F.when(raw.isNotNull(), F.concat(opening, joined, closing))


def _text_of(value: Column) -> Column:
    scalar = [_part(value, k) for k in ("string", "int", "double", "bool")]
    raw = F.coalesce(_part(value, "array"), _part(value, "kvlist"))
    return F.coalesce(*scalar, _listed(raw, _part(value, "array").isNotNull(), NESTING))


def attribute_text(value: Column) -> Column:
    """A typed OTLP value as text; lists and key lists become JSON text, bytes null."""
    return _once(value, _text_of)  # the value may be a text still to be parsed


def one_attr(listed: Column, key: str) -> Column:
    """The last plain text value of one key, without building the map."""
    hits = F.filter(listed, lambda a: a["key"] == key)
    return _part(F.try_element_at(hits, F.lit(-1))["value"], "string")


def attrs(listed: Column) -> Column:
    """LIST_TYPE to map<string,string>, later duplicates win."""
    keyed = F.filter(listed, lambda a: a["key"].isNotNull())
    entries = F.transform(
        keyed, lambda a: F.struct(a["key"].alias("key"), _text_of(a["value"]).alias("value"))
    )
    return F.coalesce(F.map_from_entries(entries), F.create_map().cast("map<string,string>"))


def first_attr(attributes: Column, keys: Sequence[str]) -> Column:
    """First key that is present and not null; 0 and '' count as present."""
    return F.coalesce(*[F.try_element_at(attributes, F.lit(k)) for k in keys])


def is_genai(attributes: Column) -> Column:
    return F.exists(F.map_keys(attributes), lambda k: k.startswith(GENAI_PREFIX))


def span_kind(attributes: Column, name: Column) -> Column:
    """agent_run, model_call, tool_call or null. The operation name decides; the
    span name is consulted only where there is no operation."""
    operation = F.try_element_at(attributes, F.lit(OPERATION))
    label = F.coalesce(name, F.lit(""))
    return (
        F.when(operation == "invoke_agent", "agent_run")
        .when(operation == "execute_tool", "tool_call")
        .when(operation.isin(*MODEL_OPERATIONS), "model_call")
        .when(operation.isNotNull(), F.lit(None))
        .when(label.startswith("invoke_agent"), "agent_run")
        .when(label.startswith("execute_tool"), "tool_call")
        .when(label.startswith("chat"), "model_call")
    )


def offered_tools(attributes: Column) -> Column:
    """Names in the tool definitions; an empty array when absent or unreadable."""
    parsed = F.try_parse_json(first_attr(attributes, TOOL_DEFINITIONS))
    names = F.transform(
        F.try_variant_get(parsed, "$", "array<variant>"),
        lambda d: F.try_variant_get(d, "$.name", "string"),
    )
    return F.coalesce(
        F.filter(names, lambda n: n.isNotNull() & (n != "")), F.array().cast("array<string>")
    )


def json_or_raw(text: Column) -> Column:
    """The parsed document where the text is JSON, else the text itself, as VARIANT."""
    return F.coalesce(F.try_parse_json(text), text.cast("variant"))
