"""Column helpers for text: LIKE as SQLite does it, JSON strictness, model output, paths."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(text: Column) -> Column:
    """A-Z in lower case; other letters stay as they are."""
    return F.translate(text, _UPPER, _LOWER)


def contains_like(text: Column, query: Column) -> Column:
    """``text LIKE '%query%'`` with SQLite's rules: ASCII case folds, % and _ are wildcards, backslash is ordinary."""
    return folded_like(fold(text), fold(query))


def folded_like(text: Column, query: Column) -> Column:
    """``contains_like`` for texts and queries that are folded already. A pattern is compiled only for queries with wildcards."""
    pattern = F.concat(F.lit("%"), F.replace(query, F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    wild = F.contains(query, F.lit("%")) | F.contains(query, F.lit("_"))
    return F.when(wild, F.call_function("like", text, pattern)).otherwise(F.contains(text, query))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Reads JSON as the standard has it; a struct that it fills needs a field ``_bad``.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": "_bad"}
# fixed values: the characters that are white space in Unicode
WHITE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def json_value(text: Column, kind: str) -> Column:
    """The text's JSON value as ``value``, of the type ``kind``; ``_bad`` is set or ``end`` isn't 1 where it isn't one.

    The parser reads one value and ignores what comes behind it, so the text is read as the first field of an object, which
    a bracket behind it would spoil. A comma behind it would not: see ``alone``.
    """
    return F.from_json(F.concat(F.lit('{"value":'), text, F.lit(',"end":1}')), f"struct<value:{kind},end:int,_bad:string>", STRICT)


def alone(text: Column) -> Column:
    """Whether a text is no more than one value, by counting it as an element of a list."""
    return F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1


def _read_as(kind: T.DataType) -> T.DataType:
    """The type that from_json reads a part as, so that nothing is turned into a text unseen."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _read_as(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_read_as(kind.elementType))
    return {T.StringType: T.VariantType(), T.BinaryType: T.StringType(), T.DecimalType: T.LongType()}.get(type(kind), kind)


def _wrong(value: Column, kind: T.DataType) -> Column:
    """Whether a value read is of another type than ``kind`` says."""
    if isinstance(kind, T.StructType):
        return reduce(or_, [_wrong(value[f.name], f.dataType) for f in kind])
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(value, lambda x: _wrong(x, kind.elementType)), F.lit(False))
    if isinstance(kind, T.StringType):
        return value.isNotNull() & ~F.schema_of_variant(value).isin("STRING", "VOID")
    return F.coalesce(value < 0, F.lit(False)) if isinstance(kind, T.DecimalType) else F.lit(False)


def _typed(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_typed(value[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _typed(x, kind.elementType))
    return F.try_variant_get(value, "$", "string") if isinstance(kind, T.StringType) else value


def strict_json(text: Column, kind: str) -> Column:
    """``ok``, whether a text is one JSON value of the type ``kind`` (or null) and nothing else, and the ``value``. A string
    has to be one: numbers and objects aren't texts. In ``kind``, binary stands for any JSON as it is written, and decimal for
    a whole number of 0 or more. Unknown fields are ignored, and of equal keys the last one counts."""
    want = T.DataType.fromDDL(kind)

    def judged(read: Column) -> Column:
        good = read["_bad"].isNull() & (read["end"] == 1) & ~_wrong(read["value"], want)
        return let(F.coalesce(good, F.lit(False)), lambda ok: F.struct(ok.alias("ok"), F.when(ok, _typed(read["value"], want)).alias("value")))

    none = F.struct(F.lit(False).alias("ok"), F.lit(None).alias("value"))
    return F.when(alone(text), let(json_value(text, _read_as(want).simpleString()), judged)).otherwise(none)


def json_object(text: Column) -> Column:
    """The JSON object of a text as a VARIANT; null where it isn't one. Of equal keys the last one counts; in objects inside
    of it, equal keys need ``spark.sql.variant.allowDuplicateKeys``, without which there is no value."""

    def last(m: Column) -> Column:
        keys, n = F.map_keys(m), F.size(m)
        latest = F.filter(F.map_entries(m), lambda e, i: F.array_position(F.slice(keys, i + 2, n), e["key"]) == 0)
        return F.when(F.size(F.array_distinct(keys)) == n, m).otherwise(F.map_from_entries(latest))

    read = json_value(text, "map<string,variant>")
    return F.when(alone(text), let(read, lambda r: F.when(r["_bad"].isNull() & (r["end"] == 1) & r["value"].isNotNull(), F.to_variant_object(last(r["value"])))))


def json_kind(text: Column) -> Column:
    """object, array, string, number, boolean, null, or invalid where strict JSON doesn't allow the text; null for null."""

    def kind(x: Column) -> Column:
        first = F.from_json(F.concat(F.lit('{"value":'), x, F.lit(',"end":1}')), "struct<end:int,_bad:string>", STRICT)
        start = F.substring(F.ltrim(F.translate(x, "\t\n\r", "   ")), 1, 1)
        names = {"{": "object", "[": "array", '"': "string", "t": "boolean", "f": "boolean", "n": "null"}
        named = F.coalesce(F.create_map(*[F.lit(v) for kv in names.items() for v in kv])[start], F.lit("number"))
        valid = alone(x) & let(first, lambda f: f["_bad"].isNull() & (f["end"] == 1))
        return F.when(x.isNotNull(), F.when(valid, named).otherwise("invalid"))

    return let(text, kind)


def trim_json_wrapper(raw: Column) -> Column:
    """The JSON part of a model's answer: without code fences, from the first { to the last }, else from [ to ]."""
    fence = "```"
    opened = lambda x: F.when(x.startswith(fence), F.regexp_replace(x, r"(?iU)^```\s*(?:json)?\s*", "")).otherwise(x)
    closed = lambda x: F.when(x.endswith(fence), F.rtrim(F.substring(x, F.lit(1), F.length(x) - len(fence)), F.lit(WHITE))).otherwise(x)

    def body(x: Column) -> Column:
        def span(a: str, b: str) -> Column:
            ends = F.struct(F.instr(x, a).alias("first"), (F.length(x) - F.length(F.substring_index(x, b, -1))).alias("last"))
            return let(ends, lambda e: F.when((e["first"] > 0) & (e["last"] > e["first"]), F.substring(x, e["first"], e["last"] - e["first"] + 1)))

        return F.coalesce(span("{", "}"), span("[", "]"), x)

    return let(let(let(F.btrim(raw, F.lit(WHITE)), opened), closed), body)


def fold_path(path: Column) -> Column:
    """The parts of an absolute path after folding . and .. , as an array; nothing is looked up."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    up = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(parts, F.array().cast("array<string>"), up)


def indent(text: Column, prefix: str) -> Column:
    """Every line with a prefix."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.concat(F.lit(prefix), x)), "\n")


def ordered_text(order: Column, text: Column, separator: str = "") -> Column:
    """Aggregate: the texts of a group in order, joined."""
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), separator)
