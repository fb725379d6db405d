"""Values of several types in one column: schema checks over VARIANT by JSON pointer, and the structure and frozen form of nested JSON."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Keywords that are checked; others that only describe are passed over, and any other raises.
CHECKED = {"type", "enum", "const", "minLength", "maxLength", "pattern", "minimum", "maximum", "minItems", "maxItems", "items", "properties", "required", "additionalProperties", "allOf", "anyOf", "oneOf", "not", "if", "then", "else"}
DESCRIBING = {"$schema", "$id", "title", "description", "default", "examples", "$comment"}
FAILURE = "array<struct<pointer:string,code:string>>"


def kind(v: Column) -> Column:
    """The JSON type of a variant: object, array, string, boolean, null, integer (also a number without a fraction) or number; SQL null where there is no value."""
    t = F.schema_of_variant(v)
    number = F.when(F.try_variant_get(v, "$", "double") == F.floor(F.try_variant_get(v, "$", "double")), "integer").otherwise("number")
    fixed = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}
    out = F.when(v.isNull(), F.lit(None).cast("string"))
    for name, is_ in fixed.items():
        out = out.when(t.startswith(name), is_)
    return out.otherwise(number)


def _written(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def failures(v: Column, schema: dict, pointer: Column | str = "") -> Column:
    """(pointer, code) of everything in a variant that a JSON schema forbids, in the order of the schema; empty where all holds, and for a SQL null (a value that isn't there).

    Types are those of each row's own value, so a field may be a string in one row and an object in the next. A property that lacks is told by its own pointer. Codes are the keywords
    that fail; those inside anyOf, oneOf, not and if are told by the keyword alone.
    """
    if unknown := set(schema) - CHECKED - DESCRIBING:
        raise ValueError(f"schema keywords that aren't understood: {sorted(unknown)}")
    here = F.lit(pointer) if isinstance(pointer, str) else pointer
    none = F.array().cast(FAILURE)
    k = kind(v)
    out: list[Column] = []

    def fail(bad: Column, code: str, at: Column = here) -> None:
        out.append(F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(at.alias("pointer"), F.lit(code).alias("code")))).otherwise(none))

    def part(name: str) -> Column:
        return F.try_variant_get(v, "$[" + json.dumps(name) + "]", "variant")

    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        fail(~k.isin(*names, *(["integer"] if "number" in names else [])), "type")
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    for code, values in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
        if values is not None:
            fail(~F.to_json(v).isin(*map(_written, values)), code)
    of = {"minLength": ("string", lambda x: F.length(text) < x), "maxLength": ("string", lambda x: F.length(text) > x), "pattern": ("string", lambda x: ~text.rlike(x)), "minimum": ("number", lambda x: number < x), "maximum": ("number", lambda x: number > x)}
    for code, (what, bad) in of.items():
        if code in schema:
            fail((k.isin("number", "integer") if what == "number" else k == what) & bad(schema[code]), code)
    if {"items", "minItems", "maxItems"} & set(schema):
        items = F.try_variant_get(v, "$", "array<variant>")
        if "minItems" in schema:
            fail((k == "array") & (F.size(items) < schema["minItems"]), "minItems")
        if "maxItems" in schema:
            fail((k == "array") & (F.size(items) > schema["maxItems"]), "maxItems")
        if "items" in schema:
            each = F.flatten(F.transform(items, lambda x, i: failures(x, schema["items"], F.concat(here, F.lit("/"), i.cast("string")))))
            out.append(F.when(k == "array", each).otherwise(none))
    for name in schema.get("required", []):
        fail((k == "object") & part(name).isNull(), "required", F.concat(here, F.lit(f"/{name}")))
    for name, rule in schema.get("properties", {}).items():
        out.append(F.when(k == "object", failures(part(name), rule, F.concat(here, F.lit(f"/{name}")))).otherwise(none))
    if schema.get("additionalProperties", True) is not True:
        if schema["additionalProperties"] is not False:
            raise ValueError("additionalProperties is understood as true or false only")
        more = F.array_except(F.json_object_keys(F.to_json(v)), F.array(*map(F.lit, schema.get("properties", {}))) if schema.get("properties") else F.array().cast("array<string>"))
        out.append(F.when(k == "object", F.transform(F.sort_array(more), lambda x: F.struct(F.concat(here, F.lit("/"), x).alias("pointer"), F.lit("additionalProperties").alias("code")))).otherwise(none))
    holds = lambda s: F.size(failures(v, s)) == 0
    number_of = lambda some: reduce(lambda a, b: a + b, [holds(s).cast("int") for s in some])
    for sub in schema.get("allOf", []):
        out.append(failures(v, sub, here))
    if "anyOf" in schema:
        fail(v.isNotNull() & (number_of(schema["anyOf"]) == 0), "anyOf")
    if "oneOf" in schema:
        fail(v.isNotNull() & (number_of(schema["oneOf"]) != 1), "oneOf")
    if "not" in schema:
        fail(v.isNotNull() & holds(schema["not"]), "not")
    if "if" in schema:
        when = holds(schema["if"])
        for code, on in (("then", when), ("else", ~when)):
            if code in schema:
                out.append(F.when(on, failures(v, schema[code], here)).otherwise(none))
    every = F.concat(*out) if out else none
    return F.when(v.isNull(), none).otherwise(F.coalesce(every, none))


def schema_failures(rows: DataFrame, keys: list[str], record: str, schema: dict) -> DataFrame:
    """(keys, pointer, code): a row for everything that a schema forbids in the JSON text of a column. Text that isn't JSON fails as `json`, with an empty pointer; null text fails nothing."""
    made = rows.select(*keys, F.col(record).alias("__text"), F.try_parse_json(record).alias("__v"))
    odd = F.array(F.struct(F.lit("").alias("pointer"), F.lit("json").alias("code")))
    found = F.when(F.col("__text").isNotNull() & F.col("__v").isNull(), odd).otherwise(failures(F.col("__v"), schema))
    return made.select(*keys, F.explode(found).alias("f")).select(*keys, "f.pointer", "f.code")


# ---- structure and frozen form ----

# How the types of JSON values are called, and the field whose subtree is no part of a structure.
TYPE_NAMES = {str: "str", int: "int", float: "float", bool: "bool", type(None): "NoneType"}
AUXILIARY = "metadata"


def structure_of(value: object) -> set[tuple[str, str]]:
    """(dotted path, type) of every value inside a JSON value: dict, list:n, or the type of a leaf."""
    out, todo = set(), [("", value)]
    while todo:
        path, v = todo.pop()
        inner = lambda k, p=path: f"{p}.{k}" if p else str(k)
        if isinstance(v, dict):
            out.add((path, "dict"))
            todo += [(inner(k), x) for k, x in v.items() if k != AUXILIARY]
        elif isinstance(v, list):
            out.add((path, f"list:{len(v)}"))
            todo += [(inner(i), x) for i, x in enumerate(v)]
        else:
            out.add((path, TYPE_NAMES[type(v)]))
    return out


def frozen_json(value: object, digits: int = 5) -> str:
    """JSON of a value in which neither the order of keys nor of list elements matters, and fractions are rounded."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{frozen_json(value[k], digits)}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(sorted(frozen_json(x, digits) for x in value)) + "]"
    return json.dumps(round(value, digits) if isinstance(value, float) else value, ensure_ascii=False)


def structures(rows: DataFrame, keys: list[str], record: str) -> DataFrame:
    """keys with paths (path, type; in order), structure (the SHA-256 of paths) and frozen (of the frozen JSON) of a column of JSON text; nulls for a null or broken text. A row is read at a time, in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, shape, frozen = [], [], []
            for text in batch.column(len(keys)).to_pylist():
                try:
                    value = json.loads(text) if text is not None else ...
                except ValueError:
                    value = ...
                if value is ...:
                    found = None
                else:
                    found = sorted(structure_of(value))
                paths.append(None if found is None else [{"path": p, "type": t} for p, t in found])
                shape.append(None if found is None else hashlib.sha256("\n".join(f"{p}\t{t}" for p, t in found).encode()).hexdigest())
                frozen.append(None if found is None else hashlib.sha256(frozen_json(value).encode()).hexdigest())
            kind = pa.list_(pa.struct([("path", pa.string()), ("type", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(paths, kind), pa.array(shape, pa.string()), pa.array(frozen, pa.string())], names=[*keys, "paths", "structure", "frozen"])

    kept = rows.select(*keys, record)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keys)])
    return kept.mapInArrow(run, f"{fields}, paths array<struct<path:string,type:string>>, structure string, frozen string")


def structure_mismatches(left: DataFrame, right: DataFrame, key: str, record: str) -> DataFrame:
    """(key, only_left, only_right): the (path, type) pairs, as path:type, that a record has in one table only; records of equal structure are left out, and so are those of one table."""
    side = lambda t, n: structures(t, [key], record).select(F.col(key), F.col("paths").alias(n), F.col("structure").alias(f"{n}_hash"))
    both = side(left, "l").join(side(right, "r"), key).where(~F.col("l_hash").eqNullSafe(F.col("r_hash")))
    text = lambda a, b: F.transform(F.array_except(F.coalesce(a, F.array().cast("array<struct<path:string,type:string>>")), F.coalesce(b, F.array().cast("array<struct<path:string,type:string>>"))), lambda x: F.concat_ws(":", x["path"], x["type"]))
    return both.select(key, text(F.col("l"), F.col("r")).alias("only_left"), text(F.col("r"), F.col("l")).alias("only_right"))
