"""Transforms of nested columns, made by walking the schema: the result is one expression a column, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType


def _leaves(c: Column, kind: DataType, change: Callable[[Column], Column]) -> Column:
    if isinstance(kind, StringType):
        return change(c)
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[_leaves(c[f.name], f.dataType, change).alias(f.name) for f in kind.fields]))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _leaves(x, kind.elementType, change))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, v: _leaves(v, kind.valueType, change))
    return c


def change_strings(df: DataFrame, change: Callable[[Column], Column], columns: list[str] | None = None) -> DataFrame:
    """Every string leaf of the columns (all by default) changed, at any depth; shapes, nulls and other types stay."""
    return df.withColumns({f.name: _leaves(F.col(f.name), f.dataType, change) for f in df.schema.fields if columns is None or f.name in columns})


def _dropped(name: str, names: set[str], tokens: tuple[str, ...]) -> bool:
    return name in names or any(t.lower() in name.lower() for t in tokens)


def _without(c: Column, kind: DataType, names: set[str], tokens: tuple[str, ...]) -> Column:
    if isinstance(kind, StructType):
        kept = [f for f in kind.fields if not _dropped(f.name, names, tokens)]
        return F.when(c.isNotNull(), F.struct(*[_without(c[f.name], f.dataType, names, tokens).alias(f.name) for f in kept])) if kept else F.lit(None).cast("string")
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _without(x, kind.elementType, names, tokens))
    if isinstance(kind, MapType):
        live = F.map_filter(c, lambda k, _: ~k.isin(*names) & ~F.exists(F.array(*[F.lit(t.lower()) for t in tokens]).cast("array<string>"), lambda t: F.contains(F.lower(k), t)))
        return F.transform_values(live, lambda _, v: _without(v, kind.valueType, names, tokens))
    return c


def drop_fields(df: DataFrame, names: set[str] = frozenset(), tokens: tuple[str, ...] = ()) -> DataFrame:
    """df without any field, at any depth, whose name is listed or holds a token in either case."""
    kept = [f for f in df.schema.fields if not _dropped(f.name, set(names), tokens)]
    return df.select(*[_without(F.col(f.name), f.dataType, set(names), tokens).alias(f.name) for f in kept])


def overlay(source: DataFrame, translated: DataFrame, key: str, wanted: Callable[[Column], Column]) -> DataFrame:
    """source with the translated string leaf wherever the source leaf is wanted; both have the same columns. Shapes are the source's."""
    def merged(a: Column, b: Column, kind: DataType) -> Column:
        if isinstance(kind, StringType):
            return F.when(wanted(a) & b.isNotNull(), b).otherwise(a)
        if isinstance(kind, StructType):
            return F.when(a.isNotNull(), F.struct(*[merged(a[f.name], b[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        if isinstance(kind, ArrayType):
            return F.transform(a, lambda x, i: merged(x, F.get(b, i), kind.elementType))
        return a

    j = source.alias("s").join(translated.alias("t"), key, "left")
    return j.select(key, *[merged(F.col(f"s.{f.name}"), F.col(f"t.{f.name}"), f.dataType).alias(f.name) for f in source.schema.fields if f.name != key])


def structure_signature(df: DataFrame) -> list[tuple[str, str]]:
    """The sorted (path, type) pairs of the schema, array elements as []; independent of the order of fields."""
    out: list[tuple[str, str]] = []

    def walk(path: str, kind: DataType) -> None:
        if isinstance(kind, StructType):
            for f in kind.fields:
                walk(f"{path}.{f.name}" if path else f.name, f.dataType)
        elif isinstance(kind, ArrayType):
            walk(path + "[]", kind.elementType)
        else:
            out.append((path, kind.simpleString()))

    walk("", df.schema)
    return sorted(out)


def frozen(c: Column) -> Column:
    """An order-insensitive form of an array: its elements as JSON, sorted."""
    return F.array_sort(F.transform(c, lambda x: F.to_json(F.struct(x.alias("x")))))


def _named(c: Column, kind: DataType, name: str, change: Callable[[Column, str], Column]) -> Column:
    if isinstance(kind, StringType):
        return change(c, name)
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[_named(c[f.name], f.dataType, f.name, change).alias(f.name) for f in kind.fields]))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _named(x, kind.elementType, name, change))
    return c


def canonical_strings(df: DataFrame, aliases: dict[str, dict[str, str]], columns: list[str] | None = None) -> DataFrame:
    """Every string leaf compacted, at any depth; in a field that aliases names, a value whose blankless form is an alias becomes what it stands for."""
    from recordmill.functions.repair import compact_token

    def change(c: Column, name: str) -> Column:
        text = compact_token(c)
        known = aliases.get(name)
        if not known:
            return text
        table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
        return F.coalesce(F.try_element_at(table, F.regexp_replace(text, r"\s+", "")), text)

    return df.withColumns({f.name: _named(F.col(f.name), f.dataType, f.name, change) for f in df.schema.fields if columns is None or f.name in columns})


def _ordered(c: Column, kind: DataType) -> Column:
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[_ordered(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.struct(e["key"], _ordered(e["value"], kind.valueType))))
    return c


def canonical_json(df: DataFrame, column: str) -> Column:
    """A nested column as JSON with the keys of structs and maps in order at every depth, without blanks, nulls kept."""
    return F.to_json(_ordered(F.col(column), df.schema[column].dataType), {"ignoreNullFields": "false"})


def present_in(target: Column, source: Column) -> Column:
    """The entries of a map whose keys the source map has, in the target's values: a projection by what each row's source holds."""
    return F.map_filter(target, lambda k, _: F.array_contains(F.map_keys(source), k))


def field_scores(gold: Column, pred: Column) -> Column:
    """(fields, correct, exact) of two maps: fields are those of either side, and a field is right if both sides hold it with equal values. Values are compared as
    they are, so that "1" and 1 differ where maps hold JSON."""
    names = F.array_union(F.map_keys(gold), F.map_keys(pred))
    right = F.size(F.filter(names, lambda k: F.coalesce(F.try_element_at(gold, k) == F.try_element_at(pred, k), F.lit(False))))
    return F.struct(F.size(names).alias("fields"), right.alias("correct"), (right == F.size(names)).alias("exact"))
