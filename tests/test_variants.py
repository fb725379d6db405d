"""Schemas over values of several types, structures and frozen forms, against plain walks."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from recordmill.functions import variants as V

SCHEMA = {
    "type": "object", "required": ["id", "input", "tags"], "title": "record",
    "properties": {
        "id": {"type": "string", "minLength": 2, "pattern": "^r"},
        "input": {"type": ["object", "string"], "properties": {"load": {"type": "number", "minimum": 0, "maximum": 2}, "deep": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}, "additionalProperties": False}}},
        "tags": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": ["string", "object"], "required": ["k"], "properties": {"k": {"enum": [1, "one", None]}}}},
        "note": {"anyOf": [{"type": "null"}, {"type": "string", "maxLength": 3}]},
        "one": {"oneOf": [{"type": "integer"}, {"type": "number", "maximum": 5}]},
        "no": {"not": {"type": "string"}},
        "task": {"const": "check"},
    },
    "allOf": [{"if": {"properties": {"task": {"const": "check"}}, "required": ["task"]}, "then": {"required": ["label"]}, "else": {"properties": {"label": {"type": "null"}}}}],
}


def kinds(v):
    if isinstance(v, bool):
        return {"boolean"}
    if isinstance(v, (int, float)):
        return {"number", "integer"} if v == int(v) else {"number"}
    return {{dict: "object", list: "array", str: "string", type(None): "null"}[type(v)]}


def plain(v, s, at=""):
    out, k = [], kinds(v)
    if "type" in s and not k & set([s["type"]] if isinstance(s["type"], str) else s["type"]):
        out.append((at, "type"))
    same = lambda a, b: json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)
    if "enum" in s and not any(same(v, x) for x in s["enum"]):
        out.append((at, "enum"))
    if "const" in s and not same(v, s["const"]):
        out.append((at, "const"))
    import re

    tests = {"minLength": ("string", lambda x: len(v) < x), "maxLength": ("string", lambda x: len(v) > x), "pattern": ("string", lambda x: not re.search(x, v)), "minimum": ("number", lambda x: v < x), "maximum": ("number", lambda x: v > x), "minItems": ("array", lambda x: len(v) < x), "maxItems": ("array", lambda x: len(v) > x)}
    out += [(at, c) for c, (of, bad) in tests.items() if c in s and of in k and bad(s[c])]
    if "array" in k and "items" in s:
        for i, x in enumerate(v):
            out += plain(x, s["items"], f"{at}/{i}")
    if "object" in k:
        out += [(f"{at}/{n}", "required") for n in s.get("required", []) if n not in v]
        for n, r in s.get("properties", {}).items():
            if n in v:
                out += plain(v[n], r, f"{at}/{n}")
        if s.get("additionalProperties") is False:
            out += [(f"{at}/{n}", "additionalProperties") for n in sorted(set(v) - set(s.get("properties", {})))]
    for sub in s.get("allOf", []):
        out += plain(v, sub, at)
    if "anyOf" in s and all(plain(v, x) for x in s["anyOf"]):
        out.append((at, "anyOf"))
    if "oneOf" in s and sum(not plain(v, x) for x in s["oneOf"]) != 1:
        out.append((at, "oneOf"))
    if "not" in s and not plain(v, s["not"]):
        out.append((at, "not"))
    if "if" in s:
        out += plain(v, s.get("then" if not plain(v, s["if"]) else "else", {}), at)
    return out


def records(n=400):
    r = random.Random(6)
    leaf = lambda: r.choice([None, True, 1, 2.5, 7, -1, "r1", "long text", "", [], {}, {"k": 1}, {"k": "one"}, {"k": None}, {"k": 3}, [1]])
    out = [{"id": "r1", "input": "x", "tags": ["a"], "task": "check", "label": "ok"}, [], 3, "text", None]
    for _ in range(n):
        x = {k: leaf() for k in ("id", "input", "tags", "note", "one", "no", "label") if r.random() < 0.7}
        if r.random() < 0.5:
            x["input"] = {"load": r.choice([0.5, 3, -1, "1", None]), "deep": r.choice([{"x": 1}, {"x": 1.5, "y": 2}, {}, [], {"x": 2.0}])}
        if r.random() < 0.6:
            x["tags"] = [r.choice(["t", {"k": 1}, {"k": "two"}, {}, 5, None]) for _ in range(r.randrange(5))]
        if r.random() < 0.5:
            x["task"] = r.choice(["check", "other", 1])
        out.append(x)
    return out


def test_failures_equal_a_plain_validator(spark):
    rows = [(i, json.dumps(x)) for i, x in enumerate(records())]
    frame = spark.createDataFrame([*rows, (-1, "{broken"), (-2, None)], "i long, t string")
    got = sorted((r.i, r.pointer, r.code) for r in V.schema_failures(frame, ["i"], "t", SCHEMA).collect())
    want = sorted([(i, p, c) for i, t in rows for p, c in plain(json.loads(t), SCHEMA)] + [(-1, "", "json")])
    assert got == want and len({c for _, _, c in want}) >= 14 and not any(i == 0 for i, _, _ in want)


def test_unknown_keywords_raise(spark):
    with pytest.raises(ValueError):
        V.failures(F.lit(None).cast("variant"), {"properties": {"a": {"$ref": "#"}}})


def walk(v, path=()):
    name = {dict: "dict", list: f"list:{len(v)}" if isinstance(v, list) else "", str: "str", int: "int", float: "float", bool: "bool", type(None): "NoneType"}[type(v)]
    out = {(".".join(path), name)}
    if isinstance(v, dict):
        for k, x in v.items():
            out |= walk(x, (*path, k)) if k != "metadata" else set()
    if isinstance(v, list):
        for i, x in enumerate(v):
            out |= walk(x, (*path, str(i)))
    return out


def test_structures_of_rows(spark):
    some = [{"a": [1, {"b": None}], "metadata": {"x": 1}, "c": {"metadata": 2, "d": True}}, [], 1.5, "s", None]
    frame = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(some)] + [(9, None), (10, "{")], "i long, t string")
    got = {r.i: r for r in V.structures(frame, ["i"], "t").collect()}
    for i, x in enumerate(some):
        assert [(p.path, p.type) for p in got[i].paths] == sorted(walk(x))
        assert got[i].structure == hashlib.sha256("\n".join(f"{p}\t{t}" for p, t in sorted(walk(x))).encode()).hexdigest()
    assert got[9].paths is None and got[10].frozen is None


def test_frozen_forms_and_mismatches(spark):
    a = [(1, '{"x": [1, [2, 3], {"k": 1.000001}], "y": "é"}'), (2, '{"x": 1}'), (3, '{"x": [1]}'), (4, "1")]
    b = [(1, '{"y": "é", "x": [{"k": 1.0}, [3, 2], 1]}'), (2, '{"x": "1"}'), (3, '{"x": [2]}'), (5, "1")]
    left, right = (spark.createDataFrame(x, "i long, t string") for x in (a, b))
    frozen = [{r.i: r.frozen for r in V.structures(x, ["i"], "t").collect()} for x in (left, right)]
    assert [frozen[0][i] == frozen[1][i] for i in (1, 2, 3)] == [True, False, False]
    off = {r.i: (r.only_left, r.only_right) for r in V.structure_mismatches(left, right, "i", "t").collect()}
    assert off[2] == (["x:int"], ["x:str"]) and set(off) == {1, 2}
