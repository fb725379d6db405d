"""Answers of models: the first JSON value, what trails it, and fields salvaged by schema, against the plain parser."""

import json
import random
import re

from pyspark.sql import functions as F

from recordmill.functions import repair as A


def mended(t):
    for name in ("structured_query", "scenario_id", "simulation_outputs", "violation_type", "loading_percent", "vm_pu", "run_power_flow", "run_opf_redispatch"):
        t = t.replace(name.replace("_", " _ "), name)
    for pattern, new in ((r"\s+([{}\[\]:,])", r"\1"), (r"([{}\[\]:,])\s+", r"\1"), (r"\s+_\s+", "_"), (r"(?<=[一-鿿])\s+(?=[一-鿿])", ""), (r"(\d)\.\s+(\d)", r"\1.\2")):
        t = re.sub(pattern, new, t)
    return t.replace("! =", "!=")


def plain(text):
    raw = (text or "").strip()
    for t in (raw, mended(raw)):
        if not t:
            continue
        try:
            return json.loads(t), False
        except ValueError:
            pass
        for start in sorted(i for i in (t.find("{"), t.find("[")) if i >= 0):
            try:
                value, end = json.JSONDecoder().raw_decode(t[start:])
                return value, bool(t[start + end :].strip())
            except ValueError:
                pass
    return None, False


def broken(r):
    """An answer around a value: prose before and after, two values, cut ends, brackets and quotes inside strings."""
    leaf = lambda: r.choice([1, -2.5, 1e20, True, None, "x", 'a"}b', "[", "\\", "é_ü \n", "北 京", "", "it's", 7])
    value = r.choice([{"a": leaf(), "b": [leaf(), {"c": leaf()}]}, [leaf(), leaf()], leaf(), {"q": {"filter": "x > 1"}}, [], {}])
    text = json.dumps(value, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1]))
    kind = r.randrange(12)
    if kind == 0:
        text = text + r.choice([" and then }", " ]", "]", " {", ' "'])
    elif kind == 1:
        text = r.choice(["Answer: ", "note [1] ", "so {", "] ", "'"]) + text
    elif kind == 2:
        text = text + " " + json.dumps({"b": 2})
    elif kind == 3:
        text = text[: r.randrange(len(text) + 1)]
    elif kind == 4:
        text = text.replace(":", " : ").replace(",", " , ")
    elif kind == 5:
        text = text.replace('"', "'")
    elif kind == 6:
        text = text.replace("2.5", "2. 5")
    elif kind == 7:
        text = "pre " + text + r.choice([" post", "", "\t\n"])
    elif kind == 8 and text:
        k = r.randrange(len(text))
        text = text[:k] + r.choice("{}[]\"\\,:\n'1") + text[k:]
    elif kind == 9:
        text = '{"a": 1, "a": ' + text + "}"
    return text


def test_first_json_value_equals_the_plain_parser(spark):
    r = random.Random(11)
    rows = [(i, broken(r)) for i in range(3000)] + [(-1, None), (-2, ""), (-3, '{"a":1} and then }'), (-4, 'note [1] {"a":1}'), (-5, '{"a":1} {"b":2}'), (-6, '{"a": "' + "x{" * 50_000 + '"} end'), (-7, '"' + "y" * 50_000 + '"'), (-8, "[1,2"), (-9, "1, 2")]
    got = spark.createDataFrame(rows, "i long, t string").select("i", "t", A.found_json(F.col("t")).alias("j")).collect()
    values = 0
    for x in got:
        value, trailing = plain(x.t)
        assert (None if x.j.json is None else json.loads(x.j.json)) == value and (x.j.json is None) == (value is None and (x.t or "").strip() != "null" and x.j.json is None), x.t
        assert x.j.trailing == trailing, x.t
        values += value is not None
    assert 1500 < values < 3000 and sum(x.j.trailing for x in got) > 300


def test_fields_are_salvaged_by_schema(spark):
    q, s = "intelligent_data_query", "auxiliary_decision"
    whole = '{"filter":"v > 1","scenario_id":"s1","source":"db"}'
    rows = [
        (1, q, '{"structured_query": ' + whole + "} and more", {"structured_query": json.loads(whole)}),
        (2, q, 'broken {"structured_query": {"filter": "v > 1", "scenario_id" : "s1", "source": "db"', {"structured_query": json.loads(whole)}),
        (3, q, '"filter": "", "scenario_id": "s1", "source": "db"', None),
        (4, q, '{"structured_query": "no object"}', None),
        (5, s, '{"response": "ok", "tools": ["a"]}', {"response": "ok", "tools": ["a"]}),
        (6, s, '{"response": null}', {"response": None}),
        (7, s, 'x "response": "do \nthis", "tools": ["a", "b"] y', {"response": "do \nthis", "tools": ["a", "b"]}),
        (8, s, '"response": "r", "tools": [a', {"response": "r", "tools": []}),
        (9, s, "nothing", None),
        (10, "other", 'so {"k": 1}.', {"k": 1}),
        (11, "other", "[1]", None),
        (12, None, '{"k": 2}', {"k": 2}),
        (13, q, None, None),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "i long, task string, t string")
    got = {x.i: x.j for x in df.select("i", A.salvaged(F.col("t"), F.col("task")).alias("j")).collect()}
    assert {i: None if j is None else json.loads(j[: plain_end(j)]) for i, j in got.items()} == {r[0]: r[3] for r in rows}


def plain_end(text):
    return json.JSONDecoder().raw_decode(text)[1]
