"""Text of model answers put right: JSON found and mended, fields salvaged, tokens compacted. Column functions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names that generation breaks apart, and what they are; patterns may take the blanks of their neighbours, so these come first.
BROKEN_NAMES = {"structured _ query": "structured_query", "scenario _ id": "scenario_id", "simulation _ outputs": "simulation_outputs", "violation _ type": "violation_type", "loading _ percent": "loading_percent", "vm _ pu": "vm_pu", "run _ power _ flow": "run_power_flow", "run _ opf _ redispatch": "run_opf_redispatch"}
# Filters without their blanks, and as they are written.
FILTER_ALIASES = {"loading_percent>100": "loading_percent > 100", "vm_pu<0.95": "vm_pu < 0.95", "violation_type!=none": "violation_type != none"}
# What breaks in generated tokens, as patterns and what they become, in this order.
TOKEN_REPAIRS = ((r"\s+_\s+", "_"), (r"(?<=[A-Za-z0-9])\s+(?=[A-Za-z0-9])", ""), (r"(?<=[一-鿿])\s+(?=[一-鿿])", ""), (r"(\d)\.\s+(\d)", "$1.$2"), ("! =", "!="))
JSON_REPAIRS = ((r"\s+([{}\[\]:,])", "$1"), (r"([{}\[\]:,])\s+", "$1"), (r"\s+_\s+", "_"), (r"(?<=[一-鿿])\s+(?=[一-鿿])", ""), (r"(\d)\.\s+(\d)", "$1.$2"), ("! =", "!="))

#: An escape, a quotation mark, a bracket, a run of anything else, or a backslash at the end: together they are the whole text.
LEXEMES = r'(?s)\\.|"|[{}\[\]]|[^"\\{}\[\]]+|\\'


def _repaired(c: Column, repairs: tuple) -> Column:
    for broken, name in BROKEN_NAMES.items():
        c = F.replace(c, F.lit(broken), F.lit(name))
    for pattern, new in repairs:
        c = F.regexp_replace(c, pattern, new)
    return c


def compact_token(c: Column) -> Column:
    """A token without the blanks that generation puts inside it; null is empty."""
    return F.trim(_repaired(F.trim(F.coalesce(c, F.lit(""))), TOKEN_REPAIRS))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def value_length(text: Column) -> Column:
    """Code points of the JSON value with whose opening bracket a text begins, up to where its brackets close; null where they don't, and where a string holds a control
    character or something else a single quotation mark, which the parser below would let pass.

    One pass over the lexemes with depth and whether a string is open; brackets inside strings don't count.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("over"), F.lit(False).alias("odd"), F.lit(0).alias("length"))

    def step(s: Column, x: Column) -> Column:
        plain = ~s["quoted"]
        opens, closes = plain & x.isin("{", "["), plain & x.isin("}", "]")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        odd = s["odd"] | F.when(plain, x.contains("'")).otherwise(x.rlike(r"[\x00-\x1f]"))
        moved = F.struct(depth.alias("depth"), (s["quoted"] != (x == '"')).alias("quoted"), (closes & (depth == 0)).alias("over"), odd.alias("odd"), (s["length"] + F.length(x)).alias("length"))
        return F.when(s["over"], s).otherwise(moved)

    return F.aggregate(F.regexp_extract_all(text, F.lit(LEXEMES), F.lit(0)), start, step, lambda s: F.when(s["over"] & ~s["odd"], s["length"]))


def _bound(value: Column, use) -> Column:
    """use(value) with value made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _from(text: Column, start: Column) -> Column:
    """(json, trailing) of the value that begins at a place of a text; null where the place is 0 or no value begins there."""

    def found(t: Column, n: Column) -> Column:
        json, after = F.substring(t, F.lit(1), n), _stripped(F.substring(t, n + 1, F.length(t)))
        return F.when(F.get_json_object(json, "$").isNotNull(), F.struct(json.alias("json"), (after != "").alias("trailing")))

    rest = F.when(start > 0, F.substring(text, start, F.length(text)))
    return _bound(rest, lambda t: _bound(value_length(t), lambda n: found(t, n)))


def _scalar(text: Column) -> Column:
    """(json, trailing) of a text that is one string, number or word: a list of it is a list of one."""
    alone = lambda t: (value_length(t) == F.length(t)) & (F.json_array_length(t) == 1)
    held = ~text.rlike(r"\A[{\[]") & (text != "")
    return F.when(F.when(held, _bound(F.concat(F.lit("["), text, F.lit("]")), alone)), F.struct(text.alias("json"), F.lit(False).alias("trailing")))


def found_json(text: Column) -> Column:
    """(json, trailing) of the first JSON value of a text: the whole text, or else the value that begins at its first brace or bracket, the earlier first; and both
    again after its punctuation is mended. trailing says whether something other than white space follows the value. Null json if nothing parses; a null text is empty.
    NaN and infinities are no JSON here.
    """
    plain = _stripped(F.coalesce(text, F.lit("")))

    def of(t: Column) -> list[Column]:
        brace, bracket = F.locate("{", t), F.locate("[", t)
        first = F.when(brace == 0, bracket).when(bracket == 0, brace).otherwise(F.least(brace, bracket))
        second = F.when((brace > 0) & (bracket > 0), F.greatest(brace, bracket)).otherwise(F.lit(0))
        return [_scalar(t), _from(t, first), _from(t, second)]

    # coalesce goes on only where nothing is found, so most answers are scanned once
    got = F.coalesce(*of(plain), _bound(_repaired(plain, JSON_REPAIRS), lambda t: F.coalesce(*of(t))))
    return _bound(got, lambda g: F.struct(g["json"].alias("json"), F.coalesce(g["trailing"], F.lit(False)).alias("trailing")))


def quoted_field(text: Column, field: str) -> Column:
    """The string that follows a quoted name anywhere in a text, without escapes; null where there is none."""
    pattern = rf'"{field}"\s*:\s*"([^"]*)"'
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def salvaged_query(text: Column) -> Column:
    """JSON of {"structured_query": ...} from an answer: the first value if it holds such an object, else its single fields if all three can be found and none is empty; else null."""
    got = found_json(text)["json"]
    own = F.get_json_object(got, "$.structured_query")
    fields = {k: quoted_field(text, k) for k in ("filter", "scenario_id", "source")}
    every = F.lit(True)
    for f in fields.values():
        every = every & F.coalesce(f != "", F.lit(False))
    pieces = F.to_json(F.struct(F.struct(*[f.alias(k) for k, f in fields.items()]).alias("structured_query")))
    return F.when(own.startswith("{"), got).when(every, pieces)


def salvaged_support(text: Column) -> Column:
    """JSON of {"response": ..., "tools": [...]} from an answer: the first value if it is an object with a response, else what stands between the two names and the list of tools, if that
    parses; null without a response."""
    got = found_json(text)["json"]
    response = r'(?s)"response"\s*:\s*"(.*?)"\s*,\s*"tools"\s*:'
    tools = F.from_json(found_json(F.regexp_extract(text, r'(?s)"tools"\s*:\s*(\[[^\]]*\])', 1))["json"], "array<string>")
    pieces = F.to_json(F.struct(F.regexp_extract(text, response, 1).alias("response"), F.coalesce(tools, F.array().cast("array<string>")).alias("tools")))
    held = got.startswith("{") & F.array_contains(F.coalesce(F.json_object_keys(got), F.array().cast("array<string>")), "response")
    return F.when(held, got).when(text.rlike(response), pieces)


def salvaged(text: Column, task: Column) -> Column:
    """An answer's JSON object by the schema of its task; null where nothing can be saved."""
    got = found_json(text)["json"]
    return F.when(task == "intelligent_data_query", salvaged_query(text)).when(task == "auxiliary_decision", salvaged_support(text)).otherwise(F.when(got.startswith("{"), got))


def canonical_filter(c: Column) -> Column:
    """A filter as it is written: compacted, and if what is left without blanks is a known filter, that one."""
    text = compact_token(c)
    table = F.create_map(*[F.lit(x) for kv in FILTER_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.regexp_replace(text, r"\s+", "")), text)
