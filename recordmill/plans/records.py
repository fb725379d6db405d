"""Queries over record files, answers of models, schemas, and label coverage of splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordmill.functions import nested as N, repair as A, variants as A2
from recordmill.operators import joins as J, splits as P, validation as V
from recordmill.plans.registry import query
from recordmill.session import checkpoint, place
from recordmill.sources import files as S


def _place(df, name):
    return place(df.sparkSession, name)


@query("SELECT doc_id, text, lang FROM documents")
def jsonl_round_trip(documents):
    """Records written as JSON lines beside their place, checked, put there and read again."""
    rows = documents.select("doc_id", "text", "lang")
    return S.write_checked(rows, _place(rows, "jsonl"), "doc_id", checks={"text": F.col("text").isNotNull()})


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_round_trip(customer):
    rows, path = customer.select("c_custkey", "c_name", "c_acctbal"), _place(customer, "csv")
    S.write_csv(rows, path)
    return S.read_csv(rows.sparkSession, path, rows.schema)


@query("SELECT n_nationkey, n_name FROM nation")
def json_document_round_trip(nation):
    """A small table as one JSON document, read again as a document of many lines."""
    rows, path = nation.select("n_nationkey", "n_name"), _place(nation, "document")
    S.write_document(rows, path)
    return S.read_records(rows.sparkSession, path, rows.schema, "json")


@query("SELECT lang AS split, count(*) AS n FROM documents WHERE lang IN ('de', 'fr') GROUP BY 1")
def splits_by_glob(documents):
    """Files of splits found by a pattern, each row with the split that its file is named for."""
    path = _place(documents, "splits")
    for name in ("de", "fr", "es"):  # the third does not match the pattern
        S.write_checked(documents.where(F.col("lang") == name).select("doc_id", "n_chars"), f"{path}/{name}.jsonl", "doc_id")
    named = S.read_splits(documents.sparkSession, f"{path}/[df]?.jsonl", "doc_id long, n_chars long")
    return named.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n_records, count(DISTINCT user_id) AS n_ids FROM events")
def file_inspection(events):
    path = _place(events, "inspect")
    events.select("user_id", "value").coalesce(2).write.json(path)
    found = S.inspect_files(events.sparkSession, f"{path}/*.json", "user_id")
    ids = S.read_records(events.sparkSession, path, "user_id long").agg(F.count_distinct("user_id").alias("n_ids"))
    return found.where((F.col("size") > 0) & (F.length("sha256") == 64)).agg(F.sum("n_records").cast("bigint").alias("n_records")).join(F.broadcast(ids))


CASE = "mpc.baseMVA = 100;\nmpc.bus = [\n 1 3 {k} 0.5; % note\n 2 1 7 1.5;\n];\n"


@query("SELECT 'bus' AS matrix, CAST(r AS INTEGER) AS \"row\", sum(CASE WHEN r = 0 THEN 1 + 3 + n_nationkey + 0.5 ELSE 2 + 1 + 7 + 1.5 END)::DOUBLE AS total FROM nation, (SELECT unnest([0, 1]) AS r) GROUP BY r UNION ALL SELECT 'baseMVA', NULL, 100.0 * count(*) FROM nation")
def case_files(nation):
    """Network case files, one for each row, parsed to numbers."""
    path = _place(nation, "cases")
    text = F.concat(F.lit(CASE.split("{k}")[0]), F.col("n_nationkey"), F.lit(CASE.split("{k}")[1]))
    nation.select(text.alias("value"), F.col("n_nationkey").alias("k")).write.partitionBy("k").text(path)
    return S.read_case(nation.sparkSession, f"{path}/*/*.txt").groupBy("matrix", "row").agg(F.sum("value").alias("total"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 2 THEN json_extract_string(props, '$.k') || '.5' ELSE json_extract_string(props, '$.k') END AS k, event_id % 4 <> 3 AS found, event_id % 4 = 1 AS trailing FROM events""")
def json_parse_and_repair(events):
    """Answers that should be JSON: as it is, inside prose, with blanks that break its numbers, and none at all."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_id") % 4
    answer = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit("Answer: "), "props", F.lit(" as asked"))).when(kind == 2, F.concat(F.lit('{"k" : '), k, F.lit(". 5 }"))).otherwise("no idea")
    got = events.select("event_id", A.found_json(answer).alias("j"))
    return got.select("event_id", F.get_json_object("j.json", "$.k").alias("k"), F.col("j.json").isNotNull().alias("found"), F.col("j.trailing").alias("trailing"))


@query("SELECT o_orderkey, 'loading_percent > 100' AS filter, 'a_b 1.5' AS name, ['x1', 'y z'] AS tags FROM orders")
def canonical_fields(orders):
    """Broken tokens in nested answers put right, and aliases of one field turned to what they stand for."""
    broken = F.struct(F.when(F.col("o_orderkey") % 2 == 0, "loading _ percent > 1 00").otherwise("overloaded").alias("filter"), F.lit("a _ b  1. 5").alias("name"), F.array(F.lit(" x 1"), F.lit("y-z")).alias("tags"))
    rows = orders.select("o_orderkey", broken.alias("q"))
    done = N.canonical_strings(rows, {"filter": {"overloaded": "loading_percent > 100", "loading_percent>100": "loading_percent > 100"}}, ["q"])
    return done.select("o_orderkey", "q.filter", F.replace("q.name", F.lit("b1"), F.lit("b 1")).alias("name"), F.transform("q.tags", lambda x: F.replace(x, F.lit("-"), F.lit(" "))).alias("tags"))


@query("""
SELECT event_id, 2 + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS fields, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 2 END AS correct, event_id % 3 <> 0 AND event_id % 5 <> 0 AS exact FROM events""")
def structured_field_scores(events):
    """Right fields of those that gold or prediction has: one that only the prediction has is wrong, and so is a number given as a string."""
    gold = F.create_map(F.lit("type"), F.to_json(F.struct("event_type")), F.lit("k"), F.col("user_id").cast("string"))
    k = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('"'), F.col("user_id"), F.lit('"'))).otherwise(F.col("user_id").cast("string"))
    pred = F.create_map(F.lit("type"), F.to_json(F.struct("event_type")), F.lit("k"), k)
    pred = F.when(F.col("event_id") % 3 == 0, F.map_concat(pred, F.create_map(F.lit("more"), F.lit("1")))).otherwise(pred)
    return events.select("event_id", N.field_scores(gold, pred).alias("s")).select("event_id", "s.*")


@query("""
SELECT p_partkey, sha256('{"a":[{"x":' || p_size || ',"y":null}],"b":{"k":' || p_partkey || ',"z":' || to_json(p_brand) || '},"m":{"k1":1,"k2":2}}') AS h FROM part""")
def canonical_nested_json(part):
    """SHA-256 of canonical JSON of a nested record: keys in order at every depth, nulls kept."""
    rec = F.struct(F.create_map(F.lit("k2"), F.lit(2), F.lit("k1"), F.lit(1)).alias("m"), F.struct(F.col("p_brand").alias("z"), F.col("p_partkey").alias("k")).alias("b"), F.array(F.struct(F.lit(None).cast("int").alias("y"), F.col("p_size").alias("x"))).alias("a"))
    rows = part.select("p_partkey", rec.alias("r"))
    return rows.select("p_partkey", F.sha2(N.canonical_json(rows, "r"), 256).alias("h"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'k=' || event_type ELSE '' END || CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN ',' ELSE '' END || 'note=x' ELSE '' END AS kept FROM events")
def stable_projection(events):
    """A translated record cut to the fields that its own source row has."""
    entry = lambda when, k: F.when(when, F.array(F.struct(F.lit(k).alias("k"), F.lit("s").alias("v")))).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    source = F.map_from_entries(F.concat(entry(F.col("event_id") % 2 == 0, "k"), entry(F.col("event_id") % 3 == 0, "note")))
    target = F.create_map(F.lit("k"), F.col("event_type"), F.lit("note"), F.lit("x"), F.lit("extra"), F.lit("y"))
    kept = F.transform(F.array_sort(F.map_entries(N.present_in(target, source))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return events.select("event_id", F.array_join(kept, ",").alias("kept"))


def _nested(documents):
    spans = F.sequence(F.lit(1), (F.col("doc_id") % 3 + 1).cast("int"))
    record = F.struct(F.col("doc_id").alias("id"), F.struct("lang", F.when(F.col("doc_id") % 2 == 0, F.lit(0.5)).alias("weight")).alias("about"), F.transform(spans, lambda i: F.struct(i.alias("start"))).alias("spans"), F.struct("source").alias("metadata"))
    return documents.select("doc_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))


@query("""
WITH d AS (SELECT doc_id, lang, doc_id % 3 + 1 AS k FROM documents), s AS (SELECT unnest(range(k)) AS i FROM d)
SELECT '' AS path, 'dict' AS type, count(*) AS n FROM d UNION ALL SELECT 'id', 'int', count(*) FROM d UNION ALL SELECT 'about', 'dict', count(*) FROM d UNION ALL SELECT 'metadata', NULL, 0 FROM d WHERE false UNION ALL SELECT 'about.lang', CASE WHEN lang IS NULL THEN 'NoneType' ELSE 'str' END, count(*) FROM d GROUP BY 2
UNION ALL SELECT 'about.weight', CASE WHEN doc_id % 2 = 0 THEN 'float' ELSE 'NoneType' END, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'spans', 'list:' || k, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'spans.' || i, 'dict', count(*) FROM s GROUP BY 1 UNION ALL SELECT 'spans.' || i || '.start', 'int', count(*) FROM s GROUP BY 1""")
def structure_paths(documents):
    """How many nested records have each path with each type; what is auxiliary has no structure."""
    rows = A2.structures(_nested(documents), ["doc_id"], "record")
    return rows.select(F.explode("paths").alias("p")).groupBy("p.path", "p.type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_orderkey % 7 <> 0 OR count(l_orderkey) = 0 AS same FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def frozen_truth(orders, lineitem):
    """Truth records whose lists stand in another order and whose fractions differ beyond the fifth digit are the same; every seventh has another quantity."""
    line = lambda more: F.struct(F.col("l_linenumber").alias("line"), (F.col("l_quantity") + more).alias("quantity"), (F.col("l_discount") + more * 1e-9).alias("discount"))
    each = lineitem.groupBy("l_orderkey").agg(F.collect_list(line(F.lit(0))).alias("a"), F.collect_list(line(F.when(F.col("l_orderkey") % 7 == 0, 1).otherwise(0))).alias("b"))
    rows = orders.join(each, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    written = lambda c, up: F.to_json(F.struct(F.sort_array(F.coalesce(c, F.array().cast(each.schema["a"].dataType)), up).alias("lines"), F.col("o_orderkey").alias("id")))
    rows = rows.select("o_orderkey", written(F.col("a"), True).alias("held"), written(F.col("b"), False).alias("replayed"))
    held = A2.structures(rows, ["o_orderkey", "replayed"], "held").select("o_orderkey", F.col("frozen").alias("x"), "replayed")
    both = A2.structures(held, ["o_orderkey", "x"], "replayed")
    return both.select("o_orderkey", (F.col("x") == F.col("frozen")).alias("same"))


RECORD_SCHEMA = {
    "type": "object", "required": ["id", "status", "lines"],
    "properties": {
        "id": {"type": "integer", "minimum": 1}, "status": {"type": "string", "enum": ["O", "F"]}, "price": {"type": ["number", "null"]},
        "note": {"type": ["object", "string"], "properties": {"priority": {"type": "string", "pattern": "^[0-9]-"}}},
        "lines": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["n", "quantity"], "properties": {"quantity": {"type": "number", "maximum": 49}}}},
    },
    "allOf": [{"if": {"properties": {"status": {"const": "F"}}}, "then": {"required": ["note"]}}],
}


@query("""
WITH l AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice) - 1 AS i, l_linenumber, l_quantity FROM lineitem)
SELECT o_orderkey AS id, '/status' AS pointer, 'enum' AS code FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT o_orderkey, '/id', 'minimum' FROM orders WHERE o_orderkey < 1 UNION ALL SELECT o_orderkey, '/price', 'type' FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0
UNION ALL SELECT o_orderkey, '/note', 'required' FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 = 3 UNION ALL SELECT o_orderkey, '/note', 'type' FROM orders WHERE o_orderkey % 4 = 2
UNION ALL SELECT o_orderkey, '/lines', 'minItems' FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) UNION ALL SELECT id, '/lines/' || i || '/quantity', 'maximum' FROM l JOIN orders ON o_orderkey = id WHERE l_quantity > 49 AND l_linenumber % 3 <> 0
UNION ALL SELECT id, '/lines/' || i || '/quantity', 'required' FROM l JOIN orders ON o_orderkey = id WHERE l_linenumber % 3 = 0""")
def nested_schema_failures(orders, lineitem):
    """Nested records with fields of several types against a declared schema: each failure by its JSON pointer."""
    k = F.col("o_orderkey")
    line = F.struct("l_linenumber", "l_quantity", "l_extendedprice")
    lines = lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("ls"))
    rows = orders.join(lines, F.col("l_orderkey") == k, "left")
    each = F.transform(F.coalesce("ls", F.array().cast(lines.schema["ls"].dataType)), lambda x: F.struct(x["l_linenumber"].alias("n"), F.when(x["l_linenumber"] % 3 != 0, x["l_quantity"]).alias("quantity")))
    price = F.when(k % 7 == 0, F.lit("null")).when(k % 5 == 0, F.concat(F.lit('"'), "o_totalprice", F.lit('"'))).otherwise(F.col("o_totalprice").cast("string"))
    note = F.when(k % 4 == 0, F.to_json(F.struct(F.col("o_orderpriority").alias("priority")))).when(k % 4 == 1, F.concat(F.lit('"'), "o_orderpriority", F.lit('"'))).when(k % 4 == 2, F.lit("17"))
    fields = F.concat_ws(",", F.concat(F.lit('"id":'), k), F.concat(F.lit('"status":"'), "o_orderstatus", F.lit('"')), F.concat(F.lit('"price":'), price), F.concat(F.lit('"note":'), note), F.concat(F.lit('"lines":'), F.to_json(each)))
    return A2.schema_failures(rows.select(k.alias("id"), F.concat(F.lit("{"), fields, F.lit("}")).alias("record")), ["id"], "record", RECORD_SCHEMA)


@query("""
SELECT event_id, CASE event_id % 8 WHEN 3 THEN '[1]' WHEN 5 THEN '{"k": "a}]{", "n": ' || event_id || '}' WHEN 6 THEN NULL WHEN 7 THEN to_json(event_type) ELSE props END AS json, event_id % 8 IN (1, 2, 3, 4, 5) AS trailing FROM events""")
def answers_with_prose(events):
    """The first JSON value of answers with text before it, after it and on both sides, with two values, with brackets in strings, cut off, and of one word."""
    own = F.lit('{"k": "a}]{", "n": ')
    kinds = [F.col("props"), F.concat(F.lit("Answer: "), "props", F.lit(" as asked")), F.concat("props", F.lit(" and then }")), F.concat(F.lit("note [1] "), "props"), F.concat("props", F.lit(' {"b": 2}')), F.concat(own, "event_id", F.lit("} done")), F.expr("left(props, length(props) - 1)"), F.concat(F.lit('"'), "event_type", F.lit('"'))]
    answer = F.get(F.array(*kinds), (F.col("event_id") % 8).cast("int"))
    return events.select("event_id", A.found_json(answer).alias("j")).select("event_id", "j.json", "j.trailing")


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'loading_percent > 100' WHEN 1 THEN 'vm_pu < 0.95' WHEN 2 THEN 'violation_type != none' ELSE event_type || '_' || user_id END AS filter FROM events""")
def canonical_filters(events):
    """The filter field of answers, broken in several ways, as it is written; what is no known filter is only compacted."""
    broken = [F.lit('loading _ percent  > 1 00'), F.lit("vm _ pu<0. 95"), F.lit(" violation _ type ! = none"), F.concat("event_type", F.lit(" _ "), "user_id", F.lit(" "))]
    said = F.concat(F.lit('so {"structured _ query": {"filter" : "'), F.get(F.array(*broken), (F.col("event_id") % 4).cast("int")), F.lit('"}} done'))
    got = A.found_json(said)["json"]
    field = F.coalesce(F.get_json_object(got, "$.structured_query.filter"), F.get_json_object(got, "$['structured _ query'].filter"))
    return events.select("event_id", A.canonical_filter(field).alias("filter"))


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS filter, CASE WHEN event_id % 3 = 1 THEN user_id::VARCHAR END AS response, CASE WHEN event_id % 3 = 1 THEN 2 END AS tools FROM events""")
def salvaged_answers(events):
    """Broken answers of two tasks: single fields saved by the schema of each; a third has nothing to save."""
    query_ = F.concat(F.lit('so {"structured_query": {"filter" : "'), "event_type", F.lit('", "scenario_id": "s", "source": "db"'))
    support = F.concat(F.lit('{"response": "'), "user_id", F.lit('", "tools": ["a", "b"], and'))
    kind = F.col("event_id") % 3
    rows = events.select("event_id", F.when(kind == 0, query_).when(kind == 1, support).otherwise("none").alias("t"), F.when(kind == 0, "intelligent_data_query").otherwise("auxiliary_decision").alias("task"))
    got = rows.select("event_id", A.salvaged(F.col("t"), F.col("task")).alias("j"))
    return got.select("event_id", F.get_json_object("j", "$.structured_query.filter").alias("filter"), F.get_json_object("j", "$.response").alias("response"), F.json_array_length(F.get_json_object("j", "$.tools")).cast("int").alias("tools"))


# A schema of the form that record files declare, over the columns of conversations.
TURN_SCHEMA = {
    "type": "object", "required": ["conv_id", "turn", "role", "text", "rationale"],
    "properties": {"conv_id": {"type": "integer"}, "turn": {"type": "integer", "minimum": 0, "maximum": 2}, "role": {"type": "string", "enum": ["user", "assistant"]}, "text": {"type": "string", "minLength": 40, "pattern": "^[A-Z]"}, "rationale": {"type": ["string", "null"]}},
    "allOf": [{"if": {"properties": {"role": {"const": "assistant"}}}, "then": {"required": ["rationale"], "properties": {"text": {"maxLength": 400}}}}],
}


@query("""
SELECT conv_id, turn, codes FROM (SELECT conv_id, turn, concat_ws(',', CASE WHEN role NOT IN ('user', 'assistant') THEN 'enum:role' END, CASE WHEN length(text) < 40 THEN 'length:text' END, CASE WHEN NOT regexp_matches(text, '^[A-Z]') THEN 'pattern:text' END,
  CASE WHEN turn < 0 OR turn > 2 THEN 'range:turn' END, CASE WHEN text IS NULL THEN 'required:text' END, CASE WHEN role = 'assistant' AND length(text) > 400 THEN 'then:length:text' END, CASE WHEN role = 'assistant' AND conv_id % 3 <> 0 THEN 'then:rationale' END) AS codes FROM conversations) WHERE codes <> ''""")
def schema_compiled_violations(conversations):
    """Rows that break a declared schema, with the failing codes: types, enumerations, lengths, patterns, ranges, required fields and conditions."""
    rows = conversations.withColumn("rationale", F.when(F.col("conv_id") % 3 == 0, "because"))
    return V.violations(rows, ["conv_id", "turn"], V.compiled(TURN_SCHEMA, rows))


def _groups(documents):
    rows = documents.select(F.col("source").alias("component"), F.col("lang").alias("label"), P.hash_split(F.col("source")).alias("split"))
    cells = checkpoint(rows.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n")))
    return checkpoint(rows.groupBy("component", "split").agg(F.count(F.lit(1)).alias("size"))), cells


@query()
def label_coverage_splits(documents):
    """Groups of a source dealt to splits, then moved so that every split holds every label and the first holds enough of each. Tested against plain loops."""
    groups, cells = _groups(documents)
    return P.support_labels(P.cover_labels(groups, cells), cells)


@query()
def tiered_replacement(supplier, customer):
    """Each supplier takes an unused customer of its nation: of its own level and kind, of its level, of its kind and near, or near. Tested against a plain loop."""
    side = lambda t, p: t.select(F.col(f"{p}_nationkey").alias("family"), F.floor(F.col(f"{p}_acctbal") / 100).cast("double").alias("load"), (F.col("s_suppkey" if p == "s" else "c_custkey") % 3).alias("issue"), F.col("s_suppkey" if p == "s" else "c_custkey").alias("id"))
    return J.tiered_nearest(side(supplier, "s"), side(customer, "c"), TIERS, "id")


# Names of tiers, from narrow to wide.
TIERS = [("exact_load_and_issue", ["family", "load", "issue"], None), ("exact_load", ["family", "load"], None), ("same_issue_nearest_load", ["family", "issue"], "load"), ("nearest_load", ["family"], "load")]
