"""Structured queries, predicates and projections over operating states (orders as states, lineitem as elements)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordmill.functions import text as X
from recordmill.operators import evidence as E, query_baseline as Q, rendering as D, states as S
from recordmill.plans.registry import query

ELEMENTS = "SELECT l_orderkey AS scenario_id, CASE WHEN l_linestatus = 'O' THEN 'line' ELSE 'transformer' END AS equipment, l_linenumber AS element, l_quantity * 4 AS loading_percent, 1.0 - l_discount + l_tax AS vm_pu FROM lineitem"


def elements(lineitem):
    return lineitem.select(F.col("l_orderkey").alias("scenario_id"), F.when(F.col("l_linestatus") == "O", "line").otherwise("transformer").alias("equipment"), F.col("l_linenumber").alias("element"), (F.col("l_quantity") * 4).alias("loading_percent"), (F.lit(1.0) - F.col("l_discount") + F.col("l_tax")).alias("vm_pu"))


def states(orders, lineitem):
    return S.nest_states(orders.select(F.col("o_orderkey").alias("scenario_id"), F.col("o_orderstatus").alias("network"), F.col("o_orderpriority").alias("priority")), elements(lineitem))


def asked(states, filters, scopes=("all",)):
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(s).alias("equipment_scope")) for f in filters for s in scopes])).alias("q")
    return states.select("scenario_id", each).select("scenario_id", "q.*")


@query(f"""
WITH e AS ({ELEMENTS}), q AS (SELECT o_orderkey AS scenario_id, unnest(['line', 'transformer', 'all']) AS equipment_scope FROM orders)
SELECT q.scenario_id, equipment_scope, CAST(count(e.element) AS INTEGER) AS "count", max(e.loading_percent) AS max_loading_percent
FROM q LEFT JOIN e ON e.scenario_id = q.scenario_id AND e.loading_percent > 100 AND (q.equipment_scope = 'all' OR e.equipment = q.equipment_scope) GROUP BY 1, 2""")
def structured_query(orders, lineitem):
    s = states(orders, lineitem)
    return S.run_queries(asked(s, S.FILTERS[:1], S.SCOPES), s).select("scenario_id", "equipment_scope", "count", "max_loading_percent")


@query(f"""
SELECT o_orderkey AS scenario_id, CAST(count(e.element) AS INTEGER) AS "count", min(e.vm_pu) AS min_vm_pu
FROM orders LEFT JOIN ({ELEMENTS}) e ON e.scenario_id = o_orderkey AND e.vm_pu < 0.95 GROUP BY 1""")
def structured_query_low_voltage(orders, lineitem):
    s = states(orders, lineitem)
    return S.run_queries(asked(s, S.FILTERS[1:2]), s).select("scenario_id", "count", "min_vm_pu")


@query(f"""
SELECT o_orderkey AS scenario_id, concat_ws(',', CASE WHEN count(*) FILTER (e.loading_percent > 100) > 0 THEN 'thermal_overload' END, CASE WHEN count(*) FILTER (e.vm_pu < 0.95) > 0 THEN 'low_voltage' END, CASE WHEN count(*) FILTER (e.vm_pu > 1.05) > 0 THEN 'high_voltage' END) AS violation_types
FROM orders LEFT JOIN ({ELEMENTS}) e ON e.scenario_id = o_orderkey GROUP BY 1""")
def structured_query_violation_types(orders, lineitem):
    s = states(orders, lineitem)
    return S.run_queries(asked(s, S.FILTERS[2:]), s).select("scenario_id", "violation_types")


@query("""
SELECT o_orderkey AS scenario_id, concat_ws(',', CASE WHEN o_orderkey % 11 = 0 THEN 'aggregation' END, CASE WHEN o_orderkey % 7 = 0 THEN 'filter' END, CASE WHEN o_orderkey % 5 = 0 THEN 'scope' END, CASE WHEN o_orderkey % 3 = 0 THEN 'version' END) AS errors FROM orders""")
def query_shape_errors(orders):
    k = F.col("o_orderkey")
    q = F.struct(F.when(k % 7 != 0, S.FILTERS[0]).otherwise("loading > 1").alias("filter"), F.when(k % 5 != 0, "line").alias("scope"), F.when(k % 11 != 0, "complete_list_and_max").otherwise("sum").alias("aggregation"), F.when(k % 3 != 0, "2").otherwise("1").alias("version"))
    return orders.select(k.alias("scenario_id"), q.alias("q")).select("scenario_id", S.shape_errors(F.col("q")).alias("errors"))


@query("""
SELECT o_orderkey AS scenario_id, (count(l_orderkey) = (o_orderkey % 6) AND o_orderstatus <> 'P') AS truth_complete FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def truth_complete_flag(orders, lineitem):
    held = lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    j = orders.join(held, orders["o_orderkey"] == held["l_orderkey"], "left")
    return j.select(F.col("o_orderkey").alias("scenario_id"), S.truth_complete(F.col("o_orderkey") % 6, F.coalesce("n", F.lit(0)), F.col("o_orderstatus") != "P").alias("truth_complete"))


@query(f"""
WITH e AS ({ELEMENTS}), q AS (SELECT o_orderkey AS scenario_id, unnest(['line', 'transformer', NULL]) AS equipment_scope FROM orders)
SELECT q.scenario_id, equipment_scope, coalesce(string_agg(e.equipment || ':' || e.element || ':' || CAST(e.loading_percent AS BIGINT), ',' ORDER BY e.equipment, e.element, e.loading_percent), '') AS records,
  CASE WHEN equipment_scope IS NOT NULL THEN CAST(count(e.element) AS INTEGER) END AS "count"
FROM q LEFT JOIN e ON e.scenario_id = q.scenario_id AND e.loading_percent > 100 AND (q.equipment_scope IS NULL OR e.equipment = q.equipment_scope) GROUP BY 1, 2""")
def structured_query_records(orders, lineitem):
    """The sorted records of each query; without a scope it is one of the old form."""
    s = states(orders, lineitem)
    found = S.run_queries(asked(s, S.FILTERS[:1], ("line", "transformer", None)), s)
    written = F.array_join(F.transform("records", lambda x: F.concat_ws(":", x["equipment"], x["element"], x["loading_percent"].cast("bigint"))), ",")
    return found.select("scenario_id", "equipment_scope", written.alias("records"), "count")


@query(f"""
WITH e AS (SELECT * FROM ({ELEMENTS}) WHERE loading_percent > 100 AND equipment = 'line'), t AS (SELECT o_orderkey AS k, count(element) AS n, max(loading_percent) AS m FROM orders LEFT JOIN e ON scenario_id = o_orderkey GROUP BY 1)
SELECT k AS scenario_id, concat_ws(',', CASE WHEN k % 3 = 0 AND NOT (k % 17 = 0) THEN 'output_structured_query_mismatch' END, CASE WHEN k % 5 = 0 THEN 'overload_query_count_mismatch' END,
  CASE WHEN k % 7 = 0 THEN 'overload_query_max_aggregation_mismatch' END, CASE WHEN k % 17 = 0 THEN 'overload_query_result_scope_mismatch' END, CASE WHEN k % 11 = 0 THEN 'query_result_mirror_mismatch' END, CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN 'query_result_truth_mismatch' END,
  CASE WHEN k % 17 = 0 THEN 'query_tool_args_mismatch' WHEN k % 13 = 0 THEN 'query_tool_plan_mismatch' END, CASE WHEN k % 2 = 0 THEN 'scenario_id_mismatch' END) AS errors
FROM t WHERE NOT (k % 17 = 0 AND (k % 3 = 0 OR k % 13 = 0)) ORDER BY 1""")
def query_contract_errors(orders, lineitem):
    """Query records with planted faults against the contract, the result against the query run again."""
    s, k = states(orders, lineitem), F.col("scenario_id")
    truth = S.run_queries(asked(s, S.FILTERS[:1], ("line",)), s)
    query = lambda agg, scope: F.struct(k.alias("scenario_id"), F.lit(S.FILTERS[0]).alias("filter"), scope.alias("scope"), agg.alias("aggregation"), F.lit("2").alias("version"))
    fine, line, of_17 = F.lit("complete_list_and_max"), F.lit("line"), k % 17 == 0
    result = lambda off: F.struct(F.when(of_17, "all").otherwise(line).alias("equipment_scope"), "records", (F.col("count") + F.when(k % 5 == 0, 1).otherwise(0) + off).alias("count"), F.when(k % 7 == 0, -1.0).otherwise(F.col("max_loading_percent")).alias("max_loading_percent"))
    rows = truth.where(~(of_17 & ((k % 3 == 0) | (k % 13 == 0)))).select(
        "scenario_id", k.alias("source_case_id"), F.when(k % 2 == 0, k + 1).otherwise(k).alias("input_id"), query(fine, line).alias("query"), query(F.when(k % 3 == 0, "sum").otherwise(fine), line).alias("output_query"),
        F.when(k % 13 == 0, F.array().cast("array<struct<tool:string,args:struct<scenario_id:bigint,filter:string,scope:string,aggregation:string,version:string>>>")).otherwise(F.array(F.struct(F.lit("query_simulation_records").alias("tool"), query(F.when(of_17, "sum").otherwise(fine), line).alias("args")))).alias("tools"),
        result(F.lit(0)).alias("result"), result(F.when(k % 11 == 0, 1).otherwise(0)).alias("output_result"),
    )
    return S.contract_errors(rows, s).select("scenario_id", "errors")


STATE_SQL = f"""
SELECT o_orderkey AS scenario_id, count(*) FILTER (e.loading_percent > 100) AS n_thermal, count(*) FILTER (e.vm_pu < 0.95) AS n_low, count(*) FILTER (e.vm_pu > 1.05) AS n_high, coalesce(max(e.loading_percent), 0) AS load, coalesce(min(e.vm_pu), 1) AS low, coalesce(max(e.vm_pu), 1) AS high
FROM orders LEFT JOIN ({ELEMENTS}) e ON e.scenario_id = o_orderkey GROUP BY 1"""
CLASSES = """SELECT *, CASE WHEN n_thermal > 0 AND n_low + n_high > 0 THEN 'combined' WHEN n_thermal > 0 THEN 'thermal' WHEN n_low + n_high > 0 THEN 'voltage' ELSE 'normal' END AS profile,
  CASE WHEN load > 110 OR low < 0.92 OR high > 1.08 THEN 'emergency' WHEN load > 100 OR low < 0.95 OR high > 1.05 THEN 'alert' ELSE 'normal' END AS severity, load >= 98 OR low < 0.97 OR high > 1.04 AS near_limit FROM"""


def classified(orders, lineitem):
    e = elements(lineitem)
    count = lambda wrong, name: F.count_if(wrong).alias(name)
    per = e.groupBy("scenario_id").agg(count(F.col("loading_percent") > S.OVERLOAD, "n_thermal"), count(F.col("vm_pu") < S.LOW_VOLTAGE, "n_low"), count(F.col("vm_pu") > S.HIGH_VOLTAGE, "n_high"), F.max("loading_percent").alias("max_loading"), F.min("vm_pu").alias("min_vm"), F.max("vm_pu").alias("max_vm"))
    j = orders.select(F.col("o_orderkey").alias("scenario_id"), "o_orderpriority").join(per, "scenario_id", "left").fillna(0, ["n_thermal", "n_low", "n_high"])
    extremes = [F.col(c) for c in ("max_loading", "min_vm", "max_vm")]
    return j.withColumns({"profile": S.profile(F.col("n_thermal") > 0, F.col("n_low") + F.col("n_high") > 0), "severity": S.severity(*extremes), "near_limit": S.near_limit(*extremes)})


@query(f"SELECT scenario_id, n_thermal, n_low, n_high, profile, severity, near_limit FROM ({CLASSES} ({STATE_SQL}))")
def state_classification(orders, lineitem):
    return classified(orders, lineitem).select("scenario_id", "n_thermal", "n_low", "n_high", "profile", "severity", "near_limit")


ACTIONS = ("Continue to increase section power", "Keep current flow and monitor", "Reactive power compensation first", "Redispatch nearby units", "Staged load transfer", "Restore the faulted line without checking", "Wait")
ACTIONS_SQL = "[" + ", ".join(f"'{a}'" for a in ACTIONS) + "]"
CATEGORY_SQL = "['risky_increase', 'monitor_only', 'corrective_voltage', 'corrective_redispatch', 'corrective_topology', 'premature_restore']"


DECISION_SQL = f"""
SELECT scenario_id, action, category, CASE
  WHEN category IS NULL THEN NULL
  WHEN category = 'premature_restore' THEN CASE WHEN profile <> 'normal' OR severity <> 'normal' THEN 'non_compliant' ELSE 'compliant_with_monitoring' END
  WHEN category = 'risky_increase' THEN CASE WHEN profile <> 'normal' OR near_limit THEN 'non_compliant' ELSE 'compliant_with_monitoring' END
  WHEN profile = 'normal' THEN CASE WHEN category = 'monitor_only' AND near_limit THEN 'compliant_with_monitoring' WHEN category = 'corrective_topology' THEN 'compliant_with_monitoring' ELSE 'compliant' END
  WHEN category = 'monitor_only' THEN CASE WHEN severity = 'emergency' OR profile = 'combined' OR load >= 115 OR low < 0.92 OR high > 1.08 THEN 'non_compliant' ELSE 'compliant_with_monitoring' END
  WHEN category = 'corrective_voltage' AND profile = 'thermal' THEN CASE WHEN load >= 115 THEN 'non_compliant' WHEN load < 108 THEN 'compliant' ELSE 'compliant_with_monitoring' END
  WHEN category IN ('corrective_redispatch', 'corrective_topology') AND profile = 'voltage' AND (low < 0.92 OR high > 1.08) THEN 'non_compliant'
  WHEN category = 'corrective_redispatch' AND profile = 'thermal' AND load < 105 THEN 'compliant'
  WHEN category = 'corrective_topology' AND profile = 'thermal' AND load < 108 THEN 'compliant'
  ELSE 'compliant_with_monitoring' END AS label
FROM (SELECT *, {ACTIONS_SQL}[1 + scenario_id % 7] AS action, CASE WHEN scenario_id % 7 < 6 THEN {CATEGORY_SQL}[1 + scenario_id % 7] END AS category FROM ({CLASSES} ({STATE_SQL})))"""


@query(DECISION_SQL)
def decision_table_label(orders, lineitem):
    """The compliance label of an action in each state, its category read from its wording."""
    c = classified(orders, lineitem).withColumn("action", F.element_at(F.array(*map(F.lit, ACTIONS)), (F.col("scenario_id") % 7 + 1).cast("int")))
    label = S.decision(F.col("category"), *[F.col(x) for x in ("profile", "severity", "max_loading", "min_vm", "max_vm")])
    return c.withColumn("category", S.category_of(F.col("action"))).select("scenario_id", "action", "category", label.alias("label"))


@query(f"""
SELECT scenario_id, concat_ws(',', CASE WHEN d.label IS NOT NULL AND (scenario_id % 9 = 0 OR scenario_id % 10 = 0) AND d.label <> 'non_compliant' THEN 'compliance_label_mismatch' END,
  CASE WHEN profile = 'normal' AND NOT near_limit AND (scenario_id % 9 = 0 OR scenario_id % 10 = 0) AND scenario_id % 4 <> 0 THEN 'non_compliant_without_detected_issue' END, CASE WHEN profile <> 'normal' AND scenario_id % 5 = 0 THEN 'rationale_denies_existing_issues' END) AS errors
FROM ({DECISION_SQL}) d JOIN ({CLASSES} ({STATE_SQL})) USING (scenario_id)""")
def compliance_record_errors(orders, lineitem):
    """Stated labels, some of them wrong, and rationales against what the decision table gives."""
    k = F.col("scenario_id")
    c = classified(orders, lineitem).withColumns({"action": F.element_at(F.array(*map(F.lit, ACTIONS)), (k % 7 + 1).cast("int")), "category": F.lit(None).cast("string")})
    right = S.decision(S.category_of(F.col("action")), *[F.col(x) for x in ("profile", "severity", "max_loading", "min_vm", "max_vm")])
    wrong = (k % 9 == 0) | (k % 10 == 0)
    prose = F.concat(F.when(k % 5 == 0, "There is no overload or voltage violation. ").otherwise("Checked. "), F.when(k % 4 == 0, "The state is close to limit.").otherwise(""))
    return S.compliance_errors(c.withColumns({"label": F.when(wrong, S.NON_COMPLIANT).otherwise(right), "rationale": prose})).select("scenario_id", "errors")


@query(f"""
WITH r AS (SELECT o_orderkey AS scenario_id, o_orderkey % 2 = 0 AS migrated, CASE WHEN o_orderkey % 2 = 1 THEN 'line' ELSE ['line', 'transformer', 'all', 'transformer'][1 + (o_orderkey // 2) % 4] END AS scope FROM orders)
SELECT r.scenario_id, scope, migrated, CASE WHEN migrated THEN '3' ELSE '2' END AS version, CAST(count(e.element) AS INTEGER) AS "count", max(e.loading_percent) AS max_loading_percent
FROM r LEFT JOIN ({ELEMENTS}) e ON e.scenario_id = r.scenario_id AND e.loading_percent > 100 AND (r.scope = 'all' OR e.equipment = r.scope) GROUP BY 1, 2, 3, 4""")
def query_upgrade(orders, lineitem):
    """Queries of the old form, every other one, brought to the present form by their prose and run again."""
    k, s = F.col("scenario_id"), states(orders, lineitem)
    prose = F.element_at(F.array(*map(F.lit, ("Which lines are overloaded?", "List each overloaded trafo", "List the outliners", "Transformers and lines over 100 %"))), (F.floor(k / 2) % 4 + 1).cast("int"))
    q = F.struct(F.lit(S.FILTERS[0]).alias("filter"), F.when(k % 2 == 1, "line").alias("scope"), F.when(k % 2 == 1, "complete_list_and_max").alias("aggregation"), F.when(k % 2 == 1, "2").alias("version"))
    out = S.upgraded(s.select("scenario_id", prose.alias("prose"), q.alias("query")), s)
    return out.where(F.col("query").eqNullSafe(F.col("output_query")) & F.col("query").eqNullSafe(F.col("tool.args"))).select("scenario_id", "query.scope", "migrated", "query.version", "count", "max_loading_percent")


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr')")
def task_filter(documents):
    return documents.where(F.col("lang").isin("de", "fr")).select("doc_id", "lang")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k.deeper') AS missing FROM events")
def dotted_path(events):
    return events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.k.deeper").alias("missing"))


@query("""
SELECT doc_id, CASE WHEN lang = 'es' THEN 'language' WHEN source IN ('src3', 'src7') THEN 'source' WHEN CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 = 0 THEN 'hash_bucket' END AS ood_reason FROM documents""")
def ood_bucket(documents):
    reason = F.when(F.col("lang") == "es", "language").when(F.col("source").isin("src3", "src7"), "source").when(X.hash_bucket(F.col("doc_id"), 10) == 0, "hash_bucket")
    return documents.select("doc_id", reason.alias("ood_reason"))


@query("""
SELECT stratum, count(*) AS n FROM (SELECT doc_id, unnest(list_filter([CASE WHEN n_chars > 2000 THEN 'long' END, CASE WHEN n_chars < 900 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'foreign' END, 'any'], lambda x: x IS NOT NULL)) AS stratum FROM documents) GROUP BY 1""")
def strata_labels(documents):
    tags = F.array_compact(F.array(F.when(F.col("n_chars") > 2000, "long"), F.when(F.col("n_chars") < 900, "short"), F.when(F.col("lang") != "en", "foreign"), F.lit("any")))
    return documents.select(F.explode(tags).alias("stratum")).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


TASKS = ("operation_ticket_check", "dispatcher_intent_tool_call", "regulation_compliance_check", "other")
HINTS = ("the permit is there", "please confirm it", "a constrained section", "nothing of note")


@query("""
SELECT k AS o_orderkey, CASE WHEN k % 4 = 0 THEN h = 0 WHEN k % 4 = 1 THEN h = 1 WHEN k % 4 = 2 THEN h = 2 OR k % 5 = 0 ELSE false END AS boundary FROM (SELECT o_orderkey AS k, (o_orderkey // 4) % 4 AS h FROM orders)""")
def boundary_candidates(orders):
    """Records near a decision's boundary, by the words of their task or the profile of their state."""
    k = F.col("o_orderkey")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    near = E.boundary_case(pick(TASKS, k % 4), pick(HINTS, F.floor(k / 4) % 4), F.when(k % 5 == 0, "Voltage"))
    return orders.select("o_orderkey", near.alias("boundary"))


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_linenumber % 2 = 0 THEN l_quantity * 4 WHEN l_quantity * 4 < 10 THEN l_quantity * 400 ELSE l_quantity * 4 END AS load, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE round(1.0 - l_discount, 2) END AS low, CASE WHEN l_orderkey % 3 = 0 AND l_orderkey % 5 <> 0 THEN round(1.0 + l_tax, 2) END AS high FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN load IS NULL THEN NULL WHEN load > 110 OR low < 0.92 OR coalesce(high, 1) > 1.08 THEN 'emergency' WHEN load > 100 OR low < 0.95 OR coalesce(high, 1) > 1.05 THEN 'alert' ELSE 'normal' END AS severity, round(load, 6) AS percent FROM v""")
def severity_from_text(lineitem):
    """The severity that a state's prose gives: loadings as ratios or in percent, voltages that may be missing, and prose without numbers."""
    k = F.col("l_orderkey")
    loading = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("maximum line loading rate: "), F.format_string("%.2f", F.col("l_quantity") * 4 / 100))).otherwise(F.concat(F.lit("Max branch loading "), (F.col("l_quantity") * 4).cast("bigint")))
    low = F.concat(F.lit("; min bus voltage: "), F.format_string("%.2f", 1 - F.col("l_discount")))
    high = F.when(k % 3 == 0, F.concat(F.lit("; maximum bus voltage "), F.format_string("%.2f", 1 + F.col("l_tax")))).otherwise("")
    prose = F.when(k % 5 == 0, "all as it was").otherwise(F.concat(loading, low, high))
    return lineitem.select("l_orderkey", "l_linenumber", E.severity_of_prose(prose).alias("severity"), F.round(E.state_numbers(prose)["loading"], 6).alias("percent"))


@query("""
SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'exact' WHEN contains(lower(p_name), '1') AND contains(lower(p_name), '2') THEN 'both' WHEN contains(lower(p_name), '1') THEN 'one' ELSE 'other' END AS surface, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS bucket FROM part""")
def surface_and_enum_buckets(part):
    n = F.lower("p_name")
    has = lambda x: F.contains(n, F.lit(x))
    return part.select("p_partkey", F.when(F.col("p_type") == "PROMO", "exact").when(has("1") & has("2"), "both").when(has("1"), "one").otherwise("other").alias("surface"), F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large").alias("bucket"))


@query("SELECT doc_id, concat_ws(',', CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN trim(text) = '' OR text IS NULL THEN 'text' END, CASE WHEN toxic IS NULL THEN 'toxic' END) AS missing FROM documents LEFT JOIN labels USING (doc_id)")
def missing_fields(documents, labels):
    j = documents.join(labels, "doc_id", "left")
    return j.select("doc_id", F.concat_ws(",", F.when(F.col("quality").isNull(), "quality"), F.when(F.col("text").isNull() | (F.trim("text") == ""), "text"), F.when(F.col("toxic").isNull(), "toxic")).alias("missing"))


@query("""
SELECT c_custkey, regexp_extract(c_name, '^([A-Za-z]+)[#_ -]*0*([0-9]+)$', 1) AS family, CAST(nullif(regexp_extract(c_name, '^([A-Za-z]+)[#_ -]*0*([0-9]+)$', 2), '') AS BIGINT) AS number FROM customer""")
def id_parse(customer):
    pattern = "^([A-Za-z]+)[#_ -]*0*([0-9]+)$"
    return customer.select("c_custkey", F.regexp_extract("c_name", pattern, 1).alias("family"), F.nullif(F.regexp_extract("c_name", pattern, 2), F.lit("")).cast("bigint").alias("number"))


@query("SELECT doc_id, 'lang: ' || lang || chr(10) || 'source: ' || source || chr(10) || 'text: ' || text AS view, '[MASKED_source]' AS source, CAST(NULL AS VARCHAR) AS blank FROM documents")
def text_views_and_masks(documents):
    """Whole fields joined in a view, and a field masked."""
    view = F.concat_ws("\n", F.concat(F.lit("lang: "), "lang"), F.concat(F.lit("source: "), "source"), F.concat(F.lit("text: "), "text"))
    return documents.select("doc_id", view.alias("view"), F.lit("[MASKED_source]").alias("source"), F.lit(None).cast("string").alias("blank"))


@query("""
WITH f AS (SELECT conv_id, turn, 'text: ' || text AS t, 'role: ' || role AS r FROM conversations)
SELECT conv_id, turn, variant, CASE variant WHEN 'full' THEN t || chr(10) || r WHEN 'no_text' THEN r WHEN 'text_only' THEN t WHEN 'mask_role' THEN t || chr(10) || 'role: [MASKED_role]' ELSE regexp_replace(t || chr(10) || r, '\\b(user|the)\\b', '[MASK]', 'gi') END AS text
FROM f, (SELECT unnest(['full', 'no_text', 'text_only', 'mask_role', 'keywords_masked']) AS variant)""")
def ablation_variants(conversations):
    """The views of a record with fields left out, kept alone or masked."""
    v = F.explode(X.ablations({"text": F.col("text"), "role": F.col("role")}, "text", ("user", "the"))).alias("v")
    return conversations.select("conv_id", "turn", v).select("conv_id", "turn", "v.variant", "v.text")


@query("""
SELECT system, load, line_index, count(*) AS n FROM (SELECT o_orderstatus AS system, regexp_replace(regexp_replace(CAST(CAST(l_discount AS DECIMAL(18,6)) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS load, l_linenumber AS line_index FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY ALL""")
def denominator_identity(lineitem, orders):
    j = lineitem.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy(F.col("o_orderstatus").alias("system"), X.decimal_form(F.col("l_discount")).alias("load"), F.col("l_linenumber").alias("line_index")).agg(F.count(F.lit(1)).alias("n"))


ASKS = (
    ("loading_percent > 100", "line", ("list the lines loaded beyond their limit", "which line carries more than it may", "overloaded lines and the worst of them")),
    ("loading_percent > 100", "transformer", ("transformers above their rating", "which transformer is overloaded", "list transformers beyond the thermal limit")),
    ("loading_percent > 100", "all", ("every overloaded element whatever its kind", "all equipment above its rating", "anything loaded beyond its limit")),
    ("loading_percent > 100", None, ("overloads of the case in the old form", "legacy list of loadings above one hundred", "old style overload records")),
    ("vm_pu < 0.95", None, ("buses with low voltage", "where is the voltage below its bound", "undervoltage at which buses")),
    ("violation_type != none", None, ("what kinds of violation does the case have", "is any limit violated and of which sort", "types of violations present")),
)


def asked_in_words(orders):
    """A record a state: a request in words with the state's customer and clerk, its query's class, the state meant and the one shown (none for every 23rd)."""
    k = F.col("o_orderkey")
    asks = F.array(*[F.struct(Q.query_label(F.lit(f), F.lit(s).cast("string")).alias("label"), F.array(*map(F.lit, words)).alias("words")) for f, s, words in ASKS])
    ask = F.get(asks, (F.xxhash64(k) % 3 + 2).cast("int") + F.when(F.col("o_orderstatus") == "O", 0).otherwise(1))
    rows = orders.select(k.alias("id"), "o_orderpriority", "o_custkey", ask.alias("ask"))
    text = F.concat_ws(" ", F.lit("customer"), F.col("o_custkey").cast("string"), F.get("ask.words", F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(3)).cast("int")), F.col("o_orderpriority"))
    return rows.select("id", text.alias("text"), F.col("ask.label").alias("label"), F.col("id").alias("gold_state"), F.when(F.col("id") % 23 != 0, F.col("id")).alias("shown_state"), (X.hash_bucket(F.col("id"), 5) == 0).alias("held_out"))


@query()
def query_label_baseline(orders, lineitem):
    """Requests in words classified by a linear model, the classes turned into queries, run again on the states, and scored; scores are held against plain ones in the tests."""
    from recordmill.operators import linear as L

    rows = asked_in_words(orders)
    found, _ = L.classified(rows, "id", "label", "held_out", features=20_000)
    told = found.select("id", F.col("label").alias("gold_label"), F.col("pred").alias("pred_label")).join(rows.select("id", "gold_state", "shown_state"), "id")
    return Q.summary(Q.scored(told, states(orders, lineitem)))


@query(f"""
WITH e AS ({ELEMENTS}), r AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'line' WHEN 1 THEN 'transformer' WHEN 2 THEN 'all' ELSE 'voltage' END AS gold, CASE WHEN o_orderkey % 3 = 0 THEN 'all' WHEN o_orderkey % 4 = 0 THEN 'line' WHEN o_orderkey % 4 = 1 THEN 'transformer' WHEN o_orderkey % 4 = 2 THEN 'all' ELSE 'voltage' END AS pred, o_orderkey % 5 <> 0 AS shown FROM orders),
f AS (SELECT o_orderkey AS id, coalesce(list(equipment || element || ':' || loading_percent ORDER BY equipment, element, loading_percent) FILTER (loading_percent > 100 AND equipment = 'line'), []) AS line, coalesce(list(equipment || element || ':' || loading_percent ORDER BY equipment, element, loading_percent) FILTER (loading_percent > 100 AND equipment = 'transformer'), []) AS trafo, coalesce(list(equipment || element || ':' || loading_percent ORDER BY equipment, element, loading_percent) FILTER (loading_percent > 100), []) AS every FROM orders LEFT JOIN e ON scenario_id = o_orderkey GROUP BY 1),
g AS (SELECT r.*, CASE gold WHEN 'line' THEN line WHEN 'transformer' THEN trafo ELSE every END AS a, every AS b FROM r JOIN f USING (id))
SELECT id, gold = pred AS label_right, gold = pred AND shown AS exact, gold = pred AS schema_exact, shown AS state_exact,
  round(CASE WHEN gold = 'voltage' AND pred = 'voltage' THEN (2 + shown::INT) / 3.0 WHEN gold = 'voltage' THEN shown::INT / 6.0 WHEN gold = pred THEN (4 + shown::INT) / 5.0 ELSE (3 + shown::INT) / 5.0 END, 6) AS field_accuracy,
  shown AND (gold = pred OR gold <> 'voltage' AND a = b) AS same_result FROM g""")
def query_label_scores(orders, lineitem):
    """Queries of given and of predicted classes, by fields and by what they return; every fifth record shows no state, every third is taken for one of all equipment."""
    k = F.col("o_orderkey")
    label = lambda name: F.when(name == "voltage", F.lit(S.FILTERS[1])).otherwise(Q.query_label(F.lit(S.FILTERS[0]), name))
    gold = F.when(k % 4 == 0, "line").when(k % 4 == 1, "transformer").when(k % 4 == 2, "all").otherwise("voltage")
    rows = orders.select(k.alias("id"), label(gold).alias("gold_label"), label(F.when(k % 3 == 0, "all").otherwise(gold)).alias("pred_label"), k.alias("gold_state"), F.when(k % 5 != 0, k).alias("shown_state"))
    return Q.scored(rows, states(orders, lineitem)).select("id", "label_right", "exact", "schema_exact", "state_exact", F.round("field_accuracy", 6).alias("field_accuracy"), "same_result")


_ID = "lpad(n::VARCHAR, greatest(6, length(n::VARCHAR))::INTEGER, '0')"


@query(f"""
WITH e AS ({ELEMENTS}), o AS (SELECT o_orderkey AS scenario_id, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders), q AS (SELECT *, ['line', 'transformer', 'all'][1 + (n - 1) % 3] AS scope FROM o),
c AS (SELECT q.scenario_id, n, scope, count(e.element)::INTEGER AS k, max(e.loading_percent) AS m FROM q LEFT JOIN e ON e.scenario_id = q.scenario_id AND e.loading_percent > 100 AND (scope = 'all' OR e.equipment = scope) GROUP BY 1, 2, 3)
SELECT 'query_' || {_ID} AS id, 'intelligent_data_query' AS task_type, scenario_id, replace(replace({list(D.QUESTIONS)!r}[1 + ((n - 1) // 3) % 3], '{{scope}}', scope), '{{case}}', scenario_id::VARCHAR) AS instruction,
  '{{"filter":"loading_percent > 100","scenario_id":"' || scenario_id || '","scope":"' || scope || '","aggregation":"complete_list_and_max","version":"2"}}' AS structured_query, k AS n, m AS worst FROM c""")
def rendered_query_records(orders, lineitem):
    """A question for each state, its query, and the result of the query on the state."""
    made = D.query_records(states(orders, lineitem), ["scenario_id"])
    return made.select("id", "task_type", "scenario_id", "instruction", "structured_query", "n", F.get_json_object("query_result", "$.max_loading_percent").cast("double").alias("worst"))


@query(f"""
WITH s AS (SELECT *, row_number() OVER (ORDER BY scenario_id) AS n FROM ({CLASSES} ({STATE_SQL}))), d AS (
{DECISION_SQL.replace("1 + scenario_id % 7", "1 + (n - 1) % 7").replace("scenario_id % 7 < 6", "(n - 1) % 7 < 6").replace(f"FROM ({CLASSES} ({STATE_SQL})))", "FROM s)")})
SELECT 'compliance_' || {_ID} AS id, 'regulation_compliance_check' AS task_type, scenario_id, replace(replace({list(D.JUDGEMENTS)!r}[1 + ((n - 1) // 7) % 3], '{{action}}', action), '{{case}}', scenario_id::VARCHAR) AS instruction, action, category, label AS compliance_label,
  'In this state ' || coalesce(nullif(concat_ws(', ', CASE WHEN n_thermal > 0 THEN n_thermal || ' overloaded' END, CASE WHEN n_low > 0 THEN n_low || ' low voltage' END, CASE WHEN n_high > 0 THEN n_high || ' high voltage' END), ''), 'no limit is violated') || '; severity ' || severity || '; it may ' || CASE label WHEN 'compliant' THEN '' WHEN 'non_compliant' THEN 'not ' ELSE '' END || 'be carried out' || CASE label WHEN 'compliant_with_monitoring' THEN ' under monitoring' ELSE '' END || '.' AS rationale
FROM d JOIN s USING (scenario_id) WHERE category IS NOT NULL""")
def rendered_compliance_records(orders, lineitem):
    """An action for each state in turn, its label by the decision table, and a rationale that names what the state violates."""
    return D.compliance_records(classified(orders, lineitem), ACTIONS, ["scenario_id"])
