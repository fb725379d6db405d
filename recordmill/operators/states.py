"""Operating states with nested violations, and the structured query language over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Limits of loading in percent and of voltage per unit, query forms, and the labels and categories of actions.
OVERLOAD, LOW_VOLTAGE, HIGH_VOLTAGE = 100.0, 0.95, 1.05
NEAR_LOADING, NEAR_LOW, NEAR_HIGH = 98.0, 0.97, 1.04
EMERGENCY_LOADING, EMERGENCY_LOW, EMERGENCY_HIGH = 110.0, 0.92, 1.08
SEVERE_LOADING, SLIGHT_FOR_REDISPATCH, SLIGHT_FOR_OTHERS = 115.0, 105.0, 108.0
CATEGORIES = ("risky_increase", "monitor_only", "corrective_voltage", "corrective_redispatch", "corrective_topology", "premature_restore")
COMPLIANT, MONITORED, NON_COMPLIANT = "compliant", "compliant_with_monitoring", "non_compliant"
SCOPES = ("line", "transformer", "all")
FILTERS = ("loading_percent > 100", "vm_pu < 0.95", "violation_type != none")


def nest_states(states: DataFrame, elements: DataFrame, key: str = "scenario_id") -> DataFrame:
    """states with elements nested: overloaded (equipment, element, loading), low_voltage and high_voltage (element, vm), each in a total order.

    elements has key, equipment, element, loading_percent and vm_pu. Elements that violate nothing are filtered out before the
    shuffle; a state without violations gets empty lists.
    """
    bad = elements.where((F.col("loading_percent") > OVERLOAD) | (F.col("vm_pu") < LOW_VOLTAGE) | (F.col("vm_pu") > HIGH_VOLTAGE))
    load = F.when(F.col("loading_percent") > OVERLOAD, F.struct("equipment", "element", "loading_percent"))
    volt = lambda wrong: F.when(wrong, F.struct("element", "vm_pu"))
    every = {"overloaded": load, "low_voltage": volt(F.col("vm_pu") < LOW_VOLTAGE), "high_voltage": volt(F.col("vm_pu") > HIGH_VOLTAGE)}
    lists = bad.groupBy(key).agg(*[F.sort_array(F.collect_list(c)).alias(n) for n, c in every.items()])
    joined = states.join(lists, key, "left")
    return joined.withColumns({c: F.coalesce(c, F.array().cast(lists.schema[c].dataType)) for c in every})


def run_queries(queries: DataFrame, states: DataFrame, key: str = "scenario_id") -> DataFrame:
    """Each query row (key, filter, equipment_scope) with its sorted records, their count and the extreme value.

    An unknown key gives a null count; an unknown filter or scope gives an error code. The maximum of no records is null. A loading query without a scope is
    one of the old form: it gives all overloaded records and neither count nor maximum.
    """
    scope = F.col("equipment_scope")
    loads = F.filter("overloaded", lambda x: scope.isNull() | (scope == "all") | (x["equipment"] == scope))
    counted = F.col("__found") & (scope.isNotNull() | (F.col("filter") != FILTERS[0]))
    is_load, is_volt, is_any = (F.col("filter") == f for f in FILTERS)
    joined = queries.join(states.select(key, "overloaded", "low_voltage", "high_voltage", F.lit(True).alias("__found")), key, "left")
    types = F.array_compact(F.array(F.when(F.size("overloaded") > 0, F.lit("thermal_overload")), F.when(F.size("low_voltage") > 0, F.lit("low_voltage")), F.when(F.size("high_voltage") > 0, F.lit("high_voltage"))))
    none = F.lit(None).cast(states.schema["overloaded"].dataType)
    return joined.select(
        *queries.columns,
        F.when(is_load & F.col("__found") & (scope.isNull() | scope.isin(*SCOPES)), loads).otherwise(none).alias("records"),
        F.when(is_volt & F.col("__found"), F.col("low_voltage")).alias("voltage_records"),
        F.when(counted, F.when(is_load, F.size(loads)).when(is_volt, F.size("low_voltage")).when(is_any, F.size(types))).alias("count"),
        F.when(is_load & scope.isNotNull(), F.array_max(F.transform(loads, lambda x: x["loading_percent"]))).alias("max_loading_percent"),
        F.when(is_volt, F.array_min(F.transform("low_voltage", lambda x: x["vm_pu"]))).alias("min_vm_pu"),
        F.when(is_any & F.col("__found"), F.array_join(types, ",")).alias("violation_types"),
        F.when(F.col("__found").isNull(), F.lit("unknown_scenario")).when(~(is_load | is_volt | is_any), F.lit("unknown_filter")).when(is_load & ~scope.isin(*SCOPES), F.lit("unknown_scope")).alias("error"),
    )


def shape_errors(q: Column, version: str = "2") -> Column:
    """Sorted codes of what is wrong with a query struct (filter, scope, aggregation, version)."""
    code = lambda bad, name: F.when(F.coalesce(bad, F.lit(True)), F.lit(name))
    return F.array_join(F.array_sort(F.array_compact(F.array(
        code(~q["filter"].isin(*FILTERS), "filter"), code(~q["scope"].isin(*SCOPES), "scope"),
        code(q["aggregation"] != "complete_list_and_max", "aggregation"), code(q["version"] != version, "version"),
    ))), ",")


def truth_complete(declared: Column, held: Column, flag: Column) -> Column:
    """A state's truth is complete if its declared count equals its list's size and its flag is set."""
    return F.coalesce((declared == held) & flag, F.lit(False))


def profile(thermal: Column, voltage: Column) -> Column:
    """combined, thermal, voltage or normal, from whether a state has overloads and whether it has voltages out of bounds on either side."""
    return F.when(thermal & voltage, "combined").when(thermal, "thermal").when(voltage, "voltage").otherwise("normal")


def _outside(loading: Column, low: Column, high: Column, limits: tuple[float, float, float]) -> tuple[Column, Column]:
    """Whether the greatest loading, and whether a voltage, lies beyond its limit; what isn't known lies within."""
    top, bottom = F.coalesce(low, F.lit(1.0)), F.coalesce(high, F.lit(1.0))
    return F.coalesce(loading, F.lit(0.0)) > limits[0], (top < limits[1]) | (bottom > limits[2])


def severity(max_loading: Column, min_vm: Column, max_vm: Column) -> Column:
    """emergency beyond the emergency limits, alert beyond the operating ones, else normal; nulls don't count."""
    worst = [a | b for a, b in (_outside(max_loading, min_vm, max_vm, x) for x in ((EMERGENCY_LOADING, EMERGENCY_LOW, EMERGENCY_HIGH), (OVERLOAD, LOW_VOLTAGE, HIGH_VOLTAGE)))]
    return F.when(worst[0], "emergency").when(worst[1], "alert").otherwise("normal")


def near_limit(max_loading: Column, min_vm: Column, max_vm: Column) -> Column:
    hot, off = _outside(max_loading, min_vm, max_vm, (NEAR_LOADING, NEAR_LOW, NEAR_HIGH))
    return hot | off | (F.coalesce(max_loading, F.lit(0.0)) == NEAR_LOADING)  # the loading limit itself is near


def decision(category: Column, prof: Column, sev: Column, max_loading: Column, min_vm: Column, max_vm: Column) -> Column:
    """The compliance label of an action of a category in a state; null for no category.

    Each category is refused where one condition holds and plainly allowed where another does; what is neither may go on under monitoring.
    """
    loading = F.coalesce(max_loading, F.lit(0.0))
    severe_thermal = loading >= SEVERE_LOADING
    _, severe_voltage = _outside(max_loading, min_vm, max_vm, (SEVERE_LOADING, EMERGENCY_LOW, EMERGENCY_HIGH))
    calm, near, thermal, voltage = prof == "normal", near_limit(max_loading, min_vm, max_vm), prof == "thermal", prof == "voltage"
    never = F.lit(False)
    rules = {
        "premature_restore": (~calm | (sev != "normal"), never),
        "risky_increase": (~calm | near, never),
        "monitor_only": (~calm & ((sev == "emergency") | (prof == "combined") | severe_thermal | severe_voltage), calm & ~near),
        "corrective_voltage": (thermal & severe_thermal, calm | (thermal & (loading < SLIGHT_FOR_OTHERS))),
        "corrective_redispatch": (voltage & severe_voltage, calm | (thermal & (loading < SLIGHT_FOR_REDISPATCH))),
        "corrective_topology": (voltage & severe_voltage, thermal & (loading < SLIGHT_FOR_OTHERS)),
    }
    label = lambda refused, allowed: F.when(refused, NON_COMPLIANT).when(allowed, COMPLIANT).otherwise(MONITORED)
    out = F.when(category.isNull(), F.lit(None).cast("string"))
    for name, (refused, allowed) in rules.items():
        out = out.when(category == name, label(refused, allowed))
    return out.otherwise(F.when(calm, COMPLIANT).otherwise(MONITORED))


def category_of(action: Column) -> Column:
    """The category of an action's wording, the first whose words it holds; null for none."""
    text = F.lower(F.trim(F.coalesce(action, F.lit(""))))
    some = lambda *words: F.lit(False) if not words else text.rlike("|".join(words))
    # The wordings of each category.
    return (
        F.when(some("continue increasing", "continue to increase", "further increase", "increase transmission", "increase constrained") & some("power"), CATEGORIES[0])
        .when(some("monitor") & some("maintain", "keep", "start", "current"), CATEGORIES[1])
        .when(some("reactive power", "reactive support", "reactive compensation", "voltage support"), CATEGORIES[2])
        .when(some("adjust output", "redispatch", "reduce section load", "reduce output of constrained", "output allocation"), CATEGORIES[3])
        .when(some("topology", "load transfer", "transfer load", "switch local"), CATEGORIES[4])
        .when(some("restore", "restoring") & some("fault", "without verify", "without checking", "do not verify"), CATEGORIES[5])
    )


def contract_errors(rows: DataFrame, states: DataFrame, key: str = "scenario_id") -> DataFrame:
    """rows with errors: the sorted codes of what is wrong with a query record.

    rows has key, source_case_id, input_id, query and output_query (structs of key, filter, scope, aggregation, version), tools (an array of tool and args, args as a
    query), result and output_result (structs of equipment_scope, records, count, max_loading_percent). The result is held against the query run again on
    the states; a key that no state has is an error of its own.
    """
    q, result = F.col("query"), F.col("result")
    asked = rows.select("*", q["filter"].alias("filter"), q["scope"].alias("equipment_scope"))
    again = run_queries(asked.drop("records", "count"), states, key).withColumnsRenamed({"records": "__records", "count": "__count", "max_loading_percent": "__max", "error": "__error"})
    ids = F.array_distinct(F.filter(F.array(*[c.cast("string") for c in (F.col(key), F.col("source_case_id"), F.col("input_id"), q[key], F.col("output_query")[key])]), lambda x: x.isNotNull() & (x != "")))
    args = F.try_element_at("tools", F.lit(1))["args"]
    one_tool = (F.size("tools") == 1) & (F.try_element_at("tools", F.lit(1))["tool"] == "query_simulation_records")
    stated, held = result["records"], F.coalesce(result["records"], F.col("__records"))
    of_load = q["filter"] == FILTERS[0]
    code = lambda bad, name: F.when(F.coalesce(bad, F.lit(True)), F.lit(name))
    shape = shape_errors(q)
    codes = F.array(
        code(q.isNull(), "structured_query_not_object"), code(shape != "", "structured_query_shape"),
        code(~q["filter"].isin(*FILTERS), "structured_query_filter_unsupported"), code(~q.eqNullSafe(F.col("output_query")), "output_structured_query_mismatch"),
        code(F.size(ids) != 1, "scenario_id_mismatch"), code(~one_tool, "query_tool_plan_mismatch"), code(one_tool & ~args.eqNullSafe(q), "query_tool_args_mismatch"),
        code(~result.eqNullSafe(F.col("output_result")), "query_result_mirror_mismatch"), F.when(F.col("__error") == "unknown_scenario", F.lit("scenario_truth_missing")),
        code(of_load & F.col("__records").isNotNull() & ~(stated.eqNullSafe(F.col("__records")) & result["count"].eqNullSafe(F.col("__count")) & result["max_loading_percent"].eqNullSafe(F.col("__max"))), "query_result_truth_mismatch"),
        code(of_load & ~result["equipment_scope"].eqNullSafe(q["scope"]), "overload_query_result_scope_mismatch"),
        code(of_load & (F.size(held) != result["count"]), "overload_query_count_mismatch"),
        code(of_load & ~result["max_loading_percent"].eqNullSafe(F.array_max(F.transform(held, lambda x: x["loading_percent"]))), "overload_query_max_aggregation_mismatch"),
    )
    return again.select(*rows.columns, F.array_join(F.array_sort(F.array_distinct(F.array_compact(codes))), ",").alias("errors"))


def compliance_errors(rows: DataFrame) -> DataFrame:
    """rows with errors: the sorted codes of what is wrong with a compliance record's label and rationale.

    rows are classified states (profile, severity, max_loading, min_vm, max_vm) with action, category (null: read from the action), label and rationale.
    """
    category = F.coalesce("category", category_of(F.col("action")))
    extremes = [F.col(c) for c in ("max_loading", "min_vm", "max_vm")]
    expected = decision(category, F.col("profile"), F.col("severity"), *extremes)
    text = F.lower(F.coalesce("rationale", F.lit("")))
    # What a rationale says of violations and of limits.
    denies = text.rlike("no thermal stability or voltage violation|no thermal or voltage violation|no overload or voltage violation")
    admits = text.rlike("near the boundary|approaching the boundary|close to the boundary|near limit|close to limit|approaching the limit|security margin|safety margin")
    calm = F.col("profile") == "normal"
    code = lambda bad, name: F.when(F.coalesce(bad, F.lit(False)), F.lit(name))
    codes = F.array(
        code(expected.isNotNull() & ~F.col("label").eqNullSafe(expected), "compliance_label_mismatch"), code(~calm & denies, "rationale_denies_existing_issues"),
        code(calm & (F.col("label") == NON_COMPLIANT) & ~(near_limit(*extremes) | admits), "non_compliant_without_detected_issue"),
    )
    return rows.select("*", F.array_join(F.array_sort(F.array_compact(codes)), ",").alias("errors"))


def inferred_scope(prose: Column) -> Column:
    """The scope that a question asks for: transformers, lines, or all."""
    text = F.lower(F.coalesce(prose, F.lit("")))
    return F.when(text.rlike(r"变压器|主变|\b(transformers?|trafos?)\b"), "transformer").when(text.rlike(r"线路|\blines?\b"), "line").otherwise("all")


def upgraded(rows: DataFrame, states: DataFrame, key: str = "scenario_id") -> DataFrame:
    """Query records in the present form: a loading query without a scope gets the one that its prose asks for, and is run again; others stay as they are.

    rows has key, prose and query (filter, scope, aggregation, version); the result has query and its mirrors, count, max_loading_percent and migrated.
    """
    q = F.col("query")
    old = (q["filter"] == FILTERS[0]) & q["scope"].isNull()
    scope = F.when(old, inferred_scope(F.col("prose"))).otherwise(q["scope"])
    new = F.struct(q["filter"].alias("filter"), scope.alias("scope"), F.when(old, "complete_list_and_max").otherwise(q["aggregation"]).alias("aggregation"), F.when(old, "3").otherwise(q["version"]).alias("version"))
    kept = [c for c in rows.columns if c != "query"]
    asked = rows.select(*kept, old.alias("migrated"), new.alias("query")).select("*", "query.filter", F.col("query.scope").alias("equipment_scope"))
    done = run_queries(asked, states, key)
    return done.select(*kept, "query", F.col("query").alias("output_query"), F.struct(F.lit("query_simulation_records").alias("tool"), F.col("query").alias("args")).alias("tool"), "records", "count", "max_loading_percent", "migrated")
