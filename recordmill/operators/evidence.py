"""Links from records to rules, inferred from what a record shows before its target, each with the fields that stand for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Rules by task, the words that call for them, where they are looked for, and the fields that are their evidence. No words: the field itself calls for the rule.
BASE_RULES = ("REG_OVERLOAD_001", "REG_VOLTAGE_001", "REG_SWITCHING_001", "REG_TOOL_001", "REG_QUERY_001")
STATE, TICKET, INTENT, QUERY = ("regulation_compliance_check", "auxiliary_decision"), ("operation_ticket_check",), ("dispatcher_intent_tool_call",), ("intelligent_data_query",)
ISSUES = ("observed_issues", "grid_state_summary")
RULES = (
    ("REG_OVERLOAD_ALERT_002", STATE, ISSUES, "overload|loading|过载|负载率", ISSUES),
    ("REG_OVERLOAD_EMERGENCY_003", STATE, ISSUES, "(?s)(?=.*(overload|loading|过载|负载率))(?=.*(severe|emergency|严重|紧急|110)).*", ISSUES),
    ("REG_VOLTAGE_LOW_002", STATE, ISSUES, "low voltage|undervoltage|低电压|电压偏低", ISSUES),
    ("REG_VOLTAGE_HIGH_003", STATE, ISSUES, "high voltage|overvoltage|高电压|电压偏高", ISSUES),
    ("REG_SECURITY_REDISPATCH_004", STATE, ("available_actions",), "generator_redispatch", ("available_actions",)),
    ("REG_TOOL_POSTCHECK_004", STATE, ("decision_window",), None, ("decision_window", "instruction")),
    ("REG_TOOL_POSTCHECK_004", STATE, ("*",), "post-action|recheck|复核|复算", ("decision_window", "instruction")),
    ("REG_SWITCHING_PERMISSION_002", TICKET, ("dispatch_permit_status",), None, ("dispatch_permit_status",)),
    ("REG_SWITCHING_MONITORING_003", TICKET, ("monitoring_arrangement",), None, ("monitoring_arrangement",)),
    ("REG_TOOL_DIAGNOSIS_002", INTENT, ("utterance", "instruction"), "diagnos|violation|check|查询|诊断|越限|校核", ("utterance",)),
    ("REG_TOOL_MITIGATION_003", INTENT, ("utterance", "instruction"), "mitigat|redispatch|correct|处置|再调度|纠正|消除", ("utterance",)),
    ("REG_SECURITY_REDISPATCH_004", INTENT, ("utterance", "instruction"), "mitigat|redispatch|correct|处置|再调度|纠正|消除", ("utterance",)),
    ("REG_TOOL_POSTCHECK_004", INTENT, ("utterance", "instruction"), "recalculate|power flow|confirm|复算|潮流|确认", ("utterance",)),
    ("REG_QUERY_FILTER_002", QUERY, ("scenario_id", "question"), None, ("scenario_id", "question", "instruction")),
    ("REG_QUERY_AGGREGATION_003", QUERY, ("question", "instruction"), "maximum|list|summary|aggregate|return|最大|列出|汇总|返回", ("question", "instruction")),
)
FIELDS = ("observed_issues", "grid_state_summary", "available_actions", "decision_window", "dispatch_permit_status", "monitoring_arrangement", "utterance", "scenario_id", "question")


def infer_links(rows: DataFrame) -> DataFrame:
    """rows with links (rules in order, each once) and basis (a map from each rule to the pointers of its evidence).

    rows have task, instruction, existing (an array of rules) and the string columns FIELDS, which stand under "input" in a record. Base rules that a record links already come
    first, on the evidence of its instruction. A rule whose evidence fields are all empty isn't linked.
    """
    there = lambda f: F.coalesce(F.col(f) != "", F.lit(False))
    first = lambda fields: F.lower(F.coalesce(*[F.when(there(f), F.col(f)) for f in fields], F.lit("")))
    whole = F.lower(F.concat_ws(" ", "instruction", *FIELDS))
    pointer = lambda f: F.lit("/instruction" if f == "instruction" else f"/input/{f}")

    def found(rule: str, tasks: tuple, places: tuple, words: str | None, evidence: tuple) -> Column:
        text = whole if places == ("*",) else first(places)
        asked = text != "" if words is None else text.rlike(words)
        basis = F.array_compact(F.array(*[F.when(there(f), pointer(f)) for f in evidence]))
        return F.when(F.col("task").isin(*tasks) & asked & (F.size(basis) > 0), F.struct(F.lit(rule).alias("rule"), basis.alias("basis")))

    base = F.filter(F.coalesce("existing", F.array().cast("array<string>")), lambda x: x.isin(*BASE_RULES))
    based = F.transform(F.array_distinct(base), lambda x: F.struct(x.alias("rule"), F.when(there("instruction"), F.array(pointer("instruction"))).otherwise(F.array().cast("array<string>")).alias("basis")))
    every = F.concat(based, F.array_compact(F.array(*[found(*r) for r in RULES])))
    out = rows.withColumn("__all", every).withColumn("links", F.array_distinct(F.transform("__all", lambda x: x["rule"])))
    basis = F.map_from_entries(F.transform("links", lambda rule: F.struct(rule, F.array_distinct(F.flatten(F.transform(F.filter("__all", lambda x: x["rule"] == rule), lambda x: x["basis"]))))))
    return out.withColumn("basis", basis).drop("__all")


# Words that make a record of a task a boundary case.
BOUNDARY = {
    "operation_ticket_check": "monitor|supervisor|permit|not backfilled|empty|single-person|immediate|checked, but|condition",
    "dispatcher_intent_tool_call": "confirm|recalculate|check|diagnose|suggest|redispatch|mitigate|violation",
    "regulation_compliance_check": "low voltage|high voltage|overload|constrained|monitor",
}
BOUNDARY_PROFILES = ("voltage", "overload", "mixed")


def boundary_case(task: Column, text: Column, profile: Column) -> Column:
    """Whether a record stands near a decision's boundary, by its task's words or its state's profile."""
    out = F.lit(False)
    for name, words in BOUNDARY.items():
        near = F.lower(text).rlike(words)
        if name == "regulation_compliance_check":
            near = near | F.lower(F.coalesce(profile, F.lit(""))).isin(*BOUNDARY_PROFILES)
        out = out | ((task == name) & near)
    return F.coalesce(out, F.lit(False))


def state_numbers(summary: Column) -> Column:
    """(loading, min_vm, max_vm) that a state's prose gives; a loading below ten is a ratio and made percent. Null for what it doesn't say."""
    number = lambda words: F.try_to_number(F.nullif(F.regexp_extract(summary, rf"(?i){words}\s*[:：]?\s*([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")), F.lit("999999999D999999")).cast("double")
    loading = number(r"max(?:imum)?\s+(?:branch|line)\s+load(?:ing)?(?:\s+rate)?")
    return F.struct(F.when(loading < 10, loading * 100).otherwise(loading).alias("loading"), number(r"min(?:imum)?\s+bus\s+voltage").alias("min_vm"), number(r"max(?:imum)?\s+bus\s+voltage").alias("max_vm"))


def severity_of_prose(summary: Column) -> Column:
    """The severity that the numbers of a state's prose give; null where it has none."""
    from recordmill.operators.states import severity

    n = state_numbers(summary)
    none = n["loading"].isNull() & n["min_vm"].isNull() & n["max_vm"].isNull()
    return F.when(~none, severity(n["loading"], n["min_vm"], n["max_vm"]))
