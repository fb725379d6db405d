"""Instruction records rendered from operating states: questions with their query and its result, and actions with the label that the decision table gives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordmill.operators.ranking import numbered
from recordmill.operators.states import COMPLIANT, FILTERS, NON_COMPLIANT, SCOPES, category_of, decision, run_queries

QUERY_TASK, COMPLIANCE_TASK = "intelligent_data_query", "regulation_compliance_check"
QUESTIONS = ("List the {scope} elements of case {case} that are loaded beyond their limit.", "Which {scope} elements of case {case} carry more than they may?", "Give the overloaded {scope} elements of {case} with the worst loading.")
JUDGEMENTS = ("Is the action \"{action}\" allowed in case {case}?", "Check \"{action}\" against the limits of case {case}.", "May the dispatcher order \"{action}\" while case {case} holds?")


def _filled(templates: tuple[str, ...], turn: Column, **values: Column) -> Column:
    text = F.get(F.array(*map(F.lit, templates)), F.pmod(turn, F.lit(len(templates))).cast("int"))
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


def state_summary(n_thermal: Column, n_low: Column, n_high: Column, severity: Column) -> Column:
    """What a state's records say of it."""
    counted = lambda n, what: F.when(n > 0, F.concat_ws(" ", n.cast("string"), F.lit(what)))
    issues = F.concat_ws(", ", counted(n_thermal, "overloaded"), counted(n_low, "low voltage"), counted(n_high, "high voltage"))
    return F.concat(F.when(issues == "", "no limit is violated").otherwise(issues), F.lit("; severity "), severity)


def query_records(states: DataFrame, order: list[str]) -> DataFrame:
    """A question for each state about one kind of equipment in turn: id, task_type, scenario_id, instruction, structured_query and query_result (JSON), and n, the records of the result."""
    own = numbered(states.withColumn("__all", F.lit(0)), ["__all"], order, "number").withColumn("turn", F.col("number") - 1)
    scope = F.get(F.array(*map(F.lit, SCOPES)), F.pmod("turn", F.lit(len(SCOPES))).cast("int"))
    asked = own.select("scenario_id", "number", "turn", scope.alias("equipment_scope"), F.lit(FILTERS[0]).alias("filter"))
    found = run_queries(asked, states)
    query = F.struct("filter", F.col("scenario_id").cast("string").alias("scenario_id"), F.col("equipment_scope").alias("scope"), F.lit("complete_list_and_max").alias("aggregation"), F.lit("2").alias("version"))
    result = F.struct("records", "count", "max_loading_percent", "equipment_scope")
    text = _filled(QUESTIONS, F.floor(F.col("turn") / len(SCOPES)), scope=F.col("equipment_scope"), case=F.col("scenario_id").cast("string"))
    written = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    return found.select(_id("query", F.col("number")).alias("id"), F.lit(QUERY_TASK).alias("task_type"), "scenario_id", text.alias("instruction"), written(query).alias("structured_query"), written(result).alias("query_result"), F.col("count").alias("n"))


def compliance_records(states: DataFrame, actions: tuple[str, ...], order: list[str]) -> DataFrame:
    """An action for each state, actions taking turns: id, task_type, scenario_id, instruction, action, category, compliance_label and rationale. states are classified (n_thermal, n_low, n_high, profile, severity,
    max_loading, min_vm, max_vm). An action of no category has neither a label nor a rationale, and no record."""
    own = numbered(states.withColumn("__all", F.lit(0)), ["__all"], order, "number").withColumn("turn", F.col("number") - 1)
    own = own.withColumn("action", F.get(F.array(*map(F.lit, actions)), F.pmod("turn", F.lit(len(actions))).cast("int"))).withColumn("category", category_of(F.col("action")))
    label = decision(F.col("category"), *[F.col(c) for c in ("profile", "severity", "max_loading", "min_vm", "max_vm")])
    told = state_summary(F.col("n_thermal"), F.col("n_low"), F.col("n_high"), F.col("severity"))
    verdict = F.when(F.col("label") == COMPLIANT, "it may be carried out").when(F.col("label") == NON_COMPLIANT, "it may not be carried out").otherwise("it may be carried out under monitoring")
    text = _filled(JUDGEMENTS, F.floor(F.col("turn") / len(actions)), action=F.col("action"), case=F.col("scenario_id").cast("string"))
    made = own.where(F.col("category").isNotNull()).withColumn("label", label)
    return made.select(_id("compliance", F.col("number")).alias("id"), F.lit(COMPLIANCE_TASK).alias("task_type"), "scenario_id", text.alias("instruction"), "action", "category", F.col("label").alias("compliance_label"), F.concat(F.lit("In this state "), told, F.lit("; "), verdict, F.lit(".")).alias("rationale"))


def _id(kind: str, number: Column) -> Column:
    return F.concat(F.lit(f"{kind}_"), F.lpad(number.cast("string"), F.greatest(F.lit(6), F.length(number.cast("string"))), F.lit("0")))
