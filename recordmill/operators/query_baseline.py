"""A classifier's labels turned into structured queries, run again on the states, and scored by fields and by what they return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordmill.functions.nested import field_scores
from recordmill.operators.states import FILTERS, run_queries

# The scope of a query of the old form, the source it names, and what a query of the new form asks for.
OLD_SCOPE, OLD_SOURCE, AGGREGATION, VERSION = "legacy_line", "simulation_outputs", "complete_list_and_max", "2"
MARK = "::"


def query_label(filter_: Column, scope: Column) -> Column:
    """The class of a query: its filter, for loadings with the scope (of the old form where there is none)."""
    return F.when(filter_ == FILTERS[0], F.concat_ws(MARK, filter_, F.coalesce(scope, F.lit(OLD_SCOPE)))).otherwise(filter_)


def label_parts(label: Column) -> tuple[Column, Column]:
    """(filter, scope) of a class; no scope for one of the old form, and for other filters."""
    scope = F.regexp_extract(label, f"{MARK}(.*)$", 1)
    return F.substring_index(label, MARK, 1), F.when(~scope.isin("", OLD_SCOPE), scope)


def canonical_query(label: Column, state: Column) -> Column:
    """The query of a class on a state, as a map of fields to JSON. The state is the one that the record shows, never that of the right answer: a null stays a null."""
    filter_, scope = label_parts(label)
    fields = lambda **x: F.map_from_arrays(F.array(*map(F.lit, x)), F.array(*[F.coalesce(F.to_json(F.array(v)), F.lit("[null]")) for v in x.values()]))
    old = fields(filter=filter_, scenario_id=state, source=F.lit(OLD_SOURCE))
    new = fields(filter=filter_, scenario_id=state, scope=scope, aggregation=F.lit(AGGREGATION), version=F.lit(VERSION))
    return F.when(scope.isNotNull(), new).otherwise(old)


def scored(rows: DataFrame, states: DataFrame, key: str = "id") -> DataFrame:
    """Of rows (key, gold_label, pred_label, gold_state, shown_state): label_right, exact, schema_exact (all fields but the state), state_exact, field_accuracy, and same_result: whether both queries
    return the same records, counts and extremes when they are run on the states."""
    made = rows.withColumns({"gold": canonical_query(F.col("gold_label"), F.col("gold_state")), "pred": canonical_query(F.col("pred_label"), F.col("shown_state"))})
    bare = lambda c: F.map_filter(c, lambda k, _: k != "scenario_id")
    s = field_scores(F.col("gold"), F.col("pred"))
    made = made.select(key, "gold_label", "pred_label", "gold_state", "shown_state", s.alias("s"), field_scores(bare(F.col("gold")), bare(F.col("pred")))["exact"].alias("schema_exact"))

    def run(side: str, label: str, state: str) -> DataFrame:
        filter_, scope = label_parts(F.col(label))
        asked = made.select(key, F.col(state).alias("scenario_id"), filter_.alias("filter"), scope.alias("equipment_scope"))
        found = run_queries(asked, states)
        return found.select(key, F.struct("records", "voltage_records", "count", "max_loading_percent", "min_vm_pu", "violation_types", "error").alias(side))

    both = made.join(run("a", "gold_label", "gold_state"), key).join(run("b", "pred_label", "shown_state"), key)
    return both.select(
        key, "gold_label", "pred_label", (F.col("gold_label") == F.col("pred_label")).alias("label_right"), F.col("s.exact").alias("exact"), "schema_exact",
        F.col("gold_state").eqNullSafe(F.col("shown_state")).alias("state_exact"), (F.col("s.correct") / F.col("s.fields")).alias("field_accuracy"), F.col("a").eqNullSafe(F.col("b")).alias("same_result"),
    )


def summary(scores: DataFrame) -> DataFrame:
    """(n, accuracy, query_exact, schema_exact, state_exact, field_accuracy, same_result, majority_label, majority_accuracy): shares of rows, beside what the commonest class would give (the
    first by name among equals)."""
    n = F.count(F.lit(1))
    share = lambda c, name: F.round(F.avg(F.col(c).cast("double")), 6).alias(name)
    most = scores.groupBy("gold_label").agg(n.alias("c")).agg(F.min(F.struct((-F.col("c")).alias("c"), "gold_label")).alias("m"))
    every = scores.agg(n.alias("n"), share("label_right", "accuracy"), share("exact", "query_exact"), share("schema_exact", "schema_exact"), share("state_exact", "state_exact"), share("field_accuracy", "field_accuracy"), share("same_result", "same_result"))
    return every.join(F.broadcast(most)).select(*every.columns, F.col("m.gold_label").alias("majority_label"), F.round(-F.col("m.c") / F.col("n"), 6).alias("majority_accuracy"))
