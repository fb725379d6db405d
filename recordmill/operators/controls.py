"""A control set whose labels follow from relations of clocks and numbers, and from nothing in the wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Labels by task, the margin that calls for monitoring, and the families of each split.
LABELS = {"ticket": ("compliant", "compliant_with_monitoring", "non_compliant"), "route": ("diagnose_and_dispatch", "mitigate_violations", "security_check_and_redispatch")}
MARGIN = 15
FAMILIES, VALIDATION, TEST = 12, (8, 9), (10, 11)


def clock(minutes: Column) -> Column:
    """Minutes after midnight as HH:MM, around the day."""
    m = F.pmod(minutes, F.lit(24 * 60))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(two(F.floor(m / 60)), F.lit(":"), two(m % 60))


def ticket_label(start: Column, permit: Column, same_object: Column, assigned_watch: Column, required_watch: Column) -> Column:
    """Refused if the permit comes after the start, the objects differ or the watch is too short; under monitoring if it is barely long enough."""
    spare = assigned_watch - required_watch
    return F.when((start < permit) | ~same_object | (spare < 0), "non_compliant").when(spare < MARGIN, "compliant_with_monitoring").otherwise("compliant")


def route_label(exposure: Column, reserve: Column, loading: Column, limit: Column, voltage: Column, floor: Column) -> Column:
    return F.when(exposure > reserve, "security_check_and_redispatch").when((loading > limit) | (voltage < floor), "mitigate_violations").otherwise("diagnose_and_dispatch")


def family_split(family: Column) -> Column:
    return F.when(family.isin(*VALIDATION), "validation").when(family.isin(*TEST), "test").otherwise("train")


def control_rows(index: DataFrame) -> DataFrame:
    """Rows of every task and label for each number i of index: (id, task, family, split, text, label, seal).

    Fields are drawn from i by arithmetic so that a label's rows differ in one relation at a time; the label is worked out from the fields again, and the seal is its
    hash with the id, by which a prediction can be scored by those who don't see the label.
    """
    each = index.select("i", F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.lit(x).alias("wanted")) for t, own in LABELS.items() for x in own])).alias("x")).select("i", "x.*")
    i, wanted, turn = F.col("i"), F.col("wanted"), F.col("i") % 3
    bad = wanted == "non_compliant"
    start = (i * 37) % 1440
    permit = start - F.when(bad & (turn == 0), -5).otherwise(30)
    seen = F.when(bad & (turn == 1), i + 1).otherwise(i)
    required = 10 + i % 20
    watch = required + F.when(bad & (turn == 2), -3).when(wanted == "compliant_with_monitoring", 5).otherwise(20)
    risk, hot = wanted == "security_check_and_redispatch", wanted == "mitigate_violations"
    reserve = 50 + i % 40
    exposure = reserve + F.when(risk, 7).otherwise(-7)
    loading = F.when(hot & (i % 2 == 0), 103).otherwise(90) + i % 5
    voltage = F.when(hot & (i % 2 == 1), 93).otherwise(98)
    ticket = F.concat(F.lit("Start "), clock(start), F.lit(", permit "), clock(permit), F.lit(", object "), i, F.lit(" against "), seen, F.lit(", watch "), watch, F.lit(" of "), required)
    route = F.concat(F.lit("Exposure "), exposure, F.lit(" against "), reserve, F.lit(", loading "), loading, F.lit(" of 102, voltage "), voltage, F.lit(" of 95"))
    of_ticket = F.col("task") == "ticket"
    label = F.when(of_ticket, ticket_label(start, permit, seen == i, watch, required)).otherwise(route_label(exposure, reserve, loading, F.lit(102), voltage, F.lit(95)))
    key = F.concat_ws("-", "task", "wanted", "i")
    rows = each.select(key.alias("id"), "task", (i % FAMILIES).alias("family"), F.when(of_ticket, ticket).otherwise(route).alias("text"), label.alias("label"))
    return rows.select("id", "task", "family", family_split(F.col("family")).alias("split"), "text", "label", F.sha2(F.concat_ws(":", "id", "label"), 256).alias("seal"))
