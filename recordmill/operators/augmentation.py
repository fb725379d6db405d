"""Compliance records made from others: paraphrased actions, and counterfactual actions for states that have seen one label only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordmill.operators.ranking import numbered
from recordmill.operators.states import COMPLIANT, MONITORED, NON_COMPLIANT, decision

# The wordings of each category of action, and the requests that ask for a judgement of an action.
SURFACES = {
    "risky_increase": ["继续增加受限断面潮流", "继续提升受限断面潮流", "继续提升受限断面输送功率", "持续增加受限断面输送功率", "进一步提高受限断面送出", "增加受限通道输送水平", "继续扩大受限断面传输功率", "维持增送计划并提高断面潮流"],
    "monitor_only": ["维持当前潮流并启动监视", "保持当前潮流并开展连续监视", "暂不调整潮流并加强监视", "维持现有运行方式并跟踪越限变化", "不改变潮流分布，仅执行实时监视", "保持当前断面送出并启动复核监视"],
    "corrective_voltage": ["先执行无功支撑后复核潮流", "先实施无功支持措施，随后验证潮流分布", "先执行无功补偿再复核潮流", "先投切无功补偿再复核电压和潮流", "先进行电压支撑后重新校核潮流", "先安排无功调节并复核电压越限"],
    "corrective_redispatch": ["调整邻近机组出力降低断面负载", "先压降受限断面送出再复算潮流", "重新分配邻近机组出力以降低断面负载", "下调受限断面送出并复核潮流", "通过机组再调度释放断面裕度", "调整发电出力组合以缓解过载断面"],
    "corrective_topology": ["先切换局部拓扑后检查越限是否消除", "执行分阶段负荷转供并继续监视", "先调整局部网络拓扑再复核越限", "分阶段转供负荷后持续监视潮流", "先实施拓扑转移再校核低压和过载", "局部倒换供电路径后检查安全裕度"],
    "premature_restore": ["不校核设备状态直接恢复故障线路运行", "直接恢复故障线路运行，不校核设备状态", "直接恢复故障线路运行，不进行设备状态校核", "未进行设备状态确认即恢复故障线路运行", "未确认设备状态即恢复故障线路运行", "跳过状态校核直接送电故障线路", "不做设备状态确认即恢复退出线路"],
}
REQUESTS = ["判断当前状态下拟执行“{action}”是否合规。", "根据当前电网状态，评估“{action}”能否作为可执行调度动作。", "请按规程校核“{action}”在该场景下的合规性。", "结合场景越限情况，判断调度命令“{action}”是否允许下发。", "从实时安全校核角度，说明“{action}”是否满足执行条件。", "面向调度复核，判断“{action}”是否满足当前安全边界。", "请依据当前越限状态审查“{action}”的执行许可。", "以实时安全校核结果为依据，判定“{action}”是否可下发。"]
#: The order in which labels that a state lacks are made up for.
WANTED = (NON_COMPLIANT, COMPLIANT, MONITORED)


def _lists(some: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in some.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def known_surface(action: Column, *texts: Column) -> Column:
    """The wording of an action: the action itself if it is one of SURFACES, else the longest that action or texts hold, the first of the dictionary among equals; null for none."""
    every = sorted([s for v in SURFACES.values() for s in v], key=len, reverse=True)
    held = F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in (action, *texts)])
    return F.coalesce(F.when(action.isin(*every), action), *[F.when(F.contains(held, F.lit(s)), F.lit(s)) for s in every])


def surface_category(surface: Column) -> Column:
    """The category of a wording by the dictionary; null for one that it lacks."""
    return F.coalesce(*[F.when(surface.isin(*v), F.lit(k)) for k, v in SURFACES.items()])


def _asked(action: Column, variant: Column) -> Column:
    return F.replace(F.get(F.array(*map(F.lit, REQUESTS)), (variant % len(REQUESTS)).cast("int")), F.lit("{action}"), action)


def paraphrased(rows: DataFrame, order: list[str], extra: int = 2) -> DataFrame:
    """(id, source_id, variant, category, label, action, instruction, rationale) of new records: for each of rows (id, label, action, category, instruction, rationale) whose action is known, one other
    wording of its category, and `extra` more for compliant ones, as far as there are any.

    Wordings follow one another from a place that is the row's number by the columns of order; the new wording replaces the old in the rationale. A stated category comes before that of the wording.
    Rows of no category give none.
    """
    surface = known_surface(F.col("action"), F.col("instruction"), F.col("rationale"))
    every = numbered(rows.withColumn("__all", F.lit(0)), ["__all"], order, "__number").withColumn("old", surface)
    own = every.withColumn("category", F.coalesce("category", surface_category(F.col("old")))).where(F.col("category").isNotNull())
    others = F.filter(F.try_element_at(_lists(SURFACES), F.col("category")), lambda s: ~s.eqNullSafe(F.col("old")))
    own = own.withColumn("others", others).where(F.size("others") > 0)
    n = F.least(F.when(F.col("label") == COMPLIANT, 1 + extra).otherwise(1), F.size("others"))
    each = own.withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
    made = each.withColumns({"variant": F.col("k") + 1, "new": F.get("others", ((F.col("__number") - 1 + F.col("k")) % F.size("others")).cast("int"))})
    replaced = F.when(F.col("old").isNotNull(), F.replace("rationale", F.col("old"), F.col("new"))).otherwise(F.col("rationale"))
    id_ = F.concat(F.col("id").cast("string"), F.lit("_actionpara_"), F.lpad(F.col("variant").cast("string"), 2, "0"))
    return made.select(id_.alias("id"), F.col("id").alias("source_id"), "variant", "category", "label", F.col("new").alias("action"), _asked(F.col("new"), F.col("variant")).alias("instruction"), replaced.alias("rationale"))


def counterfactual(rows: DataFrame, states: DataFrame, order: list[str], most: int = 2) -> DataFrame:
    """(id, source_id, variant, summary, category, label, action, instruction) of new records for states whose records have few labels.

    rows are (id, summary, scenario_id, label, action), states (scenario_id, profile, severity, max_loading, min_vm, max_vm). Of each summary the first row by the columns of order stands for it;
    the labels that its actions would have are worked out for every category, and those that no row of the summary has are made up for, one category each, in the order of WANTED and `most` a summary at
    most. Wordings turn with the summary's number and the category's. Rows without a summary, and those whose state is unknown, give none; only one row a summary is kept for the work.
    """
    told = rows.where(F.col("summary") != "")
    first = F.min_by(F.struct("id", "scenario_id", "action", *[F.col(c).alias(f"__{c}") for c in order]), F.struct(*order))
    per = told.groupBy("summary").agg(first.alias("r"), F.collect_set("label").alias("has")).select("summary", "has", "r.*")
    per = numbered(per.withColumn("__all", F.lit(0)), ["__all"], [f"__{c}" for c in order], "number")
    at = per.join(states.select("scenario_id", "profile", "severity", "max_loading", "min_vm", "max_vm"), "scenario_id")
    options = []
    for k, (category, surfaces) in enumerate(SURFACES.items()):
        words, n = F.array(*map(F.lit, surfaces)), len(surfaces)
        place = lambda off, k=k, n=n: ((F.col("number") - 1 + k + off) % n).cast("int")
        usual = F.get(words, place(0))
        word = F.when(usual.eqNullSafe(F.col("action")) & (F.lit(n) > 1), F.get(words, place(1))).otherwise(usual)
        label = decision(F.lit(category), F.col("profile"), F.col("severity"), F.col("max_loading"), F.col("min_vm"), F.col("max_vm"))
        options.append(F.struct(F.lit(k).alias("k"), F.lit(category).alias("category"), label.alias("label"), word.alias("action")))
    rank = lambda label: F.array_position(F.array(*map(F.lit, WANTED)), label)
    new = at.select("summary", "has", "id", F.explode(F.array(*options)).alias("o")).where(~F.array_contains("has", F.col("o.label")) & (rank(F.col("o.label")) > 0))
    one = new.groupBy("summary", "id", F.col("o.label").alias("label")).agg(F.min_by("o", "o.k").alias("o"))
    turn = F.row_number().over(Window.partitionBy("summary").orderBy(rank(F.col("label"))))  # three rows a summary at most
    made = one.withColumn("variant", turn).where(F.col("variant") <= most)
    id_ = F.concat(F.col("id").cast("string"), F.lit("_counterfactual_"), F.lpad(F.col("variant").cast("string"), 2, "0"))
    return made.select(id_.alias("id"), F.col("id").alias("source_id"), "variant", "summary", "o.category", "label", "o.action", _asked(F.col("o.action"), F.col("variant")).alias("instruction"))
