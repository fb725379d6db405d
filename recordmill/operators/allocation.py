"""Whole components dealt to splits by what each split still lacks of rows, tasks and labels."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, functions as F

from recordmill.operators.ranking import numbered
from recordmill.operators.splits import SHARES
from recordmill.session import checkpoint

# Weights of what is lacking (rows, tasks, labels), and how far a split may go beyond its rows, with what each row beyond costs.
ROWS, TASKS, LABELS = 0.25, 0.20, 1.25
SLACK = {"train": (1.03, 0.75)}
OTHER_SLACK = (1.08, 2.0)
#: Classes that the driver deals; beyond these, classes are made coarser.
MOST_CLASSES = 50_000
#: A class gives at most this part of what is left of it at a time.
PART = 64


def classes(cells: DataFrame, coarse: bool = False) -> DataFrame:
    """(component, size, kind): kind is the JSON of a component's rows by task and by label, equal for components that count alike.

    cells are (component, task, label, n). Coarse kinds keep a component's commonest task, its commonest and its rarest label, and numbers to a power of two: a bounded number of kinds whatever the components.
    """
    by = lambda c, name: cells.where(F.col(c).isNotNull()).groupBy("component", c).agg(F.sum("n").alias("n")).groupBy("component").agg(F.sort_array(F.collect_list(F.struct(F.col(c).cast("string").alias("k"), "n"))).alias(name))
    size = cells.groupBy("component").agg(F.sum("n").alias("size"))
    every = size.join(by("task", "tasks"), "component", "left").join(by("label", "labels"), "component", "left")
    if coarse:
        level = lambda n: F.pow(F.lit(2), F.floor(F.log2(n))).cast("long")
        most = lambda c: F.array_max(F.transform(c, lambda x: F.struct(x["n"], x["k"])))
        one = lambda x: F.struct(x["k"].alias("k"), level(x["n"]).alias("n"))
        totals = cells.where(F.col("label").isNotNull()).groupBy("label").agg(F.sum("n").alias("t"))
        rare = cells.join(totals, "label").groupBy("component", "label", "t").agg(F.sum("n").alias("n")).groupBy("component").agg(F.min(F.struct("t", F.col("label").cast("string").alias("k"), "n")).alias("rare"))
        both = F.sort_array(F.array_distinct(F.array(one(F.col("rare")), one(most("labels")))))
        tasks, labels = F.when(F.col("tasks").isNotNull(), F.array(one(most("tasks")))), F.when(F.col("labels").isNotNull(), both)
        every = every.join(rare, "component", "left").select("component", "size", level(F.col("size")).alias("level"), tasks.alias("tasks"), labels.alias("labels"))
    else:
        every = every.withColumn("level", F.col("size"))
    return every.select("component", "size", F.to_json(F.struct(F.col("level").alias("size"), "tasks", "labels")).alias("kind"))


def deal(kinds: list[tuple[dict, int]], shares: tuple = SHARES, part: int = PART) -> list[list[int]]:
    """How many components of each kind (size, tasks, labels; and how many there are) go to each split.

    Kinds with rare labels come first, then large ones. Of a kind a part at a time goes to the split with the greatest score: what it still lacks of rows, and of the tasks and labels that the
    components hold, each as a share of what it should have and weighted, less a price for going beyond its rows.
    """
    names = [n for n, _ in shares]
    tasks = sorted({x["k"] for k, _ in kinds for x in k.get("tasks") or ()})
    labels = sorted({x["k"] for k, _ in kinds for x in k.get("labels") or ()})
    place = {("t", x): 1 + i for i, x in enumerate(tasks)} | {("l", x): 1 + len(tasks) + i for i, x in enumerate(labels)}
    weight = np.array([ROWS, *[TASKS] * len(tasks), *[LABELS] * len(labels)])
    holds = np.zeros((len(kinds), len(weight)))
    for row, (k, _) in zip(holds, kinds):
        row[0] = k["size"]
        for tag, own in (("t", k.get("tasks")), ("l", k.get("labels"))):
            for x in own or ():
                row[place[tag, x["k"]]] = x["n"]
    count = np.array([c for _, c in kinds], np.int64)
    total = count @ holds
    wanted = np.outer([s for _, s in shares], total)
    held, out = np.zeros_like(wanted), np.zeros((len(kinds), len(names)), np.int64)
    slack = np.array([SLACK.get(n, OTHER_SLACK) for n in names])
    rare = [min((total[j] for j in np.flatnonzero(row[1 + len(tasks) :]) + 1 + len(tasks)), default=total[0]) for row in holds]
    scale = np.maximum(wanted, 1)
    for i in sorted(range(len(kinds)), key=lambda i: (rare[i], -holds[i, 0], str(kinds[i][0]))):
        left, row = int(count[i]), holds[i]
        gain = weight * row / max(row[0], 1)
        gain[0] = ROWS
        while left:
            over = held[:, 0] + row[0] - slack[:, 0] * wanted[:, 0]
            score = ((wanted - held) / scale) @ gain - np.where(over > 0, slack[:, 1] * over / scale[:, 0], 0)
            best = int(score.argmax())
            k = max(1, left // part)
            held[best] += k * row
            out[i, best] += k
            left -= k
    return out.tolist()


def deficit_split(cells: DataFrame, ood: DataFrame | None = None, shares: tuple = SHARES, seed: str = "deficit", most: int = MOST_CLASSES) -> DataFrame:
    """(component, split) for cells (component, task, label, n): each split is filled by what it lacks, and no component is split. Components of ood (component) go there.

    Components that count alike are one class, and only classes reach the driver, with their numbers; where there are too many they are made coarser. Which components of a
    class go where is told by a hash. Null tasks and labels count as rows only.
    """
    rows = cells if ood is None else cells.join(ood.select("component").distinct(), "component", "left_anti")
    found = checkpoint(classes(rows))
    per = found.groupBy("kind").agg(F.count(F.lit(1)).alias("c"))
    if per.count() > most:
        found = checkpoint(classes(rows, coarse=True))
        per = found.groupBy("kind").agg(F.count(F.lit(1)).alias("c"))
    kinds = [(r["kind"], r["c"]) for r in per.collect()]
    dealt = deal([(json.loads(k), c) for k, c in kinds], shares)
    upto = [(k, *np.cumsum(d).tolist()) for (k, _), d in zip(kinds, dealt)]
    spark = cells.sparkSession
    bounds = spark.createDataFrame(upto, "kind string, " + ", ".join(f"u{i} long" for i in range(len(shares))))
    placed = numbered(found.withColumn("h", F.sha2(F.concat_ws(":", F.lit(seed), F.col("component").cast("string")), 256)), ["kind"], ["h", "component"], "place")
    split = None
    for i, (name, _) in enumerate(shares):
        here = F.col("place") <= F.col(f"u{i}")
        split = F.when(here, name) if split is None else split.when(here, name)
    out = placed.join(F.broadcast(bounds), "kind").select("component", split.alias("split"))
    return out if ood is None else out.unionByName(ood.select("component").distinct().withColumn("split", F.lit("ood")))
