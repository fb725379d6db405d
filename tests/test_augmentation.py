"""New records from others, numbers in large groups, matched strata, and scores of query classes, against plain loops."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from recordmill.operators import augmentation as G, query_baseline as Q, ranking as R, strata as T
from recordmill.operators.states import decision


def test_counterfactuals_equal_a_plain_loop(spark):
    r = random.Random(12)
    flat = [s for v in G.SURFACES.values() for s in v]
    states = [(f"s{i}", r.choice(["normal", "thermal", "voltage", "combined"]), r.choice(["normal", "alert", "emergency"]), r.choice([50.0, 99.0, 104.0, 120.0]), r.choice([0.9, 0.94, 1.0]), r.choice([1.0, 1.06, 1.1])) for i in range(30)]
    rows = [(i, r.choice(["", None, *[f"sum{k}" for k in range(25)]]), f"s{r.randrange(33)}", r.choice(G.WANTED), r.choice([*flat, "other", None])) for i in range(80)]
    table = spark.createDataFrame(states, "scenario_id string, profile string, severity string, max_loading double, min_vm double, max_vm double")
    labels = {(x.scenario_id, c): x[c] for x in table.select("scenario_id", *[decision(F.lit(c), *[F.col(k) for k in ("profile", "severity", "max_loading", "min_vm", "max_vm")]).alias(c) for c in G.SURFACES]).collect() for c in G.SURFACES}
    known = {s[0] for s in states}
    first, has = {}, defaultdict(set)
    for row in rows:
        if row[1]:
            first.setdefault(row[1], row)
            has[row[1]].add(row[3])
    want = []
    for number, (summary, row) in enumerate(first.items()):
        if row[2] not in known:
            continue
        by = {}
        for k, (c, words) in enumerate(G.SURFACES.items()):
            word = words[(number + k) % len(words)]
            if word == row[4]:
                word = words[(number + k + 1) % len(words)]
            label = labels[row[2], c]
            if label not in has[summary]:
                by.setdefault(label, (c, word))
        for v, label in enumerate([x for x in G.WANTED if x in by][:2], 1):
            want.append((f"{row[0]}_counterfactual_0{v}", row[0], v, summary, by[label][0], label, by[label][1], G.REQUESTS[v].replace("{action}", by[label][1])))
    got = G.counterfactual(spark.createDataFrame(rows, "id long, summary string, scenario_id string, label string, action string"), table, ["id"]).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 10


def test_wordings_are_found(spark):
    s = G.SURFACES["monitor_only"][0]
    long_, short = "直接恢复故障线路运行，不校核设备状态", "继续提升受限断面潮流"
    rows = [(1, s, "", s), (2, None, f"a {short} b {long_} c", long_), (3, "x", "nothing", None), (4, f"so {short}", None, short), (5, None, None, None)]
    got = spark.createDataFrame([r[:3] for r in rows], "i long, a string, t string").select("i", G.known_surface(F.col("a"), F.col("t")).alias("s")).collect()
    assert {x.i: x.s for x in got} == {r[0]: r[3] for r in rows}


def test_numbers_in_groups_of_any_size(spark):
    r = random.Random(3)
    rows = [(r.choice(["big"] * 8 + ["b", None]), r.randrange(50), i) for i in range(900)]
    want = {}
    for g, own in itertools.groupby(sorted(rows, key=lambda x: (str(x[0]), x[1], x[2])), key=lambda x: x[0]):
        want |= {x[2]: k for k, x in enumerate(own, 1)}
    frame = spark.createDataFrame(rows, "g string, v long, id long").repartition(5)
    for runs in (R.BROADCAST_RUNS, 0):
        assert {x.id: x.n for x in R.numbered_by_range(frame, ["g"], ["v", "id"], "n", runs).collect()} == want
    assert {x.id: x.n for x in R.numbered(frame, ["g"], ["v", "id"], "n", most=10).collect()} == want
    assert {x.id: x.n for x in R.numbered(frame, ["g"], ["v", "id"], "n").collect()} == want
    a, b = (sorted(map(tuple, R.round_robin(frame.fillna("none"), ["g"], ["v"], ["id"], most=m).collect())) for m in (5, 1 << 20))
    assert a == b
    plan = R.numbered_by_range(frame, ["g"], ["v", "id"], "n")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert R.numbered_by_range(frame.where("false"), ["g"], ["v", "id"]).count() == 0


def plain_block(counts, firsts, seconds, target):
    best, score = ((), ()), (0, 0, 0, ())
    for n in range(2, len(firsts) + 1):
        for own in itertools.combinations(firsts, n):
            other = tuple(s for s in seconds if all(counts[f, s] >= target for f in own))
            if len(other) >= 2 and (new := (n * len(other), n, len(other), own + other)) > score:
                best, score = (own, other), new
    return best


def test_blocks_of_common_support(spark):
    r = random.Random(9)
    firsts, seconds = ["n1", "n2", "n3", "n4", "n5"], ["normal", "alert", "emergency", "worse"]
    for trial in range(4):
        rows = [(i, r.choice([*firsts, "other"]), r.choice([*seconds, None])) for i in range(120 + 30 * trial)]
        counts = Counter((f, s) for _, f, s in rows)
        frame = spark.createDataFrame(rows, "id long, f string, s string")
        target = 5 + trial
        cells = T.cell_counts(frame, "f", "s", firsts, seconds)
        block = T.common_support(cells, "f", "s", firsts, seconds, target)
        got = block.first()
        want = plain_block(counts, firsts, seconds, target)
        assert (tuple(got.firsts), tuple(got.seconds)) == want
        chosen = [(x.f, x.s, x.id) for x in T.matched_rows(frame, block, "f", "s", "id", target, "7").collect()]
        order = sorted(rows, key=lambda x: (hashlib.sha256(f"7:{x[0]}".encode()).hexdigest(), x[0]))
        plain = [(f, s, i) for f in want[0] for s in want[1] for i in [x[0] for x in order if x[1:] == (f, s)][:target]]
        assert sorted(chosen) == sorted(plain)
        for c in T.matched_cells(cells, block, "f", "s", target).collect():
            inside = c.f in want[0] and c.s in want[1]
            assert (c.available, c.in_block, c.selected, c.shortage, c.block_shortage) == (counts[c.f, c.s], inside, target if inside else 0, max(0, target - counts[c.f, c.s]), 0 if inside else None)
    none = T.common_support(T.cell_counts(frame.where("false"), "f", "s", firsts, seconds), "f", "s", firsts, seconds, 1).first()
    assert (none.firsts, none.seconds) == ([], [])


def test_query_class_summary(spark):
    rows = [(1, "a", "a", True, True, True, True, 1.0, True), (2, "a", "b", False, False, False, True, 0.5, False), (3, "b", "b", True, False, True, False, 0.75, False)]
    x = Q.summary(spark.createDataFrame(rows, "id long, gold_label string, pred_label string, label_right boolean, exact boolean, schema_exact boolean, state_exact boolean, field_accuracy double, same_result boolean")).first()
    assert (x.n, x.accuracy, x.query_exact, x.schema_exact, x.state_exact, x.field_accuracy, x.same_result, x.majority_label, x.majority_accuracy) == (3, 0.666667, 0.333333, 0.666667, 0.666667, 0.75, 0.333333, "a", 0.666667)


def test_digests_by_levels(spark):
    from recordmill.operators.validation import ordered_digests

    rows = [("a", i) for i in range(0, 900, 3)] + [("b", 7), ("b", 7), (None, 5)]
    sha = lambda xs: hashlib.sha256(",".join(xs).encode()).hexdigest()
    got = {r.g: (r.n, r.sha) for r in ordered_digests(spark.createDataFrame(rows, "g string, id long"), "g", "id", width=10).collect()}
    level = {k: sha([str(i) for g, i in rows if g == "a" and i // 10 == k]) for k in range(90)}
    level = {k: sha([level[j] for j in sorted(level) if j // 10 == k]) for k in range(9)}
    assert got == {"a": (300, sha([level[k] for k in range(9)])), "b": (2, sha([sha(["7", "7"])])), None: (1, sha([sha(["5"])]))}
