"""Operators that SQL can't express, against plain loops, and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from recordmill.functions import text as X
from recordmill.operators import joins as J, ranking as R, similarity as M, splits as P, stats as S
from recordmill.operators.components import connected_components
from recordmill.sources import files as W


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(55)] + [(i, i + 1) for i in range(100, 140)] + [(3, 3), (7, 8), (7, 8)]
    df = spark.createDataFrame([*edges, (None, 5)], "src long, dst long")
    got = {x.node: x.component for x in connected_components(df).collect()}
    want = roots({n for e in edges for n in e}, edges)
    assert got == {n: want[n] for e in edges if e[0] != e[1] for n in e}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_jaccard_join_equals_all_pairs(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("abcd ") for _ in range(60)) for _ in range(20)]
    texts += [t[:30] + "x" + t[31:] for t in texts[:10]] + [texts[0], "", None, "ab"]
    sets = M.gram_sets(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", F.col("t"), 3)
    plain = {i: {(t or "")[k : k + 3] for k in range(max(1, len(t or "") - 2))} for i, t in enumerate(texts)}
    assert {x.id: x.n for x in sets.collect()} == {i: len(g) for i, g in plain.items()}
    pairs, members = M.jaccard_join(sets, 0.7)
    rep = {x.id: x.rep for x in members.collect()}
    got = {(x.a, x.b): x.jaccard for x in pairs.collect()}
    want = {}
    reps = sorted(set(rep.values()))
    for i, a in enumerate(reps):
        for b in reps[i + 1 :]:
            j = len(plain[a] & plain[b]) / len(plain[a] | plain[b])
            if j >= 0.7:
                want[a, b] = round(j, 9)
    assert got == want and all(plain[i] == plain[k] for i, k in rep.items())
    near = {(x.a, x.b) for x in M.lsh_neighbours(sets.join(members.select(F.col("rep").alias("id")).distinct(), "id"), 0.7).collect()}
    assert near <= set(want) and len(near) >= 0.9 * len(want)


def test_nearest_unused_is_a_greedy_matching(spark):
    r = random.Random(2)
    wanted = [(g, round(r.random() * 100, 3), i) for i in range(30) for g in [r.choice("ab")]]
    offered = [(g, round(r.random() * 100, 3), 1000 + i) for i in range(40) for g in [r.choice("ab")]]
    cols = "g string, v double, id long"
    got = {x.w: x.o for x in J.nearest_unused(spark.createDataFrame(wanted, cols), spark.createDataFrame(offered, cols), ["g"], "v", "id").collect()}
    left, free, want = list(wanted), list(offered), {}
    while True:  # the closest free pair of each group first, as mutual nearest neighbours settle
        best = min(((abs(w[1] - o[1]), w, o) for w in left for o in free if w[0] == o[0]), default=None)
        if best is None:
            break
        _, w, o = best
        want[w[2]] = o[2]
        left.remove(w)
        free.remove(o)
    assert got == want


def test_greedy_split_keeps_components_and_shares(spark):
    r = random.Random(3)
    comps = spark.createDataFrame([(i, r.randrange(1, 12), r.random() < 0.1) for i in range(400)], "c long, n long, ood boolean")
    rows = P.greedy_split(comps, "c").join(comps, "c").collect()
    assert len(rows) == 400 and all((x.split == "ood") == x.ood for x in rows)
    rest = [x for x in rows if not x.ood]
    total = sum(x.n for x in rest)
    for name, share in P.SHARES:
        assert abs(sum(x.n for x in rest if x.split == name) / total - share) < 0.02


def test_bootstrap_covers_the_mean(spark):
    df = spark.createDataFrame([(i % 30, float(i % 7)) for i in range(600)], "c long, v double")
    x = S.cluster_bootstrap(df, "c", "v", 100).first()
    assert x.draws == 100 and x.low <= x["mean"] <= x.high


def test_quota_selection(spark):
    rows = spark.createDataFrame([(i, i % 3, "a" if i % 2 else "b", i < 3) for i in range(40)], "id long, src long, kind string, f boolean")
    kept = R.quota_selection(rows, "kind", "src", {"a": 5, "b": 4}, 4, "id", F.col("f")).collect()
    assert sum(x.why == "forced" for x in kept) == 3 and all(sum(y.src == s for y in kept) <= 4 for s in range(3))
    assert sum(x.kind == "a" and x.why == "quota" for x in kept) == 5


def test_merge_and_first_wins(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), spark.createDataFrame([(2, "y"), (1, "z"), (3, None)], "k long, v string")
    merged, conflicts = J.merge_checked("k", a, b)
    assert sorted(map(tuple, merged.collect()), key=str) == [(2, "y"), (3, None)] and [x.k for x in conflicts.collect()] == [1]
    assert sorted(map(tuple, J.first_wins("k", a, b).collect()), key=str) == [(1, "x"), (2, "y"), (3, None)]


def test_text_functions(spark):
    df = spark.createDataFrame([("  A  b\n\tc ", "07:45", 1.25, "non_compliant"), (None, "x", float("nan"), "qq"), ("", "24:1", float("inf"), "")], "t string, c string, x double, l string")
    got = df.select(X.collapse_blanks(F.col("t")).alias("t"), X.minutes_of(F.col("c")).alias("m"), X.finite(F.col("x")).alias("x"), X.words(F.col("t")).alias("w"), X.leaks(F.col("l"), F.lit("Is Non Compliant")).alias("k")).collect()
    assert [tuple(x) for x in got] == [("A b c", 465, 1.25, ["a", "b", "c"], True), (None, None, None, None, False), ("", None, None, [], True)]


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", [1, 2]), (2, None, [])], "id long, t string, a array<long>")
    for kind in ("jsonl", "parquet"):
        W.write_checked(df, f"{tmp_path}/{kind}", "id", kind)
        assert sorted(map(tuple, W.read_records(spark, f"{tmp_path}/{kind}", df.schema, kind).collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n\n{"id": \n')
    with pytest.raises(Exception):
        W.read_records(spark, f"{tmp_path}/bad.jsonl", df.schema, "jsonl").collect()
    W.write_csv(df.select("id", "t"), f"{tmp_path}/csv")
    assert W.read_csv(spark, f"{tmp_path}/csv", "id long, t string").count() == 2
    (tmp_path / "case.m").write_text("mpc.baseMVA = 100;\nmpc.bus = [\n1 3 0.5;\n2 1 -1e2;\n];\n")
    m = W.read_case(spark, f"{tmp_path}/case.m").collect()
    assert {(x.matrix, x.row, x.col): x.value for x in m if x.matrix == "bus"} == {("bus", 0, 0): 1, ("bus", 0, 1): 3, ("bus", 0, 2): 0.5, ("bus", 1, 0): 2, ("bus", 1, 1): 1, ("bus", 1, 2): -100}
    with pytest.raises(ValueError):
        W.write_checked(df.union(df), f"{tmp_path}/twice", "id", "jsonl")


def test_inspect_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a.jsonl").write_text('{"id": 1}\n{"id": 1}\n\n{"id": 2}\n')
    x = W.inspect_files(spark, f"{tmp_path}/*.jsonl").first()
    assert (x.n_records, x.n_ids, x.size, x.sha256) == (3, 2, (tmp_path / "a.jsonl").stat().st_size, hashlib.sha256((tmp_path / "a.jsonl").read_bytes()).hexdigest())


def test_stream_of_records(spark, tmp_path):
    from recordmill.streaming.ledger import follow_ledger

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.jsonl").write_text('{"id": 1, "status": "ok", "ts": "2024-01-01T00:00:00"}\n{"id": 1, "status": "ok", "ts": "2024-01-01T00:00:01"}\n{"id": 2, "status": "bad", "ts": "2024-01-01T00:00:02"}\n')
    q = follow_ledger(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert sorted((x.id, x.status) for x in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, "ok"), (2, "bad")]
