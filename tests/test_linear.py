"""Linear models on grams, summaries of seeded runs, bootstrap over runs and clusters, and calibration of several labels, against plain numbers."""

import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordmill.operators import linear as L, resampling as Z, stats as S

WORDS = {"animal": ["horse", "mouse", "whale", "otter", "horses"], "plant": ["grass", "cedar", "maple", "tulip", "grasses"], "stone": ["quartz", "flint", "basalt", "slate"]}


def texts(n=240, noise=0.25, seed=5):
    r = random.Random(seed)
    out = []
    for i in range(n):
        label = r.choice(list(WORDS))
        own = [r.choice(WORDS[r.choice(list(WORDS)) if r.random() < noise else label]) for _ in range(8)]
        out.append((i, " ".join(own), label, i % 4 == 0))
    return out + [(n, None, "stone", False), (n + 1, "", "plant", True), (n + 2, "horse horse", None, False), (n + 3, "horse", None, True)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, label string, held_out boolean")


@pytest.fixture(scope="module")
def runs(spark):
    found, model = L.classified(frame(spark, texts()), "id", "label", "held_out", seeds=[1, 2, 3], loss="modified_huber", features=500, shards=3, rounds=3)
    return found, model


def test_vocabulary_is_the_most_frequent_grams(spark):
    rows = texts(60)
    known = L.vocabulary(frame(spark, rows), features=50, widths=(2, 3))
    tf, df = Counter(), Counter()
    for _, t, _, _ in rows:
        own = L.gram_numbers(t or "", (2, 3)).tolist()
        tf.update(own)
        df.update(set(own))
    best = sorted(sorted(tf, key=lambda g: (-tf[g], g))[:50])
    assert known.numbers.tolist() == best
    assert np.allclose(known.idf, [np.log((1 + len(rows)) / (1 + df[g])) + 1 for g in best])
    assert len(L.gram_numbers("ab  CD", (2, 4))) == 4 + 3 + 2 and len(L.gram_numbers("a")) == 0 and L.gram_numbers("Ab").tolist() == L.gram_numbers("aB").tolist()


def test_predictions_are_good_and_differ_by_seed(runs):
    found, model = runs
    rows = [r for r in found.collect() if r.label]
    assert model.labels == ["animal", "plant", "stone"] and len(rows) == 3 * 61
    for s in (1, 2, 3):
        own = [r for r in rows if r.seed == s]
        assert sum(r.pred == r.label for r in own) / len(own) > 0.9
    assert all(abs(sum(r.probs) - 1) < 1e-9 for r in rows)
    assert not np.allclose(model.weights[0], model.weights[1])


@pytest.mark.parametrize("loss", ["hinge", "squared_hinge", "log"])
def test_losses_and_slopes(spark, loss):
    value = {"hinge": lambda m: max(0, 1 - m), "squared_hinge": lambda m: max(0, 1 - m) ** 2, "log": lambda m: np.log1p(np.exp(-m))}[loss]
    for m in (-2.5, -0.3, 0.4, 2.0):
        assert abs((value(m + 1e-6) - value(m - 1e-6)) / 2e-6 - float(L.slope(loss, np.array([m]))[0])) < 1e-4
    with pytest.raises(ValueError):
        L.slope("other", np.zeros(1))


def test_weights_do_not_depend_on_partitions(spark):
    rows = frame(spark, texts(80))
    made = [L.classified(rows.repartition(n), "id", "label", "held_out", features=200, shards=3, rounds=1)[1].weights for n in (1, 5)]
    assert np.array_equal(*made)


def test_one_label_cannot_be_learned(spark):
    with pytest.raises(ValueError):
        L.classified(frame(spark, [(1, "a b c", "x", False), (2, "d e f", "x", True)]), "id", "label", "held_out")


def f1(pairs, labels):
    out = []
    for x in labels:
        hit, both = sum(g == p == x for g, p in pairs), sum(g == x for g, _ in pairs) + sum(p == x for _, p in pairs)
        out.append(2 * hit / both if both else 0.0)
    return sum(out) / len(labels)


def test_run_summary(spark):
    r = random.Random(4)
    rows = [(s, r.choice("abc"), r.choice("abcd")) for s in range(4) for _ in range(50)] + [(0, None, "a")]
    x = S.run_summary(spark.createDataFrame(rows, "s int, g string, p string"), "s", "g", "p").first()
    fs, bs = [], []
    for s in range(4):
        own = [(g, p) for t, g, p in rows if t == s and g]
        fs.append(f1(own, "abcd"))
        bs.append(statistics.mean(sum(g == p == y for g, p in own) / sum(g == y for g, _ in own) for y in "abc"))
    assert (x.runs, x.n) == (4, 50)
    for name, v in (("macro_f1", fs), ("balanced", bs)):
        assert [x[f"{name}_{k}"] for k in ("mean", "population_std", "sample_std", "least", "greatest")] == [round(y, 6) for y in (statistics.mean(v), statistics.pstdev(v), statistics.stdev(v), min(v), max(v))]


def clustered(seed=9):
    r = random.Random(seed)
    rows = []
    for c in range(40):
        hard = r.random() * 0.6
        for _ in range(r.randrange(3, 12)):
            g = r.choice("ab")
            flip = lambda p: g if r.random() > p else {"a": "b", "b": "a"}[g]  # noqa: E731, B023
            rows.append((f"c{c}", g, flip(hard), flip(hard * 0.6), [flip(hard * k / 3) for k in (2, 3, 4)]))
    return rows


def test_two_level_interval_is_that_of_resampled_rows(spark):
    rows = clustered()
    df = spark.createDataFrame(rows, "c string, g string, p string, q string, runs array<string>").select("c", "g", F.posexplode("runs").alias("run", "pred"))
    x = Z.two_level_bootstrap(df, "c", "g", "pred", "run", draws=1500).first()
    rng, by = random.Random(1), {}
    for c, g, _, _, own in rows:
        by.setdefault(c, []).append((g, own))
    names, values = sorted(by), []
    for _ in range(1500):
        total = 0.0
        for k in rng.choices(range(3), k=3):
            total += f1([(g, own[k]) for c in rng.choices(names, k=len(names)) for g, own in by[c]], "ab")
        values.append(total / 3)
    point = sum(f1([(g, own[k]) for _, g, _, _, own in rows], "ab") for k in range(3)) / 3
    low, high = np.percentile(values, (2.5, 97.5))
    assert (x.runs, x.clusters, x.n) == (3, 40, 3 * len(rows)) and abs(x.macro_f1 - point) < 1e-6
    assert abs(x.low - low) < 0.02 and abs(x.high - high) < 0.02
    again = Z.two_level_bootstrap(df.repartition(5), "c", "g", "pred", "run", draws=1500).first()
    assert again == x


def test_clustered_difference_is_that_of_resampled_rows(spark):
    rows = clustered(3)
    x = Z.clustered_delta(spark.createDataFrame(rows, "c string, g string, p string, q string, runs array<string>"), "c", "g", "p", "q", draws=1500).first()
    rng, by = random.Random(2), {}
    for c, g, p, q, _ in rows:
        by.setdefault(c, []).append((g, p, q))
    delta = lambda some: f1([(g, q) for g, _, q in some], "ab") - f1([(g, p) for g, p, _ in some], "ab")
    values = [delta([y for c in rng.choices(sorted(by), k=len(by)) for y in by[c]]) for _ in range(1500)]
    low, high = np.percentile(values, (2.5, 97.5))
    assert abs(x.difference - delta([y for own in by.values() for y in own])) < 1e-6
    assert abs(x.low - low) < 0.02 and abs(x.high - high) < 0.02


def test_intervals_without_rows(spark):
    none = spark.createDataFrame([(None, "a", "b"), ("c", None, "b")], "c string, g string, p string")
    x = Z.two_level_bootstrap(none, "c", "g", "p", draws=10).first()
    assert (x.runs, x.clusters, x.n, x.macro_f1, x.low) == (0, 0, 0, None, None)
    y = Z.clustered_delta(none, "c", "g", "p", "p", draws=10).first()
    assert (y.clusters, y.n, y.difference, y.low) == (0, 0, None, None)


def test_multiclass_calibration(spark):
    r = random.Random(7)
    rows = []
    for _ in range(200):
        p = [r.random() + 1e-9 for _ in range(4)]
        rows.append(([x / sum(p) for x in p], r.randrange(4)))
    rows += [([0.25] * 4, 0), ([1.0, 0.0, 0.0, 0.0], 0), (None, 1), ([0.5, 0.5, 0.0, 0.0], None)]
    x = S.multiclass_calibration(spark.createDataFrame(rows, "p array<double>, y int"), "p", F.col("y")).first()
    real = [(p, y) for p, y in rows if p and y is not None]
    probs, gold = np.array([p for p, _ in real]), np.array([y for _, y in real])
    conf, hit, ece = probs.max(1), probs.argmax(1) == gold, 0.0
    for k in range(10):
        on = (conf > k / 10) & (conf <= (k + 1) / 10)
        if on.any():
            ece += on.mean() * abs(hit[on].mean() - conf[on].mean())
    brier = ((probs - np.eye(4)[gold]) ** 2).sum(1).mean()
    assert x.n == len(real) and abs(x.ece - ece) < 1e-5 and abs(x.brier - brier) < 1e-5


def test_packed_features_are_whole_and_small():
    r = np.random.default_rng(3)
    idf = r.random(70_000) + 1
    for n in (0, 1, 5, 900, 60_000):
        places, counts = np.sort(r.choice(70_000, n, replace=False)), r.geometric(0.7, n) + (r.random(n) < 0.001) * 100_000
        x, v = L.unpacked(data := L.packed(places, counts), idf)
        plain = counts * idf[places]
        assert np.array_equal(x, places) and np.array_equal(v, (plain / max(1e-12, np.sqrt((plain * plain).sum()))).astype(np.float32))
        assert n < 900 or len(data) < 4 * n  # 8 bytes before


@pytest.mark.parametrize("name", ["linear_classifier", "seed_stability", "two_level_interval"])
def test_what_linear_queries_write(spark, name):
    import os

    from recordmill import session
    from recordmill.plans.catalogue import queries

    had, sf = len(session._stored), "/root/testdata/sf0.01"
    assert queries()[name](spark, sf).count() > 0
    written = {p: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(p.removeprefix("file:")) for f in names if f.endswith(".parquet")) for p in session._stored[had:]}
    assert sum(written.values()) < 2.2 * os.path.getsize(f"{sf}/documents.parquet")
