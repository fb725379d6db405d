"""Components dealt by deficits, against a plain fold over one component after the other."""

import random
from collections import Counter, defaultdict

import pytest

from recordmill.operators import allocation as L

SHARES = dict(L.SHARES)


def made(seed=5, n=600):
    r = random.Random(seed)
    cells = []
    for c in range(n):
        size = r.choice([1, 1, 1, 2, 2, 3, 5, 9])
        rows = Counter((r.choices(["query", "advice", "check"], [6, 3, 1])[0], r.choices(["ok", "bad", "rare", None], [60, 30, 2, 8])[0]) for _ in range(size))
        cells += [(c, t, l, k) for (t, l), k in rows.items()]
    return cells


def deviations(cells, split):
    """The greatest distance from its share, of rows, and of tasks and labels with at least thirty rows."""
    held = defaultdict(Counter)
    for c, t, l, n in cells:
        for k in ("rows", ("t", t), ("l", l)):
            held[k][split[c]] += n
    off = lambda k: max(abs(held[k][s] / sum(held[k].values()) - x) for s, x in SHARES.items())
    return off("rows"), max(off(k) for k, v in held.items() if k != "rows" and sum(v.values()) >= 30 and k[1] is not None)


def fold(cells):
    """One component after the other, rare labels first, each to the split that lacks most of what it holds."""
    own = defaultdict(lambda: [0, Counter(), Counter()])
    for c, t, l, n in cells:
        own[c][0] += n
        own[c][1][t] += n
        if l is not None:
            own[c][2][l] += n
    total, tasks, labels = sum(x[0] for x in own.values()), Counter(), Counter()
    for x in own.values():
        tasks.update(x[1])
        labels.update(x[2])
    now = {s: [0, Counter(), Counter()] for s in SHARES}
    split = {}
    for c in sorted(own, key=lambda c: (min((labels[x] for x in own[c][2]), default=total), -own[c][0], c)):
        size, mine = own[c][0], own[c]
        best = None
        for s, share in SHARES.items():
            score = L.ROWS * (share * total - now[s][0]) / (share * total)
            for weight, k, every in ((L.TASKS, 1, tasks), (L.LABELS, 2, labels)):
                score += sum(weight * n / size * (share * every[x] - now[s][k][x]) / max(share * every[x], 1) for x, n in mine[k].items())
            most, price = L.SLACK.get(s, L.OTHER_SLACK)
            score -= price * max(0, now[s][0] + size - most * share * total) / (share * total)
            if best is None or score > best[0]:
                best = (score, s)
        split[c] = best[1]
        now[best[1]][0] += size
        now[best[1]][1].update(mine[1])
        now[best[1]][2].update(mine[2])
    return split


@pytest.mark.parametrize("most", [L.MOST_CLASSES, 10])
def test_shares_no_worse_than_a_plain_fold(spark, most):
    cells = made()
    frame = spark.createDataFrame(cells, "component long, task string, label string, n long")
    rows = L.deficit_split(frame, most=most).collect()
    split = {r.component: r.split for r in rows}
    assert len(rows) == len(split) == 600 and set(split.values()) == set(SHARES)
    got, want = deviations(cells, split), deviations(cells, fold(cells))
    assert got[0] <= want[0] + 0.01 and got[1] <= want[1] + (0.02 if most > 10 else 0.06), (got, want)
    assert {r.component: r.split for r in L.deficit_split(frame.repartition(7), most=most).collect()} == split


def test_out_of_distribution_components_stay_apart(spark):
    cells = made(6, 80)
    frame = spark.createDataFrame(cells, "component long, task string, label string, n long")
    ood = spark.createDataFrame([(3,), (3,), (7,)], "component long")
    got = {r.component: r.split for r in L.deficit_split(frame, ood).collect()}
    assert got[3] == got[7] == "ood" and sum(s == "ood" for s in got.values()) == 2 and len(got) == 80
    assert L.deficit_split(frame.where("false")).count() == 0


def test_a_large_class_is_dealt_in_parts():
    kinds = [({"size": 1, "tasks": [{"k": "t", "n": 1}], "labels": [{"k": "l", "n": 1}]}, 10**9), ({"size": 40, "tasks": None, "labels": None}, 3)]
    big, few = L.deal(kinds)
    assert sum(big) == 10**9 and sum(few) == 3 and all(abs(n / 10**9 - s) < 0.01 for n, (_, s) in zip(big, L.SHARES))
