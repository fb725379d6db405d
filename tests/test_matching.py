"""Matching on a line: closest free pairs, by blocks whose seams move."""

import random

import pytest

from recordmill.operators import joins as J

COLS = "g string, v double, id long"


def plain(wanted, offered):
    left, free, want = list(wanted), list(offered), {}
    while True:
        best = min(((abs(w[1] - o[1]), w[2], o[2], w, o) for w in left for o in free if w[0] == o[0] and w[1] is not None and o[1] is not None), default=None, key=lambda b: b[:3])
        if best is None:
            return want
        want[best[1]] = (best[2], best[0])
        left.remove(best[3])
        free.remove(best[4])


@pytest.mark.parametrize("most, digits", [(1 << 17, 1), (24, 3), (16, 0)])
def test_closest_free_pairs_equal_a_plain_loop(spark, most, digits):
    """With few digits values repeat and distances tie; with small blocks most pairs meet a seam."""
    r = random.Random(most + digits)
    side = lambda n, first: [(r.choice(["a", "b", None]), round(r.random() * 20, digits), first + i) for i in range(n)]
    wanted, offered = side(40, 0) + [("a", None, 900), ("only", 1.0, 901)], side(45, 1000) + [("b", None, 1900)]
    got = J.nearest_unused(spark.createDataFrame(wanted, COLS), spark.createDataFrame(offered, COLS), ["g"], "v", "id", most=most).collect()
    assert {x.w: (x.o, x.distance) for x in got} == plain(wanted, offered) and len(got) == len({x.o for x in got})


def chain(n):
    """Each gap is wider than the one before, so each pair waits for the pair on its left."""
    x, wanted, offered = 0.0, [], []
    for k in range(n):
        x += 1 + k * 1e-3
        (wanted if k % 2 else offered).append(("a", x, k))
    return wanted, offered


def test_a_chain_takes_few_rounds(spark):
    wanted, offered = chain(5000)
    got = J.nearest_unused(spark.createDataFrame(wanted, COLS), spark.createDataFrame(offered, COLS), ["g"], "v", "id", rounds=10, most=2048).collect()
    assert {x.w: x.o for x in got} == {k: k - 1 for k in range(1, 5000, 2)}
    with pytest.raises(RuntimeError):
        J.nearest_unused(spark.createDataFrame(wanted, COLS), spark.createDataFrame(offered, COLS), ["g"], "v", "id", rounds=1, most=512)


def test_nothing_to_match(spark):
    none, some = spark.createDataFrame([], COLS), spark.createDataFrame([("a", 1.0, 1)], COLS)
    assert J.nearest_unused(none, some, ["g"], "v", "id").count() == 0 and J.nearest_unused(some, none, ["g"], "v", "id").count() == 0
    assert [tuple(r) for r in J.nearest_unused(some, some, ["g"], "v", "id").collect()] == [(1, 1, 0.0)]
