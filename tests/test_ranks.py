"""The rank of the first right card against all distances."""

import random

import pytest

from recordmill.operators import stats as S


@pytest.mark.parametrize("block", [7, 1 << 19])
def test_ranks_equal_those_by_all_distances(spark, block):
    r = random.Random(8)
    number = lambda: r.choice((None, r.randrange(-300, 900) / 100, 0.1 + 0.2, 0.3, 1e17, r.random())) if r.random() < 0.3 else r.randrange(-300, 900) / 100
    queries = [(i, r.choice((0, 1, 2, 3, 9, None)), number()) for i in range(120)]
    cards = [(i, r.choice((0, 1, 2, None)), number()) for i in range(60)] + [(100, 3, None)]
    want = {}
    for q, gold, x in queries:
        d = [(kind == gold and gold is not None, float("inf") if x is None or y is None else abs(x - y)) for _, kind, y in cards]
        near = min((v for on, v in d if on), default=None)
        want[q] = None if near is None else 1 + sum(v < near for _, v in d)
    got = S.first_right_rank(spark.createDataFrame(queries, "q long, gold long, x double"), spark.createDataFrame(cards, "card long, kind long, y double"), block)
    assert {x.q: x.best for x in got.collect()} == want
