"""Every query with SQL gives the SQL's rows on the small tables."""

import os

import duckdb
import numpy as np
import pytest

from recordmill.plans.catalogue import oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def norm(x):
    if x is None or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(norm, x))
    if isinstance(x, (float, np.floating)):
        return float(f"{x:.9g}")
    return x if isinstance(x, (str, bool, int)) else str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_rows_equal_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    found = duck.sql(oracle_sql()[name])
    assert sorted(found.columns) == cols
    theirs = sorted(repr(tuple(norm(dict(zip(found.columns, r))[c]) for c in cols)) for r in found.fetchall())
    assert ours == theirs


def test_every_query_without_sql_is_tested_elsewhere():
    assert set(queries()) - set(oracle_sql()) == {"nearest_unique_replacement", "bootstrap_interval", "near_neighbour_free_split", "minhash_lsh_neighbours", "greedy_component_split", "tfidf_classifier", "label_coverage_splits", "tiered_replacement", "bootstrap_label_scores", "bootstrap_paired_difference", "deficit_component_split", "seed_stability", "two_level_interval", "clustered_difference", "linear_classifier", "query_label_baseline", "action_counterfactuals"}
