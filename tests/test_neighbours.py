"""Neighbours by gram sets against all pairs, in many tiles, and what they write."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from recordmill import session
from recordmill.operators import similarity as M
from recordmill.plans import repairs, similarity


def grams(t):
    t = " ".join(t.lower().split())
    return {t[k : k + 5] for k in range(max(1, len(t) - 4))}


def texts(seed=1, n=40):
    r, out = random.Random(seed), ["", "ab", "abcdefghij", "abcdefghijk"]
    for i in range(n):
        base = [r.choice("abcdefgh ") for _ in range(r.choice((30, 90, 300, 900)))]
        out.append("".join(base))
        for share in (0.01, 0.02, 0.03):
            at = r.sample(range(len(base)), max(1, round(share * len(base))))
            out.append("".join("z" if k in at else x for k, x in enumerate(base)))
    base = [r.choice("abcdefgh ") for _ in range(400)]
    return out + ["".join(base[:k] + ["q"] + base[k + 1 :]) for k in range(0, 400, 13)] + out[:9]


def pairs_of(rows):
    sets, least = [grams(t) for t in rows], {}
    for i, s in enumerate(sets):
        least.setdefault(frozenset(s), i)
    ids = sorted(least.values())
    return {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])}


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(M, "TILE_ROWS", 5)
    monkeypatch.setattr(M, "SET_TILE", 8)


def docs(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_exact_pairs_in_many_tiles_and_no_set_is_written(spark, small_tiles):
    rows, before = texts(), len(session._stored)
    want = pairs_of(rows)
    pairs, _ = M.jaccard_join(similarity._sets(docs(spark, rows)), 0.85)
    assert {(x.a, x.b): x.jaccard for x in pairs.collect()} == want and len(want) > 400
    written = sum(os.path.getsize(f"{d}/{f}") for p in session._stored[before:] for d, _, names in os.walk(p.removeprefix("file:")) for f in names if f.endswith(".parquet"))
    assert written < 8 * sum(len(grams(t)) for t in rows)  # the sets alone would take this


def test_buckets_go_on_in_the_next_batch():
    r, bits = random.Random(4), M.Bits(0.85)
    own = {i: M.gram_hashes(t, 5) for i, t in enumerate(texts(2, 6))}
    rows = sorted((bits.class_of(len(g)) - role, len(g), i, role, bits.both(g)[1 + role]) for i, g in own.items() for role in (0, 1))
    columns = [*zip(*((b, i, n, role, x) for b, n, i, role, x in rows))]
    batch = pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.binary())], names=["bucket", "id", "n", "role", "bits"])
    cuts = sorted({0, len(rows), *r.sample(range(len(rows)), 9)})
    got = [{(a, b) for x in bits.in_buckets(iter(parts)) for a, b in zip(*(c.to_pylist() for c in x.columns))} for parts in ([batch], [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:])])]
    true = {(a, b) for a in own for b in own if a < b and len(np.intersect1d(own[a], own[b])) >= 0.85 * len(np.union1d(own[a], own[b]))}
    assert got[0] == got[1] and true <= got[0] and len(got[0]) < 2 * len(true)


def test_bands_give_only_pairs_at_the_threshold_in_many_tiles(spark, small_tiles):
    rows = texts(3)
    want = pairs_of(rows)
    pairs, members = M.lsh_neighbours(similarity._sets(docs(spark, rows)), 0.85)
    got = {(x.a, x.b): x.jaccard for x in pairs.collect()}
    assert got.items() <= want.items() and len(got) >= 0.98 * len(want) and members.count() == len(rows)


def components(rows):
    comp = {}
    for i, t in enumerate(rows):
        comp[i] = next((k for k in range(i) if grams(rows[k]) == grams(t)), i)
    for _ in rows:
        for a, b in pairs_of(rows):
            comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: comp[c] for i, c in comp.items()}


def test_components_in_many_tiles(spark, small_tiles):
    rows = texts(5, 15)
    assert {x.doc_id: x.component for x in similarity.near_neighbour_components(docs(spark, rows)).collect()} == components(rows)


def test_no_split_holds_a_neighbour_of_another_in_many_tiles(spark, small_tiles):
    rows = texts(6, 15)
    got = {x.doc_id: (x.component, x.split) for x in repairs.near_neighbour_free_split(docs(spark, rows)).collect()}
    assert {i: c for i, (c, _) in got.items()} == components(rows) and all(got[a][1] == got[b][1] for a, b in pairs_of(rows))
