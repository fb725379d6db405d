"""The best reference of each query among texts, scanned in place or in blocks, against plain sets; no set of a reference is written."""

import math
import random
from collections import Counter

import pytest

from recordmill import session
from recordmill.operators import similarity as M
from tests.test_neighbours import grams, texts


@pytest.mark.parametrize("case", ["one block", "rare grams joined", "many blocks"])
def test_best_texts_equal_plain_scores(spark, monkeypatch, case):
    from pyspark.sql import functions as F

    r, refs = random.Random(3), texts(7, 20)
    r.shuffle(refs)
    asked = [t[: len(t) // 2 + 1] for t in refs[::5]] + ["", "nothing of it"]
    if case == "rare grams joined":
        monkeypatch.setattr(M, "KNOWN_GRAMS", 300)
    if case == "many blocks":
        monkeypatch.setattr(M, "QUERY_BLOCK", 7)
        monkeypatch.setattr(M, "REF_BLOCK", 16)
    df = lambda rows, at: spark.createDataFrame([(at + i, " ".join(t.split())) for i, t in enumerate(rows)], "id long, text string")
    q = M.gram_sets(df(asked, 0), "id", F.col("text"))
    own, sets = [grams(t) for t in asked], [grams(t) for t in refs]
    had = len(session._stored)
    jaccard = {x.id: (x.best, x.jaccard) for x in M.best_jaccard(q, df(refs, 1000)).collect()}
    assert len(session._stored) == had
    cosine = {x.id: (x.best, x.cosine) for x in M.tfidf_top1(q, df(refs, 1000)).collect()}
    n = Counter(g for s in sets for g in s)
    w = {g: math.log((1 + len(refs)) / (1 + k)) + 1 for g, k in n.items()}
    size = lambda s: math.sqrt(sum(w[g] ** 2 for g in s if g in w))
    for i, s in enumerate(own):
        j = max(((round(len(s & x) / len(s | x), 9), -1000 - k) for k, x in enumerate(sets) if s & x), default=(0.0, None))
        assert jaccard[i] == (j[1] and -j[1], j[0])
        c = {1000 + k: sum(w[g] ** 2 for g in s & x) / size(s) / size(x) for k, x in enumerate(sets) if s & x}
        assert abs(cosine[i][1] - max(c.values(), default=0)) < 2e-6 and (cosine[i][0] is None) == (not c) and (not c or c[cosine[i][0]] > max(c.values()) - 2e-6)


def test_the_queries_on_texts_write_no_sets(spark, tmp_path):
    import os

    from recordmill.plans import building, similarity

    documents = spark.createDataFrame([(i, t, f"src{i % 3}") for i, t in enumerate(texts(8, 60))], "doc_id long, text string, source string")
    benchmark = spark.createDataFrame([(0, texts(8, 60)[9])], "item_id long, text string")
    size = lambda p: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(p.removeprefix("file:")) for f in names if f.endswith(".parquet"))
    sets = 8 * sum(len(grams(t)) for t in texts(8, 60))
    for query in (similarity.jaccard_pair_max, building.retrieval_baseline):
        had = len(session._stored)
        x = query(benchmark, documents).collect()
        assert x[0].best == min(i for i, t in enumerate(texts(8, 60)) if grams(t) == grams(texts(8, 60)[9])) and sum(map(size, session._stored[had:])) < sets / 2
