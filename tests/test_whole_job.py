"""Queries do the whole job, against plain loops over every row."""

import hashlib
import math
import random

import numpy as np
import pytest

from recordmill.operators import joins as J
from recordmill.plans import building, similarity, splits, state_queries


def test_embedding_top1_searches_all_other_vectors(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 8))
    v[20] = v[0] + 0.01  # the nearest vector of a query is a query
    got = {x.id: x.best for x in similarity.embedding_top1(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = np.round(u @ u.T, 9)
    np.fill_diagonal(cos, -np.inf)
    assert got == {q: int(cos[q].argmax()) for q in (0, 20, 40)} and got[0] == 20 and got[20] == 0
    assert similarity.embedding_top1(spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<double>")).count() == 0


def test_tfidf_searches_documents_of_every_language(spark):
    docs = [(1, "the river runs past the old mill", "en", "a"), (2, "der alte mann geht in den wald", "de", "b"), (3, "el viejo molino junto al rio", "es", "c"), (4, "un chat dort sur la table", None, "d"), (5, "the old mill by the river", "en", "e")]
    items = [(10, "past the old mill"), (11, "geht in den wald"), (12, "dort sur la table"), (13, "el viejo molino"), (14, "@@@@@@@")]
    grams = lambda t: {t[k : k + 5] for k in range(max(1, len(t) - 4))}
    refs = {i: grams(t) for i, t, *_ in docs}
    w = {g: math.log((1 + len(refs)) / (1 + sum(g in r for r in refs.values()))) + 1 for r in refs.values() for g in r}
    length = lambda s: math.sqrt(sum(w[g] ** 2 for g in s))
    want = {}
    for i, t in items:
        own = grams(t) & set(w)
        c, best = max(((round(sum(w[g] ** 2 for g in own & r) / length(own) / length(r), 6), -k) for k, r in refs.items() if own & r), default=(0.0, None))
        want[i] = (best and -best, c)
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    assert {x.id: (x.best, x.cosine) for x in similarity.tfidf_cosine_top1(b, d).collect()} == want
    answers = {i: s for i, _, _, s in docs}
    assert {x.id: (x.best, x.cosine, x.answer) for x in building.retrieval_baseline(b, d).collect()} == {i: (k, c, answers.get(k)) for i, (k, c) in want.items()}
    assert {k for k, _ in want.values()} == {1, 2, 3, 4, None}


def greedy(wanted, offered):
    """Of each group the closest free pair, least ids among equals, until none is left."""
    pairs = sorted((abs(w[1] - o[1]), w[2], o[2]) for w in wanted for o in offered if w[0] == o[0])
    found, used = {}, set()
    for _, w, o in pairs:
        if w not in found and o not in used:
            found[w] = o
            used.add(o)
    return found


def test_nearest_unused_settles_every_tie(spark):
    r = random.Random(8)
    wanted = [("a", 5.0, i) for i in range(260)] + [("b", 1.0, 1000 + i) for i in range(230)] + [(g, float(r.randrange(5)), 2000 + i) for i in range(60) for g in [r.choice("cd")]]
    offered = [("a", 5.0, 5000 + i) for i in range(250)] + [("b", 2.0, 6000 + i) for i in range(240)] + [(g, float(r.randrange(5)), 7000 + i) for i in range(50) for g in [r.choice("cd")]]
    r.shuffle(wanted)
    frames = [spark.createDataFrame(x, "g string, v double, id long") for x in (wanted, offered)]
    got = {x.w: x.o for x in J.nearest_unused(*frames, ["g"], "v", "id").collect()}
    assert got == greedy(wanted, offered) and sum(w < 1000 for w in got) == 250 and sum(1000 <= w < 2000 for w in got) == 230
    with pytest.raises(RuntimeError):
        J.nearest_unused(*frames, ["g"], "v", "id", rounds=1)


def test_views_hold_whole_texts(spark):
    text = "a text of more than forty characters, which all belong to its view"
    x = state_queries.text_views_and_masks(spark.createDataFrame([(1, text, "en", "a")], "doc_id long, text string, lang string, source string")).first()
    assert x.view == f"lang: en\nsource: a\ntext: {text}"


def test_folds_train_on_48_rows_of_a_rule(spark):
    customers = spark.createDataFrame([(i, i % 2) for i in range(120)], "c_custkey long, c_nationkey long")
    nations = spark.createDataFrame([(0, 0), (1, 1)], "n_nationkey long, n_regionkey long")
    rows = splits.jurisdiction_folds(customers, nations).where("fold = 'within'").collect()
    assert {x.c_custkey for x in rows if x.part == "train"} == set(range(96)) and len(rows) == 120


def test_blocked_samples_hold_200_rows(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("abcdef") for _ in range(30)) for _ in range(100)]
    docs = [(2 * i + k, t[:27] + "xyz" if k else t, "en", f"src{k}") for i, t in enumerate(texts) for k in (0, 1)]
    # the one equal pair stands behind the first twenty rows of either side
    order = sorted((i for i, *_, s in docs if s == "src1"), key=lambda i: hashlib.sha256(f"block:{i}".encode()).hexdigest())
    last = order[-1]
    docs = [(i, "the same text in both" if i in (last, last - 1) else t, "en", s) for i, t, _, s in docs]
    x = similarity.blocked_sample_cross(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()
    assert [(y.lang, y.jaccard) for y in x] == [("en", 1.0)]
