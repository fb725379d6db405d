"""The near-dedup stage against all pairs around its threshold."""

import random

from recordmill.llm import simhash
from tests.llm.cases import docs


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def kept(texts):
    """Of each component of pairs at 0.8 or more, the least number."""
    sets, comp = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return [i for i in range(len(texts)) if root(i) == i]


def test_near_dedup_equals_all_pairs_around_the_threshold(spark, monkeypatch):
    r, texts, between = random.Random(11), [], 0
    word = lambda: f"w{r.randrange(10**6)}"
    for i in range(120):
        base = [word() for _ in range(r.choice((30, 120, 250)))]
        swap, at = round(len(base) * (0.05 + 0.13 * i / 120)), r.randrange(len(base) // 2)
        other = base[:at] + [word() for _ in range(swap)] + base[at + swap :]
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        between += 0.7 <= len(a & b) / len(a | b) <= 0.9
        texts += [" ".join(base), " ".join(other)]
    line = "all rights are held by those who hold them and by none of the others"
    texts += ["\n".join([" ".join(word() for _ in range(60)), *[line] * 200]) for _ in range(3)]  # one line many times, the rest different
    texts += ["a b c d e f g h", "A b c d e f g h i", "a b c d", "a b c d", "x y"]
    base = [word() for _ in range(100)]
    texts += [" ".join(base[:k] + [word()] + base[k + 1 :]) for k in range(0, 100, 4)]  # a group over several tiles
    monkeypatch.setattr(simhash.exact_links, "__defaults__", (8,))
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    r.shuffle(rows)
    got = sorted(x.doc_id for x in simhash.one_of_each_group(docs(spark, rows)).collect())
    assert got == kept(texts) and between > 60


def test_only_sets_of_like_size_are_compared(spark):
    sizes = [(100, 79), (100, 80), (5, 4), (1, 1), (20_000, 16_000), (20_000, 12_000), (300, 3000)]
    rows = [(2 * k + side, n, k, k, k, k) for k, pair in enumerate(sizes) for side, n in enumerate(pair)]
    distinct = spark.createDataFrame(rows, "rep long, n long, w0 long, w1 long, w2 long, w3 long")
    got = {(min(x), max(x)) for x in simhash.links(distinct, 4, 0, similarity=0.8).collect()}
    must = {(2 * k, 2 * k + 1) for k, pair in enumerate(sizes) if min(pair) >= 0.8 * max(pair)}
    assert must <= got and not got & {(10, 11), (12, 13)}
    assert len({min(x) for x in simhash.links(distinct, 4, 0).collect()}) == len(sizes)
