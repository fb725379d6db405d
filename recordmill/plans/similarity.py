"""Similarity joins of records with records and with held-out passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordmill.functions import text as X
from recordmill.operators import similarity as M
from recordmill.operators.components import connected_components
from recordmill.plans.record_joins import NORM
from recordmill.plans.registry import query
from recordmill.session import checkpoint, stored

THRESHOLD = 0.85
GRAMS = "(SELECT {id} AS id, unnest(list_distinct(list_transform(range(1, greatest(length(t) - 4, 1) + 1), lambda i: substr(t, i, 5)))) AS g FROM (SELECT {id}, {norm} AS t FROM {table}))"
DOCS = f"(SELECT min(doc_id) AS doc_id, {NORM} AS text FROM documents GROUP BY 2)"
PAIRS = f"""
WITH g AS {GRAMS.format(id='doc_id', norm='text', table=DOCS)}, n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
j AS (SELECT a, b, c / (x.n + y.n - c) AS jaccard FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c / (x.n + y.n - c) >= {THRESHOLD})"""


def _sets(documents):
    return M.texts_of(documents, "doc_id", X.collapse_blanks(F.lower("text")))


@query(f"{PAIRS} SELECT a, b, round(jaccard, 9) AS jaccard FROM j WHERE jaccard < 1")
def jaccard_prefix_join(documents):
    """Exact pairs of different gram sets at 0.85 or more, by filters on sizes and bitmaps that lose none."""
    pairs, _ = M.jaccard_join(_sets(documents), THRESHOLD)
    return pairs


@query(f"""{PAIRS.replace('WITH', 'WITH RECURSIVE', 1)},
s AS (SELECT a, b FROM j UNION SELECT b, a FROM j), r AS (SELECT id, id AS c FROM n UNION SELECT s.b, r.c FROM r JOIN s ON s.a = r.id), m AS (SELECT id, min(c) AS c FROM r GROUP BY 1)
SELECT d.doc_id, m.c AS component FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {NORM}) AS rep FROM documents) d JOIN m ON m.id = d.rep""")
def near_neighbour_components(documents):
    """Each document with its component under exact Jaccard 0.85."""
    pairs, members = M.jaccard_join(_sets(documents), THRESHOLD)
    comps = connected_components(checkpoint(pairs), "a", "b")
    return members.join(comps, F.col("rep") == F.col("node"), "left").select(F.col("id").alias("doc_id"), F.coalesce("component", "rep").alias("component"))


@query()
def minhash_lsh_neighbours(documents):
    """Neighbours found by MinHash bands and verified at 0.85: pairs of representatives of equal gram sets, and each other member with its representative. Recall is
    measured against the exact join in the tests."""
    pairs, members = M.lsh_neighbours(_sets(documents), THRESHOLD)
    return pairs.union(members.where("id <> rep").select("rep", "id", F.lit(1.0)))


BENCH = GRAMS.format(id="item_id", norm=NORM, table="benchmark")


@query(f"""
WITH q AS {BENCH}, r AS {GRAMS.format(id='doc_id', norm=NORM, table='documents')}, nq AS (SELECT id, count(*) AS n FROM q GROUP BY 1), nr AS (SELECT id, count(*) AS n FROM r GROUP BY 1),
h AS (SELECT q.id, r.id AS ref, count(*) AS c FROM q JOIN r USING (g) GROUP BY 1, 2), j AS (SELECT h.id, ref, round(c / (nq.n + nr.n - c), 9) AS j FROM h JOIN nq ON nq.id = h.id JOIN nr ON nr.id = ref),
t AS (SELECT id, arg_max(ref, (j, -ref)) AS best, max(j) AS jaccard FROM j GROUP BY 1)
SELECT nq.id, best, coalesce(jaccard, 0.0) AS jaccard FROM nq LEFT JOIN t USING (id)""")
def jaccard_pair_max(benchmark, documents):
    """The most similar document of each held-out passage."""
    return M.best_jaccard(stored(M.gram_sets(benchmark, "item_id", X.collapse_blanks(F.lower("text"))), "queries"), _sets(documents))


TFIDF_SQL = f"""
WITH q AS {BENCH}, r AS {GRAMS.format(id='doc_id', norm=NORM, table='documents')}, N AS (SELECT count(*) AS n FROM documents),
w AS (SELECT g, ln((1 + (SELECT n FROM N)) / (1 + count(*))) + 1 AS w FROM r GROUP BY 1), rw AS (SELECT * FROM r JOIN w USING (g)), qw AS (SELECT * FROM q JOIN w USING (g)),
d AS (SELECT qw.id, rw.id AS ref, sum(qw.w * rw.w) AS dot FROM qw JOIN rw USING (g) GROUP BY 1, 2), nq AS (SELECT id, sqrt(sum(w * w)) AS l FROM qw GROUP BY 1), nr AS (SELECT id, sqrt(sum(w * w)) AS l FROM rw GROUP BY 1),
c AS (SELECT d.id, ref, round(dot / nq.l / nr.l, 6) AS c FROM d JOIN nq ON nq.id = d.id JOIN nr ON nr.id = ref), t AS (SELECT id, arg_max(ref, (c, -ref)) AS best, max(c) AS cosine FROM c GROUP BY 1)
SELECT i.item_id AS id, best, coalesce(cosine, 0.0) AS cosine FROM benchmark i LEFT JOIN t ON t.id = i.item_id"""


@query(TFIDF_SQL)
def tfidf_cosine_top1(benchmark, documents):
    """The nearest document of each held-out passage by TF-IDF, among all documents."""
    norm = X.collapse_blanks(F.lower("text"))
    return M.tfidf_top1(stored(M.gram_sets(benchmark, "item_id", norm), "queries"), _sets(documents))


@query("""
WITH q AS (SELECT vec_id AS id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0), r AS (SELECT vec_id AS ref, embedding AS u FROM embeddings),
c AS (SELECT id, ref, round(list_cosine_similarity(v::DOUBLE[], u::DOUBLE[]), 9) AS c FROM q, r WHERE ref <> id)
SELECT id, arg_max(ref, (c, -ref)) AS best, round(max(c), 6) AS cosine FROM c GROUP BY 1""")
def embedding_top1(embeddings):
    """The nearest other vector of every query vector (ids divisible by 20) among all vectors but itself."""
    e = embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return M.dense_top1(e.where("id % 20 = 0"), e).select("id", "best", F.round("cosine", 6).alias("cosine"))


@query(f"""
SELECT g, count(*) AS df, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1, 6) AS idf FROM {GRAMS.format(id='doc_id', norm=NORM, table='documents')} GROUP BY 1 ORDER BY df DESC, g LIMIT 100""")
def document_frequency(documents):
    """The hundred most common grams with their smoothed inverse document frequency."""
    total = documents.agg(F.count(F.lit(1)).alias("N"))
    df = M.gram_counts(_sets(documents.where("text IS NOT NULL"))).orderBy(F.desc("df"), "g").limit(100)
    return df.join(F.broadcast(total)).select("g", "df", F.round(F.log((1 + F.col("N")) / (1 + F.col("df"))) + 1, 6).alias("idf"))


@query(f"""
WITH s AS (SELECT doc_id, lang, source = 'src1' AS side, row_number() OVER (PARTITION BY lang, source = 'src1' ORDER BY sha256('block:' || doc_id)) AS r, {NORM} AS text FROM documents),
g AS (SELECT s.lang, s.side, x.id, x.g FROM (SELECT doc_id AS id, unnest(list_distinct(list_transform(range(1, greatest(length(text) - 4, 1) + 1), lambda i: substr(text, i, 5)))) AS g FROM s WHERE r <= 200) x JOIN s ON s.doc_id = x.id),
n AS (SELECT id, count(*) AS n FROM g GROUP BY 1), p AS (SELECT a.lang, a.id AS a, b.id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.lang = b.lang AND a.side AND NOT b.side GROUP BY 1, 2, 3)
SELECT lang, round(max(c / (x.n + y.n - c)), 9) AS jaccard FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b GROUP BY 1""")
def blocked_sample_cross(documents):
    """The greatest similarity between samples of 200 rows of either side, within each language (a sampling operator)."""
    from recordmill.operators.ranking import first_of_each, hash_rank

    s = first_of_each(documents.withColumn("side", F.col("source") == "src1"), ["lang", "side"], [hash_rank("block", F.col("doc_id"))], 200)
    sets = M.gram_sets(s, "doc_id", X.collapse_blanks(F.lower("text"))).join(s.select(F.col("doc_id").alias("id"), "lang", "side"), "id")
    g = sets.select("lang", "side", "id", "n", F.explode("grams").alias("g"))
    a, b = g.where("side").select("lang", "g", F.col("id").alias("a"), F.col("n").alias("na")), g.where("NOT side").select("lang", "g", F.col("id").alias("b"), F.col("n").alias("nb"))
    p = a.join(b, ["lang", "g"]).groupBy("lang", "a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    return p.groupBy("lang").agg(F.round(F.max(F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))), 9).alias("jaccard"))
