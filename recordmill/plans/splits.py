"""Leakage-free splits."""

from __future__ import annotations


from pyspark.sql import functions as F

from recordmill.functions import text as X
from recordmill.operators import splits as P
from recordmill.operators.allocation import deficit_split
from recordmill.operators.joins import provenance_components
from recordmill.operators.ranking import first_of_each
from recordmill.plans.record_joins import NORM
from recordmill.plans.registry import query
from recordmill.session import checkpoint

BUCKET = "CAST('0x' || substr(sha256('split:' || {}), 1, 8) AS BIGINT) % 10000"
SPLIT = "CASE WHEN {b} < 8000 THEN 'train' WHEN {b} < 9000 THEN 'validation' WHEN {b} < 10000 THEN 'test' ELSE 'test' END"
BY_SOURCE = SPLIT.format(b=BUCKET.format("conv_id"))
BY_DOC = SPLIT.format(b=BUCKET.format("doc_id"))


@query(f"SELECT conv_id, turn, {BY_SOURCE} AS split FROM conversations")
def hash_bucket_split(conversations):
    """All turns of a conversation fall together."""
    return conversations.select("conv_id", "turn", P.hash_split(F.col("conv_id")).alias("split"))


@query()
def greedy_component_split(documents):
    """Provenance components dealt to splits; components with a Spanish text are out of distribution. Invariants are tested."""
    norm = X.collapse_blanks(F.lower("text"))
    comps = provenance_components(documents, "doc_id", [F.sha2(norm, 256), F.sha2(F.substring(norm, 1, 60), 256)])
    rows = documents.select("doc_id", "lang").join(comps, F.col("doc_id") == F.col("id"))
    split = P.greedy_split(P.sizes(rows, "component", F.col("lang") == "es"), "component")
    return rows.join(split, "component").select("doc_id", "component", "split")


@query()
def deficit_component_split(documents):
    """Provenance components dealt by what splits lack of rows, sources and languages; components with a Spanish text are out of distribution. Held against a plain fold in the tests."""
    norm = X.collapse_blanks(F.lower("text"))
    comps = provenance_components(documents, "doc_id", [F.sha2(norm, 256), F.sha2(F.substring(norm, 1, 60), 256)])
    rows = checkpoint(documents.select("doc_id", F.col("source").alias("task"), F.col("lang").alias("label")).join(comps, F.col("doc_id") == F.col("id")))
    cells = rows.groupBy("component", "task", "label").agg(F.count(F.lit(1)).alias("n"))
    split = deficit_split(cells, rows.where(F.col("label") == "es").select("component"))
    return rows.join(split, "component").select("doc_id", "component", "split")


@query("""
WITH g AS (SELECT source, min(lang) AS label, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n, source) AS p, count(*) OVER (PARTITION BY label) AS k FROM g)
SELECT source, label, n, CASE WHEN k <= 2 THEN 'train' WHEN p = 1 THEN 'validation' WHEN p = 2 THEN 'test' ELSE 'train' END AS split FROM r""")
def template_holdout(documents):
    return P.template_holdout(documents, "source", "lang")


EARLIEST = f"(SELECT doc_id, sha256({NORM}) AS sig, list_position(['train', 'validation', 'test'], {BY_DOC}) AS place, {BY_DOC} AS split FROM documents)"


@query(f"SELECT doc_id, split, place = min(place) OVER (PARTITION BY sig) AS kept FROM {EARLIEST}")
def exact_content_repair(documents):
    rows = documents.select("doc_id", F.sha2(X.collapse_blanks(F.lower("text")), 256).alias("sig"), P.hash_split(F.col("doc_id")).alias("split"))
    return P.earliest_split(rows, "sig", "split", ("train", "validation", "test")).select("doc_id", "split", "kept")


@query(f"""
SELECT min(doc_id) AS surface, lang, count(*) AS n FROM documents GROUP BY lang, sha256({NORM}) HAVING count(*) > 1""")
def strict_surface_grouping(documents):
    g = documents.groupBy("lang", F.sha2(X.collapse_blanks(F.lower("text")), 256).alias("k")).agg(F.min("doc_id").alias("surface"), F.count(F.lit(1)).alias("n"))
    return g.where("n > 1").select("surface", "lang", "n")


@query("SELECT event_id, coalesce(nullif(event_type, 'click'), json_extract_string(props, '$.k'), CAST(user_id AS VARCHAR)) AS source_group FROM events")
def source_group_key(events):
    """The first provenance key that is there."""
    return events.select("event_id", F.coalesce(F.nullif("event_type", F.lit("click")), F.get_json_object("props", "$.k"), F.col("user_id").cast("string")).alias("source_group"))


@query("""
WITH r AS (SELECT c_custkey, c_nationkey, n_regionkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, fold, CASE WHEN fold = 'within' THEN CASE WHEN k <= 48 THEN 'train' ELSE 'test' END WHEN fold = 'cross_' || n_regionkey THEN 'test' ELSE 'train' END AS part FROM r, (SELECT unnest(['cross_0', 'cross_1', 'within']) AS fold)""")
def jurisdiction_folds(customer, nation):
    """Two folds that leave a jurisdiction out, and one within: the first 48 rows of each rule train. A task keeps 48 rows a rule before any rows meet; those are joined back to the table."""
    first = first_of_each(customer.select("c_nationkey", "c_custkey"), ["c_nationkey"], [F.col("c_custkey")], 48, "k").select("c_custkey", "k")
    r = customer.select("c_custkey", "c_nationkey").join(nation.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).join(first, "c_custkey", "left")
    f = r.withColumn("fold", F.explode(F.array(*map(F.lit, ("cross_0", "cross_1", "within")))))
    part = F.when(F.col("fold") == "within", F.when(F.col("k").isNotNull(), "train").otherwise("test")).when(F.col("fold") == F.concat(F.lit("cross_"), F.col("n_regionkey")), "test").otherwise("train")
    return f.select("c_custkey", "fold", part.alias("part"))


@query(f"""
WITH c AS (SELECT {BY_DOC} AS split, lang, count(*) AS n FROM documents GROUP BY 1, 2), s AS (SELECT split, sum(n) AS ns FROM c GROUP BY 1), l AS (SELECT lang, sum(n) AS nl, (SELECT sum(n) FROM c) AS t FROM c GROUP BY 1)
SELECT split, round(sum(pow(coalesce(n, 0) / ns - nl / t, 2)), 9) AS loss FROM s CROSS JOIN l LEFT JOIN c USING (split, lang) GROUP BY 1""")
def distribution_loss(documents):
    return P.distribution_loss(documents.select("lang", P.hash_split(F.col("doc_id")).alias("split")), "split", "lang")


@query("""
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), g AS (SELECT source, round(max(n) / sum(n), 6) AS purity, sum(n)::BIGINT AS n FROM c GROUP BY 1)
SELECT source, purity, n, CASE WHEN sum(n) OVER (ORDER BY purity DESC, source) - n < 0.2 * sum(n) OVER () THEN 'test' ELSE 'train' END AS split FROM g""")
def proxy_stress_split(documents):
    """The groups whose label is easiest to guess make the test set, up to a fifth of the rows."""
    g = documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.round(F.max("n") / F.sum("n"), 6).alias("purity"), F.sum("n").alias("n"))
    return P.proxy_stress(g, "purity", "n", "source").select("source", "purity", "n", "split")


@query(f"""
WITH s AS (SELECT sha256({NORM}) AS sig, {BY_DOC} AS split FROM documents), g AS (SELECT sig, count(DISTINCT split) AS k, count(*) AS n FROM s GROUP BY 1)
SELECT count(*) AS signatures, count(*) FILTER (k > 1) AS leaking, coalesce(sum(n) FILTER (k > 1), 0)::BIGINT AS leaking_rows FROM g""")
def leakage_counts(documents):
    s = documents.select(F.sha2(X.collapse_blanks(F.lower("text")), 256).alias("sig"), P.hash_split(F.col("doc_id")).alias("split"))
    g = s.groupBy("sig").agg(F.count_distinct("split").alias("k"), F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("signatures"), F.count_if(F.col("k") > 1).alias("leaking"), F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("n"))), F.lit(0)).alias("leaking_rows"))
