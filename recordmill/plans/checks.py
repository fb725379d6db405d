"""Validation of records, links, denominators and recomputed truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordmill.functions import text as X
from recordmill.operators import validation as V
from recordmill.plans.registry import query


@query("""
SELECT doc_id, concat_ws(',', CASE WHEN n_chars <> length(text) THEN 'count' END, CASE WHEN lang NOT IN ('de', 'en', 'fr') THEN 'lang' END, CASE WHEN NOT regexp_matches(source, '^src[0-9]$') THEN 'source' END) AS codes FROM documents
WHERE n_chars <> length(text) OR lang NOT IN ('de', 'en', 'fr') OR NOT regexp_matches(source, '^src[0-9]$')""")
def schema_violations(documents):
    """Required fields, enumerations and patterns, with the failing codes in order."""
    return V.violations(documents, ["doc_id"], {"count": F.col("n_chars") == F.length("text"), "lang": F.col("lang").isin("de", "en", "fr"), "source": F.col("source").rlike("^src[0-9]$")})


@query("""
SELECT count(*) FILTER (o_totalprice <= 0) AS price, count(*) FILTER (o_orderstatus NOT IN ('O', 'F', 'P')) AS status_value, count(*) FILTER (o_orderdate < TIMESTAMP '1992-06-01') AS dates, CASE WHEN count(*) FILTER (o_totalprice <= 0 OR o_orderstatus NOT IN ('O', 'F', 'P') OR o_orderdate < TIMESTAMP '1992-06-01') = 0 THEN 'pass' ELSE 'fail' END AS status FROM orders""")
def gate_counts(orders):
    return V.gates(orders, {"price": F.col("o_totalprice") > 0, "status_value": F.col("o_orderstatus").isin("O", "F", "P"), "dates": F.col("o_orderdate") >= F.lit("1992-06-01").cast("timestamp_ntz")})


@query("""
SELECT o_orderkey, round(o_totalprice, 2) AS stated, round(sum(l_extendedprice), 2) AS mirrored, count(l_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING round(o_totalprice, 2) <> round(sum(l_extendedprice), 2)""")
def mirror_mismatch(orders, lineitem):
    j = orders.join(lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", F.round("o_totalprice", 2).alias("stated")).agg(F.round(F.sum("l_extendedprice"), 2).alias("mirrored"), F.count(F.lit(1)).alias("n"))
    return j.where("stated <> mirrored")


@query("""
SELECT doc_id, CASE WHEN contains(t, 'moron') OR contains(t, 'disgusting') OR contains(t, 'loser') THEN 1 ELSE 0 END AS recomputed, toxic AS stated, CASE WHEN contains(t, 'moron') OR contains(t, 'disgusting') OR contains(t, 'loser') THEN 1 ELSE 0 END <> toxic AS contradicts FROM (SELECT doc_id, lower(text) AS t, toxic FROM documents JOIN labels USING (doc_id))""")
def semantic_label_check(documents, labels):
    """A label recomputed from the text against the stated one."""
    low = F.lower("text")
    again = F.when(F.contains(low, F.lit("moron")) | F.contains(low, F.lit("disgusting")) | F.contains(low, F.lit("loser")), 1).otherwise(0)
    return documents.join(labels, "doc_id").select("doc_id", again.alias("recomputed"), F.col("toxic").alias("stated"), (again != F.col("toxic")).alias("contradicts"))


@query("""
SELECT conv_id, turn, contains(trim(regexp_replace(replace(lower(text), '_', ' '), '[ \\t\\n\\r]+', ' ', 'g')), lower(role)) AS leaks FROM conversations""")
def target_leakage(conversations):
    """Whether the target stands in the exposed text."""
    return conversations.select("conv_id", "turn", X.leaks(F.col("role"), F.col("text")).alias("leaks"))


@query("""
SELECT d.doc_id, i.item_id FROM documents d JOIN benchmark i ON contains(trim(regexp_replace(replace(lower(d.text), '_', ' '), '[ \\t\\n\\r]+', ' ', 'g')), trim(regexp_replace(replace(lower(i.text), '_', ' '), '[ \\t\\n\\r]+', ' ', 'g')))""")
def leak_containment(documents, benchmark):
    """Documents that hold a whole held-out passage.

    A passage may start and end inside a word of the document, so its words but the first and last are whole: a passage is keyed by the hash of its second
    to ninth words, or of all its inner words if it has fewer, or of its first characters (five at most) if it has none. Documents give only pairs of id and hash for keys of those
    lengths; texts come in once for each candidate, and the whole is verified.
    """
    plain = lambda c: X.collapse_blanks(F.translate(F.lower(c), "_", " "))
    hashed = lambda kind, x: F.xxhash64(F.lit(kind), x)
    b = benchmark.select("item_id", plain("text").alias("passage")).where("passage <> ''").withColumn("w", F.split("passage", " "))
    inner = F.least(F.lit(8), F.size("w") - 2)
    words = F.when(inner > 0, hashed("w", F.array_join(F.slice("w", F.lit(2), F.greatest(inner, F.lit(1))), " ")))
    keyed = b.select("item_id", F.coalesce(words, hashed("c", F.substring("passage", 1, 5))).alias("h"), F.when(inner > 0, inner).otherwise(-F.least(F.lit(5), F.length("passage"))).alias("size"))
    lengths = sorted(r["size"] for r in keyed.select("size").distinct().collect())  # 13 at most
    d = documents.select("doc_id", plain("text").alias("t")).withColumn("w", F.split("t", " "))
    empty = F.array().cast("array<bigint>")
    each = lambda last, of: F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), of)).otherwise(empty)
    run = lambda n: lambda i: hashed("w", F.array_join(F.slice("w", i, F.lit(n)), " ")) if n > 0 else hashed("c", F.substring("t", i, F.lit(-n)))
    keys = [each((F.size("w") if n > 0 else F.length("t")) - abs(n) + 1, run(n)) for n in lengths]
    runs = d.select("doc_id", F.explode(F.array_distinct(F.concat(*keys) if keys else empty)).alias("h"))
    candidates = runs.join(keyed.select("item_id", "h"), "h").select("doc_id", "item_id").distinct()
    found = candidates.join(b.select("item_id", "passage"), "item_id").join(d.select("doc_id", "t"), "doc_id")
    return found.where(F.contains("t", "passage")).select("doc_id", "item_id").distinct()


@query("""
WITH l AS (SELECT o_orderkey, o_orderstatus, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS has_r, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS has_a, count(DISTINCT l_suppkey) AS tools FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT o_orderstatus, count(*) AS n, sum(has_r)::BIGINT AS verified, sum(has_a)::BIGINT AS approved, count(*) FILTER (tools >= 2) AS tooled FROM l GROUP BY 1""")
def action_level_audit(orders, lineitem):
    per = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("r"), F.max(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).alias("a"), F.count_distinct("l_suppkey").alias("t"))
    return orders.join(per, "o_orderkey").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("verified"), F.sum("a").alias("approved"), F.count_if(F.col("t") >= 2).alias("tooled"))


@query("""
WITH s AS (SELECT o_custkey AS k, count(*)::DOUBLE + CASE WHEN o_custkey % 50 = 0 THEN 1 ELSE 0 END AS v FROM orders GROUP BY 1), r AS (SELECT o_custkey AS k, count(*)::DOUBLE AS v FROM orders WHERE o_custkey % 77 <> 0 GROUP BY 1)
SELECT k, round(s.v, 6) AS stored, round(r.v, 6) AS recomputed, s.v IS NOT DISTINCT FROM r.v AS equal FROM s FULL JOIN r USING (k)""")
def truth_replay(orders):
    n = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return V.replay(n.withColumn("v", F.col("v") + F.when(F.col("k") % 50 == 0, 1).otherwise(0)), n.where("k % 77 <> 0"), ["k"], "v")


@query("""
SELECT s_suppkey, concat_ws(',', CASE WHEN n_nationkey IS NULL THEN 'dangling' END, CASE WHEN n > 1 THEN 'repeated' END) AS codes FROM (SELECT s_suppkey, s_nationkey + CASE WHEN s_suppkey % 10 = 0 THEN 100 ELSE 0 END AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) LEFT JOIN nation ON n_nationkey = k WHERE n_nationkey IS NULL OR n > 1""")
def rule_link_errors(supplier, nation):
    n = supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    s = supplier.join(n, "s_nationkey").withColumn("k", F.col("s_nationkey") + F.when(F.col("s_suppkey") % 10 == 0, 100).otherwise(0))
    j = s.join(nation, F.col("k") == F.col("n_nationkey"), "left")
    return V.violations(j, ["s_suppkey"], {"dangling": F.col("n_nationkey").isNotNull(), "repeated": F.col("n") <= 1})


@query("""
SELECT (SELECT count(*) FROM part) AS expected, count(DISTINCT l_partkey) AS attempted, count(DISTINCT l_partkey) FILTER (l_returnflag = 'N') AS released, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) AS never_attempted FROM lineitem""")
def denominator_audit(part, lineitem):
    """Expected, attempted and released identity sets, from one row a key."""
    a = lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.lit(1).alias("t"), F.max(F.when(F.col("l_returnflag") == "N", 1).otherwise(0)).alias("r"))
    j = part.select("p_partkey", F.lit(1).alias("e")).join(a, "p_partkey", "full_outer")
    return j.agg(F.count("e").alias("expected"), F.count("t").alias("attempted"), F.count_if(F.col("r") == 1).alias("released"), F.count_if(F.col("t").isNull()).alias("never_attempted"))


@query("""
SELECT vec_id, len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS finite, len(list_filter(embedding, lambda x: x < 0)) = 0 AS nonnegative, abs(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) - 1) < 0.001 AS sums_to_one FROM embeddings""")
def probability_validity(embeddings):
    """Finite, not negative, and squares that sum to one."""
    e = F.col("embedding")
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return embeddings.select("vec_id", F.forall(e, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))).alias("finite"), F.forall(e, lambda x: x >= 0).alias("nonnegative"), (F.abs(total - 1) < 0.001).alias("sums_to_one"))


@query("""
SELECT l_orderkey, l_linenumber, abs(l_tax - l_discount) <= 0.03 AS within FROM lineitem WHERE NOT (abs(l_tax - l_discount) <= 0.03)""")
def tolerance_errors(lineitem):
    ok = V.tolerance(F.col("l_tax"), F.col("l_discount"), F.lit(0.03))
    return lineitem.select("l_orderkey", "l_linenumber", ok.alias("within")).where(~ok)


@query("""
WITH c AS (SELECT source AS artifact, doc_id // 1000 AS chunk, count(*) AS n, sha256(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS h FROM documents GROUP BY 1, 2),
m AS (SELECT artifact, sum(n)::BIGINT AS n, sha256(string_agg(h, ',' ORDER BY chunk)) AS sha FROM c GROUP BY 1)
SELECT artifact, n, sha, sha = CASE WHEN artifact = 'src5' THEN 'stale' ELSE sha END AS bound FROM m""")
def hash_binding_gate(documents):
    """The hash of each artifact's ids in order against a manifest: chunks of a thousand ids are hashed first, then chunks of a thousand hashes, until one is left."""
    m = V.ordered_digests(documents.select(F.col("source").alias("artifact"), "doc_id"), "artifact", "doc_id")
    return m.withColumn("bound", F.col("sha") == F.when(F.col("artifact") == "src5", "stale").otherwise(F.col("sha")))


@query("""
SELECT role, count(*) AS n, round(avg(CASE WHEN d.doc_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS grounded, avg(CASE WHEN d.doc_id IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.995 AS passes FROM conversations LEFT JOIN (SELECT doc_id FROM documents WHERE lang <> 'es') d ON d.doc_id = conv_id GROUP BY 1""")
def grounding_audit(conversations, documents):
    d = documents.where("lang <> 'es'").select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("g"))
    rate = F.avg(F.coalesce("g", F.lit(0)).cast("double"))
    return conversations.join(d, "conv_id", "left").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(rate, 6).alias("grounded"), (rate >= 0.995).alias("passes"))
