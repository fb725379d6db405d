"""Joins, keys and set operations of records, states and cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordmill.functions import text as X
from recordmill.operators import joins as J
from recordmill.plans.registry import query
from recordmill.plans.state_queries import elements

NORM = "trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g'))"


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, o_orderstatus, o_orderpriority FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P'""")
def record_state_lookup(lineitem, orders):
    known = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_orderpriority")
    return lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(known, "l_orderkey", "left")


@query("""
SELECT c_custkey, seg, bal FROM (SELECT c_custkey, c_mktsegment AS seg, c_acctbal AS bal FROM customer WHERE c_custkey % 3 = 0 UNION ALL
SELECT c_custkey, 'second', 0.0 FROM customer WHERE c_custkey % 3 <> 0)""")
def first_wins_lookup(customer):
    first = customer.where("c_custkey % 3 = 0").select("c_custkey", F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    second = customer.select("c_custkey", F.lit("second").alias("seg"), F.lit(0.0).alias("bal"))
    return J.first_wins("c_custkey", first, second)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def fk_violations(orders, customer):
    return J.missing_keys(orders.select("o_orderkey", "o_custkey"), customer.where("c_custkey % 10 <> 0"), "o_custkey", "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unreferenced_dimension(customer, orders):
    return customer.select("c_custkey", "c_name").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query(f"""
WITH s AS (SELECT doc_id, source, sha256({NORM}) AS sig FROM documents)
SELECT doc_id, sig FROM s WHERE source IN ('src1', 'src2', 'src3', 'src4', 'src5') AND sig IN (SELECT sig FROM s WHERE source NOT IN ('src1', 'src2', 'src3', 'src4', 'src5'))""")
def cross_signature_semi_join(documents):
    s = documents.select("doc_id", "source", F.sha2(X.collapse_blanks(F.lower("text")), 256).alias("sig"))
    right = F.col("source").isin("src1", "src2", "src3", "src4", "src5")
    return s.where(right).join(s.where(~right).select("sig"), "sig", "left_semi").select("doc_id", "sig")


CONTRAST = """
SELECT a.{g}, count(*) AS n_contrast FROM {t} a JOIN {t} b ON a.{g} = b.{g} AND a.{i} < b.{i} AND a.{d} <> b.{d} AND a.{l} <> b.{l} GROUP BY 1"""


@query("""
WITH n AS (SELECT c_nationkey, count(*) AS n_rows FROM customer GROUP BY 1),
c AS (SELECT a.c_nationkey, count(*) AS n_contrast FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey AND a.c_mktsegment <> b.c_mktsegment AND a.c_custkey % 4 <> b.c_custkey % 4 GROUP BY 1)
SELECT c_nationkey, n_rows, CAST(n_rows * (n_rows - 1) / 2 AS BIGINT) AS n_pairs, coalesce(n_contrast, 0) AS n_contrast FROM n LEFT JOIN c USING (c_nationkey)""")
def contrast_pairs(customer):
    return J.contrast_pairs(customer.withColumn("label", F.col("c_custkey") % 4), ["c_nationkey"], "c_custkey", "c_mktsegment", "label")


@query("""
WITH c AS (SELECT c_nationkey AS g, c_custkey AS i, c_mktsegment AS d, c_custkey % 4 AS l, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey + 1) % 4 ELSE c_custkey % 4 END AS p FROM customer),
j AS (SELECT a.g, count(*) AS n, count(*) FILTER (a.l = a.p AND b.l = b.p) AS r, count(*) FILTER (a.p = b.p) AS s FROM c a JOIN c b ON a.g = b.g AND a.i < b.i AND a.d <> b.d AND a.l <> b.l GROUP BY 1)
SELECT k.g AS c_nationkey, coalesce(n, 0) AS n_contrast, coalesce(r, 0) AS n_both_right, coalesce(s, 0) AS n_same_prediction FROM (SELECT DISTINCT g FROM c) k LEFT JOIN j USING (g)""")
def contrast_pair_scores(customer):
    """Contrast pairs that a prediction gets right on both sides, and those it can't tell apart."""
    label = F.col("c_custkey") % 4
    rows = customer.withColumns({"label": label, "pred": F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") + 1) % 4).otherwise(label)})
    return J.contrast_scores(rows, ["c_nationkey"], "c_custkey", "c_mktsegment", "label", "pred")


@query("""
WITH a AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 9 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'other' ELSE p_brand END AS p_brand, p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS p_size FROM part WHERE p_partkey % 8 <> 0)
SELECT p_partkey, CASE WHEN b.p_size IS NULL THEN 'only_left' WHEN a.p_size IS NULL THEN 'only_right' WHEN a.p_brand <> b.p_brand OR a.p_size <> b.p_size THEN 'changed' ELSE 'equal' END AS status,
CASE WHEN a.p_size IS NOT NULL AND b.p_size IS NOT NULL AND (a.p_brand <> b.p_brand OR a.p_size <> b.p_size) THEN concat_ws(',', CASE WHEN a.p_brand <> b.p_brand THEN 'p_brand' END, CASE WHEN a.p_size <> b.p_size THEN 'p_size' END) END AS columns
FROM a FULL JOIN b USING (p_partkey)""")
def row_diff_full_outer(part):
    a = part.where("p_partkey % 9 <> 0").select("p_partkey", "p_brand", "p_size")
    b = part.where("p_partkey % 8 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, "other").otherwise(F.col("p_brand")).alias("p_brand"), (F.col("p_size") + F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0)).alias("p_size"))
    return J.row_diff(a, b, "p_partkey")


MERGED = "(SELECT p_partkey AS k, p_brand AS v FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'changed' ELSE p_brand END FROM part WHERE p_partkey % 3 <> 1)"


def _merged(part):
    a = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("v"))
    b = part.where("p_partkey % 3 <> 1").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 10 == 0, "changed").otherwise(F.col("p_brand")).alias("v"))
    return J.merge_checked("k", a, b)


@query(f"SELECT k, min(v) AS v FROM {MERGED} GROUP BY k HAVING count(DISTINCT v) = 1")
def conflict_checked_merge(part):
    return _merged(part)[0]


@query(f"SELECT k, count(DISTINCT v) AS n_payloads FROM {MERGED} GROUP BY k HAVING count(DISTINCT v) > 1")
def merge_conflicts(part):
    return _merged(part)[1]


@query("""
SELECT n_nationkey, stress, step FROM nation, (SELECT unnest([0.8, 1.0, 1.2]::DOUBLE[]) AS stress), (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS step)""")
def case_grid(nation):
    """Every card with every stress and step: a grid of fixed size for each row, made by generators and no join."""
    return nation.select("n_nationkey", F.explode(F.array(*map(F.lit, (0.8, 1.0, 1.2)))).alias("stress")).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(3))))


@query("""
SELECT s_suppkey, string_agg(n_name, ',' ORDER BY pos) AS context FROM (SELECT s_suppkey, unnest([s_nationkey, (s_nationkey + 7) % 25, (s_nationkey + 13) % 31]) AS k, generate_subscripts([1, 2, 3], 1) AS pos FROM supplier) LEFT JOIN nation ON n_nationkey = k GROUP BY 1""")
def array_context_join(supplier, nation):
    keys = F.array(F.col("s_nationkey"), (F.col("s_nationkey") + 7) % 25, (F.col("s_nationkey") + 13) % 31)
    each = supplier.select("s_suppkey", F.posexplode(keys).alias("pos", "k")).join(nation, F.col("k") == F.col("n_nationkey"), "left")
    ordered = F.sort_array(F.collect_list(F.when(F.col("n_name").isNotNull(), F.struct("pos", "n_name"))))
    return each.groupBy("s_suppkey").agg(F.nullif(F.array_join(F.transform(ordered, lambda x: x["n_name"]), ","), F.lit("")).alias("context"))


@query("SELECT doc_id, n_name, doc_id // 25 AS variant FROM documents JOIN nation ON n_nationkey = doc_id % 25")
def modulo_join(documents, nation):
    return documents.select("doc_id", (F.col("doc_id") % 25).cast("int").alias("n_nationkey"), F.floor(F.col("doc_id") / 25).alias("variant")).join(nation, "n_nationkey").select("doc_id", "n_name", "variant")


@query("SELECT c_custkey, CASE WHEN o.n IS NULL THEN c_acctbal ELSE o.total END AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def projection_back_merge(customer, orders):
    new = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return customer.select("c_custkey", "c_acctbal").join(new, "c_custkey", "left").select("c_custkey", F.coalesce("total", "c_acctbal").alias("c_acctbal"))


@query("""
SELECT doc_id, CASE WHEN lang = 'de' AND doc_id % 4 <> 0 THEN 'german' ELSE lang END AS lang, CASE WHEN lang = 'de' AND doc_id % 4 <> 0 THEN 'source five' ELSE source END AS source, CASE WHEN lang = 'de' AND doc_id % 4 <> 0 THEN 'zwei,two' ELSE 'eins,zwei' END AS tags FROM documents""")
def structure_overlay(documents):
    """Translated leaves laid over nested records where the source leaf is to be replaced and a translation is there; shapes are the source's."""
    from recordmill.functions import nested as N

    meta = lambda lang, source, tags: F.struct(F.struct(lang.alias("lang"), source.alias("source")).alias("of"), tags.alias("tags")).alias("meta")
    german = F.col("lang") == "de"
    mark = lambda c: F.when(german, F.concat(F.lit("~"), c)).otherwise(c)  # noqa: E731  (what is to be replaced is marked)
    source = documents.select("doc_id", meta(mark(F.col("lang")), mark(F.col("source")), F.array(mark(F.lit("eins")), F.lit("zwei"))))
    translated = documents.where("doc_id % 4 <> 0").select("doc_id", meta(F.lit("german"), F.lit("source five"), F.array(F.lit("zwei"), F.lit("two"))))
    done = N.overlay(source, translated, "doc_id", lambda c: c.startswith("~"))
    plain = lambda c: F.regexp_replace(c, "^~", "")
    tags = F.when(german & (F.col("doc_id") % 4 != 0), F.concat_ws(",", F.col("meta.tags")[0], F.lit("two"))).otherwise(F.array_join(F.transform("meta.tags", plain), ","))
    return done.join(documents.select("doc_id", "lang"), "doc_id").select("doc_id", plain(F.col("meta.of.lang")).alias("lang"), plain(F.col("meta.of.source")).alias("source"), tags.alias("tags"))


@query(f"""
WITH RECURSIVE k AS (SELECT doc_id, 'a' || sha256({NORM}) AS key FROM documents UNION ALL SELECT doc_id, 'b' || sha256(substr({NORM}, 1, 60)) FROM documents),
e AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY key) AS b FROM k),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS id, a AS c FROM s UNION SELECT s.b, r.c FROM r JOIN s ON s.a = r.id)
SELECT id, min(c) AS component FROM r GROUP BY 1""")
def provenance_components(documents):
    norm = X.collapse_blanks(F.lower("text"))
    return J.provenance_components(documents, "doc_id", [F.sha2(norm, 256), F.sha2(F.substring(norm, 1, 60), 256)])


@query("SELECT pos, c_custkey, c_name FROM (SELECT o_orderkey AS pos, o_custkey FROM orders WHERE o_orderstatus = 'O') JOIN customer ON c_custkey = o_custkey")
def id_manifest_projection(orders, customer):
    """An ordered list of ids projected on the canonical table."""
    ids = orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("c_custkey"))
    return ids.join(customer.select("c_custkey", "c_name"), "c_custkey").select("pos", "c_custkey", "c_name")


@query("SELECT s_nationkey AS k, 'supplier' AS side FROM supplier UNION ALL SELECT c_nationkey, 'customer' FROM customer")
def bag_union(supplier, customer):
    return supplier.select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("side")).unionAll(customer.select("c_nationkey", F.lit("customer")))


@query("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def set_intersect(lineitem):
    return lineitem.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("k")).intersect(lineitem.where("l_returnflag = 'R'").select("l_partkey"))


@query("SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def set_except(orders, lineitem):
    return orders.select(F.col("o_orderkey").alias("k")).subtract(lineitem.select("l_orderkey"))


@query("""
WITH parts AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderkey % 10 = 0 UNION ALL SELECT -o_orderkey FROM orders WHERE o_orderkey % 97 = 0),
p AS (SELECT k, count(*) AS n FROM parts GROUP BY 1)
SELECT (SELECT count(*) FROM orders) AS n_whole, (SELECT count(*) FROM parts) AS n_parts, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT k FROM p)) AS n_missing, (SELECT count(*) FROM p WHERE k NOT IN (SELECT o_orderkey FROM orders)) AS n_foreign,
  (SELECT count(*) FROM p WHERE n > 1) AS n_twice, false AS is_partition""")
def partition_check(orders):
    """Whether parts make up the whole: nothing missing, nothing foreign, nothing in two parts. These overlap and hold keys that the whole lacks."""
    k = F.col("o_orderkey")
    parts = [orders.where("o_orderstatus = 'O'").select(k.alias("k")), orders.where((F.col("o_orderstatus") == "F") | (k % 10 == 0)).select(k.alias("k")), orders.where(k % 97 == 0).select((-k).alias("k"))]
    return J.partition_check(orders.select(k.alias("k")), parts, "k")


@query("""
WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem), b AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 20 <> 0)
SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, (SELECT count(*) FROM a JOIN b USING (k)) AS n_both, (SELECT count(*) FROM a FULL JOIN b USING (k) WHERE a.k IS NULL OR b.k IS NULL) = 0 AS equal_sets,
(SELECT count(*) FROM a ANTI JOIN b USING (k)) = 0 AS left_within_right, (SELECT count(*) FROM a JOIN b USING (k)) = 0 AS disjoint_sets""")
def identity_set_equality(lineitem, supplier):
    a, b = lineitem.select(F.col("l_suppkey").alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r")), supplier.where("s_suppkey % 20 <> 0").select(F.col("s_suppkey").alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    per = a.unionAll(b).groupBy("k").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    c = per.agg(F.sum("l").cast("bigint").alias("n_left"), F.sum("r").cast("bigint").alias("n_right"), F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("n_both"))
    return c.select("*", ((F.col("n_left") == F.col("n_both")) & (F.col("n_right") == F.col("n_both"))).alias("equal_sets"), (F.col("n_left") == F.col("n_both")).alias("left_within_right"), (F.col("n_both") == 0).alias("disjoint_sets"))


@query()
def nearest_unique_replacement(supplier, customer):
    """Each supplier takes the unused customer of its nation whose balance is nearest; checked against a plain loop in the tests."""
    w = supplier.select(F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("v"), F.col("s_suppkey").alias("id"))
    o = customer.select(F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("v"), F.col("c_custkey").alias("id"))
    return J.nearest_unused(w, o, ["g"], "v", "id")
