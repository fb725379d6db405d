"""Caps, samples, orders and representatives."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from recordmill.functions import text as X
from recordmill.operators import ranking as R, strata as T
from recordmill.plans.record_joins import NORM
from recordmill.plans.registry import query


@query("SELECT c_nationkey, c_custkey, c_acctbal, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer) WHERE rank <= 3")
def per_group_cap(customer):
    return R.first_of_each(customer, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "c_acctbal", "rank")


@query("""
WITH t AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS turn FROM orders)
SELECT o_orderkey, o_orderstatus, CAST(turn AS INTEGER) AS turn, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY turn, o_orderpriority, o_orderkey) AS INTEGER) AS place FROM t""")
def stratified_round_robin(orders):
    return R.round_robin(orders, ["o_orderstatus"], ["o_orderpriority"], ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "turn", "place")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice, p_partkey) = 1 AS lead FROM part")
def coverage_first_order(part):
    return R.coverage_first(part, ["p_brand", "p_type"], ["p_retailprice", "p_partkey"]).select("p_partkey", "lead")


@query("SELECT doc_id, sha256('s1:' || doc_id) AS h, CAST('0x' || substr(sha256('s1:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM documents ORDER BY h LIMIT 50")
def hash_order_topk(documents):
    h = R.hash_rank("s1", F.col("doc_id"))
    return documents.select("doc_id", h.alias("h"), (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32)).alias("u")).orderBy("h").limit(50)


@query("""
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('bal:' || doc_id), doc_id) AS r FROM documents), k AS (SELECT least(80, min(n)) AS k FROM (SELECT count(*) AS n FROM documents GROUP BY lang))
SELECT doc_id, lang, CASE WHEN CAST('0x' || substr(sha256('bal/test:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS part FROM r, k WHERE r <= k""")
def balanced_per_label(documents):
    return R.balanced(documents.select("doc_id", "lang"), "lang", 80, "bal", "doc_id")


PRIORITY = "CASE WHEN p_size <= 10 THEN 0 ELSE 1 END"


@query(f"""
WITH t AS (SELECT p_partkey, p_brand, {PRIORITY} AS priority, p_type, row_number() OVER (PARTITION BY p_brand, {PRIORITY}, p_type ORDER BY p_retailprice, p_partkey) AS turn FROM part),
o AS (SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY priority, turn, p_type) AS INTEGER) AS place FROM t)
SELECT * FROM o WHERE place <= 60""")
def round_robin_limit(part):
    """The first rows of each brand: small parts first, and of each level one row of every type in turn."""
    rows = part.select("p_partkey", "p_brand", F.when(F.col("p_size") <= 10, 0).otherwise(1).alias("priority"), "p_type", "p_retailprice")
    return R.round_robin_limit(rows, ["p_brand"], "priority", ["p_type"], ["p_retailprice", "p_partkey"], 60).select("p_partkey", "p_brand", "place")


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS rank FROM lineitem")
def numbers_in_large_groups(lineitem):
    """Rows numbered inside three groups that hold all of the table, by ranges: no window over a group."""
    return R.numbered_by_range(lineitem.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey"), ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "rank")


LANGS, SIZES = ["de", "en", "es", "fr"], ["tiny", "short", "medium", "long"]
SIZE_SQL = "CASE WHEN n_chars < 300 THEN 'tiny' WHEN n_chars < 900 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END"
TARGET = 5
BLOCK_SQL = f"""
WITH RECURSIVE names AS (SELECT * FROM (SELECT unnest({LANGS!r}) AS lang, unnest(range(4)) AS i), (SELECT unnest({SIZES!r}) AS size, unnest(range(4)) AS j)),
d AS (SELECT doc_id, lang, {SIZE_SQL} AS size FROM documents WHERE n_chars IS NOT NULL),
cells AS (SELECT lang, i, size, j, count(doc_id) AS available FROM names LEFT JOIN d USING (lang, size) GROUP BY ALL),
subsets AS (SELECT 0 AS i, 0 AS own UNION ALL SELECT s.i + 1, s.own + b * (1 << s.i) FROM subsets s, (SELECT unnest([0, 1]) AS b) WHERE s.i < 4),
fit AS (SELECT own, lang, c.i, size, j FROM subsets s JOIN cells c ON (s.own >> c.i) % 2 = 1 WHERE s.i = 4 AND NOT EXISTS (SELECT 1 FROM cells x WHERE x.size = c.size AND (s.own >> x.i) % 2 = 1 AND x.available < {TARGET})),
blocks AS (SELECT own, list(DISTINCT size) AS seconds, list(DISTINCT lang) AS firsts, list(DISTINCT {{'j': j, 's': size}}) AS js FROM fit GROUP BY own HAVING count(DISTINCT size) >= 2 AND count(DISTINCT lang) >= 2),
best AS (SELECT firsts, seconds FROM blocks ORDER BY len(firsts) * len(seconds) DESC, len(firsts) DESC, len(seconds) DESC, list_concat(list_sort(firsts), list_transform(list_sort(js), lambda x: x.s)) DESC LIMIT 1)"""


def _strata(documents):
    size = F.when(F.col("n_chars") < 300, "tiny").when(F.col("n_chars") < 900, "short").when(F.col("n_chars") < 3000, "medium").otherwise("long")
    rows = documents.where("n_chars IS NOT NULL").select("doc_id", "lang", size.alias("size"))
    cells = T.cell_counts(rows, "lang", "size", LANGS, SIZES)
    return rows, cells, T.common_support(cells, "lang", "size", LANGS, SIZES, TARGET)


@query(BLOCK_SQL + f"""
SELECT lang, size, available::BIGINT AS available, in_block, (CASE WHEN in_block THEN least(available, {TARGET}) ELSE 0 END)::BIGINT AS selected, greatest({TARGET} - available, 0)::BIGINT AS shortage, CASE WHEN in_block THEN ({TARGET} - least(available, {TARGET}))::BIGINT END AS block_shortage
FROM (SELECT *, coalesce(list_contains(firsts, lang) AND list_contains(seconds, size), false) AS in_block FROM cells LEFT JOIN best ON true)""")
def support_block_cells(documents):
    """Every cell of language and size: its rows, whether it is in the largest block of cells with enough of them, and what it lacks."""
    _, cells, block = _strata(documents)
    return T.matched_cells(cells, block, "lang", "size", TARGET)


@query(BLOCK_SQL + f"""
, r AS (SELECT doc_id, lang, size, CAST(row_number() OVER (PARTITION BY lang, size ORDER BY sha256('block:' || doc_id), doc_id) AS INTEGER) AS rank FROM d JOIN best ON list_contains(firsts, lang) AND list_contains(seconds, size))
SELECT * FROM r WHERE rank <= {TARGET}""")
def support_block_rows(documents):
    """The rows that the block's cells give, in hash order."""
    rows, _, block = _strata(documents)
    return T.matched_rows(rows, block, "lang", "size", "doc_id", TARGET, "block").select("doc_id", "lang", "size", "rank")


@query(BLOCK_SQL + """
, t AS (SELECT *, sum(available) OVER () AS t, sum(available) OVER (PARTITION BY lang) AS a, sum(available) OVER (PARTITION BY size) AS b FROM cells)
SELECT coalesce(round(sum(available / t * log2(available * t / (a * b))), 9), 0) AS bits FROM t WHERE available > 0""")
def support_information(documents):
    """How much language and size tell of each other, in bits."""
    _, cells, _ = _strata(documents)
    return T.shared_information(cells, "lang", "size", "available").select(F.round("bits", 9).alias("bits"))


@query("""
WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('cell:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang, source) AS n FROM documents)
SELECT lang, source, CAST(count(*) FILTER (r <= 5) AS BIGINT) AS selected, CAST(greatest(0, 5 - max(n)) AS BIGINT) AS shortage FROM r GROUP BY 1, 2""")
def matched_strata(documents):
    """How many of the first five rows of each cell there are, and how many lack; of the rows themselves only the counts matter."""
    n = F.count(F.lit(1))
    return documents.groupBy("lang", "source").agg(F.least(F.lit(5), n).cast("bigint").alias("selected"), F.greatest(F.lit(0), 5 - n).cast("bigint").alias("shortage"))


@query("""
WITH c AS (SELECT lang, n_chars // 2000 AS size, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT size, count(*) FILTER (n >= 10) AS langs, sum(n)::BIGINT AS n, count(*) FILTER (n >= 10) = (SELECT count(DISTINCT lang) FROM documents) AS full_support FROM c GROUP BY 1""")
def common_support_block(documents):
    """Which size strata hold every language with at least ten rows."""
    c = documents.groupBy("lang", F.floor(F.col("n_chars") / 2000).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    all_ = documents.agg(F.count_distinct("lang").alias("k"))
    return c.groupBy("size").agg(F.count_if(F.col("n") >= 10).alias("langs"), F.sum("n").alias("n")).join(F.broadcast(all_)).select("size", "langs", "n", (F.col("langs") == F.col("k")).alias("full_support"))


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('cap:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 20")
def limit_per_task(documents):
    return R.first_of_each(documents.select("lang", "doc_id"), ["lang"], [R.hash_rank("cap", F.col("doc_id")), F.col("doc_id")], 20).select("lang", "doc_id")


@query("SELECT o_orderkey FROM orders ORDER BY sha256('sample:' || o_orderkey), o_orderkey LIMIT 100")
def fixed_size_sample(orders):
    return orders.select("o_orderkey").orderBy(R.hash_rank("sample", F.col("o_orderkey")), "o_orderkey").limit(100)


@query("""
SELECT doc_id, shots FROM documents d JOIN (SELECT lang, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS shots FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents WHERE doc_id % 2 = 0) WHERE r <= 3 GROUP BY 1) s USING (lang) WHERE doc_id % 2 = 1""")
def few_shot_pick(documents):
    """The first three training rows of the same task for every other row."""
    first = R.first_of_each(documents.where("doc_id % 2 = 0").select("lang", "doc_id"), ["lang"], [F.col("doc_id")], 3)
    shots = first.groupBy("lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("shots"))
    return documents.where("doc_id % 2 = 1").select("doc_id", "lang").join(shots, "lang").select("doc_id", "shots")


@query(f"SELECT sha256({NORM}) AS sig, min(doc_id) AS representative, count(*) AS n FROM documents GROUP BY 1")
def first_representative(documents):
    return documents.groupBy(F.sha2(X.collapse_blanks(F.lower("text")), 256).alias("sig")).agg(F.min("doc_id").alias("representative"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderpriority, o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders""")
def multi_key_priority(orders):
    status = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return orders.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(status, "o_orderpriority", F.desc("o_totalprice"), "o_orderkey")).alias("place"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey) ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_shipdate, l_tax, l_discount) - 1 AS INTEGER) AS ordinal FROM lineitem""")
def endpoint_ordinal(lineitem):
    """The ordinal among rows with the same unordered pair of ends."""
    w = Window.partitionBy(F.least("l_partkey", "l_suppkey"), F.greatest("l_partkey", "l_suppkey")).orderBy("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_shipdate", "l_tax", "l_discount")
    return lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.row_number().over(w) - 1).alias("ordinal"))


@query("""
WITH f AS (SELECT p_partkey, p_brand, p_type FROM part WHERE p_size = 1), u AS (SELECT p_brand, count(*) AS used FROM f GROUP BY 1)
, a AS (SELECT p.p_partkey, p.p_brand, row_number() OVER (PARTITION BY p.p_brand ORDER BY p.p_partkey) + coalesce(used, 0) AS s FROM part p LEFT JOIN u USING (p_brand) WHERE p_size <> 1 AND p_partkey % 2 = 0)
, ka AS (SELECT p_partkey, p_brand FROM a WHERE s <= 60 ORDER BY p_partkey LIMIT 40)
, u2 AS (SELECT p_brand, count(*) AS used FROM (SELECT p_brand FROM f UNION ALL SELECT p_brand FROM ka) GROUP BY 1)
, b AS (SELECT p.p_partkey, row_number() OVER (PARTITION BY p.p_brand ORDER BY p.p_partkey) + coalesce(used, 0) AS s FROM part p LEFT JOIN u2 USING (p_brand) WHERE p_size <> 1 AND p_partkey % 2 = 1)
SELECT p_partkey, 'forced' AS why FROM f UNION ALL SELECT p_partkey, 'quota' FROM ka UNION ALL SELECT p_partkey, 'quota' FROM (SELECT p_partkey FROM b WHERE s <= 60 ORDER BY p_partkey LIMIT 25)""")
def quota_selection(part):
    rows = part.select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 2 == 0, "even").otherwise("odd").alias("kind"), "p_size")
    return R.quota_selection(rows, "kind", "p_brand", {"even": 40, "odd": 25}, 60, "p_partkey", F.col("p_size") == 1).select("p_partkey", "why")
