"""Migration and repair of queries, nested fields, caches, and group splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordmill.functions import nested as N, text as X
from recordmill.operators import ranking as R, similarity as M, splits as P, states as S
from recordmill.operators.components import connected_components
from recordmill.plans.record_joins import NORM
from recordmill.operators.joins import provenance_components
from recordmill.plans.registry import query
from recordmill.plans.state_queries import ELEMENTS, states
from recordmill.session import checkpoint
from recordmill.sources.files import latest


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def cache_last_wins(events):
    return latest(events.select("user_id", "event_type", "ts", "event_id"), "user_id", ["ts", "event_id"])


@query("""
SELECT o_orderkey, CASE WHEN contains(q, 'transformer') AND contains(q, 'line') THEN 'all' WHEN contains(q, 'transformer') THEN 'transformer' WHEN contains(q, 'line') THEN 'line' ELSE 'all' END AS scope, '3' AS version
FROM (SELECT o_orderkey, 'list overloaded ' || ['lines', 'transformers', 'lines and transformers', 'equipment'][1 + o_orderkey % 4] AS q FROM orders)""")
def query_migration(orders):
    """The scope that a query lacks, inferred from its prose."""
    prose = F.concat(F.lit("list overloaded "), F.element_at(F.array(*map(F.lit, ("lines", "transformers", "lines and transformers", "equipment"))), (F.col("o_orderkey") % 4 + 1).cast("int")))
    has = lambda x: F.contains(prose, F.lit(x))
    return orders.select("o_orderkey", F.when(has("transformer") & has("line"), "all").when(has("transformer"), "transformer").when(has("line"), "line").otherwise("all").alias("scope"), F.lit("3").alias("version"))


@query(f"""
WITH t AS (SELECT o_orderkey AS k, count(e.element) AS n FROM orders LEFT JOIN ({ELEMENTS}) e ON e.scenario_id = o_orderkey AND e.loading_percent > 100 GROUP BY 1)
SELECT k AS scenario_id, CAST(n AS INTEGER) AS "count", k % 9 = 0 AS repaired FROM t""")
def repair_by_re_execution(orders, lineitem):
    """Stored counts, some of them stale, replaced by what the query gives now."""
    s = states(orders, lineitem)
    q = s.select("scenario_id", F.lit(S.FILTERS[0]).alias("filter"), F.lit("all").alias("equipment_scope"))
    now = checkpoint(S.run_queries(q, s).select("scenario_id", "count"))
    kept = now.select("scenario_id", (F.col("count") + F.when(F.col("scenario_id") % 9 == 0, 1).otherwise(0)).alias("stale"))
    return kept.join(now, "scenario_id").select("scenario_id", "count", (F.col("stale") != F.col("count")).alias("repaired"))


@query("SELECT o_orderkey, o_orderstatus AS status, upper(o_orderpriority) AS priority FROM orders")
def nested_field_drop(orders):
    """Nested records without the fields whose names hold a token; the string leaves that stay are changed at any depth."""
    rec = F.struct(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("targetPrice")).alias("state"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("gold_label"))
    d = N.drop_fields(orders.select("o_orderkey", rec.alias("rec")), {"gold_label"}, ("target",))
    d = N.change_strings(d, F.upper)
    return d.select("o_orderkey", F.col("rec.state.status").alias("status"), F.col("rec.priority").alias("priority"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN text END AS utterance, CASE WHEN role <> 'user' THEN length(text) END AS reply_chars FROM conversations")
def allow_list_view(conversations):
    """The fields that each task may see."""
    user = F.col("role") == "user"
    return conversations.select("conv_id", "turn", F.when(user, F.col("text")).alias("utterance"), F.when(~user, F.length("text")).cast("bigint").alias("reply_chars"))


@query("""
WITH t AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS turn FROM documents), p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn, source, doc_id) AS place FROM t)
SELECT lang, doc_id FROM p WHERE place <= 30""")
def cluster_round_robin(documents):
    """Thirty rows a label, one of each cluster in turn."""
    first = R.first_of_each(documents.select("lang", "source", "doc_id"), ["lang", "source"], [F.col("doc_id")], 30).drop("rank")  # no cluster gives more than all thirty
    return R.round_robin(first, ["lang"], ["source"], ["doc_id"]).where("place <= 30").select("lang", "doc_id")


@query("""
WITH d AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1 OR row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) = 1 OR row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) = 1 AS must FROM part)
SELECT p_partkey, must FROM (SELECT p_partkey, must FROM d ORDER BY must DESC, p_partkey LIMIT 100)""")
def diverse_target(part):
    """A hundred rows with at least one of every value of three dimensions, then filled up in order."""
    lead = [part.groupBy(c).agg(F.min("p_partkey").alias("p_partkey")).select("p_partkey") for c in ("p_brand", "p_type", "p_size")]
    must = lead[0].union(lead[1]).union(lead[2]).distinct().withColumn("must", F.lit(True))
    return part.select("p_partkey").join(must, "p_partkey", "left").fillna(False, ["must"]).orderBy(F.desc("must"), "p_partkey").limit(100)


@query()
def near_neighbour_free_split(documents):
    """Components of exact Jaccard 0.85 dealt to splits, so that no split holds a neighbour of another's row. Invariants are tested."""
    pairs, members = M.jaccard_join(M.texts_of(documents, "doc_id", X.collapse_blanks(F.lower("text"))), 0.85)
    comps = connected_components(checkpoint(pairs), "a", "b")
    rows = checkpoint(members.join(comps, F.col("rep") == F.col("node"), "left").select(F.col("id").alias("doc_id"), F.coalesce("component", "rep").alias("component")))
    return rows.join(P.greedy_split(P.sizes(rows, "component"), "component", seed="near"), "component").select("doc_id", "component", "split")


U = "(CAST('0x' || substr(sha256('challenge:' || sha256({n})), 1, 8) AS BIGINT) % 10000)"


@query(f"SELECT doc_id, CASE WHEN u < 7000 THEN 'train' WHEN u < 8000 THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, {U.format(n=NORM)} AS u FROM documents)")
def challenge_group_split(documents):
    """Rows of one surface stay together, 70 / 10 / 20."""
    key = F.sha2(X.collapse_blanks(F.lower("text")), 256)
    return documents.select("doc_id", P.hash_split(key, (("train", 0.7), ("validation", 0.1), ("test", 0.2)), "challenge").alias("split"))


@query(f"""
WITH RECURSIVE k AS (SELECT doc_id, sha256({NORM}) AS a, sha256(substr({NORM}, 1, 60)) AS b FROM documents), e AS (SELECT doc_id AS s, min(doc_id) OVER (PARTITION BY a) AS t FROM k UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY b) FROM k),
u AS (SELECT s, t FROM e UNION SELECT t, s FROM e), r AS (SELECT s AS id, s AS c FROM u UNION SELECT u.t, r.c FROM r JOIN u ON u.s = r.id), c AS (SELECT id AS doc_id, min(c) AS component FROM r GROUP BY 1),
h AS (SELECT doc_id, component, CAST('0x' || substr(sha256('challenge:' || component), 1, 8) AS BIGINT) % 10000 AS u FROM c)
SELECT doc_id, component, CASE WHEN u < 7000 THEN 'train' WHEN u < 8000 THEN 'validation' ELSE 'test' END AS split FROM h""")
def challenge_component_split(documents):
    """Rows that share a surface or a provenance key, directly or through others, stay together, 70 / 10 / 20."""
    norm = X.collapse_blanks(F.lower("text"))
    comps = provenance_components(documents, "doc_id", [F.sha2(norm, 256), F.sha2(F.substring(norm, 1, 60), 256)])
    return comps.select(F.col("id").alias("doc_id"), "component", P.hash_split(F.col("component"), (("train", 0.7), ("validation", 0.1), ("test", 0.2)), "challenge").alias("split"))
