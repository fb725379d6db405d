"""Scalar transforms, record generation, augmentation, migration and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordmill.functions import text as X
from recordmill.operators import models as B
from recordmill.operators import augmentation as G
from recordmill.plans.registry import query
from recordmill.plans.similarity import TFIDF_SQL
from recordmill.session import checkpoint, stored


@query("""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[0-9a-f]{16,}', '<hash>', 'g'), '[0-9]+(\\.[0-9]+)?', '<num>', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS template FROM documents""")
def template_normalize(documents):
    return documents.select("doc_id", X.template_form(F.col("text")).alias("template"))


@query("SELECT doc_id, length(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) AS n, sha256(concat_ws(chr(10), coalesce(lang, ''), coalesce(source, ''), coalesce(text, ''))) AS sig, substr(sha1(text), 1, 12) AS slug FROM documents")
def hashes_and_blanks(documents):
    return documents.select("doc_id", F.length(X.collapse_blanks(F.col("text"))).alias("n"), X.signature(F.col("lang"), F.col("source"), F.col("text")).alias("sig"), F.substring(F.sha1("text"), 1, 12).alias("slug"))


@query("SELECT p_partkey, sha256('{\"brand\":' || to_json(p_brand) || ',\"key\":' || p_partkey || ',\"size\":' || p_size || '}') AS h FROM part")
def canonical_json_hash(part):
    """SHA-256 of canonical JSON: keys in order, no blanks, nulls kept."""
    return part.select("p_partkey", F.sha2(F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("key"), F.col("p_size").alias("size")), {"ignoreNullFields": "false"}), 256).alias("h"))


@query("SELECT doc_id, len(list_distinct(list_transform(range(1, greatest(length(text) - 4, 1) + 1), lambda i: substr(text, i, 5)))) AS n_grams FROM documents")
def char_ngram_counts(documents):
    return documents.select("doc_id", F.size(X.char_grams(F.col("text"), 5)).cast("bigint").alias("n_grams"))


@query("SELECT doc_id, regexp_matches(text, '[一-鿿]') AS cjk, replace(replace(text, 'src', 'source'), '%%%', '') = text AS unchanged, coalesce(CAST(nullif(regexp_extract(text, '([0-9]{10,})', 1), '') AS VARCHAR), '') AS literal FROM documents")
def walk_and_replace(documents):
    return documents.select("doc_id", X.has_cjk(F.col("text")).alias("cjk"), (F.replace(F.replace("text", F.lit("src"), F.lit("source")), F.lit("%%%"), F.lit("")) == F.col("text")).alias("unchanged"), F.regexp_extract("text", "([0-9]{10,})", 1).alias("literal"))


@query("""
SELECT l_orderkey, l_linenumber, regexp_replace(regexp_replace(CAST(CAST(l_quantity / 8 AS DECIMAL(18,6)) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS factor, CASE WHEN isfinite(l_extendedprice) THEN round_even(l_extendedprice / 7, 6) END AS guarded FROM lineitem""")
def decimal_and_finite(lineitem):
    return lineitem.select("l_orderkey", "l_linenumber", X.decimal_form(F.col("l_quantity") / 8).alias("factor"), X.finite(F.col("l_extendedprice") / 7, 6).alias("guarded"))


@query("""
SELECT event_id, m, CASE WHEN m < 360 THEN 'night' WHEN m < 720 THEN 'morning' ELSE 'later' END AS label FROM (SELECT event_id, CAST(extract(hour FROM ts) * 60 + extract(minute FROM ts) AS INTEGER) AS m FROM events)""")
def clock_relations(events):
    m = X.minutes_of(F.date_format("ts", "HH:mm"))
    return events.select("event_id", m.alias("m"), F.when(m < 360, "night").when(m < 720, "morning").otherwise("later").alias("label"))


@query("""
SELECT event_id, ['visit', 'buy', 'other'][CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END] AS alias, event_type || '::' || CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS composite, concat_ws(',', 'lookup', CASE WHEN value > 50 THEN 'verify' END, CASE WHEN event_type = 'purchase' THEN 'confirm' END) AS tools FROM events""")
def labels_and_tools(events):
    high = F.col("value") > 50
    return events.select("event_id", F.when(F.col("event_type") == "view", "visit").when(F.col("event_type") == "purchase", "buy").otherwise("other").alias("alias"), F.concat_ws("::", "event_type", F.when(high, "high").otherwise("low")).alias("composite"), F.concat_ws(",", F.lit("lookup"), F.when(high, "verify"), F.when(F.col("event_type") == "purchase", "confirm")).alias("tools"))


@query("""
SELECT k AS o_orderkey, concat_ws(',', CASE WHEN k % 2 = 0 THEN 'REG_TOOL_001' END, CASE k % 4 WHEN 0 THEN concat_ws(',', 'REG_OVERLOAD_ALERT_002', CASE WHEN k % 8 = 0 THEN 'REG_OVERLOAD_EMERGENCY_003' END, CASE WHEN k % 3 = 0 THEN 'REG_SECURITY_REDISPATCH_004' END, CASE WHEN k % 5 = 0 THEN 'REG_TOOL_POSTCHECK_004' END)
  WHEN 1 THEN CASE WHEN k % 3 = 0 THEN 'REG_SWITCHING_PERMISSION_002' END WHEN 2 THEN 'REG_TOOL_MITIGATION_003,REG_SECURITY_REDISPATCH_004' ELSE concat_ws(',', 'REG_QUERY_FILTER_002', 'REG_QUERY_AGGREGATION_003') END) AS links,
  CASE WHEN k % 4 = 0 AND k % 5 = 0 THEN '/input/decision_window,/instruction' ELSE '' END AS postcheck FROM (SELECT o_orderkey AS k FROM orders)""")
def rule_link_inference(orders):
    """Rules that a record's evidence calls for, in order, with the pointers of one of them."""
    from recordmill.operators import evidence as E

    k = F.col("o_orderkey")
    kind = lambda n, value: F.when(k % 4 == n, value)
    rows = orders.select(
        "o_orderkey", F.element_at(F.array(*map(F.lit, ("regulation_compliance_check", "operation_ticket_check", "dispatcher_intent_tool_call", "intelligent_data_query"))), (k % 4 + 1).cast("int")).alias("task"),
        F.lit("Do as the record says").alias("instruction"), F.when(k % 2 == 0, F.array(F.lit("REG_TOOL_001"), F.lit("REG_OTHER_009"), F.lit("REG_TOOL_001"))).alias("existing"),
        kind(0, F.when(k % 8 == 0, "Severe OVERLOAD of a line").otherwise("line loading is high")).alias("observed_issues"), kind(0, F.lit("")).alias("grid_state_summary"), kind(0, F.when(k % 3 == 0, "generator_redispatch, none")).alias("available_actions"),
        kind(0, F.when(k % 5 == 0, "10 minutes")).alias("decision_window"), kind(1, F.when(k % 3 == 0, "granted")).alias("dispatch_permit_status"), F.lit(None).cast("string").alias("monitoring_arrangement"),
        kind(2, F.lit("Mitigate it now")).alias("utterance"), kind(3, k.cast("string")).alias("scenario_id"), kind(3, F.lit("List all of them")).alias("question"),
    )
    out = E.infer_links(rows)
    return out.select("o_orderkey", F.array_join("links", ",").alias("links"), F.coalesce(F.array_join(F.try_element_at("basis", F.lit("REG_TOOL_POSTCHECK_004")), ","), F.lit("")).alias("postcheck"))


@query("""
WITH x AS (SELECT p_partkey AS i, unnest([0, 1, 2]) AS l FROM part), t AS (SELECT 'ticket' AS task, i, ['compliant', 'compliant_with_monitoring', 'non_compliant'][l + 1] AS label FROM x UNION ALL SELECT 'route', i, ['diagnose_and_dispatch', 'mitigate_violations', 'security_check_and_redispatch'][l + 1] FROM x)
SELECT task || '-' || label || '-' || i AS id, task, i % 12 AS family, CASE WHEN i % 12 IN (8, 9) THEN 'validation' WHEN i % 12 IN (10, 11) THEN 'test' ELSE 'train' END AS split, label, sha256(task || '-' || label || '-' || i || ':' || label) AS seal FROM t""")
def compositional_controls(part):
    """A control set of tickets and routes: the label that the fields give is the one that was asked for, in every family, label and number."""
    from recordmill.operators import controls as C

    return C.control_rows(part.select(F.col("p_partkey").alias("i"))).select("id", "task", "family", "split", "label", "seal")


@query("""
WITH s AS (SELECT p_partkey AS i, (p_partkey * 37) % 1440 AS m, (p_partkey * 37) % 1440 - 30 AS p FROM part)
SELECT 'ticket-compliant-' || i AS id, printf('%02d:%02d', m // 60, m % 60) AS start, printf('%02d:%02d', ((p + 1440) % 1440) // 60, (p + 1440) % 60) AS permit, 30 AS lead FROM s""")
def control_clocks(part):
    """The clocks that stand in a control row's text, and how long the permit came before the start, around midnight."""
    from recordmill.operators import controls as C

    rows = C.control_rows(part.select(F.col("p_partkey").alias("i"))).where("label = 'compliant'")
    time = lambda word: F.regexp_extract("text", rf"{word} ([0-9]{{2}}:[0-9]{{2}})", 1)
    lead = F.pmod(X.minutes_of(time("Start")) - X.minutes_of(time("permit")), F.lit(1440))
    return rows.select("id", time("Start").alias("start"), time("permit").alias("permit"), lead.alias("lead"))


@query("""
SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '#', 'g') AS skeleton, replace(regexp_replace(c_name, '[0-9]+', '#', 'g'), '#', CAST(c_nationkey AS VARCHAR)) AS remapped, regexp_replace(c_name, '[0-9]+', '#', 'g') = 'Customer#' AS known_shape FROM customer""")
def slot_skeleton(customer):
    """A name with its numbers as slots, and the slots filled from elsewhere."""
    s = F.regexp_replace("c_name", "[0-9]+", "#")
    return customer.select("c_custkey", s.alias("skeleton"), F.replace(s, F.lit("#"), F.col("c_nationkey").cast("string")).alias("remapped"), (s == "Customer#").alias("known_shape"))


@query("""
SELECT o_orderkey * 4 + v AS record_id, ['Check order ', 'Review order ', 'Confirm order ', 'Audit order '][v + 1] || o_orderkey || ' with status ' || o_orderstatus AS instruction, v AS variant FROM orders, (SELECT unnest([0, 1, 2, 3]) AS v)""")
def record_generation(orders):
    """Four records a state, rendered by variant number."""
    v = orders.select("o_orderkey", "o_orderstatus", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("variant"))
    head = F.element_at(F.array(*map(F.lit, ("Check order ", "Review order ", "Confirm order ", "Audit order "))), F.col("variant") + 1)
    return v.select((F.col("o_orderkey") * 4 + F.col("variant")).alias("record_id"), F.concat(head, "o_orderkey", F.lit(" with status "), "o_orderstatus").alias("instruction"), "variant")


@query("""
SELECT conv_id, turn, k, CASE k WHEN 0 THEN text WHEN 1 THEN upper(role) || ': ' || text WHEN 2 THEN text || ' (please verify)' END AS augmented FROM conversations, (SELECT unnest([0, 1, 2]) AS k) WHERE k < 2 OR role = 'user'""")
def augment_explode(conversations):
    """One to n rows: the row, a paraphrase, and an extra one for some."""
    ks = F.when(F.col("role") == "user", F.array(*map(F.lit, (0, 1, 2)))).otherwise(F.array(F.lit(0), F.lit(1)))
    e = conversations.select("conv_id", "turn", "role", "text", F.explode(ks).alias("k"))
    return e.select("conv_id", "turn", "k", F.when(F.col("k") == 0, F.col("text")).when(F.col("k") == 1, F.concat(F.upper("role"), F.lit(": "), "text")).otherwise(F.concat("text", F.lit(" (please verify)"))).alias("augmented"))


@query("SELECT s_suppkey * 3 + l AS case_id, s_name, ['compliant', 'needs_review', 'non_compliant'][l + 1] AS label, sha256(s_suppkey || ':' || l) AS sealed FROM supplier, (SELECT unnest([0, 1, 2]) AS l)")
def challenge_grid(supplier):
    """Sources by labels, with the label sealed by a hash."""
    e = supplier.select("s_suppkey", "s_name", F.posexplode(F.array(*map(F.lit, ("compliant", "needs_review", "non_compliant")))).alias("l", "label"))
    return e.select((F.col("s_suppkey") * 3 + F.col("l")).alias("case_id"), "s_name", "label", F.sha2(F.concat_ws(":", "s_suppkey", "l"), 256).alias("sealed"))


@query("""
SELECT l_orderkey AS old_id, coalesce(m.new_id, l_orderkey) AS new_id, 'order ' || coalesce(m.new_id, l_orderkey) || ' line ' || l_linenumber AS text, m.new_id IS NOT NULL AS migrated FROM lineitem LEFT JOIN (SELECT o_orderkey, o_orderkey + 1000000 AS new_id FROM orders WHERE o_orderstatus = 'P') m ON m.o_orderkey = l_orderkey""")
def link_migration(lineitem, orders):
    """Links rewritten by a map, with the fields that name them."""
    m = orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") + 1000000).alias("n"))
    new = F.coalesce("n", "l_orderkey")
    return lineitem.select("l_orderkey", "l_linenumber").join(m, "l_orderkey", "left").select(F.col("l_orderkey").alias("old_id"), new.alias("new_id"), F.concat(F.lit("order "), new, F.lit(" line "), "l_linenumber").alias("text"), F.col("n").isNotNull().alias("migrated"))


@query()
def tfidf_classifier(documents):
    """Language of held-out documents by hashed character grams and a linear model (Spark ML); accuracy is tested."""
    rows = checkpoint(documents.select("doc_id", "text", F.col("lang").alias("label"), (X.hash_bucket(F.col("doc_id"), 5) == 0).alias("held_out")))
    return B.classify(rows)


@query()
def linear_classifier(documents):
    """Language of held-out documents by a linear model with hinge loss on TF-IDF of the most frequent two- to four-character grams; accuracy is tested."""
    from recordmill.operators import linear as L

    rows = documents.select("doc_id", "text", F.col("lang").alias("label"), (X.hash_bucket(F.col("doc_id"), 5) == 0).alias("held_out"))
    found, _ = L.classified(rows, "doc_id", "label", "held_out", features=20_000)
    return found.select("doc_id", "label", "pred")


@query(f"SELECT t.*, d.source AS answer FROM ({TFIDF_SQL}) t LEFT JOIN documents d ON d.doc_id = t.best")
def retrieval_baseline(benchmark, documents):
    """The answer of the nearest training row of any language, by TF-IDF over grams."""
    from recordmill.operators import similarity as M

    norm = X.collapse_blanks(F.lower("text"))
    top = M.tfidf_top1(stored(M.gram_sets(benchmark, "item_id", norm), "queries"), M.texts_of(documents, "doc_id", norm))
    return top.join(documents.select(F.col("doc_id").alias("best"), F.col("source").alias("answer")), "best", "left").select("id", "best", "cosine", "answer")


@query("""
WITH t AS (SELECT event_type || '::' || CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS target, user_id % 20 AS k, event_id % 5 = 0 AS held_out FROM events), c AS (SELECT k, target, count(*) AS n FROM t WHERE NOT held_out GROUP BY 1, 2), m AS (SELECT k, arg_max(target, (n, target)) AS guess FROM c GROUP BY 1)
SELECT t.k, count(*) AS n, count(*) FILTER (target = guess) AS exact FROM t JOIN m USING (k) WHERE held_out GROUP BY 1""")
def tool_choice_baseline(events):
    """The most frequent composite target of each key in training, scored on the rest."""
    t = events.select(F.concat_ws("::", "event_type", F.when(F.col("value") > 50, "high").otherwise("low")).alias("target"), (F.col("user_id") % 20).alias("k"), (F.col("event_id") % 5 == 0).alias("held_out"))
    m = t.where("NOT held_out").groupBy("k", "target").agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.max_by("target", F.struct("n", "target")).alias("guess"))
    return t.where("held_out").join(m, "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("target") == F.col("guess")).alias("exact"))


_FLAT = [s for v in G.SURFACES.values() for s in v]


@query(f"""
WITH c AS (SELECT unnest({list(G.SURFACES)!r}) AS category, unnest({list(G.SURFACES.values())!r}) AS surfaces),
r AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, CASE WHEN o_orderstatus = 'O' THEN 'compliant' ELSE 'non_compliant' END AS label, {_FLAT!r}[o_orderkey % {len(_FLAT) + 5} + 1] AS old FROM orders),
o AS (SELECT r.*, category, list_filter(surfaces, lambda x: x <> old) AS others FROM r JOIN c ON list_contains(surfaces, old)), v AS (SELECT *, unnest(range(CASE WHEN label = 'compliant' THEN 3 ELSE 1 END)) AS j FROM o),
n AS (SELECT *, others[(i + j) % len(others) + 1] AS action FROM v)
SELECT k || '_actionpara_0' || (j + 1) AS id, k AS source_id, (j + 1)::INTEGER AS variant, category, label, action, replace({G.REQUESTS!r}[(j + 1) % 8 + 1], '{{action}}', action) AS instruction, 'why ' || action AS rationale FROM n""")
def action_paraphrases(orders):
    """Compliance records in other words: one for each, three for compliant ones; the wording of the action is read from its own field or from the rationale."""
    k = F.col("o_orderkey")
    old = F.get(F.array(*map(F.lit, _FLAT)), (k % (len(_FLAT) + 5)).cast("int"))
    rows = orders.select(k.alias("id"), F.when(F.col("o_orderstatus") == "O", "compliant").otherwise("non_compliant").alias("label"), F.when(k % 2 == 0, old).alias("action"), F.lit(None).cast("string").alias("category"), F.lit("asked").alias("instruction"), F.concat(F.lit("why "), old).alias("rationale"))
    return G.paraphrased(rows, ["id"])


@query()
def action_counterfactuals(orders, lineitem):
    """Actions that would have the labels which a state's records lack, two a state at most; held against a plain loop in the tests."""
    from recordmill.plans.state_queries import classified

    k = F.col("scenario_id")
    states = classified(orders, lineitem)
    old = F.get(F.array(*map(F.lit, _FLAT)), (k % len(_FLAT)).cast("int"))
    rows = states.select(k.alias("id"), F.concat_ws(" ", "profile", "severity", (k % 50).cast("string")).alias("summary"), "scenario_id", F.when(k % 3 == 0, "compliant").otherwise("non_compliant").alias("label"), old.alias("action"))
    return G.counterfactual(rows, states, ["id"])
