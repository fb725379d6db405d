"""Grouped counts, duplicate and purity profiles, ledgers and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordmill.functions import text as X
from recordmill.plans.record_joins import NORM
from recordmill.plans.registry import query


@query("SELECT lang, source, count(*) AS n, grouping_id(lang, source) AS level FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())")
def grouped_counts(documents):
    return documents.groupingSets([["lang", "source"], ["lang"], ["source"], []], "lang", "source").agg(F.count(F.lit(1)).alias("n"), F.grouping_id("lang", "source").alias("level"))


@query("SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS statuses, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders")
def distinct_value_sets(orders):
    return orders.agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderstatus").alias("statuses"), F.count_distinct(F.to_date("o_orderdate")).alias("days"))


@query("""
WITH s AS (SELECT DISTINCT l_returnflag || l_linestatus AS g, l_partkey AS k FROM lineitem)
SELECT a.g AS a, b.g AS b, count(*) AS n FROM s a JOIN s b ON a.k = b.k GROUP BY 1, 2""")
def pairwise_overlap_matrix(lineitem):
    """Sizes of the intersections of all pairs of sets. A key's sets are an array no longer than the number of sets, so each key gives few pairs."""
    per = lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("g"), F.col("l_partkey").alias("k")).groupBy("k").agg(F.collect_set("g").alias("s"))
    return per.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH s AS (SELECT sha256({NORM}) AS sig, lang, source FROM documents), g AS (SELECT sig, count(*) AS n, count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources FROM s GROUP BY 1)
SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_unique, count(*) FILTER (n > 1) AS duplicate_groups, (sum(n) - count(*))::BIGINT AS extra_rows, count(*) FILTER (n > 1 AND langs > 1) AS conflicting, count(*) FILTER (n > 1 AND sources > 1) AS cross_source, round(count(*) / sum(n), 6) AS unique_rate FROM g""")
def duplicate_profile(documents):
    g = documents.groupBy(F.sha2(X.collapse_blanks(F.lower("text")), 256).alias("sig")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("langs"), F.count_distinct("source").alias("sources"))
    many = F.col("n") > 1
    return g.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_unique"), F.count_if(many).alias("duplicate_groups"), (F.sum("n") - F.count(F.lit(1))).alias("extra_rows"), F.count_if(many & (F.col("langs") > 1)).alias("conflicting"), F.count_if(many & (F.col("sources") > 1)).alias("cross_source"), F.round(F.count(F.lit(1)) / F.sum("n"), 6).alias("unique_rate"))


@query("""
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), g AS (SELECT source, max(n) AS best, sum(n) AS n FROM c GROUP BY 1)
SELECT count(*) AS n_groups, count(*) FILTER (best = n) AS pure_groups, round(sum(best) / sum(n), 6) AS purity FROM g WHERE n >= 3""")
def label_purity(documents):
    g = documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.max("n").alias("best"), F.sum("n").alias("n")).where("n >= 3")
    return g.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("best") == F.col("n")).alias("pure_groups"), F.round(F.sum("best") / F.sum("n"), 6).alias("purity"))


@query("""
WITH f AS (SELECT unnest(['brand', 'type', 'size']) AS field, unnest([p_brand, p_type, CAST(p_size AS VARCHAR)]) AS value, p_partkey % 3 AS label FROM part), c AS (SELECT field, value, label, count(*) AS n FROM f GROUP BY ALL), g AS (SELECT field, value, max(n) AS best, sum(n) AS n FROM c GROUP BY ALL)
SELECT field, count(*) AS n_values, round(sum(best) / sum(n), 6) AS purity, round(sum(n) FILTER (n >= 3) / sum(n), 6) AS repeated_rate, round(coalesce(sum(n) FILTER (n >= 3 AND best = n), 0) / sum(n), 6) AS pure_rate FROM g GROUP BY 1""")
def input_proxy_diagnostics(part):
    """How well the value of each single field gives away the label."""
    f = part.select((F.col("p_partkey") % 3).alias("label"), F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).cast("string").alias("value")) for n, c in (("brand", "p_brand"), ("type", "p_type"), ("size", "p_size"))])).alias("f"))
    g = f.groupBy("f.field", "f.value", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("field", "value").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    share = lambda c: F.round(F.sum(F.when(c, F.col("n")).otherwise(0)) / F.sum("n"), 6)
    return g.groupBy("field").agg(F.count(F.lit(1)).alias("n_values"), F.round(F.sum("best") / F.sum("n"), 6).alias("purity"), share(F.col("n") >= 3).alias("repeated_rate"), share((F.col("n") >= 3) & (F.col("best") == F.col("n"))).alias("pure_rate"))


@query("SELECT lang, count(*) AS n, count(quality) AS with_quality, count(*) FILTER (toxic = 1) AS with_toxic, count(*) FILTER (contains(text, 'http')) AS with_link FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def coverage_counts(documents, labels):
    j = documents.join(labels, "doc_id", "left")
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("with_quality"), F.count_if(F.col("toxic") == 1).alias("with_toxic"), F.count_if(F.contains("text", F.lit("http"))).alias("with_link"))


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY 1")
def pivot_counts(documents):
    return documents.groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).count().fillna(0)


@query("""
SELECT user_id % 10 AS system, count(*) AS registered, count(*) FILTER (event_type = 'purchase') AS converged, min(CASE WHEN event_type = 'purchase' THEN value END) AS min_margin, round(count(*) FILTER (event_type = 'purchase') / nullif(count(*), 0), 6) AS rate FROM events GROUP BY 1""")
def ledger_rollup(events):
    """Failures stay in the denominator; margins are of the converged only."""
    ok = F.col("event_type") == "purchase"
    return events.groupBy((F.col("user_id") % 10).alias("system")).agg(F.count(F.lit(1)).alias("registered"), F.count_if(ok).alias("converged"), F.min(F.when(ok, F.col("value"))).alias("min_margin"), F.round(F.try_divide(F.count_if(ok), F.count(F.lit(1))), 6).alias("rate"))


@query("""
SELECT o_orderpriority, count(*) AS n, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS worst, min(o_totalprice) AS worst_value FROM orders GROUP BY 1""")
def worst_case(orders):
    return orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("worst"), F.min("o_totalprice").alias("worst_value"))


@query("""
SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_tax > 0.07 THEN 'tax' END, CASE WHEN l_quantity > 45 THEN 'quantity' END], lambda x: x IS NOT NULL)) AS reason FROM lineitem) GROUP BY 1""")
def reason_counts(lineitem):
    reasons = F.array_compact(F.array(F.when(F.col("l_discount") > 0.08, "discount"), F.when(F.col("l_tax") > 0.07, "tax"), F.when(F.col("l_quantity") > 45, "quantity")))
    return lineitem.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT bool_and(o_totalprice >= 0) AS prices, bool_and(o_orderkey IS NOT NULL) AS keys, count(*) = count(DISTINCT o_orderkey) AS unique_keys, CASE WHEN bool_and(o_totalprice >= 0) AND bool_and(o_orderkey IS NOT NULL) AND count(*) = count(DISTINCT o_orderkey) THEN 'pass' ELSE 'fail' END AS status FROM orders""")
def gate_summary(orders):
    g = orders.agg(F.bool_and(F.col("o_totalprice") >= 0).alias("prices"), F.bool_and(F.col("o_orderkey").isNotNull()).alias("keys"), (F.count(F.lit(1)) == F.count_distinct("o_orderkey")).alias("unique_keys"))
    return g.withColumn("status", F.when(F.col("prices") & F.col("keys") & F.col("unique_keys"), "pass").otherwise("fail"))


@query("""
WITH g AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS k FROM g)
SELECT count(*) AS n_groups, max(n) AS largest, max(n) FILTER (i = floor(0.95 * (k - 1))) AS p95 FROM r""")
def group_size_p95(conversations):
    """Size statistics of atomic groups. Ranks are taken over the histogram of sizes, not over the groups."""
    g = conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("n_groups"), F.max("n").alias("largest")).join(F.broadcast(_rank95(g)))


def _rank95(g):
    from pyspark.sql import Window

    hist = g.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    run = hist.withColumn("upto", F.sum("c").over(Window.orderBy("n"))).join(F.broadcast(hist.agg(F.sum("c").alias("k"))))
    return run.where(F.col("upto") > F.floor(0.95 * (F.col("k") - 1))).agg(F.min("n").alias("p95"))


@query("""
SELECT role, count(*) AS n, round(avg(CASE WHEN contains(lower(text), lang) THEN 1.0 ELSE 0.0 END), 6) AS mention_rate FROM (SELECT role, text, ['th', 'de', 'la'][1 + CAST(conv_id % 3 AS INTEGER)] AS lang FROM conversations) GROUP BY 1""")
def mention_rates(conversations):
    value = F.element_at(F.array(*map(F.lit, ("th", "de", "la"))), (F.col("conv_id") % 3 + 1).cast("int"))
    return conversations.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.contains(F.lower("text"), value), 1.0).otherwise(0.0)), 6).alias("mention_rate"))


@query("""
SELECT coalesce(lang, 'all') AS family, count(*) AS n, round(avg(CASE WHEN quality = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (SELECT lang, quality, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS pred FROM documents JOIN labels USING (doc_id)) GROUP BY ROLLUP (lang)""")
def subset_scores(documents, labels):
    j = documents.join(labels, "doc_id").withColumn("hit", F.when(F.col("quality") == F.when(F.col("n_chars") > 1500, 1).otherwise(0), 1.0).otherwise(0.0))
    return j.rollup("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("accuracy")).select(F.coalesce("lang", F.lit("all")).alias("family"), "n", "accuracy")


@query("SELECT count(*) AS n, count(*) FILTER (l_quantity > 10) AS tier1, count(*) FILTER (l_quantity > 25 AND l_discount > 0.02) AS tier2, count(*) FILTER (l_quantity > 40 AND l_discount > 0.05) AS tier3 FROM lineitem")
def tier_counts(lineitem):
    q, d = F.col("l_quantity"), F.col("l_discount")
    return lineitem.agg(F.count(F.lit(1)).alias("n"), F.count_if(q > 10).alias("tier1"), F.count_if((q > 25) & (d > 0.02)).alias("tier2"), F.count_if((q > 40) & (d > 0.05)).alias("tier3"))


@query("""
SELECT l_returnflag AS fold, round(avg(CASE WHEN l_linenumber = CAST(l_quantity AS INTEGER) % 7 + 1 THEN 1.0 ELSE 0.0 END), 6) AS number_copied, round(avg(CASE WHEN coalesce(nullif(l_linestatus, 'O'), l_returnflag) = l_returnflag THEN 1.0 ELSE 0.0 END), 6) AS flag_copied FROM lineitem GROUP BY 1""")
def copy_control_accuracy(lineitem):
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return lineitem.groupBy(F.col("l_returnflag").alias("fold")).agg(rate(F.col("l_linenumber") == F.col("l_quantity").cast("int") % 7 + 1).alias("number_copied"), rate(F.coalesce(F.nullif("l_linestatus", F.lit("O")), "l_returnflag") == F.col("l_returnflag")).alias("flag_copied"))


@query("""
WITH s AS (SELECT o_orderstatus || '/' || o_orderpriority AS sig, o_orderstatus AS abstract FROM orders), g AS (SELECT sig, count(*) AS n FROM s GROUP BY 1)
SELECT count(*) AS n_unique, count(*) FILTER (n = 1) AS singletons, max(n) AS largest, quantile_cont(n, 0.5) AS median, (SELECT count(DISTINCT abstract) FROM s) AS n_abstract FROM g""")
def signature_multiplicity(orders):
    g = orders.groupBy(F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("sig"), F.col("o_orderstatus").alias("abstract")).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("n_unique"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"), F.percentile("n", 0.5).alias("median"), F.count_distinct("abstract").alias("n_abstract"))


@query("""
SELECT source, count(*) AS n, round(avg(n_chars), 6) AS mean, min(n_chars) AS least, quantile_cont(n_chars, 0.1) AS p10 FROM documents GROUP BY 1 ORDER BY mean, n DESC, source LIMIT 5""")
def worst_groups(documents):
    g = documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.min("n_chars").alias("least"), F.percentile("n_chars", 0.1).alias("p10"))
    return g.orderBy("mean", F.desc("n"), "source").limit(5)


@query("""
SELECT event_type, count(*) AS n, round(avg(CASE WHEN json_valid(props) THEN 1.0 ELSE 0.0 END), 6) AS json_rate, round(avg(CASE WHEN json_extract_string(props, '$.k') IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS key_rate, round(avg(length(props)), 6) AS mean_length FROM events GROUP BY 1""")
def structure_coverage(events):
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), rate(F.get_json_object("props", "$").isNotNull()).alias("json_rate"), rate(F.get_json_object("props", "$.k").isNotNull()).alias("key_rate"), F.round(F.avg(F.length("props")), 6).alias("mean_length"))


@query("""
SELECT l_orderkey, max(l_extendedprice / nullif(l_quantity, 0)) AS worst_ratio, count(*) FILTER (l_quantity = 0) AS n_unrated, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) FILTER (l_tax > 0.07) AS flagged FROM lineitem GROUP BY 1""")
def row_maxima(lineitem):
    flagged = F.nullif(F.array_join(F.sort_array(F.collect_set(F.when(F.col("l_tax") > 0.07, F.col("l_linenumber").cast("string")))), ","), F.lit(""))
    return lineitem.groupBy("l_orderkey").agg(F.max(F.try_divide("l_extendedprice", "l_quantity")).alias("worst_ratio"), F.count_if(F.col("l_quantity") == 0).alias("n_unrated"), flagged.alias("flagged"))


@query("SELECT l_returnflag AS load, l_linestatus AS factor, count(*) AS attempted, count(*) FILTER (l_discount < 0.05) AS passed, count(DISTINCT l_suppkey) FILTER (l_discount < 0.05) AS passed_pairs FROM lineitem GROUP BY 1, 2")
def diversity_census(lineitem):
    ok = F.col("l_discount") < 0.05
    return lineitem.groupBy(F.col("l_returnflag").alias("load"), F.col("l_linestatus").alias("factor")).agg(F.count(F.lit(1)).alias("attempted"), F.count_if(ok).alias("passed"), F.count_distinct(F.when(ok, F.col("l_suppkey"))).alias("passed_pairs"))
