"""Quality, agreement and calibration statistics; labels.quality is the gold label, rules on length make predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordmill.functions import text as X
from recordmill.operators import linear as L, resampling as Z, stats as S
from recordmill.plans.registry import query
from recordmill.session import stored

LABELLED = "(SELECT doc_id, lang, source, n_chars, quality, toxic, CASE WHEN n_chars > 3000 THEN 2 WHEN n_chars > 1200 THEN 1 ELSE 0 END AS pred, (n_chars % 101) / 100.0::DOUBLE AS prob FROM documents JOIN labels USING (doc_id))"


def labelled(documents, labels):
    pred = F.when(F.col("n_chars") > 3000, 2).when(F.col("n_chars") > 1200, 1).otherwise(0)
    return documents.join(labels, "doc_id").select("doc_id", "lang", "source", "n_chars", "quality", "toxic", pred.alias("pred"), (F.col("n_chars") % 101 / F.lit(100.0)).alias("prob"))


@query("""
WITH c AS (SELECT lang AS a, source AS b, count(*) AS n FROM documents GROUP BY 1, 2), x AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c)
SELECT max(t)::BIGINT AS n, round(sqrt(greatest(0, (sum(n * n / (na * nb)) - 1) / (least(count(DISTINCT a), count(DISTINCT b)) - 1))), 6) AS cramers_v, round(sum(n / t * log2(n * t / (na * nb))), 6) AS mutual_information FROM x""")
def contingency_statistics(documents):
    return S.contingency(documents, "lang", "source")


@query("""
WITH c AS (SELECT lang, count(*) FILTER (n_chars > 1500) AS a, count(*) FILTER (n_chars <= 1500) AS b FROM documents GROUP BY 1), x AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM c)
SELECT round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS js_divergence FROM x""")
def js_divergence(documents):
    return S.js_divergence(documents, "lang", F.col("n_chars") > 1500)


@query("""
WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, max(n_chars) FILTER (i = n // 2) AS median_upper, max(n_chars) FILTER (i = floor(0.95 * (n - 1))) AS p95_floor, max(n_chars) FILTER (i = round_even(0.95::DOUBLE * (n - 1), 0)) AS p95_half_even, max(n_chars) FILTER (i = greatest(0, floor(0.95 * n) - 1)) AS p95_less_one, quantile_cont(n_chars, 0.5) AS median_linear, quantile_cont(n_chars, 0.95) AS p95_linear FROM r GROUP BY 1""")
def quantile_definitions(documents):
    return S.quantiles(documents, ["lang"], "n_chars")


GRID = f"WITH l AS (SELECT unnest([0, 1, 2]::INTEGER[]) AS x), c AS (SELECT quality AS gold, pred, count(*) AS n FROM {LABELLED} GROUP BY 1, 2), m AS (SELECT a.x AS gold, b.x AS pred, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN c ON c.gold = a.x AND c.pred = b.x)"
SCORES = ", s AS (SELECT x AS label, (SELECT sum(n) FROM m WHERE gold = x)::BIGINT AS support, (SELECT sum(n) FROM m WHERE pred = x)::BIGINT AS called, (SELECT sum(n) FROM m WHERE gold = x AND pred = x)::BIGINT AS tp FROM l), f AS (SELECT label, support, coalesce(tp / nullif(called, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(called + support, 0), 0) AS f1 FROM s)"


@query(f"{GRID} SELECT gold, pred, n FROM m")
def confusion_matrix(documents, labels):
    return S.confusion(labelled(documents, labels), "quality", "pred")


@query(f"{GRID}{SCORES} SELECT * FROM f")
def class_scores(documents, labels):
    return S.class_scores(S.confusion(labelled(documents, labels), "quality", "pred"))


@query(f"{GRID}{SCORES} SELECT round(avg(f1), 6) AS macro_f1, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy FROM f")
def macro_f1(documents, labels):
    return S.averages(S.class_scores(S.confusion(labelled(documents, labels), "quality", "pred")))


@query(f"""
SELECT lang, toxic, count(*) AS n, round(avg(CASE WHEN quality = pred THEN 1.0 ELSE 0.0 END), 6) AS exact, round(avg(prob), 6) AS mean_prob FROM {LABELLED} GROUP BY 1, 2""")
def grouped_metric_means(documents, labels):
    j = labelled(documents, labels)
    return j.groupBy("lang", "toxic").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("quality") == F.col("pred"), 1.0).otherwise(0.0)), 6).alias("exact"), F.round(F.avg("prob"), 6).alias("mean_prob"))


@query(f"""
WITH b AS (SELECT prob AS p, quality AS y, least(floor(prob * 10), 9) AS l, greatest(ceil(prob * 10) - 1, 0) AS r FROM {LABELLED})
SELECT (SELECT round(sum(n * abs(p - y)) / sum(n), 6) FROM (SELECT count(*) AS n, avg(p) AS p, avg(y) AS y FROM b GROUP BY l)) AS ece_left_closed, (SELECT round(sum(n * abs(p - y)) / sum(n), 6) FROM (SELECT count(*) AS n, avg(p) AS p, avg(y) AS y FROM b GROUP BY r)) AS ece_right_closed, (SELECT round(avg((p - y) * (p - y)), 6) FROM b) AS brier""")
def calibration(documents, labels):
    return S.calibration(labelled(documents, labels), "prob", F.col("quality") == 1)


@query("""
WITH e AS (SELECT event_id, 1 + value AS a, 1 + (event_id * 37) % 90 AS b, 1 + user_id % 50 AS c, event_id % 3 AS gold FROM events),
p AS (SELECT *, a / (a + b + c) AS pa, b / (a + b + c) AS pb, c / (a + b + c) AS pc FROM e),
t AS (SELECT *, greatest(pa, pb, pc) AS conf, CASE WHEN pa >= pb AND pa >= pc THEN 0 WHEN pb >= pc THEN 1 ELSE 2 END = gold AS hit FROM p),
bins AS (SELECT count(*) AS n, avg(hit::INT::DOUBLE) AS acc, avg(conf) AS conf FROM t GROUP BY greatest(ceil(conf * 10) - 1, 0))
SELECT (SELECT count(*) FROM t) AS n, (SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) FROM bins) AS ece, round(avg(pow(pa - (gold = 0)::INT, 2) + pow(pb - (gold = 1)::INT, 2) + pow(pc - (gold = 2)::INT, 2)), 6) AS brier FROM t""")
def multiclass_calibration(events):
    """Top-label calibration error and Brier score of three-way predictions made from the table's numbers."""
    raw = events.select((1 + F.col("value")).alias("a"), (1 + (F.col("event_id") * 37) % 90).alias("b"), (1 + F.col("user_id") % 50).alias("c"), (F.col("event_id") % 3).cast("int").alias("gold"))
    total = F.col("a") + F.col("b") + F.col("c")
    return S.multiclass_calibration(raw.select(F.array(*[F.col(x) / total for x in "abc"]).alias("probs"), "gold"), "probs", F.col("gold"))


#: Labels that are still sent to each task, so that the texts stay where they are read.
BROADCAST_LABELS = 1 << 20


def seeded_runs(documents, labels):
    """Predictions of quality by linear models of five seeds, for the documents that a hash holds out."""
    side = F.broadcast(labels) if labels.count() <= BROADCAST_LABELS else labels
    rows = documents.join(side, "doc_id").select("doc_id", "text", F.col("quality").cast("string").alias("label"), (X.hash_bucket(F.col("doc_id"), 4) == 0).alias("held_out"))
    found, _ = L.classified(stored(rows, "texts"), "doc_id", "label", "held_out", seeds=[11, 22, 33, 44, 55], loss="modified_huber", features=20_000)
    return found.where("label IS NOT NULL").join(documents.select("doc_id", "source"), "doc_id")


@query()
def seed_stability(documents, labels):
    """Macro-F1 and balanced accuracy of five seeded runs of a linear model, trained on the same rows in orders of their own; held against plain numbers in the tests."""
    return S.run_summary(seeded_runs(documents, labels), "seed", "label", "pred")


@query()
def two_level_interval(documents, labels):
    """The interval of the mean macro-F1 of five runs: runs resampled, then the sources inside each; held against plain resampling in the tests."""
    return Z.two_level_bootstrap(seeded_runs(documents, labels), "source", "label", "pred", "seed", draws=400)


@query()
def clustered_difference(documents, labels):
    """The interval of the difference in macro-F1 of two predictions, sources resampled for both alike; held against plain resampling in the tests."""
    rows = labelled(documents, labels).withColumn("other", F.when(F.col("n_chars") > 1500, 1).otherwise(0))
    return Z.clustered_delta(rows, "source", "quality", "pred", "other", draws=400)


@query("""
WITH q AS (SELECT c_custkey AS q, c_nationkey AS gold, c_acctbal AS x FROM customer), k AS (SELECT s_suppkey AS card, s_nationkey AS nation, s_acctbal AS y FROM supplier),
r AS (SELECT q, gold, nation, abs(x - y) AS d, rank() OVER (PARTITION BY q ORDER BY abs(x - y)) AS rk FROM q, k), b AS (SELECT q, min(rk) FILTER (nation = gold) AS best FROM r GROUP BY 1)
SELECT count(*) AS n, round(avg(CASE WHEN best = 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(coalesce(1.0::DOUBLE / best, 0)), 6) AS mrr, round(avg(best), 6) AS mean_rank, round(count(best) / count(*), 6) AS coverage FROM b""")
def retrieval_metrics(customer, supplier):
    """Rank of the first card of the right kind for each query: one plus the cards that are nearer."""
    q = customer.select(F.col("c_custkey").alias("q"), F.col("c_nationkey").alias("gold"), F.col("c_acctbal").alias("x"))
    b = S.first_right_rank(q, supplier.select(F.col("s_suppkey").alias("card"), F.col("s_nationkey").alias("kind"), F.col("s_acctbal").alias("y")))
    return b.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("best") == 1, 1.0).otherwise(0.0)), 6).alias("top1"), F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("best"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg("best"), 6).alias("mean_rank"), F.round(F.count("best") / F.count(F.lit(1)), 6).alias("coverage"))


@query()
def bootstrap_label_scores(documents, labels):
    """Intervals of macro-F1 and accuracy over rows resampled; held against resampled rows in the tests."""
    return S.bootstrap_labels(labelled(documents, labels), "quality", "pred")


@query()
def bootstrap_paired_difference(documents, labels):
    """The interval of the difference of two predictions' accuracies on the same rows; held against resampled rows in the tests."""
    other = F.when(F.col("n_chars") > 1500, 1).otherwise(0)
    return S.paired_bootstrap(labelled(documents, labels), F.col("quality") == F.col("pred"), F.col("quality") == other)


@query()
def bootstrap_interval(documents, labels):
    """Interval of the mean quality over sources resampled as clusters; deterministic draws by hashing."""
    return S.cluster_bootstrap(labelled(documents, labels), "source", "quality")


TOKENS = "list_filter(string_split(trim(regexp_replace(lower({}), '[ \\t\\n\\r]+', ' ', 'g')), ' '), lambda w: w <> '')"


@query(f"""
WITH p AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
t AS (SELECT conv_id, turn, {TOKENS.format('x')} AS xs, {TOKENS.format('y')} AS ys FROM p),
u AS (SELECT conv_id, turn, w, count(*) FILTER (s = 1) AS a, count(*) FILTER (s = 2) AS b FROM (SELECT conv_id, turn, unnest(xs) AS w, 1 AS s FROM t UNION ALL SELECT conv_id, turn, unnest(ys), 2 FROM t) GROUP BY 1, 2, 3),
m AS (SELECT conv_id, turn, sum(least(a, b)) AS common, count(*) FILTER (a > 0 AND b > 0) AS both_, count(*) AS any_ FROM u GROUP BY 1, 2)
SELECT t.conv_id, t.turn, round(CASE WHEN len(xs) + len(ys) = 0 THEN 1.0 ELSE 2 * coalesce(common, 0) / (len(xs) + len(ys)) END, 6) AS token_f1, round(CASE WHEN any_ IS NULL THEN 1.0 ELSE both_ / any_ END, 6) AS jaccard, trim(regexp_replace(x, '[ \\t\\n\\r]+', ' ', 'g')) = trim(regexp_replace(y, '[ \\t\\n\\r]+', ' ', 'g')) AS exact
FROM (SELECT t.*, p.x, p.y FROM t JOIN p USING (conv_id, turn)) t LEFT JOIN m USING (conv_id, turn)""")
def token_f1_pairs(conversations):
    """Multiset F1, set Jaccard and exact match of each turn and the next."""
    nxt = conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y"))
    p = conversations.select("conv_id", "turn", F.col("text").alias("x")).join(nxt, ["conv_id", "turn"]).withColumns({"xs": X.words(F.col("x")), "ys": X.words(F.col("y"))})
    each = lambda c, s: p.select("conv_id", "turn", F.explode(c).alias("w"), F.lit(s).alias("s"))
    u = each("xs", 1).unionAll(each("ys", 2)).groupBy("conv_id", "turn", "w").agg(F.count_if(F.col("s") == 1).alias("a"), F.count_if(F.col("s") == 2).alias("b"))
    m = u.groupBy("conv_id", "turn").agg(F.sum(F.least("a", "b")).alias("common"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("both"), F.count(F.lit(1)).alias("any"))
    total = F.size("xs") + F.size("ys")
    return p.join(m, ["conv_id", "turn"], "left").select("conv_id", "turn", F.round(F.when(total == 0, 1.0).otherwise(2 * F.coalesce("common", F.lit(0)) / total), 6).alias("token_f1"), F.round(F.coalesce(F.col("both") / F.col("any"), F.lit(1.0)), 6).alias("jaccard"), (X.collapse_blanks(F.col("x")) == X.collapse_blanks(F.col("y"))).alias("exact"))
