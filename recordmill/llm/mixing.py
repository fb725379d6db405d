"""Mixing sources to target weights by Poisson replication (operator 2).

Every source has a mean repetition rate: its target share of the output over its share of the input. Each document
draws a count from a Poisson distribution with that mean by inversion of a uniform number made from its key's
hash, so the draw is the same on every run and machine; it is then repeated that often, and all copies are dealt out
anew by the hash of key and copy, which is a global shuffle.

Rates above STEP are drawn as sums of independent Poisson counts with equal means of at most STEP, so that the
inversion never leaves double precision and no rate is cut off.

Defined results: a null source is a source of its own; a null size counts as 0; sources with no size get rate 1;
rows that repeat a doc_id draw alike; empty tables give empty results; columns of the input that clash with
results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Greatest mean of one inversion; exp(-STEP) is far from the least double.
STEP = 16.0
#: Steps of one inversion: P(Poisson(16) > 120) is below 2^-52, the grain of the uniform numbers, so no draw reaches the end.
DEPTH = 120
#: Rates are broadcast up to so many sources (a row is under 300 bytes), beyond that joined by a shuffle.
BROADCAST_SOURCES = 100_000
ALPHA = 0.5


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts: its first 13 hex digits over 2^52."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, source: str = "source", size: str = "n_chars", total: float | None = None) -> DataFrame:
    """(source, n_docs, size, weight, rate) over all documents.

    weights are target shares by source (others get 0); without them the share of a source is its size to the power alpha, normalised. The rate
    is share * total / size, where total is the size of the output, by default that of the input.
    """
    per = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(F.col(size).cast("long")), F.lit(0)).alias("size"))
    if weights is None:
        raw = F.pow(F.col("size").cast("double"), F.lit(alpha))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else None
        raw = F.coalesce(given[F.col("source")], F.lit(0.0)) if weights else F.lit(0.0)
    per = per.withColumn("raw", raw)
    whole = per.agg(F.sum("raw").alias("all_raw"), F.sum("size").alias("all_size"))
    per = per.join(F.broadcast(whole))  # one row
    target = F.lit(float(total)) if total is not None else F.col("all_size").cast("double")
    weight = F.when(F.col("all_raw") > 0, F.col("raw") / F.col("all_raw")).otherwise(F.lit(0.0))
    rate = F.when(F.col("size") > 0, F.col("weight") * target / F.col("size")).otherwise(F.lit(1.0))
    return per.withColumn("weight", weight).withColumn("rate", F.round(rate, 9)).select("source", "n_docs", "size", "weight", "rate")


def poisson(rate: Column, key: Column, seed: int) -> Column:
    """A Poisson count of this mean for this key, by inversion; a rate above STEP is drawn in equal parts."""
    parts = F.greatest(F.lit(1), F.ceil(rate / STEP)).cast("int")
    mean = rate / parts

    def one(u: Column) -> Column:
        # state: probability of k, cumulated probability, count
        start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))
        step = lambda s, k: F.when(u < s["c"], s).otherwise(F.struct((s["p"] * mean / k).alias("p"), (s["c"] + s["p"] * mean / k).alias("c"), k.cast("int").alias("k")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), start, step, lambda s: s["k"])

    drawn = F.transform(F.sequence(F.lit(1), parts), lambda part: uniform(F.lit(seed), key, part))  # bound once, not at every step
    return F.aggregate(F.transform(drawn, one), F.lit(0), lambda a, b: a + b)


def replicated(docs: DataFrame, rates: DataFrame, source: str = "source", key: str = "doc_id", seed: int = 17, shuffle: bool = True) -> DataFrame:
    """Each row of docs as often as its draw says, with copy (1, 2, ...), copies and mix_key; shuffled globally by mix_key.

    The shuffle moves each copy's row once: partitions by the hash of (key, copy), rows in the order of mix_key within them.
    """
    kept = docs.drop("copy", "copies", "mix_key")
    few = rates.select(F.col("source").alias("__s"), F.col("rate").alias("__rate"))
    if rates.count() <= BROADCAST_SOURCES:
        few = F.broadcast(few)
    joined = kept.join(few, kept[source].eqNullSafe(few["__s"]))
    drawn = joined.withColumn("copies", poisson(F.col("__rate"), F.coalesce(F.col(key).cast("string"), F.lit("")), seed)).drop("__s", "__rate")
    each = drawn.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    each = each.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"mix{seed}"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("copy"))))
    if not shuffle:
        return each
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return each.repartition(n, "mix_key").sortWithinPartitions("mix_key")


def op2(docs: DataFrame) -> DataFrame:
    """All documents mixed to square-root weights, with their texts."""
    rates = source_rates(docs.select("source", "n_chars"))
    return replicated(docs.select("doc_id", "text", "lang", "source", "n_chars"), rates)


OP2_SQL = f"""
WITH RECURSIVE per AS (
  SELECT source, COALESCE(SUM(n_chars), 0)::BIGINT AS size FROM documents GROUP BY source),
raw AS (SELECT source, size, pow(size::DOUBLE, {ALPHA}) AS w FROM per),
rates AS (
  SELECT source, round(CASE WHEN size > 0 THEN (CASE WHEN sum(w) OVER () > 0 THEN w / sum(w) OVER () ELSE 0 END) * (sum(size) OVER ())::DOUBLE / size ELSE 1.0 END, 9) AS rate FROM raw),
steps AS (
  SELECT source, GREATEST(1, ceil(rate / {STEP}))::INT AS parts, rate / GREATEST(1, ceil(rate / {STEP})) AS mean FROM rates),
cdf AS (
  SELECT source, parts, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM steps
  UNION ALL
  SELECT source, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < {DEPTH}),
tables AS (SELECT source, parts, list(c ORDER BY k) AS cs FROM cdf GROUP BY source, parts),
draws AS (
  SELECT d.*, CAST(list_sum(list_transform(range(1, t.parts + 1), lambda i:
    least({DEPTH}, len(list_filter(t.cs, lambda x: x <= CAST(('0x' || substr(md5('17:' || COALESCE(CAST(d.doc_id AS VARCHAR), '') || ':' || i), 1, 13)) AS BIGINT) / 4503599627370496.0))))) AS INTEGER) AS copies
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, text, lang, source, n_chars, copies, copy,
  md5('mix17:' || COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || copy) AS mix_key
FROM (SELECT *, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM draws WHERE copies > 0)
"""
