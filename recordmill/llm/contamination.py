"""Benchmark decontamination by a broadcast hash set of word windows (operator 11), in DataFrame functions only.

The words of every benchmark item are cut to windows of WINDOW words (an item of fewer words is one window), and the distinct windows, each with the items that hold it, are
the build side of a broadcast hash join by a 64-bit hash. A document's words are hashed once, all its windows run past that hash set as they are generated, and a hit is verified
word by word in the same pass: only hits, and one row for each document, are shuffled, never a text. Items that share a window cost one entry with several items.

The broadcast has a size bound: the benchmark's words are counted first, and beyond BENCHMARK_WORDS of them hashes are joined in a shuffle (adaptive execution splits a hot one), and
what they find is verified against the documents afterwards; the results are the same.

Defined results: a null text has no words; a document without hits has zero hits and items; an item without words has no window; an item_id that repeats is one item; a null
item_id is written as an empty string; repeated documents are scanned alike and stay repeated; empty tables on either side give no hits; columns of the documents that
clash with results or inner names are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordmill.session import checkpoint

WINDOW = 10
#: Words of a benchmark whose windows are still broadcast; about 150 bytes each in an executor's memory.
BENCHMARK_WORDS = 1 << 20
#: Contaminated documents whose spans are still broadcast to the documents.
BROADCAST_SPANS = 1 << 16
WORD, ANY_CASE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["doc_id", "k1", "k2"]


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case; none of a null text."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _made(frame: DataFrame, name: str, value: Column) -> DataFrame:
    """frame with a column that later steps may use more than once, also inside a lambda, without its being made again: a generator holds it."""
    return frame.select(*frame.columns, F.explode(F.array(value)).alias(name))


def _window_hash(hashes: Column, start: Column, size: Column, sizes: list[int]) -> Column:
    """A hash of the word hashes of a window, one after the other: no window is copied for it."""
    out = F.lit(None).cast("bigint")
    for k in sizes:
        out = F.when(size == k, F.xxhash64(*[F.get(hashes, start + j) for j in range(k)])).otherwise(out)
    return out


def _window_text(words: Column, start: Column, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def benchmark_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The distinct windows of all items: h, window (its words joined by spaces), size and the sorted items that hold it."""
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words"))
    # equal items are cut once
    items = items.where(F.size("words") > 0).groupBy("words").agg(F.collect_set("item").alias("own"))
    items = _made(items, "hashes", F.transform("words", lambda w: F.xxhash64(w)))
    size = F.least(F.size("words"), F.lit(window))
    cut = items.select("own", "words", "hashes", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("i"))
    cut = cut.select("own", "size", _window_hash(F.col("hashes"), F.col("i"), F.col("size"), [*range(1, window + 1)]).alias("h"), _window_text(F.col("words"), F.col("i"), F.col("size")).alias("window"))
    return cut.groupBy("h", "window", "size").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("own")))).alias("items"))


def _each_window(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each window (start, size, h) of each of rows, and one with nulls for the row itself."""
    n, step = F.size("words"), max(sizes, default=0) + 1
    rows = _made(rows, "hashes", F.transform("words", lambda w: F.xxhash64(w)))
    # a window as one number: its start times step, and its size
    places = [F.when(n >= k, F.sequence(F.lit(k), (n - k) * step + k, F.lit(step))).otherwise(F.array().cast("array<int>")) for k in sizes]
    each = rows.select("*", F.explode(F.concat(F.array(F.lit(-1)), *places)).alias("place"))
    real = F.col("place") >= 0
    each = each.withColumns({"start": F.when(real, F.floor(F.col("place") / step).cast("int")), "size": F.when(real, F.col("place") % step)})
    return each.withColumn("h", _window_hash(F.col("hashes"), F.col("start"), F.col("size"), sizes)).drop("place", "hashes")


def _verified(found: DataFrame) -> DataFrame:
    """Hits whose words are those of the window, and the rows that stand for documents."""
    true = _window_text(F.col("words"), F.col("start"), F.col("size")) == F.col("window")
    return found.where(F.col("start").isNull() | F.coalesce(true, F.lit(False))).select(*KEY, F.size("words").cast("long").alias("n_words"), "start", "size", "items")


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, benchmark_words: int = BENCHMARK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document (doc_id, and k1 and k2, two hashes of its text) with n_words, spans (start and end in words, end exclusive, apart and in order), n_hit (words inside them), items
    (sorted, those with a window that occurs) and contaminated."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"), F.explode(F.array(words_of(text))).alias("words"))
    windows = benchmark_windows(bench, window)
    sizes = bench.select(F.size(words_of(F.col("text"))).alias("n")).where("n > 0").select("n", F.least("n", F.lit(window)).alias("size"))
    seen = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.collect_set("size").alias("sizes")).first()
    if seen["n"] <= benchmark_words:
        each = _each_window(rows, sorted(seen["sizes"]))
        found = _verified(each.join(F.broadcast(windows.withColumnRenamed("size", "held").drop("held")), "h", "left"))
    else:
        found = _found_by_shuffle(rows, windows, sorted(seen["sizes"]))
    by_doc = found.groupBy(*KEY).agg(
        F.first("n_words").alias("n_words"),
        F.count_if(F.col("start").isNull()).alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", (F.col("start") + F.col("size")).alias("end"))))).alias("hits"),
        F.collect_set("items").alias("items"),
    )
    by_doc = _made(by_doc, "covered", F.sort_array(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["end"] - 1))))))
    near = lambda i: F.get(F.col("covered"), i)
    starts = F.filter("covered", lambda p, i: (i == 0) | (near(i - 1) < p - 1))
    ends = F.filter("covered", lambda p, i: (i == F.size("covered") - 1) | (near(i + 1) > p + 1))
    out = by_doc.select(
        *KEY,
        "copies",
        "n_words",
        F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end"))).alias("spans"),
        F.size("covered").cast("long").alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten("items"))).alias("items"),
    )
    out = out.select("*", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int"))).alias("copy"))
    return out.withColumn("contaminated", F.col("n_hit") > 0).drop("copies", "copy")


def _found_by_shuffle(rows: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """What _verified gives, for a benchmark that is too large to broadcast: hashes travel, texts don't; candidates are verified where the documents are read again."""
    each = _each_window(rows, sizes).where(F.col("start").isNotNull()).select(*KEY, "h", "start", "size").distinct()
    # each place of a text once, however often the text repeats
    met = each.join(windows.select("h", "size", "window", "items"), ["h", "size"])
    met = met.groupBy(*[F.col(k).alias(f"{k}_met") for k in KEY]).agg(F.collect_list(F.struct("start", "size", "window", "items")).alias("met"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_met")) for k in KEY]
    both = rows.join(met, same[0] & same[1] & same[2], "left")
    itself = F.array(F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("string").alias("window"), F.lit(None).cast("array<string>").alias("items")))
    return _verified(both.select(*KEY, "words", F.explode(F.concat(itself, F.coalesce("met", F.array().cast(met.schema["met"].dataType)))).alias("x")).select(*KEY, "words", "x.*"))


def _with_spans(docs: DataFrame, bench: DataFrame, broadcast_spans: int, how: dict) -> DataFrame:
    """docs with __spans and __n_words, null where nothing is hit. Spans are few beside texts: they are broadcast where a count allows it, and texts are shuffled otherwise."""
    id_col, text_col = how.get("id_col", "doc_id"), how.get("text_col", "text")
    spans = checkpoint(contamination(docs, bench, **how).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("spans").alias("__spans"), F.col("n_words").alias("__n_words")).dropDuplicates(["__id", "__k1", "__k2"]))
    side = F.broadcast(spans) if spans.count() <= broadcast_spans else spans
    same = F.xxhash64(docs[text_col]).eqNullSafe(F.col("__k1")) & F.xxhash64(docs[text_col], F.lit(1)).eqNullSafe(F.col("__k2")) & docs[id_col].eqNullSafe(F.col("__id"))
    return docs.join(side, same, "left").select(*[docs[c] for c in docs.columns], "__spans", "__n_words")


def without_spans(docs: DataFrame, bench: DataFrame, broadcast_spans: int = BROADCAST_SPANS, **how) -> DataFrame:
    """docs with the words of all spans taken out of their texts, each with what stands between it and the next word; other texts stay as they are."""
    found, text = _with_spans(docs, bench, broadcast_spans, how), F.col(how.get("text_col", "text"))
    hit, others = found.where(F.col("__spans").isNotNull()), found.where(F.col("__spans").isNull())
    # a text is what stands before its first word, then each word with what follows it
    hit = _made(_made(hit, "__words", F.regexp_extract_all(text, F.lit(ANY_CASE), F.lit(0))), "__between", F.split(text, ANY_CASE, -1))
    starts = F.concat(F.array(F.lit(0)), F.transform("__spans", lambda x: x["end"]))
    ends = F.concat(F.transform("__spans", lambda x: x["start"]), F.array(F.size("__words")))
    part = lambda a, b: F.zip_with(F.slice("__words", a + 1, b - a), F.slice("__between", a + 2, b - a), lambda w, x: F.concat(w, x))
    kept = F.array_join(F.flatten(F.zip_with(starts, ends, part)), "")
    cut = hit.withColumn(how.get("text_col", "text"), F.concat(F.get("__between", F.lit(0)), kept))
    return others.select(*docs.columns).unionByName(cut.select(*docs.columns))


def without_documents(docs: DataFrame, bench: DataFrame, share: float = 0.0, broadcast_spans: int = BROADCAST_SPANS, **how) -> DataFrame:
    """docs of which at most this share of words is hit (0: none)."""
    found = _with_spans(docs, bench, broadcast_spans, how)
    hit = F.aggregate("__spans", F.lit(0), lambda n, x: n + x["end"] - x["start"])
    return found.where(F.coalesce(hit <= F.lit(share) * F.col("__n_words"), F.lit(True))).select(*docs.columns)


def op11(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The contract's columns of every document."""
    found = contamination(docs, bench)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
OP11_SQL = f"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS ws FROM benchmark),
s AS (SELECT item, ws, least(len(ws), {WINDOW}) AS k FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM s)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
dw AS (SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS w FROM (SELECT r, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM s))),
hit AS (SELECT DISTINCT r, k, i, item FROM dw JOIN bw USING (k, w)),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, k, i FROM hit)) GROUP BY 1),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS own FROM (SELECT DISTINCT r, item FROM hit) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(own, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)
"""
