"""Document fingerprints by MinHash (operator 10).

A text's shingles of five lower-cased words are hashed, put through PERMUTATIONS universal hash functions ((a x + b) mod 2^64,
upper bits) in numpy, and the least value of each kept to 16 bits is the signature. The likeness of two signatures is the
share of equal places, an estimate of the Jaccard similarity. near_groups() joins bands of the signatures in Spark and verifies
the exact Jaccard similarity of what shares a band.

Defined results: a null text is an empty text; a text of fewer words than a shingle is one shingle; texts without words share
one signature; equal texts have equal signatures; upper case is A to Z only; rows that repeat a doc_id follow each other in the order of the
hashes of their texts; a null doc_id comes first; the row after the last is the first, so that a single row follows itself; an empty table
gives an empty result; columns of the input that clash with results are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recordmill.llm.batches import slices
from recordmill.llm.simhash import exact_links, shingle_set
from recordmill.operators.components import connected_components
from recordmill.session import checkpoint, stored

PERMUTATIONS, WIDTH, BANDS = 64, 5, 16
SIMILARITY = 0.8
_rng = np.random.default_rng(10)
_A = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_C = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 2048


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """32-bit hashes of the shingles of a text, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # A-Z only, and the six ASCII white-space bytes
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    mixed = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        mixed = (mixed ^ each[k : k + n]) * _C[k % 64]
        mixed ^= mixed >> np.uint64(29)
    return (mixed * _C[63]) >> np.uint64(32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """PERMUTATIONS numbers of 16 bits; of no shingles, the greatest of each."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), _BLOCK):
        np.minimum(least, (_A[:, None] * hashes[None, i : i + _BLOCK] + _B[:, None]).min(axis=1), out=least)
    # the least values crowd near zero: their lower half of bits tells them apart
    return ((least * _C[62]) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / PERMUTATIONS


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by as many of the start of following."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


RESULT = "doc_id long, n_chars long, edited_sha256 string, print binary, edited_print binary, near_edited double, near_next double"


def _row(doc_id, text: str, sig: np.ndarray, following: str, next_sig: np.ndarray) -> tuple:
    new = edited(text, following)
    other = sig if new == text else signature(shingles(new))
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), sig.tobytes(), other.tobytes(), likeness(sig, other), likeness(sig, next_sig)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
_NAMES = ["doc_id", "n_chars", "edited_sha256", "print", "edited_print", "near_edited", "near_next"]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT of every document. One shuffle by range of doc_id; the first and last text of each partition come out beside the
    results and are put together by the partitions' numbers afterwards, so no task sees more than its range."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, first = TaskContext.get().partitionId(), None, True
        names, types = [*_NAMES, "edge", "part", "text"], [*_TYPES, pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                sig = signature(shingles(text))
                if first:
                    out.append((doc_id, None, None, None, None, None, None, 0, part, text))
                    first = False
                else:
                    out.append((*_row(*held, text, sig), None, part, None))
                held = (doc_id, text, sig)
            yield _batch(out, names, types)
        if held is not None:
            yield _batch([(held[0], None, None, None, None, None, None, 1, part, held[1])], names, types)

    made = stored(dealt.mapInArrow(run, RESULT + ", edge int, part int, text string"), "minhash")
    firsts = made.where("edge = 0").select("part", F.col("text").alias("following"))
    lasts = made.where("edge = 1").select("part", "doc_id", "text")
    # the next part that holds rows; part numbers only, one for each partition
    from pyspark.sql import Window

    order = Window.orderBy("part")
    parts = firsts.select("part")
    to = parts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))
    seams = lasts.join(to, "part").join(firsts.withColumnRenamed("part", "to"), "to").select("doc_id", "text", "following")

    def sew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([_row(d, t, signature(shingles(t)), f, signature(shingles(f))) for d, t, f in zip(*(c.to_pylist() for c in batch.columns), strict=True)], _NAMES, _TYPES)

    return made.where("edge IS NULL").select(*_NAMES).union(seams.mapInArrow(sew, RESULT))


def op10(docs: DataFrame) -> DataFrame:
    """The contract's columns of every document; a fingerprint is 4 hex digits for each permutation."""
    out = with_next(docs)
    return out.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("print")).alias("fingerprint"), F.lower(F.hex("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next")


# ---- near-duplicate groups by bands ----


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, s0, s1, print) of every row: the hash of its text, a 128-bit hash of the set of shingles, and the signature."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh128_digest

        for whole in batches:
            for batch in slices(whole, 1):
                grams = [np.unique(shingles(t.as_py())) for t in batch.column(1)]
                sets = np.array([np.frombuffer(xxh128_digest(shingle_set(t.as_py(), WIDTH).tobytes()), np.int64) for t in batch.column(1)]).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sets[:, 0]), pa.array(sets[:, 1]), pa.array([signature(g).tobytes() for g in grams], pa.binary())], names=["doc_id", "h", "s0", "s1", "print"])

    return rows.mapInArrow(run, "doc_id long, h long, s0 long, s1 long, print binary")


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): documents linked by a Jaccard similarity of at least this in five-word shingles.

    Equal shingle sets are one representative. Representatives that share a band of PERMUTATIONS / BANDS places are tied to the least of the band's
    bucket, which gives candidate components; within each the sets are compared exactly, tile by tile, so a set travels once for its group and not
    once a band, and a tile pair yields a spanning forest. At a similarity of 0.8 a link is missed with a chance below 0.001. Documents without a
    number take part in nothing and have a null component.
    """
    sigs = stored(signatures(docs, id_col, text_col), "signatures")
    per = sigs.where("doc_id IS NOT NULL").groupBy("s0", "s1").agg(F.min(F.struct("doc_id", "h")).alias("k"), F.min("print").alias("print"))
    # numbered over the checkpoint, whose rows keep their places
    reps = checkpoint(per.select("s0", "s1", "k.doc_id", "k.h", "print")).withColumn("rep", F.monotonically_increasing_id())
    size = 2 * PERMUTATIONS // BANDS
    bands = reps.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("print", i * size + 1, size)))).alias("bucket"))
    low = bands.groupBy("bucket").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "low")
    edges = bands.join(low, "bucket").where("rep <> low").select(F.col("rep").alias("src"), F.col("low").alias("dst")).distinct()
    candidates = checkpoint(connected_components(checkpoint(edges)))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    wanted = reps.join(candidates.select(F.col("node").alias("rep")), "rep").select("doc_id", "h", "rep")
    texts = texts.join(wanted, ["doc_id", "h"]).select("rep", "text").dropDuplicates(["rep"])
    comps = connected_components(exact_links(texts, candidates, WIDTH, similarity))
    groups = reps.join(comps, reps["rep"] == comps["node"], "left").select("s0", "s1", "doc_id", F.coalesce("component", "rep").alias("group"))
    named = groups.join(groups.groupBy("group").agg(F.min("doc_id").alias("component_id")), "group").select("s0", "s1", "component_id")
    return sigs.join(named, ["s0", "s1"], "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
