"""SimHash near-dedup by tiled exact comparison (operator 4).

A text becomes a fingerprint of 64-bit words; equal fingerprints become one row with its least document. The distinct
fingerprints are dealt to tiles by their population counts, and numpy compares tile with tile: exclusive-or, bit count,
threshold. Tile pairs whose population counts differ beyond the radius are never made: at a small radius tiles are keyed
by the population counts of the blocks of a word, whose differences must add up to the radius at most; at a large one by the
population count of the whole. A tile pair yields a spanning forest of its links, no more rows than it has
fingerprints, so a large group of near copies costs comparisons but no pairs; components join the forests. Where sets are
verified afterwards, tiles are keyed by the size of the set instead: sets whose sizes differ by more than the similarity allows can't be linked.

Defined results: a null text is an empty text; a text without words has fingerprint zero and is linked like any other; a
text with fewer words than a shingle is one shingle; equal texts share a fingerprint; a document number that
repeats is one node, also with several texts; null document numbers take no part in links and are their own component; an empty table gives an
empty result; columns of the input that clash with results are not read.

The pipeline's stage uses the comparison as a search for candidates only: its links are verified by the Jaccard similarity of the sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recordmill.llm.batches import spread
from recordmill.operators.components import connected_components
from recordmill.session import checkpoint, stored

SEED = 42
#: Fingerprints in a tile on average, and comparisons held at once.
TILE, HELD = 8192, 1 << 18
#: Blocks of a word whose population counts key the tiles, for radii up to SMALL.
BLOCKS, SMALL = 4, 4
#: For 256-bit fingerprints of distinct five-word shingles: the distance of texts with a Jaccard similarity of 0.8 is 39 on average with a deviation of 5.7
#: (48 and 6.2 for sets of four and five shingles), that of unrelated texts 128 with 8.
WIDE_WORDS, WIDE_RADIUS = 4, 72
#: The Jaccard similarity at which candidates are linked, and the sets in a tile of one candidate group.
SIMILARITY, SET_TILE = 0.8, 128


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of 64-bit hashes (a multiply and shift finaliser)."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * k) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white-space bytes
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    ends = stops[min(width, len(words)) - 1 :].tolist()
    starts = [0, *(stops[: n - 1] + 1).tolist()]
    return np.fromiter((xxh64_intdigest(whole[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray, words: int = 1) -> list[int]:
    """The fingerprint's words as signed 64-bit numbers: a bit is 1 if it is set in over half the hashes."""
    out = []
    for k in range(words):
        own = hashes if k == 0 else _mixed(hashes, k)
        ones = np.zeros(64, np.int64)
        for i in range(0, len(own), 4096):
            ones += np.unpackbits(own[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(own), bitorder="little").view(np.int64)[0]))
    return out


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(text.encode(), width)) if text else np.zeros(0, np.uint64)


def set_fingerprints(docs: DataFrame, width: int, words: int, id_col: str, tag_col: str) -> DataFrame:
    """(doc_id, tag, n, s0, s1, w0, w1, ...) of every row: the size and a 128-bit hash of its set of shingles, and the fingerprint of the set, so repeats in a text don't count."""
    from xxhash import xxh128_digest

    names = ["n", "s0", "s1", *[f"w{k}" for k in range(words)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, len(names)), np.int64)
            for i, text in enumerate(batch.column(1)):
                own = shingle_set(text.as_py(), width)
                found[i] = [len(own), *np.frombuffer(xxh128_digest(own.tobytes(), SEED), np.int64), *fingerprint(own, words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *map(pa.array, np.ascontiguousarray(found.T))], names=["doc_id", "tag", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text", F.col(tag_col).cast("long").alias("tag"))
    return rows.mapInArrow(run, "doc_id long, tag long, " + ", ".join(f"{x} long" for x in names))


def fingerprints(docs: DataFrame, width: int, words: int = 1, id_col: str = "doc_id", text_col: str = "text", tag_col: str | None = None) -> DataFrame:
    """(doc_id, w0, w1, ...) of every row, and tag with a number of the row if one is named."""
    names = [f"w{k}" for k in range(words)]
    tag = [F.col(tag_col).cast("long").alias("tag")] if tag_col else []
    tagged = ["tag"] * len(tag)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *tag)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, words), np.int64)
            for i, text in enumerate(batch.column(1)):
                if raw := text.as_py():
                    found[i] = fingerprint(shingle_hashes(raw.encode(), width), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *map(pa.array, np.ascontiguousarray(found.T))], names=["doc_id", *tagged, *names])

    return rows.mapInArrow(run, "doc_id long, " + "tag long, " * len(tagged) + ", ".join(f"{x} long" for x in names))


def _forest(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between rows of left and rows of right (words by columns; right may be left itself, then n follows): pairs of positions, right's counted on from left's."""
    n, m = len(left), len(right)
    parent = np.arange(n + m)
    out_a, out_b = [], []
    step, words = max(1, HELD // max(1, m)), left.shape[1]
    # as many words as leave few unrelated pairs (32 differing bits a word, with a deviation of 4), three of four at most: their count must fit a byte
    half = next((k for k in range((words + 1) // 2, words) if 32 * k - 12 * k**0.5 >= radius), max(1, words - 1))
    for at in range(0, n, step):
        part = left[at : at + step]
        # the distance in some of the words can't exceed that in all: of unrelated wide fingerprints few pass
        distance = np.bitwise_count(part[:, :1] ^ right[None, :, 0])
        for k in range(1, half):
            distance += np.bitwise_count(part[:, k : k + 1] ^ right[None, :, k])
        a, b = np.nonzero(distance <= radius)
        if half < left.shape[1] and len(a):
            rest = sum((np.bitwise_count(part[a, k] ^ right[b, k]).astype(np.int32) for k in range(half, left.shape[1])), distance[a, b].astype(np.int32))
            a, b = a[rest <= radius], b[rest <= radius]
        if not len(a):
            continue
        a, b = a + at, b + n
        while True:  # keep what still joins two trees; one new link a tree at most in each turn
            for _ in range(64):
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent = up
            x, y = parent[a], parent[b]
            on = x != y
            if not on.any():
                break
            a, b, x, y = a[on], b[on], x[on], y[on]
            low, high = np.minimum(x, y), np.maximum(x, y)
            heads, where = np.unique(high, return_index=True)
            parent[heads] = low[where]
            out_a.append(a[where])
            out_b.append(b[where])
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def _tile_arrays(column: pa.Array, words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each row: the representatives and the words of a tile."""
    flat, offsets = column.flatten(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
    rep = flat.field(0).to_numpy(zero_copy_only=False)
    data = np.stack([flat.field(1 + k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(words)], axis=1) if len(flat) else np.zeros((0, words), np.uint64)
    return [(rep[a:b], data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _key(words: int, radius: int) -> tuple[list[Column], list[tuple[int, ...]]]:
    """The key columns of a tile, and the steps from a key to the keys that it is compared with (each pair of keys in one direction)."""
    if words == 1 and radius <= SMALL:
        width = 64 // BLOCKS
        mask = (1 << width) - 1
        cols = [F.bit_count(F.shiftrightunsigned("w0", width * i).bitwiseAND(F.lit(mask))) for i in range(BLOCKS)]
        steps = [d for d in product(range(-radius, radius + 1), repeat=BLOCKS) if sum(map(abs, d)) <= radius and d >= (0,) * BLOCKS]
        return cols, steps
    total = sum((F.bit_count(f"w{k}") for k in range(1, words)), F.bit_count("w0"))
    return [F.floor(total / (radius + 1)).cast("int")], [(0,), (1,)]


def links(distinct: DataFrame, words: int, radius: int, tile: int = TILE, similarity: float | None = None) -> DataFrame:
    """(src, dst): a forest whose components are those of all pairs of distinct rows (rep, w0, ...) within the radius.

    With a similarity rows have n, the size of their set, and pairs are left out that can't have that Jaccard similarity by their sizes alone (all those of size classes that aren't
    beside each other; of a class or of two beside each other all pairs are compared).

    Tiles of a key are told apart by a hash, so that no key, however frequent, makes a tile much over its size; the table of key
    sizes has 17^4 rows at most and is broadcast.
    """
    # sizes of a pair differ by the similarity at most, so their classes by one
    cols, steps = _key(words, radius) if similarity is None else ([F.floor(F.log(F.greatest("n", F.lit(1))) / -np.log(similarity - 1e-9)).cast("int")], [(0,), (1,)])
    names = [f"k{i}" for i in range(len(cols))]
    keyed = distinct.withColumns(dict(zip(names, cols, strict=True)))
    sizes = keyed.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("n_sub"))
    dealt = keyed.join(F.broadcast(sizes), names).withColumn("sub", F.pmod(F.xxhash64("rep", "w0"), "n_sub").cast("int"))
    tiles = checkpoint(dealt.groupBy(*names, "sub").agg(F.collect_list(F.struct("rep", *[f"w{k}" for k in range(words)])).alias("rows")))
    step = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"d{i}") for i, x in enumerate(d)]) for d in steps])).alias("d")
    near = tiles.select("*", step).select(*[(F.col(n) + F.col(f"d.d{i}")).alias(f"n{i}") for i, n in enumerate(names)], F.col("rows").alias("left"), F.col("sub").alias("own"), F.greatest(F.lit(0), F.lit(0), *[F.abs(f"d.d{i}") for i in range(len(names))]).alias("far"))
    beside = sizes.select(*[F.col(n).alias(f"n{i}") for i, n in enumerate(names)], "n_sub")
    near = near.join(F.broadcast(beside), [f"n{i}" for i in range(len(names))])
    near = near.withColumn("s", F.explode(F.sequence(F.when(F.col("far") == 0, F.col("own")).otherwise(F.lit(0)), F.col("n_sub") - 1)))
    right = tiles.select(*[F.col(n).alias(f"n{i}") for i, n in enumerate(names)], F.col("sub").alias("s"), F.col("rows").alias("right"))
    pairs = near.join(right.hint("shuffle_hash"), [*[f"n{i}" for i in range(len(names))], "s"]).select("left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for (ids_a, a), (ids_b, b) in zip(_tile_arrays(batch.column(0), words), _tile_arrays(batch.column(1), words), strict=True):
                x, y = _forest(a, b, radius)
                ids = np.concatenate([ids_a, ids_b])
                src.append(ids[x])
                dst.append(ids[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)) if src else pa.array([], pa.int64()), pa.array(np.concatenate(dst)) if dst else pa.array([], pa.int64())], names=["src", "dst"])

    return pairs.mapInArrow(run, "src long, dst long").where("src <> dst")


def near_groups(prints: DataFrame, words: int, radius: int, tile: int = TILE) -> DataFrame:
    """prints (doc_id, w0, ...) with component_id, the least document reachable by links of at most radius bits."""
    cols = [f"w{k}" for k in range(words)]
    distinct = checkpoint(prints.where("doc_id IS NOT NULL").groupBy(*cols).agg(F.min("doc_id").alias("rep")))
    # a document of several texts is one node: it ties their fingerprints
    print_ = F.struct(*cols)
    several = prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(print_).alias("a"), F.max(print_).alias("b")).where("a <> b").select("doc_id")
    ties = prints.join(several, "doc_id").join(distinct, cols).select(F.col("doc_id").alias("src"), F.col("rep").alias("dst")).where("src <> dst")
    comps = connected_components(links(distinct, words, radius, tile).unionByName(ties))
    # every distinct fingerprint with its component, then every row with its fingerprint's
    named = distinct.join(comps, distinct["rep"] == comps["node"], "left").select(*cols, F.coalesce("component", "rep").alias("component_id"))
    out = prints.join(named, cols, "left")
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def op4(docs: DataFrame) -> DataFrame:
    """The contract's fingerprint and component of every document: 3-word shingles, 64 bits, radius 2."""
    prints = checkpoint(fingerprints(spread(docs.select("doc_id", "text")), 3))
    return near_groups(prints, 1, 2).select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


def _exact_forest(a: pa.ListScalar, b: pa.ListScalar, similarity: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the links at a Jaccard similarity of at least this between the sets of two tiles (structs of rep and grams)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def parts(tile: pa.ListScalar) -> tuple[list[int], list[np.ndarray]]:
        rows = tile.values
        sets, stops = rows.field("grams"), np.cumsum(rows.field("grams").value_lengths().to_numpy(zero_copy_only=False))
        return rows.field("rep").to_pylist(), np.split(sets.flatten().to_numpy(zero_copy_only=False), stops[:-1])

    (ids_a, sets_a), (ids_b, sets_b) = parts(a), parts(b)
    # the tile's shingles in one order, each with the sets that hold it
    sizes = np.array([len(x) for x in sets_b], np.int64)
    every, owner = np.concatenate(sets_b), np.repeat(np.arange(len(sets_b)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    distinct, first, held = np.unique(every, return_index=True, return_counts=True)
    src, dst = [], []
    for rep, own in zip(ids_a, sets_a, strict=True):
        at = np.minimum(np.searchsorted(distinct, own), len(distinct) - 1)
        at = at[distinct[at] == own]
        n = held[at]
        rows = np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(owner[rows], minlength=len(sizes))
        for j in np.nonzero(common >= similarity * (len(own) + sizes - common) - 1e-9)[0]:
            x, y = root(rep), root(ids_b[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                src.append(rep)
                dst.append(ids_b[j])
    return src, dst


def exact_links(docs: DataFrame, candidates: DataFrame, width: int, similarity: float, tile: int = SET_TILE) -> DataFrame:
    """(src, dst): a forest whose components are those of all pairs of docs (rep, text) of one candidate group (node, component) with this Jaccard similarity of shingles.

    A group is dealt to tiles by a hash and compared tile with tile, so a large one costs comparisons but no pairs, and no task holds more than two
    tiles at once. Only the sizes of groups beyond a tile are broadcast: at most one row for each `tile` documents.
    """

    def run_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                sets = [shingle_set(t.as_py(), width).view(np.int64) for t in some.column(2)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["component", "rep", "grams"])

    large = candidates.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile).select("component", F.ceil(F.col("n") / tile).cast("int").alias("n_sub"))
    sets = docs.join(candidates.select(F.col("node").alias("rep"), "component"), "rep").select("component", "rep", "text").mapInArrow(run_sets, "component long, rep long, grams array<long>")
    sets = sets.join(F.broadcast(large), "component", "left").withColumn("n_sub", F.coalesce("n_sub", F.lit(1))).withColumn("sub", F.pmod(F.xxhash64("rep"), "n_sub").cast("int"))
    tiles = checkpoint(sets.groupBy("component", "sub", "n_sub").agg(F.collect_list(F.struct("rep", "grams")).alias("rows")))
    left = tiles.select("component", F.col("rows").alias("left"), F.explode(F.sequence("sub", F.col("n_sub") - 1)).alias("sub"))
    pairs = left.join(tiles.select("component", "sub", F.col("rows").alias("right")), ["component", "sub"]).select("left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                x, y = _exact_forest(a, b, similarity)
                src += x
                dst += y
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return pairs.mapInArrow(run, "src long, dst long").where("src <> dst")


def one_of_each_group(docs: DataFrame, width: int = 5, words: int = WIDE_WORDS, radius: int = WIDE_RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the near copies of another document: of each group one row stays, that of the least document (the first of equal ones).

    Texts are linked at a Jaccard similarity of their sets of five-word shingles of 0.8 or more. Fingerprints of 64 * words bits of the sets find candidates: components
    at a radius that pairs at 0.8 hardly ever exceed. Within each the sets themselves are compared, and only what that links is a group.
    Texts without words hold nothing to compare and all stay. Rows are numbered in a written table, so that a task that runs again sees the same
    numbers, and only the numbers of the rows to go are joined to it.
    """
    marked = stored(docs.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    real = marked.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    prints = checkpoint(set_fingerprints(real, width, words, "__at", "doc_id"))
    # equal sets are one representative
    distinct = checkpoint(prints.groupBy("s0", "s1").agg(F.min(F.struct("doc_id", "n", *[f"w{k}" for k in range(words)])).alias("r")).select("s0", "s1", F.col("r.doc_id").alias("rep"), "r.n", *[f"r.w{k}" for k in range(words)]))
    candidates = checkpoint(connected_components(links(distinct.drop("s0", "s1"), words, radius, similarity=similarity)))
    comps = connected_components(exact_links(real.select(F.col("__at").alias("rep"), "text"), candidates, width, similarity))
    named = distinct.join(comps, distinct["rep"] == comps["node"], "left").select("s0", "s1", F.coalesce("component", "rep").alias("component_id"))
    groups = checkpoint(prints.select("doc_id", "tag", "s0", "s1").join(named, ["s0", "s1"]).select("doc_id", "tag", "component_id"))
    stays = groups.groupBy("component_id").agg(F.min(F.struct("tag", "doc_id")).alias("s")).select(F.col("s.doc_id").alias("doc_id"))
    gone = groups.join(stays, "doc_id", "left_anti").select(F.col("doc_id").alias("__at"))
    return marked.join(gone, "__at", "left_anti").select(*docs.columns)
