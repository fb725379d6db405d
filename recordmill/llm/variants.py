"""Spelling variants by forward and reversed sorted dictionaries (operator 13).

Words are counted in DataFrame functions. Two words one edit apart keep a half intact: with m letters in the shorter one they share their first or their last m div 2 letters. So every
word stands in a block of the forward dictionary (same m, same head) and in one of the reversed dictionary (same m, same reversed tail), as the shorter and as the longer word. Both
dictionaries are sorted by range in one shuffle, and a task scans its blocks as they follow one another and verifies the pairs inside them in numpy.

Blocks are counted first. One of more than BLOCK words is subdivided before it is sorted: between head and tail a half of the rest is intact too, so its words move to blocks with a
longer head or a longer tail, again and again. The last blocks, with one letter between head and tail (two in the longer word), hold at most k + k * k words
for an alphabet of k letters (8,190 for the 90 that words are made of), whatever the dictionary. A pair is counted in one block alone: the way down goes by its common head, and each block that was
reached by a tail has a bound (cap) on it. No pair leaves a task: a block gives each word's number of near words and the best of them.

Defined results: null and empty texts have no words; a null doc_id is written as an empty string; an empty table gives an empty result; rows that repeat count again; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recordmill.session import checkpoint, stored

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, LEAST, TIMES, DAMAGED = 7, 2, 10, 31
#: Words of a block that is not subdivided, oversized blocks that are still broadcast, and letters compared at once (a bound on memory).
BLOCK, BROADCAST_BLOCKS, AT_ONCE = 128, 10_000, 1 << 23
PLACE = ["m", "i", "j", "cap", "head", "tail"]


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damaged: int = DAMAGED) -> DataFrame:
    """Every run of letters with A-Z in lower case (id, word), a letter left out where the checksum of id and run says so."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(RUN), F.lit(0))).alias("run"))
    plain = F.octet_length("run") == F.length("run")
    low = runs.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("low"))
    h = F.crc32(F.concat("id", F.lit(":"), "low"))
    hashed = low.select("low", h.alias("h"), (h % F.length("low")).cast("int").alias("at"))
    left_out = F.concat(F.substring("low", F.lit(1), F.col("at")), F.substring("low", F.col("at") + 2, F.length("low")))
    return hashed.select(F.when(F.col("h") % damaged == 0, left_out).otherwise(F.col("low")).alias("word"))


def dictionary(found: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """Distinct words of at least this length with their occurrences n."""
    return found.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _block(m: Column, i: Column, j: Column, cap: Column) -> Column:
    return F.struct(m.alias("m"), i.alias("i"), j.alias("j"), cap.alias("cap"))


def _placed(rows: DataFrame, blocks: Column) -> DataFrame:
    """rows (word, n) in each of some blocks; a tail is the head of the reversed word."""
    each = rows.select("word", "n", F.explode(blocks).alias("b")).select("word", "n", "b.*")
    return each.withColumns({"head": F.substring("word", F.lit(1), F.col("i")), "tail": F.substring(F.reverse("word"), F.lit(1), F.col("j"))})


def first_blocks(known: DataFrame, shortest: int) -> DataFrame:
    zero = F.lit(0)
    of = lambda m: F.array(_block(m, F.floor(m / 2).cast("int"), zero, m + 1), _block(m, zero, F.floor(m / 2).cast("int"), F.floor(m / 2).cast("int")))
    size = F.length("word")
    return _placed(known, F.when(size > shortest, F.concat(of(size), of(size - 1))).otherwise(of(size)))


def _subdivided(rows: DataFrame) -> DataFrame:
    m, i, j, cap = (F.col(c) for c in PLACE[:4])
    half = F.floor((m - i - j) / 2).cast("int")
    by_head, by_tail = _block(m, i + half, j, cap), _block(m, i, j + half, F.least(cap, i + half))
    return _placed(rows, F.when(i + half < cap, F.array(by_head, by_tail)).otherwise(F.array(by_tail)))


def blocks(known: DataFrame, shortest: int, most: int = BLOCK, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """Words in blocks of at most `most` words, or in last blocks."""
    level, done = first_blocks(known, shortest), []
    while True:
        sizes = level.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("size"), F.count_if(F.length("word") == F.col("m")).alias("short"))
        # words that are all the longer ones of their block have no pairs there: those blocks go
        divide = (F.col("m") - F.col("i") - F.col("j") >= 2) & (F.col("short") > 0)
        large = checkpoint(sizes.where((F.col("size") > most) & (divide | (F.col("short") == 0))).select(*PLACE, divide.alias("divide")))
        n = large.count()
        if n == 0:
            done.append(level)
            break
        side = F.broadcast(large) if n <= broadcast_blocks else large
        done.append(level.join(side, PLACE, "left_anti").select(*level.columns))
        level = stored(_subdivided(level.join(side.where("divide").drop("divide"), PLACE, "left_semi")), "blocks")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _matrices(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters from the left and from the right, padded with 0, lengths, and a bit for each letter modulo 64 (one edit changes two at most)."""
    size = np.array([*map(len, rows)])
    wide, n = int(size.max()), len(rows)
    left, right = np.zeros((n, wide), np.uint8), np.zeros((n, wide), np.uint8)
    at = np.arange(wide)
    flat = np.frombuffer(b"".join(rows), np.uint8)
    left[at[None, :] < size[:, None]] = flat
    right[at[None, :] >= wide - size[:, None]] = flat
    bits = np.where(left > 0, np.uint64(1) << (left & 63).astype(np.uint64), np.uint64(0))
    return left, right[:, ::-1], size, np.bitwise_or.reduce(bits, axis=1)


def near_pairs(rows: list[bytes], start: np.ndarray, end: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray, cap: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (x < y) of rows of a block that are one edit apart and belong to the block; rows from start to end of each row are its block."""
    left, right, size, bits = _matrices(rows)
    partners = end - np.arange(len(rows)) - 1
    total = np.cumsum(partners)
    at, step = 0, max(1, AT_ONCE // left.shape[1])
    while at < len(rows):
        before = int(total[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + step, "right")))
        own = partners[at:to]
        x = np.repeat(np.arange(at, to), own)
        y = x + 1 + np.arange(len(x)) - np.repeat(total[at:to] - own - before, own)
        at = to
        able = (np.minimum(size[x], size[y]) == m[x]) & (np.bitwise_count(bits[x] ^ bits[y]) <= 2)
        x, y = x[able], y[able]
        for k in range(0, len(x), step):
            a, b = x[k : k + step], y[k : k + step]
            head = (left[a] != left[b]).argmax(1)
            tail = (right[a] != right[b]).argmax(1)
            # words that end inside the other agree as far as the shorter goes
            head, tail = np.minimum(head, m[a]), np.minimum(tail, m[a])
            near = (head + tail >= np.maximum(size[a], size[b]) - 1) & (head >= i[a]) & (head < cap[a]) & (tail >= j[a])
            yield a[near], b[near]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks as they follow one another; the last of a batch may go on in the next, so it is carried."""

    def whole(rows: pa.Table) -> pa.RecordBatch:
        place = np.stack([rows.column(c).to_numpy() for c in ("block", "m", "i", "j", "cap")])
        n = rows.num_rows
        new = np.flatnonzero(np.concatenate([[True], (place[:, 1:] != place[:, :-1]).any(axis=0)]))
        block = np.repeat(np.arange(len(new)), np.diff([*new, n]))
        start, end = new[block], np.append(new[1:], n)[block]
        keep = np.flatnonzero(end - start > 1)
        x, y = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(keep):
            some = rows.take(keep)
            shift = np.concatenate([[0], np.cumsum(np.bincount(block[keep], minlength=len(new)))])
            words = [w.encode("latin-1") for w in some.column("word").to_pylist()]
            got = [*near_pairs(words, shift[block[keep]], shift[block[keep] + 1], *place[1:, keep])]
            if got:
                x, y = keep[np.concatenate([a for a, _ in got])], keep[np.concatenate([b for _, b in got])]
        every, counts = rows.column("word"), rows.column("n").to_numpy()
        a, b = np.concatenate([x, y]), np.concatenate([y, x])
        order = np.lexsort((b, -counts[b], a))  # rows of a block are in the order of their words
        a, b = a[order], b[order]
        heads = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
        near = np.diff([*heads, len(a)]) if len(a) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([every.take(a[heads]).combine_chunks(), pa.array(near.astype(np.int64)), pa.array(counts[b[heads]]), every.take(b[heads]).combine_chunks()], names=["word", "n_near", "best_n", "best"])

    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        block = rows.column("block").to_numpy()
        last = np.flatnonzero(block != block[-1])
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield whole(rows.slice(0, cut))
        held = rows.slice(cut)
    if held is not None and held.num_rows:
        yield whole(held)


def near_words(known: DataFrame, shortest: int = SHORTEST, most: int = BLOCK, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """Every word with near ones: n_near, and best (the near word of the largest n, the first in code-point order among equals) with best_n. known (word, n) is read several times."""
    placed = blocks(known, shortest, most, broadcast_blocks)
    ordered = placed.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE, "word")
    found = ordered.select(F.xxhash64(*PLACE).alias("block"), "m", "i", "j", "cap", "word", "n").mapInArrow(_scanned, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) with the last word that following forms leads to. A form is at least TIMES as frequent, so chains are short, and each round halves them."""
    now = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = checkpoint(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def variants(known: DataFrame, times: int = TIMES, shortest: int = SHORTEST, most: int = BLOCK) -> DataFrame:
    """Every word of known (word, n; distinct letters of Latin-1) with its form, root, n, n_near and form_n."""
    joined = checkpoint(known.join(near_words(known, shortest, most), "word", "left"))
    usual = F.col("best_n") >= times * F.col("n")
    joined = joined.withColumns({"form": F.when(usual, F.col("best")), "form_n": F.when(usual, F.col("best_n"))})
    found = roots(joined.where(F.col("form").isNotNull()).select("word", "form"))
    out = joined.join(found, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op13(docs: DataFrame) -> DataFrame:
    """The contract's columns of every word of the corpus."""
    return variants(stored(dictionary(words(docs)), "dictionary"))
