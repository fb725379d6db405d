"""Masked pseudo-likelihood scoring by a bidirectional window network (operator 9).

All words of the corpus are counted. The COMMON most frequent are tokens of their own; every other word belongs to one of BUCKETS hashed tokens, and its
probability is that of its bucket in the place where it stands, by the network, times its own share of the bucket, by the counts. The network
predicts a token from the SIDE tokens on its left and on its right: an embedding for each place of the window, a tanh layer, and a two-level softmax
(cluster, then token). It is written and trained in numpy.

Shares are those of the other documents: a document's own occurrences are left out, and UNSEEN is added to each word's count and once for a word that is
new. So a rare word that occurs nowhere else costs its document about log(1 / UNSEEN) more than one that does, however large the corpus is. The counts
grow with the corpus and are never gathered: a partition of documents is joined with the counts of the words that it shares with other partitions.

Training is distributed: documents are dealt to shards of about PER_SHARD tokens by hashes of document and text, and in each of ROUNDS rounds every shard starts from the common weights and descends on masked positions of
all its documents in the order of their hashes (a share MASKED, drawn by the hash of text and place, other places in every round), and the weights of all shards are averaged by their
numbers of positions, in a tree of Spark tasks. So neither files nor partitions nor cores change the weights. The score of a document is the sum of the log probabilities of all its words, each given both sides.

Defined results: a null or empty text has no tokens, score 0 and a null mean; words past either end are a padding token;
repeated rows are scored alike (each counts the others' words as another document's); an empty corpus leaves the initial weights; columns of the
input that clash with results are replaced.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from recordmill.llm.batches import slices, spread
from recordmill.session import stored

COMMON, BUCKETS, CLUSTERS, HIDDEN, SIDE = 1536, 512, 64, 16, 3
TOKENS = COMMON + BUCKETS
MASKED, ROUNDS, RATE, BATCH = 0.15, 2, 0.1, 4096
#: The count of a word that no other document holds.
UNSEEN = 0.1
#: Positions scored at once, and documents whose words are counted at once.
HELD, TOGETHER = 32768, 512
MEMO = 300_000
#: Tokens of a stream of training, of which the corpus gives the number of streams, whatever the cores. Nets that are averaged at once.
PER_SHARD, FAN_IN = 1 << 21, 8
#: Steps of a doubling of the counts by which the most frequent words are set apart before they are put in order.
OCTAVE = 16


#: White space as str.split has it, by code point; none lies beyond these.
SPACES = np.array([*(chr(i).isspace() for i in range(0x3001)), False])
#: A word's hash is a polynomial of its code points at BASE modulo 2^64, then mixed. Sums run over RUN code points, or one longer word.
BASE, RUN = 0x9E3779B97F4A7C15, 1 << 15


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=1)
def _run() -> tuple[np.ndarray, np.ndarray]:
    return _powers(BASE, RUN), _powers(pow(BASE, -1, 1 << 64), RUN)


def _hashes(points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each word, all at once: words lie in order at starts to stops of the code points."""
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        first = int(starts[a])
        b = max(a + 1, int(np.searchsorted(stops, first + RUN, "right")))
        n = int(stops[b - 1]) - first
        up, down = _run() if n <= RUN else (_powers(BASE, n), np.ones(1, np.uint64))  # a longer word is alone
        sums, terms = np.zeros(n + 1, np.uint64), points[first : first + n].astype(np.uint64)
        terms += np.uint64(1)
        terms *= up[:n]
        np.cumsum(terms, out=sums[1:])
        at = starts[a:b] - first
        out[a:b] = sums[stops[a:b] - first]
        out[a:b] -= sums[at]
        out[a:b] *= down.take(at, mode="clip")  # an empty word may begin where the run ends; its sum is 0
        a = b
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def hashes_of(words: Collection[str]) -> np.ndarray:
    """The 64-bit hash of each word."""
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return _hashes(_points("".join(words)), np.concatenate([[0], stops[:-1]]).astype(np.int64)[: len(words)], stops)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of texts (lower() and split()) one after the other, and the number of words of each text."""
    lower = [t.lower() for t in texts]
    points = _points("\n".join(lower) + "\n")
    space = SPACES[np.minimum(points, len(SPACES) - 1)]
    edges = np.flatnonzero(np.diff(space, prepend=True))  # a word's start and stop in turn
    starts, stops = edges[::2], edges[1::2]
    ends = np.searchsorted(starts, np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)) + 1))
    return _hashes(points, starts, stops), np.diff(ends, prepend=0)


def seeds_of(texts: list[str]) -> np.ndarray:
    """The 64-bit hash of each whole text."""
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, texts), np.uint64, len(texts))


@dataclass
class Tokens:
    """The tokens of some texts in one array with SIDE paddings before, between and after them; at is where each token stands, owner its text, place its number in the text."""

    padded: np.ndarray
    at: np.ndarray
    owner: np.ndarray
    place: np.ndarray

    @staticmethod
    def laid(ids: np.ndarray, sizes: np.ndarray) -> "Tokens":
        """Of the tokens of texts one after the other, and the sizes of the texts."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.arange(len(ids)) + SIDE * (owner + 1)
        padded = np.full(len(ids) + SIDE * (len(sizes) + 1), TOKENS, np.int32)
        padded[at] = ids
        return Tokens(padded, at, owner, place)

    def windows(self, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """(positions, 2 SIDE): the tokens around each position."""
        at = self.at[which]
        return np.stack([self.padded[at + d] for d in range(-SIDE, SIDE + 1) if d], axis=1)

    def masked(self, seeds: np.ndarray, share: float, turn: int) -> np.ndarray:
        """The positions that this round learns from, by the hash of text (seeds) and place; rounds have different ones."""
        x = (self.place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + seeds[self.owner]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        u = (x >> np.uint64(40)).astype(np.float64) / (1 << 24)
        return np.nonzero((u - turn * share) % 1.0 < share)[0]


class Ids:
    """Numbers of words: a common word's own, or COMMON and the place of its hash for any other word."""

    def __init__(self, common: dict[int, int]):
        hashes = np.fromiter(common.keys(), np.uint64, len(common))
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], np.append(np.fromiter(common.values(), np.int32, len(common))[order], np.int32(-1))

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The tokens of texts one after the other, the sizes of the texts, which words aren't common, and the hashes of those."""
        words, sizes = words_of(texts)
        at = np.searchsorted(self.hashes, words)
        rare = np.append(self.hashes, np.uint64(0))[at] != words
        rare |= at == len(self.hashes)
        hashes, ids = words[rare], self.numbers[at]
        ids[rare] = COMMON + bucket_of(hashes)
        return ids, sizes, rare, hashes


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) % BUCKETS


def _exponentials(z: np.ndarray, bound: float) -> np.ndarray:
    """The sums of the exponentials of each row of z, which become z; the greatest is only taken off where they might overflow."""
    if bound > 60:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype)


def _log_softmax(z: np.ndarray, bound: float, at: np.ndarray) -> np.ndarray:
    """The log probability of outcome `at` of each row of logits within bound."""
    rows = np.arange(len(at))
    if bound > 60:
        z -= z.max(axis=1, keepdims=True)
    out = z[rows, at]
    out -= np.log(_exponentials(z, 0))
    return out


def _errors(z: np.ndarray, bound: float, at: np.ndarray) -> np.ndarray:
    """Probabilities of all outcomes less one at the right one, divided by the number of rows."""
    n = len(at)
    z /= (_exponentials(z, bound) * n)[:, None]
    z[np.arange(n), at] -= 1 / n
    return z


class WindowNet:
    def __init__(self, seed: int = 4):
        rng, h, k, m = np.random.default_rng(seed), HIDDEN, CLUSTERS, TOKENS // CLUSTERS
        self.p = {
            "e": rng.normal(0, 0.1, (2 * SIDE, TOKENS + 1, h)).astype(np.float32), "b": np.zeros(h, np.float32),
            "w": rng.normal(0, 0.1, (h, k)).astype(np.float32), "c": np.zeros(k, np.float32),
            "v": rng.normal(0, 0.1, (k, h, m)).astype(np.float32), "d": np.zeros((k, m), np.float32),
        }

    def _hidden(self, near: np.ndarray) -> np.ndarray:
        e = self.p["e"]
        total = e[0].take(near[:, 0], axis=0)
        for o in range(1, 2 * SIDE):
            total += e[o].take(near[:, o], axis=0)
        total += self.p["b"]
        return np.tanh(total, out=total)

    def _outer(self, hidden: np.ndarray) -> tuple[np.ndarray, float]:
        """Logits of the clusters, and their bound: the hidden layer lies within 1."""
        z = hidden @ self.p["w"]
        z += self.p["c"]
        return z, np.abs(self.p["w"]).sum(axis=0).max() + np.abs(self.p["c"]).max()

    def _inner(self, hidden: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, float]:
        """Logits of the tokens of each row's cluster, rows being in the order of clusters with the given cuts, and their bound."""
        z = np.empty((len(hidden), TOKENS // CLUSTERS), hidden.dtype)
        for k in np.flatnonzero(np.diff(cuts)):
            some = slice(cuts[k], cuts[k + 1])
            np.matmul(hidden[some], self.p["v"][k], out=z[some])
            z[some] += self.p["d"][k]
        return z, np.abs(self.p["v"]).sum(axis=1).max() + np.abs(self.p["d"]).max()

    @staticmethod
    def _by_cluster(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The order of rows by cluster, the cuts between clusters, and each row's cluster and place in it, in that order."""
        order = np.argsort((tokens // (TOKENS // CLUSTERS)).astype(np.int16), kind="stable")
        cluster, inner = np.divmod(tokens[order], TOKENS // CLUSTERS)
        return order, np.searchsorted(cluster, np.arange(CLUSTERS + 1)), cluster, inner

    def log_probabilities(self, near: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Of each token given its window."""
        order, cuts, cluster, inner = self._by_cluster(tokens)
        hidden = self._hidden(near[order])
        out = np.empty(len(tokens), hidden.dtype)
        out[order] = _log_softmax(*self._outer(hidden), cluster) + _log_softmax(*self._inner(hidden, cuts), inner)
        return out

    def gradients(self, near: np.ndarray, tokens: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean negative log probability: dense ones by name, and that of the hidden input (positions, h) for the embeddings."""
        order, cuts, cluster, inner = self._by_cluster(tokens)
        hidden = self._hidden(near[order])
        outer = _errors(*self._outer(hidden), cluster)
        z = _errors(*self._inner(hidden, cuts), inner)
        own = outer @ self.p["w"].T
        gv, gd = np.zeros_like(self.p["v"]), np.zeros_like(self.p["d"])
        for k in np.flatnonzero(np.diff(cuts)):
            some = slice(cuts[k], cuts[k + 1])
            np.matmul(hidden[some].T, z[some], out=gv[k])
            gd[k] = z[some].sum(axis=0)
            own[some] += z[some] @ self.p["v"][k].T
        own *= 1 - hidden * hidden
        back = np.empty_like(own)
        back[order] = own
        return {"b": own.sum(axis=0), "w": hidden.T @ outer, "c": outer.sum(axis=0), "v": gv, "d": gd}, back

    def descend(self, near: np.ndarray, tokens: np.ndarray, seen: dict[str, np.ndarray], rate: float = RATE) -> None:
        """One step of Adagrad; seen holds the squares so far."""
        grads, back = self.gradients(near, tokens)
        e = self.p["e"]
        columns, at = back.T.astype(np.float64, order="C"), near.T.astype(np.int64, order="C")
        grads["e"] = np.stack([np.stack([np.bincount(own, column, TOKENS + 1) for column in columns], axis=1) for own in at]).astype(e.dtype)
        for k, g in grads.items():
            seen[k] += g * g
            g /= np.sqrt(seen[k]) + 1e-6
            g *= rate
            self.p[k] -= g

    def packed(self) -> bytes:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)]).astype(np.float32).tobytes()

    def unpack(self, raw: bytes) -> "WindowNet":
        flat, at = np.frombuffer(raw, np.float32), 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = flat[at : at + n].reshape(self.p[k].shape).copy()
            at += n
        return self


# ---- the counts of all words ----


@dataclass
class Vocabulary:
    """words has (h, n, parts) of every word of the corpus: hash, count, and its counts by partition of the corpus. common numbers the most frequent; of
    the other words of each bucket, total and kinds are the number of occurrences and of words."""

    words: DataFrame
    common: dict[int, int]
    total: np.ndarray
    kinds: np.ndarray


def vocabulary(docs: DataFrame, text_col: str = "text", n: int = COMMON) -> Vocabulary:
    """Words counted in each task (up to MEMO at a time) and summed by one shuffle.

    The words beyond the n-th are kept apart by a histogram of the logarithm of the counts, so that only about n words are put in order, whatever the number
    of partitions; ties go to the lesser hash.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, h, n = TaskContext.get().partitionId(), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        found, held = [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            new, many = np.unique(np.concatenate(found), return_counts=True)
            both, sums = np.concatenate([h, new]), np.concatenate([n, many])
            order = np.argsort(both, kind="stable")
            first = np.flatnonzero(np.diff(both[order], prepend=~both[order[:1]]))
            return both[order[first]], np.add.reduceat(sums[order], first) if len(first) else sums

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), part, np.int32)), pa.array(n)], names=["h", "part", "n"])

        for whole in batches:
            for batch in slices(whole, 0):
                found.append(words_of([x or "" for x in batch.column(0).to_pylist()])[0])
                held += len(found[-1])
                if held > MEMO:
                    (h, n), found, held = summed(), [], 0
                    if len(h) > MEMO:
                        yield made()
                        h, n = h[:0], n[:0]
        if found:
            h, n = summed()
        yield made()

    each = docs.select(text_col).mapInArrow(count, "h long, part int, n long")
    words = stored(each.groupBy("h").agg(F.sum("n").alias("n"), F.collect_list(F.struct("part", "n")).alias("parts")), "words")
    step = F.floor(F.log2("n") * OCTAVE).cast("int")
    sizes = sorted(((r["s"], r["c"]) for r in words.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)  # at most 64 OCTAVE rows
    enough, cut = 0, 0
    for s, c in sizes:
        enough, cut = enough + c, s
        if enough >= n:
            break
    best = words.where(step >= cut).select("h", "n").orderBy(F.desc("n"), "h").limit(n).collect()
    total, kinds = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    bucket = F.pmod(F.shiftrightunsigned("h", 40), F.lit(BUCKETS)).cast("int").alias("b")
    for r in words.groupBy(bucket).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect():
        total[r["b"]], kinds[r["b"]] = r["n"], r["k"]
    hashes = np.array([r["h"] for r in best], np.int64).view(np.uint64)
    for b, r in zip(bucket_of(hashes).tolist(), best, strict=True):
        total[b] -= r["n"]
        kinds[b] -= 1
    return Vocabulary(words, {h: i for i, h in enumerate(hashes.tolist())}, total, kinds)


# ---- training ----

PART = "shard int, weight double, net binary"


def _average(table: pa.Table) -> pa.Table:
    """The mean of some nets by their weights, in the order of their shards, so that it is the same to the last bit wherever it is taken."""
    total, mean, table = 0.0, None, table.sort_by("shard")
    for weight, raw in zip(table.column("weight").to_pylist(), table.column("net"), strict=True):
        if weight > 0:
            net = np.frombuffer(raw.as_py(), np.float32).astype(np.float64)
            total += weight
            mean = net if mean is None else mean + (net - mean) * (weight / total)
    none = mean is None
    return pa.table({"shard": pa.array([] if none else [table.column("shard")[0].as_py() // FAN_IN], pa.int32()), "weight": pa.array([] if none else [total], pa.float64()), "net": pa.array([] if none else [mean.astype(np.float32).tobytes()], pa.binary())})


def tokenised(docs: DataFrame, common: dict[int, int], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(seed, ids, id) of every text, written: its hash, its tokens as 16-bit numbers, and the hash of its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Ids(common)
        for whole in batches:
            for batch in slices(whole, 0):
                texts = [x or "" for x in batch.column(0).to_pylist()]
                ids, sizes, _, _ = known.of(texts)
                stops, raw = 2 * np.cumsum(sizes), ids.astype(np.uint16).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(seeds_of(texts).view(np.int64)), pa.array([raw[b - 2 * n : b] for b, n in zip(stops.tolist(), sizes.tolist(), strict=True)], pa.binary()), batch.column(1)], names=["seed", "ids", "id"])

    made = docs.select(text_col, F.xxhash64(id_col).alias("id")).mapInArrow(run, "seed long, ids binary, id long")
    return stored(made, "tokens")


def dealt(tokens: DataFrame, shards: int) -> DataFrame:
    """(shard, seed, ids): each shard is a partition of its own, in the order of its hashes."""
    shard = F.pmod(F.xxhash64("seed", "id"), F.lit(shards)).cast("int")
    return tokens.withColumn("shard", shard).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "seed", "id").select("shard", "seed", "ids")


def trained(tokens: DataFrame, rounds: int = ROUNDS, masked: float = MASKED, shards: int | None = None) -> WindowNet:
    """Weights after rounds of local descent over all documents (as tokenised). Each shard, one for each PER_SHARD tokens unless their number is given, is a stream in the order of its hashes,
    whatever the files, partitions and cores."""
    net = WindowNet()
    if shards is None:
        size = tokens.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)).alias("n")).first()["n"] // 2
        shards = max(1, -(-size // PER_SHARD))
    texts = dealt(tokens, shards)
    for turn in range(rounds):
        raw = net.packed()

        def local(batches: Iterator[pa.RecordBatch], raw: bytes = raw, turn: int = turn) -> Iterator[pa.RecordBatch]:
            shard: int | None = None
            own: WindowNet

            def closed() -> pa.RecordBatch:
                n = done
                if held:
                    own.descend(np.concatenate(near), np.concatenate(targets), seen)
                    n += held
                return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([float(n)]), pa.array([own.packed()], pa.binary())], names=["shard", "weight", "net"])

            for whole in batches:
                which = whole.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), whole.num_rows]  # a partition may hold several shards
                for start, stop in zip(cuts[:-1], cuts[1:]):
                    if start == stop:
                        continue
                    if which[start] != shard:
                        if shard is not None:
                            yield closed()
                        shard, own, done = int(which[start]), WindowNet().unpack(raw), 0
                        seen = {k: np.full_like(v, 1e-4 if turn == 0 else 1e-2) for k, v in own.p.items()}
                        near, targets, held = [], [], 0
                    for batch in slices(whole.slice(start, stop - start), 2):
                        texts = batch.column(2).to_pylist()
                        got = Tokens.laid(np.frombuffer(b"".join(texts), np.uint16), np.array([len(x) // 2 for x in texts], np.int64))
                        at = got.masked(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), masked, turn)
                        near.append(got.windows(at))
                        targets.append(got.padded[got.at[at]])
                        held += len(at)
                        if held >= BATCH:
                            x, y = np.concatenate(near), np.concatenate(targets)
                            full = len(y) // BATCH * BATCH
                            for k in range(0, full, BATCH):
                                own.descend(x[k : k + BATCH], y[k : k + BATCH], seen)
                            done, near, targets, held = done + full, [x[full:]], [y[full:]], len(y) - full
            if shard is not None:
                yield closed()

        made, width = texts.mapInArrow(local, PART), shards
        while width > 1:  # a tree of averages, so that no task reads more nets than FAN_IN
            width = -(-width // FAN_IN)
            made = made.groupBy(F.floor(F.col("shard") / FAN_IN).alias("of")).applyInArrow(_average, PART)
        rows = made.collect()
        if rows:
            net = WindowNet().unpack(bytes(rows[0]["net"]))
    return net


# ---- scores ----


def rare_logs(owner: np.ndarray, hashes: np.ndarray, known_h: np.ndarray, known_n: np.ndarray, total: np.ndarray, kinds: np.ndarray, unseen: float = UNSEEN) -> np.ndarray:
    """The log share in its bucket of each occurrence of a word that isn't common, by the counts of the documents (owner, in order) other than its own.

    known_h and known_n are counts in the whole corpus; a word without one occurs in these rows only and is counted here.
    """
    distinct, which, n = np.unique(hashes, return_inverse=True, return_counts=True)
    n = n.astype(np.int64)
    if len(known_h) and len(distinct):
        at = np.minimum(np.searchsorted(distinct, known_h), len(distinct) - 1)
        hit = distinct[at] == known_h
        n[at[hit]] = known_n[hit]
    out = np.empty(len(hashes))
    buckets, rest = bucket_of(hashes), total + unseen * (kinds + 1)
    ends = np.searchsorted(owner, np.arange(0, int(owner[-1]) + 1 + TOGETHER, TOGETHER)) if len(owner) else []
    for a, b in zip(ends[:-1], ends[1:]):  # some documents at a time
        if a < b:
            who, word, bucket = owner[a:b].astype(np.int64) - int(owner[a]), which[a:b], buckets[a:b]
            _, again, own = np.unique(who * len(distinct) + word, return_inverse=True, return_counts=True)
            mine = np.bincount(who * BUCKETS + bucket)[who * BUCKETS + bucket]
            out[a:b] = np.log(n[word] - own[again] + unseen) - np.log(rest[bucket] - mine)
    return out


def scored(docs: DataFrame, net: WindowNet, vocab: Vocabulary, text_col: str = "text") -> DataFrame:
    """docs, the corpus that was counted, with n_tokens, lm_score (summed log probability) and lm_mean.

    Each partition of docs meets the counts of those words that other partitions hold as well: two rows of numbers a word and partition are shuffled, and the
    documents once, to the counts of their partition. A group is one partition of the scan.
    """
    kept = docs.drop("n_tokens", "lm_score", "lm_mean")
    raw, common, total, kinds = net.packed(), vocab.common, vocab.total, vocab.kinds
    shared = vocab.words.where(F.size("parts") > 1).select("h", "n", F.explode("parts.part").alias("__part"))
    schema = T.StructType([*kept.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("lm_score", T.DoubleType()), T.StructField("lm_mean", T.DoubleType())])
    names = kept.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own, ids, n, first = WindowNet().unpack(raw), Ids(common), left.num_rows, 0
        counts, sums, rare, rare_owner = np.zeros(n, np.int64), np.zeros(n), [], []
        for whole in left.to_batches():
            for batch in slices(whole, text_col):
                flat, sizes, which, hashes = ids.of([x or "" for x in batch.column(text_col).to_pylist()])
                got, m = Tokens.laid(flat, sizes), batch.num_rows
                counts[first : first + m] = sizes
                for k in range(0, len(got.at), HELD):  # a very long text goes in pieces with their windows
                    some = slice(k, k + HELD)
                    logs = own.log_probabilities(got.windows(some), got.padded[got.at[some]])
                    sums[first : first + m] += np.bincount(got.owner[some], logs, m)
                rare.append(hashes)
                rare_owner.append((got.owner[which] + first).astype(np.int32))
                first += m
        if n:
            at, known = np.concatenate(rare_owner), right.column("h").to_numpy().view(np.uint64)
            logs = rare_logs(at, np.concatenate(rare), known, right.column("n").to_numpy(), total, kinds)
            sums += np.bincount(at, logs, n)
        mean = pa.array(np.where(counts > 0, sums / np.maximum(counts, 1), np.nan), mask=counts == 0)
        return pa.Table.from_arrays([*(left.column(c) for c in names), pa.array(counts), pa.array(sums), mean], names=schema.names)

    here = kept.withColumn("__part", F.spark_partition_id())
    return here.groupBy("__part").cogroup(shared.groupBy("__part")).applyInArrow(run, schema)


def op9(docs: DataFrame) -> DataFrame:
    """Every document's number of tokens, score and mean, the network being trained and the words counted on all documents."""
    rows = spread(docs.select("doc_id", "text"), "doc_id")
    vocab = vocabulary(rows)
    return scored(rows, trained(tokenised(rows, vocab.common)), vocab).select("doc_id", "n_tokens", "lm_score", "lm_mean")
