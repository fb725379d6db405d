"""Alignment of the tokens of two tokenizers by the bytes that they cover (operator 12).

A is a byte-level vocabulary and encodes a space and the text; B is a merge-type vocabulary of pieces that puts a space mark before the text itself. Both
end a token before every space or line feed that follows a character other than white space, so a text is cut there, and what a part gives (tokens, groups,
links) is made once by a two-pointer merge of the cumulative ends of its tokens (of all new parts at a time, in numpy) and remembered within the Python worker, whose next task finds it. Everything of a text is the concatenation of its parts.

Counts over the corpus are Spark's: documents travel in chunks of about CHUNK bytes of text; a chunk gives its distinct linked pairs with the number of its documents that
hold each, a groupBy sums them for each pair, another takes the maximum for each A id, and a join takes both back to the chunks, whose documents then sum over their own
links. So a pair travels once a chunk and not once a document: what is joined grows with the text, and a pair that every document holds is no hot key.

Defined results: texts that are null, empty, or whose joined token bytes differ from space + text (those with a space mark U+2581 of their own) have no tokens: zeros and an
empty groups_sha256; strings of special tokens are plain text; repeated rows count as documents of their own; an empty table gives an empty result; columns of the
input that clash with results are not read. A text without any space or line feed is one part, which the two libraries encode whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from recordmill.llm.batches import slices
from recordmill.session import stored

MARK = "▁"
#: Bytes of text of a chunk (a longer text is a chunk of its own), and what a row counts for besides its text.
CHUNK, ROW = 8 << 20, 64
#: Bytes of parts that a worker remembers, by estimate, in two halves; longer parts than LONGEST characters aren't remembered. ENTRY: what a part takes besides
#: its characters, groups and links (the heads of three strings and a tuple, 203 bytes by sys.getsizeof with its collector's head, and a place in a dict).
MEMO_BYTES, LONGEST, ENTRY = 160 << 20, 64, 300
#: Before a space or a line feed that follows other than white space and isn't the last character.
CUT = re.compile(r"(?<=\S)(?=[ \n].)", re.DOTALL)
HIGH = 1 << 32


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where Latin-1 shows it, else the next free one from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def merged(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both pointers at every step of the merge of two lists of cumulative ends that end together, and whether both tokens end there.

    A step ends where either token does, and the pointer moves on whose token ends; so each step is one overlapping pair, and each pair one step.
    """
    steps = np.union1d(ends_a, ends_b)
    at_a, at_b = np.searchsorted(ends_a, steps), np.searchsorted(ends_b, steps)
    return at_a, at_b, ends_a[at_a] == ends_b[at_b]


class Aligner:
    """Both tokenizers with the memo of parts: (n_a, n_b, groups with a semicolon after each, links as bytes), or None for a part whose bytes differ."""

    def __init__(self, a_path: str, b_path: str, memo_bytes: int = MEMO_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        own = byte_alphabet()
        a_bytes = {i: bytes(map(own.__getitem__, t)) for t, i in self.a.get_vocab(with_added_tokens=False).items() if own.keys() >= set(t)}
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("a piece of B goes over a space or a line feed, where texts are cut")
        b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_bytes, self.b_bytes = [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)], b_bytes
        self.a_size, self.b_size = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, b_bytes))
        self.n = n = max(len(self.a_bytes), len(b_bytes))
        self.written = [f"{i}{mark}" for mark in ",|;" for i in range(n)]  # an id inside a list, at the end of a group's A ids, of its B ids
        self.lead = len(b.encode("\n"))  # B puts a mark before each text; a line feed takes it, and both are dropped
        self.most, self.held = memo_bytes // 2, 0
        self.memo: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    @staticmethod
    def parts(text: str | None) -> list[str]:
        return CUT.split(" " + text) if text else []

    def learn(self, parts: set[str]) -> list[str]:
        """Put what the parts give into the memo, and name those that are too long to stay there after the slice. The memo has two halves: when the newer is
        full it becomes the older, from which parts come back as they are met."""
        if self.held > self.most:
            self.older, self.memo, self.held = self.memo, {}, 0
        new = parts.difference(self.memo)
        back = new.intersection(self.older)
        found = {p: self.older[p] for p in back}
        found |= self._aligned(list(new - back))
        self.memo |= found
        self.held += sum([ENTRY + 2 * len(p) + (len(own[2]) + len(own[3]) if own else 0) for p, own in found.items() if len(p) <= LONGEST])
        return [p for p in found if len(p) > LONGEST]

    def _aligned(self, parts: list[str]) -> dict[str, tuple | None]:
        """Both encodings of all parts, laid end to end, so that one merge serves them all."""
        found: dict[str, tuple | None] = {p: None for p in parts if MARK in p}  # B's bytes of such a part are fewer than its own
        parts = [p for p in parts if MARK not in p]
        if not parts:
            return found
        ids_a = [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        ids_b = [x[self.lead :] for x in self.b.encode(["\n" + p for p in parts], num_threads=1)]
        every_a, every_b = ([*chain.from_iterable(ids)] for ids in (ids_a, ids_b))
        raw = "".join(parts).encode()
        for ids, every, pieces in ((ids_a, every_a, self.a_bytes), (ids_b, every_b, self.b_bytes)):
            if b"".join(map(pieces.__getitem__, every)) != raw:  # it never is, but for parts as those above
                differ = [b"".join([pieces[i] for i in own]) != p.encode() for own, p in zip(ids, parts, strict=True)]
                found |= {p: None for p, d in zip(parts, differ, strict=True) if d}
                return found | self._aligned([p for p, d in zip(parts, differ, strict=True) if not d])
        flat_a, flat_b = np.array(every_a, np.int64), np.array(every_b, np.int64)
        at_a, at_b, both = merged(np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b]))
        links = (flat_a[at_a] * HIGH + flat_b[at_b]).tobytes()
        # all ids in the order in which groups are written: A's of a group, then B's
        stop_a, stop_b = at_a[both] + 1, at_b[both] + 1
        size_a, size_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
        place_a, place_b = np.arange(len(flat_a)) + np.repeat(stop_b - size_b, size_a), np.arange(len(flat_b)) + np.repeat(stop_a, size_b)
        order = np.empty(len(flat_a) + len(flat_b), np.int64)
        order[place_a], order[place_b] = flat_a, flat_b
        order[place_a[stop_a - 1]] += self.n
        order[place_b[stop_b - 1]] += 2 * self.n
        written = [*map(self.written.__getitem__, order.tolist())]
        # the last step of each part is that of its last A token, and ends a group
        last = np.cumsum([*map(len, ids_a)]) - 1
        s0, w0 = 0, 0
        for p, a, b, s1 in zip(parts, ids_a, ids_b, (8 * np.searchsorted(at_a, last, "right")).tolist(), strict=True):
            w1 = w0 + len(a) + len(b)
            found[p] = len(a), len(b), "".join(written[w0:w1]), links[s0:s1]
            s0, w0 = s1, w1
        return found

    def aligned(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """For each text: numbers of A tokens, B tokens and groups, the groups, and all links."""
        cut = [self.parts(t) for t in texts]
        longer = self.learn(set().union(*cut))
        get = self.memo.__getitem__
        try:
            for own in cut:
                got = [*map(get, own)]
                if not got or None in got:
                    yield 0, 0, 0, "", np.zeros(0, np.int64)
                else:
                    each_a, each_b, groups, links = zip(*got, strict=True)
                    n_a, n_b, every = sum(each_a), sum(each_b), np.frombuffer(b"".join(links), np.int64)
                    # a step ends an A token, a B token, or both and a group
                    yield n_a, n_b, n_a + n_b - len(every), "".join(groups)[:-1], every
        finally:
            for p in longer:
                self.memo.pop(p, None)


@lru_cache(maxsize=1)
def lasting(a_path: str, b_path: str) -> Aligner:
    """The aligner of this Python worker."""
    return Aligner(a_path, b_path)


DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
#: Rows of two kinds: documents with their distinct pairs as places in the chunk's dictionary (pair, times), and dictionaries (pairs, held_by).
INNER = "chunk long, pair array<int>, times array<int>, pairs array<long>, held_by array<int>"


def _lists(parts: list[np.ndarray], kind: np.dtype) -> pa.Array:
    stops = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(stops, pa.array(np.concatenate([np.zeros(0, kind), *parts]).astype(kind)))


def token_chunks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False, chunk: int = CHUNK) -> DataFrame:
    """The rows of INNER beside doc_id, the columns of DOC and, if asked for, groups. A chunk's number holds within one run: write the rows before they are used twice."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number, size = lasting(a_path, b_path), TaskContext.get().partitionId() * HIGH, 0
        ids: list[pa.Array] = []
        made: list[tuple] = []
        distinct: list[np.ndarray] = []
        times: list[np.ndarray] = []

        def closed() -> Iterator[pa.RecordBatch]:
            pairs, place = np.unique(np.concatenate([np.zeros(0, np.int64), *distinct]), return_inverse=True)
            stops = np.cumsum([len(x) for x in distinct])
            every, own, n = pa.concat_arrays(ids), np.split(place.astype(np.int32), stops[:-1]), len(made)
            for at in range(0, n, 4096):
                to = min(n, at + 4096)
                k = to - at
                cols = [*zip(*made[at:to], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [every.slice(at, k), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:]], pa.array([number] * k, pa.int64()), _lists(own[at:to], np.int32), _lists(times[at:to], np.int32), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.int32()))],
                    names=names,
                )
            if len(pairs):
                held_by = np.bincount(place, minlength=len(pairs)).astype(np.int32)
                null = [pa.nulls(1, every.type), *[pa.nulls(1, pa.int64())] * 4, *[pa.nulls(1, pa.string())] * (1 + groups), pa.array([number], pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*null, _lists([pairs], np.int64), _lists([held_by], np.int32)], names=names)

        for whole in batches:
            for some in slices(whole, 1):
                ids.append(some.column(0))
                texts = some.column(1).to_pylist()
                for text, (n_a, n_b, n_groups, as_text, links) in zip(texts, aligner.aligned(texts), strict=True):
                    sha = hashlib.sha256(as_text.encode()).hexdigest() if n_a else ""
                    made.append((n_a, n_b, n_groups, len(links), sha, as_text) if groups else (n_a, n_b, n_groups, len(links), sha))
                    own, count = np.unique(links, return_counts=True)
                    distinct.append(own)
                    times.append(count.astype(np.int32))
                    size += ROW + len(text or "")
                if size >= chunk:
                    yield from closed()
                    ids, made, distinct, times, size, number = [], [], [], [], 0, number + 1
        if made:
            yield from closed()

    schema = f"doc_id {kind}, {DOC}{', groups string' * groups}, {INNER}"
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * groups, "chunk", "pair", "times", "pairs", "held_by"]
    return rows.mapInArrow(run, schema)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """Every linked pair of ids with the number of documents that hold it, and whether that is the greatest of its A id: pair, a_id, b_id, docs, best."""
    each = chunks.where(F.col("pairs").isNotNull()).select(F.explode(F.arrays_zip("pairs", "held_by")).alias("x"))
    counts = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held_by").alias("docs"))
    counts = counts.select("pair", _a(F.col("pair")).alias("a_id"), (F.col("pair") % HIGH).cast("int").alias("b_id"), "docs")
    most = counts.groupBy("a_id").agg(F.max("docs").alias("most"))
    return counts.join(most, "a_id").select("pair", "a_id", "b_id", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _a(pair: Column) -> Column:
    return F.shiftright(pair, 32).cast("int")


def scored(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """Documents with n_best (links whose pair is its A id's most frequent) and count_sum (documents of all their links' pairs)."""
    back = chunks.where(F.col("pairs").isNotNull()).select(F.col("chunk").alias("of_chunk"), F.explode("pairs").alias("pair")).join(counts.select("pair", "docs", "best"), "pair")
    docs = chunks.where(F.col("n_a").isNotNull()).drop("pairs", "held_by")
    kept = [f for f in docs.schema.fields if f.name not in ("chunk", "pair", "times")]
    names = [f.name for f in kept]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("pair").to_numpy())
        held, best = right.column("docs").to_numpy()[order], right.column("best").to_numpy()[order]
        n_best, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in left.to_batches():
            pair, times = batch.column(batch.schema.get_field_index("pair")), batch.column(batch.schema.get_field_index("times"))
            place, weight = pair.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            stops = np.concatenate([[0], np.cumsum(pair.value_lengths().to_numpy())])
            for out, value in ((n_best, best[place] * weight), (sums, held[place] * weight)):
                total = np.concatenate([[0], np.cumsum(value, dtype=np.int64)])
                out.append(total[stops[1:]] - total[stops[:-1]])
        return pa.Table.from_arrays([*(left.column(c) for c in names), pa.array(np.concatenate(n_best)), pa.array(np.concatenate(sums))], names=[*names, "n_best", "count_sum"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.groupBy("chunk").cogroup(back.groupBy("of_chunk")).applyInArrow(run, f"{schema}, n_best long, count_sum long")


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Every document with its numbers of tokens, groups and links, n_best and count_sum, and, if asked for, the groups themselves."""
    chunks = stored(token_chunks(docs, a_path, b_path, id_col, text_col, groups, chunk), "alignment")
    return scored(chunks, pair_counts(chunks))


def op12(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The contract's columns of every document."""
    return aligned(docs, a_path, b_path).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
