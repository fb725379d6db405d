"""SentencePiece encoding and decoding of merge-type vocabularies (operator 3).

The merges run on a score-ordered agenda: a heap holds every adjacent symbol pair whose concatenation is a piece,
best score first and leftmost among equals; popping the best pair joins it and queues its two new neighbours.
Where a slice has many new parts, their agendas are the columns of a matrix, and each round pops the best pair of every part.
Symbols that remain and are no pieces fall back to byte pieces. A text is cut where no merge can reach across
(before a run of the space mark, around a line feed): every cut part is encoded once per slice and remembered, in two halves that together
hold about MEMO_BYTES, and each part new to the memo is checked against the sentencepiece library in that slice. The memo lasts for a task, or, if
asked for, for the Python worker, whose next task finds it.

Defined results: a null text is an empty text; an empty text has no ids and decodes to an empty text; rows keep their
other columns; repeated rows are encoded alike.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from recordmill.llm.batches import slices, spread

SPACE = "▁"
#: Bytes of parts that a task or worker remembers, by an estimate of ENTRY bytes for each besides its characters; a bound on memory, not on the texts.
MEMO_BYTES, ENTRY = 128 << 20, 160
#: Parts from which on matrices of agendas pay, columns of a matrix, characters of a part in one (its places have PLACE bits), and what stands for no pair.
MANY, COLUMNS, PLACE, NONE = 64, 2048, 6, 2**31 - 1


class MergeModel:
    """A merge-type SentencePiece vocabulary: pieces, scores and the library that checks them."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        order = sorted({sp.get_score(i) for i in plain}, reverse=True)
        places = {x: k for k, x in enumerate(order)}
        self.rank = {self.pieces[i]: places[sp.get_score(i)] for i in plain}
        self.numbers = [f"{i}{end}" for end in ",\n" for i in range(n)]  # inside a part and at its end
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        longer = [p for p in self.ids if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in longer) or any("\n" in p for p in longer) or len(self.byte_ids) != 256:
            raise ValueError("this vocabulary merges across word starts or line feeds, or has no byte pieces")

    def merge(self, part: str) -> list[int]:
        """Ids of one part by the agenda: a heap of rank and position in one number, so that equal scores go left to right."""
        if (n := len(part)) == 1:
            return self._id(part)
        rank, pop, push, symbols = self.rank.get, heapq.heappop, heapq.heappush, [*part]
        pair = [*map(rank, map(add, part, part[1:])), None]  # rank of each symbol joined with its right neighbour
        bits = n.bit_length()
        low = (1 << bits) - 1
        agenda = [r << bits | i for i, r in enumerate(pair) if r is not None]
        if agenda:
            after, before = [*range(1, n + 1)], [*range(-1, n)]
            heapq.heapify(agenda)
            while agenda:
                top = pop(agenda)
                i = top & low
                if pair[i] != top >> bits:
                    continue  # one of the two has been joined to another symbol since
                j = after[i]
                symbols[i] = joined = symbols[i] + symbols[j]
                symbols[j] = pair[j] = None
                after[i] = k = after[j]
                before[k] = i
                if k < n:
                    pair[i] = r = rank(joined + symbols[k])
                    if r is not None:
                        push(agenda, r << bits | i)
                else:
                    pair[i] = None
                if (h := before[i]) >= 0:
                    pair[h] = r = rank(symbols[h] + joined)
                    if r is not None:
                        push(agenda, r << bits | h)
        ids = [*map(self.ids.get, filter(None, symbols))]
        return ids if None not in ids else [i for x in symbols if x for i in self._id(x)]

    @cached_property
    def _symbols(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Symbols are numbered: pieces, their characters that are none, and one number for any other character. The number of each code point; the pairs that join to a piece
        (left * size + right, in order), the symbol and the rank that each makes; the id of each symbol or -1; and size."""
        number = {p: i for i, p in enumerate(dict.fromkeys(chain(self.ids, chain.from_iterable(self.ids))))}
        size = len(number) + 1
        points = np.full(0x110000, size - 1, np.int32)
        pairs = []
        for p, made in number.items():
            if len(p) == 1:
                points[ord(p)] = made
            for k in range(1, len(p)):
                if (left := number.get(p[:k])) is not None and (right := number.get(p[k:])) is not None:
                    pairs.append((left * size + right, made, self.rank[p]))
        keys, made, ranks = np.array([*sorted(pairs), (np.iinfo(np.int64).max, 0, 0)], np.int64).T.copy()  # the last is met by no key
        return points, keys, made.astype(np.int32), ranks.astype(np.int32), np.array([*(self.ids.get(p, -1) for p in number), -1], np.int32), size

    def merge_all(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts as merge() has them, one part after the other, and their sizes."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(lengths, kind="stable")
        short = int(np.searchsorted(lengths[order], 1 << PLACE, "left")) if len(parts) >= MANY else 0
        ids, sizes = [], []
        for k in range(0, short, COLUMNS):
            own = order[k : min(k + COLUMNS, short)]
            some, n = self._rounds([parts[i] for i in own.tolist()], lengths[own])
            for c in np.unique(np.repeat(np.arange(len(n)), n)[some < 0])[::-1].tolist():  # has symbols that are no pieces
                found, at = self.merge(parts[own[c]]), int(n[:c].sum())
                some = np.concatenate([some[:at], np.array(found, np.int32), some[at + n[c] :]])
                n[c] = len(found)
            ids.append(some)
            sizes.append(n)
        rest = [self.merge(parts[i]) for i in order[short:].tolist()]
        ids.append(np.fromiter(chain.from_iterable(rest), np.int32))
        sizes.append(np.fromiter(map(len, rest), np.int64, len(rest)))
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        back = np.argsort(order)  # in the order of parts again
        starts, sizes = (np.cumsum(sizes) - sizes)[back], sizes[back]
        return ids[np.arange(len(ids)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)], sizes

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pair: whether it joins to a piece, and if so which symbol and rank it makes."""
        _, keys, made, ranks, _, size = self._symbols
        key = left.astype(np.int64) * size + right
        at = np.searchsorted(keys, key)
        return keys[at] == key, made[at], ranks[at]

    def _rounds(self, parts: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1 for symbols that are no pieces) and sizes of parts of about one length, a part being a column of each matrix. The row after the last stands for what lies beyond either end."""
        points, _, _, _, numbers, size = self._symbols
        n, high = len(parts), int(lengths[-1])
        text = points[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        place = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        symbols = np.full((high + 1, n), size - 1, np.int32)
        symbols[place, np.repeat(np.arange(n), lengths)] = text
        rows = np.arange(high + 1, dtype=np.int32)[:, None]
        hit, joined, rank = self._pairs(symbols[:-1], symbols[1:])
        joined, agenda = (np.concatenate([x, np.full((1, n), y, np.int32)]) for x, y in ((joined, 0), (np.where(hit, rank << PLACE | rows[:-1], NONE), NONE)))
        after, before = np.repeat(rows + 1, n, axis=1), np.repeat(rows - 1, n, axis=1)
        done, columns = symbols.copy(), np.arange(n)
        while True:
            top = agenda.min(axis=0)
            live = np.flatnonzero(top < NONE)
            if 2 * len(live) < len(top):
                done[:, columns] = symbols
                if not len(live):
                    break
                columns, top = columns[live], top[live]
                symbols, joined, agenda, after, before = (x[:, live] for x in (symbols, joined, agenda, after, before))
                live = np.arange(len(live))
            i = top[live] & ((1 << PLACE) - 1)
            new, j = joined[i, live], after[i, live]
            k, h = after[j, live], before[i, live]
            symbols[i, live], symbols[j, live], agenda[j, live] = new, -1, NONE
            after[i, live], before[k, live] = k, i
            for at, left, right in ((i, new, symbols[k, live]), (h, symbols[h, live], new)):
                hit, made, rank = self._pairs(left, right)
                joined[at, live] = made
                agenda[at, live] = np.where(hit, rank << PLACE | at, NONE)
        kept = (done.T >= 0) & (rows.T < lengths[:, None])
        return numbers[done.T[kept]], kept.sum(axis=1)

    def _id(self, symbol: str) -> list[int]:
        i = self.ids.get(symbol)
        return [i] if i is not None else [self.byte_ids[b] for b in symbol.encode()]

    def text(self, ids: list[int]) -> str:
        """The text of ids inside a text: pieces joined, runs of byte pieces read as UTF-8, space marks turned back.

        Each byte that begins no valid sequence becomes one replacement mark."""
        if not self.byte_of.keys().isdisjoint(ids):
            runs: list[str | bytearray] = []
            for i in ids:
                if (b := self.byte_of.get(i)) is None:
                    runs.append(self.pieces[i])
                elif runs and isinstance(runs[-1], bytearray):
                    runs[-1].append(b)
                else:
                    runs.append(bytearray([b]))
            return "".join(x.replace(SPACE, " ") if isinstance(x, str) else _utf8(bytes(x)) for x in runs)
        return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        """The text of all ids of a text: as text(), without the space that encoding put before the first word."""
        if ids and self.pieces[ids[0]].startswith(SPACE):
            return self.text(ids)[1:]
        return self.text(ids)


def _utf8(raw: bytes) -> str:
    out, i = [], 0
    while i < len(raw):
        n = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
        try:
            out.append(raw[i : i + n].decode())
            i += n
        except UnicodeDecodeError:
            out.append("\ufffd")
            i += 1
    return "".join(out)


@lru_cache(maxsize=1)
def model_of(path: str) -> MergeModel:
    """The vocabulary, which a Python worker reads once."""
    return MergeModel(path)


PARTS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


class Encoder:
    """A model with the memo of parts: the decimal text of each part's ids, and what a part decodes to where that isn't the part itself."""

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        self.model, self.most = model_of(path), memo_bytes // 2
        self.memo: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.held = 0

    def parts(self, text: str) -> list[str]:
        return PARTS.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, texts: list[list[str]]) -> None:
        """Encode what the memo lacks and hold it against the library, in one call for the slice. The memo has two halves: when the newer
        is full it becomes the older, from which parts come back as they are met."""
        if self.held > self.most:
            self.older, self.memo, self.held = self.memo, {}, 0
            self.odd = {p: t for p, t in self.odd.items() if p in self.older}
        new = set().union(*texts).difference(self.memo)
        back = new.intersection(self.older)
        self.memo |= {p: self.older[p] for p in back}
        fresh = list(new - back)
        if fresh:
            ids, sizes = self.model.merge_all(fresh)
            said = self._library(fresh)
            stops = np.cumsum(sizes)
            if not np.array_equal(sizes, [*map(len, said)]) or not np.array_equal(ids, np.fromiter(chain.from_iterable(said), np.int32)):
                part, own, theirs = next(x for x in zip(fresh, map(np.ndarray.tolist, np.split(ids, stops[:-1])), said) if x[1] != x[2])
                raise ValueError(f"agenda and library differ on {part!r}: {own} and {theirs}")
            numbers, n = self.model.numbers, len(self.model.pieces)
            places = ids.astype(np.int64)
            places[stops - 1] += n
            self.memo.update(zip(fresh, "".join(map(numbers.__getitem__, places.tolist())).split("\n")))
            # without byte pieces the ids are the part's own symbols
            for k in np.unique(np.searchsorted(stops, np.flatnonzero(np.isin(ids, [*self.model.byte_of])), "right")).tolist():
                if (decoded := self.model.text(said[k])) != fresh[k].replace(SPACE, " "):
                    self.odd[fresh[k]] = decoded
        self.held += ENTRY * len(new) + 2 * sum(map(len, new))

    def decoded(self, parts: list[str]) -> str:
        """What the ids of a text's parts decode to, without the space that encoding put before the first word."""
        if self.odd and not self.odd.keys().isdisjoint(parts):
            return "".join([self.odd.get(p) or p.replace(SPACE, " ") for p in parts])[1:]
        return "".join(parts).replace(SPACE, " ")[1:]

    def _library(self, parts: list[str]) -> list[list[int]]:
        """The library's ids of parts as they stand inside a text: it would put a space mark before each, so a line feed is put there and the two leading ids dropped."""
        lead = self.model.library.encode("\n")
        return [x[len(lead) :] for x in self.model.library.encode(["\n" + p for p in parts], num_threads=1)]


@lru_cache(maxsize=1)
def lasting(path: str) -> Encoder:
    """The encoder of this Python worker."""
    return Encoder(path)


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text", ids: bool = False, decoded: bool = False, check_whole: bool = False, last: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids and decoded_text.

    check_whole also encodes and decodes every whole text with the library (about 2 MB a second and core) and raises where they differ.
    last keeps the model and its memo in the Python workers for later tasks, which then need not encode frequent parts again; the memory stays theirs.
    Clashing columns of docs are replaced.
    """
    made = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    made |= {"token_ids": T.ArrayType(T.IntegerType())} if ids else {}
    made |= {"decoded_text": T.StringType()} if decoded else {}
    kept = docs.drop(*made)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(k, v) for k, v in made.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = lasting(model_path) if last else Encoder(model_path)
        for whole in batches:
            for some in slices(whole, text_col):
                yield _slice(enc, some, text_col, ids, decoded, check_whole)

    return kept.mapInArrow(run, schema)


def _slice(enc: Encoder, rows: pa.RecordBatch, text_col: str, ids: bool = False, decoded: bool = False, check_whole: bool = False) -> pa.RecordBatch:
    texts = [x or "" for x in rows.column(text_col).to_pylist()]
    parts = [enc.parts(x) for x in texts]
    enc.learn(parts)
    n_tokens, ids_sha, decoded_sha, token_ids, decoded_text = [], [], [], [], []
    for own in parts:
        numbers = ",".join([*map(enc.memo.__getitem__, own)])
        text = enc.decoded(own)
        n_tokens.append(numbers.count(",") + 1 if numbers else 0)
        ids_sha.append(hashlib.sha256(numbers.encode()).hexdigest())
        decoded_sha.append(hashlib.sha256(text.encode()).hexdigest())
        if ids or check_whole:
            token_ids.append(np.fromstring(numbers, np.int32, sep=",") if numbers else np.zeros(0, np.int32))
        if decoded or check_whole:
            decoded_text.append(text)
    if check_whole:
        library = enc.model.library
        theirs = library.encode(texts, num_threads=1)
        if theirs != [x.tolist() for x in token_ids] or [library.decode(x) if x else "" for x in theirs] != decoded_text:
            raise ValueError("agenda and library differ on a whole text")
    columns = {"n_tokens": pa.array(n_tokens, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(decoded_sha, pa.string())}
    if ids:  # straight into an Arrow buffer
        stops = np.concatenate([[0], np.cumsum(n_tokens)]).astype(np.int32)
        columns["token_ids"] = pa.ListArray.from_arrays(stops, pa.array(np.concatenate(token_ids) if token_ids else np.zeros(0, np.int32)))
    if decoded:
        columns["decoded_text"] = pa.array(decoded_text, pa.string())
    return pa.RecordBatch.from_arrays([*rows.columns, *columns.values()], names=[*rows.schema.names, *columns])


def op3(docs: DataFrame, model_path: str) -> DataFrame:
    """The contract's digest columns of every document."""
    return encode_decode(spread(docs.select("doc_id", "text")), model_path, last=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
