"""Language identification by a bidirectional gated recurrent network over bytes (operator 1).

The network is written and trained in numpy, by backpropagation through time. It reads the UTF-8 bytes of the lower-cased text, white space as
single spaces, in both directions, and labels every byte position with language probabilities; a document's probabilities are the
mean over all its positions. Long texts are read in windows of CORE labelled bytes with MARGIN bytes of context on either side, so the state
is carried across words and no label stands on less context than that.

It is fitted on the driver to a bounded sample: about PER_LANG labelled documents of each language, those of least hash, with an
excerpt of EXCERPT characters each from a hashed place. Everything else covers whole texts.

Defined results: a null text, one without letters, and any text where no labelled row exists are `und` with score 0; ties go to
the language that sorts first; repeated rows are judged alike; an empty table gives an empty result; columns of the
input that clash with results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recordmill.llm.batches import slices, spread

PER_LANG, EXCERPT = 256, 1200
HIDDEN, EPOCHS, STEPS, RATE = 16, 4, 240, 0.02
#: Labelled bytes and context of a window, windows read at once, and bytes of a window in training.
CORE, MARGIN, TOGETHER, TRAINED = 256, 16, 1024, 64
UND, BLANK = "und", 32


class ByteGru:
    """Two gated recurrent layers over bytes, one in each direction, and a softmax at every position. Gates are hard sigmoids, clipped at 0 and 1."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 5):
        rng, h, n = np.random.default_rng(seed), hidden, len(langs)
        self.langs, self.h = langs, h
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (3, 256, h)).astype(np.float32)  # update, reset and candidate, by byte
            self.p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(h), (3, h, h)).astype(np.float32)
            self.p[f"v{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, n)).astype(np.float32)
        self.p["c"] = np.zeros(n, np.float32)

    def _layer(self, rows: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (positions, windows, h) of windows of equal length; keep gets what going back needs."""
        x, u, h = self.p[f"x{d}"], self.p[f"u{d}"], self.h
        n, length = rows.shape
        out, state, steps = np.empty((length, n, h), x.dtype), np.zeros((n, h), x.dtype), np.ascontiguousarray(rows.T)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            g, hu = x.take(steps[t], axis=1), np.matmul(state, u)
            gates = g[:2]
            gates += hu[:2]
            gates *= 0.25
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            z, r = gates
            cand = r * hu[2]
            cand += g[2]
            np.tanh(cand, out=cand)
            if keep is not None:
                keep.append((t, state, z, r, cand, hu[2]))
            state = state - cand
            state *= z
            state += cand
            out[t] = state
        return out

    def _softmax(self, forth: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Of the logits of all positions. States lie within 1, so the weights bound the logits; the greatest is taken off where they might overflow."""
        vf, vb, c = self.p["vf"], self.p["vb"], self.p["c"]
        z = forth.reshape(-1, self.h) @ vf
        z += back.reshape(-1, self.h) @ vb
        z += c
        if (np.abs(vf).sum(axis=0) + np.abs(vb).sum(axis=0) + np.abs(c)).max() > 60:
            z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z @ np.ones((len(c), len(c)), z.dtype)
        return z.reshape(*forth.shape[:2], len(c))

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """(positions, windows, languages)."""
        return self._softmax(self._layer(rows, "f"), self._layer(rows, "b"))

    def gradients(self, rows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all positions."""
        h, grads, (n, length) = self.h, {}, rows.shape
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: self._layer(rows, d, kept[d]) for d in "fb"}
        err = self._softmax(states["f"], states["b"])
        err[:, np.arange(n), labels] -= 1
        err /= n * length
        grads["c"] = err.sum(axis=(0, 1))
        order = np.argsort(rows.T.ravel(), kind="stable")  # positions by byte, to sum what each byte's weights get
        present, first = np.unique(rows.T.ravel()[order], return_index=True)
        for d in "fb":
            u, down = self.p[f"u{d}"], err @ self.p[f"v{d}"].T
            grads[f"v{d}"] = states[d].reshape(-1, h).T @ err.reshape(n * length, -1)
            gu, gx, back, got = np.zeros_like(u), np.zeros_like(self.p[f"x{d}"]), np.zeros((n, h), u.dtype), np.empty((3, length, n, h), u.dtype)
            for t, before, z, r, cand, hu_n in reversed(kept[d]):
                back = back + down[t]
                dcand = back * (1 - z) * (1 - cand * cand)
                own = got[:, t]
                own[0] = 0.25 * back * (before - cand) * ((z > 0) & (z < 1))
                own[1] = 0.25 * dcand * hu_n * ((r > 0) & (r < 1))
                own[2] = dcand
                du = own.copy()
                du[2] *= r
                gu += before.T @ du
                back = back * z + np.matmul(du, u.transpose(0, 2, 1)).sum(axis=0)
            gx[:, present] = np.add.reduceat(got.reshape(3, -1, h)[:, order], first, axis=1)
            grads[f"u{d}"], grads[f"x{d}"] = gu, gx
        return grads

    def fit(self, rows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, batch: int = 256, seed: int = 7) -> "ByteGru":
        """Adam over batches of windows, in an order drawn anew for each epoch; of few windows there are more epochs, for STEPS steps at least."""
        rng, epochs = np.random.default_rng(seed), max(epochs, -(-STEPS // -(-len(rows) // batch)))
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step, total = 0, epochs * -(-len(rows) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(rows), batch):
                own, step = order[k : k + batch], step + 1
                now = rate * (1 - 0.9 * step / total) * min(1.0, len(own) / 64)
                for name, g in self.gradients(rows[own], labels[own]).items():
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.p[name] -= now * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        return self

    def pooled(self, texts: list[bytes], core: int = CORE, margin: int = MARGIN) -> np.ndarray:
        """(texts, languages): the probabilities of each text, the mean over all its positions.

        The last window of a text reaches back to full length and labels only what those before it left; blanks stand around a text."""
        out = np.zeros((len(texts), len(self.langs)))
        owner, skipped, used, cut = [], [], [], []

        def flush() -> None:
            if cut:
                rows = np.frombuffer(b"".join(cut), np.uint8).reshape(len(cut), core + 2 * margin)
                found, at = self.probabilities(rows)[margin : margin + core], np.arange(core)[:, None]
                found *= ((at >= np.array(skipped)) & (at < np.array(used)))[:, :, None]
                np.add.at(out, owner, found.sum(axis=0))
                for x in (owner, skipped, used, cut):
                    x.clear()

        blank = bytes([BLANK]) * margin
        for i, text in enumerate(texts):
            whole = blank + text + bytes([BLANK]) * max(0, core - len(text)) + blank
            for k in range(0, len(text), core):
                start = max(0, min(k, len(text) - core))
                cut.append(whole[start : start + core + 2 * margin])
                owner.append(i)
                skipped.append(k - start)
                used.append(min(core, len(text) - start))
                if len(cut) >= TOGETHER:
                    flush()
        flush()
        return out / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def bytes_of(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").split())


def held_out() -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, per_lang: int = PER_LANG, excerpt: int = EXCERPT) -> ByteGru | None:
    """The network of the labelled rows that may be learned from; None if there are none.

    The labelled rows of each language are counted first, equal ones once and to about 2 %, and a row is sampled where the hash of its document lies below twice its language's share, so
    that what leaves a task is its part of the sample and not a number for each task; rows that repeat count once there too. The per_lang of least hash are learned from. A language in fewer
    than four times per_lang rows offers all of them.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).withColumn("h", F.xxhash64("doc_id", F.xxhash64("text")))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2 * per_lang / n) if n > 4 * per_lang else 1.0)])
    drawn = usable.where(F.pmod("h", F.lit(1 << 40)) < share[F.col("lang")] * float(1 << 40))
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - excerpt)) + 1
    rows = drawn.select("lang", "h", F.substring("text", place, F.lit(excerpt)).alias("part")).distinct().collect()
    rows.sort(key=lambda r: (r["lang"], r["h"], r["part"]))
    langs, windows, labels, seen = sorted(counts), [], [], dict.fromkeys(counts, 0)
    for r in rows:
        seen[r["lang"]] += 1
        if seen[r["lang"]] <= per_lang:
            own = bytes_of(r["part"])
            own += bytes([BLANK]) * (-len(own) % TRAINED)
            windows += [own[k : k + TRAINED] for k in range(0, len(own), TRAINED)]
            labels += [langs.index(r["lang"])] * (len(own) // TRAINED)
    if not windows:
        return None
    return ByteGru(langs).fit(np.frombuffer(b"".join(windows), np.uint8).reshape(-1, TRAINED), np.array(labels, np.int64))


def identify(docs: DataFrame, model: ByteGru | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    kept = docs.drop("lang_pred", "score")
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for some in slices(whole, at):
                texts = [x or "" for x in some.column(at).to_pylist()]
                preds, scores = [UND] * len(texts), np.zeros(len(texts))
                real = [i for i, x in enumerate(texts) if model is not None and any(map(str.isalpha, x))]
                if real:
                    share = model.pooled([bytes_of(texts[i]) for i in real])
                    for i, own in zip(real, share, strict=True):
                        best = int(own.argmax())
                        preds[i], scores[i] = model.langs[best], min(1.0, float(own[best]))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(preds), pa.array(scores)], names=[*some.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double")


def op1(docs: DataFrame) -> DataFrame:
    """The contract's columns of every document."""
    model = fitted(docs.select("doc_id", "text", "lang"))
    return identify(spread(docs.select("doc_id", "text")).select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
