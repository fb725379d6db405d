"""Linear classifiers on character grams: a vocabulary of the most frequent grams, TF-IDF rows, and stochastic descent for several seeds at once.

Grams are numbers (a 64-bit hash of their code points), made in numpy inside Arrow batches. The vocabulary, the only thing that tasks share besides the weights, has a fixed size; so do
the weights: seeds x labels x vocabulary. Training rows are dealt to SHARDS by a hash of their ids, once for each seed, in an order of that seed's own, and each round runs through every
shard from the common weights and averages what the shards come to. A shard is a stream: a task holds its weights, never its rows. Nothing depends on cores, files or partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recordmill.session import checkpoint, clear_place, place, stored

WIDTHS, FEATURES = (2, 4), 60_000
SHARDS, ROUNDS, RATE = 8, 4, 0.3
#: Grams of a task that are counted before they are handed on, and weights of a row of the averaging.
COUNTED, CHUNK = 1 << 21, 8192


def gram_numbers(text: str, widths: tuple[int, int] = WIDTHS) -> np.ndarray:
    """A number for each character gram of a text, white space runs being one space and letters lower case; repeats included."""
    points = np.array([*map(ord, " ".join(text.lower().split()))], np.uint64)
    every = []
    for n in range(widths[0], widths[1] + 1):
        if len(points) >= n:
            h = np.full(len(points) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ points[k : len(points) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            every.append(h)
    return np.concatenate(every).view(np.int64) if every else np.zeros(0, np.int64)


@dataclass
class Vocabulary:
    """Numbers of grams in ascending order, and their inverse document frequencies."""

    numbers: np.ndarray
    idf: np.ndarray


def vocabulary(rows: DataFrame, text_col: str = "text", widths: tuple[int, int] = WIDTHS, features: int = FEATURES) -> Vocabulary:
    """The grams with most occurrences in all rows (least numbers among equals), with ln((1 + rows) / (1 + rows with it)) + 1. A task counts before it hands on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        once: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            g, tf = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            h, df = np.unique(np.concatenate([np.zeros(0, np.int64), *once]), return_counts=True)
            assert np.array_equal(g, h)
            return pa.RecordBatch.from_arrays([pa.array(g), pa.array(tf.astype(np.int64)), pa.array(df.astype(np.int64))], names=["g", "tf", "df"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = gram_numbers(text or "", widths)
                held.append(own)
                once.append(np.unique(own))
                size += len(own)
                if size >= COUNTED:
                    yield counted()
                    held, once, size = [], [], 0
        yield counted()

    per = rows.select(text_col).mapInArrow(run, "g long, tf long, df long").groupBy("g").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    top = per.orderBy(F.desc("tf"), "g").limit(features).collect()
    n = rows.count()
    top.sort(key=lambda r: r["g"])
    return Vocabulary(np.array([r["g"] for r in top], np.int64), np.log((1 + n) / (1 + np.array([r["df"] for r in top], np.float64))) + 1)


def packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending places in a vocabulary with their counts, in about a byte each: gaps and counts by planes of bytes, most of which are zero."""
    both = np.stack([np.diff(places, prepend=0), counts]).astype("<u4")
    how = zlib.compressobj(1, strategy=zlib.Z_RLE)
    return how.compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T).tobytes()) + how.flush()


def unpacked(data: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, TF-IDF of length 1) of packed()."""
    gaps, counts = np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").reshape(2, -1)
    x = np.cumsum(gaps, dtype=np.int64)
    v = counts * idf[x]
    return x, (v / max(1e-12, np.sqrt((v * v).sum()))).astype(np.float32)


def featured(rows: DataFrame, known: Vocabulary, text_col: str = "text", widths: tuple[int, int] = WIDTHS) -> DataFrame:
    """rows without their text, with f, the packed() grams of the vocabulary that a text has; weights are made where they are used."""
    kept = rows.drop("f")
    at = kept.columns.index(text_col)
    names = [c for c in kept.columns if c != text_col]
    places = [k for k, c in enumerate(kept.columns) if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(at).to_pylist():
                g, n = np.unique(gram_numbers(text or "", widths), return_counts=True)
                place = np.minimum(np.searchsorted(known.numbers, g), max(0, len(known.numbers) - 1))
                on = known.numbers[place] == g if len(known.numbers) else np.zeros(len(g), bool)
                found.append(packed(place[on], n[on]))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in places], pa.array(found, pa.binary())], names=[*names, "f"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != text_col)
    return kept.mapInArrow(run, f"{fields}, f binary")


def slope(loss: str, margin: np.ndarray) -> np.ndarray:
    """Derivative of a loss by the margin: hinge, squared hinge, logistic, or the modified Huber loss."""
    if loss == "hinge":
        return np.where(margin < 1, -1.0, 0.0)
    if loss == "squared_hinge":
        return -2.0 * np.maximum(0, 1 - margin)
    if loss == "log":
        return -1.0 / (1.0 + np.exp(np.clip(margin, -35, 35)))
    if loss == "modified_huber":
        return np.where(margin < -1, -4.0, np.where(margin < 1, -2.0 * (1 - margin), 0.0))
    raise ValueError(f"no such loss: {loss}")


@dataclass
class LinearModel:
    """Weights by (seed, label, gram; the last is the intercept), for labels in order, one against the rest."""

    seeds: list[int]
    labels: list[str]
    weights: np.ndarray
    loss: str

    def margins(self, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        return (self.weights[:, :, x] @ v + self.weights[:, :, -1]).astype(np.float64)


def trained(rows: DataFrame, idf: np.ndarray, label: str, key: str, seeds: list[int], loss: str = "hinge", balanced: bool = True, shards: int = SHARDS, rounds: int = ROUNDS, rate: float = RATE, counted: DataFrame | None = None) -> LinearModel:
    """A model of rows (key, label, f): adaptive steps, one pass a round. idf is the vocabulary's; balanced weighs each label's rows to count as much as any other's.

    Seeds are trained one after the other, and a seed's order of the rows is deleted after it. counted: the rows without their features, to count labels in, where features are made as they are read.
    """
    usable, size = rows.where(F.col(label).isNotNull()), len(idf)
    counts = {r["label"]: r["n"] for r in (rows if counted is None else counted).where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = sorted(counts)
    if len(labels) < 2:
        raise ValueError("training rows have fewer than two labels")
    total = sum(counts.values())
    weigh = {k: total / (len(labels) * n) if balanced else 1.0 for k, n in counts.items()}
    number = F.create_map(*[F.lit(x) for k, name in enumerate(labels) for x in (name, k)])
    model = LinearModel(list(seeds), labels, np.zeros((len(seeds), len(labels), size + 1), np.float32), loss)
    each = usable.select(number[F.col(label).cast("string")].alias("y"), F.lit(weigh[labels[0]]).alias("w") if not balanced else F.create_map(*[F.lit(x) for k, v in weigh.items() for x in (k, v)])[F.col(label).cast("string")].alias("w"), "f", F.col(key).cast("string").alias("key"))
    spark = rows.sparkSession
    for s, seed in enumerate(seeds):
        salt = F.lit(seed)
        dealt = each.select(F.lit(s).alias("s"), F.pmod(F.xxhash64("key", salt), F.lit(shards)).cast("int").alias("shard"), F.xxhash64(salt, "key").alias("h"), "y", "w", "f", "key")
        # a partition may hold several shards, one after the other
        path = place(spark, "linear")
        dealt.repartition(shards, "shard").sortWithinPartitions("shard", "h", "key").write.parquet(path)
        _one_seed(spark.read.schema(dealt.schema).parquet(path).select("s", "shard", "y", "w", "f"), model, idf, rounds, rate)
        clear_place(spark, path)
    return model


def _one_seed(ordered: DataFrame, model: LinearModel, idf: np.ndarray, rounds: int, rate: float) -> None:
    """The rounds of one seed, whose rows (s, shard, y, w, f) are in order; its weights are brought up to date."""
    labels, loss, size = model.labels, model.loss, len(idf)
    for _ in range(rounds):
        weights = model.weights

        def run(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            unit, own, seen, n = None, None, None, 0

            def closed() -> Iterator[pa.RecordBatch]:
                for k in range(len(labels)):
                    for at in range(0, size + 1, CHUNK):
                        yield pa.RecordBatch.from_arrays([pa.array([unit[0]], pa.int32()), pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([n], pa.int64()), pa.array([own[k, at : at + CHUNK]], pa.list_(pa.float32()))], names=["s", "k", "at", "n", "part"])

            for batch in batches:
                for s, shard, y, w, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (s, shard) != unit:
                        if unit is not None:
                            yield from closed()
                        unit, own, n = (s, shard), weights[s].copy(), 0
                        seen = np.full_like(own, 1e-6)
                    x, v = unpacked(f, idf)
                    n += 1
                    sign = np.full(len(labels), -1.0)
                    sign[y] = 1.0
                    g = w * sign * slope(loss, sign * (own[:, x] @ v + own[:, -1]))
                    if not g.any():  # no step
                        continue
                    for at, step in ((x, g[:, None] * v), (-1, g)):
                        seen[:, at] += step * step
                        own[:, at] -= rate * step / np.sqrt(seen[:, at])
            if unit is not None:
                yield from closed()

        def averaged(table: pa.Table) -> pa.Table:
            n = table.column("n").to_numpy().astype(np.float64)
            parts = np.stack([x.values.to_numpy() for x in table.column("part")])
            return pa.table({"s": table.column("s")[:1], "k": table.column("k")[:1], "at": table.column("at")[:1], "part": pa.array([(n @ parts / n.sum()).astype(np.float32)], pa.list_(pa.float32()))})

        parts = ordered.mapInArrow(run, "s int, k int, at int, n long, part array<float>").groupBy("s", "k", "at").applyInArrow(averaged, "s int, k int, at int, part array<float>")
        new = weights.copy()
        for r in parts.toLocalIterator():  # as many numbers as the model has
            new[r["s"], r["k"], r["at"] : r["at"] + CHUNK] = r["part"]
        model.weights = new


def predicted(rows: DataFrame, model: LinearModel, idf: np.ndarray) -> DataFrame:
    """rows without f, a row for each seed, with pred and probs (of the labels in order: logistic margins, or those of the loss, made to sum to 1)."""
    names = [c for c in rows.columns if c not in ("f", "seed", "pred", "probs")]
    kept = rows.select(*names, "f")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k = batch.num_rows, len(model.seeds)
            m = np.stack([model.margins(*unpacked(f, idf)) for f in batch.column(len(names)).to_pylist()]) if n else np.zeros((0, k, len(model.labels)))
            p = 1 / (1 + np.exp(-np.clip(m, -35, 35))) if model.loss == "log" else np.clip((m + 1) / 2, 1e-6, 1)
            p = p / p.sum(axis=2, keepdims=True)
            which = np.repeat(np.arange(n), k)
            best = m.argmax(axis=2).ravel()
            columns = [batch.column(i).take(pa.array(which)) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(model.seeds, n), pa.int32()), pa.array([model.labels[i] for i in best], pa.string()), pa.array([*p.reshape(-1, len(model.labels))], pa.list_(pa.float64()))], names=[*names, "seed", "pred", "probs"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name in names)
    return kept.mapInArrow(run, f"{fields}, seed int, pred string, probs array<double>")


def classified(rows: DataFrame, key: str, label: str, held_out: str, text_col: str = "text", seeds: list[int] = [42], loss: str = "hinge", features: int = FEATURES, widths: tuple[int, int] = WIDTHS, **how) -> tuple[DataFrame, LinearModel]:
    """(predictions of the held-out rows for every seed, the model), vocabulary and weights being learned from the others. Null texts have no grams; rows without a label aren't learned from."""
    rows = rows.select(key, label, held_out, text_col)  # read twice; the caller stores what is dear to make
    known = vocabulary(rows.where(~F.col(held_out)), text_col, widths, features)
    train, test = rows.where(~F.col(held_out)), rows.where(F.col(held_out))
    made = featured(train, known, text_col, widths)
    model = trained(stored(made, "featured") if len(seeds) > 1 else made, known.idf, label, key, seeds, loss, counted=train, **how)
    return checkpoint(predicted(featured(test, known, text_col, widths).select(key, label, "f"), model, known.idf)), model
