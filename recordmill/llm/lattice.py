"""Embedding near-dedup by lattice hashing (operator 5).

In each of TABLES tables a vector of length one is projected to eight random directions and decoded to the nearest point
of the E8 lattice; it is stored in that point's cell and also probes the PROBES neighbouring cells that lie nearest to
its projection. What meets in a cell is compared by cosine in double precision, tile by tile. A link that shows in
several cells counts in the first only, by recomputing the codes of its two ends, so that the links of a
vector are counted without a pair of rows for each; a tile pair gives sums and a spanning forest.

Equal vectors are one representative with a weight. At SCALE 0.7 a pair of cosine 0.9 meets in a table with a chance of about 0.57, so
it's missed in all four with one of about 0.03; nearer pairs less often. An unrelated pair meets with one of about 0.004 a table (simulated with 64 dimensions), so
comparisons are quadratic with a factor of about 0.015. Two points a table at scale 0.5 and nine tables would meet unrelated pairs 0.0002 of the time, at more than twice the keys
a vector; that isn't built.

Defined results: a vector that is null, empty, zero, or holds null or non-finite numbers links with nothing and is its own
component; vectors of different length never link; rows that repeat a vec_id are vectors of their own; a row without
vec_id has its links counted and its group's component, the smallest vec_id in it (null where none has one), and is never kept; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recordmill.llm.forest import spanning
from recordmill.operators.components import connected_components
from recordmill.session import checkpoint

TABLES, PROBES, SCALE = 4, 6, 0.7
SIMILARITY = 0.9
TILE = 1024
SEED = 88


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    found = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            found.append(v)
    found += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


ROOTS = _roots()
_MIX = np.random.default_rng(SEED).integers(0, 2**63, 9, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of even sum."""
    near = np.rint(x)
    off, odd = x - near, near.sum(axis=1) % 2 != 0
    at = np.abs(off).argmax(axis=1)
    rows = np.nonzero(odd)[0]
    near[rows, at[rows]] += np.where(off[rows, at[rows]] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: whole coordinates of even sum, or all of them shifted by a half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _cell(points: np.ndarray, table: int, dim: int) -> np.ndarray:
    """A 64-bit code of lattice points (last axis 8)."""
    doubled = np.rint(2 * points).astype(np.int64).view(np.uint64)
    x = np.full(points.shape[:-1], (table + 1) * 1_000_003 + dim, np.uint64) * _MIX[8]
    for k in range(8):
        x = (x ^ doubled[..., k]) * _MIX[k]
        x ^= x >> np.uint64(32)
    return x.view(np.int64)


_planes: dict[tuple, np.ndarray] = {}


def codes(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """(vectors, tables, 1 + probes): own cell, then the probed ones by nearness."""
    n, dim = unit.shape
    if (key := (dim, tables, scale)) not in _planes:
        _planes[key] = np.random.default_rng([SEED, dim]).normal(0, scale, (tables, dim, 8))
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        y = unit @ _planes[key][t]
        p = decode(y)
        nearest = np.argsort(-((y - p) @ ROOTS.T), axis=1, kind="stable")[:, :probes]
        out[:, t, 0] = _cell(p, t, dim)
        out[:, t, 1:] = _cell(p[:, None, :] + ROOTS[nearest], t, dim)
    return out


def _units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix of vectors of length one) for each length of vector."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        at = np.nonzero(sizes == d)[0]
        x = flat[starts[at][:, None] + np.arange(d)]
        x /= np.abs(x).max(axis=1, keepdims=True)
        yield at, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _counted(sid: np.ndarray, qid: np.ndarray, query: np.ndarray, table: int, cs: np.ndarray, cq: np.ndarray) -> np.ndarray:
    """Whether links met here (s is stored; q is stored too, or probes where query says so) are met here first."""
    def meet(t: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        own = a[:, t, 0] == b[:, t, 0]
        return own | (a[:, t, 1:] == b[:, t, :1]).any(axis=1) | (b[:, t, 1:] == a[:, t, :1]).any(axis=1)

    on = np.ones(len(sid), bool)
    for t in range(table):
        live = np.nonzero(on)[0]
        on[live[meet(t, cs[live], cq[live])]] = False
    mutual = query & (cs[:, table, 1:] == cq[:, table, :1]).any(axis=1)  # s probes the cell of q as well: the smaller one's probe counts
    return on & ~(mutual & (qid > sid))


def _compared(a: tuple, b: tuple, same: bool, table: int, setting: tuple) -> tuple[list, list, list]:
    """Links between two tiles of a cell as (src, dst, added): sums of weights (dst none) and a spanning forest (added 0)."""
    similarity, tables, probes, scale = setting
    (ia, wa, ra, xa), (ib, wb, rb, xb) = a, b
    n = 0 if same else len(ia)
    parent = np.arange(n + len(ib))
    sums = np.zeros(n + len(ib), np.int64)
    ids = ib if same else np.concatenate([ia, ib])
    src, dst = [], []
    code_a, code_b = None, None
    step = max(1, (1 << 18) // max(1, len(ib)))
    for k in range(0, len(ia), step):
        near = xa[k : k + step] @ xb.T >= similarity
        near &= ra[k : k + step, None] | rb[None, :]
        i, j = np.nonzero(near)
        i += k
        if same:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        if code_a is None:
            code_a, code_b = codes(xa, tables, probes, scale), codes(xb, tables, probes, scale)
        turned = ~ra[i]  # then the second is the stored one
        sid, qid = np.where(turned, ib[j], ia[i]), np.where(turned, ia[i], ib[j])
        cs = np.where(turned[:, None, None], code_b[j], code_a[i])
        cq = np.where(turned[:, None, None], code_a[i], code_b[j])
        on = _counted(sid, qid, ~(ra[i] & rb[j]), table, cs, cq)
        i, j = i[on], j[on]
        sums += np.bincount(i, wb[j], len(sums)).astype(np.int64) + np.bincount(j + n, wa[i], len(sums)).astype(np.int64)
        x, y = spanning(parent, i, j + n)
        src.append(ids[x])
        dst.append(ids[y])
    met = np.nonzero(sums)[0]
    joined = sum(map(len, src))
    return [*np.concatenate(src).tolist(), *ids[met].tolist()] if src else [], [*np.concatenate(dst).tolist(), *[None] * len(met)] if src else [], [*[0] * joined, *sums[met].tolist()]


def near_vectors(vectors: DataFrame, similarity: float = SIMILARITY, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, tile: int = TILE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    setting = (similarity, tables, probes, scale)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    real = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("h", F.when(F.coalesce(real, F.lit(False)), F.xxhash64("v")))
    # one representative for equal vectors, named by a number of its own, so that ids may be null or repeat
    classes = rows.where("h IS NOT NULL").groupBy("h", "v").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("weight"))
    classes = checkpoint(classes.withColumn("rep", F.monotonically_increasing_id()))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                rep = part.column(0).to_numpy(zero_copy_only=False)
                for at, unit in _units(part.column(1)):
                    found = codes(unit, tables, probes, scale)
                    shape = found.shape
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(rep[at], shape[1] * shape[2])), pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), shape[2]), shape[0])),
                        pa.array(found.reshape(-1)), pa.array(np.tile(np.arange(shape[2]) == 0, shape[0] * shape[1]))], names=["rep", "t", "cell", "own"])

    keys = classes.select("rep", "v").mapInArrow(coded, "rep long, t int, cell long, own boolean")
    keys = checkpoint(keys)
    used = keys.groupBy("t", "cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("stored")).where("stored > 0 AND n > 1")
    used = used.select("t", "cell", F.ceil(F.col("n") / tile).cast("int").alias("n_sub"))
    met = keys.join(used, ["t", "cell"]).withColumn("sub", F.pmod(F.xxhash64("rep"), "n_sub").cast("int"))
    full = met.join(classes.select("rep", "weight", "v"), "rep")
    tiles = full.groupBy("t", "cell", "sub", "n_sub").agg(F.collect_list(F.struct("rep", "weight", "own", "v")).alias("rows"))
    several = checkpoint(tiles.where("n_sub > 1"))  # hot cells only; the others are compared where they were gathered

    def tile_of(column: pa.Array, k: int) -> tuple:
        r = column[k].values
        return r.field(0).to_numpy(zero_copy_only=False), r.field(1).to_numpy(zero_copy_only=False), r.field(2).to_numpy(zero_copy_only=False).astype(bool), next(_units(r.field(3)))[1]  # a cell's vectors are of one length

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst, added = [], [], []
            for k in range(batch.num_rows):
                same = batch.column(2)[k].as_py()
                a = tile_of(batch.column(1), k)
                for one, own in zip((src, dst, added), _compared(a, a if same else tile_of(batch.column(3), k), same, batch.column(0)[k].as_py(), setting), strict=True):
                    one += own
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(added, pa.int64())], names=["src", "dst", "added"])

    alone = tiles.where("n_sub = 1").select("t", F.col("rows").alias("left"), F.lit(True).alias("same"), F.lit(None).cast(tiles.schema["rows"].dataType).alias("right"))
    left = several.select("t", "cell", F.col("rows").alias("left"), F.col("sub").alias("a"), F.explode(F.sequence("sub", F.col("n_sub") - 1)).alias("sub"))
    pairs = left.join(several.select("t", "cell", "sub", F.col("rows").alias("right")), ["t", "cell", "sub"]).select("t", "left", (F.col("a") == F.col("sub")).alias("same"), "right")
    schema = "src long, dst long, added long"
    found = checkpoint(alone.mapInArrow(compare, schema).union(pairs.mapInArrow(compare, schema)))
    counts = found.where("dst IS NULL").groupBy(F.col("src").alias("rep")).agg(F.sum("added").alias("others"))
    comps = connected_components(found.where("dst IS NOT NULL"))
    named = classes.select("rep", "h", "v", "low", "weight").join(comps, F.col("rep") == F.col("node"), "left").withColumn("group", F.coalesce("component", "rep"))
    least = named.groupBy("group").agg(F.min("low").alias("component_id"))
    named = named.join(least, "group").join(counts, "rep", "left").select("h", "v", "component_id", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = rows.join(named, ["h", "v"], "left")
    comp = F.when(F.col("h").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))


def op5(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors)
