"""Secret scans with corpus-wide ownership frequency (operator 7).

Every text gives base spans of three fixed kinds and candidate tokens of mixed letters and digits. Candidates are
hashed; the hashes are aggregated over the corpus to the number of distinct repositories and owners that hold each.
A hash that many owners hold is a copied example; one held by at most max_owners is live-looking and its spans are
added, as kind "owned", to the base spans, which always stay and carry the same verdict in their field live.

Defined results: a null or empty text has no spans; repeated rows are scanned each on their own and count once for
their repository; a null owner or repository counts as one of its own kind; empty tables give empty results;
columns of the input that clash with results are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from recordmill.llm.batches import slices, spread
from recordmill.session import stored

# The base kinds, in their order. ASCII letters only, in either case where IGNORECASE stands.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "owned")

#: Cheap tests of a whole column: a text that fails one has no match of that kind.
MAY_ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]"
MAY_ACCESS = "AKIA"
MAY_HEX = "[0-9a-f]{32}"
MAY_TOKEN = r"[A-Za-z0-9+/_\-]{20}"
#: A candidate token: 20 or more characters of the key alphabets that hold a digit, a lower-case and an upper-case letter.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{20,}(?![A-Za-z0-9+/_\-])")
MIXED = (re.compile("[0-9]"), re.compile("[a-z]"), re.compile("[A-Z]"))
#: The same for the JVM, in one pattern.
HAS_TOKEN = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])(?=[A-Z0-9+/_\-]*+[a-z])(?=[a-z0-9+/_\-]*+[A-Z])[A-Za-z0-9+/_\-]{20}"

FOUND = "array<struct<kind:int,start:int,stop:int,hash:string>>"
FOUND_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("hash", pa.string())]))


def _hash(value: str) -> str:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def spans_of(text: str, assign: bool = True, access: bool = True, hexes: bool = True, tokens: bool = True) -> list[tuple[int, int, int, str]]:
    """(kind, start, stop, hash of the value) by start and kind; candidate tokens that overlap a base span are left out."""
    out = []
    if assign:
        out += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if access:
        out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    if hexes:
        out += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    if tokens:
        base, k = sorted((a, b) for _, a, b, _ in out), 0
        reach = -1  # the furthest end of the base spans that start before the end of the token
        for m in TOKEN.finditer(text):
            while k < len(base) and base[k][0] < m.end():
                reach = max(reach, base[k][1])
                k += 1
            if reach <= m.start() and all(p.search(m[0]) for p in MIXED):
                out.append((3, m.start(), m.end(), m[0]))
    return [(k, a, b, _hash(v)) for k, a, b, v in sorted(out, key=lambda x: (x[1], x[0]))]


def _may(texts: pa.Array) -> list[np.ndarray]:
    """Of each text, whether it may hold spans of each kind."""
    found = pc.match_substring_regex(texts, MAY_ASSIGN), pc.match_substring(texts, MAY_ACCESS), pc.match_substring_regex(texts, MAY_HEX), pc.match_substring_regex(texts, MAY_TOKEN)
    return [pc.fill_null(x, False).to_numpy(zero_copy_only=False) for x in found]


def scan(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys and found (all base and candidate spans) of every row; texts stay in their batch."""
    rows = docs.select(*keys, F.col(text_col).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys))
            may = _may(texts)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i in np.logical_or.reduce(may).nonzero()[0]:
                found[i] = [dict(zip(("kind", "start", "stop", "hash"), x, strict=True)) for x in spans_of(texts[i].as_py(), *(bool(m[i]) for m in may))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(found, FOUND_ARROW)], names=[*keys, "found"])

    return rows.mapInArrow(run, f"{fields}, found {FOUND}")


def ownership(found: DataFrame, repository: str, owner: str) -> DataFrame:
    """(hash, n_repositories, n_owners) over all rows. Two partial aggregations; a hash in a third of all rows is a few counts a task."""
    one = found.select(F.explode("found.hash").alias("hash"), F.col(repository).alias("__r"), F.col(owner).alias("__o"))
    pairs = one.groupBy("hash", "__o", "__r").agg(F.lit(1).alias("x"))
    owners = pairs.groupBy("hash", "__o").agg(F.count(F.lit(1)).alias("n"))
    return owners.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))


def find_secrets(docs: DataFrame, repository: str = "doc_id", owner: str = "source", text_col: str = "text", max_owners: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: repository, owner, keep, n_assign, n_access, n_hex, base, spans.

    base and spans are arrays of (kind, start, stop, hash, n_repositories, n_owners, live), by start and kind, in code points, end
    exclusive. spans holds base and the candidates whose value at most max_owners owners hold.
    """
    keys = list(dict.fromkeys([repository, owner, *keep]))
    hit = stored(scan(docs, keys, text_col).withColumn("__row", F.monotonically_increasing_id()), "secrets")
    counts = ownership(hit, repository, owner)
    # rows without spans, most of them, pass as they are; the others' columns travel once, with their first span
    bare, some = hit.where(F.size("found") == 0), hit.where(F.size("found") > 0)
    each = some.select("__row", F.struct(*keys).alias("__keys"), F.posexplode("found").alias("__i", "f"))
    each = each.select("__row", F.when(F.col("__i") == 0, F.col("__keys")).alias("__keys"), "f.*").join(counts, "hash")
    each = each.withColumn("live", F.col("n_owners") <= max_owners)
    item = F.struct("start", "kind", "stop", "hash", "n_repositories", "n_owners", "live")
    spans = F.sort_array(F.collect_list(F.when((F.col("kind") < 3) | F.col("live"), item))).alias("spans")
    per = each.groupBy("__row").agg(F.first("__keys", ignorenulls=True).alias("__keys"), spans).select("__keys.*", "spans")
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,hash:string,n_repositories:bigint,n_owners:bigint,live:boolean>>")
    out = per.union(bare.select(*keys, none.alias("spans")))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return out.select(*keys, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.filter("spans", lambda s: s["kind"] < 3).alias("base"), "spans")


def _written(spans: str) -> F.Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["stop"])), ",")


def op7(docs: DataFrame, max_owners: int = 1) -> DataFrame:
    """The contract's counts, digest and spans of every document."""
    found = find_secrets(spread(docs.select("doc_id", "source", "text")), max_owners=max_owners)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))


def masked(docs: DataFrame, max_owners: int = 1, text_col: str = "text", repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """docs with every base span and every owner-specific candidate of each text replaced by its kind in angle brackets.

    The stage of a pipeline: no document goes. Ownership is aggregated from hashes alone. Rows without a candidate token need only their base spans, which are
    found again as they are masked, so they pass without a shuffle; rows with candidates are joined with the hashes of theirs that are live.
    """
    holds = F.coalesce(F.col(text_col).rlike(HAS_TOKEN), F.lit(False))
    some = _with_row(docs.where(holds), repository, text_col)
    live = ownership(scan(docs, [repository, owner], text_col), repository, owner).where(F.col("n_owners") <= max_owners).select("hash")
    tokens = scan(some, ["__row"], text_col).select("__row", F.explode(F.filter("found", lambda f: f["kind"] == 3)).alias("f")).select("__row", F.col("f.hash").alias("hash"))
    own = tokens.distinct().join(live, "hash").groupBy("__row").agg(F.collect_list("hash").alias("__live"))
    none = F.array().cast("array<string>")
    joined = some.join(own, "__row", "left").drop("__row").withColumn("__live", F.coalesce("__live", none))
    fields = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, fields.index(text_col)):
                new = batch.column(fields.index(text_col)).to_pylist()
                may = _may(batch.column(fields.index(text_col)))
                hashes = batch.column(len(fields)).to_pylist()
                for i in np.logical_or.reduce(may).nonzero()[0]:
                    known, out, at = set(hashes[i]), [], 0
                    for kind, start, stop, value in spans_of(new[i], *(bool(m[i]) for m in may)):
                        if (kind < 3 or value in known) and stop > at:
                            out += [new[i][at : max(at, start)], f"<{KINDS[kind]}>" if start >= at else ""]
                            at = stop
                    new[i] = "".join([*out, new[i][at:]])
                cols = [pa.array(new, pa.string()) if c == text_col else batch.column(k) for k, c in enumerate(fields)]
                yield pa.RecordBatch.from_arrays(cols, names=fields)

    return docs.where(~holds).withColumn("__live", none).mapInArrow(run, docs.schema).union(joined.mapInArrow(run, docs.schema))


def _with_row(docs: DataFrame, repository: str, text_col: str) -> DataFrame:
    """docs with __row, a key of the document and its text: equal rows share their spans."""
    return docs.withColumn("__row", F.struct(F.col(repository).alias("a"), F.xxhash64(text_col).alias("b"), F.length(text_col).alias("c")))
