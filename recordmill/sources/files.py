"""Record files: JSON lines, JSON documents, CSV, Parquet, case files, and checked writes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_records(spark: SparkSession, path: str, schema: StructType | str, kind: str = "jsonl") -> DataFrame:
    """Records of a schema. JSON lines are read strictly: a malformed line fails the query; blank lines are skipped."""
    if kind == "jsonl":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if kind == "json":
        return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)
    return spark.read.schema(schema).format(kind).load(path)


def write_checked(df: DataFrame, path: str, key: str, kind: str = "jsonl", checks: dict[str, Column] | None = None) -> DataFrame:
    """Write records beside the path through Spark's job commit, read them back, and put them in place only if all holds; else it raises and what stood there stays.

    A count, a checksum and the uniqueness of keys must be the same on both sides, and every row read back must pass the checks. Readers see whole tables only.
    """
    spark = df.sparkSession
    mark = lambda x: x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*x.columns)), F.count_distinct(key)).first()
    before, beside = mark(df), f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    if before[2] != before[0]:
        raise ValueError(f"{before[0] - before[2]} rows have no key of their own")
    df.write.option("ignoreNullFields", "false").json(beside) if kind == "jsonl" else df.write.format(kind).save(beside)
    back = read_records(spark, beside, df.schema, kind)
    bad = back.where(~reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in checks.values()])).count() if checks else 0
    same = mark(back) == before
    files = _files(spark, path)
    if bad or not same:
        files.delete(beside)
        raise ValueError(f"{bad} rows read back fail {sorted(checks or ())}" if bad else "what was read back differs from what was written")
    files.replace(beside, path)
    return read_records(spark, path, df.schema, kind)


class _files:
    """Renaming and deleting in the file system of a path, whatever Spark reads it from."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def replace(self, new: str, old: str) -> None:
        """The old table is set aside until the new one stands in its place."""
        aside = f"{new}-old"
        had = self.fs.exists(self.path(old))
        if had and not self.fs.rename(self.path(old), self.path(aside)):
            raise OSError(f"{old} can't be set aside")
        if not self.fs.rename(self.path(new), self.path(old)):
            if had:
                self.fs.rename(self.path(aside), self.path(old))
            raise OSError(f"{new} can't be put in place")
        if had:
            self.delete(aside)


#: Rows of a table that may be one JSON document.
DOCUMENT_ROWS = 100_000


def write_document(df: DataFrame, path: str, most: int = DOCUMENT_ROWS) -> None:
    """A small table (a report, a manifest) as one JSON document: an array of its rows in order of all columns. A document is one value, so the rows are counted first, and more than
    `most` raise: such a table belongs in JSON lines (write_checked)."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows are no document; write them as JSON lines")
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    df.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(row)), ",\n"), F.lit("]")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_splits(spark: SparkSession, pattern: str, schema: StructType | str, kind: str = "jsonl") -> DataFrame:
    """Records of all files, or tables of part files, that match a pattern, with split: the name of each without its ending."""
    rows = read_records(spark, pattern, schema, kind)
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/.]+)\.[a-z]+(?:/part-[^/]*)?$", 1).alias("split"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("mode", "FAILFAST").csv(path)


def read_case(spark: SparkSession, path: str) -> DataFrame:
    """(file, matrix, row, col, value) of the numeric matrices and scalars (row null) of network case files, one row a number.

    A case file is one value of a whole-text read; its matrices are found by pattern and exploded.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"%[^\n]*", "").alias("t"))
    found = files.select("file", F.explode(F.regexp_extract_all("t", F.lit(r"(mpc\.\w+\s*=\s*(?:\[[^\]]*\]|[-+0-9.eE]+))"), 1)).alias("m"))
    named = found.select("file", F.regexp_extract("m", r"mpc\.(\w+)", 1).alias("matrix"), F.trim(F.regexp_replace(F.regexp_extract("m", r"=\s*((?s:.*))", 1), r"[\[\]]", "")).alias("body"), F.contains("m", F.lit("[")).alias("several"))
    rows = named.select("file", "matrix", "several", F.posexplode(F.filter(F.transform(F.split("body", r"[;\n]+"), lambda r: F.trim(r)), lambda r: r != "")).alias("row", "r"))
    cells = rows.select("file", "matrix", "several", "row", F.posexplode(F.split("r", r"[\s,]+")).alias("col", "v"))
    return cells.select("file", "matrix", F.when(F.col("several"), F.col("row")).alias("row"), F.when(F.col("several"), F.col("col")).alias("col"), F.col("v").cast("double").alias("value"))


def inspect_files(spark: SparkSession, pattern: str, key: str = "id") -> DataFrame:
    """(path, size, sha256, n_records, n_ids) of JSON-lines files that match a pattern."""
    raw = spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    lines = spark.read.text(pattern).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("path"), F.get_json_object("value", f"$.{key}").alias("k"))
    counts = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("k").alias("n_ids"))
    return raw.join(counts, "path", "left").fillna(0, ["n_records", "n_ids"])


def read_archive(spark: SparkSession, pattern: str, member: str, schema: StructType | str) -> DataFrame:
    """Records of the JSON-lines members, of names that end in `member`, of tar.gz archives: one task an archive, one line at a time."""
    import pandas as pd

    def lines(batches):
        import io
        import tarfile

        for batch in batches:
            for content in batch["content"]:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|gz") as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith(member):
                            held = []
                            for line in tar.extractfile(m):
                                if line.strip():
                                    held.append(line.decode())
                                if len(held) == 4096:
                                    yield pd.DataFrame({"value": held})
                                    held = []
                            yield pd.DataFrame({"value": pd.Series(held, dtype="str")})

    text = spark.read.format("binaryFile").load(pattern).select("content").mapInPandas(lines, "value string")
    return text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """An append-only cache read back: the last row of each key."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select(key, "r.*")
