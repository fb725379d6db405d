"""Session helpers: checkpointing in the shared folder, table reads, worker import path."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_stored: list[str] = []
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory; the path may be in any store that Spark reads."""
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let_workers_import(spark: SparkSession) -> None:
    """Put the repository on the Python workers' path, for local sessions started elsewhere."""
    env = spark.sparkContext.environment
    old = env.get("PYTHONPATH", "")
    if REPO not in old.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (old, REPO) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where it is unset and the session is a local one (tests)."""
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(conf)
        return conf
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="recordmill-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; a lost executor costs nothing that was computed before it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def place(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which clear_stored() deletes."""
    _stored.append(f"{shared_dir(spark)}/recordmill/{name}-{uuid.uuid4().hex}")
    return _stored[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, for wide rows of which later jobs read some columns."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_place(spark: SparkSession, path: str) -> None:
    """Delete what this process wrote at one place()."""
    _stored.remove(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear_stored(spark: SparkSession) -> int:
    """Delete what this process wrote at a place(), once no result that rests on it is needed; how many paths there were. Files of checkpoint() are Spark's: it deletes them with
    their frames where spark.cleaner.referenceTracking.cleanCheckpoints is set, and they go with the folder otherwise."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    n = len(_stored)
    while _stored:
        path = hadoop(_stored.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n
