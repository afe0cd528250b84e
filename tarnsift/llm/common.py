"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: everything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see; a folder of our own only where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="tarnsift-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: With this on, a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value):
    """key is value in jobs that run inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, never a recomputation that could
    differ, and later passes prune columns of the file.
    """
    path = f"{shared_dir(df.sparkSession)}/tarnsift/{name}-{uuid.uuid4().hex}"
    with setting(df.sparkSession, DROP_SHUFFLES, "true"):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote; nothing that is still to be computed may read it."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Ids up to so many are broadcast to leave documents out; more are joined by a shuffle.
BROADCAST_IDS = 300_000


def without_ids(docs: DataFrame, bad: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows whose id is in bad, a written table of one column; a null id matches itself."""
    bad = bad.toDF("_without")
    few = bad.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(bad) if few else bad, docs[id_col].eqNullSafe(F.col("_without")), "left_anti")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def small_batches(spark: SparkSession, size: int = 4_000_000):
    """Python workers get Arrow batches of about so many bytes in jobs that run inside; an executor holds
    several copies of each worker's batch."""
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size):
        yield


#: Bytes of the read files that go to one bin of a shuffle, about.
BIN_BYTES = 256_000_000


def bins_for(df: DataFrame) -> int:
    """Bins so that each holds a bounded share of df's files: the session's number of shuffle partitions
    at least, more where the files are large.  The size comes from the plan; nothing is read."""
    size = int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    # a plan without known sizes multiplies guesses; what is no file's size counts as none
    return max(shuffle_partitions(df.sparkSession), size // BIN_BYTES + 1 if size < 1 << 60 else 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null, in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
