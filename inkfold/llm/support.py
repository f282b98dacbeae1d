"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of every column that an operator adds for itself, so that columns of the input cannot clash.
OWN = "__ink_"


def trimmed(out: pa.Array) -> pa.Array:
    """``out``, after memory that Python and Arrow no longer use has gone back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
    return out


def arrow_column(returns: str) -> Callable:
    """An Arrow function on columns that is only built when it is applied: a type given as text needs a session."""

    def wrap(run: Callable) -> Callable:
        @functools.wraps(run)
        def own(*columns: pa.Array) -> pa.Array:
            return trimmed(run(*columns))

        return lambda *columns: F.arrow_udf(own, returns)(*columns)

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors reach: ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a folder of its own; a
    cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="inkfold-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from the files.

    Later readers see fixed rows however often a task is repeated, and a lost
    executor costs a reread instead of the whole lineage.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/inkfold-{app}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files that ``written`` made for ``df``; nothing may read it any more."""
    spark = df.sparkSession
    own = f"/inkfold-{spark.sparkContext.applicationId}/"
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        if own in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids outside the held-out fold, chosen by the hash of the id.

    Rows with a null id or label are no examples; of repeated ids the largest label counts.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    one = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return one.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(rows)
