"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word of the contracts: a maximal run without ASCII white space.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, a temporary one on a single machine (tests);
    on a cluster RuntimeError, as executors couldn't read that."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        found = sc._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
        if not found:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            found = tempfile.mkdtemp(prefix="strata-shared-")
            sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here and lost executors lose nothing.

    The folder goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/strata/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Deletes the files of a table written by cut() that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for name in df.inputFiles()[:1]:
        where = jvm.org.apache.hadoop.fs.Path(name).getParent()
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_shuffles() -> None:
    """Lets Spark delete the shuffle files of steps that are over: their plans are garbage, on both sides."""
    import gc

    from pyspark import SparkContext

    gc.collect()
    if SparkContext._active_spark_context is not None:
        SparkContext._active_spark_context._jvm.System.gc()


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have, so that extra columns with clashing names do no harm."""
    have = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name in have:
        name += "_"
    return name


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))
