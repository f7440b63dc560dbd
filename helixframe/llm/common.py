"""Helpers shared by the corpus operators: inputs, scratch tables, word splitting, let-binding."""

from __future__ import annotations

import gc
import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the five ASCII controls from tab to carriage return.
WORD_SEP = r"[\x20\x09-\x0D]+"
#: Bytes at most of an Arrow batch; the setting's name and its default.
BATCH_BYTES, BATCH_BOUND = 8 << 20, ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name below the shared folder of ``spark.checkpoint.dir``.

    Where the session names none, a local session gets one below /tmp; on a cluster, where the machines don't share that, it
    is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        base = "file:///tmp/checkpoints"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        parent = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if parent.getName().startswith("llm-"):
            parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(parent, True)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage: shuffle files and broadcasts of finished steps stay until it does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas in ``body`` use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array of strings; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SEP), "")


def mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    """``df.mapInArrow``; workers that start where this one runs find this package although it isn't installed.

    Batches are bounded in bytes, unless the session has a bound of its own: texts have no length that rows could bound.
    """
    spark = df.sparkSession
    if spark.conf.get(BATCH_BOUND[0]) == BATCH_BOUND[1]:
        spark.conf.set(BATCH_BOUND[0], str(BATCH_BYTES))
    environment, root = spark.sparkContext.environment, str(Path(__file__).parents[2])
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])
    return df.mapInArrow(fn, schema)
