"""The operators over streams of VCF lines.

All of them work record by record, so a stream needs no state and no watermark, and append mode is right.  Chain and
reference are static sides.  The order of records across files is not kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.sources.header import Header
from helixframe.sources.vcf import VariantSet, parsed


def stream_vcf(spark: SparkSession, folder: str, header: Header) -> VariantSet:
    """New files of a folder as they come; all share ``header``."""
    text = spark.readStream.option("lineSep", "\n").text(folder)
    return VariantSet(parsed(text.select(F.lit(0).cast("long").alias("row_id"), "value")), header)


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Lines appended to a folder; ``once`` takes what is there and stops."""
    writer = df.select(F.col("line").alias("value")).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
