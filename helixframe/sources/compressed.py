"""Text lines of plain and compressed files.

Spark's text source decompresses by suffix and knows ``.gz`` in lower case only.  Block-compressed files (``.bgz``) and other
spellings are sequences of gzip members, read here as whole files and cut into lines where they are read; such a file is one
task's work, as any gzip file is.
"""

from __future__ import annotations

import io
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Decompressed bytes at a time, and lines of a batch.
PIECE, LINES = 1 << 20, 4096


def is_compressed_path(path: str) -> bool:
    return os.path.splitext(path)[1] in (".gz", ".bgz")


def needs_own_reader(path: str) -> bool:
    """Whether a file is compressed by a suffix that Spark's text source does not know."""
    suffix = os.path.splitext(path)[1]
    return suffix.lower() in (".gz", ".bgz") and suffix != ".gz"


def unzipped(data: bytes) -> Iterator[bytes]:
    """The contents of a sequence of gzip members, piece by piece."""
    source, rest = io.BytesIO(data), b""
    while True:
        reader = zlib.decompressobj(31)
        while not reader.eof:
            block = rest or source.read(PIECE)
            if not block:
                return
            rest = b""
            yield reader.decompress(block, 0)
        rest = reader.unused_data


def lines_in(pieces: Iterator[bytes]) -> Iterator[str]:
    held = b""
    for piece in pieces:
        *whole, held = (held + piece).split(b"\n")
        yield from (x.decode("utf-8", "replace") for x in whole)
    if held:
        yield held.decode("utf-8", "replace")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block): the lines of a file or folder, with the file's path and the offset of its split."""
    if not needs_own_reader(path):
        text = spark.read.option("lineSep", "\n").text(path)
        return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                some: list[str] = []
                for line in lines_in(unzipped(data)):
                    some.append(line)
                    if len(some) == LINES:
                        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([name] * len(some))], ["value", "file"])
                        some = []
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([name] * len(some))], ["value", "file"])

    whole = spark.read.format("binaryFile").load(path).select("path", "content")
    return whole.mapInArrow(cut, "value string, file string").withColumn("block", F.lit(0).cast("bigint"))
