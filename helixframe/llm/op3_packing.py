"""Packing: documents end to end, cut into fixed windows of tokens.

One pass tokenizes every document and writes its ids as a table in the shared folder, with the running offset inside the
partition.  The partitions' token totals (one number each) become global offsets by a prefix sum; a second pass over the
table then cuts every document at the multiples of the sequence length, wherever it lies.  The pieces at a cut are the
boundary records: a sequence is the pieces with its number, gapless from 0.  Only the last sequence has padding.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mapped, written

LENGTH, END_ID = 1024, 0
#: Characters on which the two tokenizer libraries are known to agree; any other text goes to the slower one.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*")
_encoders: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids by the vocabulary file of ``tokenizers``.

    Beside a JSON file ``tiktoken`` may have the same vocabulary as ranks: it then gives the same ids, several times as
    fast, for texts of plain characters.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        self.fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            with open(path, encoding="utf-8") as f:
                size = len(json.load(f)["model"]["vocab"])
            if size - 1 <= len(table) <= size:
                self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and _PLAIN.fullmatch(text):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenized(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, key: str = "doc_id") -> DataFrame:
    """(key, ids, doc_tokens, part, before): ids as little-endian 32-bit numbers, the partition, and its tokens so far."""
    vocabulary = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, before = encoder(vocabulary).ids, 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                ids = [np.append(get(t or ""), np.uint32(end_id)) for t in some.column("text").to_pylist()]
                sizes = np.array([len(x) for x in ids], np.int64)
                so_far = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(sizes), some.column("part"), pa.array(so_far)], ["key", "ids", "doc_tokens", "part", "before"])

    rows = docs.select(F.col(key).alias("key"), "text", F.spark_partition_id().cast("long").alias("part"))
    kind = docs.schema[key].dataType.simpleString()
    return mapped(rows, encode, f"key {kind}, ids binary, doc_tokens long, part long, before long")


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, end_id: int = END_ID, key: str = "doc_id") -> DataFrame:
    """Pieces: doc_id, start, length, ids (binary), ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone.  Repeated rows are packed each; an empty table gives no pieces.  The
    order of the documents is that of the table.
    """
    spark = docs.sparkSession
    table = written(tokenized(docs, vocabulary, end_id, key))
    # one row for each partition of the input
    totals = table.groupBy("part").agg(F.sum("doc_tokens").alias("n")).orderBy("part").collect()
    first, at = {}, 0
    for part, n in totals:
        first[part], at = at, at + n
    parts = spark.createDataFrame(pa.table({"part": pa.array(first.keys(), pa.int64()), "first": pa.array(first.values(), pa.int64())}))
    placed = table.join(F.broadcast(parts), "part").select("key", "ids", "doc_tokens", (F.col("first") + F.col("before")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, at = batch.column("doc_tokens").to_numpy(), batch.column("at").to_numpy()
            pieces = (at + sizes - 1) // length - at // length + 1
            row = np.repeat(np.arange(batch.num_rows), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            number = at[row] // length + nth
            start = np.maximum(number * length, at[row]) - at[row]
            end = np.minimum((number + 1) * length - at[row], sizes[row])
            whole = [memoryview(b.as_buffer()) for b in batch.column("ids")]
            ids = [whole[r][4 * s : 4 * e] for r, s, e in zip(row.tolist(), start.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(row)), pa.array(start), pa.array(end - start), pa.array([bytes(x) for x in ids], pa.binary()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(sizes[row]), pa.array(number), pa.array(at[row] + start - number * length)],
                ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return mapped(placed, cut, f"doc_id {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).drop("ids")


QUERIES = {"op3_packing": op3_packing}
