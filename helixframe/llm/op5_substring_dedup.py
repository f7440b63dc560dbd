"""Substring dedup: windows of 13 words that also start in a document with a smaller id are removed.

A merged count-min sketch over-estimates in how many documents a window stands; only windows that it finds repeated are
grouped exactly, and none is lost.  What the sketch counts is a window's anchor: the smallest hash among its runs of
ANCHOR words, which equal windows share, so an anchor's count is never below its windows' counts, and there are about a
fifth as many anchors as windows.  Grouping is by a 96-bit hash.  A partition first settles what it can see by itself:
of each window it sends only the row with its smallest id, so a window that stands everywhere costs one row a partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch
from .arrays import ODD_B, Rolling, covered, mix, sliding_min, split_words, steps, window_starts
from .common import documents, mapped

WINDOW, ANCHOR = 13, 5
#: Rows of flagged windows after which a partition settles and sends what it has.
FLUSH = 1 << 21
LAST = np.iinfo(np.int64).max


def anchors(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places that start a window, their anchors) for words with hashes ``h`` and documents at ``at``."""
    start = np.flatnonzero(window_starts(at, n))
    if not len(start):
        return start, np.zeros(0, np.uint64)
    size = min(ANCHOR, n)
    return start, sliding_min(mix(Rolling(h).windows(size)), n - size + 1)[start]


def shingle_count(docs: DataFrame) -> int:
    """About how many words the texts have: a seventh of their bytes."""
    return (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 7


def text_hash(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF).cast("bigint")).cast("int")


def number() -> Column:
    """The column doc_id as ``ids`` gives it: all joins by document go by it, so that they share one exchange of the texts."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST).cast("long"))


def ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def first_in_order(order_keys: list[np.ndarray]) -> np.ndarray:
    """Where a run of equal keys begins, for sorted columns."""
    new = np.zeros(len(order_keys[0]), bool)
    if len(new):
        new[0] = True
    for k in order_keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def flagged(rows: DataFrame, hashes: Callable, expected: int, most_bits: int) -> tuple[DataFrame, Callable[[np.ndarray, pa.RecordBatch], np.ndarray]]:
    """(rows, holds): ``holds(codes, batch)`` says which hashes of a batch of the returned rows are estimated repeated.

    The sketch reaches all tasks as one filter while that has room for the hashes; beyond that it stays distributed, and
    each document comes with its own repeated hashes.  Both lose none.
    """
    if sketch.fits(expected, most_bits):
        bits = sketch.build(rows, lambda big: np.concatenate([x[0] for x in hashes(big)] or [np.zeros(0, np.uint64)]), expected, most_bits=most_bits)
        return rows, lambda codes, batch: bits.holds(codes)
    own = sketch.spread(rows, hashes, expected).groupBy("doc", "_h").agg(F.collect_list("codes").alias("_codes"))
    own = own.select(F.col("doc").alias("_id"), F.col("_h").alias("_g"), "_codes")
    rows = rows.join(own, (number() == F.col("_id")) & (F.col("_h") == F.col("_g")), "left").select("doc_id", "text", "_h", "_codes")

    def holds(codes: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        # a hash is repeated in all documents that have it or in none, but for a few that the sketch overestimates
        repeated = [np.frombuffer(c, "<u8") for some in batch.column("_codes").to_pylist() for c in some or ()]
        return np.isin(codes, np.concatenate(repeated)) if repeated else np.zeros(len(codes), bool)

    return rows, holds


def repeated_windows(docs: DataFrame, n: int = WINDOW, most_bits: int = sketch.MOST_BITS) -> DataFrame:
    """(doc_id, _h, starts): for documents with repeated windows their numbers as little-endian 32-bit numbers.

    ``_h`` is the hash of the text, so that rows with one id but other texts are told apart.  One document can have
    several rows.  A row without an id counts as larger than all.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), text_hash(F.coalesce("text", F.lit(""))).alias("_h"))
    words = shingle_count(docs)

    def once_each(big: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The anchors of each document, once each, with its numbers."""
        for batch in steps(big):
            w = split_words(batch.column("text"))
            start, anchor = anchors(w.hashes(), w.at, n)
            doc = np.searchsorted(w.at, start, "right") - 1
            keep = first_in_order([anchor, doc])
            anchor, doc = anchor[keep], doc[keep]
            sort = np.lexsort((anchor, doc))
            anchor, doc = anchor[sort], doc[sort]
            keep = first_in_order([doc, anchor])
            yield anchor[keep], ids(batch)[doc[keep]], batch.column("_h").to_numpy()[doc[keep]]

    rows, holds = flagged(rows, once_each, words // 5, most_bits)
    shards = int(min(1 << 18, max(64, words // 1_000_000)))
    kinds = [("k1", "<u8"), ("k2", "<u4"), ("doc", "<i8"), ("h", "<i4"), ("at", "<i4")]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            k1, k2, doc, h, at = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((at, h, doc, k2, k1))
            k1, k2, doc, h, at = (x[order] for x in (k1, k2, doc, h, at))
            new = first_in_order([k1, k2])
            least = doc[new][np.cumsum(new) - 1]
            sure = doc > least
            yield from hits(doc[sure], h[sure], at[sure])
            # of rows with the smallest id all go: an id may have several rows
            k1, k2, doc, h, at = (x[~sure] for x in (k1, k2, doc, h, at))
            shard = (k1 >> np.uint64(40)) % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            k1, k2, doc, h, at, shard = (x[order] for x in (k1, k2, doc, h, at, shard))
            numbers, first = np.unique(shard, return_index=True)
            cuts = [*first.tolist(), len(shard)]
            columns = [[x[a:b].astype(t).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)] for x, (_, t) in zip((k1, k2, doc, h, at), kinds, strict=True)]
            yield from table(numbers.astype(np.int64), columns)

        for big in batches:
            for batch in steps(big):
                w = split_words(batch.column("text"))
                h = w.hashes()
                start, anchor = anchors(h, w.at, n)
                start = start[holds(anchor, batch)]
                if not len(start):
                    continue
                doc = np.searchsorted(w.at, start, "right") - 1
                a, b = Rolling(h), Rolling(mix(h + np.uint64(1)), ODD_B)
                held.append([mix(a.of(start, start + n)), (mix(b.of(start, start + n)) >> np.uint64(32)).astype(np.uint32), ids(batch)[doc], batch.column("_h").to_numpy()[doc], (start - w.at[doc]).astype(np.int32)])
                size += len(start)
            if size >= FLUSH:
                yield from send()
                held.clear()
                size = 0
        yield from send()

    def hits(doc: np.ndarray, h: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((at, h, doc))
        doc, h, at = doc[order], h[order], at[order]
        cuts = np.flatnonzero(first_in_order([doc, h]))
        if len(cuts):
            ends = [*cuts.tolist()[1:], len(doc)]
            pieces = [at[a:b].astype("<i4").tobytes() for a, b in zip(cuts.tolist(), ends, strict=True)]
            empty = [b""] * len(cuts)
            yield from table(np.full(len(cuts), -1, np.int64), [empty, empty, [x.tobytes() for x in doc[cuts].astype("<i8")], [x.tobytes() for x in h[cuts].astype("<i4")], pieces])

    def table(shard: np.ndarray, columns: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(shard), 512):
            yield pa.RecordBatch.from_arrays([pa.array(shard[i : i + 512]), *[pa.array(c[i : i + 512], pa.binary()) for c in columns]], ["shard", *[k for k, _ in kinds]])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def group() -> Iterator[pa.RecordBatch]:
            if held:
                k1, k2, doc, h, at = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((doc, k2, k1))
                k1, k2, doc, h, at = (x[order] for x in (k1, k2, doc, h, at))
                new = first_in_order([k1, k2])
                late = doc > doc[new][np.cumsum(new) - 1]
                yield from found(hits(doc[late], h[late], at[late]))

        for batch in batches:
            settled = np.asarray(batch.column("shard")) < 0
            if settled.any():
                yield from found(iter([batch.filter(pa.array(settled))]))
            for number, *columns in zip(*[c.to_pylist() for c in batch.filter(pa.array(~settled)).columns], strict=True):
                if number != shard:
                    yield from group()
                    shard, held = number, []
                held.append([np.frombuffer(c, t) for c, (_, t) in zip(columns, kinds, strict=True)])
        yield from group()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, h = (np.frombuffer(b"".join(b.column(c).to_pylist()), t) for c, t in (("doc", "<i8"), ("h", "<i4")))
            yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == LAST), pa.array(h), b.column("at")], ["doc_id", "_h", "starts"])

    sent = mapped(rows, settle, "shard long, k1 binary, k2 binary, doc binary, h binary, at binary")
    # settled rows (shard -1) only pass through, so they may go anywhere
    to = F.when(F.col("shard") >= 0, F.col("shard")).otherwise(-1 - F.pmod(F.xxhash64("doc"), F.lit(1_000_003)))
    by_shard = sent.withColumn("_to", to).repartition(F.col("_to")).sortWithinPartitions("_to").drop("_to")
    return mapped(by_shard, join, "doc_id long, _h int, starts binary")


def remove_repeated(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` as doc_id, kept (its remaining words joined by one space), n_words, n_removed.

    A null text has no words.  Rows with equal ids don't remove each other's words; texts shorter than a window lose
    nothing; an empty table gives no rows.
    """
    hits = repeated_windows(docs, n).groupBy(number().alias("_id"), F.col("_h").alias("_g")).agg(F.collect_list("starts").alias("starts"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), text_hash(text).alias("_h"))
    rows = rows.join(hits, (number() == F.col("_id")) & (F.col("_h") == F.col("_g")), "left").select("doc_id", "text", "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in steps(big):
                w = split_words(batch.column("text"))
                gone = np.zeros(w.at[-1], bool)
                for i, starts in enumerate(batch.column("starts").to_pylist()):
                    if starts:
                        at = np.unique(np.frombuffer(b"".join(starts), "<i4")).astype(np.int64)
                        gone[w.at[i] : w.at[i + 1]] = covered(at, n, int(w.at[i + 1] - w.at[i]))
                texts = batch.column("text").to_pylist()
                kept = []
                for i, (a, b) in enumerate(zip(w.at.tolist(), w.at.tolist()[1:], strict=False)):
                    some = texts[i].encode().split()
                    stay = ~gone[a:b]
                    kept.append((b" ".join(some) if stay.all() else b" ".join([some[j] for j in np.flatnonzero(stay).tolist()])).decode())
                sums = np.r_[0, np.cumsum(gone)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(np.diff(w.at).astype(np.int64)), pa.array(np.diff(sums[w.at]).astype(np.int64))], ["doc_id", "kept", "n_words", "n_removed"])

    return mapped(rows, cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, kept string, n_words long, n_removed long")


def digest(kept: str) -> str:
    return hashlib.sha256(kept.encode()).hexdigest()


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT r, doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM d WHERE len(ws) >= 13)),
m AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM g) WHERE doc_id > least),
c AS (SELECT DISTINCT r, unnest(generate_series(i, i + 12)) AS j FROM m),
k AS (SELECT w.r, string_agg(w.word, ' ' ORDER BY w.j) FILTER (WHERE c.j IS NULL) AS kept, count(c.j) AS n_removed
      FROM (SELECT r, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS j FROM d) w LEFT JOIN c ON w.r = c.r AND w.j = c.j GROUP BY w.r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r
"""

QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLES = {"op5_substring_dedup": ORACLE}
