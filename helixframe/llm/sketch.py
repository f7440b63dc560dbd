"""Count-min sketches merged over partitions: which 64-bit hashes occur often enough, never missing one.

A sketch has a few rows of counters that stop at 2.  A partition's part is sent sparse, as the counters that it touched,
in blocks of 65,536; blocks are merged where they meet, and only one bit for each counter reaches the driver, so the
filter that all tasks get has ROWS * 2**most_bits bits at most whatever the corpus holds.  Estimates are never too low.

A filter of that size is of use only while it has a few counters for each hash (``fits``).  Beyond that the sketch stays
distributed (``spread``): hashes travel to the slice of the sketch that counts them, and each document gets back those of
its own that are estimated repeated.  No part of that sketch reaches the driver or is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U, mix
from .common import mapped

ROWS, LEAST_BITS, MOST_BITS, BLOCK = 2, 16, 27, 16
#: Hashes after which a partition sends what it has.
FLUSH = 1 << 21
#: A distributed sketch: hashes that a slice of it expects, slices at most, logarithm of a slice's counters at most.
SLICE, MOST_SLICES, SLICE_BITS = 1 << 19, 1 << 18, 26


def bits_for(expected: int, most_bits: int = MOST_BITS) -> int:
    """Logarithm of the counters in a row: eight for each expected hash, within bounds."""
    return int(min(most_bits, max(LEAST_BITS, np.ceil(np.log2(max(1, 8 * expected))))))


def fits(expected: int, most_bits: int = MOST_BITS) -> bool:
    """Whether a filter of 2**most_bits counters in a row has two or more for each expected hash."""
    return 2 * expected <= 1 << most_bits


def places(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(hashes ^ U(row * 0x9E3779B97F4A7C15 + 0x1234567)) >> U(64 - bits)).astype(np.int64)


class Filter:
    """The bits of the counters that reached the wanted count; sent to tasks as a broadcast."""

    def __init__(self, sent, bits: int):
        self.sent, self.bits = sent, bits

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """True where the estimated count of a hash reaches the wanted one."""
        ok = np.ones(len(hashes), bool)
        for row, table in enumerate(self.sent.value):
            at = places(hashes, row, self.bits)
            ok &= (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return ok


def build(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], expected: int, at_least: int = 2, most_bits: int = MOST_BITS) -> Filter:
    """The filter of the hashes that ``hashes`` gives for the batches of ``df``; those of each batch count once each."""
    bits = bits_for(expected, most_bits)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def send() -> Iterator[pa.RecordBatch]:
            codes = np.concatenate(held) if held else np.zeros(0, U)
            for row in range(ROWS):
                at = np.sort(places(codes, row, bits))
                new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
                twice = np.diff(np.r_[new, len(at)]) > 1
                at = at[new]
                blocks, first = np.unique(at >> BLOCK, return_index=True)
                low = (at & 0xFFFF).astype("<u2")
                cuts = [*first.tolist(), len(at)]
                pieces = [(low[a:b][~twice[a:b]].tobytes(), low[a:b][twice[a:b]].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
                for i in range(0, len(blocks), 1024):
                    some = pieces[i : i + 1024]
                    yield pa.RecordBatch.from_arrays([pa.array(blocks[i : i + 1024] * ROWS + row, pa.int64()), pa.array([x for x, _ in some], pa.binary()), pa.array([x for _, x in some], pa.binary())], ["block", "once", "twice"])

        for batch in batches:
            held.append(hashes(batch))
            n += len(held[-1])
            if n >= FLUSH:
                yield from send()
                held.clear()
                n = 0
        yield from send()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, once, twice in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                table = counts.setdefault(block, np.zeros(1 << BLOCK, np.uint8))
                at = np.frombuffer(once, "<u2")
                table[at] = np.minimum(table[at] + 1, 2)
                table[np.frombuffer(twice, "<u2")] = 2
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array([np.packbits(t >= at_least).tobytes() for t in counts.values()], pa.binary())], ["block", "bits"])

    sparse = mapped(df, parts, "block long, once binary, twice binary").repartition(F.col("block"))
    tables = [np.zeros(max(1, (1 << bits) // 8), np.uint8) for _ in range(ROWS)]
    size = (1 << BLOCK) // 8
    for block, packed in mapped(sparse, merge, "block long, bits binary").collect():
        at = block // ROWS * size
        tables[block % ROWS][at : at + size] = np.frombuffer(packed, np.uint8)
    return Filter(df.sparkSession.sparkContext.broadcast(tables), bits)


def cuts_of(*keys: np.ndarray) -> list[int]:
    """Where runs of equal keys begin in sorted columns, and where the last one ends."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return [*np.flatnonzero(new).tolist(), len(new)]


def spread(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], expected: int, distinct: bool = False) -> DataFrame:
    """(doc, _h, codes): for documents with hashes estimated to occur twice or more those hashes, eight bytes each.

    ``hashes`` gives, for a batch, arrays of hashes and of the documents' two numbers.  A document can have several rows.
    With ``distinct``, two partitions that give the same document and hash count it once.
    A hash that a partition meets twice is settled there, and its slice only hears that it is repeated: so one that stands
    everywhere costs its slice one row a flush.  A slice's counters are made for what it expects, and a slice is one task's.
    """
    slices = int(min(MOST_SLICES, max(64, expected // SLICE)))
    bits = bits_for(expected // slices, SLICE_BITS)
    names, schema = ["slice", "doc", "h", "codes", "twice"], "slice long, doc binary, h binary, codes binary, twice binary"

    def table(columns: list[list]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(columns[0]), 512):
            yield pa.RecordBatch.from_arrays([pa.array(columns[0][i : i + 512], pa.int64()), *[pa.array(c[i : i + 512], pa.binary()) for c in columns[1:]]], names)

    def settled(codes: np.ndarray, doc: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of slice -1: hashes by document, with its numbers once."""
        order = np.lexsort((codes, h, doc))
        codes, doc, h = codes[order], doc[order], h[order]
        cuts = cuts_of(doc, h)
        pairs = list(zip(cuts, cuts[1:], strict=False))
        yield from table([[-1] * len(pairs), [doc[a : a + 1].tobytes() for a, _ in pairs], [h[a : a + 1].tobytes() for a, _ in pairs], [codes[a:b].tobytes() for a, b in pairs], [b""] * len(pairs)])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def send() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            codes, doc, h = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(codes, kind="stable")
            codes, doc, h = codes[order].astype("<u8"), doc[order].astype("<i8"), h[order].astype("<i4")
            cuts = np.array(cuts_of(codes))
            many = np.diff(cuts) > 1
            often = np.repeat(many, np.diff(cuts))
            yield from settled(codes[often], doc[often], h[often])
            twice = codes[cuts[:-1][many]]
            codes, doc, h = codes[~often], doc[~often], h[~often]
            # sorted hashes are sorted by slice, as a slice is a range of hashes
            mine, theirs = ((x >> U(32)) * U(slices) >> U(32) for x in (codes, twice))
            numbers = np.union1d(mine, theirs)
            a, b, c, d = (np.searchsorted(x, numbers, side).tolist() for x in (mine, theirs) for side in ("left", "right"))
            ranges, others = list(zip(a, b, strict=True)), list(zip(c, d, strict=True))
            yield from table([numbers.astype(np.int64).tolist(), *[[x[i:j].tobytes() for i, j in ranges] for x in (doc, h, codes)], [twice[i:j].tobytes() for i, j in others]])

        for batch in batches:
            for found in hashes(batch):
                held.append(found)
                n += len(found[0])
                if n >= FLUSH:
                    yield from send()
                    held.clear()
                    n = 0
        yield from send()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, []

        def group() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            doc, h, codes, twice = (np.concatenate([np.frombuffer(x[i], t) for x in held]) for i, t in enumerate(("<i8", "<i4", "<u8", "<u8")))
            if distinct:
                order = np.lexsort((h, doc, codes))
                codes, doc, h = codes[order], doc[order], h[order]
                new = cuts_of(codes, doc, h)[:-1]
                codes, doc, h = codes[new], doc[new], h[new]
            ok = np.ones(len(codes), bool)
            for row in range(ROWS):
                counters = np.zeros(1 << bits, np.uint8)
                at = np.sort(places(codes, row, bits))
                counters[at[1:][at[1:] == at[:-1]]] = 2
                counters[places(twice, row, bits)] = 2
                ok &= counters[places(codes, row, bits)] == 2
            yield from settled(codes[ok], doc[ok], h[ok])

        for batch in batches:
            here = np.asarray(batch.column("slice")) < 0
            if here.any():
                yield batch.filter(pa.array(here))
            for of, *columns in zip(*[c.to_pylist() for c in batch.filter(pa.array(~here)).columns], strict=True):
                if of != number:
                    yield from group()
                    number, held = of, []
                held.append(columns)
        yield from group()

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in count(batches):
            doc, h = (np.frombuffer(b"".join(b.column(c).to_pylist()), t) for c, t in (("doc", "<i8"), ("h", "<i4")))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(h), b.column("codes")], ["doc", "_h", "codes"])

    # what is settled only passes through, so it may go anywhere
    to = F.when(F.col("slice") >= 0, F.col("slice")).otherwise(-1 - F.pmod(F.xxhash64("doc"), F.lit(1_000_003)))
    sent = mapped(df, parts, schema).withColumn("_to", to).repartition(F.col("_to")).sortWithinPartitions("_to").drop("_to")
    return mapped(sent, numbers, "doc long, _h int, codes binary")
