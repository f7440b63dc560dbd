"""Suffix-array dedup: bytes under a 400-byte string that starts at two places are removed.

The construction is column-wise over many strings: each round takes one more symbol of every string, re-sorts the
collection by one stable pass over that column (the positional Burrows-Wheeler transform) and updates the common
prefixes of neighbours from running maxima.  Columns lie one after the other in an external file that the rounds read in
sequence.  Neighbours that have agreed for 400 columns show a repeated string.

Strings are cut so that a bounded number of rounds suffices and equal 400-byte strings meet in one place and in line:
every 400-byte string has an anchor, its leftmost smallest hash of KEY bytes, and successive strings with one anchor form
a segment of at most 2 * 400 - KEY bytes.  Segments go to the shard of their anchor's hash, aligned at the anchor.  A
merged count-min sketch of the anchors spares segments whose anchor stands only once; no repeated string is lost.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch
from .arrays import _BYTE_CODES, ODD_A, ODD_B, Rolling, U, flat, mix, steps
from .common import documents, mapped
from .op5_substring_dedup import LAST, first_in_order, flagged, ids, number, text_hash

LENGTH, KEY = 400, 64


def sliding_argmin(x: np.ndarray, n: int) -> np.ndarray:
    """Place of the leftmost minimum of each n successive items."""
    at = np.arange(len(x), dtype=np.int32)
    have = 1
    while have < n:
        move = min(have, n - have)
        later = x[move:] < x[:-move]
        at = np.where(later, at[move:], at[:-move])
        x = np.where(later, x[move:], x[:-move])
        have += move
    return at


class Segments:
    """The segments of a batch of texts: first string's place, number of strings, anchor's place and hash, document."""

    def __init__(self, texts: pa.Array, length: int, key: int):
        self.raw, self.at = flat(texts)
        n = len(self.raw)
        empty = np.zeros(0, np.int64)
        self.start = self.number = self.anchor = self.doc = empty
        self.code = np.zeros(0, U)
        if n < length:
            return
        self.rolling = Rolling(_BYTE_CODES[self.raw])
        hashes = mix(self.rolling.windows(key))
        anchor = sliding_argmin(hashes, length - key + 1)
        size = np.diff(self.at)
        # strings that start here and end in the same document
        edge = np.zeros(n + 1, np.int32)
        many = size >= length
        np.add.at(edge, self.at[:-1][many], 1)
        np.add.at(edge, self.at[1:][many] - length + 1, -1)
        ok = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        if not len(ok):
            return
        doc = np.searchsorted(self.at, ok, "right") - 1
        new = np.flatnonzero(first_in_order([anchor[ok], doc]))
        self.start, self.number = ok[new], np.diff(np.r_[new, len(ok)])
        self.anchor, self.doc = anchor[ok[new]].astype(np.int64), doc[new]
        self.code = hashes[self.anchor]


def repeated_strings(columns: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, int]]:
    """(strings, column): after each column, the strings whose last ``length`` symbols another string has in line.

    ``columns[c]`` holds the symbols of column c; string s has those of the columns first[s] to last[s]-1.
    """
    enter = np.argsort(first, kind="stable")
    enter_at = np.searchsorted(first[enter], np.arange(len(columns) + 1))
    ends = np.bincount(last, minlength=len(columns) + 1)
    order = np.zeros(0, np.int64)
    begun = np.zeros(0, np.int32)  # column from which a string agrees with the one before it in the order
    for c in range(len(columns)):
        if len(order) and ends[c]:
            stay = np.flatnonzero(last[order] > c)
            begun = np.maximum.reduceat(begun[: stay[-1] + 1], np.r_[0, stay[:-1] + 1]) if len(stay) else begun[:0]
            order = order[stay]
        fresh = enter[enter_at[c] : enter_at[c + 1]]
        if len(fresh):
            if len(begun):
                begun[0] = c
            order = np.concatenate([fresh, order])
            begun = np.concatenate([np.full(len(fresh), c, np.int32), begun])
        if not len(order):
            continue
        symbols = columns[c][order]
        by = np.argsort(symbols, kind="stable")
        sorted_symbols = symbols[by]
        new = np.full(len(order), c + 1, np.int32)
        same = np.flatnonzero(sorted_symbols[1:] == sorted_symbols[:-1]) + 1
        before, here = by[same - 1], by[same]
        near = here - before == 1
        new[same[near]] = begun[here[near]]
        far = np.flatnonzero(~near)
        if len(far):
            bounds = np.stack([before[far] + 1, here[far] + 1], 1).ravel()
            new[same[far]] = np.maximum.reduceat(np.append(begun, 0), bounds)[::2]
        order, begun = order[by], new
        if c + 1 >= length:
            agree = begun <= c + 1 - length
            agree[0] = False
            hit = agree.copy()
            hit[:-1] |= agree[1:]
            if hit.any():
                yield order[hit], c


def mark(pre: np.ndarray, number: np.ndarray, data: np.ndarray, length: int, key: int) -> np.ndarray:
    """For all strings of the segments, one after the other, whether the same string lies in another segment in line.

    ``pre``: places between a segment's start and its anchor; ``data``: the segments' bytes one after the other.
    """
    widest = length - key
    size = number + length - 1
    first = (widest - pre).astype(np.int64)
    last = first + size
    at, flags_at = np.r_[0, np.cumsum(size)], np.r_[0, np.cumsum(number)]
    found = np.zeros(flags_at[-1], bool)
    n, width = len(pre), int(last.max(initial=0))
    if n < 2:
        return found
    with tempfile.TemporaryFile() as file:
        file.truncate(width * n)
        columns = np.memmap(file, np.uint8, "r+", shape=(width, n))
        for a in range(0, n, 2048):
            b = min(n, a + 2048)
            block = np.zeros((b - a, width), np.uint8)
            row = np.repeat(np.arange(b - a), size[a:b])
            column = np.arange(at[a], at[b]) - np.repeat(at[a:b] - first[a:b], size[a:b])
            block[row, column] = data[at[a] : at[b]]
            columns[:, a:b] = block.T
        for strings, c in repeated_strings(columns, first, last, length):
            found[flags_at[strings] + (c + 1 - length) - first[strings]] = True
        del columns
    return found


def repeated_ranges(docs: DataFrame, length: int = LENGTH, key: int = KEY, most_bits: int = sketch.MOST_BITS) -> DataFrame:
    """(doc_id, _h, ranges): byte ranges (pairs of little-endian 32-bit numbers) under repeated strings."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_hash(text).alias("_h"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def anchored(big: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in steps(big):
            found = Segments(batch.column("text"), length, key)
            yield found.code, ids(batch)[found.doc], batch.column("_h").to_numpy()[found.doc]

    rows, holds = flagged(rows, anchored, total // (length - key) * 2, most_bits)
    shards = int(min(1 << 18, max(64, total >> 23)))
    of_segment = [("pre", "<i2"), ("number", "<i2"), ("data", "u1")]
    of_place = [("segment", "<i4"), ("doc", "<i8"), ("h", "<i4"), ("start", "<i4")]
    names = ["shard", *[k for k, _ in of_segment + of_place]]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in steps(big):
                s = Segments(batch.column("text"), length, key)
                some = np.flatnonzero(holds(s.code, batch))
                if not len(some):
                    continue
                start, number, doc, code = s.start[some], s.number[some], s.doc[some], s.code[some]
                pre = s.anchor[some] - start
                end = start + number + length - 1
                # equal segments of the batch go once, with all their places
                content = mix(s.rolling.of(start, end) + number.astype(U) * U(ODD_B) + pre.astype(U) * U(ODD_A))
                shard = ((code >> U(40)) % U(shards)).astype(np.int64)
                order = np.lexsort((content, shard))
                new = first_in_order([shard[order], content[order]])
                cuts = np.flatnonzero(first_in_order([shard[order]])).tolist() + [len(order)]
                owners, hashes = ids(batch), batch.column("_h").to_numpy()
                out: list[tuple] = []
                for a, b in zip(cuts, cuts[1:], strict=False):
                    o, n = order[a:b], new[a:b]
                    one = o[n]
                    size = end[one] - start[one]
                    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[one], size)
                    values = (pre[one], number[one], s.raw[inside], np.cumsum(n) - 1, owners[doc[o]], hashes[doc[o]], start[o] - s.at[doc[o]])
                    out.append((int(shard[o[0]]), *[v.astype(t).tobytes() for v, (_, t) in zip(values, of_segment + of_place, strict=True)]))
                for i in range(0, len(out), 64):
                    columns = list(zip(*out[i : i + 64], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def settle() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            base = np.cumsum([0, *[len(x[0]) for x in held[:-1]]])
            pre, number, data = (np.concatenate([x[i] for x in held]) for i in range(3))
            number = number.astype(np.int64)
            segment = np.concatenate([x[3] + b for x, b in zip(held, base, strict=True)])
            doc, h, start = (np.concatenate([x[i] for x in held]) for i in (4, 5, 6))
            found = mark(pre.astype(np.int64), number, data, length, key)
            found |= np.repeat(np.bincount(segment, minlength=len(pre)) > 1, number)
            # runs of repeated strings of each segment, as first and last + 1
            at = np.r_[0, np.cumsum(number)]
            left = found & ~np.r_[False, found[:-1]]
            left[at[:-1][number > 0]] = found[at[:-1][number > 0]]
            right = found & ~np.r_[found[1:], False]
            right[at[1:] - 1] = found[at[1:] - 1]
            a, b = np.flatnonzero(left), np.flatnonzero(right) + 1
            of = np.searchsorted(at, a, "right") - 1
            runs_at = np.searchsorted(of, np.arange(len(number) + 1))
            runs = np.diff(runs_at)[segment]
            which = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(runs_at[:-1][segment], runs)
            place = np.repeat(np.arange(len(segment)), runs)
            begin = start[place] + (a - at[of])[which]
            stop = start[place] + (b - at[of])[which] + length - 1
            doc, h = doc[place], h[place]
            order = np.lexsort((begin, h, doc))
            doc, h, pairs = doc[order], h[order], np.stack([begin[order], stop[order]], 1).astype("<i4")
            cuts = np.flatnonzero(first_in_order([doc, h])).tolist() + [len(doc)]
            first = np.array(cuts[:-1], np.int64)
            for i in range(0, len(first), 4096):
                f = first[i : i + 4096]
                c = cuts[i : i + len(f) + 1]
                yield pa.RecordBatch.from_arrays([pa.array(doc[f], mask=doc[f] == LAST), pa.array(h[f].astype(np.int32)), pa.array([pairs[x:y].tobytes() for x, y in zip(c, c[1:], strict=False)], pa.binary())], ["doc_id", "_h", "ranges"])

        for batch in batches:
            for number, *columns in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if number != shard:
                    yield from settle()
                    shard, held = number, []
                held.append([np.frombuffer(c, t) for c, (_, t) in zip(columns, of_segment + of_place, strict=True)])
        yield from settle()

    sent = mapped(rows, send, "shard long, " + ", ".join(f"{k} binary" for k in names[1:]))
    return mapped(sent.repartition(F.col("shard")).sortWithinPartitions("shard"), meet, "doc_id long, _h int, ranges binary")


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, key: int = KEY) -> DataFrame:
    """Every row of ``docs`` as doc_id, kept (binary: the remaining bytes), n_bytes, n_removed, n_spans.

    Null and empty texts have no bytes; texts shorter than ``length`` stay whole.  Repeated rows remove each other, as
    any equal strings do.  An empty table gives no rows.
    """
    hits = repeated_ranges(docs, length, key).groupBy(number().alias("_id"), F.col("_h").alias("_g")).agg(F.collect_list("ranges").alias("ranges"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), text_hash(text).alias("_h"))
    rows = rows.join(hits, (number() == F.col("_id")) & (F.col("_h") == F.col("_g")), "left").select("doc_id", "text", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in steps(big):
                raw, at = flat(batch.column("text"))
                edge = np.zeros(len(raw) + 1, np.int32)
                for i, ranges in enumerate(batch.column("ranges").to_pylist()):
                    if ranges:
                        pairs = np.frombuffer(b"".join(ranges), "<i4").reshape(-1, 2).astype(np.int64) + at[i]
                        np.add.at(edge, pairs[:, 0], 1)
                        np.add.at(edge, pairs[:, 1], -1)
                gone = np.cumsum(edge[:-1]) > 0
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                starts = at[:-1][np.diff(at) > 0]
                opens[starts] = gone[starts]
                removed, spans = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(opens)]
                kept = [raw[a:b][~gone[a:b]].tobytes() for a, b in zip(at.tolist(), at.tolist()[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), *[pa.array(np.diff(x).astype(np.int64)) for x in (at, removed[at], spans[at])]], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return mapped(rows, cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, kept binary, n_bytes long, n_removed long, n_spans long")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
