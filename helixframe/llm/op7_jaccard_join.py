"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures before exact intersection.

A document is the set of its distinct word shingles; equal sets are one node.  In a global order with frequent shingles
last, two sets of similarity t share one of their first n - ceil(t n) + 1 shingles.  The nodes with such a shingle in
common are a tile, in order of size, and only sizes within the band of t can link.  In a tile, each pair's bitmaps (the
parity of the shingles hashed to each bit) bound the overlap from above: the bits that differ are no more than the
shingles that differ.  Pairs that pass are thinned to those that join parts of the tile, and their sorted sets are
intersected exactly.  Where a pair fails, the sets of its part are compared exactly in one place (those of a very large part
in its tiles), so no link between different sets is lost.  A count-min sketch spares shingles that only one set begins with:
one filter for all tasks while it has room for the first shingles, else a distributed one that gives each set its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch
from .arrays import ODD_A, Rolling, U, mix, split_words, steps, window_starts
from .common import documents, mapped, release, written
from .components import components
from .op5_substring_dedup import first_in_order, shingle_count, text_hash

#: Documents at most on which frequent shingles are counted, the share of them that makes a shingle frequent, and how
#: many such shingles are kept.  They only set the order of the shingles; any order gives the same result.
SAMPLE_DOCS, FREQUENT, MOST_FREQUENT = 5000, 0.002, 100_000
#: Bits of a bitmap for each shingle in the tiles, and where a part in which a pair failed is settled.
BITS, SETTLE_BITS = 0.5, 16.0
#: Nodes up to which such a part's sets meet in one task; the sets of larger ones meet in the shards of their tiles.
MOST_PART = 20_000
LEAST_BITS, MOST_BITS = 64, 1 << 17
#: Logarithm of the counters that the one filter of first shingles can have in a row.
FILTER_BITS = sketch.MOST_BITS
#: Bytes of bitmaps, with all copies, after which ``sent_by_node`` sends what it has.
SEND_BYTES = 8 << 20
#: Tiles of more nodes are joined node by node against the parts found so far.
SMALL_TILE = 256


@dataclass(frozen=True)
class Join:
    width: int = 3
    share: int = 90
    """Similarity in hundredths."""
    lower: bool = True

    def linked(self, both, a, b):
        return 100 * both >= self.share * (a + b - both)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - (n * self.share + 99) // 100 + (n > 0)


@dataclass
class Sets:
    tokens: np.ndarray
    """All sets' shingle hashes, sorted inside each set."""
    at: np.ndarray
    node: np.ndarray
    """A 64-bit hash of each set, as a signed number."""

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.at)


def shingle_sets(texts: pa.Array, join: Join) -> Sets:
    w = split_words(texts)
    h = w.hashes(join.lower)
    words = np.diff(w.at)
    full = np.flatnonzero(window_starts(w.at, join.width))
    rolling = Rolling(h)
    short = np.flatnonzero((words > 0) & (words < join.width))
    tokens = np.concatenate([mix(rolling.of(full, full + join.width)), mix(rolling.of(w.at[short], w.at[short + 1]) + words[short].astype(U) * U(ODD_A))])
    doc = np.concatenate([np.searchsorted(w.at, full, "right") - 1, short])
    order = np.lexsort((tokens, doc))
    tokens, doc = tokens[order], doc[order]
    keep = first_in_order([doc, tokens])
    tokens, doc = tokens[keep], doc[keep]
    at = np.searchsorted(doc, np.arange(len(words) + 1))
    sums = np.zeros(len(tokens) + 1, U)
    np.cumsum(mix(tokens ^ U(0x5851F42D4C957F2D)), out=sums[1:])
    node = mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(U)).view(np.int64)
    return Sets(tokens, at, node)


def pick(s: Sets, which: np.ndarray) -> Sets:
    """Some of the sets."""
    size = s.size[which]
    at = np.r_[0, np.cumsum(size)]
    inside = np.arange(at[-1]) - np.repeat(at[:-1], size) + np.repeat(s.at[:-1][which], size)
    return Sets(s.tokens[inside], at, s.node[which])


def beginnings(s: Sets, join: Join, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of sets, shingles): the first shingles of each set in the global order."""
    doc = np.repeat(np.arange(len(s.node)), s.size)
    rank = np.zeros(len(s.tokens), np.int32)
    if len(frequent):
        # ``frequent``: hashes in sorted order and their ranks
        at = np.minimum(np.searchsorted(frequent[0], s.tokens), len(frequent[0]) - 1)
        rank = np.where(frequent[0][at] == s.tokens, frequent[1][at].astype(np.int32), 0)
    order = np.lexsort((rank, doc))  # stable: hashes stay in order inside a rank
    place = np.arange(len(order)) - np.repeat(s.at[:-1], s.size)
    chosen = order[place < np.repeat(join.prefix(s.size), s.size)]
    return doc[chosen], s.tokens[chosen]


def bitmap_bits(size: np.ndarray, each: float) -> np.ndarray:
    want = np.clip(np.ceil(size * each), LEAST_BITS, MOST_BITS)
    return (1 << np.ceil(np.log2(want)).astype(np.int64)).astype(np.int64)


def bitmaps(s: Sets, each: float) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words of all bitmaps, index of each set's first word)."""
    bits = bitmap_bits(s.size, each)
    at = np.r_[0, np.cumsum(bits)]
    place = np.repeat(at[:-1], s.size) + ((s.tokens >> U(20)) & np.repeat(bits - 1, s.size).astype(U)).astype(np.int64)
    odd = (np.bincount(place, minlength=at[-1]) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8"), at // 64


class Tiles:
    """Nodes with sizes and bitmaps, and the test that bounds a pair's overlap from above."""

    def __init__(self, node: np.ndarray, size: np.ndarray, words: np.ndarray, at: np.ndarray, join: Join):
        self.node, self.size, self.words, self.at, self.join = node, size, words, at, join
        self.long = np.diff(at)

    def _rows(self, i: np.ndarray, n: int) -> np.ndarray:
        """The bitmaps of nodes i at n words; longer ones are folded, which keeps the bound."""
        out = self.words[self.at[:-1][i][:, None] + np.arange(n)]
        again = self.long[i] // n
        for k in range(1, int(again.max(initial=1))):
            more = np.flatnonzero(again > k)
            out[more] ^= self.words[self.at[:-1][i[more]][:, None] + k * n + np.arange(n)]
        return out

    def may_link(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.size[i], self.size[j]
        ok = 100 * np.minimum(a, b) >= self.join.share * np.maximum(a, b)
        for n in np.unique(np.minimum(self.long[i], self.long[j])[ok]):
            some = np.flatnonzero(ok & (np.minimum(self.long[i], self.long[j]) == n))
            for k in range(0, len(some), step := max(1, (1 << 20) // int(n))):
                p = some[k : k + step]
                differ = np.bitwise_count(self._rows(i[p], int(n)) ^ self._rows(j[p], int(n))).sum(1, dtype=np.int64)
                ok[p] = self.join.linked((a[p] + b[p] - differ) // 2, a[p], b[p])
        return ok


class Parts:
    """Disjoint sets of numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def unite(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def tile_pairs(token: np.ndarray, who: np.ndarray, tiles: Tiles) -> list[tuple[int, int]]:
    """Pairs of node numbers that may link, as many as join the parts that they form.

    (token, who) are the tiles' rows, sorted by token and size; sizes only grow along a tile, so a node's partners end
    where the band ends.
    """
    parts = Parts(len(tiles.node))
    found: list[tuple[int, int]] = []
    passed: list[np.ndarray] = []

    def take(i: np.ndarray, j: np.ndarray) -> None:
        pairs = np.unique(np.minimum(i, j).astype(np.int64) << 32 | np.maximum(i, j))
        passed.append(pairs[tiles.may_link(pairs >> 32, pairs & 0xFFFFFFFF)])

    start = np.flatnonzero(first_in_order([token]))
    number = np.diff(np.r_[start, len(token)])
    end = np.repeat(start + number, number)
    size, share = tiles.size[who], tiles.join.share
    alive, k, held = np.flatnonzero(np.repeat(number <= SMALL_TILE, number)), 1, []
    while len(alive):
        alive = alive[alive + k < end[alive]]
        alive = alive[100 * size[alive] >= share * size[alive + k]]
        held.append((who[alive], who[alive + k]))
        k += 1
        if sum(len(x) for x, _ in held) > 1 << 20:
            take(*map(np.concatenate, zip(*held, strict=True)))
            held.clear()
    if held:
        take(*map(np.concatenate, zip(*held, strict=True)))
    # in order of the smaller node: parts become stars around it, and all shards choose the same pairs
    for pair in np.unique(np.concatenate(passed)).tolist() if passed else []:
        x, y = pair >> 32, pair & 0xFFFFFFFF
        if parts.unite(x, y):
            found.append((x, y))
    for s, n in zip(start[number > SMALL_TILE].tolist(), number[number > SMALL_TILE].tolist(), strict=True):
        rows = who[s : s + n]
        sizes, label = tiles.size[rows], np.arange(n)
        for i in range(1, n):
            low = int(np.searchsorted(sizes[:i], -(-share * int(sizes[i]) // 100)))
            # first the smallest node of each part in the band, then all nodes of the parts that did not pass
            by_node = low + np.argsort(rows[low:i])
            for among in (by_node[np.unique(label[by_node], return_index=True)[1]], None):
                if among is None:
                    among = low + np.flatnonzero(label[low:i] != label[i])
                for j in among[tiles.may_link(rows[among], np.full(len(among), rows[i]))].tolist():
                    if label[j] != label[i]:
                        label[label == label[j]] = label[i]
                        if parts.unite(int(rows[j]), int(rows[i])):
                            found.append((int(rows[j]), int(rows[i])))
    return found


# ---- the operator


def frequent_shingles(rows: DataFrame, join: Join) -> np.ndarray:
    """(hashes in order, ranks from 1, the most frequent last) of the shingles that a bounded sample holds frequent."""
    n = rows.count()
    sample = rows.sample(fraction=min(1.0, 0.9 * SAMPLE_DOCS / max(1, n)), seed=11).limit(SAMPLE_DOCS)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in steps(big):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(batch.column("text"), join).tokens.view(np.int64))], ["token"])

    least = max(3, int(FREQUENT * min(n, SAMPLE_DOCS)))
    counts = mapped(sample.select("text"), spell, "token long").groupBy("token").count().filter(F.col("count") >= least)
    got = counts.orderBy(F.col("count").desc(), "token").limit(MOST_FREQUENT).select("token").toArrow()
    if not len(got):
        return np.zeros((0, 0), U)
    tokens = got.column("token").to_numpy().astype(np.int64).view(U)
    ranks = np.arange(len(got), 0, -1).astype(U)
    order = np.argsort(tokens)
    return np.stack([tokens[order], ranks[order]])


def distinct_sets(batch: pa.RecordBatch, join: Join, seen: set[int]) -> Sets:
    """The batch's sets that are not empty and not in ``seen``, to which they are added."""
    s = shingle_sets(batch.column("text"), join)
    _, first = np.unique(s.node, return_index=True)
    which = [i for i in np.sort(first[s.size[first] > 0]).tolist() if int(s.node[i]) not in seen]
    seen.update(s.node[which].tolist())
    return pick(s, np.array(which, np.int64))


def shard_count(words: int) -> int:
    return int(min(1 << 16, max(64, words // 1_000_000)))


def shard_rows(shards: int, doc: np.ndarray, token: np.ndarray, node: np.ndarray, size: np.ndarray, bits: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each shard of the first shingles (doc, token), with its nodes' sizes and bitmaps."""
    shard = ((token >> U(40)) % U(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    doc, token, shard = doc[order], token[order], shard[order]
    numbers, first = np.unique(shard, return_index=True)
    columns: list[list[bytes]] = [[], [], [], []]
    cuts = [*first.tolist(), len(shard)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        d = doc[a:b]
        n = at[d + 1] - at[d]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[d], n)
        for c, x in zip(columns, (token[a:b], node[d], size[d].astype("<i4"), bits[inside]), strict=True):
            c.append(x.tobytes())
    for i in range(0, len(numbers), 256):
        yield pa.RecordBatch.from_arrays([pa.array(numbers[i : i + 256], pa.int64()), *[pa.array(c[i : i + 256], pa.binary()) for c in columns]], ["shard", "token", "node", "size", "bits"])


def shared_firsts(rows: DataFrame, join: Join, frequent: np.ndarray, expected: int) -> DataFrame:
    """(node, codes): the first shingles of each node that another node is estimated to have too, by a distributed sketch."""

    def firsts(seen: set[int], big: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in steps(big):
            s = distinct_sets(batch, join, seen)
            doc, token = beginnings(s, join, frequent)
            yield token, s.node[doc], np.zeros(len(doc), np.int32)

    # ``seen`` is a task's own: each gets a copy of the empty set
    own = sketch.spread(rows.select("text"), partial(firsts, set()), expected, distinct=True)
    return written(own.groupBy(F.col("doc").alias("node")).agg(F.collect_list("codes").alias("codes")))


def sent_by_node(rows: DataFrame, join: Join, firsts: DataFrame, shards: int, each: float) -> DataFrame:
    """The rows of the shards from ``shared_firsts``: nodes with sizes and bitmaps meet their shingles, texts don't travel."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for big in batches:
            for batch in steps(big):
                s = distinct_sets(batch, join, seen)
                bits, at = bitmaps(s, each)
                yield pa.RecordBatch.from_arrays([pa.array(s.node), pa.array(s.size.astype(np.int32)), pa.array([bits[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["_n", "size", "bits"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size = batch.column("node").to_numpy(), batch.column("size").to_numpy()
            tokens = [np.unique(np.frombuffer(b"".join(c), "<u8")) for c in batch.column("codes").to_pylist()]
            bits = [np.frombuffer(b, "<u8") for b in batch.column("bits").to_pylist()]
            number = np.array([len(t) for t in tokens], np.int64)
            at = np.r_[0, np.cumsum([len(b) for b in bits])].astype(np.int64)
            # each first shingle can take a copy of its bitmap along, so a step is bounded by those
            step = np.cumsum(number * (8 * np.diff(at) + 20)) // SEND_BYTES
            cuts = [*np.flatnonzero(first_in_order([step])).tolist(), len(node)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield from shard_rows(shards, np.repeat(np.arange(b - a), number[a:b]), np.concatenate(tokens[a:b]), node[a:b], size[a:b], np.concatenate(bits[a:b]), at[a : b + 1] - at[a])

    # a set comes once from each partition that has it; the copies are equal
    nodes = mapped(rows.select("text"), spell, "_n long, size int, bits binary").groupBy("_n").agg(F.first("size").alias("size"), F.first("bits").alias("bits"))
    met = firsts.join(nodes, F.col("node") == F.col("_n")).select("node", "codes", "size", "bits")
    return mapped(met, send, "shard long, token binary, node binary, size binary, bits binary")


def candidate_pairs(rows: DataFrame, join: Join, frequent: np.ndarray, shared: sketch.Filter | DataFrame, words: int) -> DataFrame:
    """(a, b), a < b: nodes that may link.  ``shared``: a filter of the shingles that several begin with, or ``shared_firsts``."""
    shards, each = shard_count(words), BITS

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for big in batches:
            for batch in steps(big):
                s = distinct_sets(batch, join, seen)
                doc, token = beginnings(s, join, frequent)
                hit = shared.holds(token)
                yield from shard_rows(shards, doc[hit], token[hit], s.node, s.size, *bitmaps(s, each))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def pairs() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            token, node, size, bits = (np.concatenate(x) for x in zip(*held, strict=True))
            at = np.r_[0, np.cumsum(bitmap_bits(size, each) // 64)]
            names, first, who = np.unique(node, return_index=True, return_inverse=True)
            long = at[first + 1] - at[first]
            inside = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long) + np.repeat(at[first], long)
            tiles = Tiles(names, size[first].astype(np.int64), bits[inside], np.r_[0, np.cumsum(long)], join)
            order = np.lexsort((who, tiles.size[who], token))
            token, who = token[order], who[order]
            keep = first_in_order([token, who])
            found = np.array(tile_pairs(token[keep], who[keep], tiles), np.int64).reshape(-1, 2)
            a, b = names[found[:, 0]], names[found[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            for number, *columns in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if number != shard:
                    yield from pairs()
                    shard, held = number, []
                held.append([np.frombuffer(c, t) for c, t in zip(columns, ("<u8", "<i8", "<i4", "<u8"), strict=True)])
        yield from pairs()

    if isinstance(shared, DataFrame):
        sent = sent_by_node(rows, join, shared, shards, each)
    else:
        sent = mapped(rows.select("text"), send, "shard long, token binary, node binary, size binary, bits binary")
    return mapped(sent.repartition(F.col("shard")).sortWithinPartitions("shard"), meet, "a long, b long").distinct()


def nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def filter_of(nodes: DataFrame, expected: int) -> sketch.Filter:
    return sketch.build(nodes, lambda batch: batch.column(0).to_numpy().view(U), expected, at_least=1)


def spelled_sets(rows: DataFrame, needed: sketch.Filter, join: Join) -> DataFrame:
    """(node, tokens): the sorted sets of the nodes that the filter holds."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for big in batches:
            for batch in steps(big):
                s = distinct_sets(batch, join, seen)
                s = pick(s, np.flatnonzero(needed.holds(s.node.view(U))))
                yield pa.RecordBatch.from_arrays([pa.array(s.node), pa.array([s.tokens[a:b].tobytes() for a, b in zip(s.at, s.at[1:], strict=False)], pa.binary())], ["node", "tokens"])

    # a set comes once from each partition that has it; the copies are equal
    return mapped(rows.select("text"), spell, "node long, tokens binary").groupBy("node").agg(F.first("tokens").alias("tokens"))


def verified(rows: DataFrame, pairs: DataFrame, join: Join) -> DataFrame:
    """``pairs`` with ``linked``: exact intersections of the sorted sets."""
    needed = filter_of(nodes_of(pairs), 2 * pairs.count())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(bool(join.linked(both, len(x), len(y))))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.bool_())], ["a", "b", "linked"])

    sets = spelled_sets(rows, needed, join)
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
    both = with_a.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")
    return mapped(both, compare, "a long, b long, linked boolean")


def exact_links(node: np.ndarray, sets: list[np.ndarray], join: Join, groups: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that connect what is connected among the given sets: each set meets the parts found so far, by size.

    With ``groups`` (numbers of sets), only links inside a group need be found.
    """
    size = np.array([len(x) for x in sets], np.int64)
    order = np.lexsort((node, size))
    node, size, sets = node[order], size[order], [sets[i] for i in order.tolist()]
    s = Sets(np.concatenate(sets), np.r_[0, np.cumsum(size)], node)
    tiles = Tiles(node, size, *bitmaps(s, SETTLE_BITS), join)
    label, found = np.arange(len(node)), []
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    for group in [np.arange(len(node))] if groups is None else [np.sort(place[g]) for g in groups]:
        sizes, by_node = size[group], np.argsort(node[group])
        for n, i in enumerate(group.tolist()):
            low = int(np.searchsorted(sizes[:n], -(-join.share * int(size[i]) // 100)))
            other = label[group] != label[i]
            if not other[low:n].any():
                continue
            # first the smallest node of each part in the band, then all nodes of the parts that did not pass
            near = by_node[(by_node >= low) & (by_node < n)]
            near = group[near[other[near]]]
            for among in (near[np.unique(label[near], return_index=True)[1]], None):
                if among is None:
                    among = group[low + np.flatnonzero(label[group[low:n]] != label[i])]
                for j in among[tiles.may_link(among, np.full(len(among), i))].tolist():
                    if label[j] != label[i] and join.linked(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), int(size[i]), int(size[j])):
                        label[label == label[j]] = label[i]
                        found.append((int(node[j]), int(node[i])))
    return found


def settled(rows: DataFrame, parts: DataFrame, join: Join) -> DataFrame:
    """(a, b): exact links inside each of the parts (node, root), whose sets meet in one place."""
    needed = filter_of(parts.select("node"), parts.count())

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, nodes, sets = None, [], []

        def part() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                found = np.array(exact_links(np.array(nodes, np.int64), sets, join), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(found[:, 0], found[:, 1])), pa.array(np.maximum(found[:, 0], found[:, 1]))], ["a", "b"])

        for batch in batches:
            for of, node, tokens in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if of != root:
                    yield from part()
                    root, nodes, sets = of, [], []
                nodes.append(node)
                sets.append(np.frombuffer(tokens, U))
        yield from part()

    sets = spelled_sets(rows, needed, join).withColumnRenamed("node", "_n")
    met = parts.select("root", "node").join(sets, F.col("node") == F.col("_n")).select("root", "node", "tokens")
    return mapped(met.repartition(F.col("root")).sortWithinPartitions("root"), settle, "a long, b long")


def settled_in_tiles(rows: DataFrame, only: sketch.Filter, join: Join, frequent: np.ndarray, shared: sketch.Filter | DataFrame, words: int) -> DataFrame:
    """(a, b): exact links, enough to connect what is connected among the nodes that the filter holds.

    A set goes once to each shard of its first shingles; there its tiles are linked exactly, so a shard gives fewer pairs
    than it has nodes.
    """
    shards = shard_count(words)

    def whole(s: Sets, doc: np.ndarray, token: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A row for each shard of each set, with the set."""
        shard = ((token >> U(40)) % U(shards)).astype(np.int64)
        order = np.lexsort((doc, shard))
        doc, token, shard = doc[order], token[order], shard[order]
        cuts = np.r_[np.flatnonzero(first_in_order([shard, doc])), len(shard)]
        for k in range(0, len(cuts) - 1, 256):
            spans = [(int(a), int(b)) for a, b in zip(cuts[k : k + 256], cuts[k + 1 : k + 257], strict=False)]
            sets = [s.tokens[s.at[doc[a]] : s.at[doc[a] + 1]].tobytes() for a, _ in spans]
            first = [a for a, _ in spans]
            yield pa.RecordBatch.from_arrays([pa.array(shard[first]), pa.array(s.node[doc[first]]), pa.array([token[a:b].tobytes() for a, b in spans], pa.binary()), pa.array(sets, pa.binary())], ["shard", "node", "first", "tokens"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for big in batches:
            for batch in steps(big):
                s = distinct_sets(batch, join, seen)
                s = pick(s, np.flatnonzero(only.holds(s.node.view(U))))
                doc, token = beginnings(s, join, frequent)
                hit = shared.holds(token)
                yield from whole(s, doc[hit], token[hit])

    def send_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, codes, tokens in zip(*[batch.column(c).to_pylist() for c in ("node", "codes", "tokens")], strict=True):
                tokens, first = np.frombuffer(tokens, U), np.unique(np.frombuffer(b"".join(codes), "<u8"))
                yield from whole(Sets(tokens, np.array([0, len(tokens)]), np.array([node], np.int64)), np.zeros(len(first), np.int64), first)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, {}

        def pairs() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                firsts = [x for x, _ in held.values()]
                token, who = np.concatenate(firsts), np.repeat(np.arange(len(firsts)), [len(x) for x in firsts])
                order = np.argsort(token, kind="stable")
                groups = np.split(who[order], np.flatnonzero(first_in_order([token[order]]))[1:])
                found = exact_links(np.array(list(held), np.int64), [x for _, x in held.values()], join, [g for g in groups if len(g) > 1])
                found = np.array(found, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(found[:, 0], found[:, 1])), pa.array(np.maximum(found[:, 0], found[:, 1]))], ["a", "b"])

        for batch in batches:
            for number, node, first, tokens in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if number != shard:
                    yield from pairs()
                    shard, held = number, {}
                # a set comes once from each partition that has it; the copies are equal
                held.setdefault(node, (np.frombuffer(first, U), np.frombuffer(tokens, U)))
        yield from pairs()

    if isinstance(shared, DataFrame):
        met = shared.join(spelled_sets(rows, only, join).withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).select("node", "codes", "tokens")
        sent = mapped(met, send_met, "shard long, node long, first binary, tokens binary")
    else:
        sent = mapped(rows.select("text"), send, "shard long, node long, first binary, tokens binary")
    return mapped(sent.repartition(F.col("shard")).sortWithinPartitions("shard"), meet, "a long, b long").distinct()


def links(rows: DataFrame, join: Join) -> DataFrame:
    """(a, b): links between different sets, enough of them to connect all that are connected."""
    words = shingle_count(rows)
    frequent = frequent_shingles(rows, join)

    def first_ones(big: pa.RecordBatch) -> np.ndarray:
        seen: set[int] = set()
        return np.concatenate([beginnings(distinct_sets(batch, join, seen), join, frequent)[1] for batch in steps(big)] or [np.zeros(0, U)])

    expected = words * (100 - join.share) // 100
    # a filter without room lets all first shingles pass, each with a bitmap: many times the texts
    shared = sketch.build(rows.select("text"), first_ones, expected) if sketch.fits(expected, FILTER_BITS) else shared_firsts(rows, join, frequent, expected)
    release(rows.sparkSession)
    pairs = written(candidate_pairs(rows, join, frequent, shared, words))
    release(rows.sparkSession)
    told = written(verified(rows, pairs, join))
    release(rows.sparkSession)
    found, failed = told.filter("linked").select("a", "b"), told.filter("not linked")
    if failed.isEmpty():
        return found
    # all links of a part lie inside it, so only the parts in which a pair failed are looked at again
    parts = components(pairs, "a", "b")
    again = parts.join(nodes_of(failed), "node").select("root").distinct()
    again = written(parts.join(parts.join(again, "root").groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root").select("node", "root", "n"))
    found = found.union(settled(rows, again.filter(F.col("n") <= MOST_PART), join))
    large = again.filter(F.col("n") > MOST_PART).select("node")
    if not large.isEmpty():
        found = found.union(settled_in_tiles(rows, filter_of(large, large.count()), join, frequent, shared, words))
    return found


def classes(docs: DataFrame, join: Join) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): each row's doc_id, text hash _h, n_shingles and _node; each node's _root, its component's name."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), text_hash(text).alias("_h"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in steps(big):
                s = shingle_sets(batch.column("text"), join)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_h"), pa.array(s.size.astype(np.int64)), pa.array(s.node)], ["doc_id", "_h", "n_shingles", "_node"])

    own = written(mapped(rows, sizes, f"doc_id {kind}, _h int, n_shingles long, _node long"))
    roots = components(links(rows, join), "a", "b")
    release(docs.sparkSession)
    # minima come before the exchanges, so equal sets cost one row a partition
    nodes = own.filter("n_shingles > 0").groupBy("_node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h")).alias("_least"), F.min("doc_id").alias("_id"))
    nodes = nodes.join(roots, F.col("_node") == F.col("node"), "left").select("_node", F.coalesce("root", "_node").alias("_root"), "_least", "_id")
    return own, nodes


def jaccard_components(docs: DataFrame, join: Join = Join()) -> DataFrame:  # noqa: B008
    """Every row of ``docs`` as doc_id, n_shingles and component_id, the smallest doc_id that links reach from it.

    Documents without words (null and empty texts) have no shingles and are their own components.  Equal sets always
    link.  Rows without an id take part, but a component's id is null only where no row of it has one.
    """
    own, nodes = classes(docs, join)
    least = nodes.groupBy("_root").agg(F.min("_id").alias("component_id"))
    named = nodes.join(least, "_root").select(F.col("_node").alias("_named"), "component_id")
    out = own.join(named, (F.col("_node") == F.col("_named")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, join: Join = Join(5, 80)) -> DataFrame:  # noqa: B008
    """The rows of ``docs`` with the smallest doc_id of each component, and those without words; all columns stay.

    Rows with one id and text count as one, and one of them stays.
    """
    own, nodes = classes(docs, join)
    kept = nodes.groupBy("_root").agg(F.min("_least").alias("k")).select("k.doc_id", "k._h")
    kept = kept.union(own.filter("n_shingles = 0").select("doc_id", "_h").distinct()).select(F.col("doc_id").alias("__kept"), F.col("_h").alias("__kept_h"))
    same = docs["doc_id"].eqNullSafe(F.col("__kept")) & (text_hash(F.coalesce(docs["text"], F.lit(""))) == F.col("__kept_h"))
    return docs.join(kept, same).dropDuplicates(["doc_id", "__kept_h"]).select(*docs.columns)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


QUERIES = {"op7_jaccard_join": op7_jaccard_join}
