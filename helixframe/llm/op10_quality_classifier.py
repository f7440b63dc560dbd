"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line gets features of its own and of its neighbours and is labelled good or bad; the chain's forward-backward
marginals, weighted by the lines' lengths, give the document's quality.  Labels exist for documents only, so in training
every line of a document carries the document's label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import flat, mix, split_words, steps
from .common import documents, mapped, written

#: Labelled documents at most that the fit sees, and lines of a stretch in which it walks along them.  Documents are chosen
#: whole, as long as they have no more lines than so many stretches together; this bounds what reaches the driver.
TRAIN_DOCS, TRAIN_LINES = 4000, 500
ROUNDS, RATE, L2 = 200, 0.1, 1e-3
THRESHOLD = 0.3

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256), "symbol": b"#*$%&<>", "bar": b"|", "bang": b"!",
    "stop": b".?", "comma": b",;:", "bracket": b"()[]{}\"'", "control": [*range(0, 9), *range(14, 32), 127],
}
_OF_CLASS = np.zeros((len(_CLASSES), 256), bool)
for _i, _members in enumerate(_CLASSES.values()):
    _OF_CLASS[_i, list(_members)] = True
#: Features of one line, in order.
OWN = [*_CLASSES, "word_length", "long_words", "same_as_last", "same_as_second_last", "seen_line", "short", "empty"]


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, lengths in bytes, index of each document's first line).  A null or empty text is one empty line."""
    raw, at = flat(texts)
    cuts = np.flatnonzero(raw == 10)
    line_at = np.searchsorted(cuts, at) + np.arange(len(at))
    # lines start at documents and after line ends
    begin = np.sort(np.concatenate([at[:-1], cuts + 1]), kind="stable") if len(cuts) else at[:-1]
    end = np.sort(np.concatenate([at[1:], cuts]), kind="stable") if len(cuts) else at[1:]
    size = end - begin
    n, safe = len(begin), np.maximum(size, 1)
    out = np.zeros((n, len(OWN)), np.float32)
    for k in range(len(_CLASSES)):
        sums = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(_OF_CLASS[k][raw], out=sums[1:])
        out[:, k] = (sums[end] - sums[begin]) / safe
    w = split_words(texts)
    words = np.searchsorted(w.start, end) - (first := np.searchsorted(w.start, begin))
    many = np.maximum(words, 1)
    h, k = w.hashes(lower=True), len(_CLASSES)

    def share(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int32)
        np.cumsum(flags, out=sums[1:])
        return (sums[first + words] - sums[first]) / many

    length = w.end - w.start
    sums = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=sums[1:])
    out[:, k] = np.minimum((sums[first + words] - sums[first]) / many / 10, 3)
    out[:, k + 1] = share(length > 20)
    for back in (1, 2):
        same = np.zeros(len(h), bool)
        same[back:] = h[back:] == h[:-back]
        out[:, k + 1 + back] = share(same)
    # a line's hash is that of its words in order; a line is seen if an earlier one of its document is equal
    order = mix(h + np.arange(len(h), dtype=np.uint64) - np.repeat(first, words).astype(np.uint64)) if len(h) else h
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(order, out=sums[1:])
    line_hash = sums[first + words] - sums[first]
    doc = np.repeat(np.arange(len(at) - 1), np.diff(line_at))
    sort = np.lexsort((line_hash, doc))
    again = np.zeros(n, bool)
    again[sort[1:]] = (line_hash[sort[1:]] == line_hash[sort[:-1]]) & (doc[sort[1:]] == doc[sort[:-1]])
    out[:, k + 4] = again & (words > 0)
    out[:, k + 5] = 1 / (1 + words)
    out[:, k + 6] = words == 0
    return out, size + 1, line_at


def with_neighbours(own: np.ndarray, line_at: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and of the line after (zeros at the ends), and a constant."""
    n, k = own.shape
    out = np.zeros((n, 3 * k + 1), np.float32)
    out[:, :k] = own
    out[1:, k : 2 * k] = own[:-1]
    out[line_at[:-1], k : 2 * k] = 0
    out[:-1, 2 * k : 3 * k] = own[1:]
    out[line_at[1:] - 1, 2 * k : 3 * k] = 0
    out[:, -1] = 1
    return out


@dataclass(frozen=True)
class Chain:
    weights: np.ndarray
    """Of a line's features, for good against bad."""
    moves: np.ndarray
    """2 x 2 log weights from a line's label to the next one's; 0 is bad, 1 is good."""
    scale: tuple[float, float] = (1.0, 0.0)
    """Slope and offset, in log odds, from a document's share of good lines to its score."""


def marginals(chain: Chain, x: np.ndarray, line_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, the expected counts of the four moves, and the sum of the log partition functions.

    Documents go side by side, one line of each a step, from the longest down.
    """
    size = np.diff(line_at)
    order = np.argsort(-size, kind="stable")
    starts, size = line_at[:-1][order], size[order]
    score = (x @ chain.weights).astype(np.float64)
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(longest), "left")  # documents with more than t lines
    e = np.exp(chain.moves)
    local = np.stack([np.ones_like(score), np.exp(np.clip(score, -30, 30))], 1)
    ahead, scale = np.zeros((len(score), 2)), np.zeros(len(score))
    for t in range(longest):
        i = starts[: alive[t]] + t
        a = local[i] if t == 0 else (ahead[i - 1] @ e) * local[i]
        scale[i] = a.sum(1)
        ahead[i] = a / scale[i, None]
    back = np.ones((len(score), 2))
    counts = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        i = starts[: alive[t + 1]] + t
        nxt = local[i + 1] * back[i + 1] / scale[i + 1, None]
        counts += e * (ahead[i].T @ nxt)
        back[i] = nxt @ e.T
    both = ahead * back
    return both[:, 1] / both.sum(1), counts, float(np.log(scale).sum())


def fit(own: list[np.ndarray], labels: list[int], rounds: int = ROUNDS, rate: float = RATE, l2: float = L2, lines: int = TRAIN_LINES) -> Chain:
    """Maximum likelihood with an L2 penalty, by Adam over all documents in each round.  Without documents: all zeros.

    All lines count; the chain starts anew every ``lines`` lines, so a long document doesn't make a round long.
    """
    k = 3 * len(OWN) + 1
    if not own:
        return Chain(np.zeros(k), np.zeros((2, 2)))
    line_at = np.concatenate([[0], np.cumsum([len(o) for o in own])])
    x = with_neighbours(np.concatenate(own), line_at)
    y = np.repeat(np.array(labels), np.diff(line_at))
    line_at = np.concatenate([*[np.arange(a, b, lines) for a, b in zip(line_at, line_at[1:], strict=False)], line_at[-1:]])
    size, of_stretch = np.diff(line_at), y[line_at[:-1]]
    # each document counts once, however many lines it has
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (size - 1)[of_stretch == label].sum()
    theta = np.zeros(k + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        chain = Chain(theta[:k], theta[k:].reshape(2, 2))
        p, counts, _ = marginals(chain, x, line_at)
        slope = np.concatenate([(y - p) @ x, (seen - counts).ravel()]) / len(own) - l2 * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Chain(theta[:k], theta[k:].reshape(2, 2))


def log_odds(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


def calibrated(share: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic fit of the labels to the shares' log odds, by Newton steps with a small penalty."""
    x, theta = np.stack([log_odds(share), np.ones_like(share)], 1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (labels - p) - (theta - [1.0, 0.0])
        theta = theta + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(2), slope)
    return float(max(theta[0], 0.05)), float(theta[1])


def weighted_share(p: np.ndarray, size: np.ndarray, line_at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(p * size, line_at[:-1]) / np.add.reduceat(size, line_at[:-1])


def document_scores(chain: Chain, texts: pa.Array) -> np.ndarray:
    own, size, line_at = line_features(texts)
    p, _, _ = marginals(chain, with_neighbours(own, line_at), line_at)
    slope, offset = chain.scale
    return 1 / (1 + np.exp(-np.clip(slope * log_odds(weighted_share(p, size, line_at)) + offset, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_DOCS, lines: int = TRAIN_LINES) -> Chain:
    """Fit on the ``rows`` labelled documents with the smallest hashes of their ids, whole, while they have ``rows * lines`` lines at most.

    A document that has more than that alone is passed over.
    Rows of ``labels`` without a quality or id don't count; of several for one id the smallest quality does.
    """
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    pairs = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("_label").cast("long").alias("label"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in steps(big):
                own, size, at = line_features(batch.column("text"))
                some = [[x[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)] for x in (own, size.astype(np.int64))]
                columns = [batch.column("doc_id"), batch.column("label"), *[pa.array(x, pa.binary()) for x in some], pa.array(np.diff(at), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "own", "size", "n"])

    count = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    pairs = pairs.filter(F.coalesce(count, F.lit(1)) <= rows * lines)
    made = written(mapped(pairs, features, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label long, own binary, size binary, n long"))
    made = made.withColumn("_key", F.struct(F.xxhash64("doc_id"), "doc_id", F.xxhash64("own", "size")))
    before = Window.orderBy("_key")
    slim = made.select("_key", F.sum("n").over(before).alias("lines"), F.count(F.lit(1)).over(before).alias("rows"))
    last = slim.filter((F.col("lines") <= rows * lines) & (F.col("rows") <= rows)).agg(F.max("_key").alias("last"))
    got = made.join(F.broadcast(last), F.col("_key") <= F.col("last")).select("doc_id", "label", "own", "size").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.own)))  # the sums' order decides their last bits
    own, labels = [np.frombuffer(r.own, np.float32).reshape(-1, len(OWN)) for r in got], [r.label for r in got]
    chain = fit(own, labels, lines=lines)
    if not got:
        return chain
    line_at = np.concatenate([[0], np.cumsum([len(o) for o in own])])
    p, _, _ = marginals(chain, with_neighbours(np.concatenate(own), line_at), line_at)
    share = weighted_share(p, np.concatenate([np.frombuffer(r.size, np.int64) for r in got]), line_at)
    return Chain(chain.weights, chain.moves, calibrated(share, np.array(labels, float)))


def scored(docs: DataFrame, chain: Chain, name: str = "score") -> DataFrame:
    """``docs`` with a quality score from 0 to 1.  Null and empty texts are one empty line; all rows and columns stay.

    A column of that name is replaced; only the text is an input.
    """
    docs = docs.drop(name)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in steps(big):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(document_scores(chain, batch.column("text")), pa.float64())], [*batch.schema.names, name])

    return mapped(docs, score, docs.selectExpr("*", f"0D AS {name}").schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    out = scored(docs, train(docs, labels)).withColumn("held_out", held_out())
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
