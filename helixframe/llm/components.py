"""Connected components of a table of links, by alternating large-star and small-star steps.

Neither links nor components leave the executors; every round is written to the shared folder, which cuts its lineage.
A table of at most AT_ONCE links is settled by one task instead: a round costs the driver a dozen stages, whose tasks it
keeps in memory, whatever the number of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, mapped, written

#: Links (16 bytes each) up to which one task has them all.
AT_ONCE = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of each one's component) of links between a and b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[label]


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in roots(*(np.concatenate(x) for x in zip(*held, strict=True)))], ["node", "root"])


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v, least): for each row (u, v) the smallest of u and its v's.  Minima are taken before the shuffle."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("least"))
    return pairs.join(least, F.col("u") == F.col("_u")).select("u", "v", "least")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v")


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    star = _star(down)
    return star.select(F.col("v").alias("u"), F.col("least").alias("v")).union(star.select("u", F.col("least").alias("v"))).filter("u <> v")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has a link to another one; the root is its component's smallest node."""
    spark = edges.sparkSession
    now = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    if now.count() <= AT_ONCE:
        return written(mapped(now.coalesce(1), _at_once, "node long, root long"))
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen, before = state, now
        now = written(small_star(large_star(now).distinct()).distinct())
        drop_table(spark, before)
