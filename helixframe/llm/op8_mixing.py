"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents with the same set of sources form a pattern; only the patterns' word totals reach the driver.  A min-cost flow
routes them to the sources' quotas: the n-th copy of a pattern's words costs more than the one before, so repetition is
used only where a quota needs it.  Documents are then taken in a seeded order until their pattern's flow is met.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, words, written

#: Fixed values of the query: weights in turn, share of all words, copies of a source at most.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Patterns of several sources that the driver's flow problem may have; more raises an error.
MOST_PATTERNS = 100_000
#: Hexadecimal digits of the seeded hash that number the ranges in which documents are ordered.
DIGITS = 3


def quotas(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """``total`` shared by weight; a share over ``most`` times its size stops there and the excess is shared again."""
    caps = [float(most * s) for s in sizes]
    order = sorted((i for i in range(len(sizes)) if weights[i] > 0), key=lambda i: (caps[i] / weights[i], i))
    left, heavy, level = float(total), float(sum(weights)), 0.0
    for i in order:
        level = left / heavy
        if caps[i] / weights[i] >= level:
            break
        left, heavy = left - caps[i], heavy - weights[i]
    return [min(c, w * level) for c, w in zip(caps, weights, strict=True)]


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """The flow on each arc (from, to, capacity, cost) of a cheapest maximum flow; costs are not negative."""
    to, room, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        for x, y, r, z in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(z)
    while True:
        far, via, queue, waits = [None] * n, [-1] * n, deque([source]), [False] * n
        far[source] = 0
        while queue:
            x = queue.popleft()
            waits[x] = False
            for e in out[x]:
                y = to[e]
                if room[e] > 0 and (far[y] is None or far[x] + cost[e] < far[y]):
                    far[y], via[y] = far[x] + cost[e], e
                    if not waits[y]:
                        waits[y] = True
                        queue.append(y)
        if far[sink] is None:
            return [room[2 * i + 1] for i in range(len(arcs))]
        path, y = [], sink
        while y != source:
            path.append(via[y])
            y = to[via[y] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push


@dataclass(frozen=True)
class Plan:
    copies: list[list[int]]
    """For each pattern the words that its first, second, ... copy gives."""
    flows: list[dict[int, int]]
    """For each pattern the words that go to each source, by its number."""


def route(patterns: list[tuple[tuple[int, ...], int]], targets: list[float], most: int) -> Plan:
    """patterns: (numbers of its sources, words).  Whole words are routed; copy k costs k.

    A source that shares no document takes its own pattern's words as its target says; the others make a flow problem.
    """
    shared = {s for members, _ in patterns if len(members) > 1 for s in members}
    number = {s: i for i, s in enumerate(sorted(shared))}
    copies, flows = [[0] * most for _ in patterns], [{} for _ in patterns]
    together = []
    for p, (members, words_) in enumerate(patterns):
        if len(members) == 1 and members[0] not in shared:
            n = min(int(targets[members[0]]), most * words_)
            copies[p] = [min(max(n - k * words_, 0), words_) for k in range(most)]
            flows[p] = {members[0]: n}
        elif members:
            together.append(p)
    if together:
        plan = _flow_route([(tuple(number[s] for s in patterns[p][0]), patterns[p][1]) for p in together], [targets[s] for s in sorted(shared)], most)
        names = sorted(shared)
        for p, c, f in zip(together, plan.copies, plan.flows, strict=True):
            copies[p], flows[p] = c, {names[s]: n for s, n in f.items()}
    return Plan(copies, flows)


def _flow_route(patterns: list[tuple[tuple[int, ...], int]], targets: list[float], most: int) -> Plan:
    np_, ns = len(patterns), len(targets)
    start, end = np_ + ns, np_ + ns + 1
    arcs = [(start, p, words_, k) for p, (_, words_) in enumerate(patterns) for k in range(1, most + 1)]
    links = [(p, s) for p, (members, _) in enumerate(patterns) for s in members]
    room = [most * w for _, w in patterns]
    arcs += [(p, np_ + s, room[p], 0) for p, s in links]
    arcs += [(np_ + s, end, int(t), 0) for s, t in enumerate(targets)]
    flow = min_cost_flow(np_ + ns + 2, arcs, start, end)
    flows: list[dict[int, int]] = [{} for _ in patterns]
    for (p, s), f in zip(links, flow[np_ * most :], strict=False):
        flows[p][s] = f
    return Plan([flow[p * most : (p + 1) * most] for p in range(np_)], flows)


def mix_to_targets(docs: DataFrame, members: Column, size: Column, targets_of, most: int = MOST, seed: str = "") -> tuple[DataFrame, DataFrame]:
    """(documents, sources): every row of ``docs`` with ``_size`` and ``_copies`` (0 to ``most``); the sources' figures.

    ``members`` is an array of source names (null: a source of its own, last in order); ``targets_of(sizes)`` gives the
    sources' targets from their word totals, in the order of their names' code points.  A source's total counts a
    document that it shares with others in full.  The seeded order is that of md5(seed || doc_id); rows with one doc_id
    stand by size.  The cut falls on the nearest whole document, so a pattern misses its flow by at most half of one
    document for each copy.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.withColumn("_size", size.cast("bigint")).withColumn("__mix_members", F.array_sort(F.array_distinct(members)))
    rows = rows.withColumn("__mix_pattern", F.to_json(F.struct(F.transform("__mix_members", lambda m: F.struct(m.alias("name"))).alias("m"))))
    totals = rows.groupBy("__mix_pattern").agg(F.first("__mix_members").alias("names"), F.sum("_size").alias("n"))
    totals = written(totals)
    if totals.filter(F.size("names") > 1).count() > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns of several sources")
    totals = totals.collect()
    names = sorted({m for r in totals for m in r.names}, key=lambda m: (m is None, m or ""))
    number = {m: i for i, m in enumerate(names)}
    sizes = [0] * len(names)
    for r in totals:
        for m in r.names:
            sizes[number[m]] += r.n
    targets = targets_of(sizes)
    totals.sort(key=lambda r: [number[m] for m in r.names])
    plan = route([(tuple(number[m] for m in r.names), r.n) for r in totals], targets, most)

    of_pattern = spark.createDataFrame(pa.table({"__mix_pattern": pa.array([r["__mix_pattern"] for r in totals], pa.string()), "__mix_takes": pa.array(plan.copies, pa.list_(pa.int64()))}))
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("__mix_order", order).withColumn("__mix_range", F.substring("__mix_order", 1, DIGITS))
    key = ["__mix_pattern", "__mix_range"]
    # ranges of the seeded order: at most 16**DIGITS for each pattern
    ranges = rows.groupBy(*key).agg(F.sum("_size").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy("__mix_pattern").orderBy("__mix_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*key, ahead.alias("__mix_ahead"))
    inside = Window.partitionBy(*key).orderBy("__mix_order", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__mix_before", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    rows = rows.join(ranges, key).join(F.broadcast(of_pattern) if len(totals) <= MOST_PATTERNS else of_pattern, "__mix_pattern")
    twice = 2 * (F.col("__mix_ahead") + F.col("__mix_before")) + F.col("_size")
    copies = F.aggregate("__mix_takes", F.lit(0), lambda a, t: a + F.when(twice <= 2 * t, 1).otherwise(0))
    rows = rows.withColumn("_copies", copies).drop("__mix_members", "__mix_pattern", "__mix_order", "__mix_range", "__mix_before", "__mix_ahead", "__mix_takes")
    figures = spark.createDataFrame(pa.table({"_source": pa.array(names, pa.string()), "source_size": pa.array(sizes, pa.int64()), "target": pa.array(targets, pa.float64())}))
    return rows, figures


def default_targets(sizes: list[int]) -> list[float]:
    return quotas(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))], SHARE * sum(sizes), MOST)


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size"))
    rows, figures = mix_to_targets(docs, F.array("source"), F.col("size"), default_targets)
    rows = rows.join(F.broadcast(figures), rows["source"].eqNullSafe(figures["_source"]))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_copies")).alias("taken"))


ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nr FROM d GROUP BY source),
w AS (SELECT *, CASE (nr - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (SELECT sum(source_size) FROM w) AS total, (SELECT sum(weight) FROM w) AS heavy FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER before, 0)) / (heavy - coalesce(sum(weight) OVER before, 0)) AS level FROM c
      WINDOW before AS (ORDER BY cap / weight, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, (cap / weight, nr)) AS level FROM l WHERE cap / weight >= level),
t AS (SELECT source, source_size, least(cap, weight * f.level) AS target FROM c, f),
q AS (SELECT *, least(CAST(floor(target) AS BIGINT), source_size) AS one FROM t),
r AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.one, CAST(floor(q.target) AS BIGINT) - q.one AS two,
             2 * coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size AS twice
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(size * (CAST(twice <= 2 * one AS BIGINT) + CAST(twice <= 2 * two AS BIGINT)) AS BIGINT) AS taken FROM r
"""

QUERIES = {"op8_mixing": op8_mixing}
ORACLES = {"op8_mixing": ORACLE}
