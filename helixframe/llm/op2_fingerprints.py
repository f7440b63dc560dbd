"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's shingles.  Sketches of parts merge
into the sketch of the whole (``merge``, ``merge_sketches``), and two sketches estimate resemblance, containment and
distinct shingle counts.  A text of fewer words than a shingle has its whole word sequence as its one shingle; a text
without words (null and empty included) has the empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, let, words, written

K, SHINGLE = 128, 5


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """array<bigint>: the k smallest distinct shingle hashes, ascending."""

    def shingles(h: Column) -> Column:
        n = F.size(h)
        windows = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(shingle)]))
        short = F.array(F.aggregate(h, F.lit(0).cast("bigint"), lambda a, x: F.xxhash64(a, x)))
        return F.when(n >= shingle, windows).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))

    hashes = let(F.transform(words(text), lambda w: F.xxhash64(w)), shingles)
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1; exact when the union has at most k shingles.  Two empty sketches: 1."""

    def likeness(u: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(a, b), u))
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(both / F.size(u))

    return F.when(a == b, F.lit(1.0)).otherwise(let(merge(a, b, k), likeness))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: the size below k, else (k-1) over the k-th hash's share of the range."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: J (|A|+|B|) / ((1+J) |A|), at most 1; 1 for an empty a."""
    j = resemblance(a, b, k)
    n, m = distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (n + m) / ((1 + j) * n)))


def merge_sketches(df: DataFrame, by: list[str], col: str, k: int = K) -> DataFrame:
    """One sketch for each group of rows.

    A group's rows are never gathered: values are made distinct, then a window limit keeps k of a group in each task
    before and after the shuffle.  Groups of only empty sketches get an empty one.
    """
    values = df.select(*by, F.explode_outer(col).alias("_v")).distinct()
    ranked = values.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_last()))).filter(F.col("_r") <= k)
    return ranked.groupBy(*by).agg(F.sort_array(F.collect_list("_v")).alias(col))


def text_form(a: Column) -> Column:
    """A sketch as a string: 16 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def ranged(docs: DataFrame, per_bucket: int, most_buckets: int) -> DataFrame:
    """``docs`` with ``_b``, the range of its doc_id: an array that orders ranges as their ids, the least one for null.

    Ids fall into equal ranges.  A range that holds many times its share is cut again into equal parts of what its ids
    span, which appends a number to the array, until none does; so ids may be spread in any way.  Each cut makes a range
    eight times narrower at least, and only a range of one id can stay large.
    """
    most_buckets = max(1, most_buckets)
    (n,) = docs.agg(F.count(F.lit(1))).first()
    share = max(1, per_bucket, -(-n // most_buckets))
    # the first cut is that of one range that holds everything
    docs = docs.withColumn("_b", F.when(F.col("doc_id").isNull(), F.array(F.lit(-1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint"))))
    big = 1
    while True:
        large = docs.filter(F.col("doc_id").isNotNull()).groupBy("_b").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"))
        large = written(large.filter((F.col("n") > big * share) & (F.col("_high") > F.col("_low"))))
        if large.isEmpty():
            return docs
        # at most n / share rows, so the table of the large ranges may be broadcast
        wide = F.expr(f"cast((cast(_high as decimal(20,0)) - cast(_low as decimal(20,0))) div ceil(n / {share}) + 1 as decimal(20,0))")
        large = large.select(F.col("_b").alias("_large"), wide.alias("_wide"), F.col("_low").cast("decimal(20,0)").alias("_low"))
        docs = docs.join(F.broadcast(large), (F.col("_b") == F.col("_large")) & F.col("doc_id").isNotNull(), "left")
        part = F.expr("cast((cast(doc_id as decimal(20,0)) - _low) div _wide as bigint)")
        docs = docs.withColumn("_b", F.when(F.col("_large").isNull(), F.col("_b")).otherwise(F.concat("_b", F.array(part)))).drop("_large", "_low", "_wide")
        big = 8


def with_next(docs: DataFrame, per_bucket: int = 512, most_buckets: int = 1 << 18) -> DataFrame:
    """Every row with the row that follows in descending doc_id order (after the last one the first) as struct ``next``.

    Ids fall into ranges of bounded size (``ranged``); a range also gets a copy of the row that opens the next range that
    has rows, so one shuffle by range suffices and no task sorts the whole table.  The tables of ranges have some
    ``most_buckets`` rows of a few integers for each cut, which bounds their broadcasts.  Rows of one doc_id stand in the order
    of their text; rows without a doc_id come last.  Columns of ``docs`` other than doc_id and text are not kept.
    """
    docs = docs.select("doc_id", "text")
    rows = ranged(docs, per_bucket, most_buckets)
    ranges = rows.select(F.col("doc_id").alias("id"), F.col("_b").alias("b")).groupBy("b").agg(F.max("id").alias("opens"))
    order = Window.orderBy(F.col("b").desc())
    ranges = ranges.select("opens", F.col("b").alias("own"), F.lag("b").over(order).alias("before"), F.min("b").over(Window.partitionBy()).alias("lowest"))
    ranges = ranges.select(F.col("opens").alias("_opens"), F.col("own").alias("_own"), F.coalesce("before", "lowest").alias("_before"))
    rows = rows.join(F.broadcast(ranges), (rows["_b"] == ranges["_own"]) & rows["doc_id"].eqNullSafe(ranges["_opens"]), "left")
    # a copy sorts after the range's own rows: it only serves the last of them
    places = F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("copy")), F.struct(F.col("_before").alias("b"), F.lit(1).alias("copy")))
    rows = rows.select("doc_id", "text", F.explode(F.filter(places, lambda p: p["b"].isNotNull())).alias("_at"))
    return rows.select("doc_id", "text", F.col("_at.b").alias("_b"), F.col("_at.copy").alias("_copy"))


def fingerprint_documents(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Sketches of every text and of its edited text, and how alike they and the next document's are.

    The edited text replaces the last floor(n/2) code points by the first as many (or all) of the next document in
    descending doc_id order.  A null text counts as empty; a table of one document has itself as its next; an empty
    table gives no rows.  Repeated rows are all kept.
    """
    rows = with_next(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("sketch", sketch(F.col("text"), k, shingle))
    order = Window.partitionBy("_b").orderBy("_copy", F.col("doc_id").desc_nulls_last(), "text")
    rows = rows.select("doc_id", "text", "sketch", "_copy", F.lead("text").over(order).alias("next_text"), F.lead("sketch").over(order).alias("next_sketch"))
    rows = rows.filter(F.col("_copy") == 0)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited"), k, shingle))
    return rows.select(
        "doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sketch", "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("sketch"), k).alias("n_shingles"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_documents(documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", "edited_sha256", text_form(F.col("sketch")).alias("fingerprint"), text_form(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next", "n_shingles")


QUERIES = {"op2_fingerprints": op2_fingerprints}
