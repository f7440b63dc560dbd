"""Reference sequences as overlapping chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.errors import FormatError

CHUNK, OVERLAP = 1 << 16, 1 << 12
#: Lines of a bin in which lines and contigs meet; bins, and contigs, up to which the contigs are broadcast.
LINES, SMALL_INDEX = 1 << 16, 50_000
#: Bases up to which a reference is broadcast.
SMALL = 64 << 20


@dataclass(frozen=True)
class Reference:
    """``chunks``: contig, chunk, first (0-based place of the first base), seq: CHUNK bases with OVERLAP more on both sides.

    Bases are binary, so a cut goes straight to its place instead of counting characters from the chunk's start.
    """

    chunks: DataFrame
    lengths: dict[str, int]
    chunk: int = CHUNK
    overlap: int = OVERLAP

    @property
    def small(self) -> bool:
        return sum(self.lengths.values()) <= SMALL

    def joined(self, df: DataFrame, place: Column, contig: str = "chrom") -> DataFrame:
        """``df`` with _first and _seq of the chunk around the 0-based ``place``; null for unknown contigs and past their end."""
        side = self.chunks.select(F.col("contig").alias("_contig"), F.col("chunk").alias("_chunk"), F.col("first").alias("_first"), F.col("seq").alias("_seq"))
        at = F.floor(place / self.chunk)
        return df.join(F.broadcast(side) if self.small else side, (F.col(contig) == F.col("_contig")) & (at == F.col("_chunk")), "left").drop("_contig", "_chunk")

    def length_of(self, contig: Column) -> Column:
        """Length of a contig, null if it isn't there; the index, which the driver holds, names them all."""
        known = F.create_map(*[F.lit(x) for kv in self.lengths.items() for x in kv]) if self.lengths else F.lit(None).cast("map<string,int>")
        return F.try_element_at(known, contig).cast("bigint")

    def stretch(self, df: DataFrame, start: Column, end: Column, key: list[str], name: str, contig: str = "chrom") -> DataFrame:
        """``df`` with the bases [start, end) as ``name``, of any length: chunks are joined one by one and put together."""
        rows = df.withColumn("_s", start).withColumn("_e", F.greatest(end, start))
        parts = rows.select(*key, F.col(contig).alias("_c"), "_s", "_e", F.explode(F.sequence(F.floor(F.col("_s") / self.chunk), F.floor(F.greatest(F.col("_e") - 1, F.col("_s")) / self.chunk))).alias("_k"))
        side = self.chunks.select(F.col("contig").alias("_contig"), F.col("chunk").alias("_chunk"), "first", "seq")
        parts = parts.join(F.broadcast(side) if self.small else side, (F.col("_c") == F.col("_contig")) & (F.col("_k") == F.col("_chunk")))
        low, high = F.greatest("_s", F.col("_k") * self.chunk), F.least("_e", (F.col("_k") + 1) * self.chunk)
        piece = F.substring("seq", (low - F.col("first") + 1).cast("int"), (high - low).cast("int")).cast("string")
        whole = parts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_k", piece.alias("p")))).alias("_parts"))
        whole = whole.select(*[F.col(k).alias(f"_{k}") for k in key], F.array_join(F.transform("_parts", lambda x: x["p"]), "").alias(name))
        on = [rows[k] == whole[f"_{k}"] for k in key]
        return rows.join(whole, on, "left").drop("_s", "_e", *[f"_{k}" for k in key])


def _chunked(lines: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunks from (contig, start, bases)."""
    end = F.col("start") + F.char_length("bases")
    low = F.floor(F.greatest(F.col("start") - overlap, F.lit(0)) / chunk)
    spread = lines.filter("bases <> ''").select("contig", "start", "bases", F.explode(F.sequence(low, F.floor((end - 1 + overlap) / chunk))).alias("chunk"))
    first, last = F.greatest(F.col("chunk") * chunk - overlap, F.lit(0)), (F.col("chunk") + 1) * chunk + overlap
    cut_from = F.greatest(first, F.col("start"))
    piece = F.substring("bases", (cut_from - F.col("start") + 1).cast("int"), (F.least(last, end) - cut_from).cast("int"))
    got = spread.select("contig", "chunk", first.alias("first"), F.col("start"), piece.alias("p")).filter("p <> ''")
    grouped = got.groupBy("contig", "chunk", "first").agg(F.sort_array(F.collect_list(F.struct("start", "p"))).alias("ps"))
    return grouped.select("contig", "chunk", "first", F.array_join(F.transform("ps", lambda x: x["p"]), "").cast("binary").alias("seq"))


def reference_from_dict(spark: SparkSession, sequences: dict[str, str], chunk: int = CHUNK, overlap: int = OVERLAP) -> Reference:
    rows = [(k, i, v[i : i + 60]) for k, v in sequences.items() for i in range(0, len(v), 60)]
    return Reference(_chunked(spark.createDataFrame(rows, "contig string, start long, bases string"), chunk, overlap), {k: len(v) for k, v in sequences.items()}, chunk, overlap)


def numbered_lines(text: DataFrame) -> DataFrame:
    """(nr, bases): the lines of one file with their numbers from 0.

    A line's number is its place in its split and the number of lines in the splits before; only the splits' counts come to
    the driver, one for each part of the file that a task reads.
    """
    rows = text.select(F.col("value").alias("bases"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    splits = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first")).orderBy("_block").collect()
    shifts, before = {}, 0
    for split in splits:
        shifts[split["_block"]] = before - split["first"]
        before += split["n"]
    if not shifts:
        return rows.select(F.col("_id").alias("nr"), "bases")
    shift = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for pair in shifts.items() for x in pair]), F.col("_block"))
    return rows.select((F.col("_id") + shift).alias("nr"), "bases")


def read_fasta(spark: SparkSession, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Reference:
    """A FASTA file with its ``.fai`` beside it.

    The index tells how many lines each contig has, so a line's number alone gives its contig and place; lines and contigs
    meet in bins of line numbers.
    """
    try:
        index = [r.value.split("\t") for r in spark.read.text(path + ".fai").collect()]
    except Exception as e:
        raise FormatError(f"reference index not found: {path}.fai; create it with samtools faidx") from e
    rows, at = [], 0
    for name, length, _, width, _ in index:
        # the line of the name, then those of the bases
        n = -(-int(length) // max(1, int(width)))
        rows.append((name, at + 1, at + 1 + n, int(width)))
        at += 1 + n
    contigs = spark.createDataFrame(rows, "contig string, _from long, _to long, width long")
    contigs = contigs.filter("_to > _from").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_from") / LINES), F.floor((F.col("_to") - 1) / LINES))))
    lines = numbered_lines(spark.read.option("lineSep", "\n").text(path)).withColumn("_line_bin", F.floor(F.col("nr") / LINES))
    inside = (F.col("_line_bin") == F.col("_bin")) & (F.col("nr") >= F.col("_from")) & (F.col("nr") < F.col("_to"))
    mine = lines.join(F.broadcast(contigs) if at <= SMALL_INDEX * LINES and len(rows) <= SMALL_INDEX else contigs, inside)
    placed = mine.select("contig", ((F.col("nr") - F.col("_from")) * F.col("width")).alias("start"), F.rtrim("bases").alias("bases"))
    return Reference(_chunked(placed, chunk, overlap), {r[0]: int(r[1]) for r in index}, chunk, overlap)


def contig_sequences(reference: Reference) -> DataFrame:
    """(contig, seq): whole contigs; for small references."""
    own = F.substring("seq", (F.col("chunk") * reference.chunk - F.col("first") + 1).cast("int"), reference.chunk).cast("string")
    ordered = F.sort_array(F.collect_list(F.struct("chunk", own.alias("p"))))
    return reference.chunks.groupBy("contig").agg(F.array_join(F.transform(ordered, lambda x: x["p"]), "").alias("seq"))


__all__ = ["Reference", "contig_sequences", "read_fasta", "reference_from_dict"]
