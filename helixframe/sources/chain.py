"""Chain files: aligned blocks between two genome builds."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.errors import FormatError
from helixframe.sources.compressed import text_lines

#: Public chain files by build.
KNOWN_CHAINS = (
    ("hg19 -> hg38", "https://hgdownload.soe.ucsc.edu/goldenPath/hg19/liftOver/hg19ToHg38.over.chain.gz"),
    ("hg38 -> hg19", "https://hgdownload.soe.ucsc.edu/goldenPath/hg38/liftOver/hg38ToHg19.over.chain.gz"),
    ("hg38 -> T2T-CHM13", "https://hgdownload.soe.ucsc.edu/goldenPath/hg38/liftOver/hg38ToHs1.over.chain.gz"),
    ("T2T-CHM13 -> hg38", "https://hgdownload.soe.ucsc.edu/goldenPath/hs1/liftOver/hs1ToHg38.over.chain.gz"),
)
#: Width of the bins in which blocks and positions meet.
BIN = 1 << 16
SCHEMA = "src_chrom string, src_start long, src_end long, tgt_chrom string, tgt_start long, tgt_end long, tgt_strand string, tgt_size long"


@dataclass(frozen=True)
class Block:
    """An aligned stretch without gaps, 0-based and half-open; the target is on its forward strand."""

    src_chrom: str
    src_start: int
    src_end: int
    tgt_chrom: str
    tgt_start: int
    tgt_end: int
    tgt_strand: str
    tgt_size: int


def parse_chain(lines: Iterable[str]) -> list[Block]:
    """Blocks in the order of the file.  A chain ends at an empty line or at a data line without gaps."""
    blocks: list[Block] = []
    chain = None
    for nr, raw in enumerate(lines, 1):
        line = raw.strip()
        if not line:
            chain = None
        elif line.startswith("chain "):
            f = line.split()[1:]
            if len(f) < 11:
                raise FormatError(f"chain header on line {nr} has {len(f)} fields, 11 are needed")
            if f[3] != "+":
                raise FormatError(f"chain header on line {nr}: the source strand must be +")
            try:
                chain = {"src": f[1], "s": int(f[4]), "tgt": f[6], "size": int(f[7]), "strand": f[8], "t": int(f[9])}
            except ValueError as e:
                raise FormatError(f"chain header on line {nr}: {e}") from e
        elif not line.startswith("#") and chain:
            try:
                numbers = [int(x) for x in line.split()]
            except ValueError as e:
                raise FormatError(f"chain data on line {nr}: {e}") from e
            n, s, t = numbers[0], chain["s"], chain["t"]
            low, high = (chain["size"] - t - n, chain["size"] - t) if chain["strand"] == "-" else (t, t + n)
            if low < 0:
                raise FormatError(f"chain data on line {nr}: the block leaves the target")
            blocks.append(Block(chain["src"], s, s + n, chain["tgt"], low, high, chain["strand"], chain["size"]))
            if len(numbers) >= 3:
                chain["s"], chain["t"] = s + n + numbers[1], t + n + numbers[2]
            else:
                chain = None
    return blocks


@dataclass(frozen=True)
class ChainIndex:
    """``blocks`` with eff_end: a position belongs to the last block that starts at or before it, if that reaches it."""

    blocks: DataFrame
    contigs: tuple[str, ...]
    number: int

    def __len__(self) -> int:
        return self.number

    def is_empty(self) -> bool:
        return self.number == 0

    def source_contigs(self) -> tuple[str, ...]:
        return self.contigs

    def binned(self) -> DataFrame:
        """Blocks once for each bin that they reach; those that others hide wholly are left out."""
        some = self.blocks.filter("eff_end > src_start")
        return some.withColumn("bin", F.explode(F.sequence(F.floor(F.col("src_start") / BIN), F.floor((F.col("eff_end") - 1) / BIN))))


def chain_index(spark: SparkSession, blocks: list[Block]) -> ChainIndex:
    """Of blocks with one start the last in the file counts."""
    rows = spark.createDataFrame([(i, *astuple(b)) for i, b in enumerate(blocks)], "nr long, " + SCHEMA)
    same = Window.partitionBy("src_chrom", "src_start").orderBy(F.col("nr").desc())
    rows = rows.withColumn("_r", F.row_number().over(same)).filter("_r = 1").drop("_r")
    following = F.lead("src_start").over(Window.partitionBy("src_chrom").orderBy("src_start"))
    contigs = tuple(dict.fromkeys(b.src_chrom for b in blocks))
    return ChainIndex(rows.withColumn("eff_end", F.least("src_end", following)).drop("nr"), contigs, len(blocks))


def read_chain(spark: SparkSession, path: str) -> ChainIndex:
    """A chain file, plain or gzip; its grammar depends on the order of lines, so the driver reads it line by line."""
    lines = (r.value for r in text_lines(spark, path).coalesce(1).toLocalIterator())
    return chain_index(spark, parse_chain(lines))


def chain_from_text(spark: SparkSession, text: str) -> ChainIndex:
    return chain_index(spark, parse_chain(text.split("\n")))
