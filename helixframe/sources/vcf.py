"""VCF text as a DataFrame of raw columns, and back."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.errors import FormatError
from helixframe.functions.fields import once
from helixframe.sources.compressed import is_compressed_path, text_lines
from helixframe.sources.header import Header, parse_header

#: The eight fixed columns and FORMAT, as they are called here.
FIXED = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")
BCF_MAGIC = b"BCF\x02"


@dataclass(frozen=True)
class VariantSet:
    """Records and their header.

    ``df``: row_id (order), line (raw text), the fixed columns as text, samples (array of text), n_cols.  ``figures``: a
    DataFrame of one row with the counts of the operator that made it, if one did.
    """

    df: DataFrame
    header: Header
    figures: DataFrame | None = None

    def lines(self) -> DataFrame:
        return self.df.select("row_id", "line")

    def stats(self) -> dict[str, int]:
        """The operator's counts; this runs a job."""
        return {} if self.figures is None else {k: int(v or 0) for k, v in self.figures.first().asDict().items()}


def format_from_path(path: str) -> str:
    """The format in which a path is written: always VCF text."""
    return "vcf"


def detect_format_from_magic(head: bytes) -> bool:
    """Whether the bytes open a BCF file."""
    return head[:4] == BCF_MAGIC


def reject_bcf_output(path: str | None) -> None:
    if path and path.endswith(".bcf"):
        raise FormatError(f"BCF output is not supported: {path}; write VCF and convert it with another tool")


def parsed(lines: DataFrame) -> DataFrame:
    """Raw columns from (row_id, value); lines that start with # are left out, short ones have n_cols < 8.

    The samples are cut apart only where a plan reads them; n_cols counts them as one.
    """
    rows = lines.filter(~F.col("value").startswith("#")).withColumn("_p", F.split("value", "\t", len(FIXED) + 1))
    bare = lambda text: F.when(text.endswith("\r") | text.endswith("\n"), F.rtrim(text, F.lit("\r\n"))).otherwise(text)
    plain = [once(F.get("_p", F.lit(i))).alias(n) for i, n in enumerate(FIXED[:7])]
    last = [once(F.coalesce(bare(F.get("_p", F.lit(i))), F.lit(""))).alias(n) for i, n in enumerate(FIXED[7:], 7)]
    rest = F.get("_p", F.lit(len(FIXED)))
    samples = once(F.when(rest.isNull(), F.array().cast("array<string>")).otherwise(F.split(bare(rest), "\t")))
    return rows.select("row_id", F.col("value").alias("line"), *plain, *last, samples.alias("samples"), F.size("_p").alias("n_cols"))


def composed() -> Column:
    """A line from the columns; FORMAT and samples only where there are any."""
    tail = F.when(F.col("format") != "", F.concat(F.array("format"), F.col("samples"))).otherwise(F.array().cast("array<string>"))
    return F.concat_ws("\t", *FIXED[:8], tail)


def read_header(spark: SparkSession, path: str) -> Header:
    """The header of a file, from its first lines only."""
    text, n = text_lines(spark, path), 64
    files = sorted(spark.read.format("binaryFile").load(path).inputFiles())
    if len(files) > 1:
        # Spark reads large files first; the header is in the first by name
        text = text.filter(F.regexp_replace("file", r"^(\w+):/+", "$1:/") == re.sub(r"^(\w+):/+", r"\1:/", files[0]))
    while True:
        head = [r.value for r in text.take(n)]
        if head and detect_format_from_magic(head[0].encode("utf-8", "surrogateescape")):
            raise FormatError(f"{path} is BCF; convert it to VCF text first")
        if any(h.startswith("#CHROM") for h in head) or len(head) < n or not head[-1].startswith("#"):
            return parse_header(head)
        n *= 8


def read_vcf(spark: SparkSession, path: str) -> VariantSet:
    """A VCF text file (plain, ``.gz`` or ``.bgz``) or several with one header.  Lines end at \\n only."""
    if path.endswith(".bcf"):
        raise FormatError(f"{path} is BCF; convert it to VCF text first")
    order = F.struct("file", "block", F.monotonically_increasing_id().alias("n"))
    return VariantSet(parsed(text_lines(spark, path).select(order.alias("row_id"), "value")), read_header(spark, path))


def read_stdin(spark: SparkSession, stream=None, folder: str | None = None) -> VariantSet:
    """A VCF from a stream of bytes, which is first written as text to ``folder``.

    The folder must be one that all executors see; by default it is a new one below the session's ``spark.checkpoint.dir``,
    and in a local session without that below the system's temporary folder.  Its files stay until the session's end.
    """
    lines = (stream or sys.stdin.buffer).read().decode("utf-8", "replace").removesuffix("\n").split("\n")
    if folder is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local["):
            raise FormatError("reading a stream on a cluster needs a shared folder: pass it, or set spark.checkpoint.dir")
        folder = f"{(base or 'file://' + tempfile.gettempdir()).rstrip('/')}/stdin-{uuid.uuid4().hex}"
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(folder)
    return read_vcf(spark, folder)


def from_lines(spark: SparkSession, lines: Iterable[str]) -> VariantSet:
    """A VCF from lines in memory."""
    text = [x.removesuffix("\n") for x in lines]
    body = [(i, x) for i, x in enumerate(text) if not x.startswith("#")]
    return VariantSet(parsed(spark.createDataFrame(body, "row_id long, value string")), parse_header(text))


def from_text(spark: SparkSession, text: str) -> VariantSet:
    return from_lines(spark, text.removesuffix("\n").split("\n"))


def ordered(vs: VariantSet) -> DataFrame:
    by = [c for c in ("row_id", "alt_idx") if c in vs.df.columns]
    return vs.df.orderBy(*by).select("line")


def to_text(vs: VariantSet) -> str:
    """Header and records as one string, in order; for results that fit the driver."""
    return "\n".join([*vs.header.render(), *[r.line for r in ordered(vs).toLocalIterator()]]) + "\n"


def write_vcf(vs: VariantSet, path: str, single: bool = True, compression: str | None = None) -> None:
    """A folder of text: the header, then the records in order.  ``single`` makes one part file, else the header is the first of several.

    One part file is one task's work; large results want ``single=False``.  Without a ``compression`` the path's suffix
    decides between gzip and none.
    """
    reject_bcf_output(path)
    compression = compression or ("gzip" if is_compressed_path(path) else "none")
    spark = vs.df.sparkSession
    head = spark.createDataFrame([(i, line) for i, line in enumerate(vs.header.render())], "at long, value string")
    by = [c for c in ("row_id", "alt_idx") if c in vs.df.columns]
    body = vs.df.orderBy(*by).select(F.col("line").alias("value"))
    first = head.orderBy("at").select("value").coalesce(1)
    if not single:
        # the header as one row, in the first part file: a union keeps the order of its parts
        whole = spark.range(0, 1, 1, 1).select(F.lit("\n".join(vs.header.render())).alias("value"))
        whole.union(body).write.mode("overwrite").option("compression", compression).text(path)
        return
    first.union(body).coalesce(1).write.mode("overwrite").option("compression", compression).text(path)
