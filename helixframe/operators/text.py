"""The operators over whole texts in memory."""

from __future__ import annotations

from pyspark.sql import SparkSession

from helixframe.operators.filter import filter_variants
from helixframe.operators.liftover import liftover
from helixframe.operators.normalize import normalize
from helixframe.sources.chain import chain_from_text
from helixframe.sources.vcf import from_text, to_text


def filter_text(spark: SparkSession, vcf: str, expression: str) -> str:
    return to_text(filter_variants(from_text(spark, vcf), expression))


def normalize_text(spark: SparkSession, vcf: str) -> str:
    """Alternatives are split; nothing is checked or aligned."""
    return to_text(normalize(from_text(spark, vcf), left_align=False, check_ref="ignore"))


def liftover_text(spark: SparkSession, vcf: str, chain: str) -> str:
    """Without a target reference; rejected records are dropped, and contig styles may differ."""
    lifted, _ = liftover(from_text(spark, vcf), chain_from_text(spark, chain), allow_contig_mismatch=True)
    return to_text(lifted)
