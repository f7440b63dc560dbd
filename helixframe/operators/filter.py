"""Selection of records by an expression."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions.fields import once
from helixframe.plans.compiler import compile_expr
from helixframe.plans.expression import parse_expr
from helixframe.sources.vcf import VariantSet


def filter_variants(vs: VariantSet, expression: str, invert: bool = False) -> VariantSet:
    """The records for which the expression holds (``invert``: doesn't hold), as their raw lines.

    Lines of fewer than eight columns count as read, but are neither kept nor counted as filtered out.
    """
    holds = compile_expr(parse_expr(expression), vs.header)
    keep = (F.col("n_cols") >= 8) & (~holds if invert else holds)
    # the verdict is a column of its own: the optimizer would spread its long expression over the plan as constraints
    df = vs.df.withColumn("_keep", once(keep))
    figures = df.agg(F.count(F.lit(1)).alias("input"), F.count_if("_keep").alias("output"), F.count_if((F.col("n_cols") >= 8) & ~F.col("_keep")).alias("filtered_out"))
    return VariantSet(df.filter("_keep").drop("_keep"), vs.header, figures)


def summary(stats: dict[str, int]) -> str:
    return f"filter: {stats['input']} in, {stats['output']} out ({stats['filtered_out']} filtered out)"
