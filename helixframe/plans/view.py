"""A deterministic variant view of the ``lineitem`` table, as raw VCF lines.

One SQL text, in functions that Spark and other engines share, gives the lines and the figures they were printed from; so
the operators parse real lines while checks can work from the figures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.fields import once
from helixframe.sources.chain import ChainIndex, chain_from_text
from helixframe.sources.fasta import Reference, reference_from_dict
from helixframe.sources.header import Header, parse_header
from helixframe.sources.vcf import VariantSet, parsed

#: What the view reads of ``lineitem``.
COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
UNITS = ("AC", "ACGT", "A", "TTG", "CA", "G", "CATG", "T", "GGC", "AT")
#: A genome of 400 bases with many short repeats.
GENOME = "".join((UNITS[i % 10] * (3 + i * 7 % 5)) + "GATTC"[i % 5] for i in range(60))[:400]

HEADER_LINES = (
    "##fileformat=VCFv4.2",
    '##FILTER=<ID=PASS,Description="All filters passed">',
    '##FILTER=<ID=LowQual,Description="Low quality">',
    '##FILTER=<ID=DP5,Description="Depth below five">',
    *[f"##contig=<ID=chr{i},length=400>" for i in range(1, 5)],
    '##INFO=<ID=AF,Number=A,Type=Float,Description="Allele frequency">',
    '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">',
    '##INFO=<ID=AD,Number=R,Type=Integer,Description="Depth of each allele">',
    '##INFO=<ID=PL,Number=G,Type=Integer,Description="Likelihood of each genotype">',
    '##INFO=<ID=DB,Number=0,Type=Flag,Description="In a database">',
    '##INFO=<ID=GENE,Number=.,Type=String,Description="Genes">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Depth of each allele">',
    '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Genotype quality">',
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1",
)

CHAIN_TEXT = """chain 1 chr1 400 + 0 400 chr1 600 + 100 505 1
200 5 10
195

chain 2 chr2 400 + 50 350 chr9 500 - 20 320 2
100 10 10
190

chain 3 chr3 400 + 100 300 chr3 400 + 100 300 3
200
"""


def _s(x: str) -> str:
    return f"cast({x} as string)"


VIEW = f"""
SELECT *, concat_ws(chr(9), chrom, {_s('pos')}, '.', ref, alt, qual, filter, info, 'GT:AD:GQ', concat_ws(':', '0/1', ad, gq)) AS line FROM (
SELECT *, concat_ws(';', CASE WHEN has_af = 1 THEN 'AF=' || af ELSE CASE WHEN has_af = 0 THEN 'AF=.' END END, 'DP=' || {_s('10 + qty')}, 'AD=' || ad, 'PL=' || pl,
                    CASE WHEN nr % 2 = 0 THEN 'DB' END, 'GENE=' || gene, 'XX=' || {_s('nr')}) AS info FROM (
SELECT *,
  CASE WHEN two = 1 THEN '0.' || lpad({_s('d')}, 2, '0') || ',0.' || {_s('d + 20')} ELSE '0.' || lpad({_s('d')}, 2, '0') END AS af,
  concat_ws(',', {_s('qty')}, {_s('qty + d')}, CASE WHEN two = 1 THEN {_s('qty + 2 * d')} END) AS ad,
  concat_ws(',', '0', {_s('10 + d')}, {_s('20 + d')}, CASE WHEN two = 1 THEN {_s('30 + d')} END, CASE WHEN two = 1 THEN {_s('40 + d')} END, CASE WHEN two = 1 THEN {_s('50 + d')} END) AS pl,
  CASE WHEN part % 3 = 0 THEN 'G1' ELSE CASE WHEN part % 3 = 1 THEN 'G1,G2' ELSE 'G3' END END AS gene,
  CASE WHEN nr = 3 THEN '.' ELSE {_s('qty')} END AS gq,
  CASE WHEN nr = 7 THEN '.' ELSE {_s('qty')} END AS qual,
  CASE WHEN flag = 'R' THEN 'PASS' ELSE CASE WHEN flag = 'A' THEN 'LowQual' ELSE CASE WHEN status = 'O' THEN 'LowQual;DP5' ELSE '.' END END END AS filter,
  CASE WHEN t = 3 THEN substr(genome, place, 1 + n) ELSE CASE WHEN t < 2 AND part % 17 = 5 THEN translate(base, 'ACGT', 'TACG') ELSE base END END AS ref,
  CASE WHEN t < 2 THEN one ELSE CASE WHEN t = 2 THEN base || substr(genome, place + 1, n) ELSE CASE WHEN t = 3 THEN base ELSE CASE WHEN t = 4 THEN one || ',' || other
       ELSE CASE WHEN t = 5 THEN '<DEL>' ELSE base || substr(genome, place + 1, n) || ',' || one END END END END END AS alt,
  CASE WHEN okey % 97 = 0 THEN place + 1000 ELSE place END AS pos FROM (
SELECT *, substr(genome, place, 1) AS base, translate(substr(genome, place, 1), 'ACGT', 'CGTA') AS one, translate(substr(genome, place, 1), 'ACGT', 'GTAC') AS other,
  CASE WHEN t = 4 OR t = 6 THEN 1 ELSE 0 END AS two FROM (
SELECT concat('chr', {_s('1 + l_suppkey % 4')}) AS chrom, 1 + (l_orderkey * 37 + l_linenumber * 11) % 380 AS place, cast(1 + l_partkey % 3 AS int) AS n, l_partkey % 7 AS t, l_partkey AS part,
  l_orderkey AS okey, l_linenumber AS nr, cast(l_quantity AS int) AS qty, cast(round(l_discount * 100) AS int) AS d, l_returnflag AS flag, l_linestatus AS status,
  CASE WHEN l_orderkey % 11 = 3 THEN 0 ELSE CASE WHEN l_orderkey % 11 = 4 THEN 2 ELSE 1 END END AS has_af, '{GENOME}' AS genome FROM lineitem) a) b) c) d
"""


def header() -> Header:
    return parse_header(HEADER_LINES)


def lines_of(spark: SparkSession, lineitem: DataFrame) -> DataFrame:
    """The view over ``lineitem``, with its row_id."""
    return spark.sql(VIEW.replace("FROM lineitem", "FROM {lineitem}").replace("SELECT concat('chr'", "SELECT row_id, concat('chr'"), lineitem=lineitem)


def variants(spark: SparkSession, sf_dir: str) -> VariantSet:
    """The view's lines as a text source gives them."""
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*COLUMNS, F.monotonically_increasing_id().alias("row_id"))
    # a table of one row group is read by one task; its narrow rows are dealt out before they become lines
    dealt = table.repartition(spark.sparkContext.defaultParallelism, "row_id")
    return VariantSet(parsed(lines_of(spark, dealt).select("row_id", once(F.col("line")).alias("value"))), header())


def reference(spark: SparkSession) -> Reference:
    return reference_from_dict(spark, {f"chr{i}": GENOME for i in (1, 2, 3)}, chunk=1024, overlap=512)


def chain(spark: SparkSession) -> ChainIndex:
    return chain_from_text(spark, CHAIN_TEXT)


def flipped(bases: str) -> str:
    return bases[::-1].translate(str.maketrans("ACGT", "TGCA"))


def target_sequences() -> dict[str, str]:
    """What the chain makes of the genome; chr3 is left out on purpose."""
    one = "N" * 100 + GENOME[:200] + "N" * 10 + GENOME[205:400] + "N" * 95
    nine = "N" * 180 + flipped(GENOME[160:350]) + "N" * 10 + flipped(GENOME[50:150]) + "N" * 20
    return {"chr1": one, "chr9": nine}


def target(spark: SparkSession) -> Reference:
    return reference_from_dict(spark, target_sequences(), chunk=1024, overlap=512)
