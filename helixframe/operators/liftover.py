"""Liftover: positions and alleles carried from one genome build to another."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.errors import FormatError, VariantError
from helixframe.functions.bases import reverse_complement
from helixframe.functions.fields import canonical_number, rewritten_info, rewritten_samples, settled, with_keys
from helixframe.functions.numbers import to_long
from helixframe.sources.chain import BIN, ChainIndex
from helixframe.sources.fasta import Reference, read_fasta
from helixframe.sources.header import Header
from helixframe.sources.vcf import VariantSet, composed

log = logging.getLogger(__name__)
#: Blocks up to which the binned table is broadcast.
SMALL_CHAIN = 50_000


def kept_allele(alt: Column) -> Column:
    """Alternatives that have no bases to complement: symbolic ones, breakends and ``*``."""
    return alt.startswith("<") | alt.contains("[") | alt.contains("]") | (alt == "*")


def check_contigs(header: Header, chain: ChainIndex, allow: bool) -> None:
    """Refuses (or, if allowed, warns of) a header and a chain that share no contig and differ in the ``chr`` prefix."""
    mine, theirs = list(header.contigs), sorted(chain.source_contigs())
    if not mine or not theirs or set(mine) & set(theirs) or mine[0].startswith("chr") == theirs[0].startswith("chr"):
        return
    text = f"no contig of the header ({mine[0]}, ...) is a source of the chain ({theirs[0]}, ...): one side names them with chr, the other without; rename them, or pass allow_contig_mismatch=True, which rejects all records"
    if not allow:
        raise VariantError(text)
    log.warning(text)


def located(rows: DataFrame, chain: ChainIndex) -> DataFrame:
    """Rows with the block that holds their position (column _p0), or nulls.  Blocks meet rows in bins, one block at most."""
    blocks = chain.binned()
    if chain.number <= SMALL_CHAIN:
        blocks = F.broadcast(blocks)
    inside = (F.col("_p0") >= F.col("src_start")) & (F.col("_p0") < F.col("eff_end"))
    return rows.join(blocks, (F.col("chrom") == F.col("src_chrom")) & (F.floor(F.col("_p0") / BIN) == F.col("bin")) & inside, "left")


def with_source(info: Column, chrom: Column, pos: Column) -> Column:
    """INFO with the source's contig and place; entries of these names are replaced."""
    old = F.filter(F.split(info, ";"), lambda e: ~F.substring_index(e, "=", 1).isin("SRC_CONTIG", "SRC_POS") & ~e.isin(".", ""))
    # the place is a 32-bit number
    return F.array_join(F.concat(old, F.array(F.concat(F.lit("SRC_CONTIG="), chrom), F.concat(F.lit("SRC_POS="), F.expr("cast((_p + 2147483648) % 4294967296 - 2147483648 as string)")))), ";")


def liftover(
    vs: VariantSet, chain: ChainIndex, target_ref: Reference | str | None = None, fix_swapped_ref: bool = True, write_src_coords: bool = False, allow_contig_mismatch: bool = False, source_ref: Reference | None = None, reserialize: bool = True
) -> tuple[VariantSet, VariantSet]:
    """(lifted, rejects).  Rejects are the original records; both keep the order of the input.

    Only the position decides the block.  On the reverse strand alleles are complemented, or the record is rejected if
    ``fix_swapped_ref`` is off.  With a target reference the whole lifted REF must match it, unless an alternative is
    symbolic; one given as a path that can't be opened is warned of, and nothing is checked.  The source reference is
    accepted and not read.  Lines of fewer than eight columns are left out.
    """
    check_contigs(vs.header, chain, allow_contig_mismatch)
    if isinstance(target_ref, str):
        try:
            target_ref = read_fasta(vs.df.sparkSession, target_ref)
        except FormatError as e:
            log.warning("the lifted alleles are not checked: %s", e)
            target_ref = None
    header = vs.header
    if write_src_coords:
        header = header.with_info("SRC_CONTIG", "1", "String", "Source contig before liftover").with_info("SRC_POS", "1", "Integer", "Source position (1-based) before liftover")
    place = to_long(F.col("pos"))
    rows = with_keys(vs.df.filter("n_cols >= 8"), _p=F.when(place >= 1, place)).withColumn("_p0", F.col("_p") - 1)
    rows = located(rows, chain)
    offset, n = F.col("_p0") - F.col("src_start"), F.char_length("ref")
    reverse = F.col("tgt_strand") == "-"
    start = F.when(reverse, F.col("tgt_end") - offset - n).otherwise(F.col("tgt_start") + offset)
    rows = with_keys(rows, _t0=start).withColumn("_rev", F.coalesce(reverse, F.lit(False)))
    unmapped = F.col("src_chrom").isNull() | (F.col("_rev") & ((F.col("_t0") < 0) | F.lit(not fix_swapped_ref)))
    rows = rows.withColumn("_status", F.when(unmapped, F.lit("unmapped")).otherwise(F.lit("ok")))
    alts = F.split("alt", ",")
    flipped = F.array_join(F.transform(alts, lambda a: F.when(kept_allele(a), a).otherwise(reverse_complement(a))), ",")
    rows = rows.withColumn("_ref", F.when(F.col("_rev"), reverse_complement(F.col("ref"))).otherwise(F.col("ref")))
    rows = rows.withColumn("_alt", F.when(F.col("_rev"), flipped).otherwise(F.col("alt")))
    if target_ref is not None:
        checked = (F.col("_status") == "ok") & ~F.exists(alts, kept_allele)
        end = F.col("_t0") + n
        short = n <= target_ref.overlap  # longer ones are keyed by the record, which no shuffle changes
        rows = target_ref.joined(rows.withColumn("_checked", F.coalesce(checked, F.lit(False))), F.col("_t0"), "tgt_chrom")
        seen = F.substring("_seq", (F.col("_t0") - F.col("_first") + 1).cast("int"), n).cast("string")
        brief = rows.filter(~F.col("_checked") | short).withColumn("_seen", seen)
        long = target_ref.stretch(rows.filter(F.col("_checked") & ~short), F.col("_t0"), end, [c for c in ("row_id", "alt_idx") if c in rows.columns], "_seen", "tgt_chrom")
        rows = brief.unionByName(long)
        inside = end <= target_ref.length_of(F.col("tgt_chrom"))
        matches = F.coalesce(inside & (F.upper("_seen") == F.upper("_ref")), F.lit(False))
        rows = rows.withColumn("_status", F.when(F.col("_checked") & ~matches, F.lit("ref_mismatch")).otherwise(F.col("_status")))
    rows = settled(rows, **{c: F.col(c) for c in ("_t0", "_rev", "_ref", "_alt", "_status")})
    figures = rows.agg(
        F.count(F.lit(1)).alias("input"), F.count_if(F.col("_status") == "ok").alias("output"), F.count_if(F.col("_status") == "unmapped").alias("rejected_unmapped"),
        F.count_if(F.col("_status") == "ref_mismatch").alias("rejected_ref_mismatch"), F.count_if((F.col("_status") == "ok") & F.col("_rev")).alias("swapped_alleles"),
    )
    good = rows.filter("_status = 'ok'")
    if write_src_coords:
        good = settled(good, info=with_source(F.col("info"), F.col("chrom"), F.col("_p")))
    good = good.withColumn("chrom", F.col("tgt_chrom")).withColumn("pos", (F.col("_t0") + 1).cast("string")).withColumn("ref", F.col("_ref")).withColumn("alt", F.col("_alt"))
    if reserialize:
        good = settled(good, info=rewritten_info(F.col("info"), header, None, True), samples=rewritten_samples(F.col("samples"), F.col("format"), header, None, True), qual=canonical_number(F.col("qual")))
    lifted = VariantSet(good.withColumn("line", composed()).select(*vs.df.columns), header, figures)
    return lifted, VariantSet(rows.filter("_status <> 'ok'").select(*vs.df.columns, F.col("_status").alias("reason")), header, figures)


def summary(stats: dict[str, int]) -> str:
    return f"liftover: {stats['input']} in, {stats['output']} out ({stats['rejected_unmapped']} unmapped, {stats['rejected_ref_mismatch']} REF mismatches, {stats['swapped_alleles']} strand-flipped)"
