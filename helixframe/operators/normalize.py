"""Normalization: reference checks, one row for each alternative, indels moved to the left."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.errors import VariantError
from helixframe.functions.bases import common_prefix
from helixframe.functions.fields import canonical_number, rewritten_info, rewritten_samples, settled
from helixframe.functions.numbers import to_long
from helixframe.sources.fasta import Reference
from helixframe.sources.vcf import VariantSet, composed

log = logging.getLogger(__name__)
#: Bases before a record that are looked at, at first; rows whose repeat reaches further see more.
NEAR = 128


def symbolic(alt: Column) -> Column:
    """Whether an alternative is symbolic or a breakend; ``*`` is not."""
    return F.exists(F.split(alt, ","), lambda a: a.startswith("<")) | alt.contains("[") | alt.contains("]")


def _shift(context: Column, limit: int) -> Column:
    """Places to move left, given the bases before: the common suffix of context || REF and context || ALT."""
    shared = common_prefix(F.reverse(F.concat(context, F.col("ref"))), F.reverse(F.concat(context, F.col("alt"))), limit)
    moves = F.right("ref", F.lit(1)) == F.right("alt", F.lit(1))
    return F.when(moves, F.least(shared, F.char_length(context))).when(context.isNotNull(), F.lit(0))


def left_aligned(rows: DataFrame, reference: Reference) -> DataFrame:
    """Rows (columns chrom, pos, ref, alt, _first, _seq, _one, row_id, alt_idx) with indels at their leftmost place; adds _moved.

    ``_one``: has a single alternative with bases.  The suffix that both alleles share goes, with bases of the reference
    coming in at the front, and then the prefix they share but for one base.  Rows on unknown contigs stay.  One pass
    serves all repeats that end inside the chunk's overlap; longer ones see the whole contig before them.
    """
    known = reference.length_of(F.col("chrom"))
    rows = rows.withColumn("_p", to_long(F.col("pos")))
    indel = F.col("_one") & (F.char_length("ref") != F.char_length("alt")) & known.isNotNull() & (F.col("_p") >= 1)
    rows = rows.withColumn("_indel", F.coalesce(indel, F.lit(False))).withColumn("_left", F.when(F.col("_p") - 2 < known, F.col("_p") - 1).otherwise(F.lit(0)))

    def before(n: int) -> Column:
        """Up to n bases before the record, in upper case, from its chunk."""
        many = F.least(F.lit(n), F.col("_left"), F.greatest(F.col("_p") - 1 - F.col("_first"), F.lit(0)))
        return F.upper(F.coalesce(F.substring("_seq", (F.col("_p") - F.col("_first") - many).cast("int"), many.cast("int")).cast("string"), F.lit("")))

    near, wide = min(NEAR, reference.overlap), reference.overlap
    rows = rows.withColumn("_c", F.when(F.col("_indel"), before(near))).withColumn("_k", F.when(F.col("_indel"), _shift(F.col("_c"), near)))
    full = F.coalesce((F.col("_k") == F.char_length("_c")) & (F.col("_k") < F.col("_left")), F.lit(False))
    if wide > near:
        rows = rows.withColumn("_full", full).withColumn("_c", F.when(F.col("_full"), before(wide)).otherwise(F.col("_c")))
        rows = rows.withColumn("_k", F.when(F.col("_full"), _shift(F.col("_c"), wide)).otherwise(F.col("_k"))).drop("_full")
    if (longest := max([0, *reference.lengths.values()])) > wide:
        rows = settled(rows, _c=F.col("_c"), _k=F.col("_k"), _far=full)
        rest = reference.stretch(rows.filter("_far").drop("_c", "_k"), F.lit(0).cast("bigint"), F.col("_left"), ["row_id", "alt_idx"], "_c")
        rest = rest.withColumn("_c", F.upper(F.coalesce("_c", F.lit("")))).withColumn("_k", _shift(F.col("_c"), longest))
        rows = rows.filter("not _far").unionByName(rest).drop("_far")
    cut = lambda allele: F.when(F.col("_indel"), F.substring(F.concat("_c", allele), F.char_length("_c") - F.col("_k") + 1, F.char_length(allele)))
    rows = rows.withColumn("_r", cut(F.col("ref"))).withColumn("_a", cut(F.col("alt")))
    shorter = F.least(F.char_length("_r"), F.char_length("_a")) - 1
    shared = F.when(shorter > 0, F.least(common_prefix(F.col("_r"), F.col("_a")), shorter)).otherwise(F.lit(0))
    rows = rows.withColumn("_j", F.when(F.col("_indel"), shared))
    rows = rows.withColumn("_np", F.col("_p") - F.col("_k") + F.col("_j"))
    rows = rows.withColumn("_nr", F.substring("_r", F.col("_j") + 1, F.char_length("_r"))).withColumn("_na", F.substring("_a", F.col("_j") + 1, F.char_length("_a")))
    moved = F.coalesce((F.col("_np") != F.col("_p")) | (F.col("_nr") != F.col("ref")) | (F.col("_na") != F.col("alt")), F.lit(False))
    rows = rows.withColumn("_moved", moved)
    place = F.when(F.col("_moved"), F.col("_np").cast("string")).otherwise(F.col("pos"))
    return settled(rows, _moved=F.col("_moved"), pos=place, ref=F.coalesce("_nr", "ref"), alt=F.coalesce("_na", "alt")).drop("_p", "_indel", "_left", "_c", "_k", "_r", "_a", "_j", "_np", "_nr", "_na")


def normalize(vs: VariantSet, reference: Reference | None = None, split: bool = True, left_align: bool = True, check_ref: str = "warn", fast: bool = False) -> VariantSet:
    """Normalized records, in the order of the input and of the alternatives.

    A record is dropped if it lies past its declared contig; symbolic ones stay as they are; ``check_ref`` is ignore, warn
    (counts) or error (raises at the first).  ``fast`` keeps the raw text of records that need no work, and judges
    symbolic records before the contig's end; otherwise all records get canonical numbers.
    """
    if check_ref not in ("ignore", "warn", "error"):
        raise VariantError(f"check_ref: {check_ref}")
    if reference is None and (left_align or check_ref != "ignore"):
        raise VariantError("a reference is needed to check or to left-align")
    header = vs.header
    if reference is not None and left_align and (absent := [c for c in header.contigs if c not in reference.lengths]):
        log.warning("contigs that the reference lacks are neither checked nor aligned: %s", ", ".join(absent))
    lengths = {k: v for k, v in header.contigs.items() if v is not None}
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in lengths.items() for x in kv]), F.col("chrom")) if lengths else F.lit(None).cast("int")
    rows = settled(vs.df.filter("n_cols >= 8"), _sym=F.coalesce(symbolic(F.col("alt")), F.lit(False)), _at=to_long(F.col("pos")))
    past = F.coalesce(F.col("_at") > limit, F.lit(False))
    rows = settled(rows, _oob=past & ~F.col("_sym") if fast else past)
    place = F.greatest(F.col("_at") - 1, F.lit(0))
    if reference is not None and (left_align or check_ref != "ignore"):
        rows = reference.joined(rows, place)
    if check_ref == "ignore":
        rows = rows.withColumn("_mismatch", F.lit(False)).withColumn("_past_end", F.lit(False))
    else:
        base = F.substring("_seq", (place - F.col("_first") + 1).cast("int"), 1).cast("string")
        subject = ~F.col("_sym") & ~F.col("_oob")
        past_end = subject & (place >= reference.length_of(F.col("chrom"))) & ~F.lit(fast)
        differs = subject & (base != "") & (F.upper(base) != F.upper(F.substring("ref", 1, 1)))
        rows = settled(rows, _mismatch=F.coalesce(differs, F.lit(False)), _past_end=F.coalesce(past_end, F.lit(False)))
    many = F.col("alt").contains(",") & ~F.col("_sym")
    figures = rows.agg(F.count(F.lit(1)).alias("input"), F.count_if(F.col("_oob")).alias("out_of_bounds"), F.count_if(F.col("_mismatch")).alias("ref_mismatches"), F.count_if(many & ~F.col("_oob") & F.lit(split)).alias("split_sites"))
    if check_ref == "error":
        bad = rows.filter("_mismatch or _past_end").orderBy("row_id").select("chrom", "pos", "ref", "_past_end").first()
        if bad:
            raise VariantError(f"position {bad.chrom}:{bad.pos} out of bounds of the reference" if bad._past_end else f"REF mismatch at {bad.chrom}:{bad.pos}: the record has {bad.ref}")
    rows = rows.filter(~F.col("_oob"))
    alts = F.when(many & F.lit(split), F.split("alt", ",")).otherwise(F.array("alt"))
    out = rows.withColumn("_cut", many & F.lit(split)).select("*", F.posexplode(alts).alias("alt_idx", "_alt")).withColumn("alt", F.col("_alt"))
    k = F.when(F.col("_cut"), F.col("alt_idx") + 1)
    out = out.withColumn("_nth", k)
    out = out.withColumn("_moved", F.lit(False))
    if left_align:
        out = out.drop("_moved").withColumn("_one", ~F.col("_sym") & ~F.col("alt").contains(","))
        out = left_aligned(out, reference)
    snp = F.char_length("ref") == F.char_length("alt")
    raw = (snp | F.lit(not left_align) | F.col("_sym")) & ~F.col("_cut") & ~F.col("alt").contains(",") | F.col("_sym") if fast else F.lit(False)
    out = out.withColumn("_raw", raw)
    unless_raw = lambda name, new: F.when(F.col("_raw"), F.col(name)).otherwise(new)
    nth = F.col("_nth") if split else None
    out = settled(
        out, info=unless_raw("info", rewritten_info(F.col("info"), header, nth, True)), samples=unless_raw("samples", rewritten_samples(F.col("samples"), F.col("format"), header, nth, True)), qual=unless_raw("qual", canonical_number(F.col("qual")))
    )
    out = out.withColumn("line", F.when(F.col("_raw"), F.col("line")).otherwise(composed()))
    made = out.agg(F.count(F.lit(1)).alias("output"), F.count_if("_moved").alias("left_aligned"))
    df = out.select("row_id", "alt_idx", "line", "chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "samples", "n_cols")
    return VariantSet(df, header, figures.crossJoin(made))


def summary(stats: dict[str, int]) -> str:
    """One line of the counts; mismatches with the reference are warned of as well."""
    if stats["ref_mismatches"]:
        log.warning("%d records do not have the base of the reference", stats["ref_mismatches"])
    text = f"normalize: {stats['input']} in, {stats['output']} out ({stats['left_aligned']} left-aligned, {stats['split_sites']} split, {stats['ref_mismatches']} REF mismatches"
    return text + (f", {stats['out_of_bounds']} out-of-bounds skipped)" if stats["out_of_bounds"] else ")")
