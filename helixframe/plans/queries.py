"""The variant queries by name, and SQL that gives the same rows from the view's figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.bases import reverse_complement
from helixframe.operators.filter import filter_variants
from helixframe.operators.liftover import liftover
from helixframe.operators.normalize import normalize
from helixframe.plans import view
from helixframe.plans.compiler import format_text, info_text
from helixframe.sources.header import header_schema
from helixframe.sources.vcf import VariantSet

Query = Callable[[SparkSession, str], DataFrame]
V = f"WITH v AS ({view.VIEW})"

#: Filter queries: the expression, and the condition on the view's figures under which it holds.
FILTERS: dict[str, tuple[str, str]] = {
    "filter_af": ("INFO/AF < 0.05", "has_af = 1 AND d < 5"),
    "filter_pass": ("FILTER == 'PASS'", "flag = 'R'"),
    "filter_and": ("INFO/AF < 0.05 && FILTER == 'PASS'", "has_af = 1 AND d < 5 AND flag = 'R'"),
    "filter_region": ("CHROM == 'chr2' && POS >= 100 && POS <= 200", "chrom = 'chr2' AND pos BETWEEN 100 AND 200"),
    "filter_or": ("INFO/AF > 0.08 || QUAL > 40", "(has_af = 1 AND (d > 8 OR two = 1)) OR (nr <> 7 AND qty > 40)"),
    "filter_not": ("!(INFO/AF < 0.05)", "NOT (has_af = 1 AND d < 5)"),
    "filter_contains": ("FILTER ~ 'DP5'", "flag NOT IN ('R', 'A') AND status = 'O'"),
    "filter_not_contains": ("FILTER !~ 'DP5'", "flag IN ('R', 'A')"),
    "filter_contains_list": ("INFO/GENE ~ 'G2'", "part % 3 = 1"),
    "filter_exists": ("INFO/DB", "nr % 2 = 0"),
    "filter_missing_not": ("!(QUAL > 30)", "NOT (nr <> 7 AND qty > 30)"),
    "filter_format": ("FORMAT/GQ >= 25", "nr <> 3 AND qty >= 25"),
    "filter_format_text": ("FORMAT/AD > 19", "ad > '19'"),
    "filter_array_rhs": (
        "0.05 > INFO/AF",
        "has_af = 1 AND CASE WHEN two = 0 THEN d < 5 ELSE '0.05' > (CASE WHEN d = 0 THEN '0' WHEN d = 10 THEN '0.1' ELSE '0.' || lpad(cast(d AS string), 2, '0') END) || ',' || (CASE WHEN d = 0 THEN '0.2' WHEN d = 10 THEN '0.3' ELSE '0.' || cast(d + 20 AS string) END) END",
    ),
    "filter_array_not_equal": ("INFO/AF != 0.03", "has_af = 1 AND (d <> 3 OR two = 1)"),
    "filter_string_numeric": ("INFO/XX == '03' || CHROM == 'chr4'", "nr = 3 OR chrom = 'chr4'"),
    "filter_undeclared": ("INFO/XX >= 4", "nr >= 4"),
    "filter_parentheses": ("(QUAL > 45 || INFO/DP <= 12) && ! FILTER == 'PASS'", "((nr <> 7 AND qty > 45) OR qty <= 2) AND flag <> 'R'"),
    "filter_literals": ("1 < 2 && 'a' == 'a' && INFO/NONE != 1 || POS == 7", "pos = 7"),
}


def _filter(expression: str, invert: bool = False) -> Query:
    return lambda spark, sf_dir: filter_variants(view.variants(spark, sf_dir), expression, invert).df.select("line")


def _counted(vs: VariantSet, *columns: str) -> DataFrame:
    return vs.df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def info_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view.variants(spark, sf_dir).df
    return df.select(info_text("AF").alias("af"), info_text("DP").alias("dp"), info_text("DB").alias("db"), info_text("XX").alias("xx")).groupBy("af", "dp", "db", "xx").agg(F.count(F.lit(1)).alias("n"))


def format_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view.variants(spark, sf_dir).df
    return df.select(format_text("GT").alias("gt"), format_text("GQ").alias("gq"), format_text("ZZ").alias("zz")).groupBy("gt", "gq", "zz").agg(F.count(F.lit(1)).alias("n"))


def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    infos, formats, _ = header_schema(spark, view.header())
    return infos.select(F.lit("INFO").alias("kind"), "id", "number", "type").union(formats.select(F.lit("FORMAT"), "id", "number", "type"))


def _split(spark: SparkSession, sf_dir: str) -> VariantSet:
    return normalize(view.variants(spark, sf_dir), left_align=False, check_ref="ignore")


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).df.select("chrom", "pos", "ref", "alt", "info", F.get("samples", F.lit(0)).alias("sample"))


def _split_values(key: str, source=info_text) -> Query:
    return lambda spark, sf_dir: _split(spark, sf_dir).df.select("alt_idx", source(key).alias("value")).groupBy("alt_idx", "value").agg(F.count(F.lit(1)).alias("n"))


def symbolic_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize(view.variants(spark, sf_dir), view.reference(spark), fast=True)
    return out.df.filter("alt = '<DEL>'").select("line")


def oob_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize(view.variants(spark, sf_dir), split=False, left_align=False, check_ref="ignore")
    return _counted(out, "chrom", "pos")


def ref_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize(view.variants(spark, sf_dir), view.reference(spark), split=False, left_align=False)
    return out.figures.select("input", "out_of_bounds", "ref_mismatches")


def left_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(normalize(view.variants(spark, sf_dir), view.reference(spark), split=False, check_ref="ignore"), "chrom", "pos", "ref", "alt")


#: The headline queries over any variants with the view's header, so that they can be timed over a file as well.
HEADLINE: dict[str, Callable[[VariantSet], VariantSet]] = {
    "filter_af": lambda vs: filter_variants(vs, FILTERS["filter_af"][0]),
    "filter_pass": lambda vs: filter_variants(vs, FILTERS["filter_pass"][0]),
    "normalize_fast": lambda vs: normalize(vs, view.reference(vs.df.sparkSession), split=False, fast=True),
    "normalize_no_split": lambda vs: normalize(vs, view.reference(vs.df.sparkSession), split=False),
    "normalize_full": lambda vs: normalize(vs, view.reference(vs.df.sparkSession)),
    "liftover_refcheck": lambda vs: liftover(vs, view.chain(vs.df.sparkSession), target_ref=view.target(vs.df.sparkSession))[0],
    "normalize_liftover_filter": lambda vs: flagship(vs),
}


def headline(name: str) -> Query:
    """Whole lines, as a file of them would hold."""
    return lambda spark, sf_dir: HEADLINE[name](view.variants(spark, sf_dir)).df.select("line")


def normalize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(view.variants(spark, sf_dir), view.reference(spark)).figures


def chain_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.chain(spark).blocks.select("src_chrom", "src_start", "src_end", "tgt_chrom", "tgt_start", "tgt_end", "tgt_strand", "eff_end")


def _lifted(which: int = 0, **options) -> Callable[[SparkSession, str], VariantSet]:
    return lambda spark, sf_dir: liftover(view.variants(spark, sf_dir), view.chain(spark), **options)[which]


def liftover_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _lifted()(spark, sf_dir)
    return _counted(VariantSet(out.df.filter("chrom <> 'chr9'"), out.header), "chrom", "pos", "ref", "alt")


def liftover_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _lifted()(spark, sf_dir)
    return _counted(VariantSet(out.df.filter("chrom = 'chr9'"), out.header), "chrom", "pos", "ref", "alt")


def liftover_no_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_lifted(fix_swapped_ref=False)(spark, sf_dir), "chrom")


def liftover_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lifted(1)(spark, sf_dir).df.select("line")


def liftover_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _lifted(write_src_coords=True)(spark, sf_dir)
    return out.df.select("chrom", "pos", info_text("SRC_CONTIG").alias("src_contig"), info_text("SRC_POS").alias("src_pos")).groupBy("chrom", "pos", "src_contig", "src_pos").agg(F.count(F.lit(1)).alias("n"))


def liftover_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lifted(target_ref=view.target(spark))(spark, sf_dir).figures


def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view.variants(spark, sf_dir).df
    return df.select("ref", reverse_complement(F.col("ref")).alias("flipped")).groupBy("ref", "flipped").agg(F.count(F.lit(1)).alias("n"))


def filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_variants(view.variants(spark, sf_dir), "INFO/AF < 0.05").figures


def flagship(vs: VariantSet) -> VariantSet:
    """Normalized, lifted and filtered."""
    lifted, _ = liftover(HEADLINE["normalize_full"](vs), view.chain(vs.df.sparkSession), write_src_coords=True)
    return filter_variants(lifted, "INFO/AF < 0.05 && FILTER == 'PASS' || INFO/SRC_POS > 350")


# ---- the same in SQL

G = f"'{view.GENOME}'"
#: Rows of one alternative, in order; (x: a frequency's hundredths as the shortest text).
_SHORT = "CASE WHEN {0} = 0 THEN '0' WHEN {0} % 10 = 0 THEN '0.' || cast({0} // 10 AS string) ELSE '0.' || lpad(cast({0} AS string), 2, '0') END"
_INFO = """concat_ws(';', CASE WHEN has_af = 1 THEN 'AF=' || {af} WHEN has_af = 0 THEN 'AF=.' END, 'DP=' || cast(10 + qty AS string), 'AD=' || {ad}, 'PL=' || {pl}, CASE WHEN nr % 2 = 0 THEN 'DB' END, 'GENE=' || gene, 'XX=' || cast(nr AS string))"""
_AD = ("cast(qty AS string) || ',' || cast(qty + d AS string)", "cast(qty AS string) || ',' || cast(qty + 2 * d AS string)")
_PL = ("'0,' || cast(10 + d AS string) || ',' || cast(20 + d AS string)", "'0,' || cast(30 + d AS string) || ',' || cast(50 + d AS string)")
#: One row for each alternative of the records inside their contigs; symbolic ones too.
PARTS = f"""{V}, parts AS (
SELECT v.*, 0 AS k, CASE WHEN two = 1 THEN split_part(alt, ',', 1) ELSE alt END AS one_alt, {_SHORT.format('d')} AS af1, {_AD[0]} AS ad1, {_PL[0]} AS pl1 FROM v WHERE pos <= 400
UNION ALL SELECT v.*, 1 AS k, split_part(alt, ',', 2), {_SHORT.format('(d + 20)')}, {_AD[1]}, {_PL[1]} FROM v WHERE pos <= 400 AND two = 1)"""


def _aligned(source: str) -> str:
    """CTEs that move the indels of ``source`` (chrom, pos, ref, alt, n) step by step; result: done(chrom, pos, ref, alt, ...).

    Other columns of ``source`` go along.
    """
    return f"""
todo AS (SELECT DISTINCT pos AS p0, ref AS r0, alt AS a0 FROM {source} WHERE len(ref) <> len(alt) AND alt NOT LIKE '<%' AND alt NOT LIKE '%,%'),
shift AS (SELECT p0, r0, a0, p0 AS p, r0 AS r, a0 AS a FROM todo
  UNION ALL SELECT p0, r0, a0, p - 1, substr({G}, cast(p - 1 AS int), 1) || left(r, len(r) - 1), substr({G}, cast(p - 1 AS int), 1) || left(a, len(a) - 1) FROM shift WHERE p > 1 AND right(r, 1) = right(a, 1)),
lefts AS (SELECT p0, r0, a0, min(p) AS p, arg_min(r, p) AS r, arg_min(a, p) AS a FROM shift GROUP BY p0, r0, a0),
trim_ AS (SELECT * FROM lefts UNION ALL SELECT p0, r0, a0, p + 1, substr(r, 2), substr(a, 2) FROM trim_ WHERE len(r) > 1 AND len(a) > 1 AND left(r, 1) = left(a, 1)),
ends AS (SELECT p0, r0, a0, max(p) AS p, arg_max(r, p) AS r, arg_max(a, p) AS a FROM trim_ GROUP BY p0, r0, a0),
done AS (SELECT s.* EXCLUDE (pos, ref, alt), CASE WHEN e.p IS NULL OR s.chrom = 'chr4' THEN s.pos ELSE e.p END AS pos, CASE WHEN e.p IS NULL OR s.chrom = 'chr4' THEN s.ref ELSE e.r END AS ref,
  CASE WHEN e.p IS NULL OR s.chrom = 'chr4' THEN s.alt ELSE e.a END AS alt, s.pos AS from_pos, s.ref AS from_ref, s.alt AS from_alt FROM {source} s LEFT JOIN ends e ON s.pos = e.p0 AND s.ref = e.r0 AND s.alt = e.a0)"""


_WITH = "WITH RECURSIVE" + V.removeprefix("WITH")
_PARTS_R = "WITH RECURSIVE" + PARTS.removeprefix("WITH")
_BLOCKS = """b(src, s, e, tgt, bt, bu, strand) AS (VALUES ('chr1', 0, 200, 'chr1', 100, 300, '+'), ('chr1', 205, 400, 'chr1', 310, 505, '+'),
  ('chr2', 50, 150, 'chr9', 380, 480, '-'), ('chr2', 160, 350, 'chr9', 180, 370, '-'), ('chr3', 100, 300, 'chr3', 100, 300, '+'))"""
_FLIP = "translate(reverse({0}), 'ACGT', 'TGCA')"
#: Each record of ``source`` with its block (or nulls) and what it becomes.


def _lift(source: str) -> str:
    flip_alts = f"CASE WHEN alt LIKE '<%' THEN alt WHEN alt LIKE '%,%' THEN {_FLIP.format('split_part(alt, chr(44), 1)')} || ',' || {_FLIP.format('split_part(alt, chr(44), 2)')} ELSE {_FLIP.format('alt')} END"
    return f"""{_BLOCKS}, l AS (SELECT x.*, b.*, CASE WHEN strand = '-' THEN bu - (pos - 1 - s) - len(ref) ELSE bt + pos - 1 - s END AS t0,
  CASE WHEN strand = '-' THEN {_FLIP.format('ref')} ELSE ref END AS new_ref, CASE WHEN strand = '-' THEN {flip_alts} ELSE alt END AS new_alt
  FROM {source} x LEFT JOIN b ON x.chrom = b.src AND x.pos - 1 >= b.s AND x.pos - 1 < b.e)"""


_TARGET = " ".join(f"WHEN tgt = '{k}' THEN '{v}'" for k, v in view.target_sequences().items())
_MATCH = f"(new_alt LIKE '<%' OR coalesce(substr(CASE {_TARGET} END, cast(t0 + 1 AS int), len(ref)) = new_ref, false))"
_LIFTED = "SELECT tgt AS chrom, cast(t0 + 1 AS string) AS pos, new_ref AS ref, new_alt AS alt, count(*) AS n FROM l WHERE {0} GROUP BY ALL"


#: Records as they are, or one for each alternative, with their rewritten values.
_WHOLE = f"SELECT chrom, pos, ref, alt, qual, filter, line, two, t, {_INFO.format(af='CASE WHEN two = 1 THEN ' + _SHORT.format('d') + chr(32) + '|| chr(44) || ' + _SHORT.format('(d + 20)') + ' ELSE ' + _SHORT.format('d') + ' END', ad='ad', pl='pl')} AS new_info, concat_ws(':', '0/1', ad, gq) AS sample FROM v"
_EACH = f"SELECT chrom, pos, ref, one_alt AS alt, qual, filter, {_INFO.format(af='af1', ad='ad1', pl='pl1')} AS new_info, concat_ws(':', '0/1', ad1, gq) AS sample, has_af = 1 AND CASE WHEN k = 0 THEN d ELSE d + 20 END < 5 AND flag = 'R' AS rare FROM parts"


def _line(chrom: str = "chrom", pos: str = "pos", ref: str = "ref", alt: str = "alt", more: str = "") -> str:
    return f"concat_ws(chr(9), {chrom}, cast({pos} AS string), '.', {ref}, {alt}, qual, filter, new_info{more}, 'GT:AD:GQ', sample)"


def _mismatch(row: str = "") -> str:
    return f"(alt NOT LIKE '<%' AND chrom <> 'chr4' AND left(ref, 1) <> substr({G}, cast(pos AS int), 1))"


ORACLES: dict[str, str] = {name: f"{V} SELECT line FROM v WHERE {holds}" for name, (_, holds) in FILTERS.items()}
ORACLES |= {
    "filter_invert": f"{V} SELECT line FROM v WHERE flag <> 'R'",
    "filter_stats": f"{V} SELECT count(*) AS input, count(*) FILTER (WHERE has_af = 1 AND d < 5) AS output, count(*) FILTER (WHERE NOT (has_af = 1 AND d < 5)) AS filtered_out FROM v",
    "info_lookup": f"{V} SELECT CASE WHEN has_af = 1 THEN af END AS af, cast(10 + qty AS string) AS dp, CASE WHEN nr % 2 = 0 THEN '1' END AS db, cast(nr AS string) AS xx, count(*) AS n FROM v GROUP BY ALL",
    "format_lookup": f"{V} SELECT '0/1' AS gt, CASE WHEN nr <> 3 THEN cast(qty AS string) END AS gq, cast(NULL AS string) AS zz, count(*) AS n FROM v GROUP BY ALL",
    "header_fields": "SELECT * FROM (VALUES ('INFO', 'AF', 'A', 'Float'), ('INFO', 'DP', '1', 'Integer'), ('INFO', 'AD', 'R', 'Integer'), ('INFO', 'PL', 'G', 'Integer'), ('INFO', 'DB', '0', 'Flag'), ('INFO', 'GENE', '.', 'String'), ('FORMAT', 'GT', '1', 'String'), ('FORMAT', 'AD', 'R', 'Integer'), ('FORMAT', 'GQ', '1', 'Integer')) x(kind, id, number, type)",
    "split": f"{PARTS} SELECT chrom, cast(pos AS string) AS pos, ref, one_alt AS alt, {_INFO.format(af='af1', ad='ad1', pl='pl1')} AS info, concat_ws(':', '0/1', ad1, gq) AS sample FROM parts",
    "split_number_a": f"{PARTS} SELECT cast(k AS int) AS alt_idx, CASE WHEN has_af = 1 THEN af1 END AS value, count(*) AS n FROM parts GROUP BY ALL",
    "split_number_r": f"{PARTS} SELECT cast(k AS int) AS alt_idx, ad1 AS value, count(*) AS n FROM parts GROUP BY ALL",
    "split_number_g": f"{PARTS} SELECT cast(k AS int) AS alt_idx, pl1 AS value, count(*) AS n FROM parts GROUP BY ALL",
    "split_format": f"{PARTS} SELECT cast(k AS int) AS alt_idx, ad1 AS value, count(*) AS n FROM parts GROUP BY ALL",
    "symbolic_bypass": f"{V} SELECT line FROM v WHERE t = 5",
    "oob_drop": f"{V} SELECT chrom, cast(pos AS string) AS pos, count(*) AS n FROM v WHERE pos <= 400 GROUP BY ALL",
    "ref_check": f"{V} SELECT count(*) AS input, count(*) FILTER (WHERE pos > 400) AS out_of_bounds, count(*) FILTER (WHERE pos <= 400 AND {_mismatch()}) AS ref_mismatches FROM v",
    "left_align": f"{_WITH}, src AS (SELECT chrom, pos, ref, alt, count(*) AS n FROM v WHERE pos <= 400 GROUP BY ALL), {_aligned('src')} SELECT chrom, cast(pos AS string) AS pos, ref, alt, cast(sum(n) AS bigint) AS n FROM done GROUP BY ALL",
    "normalize_full": f"{_PARTS_R}, src AS ({_EACH}), {_aligned('src')} SELECT {_line()} AS line FROM done",
    "normalize_no_split": f"{_WITH}, src AS ({_WHOLE} WHERE pos <= 400), {_aligned('src')} SELECT {_line()} AS line FROM done",
    "normalize_fast": f"{_WITH}, src AS ({_WHOLE} WHERE pos <= 400 OR t = 5), {_aligned('src')} SELECT CASE WHEN t = 5 OR two = 0 AND len(from_ref) = len(from_alt) THEN line ELSE {_line()} END AS line FROM done",
    "normalize_stats": f"""{_PARTS_R}, src AS (SELECT chrom, pos, ref, one_alt AS alt, count(*) AS n FROM parts GROUP BY ALL), {_aligned('src')}
SELECT (SELECT count(*) FROM v) AS input, (SELECT count(*) FROM v WHERE pos > 400) AS out_of_bounds, (SELECT count(*) FROM v WHERE pos <= 400 AND {_mismatch()}) AS ref_mismatches, (SELECT count(*) FROM v WHERE pos <= 400 AND two = 1) AS split_sites,
  (SELECT count(*) FROM parts) AS output, (SELECT cast(sum(n) AS bigint) FROM done WHERE pos <> from_pos OR ref <> from_ref OR alt <> from_alt) AS left_aligned""",
    "chain_blocks": f"WITH {_BLOCKS} SELECT src AS src_chrom, cast(s AS bigint) AS src_start, cast(e AS bigint) AS src_end, tgt AS tgt_chrom, cast(bt AS bigint) AS tgt_start, cast(bu AS bigint) AS tgt_end, strand AS tgt_strand, cast(e AS bigint) AS eff_end FROM b",
    "liftover_plus": f"{V}, {_lift('v')} {_LIFTED.format(chr(39).join(['strand = ', '+', '']))}",
    "liftover_minus": f"{V}, {_lift('v')} {_LIFTED.format(chr(39).join(['strand = ', '-', '']))}",
    "liftover_no_flip": f"{V}, {_lift('v')} SELECT tgt AS chrom, count(*) AS n FROM l WHERE strand = '+' GROUP BY ALL",
    "liftover_rejects": f"{V}, {_lift('v')} SELECT line FROM l WHERE src IS NULL",
    "liftover_src": f"{V}, {_lift('v')} SELECT tgt AS chrom, cast(t0 + 1 AS string) AS pos, chrom AS src_contig, cast(pos AS string) AS src_pos, count(*) AS n FROM l WHERE src IS NOT NULL GROUP BY ALL",
    "liftover_refcheck": f"{V}, w AS ({_WHOLE}), {_lift('w')} SELECT {_line('tgt', 't0 + 1', 'new_ref', 'new_alt')} AS line FROM l WHERE src IS NOT NULL AND {_MATCH}",
    "liftover_stats": f"""{V}, {_lift('v')} SELECT count(*) AS input, count(*) FILTER (WHERE src IS NOT NULL AND {_MATCH}) AS output, count(*) FILTER (WHERE src IS NULL) AS rejected_unmapped,
  count(*) FILTER (WHERE src IS NOT NULL AND NOT {_MATCH}) AS rejected_ref_mismatch, count(*) FILTER (WHERE strand = '-' AND {_MATCH}) AS swapped_alleles FROM l""",
    "revcomp": f"{V} SELECT ref, {_FLIP.format('ref')} AS flipped, count(*) AS n FROM v GROUP BY ALL",
    "normalize_liftover_filter": f"""{_PARTS_R}, src AS ({_EACH}), {_aligned('src')}, {_lift('done')}
SELECT {_line('tgt', 't0 + 1', 'new_ref', 'new_alt', " || ';SRC_CONTIG=' || chrom || ';SRC_POS=' || cast(pos AS string)")} AS line FROM l WHERE src IS NOT NULL AND (rare OR pos > 350)""",
}

QUERIES: dict[str, Query] = {name: _filter(expression) for name, (expression, _) in FILTERS.items()}
QUERIES |= {name: headline(name) for name in HEADLINE}
QUERIES |= {
    "filter_invert": _filter("FILTER == 'PASS'", invert=True),
    "filter_stats": filter_stats, "info_lookup": info_lookup, "format_lookup": format_lookup, "header_fields": header_fields, "split": split,
    "split_number_a": _split_values("AF"), "split_number_r": _split_values("AD"), "split_number_g": _split_values("PL"), "split_format": _split_values("AD", format_text),
    "symbolic_bypass": symbolic_bypass, "oob_drop": oob_drop, "ref_check": ref_check, "left_align": left_align, "normalize_stats": normalize_stats,
    "chain_blocks": chain_blocks, "liftover_plus": liftover_plus, "liftover_minus": liftover_minus, "liftover_no_flip": liftover_no_flip, "liftover_rejects": liftover_rejects, "liftover_src": liftover_src,
    "liftover_stats": liftover_stats, "revcomp": revcomp,
}
