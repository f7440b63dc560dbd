"""The variant operators on small inputs whose results were worked out by hand."""

import pytest

from helixframe.errors import ExpressionError, FormatError, VariantError
from helixframe.functions.numbers import plain_text
from helixframe.operators.filter import filter_variants, summary
from helixframe.operators.liftover import liftover
from helixframe.operators.normalize import normalize
from helixframe.plans.expression import parse_expr
from helixframe.sources.chain import chain_from_text, parse_chain
from helixframe.sources.fasta import contig_sequences, read_fasta, reference_from_dict
from helixframe.sources.header import header_schema
from helixframe.sources.vcf import detect_format_from_magic, from_lines, is_compressed_path, read_vcf, reject_bcf_output, to_text, write_vcf

HEAD = [
    "##fileformat=VCFv4.2", "##contig=<ID=chr1,length=1000>", "##contig=<ID=chr2>",
    '##FILTER=<ID=PASS,Description="All">', '##INFO=<ID=AF,Number=A,Type=Float,Description="Frequency, by allele">', '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">',
    '##INFO=<ID=PL,Number=G,Type=Integer,Description="Likelihoods">', '##INFO=<ID=AD,Number=R,Type=Integer,Description="Depths">', '##INFO=<ID=DB,Number=0,Type=Flag,Description="Known">', '##INFO=<ID=CSQ,Number=.,Type=String,Description="Effects">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Depths">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2",
]


def row(chrom="chr1", pos=1, ref="A", alt="T", qual="50", flt="PASS", info=".", fmt="GT:AD", s1="0/1:5,6,7", s2="1/2:.,2"):
    return "\t".join(map(str, (chrom, pos, ".", ref, alt, qual, flt, info, fmt, s1, s2)))


def positions(vs):
    return [r.pos for r in vs.df.orderBy("row_id").collect()]


@pytest.mark.parametrize(
    ("expression", "kept"),
    [
        ("INFO/AF < 0.05", ["1", "2"]), ("!(INFO/AF < 0.05)", ["3", "4", "5"]), ("INFO/AF", ["1", "2", "3"]), ("0.05 > INFO/AF", ["1", "2"]), ("INFO/AF == 0.4", ["2"]), ("INFO/AF ~ '0.4'", ["2"]),
        ("INFO/CSQ ~ 'stop'", ["4"]), ("INFO/CSQ !~ 'stop'", ["5"]), ("INFO/DB", ["3"]), ("INFO/DB == 1", ["3"]), ("INFO/NEW > 2", ["5"]), ("FILTER == 'PASS' && POS >= 3", ["3", "4"]), ("QUAL > 40 || FILTER ~ 'DP'", ["1", "2", "3", "5"]),
        ("FORMAT/AD > '4'", ["1", "2", "3", "4", "5"]), ("FORMAT/GT == '0/1'", ["1", "2", "3", "4", "5"]), ("INFO/DP == '0x'", ["5"]), ("INFO/DP != 7", ["5"]), ("1 < 2", ["1", "2", "3", "4", "5"]), ("INFO/AF < INFO/DP", ["1"]), ("'nan' == 'nan'", []), ("POS == '02'", ["2"]),
    ],
)
def test_filter(spark, expression, kept):
    vs = from_lines(spark, [*HEAD, row(pos=1, info="AF=0.01;DP=7"), row(pos=2, info="AF=0.01,0.40"), row(pos=3, info="DB;AF=0.5"), row(pos=4, qual=".", info="AF=.;CSQ=a,stop"), row(pos=5, qual="9", flt="DP5;Low", info="CSQ=b;NEW=3;DP=0x"), "short\t1"])
    out = filter_variants(vs, expression)
    assert positions(out) == kept
    stats = out.stats()
    assert stats == {"input": 6, "output": len(kept), "filtered_out": 5 - len(kept)}
    assert summary(stats).startswith(f"filter: 6 in, {len(kept)} out")
    assert positions(filter_variants(vs, expression, invert=True)) == [p for p in "12345" if p not in kept]


@pytest.mark.parametrize("text", ["INFO/AF", "!INFO/DB", "!!(POS>1)", "1 < 2", "'a' == 'a'", "POS > -1", "QUAL>30&&FILTER=='PASS'"])
def test_accepted(text):
    parse_expr(text)


@pytest.mark.parametrize("text", ["", "INFO/AF <> 3", "INFO/AF << 3", "QUAL >>> 30", "POS > 1e5", "POS > .5", "INFO/1000G", "INFO/AF.x > 1", "REF == 'A'", "POS&&", "'a'", 'FILTER == "PASS"', "CHROMX", "(POS > 1"])
def test_rejected(text):
    with pytest.raises(ExpressionError, match="invalid filter expression"):
        parse_expr(text)


def test_caret():
    with pytest.raises(ExpressionError) as e:
        parse_expr(" INFO/AF << 3")
    assert str(e.value).split("\n")[2] == " " * 2 + " " * 9 + "^"


def test_numbers(spark):
    want = {1.0: "1", 0.1: "0.1", 1e-5: "0.00001", 1.5e21: "1500000000000000000000", 123456789.125: "123456789.125", -2.5e-7: "-0.00000025", float("-inf"): "-inf", 1e7: "10000000"}
    got = spark.createDataFrame([(x,) for x in want], "x double").select("x", plain_text(__import__("pyspark").sql.functions.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in got} == want


def test_split(spark):
    vs = from_lines(spark, [*HEAD, row(alt="T,G", info="AF=0.30,0.2;PL=0,10,20,30,40,50;AD=1,2,3;DB;DP=4;X=1,2"), row(pos=2, alt="<DEL>", info="AF=0.10"), row(pos=1001)])
    out = normalize(vs, left_align=False, check_ref="ignore")
    got = [(r.alt, r.info, r.samples) for r in out.df.orderBy("row_id", "alt_idx").collect()]
    assert got == [
        ("T", "AF=0.3;PL=0,10,20;AD=1,2;DB;DP=4;X=1,2", ["0/1:5,6", "1/2:.,2"]), ("G", "AF=0.2;PL=0,30,50;AD=1,3;DB;DP=4;X=1,2", ["0/1:5,7", "1/2:.,."]), ("<DEL>", "AF=0.1", ["0/1:5,6,7", "1/2:.,2"]),
    ]
    assert out.stats() == {"input": 3, "out_of_bounds": 1, "ref_mismatches": 0, "split_sites": 1, "output": 3, "left_aligned": 0}


def by_loop(sequence, pos, ref, alt):
    """The moves one by one."""
    if len(ref) == len(alt):
        return pos, ref, alt
    while pos > 1 and ref[-1] == alt[-1] and pos - 2 < len(sequence):
        b = sequence[pos - 2].upper()
        pos, ref, alt = pos - 1, b + ref[:-1], b + alt[:-1]
    while len(ref) > 1 and len(alt) > 1 and ref[0] == alt[0]:
        pos, ref, alt = pos + 1, ref[1:], alt[1:]
    return pos, ref, alt


@pytest.mark.parametrize(("chunk", "overlap"), [(16, 4), (64, 32), (1024, 512)])
def test_left_align(spark, chunk, overlap):
    sequence = "ACACACACACACGTTTTTTTTTTTTTTTTTTTTTTTTTTTTTGCAGCAGCAGCAGCAGT" + "A" * 70 + "CGCGCG"
    reference = reference_from_dict(spark, {"chr1": sequence}, chunk, overlap)
    cases = []
    for p in range(1, len(sequence) - 6, 3):
        cases += [(p, sequence[p - 1 : p + 1], sequence[p - 1]), (p, sequence[p - 1], sequence[p - 1 : p + 2]), (p, sequence[p - 1 : p + 3], sequence[p - 1 : p + 1]), (p, sequence[p - 1], "T")]
    out = normalize(from_lines(spark, [*HEAD, *[row(pos=p, ref=r, alt=a) for p, r, a in cases]]), reference, check_ref="ignore")
    assert [(int(r.pos), r.ref, r.alt) for r in out.df.orderBy("row_id").collect()] == [by_loop(sequence, *c) for c in cases]


@pytest.mark.parametrize("shared", [65_536, 65_537, 200_003])
def test_left_align_long_prefix(spark, shared):
    """A shared prefix of any length goes."""
    prefix = "".join("ACGT"[i * i % 7 % 4] for i in range(shared))
    ref, alt = prefix + "GATTC", prefix + "CG"
    out = normalize(from_lines(spark, [*HEAD, row("chr2", 1, ref, alt)]), reference_from_dict(spark, {"chr2": ref + "ACGT"}), check_ref="ignore")
    got = [(int(r.pos), r.ref, r.alt) for r in out.df.collect()]
    assert got == [(shared + 1, "GATTC", "CG")]


def test_reference_checks(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">chr1 x\nACGTA\nCGT\n>chr2\nGG\n")
    (tmp_path / "r.fa.fai").write_text("chr1\t8\t8\t5\t6\nchr2\t2\t24\t2\t3\n")
    reference = read_fasta(spark, f"file://{tmp_path}/r.fa", 4, 2)
    assert {r.contig: r.seq for r in contig_sequences(reference).collect()} == {"chr1": "ACGTACGT", "chr2": "GG"}
    vs = from_lines(spark, [*HEAD, row(pos=1, ref="a"), row(pos=2, ref="T"), row(pos=3, ref="T", alt="<DEL>"), row("chr9", 1, "T"), row(pos=900, ref="T")])
    assert normalize(vs, reference).stats()["ref_mismatches"] == 1
    with pytest.raises(VariantError, match="REF mismatch at chr1:2"):
        normalize(vs, reference, check_ref="error")
    with pytest.raises(FormatError, match="index not found"):
        read_fasta(spark, f"file://{tmp_path}/none.fa")


CASES = {
    "plus": ("chain 1 chr1 200 + 0 50 chr1 200 + 100 150 1\n50", [("chr1", 10, "A", "G")], [("chr1", "110", "A", "G")]),
    "minus": ("chain 1 chr1 200 + 0 50 chr1 200 - 50 150 1\n50", [("chr1", 11, "G", "A")], [("chr1", "140", "C", "T")]),
    "symbolic": ("chain 1 chr1 200 + 0 50 chr1 200 - 50 150 1\n50", [("chr1", 11, "G", "*,<DEL>,AC")], [("chr1", "140", "C", "*,<DEL>,GT")]),
    "two blocks": ("chain 1 chr1 50 + 0 25 chr2 100 - 0 23 1\n10 5 3\n10", [("chr1", 18, "A", "C")], [("chr2", "85", "T", "G")]),
    "gap": ("chain 1 chr1 200 + 0 25 chr1 200 + 100 125 1\n10 5 5\n10", [("chr1", 5, "A", "C"), ("chr1", 12, "A", "C"), ("chr1", 20, "A", "C")], [("chr1", "105", "A", "C"), ("chr1", "120", "A", "C")]),
    "hidden": ("chain 1 chr1 200 + 0 50 chr1 200 + 0 50 1\n50\n\nchain 1 chr1 200 + 10 12 chr3 9 + 0 2 2\n2", [("chr1", 11, "A", "C"), ("chr1", 20, "A", "C")], [("chr3", "1", "A", "C")]),
}


@pytest.mark.parametrize("case", CASES)
def test_liftover(spark, case):
    chain, rows, want = CASES[case]
    lifted, rejects = liftover(from_lines(spark, [*HEAD, *[row(c, p, r, a) for c, p, r, a in rows]]), chain_from_text(spark, chain))
    assert [(r.chrom, r.pos, r.ref, r.alt) for r in lifted.df.orderBy("row_id").collect()] == want
    stats = lifted.stats()
    assert stats["input"] == stats["output"] + stats["rejected_unmapped"] + stats["rejected_ref_mismatch"] and rejects.df.count() == len(rows) - len(want)


def test_liftover_options(spark):
    chain = chain_from_text(spark, "chain 1 chr1 200 + 0 50 chr1 200 + 100 150 1\n50")
    vs = from_lines(spark, [*HEAD, row(pos=1, info="DP=1"), row(pos=2, ref="CGTACGT", alt="C"), row(pos=3, ref="A")])
    target = reference_from_dict(spark, {"chr1": "N" * 100 + "ACGTACGTAC"}, 8, 3)
    lifted, rejects = liftover(vs, chain, target_ref=target, write_src_coords=True)
    assert [(r.pos, r.info) for r in lifted.df.orderBy("row_id").collect()] == [("101", "DP=1;SRC_CONTIG=chr1;SRC_POS=1"), ("102", "SRC_CONTIG=chr1;SRC_POS=2")]
    assert [r.reason for r in rejects.df.collect()] == ["ref_mismatch"] and "SRC_POS" in lifted.header.infos
    with pytest.raises(VariantError, match="no contig of the header"):
        liftover(vs, chain_from_text(spark, "chain 1 1 200 + 0 50 1 200 + 100 150 1\n50"))
    assert liftover(vs, chain_from_text(spark, "chain 1 1 200 + 0 50 1 200 + 100 150 1\n50"), allow_contig_mismatch=True)[0].df.count() == 0


def test_chain_errors():
    for text in ("chain 1 chr1 200 + 0 50", "chain 1 chr1 200 - 0 50 chr1 200 + 100 150 1", "chain 1 chr1 200 + 0 50 chr1 20 - 0 50 1\n50"):
        with pytest.raises(FormatError):
            parse_chain(text.split("\n"))


def test_files(spark, tmp_path):
    lines = [*HEAD, row(info="AF=0.10"), row(pos=2)]
    (tmp_path / "a.vcf").write_text("\n".join(lines) + "\n")
    vs = read_vcf(spark, f"file://{tmp_path}/a.vcf")
    assert to_text(filter_variants(vs, "POS > 0")).split("\n")[-3:-1] == lines[-2:]
    write_vcf(vs, f"file://{tmp_path}/out")
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text().split("\n")[-3:-1] == lines[-2:] and part.read_text().startswith("##fileformat")
    infos, formats, contigs = header_schema(spark, vs.header)
    assert infos.count() == 6 and formats.count() == 2 and contigs.collect()[0] == ("chr1", 1000)
    with pytest.raises(FormatError):
        reject_bcf_output("x.bcf")
    assert detect_format_from_magic(b"BCF\x02x") and not detect_format_from_magic(b"BC") and is_compressed_path("a.vcf.bgz") and not is_compressed_path("a.vcf")


def test_several_part_files(spark, tmp_path):
    lines = [*HEAD, *[row(pos=p) for p in range(1, 401)]]
    write_vcf(from_lines(spark, lines), f"file://{tmp_path}/out", single=False)
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert len(parts) > 1 and parts[0].read_text().startswith("##fileformat")
    back = read_vcf(spark, f"file://{tmp_path}/out")
    assert back.header.render() == from_lines(spark, lines).header.render() and to_text(back).split("\n")[-401:-1] == lines[-400:]


@pytest.mark.parametrize(("a", "b", "most", "want"), [("", "A", 8, 0), ("A", "C", 8, 0), ("ACGT", "ACGA", 8, 3), ("ACGT", "ACGT", 2, 2), ("A" * 300, "A" * 299 + "C", 512, 299), ("A" * 7, "A" * 9, 128, 7)])
def test_common_prefix(spark, a, b, most, want):
    from pyspark.sql import functions as F

    from helixframe.functions.bases import common_prefix

    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(common_prefix(F.col("a"), F.col("b"), most).alias("n")).first().n == want


def test_planning_stays_short(spark):
    """A filter on the results of both operators is planned in seconds: no rule copies their expressions."""
    import time

    from helixframe.operators.filter import filter_variants
    from helixframe.operators.liftover import liftover
    from helixframe.operators.normalize import normalize
    from helixframe.plans import view

    vs = normalize(view.variants(spark, "/root/testdata/sf0.001"), view.reference(spark))
    kept = filter_variants(liftover(vs, view.chain(spark))[0], "INFO/AF < 0.05 || INFO/DP > 20")
    began = time.monotonic()
    kept.df.filter("alt <> 'A'")._jdf.queryExecution().executedPlan()
    assert time.monotonic() - began < 30


def test_deep_parentheses():
    """Nested parts are read once each, so depth costs no more than length."""
    text = "POS > 1"
    for _ in range(100):
        text = f"POS > 1 && ({text})"
    parse_expr(text)
    with pytest.raises(ExpressionError):
        parse_expr(text + " &&")


def test_fasta_of_many_splits(spark, tmp_path):
    """Lines keep their numbers when a file is read in many splits."""
    import random

    r = random.Random(3)
    sequences = {f"c{i}": "".join(r.choices("ACGT", k=r.choice([1, 59, 60, 61, 5000]))) for i in range(40)}
    text, index = "", ""
    for name, s in sequences.items():
        text += f">{name} more\n"
        index += f"{name}\t{len(s)}\t{len(text)}\t60\t61\n"
        text += "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60))
    (tmp_path / "m.fa").write_text(text)
    (tmp_path / "m.fa.fai").write_text(index)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {x.contig: x.seq for x in contig_sequences(read_fasta(spark, f"file://{tmp_path}/m.fa", 256, 64)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sequences


def test_repeat_beyond_the_overlap(spark):
    """A repeat that reaches further than a chunk's overlap is followed to its start, in records of any order."""
    sequence = "G" + "AC" * 4000 + "T"
    reference = reference_from_dict(spark, {"chr2": sequence}, 1024, 64)
    cases = [(p, sequence[p - 1 : p + 2], sequence[p - 1]) for p in (7990, 5001, 3, 8000, 12)]
    out = normalize(from_lines(spark, [*HEAD, *[row("chr2", *c) for c in cases]]), reference, check_ref="ignore")
    assert [(int(r.pos), r.ref, r.alt) for r in out.df.orderBy("row_id").collect()] == [by_loop(sequence, *c) for c in cases]
