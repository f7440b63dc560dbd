"""Texts in memory, translation and streams."""

import gzip
import io
import json

import pytest

from helixframe.errors import ExpressionError, VariantError
from helixframe.operators import ask
from helixframe.operators.filter import filter_variants
from helixframe.operators.liftover import liftover
from helixframe.operators.text import filter_text, liftover_text, normalize_text
from helixframe.sources.chain import KNOWN_CHAINS, chain_from_text, read_chain
from helixframe.sources.header import parse_header
from helixframe.sources.vcf import format_from_path, from_text, read_stdin, read_vcf, to_text, write_vcf
from helixframe.streaming.vcf import stream_vcf, write_stream

HEAD = '##fileformat=VCFv4.2\n##INFO=<ID=AF,Number=A,Type=Float,Description="F">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n'
VCF = HEAD + "chr1\t5\t.\tA\tC,G\t9\tPASS\tAF=0.10,0.3\nchr1\t60\t.\tG\tT\t8\t.\tAF=0.5\n"
CHAIN = "chain 1 chr1 200 + 0 50 chr1 200 + 100 150 1\n50"


def body(text):
    return [x for x in text.split("\n") if x and x[0] != "#"]


def test_texts(spark):
    assert body(filter_text(spark, VCF, "INFO/AF < 0.2")) == ["chr1\t5\t.\tA\tC,G\t9\tPASS\tAF=0.10,0.3"]
    assert [x.split("\t")[4:8] for x in body(normalize_text(spark, VCF))] == [["C", "9", "PASS", "AF=0.1"], ["G", "9", "PASS", "AF=0.3"], ["T", "8", ".", "AF=0.5"]]
    assert [x.split("\t")[1] for x in body(liftover_text(spark, VCF, CHAIN))] == ["105"]


def test_ask(monkeypatch):
    header, answers = parse_header(HEAD.split("\n")), iter(['{"expression": "AF <"}', '```json\n{"expression": "INFO/AF < 0.1", "confidence": 0.4}\n```'])
    asked = []
    found = ask.translate("rare ones", header, lambda p: asked.append(p) or next(answers))
    assert found.expression == "INFO/AF < 0.1" and "INFO/AF: Float" in asked[0] and "invalid filter expression" in asked[1]
    with pytest.raises(VariantError):
        ask.accepted(found, unattended=True)
    assert ask.accepted(found, unattended=True, accept_low_confidence=True) == ask.accepted(found, confirm=lambda t: True) == "INFO/AF < 0.1"
    monkeypatch.setenv(ask.MOCK, json.dumps({"expression": "true"}))
    with pytest.raises(ExpressionError):
        ask.translate("x", header)


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.vcf").write_text(VCF)
    header = parse_header(HEAD.split("\n"))
    vs = stream_vcf(spark, f"file://{tmp_path}/in", header)
    write_stream(filter_variants(vs, "QUAL > 8").df, f"file://{tmp_path}/f", f"file://{tmp_path}/cf").awaitTermination()
    lifted, _ = liftover(vs, chain_from_text(spark, CHAIN))
    write_stream(lifted.df, f"file://{tmp_path}/l", f"file://{tmp_path}/cl").awaitTermination()
    assert [r.value.split("\t")[1] for r in spark.read.text(f"file://{tmp_path}/f").collect()] == ["5"]
    assert [r.value.split("\t")[1] for r in spark.read.text(f"file://{tmp_path}/l").collect()] == ["105"]


def test_known_chains():
    assert [n for n, _ in KNOWN_CHAINS] == ["hg19 -> hg38", "hg38 -> hg19", "hg38 -> T2T-CHM13", "T2T-CHM13 -> hg38"]
    assert all(u.startswith("https://hgdownload.soe.ucsc.edu/goldenPath/") and u.endswith(".over.chain.gz") for _, u in KNOWN_CHAINS)


@pytest.mark.parametrize("suffix", [".bgz", ".gz", ".GZ"])
def test_compressed(spark, tmp_path, suffix):
    """Several gzip members after one another, as block compression writes them, whatever the suffix; lines run over members."""
    half = len(VCF) // 2 + 3
    path = tmp_path / f"x.vcf{suffix}"
    path.write_bytes(gzip.compress(VCF[:half].encode()) + gzip.compress(VCF[half:].encode()) + gzip.compress(b""))
    assert [r.line for r in read_vcf(spark, f"file://{path}").df.orderBy("row_id").collect()] == body(VCF)
    chain = tmp_path / f"x.chain{suffix}"
    chain.write_bytes(gzip.compress(CHAIN.encode()))
    assert len(read_chain(spark, f"file://{chain}")) == 1


def test_stdin_and_suffix(spark, tmp_path):
    assert body(to_text(read_stdin(spark, io.BytesIO(VCF.encode())))) == body(VCF)
    vs = read_stdin(spark, io.BytesIO(VCF.encode()), f"file://{tmp_path}/stdin")
    write_vcf(vs, f"file://{tmp_path}/out.vcf.gz")
    assert [p.suffix for p in (tmp_path / "out.vcf.gz").glob("part-*")] == [".gz"] and format_from_path("x.bcf") == "vcf"


def test_warnings(spark, tmp_path, caplog):
    lifted, _ = liftover(from_text(spark, VCF), chain_from_text(spark, CHAIN), target_ref=f"file://{tmp_path}/none.fa")
    assert lifted.df.count() == 1 and "not checked" in caplog.text


def test_evaluate_and_edit():
    header = parse_header(HEAD.split("\n"))
    share, wrong = ask.evaluate([("a", "POS>1"), ("b", "POS > 2")], header, lambda p: '{"expression": "POS > 1", "confidence": 1}')
    assert share == 0.5 and wrong == [("b", "POS > 2", "POS > 1")]
    assert ask.accepted(ask.Translation("POS > 1"), confirm=lambda t: "POS > 3") == "POS > 3"
    with pytest.raises(ExpressionError):
        ask.accepted(ask.Translation("POS > 1"), confirm=lambda t: "POS >")
