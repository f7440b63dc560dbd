"""VCF headers: parsed on the driver, they decide how columns are typed."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from helixframe.errors import FormatError

#: Order in which groups of header lines are written.
GROUPS = ("INFO", "FILTER", "FORMAT", "ALT", "contig")
_STRUCTURED = re.compile(r"##(\w+)=<(.*)>\s*$")
_ENTRY = re.compile(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,]*)(?:,|$)')


@dataclass(frozen=True)
class HeaderLine:
    group: str
    values: dict[str, str]
    text: str

    @property
    def id(self) -> str:
        return self.values.get("ID", "")

    @property
    def number(self) -> str:
        return self.values.get("Number", ".")

    @property
    def type(self) -> str:
        return self.values.get("Type", "String")


@dataclass(frozen=True)
class Header:
    fileformat: str = "##fileformat=VCFv4.2"
    lines: tuple[HeaderLine, ...] = ()
    others: tuple[str, ...] = ()
    columns: tuple[str, ...] = field(default=("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"))

    def of(self, group: str) -> dict[str, HeaderLine]:
        """Lines of a group by id; the first of an id counts."""
        found: dict[str, HeaderLine] = {}
        for line in self.lines:
            if line.group == group:
                found.setdefault(line.id, line)
        return found

    @property
    def infos(self) -> dict[str, HeaderLine]:
        return self.of("INFO")

    @property
    def formats(self) -> dict[str, HeaderLine]:
        return self.of("FORMAT")

    @property
    def contigs(self) -> dict[str, int | None]:
        """Lengths of the declared contigs, in order; None where undeclared."""
        return {k: int(n) if (n := v.values.get("length", "")).isdigit() else None for k, v in self.of("contig").items()}

    @property
    def samples(self) -> tuple[str, ...]:
        return self.columns[9:]

    def with_info(self, id_: str, number: str, type_: str, description: str) -> Header:
        if id_ in self.infos:
            return self
        text = f'##INFO=<ID={id_},Number={number},Type={type_},Description="{description}">'
        return replace(self, lines=(*self.lines, HeaderLine("INFO", {"ID": id_, "Number": number, "Type": type_, "Description": description}, text)))

    def render(self) -> list[str]:
        """The header in the order in which it is written: file format, groups, the rest, column names."""
        grouped = [line.text for g in GROUPS for line in self.of(g).values()]
        return [self.fileformat, *grouped, *self.others, "#" + "\t".join(self.columns)]


def parse_header(lines: Iterable[str]) -> Header:
    """A header from its lines; it ends with the line of column names."""
    fileformat, found, others = None, [], []
    for raw in lines:
        line = raw.rstrip("\r\n")
        if line.startswith("#CHROM"):
            if fileformat is None:
                raise FormatError("failed to read VCF header: no ##fileformat line")
            return Header(fileformat, tuple(found), tuple(others), tuple(line[1:].split("\t")))
        if not line.startswith("##"):
            break
        if line.startswith("##fileformat="):
            fileformat = line
        elif (m := _STRUCTURED.match(line)) and m[1] in GROUPS:
            values = {k: v[1:-1] if v[:1] == '"' else v for k, v in _ENTRY.findall(m[2])}
            found.append(HeaderLine(m[1], values, line))
        else:
            others.append(line)
    raise FormatError("failed to read VCF header: no line of column names")


def header_schema(spark: SparkSession, header: Header) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The declared INFO fields, FORMAT fields (id, number, type, description) and contigs (id, length)."""
    fields = "id string, number string, type string, description string"
    rows = [[(x.id, x.number, x.type, x.values.get("Description", "")) for x in group.values()] for group in (header.infos, header.formats)]
    contigs = spark.createDataFrame(list(header.contigs.items()), "id string, length long")
    return spark.createDataFrame(rows[0], fields), spark.createDataFrame(rows[1], fields), contigs
