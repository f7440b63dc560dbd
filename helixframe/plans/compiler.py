"""Filter trees to Spark columns that are true or false, never null."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.functions.fields import info_value
from helixframe.functions.numbers import PLAIN_FLOAT, PLAIN_INTEGER, let, plain_text, to_double, to_long
from helixframe.plans.expression import Both, Compare, Either, Exists, FieldRef, Not, Number, Text
from helixframe.sources.header import Header


def info_text(key: str) -> Column:
    """The first entry of the key in INFO: its value, ``1`` for a bare key, null for ``.`` or none."""
    entries, bare = F.concat(F.lit(";"), F.col("info"), F.lit(";")), F.lit(f";{key};")
    # what comes before the first entry with a value, or all of it
    bare_first = F.contains(F.concat(F.substring_index(entries, f";{key}=", 1), F.lit(";")), bare)
    return F.nullif(F.when(F.contains(entries, bare) & bare_first, F.lit("1")).otherwise(info_value(key)), F.lit("."))


def format_text(key: str) -> Column:
    """The first sample's value of the key; null for ``.``, a missing key or a short sample."""
    first = F.nullif(F.get("samples", F.lit(0)), F.lit(""))
    at = F.nullif(F.array_position(F.split("format", ":"), key), F.lit(0).cast("bigint"))
    return F.nullif(F.get(F.split(first, ":"), (at - 1).cast("int")), F.lit("."))


def raw_text(field: FieldRef) -> Column:
    """The text of a field; null where it is missing."""
    match field.source:
        case "INFO":
            return info_text(field.key)
        case "FORMAT":
            return format_text(field.key)
        case "CHROM":
            return F.col("chrom")
        case "POS":
            return F.when(to_long(F.col("pos")).isNotNull(), F.col("pos"))
        case "QUAL":
            return F.when(to_double(F.col("qual")).isNotNull(), F.col("qual"))
        case "FILTER":
            return F.nullif(F.nullif(F.col("filter"), F.lit(".")), F.lit(""))
    raise AssertionError(field)


@dataclass(frozen=True)
class Kind:
    """How a field's text is read: text, whole, real, flag, or guess (whole, else real, else text)."""

    name: str
    many: bool = False


def kind_of(operand, header: Header) -> Kind:
    if isinstance(operand, Text):
        return Kind("text")
    if isinstance(operand, Number):
        return Kind("real")
    if operand.source == "INFO":
        declared = header.infos.get(operand.key)
        if declared is None:
            return Kind("guess")
        return Kind({"Integer": "whole", "Float": "real", "Flag": "flag"}.get(declared.type, "text"), declared.number != "1")
    return Kind({"POS": "whole", "QUAL": "real", "FORMAT": "guess"}.get(operand.source, "text"))


#: Lists of plain numbers, or one.
PLAIN_INTEGERS, PLAIN_FLOATS = r"\A[0-9]{1,18}(?:,[0-9]{1,18})*\z", r"\A[0-9]+(?:\.[0-9]+)?(?:,[0-9]+(?:\.[0-9]+)?)*\z"


def as_number(text: Column, kind: Kind) -> Column:
    """A single value's number, null where it isn't one; texts are read as numbers too."""
    return F.when(text.isNotNull(), F.lit(1.0)) if kind.name == "flag" else to_double(text)


def _numbers(a: Column, operator: str, b: Column) -> Column:
    """IEEE comparison: with a NaN only ``!=`` holds.  Null if a side is."""
    ordinary = ~F.isnan(a) & ~F.isnan(b)
    known = a.isNotNull() & b.isNotNull()
    return F.when(known, ~ordinary | (a != b) if operator == "!=" else ordinary & _ordered(a, operator, b))


def _ordered(a: Column, operator: str, b: Column) -> Column:
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[operator]


def loaded(operand, header: Header) -> Column:
    """struct<number, text, worded, array> of an operand; text is null where it is missing.

    ``number`` is also that of a text that is a number; ``worded`` says whether it is a text by kind; ``array`` holds the
    numbers of a value with several, which then has no number of its own.
    """
    if isinstance(operand, Number):
        value = F.lit(operand.value)
        return F.struct(value.alias("number"), plain_text(value).alias("text"), F.lit(False).alias("worded"), F.lit(None).cast("array<double>").alias("array"))
    kind = kind_of(operand, header)
    no_array = F.lit(None).cast("array<double>")

    def pack(number: Column, text: Column, worded: Column, array: Column = no_array) -> Column:
        return F.struct(number.cast("double").alias("number"), text.alias("text"), worded.alias("worded"), array.alias("array"))

    def single(text: Column) -> Column:
        whole, real = to_long(text), to_double(text)
        match kind.name:
            case "flag":
                return pack(as_number(text, kind), F.when(text.isNotNull(), F.lit("1")), F.lit(False))
            case "whole":
                return pack(F.coalesce(whole.cast("double"), real), F.coalesce(whole.cast("string"), text), whole.isNull())
            case "real":
                return pack(real, F.coalesce(plain_text(real), text), real.isNull())
            case "guess":
                return pack(F.coalesce(whole.cast("double"), real), F.coalesce(whole.cast("string"), plain_text(real), text), whole.isNull() & real.isNull())
        return pack(real, text, F.lit(True))

    def several(parts: Column) -> Column:
        joined = F.when(F.size(parts) > 0, F.array_join(parts, ","))
        words = pack(to_double(joined), joined, F.lit(True))
        if kind.name not in ("whole", "real"):
            return words
        numbers = F.transform(parts, (lambda e: to_long(e).cast("double")) if kind.name == "whole" else to_double)
        of = lambda n: F.when((F.size(n) == 0) | F.exists(n, lambda x: x.isNull()), words).otherwise(pack(F.lit(None), F.array_join(F.transform(n, plain_text), ","), F.lit(False), n))
        return let(numbers, of)

    if isinstance(operand, Text):
        return single(F.lit(operand.value))
    if not kind.many:
        return let(raw_text(operand), single)
    return let(raw_text(operand), lambda t: F.when(t.contains(","), let(F.filter(F.split(t, ","), lambda e: e != "."), several)).otherwise(single(t)))


def compare_loaded(left: Column, operator: str, right: Column) -> Column:
    """False where either side is missing.  An array on the left holds if one of its numbers does; on the right it is text."""
    a, b = left["text"], right["text"]
    if operator in ("~", "!~"):
        held = F.contains(a, b)
        return F.coalesce((left["worded"] | left["array"].isNotNull()) & right["worded"] & (held if operator == "~" else ~held), F.lit(False))
    some = F.exists(left["array"], lambda x: _numbers(x, operator, right["number"]))
    single = F.coalesce(_numbers(left["number"], operator, right["number"]), _ordered(a, operator, b))
    return F.coalesce(a.isNotNull() & b.isNotNull() & F.when(left["array"].isNotNull(), some).otherwise(single), F.lit(False))


def compare_with_constant(field: FieldRef, operator: str, constant: Number | Text, header: Header) -> Column | None:
    """The usual case, a field against a constant, without the general form's structs; None where that is needed."""
    kind, text = kind_of(field, header), raw_text(field)
    value = constant.value if isinstance(constant, Number) else _constant_number(constant.value)
    if operator in ("~", "!~"):
        if kind.name != "text" or kind.many or not isinstance(constant, Text):
            return None
        held = F.contains(text, F.lit(constant.value))
        return F.coalesce(held if operator == "~" else ~held, F.lit(False))
    if value is None:
        return F.coalesce(_ordered(text, operator, F.lit(constant.value)), F.lit(False)) if kind.name == "text" and not kind.many else None
    if value != value or kind.many and kind.name not in ("whole", "real"):
        return None
    # with a constant that is no NaN, Spark's order differs from IEEE only where a NaN counts as greatest
    def number(x: Column) -> Column:
        found = _ordered(x, operator, F.lit(value))
        return found & ~F.isnan(x) if operator in (">", ">=") else found

    shown = plain_text(F.lit(value)) if isinstance(constant, Number) else F.lit(constant.value)
    single = lambda t: F.coalesce(number(as_number(t, kind)), _ordered(t, operator, shown), F.lit(False))
    if not kind.many:
        return single(text)

    def several(parts: Column) -> Column:
        numbers = F.transform(parts, (lambda e: to_long(e).cast("double")) if kind.name == "whole" else to_double)
        joined = F.array_join(parts, ",")
        of = lambda n: F.when(F.exists(n, lambda x: x.isNull()), _ordered(joined, operator, shown)).otherwise(F.exists(n, number))
        return F.when(F.size(parts) == 0, F.lit(False)).otherwise(let(numbers, of))

    def closely(t: Column) -> Column:
        return F.coalesce(F.when(t.contains(","), let(F.filter(F.split(t, ","), lambda e: e != "."), several)).otherwise(single(t)), F.lit(False))

    if field.source != "INFO":
        return closely(text)
    # usual values, which have numbers only, need no closer look; a bare key before them is not one
    plain = info_value(field.key)
    bare = F.contains(F.concat(F.lit(";"), F.col("info"), F.lit(";")), F.lit(f";{field.key};"))
    one, list_ = (PLAIN_INTEGER, PLAIN_INTEGERS) if kind.name == "whole" else (PLAIN_FLOAT, PLAIN_FLOATS)
    holds = lambda e: _ordered(e.try_cast("double"), operator, F.lit(value))
    usual = F.when(plain.rlike(one), holds(plain)).when(plain.rlike(list_), F.exists(F.split(plain, ","), holds))
    # nothing to compare in a record without the key; what is left over is looked at closely
    return F.when(bare, let(text, closely)).when(plain.isNull(), F.lit(False)).otherwise(F.coalesce(usual, let(text, closely)))


def _constant_number(text: str) -> float | None:
    return float(text) if re.fullmatch(r"[+-]?(?:(?i:inf|infinity|nan)|(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", text) else None


def compile_expr(tree, header: Header) -> Column:
    """A Boolean column over the columns of ``VariantSet.df``."""
    if isinstance(tree, Not):
        return ~compile_expr(tree.part, header)
    if isinstance(tree, Both):
        return compile_expr(tree.left, header) & compile_expr(tree.right, header)
    if isinstance(tree, Either):
        return compile_expr(tree.left, header) | compile_expr(tree.right, header)
    if isinstance(tree, Exists):
        return F.coalesce(loaded(tree.field, header)["text"].isNotNull(), F.lit(False))
    assert isinstance(tree, Compare)
    if isinstance(tree.left, FieldRef) and not isinstance(tree.right, FieldRef):
        found = compare_with_constant(tree.left, tree.operator, tree.right, header)
        if found is not None:
            return found
    sides = F.struct(loaded(tree.left, header).alias("a"), loaded(tree.right, header).alias("b"))
    return let(sides, lambda s: compare_loaded(s["a"], tree.operator, s["b"]))
