"""Numbers as text and back, by the rules of the record format rather than Spark's casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER = r"\A([+-]?[0-9]+)\z"
#: A sign before nan is left out of the group: Spark's cast knows nan only without one.
FLOAT = r"\A(?:[+-](?=(?i:nan)\z))?((?i:nan)|[+-]?(?:(?i:inf|infinity)|(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?))\z"


#: Texts that every reader takes for the same number, and that need no closer look.
PLAIN_INTEGER, PLAIN_FLOAT = r"\A[0-9]{1,18}\z", r"\A[0-9]+(?:\.[0-9]+)?\z"


def to_long(text: Column) -> Column:
    """The whole number that a text is, else null; Spark's casts would also take spaces."""
    return F.when(text.rlike(PLAIN_INTEGER), text.try_cast("bigint")).otherwise(F.regexp_extract(text, INTEGER, 1).try_cast("bigint"))


def to_double(text: Column) -> Column:
    """The number that a text is, else null; not ``1d``, ``1.0f`` or `` 5 ``."""
    return F.when(text.rlike(PLAIN_FLOAT), text.try_cast("double")).otherwise(F.regexp_extract(text, FLOAT, 1).try_cast("double"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def plain_text(number: Column) -> Column:
    """Shortest decimal text without exponent and without a trailing ``.0``; for double or float columns."""

    def shown(text: Column) -> Column:
        bare = F.regexp_replace(text, r"\A-", "")
        sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
        plain = F.regexp_replace(bare, r"\.0\z", "")
        return F.concat(sign, F.when(text == "NaN", text).when(bare == "Infinity", F.lit("inf")).when(bare.contains("E"), let(bare, _without_power)).otherwise(plain))

    return F.when(number.isNotNull(), let(number.cast("string"), shown))


def _without_power(text: Column) -> Column:
    """``d.dddE<power>`` written out."""
    whole, part = F.substring_index(text, ".", 1), F.regexp_extract(text, r"\.([0-9]*?)0*E", 1)
    power, digits = F.substring_index(text, "E", -1).cast("int"), F.concat(whole, part)
    large = F.when(F.char_length(part) <= power, F.rpad(digits, power + 1, "0")).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(400))))
    return F.when(power >= 0, large).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
